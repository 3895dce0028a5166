"""Is a span in the language of the dictionary? Digram entropy and diacritic density."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphie.functions.plan import computed_once
from graphie.operators.lookup import Lookup, constant_lookup
from graphie.sources.files import stored

# Fixed values.
UNKNOWN_DIGRAM = 30.0
FRENCH_DIACRITICS = "éèêëàçô"
MIN_DENSITY = 0.005
MIN_SHARE = 30
FR_HOST_BONUS = 10.0
# Elided articles: far likelier in French than any count of plain digrams shows.
OVERRIDES = {"fr": {"d'": 0.1, "l'": 0.1}, "en": {"d'": 4.1, "l'": 4.1}}


def digrams(text: Column | str) -> Column:
    """All overlapping pairs of lower-cased characters, in one pass over the text."""
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(t), F.lit(r"(?s)(?=(..))"), F.lit(1))


def digram_counts(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """``lang, digram, n``. Counted per row first, then summed, so that the shuffle
    carries one row per digram and task and no language is a hot key."""
    return (
        df.select(F.col(lang_col).alias("lang"), F.explode(digrams(text_col)).alias("digram"))
        .groupBy("lang", "digram")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def parse_digram_counts(df: DataFrame, lang_col: str, spec_col: str) -> DataFrame:
    """Read counts written as ``xx 12/yy 3`` for each language."""
    line = F.explode(F.filter(F.split(spec_col, "/"), lambda x: x != ""))
    return df.select(F.col(lang_col).alias("lang"), line.alias("l")).select(
        "lang",
        F.substring_index("l", " ", 1).alias("digram"),
        F.substring_index("l", " ", -1).cast("bigint").alias("n"),
    )


def fit_digram_model(counts: DataFrame, overrides: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """``lang, digram, entropy`` with entropy = log2(total) - log2(n). The counts are made once, though they are used twice."""
    counts = stored(counts, "digrams")
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    fitted = counts.join(F.broadcast(total), "lang").select(
        "lang", "digram", (F.log2("total") - F.log2("n")).alias("entropy")
    )
    fixed = [(lg, d, e) for lg, m in (overrides or {}).items() for d, e in m.items()]
    if not fixed:
        return fitted
    extra = counts.sparkSession.createDataFrame(fixed, "lang string, digram string, entropy double")
    return fitted.join(extra, ["lang", "digram"], "left_anti").unionByName(extra)


def _paired(model: DataFrame, first: str, second: str) -> DataFrame:
    def pick(lang):
        return F.max(F.when(F.col("lang") == lang, F.nullif("entropy", F.lit(0.0))))

    return model.filter(F.col("lang").isin(first, second)).groupBy("digram").agg(
        F.coalesce(pick(first), F.lit(UNKNOWN_DIGRAM)).alias("e1"),
        F.coalesce(pick(second), F.lit(UNKNOWN_DIGRAM)).alias("e2"),
    )


PIECE = 1 << 20  # characters scored at a time


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.int64) << 21) | b


def digram_sums(texts: list[str], keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums [2, texts] of the values [2, keys + 1] of all digrams of lower-cased texts, each added in the order of its text.

    ``keys`` are sorted pairs of code points; the last value is that of an unknown pair. As in ``digrams``,
    a character beyond the basic plane gives a second pair that begins with a question mark.
    """
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
    inside = row[1:] == row[:-1]
    a, b, row = points[:-1][inside], points[1:][inside], row[1:][inside]
    if (a > 0xFFFF).any():
        times = 1 + (a > 0xFFFF)
        second = (np.cumsum(times) - 1)[times == 2]
        a, b, row = np.repeat(a, times), np.repeat(b, times), np.repeat(row, times)
        a[second] = ord("?")
    pairs = _pair(a, b)
    at = np.searchsorted(keys, pairs)
    known = at < len(keys)
    known[known] = keys[at[known]] == pairs[known]
    at = np.where(known, at, len(keys))
    return np.stack([np.bincount(row, weights=v[at], minlength=len(texts)) for v in values])


def _model_arrays(model: list[tuple[str, float, float]]) -> tuple[np.ndarray, np.ndarray]:
    model = sorted((r for r in model if len(r[0]) == 2), key=lambda r: (ord(r[0][0]), ord(r[0][1])))
    first, second = (np.array([ord(r[0][i]) for r in model], np.int64) for i in (0, 1))
    return _pair(first, second), np.array([[*(r[i] for r in model), UNKNOWN_DIGRAM] for i in (1, 2)])


def _pieces(column: pa.Array) -> Iterator[list[str]]:
    held, size = [], 0
    for cell in column:
        held.append(cell.as_py() or "")
        size += len(held[-1])
        if size >= PIECE:
            yield held
            held, size = [], 0
    yield held


def _score(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    keys = values = None
    for column, model in batches:
        if keys is None:
            keys, values = _model_arrays([(d, e["e1"], e["e2"]) for bucket in json.loads(model[0].as_py()) for d, e in bucket.items()])
        sums = np.concatenate([digram_sums(p, keys, values) for p in _pieces(column)], axis=1)
        yield pa.StructArray.from_arrays([pa.array(x) for x in sums], ["s1", "s2"], mask=column.is_null())


def with_digram_sums(df: DataFrame, text_col: str, model: Lookup, name: str) -> DataFrame:
    """Add ``name struct<s1, s2>``, the sums over lower-cased texts; null for null.

    The model is a scalar subquery, as that of ``with_lookups``. The first row of each partition brings it to
    Python, and no other; as text, since nested columns cost time even where they are null.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    score = F.arrow_udf(_score, "s1 double, s2 double")
    once = df.withColumn("_first", place == 0)
    entries = F.when(F.col("_first"), model.table.select(F.to_json("t")).scalar())
    return once.withColumn(name, computed_once(score(F.lower(text_col), entries))).drop("_first")


def language_score(
    df: DataFrame,
    text_col: str,
    model: DataFrame,
    *,
    langs: tuple[str, str] = ("fr", "en"),
    base: Column | float = 0.0,
    key: str | list[str] | None = None,
) -> DataFrame:
    """Add ``score_<lang>`` for both languages, ``englishness`` and ``is_foreign``.

    The model has one row per digram, so it goes with the tasks and a
    text is scored where it is read, many texts at once. A model over the bound is joined instead, on
    digram counts per text.
    """
    a, b = langs
    paired = _paired(model, a, b)
    table = constant_lookup(paired, "digram", ["e1", "e2"])
    base_col = base if isinstance(base, Column) else F.lit(float(base))
    if table is not None:
        scored = with_digram_sums(df, text_col, table, "_s")
    else:
        if key is None:
            raise ValueError("the model is too large to send to every task; pass key=")
        keys = [key] if isinstance(key, str) else list(key)
        counts = (
            df.select(*keys, F.explode(digrams(text_col)).alias("digram"))
            .groupBy(*keys, "digram")
            .agg(F.count(F.lit(1)).alias("n"))
        )
        unknown = F.lit(UNKNOWN_DIGRAM)
        sums = (
            counts.join(paired, "digram", "left")
            .groupBy(*keys)
            .agg(
                F.struct(
                    F.sum(F.col("n") * F.coalesce("e1", unknown)).alias("s1"),
                    F.sum(F.col("n") * F.coalesce("e2", unknown)).alias("s2"),
                ).alias("_s")
            )
        )
        scored = df.join(sums, keys, "left")
    s1, s2 = F.coalesce("_s.s1", F.lit(0.0)), F.coalesce("_s.s2", F.lit(0.0))
    out = scored.withColumn(f"score_{a}", s1).withColumn(f"score_{b}", s2).drop("_s")
    return out.withColumn("englishness", F.col(f"score_{b}") + base_col - F.col(f"score_{a}")).withColumn(
        "is_foreign", F.col("englishness") < 0
    )


def base_entropy(url: Column | str) -> Column:
    """Pages of a .fr host get the benefit of the doubt."""
    u = F.col(url) if isinstance(url, str) else url
    host = F.try_parse_url(u, F.lit("HOST"))
    return F.when(F.endswith(host, F.lit(".fr")), FR_HOST_BONUS).otherwise(0.0)


def diacritic_count(text: Column | str, letters: str = FRENCH_DIACRITICS) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.length(t) - F.length(F.translate(t, letters, ""))


def diacritic_density(text: Column | str) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.when(F.length(t) > 0, diacritic_count(t) / F.length(t))


def looks_french(text: Column | str) -> Column:
    """True above half a percent of diacritics, null for an empty text."""
    t = F.col(text) if isinstance(text, str) else text
    return F.when(F.length(t) > 0, diacritic_count(t) > MIN_DENSITY * F.length(t))


def plausibly_lang(
    text: Column | str,
    lang: str,
    *,
    html_lang: Column | None = None,
    detected_share: Column | None = None,
) -> Column:
    """The language gate. In order: share found by an external detector (percent of
    ``lang``), the page's own ``lang`` attribute, diacritic density (French only),
    and finally yes. Text the gate cannot judge because there is none stays null.

    ``detected_share`` null means the detector is not available for the row.
    """
    t = F.col(text) if isinstance(text, str) else text
    empty = F.coalesce(F.length(t), F.lit(0)) == 0
    last = looks_french(t) if lang == "fr" else F.lit(True)
    gate = last
    if html_lang is not None:
        gate = F.when(F.coalesce(html_lang, F.lit("")) != "", F.startswith(html_lang, F.lit(lang))).otherwise(gate)
    if detected_share is not None:
        gate = F.when(
            detected_share.isNotNull(), F.when(~empty, detected_share >= MIN_SHARE)
        ).otherwise(gate)
    return gate
