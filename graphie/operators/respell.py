"""Apply a dictionary to text columns.

The plan for a dictionary of checked size is one scan and one projection: words
and separators come from two regex passes, each word goes through the case ladder
inside ``transform``, and the pieces are woven back. Nothing is exploded or
shuffled. With a dictionary over the bound each row gets the entries its words can ask
for by a join (``lookup.row_lookup``), and the projection is the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphie.functions import text as T
from graphie.functions.plan import computed_once, spread_key
from graphie.operators.dictionary import Dictionary
from graphie.operators.lookup import Find, Lookup, RowLookup, constant_lookup, row_lookup, with_lookups

def with_plurals(entries: DataFrame, marker: str | None) -> DataFrame:
    """Entries with ``plural``: what the plural in s becomes."""
    plural = F.lit(None).cast("string") if marker is None else F.concat("new", F.lit(marker))
    return entries.withColumn("plural", F.when(F.col("new") != "", plural))


def asked_forms(words: Column, marker: str | None, convert_uppercase: bool) -> Column:
    """Every form that ``respell_word`` may look up for some words."""

    def forms(x: Column) -> Column:
        def with_singular(*ys: Column) -> Column:
            singular = [] if marker is None else [F.when(F.endswith(y, F.lit("s")), T.drop_last(y)) for y in ys]
            return F.array(*ys, *singular)

        low = F.lower(x)
        upper = [low, T.capitalize(low)] if convert_uppercase else []
        return F.when(T.is_capitalized(x), with_singular(x, T.uncapitalize(x), *upper)).otherwise(with_singular(x))

    def units(w: Column) -> Column:
        compound = F.contains(w, F.lit("-")) & w.rlike(T.HYPHENATED)
        return F.when(compound, F.concat(F.array(w), F.split(w, "-"))).otherwise(F.array(w))

    every = F.flatten(F.transform(F.flatten(F.transform(F.array_distinct(words), units)), forms))
    return F.filter(every, lambda x: x != "")


def _entries(
    df: DataFrame, words: str, table: DataFrame, values: list[str], key: str | list[str] | None,
    marker: str | None, convert_uppercase: bool, max_rows: int | None,
) -> tuple[DataFrame, Lookup | RowLookup]:
    """Rows with a lookup of ``table(old, values)`` for their words: a constant if it is small enough."""
    constant = constant_lookup(table, "old", values, **({} if max_rows is None else {"max_rows": max_rows}))
    if constant is not None:
        return df, constant
    if key is None:
        raise ValueError("the dictionary is too large to send to every task; pass key=")
    keys = [key] if isinstance(key, str) else list(key)
    return row_lookup(df, keys, asked_forms(F.col(words), marker, convert_uppercase), table, "old", values, "_entries")


def ladder(w: Column, find: Find, marker: str | None, convert_uppercase: bool) -> Column:
    """The replacement of one word. Null or '' when it stays as it is.

    An array lambda has no common subexpressions, so every branch is written to look
    a form up once.
    """

    def through(wu: Column, recase: Callable[[Column], Column]) -> Column:
        direct = recase(find(wu)["new"])
        if marker is None:
            return direct
        plural = F.when(F.endswith(wu, F.lit("s")), recase(find(T.drop_last(wu))["plural"]))
        return F.coalesce(direct, plural)

    capital = through(T.uncapitalize(w), T.capitalize)
    if convert_uppercase:
        low = F.lower(w)
        proper = find(T.capitalize(low)).isNotNull()
        capital = F.when(
            T.is_all_upper(w), F.when(proper, F.lit("")).otherwise(through(low, F.upper))
        ).otherwise(capital)
    return F.when(T.is_capitalized(w), F.coalesce(find(w)["new"], capital)).otherwise(
        through(w, lambda x: x)
    )


def replaced(ws: Column, results: Column) -> Column:
    """Words with their ladder results put in."""
    return F.zip_with(ws, results, lambda w, r: F.when(r != "", r).otherwise(w))


def respell_word(w: Column, find: Find, marker: str | None, convert_uppercase: bool) -> Column:
    """``ladder`` plus the hyphen rule: a compound that is not an entry is done by parts."""

    def one(x: Column) -> Column:
        return ladder(x, find, marker, convert_uppercase)

    parts = F.split(w, "-")
    by_parts = F.array_join(replaced(parts, F.transform(parts, one)), "-")
    split = F.contains(w, F.lit("-")) & w.rlike(T.HYPHENATED) & find(w).isNull()
    return F.when(split, by_parts).otherwise(one(w))


def respell(
    df: DataFrame,
    text_col: str,
    dictionary: Dictionary,
    *,
    key: str | list[str] | None = None,
    out_col: str | None = None,
    count_col: str | None = None,
    convert_uppercase: bool = True,
    marker: str | None | object = ...,
    pattern: str = T.WORD,
    normalize: bool = True,
    max_rows: int | None = None,
) -> DataFrame:
    """Rewrite ``text_col``. ``count_col`` adds the number of words that changed.

    ``key`` names the columns that identify a row; only the plan for very large dictionaries needs
    them. ``max_rows`` sets another bound for a dictionary that is sent to every task.
    """
    out_col = out_col or text_col
    m = dictionary.meta.marker() if marker is ... else marker
    keep = [c for c in df.columns if c not in (out_col, count_col)]
    src = T.nfc(text_col) if normalize else F.col(text_col)
    step = df.withColumn("_t", src).withColumn("_w", T.words("_t", pattern))
    entries = with_plurals(dictionary.df.select("old", "new"), m)
    step, table = _entries(step, "_w", entries, ["new", "plural"], key, m, convert_uppercase, max_rows)
    step = with_lookups(
        step,
        [table],
        "_r",
        lambda find: F.transform("_w", lambda w: respell_word(w, find, m, convert_uppercase)),
    ).withColumn("_n", computed_once(replaced(F.col("_w"), F.col("_r"))))
    out = [F.when(F.col("_t").isNotNull(), T.weave(T.separators("_t", pattern), "_n")).alias(out_col)]
    if count_col:
        out.append(changed_count("_w", "_n").alias(count_col))
    return step.select(*keep, *out)


def changed_count(ws: str, ns: str) -> Column:
    return F.size(F.filter(F.zip_with(ws, ns, lambda a, b: a != b), lambda x: x))


def resolve_words(
    vocabulary: DataFrame, word_col: str, dictionary: Dictionary, *, convert_uppercase: bool = True,
    marker: str | None | object = ...,
) -> DataFrame:
    """``word, new_word`` for a table of distinct words, by joins.

    Up to four equi-joins with the dictionary (the word, its other cases, its
    singular); Catalyst broadcasts or shuffles the dictionary by its size. The dictionary
    has a key once, and words that lack the key of a join are dealt by themselves.
    """
    m = dictionary.meta.marker() if marker is ... else marker
    w = F.col(word_col)

    def d(name: str, on: str) -> DataFrame:
        known = dictionary.df.filter(~F.col("old").startswith("\x00"))
        return known.select(F.col("old").alias(on), F.col("new").alias(name))

    up, allup = T.is_capitalized(w), T.is_all_upper(w)
    base = vocabulary.join(d("_exact", word_col), word_col, "left")
    low = F.lower(w)
    if convert_uppercase:
        base = base.withColumn("_cap", F.when(allup, T.capitalize(low))).withColumn("_cap", spread_key("_cap", word_col))
        base = base.join(d("_proper", "_cap"), "_cap", "left")
        mode = (
            F.when(~up | F.col("_exact").isNotNull(), "same")
            .when(allup & F.col("_proper").isNotNull(), "stop")
            .when(allup, "upper")
            .otherwise("capital")
        )
    else:
        mode = F.when(~up | F.col("_exact").isNotNull(), "same").otherwise("capital")
    base = base.withColumn("_mode", mode).withColumn(
        "_wu",
        F.when(F.col("_mode") == "same", w).when(F.col("_mode") == "upper", low).when(
            F.col("_mode") == "capital", T.uncapitalize(w)
        ),
    )
    base = base.join(d("_r1", "_wu"), "_wu", "left")
    value = F.col("_r1")
    if m is not None:
        base = base.withColumn("_sing", T.depluralize(F.col("_wu"))).withColumn("_sing", spread_key("_sing", word_col))
        base = base.join(d("_r2", "_sing"), "_sing", "left")
        value = F.coalesce(value, F.concat(F.nullif("_r2", F.lit("")), F.lit(m)))
    recased = (
        F.when(F.col("_mode") == "upper", F.upper(value))
        .when(F.col("_mode") == "capital", T.capitalize(value))
        .otherwise(value)
    )
    return base.select(word_col, F.coalesce(F.nullif(recased, F.lit("")), w).alias("new_word"))


def respell_guarded(
    df: DataFrame,
    text_col: str,
    dictionary: Dictionary,
    collisions: DataFrame,
    foreign: Column,
    *,
    out_col: str | None = None,
    count_col: str | None = None,
    marker: str | None | object = ...,
    pattern: str = T.WORD_BROWSER,
    key: str | list[str] | None = None,
    max_rows: int | None = None,
) -> DataFrame:
    """Browser form: spans judged ``foreign`` are left alone from the first word that
    is both rewritable and in ``collisions(entry)`` on. Words before it are rewritten.

    Capitals are kept as capitals of one letter only (no whole-word upper case). ``key`` and
    ``max_rows`` are those of ``respell``.
    """
    out_col = out_col or text_col
    m = dictionary.meta.marker() if marker is ... else marker
    entries = dictionary.df.join(
        collisions.select(F.col("entry").alias("old"), F.lit(True).alias("hit")), "old", "left"
    ).select("old", "new", F.coalesce("hit", F.lit(False)).alias("hit"))
    entries = with_plurals(entries, m)
    words = df.withColumn("_w", T.words(text_col, pattern)).withColumn("_f", F.coalesce(foreign, F.lit(False)))
    words, table = _entries(words, "_w", entries, ["new", "plural", "hit"], key, m, False, max_rows)

    def collides(w: Column, find: Find) -> Column:
        """Would the word be rewritten through an entry of the collision list?"""

        def entry_hit(wu: Column) -> Column:
            direct = find(wu)
            one = F.when(direct["new"] != "", direct["hit"]).when(direct["new"] == "", F.lit(False))
            if m is None:
                return one
            sing = find(T.drop_last(wu))
            return F.coalesce(
                one, F.when(F.endswith(wu, F.lit("s")) & (sing["new"] != ""), sing["hit"])
            )

        exact = find(w)
        return F.coalesce(
            F.when(
                T.is_capitalized(w) & exact["new"].isNull(), entry_hit(T.uncapitalize(w))
            ).otherwise(entry_hit(w)),
            F.lit(False),
        )

    # Compounds count through their parts, so work on the words after splitting.
    keep = [c for c in df.columns if c not in (out_col, count_col)]

    def parts(w: Column, find: Find) -> Column:
        split = F.contains(w, F.lit("-")) & w.rlike(T.HYPHENATED) & find(w).isNull()
        return F.when(split, F.split(w, "-")).otherwise(F.array(w))

    step = with_lookups(
        words,
        [table],
        "_p",
        lambda find: F.transform("_w", lambda w: parts(w, find)),
    )
    step = with_lookups(
        step,
        [table],
        "_first",
        lambda find: F.when(
            F.col("_f"),
            F.array_position(F.transform(F.flatten("_p"), lambda w: collides(w, find)), F.lit(True)),
        ).otherwise(F.lit(0)),
    )
    sizes = F.transform("_p", lambda p: F.size(p))
    step = step.withColumn(
        "_start",
        F.when(
            F.col("_first") > 0,
            F.aggregate(
                sizes,
                F.array(F.lit(0)),
                lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)),
            ),
        ),
    )

    def rewrite(w: Column, i: Column, find: Find) -> Column:
        start = F.get(F.col("_start"), i)

        def part(p: Column, j: Column) -> Column:
            guarded = (F.col("_first") > 0) & (start + j + 1 >= F.col("_first"))
            return F.when(~guarded, ladder(p, find, m, False))

        return F.array_join(replaced(w, F.transform(w, part)), "-")

    step = with_lookups(
        step, [table], "_n", lambda find: F.transform("_p", lambda w, i: rewrite(w, i, find))
    )
    out = [
        F.when(F.col(text_col).isNotNull(), T.weave(T.separators(text_col, pattern), "_n")).alias(out_col)
    ]
    if count_col:
        out.append(changed_count("_w", "_n").alias(count_col))
    return step.select(*keep, *out)
