"""Tokenising, the case ladder and whole-text respelling."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphie.functions import text as T
from graphie.operators import respell as R
from graphie.operators.dictionary import Dictionary
from graphie.plans.registry import (
    DICTS_SQL, SMOKE_SQL, VOCAB_SQL, WORD_SQL, dict_eau, documents, query, smoke_dictionary, table, vocabulary,
)


def ladder_sql(words: str, d: str = "d", marker: str | None = "s", upper: bool = True) -> str:
    """``lad(w, out)`` for the distinct words of a CTE ``words(w)``."""
    mode = "CASE WHEN NOT regexp_matches(x.w, '^\\p{Lu}') OR e.new IS NOT NULL THEN 'same'"
    if upper:
        mode += " WHEN regexp_full_match(x.w, '\\p{Lu}+') THEN (CASE WHEN p.new IS NOT NULL THEN 'stop' ELSE 'upper' END)"
    mode += " ELSE 'capital' END"
    plural = (
        f"WHEN r1.new IS NULL AND r2.new <> '' THEN r2.new || '{marker}'" if marker is not None else ""
    )
    return f"""
lad0 AS (SELECT x.w, {mode} AS mode FROM (SELECT DISTINCT w FROM {words}) x
  LEFT JOIN {d} e ON e.old = x.w
  LEFT JOIN {d} p ON p.old = upper(substr(lower(x.w), 1, 1)) || substr(lower(x.w), 2)),
lad1 AS (SELECT w, mode, CASE mode WHEN 'same' THEN w WHEN 'upper' THEN lower(w)
  WHEN 'capital' THEN lower(substr(w, 1, 1)) || substr(w, 2) END AS wu FROM lad0),
lad2 AS (SELECT w, mode, CASE WHEN r1.new <> '' THEN r1.new {plural} END AS r FROM lad1
  LEFT JOIN {d} r1 ON r1.old = wu
  LEFT JOIN {d} r2 ON wu LIKE '%s' AND r2.old = substr(wu, 1, length(wu) - 1)),
lad AS (SELECT w, coalesce(CASE mode WHEN 'upper' THEN upper(r)
  WHEN 'capital' THEN upper(substr(r, 1, 1)) || substr(r, 2) ELSE r END, w) AS out FROM lad2)"""


def pieces_sql(tab: str, keys: str, pattern: str = WORD_SQL) -> str:
    """Words ``ws`` and separators ``ss`` of each row, with positions."""
    return f"""
src AS (SELECT {keys}, text, regexp_extract_all(text, '{pattern}') AS ws,
  regexp_split_to_array(text, '{pattern}') AS ss FROM {tab}),
wds AS (SELECT {keys}, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM src)"""


def respell_sql(tab: str, keys: str, d_sql: str, **kw) -> str:
    return f"""
WITH {d_sql}, {pieces_sql(tab, keys)}, {ladder_sql('wds', **kw)},
new AS (SELECT {keys}, list(l.out ORDER BY i) AS ns, count(*) FILTER (l.out <> x.w) AS n_changed
  FROM wds x JOIN lad l ON l.w = x.w GROUP BY {keys})
SELECT {', '.join('s.' + k.strip() for k in keys.split(','))}, coalesce(n.n_changed, 0) AS n_changed,
  CASE WHEN n.ns IS NULL THEN s.text ELSE
    array_to_string(list_transform(list_zip(s.ss, n.ns), lambda p: p[1] || coalesce(p[2], '')), '') END AS text
FROM src s LEFT JOIN new n USING ({keys})"""


@query("respell_documents", respell_sql("documents", "doc_id", SMOKE_SQL))
def respell_documents(spark, sf):
    docs = documents(spark, sf, "doc_id", "text")
    return R.respell(docs, "text", smoke_dictionary(spark), count_col="n_changed")


@query("respell_conversations", respell_sql("conversations", "conv_id, turn", SMOKE_SQL))
def respell_conversations(spark, sf):
    turns = table(spark, sf, "conversations", "conv_id").select("conv_id", "turn", "text")
    return R.respell(turns, "text", smoke_dictionary(spark), count_col="n_changed")


@query(
    "respell_keep_uppercase_no_plurals",
    respell_sql("documents", "doc_id", SMOKE_SQL, marker=None, upper=False),
)
def respell_keep_uppercase_no_plurals(spark, sf):
    docs = documents(spark, sf, "doc_id", "text")
    return R.respell(
        docs, "text", smoke_dictionary(spark), count_col="n_changed", convert_uppercase=False, marker=None
    )


@query("respell_by_vocabulary_dictionary", respell_sql("documents", "doc_id", f"{DICTS_SQL}, d AS (SELECT * FROM d1)"))
def respell_by_vocabulary_dictionary(spark, sf):
    docs = documents(spark, sf, "doc_id", "text")
    return R.respell(docs, "text", Dictionary(dict_eau(spark, sf)), key="doc_id", count_col="n_changed", marker="s")


@query("respell_by_shuffle_join", respell_sql("documents", "doc_id", f"{DICTS_SQL}, d AS (SELECT * FROM d1)"))
def respell_by_shuffle_join(spark, sf):
    """The plan for dictionaries over the bound, forced."""
    docs = documents(spark, sf, "doc_id", "text")
    return R.respell(
        docs, "text", Dictionary(dict_eau(spark, sf)), key="doc_id", count_col="n_changed", marker="s", max_rows=0
    )


@query(
    "token_counts",
    f"""SELECT doc_id, len(regexp_extract_all(text, '{WORD_SQL}')) AS n_words,
  length(array_to_string(regexp_split_to_array(text, '{WORD_SQL}'), '')) AS n_outside,
  array_to_string(regexp_extract_all(text, '{WORD_SQL}'), '|') AS words FROM documents""",
)
def token_counts(spark, sf):
    return documents(spark, sf).select(
        "doc_id",
        F.size(T.words("text")).alias("n_words"),
        F.length(F.array_join(T.separators("text"), "")).alias("n_outside"),
        F.array_join(T.words("text"), "|").alias("words"),
    )


@query(
    "tokens_are_lossless",
    "SELECT doc_id, md5(text) AS digest FROM documents",
)
def tokens_are_lossless(spark, sf):
    toks = documents(spark, sf).select("doc_id", T.tokens("text").alias("t"))
    whole = F.array_join(F.transform("t", lambda t: t["tok"]), "")
    return toks.select("doc_id", F.md5(whole).alias("digest"))


@query(
    "normalised_text",
    "SELECT doc_id, md5(nfc_normalize(replace(text, 'é', 'é'))) AS digest FROM documents".replace(
        "replace(text, 'é', 'é')", "replace(text, 'é', 'e' || chr(769))"
    ),
)
def normalised_text(spark, sf):
    """Documents with é written in two code points, brought back to one."""
    docs = documents(spark, sf)
    apart = docs.select("doc_id", F.replace("text", F.lit("é"), F.lit("é")).alias("t"))
    return apart.select("doc_id", F.md5(T.nfc("t")).alias("digest"))


@query(
    "hyphen_parts",
    f"""WITH tok AS (SELECT DISTINCT unnest(regexp_extract_all(replace(text, ' ', '-'), '{WORD_SQL}')) AS w FROM documents)
SELECT w AS word, array_to_string(string_split(w, '-'), ' - ') AS parts, len(string_split(w, '-')) AS n_parts
FROM tok WHERE contains(w, '-') AND regexp_full_match(w, '[\\p{{L}}-]+')""",
)
def hyphen_parts(spark, sf):
    """Compounds made by joining neighbouring words, cut at their hyphens."""
    docs = documents(spark, sf).select(F.replace("text", F.lit(" "), F.lit("-")).alias("t"))
    w = docs.select(F.explode(T.words("t")).alias("word")).distinct()
    w = w.filter(F.contains("word", F.lit("-")) & F.col("word").rlike(T.HYPHENATED))
    parts = T.split_hyphens(F.col("word"))
    return w.select(
        "word",
        F.array_join(F.transform(parts, lambda p: F.when(p == "-", " - ").otherwise(p)), "").alias("parts"),
        F.size(F.filter(parts, lambda p: p != "-")).alias("n_parts"),
    )


@query(
    "respell_distinct_words",
    f"WITH {VOCAB_SQL}, {SMOKE_SQL}, {ladder_sql('tok')} SELECT w AS word, out AS new_word FROM lad",
)
def respell_distinct_words(spark, sf):
    docs = documents(spark, sf)
    words = docs.select(F.explode(T.words("text")).alias("word")).distinct()
    return R.resolve_words(words, "word", smoke_dictionary(spark))


@query(
    "case_functions",
    f"""WITH {VOCAB_SQL} SELECT DISTINCT w AS word, replace(upper(substr(w, 1, 1)), 'ẞ', 'SS') || substr(w, 2) AS capitalized,
  lower(substr(w, 1, 1)) || substr(w, 2) AS uncapitalized,
  CASE WHEN regexp_full_match(w, '\\p{{Lu}}+') THEN lower(w) END AS lowered, replace(upper(w), 'ẞ', 'SS') AS uppered,
  CASE WHEN w LIKE '%s' THEN substr(w, 1, length(w) - 1) END AS singular FROM tok""",
)
def case_functions(spark, sf):
    docs = documents(spark, sf)
    w = docs.select(F.explode(T.words("text")).alias("word")).distinct()
    return w.select(
        "word",
        T.capitalize("word").alias("capitalized"),
        T.uncapitalize("word").alias("uncapitalized"),
        T.lowercase_if_all_upper("word").alias("lowered"),
        F.upper("word").alias("uppered"),
        T.depluralize("word").alias("singular"),
    )


@query(
    "change_counts_by_source",
    f"""WITH {SMOKE_SQL}, {VOCAB_SQL}, {ladder_sql('tok')}
SELECT d.source, d.lang, count(DISTINCT d.doc_id) AS n_docs,
  count(*) FILTER (l.out IS NOT NULL AND l.out <> t.w) AS n_changed
FROM documents d LEFT JOIN tok t ON t.doc_id = d.doc_id LEFT JOIN lad l ON l.w = t.w GROUP BY 1, 2""",
)
def change_counts_by_source(spark, sf):
    docs = documents(spark, sf, "doc_id", "source", "lang", "text")
    r = R.respell(docs, "text", smoke_dictionary(spark), count_col="n")
    return r.groupBy("source", "lang").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("n").cast("bigint").alias("n_changed")
    )


@query(
    "stripped_words",
    f"""WITH {VOCAB_SQL} SELECT word, replace(strip_accents(word), 'œ', 'oe') AS stripped,
  CAST(octet_length(encode(replace(strip_accents(word), 'œ', 'oe'))) AS BIGINT) AS n_bytes FROM vocab""",
)
def stripped_words(spark, sf):
    v = vocabulary(spark, sf).select("word", T.strip_marks_unicode("word").alias("stripped"))
    return v.withColumn("n_bytes", F.octet_length("stripped").cast("bigint"))
