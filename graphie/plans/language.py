"""Digram models, span scores and the language gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphie.functions import text as T
from graphie.operators import language as L
from graphie.operators import respell as R
from graphie.operators import segments as S
from graphie.plans.registry import (
    SMOKE_SQL, WORD_SQL, documents, query, smoke_dictionary, table, values_sql,
)

DIGRAMS_SQL = """
chars AS (SELECT doc_id, lang, lower(text) AS t FROM documents),
dg AS (SELECT doc_id, lang, digram, count(*) AS n FROM (SELECT doc_id, lang,
  unnest(regexp_extract_all(t, '(?s)..') || regexp_extract_all(substr(t, 2), '(?s)..')) AS digram FROM chars) GROUP BY 1, 2, 3),
counts AS (SELECT lang, digram, CAST(sum(n) AS BIGINT) AS n FROM dg WHERE lang IN ('fr', 'en') GROUP BY 1, 2),
fitted AS (SELECT c.lang, digram, log2(total) - log2(n) AS entropy FROM counts c
  JOIN (SELECT lang, sum(n) AS total FROM counts GROUP BY 1) t ON t.lang = c.lang),
fixed(lang, digram, entropy) AS (VALUES ('fr', 'd''', 0.1), ('fr', 'l''', 0.1), ('en', 'd''', 4.1), ('en', 'l''', 4.1)),
model AS (SELECT * FROM fixed UNION ALL SELECT f.* FROM fitted f ANTI JOIN fixed x ON x.lang = f.lang AND x.digram = f.digram),
pairs AS (SELECT digram, coalesce(max(nullif(entropy, 0)) FILTER (lang = 'fr'), 30) AS e1,
  coalesce(max(nullif(entropy, 0)) FILTER (lang = 'en'), 30) AS e2 FROM model GROUP BY 1)"""


def corpus_model(spark, sf):
    docs = documents(spark, sf, "doc_id", "text", "lang").filter(F.col("lang").isin("fr", "en"))
    return L.fit_digram_model(L.digram_counts(docs, "text", "lang"), L.OVERRIDES)


@query(
    "digram_model",
    f"WITH {DIGRAMS_SQL} SELECT lang, digram, round(entropy, 6) AS entropy FROM model",
)
def digram_model(spark, sf):
    return corpus_model(spark, sf).withColumn("entropy", F.round("entropy", 6))


SPEC = [("fr", "es 80/le 59/de 58/en 56/ou 26/qu 24/"), ("en", "th 116/he 100/in 87/er 77/an 69/re 60/")]


@query(
    "digram_counts_from_text",
    f"""WITH {values_sql('spec', 'lang, s', SPEC)},
parts AS (SELECT lang, unnest(string_split(s, '/')) AS p FROM spec),
c AS (SELECT lang, split_part(p, ' ', 1) AS digram, CAST(split_part(p, ' ', 2) AS BIGINT) AS n FROM parts WHERE p <> ''),
seen AS (SELECT digram, lang, count(*) AS hits FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '(?s)..')
  || regexp_extract_all(substr(lower(text), 2), '(?s)..')) AS digram FROM documents) GROUP BY 1, 2)
SELECT c.lang, c.digram, c.n, round(log2(sum(c.n) OVER (PARTITION BY c.lang)) - log2(c.n), 6) AS entropy,
  coalesce(s.hits, 0) AS hits FROM c LEFT JOIN seen s ON s.digram = c.digram AND s.lang = c.lang""",
)
def digram_counts_from_text(spark, sf):
    """Counts written as text, turned into a model, next to the corpus counts."""
    spec = spark.createDataFrame(SPEC, "lang string, s string")
    c = L.parse_digram_counts(spec, "lang", "s")
    m = L.fit_digram_model(c).withColumn("entropy", F.round("entropy", 6))
    seen = L.digram_counts(documents(spark, sf, "doc_id", "text", "lang"), "text", "lang").withColumnRenamed("n", "hits")
    return (
        c.join(m, ["lang", "digram"])
        .join(seen, ["lang", "digram"], "left")
        .select("lang", "digram", "n", "entropy", F.coalesce("hits", F.lit(0)).cast("bigint").alias("hits"))
    )


@query(
    "language_score_documents",
    f"""WITH {DIGRAMS_SQL},
s AS (SELECT doc_id, sum(n * coalesce(e1, 30)) AS s1, sum(n * coalesce(e2, 30)) AS s2
  FROM dg LEFT JOIN pairs USING (digram) GROUP BY 1)
SELECT d.doc_id, round(coalesce(s1, 0), 3) AS score_fr, round(coalesce(s2, 0), 3) AS score_en,
  coalesce(s2, 0) - coalesce(s1, 0) < 0 AS is_foreign FROM documents d LEFT JOIN s USING (doc_id)""",
)
def language_score_documents(spark, sf):
    docs = documents(spark, sf, "doc_id", "text")
    s = L.language_score(docs, "text", corpus_model(spark, sf))
    return s.select(
        "doc_id", F.round("score_fr", 3).alias("score_fr"), F.round("score_en", 3).alias("score_en"), "is_foreign"
    )


@query(
    "diacritic_density",
    """SELECT doc_id, length(regexp_replace(text, '[^éèêëàçô]', '', 'g')) AS n_diacritics,
  CASE WHEN length(text) > 0 THEN round(length(regexp_replace(text, '[^éèêëàçô]', '', 'g')) / length(text), 6) END AS density,
  CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^éèêëàçô]', '', 'g')) > 0.005 * length(text) END AS looks_french
FROM documents""",
)
def diacritic_density(spark, sf):
    return documents(spark, sf, "doc_id", "text").select(
        "doc_id",
        L.diacritic_count("text").alias("n_diacritics"),
        F.round(L.diacritic_density("text"), 6).alias("density"),
        L.looks_french("text").alias("looks_french"),
    )


@query(
    "language_gate_agreement",
    """SELECT lang, count(*) AS n, count(*) FILTER (f) AS n_french, count(*) FILTER (f = (lang = 'fr')) AS n_right FROM
(SELECT lang, CASE WHEN length(text) > 0 THEN
  length(regexp_replace(text, '[^éèêëàçô]', '', 'g')) > 0.005 * length(text) END AS f FROM documents) GROUP BY 1""",
)
def language_gate_agreement(spark, sf):
    d = documents(spark, sf, "doc_id", "text", "lang").select("lang", L.plausibly_lang("text", "fr").alias("f"))
    return d.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("f").alias("n_french"),
        F.count_if(F.col("f") == (F.col("lang") == "fr")).alias("n_right"),
    )


@query(
    "page_base_entropy",
    """SELECT page_id, CASE WHEN regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) LIKE '%.fr' THEN CAST(10 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS base
FROM pages""",
)
def page_base_entropy(spark, sf):
    return table(spark, sf, "pages").select("page_id", L.base_entropy("url").alias("base"))


@query("page_language_gate")
def page_language_gate(spark, sf):
    """The whole visible text decides; the page's own language comes first."""
    pages = S.visible_text(table(spark, sf, "pages", "page_id").select("page_id", "html"), "html")
    return pages.select(
        "page_id",
        "html_lang",
        L.plausibly_lang("visible", "fr", html_lang=F.col("html_lang")).alias("plausible"),
        L.looks_french("visible").alias("looks_french"),
    )


@query(
    "page_declared_language",
    """SELECT page_id, regexp_extract(html, '<html[^>]* lang="([^"]*)"', 1) AS html_lang,
  CASE WHEN regexp_extract(html, '<html[^>]* lang="([^"]*)"', 1) <> ''
    THEN starts_with(regexp_extract(html, '<html[^>]* lang="([^"]*)"', 1), 'fr') ELSE NULL END AS declared_french
FROM pages""",
)
def page_declared_language(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", S.declared_language("html").alias("html_lang"))
    return pages.withColumn(
        "declared_french", F.when(F.col("html_lang") != "", F.startswith("html_lang", F.lit("fr")))
    )


COLLISIONS = ["avec", "pas", "elle", "une"]
GUARD_D = SMOKE_SQL
_FIRST_HIT = f"""
hits AS (SELECT doc_id, i FROM wds WHERE w IN ({', '.join("'" + c + "'" for c in COLLISIONS)})
  OR (w LIKE '%s' AND substr(w, 1, length(w) - 1) IN ({', '.join("'" + c + "'" for c in COLLISIONS)}) AND w NOT IN (SELECT old FROM d))
  OR (regexp_matches(w, '^\\p{{Lu}}') AND w NOT IN (SELECT old FROM d) AND
    (lower(substr(w, 1, 1)) || substr(w, 2) IN ({', '.join("'" + c + "'" for c in COLLISIONS)})
    OR (w LIKE '%s' AND lower(substr(w, 1, 1)) || substr(w, 2) NOT IN (SELECT old FROM d)
      AND lower(substr(w, 1, 1)) || substr(w, 2, length(w) - 2) IN ({', '.join("'" + c + "'" for c in COLLISIONS)}))))),
firsts AS (SELECT doc_id, min(i) AS p FROM hits GROUP BY 1)"""


_SCORED_SQL = f"""{DIGRAMS_SQL.strip()},
scores AS (SELECT doc_id, sum(n * (coalesce(e2, 30) - coalesce(e1, 30))) AS e FROM dg LEFT JOIN pairs USING (digram) GROUP BY 1),
judged AS (SELECT d.doc_id, d.text, CASE WHEN s.e < 0 THEN 'en' ELSE 'fr' END AS lang FROM documents d LEFT JOIN scores s USING (doc_id)),"""


def _guard_sql(documents: str = "documents", before: str = "") -> str:
    from graphie.plans.respelling import ladder_sql, pieces_sql

    pattern = WORD_SQL.replace("0-9]", "0-9?]")
    return f"""
WITH {before} {GUARD_D}, {pieces_sql(documents, 'doc_id, lang', pattern)}, {ladder_sql('wds', upper=False)}, {_FIRST_HIT},
new AS (SELECT x.doc_id, list(CASE WHEN x.lang = 'en' AND i >= f.p THEN x.w ELSE l.out END ORDER BY i) AS ns,
    count(*) FILTER (l.out <> x.w AND NOT (x.lang = 'en' AND coalesce(i >= f.p, false))) AS n_changed
  FROM wds x JOIN lad l ON l.w = x.w LEFT JOIN firsts f ON f.doc_id = x.doc_id GROUP BY 1)
SELECT s.doc_id, coalesce(n.n_changed, 0) AS n_changed,
  md5(CASE WHEN n.ns IS NULL THEN s.text ELSE
    array_to_string(list_transform(list_zip(s.ss, n.ns), lambda p: p[1] || coalesce(p[2], '')), '') END) AS digest
FROM src s LEFT JOIN new n ON n.doc_id = s.doc_id"""


@query("respell_with_foreign_guard", _guard_sql())
def respell_with_foreign_guard(spark, sf):
    """Browser form. English documents stop being rewritten at the first collision."""
    docs = documents(spark, sf, "doc_id", "text", "lang")
    coll = spark.createDataFrame([(c,) for c in COLLISIONS], "entry string")
    r = R.respell_guarded(
        docs, "text", smoke_dictionary(spark), coll, F.col("lang") == "en", count_col="n_changed"
    )
    return r.select("doc_id", "n_changed", F.md5("text").alias("digest"))


@query("respell_with_foreign_guard_by_join", _guard_sql())
def respell_with_foreign_guard_by_join(spark, sf):
    """The same with the plan for dictionaries over the bound, forced."""
    docs = documents(spark, sf, "doc_id", "text", "lang")
    coll = spark.createDataFrame([(c,) for c in COLLISIONS], "entry string")
    r = R.respell_guarded(
        docs, "text", smoke_dictionary(spark), coll, F.col("lang") == "en", count_col="n_changed", key="doc_id", max_rows=0
    )
    return r.select("doc_id", "n_changed", F.md5("text").alias("digest"))


@query("respell_with_scored_guard", _guard_sql("judged", _SCORED_SQL))
def respell_with_scored_guard(spark, sf):
    """Documents that the digram score takes for English are guarded, whatever their label says."""
    docs = documents(spark, sf, "doc_id", "text")
    scored = L.language_score(docs, "text", corpus_model(spark, sf))
    coll = spark.createDataFrame([(c,) for c in COLLISIONS], "entry string")
    r = R.respell_guarded(scored, "text", smoke_dictionary(spark), coll, F.col("is_foreign"), count_col="n_changed")
    return r.select("doc_id", "n_changed", F.md5("text").alias("digest"))


@query(
    "foreign_spans_by_language",
    f"""WITH {DIGRAMS_SQL}, ll AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
 ld AS (SELECT doc_id, lang, i, unnest(regexp_extract_all(lower(line), '(?s)..')
   || regexp_extract_all(substr(lower(line), 2), '(?s)..')) AS digram FROM ll),
 sc AS (SELECT doc_id, lang, i, sum(coalesce(e2, 30) - coalesce(e1, 30)) AS e FROM ld LEFT JOIN pairs USING (digram) GROUP BY 1, 2, 3)
SELECT l.lang, count(*) AS n_lines, count(*) FILTER (coalesce(round(e, 6), 0) < 0) AS n_foreign
FROM ll l LEFT JOIN sc s ON s.doc_id = l.doc_id AND s.i = l.i GROUP BY 1""",
)
def foreign_spans_by_language(spark, sf):
    docs = documents(spark, sf, "doc_id", "text", "lang")
    lines = docs.select("lang", F.explode(F.split("text", "\n")).alias("line"))
    s = L.language_score(lines, "line", corpus_model(spark, sf))
    return s.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(F.round("englishness", 6) < 0).alias("n_foreign")
    )
