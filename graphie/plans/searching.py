"""Search index and prefix queries over the vocabulary of the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphie.functions import text as T
from graphie.operators import search as S
from graphie.plans.registry import LEXICON_SQL, VOCAB_SQL, lexicon, query, table, vocabulary
from graphie.sources.files import stored

# Every word with é is an entry spelled with and without the accent.
ENTRIES_SQL = f"""{VOCAB_SQL},
entries AS (SELECT word AS id, word AS post90, replace(word, 'é', 'e') AS new FROM vocab),
surf AS (SELECT id, post90 AS s FROM entries UNION SELECT id, new FROM entries),
ix AS (SELECT id AS entry_id, s AS surface, replace(strip_accents(s), 'œ', 'oe') AS key,
  CAST(octet_length(encode(replace(strip_accents(s), 'œ', 'oe'))) AS BIGINT) AS len FROM surf WHERE s <> '')"""


def index(spark, sf):
    e = vocabulary(spark, sf).select(
        F.col("word").alias("id"),
        F.col("word").alias("post90"),
        F.replace("word", F.lit("é"), F.lit("e")).alias("new"),
    )
    return S.build_index(e, F.array("post90", "new"), "id")


@query("search_index", f"WITH {ENTRIES_SQL} SELECT len, key, surface, entry_id FROM ix WHERE surface <> ''")
def search_index(spark, sf):
    ix = index(spark, sf)
    return ix.select(F.col("len").cast("bigint").alias("len"), "key", "surface", "entry_id")


# Queries: the first words of part names and of every turn.
QUERY_SQL = f"""raw AS (SELECT '  ' || upper(split_part(p_name, ' ', 1)) || ' ' AS q FROM part
  UNION SELECT split_part(text, ' ', 1) FROM conversations UNION SELECT substr(text, 1, 2) FROM conversations
  UNION SELECT 'oe' UNION SELECT 'mét' UNION SELECT 'o'),
qs AS (SELECT DISTINCT CASE WHEN t <> '' THEN t END AS query FROM
  (SELECT lower(regexp_replace(q, '^ *(.*?) ?$', '\\1', 's')) AS t FROM raw))"""


def queries_table(spark, sf):
    turns = table(spark, sf, "conversations")
    raw = (
        table(spark, sf, "part")
        .select(F.concat(F.lit("  "), F.upper(F.split("p_name", " ")[0]), F.lit(" ")).alias("q"))
        .union(turns.select(F.split("text", " ")[0]))
        .union(turns.select(F.substr("text", F.lit(1), F.lit(2))))
        .union(spark.range(1).select(F.explode(F.array(F.lit("oe"), F.lit("mét"), F.lit("o")))))
    )
    return raw.select(S.clean_query("q").alias("query")).filter("query is not null").distinct()


@query(
    "search_query_hygiene",
    f"WITH {QUERY_SQL} SELECT query FROM qs WHERE query IS NOT NULL",
)
def search_query_hygiene(spark, sf):
    return queries_table(spark, sf)


def _compat_sql(q: str) -> str:
    """The accepted spellings of a query as a regex, built letter by letter."""
    body = f"regexp_replace({q}, '([^\\p{{L}}\\p{{N}}])', '\\\\\\1', 'g')"
    body = f"replace({body}, 'oe', chr(1))"
    body = f"regexp_replace({body}, 'o$', chr(2))"
    for i, (letter, cls) in enumerate(
        [("a", "[aàâä]"), ("e", "[eéèêë]"), ("i", "[iîï]"), ("u", "[uùûü]"), ("y", "[yÿ]"), ("c", "[cç]"), ("o", "[oôö]")], 4
    ):
        body = f"replace({body}, '{letter}', chr({i + 10}))"
    for i, cls in enumerate(["[aàâä]", "[eéèêë]", "[iîï]", "[uùûü]", "[yÿ]", "[cç]", "[oôö]"], 4):
        body = f"replace({body}, chr({i + 10}), '{cls}')"
    body = f"replace({body}, chr(1), '(?:[oôö][eéèêë]|œ)')"
    return f"'^' || replace({body}, chr(2), '(?:[oôö]|œ)')"


@query(
    "prefix_search",
    f"""WITH {ENTRIES_SQL}, {QUERY_SQL},
pq AS (SELECT query, replace(strip_accents(query), 'œ', 'oe') AS prefix, {_compat_sql('query')} AS re FROM qs WHERE query IS NOT NULL),
lens AS (SELECT DISTINCT length(prefix) AS l FROM pq WHERE length(prefix) > 0),
ixp AS (SELECT ix.*, substr(key, 1, l) AS prefix FROM ix JOIN lens ON length(key) >= l),
hits AS (SELECT query, entry_id, min({{'l': len, 'k': key, 's': surface}}) AS b FROM pq
  JOIN ixp ON ixp.prefix = pq.prefix WHERE regexp_matches(surface, re) GROUP BY 1, 2),
ranked AS (SELECT query, entry_id, b.s AS surface, row_number() OVER (PARTITION BY query ORDER BY b.l, b.k, b.s, entry_id) AS rank FROM hits)
SELECT * FROM ranked WHERE rank <= 10""",
)
def prefix_search(spark, sf):
    return S.search(queries_table(spark, sf), "query", index(spark, sf))


@query(
    "regular_plurals",
    f"""WITH {LEXICON_SQL},
forms AS (SELECT DISTINCT lemme, ortho, replace(phon || '#', 's#', '#') AS phon FROM lexicon),
small AS (SELECT lemme FROM forms GROUP BY 1 HAVING count(*) <= 4),
f AS (SELECT forms.* FROM forms SEMI JOIN small ON small.lemme = forms.lemme),
pairs AS (SELECT a.ortho AS s, b.ortho AS p FROM f a JOIN f b ON a.lemme = b.lemme AND a.phon = b.phon AND b.ortho = a.ortho || 's'),
sides AS (SELECT s AS word, 'S' AS side, p AS other FROM pairs UNION ALL SELECT p, 'P', s FROM pairs),
cnt AS (SELECT word, count(*) AS n FROM sides GROUP BY 1)
SELECT s.word, s.side, s.other FROM sides s JOIN cnt c ON c.word = s.word JOIN cnt o ON o.word = s.other WHERE c.n = 1 AND o.n = 1""",
)
def regular_plurals(spark, sf, v=None):
    v = stored(vocabulary(spark, sf), "vocabulary") if v is None else v  # read three times
    lx = lexicon(spark, sf, v).withColumn(
        "phon", F.replace(F.concat("phon", F.lit("#")), F.lit("s#"), F.lit("#"))
    )
    return S.regular_plurals(lx)


def entries(spark, sf):
    """Search records; the vocabulary they all come from is derived once."""
    v = stored(vocabulary(spark, sf), "vocabulary")
    return S.build_search_entries(combined(spark, sf, v), post90(spark, sf, v), stored(regular_plurals(spark, sf, v), "plurals"))


COMBINED_SQL = f"""{LEXICON_SQL},
combined AS (SELECT word AS old, replace(replace(word, 'eau', 'ô'), 'é', 'e') AS new FROM vocab),
post AS (SELECT word AS old, replace(word, 'ê', 'e') AS new FROM vocab WHERE contains(word, 'ê')),
keyed AS (SELECT coalesce(p.new, c.old) AS post90, c.old, c.new FROM combined c LEFT JOIN post p ON p.old = c.old)"""


def combined(spark, sf, v=None):
    v = vocabulary(spark, sf) if v is None else v
    return v.select(
        F.col("word").alias("old"),
        F.replace(F.replace("word", F.lit("eau"), F.lit("ô")), F.lit("é"), F.lit("e")).alias("new"),
    )


def post90(spark, sf, v=None):
    v = vocabulary(spark, sf) if v is None else v
    return v.filter(F.contains("word", F.lit("ê"))).select(
        F.col("word").alias("old"), F.replace("word", F.lit("ê"), F.lit("e")).alias("new")
    )


@query(
    "inconsistent_entries",
    f"""WITH {COMBINED_SQL} SELECT post90, array_to_string(list_sort(list(DISTINCT new)), ',') AS news
FROM keyed GROUP BY 1 HAVING count(DISTINCT new) > 1""",
)
def inconsistent_entries(spark, sf):
    r = S.inconsistent_entries(combined(spark, sf), post90(spark, sf))
    return r.select("post90", F.array_join("news", ",").alias("news"))


RECORDS_SQL = f"""{COMBINED_SQL},
forms AS (SELECT DISTINCT lemme, ortho, replace(phon || '#', 's#', '#') AS phon FROM lexicon),
small AS (SELECT lemme FROM forms GROUP BY 1 HAVING count(*) <= 4),
f AS (SELECT forms.* FROM forms SEMI JOIN small ON small.lemme = forms.lemme),
pairs AS (SELECT a.ortho AS s, b.ortho AS p FROM f a JOIN f b ON a.lemme = b.lemme AND a.phon = b.phon AND b.ortho = a.ortho || 's'),
sides AS (SELECT s AS word, 'S' AS side, p AS other FROM pairs UNION ALL SELECT p, 'P', s FROM pairs),
cnt AS (SELECT word, count(*) AS n FROM sides GROUP BY 1),
rp AS (SELECT s.word, s.side, s.other FROM sides s JOIN cnt c ON c.word = s.word JOIN cnt o ON o.word = s.other WHERE c.n = 1 AND o.n = 1),
g AS (SELECT post90, new, list_sort(list(DISTINCT old) FILTER (old <> post90)) AS olds FROM keyed GROUP BY 1, 2),
g1 AS (SELECT g.*, count(*) OVER (PARTITION BY post90) AS n FROM g),
j AS (SELECT a.post90, a.new, coalesce(a.olds, []) AS olds, rp.side,
  a.n = 1 AND b.n = 1 AND CASE rp.side
    WHEN 'S' THEN a.new || 's' = b.new AND list_transform(coalesce(a.olds, []), lambda x: x || 's') = coalesce(b.olds, [])
    WHEN 'P' THEN b.new || 's' = a.new AND list_transform(coalesce(b.olds, []), lambda x: x || 's') = coalesce(a.olds, []) END AS agrees
  FROM g1 a LEFT JOIN rp ON rp.word = a.post90 LEFT JOIN g1 b ON b.post90 = rp.other AND b.n = 1),
records AS (SELECT olds, post90, new, coalesce(agrees AND side = 'S', false) AS implied_plural FROM j WHERE NOT coalesce(agrees AND side = 'P', false))"""


@query("search_entries", f"WITH {RECORDS_SQL} SELECT array_to_string(olds, '|') AS olds, post90, new, implied_plural FROM records")
def search_entries(spark, sf):
    return entries(spark, sf).select(F.array_join("old", "|").alias("olds"), "post90", "new", "implied_plural")


@query(
    "consistent_spellings",
    f"WITH {COMBINED_SQL}, k AS (SELECT post90, replace(post90, 'ê', 'e') AS new FROM keyed) SELECT post90, min(new) AS new FROM k GROUP BY 1",
)
def consistent_spellings(spark, sf):
    """A build that may go on: each official spelling has one new one."""
    p = post90(spark, sf)
    same = combined(spark, sf).join(p.select("old", F.col("new").alias("_p")), "old", "left")
    return S.consistent(same.select("old", F.replace(F.coalesce("_p", "old"), F.lit("ê"), F.lit("e")).alias("new")), p)


@query(
    "search_display",
    f"""WITH {COMBINED_SQL},
g AS (SELECT post90, new, coalesce(list_sort(list(DISTINCT old) FILTER (old <> post90)), []) AS olds FROM keyed GROUP BY 1, 2),
h AS (SELECT *, CASE WHEN post90 LIKE '%e' THEN '(s)' ELSE '' END AS s FROM g)
SELECT CASE WHEN len(olds) = 0 THEN post90 || s ELSE array_to_string(list_transform(olds, lambda a: a || s), '<br>') END AS other,
  CASE WHEN len(olds) = 0 THEN '-' ELSE post90 || s END AS post90_display,
  CASE WHEN new = post90 THEN '-' ELSE new || s END AS new_display FROM h""",
)
def search_display(spark, sf):
    none = regular_plurals(spark, sf).limit(0)
    e = S.build_search_entries(combined(spark, sf), post90(spark, sf), none)
    plural = F.endswith("post90", F.lit("e"))
    return e.select(*S.display_columns(F.col("old"), F.col("post90"), F.col("new"), plural))


@query(
    "search_by_dictionary_entry",
    f"""WITH {RECORDS_SQL}, {QUERY_SQL},
e AS (SELECT *, post90 || '/' || new AS id FROM records),
base AS (SELECT id, implied_plural, unnest(list_concat(olds, [post90, new])) AS s FROM e),
surf AS (SELECT DISTINCT id, s FROM (SELECT id, s FROM base UNION ALL SELECT id, s || 's' FROM base WHERE implied_plural)),
ix AS (SELECT id AS entry_id, s AS surface, replace(strip_accents(s), 'œ', 'oe') AS key, octet_length(encode(replace(strip_accents(s), 'œ', 'oe'))) AS len FROM surf WHERE s <> ''),
pq AS (SELECT query, replace(strip_accents(query), 'œ', 'oe') AS prefix, {_compat_sql('query')} AS re FROM qs WHERE query IS NOT NULL),
lens AS (SELECT DISTINCT length(prefix) AS l FROM pq WHERE length(prefix) > 0),
ixp AS (SELECT ix.*, substr(key, 1, l) AS prefix FROM ix JOIN lens ON length(key) >= l),
hits AS (SELECT query, entry_id, min({{'l': len, 'k': key, 's': surface}}) AS b FROM pq JOIN ixp ON ixp.prefix = pq.prefix WHERE regexp_matches(surface, re) GROUP BY 1, 2),
ranked AS (SELECT query, entry_id, b.s AS surface, row_number() OVER (PARTITION BY query ORDER BY b.l, b.k, b.s, entry_id) AS rank FROM hits),
shown AS (SELECT id, olds, post90, new, CASE WHEN implied_plural THEN '(s)' ELSE '' END AS s FROM e)
SELECT query, rank, surface, CASE WHEN len(olds) = 0 THEN post90 || s ELSE array_to_string(list_transform(olds, lambda a: a || s), '<br>') END AS other,
  CASE WHEN len(olds) = 0 THEN '-' ELSE post90 || s END AS post90_display, CASE WHEN new = post90 THEN '-' ELSE new || s END AS new_display
FROM ranked JOIN shown ON id = entry_id WHERE rank <= 10""",
)
def search_by_dictionary_entry(spark, sf):
    """The full chain: records, their spellings, queries, display."""
    e = stored(entries(spark, sf).withColumn("id", F.concat_ws("/", "post90", "new")), "records")
    surfaces = S.search_surfaces(F.col("old"), F.col("post90"), F.col("new"), F.col("implied_plural"))
    found = S.search(queries_table(spark, sf), "query", S.build_index(e, surfaces, "id"))
    shown = e.select("id", *S.display_columns(F.col("old"), F.col("post90"), F.col("new"), F.col("implied_plural")))
    return found.join(shown, found["entry_id"] == shown["id"]).drop("id", "entry_id")
