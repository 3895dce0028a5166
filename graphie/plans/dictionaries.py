"""Dictionary algebra over dictionaries derived from the vocabulary."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphie.operators import dictionary as D
from graphie.operators import lexicon as X
from graphie.operators import rulesets as RS
from graphie.operators.dictionary import Dictionary, Metadata
from graphie.plans.registry import (
    DICTS_SQL, LEXICON_SQL, VOCAB_SQL, dict_eau, dict_que, documents, lexicon, query, table, values_sql, vocabulary,
)


@query(
    "merge_dictionaries",
    f"WITH {DICTS_SQL} SELECT coalesce(d1.old, d2.old) AS old, coalesce(d2.new, d1.new) AS new FROM d1 FULL JOIN d2 ON d1.old = d2.old",
)
def merge_dictionaries(spark, sf):
    left = Dictionary(dict_eau(spark, sf), Metadata(desc="eau", lang="fr"))
    right = Dictionary(dict_que(spark, sf), Metadata(desc="que"))
    return D.merge_dictionaries(left, right).df


STOPS = ["pierre", "eau", "beau", "vienne", "Pierre"]


@query(
    "stop_entries",
    f"""WITH {DICTS_SQL}, {values_sql('s', 'old', [(x,) for x in STOPS])}
SELECT old, new FROM d1 WHERE old NOT IN (SELECT old FROM s) UNION ALL SELECT old, '' FROM s""",
)
def stop_entries(spark, sf):
    return D.with_stop_entries(Dictionary(dict_eau(spark, sf)), STOPS).df


_KEYED_SQL = f"""{VOCAB_SQL}, k AS (SELECT substr(word, 1, 3) AS old, {{'rank': n, 'new': word}} AS o FROM vocab)"""


@query("first_definition_wins", f"WITH {_KEYED_SQL} SELECT old, min(o).new AS new, min(o).rank AS rank FROM k GROUP BY old")
def first_definition_wins(spark, sf):
    return D.first_wins(_ranked_keys(spark, sf), "old", "o", "new").select("old", "new", F.col("o.rank").alias("rank"))


@query("last_definition_wins", f"WITH {_KEYED_SQL} SELECT old, max(o).new AS new, max(o).rank AS rank FROM k GROUP BY old")
def last_definition_wins(spark, sf):
    return D.last_wins(_ranked_keys(spark, sf), "old", "o", "new").select("old", "new", F.col("o.rank").alias("rank"))


def _ranked_keys(spark, sf):
    """All words as definitions of their first three letters; many share a rank, and the word settles it."""
    key = F.substr("word", F.lit(1), F.lit(3)).alias("old")
    return vocabulary(spark, sf).select(key, F.col("word").alias("new"), F.struct(F.col("n").alias("rank"), F.col("word").alias("new")).alias("o"))


def simplify_sql(src: str, marker: str) -> str:
    n = len(marker)
    chop = f"substr(t.new, 1, length(t.new) - {n})"
    ends = f"ends_with(t.new, '{marker}')" if marker else "true"
    return f"""
chain AS (SELECT old, new, regexp_replace(old, 's+$', '') AS stem, length(old) - length(regexp_replace(old, 's+$', '')) AS k FROM {src}),
heads AS (SELECT t.old, t.new, t.stem, t.k, t.old <> t.new AS keep FROM chain t
  LEFT JOIN chain p ON p.stem = t.stem AND p.k = t.k - 1 WHERE p.old IS NULL),
walk AS (SELECT * FROM heads UNION ALL
  SELECT t.old, t.new, t.stem, t.k, CASE WHEN NOT {ends} THEN t.old <> t.new
    WHEN w.new = {chop} THEN NOT w.keep AND t.old <> t.new ELSE true END
  FROM walk w JOIN chain t ON t.stem = w.stem AND t.k = w.k + 1)"""


PLURAL_SQL = f"""{VOCAB_SQL},
base AS (SELECT word, replace(word, 'eau', 'ô') AS new FROM vocab WHERE NOT word LIKE '%s' AND length(word) > 1),
full_d AS (SELECT word AS old, new FROM base UNION ALL SELECT word || 's', CASE WHEN word LIKE 'a%' THEN word || 's' ELSE new || 's' END FROM base
  UNION ALL SELECT word || 'ss', new || 's' FROM base WHERE word LIKE '%e')"""


def plural_dictionary(spark, sf):
    """Words, their plurals (some irregular), and a few with a double s."""
    v = vocabulary(spark, sf).filter(~F.endswith("word", F.lit("s")) & (F.length("word") > 1))
    base = v.select("word", F.replace("word", F.lit("eau"), F.lit("ô")).alias("new"))
    s = F.lit("s")
    plural = F.when(F.startswith("word", F.lit("a")), F.concat("word", s)).otherwise(F.concat("new", s))
    forms = F.array(
        F.struct(F.col("word").alias("old"), F.col("new").alias("new")),
        F.struct(F.concat("word", s).alias("old"), plural.alias("new")),
    )
    double = F.array(F.struct(F.concat("word", F.lit("ss")).alias("old"), F.concat("new", s).alias("new")))
    every = F.when(F.endswith("word", F.lit("e")), F.concat(forms, double)).otherwise(forms)
    return base.select(F.explode(every).alias("x")).select("x.old", "x.new")


@query(
    "compress_plurals",
    f"WITH RECURSIVE {PLURAL_SQL}, {simplify_sql('full_d', 's')} SELECT old, CASE WHEN old = new THEN '' ELSE new END AS new FROM walk WHERE keep",
)
def compress_plurals(spark, sf):
    return D.simplify_mapping(plural_dictionary(spark, sf), "s")


@query(
    "compress_plurals_unmarked",
    f"WITH RECURSIVE {PLURAL_SQL}, {simplify_sql('full_d', '')} SELECT old, CASE WHEN old = new THEN '' ELSE new END AS new FROM walk WHERE keep",
)
def compress_plurals_unmarked(spark, sf):
    return D.simplify_mapping(plural_dictionary(spark, sf), "")


@query("compress_identities_only", f"WITH {PLURAL_SQL} SELECT old, new FROM full_d WHERE old <> new")
def compress_identities_only(spark, sf):
    return D.simplify_mapping(plural_dictionary(spark, sf), None)


@query(
    "dictionary_diff",
    f"""WITH {DICTS_SQL} SELECT coalesce(a.old, b.old) AS old, a.new AS before, b.new AS after,
  CASE WHEN a.old IS NULL THEN 'added' WHEN b.old IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM d1 a FULL JOIN d2 b ON a.old = b.old WHERE a.new IS DISTINCT FROM b.new""",
)
def dictionary_diff(spark, sf):
    return D.diff_dictionaries(dict_eau(spark, sf), dict_que(spark, sf))


@query(
    "disagreement_report",
    f"WITH {DICTS_SQL} SELECT d2.old, d2.new AS reference, d1.new AS generated FROM d2 JOIN d1 ON d1.old = d2.old WHERE d1.new <> d2.new",
)
def disagreement_report(spark, sf):
    return D.disagreements(dict_eau(spark, sf), dict_que(spark, sf))


@query(
    "chained_entries",
    f"""WITH {VOCAB_SQL}, c AS (SELECT word AS old, replace(word, 'é', 'e') AS new FROM vocab WHERE contains(word, 'é')
  UNION ALL SELECT word, word || 's' FROM vocab WHERE NOT contains(word, 'é'))
SELECT a.old, a.new, b.new AS then FROM c a JOIN c b ON b.old = a.new WHERE a.old <> a.new AND b.old <> b.new""",
)
def chained_entries(spark, sf):
    v = vocabulary(spark, sf)
    has = F.contains("word", F.lit("é"))
    new = F.when(has, F.replace("word", F.lit("é"), F.lit("e"))).otherwise(F.concat("word", F.lit("s")))
    return D.chained_entries(v.select(F.col("word").alias("old"), new.alias("new")))


@query(
    "collision_words",
    f"""WITH {DICTS_SQL}, d AS (SELECT * FROM d1 UNION ALL SELECT word, word || 'x' FROM vocab WHERE NOT contains(word, 'eau')),
en AS (SELECT DISTINCT lower(w) AS word FROM tok WHERE lang = 'en'),
e AS (SELECT old AS entry, old AS implied FROM d UNION SELECT old, old || 's' FROM d)
SELECT DISTINCT entry FROM e JOIN en ON en.word = e.implied AND en.word <> 'comme'""",
)
def collision_words(spark, sf):
    d = dict_eau(spark, sf).unionByName(
        vocabulary(spark, sf)
        .filter(~F.contains("word", F.lit("eau")))
        .select(F.col("word").alias("old"), F.concat("word", F.lit("x")).alias("new"))
    )
    docs = documents(spark, sf, "doc_id", "text", "lang").filter("lang = 'en'")
    from graphie.functions import text as T

    en = docs.select(F.explode(T.words("text")).alias("w")).select(F.lower("w").alias("word"))
    return D.collision_words(d, en, ignore=["comme"])


PATTERNS = [
    ("old", "beau"), ("old", "eau%"), ("old", "%reau%"), ("old", "ÉEAU"), ("old", "QUE%"), ("new", "%ôx"), ("new", "ô"),
]


@query(
    "exclusion_list",
    f"""WITH {DICTS_SQL}, {values_sql('p', 'field, pattern', PATTERNS)}
SELECT old, new FROM d1 WHERE old <> '' AND NOT EXISTS (SELECT 1 FROM p WHERE
  translate(CASE field WHEN 'old' THEN d1.old ELSE d1.new END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
  LIKE translate(pattern, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))""",
)
def exclusion_list(spark, sf):
    return D.exclude(dict_eau(spark, sf), spark.createDataFrame(PATTERNS, "field string, pattern string"))


@query(
    "clean_dictionary_fields",
    f"""WITH {DICTS_SQL}, r AS (SELECT '"' || old || '" (nom)' AS old, new || ' (x) (y)' AS new FROM d1 UNION ALL SELECT old, new FROM d1)
SELECT DISTINCT regexp_replace(replace(old, '"', ''), ' *\\([^)]*\\)', '', 'g') AS old,
  regexp_replace(replace(new, '"', ''), ' *\\([^)]*\\)', '', 'g') AS new FROM r""",
)
def clean_dictionary_fields(spark, sf):
    d = dict_eau(spark, sf)
    noisy = d.select(
        F.concat(F.lit('"'), "old", F.lit('" (nom)')).alias("old"), F.concat("new", F.lit(" (x) (y)")).alias("new")
    )
    return D.clean_fields(noisy.unionByName(d))


@query(
    "ligature_entries",
    f"""WITH {VOCAB_SQL}, d AS (SELECT replace(replace(word, 'oi', 'œ'), 'ai', 'æ') AS old, replace(word, 'oi', 'oe') AS new FROM vocab)
SELECT old, new FROM d UNION ALL SELECT r, new FROM (SELECT old, new, replace(replace(old, 'œ', 'oe'), 'æ', 'ae') AS r FROM d)
WHERE r <> old AND r <> new""",
)
def ligature_entries(spark, sf):
    v = vocabulary(spark, sf)
    old = F.replace(F.replace("word", F.lit("oi"), F.lit("œ")), F.lit("ai"), F.lit("æ"))
    return D.expand_ligatures(v.select(old.alias("old"), F.replace("word", F.lit("oi"), F.lit("oe")).alias("new")))


RANKED_SQL = f"""{LEXICON_SQL},
base AS (SELECT ortho AS old, replace(ortho, 'eau', 'ô') AS new, CASE WHEN length(ortho) % 3 = 0 THEN -1 ELSE rank END AS rank
  FROM lexicon WHERE NOT contains(ortho, 'ê')),
post AS (SELECT ortho AS old, replace(ortho, 'ê', 'e') AS new FROM lexicon WHERE contains(ortho, 'ê') OR contains(ortho, 'aux')
  UNION ALL SELECT 'charriot' || ortho, 'charr' || ortho FROM lexicon WHERE length(ortho) = 4)"""


def ranked(spark, sf):
    """``ortho, n, rank``: words from the most frequent on."""
    v = vocabulary(spark, sf).withColumnRenamed("word", "ortho")
    return X.numbered(v, [F.col("n").desc(), F.col("ortho")]).select("ortho", "rank")


@query(
    "add_official_spellings",
    f"""WITH {RANKED_SQL} SELECT old, new, rank FROM base UNION ALL
SELECT p.old, coalesce(b.new, p.new), CASE WHEN b.rank >= 0 THEN b.rank ELSE 100000000 END FROM post p
LEFT JOIN base b ON b.old = p.new WHERE p.old NOT IN (SELECT old FROM base)
AND NOT (b.new IS NULL AND regexp_matches(p.new, '^(?:charr|combatt|hindou)|^reboursouffler$'))""",
)
def add_official_spellings(spark, sf):
    lx = ranked(spark, sf)
    base = lx.filter(~F.contains("ortho", F.lit("ê"))).select(
        F.col("ortho").alias("old"),
        F.replace("ortho", F.lit("eau"), F.lit("ô")).alias("new"),
        F.when(F.length("ortho") % 3 == 0, F.lit(-1)).otherwise(F.col("rank")).alias("rank"),
    )
    post = lx.filter(F.contains("ortho", F.lit("ê")) | F.contains("ortho", F.lit("aux"))).select(
        F.col("ortho").alias("old"), F.replace("ortho", F.lit("ê"), F.lit("e")).alias("new")
    )
    odd = lx.filter(F.length("ortho") == 4).select(
        F.concat(F.lit("charriot"), "ortho").alias("old"), F.concat(F.lit("charr"), "ortho").alias("new")
    )
    return X.add_post90_entries(base, post.unionByName(odd), flagship=True)


SPECS = [("a", "eaux/ôs eau/ô é/E x /y q/ a/b/c"), ("b", "que/qe  ou/u "), ("c", "nothing /x")]


@query(
    "parse_custom_rules",
    f"""WITH {values_sql('specs', 'ruleset, spec', SPECS)},
w AS (SELECT ruleset, unnest(string_split(spec, ' ')) AS p, generate_subscripts(string_split(spec, ' '), 1) AS i FROM specs),
r AS (SELECT ruleset, i, substr(p, 1, instr(p, '/') - 1) AS target, substr(p, instr(p, '/') + 1) AS repl FROM w WHERE contains(p, '/')),
k AS (SELECT *, row_number() OVER (PARTITION BY ruleset ORDER BY i) AS step FROM r WHERE target <> ''),
hits AS (SELECT k.ruleset, k.step, count(d.doc_id) AS n_docs FROM k LEFT JOIN documents d ON contains(d.text, k.target) GROUP BY 1, 2)
SELECT k.ruleset, k.step, target, repl,
  CASE WHEN length(repl) - length(replace(repl, 'E', '')) = 1 THEN 'accent' ELSE 'text' END AS kind, n_docs
FROM k JOIN hits h ON h.ruleset = k.ruleset AND h.step = k.step""",
)
def parse_custom_rules(spark, sf):
    """Rules written as text, with the number of documents each can touch."""
    specs = spark.createDataFrame(SPECS, "ruleset string, spec string")
    rules = RS.parse_custom_rules(specs, "ruleset", "spec")
    targets = [r.target for r in rules.select("target").distinct().collect()]
    docs = documents(spark, sf, "doc_id", "text")
    counts = docs.agg(*[F.count_if(F.contains("text", F.lit(t))).alias(f"c{i}") for i, t in enumerate(targets)])
    pairs = F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"c{i}").alias("n_docs")) for i, t in enumerate(targets)])
    per = counts.select(F.explode(pairs).alias("x")).select("x.*")
    return rules.join(per, "target").select(
        "ruleset", F.col("step").cast("bigint").alias("step"), "target", "repl", "kind", "n_docs"
    )


@query(
    "apply_plain_rules",
    f"""WITH {VOCAB_SQL} SELECT word AS old, replace(replace(replace(word, 'eaux', 'ôs'), 'eau', 'ô'), 'que', 'qe') AS new
FROM vocab WHERE regexp_matches(word, 'eaux|eau|que')""",
)
def apply_plain_rules(spark, sf):
    v = vocabulary(spark, sf).select(F.col("word").alias("old"))
    return RS.apply_plain_rules(v, "old", [("eaux", "ôs"), ("eau", "ô"), ("que", "qe")])


@query(
    "interpret_rulesets",
    """WITH n(name, pos) AS (VALUES ('qu/q', 0), ('ti/ci', 1), ('alfonic', 2)), p AS (SELECT DISTINCT split_part(url, '/', 3) AS ruleset FROM pages)
SELECT ruleset, array_to_string(list_sort(list(name)), ' ') AS "desc", 'fr' AS lang, bool_and(name <> 'alfonic') AS supports_repeated_rewrites,
  CASE WHEN NOT bool_or(name = 'alfonic') THEN 's' END AS marker, bool_or(name = 'oe') AS oe, bool_or(name = '1990') AS rect1990
FROM p JOIN n ON (length(ruleset) + pos) % 2 = 0 GROUP BY 1""",
)
def interpret_rulesets(spark, sf):
    """Rule sets named after page hosts, with their combined properties."""
    pages = table(spark, sf, "pages").select(F.element_at(F.split("url", "/"), 3).alias("ruleset")).distinct()
    names = spark.createDataFrame([("qu/q", 0), ("ti/ci", 1), ("alfonic", 2)], "name string, pos int")
    even = pages.join(names, (F.length("ruleset") + F.col("pos")) % 2 == 0)
    return RS.interpret_rules(even)


@query(
    "words_per_lemma",
    f"WITH {LEXICON_SQL} SELECT lemme, array_to_string(list_sort(list(DISTINCT ortho)), ',') AS words FROM lexicon GROUP BY 1",
)
def words_per_lemma(spark, sf):
    return X.multimap(lexicon(spark, sf), "lemme", "ortho").select("lemme", F.array_join("values", ",").alias("words"))


@query(
    "multi_valued_entries",
    f"""WITH {DICTS_SQL}, u AS (SELECT * FROM d1 UNION ALL SELECT * FROM d2)
SELECT old, array_to_string(list_sort(list(DISTINCT new)), ',') AS news, count(DISTINCT new) AS n FROM u GROUP BY 1 HAVING count(DISTINCT new) > 1""",
)
def multi_valued_entries(spark, sf):
    m = X.multi_valued(dict_eau(spark, sf).unionByName(dict_que(spark, sf)))
    return m.withColumn("n", F.col("n").cast("bigint"))


@query(
    "lookup_function",
    f"""WITH {DICTS_SQL}, t AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS w FROM part UNION ALL SELECT -1, word FROM vocab)
SELECT w AS word, p_partkey, d1.new, d2.new AS entry FROM t LEFT JOIN d1 ON d1.old = w LEFT JOIN d2 ON d2.old = w""",
)
def lookup_function(spark, sf):
    """Dictionaries called from SQL, as a function and as a table function."""
    D.register_lookup(spark, "eau_spelling", dict_eau(spark, sf))
    D.register_lookup(spark, "que_spelling", dict_que(spark, sf))
    parts = table(spark, sf, "part").select("p_partkey", F.substring_index("p_name", " ", 1).alias("word"))
    vocabulary(spark, sf).select(F.lit(-1).cast("bigint").alias("p_partkey"), "word").unionByName(
        parts.select(F.col("p_partkey").cast("bigint").alias("p_partkey"), "word")
    ).createOrReplaceTempView("spelling_words")
    return spark.sql(
        "SELECT word, p_partkey, eau_spelling(word) AS new, e.new AS entry FROM spelling_words LEFT JOIN LATERAL que_spelling_entries(word) e"
    )


_NAMES = [("accent-plat", 0), ("ti/ci", 1), ("qu/q", 2), ("que/c", 3), ("emment/ament", 4), ("alfonic", 5), ("ou/omega", 6)]


@query(
    "ordered_rules",
    f"""WITH {values_sql('n', 'name, pos', _NAMES)}, {values_sql('k', 'name, r', list(RS.RANKS.items()))},
p AS (SELECT split_part(url, '/', 3) AS ruleset, max(length(url)) AS w FROM pages GROUP BY 1)
SELECT ruleset, n.name, row_number() OVER (PARTITION BY ruleset ORDER BY coalesce(k.r, 0), pos) AS step
FROM p JOIN n ON (w + pos) % 3 <> 0 LEFT JOIN k ON k.name = n.name""",
)
def ordered_rules(spark, sf):
    """Rule sets named after page hosts, in the order their rules run."""
    pages = table(spark, sf, "pages").groupBy(F.element_at(F.split("url", "/"), 3).alias("ruleset")).agg(F.max(F.length("url")).alias("w"))
    names = spark.createDataFrame(_NAMES, "name string, pos int")
    some = F.filter(F.lit([p for _, p in _NAMES]), lambda p: (F.col("w") + p) % 3 != 0)
    rows = pages.select("ruleset", F.explode(some).alias("pos")).join(names, "pos")
    return RS.order_rules(rows).select("ruleset", "name", F.col("step").cast("bigint").alias("step"))
