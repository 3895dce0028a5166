"""Lexicon ETL on a pseudo lexicon: the vocabulary with derived sounds and lemmas."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphie.operators import lexicon as X
from graphie.plans.registry import (
    LEXICON_SQL, VOCAB_SQL, documents, lexicon, query, table, vocabulary,
)
from graphie.sources.files import stored

# Locutions made from neighbouring words: "à la X", "à l'X", "à X".
LOCUTION_SQL = f"""{LEXICON_SQL},
loc AS (SELECT CASE length(ortho) % 4 WHEN 0 THEN 'à la ' WHEN 1 THEN 'à l''' WHEN 2 THEN 'À ' ELSE '' END || ortho AS ortho,
  CASE length(ortho) % 4 WHEN 0 THEN 'ala' WHEN 1 THEN 'al' WHEN 2 THEN 'a' ELSE '' END || phon AS phon,
  CASE length(ortho) % 4 WHEN 0 THEN 'à la ' WHEN 1 THEN 'à l''' WHEN 2 THEN 'À ' ELSE '' END || lemme AS lemme FROM lexicon),
s1 AS (SELECT ortho LIKE 'à la %' AND phon LIKE 'ala%' AS h, * FROM loc),
t1 AS (SELECT CASE WHEN h THEN substr(ortho, 6) ELSE ortho END AS ortho, CASE WHEN h THEN substr(phon, 4) ELSE phon END AS phon,
  CASE WHEN h THEN substr(lemme, 6) ELSE lemme END AS lemme FROM s1),
s2 AS (SELECT ortho LIKE 'à l''%' AND phon LIKE 'al%' AS h, * FROM t1),
t2 AS (SELECT CASE WHEN h THEN substr(ortho, 5) ELSE ortho END AS ortho, CASE WHEN h THEN substr(phon, 3) ELSE phon END AS phon,
  CASE WHEN h THEN substr(lemme, 5) ELSE lemme END AS lemme FROM s2),
s3 AS (SELECT ortho LIKE 'à %' AND phon LIKE 'a%' AS h, * FROM t2)"""


@query(
    "strip_locutions",
    f"""WITH {LOCUTION_SQL} SELECT CASE WHEN h THEN substr(ortho, 3) ELSE ortho END AS ortho,
  CASE WHEN h THEN substr(phon, 2) ELSE phon END AS phon, CASE WHEN h THEN substr(lemme, 3) ELSE lemme END AS lemme FROM s3""",
)
def strip_locutions(spark, sf):
    lx = lexicon(spark, sf)
    k = F.length("ortho") % 4
    p = F.when(k == 0, "à la ").when(k == 1, "à l'").when(k == 2, "À ").otherwise("")
    q = F.when(k == 0, "ala").when(k == 1, "al").when(k == 2, "a").otherwise("")
    return X.strip_locutions(
        lx.select(F.concat(p, "ortho").alias("ortho"), F.concat(q, "phon").alias("phon"), F.concat(p, "lemme").alias("lemme"))
    )


EXTRAS_SQL = f"""{LEXICON_SQL},
extras AS (SELECT ortho, phon || '!' AS phon, '' AS lemme FROM lexicon WHERE length(ortho) = 3
  UNION ALL SELECT ortho || 'zz', phon || 'z', CASE WHEN length(ortho) = 5 THEN '' ELSE lemme END FROM lexicon WHERE length(ortho) IN (4, 5)
  UNION ALL SELECT '# ' || ortho, '', '' FROM lexicon WHERE length(ortho) = 2)"""


def extras(spark, sf, v=None):
    lx = lexicon(spark, sf, v)
    n = F.length("ortho")
    a = lx.filter(n == 3).select("ortho", F.concat("phon", F.lit("!")).alias("phon"), F.lit("").alias("lemme"))
    b = lx.filter(n.isin(4, 5)).select(
        F.concat("ortho", F.lit("zz")).alias("ortho"),
        F.concat("phon", F.lit("z")).alias("phon"),
        F.when(n == 5, "").otherwise(F.col("lemme")).alias("lemme"),
    )
    c = lx.filter(n == 2).select(F.concat(F.lit("# "), "ortho").alias("ortho"), F.lit("").alias("phon"), F.lit("").alias("lemme"))
    return a.unionByName(b).unionByName(c)


@query(
    "override_pronunciations",
    f"""WITH {EXTRAS_SQL} SELECT l.ortho, coalesce(e.phon, l.phon) AS phon, l.lemme, l.freq FROM lexicon l LEFT JOIN extras e ON e.ortho = l.ortho""",
)
def override_pronunciations(spark, sf):
    v = stored(vocabulary(spark, sf), "vocabulary")
    return X.override_from(lexicon(spark, sf, v), extras(spark, sf, v), "ortho", "phon")


@query(
    "insert_missing_words",
    f"""WITH {EXTRAS_SQL} SELECT ortho, phon, lemme, freq FROM lexicon UNION ALL
SELECT ortho, phon, coalesce(nullif(lemme, ''), ortho), NULL FROM extras WHERE ortho NOT LIKE '#%' AND ortho NOT IN (SELECT ortho FROM lexicon)""",
)
def insert_missing_words(spark, sf):
    v = stored(vocabulary(spark, sf), "vocabulary")
    return X.insert_if_absent(lexicon(spark, sf, v), extras(spark, sf, v))


@query(
    "insert_missing_words_with_constants",
    f"""WITH {EXTRAS_SQL} SELECT ortho, phon, lemme, freq, NULL AS genre FROM lexicon UNION ALL
SELECT ortho, phon, coalesce(nullif(lemme, ''), ortho), 0, 'f' FROM extras WHERE ortho NOT LIKE '#%' AND ortho NOT IN (SELECT ortho FROM lexicon)""",
)
def insert_missing_words_with_constants(spark, sf):
    v = stored(vocabulary(spark, sf), "vocabulary")
    lx = lexicon(spark, sf, v).withColumn("genre", F.lit(None).cast("string"))
    return X.insert_if_absent(lx, extras(spark, sf, v), freq=0, genre="f").withColumn("freq", F.col("freq").cast("bigint"))


FLAGS_SQL = f"""{LEXICON_SQL},
flags AS (SELECT ortho AS word, CASE WHEN length(ortho) % 2 = 0 THEN 'true' ELSE 'false' END AS h_aspire FROM lexicon WHERE contains(ortho, 'e')),
variants AS (SELECT ortho AS old, replace(ortho, 'é', 'e') AS new FROM lexicon WHERE contains(ortho, 'é') OR contains(ortho, 'h'))"""


def flags(spark, sf):
    lx = lexicon(spark, sf).filter(F.contains("ortho", F.lit("e")))
    return lx.select(F.col("ortho").alias("word"), F.when(F.length("ortho") % 2 == 0, "true").otherwise("false").alias("h_aspire"))


def variants(spark, sf):
    lx = lexicon(spark, sf).filter(F.contains("ortho", F.lit("é")) | F.contains("ortho", F.lit("h")))
    return lx.select(F.col("ortho").alias("old"), F.replace("ortho", F.lit("é"), F.lit("e")).alias("new"))


@query(
    "propagate_flags",
    f"""WITH {FLAGS_SQL} SELECT word, h_aspire FROM flags UNION ALL
SELECT v.old, f.h_aspire FROM flags f JOIN variants v ON v.new = f.word WHERE v.old NOT IN (SELECT word FROM flags)""",
)
def propagate_flags(spark, sf):
    return X.propagate_flag(flags(spark, sf), variants(spark, sf), "word", "h_aspire", "old", "new")


def _starts(col: str, prefixes: list[str]) -> str:
    return "(" + " OR ".join(f"starts_with({col}, '{p}')" for p in prefixes) + ")"


@query(
    "classify_initial_h",
    f"""WITH {FLAGS_SQL}, l AS (SELECT CASE WHEN length(ortho) % 3 = 0 THEN 'h' || ortho WHEN length(ortho) % 3 = 1 THEN 'ha' || ortho ELSE ortho END AS ortho,
  phon, lemme, freq FROM lexicon)
SELECT l.ortho, l.phon, l.lemme, l.freq, CASE WHEN NOT starts_with(ortho, 'h') THEN 'f' WHEN {_starts('ortho', X.H_BLOCKS)} THEN 't'
  WHEN {_starts('ortho', X.H_MUTE)} OR ortho = 'hérédo' THEN 'f' WHEN coalesce(b.h_aspire, a.h_aspire, 'true') = 'true' THEN 't' ELSE 'f' END AS h_aspire
FROM l LEFT JOIN flags a ON a.word = l.ortho LEFT JOIN flags b ON b.word = l.lemme""",
)
def classify_initial_h(spark, sf):
    n = F.length("ortho") % 3
    h = F.when(n == 0, F.concat(F.lit("h"), "ortho")).when(n == 1, F.concat(F.lit("ha"), "ortho")).otherwise(F.col("ortho"))
    return X.classify_h(lexicon(spark, sf).withColumn("ortho", h), flags(spark, sf))


@query(
    "usable_rows",
    f"""WITH {LEXICON_SQL}, l AS (SELECT CASE WHEN freq = 1 AND length(ortho) = 6 THEN ortho || '. x' ELSE ortho END AS ortho, phon, lemme, freq FROM lexicon)
SELECT * FROM l WHERE NOT regexp_matches(ortho, '[ .ñã]')""",
)
def usable_rows(spark, sf):
    odd = (F.col("freq") == 1) & (F.length("ortho") == 6)
    lx = lexicon(spark, sf).withColumn("ortho", F.when(odd, F.concat("ortho", F.lit(". x"))).otherwise(F.col("ortho")))
    return X.usable_rows(lx)


@query(
    "words_by_frequency",
    f"WITH {LEXICON_SQL} SELECT ortho, freq FROM lexicon ORDER BY CAST(freq AS DOUBLE) DESC, ortho",
)
def words_by_frequency(spark, sf):
    lx = lexicon(spark, sf).select("ortho", F.col("freq").cast("string").alias("f"), "freq")
    return X.by_frequency(lx, "f").drop("f")


SPELLINGS_SQL = f"""{VOCAB_SQL},
l AS (SELECT word AS ortho, 1 + length(word) % 2 AS type, CASE WHEN length(word) % 2 = 0 THEN replace(word, 'é', 'e')
  ELSE replace(word, 'é', 'è') || '/' || replace(word, 'é', 'è') || 's' END AS post90 FROM vocab WHERE contains(word, 'é') AND length(word) % 5 <> 0),
w AS (SELECT word AS old, replace(word, 'é', CASE WHEN length(word) % 4 = 0 THEN 'e' ELSE 'è' END) AS new FROM vocab WHERE contains(word, 'é') AND length(word) % 3 <> 0
  UNION ALL SELECT replace(upper(word), 'ẞ', 'SS'), word FROM vocab WHERE length(word) = 4)"""
NEVER = ["épa", "éou"]


def official(spark, sf):
    v = vocabulary(spark, sf).filter(F.contains("word", F.lit("é")) & (F.length("word") % 5 != 0))
    e, g = F.replace("word", F.lit("é"), F.lit("e")), F.replace("word", F.lit("é"), F.lit("è"))
    return v.select(
        F.col("word").alias("ortho"),
        (F.length("word") % 2 + 1).alias("type"),
        F.when(F.length("word") % 2 == 0, e).otherwise(F.concat(g, F.lit("/"), g, F.lit("s"))).alias("post90"),
    )


def crowd(spark, sf):
    v = vocabulary(spark, sf)
    n = F.length("word")
    e, g = F.replace("word", F.lit("é"), F.lit("e")), F.replace("word", F.lit("é"), F.lit("è"))
    a = v.filter(F.contains("word", F.lit("é")) & (n % 3 != 0)).select(
        F.col("word").alias("old"), F.when(n % 4 == 0, e).otherwise(g).alias("new")
    )
    return a.unionByName(v.filter(n == 4).select(F.upper("word").alias("old"), F.col("word").alias("new")))


# official spellings with their forms for one and for many, and the form that fits the word itself
FORMS_SQL = """parted AS (SELECT *, regexp_extract(post90, '^([^/]*)/', 1) AS one, regexp_replace(post90, '^[^/]*/', '') AS many FROM l),
picked AS (SELECT ortho, CASE WHEN type = 1 THEN [post90] ELSE [one, many] END AS forms,
  CASE WHEN type = 1 THEN post90 WHEN right(ortho, 1) IN ('s', 'x') THEN many ELSE one END AS new FROM parted)"""


@query("select_spelling_by_number", f"WITH {SPELLINGS_SQL}, {FORMS_SQL} SELECT ortho, new FROM picked")
def select_spelling_by_number(spark, sf):
    return official(spark, sf).select("ortho", X.select_new(F.col("ortho"), F.col("type"), F.col("post90")).alias("new"))


@query(
    "reconcile_sources",
    f"""WITH {SPELLINGS_SQL}, {FORMS_SQL},
agreeing AS (SELECT ortho AS old, picked.new FROM picked JOIN w AS crowd ON crowd.old = ortho AND list_contains(forms, crowd.new)),
official_only AS (SELECT ortho AS old, new FROM picked WHERE ortho NOT IN (SELECT old FROM w)),
crowd_only AS (SELECT DISTINCT old, new FROM w WHERE old NOT IN (SELECT ortho FROM l))
SELECT old, new FROM (FROM agreeing UNION FROM official_only) WHERE old <> new AND NOT list_contains(['épa', 'éou'], old)
UNION ALL SELECT old, new FROM crowd_only WHERE old <> new AND lower(old) = old""",
)
def reconcile_sources(spark, sf):
    return X.reconcile(official(spark, sf), crowd(spark, sf), NEVER)


@query(
    "corrections_table",
    f"""WITH {SPELLINGS_SQL}, e AS (SELECT old, max(new || '!') AS fix FROM w WHERE length(old) = 6 GROUP BY 1)
SELECT w.old, coalesce(e.fix, w.new) AS new FROM w LEFT JOIN e ON e.old = w.old""",
)
def corrections_table(spark, sf):
    w = crowd(spark, sf)
    fixes = w.filter(F.length("old") == 6).select("old", F.concat("new", F.lit("!")).alias("new"))
    return X.override_from(w, fixes, "old", "new")


# The twin's edit distance counts bytes: letters of more than one are swapped first.
L = "'éèêëàâäáîïíôöóùûüúçñßœæ', '0123456789!#$%&*+;<=>@'"

# A dump of tagged definitions made from the vocabulary.
DUMP_SQL = f"""{LEXICON_SQL},
dump AS (SELECT rank AS line_no, ortho AS word, CASE WHEN length(ortho) % 7 = 0 THEN NULL ELSE phon END AS ipa,
  CASE WHEN length(ortho) % 3 = 0 THEN 'orthographe traditionnelle (x)' WHEN length(ortho) % 3 = 1 THEN 'orthographe rectifiée de 1990'
    WHEN contains(ortho, 'h') THEN 'h aspiré' END AS tag FROM lexicon
  UNION ALL SELECT rank + 100000000, ortho, phon || 'x', CASE WHEN contains(ortho, 'c') THEN 'h aspiré' END FROM lexicon WHERE contains(ortho, 'e')),
defs AS (SELECT line_no, word, ipa, coalesce(contains(tag, 'rectifiée'), false) AS rect, coalesce(contains(tag, 'traditionnelle'), false) AS trad,
  coalesce(contains(tag, 'h aspir'), false) AS h_aspire, tag IS NOT NULL AS tagged FROM dump
  WHERE ipa IS NOT NULL AND NOT regexp_matches(word, '[-0-9.+()&/ ,"]'))"""


def dump(spark, sf):
    """Words with an e have a second definition, with another sound, far below the first."""
    from graphie.plans.dictionaries import ranked
    from graphie.plans.registry import sound

    n = F.length("ortho")
    no_tags = F.lit(None).cast("array<string>")

    def lines(lx, line_no, tag, ipa):
        sounds = F.array(F.struct(ipa.alias("ipa"), no_tags.alias("tags"))).alias("sounds")
        return lx.select(line_no.alias("line_no"), F.col("ortho").alias("word"), F.when(tag.isNotNull(), F.array(tag)).alias("tags"), sounds)

    lx = ranked(spark, sf)
    tag = (
        F.when(n % 3 == 0, "orthographe traditionnelle (x)")
        .when(n % 3 == 1, X.RECTIFIED_TAG)
        .when(F.contains("ortho", F.lit("h")), "h aspiré")
    )
    again = F.when(F.contains("ortho", F.lit("c")), "h aspiré")
    first = lines(lx, F.col("rank"), tag, F.when(n % 7 != 0, sound("ortho")))
    second = lines(lx.filter(F.contains("ortho", F.lit("e"))), F.col("rank") + 100_000_000, again, F.concat(sound("ortho"), F.lit("x")))
    return first.unionByName(second)


@query("tagged_definitions", f"WITH {DUMP_SQL} SELECT * FROM defs")
def tagged_definitions(spark, sf):
    return X.tag_definitions(dump(spark, sf))


@query(
    "first_pronunciations",
    f"WITH {DUMP_SQL} SELECT word, arg_min(ipa, line_no) AS ipa, arg_min(h_aspire, line_no) AS h_aspire FROM defs GROUP BY word",
)
def first_pronunciations(spark, sf):
    return X.first_pronunciations(X.tag_definitions(dump(spark, sf)))


@query(
    "match_spellings_by_sound",
    f"""WITH {DUMP_SQL}, o AS (SELECT word, ipa, word LIKE '%s' AS s, word LIKE '%x' AS x FROM defs WHERE trad),
n AS (SELECT word, ipa, word LIKE '%s' AS s, word LIKE '%x' AS x FROM defs WHERE rect AND NOT trad),
r AS (SELECT o.word AS old, n.word AS new, 1 - levenshtein(translate(o.word, {L}), translate(n.word, {L})) / greatest(length(o.word), length(n.word)) AS r
  FROM o JOIN n ON o.ipa = n.ipa AND o.s = n.s AND o.x = n.x),
b AS (SELECT old, new FROM r QUALIFY row_number() OVER (PARTITION BY old ORDER BY r DESC, new) = 1)
SELECT old, CASE WHEN old = 'lieder' THEN 'lieds' ELSE new END AS new FROM b WHERE NOT (old LIKE '%y' AND new = substr(old, 1, length(old) - 1) || 'ie')""",
)
def match_spellings_by_sound(spark, sf):
    return X.match_by_sound(X.tag_definitions(dump(spark, sf)), exact_ratio=False)


# Blocks of two words, the longest first: each row of w is a pair of sides, with the letters of the block it was cut from.
@query(
    "match_spellings_by_sequence_ratio",
    f"""WITH RECURSIVE {DUMP_SQL}, o AS (SELECT word, ipa, word LIKE '%s' AS s, word LIKE '%x' AS x FROM defs WHERE trad),
n AS (SELECT word, ipa, word LIKE '%s' AS s, word LIKE '%x' AS x FROM defs WHERE rect AND NOT trad),
pairs AS (SELECT DISTINCT o.word AS old, n.word AS new FROM o JOIN n ON o.ipa = n.ipa AND o.s = n.s AND o.x = n.x),
w AS (SELECT old, new, old AS a, new AS b, 0 AS m FROM pairs UNION ALL
  SELECT old, new, side.a, side.b, side.m FROM (
    SELECT old, new, unnest([{{'a': substr(a, 1, k.i - 1), 'b': split_part(b, t, 1), 'm': k.n}},
      {{'a': substr(a, k.i + k.n), 'b': substr(b, length(split_part(b, t, 1)) + k.n + 1), 'm': 0}}]) AS side
    FROM (SELECT *, substr(a, k.i, k.n) AS t FROM (
      SELECT *, list_filter(flatten([[{{'n': CAST(n AS INT), 'i': CAST(i AS INT)}} FOR i IN range(1, length(a) - n + 2)] FOR n IN range(length(a), 0, -1)]),
        lambda c: contains(b, substr(a, c.i, c.n)))[1] AS k
      FROM w WHERE a <> '' AND b <> '') WHERE k IS NOT NULL))),
r AS (SELECT old, new, 2.0::DOUBLE * sum(m) / (length(old) + length(new)) AS r FROM w GROUP BY old, new),
b AS (SELECT old, new FROM r QUALIFY row_number() OVER (PARTITION BY old ORDER BY r DESC, new) = 1)
SELECT old, CASE WHEN old = 'lieder' THEN 'lieds' ELSE new END AS new FROM b WHERE NOT (old LIKE '%y' AND new = substr(old, 1, length(old) - 1) || 'ie')""",
)
def match_spellings_by_sequence_ratio(spark, sf):
    return X.match_by_sound(X.tag_definitions(dump(spark, sf)), exact_ratio=True)


POST_SQL = f"""{LEXICON_SQL},
post(old, new) AS (SELECT ortho, replace(ortho, 'ê', 'e') FROM lexicon WHERE contains(ortho, 'ê') UNION ALL SELECT 'eau', 'solos')"""


def post(spark, sf):
    lx = lexicon(spark, sf).filter(F.contains("ortho", F.lit("ê")))
    p = lx.select(F.col("ortho").alias("old"), F.replace("ortho", F.lit("ê"), F.lit("e")).alias("new"))
    return p.union(spark.createDataFrame([("eau", "solos")], "old string, new string"))


@query(
    "lexicon_with_official_spellings",
    f"""WITH {POST_SQL} SELECT coalesce(p.new, l.ortho) AS ortho, CASE WHEN p.new = 'solos' THEN 'solo' ELSE phon END AS phon, lemme, freq
FROM lexicon l LEFT JOIN post p ON p.old = l.ortho""",
)
def lexicon_with_official_spellings(spark, sf):
    return X.build_lexicon_post90(lexicon(spark, sf), post(spark, sf), replace=True)


@query(
    "lexicon_with_both_spellings",
    f"""WITH {POST_SQL} SELECT ortho, phon, lemme, freq FROM lexicon UNION ALL
SELECT p.new, CASE WHEN p.new = 'solos' THEN 'solo' ELSE phon END, lemme, freq FROM lexicon l JOIN post p ON p.old = l.ortho""",
)
def lexicon_with_both_spellings(spark, sf):
    return X.build_lexicon_post90(lexicon(spark, sf), post(spark, sf), replace=False)


@query(
    "ligature_twins",
    f"""WITH {LEXICON_SQL}, l AS (SELECT replace(ortho, 'oi', 'oe') AS ortho, min(phon) AS phon, min(lemme) AS lemme, min(freq) AS freq
  FROM lexicon WHERE NOT contains(ortho, 'œ') GROUP BY 1)
SELECT * FROM l UNION ALL SELECT replace(ortho, 'oe', 'œ'), phon, lemme, freq FROM l WHERE contains(ortho, 'oe')""",
)
def ligature_twins(spark, sf):
    lx = lexicon(spark, sf).filter(~F.contains("ortho", F.lit("œ")))
    one = lx.groupBy(F.replace("ortho", F.lit("oi"), F.lit("oe")).alias("ortho")).agg(
        *[F.min(c).alias(c) for c in ("phon", "lemme", "freq")]
    )
    return X.oe_twins(one)


GRAMMAR_SQL = f"""{LEXICON_SQL},
gram AS (SELECT ortho, substr(ortho, 1, 4) AS lemme, CASE WHEN length(ortho) % 2 = 0 THEN 'VER' ELSE 'NOM' END AS cgram,
  CASE WHEN ortho LIKE '%e' THEN 'f' WHEN length(ortho) % 3 = 0 THEN '' ELSE 'm' END AS genre, CASE WHEN ortho LIKE '%s' THEN 'p' ELSE 's' END AS nombre,
  CASE WHEN ortho LIKE '%é%' THEN 'par:pas' ELSE 'ind:pre' END AS infover FROM lexicon)"""


def grammar(spark, sf):
    o = F.col("ortho")
    v = stored(vocabulary(spark, sf), "vocabulary")  # read for both sides of the pairs
    return lexicon(spark, sf, v).select(
        "ortho",
        F.substr("ortho", F.lit(1), F.lit(4)).alias("lemme"),
        F.when(F.length(o) % 2 == 0, "VER").otherwise("NOM").alias("cgram"),
        F.when(o.endswith("e"), "f").when(F.length(o) % 3 == 0, "").otherwise("m").alias("genre"),
        F.when(o.endswith("s"), "p").otherwise("s").alias("nombre"),
        F.when(o.contains("é"), "par:pas").otherwise("ind:pre").alias("infover"),
    )


_PAIRS_SQL = """pp AS (SELECT DISTINCT a.ortho AS var, b.ortho AS invar FROM gram a JOIN gram b ON a.lemme = b.lemme
WHERE a.cgram = 'VER' AND b.cgram = 'VER' AND a.infover = 'par:pas' AND b.infover = 'par:pas'
AND (a.genre = 'f' OR a.nombre = 'p') AND b.genre IN ('m', '') AND b.nombre IN ('s', ''))"""


@query("participle_pairs", f"WITH {GRAMMAR_SQL}, {_PAIRS_SQL} SELECT * FROM pp")
def participle_pairs(spark, sf):
    return X.participle_pairs(grammar(spark, sf))


HEADS = ["de", "la", "le", "les", "des", "en", "un", "une", "est", "pour", "the", "of"]


_AFTER_SQL = f"""WITH {GRAMMAR_SQL}, {_PAIRS_SQL}, p AS (SELECT var, min(invar) AS invar FROM pp GROUP BY 1),
src AS (SELECT doc_id, text, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+') AS ws, regexp_split_to_array(text, '[\\p{{L}}\\p{{N}}_]+') AS ss FROM documents),
x AS (SELECT doc_id, unnest(ws) AS w, unnest(list_slice(ss, 1, len(ws))) AS s, generate_subscripts(ws, 1) AS i FROM src),
y AS (SELECT doc_id, i, w, s, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM x),
n AS (SELECT doc_id, list(CASE WHEN s = ' ' AND prev IN ({', '.join("'" + h + "'" for h in HEADS)}) THEN coalesce(p.invar, w) ELSE w END ORDER BY i) AS ns
  FROM y LEFT JOIN p ON p.var = y.w GROUP BY 1)
SELECT src.doc_id, md5(CASE WHEN ns IS NULL THEN text ELSE array_to_string(list_transform(list_zip(ss, ns), lambda q: q[1] || coalesce(q[2], '')), '') END) AS digest
FROM src LEFT JOIN n ON n.doc_id = src.doc_id"""


@query("rewrite_after_auxiliary", _AFTER_SQL)
def rewrite_after_auxiliary(spark, sf):
    docs = documents(spark, sf, "doc_id", "text")
    heads = spark.createDataFrame([(h,) for h in HEADS], "word string")
    r = X.rewrite_after(docs, "text", heads, X.participle_pairs(grammar(spark, sf), least=True))
    return r.select("doc_id", F.md5("text").alias("digest"))


@query("rewrite_after_auxiliary_by_join", _AFTER_SQL)
def rewrite_after_auxiliary_by_join(spark, sf):
    """The plan for word lists over the bound, forced."""
    docs = documents(spark, sf, "doc_id", "text")
    heads = spark.createDataFrame([(h,) for h in HEADS], "word string")
    r = X.rewrite_after(docs, "text", heads, X.participle_pairs(grammar(spark, sf), least=True), key="doc_id", max_rows=0)
    return r.select("doc_id", F.md5("text").alias("digest"))


@query(
    "word_provenance",
    f"""WITH {VOCAB_SQL}, v AS (SELECT 'vocabulary' AS source, word, CAST(n AS VARCHAR) AS detail FROM vocab),
p AS (SELECT 'part' AS source, p_name AS word, p_type AS detail FROM part), nn AS (SELECT 'nation' AS source, n_name AS word, CAST(n_regionkey AS VARCHAR) AS detail FROM nation)
SELECT * FROM (SELECT * FROM v UNION ALL SELECT * FROM p UNION ALL SELECT * FROM nn) WHERE regexp_full_match(word, '(?:r.d|red .*|NATION.*[02468]|é.u)')""",
)
def word_provenance(spark, sf):
    sources = {
        "vocabulary": vocabulary(spark, sf),
        "part": table(spark, sf, "part").select("p_name", "p_type"),
        "nation": table(spark, sf, "nation").select("n_name", "n_regionkey"),
    }
    return X.provenance(sources, "r.d|red .*|NATION.*[02468]|é.u")


TEACHING = [("%ll%", "%l%"), ("%eî%", None), ("%ain%", None), ("%ch%", "%k%"), ("%ph%", None), ("%oi%", "%wa%"), ("%th%", None)]


@query(
    "teaching_word_list",
    f"""WITH {LEXICON_SQL} SELECT DISTINCT ortho, freq FROM lexicon WHERE ortho = lemme AND
({' OR '.join(f"(ortho LIKE '{o}'" + (f" AND phon LIKE '{p}')" if p else ')') for o, p in TEACHING)})""",
)
def teaching_word_list(spark, sf):
    # The patterns are met by each word once: not by each time it stands in a text, and not again for the borders
    # of the sorted parts.
    lx = lexicon(spark, sf, stored(vocabulary(spark, sf), "vocabulary")).filter("ortho = lemme")
    words = stored(X.teaching_words(lx, TEACHING).select("ortho", "freq").distinct(), "teaching")
    return X.by_frequency(words.withColumn("f", F.col("freq").cast("string")), "f").drop("f")


@query(
    "spelling_families",
    f"""WITH {VOCAB_SQL}, r AS (SELECT replace(replace(word, 'é', 'e'), 'è', 'e') AS modern, word AS old, contains(word, 'eau') AS touched FROM vocab)
SELECT modern, coalesce(string_agg(old, ',' ORDER BY translate(old, 'eéè', '123')) FILTER (old <> modern), '') AS olds, bool_or(touched) AS touched FROM r GROUP BY 1""",
)
def spelling_families(spark, sf):
    """A family differs in its accents alone: none comes first, then acute, then grave, from the left."""
    v = vocabulary(spark, sf)
    rows = v.select(
        F.col("word").alias("old"),
        F.replace(F.replace("word", F.lit("é"), F.lit("e")), F.lit("è"), F.lit("e")).alias("modern"),
        F.contains("word", F.lit("eau")).alias("touched"),
    )
    return X.spelling_families(rows).select("modern", F.array_join("olds", ",").alias("olds"), "touched")


@query(
    "keyboard_word_list",
    f"""WITH {LEXICON_SQL}, d AS (SELECT ortho AS old, replace(ortho, 'eau', 'ô') AS new FROM lexicon WHERE contains(ortho, 'eau')),
t AS (SELECT new, min(rank) AS rank FROM lexicon JOIN d ON d.old = ortho GROUP BY 1 ORDER BY 2, 1 LIMIT 1000)
SELECT '' AS shortcut, new, 'fr-FR' AS lang FROM t""",
)
def keyboard_word_list(spark, sf):
    from graphie.plans.dictionaries import ranked
    from graphie.plans.registry import dict_eau

    return X.keyboard_list(ranked(spark, sf), dict_eau(spark, sf))


@query(
    "keyboard_shortcut_lines",
    f"""WITH {LEXICON_SQL}, d AS (SELECT ortho AS old, replace(ortho, 'eau', '') AS new FROM lexicon WHERE contains(ortho, 'eau'))
SELECT old, 0 AS line_no, ' word=' || old || ',f=1,not_a_word=true' AS line FROM d WHERE new <> ''
UNION ALL SELECT old, 1, '  shortcut=' || new || ',f=14' FROM d WHERE new <> ''""",
)
def keyboard_shortcut_lines(spark, sf):
    v = vocabulary(spark, sf).filter(F.contains("word", F.lit("eau")))
    d = v.select(F.col("word").alias("old"), F.replace("word", F.lit("eau"), F.lit("")).alias("new"))
    return X.keyboard_shortcuts(d)
