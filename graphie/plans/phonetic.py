"""Alignment and phonetic rules on the pseudo lexicon of the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphie.functions import graphemes as G
from graphie.functions import text
from graphie.operators import lexicon as X
from graphie.operators import phonetics as P
from graphie.operators import rules as R
from graphie.plans import rule_twins as T
from graphie.plans.dictionaries import ranked, simplify_sql
from graphie.plans.registry import LEXICON_SQL, VOCAB_SQL, WORD_SQL, documents, lexicon, query, table, values_sql, vocabulary

# A small grapheme table that explains the pseudo sounds, some of it surprising.
SMALL = [("eaux", "o", 0), ("eau", "o", 0), ("aux", "o", 0), ("au", "o", 0), ("oi", "wa", 0), ("ou", "u", 0), ("ch", "S", 0),
    ("qu", "k", 0), ("en", "@", 0), ("an", "@", 0), ("on", "§", 0), ("ai", "E", 0), ("è", "E", 0), ("ê", "E", 2), ("é", "e", 0),
    ("ç", "s", 0), ("e", "", 2), ("es$", "es", 1), ("s", "s", 0), ("nt", "nt", 2)] + [(c, c, 0) for c in "abcdefghijklmnopqrtuvwxyz"]


def small_rules():
    return [{"g": g, "p": p, "imp": i, "l": "", "r": ""} for g, p, i in SMALL]


@query(
    "align_with_small_table",
    f"""WITH RECURSIVE {LEXICON_SQL}, {values_sql('rules', 'g, p, imp', SMALL)},
r AS (SELECT g, p, imp, length(g) AS gl, length(p) AS pl, octet_length(encode(g)) AS gb, substr(g, 1, 1) AS f FROM rules),
words AS (SELECT ortho, phon FROM lexicon WHERE length(ortho) > 0),
core AS (SELECT ortho, i, max(gb) AS longest FROM (SELECT ortho, unnest(range(0, length(ortho))) AS i FROM words)
  JOIN r ON f = substr(ortho, i + 1, 1) AND substr(ortho || '$', i + 1, gl) = g WHERE imp = 0 GROUP BY 1, 2),
walk AS (SELECT ortho, phon, 0 AS i, 0 AS j, 0 AS surprise, CAST([] AS INTEGER[]) AS trail, '' AS gs FROM words
  UNION ALL SELECT w.ortho, w.phon, CAST(w.i + gl AS INTEGER), CAST(w.j + pl AS INTEGER),
    w.surprise + CASE WHEN imp = 2 OR gb < coalesce(c.longest, 0) THEN 1 ELSE 0 END,
    list_append(w.trail, CAST((w.j + pl) * 1000 + w.i + gl AS INTEGER)), w.gs || g || '|'
  FROM walk w JOIN r ON f = substr(w.ortho, w.i + 1, 1) AND substr(w.ortho || '$', w.i + 1, gl) = g AND substr(w.phon, w.j + 1, pl) = p
  LEFT JOIN core c ON c.ortho = w.ortho AND c.i = w.i WHERE w.i < length(w.ortho)),
best AS (SELECT ortho, max({{'t': trail, 's': surprise, 'g': gs}}) AS b FROM walk WHERE i >= length(ortho) AND j = length(phon) GROUP BY 1)
SELECT w.ortho, w.phon, b.s AS surprise, b.g AS graphemes FROM words w LEFT JOIN best ON best.ortho = w.ortho""",
)
def align_with_small_table(spark, sf):
    a = P.align_lexicon(lexicon(spark, sf), small_rules())
    gs = F.array_join(F.transform("path", lambda e: F.concat(e["g"], F.lit("|"))), "")
    return a.select("ortho", "phon", "surprise", gs.alias("graphemes"))


# How a reader of French would say an invented word: replacements in order, "ń" is an n that is spoken.
_SPOKEN = [
    *[("n" + v, "ń" + v) for v in "aeiouyéèêëàâîïôœû"], ("nń", "ńń"), ("nn", "ńń"),
    *[("e" + c + c, "E" + c) for c in "bcdfglmprtz"], ("eńń", "Eń"), ("ess", "Es"),
    ("eaux", "o"), ("eau", "o"), ("aux", "o"), ("au", "o"), ("oeu", "9"), ("œu", "9"), ("eu", "2"), ("oin", "w5"), ("oi", "wa"), ("ou", "U"),
    ("ain", "5"), ("ein", "5"), ("ai", "E"), ("ei", "E"), ("sch", "S"), ("ch", "S"), ("ph", "f"), ("gń", "N"), ("gn", "N"),
    ("cqu", "k"), ("qu", "k"), *[("gu" + v, "ǧ" + v) for v in "eiéèêa"], *[(c + v, s + v) for c, s in (("c", "s"), ("g", "Z")) for v in "eiéèêy"],
    *[(v + n + b, s + b) for v, s in (("e", "@"), ("a", "@"), ("o", "§"), ("i", "5"), ("u", "1")) for n in "m" for b in "bp"],
    ("en", "@"), ("an", "@"), ("on", "§"), ("in", "5"), ("un", "1"),
    *[("e" + v, v) for v in "aoéèêàâîïôœûy"], ("ee", "e"),
    *[(c + c, c) for c in "bcdfklmprstz"], ("ńń", "ń"), ("x", "ks"), ("'", ""), ("h", ""),
]
_SINGLE = ("ńǧçcqéèêëàâäîïôöûùüœejruyU", "ngskkeEEEaaaiioOyyy2°ZRyiu")


def spoken(col):
    """One fold over the table of replacements, then single letters."""
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in _SPOKEN])
    return F.translate(F.aggregate(pairs, F.col(col), lambda acc, x: F.replace(acc, x["a"], x["b"])), *_SINGLE)


def spoken_sql(expr: str) -> str:
    for a, b in _SPOKEN:
        expr = f"replace({expr}, {T.quoted(a)}, {T.quoted(b)})"
    return f"translate({expr}, '{_SINGLE[0]}', '{_SINGLE[1]}')"


SPOKEN_SQL = f"""{VOCAB_SQL},
spoken AS MATERIALIZED (SELECT word AS ortho, {spoken_sql('word')} AS phon, regexp_replace(word, 's$', '') AS lemme, length(word) % 2 = 0 AS h,
  row_number() OVER (ORDER BY n DESC, word) AS rank FROM vocab)"""


def small_lexicon(spark, sf):
    """The words of the documents with sounds, ranks and an initial-h flag."""
    lx = ranked(spark, sf)
    return lx.select(
        "ortho", spoken("ortho").alias("phon"), F.regexp_replace("ortho", "s$", "").alias("lemme"), "rank",
        (F.length("ortho") % 2 == 0).alias("h_aspire"),
    )


_FRENCH_TABLE, _FRENCH_CASE = T.grapheme_tables(G.french_rules())


@query(
    "align_with_french_table",
    f"""WITH RECURSIVE {SPOKEN_SQL}, {_FRENCH_TABLE}, {T.alignment("al", "spoken", _FRENCH_CASE).strip()}
SELECT ortho, phon, surprise, coalesce(array_to_string(list_transform(path, lambda e: e.g), '|') || ' ' ||
  array_to_string(list_transform(path, lambda e: e.p), '|'), '') AS explained FROM spoken LEFT JOIN al USING (ortho, phon)""",
)
def align_with_french_table(spark, sf):
    """The report of the rule checker: how each word is explained, and how surprising."""
    a = P.align_lexicon(small_lexicon(spark, sf))
    return a.select("ortho", "phon", "surprise", P.path_text(F.col("path")).alias("explained"))


def _ruleset(name: str, *names: str):
    def run(spark, sf):
        table_ = R.builtin()
        r = R.respell_lexicon(small_lexicon(spark, sf), [table_[n] for n in names])
        return r.filter("old <> new").select("old", "new", "sub")

    sql = T.rules_sql("spoken", [R.builtin()[n] for n in names])
    query(name, f"WITH RECURSIVE {SPOKEN_SQL},\n{sql}\nSELECT old, new, sub FROM respelled WHERE old <> new")(run)


_ruleset("rules_flagship", "flagship")
_ruleset("rules_letters", "circonflexe/", "qu/q", "ti/ci", "cq/q", "emment/ament", "oiement/oiment", "qua-o-u/ca-o-u", "que/c")
_ruleset("rules_sounds", "sc-sch/c-ch", "en/an", "um/ome", "gu/gh", "g/j", "gn/ni", "ez/es", "ent/es", "m-mbp/n-mbp", "qu/qou")
_ruleset("rules_plural_and_il", "aux/als", "il/y", "accent-plat")
_ruleset("rules_sound_net", "sound-net")
_ruleset("rules_alfonic", "alfonic", "accent-plat")
_ruleset("rules_ou_letter", "ou/w")
_ruleset("rules_ou_omega", "ou/omega", "qu/q")


_CUSTOM = [("ê", "E"), ("eau", "ô"), ("qu", "q")]


@query(
    "rules_custom_accent",
    f"WITH RECURSIVE {SPOKEN_SQL},\n{T.rules_sql('spoken', [R.custom(_CUSTOM)])}\nSELECT old, new, sub FROM respelled WHERE old <> new",
)
def rules_custom_accent(spark, sf):
    r = R.respell_lexicon(small_lexicon(spark, sf), [R.custom(_CUSTOM)])
    return r.filter("old <> new").select("old", "new", "sub")


# A silent h is allowed where fewer than three stand before, so a step that makes one ends there.
_H_TABLE = [*small_rules(), {"g": "h", "p": "", "imp": 0, "l": "^[^h]*(?:h[^h]*){0,2}$", "r": ""}]
_GROWING = [P.step("begin"), P.text("t", "ht"), P.text("qu", "q"), P.text("é", "hhé")]


@query(
    "rewrite_to_fixpoint",
    f"""WITH RECURSIVE {LEXICON_SQL}, {T.grapheme_tables(_H_TABLE)[0]}, {T.alignment("plain", "lexicon", T.grapheme_tables(_H_TABLE)[1]).strip()},
started AS MATERIALIZED (SELECT ortho || '|0' AS id, ortho, phon, lemme, false AS h, surprise, path, ortho || '|' || phon AS w0 FROM lexicon JOIN plain USING (ortho, phon)),
s0 AS MATERIALIZED (SELECT id, ortho, phon, surprise, path FROM started),
{T.steps_sql("s1", "s0", _GROWING, T.grapheme_tables(_H_TABLE)[1], "started", grown=5)}
SELECT split_part(id, '|', 1) AS old, ortho AS new, surprise FROM s1 WHERE split_part(id, '|', 1) <> ortho""",
)
def rewrite_to_fixpoint(spark, sf):
    """Steps whose result holds their target: words grow until the alignment refuses."""
    aligned = P.align_lexicon(lexicon(spark, sf), _H_TABLE).filter(F.col("path").isNotNull())
    out = P.fold_steps(P.with_state(aligned), _GROWING, _H_TABLE)
    return out.filter(F.col("ortho") != F.col("st.ortho")).select(F.col("ortho").alias("old"), F.col("st.ortho").alias("new"), "st.surprise")


@query(
    "flagship_mentions",
    f"""WITH {LEXICON_SQL}, x AS (SELECT ortho, phon FROM lexicon)
SELECT count(*) FILTER (contains(ortho, 'll') AND contains(phon, 'l')) AS ll, count(*) FILTER (contains(ortho, 'ch') AND contains(phon, 'k')) AS ch,
  count(*) FILTER (contains(ortho, 'ph')) AS ph, count(*) FILTER (contains(ortho, 'h')) AS h, count(*) FILTER (contains(ortho, 'x')) AS x,
  count(*) FILTER (contains(ortho, 'y')) AS y, count(*) FILTER (contains(ortho, 'oe') OR contains(ortho, 'œ')) AS oe, count(*) FILTER (contains(ortho, 'nss')) AS nss,
  {', '.join(f"count(*) FILTER (contains(ortho, '{c}{c}')) AS {c}{c}" for c in 'bcdfgmnprtz')} FROM x""",
)
def flagship_mentions(spark, sf):
    lx = lexicon(spark, sf)
    return lx.agg(*[F.count_if(c).alias(n) for n, c in R.mentions(lx).items()])


@query(
    "stop_word_rows",
    f"""WITH {LEXICON_SQL}, s AS (SELECT ortho AS word FROM lexicon WHERE length(ortho) = 3)
SELECT ortho, lemme FROM lexicon WHERE octet_length(encode(ortho)) > 1 AND NOT contains(ortho, '-') AND ortho NOT IN (SELECT word FROM s)
AND NOT (lemme || 's' = ortho AND lemme IN (SELECT word FROM s))""",
)
def stop_word_rows(spark, sf):
    lx = lexicon(spark, sf)
    stop = lx.filter(F.length("ortho") == 3).select(F.col("ortho").alias("word"))
    return R.not_usable(lx, stop).select("ortho", "lemme")


@query(
    "preserved_words",
    f"""WITH {LEXICON_SQL} SELECT ortho FROM lexicon WHERE regexp_matches(ortho, '^eau|tion$') OR regexp_replace(ortho, 's$', '') IN ('la', 'le', 'que', 'pour')""",
)
def preserved_words(spark, sf):
    pattern = R.preserve_pattern(["^eau", "tion$"], ["la", "le", "que", "pour"])
    return lexicon(spark, sf).filter(F.col("ortho").rlike(pattern)).select("ortho")


_STATS = ["cq/q", "ti/ci"]


@query(
    "generation_statistics",
    f"""WITH RECURSIVE {SPOKEN_SQL},\n{T.rules_sql('spoken', [R.builtin()[n] for n in _STATS])}
SELECT (SELECT count(*) FROM spoken) AS total, count(*) AS considered, count(*) FILTER (outcome = 'prefiltered_out') AS prefiltered_out,
  count(*) FILTER (outcome = 'failed') AS failed FROM respelled WHERE sub = 0""",
)
def generation_statistics(spark, sf):
    lx = small_lexicon(spark, sf)
    r = R.respell_lexicon(lx, [R.builtin()[n] for n in _STATS])
    return R.generation_stats(lx, r)


def _post(spark, sf):
    v = vocabulary(spark, sf).filter(F.contains("word", F.lit("ê")))
    return v.select(F.col("word").alias("old"), F.replace("word", F.lit("ê"), F.lit("e")).alias("new"))


_POST_SQL = f"""{SPOKEN_SQL},
post AS MATERIALIZED (SELECT ortho AS old, replace(ortho, 'ê', 'e') AS new FROM spoken WHERE contains(ortho, 'ê')),
official AS MATERIALIZED (SELECT coalesce(p.new, s.ortho) AS ortho, phon, lemme, h, rank FROM spoken s LEFT JOIN post p ON p.old = s.ortho)"""


def _dictionary_sql(results: str) -> str:
    """The rest of a dictionary from ``old, new, rank, sub``: first spelling, official entries, implied plurals."""
    return f"""
gen AS MATERIALIZED (SELECT old, arg_min(new, rank * 2 + sub) AS new, min(rank) AS rank FROM ({results}) GROUP BY old),
full_d AS MATERIALIZED (SELECT old, new, rank FROM gen UNION ALL
  SELECT p.old, coalesce(b.new, p.new), CASE WHEN b.rank >= 0 THEN b.rank ELSE {X.LATE_RANK} END FROM post p LEFT JOIN gen b ON b.old = p.new
  WHERE p.old NOT IN (SELECT old FROM gen) AND NOT (b.new IS NULL AND regexp_matches(p.new, '{X.UNDESIRABLE}'))),
{simplify_sql('full_d', 's').strip()}
SELECT w.old, CASE WHEN w.old = w.new THEN '' ELSE w.new END AS new, f.rank FROM walk w JOIN full_d f ON f.old = w.old WHERE w.keep"""


_FLAGSHIP_SQL = T.rules_sql("official", [R.builtin()["flagship"]], fix_oe=True)


@query("generate_dictionary", f"WITH RECURSIVE {_POST_SQL},\n{_FLAGSHIP_SQL},{_dictionary_sql('SELECT old, new, rank, sub FROM respelled')}")
def generate_dictionary(spark, sf):
    d, _ = R.build_dictionary(small_lexicon(spark, sf), post90=_post(spark, sf))
    return d


_CORPUS = ["qu/q", "circonflexe/"]


@query(
    "generate_dictionary_for_corpus",
    f"""WITH RECURSIVE {SPOKEN_SQL},
said AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '{WORD_SQL}'))) AS w FROM conversations),
pieces AS (SELECT w FROM said UNION SELECT unnest(string_split(w, '-')) FROM said),
forms AS (SELECT w FROM pieces UNION SELECT regexp_replace(w, 's$', '') FROM pieces),
used AS MATERIALIZED (SELECT * FROM spoken WHERE ortho IN (SELECT w FROM forms UNION SELECT replace(w, 'œ', 'oe') FROM forms)),
{T.rules_sql('used', [R.builtin()[n] for n in _CORPUS])}
SELECT old, arg_min(new, rank * 2 + sub) AS new, min(rank) AS rank FROM respelled GROUP BY old""",
)
def generate_dictionary_for_corpus(spark, sf):
    """Only words that the conversations use are aligned."""
    turns = table(spark, sf, "conversations", "conv_id")
    words = turns.select(F.explode(text.words("text")).alias("word")).distinct()
    d, _ = R.build_dictionary(small_lexicon(spark, sf), _CORPUS, vocabulary=words, all_words=True)
    return d


@query(
    "extend_reference_dictionary",
    f"""WITH RECURSIVE {_POST_SQL},\n{_FLAGSHIP_SQL},
{_dictionary_sql("SELECT old, new, rank, sub FROM respelled UNION ALL SELECT ortho, replace(ortho, 'aux', 'aus'), -1, 0 FROM spoken WHERE contains(ortho, 'aux')").strip()} AND f.rank >= 0""",
)
def extend_reference_dictionary(spark, sf):
    v = vocabulary(spark, sf).filter(F.contains("word", F.lit("aux")))
    ref = v.select(F.col("word").alias("old"), F.replace("word", F.lit("aux"), F.lit("aus")).alias("new"))
    return R.extend_dictionary(ref, small_lexicon(spark, sf), _post(spark, sf))


@query(
    "rule_steps",
    "SELECT count(*) AS n_docs, CAST(sum(length(text) - length(replace(text, 'qu', ''))) // 2 AS BIGINT) AS n_targets FROM documents".replace(
        "sum(length(text) - length(replace(text, 'qu', ''))) // 2", "sum(length(text) - length(replace(text, 'qu', ''))) / 2"
    ),
)
def rule_steps(spark, sf):
    """How often the target of a rule's step occurs in the corpus."""
    target = R.describe_steps([R.builtin()["qu/q"]])[1]["target"]
    n = (F.length("text") - F.length(F.replace("text", F.lit(target), F.lit("")))) / len(target)
    return documents(spark, sf, "doc_id", "text").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(n).cast("bigint").alias("n_targets")
    )


_V = G.SOUND_VOWELS


@query(
    "accent_by_syllable",
    f"""WITH {SPOKEN_SQL}, r AS (SELECT DISTINCT regexp_extract(phon, '[eE](.*)$', 1) AS "right" FROM spoken WHERE regexp_matches(phon, '[eE]'))
SELECT "right", CASE WHEN length("right") <= 1 THEN "right" = '' WHEN regexp_matches("right", '^.(?:[{_V}]|[j8w][{_V}])') THEN NOT regexp_matches("right", '^.°')
  WHEN regexp_matches("right", '[{_V.replace('°', '')}]') THEN regexp_matches("right", '^[bptdkgvf][Rlwj8]') ELSE false END AS acute FROM r""",
)
def accent_by_syllable(spark, sf):
    """For each sound that follows an e in the lexicon: is it written é?"""
    lx = small_lexicon(spark, sf).filter(F.col("phon").rlike("[eE]"))
    right = F.regexp_extract("phon", "[eE](.*)$", 1)
    return lx.select(right.alias("right")).distinct().withColumn("acute", P.accent_aigu(F.col("right")))


