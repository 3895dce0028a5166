"""Accent-insensitive, shortest-first prefix search of a dictionary, for query tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphie.functions import text as T
from graphie.functions.plan import spread_key
from graphie.sources.files import stored

DEFAULT_LIMIT = 10


def build_index(entries: DataFrame, surfaces: Column, entry_id: str, *payload: str) -> DataFrame:
    """One row per spelling of an entry: ``len, key, surface, entry_id, payload``.

    ``len`` counts bytes of the key. Write it sorted by (len, key) so that readers can skip row groups.
    """
    return (
        entries.select(F.col(entry_id).alias("entry_id"), *payload, F.explode(F.array_distinct(surfaces)).alias("surface"))
        .withColumn("key", T.strip_marks("surface"))
        .withColumn("len", F.octet_length("key"))
        .select("len", "key", "surface", "entry_id", *payload)
    )



def clean_query(q: Column | str) -> Column:
    """Leading spaces and one trailing space removed, lower case. Null when there is
    nothing to search."""
    q = F.col(q) if isinstance(q, str) else q
    t = F.lower(F.regexp_replace(q, "^ *(.*?) ?$", "$1"))
    return F.when(t != "", t)


# What a plain letter of the query accepts in the entry.
_ACCEPTS = {
    "a": "[aàâä]", "e": "[eéèêë]", "i": "[iîï]", "u": "[uùûü]", "y": "[yÿ]", "c": "[cç]", "o": "[oôö]",
}


def compat_pattern(q: Column) -> Column:
    """Regex for the original spelling. A plain letter accepts its French accented
    forms, an accented one only itself; 'oe' and a final 'o' also accept œ."""
    p = F.regexp_replace(F.translate(q, "\x01\x02\x03", ""), r"([^\p{L}\p{N}])", r"\\$1")
    p = F.replace(p, F.lit("oe"), F.lit("\x01"))
    p = F.regexp_replace(p, "o$", "\x02")
    for letter, accepted in _ACCEPTS.items():
        mark = F.lit("\x03")  # keeps 'c' from matching inside an inserted class
        if letter == "a":
            p = F.replace(p, F.lit("a"), F.concat(mark, F.lit("1")))
            continue
        p = F.replace(p, F.lit(letter), F.concat(mark, F.lit(str(list(_ACCEPTS).index(letter) + 1))))
    for i, accepted in enumerate(_ACCEPTS.values(), 1):
        p = F.replace(p, F.lit(f"\x03{i}"), F.lit(accepted))
    both = _ACCEPTS["o"] + _ACCEPTS["e"]
    p = F.replace(p, F.lit("\x01"), F.lit(f"(?:{both}|œ)"))
    p = F.replace(p, F.lit("\x02"), F.lit(f"(?:{_ACCEPTS['o']}|œ)"))
    return F.concat(F.lit("^"), p)


# Accented letters a plain one accepts; the others are exact.
_PLAIN = str.maketrans({x: k for k, v in _ACCEPTS.items() for x in v.strip("[]")[1:]})
SPELLINGS = 4


def accepts(query: Column, pattern: Column, surface: Column) -> Column:
    """Does the original spelling go with the query? The regex, which has to be compiled for each query, is
    only asked where taking the accents off the spelling does not settle it."""
    marked = "".join(map(chr, _PLAIN))
    folded = F.translate(surface, marked, marked.translate(_PLAIN))
    return F.when(F.startswith(folded, query), True).otherwise(F.rlike(surface, pattern))


def _shortest(qs: DataFrame, index: DataFrame, n: int) -> DataFrame:
    """The ``n`` first spellings of the index for each query, numbered by ``at``.

    Each key is met by equality with its own prefixes: a row per prefix length that some query has. The
    rank limit is applied in the tasks that read the index as well, so what a query of one letter moves
    is no more than what any other does.
    """
    lengths = qs.agg(F.sort_array(F.collect_set(F.length("prefix"))).alias("l")).scalar()
    usable = F.filter("_lengths", lambda n: n <= F.length("key"))
    prefixes = F.transform(usable, lambda n: F.substr(F.col("key"), F.lit(1), n))
    ix = (
        index.filter(F.length("key") > 0)
        .select("len", "key", "surface", "entry_id", lengths.alias("_lengths"))
        .select("len", "key", "surface", "entry_id", F.explode(prefixes).alias("prefix"))
    )
    hits = ix.join(qs, "prefix").filter(accepts(F.col("query"), F.col("pattern"), F.col("surface")))
    w = W.partitionBy("query").orderBy("len", "key", "surface", "entry_id")
    return hits.withColumn("at", F.row_number().over(w)).filter(F.col("at") <= n).drop("prefix", "pattern")


def search(queries: DataFrame, query_col: str, index: DataFrame, *, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """``query, rank, entry_id, surface`` for each distinct query.

    The shortest spellings of a query come first: ``SPELLINGS`` times as many as entries are wanted. A
    query is done when they hold enough entries or are all there are; the others, whose entries have more
    spellings each, go on sixteen times as far.
    """
    qs = (
        queries.select(F.col(query_col).alias("query"))
        .filter(F.col("query").isNotNull())
        .distinct()
        .withColumn("prefix", T.strip_marks("query"))
        .filter(F.length("prefix") > 0)
        .withColumn("pattern", compat_pattern(F.col("query")))
    )
    qs = stored(qs, "queries")  # read for its lengths and for the join, which knows its size then
    n, out = limit * SPELLINGS, None
    while True:
        near = _shortest(qs, index, n + 1).select("query", F.struct("at", "surface", "entry_id").alias("x"))
        rows = near.groupBy("query").agg(F.sort_array(F.collect_list("x")).alias("xs"))  # n + 1 at most
        ids = F.slice(F.array_distinct(F.transform(F.slice("xs", 1, n), lambda x: x["entry_id"])), 1, limit)
        first = lambda e: F.get(F.filter("xs", lambda x: x["entry_id"] == e), F.lit(0))["surface"]
        tops = F.transform(ids, lambda e, i: F.struct((i + 1).alias("rank"), e.alias("entry_id"), first(e).alias("surface")))
        found = stored(rows.select("query", tops.alias("tops"), ((F.size("xs") > n) & (F.size(ids) < limit)).alias("open")), "found")
        ranked = found.filter("NOT open").select("query", F.explode("tops").alias("t")).select("query", "t.rank", "t.entry_id", "t.surface")
        out = ranked if out is None else out.unionByName(ranked)
        if found.filter("open").isEmpty():
            return out
        qs, n = qs.join(found.filter("open").select("query"), "query", "left_semi"), 16 * n


def display_columns(old: Column, post90: Column, new: Column, implied_plural: Column) -> list[Column]:
    """How a result row reads: ``(s)`` for folded plurals, ``-`` for no difference."""
    s = F.when(implied_plural, "(s)").otherwise("")
    none = F.size(old) == 0
    return [
        F.when(none, F.concat(post90, s))
        .otherwise(F.array_join(F.transform(old, lambda a: F.concat(a, s)), "<br>"))
        .alias("other"),
        F.when(none, F.lit("-")).otherwise(F.concat(post90, s)).alias("post90_display"),
        F.when(new == post90, F.lit("-")).otherwise(F.concat(new, s)).alias("new_display"),
    ]


def regular_plurals(lexicon: DataFrame, max_forms: int = 4) -> DataFrame:
    """``word, side (S/P), other``: singular and plural pairs of one lemma that sound
    the same, unless either word is in more than one pair.

    A lemma with more than ``max_forms`` distinct (spelling, sound) is skipped: those
    are verbs. The count is a partial aggregate, the pairing an equi-join.
    """
    forms = lexicon.select("lemme", "ortho", "phon").distinct()
    small = (
        forms.groupBy("lemme").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= max_forms).select("lemme")
    )
    f = forms.join(small, "lemme", "left_semi")
    sing = f.withColumn("plural", F.concat("ortho", F.lit("s")))
    plur = f.select("lemme", "phon", F.col("ortho").alias("plural"))
    pairs = sing.join(plur, ["lemme", "phon", "plural"]).select(F.col("ortho").alias("s"), F.col("plural").alias("p"))
    sides = pairs.select(
        F.explode(
            F.array(
                F.struct(F.col("s").alias("word"), F.lit("S").alias("side"), F.col("p").alias("other")),
                F.struct(F.col("p").alias("word"), F.lit("P").alias("side"), F.col("s").alias("other")),
            )
        ).alias("x")
    ).select("x.*")
    once = sides.groupBy("word").agg(
        F.count(F.lit(1)).alias("n"), F.min("side").alias("side"), F.min("other").alias("other")
    )
    alone = once.filter("n = 1").drop("n")
    # A conflict taints both words of every pair it is in.
    tainted = (
        sides.join(once.filter("n > 1").select("word"), "word", "left_semi")
        .select(F.explode(F.array("word", "other")).alias("word"))
        .distinct()
    )
    return alone.join(tainted, "word", "left_anti")


def build_search_entries(
    combined: DataFrame, post90: DataFrame, plurals: DataFrame, overrides: DataFrame | None = None
) -> DataFrame:
    """Search records ``old (array), post90, new, implied_plural``.

    ``combined(old, new)``: the full dictionary, unchanged words included.
    ``post90(old, new)``: official respellings. ``plurals``: ``regular_plurals``.
    ``overrides(post90, display)``: display texts for entries with several answers.
    """
    oe = F.replace("old", F.lit("œ"), F.lit("oe"))
    twins = combined.filter(F.contains("old", F.lit("œ"))).select(oe.alias("old"))
    keyed = (
        combined.join(twins, "old", "left_anti")
        .join(post90.select("old", F.col("new").alias("_p")), "old", "left")
        .select(F.coalesce("_p", "old").alias("post90"), "old", "new")
    )
    # All answers of an official spelling come together once, and lists carry them from there on.
    per = keyed.groupBy("post90").agg(F.collect_set(F.struct("new", "old")).alias("xs"))
    others = lambda n: F.filter("xs", lambda x: (x["new"] == n) & (x["old"] != F.col("post90")))
    answers = F.transform(
        F.array_distinct(F.transform("xs", lambda x: x["new"])),
        lambda n: F.struct(n.alias("new"), F.sort_array(F.transform(others(n), lambda x: x["old"])).alias("old")),
    )
    sides = plurals.select(F.col("word").alias("post90"), "side", "other")
    j = per.select("post90", answers.alias("answers")).join(sides, "post90", "left")
    # A word and its plural meet under the singular; any other spelling is alone.
    pair = F.when(F.col("side") == "S", F.col("post90")).when(F.col("side") == "P", F.col("other"))
    paired = j.withColumn("_pair", pair).withColumn("_pair", spread_key("_pair", "post90"))
    pairs = paired.groupBy("_pair").agg(F.collect_list(F.struct("post90", "answers", "side")).alias("rows"))

    def one(side: str) -> Column:
        return F.get(F.filter("rows", lambda r: (r["side"] == side) & (F.size(r["answers"]) == 1)), F.lit(0))["answers"][0]

    add_s = lambda a: F.transform(a, lambda x: F.concat(x, F.lit("s")))
    both = pairs.withColumn("s", one("S")).withColumn("p", one("P"))
    agrees = (F.concat("s.new", F.lit("s")) == F.col("p.new")) & (add_s(F.col("s.old")) == F.col("p.old"))
    out = (
        both.withColumn("agrees", F.coalesce(agrees, F.lit(False)))
        .select("agrees", F.explode("rows").alias("r"))
        .filter(~(F.col("agrees") & (F.col("r.side").eqNullSafe("P"))))
        .select("r.post90", (F.col("agrees") & (F.col("r.side").eqNullSafe("S"))).alias("implied_plural"), F.explode("r.answers").alias("a"))
        .select("a.old", "post90", "a.new", "implied_plural")
    )
    if overrides is not None:
        out = out.join(overrides.select("post90", F.col("display").alias("_d")), "post90", "left").select(
            "old", "post90", F.coalesce("_d", "new").alias("new"), "implied_plural"
        )
    return out


def inconsistent_entries(combined: DataFrame, post90: DataFrame) -> DataFrame:
    """Official spellings with more than one new spelling: the build must not go on."""
    keyed = combined.join(post90.select("old", F.col("new").alias("_p")), "old", "left").select(
        F.coalesce("_p", "old").alias("post90"), "new"
    )
    return (
        keyed.groupBy("post90")
        .agg(F.sort_array(F.collect_set("new")).alias("news"))
        .filter(F.size("news") > 1)
    )


def consistent(combined: DataFrame, post90: DataFrame) -> DataFrame:
    """``post90, new``: the one new spelling of each official one. Reading it fails, naming the word, if there are two."""
    keyed = combined.join(post90.select("old", F.col("new").alias("_p")), "old", "left").select(
        F.coalesce("_p", "old").alias("post90"), "new"
    )
    one = keyed.groupBy("post90").agg(F.min("new").alias("new"), F.max("new").alias("_other"))
    said = F.concat(F.lit("several spellings of "), "post90", F.lit(": "), "new", F.lit(", "), "_other")
    checked = F.when(F.col("new") == F.col("_other"), F.col("new")).otherwise(F.raise_error(said).cast("string"))
    return one.select("post90", checked.alias("new"))


def search_surfaces(old: Column, post90: Column, new: Column, implied_plural: Column) -> Column:
    """Every spelling an entry is found by; folded plurals add their plural forms."""
    base = F.concat(old, F.array(post90, new))
    return F.array_distinct(
        F.when(
            implied_plural, F.concat(base, F.transform(base, lambda x: F.concat(x, F.lit("s"))))
        ).otherwise(base)
    )
