"""Lexicon ETL: cleaning, flag propagation, reconciliation of word sources.

Lexicons and spelling tables are keyed by word. Joins here are equi-joins that
Catalyst broadcasts or shuffles by size; the few pattern lists are configuration and
become predicates on the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphie.operators.dictionary import first_wins, like_ascii
from graphie.sources.files import stored


def real(col: str | Column) -> Column:
    """Text to number as the source scripts do: anything unreadable is 0, null stays."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.isNotNull(), F.coalesce(c.try_cast("double"), F.lit(0.0)))


# Characters cut from (ortho and lemma, phonetics) per locution prefix,
# tried in this order, each on the result of the one before.
LOCUTIONS = [("à la ", "ala", 5, 3), ("à l'", "al", 4, 2), ("à ", "a", 2, 1)]


def strip_locutions(df: DataFrame) -> DataFrame:
    """'à la X' becomes 'X' in spelling, lemma and sound together."""
    for prefix, sound, n, m in LOCUTIONS:
        hit = like_ascii(F.col("ortho"), prefix + "%") & like_ascii(F.col("phon"), sound + "%")
        hit = F.coalesce(hit, F.lit(False))
        df = df.withColumns(
            {
                "ortho": F.when(hit, F.substr("ortho", F.lit(n + 1))).otherwise(F.col("ortho")),
                "lemme": F.when(hit, F.substr("lemme", F.lit(n + 1))).otherwise(F.col("lemme")),
                "phon": F.when(hit, F.substr("phon", F.lit(m + 1))).otherwise(F.col("phon")),
            }
        )
    return df


def override_from(df: DataFrame, other: DataFrame, key: str, col: str, order: str | None = None) -> DataFrame:
    """Replace ``col`` by the value ``other`` has for the same key, if it has one."""
    if order is None:
        o = other.groupBy(key).agg(F.max(col).alias("_v"))
    else:
        o = first_wins(other, key, order, col).select(key, F.col(col).alias("_v"))
    cols = df.columns
    return (
        df.join(o, key, "left")
        .withColumn(col, F.coalesce("_v", col))
        .select(*cols)
    )


def insert_if_absent(df: DataFrame, extra: DataFrame, **constants) -> DataFrame:
    """Add rows of words the table lacks. An empty lemma means the word itself;
    rows starting with # are comments."""
    new = extra.filter(~F.startswith("ortho", F.lit("#"))).join(df.select("ortho").distinct(), "ortho", "left_anti")
    new = new.withColumn("lemme", F.coalesce(F.nullif("lemme", F.lit("")), "ortho"))
    for name, value in constants.items():
        new = new.withColumn(name, F.lit(value))
    return df.unionByName(new, allowMissingColumns=True)


def propagate_flag(flags: DataFrame, variants: DataFrame, word: str, flag: str, old: str, new: str) -> DataFrame:
    """A spelling variant that has no flag takes that of the spelling it maps to."""
    v = variants.select(F.col(old).alias("_o"), F.col(new).alias(word))
    gained = v.join(flags.select(word, flag), word).select(F.col("_o").alias(word), flag)
    gained = gained.join(flags.select(word).distinct(), word, "left_anti")
    return flags.select(word, flag).unionByName(gained)


# Beginnings that decide whether an initial h blocks elision.
H_BLOCKS = ["hai", "haï", "hach", "handicap", "hargn", "hant", "hât", "harna", "hiérarc", "harass", "hêtrai", "hideu", "hockey", "hulul"]
H_MUTE = ["hiéro", "hypo", "hyper", "hystér", "hémo", "halog", "homo", "humani", "humano", "héli", "herpé"]
H_MUTE_EXACT = ["hérédo"]


def classify_h(df: DataFrame, flags: DataFrame) -> DataFrame:
    """Add ``h_aspire`` ('t'/'f'): by beginning, else by the flag of the lemma, else by
    that of the word, else yes."""
    by_word = flags.select(F.col("word").alias("ortho"), F.col("h_aspire").alias("_w"))
    by_lemma = flags.select(F.col("word").alias("lemme"), F.col("h_aspire").alias("_l"))
    j = df.join(by_word, "ortho", "left").join(by_lemma, "lemme", "left")

    def starts(prefixes: list[str]) -> Column:
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | like_ascii(F.col("ortho"), p + "%")
        return hit

    flag = (
        F.when(~like_ascii(F.col("ortho"), "h%"), "f")
        .when(starts(H_BLOCKS), "t")
        .when(starts(H_MUTE) | F.col("ortho").isin(H_MUTE_EXACT), "f")
        .when(F.coalesce("_l", "_w", F.lit("true")) == "true", "t")
        .otherwise("f")
    )
    return j.select(*df.columns, flag.alias("h_aspire"))


def usable_rows(df: DataFrame) -> DataFrame:
    """Drop spellings the alignment cannot read."""
    return df.filter(~F.col("ortho").rlike("[ .ñã]"))


def by_frequency(df: DataFrame, freq: str) -> DataFrame:
    """Most frequent first; words break ties."""
    return df.orderBy(real(freq).desc_nulls_last(), "ortho")


def numbered(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Number rows from 1 in a total order, without one task seeing all of them.

    Rows are range-partitioned, numbered within their partition, and shifted by the
    sizes of the partitions before. The partitioned table is written first: sampling
    could place the borders elsewhere if it were computed twice.
    """
    parts = stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: a bounded, small table.
    before = sizes.withColumn(
        "_shift", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ).select("_part", "_shift")
    within = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return (
        parts.withColumn("_k", within)
        .join(F.broadcast(before), "_part")
        .withColumn(name, (F.col("_k") + F.col("_shift")).cast("bigint"))
        .drop("_part", "_k", "_shift")
    )


# --- reconciling spelling tables -------------------------------------------------


def select_new(ortho: Column, kind: Column, post90: Column) -> Column:
    """Type 1 gives the spelling; type 2 gives 'singular/plural', chosen by ending."""
    slash = F.instr(post90, "/")
    plural = F.substr(post90, slash + 1)
    singular = F.substr(post90, F.lit(1), F.greatest(slash - 1, F.lit(0)))
    ends = like_ascii(ortho, "%s") | like_ascii(ortho, "%x")
    return F.when(kind == 1, post90).when(ends, plural).otherwise(singular)


def reconcile(primary: DataFrame, secondary: DataFrame, never: list[str] = []) -> DataFrame:
    """Merge ``primary(ortho, type, post90)`` with ``secondary(old, new)``.

    Primary rows stay if the other side does not know the word or agrees; words only
    the secondary knows are added when lower case; disagreements go.
    """
    p = primary.withColumn("suggested", select_new(F.col("ortho"), F.col("type"), F.col("post90")))
    s = secondary.select(F.col("old").alias("ortho"), F.col("new").alias("_s"))
    slash = F.instr("post90", "/")
    agree = F.when(F.col("type") == 1, F.col("post90") == F.col("_s")).otherwise(
        (F.substr("post90", slash + 1) == F.col("_s"))
        | (F.substr("post90", F.lit(1), F.greatest(slash - 1, F.lit(0))) == F.col("_s"))
    )
    first = (
        p.join(s, "ortho", "left")
        .filter(F.col("_s").isNull() | agree)
        .filter(F.col("suggested") != F.col("ortho"))
        .filter(~F.col("ortho").isin(never) if never else F.lit(True))
        .select(F.col("ortho").alias("old"), F.col("suggested").alias("new"))
        .distinct()
    )
    second = (
        secondary.join(primary.select(F.col("ortho").alias("old")), "old", "left_anti")
        .filter((F.col("old") != F.col("new")) & (F.col("old") == F.lower("old")))
        .select("old", "new")
        .distinct()
    )
    return first.unionByName(second)


# --- tagged word dumps -----------------------------------------------------------

SALTS = 16
# Fixed values.
RECTIFIED_TAG = "orthographe rectifiée de 1990"
TRADITIONAL_TAG = "orthographe traditionnelle"
H_TAG = "h aspir"
_UNWANTED = r'[-0-9.+()&/ ,"]'
_NO_RESPELLING = {"lieder": "lieds"}


def tag_definitions(dump: DataFrame) -> DataFrame:
    """``line_no, word, ipa, rect, trad, h_aspire, tagged`` from a dump of definitions
    ``(line_no, word, tags, sounds)``."""
    from_sounds = F.filter(
        "sounds",
        lambda s: F.coalesce(
            F.exists(
                s["tags"],
                lambda t: F.contains(t, F.lit(RECTIFIED_TAG)) | F.contains(t, F.lit(TRADITIONAL_TAG)),
            ),
            F.lit(False),
        ),
    )
    # A tag list found under a sound is compared as a whole list, so only its exact
    # entries count there.
    own = F.coalesce("tags", F.array().cast("array<string>"))

    def has(tag: str) -> Column:
        return F.exists(own, lambda t: F.contains(t, F.lit(tag)))

    def exact(tag: str) -> Column:
        return F.coalesce(
            F.exists(from_sounds, lambda s: F.array_contains(s["tags"], tag)), F.lit(False)
        )

    ipa = F.get(F.col("sounds"), F.lit(0))["ipa"]
    tagged = F.col("tags").isNotNull() | F.coalesce(F.size(from_sounds) > 0, F.lit(False))
    return dump.filter(
        F.col("word").isNotNull() & ~F.col("word").rlike(_UNWANTED) & ipa.isNotNull()
    ).select(
        "line_no",
        "word",
        ipa.alias("ipa"),
        (has(RECTIFIED_TAG) | exact(RECTIFIED_TAG)).alias("rect"),
        (has(TRADITIONAL_TAG) | exact(TRADITIONAL_TAG)).alias("trad"),
        (has(H_TAG) | exact(H_TAG)).alias("h_aspire"),
        tagged.alias("tagged"),
    )


def first_pronunciations(tagged: DataFrame) -> DataFrame:
    """``word, ipa, h_aspire`` of the first definition of each word."""
    b = F.min_by(F.struct("ipa", "h_aspire"), "line_no").alias("b")
    return tagged.groupBy("word").agg(b).select("word", "b.ipa", "b.h_aspire")


def _cuts(text: Column) -> Column:
    """All substrings of a text as length and place, the longest first, then from left to right."""
    def of_length(n):
        return F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.struct(n.alias("n"), i.alias("i")))

    return F.flatten(F.transform(F.sequence(F.length(text), F.lit(1), F.lit(-1)), of_length))


def sequence_ratio(a: Column, b: Column) -> Column:
    """Share of the letters of two words in common blocks: the longest block first (the leftmost of equal ones),
    then the same on either side of it. 1 for two empty words."""
    pair = "array<struct<a:string,b:string>>"

    def step(acc, _):
        def cut(p):
            return F.struct(p.alias("p"), F.get(F.filter(_cuts(p.a), lambda c: F.contains(p.b, F.substr(p.a, c.i, c.n))), F.lit(0)).alias("c"))

        def beside(x):
            at = F.position(F.substr(x.p.a, x.c.i, x.c.n), x.p.b)
            left = F.struct(F.substr(x.p.a, F.lit(1), x.c.i - 1).alias("a"), F.substr(x.p.b, F.lit(1), at - 1).alias("b"))
            right = F.struct(F.substr(x.p.a, x.c.i + x.c.n).alias("a"), F.substr(x.p.b, at + x.c.n).alias("b"))
            sides = F.filter(F.array(left, right), lambda s: (s.a != "") & (s.b != ""))
            return F.when(x.c.isNull(), F.array().cast(pair)).otherwise(sides)

        # every open pair of one depth is cut in one step
        cuts = F.transform(acc.open, cut)
        return F.transform(
            F.array(cuts),
            lambda c: F.struct(
                F.aggregate(c, acc.n, lambda n, x: n + F.coalesce(x.c.n, F.lit(0))).alias("n"),
                F.flatten(F.transform(c, beside)).alias("open"),
            ),
        )[0]

    start = F.struct(F.lit(0).alias("n"), F.filter(F.array(F.struct(a.alias("a"), b.alias("b"))), lambda s: (s.a != "") & (s.b != "")).alias("open"))
    depths = F.sequence(F.lit(0), F.least(F.length(a), F.length(b)))
    found = F.aggregate(depths, start, lambda acc, i: F.when(F.size(acc.open) == 0, acc).otherwise(step(acc, i)), lambda acc: acc.n)
    return F.when(F.length(a) + F.length(b) == 0, 1.0).otherwise(2.0 * found / (F.length(a) + F.length(b)))


def edit_ratio(a: Column, b: Column) -> Column:
    """JVM-side closeness: 1 - edit distance / longest length."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


def match_by_sound(tagged: DataFrame, exact_ratio: bool = True) -> DataFrame:
    """``old, new``: traditional spellings with the closest rectified spelling that
    sounds the same and has the same ending in s or x.

    A word counts as traditional only if its first tagged definition says so; any
    definition can make it a rectified one. Pairs only form within one sound. A sound
    that very many words share is split over tasks by the traditional word, and the best
    match is kept before anything is shuffled again.
    """
    def keyed(df, name):
        return df.select(
            F.col("word").alias(name),
            "ipa",
            F.endswith("word", F.lit("s")).alias("ends_s"),
            F.endswith("word", F.lit("x")).alias("ends_x"),
        )

    with_tags = tagged.filter("tagged")
    firsts = (
        with_tags.groupBy("word")
        .agg(F.min_by(F.struct("ipa", "trad"), "line_no").alias("b"))
        .select("word", "b.ipa", "b.trad")
        .filter("trad")
    )
    old = keyed(firsts, "old")
    new = keyed(tagged.filter(F.col("rect") & ~F.col("trad")), "new").distinct()
    keys = ["ipa", "ends_s", "ends_x"]
    spread = new.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pairs = old.withColumn("_salt", F.pmod(F.hash("old"), F.lit(SALTS))).join(spread, [*keys, "_salt"])
    ratio = sequence_ratio(F.col("old"), F.col("new")) if exact_ratio else edit_ratio(F.col("old"), F.col("new"))
    # The smallest word breaks ties of closeness.
    scored = pairs.withColumn("r", ratio)
    best = scored.groupBy("old").agg(
        F.min_by("new", F.struct(-F.col("r"), F.col("new"))).alias("new")
    )
    special = F.col("new")
    for word, respelling in _NO_RESPELLING.items():
        special = F.when(F.col("old") == word, respelling).otherwise(special)
    best = best.withColumn("new", special)
    y_to_ie = F.endswith("old", F.lit("y")) & (
        F.col("new") == F.concat(F.substr("old", F.lit(1), F.length("old") - 1), F.lit("ie"))
    )
    return best.filter(~y_to_ie)


# --- post-1990 spellings ---------------------------------------------------------

# Respelled words whose sound changes too.
POST90_SOUNDS = {
    "addenda": "ad5da", "caméramans": "kameRaman", "graffiti": "gRafiti", "maximums": "maksimOm",
    "minimums": "minimOm", "scénarios": "senaRjo", "solos": "solo", "stimulus": "stimylys", "tumulus": "tymylys",
}


def post90ify(lexicon: DataFrame, post90: DataFrame) -> DataFrame:
    """Add ``_post``: the official spelling of ``ortho`` or null."""
    return lexicon.join(post90.select(F.col("old").alias("ortho"), F.col("new").alias("_post")), "ortho", "left")


def _post_phon() -> Column:
    p = F.col("phon")
    for word, sound in POST90_SOUNDS.items():
        p = F.when(F.col("_post") == word, sound).otherwise(p)
    return p


def build_lexicon_post90(lexicon: DataFrame, post90: DataFrame, replace: bool) -> DataFrame:
    """Lexicon with official spellings: instead of the old ones, or next to them."""
    cols = lexicon.columns
    j = post90ify(lexicon, post90)
    # Sub-rank keeps the old spelling before the new one.
    if replace:
        return j.withColumn("phon", _post_phon()).withColumn("ortho", F.coalesce("_post", "ortho")).select(*cols)
    old = F.struct(F.lit(0).alias("sub"), F.col("ortho"), F.col("phon"))
    new = F.struct(F.lit(1).alias("sub"), F.col("_post").alias("ortho"), _post_phon().alias("phon"))
    rows = F.when(F.col("_post").isNull(), F.array(old)).otherwise(F.array(old, new))
    j = j.withColumn("x", F.explode(rows)).withColumns({"ortho": F.col("x.ortho"), "phon": F.col("x.phon")})
    return j.select(*cols)


LATE_RANK = 100_000_000

# Official changes the flagship rules do not take over.
UNDESIRABLE = r"^(?:charr|combatt|hindou)|^reboursouffler$"


def is_undesirable(post90: Column) -> Column:
    return post90.rlike(UNDESIRABLE)


def add_post90_entries(base: DataFrame, post90: DataFrame, flagship: bool) -> DataFrame:
    """Add entries for old spellings that ``base(old, new, rank)`` does not know."""
    unknown = post90.select("old", F.col("new").alias("post")).join(base.select("old"), "old", "left_anti")
    known_post = base.select(F.col("old").alias("post"), F.col("new").alias("_n"), F.col("rank").alias("_r"))
    j = unknown.join(known_post, "post", "left")
    drop = F.col("_n").isNull() & is_undesirable(F.col("post")) if flagship else F.lit(False)
    late = F.lit(LATE_RANK).cast("bigint")
    added = j.filter(~drop).select(
        "old",
        F.coalesce("_n", "post").alias("new"),
        F.when(F.col("_r") >= 0, F.col("_r").cast("bigint")).otherwise(late).alias("rank"),
    )
    return base.select("old", "new", F.col("rank").cast("bigint").alias("rank")).unionByName(added)


def oe_twins(lexicon: DataFrame) -> DataFrame:
    """Lexicon rows plus their twin with œ for every oe. A twin that already exists is
    an error."""
    twins = lexicon.filter(F.contains("ortho", F.lit("oe"))).withColumn(
        "ortho", F.replace("ortho", F.lit("oe"), F.lit("œ"))
    )
    clash = twins.join(lexicon.select("ortho", F.lit(True).alias("_dup")).distinct(), "ortho", "left")
    checked = clash.filter(
        F.when(F.col("_dup"), F.raise_error(F.concat(F.lit("duplicate word "), "ortho")).cast("boolean")).otherwise(True)
    ).select(*lexicon.columns)
    return lexicon.unionByName(checked)


# --- reports ---------------------------------------------------------------------


def multimap(df: DataFrame, key: str, value: str) -> DataFrame:
    """``key, values``: distinct values, sorted."""
    return df.groupBy(key).agg(F.sort_array(F.collect_set(value)).alias("values"))


def multi_valued(df: DataFrame, key: str = "old", value: str = "new") -> DataFrame:
    """Keys with more than one value, values joined by a comma."""
    return (
        multimap(df, key, value)
        .filter(F.size("values") > 1)
        .select(key, F.array_join("values", ",").alias("news"), F.size("values").alias("n"))
    )


def participle_pairs(lexicon: DataFrame, *, least: bool = False) -> DataFrame:
    """``var, invar``: inflected past participles with the masculine singular of their lemma.

    With ``least``, of the pairs of each ``var`` the one of the least ``invar`` only: taken for each lemma
    before the words meet, so that their number does not grow with the square of the words of a lemma.
    """
    v = lexicon.filter(like_ascii(F.col("cgram"), "%VER%") & like_ascii(F.col("infover"), "%par:pas%"))
    var = v.filter((F.col("genre") == "f") | (F.col("nombre") == "p"))
    invar = v.filter(F.col("genre").isin("m", "") & F.col("nombre").isin("s", ""))
    if least:
        of_lemma = invar.groupBy("lemme").agg(F.min("ortho").alias("invar"))
        met = var.select("lemme", F.col("ortho").alias("var")).join(of_lemma, "lemme")
        return met.groupBy("var").agg(F.min("invar").alias("invar"))

    def words(df: DataFrame, name: str, lemmas: str) -> DataFrame:
        one = df.groupBy(F.col("ortho").alias(name)).agg(F.collect_set("lemme").alias(lemmas))
        return one.select(F.explode(lemmas).alias("lemme"), name, F.when(F.size(lemmas) > 1, F.col(lemmas)).alias(lemmas))

    # Words that share several lemmas meet at the first of them only, so pairs, of which there can be far more
    # than words, come out once without being held anywhere.
    first = F.array_min(F.array_intersect("_a", "_b"))
    met = words(var, "var", "_a").join(words(invar, "invar", "_b"), "lemme")
    return met.filter(F.coalesce(first == F.col("lemme"), F.lit(True))).select("var", "invar")


def rewrite_after(
    df: DataFrame, text_col: str, heads: DataFrame, pairs: DataFrame, *, out_col: str | None = None,
    key: str | list[str] | None = None, max_rows: int | None = None,
) -> DataFrame:
    """Rewrite ``head variable`` to ``head invariable`` where the two words are separated by one space.

    Word lists of checked size are sent along and the work is done where a text is read. A list over the
    bound (``max_rows``) reaches the rows, told apart by ``key``, by a join with their words.
    """
    from graphie.functions import text as T
    from graphie.functions.plan import computed_once
    from graphie.operators.lookup import RowLookup, constant_lookup, row_lookup, with_lookups

    out_col = out_col or text_col
    bound = {} if max_rows is None else {"max_rows": max_rows}
    keep = [c for c in df.columns if c != out_col]
    pattern = r"[\p{L}\p{N}_]+"
    step = df.withColumn("_w", T.words(text_col, pattern)).withColumn("_s", T.separators(text_col, pattern))

    heads = heads.select("word", F.lit(True).alias("v")).distinct()
    pairs = pairs.groupBy("var").agg(F.min("invar").alias("invar"))
    head, pair = constant_lookup(heads, "word", "v", **bound), constant_lookup(pairs, "var", "invar", **bound)
    if head is None or pair is None:
        if key is None:
            raise ValueError("the word list is too large to send to every task; pass key=")
        keys = [key] if isinstance(key, str) else list(key)
    if head is None and pair is None:
        # The rows meet both lists at once, and each list is a map of its own again.
        both = heads.withColumnRenamed("word", "var").join(pairs, "var", "full")
        step, either = row_lookup(step, keys, F.col("_w"), both, "var", ["v", "invar"], "_either")
        own = {"_heads": F.map_filter("_either", lambda _, e: e["v"].isNotNull()), "_pairs": F.map_filter("_either", lambda _, e: e["invar"].isNotNull())}
        step = step.withColumns({c: computed_once(x) for c, x in own.items()})
        head, pair = (RowLookup(c, either.head) for c in own)
        of_head, of_pair = (lambda find: lambda w: find(w)["v"]), (lambda find: lambda w: find(w)["invar"])
    else:
        if head is None:
            step, head = row_lookup(step, keys, F.col("_w"), heads, "word", "v", "_heads")
        if pair is None:
            step, pair = row_lookup(step, keys, F.col("_w"), pairs, "var", "invar", "_pairs")
        of_head = of_pair = lambda find: find

    def swap(w: Column, i: Column, head, pair) -> Column:
        before = F.get(F.col("_w"), F.greatest(i - 1, F.lit(0)))
        follows = (i > 0) & (F.get(F.col("_s"), i) == " ") & F.coalesce(head(before), F.lit(False))
        return F.when(follows, F.coalesce(pair(w), w)).otherwise(w)

    step = with_lookups(
        step, [head, pair], "_n", lambda h, p: F.transform("_w", lambda w, i: swap(w, i, of_head(h), of_pair(p)))
    )
    return step.select(*keep, T.weave("_s", "_n").alias(out_col))


def provenance(sources: dict[str, DataFrame], pattern: str) -> DataFrame:
    """Where a word comes from: ``source, word, detail`` of rows whose word matches the
    whole pattern."""
    parts = []
    for name, df in sources.items():
        first, *rest = df.columns
        detail = F.concat_ws(",", *[F.col(c).cast("string") for c in rest]) if rest else F.lit("")
        parts.append(
            df.filter(F.col(first).rlike(f"^(?:{pattern})$")).select(
                F.lit(name).alias("source"), F.col(first).alias("word"), detail.alias("detail")
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def teaching_words(lexicon: DataFrame, patterns: list[tuple[str, str | None]]) -> DataFrame:
    """Words with at least one of the spelling patterns (and sound pattern, if given)."""
    hit = F.lit(False)
    for ortho, phon in patterns:
        one = like_ascii(F.col("ortho"), ortho)
        if phon is not None:
            one = one & like_ascii(F.col("phon"), phon)
        hit = hit | one
    return lexicon.filter(F.coalesce(hit, F.lit(False)))


def spelling_families(df: DataFrame, locale: str = "fr") -> DataFrame:
    """``modern, olds, touched`` from rows ``(modern, old, touched)``; old spellings as a dictionary of the locale lists them."""
    others = F.array_except(F.collect_set("old"), F.array(F.first("modern")))
    listed = F.array_sort(F.transform(others, lambda x: F.collate(x, locale)))
    return df.groupBy("modern").agg(F.transform(listed, lambda x: x.cast("string")).alias("olds"), F.max("touched").alias("touched"))


def keyboard_list(lexicon: DataFrame, d: DataFrame, k: int = 1000, lang: str = "fr-FR") -> DataFrame:
    """The new spellings of the k first lexicon words that have one, sorted."""
    top = (
        lexicon.join(d, lexicon["ortho"] == d["old"])
        .groupBy("new")
        .agg(F.min("rank").alias("rank"))
        .orderBy("rank", "new")
        .limit(k)
    )
    return top.select(F.lit("").alias("shortcut"), "new", F.lit(lang).alias("lang")).orderBy("new")


def keyboard_shortcuts(d: DataFrame) -> DataFrame:
    """Two lines per entry: the old word, not to be suggested, and its replacement."""
    lines = F.array(
        F.concat(F.lit(" word="), "old", F.lit(",f=1,not_a_word=true")),
        F.concat(F.lit("  shortcut="), "new", F.lit(",f=14")),
    )
    return d.filter("new <> ''").select("old", F.posexplode(lines).alias("line_no", "line"))
