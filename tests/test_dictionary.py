import difflib
import random

import pytest
from pyspark.sql import functions as F

from graphie.operators import dictionary as D
from graphie.operators import lexicon as X
from graphie.operators.dictionary import Dictionary, Metadata
from graphie.sources import dictionary_io as IO
from graphie.sources import lexicon_io as LX
from graphie.streaming.streams import require_repeatable


def as_dict(df):
    return {r.old: r.new for r in df.collect()}


def of(spark, entries):
    return spark.createDataFrame(list(entries.items()), "old string, new string")


@pytest.mark.parametrize(
    "entries, marker, kept",
    [
        ({"a": "a", "as": "as"}, "s", {}),
        ({"a": "b", "as": "bs"}, "s", {"a": "b"}),
        ({"a": "b", "as": "as"}, "s", {"a": "b", "as": ""}),
        ({"a": "b", "as": "bs", "ass": "bss"}, "s", {"a": "b", "ass": "bss"}),
        ({"a": "a", "as": "b"}, "", {"as": "b"}),
        ({"a": "a", "as": "a"}, "", {"as": "a"}),
        ({"a": "a", "b": "c"}, None, {"b": "c"}),
    ],
)
def test_plural_compression(spark, entries, marker, kept):
    assert as_dict(D.simplify_mapping(of(spark, entries), marker)) == kept


def test_merge(spark):
    left = Dictionary(of(spark, {"x": "1", "y": "2"}), Metadata(desc="l", lang="fr", plurals_in_s=None))
    right = Dictionary(of(spark, {"y": "3"}), Metadata(desc="r"))
    m = D.merge_dictionaries(left, right)
    assert as_dict(m.df) == {"x": "1", "y": "3"}
    assert (m.meta.desc, m.meta.lang, m.meta.plurals_in_s) == ("r", "fr", None)
    assert as_dict(D.merge_dictionaries(left, left).df) == as_dict(left.df)


def test_metadata_json():
    for p, j in [("s", True), (None, False), ("+", "+")]:
        m = Metadata(desc="d", plurals_in_s=p)
        assert m.to_json_object()["plurals_in_s"] == j
        assert Metadata.from_json_object(m.to_json_object()) == m
    assert Metadata.from_json_object({"other": 1}) == Metadata()


def test_dictionary_file(spark, tmp_path):
    f = tmp_path / "d.txt"
    f.write_text('{"lang":"fr","plurals_in_s":"+"}\na,b\nc,d\na,e\nstop,\n')
    d = IO.read_dictionary(spark, str(f))
    assert as_dict(d.df) == {"a": "e", "c": "d", "stop": ""} and d.meta.marker() == "+"
    f2 = tmp_path / "e.txt"
    f2.write_text("a,b\nc,d\na,e\n")
    assert as_dict(IO.read_key_values(spark, str(f2))) == {"a": "b", "c": "d"}
    bad = tmp_path / "bad.txt"
    bad.write_text("a,b\nc,d,e\n")
    with pytest.raises(Exception, match="exactly 2 items"):
        IO.read_dictionary(spark, str(bad)).df.collect()


def test_dictionary_file_order(spark, tmp_path):
    df = spark.createDataFrame([("b", "x", 1), ("a", "y", 2), ("c", "c", 0)], "old string, new string, rank int")
    IO.write_dictionary(df, Metadata(lang="fr"), str(tmp_path / "o"))
    parts = lambda d: "".join(p.read_text() for p in sorted((tmp_path / d).glob("part-*")))
    lines = parts("o").splitlines()
    assert lines == ['{"lang":"fr"}', "c,c", "b,x", "a,y"]
    IO.write_dictionary(df, None, str(tmp_path / "p"), all_words=True)
    assert parts("p").splitlines() == ["c,c,=", "b,x,M", "a,y,M"]


def test_lexicon_file(spark, tmp_path):
    f = tmp_path / "l.tsv"
    f.write_text('lemme\tortho\tphon\th_aspire\nm\tun"\tx\tt\nm\tdeux\ty\tf\n')
    rows = LX.read_lexicon(spark, str(f)).orderBy("rank").collect()
    assert [(r.ortho, r.h_aspire) for r in rows] == [('un"', True), ("deux", False)]
    f.write_text("lemme\tortho\tphon\th_aspire\nm\tun\tx\tyes\n")
    with pytest.raises(Exception, match="unknown value of h_aspire"):
        LX.read_lexicon(spark, str(f)).collect()


def test_keyboard_file(spark, tmp_path):
    w = spark.createDataFrame([("", "b", "fr-FR"), ("", "a", "fr-FR")], "shortcut string, new string, lang string")
    IO.write_keyboard_list(w, str(tmp_path / "k"))
    lines = "".join(p.read_text() for p in sorted((tmp_path / "k").glob("part-*"))).split("\n")
    assert lines[1:4] == ["", "\ta\tfr-FR", "\tb\tfr-FR"] and lines[0].startswith("# ")


def test_repeatable(spark):
    require_repeatable(Dictionary.of(spark, {"a": "b", "c": "d"}))
    with pytest.raises(ValueError):
        require_repeatable(Dictionary.of(spark, {"a": "b", "b": "c"}))
    with pytest.raises(ValueError):
        require_repeatable(Dictionary.of(spark, {"a": "b"}, supports_repeated_rewrites=False))


def test_official_spelling_of_unknown_words(spark):
    base = spark.createDataFrame([("post", "n", 5), ("ext", "m", -1)], "old string, new string, rank int")
    p = of(spark, {"pre": "post", "pre2": "ext", "pre3": "other", "pre4": "charriot", "post": "zzz"})
    got = {r.old: (r.new, r.rank) for r in X.add_post90_entries(base, p, True).collect()}
    assert got == {
        "post": ("n", 5), "ext": ("m", -1), "pre": ("n", 5), "pre2": ("m", 100000000), "pre3": ("other", 100000000)
    }
    assert "pre4" in {r.old for r in X.add_post90_entries(base, p, False).collect()}


def test_twins_must_be_new(spark):
    lx = spark.createDataFrame([("coeur", "k9R"), ("chat", "Sa")], "ortho string, phon string")
    assert {r.ortho for r in X.oe_twins(lx).collect()} == {"coeur", "cœur", "chat"}
    with pytest.raises(Exception, match="duplicate word"):
        X.oe_twins(lx.union(spark.createDataFrame([("cœur", "x")], "ortho string, phon string"))).collect()


def test_text_to_number(spark):
    df = spark.createDataFrame([("1.5",), ("",), (None,), ("x",)], "f string")
    assert [r.v for r in df.select(X.real("f").alias("v")).collect()] == [1.5, 0.0, None, 0.0]


def test_phrase_rewrite(spark):
    df = spark.createDataFrame([("ont mangée, a mangés; pas mangée. a  mangés",)], "t string")
    heads = spark.createDataFrame([("ont",), ("a",)], "word string")
    pairs = spark.createDataFrame([("mangée", "mangé"), ("mangés", "mangé")], "var string, invar string")
    assert X.rewrite_after(df, "t", heads, pairs).first().t == "ont mangé, a mangé; pas mangée. a  mangés"


def test_hot_stem_is_a_short_chain(spark):
    n = 2000
    rows = [(f"w{i}", f"x{i}") for i in range(n)] + [(f"w{i}s", f"x{i}s") for i in range(n)]
    df = spark.createDataFrame(rows, "old string, new string")
    assert D.simplify_mapping(df, "s").count() == n
    assert D.simplify_mapping(df.withColumn("rank", F.lit(1)), "s").columns == ["old", "new", "rank"]


def test_exclusion_of_many_words(spark):
    words = spark.range(20_000).select(F.concat(F.lit("mot"), F.col("id").cast("string")).alias("old"), F.lit("x").alias("new"))
    exact = spark.range(10, 15_000).select(F.lit("old").alias("field"), F.concat(F.lit("MOT"), F.col("id").cast("string")).alias("pattern"))
    wild = spark.createDataFrame([("old", "mot1999_"), ("new", "y%"), ("new", None)], "field string, pattern string")
    left = D.exclude(words, exact.unionByName(wild))
    assert left.count() == 10 + 5_000 - 10 and not left.filter("old = 'mot19991' OR old = 'mot10'").count()


def test_rows_without_a_key_are_spread(spark):
    from graphie.functions.plan import spread_key

    rows = spark.createDataFrame([("a", None), ("b", None), ("c", "k")], "w string, k string").select(spread_key("k", "w").alias("key"))
    assert [r.key for r in rows.collect()] == ["\x00a", "\x00b", "k"]


def test_dictionary_files_of_many_parts(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(5000).select(F.concat(F.lit("w"), "id").alias("old"), F.lit("x").alias("new"), (F.col("id") % 7).alias("rank"))
        # a word defined twice: the later line wins, wherever the parts are cut
        IO.write_dictionary(df.unionByName(spark.createDataFrame([("w3", "y", 9)], df.schema)), Metadata(lang="fr"), str(tmp_path / "d"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "d").glob("part-*"))
    lines = "".join(f.read_text() for f in files).splitlines()
    assert len(files) > 1 and files[0].read_text().startswith('{"lang":"fr"}\n') and len(lines) == 5002
    assert lines[1:] == [f"w{i},x" for i in sorted(range(5000), key=lambda i: (i % 7, f"w{i}"))] + ["w3,y"]
    back = IO.read_dictionary(spark, str(tmp_path / "d"))
    assert back.meta.lang == "fr" and back.df.count() == 5000 and back.df.filter("old = 'w3'").first().new == "y"
    assert IO.numbered_lines(spark, str(tmp_path / "d")).filter("line = 'w3,y'").first().line_no == 5002


def test_lookup_functions(spark):
    D.register_lookup(spark, "spelling", spark.createDataFrame([("a", "b"), ("c", "")], "old string, new string"))
    rows = spark.sql("SELECT w, spelling(w) AS n FROM VALUES ('a'), ('c'), ('x'), (NULL) AS t(w)").collect()
    assert {r.w: r.n for r in rows} == {"a": "b", "c": "", "x": None, None: None}
    assert spark.sql("SELECT e.new FROM VALUES ('a'), ('x') AS t(w), LATERAL spelling_entries(w) e").collect()[0].new == "b"


def test_families_are_listed_by_locale(spark):
    rows = [("ete", x, False) for x in ("été", "ète", "ete", "éte", "etè")]
    got = X.spelling_families(spark.createDataFrame(rows, "modern string, old string, touched boolean")).first().olds
    assert got == ["etè", "éte", "été", "ète"]


def test_sequence_ratio_equals_the_standard_matcher(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcé-") for _ in range(rng.randrange(14))) for _ in range(400)]
    pairs = [*zip(words[::2], words[1::2]), ("événement", "évènement"), ("", ""), ("a", ""), ("", "a"), ("oignon", "ognon")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", X.sequence_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert len(got) == len(pairs)
    assert all(r["r"] == difflib.SequenceMatcher(None, r["a"], r["b"]).ratio() for r in got)


def test_participle_pairs_under_several_lemmas(spark):
    """Pairs come once though their words share two lemmas, and no aggregate holds them: finding F3."""
    from graphie.operators.lexicon import participle_pairs

    rows = [("finie", l, "VER", "f", "s", "par:pas") for l in ("fin", "finir", None)] * 2
    rows += [("fini", l, "VER", "m", "s", "par:pas") for l in ("fin", "finir", "x")]
    rows += [("finis", "x", "VER", "m", "p", "par:pas"), (None, "x", "VER", "", "", "par:pas"), ("bu", "fin", "NOM", "m", "s", "par:pas")]
    lx = spark.createDataFrame(rows, "ortho string, lemme string, cgram string, genre string, nombre string, infover string")
    pairs = participle_pairs(lx)
    assert sorted(map(tuple, pairs.collect()), key=str) == [("finie", "fini"), ("finis", "fini"), ("finis", None)]
    top = pairs._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "Aggregate" not in top


def test_least_participle_pairs_do_not_multiply(spark):
    """The least pair of each word, without the pairs of all words of a lemma: finding F9."""
    from graphie.operators.lexicon import participle_pairs

    rows = [("finie", l, "VER", "f", "s", "par:pas") for l in ("fin", "finir", None)] * 2 + [(None, "fin", "VER", "f", "s", "par:pas")]
    rows += [(w, l, "VER", "m", "s", "par:pas") for w in ("fini", "fina", None) for l in ("fin", "finir", "x")]
    rows += [("finis", "x", "VER", "m", "p", "par:pas"), (None, "y", "VER", "", "", "par:pas"), ("vue", "y", "VER", "f", "s", "par:pas")]
    many = [(f"{i}{e}", "many", "VER", g, "s", "par:pas") for i in range(300) for e, g in (("e", "f"), ("", "m"))]
    lx = spark.createDataFrame(rows + many, "ortho string, lemme string, cgram string, genre string, nombre string, infover string")
    least = participle_pairs(lx, least=True)
    every = participle_pairs(lx).groupBy("var").agg(F.min("invar").alias("invar"))
    assert sorted(map(tuple, least.collect()), key=str) == sorted(map(tuple, every.collect()), key=str)
    both = least._jdf.queryExecution().optimizedPlan().toString().split("Join")[1]
    assert "Aggregate" in both  # one word of each lemma goes into the join
