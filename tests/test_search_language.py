import pytest
from pyspark.sql import functions as F

from graphie.operators import language as L
from graphie.operators import search as S


def found(spark, entries, *queries, limit=10):
    rows = [(f"{a}/{b}", a, b) for a, b in entries]
    e = spark.createDataFrame(rows, "id string, a string, b string")
    ix = S.build_index(e, F.array("a", "b"), "id")
    q = spark.createDataFrame([(x,) for x in queries], "query string")
    out = {x: [] for x in queries}
    for r in S.search(q, "query", ix, limit=limit).orderBy("query", "rank").collect():
        out[r.query].append(r.entry_id.split("/")[0])
    return out


ENTRIES = [
    ("chœur", "keur"), ("met", "met"), ("méta", "méta"), ("mette", "mète"), ("mets", "mets"), ("métal", "métal"),
    ("météo", "météo"), ("mettes", "mètes"), ("mettez", "métez"), ("métis", "métis"), ("métra", "métra"),
]


def test_golden_search(spark):
    got = found(spark, ENTRIES, "met", "mét", "mèt", "choe", "cho", "chœ", "k", "zz")
    assert got["met"] == ["met", "méta", "mette", "mets", "métal", "météo", "mettes", "mettez", "métis", "métra"]
    assert got["mét"] == ["méta", "métal", "météo", "mettez", "métis", "métra"]
    assert got["mèt"] == ["mette", "mettes"]
    assert got["choe"] == got["cho"] == got["chœ"] == got["k"] == ["chœur"]
    assert got["zz"] == []


def test_limit_and_special_characters(spark):
    got = found(spark, [("a.b", "a.b"), ("axb", "axb"), ("a(b", "a(b")], "a.", "a(", "a", limit=2)
    assert got["a."] == ["a.b"] and got["a("] == ["a(b"] and len(got["a"]) == 2


def test_query_hygiene(spark):
    df = spark.createDataFrame([("  Chat ",), ("chat  ",), ("",), ("x" * 51,)], "q string")
    assert [r.c for r in df.select(S.clean_query("q").alias("c")).collect()] == ["chat", "chat ", None, "x" * 51]


def test_popular_query_and_hot_prefix(spark):
    entries = [(f"abc{i:04d}", f"abc{i:04d}") for i in range(3000)]
    got = found(spark, entries, "abc", *["abc"] * 50)
    assert got["abc"] == [f"abc{i:04d}" for i in range(10)]


def test_folded_plurals(spark):
    lx = spark.createDataFrame(
        [("chat", "Sa", "chat"), ("chats", "Sa", "chat"), ("os", "os", "os"), ("oss", "o", "os")], "ortho string, phon string, lemme string"
    )
    p = S.regular_plurals(lx)
    assert {(r.word, r.side, r.other) for r in p.collect()} == {("chat", "S", "chats"), ("chats", "P", "chat")}
    comb = spark.createDataFrame([("chat", "xat"), ("chats", "xats"), ("coeur", "keur"), ("cœur", "keur")], "old string, new string")
    none = comb.limit(0)
    e = {r.post90: (r.new, r.implied_plural, r.old) for r in S.build_search_entries(comb, none, p).collect()}
    assert e == {"chat": ("xat", True, []), "cœur": ("keur", False, [])}


def test_density(spark):
    df = spark.createDataFrame([(1, "é" + "x" * 150), (2, "é" + "x" * 400), (3, "")], "i int, t string")
    got = [r.f for r in df.select("i", L.looks_french("t").alias("f")).orderBy("i").collect()]
    assert got == [True, False, None]


def test_gate_order(spark):
    df = spark.createDataFrame([("ééé", "en", None), ("ééé", "", None), ("xxx", "fr-CA", None), ("xxx", "fr", 10), ("", "fr", 90)], "t string, l string, s int")
    g = L.plausibly_lang("t", "fr", html_lang=F.col("l"), detected_share=F.col("s"))
    assert [r.g for r in df.select(g.alias("g")).collect()] == [False, True, True, False, None]


def test_unknown_digrams_and_host_bonus(spark):
    counts = spark.createDataFrame([("fr", "es", 3), ("fr", "le", 1), ("en", "th", 1), ("en", "he", 1)], "lang string, digram string, n long")
    m = L.fit_digram_model(counts)
    df = spark.createDataFrame([("es",), ("the",), ("zz",), ("",)], "t string")
    rows = L.language_score(df, "t", m).collect()
    assert [r.is_foreign for r in rows] == [False, True, False, False]
    assert abs(rows[0].score_fr - 0.4150375) < 1e-6 and rows[0].score_en == 30.0
    u = spark.createDataFrame([("http://a.fr/x",), ("http://a.fr.com/",), ("bad",)], "u string")
    assert [r.b for r in u.select(L.base_entropy("u").alias("b")).collect()] == [10.0, 0.0, 0.0]


def test_joined_model_gives_the_same_scores(spark, monkeypatch):
    counts = spark.createDataFrame([("fr", "es", 3), ("fr", "le", 1), ("en", "th", 1), ("en", "he", 1)], "lang string, digram string, n long")
    m = L.fit_digram_model(counts)
    df = spark.createDataFrame([(1, "es the les"), (2, "thé")], "i int, t string")
    a = {r.i: (r.score_fr, r.score_en) for r in L.language_score(df, "t", m).collect()}
    monkeypatch.setattr(L, "constant_lookup", lambda *x, **k: None)
    b = {r.i: (r.score_fr, r.score_en) for r in L.language_score(df, "t", m, key="i").collect()}
    assert {k: tuple(round(x, 6) for x in v) for k, v in a.items()} == {k: tuple(round(x, 6) for x in v) for k, v in b.items()}


def test_two_spellings_of_a_word_stop_the_build(spark):
    post = spark.createDataFrame([("arrêt", "arret")], "old string, new string")
    good = spark.createDataFrame([("arrêt", "aret"), ("arret", "aret"), ("mot", "mo")], "old string, new string")
    assert {tuple(r) for r in S.consistent(good, post).collect()} == {("arret", "aret"), ("mot", "mo")}
    bad = good.unionByName(spark.createDataFrame([("arret", "arrè")], "old string, new string"))
    with pytest.raises(Exception, match="several spellings of arret: aret, arrè"):
        S.consistent(bad, post).collect()


def test_search_goes_on_for_entries_of_many_spellings(spark, monkeypatch):
    monkeypatch.setattr(S, "SPELLINGS", 1)
    entries = spark.createDataFrame([(f"e{i}", ["a" + "b" * (i + k) for k in range(30)]) for i in range(6)] + [("x", ["à", "aé"]), ("y", ["b"])], "id string, forms array<string>")
    ix = S.build_index(entries, F.col("forms"), "id")
    queries = spark.createDataFrame([("a",), ("ab",), ("aé",), ("b",), ("zz",), (None,)], "q string")
    got = sorted(tuple(r) for r in S.search(queries, "q", ix, limit=4).collect())
    rows = [(r.len, r.key, r.surface, r.entry_id) for r in ix.collect()]
    want = []
    for q, ok in (("a", lambda s: s[0] in "aà"), ("ab", lambda s: s.startswith("ab")), ("aé", lambda s: s == "aé"), ("b", lambda s: s == "b")):
        seen = {}
        for _, _, s, e in sorted(r for r in rows if ok(r[2])):
            seen.setdefault(e, s)
        want += [(q, i + 1, e, s) for i, (e, s) in enumerate(list(seen.items())[:4])]
    assert got == sorted(want)


def test_digram_sums_are_those_of_the_digrams(spark, monkeypatch):
    monkeypatch.setattr(L, "PIECE", 12)  # several pieces in a batch
    texts = ["L'été d'A😀b😀😀", "x", None, "", "😀", "😀a ab\nab", "ab ba İI ΑΣ", "?a?b", "ab" * 20]
    df = spark.createDataFrame([(i, "fr" if i % 2 else "en", t) for i, t in enumerate(texts)], "k int, lang string, t string")
    model = L.fit_digram_model(L.digram_counts(df.filter("k < 7"), "t", "lang"), L.OVERRIDES)
    known = {r.digram: (r.e1, r.e2) for r in L._paired(model, "fr", "en").collect()}
    got = {r.k: (r.score_fr, r.score_en) for r in L.language_score(df, "t", model).collect()}
    for k, found in df.select("k", L.digrams("t")).collect():
        sums = [0.0, 0.0]
        for d in found or []:
            sums = [a + b for a, b in zip(sums, known.get(d, (L.UNKNOWN_DIGRAM, L.UNKNOWN_DIGRAM)))]
        assert got[k] == tuple(sums)
    assert {tuple(r)[1:3] for r in L.language_score(df, "t", model.limit(0)).filter("k = 1").collect()} == {("fr", "x")}


def test_digrams_of_a_model_are_counted_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def watched(t):
        seen.add(1)
        return t

    df = spark.createDataFrame([("fr", "abc"), ("en", "abd")], "lang string, t string")
    model = L.fit_digram_model(L.digram_counts(df.withColumn("t", watched("t")), "t", "lang"), L.OVERRIDES)
    assert model.count() == 8 and seen.value == 2
