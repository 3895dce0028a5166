import pytest
from pyspark.sql import functions as F

from graphie.functions import text as T
from graphie.operators import language as L
from graphie.operators import lexicon as X
from graphie.operators import lookup
from graphie.operators import respell as R
from graphie.operators.dictionary import Dictionary


def run(spark, entries, texts, **kw):
    kw.setdefault("marker", "s")
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    out = R.respell(df, "text", Dictionary.of(spark, entries), key="id", **kw)
    return [r.text for r in out.orderBy("id").collect()]


@pytest.mark.parametrize("bound", [None, 0], ids=["constant", "join"])
class TestLadder:
    def test_plurals_and_case(self, spark, bound):
        kw = {"max_rows": bound}
        assert run(spark, {"chat": "xat"}, ["chats Chat CHAT chat"], **kw) == ["xats Xat XAT xat"]
        assert run(spark, {"chat": "xat"}, ["CHAT Chat"], convert_uppercase=False, **kw) == ["CHAT Xat"]
        assert run(spark, {"chat": "xat"}, ["chats chat"], marker=None, **kw) == ["chats xat"]
        assert run(spark, {"chat": "xat"}, ["CHATS Chats"], **kw) == ["XATS Xats"]

    def test_proper_nouns(self, spark, bound):
        d = {"chat": "xat", "Chat": ""}
        assert run(spark, d, ["Chat CHAT chat Chats"], max_rows=bound) == ["Chat CHAT xat Xats"]

    def test_stop_entries_do_not_infer_plurals(self, spark, bound):
        assert run(spark, {"chat": "xat", "chats": ""}, ["chats chat"], max_rows=bound) == ["chats xat"]
        assert run(spark, {"chat": ""}, ["chats chat Chat"], max_rows=bound) == ["chats chat Chat"]

    def test_hyphens(self, spark, bound):
        d = {"a-b": "ab", "c": "k", "b": "bb"}
        assert run(spark, d, ["a-b c-a-b A-b"], max_rows=bound) == ["ab k-a-bb A-bb"]

    def test_urls_and_punctuation(self, spark, bound):
        d = {"chat": "xat"}
        got = run(spark, d, ["http://chat/chat-1 chat. chat, chat"], max_rows=bound)
        assert got == ["http://chat/chat-1 xat. xat, xat"]

    def test_single_capital_counts_as_upper(self, spark, bound):
        assert run(spark, {"a": "eu"}, ["A a"], max_rows=bound) == ["EU eu"]
        assert run(spark, {"a": "eu"}, ["A a"], convert_uppercase=False, max_rows=bound) == ["Eu eu"]


def test_decomposed_accents_match(spark):
    assert run(spark, {"été": "ete"}, ["été été"]) == ["ete ete"]


def test_identity_dictionary_changes_nothing(spark):
    texts = ["Un été, deux\u0001 étés — l'eau a-b-c x.y/z 12", "", "\n\n"]
    assert run(spark, {"un": "un", "été": "été"}, texts) == texts


def test_null_text_stays_null(spark):
    df = spark.createDataFrame([(1, None), (2, "chat")], "id int, text string")
    out = R.respell(df, "text", Dictionary.of(spark, {"chat": "xat"}), count_col="n").orderBy("id").collect()
    assert [r.text for r in out] == [None, "xat"]


def test_tokens_are_lossless(spark):
    texts = ["a--b  c.d. 1x", "\u0001é\u0002 l'été-là…", "http://a.b/c?d=e", "-".join("ab" * 5000), ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(F.array_join(F.transform(T.tokens("t"), lambda x: x["tok"]), "").alias("t")).collect()
    assert sorted(r.t for r in got) == sorted(texts)


def test_words(spark):
    df = spark.createDataFrame([("http://chat/chat-1 chat. chat a_b-c 9a9",)], "t string")
    assert df.select(T.words("t").alias("w")).first().w == ["http://chat/chat", "chat", "chat", "a_b-c", "a"]


def test_very_long_compound_does_not_overflow(spark):
    long = "-".join(["chat"] * 20000)
    assert run(spark, {"chat": "xat"}, [long]) == [long.replace("chat", "xat")]


def test_resolved_words_agree_with_the_projection(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    d = Dictionary.of(spark, {"de": "dé", "la": "", "eau": "ô", "Le": "", "un": "in"})
    words = docs.select(F.explode(T.words("text")).alias("w")).distinct().filter(~F.contains("w", F.lit("-")))
    by_join = {r.w: r.new_word for r in R.resolve_words(words, "w", d, marker="s").collect()}
    direct = R.respell(words.withColumn("x", F.col("w")), "x", d, marker="s", normalize=False)
    assert {r.w: r.x for r in direct.collect()} == by_join


def test_guard_starts_at_the_first_collision(spark):
    d = Dictionary.of(spark, {"bill": "bil", "mot": "mo"})
    coll = spark.createDataFrame([("bill",)], "entry string")
    df = spark.createDataFrame([(1, "mot bill mot", True), (2, "mot bill mot", False), (3, "mot Bills mot", True)], "id int, text string, en boolean")
    out = R.respell_guarded(df, "text", d, coll, F.col("en"), marker="s").orderBy("id").collect()
    assert [r.text for r in out] == ["mo bill mot", "mo bil mo", "mo Bills mot"]


def test_plan_has_no_shuffle_and_no_join(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    out = R.respell(docs, "text", Dictionary.of(spark, {"de": "dé"}), marker="s")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    # The lookup table never becomes a column of the rows.
    assert "subquery" in plan and "AS _lookup" not in plan


def test_no_plan_carries_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.lower("text").alias("text"))
    d = Dictionary.of(spark, {"de": "dé"})
    coll = spark.createDataFrame([("de",)], "entry string")
    counts = spark.createDataFrame([("fr", "es", 3), ("en", "th", 1)], "lang string, digram string, n long")
    for df in (
        R.respell(docs, "text", d, marker="s", count_col="n").filter("n > 1"),
        R.respell_guarded(docs, "text", d, coll, F.lit(True), marker="s", count_col="n").filter("n > 1"),
        L.language_score(docs, "text", L.fit_digram_model(counts)).filter("is_foreign"),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "ubquery" in plan and "AS _lookup" not in plan


@pytest.mark.parametrize("rows", [100_000, 1])
def test_plans_over_the_bound_agree(spark, monkeypatch, rows):
    """With every word in the tail, and with all that two rows share sent as a constant; keys are null or repeated."""
    monkeypatch.setattr(lookup, "HEAD_ROWS", rows)
    texts = ["de l'eau, des eaux EAU Eau", "de bill de Bills de", "", None, "a-de De-b", "de"] * 2
    df = spark.createDataFrame([(None if i == 1 else i % 9, t, i % 2 == 1) for i, t in enumerate(texts)], "id int, text string, en boolean")
    d = Dictionary.of(spark, {"de": "dé", "eau": "ô", "eaux": "", "bill": "bil", "Eau": "x"})
    coll = spark.createDataFrame([("bill",)], "entry string")
    forms = lambda out: sorted(map(str, out.collect()))
    for kw in ({"marker": "s"}, {"marker": None, "convert_uppercase": False}):
        assert forms(R.respell(df, "text", d, key="id", max_rows=0, count_col="n", **kw)) == forms(R.respell(df, "text", d, count_col="n", **kw))
    guarded = [R.respell_guarded(df, "text", d, coll, F.col("en"), marker="s", count_col="n", **kw) for kw in ({}, {"key": "id", "max_rows": 0})]
    assert forms(guarded[0]) == forms(guarded[1])
    heads = spark.createDataFrame([("de",), ("des",)], "word string")
    pairs = spark.createDataFrame([("eaux", "eau"), ("bill", "b")], "var string, invar string")
    assert forms(X.rewrite_after(df, "text", heads, pairs, key="id", max_rows=0)) == forms(X.rewrite_after(df, "text", heads, pairs))


def test_two_lists_over_the_bound_meet_the_words_once(spark):
    """One explosion of the words joins both lists: finding F9."""
    texts = ["de eaux de bill, de  eaux", "des eaux eaux", "bill bill", "", None]
    df = spark.createDataFrame([(i % 4, t) for i, t in enumerate(texts)], "id int, text string")
    heads = spark.createDataFrame([("de",), ("des",), ("eaux",), (None,)], "word string")
    pairs = spark.createDataFrame([("eaux", "eau"), ("bill", "b"), ("bill", "c"), ("de", None)], "var string, invar string")
    joined = X.rewrite_after(df, "text", heads, pairs, key="id", max_rows=0)
    rows = lambda x: sorted(map(str, x.collect()))
    assert rows(joined) == rows(X.rewrite_after(df, "text", heads, pairs))
    assert joined._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1


def test_a_word_of_every_row_is_no_key_of_the_join(spark, monkeypatch):
    monkeypatch.setattr(lookup, "HEAD_ROWS", 50)
    df = spark.range(200).select("id", F.concat(F.lit("de mot"), F.chr(F.col("id") % 26 + 97)).alias("text"))
    d = Dictionary.of(spark, {"de": "dé", **{f"mot{c}": "m" + c for c in "abcdefghijklmnopqrstuvwxyz"}})
    step = df.withColumn("_w", T.words("text"))
    out, found = lookup.row_lookup(step, ["id"], F.col("_w"), d.df, "old", "new", "_e")
    assert found.head is not None and out.filter(F.array_contains(F.map_keys("_e"), "de")).isEmpty()
    assert out.filter(F.size("_e") == 1).count() == 200
    got = R.respell(df, "text", d, key="id", max_rows=0).agg(F.count_if(F.startswith("text", F.lit("dé m")))).first()[0]
    assert got == 200
    with pytest.raises(ValueError, match="key="):
        R.respell(df, "text", d, max_rows=0)


def test_looking_for_unusual_letters_is_cheap(spark):
    """It costs about as much as finding the words, not ten times as much."""
    import time

    points = [0x2FF, 0x300, 0x200F, 0x2010, 0x2027, 0x2028, 0x20AB, 0x20AC, 0x20AD, 0xFFFF, 0x10000, 0x10FFFF]
    found = spark.createDataFrame([(p, chr(p)) for p in points], "p int, c string").filter(F.col("c").rlike(T._UNUSUAL))
    usual = {0x2FF, 0x2010, 0x2027, 0x20AC}
    assert {r.p for r in found.collect()} == set(points) - usual

    docs = spark.range(0, 16, 1, 4).select(F.repeat(F.concat(F.lit("Élève modèle, à l'étude. "), "id"), F.lit(40_000)).alias("t"))

    def seconds(col):
        took = []
        for _ in range(2):
            start = time.perf_counter()
            docs.select(col.alias("x")).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        return min(took)

    assert seconds(F.col("t").rlike(T._UNUSUAL)) < 2 * seconds(F.size(T.words("t"))) + 0.5
