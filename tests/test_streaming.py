from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from graphie.operators.dictionary import Dictionary
from graphie.plans.streams import in_parts, run
from graphie.sources import lexicon_io as LX
from graphie.sources.files import read_documents, stored, work_folder
from graphie.streaming import streams as S


T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(ms):
    return T0 + timedelta(milliseconds=ms)


def debounced(spark, df, parts):
    """All rewrites, as milliseconds since the first moment."""
    base = work_folder(spark, "debounce")
    stream = in_parts(df, "pages", F.col("part"), parts).drop("part")
    out = run(S.debounce(stream, "page", "ts"), "debounce", base=base)
    rest = S.last_rewrites(spark, f"{base}/state", "page", "string")
    start = int(T0.timestamp() * 1000)
    return sorted((r.page, r.fired_at - start, r.n_changes) for r in out.unionByName(rest).collect()), rest.count()


def test_debounce(spark):
    rows = [("a", at(0)), ("a", at(50)), ("a", at(3000)), ("a", at(3050)), ("a", at(9000)), ("end", at(60000))]
    rows += [("big", at(i)) for i in range(1500)]
    rows += [("big", at(20000)), ("big", at(20010)), ("late", at(59999)), ("late", None)]
    # The first burst fires once quiet; the next waits until five seconds have passed.
    want = [("a", 150, 2), ("a", 5150, 2), ("a", 10150, 1), ("big", 1599, 1500), ("big", 20110, 2), ("end", 60100, 1), ("late", 60099, 1)]
    whole = spark.createDataFrame([(*r, 0) for r in rows], "page string, ts timestamp, part int")
    got, pending = debounced(spark, whole, 1)
    assert got == want and pending == 2
    # cut anywhere, also within a burst and, by less than the watermark, out of order
    cut = [(p, t, 0 if t is None or t < at(700) else 1 if t < at(5100) else 2) for p, t in rows]
    swapped = [(p, t, 1 if p == "big" and t == at(650) else k) for p, t, k in cut]
    assert debounced(spark, spark.createDataFrame(swapped, "page string, ts timestamp, part int"), 3)[0] == want


def test_newest_versions_across_micro_batches(spark):
    rows = [(1, 5, "e", 0), (1, 2, "b", 0), (2, 1, "z", 0), (3, None, "n", 0), (1, 3, "c", 1), (2, 2, "y", 1), (1, 7, "g", 2), (1, 7, "h", 2), (2, 2, "x", 2), (2, 0, "w", 2)]
    df = spark.createDataFrame(rows, "class int, v int, text string, part int")
    out = run(S.newest_versions(in_parts(df, "versions", F.col("part"), 3), "class", "v"), "newest")
    assert sorted((r["class"], r.v, r.text) for r in out.collect()) == [(1, 5, "e"), (1, 7, "g"), (1, 7, "h"), (2, 1, "z"), (2, 2, "x"), (2, 2, "y")]
    assert {tuple(r)[:3] for r in S.latest_wins(out, "class", "v").collect()} == {tuple(r)[:3] for r in S.latest_wins(df.filter("v is not null"), "class", "v").collect()}


def test_newest_versions_keep_a_null_key_apart(spark):
    rows = [(k, v, f"{k} {v}", p) for k in (1, None, 50) for v, p in ((5 if k else 9, 0), (3, 1), (7 if k else 8, 1), (1, 2))]
    df = spark.createDataFrame(rows, "k bigint, v bigint, text string, part int")
    out = run(S.newest_versions(in_parts(df, "versions", F.col("part"), 3), "k", "v"), "newest")
    assert sorted(r.text for r in out.collect()) == ["1 5", "1 7", "50 5", "50 7", "None 9"]


def test_parts_are_dealt_over_files(spark):
    folder = "large-parts"
    df = spark.range(90_000).withColumn("part", (F.col("id") % 3).cast("int"))
    out = run(in_parts(df, folder, F.col("part"), 3).withColumn("f", F.input_file_name()), "dealt")
    files = out.groupBy("f").agg(F.count("*").alias("n"), F.count_distinct("part").alias("parts")).collect()
    assert len(files) > 3 and {r.parts for r in files} == {1} and sum(r.n for r in files) == 90_000
    assert out.agg(F.count_distinct("id")).first()[0] == 90_000


def test_stream_equals_batch_and_holds_empty_rows(spark, sf):
    d = Dictionary.of(spark, {"de": "dé"}, plurals_in_s="s")
    s = S.read_table_stream(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("turn") > 0, F.col("text")).otherwise("").alias("text"))
    out = run(S.respell_or_hold(s, "text", d), "hold")
    counts = {r.decision: r["count"] for r in out.groupBy("decision").count().collect()}
    assert counts["pending"] == spark.read.parquet(f"{sf}/conversations.parquet").filter("turn = 0").count()
    assert out.filter("decision = 'rewritten' and text rlike '(^| )de( |$)'").count() == 0
    assert out.filter("decision = 'pending' and text <> ''").count() == 0


def test_latest_wins(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, 1, "z")], "k int, v int, text string")
    assert {(r.k, r.text) for r in S.latest_wins(df, "k", "v").collect()} == {(1, "c"), (2, "z")}


def test_work_folder_follows_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    assert work_folder(spark, "x").startswith(base)
    assert stored(spark.range(5), "y").count() == 5


def test_readers(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name in ("a.TXT", "b.docx", "c.exe"):
        (tmp_path / "d" / name).write_bytes(b"x")
    assert sorted(r.kind for r in read_documents(spark, str(tmp_path / "d")).collect()) == ["docx", "text"]
    (tmp_path / "t.csv").write_text('pre,post\n"a ""b""",c\n')
    assert LX.read_csv(spark, str(tmp_path / "t.csv")).first().pre == 'a "b"'
    (tmp_path / "w.json").write_text('skip\n{"word":"a","sounds":[{"ipa":"x"}]}\n{"word":"b"}\n')
    rows = LX.read_dump(spark, str(tmp_path / "w.json")).orderBy("line_no").collect()
    assert [r.word for r in rows] == ["a", "b"] and rows[0].sounds[0].ipa == "x" and rows[0].tags is None
