"""Streams over the given tables, run to completion, against the batch answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphie.plans.registry import SMOKE_SQL, query, smoke_dictionary
from graphie.plans.respelling import respell_sql
from graphie.sources.files import stored, work_folder
from graphie.streaming import streams as S


def run(stream: DataFrame, name: str, mode: str = "append", base: str | None = None) -> DataFrame:
    """Everything available now, into Parquet, then read back. State is left in ``base``/state."""
    spark = stream.sparkSession
    base = base or work_folder(spark, name)
    with S.keyed_state(spark):
        q = (
            stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{base}/state")
            .trigger(availableNow=True).start(f"{base}/out")
        )
        q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


ROWS_A_FILE = 10_000


def in_parts(df: DataFrame, name: str, part: Column, n: int) -> DataFrame:
    """A stream of a table in ``n`` micro-batches: rows of part 0 come first.

    Every part is dealt over equally many files, at most one for each core; rows in turn, so that none of them is empty.
    """
    spark = df.sparkSession
    folder = work_folder(spark, name)
    sizes = dict(df.groupBy(part.cast("int")).count().collect())
    files = max(1, min(min(sizes.get(i, 0) for i in range(n)) // ROWS_A_FILE, spark.sparkContext.defaultParallelism))
    for i in range(n):  # one after the other, as the source reads the oldest files first
        rows = df.filter(part == i)
        rows = rows.coalesce(1) if files == 1 else rows.repartition(files)
        rows.write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(folder)


@query("stream_respell_conversations", respell_sql("conversations", "conv_id, turn", SMOKE_SQL))
def stream_respell_conversations(spark, sf):
    s = S.read_table_stream(spark, sf, "conversations").select("conv_id", "turn", "text")
    return run(S.respell_stream(s, "text", smoke_dictionary(spark), count_col="n_changed"), "respell")


@query(
    "stream_language_recheck",
    f"""WITH t AS (SELECT conv_id, turn, CASE WHEN turn = 0 THEN '' ELSE text END AS text FROM conversations),
g AS (SELECT *, CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^éèêëàçô]', '', 'g')) > 0.005 * length(text) END AS f FROM t)
SELECT CASE WHEN f IS NULL THEN 'pending' WHEN f THEN 'rewritten' ELSE 'kept' END AS decision, count(*) AS n FROM g GROUP BY 1""",
)
def stream_language_recheck(spark, sf):
    s = S.read_table_stream(spark, sf, "conversations")
    s = s.select("conv_id", "turn", F.when(F.col("turn") == 0, "").otherwise(F.col("text")).alias("text"))
    out = run(S.respell_or_hold(s, "text", smoke_dictionary(spark)), "recheck")
    return out.groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stream_latest_turn",
    respell_sql("(SELECT conv_id, arg_max(text, turn) AS text FROM conversations GROUP BY 1)", "conv_id", SMOKE_SQL).replace(
        "coalesce(n.n_changed, 0) AS n_changed,", ""
    ),
)
def stream_latest_turn(spark, sf):
    """Only the newest turn of each conversation counts, though turns come in three micro-batches and out of order."""
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "text")
    stream = in_parts(turns, "turns", F.pmod(F.col("turn") + F.col("conv_id"), F.lit(3)), 3)
    newest = S.newest_versions(stream, "conv_id", "turn")
    out = run(S.respell_stream(newest, "text", smoke_dictionary(spark)), "latest")
    return S.latest_wins(out, "conv_id", "turn").select("conv_id", "text")


# Changes of pages: each event changes the page of its user and that of its type, with time running a hundred thousand times faster.
_CHANGES_SQL = """
changes AS (SELECT unnest(['user ' || user_id, 'type ' || event_type]) AS page,
  1704067200000 + (epoch_us(ts) - 1704067200000000) // 100000000 AS t FROM events WHERE ts IS NOT NULL)"""


def _changes(spark, sf) -> DataFrame:
    start = 1_704_067_200_000
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - start * 1000
    events = spark.read.parquet(f"{sf}/events.parquet").filter("ts is not null")
    pages = F.array(F.concat(F.lit("user "), F.col("user_id").cast("string")), F.concat(F.lit("type "), "event_type"))
    ms = start + F.floor(micros / 100_000_000).cast("bigint")
    return events.select(F.explode(pages).alias("page"), ms.alias("t")).filter("page is not null").withColumn("ts", F.timestamp_millis("t"))


@query(
    "stream_debounced_pages",
    f"""WITH RECURSIVE {_CHANGES_SQL},
moments AS (SELECT page, t, count(*) AS c, row_number() OVER (PARTITION BY page ORDER BY t) AS k FROM changes WHERE page IS NOT NULL GROUP BY page, t),
run AS (SELECT page, 0::BIGINT AS k, 0::BIGINT AS n, 0::BIGINT AS last, -5000::BIGINT AS fired, 0::BIGINT AS out_n FROM (SELECT DISTINCT page FROM moments)
  UNION ALL
  SELECT m.page, m.k, CASE WHEN r.n > 0 AND m.t >= d.due THEN 0 ELSE r.n END + m.c, greatest(r.last, m.t),
    CASE WHEN r.n > 0 AND m.t >= d.due THEN d.due ELSE r.fired END, CASE WHEN r.n > 0 AND m.t >= d.due THEN r.n ELSE 0 END
  FROM run r JOIN moments m ON m.page = r.page AND m.k = r.k + 1,
  LATERAL (SELECT CASE WHEN r.n > 1000 THEN r.last + 100 ELSE greatest(r.last + 100, r.fired + 5000) END AS due) d),
done AS (SELECT page, max(k) AS k FROM run GROUP BY page)
SELECT page, fired AS fired_at, out_n AS n_changes FROM run WHERE out_n > 0
UNION ALL
SELECT page, CASE WHEN n > 1000 THEN last + 100 ELSE greatest(last + 100, fired + 5000) END, n FROM run JOIN done USING (page, k) WHERE n > 0""",
)
def stream_debounced_pages(spark, sf):
    """All rewrites, those still due at the end of the input included; the input comes in three micro-batches."""
    changes = stored(_changes(spark, sf), "changes")
    third = F.floor((F.col("t") % 100_000) / F.lit(10_000)).cast("int")  # thirty days are 25.92 seconds here
    base = work_folder(spark, "debounce")
    done = run(S.debounce(in_parts(changes, "changes", F.least(third, F.lit(2)), 3).drop("t"), "page", "ts"), "debounce", base=base)
    return done.unionByName(S.last_rewrites(spark, f"{base}/state", "page", "string"))


@query(
    "stream_debounced_users",
    """WITH RECURSIVE moments AS (SELECT user_id, t, count(*) AS c, row_number() OVER (PARTITION BY user_id ORDER BY t) AS k
  FROM (SELECT user_id, epoch_us(ts) // 1000 AS t FROM events WHERE ts IS NOT NULL) GROUP BY user_id, t),
run AS (SELECT user_id, 0::BIGINT AS k, 0::BIGINT AS n, 0::BIGINT AS last, -5000::BIGINT AS fired, 0::BIGINT AS out_n FROM (SELECT DISTINCT user_id FROM moments)
  UNION ALL
  SELECT m.user_id, m.k, CASE WHEN r.n > 0 AND m.t >= d.due THEN 0 ELSE r.n END + m.c, greatest(r.last, m.t),
    CASE WHEN r.n > 0 AND m.t >= d.due THEN d.due ELSE r.fired END, CASE WHEN r.n > 0 AND m.t >= d.due THEN r.n ELSE 0 END
  FROM run r JOIN moments m ON m.user_id = r.user_id AND m.k = r.k + 1,
  LATERAL (SELECT CASE WHEN r.n > 1000 THEN r.last + 100 ELSE greatest(r.last + 100, r.fired + 5000) END AS due) d),
done AS (SELECT user_id, max(k) AS k FROM run GROUP BY user_id)
SELECT user_id, fired AS fired_at, out_n AS n_changes FROM run WHERE out_n > 0
UNION ALL
SELECT user_id, CASE WHEN n > 1000 THEN last + 100 ELSE greatest(last + 100, fired + 5000) END, n FROM run JOIN done USING (user_id, k) WHERE n > 0""",
)
def stream_debounced_users(spark, sf):
    """Each user stands for a page whose events are changes, at the pace of the table."""
    base = work_folder(spark, "debounce")
    s = S.read_table_stream(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    done = run(S.debounce(s, "user_id", "ts"), "debounce", base=base)
    return done.unionByName(S.last_rewrites(spark, f"{base}/state", "user_id", dict(s.dtypes)["user_id"]))


@query(
    "stream_change_bursts",
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 3600 SECOND THEN 0 ELSE 1 END AS b FROM events),
g AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e),
r AS (SELECT user_id, g, count(*) AS n_changes, max(ts) + INTERVAL 3600 SECOND AS ended FROM g GROUP BY 1, 2)
SELECT user_id, n_changes, count(*) AS n FROM r GROUP BY 1, 2""",
)
def stream_change_bursts(spark, sf):
    """Sessions of changes an hour apart. The table is bounded, so the batch form closes
    the last ones too."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    b = S.change_bursts(e, "user_id", "ts", gap="1 hour")
    return b.groupBy("user_id", "n_changes").agg(F.count(F.lit(1)).alias("n"))
