"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same rate target / size, so its copies are the whole part of
the rate plus a fractional probability. Pairs of documents transfer words between their
probabilities at random, so that one of the two becomes 0 or 1 and the words of the pair stay the
same. Blocks of about 64 documents are folded at once and hand one undecided document up; the
blocks form a reduction tree of fan-in 64, each level one shuffle of a 64th of the rows.

The sum of taken words of a source is off its target by less than one document. Nothing is
gathered beyond a block, whatever the size of a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphie.llm.shared import WORD, stored, unit_hash

FAN_IN = 64
MOST_COPIES = 3

_ITEM = "struct<doc_id:bigint,size:bigint,m:bigint,base:bigint,w:double,p:double>"
_DONE = "struct<doc_id:bigint,size:bigint,m:bigint,copies:bigint>"


def _moved(item: str, p: str) -> str:
    fields = ", ".join(f"'{f}', {item}.{f}" for f in ("doc_id", "size", "m", "base", "w"))
    return f"named_struct({fields}, 'p', {p})"


def _settled(item: str, one: int) -> str:
    return f"named_struct('doc_id', {item}.doc_id, 'size', {item}.size, 'm', {item}.m, 'copies', {item}.base + {one}L)"


# v.c is the undecided document so far, v.x the next; up moves words from x to c, down from c to x.
_PAIR = f"""
CASE WHEN v.up THEN
  CASE WHEN v.c.w * (1 - v.c.p) <= v.x.w * v.x.p
    THEN named_struct('carry', {_moved('v.x', 'greatest(0D, v.x.p - v.gain / v.x.w)')}, 'done', {_settled('v.c', 1)})
    ELSE named_struct('carry', {_moved('v.c', 'least(1D, v.c.p + v.gain / v.c.w)')}, 'done', {_settled('v.x', 0)}) END
ELSE
  CASE WHEN v.c.w * v.c.p <= v.x.w * (1 - v.x.p)
    THEN named_struct('carry', {_moved('v.x', 'least(1D, v.x.p + v.loss / v.x.w)')}, 'done', {_settled('v.c', 0)})
    ELSE named_struct('carry', {_moved('v.c', 'greatest(0D, v.c.p - v.loss / v.c.w)')}, 'done', {_settled('v.x', 1)}) END
END"""


def _fold(seed: int, level: int) -> str:
    """One block: the undecided document that goes up, and the decided ones."""
    mask = (1 << 53) - 1
    chance = f"(xxhash64({seed}, {level}, c.doc_id, c.size, x.doc_id, x.size) & {mask}L) / {float(1 << 53)!r}D"
    drawn = (
        "named_struct('c', c, 'x', x, 'gain', gain, 'loss', loss, 'up', "
        f"CASE WHEN gain + loss > 0 THEN {chance} < loss / (gain + loss) ELSE c.p >= 1 END)"
    )
    for name, value in (("loss", "least(c.w * c.p, x.w * (1 - x.p))"), ("gain", "least(c.w * (1 - c.p), x.w * x.p)"), ("c", "acc.carry")):
        drawn = f"transform(array({value}), {name} -> {drawn})[0]"
    step = f"transform(array({drawn}), v -> {_PAIR})[0]"
    return f"""aggregate(items,
      named_struct('carry', cast(null AS {_ITEM}), 'done', cast(array() AS array<{_DONE}>)),
      (acc, x) -> CASE WHEN acc.carry IS NULL THEN named_struct('carry', x, 'done', acc.done)
        ELSE transform(array({step}), s -> named_struct('carry', s.carry, 'done', concat(acc.done, array(s.done))))[0] END)"""


def word_count(text: str) -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sized: DataFrame, source: str = "source", weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``source, source_size, n_units, target`` for rows ``source, doc_id, size``, each of them a unit.

    Sources in code-point order (null last) weigh 1, 2, 3, 1, ...; a target stops at three times
    the size of its source and the excess goes to the others by weight. Order numbers come from a
    range partitioning and its partition sizes; shares from global sums, so that no task and not
    the driver sees all sources.
    """
    per = sized.groupBy(source).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_units"))
    per = per.withColumn("last", F.col(source).isNull()).withColumn("name", F.coalesce(F.col(source), F.lit("")))
    per = per.repartitionByRange("last", "name").withColumn("part", F.spark_partition_id())
    per = stored(per.withColumn("i", F.row_number().over(Window.partitionBy("part").orderBy("last", "name"))), "sources")
    offset, starts = 0, []
    for r in per.groupBy("part").count().orderBy("part").collect():  # one row for each partition
        starts.append((r["part"], offset))
        offset += r["count"]
    if not starts:
        return per.select(source, "source_size", "n_units", F.lit(0.0).alias("target"))
    before = F.create_map(*[F.lit(x) for pair in starts for x in pair])[F.col("part")]
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(before + F.col("i") - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.select(source, "source_size", "n_units", weight.alias("weight"), (F.col("source_size") * MOST_COPIES).cast("double").alias("most"))
    total = float(per.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:  # the level only rises, and each round caps one source more at least
        capped = F.col("weight") * level > F.col("most")
        fixed, free = per.agg(
            F.coalesce(F.sum(F.when(capped, F.col("most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0))
        ).first()
        new = (total - fixed) / free if free else level
        if new <= level:
            break
        level = new
    return per.select(source, "source_size", "n_units", F.least(F.col("most"), F.col("weight") * level).alias("target"))


def mixing_plan(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", seed: int = 17) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, copies, taken``.

    Null texts and texts without a word have size 0 and are not taken. Rows equal in id, source
    and size are one unit: they get the same copies. Ids may be null. An empty table gives no rows.
    ``taken`` is ``copies * size`` and at most three times the size. The same seed gives the same plan.
    """
    sized = docs.select(F.col(source).alias("source"), F.col(key).cast("bigint").alias("doc_id"), word_count(text).alias("size"))
    units = stored(sized.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("m")), "units")
    targets = source_targets(units.select("source", "doc_id", (F.col("size") * F.col("m")).alias("size")))
    per = stored(targets, "targets")
    most = per.agg(F.max("n_units")).first()[0] or 0
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST_COPIES)))).otherwise(F.lit(0.0))
    items = (
        units.join(per.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("rate", rate)
        .withColumn("base", F.floor("rate"))
        .withColumn("blocks", F.ceil(F.col("n_units") / F.lit(FAN_IN)))
    )
    keys = ["source", "source_size", "target"]
    zero = items.filter("size = 0").select(*keys, "doc_id", "size", "m", F.lit(0).cast("bigint").alias("copies"))
    item = F.struct("doc_id", "size", "m", "base", (F.col("size") * F.col("m")).cast("double").alias("w"), (F.col("rate") - F.col("base")).alias("p"))
    todo = items.filter("size > 0").select(*keys, "blocks", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), "blocks").alias("block"), item.alias("item"))
    blocks, level, parts = max(1, -(-most // FAN_IN)), 0, [zero]
    while True:
        folded = todo.groupBy(*keys, "block").agg(F.sort_array(F.collect_list("item")).alias("items"))
        folded = stored(folded.withColumn("f", F.expr(_fold(seed, level))).select(*keys, "block", "f"), f"level{level}")
        parts.append(folded.select(*keys, F.inline("f.done")))
        top = folded.select(*keys, "block", F.col("f.carry").alias("item"))
        if blocks == 1:
            last = F.when(unit_hash(F.lit(seed), "item.doc_id", "item.size") < F.col("item.p"), 1).otherwise(0)
            parts.append(top.select(*keys, "item.doc_id", "item.size", "item.m", (F.col("item.base") + last).alias("copies")))
            break
        todo = top.withColumn("block", F.floor(F.col("block") / F.lit(FAN_IN)))
        blocks, level = -(-blocks // FAN_IN), level + 1
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("_n", F.explode(F.expr("sequence(1L, m)"))).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mix_documents(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", seed: int = 17) -> DataFrame:
    """The documents that the mix takes, with all their columns and ``copies``, how often each is read.

    A column of the table that is itself called ``copies`` is replaced.
    """
    plan = mixing_plan(docs, text, source, key, seed).select("doc_id", "source", "size", "copies").distinct().filter("copies > 0")
    names = [c for c in docs.columns if c != "copies"]
    rows = docs.select(
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)],
        F.col(f"`{key}`").cast("bigint").alias("_id"), F.col(f"`{source}`").alias("_source"), word_count(text).alias("_size"),
    )
    on = F.col("_id").eqNullSafe(F.col("doc_id")) & F.col("_source").eqNullSafe(F.col("source")) & (F.col("_size") == F.col("size"))
    return rows.join(plan, on).select(*[f"c{i}" for i in range(len(names))], "copies").toDF(*names, "copies")
