"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length into buckets, and large buckets into blocks of bounded size. A cell
is a block of queries with a block of candidates. In a cell, candidates come in slices of falling
length; the k-th score that a query has so far gives its local cosine threshold for the slice:
above 1 the slice is skipped (length pruning); otherwise a high threshold bounds the value that
the largest coordinates of the query allow (coordinate pruning), a low one leaves all. Products
of what is left are verified in whole numbers. Cells keep k rows a query; a rank limit joins them.

A first pass over one block of the longest vectors gives each query a k-th score. In the second
pass the threshold goes to all other cells: a bucket too short for it is not read for that query,
and where none of a block of queries can use a bucket, its candidates are not dealt there.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphie.llm.shared import stored

QUERY_BLOCK, CANDIDATE_BLOCK, SLICE = 4096, 16384, 512
COORD_FROM, FOCUS = 0.5, 3
_LONG = (1 << 63) - 1


def _exact(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Inner products of all rows of q with all of p; held within 64 bits."""
    if not len(q) or not len(p):
        return np.zeros((len(q), len(p)), np.int64)
    bound = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(p.astype(float)).max(initial=0)) * q.shape[1]
    if bound < 2**53:
        return (q.astype(float) @ p.astype(float).T).astype(np.int64)
    return np.clip(q.astype(object) @ p.astype(object).T, -_LONG - 1, _LONG).astype(np.int64)


def _cell(k: int):
    def run(queries: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "m": []}).astype("int64").astype({"vec_id": "Int64"})
        if queries.empty or found.empty:
            return empty
        found = found.sort_values("norm", ascending=False, kind="stable")
        q, p = np.array(queries["q_v"].tolist(), dtype=np.int64), np.array(found["v"].tolist(), dtype=np.int64)
        if not q.shape[1]:
            q, p = np.zeros((len(q), 1), np.int64), np.zeros((len(p), 1), np.int64)
        qid, qn = queries["q_id"].to_numpy(), np.maximum(queries["q_norm"].to_numpy(), 1e-300)
        known, ids = found["known"].to_numpy(), found["id"].to_numpy()
        order_id = np.where(known, ids.astype(float), np.inf)  # for ties below; exact ids decide there
        pn, m = found["norm"].to_numpy(), found["m"].to_numpy()
        unit = q / qn[:, None]
        focus = np.argsort(-np.abs(unit), axis=1)[:, : min(FOCUS, unit.shape[1])]
        best: list[list[tuple[int, bool, int, int]]] = [[] for _ in q]  # (-score, id unknown, id, m)
        least = queries["least"].to_numpy(dtype=float, na_value=-np.inf)  # from the first pass
        for at in range(0, len(p), SLICE):
            part, length = p[at : at + SLICE], max(pn[at], 1e-300)
            tau = np.where(np.isfinite(least), least / (qn * length), -np.inf)
            live = np.flatnonzero(tau <= 1 + 1e-9)
            if not len(live):
                continue
            coord = live[tau[live] >= COORD_FROM]
            plain = live[tau[live] < COORD_FROM]
            pairs = []
            if len(coord):
                near = part / np.maximum(pn[at : at + SLICE], 1e-300)[:, None]
                keep = np.ones((len(coord), len(part)), bool)
                t = np.clip(tau[coord], 0, 1)
                for f in focus[coord].T:
                    a = unit[coord, f]
                    room = np.sqrt(np.maximum(0, 1 - a * a) * (1 - t * t)) + 1e-9
                    # the cosine needed is t or more, so the coordinate is t*a-room at least on the side of a
                    side, x = np.sign(a)[:, None], near[:, f].T
                    low = (t * np.abs(a) - room)[:, None]
                    keep &= x * side >= low
                rows, cols = np.nonzero(keep)
                if len(rows) * 4 < keep.size:
                    wide = float(np.abs(q).max()) * float(np.abs(part).max()) * q.shape[1] >= 2**53
                    for r in range(0, len(rows), 1 << 16):
                        i, j = coord[rows[r : r + (1 << 16)]], cols[r : r + (1 << 16)]
                        if wide:
                            s = np.array([max(-_LONG - 1, min(_LONG, sum(int(x) * int(y) for x, y in zip(q[a], part[b])))) for a, b in zip(i, j)], dtype=np.int64)
                        else:
                            s = np.einsum("ij,ij->i", q[i], part[j])
                        pairs.append((i, j, s))
                else:
                    plain = np.sort(np.concatenate([plain, coord]))
            if len(plain):
                s = _exact(q[plain], part)
                i, j = np.nonzero(s >= least[plain][:, None])
                pairs.append((plain[i], j, s[i, j]))
            i, j, s = (np.concatenate(x) for x in zip(*pairs))
            # only the k first of each query and slice can matter
            order = np.lexsort((order_id[at + j], -s.astype(float), i))
            i, j, s = i[order], j[order], s[order]
            bounds = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else []
            for b, e in zip(bounds, [*bounds[1:], len(i)]):
                n = i[b]
                own = qid[n]
                new = [(-int(s[x]), not known[at + j[x]], int(ids[at + j[x]]), int(m[at + j[x]])) for x in range(b, e) if s[x] >= least[n] and not (known[at + j[x]] and ids[at + j[x]] == own)]
                if new:
                    top, count, out = sorted(best[n] + new), 0, []
                    for row in top:
                        if count >= k:
                            break
                        out.append(row)
                        count += row[3]
                    best[n] = out
                    if count >= k:
                        least[n] = -out[-1][0]
        flat = [(own, None if unknown else i, -s, c) for own, rows in zip(qid, best) for s, unknown, i, c in rows]
        return pd.DataFrame(flat, columns=["query_id", "vec_id", "score", "m"]).astype({"vec_id": "Int64"}) if flat else empty

    return run


def whole_vectors(table: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, v, m``: distinct rows with components floor(1024 * x) as integers, m of each; unusable ones left out."""
    x = F.col(vector)
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    rows = table.filter(x.isNotNull()).filter(finite)
    v = F.transform(x, lambda e: F.floor(e.cast("double") * F.lit(1024.0)))
    return rows.select(F.col(key).cast("bigint").alias("vec_id"), v.alias("v")).groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("m"))


CELL = ("dim", "bucket", "block", "q_block")


def _cells(asked: DataFrame, placed: DataFrame, k: int) -> DataFrame:
    """The k best candidates of each cell for each query in it; candidates go only to cells that a query asks for."""
    cells = asked.select(*CELL).distinct()
    dealt = placed.join(cells, list(CELL[:3])).toDF(*[c if c not in CELL else f"to_{c}" for c in [*CELL[:3], "id", "known", "v", "norm", "m", "q_block"]])
    return asked.groupBy(*CELL).cogroup(dealt.groupBy(*[f"to_{c}" for c in CELL])).applyInPandas(_cell(k), "query_id bigint, vec_id bigint, score bigint, m bigint")


def top_k(vectors: DataFrame, is_query, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best other rows for each row of ``vec_id, v, m`` that is a query.

    A row is no candidate for a query of its own id. Vectors of another dimension are none either.
    Ties go to the smaller id, a null id last. Repeated rows are ranked one by one. Scores beyond
    64 bits stop at the limits of a long.
    """
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double")))
    rows = vectors.withColumn("norm", norm).withColumn("dim", F.size("v"))
    rows = stored(rows.withColumn("bucket", F.when(F.col("norm") > 0, F.floor(F.log("norm") / F.lit(math.log(1.5)))).otherwise(-1)), "vectors")
    queries = rows.filter(is_query & F.col("vec_id").isNotNull())
    q_blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    asked = queries.select(
        F.col("vec_id").alias("q_id"), F.col("v").alias("q_v"), F.col("norm").alias("q_norm"), "dim",
        F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks)).cast("int").alias("q_block"),
    )
    sizes = rows.groupBy("dim", "bucket").agg(F.sum("m").alias("n"), F.count(F.lit(1)).alias("rows"), F.max("norm").alias("longest"))
    sizes = stored(sizes.withColumn("blocks", F.ceil(F.col("rows") / F.lit(CANDIDATE_BLOCK))).drop("rows"), "buckets")
    placed = rows.join(sizes.select("dim", "bucket", "blocks"), ["dim", "bucket"])
    placed = placed.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), "blocks")).select(
        "dim", "bucket", "block", F.coalesce("vec_id", F.lit(0)).alias("id"), F.col("vec_id").isNotNull().alias("known"), "v", "norm", "m"
    )
    # the longest bucket that can hold k others, else just the longest
    first = F.max(F.struct((F.col("n") > k).alias("enough"), "bucket")).alias("f")
    first = sizes.groupBy("dim").agg(first).select("dim", F.col("f.bucket").alias("bucket"), F.lit(0).cast("bigint").alias("block"))
    no_score = F.lit(None).cast("bigint").alias("least")
    begun = stored(_cells(asked.join(first, "dim").select("*", no_score), placed, k), "first_scores")
    scores = begun.groupBy("query_id").agg(F.sum("m").alias("n"), F.min("score").alias("least")).filter(F.col("n") >= k)
    known = asked.join(scores.select(F.col("query_id").alias("q_id"), "least"), "q_id", "left")
    reach = F.col("least").isNull() | (F.col("least") <= F.col("q_norm") * F.col("longest") * (1 + 1e-9))
    blocks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block")
    others = known.join(sizes, "dim").filter(reach).select(*known.columns, "bucket", blocks)
    others = others.join(first, ["dim", "bucket", "block"], "left_anti")
    found = begun.unionByName(_cells(others, placed, k))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    found = found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k)
    each = found.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(F.col("m"), F.lit(k)))))
    ranked = each.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
