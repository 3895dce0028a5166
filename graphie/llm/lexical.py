"""Ranked lexical search by Block-Max MaxScore over segments of an inverted index.

Index. Each task tokenises its documents once and closes a segment every ``SEGMENT_DOCS`` documents
or ``SEGMENT_BYTES`` of text. A posting list holds blocks of ``BLOCK`` postings, coded as byte-wide
gaps and counts. Beside a block stand its impacts: the pairs (count, document length) that no other
posting of the block beats in both, so the largest score in the block is exact for any corpus
statistics. The index is written to the shared folder; N, L and df are sums over its rows.

Search. A task reads its segments one after the other and keeps the k best of each query over all
of them, so the k-th score so far prunes the next segment. The bounds of the lists in a segment,
summed from the smallest, part them: as long as the sum stays below the k-th score the lists are
non-essential, since a document with those terms alone cannot get in. Documents come from the other,
essential, lists. Non-essential lists are asked from the largest bound down: a document whose score,
block maximum and bounds still to come stay below the k-th score is dropped before the block is
decoded. The heaps of all tasks meet in a rank limit.

A set of queries goes to every task in blocks of bounded size.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphie.llm.shared import stored

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK, SEGMENT_DOCS, SEGMENT_BYTES = 128, 16384, 32 << 20
MOST_TERMS, QUERY_BLOCK, QUERY_ROWS = 200_000, 2048, 250_000
INDEX = (
    "segment bigint, term string, df bigint, tokens bigint, blocks array<int>, impacts array<int>, "
    "postings binary, ids array<bigint>, lengths array<int>"
)
_ARROW = pa.schema([
    ("segment", pa.int64()), ("term", pa.string()), ("df", pa.int64()), ("tokens", pa.int64()), ("blocks", pa.list_(pa.int32())),
    ("impacts", pa.list_(pa.int32())), ("postings", pa.binary()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())),
])
# Bytes of terms, A-Z lower-cased; all others become spaces.
_TERM_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8."""
    return text.translate(_TERM_BYTES).split()


def _posting_rows(segment: int, terms: list[bytes], docs: np.ndarray, tfs: np.ndarray, lengths: np.ndarray) -> Iterator[tuple]:
    """Index rows of a segment's postings, which come by document."""
    number = {t: i for i, t in enumerate(dict.fromkeys(terms))}
    which = np.fromiter(map(number.__getitem__, terms), np.int64, len(terms))
    order = np.argsort(which, kind="stable")
    which, docs, tfs = which[order], docs[order], tfs[order]
    starts = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
    place = np.arange(len(which)) - np.repeat(starts, np.diff(np.r_[starts, len(which)]))
    begins = place % BLOCK == 0
    edges = np.flatnonzero(begins)
    block = np.cumsum(begins) - 1
    gaps = np.where(begins, 0, docs - np.r_[0, docs[:-1]])
    wide_gap = np.maximum.reduceat(gaps, edges) > 255
    wide_tf = np.maximum.reduceat(tfs, edges) > 255
    # impacts: from the largest count down, each length below all lengths before it
    n = lengths[docs]
    best = np.lexsort((n, -tfs, block))
    low = n[best] + (len(edges) - block[best]) * (1 << 32)  # falls from block to block, so one running minimum serves all
    kept = best[np.r_[True, low[1:] < np.minimum.accumulate(low)[:-1]]]
    kept_block, kept_tf, kept_n = block[kept], tfs[kept], n[kept]
    impact_at = np.searchsorted(kept_block, np.arange(len(edges) + 1))
    forms = {(g, t): (gaps.astype("<u2" if g else "u1"), tfs.astype("<u4" if t else "u1")) for g in (False, True) for t in (False, True)}
    ends = np.r_[edges[1:], len(which)]
    first_block = np.r_[block[starts], len(edges)]
    names = list(number)
    for k, term in enumerate(names):
        heads, parts, at = [], [], 0
        b0, b1 = first_block[k], first_block[k + 1]
        for b in range(b0, b1):
            wide = (bool(wide_gap[b]), bool(wide_tf[b]))
            g, t = forms[wide]
            s, e = edges[b], ends[b]
            data = g[s:e].tobytes() + t[s:e].tobytes()
            heads += [int(docs[s]), int(e - s), at, wide[0] + 2 * wide[1], int(impact_at[b + 1] - impact_at[b])]
            parts.append(data)
            at += len(data)
        i0, i1 = impact_at[b0], impact_at[b1]
        impacts = np.stack([kept_tf[i0:i1], kept_n[i0:i1]], 1).ravel()
        yield segment, term.decode(), int(ends[b1 - 1] - edges[b0]), 0, heads, impacts, b"".join(parts), None, None


def _indexed(vocabulary: frozenset[bytes] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, part = TaskContext.get(), 0
        terms, tfs, per_doc, ids, lengths, size = [], [], [], [], [], 0

        def close() -> Iterator[pa.RecordBatch]:
            segment = task.partitionId() << 32 | part
            n = np.array(lengths, np.int64)
            rows = [(segment, "", len(ids), int(n.sum()), None, None, None, ids, lengths)]
            if terms:
                docs = np.repeat(np.arange(len(ids)), per_doc)
                rows += _posting_rows(segment, terms, docs, np.array(tfs, np.int64), n)
            for i in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 4096]), _ARROW)], schema=_ARROW)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                found = terms_of(text.as_py() or b"")
                if not found:
                    continue
                counts = Counter(found if vocabulary is None else filter(vocabulary.__contains__, found))
                terms += counts.keys()
                tfs += counts.values()
                per_doc.append(len(counts))
                ids.append(doc_id)
                lengths.append(len(found))
                size += len(text.as_py())
                if len(ids) >= SEGMENT_DOCS or size >= SEGMENT_BYTES:
                    yield from close()
                    terms, tfs, per_doc, ids, lengths, size, part = [], [], [], [], [], 0, part + 1
        if ids:
            yield from close()

    return run


def build_index(docs: DataFrame, terms: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The inverted index of all documents, written once.

    ``terms`` (a column ``term``) says which terms will be asked for; others get no lists, though
    they count in N and L. Beyond ``MOST_TERMS`` of them all terms are indexed. Null and empty texts
    are no documents; rows that repeat an id, or have none, are documents of their own. Other columns
    are ignored.
    """
    vocabulary = None
    if terms is not None:
        some = terms.select("term").distinct().limit(MOST_TERMS + 1).collect()
        if len(some) <= MOST_TERMS:
            vocabulary = frozenset(r[0].encode() for r in some)
    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("text"))
    return stored(rows.mapInArrow(_indexed(vocabulary), INDEX), "lexical-index")


def query_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """``q, item_id, term, repeats``: the terms of each item. Rows alike in id and text are one item; q tells others apart."""
    lower = F.translate(F.col(f"`{text}`"), UPPER, LOWER)
    rows = items.select(F.col(f"`{key}`").alias("item_id"), lower.alias("t")).filter(F.col("t").isNotNull()).distinct()
    each = rows.select(
        F.sha2(F.concat_ws("\x00", F.coalesce(F.col("item_id").cast("string"), F.lit("\x01")), "t"), 256).alias("q"), "item_id",
        F.explode(F.regexp_extract_all("t", F.lit(TERM), F.lit(0))).alias("term"),
    )
    return each.groupBy("q", "item_id", "term").agg(F.count(F.lit(1)).alias("repeats"))


def term_weights(index: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` with the weight w of each term and the corpus numbers N and L; terms of no document are left out."""
    corpus = index.filter("term = ''").agg(F.sum("df").alias("N"), F.sum("tokens").alias("L"))
    df = index.filter("term <> ''").groupBy("term").agg(F.sum("df").alias("df"))
    w = F.floor(F.lit(1000.0) * F.log((2 * F.col("N") + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
    return asked.join(df, "term").crossJoin(F.broadcast(corpus)).withColumn("w", w.cast("bigint"))  # corpus: one row


class _List:
    """A posting list of one segment; blocks are decoded when asked for, once."""

    def __init__(self, seg: _Segment, blocks: np.ndarray, impacts: np.ndarray, postings: bytes):
        self.seg, self.blocks, self.postings, self.open, self.all = seg, blocks.reshape(-1, 5), postings, {}, None
        tf, n = impacts.reshape(-1, 2).T
        edges = np.r_[0, np.cumsum(self.blocks[:, 4])[:-1]]
        self.block_max = np.maximum.reduceat(seg.impact(tf.astype(np.int64), n.astype(np.int64)), edges)
        self.max = int(self.block_max.max())

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of a block."""
        if b not in self.open:
            first, n, at, kind, _ = self.blocks[b]
            gap, count = "<u2" if kind & 1 else "u1", "<u4" if kind & 2 else "u1"
            docs = first + np.cumsum(np.frombuffer(self.postings, gap, n, at), dtype=np.int64)
            tfs = np.frombuffer(self.postings, count, n, at + n * np.dtype(gap).itemsize).astype(np.int64)
            self.open[b] = docs, self.seg.impact(tfs, self.seg.lengths[docs])
            self.seg.decoded += 1
        return self.open[b]

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        if self.all is None:
            self.all = tuple(np.concatenate(x) for x in zip(*map(self.block, range(len(self.blocks)))))
        return self.all


class _Segment:
    def __init__(self, ids: list, lengths: np.ndarray, corpus: tuple[int, int]):
        self.known = np.array([i is not None for i in ids])
        self.ids = np.array([i or 0 for i in ids], np.int64)
        self.lengths = lengths.astype(np.int64)
        self.corpus, self.lists, self.decoded = corpus, {}, 0

    def impact(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        m = 100 - 25 + (25 * n * self.corpus[0]) // self.corpus[1]
        return (1_000_000_000 * tf) // (1000 * tf + 12 * m)

    def candidates(self, query: dict[str, int], least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents with a score of ``least`` or more, and the scores; ``least`` is 1 or more."""
        lists = [(w * x.max, w, x) for t, w in query.items() if w and (x := self.lists.get(t))]
        lists.sort(key=lambda x: x[0])
        bound = np.cumsum([x[0] for x in lists], dtype=np.int64)
        passive = int(np.searchsorted(bound, least))
        score = np.zeros(len(self.ids), np.int64)
        if passive == len(lists):
            return np.zeros(0, np.int64), score[:0]
        for _, w, x in lists[passive:]:
            docs, impacts = x.whole()
            score[docs] += w * impacts
        found = np.flatnonzero(score)
        for i in range(passive - 1, -1, -1):
            _, w, x = lists[i]
            rest = int(bound[i - 1]) if i else 0
            b = np.searchsorted(x.blocks[:, 0], found, "right") - 1
            most = score[found] + rest + np.where(b >= 0, w * x.block_max[np.maximum(b, 0)], 0)
            found, b = found[most >= least], b[most >= least]
            for k in np.unique(b[b >= 0]):
                docs, impacts = x.block(k)
                mine = found[b == k]
                at = np.minimum(np.searchsorted(docs, mine), len(docs) - 1)
                score[mine] += np.where(docs[at] == mine, w * impacts[at], 0)
        found = found[score[found] >= least]
        return found, score[found]


class _Heap:
    """The k best (score, id) so far: higher scores, then smaller ids, none last."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.score, self.known, self.id = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, known: np.ndarray, ids: np.ndarray) -> None:
        score, known, ids = np.r_[self.score, score], np.r_[self.known, known], np.r_[self.id, ids]
        best = np.lexsort((ids, ~known, -score))[: self.k]
        self.score, self.known, self.id = score[best], known[best], ids[best]
        if len(best) == self.k:
            self.least = int(self.score[-1])


def _searched(queries: list[tuple[str, dict[str, int]]], corpus: tuple[int, int], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = [_Heap(k) for _ in queries]
        seg, current = None, None

        def ask() -> None:
            for heap, (_, query) in zip(heaps, queries):
                found, score = seg.candidates(query, heap.least)
                if len(found):
                    heap.add(score, seg.known[found], seg.ids[found])

        for batch in batches:
            segments, names, blocks, impacts, postings, ids, lengths = (batch.column(i) for i in range(7))
            for i, (s, term) in enumerate(zip(segments.to_pylist(), names.to_pylist())):
                if s != current:  # its first row has the empty term: ids and lengths
                    if seg is not None:
                        ask()
                    seg, current = _Segment(ids[i].as_py(), lengths[i].values.to_numpy(zero_copy_only=False), corpus), s
                else:
                    seg.lists[term] = _List(seg, blocks[i].values.to_numpy(zero_copy_only=False), impacts[i].values.to_numpy(zero_copy_only=False), postings[i].as_py())
        if seg is not None:
            ask()
        rows = [(q, i if known else None, s) for heap, (q, _) in zip(heaps, queries) for s, known, i in zip(heap.score.tolist(), heap.known.tolist(), heap.id.tolist())]
        kinds = [pa.string(), pa.int64(), pa.int64()]
        columns = zip(*rows) if rows else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["q", "doc_id", "score"])

    return run


def search(index: DataFrame, asked: DataFrame, k: int = 20) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents of each item of ``query_terms``, whose scores are above 0.

    Equal scores are ranked by id, a missing id last. Items without terms, or whose terms no document
    has, have no rows. Items of one id but other texts are ranked each by itself.
    """
    spark = index.sparkSession
    weighted = stored(term_weights(index, asked), "lexical-queries")
    n = weighted.agg(F.countDistinct("q"), F.count(F.lit(1)), F.max("N"), F.max("L")).first()
    n_blocks = max(1, math.ceil(n[0] / QUERY_BLOCK), math.ceil(n[1] / QUERY_ROWS))
    corpus = (n[2] or 0, n[3] or 1)
    lists = index.select("segment", "term", "blocks", "impacts", "postings", "ids", "lengths")
    if n[1] > MOST_TERMS:
        lists = lists.join(weighted.select("term").distinct().union(spark.createDataFrame([("",)], "term string")), "term", "left_semi").select(lists.columns)
    lists = lists.repartition("segment").sortWithinPartitions("segment", "term")
    heaps = None
    for b in range(n_blocks):
        block = weighted.filter(F.pmod(F.xxhash64("q"), F.lit(n_blocks)) == b).select("q", "term", (F.col("repeats") * F.col("w")).alias("w"))
        queries: dict[str, dict[str, int]] = {}
        for q, term, w in block.collect():
            queries.setdefault(q, {})[term] = w
        found = lists.mapInArrow(_searched(sorted(queries.items()), corpus, k), "q string, doc_id bigint, score bigint")
        heaps = found if heaps is None else heaps.unionAll(found)
    best = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = heaps.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.join(weighted.select("q", "item_id").distinct(), "q").select("item_id", "rank", "doc_id", "score")
