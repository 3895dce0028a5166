"""N-gram Jaccard join: documents linked by the overlap of their word n-gram sets, and their components.

The length of the n-grams and the similarity needed are the caller's; 4 and 0.85 stand for them here.
Equal sets are one class. Tokens (hashed n-grams) have one global order, very frequent ones last
and by hash otherwise; two linked sets share a token within the first n - ceil(0.85 n) + 1 of each.
Of a set that is linked at all, no more than n - ceil(0.85 n) tokens are in no other set. So each
set is laid open to a third more than its prefix, and one that has more such tokens there is
linked with nothing and left out: a passage in a longer document makes no candidates.
Classes that share a token of their prefixes go through two steps:

1. A star: each class is compared with the one class, among those it shares tokens with, that has
   the fewest prefix tokens of its own. Verified stars join most of a family of near copies with one
   comparison a class.
2. A prefix tree: for each shared token whose classes are still in different components, the
   prefixes are stored in a tree, blocks of bounded size each. Classes outside the token's largest
   component walk the trees: paths share the overlap counted so far, and a subtree is left when the
   remaining lengths cannot reach the overlap that is needed, or when it holds the same component
   only. Before that, classes with too many tokens that no other component has are left out again,
   and of tokens that the same classes share the first alone is walked. A histogram of each whole set bounds the overlap from above as well. What survives is
   verified on the whole sets: first the best candidate of each class and component, then, with the
   components joined anew, all that is left.

Every pair of linked classes is either in one component or met in the last walk, so the components
are exact. No group is gathered whole, and members of a family are not paired off.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphie.llm.shared import stored
from graphie.llm.toxicity import pieces

GRAM = 4
NEEDED = (85, 100)
COUNTED = 0.2  # the share of a set, by hash, in which frequent tokens are looked for
FREQUENT, MOST_FREQUENT = 32, 1 << 18
BLOCK = 2000
BEFORE, DEPTH = 8, 40  # tokens of a prefix that travel with one of its tokens: some before it, and the depth of a tree
BUCKETS = 64
PART = 3  # a set is laid open to this part of its prefix more
ROUNDS = 2  # how often classes without partners are left out before a walk
PIECE = 1 << 19  # bytes of text hashed side by side: about what a core holds in its cache
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_CODES = np.arange(1, 257, dtype=np.uint64)
_CODES[65:91] += np.uint64(32)
_CODES[[32, *range(9, 14)]] = 0  # the six spaces
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * _M1
    x = x ^ (x >> np.uint64(29))
    x = x * _M2
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, kept between calls."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((int(_M1), pow(int(_M1), -1, 1 << 64))):
            _POWERS[k] = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, base, np.uint64)])
    return _POWERS


def gram_sets(texts: list[str | None], gram: int = GRAM) -> list[np.ndarray]:
    """For each text the sorted distinct 63-bit hashes of its word n-grams; of the whole sequence with fewer words.

    All texts are hashed side by side: a word is the difference of running polynomial sums, A-Z lower-cased.
    """
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    firsts = np.cumsum([0, *(len(x) + 1 for x in parts)])
    codes = _CODES[np.frombuffer(b" ".join([*parts, b""]), np.uint8)]
    ahead, back = _powers(len(codes) + 1)
    word = np.r_[False, codes > 0, False]
    starts, ends = np.flatnonzero(word[1:] & ~word[:-1]), np.flatnonzero(word[:-1] & ~word[1:])
    codes *= ahead[: len(codes)]
    sums = np.r_[np.uint64(0), np.cumsum(codes)]
    w = _mixed((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64) * _M2)

    def grams(w: np.ndarray, k: int) -> np.ndarray:
        h = np.full(max(0, len(w) - k + 1), np.uint64(k), np.uint64)
        for i in range(k):
            h = _mixed(h * _M2 + w[i : len(h) + i])
        return (h >> np.uint64(1)).astype(np.int64)

    of_text = np.searchsorted(starts, firsts)
    every, out = grams(w, gram), []
    for a, b in zip(of_text[:-1].tolist(), of_text[1:].tolist()):
        if b - a >= gram:
            h = np.sort(every[a : b - gram + 1])
            out.append(h[np.r_[True, h[1:] != h[:-1]]])
        else:
            out.append(grams(w[a:b], b - a) if b > a else np.zeros(0, np.int64))
    return out


def gram_set(text: str | None, gram: int = GRAM) -> np.ndarray:
    return gram_sets([text], gram)[0]


def histogram(tokens: np.ndarray) -> np.ndarray:
    """Numbers of tokens in ``BUCKETS`` classes of hashes; all 255 for a set with a larger one."""
    counts = np.bincount(tokens & (BUCKETS - 1), minlength=BUCKETS)
    return np.where(counts.max() > 255, 255, counts).astype(np.uint8)


def set_id(tokens: np.ndarray) -> int:
    """A 64-bit digest of a set."""
    if not len(tokens):
        return 0
    t = tokens.astype(np.uint64)
    total, odd = _mixed(t + _M2).sum(dtype=np.uint64, keepdims=True), np.bitwise_xor.reduce(_mixed(t ^ _M1), keepdims=True)
    return int((_mixed(total * _M1 + odd) ^ np.uint64(len(t))).astype(np.int64)[0])


class Link(NamedTuple):
    """Sets are linked whose intersection is at least ``part / whole`` of their union."""

    part: int = NEEDED[0]
    whole: int = NEEDED[1]

    def least_overlap(self, a: int, b: int) -> int:
        """Shared tokens without which whole * intersection < part * union."""
        return -(-self.part * (a + b) // (self.whole + self.part))

    def prefix_length(self, n: int) -> int:
        return n - -(-self.part * n // self.whole) + 1

    def reach(self, n: int) -> int:
        first = self.prefix_length(n) if n else 0
        return min(n, first + first // PART + 1)

    def spare(self, n: str) -> Column:
        """Tokens that a linked set of ``n`` tokens may have for itself: one fewer than its prefix."""
        return F.expr(f"bigint({n}) * {self.whole - self.part} div {self.whole}")

    def enough(self, shared: str | Column, n: str = "n") -> Column:
        """Whether so many shared tokens among those laid open leave a link possible."""
        first = self.spare(n) + 1
        return F.least(F.col(n), first + F.floor(first / PART) + 1) - shared <= self.spare(n)


def _text_map(docs: DataFrame, schema: str, row, keys: int, gram: int):
    """mapInArrow over rows whose last column is a text; ``row(keys..., set)`` gives the output rows."""
    names = [x.strip().split(" ")[0] for x in schema.split(", ")]
    of = {"bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64()), "binary": pa.binary()}
    kinds = [of[x.strip().split(" ")[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in pieces(batch.column(keys), PIECE):
                cols = [batch.column(i).slice(at, n).to_pylist() for i in range(keys)]
                out = [row(*r) for r in zip(*cols, gram_sets(batch.column(keys).slice(at, n).to_pylist(), gram))]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    return docs.mapInArrow(run, schema)


def frequent_tokens(docs: DataFrame, text: str, gram: int = GRAM) -> np.ndarray:
    """Up to ``MOST_FREQUENT`` tokens of the most documents, sorted. They only set the order: any choice is right."""

    def row(tokens):
        return (tokens[: int(len(tokens) * COUNTED) + 1],)

    tokens = _text_map(docs.select(F.col(text).alias("t")), "tokens array<bigint>", row, 0, gram).select(F.explode("tokens").alias("token"))
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > FREQUENT)
    top = often.orderBy(F.desc("c"), "token").limit(MOST_FREQUENT).select("token").toArrow()
    return np.sort(top.column(0).to_numpy().astype(np.int64))


def ordered(tokens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Keys of a sorted set whose signed order is the global one: frequent tokens, which are not negative, last."""
    if not len(frequent):
        return tokens - (1 << 62) - (1 << 62)
    at = np.searchsorted(frequent, tokens)
    hot = frequent[np.minimum(at, len(frequent) - 1)] == tokens
    return np.r_[tokens[~hot] - (1 << 62) - (1 << 62), tokens[hot]]


def components(edges: DataFrame) -> DataFrame:
    """``v, label``: the smallest vertex of each component, for undirected ``a, b``; smallest labels with pointer jumps."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).toDF("v", "u").distinct(), "edges")
    labels = stored(both.groupBy("v").agg(F.min("u").alias("u")).select("v", F.least("v", "u").alias("label")), "labels")
    while True:
        seen = labels.select(F.col("v").alias("u"), F.col("label").alias("near"))
        low = both.join(seen, "u").groupBy("v").agg(F.min("near").alias("near"))
        step = labels.join(low, "v").select("v", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("v").alias("low"), F.col("label").alias("far"))
        step = step.join(jump, "low").select("v", F.least("low", "far").alias("new"), "label")
        step = stored(step, "labels")
        labels = step.select("v", F.col("new").alias("label"))
        if not step.filter("new != label").limit(1).count():
            return labels


def _possible(link: Link):
    """Pairs whose lengths and histograms leave the needed overlap possible. Columns a, b, n_a, n_b, h_a, h_b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = (batch.column(i).to_numpy() for i in (2, 3))
            keep = bound(_histograms(batch.column(4).to_pylist()), _histograms(batch.column(5).to_pylist())) >= link.least_overlap(n_a, n_b)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _histograms(cells: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(cells), np.uint8).reshape(-1, BUCKETS)


def bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of least bucket numbers bound an overlap from above; two sets too large for the buckets have no bound."""
    full = (a == 255).all(axis=-1) & (b == 255).all(axis=-1)
    return np.where(full, 1 << 40, np.minimum(a, b).sum(axis=-1, dtype=np.int64))


def reachable(a: tuple, b: tuple, link: Link) -> bool:
    """Whether two sets can overlap enough, each (size, tokens, places, end), where no token before the first is shared.

    Up to the smaller reach of the two in the global order all shared tokens are known; after it at
    most as many follow as are left of either set. ``end`` is the place after the last token known.
    """
    (n_a, t_a, p_a, end_a), (n_b, t_b, p_b, end_b) = a, b
    if link.whole * min(n_a, n_b) < link.part * max(n_a, n_b):
        return False
    at = {t: p for t, p in zip(t_b, p_b)}
    common = [(p, at[t]) for t, p in zip(t_a, p_a) if t in at]
    if not common:
        return False
    last_a, last_b = common[-1]
    most = len(common) + max(min(n_a - end_a, n_b - last_b - 1), min(n_a - last_a - 1, n_b - end_b))
    return most >= link.least_overlap(n_a, n_b)


class Tree:
    """Prefixes of one token's classes: nodes by token, with the classes that end there, and all below as bits.

    A node that one class alone passes holds the rest of its prefix as a list.
    """

    __slots__ = ("below", "ends", "bits", "sole", "rest")

    def __init__(self, sole: int | None = None, rest: list[int] | None = None):
        self.below: dict[int, Tree] = {}
        self.ends: list[int] = []
        self.bits = 0 if sole is None else 1 << sole
        self.sole, self.rest = sole, rest

    def add(self, tokens: list[int], member: int) -> None:
        node, i = self, 0
        while True:
            if not node.bits:
                node.__init__(member, tokens[i:])
                return
            if node.rest:
                node.below[node.rest[0]] = Tree(node.sole, node.rest[1:])
            elif node.rest is not None:
                node.ends.append(node.sole)
            node.rest = None
            node.bits |= 1 << member
            if i == len(tokens):
                node.ends.append(member)
                return
            node, i = node.below.setdefault(tokens[i], Tree()), i + 1


def walk(tree: Tree, tokens: list[int], places: list[int], n: int, token: int, wanted: int, link: Link) -> list[int]:
    """The wanted classes (bits) that the tree cannot rule out for a set of ``n`` tokens with this prefix from ``token`` on.

    A subtree is left when nothing wanted is below, or when the tokens of the walker that were passed
    over leave fewer than it must share with any partner.
    """
    index = {t: p for t, p in zip(tokens, places)}
    part, whole = link
    found: list[int] = []
    todo = [(tree, 0)]
    while todo:
        node, shared = todo.pop()
        if node.rest is not None:
            for t in node.rest:
                place = index.get(t)
                if place is not None:
                    if not (shared or t == token) or whole * (shared + n - place) < part * n:
                        break
                    shared += 1
            else:
                if shared and wanted >> node.sole & 1:
                    found.append(node.sole)
            continue
        if shared:
            found += [m for m in node.ends if wanted >> m & 1]
        for t, below in node.below.items():
            if not below.bits & wanted:
                continue
            place = index.get(t)
            if place is None:
                todo.append((below, shared))
            elif (shared or t == token) and whole * (shared + n - place) >= part * n:
                todo.append((below, shared + 1))
    return found


def fitting(h: np.ndarray, n: np.ndarray, label: np.ndarray, m: int, link: Link) -> np.ndarray:
    """Rows (first m classes, then walkers) that a row of the other kind fits by size, component and histogram.

    Rows are met by size, first in a quarter of the buckets, which are sums (one bucket of all pairs at a time), then in
    all; of the pairs whose rows both fit something already, none is met again.
    """
    classes, walkers = np.argsort(n[:m], kind="stable"), m + np.argsort(n[m:], kind="stable")
    sizes, rough = n[classes], h.reshape(len(h), -1, 4).sum(axis=2, dtype=np.uint16).T  # 64 * 255 fits
    rough_w, rough_c = np.ascontiguousarray(rough[:, walkers]), np.ascontiguousarray(rough[:, classes])
    full = (h == 255).all(axis=1)
    part, whole = link
    seen = np.zeros(len(h), bool)
    for at in range(0, len(walkers), 64):
        w = walkers[at : at + 64]
        low, high = np.searchsorted(sizes, -(-part * n[w[0]] // whole)), np.searchsorted(sizes, whole * n[w[-1]] // part, "right")
        for first in range(low, high, 2048):
            c = classes[first : min(high, first + 2048)]
            most = np.zeros((len(w), len(c)), np.uint16)
            for a, b in zip(rough_w, rough_c):
                most += np.minimum(a[at : at + 64, None], b[first : first + len(c)])
            can = most * np.int64(part + whole) >= part * (n[w][:, None] + n[c])
            can |= full[w][:, None] & full[c]
            can &= label[w][:, None] != label[c]
            i, j = np.nonzero(can)
            i, j = w[i], c[j]
            while len(i):
                open_ = ~(seen[i] & seen[j])
                i, j = i[open_], j[open_]
                x, y = i[:4096], j[:4096]
                ok = bound(h[x], h[y]) >= link.least_overlap(n[x], n[y])
                seen[x[ok]] = seen[y[ok]] = True
                i, j = i[4096:], j[4096:]
    return np.flatnonzero(seen)


def _screened(link: Link):
    """Rows of (token, block) that some row of another component and fitting histogram stands against."""
    names = ["key", "block", "walks", "set_id", "i"]

    def screened(table: pa.Table) -> pa.RecordBatch:
        key, block, walks, n, label = (table.column(c).to_numpy() for c in ("key", "block", "walks", "n", "label"))
        keep = np.zeros(len(key), bool)
        cells = table.column("hist").to_pylist()
        firsts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (block[1:] != block[:-1])])
        for a, b in zip(firsts.tolist(), [*firsts[1:].tolist(), len(key)]):
            m = a + int(np.count_nonzero(~walks[a:b]))  # classes first, then walkers
            if m == b:
                continue
            fits = fitting(_histograms(cells[a:b]), n[a:b], label[a:b], m - a, link)
            keep[a + fits] = True
        out = table.select(names).filter(pa.array(keep)).combine_chunks()
        return out.to_batches()[0] if out.num_rows else pa.RecordBatch.from_pylist([], schema=out.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            key, block = table.column("key").to_numpy(), table.column("block").to_numpy()
            last = np.flatnonzero((key != key[-1]) | (block != block[-1])) if len(key) else []
            cut = int(last[-1]) + 1 if len(last) else 0
            rest = table.slice(cut)
            if cut:
                yield screened(table.slice(0, cut))
        if rest is not None and rest.num_rows:
            yield screened(rest)

    return run


def _meet(best: bool, link: Link):
    """Candidate pairs from rows of (token, block) in order, indexed classes before walkers.

    With ``best``, one candidate for each walker and component, that of the greatest bound; else all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tree, held, matrix, sizes, labels = None, Tree(), [], None, None, None
        for batch in batches:
            out: list[tuple[int, int]] = []
            for token, block, walks, own, n, label, tokens, places, h, *tail in zip(*(batch.column(i).to_pylist() for i in range(11))):
                i, cut = tail
                before, tokens, places = set(tokens[:i]), tokens[i:], places[i:]
                mine = (n, tokens, places, places[-1] + 1 if cut else link.prefix_length(n))
                if (token, block) != key:
                    key, tree, held, matrix = (token, block), Tree(), [], None
                if not walks:
                    tree.add(tokens, len(held))
                    held.append((mine, before, h, label, own))
                    continue
                if matrix is None:
                    matrix = _histograms([x[2] for x in held])
                    sizes, labels = np.array([x[0][0] for x in held]), np.array([x[3] for x in held])
                most = bound(matrix, np.frombuffer(h, np.uint8))
                can = (most >= link.least_overlap(n, sizes)) & (labels != label)
                if not can.any():
                    continue
                found: dict[int, tuple[int, int]] = {}
                wanted = int.from_bytes(np.packbits(can, bitorder="little").tobytes(), "little")
                for i in walk(tree, tokens, places, n, token, wanted, link):
                    # pairs that share a token before this one are met there
                    if before.isdisjoint(held[i][1]) and reachable(mine, held[i][0], link):
                        other = held[i][4]
                        group = int(labels[i]) if best else other
                        found[group] = max(found.get(group, (-1, 0)), (int(most[i]), other))
                out += [(min(own, other), max(own, other)) for _, other in found.values()]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def tree_pairs(nodes: DataFrame, found: DataFrame, best: bool, link: Link) -> DataFrame:
    """Candidates ``a, b`` in different components, for the tokens whose classes are in several."""
    labelled = nodes.join(found.withColumnRenamed("v", "set_id"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    labelled = stored(labelled, "labelled")
    for _ in range(ROUNDS):
        at = labelled.select("set_id", "label", F.explode("token").alias("key"))
        foreign = at.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high").select("key")
        left = at.join(foreign.hint("merge"), "key").groupBy("set_id").agg(F.count(F.lit(1)).alias("c"))
        labelled = stored(labelled.join(left.hint("merge"), "set_id").filter(link.enough(F.col("c"))).drop("c"), "labelled")
    labelled = labelled.withColumns({c: F.slice(c, F.lit(1), F.col("k")) for c in ("token", "place")})
    at = labelled.select("set_id", "label", F.posexplode("token").alias("i", "key"))
    marks = [F.expr(f"sum(cast(xxhash64(set_id, {i}) as decimal(20)))").alias(f"m{i}") for i in (1, 2)]
    per = at.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"), *marks)
    totals = [F.sum(m).alias(m) for m in ("m1", "m2")]
    per = per.groupBy("key").agg(F.sum("c").alias("g"), F.count(F.lit(1)).alias("labels"), F.max(F.struct("c", "label")).alias("m"), *totals).filter("labels > 1")
    # of tokens that the same classes share only the first can be the first that two of them share
    per = per.groupBy("g", "m1", "m2").agg(F.min_by(F.struct("key", "m"), "key").alias("t")).select("g", "t.*")
    per = per.select("key", F.ceil(F.col("g") / F.lit(BLOCK)).alias("blocks"), F.col("m.label").alias("main"))
    at = at.join(per, "key").select("key", "blocks", "set_id", "i", (F.col("label") != F.col("main")).alias("walks"))
    walkers = at.filter("walks").select("key", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"), "walks", "set_id", "i")
    indexed = at.select("key", F.pmod(F.xxhash64("set_id"), "blocks").alias("block"), F.lit(False).alias("walks"), "set_id", "i")
    small = labelled.select("set_id", "n", "label", "hist").hint("merge")
    met = indexed.unionByName(walkers).join(small, "set_id").select("key", "block", "walks", "set_id", "i", "n", "label", "hist")
    met = met.repartition("key", "block").sortWithinPartitions("key", "block", "walks")
    met = met.mapInArrow(_screened(link), "key bigint, block bigint, walks boolean, set_id bigint, i int").join(labelled.hint("merge"), "set_id")
    start = F.greatest(F.col("i") - BEFORE, F.lit(0))
    near = [F.slice(c, start + 1, F.lit(DEPTH)).alias(c) for c in ("token", "place")]
    met = met.select("key", "block", "walks", "set_id", "n", "label", *near, "hist", (F.col("i") - start).alias("i"), (F.size("token") > start + DEPTH).alias("cut"))
    met = met.repartition("key", "block").sortWithinPartitions("key", "block", "walks")
    return met.mapInArrow(_meet(best, link), "a bigint, b bigint")


def verified(pairs: DataFrame, first: DataFrame, docs: DataFrame, key: str, text: str, gram: int, link: Link) -> DataFrame:
    """The pairs ``a, b`` of classes that are linked, by their whole sets. ``first`` has a document of each class."""
    pairs = stored(pairs.distinct(), "pairs")
    needed = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct().join(first, "set_id")
    needed = needed.select("set_id", F.col("first").alias("_first"))
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("t")).join(needed, F.col("_key") == F.col("_first"))

    def row(own, tokens):
        return own, set_id(tokens), tokens

    sets = _text_map(rows.select("set_id", "t"), "set_id bigint, found bigint, tokens array<bigint>", row, 1, gram)
    # an id may be on several rows of different text: only the row of the class counts
    sets = stored(sets.filter("set_id = found").select("set_id", "tokens").dropDuplicates(["set_id"]), "sets")
    both = pairs.join(sets.toDF("a", "t_a").hint("merge"), "a").join(sets.toDF("b", "t_b").hint("merge"), "b")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x, y = (batch.column(c)[i].values.to_numpy() for c in (2, 3))
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(link.whole * same >= link.part * (len(x) + len(y) - same))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return stored(both.select("a", "b", "t_a", "t_b").mapInArrow(linked, "a bigint, b bigint"), "links")


def jaccard_components(docs: DataFrame, text: str = "text", key: str = "doc_id", gram: int = GRAM, needed: tuple[int, int] = NEEDED) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, set_id, component_id``, the smallest id reachable by links.

    Documents are linked when the sets of their word ``gram``-grams have a Jaccard similarity of ``needed``
    (numerator, denominator) or more. Words are runs without the six ASCII spaces, A-Z lower-cased. A null text, or one without words, has
    an empty set and is its own component; so is a row with a null id, which links with nothing. Rows
    that repeat an id are rows of one document each and are linked by their texts. Other columns are ignored.
    """
    link = Link(*needed)
    frequent = frequent_tokens(docs, text, gram)

    def row(own, tokens):
        first = ordered(tokens, frequent)[: link.reach(len(tokens))]
        return own, len(tokens), set_id(tokens), first, histogram(tokens).tobytes()

    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("t"))
    shape = "doc_id bigint, n_shingles bigint, set_id bigint, prefix array<bigint>, hist binary"
    base = stored(_text_map(rows, shape, row, 1, gram), "prefixes")
    member = base.select("doc_id", "n_shingles", "set_id")
    usable = base.filter("doc_id IS NOT NULL AND n_shingles > 0")
    first = usable.groupBy("set_id").agg(F.min("doc_id").alias("first"), F.first("hist").alias("hist"))
    first = stored(first, "classes")

    each = usable.select("set_id", F.col("n_shingles").alias("n"), F.posexplode("prefix").alias("place", "token"))
    # the classes of a token are met where its rows lie anyway: one shuffle of all tokens, not one for each side of a join
    of_token = Window.partitionBy("token")
    shared = each.withColumns({"low": F.min("set_id").over(of_token), "high": F.max("set_id").over(of_token)}).filter("low != high")
    nodes = shared.groupBy("set_id", "n").agg(F.sort_array(F.collect_set(F.struct("place", "token"))).alias("p"))
    nodes = nodes.filter(link.enough(F.size("p"))).select("set_id", F.col("n").cast("int").alias("n"), "p.place", "p.token")
    nodes = nodes.withColumn("k", F.size(F.filter("place", lambda x: x <= link.spare("n")))).join(first.hint("merge"), "set_id")
    nodes = stored(nodes.withColumn("alone", link.spare("n") + 1 - F.col("k")), "nodes")

    # 1. stars
    at = nodes.select("set_id", "alone", F.explode(F.slice("token", F.lit(1), F.col("k"))).alias("token"))
    centre = at.groupBy("token").agg(F.min(F.struct("alone", "set_id")).alias("c")).select("token", F.col("c.set_id").alias("centre"))
    votes = at.join(centre.hint("merge"), "token").filter("set_id != centre").groupBy("set_id", "centre").agg(F.count(F.lit(1)).alias("c"))
    star = votes.groupBy("set_id").agg(F.max(F.struct("c", "centre")).alias("v")).select(F.col("set_id").alias("a"), F.col("v.centre").alias("b"))
    sides = [nodes.select(F.col("set_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("hist").alias(f"h_{x}")).hint("merge") for x in "ab"]
    star = star.join(sides[0], "a").join(sides[1], "b").select("a", "b", "n_a", "n_b", "h_a", "h_b")
    links = verified(star.mapInArrow(_possible(link), "a bigint, b bigint"), first, docs, key, text, gram, link)
    found = components(links)

    # 2. trees
    for best in (True, False):
        more = verified(tree_pairs(nodes, found, best, link), first, docs, key, text, gram, link)
        if more.limit(1).count():
            links = links.union(more)
            found = components(links)

    labels = member.join(found.withColumnRenamed("v", "set_id"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    lowest = labels.filter(~alone).groupBy("label").agg(F.min("doc_id").alias("lowest"))
    out = labels.join(lowest, "label", "left")
    return out.select("doc_id", "n_shingles", "set_id", F.when(alone, F.col("doc_id")).otherwise(F.col("lowest")).alias("component_id"))


def first_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", gram: int = GRAM, needed: tuple[int, int] = NEEDED) -> DataFrame:
    """The documents with one kept of each component: that of the smallest id, and of rows repeating it the first text."""
    found = jaccard_components(docs, text, key, gram, needed).select(F.col("doc_id").alias("_doc"), "component_id").filter("_doc != component_id")
    drop = found.select("_doc").distinct()
    return docs.join(drop, F.col(key) == F.col("_doc"), "left_anti")
