"""Embedding whitening from an exact scatter matrix in bit slices.

Entries become whole numbers floor(64 * c) + 1000000. A task takes its vectors in chunks of
``CHUNK`` entries. In a chunk each dimension is shifted by its smallest value, and every bit of the
shifted numbers becomes a plane: one bit a row, packed into 64-bit words. The sum of products of two
dimensions is then the sum over pairs of planes of 2^(a+b) times the number of ones in their AND.
Chunks add up exactly; the sums of all tasks are added as decimals. Centring is done on whole
numbers, n * sum(x_i x_j) - S_i S_j, and only that matrix is turned into doubles for ``eigh``.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphie.llm.shared import stored

SCALE, OFFSET = 64, 1_000_000
CHUNK, COMPONENTS = 1 << 22, 32
MODEL_BYTES = 64 << 20
EXACT = "decimal(38,0)"


def whole_entries(vectors: np.ndarray) -> np.ndarray:
    """floor(64 * c), without the offset; held within 62 bits."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(vectors * SCALE), -(2.0**62), 2.0**62).astype(np.int64)


def bit_sliced_products(x: np.ndarray) -> np.ndarray:
    """x^T x of whole numbers that are 0 or more, by AND and popcount; exact, as Python ints."""
    n, d = x.shape
    bits = max(1, int(x.max(initial=0)).bit_length())
    words = -(-n // 64) * 64
    planes = np.zeros((bits, d, words // 64), np.uint64)
    for a in range(bits):
        rows = np.zeros((d, words), np.uint8)
        rows[:, :n] = ((x >> a) & 1).T
        planes[a] = np.packbits(rows, axis=1).view(np.uint64)
    out = np.zeros((d, d), object)
    for i in range(d):
        for a in range(bits):
            ones = np.bitwise_count(planes[:, i:] & planes[a, i]).sum(axis=2, dtype=np.int64)  # bits x dimensions from i on
            weights = np.array([1 << (a + b) for b in range(bits)], object)
            out[i, i:] += (ones.astype(object) * weights[:, None]).sum(axis=0)
    low = np.tril_indices(d, -1)
    out[low] = out.T[low]
    return out


class Moments:
    """Number, sums and sums of products of whole vectors, about the offset."""

    def __init__(self, d: int):
        self.n, self.sums, self.products = 0, np.zeros(d, object), np.zeros((d, d), object)

    def add(self, x: np.ndarray) -> None:
        least = x.min(axis=0)
        y, shift = x.astype(np.uint64) - least.astype(np.uint64), least.astype(object)  # modulo 2^64, so differences hold
        sums = np.array([sum(c.tolist()) for c in y.T] if y.max(initial=0) >= 2**32 else y.sum(axis=0).tolist(), object)
        self.n += len(x)
        self.sums += sums + len(x) * shift
        self.products += bit_sliced_products(y) + np.outer(shift, sums) + np.outer(sums, shift) + len(x) * np.outer(shift, shift)


def _by_dimension(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Dimension, row numbers and values of the vectors of each length in a batch."""
    vectors = batch.column(column)
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    values, starts = vectors.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(sizes)[:-1]]
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        yield d, rows, values[(starts[rows][:, None] + np.arange(d)).astype(np.int64)].reshape(len(rows), d)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``dim, i, j, s``: s is n for i = -1, the sum of i for j = -1, else the sum of products."""
    waiting: dict[int, list[np.ndarray]] = {}
    moments: dict[int, Moments] = {}

    def take(d: int) -> None:
        if parts := waiting.pop(d, None):
            moments.setdefault(d, Moments(d)).add(np.concatenate(parts))

    for batch in batches:
        for d, _, values in _by_dimension(batch, 0):
            waiting.setdefault(d, []).append(whole_entries(values))
            if sum(map(len, waiting[d])) * d >= CHUNK:
                take(d)
    for d in list(waiting):
        take(d)
    for d, m in moments.items():
        rows = [(-1, -1, m.n)] + [(i, -1, m.sums[i]) for i in range(d)] + [(i, j, m.products[i, j]) for i in range(d) for j in range(i, d)]
        i, j, s = zip(*rows)
        columns = [pa.array([d] * len(rows), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(list(map(Decimal, s)), pa.decimal128(38, 0))]
        yield pa.RecordBatch.from_arrays(columns, names=["dim", "i", "j", "s"])


def usable_vectors(table: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, v``: vectors without null or non-finite entries; empty ones are left out as well."""
    x = F.col(f"`{vector}`")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    return table.filter(x.isNotNull() & (F.size(x) > 0)).filter(finite).select(F.col(f"`{key}`").alias("vec_id"), x.cast("array<double>").alias("v"))


def scatter(vectors: DataFrame) -> DataFrame:
    """``dim, i, j, s`` over all vectors of each length: exact sums, about the offset."""
    return vectors.select("v").mapInArrow(_sums, f"dim int, i int, j int, s {EXACT}").groupBy("dim", "i", "j").agg(F.sum("s").cast(EXACT).alias("s"))


def _components(most: int):
    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        d = int(rows["dim"].iloc[0])
        sums, products, n = [0] * d, np.zeros((d, d), object), 0
        for i, j, s in zip(rows["i"], rows["j"], rows["s"]):
            if i < 0:
                n = int(s)
            elif j < 0:
                sums[i] = int(s)
            else:
                products[i, j] = products[j, i] = int(s)
        centred = n * products - np.outer(np.array(sums, object), np.array(sums, object))  # n^2 times the covariance
        covariance = np.array([[float(Decimal(c) / (n * n)) for c in row] for row in centred])
        values, vectors = np.linalg.eigh(covariance)
        trace = float(Decimal(int(np.trace(centred))) / (n * n))
        out = []
        for c in range(min(most, d)):
            e, u = float(values[d - 1 - c]), vectors[:, d - 1 - c]
            u = u if u[np.argmax(np.abs(u))] > 0 else -u
            alive = e > values[-1] * d * 1e-13
            out.append((d, c + 1, n, [str(s) for s in sums], e if alive else 0.0, max(e, 0.0) / trace if trace else 0.0, u.tolist()))
        return pd.DataFrame(out, columns=["dim", "component", "n", "sums", "e", "explained", "u"])

    return solve


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``dim, component, n, sums, e, explained, u`` of ``usable_vectors``, written once, so signs hold for all readers.

    Vectors of each length are a fit list of their own. ``sums`` are exact and about the offset.
    Components whose eigenvalue is no more than rounding count as e = 0. A tie between eigenvalues
    leaves the choice of vectors in their plane to ``eigh``.
    """
    kinds = "dim int, component int, n bigint, sums array<string>, e double, explained double, u array<double>"
    return stored(scatter(vectors).groupBy("dim").applyInPandas(_components(components), kinds), "whitening")


def _projected(models: dict[int, dict], x: np.ndarray) -> np.ndarray:
    """Whitened rows; 0 for components without variance."""
    m = models[x.shape[1]]
    shifted = x.astype(object) * m["n"] - m["sums"] if m["wide"](x) else x * m["n"] - m["small"]
    return (shifted.astype(float) / m["n"]) @ m["axes"]


def _loaded(rows) -> dict[int, dict]:
    models: dict[int, dict] = {}
    for r in rows:
        models.setdefault(r["dim"], {"rows": []})["rows"].append(r)
    for d, m in models.items():
        own = sorted(m.pop("rows"), key=lambda r: r["component"])
        m["n"], m["sums"] = own[0]["n"], np.array([int(s) for s in own[0]["sums"]], object)
        far = max(abs(s) for s in m["sums"])
        m["small"] = m["sums"].astype(np.int64) if far < 2**62 else None
        m["axes"] = np.array([np.array(r["u"]) / np.sqrt(r["e"]) if r["e"] > 0 else np.zeros(d) for r in own]).T
        m["live"] = [r["e"] > 0 for r in own]
        m["component"], m["explained"] = [r["component"] for r in own], [r["explained"] for r in own]
        n, big = m["n"], m["small"] is None
        # beyond 64 bits (also the sum of squares): Python's whole numbers
        m["wide"] = lambda x, n=n, far=far, big=big: big or (n * int(np.abs(x).max(initial=0)) + far) ** 2 * x.shape[1] >= 2**63
    return models


def _checked(packed: list):
    """Sums of products of the whitened rows of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, sums = _loaded(packed), {}
        for batch in batches:
            for d, _, values in _by_dimension(batch, 0):
                if d in models:
                    z = _projected(models, whole_entries(values))
                    s, p = sums.get(d, (0, 0))
                    sums[d] = s + z.sum(axis=0), p + z.T @ z
        for d, (s, p) in sums.items():
            live = np.flatnonzero(models[d]["live"])
            rows = [(d, int(i), -1, float(s[i])) for i in live] + [(d, int(i), int(j), float(p[i, j])) for i in live for j in live if i <= j]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.float64()))], names=["dim", "i", "j", "s"])

    return run


def _whitened(packed: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = _loaded(packed)
        for batch in batches:
            for d, rows, values in _by_dimension(batch, 1):
                if d not in models:
                    continue
                m, x = models[d], whole_entries(values)
                wide = m["wide"](x)
                shifted = x.astype(object) * m["n"] - m["sums"] if wide else x * m["n"] - m["small"]
                deviation = (shifted * shifted).sum(axis=1)
                c, z = len(m["component"]), _projected(models, x)
                n, each = len(rows) * c, pa.array(np.repeat(np.arange(len(rows)), c))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(np.repeat(rows, c))), pa.array(np.full(n, d), pa.int32()), pa.array(np.tile(m["component"], len(rows)), pa.int32()),
                    pa.array(np.full(n, m["n"]), pa.int64()), pa.array([Decimal(int(v)) for v in deviation], pa.decimal128(38, 0)).take(each),
                    pa.array(z.ravel()), pa.array(np.tile(m["explained"], len(rows))),
                ], names=["vec_id", "dim", "component", "n", "deviation", "whitened", "explained"])

    return run


def whiten(vectors: DataFrame, model: DataFrame) -> DataFrame:
    """``vec_id, dim, component, n, deviation, whitened, explained, identity_error`` of each vector and component.

    A component without variance gives 0.0. ``identity_error`` is measured on the whitened values of
    these vectors, over the components that have variance: the largest entry of their covariance
    minus the identity (0.0 where no component has any). Repeated rows are rows of their own. Lengths
    the model does not know give no rows. The model is sent to tasks for so many lengths at a time
    that it stays within ``MODEL_BYTES``.
    """
    sizes = model.groupBy("dim").agg((F.count(F.lit(1)) * F.first("dim") * 8 + F.first("dim") * 64).alias("b")).orderBy("dim").collect()
    groups, size = [[]], 0
    for d, b in sizes:
        if groups[-1] and size + b > MODEL_BYTES:
            groups.append([])
            size = 0
        groups[-1].append(d)
        size += b
    done = None
    key = vectors.schema["vec_id"].dataType.simpleString()
    for dims in groups:
        packed = model.filter(F.col("dim").isin(dims)).collect() if dims else []
        mine = vectors.filter(F.size("v").isin(dims)) if len(groups) > 1 else vectors
        sums = mine.select("v").mapInArrow(_checked(packed), "dim int, i int, j int, s double").groupBy("dim", "i", "j").agg(F.sum("s").alias("s"))
        counts = {r["dim"]: r["n"] for r in packed}
        n = F.element_at(F.create_map(*[F.lit(x) for p in counts.items() for x in p]), F.col("dim")) if counts else F.lit(1)
        means = sums.filter("j < 0").select("dim", "i", (F.col("s") / n).alias("mean"))
        off = (
            sums.filter("j >= 0").join(means, ["dim", "i"]).join(means.toDF("dim", "j", "mean_j"), ["dim", "j"])
            .groupBy("dim").agg(F.max(F.abs(F.col("s") / n - F.col("mean") * F.col("mean_j") - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))).alias("identity_error"))
        )
        out = mine.select("vec_id", "v").mapInArrow(_whitened(packed), f"vec_id {key}, dim int, component int, n bigint, deviation {EXACT}, whitened double, explained double")
        out = out.join(F.broadcast(off), "dim", "left").withColumn("identity_error", F.coalesce("identity_error", F.lit(0.0)))  # one row a length of the group
        done = out if done is None else done.unionByName(out)
    return done
