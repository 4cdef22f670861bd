"""Embedding whitening by contour integration (FEAST).

Vectors are cast to whole numbers x. One pass counts them and sums them, a second sums the products of centred entries; both are
exact, since batches multiply numbers small enough for doubles to hold the products, and partial sums go on as pairs of 64-bit
numbers. So the covariance V is exact but for one rounding an entry, and the driver holds d x d numbers and nothing of the rows.

Its largest eigenvalues are cut into intervals of at most ``IN_INTERVAL`` by inertia: the number of negative pivots of the
symmetric factorisation of V - s is the number of eigenvalues below s. Each interval is a Spark task of its own. It projects a
random block onto the interval's eigenvectors by quadrature along a circle around it: a weighted sum of solves with the complex
matrices z - V. Rayleigh-Ritz takes Ritz pairs from the projected block, which is projected again until the pairs inside the
interval are as many as the inertia counted, and their residual no longer shrinks. A last Rayleigh-Ritz over all intervals' vectors
makes them orthogonal to each other. A third pass whitens all rows and measures their covariance; a fourth returns them.

Defined results: rows whose vector is null, or holds a null or non-finite entry, or one beyond ``LARGEST`` in size (no exact
products then), are dropped. An empty vector has no component and so no row. Vectors of each length are a fit list of their own,
with their own n. Components with an eigenvalue that is zero but for rounding (fewer rows than dimensions, constant dimensions)
can't be whitened and are left out. Equal eigenvalues have some orthonormal basis of their space. A deviation beyond 64 bits is
null. Repeated rows and ids, null ids included, each keep their rows; an empty table has none. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionmill.llm.common import small_batches

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
LARGEST = 2.0**25 / SCALE - 1
NODES, IN_INTERVAL, ROUNDS = 12, 8, 60
_LOW = 1 << 32


def vectors(table: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, x) of the rows that stay; x: whole numbers."""
    v = F.col("embedding").cast("array<double>")
    fine = F.size(v) > 0
    fine &= F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST)), F.lit(False))
    return table.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.coalesce(fine, F.lit(False)), F.transform(v, lambda c: F.floor(c * scale) + shift)).alias("x")).where("x is not null")


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of each length in a batch."""
    lists = batch.column("x")
    at = lists.offsets.to_numpy().astype(np.int64)
    flat, size = lists.values.to_numpy(), np.diff(at)
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        yield rows, flat[at[rows][:, None] + np.arange(d)]


def split(total: list[int]) -> tuple[list[int], list[int]]:
    """High and low parts of whole numbers of any size, so that sums of parts don't overflow."""
    return [t >> 32 for t in total], [t & (_LOW - 1) for t in total]


def summed(parts: DataFrame) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Sums of partial rows (d, i, n, high, low) by (d, i), in two levels, so that no group grows with the number of tasks."""

    def add(group: pa.Table) -> pa.Table:
        total = lambda c: np.sum(group[c].combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1), 0)
        low = total("low")
        high, low = total("high") + (low >> 32), low & (_LOW - 1)
        first = lambda c: group[c].slice(0, 1)
        return pa.table({"d": first("d"), "i": first("i"), "lot": first("lot"), "n": pa.array([sum(group["n"].to_pylist())], pa.int64()), "high": pa.array([high.tolist()], pa.list_(pa.int64())), "low": pa.array([low.tolist()], pa.list_(pa.int64()))})

    schema = "d int, i int, lot int, n long, high array<long>, low array<long>"
    some = parts.groupBy("d", "i", "lot").applyInArrow(add, schema)
    rows = some.withColumn("lot", F.lit(0)).groupBy("d", "i", "lot").applyInArrow(add, schema).collect()  # a row of d numbers for each dimension
    return {(r["d"], r["i"]): (r["n"], [(h << 32) + low for h, low in zip(r["high"], r["low"], strict=True)]) for r in rows}


def rows_of(found: dict[int, tuple[int, list[list[int]]]]) -> Iterator[pa.RecordBatch]:
    """A task's partial sums as rows."""
    lot = TaskContext.get().partitionId() % 64
    for d, (n, matrix) in found.items():
        both = [split(r) for r in matrix]
        of = lambda k: pa.array([b[k] for b in both], pa.list_(pa.int64()))  # noqa: E731, B023
        yield pa.record_batch({"d": pa.array([d] * len(matrix), pa.int32()), "i": pa.array(range(len(matrix)), pa.int32()), "lot": pa.array([lot] * len(matrix), pa.int32()), "n": pa.array([n] * len(matrix), pa.int64()), "high": of(0), "low": of(1)})


_PARTS = "d int, i int, lot int, n long, high array<long>, low array<long>"


def products(z: np.ndarray) -> np.ndarray:
    """Exact z'z of whole numbers below 2^26 in size: doubles hold what each slice adds up to."""
    most = max(1, int(np.abs(z).max()))
    step = max(1, (1 << 53) // (most * most))
    total = np.zeros((z.shape[1], z.shape[1]), dtype=object if len(z) * most * most >= 1 << 62 else np.int64)
    for at in range(0, len(z), step):
        part = z[at : at + step].astype(np.float64)
        total += (part.T @ part).astype(np.int64)
    return total


def moments(x: DataFrame) -> dict[int, tuple[int, list[int], np.ndarray]]:
    """By length d: n, the sums S, and V."""

    def sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, list[list[int]]]] = {}
        for batch in it:
            for _, m in by_length(batch):
                n, total = found.get(m.shape[1], (0, [[0] * m.shape[1]]))
                found[m.shape[1]] = (n + len(m), [[a + b for a, b in zip(total[0], m.sum(0).tolist(), strict=True)]])
        yield from rows_of(found)

    first = {d: v for (d, _), v in summed(x.mapInArrow(sums, _PARTS)).items()}
    if not first:
        return {}
    centre = {d: np.array([s // n for s in total]) for d, (n, total) in first.items()}  # d numbers a length

    def centred(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        for batch in it:
            for _, m in by_length(batch):
                z = m - centre[m.shape[1]]
                n, s, p = found.get(m.shape[1], (0, 0, 0))
                found[m.shape[1]] = (n + len(z), s + z.sum(0).astype(object), p + products(z).astype(object))
        # the sums of z stand behind the products
        yield from rows_of({d: (n, [*p.tolist(), s.tolist()]) for d, (n, s, p) in found.items()})

    second = summed(x.mapInArrow(centred, _PARTS))
    out = {}
    for d, (n, total) in first.items():
        s = second[d, d][1]
        exact = [[n * p - s[i] * s[j] for j, p in enumerate(second[d, i][1])] for i in range(d)]
        out[d] = (n, total, np.array([[e / (n * n) for e in row] for row in exact]))
    return out


def below(v: np.ndarray, s: float) -> int:
    """Eigenvalues of v below s: negative ones of the block-diagonal factor of v - s (symmetric elimination, pivots of one or two rows)."""
    a, count = v - s * np.eye(len(v)), 0
    while len(a):
        size = len(a)
        own = np.abs(np.diag(a))
        off = np.abs(a - np.diag(np.diag(a)))
        p = int(own.argmax())
        r, c = divmod(int(off.argmax()), size)
        if own[p] >= 0.6404 * off[r, c]:  # (1 + sqrt(17)) / 8
            block, picked = a[p, p], [p]
            if block == 0:
                return count
            count += block < 0
            inverse = np.array([[1 / block]])
        else:
            picked = [r, c]
            pivot = a[np.ix_(picked, picked)]
            count += int((np.linalg.eigvalsh(pivot) < 0).sum())
            inverse = np.linalg.inv(pivot)
        keep = np.setdiff1d(np.arange(size), picked)
        side = a[np.ix_(keep, picked)]
        a = a[np.ix_(keep, keep)] - side @ inverse @ side.T
        a = (a + a.T) / 2
    return count


def intervals(v: np.ndarray, wanted: int, most: int = IN_INTERVAL) -> list[tuple[float, float, int]]:
    """(low, high, count) that together hold the ``wanted`` largest eigenvalues, each at most ``most`` unless they can't be told apart."""
    top = float(np.abs(v).sum(1).max()) * (1 + 1e-9) + np.finfo(float).tiny
    fine = top * 1e-13
    out, todo = [], [(-fine, top, len(v))]
    while todo and sum(c for _, _, c in out) < wanted:
        low, high, count = todo.pop()  # the highest that is left
        if count <= most or high - low <= fine:
            if count:
                out.append((float(low), float(high), int(count)))
            continue
        middle = (low + high) / 2
        upper = min(count, max(0, len(v) - below(v, middle) - sum(c for _, _, c in out)))
        todo += [(low, middle, count - upper), (middle, high, upper)]
    return out


def project(v: np.ndarray, y: np.ndarray, low: float, high: float, nodes: int = NODES) -> np.ndarray:
    """Quadrature (Gauss-Legendre, upper half circle around the interval) of the resolvent times y."""
    x, weight = np.polynomial.legendre.leggauss(nodes)
    angle = np.pi / 2 * (1 - x)
    middle, radius = (low + high) / 2, (high - low) / 2
    out = np.zeros_like(y)
    for t, w in zip(angle, weight, strict=True):
        turn = np.exp(1j * t)
        out += w / 2 * (radius * turn * np.linalg.solve((middle + radius * turn) * np.eye(len(v)) - v, y.astype(complex))).real
    return out


def ritz(v: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rayleigh-Ritz: values and vectors of v in the space of q."""
    q = np.linalg.qr(q)[0]
    value, mix = np.linalg.eigh(q.T @ v @ q)
    return value, q @ mix


def feast(v: np.ndarray, low: float, high: float, count: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The count eigenpairs of v in [low, high)."""
    d = len(v)
    wide = (high - low) / 2 * 1e-3  # the circle stays off the ends
    y = np.random.default_rng(seed).standard_normal((d, min(d, count + max(4, count))))
    best, kept, idle = np.inf, None, 0
    for _ in range(ROUNDS):
        value, vector = ritz(v, project(v, y, low - wide, high + wide))
        inside = np.flatnonzero((value >= low) & (value < high))
        if len(inside) == count:
            rest = np.linalg.norm(v @ vector[:, inside] - vector[:, inside] * value[inside], axis=0).max()
            idle = 0 if rest < 0.9 * best else idle + 1
            if rest < best:
                best, kept = rest, (value[inside], vector[:, inside])
            if idle == 3 or rest <= np.finfo(float).eps * high:
                break
        y = vector
    if kept is None:  # values at an end of the interval by rounding: the count that inertia gave, nearest to it
        nearest = np.argsort(np.maximum(low - value, value - high), kind="stable")[:count]
        kept = value[nearest], vector[:, nearest]
    return kept


def components(spark: SparkSession, v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of v, falling, and their unit vectors (columns); those that are zero but for rounding are left out."""
    trace = float(np.trace(v))
    if not trace > 0:
        return np.zeros(0), np.zeros((len(v), 0))
    cut = intervals(v, min(wanted, len(v)))
    shared = spark.sparkContext.broadcast(v)  # d x d numbers

    def solve(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for r in batch.to_pylist():
                value, vector = feast(shared.value, r["low"], r["high"], r["n"])
                yield pa.record_batch({"value": pa.array(value), "vector": pa.array(vector.T.tolist(), pa.list_(pa.float64()))})

    asked = spark.createDataFrame(cut, "low double, high double, n int").repartition(len(cut), "low")
    rows = asked.mapInArrow(solve, "value double, vector array<double>").collect()  # at most d vectors
    value, vector = ritz(v, np.array([r["vector"] for r in rows]).T)
    order = np.argsort(-value, kind="stable")[:wanted]
    value, vector = value[order], vector[:, order]
    stay = value > trace * len(v) * np.finfo(float).eps
    return value[stay], vector[:, stay]


def whiten(table: DataFrame, wanted: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each row (vec_id, embedding) and component."""
    spark = table.sparkSession
    small_batches(spark)
    x = vectors(table, scale, shift)
    fitted = {}
    for d, (n, total, v) in moments(x).items():
        value, vector = components(spark, v, wanted)
        centre = [s // n for s in total]
        offset = np.array([(s - n * c) / n for s, c in zip(total, centre, strict=True)])
        fitted[d] = (n, total, np.array(centre), offset, vector / np.sqrt(value), value / max(float(np.trace(v)), np.finfo(float).tiny))
    shared = spark.sparkContext.broadcast(fitted)  # d x wanted numbers a length

    def white(m: np.ndarray) -> np.ndarray:
        _, _, centre, offset, basis, _ = shared.value[m.shape[1]]
        return (m - centre - offset) @ basis

    def spread(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        for batch in it:
            for _, m in by_length(batch):
                w = white(m)
                n, s, p = found.get(m.shape[1], (0, 0.0, 0.0))
                found[m.shape[1]] = (n + len(w), s + w.sum(0), p + w.T @ w)
        for d, (n, s, p) in found.items():
            yield pa.record_batch({"d": pa.array([d], pa.int32()), "n": pa.array([n], pa.int64()), "s": pa.array([s.tolist()], pa.list_(pa.float64())), "p": pa.array([p.ravel().tolist()], pa.list_(pa.float64()))})

    both = x.mapInArrow(spread, "d int, n long, s array<double>, p array<double>").withColumn("lot", F.spark_partition_id() % 64)

    def add(group: pa.Table) -> pa.Table:
        total = lambda c: pa.array([np.sum(np.array(group[c].to_pylist(), dtype=np.float64).reshape(group.num_rows, -1), 0).tolist()], pa.list_(pa.float64()))
        return pa.table({"d": group["d"].slice(0, 1), "lot": group["lot"].slice(0, 1), "n": pa.array([sum(group["n"].to_pylist())], pa.int64()), "s": total("s"), "p": total("p")})

    schema = "d int, lot int, n long, s array<double>, p array<double>"
    errors = [0.0]
    for r in both.groupBy("d", "lot").applyInArrow(add, schema).withColumn("lot", F.lit(0)).groupBy("d", "lot").applyInArrow(add, schema).collect():  # one row a length
        s = np.array(r["s"]) / r["n"]
        p = np.array(r["p"]).reshape(len(s), len(s)) / r["n"]
        errors.append(float(np.abs(p - np.outer(s, s) - np.eye(len(s))).max(initial=0.0)))
    error = max(errors)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids = batch.column("vec_id")
            for rows, m in by_length(batch):
                n, total, centre, _, basis, share = shared.value[m.shape[1]]
                k = basis.shape[1]
                out = [deviation(m, n, total, centre), np.repeat(rows, k)]
                yield pa.record_batch(
                    {
                        "vec_id": ids.take(pa.array(out[1])),
                        "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(m))),
                        "n": pa.array(np.full(len(m) * k, n)),
                        "deviation": pa.array([x for x in out[0] for _ in range(k)], pa.int64()),
                        "whitened": pa.array(white(m).ravel()),
                        "explained": pa.array(np.tile(share, len(m))),
                        "identity_error": pa.array(np.full(len(m) * k, error)),
                    }
                )

    return x.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def deviation(m: np.ndarray, n: int, total: list[int], centre: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; null beyond 64 bits."""
    z, left = m - centre, np.array([s - n * int(c) for s, c in zip(total, centre, strict=True)], dtype=np.int64)
    most = n * (int(np.abs(z).max()) + 1)
    if most * most * m.shape[1] < 1 << 63:
        return ((n * z - left) ** 2).sum(1).tolist()
    exact = [sum((n * a - b) ** 2 for a, b in zip(row, left.tolist(), strict=True)) for row in z.tolist()]
    return [e if e < 1 << 63 else None for e in exact]


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    """All embeddings on their 32 largest components, whitened."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
