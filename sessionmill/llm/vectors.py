"""Embedding near-duplicates by product quantisation.

A coarse k-means (inverted lists) and, on the residuals, one k-means a subspace
are fitted on a bounded sample; every vector is then indexed: its list, its codes
and the norm of what the codes leave out. A vector is searched in every list that
can hold a neighbour: one whose Voronoi cell is no farther than the radius, by
the distance to the plane between its centroid and the vector's own. In a list,
table look-ups give the distance to the coded vectors; by the triangle inequality
none within the radius is lost if the look-up distance less the coded vector's
own error exceeds it. What is left gets an exact cosine in double precision. So
no link is lost, whatever the sample was; the sample only sets the speed. Since
either end of a link would find the other, a vector asks only its own list and
those numbered above it.

Equal vectors are one class, so copies cost a count and no pairs. A list is
searched in blocks of ``ROWS`` entries by ``QUERIES`` queries. A block returns
each query's number of links and a spanning forest of its links, never all pairs.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing, as do vectors of different length. Repeated rows
each get their row; rows of one vec_id are one vector when links are counted
within a class of equal vectors. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionmill.llm.common import components, table

COSINE = 0.95
SAMPLE, LISTS, PARTS, CODES = 8_192, 256, 8, 64
PER_LIST, ROWS, QUERIES = 512, 4_096, 4_096
_SLACK = 1e-6


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """k centroids of the rows of x; deterministic."""
    random = np.random.default_rng(seed)
    centre = x[random.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = (x @ centre.T - 0.5 * (centre**2).sum(1)).argmax(1)
        size = np.bincount(near, minlength=len(centre))
        total = np.stack([np.bincount(near, x[:, d], minlength=len(centre)) for d in range(x.shape[1])], 1)
        centre = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centre)
    return centre


class Quantiser:
    """Coarse centroids and a codebook a subspace, fitted on unit vectors."""

    def __init__(self, sample: np.ndarray, rows: int, lists: int = LISTS):
        k = int(max(1, min(lists, len(sample), rows // PER_LIST)))
        self.coarse = kmeans(sample, k)
        left = sample - self.coarse[self.nearest(sample)]
        self.cuts = np.array_split(np.arange(sample.shape[1]), min(PARTS, sample.shape[1]))
        self.books = [kmeans(left[:, c], min(CODES, len(left)), 6) for c in self.cuts]
        self.apart = np.sqrt(np.maximum(0, ((self.coarse[:, None] - self.coarse[None]) ** 2).sum(2)))

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.coarse.T - 0.5 * (self.coarse**2).sum(1)).argmax(1)

    def encode(self, x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """List, codes, error norm and sufficient probes (its own list and higher ones) of each row."""
        d2 = ((x**2).sum(1)[:, None] - 2 * x @ self.coarse.T) + (self.coarse**2).sum(1)[None]
        own = d2.argmin(1)
        left = x - self.coarse[own]
        codes = np.stack([((left[:, c] @ b.T) - 0.5 * (b**2).sum(1)).argmax(1) for c, b in zip(self.cuts, self.books, strict=True)], 1).astype(np.uint8)
        error = np.sqrt(sum(((left[:, c] - b[codes[:, m]]) ** 2).sum(1) for m, (c, b) in enumerate(zip(self.cuts, self.books, strict=True))))
        # twice the distance between centroids times the radius bounds the difference of squared distances
        ok = d2 - d2[np.arange(len(x)), own][:, None] <= 2 * radius * self.apart[own] + _SLACK
        ok &= np.arange(ok.shape[1])[None] >= own[:, None]
        return own, codes, error, [np.flatnonzero(row) for row in ok]

    def near(self, x: np.ndarray, list_no: int, codes: np.ndarray, error: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, entry) of one list that table look-ups can't rule out."""
        left = x - self.coarse[list_no]
        total = np.zeros((len(codes), len(x)), dtype=np.float32)
        row = np.empty_like(total)
        for m, (c, b) in enumerate(zip(self.cuts, self.books, strict=True)):
            look = (left[:, c] ** 2).sum(1)[None] - 2 * b @ left[:, c].T + (b**2).sum(1)[:, None]
            total += np.take(look.astype(np.float32), codes[:, m], axis=0, out=row)
        entry, query = np.nonzero(total <= ((radius + error) ** 2 + 100 * _SLACK).astype(np.float32)[:, None])
        return query, entry


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that keep what the links (a, b) connect: each end to the smallest end of its component."""
    ends, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = places[: len(a)], places[len(a) :]
    label = np.arange(len(ends))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        new = new[label]
        if (new == label).all():
            break
        label = new
    root = ends[label]
    keep = root != ends
    return ends[keep], root[keep]


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (vec_id, s, t) with the key of their class (null if the vector can't link), and classes (s, t, id, n, v)."""
    v = F.col("embedding").cast("array<double>")
    fine = F.coalesce(F.size(v) > 0, F.lit(False)) & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select("vec_id", "embedding").withColumn("fine", fine)
    rows = rows.withColumns({"s": F.when(F.col("fine"), F.xxhash64("embedding")), "t": F.when(F.col("fine"), F.xxhash64(F.reverse("embedding"), F.size("embedding")))})
    found = rows.where("fine").groupBy("s", "t").agg(F.min("vec_id").alias("id"), F.count_distinct("vec_id").alias("n"), F.any_value("embedding").alias("v"))
    return rows.select("vec_id", "s", "t"), found


def links(found: DataFrame, cosine: float = COSINE) -> DataFrame:
    """From classes (id, n, v) of one length: rows (a, b, n) that hold a class's number of linked vectors (b null) or an edge of a spanning forest (n null)."""
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    rows = found.count()
    share = SAMPLE / max(1, rows)
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / float(1 << 20)
    sample = np.array([r["v"] for r in found.where(draw < share).orderBy("id").limit(2 * SAMPLE).select("v").collect()], dtype=np.float64)
    if not len(sample):
        sample = np.array([r["v"] for r in found.orderBy("id").limit(1).select("v").collect()], dtype=np.float64)
    kind = np.float32 if found.schema["v"].dataType.elementType.simpleString() == "float" else np.float64
    shared = found.sparkSession.sparkContext.broadcast(Quantiser(unit(sample), rows))

    def index(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not batch.num_rows:
                continue
            given = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(batch.num_rows, -1)
            x = unit(given)
            own, codes, error, probes = shared.value.encode(x, radius)
            made = {"list": pa.array(own, pa.int32()), "codes": pa.array([c.tobytes() for c in codes], pa.binary()), "error": pa.array(error), "probes": pa.array(probes, pa.list_(pa.int32())), "x": pa.array([r.tobytes() for r in given], pa.binary())}
            yield pa.record_batch({"id": batch.column("id"), "n": batch.column("n")} | made)

    indexed = table(found.select("id", "n", "v").mapInArrow(index, "id long, n long, list int, codes binary, error double, probes array<int>, x binary"), "indexed")
    entries = indexed.groupBy("list").count().select("list", F.ceil(F.col("count") / ROWS).cast("int").alias("row_blocks"))
    asked = indexed.select(F.explode("probes").alias("list")).groupBy("list").count().select("list", F.ceil(F.col("count") / QUERIES).cast("int").alias("query_blocks"))
    sizes = F.broadcast(entries.join(asked, "list"))  # one row a list, LISTS at most
    place = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    kept = indexed.join(sizes, "list").select("list", F.col("list").alias("home"), place("row_blocks").alias("row_block"), F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("query_block"), F.lit(False).alias("asks"), "id", "n", "codes", "error", "x")
    asks = indexed.withColumn("home", F.col("list")).withColumn("list", F.explode("probes")).join(sizes, "list")
    asks = asks.select("list", "home", F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1)).alias("row_block"), place("query_blocks").alias("query_block"), F.lit(True).alias("asks"), "id", "n", F.lit(None).cast("binary").alias("codes"), F.lit(0.0).alias("error"), "x")

    def search(group: pa.Table) -> pa.Table:
        asks = group["asks"].to_numpy(zero_copy_only=False).astype(bool)
        a, b, n = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        if asks.any() and not asks.all():
            read = lambda c, t, k: np.frombuffer(b"".join(group.filter(pa.array(k))[c].to_pylist()), dtype=t).reshape(int(k.sum()), -1)
            ids, sizes, this = group["id"].to_numpy(), group["n"].to_numpy(), int(group["list"][0].as_py())
            qx, ex, codes = unit(read("x", kind, asks)), unit(read("x", kind, ~asks)), read("codes", np.uint8, ~asks)
            q_id, e_id, q_n, e_n, error = ids[asks], ids[~asks], sizes[asks], sizes[~asks], group["error"].to_numpy()[~asks]
            heads, tails = [], []
            for start in range(0, len(qx), 256):
                i, j = shared.value.near(qx[start : start + 256], this, codes, error, radius)
                i = i + start
                for s in range(0, len(i), 1 << 16):
                    p, q = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
                    ok = (np.einsum("ij,ij->i", qx[p], ex[q]) >= cosine) & (q_id[p] != e_id[q])
                    heads.append(p[ok])
                    tails.append(q[ok])
            i, j = np.concatenate(heads), np.concatenate(tails)
            # a list asks itself from both ends; another list's links are asked once and count for both
            away = group["home"].to_numpy()[asks][i] != this
            ends, count = np.concatenate([q_id, e_id]), np.concatenate([np.bincount(i, e_n[j], minlength=len(q_id)), np.bincount(j[away], q_n[i[away]], minlength=len(e_id))]).astype(np.int64)
            some = np.flatnonzero(count)
            left, right = forest(q_id[i], e_id[j])
            a, b, n = [ends[some], left], [np.full(len(some), -1), right], [count[some], np.zeros(len(left), dtype=np.int64)]
        a, b, n = np.concatenate(a), np.concatenate(b), np.concatenate(n)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64(), mask=n > 0), "n": pa.array(n, pa.int64(), mask=n == 0)})

    return kept.unionByName(asks).groupBy("list", "row_block", "query_block").applyInArrow(search, "a long, b long, n long")


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at unit length in double precision; scaled first, so that neither large nor small components overflow."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of vectors (vec_id, embedding)."""
    rows, found = classes(vectors)
    rows, found = rows.withColumn("vec_id", F.col("vec_id").cast("long")), table(found, "classes")
    parts = [table(links(found.where(F.size("v") == r["d"]), cosine), "links") for r in found.select(F.size("v").alias("d")).distinct().orderBy("d").collect()]
    if not parts:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    made = parts[0]
    for p in parts[1:]:
        made = made.unionByName(p)
    joined = components(found.select(F.col("id").alias("node")), made.where("b is not null").select("a", "b"))
    linked = made.where("n is not null").groupBy("a").agg(F.sum("n").alias("linked"))
    per_class = found.select("s", "t", "id", "n").join(joined, F.col("id") == F.col("node")).join(linked, F.col("id") == F.col("a"), "left")
    per_class = per_class.select("s", "t", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("links"), "component")
    out = rows.join(per_class, ["s", "t"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op7_embedding_neardup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate links and components of all embeddings."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
