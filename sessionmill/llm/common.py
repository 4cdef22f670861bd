"""What the corpus operators share: tokens, hashes, folds, tables that cut lineage, components."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z, all other bytes as they are.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a new one where it is unset (tests)."""
    context = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known is None:
        has = context._jsc.sc().getCheckpointDir()
        if not has.isDefined() and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        known = has.get() if has.isDefined() else tempfile.mkdtemp(prefix="spark-")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(known)
    return known


_SCRATCH: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that ``table`` writes inside, at the end. What was made of them must be written by then."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this library has written."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go when it is written, and not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def table(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back, so that a lost executor costs a read and no recomputation.
    Stays there until ``discard`` or the end of ``scratch``, if inside one."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    with swept(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def discard(*made: DataFrame) -> None:
    """Deletes tables that ``table`` has returned, of which nothing is to be made any more."""
    for df in made:
        remove(df.sparkSession, _PATHS.pop(df))


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, for what loops rebuild."""
    shared_dir(df.sparkSession)
    with swept(df.sparkSession):
        return df.checkpoint(eager=True)


#: Bits of a sieve (8 MB), and of one of its rows.
SIEVE, SIEVE_PART = 1 << 26, 1 << 15


def sieve(keys: DataFrame) -> DataFrame:
    """(sieve_part, sieve_bits): a bit of SIEVE for each of the keys (key long). It stays as small however many keys there are."""
    at = F.pmod("key", F.lit(SIEVE))
    dealt = keys.select(F.floor(at / SIEVE_PART).alias("sieve_part"), (at % SIEVE_PART).alias("at")).repartition("sieve_part")
    return dealt.groupBy("sieve_part").agg(F.bitmap_construct_agg("at").alias("sieve_bits"))


def sifted(df: DataFrame, key: Column, parts: DataFrame) -> DataFrame:
    """df with ``hit``: true for every key of the sieve ``parts`` and, by chance, for some others. No row of df is shuffled."""
    at = F.pmod(key, F.lit(SIEVE))
    byte = F.substring("sieve_bits", (F.floor(at % SIEVE_PART / 8) + 1).cast("int"), F.lit(1))
    hit = F.getbit(F.conv(F.hex(byte), 16, 10).cast("long"), (at % 8).cast("int")) == 1
    found = df.join(F.broadcast(parts), F.floor(at / SIEVE_PART) == F.col("sieve_part"), "left")
    return found.select(*df.columns, F.coalesce(hit, F.lit(False)).alias("hit"))


#: Rows of an Arrow batch between Spark and Python: texts can be long, and a batch is held several times over.
ARROW_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch size to ARROW_ROWS if it is larger, so that memory stays small with long texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % k


def words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 text, A-Z lower-cased."""
    return text.translate(LOWER).split()


def raw(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    return column.cast(pa.large_binary()).to_pylist()


class WordHash(dict):
    """64-bit hash of a word, remembered for at most ``limit`` words at a time."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), dtype=np.uint64, count=len(found))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles of a text, in order; with fewer words the whole sequence is one, without words none."""
    if len(h) == 0:
        return h
    n = min(k, len(h))
    out = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return out


def batches(it: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that what is made of a batch stays small."""
    for batch in it:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


HUB, HUBS = 64, 50_000


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest node reachable from each node: (node, component).

    nodes: (node long); edges: (a long, b long), in any direction, with
    repeats. Alternates large-star and small-star steps until no edge changes;
    each step is a grouped minimum and a join, so no component is ever
    gathered. Neighbours of hubs (nodes of more than HUB edges, and of so many
    that there are at most HUBS such nodes) find their minimum by a broadcast of
    the hubs' minima and don't meet in one task. A node without edges is its own
    component.
    """
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = cut(both)
    before = None
    while True:
        signature = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if signature == before or signature[0] == 0:
            break
        before = signature
        # large star: each larger neighbour of a node goes to the smallest of its neighbourhood
        near = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("m"), F.count("*").alias("n"))
        hubs = F.broadcast(least.where(F.col("n") > max(HUB, 2 * signature[0] // HUBS)).select("a", F.col("m").alias("hub_m")))  # HUBS rows at most
        up = near.where("b > a").join(hubs, "a", "left")
        rest = up.where("hub_m is null").select("a", "b").join(least.select("a", "m"), "a")
        large = rest.unionByName(up.where("hub_m is not null").select("a", "b", F.col("hub_m").alias("m"))).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: each node and its smaller neighbours go to the smallest of these
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        now = cut(small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
    least = now.groupBy("a").agg(F.min("b").alias("component"))
    return nodes.join(least, nodes["node"] == least["a"], "left").select("node", F.coalesce("component", "node").alias("component"))
