"""Mixing sources to target weights: subset-sum budget fitting.

Sources in code point order (null last) weigh 5, 2, 1, repeating, and share
``SHARE`` of all words; a target stops at ``MOST`` times its source's words and
what is over goes to the others by weight until none is above. A source gives
whole passes over its documents (target // size) and fits the rest: documents
are counted by exact length, each length first gives its even share, and
bounded-knapsack dynamic programming picks the counts by length that come
closest to what is then left. Which documents of a length those are is decided
by a seeded hash, so reruns agree.

The grouped data of a source are its distinct lengths, not its documents.
Documents of one source and length are ranked within ``SPLITS`` or more ranges of the
hash (more with more rows), with the ranges' counts as offsets, so copies of one text do not meet in
one task. Sources are ranked within range partitions in the same way, and the
capped targets are found by rounds of sums; only sums come to the driver.

Defined results: a null text has size 0, and size 0 takes 0 words. A null source
is a source of its own. Repeated rows each get their row, and equal ids of equal
length are ordered arbitrarily but alike. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionmill.llm.common import small_batches, table

WEIGHTS, SHARE, MOST, SEED = (5.0, 2.0, 1.0), 1.5, 2, 20240131
SPLITS = 256
#: A window of ranks holds about this many rows at most; there are more windows where SPLITS aren't enough.
SPLIT_ROWS = 1_000_000
#: Words that the knapsack is given at most, beside what no length can take; what is beyond goes to all lengths by their shares.
REACH = 1 << 16


def count_words(text: pa.Array) -> list[int]:
    return [len(t.split()) if t else 0 for t in text.cast(pa.large_binary()).to_pylist()]


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h): h is the seeded hash that picks documents."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.record_batch({"doc_id": b.column("doc_id"), "source": b.column("source"), "size": pa.array(count_words(b.column("text")), pa.int64())})

    out = docs.select("doc_id", F.col("source").cast("string").alias("source"), "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, source string, size long")
    return out.withColumn("h", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(SEED)))


def ranked(sources: DataFrame) -> DataFrame:
    """sources (source, source_size) with weight, by rank in code point order, null last."""
    key = [F.col("source").isNull(), F.encode("source", "UTF-8")]
    dealt = table(sources.repartitionByRange(*key).withColumn("part", F.spark_partition_id()), "sources")
    before = {r["part"]: r["count"] for r in dealt.groupBy("part").count().collect()}
    offset, start = {}, 0
    for part in sorted(before):
        offset[part], start = start, start + before[part]
    place = F.create_map(*[F.lit(x) for kv in offset.items() for x in kv]) if offset else F.create_map(F.lit(0), F.lit(0))
    rank = F.row_number().over(W.partitionBy("part").orderBy(*key)) - 1 + place[F.col("part")]
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    return dealt.withColumn("weight", weights[(rank % len(WEIGHTS)).cast("int")]).drop("part")


def targets(sources: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sources with target: share of all words by weight, capped at most times the source's words, the excess reshared."""
    sources = table(ranked(sources), "ranked")
    capacity = F.col("source_size") * float(most)
    level, total = 0.0, None
    while True:
        over = F.col("weight") * F.lit(level) >= capacity
        got = sources.agg(F.sum("source_size").alias("n"), F.sum(F.when(over, capacity)).alias("full"), F.sum(F.when(~over, F.col("weight"))).alias("weight"), F.count_if(over).alias("capped")).first()
        total = share * float(got["n"] or 0)
        if not got["weight"] or not total:
            break
        new = max(0.0, total - float(got["full"] or 0.0)) / got["weight"]
        if new <= level:  # no source went over
            break
        level = new
    over = F.col("weight") * F.lit(level) >= capacity
    return sources.withColumn("target", F.when(over | F.lit(not total), capacity if total else F.lit(0.0)).otherwise(F.col("weight") * F.lit(level)))


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take so that their sum comes closest to budget from below (the fullest reachable sum).

    Sums are bits of one integer; for each sum reached first by an item (a length times a power of two), the item is kept.
    """
    take = np.zeros(len(lengths), dtype=np.int64)
    if budget <= 0:
        return take
    reached, mask = 1, (1 << (budget + 1)) - 1
    came: list[tuple[int, int, int]] = []  # index, items at once, the sums that it reached first
    for i in np.argsort(-lengths, kind="stable"):
        left, piece, length = int(min(counts[i], budget // lengths[i])), 1, int(lengths[i])
        while left > 0:
            n = min(piece, left)
            new = (reached << (length * n)) & mask & ~reached
            if new:
                came.append((int(i), n, new))
                reached |= new
            left, piece = left - n, piece * 2
        if reached >> budget & 1:
            break
    at = reached.bit_length() - 1
    for i, n, new in reversed(came):
        if new >> at & 1:
            take[i] += n
            at -= int(lengths[i]) * n
    return take


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: float) -> np.ndarray:
    """How many of each length make up about ``budget`` words: even shares, of which the last ``REACH`` words go to the knapsack.

    Whole documents of the even shares come first. Of their fractions, in words, what is over REACH is given out from the longest
    length to the shortest; what a length can't take as a whole document goes on to the next.
    """
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    size = int((lengths * counts).sum())
    if budget <= 0 or size == 0:
        return np.zeros(len(lengths), dtype=np.int64)
    budget = min(int(round(budget)), size)
    share = counts * (budget / size)
    take = np.floor(share).astype(np.int64)
    left = budget - int((take * lengths).sum())
    due = (share - take) * lengths * (max(0, left - REACH) / max(1, left))
    carry = 0.0
    for i in np.argsort(-lengths, kind="stable"):
        carry += due[i]
        n = min(int(counts[i] - take[i]), int(carry // lengths[i])) if lengths[i] else 0
        take[i] += n
        carry -= n * lengths[i]
    left = budget - int((take * lengths).sum())
    ok = (lengths > 0) & (counts > take) & (lengths <= left)
    take[ok] += knapsack(lengths[ok], (counts - take)[ok], left)
    return take


def mix(docs: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, and copies (how often the mix holds the document) of each row of docs (doc_id, source, text)."""
    small_batches(docs.sparkSession)
    rows = table(sized(docs), "sizes")
    splits = max(SPLITS, rows.count() // SPLIT_ROWS)
    split = F.pmod(F.shiftrightunsigned("h", 20), F.lit(splits)).alias("split")
    by_range = table(rows.where("size > 0").groupBy("source", "size", split).count(), "ranges")
    by_length = by_range.groupBy("source", "size").agg(F.sum("count").alias("n"))
    sources = table(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), share, most), "targets")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = sources.select("source", "source_size", "target", passes.alias("passes")).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))

    def choose(group: pa.Table) -> pa.Table:
        take = fit_counts(group["size"].to_numpy(), group["n"].to_numpy(), group["rest"][0].as_py())
        return pa.table({"source": group["source"], "size": group["size"], "extra": pa.array(take, pa.int64())})

    extra = by_length.join(plan.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s"))).select("source", "size", "n", "rest")
    extra = extra.groupBy("source").applyInArrow(choose, "source string, size long, extra long")
    before = W.partitionBy("source", "size").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    offsets = by_range.withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source")) & (F.col(f"{a}.size") == F.col(f"{b}.size"))
    edges = offsets.alias("o").join(extra.alias("e"), same("o", "e")).select("o.source", "o.size", "split", F.greatest(F.lit(0), F.least("count", F.col("extra") - F.col("before"))).alias("wanted"), "count")
    order = W.partitionBy("source", "size", "split").orderBy("h", "doc_id")
    picked = rows.withColumn("split", split).withColumn("nth", F.row_number().over(order))
    joined = picked.alias("r").join(edges.alias("x"), same("r", "x") & (F.col("r.split") == F.col("x.split")), "left")
    joined = joined.select("r.doc_id", "r.source", "r.size", (F.col("nth") <= F.coalesce("wanted", F.lit(0))).cast("long").alias("more"))
    out = joined.join(plan.select(F.col("source").alias("s"), "source_size", "target", "passes"), F.col("source").eqNullSafe(F.col("s")))
    copies = F.when(F.col("size") > 0, F.least(F.col("passes") + F.col("more"), F.lit(most))).otherwise(0)
    return out.select("doc_id", "source", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), copies.cast("long").alias("copies"))


def op6_source_mix(spark, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
