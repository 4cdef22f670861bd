"""Benchmark decontamination: a BM25 inverted index of test items, queried with every passage of every text by block-max WAND.

Items are cut into chunks of at most ``CHUNK`` words, the index's documents. A
term's impact on a chunk is its BM25 weight there over the chunk's own total, so
a score is the share of a chunk's weight that a passage covers and one threshold
suits chunks of every length. Passages are windows of 2 * CHUNK words that start
every CHUNK words, so each copy of a chunk lies whole in one of them.

Before a window is queried an upper bound is taken from the same impacts: a
chunk's lightest terms that together stay below half the threshold are left out,
and the sum over its other terms must reach the rest. That loses no passage. The
windows left are queried by WAND with block maxima, which returns every chunk at
or above the threshold. A hit counts if the text around it holds enough of the
runs of three words (of all, where there are fewer) of both the item's question
(its words but the last third, or up to its last sentence) and its answer (the
rest). An item of fewer than ``WHOLE`` words must stand there as it is, in one run.

Chunk counts of terms and the mean length are those of all items. Items are dealt
to shards of about ``SHARD`` chunks, indexed by executors; one shard's index is
what a process holds at a time, so memory doesn't grow with the benchmark, and
results don't depend on the number of shards. Each shard is a pass over the texts.

Defined results: null or empty texts match nothing, as do null items and those
without a word. An item of one word has no answer, and its overlap is 1. Items with
a null id are reported under a null item_id; items of one id are one item, whatever
their texts, and hits in texts of one doc_id are one row, the highest score first
(then the overlaps, then the later word). Empty tables give an empty result.
Columns of documents stay as they are.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionmill.llm.common import raw, small_batches, table, words

CHUNK, BLOCK, WHOLE, SHARD = 48, 32, 8, 20_000
THRESHOLD, OVERLAP, RUN = 0.5, 0.5, 3
K1, B = 1.2, 0.4
_SENTENCE_END = re.compile(rb"[.!?][\"')\]]*$")


def split(item: list[bytes]) -> tuple[list[bytes], list[bytes]]:
    """Question and answer of an item: its last sentence is the answer if that is at most half of its words, else its last third."""
    ends = [i + 1 for i, w in enumerate(item[:-1]) if _SENTENCE_END.search(w)]
    cut = ends[-1] if ends and 2 * ends[-1] >= len(item) else len(item) - len(item) // 3
    return item[:cut], item[cut:]


def grams(found: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    return {tuple(found[i : i + n]) for i in range(len(found) - n + 1)}


def overlap(part: list[bytes], around: list[bytes]) -> float:
    """Share of the part's runs of RUN words (of all its words, where there are fewer) that stand in ``around``."""
    n = min(RUN, len(part))
    runs = grams(part, n) if n else set()
    return len(runs & grams(around, n)) / len(runs) if runs else 1.0


def chunks(item: list[bytes]) -> list[Counter]:
    """Terms of the even pieces of an item."""
    n = math.ceil(len(item) / CHUNK)
    return [Counter(item[i * len(item) // n : (i + 1) * len(item) // n]) for i in range(n)]


class Postings:
    """A term's chunks in order, its impacts on them, and the largest impact of each block."""

    __slots__ = ("docs", "impacts", "most", "blocks")

    def __init__(self, docs: list[int], impacts: list[float]):
        self.docs, self.impacts, self.most = docs, impacts, max(impacts)
        self.blocks = [max(impacts[i : i + BLOCK]) for i in range(0, len(impacts), BLOCK)]


class Index:
    """Inverted index of items: (item_id, words). df: chunks that hold a term, count: all chunks, mean: their mean length (by
    default those of the items)."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], df: dict[bytes, int] | None = None, count: int = 0, mean: float = 0.0):
        self.items = [(item_id, item, *split(item)) for item_id, item in items]
        self.owner = [i for i, (_, item) in enumerate(items) for _ in range(math.ceil(len(item) / CHUNK))]
        cut = [c for _, item in items for c in chunks(item)]
        if df is None:
            df, count = Counter(t for c in cut for t in c), len(cut)
            mean = sum(map(Counter.total, cut)) / max(1, count)
        idf = {t: math.log(1 + (count - df[t] + 0.5) / (df[t] + 0.5)) for t in {t for c in cut for t in c}}
        lists: dict[bytes, tuple[list[int], list[float]]] = {}
        self.slack = np.zeros(len(cut))
        heavy: list[tuple[bytes, int, float]] = []
        for k, c in enumerate(cut):
            size = K1 * (1 - B + B * c.total() / mean)
            weight = {t: idf[t] * n * (K1 + 1) / (n + size) for t, n in c.items()}
            total = sum(weight.values())
            left = THRESHOLD / 2
            for t in sorted(weight, key=lambda t: (weight[t], t)):
                share = weight[t] / total
                docs, impacts = lists.setdefault(t, ([], []))
                docs.append(k)
                impacts.append(share)
                if share <= left:
                    left -= share
                    self.slack[k] += share
                else:
                    left = -1
                    heavy.append((t, k, share))
        self.postings = {t: Postings(*x) for t, x in lists.items()}
        heavy.sort()
        self.term = {t: i + 1 for i, t in enumerate(sorted({t for t, _, _ in heavy}))}
        sizes = Counter(self.term[t] for t, _, _ in heavy)
        self.ends = np.cumsum([0] + [sizes[i] for i in range(len(self.term) + 1)])  # of term i: ends[i] to ends[i + 1]
        self.heavy_chunk = np.array([k for _, k, _ in heavy], dtype=np.int64)
        self.heavy_share = np.array([s for _, _, s in heavy])

    def windows(self, found: list[bytes]) -> np.ndarray:
        """Starts (in units of CHUNK) of the windows whose bound reaches the threshold for some chunk."""
        ids = np.fromiter(map(self.term.get, found, repeat(0)), dtype=np.int64, count=len(found))
        at = np.flatnonzero(ids)
        if not len(at):
            return at
        ids = ids[at]
        first, n = self.ends[ids], self.ends[ids + 1] - self.ends[ids]
        rows = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        count = len(self.owner)
        key, back = np.unique(np.repeat(at // CHUNK, n) * count + self.heavy_chunk[rows], return_inverse=True)
        total = np.bincount(back, self.heavy_share[rows])
        place = np.searchsorted(key, key + count)
        place[place == len(key)] = 0
        both = total + np.where(key[place] == key + count, total[place], 0)
        before = np.searchsorted(key, key - count)
        before[before == len(key)] = 0
        also = total + np.where(key[before] == key - count, total[before], 0)
        need = THRESHOLD - self.slack[key % count] - 1e-9
        start = key // count
        return np.unique(np.concatenate([start[both >= need], start[(also >= need) & (start > 0)] - 1]))

    def query(self, passage: list[bytes], least: float = THRESHOLD) -> list[tuple[int, float]]:
        """Every chunk whose score for the passage's distinct terms is at least ``least``, by block-max WAND."""
        cursors = [[p.docs[0], i, 0, p] for i, p in enumerate(self.postings[t] for t in sorted(set(passage)) if t in self.postings)]
        out = []
        cursors.sort(key=lambda c: c[:2])
        while cursors:
            bound, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                bound += c[3].most
                if bound >= least - 1e-9:
                    pivot = i
                    break
            if pivot < 0:
                return out
            doc = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == doc:
                pivot += 1
            part, until = 0.0, math.inf
            for c in cursors[: pivot + 1]:
                block = _seek(c[3].docs, c[2], doc) // BLOCK
                if block < len(c[3].blocks):
                    part += c[3].blocks[block]
                    end = min(len(c[3].docs), (block + 1) * BLOCK)
                    until = min(until, c[3].docs[end - 1] + 1)
            if part >= least - 1e-9 and cursors[0][0] == doc:
                score = sum(c[3].impacts[c[2]] for c in cursors[: pivot + 1])
                if score >= least - 1e-9:
                    out.append((doc, score))
                target = doc + 1
            elif part >= least - 1e-9:
                target = doc
            else:  # no chunk before the end of these blocks, or before the next list begins, can reach it
                target = until if pivot + 1 == len(cursors) else min(until, cursors[pivot + 1][0])
                target = max(target, doc + 1)
            kept = []
            for i, c in enumerate(cursors):
                if i <= pivot and c[0] < target:
                    c[2] = _seek(c[3].docs, c[2], target)
                    if c[2] == len(c[3].docs):
                        continue
                    c[0] = c[3].docs[c[2]]
                kept.append(c)
            cursors = sorted(kept, key=lambda c: c[:2])
        return out

    def leaks(self, text: bytes | None) -> dict[int, tuple[float, float, float, int]]:
        """By item id: score, overlap of question and of answer, and the word where the passage starts."""
        found = words(text) if text else []
        best: dict[int | None, tuple[float, float, float, int]] = {}
        for start in self.windows(found).tolist() if found else []:
            passage = found[start * CHUNK : (start + 2) * CHUNK]
            for chunk, score in self.query(passage):
                item_id, item, question, answer = self.items[self.owner[chunk]]
                around = found[max(0, start * CHUNK - len(item)) : (start + 2) * CHUNK + len(item)]
                q, a = overlap(question, around), overlap(answer, around)
                if min(q, a) >= OVERLAP and (len(item) >= WHOLE or tuple(item) in grams(around, len(item))):
                    best[item_id] = max(best.get(item_id, (0.0, 0.0, 0.0, 0)), (score, q, a, start * CHUNK))
        return best


def _seek(docs: list[int], at: int, target: int) -> int:
    """First place from ``at`` on with a document of at least ``target``: doubling steps, then halving."""
    step, low = 1, at
    while low + step < len(docs) and docs[low + step] < target:
        low += step
        step *= 2
    high = min(len(docs), low + step)
    while low < high:
        mid = (low + high) // 2
        if docs[mid] < target:
            low = mid + 1
        else:
            high = mid
    return low


def shards(items: DataFrame, size: int | None = None) -> Iterator[Index]:
    """One index after the other over items (item_id, text)."""
    usable = items.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()

    def count_terms(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            cut = [(s, chunks(words(t))) for s, t in zip(batch.column("shard").to_pylist(), raw(batch.column("text")), strict=True)]
            n = Counter((s, t) for s, found in cut for c in found for t in c)
            for s, found in cut:
                # the empty term, which no text has, counts the chunks; the next their words
                n[s, b""] += len(found)
                n[s, b" "] += sum(map(Counter.total, found))
            yield pa.record_batch({"shard": pa.array([s for s, _ in n], pa.int64()), "term": pa.array([t for _, t in n], pa.binary()), "n": pa.array(list(n.values()), pa.int64())})

    def counted(sharded: DataFrame) -> DataFrame:
        return sharded.select("shard", "text").mapInArrow(count_terms, "shard long, term binary, n long").groupBy("shard", "term").agg(F.sum("n").alias("n"))

    whole = counted(usable.withColumn("shard", F.lit(0).cast("long"))).where("term in (X'', X'20')")
    about = {bytes(r["term"]): r["n"] for r in whole.collect()}  # two rows
    total, length = about.get(b"", 0), about.get(b" ", 0)
    if not total:
        return
    n_shards = math.ceil(total / (SHARD if size is None else size))
    sharded = usable.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_shards)))
    local = counted(sharded)
    terms = local.select("shard", "term").join(local.groupBy("term").agg(F.sum("n").alias("n")), "term")

    def build(group: pa.Table, known: pa.Table) -> pa.Table:
        df = dict(zip(known["term"].to_pylist(), known["n"].to_pylist(), strict=True))
        order = sorted(zip(group["item_id"].to_pylist(), raw(group["text"]), strict=True), key=lambda x: (x[0] is None, x))
        index = Index([(i, w) for i, t in order if (w := words(t))], df, total, length / total)
        return pa.table({"shard": pa.array([group["shard"][0].as_py()], pa.int64()), "made": pa.array([pickle.dumps(index)], pa.binary())})

    made = table(sharded.groupBy("shard").cogroup(terms.groupBy("shard")).applyInArrow(build, "shard long, made binary"), "shards")
    for k in range(n_shards):
        for r in made.where(F.col("shard") == k).collect():  # one row
            yield pickle.loads(r["made"])


HIT = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, word long"


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each text and test item that it contains: doc_id, item_id, score, overlaps, word."""
    spark = docs.sparkSession
    small_batches(spark)
    out = spark.createDataFrame([], HIT)
    for index in shards(items):
        shared = spark.sparkContext.broadcast(index)

        def run(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in it:
                rows = [(d, item, *x) for d, t in zip(batch.column("doc_id").to_pylist(), raw(batch.column("text")), strict=True) for item, x in shared.value.leaks(t).items()]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
                columns = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in HIT.split(", ")])

        out = out.unionByName(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, HIT))
    best = F.max_by(F.struct("question_overlap", "answer_overlap", "word"), F.struct("score", "question_overlap", "answer_overlap", "word"))
    return out.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), best.alias("best")).select("doc_id", "item_id", "score", "best.*")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the texts that contain a test item."""
    spark = docs.sparkSession
    small_batches(spark)
    for index in shards(items):
        shared = spark.sparkContext.broadcast(index)

        def run(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in it:
                yield batch.filter(pa.array([not shared.value.leaks(t) for t in raw(batch.column("text"))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Test items that documents contain: one row for each pair."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
