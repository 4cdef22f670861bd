"""Ranked lexical search: hybrid term-at-a-time and document-at-a-time.

Every document is tokenised once; what the items can ask for is kept as (document, length, term numbers, counts) in a table of the
shared folder. Statistics are counted over all documents. Each task of a pass over that table inverts its documents by shards of
about ``SHARD`` postings: lists by term with each posting's score, the largest score of each block of ``WIDE`` documents of each
list. An item is then searched in a shard in two steps.

* Term at a time: its shortest lists, as many as hold ``SHORT`` postings together, are summed into one list of accumulators. From
  here on that list is one iterator with a bound for each block, like any other.
* Document at a time: a block is skipped if the bounds of the accumulators and of the long lists add up to less than the score of
  the item's best ``k`` so far. Blocks that stay are read by descending bound; of a block, long lists are read by descending
  bound, and documents that what is left can't lift to that score drop out before the next list is read.

The best ``k`` of an item go from shard to shard of a task, so bounds tighten; the tasks' best are ranked by Spark in two windows.
Nothing is lost: a block or a document is skipped only if its score must be below ``k`` scores already found.

Defined results: documents without a term (null, empty, only signs) are counted nowhere and found by nothing; items without a term
find nothing. Each row of the items is an item of its own, also if its item_id is null or repeated. Each row of the documents is a
document; those of a null doc_id stand behind all others of their score. If one of the tables is empty, the result is. Other
columns of the inputs are not read.

Items are taken in groups of about ``TERMS`` terms (one item's terms are held whole); each group is a pass over the texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionmill.llm.common import batches, raw, small_batches, table

TOP, TERMS, SHARD, SHORT, WIDE, STEP = 50, 1 << 20, 1 << 21, 8_192, 128, 64
#: Bytes to term characters: A-Z lower-cased, other letters, digits and bytes of characters beyond ASCII stay, the rest are blanks.
_CHARS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_NO_ID = np.iinfo(np.int64).max


def terms(text: bytes) -> list[bytes]:
    return text.translate(_CHARS).split()


class Items:
    """A group of items: the terms' numbers and each item's numbers."""

    def __init__(self, rows: list[tuple[int, bytes | None]]):
        self.numbers: dict[bytes, int] = {}
        self.of: dict[int, np.ndarray] = {}
        for key, text in rows:
            found = {self.numbers.setdefault(t, len(self.numbers)) for t in terms(text or b"")}
            self.of[key] = np.array(sorted(found), dtype=np.int64)


def counted(docs: DataFrame, shared) -> DataFrame:
    """(doc, n, terms, counts) of every document with a term; terms are numbers in the group of items, n counts all terms."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.numbers
        for batch in batches(it, 500):
            words = [terms(t) if t else [] for t in raw(batch.column("text"))]
            n = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
            flat = np.fromiter((number.get(w, -1) for ws in words for w in ws), dtype=np.int64, count=int(n.sum()))
            at = np.repeat(np.arange(len(words)), n)
            key, tf = np.unique((at << 32 | flat)[flat >= 0], return_counts=True)
            ends = np.searchsorted(key, np.arange(len(words) + 1) << 32).astype(np.int32)
            keep = pa.array(n > 0)
            lists = lambda v: pa.ListArray.from_arrays(pa.array(ends), pa.array(v.astype(np.int32)))
            yield pa.record_batch({"doc": batch.column("doc"), "n": pa.array(n), "terms": lists(key & 0xFFFFFFFF), "counts": lists(tf)}).filter(keep)

    return docs.mapInArrow(run, "doc long, n long, terms array<int>, counts array<int>")


class Shard:
    """Lists by term of some documents, with scores and their largest by block."""

    def __init__(self, docs: np.ndarray, term: np.ndarray, at: np.ndarray, score: np.ndarray, n_terms: int):
        self.docs = docs  # ids by place; places are in the order of ids
        order = np.argsort(term * len(docs) + at)
        self.at, self.score = at[order], score[order]
        self.start = np.searchsorted(term[order], np.arange(n_terms + 1))
        self.blocks = -(-len(docs) // WIDE)
        self.bounds: dict[int, np.ndarray] = {}

    def bound(self, t: int) -> np.ndarray:
        """Largest score of a list in each block."""
        found = self.bounds.get(t)
        if found is None:
            found = np.zeros(self.blocks, dtype=np.int64)
            at, score = self.list(t)
            if len(at):
                head = np.flatnonzero(np.diff(at // WIDE, prepend=-1))
                found[at[head] // WIDE] = np.maximum.reduceat(score, head)
            self.bounds[t] = found
        return found

    def list(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        return self.at[self.start[t] : self.start[t + 1]], self.score[self.start[t] : self.start[t + 1]]

    def search(self, asked: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best (scores, ids) of the shard and of ``best``, which other documents have reached."""
        size = self.start[asked + 1] - self.start[asked]
        asked, size = asked[size > 0], size[size > 0]
        by_size = np.argsort(size, kind="stable")
        asked, size = asked[by_size], size[by_size]
        n_short = int(np.searchsorted(np.cumsum(size), SHORT, side="right"))
        # term at a time: one list of summed scores
        total = np.zeros(len(self.docs), dtype=np.int64)
        for t in asked[:n_short]:
            at, score = self.list(t)
            total[at] += score
        bound = np.maximum.reduceat(total, np.arange(0, len(total), WIDE))
        longs = sorted(asked[n_short:].tolist(), key=lambda t: -int(self.bound(t).max()))
        for t in longs:
            bound = bound + self.bound(t)
        rest = [int(self.bound(t).max()) for t in longs]
        rest = np.cumsum(rest[::-1])[::-1].tolist() + [0]  # what lists from here on can add
        least = lambda: int(best[0][-1]) if len(best[0]) == k else 1
        live = np.flatnonzero(bound >= least())
        live = live[np.argsort(-bound[live], kind="stable")]
        for first in range(0, len(live), STEP):
            group = live[first : first + STEP]
            group = np.sort(group[bound[group] >= least()])
            if not len(group):
                break  # bounds fall, so none that follows can enter
            places = (group[:, None] * WIDE + np.arange(WIDE)).ravel()
            places = places[places < len(total)]
            sums = total[places]
            for i, t in enumerate(longs):
                keep = sums + rest[i] >= least()
                places, sums = places[keep], sums[keep]
                if not len(places):
                    break
                at, score = self.list(t)
                found = np.searchsorted(at, places)
                found[found == len(at)] = 0
                sums = sums + np.where(at[found] == places, score[found], 0)
            keep = sums >= least()
            best = top(np.concatenate([best[0], sums[keep]]), np.concatenate([best[1], self.docs[places[keep]]]), k)
        return best


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, equal ones by ascending id."""
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def weights(documents: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df], dtype=np.int64)


def lengths(n: np.ndarray, documents: int, words: int) -> np.ndarray:
    """A document's m; whole numbers throughout, also where the product is beyond 64 bits."""
    if 50 * int(n.max(initial=0)) * documents < 1 << 63:
        return 50 + 50 * n * documents // words
    return np.array([50 + 50 * int(x) * documents // words for x in n], dtype=np.int64)


def searched(index: DataFrame, shared, w: np.ndarray, documents: int, words: int, k: int) -> DataFrame:
    """Each task's best k of each item: (key, doc, score)."""
    heavy = index.sparkSession.sparkContext.broadcast(w)  # one number a term of the group

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, items = heavy.value, shared.value.of
        best = {key: (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)) for key in items}
        held, size = [], 0

        def flush() -> None:
            docs = np.concatenate([h[0] for h in held])
            term, tf, m = (np.concatenate([h[i] for h in held]) for i in (1, 2, 4))
            at = np.repeat(np.arange(len(docs)), np.concatenate([h[3] for h in held]))
            order = np.argsort(docs, kind="stable")
            place = np.empty(len(docs), dtype=np.int64)
            place[order] = np.arange(len(docs))
            score = w[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[at]))
            shard = Shard(docs[order], term, place[at], score, len(w))
            for key, asked in items.items():
                best[key] = shard.search(asked, best[key], k)

        for batch in it:
            if not batch.num_rows:
                continue
            lists = batch.column("terms")
            sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            docs = batch.column("doc").fill_null(_NO_ID).to_numpy().astype(np.int64)
            flat = lambda c: batch.column(c).flatten().to_numpy().astype(np.int64)
            held.append((docs, flat("terms"), flat("counts"), sizes, lengths(batch.column("n").to_numpy(), documents, words)))
            size += int(sizes.sum()) + len(docs)
            if size >= SHARD:
                flush()
                held, size = [], 0
        if held:
            flush()
        for key, (scores, ids) in best.items():
            if len(ids):
                yield pa.record_batch({"key": pa.array(np.full(len(ids), key), pa.int64()), "doc": pa.array(ids, pa.int64(), mask=ids == _NO_ID), "score": pa.array(scores, pa.int64())})

    return index.mapInArrow(run, "key long, doc long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents (doc_id, text) of each item (item_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    asked = table(items.select(F.monotonically_increasing_id().alias("key"), "item_id", F.col("text").cast("string").alias("text")), "items")
    size = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    groups = -(-int(size) // (4 * TERMS))  # a term and its blank take two characters at least, four or more as a rule
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
    parts = []
    for g in range(groups):
        rows = asked.where(F.pmod(F.xxhash64("key"), F.lit(groups)) == g).select("key", "text").collect()  # TERMS terms or so
        shared = spark.sparkContext.broadcast(Items([(r["key"], None if r["text"] is None else r["text"].encode()) for r in rows]))
        n_terms = len(shared.value.numbers)
        index = table(counted(texts, shared), "postings")
        documents, words = index.agg(F.count("*"), F.sum("n")).first()
        if not documents or not n_terms:
            continue

        def frequencies(it: Iterator[pa.RecordBatch], n_terms: int = n_terms) -> Iterator[pa.RecordBatch]:
            df = np.zeros(n_terms, dtype=np.int64)
            for batch in it:
                df += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=n_terms)
            some = np.flatnonzero(df)
            yield pa.record_batch({"term": pa.array(some, pa.int64()), "df": pa.array(df[some], pa.int64())})

        df = np.zeros(n_terms, dtype=np.int64)
        for r in index.select("terms").mapInArrow(frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # a row a term of the group
            df[r["term"]] = r["df"]
        parts.append(searched(index, shared, weights(documents, df), documents, words, k))
    if not parts:
        return asked.limit(0).select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    # tasks' best: first among some tasks, then among what is left, so that no window grows with the number of tasks
    order = [F.desc("score"), F.asc_nulls_last("doc")]
    found = found.withColumn("lot", F.pmod(F.spark_partition_id(), F.lit(64)))
    for by in (["key", "lot"], ["key"]):
        found = found.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    return found.join(asked.select("key", "item_id"), "key").select("item_id", "rank", F.col("doc").alias("doc_id"), "score")


def op12_ranked_search(spark, sf_dir: str) -> DataFrame:
    """The 50 best documents of each benchmark item."""
    read = lambda name, key: spark.read.parquet(f"{sf_dir}/{name}.parquet").select(key, "text")
    return search(read("documents", "doc_id"), read("benchmark", "item_id"))


ORACLE_SQL = """
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words FROM documents),
q AS (SELECT row_number() OVER () AS key, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words FROM benchmark),
size AS (SELECT count(*) AS documents, CAST(sum(len(words)) AS BIGINT) AS total FROM d WHERE len(words) > 0),
m AS (SELECT row, doc_id, 50 + (50 * len(words) * documents) // total AS m FROM d, size WHERE len(words) > 0),
posting AS (SELECT row, word, count(*) AS tf FROM (SELECT row, unnest(words) AS word FROM d) GROUP BY row, word),
asked AS (SELECT DISTINCT key, item_id, word FROM (SELECT key, item_id, unnest(words) AS word FROM q)),
weight AS (SELECT word, CAST(floor(1000 * ln(CAST(2 * max(documents) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM posting, size WHERE word IN (SELECT word FROM asked) GROUP BY word),
scored AS (SELECT key, item_id, row, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score, any_value(doc_id) AS doc_id FROM asked JOIN weight USING (word) JOIN posting USING (word) JOIN m USING (row) GROUP BY key, item_id, row),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY key ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
