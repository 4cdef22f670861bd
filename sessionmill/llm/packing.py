"""Cost-balanced packing of documents into training sequences.

A task tokenises its documents and packs them by blocks of about ``BLOCK`` tokens, so nothing is shuffled and no more than a
block is held. In a block the estimated cost of a piece of n tokens is ``LINEAR`` n + ``QUADRATIC`` n^2 (attention stays within a
document). Documents are dealt in descending order, each to the sequence of lowest cost that has room for the whole of it. Only
what no sequence has room for is cut, and pieces of a full sequence are cut off long documents first.

A block of T tokens gets T // size sequences of ``size`` tokens; the remaining T % size tokens get one sequence for each power of
two in that number. So all sequences end up full, and since those at a power of two need no padding, none is padded.

Ids are those of the tokenizer file for ``tokenizers`` (no special tokens added, one id 0 behind each document). Texts of common
characters are encoded by ``tiktoken`` from the ranks of the same vocabulary, which gives the same ids at three times the speed;
all others, and texts with a special token's string or a very long run of white space, by ``tokenizers`` itself.

Defined results: a null or empty text has the one id 0. Each row is a document, also if its doc_id is null or repeated. An empty
table has no pieces. Sequence ids are the number of the scan's partition and a counter, so they are unique and the same again if
a task runs again, but follow from how the files are split. Other columns of the input are not read.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sessionmill.llm.common import batches, small_batches

SIZE, BLOCK = 1024, 1 << 21
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"

#: Characters whose class (letter, digit, space, other) is the same in every Unicode version since 5.
_COMMON = re.compile(r"[\t\n\r -~ -ɏЀ-ӿ‐-‧ぁ-ゖァ-ヺ一-龥]*")
_RUN = re.compile(r"\s{2000}|\S{20000}")


class Encoder:
    """Texts to ids; built once a task."""

    def __init__(self, tokenizer: str = TOKENIZER, ranks: str = RANKS):
        self.plain = Tokenizer.from_file(public_tokenizers.path(tokenizer))
        self.special = [t.content for t in self.plain.get_added_tokens_decoder().values()]
        with open(public_tokenizers.path(ranks), "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if _COMMON.fullmatch(text) and not any(s in text for s in self.special) and not _RUN.search(text):
            return self.fast.encode_ordinary(text)
        return self.plain.encode(text, add_special_tokens=False).ids


class Sequences:
    """Open sequences by the room they have left; finds the one of lowest cost with enough room."""

    def __init__(self, size: int):
        self.size = size
        self.leaves = 1 << size.bit_length()
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(size + 1)]
        self.least = [(float("inf"), -1)] * (2 * self.leaves)

    def _update(self, room: int) -> None:
        at = self.leaves + room
        self.least[at] = self.heaps[room][0] if self.heaps[room] else (float("inf"), -1)
        at //= 2
        while at:
            self.least[at] = min(self.least[2 * at], self.least[2 * at + 1])
            at //= 2

    def put(self, room: int, cost: float, sequence: int) -> None:
        if room:
            heapq.heappush(self.heaps[room], (cost, sequence))
            self._update(room)

    def fill(self, room: int, sequences: range) -> None:
        """Empty sequences of one size."""
        self.heaps[room] = [(0.0, s) for s in sequences]
        self._update(room)

    def cheapest(self, room: int) -> int:
        """Number of the cheapest sequence with at least so much room, or -1."""
        low, high, best = self.leaves + room, 2 * self.leaves, (float("inf"), -1)
        while low < high:
            if low & 1:
                best = min(best, self.least[low])
                low += 1
            if high & 1:
                high -= 1
                best = min(best, self.least[high])
            low //= 2
            high //= 2
        return best[1]

    def take(self, room: int) -> tuple[float, int]:
        found = heapq.heappop(self.heaps[room])
        self._update(room)
        return found

    def roomiest(self) -> int:
        return next(r for r in range(self.size, 0, -1) if self.heaps[r])


def assign(lengths: np.ndarray, size: int = SIZE, linear: float = LINEAR, quadratic: float = QUADRATIC) -> np.ndarray:
    """Rows (document, start, length, sequence, offset), by sequence and offset, for documents of these lengths."""
    full, rest = lengths // size, lengths % size
    doc = np.repeat(np.arange(len(lengths)), full)
    first = np.cumsum(full) - full
    number = np.arange(len(doc))
    start = (number - first[doc]) * size
    rows = [np.stack([doc, start, np.full(len(doc), size), number, np.zeros(len(doc), dtype=np.int64)], 1)]
    total, next_one = int(rest.sum()), len(doc)
    room = {size: total // size} | {1 << b: 1 for b in range(size.bit_length()) if total % size >> b & 1}
    left: list[int] = []
    open_ = Sequences(size)
    for r, n in room.items():
        if n:
            open_.fill(r, range(next_one, next_one + n))
            left += [r] * n
            next_one += n
    base, made = len(doc), []
    used = [0] * len(left)
    for d in np.argsort(-rest, kind="stable").tolist():
        n = int(rest[d])
        at = int(full[d]) * size
        while n:
            s = open_.cheapest(n)
            r = left[s - base] if s >= 0 else open_.roomiest()  # room for the whole, else the most room there is
            cost, s = open_.take(r)
            part = min(n, r)
            made.append((d, at, part, s, used[s - base]))
            used[s - base] += part
            left[s - base] -= part
            open_.put(r - part, cost + linear * part + quadratic * part * part, s)
            at += part
            n -= part
    rows.append(np.array(made, dtype=np.int64).reshape(-1, 5))
    out = np.concatenate(rows)
    return out[np.lexsort((out[:, 4], out[:, 3]))]


def pack(docs: DataFrame, size: int = SIZE, block: int = BLOCK, linear: float = LINEAR, quadratic: float = QUADRATIC, tokenizer: str = TOKENIZER, ranks: str = RANKS) -> DataFrame:
    """Pieces of documents (doc_id, text): doc_id, start, length, ids (binary, unsigned 32-bit little-endian), doc_tokens, sequence_id, offset."""
    small_batches(docs.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, made = Encoder(tokenizer, ranks), TaskContext.get().partitionId() << 40
        doc_ids, held, tokens = [], [], 0

        def emit() -> Iterator[pa.RecordBatch]:
            nonlocal made, tokens
            lengths = np.array([len(h) // 4 for h in held], dtype=np.int64)
            rows = assign(lengths, size, linear, quadratic)
            for at in range(0, len(rows), 4096):
                d, start, length, sequence, offset = rows[at : at + 4096].T
                ids = [held[i][4 * a : 4 * (a + n)] for i, a, n in zip(d.tolist(), start.tolist(), length.tolist(), strict=True)]
                yield pa.record_batch({"doc_id": pa.array([doc_ids[i] for i in d.tolist()], pa.int64()), "start": start, "length": length, "ids": pa.array(ids, pa.binary()), "doc_tokens": lengths[d], "sequence_id": made + sequence, "offset": offset})
            made += int(rows[:, 3].max()) + 1
            doc_ids.clear()
            held.clear()
            tokens = 0

        for batch in batches(it, 200):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = encoder.ids(text or "")
                ids.append(0)
                doc_ids.append(doc_id)
                held.append(np.array(ids, dtype="<u4").tobytes())
                tokens += len(ids)
                if tokens >= block:
                    yield from emit()
        if held:
            yield from emit()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def op13_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens, none padded."""
    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
