"""LM scoring with Elias-Fano n-gram tries.

The model is a trigram model that takes shares of the shorter n-grams' counts as pseudo-counts:
p(w | u v) = (c(uvw) + KAPPA c(vw) + MU q(w)) / (c(uv) + KAPPA c(v) + MU). q is the add-one
unigram distribution of all known words and one unknown. Summed over w, the numerators
give the divisor, so it is a distribution under every context.

A token is a word and the two before it. Texts are cut into batches of about ``FLUSH``
tokens, and a batch sends each shard the tokens whose word hashes to it. So a shard has
every token of its words: it counts them (c(w), hence q(w), of every word, however
rare), builds the trie of its words, those before them and those before these
(monotone pointers and quantised logs of the numerators in memory-mapped Elias-Fano
levels) and answers every token by successor search under its word. The divisor
depends on u and v alone, and v is itself a token of the text after u (or its start), so
the shard of v adds it. Scores and the words' counts come back by batch and are
summed by text. Words that hold a large share of all tokens (and the end of a text)
are dealt by the word before them too, and pairs of words that do by the word before
both; their totals are broadcast: about 8 words and 2 pairs a shard at most, since
each holds that share, and ``HEAD`` of either in any case. The number of shards grows with the corpus, so a shard's size does not
(but beyond HEAD / 8 shards a word of less than 1 / HEAD of all tokens, and at any size a frequent triple, is whole in one shard);
counts of all words are never gathered. Batches grow with the number of shards up to ``MOST_FLUSH`` tokens, so messages grow with
the tokens up to some 20,000 shards. A token's log probability is rounded once, to 1 / 1024, so a text's score doesn't depend on how
it was batched.

Words are 64-bit hashes, those before a word 32-bit ones.

Defined results: a null text counts as empty: one token (the end), none known
but the end. Repeated rows each get their row; training counts include each.
With no training rows every count is 0. Extra columns are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmill.llm.common import WordHash, fold, mix, raw, small_batches, table, words
from sessionmill.llm.elias_fano import Trie

#: Most words (and pairs of words) that are dealt by more than themselves: those of this share of all tokens or more, so there can't
#: be more. How many are changes no result.
HEAD = 1 << 16
#: Shares of the bigram's and the unigram's counts; chosen on a fold of the training rows.
KAPPA, MU = 0.001, 5.0
FLUSH, SHARD, LEAST_SHARDS = 1_500_000, 1_000_000, 64
#: A batch has about so many tokens for each shard at least, up to MOST_FLUSH in all, so that messages grow with the tokens.
EACH_SHARD, MOST_FLUSH = 256, 6_000_000
MOST_TEXTS = 60_000  # of a batch: places of texts are 16-bit
START, END = xxhash.xxh64_intdigest(b"  "), xxhash.xxh64_intdigest(b" ")  # words hold no space
_U = np.uint64
LEVELS = 1 << 16  # of the quantised logs of a shard
SLICE = 1 << 18  # questions to a trie at a time
_STEP = 1024.0  # log10 probabilities of tokens travel in units of 1 / _STEP


class Hot:
    """Sorted hashes with their counts."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]

    def count(self, hashes: np.ndarray) -> np.ndarray:
        """Count of each hash; -1 if it isn't one of these."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.counts[at], -1)


class Head:
    """Totals, words that are dealt by two words, and pairs (by ``pair_key``) that are dealt by three."""

    def __init__(self, words: Hot, pairs: Hot, total: int, distinct: int, shards: int):
        self.words, self.pairs, self.total, self.distinct, self.shards = words, pairs, total, distinct, shards


def pair_key(word: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Hash of words and the 32-bit prints of those before them."""
    return mix(word ^ mix(before.astype(_U)))


def unigrams(docs: DataFrame, shards: int) -> DataFrame:
    """(word long, n long): training count of every word, from docs (text, train)."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, size = WordHash(), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            shard = (mix(h) % _U(shards)).astype(np.int32)
            order = np.argsort(shard, kind="stable")
            h, n, shard = h[order], n[order].astype(np.int32), shard[order]
            which, first = np.unique(shard, return_index=True)
            ends = np.append(first[1:], len(h))
            yield pa.record_batch({"shard": pa.array(which, pa.int32()), "words": pa.array([h[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary()), "counts": pa.array([n[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary())})

        for batch in it:
            for text, train in zip(raw(batch.column("text")), batch.column("train").to_pylist(), strict=True):
                if text and train:
                    held.append(seen.of(words(text)))
                    size += len(held[-1])
                    if size >= FLUSH:
                        yield from flush()
                        held, size = [], 0
        if size:
            yield from flush()

    def total(group: pa.Table) -> pa.Table:
        h = np.frombuffer(b"".join(group["words"].to_pylist()), dtype=_U)
        n = np.frombuffer(b"".join(group["counts"].to_pylist()), dtype=np.int32)
        which, place = np.unique(h, return_inverse=True)
        return pa.table({"word": which.view(np.int64), "n": np.bincount(place, n).astype(np.int64)})

    return docs.select("text", "train").mapInArrow(count, "shard int, words binary, counts binary").groupBy("shard").applyInArrow(total, "word long, n long")


def commonest(counts: DataFrame, least: int) -> list:
    """Rows of the words that stand ``least`` times or more."""
    return sorted(counts.where(F.col("n") >= least).collect(), key=lambda r: (-r["n"], r["word"]))


def hot_pairs(docs: DataFrame, common: Hot, least: int) -> Hot:
    """Pairs of the given words (any may be the start) that stand ``least`` times or more in training texts."""
    given = docs.sparkSession.sparkContext.broadcast(common)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, size = WordHash(), [], 0

        def flush() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.record_batch({"key": pa.array(key.view(np.int64)), "n": pa.array(n.astype(np.int64))})

        for batch in it:
            for text, train in zip(raw(batch.column("text")), batch.column("train").to_pylist(), strict=True):
                if train:
                    h = np.concatenate([[_U(START)], seen.of(words(text or b"")), [_U(END)]]).astype(_U)
                    hot = given.value.count(h) >= 0
                    hot[0] = True
                    both = np.flatnonzero(hot[1:] & hot[:-1])
                    held.append(pair_key(h[both + 1], h[both] & _U(0xFFFFFFFF)))
                    size += len(both) + 1
                    if size >= FLUSH:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    found = docs.select("text", "train").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).collect()
    return Hot(np.array([r["key"] % (1 << 64) for r in found], dtype=_U), np.array([r["n"] for r in found], dtype=np.int64))


def _join(parts: list[np.ndarray]) -> bytes:
    """Arrays behind one another, each after its size in bytes."""
    return b"".join(x for p in parts for x in (np.int64(p.nbytes).tobytes(), np.ascontiguousarray(p).tobytes()))


def _split(data: bytes, kinds: tuple) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        size = int(np.frombuffer(data, dtype=np.int64, count=1, offset=at)[0])
        out.append(np.frombuffer(data, dtype=kind, count=size // np.dtype(kind).itemsize, offset=at + 8))
        at += 8 + size
    return out


#: words of a batch in a shard, tokens of each, prints of the words before and of those before them, texts (as differences)
SENT = (np.uint64, np.uint32, np.uint32, np.uint32, np.uint16)


def deal(docs: DataFrame, head) -> DataFrame:
    """(shard, batch, train, tokens, texts): a batch's tokens for each shard; texts (ids and sizes) go with one of them."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part, batches = head.value, TaskContext.get().partitionId(), 0
        flush_at = max(FLUSH, min(MOST_FLUSH, EACH_SHARD * known.shards))
        seen, held, size = WordHash(), {False: [], True: []}, {False: 0, True: 0}

        def flush(train: bool) -> pa.RecordBatch:
            nonlocal batches
            number = part << 32 | batches
            batches += 1
            n = np.array([len(h) for _, h in held[train]], dtype=np.int64) + 1
            starts = np.cumsum(n) - n
            after = np.full(int(n.sum()), END, dtype=_U)
            context = np.full(int(n.sum()), START, dtype=_U)
            farther = np.full(int(n.sum()), START & 0xFFFFFFFF, dtype=np.uint32)
            for (_, h), s in zip(held[train], starts, strict=True):
                after[s : s + len(h)] = h
                context[s + 1 : s + 1 + len(h)] = h
                farther[s + 2 : s + 1 + len(h)] = (h[:-1] & _U(0xFFFFFFFF)).astype(np.uint32)
            text = np.repeat(np.arange(len(n)), n)
            prints = (context & _U(0xFFFFFFFF)).astype(np.uint32)
            pair = pair_key(after, prints)
            key = np.where(known.words.count(after) >= 0, pair, mix(after))
            key = np.where(known.pairs.count(pair) >= 0, mix(pair ^ mix(farther.astype(_U))), key)
            shard = (key % _U(known.shards)).astype(np.int32)
            order = np.lexsort((text, after, shard))
            shard, after, prints, farther, text = shard[order], after[order], prints[order], farther[order], text[order].astype(np.uint16)
            which, first = np.unique(shard, return_index=True)
            rows = []
            for a, b in zip(first, np.append(first[1:], len(shard)), strict=True):
                c = after[a:b]
                heads = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
                rows.append(_join([c[heads], np.diff(np.append(heads, b - a)).astype(np.uint32), prints[a:b], farther[a:b], np.diff(text[a:b], prepend=np.uint16(0))]))
            ids = [d for d, _ in held[train]]
            about = _join([np.array([d if d is not None else 0 for d in ids], dtype=np.int64), np.array([d is None for d in ids], dtype=np.uint8), n])
            held[train], size[train] = [], 0
            return pa.record_batch(
                {"shard": pa.array(which, pa.int32()), "batch": pa.array([number] * len(which), pa.int64()), "train": pa.array([train] * len(which), pa.bool_()), "tokens": pa.array(rows, pa.binary()), "texts": pa.array([about] + [None] * (len(which) - 1), pa.binary())}
            )

        for batch in it:
            for d, text, train in zip(batch.column("doc_id").to_pylist(), raw(batch.column("text")), batch.column("train").to_pylist(), strict=True):
                h = seen.of(words(text)) if text else np.zeros(0, dtype=_U)
                held[train].append((d, h))
                size[train] += len(h) + 1
                if size[train] >= flush_at or len(held[train]) >= MOST_TEXTS:
                    yield flush(train)
        for train in (False, True):
            if held[train]:
                yield flush(train)

    return docs.select(F.col("doc_id").cast("long"), "text", "train").mapInArrow(run, "shard int, batch long, train boolean, tokens binary, texts binary")


#: texts (as differences), their known tokens, sums of log10(count + 1), and sums of rounded scores (32 bits, or 64 where these don't do)
SUMS = (np.uint16, np.uint32, np.float64, np.uint8)
#: counts of words, tokens of each, texts (as differences), scores of tokens
EACH = (np.uint32, np.uint32, np.uint16, np.int16)


def answer(head, kappa: float, mu: float):
    """Function of a shard's group: the same batches with their tokens' scores, summed by text where that is shorter."""

    def run(group: pa.Table) -> pa.Table:
        known = head.value
        sent = [_split(t, SENT) for t in group["tokens"].to_pylist()]
        train = np.array(group["train"].to_pylist(), dtype=bool)
        mine, place = np.unique(np.concatenate([s[0] for s in sent]), return_inverse=True)
        runs = np.concatenate([s[1] for s in sent]).astype(np.int64)
        sizes = np.array([len(s[2]) for s in sent], dtype=np.int64)
        rank = np.repeat(place, runs)
        low = _U(0xFFFFFFFF)
        pairs, at_pair = np.unique(rank.astype(_U) << _U(32) | np.concatenate([s[2] for s in sent]).astype(_U), return_inverse=True)
        triples, at_triple = np.unique(at_pair.astype(_U) << _U(32) | np.concatenate([s[3] for s in sent]).astype(_U), return_inverse=True)
        at_triple = at_triple.astype(np.int32)
        del rank, at_pair
        # training counts of the trigrams, bigrams and words here
        pair = (triples >> _U(32)).astype(np.int64)
        n3 = np.bincount(at_triple[np.repeat(train, sizes)], minlength=len(triples))
        n2 = np.bincount(pair, n3, minlength=len(pairs)).astype(np.int64)
        owner = (pairs >> _U(32)).astype(np.int64)
        count = np.bincount(owner, n2, minlength=len(mine)).astype(np.int64)
        # tokens of a hot word or pair are in many shards, so its total comes with the head; others are whole here
        total = known.words.count(mine)
        count = np.where(total >= 0, total, count)
        total = known.pairs.count(pair_key(mine[owner], pairs & low))
        n2 = np.where(total >= 0, total, n2)
        share = mu * (count + 1.0) / (known.total + known.distinct + 1)
        two, three = np.flatnonzero(n2), np.flatnonzero(n3)
        here, first = np.unique(owner[two], return_index=True)
        below = np.searchsorted(pair[three], two)
        second, third = (pairs[two] & low).astype(np.uint32), (triples[three] & low).astype(np.uint32)
        base = kappa * n2 + share[owner]
        deeper = (np.append(below, len(three)), third, np.log10(n3[three] + base[pair[three]]))
        trie = Trie(mine[here], np.append(first, len(two)), second, np.log10(base[two]), LEVELS, (deeper,))
        roots, found = trie.find(mine), np.empty(len(triples))
        for a in range(0, len(triples), SLICE):
            p = pair[a : a + SLICE]
            found[a : a + SLICE] = trie.score(roots[owner[p]], (pairs[p] & low).astype(np.uint32), (triples[a : a + SLICE] & low).astype(np.uint32))
        # the word and the one before it are those before the next token, but for the end
        divisor = np.where(mine[owner] == _U(END), 0.0, np.log10(n2 + kappa * count[owner] + mu))
        found = np.where(np.isnan(found), np.log10(share)[owner[pair]], found) - divisor[pair]
        found = np.maximum(np.round(found * _STEP), -32768) / _STEP  # one rounding of a token, however it travels; sums of these are exact
        counts = count[place]
        out, at, run_at = [], 0, 0
        for s in sent:
            score, c = found[at_triple[at : at + len(s[2])]], counts[run_at : run_at + len(s[0])]
            text = np.cumsum(s[4], dtype=np.uint16)
            at, run_at = at + len(s[2]), run_at + len(s[0])
            which, spot = np.unique(text, return_inverse=True)
            if 18 * len(which) <= 4 * len(text) + 8 * len(c):
                each = np.repeat(c, s[1])
                sums = [np.bincount(spot, x, minlength=len(which)) for x in (each > 0, np.log10(each + 1.0), score)]
                codes = np.rint(sums[2] * _STEP).astype(np.int64)
                codes = codes.astype(np.int32) if np.abs(codes).max(initial=0) < 1 << 31 else codes
                out.append((True, _join([np.diff(which, prepend=np.uint16(0)), sums[0].astype(np.uint32), sums[1], codes])))
            else:
                if (c >= 1 << 32).any():
                    raise OverflowError("a word's count is over 32 bits")
                code = np.round(score * _STEP).astype(np.int16)
                out.append((False, _join([c.astype(np.uint32), s[1], s[4], code])))
        return pa.table({"batch": group["batch"], "train": group["train"], "summed": pa.array([x for x, _ in out], pa.bool_()), "data": pa.array([x for _, x in out], pa.binary()), "texts": group["texts"]})

    return run


def gather(head, kappa: float, mu: float):
    """Function of a batch's group: one row a text."""

    def run(group: pa.Table) -> pa.Table:
        ids, missing, n = _split(next(t for t in group["texts"].to_pylist() if t is not None), (np.int64, np.uint8, np.int64))
        ends = head.value.words.count(np.array([END], dtype=_U))[0]
        known, logs, score = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids)), np.full(len(ids), -np.log10(ends + kappa * ends + mu))  # the start's divisor
        for summed, data in zip(group["summed"].to_pylist(), group["data"].to_pylist(), strict=True):
            if summed:
                text, k, ls, s = _split(data, SUMS)
                s = s.view(np.int32 if len(s) == 4 * len(text) else np.int64) / _STEP
                text = np.cumsum(text, dtype=np.uint16)
                known[text] += k
                logs[text] += ls
                score[text] += s
            else:
                c, runs, text, code = _split(data, EACH)
                text, c = np.cumsum(text, dtype=np.uint16), np.repeat(c.astype(np.int64), runs)
                known += np.bincount(text, c > 0, minlength=len(ids)).astype(np.int64)
                logs += np.bincount(text, np.log10(c + 1.0), minlength=len(ids))
                score += np.bincount(text, code / _STEP, minlength=len(ids))
        base = logs - n * np.log10(head.value.total + head.value.distinct + 1.0)
        return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=missing > 0), "train": pa.array([group["train"][0].as_py()] * len(ids), pa.bool_()), "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(known, pa.int64()), "base_score": base, "score": score})

    return run


def score(docs: DataFrame, train: Column, kappa: float = KAPPA, mu: float = MU) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score of each row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    seen = docs.select("doc_id", "text", F.coalesce(train, F.lit(False)).alias("train"))
    about = seen.agg(F.sum(F.length("text")).alias("chars"), F.count_if("train").alias("texts"), F.count("*").alias("rows")).first()
    shards = max(LEAST_SHARDS, ((about["chars"] or 0) // 6 + about["rows"]) // SHARD)
    counts = table(unigrams(seen, shards), "unigrams")
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    tokens = (total["n"] or 0) + about["texts"]
    # thresholds are shares of all tokens and not below 1 / HEAD, so at most HEAD rows come to the driver, whatever the corpus
    top = commonest(counts, max(1, tokens // (8 * shards), -(-tokens // HEAD)))
    hot = Hot(np.array([r["word"] % (1 << 64) for r in top] + [END], dtype=_U), np.array([r["n"] for r in top] + [about["texts"]], dtype=np.int64))
    least = max(1, tokens // (2 * shards), -(-tokens // HEAD))
    often = hot.counts >= least
    pairs = hot_pairs(seen, Hot(hot.hashes[often], hot.counts[often]), least)
    head = docs.sparkSession.sparkContext.broadcast(Head(hot, pairs, tokens, total["v"] + (about["texts"] > 0), shards))
    answered = deal(seen, head).groupBy("shard").applyInArrow(answer(head, kappa, mu), "batch long, train boolean, summed boolean, data binary, texts binary")
    out = answered.groupBy("batch").applyInArrow(gather(head, kappa, mu), "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "train", "n_tokens", "n_known", F.lit(head.value.total).cast("long").alias("train_tokens"), "base_score", "score")


def op8_lm_score(spark, sf_dir: str) -> DataFrame:
    """Log probability of every document under a model of those outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score(docs, fold(F.col("doc_id"), 7) != 2)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
