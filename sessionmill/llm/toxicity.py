"""Toxicity: a counterfactually regularised classifier.

Features are the presence of words and of word beginnings (3 to 6 letters),
hashed. A bounded sample of labelled texts is drawn by a hash of their id; Spark
counts each feature by class over it and keeps the ``KEEP`` features with the
largest standardised log odds. A logistic regression over those is fitted on the
sample with three terms: log loss, an L2 penalty, and ``SWAP_WEIGHT`` times the
squared change of the score when the identity terms of a labelled sentence are
swapped for others of their group. The last term takes weight from identity
terms, so that neutral mentions of a group are not scored up.

Identity terms are the given lists and, so that there are some in every language,
groups of words that the sample itself shows to be interchangeable: words of medium
frequency whose labels are balanced (within TERM_Z) and that stand between the same
neighbours. The terms' own features are always kept.

Defined results: a null or empty text gets the score of a text without features.
A label that is null is not used; of repeated labels of one document the larger
counts. Without labelled rows of both classes every score is 0. Repeated rows
each get their row; columns named score or predicted are replaced. Texts are read whole; the number of features of a text is
bounded by ``BUCKETS``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionmill.llm.common import batches, fold, small_batches, table

BUCKETS, KEEP = 1 << 18, 3072
BEGINNINGS = (3, 4, 5, 6)
#: Labelled texts that are drawn at most (about), by class.
TRAIN_TOXIC, TRAIN_CLEAN = 5_000, 10_000
L2, SWAP_WEIGHT, EPOCHS, RATE, BATCH = 5e-5, 2.0, 60, 0.05, 512
EDGE = " \t\r\n.,;:!?\"'()[]{}<>*#%&$|/\\-_=+~`^@«»¡¿…“”‘’"

#: Identity terms by group; a term is swapped for the others of its group.
IDENTITY_TERMS = {
    "gender": ["women", "men", "girls", "boys", "transgender people", "nonbinary people"],
    "person": ["woman", "man", "girl", "boy"],
    "faith": ["muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "atheists"],
    "faithful": ["muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "atheist"],
    "orientation": ["gay", "lesbian", "bisexual", "straight", "queer", "heterosexual"],
    "origin": ["black", "white", "asian", "african", "european", "latino", "arab", "indian", "american"],
    "status": ["immigrants", "refugees", "foreigners", "locals", "natives"],
    "ability": ["disabled", "blind", "deaf", "autistic", "abled"],
    "age": ["old", "young", "elderly", "teenage"],
}
#: Learned terms: at most so many, in this range of shares of the sample's texts, with standardised log odds of at most TERM_Z, in groups
#: of words whose neighbours have at least this cosine; buckets of neighbours.
TERMS, TERM_SHARE, TERM_Z, TERM_COSINE, NEIGHBOURS = 300, (0.002, 0.1), 2.0, 0.5, 256
SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")


class Features(dict):
    """Word to a row of feature numbers; at most ``limit`` words are remembered."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit, self.rows = limit, np.zeros((limit, 1 + len(BEGINNINGS)), dtype=np.int32)
        self.place = np.zeros(BUCKETS, dtype=np.int32)

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        bare = word.strip(EDGE)
        names = [bare] + [f"^{bare[:n]}" if len(bare) >= n else bare for n in BEGINNINGS]
        at = self[word] = len(self)
        self.rows[at] = [xxhash.xxh32_intdigest(x.encode()) % (BUCKETS - 1) + 1 if bare else 0 for x in names]
        return at

    def of(self, text: str | None) -> np.ndarray:
        """Distinct feature numbers of a text, 0 left out."""
        found = list(set((text or "").lower().split()))
        out = []
        for start in range(0, len(found), 50_000):
            some = found[start : start + 50_000]
            if len(self) + len(some) >= self.limit:
                self.clear()
            out.append(self.rows[np.fromiter(map(self.__getitem__, some), dtype=np.int64, count=len(some))].ravel())
        f = np.concatenate(out) if out else np.zeros(0, dtype=np.int32)
        f = f[f > 0]
        order = np.arange(len(f), dtype=np.int32)
        self.place[f] = order
        return f[self.place[f] == order]


def swapper(terms: dict[str, list[str]]):
    """Function from a sentence to the same sentence with each identity term swapped, once a shift; none without a term."""
    group = {t: g for g in terms.values() for t in g if len(g) > 1}
    if not group:
        return lambda sentence: []
    longer = [t for t in group if " " in t]
    phrase = re.compile(r"\b(" + "|".join(sorted(map(re.escape, longer), key=len, reverse=True)) + r")\b", re.IGNORECASE) if longer else None
    other = lambda term, shift: (g := group[term])[(g.index(term) + shift) % len(g)]

    def swap(sentence: str) -> list[str]:
        out = []
        for shift in (1, 2):
            made = phrase.sub(lambda m: other(m[0].lower(), shift), sentence) if phrase else sentence  # noqa: B023
            parts = made.split(" ")
            for i, word in enumerate(parts):
                bare = word.strip(EDGE)
                if bare and bare.lower() in group:
                    parts[i] = word.replace(bare, other(bare.lower(), shift), 1)
            made = " ".join(parts)
            if made != sentence and made not in out:
                out.append(made)
        return out

    return swap


def interchangeable(drawn: DataFrame, n_toxic: int, n_clean: int) -> dict[str, list[str]]:
    """Groups of words of drawn (text, toxic) with balanced labels and the same neighbours. The sample is bounded, and so is what comes back."""

    def bare(text: str | None) -> list[str]:
        return [w.strip(EDGE) for w in (text or "").lower().split()]

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[str, list[int]] = {}
        for batch in it:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                for w in set(bare(text)):
                    n.setdefault(w, [0, 0])[int(toxic == 1)] += 1
        yield pa.record_batch({"word": pa.array(list(n), pa.string()), "clean": pa.array([x[0] for x in n.values()], pa.int64()), "toxic": pa.array([x[1] for x in n.values()], pa.int64())})

    counts = drawn.mapInArrow(count, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    share = (F.col("clean") + F.col("toxic")) / (n_toxic + n_clean)
    a, b = F.col("toxic") + 0.5, F.col("clean") + 0.5
    z = (F.log(a / (n_toxic + 1.0 - F.col("toxic"))) - F.log(b / (n_clean + 1.0 - F.col("clean")))) / F.sqrt(1 / a + 1 / b)
    known = counts.where((F.length("word") > 2) & share.between(*TERM_SHARE) & (F.abs(z) <= TERM_Z)).orderBy(F.desc(share), "word").limit(TERMS)
    words = [r["word"] for r in known.select("word").collect()]
    if not words:
        return {}

    def beside(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, n = {w: i for i, w in enumerate(words)}, np.zeros((len(words), 2 * NEIGHBOURS), dtype=np.int64)
        for batch in it:
            for text in batch.column("text").to_pylist():
                found = bare(text)
                for i, w in enumerate(found):
                    if (k := place.get(w)) is not None:
                        for side, j in ((0, i - 1), (1, i + 1)):
                            if 0 <= j < len(found):
                                n[k, side * NEIGHBOURS + xxhash.xxh32_intdigest(found[j].encode("utf-8", "surrogatepass")) % NEIGHBOURS] += 1
        k, c = np.nonzero(n)
        yield pa.record_batch({"k": pa.array(k, pa.int64()), "c": pa.array(c, pa.int64()), "n": pa.array(n[k, c], pa.int64())})

    seen = np.zeros((len(words), 2 * NEIGHBOURS))
    for r in drawn.mapInArrow(beside, "k long, c long, n long").groupBy("k", "c").agg(F.sum("n").alias("n")).collect():
        seen[r["k"], r["c"]] = r["n"]
    seen = np.log1p(seen)
    seen -= seen.mean(0)  # what all words have beside them tells nothing
    seen /= np.maximum(1e-9, np.sqrt((seen**2).sum(1, keepdims=True)))
    near, free, groups = seen @ seen.T, set(range(len(words))), {}
    for i in range(len(words)):
        if i in free:
            mates = [j for j in np.argsort(-near[i], kind="stable").tolist() if j in free and j != i and near[i, j] >= TERM_COSINE][:3]
            if mates:
                free -= {i, *mates}
                groups[f"learned {words[i]}"] = [words[i], *[words[j] for j in mates]]
    return groups


def sample(labels: DataFrame, toxic: int = TRAIN_TOXIC, clean: int = TRAIN_CLEAN) -> DataFrame:
    """(doc_id, toxic) of about so many labelled documents a class."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    draw = F.xxhash64("doc_id", F.lit("toxicity")).bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40))
    return known.where(draw < F.when(F.col("toxic") == 1, toxic / max(1, n.get(1, 0))).otherwise(clean / max(1, n.get(0, 0))))


def count_features(drawn: DataFrame) -> DataFrame:
    """(feature, toxic, clean): documents of each class with the feature, from (text, toxic)."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, n = Features(), np.zeros((2, BUCKETS), dtype=np.int64)
        for batch in it:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                n[int(toxic == 1), features.of(text)] += 1
        at = np.flatnonzero(n.any(0))
        yield pa.record_batch({"feature": at, "clean": n[0][at], "toxic": n[1][at]})

    return drawn.mapInArrow(count, "feature long, clean long, toxic long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def choose(counts: DataFrame, n_toxic: int, n_clean: int, keep: int = KEEP) -> np.ndarray:
    """The ``keep`` features with the largest standardised log odds, either way."""
    a, b = F.col("toxic") + 0.5, F.col("clean") + 0.5
    odds = F.log(a / (n_toxic + 1.0 - F.col("toxic"))) - F.log(b / (n_clean + 1.0 - F.col("clean")))
    z = odds / F.sqrt(1.0 / a + 1.0 / b)
    top = counts.where("toxic + clean >= 2").select("feature", z.alias("z")).orderBy(F.abs("z").desc(), "feature").limit(keep)
    return np.sort(np.array([r["feature"] for r in top.collect()], dtype=np.int64))


def project(drawn: DataFrame, chosen: np.ndarray, terms: dict[str, list[str]]) -> DataFrame:
    """(kind, toxic, bits, other): a labelled text's features as bits; for each swapped sentence, those before and after."""
    at = np.full(BUCKETS, -1, dtype=np.int64)
    at[chosen] = np.arange(len(chosen))

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, swap = Features(), swapper(terms)
        pairs: dict[int, tuple] = {}  # those of the smallest hashes
        worst = 0

        def bits(text: str) -> bytes:
            x = np.zeros(len(chosen), dtype=np.uint8)
            f = at[features.of(text)]
            x[f[f >= 0]] = 1
            return np.packbits(x).tobytes()

        for batch in batches(it, 500):
            out: list[tuple] = []
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                out.append(("text", int(toxic == 1), bits(text or ""), None))
                for s in SENTENCE.findall(text or ""):
                    h = xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"))
                    if len(pairs) < MAX_PAIRS or h < worst:
                        for i, other in enumerate(swap(s)):
                            pairs[h + i & (1 << 64) - 1] = (bits(s), bits(other))
                    if len(pairs) >= 2 * MAX_PAIRS:
                        pairs = dict(sorted(pairs.items())[:MAX_PAIRS])
                        worst = max(pairs)
            yield as_batch(out)
        yield as_batch([("pair", 0, a, b) for _, (a, b) in sorted(pairs.items())[:MAX_PAIRS] if a != b])

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 4
        return pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["kind", "toxic", "bits", "other"])

    return drawn.mapInArrow(rows, "kind string, toxic int, bits binary, other binary")


def fit(x: np.ndarray, y: np.ndarray, pairs: np.ndarray, dims: int, swap_weight: float = SWAP_WEIGHT, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias. x: packed bits (texts x bytes), y: 0 or 1, pairs: int8 differences (pairs x dims) of swapped sentences."""
    w, bias = np.zeros(dims), float(np.log(max(1, y.sum()) / max(1, len(y) - y.sum())))
    m, v, step, order = np.zeros(dims + 1), np.zeros(dims + 1), 0, np.random.default_rng(7)
    pairs = pairs.astype(np.float32)
    for epoch in range(epochs):
        rate = RATE * (0.5 + 0.5 * np.cos(np.pi * epoch / epochs)) + 1e-4
        for part in np.array_split(order.permutation(len(y)), max(1, len(y) // BATCH)):
            bits = np.unpackbits(x[part], axis=1, count=dims).astype(np.float32)
            p = 1 / (1 + np.exp(-np.clip(bits @ w.astype(np.float32) + bias, -30, 30)))
            grad = np.append(bits.T @ (p - y[part]) / len(part) + L2 * w, np.mean(p - y[part]))
            if len(pairs):
                some = pairs[order.integers(0, len(pairs), PAIR_BATCH)]
                grad[:-1] += 2 * swap_weight * some.T @ (some @ w.astype(np.float32)) / len(some)
            step += 1
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
            w, bias = w - move[:-1], bias - move[-1]
    return w, bias


#: Swapped sentences that the fit uses at most (about, drawn by a hash), and of those a step.
MAX_PAIRS, PAIR_BATCH = 5_000, 256


def learn(docs: DataFrame, labels: DataFrame, terms: dict[str, list[str]] = IDENTITY_TERMS, swap_weight: float = SWAP_WEIGHT) -> tuple[np.ndarray, float] | None:
    """Weights by feature number and the bias, from docs (doc_id, text) and labels (doc_id, toxic); None if a class is missing.

    The drawn ids are bounded by TRAIN_TOXIC + TRAIN_CLEAN, so their broadcast is too.
    """
    small_batches(docs.sparkSession)
    drawn = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(sample(labels)), "doc_id").select("text", "toxic")
    drawn = table(drawn, "drawn")  # read again below, and bounded
    n = {r["toxic"]: r["count"] for r in drawn.groupBy("toxic").count().collect()}
    if not n.get(1) or not sum(c for k, c in n.items() if k != 1):
        return None
    clean = sum(c for k, c in n.items() if k != 1)
    terms = terms | interchangeable(drawn, n[1], clean)
    own = Features()
    chosen = np.union1d(choose(count_features(drawn), n[1], clean), np.concatenate([np.zeros(0, dtype=np.int64), *[own.of(t) for g in terms.values() for t in g]])).astype(np.int64)
    made = table(project(drawn, chosen, terms), "projected")
    swapped = made.where("kind = 'pair' and bits <> other").select("bits", "other").distinct()
    draw = F.xxhash64("bits", "other").bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40))
    pairs = swapped.where(draw < 1.1 * MAX_PAIRS / max(1, swapped.count())).collect()
    pairs = sorted(pairs, key=lambda r: (bytes(r["bits"]), bytes(r["other"])))
    rows = made.where("kind = 'text'").select("toxic", "bits").collect()
    rows.sort(key=lambda r: (r["toxic"], bytes(r["bits"])))
    unpack = lambda c: np.unpackbits(np.array([np.frombuffer(r[c], dtype=np.uint8) for r in pairs]), axis=1, count=len(chosen)).astype(np.int8)
    changed = unpack("bits") - unpack("other") if pairs else np.zeros((0, len(chosen)), dtype=np.int8)
    w, bias = fit(np.array([np.frombuffer(r["bits"], dtype=np.uint8) for r in rows]), np.array([r["toxic"] for r in rows], dtype=np.float32), changed, len(chosen), swap_weight)
    weights = np.zeros(BUCKETS, dtype=np.float32)
    weights[chosen] = w
    return weights, bias


def score(docs: DataFrame, model: tuple[np.ndarray, float] | None) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from 0.5 on); columns of these names are replaced."""
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    if model is None:
        return docs.select(*[F.col(f"`{c}`") for c in keep], F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep) + ", score double, predicted int"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, (weights, bias) = Features(), shared.value
        for batch in batches(it):
            z = np.array([bias + float(weights[features.of(t)].sum()) for t in batch.column("text").to_pylist()])
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.record_batch({c: batch.column(c) for c in keep} | {"score": pa.array(p, pa.float64()), "predicted": pa.array((p >= 0.5).astype(np.int32), pa.int32())})

    return docs.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = fold(F.col("doc_id"), 5) == 0
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~out).select("doc_id", "toxic")
    return score(docs, learn(docs, labels)).select("doc_id", out.alias("held_out"), "score", "predicted")
