"""Language ID by string kernels: Nyström landmarks and one-versus-rest kernel ridge regression.

The kernel is the blended spectrum presence kernel: the number of character
n-grams (lengths 1 to ``ORDER``) that two texts share, over the root of the
product of how many each has. ``fit`` draws a bounded number of training texts a
language, takes some of them as landmarks L, maps every training text to its
kernel values with L times K_LL^(-1/2) (Nyström), and solves one ridge
regression a language. Since the score of a text is K(x, L) A with
A = K_LL^(-1/2) W, and K(x, L) is the product of the text's presence row with the
landmarks' presence matrix, the products are associated once: executors multiply
presence rows by (features x languages) weights, a batch of texts at a time.

N-grams are hashed to ``BUCKETS`` features. Landmarks are held as lists, the normal equations are summed by blocks of texts, and
there are ``LANDMARKS`` at most, so the driver holds a few numbers a training text and BUCKETS numbers (0.5 MB) a language: that,
and its broadcast, bound the number of languages to some hundreds.
Letters are case-folded by Python's lower().

Defined results: a null text or one without a letter is ``und`` with score 0. With no training
rows every text is ``und``. Ties go to the first language by code point. Repeated rows each get
their row. Texts are used whole, in chunks of ``CHUNK`` characters that overlap by ORDER - 1, so
memory does not grow with a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionmill.llm.common import batches, fold, small_batches, table

ORDER, BUCKETS = 3, 1 << 17
#: At most about this many training texts and landmarks a language, drawn by a hash of text.
TRAIN_PER_LANG, LANDMARKS_PER_LANG = 300, 60
#: Landmarks of all languages together; many languages have fewer each.
LANDMARKS = 2_048
RIDGE = 1e-2
#: Up to so many languages' shares are broadcast; more are joined by shuffle.
BROADCAST_LANGS = 100_000
CHUNK = 1 << 18
_MULTIPLY = [np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)]


class Presence:
    """Distinct n-gram features of a text."""

    def __init__(self) -> None:
        self.last = np.zeros(BUCKETS, dtype=np.int32)
        self.stamp = 0

    def of(self, text: str) -> np.ndarray:
        found = []
        self.stamp += 1
        for start in range(0, max(1, len(text) - ORDER + 1), CHUNK):
            c = np.frombuffer(text[start : start + CHUNK + ORDER - 1].lower().encode("utf-32-le"), dtype=np.uint32)
            h = np.zeros(len(c), dtype=np.uint32)
            for n in range(ORDER):
                if n and len(c) <= n:
                    break
                h = (h[: len(c) - n] if n else h) * _MULTIPLY[0] + c[n:] * _MULTIPLY[1] + np.uint32(n)
                f = ((h ^ (h >> np.uint32(15))) * _MULTIPLY[2] >> np.uint32(15)).astype(np.int32)
                f = f[self.last[f] != self.stamp]
                self.last[f] = self.stamp
                found.append(f)
        # a feature may repeat inside one block; keep one of each
        f = np.concatenate(found) if found else np.zeros(0, dtype=np.int32)
        order = np.arange(len(f), dtype=np.int32)
        self.place = getattr(self, "place", np.zeros(BUCKETS, dtype=np.int32))
        self.place[f] = order
        return f[self.place[f] == order]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def fit(rows: list[tuple[str, np.ndarray]]) -> tuple[list[str], np.ndarray]:
    """Languages and the (BUCKETS x languages) weights from (lang, features) training rows."""
    langs = sorted({lang for lang, _ in rows})
    if not langs:
        return [], np.zeros((BUCKETS, 0), dtype=np.float32)
    each = max(1, min(LANDMARKS_PER_LANG, LANDMARKS // len(langs)))
    picked: list[np.ndarray] = []
    for lang in langs:
        picked += [f for x, f in rows if x == lang][:each]
    kernel = Kernel(picked)
    square = kernel.rows(picked)
    values, vectors = np.linalg.eigh((square + square.T) / 2)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] * values[keep] ** -0.5
    # normal equations by blocks of training texts, so that no matrix of all texts is held
    size = np.array([sum(1 for x, _ in rows if x == lang) for lang in langs], dtype=np.float64)
    gram = RIDGE / len(langs) * np.eye(root.shape[1] + 1)
    right = np.zeros((root.shape[1] + 1, len(langs)))
    for start in range(0, len(rows), 1_000):
        part = rows[start : start + 1_000]
        phi = np.hstack([kernel.rows([f for _, f in part]) @ root, np.ones((len(part), 1))])
        target = np.array([[lang == x for x in langs] for lang, _ in part], dtype=np.float64)
        weighed = phi * (1.0 / size[target.argmax(1)])[:, None]  # languages count alike
        gram += phi.T @ weighed
        right += weighed.T @ target
    solved = np.linalg.solve(gram, right)
    return langs, np.vstack([kernel.times(root @ solved[:-1]), solved[-1:].astype(np.float32)])


class Kernel:
    """Kernel values with landmarks, by lists of the landmarks that have a feature."""

    def __init__(self, landmarks: list[np.ndarray]):
        self.landmarks = landmarks
        self.norm = np.array([max(1, len(f)) for f in landmarks]) ** -0.5
        feature = np.concatenate(landmarks)
        order = np.argsort(feature, kind="stable")
        self.owner = np.repeat(np.arange(len(landmarks)), [len(f) for f in landmarks])[order]
        self.start = np.searchsorted(feature[order], np.arange(BUCKETS + 1))

    def rows(self, texts: list[np.ndarray]) -> np.ndarray:
        """(texts x landmarks) of n-grams in common, over the root of the product of how many each has."""
        out = np.zeros((len(texts), len(self.landmarks)))
        for i, f in enumerate(texts):
            n = self.start[f + 1] - self.start[f]
            places = np.repeat(self.start[f] - np.cumsum(n) + n, n) + np.arange(n.sum())
            out[i] = np.bincount(self.owner[places], minlength=len(self.landmarks)) * self.norm * max(1, len(f)) ** -0.5
        return out

    def times(self, dual: np.ndarray) -> np.ndarray:
        """Weights by feature: the landmarks' rows times dual."""
        out = np.zeros((BUCKETS, dual.shape[1]), dtype=np.float32)
        for f, n, d in zip(self.landmarks, self.norm, dual, strict=True):
            out[f] += (n * d).astype(np.float32)
        return out


def training(docs: DataFrame, per_lang: int = TRAIN_PER_LANG) -> DataFrame:
    """(lang, features binary) of about per_lang texts a language, whatever the table's size.

    Texts are drawn by a hash of the text below a threshold for each language, so copies share one draw and count once. The
    threshold follows from the number of distinct texts, which is what is drawn from.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counts = usable.select("lang", F.xxhash64("text").alias("hash")).distinct().groupBy("lang").count()
    share = table(counts.select("lang", (F.lit(float(per_lang)) / F.col("count")).alias("share")), "shares")
    share = F.broadcast(share) if share.count() <= BROADCAST_LANGS else share
    draw = (F.xxhash64("text").bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40))).alias("draw")
    drawn = usable.select("lang", "text", draw).join(share, "lang").where("draw < share").select("lang", "text")

    def features(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        presence = Presence()
        for batch in it:
            texts = batch.column("text").to_pylist()
            keep = [i for i, t in enumerate(texts) if has_letter(t)]
            yield pa.record_batch({"lang": batch.column("lang").take(pa.array(keep, pa.int64())), "features": pa.array([presence.of(texts[i]).astype(np.int32).tobytes() for i in keep], pa.binary())})

    return drawn.dropDuplicates().mapInArrow(features, "lang string, features binary")


def identify(docs: DataFrame, learn: DataFrame | None = None) -> DataFrame:
    """docs with lang_pred and score; learns from ``learn`` (text, lang), by default docs itself.

    Columns of docs stay; those named lang_pred or score are replaced.
    """
    small_batches(docs.sparkSession)
    rows = [(r["lang"], np.frombuffer(r["features"], dtype=np.int32)) for r in training(docs if learn is None else learn).collect()]
    rows.sort(key=lambda r: (r[0], r[1].tobytes()))
    langs, weights = fit(rows)
    shared = docs.sparkSession.sparkContext.broadcast((langs, weights))
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep) + ", lang_pred string, score double"

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, weights = shared.value
        presence, bias = Presence(), weights[-1] if langs else None
        for batch in batches(it):
            made = [presence.of(t) if langs and has_letter(t) else None for t in batch.column("text").to_pylist()]
            rows = [i for i, f in enumerate(made) if f is not None]
            found, best = [None] * len(made), np.zeros(len(made))
            if rows:
                size = np.array([len(made[i]) for i in rows])
                # presence rows times weights: a sparse product, summed by row
                got = np.add.reduceat(weights[np.concatenate([made[i] for i in rows])], np.concatenate([[0], np.cumsum(size)[:-1]]), axis=0) * size[:, None] ** -0.5 + bias
                top = got.argmax(1)
                for i, k, v in zip(rows, top, got.max(1), strict=True):
                    found[i], best[i] = langs[k], min(1.0, max(0.0, float(v)))
            columns = {c: batch.column(c) for c in keep}
            columns |= {"lang_pred": pa.array([x or "und" for x in found], pa.string()), "score": pa.array(best, pa.float64())}
            yield pa.record_batch(columns)

    return docs.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(score, schema)


def held_out(doc_id: Column) -> Column:
    return fold(doc_id, 4) == 2


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    learn = docs.where(~held_out(F.col("doc_id"))).select("text", "lang")
    return identify(docs.select("doc_id", "text"), learn).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
