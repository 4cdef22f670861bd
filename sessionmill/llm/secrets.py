"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds to them.

Three patterns find the plain kinds (assign, access, hex). The field tags every
token as secret begin (B), inside (I) or outside (O) from its shape, neighbouring
words and features of the text, and Viterbi decodes it. A token is a run of
bytes other than ASCII white space and ``SEPARATORS``.

The field learns from a bounded sample of texts, whose B and I tags are the values
that the patterns find. So that it finds what they miss, each value is also taught
in other guises: its characters drawn anew from other alphabets, and its cue (the
word and the sign before it) hidden from half of them. Its spans that overlap none
of the patterns' are added as kind ``field``; the patterns' spans always stay.

Features of a batch of texts are computed at once as numbers of a fixed table.
Tokens that no best path can tag are told by a bound: their own gain over O, and
the most that transitions and the next token can add, is below nought. That is
exact; Viterbi runs over the stretches between them.

Defined results: a null text counts as empty and has no spans. Repeated rows each
get their row. Without a pattern hit in the sample the field adds nothing. Texts
are read whole; offsets are code points, ends exclusive. Ties of Viterbi go to O,
then B.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionmill.llm.common import LOWER, batches, small_batches

ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs are maximal, so shorter ones need no match to be dropped
KINDS = ("assign", "access", "hex", "field")
SEPARATORS = "\"'`<>(){}[],;:=|&$#%*!?"
#: Texts that the field learns from at most (about), with and without a pattern's hit, drawn by a hash of the text; draws of each alphabet; tokens of a window.
TRAIN_HITS, TRAIN_PLAIN, GUISES, WINDOW, AROUND = 200, 1_500, 4, 16, 6
L2, EPOCHS, RATE, BATCH = 1e-3, 30, 0.1, 128
ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
#: Bytes of texts whose features are computed at once; a longer text is taken alone, tokens in pieces of TOKENS.
PIECE, TOKENS = 1 << 20, 1 << 18

Span = tuple[str, int, int]
_HINT = re.compile(rb"pass|pwd|secret|token|key|auth|cred|bearer|private")


def _flags(chars: bytes) -> np.ndarray:
    return np.isin(np.arange(256), np.frombuffer(chars, dtype=np.uint8)).astype(np.uint8)


_SEP = _flags(b" \t\n\x0b\x0c\r" + SEPARATORS.encode())
_DIGIT, _UPPER, _LOWER = _flags(b"0123456789"), _flags(bytes(range(65, 91))), _flags(bytes(range(97, 123)))
_HEX, _HEX_UPPER = _flags(b"0123456789abcdef"), _flags(b"0123456789ABCDEF")
_WIDE = (np.arange(256) >= 128).astype(np.uint8)
_CLASS = _DIGIT + 2 * _UPPER + 3 * _LOWER + 4 * _WIDE
_MARKS = b"@./-_+~"
_MARK = sum((_flags(bytes([c])) << i for i, c in enumerate(_MARKS)), np.zeros(256, dtype=np.uint8)).astype(np.uint8)
_ASSIGN, _QUOTE = _flags(b"=:"), _flags(b"\"'`")
WORDS = 1 << 12
#: Numbers that each feature can take.
SIZES = {"kind": 9, "kind_size": 144, "digits": 6, "changes": 44, **{f"mark_{chr(c)}": 2 for c in _MARKS}, "prefix": 2048, "left": 5, "right": 5, "hint": 20, "before": WORDS + 1, "before2": WORDS + 1, "after": WORDS + 1, "text_size": 13, "text_equals": 4, "text_upper": 2}
FIRST = np.concatenate([[0], np.cumsum(list(SIZES.values()))])


def patterns(text: str) -> list[Span]:
    """Spans of the three patterns, by start, then kind as listed."""
    found = []
    if "=" in text or ":" in text:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return in_order(found)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def tokens(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the tokens of a text's bytes start and end."""
    edge = np.diff(np.concatenate([[1], _SEP[data], [1]]).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def _word(lower: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bucket of a word by its size, first four and last four letters."""
    h = (ends - starts).astype(np.uint32)
    for i in range(4):
        for at in (starts + i, ends - 1 - i):
            h = h * np.uint32(0x9E3779B1) + np.where((at >= starts) & (at < ends), lower[np.clip(at, 0, len(lower) - 1)], 0).astype(np.uint32)
    return ((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77) >> np.uint32(20)).astype(np.int64)


def features(data: bytes, starts: np.ndarray, ends: np.ndarray, text: np.ndarray, about: np.ndarray) -> np.ndarray:
    """Feature numbers (tokens x features) of tokens that follow each other in data; text: the text of each; about: three features of each text."""
    if not len(starts):
        return np.zeros((0, len(SIZES)), dtype=np.int32)
    low, high = int(starts[0]), int(ends[-1])
    whole = np.frombuffer(data, dtype=np.uint8)
    b = whole[low:high]
    lower = np.frombuffer(data[low:high].translate(LOWER), dtype=np.uint8)
    starts, ends = starts - low, ends - low
    n = ends - starts
    count = lambda table: np.add.reduceat(table[b], starts, dtype=np.int32)  # noqa: E731  separators count for nothing
    digits, upper, small, wide = count(_DIGIT), count(_UPPER), count(_LOWER), count(_WIDE)
    kind = np.full(len(n), 7)
    for k, holds in ((6, digits + upper + small == n), (8, wide > 0), (5, upper + small == n), (4, upper == n), (3, small == n), (2, (count(_HEX_UPPER) == n) & (digits > 0)), (1, (count(_HEX) == n) & (digits > 0)), (0, digits == n)):
        kind[holds] = k
    size = np.minimum(15, n // 3)
    shape = _CLASS[b]
    turns = np.concatenate([[0], (shape[1:] != shape[:-1]).astype(np.uint8)])
    turns[starts] = 0
    turns[ends[:-1]] = 0
    changes = np.minimum(10, 10 * np.add.reduceat(turns, starts, dtype=np.int32) // n)
    marks = np.bitwise_or.reduceat(_MARK[b], starts)
    prefix = np.zeros(len(n), dtype=np.uint32)
    for i in range(4):
        prefix = prefix * np.uint32(0x9E3779B1) + np.where(i < n, b[np.minimum(starts + i, len(b) - 1)], 0).astype(np.uint32)
    prefix = ((prefix ^ (prefix >> np.uint32(15))) * np.uint32(0x85EBCA77) >> np.uint32(21)).astype(np.int64)
    first = np.concatenate([[True], text[1:] != text[:-1]])
    last = np.append(first[1:], True)
    gap = 2 * (count(_ASSIGN) > 0) + (count(_QUOTE) > 0)  # the signs behind each token
    left = np.where(first, 4, np.concatenate([[0], gap[:-1]]))
    hinted = np.zeros(len(n), dtype=np.int64)
    hinted[np.searchsorted(starts, [m.start() for m in _HINT.finditer(lower)], side="right") - 1] = 1
    word = _word(lower, starts, ends)
    back = lambda x, k, none, out: np.where(out, none, np.concatenate([np.full(min(k, len(x)), none), x[:-k]]))
    second = first | np.concatenate([[True], first[:-1]])
    made = [kind, kind * 16 + size, 6 * digits // np.maximum(1, n), changes * 4 + np.minimum(3, n // 12)]
    made[2] = np.minimum(5, made[2])
    made += [(marks >> i) & 1 for i in range(len(_MARKS))]
    made += [prefix, left, np.where(last, 4, gap), 5 * (back(hinted, 1, 0, first) + 2 * back(hinted, 2, 0, second)) + left]
    made += [back(word, 1, WORDS, first), back(word, 2, WORDS, second), np.where(last, WORDS, np.append(word[1:], WORDS))]
    made += [about[text, i] for i in range(3)]
    return (np.stack(made, 1) + FIRST[:-1]).astype(np.int32)


def about_texts(texts: list[bytes]) -> np.ndarray:
    """Features of whole texts: size, share of equals signs, whether it has upper-case letters only."""
    return np.array([[min(12, len(t).bit_length() // 2), min(3, 2000 * t.count(b"=") // max(1, len(t))), int(t.isupper())] for t in texts], dtype=np.int64).reshape(-1, 3)


def pieces(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Texts behind one another in pieces of about PIECE bytes: the first's place, and the texts."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > PIECE:
            yield at, texts[at:i]
            at, held = i, 0
        held += len(t)
    if at < len(texts):
        yield at, texts[at:]


def laid_out(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts as one, where each starts, and its tokens: start, end, text."""
    data = b"\n".join(texts)
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]]).astype(np.int64)
    starts, ends = tokens(np.frombuffer(data, dtype=np.uint8))
    return data, begins, starts, ends, np.searchsorted(begins, starts, side="right") - 1


def values(text: str) -> list[tuple[int, int, int]]:
    """Code point spans of the values that the patterns find, and where their cues start."""
    found = {(a, b): a for k, a, b in patterns(text) if k != "assign"}
    found |= {m.span(2): m.start() for m in ASSIGN.finditer(text) if len(m[2]) >= 8}
    return sorted((a, b, cue) for (a, b), cue in found.items())


def guises(text: str, draw: random.Random) -> list[tuple[str, tuple[int, int]]]:
    """The text around each value as it is, and in other guises: (text, span of the value)."""
    out = []
    for a, b, cue in values(text):
        after = text[b : b + 100]
        out.append((text[max(0, a - 150) : b] + after, (min(a, 150), min(a, 150) + b - a)))
        for alphabet in ALPHABETS * GUISES:
            value = "".join(draw.choices(alphabet, k=draw.randrange(16, 56)))
            bare = draw.random() < 0.5
            before = text[max(0, cue - 150) : cue] if bare else text[max(0, a - 150) : a]
            out.append((before + value + (after.lstrip("\"'") if bare else after), (len(before), len(before) + len(value))))
    return out


def windows(text: str) -> list[tuple[np.ndarray, list[int]]]:
    """Training windows of a text: feature numbers and tags. Around values and, without tags, around long tokens and those with digits."""
    draw, out = random.Random(text), []
    made = guises(text, draw)
    for seen, spans in [*[(t, [s]) for t, s in made], (text, [(a, b) for a, b, _ in values(text)])]:
        data = seen.encode("utf-8", "surrogatepass")
        place = lambda i, seen=seen: len(seen[:i].encode("utf-8", "surrogatepass"))
        joined_text, _, starts, ends, of = laid_out([data])
        x = features(joined_text, starts, ends, of, about_texts([data]))
        tags = np.zeros(len(starts), dtype=np.int64)
        for a, b in spans:
            inside = np.flatnonzero((starts < place(b)) & (ends > place(a)))
            tags[inside] = 2
            tags[inside[:1]] = 1
        if seen is not text:
            centres = np.flatnonzero(tags == 1).tolist()
        else:
            odd = np.flatnonzero((tags == 0) & ((np.add.reduceat(_DIGIT[np.frombuffer(data, dtype=np.uint8)], starts, dtype=np.int32) > 0) | (ends - starts > 14))) if len(starts) else []
            centres = sorted(draw.sample(list(odd), min(6, len(odd)))) + ([draw.randrange(len(starts))] if len(starts) else [])
        for c in centres:
            low = max(0, int(c) - AROUND)
            out.append((x[low : low + WINDOW], tags[low : low + WINDOW].tolist()))
    return out


def fit(data: list[tuple[np.ndarray, list[int]]]) -> tuple[np.ndarray, np.ndarray] | None:
    """Emissions of B and I over O by feature number, and the transition scores (previous x tag); None if no tag leaves O."""
    if not any(any(tags) for _, tags in data):
        return None
    width, longest = len(SIZES), max(len(t) for _, t in data)
    ids = np.full((len(data), longest, width), FIRST[-1], dtype=np.int32)
    all_tags, sizes = np.zeros((len(data), longest), dtype=np.int64), np.array([len(t) for _, t in data])
    for i, (x, y) in enumerate(data):
        ids[i, : len(y)], all_tags[i, : len(y)] = x, y
    w, trans = np.zeros((FIRST[-1] + 1, 3)), np.zeros((3, 3))
    banned = np.zeros((3, 3))
    banned[0, 2] = -1e4  # nothing is inside that has not begun
    moments = [np.zeros_like(x) for x in (w, w, trans, trans)]
    lse = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
    order, step = np.random.default_rng(11), 0
    for epoch in range(EPOCHS):
        for part in np.array_split(order.permutation(len(data)), max(1, len(data) // BATCH)):
            rows, n, x, size = np.arange(len(part)), len(part), ids[part], sizes[part]
            mask = np.arange(longest)[None] < size[:, None]
            gold = np.zeros((n, longest, 3))
            gold[rows[:, None], np.arange(longest)[None, :], all_tags[part]] = mask
            score, edge = w[x].sum(2), trans + banned
            ahead, back = np.zeros((n, longest, 3)), np.zeros((n, longest, 3))
            ahead[:, 0] = score[:, 0] + edge[0]
            for t in range(1, longest):
                ahead[:, t] = lse(ahead[:, t - 1, :, None] + edge[None], 1) + score[:, t]
            back[:, :] = edge[:, 0]
            for t in range(longest - 2, -1, -1):
                got = lse(edge[None] + (score[:, t + 1] + back[:, t + 1])[:, None, :], 2)
                back[:, t] = np.where((t + 1 < size)[:, None], got, edge[:, 0])
            total = lse(ahead[rows, size - 1] + edge[:, 0], 1)
            p = np.exp(ahead + back - total[:, None, None]) * mask[:, :, None]
            diff = (p - gold) / n
            flat = x.ravel()
            grad = np.stack([np.bincount(flat, np.repeat(diff[:, :, s].ravel(), width), minlength=len(w)) for s in range(3)], 1) + L2 * w / len(data)
            turn = np.zeros((3, 3))
            if longest > 1:
                pair = np.exp(ahead[:, :-1, :, None] + edge[None, None] + (score + back)[:, 1:, None, :] - total[:, None, None, None]) * mask[:, 1:, None, None]
                turn += pair.sum((0, 1)) - np.einsum("nts,ntu->su", gold[:, :-1], gold[:, 1:] * mask[:, 1:, None])
            turn[0] += (p[:, 0] - gold[:, 0]).sum(0)
            end = rows, size - 1
            turn[:, 0] += (p[end] - gold[end]).sum(0)
            turn = turn / n + L2 * trans
            step += 1
            for value, g, a, b in ((w, grad, 0, 1), (trans, turn, 2, 3)):
                moments[a] = 0.9 * moments[a] + 0.1 * g
                moments[b] = 0.99 * moments[b] + 0.01 * g * g
                value -= RATE * (moments[a] / (1 - 0.9**step)) / (np.sqrt(moments[b] / (1 - 0.99**step)) + 1e-8)
            w[-1] = 0
    return (w[:, 1:] - w[:, :1]).astype(np.float32), trans + banned


def may_leave(gain: np.ndarray, edge: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Tokens that a best path may tag B or I: for the others even the best tags around lose against O (and B for an I behind it).

    gain: of B and I over O (tokens x 2); last: whether a token is its text's last."""
    most = max(edge[p][s] + edge[s][n] - edge[p][0] - edge[0][1 if n == 2 else n] for p in range(3) for s in (1, 2) for n in range(3))
    behind = np.append(np.maximum(0, gain[1:, 1] - gain[1:, 0]), 0)
    return gain.max(1) + np.where(last, 0, behind) + most >= -1e-6


def viterbi(scores: list[list[float]], edge: list[list[float]]) -> list[int]:
    """Best tags of a run that stands between two O."""
    best, came = [edge[0][s] + scores[0][s] for s in range(3)], []
    for row in scores[1:]:
        link = [max(range(3), key=lambda r, s=s: best[r] + edge[r][s]) for s in range(3)]
        best = [best[link[s]] + edge[link[s]][s] + row[s] for s in range(3)]
        came.append(link)
    tags = [max(range(3), key=lambda s: best[s] + edge[s][0])]
    for link in reversed(came):
        tags.append(link[tags[-1]])
    return tags[::-1]


def tagged(texts: list[bytes], model) -> dict[int, list[tuple[int, int]]]:
    """Byte spans that the field finds in each text, by its place; texts without one are absent."""
    weights, edge = model
    found: dict[int, list[tuple[int, int]]] = {}
    for at, some in pieces(texts):
        data, begins, starts, ends, of = laid_out(some)
        about = about_texts(some)
        gain = np.zeros((len(starts), 2), dtype=np.float32)
        for low in range(0, len(starts), TOKENS):
            high, a, b = min(len(starts), low + TOKENS), max(0, low - 2), min(len(starts), low + TOKENS + 1)
            x = features(data, starts[a:b], ends[a:b], of[a:b], about)[low - a : high - a]
            for column in x.T:
                gain[low:high] += weights[column]
        last = np.append(of[1:] != of[:-1], True)[: len(of)]
        places = np.flatnonzero(may_leave(gain, edge, last)) if len(starts) else []
        run: list[int] = []
        for t in [*places, None]:
            if run and (t is None or t != run[-1] + 1 or of[t] != of[run[-1]]):
                span: list[int] | None = None
                for k, tag in zip(run, viterbi([[0.0, float(gain[k, 0]), float(gain[k, 1])] for k in run], edge), strict=True):
                    start, end = int(starts[k] - begins[of[k]]), int(ends[k] - begins[of[k]])
                    if tag == 1:
                        span = [start, end]
                        found.setdefault(at + int(of[k]), []).append(span)
                    elif tag == 2 and span:
                        span[1] = end
                    else:
                        span = None
                run = []
            if t is not None:
                run.append(int(t))
    return {i: [tuple(s) for s in spans] for i, spans in found.items()}


def scan(texts: list[str | None], model) -> list[tuple[list[Span], list[Span]]]:
    """The patterns' spans, and all spans, of each text."""
    base = [patterns(t) if t else [] for t in texts]
    if model is None:
        return [(b, b) for b in base]
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    extra: dict[int, list[Span]] = {}
    for i, spans in tagged(data, model).items():
        place = lambda k, i=i: len(data[i][:k].decode("utf-8", "surrogatepass"))
        extra[i] = [("field", a, b) for a, b in ((place(a), place(b)) for a, b in spans) if not any(a < e and s < b for _, s, e in base[i])]
    return [(b, in_order(b + extra.get(i, []))) for i, b in enumerate(base)]


#: What JVM-side selection of texts with a hit looks for; the patterns decide.
MAY_HIT = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[a-z0-9+/_.=-]{8}|AKIA[A-Z0-9]{12}|[0-9a-f]{32}"


def learn(docs: DataFrame, hits: int = TRAIN_HITS, plain: int = TRAIN_PLAIN):
    """The field, from about ``hits`` texts of docs that a pattern finds something in and ``plain`` others; copies are drawn
    together and count once."""
    small_batches(docs.sparkSession)
    seen = docs.where("text is not null").select("text", F.xxhash64("text").alias("hash"), F.col("text").rlike(MAY_HIT).alias("hit"))
    n = {r["hit"]: r["count"] for r in seen.select("hash", "hit").distinct().groupBy("hit").count().collect()}
    draw = F.xxhash64("text", F.lit("secrets")).bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40))
    share = F.when(F.col("hit"), hits / max(1, n.get(True, 0))).otherwise(plain / max(1, n.get(False, 0)))
    drawn = seen.where(draw < share).select("text").distinct()

    def made(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 100):
            out = [s for t in batch.column("text").to_pylist() for s in windows(t)]
            yield pa.record_batch({"tags": pa.array([y for _, y in out], pa.list_(pa.int32())), "x": pa.array([x.tobytes() for x, _ in out], pa.binary())})

    found = drawn.mapInArrow(made, "tags array<int>, x binary").collect()
    found.sort(key=lambda r: (bytes(r["x"]), r["tags"]))
    return fit([(np.frombuffer(r["x"], dtype=np.int32).reshape(-1, len(SIZES)), list(r["tags"])) for r in found])


def find(docs: DataFrame, model) -> DataFrame:
    """docs with base and spans: arrays of (kind, start, end); columns of these names are replaced."""
    keep = [c for c in docs.columns if c not in ("base", "spans")]
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = "array<struct<kind: string, start: int, end: int>>"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep) + f", base {kind}, spans {kind}"
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            found = scan(batch.column("text").to_pylist(), shared.value)
            as_rows = lambda k: pa.array([[{"kind": s[0], "start": s[1], "end": s[2]} for s in f[k]] for f in found], arrow)
            yield pa.record_batch({c: batch.column(c) for c in keep} | {"base": as_rows(0), "spans": as_rows(1)})

    return docs.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)


def redact(docs: DataFrame, model, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span replaced by ``mark`` (overlapping spans by one); a null text stays null. n_chars, if there, follows."""
    small_batches(docs.sparkSession)
    keep, shared = docs.columns, docs.sparkSession.sparkContext.broadcast(model)

    def cover(text: str | None, spans: list[Span]) -> str | None:
        out, at = [], 0
        for _, a, b in spans:
            if a >= at:
                out += [text[at:a], mark]
            at = max(at, b)
        return text if not out else "".join(out) + text[at:]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            given = batch.column("text").to_pylist()
            texts = [cover(t, spans) for t, (_, spans) in zip(given, scan(given, shared.value), strict=True)]
            new = {"text": pa.array(texts, pa.string())}
            if "n_chars" in keep:
                new["n_chars"] = pa.array([len(t) if t != o else n for t, o, n in zip(texts, given, batch.column("n_chars").to_pylist(), strict=True)], batch.column("n_chars").type)
            yield pa.record_batch({c: new.get(c, batch.column(c)) for c in keep})

    return docs.mapInArrow(run, docs.schema)


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Counts and spans of secrets in every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find(docs, learn(docs))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(text("base").cast("binary"), 256).alias("base_sha256"), text("spans").alias("spans"))


def digest(base: list[Span]) -> str:
    """What op10 returns as base_sha256."""
    return hashlib.sha256(joined(base).encode()).hexdigest()
