"""Whitening, ranked search and packing against brute force, and their odd inputs."""

import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sessionmill.llm import packing, ranked, whitening

SF = "/root/testdata/sf0.001"


# --- whitening -----------------------------------------------------------------------------------------------------------------
def brute_whiten(vectors: np.ndarray, k: int):
    """Eigenvectors of the covariance by numpy's own solver, whitened rows, shares."""
    x = np.floor(64 * vectors.astype(np.float64)) + 1_000_000
    c = x - x.mean(0)
    v = c.T @ c / len(x)
    value, vector = np.linalg.eigh(v)
    value, vector = value[::-1][:k], vector[:, ::-1][:, :k]
    stay = value > np.trace(v) * len(v) * np.finfo(float).eps
    return x, c @ vector[:, stay] / np.sqrt(value[stay]), value[stay] / np.trace(v)


def same_whitened(rows, vectors, ids, k):
    x, want, share = brute_whiten(vectors, k)
    n, m = want.shape
    found = sorted(rows, key=lambda r: (ids.index(r["vec_id"]), r["component"]))
    assert [(r["vec_id"], r["component"]) for r in found] == [(i, c) for i in ids for c in range(1, m + 1)]
    got = np.array([r["whitened"] for r in found]).reshape(n, m)
    assert np.abs(got * np.sign((got * want).sum(0)) - want).max() < 1e-6
    assert np.allclose([r["explained"] for r in found[:m]], share, rtol=1e-9)
    whole = [[int(e) for e in row] for row in x]
    sums = [sum(c) for c in zip(*whole, strict=True)]
    exact = [sum((n * e - s) ** 2 for e, s in zip(row, sums, strict=True)) for row in whole]
    assert [r["deviation"] for r in found[::m]] == exact
    assert {r["n"] for r in found} == {n} and max(r["identity_error"] for r in found) < 1e-9


def test_whitening_query_is_brute_force(spark):
    rows = whitening.op11_whitening(spark, SF).collect()
    data = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    same_whitened(rows, np.array([r["embedding"] for r in data]), [r["vec_id"] for r in data], 32)


def test_whitening_odd_rows(spark):
    random = np.random.default_rng(3)
    good = random.standard_normal((40, 6))
    rows = [(i, v.tolist()) for i, v in enumerate(good)] + [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (102, [float("nan")] * 6), (103, [float("inf")] * 6), (104, []), (105, [1e300] * 6)]
    frame = spark.createDataFrame([(a, b, "x") for a, b in rows], "vec_id long, embedding array<double>, component string")
    same_whitened(whitening.whiten(frame, 4).collect(), good, list(range(40)), 4)
    assert whitening.whiten(frame.where("vec_id >= 100")).collect() == []
    # one row, equal rows: no variance, so no component; a constant dimension has none
    assert whitening.whiten(frame.where("vec_id = 3")).collect() == []
    twice = spark.createDataFrame([(None, [0.0, float(i % 5), 1.0]) for i in range(10)], "vec_id long, embedding array<double>")
    assert [r["component"] for r in whitening.whiten(twice).collect()] == [1] * 10
    # two lengths are two fit lists
    two = frame.where("vec_id < 40").select("vec_id", "embedding").union(spark.createDataFrame([(200 + i, [float(i)]) for i in range(5)], "vec_id long, embedding array<double>"))
    made = whitening.whiten(two, 4).collect()
    assert {r["n"] for r in made if r["vec_id"] >= 200} == {5} and {r["n"] for r in made if r["vec_id"] < 200} == {40}


@pytest.mark.parametrize("values", [[3.0, 2.0, 1.0], [1.0] * 9 + [0.5] * 12 + [0.0] * 4, [10.0**-i for i in range(12)], [1 + 1e-9 * i for i in range(20)]])
def test_inertia_and_contours_find_every_eigenvalue(values):
    d = len(values)
    q = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))[0]
    v = q @ np.diag(values) @ q.T
    v = (v + v.T) / 2
    cut = whitening.intervals(v, d)
    assert sum(c for *_, c in cut) == d
    for low, high, count in cut:
        assert count == whitening.below(v, high) - whitening.below(v, low)
    found = np.sort(np.concatenate([whitening.feast(v, *c)[0] for c in cut]))
    assert np.abs(found - np.sort(values)).max() < 1e-13 * max(values) * d


def test_products_are_exact():
    z = np.random.default_rng(1).integers(-(1 << 25), 1 << 25, (300, 3))
    exact = [[sum(int(a) * int(b) for a, b in zip(z[:, i], z[:, j], strict=True)) for j in range(3)] for i in range(3)]
    assert whitening.products(z).tolist() == exact
    assert whitening.deviation(z * 40, 10**9, [0, 0, 0], np.zeros(3, dtype=np.int64))[0] is None


# --- ranked search -------------------------------------------------------------------------------------------------------------
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_rank(docs, items, k=50):
    counts = [(i, Counter(brute_terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counts:
            m = 50 + 50 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 20 * m)) for w in set(brute_terms(text)) if w in c)
            if s > 0:
                scores.append((-s, i is None, i, s))
        for rank, (*_, i, s) in enumerate(sorted(scores, key=lambda x: x[:2] + (x[2] or 0,))[:k], 1):
            out.append((item, rank, i, s))
    return out


def test_ranked_query_is_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert sorted(map(tuple, ranked.op12_ranked_search(spark, SF).collect())) == sorted(con.execute(ranked.ORACLE_SQL).fetchall())


def test_ranked_with_small_shards_skips_and_loses_nothing(spark, monkeypatch):
    """Many shards, blocks and long lists; the same result whatever is summed first."""
    random = np.random.default_rng(5)
    word = lambda: f"w{int(random.zipf(1.3)) % 400}"
    docs = [(i % 280, " ".join(word() for _ in range(int(random.integers(0, 60))))) for i in range(1200)]
    items = [(i, " ".join(word() for _ in range(8))) for i in range(12)]
    want = sorted(brute_rank(docs, items, 7), key=str)
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for shard, short, wide, step in ((500, 0, 4, 2), (2000, 60, 16, 3), (1 << 21, 1 << 20, 128, 64)):
        for name, value in (("SHARD", shard), ("SHORT", short), ("WIDE", wide), ("STEP", step)):
            monkeypatch.setattr(ranked, name, value)
        assert sorted(map(tuple, ranked.search(d, q, 7).collect()), key=str) == want


def test_shard_skips_blocks(monkeypatch):
    """Of blocks whose bound is below the k-th score no posting is read."""
    monkeypatch.setattr(ranked, "SHORT", 0)
    n = ranked.WIDE * ranked.STEP * 4
    term = np.concatenate([np.zeros(n, dtype=np.int64), np.ones(2, dtype=np.int64)])
    at = np.concatenate([np.arange(n), [5, 6]])
    score = np.concatenate([np.ones(n, dtype=np.int64), [100, 90]])
    shard = ranked.Shard(np.arange(n), term, at, score, 2)
    asked, seen = np.array([0, 1]), []
    listed = shard.list
    monkeypatch.setattr(ranked, "top", lambda s, i, k, f=ranked.top: seen.append(len(s)) or f(s, i, k))
    none = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
    found = shard.search(asked, none, 2)
    assert found[0].tolist() == [101, 91] and found[1].tolist() == [5, 6] and listed(1)[0].tolist() == [5, 6]
    assert len(seen) == 1 and seen[0] < n  # one group of blocks of four


def test_ranked_odd_rows(spark):
    docs = [(3, "Alpha beta"), (1, "alpha BETA"), (None, "alpha beta"), (2, None), (4, ""), (5, "... !"), (3, "Alpha beta"), (6, "ñandú Ñandú 漢字 x" * 40), (7, "gamma " * 5000)]
    items = [(1, "alpha beta alpha"), (None, "Gamma"), (1, "ñandú"), (2, None), (3, ""), (4, "..."), (5, "nowhere")]
    d = spark.createDataFrame([(*x, 9) for x in docs], "doc_id long, text string, score int")
    q = spark.createDataFrame([(*x, 9) for x in items], "item_id long, text string, rank int")
    want = sorted(brute_rank(docs, items), key=str)
    assert sorted(map(tuple, ranked.search(d, q).collect()), key=str) == want and want
    assert ranked.search(d.limit(0), q).collect() == [] and ranked.search(d, q.limit(0)).collect() == []
    assert [c for c, _ in ranked.search(d, q.limit(0)).dtypes] == ["item_id", "rank", "doc_id", "score"]


def test_ranked_in_groups_of_items(spark, monkeypatch):
    monkeypatch.setattr(ranked, "TERMS", 3)
    docs = [(i, f"a{i % 3} b{i % 5} c") for i in range(30)]
    items = [(i, f"a{i % 3} b{i} zz c") for i in range(6)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, ranked.search(d, q, 4).collect())) == sorted(brute_rank(docs, items, 4))


# --- packing -------------------------------------------------------------------------------------------------------------------
PLAIN = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def held_together(rows, docs, size=1024):
    """Pieces give each document's ids back; sequences are gapless, within the size, and none needs padding. Documents of one id are
    told apart by none, so ids must be distinct here."""
    texts, parts, sequences = dict(docs), defaultdict(list), defaultdict(list)
    for r in rows:
        parts[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert parts.keys() == texts.keys()
    for i, found in parts.items():
        found.sort(key=lambda r: r["start"])
        ids = b"".join(bytes(r["ids"]) for r in found)
        want = [*PLAIN.encode(texts[i] or "", add_special_tokens=False).ids, 0]
        assert np.frombuffer(ids, dtype="<u4").tolist() == want
        at = 0
        for r in found:
            assert r["start"] == at and len(r["ids"]) == 4 * r["length"] and r["length"] > 0 and r["doc_tokens"] == len(want)
            at += r["length"]
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size and at & (at - 1) == 0  # 1024 itself is a power of two


def test_packing_query_gives_all_ids_back(spark):
    import zlib

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    pieces = packing.pack(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    held_together(pieces, docs)
    key = lambda r: (r["doc_id"], r["start"])
    made = sorted(packing.op13_packing(spark, SF).collect(), key=key)
    assert [(r["doc_id"], r["ids_crc32"], r["sequence_id"], r["offset"]) for r in made] == [(r["doc_id"], zlib.crc32(bytes(r["ids"])), r["sequence_id"], r["offset"]) for r in sorted(pieces, key=key)]


def test_packing_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "a" * 30_000), (4, " " * 9_000 + "x"), (5, "<|endoftext|> b"), (6, "漢字 ́ \x85 \x1c"), (7, "word " * 40_000), (None, "n")]
    frame = spark.createDataFrame([(*d, "s", 1) for d in docs], "doc_id long, text string, sequence_id string, start int")
    held_together(packing.pack(frame).collect(), docs)
    held_together(packing.pack(frame, block=1).collect(), docs)
    assert packing.pack(frame.limit(0)).collect() == []
    again = packing.pack(frame.union(frame)).agg({"length": "sum"}).first()[0]
    assert again == 2 * packing.pack(frame).agg({"length": "sum"}).first()[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 90), max_size=60), st.sampled_from([8, 16, 32]))
def test_assignment_fills_sequences(lengths, size):
    rows = packing.assign(np.array(lengths, dtype=np.int64), size)
    fill = np.bincount(rows[:, 3], rows[:, 2]).astype(int) if len(rows) else np.zeros(0, dtype=int)
    assert all(f <= size and f & (f - 1) == 0 and f > 0 for f in fill)
    for d, n in enumerate(lengths):
        own = rows[rows[:, 0] == d]
        own = own[np.argsort(own[:, 1])]
        assert own[0, 1] == 0 and (own[:-1, 1] + own[:-1, 2] == own[1:, 1]).all() and own[-1, 1] + own[-1, 2] == n


def test_assignment_balances_cost():
    """Sequences differ less in cost than those of first-fit packing by falling length."""
    lengths = np.random.default_rng(2).integers(1, 400, 3000)
    rows = packing.assign(lengths)
    cost = np.bincount(rows[:, 3], rows[:, 2] + rows[:, 2] ** 2 / 1024)
    cost = cost[np.bincount(rows[:, 3], rows[:, 2]) == 1024]
    bins: list[list[int]] = []
    for n in sorted(lengths.tolist(), reverse=True):
        home = next((b for b in bins if sum(b) + n <= 1024), None)
        bins.append([n]) if home is None else home.append(n)
    first_fit = np.array([sum(b) + sum(x * x for x in b) / 1024 for b in bins])
    assert cost.std() < 0.8 * first_fit.std()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" \t\n\x85\x1c  aBé1٣s'!?漢😀́_ßÿ×—№ª²<|>")), max_size=20))
def test_fast_ids_are_the_tokenizers(text):
    assert ENCODER.ids(text) == PLAIN.encode(text, add_special_tokens=False).ids


ENCODER = packing.Encoder()
