"""The corpus operators against brute force, and their edge cases."""

import collections
import html
import itertools
import math
import pathlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionmill.llm import decontaminate, html_text, jaccard, language, lm_score, mixing, secrets, toxicity, url_rules, vectors
from sessionmill.llm.common import components, shared_dir

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def corpus(n=120, seed=1):
    """Documents with copies, near-copies, empty, null and long texts, repeated rows."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(400)]
    rows = []
    for i in range(n):
        text = " ".join(rng.choices(vocabulary, k=rng.randrange(1, 90)))
        if i % 5 == 4:
            w = rows[rng.randrange(len(rows))][1].split() or ["x"]
            if i % 10 == 9 and len(w) > 3:
                w[rng.randrange(len(w))] = "edit"
            text = " ".join(w)
        rows.append((i, text, rng.choice(["en", "de"]), f"s{i % 4}", len(text)))
    rows += [(n, "", "en", None, 0), (n + 1, None, None, "s1", None), (n + 2, "ONE two", "de", "s2", 7), (n + 3, "one TWO", "de", "s2", 7), (n + 4, " \t\n", "de", "s9", 3), (n + 5, " ".join(vocabulary * 20), "en", "s3", 9)]
    rows += [rows[3], rows[3]]
    return rows


# --- op4 -----------------------------------------------------------------------------------------------------------------------
def brute_components(rows, k, similar):
    sets = {}
    for i, text, *_ in rows:
        w = words(text)
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= similar * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("k,similar,hot,block", [(4, 85, 64, 256), (5, 80, 1, 3)])
def test_jaccard_equals_brute_force(spark, monkeypatch, k, similar, hot, block):
    monkeypatch.setattr(jaccard, "HOT", hot)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = corpus()
    want = brute_components(rows, k, similar)
    got = jaccard.join(spark.createDataFrame(rows, DOCS).withColumn("n", F.lit("clash")), k, similar).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_jaccard_empty_and_keep_one(spark):
    assert jaccard.join(spark.createDataFrame([], DOCS)).count() == 0
    rows = corpus(60)
    kept = [r["doc_id"] for r in jaccard.keep_one(spark.createDataFrame(rows, DOCS), 5, 80).collect()]
    want = brute_components(rows, 5, 80)
    assert sorted(kept) == sorted(i for i, (_, c) in want.items() if i == c)


def test_keep_one_with_null_and_repeated_ids(spark):
    rng = random.Random(22)
    text = lambda: " ".join(f"t{rng.randrange(10**6)}" for _ in range(30))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(None, a), (None, a), (None, a + " more"), (None, b), (None, None), (None, " "), (1, c), (1, d), (2, d + " more"), (3, b + " more"), (4, ""), (5, e), (5, e), (5, e + " more")]
    kept = [(r["doc_id"], r["text"]) for r in jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()]
    assert len([x for x in kept if x[0] is None and x[1] in (a, a + " more")]) == 1  # one of a component without ids
    assert len([x for x in kept if x[0] == 5]) == 1
    rest = [x for x in kept if x[0] != 5 and x[1] not in (a, a + " more")]
    assert sorted(rest, key=str) == sorted([(None, None), (None, " "), (1, c), (1, d), (3, b + " more"), (4, "")], key=str)


def test_components(spark, monkeypatch):
    import sessionmill.llm.common as common

    rng = random.Random(18)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(140)] + [(5, i) for i in range(300, 360)]
    label = list(range(360))
    for _ in range(360):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    for hub in (64, 2):
        monkeypatch.setattr(common, "HUB", hub)
        got = components(spark.createDataFrame([(i,) for i in range(360)], "node long"), spark.createDataFrame(pairs, "a long, b long"))
        assert {r["node"]: r["component"] for r in got.collect()} == dict(enumerate(label))
    edges = [(i, i + 1) for i in range(40)] + [(100, 99), (99, 98), (7, 7)]
    got = components(spark.createDataFrame([(i,) for i in [*range(42), 98, 99, 100]], "node long"), spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["component"] for r in got.collect()} == {**{i: 0 for i in range(41)}, 41: 41, 98: 98, 99: 98, 100: 98}


# --- op8 -----------------------------------------------------------------------------------------------------------------------
def trigram_scores(tokens, training):
    """log10 probability of each token list by the formula, learned from those at the places ``training``."""
    count, pairs, triples, after_one, after_two = (collections.Counter() for _ in range(5))
    grams = [list(zip([None, None, *t[:-2]] if len(t) > 1 else [None], [None, *t[:-1]], t, strict=True)) for t in tokens]
    for i in training:
        for a, b, c in grams[i]:
            count[c] += 1
            pairs[b, c] += 1
            triples[a, b, c] += 1
            after_one[b] += 1
            after_two[a, b] += 1
    base = sum(count.values()) + len(count) + 1
    k, m = lm_score.KAPPA, lm_score.MU
    return [sum(math.log10((triples[a, b, c] + k * pairs[b, c] + m * (count[c] + 1) / base) / (after_two[a, b] + k * after_one[b] + m)) for a, b, c in g) for g in grams]


def test_lm_score(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    found = lm_score.score(docs, F.col("doc_id") % 7 != 2).collect()
    tokens = [(i, words(t) + [""]) for i, t, *_ in rows]
    count = collections.Counter(w for i, t in tokens if i % 7 != 2 for w in t)
    total, distinct = sum(count.values()), len(count)
    want = sorted((i, i % 7 != 2, len(t), sum(count[w] > 0 for w in t), total) for i, t in tokens)
    assert sorted((r["doc_id"], r["train"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in found) == want
    base = {i: sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in t) for i, t in tokens}
    assert all(abs(base[r["doc_id"]] - r["base_score"]) < 1e-9 * max(1, abs(r["base_score"])) for r in found)
    # the model itself, by the formula; unigrams all lie in the head here
    whole = dict(zip([i for i, _ in tokens], trigram_scores([t for _, t in tokens], [x for x, (i, _) in enumerate(tokens) if i % 7 != 2]), strict=True))
    for r in found:
        assert abs(whole[r["doc_id"]] - r["score"]) < 1e-3 * r["n_tokens"]
    # many small batches and no head give the same counts
    monkeypatch.setattr(lm_score, "FLUSH", 300)
    monkeypatch.setattr(lm_score, "HEAD", 1)
    again = lm_score.score(docs, F.col("doc_id") % 7 != 2).collect()
    pick = lambda rs: sorted((r["doc_id"], r["n_known"], round(r["base_score"], 6)) for r in rs)
    assert pick(again) == pick(found)


def test_lm_scores_do_not_depend_on_batches(spark, monkeypatch):
    docs = spark.createDataFrame(corpus(150), DOCS)
    made = {}
    for flush, texts, shards in ((50, 60_000, 4), (1_500_000, 60_000, 4), (1_500_000, 7, 4)):
        monkeypatch.setattr(lm_score, "FLUSH", flush)
        monkeypatch.setattr(lm_score, "EACH_SHARD", 1)
        monkeypatch.setattr(lm_score, "MOST_TEXTS", texts)
        monkeypatch.setattr(lm_score, "LEAST_SHARDS", shards)
        made[flush, texts] = sorted(((r["doc_id"], r["score"]) for r in lm_score.score(docs, F.col("doc_id") % 7 != 2).collect()), key=str)
    first, *others = made.values()
    assert all(o == first for o in others) and len(first) == docs.count()


def test_lm_words_beyond_the_head(spark, monkeypatch):
    """Rare words keep their own unigram share, however many words there are."""
    monkeypatch.setattr(lm_score, "HEAD", 3)
    rng = random.Random(21)
    often = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(often, k=40) + [f"five{i % 8}", f"once{i}"])) for i in range(40)]
    rows += [(100, "five3 five4 five5"), (101, "once3 once4 once5"), (102, "never3 never4 never5")]
    found = {r["doc_id"]: r["score"] for r in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") < 100).collect()}
    want = trigram_scores([[*t.split(), ""] for _, t in rows], range(40))
    assert all(abs(found[i] - w) < 1e-3 * (len(t.split()) + 1) for (i, t), w in zip(rows, want, strict=True))
    assert found[100] > found[101] + 1 > found[102] + 1


def test_lm_frequent_pairs(spark, monkeypatch):
    """Pairs of words that many documents share are dealt by the word before them and keep their counts."""
    seen, plain = [], lm_score.hot_pairs
    monkeypatch.setattr(lm_score, "hot_pairs", lambda *a: seen.append(plain(*a)) or seen[-1])
    rng = random.Random(5)
    rows = [(i, " ".join(["all", "rights", "reserved", *rng.choices("abcdefgh", k=9), "see", "the", "licence"][: 15 if i % 9 else 2])) for i in range(60)]
    found = {r["doc_id"]: r["score"] for r in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") < 50).collect()}
    assert len(seen[0].hashes) > 4
    want = trigram_scores([[*t.split(), ""] for _, t in rows], range(50))
    assert all(abs(found[i] - w) < 1e-3 * (len(t.split()) + 1) for (i, t), w in zip(rows, want, strict=True))


def test_lm_without_training(spark):
    rows = [(1, "a b"), (2, None)]
    got = lm_score.score(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(False)).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got) == [(1, 3, 0, 0), (2, 1, 0, 0)]
    assert lm_score.score(spark.createDataFrame([], "doc_id long, text string"), F.lit(True)).count() == 0


def test_elias_fano_and_trie():
    from sessionmill.llm.elias_fano import EliasFano, Trie

    rng = np.random.default_rng(0)
    for n, universe in ((0, 10), (1, 1), (500, 5000), (2000, 1 << 64), (700, 700)):
        values = np.sort(rng.integers(0, min(universe, 1 << 63), n, dtype=np.uint64))
        packed = EliasFano(values, universe)
        places = np.arange(n)
        assert (packed[places] == values).all()
        if n:
            asked = np.concatenate([values, rng.integers(0, min(universe, 1 << 63), 300, dtype=np.uint64)])
            zero = np.zeros(len(asked), dtype=np.int64)
            assert (packed.successor(asked, zero, zero + n) == np.searchsorted(values, asked)).all()
    trie = Trie(np.array([3, 9], dtype=np.uint64), np.array([0, 2, 3]), np.array([5, 8, 5], dtype=np.uint32), np.array([-1.0, -2.0, -3.0]))
    got = trie.score(trie.find(np.array([3, 3, 9, 9, 4], dtype=np.uint64)), np.array([5, 8, 5, 8, 5], dtype=np.uint32))
    assert np.allclose(got[:3], [-1, -2, -3]) and np.isnan(got[3:]).all()
    # a third level: the longest n-gram held decides
    third = (np.array([0, 1, 1, 3]), np.array([7, 2, 7], dtype=np.uint32), np.array([-0.1, -0.2, -0.3]))
    trie = Trie(np.array([3, 9], dtype=np.uint64), np.array([0, 2, 3]), np.array([5, 8, 5], dtype=np.uint32), np.array([-1.0, -2.0, -3.0]), deeper=(third,))
    asked = np.array([[3, 5, 7], [3, 5, 2], [3, 8, 7], [9, 5, 2], [9, 5, 7], [9, 8, 7], [4, 5, 7]])
    got = trie.score(trie.find(asked[:, 0].astype(np.uint64)), asked[:, 1].astype(np.uint32), asked[:, 2].astype(np.uint32))
    assert np.allclose(got[:5], [-0.1, -1, -2, -0.2, -0.3]) and np.isnan(got[5:]).all()


# --- op6 -----------------------------------------------------------------------------------------------------------------------
def test_mix(spark):
    rows = corpus(200)
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(docs).collect()
    sizes = collections.Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(words(t))
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= 2 * sizes[s]}
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    taken = collections.Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[r["source"]] += r["taken"]
    short = [s for s in names if s != "s3" and sizes[s] >= 100]  # s3 is mostly one long document
    assert all(abs(taken[s] - target[s]) <= 1 for s in short), {s: (taken[s], target[s], sizes[s]) for s in names}
    assert len(got) == len(rows)
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: (r["doc_id"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0


def test_knapsack_equals_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        lengths = np.array(sorted(rng.sample(range(1, 30), 4)))
        counts = np.array([rng.randrange(0, 4) for _ in lengths])
        budget = rng.randrange(0, 80)
        best = max(s for c in itertools.product(*[range(x + 1) for x in counts]) if (s := int(np.dot(c, lengths))) <= budget)
        take = mixing.knapsack(lengths, counts, budget)
        assert (take <= counts).all() and int(np.dot(take, lengths)) == best


def test_fit_gives_all_lengths_their_share(monkeypatch):
    """What is over the knapsack's reach doesn't go to the longest documents alone, and the budget is met."""
    monkeypatch.setattr(mixing, "REACH", 2_000)
    lengths, counts = np.arange(1, 801), np.full(800, 3)
    for share in (0.1, 0.5, 0.6, 0.9, 1.0):
        budget = round(share * int((lengths * counts).sum()))
        take = mixing.fit_counts(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all() and int(take @ lengths) == budget
        for part in (slice(0, 400), slice(400, 600), slice(600, 800)):
            assert abs((take @ np.where(np.isin(np.arange(800), np.arange(800)[part]), lengths, 0)) / (lengths[part] @ counts[part]) - share) < 0.03


# --- op7 -----------------------------------------------------------------------------------------------------------------------
def test_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PER_LIST", 40)
    monkeypatch.setattr(vectors, "ROWS", 30)
    monkeypatch.setattr(vectors, "QUERIES", 25)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8))
    x[200:260] = x[:60] + 0.15 * rng.normal(size=(60, 8))
    x[260:300] = x[5]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(300, None), (301, [0.0] * 8), (302, [float("nan")] + [1.0] * 7), (303, [1.0, 2.0]), (304, [None] + [1.0] * 7), (305, [2.0, 4.0]), (306, [])]
    y = x / np.linalg.norm(x, axis=1)[:, None]
    linked = y @ y.T >= 0.95
    np.fill_diagonal(linked, False)
    label = np.arange(300)
    for _ in range(300):
        label = np.minimum(label, np.where(linked, label[None], 10**9).min(1))
    want = {i: (int(linked[i].sum()), int(label[i])) for i in range(300)} | {i: (0, i) for i in (300, 301, 302, 304, 306)} | {303: (1, 303), 305: (1, 303)}
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(1))).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# --- op2 -----------------------------------------------------------------------------------------------------------------------
def _items(rng, vocabulary, n=30):
    return [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(9, 120)))) for i in range(n)]


def test_wand_equals_brute_force():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(150)]
    items = [(i, t.encode().split()) for i, t in _items(rng, vocabulary)]
    index = decontaminate.Index(items)
    for _ in range(200):
        passage = rng.choices([v.encode() for v in vocabulary], k=rng.randrange(1, 60)) + rng.choice(items)[1][: rng.randrange(0, 50)]
        for least in (0.1, 0.5):
            want = [(k, s) for k in range(len(index.owner)) if (s := sum(p.impacts[p.docs.index(k)] for t in set(passage) if (p := index.postings.get(t)) and k in p.docs)) >= least]
            got = index.query(passage, least)
            assert [k for k, _ in got] == [k for k, _ in want] and np.allclose([s for _, s in got], [s for _, s in want])
    # no window that a query would answer is left out by the bound
    for _ in range(40):
        text = rng.choices([v.encode() for v in vocabulary], k=300)
        at = rng.randrange(300)
        text[at:at] = rng.choice(items)[1]
        kept = set(index.windows(text).tolist())
        for w in range(-(-len(text) // decontaminate.CHUNK)):
            if index.query(text[w * decontaminate.CHUNK : (w + 2) * decontaminate.CHUNK]):
                assert w in kept or w - 1 in kept or w + 1 in kept
                assert w in kept


def test_leaks(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = _items(rng, vocabulary)
    rows, planted = [], set()
    for i in range(80):
        text = rng.choices(vocabulary, k=rng.randrange(20, 400))
        if i % 4 == 0:
            item = rng.choice(items)
            at = rng.randrange(len(text))
            text[at:at] = item[1].upper().split() if i % 8 == 0 else item[1].split()
            planted.add((i, item[0]))
        rows.append((i, " ".join(text)))
    rows += [(100, None), (101, ""), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    tests = spark.createDataFrame([*items, items[0], (98, None), (99, "too short"), (97, " ")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, tests).collect()} == planted
    monkeypatch.setattr(decontaminate, "SHARD", 20)  # several shards
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, tests).collect()} == planted
    left = [r["doc_id"] for r in decontaminate.clean(docs, tests).collect()]
    assert sorted(left) == sorted(i for i, _ in rows if i not in {d for d, _ in planted})
    # one shard or many give the same rows, scores and all
    rows_of = lambda: sorted(map(tuple, decontaminate.leaks(docs, tests).collect()))
    many = rows_of()
    monkeypatch.setattr(decontaminate, "SHARD", 10**6)
    assert rows_of() == many
    assert decontaminate.leaks(docs, tests.limit(0)).count() == 0 and decontaminate.clean(docs, tests.limit(0)).count() == len(rows)


def test_short_answers_and_items(spark):
    question = "On which river does the capital of that country lie, seen from the hill above the old town?"
    items = [(1, f"{question} The Thames."), (2, f"{question.replace('capital', 'second city')} Avon."), (3, "alpha beta gamma"), (4, "solo"), (None, "an item that has no id but words enough to be found")]
    rows = [
        (1, f"before it {question} The Thames. and behind"),
        (2, f"{question} It is called the Danube."),
        (3, f"{question.replace('capital', 'second city')} Avon. It ends here"),
        (4, "x alpha beta gamma y"),
        (5, "alpha x beta y gamma"),
        (6, "so solo it is"),
        (7, "here stands an item that has no id but words enough to be found, too"),
        (None, "x alpha beta gamma y"),
        (8, " ".join(f"w{i}" for i in range(50_000)) + f" {question} The Thames."),
    ]
    docs, tests = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")), spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, tests).collect()}
    assert got == {(1, 1), (3, 2), (4, 3), (6, 4), (7, None), (None, 3), (8, 1)}
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs, tests).collect()) == [2, 5]


def test_leaks_recall_equals_brute_force(spark):
    """Every text that scores at the threshold in some window, by BM25 over all windows and chunks, and overlaps, is found."""
    rng = random.Random(15)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 110)))) for i in range(40)]
    rows = []
    for i in range(60):
        text = rng.choices(vocabulary, k=rng.randrange(0, 200))
        part = rng.choice(items)[1].split()
        text[rng.randrange(len(text) + 1) :] = part[: rng.randrange(len(part) // 2, len(part) + 1)]
        rows.append((i, " ".join(text)))
    index = decontaminate.Index([(i, t.encode().split()) for i, t in items])
    want = set()
    for d, text in rows:
        w = text.encode().split()
        for s in range(0, len(w), decontaminate.CHUNK):
            seen = set(w[s : s + 2 * decontaminate.CHUNK])
            for k, o in enumerate(index.owner):
                score = sum(p.impacts[p.docs.index(k)] for t in seen if (p := index.postings.get(t)) and k in p.docs)
                item_id, item, q, a = index.items[o]
                around = w[max(0, s - len(item)) : s + 2 * decontaminate.CHUNK + len(item)]
                if score >= decontaminate.THRESHOLD - 1e-9 and min(decontaminate.overlap(q, around), decontaminate.overlap(a, around)) >= decontaminate.OVERLAP:
                    if len(item) >= decontaminate.WHOLE or tuple(item) in decontaminate.grams(around, len(item)):
                        want.add((d, item_id))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want and len(want) >= 15


# --- op3 -----------------------------------------------------------------------------------------------------------------------
def test_language(spark):
    rng = random.Random(6)
    stems = {"xa": ["abra", "kada", "bra"], "yo": ["umlo", "pluto", "lom"], "zu": ["zizi", "quiz", "fizz"]}
    rows = [(i, " ".join("".join(rng.choices(stems[lang], k=2)) for _ in range(rng.randrange(3, 40))), lang) for i in range(300) for lang in [rng.choice(list(stems))]]
    docs = spark.createDataFrame([*rows, (900, None, "xa"), (901, "123 !!", "yo"), (902, "", None), (903, "x", None)], "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: r for r in language.identify(docs, docs.where("doc_id % 4 <> 2")).collect()}
    assert sum(got[i]["lang_pred"] == lang for i, _, lang in rows if i % 4 == 2) / sum(i % 4 == 2 for i, *_ in rows) > 0.97
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902)) and got[903]["lang_pred"] in stems
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in language.identify(docs, docs.limit(0)).collect()} == {"und"}
    assert language.identify(docs.limit(0), docs).count() == 0


def test_training_share_follows_distinct_texts(spark):
    rows = [(f"{lang} word {i % 40} {'x' * (i % 40)}", lang) for lang in ("de", "en") for i in range(2000)]
    got = {r["lang"]: r["count"] for r in language.training(spark.createDataFrame(rows, "text string, lang string"), per_lang=30).groupBy("lang").count().collect()}
    assert set(got) == {"de", "en"} and all(15 <= n <= 40 for n in got.values())


def test_scores_are_kernel_ridge_regression(monkeypatch):
    """The operator's weights against an explicit kernel matrix, and many languages in little memory."""
    import tracemalloc

    rng = np.random.default_rng(4)
    rows = sorted(((f"l{i % 3}", np.unique(rng.integers(0, 400, 60) + 200 * (i % 3)).astype(np.int32)) for i in range(90)), key=lambda r: (r[0], r[1].tobytes()))
    langs, weights = language.fit(rows)
    dense = np.zeros((len(rows), language.BUCKETS))
    for i, (_, f) in enumerate(rows):
        dense[i, f] = len(f) ** -0.5
    mark = np.concatenate([[i for i, (x, _) in enumerate(rows) if x == lang][: language.LANDMARKS_PER_LANG] for lang in langs])
    k_nm, k_mm = dense @ dense[mark].T, dense[mark] @ dense[mark].T
    value, vector = np.linalg.eigh(k_mm)
    ok = value > 1e-6 * value.max()
    root = vector[:, ok] * value[ok] ** -0.5
    phi = np.hstack([k_nm @ root, np.ones((len(rows), 1))])
    target = np.array([[lang == x for x in langs] for lang, _ in rows], dtype=float)
    by = np.diag(target @ (1 / target.sum(0)))
    solved = np.linalg.solve(phi.T @ by @ phi + language.RIDGE / len(langs) * np.eye(phi.shape[1]), phi.T @ by @ target)
    got = np.stack([weights[f].sum(0) * len(f) ** -0.5 + weights[-1] for _, f in rows])
    assert np.abs(got - phi @ solved).max() < 1e-4
    many = [(f"l{i % 200:03d}", np.unique(rng.integers(0, language.BUCKETS, 800)).astype(np.int32)) for i in range(2_000)]
    tracemalloc.start()
    assert language.fit(many)[1].shape == (language.BUCKETS + 1, 200)
    assert tracemalloc.get_traced_memory()[1] < 1e9
    tracemalloc.stop()


def test_presence_is_the_set_of_ngrams():
    presence = language.Presence()
    for text in ("", "a", "ab", "abab", "Ärger im Haus"):
        t = text.lower()
        grams = {t[i : i + n] for n in range(1, language.ORDER + 1) for i in range(len(t) - n + 1)}
        assert len(presence.of(text)) == len(set(presence.of(text).tolist())) == len(grams)
    long = "abc " * 3000
    whole = set(presence.of(long).tolist())
    language.CHUNK, keep = 100, language.CHUNK
    try:
        assert set(language.Presence().of(long).tolist()) == whole
    finally:
        language.CHUNK = keep


# --- op1 -----------------------------------------------------------------------------------------------------------------------
def test_toxicity(spark):
    rng = random.Random(7)
    plain, bad = [f"word{i}" for i in range(200)], ["vileone", "viletwo", "vilest"]
    rows, labels = [], []
    for i in range(600):
        text, toxic = rng.choices(plain, k=rng.randrange(5, 40)), i % 4 == 0
        if toxic:
            text.insert(rng.randrange(len(text)), rng.choice(bad))
        if rng.random() < (0.7 if toxic else 0.1):  # the term goes with the label by chance
            text.insert(0, "muslims")
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    marked = spark.createDataFrame([*labels, (5, None), (None, 1), labels[0]], "doc_id long, toxic int").withColumn("quality", F.lit(0))
    learn = marked.where("doc_id % 5 <> 0")
    model = toxicity.learn(docs, learn)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [(i, y) for i, y in labels if i % 5 == 0]
    assert sum(got[i]["predicted"] == y for i, y in held) / len(held) > 0.95
    assert got[900]["score"] == got[901]["score"] < 0.5
    # the penalty takes weight from identity terms: a swap changes the score less than without it
    free = toxicity.learn(docs, learn, swap_weight=0.0)
    probe = spark.createDataFrame([(1, "muslims word1 word2"), (2, "atheists word1 word2")], "doc_id long, text string")
    change = lambda m: abs((lambda s: math.log(s[0] / (1 - s[0])) - math.log(s[1] / (1 - s[1])))([r["score"] for r in toxicity.score(probe, m).orderBy("doc_id").collect()]))
    assert change(model) < 0.5 * change(free)
    assert toxicity.learn(docs, learn.where("toxic = 0")) is None
    assert {r["score"] for r in toxicity.score(docs, None).collect()} == {0.0}


def test_interchangeable_terms(spark):
    """Words that stand in each other's place make a group, in any language; a word that goes with the label is in none."""
    rng = random.Random(24)
    groups = [["kalo", "mipu", "sorn"], ["zéta", "ñaru", "ülke"]]
    rows = []
    for i in range(900):
        g = i % 2
        parts = [f"fill{rng.randrange(400)}" for _ in range(6)] + [f"left{g}", rng.choice(groups[g]) if rng.random() < 0.25 else "other", f"right{g}"]
        toxic = int(i % 5 == 0)
        rows.append((" ".join(parts + (["vile"] if toxic else [])) + ".", toxic))
    drawn = spark.createDataFrame(rows, "text string, toxic int")
    found = toxicity.interchangeable(drawn, 180, 720)
    learned = [set(g) for g in found.values() if not g[0].startswith("fill")]
    assert len(learned) == 2 and all(any(g <= set(x) for x in groups) for g in learned) and not any("vile" in g for g in learned), found
    swap = toxicity.swapper(found)
    assert all("left0" in s and "kalo" not in s.lower() for s in swap("Fill1 left0 Kalo right0.")) and swap("nothing here") == []
    pairs = toxicity.project(drawn, np.unique(np.concatenate([toxicity.Features().of(w) for w in ("kalo", "mipu", "sorn", "zéta", "ñaru", "ülke")])).astype(np.int64), found).where("kind = 'pair'")
    assert pairs.count() > 50
    assert toxicity.interchangeable(drawn.limit(0), 1, 1) == {}


def test_toxicity_edge_cases(spark):
    docs = spark.createDataFrame([(i, ("bad " if i % 3 == 0 else "good ") + f"word{i}", "x", "y") for i in range(90)] + [(None, "bad", "x", "y"), (200, "good " * 200_000, "x", "y"), (200, "good", "x", "y")], "doc_id long, text string, score string, predicted string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.learn(docs, labels)).collect()
    assert len(got) == 93 and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got)
    assert toxicity.score(docs.limit(0), toxicity.learn(docs, labels)).count() == 0


# --- op5 -----------------------------------------------------------------------------------------------------------------------
PAGE = "page_id long, url string, html string"


def test_blocks():
    kept = lambda page: [t for k, t in html_text.blocks(page) if k == html_text.ARTICLE]
    assert html_text.blocks(None) == html_text.blocks("") == []
    page = """<!DOCTYPE html><html><head><title>t</title></head><body><nav><a>menu</a></nav><div class="cookie-notice">cookies</div><article><h1>Head &amp; tail</h1><p>one <b>t</b>wo<p>three<br>four
    <script>var x="</p>";</script><form>form <input></form><aside>side</aside><div class="ad">buy</div></article><section id="comments"><article class="comment">hi</article></section><footer>foot"""
    assert kept(page) == ["Head & tail", "one two", "three", "four"]
    assert kept("<main><p>a<nav>b</nav><p>c</main>d") == ["a", "c"]
    assert kept('<form><div class="with-sidebar"><div class="menu">m</div><article><p>a</article>b</div></form>') == ["a"]
    assert kept('<div class="comments"><article>a</article></div><aside><article>b</article></aside><article>c</article>') == ["c"]
    assert html_text.blocks("<p>loose<p>text") == [(html_text.UNKNOWN, "loose"), (html_text.UNKNOWN, "text")]


def test_extract(spark, monkeypatch):
    rng = random.Random(8)
    boiler = " ".join(f"boiler{i}" for i in range(12))
    rows, want = [], {}
    for i in range(40):
        own = [" ".join(f"u{i}x{rng.randrange(10**6)}" for _ in range(rng.randrange(3, 20))) for _ in range(3)]
        # no article: what the host repeats goes, unique runs stay
        rows.append((i, f"http://h.example.com/{i}", f"<body><p>{own[0]}<p>{boiler}<p>{own[1]}<p>{own[2]}</body>"))
        want[i] = " ".join(own)
    shared = "passage " * 3 + " ".join(f"p{i}" for i in range(20))
    for i in range(40, 44):  # a repeated passage inside an article stays
        rows.append((i, f"http://h.example.com/{i}", f"<nav>{boiler}</nav><article><p>{shared}</p> &eacute;{i}</article>"))
        want[i] = " ".join(f"{shared} é{i}".split())
    spread = " ".join(f"spread{i}" for i in range(10))  # once inside an article, once outside: text that no other page has outside
    rows += [(48, "http://h.example.com/48", f"<main><p>{spread}</main>"), (49, "http://h.example.com/49", f"<p>{spread}<p>mine")]
    want |= {48: spread, 49: f"{spread} mine"}
    rows += [(50, None, None), (51, "nohost", "<p>alone"), rows[0]]
    want |= {50: "", 51: "alone"}
    pages = spark.createDataFrame(rows, PAGE).withColumn("text", F.lit("clash"))
    for per_block in (200, 5):
        got = html_text.extract(pages, per_block=per_block).collect()
        assert len(got) == len(rows)
        assert {r["page_id"]: r["text"] for r in got} == want
        assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_text.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("n", [3, 30])
def test_split_host_of_clean_pages(spark, n):
    """A host of several blocks without a run outside its articles, and one where some batches have none."""
    clean = [(i, f"http://h.example.com/{i}", f"<nav>menu</nav><article><p>Text {i} of a page.</p></article>") for i in range(n)]
    some = [(n + i, f"http://h.example.com/x{i}", f"<article>Other {i}</article><div>one two three four five six seven eight nine</div>") for i in range(2)]
    for rows in (clean, clean + some):
        frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
        got = {r["page_id"]: r["text"] for r in html_text.extract(frame, per_block=2).collect()}
        assert got == {i: f"Text {i} of a page." if i < n else f"Other {i - n}" for i, *_ in rows}
    assert html_text.extract(spark.createDataFrame([(1, "http://h/", "<p>x</p>")] * 3, "page_id long, url string, html string"), per_block=1).count() == 3


def test_pages_under_several_urls_are_one(spark):
    own = [" ".join(f"p{i}x{j}" for j in range(30)) for i in range(6)]
    boiler = " ".join(f"boiler{j}" for j in range(10))
    rows = [(10 * i + k, f"http://m.example.com/{i}?utm={k}", f"<body><p>{boiler}<p>{own[i]}</body>") for i in range(6) for k in range(3)]
    for per_block in (200, 4):
        assert {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, PAGE), per_block=per_block).collect()} == {r[0]: own[r[0] // 10] for r in rows}


def test_text_outside_the_article(spark, monkeypatch):
    boiler = " ".join(f"boiler{j}" for j in range(10))
    own = [" ".join(f"b{i}x{j}" for j in range(12)) for i in range(30)]
    # a small teaser article (or main) and the body in a div
    rows = [(i, f"http://t.example.com/{i}", f"<body><nav>go {i}</nav><{tag}><p>teaser {i}</{tag}><div><p>{boiler}<p>{own[i]}</div></body>") for i in range(30) for tag in ["main" if i % 2 else "article"]]
    # all text is in known markup
    rows += [(100 + i, f"http://k.example.com/{i}", f"<nav>{boiler}</nav><article><p>{own[i]}</article>") for i in range(30)]
    want = {i: f"teaser {i} {own[i]}" for i in range(30)} | {100 + i: own[i] for i in range(30)}
    for per_block, most in ((200, 10), (1, 10**6), (1, 10)):  # each page in a block by itself, or nearly; with and without the first count
        monkeypatch.setattr(html_text, "BROADCAST_PRINTS", most)
        got = {r["page_id"]: r for r in html_text.extract(spark.createDataFrame(rows, PAGE), per_block=per_block).collect()}
        assert {i: r["text"] for i, r in got.items()} == want
        assert all(r["n_repeated"] == 10 for r in got.values())
    # without the array the boilerplate outside the article stays
    none = lambda streams, *_: [np.zeros(len(s), dtype=bool) for s in streams]
    monkeypatch.setattr(html_text, "repeated", none)
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, PAGE), per_block=200).collect()}
    assert all(got[i] == f"teaser {i} {boiler} {own[i]}" for i in range(30))


def test_extract_edge_cases(spark):
    """A very long page, clashing columns, equal and repeated rows."""
    long = " ".join(f"x{i}" for i in range(60_000))
    rows = [(1, "http://l.example.com/1", f"<article><p>{long}</article><p>{long}", 5), (2, "http://l.example.com/2", f"<p>{long} end", 6), (None, None, "<p>no id", None)]
    got = html_text.extract(spark.createDataFrame([*rows, rows[2]], f"{PAGE}, n_chars long")).collect()
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in got) == sorted([("1", long, len(long)), ("2", "end", 3), ("None", "no id", 5), ("None", "no id", 5)])


def test_longest_matches_equal_brute_force():
    rng = np.random.default_rng(19)
    for _ in range(40):
        streams = [rng.integers(0, 3, rng.integers(0, 25)) for _ in range(5)]
        owners = rng.integers(0, 3, 5)
        found, starts = html_text.longest_matches(streams, owners)
        for i, s in enumerate(streams):
            for p in range(len(s)):
                best = 0
                for j, o in enumerate(streams):
                    if owners[i] != owners[j]:
                        for q in range(len(o)):
                            n = 0
                            while p + n < len(s) and q + n < len(o) and s[p + n] == o[q + n]:
                                n += 1
                            best = max(best, n)
                assert found[starts[i] + p] == best


def test_repeated_equals_brute_force():
    rng = np.random.default_rng(9)
    for run in (1, 2, 3, 5, 8):
        pages = [rng.integers(0, 4, rng.integers(0, 40)) for _ in range(6)]
        where = collections.defaultdict(set)
        for i, p in enumerate(pages):
            for j in range(len(p) - run + 1):
                where[tuple(p[j : j + run])].add(i)
        for p, got in zip(pages, html_text.repeated(pages, run), strict=True):
            want = np.zeros(len(p), dtype=bool)
            for j in range(len(p) - run + 1):
                if len(where[tuple(p[j : j + run])]) > 1:
                    want[j : j + run] = True
            assert (got == want).all()


# --- op9 -----------------------------------------------------------------------------------------------------------------------
def test_urls(spark):
    urls = [
        ("http://a.net/x", "a.net", "/x", "net/", "block"),
        ("https://WWW.Example.NET/en/1?q#f", "www.example.net", "/en/1", "example.net/en/", "allow"),
        ("http://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
        ("http://xexample.com/de/", "xexample.com", "/de/", None, None),
        ("http://b.org/fr/z", "b.org", "/fr/z", "org/fr/", "allow"),
        ("http://b.org?x=/fr/", "b.org", "", None, None),
        ("http://planet", "planet", "", None, None),
        ("no host", "", "", None, None),
        (None, "", "", None, None),
    ]
    more = [(500 + i, f"http://x{i % 7}.site{i % 9}.net/de/{i}") for i in range(100)]
    more += [(100 + i, f"http://s{i % 3}.example.{'com' if i % 2 else 'org'}/{'de' if i % 2 else 'fr'}/{i}") for i in range(200)]
    pages = spark.createDataFrame([(i, u[0]) for i, u in enumerate(urls)] + more + [(300, "http://t.example.info/de/7"), (1, urls[1][0])], "page_id long, url string").withColumn("verdict", F.lit("clash"))
    got = url_rules.judge(pages).collect()
    assert len(got) == len(urls) + 302
    by = {r["page_id"]: r for r in got}
    for i, (_, host, path, rule, verdict) in enumerate(urls):
        assert (by[i]["host"], by[i]["path"], by[i]["rule"]) == (host, path, rule) and (verdict is None or by[i]["verdict"] == verdict)
    assert by[300]["verdict"] == "block" and by[300]["rule"] is None and by[300]["confidence"] >= 0.9  # mined: first=de
    assert url_rules.own_tokens("example.com", "/de/") == ["tld=com", "domain=example.com", "first=de"] and url_rules.own_tokens("net", "/") == ["tld=net"]
    # rows are judged alike one by one; a long url is no trouble
    long = spark.createDataFrame([(1, "http://q.info/de/" + "a/" * 50_000 + "?" + "k=v&" * 20_000)], "page_id long, url string")
    assert url_rules.judge(pages.unionByName(long, allowMissingColumns=True)).where("length(path) > 50000").first()["verdict"] == "block"
    assert url_rules.judge(pages.limit(0)).count() == 0


def test_judge_equals_brute_force(spark):
    """Rules pruned and chosen by plain Python from the same mined rules, on the given tables' urls."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    seen = [(r["page_id"], r["hit"], r["toks"]) for r in url_rules.tokenised(pages, url_rules.RULES).collect()]
    labelled = [([t for t in toks if t not in hit["own"]], hit["verdict"]) for _, hit, toks in seen if hit]
    frame = spark.createDataFrame(labelled, "toks array<string>, label string")
    mined = [(tuple(r["antecedent"]), r["verdict"], r["confidence"], r["support"]) for r in url_rules.mine(frame).collect()]
    kept = [r for r in mined if not any(set(g[0]) < set(r[0]) and g[1] == r[1] and g[2] >= r[2] for g in mined)]
    assert sorted(kept) == sorted((tuple(r["antecedent"]), r["verdict"], r["confidence"], r["support"]) for r in url_rules.prune(url_rules.mine(frame)).collect())
    want = {}
    for page, hit, toks in seen:
        fits = [(c, s, -len(a), v, list(a)) for a, v, c, s in kept if set(a) <= set(toks)]
        want[page] = (hit["rule"], hit["verdict"], None) if hit else (None, max(fits)[3], " ".join(max(fits)[4])) if fits else (None, url_rules.DEFAULT, None)
    got = {r["page_id"]: (r["rule"], r["verdict"], r["reason"]) for r in url_rules.judge(pages).collect()}
    assert got == want and any(x[2] for x in want.values())


def test_rules_on_unseen_hosts(spark):
    """A path that tells is told on hosts that mining hasn't seen; noise isn't."""
    rows = [(i, f"http://h{i % 40}.{'net' if i % 2 else 'org'}/{'ads' if i % 2 else 'fr'}/{i}.html") for i in range(400)]
    found = url_rules.held_out(spark.createDataFrame(rows, "page_id long, url string")).first()
    assert found["asked"] == 400 and found["right"] == found["told"] >= 200


def test_mined_rules_equal_brute_force(spark):
    rng = random.Random(10)
    rows = [(sorted({f"t{rng.randrange(6)}" for _ in range(3)}), rng.choice(["block", "allow"])) for _ in range(120)]
    got = {(tuple(r["antecedent"]), r["verdict"]): r["confidence"] for r in url_rules.mine(spark.createDataFrame(rows, "toks array<string>, label string"), 0.05, 0.6).collect()}
    want = {}
    for n in (1, 2, 3):
        for combo in itertools.combinations([f"t{i}" for i in range(6)], n):
            having = [label for t, label in rows if set(combo) <= set(t)]
            for label in ("block", "allow"):
                if having and having.count(label) / len(rows) >= 0.05 and having.count(label) / len(having) >= 0.6:
                    want[combo, label] = having.count(label) / len(having)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


# --- op10 ----------------------------------------------------------------------------------------------------------------------
def brute_patterns(text):
    out = []
    for kind, pattern, least, group in (("assign", r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 8, 2), ("access", "AKIA[A-Z0-9]+", 16, 0), ("hex", "[0-9a-f]+", 32, 0)):
        out += [(kind, *m.span()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return sorted(out, key=lambda s: (s[1], secrets.KINDS.index(s[0]), s[2]))


def test_patterns_equal_brute_force():
    rng = random.Random(11)
    parts = ["token", "Secret", "PASSWORD", "api_key", "apikey", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH12", "deadbeef", "0123456789abcdef", "x", "é", "\n", "short", "longvalue99", "ſecret"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randrange(0, 14)))
        assert secrets.patterns(text) == brute_patterns(text)


def test_viterbi_equals_brute_force():
    rng = random.Random(12)
    for _ in range(50):
        edge = [[rng.uniform(-2, 2) for _ in range(3)] for _ in range(3)]
        rows = [[rng.uniform(-2, 2) for _ in range(3)] for _ in range(rng.randrange(1, 6))]
        total = lambda tags: sum(r[t] for r, t in zip(rows, tags, strict=True)) + sum(edge[a][b] for a, b in zip([0, *tags], [*tags, 0], strict=True))
        assert math.isclose(total(secrets.viterbi(rows, edge)), max(total(list(t)) for t in itertools.product(range(3), repeat=len(rows))))


def notes(n, seed):
    """Texts with a secret that a pattern finds, and with numbers, addresses and long words that are none."""
    rng = random.Random(seed)
    hexes = lambda k: "".join(rng.choices("0123456789abcdef", k=k))
    word = lambda: "".join(rng.choices("abdeilnorst", k=rng.randrange(2, 9)))
    some = lambda k: " ".join(word() for _ in range(k))
    out = []
    for i in range(n):
        out += [f'{some(9)} token = "{hexes(40)}" {some(6)}', f"{some(5)} call {rng.randrange(10**15, 10**16)} at 2024-01-{i % 28 + 1:02d} {some(4)}", f"{some(4)} mail {word()}{i}@mail{i % 9}.example.com from 10.{i % 255}.3.{i % 99} {some(5)}", f"{some(3)} password={hexes(18)} {some(3)}", f"see https://{word()}.example.org/{word()}/{i}?x={i} {some(20)}"]
    return out


@pytest.fixture(scope="module")
def field(spark):
    return secrets.learn(spark.createDataFrame([(t,) for t in notes(150, 13)], "text string"))


def test_scan(spark, field):
    texts = notes(20, 14)
    rows = [*enumerate(texts), (9000, None), (9001, ""), (9002, f"é says xk7Qp2Lm9Vt4Rw8Zs1Nb6Hd3Fg5 now"), (9003, "call 2669109448945250 now"), (9004, " ".join(["plain words"] * 60_000) + " AKIA" + "Z9" * 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash"))
    got = {r["doc_id"]: r for r in secrets.find(docs, field).collect()}
    for i, t in rows:
        assert [tuple(s) for s in got[i]["base"]] == brute_patterns(t or "")
        assert set(map(tuple, got[i]["base"])) <= set(map(tuple, got[i]["spans"]))
    assert [tuple(s) for s in got[9002]["spans"]] == [("field", 7, 34)]  # the patterns miss it
    assert not got[9003]["spans"] and not got[9000]["spans"] and len(got[9004]["spans"]) == 1
    redacted = {r["doc_id"]: r["text"] for r in secrets.redact(docs.select("doc_id", "text"), field).collect()}
    assert redacted[9000] is None and redacted[9002] == "é says [SECRET] now" and redacted[9003] == rows[-2][1]
    assert secrets.learn(docs.limit(0)) is None and secrets.find(docs.limit(0), None).count() == 0


def test_field_finds_masked_secrets(field):
    """Held-out texts whose secrets no pattern finds: without cue, in other alphabets, letters only too."""
    rng = random.Random(16)
    plain, masked, where = notes(200, 17), [], []
    for text in plain[::5]:
        alphabet = rng.choice(["0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"])
        value = "".join(rng.choices(alphabet, k=rng.randrange(20, 45)))
        before, after = text.split(" token = ")[0], text.split('" ')[-1]
        masked.append(f"{before} {value} {after}")
        where.append(("field", len(before) + 1, len(before) + 1 + len(value)))
    assert not any(secrets.patterns(t) for t in masked)
    found = [spans for _, spans in secrets.scan(masked, field)]
    recall = sum(w in spans for w, spans in zip(where, found, strict=True)) / len(where)
    wrong = sum(k == "field" for _, spans in secrets.scan([t for i, t in enumerate(plain) if i % 5], field) for k, _, _ in spans)
    assert recall > 0.9 and wrong <= 0.01 * len(plain), (recall, wrong)


def test_pruned_decoding_equals_viterbi_over_all_tokens(field):
    weights, edge = field
    rng = random.Random(20)
    weights = weights * 0.4 + np.random.default_rng(3).normal(size=weights.shape).astype(np.float32) * 0.2  # many close calls
    texts = [t.encode() for t in notes(12, 21)] + [b"", b" ", "ünï çödé".encode()]
    some = secrets.tagged(texts, (weights, edge))
    for i, t in enumerate(texts):
        data, _, starts, ends, of = secrets.laid_out([t])
        x = secrets.features(data, starts, ends, of, secrets.about_texts([t]))
        gain = weights[x].sum(1) if len(x) else []
        spans = []
        for k, tag in enumerate(secrets.viterbi([[0.0, *map(float, g)] for g in gain], edge) if len(x) else []):
            if tag == 1:
                spans.append([int(starts[k]), int(ends[k])])
            elif tag == 2:
                spans[-1][1] = int(ends[k])
        assert some.get(i, []) == [tuple(s) for s in spans], rng


def test_features_by_piece_are_those_of_the_whole(field, monkeypatch):
    texts = [t.encode() for t in notes(8, 22)]
    whole = secrets.tagged(texts, (field[0] * 0.3, field[1]))
    monkeypatch.setattr(secrets, "PIECE", 50)
    monkeypatch.setattr(secrets, "TOKENS", 3)
    assert secrets.tagged(texts, (field[0] * 0.3, field[1])) == whole


def test_learning_follows_distinct_texts(spark):
    texts = [(t,) for t in notes(12, 23)]
    once, copies = (secrets.learn(spark.createDataFrame(t, "text string"), 40, 40) for t in (texts, texts * 30))
    assert np.array_equal(once[0], copies[0]) and np.array_equal(once[1], copies[1])


# --- folds and the pipeline ----------------------------------------------------------------------------------------------------
def test_folds(spark):
    from sessionmill.llm.common import fold

    got = spark.createDataFrame([(i,) for i in [0, 1, 12345, None]], "doc_id long").select("doc_id", fold(F.col("doc_id"), 7).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 7 for r in got)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = corpus(100)
    item = " ".join(f"q{i}" for i in range(30))
    rows += [(500, f"before it {item} after it", "en", "s1", 99), (501, 'my token = "0123456789abcdef0123" ok', "en", "s2", 40), (502, "12 34", "en", "s2", 5)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = seen[name] = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "source_mix":
            assert docs.columns == corpus_pipeline.COLUMNS
    ids = {n: sorted(r["doc_id"] for r in d.collect()) for n, d in seen.items()}
    lettered = [r for r in rows if language.has_letter(r[1])]
    assert ids["language_id"] == sorted(r[0] for r in lettered)
    groups = brute_components(lettered, 5, 80)
    assert ids["ngram_jaccard"] == sorted(i for i, (_, c) in groups.items() if i == c)
    assert ids["decontaminate"] == [i for i in ids["ngram_jaccard"] if i != 500]
    assert ids["secret_scan"] == ids["source_mix"] == ids["decontaminate"]
    assert {r["doc_id"]: r["text"] for r in seen["secret_scan"].collect()}[501] == 'my [SECRET]" ok'
    size = {r["doc_id"]: r["size"] for r in seen["source_mix"].collect()}
    assert all(size[r["doc_id"]] == len(words(r["text"])) for r in seen["secret_scan"].collect())


def test_pipeline_edge_cases(spark, tmp_path):
    """Each stage on odd rows with clashing extra columns, and on an empty table; a run leaves its last stage alone in the folder."""
    import corpus_pipeline

    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(None, "one two three four five six", "en", "s1", 1), (None, "one two three four five six", "en", "s1", 1), (7, None, None, None, None), (7, "seven words of text for id seven", None, None, 2), (7, "other words of text that id seven has", "de", None, 2)]
    rows += [(8, "", "en", "s1", 0), (9, "!!! 12", "en", "s1", 0), (10, long, "en", "s2", 9), (11, long + " end", "en", "s2", 9), (12, "Hi", None, "s2", 2)]
    extra = ", score double, lang_pred string, taken long, size long, node long, text_id long"
    frame = spark.createDataFrame([(*r, 0.5, "xx", 3, 4, 5, 6) for r in rows], DOCS + extra)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None), (None, ""), (2, "nothing that stands there at all in any of these texts")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = frame
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), stage(spark, docs.limit(0), str(tmp_path)).schema)
        kept[name] = sorted((r["doc_id"] for r in docs.collect()), key=str)
        assert stage(spark, (frame if name == "language_id" else frame.select(corpus_pipeline.COLUMNS)).limit(0), str(tmp_path)).count() == 0
    assert kept["language_id"] == sorted([None, None, 7, 7, 10, 11, 12], key=str)
    assert kept["ngram_jaccard"] == sorted([None, 7, 7, 10, 12], key=str) == kept["decontaminate"] == kept["secret_scan"] == kept["source_mix"]
    shared = pathlib.Path(shared_dir(spark).removeprefix("file:"))
    before = set(shared.iterdir())
    done = corpus_pipeline.run(spark, str(tmp_path))
    left = [f for f in set(shared.iterdir()) - before if not f.name.startswith("rdd-")]  # but for checkpoints
    assert [f.name.split("-")[0] for f in left] == ["pipeline"] and [f.name for f in left[0].iterdir()] == ["source_mix"]
    assert sorted((r["doc_id"] for r in done.collect()), key=str) == kept["source_mix"]


def test_article_of_given_pages(spark):
    """Main texts of the given pages against their article element, cut out by a pattern."""
    path = "/root/testdata/sf0.001"
    got = {r["page_id"]: r["text"] for r in html_text.op5_html_text(spark, path).collect()}
    for r in spark.read.parquet(f"{path}/pages.parquet").collect():
        body = re.search("<article>(.*?)</article>", r["html"], re.S)[1]
        assert got[r["page_id"]] == " ".join(html.unescape(re.sub("</?b>", "", re.sub("</?(p|h1|br)>", " ", body))).split())
