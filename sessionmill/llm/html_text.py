"""HTML extraction with a host suffix array.

Every page is read into blocks of text. Markup protects the article: its blocks
stay whatever repeats (passages that articles share are text). All text outside
is the suffix array's: the token streams of a host's pages are concatenated, cut
at articles, their suffixes sorted (prefix doubling, to full depth), and from the
lengths of common prefixes follows, for each place, the longest substring that
also stands on another page. Substrings of ``RUN`` tokens or more are boilerplate
and go; unique runs stay. An exact check by markup follows: of the unique runs
those in page furniture (menus, headers, footers, sidebars, notices, adverts,
forms, reader comments) go, too.

A host's pages are sorted in blocks of about ``PAGES`` pages. For hosts of more
than one block, the runs that stand on two pages are found by a distributed count of
their hashes and given to each block, so splitting a host loses no repeated run. A
first count of short prints of all runs tells which can't stand twice; only the others
are counted by page. Pages of a host with equal block texts are one page, under
whatever urls.

Defined results: a null html is an empty page with empty text. Repeated rows each
get their row; a null url has the empty host. No text is cut. Extra columns are
dropped. White space is what str.split() splits at.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionmill.llm.common import WordHash, batches, mix, small_batches, table
from sessionmill.llm.url_rules import parts

RUN, PAGES = 8, 200
#: Up to this many split hosts are broadcast; beyond that they are joined by shuffle.
BROADCAST_HOSTS = 100_000
#: Bits of a run's print, and of its first part that tells the shard. Up to this many prints are broadcast; beyond that all runs are counted by page.
PRINT, SHARD, BROADCAST_PRINTS = 41, 9, 4_000_000

ARTICLE, FURNITURE, UNKNOWN = 0, 1, 2

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|math|iframe|textarea|select|object|canvas|audio|video|head|button)\b[^>]*(?<!/)>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/][^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
FURNITURE_TAGS = frozenset("nav header footer aside form menu dialog fieldset".split())
CONTAINERS = FURNITURE_TAGS | frozenset("article main body div section ul ol dl table figure details center blockquote span p li td".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id and role that mark page furniture.
FURNITURE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert banner sidebar aside menu nav navbar navigation breadcrumb breadcrumbs comment comments disqus reply replies discussion respond share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay footer header masthead topbar toolbar widget pagination pager form search contentinfo complementary dialog".split()
)
#: The fewer that an article element itself can have.
ARTICLE_NAMES = frozenset("comment comments reply replies ad ads advert sponsored promo related".split())


#: How sure markup is: a wrapper (a class on an element, or a form) that holds a whole article is no furniture.
WRAPPER, SURE = 1, 2


def _furniture(tag: str, attributes: str) -> int:
    """0, or how sure it is that the element is page furniture."""
    if tag in FURNITURE_TAGS:
        return WRAPPER if tag == "form" else SURE
    if not attributes or tag in ("body", "html", "main", "h1", "h2", "h3"):
        return 0
    found = 0
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return SURE
        if name in ("class", "id", "role"):
            words = {w.lower() for w in _NAME.findall(value)}
            if words & ARTICLE_NAMES:
                return SURE
            if tag != "article" and words & FURNITURE_NAMES:
                found = WRAPPER
    return found


def blocks(page: str | None) -> list[tuple[int, str]]:
    """Blocks of a page in order: where markup puts them, and their text."""
    if not page:
        return []
    found: list[list] = []
    text: list[str] = []
    stack: list[tuple[str, int]] = []  # open containers; how sure it is that they are furniture
    at, bad, inside = 0, 0, {"article": 0, "main": 0}

    def end() -> None:
        if text:
            whole = " ".join(entities.unescape("".join(text)).split())
            if whole:
                found.append([FURNITURE if bad else ARTICLE if inside["article"] else -1 if inside["main"] else UNKNOWN, whole])
            text.clear()

    def pop() -> None:
        nonlocal bad
        tag, was = stack.pop()
        bad -= was > 0
        if tag in inside and not was:
            inside[tag] -= 1

    for m in _MARKUP.finditer(page):
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        tag = (m[3] or m[1] or "").lower()
        if not tag:
            continue
        closing, attributes = m[2] == "/", m[4] or ""
        marked = _furniture(tag, attributes) if not closing and (attributes or tag in FURNITURE_TAGS) else 0
        if tag in INLINE and not marked and not (closing and any(t == tag for t, _ in stack)):
            continue
        end()
        if m[1] or tag in VOID or attributes.endswith("/"):
            continue
        if closing:
            if any(t == tag for t, _ in stack):
                while stack[-1][0] != tag:
                    pop()
                pop()
        else:
            if tag in ("p", "li", "td", "div", "section", "article") and stack and stack[-1][0] == "p" or tag == "li" and stack and stack[-1][0] == "li":
                pop()
            if tag in CONTAINERS and (marked or tag not in INLINE and tag not in ("p", "li", "td")):
                if tag in inside and not marked:
                    if bad and all(sure != SURE for _, sure in stack):
                        stack, bad = [(t, 0) for t, _ in stack], 0
                    inside[tag] += 1
                stack.append((tag, marked))
                bad += marked > 0
    if at < len(page):
        text.append(page[at:])
    end()
    # main is the article of a page that has no other; beside one, its text is the suffix array's, as all text outside
    as_main = UNKNOWN if any(k == ARTICLE for k, _ in found) else ARTICLE
    return [(as_main if k == -1 else k, t) for k, t in found]


def longest_matches(streams: list[np.ndarray], owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of the concatenated streams (each ends with a separator of its own), the length of the longest substring from
    there that also stands in a stream of another owner; and where each stream starts.

    The suffix array comes from ranks by the first 1, 2, 4, ... tokens until all suffixes differ. Common prefixes of neighbours
    are read off the same ranks, the longest first, and carried on to the nearest suffix of another owner, either way.
    """
    sizes = np.array([len(s) for s in streams], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    total = int(starts[-1])
    if not total:
        return np.zeros(0, dtype=np.int64), starts
    most = max((int(s.max()) for s in streams if len(s)), default=0) + 1
    text = np.empty(total, dtype=np.int64)
    for i, s in enumerate(streams):
        text[starts[i] : starts[i + 1] - 1] = s
        text[starts[i + 1] - 1] = most + i
    page = np.repeat(np.asarray(owners, dtype=np.int64), sizes + 1)
    ranks = [np.unique(text, return_inverse=True)[1].astype(np.int64)]
    depth = 1
    while int(ranks[-1].max()) + 1 < total:
        rank = ranks[-1]
        after = np.full(total, -1, dtype=np.int64)
        after[: total - depth] = rank[depth:]
        key = rank * (total + 1) + after + 1
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.empty(total, dtype=np.int64)
        new[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        ranks.append(new)
        depth *= 2
    suffixes = np.empty(total, dtype=np.int64)
    suffixes[ranks[-1]] = np.arange(total)
    above, below = suffixes[:-1], suffixes[1:]
    common = np.zeros(total - 1, dtype=np.int64)
    for level in range(len(ranks) - 2, -1, -1):
        a, b = above + common, below + common
        inside = np.flatnonzero((a < total) & (b < total))
        same = inside[ranks[level][a[inside]] == ranks[level][b[inside]]]
        common[same] += 1 << level
    owner = page[suffixes]
    best = np.zeros(total, dtype=np.int64)
    for way in (1, -1):
        o, c = owner[::way], np.concatenate([[0], common[::way]])
        part = np.concatenate([[0], np.cumsum(o[1:] != o[:-1])])
        lift = (int(part[-1]) - part) * (total + 1)  # minima are taken within each stretch of one owner
        nearest = np.minimum.accumulate(c + lift) - lift
        nearest[part == 0] = 0
        best = np.maximum(best, nearest[::way])
    out = np.empty(total, dtype=np.int64)
    out[suffixes] = best
    return out, starts


def repeated(streams: list[np.ndarray], run: int = RUN, given: np.ndarray | None = None, hashes: list[np.ndarray] | None = None, owners: list[int] | None = None) -> list[np.ndarray]:
    """For each stream's tokens, which of them a substring of ``run`` tokens or more covers that a stream of another owner has too.

    owners: the pages of the streams (by default each is a page). given: hashes of runs known to repeat elsewhere; hashes: those
    of each stream's runs.
    """
    longest, starts = longest_matches(streams, np.arange(len(streams)) if owners is None else np.array(owners))
    out = []
    for i, s in enumerate(streams):
        here = longest[starts[i] : starts[i] + len(s)]
        edge = np.zeros(len(s) + 1, dtype=np.int64)
        places = np.flatnonzero(here >= run)
        edge[places] += 1
        np.subtract.at(edge, places + here[places], 1)
        if given is not None and len(given) and len(hashes[i]):
            places = np.flatnonzero(np.isin(hashes[i], given))
            edge[places] += 1
            edge[places + run] -= 1
        out.append(np.cumsum(edge)[: len(s)] > 0)
    return out


def run_hashes(found: list[str], run: int = RUN, seen: WordHash | None = None) -> np.ndarray:
    """64-bit hashes of the runs of ``run`` tokens, by place."""
    if len(found) < run:
        return np.zeros(0, dtype=np.uint64)
    h = (WordHash() if seen is None else seen).of(found)
    out = np.zeros(len(h) - run + 1, dtype=np.uint64)
    for i in range(run):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - run + 1 + i])
    return out


def runs_of_pages(pieces: list[list[list[str]]], run: int, seen: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (page, run hash) of many pages' pieces at once, by page and hash."""
    flat = [piece for page in pieces for piece in page]
    sizes = np.array([len(piece) for piece in flat], dtype=np.int64)
    runs = run_hashes([t for piece in flat for t in piece], run, seen)
    left = np.repeat(sizes, sizes) - (np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes))  # tokens of the piece from here on
    page = np.repeat(np.repeat(np.arange(len(pieces)), [len(x) for x in pieces]), sizes)[: len(runs)]
    whole = left[: len(runs)] >= run
    page, runs = page[whole], runs[whole]
    order = np.lexsort((runs, page))
    page, runs = page[order], runs[order]
    new = np.ones(len(runs), dtype=bool)
    new[1:] = (runs[1:] != runs[:-1]) | (page[1:] != page[:-1])
    return page[new], runs[new]


def outside(found: list[tuple[int, str]]) -> list[list[str]]:
    """Tokens outside the article, cut where it stands between them."""
    out: list[list[str]] = []
    before = ARTICLE
    for kind, text in found:
        if kind != ARTICLE:
            if before == ARTICLE:
                out.append([])
            out[-1] += text.split()
        before = kind
    return out


def content_of(found: list[tuple[int, str]]) -> int:
    """Hash of the block texts: pages of a host that have it in common are one page."""
    return xxhash.xxh64_intdigest("\n".join([t for _, t in found]).encode("utf-8", "surrogatepass"))


def _pack(found: list[tuple[int, str]], by: zstandard.ZstdCompressor) -> bytes:
    return by.compress(json.dumps(found, ensure_ascii=False).encode("utf-8", "surrogatepass"))


def _unpack(packed: bytes) -> list[tuple[int, str]]:
    return json.loads(zstandard.ZstdDecompressor().decompress(packed).decode("utf-8", "surrogatepass"))


def extract(pages: DataFrame, run: int = RUN, per_block: int = PAGES) -> DataFrame:
    """page_id, url, text, n_chars, n_tokens (all tokens of the page), n_repeated (those outside the article in runs that the host
    repeats, which the suffix array removes), n_checked (unique ones in page furniture, which the check removes) per page row."""
    spark = pages.sparkSession
    small_batches(spark)
    host, _ = parts(F.col("url"))
    seen = pages.select("page_id", "url", "html", host.alias("host"))
    split = table(seen.groupBy("host").agg(F.ceil(F.count("*") / per_block).alias("n")).where("n > 1"), "hosts")
    split = F.broadcast(split) if split.count() <= BROADCAST_HOSTS else split
    # copies of a page go to different blocks; they count as one page there and in the count across blocks
    dealt = seen.join(split, "host", "left").withColumn("n", F.coalesce("n", F.lit(1))).withColumn("part", F.pmod(F.xxhash64(F.xxhash64("url", "html"), "page_id"), F.col("n")))
    kind = pages.schema["page_id"].dataType.simpleString()

    def parse(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = zstandard.ZstdCompressor(level=1)
        for batch in batches(it, 500):
            made = [_pack(blocks(t), by) for t in batch.column("html").to_pylist()]
            yield pa.record_batch({c: batch.column(c) for c in ("page_id", "url", "host", "part")} | {"blocks": pa.array(made, pa.binary())})

    parsed = dealt.select("page_id", "url", "html", "host", "part").mapInArrow(parse, f"page_id {kind}, url string, host string, part long, blocks binary")

    def prints_of(hosts: np.ndarray, runs: np.ndarray) -> np.ndarray:
        return mix(runs ^ hosts) >> np.uint64(64 - PRINT)

    def host_hashes(hosts: list[str]) -> np.ndarray:
        return np.array([xxhash.xxh64_intdigest(h) for h in hosts], dtype=np.uint64)

    low_bits = np.uint64(PRINT - SHARD)

    def print_runs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        for batch in batches(it, 1000):
            page, runs = runs_of_pages([outside(blocks(t)) for t in batch.column("html").to_pylist()], run, words)
            found, n = np.unique(prints_of(host_hashes(batch.column("host").to_pylist())[page], runs), return_counts=True)
            if not len(found):
                continue  # no page of the batch has a run outside its article
            which, first = np.unique(found >> low_bits, return_index=True)
            packed = []
            for a, b in zip(first, np.append(first[1:], len(found)), strict=True):
                low = (found[a:b] & ((np.uint64(1) << low_bits) - np.uint64(1))).astype(np.uint32)
                packed.append((np.diff(low, prepend=np.uint32(0)).tobytes(), np.packbits(n[a:b] > 1).tobytes()))
            yield pa.record_batch({"shard": pa.array(which.astype(np.int32), pa.int32()), "prints": pa.array([p for p, _ in packed], pa.binary()), "twice": pa.array([t for _, t in packed], pa.binary())})

    def often(group: pa.Table) -> pa.Table:
        held = []
        for p, t in zip(group["prints"].to_pylist(), group["twice"].to_pylist(), strict=True):
            low = np.cumsum(np.frombuffer(p, dtype=np.uint32), dtype=np.uint32)
            held += [low, low[np.unpackbits(np.frombuffer(t, dtype=np.uint8), count=len(low)) > 0]]
        low, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.table({"print": (np.uint64(group["shard"][0].as_py()) << low_bits | low[n > 1].astype(np.uint64)).astype(np.int64)})

    large = dealt.where(F.col("n") > 1)
    printed = table(large.select("host", "html").mapInArrow(print_runs, "shard int, prints binary, twice binary").groupBy("shard").applyInArrow(often, "print long"), "prints")
    few = printed.count() <= BROADCAST_PRINTS
    shared_prints = spark.sparkContext.broadcast(np.sort(printed.toArrow()["print"].to_numpy().astype(np.uint64)) if few else None)

    def page_runs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known = WordHash(), shared_prints.value
        for batch in batches(it, 500):
            found = [blocks(t) for t in batch.column("html").to_pylist()]
            page, runs = runs_of_pages([outside(f) for f in found], run, words)
            if known is not None:
                p = prints_of(host_hashes(batch.column("host").to_pylist())[page], runs)
                may = known[np.minimum(np.searchsorted(known, p), len(known) - 1)] == p if len(known) else np.zeros(len(p), dtype=bool)
                page, runs = page[may], runs[may]
            content = np.array([content_of(f) for f in found], dtype=np.uint64).view(np.int64)
            place = pa.array(page, pa.int64())
            yield pa.record_batch({"host": batch.column("host").take(place), "part": batch.column("part").take(place), "content": pa.array(content[page], pa.int64()), "run": pa.array(runs.view(np.int64), pa.int64())})

    # first by block, so that a run on all pages of a host meets in no task; then over the blocks
    by_block = large.select("host", "part", "html").mapInArrow(page_runs, "host string, part long, content long, run long")
    by_block = table(by_block.groupBy("host", "run", "part").agg(F.min("content").alias("low"), F.max("content").alias("high")), "runs")
    twice = by_block.groupBy("host", "run").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("host", "run")
    shared = by_block.join(twice, ["host", "run"], "left_semi").select("host", "part", "run")

    def remove(group: pa.Table, given: pa.Table) -> pa.Table:
        rows = [_unpack(b) for b in group["blocks"].to_pylist()]
        same: dict[int, int] = {}
        number: dict[str, int] = {}
        place = [same.setdefault(content_of(row), len(same)) for row in rows]
        first = np.unique(place, return_index=True)[1].tolist()
        pieces = [outside(rows[i]) for i in first]
        tokens = [piece for page in pieces for piece in page]
        owners = [i for i, page in enumerate(pieces) for _ in page]
        streams = [np.fromiter((number.setdefault(t, len(number)) for t in found), dtype=np.int64, count=len(found)) for found in tokens]
        known = given["run"].to_numpy().view(np.uint64) if given.num_rows else None
        seen_words = WordHash()
        hashes = [run_hashes(found, run, seen_words) for found in tokens] if known is not None else None
        covered: list[np.ndarray] = [np.zeros(0, dtype=bool)] * len(pieces)
        for i, hit in zip(owners, repeated(streams, run, known, hashes, owners), strict=True):
            covered[i] = np.concatenate([covered[i], hit])
        out, counts = [], []
        for row, k in zip(rows, place, strict=True):
            kept, at, n_tokens, checked = [], 0, 0, 0
            for kind, text in row:
                found = text.split()
                n_tokens += len(found)
                if kind == ARTICLE:
                    kept.append(text)
                    continue
                left = [t for t, c in zip(found, covered[k][at : at + len(found)], strict=True) if not c]
                at += len(found)
                if kind == UNKNOWN:
                    kept += left
                else:
                    checked += len(left)
            out.append(" ".join(kept))
            counts.append((n_tokens, int(covered[k].sum()), checked))
        return pa.table(
            {"page_id": group["page_id"], "url": group["url"], "text": pa.array(out, pa.string()), "n_chars": pa.array([len(t) for t in out], pa.int64())}
            | {c: pa.array([n[i] for n in counts], pa.int64()) for i, c in enumerate(("n_tokens", "n_repeated", "n_checked"))}
        )

    return parsed.groupBy("host", "part").cogroup(shared.groupBy("host", "part")).applyInArrow(remove, f"page_id {kind}, url string, text string, n_chars long, n_tokens long, n_repeated long, n_checked long")


def op5_html_text(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
