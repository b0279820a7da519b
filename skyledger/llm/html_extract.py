"""HTML extraction with host suffix arrays.

A page is cut into text blocks, each with a zone: what the mark-up itself declares to be the article
(``article``, ``main``), what it declares to be something else (navigation, adverts, forms, comments
and the like, which is dropped), and the rest. The rest is decided by repetition: the token streams of
pages of one host are concatenated, their suffixes sorted, runs of tokens that recur on distinct pages
are boilerplate, and blocks that such runs cover whole go; a block with a unique run stays. Text that the mark-up
declares to be the article stays even where it recurs: copies and shared passages are content. Pages of equal
content count once. A host too large for one task is cut into blocks; its runs are counted by their hashes over
all of them, so that what recurs is the same as if one task held the host.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from html import unescape

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm.base import map_batches, query, stored, table
from skyledger.llm.decontamination import in_filter

#: A run is long from so many tokens on, and boilerplate from so many distinct pages on.
RUN_TOKENS, RUN_PAGES = 8, 3
#: Characters of HTML that make up a block of pages of one host.
BLOCK_CHARS = 1_000_000
#: Remembered token hashes of a task, and rows that it hands on at a time.
REMEMBERED, HANDED = 300_000, 100_000
#: Pages of a cut host that are decided at a time.
HELD_PAGES = 256
#: Bits of the filter for runs of undeclared blocks; more such runs only let more of the others through.
FILTER_BITS = 1 << 22
#: Up to so many hosts' block numbers are sent to all tasks; more are joined by a shuffle.
SMALL_HOSTS = 100_000

# Elements of the HTML standard by their role here.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object".split())
DROPPED = frozenset("head nav footer aside button select dialog menu label fieldset".split())
MAIN = frozenset(("article", "main"))
MAIN_ALONE = frozenset(("main",))
# Words of a class, id or role that name something other than the article.
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted promotion related replies reply search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
HEADS = frozenset(("header", "masthead"))
COMMENTS = frozenset("comment comments disqus replies reply".split())
# Last words of names that don't say what the element is, words that make a name a remark, first words of taxonomies.
GENERIC = frozenset(
    "area articles bar block board body bottom box button buttons card center col column container content cta desktop disclaimer feed fixed footer form foot group head header heading holder icon icons image info inline inner item items label large law layer layout left level line link links list main media message mobile now outer overlay panel placeholder posts pane primary prompt region respond right row secondary section shell slot small stack sticky stories strip text this thread title toggle tools top trail unit wrap wrapper zone".split()
)
QUALIFIERS = frozenset("has is no not with without".split())
TAXONOMY = frozenset("category format tag".split())
ANCHORED = frozenset("section h1 h2 h3 h4 h5 h6".split())
HIDDEN = frozenset(("hidden", "is-hidden", "visually-hidden"))
# Elements that "/>" ends; for other raw elements it does where no end tag is theirs.
FOREIGN = frozenset(("svg", "math"))
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*+>", re.DOTALL)
NAMES = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
ATTRIBUTE = re.compile(r"([^\s\"'=/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?")
TOKEN = re.compile(r"\S+")


def named_noise(name: str, words: frozenset[str]) -> bool:
    """Whether a class, id or role as a whole names one of ``words``.

    A name says what it is by its last word, generic words, numbers and BEM modifiers aside ("cookie-banner",
    "comment-list", "ad-slot-2"). One that says what the element has, lacks or is filed under ("no-sidebar",
    "content-with-comments", "tag-search") names nothing.
    """
    parts = [w for w in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name.split("--")[0]).lower()) if w]
    if not parts or parts[0] in TAXONOMY and len(parts) > 1 or not QUALIFIERS.isdisjoint(parts):
        return False
    while len(parts) > 1 and parts[-1] not in words and (parts[-1] in GENERIC or parts[-1][-1].isdigit()):
        parts.pop()
    return parts[-1] in words


@lru_cache(maxsize=4096)
def noisy(attributes: str, in_main: bool, tag: str = "div") -> bool:
    """Whether class, id or role name something other than the article.

    Inside of the article the id of a section or heading is an anchor, which says so for comments alone.
    """
    for kind, *values in NAMES.findall(attributes):
        anchor = in_main and tag in ANCHORED and kind.lower() == "id"
        words = COMMENTS if anchor else NOISE if in_main else NOISE | HEADS
        if any(named_noise(name, words) for name in "".join(values).split()):
            return True
    return False


def gone(attributes: str) -> bool:
    return "hidden" in attributes.lower() and hidden(attributes)


@lru_cache(maxsize=4096)
def hidden(attributes: str) -> bool:
    """Whether the attribute ``hidden``, ``aria-hidden`` or a whole class name hides the element."""
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or (name == "aria-hidden" and value.strip() == "true") or (name == "class" and not HIDDEN.isdisjoint(value.split())):
            return True
    return False


def blocks(html: str) -> list[tuple[str, bool]]:
    """Text blocks in page order, each with whether the mark-up declares it to be the article.

    Blocks of dropped zones are left out. Unclosed elements end with what holds them; an end tag
    without a start is ignored; a mark without an end is text. A name never drops ``main``, and what holds
    it is a layout; the same goes for ``article`` where the page would have no declared text otherwise.
    """
    found, nested = cut_blocks(html, MAIN_ALONE)
    if nested and not any(declared for _, declared in found):
        again, _ = cut_blocks(html, MAIN)
        if any(declared for _, declared in again):
            return again
    return found


def cut_blocks(html: str, freeing: frozenset[str]) -> tuple[list[tuple[str, bool]], bool]:
    """Blocks where elements in ``freeing`` end what names have dropped, and whether names dropped an article."""
    out: list[tuple[str, bool]] = []
    parts: list[str] = []
    open_: list[tuple[str, bool, int]] = []  # tag, in the article, dropped (1: by a name, 2: for good)
    main, dropped, nested = False, 0, False

    def flush():
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((text, main))
            parts.clear()

    edge, raw_end = 0, -1
    for mark in MARKUP.finditer(html):
        if mark.start() < raw_end:
            continue
        if not dropped and mark.start() > max(edge, raw_end):
            text = html[max(edge, raw_end) : mark.start()]
            parts.append(unescape(text) if "&" in text else text)
        edge = mark.end()
        if not mark[2]:
            continue
        tag = mark[2].lower()
        if tag in RAW and not mark[1]:  # unseen, so it parts no block
            if mark[3].endswith("/"):
                ahead = None if tag in FOREIGN else re.compile(rf"<(/?){tag}\b", re.IGNORECASE).search(html, mark.end())
                if not ahead or not ahead[1]:
                    continue
            end = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(html, mark.end())
            raw_end = end.end() if end else len(html)
            continue
        if tag in INLINE:
            if tag == "br" and not dropped:
                parts.append(" ")
            if tag in VOID or (not mark[1] and not (mark[3] and (noisy(mark[3], main, tag) or gone(mark[3])))) or (mark[1] and not any(o[0] == tag for o in open_)):
                continue
        if not dropped:
            flush()
        if mark[1]:
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] == tag:
                    del open_[i:]
                    main, dropped = open_[-1][1:] if open_ else (False, 0)
                    break
            continue
        if tag in VOID or mark[3].endswith("/"):
            continue
        if open_ and open_[-1][0] == "p" and tag not in INLINE:  # a block ends a paragraph
            open_.pop()
            main, dropped = open_[-1][1:] if open_ else (False, 0)
        own = 'role="main"' in mark[3] or tag in MAIN
        free = tag in freeing or 'role="main"' in mark[3]
        by_name = not free and (tag == "form" or (bool(mark[3]) and tag not in ("html", "body") and noisy(mark[3], main, tag)))
        for_good = tag in DROPPED or (tag == "header" and not main) or (bool(mark[3]) and tag not in ("html", "body") and gone(mark[3]))
        if tag == "body":
            open_, main, dropped = [], False, 0
        nested = nested or (tag == "article" and (by_name or dropped == 1))
        open_.append((tag, main or own, max(0 if free and dropped == 1 else dropped, 2 * for_good, by_name)))
        main, dropped = open_[-1][1:]
    if not dropped and max(edge, raw_end) < len(html):
        text = html[max(edge, raw_end) :]
        parts.append(unescape(text) if "&" in text else text)
    flush()
    return out, nested


def repeated_tokens(pages: list[list[str]], run: int = RUN_TOKENS, least: int = RUN_PAGES) -> list[np.ndarray]:
    """For each page's token stream, which tokens lie in a run that recurs on ``least`` distinct pages.

    Suffixes of the concatenated streams are ranked by prefix doubling until the ranks tell prefixes of
    ``run`` tokens apart; equal ranks are one run. A page end is a token that no other page has.
    """
    ids: dict[str, int] = {}
    stream: list[int] = []
    owner = np.repeat(np.arange(len(pages)), [len(p) + 1 for p in pages])
    for i, page in enumerate(pages):
        stream += [ids.setdefault(t, len(ids)) for t in page]
        stream.append(-1 - i)
    rank = np.unique(np.array(stream, dtype=np.int64), return_inverse=True)[1].astype(np.int64)
    n, known = len(rank), 1
    while known < run:
        step = min(known, run - known)
        ahead = np.concatenate((rank[step:], -1 - np.arange(min(step, n))))[:n]
        rank = np.unique(rank * (2 * n + 1) + ahead + n, return_inverse=True)[1].astype(np.int64)
        known += step
    order = np.lexsort((owner, rank))  # the suffix array, by the first ``run`` tokens, then by page
    new_rank = np.concatenate(([True], rank[order][1:] != rank[order][:-1]))
    new_page = new_rank | np.concatenate(([True], owner[order][1:] != owner[order][:-1]))
    group = np.cumsum(new_rank) - 1
    common = np.bincount(group, weights=new_page)[group] >= least
    starts = np.zeros(n + 1, dtype=np.int64)
    at = order[common]
    np.add.at(starts, at, 1)
    np.add.at(starts, np.minimum(at + run, n), -1)
    covered = np.cumsum(starts[:n]) > 0
    ends = np.cumsum([len(p) + 1 for p in pages])
    return [covered[e - len(p) - 1 : e - 1] for e, p in zip(ends, pages, strict=True)]


def content_of(page: list[tuple[str, bool]]) -> int:
    """What pages of equal token streams share."""
    return int.from_bytes(blake2b(" ".join(text for text, _ in page).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


class TokenHashes(dict):
    """64-bit hashes of tokens, remembered by token."""

    def __missing__(self, token: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[token] = out = int.from_bytes(blake2b(token.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")
        return out


def run_keys(tokens: list[str], host: int, hashes: TokenHashes, run: int = RUN_TOKENS) -> np.ndarray:
    """The 64-bit key of the run of tokens from each place, with the host in it."""
    n = len(tokens) - run + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    own = np.fromiter(map(hashes.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    key = np.full(n, host, dtype=np.uint64)
    for i in range(run):
        key = key * np.uint64(0x9E3779B97F4A7C15) + own[i : i + n]
    key ^= key >> np.uint64(31)
    key *= np.uint64(0xBF58476D1CE4E5B9)
    return (key ^ (key >> np.uint64(29))).view(np.int64)


def covered_tokens(keys: np.ndarray, n: int, common: np.ndarray, run: int = RUN_TOKENS) -> np.ndarray:
    """Which of a page's ``n`` tokens lie in a run whose key is among ``common``."""
    starts = np.zeros(n + 1, dtype=np.int64)
    at = np.nonzero(np.isin(keys, common))[0]
    starts[at] += 1
    starts[at + run] -= 1
    return np.cumsum(starts[:n]) > 0


def main_texts(found: list[list[tuple[str, bool]]], host: str = "", common: np.ndarray | None = None) -> Iterator[tuple[str, int, int]]:
    """The main text, its repeated tokens and the blocks removed as boilerplate, for pages of one host.

    The pages are the whole host, or ``common`` has the keys of the runs that recur on it.
    """
    tokens = [[TOKEN.findall(text) for text, _ in page] for page in found]
    streams = [[t for block in page for t in block] for page in tokens]
    if common is None:
        places: dict[tuple[str, ...], int] = {}
        at_ = [places.setdefault(tuple(stream), len(places)) for stream in streams]  # copies count once
        distinct = repeated_tokens([list(p) for p in places])
        covered = [distinct[i] for i in at_]
    else:
        hashes = TokenHashes()
        covered = [covered_tokens(run_keys(stream, hashes[host], hashes), len(stream), common) for stream in streams]
    for page, page_tokens, mask in zip(found, tokens, covered, strict=True):
        kept, repeated, removed, at = [], 0, 0, 0
        for (text, declared), block in zip(page, page_tokens, strict=True):
            own = mask[at : at + len(block)]
            at += len(block)
            if not declared and own.all():
                removed += 1
                continue
            kept.append(text)
            if not declared:
                repeated += int(own.sum())
        yield "\n".join(kept), repeated, removed


def extract(pages: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per page: ``page_id``, ``url``, ``text``, ``n_chars``, ``n_repeated`` (kept tokens of
    undeclared blocks that recur on the host) and ``n_removed`` (blocks that went as boilerplate).

    Null and empty html gives an empty text. A null or odd url is the host of the empty name. Repeated
    rows have a row each. Other columns of ``pages`` are left behind. Pages are cut before they are dealt,
    so what is shuffled is their packed text blocks. A host of more than ``block_chars`` is dealt into blocks
    by the hash of the content; each block counts its runs, the counts are summed over the host, and the keys
    of the runs that recur go back to the blocks that hold them. Only runs that touch an undeclared block
    decide anything, so a fixed-size filter of these keeps the others out of the counts.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    own = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))
    sizes = stored(own.groupBy("host").agg(F.ceil(F.sum(F.length("html")) / block_chars).alias("parts")), "hosts")
    state = sizes.agg(F.count("*").alias("n"), F.max("parts").alias("most")).first()
    if state["n"] <= SMALL_HOSTS:
        sizes = F.broadcast(sizes)

    def cut(batches):
        for batch in batches:
            found = [blocks(html) for html in batch.pop("html")]
            batch["content"] = [content_of(page) for page in found]
            batch["packed"] = [zlib.compress(json.dumps(page, ensure_ascii=False).encode("utf-8", "surrogatepass"), 6) for page in found]
            yield batch

    packed = map_batches(own, cut, "page_id long, url string, host string, content long, packed binary")
    part = F.pmod("content", F.greatest("parts", F.lit(1)))
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wide = (state["most"] or 0) > 1  # then pages are cut twice: a stored copy would be more disk than that is time
    named = packed.join(sizes, "host").withColumns({"part": part, "wide": F.col("parts") > 1}).drop("parts")
    named = named.withColumns({"block": F.xxhash64("host", "part"), "keys": F.lit(None).cast("array<bigint>")})
    if wide:
        named = named.unionByName(common_runs(named.where("wide"), n), allowMissingColumns=True)
    # a block's keys come first
    dealt = named.repartition(n, "block").sortWithinPartitions("block", F.col("keys").isNull(), "host", "part", "content", "page_id", "url")

    def run(batches):
        held: list[tuple] = []
        at = common_at = None
        common = none = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for row in zip(*(batch[c] for c in ("page_id", "url", "packed", "content", "block", "host", "part", "wide", "keys")), strict=True):
                if row[4:8] != at and held:
                    yield done(held, at, common if common_at == at[0] else none)
                    held = []
                elif len(held) >= HELD_PAGES and at[3]:  # a block's keys are known, so its pages need not meet
                    yield done(held, at, common if common_at == at[0] else none)
                    held = []
                at = row[4:8]
                if row[8] is not None:
                    common, common_at, at = np.array(row[8], dtype=np.int64), row[4], None
                else:
                    held.append(row[:4])
        if held:
            yield done(held, at, common if common_at == at[0] else none)

    def done(rows, at, common):
        found = list(main_texts([unpacked(r[2]) for r in rows], at[1], common if at[3] else None))
        return {"page_id": [r[0] for r in rows], "url": [r[1] for r in rows], "text": [f[0] for f in found], "n_chars": [len(f[0]) for f in found], "n_repeated": [f[1] for f in found], "n_removed": [f[2] for f in found]}

    rows = dealt.select("page_id", "url", "packed", "content", "block", "host", "part", "wide", "keys")
    return map_batches(rows, run, "page_id long, url string, text string, n_chars long, n_repeated long, n_removed long")


def unpacked(packed: bytes) -> list[tuple[str, bool]]:
    return json.loads(zlib.decompress(packed).decode("utf-8", "surrogatepass"))


def undeclared_keys(page: list[tuple[str, bool]], host: int, hashes: TokenHashes, run: int = RUN_TOKENS) -> np.ndarray:
    """The keys of the runs that touch an undeclared block of a page."""
    tokens = [TOKEN.findall(text) for text, _ in page]
    n = sum(map(len, tokens)) - run + 1
    if n <= 0 or all(declared for _, declared in page):
        return np.zeros(0, dtype=np.int64)
    wanted, at = np.zeros(n, dtype=bool), 0
    for (_, declared), block in zip(page, tokens, strict=True):
        if not declared:
            wanted[max(0, at - run + 1) : at + len(block)] = True
        at += len(block)
    return run_keys([t for block in tokens for t in block], host, hashes)[wanted]


def run_filter(named: DataFrame, bits: int = FILTER_BITS) -> tuple[DataFrame, bytes]:
    """Hosts with runs that touch an undeclared block, and a bit for each such run."""

    def mark(batches):
        hashes = TokenHashes()
        for batch in batches:
            for host, packed in zip(batch["host"], batch["packed"], strict=True):
                slots = np.unique(undeclared_keys(unpacked(packed), hashes[host], hashes) % bits)
                if len(slots):
                    yield {"host": [host] * len(slots), "byte": slots >> 3, "mask": 1 << (slots & 7)}

    marks = map_batches(named.select("host", "packed"), mark, "host string, byte long, mask long")
    # at most bits / 8 rows a host, whatever its size
    own = stored(marks.groupBy("host", "byte").agg(F.bit_or("mask").alias("mask")), "run-filter")
    rows = own.groupBy("byte").agg(F.bit_or("mask").alias("mask")).toPandas()  # at most bits / 8 rows
    out = np.zeros(bits // 8, dtype=np.uint8)
    out[rows["byte"].to_numpy(dtype=int)] = rows["mask"].to_numpy(dtype=int)
    return own.select("host").distinct(), out.tobytes()


def common_runs(named: DataFrame, n: int) -> DataFrame:
    """``block`` and ``keys``: for each block the keys of its runs that recur on the whole host, of those
    that may touch an undeclared block on one of its pages.

    All copies of a content are in one block, so the blocks' numbers of distinct contents add up. A block has
    one row for each of its runs.
    """
    hosts, bits = run_filter(named)
    sent = named.sparkSession.sparkContext.broadcast(bits)

    def count(batches):
        hashes, held = TokenHashes(), []
        wanted = np.frombuffer(sent.value, dtype=np.uint8)
        at = last = None

        def counted():
            keys, c = np.unique(np.concatenate(held), return_counts=True)
            for i in range(0, len(keys), HANDED):
                yield {"key": keys[i : i + HANDED], "block": np.full(len(keys[i : i + HANDED]), at[0]), "c": c[i : i + HANDED]}

        for batch in batches:
            for block, host, part, content, packed in zip(*(batch[c] for c in ("block", "host", "part", "content", "packed")), strict=True):
                if (block, host, part) != at:
                    if held:
                        yield from counted()
                    held, at, last = [], (block, host, part), None
                if content != last:
                    keys = run_keys([t for text, _ in unpacked(packed) for t in TOKEN.findall(text)], hashes[host], hashes)
                    held.append(np.unique(keys[in_filter(wanted, keys)]))
                    last = content
        if held:
            yield from counted()

    dealt = named.join(hosts, "host", "left_semi").select("block", "host", "part", "content", "packed").repartition(n, "block").sortWithinPartitions("block", "host", "part", "content")
    counts = map_batches(dealt, count, "key long, block long, c long")
    common = counts.withColumn("n", F.sum("c").over(Window.partitionBy("key"))).where(F.col("n") >= RUN_PAGES)
    return common.groupBy("block").agg(F.collect_list("key").alias("keys"))


@query("op4_html_extract")
def op4(spark, sf_dir):
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
