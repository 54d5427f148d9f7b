"""Main text of web pages: page zones, and a suffix array over the pages of a host.

Markup sorts a page's text blocks into three zones: main (an article), boilerplate (menus, headers,
footers, sidebars, notices, adverts, forms, reader comments) and open (everything else). Where a page
has an article, that is its text. Where it has none, its open blocks are judged by the host: the
token streams of the host's pages, without their articles, are concatenated, a suffix array finds
substrings of at least ``min_tokens`` tokens that stand on several different pages, the tokens they
cover are removed, and unique runs stay.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobmeter.llm import words
from jobmeter.llm.tables import batch, bounded_batches, col, tidy
from jobmeter.operators.lookups import small_side
from jobmeter.session import materialize

MIN_TOKENS = 8
MIN_PAGES = 3
PAGES_PER_PART = 512
MAIN, OPEN, BOILERPLATE, PROSE, LINKS = 0, 1, 2, 3, 4

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(script|style|noscript|template|svg|iframe|textarea|select|object|canvas|video|audio|math|title)"
    r"\b[^>]*>(?:.*?</\1\s*>|.*\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)",
    re.I | re.S,
)
_ATTRIBUTE = re.compile(r"([a-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

_BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset"
    " figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol"
    " optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_BOILERPLATE_TAGS = frozenset("aside button dialog fieldset footer form head header label menu nav".split())
_BOILERPLATE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs byline comment comments"
    " commentlist consent cookie cookies copyright disclaimer disqus footer gdpr header login masthead menu modal"
    " nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promotion"
    " recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored"
    " subscribe subscription tags toolbar widget widgets".split()
)
_BOILERPLATE_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split()
)
_MAIN_NAMES = (
    {"article", "body"}, {"article", "content"}, {"article", "text"}, {"entry", "content"},
    {"post", "body"}, {"post", "content"}, {"post", "text"}, {"story", "body"},
)
#: Elements that hold running text; other open blocks are bare text between elements.
_PROSE_TAGS = frozenset("blockquote dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre td th".split())
_HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})
_MODIFIERS = frozenset({"has", "no", "with", "without"})  # "content with-sidebar" is no sidebar
# Elements that end where the next of their kind begins; a paragraph ends at any block.
_UNCLOSED = frozenset("dd dt li option p td th tr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


def _zone(tag: str, attributes: str, inside: str) -> str | None:
    """The zone that an element opens: boilerplate, article, main, headline, or None for no change."""
    names: set[str] = set()
    role = ""
    for name, *values, bare in _ATTRIBUTE.findall(attributes) if attributes else ():
        value = "".join(values)
        if bare:
            return "boilerplate"
        match name.lower():
            case "class" | "id":
                names |= {w.lower() for w in _WORDS.findall(value)}
            case "role":
                role = value.lower()
            case "aria-hidden":
                role = "dialog" if value.lower() == "true" else role
            case "style":
                hidden = re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)
                role = "dialog" if hidden else role
            case "itemprop":
                names |= {"article", "body"} if value.lower() == "articlebody" else set()
    if tag in ("html", "body"):
        return None
    comment = bool(names & {"comment", "comments", "commentlist", "reply", "replies"})
    if tag == "header" and inside in ("article", "main"):
        return "headline"
    if tag in _BOILERPLATE_TAGS or role in _BOILERPLATE_ROLES or comment:
        return "boilerplate"
    if tag == "article" or any(pair <= names for pair in _MAIN_NAMES):
        return "article"
    if tag == "main" or role == "main":
        return "main"
    if names & _BOILERPLATE_NAMES and not names & _MODIFIERS:
        headline = inside in ("article", "main") and not names & _BOILERPLATE_NAMES - {"header", "byline"}
        return "headline" if headline else "boilerplate"
    return None


def page_blocks(page: str) -> list[tuple[int, str]]:
    """(zone, text) of a page's blocks in order; zones are MAIN, BOILERPLATE and three kinds of open ones.

    If the page has article elements with text, these are the main zone, else its main element. Open
    blocks are LINKS if most of their letters are in links, PROSE if an element of running text
    holds them, else OPEN.
    Tags that are not closed end with the element around them; boilerplate inside a line of text is
    left out of it.
    """
    blocks: list[tuple[str, str, int]] = []
    stack: list[tuple[str, str]] = []
    zone, heading = "", ""
    linked, letters_ = False, [0, 0]  # inside a link; letters outside and inside links
    held: list[str] = []
    at = 0
    muted, depth = "", 0  # an inline element that is boilerplate, inside a block that goes on

    def flush() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            kind = PROSE if stack and stack[-1][0] in _PROSE_TAGS else OPEN
            kind = LINKS if letters_[1] > letters_[0] else kind
            blocks.append(("boilerplate" if zone == "headline" and not heading else zone, text, kind))
        letters_[:] = 0, 0

    def add(text: str) -> None:
        held.append(entities.unescape(text))
        letters_[linked] += len(text.strip())

    for m in _MARKUP.finditer(page):
        if m.start() > at and not muted:
            add(page[at : m.start()])
        at = m.end()
        tag = m[3].lower() if m[3] else ""
        if not tag:
            continue
        if tag == "br":
            held.append(" ")
        if tag in _VOID and tag != "hr":
            continue
        if tag not in _BLOCKS:
            if tag == "a":
                linked = not m[2]
            if muted:
                depth += (-1 if m[2] else 1) * (tag == muted)
                muted = muted if depth else ""
            elif m[4] and not m[2] and _zone(tag, m[4], zone) == "boilerplate":
                muted, depth = tag, 1
            continue
        muted, depth = "", 0
        flush()
        if stack and stack[-1][0] in _UNCLOSED and not m[2] and stack[-1][0] in ("p", tag):
            stack.pop()
        if m[2]:
            if any(t == tag for t, _ in stack):
                while stack.pop()[0] != tag:
                    pass
        else:
            opened = _zone(tag, m[4], zone)
            inner = stack[-1][1] if stack else ""
            if tag in ("body", "article", "main") and inner == "boilerplate":
                while stack and stack[-1][0] in ("head", "title"):
                    stack.pop()  # a head that was never closed
                inner = stack[-1][1] if stack else ""
            if inner == "boilerplate":
                opened = inner
            elif opened == "main" and inner == "article":
                opened = inner
            if tag != "hr":
                stack.append((tag, opened or inner))
        zone = stack[-1][1] if stack else ""
        heading = next((t for t, _ in reversed(stack) if t in _HEADINGS), "")
    if at < len(page) and not muted:
        add(page[at:])
    flush()
    zones = {z for z, _, _ in blocks}
    main = {"article", "headline"} if "article" in zones else {"main", "headline"} if "main" in zones else set()
    return [(MAIN if z in main else BOILERPLATE if z == "boilerplate" else kind, t) for z, t, kind in blocks]


def repeated_tokens(tokens: np.ndarray, page: np.ndarray, min_tokens: int, min_pages: int) -> np.ndarray:
    """Which tokens lie in a substring of at least ``min_tokens`` found on ``min_pages`` pages.

    ``tokens`` concatenates the streams of all pages, with a negative token of its own after each, so
    that no substring reaches into the next page; ``page`` numbers the page of each token. The suffix
    array is built by prefix doubling and stops at the depth of the shortest substring of interest:
    suffixes of equal rank then share that prefix, and longer repeats are runs of such positions.
    """
    n = len(tokens)
    covered = np.zeros(n, bool)
    if n < min_tokens:
        return covered
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    depth = 1
    while depth < min_tokens:
        step = min(depth, min_tokens - depth)
        pair = np.full(n, -1, np.int64)
        pair[: n - step] = rank[step:]
        rank = np.unique(rank * (n + 1) + pair + 1, return_inverse=True)[1].astype(np.int64)
        depth += step
    stops = np.r_[0, np.cumsum(tokens < 0)]
    at = np.flatnonzero(stops[min_tokens:] == stops[:-min_tokens])
    order = at[np.lexsort((page[at], rank[at]))]
    r, p = rank[order], page[order]
    new = np.r_[True, (r[1:] != r[:-1]) | (p[1:] != p[:-1])] if len(order) else np.zeros(0, bool)
    pages = np.bincount(r[new], minlength=int(rank.max()) + 1)
    starts = order[pages[r] >= min_pages]
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + min_tokens, -1)
    return np.cumsum(change[:-1]) > 0


def page_content(blocks: list[tuple[int, str]]) -> str:
    """What copies of a page agree in: the set of its main and open blocks, without any all its blocks.

    A single block would not do: the longest may be the one that the host repeats. Nor would blocks
    that are boilerplate by their markup: pages of a host agree in them and are no copies for that.
    """
    own = {text for zone, text in blocks if zone != BOILERPLATE}
    return "\n".join(sorted(own) if own else [text for _, text in blocks])


def open_text(blocks: list[tuple[int, list[str], np.ndarray]]) -> list[str]:
    """The texts of a page's open blocks (zone, tokens, which of them the host repeats) without boilerplate.

    The host decides, the kind of a block has a vote. Neighbouring blocks of prose are one passage: it
    stays whole if any of its blocks is mostly the page's own (what else repeats in it is shared by
    articles), and goes if the host repeats all of it. Where passages are left and hold most of the
    page's own words, bare text and links before the first and after the last of them are no part of
    the text. Elsewhere each block keeps its unique runs, and what lies between two blocks that are
    mostly the page's own stays whole, as boilerplate stands around a text and not within. If the host
    repeats every block of prose and nothing is the page's own, the longest passage is the text: a copy.
    """
    own = [2 * int(covered.sum()) < len(covered) for _, _, covered in blocks]
    passages: list[list[int]] = []
    for i, (zone, _, _) in enumerate(blocks):
        if zone == PROSE:
            if passages and passages[-1][-1] == i - 1:
                passages[-1].append(i)
            else:
                passages.append([i])
    size = lambda indices: sum(len(blocks[i][1]) for i in indices)
    left = [g for g in passages if any(own[i] for i in g)]
    if not left and passages and not any(own):
        left = [max(passages, key=size)]
    bare = [i for i, (zone, _, _) in enumerate(blocks) if zone == OPEN and own[i]]
    if left and size(bare) <= sum(map(size, left)):
        first, last = left[0][0], left[-1][-1]
        inside = {i for g in left for i in g} | {i for i in range(first, last) if own[i]}
        return [" ".join(blocks[i][1]) for i in sorted(inside)]
    mostly = [i for i, mine in enumerate(own) if mine and blocks[i][0] != LINKS]
    first, last = (mostly[0], mostly[-1]) if mostly else (len(blocks), -1)
    return [
        " ".join(tokens if first < i < last else [w for w, c in zip(tokens, covered) if not c])
        for i, (_, tokens, covered) in enumerate(blocks)
    ]


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _windows(texts: list[str], min_tokens: int, known: dict[str, int]) -> np.ndarray:
    """Hashes of all runs of ``min_tokens`` tokens of a page's blocks; ``known`` holds those of words."""
    tokens = [w for text in texts for w in text.split()]
    for w in set(tokens) - known.keys():
        known[w] = _digest(w)
    values = np.array([known[w] for w in tokens], np.int64).view(np.uint64)
    total = np.zeros(max(0, len(values) - min_tokens + 1), np.uint64)
    for k in range(min_tokens):
        total = total * np.uint64(0x9E3779B97F4A7C55) + words.mix(values[k : k + len(total)])
    return words.mix(total).view(np.int64)


def host_texts(
    pages: list[list[tuple[int, str]]], min_tokens: int, min_pages: int, repeats: np.ndarray | None = None
) -> list[tuple[str, int]]:
    """(main text, tokens found repeated) of the pages of one host.

    Where these are a part of the host's pages, ``repeats`` holds the hashes of the runs that the
    whole host repeats.
    """
    numbers: dict[str, int] = {}
    contents: dict[str, int] = {}
    tokens, page, bounds = [], [], []
    for blocks in pages:
        outside = [text for zone, text in blocks if zone != MAIN]
        content = contents.setdefault(page_content(blocks), len(contents))
        first = len(tokens)
        for text in outside:
            for word in text.split():
                tokens.append(numbers.setdefault(word, len(numbers)))
        page += [content] * (len(tokens) - first)
        bounds.append(first)
    covered = _covered(np.array(tokens, np.int64), np.array(page, np.int64), np.array(bounds, np.int64), min_tokens, min_pages)
    if repeats is not None and len(repeats):
        known: dict[str, int] = {}
        for blocks, first in zip(pages, bounds):
            found = _windows([text for zone, text in blocks if zone != MAIN], min_tokens, known)
            for at in np.flatnonzero(np.isin(found, repeats)):
                covered[first + at : first + at + min_tokens] = True
    out = []
    for blocks, first in zip(pages, bounds):
        main = [text for zone, text in blocks if zone == MAIN]
        at, open_, repeated = first, [], 0
        for zone, text in blocks:
            if zone == MAIN:
                continue
            parts = text.split()
            here = covered[at : at + len(parts)]
            at += len(parts)
            repeated += int(here.sum())
            if zone != BOILERPLATE:
                open_.append((zone, parts, here))
        out.append(("\n".join(main or [t for t in open_text(open_) if t]), repeated))
    return out


def _covered(tokens: np.ndarray, content: np.ndarray, bounds: np.ndarray, min_tokens: int, min_pages: int) -> np.ndarray:
    """``repeated_tokens`` where pages of equal content count once and streams end at ``bounds``."""
    if not len(tokens):
        return np.zeros(0, bool)
    ends = np.zeros(len(tokens), np.int64)
    np.add.at(ends, bounds[bounds < len(tokens)], 1)
    number = np.cumsum(ends)
    gaps = np.flatnonzero(np.r_[False, number[1:] != number[:-1]])
    stops = -1 - np.arange(len(gaps))
    padded = np.insert(tokens, gaps, stops)
    pages = np.insert(content, gaps, content[gaps - 1])
    return np.delete(repeated_tokens(padded, pages, min_tokens, min_pages), gaps + np.arange(len(gaps)))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"zones": pa.list_(pa.int32()), "texts": pa.list_(pa.string()), "content": pa.int64()}
    for given in batches:
        for first in range(0, given.num_rows, 256):
            part = given.slice(first, 256)
            blocks = [page_blocks(page.as_py() or "") for page in part["html"]]
            columns = {"zones": [[z for z, _ in b] for b in blocks], "texts": [[t for _, t in b] for b in blocks]}
            out = batch(columns | {"content": [_digest(page_content(b)) for b in blocks]}, kinds)
            rest = [c for c in part.schema.names if c != "html"]
            yield pa.RecordBatch.from_arrays(
                [*out.columns, *[part[c] for c in rest]],
                schema=pa.schema([*out.schema, *[part.schema.field(c) for c in rest]]),
            )


def _judge(min_tokens: int, min_pages: int, repeats: np.ndarray | None = None):
    def run(given: pa.Table) -> pa.Table:
        pages = [list(zip(z, t)) for z, t in zip(given["zones"].to_pylist(), given["texts"].to_pylist())]
        found = host_texts(pages, min_tokens, min_pages, repeats)
        kinds = {"text": pa.string(), "n_repeated": pa.int64()}
        out = batch({"text": [t for t, _ in found], "n_repeated": [n for _, n in found]}, kinds)
        return pa.Table.from_batches([out]).append_column(given.schema.field("row"), given["row"])

    return run


def _part_windows(min_tokens: int, min_pages: int):
    """(host, part, window, content): every run of a part with up to ``min_pages`` pages of different content."""

    def run(key: tuple, given: pa.Table) -> pa.Table:
        known: dict[str, int] = {}
        held: dict[int, list[np.ndarray]] = {}
        for texts, content in zip(given["texts"].to_pylist(), given["content"].to_pylist()):
            held.setdefault(content, []).append(np.unique(_windows(texts, min_tokens, known)))
        each = {content: np.unique(np.concatenate(x)) for content, x in held.items()}
        window = np.concatenate([np.zeros(0, np.int64), *each.values()])
        content = np.repeat(np.fromiter(each, np.int64, len(each)), [len(x) for x in each.values()])
        order = np.lexsort((content, window))
        window, content = window[order], content[order]
        few = np.ones(len(window), bool)
        few[min_pages:] = window[min_pages:] != window[: len(window) - min_pages]
        kinds = {"host": pa.string(), "part": pa.int64(), "window": pa.int64(), "content": pa.int64()}
        n = int(few.sum())
        names = pa.array([key[0].as_py()] * n, pa.string())
        parts = np.full(n, key[1].as_py(), np.int64)
        out = {"host": names, "part": parts, "window": window[few], "content": content[few]}
        return pa.Table.from_batches([batch(out, kinds)])

    return run


def _judge_part(min_tokens: int, min_pages: int):
    def run(given: pa.Table, repeats: pa.Table) -> pa.Table:
        return _judge(min_tokens, min_pages, repeats["window"].to_numpy())(given)

    return run


def extract(
    pages: DataFrame,
    *,
    html: str = "html",
    url: str = "url",
    min_tokens: int = MIN_TOKENS,
    min_pages: int = MIN_PAGES,
    pages_per_part: int = PAGES_PER_PART,
) -> DataFrame:
    """Every row of ``pages`` without ``html``, with text, n_chars and n_repeated.

    Character references are decoded, white space inside a block becomes one space, and blocks are
    joined by ``\\n`` in page order. ``n_chars`` counts code points; ``n_repeated`` counts the tokens
    outside the main zone that the host repeats. Result columns replace columns of the same name;
    other columns pass through.

    A host with many pages is judged in parts of about ``pages_per_part`` pages, dealt by a hash of
    url and html; the pages that have a run are counted over all parts, so that the result is that of
    the whole host. Pages that agree in the set of their main and open blocks are copies and count as one
    page, so that copies do not make a text boilerplate. Null or empty html gives empty text. Pages without
    url share one host. Repeated rows are pages of their own with equal results. An empty table
    gives an empty table.
    """
    host = F.coalesce(
        F.lower(F.regexp_extract(col(url).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)),
        F.lit(""),
    )
    counts = pages.select(host.alias("host")).groupBy("host").agg(F.count("*").alias("pages"))
    counts = materialize(counts.select("host", F.ceil(F.col("pages") / pages_per_part).alias("parts")), "hosts")
    rest = [c for c in pages.columns if c != html]
    row = F.struct(*[col(c) for c in rest]) if rest else F.struct(F.lit(0).alias("_"))
    keyed = bounded_batches(pages).select(
        host.alias("host"),
        F.xxhash64(col(url).cast("string"), col(html).cast("string"), row).alias("hash"),
        col(html).cast("string").alias("html"),
        row.alias("row"),
    )
    kind = keyed.schema["row"].dataType.simpleString()
    parsed = keyed.mapInArrow(
        tidy(_parse), f"zones array<int>, texts array<string>, content long, host string, hash long, row {kind}"
    )
    dealt = parsed.join(small_side(counts), "host").withColumn("part", F.pmod("hash", "parts"))
    keys, schema = ["host", "part"], f"text string, n_repeated long, row {kind}"
    grouped = dealt.select(*keys, "zones", "texts", "row").groupBy(*keys)
    if counts.where(F.col("parts") > 1).isEmpty():
        judged = grouped.applyInArrow(_judge(min_tokens, min_pages), schema)
    else:
        # Runs are found in each part, the pages of different content that have them counted over all parts.
        large = keyed.join(small_side(counts.where(F.col("parts") > 1)), "host").select(
            "host", F.pmod("hash", "parts").alias("part"), "html"
        )
        outside = large.mapInArrow(
            tidy(_parse), "zones array<int>, texts array<string>, content long, host string, part long"
        )
        zoned = F.filter(F.arrays_zip("zones", "texts"), lambda b: b["zones"] != MAIN)
        outside = outside.select(*keys, zoned["texts"].alias("texts"), "content")
        windows = outside.groupBy(*keys).applyInArrow(
            _part_windows(min_tokens, min_pages), "host string, part long, window long, content long"
        )
        windows = materialize(windows, "windows")
        often = windows.groupBy("host", "window").agg(F.count_distinct("content").alias("pages"))
        often = often.where(F.col("pages") >= min_pages)
        repeats = windows.join(often, ["host", "window"], "left_semi").select(*keys, "window").distinct()
        judged = grouped.cogroup(repeats.groupBy(*keys)).applyInArrow(_judge_part(min_tokens, min_pages), schema)
    results = {"text": F.col("text"), "n_chars": F.length("text").cast("long"), "n_repeated": F.col("n_repeated")}
    kept = [F.col("row")[c].alias(c) for c in rest if c.lower() not in results]
    return judged.select(*kept, *[c.alias(name) for name, c in results.items()])
