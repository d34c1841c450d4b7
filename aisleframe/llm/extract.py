"""Main text of web pages: marked articles, and suffix arrays of a host's pages for the rest.

A page is cut into blocks, each in a zone: main (inside article or main), chrome (menus, headers,
footers, sidebars, notices, adverts, forms, comments) or open. The blocks outside articles of all pages
are concatenated by host, their suffixes sorted, and stretches of ``RUN`` or more tokens that stand on
several pages are boilerplate: every page keeps the runs of its open blocks that are not covered by
them. Marks are the check on that: blocks of a marked article always stay, chrome never does, and
beside a marked article a run of fewer than ``RUN`` tokens, on which the arrays cannot speak, goes.
Pages of a host with equal blocks are one page. Large hosts have several arrays; what stands on too
few pages of one of them is counted over all.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aisleframe.llm.common import Rows, folder_table, slices, whole_text

# Tokens of a repeated stretch, pages that must share it, tokens in one suffix array.
RUN = 8
PAGES = 3
SHARD_TOKENS = 50_000

_token = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*)>"
    r"|[^<]+|<", re.S,
)
_attribute = re.compile(
    r"(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I
)
_split = re.compile(r"[^a-z0-9]+").split
# Contents that are never text.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "object", "svg",
       "select", "button", "math", "canvas", "audio", "video"}
BLOCKS = {"p", "div", "section", "article", "main", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol",
          "li", "dl", "dt", "dd", "table", "caption", "thead", "tbody", "tfoot", "tr", "blockquote",
          "pre", "figure", "figcaption", "hr", "header", "footer", "nav", "aside", "form", "fieldset",
          "address", "body", "html", "head", "details", "summary", "center", "menu", "dialog"}
CLOSED_BY_NEXT = {"p", "li", "dt", "dd", "tr", "h1", "h2", "h3", "h4", "h5", "h6"}
GAPS = {"br", "td", "th", "img", "wbr"}
CHROME_TAGS = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "head"}
CHROME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert",
                "alertdialog", "form", "menu", "menubar", "toolbar"}
CHROME_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "adsense", "banner", "breadcrumb",
                "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "copyright",
                "disclaimer", "disqus", "footer", "gdpr", "header", "legal", "login", "masthead",
                "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices",
                "pager", "pagination", "popup", "promo", "promotion", "related", "replies", "search",
                "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe",
                "teaser", "toolbar", "widget"}
# An article of its own kind: what readers wrote, or a pointer to another page.
ASIDE_ARTICLES = {"comment", "comments", "reply", "replies", "related", "teaser", "promo", "ad"}


def _zone(tag: str, attributes: str) -> str | None:
    """The zone an element opens, None when it keeps its parent's."""
    words, role = set(), ""
    for name, value in _attribute.findall(attributes) if attributes else ():
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            words.update(_split(value))
        elif name == "role":
            role = value
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            return "chrome"
        elif name == "style" and "display:none" in value.replace(" ", ""):
            return "chrome"
    if tag in ("article", "main") or role in ("main", "article"):
        return "chrome" if words & ASIDE_ARTICLES else "main"
    if tag in CHROME_TAGS or role in CHROME_ROLES:
        return "chrome"
    if tag in BLOCKS and tag not in ("body", "html") and words & CHROME_WORDS:
        return "chrome"
    return None


def blocks(page: str) -> list[tuple[str, str]]:
    """(zone, text) of the blocks in page order; tags that never close do no harm beyond their own."""
    out: list[tuple[str, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, str]] = []  # (tag, zone) of open blocks
    zone, at, n, lowered = "open", 0, len(page), None
    match = _token.match

    def end_block():
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((zone, text))
            parts.clear()

    while at < n:
        m = match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            first = page[m.start()]
            if first != "<" or at == m.start() + 1:
                parts.append(m[0])
            continue
        tag = tag.lower()
        if tag in RAW:
            if not m[1] and not m[3].endswith("/"):
                lowered = lowered or page.lower()
                end = lowered.find(f"</{tag}", at) if len(lowered) == n else _find(page, tag, at)
                close = page.find(">", end) if end >= 0 else -1
                at = close + 1 if close >= 0 else n
            continue
        if tag not in BLOCKS:
            if tag in GAPS:
                parts.append(" ")
            continue
        end_block()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        else:
            while stack and stack[-1][0] in CLOSED_BY_NEXT:
                stack.pop()
            if tag != "hr":
                inner = stack[-1][1] if stack else "open"
                stack.append((tag, _zone(tag, m[3]) or inner))
        zone = stack[-1][1] if stack else "open"
    end_block()
    return out


def _find(page: str, tag: str, at: int) -> int:
    m = re.compile(f"</{tag}", re.I).search(page, at)
    return m.start() if m else -1


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)", url or "", re.I)
    return m[1].rpartition("@")[2].lower() if m else ""


# ``own``: the article's blocks at their places among all blocks, null elsewhere; ``outside``: the others,
# behind their zone's letter; ``at``: their places.
PARSED = ("page_id bigint, url string, host string, marked boolean, own array<string>, "
          "outside array<string>, at array<int>, content binary")


def content_of(found: list[tuple[str, str]]) -> bytes:
    """Digest of a page's blocks."""
    whole = "\0".join(f"{z}{len(t)} {t}" for z, t in found)
    return hashlib.blake2b(whole.encode(), digest_size=16).digest()


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = Rows(pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("marked", pa.bool_()),
        ("own", pa.list_(pa.string())), ("outside", pa.list_(pa.string())), ("at", pa.list_(pa.int32())),
        ("content", pa.binary()),
    ]))
    for batch in slices(batches, "html"):
        for page, url, body in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "html")]):
            found = blocks(body)
            own = [t if z == "main" else None for z, t in found]
            at = [k for k, t in enumerate(own) if t is None]
            outside = [("o" if found[k][0] == "open" else "c") + found[k][1] for k in at]
            if out.add(page, url, host_of(url), len(at) < len(found), own, outside, at,
                       content_of(found), size=len(body) + 64):
                yield out.take()
    if len(out):
        yield out.take()


def windows(tokens: np.ndarray, page: np.ndarray, run: int = RUN) -> tuple[np.ndarray, ...]:
    """Starts of the windows of ``run`` tokens inside pages, the group of equal windows each belongs
    to, and the distinct pages of each group.

    ``tokens`` are the pages' streams one after the other, ``page`` their (ascending) numbers.
    Suffixes are ranked by prefix doubling; as only their first ``run`` tokens decide, it stops there.
    """
    n = len(tokens)
    if n < run:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    width = 1
    while width < run:
        step = min(width, run - width)
        follow = np.full(n, -1, np.int64)
        same = page[step:] == page[:-step]
        follow[:-step][same] = rank[step:][same]
        rank = np.unique(rank * (n + 1) + follow + 1, return_inverse=True)[1].astype(np.int64)
        width += step
    order = np.argsort(rank, kind="stable")  # suffix array by the first ``run`` tokens
    whole = np.zeros(n, bool)
    whole[: n - run + 1] = page[run - 1 :] == page[: n - run + 1]
    order = order[whole[order]]
    if not len(order):
        return windows(tokens[:0], page[:0], run)
    r, p = rank[order], page[order]
    new_group = np.concatenate([[True], r[1:] != r[:-1]])
    new_page = new_group | np.concatenate([[True], p[1:] != p[:-1]])
    group = np.cumsum(new_group) - 1
    return order, group, np.bincount(group, weights=new_page).astype(np.int64)


def cover(n: int, starts: np.ndarray, run: int = RUN) -> np.ndarray:
    """Mask of the tokens inside the windows at ``starts``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + run, -1)
    return np.cumsum(edge[:n]) > 0


def repeated(tokens: np.ndarray, page: np.ndarray, run: int = RUN, pages: int = PAGES) -> np.ndarray:
    """Mask of the tokens inside stretches of ``run`` or more that ``pages`` distinct pages share."""
    starts, group, shared = windows(tokens, page, run)
    return cover(len(tokens), starts[shared[group] >= pages], run)


def window_names(words: np.ndarray, codes: np.ndarray, starts: np.ndarray, run: int = RUN) -> list[np.ndarray]:
    """Two 64-bit hashes (as signed) of the windows at ``starts``; ``words`` are those of the codes."""
    out = []
    for seed in (1, 2):
        own = np.array([xxhash.xxh64_intdigest(w, seed) for w in words], np.uint64)
        h, factor = np.zeros(len(starts), np.uint64), seed
        for k in range(run):
            factor = (factor * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) % 2**64 | 1
            h += own[codes[starts + k]] * np.uint64(factor)
            h ^= h >> np.uint64(32)
        out.append(h.view(np.int64))
    return out


def unique_words(words: list[str], covered: np.ndarray, run: int = RUN) -> list[str]:
    """Words outside the repeated stretches. A stretch that reaches from a repeated block a few words
    into another one takes none of these."""
    if covered.all():
        return []
    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    drop = np.zeros(len(words), bool)
    for a, b in zip(edges[0::2], edges[1::2]):
        drop[a:b] = b - a >= run
    return [w for w, d in zip(words, drop) if not d]


def _streams(group: pd.DataFrame) -> tuple:
    """A shard's pages, their words by block, all words, the word code and page number of each token."""
    words = [[b[1:].split() for b in blocks_] for blocks_ in group["outside"]]
    flat = [w for page in words for block in page for w in block]
    page = np.repeat(np.arange(len(words)), [sum(map(len, p)) for p in words])
    codes, known = pd.factorize(np.array(flat, dtype=object)) if flat else (np.zeros(0, np.int64), [])
    return words, known, codes, page


WINDOWS = "host string, shard bigint, w1 bigint, w2 bigint, pages bigint"
_SHARED = ["host", "w1", "w2"]


def _rare_windows(group: pd.DataFrame) -> pd.DataFrame:
    """Windows of a large host's shard with their pages."""
    if not group["shards"].iloc[0] > 1:
        return pd.DataFrame(columns=["host", "shard", "w1", "w2", "pages"], dtype=object)
    _, known, codes, page = _streams(group)
    starts, of, shared = windows(codes, page)
    first = starts[np.flatnonzero(np.diff(of, prepend=-1))]
    w1, w2 = window_names(known, codes, first)
    return pd.DataFrame({
        "host": np.full(len(first), group["host"].iloc[0], object),
        "shard": group["shard"].iloc[0], "w1": w1, "w2": w2, "pages": shared,
    })


def _unique_runs(group: pd.DataFrame, elsewhere: pd.DataFrame) -> pd.DataFrame:
    """What a shard's pages keep of their open blocks, and the blocks' places. ``elsewhere`` has the
    windows that stand on enough pages only when the host's other shards are counted."""
    group = group.reset_index(drop=True)
    words, known, codes, page = _streams(group)
    starts, of, shared = windows(codes, page)
    boiler = shared >= PAGES
    if len(elsewhere):
        first = starts[np.flatnonzero(np.diff(of, prepend=-1))]
        w1, w2 = window_names(known, codes, first)
        names = set(zip(elsewhere["w1"].tolist(), elsewhere["w2"].tolist()))
        boiler |= np.fromiter((w in names for w in zip(w1.tolist(), w2.tolist())), bool, len(first))
    covered = cover(len(codes), starts[boiler[of]])
    rows, at = [], 0
    for i, (page_words, raw, places) in enumerate(zip(words, group["outside"], group["at"])):
        kept_at, lines = [], []
        least = RUN if group["marked"][i] else 1
        for block, own, place in zip(raw, page_words, places):
            kept = unique_words(own, covered[at : at + len(own)])
            at += len(own)
            if block[0] == "o" and len(kept) >= least:
                kept_at.append(int(place))
                lines.append(" ".join(kept))
        if lines:
            rows.append((group["host"][i], group["content"][i], kept_at, lines))
    return pd.DataFrame(rows, columns=["host", "content", "kept_at", "kept"], dtype=object)


def main_text(pages: DataFrame, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """page_id, url, text per row; text is empty where nothing is left. Null html is empty.

    Suffix arrays hold the blocks outside articles of all distinct pages of a host. Hosts with more than
    ``shard_tokens`` of them are dealt by page over several arrays. Windows on too few pages of one
    array are summed over the host's arrays, so the size of the arrays changes no text.
    """
    parsed = folder_table(pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
        whole_text("html").alias("html"),
    ).mapInArrow(_parse, PARSED), "pages")
    bare = F.size("outside") == 0
    distinct = parsed.where(~bare).select("host", "content", "marked", "outside", "at").dropDuplicates(
        ["host", "content"]
    )
    chars = F.aggregate("outside", F.lit(0).cast("bigint"), lambda s, x: s + F.length(x))
    # Copies count here, which only makes more shards.
    sizes = parsed.where(~bare).groupBy("host").agg(F.sum(chars).alias("chars"))
    # At most one host for every 6 * shard_tokens characters of the input; its size decides how it is joined.
    large = folder_table(sizes.where(F.col("chars") > 6 * shard_tokens).select(
        "host", F.ceil(F.col("chars") / (6 * shard_tokens)).alias("shards")
    ), "large_hosts")
    dealt = distinct.join(large, "host", "left").withColumn(
        "shards", F.coalesce("shards", F.lit(1)).cast("bigint")
    ).withColumn("shard", F.pmod(F.xxhash64("content"), F.col("shards")))
    counted = folder_table(
        dealt.groupBy("host", "shard").applyInPandas(_rare_windows, WINDOWS), "windows"
    )
    common = counted.groupBy(_SHARED).agg(F.sum("pages").alias("n")).where(F.col("n") >= PAGES)
    elsewhere = counted.where(F.col("pages") < PAGES).join(common, _SHARED).select(
        "host", "shard", "w1", "w2"
    )
    # Stored, so that its size decides how it is joined; pages that keep no open block have no row.
    open_runs = folder_table(dealt.groupBy("host", "shard").cogroup(elsewhere.groupBy("host", "shard")).applyInPandas(
        _unique_runs, "host string, content binary, kept_at array<int>, kept array<string>"
    ), "open_runs")
    whole = parsed.select("page_id", "url", "host", "content", "own").join(open_runs, ["host", "content"], "left")
    lines = F.transform("own", lambda t, k: F.coalesce(t, F.get(F.col("kept"), F.array_position("kept_at", k).cast("int") - 1)))
    return whole.select("page_id", "url", F.array_join(lines, "\n").alias("text"))
