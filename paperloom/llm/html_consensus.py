"""Operator 7: main text of HTML pages by consensus paths of each host.

A first pass over the pages scores each page's containers: a text block's
length without links counts for its container and half for the one above.
Each page votes for the generalised path of its best container (tag names
with classes, digits removed), as a hash of bounded size. Spark counts the
votes of each host; paths with at least ``SHARE`` of them win, so at most
1 / SHARE paths a host. A second pass extracts every page again by its host's
winning paths, and by its own best container where none of them occurs.

Left out are navigation, asides, forms and their controls, scripts, styles,
headers and footers outside the article, hidden elements, and those whose role
or whose class or id as a whole names a menu, notice, advert, sidebar or
comments (``comment-list``, but not ``comment-on-kant``). Names that may also stand
for content (``related``, ``search``) count only where half of the text is links.
A named element around an article is never left out.

Null html counts as empty; pages without text give an empty text. Null URLs
form one host. Repeated rows each give a row (and a vote). Time and memory are
linear in a page's length, however deep it is nested.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom import scratch
from paperloom.llm.shared import fresh, text_batches
from paperloom.llm.url_templates import host_of

SHARE = 0.2
#: Hosts whose winning paths are broadcast (at most 1 / SHARE hashes each), at most; beyond, a shuffled join.
BROADCAST_HOSTS = 50_000

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:_-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:_-]*)([^>]*)>", re.S)
ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
TELLING = re.compile(r"class|id|role|style|hidden|itemprop", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg iframe textarea object canvas title".split())
DROP = frozenset("nav footer aside button select dialog menu head audio video".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt td th figcaption tr ul ol table tbody".split())
ALONE = {"p": frozenset(["p"]), "li": frozenset(["li"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "tr": frozenset(["tr", "td", "th"]), "dd": frozenset(["dd", "dt"]), "dt": frozenset(["dd", "dt"]), "option": frozenset(["option"])}
#: Names of what is never the article, and those that are so only where most of the text is links.
MARKS = frozenset("ad ads adv advert adverts advertisement advertisements advertising adsense alert alerts breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr masthead modal nav navbar navigation newsletter notice notices pager pagination popup promo promos promotion replies reply respond sidebar sponsor sponsored sponsors toolbar".split())
LINKED_MARKS = frozenset("menu menus recommendations recommended related search share sharing skip social subscribe subscription widget widgets".split())
OUTER_MARKS = frozenset("header banner".split())
#: Words beside a mark that don't change what it names: of layout (anywhere), of whose it is (before it), of what a list holds (after it).
LAYOUT = frozenset("area bar block body bottom box center col column container content frame group holder inner item items layer left list main outer panel region right row section slot small sticky thread top unit wrap wrapper zone banner".split())
OWNERS = frozenset("article blog global google page post primary reader readers secondary site user users".split())
HELD = frozenset("articles buttons icons links posts stories".split())
ROLES = frozenset("alert alertdialog complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: What an element's own tag says of it.
STAYS, DROPPED, NAMED, NAMED_LINKED, OUTER = range(5)


def named(name: str) -> int:
    """What a class or id as a whole says: STAYS, NAMED, NAMED_LINKED or OUTER."""
    words = [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", name)]
    core = [w for w in words if w not in LAYOUT]
    while core and core[0] in OWNERS:
        core = core[1:]
    while len(core) > 1 and core[-1] in HELD:
        core = core[:-1]
    if core and all(w in MARKS or w in LINKED_MARKS for w in core):
        return NAMED if core[-1] in MARKS and not any(w in HELD for w in words) else NAMED_LINKED
    if core == ["header"] or not core and "banner" in words:
        return OUTER
    return STAYS


@lru_cache(maxsize=8192)
def described(tag: str, attrs: str) -> tuple[str, int, bool]:
    """(generalised label, what the tag says, whether it is an article) of an element."""
    found: dict[str, str] = {}
    for a, b, c, d in ATTR.findall(attrs):
        found.setdefault(a.lower(), b or c or d or "")
    classes = found.get("class", "").split()
    role = found.get("role", "").lower()
    article = tag in ("article", "main") or role == "main" or found.get("itemprop") == "articleBody"
    says = max(map(named, [*classes, found.get("id", "")]), key=(STAYS, OUTER, NAMED_LINKED, NAMED).index)
    if tag in ("body", "html") or article:
        says = STAYS
    elif tag in DROP or role in ROLES or "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower():
        says = DROPPED
    elif tag == "form":
        says = NAMED
    elif (tag == "header" or role == "banner") and says == STAYS:
        says = OUTER
    label = ".".join([tag, *sorted(re.sub(r"\d+", "", c.lower()) for c in classes)])
    return label, says, article


class Paths:
    """The generalised path of an element as text, by its number."""

    def __init__(self, page: Page):
        self.page = page

    def __getitem__(self, e: int) -> str:
        labels = []
        while e:
            labels.append(self.page.label[e])
            e = self.page.up[e]
        return "".join(f"/{x}" for x in reversed(labels))


class Page:
    """Elements, in the order of their opening tags, and text blocks of one page."""

    def __init__(self, html: str):
        self.tag: list[str] = ["#"]
        self.up: list[int] = [0]
        self.label: list[str] = [""]
        self.key: list[int] = [0]  # hash of the generalised path
        self.article: list[int] = [0]  # the article around the element, if any
        self.says: list[int] = [STAYS]
        self.block_of: list[int] = [0]
        self.path = Paths(self)
        self._parts: list[tuple[int, list[tuple[int, str, bool]]]] = []  # block element; element, text and whether it is linked
        self._read(html)
        self._settle()

    def _open(self, tag: str, attrs: str, parent: int) -> int:
        label, says, article = described(tag, attrs if TELLING.search(attrs) else "")
        inside = self.article[parent]
        if says == OUTER:
            says = STAYS if inside else DROPPED
        e = len(self.tag)
        self.tag.append(tag)
        self.up.append(parent)
        self.label.append(label)
        self.key.append(xxhash.xxh64_intdigest(label, self.key[parent]))
        self.article.append(inside or (e if article else 0))
        self.says.append(DROPPED if self.says[parent] == DROPPED else says)
        self.block_of.append(e if tag in BLOCK else self.block_of[parent])
        return e

    def _read(self, html: str) -> None:
        stack, parts, links, there = [0], [], 0, Counter()

        def flush() -> None:
            nonlocal parts
            if parts:
                self._parts.append((self.block_of[stack[-1]], parts))
                parts = []

        def close(k: int) -> None:
            for x in stack[k:]:
                there[self.tag[x]] -= 1
            del stack[k:]

        at, end = 0, len(html)
        while at < end:
            m = TAG.search(html, at)
            stop = m.start() if m else end
            if stop > at and self.says[stack[-1]] != DROPPED:
                parts.append((stack[-1], html[at:stop], links > 0))
            if not m:
                break
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name, closing, attrs = name.lower(), m[1] or m[4], m[3] or m[6] or ""
            if closing:
                if name in BLOCK:
                    flush()
                if name == "a":
                    links = max(0, links - 1)
                if there[name] > 0:
                    for k in range(len(stack) - 1, 0, -1):
                        inner = self.tag[stack[k]]
                        if inner == name:
                            close(k)
                            break
                        if inner in ("article", "main", "body") and name not in ("article", "main", "body", "html", "div", "section"):
                            break
                continue
            if name in RAW:
                if not attrs.endswith("/"):
                    past = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at)
                    at = past.end() if past else end
                continue
            if name == "br":
                parts.append((stack[-1], " ", False))
                continue
            if name in VOID:
                if name in BLOCK:
                    flush()
                continue
            if name in BLOCK:
                flush()
                alone = {*ALONE.get(name, ()), "p"}
                for k in range(len(stack) - 1, 0, -1):
                    inner = self.tag[stack[k]]
                    if inner in alone:
                        close(k)
                    elif inner in BLOCK:
                        break
            if name == "a":
                links += 1
            stack.append(self._open(name, attrs, stack[-1]))
            there[name] += 1
        flush()

    def _settle(self) -> None:
        """Decide on named elements by what they hold, and keep the blocks of what stays."""
        n = len(self.tag)
        chars, linked, holds, last = [0] * n, [0] * n, [False] * n, list(range(n))
        for _, parts in self._parts:
            for e, text, link in parts:
                size = len(text) - text.count(" ")
                chars[e] += size
                linked[e] += size * link
        for e in range(n - 1, 0, -1):
            up = self.up[e]
            chars[up] += chars[e]
            linked[up] += linked[e]
            holds[up] = holds[up] or holds[e] or self.article[e] == e
            last[up] = max(last[up], last[e])
        self.last, self.dropped = last, [False] * n
        for e in range(1, n):
            says = self.says[e]
            own = says == DROPPED or not holds[e] and (says == NAMED or says == NAMED_LINKED and 2 * linked[e] >= chars[e])
            self.dropped[e] = own or self.dropped[self.up[e]]
        self.blocks: list[tuple[int, str, int]] = []  # innermost block element, text, characters in links
        for block, parts in self._parts:
            kept = [p for p in parts if not self.dropped[p[0]]]
            words = " ".join(unescape("".join(text for _, text, _ in kept)).split())
            if words:
                self.blocks.append((block, words, sum(len(text) for _, text, link in kept if link)))
        del self._parts

    def best(self) -> tuple[int, float]:
        """(element, score) of the container with most text outside links; the article around it if there is one."""
        holder = [0] * len(self.tag)
        for e in range(1, len(self.tag)):
            holder[e] = holder[self.up[e]] if self.tag[e] in LEAF else e
        scores: dict[int, float] = {}
        for e, words, linked in self.blocks:
            n, e = max(0, len(words) - linked), holder[e]
            scores[e] = scores.get(e, 0) + n
            if e:
                scores[self.up[e]] = scores.get(self.up[e], 0) + n / 2
        if not scores:
            return 0, 0.0
        e = max(scores, key=lambda k: (scores[k], -k))
        return self.article[e] or e, scores[e]

    def text(self, target: int) -> str:
        """Blocks of an element, one a line."""
        return "\n".join(words for e, words, _ in self.blocks if target <= e <= self.last[target])

    def extract(self, keys: list[int]) -> str:
        """Blocks of all elements with the first of the paths (as hashes) that has text, else of the page's best container."""
        for key in keys:
            if key not in self.key:
                continue
            inside = [False] * len(self.tag)
            for e in range(1, len(self.tag)):
                inside[e] = inside[self.up[e]] or self.key[e] == key and not self.dropped[e]
            found = [words for e, words, _ in self.blocks if inside[e]]
            if found:
                return "\n".join(found)
        return self.text(self.best()[0])


def _htmls(b: pa.RecordBatch, k: int) -> list[str]:
    return pc.fill_null(b.column(k).cast(pa.string()), "").to_pylist()


def _signed(key: int) -> int:
    return key - (1 << 64) if key >> 63 else key


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [(_signed(p.key[e]) if e else None, s) for p in map(Page, _htmls(b, 1)) for e, s in [p.best()]]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.float64())], names=["host", "path", "score"])


def host_paths(pages: DataFrame, url: str = "url", html: str = "html", share: float = SHARE) -> DataFrame:
    """(host, paths): hashes of the winning paths of each host, most votes first."""
    text_batches(pages.sparkSession)
    votes = pages.select(host_of(url).alias("host"), html).mapInArrow(_votes, "host string, path bigint, score double").where("path is not null")
    counts = votes.groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum(F.log1p("score")).alias("weight"))
    counts, _ = scratch.stage(counts, "votes")
    totals = counts.groupBy("host").agg(F.sum("weight").alias("total"))
    # at most 1 / share paths a host are left to gather
    won = counts.join(totals, "host").where((F.col("weight") >= share * F.col("total")) & (F.col("weight") > 0))
    return won.groupBy("host").agg(F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("w"), "path"))).alias("p")).select("host", F.col("p.path").alias("paths"))


def extract_main(pages: DataFrame, url: str = "url", html: str = "html", out: str = "text", keep: list[str] | None = None, share: float = SHARE, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """``pages`` (the columns ``keep``, all if None) with the main text of each page in ``out``."""
    rest = [c for c in (pages.columns if keep is None else keep) if c != out]
    paths, _ = scratch.stage(host_paths(pages, url, html, share), "paths")
    small = paths.count() <= broadcast_hosts
    page, host, won = (fresh(rest) + x for x in ("html", "host", "paths"))
    source = pages.select(*[F.col(c) for c in rest], F.col(html).alias(page), host_of(url).alias(host))
    winners = paths.select(F.col("host").alias(host), F.col("paths").alias(won))
    joined = source.join(F.broadcast(winners) if small else winners, host, "left").select(*rest, page, won)
    schema = pages.select(*rest).schema.add(T.StructField(out, T.StringType(), False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(rest)
        for b in batches:
            texts = [Page(h).extract([k % (1 << 64) for k in p or []]) for h, p in zip(_htmls(b, k), b.column(k + 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:k], pa.array(texts, pa.string())], names=schema.names)

    return joined.mapInArrow(run, schema)
