"""Main text of web pages by consensus of a host's pages on the path of their article.

Each page's containers are scored by their running text outside links and page furniture; the page votes for
the path of its best one, generalised to tags and digit-free classes. Spark sums the votes of every host, and
each page is extracted again with its host's winning path. A page on which that path holds less than half the running
text of its own best container, as where another template uses the path for something else, uses its own.

An element knows its parent, its own step of the path and a hash of the whole path, so a page takes memory in proportion to its
size, however deep its elements nest.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from html import unescape
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import bounded_batches, kept, stored

# Names of HTML and of page furniture.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe textarea title svg object select annotation annotation-xml".split())
BLOCK = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
CONTAINER = set("article body div html main section td".split())
FURNITURE_TAGS = set("nav header footer aside menu dialog button head input".split()) | RAW
FURNITURE_ROLES = set("navigation banner contentinfo complementary dialog alert menu menubar alertdialog".split())
#: Tags and roles of furniture that may as well stand around a whole page.
WRAPPING_TAGS, WRAPPING_ROLES = set("form fieldset".split()), set("form search".split())
#: Words among FURNITURE_WORDS that are also what a part of an article is about, where they are a whole name.
AMBIGUOUS = set("discussion search related form reply respond sharing share promotion promo tags alert notice notices navigation subscription registration".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Characters of running text outside links from which a part with a heading and an ambiguous name is no furniture.
RUNNING = 160
FURNITURE_WORDS = set(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer bottombar sidebar "
    "aside widget widgets cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus respond reply replies discussion "
    "form search searchbox share sharing social related recommended recommendations pagination pager toolbar skip tags hidden".split()
)
#: Parts that may stand beside one of FURNITURE_WORDS in a name that means furniture: where or how it is laid out, not what a text is about.
LAYOUT_WORDS = set(
    "site page global top bottom left right first last inner outer upper lower primary secondary main blog post posts article articles entry user reader readers list lists item items link links button buttons btn box "
    "wrap wrapper container holder area block blocks section sections row col column columns bar unit slot zone panel pane strip region group content text title heading icon icons image images img logo widget js "
    "meta author thread body field fields input icon slider carousel grid card cards nested mobile desktop sticky fixed float floating style default count number date time children child parent level more".split()
)
CONTENT_WORDS = set("article content entry post story main text body".split())
CLOSES_P = BLOCK - {"body", "html"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = set("ul ol dl table".split())

#: Part of the running text of a page's own best container that its host's path must hold.
HALF = 0.5

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def names_furniture(name: str) -> bool:
    """Whether one class or id, taken whole, names page furniture: site-header, commentList and ad-slot2 do, has-sidebar, alert-free and comments-open don't."""
    parts = _WORDS.findall(_CAMEL.sub("-", name).lower())
    return any(x in FURNITURE_WORDS for x in parts) and all(x in FURNITURE_WORDS or x in LAYOUT_WORDS for x in parts)


_MASK = (1 << 64) - 1


def _step(before: int, step: str) -> int:
    """Hash of a path that goes on by a step; the same everywhere."""
    x = ((before ^ zlib.crc32(step.encode("utf-8", "surrogatepass")) ^ len(step) << 32) * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & _MASK
    return x ^ x >> 29


class Page:
    """Elements in page order (tag, parent, step and hash of the path, furniture) and pieces of text (element, block, text)."""

    def __init__(self, html: str) -> None:
        self.tags, self.parents, self.steps, self.keys, self.in_link = ["#"], [-1], [""], [0], [False]
        self.hints, self._sure, self._named, self._doubt = [False], [False], [False], [""]
        self.pieces: list[tuple[int, int, str]] = []
        self._block = 0
        self._parse(html)
        self.furniture = self._marked()

    def _open(self, tag: str, attrs: str, parent: int) -> int:
        got = {}
        if attrs and not attrs.isspace():
            got = {k.lower(): a or b or c or "" for k, a, b, c in _ATTR.findall(attrs)}
        names = unescape(f"{got.get('class', '')} {got.get('id', '')}").split() if got else []
        told = set(_WORDS.findall(" ".join(names).lower()))
        classes = sorted(x for x in re.sub(r"\d+", "", unescape(got.get("class", "")).lower()).split() if x) if got else []
        role = got.get("role", "").lower()
        sure = tag in FURNITURE_TAGS or role in FURNITURE_ROLES or "hidden" in got or got.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none", got.get("style", "").lower()))
        self.tags.append(tag)
        self.parents.append(parent)
        self.steps.append(".".join([tag, *classes]) if tag in CONTAINER or tag in BLOCK else "")
        self.keys.append(_step(self.keys[parent], self.steps[-1]) if self.steps[-1] else self.keys[parent])
        self._sure.append(sure)
        named = [x for x in names if names_furniture(x)] if tag not in ("body", "html", "main") else []
        self._named.append(bool(named) or tag in WRAPPING_TAGS or role in WRAPPING_ROLES)
        alone = {x.lower() for x in named}
        self._doubt.append(min(alone) if len(alone) == 1 and alone <= AMBIGUOUS and tag not in WRAPPING_TAGS else "")
        self.in_link.append(tag == "a" or self.in_link[parent])
        self.hints.append(tag in ("article", "main") or bool(told & CONTENT_WORDS))
        return len(self.tags) - 1

    def path(self, at: int) -> str:
        """The path of an element, tags and classes from the top."""
        steps = []
        while at > 0:
            if self.steps[at]:
                steps.append(self.steps[at])
            at = self.parents[at]
        return "".join(f"/{x}" for x in reversed(steps))

    def _marked(self) -> list[bool]:
        """Which elements are furniture: by tag, role or state; or by name, or as a form, unless the page's heading or main part is in them with more text than stands outside all such.

        A part whose only name is an ambiguous word is none if it has a heading of its own and running text outside links that isn't
        within furniture of other names.
        """
        n = len(self.tags)
        sure, named = list(self._sure), list(self._named)
        for e in range(1, n):
            sure[e] |= sure[self.parents[e]]
            named[e] |= named[self.parents[e]]
        size, held, outside, runs = [0] * n, [False] * n, 0, [0] * n
        heads: dict[int, str] = {}
        for e, _, text in self.pieces:
            if not sure[e]:
                k = len(text.strip())
                size[e] += k
                outside += 0 if named[e] else k
                if not self.in_link[e]:
                    runs[e] += k
        for e in range(n - 1, 0, -1):
            up = self.parents[e]
            held[e] |= not sure[e] and (self.tags[e] in ("h1", "main") or self.tags[e] in ("article", "h2") and self._wrapped(e))
            held[up] |= held[e]
            size[up] += size[e]
            if not (self._named[e] and not self._doubt[e]):
                runs[up] += runs[e]
        if any(self._doubt):
            heads = self._headings(sure)
        for e in range(1, n):
            if sure[self.parents[e]]:
                sure[e] = True
            elif self._named[e] and not sure[e]:
                clear = self._doubt[e] and e in heads and runs[e] >= RUNNING and not (set(_WORDS.findall(heads[e].lower())) - {self._doubt[e]}) & FURNITURE_WORDS
                sure[e] = not (clear or held[e] and size[e] > outside)
        return sure

    def _wrapped(self, e: int) -> bool:
        """Whether the nearest element around e that names or forms may make furniture is a form, and no name."""
        at = self.parents[e]
        while at > 0 and not self._named[at]:
            at = self.parents[at]
        return at > 0 and self.tags[at] in WRAPPING_TAGS

    def _headings(self, sure: list[bool]) -> dict[int, str]:
        """The first heading within each element of an ambiguous name."""
        texts: dict[int, list[str]] = defaultdict(list)
        for e, _, text in self.pieces:
            while e > 0 and self.tags[e] not in HEADINGS and self.tags[e] not in BLOCK:
                e = self.parents[e]
            if self.tags[e] in HEADINGS and not sure[e]:
                texts[e].append(text)
        out: dict[int, str] = {}
        for e in sorted(texts):
            at = self.parents[e]
            while at > 0:
                if self._doubt[at]:
                    out.setdefault(at, "".join(texts[e]))
                    break
                at = self.parents[at]
        return out

    def _text(self, at: int, text: str) -> None:
        if text:
            self.pieces.append((at, self._block, text))

    def _parse(self, html: str) -> None:
        stack, at, n = [0], 0, len(html)
        seen: set[str] = set()
        while at < n:
            cut = html.find("<", at)
            if cut < 0:
                self._text(stack[-1], html[at:])
                break
            self._text(stack[-1], html[at:cut])
            if html.startswith("<!--", cut):
                end = html.find("-->", cut + 4)
                at = n if end < 0 else end + 3
                continue
            if html.startswith(("<!", "<?"), cut):
                end = html.find(">", cut)
                at = n if end < 0 else end + 1
                continue
            m = _TAG.match(html, cut) or _LOOSE.match(html, cut)
            if not m:
                if html.startswith("</", cut):
                    end = html.find(">", cut)
                    at = n if end < 0 else end + 1
                else:
                    self._text(stack[-1], "<")
                    at = cut + 1
                continue
            closing, tag, attrs, at = m[1], m[2].lower(), m[3], m.end()
            if tag == "br" or tag in BLOCK:
                if tag == "br":
                    self._text(stack[-1], " ")
                else:
                    self._block += 1
            if closing:
                for k in range(len(stack) - 1, 0, -1) if tag in seen else ():
                    if self.tags[stack[k]] == tag:
                        del stack[k:]
                        break
                continue
            if tag in CLOSES_P:
                self._close(stack, {"p"}, BLOCK)
            if tag in SAME:
                self._close(stack, SAME[tag], LISTS)
            own = self._open(tag, attrs, stack[-1])
            if tag in RAW and not attrs.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                at = end.end() if end else n
            elif tag not in VOID and not (attrs.endswith("/") and tag not in BLOCK):
                stack.append(own)
                seen.add(tag)

    def _close(self, stack: list[int], tags: set[str], stop: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            tag = self.tags[stack[k]]
            if tag in tags:
                del stack[k:]
                return
            if tag in stop:
                return

    def best(self) -> int:
        """The deepest container with most of the page's running text, 0 for the whole page, -1 without any; content names count somewhat more."""
        n = len(self.tags)
        size = self.running()
        if size[0] <= 0:
            return -1
        best, best_score = 0, size[0] * 0.7
        for e in range(1, n):
            if self.tags[e] in CONTAINER and not self.furniture[e]:
                score = size[e] * (1.25 if self.hints[e] else 1.0)
                if score >= best_score and size[e] >= 0.5 * size[0]:
                    best, best_score = e, min(score, size[0])
                    if self.hints[e]:
                        best_score = max(best_score, 0.9 * size[0])
        return best

    def running(self) -> list[float]:
        """Characters of text in each element, those of links against it, furniture aside."""
        size = [0.0] * len(self.tags)
        for e, _, text in self.pieces:
            if not self.furniture[e]:
                k = len(text.strip())
                size[e] += -0.5 * k if self.in_link[e] else k
        for e in range(len(size) - 1, 0, -1):
            size[self.parents[e]] += size[e]
        return size

    def under(self, key: int) -> list[bool]:
        """Which elements are on a path, or within an element that is."""
        inside = [key == 0] + [False] * (len(self.tags) - 1)
        for e in range(1, len(inside)):
            inside[e] = inside[self.parents[e]] or self.keys[e] == key and bool(self.steps[e])
        return inside

    def text(self, inside: list[bool]) -> str:
        """Blocks of the elements inside, without furniture."""
        blocks: dict[int, list[str]] = defaultdict(list)
        for e, block, text in self.pieces:
            if inside[e] and not self.furniture[e]:
                blocks[block].append(text)
        joined = (" ".join(unescape("".join(x)).split()) for _, x in sorted(blocks.items()))
        return " ".join(x for x in joined if x)

    def main(self, key: int | None) -> str:
        """The main text: under the host's path, if that holds HALF of the running text under the page's own best container or more."""
        best = max(0, self.best())
        if key is not None and key != self.keys[best]:
            inside, size = self.under(key), self.running()
            told = sum(size[e] for e in range(1, len(inside)) if inside[e] and not inside[self.parents[e]])
            if told >= HALF * size[best] and (text := self.text(inside)):
                return text
        return self.text(self.under(self.keys[best]))


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        votes: Counter = Counter()
        for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
            if html and (best := (page := Page(html)).best()) > 0:
                votes[host_of(url), page.path(best), page.keys[best] - (1 << 63)] += 1
        hosts, paths, keys = zip(*votes, strict=True) if votes else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(keys, pa.int64()), pa.array(list(votes.values()), pa.int64())], ["host", "path", "key", "votes"])


def _hosted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.append_column("host", pa.array([host_of(x) for x in batch.column("url").to_pylist()], pa.string()))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column("key").to_pylist()
        out = [Page(html or "").main(None if key is None else key + (1 << 63)) for html, key in zip(batch.column("html").to_pylist(), keys, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), batch.column("path")], ["page_id", "url", "text", "path"])


def consensus_paths(pages: DataFrame) -> DataFrame:
    """(host, path, votes, share, key): the winning path of each host, and its hash; ties go to the smaller path."""
    votes = pages.select("url", "html").mapInArrow(_votes, "host string, path string, key long, votes long").groupBy("host", "path", "key").agg(F.sum("votes").alias("votes"))
    best = votes.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("v"), "path", "key")).alias("at"), F.sum("votes").alias("all"))
    return best.selectExpr("host", "at.path AS path", "-at.v AS votes", "-at.v / all AS share", "at.key AS key")


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and the path used, of every page.

    Null or empty html, and pages of furniture alone, give an empty text. A null url counts as one host, and of a host's
    paths with equally many votes the smaller wins. Rows that repeat a page_id or have none give a row each; page_id is
    cast to long. No rows give no rows. Only page_id, url and html are read. Furniture is told by whole names of
    classes and ids (names_furniture()); formulas stay, but not their annotations.
    """
    bounded_batches(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    winners = kept(stored(consensus_paths(pages).select("host", "path", "key"), "paths"))
    joined = pages.mapInArrow(_hosted, "page_id long, url string, html string, host string").join(winners, "host", "left")
    got = joined.select("page_id", "url", "html", "path", "key").mapInArrow(_extracted, "page_id long, url string, text string, path string")
    return got.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "path")
