"""Main text of web pages by a vote of the pages of a host.

Each page proposes the container that holds its text: from the body down, into
the child container with most of the text, as long as no heading is lost.
Proposals are written as generalised paths of tags and classes, weighed by
their text and counted per host in Spark. Every page is then extracted again
at its host's winning path; a page without that path uses its own proposal.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import columns, filled, slices, stored

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+>", re.S)
_ATTRIBUTE = re.compile(r"(?:\A|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template svg math".split())
CONTAINERS = frozenset("body main article section div td center".split())
BLOCKS = CONTAINERS | frozenset(
    "html head p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre blockquote table thead tbody tfoot tr th caption figure "
    "figcaption header footer nav aside form fieldset details summary address hr br option".split())
#: Elements that are never part of the article.
ASIDE = frozenset("head nav footer aside form button select menu dialog object canvas audio video".split()) | RAW
#: What an open element of the key is closed by.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
#: Words in classes and ids of what surrounds an article.
SURROUNDINGS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar rail footer masthead cookie cookies consent notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login search comment comments reply replies respond disqus share sharing "
    "social related recommended recommendations pagination pager widget toolbar skip".split())
BESIDE = frozenset("with without no not non has".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
MOST_OF = 0.7


def _surrounds(token: str) -> bool:
    """Whether a class or id names a surrounding; ``with-sidebar`` and ``no-comments`` name what stands beside one."""
    parts = [w.lower() for w in _PART.findall(token)]
    return bool(parts) and parts[0] not in BESIDE and any(w in SURROUNDINGS for w in parts)


class Page:
    """Elements with their parents, generalised names and flags, and the texts between the tags."""

    def __init__(self, html: str):
        self.parent, self.name, self.out, self.tag = [-1], [""], [False], [""]
        self.texts: list[tuple[int, str | None]] = []  # None: a block begins or ends
        stack, at, size = [0], 0, len(html)
        while at < size:
            m = _TOKEN.search(html, at)
            if m is None:
                self._add(stack[-1], html[at:])
                break
            if m.start() > at:
                self._add(stack[-1], html[at:m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if tag in BLOCKS:
                self.texts.append((stack[-1], None))
            if m[1]:
                self._close(stack, tag)
            elif tag in RAW:
                if not m[3].endswith("/"):
                    end = re.compile(f"</{re.escape(tag)}\\b[^>]*>?", re.I).search(html, at)
                    at = end.end() if end else size
            else:
                self._imply(stack, tag)
                if tag not in VOID:
                    stack.append(self._open(stack[-1], tag, m[3]))

    def _add(self, node: int, text: str):
        if not self.out[node]:
            self.texts.append((node, unescape(text) if "&" in text else text))

    def _open(self, parent: int, tag: str, attributes: str) -> int:
        classes, out = [], tag in ASIDE or (tag == "header" and not self._within(parent, ("article", "main")))
        for key, *value in _ATTRIBUTE.findall(attributes) if attributes else ():
            value = unescape("".join(value))
            if key.lower() == "role":
                out = out or value.strip().lower() in ROLES
                continue
            if tag not in ("html", "body", "article", "main"):
                out = out or any(map(_surrounds, value.split()))
            if key.lower() == "class":
                classes = sorted({re.sub(r"[0-9]+", "#", c) for c in value.split()})
        self.parent.append(parent)
        self.tag.append(tag)
        self.name.append(".".join([tag, *classes]))
        self.out.append(out or self.out[parent])
        return len(self.parent) - 1

    def _within(self, node: int, tags) -> bool:
        while node > 0:
            if self.tag[node] in tags:
                return True
            node = self.parent[node]
        return False

    def _imply(self, stack: list[int], tag: str):
        """Close what the start of ``tag`` closes: a paragraph by any block, list items and cells by their like."""
        like = CLOSES.get(tag)
        for i in range(len(stack) - 1, 0, -1):
            own = self.tag[stack[i]]
            if (tag in BLOCKS and tag != "br" and own == "p") or (like and own in like):
                del stack[i:]
                return
            if own in CONTAINERS or own in ("table", "ul", "ol", "dl") or (not like and own in BLOCKS):
                return

    def _close(self, stack: list[int], tag: str):
        for i in range(len(stack) - 1, 0, -1):
            if self.tag[stack[i]] == tag:
                del stack[i:]
                return
            if self.tag[stack[i]] in CONTAINERS and tag not in CONTAINERS and tag not in BLOCKS:
                return

    def path(self, node: int) -> str:
        names = []
        while node > 0:
            names.append(self.name[node])
            node = self.parent[node]
        return "/".join(reversed(names))

    def proposal(self) -> tuple[str, int]:
        """Path of the page's own container and the number of its characters."""
        chars, heads = [0] * len(self.parent), [0] * len(self.parent)
        for node, text in self.texts:
            if text and not self.out[node]:
                chars[node] += 0 if self._within(node, ("a",)) else len(text)
        for node in range(1, len(self.parent)):
            heads[node] += self.tag[node] == "h1" and not self.out[node]
        children: dict[int, list[int]] = {}
        for node in range(len(self.parent) - 1, 0, -1):
            chars[self.parent[node]] += chars[node]
            heads[self.parent[node]] += heads[node]
            children.setdefault(self.parent[node], []).append(node)
        at = 0
        while True:
            best = max((c for c in children.get(at, ()) if not self.out[c]), default=None,
                       key=lambda c: (chars[c] * (3 if self.tag[c] in ("article", "main") else 2), -c))
            if best is None or chars[best] < MOST_OF * chars[at] or (heads[at] and not heads[best]) or (
                    self.tag[best] not in CONTAINERS and self.tag[best] != "html"):
                return self.path(at), chars[at]
            at = best
            if self.tag[at] == "article":
                return self.path(at), chars[at]

    def text(self, path: str | None) -> str:
        """Text under the outermost elements at ``path``, or under the page's own proposal where there are none."""
        inside = [False] * len(self.parent)
        own = [""] * len(self.parent)

        def mark(path):
            found = False
            for node in range(len(self.parent)):
                if node:
                    up = own[self.parent[node]]
                    own[node] = f"{up}/{self.name[node]}" if up else self.name[node]
                    inside[node] = inside[self.parent[node]]
                if own[node] == path and not self.out[node]:
                    inside[node] = found = True
            return found

        if path is None or not mark(path):
            mark(self.proposal()[0])
        blocks, run = [], []
        for node, text in self.texts:
            if text is None:
                if run:
                    blocks.append("".join(run))
                    run = []
            elif inside[node] and not self.out[node]:
                run.append(text)
        blocks.append("".join(run))
        return " ".join(" ".join(blocks).split())


def _proposals(batches):
    for batch in batches:
        found = [Page(html).proposal() for html in filled(batch.column("html")).to_pylist()]
        yield pa.RecordBatch.from_arrays([
            batch.column("host"), pa.array([p for p, _ in found], pa.string()),
            pa.array([n for _, n in found], pa.int64())], ["host", "path", "weight"])


def _texts(batches):
    for batch in batches:
        pages, paths = filled(batch.column("html")), batch.column("path").to_pylist()
        for low, high in slices(pages):
            texts = [Page(html).text(path) for html, path in zip(pages.slice(low, high - low).to_pylist(), paths[low:high])]
            texts = [t.encode("utf-8", "replace").decode() for t in texts]
            yield pa.RecordBatch.from_arrays([
                batch.column("page_id").slice(low, high - low), batch.column("url").slice(low, high - low),
                pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, html) to one row per host: host, path. Votes are summed before the shuffle."""
    votes = pages.mapInArrow(_proposals, "host string, path string, weight bigint").where("weight > 0")
    votes = votes.groupBy("host", "path").agg(F.sum("weight").alias("weight"))
    return votes.groupBy("host").agg(F.max(F.struct("weight", "path")).getField("path").alias("path"))


def main_text(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Null and empty pages have an empty text. Pages without a readable host vote
    together. Repeated rows are extracted one by one; an empty table gives no rows.
    """
    rows = columns(pages, page_id=id, url=url, html=html).withColumn("host", host_of(F.col("url")))
    # read back from files, so that Spark knows its size and broadcasts it only if it is small
    winners = stored(host_paths(rows.select("host", "html")), "host-paths")
    schema = f"page_id {pages.schema[id].dataType.simpleString()}, url string, text string, n_chars bigint"
    return rows.join(winners, "host", "left").select("page_id", F.col("url").cast("string"), "html", "path").mapInArrow(
        _texts, schema)
