"""Main text of web pages by wrappers inferred per host.

All pages of a host are grouped by template, the set of paths of their containers. In each template, blocks whose text differs between
pages are slots; the slots say which element holds the article, and every page is then read by its template's path. infer() shows
some pages as one expression: runs that repeat are repeated groups, tokens that only some pages have are optional groups.
"""

from __future__ import annotations

import hashlib
import html as entities
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.llm.common import table
from strandloom.plans.tables import written as save

#: When a block is a slot, see wrappers().
TWENTY, FEW = 20, 6
#: Longest unit of a repeated group, in tokens.
UNIT = 8
#: Wrappers are broadcast up to this many and PATH characters of each on average; beyond, pages are joined to them, a template dealt out to SALTS tasks.
HOSTS, PATH, SALTS = 20_000, 400, 32

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold no article text, and whole words of class, id or role that mark others. A form, or a marked element, that
#: holds the page's first article, main or h1 element holds the article, and isn't left out; a header is left out unless it stands
#: in an article or main element or in what a wrapper names. Elements in UNMARKED hold the page or the article and are never
#: marked; the id of one in NAMED is an anchor and doesn't mark it.
OUTSIDE = frozenset("head nav aside footer button select object canvas dialog menu".split())
#: Elements whose text is no text; without an end tag only the tag itself goes, but for scripts and styles.
RAW = frozenset("script style noscript template textarea iframe svg".split())
HOLDERS = ("article", "main", "h1")
MARKS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer gdpr masthead menu menus nav navbar navigation newsletter notice notices popup promo related reply replies share sharing sidebar sidebars social sponsor sponsored subscribe toolbar widget".split()
)
UNMARKED = frozenset("html body main article".split())
NAMED = frozenset("h1 h2 h3 h4 h5 h6 section".split())
#: Elements that run on in a line; every other tag ends a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements inside a text; all others are containers, whose paths tell templates apart.
CONTENT = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre figure figcaption picture audio video table caption colgroup thead tbody tfoot tr td th address details summary hgroup fieldset legend center".split())
OUTLINE = "struct<template:bigint,blocks:array<struct<path:array<string>,marked:boolean,text:bigint,chars:bigint,article:array<string>,main:array<string>>>>"
BLOCKS = pa.list_(pa.struct([("path", pa.list_(pa.string())), ("marked", pa.bool_()), ("text", pa.int64()), ("chars", pa.int64()), ("article", pa.list_(pa.string())), ("main", pa.list_(pa.string()))]))
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(noscript|template|textarea|iframe|svg)\b[^>]*(?<!/)>.*?</\2\s*>|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", raw text, ""), ("open", name, class and id words, each with # before it in an anchor) and ("close", name, ""); scripts, styles and comments are left out."""
    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            yield "text", page[at : m.start()], ""
        at = m.end()
        if m[4] and (name := m[4].lower()) not in RAW:
            if m[3]:
                yield "close", name, ""
            else:
                words = " ".join(("#" if name in NAMED and x[1].lower() == "id" else "") + next(filter(None, x.groups()[1:]), "") for x in _ATTR.finditer(m[5])).lower() if m[5] else ""
                yield "open", name, words
                if name in VOID or m[5].endswith("/") and name not in INLINE and name != "p":
                    yield "close", name, ""
    if at < len(page):
        yield "text", page[at:], ""


def marked(name: str, words: str) -> bool:
    return name == "form" or bool(words) and name not in UNMARKED and not MARKS.isdisjoint(words.split())


class Walk:
    """The open elements, as tags come; unclosed ones end with what holds them, and a paragraph with the next.

    Each is (name, label, kind, ordinal): kind is 3 for an element of OUTSIDE, 2 for a header, 1 for a marked one, else 0. The ordinals in
    `holding` are of elements that hold the article: their marks don't count.
    """

    def __init__(self, holding: frozenset[int] = frozenset()):
        self.open: list[tuple[str, str, int, int]] = []
        self.holding, self.seen = holding, 0

    def step(self, kind: str, name: str, words: str) -> None:
        if kind == "open":
            if name in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and any(x[0] == name for x in self.open[-3:]):
                self._close(name)
            own = 3 if name in OUTSIDE else 2 if name == "header" or "header" in words.split() else int(marked(name, words))
            self.open.append((name, label(name, words), 0 if own == 1 and self.seen in self.holding else own, self.seen))
            self.seen += 1
        elif kind == "close" and any(x[0] == name for x in self.open):
            self._close(name)

    def _close(self, name: str) -> None:
        while self.open.pop()[0] != name:
            pass

    def path(self) -> tuple[str, ...]:
        return tuple(x[1] for x in self.open)

    def skipped(self, holds: int = 0) -> bool:
        """Inside what holds no article text; the first elements, as many as holds, hold the article, whatever their class."""
        inside = holds > 0 and self.open[holds - 1][0] not in ("html", "body")
        for k, x in enumerate(self.open):
            if x[0] in ("article", "main"):
                inside = True
            if x[2] == 3 or k >= holds and (x[2] == 1 or x[2] == 2 and not inside):
                return True
        return False


def holding(parts: list[tuple[str, str, str]]) -> frozenset[int]:
    """Ordinals of the elements that hold the first of an article, a main and an h1 element. One in a header or in an element of OUTSIDE doesn't count, nor, after another was found, one in a marked element."""
    walk, found, left = Walk(), set(), set(HOLDERS)
    for kind, name, words in parts:
        if kind == "text":
            continue
        if kind == "open" and name in left and all(x[2] < 2 and (not x[2] or not found or x[3] in found) for x in walk.open):
            left.discard(name)
            found |= {-1, *(x[3] for x in walk.open)}
        walk.step(kind, name, words)
        if not left:
            break
    return frozenset(found)


def label(name: str, words: str) -> str:
    """An element as a path names it; numbers in its class or id don't tell pages apart."""
    return name + ("." + ".".join(sorted({w for w in _SPLIT.split(words) if w and not any(c.isdigit() for c in w)})) if words else "")


@dataclass
class Node:
    """A token of a wrapper, or a repeated group of them. texts: what stood there in the pages so far."""

    key: tuple
    texts: set = field(default_factory=set)
    chars: int = 0
    optional: bool = False

    @property
    def slot(self) -> bool:
        return len(self.texts) > 1


def stream(page: str) -> list[Node]:
    out = []
    for kind, name, words in tokens(page):
        if kind == "text":
            text = " ".join(entities.unescape(name).split())
            if text:
                out.append(Node(("#",), {text}, len(text)))
        else:
            out.append(Node((("<" if kind == "open" else "</") + label(name, words),)))
    return out


def fold(nodes: list[Node], known: set[tuple]) -> list[Node]:
    """Runs of an equal unit, and single units that other pages repeat, become one repeated group."""
    out, i = [], 0
    keys = [n.key for n in nodes]
    while i < len(nodes):
        for size in range(1, min(UNIT, len(nodes) - i) + 1):
            unit = tuple(keys[i : i + size])
            n = 1
            while keys[i + n * size : i + (n + 1) * size] == list(unit):
                n += 1
            if (n > 1 or unit in known) and any(k == ("#",) for k in unit) and unit[0] != ("#",):
                inside = nodes[i : i + n * size]
                out.append(Node(("+", unit), set().union(*(x.texts for x in inside)), sum(x.chars for x in inside)))
                i += n * size
                break
        else:
            out.append(nodes[i])
            i += 1
    return out


def units_of(nodes: list[Node]) -> set[tuple]:
    return {n.key[1] for n in nodes if n.key[0] == "+"}


def infer(pages: list[str]) -> list[Node]:
    """The wrapper of some pages of a host."""
    streams = [stream(p) for p in pages]
    known = set().union(*(units_of(fold(s, set())) for s in streams)) if streams else set()
    wrapper: list[Node] = []
    for k, s in enumerate(streams):
        page = fold(s, known)
        if not k:
            wrapper = page
            continue
        merged: list[Node] = []
        for what, a, b, c, d in SequenceMatcher(None, [n.key for n in wrapper], [n.key for n in page], autojunk=False).get_opcodes():
            if what == "equal":
                for x, y in zip(wrapper[a:b], page[c:d]):
                    x.texts |= y.texts
                    x.chars += y.chars
                    merged.append(x)
            else:
                for x in wrapper[a:b] + page[c:d]:
                    x.optional = True
                    merged.append(x)
        wrapper = merged
    return wrapper


def expression(wrapper: list[Node]) -> str:
    """The wrapper as a union-free regular expression."""
    def one(n: Node) -> str:
        body = "( " + " ".join("#text" if k == ("#",) else k[0] for k in n.key[1]) + " )+" if n.key[0] == "+" else ("#text" if n.slot or n.key != ("#",) else repr(min(n.texts)))
        if n.key[0] not in ("+", "#"):
            body = n.key[0]
        return f"( {body} )?" if n.optional else body

    return " ".join(map(one, wrapper))


def container(path: tuple[str, ...]) -> tuple[str, ...]:
    """The path up to its last element that isn't a paragraph, heading, list, table cell or the like."""
    n = len(path)
    while n and path[n - 1].split(".")[0] in CONTENT:
        n -= 1
    return path[:n]


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def outer(path: tuple[str, ...], name: str) -> list[str] | None:
    """The path up to its outermost element of that name."""
    return next((list(path[: k + 1]) for k, x in enumerate(path) if x.split(".")[0] == name), None)


def outline(page: str) -> tuple[int, list[dict]]:
    """The template of a page (a digest of the paths of its containers) and its blocks with text: path, whether it is in a marked element, digest of the text, characters."""
    parts = list(tokens(page))
    walk, boxes, texts = Walk(holding(parts)), set(), {}
    for kind, name, words in parts:
        if kind == "text":
            if not walk.skipped(len(walk.open)) and (text := " ".join(name.split())):
                path = walk.path()
                n = len(path)
                while n and path[n - 1].split(".")[0] in INLINE:
                    n -= 1
                texts.setdefault((path[:n], walk.skipped()), []).append(text)
            continue
        walk.step(kind, name, words)
        if kind == "open" and name not in INLINE and name not in CONTENT and name not in VOID and not walk.skipped():
            boxes.add("/".join(walk.path()))
    blocks = []
    for (path, inside), some in texts.items():
        text = " ".join(some)
        blocks.append({"path": list(path), "marked": inside, "text": digest(text), "chars": len(text), "article": outer(path, "article"), "main": outer(path, "main")})
    return digest("\n".join(sorted(boxes))), blocks


def main_text(page: str, path: tuple[str, ...] = ()) -> str:
    """The text inside the element at path; a page without it is read by its own article or main element, else whole but for what is skipped(), and if nothing is left, whole but for OUTSIDE."""
    found: dict[str, list[str]] = {"wrapper": [], "article": [], "main": [], "page": [], "rest": []}
    parts = list(tokens(page))
    walk = Walk(holding(parts))
    for kind, name, words in parts:
        if kind == "text":
            if not name:
                continue
            text = entities.unescape(name) if "&" in name else name
            if path and walk.path()[: len(path)] == path and not walk.skipped(len(path)):
                found["wrapper"].append(text)
            if not walk.skipped():
                names = {x[0] for x in walk.open}
                for k in ("article", "main"):
                    if k in names:
                        found[k].append(text)
                found["page"].append(text)
            if not walk.skipped(len(walk.open)):
                found["rest"].append(text)
            continue
        walk.step(kind, name, words)
        if name not in INLINE:
            for some in found.values():
                some.append(" ")
    for some in found.values():
        if text := " ".join("".join(some).split()):
            return text
    return ""


def _host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


def wrappers(pages: DataFrame) -> DataFrame:
    """host, template and path for each template of a host, from all of pages (host, html); equal pages count once.

    A block is a slot where more than one in TWENTY pages of the template differ from the most frequent text, and in a template of under FEW
    pages also where most texts of that path on the host differ. The path is the article or main element with most text in
    slots, else the deepest container that holds all slots; slots in marked elements count where there are no others.
    """
    @F.arrow_udf(OUTLINE)
    def shape(cols: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in cols:
            got = [outline(h.as_py() or "") for h in col]
            yield pa.StructArray.from_arrays([pa.array([t for t, _ in got], pa.int64()), pa.array([b for _, b in got], BLOCKS)], names=["template", "blocks"])

    once = pages.select("host", F.xxhash64("html").alias("page"), shape(F.col("html")).alias("o")).select("host", "page", "o.*")
    once = once.groupBy("host", "page", "template").agg(F.first("blocks").alias("blocks"))
    texts = once.select("host", "template", F.explode("blocks").alias("b")).groupBy("host", "template", "b.path", "b.marked", "b.text").agg(F.count("*").alias("n"), F.sum("b.chars").alias("chars"), F.first("b.article").alias("article"), F.first("b.main").alias("main"))
    texts = save(texts)
    size = ["host", "template", "path", "marked"]
    blocks = texts.groupBy(*size).agg(F.sum("n").alias("n"), F.max("n").alias("top"), F.sum("chars").alias("chars"), F.first("article").alias("article"), F.first("main").alias("main"))
    hosts = texts.groupBy("host", "path", "marked", "text").agg(F.sum("n").alias("n")).groupBy("host", "path", "marked").agg(F.sum("n").alias("all_n"), F.count("*").alias("kinds"))
    differs = TWENTY * (F.col("n") - F.col("top")) > F.col("n")
    slots = blocks.where(differs)
    pages_n = F.max("n").over(Window.partitionBy("host", "template"))
    few = blocks.withColumn("pages_n", pages_n).where(~differs & (F.col("pages_n") < FEW)).drop("pages_n").join(hosts, ["host", "path", "marked"]).where(2 * F.col("kinds") > F.col("all_n")).select(*slots.columns)
    keys = ["host", "template"]
    part = slots.unionByName(few).groupBy(*keys, "marked", "article", "main").agg(F.sum("chars").alias("chars"), F.min("path").alias("lo"), F.max("path").alias("hi"))
    part = part.withColumn("first", F.min("marked").over(Window.partitionBy(*keys))).where(F.col("marked") == F.col("first"))
    ends = part.groupBy(*keys).agg(
        F.max_by("article", F.when(F.col("article").isNotNull(), F.col("chars"))).alias("article"), F.max_by("main", F.when(F.col("main").isNotNull(), F.col("chars"))).alias("main"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )

    @F.arrow_udf("array<string>")
    def shared(los: pa.Array, his: pa.Array) -> pa.Array:
        return pa.array([container(tuple(os.path.commonprefix([a, b]))) for a, b in zip(los.to_pylist(), his.to_pylist())], pa.list_(pa.string()))

    return ends.select(*keys, F.coalesce("article", "main", shared(F.col("lo"), F.col("hi"))).alias("path"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of each row.

    Null and empty pages give ''; a null or odd url counts as a host of its own kind. Repeated rows each have a result;
    other columns are not read.
    """
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    p = p.withColumn("host", _host(F.col("url")))
    known = save(wrappers(p))
    broad = known.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(F.concat_ws("/", "path"))), F.lit(0)).alias("size")).first()

    @F.arrow_udf("long")
    def template(cols: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for html in cols:
            yield pa.array([outline(h.as_py() or "")[0] for h in html], pa.int64())

    p = p.withColumn("template", template(F.col("html")))
    if broad.n <= HOSTS and broad.size <= HOSTS * PATH:
        joined = p.join(F.broadcast(known), ["host", "template"], "left")
    else:  # a hot template is dealt out by a salt
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        joined = p.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(known.withColumn("salt", salts), ["host", "template", "salt"], "left")

    @F.arrow_udf("string")
    def read(cols: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for html, path in cols:
            yield pa.array([main_text(h.as_py() or "", tuple(q or ())) for h, q in zip(html, path.to_pylist())], pa.string())

    done = joined.select("page_id", "url", read(F.col("html"), F.col("path")).alias("text"))
    return done.withColumn("n_chars", F.length("text").cast("long"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
