"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree whose nodes are paths of block elements with their class and id
(digits alike). For each node over the m distinct pages that hold text in it or below it:

* content importance: 1 - mean over the distinct texts below it of log_m(pages that hold the text), so texts
  that stand on every page weigh nothing and texts of one page weigh fully;
* presentation importance: the entropy of the sequences of child elements it shows, to the base of their number;
* importance: (1 - GAMMA) * presentation + GAMMA * content.

A branch that is below LEAST with all branches in it, each on at least MIN_PAGES distinct pages, is removed from
each page of the host, besides branches that their own elements or names mark as menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles or reader comments. A name is a mark only by itself: not negated ("no-sidebar", "ad-free"), not
of a layout ("content-sidebar-wrap") or of an article's own header. Words that often name content as well
("form", "search", "tags") mark nothing; the tree decides. No name drops a branch that is or holds a page's only
article or main element, or most of the page's text; reader comments beside an article are dropped at any size.
A page whose names mark all of its text keeps it; text beside a marked article stays where there is more of it. Where a page has an article (or main) element, its text is what is left
inside, whatever stands around it; else what is left of the body. Plain text elements directly in the article are content by declaration
and are not removed for being repeated.

Statistics are counted per (host, node, text) over distinct pages with partial aggregation, so one host may
hold most pages; low branches are joined to pages by salted host. Null or empty html gives empty text. Null or
odd urls share the host "". Repeated rows are extracted each on their own; copies of a page count once. An empty
table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dist import lean, ship, stage
from .text import blocks

GAMMA, LEAST, MIN_PAGES, SALTS = 0.9, 0.2, 8, 16

#: Elements whose text is never content, such elements inside a line of text, elements whose content is raw, block elements, and elements without an end tag.
DROPPED = {"head", "nav", "footer", "aside", "form", "label", "fieldset", "dialog", "menu", "title"}
HUSHED = {"script", "style", "noscript", "template", "svg", "annotation", "annotation-xml", "iframe", "object", "canvas", "audio", "video", "button", "select", "textarea"}
RAW = {"script", "style", "textarea", "title", "iframe", "noscript", "xmp"}
BLOCK = DROPPED | {"html", "body", "article", "main", "header", "section", "div", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "blockquote", "pre", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "figure", "figcaption", "address", "hr", "details", "summary", "center"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
TEXTUAL = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "blockquote", "pre", "table", "thead", "tbody", "tr", "td", "th", "figure", "figcaption"}
#: Words of a class or id that mark a branch as not content, those of reader comments, and roles.
COMMENTS = {"comment", "comments", "reply", "replies", "disqus", "respond"}
MARKS = COMMENTS | {
    "ad", "ads", "advert", "advertisement", "adverts", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "popup", "modal",
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager",
    "header", "masthead", "topbar", "footer", "sidebar", "aside", "rail", "related", "recommended",
    "cookie", "cookies", "consent", "gdpr", "newsletter", "subscribe", "subscription", "signup", "login", "searchbox",
}
ROLES = {"banner", "navigation", "menu", "menubar", "complementary", "contentinfo", "search", "form", "dialog", "alert"}
#: Words that turn a name around or make it a layout's, marks that stand for a place on the page, and words before these that name content.
NEGATED = {"no", "non", "not", "without", "free", "less", "off", "with", "has", "layout", "open", "closed"}
PLACES = {"header", "masthead", "banner", "sidebar", "aside", "rail"}
CONTENT = {"content", "article", "post", "entry", "story", "section", "page"}

# a quote opens a value after "=" only; one that is never closed ends with its tag
_TOKEN = re.compile(r"""<!--(?:.*?-->|.*)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)>|<[!?][^>]*>""", re.S)
_ATTR = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""")
_MAIN = re.compile(r"(article|main)\b|.*\[main\]")
_CLOSES_P = BLOCK - {"li", "td", "th", "tr", "thead", "tbody", "tfoot", "caption", "dt", "dd", "body", "html", "head"}
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
_STOP = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tr": {"table"}, "option": {"select"}}


class Node:
    __slots__ = ("children", "dropped", "hushed", "label", "main", "marked", "path", "tag")

    def __init__(self, tag: str, label: str, parent: Node | None, dropped: bool, marks: frozenset[str] = frozenset()):
        self.tag, self.label, self.children = tag, label, []
        self.path = f"{parent.path}/{label}" if parent else label
        self.dropped = dropped or bool(parent and parent.dropped)
        self.hushed = bool(parent and parent.hushed) or tag in HUSHED
        self.main = bool(parent and parent.main) or (tag in ("article", "main") or "[main]" in label)
        #: each marked branch that the node is or is in, outermost first: the branch's node, and whether it is of comments
        self.marked = parent.marked if parent else ()
        if marks:
            self.marked += ((self, bool(marks & COMMENTS)),)


def _marks(name: str) -> set[str]:
    """Words by which one class or id marks its branch."""
    words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w]
    if NEGATED & set(words):
        return set()
    if "hidden" in words and len(words) == 1:
        return {"hidden"}
    return {w for k, w in enumerate(words) if w in MARKS and not (w in PLACES and CONTENT & set(words[:k]))}


def _label(tag: str, attrs: str) -> tuple[str, bool, frozenset[str]]:
    """Element with its class and id, digits alike; whether it is never content; the words of its names that mark it as not content."""
    dropped = tag in DROPPED
    if not attrs.strip():
        return tag, dropped, frozenset()
    got = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(attrs)}
    names = [*got.get("class", "").split(), got.get("id", "")]
    marks = frozenset().union(*map(_marks, names), ROLES & set(got.get("role", "").lower().split())) if tag not in ("html", "body") else frozenset()
    dropped |= "hidden" in got or got.get("aria-hidden") == "true" or "display:none" in got.get("style", "").replace(" ", "")
    label = tag + "".join(f".{x}" for x in got.get("class", "").split()) + (f"#{got['id']}" if got.get("id") else "") + ("[main]" if got.get("role") == "main" else "")
    return re.sub(r"\d+", "0", label.replace("/", "|")), dropped, marks


def _after(page: str, tag: str, at: int) -> int:
    close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
    return close.end() if close else len(page)


def parse(page: str) -> list[tuple[Node, list[str]]]:
    """The page's runs of text in order, each with the innermost block element around it. Unclosed elements end with their parents."""
    root = Node("", "", None, False)
    stack, runs, at = [root], [], 0

    def text(part: str) -> None:
        if not part or stack[-1].hushed:
            return
        if not runs or runs[-1][0] is not stack[-1]:
            if not part.strip():
                return
            runs.append((stack[-1], []))
        runs[-1][1].append(part)

    def end(tag: str, stop: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == tag:
                inside = stack[k].hushed
                del stack[k:]
                if not inside:
                    mark()
                return
            if stack[k].tag in stop:
                return

    def mark() -> None:
        if runs and runs[-1][0] is not None:
            runs.append((None, []))

    while m := _TOKEN.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag == "br" or tag not in BLOCK and tag in VOID:
            text(" ")
            continue
        if tag not in BLOCK and tag not in HUSHED:
            continue
        if m[1]:
            end(tag, set())
            continue
        if tag in RAW and (tag in HUSHED or stack[-1].hushed):
            at = _after(page, tag, at)
            continue
        if tag in HUSHED or stack[-1].hushed:
            if not m[3].rstrip().endswith("/"):
                stack.append(Node(tag, tag, stack[-1], True))
            continue
        if tag in _CLOSES_P:
            end("p", {"article", "main", "section", "div", "td", "th", "li", "blockquote", "body"})
        for same in _SAME.get(tag, ()):
            end(same, _STOP[tag])
        label, dropped, marks = _label(tag, m[3])
        if tag == "header" and not stack[-1].main:
            dropped = True
        mark()
        if tag in VOID:
            continue
        node = Node(tag, label, stack[-1], dropped, marks)
        stack[-1].children.append(label)
        if tag in RAW:
            at = _after(page, tag, at)
            continue
        if not m[3].rstrip().endswith("/") or tag in TEXTUAL:
            stack.append(node)
    text(page[at:])
    return [(node, run) for node, run in runs if node is not None]


def tidy(run: list[str]) -> str:
    return " ".join(entities.unescape("".join(run)).split())


def content(page: str) -> list[tuple[Node, str]]:
    """The page's texts in order that neither their elements nor names that hold on this page drop."""
    runs = [(node, t) for node, run in parse(page) if not node.dropped and (t := tidy(run))]
    if not any(node.marked for node, _ in runs):
        return runs
    total, size, holds = sum(len(t) for _, t in runs), {}, set()
    for node, t in runs:
        for branch, _ in node.marked:
            size[branch] = size.get(branch, 0) + len(t)
            if node.main:
                holds.add(branch)
    plain = any(node.main and not node.marked for node, _ in runs)
    article = any(node.main and not any(comments for _, comments in node.marked) for node, _ in runs)

    def yields(branch: Node, comments: bool) -> bool:
        return branch in holds and not plain and not comments or size[branch] * 2 > total and not (comments and article)

    return [(node, t) for node, t in runs if all(yields(*of) for of in node.marked)] or runs


def extract(page: str | None, low: frozenset[str] = frozenset()) -> str:
    """Main text of a page. low: paths of the host's branches of low importance."""
    if not page:
        return ""
    runs = content(page)
    main = [r for r in runs if r[0].main]
    plain = sum(len(t) for node, t in runs if not node.marked)
    if any(not node.marked for node, _ in main) or main and plain <= sum(len(t) for _, t in main):
        runs = main
    if low:
        runs = [r for r in runs if not any(_removed(p, low) for p in _above(r[0].path))]
    return "\n".join(t for _, t in runs)


def _above(path: str) -> Iterator[str]:
    """The branches that may take a text along: all above it, up to its article."""
    parts = path.split("/")
    main = next((k for k, p in enumerate(parts) if _MAIN.match(p)), 0)
    return ("/".join(parts[: k + 1]) for k in range(main + 1, len(parts)))


def _removed(path: str, low: frozenset[str]) -> bool:
    if path not in low:
        return False
    parts = path.split("/")
    inside = any(_MAIN.match(p) for p in parts[:-1])
    return parts[-1] not in ("html", "body") and not _MAIN.match(parts[-1]) and not (inside and parts[-1] in TEXTUAL)


def _hash(x: str) -> int:
    return int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct (node, feature) of each page that is not marked already: kind 0 texts, kind 1 sequences of children, kind 2 that the page holds the node."""
    for batch in blocks(batches, "html"):
        rows = []
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            if not page:
                continue
            digest, seen = _hash(page), set()
            for node, t in content(page):
                seen.add((node.path, 0, _hash(t)))
                parts = node.path.split("/")
                seen.update(("/".join(parts[: k + 1]), 2, 0) for k in range(1, len(parts)))
                if node.children:
                    seen.add((node.path, 1, _hash("\0".join(dict.fromkeys(node.children)))))
            rows += [(host, p, k, f, digest) for p, k, f in seen]
        if rows:
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["host", "path", "kind", "feature", "page"])


#: The paths of a node and of all nodes above it.
_ABOVE = "transform(sequence(2, size(split(path, '/'))), k -> array_join(slice(split(path, '/'), 1, k), '/'))"


def importance(pages: DataFrame) -> DataFrame:
    """host, path, m (distinct pages) and importance of each node of each host's style tree; 1 on a single page. pages: host, html."""
    ship(pages.sparkSession)
    rows = pages.select("host", "html").mapInArrow(lean(_features), "host string, path string, kind int, feature long, page long").distinct()
    by = rows.groupBy("host", "path", "kind", "feature").agg(F.count(F.lit(1)).alias("n"))
    nodes = by.groupBy("host", "path", "kind").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.log("n")).alias("log_n"), F.sum("n").alias("total"), F.sum(F.col("n") * F.log("n")).alias("n_log_n"))
    # every node above a text shares its content
    text, own, held = F.col("kind") == 0, F.col("kind") == 1, F.col("kind") == 2
    spread = nodes.select("host", F.explode(F.when(text, F.expr(_ABOVE)).otherwise(F.array("path"))).alias("node"), "kind", "texts", "log_n", "total", "n_log_n")
    tree = spread.groupBy("host", F.col("node").alias("path")).agg(
        F.max(F.when(held, F.col("total"))).alias("m"), F.sum(F.when(text, F.col("texts"))).alias("texts"), F.sum(F.when(text, F.col("log_n"))).alias("log_n"),
        F.max(F.when(own, F.col("total"))).alias("shown"), F.max(F.when(own, F.col("n_log_n"))).alias("n_log_n"),
    )
    content = F.greatest(F.lit(0.0), 1 - F.col("log_n") / F.col("texts") / F.log("m"))
    presentation = F.coalesce((F.log("shown") - F.col("n_log_n") / F.col("shown")) / F.log("shown"), F.lit(0.0))
    weight = (1 - GAMMA) * F.when(F.col("shown") > 1, presentation).otherwise(0.0) + GAMMA * content
    return tree.select("host", "path", "m", F.when(F.col("m") > 1, weight).otherwise(1.0).alias("importance"))


#: Of the labels of a path: whether each is of an article, and how many are up to and with the first of those, or the root.
_PARTS, _UP_TO = "split(path, '/')", "greatest(array_position(transform(split(path, '/'), p -> p RLIKE '^((article|main)\\\\b|.*\\\\[main\\\\])'), true), 1)"


def low_branches(tree: DataFrame, least: float = LEAST, min_pages: int = MIN_PAGES) -> DataFrame:
    """host and path of each node of importance's tree that may go, is low itself and holds no node that is not: one with a page's own text below it stays.

    Nodes below another of them are left out, so what a host keeps grows with its templates, not with its pages or nodes.
    """
    high = (~((F.col("m") >= min_pages) & (F.col("importance") < least))).cast("int")
    low = tree.select("host", F.explode(F.expr(_ABOVE)).alias("path"), high.alias("high")).groupBy("host", "path").agg(F.max("high").alias("high")).where("high = 0").select("host", "path")
    tag = F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"^[^.#\[]*", 0)
    inside = F.expr(f"array_position(transform(slice({_PARTS}, 1, size({_PARTS}) - 1), p -> p RLIKE '^((article|main)\\\\b|.*\\\\[main\\\\])'), true) > 0")
    low = low.where(~tag.isin("html", "body", "article", "main") & ~F.element_at(F.split("path", "/"), -1).endswith("[main]") & ~(inside & tag.isin(*sorted(TEXTUAL))))
    # paths of the branches above, down from the article
    above = F.expr(f"CASE WHEN {_UP_TO} + 1 < size({_PARTS}) THEN transform(sequence({_UP_TO} + 1, size({_PARTS}) - 1), k -> array_join(slice({_PARTS}, 1, k), '/')) ELSE array() END")
    of = low.select("host", "path", F.explode(above).alias("over"))
    under = of.join(low.select(F.col("host").alias("low_host"), F.col("path").alias("low_path")), (F.col("host") == F.col("low_host")) & (F.col("over") == F.col("low_path")), "left_semi")
    return low.join(under.select("host", "path").distinct(), ["host", "path"], "left_anti")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[tuple, frozenset] = {}
    for batch in blocks(batches, "html"):
        text = []
        for page, low in zip(batch.column("html").to_pylist(), batch.column("low").to_pylist(), strict=True):
            key = tuple(low or ())
            if key not in known:
                if len(known) > 1000:
                    known.clear()
                known[key] = frozenset(key)
            text.append(extract(page, known[key]))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string())], ["page_id", "url", "text"])


def main_text(pages: DataFrame, least: float = LEAST, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages."""
    ship(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))
    low = low_branches(stage(importance(own), "tree"), least, min_pages)
    low = stage(low.groupBy(F.col("host").alias("low_host")).agg(F.array_sort(F.collect_set("path")).alias("low")), "style-tree")
    salted = low.withColumn("low_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = own.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, (F.col("host") == F.col("low_host")) & (F.col("salt") == F.col("low_salt")), "left")
    out = joined.select("page_id", "url", "html", "low").mapInArrow(lean(_extract), "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
