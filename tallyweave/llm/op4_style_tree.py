"""Main text of pages by a site style tree.

The DOMs of a host are merged: a node of the tree is a chain of element styles (tag, class, id) from the root. A node's importance is
the greater of two: of its presentation, the entropy of the child sequences it takes over the host's pages; of its
content, one less the mean entropy with which its texts are spread over those pages. Both are relative to the logarithm of the number of
pages with the node. Each is drawn towards the same node's in the tree of all hosts, which counts as much as PRIOR pages: so a host of one page is judged by what
other hosts have there, and one of many by itself, without a threshold of pages in between. Texts right below nodes of less than
THRESHOLD are cut from each page, as are those that HTML itself or their own names mark as no content; what a page's
article or main element holds is preferred. Pages of a host with the same texts count once, else the tree would take copies for boilerplate; a page
of boilerplate alone has no main text.

At scale: pages are parsed twice; what is shuffled in between is (host, node, text hash) with partial sums. The nodes cut, a short list a host, are joined to the pages by
a join whose hot keys Spark splits, as both sides are dealt out for it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_dealt_anew, table, written

THRESHOLD = 0.7
#: Pages that the tree of all hosts counts for in a host's own.
PRIOR = 8

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?/][^>]*>""", re.S)
NAMED = re.compile(r"""(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(?=[\s/]|$))|"[^"]*"|'[^']*'""", re.I)
# Kinds of elements in HTML.
RAW = frozenset("script style noscript template textarea title svg math iframe object canvas xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
CUT_TAGS = frozenset("head nav footer aside form button select option menu dialog audio video map applet fieldset legend datalist".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
# Whole class names and ids, `_` read as `-`; those of the second list hold within an article too, where a name says less.
CUT_NAMES = frozenset(
    "ads adv adsense sponsor sponsored sponsors promo promotion promotions banner cookie cookies cookie-banner cookie-notice cookie-consent consent gdpr notice notices notification notifications popup modal overlay newsletter subscribe subscription "
    "sidebar side-bar left-sidebar right-sidebar rail widget widgets menu menus main-menu nav navbar nav-bar navigation main-nav site-nav breadcrumb breadcrumbs crumbs pagination pager footer site-footer page-footer masthead topbar toolbar site-header page-header "
    "share sharing share-bar share-buttons social social-links related related-posts related-articles recommended recommendations trending login signup search search-form skip-link copyright disclaimer alert".split()
)
CUT_ANYWHERE = frozenset("ad advert adverts advertisement ad-slot ad-banner comment-list comments comments-section comment-section comment-form comments-area disqus disqus-thread".split())
# Elements that the start of another closes.
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"})}
MAIN = frozenset(("article", "main"))


def hashed(text: str, seed: int = 0) -> int:
    """63 bits of a text's hash."""
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), seed) >> 1


class Node:
    __slots__ = ("cut", "kids", "main", "name", "tag")  # name: hash of the styles from the root on; kids: running hash of the child sequence

    def __init__(self, tag: str, name: int, cut: bool, main: bool) -> None:
        self.tag, self.name, self.cut, self.main, self.kids = tag, name, cut, main, 0


def blocks(page: str | None) -> tuple[list[tuple[int, bool, bool, str]], list[tuple[int, int]]]:
    """Blocks (node, within article or main, cut by a rule, text) in order, and the (node, hash of the child sequence) of each element."""
    page = page or ""
    root = Node("", 0, False, False)
    stack, out, text, styles = [root], [], [], []
    at, end = 0, len(page)

    def flush() -> None:
        if text:
            node = stack[-1]
            said = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if said:
                out.append((node.name, node.main, node.cut, said))

    def pop(i: int) -> None:
        for n in stack[i:]:
            if n.tag not in INLINE:
                styles.append((n.name, n.kids))
        del stack[i:]

    while at < end:
        m = TOKEN.search(page, at)
        if not m:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    if stack[-1].cut != stack[i - 1].cut or any(n.tag not in INLINE for n in stack[i:]):
                        flush()
                    pop(i)
                    break
            else:
                if tag not in INLINE:
                    flush()
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if tag == "br":
            text.append(" ")
        if tag not in INLINE:
            flush()
            if tag in CLOSES_P:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == "p":
                        pop(i)
                        break
                    if stack[i].tag not in INLINE:
                        break
            if tag in SAME:
                closes, within = SAME[tag]
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in within:
                        break
                    if stack[i].tag in closes.split():
                        pop(i)
                        break
        if tag in VOID:
            continue
        parent, attrs = stack[-1], m[3] or m[6] or ""
        names = {a.lower(): b or c or d for a, b, c, d in NAMED.findall(attrs) if a} if attrs else {}
        style = tag + "".join("." + re.sub(r"\d+", "#", names[k].strip().lower()) for k in ("class", "id") if names.get(k))
        main = parent.main or tag in MAIN
        cut = parent.cut or tag in CUT_TAGS or tag == "header" and not parent.main or names.get("role", "").lower() in CUT_ROLES
        if names and not cut and tag not in ("html", "body"):
            called = {x.lower().replace("_", "-") for k in ("class", "id") for x in names.get(k, "").split()}
            cut = tag not in MAIN and (not called.isdisjoint(CUT_ANYWHERE) or not main and not called.isdisjoint(CUT_NAMES))
            cut = cut or "hidden" in names or names.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none", names.get("style", ""), re.I))
        if tag not in INLINE:
            parent.kids = hashed(style, parent.kids)
        if cut != parent.cut and tag in INLINE:
            flush()
        stack.append(Node(tag, hashed(style, parent.name) if tag not in INLINE else parent.name, cut, main))
        if attrs.endswith("/") and tag in INLINE:
            stack.pop()
    flush()
    pop(1)
    return out, styles


def main_text(page: str | None, low: frozenset[int]) -> str:
    """The blocks that neither a rule nor the tree cuts, an empty line between them."""
    found, _ = blocks(page)
    ruled = [(node, main, said) for node, main, cut, said in found if not cut]
    inside = [x for x in ruled if x[1]] or ruled
    return "\n\n".join(said for node, _, said in inside if node not in low)


def _host(url: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _importance(features: DataFrame, by: list[str]) -> DataFrame:
    """(by, pages, presentation, content) from (by, kind, feature, n): n pages have the node (kind 0), a text right below it (1), a child sequence (2)."""
    n, ln = F.col("n"), F.col("n") * F.log("n")
    of = lambda k, x: F.coalesce(F.sum(F.when(F.col("kind") == k, x)), F.lit(0))
    nodes = features.groupBy(*by).agg(of(0, n).alias("pages"), of(1, n).alias("s"), of(1, ln).alias("t"), of(2, n).alias("u"), of(2, ln).alias("v"))
    base = F.log(F.greatest("pages", F.lit(2)))
    content = F.when(F.col("s") > 0, 1 - F.col("t") / base / F.col("s"))
    return nodes.select(*by, "pages", F.when(F.col("u") > 0, (F.log("u") - F.col("v") / F.col("u")) / base).otherwise(0.0).alias("presentation"), content.alias("content"))


def style_tree(pages: DataFrame, prior: int = PRIOR) -> DataFrame:
    """(host, node, pages, presentation, content, importance), a row for each node of each host's tree; no text right below it: null content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple[str, int, int, int, int]] = []
            for host, page in zip(b.column(0), b.column(1), strict=True):
                found, styles = blocks(page.as_py())
                h, seen, page_of = host.as_py(), set(), 0
                for node, _, _, said in found:
                    page_of = hashed(said, page_of)
                    seen.add((node, 1, hashed(said)))
                    seen.add((node, 0, 0))
                for node, kids in styles:
                    seen.add((node, 2, kids))
                    seen.add((node, 0, 0))
                rows += [(h, *x, page_of) for x in seen]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], ["host", "node", "kind", "feature", "page"])

    key = ["host", "node", "kind", "feature"]
    rows = pages.select(_host().alias("host"), "html").mapInArrow(run, "host string, node long, kind int, feature long, page long")
    features = written(rows.distinct().groupBy(*key).agg(F.count("*").alias("n")), "features")
    own = _importance(features, ["host", "node"])
    every = _importance(features.groupBy("node", "kind", "feature").agg(F.sum("n").alias("n")), ["node"])
    every = every.select("node", F.col("presentation").alias("p"), F.col("content").alias("c"))
    drawn = lambda a, b: (F.col("pages") * F.col(a) + prior * F.col(b)) / (F.col("pages") + prior)
    tree = join_dealt_anew(own, every, ["node"])
    return tree.select("host", "node", "pages", "presentation", "content", F.greatest(drawn("presentation", "p"), drawn("content", "c")).alias("importance"))


def extract(pages: DataFrame, threshold: float = THRESHOLD, prior: int = PRIOR) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars.

    Null and empty html give the empty string; a null url is a host of its own name (empty). A page that loses all its text has the empty string. Repeated rows stay repeated; an empty table gives no row; further columns are ignored.
    """
    tree = style_tree(pages, prior).where(F.col("content").isNotNull() & (F.col("importance") < threshold))
    low = written(tree.groupBy("host").agg(F.collect_set("node").alias("low")), "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets: dict[tuple, frozenset] = {}
            texts = []
            for page, cut in zip(b.column(2), b.column(3), strict=True):
                key = tuple(cut.as_py() or ())
                texts.append(main_text(page.as_py(), sets.setdefault(key, frozenset(key))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    hosted = pages.select(F.col("page_id").cast("long"), "url", "html", _host().alias("host"))
    hosted = join_dealt_anew(hosted, low, ["host"], "left")
    return hosted.select("page_id", "url", "html", "low").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op4_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
