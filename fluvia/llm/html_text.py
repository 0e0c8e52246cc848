"""Main text of web pages by a site style tree: pages of a host are merged, and branches of low importance removed."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvia.llm.common import checkpointed, map_slices, table

#: A node's importance is (1 - CONTENT) of its presentation's and CONTENT of its texts'; below LOW it is removed, if its host has
#: LEAST pages with it at least (with fewer, entropy tells nothing).
CONTENT, LOW, LEAST = 0.9, 0.25, 5
#: Removed branches of all hosts that are sent to every task at most; more of them are joined to the pages instead.
FEW = 50_000

# Elements by what they mean in HTML, and words that name parts of a page in class, id or role.
RAW = frozenset("script style noscript template iframe textarea title svg math object canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
NO_CONTENT = frozenset("nav header footer aside form button select dialog menu head fieldset".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody"), "body": ("head",)}
SCOPE = frozenset("ul ol dl table div article section main aside nav body html td th".split())
PARTS = frozenset(
    "nav navbar navigation menu menubar topbar header footer masthead sidebar aside ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social breadcrumb breadcrumbs related recommended comment comments disqus respond reply replies widget toolbar pagination pager search contentinfo complementary".split()
)

#: Of these, words that mean what readers wrote or advertisers placed hold for an article element too; with a word that only
#: tells of a part elsewhere, as in has-sidebar, the others say nothing.
OTHERS = frozenset("ad ads advert adverts advertisement sponsor sponsored promo promotion related recommended comment comments disqus respond reply replies".split())
TELLING = frozenset("has have no with without".split())

NAME = re.compile(r"(/?)([A-Za-z][^\s/>]*)")
ATTRIBUTES = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
WORD = re.compile(r"[A-Za-z]+")


class Node:
    """An element: hard and soft tell that its tag or its class says that it isn't content; an article within what is only
    soft is content again. up is the next element around it that isn't inline, so a block needs no list of what is around it."""

    __slots__ = ("tag", "path", "hard", "soft", "article", "children", "up", "low")

    def __init__(self, tag: str, path: int, hard: bool, soft: bool, article: bool, up: "Node | None" = None):
        self.tag, self.path, self.hard, self.soft, self.article, self.children, self.up, self.low = tag, path, hard, soft, article, [], up, False


def short_hash(s: str) -> int:
    return int.from_bytes(xxhash.xxh64_digest(s.encode("utf-8", "surrogatepass")), "big", signed=True)


def tokens(page: str) -> Iterator[tuple[str, str, str, int]]:
    """(text, tag, attributes, kind) from a page's start to its end: kind 0 is text, 1 a start tag, 2 an end tag. Comments and
    declarations are left out, and what stands in elements whose content is no text. Work is in proportion to the page: a tag
    that doesn't end is text, and after a quote that doesn't close no quotes are looked for any more."""
    at, end, quotes = 0, len(page), True
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            lt = end
        if lt > at:
            yield page[at:lt], "", "", 0
        if lt == end:
            return
        if page.startswith("<!--", lt):
            close = page.find("-->", lt + 4)
            at = end if close < 0 else close + 3
            continue
        m = NAME.match(page, lt + 1)
        if not m and page[lt + 1 : lt + 2] not in ("!", "?"):
            yield "<", "", "", 0
            at = lt + 1
            continue
        done = ATTRIBUTES.match(page, m.end()) if m and quotes else None
        if done:
            at = done.end()
        else:
            quotes = quotes and not m
            close = page.find(">", lt)
            if close < 0:
                yield page[lt:], "", "", 0
                return
            at = close + 1
        if not m:
            continue
        tag = m[2].lower()
        if not m[1] and tag in RAW:
            last = re.compile(f"</{re.escape(tag)}(?![a-z0-9])", re.I).search(page, at)
            close = page.find(">", last.end()) if last else -1
            at = end if close < 0 else close + 1
            continue
        yield "", tag, page[m.end() : at - 1], 2 if m[1] else 1


def walk(page: str) -> tuple[list[tuple[str, Node]], list[Node]]:
    """Blocks in page order as (text, the element that holds it), and all elements. A path names an element by its own and its
    ancestors' tags and classes."""
    root = Node("#", 0, False, False, False)
    stack, nodes, blocks, piece = [root], [], [], []
    open_: Counter[str] = Counter()

    def flush() -> None:
        if piece:
            text = " ".join("".join(piece).split())
            piece.clear()
            if text:
                blocks.append((text, stack[-1]))

    def close(k: int) -> None:
        if any(n.tag not in INLINE for n in stack[k:]):
            flush()
        for n in stack[k:]:
            open_[n.tag] -= 1
        del stack[k:]

    for text, tag, attrs, kind in tokens(page):
        if kind == 0:
            piece.append(html.unescape(text))
            continue
        if kind == 2:
            if open_[tag]:
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
            continue
        if tag == "br":
            piece.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag not in INLINE:
            flush()
        if tag in CLOSES_P and open_["p"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag not in INLINE:
                    break
        ends = CLOSES.get(tag, ())
        k = len(stack) - 1
        while k > 0 and any(open_[x] for x in ends):
            if stack[k].tag in ends:
                close(k)
                if tag not in ("tr", "tbody", "tfoot"):
                    break
            elif stack[k].tag in SCOPE:
                break
            k -= 1
        up = stack[-1]
        names = [v.strip("\"'") for _, v in NAMED.findall(attrs)] if "=" in attrs else []
        words = {w.lower() for v in names for w in WORD.findall(v)}
        main = tag in ("article", "main")
        hard = up.hard or (tag in NO_CONTENT and not (tag == "header" and up.article))
        if main:
            soft = bool(words & OTHERS)
        else:
            named = words & PARTS - {"header"} if up.article else words & PARTS
            soft = up.soft or (tag not in ("html", "body") and bool(named) and not words & TELLING)
        node = Node(tag, up.path, hard, soft, up.article or main, up.up if up.tag in INLINE else up)
        if tag not in INLINE:
            node.path = short_hash(f"{up.path} {tag} {' '.join(sorted(words))}")
            up.children.append(tag)
            nodes.append(node)
        stack.append(node)
        open_[tag] += 1
        if attrs.endswith("/") and tag not in ("html", "body", "article", "main", "p", "div"):
            close(len(stack) - 1)
    flush()
    return blocks, nodes


def tree_rows(page: str) -> list[tuple[int, bool, int]]:
    """What a page adds to its host's tree: (path, is style, hash of the children's tags or of a text directly in it), each once.

    All elements stand in it, those of articles too. A path holds the ancestors', so an element's texts need not be counted at
    each of them.
    """
    blocks, nodes = walk(page)
    styles: dict[int, list[str]] = {}
    for n in nodes:
        styles.setdefault(n.path, []).append(" ".join(n.children))
    rows = {(p, True, short_hash("|".join(s))) for p, s in styles.items()}
    rows.update((n.path, False, short_hash(text)) for text, n in blocks)
    return sorted(rows)


def main_text(page: str, removed: set[int]) -> str:
    """The blocks that are neither dropped for their element's meaning nor under a removed path; of those that are left the ones in
    articles where there are any. If the tree would leave nothing, its say doesn't count."""
    blocks, nodes = walk(page)
    for n in nodes:  # those around a node come before it
        n.low = n.path in removed or bool(n.up and n.up.low)
    kept = [(text, n) for text, n in blocks if not (n.hard or n.soft)]
    rest = kept
    if removed:
        rest = [(text, n) for text, n in kept if not (n.up if n.tag in INLINE else n).low] or kept
    chosen = [text for text, n in rest if n.article] or [text for text, _ in rest]
    return "\n\n".join(chosen)


def _keyed(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    return pages.withColumns({"__host": host, "__key": F.xxhash64(F.col(url_col), F.col(html_col))})


def extract_text(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """pages with a column text in place of html: the main text of each row, empty if it has none.

    A null html counts as empty, a null url as a host of its own. Repeated rows are kept; a host's pages are merged by counts
    that combine before they are shuffled, so a host of any size is never gathered.
    """
    keyed = _keyed(pages, url_col, html_col)

    def rows_of(c: dict[str, list]) -> dict[str, list]:
        return {"__host": c["__host"], "__key": c["__key"], "rows": [[{"p": p, "s": s, "h": h} for p, s, h in tree_rows(x or "")] for x in c[html_col]]}

    tree = map_slices(keyed, ["__host", "__key", html_col], "__host string, __key bigint, rows array<struct<p: bigint, s: boolean, h: bigint>>", rows_of)
    flat = tree.select("__host", "__key", F.explode("rows").alias("r")).select("__host", "__key", "r.p", "r.s", "r.h")
    counts = flat.groupBy("__host", "p", "s", "h").agg(F.count(F.lit(1)).alias("c"))
    ln = F.log(F.col("c").cast("double"))
    nodes = counts.groupBy("__host", "p").agg(F.sum(F.when(F.col("s"), F.col("c"))).alias("m"), F.sum(F.when(F.col("s"), F.col("c") * ln)).alias("style"), F.avg(F.when(~F.col("s"), ln)).alias("texts"))
    base = F.log(F.col("m").cast("double"))
    shown = (base - F.col("style") / F.col("m")) / base  # entropy of the presentations, to base m
    said = 1 - F.col("texts") / base  # one less the mean entropy of the texts
    low = checkpointed(nodes.where((F.col("m") >= LEAST) & F.col("texts").isNotNull() & ((1 - CONTENT) * shown + CONTENT * said < LOW)).select("__host", "p"))
    names = [c for c in pages.columns if c != html_col and c != "text"]
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in names) + ", text string"
    if low.count() <= FEW:  # the usual case: a few branches a host, so the pages need not be shuffled
        by_host: dict[str, set[int]] = {}
        for r in low.collect():
            by_host.setdefault(r["__host"], set()).add(r["p"])

        def text_here(c: dict[str, list]) -> dict[str, list]:
            return {k: c[k] for k in names} | {"text": [main_text(x or "", by_host.get(h, set())) for x, h in zip(c[html_col], c["__host"], strict=True)]}

        return map_slices(keyed, [*names, html_col, "__host"], schema, text_here)
    removed = flat.where("s").select("__host", "__key", "p").join(low, ["__host", "p"]).groupBy("__key").agg(F.collect_set("p").alias("__removed"))

    def text_of(c: dict[str, list]) -> dict[str, list]:
        return {k: c[k] for k in names} | {"text": [main_text(x or "", set(r or ())) for x, r in zip(c[html_col], c["__removed"], strict=True)]}

    return map_slices(keyed.join(removed, "__key", "left"), [*names, html_col, "__removed"], schema, text_of)


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every row of pages."""
    out = extract_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
