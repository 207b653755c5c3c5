"""Main text of web pages by a tree-structured graphical model.

Every block element of the DOM is a node that is content or not. A node's own features (tag, words of class and id, links, length)
give its potential, and each parent and child share a potential that depends on the kind of the child. Messages
are passed from the leaves to the root and back, which gives exact marginals; blocks whose marginal is above a half are the text.
Potentials are smoothed counts over a bounded sample of labelled pages.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from roadpoints.llm.registry import query, table

#: pages of the labelled sample, those of the smallest hashes; longer pages than this are not used for fitting
SAMPLE, SAMPLE_CHARS = 2000, 200_000
#: weight of the pseudo-counts of labels whose kind of node is given by the standard or by custom; smoothing; largest log odds that one
#: feature of a node may have, since features of a node depend on each other
PRIOR, SMOOTH, MOST = 50.0, 0.5, 1.0
_WORD = re.compile(r"[A-Za-z]+")
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|</[^>]*(?:>|\Z)", re.S)
_NAMES = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_ATTR = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]+)))?")
_UNSHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none(?![\w-])", re.I)

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math canvas object audio video xmp noframes noembed".split())
_ENDS_RAW = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}
#: elements whose content is never text of the page
DROP = RAW | frozenset("head form button select option label fieldset datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: an open element of the key's kind ends where one of these begins
ENDS = {"p": frozenset("address article aside blockquote details dialog div dl dt dd fieldset figure figcaption footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split()),
        "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]),
        "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"]),
        **{h: frozenset("article aside div footer h1 h2 h3 h4 h5 h6 header main nav ol p section table ul".split()) for h in ("h1", "h2", "h3", "h4", "h5", "h6")}}
SCOPE = frozenset("html body article aside div footer header main nav ol section table td th tr ul blockquote form".split())
CONTENT_TAGS = frozenset(["article", "main"])
OTHER_TAGS = frozenset("nav footer aside header menu dialog".split())
#: words of class, id and role that custom gives to parts beside the text, and to the text
OTHER_WORDS = frozenset("ad ads adv advert adverts advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr notice alert sidebar aside widget related recommended share sharing social comment comments "
                        "respond reply replies disqus nav navbar navigation menu breadcrumb breadcrumbs pagination pager header masthead footer copyright newsletter subscribe subscription signup popup modal overlay login search form toolbar "
                        "complementary contentinfo skip tags metadata byline".split())
CONTENT_WORDS = frozenset("article content entry post story maincontent articlebody bodytext main".split())


class Node:
    __slots__ = ("tag", "parent", "kids", "names", "chars", "linked", "kind", "zone")

    def __init__(self, tag: str, parent: int, names: str, zone: str):
        """``zone`` is that of the parent: article, aside or top. Parts of side parts stay plain, an article within one is none."""
        self.tag, self.parent, self.kids, self.names, self.chars, self.linked = tag, parent, [], names, 0, 0
        marked = tag in CONTENT_TAGS
        if tag in OTHER_TAGS or (names == "other" and (not marked or zone != "top")):
            self.kind = self.zone = "aside"
        elif zone != "aside" and (marked or names == "content"):
            self.kind = self.zone = "article"
        else:
            self.kind, self.zone = "plain", zone


def _names(attrs: str) -> str:
    words = set()
    for m in _NAMES.finditer(attrs):
        words.update(w.lower() for w in _WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", m[1] or m[2] or m[3] or "")))
    return "other" if words & OTHER_WORDS else "content" if words & CONTENT_WORDS else "some" if words else "none"


def _hidden(attrs: str) -> bool:
    """Whether an attribute of its own hides the element: hidden, aria-hidden=true or a style of display:none."""
    low = attrs.lower()
    if "hidden" not in low and "display" not in low:
        return False
    found: dict[str, str] = {}
    for m in _ATTR.finditer(attrs):  # of equal names the first counts
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return "hidden" in found or found.get("aria-hidden", "").strip().lower() == "true" or bool(_UNSHOWN.search(found.get("style", "")))


def _tokens(html: str):
    """Tags and comments; after the start tag of a raw element only its end tag is looked for, and nothing comes if there is none."""
    at = 0
    while m := _TOKEN.search(html, at):
        yield m
        at = m.end()
        if m[2] and not m[1] and m[2].lower() in RAW and not m[3].endswith("/"):
            end = _ENDS_RAW[m[2].lower()].search(html, at)
            if end is None:
                return
            at = end.start()


def parse(html: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """(block nodes, parents before children; (node, text) pieces in page order). Ill-formed and cut-off pages are read as far as they go."""
    nodes, pieces = [Node("root", -1, "none", "top")], []
    open_: list[tuple[str, int, bool]] = [("root", 0, False)]  # tag, node, dropped
    at, links = 0, 0

    def text(part: str) -> None:
        _, node, dropped = open_[-1]
        if dropped or not part:
            return
        pieces.append((node, part))
        n = len(part) - part.count(" ") - part.count("\n")
        nodes[node].chars += n
        if links:
            nodes[node].linked += n

    skip = None
    for m in _tokens(html):
        if skip:  # this is its end tag
            skip, at = None, m.start()
        if m.start() > at:
            text(html[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in INLINE:
                links -= tag == "a" and links > 0
                continue
            for k in range(len(open_) - 1, 0, -1):
                if open_[k][0] == tag:
                    del open_[k:]
                    break
            continue
        if tag in INLINE:
            links += tag == "a"
            continue
        if tag == "br" or tag == "wbr":
            text(" " if tag == "br" else "")
            continue
        if tag in VOID:
            continue
        while len(open_) > 1 and tag in ENDS.get(open_[-1][0], ()):
            open_.pop()
        for k in range(len(open_) - 1, 0, -1):  # an open p below other elements ends too, within its scope
            if open_[k][0] in SCOPE:
                break
            if tag in ENDS.get(open_[k][0], ()):
                del open_[k:]
                break
        top = open_[-1]
        dropped = top[2] or tag in DROP or _hidden(m[3])
        links = 0 if not top[2] else links
        if tag in RAW and not m[3].endswith("/"):
            skip = tag
        node = top[1]
        if not dropped:
            node = len(nodes)
            nodes.append(Node(tag, top[1], _names(m[3]) if m[3] else "none", nodes[top[1]].zone))
            nodes[top[1]].kids.append(node)
        open_.append((tag, node, dropped))
    if not skip and at < len(html):
        text(html[at:])
    if not any(n.kind == "article" for n in nodes):
        for n in nodes:  # a page that marks no article: its plain parts may be content or not
            n.kind = "free" if n.kind == "plain" and n.zone == "top" else n.kind
    return nodes, pieces


def features(n: Node, zone: str = "") -> tuple[str, ...]:
    """Names of a node's features, which count apart in the article, in side parts, and elsewhere; there are a bounded number of them."""
    zone = zone or ("any" if n.kind == "free" else n.zone)
    known = n.tag in CONTENT_TAGS or n.tag in OTHER_TAGS or n.tag in SCOPE or n.tag in ENDS or n.tag in INLINE
    share = "none" if not n.chars else "links" if 2 * n.linked > n.chars else "text"
    return (f"{zone}:tag={n.tag if known else '?'}", f"{zone}:names={n.names}", f"{zone}:share={share}", f"{zone}:size={min(9, int(math.log2(1 + n.chars)))}")


def labelled(nodes: list[Node]) -> list[bool] | None:
    """Labels of a page that marks its article: content are the article and what lies in it, but for marked side parts; None without one."""
    if not any(n.tag in CONTENT_TAGS and n.kind == "article" for n in nodes):
        return None
    out = []
    for n in nodes:
        inside = n.parent >= 0 and out[n.parent]
        out.append(n.kind != "aside" and (inside or n.kind == "article"))
    return out


def _counted(batches):
    for batch in batches:
        counts: Counter = Counter()
        for html in batch.column(0).to_pylist():
            nodes, _ = parse(html or "")
            labels = labelled(nodes)
            if labels is None:
                continue
            for n, y in zip(nodes, labels):
                for f in (*features(n), *features(n, "any")):  # "any": for pages that mark no article
                    counts[f"{f}|{int(y)}"] += 1
                if n.parent >= 0:
                    counts[f"edge={n.kind},{int(labels[n.parent])}|{int(y)}"] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["name", "n"])


class Model:
    """Log potentials: of features (not content, content), and of a child's label given its kind and its parent's label."""

    def __init__(self, counts: dict[str, float]):
        c = Counter(counts)
        for up in (0, 1):
            c[f"edge=article,{up}|1"] += PRIOR
            c[f"edge=aside,{up}|0"] += PRIOR
            c[f"edge=plain,{up}|{up}"] += PRIOR
            c[f"edge=free,{up}|{up}"] += PRIOR
        c["edge=free,0|1"] += PRIOR
        names = {k.rsplit("|", 1)[0] for k in c}
        total = {}
        for k, n in c.items():
            name, y = k.rsplit("|", 1)
            if not name.startswith("edge="):
                group = (name.split("=")[0], y)
                total[group] = total.get(group, 0) + n
        self.unary = {}
        for name in names:
            a, b = c[f"{name}|0"] + SMOOTH, c[f"{name}|1"] + SMOOTH
            if name.startswith("edge="):
                self.unary[name] = (math.log(a / (a + b)), math.log(b / (a + b)))
            else:
                g = name.split("=")[0]
                odds = math.log(b / a)
                if g.startswith("any:"):  # without a marked article the share of content among all nodes says nothing
                    odds += math.log((total.get((g, "0"), 0) + 1) / (total.get((g, "1"), 0) + 1))
                self.unary[name] = (0.0, max(-MOST, min(MOST, odds)))

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Probability of content of every node, by one sweep up and one down the tree."""
        zero = (0.0, 0.0)
        own = []
        for n in nodes:
            a = b = 0.0
            for f in features(n):
                x, y = self.unary.get(f, zero)
                a, b = a + x, b + y
            own.append([a, b])
        up: list[tuple[float, float]] = [zero] * len(nodes)
        edge = [None if n.parent < 0 else (self.unary.get(f"edge={n.kind},0", zero), self.unary.get(f"edge={n.kind},1", zero)) for n in nodes]
        for k in range(len(nodes) - 1, 0, -1):
            a, b = own[k]
            (p00, p01), (p10, p11) = edge[k]
            up[k] = (_add(p00 + a, p01 + b), _add(p10 + a, p11 + b))
            mine = own[nodes[k].parent]
            mine[0] += up[k][0]
            mine[1] += up[k][1]
        # from here own[k] is the node's belief: its potential with all messages from below, then also with the one from above
        out = [_share(own[0])]
        for k in range(1, len(nodes)):
            above, (p00, p01), (p10, p11) = own[nodes[k].parent], *edge[k]
            a, b = above[0] - up[k][0], above[1] - up[k][1]
            own[k][0] += _add(a + p00, b + p10)
            own[k][1] += _add(a + p01, b + p11)
            out.append(_share(own[k]))
        return out


def _add(a: float, b: float) -> float:
    hi = a if a > b else b
    return hi + math.log1p(math.exp(-abs(a - b)))


def _share(x: list[float]) -> float:
    d = x[0] - x[1]
    return 1 / (1 + math.exp(d)) if d < 700 else 0.0


def main_text(html: str, model: Model) -> str:
    nodes, pieces = parse(html)
    keep = [p > 0.5 for p in model.marginals(nodes)] if len(nodes) > 1 else [True]  # without markup the page is one block
    blocks, last, part = [], -1, []
    for node, text in pieces:
        if node != last and part:
            blocks.append("".join(part))
            part = []
        last = node
        if keep[node]:
            part.append(text)
    blocks.append("".join(part))
    return " ".join(t for t in (" ".join(unescape(b).split()) for b in blocks) if t)


def fit(pages: DataFrame, sample: int = SAMPLE) -> Model:
    """The potentials, from ``sample`` pages at most that mark their article; feature names are few, so are the rows collected."""
    h = F.xxhash64("page_id", "url")
    last = pages.select(h.alias("h")).orderBy("h").limit(sample).agg(F.max("h")).first()[0]  # hashes alone are sorted, no page
    rows = pages.where((h <= F.lit(last)) & (F.length("html") <= SAMPLE_CHARS)).select("html")
    counts = rows.mapInArrow(_counted, "name string, n long").groupBy("name").agg(F.sum("n").alias("n"))
    return Model({r["name"]: r["n"] for r in counts.collect()})


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """(page_id, url, text) of ``pages`` (page_id, url, html; other columns are ignored), one row per row.

    A null, empty or text-less html gives an empty text. Blocks stand in page order, joined by one space; white space within a block becomes
    one space; character references are decoded. Cut-off pages give the text they have.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                out = [main_text(h, m) if h else "" for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1).cast(pa.string()), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string")


@query("op2_html_extract")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, fit(pages)).withColumn("n_chars", F.length("text").cast("long"))
