"""Main-text extraction from HTML pages by tree scoring.

A page is read into a tree of elements; elements that are never article text (scripts, forms,
menus, adverts, comments and the like, by tag, role or class) are cut off. A wrapper with such a
name stays if it holds an article element or a main heading and most of the page's prose. Names are read
by their words, cut at changes of case as well; an id inside an article element, where headings and
sections carry ids made from their titles, counts only if all its words belong to such a name. Every
paragraph gives points for its length and commas to its five nearest ancestors: all to the parent,
half to the grandparent, a smaller part further up; a container's points are discounted by the share
of its text that stands in links and raised by a factor if it is an article element or named like
one. The best container is kept, the first in page order of equal ones, together with those
siblings that score close to it or are paragraphs without many links. If it stands in an article
element that adds few links, that element is kept instead, and siblings of an article element are not.

Defined results: null and empty html, and pages without text, give the empty string; unclosed and
stray tags are tolerated; nothing is capped, so very long and very deep pages come out whole;
repeated rows give repeated results; extra columns are ignored. A header inside an article element,
which holds its headline, is article text.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
CUT = frozenset("head script style noscript template iframe object svg math canvas form button select option input textarea label nav footer aside menu dialog title xmp noembed noframes audio video map".split())
BLOCK = frozenset("address article blockquote body br caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hr html legend li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("html body div section article main td blockquote ul ol dl table tbody tr center details figure li".split())
ENDS_P = BLOCK - {"br"}
P = frozenset(["p"])
#: What an opening tag closes, up to one of the elements after the bar.
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), "tbody": ("thead tbody tr td th", "table"), "tfoot": ("thead tbody tr td th", "table")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
BAD_ROLE = frozenset("navigation banner contentinfo complementary search menu menubar dialog alertdialog alert form toolbar".split())
BAD_NAME = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adsense|adslot|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|announcements?|alert|popup|modal|overlay|paywall|newsletter|subscri\w+|signup|login|side-?bar\w*|rail|menu\w*|nav(?:bar\w*|igation\w*|menu\w*|list|links?)?|breadcrumbs?|foot|footer\w*|masthead|site-?header|page-?header|topbar|toolbar|(?:user|reader)?comments?|commentlist|disqus|discussions?|feedback|replies|responses?|respond|reply|share|shares|sharebar|sharethis|sharing|addthis|social\w*|related\w*|recommend\w*|widgets?|pagination|pager|skip|search\w*)(?:$|[\s_-])|(?:^|\s)hidden(?:$|\s)"
)
#: Names that stay cut even around an article element, and those that make an article element something else.
NEVER_ARTICLE = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|disqus|replies|respond|reply|related\w*|recommend\w*|promo\w*|advert\w*|ads?|sponsor\w*|teasers?)(?:$|[\s_-])")
#: Words that say nothing beside a bad one.
PLAIN_WORD = re.compile(r"(?:area|bar|block|box|container|content|form|inner|item|items|link|links|list|outer|panel|posts?|section|slot|top|bottom|left|right|unit|wrap|wrapper|\d+)")
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[A-Za-z])(?=\d)")
GOOD_NAME = re.compile(r"(?:^|[\s_-])(?:article\w*|content\w*|main\w*|post\w*|story\w*|entry\w*|body\w*|text)(?:$|[\s_-])")
HEADER_NAME = re.compile(r"(?:^|[\s_-])header(?:$|[\s_-])")
LEVELS = 5  # ancestors that a paragraph gives points to
ARTICLE_FACTOR, NAME_FACTOR = 1.5, 1.25
PARDON = 0.5  # the least share of the page's prose in a wrapper that is kept in spite of its name
ADDED_LINKS = 0.2  # the greatest share of links in what an article element adds to the best container
TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z))", re.S)
ATTR = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
SPACE = re.compile(r"\s+")


def words_of(name: str | None) -> str:
    """A class or id in lower case, its words parted by hyphens where only capitals part them."""
    return HUMP.sub("-", name or "").lower()


def bad_id(name: str) -> bool:
    """Whether an id names what is cut and nothing else: share-bar, but not share-price."""
    words = [w for w in re.split(r"[\s_-]+", name) if w]
    return any(BAD_NAME.search(w) for w in words) and all(BAD_NAME.search(w) or PLAIN_WORD.fullmatch(w) for w in words)


class Node:
    __slots__ = ("tag", "name", "article", "parent", "parts", "inside", "named", "cut", "dead", "total", "links", "own", "points", "proof")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.parent, self.parts, self.points = tag, parent, [], 0.0
        own, ident = words_of(attrs.get("class")), words_of(attrs.get("id"))
        self.name = f"{own} {ident}".strip()
        role = (attrs.get("role") or "").lower()
        self.article = tag in ("article", "main") or role == "main" or attrs.get("itemprop") == "articleBody"
        self.inside = parent is not None and (parent.inside or parent.article)
        if tag == "article":
            bad = NEVER_ARTICLE.search(self.name)
        else:
            bad = (BAD_NAME.search(own) or bad_id(ident)) if self.inside else (BAD_NAME.search(self.name) or HEADER_NAME.search(self.name))
        self.named = bool(self.name and bad) and tag not in ("html", "body", "main")
        self.cut = tag in CUT or (tag == "header" and not self.inside) or role in BAD_ROLE or "hidden" in attrs or attrs.get("aria-hidden") == "true"
        self.proof = tag == "h1" or (self.article and not self.named)


def parse(page: str) -> list[Node]:
    """The nodes of a page in page order, the root first; parts are text pieces and child nodes."""
    root = Node("html", {}, None)
    nodes, stack, open_tags, at = [root], [root], Counter(), 0

    def close_to(depth: int) -> None:
        for node in stack[depth:]:
            open_tags[node.tag] -= 1
        del stack[depth:]

    while True:
        m = TAG.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            stack[-1].parts.append(text)
        if not m:
            return nodes
        at = m.end()
        close, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if close:
            if open_tags[tag]:
                i = len(stack) - 1
                while stack[i].tag != tag:
                    i -= 1
                close_to(i)
            continue
        if tag in ("html", "body") and tag == stack[-1].tag:
            continue
        kind, stop = CLOSES.get(tag, (P, frozenset())) if tag in ENDS_P or tag in CLOSES else (frozenset(), frozenset())
        ends_p = tag in ENDS_P and open_tags["p"]
        depth, i = len(stack), len(stack) - 1
        while (ends_p or any(open_tags[k] for k in kind)) and i > 0 and stack[i].tag not in stop:
            up = stack[i].tag
            if up in kind or (up == "p" and ends_p):
                depth = i
                if tag not in CLOSES or up != "p":
                    break
            elif up in CONTAINERS and tag not in CLOSES:
                break
            i -= 1
        close_to(depth)
        found = {a[0].lower(): a[1] or a[2] or a[3] for a in ATTR.findall(attrs)} if attrs else {}
        child = Node(tag, found, stack[-1])
        stack[-1].parts.append(child)
        nodes.append(child)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not attrs.rstrip().endswith("/"):
            stack.append(child)
            open_tags[tag] += 1


def measure(nodes: list[Node]) -> None:
    """Of each node that is not cut: lengths of its text, of its links and of its own direct text."""
    for node in nodes:
        node.dead = node.cut or (node.parent is not None and node.parent.dead)
    for node in reversed(nodes):
        node.total = node.links = node.own = 0
        if node.dead:
            continue
        for part in node.parts:
            if isinstance(part, str):
                n = len(part.strip())
                node.total, node.own = node.total + n, node.own + n
            else:
                node.total, node.links = node.total + part.total, node.links + part.links
                node.own += part.own if part.tag not in BLOCK else 0
                node.proof = node.proof or (part.proof and not part.dead)
        if node.tag == "a":
            node.links = node.total


def cut_by_name(nodes: list[Node]) -> None:
    """Cuts the nodes with bad names, but for wrappers around an article element or a main heading that
    hold most of the page's prose."""
    measure(nodes)
    prose = nodes[0].total - nodes[0].links
    for node in nodes:
        wrapper = node.proof and node.total - node.links >= PARDON * prose and not NEVER_ARTICLE.search(node.name)
        node.cut = node.cut or (node.named and not wrapper)
    measure(nodes)


def give_points(nodes: list[Node]) -> None:
    """Each paragraph's points for length and commas, to its ancestors."""
    for node in nodes:
        paragraph = node.tag in ("p", "pre", "td", "blockquote", "dd") or (node.tag in CONTAINERS and node.tag not in ("html", "ul", "ol", "li"))
        if node.dead or not node.own or not paragraph:
            continue
        commas = sum(part.count(",") for part in node.parts if isinstance(part, str))
        points = (1 + commas + min(node.own / 100, 3)) * (node.own / (node.own + 25))
        up = node.parent if node.tag in ("p", "pre") else node
        for level in range(LEVELS):
            if up is None:
                break
            up.points += points if level == 0 else points / 2 if level == 1 else points / (3 * level)
            up = up.parent


def score(node: Node) -> float:
    factor = ARTICLE_FACTOR if node.article else NAME_FACTOR if GOOD_NAME.search(node.name) else 1.0
    return node.points * factor * (1 - node.links / node.total if node.total else 0.0)


def blocks(node: Node) -> list[str]:
    """The blocks of a node, character references decoded and white space made single."""
    out, held = [], []

    def close() -> None:
        text = SPACE.sub(" ", entities.unescape("".join(held))).strip()
        held.clear()
        if text:
            out.append(text)

    todo: list[Node | str | None] = [node]
    while todo:
        part = todo.pop()
        if part is None:
            close()
        elif isinstance(part, str):
            held.append(part)
        elif not part.dead:
            if part.tag in BLOCK:
                close()
                todo.append(None)
            todo.extend(reversed(part.parts))
    close()
    return out


def main_text(page: str | None) -> str:
    nodes = parse(page or "")
    cut_by_name(nodes)
    give_points(nodes)
    best = max((n for n in nodes[1:] if n.tag in CONTAINERS and n.total), key=score, default=nodes[0])
    up = best.parent
    while up is not None:
        if up.article and up.links - best.links <= ADDED_LINKS * (up.total - best.total):
            best = up
        up = up.parent
    if best.article or best.parent is None:
        return " ".join(blocks(best))
    least, out = max(2.0, 0.2 * score(best)), []
    for part in best.parent.parts:
        if part is best:
            out += blocks(part)
        elif isinstance(part, str):
            text = SPACE.sub(" ", entities.unescape(part)).strip()
            out += [text] if len(text) > 80 else []
        elif not part.dead and part.total:
            near = part.tag in CONTAINERS and score(part) >= least
            prose = part.tag in ("p", "pre", "blockquote", "h1", "h2", "h3", "h4") and part.links < 0.25 * part.total
            if near or prose:
                out += blocks(part)
    return " ".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of pages (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return plain.mapInArrow(run, "page_id long, url string, text string, n_chars long")
