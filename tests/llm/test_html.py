"""Main text of hand-made pages, and of random ones against a version written straight from the rules."""

import random
import xml.etree.ElementTree as ET

import pytest

from tidemark.llm import html_extract as H

A = "The first paragraph of the story says, with a few commas, what there is to say about the matter."
B = "A second one goes on, since a story has more than one paragraph, and ends after some words."
C = "Then a third brings it to its end, which is neither happy nor sad, but long enough to count."
STORY = f"<p>{A}</p><p>{B}</p><p>{C}</p>"
TEXT = f"{A} {B} {C}"
OTHER = "Words of another kind, that fill a block beside the story, with commas, for as long as they can."
BLOCK_NAMES = ["sidebar-content", "comment-body", "comment-text", "newsletter-content", "cookie-text", "promo-text", "footer-content", "ad-content", "related-posts", "nav-main", "share-buttons", "site-header-text"]

PAGES = [
    *[(f"<article>{STORY}<div class='{name}'><p>{OTHER}</p><p>{OTHER}</p></div></article>", TEXT) for name in BLOCK_NAMES],
    *[(f"<body><div class='{name}'><p>{OTHER}</p></div><div>{STORY}</div></body>", TEXT) for name in BLOCK_NAMES],
    (f"<body><div class=story>{STORY}{STORY}</div><article>tiny teaser</article><article>small teaser</article></body>", f"{TEXT} {TEXT}"),
    (f"<body><article class=teaser><p>{OTHER}</p></article><div>{STORY}</div></body>", TEXT),
    (f"<div class='page nav-open'><article><h1>Head</h1>{STORY}</article><div class=related><a href=x>{OTHER}</a></div></div>", f"Head {TEXT}"),
    (f"<div id=sidebar-layout><h1>Head</h1>{STORY}</div><div class=sidebar><p>{OTHER}</p></div>", f"Head {TEXT}"),
    (f"<div id=comments><article><p>{OTHER}</p><p>{OTHER}</p><p>{OTHER}</p><p>{OTHER}</p></article></div><div>{STORY}</div>", TEXT),
    (f"<main><article><section>{STORY}</section><section><p>{B}</p></section></article><div><a href=a>{OTHER}</a><a href=b>{OTHER}</a></div></main>", f"{TEXT} {B}"),
    (f"<div class='prose overflow-hidden text-navy shared-by'>{STORY}</div><div class='hidden wide'><p>{OTHER}</p></div><div id=navbar-top><p>{OTHER}</p></div>", TEXT),
    (f"<header><p>{OTHER}</p></header><article><header><h1>Head</h1></header>{STORY}</article>", f"Head {TEXT}"),
    (f"<div>{STORY}</div><div><a href=1>{OTHER}</a> <a href=2>{OTHER}</a></div>", TEXT),
    (f"<table><tr><td><a href=1>{OTHER}</a></td><td>{STORY}</td></tr></table>", TEXT),
    (f"<div role=navigation><p>{OTHER}</p></div><div role=main>{STORY}</div><div hidden><p>{OTHER}</p></div>", TEXT),
    (f"<article>{STORY}<form><p>{OTHER}</p></form><aside><p>{OTHER}</p></aside><footer>{OTHER}</footer></article>", TEXT),
    (f"<ARTICLE><P>{A}<P>{B}<SCRIPT>if (a < b) '<p>'</SCRIPT><!-- <p>no</p> --><P>{C}</ARTICLE>", TEXT),
    ("<article><p>caf&eacute; &#8212; &lt;b&gt; &amp;amp; &nbsp; x</p></article>", "café — <b> &amp; x"),
    (f"<article><p>{A}</p></div></section></p><p>{B}</p></article>", f"{A} {B}"),
    (f"<article>{'<div>' * 600}<p>{A}</p>{'</div>' * 600}<p>{B}</p><aside>{'<div>' * 600}no{'</div>' * 600}no</aside><p>{C}</p></article><p>after</p>", TEXT),
    ("<article>" + "".join(f"<div><p>{A}</p>" for _ in range(800)) + "</div>" * 800 + f"<p>{B}</p></article>", " ".join([A] * 800 + [B])),
    ("<p>" + "</x>" * 20000 + "<b>" * 5000 + "deep", "deep"),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_hand_made_pages(page, text):
    assert H.main_text(page) == text


def plain_main_text(page):
    """The rules of the module, by walking up and down a parsed tree for each question."""
    root = ET.fromstring(page)
    parent = {c: p for p in root.iter() for c in p}
    chain = lambda e: [e, *chain(parent[e])] if e in parent else [e]
    parts = lambda e: [x for x in [e.text, *(y for c in e for y in (c, c.tail))] if x is not None]
    name = lambda e: f"{e.get('class') or ''} {e.get('id') or ''}".lower().strip()
    article = lambda e: e.tag in ("article", "main") or (e.get("role") or "") == "main"
    inside = lambda e: any(article(a) for a in chain(e)[1:])

    def named(e):
        if e.tag in ("html", "body", "main") or not name(e):
            return False
        return bool(H.NEVER_ARTICLE.search(name(e)) if e.tag == "article" else H.BAD_NAME.search(name(e)) or (not inside(e) and H.HEADER_NAME.search(name(e))))

    cut = {e for e in root.iter() if e.tag in H.CUT or (e.tag == "header" and not inside(e)) or (e.get("role") or "") in H.BAD_ROLE}
    alive = lambda e: not any(a in cut for a in chain(e))
    strings = lambda e: [(o, p) for o in e.iter() if alive(o) for p in parts(o) if isinstance(p, str)]
    total = lambda e: sum(len(p.strip()) for _, p in strings(e))
    links = lambda e: sum(len(p.strip()) for o, p in strings(e) if any(a.tag == "a" for a in chain(o)[: chain(o).index(e) + 1]))
    own = lambda e: sum(len(p.strip()) if isinstance(p, str) else own(p) if p.tag not in H.BLOCK and alive(p) else 0 for p in parts(e))
    prose = total(root) - links(root)
    pardoned = lambda e: not H.NEVER_ARTICLE.search(name(e)) and total(e) - links(e) >= H.PARDON * prose and any(alive(x) and (x.tag == "h1" or (article(x) and not named(x))) for x in e.iter())
    cut |= {e for e in root.iter() if named(e) and not (alive(e) and pardoned(e))}
    points = {e: 0.0 for e in root.iter()}
    for e in root.iter():
        if alive(e) and own(e) and (e.tag in ("p", "pre", "td", "blockquote", "dd") or (e.tag in H.CONTAINERS and e.tag not in ("html", "ul", "ol", "li"))):
            n = own(e)
            value = (1 + sum(p.count(",") for p in parts(e) if isinstance(p, str)) + min(n / 100, 3)) * n / (n + 25)
            for level, up in enumerate(chain(e)[1 if e.tag in ("p", "pre") else 0 :][: H.LEVELS]):
                points[up] += value * (1 if level == 0 else 0.5 if level == 1 else 1 / (3 * level))
    factor = lambda e: H.ARTICLE_FACTOR if article(e) else H.NAME_FACTOR if H.GOOD_NAME.search(name(e)) else 1
    score = lambda e: points[e] * factor(e) * (1 - links(e) / total(e))
    best = root
    for e in root.iter():
        if e is not root and alive(e) and e.tag in H.CONTAINERS and total(e) and (best is root or score(e) > score(best) + 1e-9):
            best = e
    for up in chain(best)[1:]:
        if article(up) and links(up) - links(best) <= H.ADDED_LINKS * (total(up) - total(best)):
            best = up

    def text(e):
        if not alive(e):
            return ""
        edge = "\0" if e.tag in H.BLOCK else ""
        return edge + "".join(p if isinstance(p, str) else text(p) for p in parts(e)) + edge

    lay = lambda t: [b for b in (" ".join(x.split()) for x in t.split("\0")) if b]
    if article(best) or best is root:
        return " ".join(lay(text(best)))
    out = []
    for p in parts(parent[best]):
        if isinstance(p, str):
            out += [p.strip()] if len(p.strip()) > 80 else []
        elif p is best or (alive(p) and total(p) and ((p.tag in H.CONTAINERS and score(p) >= max(2.0, 0.2 * score(best))) or (p.tag in ("p", "pre", "blockquote", "h1", "h2", "h3", "h4") and links(p) < 0.25 * total(p)))):
            out += lay(text(p))
    return " ".join(out)


def random_page(rng):
    words = lambda n: " ".join(rng.choice(["word", "and,", "of", "some", "length,", "here"]) for _ in range(n))
    names = ["", "", "", "story", "content", "sidebar", "comments", "related", "nav-open", "header"]

    def element(depth):
        kind = rng.choice(["div", "div", "section", "article", "p", "p", "p", "ul", "h1", "h2", "aside", "span", "header", "a"]) if depth else "p"
        attrs = f' class="{rng.choice(names)}"' if rng.random() < 0.5 else ""
        if kind in ("p", "h1", "h2", "a", "span"):
            inner = words(rng.randint(1, 30)) + ("<a>" + words(4) + "</a>" + words(2) if kind != "a" and rng.random() < 0.3 else "")
        elif kind == "ul":
            inner = "".join(f"<li><a>{words(2)}</a></li>" for _ in range(3))
        else:
            inner = (words(rng.randint(0, 12)) if rng.random() < 0.3 else "") + "".join(element(depth - 1) for _ in range(rng.randint(1, 4)))
        return f"<{kind}{attrs}>{inner}</{kind}>"

    return "<html><body>" + "".join(element(3) for _ in range(rng.randint(1, 4))) + "</body></html>"


@pytest.mark.parametrize("seed", range(60))
def test_random_pages_equal_the_plain_version(seed):
    page = random_page(random.Random(seed))
    assert H.main_text(page) == plain_main_text(page)


TALE = "<p>" + "The council met on Monday, and after a long debate, agreed on the plan for the harbour. " * 4 + "</p>"


@pytest.mark.parametrize("name", ["cookieBanner", "adBox", "googleAd", "newsletterSignup", "navlinks", "usercomment", "responses", "discussion", "feedback", "announcement", "paywall", "SideBar2", "shareBar", "reader-comments"])
def test_names_without_separators_go(name):
    page = f"<html><body><article><h1>Harbour</h1>{TALE}<div class='{name}'>Take this away, please.</div>{TALE}</article></body></html>"
    text = H.main_text(page)
    assert "Take this away" not in text and text.startswith("Harbour The council") and text.count("council") == 8


@pytest.mark.parametrize("ident", ["nav-history", "banner-headline", "login-guide", "modal-verbs", "share-price", "search-results", "menuOfTheDay", "social_history", "comments-on-the-plan"])
def test_ids_made_from_titles_stay(ident):
    page = f"<html><body><article><h1>Harbour</h1>{TALE}<section id='{ident}'><h2 id='{ident}'>A title</h2><p>Keep this part, it tells the story.</p></section>{TALE}</article></body></html>"
    text = H.main_text(page)
    assert "A title Keep this part, it tells the story." in text


@pytest.mark.parametrize("ident", ["comments", "comments-section", "share-bar", "sidebar", "relatedPosts", "ad-slot-3"])
def test_ids_of_what_is_not_the_story_go(ident):
    page = f"<html><body><article><h1>Harbour</h1>{TALE}<section id='{ident}'><p>Take this away, please.</p></section></article></body></html>"
    assert "Take this away" not in H.main_text(page)
