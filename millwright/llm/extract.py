"""Main text of web pages.

Every element of a page gets features: its tag and attribute tokens, depth, density of text, links and tags in its subtree,
how it stands among its siblings, and how its parent and the part of the page that it lies in stand among theirs.
Gradient-boosted trees, fitted on a bounded sample of pages whose elements are labelled by what their tags and tokens say, tell
how likely it belongs to the article.  They are also fitted on variants with more furniture, outside and inside the article, and on
masked copies in which the tags and tokens that gave the labels are gone and only the shape is left: what repeats among siblings,
what begins with a name, how much is links against the rest of the article.  Ids and classes of headings, paragraphs and the like
count for nothing.  A pass over the tree then decodes all elements at once: outside the article, inside, or
dropped from it.  What lies below a dropped element is dropped, and what lies inside stays inside unless it is dropped, so that
no element contradicts its ancestors; of all such labellings the one with the greatest sum of log odds is taken.
"""

from __future__ import annotations

import math
import random
import re
from dataclasses import replace
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwright.llm.common import extended
from millwright.llm.dom import RAW, Tree, parse
from millwright.llm.trees import BoostedTrees

#: Pages that the trees are fitted on, and the longest of them in characters.
SAMPLE_PAGES, SAMPLE_CHARS = 200, 100_000
_TAGS = ("article", "main", "section", "div", "p", "h1", "h2", "h3", "blockquote", "pre", "ul", "ol", "li", "a", "table", "td", "nav", "header", "footer", "aside", "form", "span", "figure", "button")
_NUMBER = {t: i for i, t in enumerate(_TAGS)}
_TOKEN = re.compile(r"[a-zA-Z]+")
_AGAINST = frozenset("ad ads advert adverts advertisement adverting banner sponsor sponsored promo promoted promotion nav navigation navbar menu breadcrumb breadcrumbs sidebar aside rail widget footer foot bottom header masthead topbar cookie cookies consent notice notification alert popup modal overlay newsletter subscribe subscription signup login form search comment comments reply replies discussion disqus reader feedback share sharing social related recommended recommend more pager pagination tags copyright legal disclaimer toolbar hidden complementary contentinfo".split())
_FOR = frozenset("article content main body post entry story text prose copy".split())
#: Their ids and classes name what they say (a heading's id is often a slug of its words), not what they are for: they count for nothing.
_UNNAMED = frozenset("h1 h2 h3 h4 h5 h6 p li a b i em strong span blockquote pre code td th tr dt dd figcaption img br".split())
#: Blocks whose repetition among siblings counts.
_BLOCKS = frozenset("div section article aside li ul ol dl dd figure blockquote".split())
#: Elements that hold no text of a page.
_NO_TEXT = RAW | frozenset("head noscript template svg math canvas audio video object select option datalist".split())


def _names(tag: str, attributes: str) -> set[str]:
    """Tokens of an element's attributes, where they may tell what it is for; ``data-own`` marks, in training, parts of the article with misleading names."""
    if "=" not in attributes or tag in _UNNAMED or "data-own" in attributes:
        return set()
    return set(_TOKEN.findall(attributes.lower()))


def _repeats(tree: Tree) -> tuple[list[int], list[int], list[int]]:
    """For each node: how many siblings have its shape (tags of all that is below), the most of its children that share one, and whether it begins with a short name or link before a block."""
    n = len(tree.tags)
    children: list[list[int]] = [[] for _ in range(n)]
    for i in range(1, n):
        children[tree.parents[i]].append(i)
    shape, alike, most, led = [0] * n, [0] * n, [0] * n, [0] * n
    numbers: dict[tuple, int] = {}
    for i in range(n - 1, -1, -1):
        below = [shape[k] for k in children[i] if tree.tags[k] not in ("br", "img")]
        shape[i] = numbers.setdefault((tree.tags[i], *below[:8]), len(numbers))
        seen: dict[int, int] = {}
        for k in children[i]:
            if tree.tags[k] in _BLOCKS:
                seen[shape[k]] = seen.get(shape[k], 0) + 1
        for k in children[i]:
            alike[k] = seen.get(shape[k], 0) if tree.tags[k] in _BLOCKS else 0
        most[i] = max(seen.values(), default=0)
        kinds = [tree.tags[k] for k in children[i]]
        led[i] = len(kinds) > 1 and kinds[0] in ("b", "strong", "span", "a", "em", "i", "h4", "h5", "h6") and any(k in ("p", "div", "blockquote") for k in kinds[1:])
    return alike, most, led


def _parts(tree: Tree, length: list[int]) -> tuple[list[int], list[int]]:
    """The parts of a page, and the one that each node lies in (0 where none): children of the lowest node that holds all its text."""
    children: list[list[int]] = [[] for _ in tree.tags]
    for i in range(1, len(tree.tags)):
        children[tree.parents[i]].append(i)
    top = 0
    while len(full := [k for k in children[top] if length[k]]) == 1 and length[full[0]] == length[0]:
        top = full[0]
    branch = [0] * len(tree.tags)
    for i in range(1, len(tree.tags)):
        branch[i] = i if tree.parents[i] == top else branch[tree.parents[i]]
    return children[top], branch


def features(tree: Tree) -> tuple[np.ndarray, list[int]]:
    """A row for each node, and how many characters of text each holds itself."""
    n = len(tree.tags)
    own, words, marks = [0] * n, [0] * n, [0] * n
    for node, text in tree.events:
        if text and not text.isspace() and tree.tags[node] not in _NO_TEXT:
            own[node] += len(text)
            words[node] += text.count(" ") + 1
            marks[node] += text.count(". ") + text.count(", ") + text.endswith((".", "!", "?"))
    parents, tags = tree.parents, tree.tags
    length, link, nodes, paras, signs, total_words = own[:], [0] * n, [1] * n, [0] * n, marks[:], words[:]
    children: list[int] = [0] * n
    position, same = [0] * n, [0] * n
    last_of: dict[tuple[int, str], int] = {}
    for i in range(1, n):
        p = parents[i]
        position[i] = children[p]
        children[p] += 1
        key = (p, tags[i])
        same[i] = last_of[key] = last_of.get(key, 0) + 1
    for i in range(n - 1, 0, -1):
        p = parents[i]
        if tags[i] == "a":
            link[i] = length[i]
        if tags[i] == "p":
            paras[i] += 1
        length[p] += length[i]
        link[p] += link[i]
        nodes[p] += nodes[i]
        paras[p] += paras[i]
        signs[p] += signs[i]
        total_words[p] += total_words[i]
    whole = max(1, length[0])
    parts, branch = _parts(tree, length)
    widest = max((length[k] for k in parts), default=0)
    place = {k: j for j, k in enumerate(k for k in parts if length[k])}
    against, favour, above, under = [0] * n, [0] * n, [0] * n, [0] * n
    alike, most, led = _repeats(tree)
    rows = np.zeros((n, 38))
    for i in range(n):
        if a := tree.attributes[i]:
            tokens = _names(tags[i], a)
            against[i], favour[i] = len(tokens & _AGAINST), len(tokens & _FOR)
        p = parents[i]
        bad_tag = tags[i] in ("nav", "footer", "aside", "form", "button", "header")
        above[i] = (above[p] if p >= 0 else 0) + (against[i] > 0) + bad_tag
        under[i] = (under[p] if p >= 0 else 0) + (favour[i] > 0 and not against[i]) + (tags[i] in ("article", "main"))
        size, b, q = length[i], branch[i] or i, max(p, 0)
        rows[i] = (
            _NUMBER.get(tags[i], -1), tree.depths[i], against[i], favour[i], above[i], under[i],
            math.log1p(size), size / whole, link[i] / max(1, size), size / nodes[i], math.log1p(nodes[i]), math.log1p(paras[i]),
            signs[i] / max(1, total_words[i]), math.log1p(own[i]), own[i] / max(1, size), position[i],
            children[p] if p >= 0 else 1, (last_of[(p, tags[i])] / children[p]) if p >= 0 else 1.0, size / max(1, length[p] if p >= 0 else size), total_words[i] / nodes[i],
            length[q] / whole, link[q] / max(1, length[q]), math.log1p(paras[q]),
            length[b] / whole, length[b] / max(1, widest), link[b] / max(1, length[b]), math.log1p(paras[b]), signs[b] / max(1, total_words[b]),
            place.get(b, -1), len(place) - place.get(b, -1),
            alike[i], most[i], led[i], alike[q], most[q], link[i] / max(1, size) - link[b] / max(1, length[b]),
            math.log1p(size / max(1, most[i])), size / (1 + paras[i]) / max(1.0, length[b] / (1 + paras[b])),
        )
    return rows, own


def decode(tree: Tree, odds: list[float], own: list[int]) -> list[bool]:
    """Which nodes are inside the article, by the best labelling without contradictions (states: outside, inside, dropped)."""
    n = len(odds)
    inside = [max(-8.0, min(8.0, o)) * (0.05 + math.log1p(c)) for o, c in zip(odds, own)]
    best_inside, best_outside = inside[:], [0.0] * n  # of the subtree, the node being in that state; dropped is 0
    for i in range(n - 1, 0, -1):
        p = tree.parents[i]
        best_inside[p] += max(best_inside[i], -1.0)
        best_outside[p] += max(best_outside[i], best_inside[i] - 1.0, 0.0)
    state = [0] * n
    state[0] = 1 if best_inside[0] - 1.0 > best_outside[0] else 0
    for i in range(1, n):
        above = state[tree.parents[i]]
        if above == 2 or tree.tags[i] in _NO_TEXT:
            state[i] = 2
        elif above == 1:
            state[i] = 1 if best_inside[i] >= -1.0 else 2
        else:
            state[i] = 1 if best_inside[i] - 1.0 > max(best_outside[i], 0.0) else 0
    return [s == 1 for s in state]


def text_of(tree: Tree, inside: list[bool]) -> str:
    """The text of these nodes: references decoded, one space for white space in a block, blocks parted by an empty line."""
    blocks, held = [], []
    for node, text in tree.events:
        if text is None:
            if held:
                block = " ".join(unescape("".join(held)).split())
                if block:
                    blocks.append(block)
                held = []
        elif inside[node]:
            held.append(text)
    if held and (block := " ".join(unescape("".join(held)).split())):
        blocks.append(block)
    return "\n\n".join(blocks)


def _labels(tree: Tree) -> list[int] | None:
    """Which elements belong to the article, by tags and tokens; None where they do not say."""
    bad = ("nav", "footer", "aside", "form", "button", "header")
    out, seen = [0] * len(tree.tags), False
    dropped = [False] * len(tree.tags)
    for i, (tag, attributes, p) in enumerate(zip(tree.tags, tree.attributes, tree.parents)):
        tokens = _names(tag, attributes)
        dropped[i] = (p >= 0 and dropped[p]) or tag in bad or tag in _NO_TEXT or bool(tokens & _AGAINST)
        root = tag in ("article", "main") or (tag in ("div", "section") and bool(tokens & _FOR))
        out[i] = int(not dropped[i] and (root or (p >= 0 and out[p] == 1)))
        seen |= out[i] == 1
    return out if seen else None


_FURNITURE = (
    '<div class="comments"><h3>{0}</h3><div class="comment"><p>{1}</p></div><div class="comment"><p>{2}</p></div></div>',
    '<aside class="sidebar"><h2>{0}</h2><ul><li><a href="/1">{0}</a></li><li><a href="/2">{0}</a></li></ul><p>{1}</p></aside>',
    '<div class="cookie-notice"><p>{1}</p><button>{0}</button></div>',
    '<form action="/s"><label>{0}</label><input name="q"><p>{2}</p><button>{0}</button></form>',
    '<header class="masthead"><a href="/">{0}</a><p>{0}</p></header>',
    '<div id="newsletter"><h3>{0}</h3><p>{1}</p></div>',
    '<section class="related"><h3>{0}</h3><ul><li><a href="/3">{1}</a></li></ul></section>',
)
#: Furniture for the inside of an article, by shape: comments, lists of links, rows of links.
_INNER = (
    '<div class="comments"><div class="comment"><b>{0}</b><p>{1}</p></div><div class="comment"><b>{0}</b><p>{2}</p></div><div class="comment"><b>{0}</b><p>{1}</p></div></div>',
    '<ul class="related"><li><a href="/4">{3}</a></li><li><a href="/5">{4}</a></li><li><a href="/6">{3}</a></li></ul>',
    '<ul class="comments"><li><span>{0}</span><p>{2}</p></li><li><span>{0}</span><p>{1}</p></li></ul>',
    '<div class="related"><h3>{0}</h3><ul><li><a href="/7">{3}</a></li><li><a href="/8">{4}</a></li></ul></div>',
    '<section class="comments"><h3>{0}</h3><div><p>{2}</p></div><div><p>{4}</p></div><div><p>{1}</p></div></section>',
    '<div class="share"><a href="#a">{0}</a> <a href="#b">{0}</a> <a href="#c">{0}</a></div>',
    '<div class="comments"><h4>{0}</h4><div class="comment"><p>{0}: {1}</p></div><div class="comment"><p>{0}: {2}</p></div></div>',
    '<div class="comments"><p>{0}: {2}</p><p>{0}: {4}</p><p>{0}: {2}</p></div>',
    '<div class="comments"><ol><li><p><b>{0}</b> {2}</p></li><li><p><b>{0}</b> {1}</p></li></ol></div>',
)
_ROOTS = (("<article>", "</article>"), ('<div class="content">', "</div>"), ('<main id="main">', "</main>"), ('<div class="post"><div class="entry-content">', "</div></div>"), ('<section class="story-body">', "</section>"))
_MENUS = (("<nav>", "</nav>"), ('<div class="menu">', "</div>"), ('<div id="navigation">', "</div>"))
_FEET = (("<footer>", "</footer>"), ('<div class="footer">', "</div>"), ('<div id="bottom-copyright">', "</div>"))


def variant(html: str, k: int) -> str:
    """The page with its article, menu and footer marked up in the k-th way, and some furniture of its own words put in; in odd ways one piece stands inside the article."""
    words = re.sub(r"<[^>]*>", " ", html).split()[-400:]
    piece = lambda a, b: " ".join(words[(k * 37 + a) % max(1, len(words)) :][:b])
    made = [_FURNITURE[(k + j) % len(_FURNITURE)].format(piece(j, 2), piece(5 + j, 20), piece(31 + j, 12)) for j in (0, 2, 5, 3)]
    if k % 2:
        before = r"(</article\s*>)" if k % 4 == 1 else r"(<p(?:\s[^>]*)?>)"
        html = re.sub(before, lambda m: made[3] + m[1], html, count=1, flags=re.I)
    if k % 3 == 0:  # more text behind the article
        html = re.sub(r"</article\s*>", lambda m: f'{m[0]}<div class="related"><h2>{piece(3, 3)}</h2><p>{piece(11, 35)}</p><p>{piece(90, 25)}</p></div>', html, count=1, flags=re.I)
    for tag, ways, step in (("article", _ROOTS, 1), ("nav", _MENUS, 2), ("footer", _FEET, 3)):
        opening, closing = ways[(k * step + k // 3) % len(ways)]
        html = re.sub(rf"<{tag}(\s[^>]*)?>", opening, html, flags=re.I)
        html = re.sub(rf"</{tag}\s*>", closing, html, flags=re.I)
    html = re.sub(r"(<body[^>]*>)", lambda m: m[1] + made[0], html, count=1, flags=re.I)
    return re.sub(r"</body\s*>", lambda m: made[1] + made[2] + m[0], html, count=1, flags=re.I)


def inner_variant(html: str, k: int) -> str:
    """The page with furniture at one or two places inside its article, and parts of the article in blocks of their own, some with names that mislead."""
    words = re.sub(r"<[^>]*>", " ", html).split()[-400:]
    piece = lambda a, b: " ".join(words[(k * 53 + a) % max(1, len(words)) :][:b])
    made = [_INNER[(k + j) % len(_INNER)].format(piece(j, 2), piece(9, 22), piece(40 + j, 11), piece(70, 4), piece(80 + j, 6)) for j in (0, 4)]
    found = re.search(r"<article\b[^>]*>(.*?)</article\s*>", html, re.S | re.I)
    if not found:
        return html
    body = found[1]
    name = ("", ' class="more related"', ' id="x" class="y"', ' class="comment-like notice"')[k % 4]
    if k % 3 == 0:  # each paragraph in a block of its own
        body = re.sub(r"<p\b[^>]*>.*?</p\s*>", lambda m: f"<div data-own{name}>{m[0]}</div>", body, flags=re.S | re.I)
    elif k % 3 == 1:  # the first two in one
        body = re.sub(r"(<p\b[^>]*>.*?</p\s*>\s*<p\b[^>]*>.*?</p\s*>)", lambda m: f"<section data-own{name}>{m[0]}</section>", body, count=1, flags=re.S | re.I)
    else:  # one of them
        places = list(re.finditer(r"<p\b[^>]*>.*?</p\s*>", body, re.S | re.I))
        if places:
            m = places[k // 3 % len(places)]
            body = f"{body[: m.start()]}<div data-own{name}>{m[0]}</div>{body[m.end() :]}"
    if k % 2:
        middle = [m.end() for m in re.finditer(r"</p\s*>(?!\s*</(?:div|li|section|td|blockquote)\b)", body, re.I)]
        at = middle[len(middle) // 2] if middle else 0
        body = body[:at] + made[1] + body[at:]
    return html[: found.start(1)] + body + made[0] + html[found.end(1) :]


_ROOT_TAGS = frozenset("article main".split())
_WRAPPERS = _ROOT_TAGS | frozenset("section div nav header footer aside form".split())


def masked(tree: Tree, seed: int, *, whole: bool, misleading: float = 0.0) -> Tree:
    """The same nodes and texts with made-up attributes and neutral wrappers: all of them, or only those that hold an article; a share of the made-up names says something, whatever it names."""
    r = random.Random(seed)
    listed = sorted(_AGAINST | _FOR)
    word = lambda: r.choice(listed) if r.random() < misleading else "".join(r.choices("bcdfghjklmnpqrstvwxz", k=5))
    tags, attributes = [], []
    for tag, given in zip(tree.tags, tree.attributes):
        tokens = _names(tag, given)
        hit = tag in _WRAPPERS if whole else tag in _ROOT_TAGS or bool(tokens & _FOR)
        tags.append(r.choice(("div", "section", "div")) if hit else "span" if whole and tag in ("button", "label") else tag)
        attributes.append(r.choice(("", f' class="{word()}"', f' id="{word()}" class="{word()} {word()}"')) if hit or whole else given)
    return replace(tree, tags=tags, attributes=attributes)


def fit(pages: list[str]) -> BoostedTrees | None:
    """Trees fitted on these pages, variants of each, and masked copies of all; None where no page says what its article is."""
    rows, marks = [], []
    for i, page in enumerate(pages):
        for j, html in enumerate((page, variant(page, 2 * i + i % 2), inner_variant(page, 2 * i), inner_variant(page, 2 * i + 1))):
            tree = parse(html)
            labels = _labels(tree)
            if labels:
                keep = [k for k, t in enumerate(tree.tags) if t not in _NO_TEXT]
                for seen in (tree, masked(tree, 4 * i + j, whole=True)) if j < 2 else (masked(tree, 4 * i + j, whole=True), masked(tree, 4 * i + j + 1, whole=True, misleading=0.4)):
                    rows.append(features(seen)[0][keep])
                    marks += [labels[k] for k in keep]
    return BoostedTrees().fit(np.concatenate(rows), np.array(marks, float)) if rows else None


def fit_extractor(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", sample_pages: int = SAMPLE_PAGES) -> BoostedTrees | None:
    """Trees from at most ``sample_pages`` pages, dealt out by a hash of the id, of up to ``SAMPLE_CHARS`` characters; of pages that share an id the least."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("html")).filter(F.length("html").between(1, SAMPLE_CHARS))
    chosen = rows.filter("id is not null").select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(sample_pages)  # ids alone go through the sort
    drawn = rows.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("html")).collect()
    return fit([html for _, html in sorted(map(tuple, drawn))])


def extract_text(pages: DataFrame, model: BoostedTrees | None, *, html_col: str = "html") -> DataFrame:
    """``pages`` with text string: the article's blocks in page order, empty where there is none.

    Null and empty pages have an empty text, an empty table an empty result; repeated rows stay, each with its text; a page of any
    length is read whole, in one piece.  Between labellings of equal odds the one that keeps more is taken.  Without a model (no
    page said what its article is) all text outside scripts, styles and the like is kept; columns named text are replaced, all
    others kept.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def work(batch):
        trees, rows, texts = [], [], []

        def settle():
            odds = shared.value.margin(np.concatenate([r[0] for r in rows])) if shared.value else None
            at = 0
            for tree, (x, own) in zip(trees, rows):
                if odds is None:
                    found = [4.0] * len(own)
                else:
                    found = odds[at : at + len(own)].tolist()
                at += len(own)
                texts.append(text_of(tree, decode(tree, found, own)))
            trees.clear()
            rows.clear()

        for html in batch.column("h").to_pylist():
            trees.append(parse(html or ""))
            rows.append(features(trees[-1]))
            if sum(len(r[1]) for r in rows) > 20_000:
                settle()
        if trees:
            settle()
        return [pa.array(texts, pa.string())]

    return extended(pages, {"h": F.col(html_col).cast("string")}, T.StructType().add("text", "string"), work)
