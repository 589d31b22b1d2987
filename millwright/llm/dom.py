"""A forgiving HTML reader: elements with their parents, the text each holds, and where blocks end."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_TOKEN = re.compile(r"""<!--.*?-->|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup; only a closing tag ends it.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: An opening tag ends an open element named here, unless one of the second set lies between.
_ENDS = {t: ({"p"}, {"table", "button", "td", "th", "caption", "object"}) for t in BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}}
_ENDS |= {
    "li": ({"li", "p"}, {"ul", "ol", "menu", "table"}),
    "dt": ({"dt", "dd", "p"}, {"dl"}),
    "dd": ({"dt", "dd", "p"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    **{t: ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}) for t in ("tbody", "thead", "tfoot")},
}


@dataclass
class Tree:
    """Node 0 is the page; a parent's number is below its children's.  events: (node, text), or (node, None) where a block begins or ends."""

    tags: list[str] = field(default_factory=lambda: ["#page"])
    attributes: list[str] = field(default_factory=lambda: [""])
    parents: list[int] = field(default_factory=lambda: [-1])
    depths: list[int] = field(default_factory=lambda: [0])
    events: list[tuple[int, str | None]] = field(default_factory=list)


def parse(html: str) -> Tree:
    tree = Tree()
    stack, at, size = [0], 0, len(html)
    tags, events = tree.tags, tree.events
    opened: dict[str, list[int]] = {}  # places in the stack by tag

    def close(depth: int) -> None:
        while len(stack) > depth:
            node = stack.pop()
            opened[tags[node]].pop()
            if tags[node] in BLOCK:
                events.append((node, None))

    def deepest(names) -> int:
        return max((opened[t][-1] for t in names if opened.get(t)), default=0)

    while at < size:
        m = _TOKEN.search(html, at)
        if m is None:
            events.append((stack[-1], html[at:]))
            break
        if m.start() > at:
            events.append((stack[-1], html[at : m.start()]))
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        name = name.lower()
        if m[1] or m[4]:
            if place := deepest((name,)):
                close(place)
            continue
        if name in _ENDS:
            ended, fence = _ENDS[name]
            while (place := deepest(ended)) > deepest(fence):
                close(place)
        node = len(tags)
        tags.append(name)
        attributes = m[3] if m[2] else m[6]
        tree.attributes.append(attributes)
        tree.parents.append(stack[-1])
        tree.depths.append(len(stack))
        if name in BLOCK:
            events.append((node, None))
        if name == "br":
            events.append((stack[-1], " "))
        if name in VOID or attributes.endswith("/") and name not in BLOCK and name not in RAW:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(html, at)
            if end is None:
                at = size
            else:
                if name == "textarea":
                    events.append((node, html[at : end.start()]))
                closing = html.find(">", end.end())
                at = size if closing < 0 else closing + 1
            continue
        opened.setdefault(name, []).append(len(stack))
        stack.append(node)
    close(1)
    return tree
