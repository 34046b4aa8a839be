"""HTML as a tag stream with a stack of open elements, for functions inside tasks.

One pass over a page, whose time follows its length whatever is left open in it: every search for an end that fails ends
the pass, and an end tag is looked for in the stack only when the stack has its element.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, field

#: What browsers trim.
SPACE = "\t\n\x0b\x0c\r \xa0\ufeff\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
# Elements without content, with content that isn't markup, and those that an opening tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "a": ("a",)}
#: Elements that such an implied end doesn't reach beyond.
FENCES = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",), "a": ("table",)}

#: Elements open at once; those further inside count as their parents' text, as in browsers.
DEEPEST = 512

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*(?:([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)?))?|=)")
_OPEN_QUOTE = re.compile(r"\s*=\s*[\"']")


@dataclass(slots=True)
class Element:
    name: str
    parent: int
    attributes: dict[str, str]
    #: Its text is pieces[first:last]; its descendants are elements[i + 1:end].
    first: int
    last: int = -1
    end: int = -1
    children: list[int] = field(default_factory=list)

    def classes(self) -> list[str]:
        return self.attributes.get("class", "").split()


@dataclass(slots=True)
class Tree:
    elements: list[Element]
    pieces: list[str]

    def text(self, i: int) -> str:
        e = self.elements[i]
        return "".join(self.pieces[e.first : e.last])

    def named(self, name: str) -> list[int]:
        return [i for i, e in enumerate(self.elements) if e.name == name]

    def of_class(self, name: str) -> list[int]:
        return [i for i, e in enumerate(self.elements) if name in e.attributes.get("class", "") and name in e.classes()]

    def within(self, i: int, sorted_places: list[int]) -> int | None:
        """The first of some places that is a descendant of element i."""
        k = bisect_left(sorted_places, i + 1)
        return sorted_places[k] if k < len(sorted_places) and sorted_places[k] < self.elements[i].end else None


def _attributes(page: str, at: int) -> tuple[dict[str, str], int]:
    """Attributes from `at` on, and where the tag's > is; -1 where the tag doesn't end."""
    found: dict[str, str] = {}
    while True:
        m = _ATTRIBUTE.match(page, at)
        if m is None:
            while at < len(page) and (page[at].isspace() or page[at] == "/"):
                at += 1
            if at < len(page) and page[at] == ">":
                return found, at
            if at < len(page) and page[at] not in "\"'":
                return found, page.find(">", at)
            if at >= len(page):
                return found, -1
            at += 1
            continue
        at = m.end()
        name = (m[1] or "").lower()
        if name and _OPEN_QUOTE.match(page, m.end(1)) and m[2] is None and m[3] is None:
            return found, -1
        if name and name not in found:
            value = next((v for v in m.groups()[1:] if v is not None), "")
            found[name] = entities.unescape(value) if "&" in value else value


def parse(page: str) -> Tree:
    """Elements in the order of their opening tags, the whole page being number 0, and pieces of text between tags.

    What a tag implies is kept to what text needs: a block ends an open paragraph; a list item, cell, row or link ends the
    one before it; an end tag ends all that is open inside its element, and one without an element ends nothing.
    """
    elements, pieces = [Element("", -1, {}, 0)], []
    stack, open_ = [0], Counter({"": 1})
    at, n = 0, len(page)

    def pop() -> Element:
        e = elements[stack.pop()]
        e.last, e.end = len(pieces), len(elements)
        open_[e.name] -= 1
        return e

    def imply(names: tuple[str, ...], fences: tuple[str, ...]) -> None:
        if any(open_[x] for x in names):
            for k in range(len(stack) - 1, 0, -1):
                name = elements[stack[k]].name
                if name in fences:
                    return
                if name in names:
                    outer = k
                    while outer > 1 and elements[stack[outer - 1]].name in names:
                        outer -= 1
                    while len(stack) > outer:
                        pop()
                    return
                if name in BLOCK and name not in ("div", "p", "address"):
                    return

    def add(name: str, attributes: dict[str, str]) -> None:
        elements[stack[-1]].children.append(len(elements))
        elements.append(Element(name, stack[-1], attributes, len(pieces)))
        stack.append(len(elements) - 1)
        open_[name] += 1
        if len(stack) > DEEPEST and name not in RAW:
            pop()

    while at < n:
        i = page.find("<", at)
        if i < 0:
            i = n
        if i > at:
            piece = page[at:i]
            pieces.append(entities.unescape(piece) if "&" in piece else piece)
        if i == n:
            break
        if page.startswith("<!--", i):
            at = page.find("-->", i + 4) + 3
            if at == 2:
                break
            continue
        closing = page.startswith("</", i)
        m = _NAME.match(page, i + 1 + closing)
        if m is None:
            if closing or page[i + 1 : i + 2] in ("!", "?"):
                at = page.find(">", i) + 1
                if at == 0:
                    break
            else:
                pieces.append("<")
                at = i + 1
            continue
        name = m[0].lower()
        attributes, end = _attributes(page, m.end())
        if end < 0:
            break
        at = end + 1
        if closing:
            if open_[name] and name:
                while pop().name != name:
                    pass
            continue
        if name in BLOCK and open_["p"]:
            imply(("p",), ("button", "td", "th", "table", "li"))
        if name in CLOSES:
            imply(CLOSES[name], FENCES[name])
        add(name, attributes)
        if name in VOID:
            if elements[stack[-1]].name == name:
                pop()
        elif name in RAW:
            low = _end_of(name).search(page, at)
            stop = low.start() if low else n
            piece = page[at:stop]
            pieces.append(entities.unescape(piece) if name in ("title", "textarea") else piece)
            pop()
            if low is None:
                break
            at = page.find(">", stop) + 1
            if at == 0:
                break
    while stack:
        pop()
    return Tree(elements, pieces)


_ENDS: dict[str, re.Pattern] = {}


def _end_of(name: str) -> re.Pattern:
    if name not in _ENDS:
        _ENDS[name] = re.compile(rf"</{name}(?=[\s/>])", re.I)
    return _ENDS[name]
