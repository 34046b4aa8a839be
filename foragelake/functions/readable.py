"""The article of a page: blocks are scored by their text and links, and the best one is read with what belongs to it."""

from __future__ import annotations

import re
from collections import defaultdict

from foragelake.functions.tags import BLOCK, Element, Tree

# What class and id say about a block, what is no text, and the scores of blocks that hold paragraphs.
FURNITURE = re.compile(r"(?i)advert|banner|breadcrumb|combx|comment|community|cookie|disqus|extra|footer|gdpr|header|legends|menu|nav|pager|pagination|popup|related|remark|replies|rss|shoutbox|sidebar|skyscraper|social|sponsor|supplemental|yom-remote")
MAYBE = re.compile(r"(?i)and|article|body|column|content|main|shadow")
GOOD = re.compile(r"(?i)article|body|content|entry|hentry|h-entry|main|page|pagination|post|text|blog|story")
BAD = re.compile(r"(?i)hidden|banner|combx|comment|com-|contact|footer|gdpr|masthead|media|meta|outbrain|promo|related|scroll|share|shoutbox|sidebar|skyscraper|sponsor|shopping|tags|widget")
BYLINE = re.compile(r"(?i)byline|author|dateline|writtenby|p-author")
ROLES = frozenset("menu menubar complementary navigation alert alertdialog dialog".split())
UNSEEN = frozenset("script style noscript template svg head title iframe object embed textarea select button input math".split())
DROPPED = frozenset("form fieldset footer aside nav link".split())
SCORED = frozenset("p pre td section h2 h3 h4 h5 h6".split())
WEIGHTS = {"div": 5, "pre": 3, "td": 3, "blockquote": 3} | dict.fromkeys("address ol ul dl dd dt li form".split(), -3) | dict.fromkeys("h1 h2 h3 h4 h5 h6 th".split(), -5)
COMMAS = re.compile("[,،﹐︐︑⹁⸴⸲，]")
SEPARATOR = re.compile(r"\s[|\-–—\\/>»]\s")
#: Text of a paragraph that counts, ancestors that it counts for, and the text that an article should have.
LEAST_TEXT, LEVELS, ENOUGH = 25, 5, 500


def title_of(tree: Tree) -> str:
    """The page's own title without the name of the site."""
    for i in tree.named("meta"):
        a = tree.elements[i].attributes
        if (a.get("property") or a.get("name") or "").strip().lower() in ("og:title", "twitter:title", "dc:title", "dcterm:title") and a.get("content", "").strip():
            return " ".join(a["content"].split())
    first = next(iter(tree.named("title")), None)
    whole = " ".join(tree.text(first).split()) if first is not None else ""
    found, cut = whole, False
    if parts := list(SEPARATOR.finditer(whole)):
        cut = True
        found = whole[: parts[-1].start()]
        if len(found.split()) < 3:
            found = whole[parts[0].end() :]
    elif ": " in whole:
        heads = {" ".join(tree.text(i).split()) for name in ("h1", "h2") for i in tree.named(name)}
        if whole not in heads:
            found = whole.rsplit(":", 1)[1]
            if len(found.split()) < 3:
                found = whole.split(":", 1)[1]
    elif not 15 <= len(whole) <= 150:
        heads = tree.named("h1")
        if len(heads) == 1:
            found = tree.text(heads[0])
    found = " ".join(found.split())
    if len(found.split()) <= 4 and not (cut and len(found.split()) == len(SEPARATOR.sub(" ", whole).split()) - 1):
        found = whole
    return found


def byline_of(tree: Tree) -> str | None:
    for i in tree.named("meta"):
        a = tree.elements[i].attributes
        said = a.get("content", "").strip()
        if (a.get("property") or a.get("name") or "").strip().lower() in ("author", "dc:creator", "article:author") and said and "://" not in said:
            return " ".join(said.split())
    for i, e in enumerate(tree.elements):
        a = e.attributes
        if a and (a.get("rel") == "author" or "author" in a.get("itemprop", "") or BYLINE.search(a.get("class", "") + " " + a.get("id", ""))):
            said = " ".join(tree.text(i).split())
            if 0 < len(said) < 100:
                return said
    return None


def _says(e: Element) -> str:
    return e.attributes.get("class", "") + " " + e.attributes.get("id", "")


def _class_weight(e: Element) -> int:
    out = 0
    for key in ("class", "id"):
        said = e.attributes.get(key, "")
        if said:
            out += 25 * (GOOD.search(said) is not None) - 25 * (BAD.search(said) is not None)
    return out


class _Page:
    """Sums over the elements of a page that are read: text, text in links, commas."""

    def __init__(self, tree: Tree, strict: bool):
        self.tree = tree
        e = tree.elements
        self.skip = [False] * len(e)
        self.own: list[list[int]] = [[] for _ in e]
        for i, x in enumerate(e[1:], 1):
            said = _says(x)
            unlikely = strict and x.name not in ("body", "a", "html") and len(said) > 1 and FURNITURE.search(said) and not MAYBE.search(said)
            hidden = "hidden" in x.attributes or "display:none" in x.attributes.get("style", "").replace(" ", "").lower() or (strict and x.attributes.get("role") in ROLES)
            self.skip[i] = self.skip[x.parent] or x.name in UNSEEN or bool(unlikely) or hidden
        owner = self._owners()
        self.size, self.linked, self.commas = ([0] * len(e) for _ in range(3))
        for k, piece in enumerate(tree.pieces):
            o = owner[k]
            if not self.skip[o]:
                self.own[o].append(k)
                self.size[o] += len(" ".join(piece.split()))
                self.commas[o] += len(COMMAS.findall(piece))
        inside = [False] * len(e)
        for i, x in enumerate(e[1:], 1):
            inside[i] = inside[x.parent] or x.name == "a"
            self.linked[i] = self.size[i] if inside[i] else 0
        self.blocks = [0] * len(e)
        for i in range(len(e) - 1, 0, -1):
            p = e[i].parent
            self.size[p] += self.size[i]
            self.linked[p] += self.linked[i]
            self.commas[p] += self.commas[i]
            self.blocks[p] += not self.skip[i] and (e[i].name in BLOCK or self.blocks[i] > 0)

    def _owners(self) -> list[int]:
        """The innermost element of each piece of text."""
        out = [0] * len(self.tree.pieces)
        for i, x in enumerate(self.tree.elements):
            if not x.children:
                out[x.first : x.last] = [i] * (x.last - x.first)
                continue
            at = x.first
            for c in x.children:
                child = self.tree.elements[c]
                out[at : child.first] = [i] * (child.first - at)
                at = child.last
            out[at : x.last] = [i] * (x.last - at)
        return out

    def density(self, i: int) -> float:
        return self.linked[i] / self.size[i] if self.size[i] else 0.0

    def scores(self, weigh: bool) -> dict[int, float]:
        e, found = self.tree.elements, defaultdict(float)
        started: set[int] = set()
        for i, x in enumerate(e[1:], 1):
            paragraph = x.name in SCORED or (x.name == "div" and not self.blocks[i])
            if self.skip[i] or not paragraph or self.size[i] < LEAST_TEXT:
                continue
            points = 2 + self.commas[i] + min(self.size[i] // 100, 3)
            up = x.parent
            for level in range(LEVELS):
                if up <= 0:
                    break
                if up not in started:
                    started.add(up)
                    found[up] += WEIGHTS.get(e[up].name, 0) + (_class_weight(e[up]) if weigh else 0)
                found[up] += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
                up = e[up].parent
        return {i: s * (1 - self.density(i)) for i, s in found.items()}

    def joined(self, top: int, scores: dict[int, float]) -> list[int]:
        """The best block and those beside it that belong to it."""
        e = self.tree.elements
        least = max(10.0, 0.2 * scores[top])
        out = []
        for i in e[e[top].parent].children if e[top].parent >= 0 else [top]:
            alike = 0.2 * scores[top] if e[i].attributes.get("class") and e[i].attributes["class"] == e[top].attributes.get("class") else 0
            short = 0 < self.size[i] <= 80 and self.density(i) == 0 and "." in self.tree.text(i)[-3:]
            if i == top or (not self.skip[i] and (scores.get(i, -1e9) + alike >= least or (e[i].name == "p" and ((self.size[i] > 80 and self.density(i) < 0.25) or short)))):
                out.append(i)
        return out

    def text(self, blocks: list[int], clean: bool, title: str) -> str:
        """Text of blocks, without what is dropped; clean: also without blocks that are mostly links."""
        e, out = self.tree.elements, []
        gone = [False] * len(e)
        headed = False
        for b in blocks:
            last = -1
            for i in range(b, e[b].end):
                x = e[i]
                drop = self.skip[i] or (i > b and (gone[x.parent] or x.name in DROPPED))
                if not drop and i > b and clean and x.name in ("div", "ul", "ol", "table", "section") and self.commas[i] < 10:
                    drop = (self.size[i] > 0 and self.density(i) > 0.5) or _class_weight(x) < 0
                if not drop and x.name in ("h1", "h2") and not headed and " ".join(self.tree.text(i).split()) == title:
                    drop = headed = True
                gone[i] = drop
                last = i
            if last >= 0:
                read = sorted(k for i in range(b, last + 1) if not gone[i] for k in self.own[i])
                out.append("".join(self.tree.pieces[k] for k in read))
        return "\n".join(out).strip()


def article(tree: Tree) -> tuple[str, str | None, str]:
    """title, byline, text. With too little text it is read again less strictly, and the longest reading counts; a page
    without any article has all text of its body."""
    title = title_of(tree)
    best = ""
    for strict, weigh, clean in ((True, True, True), (False, True, True), (False, False, True), (False, False, False)):
        page = _Page(tree, strict)
        scores = page.scores(weigh)
        top = max(scores, key=lambda i: (scores[i], -i), default=None)
        if top is None or scores[top] <= 0:
            top = next(iter(tree.named("body")), 0)
            blocks = [top]
        else:
            blocks = page.joined(top, scores)
        found = page.text(blocks, clean, title)
        if len(found) > len(best):
            best = found
        if len(best) >= ENOUGH:
            break
    if not best:
        body = next(iter(tree.named("body")), 0)
        best = tree.text(body).strip()
    return title, byline_of(tree), best


def nested_style(tree: Tree) -> bool:
    """Whether a style sheet has a rule inside a rule, or a brace too many: what strict parsers of style sheets reject."""
    for i in tree.named("style"):
        kinds: list[bool] = []
        parts = tree.text(i).split("/*")
        css = parts[0] + "".join(p.partition("*/")[2] for p in parts[1:])
        css = re.sub(r"\"[^\"\n]*\"|'[^'\n]*'", "", css)
        at = 0
        for m in re.finditer(r"[{};]", css):
            before = css[at : m.start()].strip()
            at = m.end()
            if m[0] == "{":
                if kinds and kinds[-1]:
                    return True
                kinds.append(not before.startswith("@") or before.startswith(("@font-face", "@page")))
            elif m[0] == "}":
                if not kinds:
                    return True
                kinds.pop()
    return False
