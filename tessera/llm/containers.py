"""A page as containers and blocks of text, enough of HTML for that: see parse."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_HEADING = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_LEAF = frozenset("p pre blockquote li dt dd caption figcaption th summary legend".split()) | _HEADING
_CONTAINER = frozenset("html body main article section div td center table tbody thead tfoot tr ul ol dl figure details hgroup header fieldset address".split())
_BLOCK = _LEAF | _CONTAINER | frozenset("head nav footer aside form menu dialog option optgroup dir".split())
_UNSEEN = frozenset("head nav footer aside form menu dialog template noscript svg canvas object audio video button select label math map".split()) | _RAW
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tr", "td", "th", "thead", "tbody"), "thead": ("tr", "td", "th"), "tfoot": ("tr", "td", "th", "tbody")}
_SCOPE = frozenset("table ul ol dl select div section article".split())
#: Parts of class, id and role that name what isn't the article.
_ASIDE = frozenset(
    """ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies
    copyright dialog disclaimer discussion disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination
    popup promo promotion recommendations recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored
    subscribe subscription tagcloud toolbar topbar widget widgets complementary contentinfo navigation alert alertdialog""".split()
)
_MAIN = frozenset("article articlebody content entry main post story".split())
_NOT_OWN = frozenset(("has", "no", "with", "without"))
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_a-zA-Z]+")
_DIGITS = re.compile(r"\d+")


def _parts(value: str) -> set[str]:
    """Lower-case words of a class or id; what follows `with` or `no` in a name isn't said of the element itself."""
    out = set()
    for name in value.split():
        words = [w.lower() for w in _PART.findall(name)]
        cut = next((k for k, w in enumerate(words) if w in _NOT_OWN), len(words))
        out.update(words[:cut])
    return out


class Page:
    """Containers in page order: parent, label, weight (of an article's mark-up), seen. Blocks in page order: (container, text, links' share of it, whether it is prose by its tag or lies in an article)."""

    def __init__(self) -> None:
        self.parent, self.label, self.weight, self.seen = [-1], ["#page"], [1.0], [True]
        self.blocks: list[tuple[int, str, float, bool]] = []

    def path(self, node: int) -> str:
        labels = []
        while node > 0:
            labels.append(self.label[node])
            node = self.parent[node]
        return ">".join(reversed(labels))

    def scores(self) -> list[float | None]:
        """For each container the worth of its blocks: the length of what is prose, less that of links, and of what isn't by its tag
        what goes beyond 40 characters; None without blocks."""
        out: list[float | None] = [None] * len(self.parent)
        for node, text, linked, prose in self.blocks:
            n = len(text)
            worth = -n if linked > 0.5 else n * (1 - linked) if prose else max(0, n - 40)
            out[node] = (out[node] or 0) + worth
        for node in range(len(out) - 1, 0, -1):
            if out[node] is not None:
                above = self.parent[node]
                out[above] = (out[above] or 0) + out[node]
        return out

    def best(self, scores: list[float | None]) -> int | None:
        """The container that is worth most, the deepest among equals; mark-up as an article counts half as much
        again. The page as a whole if none is worth anything, None if it has no text."""
        found, most = None if scores[0] is None else 0, 0.0
        for node, score in enumerate(scores):
            if score is not None and score > 0 and score * self.weight[node] >= most:
                found, most = node, score * self.weight[node]
        return found


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)}


def parse(html: str) -> Page:
    """The containers of a page and the blocks of text that may be its article's.

    A block is the text between two tags that begin or end a block, with white space as one space and
    character references decoded. Not seen are scripts, styles, forms, menus and other elements that
    are no part of an article by their tag, by a class, id or role that says so, or as they are hidden;
    lists outside of an article of which over four fifths are links, three at least, count as menus.
    """
    page = Page()
    # tag, container, seen, block of text (its own or the one it is within), in an article
    stack: list[tuple[str, int, bool, str, bool]] = [("#page", 0, True, "#page", False)]
    opened: Counter[str] = Counter()
    pieces: list[str] = []
    linked, link_depth = 0, 0
    lists: dict[int, list[int]] = {}  # container of a list outside of an article: its length, that of its links, their number

    def flush() -> None:
        nonlocal linked
        if pieces:
            _, node, _, leaf, inside = stack[-1]
            if text := " ".join("".join(pieces).split()):
                page.blocks.append((node, text, min(1.0, linked / len(text)), inside or leaf in _LEAF))
            pieces.clear()
        linked = 0

    def pop() -> None:
        nonlocal link_depth
        opened[stack.pop()[0]] -= 1
        if len(stack) <= link_depth:
            link_depth = 0

    def close(tag: str) -> None:
        while stack[-1][0] != tag:
            pop()
        pop()

    at, n = 0, len(html)
    last = html.rfind(">") + 1  # no tag ends after that
    while at < n:
        m = _TOKEN.search(html, at, last) if at < last else None
        upto = m.start() if m else n
        if upto > at and stack[-1][2]:
            piece = html[at:upto]
            if "&" in piece:
                piece = unescape(piece)
            pieces.append(piece)
            if link_depth:
                linked += len(piece)
        if not m:
            break
        at = m.end()
        if m[0].startswith("<!--") and not m[0].endswith("-->"):  # a comment without an end
            break
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if not opened[tag]:
                if tag in ("p", "br"):
                    flush() if tag == "p" else pieces.append(" ")
                continue
            if tag in _BLOCK:
                flush()
                close(tag)
            else:
                k = len(stack) - 1
                while stack[k][0] != tag and stack[k][0] not in _BLOCK and k:
                    k -= 1
                if stack[k][0] == tag:
                    close(tag)
            continue
        if tag == "br":
            if stack[-1][2]:
                pieces.append(" ")
            continue
        if tag == "hr":
            flush()
        if tag in _VOID:
            continue
        if tag in _BLOCK:
            flush()
            if opened["p"]:
                k = len(stack) - 1
                while stack[k][0] not in ("p", "td", "th", "button", "object"):
                    k -= 1
                if stack[k][0] == "p":
                    close("p")
            if tag in _HEADING and stack[-1][0] in _HEADING:
                pop()
            for other in _CLOSES.get(tag, ()):
                if opened[other]:
                    k = len(stack) - 1
                    while k and stack[k][0] != other and stack[k][0] not in _SCOPE:
                        k -= 1
                    if stack[k][0] == other:
                        close(other)
        elif tag == "a" and opened["a"] and link_depth:
            k = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == "a" or stack[k][0] in _BLOCK)
            if stack[k][0] == "a":
                close("a")
        _, node, seen, leaf, inside = stack[-1]
        given = _attributes(m[3]) if m[3] else {}
        if seen:
            named = " ".join(given[k] for k in ("class", "id", "role", "itemprop") if k in given)
            parts = _parts(named) if named else set()
            plain = tag not in ("html", "body", "main")
            seen = not (tag in _UNSEEN or (tag == "header" and not inside) or "hidden" in given or "display:none" in given.get("style", "").replace(" ", "").lower() or (plain and parts & _ASIDE))
            if tag in _CONTAINER and seen:
                inside = inside or tag in ("article", "main")
                label = _DIGITS.sub("0", ".".join([tag, *given.get("class", "").split()]) if given.get("class", "").strip() else tag + ("#" + given["id"] if given.get("id") else ""))
                page.parent.append(node)
                page.label.append(label)
                page.weight.append(1.5 if tag in ("article", "main") or "articlebody" in named.lower() else 1.25 if parts & _MAIN and tag not in ("html", "body") else 1.0)
                node = len(page.parent) - 1
                if tag in ("ul", "ol") and not inside:
                    lists[node] = [0, 0, 0]
                leaf = tag
            elif tag in _BLOCK:
                leaf = tag
        if tag == "a" and not link_depth and seen:
            link_depth = len(stack)
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in ("ul", "ol") and stack[k][1] in lists:
                    lists[stack[k][1]][2] += 1
                    break
        if tag in _RAW:
            end = re.compile(f"</{tag}", re.I).search(html, at)
            at = end.start() if end else n
        stack.append((tag, node, seen, leaf, inside))
        opened[tag] += 1
    flush()
    if lists:
        _drop_menus(page, lists)
    return page


def _drop_menus(page: Page, lists: dict[int, list[int]]) -> None:
    """Takes away the blocks of lists that are menus."""
    of: list[int] = []
    for node, above in enumerate(page.parent):
        of.append(node if node in lists else of[above] if above >= 0 else -1)
    for node, text, linked, _ in page.blocks:
        if of[node] >= 0:
            lists[of[node]][0] += len(text)
            lists[of[node]][1] += linked * len(text)
    menus = {k for k, (n, links, count) in lists.items() if count >= 3 and links > 0.8 * n}
    page.blocks = [b for b in page.blocks if of[b[0]] not in menus]
