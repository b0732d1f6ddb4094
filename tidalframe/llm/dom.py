"""Pages as flat trees, for ``extract``: block elements and runs of text in page order.

A node is a block element or a leaf, a run of inline content between two block
boundaries with its character references decoded and its white space (as
``str.split`` has it) made one space. ``end`` is one past a node's last descendant, so sums
over subtrees are differences of prefix sums.

Forgiving: end tags may be missing, stray, crossed or in capitals, quotes
unbalanced, comments and scripts unclosed; a tag that the page ends in is text.
Time is linear in the page.
"""

from __future__ import annotations

import html
import re
from collections import Counter

#: Elements without an end tag, elements that hold no text of a page, and elements that are blocks (fixed values of HTML).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
SILENT = frozenset("select button datalist object audio video canvas svg map head".split())
BLOCK = frozenset(
    """address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption""".split()
)
CONTROL = frozenset("input select button textarea option".split())
#: What the start of an element ends, up to the elements behind the bar.
_ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tbody": ("tr td th tbody thead tfoot", "table")}
_ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in _ENDS.items()}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)>|<[!?/][^>]*>""", re.S)
_NAMED = re.compile(r"""(?:^|\s)(?:class|id|role|itemprop|itemtype|aria-label|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_CAPITALS, _DIGITS = re.compile("[A-ZÀ-Þ]"), re.compile(r"\d")
_MARKS = re.compile(r"[.!?。！？]")


def names_of(tag: str, attributes: str) -> tuple[str, ...]:
    """The tag and the words of the attributes that name an element, lower-cased: ``entry-content`` and ``entryContent`` give the same."""
    words = {w.lower() for m in _NAMED.finditer(attributes) for w in _WORD.findall((m[1] or m[2] or m[3] or "")) if len(w) > 1} if attributes else ()
    return (f"<{tag}>", *sorted(words))


class Forest:
    """Pages read one after the other; each node's fields are at its place in the lists."""

    FIELDS = "parent end depth leaf tag names chars linked words marks commas capitals digits controls inline".split()

    def __init__(self) -> None:
        for f in self.FIELDS:
            setattr(self, f, [])
        self.text: dict[int, str] = {}
        #: One past the last node of each page.
        self.pages: list[int] = []

    def _add(self, parent: int, depth: int, leaf: bool, tag: str, names: tuple[str, ...], *counts: int) -> int:
        at = len(self.parent)
        for f, x in zip(self.FIELDS, (parent, at + 1, depth, leaf, tag, names, *(counts or (0,) * 9)), strict=True):
            getattr(self, f).append(x)
        return at

    def read(self, page: str) -> None:
        """Add a page: its document node, then its elements and leaves in order."""
        stack: list[tuple[str, int]] = [("", self._add(-1, 0, False, "", ()))]
        open_, held = Counter(), []
        linked, link_level, inline, silent = 0, 0, 0, ""
        quiet = 0  # open elements named `silent`

        def flush() -> None:
            nonlocal linked, inline
            if held:
                text = " ".join("".join(held).split())
                held.clear()
                if text:
                    words = text.count(" ") + 1
                    names = tuple(f"={w}" for w in sorted(set(text.lower().split()))) if words <= 5 else ()
                    counts = (len(text), min(linked, len(text)), words, len(_MARKS.findall(text)), text.count(","), len(_CAPITALS.findall(text)), len(_DIGITS.findall(text)), 0, inline)
                    at = self._add(stack[-1][1], len(stack), True, stack[-1][0], names, *counts)
                    self.text[at] = text
            linked = inline = 0

        def close(level: int) -> None:
            nonlocal link_level
            while len(stack) > level:
                tag, node = stack.pop()
                open_[tag] -= 1
                self.end[node] = len(self.parent)
            if link_level > len(stack):
                link_level = 0

        pos, stop = 0, page.rfind(">") + 1
        while pos < stop:
            m = _TAG.search(page, pos, stop)
            data = page[pos : m.start() if m else len(page)]
            if data and not silent:
                piece = html.unescape(data) if "&" in data else data
                held.append(piece)
                if link_level:
                    linked += len(piece.strip())
            if not m:
                pos = len(page)
                break
            pos = m.end()
            if m[2] is None:
                if m[0].startswith("<!--") and not m[0].endswith("-->"):
                    pos = len(page)
                continue
            tag = m[2].lower()
            if silent:
                if tag == silent:
                    quiet += -1 if m[1] else 1
                    silent = silent if quiet else ""
                elif tag == "body" and silent == "head":
                    silent = ""
                if silent:
                    if not m[1] and tag in RAW:
                        pos = self._behind(page, tag, pos)
                    continue
                if tag != "body":
                    continue
            if m[1]:
                if tag == "a":
                    link_level = 0
                elif open_[tag] > 0:
                    flush()
                    level = len(stack) - 1
                    while stack[level][0] != tag:
                        level -= 1
                    close(level)
                elif tag in BLOCK:
                    flush()
                continue
            if tag in CONTROL:
                self.controls[stack[-1][1]] += 1
            if tag in RAW:
                pos = self._behind(page, tag, pos)
            elif tag in SILENT:
                if not m[3].endswith("/"):
                    silent, quiet = tag, 1
            elif tag in BLOCK or "-" in tag:
                flush()
                if stack[-1][0] == "p":
                    close(len(stack) - 1)
                if tag in _ENDS:
                    ended, bound = _ENDS[tag]
                    level = len(stack)
                    while level > 1 and stack[level - 1][0] not in bound:
                        level -= 1
                        if stack[level][0] in ended:
                            close(level)
                            if tag not in ("tr", "tbody"):
                                break
                        elif len(stack) - level > 20:  # an old one that far up stays open
                            break
                elif tag in ("body", "html") and open_[tag]:
                    continue
                node = self._add(stack[-1][1], len(stack), False, tag, names_of(tag, m[3]))
                stack.append((tag, node))
                open_[tag] += 1
            elif tag == "br" or tag == "hr":
                if tag == "hr":
                    flush()
                else:
                    held.append(" ")
            else:
                inline += 1
                if tag == "a":
                    link_level = len(stack)
        if not silent and pos < len(page):
            held.append(html.unescape(page[pos:].partition("<!--")[0]))
        flush()
        close(0)
        self.pages.append(len(self.parent))

    @staticmethod
    def _behind(page: str, tag: str, pos: int) -> int:
        """The place behind the end tag of an element whose content is no markup."""
        m = _RAW_END[tag].search(page, pos)
        return m.end() if m else len(page)


_RAW_END = {t: re.compile(rf"</{t}(?:\s[^>]*)?>", re.I) for t in RAW}
