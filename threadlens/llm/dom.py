"""HTML pages as forests of nodes in arrays, and the text of chosen nodes as blocks."""

from __future__ import annotations

import html
import re
from collections import Counter

_words = lambda s: frozenset(s.split())
# Element names of the HTML standard.
VOID = _words("area base br col embed hr img input link meta param source track wbr")
RAW = _words("script style noscript iframe template noembed noframes xmp svg math textarea select object canvas")
BLOCK = _words(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li listing main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul"
)
FORMATTING = _words("a abbr b big cite code em font i label nobr q s small span strike strong sub sup tt u")
CELLS = _words("table td th caption")
_TABLE = _words("table caption tbody thead tfoot tr td th")
#: What a start tag closes: these elements, as far as the nearest of those.
CLOSES = {
    **dict.fromkeys(BLOCK - _words("body caption dd dt head html legend li optgroup option tbody td tfoot th thead title tr"), (_words("p"), CELLS | _words("button"))),
    "li": (_words("li p"), _words("ul ol menu") | CELLS),
    **dict.fromkeys(("dt", "dd"), (_words("dt dd p"), _words("dl") | CELLS)),
    **dict.fromkeys(("td", "th"), (_words("td th"), _words("tr table"))),
    "tr": (_words("tr td th"), _words("table")),
    **dict.fromkeys(("tbody", "thead", "tfoot"), (_words("tbody thead tfoot tr td th caption"), _words("table"))),
}

#: A quote opens a value only after an equals sign; nothing is read twice, whatever is left open.
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
_NAMES = re.compile(r"(?<![^\s\"'])(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)", re.I)
_MARK = re.compile(r"\bdata-main=\"([01])\"")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
TEXT, ROOT, FRAGMENT = "#text", "#root", "#fragment"
_EDGE, _BREAK = -1, -2


class Page:
    """A page's nodes in page order: tag, parent (-1 for the root), depth, words of class, id and role, text;
    ``marks``, the labels that ``data-main`` attributes give; and ``flow``, the order of texts (their nodes),
    edges of blocks and line breaks."""

    def __init__(self, source: str):
        self.tags, self.parents, self.depths, self.names, self.texts = [ROOT], [-1], [0], [()], [""]
        self.marks: dict[int, bool] = {}
        self.flow: list[int] = []
        self._stack, self._open = [0], Counter()
        self._read(source)

    def _node(self, tag: str, names: tuple[str, ...], text: str) -> int:
        self.tags.append(tag)
        self.parents.append(self._stack[-1])
        self.depths.append(len(self._stack))
        self.names.append(names)
        self.texts.append(text)
        return len(self.tags) - 1

    def _text(self, raw: str) -> None:
        if raw.strip():
            self.flow.append(self._node(TEXT, (), html.unescape(raw) if "&" in raw else raw))
        elif raw:
            self.flow.append(_BREAK)

    def _close_to(self, height: int) -> None:
        while len(self._stack) > height:
            tag = self.tags[self._stack.pop()]
            self._open[tag] -= 1
            if tag in BLOCK:
                self.flow.append(_EDGE)

    def _start(self, tag: str, attributes: str) -> None:
        if tag in ("html", "body") and self._open[tag]:
            return
        if tag in CLOSES:
            targets, stops = CLOSES[tag]
            if any(self._open[t] for t in targets):
                height = len(self._stack)
                for at in range(len(self._stack) - 1, 0, -1):
                    name = self.tags[self._stack[at]]
                    if name in stops:
                        break
                    if name in targets:
                        height = at
                        if name == tag or tag not in _TABLE and (name != "p" or tag not in ("li", "dt", "dd")):
                            break
                self._close_to(height)
        if tag == "br":
            self.flow.append(_BREAK)
        if tag in BLOCK:
            self.flow.append(_EDGE)
        if tag not in VOID:
            named = _NAMES.findall(attributes) if attributes and "=" in attributes else ()
            words = tuple(dict.fromkeys(w.lower() for _, value in named for w in _PARTS.findall(value)))
            if (mark := _MARK.search(attributes)) if attributes else None:
                self.marks[len(self.tags)] = mark[1] == "1"
            self._stack.append(self._node(tag, words, ""))
            self._open[tag] += 1

    def _end(self, tag: str) -> None:
        if not self._open[tag]:
            return
        for at in range(len(self._stack) - 1, 0, -1):
            name = self.tags[self._stack[at]]
            if name == tag:
                self._close_to(at)
                return
            if (tag in FORMATTING and name in BLOCK) or (name in CELLS and tag not in _TABLE | {"body", "html"}):
                return

    def _read(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            begin = source.find("<", at)
            if begin < 0:
                self._text(source[at:])
                break
            tag = _TAG.match(source, begin)
            if tag:
                if begin > at:
                    self._text(source[at:begin])
                name, at = tag[2].lower(), tag.end()
                if tag[1]:
                    self._end(name)
                    continue
                self._start(name, tag[3])
                if name in RAW and not tag[3].endswith("/"):  # what it holds is no text of the page
                    over = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(source, at)
                    at = over.start() if over else n
                continue
            if source.startswith("<!--", begin):
                over = source.find("-->", begin + 2)
                over = n if over < 0 else over + 3
            elif source[begin + 1 : begin + 2] in ("!", "?", "/"):
                over = source.find(">", begin)
                over = n if over < 0 else over + 1
            elif source[begin + 1 : begin + 2].isalpha() and source[begin + 1].isascii():
                over = n  # a tag that never ends
            else:  # a plain sign: text runs on to the next that could be a tag
                over = source.find("<", begin + 1)
                over = n if over < 0 else over
                self._text(source[at:over])
                at = over
                continue
            if begin > at:
                self._text(source[at:begin])
            at = over
        self._close_to(1)
        if "html" not in self.tags and "body" not in self.tags:
            self.tags[0] = FRAGMENT

    def text_of(self, content) -> str:
        """The texts of the nodes for which ``content`` holds: white space is one space, blocks are two line feeds apart."""
        blocks, now = [], []
        for node in [*self.flow, _EDGE]:
            if node == _EDGE:
                if now and (block := " ".join("".join(now).split())):
                    blocks.append(block)
                now = []
            elif node == _BREAK:
                now.append(" ")
            elif content[node]:
                now.append(self.texts[node])
        return "\n\n".join(blocks)
