"""Block elements of an HTML page with their text, as flat lists; forgiving about unclosed and cut-off markup.

One pass from left to right, in time and memory in proportion to the page whatever it holds: no pattern gives back what
it matched, and which elements are open is known by tag."""

from __future__ import annotations

import html
import re

#: A tag's name, and its next attribute, read as browsers read them: a quote only bounds a value right after "=".
#: Nothing that these match is given back, so that a page takes time in proportion to its length.
NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
ATTRIBUTE = re.compile(r"""[\s/]*+(=?[^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)("|\Z)|'([^']*+)('|\Z)|([^\s>]*+)))?+""")
#: Text from a "<" on that starts no markup.
LOOSE = re.compile(r"(?:<(?![a-zA-Z/!?])[^<]*+)++")
#: Attributes whose words tell what an element is for.
TELLING = {"class", "id", "role", "itemprop", "aria-label"}
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: Elements whose content is no markup, and those whose text is never shown.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
HIDDEN = RAW | {"noscript", "template", "svg", "object", "select", "button", "datalist", "canvas", "head"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set(
    "html head body article aside section nav main header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption"
    " blockquote pre figure figcaption form fieldset legend address details summary dialog menu center hgroup search"
    " script style textarea title iframe noscript template svg object select button option optgroup".split()
)
#: Starting one of these ends an open element of the second set, up to one of the third.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
NO_P = {"table", "td", "th", "caption", "button", "object", "template"}


#: RAW elements end at their end tag only.
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.IGNORECASE) for t in RAW}


def _skipped(source: str, at: int) -> int:
    """Where markup that starts at "<" without being a tag ends: comments, declarations, or the page's end."""
    if not source.startswith("<!--", at):
        return source.find(">", at) + 1 or len(source)
    if source.startswith((">", "->"), at + 4):  # comments that end at once
        return source.index(">", at) + 1
    end = source.find("-->", at + 4)
    return end + 3 if end >= 0 else len(source)


def _attributes(source: str, at: int) -> tuple[int, list[str], bool]:
    """Where a tag ends (0 if the page ends first), the telling values among its attributes, and if it closes itself."""
    told: list[str] = []
    size = len(source)
    while True:
        m = ATTRIBUTE.match(source, at)
        at = m.end()
        if at < size and m[1] and m[1].lower() in TELLING and (value := m[2] or m[4] or m[6]):
            told.append(value)
        if at >= size:
            return 0, told, False
        if source[at] == ">":
            return at + 1, told, source[at - 1] == "/" and not m[6]


class Page:
    """tags, parents, words (of class, id and the like) by element in page order; runs: (element, text, characters
    inside links) for each piece of text between two block bounds, with white space made one space."""

    def __init__(self, source: str) -> None:
        self.tags, self.parents, self.words = ["#page"], [-1], [()]
        self.runs: list[tuple[int, str, int]] = []
        open_ = [0]
        at_of: dict[str, list[int]] = {}  # the places of a tag's open elements in open_
        text: list[str] = []
        linked, hidden, in_link = 0, 0, False

        def bound() -> None:
            nonlocal linked
            if text:
                run = " ".join("".join(text).split())
                if run:
                    self.runs.append((open_[-1], run, min(linked, len(run))))
                text.clear()
            linked = 0

        def close(to: int) -> None:
            """Ends the open elements from place to on."""
            nonlocal hidden, in_link
            for k in open_[to:]:
                at_of[self.tags[k]].pop()
                hidden -= self.tags[k] in HIDDEN
            del open_[to:]
            in_link = False

        def place(of: set[str], stop: set[str]) -> int:
            """The place of the last open element of the first set, if none of the second is inside it; else 0."""
            found = max((own[-1] for t in of if (own := at_of.get(t))), default=0)
            return found if found and not any((own := at_of.get(t)) and own[-1] > found for t in stop if t not in of) else 0

        def shown(piece: str) -> None:
            nonlocal linked
            if not hidden:
                if "&" in piece:
                    piece = html.unescape(piece)
                text.append(piece)
                if in_link:
                    linked += len(piece)

        at, size = 0, len(source)
        while at < size:
            if source[at] != "<":
                end = source.find("<", at)
                end = end if end >= 0 else size
                shown(source[at:end])
                at = end
                continue
            closing = source.startswith("</", at)
            m = NAME.match(source, at + 1 + closing)
            if not m:
                if closing or source.startswith(("<!", "<?"), at):
                    at = _skipped(source, at)
                else:
                    m = LOOSE.match(source, at)
                    shown(m[0])
                    at = m.end()
                continue
            tag = m[0].lower()
            at, told, alone = _attributes(source, m.end())
            if not at:  # cut off: no tag
                break
            if closing:
                if tag == "a":
                    in_link = False
                elif tag in BLOCK and (i := place({tag}, set())):
                    bound()
                    close(i)
                continue
            if tag == "a":
                in_link = True
            elif tag in VOID:
                if tag == "hr":
                    bound()
                elif tag in ("br", "wbr", "img"):
                    text.append(" " if tag == "br" else "")
            elif tag in BLOCK:
                bound()
                if tag in ENDS:
                    if i := place(*ENDS[tag]):
                        close(i)
                elif tag != "head" and tag not in HIDDEN and (i := place({"head"}, set())):
                    close(i)
                if tag not in HIDDEN and (i := place({"p"}, NO_P)):
                    close(i)
                if tag not in ("html", "body") or not place({tag}, set()):
                    self.tags.append(tag)
                    self.parents.append(open_[-1])
                    self.words.append(tuple(w.lower() for value in told for w in WORD.findall(value)))
                    if not alone:
                        at_of.setdefault(tag, []).append(len(open_))
                        open_.append(len(self.tags) - 1)
                        hidden += tag in HIDDEN
                        if tag in RAW:
                            end = RAW_END[tag].search(source, at)
                            at = end.start() if end else size
        bound()
