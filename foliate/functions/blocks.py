"""Where blocks, code, tags and destinations of a Markdown text stand: one pass over its lines, one over each leaf.

Blocks nest in quotes and list items, as CommonMark has it, with the tables of GitHub's dialect; a tag of the page's own
markup (``ELEMENTS``) that stands alone on its line opens a block that ends with its closing tag or at a blank line.
All positions are offsets of the source, so whoever rewrites a text gives edits of it, and what no edit touches stays
as it was written.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

#: The page's own elements, and CommonMark's names of HTML blocks that end at a blank line.
ELEMENTS = ("callout", "synced_block", "synced_block_reference", "columns")
HTML_BLOCKS = "address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|frameset|h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul"

_NAME = r"[A-Za-z][A-Za-z0-9_-]*+"
TAG = re.compile(rf"<(/?)({_NAME})(?=[\s/>])((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>")
#: What a scan of a leaf stops at: escapes, backticks, comments, tags, autolinks, brackets.
_INLINE = re.compile(rf"(?P<escape>\\[!-/:-@\[-`{{-~])|(?P<ticks>`+)|(?P<comment><!--(?:[^-]|-(?!->))*+-->)|(?P<cdata><!\[CDATA\[(?:[^\]]|\](?!\]>))*+\]\]>)|(?P<auto><[A-Za-z][A-Za-z0-9+.-]{{1,31}}:[^\s<>]*>)|(?P<tag>{TAG.pattern})|(?P<image>!\[)|(?P<open>\[)|(?P<close>\])")
_FENCE = re.compile(r"(`{3,}|~{3,})([^\n]*)")
_HEADING = re.compile(r"#{1,6}(?=[ \t]|$)")
_RULE = re.compile(r"(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_ITEM = re.compile(r"(?:([-+*])|(\d{1,9})([.)]))(?=[ \t]|$)")
_DELIMITERS = re.compile(r"\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
#: Kinds of HTML blocks: how each begins, how it ends (None: at a blank line), whether it may interrupt a paragraph.
_HTML = [
    (re.compile(r"<(?:script|pre|style|textarea)(?:[\s>]|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I), True),
    (re.compile(r"<!--"), re.compile(r"-->"), True),
    (re.compile(r"<\?"), re.compile(r"\?>"), True),
    (re.compile(r"<![A-Za-z]"), re.compile(r">"), True),
    (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>"), True),
    (re.compile(rf"</?(?:{HTML_BLOCKS})(?:\s|/?>|$)", re.I), None, True),
    (re.compile(rf"{TAG.pattern}[ \t]*$"), None, False),
]


class Block:
    """``lines`` are the spans of a leaf's lines without the marks of what they stand in; ``width`` is the columns of an item's mark."""

    __slots__ = ("kind", "start", "end", "children", "lines", "width", "mark", "info", "closed", "ends", "element")

    def __init__(self, kind: str, start: int, **fields) -> None:
        self.kind, self.start, self.end, self.children, self.lines = kind, start, start, [], []
        self.width, self.mark, self.info, self.closed, self.ends, self.element = 0, "", "", False, None, None
        for name, value in fields.items():
            setattr(self, name, value)

    def walk(self) -> Iterator[Block]:
        held = [self]
        while held:
            block = held.pop()
            yield block
            held.extend(reversed(block.children))


class _Depth:
    """Reads an element's lines once and tells where its closing tag ends: tags in comments, quotes and code don't count."""

    __slots__ = ("name", "depth", "inside")
    _STOPS = {"": re.compile(rf"<!--|<!\[CDATA\[|(`+)[^`].*?(?<!`)\1(?!`)|<(/?)({_NAME})"), "-->": re.compile("-->"), "]]>": re.compile(r"\]\]>"), ">": re.compile("[\"'>]"), '"': re.compile('"'), "'": re.compile("'")}

    def __init__(self, name: str) -> None:
        self.name, self.depth, self.inside = name, 0, [""]

    def feed(self, text: str, at: int, end: int) -> int | None:
        while m := self._STOPS[self.inside[-1]].search(text, at, end):
            at, found = m.end(), m[0]
            if len(self.inside) > 1:
                if found == self.inside[-1]:
                    self.inside.pop()
                    if found == ">":
                        if text[m.start() - 1] == "/" and self.depth and self.opened:
                            self.depth -= 1
                        if not self.depth:
                            return at
                else:
                    self.inside.append(found)
            elif found == "<!--":
                self.inside.append("-->")
            elif found == "<![CDATA[":
                self.inside.append("]]>")
            elif found[0] == "<":
                self.opened = m[3].lower() == self.name and not m[2]
                self.depth += (m[3].lower() == self.name) * (-1 if m[2] else 1)
                self.inside.append(">")
        return None

    __slots__ += ("opened",)


def parse(text: str) -> Block:
    """The tree of a text's blocks."""
    top = Block("document", 0)
    stack, leaf, depths = [top], None, {}
    start, size = 0, len(text)

    def blank_to(at: int, col: int, end: int) -> tuple[int, int]:
        while at < end and text[at] in " \t":
            col += 1 if text[at] == " " else 4 - col % 4
            at += 1
        return at, col

    def advance(at: int, col: int, end: int, n: int) -> tuple[int, int]:
        target = col + n
        while col < target and at < end and text[at] in " \t":
            step = 1 if text[at] == " " else 4 - col % 4
            if col + step > target:
                return at, target  # within a tab, whose rest counts on
            at, col = at + 1, col + step
        return at, col

    while start < size:
        stop = text.find("\n", start)
        stop = size if stop < 0 else stop
        end = stop - 1 if stop > start and text[stop - 1] == "\r" else stop
        at, col, depth = start, 0, 1
        while depth < len(stack):
            block = stack[depth]
            p, c = blank_to(at, col, end)
            if block.kind == "quote":
                if p >= end or c - col > 3 or text[p] != ">":
                    break
                at, col = advance(p + 1, c + 1, end, 1)
            elif block.kind == "item":
                if p < end and c - col < block.width or p >= end and not block.children:
                    break
                at, col = advance(at, col, end, block.width)
            depth += 1
        matched = depth == len(stack)
        p, c = blank_to(at, col, end)

        def close(to: int) -> None:
            nonlocal leaf
            del stack[to:]
            leaf = None

        def add(block: Block) -> Block:
            """``block`` in the innermost matched container; a list holds nothing but items."""
            nonlocal depth
            if block.kind != "item" and stack[depth - 1].kind == "list":
                depth -= 1
            close(depth)
            stack[-1].children.append(block)
            return block

        if leaf is not None and leaf.kind == "fence" and matched:
            m = _FENCE.match(text, p, end)
            if m and c - col <= 3 and m[1][0] == leaf.mark[0] and len(m[1]) >= len(leaf.mark) and not m[2].strip():
                leaf.closed = True
            else:
                leaf.lines.append((advance(at, col, end, min(leaf.width, c - col))[0], end))
            for block in (*stack, leaf):
                block.end = stop
            if leaf.closed:
                leaf = None
            start = stop + 1
            continue
        if leaf is not None and leaf.kind == "html" and matched and (p < end or leaf.ends is not None):
            leaf.lines.append((at, end))
            for block in (*stack, leaf):
                block.end = stop
            done = depths[id(leaf)].feed(text, at, end) if leaf.element else leaf.ends.search(text, at, end) if leaf.ends is not None else None
            if done is not None:
                leaf.closed = True
                if leaf.element and text[done:end].strip():  # what follows the closing tag on its line is read as a line of its own
                    leaf.lines[-1] = (at, done)
                    for block in (*stack, leaf):
                        block.end = done
                    start, leaf = done, None
                    continue
                leaf = None
            start = stop + 1
            continue
        if p >= end:
            if leaf is not None and leaf.kind != "indented":
                leaf = None
            if not matched:
                while depth > 1 and stack[depth - 1].kind == "list":
                    depth -= 1
                close(depth)
            start = stop + 1
            continue
        in_paragraph = leaf is not None and leaf.kind in ("paragraph", "table")
        lazy = in_paragraph and not matched
        if leaf is not None and not in_paragraph and not (leaf.kind == "indented" and matched and c - col >= 4):
            leaf = None
        made = None
        while made is None:
            p, c = blank_to(at, col, end)
            indent = c - col
            interrupts = in_paragraph and matched
            if p >= end:
                break
            if indent >= 4:
                if not in_paragraph and (leaf is None or leaf.kind != "indented"):
                    made = leaf = add(Block("indented", start))
                break
            ch = text[p]
            if ch == ">":
                stack.append(add(Block("quote", start)))
                depth, leaf, in_paragraph, lazy = len(stack), None, False, False
                at, col = advance(p + 1, c + 1, end, 1)
                continue
            if ch in "`~" and (m := _FENCE.match(text, p, end)) and not (ch == "`" and "`" in m[2]):
                made = add(Block("fence", start, mark=m[1], info=m[2].strip(), width=indent))
            elif ch == "#" and _HEADING.match(text, p, end):
                made = add(Block("heading", start, lines=[(p, end)]))
            elif ch in "=-" and interrupts and leaf.kind == "paragraph" and re.compile(r"(?:=+|-+)[ \t]*$").match(text, p, end):
                leaf.kind, made = "heading", leaf
            elif ch in "*-_" and _RULE.match(text, p, end):
                made = add(Block("rule", start))
            elif m := _ITEM.match(text, p, end):
                q, after = blank_to(m.end(), c + m.end() - p, end)
                empty = q >= end
                if interrupts and (empty or m[2] and int(m[2]) != 1):
                    break
                gap = after - (c + m.end() - p)
                width = indent + m.end() - p + (gap if 1 <= gap <= 4 and not empty else 1)
                mark = m[1] or m[3]
                if stack[depth - 1].kind != "list" or stack[depth - 1].mark != mark:
                    stack.append(add(Block("list", start, mark=mark)))
                    depth = len(stack)
                stack.append(add(Block("item", start, width=width, info=m[2] or "")))
                depth, leaf, in_paragraph, lazy = len(stack), None, False, False
                at, col = advance(m.end(), c + m.end() - p, end, width - indent - (m.end() - p))
            elif ch == "<" and (kind := next(((ends, always) for begins, ends, always in _HTML if begins.match(text, p, end) and (always or not interrupts)), None)):
                made = leaf = add(Block("html", start, lines=[(p, end)], ends=kind[0]))
                m = TAG.match(text, p, end)
                if m and m[2].lower() in ELEMENTS and not kind[1]:
                    if m[1]:
                        leaf.closed = True  # a closing tag alone
                    elif not m[3].rstrip().endswith("/"):
                        leaf.element = m[2].lower()
                        depths[id(leaf)] = own = _Depth(leaf.element)
                        own.feed(text, p, end)
                elif kind[0] is not None and kind[0].search(text, p + 2, end):
                    leaf.closed = True
            else:
                break
        if made is None and leaf is not None and leaf.kind in ("paragraph", "table") and (matched or lazy):
            if leaf.kind == "paragraph" and len(leaf.lines) == 1 and matched and "|" in text[slice(*leaf.lines[0])] and _DELIMITERS.match(text, p, end):
                leaf.kind = "table"
            leaf.lines.append((p, end))
            made = leaf
        elif made is None and leaf is not None and leaf.kind == "indented":
            leaf.lines.append((at, end))
            made = leaf
        elif made is None and p < end:
            made = leaf = add(Block("paragraph", start, lines=[(p, end)]))
        elif made is not None and made.kind == "indented":
            made.lines.append((at, end))
        for block in stack if made is None else (*stack, made):
            block.end = stop
        if made is not None:
            leaf = made if made.kind in ("paragraph", "table", "fence", "html", "indented") and not (made.kind == "html" and made.closed) else None
        start = stop + 1
    top.end = size
    return top


class Content:
    """A leaf's text without the marks of what it stands in, and where each of its characters is in the source."""

    def __init__(self, text: str, lines: list[tuple[int, int]]) -> None:
        self.text = "\n".join(text[a:b] for a, b in lines)
        self.starts, at = [], 0
        self.sources = [a for a, _ in lines]
        for a, b in lines:
            self.starts.append(at)
            at += b - a + 1

    def source(self, at: int) -> int:
        k = bisect_right(self.starts, at) - 1
        return self.sources[k] + at - self.starts[k]


class Span:
    """``kind``: code, comment, tag, autolink, link or image. ``dest`` and ``label`` are spans within the same text."""

    __slots__ = ("kind", "start", "end", "name", "closes", "attributes", "dest", "label", "bracketed")

    def __init__(self, kind: str, start: int, end: int, **fields) -> None:
        self.kind, self.start, self.end = kind, start, end
        self.name, self.closes, self.attributes, self.dest, self.label, self.bracketed = "", False, "", None, None, False
        for name, value in fields.items():
            setattr(self, name, value)


def _destination(text: str, at: int) -> tuple[int, int, bool, int] | None:
    """Start and end of the destination after ``](``, whether in angle brackets, and where the link ends."""
    space = re.compile(r"[ \t]*\n?[ \t]*")
    at = space.match(text, at).end()
    if text[at : at + 1] == "<":
        m = re.compile(r"<((?:\\.|[^<>\n\\])*+)>").match(text, at)
        if not m:
            return None
        start, end, after, bracketed = m.start(1), m.end(1), m.end(), True
    else:
        depth, end = 0, at
        while end < len(text):
            ch = text[end]
            if ch == "\\" and end + 1 < len(text):
                end += 2
                continue
            if ch <= " " or ch == ")" and not depth:
                break
            depth += (ch == "(") - (ch == ")")
            if depth > 32:
                return None
            end += 1
        if depth:
            return None
        start, after, bracketed = at, end, False
    m = re.compile(r"(?:[ \t]*\n?[ \t]*(?<=\s)(?:\"(?:\\.|[^\"\\])*+\"|'(?:\\.|[^'\\])*+'|\((?:\\.|[^()\\])*+\)))?[ \t]*\n?[ \t]*\)").match(text, after)
    return (start, min(end, len(text)), bracketed, m.end()) if m else None


def inlines(text: str) -> list[Span]:
    """Code, comments, tags, autolinks and links of a leaf's text, by where they begin."""
    ticks: dict[int, list[int]] = {}
    for m in re.finditer("`+", text):
        ticks.setdefault(len(m[0]), []).append(m.start())
    spans: list[Span] = []
    brackets: list[tuple[int, bool]] = []
    at = 0
    while m := _INLINE.search(text, at):
        at, kind = m.end(), m.lastgroup if m.lastgroup else ""
        kind = next(k for k in ("escape", "ticks", "comment", "cdata", "auto", "tag", "image", "open", "close") if m[k] is not None)
        if kind == "ticks":
            own = ticks[len(m[0])]
            k = bisect_right(own, m.start())
            if k < len(own):
                spans.append(Span("code", m.start(), own[k] + len(m[0])))
                at = spans[-1].end
        elif kind in ("comment", "cdata"):
            spans.append(Span("comment", m.start(), m.end()))
        elif kind == "auto":
            spans.append(Span("autolink", m.start(), m.end(), dest=(m.start() + 1, m.end() - 1)))
        elif kind == "tag":
            own = TAG.match(text, m.start())
            spans.append(Span("tag", m.start(), m.end(), name=own[2].lower(), closes=bool(own[1]), attributes=own[3]))
        elif kind in ("image", "open"):
            brackets.append((m.start(), kind == "image"))
        elif kind == "close" and brackets:
            begun, image = brackets.pop()
            found = _destination(text, at + 1) if text[at : at + 1] == "(" else None
            if found:
                start, end, bracketed, after = found
                spans.append(Span("image" if image else "link", begun, after, dest=(start, end), label=(begun + 1 + image, m.start()), bracketed=bracketed))
                at = after
                if not image:
                    brackets = [b for b in brackets if b[1]] if len(brackets) < 32 else []  # links hold no links
    return sorted(spans, key=lambda s: (s.start, -s.end))


def leaves(tree: Block) -> Iterator[Block]:
    return (b for b in tree.walk() if b.lines or b.kind in ("fence", "html"))


def code_ranges(text: str, tree: Block | None = None) -> list[tuple[int, int]]:
    """Source ranges of fenced and indented code and of code spans, in order; code spans of HTML blocks too."""
    found = []
    for block in leaves(tree or parse(text)):
        if block.kind in ("fence", "indented"):
            found.append((block.start, block.end))
        else:
            content = Content(text, block.lines)
            if "`" in content.text:
                found += [(content.source(s.start), content.source(s.end - 1) + 1) for s in inlines(content.text) if s.kind == "code"]
    return sorted(found)


class Edits:
    """Replacements of source ranges, which may not overlap; offsets can be taken over from the old text to the new one."""

    def __init__(self, edits: Iterable[tuple[int, int, str]] = ()) -> None:
        self.edits = sorted(edits)
        for (_, end, _), (start, _, _) in zip(self.edits, self.edits[1:], strict=False):
            if start < end:
                raise ValueError("edits overlap")
        self.starts = [e[0] for e in self.edits]
        self.shifts, shift = [], 0
        for start, end, new in self.edits:
            shift += len(new) - (end - start)
            self.shifts.append(shift)

    def apply(self, text: str) -> str:
        out, at = [], 0
        for start, end, new in self.edits:
            out += [text[at:start], new]
            at = end
        return "".join([*out, text[at:]])

    def moved(self, at: int, after: bool = True) -> int | None:
        """Where ``at`` is in the new text, None within a replaced range; text put in right there comes before it if ``after``."""
        k = (bisect_right if after else _bisect_left)(self.starts, at) - 1
        if k < 0:
            return at
        start, end, _ = self.edits[k]
        if start < at < end or start == at and end > at:
            return None
        return at + self.shifts[k]


def _bisect_left(values: list[int], at: int) -> int:
    from bisect import bisect_left

    return bisect_left(values, at)


def survive(ranges: list[tuple[int, int]], edits: Edits, old: str, new: str) -> bool:
    """Whether each range outside the edits is, with the same text, a code range of the new text as well."""
    now = set(code_ranges(new))
    for start, end in ranges:
        a, b = edits.moved(start), edits.moved(end, after=False)
        if a is None or b is None:
            continue  # an edit has part of it
        if (a, b) not in now or new[a:b] != old[start:end]:
            return False
    return True
