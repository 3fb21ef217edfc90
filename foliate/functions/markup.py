"""A page's own markup rewritten over the tree of its blocks: callouts, synced blocks, columns, tables, spans, broken fences.

Everything is an edit of the source, so text that isn't rewritten stays byte for byte.  What can't be told for certain
(tags that cross or don't close, fences with two possible ends) is left as it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from foliate.functions.blocks import TAG, Block, Content, Edits, Span, code_ranges, inlines, parse, survive
from foliate.functions.markdown import attribute, cell

SYNCED = ("synced_block", "synced_block_reference")
KNOWN = ("callout", *SYNCED)
_INLINE = re.compile("span|u|mention-.*|page|database|user")
_FENCE_LINE = re.compile(r"([ \t]*)(`{3,}|~{3,})([^\n]*)")
_SYNCED_LINE = re.compile(r"[ \t]*<(/?)(synced_block|synced_block_reference)\b((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>[ \t]*", re.I)


# Broken fences -----------------------------------------------------------------------------------


def _width(indent: str) -> int:
    return sum(4 if ch == "\t" else 1 for ch in indent)


def _line(text: str, at: int) -> tuple[int, int]:
    end = text.find("\n", at)
    end = len(text) if end < 0 else end
    return text.rfind("\n", 0, at) + 1, end - 1 if end > at and text[end - 1] == "\r" else end


def _name(text: str, block: Block) -> str:
    m = TAG.match(text, block.lines[0][0])
    return m[2] if m else ""


def _breaks(text: str, tree: Block) -> Iterator[tuple[int, int, int, int, int]]:
    """``indent, start of the opening line, start of the body, start and end of the closing line`` of fences that a numbered
    list's last item opens and that its end cuts off.

    The closing line is either a fence of its own that nothing closes, or the one line of the paragraphs between that is
    a fence of the opening's kind and indentation.
    """
    held = [(tree, 0)]
    while held:
        parent, indent = held.pop()
        children = parent.children
        for k, block in enumerate(children):
            if block.kind != "quote":
                held.append((block, indent + block.width * (block.kind == "item")))
            if block.kind != "list" or block.mark not in ".)":
                continue
            last = block.children[-1]
            opened = last.children[-1] if last.children else None
            if opened is None or opened.kind != "fence" or opened.closed or opened.lines or not opened.info:
                continue
            start, end = _line(text, opened.start)
            mark = _FENCE_LINE.fullmatch(text, start, end)
            after = k + 1
            while after < len(children) and (children[after].kind == "paragraph" or children[after].kind == "html" and "_" in _name(text, children[after])):
                after += 1
            if mark is None or after == k + 1:
                continue
            body, own = min(len(text), text.find("\n", start) + 1), indent + last.width
            closing = children[after] if after < len(children) else None
            if closing is not None and closing.kind == "fence" and not closing.info and not closing.closed and closing.mark[0] == mark[2][0] and len(closing.mark) >= len(mark[2]):
                yield (own, start, body, *_line(text, closing.start))
                continue
            found = []
            for paragraph in children[k + 1 : after]:
                at = paragraph.start
                while at < paragraph.end:
                    line = _line(text, at)
                    m = _FENCE_LINE.fullmatch(text, *line)
                    if m and not m[3].strip() and _width(m[1]) == _width(mark[1]) and m[2][0] == mark[2][0] and len(m[2]) >= len(mark[2]):
                        found.append(line)
                    at = text.find("\n", at) + 1 or len(text)
            if len(found) == 1:
                yield (own, start, body, *found[0])


def _mend(text: str, breaks: list[tuple[int, int, int, int, int]], ranges: list[tuple[int, int]]) -> str | None:
    """The text with these fences set right, None if any code of it wouldn't survive or a body would change."""
    edits, bodies = [], []
    for indent, start, body, closing, end in breaks:
        lines = [x.removesuffix("\r") for x in text[body:closing].split("\n")[:-1]]
        bodies.append(lines)
        follows = text[end:].lstrip("\r")[1:].split("\n", 1)[0].strip() if len(text) - end < 4096 else text[end : end + 4096].lstrip("\r")[1:].split("\n", 1)[0].strip()
        pad = " " * indent
        edits.append((start, end, "\n".join([pad + text[start : body - 1].strip(), *(pad + x if x.strip() else "" for x in lines), pad + text[closing:end].strip()]) + ("\n" if follows else "")))
    moved = Edits(edits)
    new = moved.apply(text)
    tree = parse(new)
    fences = {b.start: b for b in tree.walk() if b.kind == "fence"}
    for k, lines in enumerate(bodies):
        fence = fences.get(edits[k][0] + (moved.shifts[k - 1] if k else 0))
        if fence is None or not fence.closed or [new[a:b].rstrip() if not new[a:b].strip() else new[a:b] for a, b in fence.lines] != [x if x.strip() else "" for x in lines]:
            return None
    return new if survive(ranges, moved, text, new) else None


def fences(text: str) -> str:
    """Code that a numbered list's item opens and that its lack of indentation cuts off, put back into the item."""
    if "```" not in text and "~~~" not in text:
        return text
    refused: set[str] = set()
    while True:
        tree = parse(text)
        found = [b for b in _breaks(text, tree) if text[b[1] : b[4]] not in refused]
        if not found:
            return text
        ranges = code_ranges(text, tree)
        new = _mend(text, found, ranges)
        if new is None:
            one = next(((b, new) for b in found if (new := _mend(text, [b], ranges)) is not None), None)
            refused |= {text[b[1] : b[4]] for b in found if one is None or b != one[0]}
            new = one[1] if one else text
        text = new


# Elements ----------------------------------------------------------------------------------------


def quoted(attributes: str, body: str) -> str:
    """A callout as a quote headed by its kind."""
    kind = attribute(attributes, "type") or "note"
    kind = kind.lower() if re.fullmatch(r"[A-Za-z][A-Za-z0-9-]*", kind) else "note"
    return "\n".join([f"> [!{kind}]", *(f"> {x}" if x else ">" for x in body.split("\n"))] if body else [f"> [!{kind}]"])


def _columns(value: str) -> str | None:
    body = re.fullmatch(r"<columns\b[^>]*>(.*)</columns>", value, re.I | re.S)
    if not body:
        return None
    out: list[str] = []
    for line in body[1].strip().split("\n"):
        tag = line.strip().lower()
        if tag == "</column>":
            out += [""] * (bool(out) and out[-1] != "")
        elif not re.fullmatch(r"<column\b[^>]*>", tag):
            out.append(line)
    return "\n".join(out).strip("\n")


_TABLE = re.compile(r"<table((?:\s[^>]*)?)>\s*(?:<colgroup(?:\s[^>]*)?>\s*(?:<col(?:\s[^>]*)?>\s*)*</colgroup>\s*)?((?:<tr(?:\s[^>]*)?>(?:(?!</tr>).)*</tr>\s*)*)</table>", re.I | re.S)
_CELLS = re.compile(r"\s*(?:<td((?:\s[^>]*)?)>((?:(?!</td>).)*)</td>\s*)*", re.I | re.S)


def table(value: str) -> str | None:
    """A table of plain rows and cells as aligned Markdown; None for anything else."""
    m = _TABLE.fullmatch(value)
    if not m:
        return None
    rows = []
    for row in re.findall(r"<tr(?:\s[^>]*)?>((?:(?!</tr>).)*)</tr>", m[2], re.I | re.S):
        if not _CELLS.fullmatch(row) or re.search(r"<td[^>]*\b(?:col|row)span\s*=", row, re.I):
            return None
        rows.append([cell(re.sub(r"\s*\n\s*", " ", x.strip())) for x in re.findall(r"<td(?:\s[^>]*)?>((?:(?!</td>).)*)</td>", row, re.I | re.S)])
    if not rows or not rows[0] or len({len(r) for r in rows}) != 1:
        return None
    if attribute(m[1], "header-row") != "true":
        rows.insert(0, [""] * len(rows[0]))
    widths = [max(1, *(len(r[k]) for r in rows)) for k in range(len(rows[0]))]
    line = lambda cells: "| " + " | ".join(x.ljust(w) for x, w in zip(cells, widths, strict=True)) + " |"
    return "\n".join([line(rows[0]), line(["-" * w for w in widths]), *map(line, rows[1:])])


def _unwrapped(body: str) -> str:
    """A synced block's body without the tags of further ones on lines of their own."""
    lines = body.split("\n")
    found = [(k, m) for k, line in enumerate(lines) if (m := _SYNCED_LINE.fullmatch(line)) and not m[3].rstrip().endswith("/")]
    stack: list[str] = []
    for _, m in found:
        if not m[1]:
            stack.append(m[2].lower())
        elif not stack or stack.pop() != m[2].lower():
            return body
    if stack:
        return body
    for k, _ in found:
        lines[k] = ""
    return "\n".join(lines)


def element(block: Block, content: Content) -> str | None:
    """What an HTML block of the page's own markup becomes; None if it stays."""
    value = content.text.strip()
    opening = TAG.match(value)
    if not opening:
        return None
    name, attributes = opening[2].lower(), opening[3]
    if name == "table_of_contents":
        return "" if opening.end() == len(value) and attributes.rstrip().endswith("/") else None
    if name == "table":
        return table(value)
    if not block.element or not block.closed:
        return None
    if name == "columns":
        return _columns(value)
    body = value[opening.end() : value.rfind("<")].strip()
    return quoted(attributes, body) if name == "callout" else rewritten(_unwrapped(body)).strip("\n")


# Paragraphs --------------------------------------------------------------------------------------


def _known(spans: list[Span]) -> list[Span]:
    return [s for s in spans if s.kind == "tag" and s.name in KNOWN and (s.closes or not s.attributes.rstrip().endswith("/"))]


def _open(tags: list[Span]) -> list[Span] | None:
    """Tags left open, None if some cross, close nothing or put a callout into a callout."""
    stack: list[Span] = []
    inside = 0
    for tag in tags:
        if tag.closes:
            if not stack or stack.pop().name != tag.name:
                return None
            inside -= tag.name == "callout"
        else:
            if tag.name == "callout" and inside:
                return None
            inside += tag.name == "callout"
            stack.append(tag)
    return stack


def _blocks(text: str, tags: list[Span]) -> list[str]:
    """What the tags part, callouts as quotes; the tags are in order and closed."""
    out: list[str] = []
    stack: list[tuple[Span, int]] = []
    at = 0
    for tag in tags:
        out += [x] if (x := text[at : tag.start].strip()) else []
        at = tag.end
        if not tag.closes:
            stack.append((tag, len(out)))
            continue
        opening, k = stack.pop()
        if opening.name == "callout":
            out[k:] = [quoted(opening.attributes, "\n\n".join(out[k:]))]
    return out + ([x] if (x := text[at:].strip()) else [])


def _crossed(spans: list[Span]) -> bool:
    stack: list[str] = []
    for tag in spans:
        if tag.kind == "tag" and _INLINE.fullmatch(tag.name) and not tag.attributes.rstrip().endswith("/"):
            if not tag.closes:
                stack.append(tag.name)
            elif not stack or stack.pop() != tag.name:
                return True
    return False


def small_tags(text: str, spans: list[Span]) -> str:
    """Colours as highlights, underlining as its own tag, discussions and tables of contents taken out; spans that cross other inline tags stay."""
    if _crossed(spans):
        spans = [s for s in spans if s.name != "span"]
    edits: list[tuple[int, int, str]] = []
    stack: list[Span] = []
    for tag in spans:
        if tag.kind != "tag":
            continue
        if tag.name == "table_of_contents" and tag.attributes.rstrip().endswith("/"):
            edits.append((tag.start, tag.end, ""))
        elif tag.name == "span" and not tag.closes:
            stack.append(tag)
        elif tag.name == "span" and stack:
            opening = stack.pop()
            color, line = attribute(opening.attributes, "color") is not None, attribute(opening.attributes, "underline") == "true"
            if color or line or attribute(opening.attributes, "discussion-urls") is not None:
                empty = opening.end == tag.start
                edits.append((opening.start, opening.end, "" if empty else "<u>" * line + "==" * color))
                edits.append((tag.start, tag.end, "" if empty else "==" * color + "</u>" * line))
    return Edits(edits).apply(text) if edits else text


def paragraph(text: str, joint: str = "\n\n") -> str:
    """A paragraph with its tags rewritten; known tags make blocks of what they hold, all or none of them."""
    if "<" not in text:
        return text
    text = small_tags(text, inlines(text))
    tags = _known(inlines(text))
    return joint.join(_blocks(text, tags)) if tags and _open(tags) == [] else text


def _unfinished(block: Block, content: Content) -> Span | None:
    """The callout or synced block that a leaf opens at its end and doesn't close, with nothing but plain text after it."""
    if block.kind == "html" and block.element in KNOWN and not block.closed:
        m = TAG.match(content.text)
        return Span("tag", 0, m.end(), name=block.element, attributes=m[3])
    if block.kind != "paragraph" or "<" not in content.text:
        return None
    spans = inlines(content.text)
    left = _open(_known(spans))
    if not left or len(left) != 1 or re.search(r"[*_~`\[<]", content.text[left[0].end :]):
        return None
    return left[0]


def _last_leaf(block: Block) -> Block:
    while block.children:
        block = block.children[-1]
    return block


def rewritten(text: str, html: bool = True, inline: bool = True, joins: bool = True) -> str:
    """Elements, paragraphs and callouts that a blank line or a list's end splits, rewritten."""
    edits: list[tuple[int, int, str]] = []
    held: list[tuple[list[Block], str, bool]] = [(parse(text).children, "", False)]
    taken: set[int] = set()
    parted: set[int] = set()

    def put(block: Block, new: str, prefix: str, tight: bool, before: Block | None, after: Block | None) -> None:
        """``new`` in place of a leaf, apart from its neighbours by blank lines."""
        start, end, gap = block.lines[0][0], block.end, "\n" + prefix.rstrip()
        if not new:  # its line goes, and the blank ones after it
            start = block.start if not text[block.start : start].strip() else start
            while end < len(text) and text[end] in " \t\r\n":
                end += 1
            end = text.rfind("\n", block.end, end) + 1 or end
            edits.append((start, end, ""))
            return
        new = new.replace("\n", "\n" + prefix).replace("\n" + prefix + "\n", "\n" + prefix.rstrip() + "\n")
        apart = new != text[start:end]
        if apart and after is not None and after.start <= block.end + 1 and not tight:
            new += gap
            parted.add(id(after))
        if apart and id(block) not in parted and block.kind == "html" and before is not None and block.start <= before.end + 1 and not tight and not text[block.start : start].strip(" \t>"):
            start, new = block.start, prefix.rstrip() + "\n" + prefix + new
        edits.append((start, end, new))

    while held:
        children, prefix, tight = held.pop()
        joint = "\n" if tight else "\n\n"
        for k, block in enumerate(children):
            before, after = children[k - 1] if k else None, children[k + 1] if k + 1 < len(children) else None
            if id(block) in taken:
                continue
            if block.kind in ("quote", "item", "list"):
                own = prefix + ("> " if block.kind == "quote" else " " * block.width)
                held.append((block.children, own, block.kind != "quote" and (tight if block.kind == "item" else "\n\n" not in text[block.start : block.end].replace("\r", ""))))
            closing = after is not None and after.kind == "html" and after.closed and not after.element and (m := TAG.match(text, after.lines[0][0])) is not None and m[1] and m[2].lower()
            if joins and closing in KNOWN and block.kind in ("list", "paragraph", "html"):
                leaf = _last_leaf(block)
                content = Content(text, leaf.lines)
                tag = _unfinished(leaf, content) if leaf.lines else None
                if tag is not None and tag.name == closing and (block.kind == "list" or leaf.kind == "paragraph"):
                    within, inner = prefix, tight
                    walk = block
                    while walk is not leaf:
                        within += " " * walk.width if walk.kind != "quote" else "> "
                        inner = inner or walk.kind == "list" and "\n\n" not in text[walk.start : walk.end]
                        walk = walk.children[-1]
                    begun = content.text[: tag.start]
                    begun = small_tags(begun, inlines(begun)) if "<" in begun else begun
                    first = _blocks(begun, _known(inlines(begun)))
                    body = content.text[tag.end :].strip()
                    last = [quoted(tag.attributes, body)] if closing == "callout" else [body] * bool(body)
                    put(leaf, ("\n" if inner else "\n\n").join([*first, *last]), within, True, None, None)
                    taken |= {id(after), id(leaf)}
                    edits.append((after.start - (after.start > block.end + 1), after.end, ""))  # one blank line stays
                    continue
            if not block.lines:
                continue
            content = Content(text, block.lines)
            if block.kind == "html" and html:
                new = element(block, content)
                if new is not None:
                    put(block, new, prefix, tight, before, after)
            elif block.kind in ("paragraph", "heading") and inline and "<" in content.text:
                new = paragraph(content.text, joint)
                if new != content.text:
                    put(block, new, prefix, tight, before, after if new.split("\n")[-1].startswith(">") else None)
            elif block.kind == "table" and inline:
                for line in block.lines:
                    own = text[slice(*line)]
                    new = small_tags(own, inlines(own)) if "<" in own else own
                    if new != own:
                        edits.append((*line, new))
    return Edits(edits).apply(text) if edits else text


def enhanced(text: str) -> str:
    """All of a page's own markup."""
    text = fences(text)
    return rewritten(text) if "<" in text else text


def inline_tags(text: str) -> str:
    return rewritten(text, html=False, joins=False) if "<" in text else text


def split_callouts(text: str) -> str:
    return rewritten(text, html=False, inline=False) if "<" in text else text
