"""Markdown rewriting kernels: plain functions of one page's text, run over Arrow batches.

A page is cut into code (fenced blocks and inline spans), which is never touched, and
the rest.  Each kernel rewrites the rest and fails closed: what it doesn't recognise
stays as it is.  Emphasis marks, list marks and table padding stay as the author wrote
them; only what is rewritten is formatted anew.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from urllib.parse import unquote, urlsplit

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})([^\n]*)$")
_INLINE_CODE = re.compile(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", re.S)
#: Callout kinds, and query keys that mark a short-lived signature.
CALLOUTS = frozenset("note abstract summary tldr info todo tip hint important success check done question help faq warning caution attention failure fail missing danger error bug example quote cite".split())
SIGNATURES = frozenset(x.lower() for x in "X-Amz-Signature X-Amz-Credential X-Amz-Algorithm X-Amz-Date X-Amz-Expires X-Amz-SignedHeaders X-Amz-Security-Token AWSAccessKeyId Signature Expires expirationTimestamp".split())


def parts(text: str) -> list[tuple[bool, str]]:
    """``(is_code, piece)`` in order; together they are the text."""
    out: list[tuple[bool, str]] = []
    held: list[str] = []
    fence = ""

    def flush() -> None:
        rest, at = "".join(held), 0
        for m in _INLINE_CODE.finditer(rest):
            if "\n\n" in m[0]:
                continue
            out.append((False, rest[at : m.start()]))
            out.append((True, m[0]))
            at = m.end()
        out.append((False, rest[at:]))
        held.clear()

    for line in text.splitlines(keepends=True):
        bare = line.rstrip("\r\n")
        m = _FENCE.match(bare)
        if fence:
            out.append((True, line))
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                fence = ""
        elif m and not (m[1][0] == "`" and "`" in m[2]):
            flush()
            out.append((True, line))
            fence = m[1]
        else:
            held.append(line)
    flush()
    return [(code, p) for code, p in out if p]


def outside_code(text: str, use: Callable[[str], str]) -> str:
    """``use`` on the text with each piece of code hidden behind a private mark."""
    codes: list[str] = []
    spoken = []
    for code, piece in parts(text):
        if code:
            spoken.append(f"\ue000{len(codes)}\ue001")
            codes.append(piece)
        else:
            spoken.append(piece.replace("\ue000", "\ue002").replace("\ue001", "\ue003"))
    out = re.sub("\ue000(\\d+)\ue001", lambda m: codes[int(m[1])], use("".join(spoken)))
    return out.replace("\ue002", "\ue000").replace("\ue003", "\ue001")


def empty_blocks(text: str) -> str:
    """A blank gap with an empty-block mark becomes one blank line, none at either end; fences stay."""
    end = "\r\n" if "\r\n" in text else "\n"
    mark = re.compile(r"^\s*<empty-block\s*/?>(?:</empty-block>)?\s*$", re.I)
    if not any(mark.match(x) for x in text.split(end)):
        return text
    out, gap, fence = [], [], ""

    def flush(more: bool) -> None:
        if any(mark.match(x) for x in gap):
            if out and more:
                out.append("")
        else:
            out.extend(gap)
        gap.clear()

    for line in text.split(end):
        m = _FENCE.match(line)
        if fence:
            out.append(line)
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                fence = ""
        elif not line.strip() or mark.match(line):
            gap.append(line)
        else:
            flush(True)
            out.append(line)
            fence = m[1] if m else ""
    flush(False)
    return end.join(out)


def _tag(name: str) -> re.Pattern:
    return re.compile(rf"<(/?){name}\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.I)


def attribute(tag: str, name: str) -> str | None:
    m = re.search(rf"(?:^|\s){name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", tag)
    return (m[1] if m[1] is not None else m[2]) if m else None


def elements(text: str, name: str, use: Callable[[str, str], str | None]) -> str:
    """``use(attributes, content)`` in place of each outermost element; None and unbalanced ones stay."""
    tag, out, at = _tag(name), [], 0
    while m := tag.search(text, at):
        out.append(text[at : m.start()])
        if m[1] or m[2].rstrip().endswith("/"):
            out.append(m[0])
            at = m.end()
            continue
        depth, close = 1, None
        for n in tag.finditer(text, m.end()):
            depth += -1 if n[1] else 0 if n[2].rstrip().endswith("/") else 1
            if not depth:
                close = n
                break
        if close is None:
            return "".join([*out, text[m.start() :]])
        made = use(m[2], text[m.end() : close.start()])
        out.append(text[m.start() : close.end()] if made is None else made)
        at = close.end()
    return "".join([*out, text[at:]])


def callouts(text: str) -> str:
    """A callout becomes a quote headed by its kind; unknown kinds are notes."""
    def one(attributes: str, content: str) -> str:
        kind = (attribute(attributes, "type") or "note").lower()
        body = callouts(content).strip("\n").split("\n")
        return "\n".join([f"> [!{kind if kind in CALLOUTS else 'note'}]", *(f"> {x}".rstrip() for x in body)])

    return elements(text, "callout", one)


def columns(text: str) -> str:
    """Columns one below the other, with a blank line between."""
    def one(_: str, content: str) -> str | None:
        found: list[str] = []
        rest = elements(content, "column", lambda _, x: found.append(columns(x).strip("\n")) or "")
        return None if rest.strip() or not found else "\n\n".join(found)

    return elements(text, "columns", one)


def synced(text: str) -> str:
    """Synced blocks and references to them, unwrapped to any depth, with a blank line to their neighbours."""
    for name in ("synced_block_reference", "synced_block"):
        while (new := elements(text, name, lambda _, x: "\n\n" + x.strip("\n") + "\n\n")) != text:
            text = new
    return re.sub(r"\n{3,}", "\n\n", text).lstrip("\n") if text else text


def small_tags(text: str) -> str:
    """Colours become highlights, underlining its tag; discussions are unwrapped; a table of contents alone on its line goes."""
    def span(attributes: str, content: str) -> str | None:
        inner = elements(content, "span", span)
        if attribute(attributes, "discussion-urls") is not None:
            return inner
        if (attribute(attributes, "underline") or "").lower() == "true":
            return f"<u>{inner}</u>"
        return f"=={inner}==" if attribute(attributes, "color") and "\n" not in inner else None

    text = re.sub(r"(?m)^[ \t]*<table_of_contents\b[^>\n]*/?>(?:</table_of_contents>)?[ \t]*\n?", "", text)
    return elements(text, "span", span)


def cell(text: str) -> str:
    text = re.sub(r"\r?\n", "<br>", text)
    return re.sub(r"(\\*)\|", lambda m: m[1] + ("\\|" if len(m[1]) % 2 == 0 else "|"), text)


def tables(text: str) -> str:
    """Strict HTML tables become Markdown; spans, captions, header cells, stray text or ragged rows keep the HTML."""
    def one(attributes: str, content: str) -> str | None:
        if re.search(r"<(?:th|caption|table)\b|\b(?:col|row)span\s*=", content, re.I):
            return None
        rows: list[list[str]] = []

        def row(_: str, inner: str) -> str:
            cells: list[str] = []
            rest = elements(inner, "td", lambda _, x: cells.append(cell(x.strip())) or "")
            rows.append([] if rest.strip() else cells)
            return ""

        bare = re.sub(r"</?(?:thead|tbody|tfoot|colgroup)\b[^>]*>|<col\b[^>]*/?>(?:</col>)?", "", content, flags=re.I)
        if elements(bare, "tr", row).strip() or not rows or not rows[0] or len({len(r) for r in rows}) != 1:
            return None
        head = rows[0] if (attribute(attributes, "header-row") or "").lower() == "true" else [""] * len(rows[0])
        body = rows[1:] if head is rows[0] else rows
        line = lambda cells: f"| {' | '.join(cells)} |"
        return "\n".join([line(head), line(["---"] * len(head)), *map(line, body)])

    return elements(text, "table", one)


_KNOWN = re.compile(r"<(/?)(span|u|mention-[a-z-]+|page|database|user|callout|columns?|synced_block(?:_reference)?)\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.I)


def crossed(paragraph: str) -> bool:
    """Whether known tags of a paragraph close in another order than they open, or not at all."""
    stack: list[str] = []
    for m in _KNOWN.finditer(paragraph):
        name = m[2].lower()
        if m[1]:
            if not stack or stack.pop() != name:
                return True
        elif not m[3].rstrip().endswith("/"):
            stack.append(name)
    return bool(stack)


_LINK = re.compile(r"(!?)\[((?:[^\[\]\\]|\\.|\[[^\[\]]*\])*)\]\(\s*<?([^\s()<>]+(?:\([^\s()]*\)[^\s()<>]*)*)>?(\s+(?:\"[^\"]*\"|'[^']*'))?\s*\)")
_MENTION = re.compile(r"<(page|mention-page)\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>(.*?)</\1>", re.I | re.S)


def page_id(url: str | None) -> str | None:
    try:
        u = urlsplit(url or "")
    except ValueError:
        return None
    host = (u.hostname or "").lower()
    last = unquote(next((s for s in reversed(u.path.split("/")) if s), ""))
    m = re.search(r"(?:[0-9a-f]{32}|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})$", last, re.I)
    return m[0].replace("-", "").lower() if m and u.scheme == "https" and (host == "notion.so" or host.endswith(".notion.so")) else None


def links(text: str, paths: dict[str, str]) -> str:
    """Links and mentions of known pages become wiki links; within a table row their bar is escaped."""
    def wiki(path: str, label: str, in_table: bool) -> str:
        bare = re.sub(r"\.md$", "", path.replace("\\", "/"), flags=re.I)
        alias = (label.strip() or bare.split("/")[-1] or bare).replace("\n", " ").replace("|", "\\|").replace("]", "\\]")
        return f"[[{bare}{chr(92) if in_table else ''}|{alias}]]"

    def use(rest: str) -> str:
        def in_table(at: int, whole: str) -> bool:
            return whole[whole.rfind("\n", 0, at) + 1 :].lstrip().startswith("|")

        def link(m: re.Match) -> str:
            path = None if m[1] else paths.get(page_id(m[3]) or "")
            return wiki(path, re.sub(r"[*_~]{1,2}(\S.*?\S|\S)[*_~]{1,2}", r"\1", m[2]), in_table(m.start(), rest)) if path else m[0]

        def mention(m: re.Match) -> str:
            path = paths.get(page_id(attribute(m[2], "url")) or "")
            return wiki(path, re.sub(r"<[^>]*>", "", m[3]), in_table(m.start(), rest)) if path else m[0]

        return _MENTION.sub(mention, _LINK.sub(link, rest))

    return outside_code(text, use)


def assets(text: str) -> list[tuple[str, str, str, int]]:
    """Kind, URL, caption and occurrence of each image (an image) and link (a file)."""
    found, counts = [], {"image": 0, "file": 0}

    def use(rest: str) -> str:
        for m in _LINK.finditer(rest):
            kind = "image" if m[1] else "file"
            found.append((kind, m[3], m[2], counts[kind]))
            counts[kind] += 1
        return rest

    outside_code(text, use)
    return found


def around_tokens(text: str, pattern: str) -> list[str]:
    """What stands before, between and after the tokens that aren't in code."""
    out = [""]
    for code, piece in parts(text):
        first, *rest = [piece] if code else re.split(pattern, piece)
        out[-1] += first
        out += rest
    return out


def front_matter(fields: list[tuple[str, object]]) -> str:
    """Keys in the given order as YAML between dashes; absent values are left out."""
    import yaml

    return "---\n" + "".join(yaml.safe_dump({k: v}, allow_unicode=True, width=1 << 30, default_flow_style=False) for k, v in fields if v is not None) + "---\n"
