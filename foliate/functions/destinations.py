"""Destinations of links, images, autolinks and quoted attributes: where they stand, and what may be put in their place.

Only a destination whose end the syntax fixes is ever replaced.  A signed URL anywhere else (bare in the text, in code) is
reported as unsafe, since where it ends can't be told from the text around it.
"""

from __future__ import annotations

import hashlib
import re
from urllib.parse import quote, unquote

from foliate.functions.blocks import TAG, Content, inlines, leaves, parse
from foliate.functions.markdown import SIGNATURES

_HTTP = re.compile(r"https?://\S+", re.I)
_ATTRIBUTE = re.compile(r"=(?:\"([^\"\n]*)\"|'([^'\n]*)')")
_HOSTS = re.compile(r"(?:.*\.)?(?:notion\.so|notion-static\.com)|prod-files-secure\.s3(?:\.[a-z0-9-]+)?\.amazonaws\.com")


class Destination:
    """``shape``: raw, bracketed, autolink (with its angle brackets as ``whole``) or attribute."""

    __slots__ = ("start", "end", "url", "context", "shape", "whole")

    def __init__(self, text: str, start: int, end: int, context: str, shape: str, whole: tuple[int, int] | None = None) -> None:
        self.start, self.end, self.url, self.context, self.shape, self.whole = start, end, text[start:end], context, shape, whole


def _in_html(own: str) -> list[tuple[int, int, str, str]]:
    """Quoted attributes of tags, and image or link destinations whose brackets match on their line."""
    found = []
    for tag in TAG.finditer(own):
        if not tag[1]:
            found += [(tag.start(3) + m.start(m.lastindex), tag.start(3) + m.end(m.lastindex), "html-attribute", "attribute") for m in _ATTRIBUTE.finditer(tag[3]) if m.lastindex]
    at = 0
    for line in own.split("\n"):
        depth = 0
        for m in re.finditer(r"\\.|\[|\](?:\((?:<([^<>]*)>|((?:[^\s()\\]|\\.|\([^\s()]*\))*))(?=\)|[ \t][^\n]*\)))?", line):
            if m[0] == "[":
                depth += 1
            elif m[0][0] == "]":
                k = m.lastindex
                if k and depth:
                    found.append((at + m.start(k), at + m.end(k), "html-rescue", "bracketed" if k == 1 else "raw"))
                depth = max(0, depth - 1)
        at += len(line) + 1
    return sorted(found)


def destinations(text: str) -> list[Destination]:
    """By place; those of nested links and images each on their own."""
    found: list[Destination] = []
    for block in leaves(parse(text)):
        if block.kind in ("fence", "indented", "rule"):
            continue
        for lines in ([[line] for line in block.lines] if block.kind == "table" else [block.lines]):
            content = Content(text, lines)
            if block.kind == "html":
                found += [Destination(text, content.source(a), content.source(b - 1) + 1, context, shape) for a, b, context, shape in _in_html(content.text) if b > a]
                continue
            for span in inlines(content.text):
                if span.kind == "autolink":
                    a, b = content.source(span.dest[0]), content.source(span.dest[1] - 1) + 1
                    found.append(Destination(text, a, b, "autolink", "autolink", (a - 1, b + 1)))
                elif span.kind in ("link", "image") and span.dest[1] > span.dest[0]:
                    a = content.source(span.dest[0])
                    found.append(Destination(text, a, a + span.dest[1] - span.dest[0], "markdown-" + span.kind, "bracketed" if span.bracketed else "raw"))
                elif span.kind == "tag" and not span.closes:
                    own = content.text[span.start : span.end]
                    found += [Destination(text, content.source(span.start + a), content.source(span.start + b - 1) + 1, context, shape) for a, b, context, shape in _in_html(own) if b > a]
    return sorted(found, key=lambda d: (d.start, -d.end))


def signature(url: str) -> tuple[bool, str | None]:
    """Whether a URL is of a known store and signed; and the URL without its signature, None where it can't be read."""
    m = re.match(r"(https?)://([^/?#]*)([^?#]*)(\?[^#]*)?", url, re.I)
    if not m or not m[4] or "@" in m[2] or "[" in m[2]:
        return False, None
    host = re.fullmatch(r"(.*?)(?::(\d+))?", m[2])
    name, scheme = host[1].lower(), m[1].lower()
    if host[2] and host[2] != ("443" if scheme == "https" else "80"):
        return False, None
    bare = name.rstrip(".") if name.endswith(".") and not name.endswith("..") else name
    known = _HOSTS.fullmatch(bare) or re.fullmatch(r"s3(?:\.[a-z0-9-]+)?\.amazonaws\.com", bare) and re.match(r"/secure\.notion-static\.com(?:/|$)", m[3], re.I)
    query = re.sub(r"&(?:amp|#0*38|#x0*26);", "&", m[4][1:], flags=re.I)
    if not known or not any(unquote(p.split("=")[0]).lower() in SIGNATURES for p in query.split("&")):
        return False, None
    if re.search(r"%(?![0-9a-f]{2})", url, re.I) or not re.fullmatch(r"[a-z0-9.-]+", name):
        return True, None
    return True, f"{scheme}://{name}{quote(m[3], safe='/%:@!$&\'()*+,;=~-._|[]')}"


def occurrences(text: str) -> list[tuple[int, int, str, str, str, str | None]]:
    """``start, end, context, outcome, sha256 of the URL, replacement`` of signed URLs: replaced, unparseable or boundary-undetermined."""
    if not re.search("https?://", text, re.I):
        return []
    digest = lambda url: hashlib.sha256(url.encode()).hexdigest()
    found, seen, at = [], set(), 0
    for d in destinations(text):
        if d.start < at or not _HTTP.fullmatch(d.url):
            continue
        seen.add(d.start)
        signed, stable = signature(d.url)
        if signed:
            found.append((d.start, d.end, d.context, "replaced" if stable else "unparseable", digest(d.url), stable))
            at = d.end if stable else at
    cut = sorted((f[0], f[1]) for f in found if f[5])
    k = 0
    for m in re.finditer(r"https?://", text, re.I):
        while k < len(cut) and cut[k][1] <= m.start():
            k += 1
        if m.start() in seen or k < len(cut) and cut[k][0] <= m.start():
            continue
        url = _HTTP.match(text, m.start())
        signed, stable = signature(url[0]) if url else (False, None)
        if signed:
            found.append((m.start(), url.end(), "bare-url", "boundary-undetermined" if stable else "unparseable", digest(url[0]), None))
    return sorted(found)


def signed_urls(text: str) -> tuple[str, int, list[str]]:
    """The text with signed URLs cut to origin and path; how many; and those that can't be."""
    found = occurrences(text)
    out, at = [], 0
    for start, end, *_, stable in found:
        if stable:
            out += [text[at:start], stable]
            at = end
    return "".join([*out, text[at:]]), sum(f[5] is not None for f in found), [text[f[0] : f[1]] for f in found if f[5] is None]


def _bracketed(path: str) -> str:
    return "<" + re.sub(r"[<>&]", r"\\\g<0>", path) + ">"


def asset_urls(text: str, local: dict[str, str]) -> str:
    """Destinations of links, images and autolinks that have a local copy; an autolink becomes a link named by its path."""
    if not local:
        return text
    out, at = [], 0
    for d in destinations(text):
        path = local.get(d.url) if d.shape != "attribute" and d.context != "html-rescue" else None
        start, end = d.whole or (d.start - (d.shape == "bracketed"), d.end + (d.shape == "bracketed"))
        if path is None or start < at:
            continue
        path = path.replace("\\", "/")
        to = _bracketed(path) if d.shape == "bracketed" or re.search(r"[\x00- ]", path) else re.sub(r"[()&]", r"\\\g<0>", path)
        out += [text[at:start], f"[{re.sub(r'[\\\[\]&`_~]', r'\\\g<0>', path)}]({to})" if d.shape == "autolink" else to]
        at = end
    return "".join([*out, text[at:]])
