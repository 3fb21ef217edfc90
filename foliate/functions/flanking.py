"""Runs of emphasis marks, as CommonMark pairs them, and zero-width spaces where its rules for punctuation part what belongs together."""

from __future__ import annotations

import re
import unicodedata

from foliate.functions.blocks import Content, inlines, leaves, parse

ZERO_WIDTH = "\u200b"
#: Characters that may stand for an author's own zero-width space meanwhile: the first that the text doesn't hold.
_STAND_INS = [chr(0xE000 + k) for k in range(16)]


def _class(ch: str) -> str:
    """``s``: white space or an end of the text, ``p``: punctuation or a symbol, else ``o``."""
    if not ch or ch in "\t\n\f\r" or unicodedata.category(ch) == "Zs":
        return "s"
    return "p" if unicodedata.category(ch)[0] in "PS" else "o"


class Run:
    __slots__ = ("at", "mark", "length", "left", "opens", "closes")

    def __init__(self, text: str, at: int, end: int) -> None:
        self.at, self.mark, self.length, self.left = at, text[at], end - at, end - at
        before, after = _class(text[at - 1 : at]), _class(text[end : end + 1])
        left = after != "s" and (after == "o" or before != "o")
        right = before != "s" and (before == "o" or after != "o")
        under = self.mark == "_"
        self.opens = left and (not under or not right or before == "p")
        self.closes = right and (not under or not left or after == "p")


def runs(text: str) -> list[Run]:
    """Runs of ``*`` and ``_`` outside code, tags and destinations."""
    hidden = []
    for s in inlines(text):
        if s.kind in ("code", "comment", "tag", "autolink"):
            hidden.append((s.start, s.end))
        elif s.dest:
            hidden.append((s.label[1], s.end))
    found, k = [], 0
    hidden.sort()
    for m in re.finditer(r"\\.|\*+|_+", text, re.S):
        while k < len(hidden) and hidden[k][1] <= m.start():
            k += 1
        if m[0][0] != "\\" and not (k < len(hidden) and hidden[k][0] <= m.start()):
            found.append(Run(text, m.start(), m.end()))
    return found


def pairs(text: str) -> list[tuple[int, int, int]]:
    """``start of the opening marks, start of the closing marks, how many (1 or 2)`` of emphasis, as CommonMark's stack of delimiters finds it."""
    openers: list[Run] = []
    bottoms: dict[tuple, int] = {}
    out = []
    for run in runs(text):
        while run.closes and run.left:
            key = run.mark, run.opens, run.length % 3
            k = len(openers) - 1
            while k >= bottoms.get(key, 0):
                o = openers[k]
                if o.mark == run.mark and o.left and not ((o.closes or run.opens) and (o.length + run.length) % 3 == 0 and (o.length % 3 or run.length % 3)):
                    break
                k -= 1
            if k < bottoms.get(key, 0):
                bottoms[key] = len(openers)
                break
            o = openers[k]
            n = 2 if o.left >= 2 and run.left >= 2 else 1
            o.left -= n
            out.append((o.at + o.left, run.at + run.length - run.left, n))
            run.left -= n
            del openers[k + (o.left > 0) :]
            bottoms = {b: min(v, len(openers)) for b, v in bottoms.items()}
        if run.opens and run.left:
            openers.append(run)
    return sorted(out)


def _spaced(text: str) -> list[int]:
    """Where zero-width spaces let ``**`` open before, or close after, punctuation within a word; only where that makes a pair."""
    wanted = []
    for run in runs(text):
        if run.mark == "*" and run.length >= 2:
            end = run.at + run.length
            before, after = _class(text[run.at - 1 : run.at]), _class(text[end : end + 1])
            if before == "o" and after == "p":
                wanted.append(end)
            elif before == "p" and after == "o":
                wanted.append(run.at)
    if not wanted:
        return []
    held = {p for a, b, n in pairs(text) if n == 2 for p in (a, a + 2, b)}
    new = _put(text, wanted)
    moved = lambda p: p - sum(w + k < p for k, w in enumerate(wanted))
    made = {q for a, b, n in pairs(new) if n == 2 for q in (moved(a), moved(a) + 2, moved(b))}
    return [w for w in wanted if w in made and w not in held]


def _put(text: str, at: list[int]) -> str:
    out, last = [], 0
    for p in at:
        out += [text[last:p], ZERO_WIDTH]
        last = p
    return "".join([*out, text[last:]])


def bold(text: str) -> tuple[str, str]:
    """The text with zero-width spaces where bold marks need them, and the stand-in for the author's own ('' without any).

    A text that holds zero-width spaces and all stand-ins stays as it is, since its own ones couldn't be told from new ones.
    """
    if "**" not in text:
        return text, ""
    own = ""
    if ZERO_WIDTH in text:
        own = next((x for x in _STAND_INS if x not in text), "")
        if not own:
            return text, ""
        text = text.replace(ZERO_WIDTH, own)
    at = []
    for block in leaves(parse(text)):
        if block.kind in ("paragraph", "heading", "table"):
            for lines in ([[x] for x in block.lines] if block.kind == "table" else [block.lines]):
                content = Content(text, lines)
                if "**" in content.text:
                    at += [content.source(p) if p < len(content.text) else content.source(p - 1) + 1 for p in _spaced(content.text)]
    return _put(text, sorted(at)), own


def plain(text: str, own: str) -> str:
    """``bold`` undone: new zero-width spaces go, the author's own come back."""
    return text.replace(ZERO_WIDTH, "").replace(own, ZERO_WIDTH) if own else text.replace(ZERO_WIDTH, "")
