"""Text helpers for sources of the xBase-like language: blanking, calls and arguments.

Plain functions on one text; ``sablefish.operators.facts`` runs them over Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

# One alternative per thing that isn't code. Comments with a star or two ampersands need to be the
# first on their line, where a comment before them on the line doesn't count as white space.
_NOT_CODE = re.compile(
    r"""(?P<line>//[^\n]*)|(?P<block>/\*.*?(?:\*/|\Z))|(?P<first>(?:(?<=\n)|\A)[ \t\r]*(?:\*|&&)[^\n]*)"""
    r"""|(?P<string>"(?:\\.|[^"\\])*(?:"|\\?\Z)|'(?:\\.|[^'\\])*(?:'|\\?\Z))""",
    re.DOTALL,
)
_VISIBLE = re.compile(r"[^\n]")


def blank(text: str, strings: bool = True) -> str:
    """``text`` with comments (and strings) replaced by spaces; length and newlines stay."""

    def hide(m: re.Match) -> str:
        if m.lastgroup == "string" and not strings:
            return m[0]
        return _VISIBLE.sub(" ", m[0])

    return _NOT_CODE.sub(hide, text)


def call_arguments(text: str, after_open: int) -> tuple[str, int] | None:
    """The text between an open parenthesis and its partner, and the partner's place; quotes are respected."""
    depth, quote = 1, ""
    for at in range(after_open, len(text)):
        c = text[at]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                return text[after_open:at], at
    return None


def split_arguments(text: str, most: int | None = None) -> list[str]:
    """The parts between commas outside brackets and quotes, trimmed; at most ``most`` if given."""
    if not text.strip():
        return []
    parts, start, depth, quote = [], 0, 0, ""
    for at, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == "," and depth <= 0 and (most is None or len(parts) < most - 1):
            parts.append(text[start:at].strip())
            start = at + 1
    parts.append(text[start:].strip())
    return parts


_QUOTED = re.compile(r"""["']([^"']*)["']""")


def literal(argument: str) -> str:
    """The text of a quoted argument, else nothing."""
    m = _QUOTED.fullmatch(argument.strip())
    return m[1] if m else ""


def line_of(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def decode(raw: bytes, detect: Callable[[bytes], str] | None = None) -> tuple[str, str]:
    """The text and encoding of a source: cp1252 for plain ASCII, strict UTF-8, cp1252, else latin-1; or by ``detect``."""
    if not raw or raw.isascii():
        return raw.decode("ascii"), "cp1252"
    if detect is not None:
        encoding = detect(raw)
        return raw.decode(encoding), encoding
    for encoding in ("utf-8", "cp1252"):
        try:
            return raw.decode(encoding), encoding
        except UnicodeDecodeError:
            continue
    return raw.decode("latin-1"), "latin-1"


def loops(strict: str) -> Iterator[tuple[int, int]]:
    """First and last lines of While/EndDo and For/Next loops, paired by a stack."""
    closes = {"enddo": "while", "next": "for"}
    open_at: list[tuple[str, int]] = []
    for m in re.finditer(r"\b(While|For|EndDo|Next)\b", strict, re.IGNORECASE):
        word = m[1].lower()
        if word not in closes:
            open_at.append((word, line_of(strict, m.start())))
            continue
        for k in range(len(open_at) - 1, -1, -1):
            if open_at[k][0] == closes[word]:
                yield open_at[k][1], line_of(strict, m.start())
                del open_at[k:]
                break
