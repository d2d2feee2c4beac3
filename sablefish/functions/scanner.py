"""A token scanner for sources of the xBase-like language, and rules over tokens.

A source becomes a run of tokens (names, numbers, strings, marks); comments and white space fall away. A rule is a sequence of steps that tokens have to meet one after the other:

    Word|Other     a name, one of these in any case          <A|B>     the same, kept
    ( , -> :=      a mark                                    ^         the next token is the first of its line, and all stand on this line
    $shape         a name of a shape, kept                   'shape'   a string of a shape, kept
    &shape         a name of a shape
    #              a number, kept                            %         a name or a string
    () {}          brackets and all inside, kept as text     ~arg      an argument: tokens up to a comma or bracket
    ~X             all up to the token X, which is met       *rest     the rest of the line, kept
    +X             all up to the name X, kept as text        [ ... ]   steps that may be missing (what they keep is empty then)
    !member        what follows isn't behind ``:`` or ``.``  \\[        the mark [

Of several rules of one kind (as far as a slash in it) the first that matches at a token counts. Rules read strings' insides too where they say ``text``, as names and calls are often given as text to be run.
"""

from __future__ import annotations

import re
from collections.abc import Callable

#: What a rule keeps of a name or of a string's content, or None where it isn't of the shape.
Shape = Callable[[str], str | None]
_NAME_START = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_")


class Tokens:
    """Parallel lists of a text's tokens: kind (n name, d number, s string, m mark), text, its upper case, start, stop, line number, and whether it is the first of its line."""

    def __init__(self) -> None:
        self.kind: list[str] = []
        self.text: list[str] = []
        self.upper: list[str] = []
        self.start: list[int] = []
        self.stop: list[int] = []
        self.line: list[int] = []
        self.first: list[bool] = []


_COMMENTS = r"""(?P<f>(?:(?<=\n)|\A)[ \t\r\f\v]*(?:\*|&&)[^\n]*)|(?P<c>//[^\n]*|/\*.*?(?:\*/|\Z))|"""
_TOKENS = r"""(?P<n>[^\W\d]\w*)|(?P<b>[ \t\r\f\v]+)|(?P<l>\n)|(?P<d>\d\w*)|(?P<s>"(?:\\.|[^"\\])*(?:"|\\?\Z)|'(?:\\.|[^'\\])*(?:'|\\?\Z))|(?P<m>:=|->|::|\+=|-=|==|!=|<>|>=|<=|\.[A-Za-z]+\.|.)"""
#: Tokens and what falls away; a star or two ampersands begin a comment where they are the first of a line.
_OUTSIDE, _INSIDE = (re.compile(p + _TOKENS, re.DOTALL) for p in (_COMMENTS, ""))


def scan(text: str, shift: int = 0, line: int = 1, inside: bool = False) -> Tokens:
    """The tokens of a text; ``inside`` a string, nothing is the first of a line and there are no comments."""
    out, fresh = Tokens(), not inside
    add_kind, add_text, add_upper, add_start, add_stop, add_line, add_first = (x.append for x in (out.kind, out.text, out.upper, out.start, out.stop, out.line, out.first))
    for m in (_INSIDE if inside else _OUTSIDE).finditer(text):
        kind = m.lastgroup
        if kind == "b":
            continue
        if kind == "l":
            line, fresh = line + 1, not inside
            continue
        piece = m[0]
        if kind == "c" or kind == "f":
            line, fresh = line + piece.count("\n"), False
            continue
        if kind == "n" and piece[0].isdigit():
            kind = "d"  # such as a superscript
        at = m.start() + shift
        add_kind(kind)
        add_text(piece)
        add_upper(piece.upper() if kind != "s" else "")
        add_start(at)
        add_stop(at + len(piece))
        add_line(line)
        add_first(fresh)
        if kind == "s":
            line += piece.count("\n")
        fresh = False
    return out


def content(string: str) -> str:
    """What stands between a string's quotes."""
    return string[1:-1] if len(string) > 1 and string[-1] == string[0] else string[1:]


class Found:
    """A match in the making: the tokens, the text that is kept, and what has been kept so far."""

    __slots__ = ("kept", "text", "tokens")

    def __init__(self, tokens: Tokens, text: str):
        self.tokens, self.text, self.kept = tokens, text, []


class Rule:
    """Steps over tokens, from a line of words."""

    def __init__(self, kind: str, inside: bool, steps: str, shapes: dict[str, Shape], arguments: bool = False):
        self.kind, self.inside, self.arguments, self.shapes = kind, inside, arguments, shapes
        self.family = kind.partition("/")[0]
        parts = steps.split()
        self.head = parts[0] == "^"
        self.loose = parts[0] == "!member"
        self.steps = self._nested(parts[1:] if self.head or self.loose else parts)
        self.leads = self._leads()

    def _leads(self) -> tuple[Shape | None, frozenset[str] | None]:
        """For a rule that begins with a name's shape: the shape, and what the token behind the name has to be; None for either where it isn't fixed."""
        first = self.steps[0]
        if isinstance(first, list) or first[0] not in "$&":
            return None, None
        if first == "$member":
            return None, frozenset((":",))
        shape = self.shapes.get(first[1:])
        after = self.steps[1] if len(self.steps) > 1 else None
        if after is None or isinstance(after, list) or after in ("()", "{}") or after[0] in "$&'#%~*+<" and after not in ("+=", "<"):
            return shape, None
        return shape, frozenset(after.removeprefix("\\").upper().split("|"))

    @staticmethod
    def _nested(parts: list[str]) -> list:
        out: list = [[]]
        for p in parts:
            if p == "[":
                out.append([])
            elif p == "]":
                inner = out.pop()
                out[-1].append(inner)
            else:
                out[-1].append(p)
        return out[0]

    def starts(self) -> set[str] | None:
        """Upper-case texts of the tokens that a match may begin with; None where a shape decides."""
        out: set[str] = set()
        for step in self.steps:
            if isinstance(step, list):
                out |= {w.upper() for w in step[0].strip("<>").split("|")}
                continue
            if step == "$self":
                return {"::"}
            if step[0] in "$&'%":
                return None
            return out | ({w.upper() for w in step.strip("<>").split("|")} if step[0] in _NAME_START or step[0] == "<" and len(step) > 2 else {step})
        return out

    @staticmethod
    def _keeps(steps: list) -> int:
        return sum(Rule._keeps(s) if isinstance(s, list) else s[0] in "$'#*+" and s not in ("+=",) or s in ("()", "{}") or s[0] == "<" and len(s) > 2 for s in steps)

    def match(self, tokens: Tokens, at: int, text: str) -> tuple[list[str], int] | None:
        """What is kept, and the place behind the last token; None where the rule doesn't match from this token on."""
        if self.head and not tokens.first[at]:
            return None
        if self.loose and tokens.start[at] and text[tokens.start[at] - 1] in ":.":
            return None
        return self._run(self.steps, 0, tokens, at, text, tokens.line[at] if self.head else 0, [])

    def _run(self, steps: list, k: int, tokens: Tokens, at: int, text: str, line: int, kept: list[str]) -> tuple[list[str], int] | None:
        count = len(tokens.kind)
        while k < len(steps):
            step = steps[k]
            if isinstance(step, list):
                with_it = self._run(step + steps[k + 1 :], 0, tokens, at, text, line, list(kept))
                if with_it is not None:
                    return with_it
                kept = kept + [""] * self._keeps(step)
                k += 1
                continue
            if step == "*rest":
                stop = text.find("\n", tokens.stop[at - 1])
                rest = text[tokens.stop[at - 1] : len(text) if stop < 0 else stop].strip(" \t")
                return ([*kept, rest], len(text) if stop < 0 else stop) if rest.strip() else None
            if at >= count or (line and tokens.line[at] != line and step not in ("()",)):
                return None
            kind, upper = tokens.kind[at], tokens.upper[at]
            first = step[0]
            if step in ("()", "{}"):
                if tokens.text[at] != step[0]:
                    return None
                close = next((j for j in range(at + 1, count) if tokens.text[j] == step[1]), None)
                if close is None:
                    return None
                kept = [*kept, text[tokens.stop[at] : tokens.start[close]]]
                at, line = close, line and tokens.line[close]
            elif first == "$":
                value = None
                if step[1:] in ("member", "self"):
                    names = (at, at + 1, at + 2) if step == "$member" else (at, at + 1)
                    if names[-1] >= count or tokens.text[names[-2]] != (":" if step == "$member" else "::") or any(tokens.kind[j] != "n" for j in (names[0], names[-1]) if j != names[-2]):
                        return None
                    if any(tokens.stop[i] != tokens.start[j] for i, j in zip(names, names[1:], strict=False)):
                        return None
                    value, at = "".join(tokens.text[j] for j in names), names[-1]
                elif step == "$dotted" and kind == "n":
                    while at + 2 < count and tokens.text[at + 1] == "." and tokens.kind[at + 2] == "n" and tokens.stop[at + 1] == tokens.start[at + 2]:
                        value, at = (value or tokens.text[at]) + "." + tokens.text[at + 2], at + 2
                    value = value or tokens.text[at]
                elif step == "$same":
                    value = "" if tokens.text[at] == kept[-1] else None
                elif kind == "n" or (kind == "d" and step == "$word"):
                    value = self.shapes[step[1:]](tokens.text[at])
                if value is None:
                    return None
                kept = [*kept, value]
            elif first == "&":
                if kind != "n" or self.shapes[step[1:]](tokens.text[at]) is None:
                    return None
            elif first == "'":
                if kind != "s":
                    return None
                value = self.shapes[step.strip("'")](content(tokens.text[at]))
                if value is None:
                    return None
                kept = [*kept, value]
            elif step == "#":
                if kind != "d" or not upper.isdigit():
                    return None
                kept = [*kept, tokens.text[at]]
            elif step == "%":
                if kind not in "ns":
                    return None
            elif step == "~arg":
                begin = at
                while at < count and tokens.text[at] not in (",", ")", "("):
                    at += 1
                if at == begin:
                    return None
                at -= 1
            elif first == "~" or (first == "+" and len(step) > 2):
                wanted, begin = step[1:].upper(), at
                while at < count and tokens.upper[at] != wanted:
                    at += 1
                if at == count:
                    return None
                if first == "+":
                    kept = [*kept, text[tokens.stop[begin - 1] : tokens.start[at]]]
            elif first == "<" and len(step) > 2:
                if kind != "n" or upper not in step[1:-1].upper().split("|"):
                    return None
                kept = [*kept, tokens.text[at]]
            elif first in _NAME_START:
                if kind != "n" or upper not in step.upper().split("|"):
                    return None
            elif tokens.text[at].upper() != step.removeprefix("\\"):
                return None
            at, k = at + 1, k + 1
        return kept, tokens.stop[at - 1]


class Scanner:
    """All rules over a text."""

    def __init__(self, rules: list[Rule]):
        self.by_start: dict[str, list[Rule]] = {}
        self.shaped: list[Rule] = []
        self.reads_strings = any(r.inside for r in rules)
        #: Rules that begin with any name, by the token behind it.
        self.by_next: dict[str, list[Rule]] = {}
        for rule in rules:
            starts = rule.starts()
            if starts is None:
                self.shaped.append(rule)
            for s in starts or ():
                self.by_start.setdefault(s.removeprefix("\\"), []).append(rule)
        self.anywhere = [r for r in self.shaped if r.leads[1] is None]
        for mark in {m for r in self.shaped for m in r.leads[1] or ()}:
            self.by_next[mark] = [r for r in self.shaped if r.leads[1] is None or mark in r.leads[1]]

    def _at(self, tokens: Tokens, strict: str, kept: str, inside: bool, found: list) -> None:
        by_start, by_next, anywhere, uppers, last = self.by_start, self.by_next, self.anywhere, tokens.upper, len(tokens.upper) - 1
        for at, upper in enumerate(uppers):
            kind = tokens.kind[at]
            if kind == "s":
                continue
            rules = by_start.get(upper, ())
            if kind == "n":
                shaped = by_next.get(uppers[at + 1], anywhere) if at < last else anywhere
                name, first = tokens.text[at], tokens.first[at]
                shaped = [r for r in shaped if (first or not r.head) and (r.inside or not inside) and (r.leads[0] is None or r.leads[0](name) is not None)]
                rules = [*rules, *shaped]
            if not rules:
                continue
            done = set()
            for rule in rules:
                if (inside and not rule.inside) or rule.family in done:
                    continue
                hit = rule.match(tokens, at, kept if rule.inside else strict)
                if hit is not None:
                    done.add(rule.family)
                    found.append((rule, tokens.line[at], tokens.start[at], hit[1], hit[0]))

    def find(self, text: str, strict: str, kept: str) -> list[tuple[Rule, int, int, int, list[str]]]:
        """Rule, line, start, stop and what is kept of each match. Pieces of text come from ``kept``, the text without its comments, or for rules that don't read strings from ``strict``, where these are blank too."""
        tokens, found = scan(text), []
        self._at(tokens, strict, kept, False, found)
        if not self.reads_strings:
            return found
        for at, kind in enumerate(tokens.kind):
            if kind == "s":
                inner = scan(content(tokens.text[at]), tokens.start[at] + 1, tokens.line[at], inside=True)
                self._at(inner, strict, kept, True, found)
        return found

