"""The tables that an SQL statement names: a lexer and a walk with scopes.

A table's name stands behind FROM, JOIN, INTO, UPDATE or USING, behind the commas of a FROM list, and behind TABLE where a statement drops, alters or empties one. Common table names of a
WITH clause, aliases and functions in a FROM list aren't tables; names in comments and strings aren't either. Names may be quoted (``"x"``, ``[x]``, backticks) and have a schema, of which the last part counts.
Macros (``%table:X%``) stand for a table by another name and are kept apart.
"""

from __future__ import annotations

import re

_LEXEME = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>'(?:''|[^'])*(?:'|\Z))|(?P<quoted>"[^"]*"|\[\w[^\]]*\]|`[^`]*`)|(?P<macro>%[^%\n]*%)|(?P<word>\w+)|(?P<mark>.)""",
    re.DOTALL,
)
#: A name that follows one of these is a table's.
_LEADS = {"FROM", "JOIN", "INTO", "UPDATE", "USING"}
#: What ends a FROM list.
_ENDS = {"WHERE", "GROUP", "ORDER", "HAVING", "ON", "SET", "UNION", "EXCEPT", "INTERSECT", "LIMIT", "VALUES", "SELECT", "WHEN", "RETURNING", "WINDOW", "QUALIFY"}
#: Words that may stand between a lead and the name.
_FILLERS = {"ONLY", "LATERAL", "TOP"}


def _lexemes(sql: str) -> list[tuple[str, str]]:
    out = []
    for m in _LEXEME.finditer(sql):
        if m.lastgroup != "space":
            out.append((m.lastgroup, m[0]))
    return out


def _common(parts: list[tuple[str, str]]) -> set[str]:
    """The names that WITH clauses define: a name, maybe columns in brackets, AS and a bracket."""
    names = set()
    for k, (kind, text) in enumerate(parts):
        if kind == "word" and text.upper() == "AS" and k + 1 < len(parts) and parts[k + 1][1] == "(" or (kind == "word" and text.upper() == "MATERIALIZED" and k + 1 < len(parts) and parts[k + 1][1] == "("):
            at = k - 1
            while at >= 0 and parts[at][1].upper() in ("AS", "NOT", "MATERIALIZED"):
                at -= 1
            if at >= 0 and parts[at][1] == ")":
                depth = 1
                while at > 0 and depth:
                    at -= 1
                    depth += {")": 1, "(": -1}.get(parts[at][1], 0)
                at -= 1
            before = parts[at - 1][1].upper() if at > 0 else ""
            if at >= 0 and parts[at][0] in ("word", "quoted") and before in ("WITH", "RECURSIVE", ","):
                names.add(_bare(parts[at]))
    return names


def _bare(part: tuple[str, str]) -> str:
    kind, text = part
    return (text[1:-1] if kind == "quoted" else text).upper()


def tables(sql: str) -> list[str]:
    """The names of a statement's tables in upper case, sorted; those of macros begin with ``%``."""
    parts, found = _lexemes(sql), set()
    known = _common(parts)
    # for each open bracket: whether a FROM list is being read here, and whether a name is expected next
    scopes: list[list[bool]] = [[False, False]]
    k = 0
    while k < len(parts):
        kind, text = parts[k]
        scope, upper = scopes[-1], text.upper() if kind == "word" else ""
        if text == "(":
            scope[1] = False
            scopes.append([False, False])
        elif text == ")":
            if len(scopes) > 1:
                scopes.pop()
        elif upper == "FROM" and len(scopes) > 1 and k and _of_a_function(parts, k):
            pass  # extract(day FROM x), trim(both ' ' FROM x)
        elif upper in _LEADS:
            scope[0], scope[1] = upper in ("FROM", "USING"), True
        elif upper == "TABLE" and k and parts[k - 1][1].upper() in ("DROP", "ALTER", "TRUNCATE", "CREATE"):
            scope[1] = True
        elif upper in _ENDS:
            scope[0] = scope[1] = False
        elif text == "," and scope[0]:
            scope[1] = True
        elif scope[1] and upper not in _FILLERS:
            if kind == "macro" and text.lower().startswith("%table:"):
                found.add("%" + text[7:-1].strip().upper())
                scope[1] = False
            elif kind in ("word", "quoted") and not (kind == "word" and text.isdigit()):
                while k + 2 < len(parts) and parts[k + 1][1] == "." and parts[k + 2][0] in ("word", "quoted"):
                    k += 2
                call = scope[0] and k + 1 < len(parts) and parts[k + 1][1] == "("
                if not call and _bare(parts[k]) not in known:
                    found.add(_bare(parts[k]))
                scope[1] = False
            else:
                scope[1] = False
        k += 1
    return sorted(found)


def _of_a_function(parts: list[tuple[str, str]], at: int) -> bool:
    """Whether FROM here belongs to a function such as EXTRACT or TRIM: its bracket is opened behind that name and holds no SELECT."""
    depth = 0
    for k in range(at - 1, -1, -1):
        text = parts[k][1]
        if text == ")":
            depth += 1
        elif text == "(":
            if not depth:
                return k > 0 and parts[k - 1][1].upper() in ("EXTRACT", "TRIM", "SUBSTRING", "OVERLAY", "POSITION")
            depth -= 1
        elif not depth and text.upper() in ("SELECT", "DELETE"):
            return False
    return False

