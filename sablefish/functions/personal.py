"""What counts as personal data in code: by the names of variables and fields, and by the shape of printed numbers."""

from __future__ import annotations

import re

from .scanner import content, scan

# Beginnings of variables' names behind their type letter.
NAMES = (
    "Cpf",
    "Cnpj",
    "Senha",
    "Password",
    "Token",
    "Cartao",
    "Cvv",
    "ApiKey",
    "Api_Key",
    "Secret",
)
# Names behind the type letter c, as a whole or before another capital.
SHORT_NAMES = (
    "Pwd",
    "Rg",
    "Pin",
    "Card",
    "Pass",
)
# Fields of customers, suppliers, employees and dependants.
FIELDS = (
    "A1_CGC",
    "A1_CPF",
    "A1_NOME",
    "A1_NREDUZ",
    "A1_EMAIL",
    "A1_TEL",
    "A1_END",
    "A1_DDD",
    "A2_CGC",
    "A2_CPFRG",
    "A2_NOME",
    "A2_NREDUZ",
    "A2_EMAIL",
    "A2_TEL",
    "A2_END",
    "A2_DDD",
    "RA_CIC",
    "RA_RG",
    "RA_NOMECMP",
    "RA_EMAIL",
    "RA_NUMCP",
    "RA_TELEFON",
    "RH_CPFDEP",
    "RH_NOMEDEP",
    "RH_RGDEP",
)
#: Numbers of people and of companies: the lengths of their groups of digits, and what stands between them.
NUMBERS = (((3, 3, 3, 2), "..-"), ((2, 3, 3, 4, 2), "../-"))


def personal_variable(name: str) -> bool:
    for begin in (0, 1) if name[:1].islower() else (0,):
        if name[begin:].startswith(NAMES):
            return True
    rest = name[1:]
    short = next((s for s in SHORT_NAMES if rest.startswith(s)), None)
    return name[:1] == "c" and short is not None and (rest == short or rest[len(short)].isupper())


def personal_number(text: str) -> bool:
    """A run of digit groups of a known shape, not part of a longer word."""
    for run in re.split(r"[^\w./-]+", text):
        groups = re.split(r"\D", run.strip("./-"))
        marks = "".join(c for c in run.strip("./-") if not c.isdigit())
        if any(tuple(map(len, groups)) == sizes and marks == between for sizes, between in NUMBERS):
            return True
    return False


def names_a_person(arguments: str) -> bool:
    """Whether a call's arguments hold personal data: in names outside strings, or as a number anywhere."""
    tokens = scan(arguments, inside=True)
    names = [t for t, kind in zip(tokens.text, tokens.kind, strict=True) if kind == "n"]
    if any(n.upper() in FIELDS or personal_variable(n) for n in names):
        return True
    return personal_number(" ".join(content(t) if kind == "s" else t for t, kind in zip(tokens.text, tokens.kind, strict=True) if kind == "s"))
