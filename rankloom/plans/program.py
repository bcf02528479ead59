"""Evaluation programs: text that defines a scheme.

Statements end with a semicolon; # starts a comment that runs to the end of the line.

    TERM set value : type;
    SELECT set;    WEIGHT set;    RESTRICT a, b;
    EVAL fn( name = value, .role = set, ...);
    FORMULA "expression";
    SUMMARIZE [id =] fn( name = value, .role = set, ...);
"""

from __future__ import annotations

import re

from rankloom.plans.expr import Term
from rankloom.plans.query import Call, QueryEval

_TOKEN = re.compile(r"\s*(?:#[^\n]*|(\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*')|([-+]?\d+(?:\.\d+)?)|(\w+)|([;:,=().]))")


def tokens(text: str) -> list[tuple[str, object]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unexpected text at {at}: {text[at:at + 20]!r}")
        at = m.end()
        if m.group(1):
            out.append(("string", re.sub(r"\\(.)", r"\1", m.group(1)[1:-1])))
        elif m.group(2):
            out.append(("number", float(m.group(2)) if "." in m.group(2) else int(m.group(2))))
        elif m.group(3):
            out.append(("name", m.group(3)))
        elif m.group(4):
            out.append((m.group(4), m.group(4)))
    return out


def parse(text: str) -> QueryEval:
    parts, pos = tokens(text), 0
    scheme, weight_set = QueryEval(), None

    def peek() -> str:
        return parts[pos][0] if pos < len(parts) else "end"

    def take(*kinds: str):
        nonlocal pos
        if peek() not in kinds:
            raise ValueError(f"{' or '.join(kinds)} expected, not {parts[pos] if pos < len(parts) else 'the end'}")
        pos += 1
        return parts[pos - 1][1]

    def call(name: str, id: str | None = None) -> Call:
        c = Call(name.lower(), id=id)
        take("(")
        while peek() != ")":
            if peek() == ".":
                take(".")
                role = take("name").lower()
                take("=")
                c.roles[role] = take("name", "string").lower()
            else:
                key = take("name").lower()
                take("=")
                value = take("name", "string", "number")
                if key in c.params:
                    held = c.params[key]
                    c.params[key] = [*(held if isinstance(held, list) else [held]), value]
                else:
                    c.params[key] = value
            if peek() != ")":
                take(",")
        take(")")
        return c

    while pos < len(parts):
        word = take("name").upper()
        if word == "TERM":
            name = take("name").lower()
            value = str(take("name", "string", "number"))
            take(":")
            scheme.terms.append((name, Term(take("name"), value)))
        elif word == "SELECT":
            if scheme.selections:
                raise ValueError("SELECT is given twice")
            scheme.selections.append(take("name").lower())
            while peek() == ",":
                take(",")
                scheme.selections.append(take("name").lower())
        elif word == "WEIGHT":
            if weight_set or scheme.weightings:
                raise ValueError("WEIGHT is given once, before EVAL")
            weight_set = take("name").lower()
        elif word == "RESTRICT":
            scheme.restrictions.append(take("name").lower())
            while peek() == ",":
                take(",")
                scheme.restrictions.append(take("name").lower())
        elif word == "EVAL":
            c = call(take("name"))
            if weight_set and "match" not in c.roles and c.name not in ("metadata", "scalar"):
                c.roles = {"match": weight_set, **c.roles}
            scheme.weightings.append(c)
        elif word == "FORMULA":
            first = take("name", "string")
            scheme.formula = take("string") if peek() == "string" else first
        elif word == "SUMMARIZE":
            name, id = take("name"), None
            if peek() == "=":
                take("=")
                id, name = name, take("name")
            scheme.summarizers.append(call(name, id))
        else:
            raise ValueError(f"unknown statement {word}")
        take(";")
    return scheme
