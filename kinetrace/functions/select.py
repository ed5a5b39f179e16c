"""Selection language: `all`, `id N ...`, `type T ...`, `name X ...`, joined by and, or, not and parentheses. Anything else is taken as a SQL predicate."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_FIELDS = {"id": "particle_id", "type": "type", "name": "name", "index": "particle_id"}
_RESERVED = {"and", "or", "not", "(", ")", "all", "none", *_FIELDS}


def selection(text: str | Column | None) -> Column:
    """The predicate a selection stands for. `id` counts from 1, `index` from 0."""
    if text is None:
        return F.lit(True)
    if isinstance(text, Column):
        return text
    tokens = re.findall(r"\(|\)|[^\s()]+", text)
    if not tokens or tokens[0] not in _RESERVED or re.search(r"[=<>]", text):
        return F.expr(text)
    found, rest = _either(tokens)
    if rest:
        raise ValueError(f"selection {text!r} can't be read from {rest[0]!r} on")
    return found


def _either(t: list[str]) -> tuple[Column, list[str]]:
    left, t = _both(t)
    while t and t[0] == "or":
        right, t = _both(t[1:])
        left = left | right
    return left, t


def _both(t: list[str]) -> tuple[Column, list[str]]:
    left, t = _one(t)
    while t and t[0] == "and":
        right, t = _one(t[1:])
        left = left & right
    return left, t


def _one(t: list[str]) -> tuple[Column, list[str]]:
    if not t:
        raise ValueError("selection ends too early")
    head, t = t[0], t[1:]
    if head == "not":
        found, t = _one(t)
        return ~found, t
    if head == "(":
        found, t = _either(t)
        if not t or t[0] != ")":
            raise ValueError("selection lacks a closing parenthesis")
        return found, t[1:]
    if head in ("all", "none"):
        return F.lit(head == "all"), t
    if head not in _FIELDS:
        raise ValueError(f"selection has an unknown word {head!r}")
    values = []
    while t and t[0] not in _RESERVED:
        values.append(t[0])
        t = t[1:]
    if not values:
        raise ValueError(f"selection lacks a value after {head!r}")
    if head in ("id", "index"):
        return F.col("particle_id").isin([int(v) - (head == "id") for v in values]), t
    return F.col(_FIELDS[head]).isin(values), t
