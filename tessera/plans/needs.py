"""Literals without which a rule can't match, and whether texts hold them: one pass of an automaton instead of one for each rule."""

from __future__ import annotations

import re
import warnings
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType

#: Letters beyond ASCII that Java takes for ASCII ones where case is ignored; RE2, which Arrow uses, knows two of the four.
_ALSO = {"i": "[i\u0130\u0131]", "s": "[s\u017f]", "k": "[k\u212a]"}
#: Alternatives up to which two literals side by side are multiplied out into one.
_MOST = 8


def needs(condition: str) -> tuple | None:
    """What every text with a match holds, in small letters: ("has", literal), ("all", ...) or ("any", ...); null: nothing is known.

    Only printable ASCII counts. Conditions that Java reads in another way than Python (set operations, octal escapes, flags
    other than i) are not looked into.
    """
    from re import _parser

    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")  # nested sets and set operations
            parsed = _parser.parse(condition)
    except (re.error, Warning):
        return None
    if parsed.state.flags & ~int(re.I | re.U) or re.search(r"\\[0-9]", condition):
        return None
    texts, need = _sequence(parsed)
    return need if texts is None else _literal(texts)


def _join(kind: str, parts: list) -> tuple | None:
    """All or any of some parts, those with fewest literals first; an unknown part makes any unknown."""
    if kind == "any" and None in parts:
        return None
    flat = [y for x in parts if x for y in (x[1] if x[0] == kind else [x])]
    if kind == "any":  # a literal that holds another one adds nothing
        texts = {x[1] for x in flat if x[0] == "has"}
        flat = [x for x in flat if x[0] != "has" or not any(t != x[1] and t in x[1] for t in texts)]
    flat = sorted(dict.fromkeys(flat), key=_count)
    return (flat[0] if len(flat) == 1 else (kind, tuple(flat))) if flat else None


def _count(node: tuple) -> int:
    return 1 if node[0] == "has" else sum(map(_count, node[1]))


def _literal(texts: set) -> tuple | None:
    return None if "" in texts else _join("any", [("has", x) for x in sorted(texts)])


def _sequence(items) -> tuple[set | None, tuple | None]:
    """(all texts that a sequence can be, where they are known; else what it needs)."""
    run, known, whole = {""}, [], True
    for op, of in items:
        if str(op) in ("AT", "ASSERT", "ASSERT_NOT"):  # of no width
            continue
        texts, need = _item(str(op), of)
        if texts is None or (len(texts) > 1 and len(run) > 1 and len(texts) * len(run) > _MOST):
            whole = False
            known += [_literal(run), need]
            run = {""} if texts is None else texts
        else:
            run = {a + b for a in run for b in texts}
    return (run, None) if whole else (None, _join("all", [*known, _literal(run)]))


def _item(op: str, of) -> tuple[set | None, tuple | None]:
    if op == "LITERAL":
        return ({chr(of).lower()} if 32 <= of < 127 else None), None
    if op == "IN":
        return ({chr(y).lower() for _, y in of} if all(str(x) == "LITERAL" and 32 <= y < 127 for x, y in of) else None), None
    if op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        least, most, inner = of
        texts, need = _sequence(inner)
        if texts is not None and most == 1:
            return (texts if least else texts | {""}), None
        return None, ((need if texts is None else _literal(texts)) if least else None)
    if op == "SUBPATTERN" and not (of[1] | of[2]) & ~int(re.I):
        return _sequence(of[3])
    if op == "ATOMIC_GROUP":
        return _sequence(of)
    if op == "BRANCH":
        ways = [_sequence(x) for x in of[1]]
        if all(texts is not None for texts, _ in ways):
            return set().union(*(texts for texts, _ in ways)), None
        return None, _join("any", [need if texts is None else _literal(texts) for texts, need in ways])
    return None, None


def _lead(node: tuple) -> set:
    """Literals of which every text that holds a node has one: the rarest part of all, taken for the one whose shortest literal is longest."""
    kind, of = node
    if kind == "has":
        return {of}
    parts = [_lead(x) for x in of]
    return set().union(*parts) if kind == "any" else max(parts, key=lambda x: (min(map(len, x)), -len(x)))


@lru_cache(4096)
def _pattern(literals: frozenset) -> str:
    return "|".join("".join(_ALSO.get(c, re.escape(c)) for c in x) for x in sorted(literals))


def _match(texts: pa.Array, literals) -> np.ndarray:
    found = pc.match_substring_regex(texts, _pattern(frozenset(literals)), ignore_case=True)
    return pc.fill_null(found, False).to_numpy(zero_copy_only=False).astype(bool)


def held(texts: pa.Array, node: tuple | None) -> np.ndarray:
    """For each text whether it holds a node; parts are tried only on texts that they can still decide."""
    if node is None:
        return np.ones(len(texts), dtype=bool)
    kind, of = node
    if kind == "has":
        return _match(texts, [of])
    every = kind == "all"
    plain = [] if every else [x for k, x in of if k == "has"]
    out = _match(texts, plain) if plain else np.full(len(texts), every)
    for part in of if every else [x for x in of if x[0] != "has"]:
        left = out if every else ~out
        if left.any():
            at = left.nonzero()[0]
            out[at] = held(texts.filter(pa.array(left)), part)
    return out


def holds(text: Column, conditions: list[str]) -> Column:
    """For each condition whether a text holds its literals: array<boolean>, false for null."""
    nodes = [needs(x) for x in conditions]
    first = set().union(*(_lead(x) for x in nodes if x))
    if not first:
        return F.array_repeat(F.lit(True), len(nodes))

    def run(texts: pa.Array) -> pa.Array:
        some = _match(texts, first)
        left = texts.filter(pa.array(some))
        out = np.zeros((len(texts), len(nodes)), dtype=bool)
        for k, node in enumerate(nodes):
            out[some if node else slice(None), k] = held(left, node) if node else True
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(nodes)), pa.array(out.ravel()))

    return F.arrow_udf(run, ArrayType(BooleanType()))(text)
