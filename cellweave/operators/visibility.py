"""Visibility labels: authorizations, evaluation, stamping.

A batch has few distinct labels, so each distinct one is evaluated once. Only labels pass through Python, and no cell
is moved to another task.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r'\s*(?:("(?:[^"\\]|\\.)*")|([A-Za-z0-9_:./-]+)|([&|()]))')


def parse(label: str) -> tuple | None:
    """A label as ("term", word), ("and", parts) or ("or", parts); None for the empty one. ``&`` binds tighter than ``|``; a malformed label is an error."""
    tokens, at = [], 0
    while at < len(label.rstrip()):
        m = _TOKEN.match(label, at)
        if not m:
            raise ValueError(f"malformed label: {label!r}")
        tokens.append(m[3] or ("term", re.sub(r"\\(.)", r"\1", m[1][1:-1]) if m[1] else m[2]))
        at = m.end()

    def split(part: list, mark: str) -> list[list]:
        """Parts between marks outside parentheses."""
        out, deep = [[]], 0
        for t in part:
            deep += (t == "(") - (t == ")")
            if deep < 0:
                raise ValueError(f"unbalanced label: {label!r}")
            if t == mark and deep == 0:
                out.append([])
            else:
                out[-1].append(t)
        return out

    def tree(part: list) -> tuple:
        for mark, kind in (("|", "or"), ("&", "and")):
            if len(found := split(part, mark)) > 1:
                return kind, [tree(x) for x in found]
        if len(part) == 1 and isinstance(part[0], tuple):
            return part[0]
        if len(part) > 2 and part[0] == "(" and part[-1] == ")":
            return tree(part[1:-1])
        raise ValueError(f"malformed label: {label!r}")

    return tree(tokens) if tokens else None


def allows(label: str, auths: frozenset[str]) -> bool:
    """Whether the authorizations satisfy a label; the empty one always, a malformed one never."""

    def met(node: tuple) -> bool:
        kind, parts = node
        return parts in auths if kind == "term" else (all if kind == "and" else any)(map(met, parts))

    try:
        node = parse(label)
    except ValueError:
        return False
    return node is None or met(node)


def normalized(node: tuple | None) -> tuple | None:
    """Parts of the same kind rolled up, each once; terms first, then alternatives, then conjunctions, each in the order of their text."""
    if node is None or node[0] == "term":
        return node
    parts = []
    for p in map(normalized, node[1]):
        parts += p[1] if p[0] == node[0] else [p]
    unique = {_text(p): p for p in parts}
    parts = sorted(unique.values(), key=lambda p: (("term", "or", "and").index(p[0]), _text(p)))
    return parts[0] if len(parts) == 1 else (node[0], parts)


def _text(node: tuple) -> str:
    if node[0] == "term":
        return node[1] if re.fullmatch(r"[A-Za-z0-9_:./-]+", node[1]) else '"' + re.sub(r'(["\\])', r"\\\1", node[1]) + '"'
    return ("&" if node[0] == "and" else "|").join(_text(p) if p[0] == "term" else f"({_text(p)})" for p in node[1])


def flatten(label: str) -> str:
    """A label in its normal form: equal ones for labels that differ in order, repeats and needless parentheses only."""
    node = normalized(parse(label))
    return "" if node is None else _text(node)


def authorizations(*labels: str) -> frozenset[str]:
    """A set of labels, each of which has to be a word that a label can name without quotes."""
    for x in labels:
        if not re.fullmatch(r"[A-Za-z0-9_:./-]+", x):
            raise ValueError(f"not an authorization: {x!r}")
    return frozenset(labels)


def visible(cells: DataFrame, auths: list[str] | None) -> DataFrame:
    """Cells that the authorizations may see: None sees all, an empty list unlabelled cells only."""
    if auths is None:
        return cells
    held = frozenset(auths)

    @F.pandas_udf("boolean")
    def allowed(labels: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(labels)
        return pd.Series(np.array([allows(bytes(x).decode("utf-8", "replace"), held) for x in distinct] + [False])[codes])

    return cells.filter((F.octet_length("cv") == 0) | allowed("cv"))


def stamp(cells: DataFrame, label: str, mode: str = "and") -> DataFrame:
    """Add a label to every cell (``and``), or to unlabelled ones (``whenEmpty``)."""
    if not re.fullmatch(r"[A-Za-z0-9_:./-]+", label):
        raise ValueError(f"not a label: {label!r}")
    if mode not in ("and", "whenEmpty"):
        raise ValueError(f"unknown mode: {mode!r}")
    old, new = F.col("cv").cast("string"), F.lit(label)
    both = old if mode == "whenEmpty" else F.when(old == new, old).otherwise(F.concat(F.lit("("), old, F.lit(")&("), new, F.lit(")")))
    return cells.withColumn("cv", F.when(F.octet_length("cv") == 0, new).otherwise(both).cast("binary"))


def compound(a: Column, c: Column) -> Column:
    """The label of something derived from two cells; alternatives get parentheses."""
    closed = lambda x: F.when(x.contains("|"), F.concat(F.lit("("), x, F.lit(")"))).otherwise(x)
    return F.when(a == "", c).when((c == "") | (a == c), a).otherwise(F.concat(closed(F.least(a, c)), F.lit("&"), closed(F.greatest(a, c))))
