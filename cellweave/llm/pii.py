"""Operator 4: personal data, DataFrame expressions only.

Patterns propose spans; checksums confirm them (Luhn for cards, mod-97 for account numbers, the range of
address parts, the number of digits of a phone); words shortly before a span raise its score. Base
spans (email, ip, card, phone) stay whatever their score; the method's further kinds, ``iban`` and
``secret``, need a score of ``least``.

The positions of a pattern's matches are prefix sums of the lengths of the matches and of the text between
them; both walks find the same leftmost, non-overlapping matches. The patterns start at the beginning
of a run only (or where the last match ended) and never give characters back, which finds the same
matches as the plain form but takes time in proportion to the text. Prefix sums go in blocks, and parts
of a text are cut from pieces of it, so a text with very many matches does not take time with the square of
their number.

Null texts count as empty; redact() leaves a null null. Rows are handled one by one, so ties and repeated rows
need no rule. Further columns stay; one named like ``into``, the result of find_pii(), is replaced. Empty tables
give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "secret")

#: The patterns by kind.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9]){13,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+(?![A-Za-z0-9])",
    "secret": r"(?:token|password|passwd|secret|api_key|apikey)[\"']?[ ]?[=:][ ]?[\"']?[A-Za-z0-9_/+-]{12,}+",
}
#: The score by kind, and words that raise it when they stand shortly before.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "secret": 0.7}
CONTEXT = {
    "email": "mail|contact|write|reach", "ip": r"\bip\b|host|server|address|login", "card": "card|visa|credit|debit|pay|expir",
    "phone": "phone|call|tel|mobile|fax|whatsapp", "iban": "iban|account|bank|transfer", "secret": "auth|login|config|env|bearer",
}
RAISE, REACH = 0.1, 40
PIECE = 256


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's sum."""
    figures = F.split(F.reverse(digits), "")
    doubled = F.transform(F.filter(figures, lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number without blanks leaves 1 modulo 97."""
    turned = F.concat(F.substring(account, 5, 40), F.substring(account, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        value = F.ascii(c)
        return F.when(value < 58, (rest * 10 + value - 48) % 97).otherwise((rest * 100 + value - 55) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def _confirmed(kind: str, match: Column) -> Column:
    n = F.length(_digits(match))
    if kind == "ip":
        return ~F.exists(F.split(match, r"\."), lambda p: ~p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})$"))
    if kind == "card":
        return F.when(n.between(14, 19), luhn(_digits(match))).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    if kind == "iban":
        return mod97(F.regexp_replace(match, " ", ""))
    return F.lit(True)


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, combine, block: int = 128) -> Column:
    """For each of an array of integers what those before it come to (0 for the first), by an associative ``combine``; in blocks, as appending copies."""
    none = F.array().cast("array<int>")
    parts = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(values) - 1, F.lit(0)) / block).cast("int")), lambda c: F.slice(values, c * block + 1, block))
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    grown = lambda a, x: F.struct(combine(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
    ahead = lambda bs: F.aggregate(bs, start, lambda a, x: grown(a, x["at"]), lambda a: a["out"])
    return _bound(F.transform(parts, lambda x: F.aggregate(x, start, grown)), lambda bs: F.flatten(F.zip_with(bs, ahead(bs), lambda x, o: F.transform(x["out"], lambda v: combine(o, v)))))


def pieces(text: Column) -> Column:
    """A text in pieces of PIECE code points."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut(parts: Column, start: Column, end: Column) -> Column:
    """Code points [start, end) of a text in pieces."""
    first = F.floor(start / PIECE).cast("int")
    some = F.array_join(F.slice(parts, first + 1, F.floor((end - 1) / PIECE).cast("int") - first + 1), "")
    return F.when(end > start, F.substring(some, start - first * PIECE + 1, end - start)).otherwise("")


def _spans(text: Column, parts: Column, kind: str) -> Column:
    """Array of (start, ord, end, kind, score) of a kind's confirmed matches."""
    gaps = F.transform(F.split(text, PATTERNS[kind], -1), lambda gap: F.length(gap))
    pairs = F.zip_with(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), gaps, lambda m, gap: F.struct(m.alias("m"), gap.alias("gap"), F.length(m).alias("n")))
    ahead = lambda ps: running(F.transform(ps, lambda p: p["gap"] + p["n"]), lambda x, y: x + y)
    placed = lambda p, at: F.struct((at + p["gap"]).alias("start"), (at + p["gap"] + p["n"]).alias("end"), p["m"].alias("m"))
    found = _bound(F.filter(pairs, lambda p: p["m"].isNotNull()), lambda ps: F.zip_with(ps, ahead(ps), placed))

    def scored(p: Column) -> Column:
        near = F.lower(cut(parts, F.greatest(p["start"] - REACH, F.lit(0)), p["start"]))
        score = F.lit(SCORES[kind]) + F.when(near.rlike(CONTEXT[kind]), RAISE).otherwise(0.0)
        return F.struct(p["start"].alias("start"), F.lit(KINDS.index(kind)).alias("ord"), p["end"].alias("end"), F.lit(kind).alias("kind"), F.round(score, 2).alias("score"))

    return F.transform(F.filter(found, lambda p: _confirmed(kind, p["m"])), scored)


#: What a text must hold for a kind to be looked for; digits for the other kinds.
_MAY = {"email": "@", "phone": r"\+", "secret": "[=:]"}
_EMPTY = "array<struct<start:int,ord:int,end:int,kind:string,score:double>>"


def find_pii(docs: DataFrame, column: str = "text", into: str = "pii", least: float = 0.7) -> DataFrame:
    """Adds ``into``: all spans (start, ord, end, kind, score) of the column, by start and kind; code points, end exclusive."""
    text = F.coalesce(F.col(column), F.lit(""))

    def spans(parts: Column, kind: str) -> Column:
        found = F.when(text.rlike(_MAY.get(kind, "[0-9]")), _spans(text, parts, kind)).otherwise(F.array().cast(_EMPTY))
        return found if kind in BASE else F.filter(found, lambda s: s["score"] >= least)

    return docs.withColumn(into, _bound(pieces(text), lambda parts: F.array_sort(F.concat(*[spans(parts, kind) for kind in KINDS]))))


def redact(docs: DataFrame, column: str = "text", spans: str = "pii") -> DataFrame:
    """Replaces each span by its kind in angle brackets; overlapping spans become one."""
    text = F.coalesce(F.col(column), F.lit(""))

    def written(parts: Column) -> Column:
        told = lambda s, at: F.when(s["start"] >= at, F.concat(cut(parts, at, s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise("")
        before = running(F.transform(spans, lambda s: s["end"]), lambda x, y: F.greatest(x, y))
        return F.concat(F.array_join(F.zip_with(spans, before, told), ""), cut(parts, F.array_max(F.transform(spans, lambda s: s["end"])), F.length(text)))

    return docs.withColumn(column, F.when(F.size(spans) > 0, _bound(pieces(text), written)).otherwise(F.col(column)))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    docs = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["ord"] < len(BASE))
    counted = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [counted(kind) for kind in BASE]
    scores = F.array_join(F.transform("pii", lambda s: s["score"].cast("string")), ",")
    return docs.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("pii")).alias("spans"), scores.alias("scores"))
