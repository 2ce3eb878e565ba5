r"""Operator 9, personal data: expressions propose, checksums confirm, context adjusts.

Spans are proposed by regular expressions, leftmost and non-overlapping for
each kind, confirmed by validators (Luhn for cards, mod 97 for IBANs, value
and digit counts for addresses and phone numbers) and scored: a kind's prior,
more if one of its words stands within 40 characters before the span.  The
base kinds (email, ip, card, phone) are kept whatever their score; the added
kinds (iban, ssn) need a score of 0.5.

Only column expressions: no shuffle, no Python.  The expressions match what
the plain ones of the contract match, but cannot run long: possessive where
nothing can be given back, no repeated groups (which recurse in Java), and no
restart inside a run that has failed.

Defined results: null counts as empty and has no spans; positions are code
points, end exclusive; spans are ordered by start, then kind as listed, then
end; each row gives a row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds in order, their priors, and words that raise a score.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.5, "iban": 0.9, "ssn": 0.3}
CONTEXT = {
    "email": "mail|contact|write",
    "ip": "(^|[^a-z0-9])ip([^a-z0-9]|$)|address|host|server",
    "card": "card|visa|credit|pay",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|account|bank",
    "ssn": "ssn|social|security",
}
BONUS, THRESHOLD, NEAR = 0.3, 0.5, 40

_LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++\.[A-Za-z0-9-][A-Za-z0-9.-]*?(?=\.(?![A-Za-z0-9-])|[^A-Za-z0-9.-]|\z)"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Digits, spaces and hyphens, enough of them for a card; a run is cut at two of the latter in a row.
DIGITS = r"[0-9][0-9 -]{11,}+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9_])"
SSN = r"(?<![A-Za-z0-9_])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_])"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
OCTETS = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"

_SPAN = "array<struct<start:int,end:int,body:string>>"


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Matches that one fold appends to an array: growing it match by match would take the square of their number.
_CHUNK = 256


def _fold(pairs: str, start: str, step: str) -> str:
    """SQL: spans from an array of structs; step: a struct (at, add) from position a and element x."""
    inner = f"""aggregate(c, named_struct('at', a.at, 'out', cast(array() as {_SPAN})), (a, x) ->
        transform(array({step}), t -> named_struct('at', t.at, 'out', concat(a.out, t.add)))[0])"""
    return f"""transform(array({pairs}), p -> aggregate(
        transform(sequence(0, (size(p) - 1) div {_CHUNK}), i -> slice(p, cast(i * {_CHUNK} + 1 as int), {_CHUNK})),
        named_struct('at', {start}, 'out', cast(array() as array<{_SPAN}>)),
        (a, c) -> transform(array({inner}), r -> named_struct('at', r.at, 'out', concat(a.out, array(r.out))))[0],
        a -> flatten(a.out)))[0]"""


def _spans(text: str, pattern: str) -> str:
    """SQL: spans of all matches.  The gaps between matches give the positions in one pass."""
    return _fold(
        f"zip_with(split({text}, {_sql(pattern)}, -1), regexp_extract_all({text}, {_sql(pattern)}, 0), (g, b) -> named_struct('gap', g, 'body', b))",
        "0",
        f"""named_struct('at', a.at + length(x.gap) + coalesce(length(x.body), 0), 'add', if(x.body is null, cast(array() as {_SPAN}),
            array(named_struct('start', a.at + length(x.gap), 'end', a.at + length(x.gap) + length(x.body), 'body', x.body))))""",
    )


def _where(test: str, spans: str) -> str:
    """SQL: spans, looked for only in texts that pass a cheap test."""
    return f"if({test}, {spans}, cast(array() as {_SPAN}))"


def _count_digits(body: str) -> str:
    return f"length(regexp_replace({body}, '[^0-9]', ''))"


def _luhn(digits: str) -> str:
    """SQL: whether a string of digits has a valid check digit."""
    return f"""aggregate(sequence(1, length({digits})), 0, (a, i) ->
        a + element_at(array(0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 0, 2, 4, 6, 8, 1, 3, 5, 7, 9),
            1 + cast(substring({digits}, length({digits}) + 1 - i, 1) as int) + if(i % 2 = 0, 10, 0))) % 10 = 0"""


def _mod97(body: str) -> str:
    """SQL: whether the letters and digits of an IBAN leave 1."""
    plain = f"replace({body}, ' ', '')"
    moved = f"concat(substring({plain}, 5), substring({plain}, 1, 4))"
    return f"""length({plain}) between 15 and 34 and aggregate(split({moved}, ''), 0, (a, c) ->
        if(c = '', a, if(c between '0' and '9', a * 10 + cast(ascii(c) - 48 as int), a * 100 + cast(ascii(c) - 55 as int)) % 97)) = 1"""


def _cards(text: str) -> str:
    """SQL: within each run of digits, the parts between doubled separators that pass as card numbers."""
    inner = _fold(
        "zip_with(split(s.body, '[ -]{2,}', -1), regexp_extract_all(s.body, '[ -]{2,}', 0), (p, g) -> named_struct('part', p, 'gap', g))",
        "s.start",
        """named_struct('at', a.at + length(x.part) + coalesce(length(x.gap), 0),
            'add', array(named_struct('start', a.at, 'end', a.at + length(regexp_replace(x.part, '[ -]$', '')), 'body', regexp_replace(x.part, '[ -]$', ''))))""",
    )
    found = f"flatten(transform(filter({_spans(text, DIGITS)}, s -> {_count_digits('s.body')} >= 12), s -> {inner}))"
    digits = "regexp_replace(c.body, '[ -]', '')"
    return f"filter({found}, c -> length({digits}) between 12 and 19 and {_luhn(digits)})"


def _proposals(text: str) -> dict[str, str]:
    """SQL of the confirmed spans of each kind."""
    return {
        "email": _where(f"contains({text}, '@')", _spans(text, EMAIL)),
        "ip": _where(f"contains({text}, '.')", f"filter({_spans(text, IP)}, s -> s.body rlike {_sql(OCTETS)})"),
        "card": _where(f"{text} rlike '[0-9]'", _cards(text)),
        "phone": _where(f"contains({text}, '+')", f"filter({_spans(text, PHONE)}, s -> {_count_digits('s.body')} between 9 and 15)"),
        "iban": _where(f"{text} rlike '[A-Z]{{2}}[0-9]{{2}}'", f"filter({_spans(text, IBAN)}, s -> {_mod97('s.body')})"),
        "ssn": _where(f"contains({text}, '-')", _spans(text, SSN)),
    }


def _scored(kind: str, spans: str, text: str) -> str:
    near = f"lower(substring({text}, greatest(s.start - {NEAR}, 0) + 1, s.start - greatest(s.start - {NEAR}, 0)))"
    score = f"{PRIOR[kind]}D + if({near} rlike {_sql(CONTEXT[kind])}, {BONUS}D, 0D)"
    made = f"transform({spans}, s -> named_struct('start', s.start, 'rank', {KINDS.index(kind)}, 'end', s.end, 'kind', '{kind}', 'score', least(1D, {score})))"
    return made if kind in BASE else f"filter({made}, s -> s.score >= {THRESHOLD}D)"


def find_pii(docs: DataFrame) -> DataFrame:
    """Spans of personal data in every text.

    docs: doc_id, text string.  Returns doc_id, n_email, n_ip, n_card, n_phone,
    base_sha256, spans (kind:start:end, comma-joined), max_score (0 without
    spans) and found (array of structs with the score of each span).
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kinds = _proposals("text")
    rows = rows.select("doc_id", "text", *[F.expr(x).alias(k) for k, x in kinds.items()])
    rows = rows.select("doc_id", *[F.expr(_scored(k, k, "text")).alias(k) for k in KINDS])
    rows = rows.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], F.array_sort(F.concat(*KINDS)).alias("found"))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base: Column = F.filter("found", lambda s: s["rank"] < len(BASE))
    return rows.select("doc_id", *[f"n_{k}" for k in BASE], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("found")).alias("spans"), F.coalesce(F.array_max(F.transform("found", lambda s: s["score"])), F.lit(0.0)).alias("max_score"), "found")
