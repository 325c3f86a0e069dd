"""Secrets in texts: three base patterns, and weak candidates linked with their other parts.

A credential often comes in parts: who (an access identifier), what (a secret) and where (an
endpoint). Alone a user name, a short password or a host says little; near each other they are a
credential. Candidates of the three sorts are found with their spans, each span is widened by
``REACH`` code points, and the spans of complementary sorts are joined where the widened intervals
meet within a scope (text without a blank line between). Base matches are always reported. Weak
candidates are reported only when joined.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.llm.tokens import forget

KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
BASE = KINDS[:3]
#: What parts a candidate of a sort needs nearby.
NEEDS = {"weak_id": "secret", "weak_secret": "id or endpoint", "endpoint": "secret"}
#: Code points between two parts at most.
REACH = 120

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # as AKIA[A-Z0-9]+ of 16 or more: a run is taken whole
HEX = re.compile(r"[0-9a-f]{32,}")
WEAK_ID = re.compile(r"""(?<![A-Za-z0-9])(?:user(?:_?name)?|login|client_?id|account(?:_?(?:id|name))?|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,}""", re.A | re.I)
WEAK_SECRET = re.compile(r"""(?<![A-Za-z0-9])(?:pwd|pass|passphrase|credentials?|bearer|auth|private_?key)["']?(?:\x20*[:=]\x20*["']?|\x20)[A-Za-z0-9+/_.=!@#$%^&*-]{4,}""", re.A | re.I)
MIXED = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")  # whole runs; counted only with all of ``_MIXTURE``
_MIXTURE = (re.compile("[0-9]"), re.compile("[a-z]"), re.compile("[A-Z]"))
ENDPOINT = re.compile(r"""[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\s"'<>]+|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{1,5})?(?![0-9.])|(?<![A-Za-z0-9@.-])(?:[a-z0-9-]+\.)+(?:com|net|org|io|dev|local|internal)(?::[0-9]{1,5})?(?![A-Za-z0-9])""", re.A)

#: What ends a scope: an empty line, or one of blanks, with either kind of line end.
BLANK = re.compile(r"\n[ \t\r]*\n")

_ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
_WEAK_WORDS = ("pwd", "pass", "credential", "bearer", "auth", "private")
_ID_WORDS = ("user", "login", "client", "account", "access")
_HEX_DIGITS = bytes(1 if chr(b) in "0123456789abcdef" else 0 for b in range(256))
_HEX_RUN = b"\x01" * 32

Span = tuple[int, int, str]


def base_spans(text: str) -> tuple[list[Span], list[Span]]:
    """The base matches, and assignments that failed only for a value of 4 to 7 characters."""
    found, short = [], []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        for m in ASSIGN.finditer(text):
            n = m.end(2) - m.start(2)
            if n >= 8:
                found.append((m.start(), m.end(), "assign"))
            elif n >= 4:
                short.append((m.start(), m.end(), "weak_secret"))
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    if _HEX_RUN in text.encode("utf-8", "surrogatepass").translate(_HEX_DIGITS):
        found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return found, short


def _joined(text: str, spans: list[Span], others: list[Span]) -> list[Span]:
    """Those of ``spans`` with one of ``others`` in reach and in scope. Interval join of two sorted
    lists: an interval's nearest partners before and after decide."""
    others = sorted(set(others))
    starts = [s for s, *_ in others]
    ends_so_far, best = [], -1  # of the others up to here, the one that reaches furthest
    for i, (_, e, _) in enumerate(others):
        best = i if best < 0 or e > others[best][1] else best
        ends_so_far.append(best)
    out = []
    for s, e, kind in spans:
        i = bisect_left(starts, s)
        near = ([others[ends_so_far[i - 1]]] if i else []) + others[i : i + 1]
        for a, b, _ in near:
            low, high = (min(e, b), max(s, a))
            if high - low <= REACH and not BLANK.search(text, low, high):
                out.append((s, e, kind))
                break
    return out


def _within(spans: list[Span], others: list[Span], gap: int) -> list[Span]:
    """Those of ``spans`` with at most ``gap`` code points between them and one of ``others``; an
    overlap counts as less than none."""
    others = sorted(others)
    starts, furthest = [s for s, *_ in others], list(accumulate((e for _, e, _ in others), max))
    return [x for x in spans if (i := bisect_left(starts, x[1] + gap + 1)) and furthest[i - 1] >= x[0] - gap]


def find(text: str | None) -> list[Span]:
    """All spans of a text (code points, end exclusive), by start, then kind as listed."""
    text = text or ""
    base, weak_secrets = base_spans(text)
    low = text.lower()
    if any(w in low for w in _WEAK_WORDS):
        weak_secrets += [(*m.span(), "weak_secret") for m in WEAK_SECRET.finditer(text)]
    secrets = [x for x in base if x[2] != "access"]
    ids = [x for x in base if x[2] == "access"]
    weak_ids = [(*m.span(), "weak_id") for m in WEAK_ID.finditer(text)] if any(w in low for w in _ID_WORDS) else []
    if who := ids + weak_ids:  # a mixed string beside an identifier may be its secret
        mixed = [(*m.span(), "weak_secret") for m in MIXED.finditer(text) if all(c.search(m[0]) for c in _MIXTURE)]
        beside, over = _within(mixed, who, REACH), set(_within(mixed, who, -1))
        weak_secrets += [x for x in beside if x not in over]
    weak_secrets = sorted(set(weak_secrets))
    over = set(_within(weak_secrets, secrets, -1)) if secrets else set()
    weak_secrets = [x for x in weak_secrets if x not in over]
    found = list(base)
    if secrets or weak_secrets:
        endpoints = [(*m.span(), "endpoint") for m in ENDPOINT.finditer(text)] if "." in text or "://" in text else []
        every = secrets + weak_secrets
        found += _joined(text, weak_ids, every) + _joined(text, endpoints, every)
        found += _joined(text, weak_secrets, ids + weak_ids + endpoints)
    return sorted(set(found), key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end) of every row; no spans for a null or empty text.

    Rows stay as they are: a repeated or null doc_id has a row each time. Texts of any length are read
    whole, in time linear in their length; an empty table gives no rows. Other columns are ignored.
    """

    def run(rows):
        forget()
        for batch in rows:
            for i in range(0, len(batch), 1024):
                some = batch.slice(i, 1024)
                found = [find(t) for t in some.column(1).to_pylist()]
                spans = [[{"kind": k, "start": s, "end": e} for s, e, k in x] for x in found]
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:int,end:int>>")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact_text(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every reported part replaced; overlapping parts become one mark."""
    if text is None or not (spans := find(text)):
        return text
    out, at = [], 0
    for s, e, _ in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns, with the secrets in ``text`` replaced. Null and empty texts stay as they
    are, repeated rows and null doc_ids too; texts of any length are read whole, an empty table gives no
    rows, and names of other columns cannot clash."""
    at, kind = docs.columns.index("text"), dict(docs.dtypes)["text"]
    if kind != "string":
        docs = docs.withColumn("text", F.col("text").cast("string"))

    def run(rows):
        forget()
        for batch in rows:
            texts = pa.array([redact_text(t, mark) for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
            columns = [texts if i == at else batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
