"""Secret scans by assignment-aware lexing.

Two layers give spans of one text. The *base* patterns are fixed: named assignments, access keys and long hex numbers. The *lexer* reads
source and configuration syntax (``name = "x"``, ``name: x``, ``"name": "x"``, ``name => 'x'``, ``name := x``, ``--name=x``), joins
adjacent literals, and propagates constants: a name that is assigned another name takes the literals behind that. Each literal
is scored by how sensitive the names are that it reaches and by how random it looks; from ``LEAST`` on it becomes a span of kind
``literal``, which is the literal's own text. Base spans always stay.

Defined results: a null or empty text has no spans. Spans are in code points, ``end`` exclusive. The same span of one kind counts once.
Placeholders (``changeme``, ``<...>``, ``${...}``) are no secrets of the lexer. Repeated rows get equal results; extra columns are left alone.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

# The base patterns and the order of kinds.
KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGN, LEAST_ACCESS = 8, 16

# What parts of a name say about its value.
WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9,
    "credentials": 0.9, "bearer": 0.8, "auth": 0.6, "authorization": 0.8, "private": 0.5, "key": 0.4, "access": 0.3, "api": 0.3,
    "signature": 0.5, "salt": 0.5, "cookie": 0.5, "session": 0.4, "conn": 0.3, "dsn": 0.6, "webhook": 0.5, "pass": 0.7,
}
LEAST = 1.1
MIN_LITERAL = 6
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|-+|change_?me|example|placeholder|none|null|true|false|todo|your[-_ ].*|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*\)s)$")

# Possessive: a name is read once to its end, whatever follows.
_CHAIN = r"[A-Za-z_$@][\w$-]*+(?:(?:\.|::|->)[A-Za-z_][\w$-]*+)*+"
_NAME = rf"{_CHAIN}(?:\[['\"][\w.-]++['\"]\])?"
_QUOTED = r"\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|`[^`\n]*+`"
# One assignment: an optionally quoted or dashed name, an operator, then literals joined by + or . or blanks, or one bare word.
# A dotted name that is no assignment is passed over as a whole: any later part of it ends at the same place.
PAIR = re.compile(
    rf"(?<![\w$-])(?:(?P<q>[\"']?)(?:--)?(?P<name>{_NAME})(?P=q)[ \t]*+(?:=>|:=|=(?!=)|:(?![:/]))[ \t]*+"
    rf"(?P<value>[bfru]?(?:{_QUOTED})(?:[ \t]*+(?:[+.][ \t]*+)?(?:{_QUOTED}))*+|[^\s\"'`,;(){{}}\[\]]++)|(?:--)?{_CHAIN})"
)
LITERAL = re.compile(_QUOTED)
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind; those too short are consumed and dropped."""
    out = []
    if "=" in text or ":" in text:
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def name_weight(name: str) -> float:
    """Between 0 and 1.5: sums what the parts of the name say, ``api_key`` and ``apiKey`` alike."""
    parts = [p.lower() for p in WORD.findall(name)]
    joined = {a + b for a, b in zip(parts, parts[1:])}
    return min(1.5, sum(WEIGHTS.get(p, 0.0) for p in {*parts, *joined}))


def randomness(literal: str) -> float:
    """Between 0 and 1: bits per character against those of a long random word, less for sentences and paths."""
    n = len(literal)
    bits = -sum(k / n * math.log2(k / n) for k in Counter(literal).values())
    kinds = sum(bool(re.search(p, literal)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    plain = 0.3 * (literal.count(" ") > 1) + 0.3 * literal.startswith(("http://", "https://", "/", "./"))
    return max(0.0, min(1.0, bits / 4.5) * (0.55 + 0.15 * kinds) - plain)


def pairs(text: str) -> Iterator[tuple[str, list[tuple[int, int]], str | None]]:
    """(name, places of its literals without quotes, or None and the name it is assigned)."""
    for m in PAIR.finditer(text):
        if m["name"] is None:
            continue
        value, start = m["value"], m.start("value")
        quoted = [(start + q.start() + 1, start + q.end() - 1) for q in LITERAL.finditer(value)] if value[:1] in "\"'`" or value[1:2] in ("'", '"') else []
        if quoted:
            yield m["name"], quoted, None
        elif re.fullmatch(_NAME, value) and not any(c.isdigit() for c in value):
            yield m["name"], [], value
        else:
            yield m["name"], [(start, start + len(value.rstrip(".")))], None


def literal_spans(text: str) -> list[Span]:
    if "=" not in text and ":" not in text:
        return []
    behind: dict[str, tuple[tuple[int, int], ...]] = {}
    reach: dict[tuple[tuple[int, int], ...], float] = {}
    for name, literals, other in pairs(text):
        own = tuple(literals) if other is None else behind.get(other, ())
        if not own:
            continue
        behind[name] = own
        weight = name_weight(name)
        if weight > reach.get(own, 0.0):
            reach[own] = weight
    out = []
    for places, weight in reach.items():
        literal = "".join(text[s:e] for s, e in places)
        if len(literal) >= MIN_LITERAL and not PLACEHOLDER.match(literal) and weight + randomness(literal) >= LEAST:
            out += [("literal", s, e) for s, e in places if e > s]
    return out


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(set(spans), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


_SPAN = StructType().add("kind", StringType()).add("start", IntegerType()).add("end", IntegerType())


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        base, found = [], []
        for text in batch.column("text").to_pylist():
            own = ordered(base_spans(text or ""))
            base.append([dict(zip(("kind", "start", "end"), s)) for s in own])
            found.append([dict(zip(("kind", "start", "end"), s)) for s in ordered(own + literal_spans(text or ""))])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(base, kind), pa.array(found, kind)], names=[*batch.schema.names, "base", "spans"])


def find_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, text, base, spans) per document: arrays of (kind, start, end), by start, then kind."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col] or [F.lit(None).cast("int").alias("none")]
    state = docs.select(F.struct(*others).alias("row"), F.col(text_col).alias("text"))
    return state.mapInArrow(_scan, StructType([*state.schema.fields]).add("base", ArrayType(_SPAN)).add("spans", ArrayType(_SPAN)))


def _masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            at, parts = 0, []
            for span in spans:
                if span["end"] > at:
                    parts += [text[at : max(at, span["start"])], f"[{span['kind']}]"] if span["start"] >= at else []
                    at = span["end"]
            out.append(text if text is None else "".join(parts) + text[at:])
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string())], names=["row", "text"])


def mask(found: DataFrame) -> DataFrame:
    """(row, text) of :func:`find_secrets` with every span replaced by its kind."""
    return found.select("row", "text", "spans").mapInArrow(_masked, found.select("row", "text").schema)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        F.col(f"row.`{id_col}`").alias("doc_id"),
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(text("base").cast("binary"), 256).alias("base_sha256"),
        text("spans").alias("spans"),
    )


def sha256_of(spans: list[Span]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
