"""Secret scans: Aho-Corasick keyword prefilter, anchored patterns at its hits, checksum validation.

One pass of an Aho-Corasick automaton over the ASCII-lower-cased text names the places where a pattern can
begin; patterns are only matched there. Hex runs have no keyword: a run of 24 covers four neighbouring
multiples of 6, so a probe of every 6th byte names them. Kinds with an embedded checksum (the last six
base-62 digits are the CRC-32 of the thirty before them) are kept only if it holds.

Null text counts as empty; every input row gives one row, repeated rows included; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import sha256, ship

# Kinds in the order of the result, keywords and the patterns of the base kinds.
BASE_KINDS = ("assign", "access", "hex")
CHECKED_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
KINDS = (*BASE_KINDS, "checked")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX_BYTES = re.compile(rb"[0-9a-f]+")
NOT_HEX_BACK = re.compile(rb"[^0-9a-f]")
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
LEAST = {"assign": 6, "access": 20, "hex": 24}
STRIDE = 6

_IS_HEX = np.zeros(256, dtype=bool)
_IS_HEX[list(b"0123456789abcdef")] = True

Span = tuple[int, int, int]  # start, place of the kind, end


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, words in (("assign", ASSIGN_WORDS), ("access", ("akia",)), ("checked", CHECKED_PREFIXES)):
        for w in words:
            found.add_word(w, (kind, len(w)))
    found.make_automaton()
    return found


def checksum_holds(body: str, tail: str) -> bool:
    n, digits = zlib.crc32(body.encode()), ""
    while n:
        n, d = divmod(n, 62)
        digits = BASE62[d] + digits
    return digits.rjust(6, "0") == tail


def _hex_spans(text: str, raw: bytes) -> Iterator[Span]:
    """Runs are found among the bytes; only code points before a span that is kept are counted, each once."""
    probe = _IS_HEX[np.frombuffer(raw, dtype=np.uint8)[::STRIDE]]
    if len(probe) < 4:
        return
    near = np.flatnonzero(probe[:-3] & probe[1:-2] & probe[2:-1] & probe[3:])
    same, end, counted, points = len(raw) == len(text), 0, 0, 0
    for at in (near * STRIDE).tolist():
        if at < end:
            continue
        back = NOT_HEX_BACK.search(raw[max(0, at - STRIDE) : at][::-1])
        start = at - (back.start() if back else min(at, STRIDE))
        end = HEX_BYTES.match(raw, at).end()
        if end - start >= LEAST["hex"]:
            if same:
                yield start, KINDS.index("hex"), end
            else:
                points += len(raw[counted:start].decode())
                counted = start
                yield points, KINDS.index("hex"), points + end - start


def find_spans(text: str | None) -> list[Span]:
    """All spans of a text, by start, then kind; offsets are code points, the end is exclusive."""
    if not text:
        return []
    raw = text.encode()
    spans, past = [], dict.fromkeys(KINDS, 0)
    for start, kind in sorted((last - n + 1, kind) for last, (kind, n) in _automaton().iter(raw.lower().decode())):
        if start < past[kind]:
            continue
        m = {"assign": ASSIGN, "access": ACCESS, "checked": CHECKED}[kind].match(text, start)
        if not m:
            continue
        past[kind] = m.end()
        if kind == "checked":
            good = checksum_holds(m[1], m[2])
        else:
            good = len(m[2] if kind == "assign" else m[0]) >= LEAST[kind]
        if good:
            spans.append((start, KINDS.index(kind), m.end()))
    return sorted([*spans, *_hex_spans(text, raw)])


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{start}:{end}" for start, k, end in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_assign, n_access, n_hex, n_checked, base_sha256 and spans ("kind:start:end,...") of each row."""
    ship(docs.sparkSession)
    base = len(BASE_KINDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [find_spans(t.as_py()) for t in b.column(1)]
            count = [[sum(k == kind for _, k, _ in s) for s in found] for kind in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    *(pa.array(c, pa.int64()) for c in count),
                    pa.array([sha256(_joined([x for x in s if x[1] < base])) for s in found], pa.string()),
                    pa.array([_joined(s) for s in found], pa.string()),
                ],
                ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    schema = f"id {docs.schema[id_col].dataType.simpleString()}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string"
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("t")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def redacted(text: str | None, mark: str = "[REDACTED]") -> str | None:
    """The text with every span, overlapping ones as one, replaced by the mark."""
    if not (spans := find_spans(text)):
        return text
    out, at, end = [], 0, 0
    for start, _, stop in spans:
        if start >= end:
            out += [text[at:start], mark]
        end = max(end, stop)
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The same rows and columns with the secrets replaced in the text; the length column follows where there is one."""
    ship(docs.sparkSession)
    schema, names = docs.schema, docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols, old = list(b.columns), b.column(names.index(text_col)).to_pylist()
            new = [redacted(t) for t in old]
            if new != old:
                cols[names.index(text_col)] = pa.array(new, cols[names.index(text_col)].type)
                if length_col in names:
                    at = names.index(length_col)
                    was = cols[at].to_pylist()
                    cols[at] = pa.array([w if n == o else len(n) for w, n, o in zip(was, new, old)], cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(run, schema)
