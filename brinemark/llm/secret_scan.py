"""Secret scan: an Aho-Corasick pass over each text finds keywords, and anchored expressions run only there.

Kinds, in the order used for ties:
- assign: a keyword, ':' or '=' and a value of at least 6 characters;
- access: AKIA and upper-case letters or digits, 20 characters at least;
- hex: a run of lower-case hexadecimal digits, 24 at least;
- checked: a token that carries its own checksum (prefix, 30 base-62 characters and the CRC-32 of these
  in 6 base-62 digits). This kind is added by the method; it is reported only if the checksum holds.

Each kind is found leftmost and without overlaps as its whole expression would find it; a match that
fails its length or checksum is dropped and isn't tried again from inside.

Cases: a null text counts as empty and has no spans; repeated rows are scanned each; a null id stays
null; an empty table gives an empty table; other columns aren't read, so their names can't clash. A text of any
length is scanned whole, in time linear in its length.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, join_spans, table

KINDS = {"assign": 0, "access": 1, "hex": 2, "checked": 3}
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = "AKIA"
#: Prefixes of access tokens that end in a base-62 CRC-32.
CHECKED = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_ASSIGN_TAIL = re.compile(r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS_TAIL = re.compile(r"[A-Z0-9]+")
_HEX_RUN = re.compile(r"[0-9a-f]{24,}")
_CHECKED_TAIL = re.compile(r"[A-Za-z0-9]{36}(?![A-Za-z0-9])")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})


def checksum62(body: str) -> str:
    """CRC-32 of the body as six base-62 digits."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out


def has_checksum(token: str) -> bool:
    return checksum62(token[-36:-6]) == token[-6:]


class Scanner:
    def __init__(self):
        import ahocorasick

        self.words = ahocorasick.Automaton()
        for w in KEYWORDS:
            self.words.add_word(w, ("assign", len(w)))
        self.words.add_word(ACCESS.lower(), ("access", len(ACCESS)))
        for w in CHECKED:
            self.words.add_word(w, ("checked", len(w)))
        self.words.make_automaton()

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        if not text:
            return []
        out: list[tuple[str, int, int]] = []
        past = dict.fromkeys(KINDS, 0)
        for last, (kind, size) in self.words.iter(text.translate(_LOWER) if not text.isascii() else text.lower()):
            start, at = last - size + 1, last + 1
            if start < past[kind]:
                continue
            if kind == "assign":
                m = _ASSIGN_TAIL.match(text, at)
                if m:
                    past[kind] = m.end()
                    if m.end(1) - m.start(1) >= 6:
                        out.append((kind, start, m.end()))
            elif kind == "access":
                if text.startswith(ACCESS, start) and (m := _ACCESS_TAIL.match(text, at)):
                    past[kind] = m.end()
                    if m.end() - start >= 20:
                        out.append((kind, start, m.end()))
            elif text[start:at] in CHECKED and (not start or not text[start - 1].isalnum()) and (m := _CHECKED_TAIL.match(text, at)):
                past[kind] = m.end()
                if has_checksum(m[0]):
                    out.append((kind, start, m.end()))
        out += [("hex", m.start(), m.end()) for m in _HEX_RUN.finditer(text)]
        return out


_SCANNER: list[Scanner] = []


def scanner() -> Scanner:
    if not _SCANNER:
        _SCANNER.append(Scanner())
    return _SCANNER[0]


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id and secrets, an array of (kind, start, stop) by start and kind; places count code points."""

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        s = scanner()
        found = [sorted(s.spans(t.as_py()), key=lambda x: (x[1], KINDS[x[0]])) for t in b.column(1)]
        arr = pa.array([[{"kind": k, "start": i, "stop": j} for k, i, j in x] for x in found], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])))
        return pa.RecordBatch.from_arrays([b.column(0), arr], names=["id", "secrets"])

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(id_col, text), one, f"`{id_col}` {kind}, secrets array<struct<kind:string,start:long,stop:long>>")


def mask(text: str, spans: list[tuple[str, int, int]], token: str = "<{}>") -> str:
    """The text with each span, overlapping ones together, replaced by its first kind's mark."""
    out, at = [], 0
    for kind, start, stop in sorted(spans, key=lambda x: (x[1], KINDS[x[0]])):
        if start >= at:
            out += [text[at:start], token.format(kind)]
        at = max(at, stop)
    return "".join(out) + text[at:]


def mask_secrets(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """docs with secrets in the text replaced by marks such as <assign>; n_chars follows where there is such a column.

    A null text stays null; rows without secrets stay as they are.
    """
    schema = docs.schema
    at = schema.fieldNames().index(text)
    size = schema.fieldNames().index(n_chars) if n_chars in schema.fieldNames() else None

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        s, texts = scanner(), b.column(at).to_pylist()
        found = [s.spans(t) for t in texts]
        if not any(found):
            return b
        columns = list(b.columns)
        new = [mask(t, x) if x else t for t, x in zip(texts, found, strict=True)]
        columns[at] = pa.array(new, columns[at].type)
        if size is not None:
            n = columns[size].to_pylist()
            columns[size] = pa.array([len(t) if x else k for t, x, k in zip(new, found, n, strict=True)], columns[size].type)
        return pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return arrow_map(docs, one, schema)


def digests(base: list[tuple[str, int, int]], every: list[tuple[str, int, int]], order: dict[str, int]) -> tuple[str, str]:
    return hashlib.sha256(join_spans(base, order).encode()).hexdigest(), join_spans(every, order)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    return digest_columns(found, "secrets", ["assign", "access", "hex"], ["n_checked"])


def digest_columns(found: DataFrame, column: str, base: list[str], more: list[str]) -> DataFrame:
    """doc_id, a count of each kind, base_sha256 and spans from an ordered array of spans."""
    from pyspark.sql import functions as F

    told = lambda a: F.concat_ws(",", F.transform(a, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.stop.cast("string"))))
    count = lambda k: F.size(F.filter(column, lambda x: x.kind == k)).cast("long")
    own = F.filter(column, lambda x: x.kind.isin(base))
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in base], F.sha2(told(own), 256).alias("base_sha256"), told(F.col(column)).alias("spans"), *[count(k.removeprefix("n_")).alias(k) for k in more]
    )


__all__ = ["find_secrets", "mask_secrets", "op5_secret_scan", "checksum62", "scanner"]


def secret_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of base spans alone, which SQL can express."""
    return op5_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


BASE_COUNTS_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, len(list_filter(regexp_extract_all(text, '(?i:(password|passwd|secret|token|api_?key))["\']?\x20*[:=]\x20*["\']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6)) AS n_assign,
    len(list_filter(regexp_extract_all(text, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS n_access,
    len(list_filter(regexp_extract_all(text, '[0-9a-f]+'), lambda x: length(x) >= 24)) AS n_hex FROM d""".replace("\\'", "''")
