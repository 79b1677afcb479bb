"""Op 7: secrets in texts, with structural confirmation of what only looks like a key.

Three base kinds come from patterns: assign, access and hex. The method adds spans that are reported
only when what they decode to holds together: jwt (a signed token whose header is a JSON object with
an algorithm and whose body is JSON too), der (base64 or hex of a private key whose nested DER lengths
all agree: PKCS#1, PKCS#8 or SEC1), openssh (base64 of an OpenSSH key whose length-prefixed fields
fill it), pem (an armoured block whose body decodes to one of those, or is declared encrypted).
A base span stays whether or not it decodes.

Every text is scanned whole, a row at a time, in bounded memory; nothing is shuffled.

Defined results: null and empty texts have no spans; the digest is that of the empty string. Offsets
are code points, ends exclusive. Repeated rows are scanned each. Empty input gives empty output.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import keep_columns, table

KINDS = ("assign", "access", "hex", "jwt", "der", "openssh", "pem")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
JWT = re.compile(r"eyJ[A-Za-z0-9_-]*\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
BASE64 = re.compile(r"[A-Za-z0-9+/]{64,}={0,2}")
LONG_HEX = re.compile(r"[0-9A-Fa-f]{96,}")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----\s*(.*?)-----END \1-----", re.DOTALL)
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: a: 0-9a-f; b: other characters of base64
CLASSES = bytes(97 if chr(c) in "0123456789abcdef" else 98 if re.match("[A-Za-z0-9+/]", chr(c)) else 32 for c in range(256))


def _tlv(data: bytes, at: int, end: int) -> tuple[int, int, int]:
    """Tag, and where the contents start and end; ValueError where the length doesn't fit."""
    if at + 2 > end:
        raise ValueError
    tag, n, at = data[at], data[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > end or data[at] == 0:
            raise ValueError
        n, at = int.from_bytes(data[at : at + k], "big"), at + k
        if n < 0x80:
            raise ValueError
    if at + n > end:
        raise ValueError
    return tag, at, at + n


def _children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]]:
    out = []
    while at < end:
        out.append(_tlv(data, at, end))
        at = out[-1][2]
    return out


def is_der_key(data: bytes) -> bool:
    """A DER private key, all nested lengths of which fill what holds them."""
    try:
        tag, a, b = _tlv(data, 0, len(data))
        if tag != 0x30 or b != len(data):
            return False
        parts = _children(data, a, b)
        tags = [x[0] for x in parts]
        if len(parts) >= 9 and tags[:9] == [2] * 9 and all(y > x for _, x, y in parts):  # PKCS#1
            return True
        if tags[:3] == [2, 0x30, 4]:  # PKCS#8
            alg = _children(data, *parts[1][1:])
            return bool(alg) and alg[0][0] == 6 and alg[0][2] > alg[0][1] and parts[2][2] > parts[2][1]
        return tags[:2] == [2, 4] and data[parts[0][1] : parts[0][2]] == b"\x01" and parts[1][2] - parts[1][1] >= 16  # SEC1
    except ValueError:
        return False


def is_openssh_key(data: bytes) -> bool:
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)

    def field(at: int) -> int:
        end = at + 4 + int.from_bytes(data[at : at + 4], "big")
        if at + 4 > len(data) or end > len(data):
            raise ValueError
        return end

    try:
        at = field(field(field(at)))  # cipher, KDF, its options
        keys = int.from_bytes(data[at : at + 4], "big")
        if not 1 <= keys <= 16:
            return False
        at += 4
        for _ in range(keys + 1):  # public keys, then the private part
            at = field(at)
        return at == len(data)
    except ValueError:
        return False


def _base64(x: str) -> bytes:
    x = x.rstrip("=")
    try:
        return base64.b64decode(x + "=" * (-len(x) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def _json_part(x: str):
    try:
        return json.loads(base64.urlsafe_b64decode(x + "=" * (-len(x) % 4)))
    except (binascii.Error, ValueError, RecursionError):
        return None


def _kind(data: bytes) -> str | None:
    return "der" if is_der_key(data) else "openssh" if is_openssh_key(data) else None


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    low = text.lower()
    if any(x in low for x in WORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if b"a" * 24 in text.encode("utf-8").translate(CLASSES):
        out += [("hex", *m.span()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    return out


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    if "eyJ" in text:
        for m in JWT.finditer(text):
            head, body, _ = m[0].split(".")
            header = _json_part(head)
            if isinstance(header, dict) and isinstance(header.get("alg"), str) and _json_part(body) is not None:
                out.append(("jwt", *m.span()))
    if "PRIVATE KEY-----" in text:
        for m in PEM.finditer(text):
            lines = [x for x in m[2].split() if x]
            body = "".join(re.sub(r"(?m)^[A-Za-z-]+:.*$", "", m[2]).split())
            if _kind(_base64(body)) or ("ENCRYPTED" in m[1] + "".join(lines) and len(_base64(body)) >= 32):
                out.append(("pem", *m.span()))
    if b"b" * 64 in text.encode("utf-8").translate(CLASSES).replace(b"a", b"b"):
        for m in BASE64.finditer(text):
            if kind := _kind(_base64(m[0])):
                out.append((kind, *m.span()))
        for m in LONG_HEX.finditer(text):
            if len(m[0]) % 2 == 0 and (kind := _kind(bytes.fromhex(m[0]))):
                out.append((kind, *m.span()))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each row of docs."""
    docs = keep_columns(docs, "doc_id", "text")
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], []]
            digests, spans = [], []
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                for c, kind in zip(counts, KINDS, strict=False):
                    c.append(sum(x[0] == kind for x in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(base + confirmed_spans(text or "")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], names)

    return docs.mapInArrow(scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
