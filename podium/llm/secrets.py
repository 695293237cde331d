"""Secret scans with structural confirmation (operator 12).

Three base patterns (assignments, access keys, long hexadecimal runs) are reported
as they match.  Beyond them, base64 and hexadecimal runs are candidates only:
a candidate is decoded and its inside parsed before it is reported,

* ``jwt``: a signed token: the header is a JSON object that names its algorithm,
  the payload a JSON object, the signature as long as the algorithm makes it;
* ``key``: a private key in DER (PKCS#1, PKCS#8, encrypted PKCS#8, SEC 1, DSA):
  nested tags and lengths must fit each other to the last byte;
* ``ssh``: an OpenSSH private key: its magic and its chain of length-prefixed
  fields, with the same key type and check words inside.

The structure tells where a candidate ends, so text behind it is left alone.
Every text is scanned whole, by rows; no shuffle.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

# ---------------------------------------------------------------------------
# The base patterns, their least lengths, and the kinds in order
# ---------------------------------------------------------------------------
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "jwt", "key", "ssh"]
#: bytes of a signature by algorithm; of RSA signatures the least
SIGNATURES = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES256K": 64, "ES384": 96, "ES512": 132, "EdDSA": 64}
RSA_SIGNATURE_LEAST = 128
SSH_MAGIC = b"openssh-key-v1\x00"
# ---------------------------------------------------------------------------
#: a JSON object in base64 begins with e; DER's sequence tag with M (hexadecimal: 30), the OpenSSH magic with b3B
JWT = re.compile(r"(?<![A-Za-z0-9_-])e[A-Za-z0-9_-]{7,}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+(?![A-Za-z0-9_.-])")
#: lines of base64, joined by white space or by backslash-n as in quoted keys
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?:M[A-Z]|b3B)[A-Za-z0-9+/_-]{38,}={0,2}"
                    r"(?:(?:\r?\n|\\r\\n|\\n)[\x20\t]*[A-Za-z0-9+/_-]+={0,2})*")
HEX_DER = re.compile(r"(?<![0-9A-Fa-f])(?:30|6f70656e7373682d)[0-9A-Fa-f]{62,}", re.I | re.A)
BREAK = re.compile(r"(?:\r?\n|\\r\\n|\\n)[\x20\t]*")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, in code points, end exclusive."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def _in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


class Malformed(ValueError):
    """The bytes are not of the structure looked for."""


def der_parts(data: bytes, at: int, end: int) -> list[tuple[int, int, int]]:
    """(tag, start, end) of the values that fill ``data[at:end]``; each length must be
    in its shortest form and stay inside."""
    out = []
    while at < end:
        if end - at < 2:
            raise Malformed
        tag, length, at = data[at], data[at + 1], at + 2
        if tag & 0x1F == 0x1F:
            raise Malformed
        if length & 0x80:
            n = length & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                raise Malformed
            length, at = int.from_bytes(data[at:at + n], "big"), at + n
            if length < 0x80 or length < 1 << (8 * (n - 1)):
                raise Malformed
        if at + length > end:
            raise Malformed
        out.append((tag, at, at + length))
        at += length
    return out


def der_private_key(data: bytes) -> int:
    """Number of bytes of the private key that ``data`` begins with; Malformed if none."""
    if len(data) < 2 or data[0] != 0x30:
        raise Malformed
    size = data[1] if data[1] < 0x80 else int.from_bytes(data[2:2 + (data[1] & 0x7F)], "big")
    total = 2 + (data[1] & 0x7F if data[1] & 0x80 else 0) + size
    if data[1] == 0x80 or data[1] > 0x84 or total > len(data):
        raise Malformed
    (_, start, end), = der_parts(data, 0, total)
    parts = der_parts(data, start, end)
    tags = [p[0] for p in parts]

    def number(i: int) -> int:
        _, a, z = parts[i]
        if a == z or (z - a > 1 and data[a] == 0 and data[a + 1] < 0x80):
            raise Malformed
        return int.from_bytes(data[a:z], "big")

    def algorithm(i: int) -> bool:
        inside = der_parts(data, *parts[i][1:])
        return bool(inside) and inside[0][0] == 0x06 and inside[0][2] - inside[0][1] >= 3

    if len(tags) >= 9 and set(tags[:9]) == {2}:  # PKCS#1: version, n, e, d, p, q, ...; n = p q
        found = number(0) in (0, 1) and number(1) == number(4) * number(5) and number(1).bit_length() >= 256
    elif tags == [2] * 6:  # DSA: version, p, q, g, y, x; q divides p - 1
        found = number(0) == 0 and number(2) > 1 and (number(1) - 1) % number(2) == 0
    elif tags[:3] == [2, 0x30, 4] and all(t in (0xA0, 0xA1, 0x81) for t in tags[3:]):  # PKCS#8: version, algorithm, key
        found = number(0) in (0, 1) and algorithm(1) and parts[2][2] - parts[2][1] >= 16
        inside = der_parts(data, *parts[2][1:]) if found else []  # the key is DER again
        found = found and len(inside) == 1 and inside[0][0] in (0x30, 4, 2)
    elif tags == [0x30, 4]:  # encrypted PKCS#8: scheme with its parameters, bytes
        found = algorithm(0) and len(der_parts(data, *parts[0][1:])) == 2 and parts[1][2] - parts[1][1] >= 32
    elif tags[:2] == [2, 4] and all(t in (0xA0, 0xA1) for t in tags[2:]):  # SEC 1: version, secret, curve, public point
        found = number(0) == 1 and parts[1][2] - parts[1][1] in (20, 24, 28, 32, 48, 66)
    else:
        found = False
    if not found:
        raise Malformed
    return total


def ssh_private_key(data: bytes) -> int:
    """Number of bytes of the OpenSSH private key that ``data`` begins with."""
    if not data.startswith(SSH_MAGIC):
        raise Malformed
    at = len(SSH_MAGIC)

    def word(d: bytes, i: int) -> int:
        if i + 4 > len(d):
            raise Malformed
        return int.from_bytes(d[i:i + 4], "big")

    def field(d: bytes, i: int) -> tuple[bytes, int]:
        n = word(d, i)
        if i + 4 + n > len(d):
            raise Malformed
        return d[i + 4:i + 4 + n], i + 4 + n

    cipher, at = field(data, at)
    derivation, at = field(data, at)
    _, at = field(data, at)
    if word(data, at) != 1 or not cipher or not derivation:
        raise Malformed
    public, at = field(data, at + 4)
    kind, _ = field(public, 0)
    private, at = field(data, at)
    if not kind.isascii() or not private:
        raise Malformed
    if cipher == b"none" and (word(private, 0) != word(private, 4) or field(private, 8)[0] != kind):
        raise Malformed
    return at


def _base64(run: str) -> bytes:
    run = run.rstrip("=").translate(str.maketrans("-_", "+/"))
    run = run[:len(run) - (len(run) % 4 == 1)]
    return base64.b64decode(run + "=" * (-len(run) % 4))


def _key(data: bytes) -> tuple[str, int]:
    return ("ssh", ssh_private_key(data)) if data.startswith(b"o") else ("key", der_private_key(data))


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the candidates whose structure holds."""
    out = []
    for m in JWT.finditer(text):
        try:
            head, body, signature = m[0].split(".")
            header, claims, signed = json.loads(_base64(head)), json.loads(_base64(body)), _base64(signature)
        except (ValueError, RecursionError):
            continue
        name = header.get("alg") if isinstance(header, dict) else None
        if not isinstance(name, str) or not isinstance(claims, dict) or name.lower() == "none":
            continue
        least = SIGNATURES.get(name) or (RSA_SIGNATURE_LEAST if name[:2] in ("RS", "PS") else 16)
        if len(signed) == least if name in SIGNATURES else len(signed) >= least:
            out.append(("jwt", *m.span()))
    for m in BASE64.finditer(text):
        # places in the text of the characters without line breaks
        runs, at = [], m.start()
        for b in BREAK.finditer(text, m.start(), m.end()):
            runs.append((at, b.start()))
            at = b.end()
        runs.append((at, m.end()))
        joined = "".join(text[a:z].rstrip("=") for a, z in runs)
        try:
            kind, n = _key(_base64(joined))
        except (Malformed, binascii.Error):
            continue
        left = (n * 4 + 2) // 3
        for a, z in runs:
            here = len(text[a:z].rstrip("="))
            if left <= here:
                # its padding too, if the key ends where the run does
                out.append((kind, m.start(), z if left == here else a + left))
                break
            left -= here
    for m in HEX_DER.finditer(text):
        try:
            kind, n = _key(bytes.fromhex(m[0][:len(m[0]) // 2 * 2]))
        except Malformed:
            continue
        out.append((kind, m.start(), m.start() + 2 * n))
    return out


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base, spans = [], []
        for text in batch.column(1).to_pylist():
            found = base_spans(text or "")
            base.append([dict(zip(("kind", "start", "end"), s)) for s in _in_order(found)])
            more = confirmed_spans(text or "")
            spans.append([dict(zip(("kind", "start", "end"), s)) for s in _in_order(found + more)] if more else base[-1])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(base, pa.list_(_SPAN)), pa.array(spans, pa.list_(_SPAN))], ["doc_id", "base", "spans"])


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, spans) of every row: arrays of (kind, start, end), in code points,
    end exclusive, by start, then kind; ``spans`` has the base ones and those confirmed.

    A null or empty text has none.  Every row is judged on its own, so repeated
    rows and null ids give rows of their own; an empty table gives no rows; other
    columns are ignored, whatever their names.  Spans of different kinds may
    overlap.
    """
    span = "array<struct<kind:string,start:long,end:long>>"
    return map_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), _scan,
                       f"doc_id long, base {span}, spans {span}")


def joined(spans) -> "F.Column":
    """kind:start:end of an array of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
