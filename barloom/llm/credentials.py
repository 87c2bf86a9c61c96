"""Secret scans with structural confirmation (operator 11).

Plain patterns find assignments, access keys and long hex strings. Everything else is reported only after it was
decoded and its structure held:

* ``jwt``: a signed or encrypted token. The header decodes to a JSON object with an algorithm, the number of segments
  fits it, the payload of a signed token is a JSON object and the signature has the algorithm's length.
* ``key``: a private key. Base64 (on one line or wrapped, between markers or bare) or hex is decoded and parsed: DER whose nested
  lengths fill each other exactly and whose members are those of a PKCS#1, PKCS#8, SEC1, DSA or PKCS#12 structure, the
  length-prefixed strings of an OpenSSH key, or the packets of an OpenPGP key. Text inside base64 is searched again, ``DEPTH``
  layers deep, so an encoded key file is found too. Public keys and certificates parse as well and are not reported.
* ``basic``: HTTP basic credentials, decoding to printable ``name:password``.

The scan is one projection: no shuffle, whole texts, and a state of one text. All patterns are linear in the text's length.

Defined cases: null text is empty; an empty text has no spans; texts of any length are scanned whole; repeated rows are scanned
each for itself; an empty table gives no rows; ``redact`` keeps further columns, whatever their names, the others ignore them. Positions count
code points, ends are exclusive. Spans of one kind do not overlap; spans of different kinds may.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "jwt", "key", "basic")
DEPTH = 3
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{%d,}" % MIN_HEX)  # a maximal run, as shorter ones fail
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]*){2,4}")
_MARKER = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{1,60})-----")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
_MORE = re.compile(r"(?:\r?\n|(?:\\r)?\\n)[ \t]*([A-Za-z0-9+/]+={0,2})")
_HEX_RUN = re.compile(r"[0-9A-Fa-f]+")
_BASIC = re.compile(r"\b[Bb]asic ([A-Za-z0-9+/]{8,}={0,2})(?![A-Za-z0-9+/=])", re.ASCII)
_BREAKS = re.compile(r"\s|\\[nr]")

#: Fixed values of the token standard: bytes of a signature.
_SIGNATURE = {"none": 0, "HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES256K": 64, "ES384": 96, "ES512": 132}
#: Encoded object identifiers.
_RSA, _EC = bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a8648ce3d0201")
_CURVES = {bytes.fromhex("2b656e"): 32, bytes.fromhex("2b656f"): 56, bytes.fromhex("2b6570"): 32, bytes.fromhex("2b6571"): 57}
_ENCRYPTION = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
_OPENSSH = b"openssh-key-v1\0"
INT, BITS, OCTETS, OID, SEQ = 2, 3, 4, 6, 48


def _header(data: bytes, at: int) -> tuple[int, int, int] | None:
    """(tag, start, end) of the DER element at ``at``: definite lengths in their shortest form only."""
    if at + 2 > len(data) or data[at] & 31 == 31:
        return None
    n, start = data[at + 1], at + 2
    if n >= 128:
        size = n - 128
        n, start = int.from_bytes(data[start:start + size], "big"), start + size
        if not 1 <= size <= 4 or n < 128 or n >> 8 * (size - 1) == 0:
            return None
    return data[at], start, start + n


def _members(data: bytes, start: int, end: int) -> list[tuple[int, bytes]]:
    """(tag, content) of the elements that fill start:end exactly; none if they do not."""
    out = []
    while start < end:
        h = _header(data, start)
        if h is None or h[2] > end:
            return []
        out.append((h[0], data[h[1]:h[2]]))
        start = h[2]
    return out


def _sequence(content: bytes) -> list[tuple[int, bytes]]:
    return _members(content, 0, len(content))


def _whole_key(data: bytes) -> str | None:
    """The kind of a private key that fills ``data``."""
    h = _header(data, 0)
    return _key_of(_members(data, h[1], h[2])) if h and h[0] == SEQ and h[2] == len(data) else None


def _key_of(parts: list[tuple[int, bytes]]) -> str | None:
    """Which private key the members of an outer sequence make up."""
    tags, body = [t for t, _ in parts], [b for _, b in parts]
    if len(parts) >= 9 and set(tags[:9]) == {INT} and body[0] in (b"\0", b"\1") and len(body[1]) >= 64 and len(body[3]) > len(body[1]) // 2:
        return "pkcs1"
    if tags == [INT] * 6 and body[0] == b"\0" and len(body[1]) >= 64 and 16 <= len(body[2]) <= 65:
        return "dsa"
    if tags[:2] == [INT, OCTETS] and body[0] == b"\1" and 20 <= len(body[1]) <= 72 and set(tags[2:]) <= {0xA0, 0xA1} and len(tags) > 2:
        inner = {t: _sequence(b) for t, b in parts[2:]}
        if all([x[0] for x in inner[t]] in ([OID], [SEQ], [BITS]) for t in inner):
            return "sec1"
    if tags[:3] == [INT, SEQ, OCTETS] and body[0] in (b"\0", b"\1") and set(tags[3:]) <= {0xA0, 0x81, 0xA1}:
        name = _sequence(body[1])
        if name and name[0][0] == OID and _fits(name[0][1], body[2]):
            return "pkcs8"
    if tags == [SEQ, OCTETS] and len(body[1]) >= 16:
        name = _sequence(body[0])
        if name and name[0][0] == OID and name[0][1].startswith(_ENCRYPTION):
            return "pkcs8-encrypted"
    if tags[:2] == [INT, SEQ] and body[0] == b"\3" and set(tags[2:]) <= {SEQ} and _sequence(body[1])[:1] and _sequence(body[1])[0][0] == OID:
        return "pkcs12"
    return None


def _fits(oid: bytes, private: bytes) -> bool:
    """Whether the inner string of a PKCS#8 key is what its algorithm wants."""
    if oid == _RSA:
        return _whole_key(private) == "pkcs1"
    h = _header(private, 0)
    if h is None or h[2] != len(private):
        return False
    if oid in _CURVES:
        return h[0] == OCTETS and h[2] - h[1] == _CURVES[oid]
    if oid == _EC:
        parts = _members(private, h[1], h[2]) if h[0] == SEQ else []
        return [t for t, _ in parts[:2]] == [INT, OCTETS] and parts[0][1] == b"\1"
    return h[0] in (INT, OCTETS, SEQ)


def _openssh(data: bytes) -> int | None:
    """Length of the OpenSSH private key that ``data`` begins with."""
    at = len(_OPENSSH)

    def number() -> int:
        nonlocal at
        at += 4
        if at > len(data):
            raise ValueError
        return int.from_bytes(data[at - 4:at], "big")

    def string() -> bytes:
        nonlocal at
        n = number()
        at += n
        if at > len(data):
            raise ValueError
        return data[at - n:at]

    try:
        cipher, _, _ = string(), string(), string()
        public = [string() for _ in range(min(number(), 64))]
        private = string()
    except ValueError:
        return None
    names = [p[4:4 + int.from_bytes(p[:4], "big")] for p in public]
    if not names or not all(0 < len(n) < len(p) for n, p in zip(names, public)):
        return None
    if cipher == b"none" and (private[:4] != private[4:8] or private[12:12 + len(names[0])] != names[0]):
        return None
    return at


def _openpgp(data: bytes) -> bool:
    """Whether ``data`` is a row of packets that begins with a secret key."""
    at, first = 0, True
    while at < len(data):
        b = data[at]
        if not b & 0x80 or at + 2 > len(data):
            return False
        at += 1
        if b & 0x40:
            tag, n = b & 63, data[at]
            at += 1
            if 192 <= n < 224 and at < len(data):
                n, at = (n - 192 << 8) + data[at] + 192, at + 1
            elif n == 255:
                n, at = int.from_bytes(data[at:at + 4], "big"), at + 4
            elif n >= 224:
                return False
        else:
            tag, size = b >> 2 & 15, 1 << (b & 3)
            if size == 8:
                return False
            n, at = int.from_bytes(data[at:at + size], "big"), at + size
        if at + n > len(data) or first and (tag != 5 or n < 6 or data[at] not in (3, 4, 5, 6)):
            return False
        at, first = at + n, False
    return not first


def _decode(chars: str) -> bytes | None:
    """Strict base64 of either alphabet; missing padding is added."""
    chars = chars.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(chars + "=" * (-len(chars) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _object(segment: str) -> dict | None:
    raw = _decode(segment)
    try:
        value = json.loads(raw.decode()) if raw else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def _tokens(text: str) -> Iterator[tuple[str, int, int, str]]:
    for m in _TOKEN.finditer(text):
        parts = m[0].split(".")
        header = _object(parts[0])
        alg = header.get("alg") if header else None
        if not isinstance(alg, str):
            continue
        if "enc" in header:
            if len(parts) == 5 and all(_decode(p) is not None for p in parts[1:]) and parts[3] and parts[4]:
                yield "jwt", m.start(), m.end(), f"encrypted {alg}"
            continue
        signature = _decode(parts[2])
        if _object(parts[1]) is None or signature is None:
            continue
        if len(signature) == _SIGNATURE[alg] if alg in _SIGNATURE else len(signature) >= 64:
            yield "jwt", m.start(), m.start() + len(".".join(parts[:3])), f"signed {alg}"


def _block(label: str, body: str) -> str | None:
    """The kind of the private key between markers."""
    head, _, rest = body.partition("\n\n")
    if label == "PGP PRIVATE KEY BLOCK":
        lines = (rest or body).replace("\\n", "\n").split()
        data = _decode("".join(x for x in lines if not x.startswith("=")))
        return "openpgp" if data and _openpgp(data) else None
    if "ENCRYPTED" in head and "DEK-Info:" in head:
        data = _decode(_BREAKS.sub("", rest))
        return "encrypted" if data and len(data) % 8 == 0 else None
    data = _decode(_BREAKS.sub("", body))
    if not data:
        return None
    if data.startswith(_OPENSSH):
        return "openssh" if _openssh(data) == len(data) else None
    return _whole_key(data)


def _blocks(text: str) -> Iterator[tuple[str, int, int, str]]:
    begin = None
    for m in _MARKER.finditer(text):
        if m[1] == "END" and begin is not None and begin[2] == m[2]:
            kind = _block(m[2], text[begin.end():m.start()])
            if kind:
                yield "key", begin.start(), m.end(), kind
        begin = m if m[1] == "BEGIN" else None


def _bare(text: str, m: re.Match, depth: int) -> tuple[int, str] | None:
    """(end, kind) of the key that the run ``m`` of base64 or hex characters begins with."""
    run = m[0]
    if run[:2] == "30" and (h := _HEX_RUN.match(run)) and len(h[0]) >= 64:
        data = bytes.fromhex(h[0][:len(h[0]) & ~1])
        size = (_header(data, 0) or (0, 0, 0))[2]
        if 0 < size <= len(data) and (kind := _whole_key(data[:size])):
            return m.start() + 2 * size, f"hex {kind}"
    head = _decode(run[:24]) or b""
    der = head[:1] == b"\x30"
    nested = head.startswith((b"-----BEGIN ", b"eyJ"))
    if not der and not nested and not head.startswith(_OPENSSH):
        return None
    size = (_header(head, 0) or (0, 0, 0))[2] if der else 0
    need = -(-size * 4 // 3)  # characters that hold a DER key
    # the characters' places, over as many lines as the run goes on or the key needs
    pieces, starts, end, length = [run.rstrip("=")], [m.start()], m.end(), len(run)
    while run[-1] != "=" and not 0 < need <= length and (more := _MORE.match(text, end)):
        run = more[1]
        pieces.append(run.rstrip("="))
        starts.append(more.start(1))
        end, length = more.end(), length + len(run)
    chars = "".join(pieces)
    if der and not 0 < need <= len(chars):
        return None
    chars = chars[:need] if der else chars
    data = _decode(chars[:len(chars) - (len(chars) % 4 == 1)])
    if not data:
        return None
    if nested:
        inner = next(_spans(data.decode("latin-1"), depth - 1), None) if depth > 1 else None
        return (end, f"base64 {inner[3]}") if inner else None
    size = size if der else _openssh(data) or 0
    kind = (_whole_key(data[:size]) if der else "openssh") if 0 < size <= len(data) else None
    if kind is None:
        return None
    need = -(-size * 4 // 3)
    for piece, start in zip(pieces, starts):
        if need <= len(piece):
            stop = start + need
            return stop + len(text[stop:stop + 2]) - len(text[stop:stop + 2].lstrip("=")), f"base64 {kind}"
        need -= len(piece)
    return None


def _spans(text: str, depth: int = DEPTH) -> Iterator[tuple[str, int, int, str]]:
    """Confirmed spans of tokens and keys; those of one kind in order and apart."""
    yield from _tokens(text)
    found = list(_blocks(text)) if "-----BEGIN " in text else []
    yield from found
    at = k = 0
    for m in _RUN.finditer(text):
        while k < len(found) and found[k][2] <= m.start():
            k += 1
        if m.start() < at or k < len(found) and found[k][1] < m.end():
            continue
        hit = _bare(text, m, depth)
        if hit:
            at = hit[0]
            yield "key", m.start(), at, hit[1]


def _credentials(text: str) -> Iterator[tuple[str, int, int, str]]:
    for m in _BASIC.finditer(text):
        data = _decode(m[1]) if len(m[1]) % 4 == 0 else None
        name, colon, password = (data or b"").partition(b":")
        if colon and name and password and data.isascii() and data.decode().isprintable():
            yield "basic", m.start(1), m.end(1), "name:password"


def find(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, detail) of every secret of a text, by start, then kind as listed."""
    out = [("assign", *m.span(), m[1].lower()) for m in _ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    out += [("access", *m.span(), "") for m in _ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    out += [("hex", *m.span(), "") for m in _HEX.finditer(text)]
    out += [*_spans(text), *_credentials(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


_FIELDS = ("kind", "start", "end", "detail")
_SPANS = T.ArrayType(T.StructType([T.StructField(f, T.IntegerType() if f in ("start", "end") else T.StringType()) for f in _FIELDS]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("detail", pa.string())]))


@F.arrow_udf(_SPANS)
def _find(texts: pa.Array) -> pa.Array:
    return pa.array([[dict(zip(_FIELDS, s)) for s in find(t.as_py() or "")] for t in texts], _ARROW)


@F.arrow_udf(T.StringType())
def _redact(texts: pa.Array) -> pa.Array:
    return pa.array([redacted(t.as_py()) if t.is_valid else None for t in texts], pa.string())


def redacted(text: str) -> str:
    """The text with every secret replaced by its kind; of overlapping ones the kind of the first stays."""
    out, at = [], 0
    for kind, start, end, _ in find(text):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and ``secrets``, an array of (kind, start, end, detail), of every document."""
    return docs.select("doc_id", _find("text").alias("secrets"))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every secret in their texts replaced by its kind, all columns kept."""
    return docs.select(*[_redact("text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE))
    return scan(docs).select("doc_id", *map(of, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))
