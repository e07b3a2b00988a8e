"""Secret scan: patterns give candidates, and what base64 or hex hides is reported once its structure
holds: nested lengths of key encodings, headers and signature sizes of signed tokens."""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, table

#: The base patterns, on lower-cased bytes for assignments, and the least sizes of their matches.
ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}")
LEAST_ASSIGNED, LEAST_ACCESS = 12, 18
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "jwt", "key")

#: Shortest run of base64 or hex characters that is looked into.
LEAST_RUN = 16
_RUN = np.zeros(256, bool)
_RUN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")] = True
_BREAK = re.compile(rb"(?:\r?\n|\\r\\n|\\n)[ \t]*")
_ONLY_HEX = re.compile(rb"[0-9a-fA-F]+")
_PRINTABLE = bytes([9, 10, 13, *range(32, 127)])
_TOKEN = re.compile(rb"[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*\.[A-Za-z0-9_-]*(?:\.[A-Za-z0-9_-]*\.[A-Za-z0-9_-]*)?")
#: Bytes of a signature by the algorithm's name; RSA signatures are as long as their key.
SIGNATURES = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES256K": 64, "ES384": 96, "ES512": 132, "EdDSA": 64}
RSA_SIGNATURES = ("RS256", "RS384", "RS512", "PS256", "PS384", "PS512")
#: Object identifiers, as encoded.
RSA_KEYS = (bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a864886f70d01010a"))
EC_KEY = bytes.fromhex("2a8648ce3d0201")
CURVE_KEYS = {bytes.fromhex("2b656e"): 32, bytes.fromhex("2b656f"): 56, bytes.fromhex("2b6570"): 32, bytes.fromhex("2b6571"): 57}
NUMBER_KEYS = (bytes.fromhex("2a8648ce380401"), bytes.fromhex("2a864886f70d010301"))
PASSWORD_SCHEMES = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
OPENSSH = b"openssh-key-v1\0"
#: Longest modulus, in bits, whose factors are multiplied.
MOST_BITS = 1 << 16
INTEGER, BITS, OCTETS, OID, SEQUENCE = 2, 3, 4, 6, 0x30


def element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, stop) of the DER element at a place; None unless its length is definite, as short as
    can be and within `end`."""
    if at + 2 > end:
        return None
    tag, size = data[at], data[at + 1]
    at += 2
    if size >= 0x80:
        n = size & 0x7F
        if not 1 <= n <= 8 or at + n > end:
            return None
        size = int.from_bytes(data[at : at + n], "big")
        if size < 0x80 or size >> (8 * (n - 1)) == 0:
            return None
        at += n
    return (tag, at, at + size) if at + size <= end else None


def elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill at:end, or None where they don't."""
    out = []
    while at < end:
        e = element(data, at, end)
        if e is None:
            return None
        out.append(e)
        at = e[2]
    return out


def _numbers(data: bytes, parts: list[tuple[int, int, int]]) -> list[int] | None:
    if any(t != INTEGER or a == b for t, a, b in parts):
        return None
    return [int.from_bytes(data[a:b], "big", signed=True) for _, a, b in parts]


def _rsa(data: bytes, a: int, b: int) -> str | None:
    parts = elements(data, a, b)
    if not parts or len(parts) < 9 or any(8 * (y - x) > MOST_BITS for _, x, y in parts[:9]):
        return None
    v = _numbers(data, parts[:9])
    if not v or v[0] not in (0, 1) or min(v[1:]) <= 0 or v[4] * v[5] != v[1] or v[2] % 2 == 0:
        return None
    return f"rsa-{v[1].bit_length()}"


def _ec(data: bytes, a: int, b: int) -> str | None:
    parts = elements(data, a, b)
    if not parts or len(parts) < 2 or [p[0] for p in parts[:2]] != [INTEGER, OCTETS] or data[parts[0][1] : parts[0][2]] != b"\1":
        return None
    size = parts[1][2] - parts[1][1]
    if not 16 <= size <= 72:
        return None
    for tag, x, y in parts[2:]:
        inner = elements(data, x, y)
        if not inner or len(inner) != 1 or (tag, inner[0][0]) not in ((0xA0, OID), (0xA0, SEQUENCE), (0xA1, BITS)):
            return None
        if tag == 0xA1 and inner[0][2] - inner[0][1] not in (size + 2, 2 * size + 2):
            return None
    return f"ec-{8 * size}"


def _dsa(data: bytes, a: int, b: int) -> str | None:
    parts = elements(data, a, b)
    if not parts or len(parts) != 6 or any(8 * (y - x) > MOST_BITS for _, x, y in parts):
        return None
    v = _numbers(data, parts)
    if not v or v[0] or min(v[1:]) <= 0 or (v[1] - 1) % v[2] or not v[3] < v[1] > v[4] or v[5] >= v[2]:
        return None
    return f"dsa-{v[1].bit_length()}"


def _wrapped(data: bytes, a: int, b: int) -> str | None:
    """A key behind the identifier of its algorithm, or one encrypted with a password."""
    parts = elements(data, a, b)
    if not parts:
        return None
    tags = [p[0] for p in parts]
    if tags == [SEQUENCE, OCTETS]:
        scheme = elements(data, *parts[0][1:])
        if scheme and len(scheme) == 2 and scheme[0][0] == OID and scheme[1][0] == SEQUENCE and elements(data, *scheme[1][1:]) and parts[1][2] - parts[1][1] >= 8:
            return "encrypted" if data[scheme[0][1] : scheme[0][2]].startswith(PASSWORD_SCHEMES) else None
        return None
    if tags[:3] != [INTEGER, SEQUENCE, OCTETS] or data[parts[0][1] : parts[0][2]] not in (b"\0", b"\1"):
        return None
    kind = elements(data, *parts[1][1:])
    inner = element(data, *parts[2][1:])
    if not kind or kind[0][0] != OID or inner is None or inner[2] != parts[2][2]:
        return None
    name, (tag, x, y) = data[kind[0][1] : kind[0][2]], inner
    if name in RSA_KEYS and tag == SEQUENCE:
        return _rsa(data, x, y)
    if name == EC_KEY and tag == SEQUENCE:
        return _ec(data, x, y)
    if name in CURVE_KEYS and tag == OCTETS and y - x == CURVE_KEYS[name]:
        return f"curve-{8 * (y - x)}"
    return "number" if name in NUMBER_KEYS and tag == INTEGER and y > x else None


def _openssh(data: bytes) -> tuple[str, int] | None:
    at = len(OPENSSH)

    def text(data: bytes, at: int) -> tuple[bytes, int] | None:
        if at + 4 > len(data):
            return None
        stop = at + 4 + int.from_bytes(data[at : at + 4], "big")
        return (data[at + 4 : stop], stop) if stop <= len(data) else None

    read = []
    for _ in range(3):
        if (x := text(data, at)) is None:
            return None
        read.append(x[0])
        at = x[1]
    n, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    name = b""
    if not 1 <= n <= 64:
        return None
    for _ in range(n):
        if (x := text(data, at)) is None or (y := text(x[0], 0)) is None:
            return None
        name, at = y[0], x[1]
    if (x := text(data, at)) is None or len(x[0]) < 8 or len(x[0]) % 8 or not name or name.strip(_PRINTABLE):
        return None
    if read[0] == b"none" and x[0][:4] != x[0][4:8]:
        return None
    return f"openssh {name.decode()}", x[1]


def _packet(data: bytes) -> tuple[str, int] | None:
    """A secret-key packet of an OpenPGP message: its length, version, algorithm and public numbers."""
    first = data[0]
    if first & 0xC0 == 0xC0:
        tag, n = first & 0x3F, data[1]
        at, size = (2, n) if n < 192 else (3, ((n - 192) << 8) + data[2] + 192) if n < 224 else (6, int.from_bytes(data[2:6], "big")) if n == 255 else (0, 0)
    elif first & 0xC0 == 0x80 and first & 3 < 3:
        tag, n = first >> 2 & 15, 1 << (first & 3)
        at, size = 1 + n, int.from_bytes(data[1 : 1 + n], "big")
    else:
        return None
    if tag not in (5, 7) or not at or size < 24 or at + size > len(data) or data[at] != 4:
        return None
    numbers, end = {1: 2, 2: 2, 3: 2, 16: 3, 17: 4}.get(data[at + 5], 0), at + size
    if not numbers:
        return None
    place = at + 6
    for _ in range(numbers):
        bits = int.from_bytes(data[place : place + 2], "big")
        top = data[place + 2] if place + 2 < end else 0
        if not bits or top.bit_length() != (bits - 1) % 8 + 1:
            return None
        place += 2 + (bits + 7) // 8
    return (f"openpgp-{data[at + 5]}", end) if place < end else None


def private_key(data: bytes) -> tuple[str, int] | None:
    """(what it is, bytes it takes) when the bytes begin with a private key whose nested lengths and
    numbers hold together; public keys and certificates are none."""
    if data.startswith(OPENSSH):
        return _openssh(data)
    if len(data) < 32:
        return None
    if data[0] != SEQUENCE:
        return _packet(data)
    top = element(data, 0, len(data))
    if top is None:
        return None
    for form in (_rsa, _ec, _wrapped, _dsa):
        if what := form(data, *top[1:]):
            return what, top[2]
    return None


def _unpacked(chars: bytes) -> bytes:
    """Bytes of the longest decodable start of base64 characters of either alphabet."""
    chars = chars.translate(bytes.maketrans(b"-_", b"+/"))
    chars = chars[: len(chars) - (len(chars) % 4 == 1)]
    return base64.b64decode(chars + b"=" * (-len(chars) % 4))


def _object(chars: bytes) -> dict | None:
    try:
        x = json.loads(_unpacked(chars))
    except (ValueError, RecursionError):
        return None
    return x if isinstance(x, dict) else None


def signed_token(data: bytes, at: int) -> tuple[str, int] | None:
    """(algorithm, end) of the signed or encrypted token at a place: its header is an object that names an
    algorithm, its claims are an object, and the signature (initial value, tag) has that algorithm's size."""
    m = _TOKEN.match(data, at)
    if not m:
        return None
    parts = m[0].split(b".")
    head = _object(parts[0])
    if not head or not isinstance(head.get("alg"), str):
        return None
    if len(parts) == 5 and isinstance(head.get("enc"), str):
        vector, tag = len(_unpacked(parts[2])), len(_unpacked(parts[4]))
        return (f"{head['alg']} {head['enc']}", m.end()) if vector in (12, 16) and tag in (16, 24, 32) and parts[3] else None
    if _object(parts[1]) is None:
        return None
    size = len(_unpacked(parts[2]))
    if head["alg"] in RSA_SIGNATURES and size >= 128 and size % 8 == 0 or size == SIGNATURES.get(head["alg"]):
        return head["alg"], m.start() + sum(map(len, parts[:3])) + 2
    return None


def _json_key(data: bytes) -> str | None:
    if b'"kty"' not in data:
        return None
    try:
        x = json.loads(data)
    except (ValueError, RecursionError):
        return None
    keys = x.get("keys", [x]) if isinstance(x, dict) else []
    for k in keys if isinstance(keys, list) else []:
        secret = k.get("k" if k.get("kty") == "oct" else "d") if isinstance(k, dict) else None
        if isinstance(secret, str) and len(secret) >= 16 and not re.search(r"[^A-Za-z0-9_-]", secret):
            return f"json {k.get('kty')}"
    return None


def _blocks(data: bytes, starts: list[int], ends: list[int]) -> Iterator[list[tuple[int, int]]]:
    """Runs that are the lines of one encoded block: all as long as the first but for the last."""
    i = 0
    while i < len(starts):
        block = [(starts[i], ends[i])]
        i += 1
        while i < len(starts) and block[-1][1] - block[-1][0] == block[0][1] - block[0][0]:
            m = _BREAK.match(data, block[-1][1])
            # A run may begin with the letter of an escaped line break.
            if not m or not starts[i] <= m.end() < ends[i]:
                break
            block.append((m.end(), ends[i]))
            i += 1
        yield block


def _place(block: list[tuple[int, int]], n: int) -> int:
    """The place after the first n characters of a block."""
    for a, b in block:
        if n <= b - a:
            return a + n
        n -= b - a
    return block[-1][1]


def _runs(data: bytes, least: int) -> tuple[list[int], list[int]]:
    own = np.zeros(len(data) + 2, np.int8)
    own[1:-1] = _RUN[np.frombuffer(data, np.uint8)]
    edge = np.diff(own)
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # Shorter last lines of a block count with it.
    keep = b - a >= least
    keep[1:] |= keep[:-1] & (b[1:] - a[1:] >= 1) & (a[1:] - b[:-1] <= 8)
    return a[keep].tolist(), b[keep].tolist()


def confirmed(data: bytes, starts: list[int] | None = None, ends: list[int] | None = None) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, what) of the keys and signed tokens that encoded runs of some bytes hold, also
    inside text that is itself encoded. What is decoded is shorter by a quarter at least, so the work stays
    in proportion to the bytes."""
    if starts is None or ends is None:
        starts, ends = _runs(data, LEAST_RUN)
    out: list[tuple[str, int, int, str]] = []
    done = 0
    for a, b in zip(starts, ends):
        if a >= done and data[a : a + 1] == b"e" and b - a >= LEAST_RUN and (t := signed_token(data, a)):
            out.append(("jwt", a, t[1], t[0]))
            done = t[1]
    tokens = iter([*out, ("", len(data) + 1, len(data) + 1, "")])
    token = next(tokens)
    for block in _blocks(data, starts, ends):
        while token[2] <= block[0][0]:
            token = next(tokens)
        if token[1] <= block[0][0] or block[0][1] - block[0][0] < LEAST_RUN:
            continue
        chars = b"".join(data[a:b] for a, b in block)
        for bits in (4, 6) if _ONLY_HEX.fullmatch(chars) else (6,):
            raw = binascii.unhexlify(chars[: len(chars) // 2 * 2]) if bits == 4 else _unpacked(chars)
            if key := private_key(raw):
                n = -(-8 * key[1] // bits)
                end = _place(block, n)
                if n >= len(chars):
                    end += len(data[end : end + 2]) - len(data[end : end + 2].lstrip(b"="))
                out.append(("key", block[0][0], end, key[0]))
                break
            if len(raw) >= LEAST_RUN and not raw.translate(None, _PRINTABLE):
                inner = ("key", 0, 0, what) if (what := _json_key(raw)) else next(iter(confirmed(raw)), None)
                if inner:
                    out.append((inner[0], block[0][0], block[-1][1], inner[3]))
                    break
    return out


def base_spans(data: bytes, runs: list[tuple[int, int]]) -> list[tuple[str, int, int, str | None]]:
    """The base spans, in bytes; `runs` are places that hold all hex runs of 16 or more."""
    out: list[tuple[str, int, int, str | None]] = [("assign", *m.span(), None) for m in ASSIGN.finditer(data.lower()) if m.end(1) - m.start(1) >= LEAST_ASSIGNED]
    out += [("access", *m.span(), None) for m in ACCESS.finditer(data) if m.end() - m.start() >= LEAST_ACCESS]
    for a, b in runs:
        out += [("hex", *m.span(), None) for m in HEX.finditer(data, a, b)]
    return out


SPANS = "array<struct<kind:string,start:bigint,end:bigint,what:string>>"
_ORDER = {k: i for i, k in enumerate(KINDS)}


def byte_spans(data: bytes) -> list[tuple[str, int, int, str | None]]:
    """All spans of some UTF-8 bytes, in bytes, by start, then kind."""
    starts, ends = _runs(data, LEAST_RUN)
    found = [*base_spans(data, list(zip(starts, ends))), *confirmed(data, starts, ends)]
    return sorted(found, key=lambda s: (s[1], _ORDER[s[0]], s[2]))


def secret_scan(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for each row of docs (doc_id, text), in one pass without a shuffle.

    Spans are of code points, end exclusive, by start, then kind in the order of KINDS: assigned values,
    access keys and hex runs as the patterns have them; `jwt` for signed or encrypted tokens and `key` for
    private keys, both confirmed by structure, with what they are in `what`.  Encoded lines of one length
    count as one block.  Null and empty texts have no spans.  Null ids, repeated rows and other columns do
    no harm.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("what", pa.string())]))
        for batch in batches:
            for part in slices(batch, 1):
                rows = []
                for data in part.column(1).cast(pa.large_binary()).to_pylist():
                    found = byte_spans(data) if data else []
                    if found and not data.isascii():
                        points = np.cumsum(np.frombuffer(data, np.uint8) & 0xC0 != 0x80)
                        found = [(k, int(points[a]) - 1, int(points[b - 1]), w) for k, a, b, w in found]
                    rows.append([{"kind": k, "start": a, "end": b, "what": w} for k, a, b, w in found])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(scan, f"doc_id long, spans {SPANS}")


def redacted(docs: DataFrame) -> DataFrame:
    """docs with `[kind]` in place of each secret (of spans that overlap, the first one's kind in place of
    all of them) and n_secrets, the places replaced.  Null texts stay null; ids may repeat or be null."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                texts, counts = [], []
                for data in part.column(1).cast(pa.large_binary()).to_pylist():
                    out, at, n = [], 0, 0
                    for kind, a, b, _ in byte_spans(data) if data else []:
                        if a >= at:
                            out += [data[at:a], f"[{kind}]".encode()]
                            n += 1
                        at = max(at, b)
                    texts.append(None if data is None else b"".join([*out, data[at:]]).decode("utf-8", "replace"))
                    counts.append(n)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], names=["row", "left", "n"])

    rows = docs.select(F.struct(*docs.columns).alias("row"), docs["text"].cast("string").alias("text"))
    out = rows.mapInArrow(scan, T.StructType([rows.schema["row"], T.StructField("left", T.StringType()), T.StructField("n", T.LongType())]))
    return out.select(*[(F.col("left") if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns], F.col("n").alias("n_secrets"))


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return secret_scan(table(spark, sf_dir, "documents")).select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(_joined(F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS))), 256).alias("base_sha256"),
        _joined(spans).alias("spans"),
    )
