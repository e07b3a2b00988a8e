import base64
import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from quarrylane.llm import secret_scan

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PRIMES = (2**127 - 1, 2**89 - 1)


def der(tag, *parts):
    body = b"".join(parts)
    size = bytes([len(body)]) if len(body) < 128 else bytes([0x80 | (n := (len(body).bit_length() + 7) // 8)]) + len(body).to_bytes(n, "big")
    return bytes([tag]) + size + body


def number(x):
    return der(2, x.to_bytes(x.bit_length() // 8 + 1, "big"))


def rsa(wrong=0):
    p, q = PRIMES
    return der(0x30, number(0), number(p * q + wrong), number(65537), *[number(x) for x in (12345678901, p, q, 5, 7, 11)])


def ec():
    return der(0x30, number(1), der(4, bytes(range(32))), der(0xA0, der(6, bytes.fromhex("2a8648ce3d030107"))), der(0xA1, der(3, b"\0\4" + bytes(64))))


def wrapped(oid, inner):
    return der(0x30, number(0), der(0x30, der(6, bytes.fromhex(oid)), der(5)), der(4, inner))


def openssh(checks=b"abcdabcd"):
    s = lambda x: len(x).to_bytes(4, "big") + x
    return b"openssh-key-v1\0" + s(b"none") + s(b"none") + s(b"") + (1).to_bytes(4, "big") + s(s(b"ssh-ed25519") + s(bytes(32))) + s(checks + bytes(range(64)))


def packet():
    body = b"\4" + bytes(4) + b"\1" + b"\0\x10\xff\xff" + b"\0\x11\1\0\1" + b"\0" + bytes(range(20))
    return bytes([0xC5, len(body)]) + body


def b64(x):
    return base64.b64encode(x).decode()


def url(x):
    return base64.urlsafe_b64encode(x if isinstance(x, bytes) else json.dumps(x).encode()).decode().rstrip("=")


def lines(x, n=64, sep="\n"):
    return sep.join(x[i : i + n] for i in range(0, len(x), n))


def jwt(alg="HS256", size=32):
    return f"{url({'alg': alg, 'typ': 'JWT'})}.{url({'sub': 'x'})}.{url(bytes(range(size)))}"


def kinds(text):
    return [(k, text.encode()[a:b].decode(), w) for k, a, b, w in secret_scan.confirmed(text.encode())]


@pytest.mark.parametrize(
    "raw, what",
    [
        (rsa(), "rsa-216"),
        (ec(), "ec-256"),
        (wrapped("2a864886f70d010101", rsa()), "rsa-216"),
        (wrapped("2a8648ce3d0201", ec()), "ec-256"),
        (wrapped("2b6570", der(4, bytes(range(32)))), "curve-256"),
        (wrapped("2a8648ce380401", number(2**150 + 7)), "number"),
        (der(0x30, der(0x30, der(6, bytes.fromhex("2a864886f70d01050d")), der(0x30, der(5))), der(4, bytes(40))), "encrypted"),
        (der(0x30, number(0), number(23 * 2 + 1), number(23), number(4), number(9), number(5)) + b"", None),
        (openssh(), "openssh ssh-ed25519"),
        (packet(), "openpgp-1"),
    ],
)
def test_key_encodings(raw, what):
    if what is None:  # too short to be told from chance
        assert secret_scan.private_key(raw) is None
        return
    for text in (b64(raw), raw.hex(), raw.hex().upper(), lines(b64(raw)), lines(b64(raw), sep="\r\n  "), lines(b64(raw), sep="\\n"), lines(raw.hex(), 32)):
        if len(text) > 64 or "\n" not in text:
            whole = f"before {text} after"
            assert kinds(whole) == [("key", text, what)], text
    # A length that is one off, a cut and a changed first byte confirm nothing.
    for bad in (raw[:-1], bytes([raw[0] ^ 1]) + raw[1:], raw[:1] + bytes([raw[1] ^ 64]) + raw[2:]):
        assert secret_scan.private_key(bad) is None
    # What follows the key is not part of the span.
    assert kinds(f"{raw.hex()}00")[0][1] == raw.hex()


def test_what_is_not_secret_is_left():
    public = der(0x30, der(0x30, der(6, bytes.fromhex("2a864886f70d010101")), der(5)), der(3, b"\0" + der(0x30, number(2**200 + 1), number(65537))))
    for raw in (rsa(wrong=1), public, openssh(b"abcdabce"), bytes(64), b"plain text that is only encoded, nothing more"):
        assert kinds(f"x {b64(raw)} y {raw.hex()}") == []


def test_signed_tokens():
    good = [jwt(), jwt("RS256", 256), jwt("ES512", 132), jwt("EdDSA", 64)]
    sealed = ".".join([url({"alg": "RSA-OAEP", "enc": "A256GCM"}), url(b"k" * 40), url(b"v" * 12), url(b"cipher"), url(b"t" * 16)])
    for t in (*good, sealed):
        assert [x[:2] for x in kinds(f"Bearer {t}, and")] == [("jwt", t)]
    bad = [jwt("HS256", 31), jwt("none", 0), jwt("XX", 32), f"{url({'typ': 'JWT', 'x': 1})}.{url({})}.{url(bytes(32))}", f"{url({'alg': 'HS256'})}.{url(b'[1]')}.{url(bytes(32))}"]
    assert [kinds(t) for t in bad] == [[]] * 5


def test_encoded_text_is_looked_into():
    pem = f"-----BEGIN RSA PRIVATE KEY-----\n{lines(b64(rsa()))}\n-----END RSA PRIVATE KEY-----\n"
    assert [k for k, _, _ in kinds(pem)] == ["key"]
    for inner, kind in ((pem, "key"), (f"t: {jwt()}", "jwt"), (json.dumps({"kty": "oct", "k": "x" * 43}), "key"), (b64(pem.encode()), "key")):
        code = b64(inner.encode())
        assert [(k, t) for k, t, _ in kinds(f"data: {code} end")] == [(kind, code.rstrip("="))]


def test_long_inputs_take_linear_time():
    line = "MIIa" + "b" * 60
    for text in ("\n".join([line] * 20_000), "eyJh.eyJh." * 100_000, "30" * 500_000, jwt() * 5_000):
        secret_scan.byte_spans(text.encode())


def plain(text):
    """The base spans by the plain patterns on whole texts."""
    text, out = text or "", []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if m[0].isascii() and len(m[2]) >= 12:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(k, a, b) for a, _, b, k in sorted(out)]


def test_query_equals_plain_patterns(spark, tmp_path):
    rng = random.Random(5)
    pieces = ["token = ", 'API_KEY: "', "apikey='", "Password=", "secret", "==", " ", "é", "ß🙂", "\n", "AKIA", "AKIAAKIA", "ABCDEFGHIJKLMNOP12", "0123456789abcdef", "deadbeef", "xyz.=-_/+", "passwd :=", "'", "ſecret=abcdefabcdef"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 40)))) for i in range(400)]
    rows += [(400, None), (401, ""), (402, "é" * 50_000 + " token=abcdefabcdef " + jwt()), (None, "token=abcdefabcdef"), (7, "token=abcdefabcdef"), (7, "token=abcdefabcdef")]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secret_scan.op11_secret_scan(spark, str(tmp_path)).collect())
    want = []
    for i, t in rows:
        p = plain(t)
        code = ",".join(f"{k}:{a}:{b}" for k, a, b in p)
        want.append((i is None, i or 0, *[sum(x[0] == k for x in p) for k in secret_scan.BASE_KINDS], hashlib.sha256(code.encode()).hexdigest()))
    assert got == sorted(want)
    last = secret_scan.op11_secret_scan(spark, str(tmp_path)).where("doc_id = 402").first()
    assert last.spans.split(",")[1] == f"jwt:{50_000 + 20}:{50_000 + 20 + len(jwt())}"


def test_scan_of_odd_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert secret_scan.secret_scan(none).count() == 0 and secret_scan.redacted(none).count() == 0
    docs = spark.createDataFrame([(1, f"a token=abcdefabcdefabcd {b64(ec())} z", 5), (None, None, 6)], "doc_id int, text string, kind long").withColumn("spans", F.lit(1))
    assert [[s.kind for s in r.spans] for r in secret_scan.secret_scan(docs).orderBy("doc_id").collect()] == [[], ["assign", "hex", "key"]]
    left = secret_scan.redacted(docs).orderBy("doc_id").collect()
    assert [tuple(r) for r in left] == [(None, None, 6, 1, 0), (1, "a [assign] [key] z", 5, 1, 2)]
