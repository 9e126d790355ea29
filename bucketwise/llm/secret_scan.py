"""Secret scan with structural confirmation.

Three patterns give base spans: assignments to secret names, access keys, long hex runs. Beyond them, candidates in
base64 or hex are decoded and reported only if their structure holds:

- ``pem``: a private-key block whose body decodes to a key encoding, its lines broken by line breaks or backslash-n, behind
  header lines or not; a body that its headers name encrypted is of whole cipher blocks;
- ``der``: a base64 or hex run, also wrapped over lines, that decodes to a key: nested lengths fill it to the last byte, as
  PKCS#1, PKCS#8, SEC 1 or DSA lay it out, or length-prefixed fields behind the OpenSSH magic; or to a private-key block or a
  signed token;
- ``jwt``: a signed token whose header decodes to an object with an algorithm and whose payload decodes to an object.

A wrapped run is decoded once, whatever number of its lines could begin a secret. Texts are scanned whole, per task in pieces of bounded size. Defined cases: null text is empty; an empty text has no
spans; ids of any kind, null too, come back as they are; repeated rows are scanned one by one; other columns take no part.
"""

from __future__ import annotations

import base64
import binascii
import codecs
import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from bucketwise.llm.textkit import only, pieces, table

KINDS = ("assign", "access", "hex", "pem", "der", "jwt")
_RANK = {k: i for i, k in enumerate(KINDS)}

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_NAMES = ("passw", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")

_PEM = re.compile(
    r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----"
    r"(?P<head>(?:(?:\\[rnt]|\s)*+[A-Za-z][A-Za-z0-9-]*:[^\r\n\\]*+(?:(?:\\r|\\n|[\r\n])+[ \t]+[^\r\n\\]*+)*)*+)"
    r"(?P<body>(?:[A-Za-z0-9+/=\s]|\\[rnt/])*+)-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----"
)
_SPACES = re.compile(r"\\[rnt]|\s+")
#: runs of base64 as they stand, and the breaks over which one is wrapped
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{31,}={0,2}")
_WRAP = re.compile(r"(?:\\r)?\\n[ \t]*|\r?\n[ \t]*|\r[ \t]*")
_PART = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
_HEX = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{48,}(?![0-9A-Fa-f])")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])e[A-Za-z0-9_-]{9,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")
_TOKEN = re.compile(rb"e[A-Za-z0-9_-]{9,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")
_TOKEN_LETTERS = re.compile(rb"[A-Za-z0-9_-]*+")
_OPENSSH = b"openssh-key-v1\x00"


def decode64(text: str) -> bytes | None:
    """Bytes of standard or URL-safe base64, padded or not; None if it is neither."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes | memoryview) -> list[tuple[int, bytes | memoryview]] | None:
    """(tag, content) of consecutive items that fill ``data`` exactly; None otherwise."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(data):
                return None
            size, at = int.from_bytes(data[at : at + n]), at + n
            if size < 0x80:
                return None
        if at + size > len(data):
            return None
        out.append((tag, data[at : at + size]))
        at += size
    return out


def is_key(data: bytes | memoryview | None) -> bool:
    """A private key by its encoding."""
    if not data:
        return False
    if data[: len(_OPENSSH)] == _OPENSSH:
        return _openssh(data[len(_OPENSSH) :])
    outer = der_items(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    items = der_items(outer[0][1])
    if not items:
        return False
    tags = [t for t, _ in items]
    if tags[0] == 0x30 and tags == [0x30, 0x04]:  # encrypted PKCS#8: algorithm, octets
        return _algorithm(items[0][1])
    if tags[0] != 0x02:
        return False
    if len(tags) >= 9 and set(tags[:9]) == {0x02}:  # PKCS#1: version and eight numbers
        return len(items[1][1]) >= 16
    if tags == [0x02] * 6:  # DSA: version zero, p, q, g, public and private number
        return items[0][1] == b"\x00" and len(items[1][1]) >= 64 and len(items[2][1]) >= 16
    if tags[:3] == [0x02, 0x30, 0x04]:  # PKCS#8: version, algorithm, octets
        return _algorithm(items[1][1])
    return tags[:2] == [0x02, 0x04] and items[0][1] == b"\x01" and len(items[1][1]) >= 16  # SEC 1


def _algorithm(data: bytes | memoryview) -> bool:
    inner = der_items(data)
    return bool(inner) and inner[0][0] == 0x06 and len(inner[0][1]) >= 3


def _openssh(data: bytes | memoryview) -> bool:
    """Cipher, key derivation and its options as fields of stated length, then the number of keys and their fields."""
    at = 0
    for _ in range(3):
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4])
    if at + 4 > len(data):
        return False
    keys, at = int.from_bytes(data[at : at + 4]), at + 4
    for _ in range(min(keys, 64) + 1):
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4])
    return keys >= 1 and at <= len(data)


def _object(text: str) -> dict | None:
    raw = decode64(text)
    try:
        value = json.loads(raw) if raw else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def is_token(text: str) -> bool:
    head, body, signature = text.split(".")
    header = _object(head)
    if not header or not isinstance(header.get("alg"), str) or _object(body) is None:
        return False
    return bool(signature) or header["alg"].lower() == "none"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    low = text.lower()
    if any(n in low for n in _NAMES):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), "hex") for m in _LONG_HEX.finditer(text)]
    return out


def _is_pem(block: re.Match) -> bool:
    data = decode64(_SPACES.sub("", block["body"]).replace("\\/", "/"))
    if "ENCRYPTED" in block["head"]:  # cipher text, of whole blocks
        return bool(data) and len(data) >= 32 and len(data) % 8 == 0
    return is_key(data)


def is_secret(data: bytes | None) -> bool:
    """A key by its encoding, a private-key block or a signed token."""
    if not data:
        return False
    if data[0] == 0x30 or data.startswith(_OPENSSH):
        return is_key(data)
    if b"PRIVATE KEY-----" not in data and b"." not in data:
        return False
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return False
    return any(_is_pem(m) for m in _PEM.finditer(text)) or any(is_token(m[0]) for m in _JWT.finditer(text))


def _wrapped(text: str, first: re.Match) -> list[tuple[int, int]]:
    """[start, end) of the lines that continue a run of base64: all but the last are as long as the first."""
    out, width = [(first.start(), first.end())], first.end() - first.start()
    while out[-1][1] - out[-1][0] == width and text[out[-1][1] - 1] != "=":
        gap = _WRAP.match(text, out[-1][1])
        part = _PART.match(text, gap.end()) if gap else None
        if part is None or part.end() - part.start() > width:
            break
        out.append((part.start(), part.end()))
    return out


def _base64_spans(text: str) -> list[tuple[int, int]]:
    out, done = [], 0
    for m in _BASE64.finditer(text):
        if m.start() < done:
            continue
        # behind a backslash-n the n is not the run's
        if m[0][0] in "rnt" and m.start() and text[m.start() - 1] == "\\":
            m = _BASE64.match(text, m.start() + 1) or _PART.match(text, m.start() + 1)
        if is_secret(decode64(m[0])):
            out.append((m.start(), m.end()))
            continue
        lines = _wrapped(text, m)
        block = _Block(text, lines) if len(lines) > 1 else None
        at = 0
        while block and at < len(lines):
            n = next((n for n in _ends(text, lines, at) if block.is_secret(at, n)), 0)
            if n:
                out.append((lines[at][0], lines[n - 1][1]))
            at = n or at + 1
        done = lines[-1][1] if len(lines) > 1 else 0
    return out


class _Suffixes:
    """What begins at ascending places of decoded bytes and goes to their end; the bytes are read once for all places."""

    def __init__(self, data: memoryview) -> None:
        self.data = data
        self.broken = -1  # no suffix from here or before is text
        self.searched = False  # a suffix that is text was searched and holds no secret
        self.run = -1  # end of the last run of token letters

    def is_secret(self, at: int) -> bool:
        head = bytes(self.data[at : at + len(_OPENSSH)])
        if not head:
            return False
        if head[0] == 0x30 or head == _OPENSSH:
            return is_key(self.data[at:])
        if at <= self.broken:
            return False
        if not self.searched:
            text = self._text(at)
            self.searched = text is not None
            return self.searched and (any(_is_pem(m) for m in _PEM.finditer(text)) or any(is_token(m[0]) for m in _JWT.finditer(text)))
        # searched from an earlier place: only a token that begins right here could be new
        if head[:1] != b"e":
            return False
        if at >= self.run:
            self.run = _TOKEN_LETTERS.match(self.data, at).end()
        token = _TOKEN.match(self.data, at) if self.data[self.run : self.run + 1] == b"." else None
        return token is not None and is_token(token[0].decode())

    def _text(self, at: int) -> str | None:
        """The suffix as text. Pieces grow, so that a fault costs no more than what lies before it."""
        decoder, out, start, size = codecs.getincrementaldecoder("utf-8")(), [], at, 256
        while start < len(self.data):
            end = min(start + size, len(self.data))
            held = len(decoder.getstate()[0])
            try:
                out.append(decoder.decode(self.data[start:end], final=end == len(self.data)))
            except UnicodeDecodeError as fault:
                self.broken = start - held + fault.start
                return None
            start, size = end, size * 2
        return "".join(out)


class _Block:
    """A wrapped run of base64, decoded once for each of the four ways in which lines can begin in a group of signs."""

    def __init__(self, text: str, lines: list[tuple[int, int]]) -> None:
        self.signs = "".join(text[a:b] for a, b in lines).rstrip("=").replace("-", "+").replace("_", "/")
        self.width, self.n_lines = lines[0][1] - lines[0][0], len(lines)
        self.decoded: dict[int, memoryview] = {}
        self.suffixes: dict[tuple[int, int], _Suffixes] = {}

    def is_secret(self, at: int, n: int) -> bool:
        """Do the lines from ``at`` up to ``n`` decode to a secret?"""
        first, end = at * self.width, len(self.signs) if n == self.n_lines else n * self.width
        phase = first % 4
        if (end - first) % 4 == 1 or end <= first:
            return False
        if phase not in self.decoded:
            whole = self.signs[phase:]
            whole = whole[:-1] if len(whole) % 4 == 1 else whole
            self.decoded[phase] = memoryview(base64.b64decode(whole + "=" * (-len(whole) % 4)))
        start, stop = (first - phase) * 3 // 4, (end - phase) * 3 // 4
        if n < self.n_lines - 1:  # a sequence, whose length is stated
            return is_key(self.decoded[phase][start:stop])
        suffixes = self.suffixes.setdefault((phase, n), _Suffixes(self.decoded[phase][:stop]))
        return suffixes.is_secret(start)


def _ends(text: str, lines: list[tuple[int, int]], at: int) -> list[int]:
    """Numbers of the lines behind which a secret that begins with line ``at`` may end; a sequence states its length."""
    first, last = lines[at]
    head = decode64(text[first : first + 8]) or b""
    if len(head) >= 6 and head[0] == 0x30 and head[1] & 0x80 and 1 <= head[1] & 0x7F <= 4:
        n = head[1] & 0x7F
        size = 2 + n + int.from_bytes(head[2 : 2 + n])
    elif len(head) >= 6 and head[0] == 0x30:
        size = 2 + head[1]
    elif at == 0 or text.startswith(("b3BlbnNzaC", "LS0t", "ZXlK"), first):
        return [n for n in (len(lines), len(lines) - 1) if n > at]
    else:
        return []
    signs = -(-size * 4 // 3)
    end = at - (-signs // (last - first))
    return [end] if end <= len(lines) else []


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    if "PRIVATE KEY-----" in text:
        out += [(m.start(), m.end(), "pem") for m in _PEM.finditer(text) if _is_pem(m)]
    starts, ends = [a for a, _, _ in out], [-1, *(b for _, b, _ in out)]
    out += [(a, b, "der") for a, b in _base64_spans(text) if a >= ends[bisect_right(starts, a)]]
    for m in _HEX.finditer(text):
        if len(m[0]) % 2 == 0 and is_secret(bytes.fromhex(m[0])):
            out.append((m.start(), m.end(), "der"))
    out += [(m.start(), m.end(), "jwt") for m in _JWT.finditer(text) if is_token(m[0])]
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], _RANK[s[2]], s[1])))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
    for batch in pieces(batches, "text"):
        out: dict[str, list] = {n: [] for n in names}
        for text in batch.column("text").to_pylist():
            base = base_spans(text or "")
            every = base + confirmed_spans(text or "")
            for k in KINDS:
                out[f"n_{k}"].append(sum(s[2] == k for s in every))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(every))
        kinds = [pa.int64()] * len(KINDS) + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), *(pa.array(out[n], t) for n, t in zip(names, kinds, strict=True))], names=["id", *names]
        )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, a count per kind, base_sha256 and spans (``kind:start:end`` in code points) of every row."""
    rows = only(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return rows.mapInArrow(_scan, f"id {kind}, {counts}, base_sha256 string, spans string")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_pem", "n_der", "n_jwt"
    )
