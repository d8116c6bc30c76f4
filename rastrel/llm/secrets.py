"""Secret scan with structural confirmation.

Base spans come from three patterns (``assign``, ``access``, ``hex``). Candidates written in base64
or hex are then decoded and parsed; one is reported only if its structure holds all the way:

* ``jwt``: header and claims decode to JSON objects, and the header names an algorithm;
* ``pem``: an armoured block whose body decodes to a private key encoding;
* ``key``: a private key encoding in bare base64, wrapped into lines or not, or in hex of either case.

A private key encoding is DER whose nested lengths fill their parents exactly and whose shape is
PKCS#1, PKCS#8, SEC1 or encrypted PKCS#8, or an OpenSSH container whose length-prefixed fields end
at its end. Every text is scanned whole, in time in proportion to its length (a run of base64 is decoded
once for each of its four alignments, however many keys may begin in it); positions are code points.

Defined cases: null and empty texts have no spans (masking leaves them as they are); spans of two kinds
may overlap, and masking merges them; repeated rows are scanned each; an empty table gives an empty
result; other columns, whatever their names, are not read and come back from masking as they were.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_slices

KINDS = ("assign", "access", "hex", "jwt", "pem", "key")
# The patterns of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a run of at least 20: the same matches as the open pattern, filtered
HEX = re.compile(r"[0-9a-f]{24,}")
_NAMES = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")

_DOTTED = re.compile(r"[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]*+)++")
_BEGIN = re.compile(r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----")
_ARMOUR = re.compile(r"[A-Za-z0-9+/=\s\\:,-]*+")
_B64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}+(?:\r?\n[A-Za-z0-9+/_-]++)*+={0,2}")
_LINE = re.compile(r"[A-Za-z0-9+/_-]++")
_ANY_HEX = re.compile(r"[0-9A-Fa-f]{24,}+")
_KEY_START = re.compile(r"M[C-I]|b3BlbnNzaC1rZXktdjE")


def _der(data: bytes, at: int, end: int, depth: int = 0) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the elements that fill data[at:end] exactly, or None."""
    out = []
    while at < end:
        if end - at < 2 or depth > 16:
            return None
        tag, length, at = data[at], data[at + 1], at + 2
        if length & 0x80:
            n = length & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                return None
            length, at = int.from_bytes(data[at : at + n], "big"), at + n
        if at + length > end:
            return None
        if tag & 0x20 and _der(data, at, at + length, depth + 1) is None:
            return None
        out.append((tag, at, at + length))
        at += length
    return out


def _ssh_fields(data: bytes, at: int, n: int) -> int | None:
    """Position after ``n`` length-prefixed fields."""
    for _ in range(n):
        if at + 4 > len(data):
            return None
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        if at > len(data):
            return None
    return at


def key_length(data: bytes, at: int = 0) -> int | None:
    """How long the private key encoding at ``at`` says it is; None where none begins or it is cut off."""
    if data.startswith(_SSH, at):
        end = _ssh_fields(data, at + len(_SSH), 3)
        if end is None or end + 4 > len(data):
            return None
        keys = int.from_bytes(data[end : end + 4], "big")
        end = _ssh_fields(data, end + 4, keys + 1) if 1 <= keys <= 16 else None
        return end and end - at
    head = data[at : at + 6]
    if len(head) < 6 or head[0] != 0x30:
        return None
    n = head[1] & 0x7F if head[1] & 0x80 else 0
    if n > 4 or head[1] == 0x80:
        return None
    end = at + 2 + n + (int.from_bytes(head[2 : 2 + n], "big") if n else head[1])
    # the first element is a version or an algorithm
    return end - at if end <= len(data) and data[at + 2 + n : at + 3 + n] in (b"\x02", b"\x30") else None


def is_private_key(data: bytes) -> bool:
    """Whether the bytes are, from first to last, one private key encoding."""
    if data.startswith(_SSH):
        return key_length(data) == len(data)
    top = _der(data, 0, len(data)) if data[:1] == b"\x30" else None
    if not top or len(top) != 1:
        return False
    inner = _der(data, top[0][1], top[0][2]) or []
    tags = [t for t, _, _ in inner]
    version = data[inner[0][1] : inner[0][2]] if inner and tags[0] == 2 else None
    if version in (b"\0", b"\1"):
        if len(tags) >= 9 and tags[:9] == [2] * 9:
            return True
        if tags[1:3] == [0x30, 4]:
            return bool((oid := _der(data, inner[1][1], inner[1][2])) and oid[0][0] == 6)
        if version == b"\1" and tags[1:2] == [4]:
            return 16 <= inner[1][2] - inner[1][1] <= 66
    if tags == [0x30, 4]:
        scheme = _der(data, inner[0][1], inner[0][2])
        return bool(scheme and [t for t, _, _ in scheme] == [6, 0x30])
    return False


_SSH = b"openssh-key-v1\0"


def _unbase64(text: str) -> bytes | None:
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _signed_token(text: str) -> bool:
    try:
        parts = text.split(".")
        header, claims = (json.loads(_unbase64(p) or b"") for p in parts[:2])
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(claims, dict) and isinstance(header.get("alg"), str) and (header["alg"] == "none" or len(parts[2]) > 0)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the three base kinds."""
    out = []
    raw = text.encode("utf-8", "surrogatepass").lower()
    if any(name in raw for name in _NAMES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"akia" in raw:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _tokens(text: str) -> list[tuple[int, int]]:
    """Signed tokens: in each run of dotted parts, from left to right and without overlap.

    A header begins with its part, or at the first ``eyJ`` in it where other letters stand before.
    """
    out = []
    for run in _DOTTED.finditer(text):
        parts = run[0].split(".")
        at, i = run.start(), 0
        while i + 2 < len(parts):
            found = None
            for cut in dict.fromkeys((0, parts[i].find("eyJ"))):
                if cut >= 0 and parts[i][cut : cut + 1] == "e" and parts[i + 1] and _signed_token(".".join((parts[i][cut:], *parts[i + 1 : i + 3]))):
                    found = cut
                    break
            step = 1 if found is None else 3
            if found is not None:
                out.append((at + found, at + sum(map(len, parts[i : i + 3])) + 2))
            at += sum(map(len, parts[i : i + step])) + step
            i += step
    return out


def _armoured(text: str) -> list[tuple[int, int]]:
    """Armoured private keys: the dashes after a beginning must be those of its own end."""
    out = []
    for m in _BEGIN.finditer(text):
        stop, close = text.find("-----", m.end()), f"-----END {m[1]}-----"
        if stop < 0:
            break
        if not text.startswith(close, stop) or not _ARMOUR.fullmatch(text, m.end(), stop):
            continue
        whole = text[m.end() : stop]
        body = re.sub(r"\\[nr]|\s", "", re.sub(r"(?m)^[A-Za-z-]+:.*$", "", whole))
        data = _unbase64(body) or b""
        if is_private_key(data) or ("Proc-Type" in whole or "DEK-Info" in whole) and len(data) >= 32:
            out.append((m.start(), stop + len(close)))
    return out


def _bare_keys(text: str) -> list[tuple[int, int]]:
    """Private keys in base64 that fill one line or several from beginning to end."""
    out = []
    for run in _B64.finditer(text):
        lines = [(m.start(), m.end()) for m in _LINE.finditer(text, run.start(), run.end())]
        chars = "".join(text[a:b] for a, b in lines).replace("-", "+").replace("_", "/")
        ends = {}  # place in chars after each line: its place in the text
        begins, n = [], 0
        for a, b in lines:
            begins.append((n, a))
            n += b - a
            ends[n] = b
        decoded: dict[int, bytes] = {}
        done = 0
        for place, a in begins:
            if place < done or not _KEY_START.match(text, a):
                continue
            shift = place % 4
            if shift not in decoded:
                whole = chars[shift:]
                whole = whole[: len(whole) - (len(whole) % 4 == 1)]
                decoded[shift] = base64.b64decode(whole + "=" * (-len(whole) % 4))
            data, first = decoded[shift], (place - shift) // 4 * 3
            size = key_length(data, first)
            if size is None:
                continue
            stop = place + (size * 8 + 5) // 6
            if stop in ends and is_private_key(data[first : first + size]):
                b = ends[stop]
                out.append((a, b + len(re.match("={0,2}", text[b : b + 2])[0])))
                done = stop
    return out


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of what decodes and parses as a signed token or a private key."""
    out = [(a, 3, b) for a, b in _tokens(text)] if "." in text else []
    armoured = _armoured(text) if "-----BEGIN " in text else []
    out += [(a, 4, b) for a, b in armoured]
    starts = [a for a, _ in armoured]

    def free(a: int) -> bool:
        i = bisect.bisect_right(starts, a)
        return not i or a >= armoured[i - 1][1]

    out += [(a, 5, b) for a, b in _bare_keys(text) if free(a)]
    for m in _ANY_HEX.finditer(text):
        if len(m[0]) % 2 == 0 and m[0][:2].lower() in ("30", "6f") and free(m.start()) and is_private_key(bytes.fromhex(m[0])):
            out.append((m.start(), 5, m.end()))
    return sorted(out)


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, base and confirmed spans together), each by start, then kind."""
    text = text or ""
    base = base_spans(text)
    return base, sorted(base + confirmed_spans(text))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_report(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, the digest of the base spans, and all spans."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in batch.column("text").to_pylist():
            base, spans = scan(text)
            n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
            rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
        cols = list(zip(*rows, strict=True))
        return pa.record_batch([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return map_slices(docs.select("doc_id", "text"), kernel, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def mask(text: str | None) -> str | None:
    """The text with each stretch of overlapping spans replaced by ``[secret]``."""
    if text is None:
        return None
    spans = scan(text)[1]
    if not spans:
        return text
    merged: list[list[int]] = []
    for a, _, b in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    out, at = [], 0
    for a, b in merged:
        out += [text[at:a], "[secret]"]
        at = b
    return "".join(out) + text[at:]


def mask_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret masked and n_chars, where there is one, recounted; all rows stay."""
    names = docs.columns

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [mask(t) for t in batch.column("text").to_pylist()]
        cols = list(batch.columns)
        cols[names.index("text")] = pa.array(texts, batch.schema.field("text").type)
        if "n_chars" in names:
            was, old = batch.column("text").to_pylist(), batch.column("n_chars").to_pylist()
            cols[names.index("n_chars")] = pa.array([n if a == b else len(b) for a, b, n in zip(was, texts, old, strict=True)], pa.int64())
        return pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return map_slices(docs, kernel, docs.schema)
