"""Secrets in texts: patterns, and candidates whose decoded structure confirms them."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
JWT = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}={0,2}")
ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}(?:KEY|KEY BLOCK))-----")
HEX_ANY = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){32,}(?![0-9A-Fa-f])")
#: Kinds in the order of the report; the first three are the base.
KINDS = ("assign", "access", "hex", "jwt", "armour", "der", "ssh")
#: Line ends written as a backslash and a letter, as in JSON.
ESCAPED_END = re.compile(r"\\+[nr]")
ENCRYPTED = re.compile(r"Proc-Type:\s*4,\s*ENCRYPTED")
CIPHER = re.compile(r"DEK-Info:\s*[A-Z0-9-]+,\s*([0-9A-Fa-f]+)\s*\Z")
CHECKSUM = re.compile(r"=[A-Za-z0-9+/]{4}")
OPENSSH = b"openssh-key-v1\0"
SSH_NAME = re.compile(rb"(?:ssh-(?:rsa|dss|ed25519|ed448)|ecdsa-sha2-[a-z0-9-]+|sk-[a-z0-9@.-]+)\Z")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def decoded(text: str) -> bytes | None:
    """Bytes of base64 text in either alphabet, with or without padding; None if it is none."""
    plain = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(plain) % 4 == 1:
        return None
    try:
        return base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_der(data: bytes) -> bool:
    """A private key: a DER sequence that fills the data, whose nested lengths all fit.

    It begins with a version number (PKCS 1 and 8, SEC 1), as public keys and certificates do not, or with an
    algorithm and an octet string only (encrypted PKCS 8); and it holds an integer or a bit or octet string of 16 bytes or more.
    """
    if len(data) < 24 or data[0] != 0x30:
        return False
    stack, at, material, ended, outer = [len(data)], 0, False, 0, []
    while stack:
        if at == stack[-1]:
            stack.pop()
            continue
        if at + 2 > stack[-1]:
            return False
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > stack[-1] or data[at] == 0:
                return False
            size = int.from_bytes(data[at:at + n], "big")
            at += n
            if size < 0x80:
                return False
        if at + size > stack[-1]:
            return False
        if len(stack) == 1:
            ended += 1
        elif len(stack) == 2:
            outer.append((tag, size))
        kind = tag & 0x1F
        if kind == 0 and tag < 0x80:
            return False
        if tag & 0x20:
            stack.append(at + size)
        else:
            material |= tag in (2, 3, 4) and size >= 16
            at += size
    tags = [tag for tag, _ in outer]
    # A version is one byte; a bare pair of integers is a public key, a signature or nothing.
    private = outer[:1] == [(2, 1)] and (len(tags) >= 3 or tags[1:] == [4]) or tags == [0x30, 4]
    return ended == 1 and material and private


def is_ssh(data: bytes) -> bool:
    """An OpenSSH private key: cipher, derivation and its options, the number of keys, so many public keys, and the
    private part, each of the stated length, that fill the data. Each public key begins with the name of a key type."""
    if not data.startswith(OPENSSH):
        return False
    at = len(OPENSSH)

    def field() -> bytes | None:
        nonlocal at
        start, at = at + 4, at + 4 + int.from_bytes(data[at:at + 4], "big")
        return data[start:at] if start <= at <= len(data) else None
    head = [field() for _ in range(3)]
    if None in head or not head[0] or not head[1]:
        return False
    many, at = int.from_bytes(data[at:at + 4], "big"), at + 4
    # A key takes four bytes at least, so that the data bound the loop.
    if not 1 <= many <= len(data) // 4:
        return False
    for _ in range(many):
        public = field()
        if public is None or not SSH_NAME.match(public[4:4 + int.from_bytes(public[:4], "big")]):
            return False
    private = field()
    return bool(private) and at == len(data)


def is_encrypted(headers: list[str], data: bytes) -> bool:
    """The body of an encrypted PEM key: its headers say so, and it fills whole blocks as long as the initial vector."""
    vector = next((m[1] for m in map(CIPHER.search, headers) if m), "")
    return (any(map(ENCRYPTED.search, headers)) and len(vector) in (16, 32)
            and len(data) >= 16 and len(data) % (len(vector) // 2) == 0)


def is_openpgp(data: bytes) -> bool:
    """OpenPGP packets that fill the data, the first a secret key of a known version."""
    at, first = 0, None
    while at < len(data):
        head = data[at]
        at += 1
        if head & 0xC0 == 0xC0:
            tag, n = head & 0x3F, data[at] if at < len(data) else 255
            width = 1 if n < 192 else 2 if n < 224 else 5 if n == 255 else 0
            if not width or at + width > len(data):
                return False
            size = n if width == 1 else ((n - 192) << 8) + data[at + 1] + 192 if width == 2 else int.from_bytes(data[at + 1:at + 5], "big")
        elif head & 0x80 and head & 3 != 3:
            tag, width = head >> 2 & 0x0F, 1 << (head & 3)
            if at + width > len(data):
                return False
            size = int.from_bytes(data[at:at + width], "big")
        else:
            return False
        at += width
        if tag == 0 or at + size > len(data):
            return False
        if first is None:
            first = tag
            if tag != 5 or size < 12 or data[at] not in (2, 3, 4, 5, 6):
                return False
        at += size
    return first is not None


def is_token(text: str) -> bool:
    """A signed token: its header is JSON with an algorithm, its claims a JSON object."""
    head, body, _ = text.split(".", 2)
    parts = [decoded(head), decoded(body)]
    try:
        header, claims = (json.loads(p) if p else None for p in parts)
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(claims, dict)


def structural_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    if "eyJ" in text:
        found += [(m.start(), m.end(), "jwt") for m in JWT.finditer(text) if is_token(m[0])]
    end = 0
    if "-----BEGIN " in text:
        starts = [m for m in ARMOUR.finditer(text) if "PUBLIC" not in m[1]]
        for m in starts:
            if m.start() < end:
                continue
            # No further than the next beginning, so that the text is passed over once.
            following = text.find("-----BEGIN ", m.end())
            close = f"-----END {m[1]}-----"
            upto = text.find(close, m.end(), following if following >= 0 else len(text))
            if upto < 0:
                continue
            # Header lines hold a colon, base64 never does.
            lines = [x.strip() for x in ESCAPED_END.sub("\n", text[m.end():upto]).splitlines()]
            headers = [x for x in lines if ":" in x]
            body = [x for x in lines if ":" not in x and not CHECKSUM.fullmatch(x)]
            data = decoded("".join("".join(body).split()))
            if data and (is_der(data) or is_ssh(data) or is_encrypted(headers, data) or m[1].startswith("PGP ") and is_openpgp(data)):
                end = upto + len(close)
                found.append((m.start(), end, "armour"))
    for m in BASE64.finditer(text):
        data = decoded(m[0])
        if data:
            found += [(m.start(), m.end(), kind) for kind, check in (("der", is_der), ("ssh", is_ssh)) if check(data)]
    for m in HEX_ANY.finditer(text):
        data = bytes.fromhex(m[0])
        found += [(m.start(), m.end(), kind) for kind, check in (("der", is_der), ("ssh", is_ssh)) if check(data)]
    return list(dict.fromkeys(found))


def listed(spans: list[tuple[int, int, str]]) -> str:
    order = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in order)


def find_secrets(text_col: str = "text") -> Column:
    """struct of the counts, the base spans' digest and all spans of each text (code points, end exclusive).

    Null and empty texts have none: counts 0, the digest of the empty string, no spans. A
    candidate that the structure confirms is added even where a base span covers it.
    Candidates are decoded whole, whatever their length, each once.
    """
    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            base = base_spans(text) if text else []
            kinds = [k for _, _, k in base]
            more = structural_spans(text) if text else []
            rows.append((*(kinds.count(k) for k in KINDS[:3]),
                         hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + more)))
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])
    return of(F.col(text_col).cast("string"))


def redact(text: str, spans: str, mask: str = "[SECRET]") -> str:
    """The text with every listed span replaced; overlapping spans become one mask."""
    cuts = sorted(tuple(map(int, s.split(":")[1:])) for s in spans.split(",") if s)
    out, at = [], 0
    for start, end in cuts:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])
