"""Operator 4: secret scan with structural confirmation.

Three plain patterns give the base spans. Beyond them, candidates that look encoded are
decoded and parsed, and reported only if their structure holds: armoured private keys
(their body, without header lines, must be a key, a wrapped encrypted key, or, under header
lines that name cipher and vector, whole blocks), base64,
base64url or hex text that decodes to a DER private key whose nested lengths fill it exactly,
to an OpenSSH key record or to an armoured key, and signed tokens whose header is JSON with
an algorithm. Encoded text may go on over line ends, also over escaped ones as in JSON;
where it ends follows from the lengths in it.

Cases: null text counts as empty; an empty text or table gives no spans or rows; repeated
rows are scanned each; extra columns stay, those with the name of a new one are replaced.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgloom.llm.common import append_columns, named, table

#: In the order in which spans of one start are listed; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "armoured", "key", "signed")
RANK = {kind: k for k, kind in enumerate(KINDS)}

_ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_CUES = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:[^-]|-(?!----))*)-----END \1-----")
_ARMOUR_HEAD = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----")
_HEADER = re.compile(r"[ \t]*[A-Za-z0-9-]+:.*")
_ESCAPED = re.compile(r"(?:\\+r)?\\+n|\\+r")
_WRAP = re.compile(r"\r?\n[ \t]*|(?:\\+r)?\\+n")
_SIX, _FOUR = re.compile(r"[A-Za-z0-9+/_-]*"), re.compile(r"[0-9A-Fa-f]*")
#: Where encoded keys may start: a DER sequence, an OpenSSH record, "-----BEGIN" at its place in a group of three bytes.
_START64 = re.compile(r"(?=M[A-P][A-Za-z0-9+/_-]{6}|b3BlbnNzaC1rZXktdjE|LS0tLS1CRUdJTi|LS0tLUJFR0lOI|LS0tQkVHSU4g)")
_START16 = re.compile(r"(?=30(?:[0-7]|8[1-4])[0-9A-Fa-f]{9}|6[fF]70656[eE]7373682[dD]6|2[dD]2[dD]2[dD]2[dD]2[dD]424547494[eE])")
_CUT_DASHES = {"LS0tLUJF": b"-", "LS0tQkVH": b"--"}
_RUN = re.compile(r"[A-Za-z0-9_-]*")
_JSON = json.JSONDecoder()
_DEK = re.compile(r"DEK-Info:\s*[A-Za-z0-9-]+,\s*[0-9A-Fa-f]{16,}\s*")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each base kind; a match that fails its length test is dropped."""
    found: list[Span] = []
    low = text.lower()
    if any(cue in low for cue in _CUES):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return found


def decoded64(text: str) -> bytes:
    """The bytes of base64 or base64url text with or without padding; empty if it isn't."""
    text = re.sub(r"\s", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except binascii.Error:
        return b""


def elements(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tag and content of consecutive DER elements that fill ``data`` exactly, else None."""
    found, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            width = size & 0x7F
            if not 1 <= width <= 4 or at + width > len(data):
                return None
            size, at = int.from_bytes(data[at : at + width], "big"), at + width
        if at + size > len(data):
            return None
        found.append((tag, data[at : at + size]))
        at += size
    return found


def is_encrypted_key(data: bytes) -> bool:
    """Whether the bytes are a wrapped encrypted key: an algorithm (identifier and parameters) and an octet string."""
    outer = elements(data)
    inner = elements(outer[0][1]) if outer and len(outer) == 1 and outer[0][0] == 0x30 else None
    if not inner or [tag for tag, _ in inner] != [0x30, 0x04]:
        return False
    algorithm = elements(inner[0][1])
    return bool(algorithm) and algorithm[0][0] == 0x06 and len(inner[1][1]) >= 16


def is_private_key(data: bytes) -> bool:
    """Whether the bytes are an RSA, elliptic-curve or wrapped private key, or an OpenSSH key record."""
    if data.startswith(b"openssh-key-v1\0"):
        return record_end(data) is not None
    outer = elements(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    inner = elements(outer[0][1])
    if not inner or len(inner) < 2 or inner[0][0] != 0x02 or len(inner[0][1]) != 1:
        return False
    tags = [tag for tag, _ in inner]
    if tags[:9] == [0x02] * 9:
        return True
    if len(tags) >= 3 and tags[1:3] == [0x30, 0x04]:
        algorithm = elements(inner[1][1])
        return bool(algorithm) and algorithm[0][0] == 0x06
    return tags[1] == 0x04 and inner[0][1] == b"\x01" and len(inner[1][1]) in (20, 24, 28, 32, 48, 66)


def opens_json(text: str, at: int, end: int) -> bool:
    """Whether base64 text from ``at`` to ``end`` may decode to one JSON value; longer and longer starts of it are tried."""
    size = 64
    while size < end - at:
        part = decoded64(text[at : at + size]).decode("latin-1")
        try:
            _, stop = _JSON.raw_decode(part)
        except json.JSONDecodeError as error:
            # an error well before the cut is one of the whole, but for strings, whose place is their start
            if not part or (error.pos < len(part) - 8 and not error.msg.startswith("Unterminated")):
                return False
        except RecursionError:
            return False
        else:
            if part[stop:].strip():
                return False
        size *= 2
    return True


def signed_tokens(text: str) -> Iterator[Span]:
    """Signed tokens: three runs joined by dots, of which the first, from an ``eyJ`` on, and the second decode to JSON objects.

    Each run is walked once, however many starts it has, and a start is decoded only as far as it reads as JSON.
    """
    done = end = middle = last = 0
    at = text.find("eyJ")
    while at >= 0:
        if at >= end:
            end = _RUN.match(text, at).end()
            middle = _RUN.match(text, end + 1).end() if text.startswith(".", end) else end
            last = _RUN.match(text, middle + 1).end() if middle > end + 1 and text.startswith(".", middle) else middle
        if at >= done and end - at >= 11 and last - middle > 16 and opens_json(text, at, end) and is_signed_token(text[at:last]):
            yield ("signed", at, last)
            done = last
        at = text.find("eyJ", at + 1)


def is_signed_token(text: str) -> bool:
    head, body, _ = text.split(".")
    try:
        header, claims = json.loads(decoded64(head)), json.loads(decoded64(body))
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(claims, dict)


def is_armoured_key(m: re.Match) -> bool:
    """Whether the body of an armour, with header lines or escaped line ends, is a key or an encrypted one."""
    lines = _ESCAPED.sub("\n", m.group(2)).replace("\\/", "/").split("\n")
    heads = [line for line in lines if _HEADER.fullmatch(line.rstrip("\r"))]
    body = "\n".join(line for line in lines if line not in heads)
    data = decoded64(body)
    if any("ENCRYPTED" in h for h in heads):
        # enciphered in blocks of eight bytes or more, under the cipher and vector that the header names
        return any(_DEK.fullmatch(h.rstrip("\r")) for h in heads) and len(data) >= 32 and len(data) % 8 == 0
    return is_encrypted_key(data) if "ENCRYPTED" in m.group(1) else is_private_key(data)


def taken(text: str, at: int, size: int, letters: re.Pattern, whole: bool = True) -> tuple[str, int] | None:
    """``size`` encoded letters from ``at`` on over line ends, and their end, None unless a run ends there; or, not ``whole``, up to ``size``."""
    parts, left = [], size
    while True:
        part = letters.match(text, at, min(len(text), at + left + whole))
        if part.end() - at > left:
            return None
        parts.append(part.group())
        left, at = left - len(parts[-1]), part.end()
        wrap = left and _WRAP.match(text, at)
        follows = wrap and letters.match(text, wrap.end(), wrap.end() + 1).group()
        if not follows:
            return ("".join(parts), at) if not (whole and left) else None
        at = wrap.end()


def place_of(text: str, at: int, count: int, letters: re.Pattern) -> int:
    """Where ``count`` encoded letters from ``at`` on end."""
    while True:
        end = letters.match(text, at, min(len(text), at + count)).end()
        count -= end - at
        if count <= 0 or not (wrap := _WRAP.match(text, end)):
            return end
        at = wrap.end()


def bytes_of(letters: str, bits: int) -> bytes:
    if bits == 4:
        return bytes.fromhex(letters[: len(letters) // 2 * 2])
    return decoded64(letters[:-1] if len(letters) % 4 == 1 else letters)


def record_end(data: bytes, known: int | None = None) -> int | None:
    """Where an OpenSSH key record ends: three names, the number of keys, as many public keys, the private part.

    None if it has not that form or does not end within ``known`` bytes (those of the data
    unless given); an end past the data if it may go on there.
    """
    known = len(data) if known is None else known
    at, strings, k = 15, 3, 0
    while k < strings:
        if at + 4 > len(data):
            break
        size = int.from_bytes(data[at : at + 4], "big")
        at += 4 + size
        k += 1
        if k == 3:
            keys = int.from_bytes(data[at : at + 4], "big")
            if at + 4 > len(data):
                break
            if not 1 <= keys <= known // 4:
                return None
            strings += keys + 1
            at += 4
        elif k == strings and (size < 8 or size % 8):
            return None
    if k < strings:
        at = max(at + 4, len(data) + 1)
    return at if at <= known else None


def framed_key(text: str, at: int, lead: bytes, bits: int, letters: re.Pattern) -> int | None:
    """Length in bytes of the OpenSSH record or armoured key that the letters from ``at`` on encode, read no further than it goes; else None."""
    size = 512
    while True:
        got, _ = taken(text, at, size, letters, whole=False)
        data = lead + bytes_of(got, bits)
        more = len(got) == size
        if data.startswith(b"openssh-key-v1\0"):
            end = record_end(data, len(data) + (len(text) - at if more else 0))
            if end is None or end <= len(data):
                return end
        else:
            shown = data.decode("latin-1")
            armour = _ARMOUR.match(shown)
            if armour:
                rest = shown[armour.end() :]
                return armour.end() - len(lead) + len(rest) - len(rest.lstrip()) if is_armoured_key(armour) else None
            head = _ARMOUR_HEAD.match(shown)
            if not head or (shown.find("-----", head.end(), len(shown) - 64) >= 0):
                return None
        if not more:
            return None
        size *= 4


def encoded_keys(text: str, bits: int) -> Iterator[Span]:
    """Private keys as base64 (six bits a letter) or hex (four)."""
    starts, letters = (_START64, _SIX) if bits == 6 else (_START16, _FOUR)
    done = 0
    for m in starts.finditer(text):
        at = m.start()
        if at < done:
            continue
        head = bytes_of(taken(text, at, 16 if bits == 6 else 24, letters, whole=False)[0], bits)
        if head[0] == 0x30:
            width = head[1] & 0x7F if head[1] & 0x80 else 0
            # every private key begins with a version of one byte
            if width > 4 or head[2 + width : 4 + width] != b"\x02\x01":
                continue
            size = 2 + width + (int.from_bytes(head[2 : 2 + width], "big") if width else head[1])
            got = size >= 20 and taken(text, at, -(-size * 8 // bits), letters)
            if not got or not is_private_key(bytes_of(got[0], bits)):
                continue
            end = got[1]
        else:
            size = framed_key(text, at, _CUT_DASHES.get(text[at : at + 8], b""), bits, letters)
            if size is None:
                continue
            end = place_of(text, at, -(-size * 8 // bits), letters)
        if bits == 6:
            end += len(re.match("={0,2}", text[end : end + 2]).group())
        yield ("key", at, end)
        done = end


def confirmed_spans(text: str) -> Iterator[Span]:
    """Candidates whose decoded structure is that of a key or signed token."""
    armoured = []
    if "-----BEGIN" in text:
        armoured = [m.span() for m in _ARMOUR.finditer(text) if is_armoured_key(m)]
        yield from (("armoured", *span) for span in armoured)
    for bits in (6, 4):
        yield from (k for k in encoded_keys(text, bits) if not any(a <= k[1] and k[2] <= b for a, b in armoured))
    yield from signed_tokens(text)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in sorted(spans, key=lambda s: (s[1], RANK[s[0]], s[2])))


def scan(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with base_spans and secret_spans: arrays of kind, start, end (code points, end exclusive)."""

    def make():
        def step(texts):
            base = [base_spans(t or "") for t in texts]
            every = [found + list(confirmed_spans(t or "")) for t, found in zip(texts, base, strict=True)]
            return [[[dict(zip(("kind", "start", "end"), s, strict=True)) for s in sorted(spans, key=lambda s: (s[1], RANK[s[0]], s[2]))] for spans in rows] for rows in (base, every)]

        return step

    kind = "array<struct<kind:string,start:int,end:int>>"
    return append_columns(df, [text_col], f"base_spans {kind}, secret_spans {kind}", make)


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with every secret span of its text replaced by ``[kind]``; overlapping spans by the first one's mark."""

    def make():
        def clean(text):
            if text is None:
                return None
            out, at = [], 0
            for kind, start, end in sorted(base_spans(text) + list(confirmed_spans(text)), key=lambda s: (s[1], RANK[s[0]])):
                if start >= at:
                    out += [text[at:start], f"[{kind}]"]
                at = max(at, end)
            return "".join([*out, text[at:]])

        return lambda texts: [[clean(t) for t in texts]]

    return append_columns(df, [text_col], f"`{text_col}` string", make).select(*named(df.columns))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: counts and digest of the base spans, and the text form of all spans."""
    def text_of(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *(count(kind) for kind in KINDS[:3]),
        F.sha2(text_of("base_spans").cast("binary"), 256).alias("base_sha256"),
        text_of("secret_spans").alias("spans"),
        (F.size("secret_spans") - F.size("base_spans")).cast("long").alias("n_confirmed"),
    )
