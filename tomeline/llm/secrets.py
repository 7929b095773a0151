"""Secret scans with structural confirmation.

Three base kinds are plain patterns. Further candidates (base64, hex, signed tokens, armoured keys)
are decoded and reported only if what comes out has the structure of a key: DER values whose nested
lengths add up (they also say where a value that is broken over lines ends), the length-prefixed fields
of an SSH key, a signed token whose header names its algorithm and whose claims are an object, or an
armoured body whose header lines name its cipher.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

#: In the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "der", "jwt", "pem", "ssh")

# Letters in either case are ASCII letters: without re.A, "ſ" would count as an "s".
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*\.[A-Za-z0-9_-]*(?:\.[A-Za-z0-9_-]*\.[A-Za-z0-9_-]*)?")
_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*(?:PRIVATE|PUBLIC) KEY)-----((?:\s*[A-Za-z0-9-]+: [^\n]*\n)*)((?:[A-Za-z0-9+/=\s]|\\[rn])+)-----END \1-----")
#: White space of an armoured body, line ends escaped as in JSON included.
_BETWEEN = re.compile(r"(?:\s|\\[rn])+")
_CIPHER = re.compile(r"^\s*DEK-Info: ([A-Z0-9-]+),((?:[0-9A-Fa-f]{2})+)\s*$", re.M)
# Base64 of either alphabet that begins like a SEQUENCE, and what follows it on further lines.
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])M[A-Za-z0-9+/_-]{19,}(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]{4,})*={0,2}")
_HEX_DER = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{38,}")
_SSH = re.compile(r"(?<![A-Za-z0-9+/])(?:AAAA[A-Za-z0-9+/]{40,}|b3BlbnNzaC1rZXktdjE[A-Za-z0-9+/]{20,})={0,2}")

#: Every text with a span matches this; RE2 runs it over a whole column. Its \\x20* and case folding let more pass than the patterns do.
_SCREEN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]|[0-9a-f]{16}|eyJ[A-Za-z0-9_-]+\.|-----BEGIN |M[A-Za-z0-9+/_-]{19}|30[0-9A-Fa-f]{38}|AAAA[A-Za-z0-9+/]{40}|b3BlbnNzaC1rZXktdjE"""


def _der_head(data: bytes, at: int, end: int) -> tuple[int, int] | None:
    """Where the contents of the DER value at ``at`` begin and end, if its length is in the shortest form and leaves it before ``end``."""
    if end - at < 2:
        return None
    tag, size = data[at], data[at + 1]
    at += 2
    if tag & 0x1F == 0x1F or size == 0x80:
        return None
    if size > 0x80:
        n = size & 0x7F
        if n > 4 or at + n > end:
            return None
        size = int.from_bytes(data[at : at + n], "big")
        at += n
        if size < 0x80 or size >> 8 * (n - 1) == 0:
            return None
    return (at, at + size) if at + size <= end else None


def _der_tags(data: bytes) -> list[int] | None:
    """The tags of a run of DER values that fills the data exactly, nested ones included; None if lengths do not add up.

    A constructed value is entered, not recursed into, so that any depth is read; each step takes a
    head of two bytes at least.
    """
    tags, at, ends = [], 0, [len(data)]
    while True:
        while ends and at == ends[-1]:
            ends.pop()
        if not ends:
            return tags
        found = _der_head(data, at, ends[-1])
        if found is None:
            return None
        tags.append(data[at])
        at, end = found
        if tags[-1] & 0x20:
            ends.append(end)
        else:
            at = end


def is_der_key(data: bytes) -> bool:
    """One SEQUENCE that holds integers, object identifiers or key strings, all lengths adding up; no signature of two integers."""
    if len(data) < 16 or data[0] != 0x30 or (head := _der_head(data, 0, len(data))) is None or head[1] != len(data):
        return False
    tags = _der_tags(data)
    if tags == [0x30, 0x02, 0x02]:  # modulus and exponent make a key; two numbers of a size are a signature
        first = _der_head(data, head[0], len(data))
        second = _der_head(data, first[1], len(data))
        return first[1] - first[0] >= 64 and second[1] - second[0] <= 8 and data[second[1] - 1] & 1 == 1
    return tags is not None and len(tags) >= 3 and any(not t & 0x20 for t in tags) and any(t in (0x02, 0x03, 0x04, 0x06) for t in tags)


def _fields(data: bytes, at: int, most: int | None = None) -> tuple[list[bytes], int] | None:
    """Length-prefixed fields from ``at`` on, all or the first ``most``, and where they end; None if a length passes the end."""
    found: list[bytes] = []
    while (at < len(data)) if most is None else (len(found) < most):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        found.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return found, at


def _is_public_blob(data: bytes) -> bool:
    """Fields that fill the data, the first naming a key type."""
    found = _fields(data, 0)
    return found is not None and len(found[0]) >= 2 and re.match(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]+$", found[0][0]) is not None


def is_ssh_key(data: bytes) -> bool:
    """A public key, or ``openssh-key-v1``: names of cipher and derivation, its options, as many public keys as announced and one private part, to the end."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return _is_public_blob(data)
    head = _fields(data, len(magic), 3)
    if head is None or head[1] + 4 > len(data) or not all(re.match(rb"[a-z0-9@.-]+$", x) for x in head[0][:2]):
        return False
    n, at = int.from_bytes(data[head[1] : head[1] + 4], "big"), head[1] + 4
    if not 0 < n <= len(data):
        return False
    keys = _fields(data, at, n + 1)
    return keys is not None and keys[1] == len(data) and all(map(_is_public_blob, keys[0][:-1])) and len(keys[0][-1]) >= 8


def _decoded(text: str, url: bool = False) -> bytes:
    text = text.rstrip("=")
    if len(text) % 4 == 1:
        return b""
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), altchars=b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return b""


def _object(text: str) -> dict | None:
    """The JSON object that base64url text holds, if it does."""
    try:
        found = json.loads(_decoded(text, url=True))
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def is_token(text: str) -> bool:
    """A signed token: a header that names its algorithm, claims, and a signature unless the algorithm is none; or the five parts of an encrypted one."""
    parts = text.split(".")
    head = _object(parts[0])
    if head is None or not isinstance(head.get("alg"), str):
        return False
    if len(parts) == 5:
        return isinstance(head.get("enc"), str) and all(p == "" or _decoded(p, url=True) for p in parts[1:]) and bool(parts[3])
    return len(parts) == 3 and _object(parts[1]) is not None and (bool(_decoded(parts[2], url=True)) or (not parts[2] and head["alg"].lower() == "none"))


def _is_armoured(headers: str, body: bytes) -> bool:
    """A key in the clear, or one whose headers name a cipher and its start value, with whole cipher blocks."""
    if is_der_key(body) or is_ssh_key(body):
        return True
    cipher = _CIPHER.search(headers)
    return cipher is not None and "ENCRYPTED" in headers and len(cipher[2]) in (16, 32) and len(body) >= 16 and len(body) % (len(cipher[2]) // 2) == 0


def _der_end(run: str) -> int | None:
    """How much of a run of base64, line breaks and all, is one DER key: its own length says how many characters it takes."""
    code = [i for i, c in enumerate(run) if not c.isspace() and c != "="]
    plain = "".join(run[i] for i in code)
    url = "-" in plain or "_" in plain
    if url and ("+" in plain or "/" in plain):
        return None
    begin = _decoded(plain[:8], url)
    # The head alone: what it announces lies beyond these bytes.
    size = begin[1] if begin[1] < 0x80 else int.from_bytes(begin[2 : 2 + (begin[1] & 0x7F)], "big") if 0x80 < begin[1] <= 0x84 else None
    if size is None:
        return None
    total = size + 2 + (begin[1] & 0x7F if begin[1] > 0x80 else 0)
    need = (total * 8 + 5) // 6
    if need > len(code) or not is_der_key(_decoded(plain[:need], url)):
        return None
    end = code[need - 1] + 1
    while end < len(run) and run[end] == "=":
        end += 1
    return end if end == len(run) or run[end].isspace() else None


def spans_of(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all secrets, in code points, by start and then in the order of KINDS."""
    found = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end() - m.start(2) >= 12]
    found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    found += [(m.start(), m.end(), "jwt") for m in _JWT.finditer(text) if is_token(m[0])]
    armoured = [(m.start(), m.end(), "pem") for m in (_PEM.finditer(text) if "-----BEGIN " in text else ()) if _is_armoured(m[2], _decoded(_BETWEEN.sub("", m[3])))]
    der = [(m.start(), m.start() + end, "der") for m in _BASE64.finditer(text) if (end := _der_end(m[0])) is not None]
    found += armoured + [d for d in der if not any(a <= d[0] < b for a, b, _ in armoured)]
    found += [(m.start(), m.end(), "der") for m in _HEX_DER.finditer(text) if len(m[0]) % 2 == 0 and is_der_key(bytes.fromhex(m[0]))]
    found += [(m.start(), m.end(), "ssh") for m in _SSH.finditer(text) if is_ssh_key(_decoded(m[0])) and not any(a <= m.start() < b for a, b, _ in armoured)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def masked(text: str, spans: list[tuple[int, int, str]], mask: str) -> str:
    """The text with each secret, overlapping ones together, replaced by the mask."""
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _scan(mask: str | None, keep: Sequence[str]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.pieces(batches, 1):
            text = batch.column(1).cast(pa.large_string())
            maybe = pc.fill_null(pc.match_substring_regex(text, _SCREEN), False).to_numpy(zero_copy_only=False)
            found = [spans_of(text[i].as_py()) if m else [] for i, m in enumerate(maybe)]
            counts = [pa.array([sum(s[2] == k for s in f) for f in found], pa.int64()) for k in KINDS[:3]]
            base = [hashlib.sha256(listed([s for s in f if s[2] in KINDS[:3]]).encode()).hexdigest() for f in found]
            columns = [batch.column(0), *counts, pa.array(base, pa.string()), pa.array([listed(f) for f in found], pa.string())]
            if mask is not None:
                columns.append(pc.if_else(pa.array([bool(f) for f in found], pa.bool_()), pa.array([masked(text[i].as_py(), f, mask) if f else None for i, f in enumerate(found)], pa.large_string()), text).cast(pa.string()))
            columns += [batch.column(c) for c in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, names=[*_NAMES, *(["masked"] if mask is not None else []), *(["kept"] if keep else [])])

    return scan


_NAMES = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256 and spans; ``mask`` adds masked, the text with its secrets replaced; and, as a struct, kept: the columns of ``keep``.

    Spans are ``kind:start:end`` in code points, comma-joined by start; base_sha256 digests those of
    the three base kinds. A null or empty text has no spans: zeros, the digest of the empty string and
    an empty list (its masked text is null or empty likewise). doc_id may be null and may repeat; rows
    are judged one by one. Other columns are ignored.
    """
    # A struct keeps names that clash with this operator's own apart.
    kept = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept")] if keep else []
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *kept)
    kinds = dict(rows.dtypes)
    schema = [f"doc_id {kinds['doc_id']}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"]
    schema += (["masked string"] if mask is not None else []) + ([f"kept {kinds['kept']}"] if keep else [])
    return rows.mapInArrow(_scan(mask, keep), ", ".join(schema))
