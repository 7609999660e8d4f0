"""Secrets in texts, confirmed by the structure of what they decode to.

Three plain patterns (assignments, access ids, hex runs) always report. Beside
them, candidates in base64, in hex, between PEM lines and in three or five dotted parts
are decoded, and reported only if what comes out parses to its last byte:

* ``key``: a private key, as nested tag-length-value records (PKCS 1, PKCS 8,
  SEC 1, DSA, PKCS 12) or as nested length-prefixed strings (OpenSSH). RSA moduli must
  be the product of their primes, check numbers must agree.
* ``token``: a signed token, with a JSON header that names an algorithm, and a
  signature as long as that algorithm makes it.
* ``encoded``: a run that decodes to text with a secret in it, up to three layers deep.

Public keys, certificates, digests and other encoded data do not parse as these
and are left alone. The work is one narrow pass: nothing is shuffled, and a lost task is run again by itself.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import kernel
from larder.llm.common import query, read

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "key", "token", "encoded")
LEAST_RUN = 16  # letters of a run that may hold a candidate
LEAST_ENCODED = 24  # letters of one that is decoded
KEY_BYTES = 1 << 16  # no private key's encoding is longer
LAYERS = 3  # of encoded text

_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_ASKS = "(?i)(password|passwd|secret|token|api_?key)"
_ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----")
_FIELD = re.compile(r"^[A-Za-z][A-Za-z0-9-]*:[^\n]*$", re.MULTILINE)
_DOTTED = re.compile(r"(?<![A-Za-z0-9_.=-])[A-Za-z0-9_-]{10,}(?:\.[A-Za-z0-9_-]*){2,4}(?![A-Za-z0-9_=-])")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{%d,}={0,2}" % LEAST_ENCODED)
_WRAPPED = re.compile(r"[A-Za-z0-9+/_-]+|(?:\s|\\[nr])+")
_ALL_HEX = re.compile(r"[0-9A-Fa-f]+")
_URL_SAFE = str.maketrans("-_", "+/")

_INSIDE = np.zeros(256, bool)
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-":
    _INSIDE[_c] = True

# Object identifiers of key types, as encoded.
RSA = bytes.fromhex("2a864886f70d010101")
ELLIPTIC = bytes.fromhex("2a8648ce3d0201")
DSA = bytes.fromhex("2a8648ce380401")
EDWARDS = {bytes.fromhex("2b656e"): 32, bytes.fromhex("2b656f"): 56, bytes.fromhex("2b6570"): 32, bytes.fromhex("2b6571"): 57}
ENCRYPTIONS = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
PKCS7 = bytes.fromhex("2a864886f70d0107")
OPENSSH = b"openssh-key-v1\0"
# Bytes of a signature by the algorithm a token names; RSA ones have at least these.
SIGNATURE = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES256K": 64, "ES384": 96, "ES512": 132, "EdDSA": 64}
RSA_SIGNATURE = 128

INTEGER, OCTETS, NAME, SEQUENCE = 2, 4, 6, 0x30


# ---- nested records -----------------------------------------------------------


def record(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, first byte, end) of the record at a place, None if its length does not fit."""
    if end - at < 2 or data[at] & 0x1F == 0x1F:
        return None
    tag, length, at = data[at], data[at + 1], at + 2
    if length >= 0x80:
        many = length & 0x7F
        if not 0 < many <= 4 or end - at < many:
            return None
        length = int.from_bytes(data[at : at + many], "big")
        at += many
        if length < 0x80 or length >> (8 * (many - 1)) == 0:  # the shortest form is the only one
            return None
    return (tag, at, at + length) if at + length <= end else None


def records(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The records that fill a place exactly, None if they do not."""
    out = []
    while at < end:
        one = record(data, at, end)
        if one is None:
            return None
        out.append(one)
        at = one[2]
    return out


def _number(data: bytes, one: tuple[int, int, int]) -> int:
    return int.from_bytes(data[one[1] : one[2]], "big")


def _private_records(data: bytes, at: int, end: int) -> bool:
    """Whether the records in a sequence's place are those of a private key."""
    own = records(data, at, end)
    if not own or any(b == e for t, b, e in own if t in (INTEGER, NAME)):
        return False
    tags = [t for t, _, _ in own]
    if tags[:9] == [INTEGER] * 9 and tags[9:] in ([], [SEQUENCE]):  # RSA
        _, n, e, d, p, q = (_number(data, r) for r in own[:6])
        return n > 1 and e > 1 and d > 1 and (n == p * q or tags[9:] == [SEQUENCE] and n % (p * q or n + 1) == 0)
    if tags == [INTEGER] * 6:  # DSA
        version, p, q, g, y, x = (_number(data, r) for r in own)
        return version == 0 and q > 1 and p > q and (p - 1) % q == 0 and 0 < x < q and 1 < g < p and 1 < y < p
    if tags[:2] == [INTEGER, OCTETS] and set(tags[2:]) <= {0xA0, 0xA1}:  # elliptic curves
        return _number(data, own[0]) == 1 and 16 <= own[1][2] - own[1][1] <= 66 and all(records(data, b, e) for _, b, e in own[2:])
    if tags[:3] == [INTEGER, SEQUENCE, OCTETS] and set(tags[3:]) <= {0xA0, 0xA1, 0x81}:  # PKCS 8
        kind = records(data, *own[1][1:])
        return _number(data, own[0]) in (0, 1) and bool(kind) and kind[0][0] == NAME and _wrapped_key(data, data[kind[0][1] : kind[0][2]], *own[2][1:])
    if tags == [SEQUENCE, OCTETS]:  # encrypted PKCS 8
        kind = records(data, *own[0][1:])
        return bool(kind) and kind[0][0] == NAME and data[kind[0][1] : kind[0][2]].startswith(ENCRYPTIONS) and 0 < own[1][2] - own[1][1] and (own[1][2] - own[1][1]) % 8 == 0
    if tags[:2] == [INTEGER, SEQUENCE] and tags[2:] in ([], [SEQUENCE]):  # PKCS 12
        kind = records(data, *own[1][1:])
        return _number(data, own[0]) == 3 and bool(kind) and kind[0][0] == NAME and data[kind[0][1] : kind[0][2]].startswith(PKCS7) and len(kind) == 2
    return False


def _wrapped_key(data: bytes, name: bytes, at: int, end: int) -> bool:
    inner = record(data, at, end)
    if inner is None or inner[2] != end:
        return False
    tag, begin, stop = inner
    if name in EDWARDS:
        return tag == OCTETS and stop - begin == EDWARDS[name]
    if name == DSA:
        return tag == INTEGER and stop > begin
    if name in (RSA, ELLIPTIC):
        return tag == SEQUENCE and _private_records(data, begin, stop)
    return tag in (SEQUENCE, OCTETS, INTEGER) and stop - begin >= 16


def _strings(data: bytes, at: int, many: int) -> tuple[list[bytes], int] | None:
    """Length-prefixed strings in a row, and where they end."""
    out = []
    for _ in range(many):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        out.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return out, at


def key_bytes(data: bytes) -> int:
    """How many bytes at the start are a private key, 0 if none."""
    if data.startswith(OPENSSH):
        head = _strings(data, len(OPENSSH), 3)
        if head is None or len(data) < head[1] + 4:
            return 0
        (cipher, derived, _), at = head
        many = int.from_bytes(data[at : at + 4], "big")
        tail = _strings(data, at + 4, many + 1) if 0 < many <= 16 else None
        if tail is None or not cipher or not derived:
            return 0
        *public, private = tail[0]
        typed = [_strings(p, 0, 1) for p in public]
        if any(t is None or not t[0][0].startswith((b"ssh-", b"ecdsa-", b"sk-")) for t in typed) or not private or len(private) % 8:
            return 0
        same = cipher != b"none" or private[:4] == private[4:8] and _strings(private, 8, 1) is not None and _strings(private, 8, 1)[0][0] == typed[0][0][0]
        return tail[1] if same else 0
    one = record(data, 0, len(data))
    return one[2] if one and one[0] == SEQUENCE and _private_records(data, one[1], one[2]) else 0


# ---- candidates ---------------------------------------------------------------


def decoded(letters: str) -> bytes | None:
    """Base64 of either alphabet, with or without padding; None if the last letters do not fit."""
    letters = letters.rstrip("=").translate(_URL_SAFE)
    if len(letters) % 4 == 1:
        return None
    try:
        return base64.b64decode(letters + "=" * (-len(letters) % 4), validate=True)
    except binascii.Error:
        return None


def _gathered(text: str, at: int, most: int) -> tuple[str, list[tuple[int, int]]]:
    """Up to ``most`` base64 letters from a place on, over line ends; and (letters so far, place) of each piece."""
    out, places, so_far = [], [], 0
    for m in _WRAPPED.finditer(text, at):
        if m.start() != at or so_far >= most:
            break
        at = m.end()
        if not m.group()[0].isspace() and m.group()[0] != "\\":
            places.append((so_far, m.start()))
            out.append(m.group())
            so_far += len(m.group())
    return "".join(out)[:most], places


def _bare_key(text: str, at: int) -> int:
    """Where a key ends whose base64 begins at a place, 0 if none does."""
    first = decoded(text[at : at + 24])
    if first is None or not (first.startswith(OPENSSH) or first[0] == SEQUENCE):
        return 0
    most = KEY_BYTES
    if first[0] == SEQUENCE:
        announced = record(first + bytes(KEY_BYTES), 0, len(first) + KEY_BYTES)
        if announced is None:
            return 0
        most = announced[2]
    letters, places = _gathered(text, at, -(-most * 4 // 3))
    data = decoded(letters) or decoded(letters[: len(letters) // 4 * 4]) or b""
    used = key_bytes(data)
    if not used:
        return 0
    needed = -(-used * 4 // 3)
    so_far, start = max(p for p in places if p[0] < needed)
    end = start + needed - so_far
    padded = end + len(text[end : end + 2]) - len(text[end : end + 2].lstrip("="))
    return padded if not re.match(r"[A-Za-z0-9+/_-]", text[padded : padded + 1]) else 0


def signed_token(parts: list[str]) -> bool:
    """Whether dotted parts are a signed (three) or encrypted (five) token."""
    made = [decoded(p) if p else b"" for p in parts]
    if any(m is None for m in made):
        return False
    try:
        header = json.loads(made[0])
    except (ValueError, RecursionError):
        return False
    algorithm = header.get("alg") if isinstance(header, dict) else None
    if not isinstance(algorithm, str):
        return False
    if len(parts) == 5:
        return isinstance(header.get("enc"), str) and bool(made[2]) and bool(made[3]) and bool(made[4])
    if len(parts) != 3 or not made[1]:
        return False
    if algorithm in SIGNATURE:
        return len(made[2]) == SIGNATURE[algorithm]
    return algorithm[:2] in ("RS", "PS") and len(made[2]) >= RSA_SIGNATURE


def _armoured(text: str, m: re.Match) -> int:
    """Where an armoured private key ends, 0 if its body does not parse."""
    close = f"-----END {m[1]}-----"
    end = text.find(close, m.end(), m.end() + 2 * KEY_BYTES)
    if end < 0:
        return 0
    body = text[m.end() : end].replace("\\n", "\n").replace("\\r", "")
    fields = _FIELD.findall(body)
    data = decoded(re.sub(r"\s+", "", _FIELD.sub("", body)))
    if not data:
        return 0
    locked = any(f.startswith("DEK-Info:") for f in fields) and len(data) % 8 == 0
    return end + len(close) if locked or key_bytes(data) == len(data) else 0


def _readable(data: bytes) -> str | None:
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    return text if len(text) >= 12 and not re.search(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", text) else None


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the plain patterns; the kind as its place in ``KINDS``."""
    out = [(0, *m.span()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    out += [(1, *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return out + [(2, *m.span()) for m in _HEX.finditer(text) if m.end() - m.start() >= 16]


def _outside(spans: list[tuple[int, int, int]]) -> Callable[[int], bool]:
    """Tells whether a place is in none of some spans that lie apart."""
    ranges = sorted((s, e) for _, s, e in spans)
    starts, ends = [s for s, _ in ranges], [0, *(e for _, e in ranges)]
    return lambda at: at >= ends[bisect.bisect_right(starts, at)]


def confirmed(text: str, layers: int = LAYERS) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the candidates whose structure holds, apart from each other."""
    out, done = [], 0
    for m in _ARMOUR.finditer(text):
        if m.start() >= done and (end := _armoured(text, m)):
            out.append((3, m.start(), end))
            done = end
    free = _outside(out)
    out += [(4, *m.span()) for m in _DOTTED.finditer(text) if free(m.start()) and signed_token(m.group().split("."))]
    free = _outside(out)
    done = 0
    for m in _RUN.finditer(text):
        if m.start() < done or not free(m.start()):
            continue
        letters, data = m.group(), None
        if _ALL_HEX.fullmatch(letters) and len(letters) % 2 == 0:
            data = bytes.fromhex(letters)
            if key_bytes(data) == len(data):
                out.append((3, *m.span()))
                continue
        elif end := _bare_key(text, m.start()):
            out.append((3, m.start(), end))
            done = end
            continue
        if layers:
            inner = next((t for d in (data, decoded(letters)) if d and (t := _readable(d))), None)
            if inner and (any(k < 2 for k, *_ in base_spans(inner)) or confirmed(inner, layers - 1)):
                out.append((5, *m.span()))
    return out


def spans_of(text: str) -> list[tuple[int, int, int]]:
    """All spans in the order of start, kind and end."""
    return sorted({*base_spans(text), *confirmed(text)}, key=lambda x: (x[1], x[0], x[2]))


# ---- as a Spark job -------------------------------------------------------------


def _scan(names: list[str]):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in kernel.slices(batch["_text"]):
                own = kernel.Text(data, offsets)
                starts, ends = own.spans(_INSIDE[data])
                column = batch["_text"][at:end].fill_null("")
                look = pc.match_substring_regex(column, _ASKS).to_numpy(zero_copy_only=False).copy()
                look[own.row_of(starts[ends - starts >= LEAST_RUN])] = True  # the others have neither pattern nor candidate
                out: list[list] = [[] for _ in range(end - at)]
                for i in np.flatnonzero(look):
                    out[i] = [{"kind": KINDS[k], "start": s, "end": e} for k, s, e in spans_of(column[int(i)].as_py())]
                yield pa.RecordBatch.from_arrays([batch[n][at:end] for n in names] + [pa.array(out, kind)], [*names, "_spans"])

    return run


def scan(documents: DataFrame, keep: list[str]) -> DataFrame:
    """The columns in ``keep``, and the secrets of each ``text`` as ``_spans`` (kind, start, end in code points, end exclusive).

    Ordered by start, kind and end. A missing or empty text has none. Rows are
    scanned each by itself: repeated rows and ids, missing ids, an empty table and other
    columns (also one named ``_spans``, unless it is kept) change nothing.
    """
    rows = documents.select(*[F.col(f"`{k}`") for k in keep], F.col("text").alias("_text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return rows.mapInArrow(_scan(keep), ", ".join([*kinds, "_spans array<struct<kind: string, start: int, end: int>>"]))


def without_secrets(documents: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with each secret (or run of overlapping ones) replaced by a mark; a missing text stays missing."""
    found = scan(documents, documents.columns)
    empty = F.struct(F.array().cast("array<string>").alias("pieces"), F.lit(0).alias("at"))
    text = F.col("text")

    def step(done, one):
        before = F.substring(text, done["at"] + 1, one["start"] - done["at"])
        piece = F.when(one["start"] >= done["at"], F.array(before, F.lit(mark))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.concat(done["pieces"], piece).alias("pieces"), F.greatest(done["at"], one["end"]).alias("at"))

    whole = F.aggregate("_spans", empty, step, lambda done: F.concat(F.array_join(done["pieces"], ""), F.substring(text, done["at"] + 1, F.length(text))))
    return found.withColumn("text", F.when(F.size("_spans") > 0, whole).otherwise(text)).drop("_spans")


def own_spans(kinds: tuple[str, ...]) -> Column:
    return F.filter("_spans", lambda s: s["kind"].isin(*kinds))


def listed_spans(kinds: tuple[str, ...]) -> Column:
    return F.array_join(F.transform(own_spans(kinds), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query("op11_secrets")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    found = scan(read(spark, folder, "documents"), ["doc_id"])
    counts = [F.size(own_spans((k,))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed_spans(BASE_KINDS).cast("binary"), 256).alias("base_sha256"), listed_spans(KINDS).alias("spans"))
