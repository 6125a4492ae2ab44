"""Secret scans with structural confirmation.

Three plain patterns give the base spans. Beyond them, runs of base64 or hex characters are decoded and
reported only if what comes out has the structure of a secret: a DER key whose nested lengths fit to the
last byte, a key in OpenSSH's format whose fields do, a signed token whose header is JSON naming an
algorithm, or text that is an assignment itself. Text between PEM markers counts when its body decodes
so. Python reads each whole text once per pattern; patterns are anchored at literals, so their cost is
linear in the text.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcount.llm.bytetext import slices

#: Fixed values of the contract, in its order.
BASE_KINDS = ("assign", "access", "hex")
#: What structure confirms.
MORE_KINDS = ("pem_key", "der_key", "ssh_key", "signed_token", "encoded_assign")
KINDS = BASE_KINDS + MORE_KINDS
_PLACE = {kind: i for i, kind in enumerate(KINDS)}

ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")

#: The shortest secret is the shortest keyword, a sign and 8 characters: 14 bytes.
_LEAST = 14
_BREAK = r"(?:\r?\n|\\r\\n|\\n)[\x20\t]*"
_START = r"(?<![A-Za-z0-9+/_-])(?:(?<=\\)[nrt])?"
_ANY_HEX = re.compile(_START + rf"((?:[0-9A-Fa-f]{{2}}){{{_LEAST},}})(?![0-9A-Za-z+/_-])")
_BASE64 = re.compile(_START + rf"([A-Za-z0-9+/_-]{{{-(-4 * _LEAST // 3)},}}={{0,2}})")
#: Runs that go on over line breaks, also escaped ones.
_HEX_LINES = re.compile(_START + rf"((?:[0-9A-Fa-f]{{2}})+(?:{_BREAK}(?:[0-9A-Fa-f]{{2}})+)+)(?![0-9A-Za-z+/_-])")
_BASE64_LINES = re.compile(_START + rf"([A-Za-z0-9+/_-]+(?:{_BREAK}[A-Za-z0-9+/_-]+)+={{0,2}})")
_BREAKS = re.compile(_BREAK)
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
_PEM = re.compile(r"-----BEGIN ([A-Z ]{0,30}PRIVATE KEY)-----((?:[^-]|-(?!----))+)-----END \1-----")
_PEM_HEADER = re.compile(r"^[\x20\t]*([A-Za-z0-9-]+):[\x20\t]*(.*)$", re.M)
#: PKCS#5 and PKCS#12 encryption.
_PBE = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))

Span = tuple[int, int, str]


def _decode(text: str) -> bytes | None:
    text = text.rstrip("=").translate(str.maketrans("-_", "+/"))
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _der_item(data: bytes, at: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the contents of the DER item at ``at``, if its length fits."""
    if at + 2 > len(data):
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > len(data):
            return None
        size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if size < 0x80:
            return None
    return (tag, at, at + size) if at + size <= len(data) else None


def is_der_key(data: bytes) -> bool:
    """A sequence that ends with the data and nests without a gap: a small version number and a key's
    parts, or the algorithm of an encryption by password and what it made."""
    outer = _der_item(data, 0)
    if not outer or outer[0] != 0x30 or outer[2] != len(data) or len(data) < 24:
        return False
    at, items = outer[1], []
    while at < outer[2]:
        item = _der_item(data[: outer[2]], at)
        if not item:
            return False
        items.append(item)
        at = item[2]
    if len(items) == 2 and [tag for tag, _, _ in items] == [0x30, 0x04]:
        name = _der_item(data[: items[0][2]], items[0][1])
        return bool(name) and name[0] == 0x06 and data[name[1] : name[2]].startswith(_PBE)
    if len(items) < 3 or items[0][0] != 0x02 or items[0][2] - items[0][1] != 1 or data[items[0][1]] > 2:
        return False
    kinds = [tag for tag, _, _ in items[1:]]
    integers = all(k == 0x02 for k in kinds) and (len(kinds) >= 8 or len(kinds) == 5)
    wrapped = kinds[:2] == [0x30, 0x04] and _der_item(data, items[1][1]) is not None
    elliptic = kinds[0] == 0x04 and all(k in (0xA0, 0xA1) for k in kinds[1:])
    return integers or wrapped or elliptic


def is_ssh_key(data: bytes) -> bool:
    """OpenSSH's private format: a marker, then length-prefixed fields that fill the data."""
    marker = b"openssh-key-v1\0"
    if not data.startswith(marker):
        return False
    at = len(marker)
    for field in range(6):
        if field == 3:
            at += 4
            continue
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at == len(data)


def is_signed_header(text: str) -> bool:
    data = _decode(text)
    try:
        head = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and head["alg"].lower() != "none"


def _meaning(data: bytes) -> str | None:
    """What decoded bytes are, if they are a secret by structure."""
    if is_der_key(data):
        return "der_key"
    if is_ssh_key(data):
        return "ssh_key"
    if data.isascii() and (m := ASSIGN.search(data.decode("ascii"))) and len(m[2]) >= 8:
        return "encoded_assign"
    return None


def base_spans(text: str) -> list[Span]:
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def _is_pem_body(body: str) -> bool:
    body = body.replace("\\r", "\n").replace("\\n", "\n")
    heads = dict(_PEM_HEADER.findall(body))
    data = _decode("".join(_PEM_HEADER.sub("", body).split()))
    if not data:
        return False
    if "ENCRYPTED" in heads.get("Proc-Type", "") and "DEK-Info" in heads:
        return len(data) % 8 == 0
    return is_der_key(data) or is_ssh_key(data)


def _unhex(text: str) -> bytes | None:
    return bytes.fromhex(text) if len(text) % 2 == 0 else None


def _wrapped(text: str, start: int, end: int, decode) -> Iterator[Span]:
    """What lines of one encoding are together.

    Wrapped lines are of one width but for a shorter last one. An encoded key may also begin at a
    line among others of its width; its head tells, and its outer length says where it ends.
    """
    lines, at = [], start
    for m in [*_BREAKS.finditer(text, start, end), None]:
        lines.append((at, m.start() if m else end))
        at = m.end() if m else end
    i = 0
    while i < len(lines):
        width, k = lines[i][1] - lines[i][0], i + 1
        while k < len(lines) and lines[k][1] - lines[k][0] == width:
            k += 1
        tail = k < len(lines) and lines[k][1] - lines[k][0] < width
        begins = [i] + [n for n in range(i + 1, k) if _may_begin(text[slice(*lines[n])], decode)]
        found = None
        for n in begins:
            for last in (k + 1, k) if tail else (k,):
                if last - n > 1 and (kind := _kind_of("".join(text[x:y] for x, y in lines[n:last]), decode)):
                    found = found or (lines[n][0], lines[last - 1][1], kind)
            if found:
                yield found
                break
            if n < k and (found := _measured(text, lines[n:], decode)):
                yield found
                break
        i = k


def _may_begin(line: str, decode) -> bool:
    return line.startswith(("30", "6f70656e7373682d", "6F70656E7373682D") if decode is _unhex else ("M", "b3BlbnNzaC1r"))


def _measured(text: str, lines: list[tuple[int, int]], decode) -> Span | None:
    """A DER key that begins with the first line and ends with the line where its length says."""
    per = 2 if decode is _unhex else 4 / 3
    head = decode(text[slice(*lines[0])][:8])
    if not head or head[0] != 0x30 or len(head) < 2:
        return None
    more = head[1] & 0x7F if head[1] & 0x80 else 0
    if more > 3 or len(head) < 2 + more:
        return None
    size = 2 + more + (int.from_bytes(head[2 : 2 + more], "big") if more else head[1])
    need, got = -int(-size * per // 1), 0
    for n, (x, y) in enumerate(lines):
        got += len(text[x:y].rstrip("="))
        if got >= need:
            if got == need and n and (kind := _kind_of("".join(text[x:y] for x, y in lines[: n + 1]), decode)):
                return lines[0][0], y, kind
            return None
    return None


def _kind_of(text: str, decode) -> str | None:
    data = decode(text)
    return _meaning(data) if data else None


def confirmed_spans(text: str) -> list[Span]:
    out: list[Span] = []
    if "-----BEGIN " in text:
        out += [(m.start(), m.end(), "pem_key") for m in _PEM.finditer(text) if _is_pem_body(m[2])]
    if "eyJ" in text:
        out += [(m.start(), m.end(), "signed_token") for m in _TOKEN.finditer(text) if is_signed_header(m[1])]
    for one, many, decode in ((_BASE64, _BASE64_LINES, _decode), (_ANY_HEX, _HEX_LINES, _unhex)):
        joined = [span for m in many.finditer(text) for span in _wrapped(text, m.start(1), m.end(1), decode)]
        out += joined
        ends = {p for a, b, _ in joined for p in range(a, b)}
        for m in one.finditer(text):
            # an escape's letter may also be the first of the run
            for begin in dict.fromkeys((m.start(1), m.start())):
                if begin not in ends and (kind := _kind_of(text[begin : m.end()], decode)):
                    out.append((begin, m.end(), kind))
                    break
    return out


def find_secrets(text: str) -> list[Span]:
    """All spans (start, end, kind) in code points, by start and then kind."""
    return sorted(base_spans(text) + confirmed_spans(text), key=lambda s: (s[0], _PLACE[s[2]], s[1]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id and ``found``, an array of (kind, start, end, value).

    Null and empty texts have no spans. Repeated rows are scanned each; other columns are dropped.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for a, b in slices(batch["text"], 4 << 20):
                for text in batch["text"].slice(a, b - a).to_pylist():
                    spans = find_secrets(text)
                    found.append([{"kind": k, "start": s, "end": e, "value": text[s:e]} for s, e, k in spans])
            yield pa.record_batch([batch[id_col], pa.array(found, item)], names=[id_col, "found"])

    texts = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = f"`{id_col}` {kind}, found array<struct<kind: string, start: long, end: long, value: string>>"
    return texts.mapInArrow(run, schema)


def secret_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the hash of the base spans and the list of all spans."""
    base = F.filter("found", lambda x: x["kind"].isin(*BASE_KINDS))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind):
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        id_col,
        *[count(kind) for kind in BASE_KINDS],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"),
    )


def sha256_of(spans: list[Span]) -> str:
    """The digest of base spans, as ``secret_digest`` has it."""
    listed = ",".join(f"{k}:{s}:{e}" for s, e, k in spans if k in BASE_KINDS)
    return hashlib.sha256(listed.encode()).hexdigest()
