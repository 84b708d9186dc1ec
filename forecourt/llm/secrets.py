"""Secret scans: keyword automaton, anchored patterns near its hits, embedded checksums."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from forecourt.llm.common import ascii_lower

#: Kinds in the order of their rank at equal starts. The first three are the base kinds.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_JWT = re.compile(r"(eyJ[A-Za-z0-9_-]{8,})\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}")
_JWT_RUN = re.compile(r"[A-Za-z0-9_-]+")
_PEM = re.compile(r"-----BEGIN ([A-Z ]*)PRIVATE KEY-----([A-Za-z0-9+/=\s]+)-----END \1PRIVATE KEY-----")

_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62_crc(body: str) -> str:
    """The six-character checksum that ends such a token."""
    n, out = zlib.crc32(body.encode()), ""
    while n or len(out) < 6:
        n, d = divmod(n, 62)
        out = _DIGITS[d] + out
    return out


def _long_value(m: re.Match) -> bool:
    return len(m[2]) >= 6


def _long_key(m: re.Match) -> bool:
    return len(m[0]) >= 20


def _checksum(m: re.Match) -> bool:
    return base62_crc(m[1]) == m[2]


def _header(m: re.Match) -> bool:
    """The first part is a JSON object that names an algorithm."""
    try:
        found = json.loads(base64.urlsafe_b64decode(m[1] + "=" * (-len(m[1]) % 4)))
    except (ValueError, RecursionError):
        return False
    return isinstance(found, dict) and isinstance(found.get("alg"), str)


def _sequence(m: re.Match) -> bool:
    """The body is one ASN.1 sequence of the length that it embeds, or an OpenSSH key."""
    try:
        body = base64.b64decode("".join(m[2].split()), validate=True)
    except ValueError:
        return False
    if body.startswith(b"openssh-key-v1\0"):
        return True
    if len(body) < 2 or body[0] != 0x30:
        return False
    wide = body[1] - 0x80 if body[1] > 0x80 else 0
    size = int.from_bytes(body[2 : 2 + wide], "big") if wide else body[1]
    return wide <= 8 and 2 + wide + size == len(body)


#: Keyword (lower case): kind, pattern that must match where it stands, check.
_RULES = {
    **dict.fromkeys(("password", "passwd", "secret", "token", "apikey", "api_key"), ("assign", _ASSIGN, _long_value)),
    "akia": ("access", _ACCESS, _long_key),
    **dict.fromkeys(("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), ("github", _GITHUB, _checksum)),
    "npm_": ("npm", _NPM, _checksum),
    "eyj": ("jwt", _JWT, _header),
    "-----begin ": ("pem", _PEM, _sequence),
}

_built: list = []


def _automaton():
    if not _built:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for word in _RULES:
            machine.add_word(word, word)
        machine.make_automaton()
        _built.append(machine)
    return _built[0]


def find(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all secrets of a text, by start and then kind.

    Of each kind the leftmost matches that don't overlap; a match that fails
    its check uses up its characters. A run of hexadecimal digits has no
    keyword and is found by its pattern.
    """
    if not text:
        return []
    hits = sorted((end - len(word) + 1, word) for end, word in _automaton().iter(ascii_lower(text)))
    found, done = [], {}
    for start, word in hits:
        kind, pattern, check = _RULES[word]
        if start < done.get(kind, 0):
            continue
        if m := pattern.match(text, start):
            done[kind] = m.end()
            if check(m):
                found.append((start, m.end(), kind))
        elif text.startswith("eyJ", start):
            # Later starts in the same run of characters fail as well.
            done[kind] = _JWT_RUN.match(text, start).end()
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    rank = KINDS.index
    return sorted(found, key=lambda s: (s[0], rank(s[2]), s[1]))


def digest(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


_FOUND = "doc_id long, n_assign long, n_access long, n_hex long, n_checked long, base_sha256 string, spans string"


def scan(docs: DataFrame) -> DataFrame:
    """Secrets of each row of ``docs`` (doc_id, text); spans in code points, end exclusive.

    ``n_checked`` counts the spans beyond the base kinds. Null and empty texts
    have none; repeated rows are scanned alike; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                spans = find(text.as_py())
                counts = [sum(s[2] == kind for s in spans) for kind in KINDS[:3]]
                base = digest([s for s in spans if s[2] in KINDS[:3]])
                rows.append((*counts, len(spans) - sum(counts), hashlib.sha256(base.encode()).hexdigest(), digest(spans)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64())] + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["doc_id", "n_assign", "n_access", "n_hex", "n_checked", "base_sha256", "spans"],
            )

    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(run, _FOUND)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with each span, or each stretch of overlapping spans, replaced by its first kind."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]
