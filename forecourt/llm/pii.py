"""Personal data: patterns with checks, and a character tagger for what they miss."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forecourt.llm.tagger import Tagger, codes

#: Kinds in the order of the digest. Label 0 is outside; 1 + 2k begins kind k, 2 + 2k continues it.
KINDS = ("email", "ip", "card", "phone")

#: Windows of two cells; each decides its middle.
CELL = 48

#: Labelled windows and training steps; both are fixed, whatever the corpus.
EXAMPLES, EXAMPLE_CHARS, STEPS = 3000, 64, 200

#: Windows tagged at once.
TAGGED = 512

_PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    # A match always ends with a run of digits and none begins inside one that failed, so only the start of a run is tried.
    "ip": re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}

#: Where the patterns can begin to match, and where the tagger looks.
_DIGIT = re.compile(r"[0-9]")
_TRIGGER = re.compile(r"[0-9]|@|[(\[]at[)\]]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def _passes(kind: str, text: str) -> bool:
    if kind == "ip":
        parts = (p.lstrip("0") for p in text.split("."))
        return all(len(p) <= 3 and int(p or "0") <= 255 for p in parts)
    if kind == "card":
        digits = _digits(text)
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 8 <= len(_digits(text)) <= 15


def _emails(text: str) -> Iterator[re.Match]:
    """Leftmost email matches, tried only where a run of local characters leads to an at sign."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _PATTERNS["email"].match(text, start) if start < at else None
        if m:
            yield m
            done = m.end()
        at = text.find("@", max(at + 1, done))


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind and start: leftmost matches that don't overlap, less those that fail their check."""
    out = [("email", m.start(), m.end()) for m in _emails(text)]
    if _DIGIT.search(text):
        for kind in KINDS[1:]:
            out += [(kind, m.start(), m.end()) for m in _PATTERNS[kind].finditer(text) if _passes(kind, m[0])]
    return out


# --- labelled examples -------------------------------------------------------


def _pick(draw: random.Random, alphabet: str, low: int, high: int) -> str:
    return "".join(draw.choice(alphabet) for _ in range(draw.randint(low, high)))


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_NUMERALS = "0123456789"


def _card(draw: random.Random) -> str:
    size = draw.choice((13, 14, 15, 15, 16, 16, 16, 19))
    body = draw.choice("3456") + _pick(draw, _NUMERALS, size - 2, size - 2)
    digits = next(body + d for d in _NUMERALS if luhn(body + d))
    cuts = {15: (4, 10), 14: (4, 10)}.get(size, (4, 8, 12, 16))
    gap = draw.choice(("", " ", "-"))
    return "".join((gap if k in cuts else "") + d for k, d in enumerate(digits))


def _phone(draw: random.Random) -> str:
    n = lambda k: _pick(draw, _NUMERALS, k, k)
    area, code = draw.choice("23456789") + n(2), draw.choice("123456789") + draw.choice(("", draw.choice(_NUMERALS)))
    forms = (
        f"+{code} ({area}) {n(3)}-{n(4)}",
        f"+{code} {area} {n(3)} {n(4)}",
        f"({area}) {n(3)}-{n(4)}",
        f"{area}-{n(3)}-{n(4)}",
        f"{area}.{n(3)}.{n(4)}",
        f"0{n(2)} {n(4)} {n(4)}",
        f"00{code} {n(2)} {n(3)} {n(4)}",
    )
    return draw.choice(forms)


def _email(draw: random.Random) -> str:
    user = _pick(draw, _LETTERS + "." + _NUMERALS, 3, 10).strip(".") or "me"
    host = _pick(draw, _LETTERS + _NUMERALS, 3, 8) + "." + draw.choice(("com", "org", "net", "example.com", "co.uk"))
    sign, dot = draw.choice((("@", "."), ("@", "."), ("@", "."), (" [at] ", " [dot] "), (" (at) ", " (dot) "), (" (at) ", ".")))
    return user + sign + host.replace(".", dot)


def _ip(draw: random.Random) -> str:
    if draw.random() < 0.6:
        return ".".join(str(draw.randint(0, 255)) for _ in range(4))
    groups = [_pick(draw, "0123456789abcdef", 1, 4) for _ in range(draw.randint(3, 8))]
    if len(groups) == 8:
        return ":".join(groups)
    at = draw.randint(1, len(groups) - 1)
    return ":".join(groups[:at]) + "::" + ":".join(groups[at:])


_MAKE = {"email": _email, "ip": _ip, "card": _card, "phone": _phone}


def _other(draw: random.Random) -> str:
    """Text that is not personal data, much of it with digits."""
    n = lambda a, b: _pick(draw, _NUMERALS, a, b)
    forms = (
        n(1, 12),
        f"{n(4, 4)}-{n(2, 2)}-{n(2, 2)}",
        f"{n(1, 2)}.{n(1, 2)}.{n(4, 4)}",
        f"{n(1, 3)},{n(3, 3)}.{n(2, 2)}",
        f"v{n(1, 1)}.{n(1, 2)}.{n(1, 2)}",
        f"{n(2, 2)}:{n(2, 2)}:{n(2, 2)}",
        _pick(draw, "0123456789abcdef", 12, 40),
        "AKIA" + _pick(draw, _LETTERS.upper() + _NUMERALS, 16, 16),
        f"@{_pick(draw, _LETTERS, 3, 8)}",
        f"http://{_pick(draw, _LETTERS, 4, 9)}.com/{n(2, 6)}",
        f"{n(2, 4)}-{n(2, 4)}",
        f"CC BY-NC {n(1, 1)}.{n(1, 1)}",
        f"{n(1, 2)}/{n(1, 2)}/{n(2, 4)}",
        f"ISBN {n(3, 3)}-{n(1, 1)}-{n(5, 5)}-{n(3, 3)}-{n(1, 1)}",
        f"{n(1, 3)}%",
        n(14, 22),
    )
    return draw.choice(forms)


def labelled_text(draw: random.Random, chars: int) -> tuple[str, list[tuple[str, int, int]]]:
    """Text of at least ``chars`` characters and the spans of personal data in it."""
    text, spans = "", []
    while len(text) < chars:
        kind = draw.random()
        if kind < 0.16:
            name = draw.choice(KINDS)
            value = _MAKE[name](draw)
            spans.append((name, len(text), len(text) + len(value)))
        elif kind < 0.3:
            value = _other(draw)
        else:
            value = _pick(draw, _LETTERS + "aeiounrst" + "éüñß", 1, 9)
            value = value.capitalize() if draw.random() < 0.1 else value
        text += value + draw.choice((" ", " ", " ", " ", ", ", ". ", "\n", "; "))
    return text, spans


def label_codes(spans: list[tuple[str, int, int]], size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    for kind, start, end in spans:
        k = KINDS.index(kind)
        out[start:end] = 2 + 2 * k
        out[start] = 1 + 2 * k
    return out


def examples(count: int, chars: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows cut from labelled texts: codes and labels (count, chars)."""
    draw, xs, ys = random.Random(seed), [], []
    while len(xs) < count:
        text, spans = labelled_text(draw, 8 * chars)
        x, y = codes(text), label_codes(spans, len(text))
        for at in range(0, len(text) - chars, chars):
            xs.append(x[at : at + chars])
            ys.append(y[at : at + chars])
    return np.stack(xs[:count]), np.stack(ys[:count])


@lru_cache(maxsize=1)
def trained() -> Tagger:
    """The tagger, trained from labelled spans; the same in every process."""
    tagger = Tagger(1 + 2 * len(KINDS))
    tagger.train(*examples(EXAMPLES, EXAMPLE_CHARS, seed=11), steps=STEPS)
    return tagger


# --- whole texts -------------------------------------------------------------


def _windows(text: str) -> dict[int, str]:
    """Windows near a trigger, by the number of their first cell; text beyond the ends is blank."""
    cells = {m.start() // CELL for m in _TRIGGER.finditer(text)}
    firsts = {c + d for c in cells for d in (-2, -1, 0, 1)}
    last = (len(text) - 1) // CELL
    out = {}
    for k in firsts:
        if -1 <= k <= last:
            part = text[max(0, k * CELL) : (k + 2) * CELL]
            out[k] = part.rjust(2 * CELL, "\0") if k < 0 else part.ljust(2 * CELL, "\0")
    return out


def _tagged(tagger: Tagger, texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
    """Spans of each text: every window decides its middle, and the labels are joined over the whole text."""
    windows = [_windows(t) if t else {} for t in texts]
    different = list(dict.fromkeys(w for found in windows for w in found.values()))
    labels: dict[str, np.ndarray] = {}
    for at in range(0, len(different), TAGGED):
        part = different[at : at + TAGGED]
        labels.update(zip(part, tagger.decode(np.stack([codes(w) for w in part])), strict=True))
    return [_joined(len(text or ""), {k: labels[w] for k, w in found.items()}) for text, found in zip(texts, windows, strict=True)]


def _joined(size: int, windows: dict[int, np.ndarray]) -> list[tuple[str, int, int]]:
    """Spans of a text's labels, each taken from the window whose middle it is in."""
    if not windows:
        return []
    label = np.zeros(size + 4 * CELL, np.int8)
    for k, found in windows.items():
        at = (k + 1) * CELL + CELL // 2
        label[at : at + CELL] = found[CELL // 2 : CELL // 2 + CELL]
    label = label[CELL : CELL + size]
    kind = (label + 1) // 2
    begins = (kind > 0) & ((label % 2 == 1) | (np.diff(kind, prepend=0) != 0))
    starts = np.flatnonzero(begins)
    stops = np.append(np.flatnonzero(begins | (kind == 0)), size)
    ends = stops[np.searchsorted(stops, starts, "right")]
    return [(KINDS[kind[a] - 1], int(a), int(b)) for a, b in zip(starts, ends, strict=True)]


_IPV6 = re.compile(r"[0-9a-fA-F]{0,4}(:[0-9a-fA-F]{0,4}){2,7}")
_SAID = re.compile(r"[A-Za-z0-9._%+-]+(@| ?[(\[]at[)\]] ?)[A-Za-z0-9-]+((\.| ?[(\[]dot[)\]] ?)[A-Za-z0-9-]+)+")
_CALLED = re.compile(r"[+(0-9][\x20().0-9-]*[0-9]")


def _believable(text: str, kind: str, start: int, end: int) -> tuple[str, int, int] | None:
    """A tagged span, trimmed to its value; nothing if it isn't a whole value of its kind."""
    part = text[start:end]
    cut = part.strip(" \t\r\n,;.")
    start += part.find(cut) if cut else 0
    end = start + len(cut)
    around = text[start - 1 : start] + text[end : end + 1]
    if not cut or any(c.isalnum() for c in around):
        return None
    digits = _digits(cut)
    good = {
        "email": lambda: _SAID.fullmatch(cut) is not None,
        "ip": lambda: _IPV6.fullmatch(cut) is not None and cut.count("::") <= 1 and len(digits) > 0 and ("::" in cut or cut.count(":") == 7),
        "card": lambda: 13 <= len(digits) <= 19 and luhn(digits) and len(digits) == sum(c not in " -" for c in cut),
        "phone": lambda: _CALLED.fullmatch(cut) is not None and 9 <= len(digits) <= 15 and len(re.split(r"[^0-9]+", cut.strip("+()"))) > 2,
    }[kind]
    return (kind, start, end) if good() else None


def all_spans(tagger: Tagger, texts: list[str | None]) -> list[tuple[list, list]]:
    """Base spans and all spans of each text, both by kind and start. Tagged spans that touch a base span are dropped."""
    out = []
    for text, tagged in zip(texts, _tagged(tagger, texts), strict=True):
        base = base_spans(text) if text else []
        more = [s for s in (_believable(text, *t) for t in tagged) if s]
        if base and more:
            starts, ends = np.sort([a for _, a, _ in base]), np.sort([b for _, _, b in base])
            # A span touches none if as many base spans end before it as begin before its end.
            free = np.searchsorted(ends, [s[1] for s in more], "right") == np.searchsorted(starts, [s[2] for s in more], "left")
            more = [s for s, good in zip(more, free.tolist(), strict=True) if good]
        out.append((base, sorted([*base, *more], key=lambda s: (KINDS.index(s[0]), s[1]))))
    return out


def digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


_FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

#: Texts tagged together.
TEXTS = 500


def scan(docs: DataFrame) -> DataFrame:
    """Personal data of each row of ``docs`` (doc_id, text); spans in code points, end exclusive.

    The counts and ``base_sha256`` are of the base kinds' patterns, ``spans``
    has the tagger's too. Null and empty texts have none; repeated rows are
    scanned alike; other columns are ignored.
    """
    tagger = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(at, TEXTS)
                rows = []
                for base, spans in all_spans(tagger, batch.column("text").to_pylist()):
                    counts = [sum(s[0] == kind for s in base) for kind in KINDS]
                    rows.append((*counts, hashlib.sha256(digest(base).encode()).hexdigest(), digest(spans)))
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")] + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _FOUND)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with spans, joined where they overlap, replaced by the kind of the first."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by its kind in brackets; other columns as they are."""
    tagger = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            place = whole.schema.get_field_index("text")
            for at in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(at, TEXTS)
                texts = batch.column(place).to_pylist()
                clean = [
                    redact(text, spans) if spans else text
                    for text, (_, spans) in zip(texts, all_spans(tagger, texts), strict=True)
                ]
                yield batch.set_column(place, batch.schema.field(place), pa.array(clean, batch.schema.field(place).type))

    return docs.mapInArrow(run, docs.schema)
