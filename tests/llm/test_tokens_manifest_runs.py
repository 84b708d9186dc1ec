"""Byte-pair encoding, the Merkle manifest and periodic runs, each against a plain version."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from compare import connect, differences

from forecourt.llm import bytepair, manifest, periodic, queries
from forecourt.llm.common import prepare
from forecourt.llm.oracle import ORACLES

SMALL = "/root/testdata/sf0.001"

#: Extra columns have names that the operators use themselves.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, grp int, word string, block int, ids string"


def documents(spark, rows):
    prepare(spark)
    return spark.createDataFrame([(i, t, lang, "s", 3, 1, "w", 2, "x") for i, t, lang in rows], DOCS)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- byte pairs ----------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path(queries.BYTE_TOKENIZER))


TEXTS = [
    None, "", " ", "\n\n\t a", "it's  'S we'll", "a<|endoftext|> b <|endoftext|><|endoftext|>", "<|endoftext", "\0\x1c\x85\xa0 x",
    "ՠx ¼²3", "\U0001f600 é 한글 漢字", "x" * 5000 + " " * 3000 + "é" * 2000, "9" * 400, "same text", "same text",
]


@pytest.mark.parametrize("block", [1 << 25, 40])
def test_ids_and_texts_are_the_tokenizers(spark, tokenizer, monkeypatch, block):
    monkeypatch.setattr(bytepair, "BLOCK_CHARS", block)
    draw = random.Random(8)
    texts = TEXTS + ["".join(draw.choices("ab's \n12!é漢<|", k=draw.randint(1, 60))) for _ in range(60)]
    docs = documents(spark, [(None if k == 3 else k, t, "en") for k, t in enumerate(texts)])
    found = bytepair.encode_decode(docs, queries.tokenizer_path(queries.BYTE_TOKENIZER)).collect()
    expected = []
    for k, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        expected.append((None if k == 3 else k, ids, tokenizer.decode(ids, skip_special_tokens=False)))
    assert sorted(((r.doc_id, list(r.ids), r.decoded) for r in found), key=str) == sorted(expected, key=str)
    assert bytepair.encode_decode(docs.limit(0), queries.tokenizer_path(queries.BYTE_TOKENIZER)).count() == 0


def test_words_are_split_as_by_the_tokenizer(tokenizer):
    split = bytepair.splitter(queries.tokenizer_path(queries.BYTE_TOKENIZER)).words
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 997):  # every point, between words of each kind
        text = "".join(f"a{chr(c)}1{chr(c)} !{chr(c)}" for c in points[at : at + 997])
        assert split(text) == [text[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(text)]


def test_byte_pair_query(spark, tokenizer):
    rows = queries.op11_bytepair(spark, SMALL).collect()
    texts = dict(connect(SMALL).sql("SELECT doc_id, text FROM documents").fetchall())
    assert len(rows) == len(texts)
    for r in rows:
        ids = tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(decoded))


# --- manifest --------------------------------------------------------------------


def brute_manifest(rows):
    """Of rows (doc_id, source, lang, n_chars, text)."""

    def leaf(row):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    def tree(nodes):
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, path in enumerate(paths):
                run, slot = nodes[at[k] // 8 * 8 : at[k] // 8 * 8 + 8], at[k] % 8
                path.append(("".join(run[:slot]), "".join(run[slot + 1 :])))
                at[k] //= 8
            nodes = [sha("".join(nodes[k : k + 8])) for k in range(0, len(nodes), 8)]
        return nodes[0], paths

    groups = {}
    for row in rows:
        changed = row
        if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None:
            changed = (*row[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4]))
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf(row), leaf(changed), row[0]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names]
    if not trees:
        return []
    root, tops = tree([t[0] for t in trees])
    out = []
    for g, (subroot, paths), above in zip(names, trees, tops, strict=True):
        for row, path in zip(sorted(groups[g], key=lambda x: x[:3]), paths, strict=True):
            fold = row[3]
            for left, right in path + above:
                fold = sha(left + fold + right)
            proof = sha("".join(left + right for left, right in path + above))
            out.append((row[4], row[2], subroot, root, proof, fold, fold == root))
    return out


def manifest_rows(spark, rows):
    docs = spark.createDataFrame([(a, e, c, b, d, 1, "w", 2, "x") for a, b, c, d, e in rows], DOCS)
    return sorted(map(tuple, manifest.manifest(docs, tamper=True).collect()), key=str)


def test_manifest_on_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(manifest, "ROUND", 2)
    monkeypatch.setattr(manifest, "DIRECTORY_BITS", 3)
    draw = random.Random(3)
    ids = [None, -70, -5, 3, 4, 63, 64, 1 << 40, -(1 << 63), (1 << 63) - 1]
    langs = ["en"] * 12 + ["de", None, "", "é", "~", *(f"l{k}" for k in range(9))]
    rows = [
        (draw.choice(ids) if draw.random() < 0.2 else k * draw.choice((1, 37)), draw.choice(("a", None)), draw.choice(langs),
         draw.choice((1, None)), draw.choice(("Abc", "xyz", None, "", "É A")))
        for k in range(400)
    ]
    rows += rows[:40] + [rows[0]] * 70
    assert manifest_rows(spark, rows) == sorted(brute_manifest(rows), key=str)


def test_manifest_of_none_and_one(spark):
    assert manifest_rows(spark, []) == []
    one = [(5, "s", "en", 3, "Abc")]
    assert manifest_rows(spark, one) == brute_manifest(one)


def test_manifest_is_the_sql(spark):
    assert differences(queries.op12_manifest(spark, SMALL), connect(SMALL), ORACLES["op12_manifest"]) == []


# --- periodic runs -----------------------------------------------------------------


def brute_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            if j > i and n >= max(6, 4 * q):
                if not any(all(w[i + t] == w[i + t + p] for t in range(n - p)) for p in range(1, q)):
                    out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    w = [x for x in text.replace("\t", " ").replace("\n", " ").split(" ") if x]
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + m for s, m, q in found)]
    return (
        doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(kept)),
    )


def periodic_text(draw, size):
    w = []
    while len(w) < size:
        part = draw.choices("abc", k=draw.randint(1, 9))
        w += (part * draw.randint(1, 7))[: draw.randint(1, 60)] if draw.random() < 0.5 else part
    return " ".join(w)


@pytest.mark.parametrize("chunk", [1 << 16, 50])
def test_runs_by_rows(spark, monkeypatch, chunk):
    monkeypatch.setattr(periodic, "CHUNK", chunk)
    draw = random.Random(chunk)
    texts = ["", " ", "a", "a " * 6, "\n\t".join("aaaaaaa"), "a b " * 50, "x y z " * 3] + [periodic_text(draw, draw.randint(1, 200)) for _ in range(150)]
    rows = [(None if k == 4 else k, t, "en") for k, t in enumerate(texts)] + [(3, texts[3], "en")]
    docs = documents(spark, [*rows, (999, None, "en")])
    found = sorted(map(tuple, periodic.periodic_runs(docs, plant=True).collect()), key=str)
    assert found == sorted((brute_row(i, t or "") for i, t, _ in [*rows, (999, "", "en")]), key=str)
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


def test_runs_of_long_texts():
    found = periodic.text_runs([["a"] * 200_000, [], list("ab") * 50_000])
    assert [f.tolist() for f in found] == [[[0, 200_000, 1]], [], [[0, 100_000, 2]]]


def test_wavelet_answers():
    draw = np.random.default_rng(2)
    values = draw.permutation(300)
    tree = periodic.Wavelet(values)
    low = draw.integers(0, 299, 200)
    high = low + 1 + draw.integers(0, 300 - low)
    x = draw.integers(0, 300, 200)
    assert tree.below(low, high, x).tolist() == [int((values[a:b] < v).sum()) for a, b, v in zip(low, high, x, strict=True)]
    k = (high - low) // 2
    assert tree.nth(low, high, k).tolist() == [int(np.sort(values[a:b])[n]) for a, b, n in zip(low, high, k, strict=True)]


def test_run_query(spark):
    rows = queries.op13_periodic(spark, SMALL).collect()
    texts = dict(connect(SMALL).sql("SELECT doc_id, text FROM documents").fetchall())
    assert len(rows) == len(texts)
    short = [r for r in rows if len(texts[r.doc_id] or "") < 6000]
    assert len(short) > 100 and all(tuple(r) == brute_row(r.doc_id, texts[r.doc_id] or "") for r in short)
