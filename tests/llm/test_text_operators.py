"""Packing, pages, quality rules, personal data, secrets: against brute force and hand-made cases."""

import base64
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from forecourt.llm import html, packing, pii, quality, secrets, tokens
from forecourt.llm.tagger import Tagger

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

DOCS = "doc_id long, text string, lang string, source string, n_chars long, part int, queue string, row long"


def documents(spark, texts, sources=None):
    """Rows with columns whose names also occur inside the operators."""
    rows = [(i, t, "en", (sources or ["a"] * len(texts))[i], 0, 9, "q", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = ["", None, "a", "  \n\t ", "word " * 3000, "x" * 200_000, "Ünï çødé 漢字 🙂 don't I'LL <|endoftext|>", "a\x1cb\x85c\xa0d"]


def test_ids_are_the_tokenizers():
    whole = Tokenizer.from_file(TOKENIZER)
    draw = random.Random(1)
    alphabet = [chr(i) for i in range(1, 0x250)] + list("'<|>trelvsdm ") * 20
    texts = [t or "" for t in ODD] + ["".join(draw.choices(alphabet, k=300)) for _ in range(300)]
    for text in texts:
        found = np.frombuffer(tokens.encode(TOKENIZER, text), "<u4").tolist()
        assert found == whole.encode(text, add_special_tokens=False).ids


def test_words_of_one_piece_are_learnt_once():
    encoder = tokens.Encoder(TOKENIZER)
    encoder.encode("haus Haus katze")
    assert not {"haus", "katze"} & encoder.pieces.keys()
    found = np.frombuffer(encoder.encode("(haus) hund, hund Hund!"), "<u4").tolist()
    assert found == Tokenizer.from_file(TOKENIZER).encode("(haus) hund, hund Hund!", add_special_tokens=False).ids
    assert encoder.words["hund"] is encoder.pieces["hund"]


@pytest.mark.parametrize("targets", [None, {"a": 2.0, "b": 1.0}, {"none": 1.0}])
def test_packing_covers_every_id_once(spark, targets):
    draw = random.Random(2)
    texts = ODD + [" ".join(draw.choices(["alpha", "beta", "gamma7"], k=draw.randint(1, 400))) for _ in range(60)]
    sources = [draw.choice(["a", "a", "a", "b", "c", None]) for _ in texts]
    rows = packing.pack(documents(spark, texts, sources), TOKENIZER, window=256, targets=targets).collect()
    ids = [np.frombuffer(tokens.encode(TOKENIZER, t or ""), "<u4").tolist() + [1] for t in texts]
    by_doc, by_window = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_window.setdefault(r.sequence_id, []).append(r)
    assert sorted(by_doc) == list(range(len(texts)))
    for doc, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids[doc])
            assert p.ids_crc32 == zlib.crc32(np.array(ids[doc][at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids[doc])
    assert sorted(by_window) == list(range(len(by_window)))
    for w, pieces in by_window.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 256 or w == len(by_window) - 1


def test_windows_hold_the_target_shares():
    totals = [50_000, 30_000, 19_990, 10]
    phases = packing.schedule(totals)
    share = {}
    for q, n in enumerate(totals):
        for _, _, length, w, _ in packing.cut(phases, 1000, q, np.array([0]), np.array([n])).T:
            share[q, w] = share.get((q, w), 0) + length
    for w in range(100):
        for q, n in enumerate(totals):
            assert abs(share.get((q, w), 0) - n / 100) <= 3  # deficits stay below the tree's depth, on both sides
    weighted = packing.schedule(totals, [1.0, 1.0, 0.0, 0.0])
    assert [sorted(p.amount) for p in weighted] == [[0, 1], [0], [2, 3]]
    large = packing.schedule([10**13, 3 * 10**12])
    cut = packing.cut(large, 2048, 1, np.array([10**12]), np.array([5000]))
    assert cut[2].sum() == 5000 and (cut[3] > 0).all()


def test_rows_of_all_queues_are_cut_at_once():
    totals = [5, 90_000, 0, 7_000, 1, 30_000]
    phases = packing.schedule(totals)
    queue = np.repeat([3, 1, 5, 0, 4], [2, 3, 2, 1, 1])
    count = np.array([3_000, 4_000, 1, 60_000, 29_999, 10_000, 20_000, 5, 1])
    first = np.array([0, 3_000, 0, 1, 60_001, 0, 10_000, 0, 0])
    alone = []
    for q in np.unique(queue):
        rows = np.flatnonzero(queue == q)
        part = packing.cut(phases, 512, int(q), first[rows], count[rows])
        part[0] = rows[part[0]]
        alone.append(part)
    together = packing.cut_small(phases, 512, queue, [[]] * len(queue), first, count)
    assert sorted(map(tuple, np.concatenate(alone, axis=1).T)) == list(map(tuple, together.T))


def test_packing_empty_table(spark):
    assert packing.pack(documents(spark, []), TOKENIZER).count() == 0


@pytest.mark.parametrize("own_queue", [4, 4096])
def test_packing_mixes_many_small_sources(spark, monkeypatch, own_queue):
    monkeypatch.setattr(packing, "OWN_QUEUE", own_queue)
    draw, tail, per = random.Random(4), 300, 2
    sources = [f"site{k}" for k in range(tail) for _ in range(per)] + ["big"] * 40
    texts = [" ".join(draw.choices(["alpha", "beta"], k=20 if s != "big" else 300)) for s in sources]
    docs = documents(spark, texts, sources).repartition(3)
    rows = packing.pack(docs, TOKENIZER, window=1024).collect()
    ids = [np.frombuffer(tokens.encode(TOKENIZER, t), "<u4").tolist() + [1] for t in texts]
    size = sum(map(len, ids))
    total, spent, filled, pieces = {}, {}, {}, {}
    for s, i in zip(sources, ids, strict=True):
        total[s] = total.get(s, 0) + len(i)
    for r in rows:
        spent[r.source, r.sequence_id] = spent.get((r.source, r.sequence_id), 0) + r.length
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    for doc, found in pieces.items():
        at = 0
        for start, length, crc in sorted(found):
            assert start == at and crc == zlib.crc32(np.array(ids[doc][at : at + length], "<u4").tobytes())
            at += length
        assert at == len(ids[doc])
    assert len(pieces) == len(texts) and sorted(filled) == list(range(-(-size // 1024)))
    for w, found in filled.items():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at == min(1024, size - 1024 * w)
    for s, n in total.items():
        sofar = 0
        for w in range(size // 1024):
            sofar += spent.get((s, w), 0)
            assert abs(sofar - n * 1024 * (w + 1) / size) <= 14  # below the depth of both trees


def test_packing_small_source_holds_its_own_target(spark, monkeypatch):
    monkeypatch.setattr(packing, "OWN_QUEUE", 4)
    sources = ["big"] * 30 + ["one"] * 2 + ["two"] * 2
    texts = ["alpha " * 300 if s == "big" else "alpha " * 40 for s in sources]
    rows = packing.pack(documents(spark, texts, sources), TOKENIZER, window=100, targets={"big": 0.6, "one": 0.3, "two": 0.1}).collect()
    first = {}
    for r in rows:
        if r.sequence_id == 0:
            first[r.source] = first.get(r.source, 0) + r.length
    assert all(abs(first.get(s, 0) - n) <= 3 for s, n in {"big": 60, "one": 30, "two": 10}.items())


def test_pages():
    chain = html.trained()
    page = (
        "<html><head><title>t</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/x'>Menu</a></ul></nav>"
        "<!-- no --><div class='ad'>Buy this now.</div><article><h1>A &amp; B title of the page</h1><p>One <b>two\n three.<br>Four."
        "<p>Unclosed &lt;tag&gt; text, which goes on for a while. It has sentences.</article>"
        "<div class=comments><p>I like this.</p></div><footer>&copy; me</footer>"
    )
    assert html.main_text(chain, page) == (
        "A & B title of the page\n\nOne two three. Four.\n\nUnclosed <tag> text, which goes on for a while. It has sentences."
    )
    for odd in ("", None, "<", "<!--", "<p", "<script>x", "<<<>>>", "<p>" * 5000, '<a href="x' + "y" * 1000):
        assert isinstance(html.main_text(chain, odd), str)


@pytest.mark.parametrize("tag", ["svg", "math", "object", "select", "noscript"])
def test_unclosed_element_keeps_the_rest_of_the_page(tag):
    page = f"<div><p>Before it.</p><{tag} class=x></div><div><p>After it.</p><noscript><p>Hidden.</p></noscript><p>Last.</p></div>"
    assert [b.text for b in html.blocks(page)] == ["Before it.", "After it.", "Last."]
    assert [b.text for b in html.blocks(f"<p>One <{tag}>two")] == ["One two"]


def test_math_and_object_text_stay_and_unseen_text_goes():
    page = (
        "<article><p>Where <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds <svg><text>no</text></svg>here.</p><object data=a><p>Fallback.</p></object>"
        "<div><noscript><div>no</div></noscript>Shown.<select><option>no<option>no</select></div><svg><svg></svg><title>no</title></svg></article>"
    )
    assert [b.text for b in html.blocks(page)] == ["Where x=1 holds here.", "Fallback.", "Shown."]
    assert isinstance(html.blocks("<svg>" * 5000), list)


def test_quotes_in_tags_start_after_an_equals_sign():
    page = "<p><a href=/x title=Bob's>link</a> first part.</p><p>Second it's here</p>"
    assert [b.text for b in html.blocks(page)] == ["link first part.", "Second it's here"]
    page = "<p><a href=/x?a='b rel=c>link</a> one.</p><p title = 'a > b' data-x=\"c > d\">It's two.</p>"
    assert [b.text for b in html.blocks(page)] == ["link one.", "It's two."]


def test_short_comments_end_where_they_should():
    def texts(page):
        return [b.text for b in html.blocks(page)]

    assert texts("<p>one</p><!--><p>two</p><!-- c --><p>three</p>") == ["one", "two", "three"]
    assert texts("<p>one</p><!-- x --!><p>two</p><!---><p>three</p>") == ["one", "two", "three"]
    assert texts("<p>one</p><!-- x <p>two</p>") == ["one"]
    page = html.blocks("<div class=nav/><p>menu</p></div><p>text</p>")
    assert [len(b.path) for b in page] == [2, 1] and "nav" in page[0].path[0][1]


def test_pages_held_out():
    chain, right, total = html.trained(), 0, 0
    for fs, truth in html.labelled(150, seed=99):
        found = chain.decode(fs)
        right += sum(a == b for a, b in zip(found, truth, strict=True))
        total += len(truth)
    assert right / total > 0.98


def test_chain_decodes_the_best_path():
    chain, draw = html.Chain(), np.random.default_rng(0)
    chain.move = draw.normal(size=(2, 2))
    fs = [[f"f{k}"] for k in range(7)]
    chain.weights = {f"f{k}": float(draw.normal()) for k in range(7)}

    def score(path):
        emit = sum(chain.weights[f"f{k}"] * y for k, y in enumerate(path))
        return emit + sum(chain.move[a, b] for a, b in zip(path, path[1:], strict=False))

    paths = [[(n >> k) & 1 for k in range(7)] for n in range(128)]
    assert chain.decode(fs) == max(paths, key=score)


def test_pages_query_handles_odd_rows(spark):
    rows = [(1, None, None, "x"), (1, "u", "", "x"), (None, "u", "<p>a</p>", "x")]
    found = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert found.columns == ["page_id", "url", "text", "n_chars"] and found.count() == 3


def brute_stats(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    triples = [tuple(found[i : i + 3]) for i in range(len(found) - 2)]
    hit = {i + k for i, t in enumerate(triples) if triples.count(t) > 1 for k in range(3)}
    return (
        len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines),
        sum(x in lines[:i] for i, x in enumerate(lines)), len(hit),
    )


def test_text_stats():
    draw = random.Random(3)
    texts = ["", None, "  ", "a\n\na\n a\na", "a b c a b c", "x\x1cy \x85 #*|"]
    texts += ["".join(draw.choices(["a ", "b ", "c\n", "d# ", "é\t"], k=draw.randint(1, 60))) for _ in range(300)]
    for text in texts:
        assert quality.text_stats(text) == brute_stats(text)


def test_binomial_tail():
    for n, k, p in ((10, 3, 0.2), (50, 0, 0.05), (400, 9, 0.02), (5, 5, 0.1)):
        exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert quality.chance_of_fewer(k, n, p) == pytest.approx(exact)


def test_cutoffs_hold_the_risk():
    good, bad = np.zeros(quality.STEPS + 1, int), np.zeros(quality.STEPS + 1, int)
    good[0], good[40], bad[60] = 5000, 4, 300
    assert quality.choose(good, bad, 0.005, 0.001) in range(41, 61)
    good[60] = 400  # every useful cutoff now rejects too many
    assert quality.choose(good, bad, 0.005, 0.001) == 0
    assert quality.choose(good // 1000, bad, 0.005, 0.001) == 0  # too few to prove anything


def test_quality_rules_on_rows(spark):
    draw = random.Random(4)
    plain = [" ".join("".join(draw.choices("abcdefgh", k=5)) for _ in range(60)) for _ in range(1500)]
    junk = [t.replace(" ", "### ") for t in plain[:200]]
    texts = plain + junk + ODD
    docs = documents(spark, texts)
    labels = [(i, 1, 0) for i in range(1500)] + [(1500 + i, 0, 0) for i in range(150)]
    labels += [(10, 1, 0), (None, 1, 0), (99_999, 0, 0), (11, None, None)]
    labels = spark.createDataFrame(labels, "doc_id long, quality long, toxic long")
    judged, stats, failed, kept = quality.judge(docs, labels, risk=0.05)
    rows = {r.doc_id: r for r in judged.collect()}
    assert len(rows) == len(texts)
    assert all(rows[i][kept] for i in range(1500)) and not any(rows[1500 + i][kept] for i in range(200))
    assert all(rows[1700 + i][failed] and not rows[1700 + i][kept] for i in range(len(ODD)))
    good = quality.keep_good(docs, labels, risk=0.05)
    assert good.columns == docs.columns and good.count() == 1500
    none = quality.keep_good(docs, labels.limit(0))
    assert none.count() == 1700
    assert quality.keep_good(docs.limit(0), labels).count() == 0


def test_repeated_documents_prove_nothing(spark):
    draw = random.Random(9)
    plain = [" ".join("".join(draw.choices("abcdefgh", k=5)) for _ in range(60)) for _ in range(20)]
    junk = [t.replace(" ", "### ") for t in plain[:10]]
    for ids in (range(30), range(9000)):  # repeated rows, then exact copies under several ids
        rows = [(i if len(ids) > 30 else i % 30, (plain + junk)[i % 30]) for i in range(9000)]
        docs = spark.createDataFrame([(i, t, "en", "a", 0, 9, "q", 7) for i, t in rows], DOCS)
        labels = spark.createDataFrame([(i, int(i % 30 < 20), 0) for i in ids], "doc_id long, quality long, toxic long")
        assert quality.keep_good(docs, labels, risk=0.05).count() == 9000


def brute_base(text):
    """The contract's patterns, written out again; no part of the operator's code."""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[\w.%+-]+@[a-zA-Z0-9-]+(?:\.[a-zA-Z0-9-]+)+", text, re.ASCII)]
    for m in re.finditer(r"\d+\.\d+\.\d+\.\d+", text, re.ASCII):
        if all(len(p.lstrip("0")) <= 3 and int("0" + p.lstrip("0")) < 256 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"\d(?:[ -]?\d)+", text, re.ASCII):
        digits = [int(c) for c in m[0] if c.isdigit()]
        doubled = [sum(divmod(2 * d, 10)) for d in digits[-2::-2]]
        if 16 <= len(digits) <= 19 and (sum(digits[::-2]) + sum(doubled)) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+\d[ ().\d-]+\d", text, re.ASCII):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def test_long_runs_take_linear_time():
    for text in ("1" * 1_000_000, "1." * 500_000, "eyJ" * 333_333, "v 1.1.1." + "0" * 5_000, "a@b.co +1 988 555 2485 " * 40_000):
        start = time.perf_counter()
        found = pii.base_spans(text)
        secrets.find(text)
        assert time.perf_counter() - start < 5
    assert found[-1][0] == "phone" and pii.base_spans("v 1.1.1." + "0" * 5_000) == [("ip", 2, 5_008)]
    assert pii.base_spans("1.1.1." + "0" * 5_000 + "256") == []
    tagger = pii.trained()
    start = time.perf_counter()
    pii.all_spans(tagger, ["1" * 1_000_000, "a@b.co +1 988 555 2485 " * 40_000])
    assert time.perf_counter() - start < 30


def test_base_patterns():
    draw = random.Random(5)
    pieces = ["a@b.co", "@", ".", "x.y@z", "1.2.3.4", "999.1.1.1", "+1 (988) 555-2485", "4111 1111 1111 1111", "4", " ", "-", "é", "\n"]
    texts = ["", "joe@a.b@c.d", "@@", "a@b", "4532015112830366", "0.0.0.00256"] + ["".join(draw.choices(pieces, k=12)) for _ in range(500)]
    for text in texts:
        assert pii.base_spans(text) == brute_base(text)


def test_tagger_gradient_and_viterbi():
    tagger = Tagger(3, 3, 4)
    tagger.weights = {k: v.astype(np.float64) for k, v in tagger.weights.items()}
    draw = np.random.default_rng(1)
    x, y = draw.integers(1, 100, (3, 6)), draw.integers(0, 3, (3, 6))
    _, grad = tagger.gradient(x, y)
    for name, w in tagger.weights.items():
        at = (int(x[0, 2]), 1) if name == "embed" else tuple(int(draw.integers(0, s)) for s in w.shape)
        old = w[at]
        w[at] = old + 1e-4
        up = tagger.gradient(x, y)[0]
        w[at] = old - 1e-4
        down = tagger.gradient(x, y)[0]
        w[at] = old
        assert grad[name][at] == pytest.approx((up - down) / 2e-4, rel=1e-3, abs=1e-5)
    scores = tagger._scores(x, False)[0]
    move, paths = tagger.weights["move"], np.array(np.meshgrid(*[range(3)] * 6)).reshape(6, -1).T
    for b, best in enumerate(tagger.decode(x)):
        value = [sum(scores[t, b, p[t]] for t in range(6)) + sum(move[p[t], p[t + 1]] for t in range(5)) for p in paths]
        assert best.tolist() == paths[int(np.argmax(value))].tolist()


def test_tagger_adds_what_patterns_miss():
    tagger = pii.trained()
    text = "call (988) 555-2485 or joe [at] mail [dot] example.com, card 3782 822463 10005, host 2001:db8::1, v1.2.3 of 2024-01-02 for 1,299.00 and bob@x.org ok. "
    values = {text[a:b] for _, a, b in pii.all_spans(tagger, [text])[0][1]}
    assert values == {"(988) 555-2485", "joe [at] mail [dot] example.com", "3782 822463 10005", "2001:db8::1", "bob@x.org"}
    # The same span wherever it lies among the windows.
    for lead in range(0, 120, 7):
        moved = "w" * lead + " " + text * 3
        spans = pii.all_spans(tagger, [moved])[0][1]
        assert sum(moved[a:b] == "bob@x.org" for _, a, b in spans) == 3
    x, y = pii.examples(300, 64, seed=123)
    found = tagger.decode(x)
    assert ((found > 0) & (y > 0)).sum() / (y > 0).sum() > 0.85


def test_personal_data_rows(spark):
    texts = [*ODD, "mail bob@x.org now", "mail bob@x.org now"]
    docs = documents(spark, texts)
    rows = {r.doc_id: r for r in pii.scan(docs).collect()}
    assert len(rows) == len(texts) and rows[8].n_email == rows[9].n_email == 1 and rows[1].spans == ""
    clean = pii.redacted(docs)
    assert clean.columns == docs.columns
    kept = {r.doc_id: r.text for r in clean.collect()}
    assert kept[8] == "mail [email] now" and [kept[i] for i in range(8)] == ODD
    assert pii.scan(docs.limit(0)).count() == 0


def brute_secrets(text):
    out = []
    for kind, pattern, least, group in (
        ("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
        ("access", r"AKIA[A-Z0-9]+", 20, 0),
        ("hex", r"[0-9a-f]+", 24, 0),
    ):
        out += [(m.start(), m.end(), kind) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    rank = ("assign", "access", "hex").index
    return sorted(out, key=lambda s: (s[0], rank(s[2])))


def test_secrets():
    draw = random.Random(6)
    pieces = ["password", "PassWd", "secret", "toKen", "api_key", "APIKEY", "apikey", "=", ": ", '"', "abc", "abcdef0", "AKIA", "A1B2C3D4E5", "0123456789abcdef", " ", "İ", "K"]
    for _ in range(2000):
        text = "".join(draw.choices(pieces, k=draw.randint(1, 14)))
        assert [s for s in secrets.find(text) if s[2] in secrets.KINDS[:3]] == brute_secrets(text)
    body = "z" * 30
    head, other = '{"alg":"HS256"}', '{"typ":"nothing"}'
    coded = [base64.urlsafe_b64encode(h.encode()).decode().rstrip("=") for h in (head, other)]
    tokens = [f"{c}.eyJzdWIiOiIxMjM0In0.{'s' * 20}" for c in coded]
    assert [s[2] for s in secrets.find(" ".join(tokens))] == ["jwt"]
    assert secrets.find("eyj" + tokens[0])[0][2] == "jwt"  # a failed start in the same run hides none
    keys = [base64.b64encode(b"\x30\x82" + size.to_bytes(2, "big") + bytes(300)).decode() for size in (300, 299)]
    blocks = [f"-----BEGIN RSA PRIVATE KEY-----\n{k}\n-----END RSA PRIVATE KEY-----" for k in keys]
    assert [s[:2] for s in secrets.find("\n".join(blocks)) if s[2] == "pem"] == [(0, len(blocks[0]))]
    good = f"ghp_{body}{secrets.base62_crc(body)}"
    assert secrets.find(f"x {good} y") == [(2, 42, "github")]
    assert secrets.find(f"x ghp_{body}000000 y") == []
    assert secrets.redact(f"x {good} y", secrets.find(f"x {good} y")) == "x [github] y"


def test_secret_rows(spark):
    docs = documents(spark, [*ODD, "token = abcdef1"])
    rows = {r.doc_id: r for r in secrets.scan(docs).collect()}
    assert len(rows) == 9 and rows[8].n_assign == 1 and rows[8].spans == "assign:0:15" and rows[1].spans == ""
    assert secrets.scan(docs.limit(0)).count() == 0
