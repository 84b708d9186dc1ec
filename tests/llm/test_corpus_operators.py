"""Archives, sharding, near-duplicates, decontamination, repeated passages and the pipeline."""

import hashlib
import random
import re
from collections import Counter

import pytest
from compare import connect

import corpus_pipeline
from forecourt.llm import decontamination, neardup, queries, sharding, substring, warc
from forecourt.llm.oracle import ORACLES

SMALL = "/root/testdata/sf0.001"

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, id long, band long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", 0, 1, 2, 3) for i, t in rows], DOCS)


PAGES = "page_id long, url string, html string, payload string, row long"


def archive(spark, rows):
    pages = spark.createDataFrame([(i, u, h, "x", 0) for i, u, h in rows], PAGES).repartition(2)
    path = warc.write_archive(warc.with_revisits(pages))
    return path, warc.read_archive(spark, path).collect()


def test_archive_round_trip(spark):
    fake = "WARC/1.0\r\nWARC-Type: response\r\nX-Page-Id: 666\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    long = "long payload " * 10
    rows = [
        (1, "u", "<p>ä 漢</p>"), (2, None, None), (3, "u\r\nX: y", ""), (4, "u", fake), (5, "u", fake + "rest" + fake),
        (6, "u", "WARC/1.0\r\n" * 30), (7, "u", "x\r\n\r\n" * 40), (8, "u", "WARC/1.0\r\nContent-Length: 10\r\n\r\n"),
        (12, "u", long), (11, "u", long), (13, "u", long), (11, "u", long), (14, "u", "same"), (15, "u", "same"), (None, "u", long),
        (16, "u", "y" * 300_000 + fake),
    ]
    _, found = archive(spark, rows)
    expected = Counter()
    for i, _, h in rows:
        body = (h or "").encode()
        expected[i, len(body), hashlib.sha256(body).hexdigest()] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in found) == expected
    kinds = Counter((r.page_id, r.record_type, r.refers_to) for r in found if r.page_id in (11, 12, 13, 14, 15, None))
    assert kinds == Counter(
        [(11, "response", None), (11, "revisit", 11), (12, "revisit", 11), (13, "revisit", 11), (None, "revisit", 11), (14, "response", None), (15, "response", None)]
    )


def test_archive_chain_crosses_splits(spark):
    rows = [(i, "u", f"{i} " + "WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * (i % 4) + "z" * (i * 37 % 900)) for i in range(300)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    pages = spark.createDataFrame([(i, u, h, "x", 0) for i, u, h in rows], PAGES).coalesce(1)
    path = warc.write_archive(warc.with_revisits(pages))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        found = warc.read_archive(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {r.page_id: r.payload_digest for r in found} == {i: hashlib.sha256(h.encode()).hexdigest() for i, _, h in rows}
    assert len(found) == 300


def test_archive_read_does_not_depend_on_splits(spark):
    rows = [(i, "u", f"{i} " + "WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * (i % 4) + "z" * (i * 37 % 900)) for i in range(300)]
    expected = {i: hashlib.sha256(h.encode()).hexdigest() for i, _, h in rows}
    path, _ = archive(spark, rows)
    old = spark.conf.get("spark.sql.files.minPartitionNum", None)
    try:
        for parts in ("2", "40"):
            spark.conf.set("spark.sql.files.minPartitionNum", parts)
            found = warc.read_archive(spark, path)
            # The rows are made lazily: the last plan runs with other splits than the ones before.
            spark.conf.set("spark.sql.files.minPartitionNum", "17")
            assert {r.page_id: r.payload_digest for r in found.collect()} == expected
    finally:
        spark.conf.set("spark.sql.files.minPartitionNum", old) if old else spark.conf.unset("spark.sql.files.minPartitionNum")


def test_archive_empty(spark):
    assert archive(spark, [])[1] == []


def test_sharding(spark):
    names = [f"s{k}" for k in range(7)]
    owner = sharding.fill(names, 503)
    assert set(Counter(owner).values()) <= {71, 72}
    # By turns, in each shard's own order.
    taken = {}
    order = {
        n: [(sharding._number(f"offset:{n}") + j * (sharding._number(f"step:{n}") % 502 + 1)) % 503 for j in range(503)] for n in names
    }
    while len(taken) < 503:
        for k, n in enumerate(names):
            free = next((s for s in order[n] if s not in taken), None)
            if free is not None:
                taken[free] = k
    assert [taken[s] for s in range(503)] == owner
    fewer = sharding.fill(names[:-1], 503)
    moved = sum(a != b for a, b in zip(owner, fewer, strict=True) if a != 6)
    assert moved < 0.25 * 503
    rows = [(k, "a", 1, "b") for k in [None, 1, 1, 2**62, -5]]
    df = spark.createDataFrame(rows, "doc_id long, source string, slot int, shard string")
    found = sharding.place(df, "doc_id", names, 503).collect()
    for r in found:
        key = "" if r.doc_id is None else str(r.doc_id)
        assert r.slot == int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 503 and r.shard == names[owner[r.slot]]
    assert len(found) == 5 and sharding.place(df.limit(0), "doc_id", names, 503).count() == 0
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.fill(bad)
    with pytest.raises(ValueError):
        sharding.fill(names, 504)


def brute_components(rows, size, percent):
    def shingles(text):
        found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(found[i : i + size]) for i in range(max(1, len(found) - size + 1))} if found else set()

    sets = [shingles(t) for _, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, _) in enumerate(rows):
        for y, (j, _) in enumerate(rows[:x]):
            both = len(sets[x] & sets[y])
            if None not in (i, j) and both and 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return sorted(((i, len(s), top(i) if i is not None else None) for (i, _), s in zip(rows, sets, strict=True)), key=str)


def near_rows(seed):
    draw = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, bases = [], [[draw.choice(vocabulary) for _ in range(draw.randint(2, 120))] for _ in range(12)]
    for n in range(160):
        text = list(draw.choice(bases))
        for _ in range(draw.randint(0, max(1, len(text) // 12))):
            text[draw.randrange(len(text))] = draw.choice(vocabulary)
        rows.append((n, " ".join(text).title() if n % 3 else " ".join(text)))
    return rows + [(200, ""), (201, None), (202, " \n"), (203, "one"), (204, "ONE"), (205, "é É"), (206, "big " * 50_000)]


@pytest.mark.parametrize(("size", "seed"), [(2, 1), (5, 2)])
def test_near_duplicates(spark, size, seed):
    rows = near_rows(seed)
    found = neardup.near_duplicates(documents(spark, rows), size, 0.8)
    assert sorted([tuple(r) for r in found.collect()], key=str) == brute_components(rows, size, 80)


def test_near_duplicates_with_repeated_ids(spark):
    rows = [(1, "a b c d"), (1, "e f g h"), (2, "e f g h"), (3, "a b c d"), (None, "a b c d"), (4, "x"), (4, "x"), (5, None), (5, "")]
    found = Counter((r.doc_id, r.component_id) for r in neardup.near_duplicates(documents(spark, rows), 2).collect())
    assert found == Counter([(1, 1), (1, 1), (2, 1), (3, 1), (None, None), (4, 4), (4, 4), (5, 5), (5, 5)])
    kept = neardup.keep_one(documents(spark, rows), 2)
    assert kept.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 4, 5, None]
    assert neardup.near_duplicates(documents(spark, [])).count() == 0


def test_members_beyond_the_star_are_linked(spark, monkeypatch):
    """Blocks link what the smallest document of a bucket does not reach."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(neardup, "_bands", lambda least: neardup.np.zeros(1, neardup.np.int64))
    rows = [(k, t) for k, t in near_rows(3) if k < 60]
    found = neardup.near_duplicates(documents(spark, rows), 2, 0.8)
    assert sorted([tuple(r) for r in found.collect()], key=str) == brute_components(rows, 2, 80)


def test_components(spark):
    draw = random.Random(7)
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 160)] + [(draw.randint(200, 260), draw.randint(200, 260)) for _ in range(40)]
    found = {r.id: r.root for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {v: v for e in edges for v in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert found == {v: r for v, r in root.items() if any(v in e and e[0] != e[1] for e in edges)}


def brute_contamination(docs, items, window=13):
    def terms(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    out = []
    for i, text in docs:
        found, hit, names = terms(text), set(), set()
        for item, body in items:
            w = terms(body)
            for s in range(max(1, len(w) - window + 1)) if w else []:
                part = w[s : s + window]
                for at in range(len(found) - len(part) + 1):
                    if found[at : at + len(part)] == part:
                        hit.update(range(at, at + len(part)))
                        names.add(str(item))
        sha = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((i, len(found), len(hit), len(names), sha, bool(hit) and 20 * len(hit) >= len(found)))
    return sorted(out, key=str)


def test_decontamination(spark):
    draw = random.Random(8)
    vocabulary = ["the", "of", "a", "É", "x1"]
    items = [(k, " ".join(draw.choices(vocabulary, k=draw.randint(1, 20)))) for k in range(12)] + [(50, None), (51, ""), (52, "The-Of"), (52, "a a a a a")]
    docs = [(k, ", ".join(draw.choices(vocabulary, k=draw.randint(1, 90)))) for k in range(40)]
    docs += [(60 + k, "zz " * 300 + items[k][1] + " yy" * 20) for k in range(6)]
    docs += [(90, None), (90, ""), (91, "..."), (None, items[3][1]), (92, "the of"), (92, "the of"), (93, "the " * 2000)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.contamination(documents(spark, docs), bench).drop("row")
    assert sorted([tuple(r) for r in found.collect()], key=str) == brute_contamination(docs, items)
    clean = decontamination.drop_contaminated(documents(spark, docs), bench)
    bad = {r[0] for r in brute_contamination(docs, items) if r[5]}
    assert sorted((r.doc_id for r in clean.collect()), key=str) == sorted((i for i, _ in docs if i not in bad), key=str)
    assert decontamination.contamination(documents(spark, docs), bench.limit(0)).filter("n_hit > 0").count() == 0
    assert decontamination.contamination(documents(spark, []), bench).count() == 0


def test_proximity(spark):
    draw = random.Random(9)
    docs = [(k, " ".join(draw.choices("abcdefghij", k=40))) for k in range(20)]
    items = [(0, "a b c"), (1, "j i h g")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    wanted = decontamination.phrases(bench)
    index = decontamination.Index(documents(spark, docs), wanted)
    near = index.near(6).join(index.rows, "row").join(wanted, "phrase")
    found = {(r.doc_id, r.item_id) for r in near.collect()}
    truth = set()
    for i, text in docs:
        w = text.split()
        for item, body in items:
            need = set(body.split())
            if any(need <= set(w[s : s + 6]) for s in range(len(w))):
                truth.add((i, str(item)))
    assert found == truth


def brute_repeats(rows, window):
    found = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in found:
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            rank = (i is None, i or 0)
            first[key] = min(first.get(key, rank), rank)
    out = []
    for i, w in found:
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (i is None, i or 0):
                gone.update(range(s, s + window))
        body = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [40, 1_000_000])
def test_substrings(spark, monkeypatch, block):
    monkeypatch.setattr(substring, "BLOCK", block)
    monkeypatch.setattr(substring, "BUCKET", 100)
    monkeypatch.setattr(substring, "GROUP", 3)
    draw = random.Random(10)
    passage = [f"p{k}" for k in range(30)]
    rows = []
    for n in range(60):
        text = draw.choices(["a", "b", "c", "d", "É"], k=draw.randint(0, 40))
        if n % 3 == 0:
            at, size = draw.randint(0, 15), draw.randint(5, 15)
            text[5:5] = passage[at : at + size]
        rows.append((n - 5, " ".join(text)))
    rows += [(100, ""), (100, None), (None, rows[3][1]), (None, rows[3][1]), (7, rows[2][1]), (2**62, rows[9][1]), (101, "a " * 3000)]
    found = substring.remove_repeats(documents(spark, rows), window=8)
    assert sorted([tuple(r) for r in found.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()], key=str) == brute_repeats(rows, 8)
    assert substring.remove_repeats(documents(spark, [])).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    found = queries.QUERIES[name](spark, SMALL)
    result = connect(SMALL).execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(found.columns)
    assert Counter(tuple(map(str, r)) for r in result.fetchall()) == Counter(tuple(str(r[c]) for c in columns) for r in found.collect())


def test_pipeline_stages(spark):
    """Each stage's decisions, against plain Python over its own input."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "neardup", "decontamination", "pii", "packing"]

    def step(name, df):
        out = stages[name](spark, df, SMALL)
        if name != "packing":
            assert out.columns == docs.columns
        return corpus_pipeline.stored(out)

    good = step("quality", docs)
    judged = {r.doc_id: r.kept for r in queries.op4_quality(spark, SMALL).collect()}
    assert {r.doc_id for r in good.collect()} == {i for i, kept in judged.items() if kept}
    single = step("neardup", good)
    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert {r.doc_id for r in single.collect()} == {r[2] for r in brute_components(rows, 5, 80)}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    clean = step("decontamination", single)
    rows = [(r.doc_id, r.text) for r in single.collect()]
    assert {r.doc_id for r in clean.collect()} == {r[0] for r in brute_contamination(rows, items) if not r[5]}
    private = step("pii", clean)
    before, after = {r.doc_id: r.text for r in clean.collect()}, {r.doc_id: r for r in private.collect()}
    spans = {r.doc_id: r.spans for r in __import__("forecourt.llm.pii", fromlist=["scan"]).scan(clean).collect()}
    assert all((after[i].text == t) == (not spans[i]) and after[i].n_chars == len(after[i].text) for i, t in before.items())
    packed = step("packing", private)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(after)
