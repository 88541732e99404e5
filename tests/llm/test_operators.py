"""Each operator against brute force or an exact round trip, and on the edge cases of conftest."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tillcast.llm import (bpe, components, langid, line_dedup, mixing, order_minhash, quality, rabitq, stages, superminhash,
                          toxicity, warc)

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def similar(a, b):
    both = len(a & b)
    return bool(a) and bool(b) and 100 * both >= 80 * (len(a) + len(b) - both)


def reach(n, links):
    low = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    low = reach(200, links)
    assert got == {v: low[v] for a, b in links if a != b for v in (a, b)}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_line_dedup(spark, docs, empty):
    rows = docs.select("doc_id", "text").collect()
    lines = sorted(((r["doc_id"] if r["doc_id"] is not None else 1 << 62, k, frozenset(WORD.findall(lower(x))))
                    for r in rows for k, x in enumerate((r["text"] or "").split("\n"))), key=lambda x: x[:2])
    lines = [x for x in lines if x[2]]
    gone = {(d, k) for d, k, s in lines if any(similar(s, t) for e, j, t in lines if (e, j) < (d, k))}
    got = line_dedup.removals(docs).collect()
    assert len(got) == len(rows)
    assert {(r["id"] if r["id"] is not None else 1 << 62, k) for r in got for k in r["removed"]} == gone
    kept = {r["doc_id"]: r["text"] for r in line_dedup.dedup(docs).collect()}
    assert 2 not in kept and kept[10] == "Été à la plage" and kept[4] is None and kept[5] == ""
    assert line_dedup.dedup(docs).columns == docs.columns
    assert line_dedup.removals(empty).count() == 0


def test_line_matches(spark, monkeypatch):
    """Classes and links of all lines against brute force, with large words and several blocks."""
    rng = random.Random(11)
    rows = []
    for g in range(8):
        base = [f"g{g}w{i}" for i in range(rng.choice([6, 12, 40]))]
        for _ in range(14):
            words = list(base)
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(6)}"
            rows.append((len(rows), "common words " + " ".join(words) + f"\nline {len(rows) % 5}"))
    rows.append((None, rows[0][1]))
    lines = [((d if d is not None else 1 << 62, k), frozenset(WORD.findall(x))) for d, t in rows for k, x in enumerate(t.split("\n"))]
    lines.sort(key=lambda x: x[0])
    link = [(i, j) for i in range(len(lines)) for j in range(i) if similar(lines[i][1], lines[j][1])]
    low, n = reach(len(lines), link), [0] * len(lines)
    for i, j in link:
        n[i] += 1
        n[j] += 1
    want = {lines[i][0]: (*lines[low[i]][0], n[i]) for i in range(len(lines)) if n[i]}
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(line_dedup, "LARGE", 4)
    monkeypatch.setattr(line_dedup, "BLOCK_WORDS", 60)
    monkeypatch.setattr(line_dedup, "HOT_CLASS", 6)
    got = line_dedup.matches(df).collect()
    key = lambda x: x if x is not None else 1 << 62
    assert {(key(r["id"]), m["line"]): (key(m["class_id"]), m["class_line"], m["n_links"]) for r in got for m in r["matches"]} == want
    assert {(key(r["id"]), k) for r in got for k in r["removed"]} == {lines[i][0] for i, _ in link}


def test_order_minhash(docs, empty):
    texts = ["", "a", "abcdefghij" * 30, "abcdefghij" * 30, "the quick brown fox " * 300]
    sig, chars = order_minhash.fingerprints(pa.array(texts, pa.large_string()))
    alone = np.concatenate([order_minhash.fingerprints(pa.array([t], pa.large_string()))[0] for t in texts])
    assert (sig == alone).all() and list(chars) == [len(t) for t in texts] and (sig[2] == sig[3]).all()
    words = [f"{random.Random(i).random():.9f}" for i in range(400)]
    a, near, swapped = " ".join(words), " ".join(words[:200] + ["changed"] + words[201:]), " ".join(words[200:] + words[:200])
    f = order_minhash.fingerprints(pa.array([a, near, swapped], pa.large_string()))[0]
    near, swapped = order_minhash.likeness(f[:1], f[1:2])[0], order_minhash.likeness(f[:1], f[2:])[0]
    assert near > 0.9 > 0.75 > swapped
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    t = [r["text"] or "" for r in rows]
    want = sorted(hashlib.sha256((x[: len(x) - len(x) // 2] + y[: len(x) // 2]).encode()).hexdigest() for x, y in zip(t, t[1:] + t[:1]))
    assert sorted(r["edited_sha256"] for r in order_minhash.compare(docs).collect()) == want
    assert order_minhash.compare(empty).count() == 0


def _labelled(spark, seed=5, n=600):
    """Synthetic labelled documents: label 1 holds one of a few marker words."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(30, 80))]
        label = i % 3 == 0
        if label:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["wretchling", "foulmonger", "spitebeard"]))
        rows.append((i, " ".join(words), int(label)))
    return (spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string"),
            spark.createDataFrame([(r[0], r[2], r[2]) for r in rows], "doc_id bigint, toxic int, quality int"))


def test_toxicity(spark, docs, empty):
    d, labels = _labelled(spark)
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    got = toxicity.classify(d, labels).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] == truth[r["id"]] for r in held]) > 0.9
    edge = toxicity.classify(docs, labels).collect()
    assert len(edge) == 12 and all(0 <= r["score"] <= 1 for r in edge)
    assert toxicity.classify(empty, labels).count() == 0 and {r["score"] for r in toxicity.classify(docs, labels.limit(0)).collect()} == {0.0}


def test_toxicity_whole_vocabulary():
    """Every word that sets toxic documents apart is in the dictionary and saves bytes, however many there are."""
    rng = random.Random(7)
    plain = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    marks = ["".join(rng.choice("qrstuvwxyz") for _ in range(rng.randint(6, 11))) for _ in range(240)]
    assert len(set(marks)) == 240 and sum(map(len, marks)) > 1024
    toxic = [[rng.choice(plain) for _ in range(40)] for _ in range(1600)]
    for i, words in enumerate(toxic):  # a mark is in 4 of 1,600 documents
        if i < 960:
            words.insert(rng.randrange(40), marks[i % 240])
    ordinary = [" ".join(rng.choice(plain) for _ in range(40)) for _ in range(8000)]
    model = toxicity.dictionaries([" ".join(x) for x in toxic], ordinary)
    assert {x.encode() for x in marks} <= set(model.toxic.split())
    assert all(model.savings(f"abc {x} defg hij").max() > 0 for x in marks)


def test_toxicity_ignores_held_out_labels(spark):
    d, labels = _labelled(spark, n=240)
    other = spark.createDataFrame([(r["doc_id"], 1 if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 else r["toxic"]) for r in labels.collect()], "doc_id bigint, toxic int")
    a, b = ({r["id"]: r["score"] for r in toxicity.classify(d, x).collect()} for x in (labels, other))
    assert a == b


def test_quality(spark, docs, empty):
    d, labels = _labelled(spark)
    shout = d.selectExpr("doc_id", "CASE WHEN doc_id % 3 = 0 THEN text ELSE concat(upper(text), '!!') END AS text")
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [r for r in quality.classify(shout, labels).collect() if r["held_out"]]
    assert np.mean([r["predicted"] == truth[r["id"]] for r in held]) > 0.95
    assert quality.classify(docs, labels).count() == 12 and quality.classify(empty, labels).count() == 0
    assert {r["score"] for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    xs, ys = quality.isotonic(np.array([1.0, 2.0, 3.0, 4.0]), np.array([0.0, 1.0, 0.0, 1.0]))
    assert (np.diff(ys) >= 0).all() and (np.diff(xs) >= 0).all()


def test_langid(spark, docs, empty, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in d.collect()}
    held = [r for r in langid.identify(d).collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["id"]] for r in held]) > 0.97
    edge = langid.identify(docs).collect()
    assert len(edge) == 12 and {r["lang_pred"] for r in edge if r["id"] in (4, 5, 6, 8)} == {"und"}
    assert langid.identify(empty).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(12, 32))
    x = [b + rng.normal(size=32) * 0.12 for b in base for _ in range(25)] + [base[0]] * 3
    rows = [(i, [float(c) for c in v], i % 2) for i, v in enumerate(x)]
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [0.0] * 32, 0), (n + 2, [float("nan")] * 32, 0), (n + 3, [1.0, None], 0), (n + 4, [float(c) for c in x[0]], None),
             (n + 5, [1.0, 2.0], 0), (n + 6, [], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    u = np.array(x) / np.linalg.norm(x, axis=1, keepdims=True)
    link = (u @ u.T >= 0.98) & ((np.arange(n)[:, None] - np.arange(n)) % 2 == 0) & ~np.eye(n, dtype=bool)
    low = reach(n, list(zip(*np.nonzero(link)))) + list(range(n, n + 7))
    got = {r["id"]: (r["n_links"], r["component_id"], r["kept"]) for r in rabitq.near_duplicates(df).collect()}
    assert got == {i: (int(link[i].sum()) if i < n else 0, low[i], low[i] == i) for i in range(n + 7)}
    assert rabitq.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("width", [2, 5])
def test_minhash(spark, docs, empty, width):
    rng = random.Random(width)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] not in (None, 9)]
    for g in range(12):
        base = [f"t{rng.randrange(500)}" for _ in range(rng.choice([3, 40, 150]))]
        for _ in range(8):
            words = list(base)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = f"u{rng.randrange(500)}"
            rows.append((100 + len(rows), " ".join(words)))
    rows.sort()

    def shingles(t):
        w = WORD.findall(lower(t))
        return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()

    sets = [shingles(t) for _, t in rows]
    low = reach(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if similar(sets[i], sets[j])])
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in superminhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), width=width).collect()}
    assert got == {rows[i][0]: (len(sets[i]), rows[low[i]][0]) for i in range(len(rows))}
    kept = superminhash.dedup(docs, width=width)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()].count(9) == 1 and superminhash.dedup(empty).count() == 0


def test_superminhash_signature():
    x = np.unique(np.random.default_rng(0).integers(0, 2**63, 3000).astype(np.uint64))
    a, b = x[:2000], x[500:2500]  # similarity 0.6
    sig = superminhash.signatures(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]), 2)
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.15
    one = superminhash.signatures(np.zeros(1, int), x[:1], 1)
    assert sorted(one[0] >> np.uint64(56)) == list(range(superminhash.SLOTS))  # one element visits every slot once


def test_bpe(spark, docs, empty):
    tiktoken = pytest.importorskip("tiktoken")
    vocabulary = pytest.importorskip("public_tokenizers")
    path = vocabulary.path("byte_bpe_multi_50k.tiktoken")
    ours = bpe.load(path, vocabulary.PATTERN)
    theirs = tiktoken.Encoding("own", pat_str=vocabulary.PATTERN, mergeable_ranks=ours.ranks, special_tokens={})
    rng = random.Random(0)
    for t in ["", "aaaaaaa", "ab" * 5000 + "a" * 301, *("".join(rng.choice("ab \néthe1!\U0001f600") for _ in range(60)) for _ in range(200))]:
        ids = np.frombuffer(ours.encode(t), "<u4").tolist()
        assert ids == theirs.encode_ordinary(t) and ours.decode(ours.encode(t)) == t.encode()
    back = {r["id"]: bytes(r["data"]) for r in bpe.decode(bpe.encode(docs)).collect()}
    assert back == {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    assert bpe.digests(docs).count() == 12 and bpe.encode(empty).count() == 0


def test_mixing(spark, docs, empty):
    rows = [(i, "w " * (1 + i % 7), ["a", "b", "c", None][i % 4]) for i in range(4000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    assert len(got) == 4000 and all(r["taken"] <= 2 * r["size"] for r in got)
    total = sum(r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r["target"], [r["source_size"], 0])[1] += r["taken"]
    assert math.isclose(sum({(r["target"], r["source_size"]) for r in got} and by), 1.5 * total)
    assert all(t <= 2 * size + 1e-9 and abs(t - taken) <= 7 for t, (size, taken) in by.items())
    assert mixing.mix(docs).count() == 12 and mixing.mix(empty).count() == 0 and mixing.repeat(docs).columns == docs.columns


def test_warc(spark, tmp_path):
    big = "é" * 800
    rows = [(1, "http://a\r\nX: y", big), (2, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (None, "u", big), (6, "u", "z" * 17_000_000)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "page_id bigint, url string, html string, payload int")
    path = warc.write(warc.records(df), str(tmp_path / "w"))
    got = {r["page_id"]: r for r in warc.read(spark, path).collect()}
    assert len(got) == 7 and all(r["verified"] for r in got.values())
    for page, _, html in rows:
        data, r = (html or "").encode(), got[page]
        assert r["payload_bytes"] == len(data) and r["payload_digest"] == hashlib.sha1(data).hexdigest()
        assert (r["record_type"], r["refers_to"]) == (("revisit", 2) if page in (1, None) else ("response", None))
        assert r["payload"] is None if page in (1, None) else bytes(r["payload"]) == data
    whole = warc.member(1, "u", b"payload")
    with pytest.raises(ValueError):
        list(warc.Reader(whole[:-20]))
    assert warc.round_trip(df.limit(0)).count() == 0


def test_pipeline_stages(spark, docs, empty, sf_dir):
    import corpus_pipeline

    for table in (docs, empty):
        d = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            d = corpus_pipeline.materialize(stage(spark, d, sf_dir), name)
            assert d.columns == stages.COLUMNS
        ids = {r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, d, sf_dir).collect()}
    assert not ids


def test_stars():
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(300, 400)]
    a, b = components.stars(*(np.array([x[k] for x in links]) for k in range(2)))
    low = reach(401, links)
    assert dict(zip(a.tolist(), b.tolist())) == {v: low[v] for v in range(401) if low[v] != v}
    assert len(components.stars(np.zeros(0, np.int64), np.zeros(0, np.int64))[0]) == 0


def test_components_of_paths_and_hubs(spark, monkeypatch):
    """Rounds that a task ends before it has seen all its edges; no vertex's degree shows in the rows of a larger end."""
    monkeypatch.setattr(components, "EDGES", 3)
    links = [(i, i + 1) for i in range(40)] + [(500 + i * 37 % 60, 500 + (i + 1) * 37 % 60) for i in range(59)] + [(1000, 1001 + i) for i in range(80)] + [(1040, 5)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    low = reach(1100, links)
    assert got == {v: low[v] for e in links for v in e}


def _bucket_rows():
    """Three sets, one of them twice, with two words in common; words of one slot and of another."""
    h, size, pos = [5, 6, 7, 5], [10, 10, 60, 10], [0, 0, 0, 0]
    words = [[11, 12, 13], [11, 12], [11, 14], [11, 12, 13]]
    wide = [[0, 0, 9, 0]] * 4
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (h, size, [1, 1, 3, 1], *wide, pos)] + [pa.array(words, pa.list_(pa.int64()))],
                                      ["h", "size", "bits", *line_dedup.WIDE, "pos", "words"])


def test_bucket_rows_travel_by_slot_and_once():
    """A row a slot and not a row a word; a set that a task sees again adds none."""
    batches = list(line_dedup._packed(2)(iter([_bucket_rows()])))
    rows = [r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(3)))]
    assert [(s, n) for s, n, _ in rows] == [(0, 3), (1, 4)]
    cols = [np.concatenate(x) for x in zip(*(line_dedup._unpacked(n, memoryview(d)) for _, n, d in rows))]
    got = {(k, h): (size, pos, bits, w) for k, h, size, pos, bits, w, *_ in zip(*(c.tolist() for c in cols))}
    assert got == {(11, 5): (10, 0, 1, 0), (12, 5): (10, 1, 1, 0), (13, 5): (10, 2, 1, 0), (11, 6): (10, 0, 1, 0), (12, 6): (10, 1, 1, 0),
                   (11, 7): (60, 0, 3, 9), (14, 7): (60, 1, 3, 9)}
    edges = [e for b in line_dedup._candidates((80, 100))(iter(batches)) for e in zip(*(b.column(k).to_pylist() for k in range(2)))]
    assert edges == [(6, 5)]
