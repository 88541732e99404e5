"""The license scan against a plain count of every block and notice, and on the edge cases of conftest."""

import random
import re

import duckdb
import pytest

from tillcast.llm import license_scan as ls

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(text, notices, tenths):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    at = [(i, label) for phrase, label in ls.PHRASES.items() for i in range(len(w)) if w[i:i + len(phrase.split())] == phrase.split()]
    hits = {}
    for b in range(max(1, -(-len(w) // ls.STEP))):
        have = set(w[b * ls.STEP: b * ls.STEP + ls.BLOCK])
        for label, notice in notices:
            t = set(notice.split())
            if 10 * len(t & have) >= tenths * len(t):
                hits[b, label] = max(hits.get((b, label), 0), len(t & have) / len(t))
    base = {x for _, x in at}
    return (len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted(base)),
            ",".join(sorted(base | {x for _, x in hits})), 1.0 if at else max(hits.values(), default=0.0), sorted((b, x, c) for (b, x), c in hits.items()))


@pytest.fixture(scope="module")
def texts():
    """Notices whole, with words missing, out of order, across block edges, in long texts; ties in word frequency."""
    rng = random.Random(5)
    common = "the of and to in is this software license under work free use terms".split()
    out = [None, "", " \n ", "MIT", "under the MIT license", "Under the MIT-License. Licensed under CC BY NC 4.0", "x" * 50_000, "日本 under\tthe\nmit  LICENSE é",
           "apache license version 2" * 2, "apache license version 2 " * 3, "under the mıt license", "under the Kind license"]
    for _ in range(60):
        label, notice = rng.choice(ls.NOTICES)
        words = notice.split()
        for _ in range(rng.randrange(5)):
            words[rng.randrange(len(words))] = rng.choice(common)
        if rng.random() < 0.3:
            rng.shuffle(words)
        filler = [rng.choice([*common, *(f"w{i}" for i in range(40))]) for _ in range(rng.choice([0, 20, 40, 70, 3000]))]
        cut = rng.randrange(len(filler) + 1)
        out.append(" ".join(filler[:cut] + words + filler[cut:]).upper() if rng.random() < 0.2 else " ".join(filler[:cut] + words + filler[cut:]))
    return out


@pytest.mark.parametrize("tenths", [9, 6])
def test_scan(spark, texts, tenths):
    df = spark.createDataFrame([(i % 50 if i % 7 else None, t, 1, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, token int, _row string")
    got = sorted(((r["id"] is not None, r["id"] or 0, *[r[c] for c in r.__fields__[1:-1]], [tuple(h) for h in r["hits"]]) for r in ls.scan(df, tenths=tenths).collect()), key=repr)
    want = sorted(((i % 7 > 0, i % 50 if i % 7 else 0, *brute(t, ls.NOTICES, tenths)) for i, t in enumerate(texts)), key=repr)
    assert got == want
    assert sum(1 for x in want if x[-1]) > 20


def test_edges(spark, docs, empty):
    out = ls.scan(docs)
    assert out.count() == docs.count() and ls.scan(empty).count() == 0
    assert {(r["n_words"], r["score"], r["labels"]) for r in out.where("id IN (4, 5, 6)").collect()} == {(0, 0.0, "")}


def test_sql(spark, texts):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    want = sorted(con.execute(ls.OP11_SQL).fetchall())
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(tuple(r)[:-1] for r in ls.scan(df).collect()) == want


def test_plan_is_native(spark, docs):
    plan = ls.scan(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoop", plan)


def test_notices_fit_the_blocks():
    assert all(len(text.split()) <= ls.STEP + 1 for _, text in ls.NOTICES)
