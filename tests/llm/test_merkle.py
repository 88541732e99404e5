"""The Merkle manifest against trees built over sorted lists, with repeated, missing, negative and far ids."""

import hashlib
import random
import zlib

import duckdb
import pytest

from tillcast.llm import merkle


def sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return sha("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def tree(nodes):
    """The root, and for every leaf its (place, others) level by level."""
    ways, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for way, i in zip(ways, at):
            first = i - i % 3
            way.append((i % 3, level[first:i] + level[i + 1:first + 3]))
        level, at = [sha(level[i:i + 3]) for i in range(0, len(level), 3)], [i // 3 for i in at]
    return level[0], ways


def folded(node, way):
    for place, others in way:
        node = sha([*others[:place], node, *others[place:]])
    return node


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees.append(tree([leaf_of(r) for r in groups[s]]))
    root, tops = tree([t[0] for t in trees])
    out = []
    for s, (subroot, ways), top in zip(names, trees, tops):
        for r, way in zip(groups[s], ways):
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            got = folded(leaf_of((*r[:4], text)), way + top)
            out.append((r[0], leaf_of(r), subroot, root, sha(x for _, o in way + top for x in o), got, got == root))
    return sorted(out, key=repr)


SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def check(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", index int, src string")
    assert sorted((tuple(r) for r in merkle.op12_manifest(df).collect()), key=repr) == brute(rows)


def test_repeats_and_far_ids(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, -1, 5, 4095, 4096, 2**63 - 1, -2**63, rng.randrange(-9000, 9000), rng.randrange(-2**62, 2**62)]),
             rng.choice(["a", "a", "", None, "ü"]), rng.choice(["en", None]), rng.choice([None, 3]), rng.choice([None, "", "x\ny", "日本\n", "z"])) for _ in range(1500)]
    rows += [(77, "a", "en", 1, f"{i}\n") for i in range(merkle.CHUNK + 100)]  # more rows of one id than a window may hold
    check(spark, rows)


def test_many_runs_and_sources(spark):
    rows = [(i * 3, "big", None, i, f"t\n{i}") for i in range(merkle.RUN * 2 + 5)] + [(i, f"s{i}", "en", 0, "") for i in range(merkle.RUN + 30)]
    rows += [(i, "full", "en", 1, None) for i in range(merkle.RUN)]
    random.Random(1).shuffle(rows)
    check(spark, rows)


def test_edges(spark, docs, empty):
    assert merkle.op12_manifest(empty).count() == 0
    check(spark, [(4, None, None, None, "one\nleaf")])
    check(spark, [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()])


def test_proofs_fold_to_the_root(spark, docs):
    rows = merkle.manifest(docs, proofs=True).collect()
    assert rows and all(merkle.fold_proof(bytes.fromhex(r["leaf"]), r["proof"]).hex() == r["root"] and r["verified"] for r in rows)
    with pytest.raises(AssertionError):
        assert merkle.fold_proof(b"\0" * 32, rows[0]["proof"]).hex() == rows[0]["root"]


def test_sql(spark, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect() if r["doc_id"] is not None]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR, lang VARCHAR, n_chars BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    assert sorted(con.execute(merkle.OP12_SQL).fetchall(), key=repr) == brute(rows)
