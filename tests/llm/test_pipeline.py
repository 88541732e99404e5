"""The whole pipeline against a row-by-row version of its stages, on a fixture with planted copies."""

import hashlib
import random
import re
import struct
from collections import Counter

import duckdb

import corpus_pipeline
from tillcast.llm import mixing
from tests.llm.test_operators import reach, similar

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EN = "the house stands near river and people walk there every morning with their dogs while children play under old trees because summer is warm".split()
DE = "das haus steht nahe dem fluss und leute gehen dort jeden morgen mit ihren hunden während kinder unter alten bäumen spielen weil der sommer warm ist".split()


def documents():
    rng = random.Random(9)
    rows = []
    for i in range(48):
        words = DE if i % 4 == 1 else EN
        lines = [" ".join(rng.choice(words) + (f"{rng.randrange(40)}" if rng.random() < 0.2 else "") for _ in range(rng.randrange(6, 25))) for _ in range(rng.randrange(1, 6))]
        rows.append([i, "\n".join(lines), "de" if i % 4 == 1 else "en", rng.choice(["a", "a", "b", None])])
    rows[20][1] = rows[3][1]  # an exact copy: loses all its lines
    rows[21][1] = rows[4][1] + "\n" + rows[21][1]  # shares lines
    rows[30][1], rows[31][1], rows[32][1] = "12 34 ??", "", None  # no letter
    long = [rng.choice(EN) + str(k) for k in range(200)]
    rows[40][1] = "\n".join(" ".join(long[k:k + 5]) for k in range(0, 200, 5))
    rows[41][1] = "\n".join(" ".join(long[k:k + 9]) for k in range(0, 200, 9))  # the same words in other lines
    return [(d, t, c, s, None if t is None else len(t)) for d, t, c, s in rows]


def words_of(line):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(line)]


def brute(rows):
    rows = [r for r in rows if any(map(str.isalpha, r[1] or ""))]
    lines = [(i, k, frozenset(words_of(x))) for i, r in enumerate(rows) for k, x in enumerate(r[1].split("\n"))]
    gone = {lines[j][:2] for j in range(len(lines)) if any(similar(lines[i][2], lines[j][2]) for i in range(j))}
    left = []
    for i, r in enumerate(rows):
        text = "\n".join(x for k, x in enumerate(r[1].split("\n")) if (i, k) not in gone)
        if WORD.search(text):
            left.append((r[0], text, r[2], r[3]))
    sets = []
    for r in left:
        w = words_of(r[1])
        sets.append(frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]))
    low = reach(len(left), [(a, b) for a in range(len(left)) for b in range(a) if similar(sets[a], sets[b])])
    return left, [r for i, r in enumerate(left) if low[i] == i]


def test_run_against_brute_force(spark, tmp_path):
    import public_tokenizers
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    rows = documents()
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    before, kept = brute(rows)
    assert 20 not in {r[0] for r in before} and len(kept) < len(before)  # both deduplications have work
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", kept)
    times = {r[0]: r[4] // r[1] for r in con.execute(mixing.OP7_SQL).fetchall()}
    enc = tiktoken.Encoding("multi", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))), special_tokens={})
    want = Counter()
    for d, text, _, _ in kept:
        ids = enc.encode_ordinary(text)
        want[d, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += times[d]
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == +want
