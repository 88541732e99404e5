"""Conversation repair against a search over all edits, and its bounded memory."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest

from tillcast.llm import repair as rp

GRAMMAR = re.compile(r"(s?(ua)+)?")
OPEN = re.compile(r"s?(ua)*u?")  # what a longer string can still be


def search(rows, insert=5, delete=2):
    """The cheapest and ASCII-least edits of (role, text, fault) rows by trying all, with the repaired lines."""
    best = [None]

    def go(i, roles, cost, audit, lines, inserted):
        if best[0] and cost > best[0][0] or not OPEN.fullmatch(roles):
            return
        if i == len(rows) and GRAMMAR.fullmatch(roles) and (best[0] is None or (cost, audit) < best[0][:2]):
            best[0] = (cost, audit, lines)
        if inserted < 3:
            for r in ("user", "assistant"):
                go(i, roles + r[0], cost + insert, audit + "I", [*lines, r + ":"], inserted + 1)
        if i < len(rows):
            role, text, fault = rows[i]
            go(i + 1, roles, cost + delete, audit + "D", lines, 0)
            if fault in ("", "truncated"):
                more = 5 * (fault == "truncated")
                if role[:1] in ("s", "u", "a"):
                    go(i + 1, roles + role[0], cost + more, audit + "K", [*lines, f"{role}:{text}"], 0)
                for r in ("user", "assistant"):
                    go(i + 1, roles + r[0], cost + more + 1, audit + "R", [*lines, f"{r}:{text}"], 0)

    best[0] = (delete * len(rows) + 1, "", [])
    go(0, "", 0, "", [], 0)
    return best[0]


def brute(rows):
    """Damage and repair of (conv_id, turn, role, text) rows by the letter of the contract."""
    out, groups = [], {}
    for c, t, r, x in rows:
        groups.setdefault(c, [])
        r, x = " " if r is None else r, " " if x is None else x
        f = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if f == 0:
            continue
        row = (t, "user" if f == 4 else r, "" if f == 1 else re.sub("[.!?]", "", x) if f == 2 else x)
        groups[c] += [row] * (2 if f == 3 else 1)
    for c, g in groups.items():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for t, r, x in g:
            solid = re.sub(r"[\x20\x09-\x0D]", "", x)
            faults.append("blank" if not solid else "duplicate" if (r, x) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((r, x))
        turns = [t for t, _, _ in g if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(g, g[1:]))
        cost, audit, lines = search([(r, x, f) for (_, r, x), f in zip(g, faults)])
        out.append((c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
                    illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def some_rows(seed, convs, turns):
    rng = random.Random(seed)
    return [(c if c else None, rng.choice([None, *range(7), *range(7)]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "s"]),
             rng.choice(["a.", "b!", "c?", "cut", "x. \n", " ", "", None, "é", "End ", "d."])) for c in range(convs) for _ in range(rng.randrange(turns + 1))]


def test_all_edits(spark):
    rows = some_rows(1, 220, 5)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", id int, gone string")
    got = sorted((tuple(r) for r in rp.op13_repair(df).collect()), key=repr)
    assert got == brute(rows)
    assert {x for r in got for x in r[-2]} == set("KRD")  # at these costs an insertion never pays


@pytest.mark.parametrize("insert, delete", [(5, 2), (1, 3), (1, 2), (2, 2)])
def test_decoder_against_search(monkeypatch, insert, delete):
    """With other costs, where insertions pay and tie too."""
    rng, letters = random.Random(8), set()
    monkeypatch.setattr(rp, "INSERT_COST", insert)
    monkeypatch.setattr(rp, "DELETE_COST", delete)
    monkeypatch.setattr(rp, "EXTRA", rp.extra(insert, delete))
    for n in range(200):
        rows = [(rng.choice(["system", "user", "assistant", "tool"]), f"t{i}", rng.choice(["", "", "blank", "truncated"])) for i in range(rng.randrange(6))]
        d = rp.Decoder()
        for r, x, f in rows:
            d.turn(r, x, f == "blank", f == "truncated")
        cost, audit, lines = search(rows, insert, delete)
        assert d.finish() == (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()), rows
        letters |= set(audit)
    assert insert == 5 or letters == set("KRDI")


def test_dropping_survivors_changes_nothing(monkeypatch):
    """The same edits as without the bound on what a survivor can still gain, on long conversations."""
    rng = random.Random(4)
    for n in range(40):
        rows = [(rng.choice(["system", "user", "assistant", "tool"]), "x", rng.random() < 0.3, rng.random() < 0.3) for _ in range(150)]
        ends = []
        for extra in (rp.EXTRA, ((10**9,) * 4,) * 4):
            monkeypatch.setattr(rp, "EXTRA", extra)
            d = rp.Decoder()
            for r in rows:
                d.turn(*r)
            ends.append(d.finish())
        assert ends[0] == ends[1]


def test_open_edits_stay_few():
    """Unresolved edits stay few however long the conversation, also where every turn must go."""
    rng = random.Random(6)
    kinds = {
        "mixed": lambda i: (rng.choice(["system", "user", "assistant", "tool"]), "x", rng.random() < 0.2, rng.random() < 0.2), "blank": lambda i: ("user", "", True, False),
        "fair": lambda i: (rng.choice(["user", "assistant"]), "x", rng.random() < 0.05, rng.random() < 0.05)}
    for name, kind in kinds.items():
        d = rp.Decoder()
        for i in range(20_000):
            d.turn(*kind(i))
        assert d.widest < 400, (name, d.widest)
        assert len(d.finish()[1]) >= 20_000


def test_conversations_open_to_the_end():
    """One role only: the parity of the number of turns decides on the first edit; linear time, no texts held."""
    for n in (50_000, 50_001):
        d = rp.Decoder()
        for _ in range(n):
            d.turn("user", "x" * 50, False, False)
        assert d.finish()[:2] == (n // 2 + 2 * (n % 2), "D" * (n % 2) + "KR" * (n // 2))


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert rp.op13_repair(empty).count() == 0
    gone = next(t for t in range(200) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    row = rp.op13_repair(spark.createDataFrame([(1, gone, "user", "x")], SCHEMA)).collect()
    assert [tuple(r) for r in row] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    long = [(5, i, ("user", "assistant")[i % 2], f"{i} " + "y" * 2000 + ".") for i in range(4000)]
    got = rp.repair(spark.createDataFrame(long, SCHEMA)).collect()[0]
    assert (got["cost"], got["audit"]) == (0, "K" * 4000)
    assert got["repaired_sha256"] == hashlib.sha256("\n".join(f"{r}:{x}" for _, _, r, x in long).encode()).hexdigest()


def test_sql(spark):
    rows = some_rows(3, 60, 5)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted(con.execute(rp.OP13_SQL).fetchall(), key=repr) == brute(rows)


def test_one_shuffle(spark):
    rows = spark.createDataFrame(some_rows(3, 6, 5), SCHEMA)
    plan = rp.op13_repair(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
