"""Conversation structure repair: the cheapest edits that make the turns' roles alternate, by Viterbi decoding.

The roles of a repaired conversation are nothing, or an optional system turn and one or more pairs of user and
assistant.  A four-state automaton accepts them, and edits of the given turns are its weighted moves.

The decoder reads a conversation's turns once, in order, and never holds it whole.  Each state keeps one
survivor: the end of a path in a backpointer tree whose nodes count their references, and the digest of the
turns that the path keeps, so no text is held.  A node that nobody refers to any more is dropped, and its parent
with it if it was the last.  Once all survivors share an ancestor, the edits up to it are certain; they are
emitted and forgotten.  What stays in memory is the part that is still open.  Survivors of equal cost are
compared by their whole edit strings: the order of any two survivors is kept and carried on from turn to turn,
so a comparison never walks back.  A survivor that costs more than another one plus the most that the other
would pay to do what the first can still do is dropped, since no path through it can win or tie.

Spark partitions by conversation and sorts inside the partitions (spilling to disk), so a very long conversation
streams through its task; only its edits grow there: a byte a turn once they are certain.  Some conversations
stay open to the end (turns of one role only: their number decides whether the first one goes).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 1, 2, 5, 5
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}

#: States: nothing yet, after system, after user, after assistant.  MOVES[state] = {role initial: next state}.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
MOVES = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
FINAL = (EMPTY, ASSISTANT)
#: Insertions that can pay before a turn: (from, to, role initial); a longer chain only comes back to its start.
INSERTIONS = ((EMPTY, USER, "u"), (SYSTEM, USER, "u"), (ASSISTANT, USER, "u"), (USER, ASSISTANT, "a"))


def extra(i: int, d: int) -> tuple[tuple[int, ...], ...]:
    """What the survivor in state y (column) pays more, at most, to end as any path from state x (row) ends.

    It inserts the turns (at ``i``) that lead to x or to where x must go next, or deletes (at ``d``) the turns
    that only x can keep."""
    s = min(i, d)
    return (
        (0, 2 * i + d, i + d, d),  # x = EMPTY
        (0, 0, s, 0),              # x = SYSTEM: a user turn must follow
        (s, i, 0, s),              # x = USER: an assistant turn must follow
        (0, 2 * i, i, 0),          # x = ASSISTANT
    )


EXTRA = extra(INSERT_COST, DELETE_COST)


class Node:
    """An edit on a path; ``refs`` counts the children and survivors that refer to it."""

    __slots__ = ("parent", "letter", "refs", "children")

    def __init__(self, parent: Node | None, letter: str):
        self.parent, self.letter, self.refs, self.children = parent, letter, 0, []
        if parent:
            parent.refs += 1
            parent.children.append(self)

    def release(self) -> None:
        """Give up one reference; unreferred nodes leave the tree, up to the first one still in use."""
        node: Node | None = self
        node.refs -= 1
        while node.refs == 0 and node.parent is not None:
            parent, node.parent = node.parent, None
            parent.children.remove(node)
            parent.refs -= 1
            node = parent


class Text:
    """The digest of a path's turns, one a line."""

    __slots__ = ("digest", "some")

    def __init__(self, digest=None, some: bool = False):
        self.digest, self.some = digest or hashlib.sha256(), some

    def plus(self, lines: list[str]) -> Text:
        if not lines:
            return self
        digest = self.digest.copy()
        digest.update((("\n" if self.some else "") + "\n".join(lines)).encode())
        return Text(digest, True)


def carried(order: tuple[str, str], s: str, t: str) -> tuple[str, str]:
    """What two edit strings are after their common start, once ``s`` and ``t`` are added; one letter decides.

    Paths over the same turns whose strings start alike differ by insertions only, so the rest stays short."""
    a, b = order
    if a and b:
        return order
    a, b = a + s, b + t
    k = 0
    while k < len(a) and k < len(b) and a[k] == b[k]:
        k += 1
    a, b = a[k:], b[k:]
    return (a[0], b[0]) if a and b else (a, b)


#: A candidate path: cost, the survivor it starts from, the letters and the lines it adds.
Path = tuple[int, int, str, list[str]]


class Decoder:
    """Viterbi over one conversation's turns; ``widest`` is the largest number of unresolved edits so far."""

    def __init__(self):
        self.root = Node(None, "")
        self.root.refs = 1  # the survivor in EMPTY
        self.ends: list[tuple[int, Node, Text] | None] = [(0, self.root, Text()), None, None, None]
        self.order = {(EMPTY, EMPTY): ("", "")}
        self.audit, self.open, self.widest = bytearray(), 0, 0

    def _better(self, new: Path, old: Path | None) -> bool:
        if old is None or new[0] != old[0]:
            return old is None or new[0] < old[0]
        a, b = carried(self.order[new[1], old[1]], new[2], old[2])
        return a < b

    def _inserted(self) -> list[Path | None]:
        """The cheapest way to every state with turns inserted before the next one."""
        best: list[Path | None] = [None if e is None else (e[0], x, "", []) for x, e in enumerate(self.ends)]
        for x, y, role in INSERTIONS:
            if best[x] is not None:
                cost, start, letters, lines = best[x]
                path = (cost + INSERT_COST, start, letters + INSERT, [*lines, ROLES[role] + ":"])
                if self._better(path, best[y]):
                    best[y] = path
        return best

    def turn(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        best: list[Path | None] = [None] * 4
        stay = TRUNCATED_COST if truncated else 0
        for x, path in enumerate(self._inserted()):
            if path is None:
                continue
            cost, start, letters, lines = path
            moves = [(x, (cost + DELETE_COST, start, letters + DELETE, lines))]
            for initial, y in ({} if must_go else MOVES[x]).items():
                if initial == role[:1]:
                    moves.append((y, (cost + stay, start, letters + KEEP, [*lines, f"{role}:{text}"])))
                elif initial in ROLES:
                    moves.append((y, (cost + stay + REROLE_COST, start, letters + REROLE, [*lines, f"{ROLES[initial]}:{text}"])))
            for y, move in moves:
                if self._better(move, best[y]):
                    best[y] = move
        for x, path in enumerate(best):
            if path is not None and any(o is not None and o[0] + EXTRA[x][y] < path[0] for y, o in enumerate(best) if y != x):
                best[x] = None
        self._survive(best)

    def _survive(self, best: list[Path | None]) -> None:
        """The paths become the survivors: their edits join the tree, what nobody refers to any more leaves it."""
        grown: dict[tuple[int, str], Node] = {}
        ends: list[tuple[int, Node, Text] | None] = [None] * 4
        for x, path in enumerate(best):
            if path is None:
                continue
            cost, start, letters, lines = path
            node, text = self.ends[start][1:]
            for k in range(len(letters)):
                if (start, letters[: k + 1]) not in grown:
                    grown[start, letters[: k + 1]] = Node(node, letters[k])
                node = grown[start, letters[: k + 1]]
            node.refs += 1
            ends[x] = (cost, node, text.plus(lines))
        self.order = {(x, y): carried(self.order[p[1], q[1]], p[2], q[2]) for x, p in enumerate(best) if p for y, q in enumerate(best) if q}
        for old in self.ends:
            if old is not None:
                old[1].release()
        self.ends = ends
        self.open += 1
        held = {id(e[1]) for e in ends if e is not None}
        while len(self.root.children) == 1 and id(self.root) not in held:
            self.root = self.root.children[0]
            self.root.parent = None
            self.audit += self.root.letter.encode()
            self.open -= self.root.letter != INSERT
        self.widest = max(self.widest, self.open)

    def finish(self) -> tuple[int, str, str]:
        """(cost, edits, hex digest of the repaired conversation)."""
        best = None
        for x, path in enumerate(self._inserted()):
            if x in FINAL and path is not None and self._better(path, best):
                best = path
        cost, start, letters, lines = best
        node, text = self.ends[start][1:]
        rest = []
        while node is not self.root:
            rest.append(node.letter)
            node = node.parent
        return cost, self.audit.decode() + "".join(reversed(rest)) + letters, text.plus(lines).digest.hexdigest()


class Conversation:
    """What one pass over a conversation's rows gives."""

    def __init__(self):
        self.decoder, self.turns, self.first, self.last, self.distinct = Decoder(), 0, None, None, 0
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before: str | None = None

    def row(self, turn, role: str, text: str, blank: bool, again: bool, truncated: bool) -> None:
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.distinct += turn != self.last
            self.last = turn
        duplicate = again and not blank
        truncated = truncated and not blank and not duplicate
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated
        initial = role[:1]
        self.illegal += self.before is not None and self.before + initial not in LEGAL
        self.before = initial
        self.decoder.turn(role, text, blank or duplicate, truncated)

    def result(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return (gaps, self.blank, self.duplicate, self.truncated, self.illegal, *self.decoder.finish())


RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
NAMES = [c.split()[0] for c in RESULT.split(", ")]
FLUSH = 1024


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from rows sorted by conversation and turn; conversations may span batches."""
    open_, id_, ids, results, schema = None, None, [], [], None

    def flush():
        columns = list(zip(*results))
        kinds = [pa.int64()] * 6 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(ids, schema), *[pa.array(c, k) for c, k in zip(columns, kinds)]], ["id", *NAMES])

    for b in batches:
        schema = b.schema.field("id").type
        for i, turn, role, text, gone, blank, again, truncated in zip(*[b.column(c).to_pylist() for c in ("id", "turn", "role", "text", "gone", "blank", "again", "truncated")]):
            if open_ is None or i != id_:
                if open_ is not None:
                    ids.append(id_)
                    results.append(open_.result())
                    if len(ids) == FLUSH:
                        yield flush()
                        ids, results = [], []
                open_, id_ = Conversation(), i
            if not gone:
                open_.row(turn, role, text, blank, again, truncated)
    if open_ is not None:
        ids.append(id_)
        results.append(open_.result())
        yield flush()


def repair(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", gone: Column | None = None) -> DataFrame:
    """(id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation of ``df``.

    Turns are taken by number (null first), then role and text.  A turn's first fault counts: blank, duplicate
    (role and text seen earlier in the conversation), truncated (the last character that is not white space is
    none of ``.!?``).  ``illegal``: neighbours whose role initials can't follow each other.  ``gaps``: missing turn
    numbers.  Edits: keep 0, rerole 1, delete 2 (the only one for blank and duplicate turns), insert an empty
    turn 5, and 5 for every truncated turn that stays.  ``audit`` is the cheapest sequence of edit initials, the
    first in ASCII order among equals; ``repaired_sha256`` the digest of the repaired ``role:text`` lines.

    Rows where ``gone`` holds only name their conversation; one without any other row has zeros, an empty audit
    and the digest of the empty string.  Null roles and texts are one space, null ids one conversation; repeated
    rows are turns of their own; other columns are ignored; an empty table gives an empty one."""
    id_, turn = F.col(f"`{id_col}`"), F.col(f"`{turn_col}`").cast("bigint")
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in (role_col, text_col))
    rows = df.select(id_.alias("id"), turn.alias("turn"), role.alias("role"), text.alias("text"), (F.lit(False) if gone is None else gone).alias("gone"))
    rows = rows.repartition("id")  # the windows below and the decoder share this one shuffle
    seen = F.row_number().over(Window.partitionBy("id", "gone", "role", "text").orderBy("turn"))
    rows = rows.select("*", (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"), (seen > 1).alias("again"),
                       (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("truncated"))
    rows = rows.sortWithinPartitions("id", "turn", "role", "text", "again")
    return rows.mapInArrow(_stream, f"id {rows.schema['id'].dataType.simpleString()}, {RESULT}")


def damaged(df: DataFrame) -> DataFrame:
    """``conversations`` with faults by crc32(conv_id:turn) % 20 (nulls: one space), and ``gone`` for dropped rows."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = df.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key.cast("binary")) % 20).alias("fault"))
    fault = F.col("fault")
    return rows.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (fault == 0).alias("gone"), F.explode(F.sequence(F.lit(1), F.when(fault == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def op13_repair(conversations: DataFrame) -> DataFrame:
    """``repair`` of the damaged conversations."""
    return repair(damaged(conversations), gone=F.col("gone")).withColumnRenamed("id", "conv_id")


def _op13_sql() -> str:
    """All states' cheapest edit strings, row by row, as whole strings: dynamic programming by recursion."""
    key = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
    shifted = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len({key}) + 1), lambda i: ascii(substr({key}, i, 1))::BIGINT)), lambda c, b: {shifted}), 4294967295)"
    # Insertions before a row, and moves over a row: (from, to, cost, letters, lines).
    ins = [("E", "E", 0, "", ""), ("S", "S", 0, "", ""), ("U", "U", 0, "", ""), ("A", "A", 0, "", ""),
           *[(x, "U", 5, "I", "user:") for x in "ESA"], ("U", "A", 5, "I", "assistant:"), *[(x, "A", 10, "II", "user:+assistant:") for x in "ES"]]
    moves = [(x, c, y) for x, c, y in (("E", "s", "S"), ("E", "u", "U"), ("S", "u", "U"), ("U", "a", "A"), ("A", "u", "U"))]
    ins_rows = ", ".join(f"('{x}', '{y}', {c}, '{a}', {'NULL::VARCHAR' if not t else repr(t)})" for x, y, c, a, t in ins)
    move_rows = ", ".join(f"('{x}', '{c}', '{y}')" for x, c, y in moves)
    return rf"""
WITH RECURSIVE
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS f FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN f = 1 THEN '' WHEN f = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
             unnest(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k),
g AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
             row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
             NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut,
             lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS before FROM d),
r AS (SELECT *, CASE WHEN blank THEN 'b' WHEN again THEN 'd' WHEN cut THEN 't' ELSE '' END AS fault FROM g),
m AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 'b') AS blank,
             count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
             count(*) FILTER (before IS NOT NULL AND before || substr(role, 1, 1) NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM r GROUP BY conv_id),
ins (x, y, c, letters, lines) AS (VALUES {ins_rows}),
moves (x, role, y) AS (VALUES {move_rows}),
e AS (
  SELECT conv_id, i, x, x AS y, 2 AS c, 'D' AS letter, NULL::VARCHAR AS line FROM r, (VALUES ('E'), ('S'), ('U'), ('A')) s (x)
  UNION ALL
  SELECT conv_id, i, x, y, CASE WHEN fault = 't' THEN 5 ELSE 0 END + CASE WHEN moves.role = substr(r.role, 1, 1) THEN 0 ELSE 1 END,
         CASE WHEN moves.role = substr(r.role, 1, 1) THEN 'K' ELSE 'R' END,
         CASE WHEN moves.role = substr(r.role, 1, 1) THEN r.role WHEN moves.role = 'u' THEN 'user' ELSE 'assistant' END || ':' || text
  FROM r, moves WHERE fault NOT IN ('b', 'd') AND (moves.role = substr(r.role, 1, 1) OR moves.role <> 's')),
v AS (
  SELECT conv_id, 0::BIGINT AS i, 'E' AS state, struct_pack(c := 0, a := '', t := NULL::VARCHAR) AS best FROM m
  UNION ALL
  SELECT v.conv_id, e.i, e.y, min(struct_pack(c := v.best.c + ins.c + e.c, a := v.best.a || ins.letters || e.letter,
         t := nullif(concat_ws(chr(10), v.best.t, replace(ins.lines, '+', chr(10)), e.line), '')))
  FROM v JOIN ins ON ins.x = v.state JOIN e ON e.conv_id IS NOT DISTINCT FROM v.conv_id AND e.i = v.i + 1 AND e.x = ins.y
  GROUP BY v.conv_id, e.i, e.y),
z AS (
  SELECT v.conv_id, min(struct_pack(c := v.best.c + ins.c, a := v.best.a || ins.letters, t := nullif(concat_ws(chr(10), v.best.t, replace(ins.lines, '+', chr(10))), ''))) AS best
  FROM v JOIN m ON m.conv_id IS NOT DISTINCT FROM v.conv_id AND m.n = v.i JOIN ins ON ins.x = v.state AND ins.y IN ('E', 'A') GROUP BY v.conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(z.best.c, 0) AS BIGINT) AS cost, coalesce(z.best.a, '') AS audit, sha256(coalesce(z.best.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN m ON m.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM a.conv_id
"""


OP13_SQL = _op13_sql()
