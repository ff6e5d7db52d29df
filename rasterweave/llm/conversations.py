"""Conversation structure repair by iterative-deepening A*.

A conversation's roles have to read: an optional system row, then user and assistant in
turn. Rows are kept, given the other role, deleted, or inserted, at costs; blank and repeated
rows have to go. The search goes depth first, tries edits in ASCII order of their initials and gives
up paths whose cost and least remaining cost pass a bound; the bound rises to the
least cost that was cut off. A (row, state) that failed with some budget fails with less, so it is kept
in a table. So the first accepting path is the cheapest one, and of those the first in order.

Conversations are ranges of one sorted table. One that lies within a task is repaired there.
The others, at most two a task and any that fill tasks by themselves, are cut into pieces of
bounded rows; a piece is searched from each state it can begin in to each it can end in, the pieces
of a conversation are chained by least cost, and each is edited by its part of the answer. So no
conversation is held by one task; its digest alone, which is sequential, reads the
pieces' texts one after another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cmp_to_key

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, prepare

#: States: nothing yet, after a system row, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: The user or assistant row that a state asks for.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
INITIALS = {USER: "u", ASSISTANT: "a"}
DELETE, INSERT, REROLE = 3, 2, 2
#: Rows and characters of a piece; a row is never cut.
ROWS, CHARS = 150, 1_000_000
#: A row's fault.
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)


def least_costs(rows: list[tuple[str, int]]) -> list[int]:
    """For each row what it and those after it cost at least: rows that have to go, what is left of the
    others, and 2 for each disjoint pair of neighbours among them with the same role."""
    n = len(rows)
    alone, clashes, better = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    after = beyond = n  # the next two places of rows that may stay
    for i in range(n - 1, -1, -1):
        role, fault = rows[i]
        if fault in (BLANK, DUPLICATE):
            alone[i], clashes[i] = alone[i + 1] + DELETE, clashes[i + 1]
            continue
        own = (0 if role in ("s", "u", "a") else REROLE) + (fault == TRUNCATED)
        alone[i] = alone[i + 1] + own
        clash = after < n and role == rows[after][0] and role in ("u", "a")
        clashes[i] = max(clashes[i + 1], clash + clashes[beyond] if clash else 0)
        after, beyond = i, after
    for i in range(n + 1):
        better[i] = alone[i] + INSERT * clashes[i]
    return better


def cheapest(rows: list[tuple[str, int]], entry: int = START, exits: tuple = (START, ASSISTANT)) -> tuple[int, str] | None:
    """(cost, initials of the edits) of the cheapest edits of (role initial, fault) rows that lead from
    state ``entry`` to one of ``exits``; of equally cheap ones the first in ASCII order. None if none do."""
    n, ahead = len(rows), least_costs(rows)
    if not any(can_reach(rows, entry, e) for e in exits):
        return None
    failed: dict[tuple[int, int], int] = {}
    bound = ahead[0]
    while True:
        over = None
        # a path is a stack of (row, state, cost so far, edits still to try)
        path, stack = [], [(0, entry, 0, moves(rows, 0, entry))]
        while stack:
            i, state, cost, todo = stack[-1]
            if i == n and state in exits:
                return cost, "".join(path)
            for edit, price, i2, state2 in todo:
                spent = cost + price
                if spent + ahead[i2] > bound:
                    over = spent + ahead[i2] if over is None else min(over, spent + ahead[i2])
                    continue
                known = failed.get((i2, state2), -1)
                if bound - spent <= known:  # costs more than ``known`` from there
                    over = spent + known + 1 if over is None else min(over, spent + known + 1)
                    continue
                path.append(edit)
                stack.append((i2, state2, spent, moves(rows, i2, state2)))
                break
            else:
                failed[i, state] = max(failed.get((i, state), -1), bound - cost)
                stack.pop()
                if path:
                    path.pop()
        bound = over


def moves(rows: list[tuple[str, int]], i: int, state: int) -> Iterator[tuple[str, int, int, int]]:
    """(initial, cost, row after, state after) of the edits at a row, in ASCII order."""
    ask = NEXT[state]
    here = i < len(rows)
    if here:
        yield "D", DELETE, i + 1, state
    yield "I", INSERT, i, ask
    if here and rows[i][1] not in (BLANK, DUPLICATE):
        role, fault = rows[i]
        extra = int(fault == TRUNCATED)
        if role == INITIALS[ask]:
            yield "K", extra, i + 1, ask
        elif role == "s" and state == START:
            yield "K", extra, i + 1, SYSTEM
        yield "R", REROLE + extra, i + 1, ask


def can_reach(rows: list[tuple[str, int]], entry: int, end: int) -> bool:
    if end in ROLES:
        return True
    if end == SYSTEM:
        return entry == SYSTEM or entry == START and any(r == "s" and f not in (BLANK, DUPLICATE) for r, f in rows)
    return entry == START


def repaired(rows: list[tuple[str, str]], edits: str, state: int = START) -> tuple[list[str], int]:
    """The edited ``role:text`` lines of (role, text) rows, and the state after them."""
    out, at = [], 0
    for e in edits:
        if e == "D":
            at += 1
            continue
        ask = NEXT[state]
        if e == "I":
            out.append(f"{ROLES[ask]}:")
            state = ask
            continue
        role, text = rows[at]
        at += 1
        state = SYSTEM if e == "K" and role[:1] == "s" else ask
        out.append(f"{role if e == 'K' else ROLES[ask]}:{text}")
    return out, state


def damaged(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, gone): the rows as the damage leaves them. A dropped row
    stays as a mark (gone), so that its conversation is known."""
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    t = turns.select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), own(role).alias("role"), own(text).alias("text"),
        (F.crc32(F.concat(own(conv_id), F.lit(":"), own(turn))) % 20).alias("_d"),
    )
    gone, empty = F.col("_d") == 0, F.lit("")
    t = t.select(
        "conv_id", F.when(~gone, F.col("turn")).alias("turn"), F.when(gone, empty).when(F.col("_d") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(gone | (F.col("_d") == 1), empty).when(F.col("_d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"), gone.alias("gone"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("_d") == 3, 2).otherwise(1))).alias("_copy"),
    )
    return t.drop("_copy")


def faults(rows: DataFrame) -> DataFrame:
    """Adds fault, each row's first one. A conversation's rows are dealt by their role and text, not by the conversation."""
    order = [F.col("turn").asc_nulls_first()]
    again = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "text").orderBy(*order)) > 1
    last = F.right(F.rtrim("text", F.lit(" \t\n\x0b\f\r")), F.lit(1))
    fault = F.when(last == "", BLANK).when(again, DUPLICATE).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(FINE)
    return rows.withColumn("fault", fault.cast("int"))


#: What a conversation, or a piece of one, is found to be.
FACTS = "rows long, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long"
PIECES = f"conv_id long, part int, piece int, whole boolean, {FACTS}, first_turn long, last_turn long, opens string, closes string, cost long, audit string, sha string, roles array<string>, texts array<string>, ways array<string>"


class Run:
    """The rows of a piece in order, and what they are found to be."""

    def __init__(self, conv_id):
        self.conv_id, self.roles, self.texts, self.faults, self.turns, self.chars = conv_id, [], [], [], [], 0

    def add(self, turn, role, text, fault, gone):
        if gone:
            return
        self.turns.append(turn), self.roles.append(role), self.texts.append(text), self.faults.append(fault)
        self.chars += len(text) + len(role)

    def full(self, most_rows: int, most_chars: int) -> bool:
        return len(self.roles) >= most_rows or self.chars >= most_chars

    def row(self, part: int, piece: int, whole: bool) -> dict:
        known = [t for t in self.turns if t is not None]
        initials = [r[:1] for r in self.roles]
        rows = list(zip(initials, self.faults))
        out = {
            "conv_id": self.conv_id, "part": part, "piece": piece, "whole": whole, "rows": len(rows), "low": min(known, default=None), "high": max(known, default=None), "turns": len(set(known)),
            "blank": self.faults.count(BLANK), "duplicate": self.faults.count(DUPLICATE), "truncated": self.faults.count(TRUNCATED),
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            "first_turn": known[0] if known else None, "last_turn": known[-1] if known else None, "opens": initials[0] if rows else None, "closes": initials[-1] if rows else None,
        }
        if whole:
            cost, audit = cheapest(rows)
            text = "\n".join(repaired(list(zip(self.roles, self.texts)), audit)[0])
            return out | {"cost": cost, "audit": audit, "sha": hashlib.sha256(text.encode()).hexdigest()}
        ways = []
        for entry in range(4):
            for end in range(4):
                found = cheapest(rows, entry, (end,)) if can_reach(rows, entry, end) else None
                ways.append(f"{found[0]}:{found[1]}" if found else "")
        return out | {"roles": self.roles, "texts": self.texts, "ways": ways}


def as_pieces(rows: list[dict]) -> pd.DataFrame:
    kinds = dict(c.split() for c in PIECES.split(", "))
    return pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype="Int64" if kind in ("long", "int") else object) for c, kind in kinds.items()})


def cut(most_rows: int, most_chars: int):
    """Pieces of a task's sorted rows; those of a conversation that begins and ends inside the task are whole and repaired."""

    def run(batches):
        from pyspark import TaskContext

        part, own, piece, first, out, size = TaskContext.get().partitionId(), None, 0, True, [], 0
        for batch in batches:
            turns, ids = ([None if pd.isna(v) else int(v) for v in batch[c]] for c in ("turn", "conv_id"))
            for conv_id, turn, role, text, fault, gone in zip(ids, turns, batch["role"], batch["text"], batch["fault"], batch["gone"]):
                other = own is not None and conv_id != own.conv_id
                if other or own is not None and own.full(most_rows, most_chars):
                    out.append(own.row(part, piece, other and not first and piece == 0))
                    size, first, piece = size + own.chars, first and not other, 0 if other else piece + 1
                    own = None
                if own is None:
                    own = Run(conv_id)
                own.add(turn, role, text, fault, gone)
                if len(out) >= 2000 or size >= 4 * CHARS:
                    yield as_pieces(out)
                    out, size = [], 0
        if own is not None:
            out.append(own.row(part, piece, False))
        if out:
            yield as_pieces(out)

    return run


class Way:
    """The edits of a piece and of those after it; compared as one string without making it."""

    __slots__ = ("text", "at", "end", "then")

    def __init__(self, text: str, at: tuple[int, int], end: int, then: Way | None):
        self.text, self.at, self.end, self.then = text, at, end, then

    def parts(self) -> Iterator[str]:
        way = self
        while way is not None:
            if way.text:
                yield way.text
            way = way.then


def compare(a: Way, b: Way) -> int:
    """-1, 0, 1 as the strings of a and b compare."""
    xs, ys, x, y = a.parts(), b.parts(), "", ""
    while True:
        x, y = x or next(xs, ""), y or next(ys, "")
        n = min(len(x), len(y))
        if x[:n] != y[:n] or not n:
            return (x > y) - (x < y)
        x, y = x[n:], y[n:]


class Chain:
    """The cheapest way through a conversation's pieces, which come last first, ties in ASCII order: from
    each state the best way to the end is kept."""

    def __init__(self):
        self.best: dict[int, tuple[int, Way | None]] = {START: (0, None), ASSISTANT: (0, None)}

    def before(self, at: tuple[int, int], table: list[str]) -> None:
        now = {}
        for entry in range(4):
            options = []
            for end, (cost, then) in self.best.items():
                own, _, edits = table[4 * entry + end].partition(":")
                if own:
                    options.append((cost + int(own), Way(edits, at, end, then)))
            if options:
                least = min(c for c, _ in options)
                now[entry] = least, min((w for c, w in options if c == least), key=cmp_to_key(compare))
        self.best = now

    def rows(self) -> Iterator[tuple[int, int, str, int, int]]:
        """(part, piece, edits, first state, cost of the whole), first piece first."""
        (cost, way), state = self.best[START], START
        while way is not None:
            yield (*way.at, way.text, state, cost)
            way, state = way.then, way.end


def chained(batches):
    """(conv_id, part, piece, edits, state, total) from tables of pieces, those of a conversation in falling order."""
    chain, of, some = Chain(), None, False

    def done():
        rows = [(of, *r) for r in chain.rows()]
        return pd.DataFrame(rows, columns=["conv_id", "part", "piece", "edits", "state", "total"]).astype({"conv_id": "Int64"})

    for batch in batches:
        for c, p, k, table in zip(batch["conv_id"], batch["part"], batch["piece"], batch["ways"]):
            c = None if pd.isna(c) else int(c)
            if some and c != of:
                yield done()
                chain = Chain()
            of, some = c, True
            chain.before((int(p), int(k)), table)
    if some:
        yield done()


def edited(batches):
    """Each piece's repaired lines as one text, and whether there are any."""
    for batch in batches:
        texts, any_ = [], []
        for roles, lines, edits, state in zip(batch["roles"], batch["texts"], batch["edits"], batch["state"]):
            out, _ = repaired(list(zip(roles, lines)), edits, int(state))
            texts.append("\n".join(out)), any_.append(bool(out))
        frame = batch[["conv_id", "part", "piece", "edits", "total"]].copy()
        frame["lines"], frame["some"] = texts, any_
        yield frame.astype({"conv_id": "Int64"})


def digests(batches):
    """(conv_id, total, audit, sha) of conversations whose edited pieces come in order; texts pass by, only edits are held."""
    digest, edits, of, total, begun, some = hashlib.sha256(), [], None, 0, False, False

    def done():
        frame = pd.DataFrame([(of, total, "".join(edits), digest.hexdigest())], columns=["conv_id", "cost", "audit", "sha"])
        return frame.astype({"conv_id": "Int64"})

    for batch in batches:
        for c, t, e, lines, any_ in zip(batch["conv_id"], batch["total"], batch["edits"], batch["lines"], batch["some"]):
            c = None if pd.isna(c) else int(c)
            if some and c != of:
                yield done()
                digest, edits, begun = hashlib.sha256(), [], False
            of, total, some = c, t, True
            edits.append(e)
            if any_:
                digest.update((b"\n" if begun else b"") + lines.encode())
                begun = True
    if some:
        yield done()


def repair(rows: DataFrame, most_rows: int = ROWS, most_chars: int = CHARS) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of conversations.

    ``rows`` has conv_id, turn, role, text (no nulls in the last two) and gone, a mark that stands for no row. Rows are
    taken by turn, nulls first, then by role and text; equal rows of one turn follow each other. A null conv_id is a conversation like
    others. A role's initial is its first character; a row of an empty role cannot be kept. A conversation without rows has zeros, an
    empty audit and the digest of an empty text. Its audit is one value, so a conversation has less than 2^31 edits.
    """
    spark = rows.sparkSession
    prepare(spark)
    key = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("fault") == DUPLICATE]
    ordered = faults(rows).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *key).sortWithinPartitions(*key)
    pieces = materialise(ordered.mapInPandas(cut(most_rows, most_chars), PIECES), "conversation-pieces")
    names = ["gaps", "blank", "duplicate", "truncated", "illegal"]
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    whole = pieces.where("whole").select("conv_id", gaps, *names[1:], "cost", "audit", F.col("sha").alias("repaired_sha256"))

    # the others: their pieces are few, but for a conversation that fills tasks
    parts = pieces.where("not whole")
    at = ["conv_id", "part", "piece"]
    plan = parts.select(*at, "ways").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("piece")).mapInPandas(chained, "conv_id long, part int, piece int, edits string, state int, total long")
    plan = materialise(plan, "piece-edits").select(F.col("conv_id").alias("of"), F.col("part").alias("of_part"), F.col("piece").alias("of_piece"), "edits", "state", "total")
    here = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part")) & (F.col("piece") == F.col("of_piece"))
    lines = parts.select(*at, "roles", "texts").join(plan, here).mapInPandas(edited, "conv_id long, part int, piece int, edits string, total long, lines string, some boolean")
    answers = lines.repartition("conv_id").sortWithinPartitions(*at).mapInPandas(digests, "conv_id long, cost long, audit string, sha string")
    # facts add up; where two pieces meet, a turn may go on and two roles meet
    before = Window.partitionBy("conv_id").orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    facts = parts.select(*at, "rows", "low", "high", "turns", *names[1:], "first_turn", "last_turn", "opens", "closes")
    facts = facts.withColumn("_turn", F.last("last_turn", True).over(before)).withColumn("_role", F.last("closes", True).over(before))
    meets = F.when(F.col("_role").isNotNull() & F.col("opens").isNotNull(), (~F.concat("_role", "opens").isin("su", "ua", "au")).cast("long")).otherwise(0)
    goes_on = F.coalesce((F.col("first_turn") == F.col("_turn")).cast("long"), F.lit(0))
    total = facts.groupBy("conv_id").agg(
        F.coalesce(F.max("high") - F.min("low") + 1 - F.sum(F.col("turns") - goes_on), F.lit(0)).alias("gaps"),
        *[F.sum(c).alias(c) for c in names[1:4]], F.sum(F.col("illegal") + meets).alias("illegal"),
    )
    answers = answers.select(F.col("conv_id").alias("of"), "cost", "audit", F.col("sha").alias("repaired_sha256"))
    longer = total.join(answers, F.col("conv_id").eqNullSafe(F.col("of"))).select("conv_id", *names, "cost", "audit", "repaired_sha256")
    return whole.unionByName(longer)


#: Dynamic programming over the four states: from each, up to two inserts, then the row's edit; of one row and state
#: the cheapest way stays, ties in ASCII order. The checksum's table follows from its polynomial (fixed value).
OP11_SQL = """WITH RECURSIVE tab AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS l FROM (SELECT unnest(range(256)) AS i)),
t AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
c AS (SELECT t.*, xor(list_reduce([4294967295] || list_transform(string_split(k, ''), lambda s: CAST(ascii(s) AS BIGINT)), lambda c, b: xor(c >> 8, l[CAST(xor(c, b) & 255 AS INT) + 1])), 4294967295) % 20 AS d FROM t, tab),
r AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
 FROM c, (SELECT unnest([1, 2]) AS copy) WHERE d <> 0 AND (copy = 1 OR d = 3)),
m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
 right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last, left(role, 1) AS s FROM m),
f AS (SELECT *, CASE WHEN last = '' THEN 'b' WHEN again THEN 'd' WHEN last NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, lag(s) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM n),
ins(p, q, price, edits, lines) AS (VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''), (0, 2, 2, 'I', chr(10) || 'user:'), (1, 2, 2, 'I', chr(10) || 'user:'), (2, 3, 2, 'I', chr(10) || 'assistant:'), (3, 2, 2, 'I', chr(10) || 'user:'),
 (0, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
w AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS st, {'cost': CAST(0 AS BIGINT), 'audit': '', 'lines': ''} AS best FROM conversations UNION ALL
 SELECT conv_id, i, st, min({'cost': CAST(cost AS BIGINT), 'audit': audit, 'lines': lines}) FROM (
  SELECT w.conv_id, f.i, w.best.cost + ins.price + e.price AS cost, w.best.audit || ins.edits || e.edit AS audit, w.best.lines || ins.lines || CASE e.edit WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || role || ':' || text WHEN 'R' THEN chr(10) || CASE WHEN ins.q = 2 THEN 'assistant:' ELSE 'user:' END || text END AS lines,
   CASE WHEN e.edit = 'D' THEN ins.q WHEN e.edit = 'K' AND s = 's' THEN 1 WHEN ins.q = 2 THEN 3 ELSE 2 END AS st
  FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1 JOIN ins ON ins.p = w.st JOIN (VALUES ('D', 3), ('K', 0), ('R', 2)) x(edit, base) ON edit = 'D' OR fault NOT IN ('b', 'd') AND (edit = 'R' OR s = 's' AND q = 0 OR s = 'u' AND q <> 2 OR s = 'a' AND q = 2),
   LATERAL (SELECT edit, base + CASE WHEN edit <> 'D' AND fault = 't' THEN 1 ELSE 0 END AS price) e) GROUP BY conv_id, i, st),
rows_ AS (SELECT conv_id, max(i) AS n FROM w GROUP BY conv_id),
done AS (SELECT w.conv_id, min({'cost': w.best.cost + price, 'audit': w.best.audit || edits, 'lines': w.best.lines || ins.lines}) AS best
 FROM w JOIN rows_ z ON z.conv_id IS NOT DISTINCT FROM w.conv_id AND z.n = w.i JOIN ins ON ins.p = w.st AND ins.q IN (0, 3) GROUP BY w.conv_id),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
 count(*) FILTER (before IS NOT NULL AND before || s NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT d.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
 CAST(d.best.cost AS BIGINT) AS cost, d.best.audit AS audit, sha256(substr(d.best.lines, 2)) AS repaired_sha256 FROM done d LEFT JOIN facts x ON x.conv_id IS NOT DISTINCT FROM d.conv_id"""


def op11_conversation_repair(spark, sf_dir):
    return repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
