"""Conversation repair against brute force."""

import hashlib
import random
import zlib

import duckdb
import pytest

from rasterweave.llm import conversations as conv

SPACES = " \t\n\x0b\f\r"


def brute(rows, entry=0, exits=(0, 3)):
    """Least (cost, audit) by dynamic programming over all edits, whole strings compared."""
    step = {0: 2, 1: 2, 2: 3, 3: 2}

    def grow(ways):
        for _ in range(2):
            for state, (cost, audit) in list(ways.items()):
                new = cost + 2, audit + "I"
                if new < ways.get(step[state], (1 << 30, "")):
                    ways[step[state]] = new
        return ways

    ways = grow({entry: (0, "")})
    for initial, fault in rows:
        now = {}
        for state, (cost, audit) in ways.items():
            options = [(state, cost + 3, "D")]
            if fault not in (conv.BLANK, conv.DUPLICATE):
                more = fault == conv.TRUNCATED
                options.append((step[state], cost + 2 + more, "R"))
                if initial == "ua"[step[state] - 2]:
                    options.append((step[state], cost + more, "K"))
                if initial == "s" and state == 0:
                    options.append((1, cost + more, "K"))
            for to, c, e in options:
                if (c, audit + e) < now.get(to, (1 << 30, "")):
                    now[to] = c, audit + e
        ways = grow(now)
    found = [w for s, w in ways.items() if s in exits]
    return min(found) if found else None


@pytest.mark.parametrize("n", [0, 1, 2, 5, 9, 40])
def test_search_equals_brute_force(n):
    rng = random.Random(n)
    for _ in range(150 if n < 20 else 20):
        rows = [(rng.choice("suauauax"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(n)]
        assert conv.cheapest(rows) == brute(rows), rows
        for entry in range(4):
            for end in range(4):
                assert conv.cheapest(rows, entry, (end,)) == brute(rows, entry, (end,)), (rows, entry, end)


def test_least_costs_never_pass_the_cost():
    rng = random.Random(3)
    for _ in range(300):
        rows = [(rng.choice("suuaax"), rng.choice([0, 0, 1, 3])) for _ in range(rng.randint(0, 8))]
        for i, least in enumerate(conv.least_costs(rows)):
            for entry in range(4):
                assert least <= brute(rows[i:], entry)[0] if brute(rows[i:], entry) else True


def expected(turns):
    """By the definition, one conversation after another; turns: (conv_id, turn, role, text)."""
    text_of = lambda v: " " if v is None else str(v)
    groups = {}
    for c, t, role, text in turns:
        own = groups.setdefault(c, [])
        kind = zlib.crc32(f"{text_of(c)}:{text_of(t)}".encode()) % 20
        role, text = text_of(role), text_of(text)
        if kind == 0:
            continue
        text = {1: "", 2: "".join(x for x in text if x not in ".!?")}.get(kind, text)
        own += [(t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for c, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in rows:
            bare = text.strip(SPACES)
            faults.append(conv.BLANK if not bare else conv.DUPLICATE if (role, text) in seen else conv.FINE if bare[-1] in ".!?" else conv.TRUNCATED)
            seen.add((role, text))
        known = [t for t, _, _ in rows if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
        cost, audit = brute([(r[:1], f) for (_, r, _), f in zip(rows, faults)])
        lines, state, at = [], 0, 0
        for e in audit:
            if e in "IR":
                state = {0: 2, 1: 2, 2: 3, 3: 2}[state]
                lines.append(("user" if state == 2 else "assistant") + ":" + (rows[at][2] if e == "R" else ""))
            elif e == "K":
                lines.append(f"{rows[at][1]}:{rows[at][2]}")
                state = {"s": 1, "u": 2, "a": 3}[rows[at][1][0]]
            at += e != "I"
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[c] = (gaps, faults.count(1), faults.count(2), faults.count(3), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha)
    return out


def some_turns():
    rng = random.Random(11)
    texts = ["Yes.", "No!", "cut off", "", " \n ", "Why?", "ends. \n", "ünïcode…", "x" * 3000 + "."]
    rows = []
    for c in range(120):
        n = 400 if c == 7 else rng.randint(1, 9)
        for t in range(n):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None, "unknown"])
            text = rng.choice(texts) if rng.random() < 0.4 else f"{rng.random()}."
            rows.append((None if c == 3 else c, None if rng.random() < 0.05 else t + (rng.random() < 0.1), role, rng.choice([text, text, text, None])))
    rows += rows[:30]  # repeated rows
    rows += [(5000 + i, 0, "user", "Hi.") for i in range(40)]  # some of them wholly dropped
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("parts", "most_rows", "most_chars"), [(1, 150, 1_000_000), (7, 150, 1_000_000), (40, 5, 4000)])
def test_repair_equals_brute_force(spark, parts, most_rows, most_chars):
    rows = some_turns()
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, fault string").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = conv.repair(conv.damaged(df), most_rows, most_chars).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = expected(rows)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r.conv_id], r.conv_id
    assert any(w[6] == "" for w in want.values())


def test_query_equals_sql_and_brute_force(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    want = expected(con.sql("select conv_id, turn, role, text from conversations").fetchall())
    got = conv.op11_conversation_repair(spark, sf_dir)
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want
    assert {r[0]: r[1:] for r in con.sql(conv.OP11_SQL).fetchall()} == want and con.sql(conv.OP11_SQL).columns == got.columns


def test_sql_equals_brute_force_on_odd_rows(tmp_path):
    rows = [r for r in some_turns() if r[0] != 7]  # all but the long one
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    assert {r[0]: r[1:] for r in con.sql(conv.OP11_SQL).fetchall()} == expected(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conv.repair(conv.damaged(df)).count() == 0


def test_other_columns_may_be_called_anything(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi.", True, 5)], "conv_id long, turn long, role string, text string, gone boolean, part int")
    assert conv.repair(conv.damaged(df)).count() == 1
