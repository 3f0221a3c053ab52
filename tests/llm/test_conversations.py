import hashlib
import itertools
import random
import re
import zlib

import pytest

from posteria.llm import conversations, queries
from registry import compare

RIGHT = re.compile(r"(s?(ua)+)?")


def every_repair(rows):
    """(cost, audit, lines) of all repairs with at most two insertions in one place."""
    gaps = [()] + [(x,) for x in ("user", "assistant")] + list(itertools.product(("user", "assistant"), repeat=2))

    def choices(row):
        role, text, must, more = row
        yield 4, "D", None
        if not must:
            yield more, "K", (role, text)
            for other in ("user", "assistant"):
                yield more + 3, "R", (other, text)

    for edits in itertools.product(*map(choices, rows)):
        for put in itertools.product(gaps, repeat=len(rows) + 1):
            cost, audit, lines = 0, "", []
            for i in range(len(rows) + 1):
                cost += 3 * len(put[i])
                audit += "I" * len(put[i])
                lines += [(r, "") for r in put[i]]
                if i < len(rows):
                    cost += edits[i][0]
                    audit += edits[i][1]
                    lines += [edits[i][2]] if edits[i][2] else []
            if RIGHT.fullmatch("".join(r[:1] or "-" for r, _ in lines)):
                yield cost, audit, lines


def least(rows):
    """The same by a plain table over rows and states, without an agenda."""
    steps = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    table = {0: (0, "", [])}

    def inserted(table):
        table = dict(table)
        for _ in range(2):
            for q, (cost, audit, lines) in list(table.items()):
                for role in ("user", "assistant"):
                    if role[0] in steps[q]:
                        new = (cost + 3, audit + "I", [*lines, (role, "")])
                        to = steps[q][role[0]]
                        if to not in table or new[:2] < table[to][:2]:
                            table[to] = new
        return table

    for role, text, must, more in rows:
        new = {}
        for q, (cost, audit, lines) in inserted(table).items():
            ways = [(q, (cost + 4, audit + "D", lines))]
            if not must:
                if role[:1] in steps[q]:
                    ways.append((steps[q][role[:1]], (cost + more, audit + "K", [*lines, (role, text)])))
                ways += [(steps[q][r[0]], (cost + more + 3, audit + "R", [*lines, (r, text)])) for r in ("user", "assistant") if r[0] in steps[q]]
            for to, way in ways:
                if to not in new or way[:2] < new[to][:2]:
                    new[to] = way
        table = new
    return min((w for q, w in inserted(table).items() if q in (0, 3)), key=lambda w: w[:2])


def judged(rows):
    """(gaps, blank, duplicate, truncated, illegal) and the rows for ``least``, from (turn, role, text) in order."""
    seen, out, counts = set(), [], [0, 0, 0]
    for _, role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = 0 if not solid else 1 if (role, text) in seen else 2 if solid[-1] not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            counts[fault] += 1
        out.append((role, text, fault in (0, 1), 3 if fault == 2 else 0))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (gaps, *counts, illegal), out


def wanted(conv, rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    facts, told = judged(rows)
    cost, audit, lines = least(told)
    text = "\n".join(f"{r}:{t}" for r, t in lines)
    return (conv, *facts, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def hurt(conv, turn, role, text):
    """Rows that the damage leaves of one row."""
    role, text = (" " if x is None else x for x in (role, text))
    kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
    text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
    return [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)


def odd_rows(seed, convs, most):
    rnd = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "user", "assistant"], ["Yes.", "No", "", " \t", "Why?", "Fine!\n", "a", None, "é.", "x "]
    rows = []
    for conv in [*range(convs), None]:
        for turn in range(rnd.randint(1, most)):
            rows.append((conv, rnd.choice([turn, turn, turn, None, turn * 2, -1]), rnd.choice(roles), rnd.choice(texts) if rnd.random() < 0.5 else f"text {rnd.random()}" + rnd.choice([".", "", "?"])))
    return rows


def test_agenda_against_all_repairs():
    rnd = random.Random(5)
    for _ in range(150):
        rows = [(rnd.choice(["user", "assistant", "system", "tool"]), f"t{i}", rnd.random() < 0.2, rnd.choice([0, 0, 3])) for i in range(rnd.randint(0, 3))]
        best = min(every_repair(rows), key=lambda r: r[:2])
        assert least(rows)[:2] == best[:2]
        told = [(r[:1], more, int(must)) for r, _, must, more in rows]
        ((cost, audit),) = conversations.lightest(told).values()
        assert (cost, audit) == best[:2]
        lines = conversations.repaired(told, [(r, t) for r, t, _, _ in rows], audit)
        assert [(x["role"], x["text"]) for x in lines] == best[2]


@pytest.mark.parametrize("rows_in_segment", [512, 3, 1])
def test_equals_brute_force(spark, rows_in_segment):
    rows = odd_rows(rows_in_segment, 40, 14) + [(900, i, "user" if i % 3 else "assistant", f"turn {i}" + "." * (i % 2)) for i in range(300)]
    by_conv = {}
    for row in rows:
        by_conv.setdefault(row[0], []).extend(hurt(*row))
    want = sorted((wanted(conv, found) if found else (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for conv, found in by_conv.items()), key=str)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, cost int").repartition(5)
    mended = conversations.repair(conversations.damage(df), copies_col="copies", segment_rows=rows_in_segment)
    found = conversations.summary(mended)
    assert sorted(map(tuple, found.collect()), key=str) == want
    if rows_in_segment < 512:
        assert mended.filter("conv_id = 900").count() > 50


def test_query_equals_sql(spark):
    con = compare.connect("/root/testdata/sf0.01")
    found = queries.op11_repair_conversations(spark, "/root/testdata/sf0.01")
    assert compare.difference(found, con, queries.SQL["op11_repair_conversations"]) is None


def test_sql_and_query_on_odd_rows(spark):
    import duckdb
    import pandas as pd

    rows = [r for r in odd_rows(9, 60, 9) if r[2] != ""]
    con = duckdb.connect()
    frame = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    con.register("conversations", frame)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = conversations.summary(conversations.repair(conversations.damage(df), copies_col="copies"))
    assert compare.difference(found, con, queries.SQL["op11_repair_conversations"]) is None


def test_undamaged_rows_and_edges(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Hello!"), (2, 0, "assistant", "Hello."), (3, None, None, None),
            (4, 0, "user", "q?"), (4, 0, "user", "q?"), (4, 1, "assistant", "x" * 3_000_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in conversations.repair(df).filter("whole").collect()}
    out |= {r["conv_id"]: r for r in conversations.summary(conversations.repair(df)).collect() if r["conv_id"] not in out}
    got = {c: (r["cost"], r["audit"]) for c, r in out.items()}
    assert got == {1: (0, "KKK"), 2: (3, "IK"), 3: (4, "D"), 4: (7, "KDK")}
    assert conversations.summary(conversations.repair(df.limit(0))).collect() == []
    many = spark.range(5000).selectExpr("1L AS conv_id", "0L AS turn", "'user' AS role", "'again.' AS text")
    (only,) = conversations.summary(conversations.repair(many)).collect()
    assert (only["duplicate"], only["audit"], only["cost"]) == (4999, "K" + "D" * 4999 + "I", 4 * 4999 + 3)
