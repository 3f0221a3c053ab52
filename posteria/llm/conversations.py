"""Repair of conversation structure by Knuth's lightest derivations.

A conversation is right if its roles begin with at most one system turn and
then alternate user, assistant to the end. Repairs are weighted deductions
over items (rows read, state of the roles so far): keep, rerole, delete a row,
insert a turn. An agenda pops the item of least (cost, audit), where the audit
is the string of the edits' initials; every deduction makes both larger, so
what is popped is final, and the first complete item is the answer. Two ways
to one item at one cost never have audits of which one begins the other: that
would take more insertions and so cost more. Hence a least audit stays least
whatever is added behind it.

Conversations of any length are read in order, in segments. A conversation
that lies whole in one segment is repaired there. Of others each segment gives
the lightest derivation from every state to every state, one pass over those
small tables finds the states between segments, and each segment is then
repaired by itself.
"""

from __future__ import annotations

import hashlib
import heapq
import os.path
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posteria.llm.tables import give_back, pick
from posteria.session import stage

SEGMENT_ROWS = 512
SEGMENT_CHARS = 4 << 20
REROLE, DELETE, INSERT, CUT_SHORT = 3, 4, 3, 3
#: States of ``(s?(ua)+)?``: nothing yet, after s, after u, after a. From each, what initial leads where.
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The one role other than system that may come next.
EXPECTED = ("user", "user", "assistant", "user")
DONE = (0, 3)
FACTS = "n_rows long, blank long, duplicate long, truncated long, illegal long, least_turn long, most_turn long, n_turns long, first_initial string, last_initial string"
LINES = "array<struct<role:string,text:string>>"


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: rows hurt by crc32(``conv_id:turn``) % 20, nulls read as one space.

    0 drops the row (no copies), 1 empties its text, 2 takes out ``[.!?]``,
    3 makes two copies, 4 makes the role user.
    """
    text_of = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.encode(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")), "UTF-8")), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text_of("text"), "[.!?]", "")).otherwise(text_of("text"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(text_of("role")).alias("role"),
        text.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def lightest(rows: list[tuple[str, int, int]], start: int = 0, goals: tuple[int, ...] = DONE, every: bool = False) -> dict[int, tuple[int, str]]:
    """State after all rows: (cost, audit), for the lightest goal or, with ``every``, for all states that can be reached.

    A row is (initial of its role, surcharge if it is not deleted, how often it
    must be deleted, else 0).
    """
    agenda, final, found = [(0, "", 0, start)], set(), {}
    while agenda:
        cost, audit, at, state = heapq.heappop(agenda)
        if (at, state) in final:
            continue
        final.add((at, state))
        if at == len(rows):
            found[state] = (cost, audit)
            if not every and state in goals:
                return {state: (cost, audit)}
        expected = EXPECTED[state][0]
        after = STEPS[state][expected]
        if (at, after) not in final:
            heapq.heappush(agenda, (cost + INSERT, audit + "I", at, after))
        if at < len(rows):
            initial, more, must = rows[at]
            times = must or 1
            heapq.heappush(agenda, (cost + DELETE * times, audit + "D" * times, at + 1, state))
            if not must:
                heapq.heappush(agenda, (cost + more + REROLE, audit + "R", at + 1, after))
                if initial in STEPS[state]:
                    heapq.heappush(agenda, (cost + more, audit + "K", at + 1, STEPS[state][initial]))
    return found


def repaired(rows: list[tuple[str, int, int]], said: list[tuple[str, str]], audit: str, state: int = 0) -> list[dict]:
    """Turns that the edits of the audit leave, from that state on."""
    at, out, edits = 0, [], iter(audit)
    for edit in edits:
        if edit == "D":
            for _ in range((rows[at][2] or 1) - 1):
                next(edits)
            at += 1
            continue
        role, text = (EXPECTED[state], "") if edit == "I" else said[at]
        role = EXPECTED[state] if edit == "R" else role
        state = STEPS[state][role[:1]]
        at += edit != "I"
        out.append({"role": role, "text": text})
    return out


class Segment:
    """Rows of one conversation in order, with what is wrong with them."""

    solid = re.compile(r"[^\x20\x09-\x0D]")

    def __init__(self):
        self.rows, self.said, self.held = [], [], 0
        self.n = self.blank = self.duplicate = self.truncated = self.illegal = self.n_turns = 0
        self.least = self.most = self.first = self.last = None

    def add(self, turn: int | None, role: str, text: str, copies: int, first: bool) -> None:
        """``copies`` equal rows; ``first``: no row before them says the same in the same role."""
        if not copies:
            return
        initial = role[:1]
        pair = lambda a, b: a + b not in ("su", "ua", "au")
        self.illegal += (self.n > 0 and pair(self.last, initial)) + (copies - 1) * pair(initial, initial)
        self.first = initial if self.first is None else self.first
        self.last = initial
        self.n += copies
        if turn is not None and (self.most is None or turn != self.most):
            self.n_turns += 1
            self.least, self.most = turn if self.least is None else self.least, turn
        # cut from the end, not by a pattern over the text, which would try every place
        end = text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")
        must = copies
        if not end:
            self.blank += copies
        elif not first:
            self.duplicate += copies
        else:
            short = end[-1] not in ".!?"
            self.truncated += short
            self.duplicate += copies - 1
            self.rows.append((initial, CUT_SHORT if short else 0, 0))
            self.said.append((role, text))
            must = copies - 1
        if must:
            self.rows.append((initial, 0, must))
            self.said.append((role, ""))  # deleted whatever it says
        self.held += len(text)

    def full(self, most_rows: int) -> bool:
        return len(self.rows) >= most_rows or self.held >= SEGMENT_CHARS

    def facts(self) -> dict:
        return {
            "n_rows": self.n, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal,
            "least_turn": self.least, "most_turn": self.most, "n_turns": self.n_turns, "first_initial": self.first, "last_initial": self.last,
        }


def _schema(kind: str, conv: T.DataType) -> tuple[T.StructType, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = T.StructType([T.StructField("conv", conv), *T.StructType.fromDDL(kind).fields])
    return kind, to_arrow_schema(kind)


def _batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 1 + sum(len(x["text"] or "") for x in row.get("lines") or row.get("said") or ())
        if len(held) >= 1024 or size >= SEGMENT_CHARS:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of sorted batches, a few thousand at a time as Python objects."""
    for batch in batches:
        for start in range(0, batch.num_rows, 2048):
            yield from zip(*(c.to_pylist() for c in batch.slice(start, 2048).columns))


def _segments(ordered: DataFrame, segment_rows: int) -> DataFrame:
    """Segments of sorted rows. ``whole`` ones are repaired; others carry ways, rows and texts."""
    kind = f"part long, place long, whole boolean, {FACTS}, cost long, audit string, lines {LINES}, ways array<struct<a:int,b:int,cost:long,audit:string>>, rows array<struct<initial:string,more:int,must:long>>, said {LINES}"
    kind, schema = _schema(kind, ordered.schema["conv"].dataType)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part, place = TaskContext.get().partitionId(), 0
        conv, segment, opened = None, None, True

        def ended(closed: bool) -> dict:
            # the first and the last conversation of a task may go on in another one
            out = {"conv": conv, "part": part, "place": place, "whole": closed and not opened, **segment.facts()}
            if out["whole"]:
                ((cost, audit),) = lightest(segment.rows).values()
                return out | {"cost": cost, "audit": audit, "lines": repaired(segment.rows, segment.said, audit)}
            ways = [{"a": a, "b": b, "cost": c, "audit": s} for a in range(4) for b, (c, s) in lightest(segment.rows, a, every=True).items()]
            rows = [dict(zip(("initial", "more", "must"), r)) for r in segment.rows]
            return out | {"ways": ways, "rows": rows, "said": [{"role": r, "text": t} for r, t in segment.said]}

        for found, turn, role, text, copies, first in _told(batches):
            if segment is None or found != conv:
                if segment is not None:
                    yield ended(True)
                    opened, place = False, place + 1
                conv, segment = found, Segment()
            elif segment.full(segment_rows):
                opened = True
                yield ended(False)
                segment, place = Segment(), place + 1
            segment.add(turn, role, text, copies, first)
        if segment is not None:
            yield ended(False)
        give_back()

    return ordered.mapInArrow(lambda batches: _batches(cut(batches), schema), kind)


def _chosen(ways: DataFrame) -> DataFrame:
    """part, place, a, b: the states before and after each segment of the lightest repair of its conversation."""
    kind, schema = _schema("part long, place long, a int, b int", ways.schema["conv"].dataType)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        def ended() -> Iterator[dict]:
            state = min((best[q], q) for q in DONE if q in best)[1]
            for part, place, came in reversed(steps):
                yield {"conv": conv, "part": part, "place": place, "a": came[state], "b": state}
                state = came[state]

        conv, best, steps = None, None, []
        for found, part, place, ways in _told(batches):
            if best is None or found != conv:
                if best is not None:
                    yield from ended()
                conv, best, steps = found, {0: (0, "")}, []
            options: dict[int, list] = {}
            for w in ways:
                if w["a"] in best:
                    cost, audit = best[w["a"]]
                    options.setdefault(w["b"], []).append(((cost + w["cost"], audit + w["audit"]), w["a"]))
            picked = {b: min(found) for b, found in options.items()}
            steps.append((part, place, {b: a for b, (_, a) in picked.items()}))
            # what all four begin with decides nothing any more
            shared = len(os.path.commonprefix([audit for (_, audit), _ in picked.values()]))
            best = {b: (cost, audit[shared:]) for b, ((cost, audit), _) in picked.items()}
        if best is not None:
            yield from ended()

    return ways.mapInArrow(lambda batches: _batches(choose(batches), schema), kind)


def repair(
    rows: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    copies_col: str | None = None,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Repaired conversations: one row each, or one for every segment of a long one.

    conv_id, segment (text that sorts by place, one for all of most), whole (it
    is all of its conversation), what was found (n_rows, blank, duplicate,
    truncated, illegal, turns and initials at the ends), and what was done:
    cost, audit, lines (role, text).

    Rows go by turn, nulls first, then role and text. Null roles and texts are
    one space. ``copies_col`` says how often a row is there; 0 tells only that
    its conversation exists. A null conversation id is one conversation. Rows
    of a role with another initial than s, u, a are reroled or deleted. Equal
    rows are counted before they are shuffled, texts of any length are read
    whole, no rows give no rows, and extra columns are left out.
    """
    copies = {"copies": copies_col} if copies_col else {}
    narrow = pick(rows, conv=conv_col, turn=turn_col, role=role_col, text=text_col, **copies)
    narrow = narrow.withColumn("copies", F.col("copies").cast("long") if copies_col else F.lit(1).cast("long"))
    there = F.col("copies") > 0
    or_space = lambda name: F.when(there, F.coalesce(name, F.lit(" "))).alias(name)
    told = narrow.select("conv", F.when(there, F.col("turn").cast("long")).alias("turn"), or_space("role"), or_space("text"), "copies")
    # a digest stands for the text in the keys; the text itself goes along once
    told = told.withColumn("said", F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256)))
    counted = stage(
        told.groupBy("conv", "turn", "said").agg(F.first("role").alias("role"), F.first("text").alias("text"), F.sum("copies").alias("copies")), "turns"
    )
    at = F.struct(F.col("turn").isNotNull().alias("named"), "turn")
    again = counted.filter("copies > 0").groupBy("conv", "said").agg(F.min(at).alias("at"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = stage(again.select(F.col("conv").alias("_conv"), F.col("said").alias("_said"), F.col("at.turn").alias("_turn")), "again")
    seen = counted.join(again, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("said") == F.col("_said")), "left")
    first = F.col("_said").isNull() | F.col("turn").eqNullSafe(F.col("_turn"))
    order = ["conv", "turn", "role", "text"]
    ordered = seen.select(*order, "copies", first.alias("first")).repartitionByRange(*order).sortWithinPartitions(*order)
    found = stage(_segments(ordered, segment_rows), "segments")
    parts = found.filter(~F.col("whole"))
    chosen = stage(
        _chosen(parts.select("conv", "part", "place", "ways").repartition("conv").sortWithinPartitions("conv", "part", "place")).drop("conv"), "chosen"
    )
    facts = [f.name for f in T.StructType.fromDDL(FACTS).fields]
    kind, schema = _schema(f"part long, place long, whole boolean, {FACTS}, cost long, audit string, lines {LINES}", found.schema["conv"].dataType)
    names = kind.names

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for start in range(batch.num_rows):
                (row,) = batch.slice(start, 1).to_pylist()
                ((cost, audit),) = [(w["cost"], w["audit"]) for w in row["ways"] if (w["a"], w["b"]) == (row["a"], row["b"])]
                rows = [(r["initial"], r["more"], r["must"]) for r in row["rows"]]
                lines = repaired(rows, [(s["role"], s["text"]) for s in row["said"]], audit, row["a"])
                yield {name: row[name] for name in names} | {"cost": cost, "audit": audit, "lines": lines}

    mended = parts.join(chosen, ["part", "place"]).mapInArrow(lambda batches: _batches(mend(batches), schema), kind)
    segment = F.format_string("%010d-%010d", "part", "place").alias("segment")
    out = found.filter("whole").select(*names).unionByName(mended)
    return out.select(F.col("conv").alias(conv_col), segment, "whole", *facts, "cost", "audit", "lines")


def summary(mended: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every repaired conversation.

    Most are one row and stay where they are. Segments of long ones meet in
    order and are hashed as they pass, one segment in memory at a time.
    """
    line = F.transform("lines", lambda x: F.concat(x["role"], F.lit(":"), x["text"]))
    text = F.concat_ws("\n", line)
    gaps = F.coalesce(F.col("most_turn") - F.col("least_turn") + 1 - F.col("n_turns"), F.lit(0).cast("long"))
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    whole = mended.filter("whole").select(F.col(conv_col).alias("conv"), gaps.alias("gaps"), *counts, "audit", F.sha2(text, 256).alias("repaired_sha256"))
    kind, schema = _schema("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string", whole.schema["conv"].dataType)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now = None

        def ended() -> dict:
            turns = now["most"] - now["least"] + 1 - now["n"] if now["least"] is not None else 0
            return {"conv": now["conv"], "gaps": turns, **now["sums"], "audit": "".join(now["audit"]), "repaired_sha256": now["hash"].hexdigest()}

        for batch in batches:
            for start in range(batch.num_rows):
                (row,) = batch.slice(start, 1).to_pylist()
                if now is None or row["conv"] != now["conv"]:
                    if now is not None:
                        yield ended()
                    now = {"conv": row["conv"], "least": None, "most": None, "n": 0, "last": None, "audit": [], "hash": hashlib.sha256(), "said": False, "sums": dict.fromkeys(counts, 0)}
                for name in counts:
                    now["sums"][name] += row[name]
                if now["last"] is not None and row["first_initial"] is not None:
                    now["sums"]["illegal"] += now["last"] + row["first_initial"] not in ("su", "ua", "au")
                now["last"] = row["last_initial"] if row["last_initial"] is not None else now["last"]
                if row["least_turn"] is not None:
                    now["n"] += row["n_turns"] - (now["most"] == row["least_turn"])
                    now["least"] = row["least_turn"] if now["least"] is None else now["least"]
                    now["most"] = row["most_turn"]
                now["audit"].append(row["audit"])
                if row["lines"]:
                    if now["said"]:
                        now["hash"].update(b"\n")
                    now["hash"].update(row["text"].encode())
                    now["said"] = True
        if now is not None:
            yield ended()

    long = mended.filter("not whole").select(
        F.col(conv_col).alias("conv"), "segment", *counts, "first_initial", "last_initial", "least_turn", "most_turn", "n_turns", "audit", (F.size("lines") > 0).alias("lines"), text.alias("text")
    )
    ordered = long.repartition("conv").sortWithinPartitions("conv", "segment")
    merged = ordered.mapInArrow(lambda batches: _batches(merge(batches), schema), kind)
    return whole.unionByName(merged).withColumnRenamed("conv", conv_col)
