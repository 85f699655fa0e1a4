"""Repair of conversations by generalised LR parsing over the grammar of roles.

    talk  ->  nothing | turns | system turns
    turns ->  pair | turns pair
    pair  ->  user assistant

The parser reads a conversation's rows in order. Where the rows break the grammar it
may delete a row, give it another role or insert an empty one, each at its cost, so
many stacks are alive at once: they form one graph-structured stack, whose tops are
what each stack waits for next. Stacks with equal tops are merged, the one of least
(cost, audit) stays. Nothing is lost by that: equal tops go on alike whatever lies
below them, and of two audits of the same rows and cost neither begins the other, so
what is appended later does not change their order.

For the same reason a stretch of rows has a table of its own, from each top that it
may begin with to each top that it may end with, and tables of neighbours combine. A
conversation is parsed in stretches of SEGMENT_ROWS rows or SEGMENT_BYTES of text at
most, which may lie in several partitions; conversations that lie whole in one
partition and one stretch, nearly all, end there. Of the others, the tables are combined
in order (a few cells for each stretch), and the repaired texts go through SHA-256
stretch by stretch in a stream, so memory holds one stretch of one conversation.

Rows are counted before they are moved: equal rows (conversation, turn, role, text)
are one row with a count. Whether a text was seen before is joined from the least turn
of each (conversation, role, text), known by their SHA-256, on keys that include the
turn, so no key is hot. Only then are rows laid out by ranges of conversation and turn.

Defined results: a null role or text is one space, in the damage's key too. A null
conv_id is a conversation of its own, a null turn comes first and makes no gap. Rows of
one turn go by role, then by the SHA-256 of the text. A role without a first letter
(empty) fits no grammar and no neighbour. Blank rows come before the other faults,
duplicates before truncated ones; a duplicate is what the same conversation has with
equal role and text earlier, deleted rows included. Conversations without rows have
zeros, an empty audit and the hash of nothing. An empty table has no rows. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from . import common

DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
SEGMENT_ROWS, SEGMENT_BYTES = 2048, 4 << 20

#: Tops of the stack. An assistant's row never stays on top: the pair is reduced onto the turns at once.
START, SYSTEM, USER, TURNS = range(4)
#: What each top shifts, by the role's first letter, and the top after that and its reductions.
SHIFT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": TURNS}, {"u": USER})
#: The role that an insertion or another role must have on each top.
WANTED = ("user", "user", "assistant", "user")
#: Tops at which a conversation may end.
FINAL = (START, TURNS)

Stack = dict[int, tuple[int, str]]
_LEGAL = {"su", "ua", "au"}
_SPACE = " \t\n\x0b\x0c\r"


def _merge(tops: Stack, top: int, cost: int, audit: str) -> bool:
    old = tops.get(top)
    if old is None or (cost, audit) < old:
        tops[top] = (cost, audit)
        return True
    return False


def insert(tops: Stack) -> None:
    """Adds the stacks that insertions make of these, as many in a row as help."""
    todo = list(tops)
    while todo:
        top = todo.pop()
        cost, audit = tops[top]
        to = SHIFT[top][WANTED[top][0]]
        if _merge(tops, to, cost + INSERT, audit + "I"):
            todo.append(to)


def read(tops: Stack, initial: str, must_go: bool, truncated: bool) -> Stack:
    """The stacks after a row: deleted, kept or with another role, on each stack before it."""
    insert(tops)
    out: Stack = {}
    more = TRUNCATED if truncated else 0
    for top, (cost, audit) in tops.items():
        _merge(out, top, cost + DELETE, audit + "D")
        if not must_go:
            if initial in SHIFT[top]:
                _merge(out, SHIFT[top][initial], cost + more, audit + "K")
            _merge(out, SHIFT[top][WANTED[top][0]], cost + REROLE + more, audit + "R")
    return out


def end(tops: Stack) -> tuple[int, int, str]:
    """top, cost, audit of the best stack that may end here. Conversations end with this; stretches of them don't."""
    insert(tops)
    cost, audit, top = min((*tops[t], t) for t in FINAL if t in tops)
    return top, cost, audit


class Stretch:
    """Rows in order: role, text, count, blank, first (not seen in an earlier turn), truncated, turn. Counts zero only say that the conversation is there."""

    def __init__(self):
        self.rows: list[tuple[str, str, int, bool, bool, bool]] = []
        self.bytes = 0
        self.facts = dict.fromkeys(("n", "blank", "duplicate", "truncated", "illegal", "turns"), 0) | {"head": "", "tail": "", "low": None, "high": None}

    def add(self, role: str, text: str, n: int, blank: bool, first: bool, truncated: bool, turn: int | None) -> None:
        if not n:
            return
        self.rows.append((role, text, n, blank, first, truncated))
        self.bytes += len(role) + len(text)
        copies = 0 if blank or not first else n - 1
        one = {"n": n, "blank": n if blank else 0, "duplicate": 0 if blank else copies if first else n, "truncated": int(not blank and first and truncated), "illegal": n - 1, "turns": int(turn is not None), "head": role[:1], "tail": role[:1], "low": turn, "high": turn}
        self.facts = joined(self.facts, one)

    def parse(self, entry: int) -> Stack:
        tops: Stack = {entry: (0, "")}
        for role, _, n, blank, first, truncated in self.rows:
            gone = n if blank or not first else n - 1
            if gone < n:
                tops = read(tops, role[:1], False, truncated)
            if gone:
                insert(tops)
                tops = {t: (c + DELETE * gone, a + "D" * gone) for t, (c, a) in tops.items()}
        return tops

    def lines(self, entry: int, audit: str) -> list[str]:
        """The repaired rows that the audit makes of these, from the top on which they begin."""
        out, top = [], entry
        copies = ((role, text) for role, text, n, *_ in self.rows for _ in range(n))
        for letter in audit:
            role, text = (WANTED[top], "") if letter == "I" else next(copies)
            if letter == "D":
                continue
            if letter == "R":
                role = WANTED[top]
            top = SHIFT[top][role[:1]]
            out.append(f"{role}:{text}")
        return out


def joined(a: dict, b: dict) -> dict:
    """The facts of rows that follow each other."""
    if not a["n"] or not b["n"]:
        return a if a["n"] else b
    sums = {k: a[k] + b[k] for k in ("n", "blank", "duplicate", "truncated", "illegal", "turns")}
    sums["illegal"] += a["tail"] + b["head"] not in _LEGAL
    sums["turns"] -= a["high"] is not None and a["high"] == b["low"]
    return sums | {"head": a["head"], "tail": b["tail"], "low": b["low"] if a["low"] is None else a["low"], "high": a["high"] if b["high"] is None else b["high"]}


def counts(facts: dict) -> dict:
    gaps = 0 if facts["low"] is None else facts["high"] - facts["low"] + 1 - facts["turns"]
    return {"gaps": gaps} | {k: facts[k] for k in ("blank", "duplicate", "truncated", "illegal")}


def digest(lines: list[str]) -> str:
    return hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest()


# --- on Spark -------------------------------------------------------------------------------

_KEY = "gone boolean, conv long"
_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_FACTS = "facts struct<n: long, blank: long, duplicate: long, truncated: long, illegal: long, turns: long, head: string, tail: string, low: long, high: long>"
_CELLS = "cells array<struct<entry: int, top: int, cost: long, audit: string>>"
_ROWS = "rows array<struct<role: string, text: string, n: long>>"
_PARSED = f"{_KEY}, {_RESULT}, part int, seq long, {_FACTS}, {_CELLS}, {_ROWS}"


def damaged(conversations: DataFrame) -> DataFrame:
    """gone (conv_id is null), conv, turn, role, text, n: what is left of each row after the damage, and how often (0: nothing is)."""
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(own("conv_id"), F.lit(":"), own("turn")).cast("binary")) % 20
    x = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), own("role").alias("role"), own("text").alias("text"), kind.alias("kind"))
    there = F.col("kind") != 0
    return x.select(
        F.col("conv_id").isNull().alias("gone"),
        F.coalesce("conv_id", F.lit(0)).alias("conv"),
        F.when(there, F.col("turn")).alias("turn"),
        F.when(~there, "").when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(~there | (F.col("kind") == 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(~there, 0).when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def in_order(rows: DataFrame) -> DataFrame:
    """Distinct rows of damaged with their counts and faults, laid out by ranges of conversation and turn."""
    x = rows.select("gone", "conv", F.col("turn").isNotNull().alias("dated"), F.coalesce("turn", F.lit(0)).alias("turn"), "role", F.sha2("text", 256).alias("sha"), "text", "n")
    key = ["gone", "conv", "dated", "turn", "role", "sha"]
    distinct = x.groupBy(*key).agg(F.sum("n").alias("n"), F.min("text").alias("text"))
    least = x.where("n > 0").groupBy("gone", "conv", "role", "sha").agg(F.min(F.struct("dated", "turn")).alias("t"))
    first = least.select("gone", "conv", "t.dated", "t.turn", "role", "sha", F.lit(True).alias("first"))
    stripped = F.rtrim(F.col("text"), F.lit(_SPACE))
    faults = distinct.join(first, key, "left").withColumns({"first": F.coalesce("first", F.lit(False)), "blank": stripped == "", "truncated": ~F.right(stripped, F.lit(1)).isin(".", "!", "?")})
    order = [F.desc("gone"), F.asc("conv"), F.asc("dated"), F.asc("turn"), F.asc("role"), F.asc("sha")]
    return faults.repartitionByRange(*order).sortWithinPartitions(*order).drop("sha")


def _stream(batches: Iterator[pa.RecordBatch], step: int = 1000) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield from batch.slice(at, step).to_pylist()


def _batches(rows: Iterator[dict], schema: pa.Schema, most: int = 500, weight: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += row.pop("__size", 100)
        if len(held) == most or size >= weight:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _arrow(spark: SparkSession, schema: str) -> pa.Schema:
    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def parsed(ordered: DataFrame) -> DataFrame:
    """_PARSED: the result of each conversation that lies whole inside a partition, and the stretches of the others, with their tables."""
    schema = _arrow(ordered.sparkSession, _PARSED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part = TaskContext.get().partitionId()
        key, stretch, seq, inside = None, Stretch(), 0, False

        def closed(last: bool) -> dict:
            size = 300 + stretch.bytes
            if last and inside and seq == 0:
                _, cost, audit = end(stretch.parse(START))
                return {"gone": key[0], "conv": key[1], **counts(stretch.facts), "cost": cost, "audit": audit, "repaired_sha256": digest(stretch.lines(START, audit))}
            cells = [{"entry": e, "top": t, "cost": c, "audit": a} for e in range(4) for t, (c, a) in stretch.parse(e).items()]
            rows = [{"role": r, "text": x, "n": n} for r, x, n, *_ in stretch.rows]
            return {"gone": key[0], "conv": key[1], "part": part, "seq": seq, "facts": stretch.facts, "cells": cells, "rows": rows, "__size": size}

        for r in _stream(batches):
            if (here := (r["gone"], r["conv"])) != key:
                if key is not None:
                    yield closed(True)
                inside, key, stretch, seq = key is not None, here, Stretch(), 0
            elif len(stretch.rows) >= SEGMENT_ROWS or stretch.bytes >= SEGMENT_BYTES:
                yield closed(False)
                stretch, seq = Stretch(), seq + 1
            stretch.add(r["role"], r["text"], r["n"], r["blank"], r["first"], r["truncated"], r["turn"] if r["dated"] else None)
        if key is not None:
            inside = False  # the next partition may go on with it
            yield closed(True)

    return ordered.mapInArrow(lambda batches: _batches(run(batches), schema), _PARSED)


_COMBINED = f"{_KEY}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, part int, seq long, entry int, top int"


def combined(stretches: DataFrame) -> DataFrame:
    """_COMBINED: of each conversation in stretches its result (part is null), and for each stretch the tops at which the best repair enters and leaves it."""
    schema = _arrow(stretches.sparkSession, _COMBINED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        key, tops, facts, ways = None, {START: (0, "")}, _none(), []

        def closed() -> Iterator[dict]:
            top, cost, audit = end(dict(tops))
            # what is inserted at the very end belongs to no stretch: back to the top that it was put on
            leave = next(t for t, (c, a) in tops.items() if (k := _inserted(t, top)) is not None and (c + INSERT * k, a + "I" * k) == (cost, audit))
            named = {"gone": key[0], "conv": key[1]}
            yield named | counts(facts) | {"cost": cost, "audit": audit, "entry": leave, "top": top}
            for part, seq, back in reversed(ways):
                yield named | {"part": part, "seq": seq, "entry": back[leave], "top": leave}
                leave = back[leave]

        for r in _stream(batches, 50):
            if (here := (r["gone"], r["conv"])) != key:
                if key is not None:
                    yield from closed()
                key, tops, facts, ways = here, {START: (0, "")}, _none(), []
            out, back = {}, {}
            for cell in r["cells"]:
                if cell["entry"] in tops:
                    cost, audit = tops[cell["entry"]]
                    if _merge(out, cell["top"], cost + cell["cost"], audit + cell["audit"]):
                        back[cell["top"]] = cell["entry"]
            tops, facts = out, joined(facts, r["facts"])
            ways.append((r["part"], r["seq"], back))
        if key is not None:
            yield from closed()

    x = stretches.select("gone", "conv", "part", "seq", "facts", "cells").repartition("gone", "conv").sortWithinPartitions("gone", "conv", "part", "seq")
    return x.mapInArrow(lambda batches: _batches(run(batches), schema), _COMBINED)


def _none() -> dict:
    return Stretch().facts


def _inserted(top: int, to: int) -> int | None:
    """How many insertions lead from a top to another, if any do."""
    for k in range(4):
        if top == to:
            return k
        top = SHIFT[top][WANTED[top][0]]
    return None


def hashed(stretches: DataFrame, ways: DataFrame) -> DataFrame:
    """_KEY, repaired_sha256: texts of the stretches along the best ways, in order. An order that no sum can change: SHA-256 takes bytes one after the other, so a conversation streams through one task."""
    spark = stretches.sparkSession
    piece = f"{_KEY}, part int, seq long, piece binary, lines long"
    piece_schema, hash_schema = _arrow(spark, piece), _arrow(spark, f"{_KEY}, repaired_sha256 string")

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for r in _stream(batches, 1):
            stretch = Stretch()
            stretch.rows = [(x["role"], x["text"], x["n"]) for x in r["rows"]]
            audit = next(c["audit"] for c in r["cells"] if c["entry"] == r["entry"] and c["top"] == r["top"])
            lines = stretch.lines(r["entry"], audit)
            data = "\n".join(lines).encode("utf-8", "surrogatepass")
            yield {"gone": r["gone"], "conv": r["conv"], "part": r["part"], "seq": r["seq"], "piece": data, "lines": len(lines), "__size": len(data)}

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        key, sha, lines = None, None, 0
        for r in _stream(batches, 1):
            if (here := (r["gone"], r["conv"])) != key:
                if key is not None:
                    yield {"gone": key[0], "conv": key[1], "repaired_sha256": sha.hexdigest()}
                key, sha, lines = here, hashlib.sha256(), 0
            if r["lines"]:
                sha.update((b"\n" if lines else b"") + r["piece"])
                lines += r["lines"]
        if key is not None:
            yield {"gone": key[0], "conv": key[1], "repaired_sha256": sha.hexdigest()}

    pieces = stretches.select("gone", "conv", "part", "seq", "cells", "rows").join(ways.where("part is not null").select("gone", "conv", "part", "seq", "entry", "top"), ["gone", "conv", "part", "seq"])
    pieces = pieces.mapInArrow(lambda b: _batches(replay(b), piece_schema), piece)
    # insertions at the end of a conversation are its last piece
    ends = ways.where("part is null")
    tail = ends.select("gone", "conv", F.lit(None).cast("int").alias("part"), F.lit(None).cast("long").alias("seq"), _inserted_lines().alias("piece"))
    tail = tail.select("*", F.when(F.length("piece") > 0, 1).otherwise(0).cast("long").alias("lines"))
    every = pieces.unionByName(tail).repartition("gone", "conv").sortWithinPartitions("gone", "conv", F.asc_nulls_last("part"), "seq")
    return every.mapInArrow(lambda b: _batches(stream(b), hash_schema), f"{_KEY}, repaired_sha256 string")


def _inserted_lines():
    """The lines that lead from the top on which the last stretch ends (entry) to the end (top)."""
    out = F.lit("")
    for a in range(4):
        for b in range(4):
            k, lines, top = _inserted(a, b), [], a
            for _ in range(k or 0):
                lines.append(WANTED[top] + ":")
                top = SHIFT[top][WANTED[top][0]]
            out = F.when((F.col("entry") == a) & (F.col("top") == b), "\n".join(lines)).otherwise(out)
    return out.cast("binary")


RESULT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def repair(rows: DataFrame) -> DataFrame:
    """RESULT of rows as damaged gives them (gone, conv, turn, role, text, n)."""
    every = common.parted(parsed(in_order(rows)), "parsed")
    id_ = F.when(~F.col("gone"), F.col("conv")).alias("conv_id")
    done = every.where("part is null").select(id_, *RESULT[1:])
    stretches = every.where("part is not null")
    ways = common.parted(combined(stretches), "ways")
    rest = ways.where("part is null").drop("part", "seq", "entry", "top").join(hashed(stretches, ways), ["gone", "conv"])
    return done.unionByName(rest.select(id_, *RESULT[1:]))


def op13_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged as the contract says: its faults, and the cheapest repair."""
    return repair(damaged(common.table(spark, sf_dir, "conversations")))
