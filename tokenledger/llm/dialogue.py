"""Conversation structure repair as a shortest path, found by auction.

A conversation's rows, in order of turn, are edited so that the initials of their roles read ``(s?(ua)+)?``: an optional
system row, then pairs of user and assistant. Nodes of the lattice are (row, state), with states: nothing yet, after s,
after u, after a; the first and the last accept. Arcs, with costs:

    D  delete a row                        2
    I  insert a user or assistant row      5, of empty text
    K  keep a row                          0 } plus 5 for a truncated row
    R  give a row the role that fits       1 }

Blank and duplicate rows can only be deleted. The auction (Bertsekas, 1991) keeps a price for each node, at most the cost
of any arc out of it plus the price there, and a path of arcs where both are equal. Its last node either extends the path
by an arc of least cost plus price, or raises its price to that sum and leaves the path. When the path reaches the end, all
arcs of all cheapest paths are tight, and a walk along tight arcs that takes the least letter each time gives the ASCII-least
edits: D, I, K, R. As an auction's work grows with the square of a lattice's length, long conversations are cut into blocks
of ``BLOCK`` rows, from the last to the first: the prices of a block's four entries are the costs of the exits of the one
before. Equal blocks are solved once.

Texts never wait in a task. Rows are numbered and stored; planning sees one byte for each row, and hashing reads the
repaired rows in order. A conversation's plan takes one byte a row in one task, since its audit is one string.

Edge cases: null roles and texts are one space. Rows go by turn (nulls first), then by role and text. A role of another
initial, or none, can be given another role or be deleted. Null ids are one conversation. Conversations without rows have no
plan, no repaired rows, and in the query zeros, an empty audit and the hash of nothing. Repeated rows are duplicates. An
empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenledger.llm.tables import stage

DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
BLOCK = 16
SPACE = " \t\n\x0b\x0c\r"

#: Classes of initials and faults as one number: class + 4 * fault.
_CLASSES, _OTHER = "sua", 3
_FAULTS = ("", "blank", "duplicate", "truncated")
_START, _AFTER_S, _AFTER_U, _AFTER_A = range(4)
#: The state after an initial, for each state in which it fits.
_NEXT = {_START: {"s": _AFTER_S, "u": _AFTER_U}, _AFTER_S: {"u": _AFTER_U}, _AFTER_U: {"a": _AFTER_A}, _AFTER_A: {"u": _AFTER_U}}
_LEGAL = {(0, 1), (1, 2), (2, 1)}  # su, ua, au

FACTS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
EDITS = "conv_id long, n long, place long, before string, own string, after string"


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with planted faults, by the checksum of ``conv_id:turn`` modulo 20: 0 none is left, 1 empty text, 2 no ``.!?``,
    3 twice, 4 role user."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(F.concat(shown[0], F.lit(":"), shown[1]).cast("binary")) % 20).alias("kind"),
    )
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.filter("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def numbered(rows: DataFrame) -> DataFrame:
    """``(conv_id, n, turn, role, text, code)``: rows in order, from 1, with the class of the role and the first fault."""
    plain = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    placed = plain.withColumn("n", F.row_number().over(order).cast("long"))
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    earlier = F.row_number().over(Window.partitionBy("conv_id", "digest").orderBy("n")) > 1
    seen = placed.withColumn("digest", digest).withColumn("repeat", earlier)
    ended = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1)).isin(".", "!", "?")
    fault = F.when(F.trim("text", F.lit(SPACE)) == "", 1).when(F.col("repeat"), 2).when(~ended, 3).otherwise(0)
    initial = F.instr(F.lit(_CLASSES), F.substring("role", 1, 1)) - 1
    kind = F.when((F.col("role") == "") | (initial < 0), _OTHER).otherwise(initial)
    return seen.select("conv_id", "n", "turn", "role", "text", (kind + 4 * fault).cast("int").alias("code"))


def _row_arcs(code: int, state: int) -> list[tuple[str, int, int, int]]:
    """``(letter, cost, rows passed, state)`` before a row, by letter."""
    kind, fault = code % 4, _FAULTS[code // 4]
    extra = TRUNCATED if fault == "truncated" else 0
    arcs = [("D", DELETE, 1, state)] + [("I", INSERT, 0, to) for initial, to in _NEXT[state].items() if initial != "s"]
    if fault not in ("blank", "duplicate"):
        arcs += [("K", extra, 1, to) for initial, to in _NEXT[state].items() if kind != _OTHER and initial == _CLASSES[kind]]
        arcs += [("R", REROLE + extra, 1, to) for initial, to in _NEXT[state].items() if initial != "s"]
    return arcs


def _lattice(codes: bytes, exits: tuple[int, ...] | None) -> list[list[tuple[str, int, int]]]:
    """``(letter, cost, node)`` out of each node ``4 * row + state``; the last node is the end."""
    end = 4 * (len(codes) + 1)
    arcs = [[(letter, cost, 4 * (i + step) + to) for letter, cost, step, to in _row_arcs(code, state)] for i, code in enumerate(codes) for state in range(4)]
    for state in range(4):
        if exits is not None:
            arcs.append([("", exits[state], end)])
        else:
            arcs.append([("", 0, end)] * (state in (_START, _AFTER_A)) + [("I", INSERT, 4 * len(codes) + to) for initial, to in _NEXT[state].items() if initial != "s"])
    return [*arcs, []]


def auction(arcs: list[list[tuple[str, int, int]]], prices: list[int], origin: int) -> None:
    """Raise the prices until the path from ``origin`` reaches the last node; then ``prices[origin]`` is its cost."""
    path, end = [origin], len(arcs) - 1
    while path[-1] != end:
        node = path[-1]
        best, to = min(((cost + prices[j], k, j) for k, (_, cost, j) in enumerate(arcs[node])), key=lambda x: x[:2])[::2]
        if prices[node] < best:
            prices[node] = best
            if len(path) > 1:
                path.pop()
        else:
            path.append(to)


def trace(arcs: list[list[tuple[str, int, int]]], prices: list[int], origin: int) -> tuple[str, int]:
    """The letters of the tight arcs from ``origin`` to the end, the least first, and the last node before the end."""
    letters, node = [], origin
    while True:
        letter, _, to = next(a for a in arcs[node] if prices[node] == a[1] + prices[a[2]])
        if to == len(arcs) - 1:
            return "".join(letters), node
        letters.append(letter)
        node = to


@lru_cache(1 << 16)
def _solved(codes: bytes, exits: tuple[int, ...] | None) -> tuple[tuple[int, ...], tuple[tuple[str, int], ...]]:
    """For each state before a block: the cost from there to the end, the block's edits and the state after it."""
    arcs = _lattice(codes, exits)
    prices, paths = [0] * len(arcs), []
    for origin in range(4):
        auction(arcs, prices, origin)
        letters, node = trace(arcs, prices, origin)
        paths.append((letters, node - 4 * len(codes)))
    return tuple(prices[:4]), tuple(paths)


def plan(codes: bytes, block: int = BLOCK) -> tuple[int, str]:
    """The least cost of a conversation and its edits."""
    solved, exits, base = [], None, 0
    for at in reversed(range(0, max(len(codes), 1), block)):
        costs, paths = _solved(codes[at : at + block], exits)
        solved.append(paths)
        least = min(costs)
        total, exits, base = base + costs[_START], tuple(c - least for c in costs), base + least
    letters, state = [], _START
    for paths in reversed(solved):
        part, state = paths[state]
        letters.append(part)
    return total, "".join(letters)


def steps(audit: str) -> list[tuple[int, str, str, str]]:
    """For each row: the place of the first row that it leaves, the initials inserted before it, what becomes of it (``K``,
    ``D`` or its new initial), and the initials inserted after it (the last row only)."""
    written = len(audit) - audit.count("D")
    system = written % 2
    initial = lambda place: "ua"[(place - system) % 2]
    out, place, start, before = [], 0, 0, []
    for letter in audit:
        if letter == "I":
            before.append(initial(place))
            place += 1
            continue
        out.append((start, "".join(before), initial(place) if letter == "R" else letter, ""))
        place += letter != "D"
        start, before = place, []
    if before and out:
        first, own_before, own, _ = out[-1]
        out[-1] = (first, own_before, own, "".join(before))
    return out


class _Conversation:
    """What planning keeps of a conversation while its rows pass by."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.codes = conv_id, bytearray()
        self.first = self.last = None
        self.turns = 0

    def take(self, turn: int | None, code: int) -> None:
        self.codes.append(code)
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.turns = turn, self.turns + 1

    def facts(self) -> tuple:
        faults = [code // 4 for code in self.codes]
        illegal = sum((a % 4, b % 4) not in _LEGAL for a, b in zip(self.codes, self.codes[1:], strict=False))
        cost, audit = plan(bytes(self.codes))
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (self.conv_id, gaps, *(faults.count(k) for k in (1, 2, 3)), illegal, cost, audit)


def _passing(rows: DataFrame, order: str, kind: str, start, take, close) -> DataFrame:
    """One conversation after the other, its rows in order: ``take(state, row)`` for each, ``close(state)`` at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, current = None, None
        for batch in batches:
            done = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                if state is None or row[0] != current:
                    if state is not None:
                        done.append(close(state))
                    state, current = start(row[0]), row[0]
                take(state, row)
            if done:
                yield from _batches(done, kind)
        if state is not None:
            yield from _batches([close(state)], kind)

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", order).mapInArrow(run, kind)


def _batches(rows: list[tuple], kind: str) -> Iterator[pa.RecordBatch]:
    names = [part.split() for part in kind.split(", ")]
    yield pa.RecordBatch.from_pydict({name: pa.array([r[i] for r in rows], pa.int64() if of == "long" else pa.string()) for i, (name, of) in enumerate(names)})


def plans(ordered: DataFrame) -> DataFrame:
    """``FACTS`` of each conversation of ``numbered`` rows."""
    return _passing(ordered.select("conv_id", "n", "turn", "code"), "n", FACTS, _Conversation, lambda state, row: state.take(row[2], row[3]), _Conversation.facts)


def edits(facts: DataFrame) -> DataFrame:
    """``EDITS``: what becomes of each row, from the audits."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv_id, audit in zip(batch.column("conv_id").to_pylist(), batch.column("audit").to_pylist(), strict=True):
                for n, step in enumerate(steps(audit), 1):
                    rows.append((conv_id, n, *step))
                    if len(rows) == 10_000:
                        yield from _batches(rows, EDITS)
                        rows = []
            if rows:
                yield from _batches(rows, EDITS)

    return facts.select("conv_id", "audit").mapInArrow(spread, EDITS)


def repaired(ordered: DataFrame, changes: DataFrame) -> DataFrame:
    """``(conv_id, place, role, text)``: the rows after the edits; places are gapless from 0."""
    c = changes.select(F.col("conv_id").alias("of"), F.col("n").alias("of_n"), "place", "before", "own", "after")
    rows = ordered.join(c, ordered["conv_id"].eqNullSafe(c["of"]) & (ordered["n"] == c["of_n"]))

    def added(initials: str) -> Column:
        letters = F.when(F.col(initials) == "", F.array().cast("array<string>")).otherwise(F.split(initials, ""))
        return F.transform(F.filter(letters, lambda x: x != ""), lambda x: F.struct(_role(x).alias("role"), F.lit("").alias("text")))

    role = F.when(F.col("own") == "K", F.col("role")).otherwise(_role(F.col("own")))
    own = F.when(F.col("own") == "D", F.array().cast("array<struct<role:string,text:string>>")).otherwise(F.array(F.struct(role.alias("role"), F.col("text").alias("text"))))
    written = rows.select("conv_id", "place", F.posexplode(F.concat(added("before"), own, added("after"))).alias("at", "row"))
    return written.select("conv_id", (F.col("place") + F.col("at")).alias("place"), "row.role", "row.text")


def _role(initial: Column) -> Column:
    return F.when(initial == "u", "user").otherwise("assistant")


class _Hash:
    def __init__(self, conv_id: int | None):
        self.conv_id, self.sha, self.any = conv_id, hashlib.sha256(), False

    def take(self, row: tuple) -> None:
        self.sha.update((("\n" if self.any else "") + f"{row[2]}:{row[3]}").encode())
        self.any = True


def digests(rows: DataFrame) -> DataFrame:
    """``(conv_id, repaired_sha256)`` of ``repaired`` rows written as ``role:text`` lines."""
    return _passing(rows.select("conv_id", "place", "role", "text"), "place", "conv_id long, repaired_sha256 string", _Hash, _Hash.take, lambda state: (state.conv_id, state.sha.hexdigest()))


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts of each conversation, and its repaired rows; both from stored tables."""
    ordered = stage(numbered(rows), "dialogue-rows")
    facts = stage(plans(ordered), "dialogue-plans")
    return facts, repaired(ordered, edits(facts))


def report(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """A row for every id of ``conversations``: the facts about ``rows`` and the hash of what repair makes of them."""
    facts, result = repair(rows)
    hashes = digests(result)
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    f, h = facts.withColumnRenamed("conv_id", "of"), hashes.withColumnRenamed("conv_id", "hash_of")
    joined = ids.join(f, ids["conv_id"].eqNullSafe(f["of"]), "left").join(h, ids["conv_id"].eqNullSafe(h["hash_of"]), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
