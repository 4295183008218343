"""Conversations whose turns follow a grammar again, by the cheapest edits.

A conversation is a row of turns; the wanted form is nothing, or an optional system
turn and then pairs of a user and an assistant turn.  Four edits lead there: keep a
turn, change its role, delete it, insert an empty one.  The edits span a lattice of
(turns consumed, what was written last).  Two Dijkstra searches walk it, one from its
start and one from its end; they go on until no further crossing can be as cheap as
the best one, and the least audit among all cheapest paths is read off.

Turns reach a task in order and one at a time.  It remembers two bytes and a digest
of a turn, not its text, so a conversation of many turns needs little memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lastseen.llm.common import SPACES, shipped, stored

# Costs of the edits, as given by the contract.
RENAMED, DELETED, INSERTED, CUT_OFF = 1, 2, 5, 5
# Faults of a turn; the first that holds counts.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
ROLES = {"u": "user", "a": "assistant"}

# What was written last: nothing, a system, a user or an assistant turn.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NOTHING, ASSISTANT)
FOLLOWS = {
    NOTHING: {"s": SYSTEM, "u": USER},
    SYSTEM: {"u": USER},
    USER: {"a": ASSISTANT},
    ASSISTANT: {"u": USER},
}
COMES_FROM = {
    state: [(before, initial) for before, to in FOLLOWS.items() for initial, t in to.items() if t == state]
    for state in FOLLOWS
}



def _edges(initials: str, faults: bytes, i: int, state: int) -> list[tuple[str, int, int, int]]:
    """Edits possible at a place: (initial of the edit, cost, next place, next state)."""
    steps = []
    for initial, to in FOLLOWS[state].items():
        if initial in ROLES:
            steps.append(("I", INSERTED, i, to))
    if i < len(initials):
        steps.append(("D", DELETED, i + 1, state))
        if faults[i] not in (BLANK, DUPLICATE):
            extra = CUT_OFF if faults[i] == TRUNCATED else 0
            for initial, to in FOLLOWS[state].items():
                if initials[i] == initial:
                    steps.append(("K", extra, i + 1, to))
                if initial in ROLES:
                    steps.append(("R", RENAMED + extra, i + 1, to))
    return steps


def _edges_into(initials: str, faults: bytes, i: int, state: int) -> list[tuple[int, int, int]]:
    """Places an edit leads from: (cost, place, state)."""
    steps = [(INSERTED, i, before) for before, initial in COMES_FROM[state] if initial in ROLES]
    if i > 0:
        steps.append((DELETED, i - 1, state))
        if faults[i - 1] not in (BLANK, DUPLICATE):
            extra = CUT_OFF if faults[i - 1] == TRUNCATED else 0
            for before, initial in COMES_FROM[state]:
                if initials[i - 1] == initial:
                    steps.append((extra, i - 1, before))
                if initial in ROLES:
                    steps.append((RENAMED + extra, i - 1, before))
    return steps


def cheapest_audit(initials: str, faults: bytes) -> tuple[int, str]:
    """Least cost and, among its audits, the one least in ASCII order.

    ``initials`` has one character per turn, ``faults`` one of the codes above.  Edits
    that cost nothing only move forward, so the heaps order equal costs by place.
    """
    length = len(initials)
    ahead, behind = {}, {}  # settled distances from the start, to the end
    forward = [(0, 0, NOTHING)]
    reverse = [(0, -length, state) for state in ENDS]
    best = None

    def crossing(total: int) -> None:
        nonlocal best
        best = total if best is None else min(best, total)

    # Stop only beyond the best crossing: all that cost as little are then known.
    while forward and reverse and (best is None or forward[0][0] + reverse[0][0] <= best):
        if len(ahead) <= len(behind):
            cost, i, state = heappop(forward)
            if (i, state) in ahead:
                continue
            ahead[i, state] = cost
            if (i, state) in behind:
                crossing(cost + behind[i, state])
            for _, more, j, to in _edges(initials, faults, i, state):
                if (j, to) in behind:
                    crossing(cost + more + behind[j, to])
                if (j, to) not in ahead:
                    heappush(forward, (cost + more, j, to))
        else:
            cost, minus, state = heappop(reverse)
            i = -minus
            if (i, state) in behind:
                continue
            behind[i, state] = cost
            if (i, state) in ahead:
                crossing(cost + ahead[i, state])
            for more, j, before in _edges_into(initials, faults, i, state):
                if (j, before) in ahead:
                    crossing(cost + more + ahead[j, before])
                if (j, before) not in behind:
                    heappush(reverse, (cost + more, -j, before))

    return best, _least_audit(initials, faults, ahead, behind, best)


def _least_audit(initials: str, faults: bytes, ahead: dict, behind: dict, best: int) -> str:
    """Least concatenation of a forward and a reverse part over all cheapest crossings.

    What is left to pay is known behind the crossings; in front of them it is found by
    walking back from every crossing over edits that keep to the cheapest cost.
    """
    left = {place: cost for place, cost in behind.items()}
    # Back from the crossings, through what the forward search settled.
    todo = []
    for (i, state), cost in ahead.items():
        for _, more, j, to in _edges(initials, faults, i, state):
            if (j, to) in behind and cost + more + behind[j, to] == best:
                left[i, state] = best - cost
        if left.get((i, state)) == best - cost:
            todo.append((i, state))
    while todo:
        i, state = todo.pop()
        for more, j, before in _edges_into(initials, faults, i, state):
            place = (j, before)
            if place in left or place not in ahead:
                continue
            if ahead[place] + more == ahead[i, state]:
                left[place] = best - ahead[place]
                todo.append(place)
    # Places one audit leads to agree in the turns consumed, so they are few.
    audit, places, length = [], {(0, NOTHING)}, len(initials)
    while not any(i == length and state in ENDS and left[i, state] == 0 for i, state in places):
        reached: dict[str, set] = {}
        for i, state in places:
            for name, more, j, to in _edges(initials, faults, i, state):
                if (j, to) in left and left[j, to] + more == left[i, state]:
                    reached.setdefault(name, set()).add((j, to))
        name = min(reached)
        audit.append(name)
        places = reached[name]
    return "".join(audit)


AUDITS = T.StructType(
    [
        T.StructField("gaps", T.LongType()),
        T.StructField("blank", T.LongType()),
        T.StructField("duplicate", T.LongType()),
        T.StructField("truncated", T.LongType()),
        T.StructField("illegal", T.LongType()),
        T.StructField("cost", T.LongType()),
        T.StructField("audit", T.StringType()),
    ]
)
LEGAL = {"su", "ua", "au"}


def _in_order(turns: DataFrame) -> DataFrame:
    """Conversations dealt to tasks; of each its audit, if there, then its turns."""
    by = [F.col(c).asc_nulls_first() for c in ("conv_id", "is_turn", "turn", "role", "text")]
    return turns.repartition("conv_id").sortWithinPartitions(*by)


def _plain(turns: DataFrame) -> DataFrame:
    """The columns used, with one space for a role or text that is null."""
    return turns.select(
        "conv_id",
        F.lit(True).alias("is_turn"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        F.lit(None).cast("string").alias("audit"),
    )


class _Conversation:
    """What is remembered of a conversation while its turns go by."""

    def __init__(self) -> None:
        self.initials: list[str] = []
        self.faults = bytearray()
        self.seen: set[bytes] = set()
        self.first = self.last = None
        self.distinct = self.illegal = 0

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None:
            if self.last is None:
                self.first = turn
            if turn != self.last:
                self.distinct += 1
            self.last = turn
        initial = role[:1] or " "
        if self.initials and self.initials[-1] + initial not in LEGAL:
            self.illegal += 1
        self.initials.append(initial)
        said = text.rstrip(SPACES)
        mark = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        if not said:
            fault = BLANK
        elif mark in self.seen:
            fault = DUPLICATE
        else:
            fault = SOUND if said[-1] in ".!?" else TRUNCATED
        self.seen.add(mark)
        self.faults.append(fault)

    def row(self) -> tuple:
        faults = bytes(self.faults)
        gaps = 0 if self.last is None else self.last - self.first + 1 - self.distinct
        cost, audit = cheapest_audit("".join(self.initials), faults)
        counts = (faults.count(kind) for kind in (BLANK, DUPLICATE, TRUNCATED))
        return gaps, *counts, self.illegal, cost, audit


def _streamed(
    ordered: DataFrame, schema: T.StructType, start: Callable, step: Callable, end: Callable
) -> DataFrame:
    """Fold rows that arrive conversation by conversation.

    ``start`` makes the memory of a conversation, ``step`` takes its next row and ``end``
    closes it; the last two return rows without ``conv_id``.  One batch is held at a time.
    """
    names = ordered.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, current = None, None

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * len(wanted)
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), f.type) for c, f in zip(columns, wanted)], schema=wanted
            )

        for batch in batches:
            id_type = batch.schema.field(names[0]).type
            wanted = pa.schema(
                [(names[0], id_type), *((f.name, _ARROW[f.dataType]) for f in schema.fields[1:])]
            )
            rows = []
            for conv_id, *row in zip(*(batch.column(n).to_pylist() for n in names)):
                if memory is None or conv_id != current:
                    if memory is not None:
                        rows += [(current, *r) for r in end(memory)]
                    current, memory = conv_id, start()
                rows += [(current, *r) for r in step(memory, *row)]
            yield packed(rows)
        if memory is not None:
            yield packed([(current, *r) for r in end(memory)])

    return ordered.mapInArrow(run, schema)


_ARROW = {T.LongType(): pa.int64(), T.StringType(): pa.string()}


def audits(turns: DataFrame) -> DataFrame:
    """Faults, cost and audit of each conversation: one row per ``conv_id``.

    Takes ``conv_id, turn, role, text``; other columns are ignored.  A null role or text
    counts as one space; rows without a ``conv_id`` are one conversation of their own.
    Turns are taken by number, nulls first, then by role and text, so equal rows and equal
    numbers give the same result in every run.  Texts may be empty or very long.  An empty
    table gives no rows.  Only an audit grows with its conversation, two bytes a turn.
    """
    schema = T.StructType([turns.schema["conv_id"], *AUDITS])

    def step(state: _Conversation, _, turn, role, text, audit) -> tuple:
        state.add(turn, role, text)
        return ()

    def end(state: _Conversation) -> list[tuple]:
        return [state.row()]

    return _streamed(_in_order(_plain(turns)), schema, _Conversation, step, end)


REPAIRED = T.StructType(
    [
        T.StructField("position", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("edit", T.StringType()),
    ]
)


class _Repair:
    """Where the audit of a conversation stands."""

    def __init__(self) -> None:
        self.audit, self.at = "", 0
        self.last, self.position = NOTHING, 0

    def written(self, role: str, text: str, edit: str) -> tuple:
        self.last = FOLLOWS[self.last][role[:1]]
        self.position += 1
        return self.position - 1, role, text, edit

    def due(self) -> str:
        """Role the grammar asks for next, apart from a system turn."""
        return ROLES[next(initial for initial in FOLLOWS[self.last] if initial in ROLES)]

    def inserted(self) -> list[tuple]:
        rows = []
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            rows.append(self.written(self.due(), "", "I"))
        return rows


def repaired(turns: DataFrame, judged: DataFrame) -> DataFrame:
    """The repaired turns: ``conv_id, position, role, text, edit``.

    ``judged`` is :func:`audits` of the same turns.  A conversation's rows are in order in
    one partition.  The audit goes ahead of its turns in the same stream, so that no row
    carries a copy of it.  Nulls, ties and empty tables are as in :func:`audits`; of a
    conversation whose turns are all deleted there is no row.
    """
    schema = T.StructType([turns.schema["conv_id"], *REPAIRED])
    plain = _plain(turns)
    nothing = F.lit(None)
    heads = judged.select(
        "conv_id",
        F.lit(False).alias("is_turn"),
        *(nothing.cast(plain.schema[c].dataType).alias(c) for c in ("turn", "role", "text")),
        "audit",
    )

    def step(state: _Repair, is_turn, _, role, text, audit) -> list[tuple]:
        if not is_turn:
            state.audit = audit
            return []
        rows = state.inserted()
        edit = state.audit[state.at]
        state.at += 1
        if edit == "K":
            rows.append(state.written(role, text, edit))
        elif edit == "R":
            rows.append(state.written(state.due(), text, edit))
        return rows

    return _streamed(
        _in_order(plain.unionByName(heads)), schema, _Repair, step, _Repair.inserted
    )


DIGEST = T.StructType([T.StructField("repaired_sha256", T.StringType())])


def digests(rows: DataFrame) -> DataFrame:
    """SHA-256 of each repaired conversation, its ``role:text`` lines joined by newlines.

    ``rows`` must be as :func:`repaired` returns them: in order, a conversation in one
    partition.  The texts run through the hash one by one.
    """
    schema = T.StructType([rows.schema["conv_id"], *DIGEST])

    def step(state: list, position, role, text, edit) -> tuple:
        state[0].update(f"{chr(10) if position else ''}{role}:{text}".encode())
        return ()

    def end(state: list) -> list[tuple]:
        return [(state[0].hexdigest(),)]

    return _streamed(rows, schema, lambda: [hashlib.sha256()], step, end)


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns with the damage the contract deals out by a checksum of their place.

    Takes ``conv_id, turn, role, text`` and returns the same; nulls are read as one space,
    except that ``conv_id`` and ``turn`` keep theirs.  Equal rows suffer equal damage.
    """
    place = F.concat_ws(
        ":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    )
    dealt = F.crc32(place) % 20
    text = F.coalesce("text", F.lit(" "))
    rows = conversations.select(
        "conv_id",
        "turn",
        F.when(dealt == 4, F.lit("user")).otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(dealt == 1, F.lit(""))
        .when(dealt == 2, F.translate(text, ".!?", ""))
        .otherwise(text)
        .alias("text"),
        # None, one or two of the row.
        F.when(dealt == 0, 0).when(dealt == 3, 2).otherwise(1).alias("_times"),
    )
    times = F.explode(F.sequence(F.lit(1), F.col("_times")))
    return rows.filter("_times > 0").select("*", times.alias("_time")).drop("_times", "_time")


@shipped
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation after damage: its faults, cheapest audit and repaired digest.

    Null, tied, repeated and empty values are as in :func:`damaged` and :func:`audits`; a
    null ``conv_id`` names one conversation.  Conversations that lost every row get zeros,
    an empty audit and the digest of the empty string.  An empty table gives no rows.
    """
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turns = damaged(conversations)
    judged = stored(audits(turns), "conversation-audits")
    sums = digests(repaired(turns, judged))
    result = conversations.select("conv_id").distinct()
    for part in (judged, sums):
        part = part.withColumnRenamed("conv_id", "_id")
        same = F.col("conv_id").eqNullSafe(F.col("_id"))
        result = result.join(part, same, "left").drop("_id")
    nothing = {f.name: F.lit("") if f.name == "audit" else F.lit(0).cast("long") for f in AUDITS}
    nothing["repaired_sha256"] = F.lit(hashlib.sha256().hexdigest())
    return result.select(
        "conv_id", *(F.coalesce(F.col(name), empty).alias(name) for name, empty in nothing.items())
    )
