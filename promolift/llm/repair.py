"""Cheapest edits that give every conversation the roles ``(s?(ua)+)?``, without blank or repeated rows.

Rows are kept (K, free), given the role user or assistant (R, 2), deleted (D, 3; blank and repeated rows always are) and
rows with an empty text inserted (I, 2); a row whose text breaks off costs 1 more while it stays. Of the cheapest edits
those with the least letters in ASCII order are taken. The costs of what remains, by the state of the roles before it,
are a vector computed backwards. Vectors are stored at checkpoints only, at every square root of the number of rows, and
a block's vectors are computed again while the walk forward emits its edits.

A conversation may hold any share of all rows. Rows are sorted by range partitions; the rows of a conversation in one of
them are a run, which is a string with a letter per row. Vectors at the end of a run follow from the runs after it, each
as one matrix of costs between states; at most one conversation crosses each boundary between partitions, so there are
no more matrices than partitions and the driver joins them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promolift.llm.common import drop_paths, map_batches, written

KEEP, REROLE, DELETE, INSERT, BROKEN = 0, 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)  # what the role before was
NEXT = (USER, USER, ASSISTANT, USER)  # the state after an inserted or changed row
ROLES = {USER: "user", ASSISTANT: "assistant"}
FINAL = (0, 2 * INSERT, INSERT, 0)
NEVER = 1 << 60
LEGAL = {"su", "ua", "au"}
INITIALS, FAULTS = "sua?", ("", "blank", "duplicate", "truncated")
LETTER = 65  # a row's letter: 4 * place in INITIALS + place in FAULTS, from A on
IN_PARTITION = 33  # bits of a row's number inside its partition

Vector = tuple[int, ...]


def _kept_state(state: int, initial: str) -> int | None:
    if initial == "u" and state != USER:
        return USER
    if initial == "a" and state == USER:
        return ASSISTANT
    return SYSTEM if initial == "s" and state == START else None


def _meaning(letter: str) -> tuple[str, bool, int]:
    """Initial, whether the row must go, and what it costs while it stays."""
    initial, fault = divmod(ord(letter) - LETTER, 4)
    return INITIALS[initial], FAULTS[fault] in ("blank", "duplicate"), BROKEN * (FAULTS[fault] == "truncated")


def _row_choices(letter: str, state: int, after: Vector) -> Iterator[tuple[str, int, int]]:
    """(edit, state after, cost with all that remains) of the edits that take the row."""
    initial, must_go, stays = _meaning(letter)
    yield "D", state, DELETE + after[state]
    if not must_go:
        kept = _kept_state(state, initial)
        if kept is not None:
            yield "K", kept, KEEP + stays + after[kept]
        yield "R", NEXT[state], REROLE + stays + after[NEXT[state]]


_steps: dict[tuple[str, Vector], tuple[Vector, int]] = {}


def _back(letter: str, after: Vector) -> tuple[Vector, int]:
    """The vector before a row, less its least cost, and that cost. The vectors that occur are few, so they are kept."""
    found = _steps.get((letter, after))
    if found is None:
        costs = [min(cost for _, _, cost in _row_choices(letter, state, after)) for state in range(4)]
        for _ in range(3):  # from the start an inserted user, then assistant, then user again
            costs = [min(cost, INSERT + costs[NEXT[state]]) for state, cost in enumerate(costs)]
        least = min(costs)
        found = _steps[letter, after] = tuple(cost - least if cost < NEVER else NEVER for cost in costs), least
    return found


def before_run(letters: str, after: Vector) -> Vector:
    """The vector before all rows of a run."""
    base = 0
    for letter in reversed(letters):
        after, least = _back(letter, after)
        base += least
    return tuple(min(cost + base, NEVER) for cost in after)


def run_matrix(letters: str) -> list[Vector]:
    """For each state after the run, the costs by the state before it."""
    return [before_run(letters, tuple(0 if state == end else NEVER for state in range(4))) for end in range(4)]


def joined_with(matrix: list[Vector], after: Vector) -> Vector:
    return tuple(min(matrix[end][state] + after[end] for end in range(4)) for state in range(4))


class Edit(NamedTuple):
    row: int
    letters: str  # of the inserted rows before it, of its own edit and, for the last row, of those inserted after it
    roles: list[str]  # of the inserted rows and of a changed row; null for the others


def walk(letters: str, state: int, after: Vector, last: bool) -> tuple[list[Edit], int]:
    """The edits of a run from the state before it, and the state after it."""
    count = len(letters)
    size = max(1, isqrt(count))
    checkpoints: list[tuple[Vector, int]] = []  # behind each block, the last block first
    vector, base = after, 0
    for stop in range(count, 0, -1):
        if stop == count or stop % size == 0:
            checkpoints.append((vector, base))
        vector, least = _back(letters[stop - 1], vector)
        base += least
    edits: list[Edit] = []
    for start in range(0, count, size):
        stop = min(start + size, count)
        vectors = [checkpoints.pop()]
        for at in range(stop - 1, start - 1, -1):
            vector, least = _back(letters[at], vectors[-1][0])
            vectors.append((vector, vectors[-1][1] + least))
        for at in range(start, stop):
            (now, now_base), (then, then_base) = vectors[stop - at], vectors[stop - at - 1]
            done, roles = "", []
            while True:
                remains = now[state] + now_base - then_base
                choices = {edit: to for edit, to, cost in _row_choices(letters[at], state, then) if cost == remains}
                if INSERT + now[NEXT[state]] == now[state]:
                    choices["I"] = NEXT[state]
                edit = min(choices)
                state = choices[edit]
                done += edit
                roles.append(ROLES[state] if edit in "IR" else None)
                if edit != "I":
                    break
            edits.append(Edit(at, done, roles))
    if last:
        row, done, roles = edits.pop()
        while state in (SYSTEM, USER):
            state = NEXT[state]
            done += "I"
            roles.append(ROLES[state])
        edits.append(Edit(row, done, roles))
    return edits, state


def illegal_pairs(letters: str) -> int:
    initials = [_meaning(letter)[0] for letter in letters]
    return sum(left + right not in LEGAL for left, right in zip(initials, initials[1:]))


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs that cross a boundary: their outer letters and their matrix."""
    for batch in batches:
        rows = batch.to_pylist()
        for row in rows:
            letters = row.pop("letters")
            row |= {"opens": letters[0], "closes": letters[-1], "matrix": sum(run_matrix(letters), ())}
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
            ("partition", pa.int64()), ("later", pa.bool_()), ("more", pa.bool_()), ("opens", pa.string()),
            ("closes", pa.string()), ("matrix", pa.list_(pa.int64())),
        ]))


class _Exits:
    """The state after a crossing run, for each state before it."""

    def __init__(self, after: dict[tuple[int, bool], Vector]):
        self.after = after

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                {"partition": row["partition"], "later": row["later"], "exits": [
                    walk(row["letters"], state, self.after[row["partition"], row["later"]], not row["more"])[1]
                    for state in range(4)
                ]}
                for row in batch.to_pylist()
            ]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
                ("partition", pa.int64()), ("later", pa.bool_()), ("exits", pa.list_(pa.int64())),
            ]))


class _Walks:
    """Edits and counts of every run."""

    def __init__(self, after: dict, entry: dict[int, int], before: dict[int, str]):
        self.after, self.entry, self.before = after, entry, before

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list] = {name: [] for name in ("cost", "blank", "duplicate", "truncated", "illegal", "edits")}
            for row in batch.drop_columns(["conv_id"]).to_pylist():
                letters, later = row["letters"], row["later"]
                key = row["partition"], later
                after = self.after[key] if row["more"] else FINAL
                edits, _ = walk(letters, self.entry[row["partition"]] if later else START, after, not row["more"])
                found["cost"].append(0 if later else before_run(letters, after)[START])
                faults = [FAULTS[(ord(letter) - LETTER) % 4] for letter in letters]
                for name in ("blank", "duplicate", "truncated"):
                    found[name].append(faults.count(name))
                found["illegal"].append(illegal_pairs(self.before[row["partition"]] + letters if later else letters))
                found["edits"].append([
                    {"row": row["first"] + at, "letters": done, "roles": roles} for at, done, roles in edits
                ])
            edit = pa.struct([("row", pa.int64()), ("letters", pa.string()), ("roles", pa.list_(pa.string()))])
            kinds = {"edits": pa.list_(edit)}
            arrays = [pa.array(values, kinds.get(name, pa.int64())) for name, values in found.items()]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *arrays], ["conv_id", *found])


_BLANKS = " \t\n\x0b\f\r"


def _fault() -> Column:
    """Place in FAULTS of a row that is no duplicate: its last character that is not blank decides."""
    last = F.right(F.rtrim("text", F.lit(_BLANKS)), F.lit(1))
    return F.when(last == "", 1).when(last.isin(".", "!", "?"), 0).otherwise(3).alias("fault")


def _initial() -> Column:
    """Place in INITIALS."""
    first = F.substring("role", 1, 1)
    places = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2)
    return places.otherwise(3).alias("initial")


class Repair(NamedTuple):
    #: conv_id, gaps, blank, duplicate, truncated, illegal, cost
    summary: DataFrame
    #: conv_id, row, step, edit, role, text: every edit in order of row and step; role and text of deleted rows as well
    steps: DataFrame


def repair(frame: DataFrame) -> Repair:
    """Faults, costs and edits of conversations: rows of conv_id, turn, role, text, taken by turn, nulls first, and by
    role and text where turns are equal.

    A null role or text counts as one blank; null ids are one conversation; repeated rows are duplicates; other columns
    are not read; an empty table gives two empty ones. ``gaps`` counts turns missing between the least and the largest.
    Rows that agree in id, turn and the first 96 characters of role and text share a range partition.
    """
    spark = frame.sparkSession
    said = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" ")).alias(name)
    base = frame.select("conv_id", F.col("turn").cast("long").alias("turn"), said("role"), said("text"))
    whole = F.concat("role", F.lit("\0"), "text")
    ranged = base.repartitionByRange("conv_id", "turn", F.substring(whole, 1, 96))
    numbered = ranged.sortWithinPartitions("conv_id", "turn", whole).select(
        "*", F.monotonically_increasing_id().alias("row")
    )
    rows = written(numbered, "repair-rows")[0]

    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    firsts = rows.groupBy("conv_id", digest.alias("digest")).agg(F.min("row").alias("row"))
    repeated = F.col("is_first").isNull() & (F.col("fault") != 1)
    place = 4 * F.col("initial") + F.when(repeated, 2).otherwise(F.col("fault"))
    lettered = (
        rows.select("conv_id", "row", _initial(), _fault())
        .join(firsts.select("row", F.lit(True).alias("is_first")), "row", "left")
        .select(
            "conv_id", "row", F.shiftright("row", IN_PARTITION).alias("partition"), F.char(LETTER + place).alias("letter")
        )
    )
    of_conversation = Window.partitionBy("conv_id")
    runs = (
        lettered.groupBy("conv_id", "partition")
        .agg(F.min("row").alias("first"), F.array_sort(F.collect_list(F.struct("row", "letter"))).alias("all"))
        .select(
            "conv_id", "partition", "first", F.array_join(F.col("all.letter"), "").alias("letters"),
            (F.col("partition") > F.min("partition").over(of_conversation)).alias("later"),
            (F.col("partition") < F.max("partition").over(of_conversation)).alias("more"),
        )
    )
    runs, runs_path = written(runs, "repair-runs")

    walks = _Walks(*_boundaries(runs))
    conv_type = runs.schema["conv_id"].dataType.simpleString()
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    schema = f"conv_id {conv_type}, cost long, blank long, duplicate long, truncated long, illegal long, " \
             "edits array<struct<row: long, letters: string, roles: array<string>>>"  # fmt: skip
    done = written(map_batches(runs, walks, schema), "repair-edits")[0]
    drop_paths(spark, [runs_path])

    turns = rows.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps")
    )
    sums = done.groupBy("conv_id").agg(*[F.sum(name).alias(name) for name in counts])
    sums = sums.withColumnRenamed("conv_id", "of")
    summary = turns.join(sums, F.col("conv_id").eqNullSafe(F.col("of"))).select("conv_id", "gaps", *counts)

    edits = done.select(F.inline("edits"))
    steps = rows.join(edits, "row").select(
        "conv_id", "row", F.posexplode(F.split("letters", "")).alias("step", "edit"), "roles", "role", "text"
    )
    changed = F.get("roles", F.col("step"))
    steps = steps.select(
        "conv_id", "row", "step", "edit", F.coalesce(changed, "role").alias("role"),
        F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"),
    )
    return Repair(summary, steps)


def _boundaries(runs: DataFrame) -> tuple[dict, dict[int, int], dict[int, str]]:
    """What crosses the boundaries between range partitions, at most one conversation each: the vector after each run
    with a later one, by partition and whether the run is a later one itself; the state before each later run; and the
    letter before it."""
    crossing = runs.where("later OR more").select("partition", "later", "more", "letters")
    schema = "partition long, later boolean, more boolean, opens string, closes string, matrix array<long>"
    edges = sorted(map_batches(crossing, _edges, schema).collect(), key=lambda row: (row.partition, not row.later))
    # Sorted like this, a conversation's runs are neighbours: a later one comes first in its partition, an opening one last.
    after: dict[tuple[int, bool], Vector] = {}
    for place in reversed(range(len(edges))):
        row = edges[place]
        vector = FINAL
        if row.more:
            following = edges[place + 1]
            matrix = [tuple(following.matrix[4 * end : 4 * end + 4]) for end in range(4)]
            vector = joined_with(matrix, after[following.partition, True])
        after[row.partition, row.later] = vector
    if not edges:
        return after, {}, {}
    found = map_batches(crossing, _Exits(after), "partition long, later boolean, exits array<long>").collect()
    exits = {(row.partition, row.later): row.exits for row in found}
    entry, before, state = {}, {}, START
    for place, row in enumerate(edges):
        if row.later:
            entry[row.partition], before[row.partition] = state, edges[place - 1].closes
        state = exits[row.partition, row.later][state if row.later else START]
    return after, entry, before


class _Transcripts:
    """Steps in order to one row per conversation: the edits' letters, and the digest of the rows that are left."""

    def __init__(self, conv_type: pa.DataType):
        self.conv_type = conv_type

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "audit", "repaired_sha256"]
        kinds = [self.conv_type, pa.string(), pa.string()]
        out: list[tuple] = []
        current, edits, digest, any_row, open_ = None, [], hashlib.sha256(), False, False
        for batch in batches:
            for conv, edit, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "edit", "role", "text"))):
                if not open_ or conv != current:
                    if open_:
                        out.append((current, "".join(edits), digest.hexdigest()))
                    current, edits, digest, any_row, open_ = conv, [], hashlib.sha256(), False, True
                edits.append(edit)
                if edit != "D":
                    digest.update(("\n" * any_row + f"{role}:{text}").encode())
                    any_row = True
            if len(out) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], names)
                out = []
        if open_:
            out.append((current, "".join(edits), digest.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], names)


def transcripts(steps: DataFrame) -> DataFrame:
    """conv_id, audit (the edits' letters) and repaired_sha256 (of ``role:text`` lines) of each conversation.

    The digest reads a conversation in order, so its rows go through one task, one at a time.
    """
    kind = steps.schema["conv_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    ordered = steps.repartition("conv_id").sortWithinPartitions("conv_id", "row", "step")
    schema = f"conv_id {kind.simpleString()}, audit string, repaired_sha256 string"
    return map_batches(ordered.select("conv_id", "edit", "role", "text"), _Transcripts(to_arrow_type(kind)), schema)
