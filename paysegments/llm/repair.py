"""Repair of conversations by the cheapest edits, with a checkpointed dynamic programme.

A conversation should read: perhaps a system turn, then user and assistant in turns, each
at least once; or nothing at all. Turns can be kept, deleted, given another role or be
preceded by an inserted empty turn, at a cost each (``Costs``). Blank turns and copies of
an earlier turn have to go, and keeping a truncated turn costs extra. Four states say
what may follow: the start, after system, after user, after assistant.

The programme runs over the codes of turns (initial of the role and faults, a byte each)
and never sees texts. A conversation of n turns is cut into blocks of about the square
root of n. Per block the least cost from every state to every state is worked out; over
the blocks, last to first, these give the backward vector of costs to the end at every
block border, the checkpoints, and nothing between them is stored. Then each block works
out its inner vectors again from the checkpoint at its end, walks forward over tight
edits only, the ASCII-least of them first, from each state that it could be entered in;
and the states in which blocks are entered are chained over the blocks, first to last. A
task holds a block's codes or one row per block of a conversation, so a conversation of a
billion turns is 32 thousand rows of 32 thousand codes, spread over tasks.

Turns are ranked by ranges (``ranking``), and the first of equal turns is found with
partial minima, so neither hot conversations nor copies gather in a task. Only the digest
of a whole repaired conversation is worked out in its order in one task, which holds a
batch of turns at a time.

Defined results: turns are ordered by turn (null first), then role, then the first HEAD
characters of the text, then its digest; a null
role or text is one space; repeated rows are copies of the earlier one; a null
conversation id is a conversation of its own; a role without characters has no initial
and cannot be kept; texts of any length are taken whole, and of their words only the last
character counts; an empty table gives no conversations; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paysegments.functions.lineage import Scratch, materialise
from paysegments.functions.shipping import ship_by_value
from paysegments.llm.ranking import group_key, ranked

ship_by_value(__name__)

START, SYSTEM, USER, ASSISTANT = STATES = range(4)
INITIALS = "sua"
# The state after an initial (by its place in INITIALS) in each state; None: not allowed.
AFTER = [[SYSTEM, USER, None], [None, USER, None], [None, None, ASSISTANT], [None, USER, None]]
# The state after an insertion or a change of role, which are to what may follow.
FORCED = [USER, USER, ASSISTANT, USER]
# Edits: K and D, and with the role that they give, in small letters inserted turns and in
# capitals turns with another role.
ROLES = {"u": "user", "a": "assistant", "U": "user", "A": "assistant"}
INSERTED = {USER: "u", ASSISTANT: "a"}
REROLED = {USER: "U", ASSISTANT: "A"}
EDITS = "DK" + "".join(ROLES)
OTHER = len(INITIALS)  # the code of any other initial
MUST_GO, TRUNCATED = 4, 8  # flags of a code, above the initial
NEVER = 1 << 60


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


def _inserting(ahead: list[int], insert: int) -> list[int]:
    """Costs to the end where turns may be inserted first, from those where none is."""
    best = list(ahead)
    for _ in STATES:  # no more insertions than states are of use
        best = [min(b, insert + best[FORCED[q]]) for q, b in enumerate(best)]
    return best


def before_row(code: int, ahead: list[int], costs: Costs) -> list[int]:
    """The vector of costs before a turn, insertions included, from the vector after it."""
    kept = costs.truncated if code & TRUNCATED else 0
    best = []
    for q in STATES:
        cost = costs.delete + ahead[q]
        if not code & MUST_GO:
            cost = min(cost, costs.rerole + kept + ahead[FORCED[q]])
            initial = code & 3
            after = AFTER[q][initial] if initial < OTHER else None
            if after is not None:
                cost = min(cost, kept + ahead[after])
        best.append(cost)
    return _inserting(best, costs.insert)


def at_end(costs: Costs) -> list[int]:
    """Costs after the last turn: a conversation ends empty or after an assistant."""
    return _inserting([0, NEVER, NEVER, 0], costs.insert)


def block_costs(codes: bytes, costs: Costs) -> list[list[int]]:
    """Least cost of a block by state at its start and at its end, [start][end]."""
    columns = []
    for end in STATES:
        ahead = [0 if q == end else NEVER for q in STATES]
        for code in reversed(codes):
            ahead = before_row(code, ahead, costs)
        columns.append([min(c, NEVER) for c in ahead])
    return [[columns[end][q] for end in STATES] for q in STATES]


def walk(codes: bytes, ahead: list[int], costs: Costs) -> list[tuple[int, str]]:
    """For every state at a block's start the state at its end and the ASCII-least tight edits.

    ``ahead`` is the checkpoint at the block's end. Edits are letters of EDITS.
    """
    vectors = [ahead]
    for code in reversed(codes):
        vectors.append(before_row(code, vectors[-1], costs))
    vectors.reverse()
    found = []
    for q in STATES:
        edits = []
        for code, here, after in zip(codes, vectors, vectors[1:]):
            # D before I before K before R; every letter leads to one state only
            while here[q] != costs.delete + after[q] and here[q] == costs.insert + here[FORCED[q]]:
                q = FORCED[q]
                edits.append(INSERTED[q])
            kept = costs.truncated if code & TRUNCATED else 0
            to = AFTER[q][code & 3] if code & 3 < OTHER and not code & MUST_GO else None
            if here[q] == costs.delete + after[q]:
                edits.append("D")
            elif to is not None and here[q] == kept + after[to]:
                q = to
                edits.append("K")
            else:
                q = FORCED[q]
                edits.append(REROLED[q])
        found.append((q, "".join(edits)))
    return found


def closing(state: int) -> str:
    """The insertions after the last turn, from the state after it."""
    edits = ""
    while state not in (START, ASSISTANT):
        state = FORCED[state]
        edits += INSERTED[state]
    return edits


def audit(edits: Column) -> Column:
    """Edits by their initials: Delete, Insert, Keep, Rerole."""
    return F.translate(edits, "uaUA", "IIRR")


# --- turns ---------------------------------------------------------------------------

# Turns of one conversation, turn and role are ordered by so many characters of the text
# and by its digest after that, so that texts need not travel to be ranked.
HEAD = 32
KEY = ["group", "turn", "role", "head", "said"]
SPACES = " \t\n\x0b\x0c\r"


def keyed(turns: DataFrame) -> DataFrame:
    """The columns KEY, by which turns are ordered, and text."""
    space = F.lit(" ")
    text = F.coalesce("text", space)
    return turns.select(
        group_key(F.col("conv_id")).alias("group"),
        F.col("turn"),
        F.coalesce("role", space).alias("role"),
        F.left(text, F.lit(HEAD)).alias("head"),
        F.unhex(F.sha2(text, 256)).alias("said"),
        text.alias("text"),
    )


def faults(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """Every turn without its text: KEY, rank, n, fault (the first that it has) and code."""
    trimmed = F.rtrim("text", F.lit(SPACES))
    read = keyed(turns).select(
        *KEY, (trimmed == "").alias("blank"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("cut")
    )
    placed = ranked(read, "group", [F.col(c) for c in KEY[1:]], scratch)
    first = placed.groupBy("group", "role", "said").agg(F.min("rank").alias("rank"))
    first = first.select("group", "rank", F.lit(True).alias("new"))
    fault = F.when(F.col("blank"), "blank").when(F.col("new").isNull(), "duplicate").when(F.col("cut"), "truncated")
    initial = F.left("role", F.lit(1))
    known = F.lit(OTHER)
    for i, letter in enumerate(INITIALS):
        known = F.when(initial == letter, F.lit(i)).otherwise(known)
    flag = F.when(fault == "truncated", F.lit(TRUNCATED)).when(fault.isNotNull(), F.lit(MUST_GO)).otherwise(F.lit(0))
    return placed.join(first, ["group", "rank"], "left").select(
        *KEY, "rank", "n", fault.alias("fault"), (known + flag).cast("byte").alias("code")
    )


# --- blocks --------------------------------------------------------------------------

# Blocks that a task remembers; their codes repeat a lot in short conversations.
REMEMBERED = 50_000


def _blocks(turns: DataFrame) -> DataFrame:
    """group, block and the codes of its turns in order."""
    length = F.ceil(F.sqrt(F.col("n").cast("double"))).cast("long")
    block = F.floor(F.col("rank") / length).cast("long")
    return turns.groupBy("group", block.alias("block")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "code"))), lambda x: x["code"]).alias("codes")
    )


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def _codes(batch: pa.RecordBatch) -> Iterator[bytes]:
    column = batch.column("codes")
    values = column.values.to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()
    ends = column.offsets.to_pylist()
    return (values[s:e] for s, e in zip(ends, ends[1:]))


def _with_costs(blocks: DataFrame, costs: Costs) -> DataFrame:
    """The least costs through each block, [start][end] in one list."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(REMEMBERED)(lambda codes: sum(block_costs(codes, costs), []))
        for batch in batches:
            found = pa.array([known(codes) for codes in _codes(batch)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, "costs"])

    return blocks.mapInArrow(task, "group string, block long, codes array<byte>, costs array<long>")


def _checkpoints(blocks: DataFrame, costs: Costs) -> DataFrame:
    """The backward vector at the end of each block: group, block, ahead; and the cost in all."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                ahead, found = at_end(costs), []
                for block in reversed(row["blocks"]):
                    found.append((row["group"], block["block"], ahead))
                    through = block["costs"]
                    ahead = [min(through[4 * q + e] + ahead[e] for e in STATES) for q in STATES]
                out += [(*f, ahead[START]) for f in found]
            yield _batch(out, ["group", "block", "ahead", "cost"], [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.int64()])

    listed = blocks.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("block", "costs"))).alias("blocks"))
    return listed.mapInArrow(task, "group string, block long, ahead array<long>, cost long")


def _walked(blocks: DataFrame, costs: Costs) -> DataFrame:
    """Blocks with their walks: for each state at the start, the state at the end and the edits."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(REMEMBERED)(lambda codes, ahead: walk(codes, list(ahead), costs))
        for batch in batches:
            aheads = batch.column("ahead").to_pylist()
            found = [known(codes, tuple(ahead)) for codes, ahead in zip(_codes(batch), aheads)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("group"),
                    batch.column("block"),
                    batch.column("cost"),
                    pa.array([[end for end, _ in walks] for walks in found], pa.list_(pa.int32())),
                    pa.array([[edits for _, edits in walks] for walks in found], pa.list_(pa.string())),
                ],
                ["group", "block", "cost", "ends", "walks"],
            )

    return blocks.mapInArrow(task, "group string, block long, cost long, ends array<int>, walks array<string>")


def _entered(walked: DataFrame) -> DataFrame:
    """The state in which each block is entered, and the insertions after the last one."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                state = START
                for block in row["blocks"]:
                    entered, state = state, block["ends"][state]
                    last = block is row["blocks"][-1]
                    out.append((row["group"], block["block"], entered, closing(state) if last else ""))
            yield _batch(out, ["group", "block", "entered", "closing"], [pa.string(), pa.int64(), pa.int32(), pa.string()])

    listed = walked.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("block", "ends"))).alias("blocks"))
    return listed.mapInArrow(task, "group string, block long, entered int, closing string")


# --- results -------------------------------------------------------------------------


@dataclass(frozen=True)
class Repair:
    """``turns``: the columns of ``faults``. ``blocks``: group, block, cost (of the whole
    conversation), edits (letters of EDITS) of the block's turns and closing, the edits after
    the last turn. Both lie in the shared folder."""

    turns: DataFrame
    blocks: DataFrame


def repair(conversations: DataFrame, costs: Costs = Costs()) -> Repair:
    """The cheapest edits of ``conversations`` (conv_id, turn, role, text)."""
    with Scratch(conversations.sparkSession) as scratch:
        turns = materialise(faults(conversations, scratch))
        blocks = scratch.write(_with_costs(_blocks(turns), costs))
        ahead = scratch.write(_checkpoints(blocks, costs))
        walked = scratch.write(_walked(blocks.join(ahead, ["group", "block"]), costs))
        chosen = walked.join(_entered(walked), ["group", "block"])
        edits = F.get("walks", F.col("entered")).alias("edits")
        return Repair(turns, materialise(chosen.select("group", "block", "cost", edits, "closing")))


def steps(found: Repair) -> DataFrame:
    """group, rank and step of every turn: the insertions before it and its own edit.

    Insertions after the last turn are a step of rank n.
    """
    sizes = found.turns.where("rank = 0").select("group", "n")
    own = F.regexp_extract_all("edits", F.lit("[ua]*[DKUA]"), F.lit(0))
    last = F.when(F.col("closing") != "", F.array("closing")).otherwise(F.array().cast("array<string>"))
    length = F.ceil(F.sqrt(F.col("n").cast("double"))).cast("long")
    listed = found.blocks.join(sizes, "group").select(
        "group", (F.col("block") * length).alias("first"), F.posexplode(F.concat(own, last)).alias("i", "step")
    )
    return listed.select("group", (F.col("first") + F.col("i")).alias("rank"), "step")


def repaired_text(found: Repair, conversations: DataFrame) -> DataFrame:
    """group, repaired_sha256 and repaired_turns of every conversation with turns.

    The digest is that of ``role:text`` of all turns after the repair, joined by line feeds.
    Texts cross the network once, and are read in order as they arrive.
    """
    none = F.lit(None)
    texts = keyed(conversations).select(
        *KEY, F.lit(0).alias("kind"), F.lit(0).cast("long").alias("rank"), "text", none.cast("string").alias("step")
    )
    # a step after the last turn has no turn of its own, so it follows that of the last one
    listed = steps(found)
    sizes = found.turns.where("rank = n - 1").select("group", "rank", *[F.col(c).alias(f"own_{c}") for c in KEY[1:]])
    listed = found.turns.select(*KEY, "rank").join(listed, ["group", "rank"], "left").select(*KEY, "rank", "step")
    closed = found.blocks.where("closing <> ''").select("group", "closing").join(sizes, "group")
    closed = closed.select(
        "group", *[F.col(f"own_{c}").alias(c) for c in KEY[1:]], (F.col("rank") + 1).alias("rank"), F.col("closing").alias("step")
    )
    kind, text = F.lit(1).alias("kind"), none.cast("string").alias("text")
    both = texts.unionAll(listed.unionAll(closed).select(*KEY, kind, "rank", text, "step"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, text, hashed, n = None, "", None, 0
        names, types = ["group", "repaired_sha256", "repaired_turns"], [pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            done = []
            rows = zip(*[batch.column(c).to_pylist() for c in ("group", "kind", "role", "text", "step")])
            for own, kind, role, said, step in rows:
                if own != group:
                    if hashed:
                        done.append((group, hashed.hexdigest(), n))
                    group, hashed, n = own, hashlib.sha256(), 0
                if kind == 0:
                    text = said
                    continue
                for edit in step:
                    if edit == "D":
                        continue
                    line = f"{role if edit == 'K' else ROLES[edit]}:{'' if edit in 'ua' else text}"
                    hashed.update((("\n" if n else "") + line).encode())
                    n += 1
            yield _batch(done, names, types)
        if hashed:
            yield _batch([(group, hashed.hexdigest(), n)], names, types)

    order = [*KEY, "kind", "rank"]
    laid = both.repartition("group").sortWithinPartitions(*order)
    return laid.select("group", "kind", "role", "text", "step").mapInArrow(
        task, "group string, repaired_sha256 string, repaired_turns long"
    )


def repaired_turns(found: Repair, conversations: DataFrame) -> DataFrame:
    """group, rank, place, edit (an initial), role and text of the turns after the repair.

    ``rank`` is that of the turn that they stand at or, inserted, before.
    """
    # copies of a text are alike, so any of them will do
    one = keyed(conversations).groupBy(*KEY).agg(F.min("text").alias("text"))
    match = reduce(and_, [F.col(f"t.{c}").eqNullSafe(F.col(f"k.{c}")) for c in KEY])
    texts = found.turns.alias("t").join(one.alias("k"), match).select("t.group", "t.rank", "t.role", "k.text")
    listed = steps(found).join(texts, ["group", "rank"], "left")
    each = listed.select("*", F.posexplode(F.split("step", "")).alias("place", "edit")).where("edit NOT IN ('D', '')")
    role = F.when(F.col("edit") == "K", F.col("role"))
    for letter, name in ROLES.items():
        role = role.when(F.col("edit") == letter, F.lit(name))
    text = F.when(F.col("edit").isin("u", "a"), "").otherwise(F.col("text"))
    return each.select("group", "rank", "place", audit(F.col("edit")).alias("edit"), role.alias("role"), text.alias("text"))


def summary(found: Repair) -> DataFrame:
    """group, turns, gaps, blank, duplicate, truncated, illegal, cost and audit of every conversation."""

    def having(fault: str) -> Column:
        return F.count_if(F.col("fault") == fault).alias(fault)

    gaps = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    counts = found.turns.groupBy("group").agg(
        F.count(F.lit(1)).alias("turns"),
        F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"),
        *[having(f) for f in ("blank", "duplicate", "truncated")],
    )
    initial = F.col("code").bitwiseAND(F.lit(3).cast("byte")).cast("int")
    before = found.turns.select("group", (F.col("rank") + 1).alias("rank"), initial.alias("before"))
    pair = F.col("before") * 4 + initial
    legal = [INITIALS.index(a) * 4 + INITIALS.index(b) for a, b in ("su", "ua", "au")]
    pairs = found.turns.join(before, ["group", "rank"]).groupBy("group").agg(F.count_if(~pair.isin(*legal)).alias("illegal"))
    edits = found.blocks.groupBy("group").agg(
        F.max("cost").alias("cost"),
        audit(
            F.array_join(
                F.transform(F.sort_array(F.collect_list(F.struct("block", "edits", "closing"))), lambda b: F.concat(b["edits"], b["closing"])), ""
            )
        ).alias("audit"),
    )
    return counts.join(edits, "group").join(pairs, "group", "left").withColumn("illegal", F.coalesce("illegal", F.lit(0)).cast("long"))
