"""Near-duplicates by SimHash, found through popcounts of fingerprint segments.

A fingerprint has 64 bits; a bit is set if it is set in over half of the hashes of the
text's shingles. Fingerprints that differ in a few bits only are linked.

The 64 bits are 32 segments of two, and the embedding maps a fingerprint to the number
of bits set in each. One differing bit changes one of these counts by one, so the
Manhattan distance of two embeddings is never above the bit distance. For the range join,
the segments are dealt to blocks, three more than the bits that may differ: at least
three blocks then have distance zero, so linked fingerprints share a cell of one of the
grids that three blocks span (20 grids for 3 bits). Inside a cell, pairs are tested by
the Manhattan distance and then by the bits themselves. Counts are kept in unary, 0 as
00, 1 as 01, 2 as 11, so that the Manhattan distance is the bit distance of embeddings.

Fingerprints are grouped before, so copies cost one row however many they are. Cells are
sorted streams, not groups in memory. A cell with more than BLOCK rows is dealt out over
the pairs of its blocks, so no task holds more than two of them, and a task gives back
the links that connect what it found connected, never all pairs.

Defined results: a null text is an empty one; with fewer words than a shingle the whole
sequence is the only shingle; without words the fingerprint is zero and linked like any
other; the component of rows whose ids are all null is null; equal ids and repeated rows
are rows like others; a very long text counts with all its shingles; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paysegments.functions.lineage import Scratch, materialise
from paysegments.functions.shipping import ship_by_value
from paysegments.llm.components import components
from paysegments.llm.text import as_bytes, small_batches

ship_by_value(__name__)

SEED = 42
BITS = 64
# Blocks beyond the number of bits that may differ; so many span a grid.
SPARE = 3
# Rows of a cell that one task compares at a time with as many others.
BLOCK = 2048
# Shingles hashed at a time.
RUN = 1 << 16


def fingerprint(text: bytes, shingle: int) -> int:
    words = text.lower().split()  # of bytes: A-Z and the six ASCII white-space characters only
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(len(words) - shingle + 1, 1)
    first, last = starts[:n].tolist(), ends[-n:].tolist()
    digest = xxhash.xxh64_digest
    counts = np.zeros(BITS, np.int64)
    for run in range(0, n, RUN):
        spans = zip(first[run : run + RUN], last[run : run + RUN])
        hashes = b"".join([digest(joined[s:e], SEED) for s, e in spans])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``carry`` and the fingerprint (a signed long) of every row of ``docs``."""
    small_batches(docs.sparkSession)
    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    schema = f"{types}, fingerprint long"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(as_bytes(t), shingle) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in carry], pa.array(found, pa.int64())], [*carry, "fingerprint"]
            )

    return docs.select(*carry, "text").mapInArrow(task, schema)


def _embedding(value: Column) -> Column:
    """The popcounts of the two-bit segments in unary, as one long."""
    low = F.lit(0x5555555555555555)
    high = F.shiftrightunsigned(value, 1)
    either = value.bitwiseOR(high).bitwiseAND(low)
    both = value.bitwiseAND(high).bitwiseAND(low)
    return either.bitwiseOR(F.shiftleft(both, 1))


def _grids(most: int) -> list[int]:
    """Masks of the segments that span each grid."""
    blocks = most + SPARE
    masks = [0] * blocks
    for segment in range(BITS // 2):
        masks[segment * blocks // (BITS // 2)] |= 3 << 2 * segment
    wide = [sum(chosen) for chosen in combinations(masks, SPARE)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in wide]


def _cells(values: DataFrame, most: int, scratch: Scratch) -> DataFrame:
    """fingerprint by grid, cell and, in large cells, pair of blocks (i <= j)."""
    grids = F.explode(F.array(*[F.struct(F.lit(g).alias("grid"), F.lit(m).alias("mask")) for g, m in enumerate(_grids(most))]))
    listed = values.select("fingerprint", _embedding(F.col("fingerprint")).alias("e"), grids.alias("g"))
    cells = listed.select("fingerprint", F.col("g.grid").alias("grid"), F.col("e").bitwiseAND(F.col("g.mask")).alias("cell"))
    large = cells.groupBy("grid", "cell").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    large = scratch.write(large.select("grid", "cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    dealt = cells.join(large, ["grid", "cell"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = dealt.withColumn("other", other)
    return paired.select(
        "grid", "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fingerprint"
    )


def connect(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Few links that connect what the links left-right connect."""
    nodes, flat = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = flat[: len(left)], flat[len(left) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        if (label[a] == least).all() and (label[b] == least).all():
            break
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        label = label[label]
    member = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[member], nodes[label[member]]


def _unary(values: np.ndarray) -> np.ndarray:
    low = np.uint64(0x5555555555555555)
    high = values >> np.uint64(1)
    return ((values | high) & low) | ((values & high & low) << np.uint64(1))


def _links(keys: list[np.ndarray], values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows that are sorted by their keys."""
    same = np.ones(len(values) - 1, bool)
    for key in keys:
        same &= key[1:] == key[:-1]
    group = np.concatenate([[0], np.cumsum(~same)])
    counts = _unary(values)
    left, right = [], []
    distance = 1
    at = np.flatnonzero(same)  # rows with another one of their cell at this distance
    while len(at):  # pairs of neighbours, then of next neighbours, and so on
        near = at[np.bitwise_count(counts[at] ^ counts[at + distance]) <= most]
        found = near[np.bitwise_count(values[near] ^ values[near + distance]) <= most]
        left.append(found)
        right.append(found + distance)
        distance += 1
        at = at[at + distance < len(values)]
        at = at[group[at] == group[at + distance]]
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return connect(np.concatenate(left), np.concatenate(right))


def links(values: DataFrame, most: int, scratch: Scratch) -> DataFrame:
    """Links a, b that connect the distinct fingerprints within ``most`` bits of each other."""
    by = ["grid", "cell", "i", "j"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in (*by, "fingerprint")]
            if rest is not None:
                columns = [np.concatenate(pair) for pair in zip(rest, columns)]
            differs = np.zeros(len(columns[0]), bool)
            for key in columns[:-1]:
                differs |= key != key[-1]
            last = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
            rest = [c[last:] for c in columns]  # the last cell may go on in the next batch
            if last > 1:
                yield found([c[:last] for c in columns])
        if rest is not None and len(rest[0]) > 1:
            yield found(rest)

    def found(columns: list[np.ndarray]) -> pa.RecordBatch:
        values = columns[-1].view(np.uint64)
        a, b = _links(columns[:-1], values, most)
        return pa.RecordBatch.from_arrays([pa.array(columns[-1][a]), pa.array(columns[-1][b])], ["a", "b"])

    cells = _cells(values, most, scratch)
    return cells.repartition(*by).sortWithinPartitions(*by).mapInArrow(task, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, most: int = 3) -> DataFrame:
    """doc_id, fingerprint (signed long) and component_id (smallest id linked, directly or not)."""
    return groups(docs, shingle, most).select("doc_id", "fingerprint", "component_id")


def groups(docs: DataFrame, shingle: int = 3, most: int = 3, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``carry`` (doc_id and others), fingerprint, component and component_id of every row.

    Rows of one id can have texts that belong to several components; ``component``, a
    fingerprint, tells these apart where their smallest ids are equal.
    """
    rows = materialise(fingerprints(docs, shingle, carry))
    with Scratch(docs.sparkSession) as scratch:
        values = scratch.write(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
        nodes = components(links(values, most, scratch), scratch)
        named = values.join(nodes, values["fingerprint"] == nodes["node"], "left").select(
            "fingerprint", "least", F.coalesce("component", "fingerprint").alias("component")
        )
        ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
        named = materialise(named.join(ids, "component").select("fingerprint", "component", "component_id"))
    return rows.join(named, "fingerprint").select(*carry, "fingerprint", "component", "component_id")


def hexadecimal(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")
