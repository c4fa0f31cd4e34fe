"""Shards by consistent hashing with bounded loads.

Every shard has many virtual nodes on a ring of cells. A row belongs to the first
virtual node at or clockwise of its key's cell. Each shard takes an equal number of
rows, give or take one. In rounds, rows that found their shard full go on to the next
other shard clockwise; a shard takes those that arrive in the order of the ring and,
inside an arc, of the key's hash. Rows that a shard has taken stay, so only the excess
of a shard moves, and another number of shards moves few rows.

Rows of one arc differ only in their order, so the rounds need one number per arc. Those
counts (virtual nodes x shards of them, whatever the size of the data) are the only thing
that reaches the driver. It answers with intervals: rows so many to so many of an arc go
to this shard from this slot on. Each row finds its interval by its rank in the arc; only
narrow rows are shuffled, never texts. Everything is DataFrame functions.

Defined results: a null text has no bytes; rows without a key take their place on the ring
from their text; rows with equal keys stay neighbours on the ring and are told apart by
size and checksum, identical rows are exchangeable; with fewer rows than shards the last
shards stay empty; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paysegments.functions.lineage import materialise

# Bytes that a row takes besides its text.
OVERHEAD = 16
CELLS = 1 << 16
HEX = 15  # digits of a hash that are used: 60 bits


def _position(key: str) -> int:
    return int(hashlib.md5(key.encode()).hexdigest()[:HEX], 16)


def ring(shards: int, virtual_nodes: int) -> list[tuple[int, int]]:
    """(cell, shard) of the virtual nodes, clockwise; the first node in a cell holds it.

    A shard whose nodes all lost their cells takes the next free cell after its first
    node's, so every shard is on the ring.
    """
    if shards > CELLS:
        raise ValueError(f"{shards} shards on a ring of {CELLS} cells")
    nodes: dict[int, tuple[int, int]] = {}
    for shard in range(shards):
        for node in range(virtual_nodes):
            position = _position(f"{shard}/{node}")
            cell = position * CELLS >> 4 * HEX
            nodes[cell] = min(nodes.get(cell, (position, shard)), (position, shard))
    placed = {shard for _, shard in nodes.values()}
    for shard in range(shards):
        cell = _position(f"{shard}/0") * CELLS >> 4 * HEX
        while shard not in placed:
            if len(nodes) == CELLS:
                raise ValueError(f"{shards} shards with {virtual_nodes} nodes each fill a ring of {CELLS} cells")
            if cell not in nodes:
                nodes[cell] = (cell, shard)
                placed.add(shard)
            cell = (cell + 1) % CELLS
    return [(cell, nodes[cell][1]) for cell in sorted(nodes)]


def intervals(nodes: list[tuple[int, int]], counts: dict[int, int], shards: int) -> list[dict]:
    """Which rows of each arc, by rank, go to which shard, and to which slots there."""
    rows = sum(counts.values())
    free = [rows // shards + (s < rows % shards) for s in range(shards)]
    taken = [0] * shards
    at = {arc: i for i, (arc, _) in enumerate(nodes)}  # where an arc's rows ask next
    asked: dict[int, set[int]] = defaultdict(set)
    first = dict.fromkeys(counts, 0)
    waiting = sorted(arc for arc, n in counts.items() if n)
    placed = []
    while waiting:
        still = []
        for arc in waiting:
            shard = nodes[at[arc]][1]
            asked[arc].add(shard)
            n = min(counts[arc] - first[arc], free[shard])
            if n:
                placed.append(
                    {"arc": arc, "low": first[arc], "high": first[arc] + n, "shard": shard, "slot": taken[shard]}
                )
                first[arc] += n
                free[shard] -= n
                taken[shard] += n
            if first[arc] < counts[arc]:
                still.append(arc)
        for arc in still:  # an arc asks no shard twice
            while nodes[at[arc]][1] in asked[arc]:
                at[arc] = (at[arc] + 1) % len(nodes)
        waiting = still
    return placed


def _table(spark, rows: list[dict], schema: str) -> DataFrame:
    listed = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")
    return spark.range(1).select(F.inline(listed))


def _hash(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key), 1, HEX), 16, 10).cast("long")


def assign(docs: DataFrame, shards: int, virtual_nodes: int = 128) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0) of every row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keyed = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.col("text_crc32").cast("string")))
    spark = docs.sparkSession
    nodes = ring(shards, virtual_nodes)
    arcs = _arcs(spark, nodes)
    narrow = keyed.withColumn("position", _hash(key))
    narrow = narrow.withColumn("cell", F.shiftright("position", 4 * HEX - 16).cast("int"))
    narrow = materialise(narrow.join(F.broadcast(arcs), "cell").drop("cell"))
    counts = {r["arc"]: r["n"] for r in narrow.groupBy("arc").agg(F.count("*").alias("n")).collect()}
    plan = _table(
        spark, intervals(nodes, counts, shards), "arc:int,low:bigint,high:bigint,shard:int,slot:bigint"
    )
    order = Window.partitionBy("arc").orderBy("position", "doc_id", "size", "text_crc32")
    ranked = narrow.withColumn("rank", F.row_number().over(order).cast("long") - 1)
    inside = (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    return (
        ranked.join(F.broadcast(plan), "arc")
        .where(inside)
        .select(
            "doc_id", "size", "text_crc32", "shard", (F.col("slot") + F.col("rank") - F.col("low")).alias("slot")
        )
    )


def _arcs(spark, nodes: list[tuple[int, int]]) -> DataFrame:
    """cell and arc of all cells; the cells after the last node belong to the first."""
    ends = [cell for cell, _ in nodes]
    rows = [{"arc": end, "low": low + 1, "high": end} for low, end in zip([-1, *ends], ends)]
    if ends[-1] < CELLS - 1:
        rows.append({"arc": ends[0], "low": ends[-1] + 1, "high": CELLS - 1})
    table = _table(spark, rows, "arc:int,low:int,high:int")
    return table.select("arc", F.explode(F.sequence("low", "high")).alias("cell"))
