"""Approximate nearest neighbours by cross-polytope hashing.

A vector is scaled to length one and turned by a pseudo-rotation: three times random signs
and a fast Hadamard transform. Its hash is the signed axis that it is nearest to. A table
has two rotations of its own, and its buckets are the pairs of their axes. A query asks, in
each table, the ``probes`` x ``probes`` buckets whose two axes have the largest sum of
projections, as many as ``probes`` axes of either rotation span.
Everything found in any table is a candidate and is reranked, once, by the exact inner
product in double precision.

Vectors are dealt evenly to parts, whatever their hashes and ids are, and cross the network
once, in the type that they have. A task holds one part and its tables; the queries pass by
in blocks, each leaving its best ``k`` of the part. Those are all that is shuffled after
that; candidates are never written out. Parts grow with the root of the number of vectors
up to BLOCK. A query that found fewer than ``k`` is asked again of all vectors of all
parts.

Vectors that are null, zero or hold null or non-finite components take no part, nor do
those whose length differs from ``dimensions``, nor rows without an id. Rows with equal ids
are one entry: their score with a query is the largest of any of their vectors, also where
it is the query that repeats. Ties go to the smaller id. With ``k`` or fewer others all are
returned; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paysegments.functions.lineage import Scratch, materialise
from paysegments.functions.shipping import ship_by_value

ship_by_value(__name__)

# Vectors of a part: SPREAD times the root of their number, about BLOCK at most.
SPREAD, BLOCK = 32, 65536
# Queries compared with a part at a time, and vectors hashed at a time.
QUERIES, RUN = 64, 512
# Buckets of a table; more pairs of axes than that share them.
BUCKETS = 1 << 16
# Which rows of a part's stream: vectors come before queries.
VECTOR, QUERY = 0, 1


def usable(vector: Column, dimensions: int) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = vector.isNotNull() & (F.size(vector) == dimensions) & finite
    return F.coalesce(whole & F.exists(vector, lambda x: x != 0), F.lit(False))


def hadamard(values: np.ndarray) -> np.ndarray:
    """The fast transform of the columns, whose length is a power of two."""
    n, columns = values.shape
    width = 1
    while width < n:
        pairs = values.reshape(-1, 2, width, columns)
        values = np.empty_like(pairs)
        np.add(pairs[:, 0], pairs[:, 1], out=values[:, 0])
        np.subtract(pairs[:, 0], pairs[:, 1], out=values[:, 1])
        width *= 2
    return values.reshape(n, columns) / np.sqrt(n)


def _turned(unit: np.ndarray, rotation: int, seed: int) -> np.ndarray:
    """The vectors, padded to a power of two, after a rotation: a column each."""
    size = 1 << max(unit.shape[1] - 1, 0).bit_length()
    signs = np.random.default_rng([seed, rotation]).choice([-1.0, 1.0], (3, size, 1))
    turned = np.zeros((size, len(unit)))
    turned[: unit.shape[1]] = unit.T
    for sign in signs:
        turned = hadamard(turned * sign)
    return turned


def rotated(vectors: np.ndarray, rotation: int, seed: int) -> np.ndarray:
    """The projections on the signed axes (axis, then its opposite) after a rotation."""
    turned = _turned(vectors, rotation, seed).T
    return np.concatenate([turned, -turned], axis=1)


def nearest_axis(vectors: np.ndarray, rotation: int, seed: int) -> np.ndarray:
    """The signed axis with the largest projection, numbered as the columns of ``rotated``."""
    turned = _turned(vectors, rotation, seed)
    axis = np.abs(turned).argmax(axis=0)
    return axis + len(turned) * (turned[axis, np.arange(len(vectors))] < 0)


def _unit(matrix: np.ndarray) -> np.ndarray:
    scaled = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def index(matrix: np.ndarray, tables: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every table the rows by bucket, and the place in them where each bucket starts."""
    codes = np.zeros((tables, len(matrix)), np.int64)
    axes = 2 << max(matrix.shape[1] - 1, 0).bit_length()
    for start in range(0, len(matrix), RUN):
        unit = _unit(matrix[start : start + RUN].astype(np.float64))
        for table in range(tables):
            first, second = (nearest_axis(unit, 2 * table + i, seed) for i in range(2))
            codes[table, start : start + RUN] = first * axes + second
    codes %= BUCKETS
    counts = [np.bincount(c, minlength=BUCKETS) for c in codes]
    return [
        (np.argsort(c, kind="stable").astype(np.int32), np.concatenate([[0], np.cumsum(n)]))
        for c, n in zip(codes, counts)
    ]


def probed(unit: np.ndarray, table: int, probes: int, seed: int) -> np.ndarray:
    """For each row the buckets of a table whose axes have the largest sums of projections."""
    first, second = (rotated(unit, 2 * table + i, seed) for i in range(2))
    size = first.shape[1]
    wanted, place = probes * probes, np.arange(1, size + 1)
    # the pair of the i-th and the j-th axis has i * j pairs, itself included, that are as good
    i, j = np.nonzero(np.outer(place, place) <= wanted)
    by_first, by_second = (np.argsort(-a, axis=1, kind="stable") for a in (first, second))
    sums = np.take_along_axis(first, by_first, 1)[:, i] + np.take_along_axis(second, by_second, 1)[:, j]
    best = np.argpartition(-sums, min(wanted, len(i)) - 1, axis=1)[:, :wanted]
    pairs = np.take_along_axis(by_first, i[best], 1) * size + np.take_along_axis(by_second, j[best], 1)
    return pairs % BUCKETS


def candidates(queries: np.ndarray, built: list, size: int, probes: int, seed: int) -> np.ndarray:
    """Which of the ``size`` rows of an index each query finds in some table."""
    unit = _unit(queries.astype(np.float64))
    found = np.zeros((len(unit), size), bool)
    for table, (rows, starts) in enumerate(built):
        asked = probed(unit, table, probes, seed)
        low = starts[asked].ravel()
        number = starts[asked + 1].ravel() - low
        ends = np.cumsum(number)
        place = np.arange(ends[-1]) + np.repeat(low - ends + number, number)
        found[np.repeat(np.arange(len(unit)).repeat(asked.shape[1]), number), rows[place]] = True
    return found


def _matrix(column: pa.ListArray, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def _blocks(queries: DataFrame) -> DataFrame:
    """ids and vectors of QUERIES queries a row, one vector after the other."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, QUERIES):
                some = batch.slice(start, QUERIES)
                values = some.column("vector").flatten()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.ListArray.from_arrays(pa.array([0, some.num_rows], pa.int32()), some.column("id")),
                        pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values),
                    ],
                    ["ids", "vectors"],
                )

    kind = queries.schema["vector"].dataType.simpleString()
    return queries.select("id", "vector").mapInArrow(task, f"ids array<long>, vectors {kind}")


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the best ``k`` ids by score, ties to the smaller id; an id counts once."""
    order = np.lexsort([ids, -scores])
    _, first = np.unique(ids[order], return_index=True)
    return order[np.sort(first)[:k]]


def _search(
    taken: DataFrame, queries: DataFrame, n: int, dimensions: int, k: int, tables: int, probes: int, seed: int
) -> DataFrame:
    """query_id, vec_id, score: the best of each part for each query. Without tables, of all its vectors."""
    parts = max(1, math.ceil(math.sqrt(n) / SPREAD), math.ceil(n / BLOCK))

    def answers(asked: np.ndarray, questions: np.ndarray, ids: np.ndarray, matrix: np.ndarray, built: list) -> list:
        found = []
        for start in range(0, len(asked), QUERIES):
            some = slice(start, start + QUERIES)
            wide = questions[some].astype(np.float64)
            near = candidates(wide, built, len(ids), probes, seed) if built else np.ones((len(wide), len(ids)), bool)
            for own, vector, row in zip(asked[some], wide, near):
                kept = np.flatnonzero(row & (ids != own))
                # row by row in double precision, so that equal vectors have equal scores
                scores = np.einsum("vd,d->v", matrix[kept].astype(np.float64), vector)
                best = _best(ids[kept], scores, k)
                found.append((np.full(len(best), own), ids[kept][best], scores[best]))
        return found

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ready = None, [], None
        for batch in batches:
            keys = np.stack([batch.column("part").to_numpy(), batch.column("kind").to_numpy()], axis=1)
            ends = np.append(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, len(keys))
            start = 0
            for end in ends[ends > 0]:
                part, kind = keys[start]
                some = batch.slice(start, end - start)
                ids = some.column("ids").flatten().to_numpy()
                matrix = _matrix(some.column("vectors"), dimensions)
                if part != now:
                    now, held, ready = part, [], None
                if kind == VECTOR:
                    held.append((ids, matrix))
                elif held or ready:
                    if ready is None:
                        every = np.concatenate([h[1] for h in held])
                        ready = np.concatenate([h[0] for h in held]), every, index(every, tables, seed)
                        held = []
                    found = answers(ids, matrix, *ready)
                    columns = [np.concatenate([f[i] for f in found]) for i in range(3)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])
                start = end

    part = F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int").alias("part")
    own = taken.select(part, F.lit(VECTOR).alias("kind"), F.array("id").alias("ids"), F.col("vector").alias("vectors"))
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    asking = _blocks(queries).select(every, F.lit(QUERY).alias("kind"), "ids", "vectors")
    # by number and not by its hash, so that no two parts meet in one task
    streams = own.unionByName(asking).repartitionById(parts, "part").sortWithinPartitions("part", "kind")
    return streams.mapInArrow(task, "query_id long, vec_id long, score double")


def _merged(found: DataFrame, k: int) -> DataFrame:
    """query_id, found: the best ``k`` of the answers of all parts to a query, as an ordered list."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    answer = F.struct((-F.col("score")).alias("minus"), "vec_id")
    return once.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(answer)), 1, k).alias("found"))


def nearest(
    vectors: DataFrame,
    queries: Column,
    dimensions: int,
    k: int = 20,
    tables: int = 32,
    probes: int = 16,
    seed: int = 1,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the nearest of all ``vectors`` (vec_id, embedding)
    to those of them for which ``queries`` holds."""
    double = F.col("embedding").cast("array<double>")
    narrow = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    vector = F.col("embedding") if narrow else double
    with Scratch(vectors.sparkSession) as scratch:
        taken = vectors.where(usable(double, dimensions)).where("vec_id IS NOT NULL")
        taken = scratch.write(
            taken.select(
                F.col("vec_id").cast("long").alias("id"),
                vector.alias("vector"),
                F.coalesce(queries, F.lit(False)).alias("query"),
            )
        )
        n = taken.count()
        asking = taken.where("query")
        found = scratch.write(_merged(_search(taken, asking, n, dimensions, k, tables, probes, seed), k))
        enough = found.where(F.size("found") == k)
        short = scratch.write(asking.join(enough, F.col("id") == F.col("query_id"), "left_anti"))
        if not short.isEmpty():
            found = enough.unionByName(_merged(_search(taken, short, n, dimensions, k, 0, 0, seed), k))
        listed = found.select("query_id", F.posexplode("found").alias("at", "f")).select(
            "query_id", (F.col("at") + 1).alias("rank"), "f.vec_id", (-F.col("f.minus")).alias("score")
        )
        return materialise(listed)
