"""Near-duplicates of embeddings by an inverted index with product quantisation.

Vectors are compared if their labels are equal. Coarse centroids divide the unit sphere
into lists; a vector stands in the list of its nearest centroid, with its residual
quantised subspace by subspace to a short code. A query looks up the distances of its own
residual to all codewords once per list, and adds them up by the codes (asymmetric
distances). What passes is reranked by the exact cosine in double precision.

Probes and cut are sufficient, not tuned: cosine t means a distance of at most
d = sqrt(2 - 2t) on the sphere. A vector of another list lies beyond the plane halfway to
that list's centroid, so lists whose plane is farther than d need no probe. The code's own
error e is stored with it, and by the triangle inequality the looked-up distance of a link
is at most d + e. So no link is lost, whatever the sample the index was fitted on was
like. Of two lists, only the vectors of the first probe the second.

The index (centroids and codewords) is fitted on at most SAMPLE vectors chosen by hash;
every vector is indexed. Equal vectors of a label are one row with a number. A list meets
its queries as a sorted stream: up to BLOCK codes are held while the queries pass. Longer
lists are dealt to several tasks. What comes out is a sum of links per vector and the few
links that connect what a block found connected, never all pairs.

Defined results: vectors that are null, zero, hold null or non-finite components or have
another length, and those without label or id, link with nothing, are their own component
and are kept; rows with equal ids are rows like others; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paysegments.functions.lineage import Scratch, materialise
from paysegments.functions.shipping import ship_by_value
from paysegments.llm.text import send
from paysegments.llm.ann import usable
from paysegments.llm.components import components
from paysegments.llm.simhash import connect

ship_by_value(__name__)

# Most vectors that the index is fitted on, and most lists.
SAMPLE, LISTS = 8192, 1024
# Vectors of all labels for which there is one list.
PER_LIST = 8192
SUBSPACES, CODEWORDS = 8, 64
# Codes of a list that a task holds, and queries that it compares with them at a time.
BLOCK, QUERIES = 4096, 128
CODE, HOME, QUERY = 0, 1, 2  # what a row is in a list: an entry, its own query, one from elsewhere
SLACK = 1e-5


@dataclass(frozen=True)
class Index:
    centroids: np.ndarray  # list by dimension
    codewords: np.ndarray  # subspace by codeword by dimension of the subspace


def _k_means(points: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(0)
    centres = points[np.sort(rng.choice(len(points), min(k, len(points)), replace=False))].copy()
    for _ in range(rounds):
        nearest = _squares(points, centres).argmin(axis=1)
        n = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _squares(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    cross = points @ centres.T
    return np.maximum((points * points).sum(1)[:, None] - 2 * cross + (centres * centres).sum(1), 0)


def fit(sample: np.ndarray, lists: int) -> Index:
    """An index from unit vectors."""
    centroids = _k_means(sample, lists)
    residuals = sample - centroids[_squares(sample, centroids).argmin(axis=1)]
    parts = np.array_split(residuals, SUBSPACES, axis=1)
    width = parts[0].shape[1]
    codewords = np.zeros((SUBSPACES, min(CODEWORDS, len(sample)), width))
    for i, part in enumerate(parts):
        codewords[i, :, : part.shape[1]] = _k_means(part, CODEWORDS)
    return Index(centroids, codewords)


def _subspaces(residuals: np.ndarray, width: int) -> np.ndarray:
    """Row by subspace by dimension; narrower subspaces are filled up with zeros."""
    out = np.zeros((len(residuals), SUBSPACES, width))
    for i, part in enumerate(np.array_split(residuals, SUBSPACES, axis=1)):
        out[:, i, : part.shape[1]] = part
    return out


def encode(index: Index, residuals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of residuals, and the distance of each residual from what its code stands for."""
    parts = _subspaces(residuals, index.codewords.shape[2])
    codes = np.stack([_squares(parts[:, m], index.codewords[m]).argmin(axis=1) for m in range(SUBSPACES)], axis=1)
    meant = index.codewords[np.arange(SUBSPACES), codes]
    return codes.astype(np.uint8), np.sqrt(((parts - meant) ** 2).sum(axis=(1, 2)))


def probes(index: Index, unit: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The own list of each vector, and row and list of the later lists within reach."""
    squares = _squares(unit, index.centroids)
    own = squares.argmin(axis=1)
    apart = np.sqrt(_squares(index.centroids, index.centroids))[own]
    beyond = squares - squares[np.arange(len(unit)), own][:, None] <= 2 * apart * (reach + SLACK) + SLACK
    beyond &= np.arange(len(index.centroids)) > own[:, None]
    rows, lists = np.nonzero(beyond)
    return own, rows, lists


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _matrix(column: pa.ListArray, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)


def _listed(distinct: DataFrame, index: Index, dimensions: int, reach: float) -> DataFrame:
    """label, list, kind, id, n, vector: each vector as code in its list and as query where it probes."""
    sent = send(distinct.sparkSession, index)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent()
        for batch in batches:
            if not batch.num_rows:
                continue
            own, rows, lists = probes(index, _unit(_matrix(batch.column("vector"), dimensions)), reach)
            n = len(own)
            every = pa.array(np.concatenate([np.arange(n), np.arange(n), rows]))
            kind = np.repeat([CODE, HOME, QUERY], [n, n, len(rows)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("label").take(every),
                    pa.array(np.concatenate([own, own, lists]).astype(np.int32)),
                    pa.array(kind),
                    *[batch.column(c).take(every) for c in ("id", "n", "vector")],
                ],
                ["label", "list", "kind", "id", "n", "vector"],
            )

    label = distinct.schema["label"].dataType.simpleString()
    value = distinct.schema["vector"].dataType.simpleString()
    return distinct.mapInArrow(task, f"label {label}, list int, kind int, id long, n long, vector {value}")


def _dealt(listed: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds ``part``: lists with more than BLOCK codes are dealt out, with all their queries."""
    by = ["label", "list"]
    sizes = listed.where(F.col("kind") == CODE).groupBy(*by).agg(F.count("*").alias("size"))
    many = F.ceil(F.col("size") * 1.25 / BLOCK).cast("int").alias("parts")
    large = scratch.write(sizes.where(F.col("size") > BLOCK).select(*by, many))
    parts = F.coalesce("parts", F.lit(1))
    own = F.array(F.pmod(F.xxhash64("id"), parts).cast("int"))
    part = F.when(F.col("kind") == CODE, own).otherwise(F.sequence(F.lit(0), parts - 1))
    return listed.join(large, by, "left").select(*by, F.explode(part).alias("part"), "kind", "id", "n", "vector")


class _Codes:
    """The codes of a part of a list, with the vectors for the rerank."""

    def __init__(self, index: Index, at: int, threshold: float, reach: float):
        self.index, self.at, self.threshold, self.reach = index, at, threshold, reach
        self.parts: list[tuple] = []
        self.ready = None

    def add(self, ids: np.ndarray, n: np.ndarray, vectors: np.ndarray) -> None:
        unit = _unit(vectors)
        self.parts.append((ids, n, unit, *encode(self.index, unit - self.index.centroids[self.at])))

    def links(self, ids: np.ndarray, n: np.ndarray, vectors: np.ndarray, home: np.ndarray) -> pa.RecordBatch:
        """Sums of links (b is null) and connecting links (n is 0) between queries and codes."""
        if self.ready is None:
            self.ready = [np.concatenate(c) for c in zip(*self.parts)]
        own_ids, own_n, own_unit, codes, error = self.ready
        unit = _unit(vectors)
        words = self.index.codewords
        parts = _subspaces(unit - self.index.centroids[self.at], words.shape[2])
        left, right = [], []
        for start in range(0, len(ids), QUERIES):
            some = parts[start : start + QUERIES]
            near = np.zeros((len(some), len(codes)))
            for m in range(SUBSPACES):
                near += _squares(some[:, m], words[m])[:, codes[:, m]]
            passed = np.sqrt(near) <= self.reach + error + SLACK
            for i in range(len(some)):
                at = np.flatnonzero(passed[i])
                at = at[own_unit[at] @ unit[start + i] >= self.threshold]
                if home[start + i]:  # pairs inside a list are met from both sides
                    at = at[own_ids[at] > ids[start + i]]
                left.append(np.full(len(at), start + i))
                right.append(at)
        left, right = np.concatenate(left), np.concatenate(right)
        sums = np.zeros(len(ids), np.int64), np.zeros(len(own_ids), np.int64)
        np.add.at(sums[0], left, own_n[right])
        np.add.at(sums[1], right, n[left])
        a, b = connect(ids[left], own_ids[right])
        some, others = np.flatnonzero(sums[0]), np.flatnonzero(sums[1])
        single = len(some) + len(others)
        nulls = pa.nulls(single, pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([ids[some], own_ids[others], a])),
                pa.concat_arrays([nulls, pa.array(b)]),
                pa.array(np.concatenate([sums[0][some], sums[1][others], np.zeros(len(a), np.int64)])),
            ],
            ["a", "b", "n"],
        )


def _found(dealt: DataFrame, index: Index, dimensions: int, threshold: float, reach: float) -> DataFrame:
    by = ["label", "list", "part"]
    sent = send(dealt.sparkSession, index)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, index = None, None, sent()
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in (*by, "kind"))))
            ids, n = batch.column("id").to_numpy(), batch.column("n").to_numpy()
            vectors = _matrix(batch.column("vector"), dimensions)
            ends = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]] + [len(keys)] * bool(keys)
            start = 0
            for end in ends:
                *key, kind = keys[start]
                if key != now:
                    now, held = key, _Codes(index, key[1], threshold, reach)
                part = ids[start:end], n[start:end], vectors[start:end]
                if kind == CODE:
                    held.add(*part)
                elif held.parts:
                    yield held.links(*part, np.full(end - start, kind == HOME))
                start = end

    streams = dealt.repartition(*by).sortWithinPartitions(*by, "kind")
    return streams.mapInArrow(task, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, dimensions: int, threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links and component_id of every row of ``vectors`` (vec_id, embedding, label)."""
    vector = F.col("embedding")
    reach = float(np.sqrt(max(2 - 2 * threshold, 0)))
    rows = vectors.select("vec_id", "label", vector.alias("vector"))
    usual = usable(vector.cast("array<double>"), dimensions)
    ok = vectors.where(usual).where("vec_id IS NOT NULL AND label IS NOT NULL").select("vec_id", "label", vector.alias("vector"))
    with Scratch(vectors.sparkSession) as scratch:
        distinct = scratch.write(
            ok.groupBy("label", "vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"))
        )
        total = distinct.count()
        index = _fitted(distinct, total, dimensions)
        if index is None:
            named = None
        else:
            dealt = _dealt(scratch.write(_listed(distinct, index, dimensions, reach)), scratch)
            found = scratch.write(_found(dealt, index, dimensions, threshold, reach))
            sums = found.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("others"))
            nodes = components(found.where("b IS NOT NULL").select("a", "b"), scratch)
            named = materialise(
                distinct.join(sums, "id", "left")
                .join(nodes, distinct["id"] == nodes["node"], "left")
                .select(
                    "label",
                    "vector",
                    (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
                    F.coalesce("component", "id").alias("component_id"),
                )
            )
    if named is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    linked = rows.join(named, ["label", "vector"], "left")
    known = F.col("vec_id").isNotNull()
    return linked.select(
        "vec_id",
        F.when(known, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        F.when(known, F.coalesce("component_id", "vec_id")).alias("component_id"),
    )


def _fitted(distinct: DataFrame, total: int, dimensions: int) -> Index | None:
    """The index of a sample by hash of the id, or None without vectors."""
    if not total:
        return None
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(min(1.0, 0.9 * SAMPLE / total) * (1 << 30))
    chosen = distinct.where(share).limit(SAMPLE) if total > SAMPLE else distinct
    sample = np.array([r["vector"] for r in chosen.orderBy("id").collect()], np.float64).reshape(-1, dimensions)
    return fit(_unit(sample), int(min(LISTS, -(-total // PER_LIST))))
