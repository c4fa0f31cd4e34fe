"""Fingerprints of documents by context-triggered piecewise hashing, and their likeness.

A hash over the last WINDOW bytes rolls over a text's UTF-8 bytes. Where its low bits are
all ones a chunk ends, so an edit only changes the chunks that it touches. Every chunk
gives one character, from its checksum. The block size is the power of two at which a
text of its length has about PIECES chunks; a fingerprint holds it and the characters of
the chunks at that size and at twice the size, so two fingerprints can be compared if
their block sizes are equal or one is twice the other.

The likeness of two fingerprints is 1 less the edit distance of their characters at a
common block size, as a part of the longer one's length; the greater where two sizes are
common, and 0 where none is.

No chunk but the last is shorter than a quarter of the block size and none longer than
four block sizes, so a fingerprint has a bounded length and a text without variety still
has chunks. Texts are hashed whole, in parts of BLOCK bytes.

``with_next`` puts each document beside the next one. Documents are sorted by ranges, so
texts cross the network once and a task holds two of them at a time; only the first and
the last document of each partition are handed on to be paired across partitions.

Defined results: a null text is empty; an empty text has a fingerprint without chunks,
which is like itself alone; documents are ordered by id (null first), those with one id by
the hash of their texts, and repeated rows stand beside each other; the last one's next is
the first, and a single document is its own next; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paysegments.functions.lineage import materialise
from paysegments.functions.shipping import ship_by_value

ship_by_value(__name__)

WINDOW = 8
# Chunks that a text has at its block size, on average: this to half of it.
PIECES = 64
BLOCK = 1 << 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_FACTOR = 0x9E3779B1


def block_size(length: int) -> int:
    size = 1
    while size * PIECES < length:
        size *= 2
    return size


def triggers(data: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where chunks could end at a block size and at its multiples, and the hashes there.

    Before its first byte a text counts as zeros.
    """
    places, hashes = [], []
    for block in range(0, len(data), BLOCK):
        last = min(len(data), block + BLOCK)
        piece = np.zeros(last - block + WINDOW - 1, np.uint32)
        known = np.frombuffer(data, np.uint8, last - max(block - WINDOW + 1, 0), max(block - WINDOW + 1, 0))
        piece[-len(known) :] = known
        rolled = piece + np.uint32(1)
        power = _FACTOR
        for width in (1, 2, 4):
            rolled = rolled[:-width] * np.uint32(power) + rolled[width:]
            power = power * power & 0xFFFFFFFF
        rolled ^= rolled >> np.uint32(15)
        rolled *= np.uint32(_FACTOR)
        rolled >>= np.uint32(8)
        at = np.flatnonzero((rolled & np.uint32(size - 1)) == np.uint32(size - 1))
        places.append(at + block + 1)
        hashes.append(rolled[at])
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.uint32)
    return np.concatenate(places), np.concatenate(hashes)


def chunk_ends(places: np.ndarray, hashes: np.ndarray, size: int, length: int) -> list[int]:
    """Ends of the chunks at a block size."""
    ends, last = [], 0
    shortest, longest = max(size // 4, 1), 4 * size
    for place in [*places[(hashes & np.uint32(size - 1)) == np.uint32(size - 1)].tolist(), length]:
        while place - last > longest:
            last += longest
            ends.append(last)
        if place - last >= shortest and place < length:
            last = place
            ends.append(last)
    return [*ends, length] if length > last else ends


def characters(data: bytes, ends: list[int]) -> str:
    view = memoryview(data)
    return "".join(
        [ALPHABET[(zlib.crc32(view[s:e]) * _FACTOR & 0xFFFFFFFF) >> 26] for s, e in zip([0, *ends], ends)]
    )


def fingerprint(data: bytes) -> str:
    """``size:characters:characters`` at the block size and at twice of it."""
    size = block_size(len(data))
    found = triggers(data, size)
    one, two = (characters(data, chunk_ends(*found, s, len(data))) for s in (size, 2 * size))
    return f"{size}:{one}:{two}"


def likeness(a: Column, b: Column) -> Column:
    """How alike two fingerprints are, from 0 to 1."""

    def close(x: Column, y: Column) -> Column:
        longer = F.greatest(F.length(x), F.length(y))
        return F.coalesce(1 - F.try_divide(F.levenshtein(x, y), longer), F.lit(0.0))

    a, b = F.split(a, ":"), F.split(b, ":")
    size_a, size_b = a[0].cast("long"), b[0].cast("long")
    return (
        F.when(F.array_join(a, ":") == F.array_join(b, ":"), F.lit(1.0))
        .when(size_a == size_b, F.greatest(close(a[1], b[1]), close(a[2], b[2])))
        .when(size_a == size_b * 2, close(a[1], b[2]))
        .when(size_a * 2 == size_b, close(a[2], b[1]))
        .otherwise(F.lit(0.0))
    )


# --- documents -----------------------------------------------------------------------


def fingerprints(docs: DataFrame, carry: str = "doc_id") -> DataFrame:
    """The column ``carry`` and the fingerprint of every document."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint((t or "").encode()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, pa.string())], ["key", "fingerprint"])

    read = docs.select(F.col(carry).alias("key"), "text")
    kind = docs.schema[carry].dataType.simpleString()
    found = read.mapInArrow(task, f"key {kind}, fingerprint string")
    return found.withColumnRenamed("key", carry)


# Rows of the pass over neighbours: results, and the ends of a partition.
DONE, FIRST, LAST = 0, 1, 2
RESULTS = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint"]
_SCHEMA = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string"
_TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]


def edited(text: str, following: str, share: int = 4) -> str:
    """``text`` with its last ``len // share`` characters replaced by the first of ``following``."""
    n = len(text) // share
    return text[: len(text) - n] + following[:n]


def _results(text: str, following: str, own: str, next_own: str) -> tuple:
    changed = edited(text, following).encode()
    return len(text), hashlib.sha256(changed).hexdigest(), own, fingerprint(changed), next_own


def _columns(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(_TYPES)]


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of all documents of a sorted partition but the last, and its ends as they are."""
    names = ["key", *RESULTS, "kind", "part", "text"]

    def border(key: pa.Array, kind: int, part: int, text: str) -> pa.RecordBatch:
        more = [pa.array([kind], pa.int32()), pa.array([part], pa.int32()), pa.array([text], pa.string())]
        return pa.RecordBatch.from_arrays([key, *_columns([(None,) * len(RESULTS)]), *more], names)

    held = None  # key, text and fingerprint of the document before, and its partition
    for batch in batches:
        if not len(batch):
            continue
        keys, part = batch.column("key"), batch.column("part")[0].as_py()
        texts = batch.column("text").to_pylist()
        prints = [fingerprint(t.encode()) for t in texts]
        if held is None:
            yield border(keys.slice(0, 1), FIRST, part, texts[0])
        else:
            keys = pa.concat_arrays([held[0], keys])
            texts, prints = [held[1], *texts], [held[2], *prints]
        rows = [_results(*pair, *own) for pair, own in zip(zip(texts, texts[1:]), zip(prints, prints[1:]))]
        n = len(rows)
        none = [pa.array([DONE] * n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())]
        yield pa.RecordBatch.from_arrays([keys.slice(0, n), *_columns(rows), *none], names)
        held = (keys.slice(n, 1), texts[-1], prints[-1], part)
    if held is not None:
        yield border(held[0], LAST, held[3], held[1])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(batch.column("text").to_pylist(), batch.column("following").to_pylist())
        rows = [_results(t, f, fingerprint(t.encode()), fingerprint(f.encode())) for t, f in pairs]
        yield pa.RecordBatch.from_arrays([batch.column("key"), *_columns(rows)], ["key", *RESULTS])


def with_next(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key`` and RESULTS of every document: of itself, of itself edited and of the next one."""
    text = F.coalesce("text", F.lit(""))
    read = docs.select(F.col(key).alias("key"), text.alias("text"), F.xxhash64(text).alias("tie"))
    # copies of a row may be more than a partition holds, so they are told apart by their place
    order = ["key", "tie", "place"]
    laid = (
        read.withColumn("place", F.monotonically_increasing_id())
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("key", "text", F.spark_partition_id().alias("part"))
    )
    kind = f"key {docs.schema[key].dataType.simpleString()}"
    found = materialise(laid.mapInArrow(_neighbours, f"{kind}, {_SCHEMA}, kind int, part int, text string"))
    firsts = found.where(F.col("kind") == FIRST)
    lasts = found.where(F.col("kind") == LAST)
    # one row per partition
    parts = Window.orderBy("part")
    after = firsts.select(
        "part", F.coalesce(F.lead("part").over(parts), F.first("part").over(parts)).alias("next_part")
    )
    heads = firsts.select(F.col("part").alias("next_part"), F.col("text").alias("following"))
    ends = lasts.select("key", "part", "text").join(after, "part").join(heads, "next_part").select("key", "text", "following")
    done = found.where(F.col("kind") == DONE).select("key", *RESULTS)
    return done.unionAll(ends.mapInArrow(_pairs, f"{kind}, {_SCHEMA}")).withColumnRenamed("key", key)
