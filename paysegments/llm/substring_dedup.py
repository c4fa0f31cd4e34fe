"""Removing passages that occur elsewhere, found at difference-cover anchors.

A window of WINDOW words repeats if the same words start anywhere else. Every word that a
repeated window covers is removed. To find repeats without hashing all windows, short
windows (anchors) are hashed only at positions of a difference cover modulo PERIOD: for
any two positions there is an offset below PERIOD at which both are in the cover. So two
equal windows contain equal anchors at the same offset. The steps:

1. Anchors go to one shuffle by hash; an anchor found in two texts, or twice in one, is a
   candidate. Equal anchors of a slice of documents are settled before the shuffle, and
   only one of them represents the slice, so frequent passages do not pile up under one
   key. A slice sends one row for each bucket of hashes, with all its anchors there.
2. Candidates return to their text by their hash. Each is extended to the full windows that contain it,
   and only those are hashed, with 95 bits. Windows found at two places are repeats.
   Again a slice settles its own first.
3. The starts of repeated windows return to their text, whose other words are kept.

Places are positions in distinct texts: copies of a whole text are told from a count, and
their windows are not looked for. The documents are shuffled once, by a hash of the text;
both returns read that one exchange, and a text with very many copies can be split there.
No pairs of places are ever formed.

Defined results: a null or empty text has no words and keeps nothing; a repeated row is a
copy like any other; ids play no part and may be null or repeated; a very long text is one
text, however many windows it has, and may fill a slice of its own; the columns to carry
along come out inside ``row``; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paysegments.functions.shipping import ship_by_value
from paysegments.llm.text import as_bytes, as_row, row_type, small_batches, with_columns

ship_by_value(__name__)

WINDOW = 35
# A perfect difference set: every residue but zero is the difference of exactly one pair.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
# Bytes of text whose anchors and windows are settled together.
SLICE = 1 << 22
# Words whose hashes a task remembers.
REMEMBERED = 200_000
# Buckets of anchors for each partition of a shuffle.
BUCKETS = 8
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MASK = (1 << 64) - 1
COPIED = -1  # in place of a start: the text has copies


class _Words(dict):
    """Hashes of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def window_hashes(words: np.ndarray, length: int, factor: int) -> np.ndarray:
    """A hash of every ``length`` consecutive word hashes, by doubling."""
    part, width, power = _mixed(words ^ np.uint64(factor)), 1, factor
    whole, covered = None, 0
    while True:
        if length & width:
            if whole is None:
                whole = part
            else:  # the hash of `covered` words, followed by `width` more
                n = len(whole) - width
                whole = whole[:n] * np.uint64(power) + part[covered : covered + n]
            covered += width
        if covered == length:
            return _mixed(whole)
        part = part[:-width] * np.uint64(power) + part[width:]
        power = power * power & _MASK
        width *= 2


def _settle(keys: list[np.ndarray], places: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows to send on, which of them stand under their true key, and which are known to repeat.

    Of rows with equal keys and equal places one is left. Of rows with equal keys at
    different places all are known to repeat; one keeps its key to tell other slices.
    Rows stay in the order of their texts, in which they take the least room.
    """
    order = np.lexsort([*reversed(places), *reversed(keys)])
    new_key = np.zeros(len(order), bool)
    new_key[:1] = True
    for key in keys:
        new_key[1:] |= key[order][1:] != key[order][:-1]
    new = new_key.copy()
    for place in places:
        new[1:] |= place[order][1:] != place[order][:-1]
    order, new_key = order[new], new_key[new]
    alone = new_key & np.append(new_key[1:], True)
    back = np.argsort(order)
    return order[back], new_key[back], ~alone[back]


def _hashed(text: bytes, words: _Words) -> np.ndarray:
    split = text.split()
    return np.fromiter(map(words.__getitem__, split), np.uint64, len(split))


def _cover_anchors(hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the cover in a text, and the anchors there."""
    found = window_hashes(hashed, WINDOW - PERIOD + 1, _FACTORS[0])
    at = np.flatnonzero(np.resize(np.isin(np.arange(PERIOD), COVER), len(found)))
    return at, found[at]


def _anchors(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """bucket, known, anchors, texts: the anchors of a slice by bucket, with the texts they are in."""
    words = _Words()

    def send(parts: list[tuple]) -> pa.RecordBatch:
        anchor, text, inner = map(np.concatenate, zip(*parts))
        rows, own, known = _settle([anchor], [text])
        anchor, text, known = anchor[rows], text[rows], known | inner[rows]
        # what is settled goes by its text
        bucket = np.where(own, anchor, _mixed(text.view(np.uint64))) % np.uint64(buckets)
        order = np.lexsort([known, bucket])
        anchor, text, known, bucket = anchor[order], text[order], known[order], bucket[order].astype(np.int32)
        first = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (known[1:] != known[:-1])))
        offsets = pa.array(np.append(first, len(order)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (anchor.view(np.int64), text)]
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket[first]), pa.array(known[first]), *lists], ["bucket", "known", "anchors", "texts"]
        )

    parts, size = [], 0
    for batch in batches:
        for k1, text in zip(batch.column("k1").to_pylist(), batch.column("text")):
            data = as_bytes(text)
            hashed = _hashed(data, words)
            if len(hashed) >= WINDOW:
                found, times = np.unique(_cover_anchors(hashed)[1], return_counts=True)
                parts.append((found, np.full(len(found), k1, np.int64), times > 1))
                size += len(data)
            if size >= SLICE:
                yield send(parts)
                parts, size = [], 0
    if parts:
        yield send(parts)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h1, h2, k1, k2, start, known: hashes of the full windows around candidates."""
    words = _Words()

    def send(parts: list[tuple]) -> pa.RecordBatch:
        h1, h2, k1, k2, start = map(np.concatenate, zip(*parts))
        rows, own, known = _settle([h1, h2], [k1, k2, start])
        h1, h2, k1, k2, start = h1[rows], h2[rows], k1[rows], k2[rows], start[rows]
        key = np.where(own, h1, _mixed(k1.view(np.uint64))).view(np.int64), np.where(own, h2, 0)
        return pa.RecordBatch.from_arrays(
            list(map(pa.array, (*key, k1, k2, start, known))), ["h1", "h2", "k1", "k2", "start", "known"]
        )

    parts, size, seen = [], 0, set()
    for batch in batches:
        k1s, k2s = batch.column("k1").to_pylist(), batch.column("k2").to_pylist()
        texts = batch.column("row").field("text")
        for k1, k2, text, candidates in zip(k1s, k2s, texts, batch.column("anchors")):
            if (k1, k2) in seen:  # another copy
                continue
            seen.add((k1, k2))
            data = as_bytes(text)
            hashed = _hashed(data, words)
            n = len(hashed) - WINDOW + 1
            if n < 1:
                continue
            at, anchors = _cover_anchors(hashed)
            position = at[np.isin(anchors, candidates.values.to_numpy().view(np.uint64))]
            change = np.zeros(n + PERIOD + 1, np.int32)  # starts up to PERIOD - 1 before an anchor
            np.add.at(change, np.maximum(position - PERIOD + 1, 0), 1)
            np.add.at(change, np.minimum(position, n + PERIOD - 1) + 1, -1)
            start = np.flatnonzero(np.cumsum(change[:n]) > 0)
            one, two = (window_hashes(hashed, WINDOW, f)[start] for f in _FACTORS)
            two = (two >> np.uint64(33)).astype(np.int32)
            parts.append((one, two, np.full(len(start), k1, np.int64), np.full(len(start), k2, np.int64), start.astype(np.int32)))
            size += len(data)
            if size >= SLICE:
                yield send(parts)
                parts, size, seen = [], 0, set()
    if parts:
        yield send(parts)


def _removed(n: int, k2: int, repeats: pa.ListScalar) -> np.ndarray:
    """Which of the ``n`` words of a text go."""
    removed = np.zeros(n, bool)
    if repeats.is_valid and n >= WINDOW:
        found = repeats.values
        start = found.field("start").to_numpy()[found.field("k2").to_numpy() == k2]
        if (start == COPIED).any():
            removed[:] = True
        elif len(start):
            change = np.zeros(n + 1, np.int32)
            change[start] = 1
            np.subtract.at(change, start + WINDOW, 1)
            removed = np.cumsum(change)[:n] > 0
    return removed


def _repeats(found: DataFrame, keys: list[str], place: list[str]) -> DataFrame:
    """Rows of ``found`` whose keys stand at two places or are known to."""
    group = Window.partitionBy(*keys)
    at = F.xxhash64(*place)
    twice = F.max("known").over(group) | (F.min(at).over(group) != F.max(at).over(group))
    return found.withColumn("twice", twice).where("twice").drop("known", "twice")


def remove_repeats(docs: DataFrame, carry: Sequence[str] = ("doc_id",), tidy: bool = True) -> DataFrame:
    """``row`` (the columns ``carry`` of ``docs``), n_words, n_removed and kept, the text that is left.

    ``kept`` is the words with single blanks between them. Without ``tidy`` that holds
    only for texts that lose words; the others are kept as they are.
    """
    small_batches(docs.sparkSession)
    text = F.col("text")
    k2 = F.shiftleft(F.crc32(text.cast("binary")), 31).bitwiseOR(F.length(text).cast("long"))
    keyed = docs.select(F.xxhash64(text).alias("k1"), F.coalesce(k2, F.lit(0)).alias("k2"), as_row(docs))
    texts = docs.select(F.xxhash64(text).alias("k1"), "text")
    buckets = BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = texts.mapInArrow(
        lambda batches: _anchors(batches, buckets), "bucket int, known boolean, anchors array<long>, texts array<long>"
    )
    # rows of a bucket meet in one task, and with them all equal anchors
    anchors = sent.repartition("bucket").select("bucket", "known", F.inline(F.arrays_zip("anchors", "texts")))
    found = _repeats(anchors, ["bucket", "anchors"], ["texts"])
    candidates = found.groupBy(F.col("texts").alias("k1")).agg(F.collect_set("anchors").alias("anchors"))
    windows = keyed.join(candidates, "k1").mapInArrow(
        _windows, "h1 long, h2 int, k1 long, k2 long, start int, known boolean"
    )
    starts = _repeats(windows, ["h1", "h2"], ["k1", "k2", "start"]).select("k1", "k2", "start")
    copied = keyed.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1")
    every = starts.unionByName(copied.select("k1", "k2", F.lit(COPIED).alias("start")))
    repeats = every.groupBy("k1").agg(F.collect_set(F.struct("k2", "start")).alias("repeats"))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = batch.column("row"), []
            for k2, text, found in zip(batch.column("k2").to_pylist(), rows.field("text"), batch.column("repeats")):
                data = as_bytes(text)
                words = data.split()
                removed = _removed(len(words), k2, found)
                gone = int(removed.sum())
                left = [words[i] for i in np.flatnonzero(~removed)] if gone else words
                out.append((len(words), gone, b" ".join(left) if gone or tidy else data if text.is_valid else None))
            n_words, n_removed, texts = zip(*out) if out else ((), (), ())
            yield with_columns(
                rows,
                carry,
                n_words=pa.array(n_words, pa.int64()),
                n_removed=pa.array(n_removed, pa.int64()),
                kept=pa.array(texts, pa.binary()).cast(pa.string()),
            )

    schema = f"{row_type(docs, carry)}, n_words long, n_removed long, kept string"
    return keyed.join(repeats, "k1", "left").mapInArrow(kept, schema)
