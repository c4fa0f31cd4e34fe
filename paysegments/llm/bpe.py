"""Byte-level BPE encoding with content-defined chunk reuse, and decoding.

A rolling hash over 16 bytes cuts a text into chunks, so documents that share a passage
share the chunks inside it wherever the passage stands. A task encodes each chunk once.
Cuts fall anywhere, also inside words and special tokens, so chunk joins are repaired:
the text from the last safe boundary of one chunk to the first of the next is encoded
again as one window, which grows over further chunks until both of its ends are safe. A
boundary is safe where a visible character is followed by one blank or line feed and
another visible character. The tokenizer's pattern splits there in any context, so the
encodings of both sides agree with that of the whole text, and the repaired ids are
exactly those of the library.

Inside a chunk the pieces between safe boundaries are looked up as well, so the library
only sees pieces that are new to the task, many of them as one text. The caches hold a
bounded number of entries and start anew when full; that changes the time, not the result. Reuse stays inside a
task on purpose: sharing chunks through a shuffle would move the texts and ids of the
whole corpus, which is more than the encoding that it saves.

Defined results: a null text is empty and has no ids; equal ids and repeated rows are
encoded row by row; the columns to carry along come out inside ``row``; an empty table gives
no rows; very long texts are hashed block by block.
"""

from __future__ import annotations

import re
import sys
import types
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from paysegments.functions.shipping import ship_by_value
from paysegments.llm.text import as_bytes, as_row, row_type, small_batches, with_columns

ship_by_value(__name__)

# Cut where the upper bits of the hash are zero: every 512 bytes on average.
CUT_BITS = 9
# No chunk is shorter, whatever the hash says.
SHORTEST = 64
BLOCK = 1 << 20
# Entries of a task's caches at which they start anew.
PIECES, CHUNKS = 200_000, 10_000
# Pieces that are encoded as one text.
TOGETHER = 4096
# Bytes of text that a task works on at a time.
SLICE = 1 << 20

SAFE = re.compile(r"(?<=\S)(?=[ \n]\S)")
# A piece with a safe boundary before it, and after it if another such piece follows.
LINE = re.compile(r"[ \n]\S(?:.*\S)?", re.DOTALL)
_FACTOR = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def cuts(data: bytes) -> list[int]:
    """Where chunks end: content-defined places at the start of a character, and the end."""
    ends = []
    for block in range(0, len(data), BLOCK):
        first = max(block - 15, 0)
        piece = np.frombuffer(data, np.uint8, min(len(data), block + BLOCK) - first, first)
        if len(piece) < 16:
            continue
        hashed = (piece.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        power = _FACTOR
        for width in (1, 2, 4, 8):
            hashed = hashed[:-width] * np.uint64(power) + hashed[width:]
            power = power * power & _MASK
        hashed ^= hashed >> np.uint64(32)
        hashed *= np.uint64(_FACTOR)
        ends.append(np.flatnonzero(hashed < np.uint64(1 << (64 - CUT_BITS))) + first + 16)
    found = np.concatenate(ends) if ends else np.empty(0, np.int64)
    found = found[found < len(data)]
    if len(found):
        found = found[(np.frombuffer(data, np.uint8)[found] & 0xC0) != 0x80]
    chosen, last = [], 0
    i = 0
    while i < len(found):
        i = int(np.searchsorted(found, last + SHORTEST)) if found[i] < last + SHORTEST else i
        if i < len(found):
            last = int(found[i])
            chosen.append(last)
            i += 1
    return [*chosen, len(data)] if data else []


class Encoder:
    """Encodes texts to ids (little-endian unsigned 32-bit), reusing chunks and pieces."""

    def __init__(self, tokenizer: str):
        self.library = Tokenizer.from_str(tokenizer)
        self.library.no_truncation()
        self.library.no_padding()
        self.of = token_bytes(self.library)
        self.lengths = np.array([len(b) for b in self.of])
        # pieces in use, and those of the time before, of which the ones still in use move over
        self.pieces: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        # a chunk: its text up to the first safe boundary, the ids of what lies between the
        # first and the last, and the rest; without a boundary the first is all of it
        self.chunks: dict[bytes, tuple[str, bytes | None, str]] = {}

    def _learn(self, lists: Iterable[list[str]]) -> None:
        new = set().union(*lists) - self.pieces.keys()
        again = new & self.before.keys()
        self.pieces.update((p, self.before[p]) for p in again)
        new -= again
        lines = [p for p in new if LINE.fullmatch(p)]
        for start in range(0, len(lines), TOGETHER):
            new.difference_update(self._learn_lines(lines[start : start + TOGETHER]))
        rest = list(new)
        for piece, encoded in zip(rest, self.library.encode_batch_fast(rest, add_special_tokens=False)):
            self.pieces[piece] = np.array(encoded.ids, "<u4").tobytes()

    def _learn_lines(self, lines: list[str]) -> list[str]:
        """Encode pieces as one text, as long as its tokens end where the pieces do."""
        # without offsets, which plain encode() works out as well
        ids = np.array(self.library.encode_batch_fast(["".join(lines)], add_special_tokens=False)[0].ids, "<u4")
        reached = np.cumsum(self.lengths[ids])
        ends = np.cumsum([len(p.encode()) for p in lines])
        at = np.searchsorted(reached, ends)
        if at[-1] >= len(ids) or (reached[at] != ends).any():
            return []
        data = ids.tobytes()
        last = (4 * (at + 1)).tolist()
        self.pieces.update(zip(lines, [data[s:e] for s, e in zip([0, *last], last)]))
        return lines

    def _ids(self, pieces: Iterable[str]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, pieces))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.pieces) > PIECES:
            self.pieces, self.before = {}, self.pieces
        if len(self.chunks) > CHUNKS:
            self.chunks.clear()
        cut = []
        for text in texts:
            data = text.encode()
            ends = cuts(data)
            cut.append([data[s:e] for s, e in zip([0, *ends], ends)])
        split = {c: SAFE.split(c.decode()) for chunks in cut for c in chunks if c not in self.chunks}
        self._learn(pieces[1:-1] for pieces in split.values())
        for chunk, pieces in split.items():
            between = self._ids(pieces[1:-1]) if len(pieces) > 1 else None
            self.chunks[chunk] = (pieces[0], between, pieces[-1] if len(pieces) > 1 else "")
        walked = [self._walk(chunks) for chunks in cut]
        self._learn(step for steps in walked for step in steps if isinstance(step, list))
        return [b"".join(self._ids(s) if isinstance(s, list) else s for s in steps) for steps in walked]

    def _walk(self, chunks: list[bytes]) -> list[list[str] | bytes]:
        """Ids of chunks, and between them the windows over their joins as pieces."""
        steps: list[list[str] | bytes] = []
        window = ""
        for chunk in chunks:
            head, between, tail = self.chunks[chunk]
            window += head
            if between is not None:
                steps += [SAFE.split(window), between]
                window = tail
        if window:
            steps.append(SAFE.split(window))
        return [s for s in steps if s and s != [""]]


def kept_encoder(tokenizer: str) -> Encoder:
    """The encoder of this worker process, made once: tasks that follow find pieces and chunks known.

    Task code arrives anew with every task, so the encoder is kept by the interpreter.
    """
    name = "_kept_bpe_encoder"
    place = sys.modules.setdefault(name, types.ModuleType(name)).__dict__
    if place.get("tokenizer") != tokenizer:
        place["tokenizer"], place["encoder"] = tokenizer, Encoder(tokenizer)
    return place["encoder"]


def token_bytes(library: Tokenizer) -> list[bytes]:
    """The bytes of every id. In the vocabulary each byte is a visible character."""
    visible = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(visible)]
    byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
    found = [b""] * library.get_vocab_size(with_added_tokens=True)
    for token, i in library.get_vocab(with_added_tokens=True).items():
        known = all(c in byte for c in token)
        found[i] = bytes(byte[c] for c in token) if known else token.encode()
    return found


def decode_ids(ids: bytes, of: list[bytes]) -> str:
    return b"".join(map(of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def _slices(batch: pa.RecordBatch) -> Iterator[pa.StructArray]:
    """Parts of a batch with about SLICE bytes of text each."""
    rows = batch.column("row")
    start = total = 0
    for i, text in enumerate(rows.field("text")):
        total += len(as_bytes(text))
        if total >= SLICE:
            yield rows.slice(start, i + 1 - start)
            start, total = i + 1, 0
    if start < len(rows):
        yield rows.slice(start)


def tokenizer_text(path: str) -> str:
    """The tokenizer file, a vocabulary of fixed size, as it is sent to the tasks."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode(docs: DataFrame, path: str, carry: Sequence[str] = ("doc_id",), decoded: bool = False) -> DataFrame:
    """``row`` (the columns ``carry`` of ``docs``), ``ids`` (binary) and on demand ``decoded`` from them."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer_text(path))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or kept_encoder(sent.value)
            for rows in _slices(batch):
                ids = encoder.encode([t or "" for t in rows.field("text").to_pylist()])
                more = {"decoded": pa.array([decode_ids(i, encoder.of) for i in ids], pa.string())} if decoded else {}
                yield with_columns(rows, carry, ids=pa.array(ids, pa.binary()), **more)

    schema = f"{row_type(docs, carry)}, ids binary" + ", decoded string" * decoded
    return docs.select(as_row(docs)).mapInArrow(task, schema)


def decode(encoded: DataFrame, path: str, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``row`` (the columns ``carry``) and ``decoded`` for a column ``ids`` (binary; null: empty)."""
    small_batches(encoded.sparkSession)
    sent = encoded.sparkSession.sparkContext.broadcast(tokenizer_text(path))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = None
        for batch in batches:
            of = of or kept_encoder(sent.value).of
            rows = batch.column("row")
            texts = [decode_ids(i or b"", of) for i in rows.field("ids").to_pylist()]
            yield with_columns(rows, carry, decoded=pa.array(texts, pa.string()))

    schema = f"{row_type(encoded, carry)}, decoded string"
    return encoded.select(as_row(encoded)).mapInArrow(task, schema)


def n_tokens(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")
