"""Word-piece token counts by a linear longest-match automaton.

Greedy longest match from the left, as word-piece tokenizers do it: the longest piece that
starts the word, then the longest continuation that starts the rest, and so on; a word
that cannot be split this way is one unknown token. The vocabulary is a trie with two
roots, for starts and for continuations. Every node has a failure link, to where matching
goes on when no child fits, and the number of tokens that are final by then, both worked
out beforehand. A word is then read once, character by character, and the counts on the
links add up to its length in tokens; no piece is ever built.

The vocabulary comes from the pieces of a public model: those that begin with the mark of
a word start are starts, the others are continuations. It has a fixed size, so the
automaton is built on the driver and broadcast. Documents stay where they are; there is no
shuffle. A task remembers the counts of words in a bounded table.

Defined results: a null or empty text has 0 words and tokens; an empty table gives no
rows; equal ids and repeated rows are counted row by row; a very long text is read whole, in the
task that has its row; other columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from paysegments.functions.shipping import ship_by_value
from paysegments.llm.text import as_bytes, send, small_batches

ship_by_value(__name__)

START, CONTINUATION = 0, 1
# Words whose counts a task remembers.
REMEMBERED = 200_000
UNKNOWN = 1 << 40  # added to the count of a word that cannot be split
WORD_START = "▁"


class Automaton:
    """Token counts of words for a vocabulary of starts and continuations."""

    def __init__(self, starts: Iterable[str], continuations: Iterable[str]):
        self.step: dict[int, int] = {}  # node << 21 | character -> node
        self.fail: list[int | None] = [None, None]
        self.popped = [0, 0]
        ends = [False, False]
        children: list[list[tuple[int, int]]] = [[], []]
        for root, pieces in ((START, starts), (CONTINUATION, continuations)):
            for piece in pieces:
                node = root
                for c in map(ord, piece):
                    key = node << 21 | c
                    if key not in self.step:
                        self.step[key] = len(ends)
                        children[node].append((c, len(ends)))
                        children.append([])
                        ends.append(False)
                        self.fail.append(None)
                        self.popped.append(0)
                    node = self.step[key]
                ends[node] = node > CONTINUATION
        waiting = deque([START, CONTINUATION])
        while waiting:  # by depth, so what lies behind a link is known
            node = waiting.popleft()
            for c, child in children[node]:
                waiting.append(child)
                if ends[child]:
                    self.fail[child], self.popped[child] = CONTINUATION, 1
                    continue
                link, popped = self.fail[node], 0
                while link is not None and link << 21 | c not in self.step:
                    popped += self.popped[link]
                    link = self.fail[link]
                if link is not None:
                    self.fail[child] = self.step[link << 21 | c]
                    self.popped[child] = self.popped[node] + popped

    def count(self, word: str) -> int | None:
        """Tokens of a word; None if it cannot be split."""
        step, fail, popped = self.step, self.fail, self.popped
        node, tokens = START, 0
        for c in map(ord, word):
            while (child := step.get(node << 21 | c)) is None:
                tokens += popped[node]
                node = fail[node]
                if node is None:
                    return None
            node = child
        while node != CONTINUATION:
            tokens += popped[node]
            node = fail[node]
            if node is None:
                return None
        return tokens


class _Counts(dict):
    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self.automaton.count(word.decode())
        self[word] = found = UNKNOWN + 1 if n is None else n
        return found


def vocabulary(path: str) -> tuple[list[str], list[str]]:
    """Starts and continuations among the pieces of a sentencepiece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [
        i for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]
    pieces = [model.id_to_piece(i) for i in ids]
    starts = [p[1:] for p in pieces if p.startswith(WORD_START)]
    continuations = [p for p in pieces if not p.startswith(WORD_START)]
    plain = [[p for p in some if p and WORD_START not in p] for some in (starts, continuations)]
    return plain[0], plain[1]


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words, n_tokens and n_unknown of every row of ``docs``."""
    small_batches(docs.sparkSession)
    automaton = send(docs.sparkSession, Automaton(*vocabulary(path)))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_tokens long, n_unknown long"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(automaton())
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                words = as_bytes(text).split()
                total = sum(map(counts.__getitem__, words))
                rows.append((len(words), total % UNKNOWN, total // UNKNOWN))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * 3
            names = ["doc_id", "n_words", "n_tokens", "n_unknown"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names)

    return docs.select("doc_id", "text").mapInArrow(task, schema)
