"""Language identification by sparse multinomial logistic regression.

Features are character n-grams of the lower-cased text, with everything but letters as
single blanks, hashed to FEATURES buckets; values are TF-IDF with 1 + log term counts,
scaled to length one. Document frequencies are counted over all training documents. The
weights are fitted by follow-the-regularised-leader steps with elastic-net penalties,
which leaves most of them exactly zero, and a temperature fitted on rows that were kept
out of the steps makes the scores probabilities.

The fit takes a bounded sample of the labelled rows, at most ``per_language`` of each
language, chosen by a hash of id and text so that reruns agree. Only the n-gram counts of the sample,
the weights and the document frequencies (one number per bucket) reach the driver.
Prediction reads whole texts, block by block, where they are; there is no shuffle.

Defined results: a text that is null or has no letters is ``und`` with score 0, and so is
every text if nothing was learned; ties go to the first language in code point order; rows
without a language or an id are not learned from; equal ids and repeated rows are rows like
others; an empty table gives no rows. The columns to carry along come out inside ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paysegments.functions.shipping import ship_by_value
from paysegments.llm.text import as_row, row_type, send, small_batches, with_columns

ship_by_value(__name__)

BITS = 15
FEATURES = 1 << BITS
LONGEST = 3  # characters of an n-gram
BLOCK = 1 << 20
UNDETERMINED = "und"
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


@dataclass(frozen=True)
class Fit:
    """Parameters of the fit."""

    per_language: int = 750
    passes: int = 3
    rate: float = 0.5
    smoothing: float = 1.0
    l1: float = 0.02
    l2: float = 0.01
    # every so many rows of the sample are for the temperature
    calibration: int = 5


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray  # FEATURES + 1 for the constant, by language
    temperature: float


class Letters:
    """Which code points are letters."""

    def __init__(self):
        self.known = np.zeros(0x110000, bool)
        points = (i for i in range(0x110000) if chr(i).isalpha())
        self.known[np.fromiter(points, np.int64)] = True

    def ngrams(self, text: str) -> np.ndarray | None:
        """Counts of the n-grams by bucket; None without letters."""
        counts, found = np.zeros(FEATURES, np.int64), False
        before, in_word = np.array([32], np.uint32), False  # what n-grams of the next block may begin with
        for start in range(0, len(text), BLOCK):
            piece = text[start : start + BLOCK].lower()
            points = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), "<u4")
            letter = self.known[points]
            found = found or bool(letter.any())
            keep = letter | np.concatenate([[in_word], letter[:-1]])  # one blank after each word
            in_word = bool(letter[-1:].any())
            plain = np.where(letter, points, 32)[keep]
            if start + BLOCK >= len(text):
                plain = np.append(plain, 32)
            line = np.concatenate([before, plain]).astype(np.uint32)
            mixed = np.zeros(len(line), np.uint32)
            for n in range(min(LONGEST, len(line))):  # n-grams of n + 1 characters that end in this block
                mixed = (mixed[: len(line) - n] ^ line[n:]) * _FACTORS[n]
                mixed ^= mixed >> np.uint32(15)
                new = mixed[max(len(before) - n, 0) :] * np.uint32(0x27D4EB2F)
                counts += np.bincount(new >> np.uint32(32 - BITS), minlength=FEATURES)
            before = line[-(LONGEST - 1) :]
        return counts if found else None


def _vector(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a text, with the constant as the last bucket."""
    at = np.flatnonzero(counts)
    values = (1 + np.log(counts[at])) * idf[at]
    length = np.linalg.norm(values)
    return np.append(at, FEATURES), np.append(values / length if length else values, 1.0)


def _softmax(scores: np.ndarray) -> np.ndarray:
    powers = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return powers / powers.sum(axis=-1, keepdims=True)


def _follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], n: int, fit: Fit) -> np.ndarray:
    gradients, squares = np.zeros((FEATURES + 1, n)), np.zeros((FEATURES + 1, n))

    def weights(z: np.ndarray, s: np.ndarray) -> np.ndarray:
        size = np.maximum(np.abs(z) - fit.l1, 0)
        return -np.sign(z) * size / ((fit.smoothing + np.sqrt(s)) / fit.rate + fit.l2)

    for _ in range(fit.passes):
        for at, values, label in rows:
            z, s = gradients[at], squares[at]
            w = weights(z, s)
            error = _softmax(values @ w)
            error[label] -= 1
            step = values[:, None] * error
            more = s + step * step
            gradients[at] = z + step - (np.sqrt(more) - np.sqrt(s)) / fit.rate * w
            squares[at] = more
    return weights(gradients, squares)


def _temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, by golden section on its logarithm.

    As in Platt's scaling the labels count as one more row of each language, or rows
    that are all told apart would ask for certainty.
    """
    n, languages = scores.shape
    wanted = np.full(scores.shape, 1 / (n + languages))
    wanted[np.arange(n), labels] = (n + 1) / (n + languages)

    def loss(log: float) -> float:
        chances = _softmax(scores / np.exp(log))
        return float(-(wanted * np.log(np.maximum(chances, 1e-300))).sum())

    low, high, golden = np.log(0.01), np.log(100.0), (5**0.5 - 1) / 2
    while high - low > 1e-4:
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _counted(texts: Iterator[str | None], letters: Letters) -> Iterator[np.ndarray | None]:
    return (letters.ngrams(t) if t else None for t in texts)


def _document_frequencies(docs: DataFrame) -> np.ndarray:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, total = Letters(), np.zeros(FEATURES + 1, np.int64)
        for batch in batches:
            for counts in _counted(batch.column("text").to_pylist(), letters):
                if counts is not None:
                    total[:FEATURES] += counts > 0
                    total[FEATURES] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["bucket", "n"])

    summed = docs.select("text").mapInArrow(task, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = np.zeros(FEATURES + 1, np.int64)
    for bucket, n in summed.collect():
        found[bucket] = n
    return found


def _sample(docs: DataFrame, per_language: int) -> DataFrame:
    """lang, order and text of at most ``per_language`` rows of each language."""
    order = F.conv(F.substring(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(" "), F.col("text"))), 1, 15), 16, 10)
    ordered = docs.select("lang", order.cast("long").alias("order"), "text")
    # one count per language, of which the model has a column of weights each
    counts = docs.groupBy("lang").agg(F.count("text").alias("n")).collect()
    # by the hash alone, so that no language has to be sorted: a bit more than needed ...
    highest = [min(1.0, (1.5 * per_language + 50) / r["n"]) * (1 << 60) for r in counts]
    limit = F.create_map(*[F.lit(v) for r, h in zip(counts, highest) for v in (r["lang"], h)])
    near = ordered.where(F.col("order") < F.element_at(limit, F.col("lang"))) if counts else ordered
    # ... of which the first are kept
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("order", F.xxhash64("text")))
    return near.withColumn("rank", rank).where(F.col("rank") <= per_language).select("lang", "order", "text")


def train(docs: DataFrame, fit: Fit = Fit()) -> Model:
    """A model from the columns doc_id, text and lang of the labelled rows in ``docs``."""
    small_batches(docs.sparkSession)
    labelled = docs.select("doc_id", "text", "lang").where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    frequencies = _document_frequencies(labelled)
    idf = np.log((1 + frequencies[FEATURES]) / (1 + frequencies[:FEATURES])) + 1

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = Letters()
        for batch in batches:
            kept = [
                (lang, order, np.flatnonzero(c), c[np.flatnonzero(c)])
                for lang, order, c in zip(
                    batch.column("lang").to_pylist(),
                    batch.column("order").to_pylist(),
                    _counted(batch.column("text").to_pylist(), letters),
                )
                if c is not None
            ]
            lang, order, at, n = zip(*kept) if kept else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(lang, pa.string()),
                    pa.array(order, pa.int64()),
                    pa.array([a.astype("<i4").tobytes() for a in at], pa.binary()),
                    pa.array([c.astype("<i4").tobytes() for c in n], pa.binary()),
                ],
                ["lang", "order", "at", "n"],
            )

    sample = _sample(labelled, fit.per_language).mapInArrow(task, "lang string, order long, at binary, n binary")
    rows = sorted(tuple(r) for r in sample.collect())
    languages = tuple(sorted({r[0] for r in rows}, key=lambda lang: lang.encode()))
    if not languages:
        return Model((), idf, np.zeros((FEATURES + 1, 0)), 1.0)
    vectors = []
    for lang, order, at, n in sorted(rows, key=lambda r: (r[1], r[0], bytes(r[2]))):
        counts = np.zeros(FEATURES, np.int64)
        counts[np.frombuffer(at, "<i4")] = np.frombuffer(n, "<i4")
        vectors.append((*_vector(counts, idf), languages.index(lang)))
    kept_out = vectors[:: fit.calibration] if len(vectors) >= 2 * fit.calibration else vectors
    learned = [v for i, v in enumerate(vectors) if i % fit.calibration] or vectors
    weights = _follow_the_leader(learned, len(languages), fit)
    scores = np.array([values @ weights[at] for at, values, _ in kept_out])
    temperature = _temperature(scores, np.array([label for *_, label in kept_out]))
    return Model(languages, idf, weights, temperature)


def predict(docs: DataFrame, model: Model, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``row`` (the columns ``carry`` of ``docs``), lang_pred and score (0 to 1)."""
    small_batches(docs.sparkSession)
    sent = send(docs.sparkSession, model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, model = Letters(), sent()
        for batch in batches:
            rows, found = batch.column("row"), []
            for counts in _counted(rows.field("text").to_pylist(), letters):
                if counts is None or not model.languages:
                    found.append((UNDETERMINED, 0.0))
                    continue
                at, values = _vector(counts, model.idf)
                chances = _softmax(values @ model.weights[at] / model.temperature)
                best = int(chances.argmax())
                found.append((model.languages[best], min(float(chances[best]), 1.0)))
            lang, score = zip(*found) if found else ((), ())
            yield with_columns(
                rows, carry, lang_pred=pa.array(lang, pa.string()), score=pa.array(score, pa.float64())
            )

    schema = f"{row_type(docs, carry)}, lang_pred string, score double"
    return docs.select(as_row(docs)).mapInArrow(task, schema)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of all learning: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
