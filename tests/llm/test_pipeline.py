"""The pipeline's stages against brute force, on odd rows and on a whole table."""

from __future__ import annotations

from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as entry_points
import brute
import corpus_pipeline
from paysegments.functions.lineage import materialise

SMALL = "/root/testdata/sf0.001"


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_registered():
    assert entry_points.queries()["pipeline"] is corpus_pipeline.run
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language", "near_duplicates", "repeated_passages", "mixing", "tokens"
    ]


def check_stages(spark, docs):
    columns = docs.columns
    at = {c: i for i, c in enumerate(columns)}
    before = rows(docs)

    after = materialise(corpus_pipeline.language(spark, docs, SMALL))
    assert after.columns == columns
    left = rows(after)
    assert not left - before
    for r, _ in (before - left).items():
        assert not any(c.isalpha() for c in r[at["text"]] or "")

    docs, before = after, left
    after = materialise(corpus_pipeline.near_duplicates(spark, docs, SMALL))
    left = rows(after)
    known = [r for r in before.elements() if r[at["doc_id"]] is not None]
    groups = {d: c for d, _, c in brute.simhash([(r[at["doc_id"]], r[at["text"]]) for r in known])}
    assert not left - before
    kept = [r[at["doc_id"]] for r in left.elements() if r[at["doc_id"]] is not None]
    assert sorted(kept) == sorted({d for d, c in groups.items() if d == c})
    assert sum(r[at["doc_id"]] is None for r in left.elements()) == sum(r[at["doc_id"]] is None for r in before.elements())

    docs, before = after, left
    after = materialise(corpus_pipeline.repeated_passages(spark, docs, SMALL))
    left = rows(after)
    listed = list(before.elements())
    expected = Counter()
    for r, (n, gone, text) in zip(listed, brute_kept(listed, at)):
        if gone == 0:
            expected[r] += 1
        elif gone < n:
            changed = list(r)
            changed[at["text"]], changed[at["n_chars"]] = text, len(text)
            expected[tuple(changed)] += 1
    assert left == expected

    docs, before = after, left
    after = materialise(corpus_pipeline.mix(spark, docs, SMALL))
    left = rows(after)
    assert after.columns == columns and all(0 < n <= 3 * before[r] for r, n in left.items())

    out = corpus_pipeline.tokens(spark, after, SMALL).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = Counter()
    for r in left.elements():
        ids = library.encode(r[at["text"]] or "", add_special_tokens=False).ids
        expected[(r[at["doc_id"]], r[at["source"]], len(ids), brute.sha(np.array(ids, "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["source"], r["n_tokens"], r["ids_sha256"]) for r in out) == expected


def brute_kept(listed, at):
    """(words, removed words, text that is left) of each row."""
    split = [brute.words(r[at["text"]]) for r in listed]
    starts = Counter(tuple(w[i : i + 35]) for w in split for i in range(len(w) - 34))
    out = []
    for w in split:
        gone = {j for i in range(len(w) - 34) if starts[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def test_odd_rows(spark, odd):
    check_stages(spark, odd)


def test_whole_table(spark):
    check_stages(spark, spark.read.parquet(f"{SMALL}/documents.parquet"))


def test_rows_that_repeat_an_id(spark):
    one, other, third = ("%s " % " ".join(f"{w}{i}" for i in range(60)) for w in ("ab", "cd", "ef"))
    texts = [(1, one, "a"), (1, other, "a"), (1, other, "b"), (1, other, "a"), (2, one, "a"), (2, third, "a"), (3, third, "a"), (3, one, "c")]
    docs = spark.createDataFrame([(i, t, s, 0, 1) for i, t, s in texts], "doc_id long, text string, source string, row int, _ int")
    left = corpus_pipeline.near_duplicates(spark, docs, SMALL)
    assert left.columns == docs.columns
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in left.collect()) == Counter([texts[0], texts[1], texts[5]])


def test_empty_table(spark, empty):
    docs = empty
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        assert docs.count() == 0
        assert name == "tokens" or docs.columns == empty.columns


def test_run(spark):
    found = corpus_pipeline.run(spark, SMALL)
    assert found.count() > 100 and found.where("ids IS NULL").count() == 0
