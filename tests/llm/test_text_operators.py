"""Operators on documents: odd rows, empty tables, and brute force over whole tables."""

from __future__ import annotations

from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

import brute
from paysegments.functions.lineage import Scratch
from paysegments.llm import bpe, components, queries, simhash, substring_dedup, token_counts
from samples import passage

SMALL = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = Tokenizer.from_file(BPE)


def counted(df, *cols) -> Counter:
    return Counter(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture(scope="module")
def small(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]


def texts(df) -> list[tuple]:
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


# --- substring dedup ------------------------------------------------------------


def removed(docs):
    found = substring_dedup.remove_repeats(docs)
    return counted(found.select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256)), "*")


def test_repeats_of_odd_rows(odd):
    assert removed(odd) == brute.substring_dedup(texts(odd))


def test_repeats_of_the_whole_table(spark, small):
    found = queries.op2_substring_dedup(spark, SMALL)
    assert counted(found, "doc_id", "n_words", "n_removed", "kept_sha256") == brute.substring_dedup(small)


def test_repeats_of_an_empty_table(empty):
    assert removed(empty) == Counter()


@pytest.mark.parametrize("size", [1 << 22, 500])
def test_repeats_at_all_offsets_and_with_small_slices(spark, monkeypatch, size):
    """Passages of 34 to 36 words at every distance from each other, few words, many repeats."""
    monkeypatch.setattr(substring_dedup, "SLICE", size)
    draw = np.random.default_rng(1)
    rows = []
    for i in range(60):
        common = passage(i * 100, 34 + i % 3)
        rows.append((2 * i, passage(10_000 + 100 * i, i) + " " + common))
        rows.append((2 * i + 1, common + " " + passage(20_000 + 100 * i, 7)))
    rows += [(1000 + i, " ".join(draw.choice(["x", "y"], 80))) for i in range(20)]
    rows += [(2000, "x " * 500), (2001, "x " * 36), (2002, "x " * 35), (2003, "y " * 35)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert removed(df) == brute.substring_dedup(rows)


def test_cover_has_every_difference():
    found = {(a - b) % substring_dedup.PERIOD for a in substring_dedup.COVER for b in substring_dedup.COVER}
    assert found == set(range(substring_dedup.PERIOD))


def test_untouched_texts_can_stay_as_they_are(odd):
    found = substring_dedup.remove_repeats(odd, ["doc_id", "text"], tidy=False)
    for r in found.collect():
        if not r["n_removed"]:
            assert r["kept"] == r["row"]["text"]


# --- BPE ---------------------------------------------------------------------------


def expected_ids(rows):
    out = Counter()
    for doc, text in rows:
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        out[(doc, bytes(np.array(ids, "<u4").tobytes()), LIBRARY.decode(ids, skip_special_tokens=False))] += 1
    return out


def encoded(docs):
    found = bpe.encode(docs, BPE, decoded=True).collect()
    return Counter((r["row"]["doc_id"], bytes(r["ids"]), r["decoded"]) for r in found)


def test_ids_of_odd_rows(odd):
    assert encoded(odd) == expected_ids(texts(odd))


def test_ids_of_the_whole_table(spark, small):
    exact = {
        (d, len(i) // 4, brute.sha(i), brute.sha(t)): n for (d, i, t), n in expected_ids(small).items()
    }
    found = counted(queries.op3_bpe(spark, SMALL), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert found == Counter(exact)


def test_ids_of_an_empty_table(empty):
    assert encoded(empty) == Counter()


def test_decoding_again(odd):
    found = bpe.decode(bpe.encode(odd, BPE).select("row.doc_id", "ids"), BPE)
    assert counted(found, "row.doc_id", "decoded") == Counter((d, t or "") for d, t in texts(odd))


ENCODER = bpe.Encoder(open(BPE, encoding="utf-8").read())
ANY = st.text(st.sampled_from(" \n\t\r 　 ab'sé日<|endoftext|>.,1\U0001f600"), max_size=400)


@settings(max_examples=150, deadline=None)
@given(ANY, st.integers(1, 6), st.integers(1, 40))
def test_any_cuts_give_the_ids_of_the_library(text, bits, shortest):
    """With cuts nearly everywhere, also inside words and special tokens."""
    before = bpe.CUT_BITS, bpe.SHORTEST
    bpe.CUT_BITS, bpe.SHORTEST = bits, shortest
    try:
        ENCODER.chunks.clear()
        [ids] = ENCODER.encode([text])
    finally:
        bpe.CUT_BITS, bpe.SHORTEST = before
    assert np.frombuffer(ids, "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_chunks_are_shared_wherever_a_passage_stands():
    common = passage(0, 3000).encode()
    chunks = []
    for before in (b"", b"something else first, "):
        data = before + common
        ends = bpe.cuts(data)
        chunks.append({data[s:e] for s, e in zip([0, *ends], ends)})
    assert len(chunks[0] & chunks[1]) > 0.9 * len(chunks[0]) > 10


def test_blocks_of_long_texts_are_cut_alike(monkeypatch):
    data = passage(0, 20_000).encode()
    whole = bpe.cuts(data)
    monkeypatch.setattr(bpe, "BLOCK", 1000)
    assert bpe.cuts(data) == whole


# --- SimHash -----------------------------------------------------------------------


def grouped(docs, **how):
    found = simhash.near_duplicates(docs, **how)
    return counted(found.withColumn("f", simhash.hexadecimal(F.col("fingerprint"))), "doc_id", "f", "component_id")


def test_groups_of_the_whole_table(spark, small):
    found = queries.op5_simhash(spark, SMALL)
    assert counted(found, "doc_id", "fingerprint", "component_id") == brute.simhash(small)


def test_groups_of_odd_rows(odd):
    rows = [r for r in texts(odd) if r[0] is not None]
    assert grouped(odd.where("doc_id IS NOT NULL")) == brute.simhash(rows)
    # of rows without id, one has the fingerprint zero of documents 1 to 3
    found = [r for r in simhash.near_duplicates(odd).collect() if r["doc_id"] is None]
    assert sorted(str(r["component_id"]) for r in found) == ["1", "None"]


def test_groups_of_an_empty_table(empty):
    assert grouped(empty) == Counter()


@pytest.mark.parametrize("block", [2048, 8])
def test_links_are_those_of_all_pairs(spark, monkeypatch, block):
    """Clusters of fingerprints a few bits apart, in cells of any size."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    draw = np.random.default_rng(2)
    values = set()
    for centre in draw.integers(0, 2**64, 40, np.uint64):
        for _ in range(15):
            flips = draw.choice(64, draw.integers(0, 5), replace=False)
            values.add(int(centre) ^ sum(1 << int(b) for b in flips))
    values |= {0, 7, 15, 2**64 - 1}
    listed = np.array(sorted(values), np.uint64)
    signed = listed.view(np.int64).tolist()
    df = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    with Scratch(spark) as scratch:
        nodes = components.components(simhash.links(df, 3, scratch), scratch)
        found = {r["node"]: r["component"] for r in nodes.collect()}
    exact = brute.smallest_reachable(signed, lambda i: np.flatnonzero(np.bitwise_count(listed ^ listed[i]) <= 3))
    assert {v: found.get(v, v) for v in signed} == exact


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(200)]
    hub = [(1000, 1001 + i) for i in range(300)]
    links = spark.createDataFrame([*chain, *hub, (5000, 5000), (7, 6)], "a long, b long")
    with Scratch(spark) as scratch:
        found = {r["node"]: r["component"] for r in components.components(links, scratch).collect()}
    assert found == {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1301)}


# --- token counts -------------------------------------------------------------------


def test_counts_of_the_whole_table_and_of_odd_rows(spark, odd, small):
    starts, continuations = map(set, token_counts.vocabulary(PIECES))

    def exact(rows):
        out = Counter()
        for doc, text in rows:
            found = [brute.word_pieces(w.decode(), starts, continuations) for w in brute.words(text)]
            out[(doc, len(found), sum(n or 1 for n in found), found.count(None))] += 1
        return out

    assert counted(queries.op6_token_counts(spark, SMALL), "*") == exact(small)
    assert counted(token_counts.count_tokens(odd, PIECES), "*") == exact(texts(odd))


def test_counts_of_an_empty_table(empty):
    assert token_counts.count_tokens(empty, PIECES).count() == 0


@settings(max_examples=200, deadline=None)
@given(
    st.sets(st.text("abc", min_size=1, max_size=4), max_size=12),
    st.sets(st.text("abc", min_size=1, max_size=4), max_size=12),
    st.lists(st.text("abcd", min_size=1, max_size=12), max_size=8),
)
def test_automaton_counts_as_the_library_does(starts, continuations, words):
    vocabulary = {"[UNK]": 0}
    for piece in [*sorted(starts), *(f"##{c}" for c in sorted(continuations))]:
        vocabulary.setdefault(piece, len(vocabulary))
    model = models.WordPiece(vocabulary, unk_token="[UNK]", max_input_chars_per_word=1000)
    library = Tokenizer(model)
    library.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    automaton = token_counts.Automaton(starts, continuations)
    for word in words:
        ids = library.encode(word).ids
        assert automaton.count(word) == (None if ids == [0] else len(ids))
