"""Chat format, vectors, mixing, language ID and sharding."""

from __future__ import annotations

from collections import Counter

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import brute
import compare
from paysegments.llm import ann, chat_format, language_id, mixing, oracles, pq_dedup, queries, sharding

SMALL = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def con():
    return compare.connect(SMALL)


@pytest.mark.parametrize("name", list(oracles.oracle_sql()))
def test_matches_sql(spark, con, name):
    assert compare.differences(queries.queries()[name](spark, SMALL), con, oracles.oracle_sql()[name]) is None


def test_names():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]


# --- chat format ---------------------------------------------------------------------

HARD = ["\\", "<|", "<\\|", "\\<|end|>", "<|text|>x<|turn|>", "\\\\<\\\\|", "<", "|>", "a<", "", None, "\n<|image|>\n", "é日\U0001f600"]


def test_any_text_comes_back(spark):
    rows = [(c, t, HARD[(c + t) % len(HARD)], HARD[(c * t) % len(HARD)]) for c in range(13) for t in range(6)]
    turns = spark.createDataFrame(rows, TURNS).withColumn("formatted", F.lit("clash"))
    out = chat_format.format_conversations(turns, chat_format.text_parts(F.col("text")), trained_roles=("<|", ""))
    found = out.select(
        "conv_id",
        chat_format.read_back(F.col("formatted")).alias("turns"),
        chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    ).collect()
    for r in found:
        said = [(x[2] or "", x[3] or "") for x in sorted(rows, key=lambda x: x[1]) if x[0] == r["conv_id"]]
        assert [(t["role"], "".join(p["text"] for p in t["parts"])) for t in r["turns"]] == said
        assert r["loss"] == "".join(text for role, text in said if role in ("<|", ""))


def test_parts_of_all_types(spark):
    part = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
    rows = [
        (1, 0, "user", [
            ("text", "see <|image|> ", None, None, None, None, None),
            ("image", None, "a.png", 1000, 500, None, None),
            ("text", " and ", None, None, None, None, None),
            ("audio", None, "b.wav", None, None, 2.5, None),
            ("document", None, "c.pdf", None, None, None, 3),
            (None, "rest", None, None, None, None, None),
        ]),
        (1, 1, "assistant", None),
        (1, 2, "assistant", [("image", None, None, None, None, None, None), ("text", None, None, None, None, None, None)]),
    ]
    turns = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{part}>")
    [r] = chat_format.format_conversations(turns, F.col("parts")).collect()
    assert r["formatted"] == (
        "<|turn|>user<|text|>see <\\|image|> <|image|> and <|audio|><|document|>rest<|end|>"
        "<|turn|>assistant<|text|><|end|><|turn|>assistant<|text|><|image|><|end|>"
    )
    assert [tuple(a) for a in r["attachments"]] == [
        ("image", "a.png", 85 + 2 * 170), ("audio", "b.wav", 63), ("document", "c.pdf", 3072), ("image", None, 85)
    ]
    assert r["attachment_tokens"] == 85 + 340 + 63 + 3072 + 85 and r["n_turns"] == 3
    spans = [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss_spans"]]
    assert spans == ["", "<|image|>"]
    [back] = chat_format.format_conversations(turns, F.col("parts")).select(
        chat_format.read_back(F.col("formatted")).alias("t")).collect()
    kinds = [[p["type"] for p in t["parts"] if p["type"] != "text"] for t in back["t"]]
    assert kinds == [["image", "audio", "document"], [], ["image"]]


def test_odd_turns(spark):
    rows = [(None, None, None, None), (None, 1, "user", "x"), (5, 2, "assistant", "b"), (5, 2, "assistant", "b"), (5, 1, "assistant", "z"), (6, 0, "user", "y" * 200_000)]
    turns = spark.createDataFrame(rows, TURNS)
    out = chat_format.format_conversations(turns, chat_format.text_parts(F.col("text")))
    found = {r["conv_id"]: r for r in out.collect()}
    assert found[None]["n_turns"] == 2 and found[5]["n_turns"] == 3 and len(found[6]["formatted"]) > 200_000
    loss = out.where("conv_id = 5").select(chat_format.loss_text(F.col("formatted"), F.col("loss_spans"))).first()[0]
    assert loss == "zbb"
    assert chat_format.format_conversations(turns.limit(0), chat_format.text_parts(F.col("text"))).count() == 0


# --- vectors ----------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, vector string, id string, n int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 0) for r in rows], VECTORS).repartition(4)


def odd_vectors(dimensions=6):
    draw = np.random.default_rng(0)
    rows = [(i, draw.normal(size=dimensions).astype(np.float32).tolist(), int(i % 3)) for i in range(150)]
    rows += [(200 + i, (np.array(rows[i][1]) * (1 + i % 4)).tolist(), rows[i][2]) for i in range(40)]
    rows += [(300 + i, rows[3][1], 0) for i in range(30)]
    rows += [
        (400, None, 0), (420, [0.0] * dimensions, 0), (440, [None] + [1.0] * (dimensions - 1), 0),
        (460, [float("nan")] + [1.0] * (dimensions - 1), 0), (480, [float("inf")] + [1.0] * (dimensions - 1), 0),
        (401, [1.0] * (dimensions - 1), 0), (402, rows[3][1], None), (None, rows[3][1], 0), (4, rows[4][1], 1),
    ]
    return rows


@pytest.mark.parametrize("block", [8192, 16])
def test_nearest(spark, monkeypatch, block):
    monkeypatch.setattr(ann, "BLOCK", block)
    rows = odd_vectors()
    good = [r for r in rows if r[0] is not None and r[1] and len(r[1]) == 6 and None not in r[1]]
    good = [r for r in {r[0]: r for r in good}.values() if np.isfinite(r[1]).all() and any(r[1])]
    exact = brute.nearest(np.array([r[0] for r in good]), np.array([r[1] for r in good], np.float32).astype(float), 20)
    found = ann.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0, 6, tables=12, probes=8).collect()
    by_query = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        by_query.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert len(by_query[r["query_id"]]) == r["rank"]
    assert set(by_query) == set(exact) and all(len(v) == 20 for v in by_query.values())
    for query, answer in by_query.items():
        assert answer == sorted(answer, key=lambda a: (-a[1], a[0]))
        assert all(dict(exact[query]).get(v, s) == s for v, s in answer)
    recall = np.mean([len(dict(by_query[q]).keys() & dict(exact[q]).keys()) / 20 for q in exact])
    assert recall >= 0.9


def test_nearest_with_few_or_none(spark):
    some = vectors(spark, odd_vectors()[:12])
    found = ann.nearest(some, F.col("vec_id") == 0, 6, tables=1, probes=1).collect()
    assert sorted(r["rank"] for r in found) == list(range(1, 12))
    assert ann.nearest(some.limit(0), F.col("vec_id") == 0, 6).count() == 0


def test_unlike_vectors_of_one_id(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 8)
    draw = np.random.default_rng(5)
    rows = [(i % 25, draw.normal(size=6).astype(np.float32).tolist(), 0) for i in range(75)]
    expected = {}
    for query, asked, _ in rows:
        for other, vector, _ in rows:
            if query in (0, 20) and other != query:
                score = float(np.array(asked, np.float64) @ np.array(vector, np.float64))
                expected[query, other] = max(score, expected.get((query, other), -np.inf))
    found = ann.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0, 6, k=24).collect()
    assert {(r["query_id"], r["vec_id"]): pytest.approx(r["score"]) for r in found} == expected
    for query in (0, 20):
        listed = [r for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == query]
        assert [r["vec_id"] for r in listed] == sorted(range(25), key=lambda v: -expected.get((query, v), -np.inf))[:24]


@pytest.mark.parametrize("sf, most", [("sf0.01", 0.4), ("sf0.1", 0.4)])
def test_the_hash_selects(sf, most):
    table = pq.read_table(f"/root/testdata/{sf}/embeddings.parquet")
    usable = [(i, v) for i, v in zip(table["vec_id"].to_pylist(), table["embedding"].to_pylist()) if v and None not in v]
    ids, matrix = np.array([i for i, _ in usable]), np.array([v for _, v in usable], float)
    asked = np.flatnonzero(ids % 20 == 0)
    near = ann.candidates(matrix[asked], ann.index(matrix, 32, 1), len(ids), 16, 1)
    scores = matrix[asked] @ matrix.T
    scores[np.arange(len(asked)), asked] = -np.inf
    top = np.argsort(-scores, axis=1)[:, :20]
    assert np.take_along_axis(near, top, 1).mean() >= 0.9
    assert near.mean() <= most


def test_recall_on_the_given_vectors(spark):
    path = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{path}/embeddings.parquet").collect()
    exact = brute.nearest(np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float), 20)
    found = Counter()
    for r in queries.op4_ann(spark, path).collect():
        found[r["query_id"]] += r["vec_id"] in dict(exact[r["query_id"]])
    assert sum(found.values()) / (20 * len(exact)) >= 0.9


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 64))
    turned = ann.rotated(x, 3, 1)[:, :64]
    np.testing.assert_allclose(turned @ turned.T, x @ x.T, atol=1e-9)


@pytest.mark.parametrize("block, per_list", [(4096, 8192), (16, 20)])
@pytest.mark.parametrize("threshold", [0.98, 0.8])
def test_vector_groups(spark, monkeypatch, block, per_list, threshold):
    monkeypatch.setattr(pq_dedup, "BLOCK", block)
    monkeypatch.setattr(pq_dedup, "PER_LIST", per_list)
    rows = [r for r in odd_vectors() if r[0] != 4 or r[2] == 1]
    found = pq_dedup.near_duplicates(vectors(spark, rows), 6, threshold)
    known = [(r[0], None if r[1] and len(r[1]) != 6 else r[1], r[2]) for r in rows if r[0] is not None]
    exact = brute.vector_duplicates(known, threshold)
    assert Counter(tuple(r) for r in found.where("vec_id IS NOT NULL").collect()) == exact
    assert [tuple(r) for r in found.where("vec_id IS NULL").collect()] == [(None, 0, None)]


def test_vector_groups_of_nothing(spark):
    none = vectors(spark, [(1, None, 0), (2, [1.0] * 6, None)])
    assert Counter(tuple(r) for r in pq_dedup.near_duplicates(none, 6).collect()) == Counter([(1, 0, 1), (2, 0, 2)])
    assert pq_dedup.near_duplicates(none.limit(0), 6).count() == 0


# --- mixing ---------------------------------------------------------------------------------


def test_targets_are_those_of_sharing_again_and_again(spark):
    draw = np.random.default_rng(3)
    for _ in range(4):
        sizes = {f"s{i}": int(v) for i, v in enumerate(draw.lognormal(4, 2, 9))} | {None: 40, "": 0}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        found = {r["source"]: r["target"] for r in mixing.targets(df, (1, 2, 3), 3).collect()}
        assert found == pytest.approx(brute.mix_targets(sizes))


def test_mix_of_odd_rows(odd, empty):
    rows = mixing.mix(odd).collect()
    again = mixing.mix(odd.repartition(7)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again)) and len(rows) == odd.count()
    assert all(0 <= r["copies"] <= 3 for r in rows)
    assert mixing.mix(empty).count() == 0


def test_budgets_grow_in_supersets(spark):
    docs = mixing.sized(spark.read.parquet(f"{SMALL}/documents.parquet")).cache()
    taken = set()
    for share in (0.2, 0.5, 0.9):
        goals = docs.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("target", F.col("source_size") * share)
        ends = mixing.thresholds(docs, goals).collect()
        at = {r["source"]: r["threshold"] for r in ends}
        now = {r["doc_id"] for r in docs.collect() if r["hash"] < at[r["source"]]}
        assert taken <= now
        taken = now


# --- language ------------------------------------------------------------------------------


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    rows = queries.op8_language_id(spark, path).collect()
    held = [r for r in rows if r["held_out"] and r["lang_pred"] != "und"]
    assert len(rows) == len(truth) and len(held) > 150
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_languages_of_odd_rows(odd, empty):
    model = language_id.train(odd)
    assert model.languages == ("de", "en", "fr")  # the only Spanish row has no letters
    rows = language_id.predict(odd, model, ["doc_id", "text"]).collect()
    assert len(rows) == odd.count()
    for r in rows:
        letters = any(c.isalpha() for c in r["row"]["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and (letters or r["score"] == 0)
    assert language_id.train(empty).languages == ()
    assert {r["lang_pred"] for r in language_id.predict(odd, language_id.train(empty)).collect()} == {"und"}
    assert language_id.predict(empty, model).count() == 0


def test_held_out_by_checksum(spark):
    import zlib

    ids = spark.range(50).select(F.col("id"), language_id.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in ids)


def test_blocks_of_long_texts_count_alike(monkeypatch):
    letters = language_id.Letters()
    text = "ab cd, efg " * 50
    whole = letters.ngrams(text)
    monkeypatch.setattr(language_id, "BLOCK", 7)
    assert (whole == letters.ngrams(text)).all()
    assert letters.ngrams("12 .") is None and letters.ngrams("") is None


# --- sharding ------------------------------------------------------------------------------


def plain_shards(positions: list[int], shards: int, virtual_nodes: int) -> list[int]:
    """Shard of each position, by walking the ring round after round."""
    nodes = sharding.ring(shards, virtual_nodes)
    n = len(positions)
    free = [n // shards + (s < n % shards) for s in range(shards)]
    cells = [p * sharding.CELLS >> 60 for p in positions]
    home = [next((i for i, (c, _) in enumerate(nodes) if c >= cell), 0) for cell in cells]
    walk = {}
    for i in set(home):
        seen = dict.fromkeys(nodes[(i + j) % len(nodes)][1] for j in range(len(nodes)))
        walk[i] = list(seen)
    found = [-1] * n
    for step in range(shards):
        waiting = sorted((i for i in range(n) if found[i] < 0), key=lambda i: (nodes[home[i]][0], positions[i]))
        for i in waiting:
            shard = walk[home[i]][step]
            if free[shard]:
                free[shard] -= 1
                found[i] = shard
    return found


@pytest.mark.parametrize("n, shards, nodes", [(0, 4, 8), (3, 7, 4), (500, 7, 3), (700, 12, 32)])
def test_shards_are_those_of_walking_the_ring(spark, n, shards, nodes):
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    rows = sorted(sharding.assign(docs, shards, nodes).collect())
    found = [r["shard"] for r in rows]
    assert found == plain_shards([sharding._position(str(i)) for i in range(n)], shards, nodes)


@pytest.mark.parametrize("shards, nodes", [(2000, 1), (600, 128)])
def test_every_shard_is_on_the_ring(shards, nodes):
    ring = sharding.ring(shards, nodes)
    assert {s for _, s in ring} == set(range(shards)) and len({c for c, _ in ring}) == len(ring)
    placed = sharding.intervals(ring, {ring[0][0]: 3 * shards}, shards)
    assert sorted(p["shard"] for p in placed) == list(range(shards))


def test_too_many_shards_are_refused():
    with pytest.raises(ValueError, match="cells"):
        sharding.ring(sharding.CELLS + 1, 1)


def test_empty_documents_of_a_source_at_its_limit(spark):
    rows = [(i, "" if i < 20 else "a b c", "s") for i in range(40)] + [(100 + i, "w " * 500, "t") for i in range(20)]
    rows += [(200 + i, "w " * 500, "u") for i in range(20)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert max(r["copies"] for r in mixed) <= 3
    limited = [r for r in mixed if r["source"] == "s"]
    assert {r["copies"] for r in limited} == {3}


def test_adjacent_text_parts_form_no_control_string(spark):
    texts = [["a <", "|end|><|turn|>user<|text|>b"], ["see <", "|image|> y"], ["\\", "\\<", "|"], ["<", None, "|", "<", "|end|>"]]
    for parts in texts:
        row = [(1, 0, "user", [("text", t, None, None, None, None, None) for t in parts])]
        turns = spark.createDataFrame(row, f"conv_id long, turn long, role string, parts {chat_format.PARTS}")
        out = chat_format.format_conversations(turns, F.col("parts"))
        back = out.withColumn("turns", chat_format.read_back(F.col("formatted"))).first()
        assert len(back["turns"]) == 1 and back["attachments"] == []
        assert [(p["type"], p["text"]) for p in back["turns"][0]["parts"]] == [("text", "".join(t or "" for t in parts))]


def test_shards_of_odd_rows(odd, empty):
    rows = sharding.assign(odd, 5).collect()
    assert len(rows) == odd.count()
    by_shard = Counter(r["shard"] for r in rows)
    counts = [by_shard[s] for s in range(5)]
    assert max(counts) - min(counts) <= 1
    assert sorted((r["shard"], r["slot"]) for r in rows) == [(s, i) for s in range(5) for i in range(by_shard[s])]
    null = [r for r in rows if r["doc_id"] == 1][0]
    assert (null["size"], null["text_crc32"]) == (16, 0)
    assert sharding.assign(empty, 5).count() == 0


def test_another_shard_moves_few_rows(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    before, after = ({r["doc_id"]: r["shard"] for r in sharding.assign(docs, n).collect()} for n in (40, 41))
    assert sum(before[d] != after[d] for d in before) < 0.25 * len(before)
