"""Documents to training tokens, in five stages.

1. ``language``: documents whose language cannot be told go: texts without letters, and
   those whose most likely language has a score below MIN_SCORE.
2. ``near_duplicates``: of rows whose SimHash fingerprints are linked, one stays: the one
   with the smallest id, of rows that repeat it the one with the least SHA-256 of its text,
   then the least other columns as JSON.
3. ``repeated_passages``: words in passages of 35 words that occur elsewhere go; a
   document of which nothing is left goes. Texts without such passages stay as they are.
4. ``mixing``: each source is taken up to its target; a document stands in the output as
   often as the mix takes it.
5. ``tokens``: byte-level BPE ids of every document, and digests of them and of the
   decoded text.

Each stage takes the documents that the one before has kept. All but the last return the
columns of ``documents``; ``n_chars`` is counted again where a text changes. Null ids
belong to no group and stay. Rows that repeat an id are documents of their own in stage 2,
so unlike texts of one id all stay, and equal rows count once. Null and empty texts have no
letters and go in stage 1; texts are taken whole, however long; other columns, whatever
their names, are kept up to the last stage; an empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paysegments.functions.lineage import materialise
from paysegments.llm import bpe, language_id, mixing, simhash, substring_dedup
from paysegments.llm.text import as_row

# With four languages, guessing has a score of 0.25.
MIN_SCORE = 0.3
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

# The hashes and the library's encoding have no counterpart in SQL; the tests compare
# every stage with a brute-force version.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))))
    found = language_id.predict(docs, model, docs.columns)
    known = (F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= MIN_SCORE)
    return found.where(known).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    others = F.to_json(F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")], F.lit(0).alias("_")))
    key = {"doc_id": F.col("doc_id"), "digest": F.coalesce(F.sha2("text", 256), F.lit("")), "others": others}
    key = [column.alias(name) for name, column in key.items()]
    known = docs.where("doc_id IS NOT NULL")
    found = simhash.groups(known.select(*key, "text"), shingle=3, most=3, carry=["doc_id", "digest", "others"])
    least = found.groupBy("component").agg(F.min(F.struct("doc_id", "digest", "others")).alias("least"))
    # equal rows are merged where they are read, so no key is hot in the join
    rows = known.select(as_row(docs), *key).dropDuplicates(["doc_id", "digest", "others"])
    kept = rows.join(least.select("least.*"), ["doc_id", "digest", "others"], "left_semi").select("row.*")
    return kept.unionByName(docs.where("doc_id IS NULL")).select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    carry = [c for c in docs.columns if c != "text"]
    found = substring_dedup.remove_repeats(docs, carry, tidy=False)
    left = found.where("n_removed = 0 OR n_removed < n_words")
    changed = F.col("n_removed") > 0
    columns = {c: F.col(f"row.`{c}`") for c in carry} | {"text": F.col("kept")}
    if "n_chars" in carry:
        columns["n_chars"] = F.when(changed, F.length("kept")).otherwise(columns["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return left.select(*[columns[c].alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    taken = mixing.mix(docs).where("copies > 0").groupBy(F.col("doc_id").alias("id")).agg(F.max("copies").alias("copies"))
    times = taken.select("id", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("time"))
    return docs.join(times, docs["doc_id"].eqNullSafe(times["id"])).select(*[docs[c] for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = bpe.encode(docs, TOKENIZER, ["doc_id", "source"], decoded=True)
    return found.select(
        "row.doc_id",
        "row.source",
        bpe.n_tokens(F.col("ids")).alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixing", mix),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of the documents in ``sf_dir``; every stage is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
