"""The corpus pipeline: quality, near duplicates, secrets, source mix, tokens.

Each stage takes the documents (doc_id, text, lang, source, n_chars) that its predecessor kept. Ids may
be null or repeated: stages follow rows by a hash of all their columns. The mix repeats a document's row as
often as it takes it. The last stage returns token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleet_health.llm import bpe, jaccard, mixing, quality, secrets
from fleet_health.session import cut_lineage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def with_key(docs: DataFrame) -> DataFrame:
    """`docs` with `_row`, which only rows that are equal in all columns share."""
    return docs.withColumn("_row", F.xxhash64(*[x for c in COLUMNS for x in (F.col(c), F.col(c).isNull())]))


def keep_good(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    docs = with_key(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    trusted = cut_lineage(docs.select("doc_id", "_row").join(labels, "doc_id", "left_semi").select("_row"))
    good = quality.judge(docs, trusted, key="_row").where("keep").select(F.col("doc_id").alias("_row"))
    return docs.join(good.distinct(), "_row", "left_semi").select(COLUMNS)


def keep_different(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id (null: last) of each group of near duplicates, once."""
    docs = with_key(docs)
    linked = jaccard.link(docs, key="_row").select(F.col("doc_id").alias("_row"), "component_id").distinct()
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("least")
    first = docs.select("doc_id", "_row").join(linked, "_row").groupBy("component_id").agg(least)
    return (docs.join(first.select("least._row"), "_row", "left_semi").dropDuplicates(["_row"])
            .select(COLUMNS))


def mask_secrets(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked."""
    found = secrets.scan(docs, secrets.train(docs))
    clean = found.withColumn("text", secrets.masked(F.col("text"), F.col("spans")))
    return clean.withColumn("n_chars", F.length("text").cast("bigint")).select(COLUMNS)


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    mixed, _ = mixing.mix(docs)
    times = F.explode(F.array_repeat(F.lit(0), F.col("mix_copies").cast("int")))
    return mixed.select(*COLUMNS, times.alias("_copy")).drop("_copy")


def tokenize(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (packed), their number, and a digest of the ids and of what they decode to."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    made = bpe.round_trip(docs, ranks, public_tokenizers.PATTERN, keys=["doc_id", "lang", "source"])
    return made.select("doc_id", "lang", "source", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.col("ids").alias("token_ids"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality classifier", keep_good), ("n-gram Jaccard join", keep_different),
          ("secret scans", mask_secrets), ("mixing sources", mix_sources), ("byte-level BPE", tokenize)]
#: No SQL: the classifier, the seeded mix and the encoder are not expressible.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
