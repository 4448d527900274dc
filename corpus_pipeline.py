"""From raw documents to training sequences: quality, near duplicates, duplicate passages, benchmark items, packing.

Each stage takes all that its predecessor kept, and writes what it keeps; all but the last return the columns
of documents. Null, empty and repeated rows follow the operators' own rules:

1. quality: documents that the quality rules reject go (null and empty texts among them).
2. near_duplicates: one document of each group stays, the one with the smallest doc_id; of rows that share a
   doc_id one stays, that whose columns hash lowest; rows without a doc_id stay.
3. substrings: words of passages that stand earlier go, and n_chars follows; a document that loses all words goes.
4. decontamination: documents that hold a benchmark window go.
5. packing: the pieces of what is left, with their ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm.decontaminate import decontaminate
from papyra.llm.dist import named, stage, table
from papyra.llm.minhash import near_duplicates
from papyra.llm.packing import pack
from papyra.llm.quality import judge
from papyra.llm.substrings import remove_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return judge(docs, table(spark, sf_dir, "labels")).where("kept").select("doc.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ids = near_duplicates(docs).where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("own id")).agg(F.bool_and("kept").alias("stays"), F.count(F.lit(1)).alias("rows of it"))
    ids = stage(ids.where("NOT stays OR `rows of it` > 1"), "not-one")
    own = F.col("doc_id") == F.col("own id")
    left = docs.join(ids.select("own id"), own, "left_anti")
    if ids.where("stays").head(1):
        again = docs.join(ids.where("stays").select("own id"), own, "left_semi")
        columns = [named(c) for c in docs.columns]
        left = left.unionByName(again.groupBy(F.col("doc_id").alias("own id")).agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("row")).select("row.*"))
    return left


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = remove_duplicates(docs, original=True).where("n_removed = 0 OR n_removed < n_words")
    kinds = dict(docs.dtypes)
    columns = [F.col("kept_text").alias(c) if c == "text" else F.length("kept_text").cast(kinds[c]).alias(c) if c == "n_chars" else F.col("doc").getField(c).alias(c) for c in docs.columns]
    return left.select(*columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).where("NOT contaminated").select("doc.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", F.col("length").cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [("quality", quality), ("near_duplicates", near), ("substrings", substrings), ("decontamination", decontamination), ("packing", packing)]

#: Quality scores, sketches and token ids are beyond SQL; tests/llm holds the stages against plain restatements.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
