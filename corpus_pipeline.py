"""The corpus pipeline: stages over documents, each written as Parquet and reread by the next.

Null and empty texts are judged like any other by the first stage; repeated rows of a
doc_id become one in the second; later stages keep what they get, except contaminated
documents. Extra columns of documents travel along, whatever their names, up to the last
stage. The mixing stage writes its rows in mixed order and the last stage writes tokens in
the order of its input's files, so the mixture is the order of the tokens.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescry.llm.common import held_out
from tablescry.llm.decontaminate import without_contaminated
from tablescry.llm.mixing import TARGET_WEIGHTS, in_mixed_order
from tablescry.llm.near_dup import without_near_duplicates
from tablescry.llm.quality import score_quality, train
from tablescry.llm.token_output import TOKENIZER, read_documents, write_tokens
from tablescry.plans.derived import load, scratch_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Near duplicates share four in five of their five-word shingles.
SHINGLE_WORDS, PERCENT = 5, 80


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents whose score is below the threshold go."""
    trees = train(docs.where(~held_out(F.col("doc_id"), 5, 0)), load(spark, sf_dir, "labels"))
    return score_quality(docs, trees, keep=docs.columns, only_good=True)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of each group of near duplicates the smallest doc_id stays."""
    return without_near_duplicates(docs, PERCENT, SHINGLE_WORDS)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents with too large a share of benchmark windows go."""
    return without_contaminated(docs, load(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: all documents, in the order of the mixture."""
    return in_mixed_order(docs, TARGET_WEIGHTS)


def token_file(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: where each document's ids stand in the written file, read back from it.

    The order is that of the rows in the files ``docs`` was read from; a table that comes
    from no file is taken by doc_id.
    """
    import public_tokenizers

    number = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long")
    try:
        placed = docs.select("doc_id", "text", number.alias("_part"), F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
        order = [F.col(c) for c in ("_part", "_file", "_row")]
    except AnalysisException:
        placed, order = docs, None
    folder = f"{scratch_folder(spark)}/tokens"
    write_tokens(placed, folder, public_tokenizers.path(TOKENIZER), order)
    return read_documents(spark, folder)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", good_documents),
    ("minhash_near_dedup", one_of_each_group),
    ("benchmark_decontamination", uncontaminated),
    ("source_mixing", mixed),
    ("token_output", token_file),
]

#: The classifier cannot be written in SQL; the tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    folder = scratch_folder(spark)
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
