"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each as Parquet
to the shared folder and gives it to the next. Null, empty and repeated ids are no trouble: where a stage has to tell rows
apart, it numbers them first. Empty input gives empty output in every stage; columns beside those of documents are carried
along; a column named like one of the stage's own (they begin with an underscore) is not expected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language_id, mixing, near_dedup, packing, toxicity
from tessera.llm.common import crc_mod, discard, keep, read, small_batches

#: A text that the best language model can't code below this, in bits a byte, is in none of the languages: random letters and digits cost
#: as much (log2 of 62), prose of a language learnt two to three bits.
MOST_BITS = 6.0


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters that the model of one of the languages learnt codes in MOST_BITS a byte; null, empty and letterless texts go."""
    small_batches(spark)
    found = language_id.identify(docs, F.coalesce(crc_mod("doc_id", 3) != 1, F.lit(True)), carry=docs.columns)
    return found.where((F.col("lang_pred") != "und") & (F.col("bits_per_byte") <= MOST_BITS)).select(docs.columns)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic; those without text are judged by the classifier's intercept."""
    small_batches(spark)
    scored = toxicity.toxicity(docs, read(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0, carry=docs.columns)
    return scored.where("predicted = 0").select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id (null last); texts without words stay."""
    small_batches(spark)
    rows = keep(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    found = near_dedup.near_duplicates(rows, id_col="_row").where("n_shingles > 0").select(F.col("doc_id").alias("_row"), "component_id")
    groups = keep(found.withColumn("_many", F.col("_row") != F.col("component_id")), "groups")
    several = groups.where("_many").select("component_id").distinct()
    members = groups.join(several, "component_id", "left_semi").join(rows.select("_row", F.col("doc_id").alias("_id")), "_row")
    stays = members.groupBy("component_id").agg(F.min_by("_row", F.struct(F.col("_id").isNull(), "_id", "_row")).alias("_row"))
    gone = keep(members.select("_row").join(stays, "_row", "left_anti"), "gone")
    discard(groups)
    return rows.join(gone, "_row", "left_anti").select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it (not at all, once or twice), copies in different places."""
    rows = keep(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    copies = mixing.mix(rows, id_col="_row").where("copies > 0").select(F.col("doc_id").alias("_row"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).hint("merge")  # small as a file, but not bounded
    return rows.join(copies, "_row").sortWithinPartitions(F.xxhash64("_row", "_copy")).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full sequences, with their token ids; a document without text is its closing token."""
    small_batches(spark)
    return packing.pack(docs)


STAGES = [("language", known_language), ("toxicity", not_toxic), ("near duplicates", one_of_each), ("mixing", mixed), ("packing", packed)]
#: Trained models, MinHash and tokenizers have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
