"""From raw documents to token ids, each stage on all that the one before kept.

Quality rules drop bad documents, line dedup takes repeated lines out of texts, SimHash keeps one
document of each near-duplicate group, mixing repeats or drops documents towards the sources' target
weights, and BPE encodes what is left.  Every stage is written as Parquet and read again, so a lost
executor costs at most the stage that runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lucidex.llm import bpe, lines, mixture, rules, shingles, simhash
from lucidex.llm.common import saved, table

#: The columns of documents, which all stages but the last return.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned decision list rejects."""
    return rules.keep_good(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat an earlier one; a document stays even if no line of it does."""
    cut = lines.dedup_lines(docs)
    length = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", length).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: that with the smallest doc_id (null last), then the smallest hash of the row.

    Rows that share a doc_id, or have none, but are in different groups are each kept.  Rows that are
    equal in all columns are one.  Near-duplicates are what op4 calls so (SimHash of four-word shingles, 4 of
    64 bits), and texts that share four fifths of their five-word shingles, both linked in chains.
    """
    named = docs.withColumn("_row", F.sha2(F.to_json(F.struct(*COLUMNS)), 256))
    placed = simhash.grouped(named, ["doc_id", "_row"]).dropDuplicates(["_row"])
    groups = shingles.regrouped(placed, named.select("_row", "text"), "_row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))
    kept = placed.select("doc_id", "_row").join(groups, "_row").groupBy("_group").agg(first.alias("_first")).select("_first._row")
    return named.join(kept, "_row", "left_semi").dropDuplicates(["_row"]).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; a copy has the same doc_id.

    Rows that agree in doc_id and text, of which the stage before leaves none, are taken together.
    """
    text = F.coalesce("text", F.lit(""))
    named = docs.withColumns({"size": mixture.word_count(text), "_name": mixture.row_name(text), "_at": F.lit(0)})
    taken = mixture.mix(named.withColumn("hash", mixture.row_hash("_name", "_at")))
    return taken.filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row with the digests that op6 gives; in small blocks, as the stages before leave heaps full."""
    return bpe.encode(docs, keys=("doc_id", "lang", "source"), with_ids=True, block_bytes=16 << 20, batch_bytes=4 << 20)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding", bpe_encode),
]

#: SQL can't express the learned rules nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
