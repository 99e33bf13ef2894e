"""Reading and writing the engine's tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from lucidex.operators.skew import latest_per_key
from lucidex.sources.work import create_if_absent, delete, files_in

KEY = ["site_id", "content_id"]


def read_table(spark: SparkSession, path: str, schema: str | None = None, fmt: str = "parquet") -> DataFrame:
    """A table as declared: nothing is inferred where a schema is given."""
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema else reader).load(path)


def save_bucketed(rows: DataFrame, table: str, buckets: int, path: str | None = None) -> None:
    """Save bucketed and sorted by the document key.

    Content, store and metadata saved with the same number of buckets join on the key
    without a shuffle.  The document id is part of the key, so a hot site is spread.
    """
    writer = (rows.repartition(buckets, *KEY).write.mode("overwrite").format("parquet")
              .bucketBy(buckets, *KEY).sortBy(*KEY))
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


# A keyed table that changes: a base plus a log of small changes.
#
#   root/base/seq=7-<run>    the whole table as of change 7
#   root/log/seq=8-<run>     rows put or dropped by change 8
#   root/_commits            one row per finished write
#
# A change costs its own size; the table is rewritten only when it is compacted.  A write is named by
# its run, so two writers never share a folder and a run that is repeated is not logged again.

COMMIT = "seq bigint, kind string, run string"


def commits(spark: SparkSession, root: str) -> DataFrame:
    """One small row (seq, kind, run) per finished write; a table that was never written has none."""
    try:
        return spark.read.schema(COMMIT).json(f"{root}/_commits").distinct()
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COMMIT)


def _finish(spark: SparkSession, root: str, seq: int, kind: str, run: str) -> int:
    row = json.dumps({"seq": seq, "kind": kind, "run": run})
    create_if_absent(spark, f"{root}/_commits/{seq:012d}-{uuid.uuid4().hex}.json", row + "\n")
    return seq


def claim_seq(spark: SparkSession, root: str, run: str) -> int:
    """The next free number, for this run alone: of two writers that claim at once one gets the next.

    The greater number wins where two changes touch a document, so which one does is settled here.
    """
    last = commits(spark, root).agg(F.max("seq")).first()[0]
    seq = 0 if last is None else last + 1
    while not create_if_absent(spark, f"{root}/_claims/{seq:012d}", run):
        seq += 1
    return seq


def append_change(rows: DataFrame, root: str, op: str, schema: str, run: str | None = None) -> int:
    """Log a change: whole rows to ``put``, or keys to ``drop``.

    The data is written before its commit, so a reader never sees half a change.  *run* names the write,
    such as a stream and its epoch; a run that is logged already is left as it is.
    """
    spark = rows.sparkSession
    run = run or uuid.uuid4().hex
    known = commits(spark, root).filter(F.col("run") == run).agg(F.max("seq")).first()[0]
    if known is not None:
        return known
    names = StructType.fromDDL(schema)
    full = rows.select(*[
        (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in names.fields])
    while True:
        seq = claim_seq(spark, root, run)
        full.withColumns({"_op": F.lit(op), "_seq": F.lit(seq).cast("bigint"), "_run": F.lit(run)}).write.mode("overwrite").parquet(
            f"{root}/log/seq={seq}-{run}")
        # A compaction may have given this claim up; then the change takes a later number.
        if create_if_absent(spark, f"{root}/_ends/{seq:012d}", run):
            return _finish(spark, root, seq, "log", run)


def read_changing(spark: SparkSession, root: str, schema: str, upto: int | None = None) -> DataFrame:
    """The table as of the last finished write, or as of write *upto*.

    The log since the base is read at once.  Its newest row of each key replaces the key's row in the
    base, which is found by its key: no text of the base is compared or sorted.
    """
    done = commits(spark, root)
    if upto is not None:
        done = done.filter(F.col("seq") <= upto)
    base = done.filter("kind = 'base'").agg(F.max(F.struct("seq", "run"))).first()[0]
    since = done.filter("kind = 'log'").filter(F.col("seq") > (-1 if base is None else base["seq"]))
    # As many rows as writes since the base; compaction sets them back to none.
    logged = [f"{root}/log/seq={r['seq']}-{r['run']}" for r in since.orderBy("seq", "run").collect()]
    names = StructType.fromDDL(schema).names
    start = (spark.createDataFrame([], schema) if base is None else
             read_table(spark, f"{root}/base/seq={base['seq']}-{base['run']}", schema))
    if not logged:
        return start
    log = spark.read.schema(f"{schema}, _op string, _seq bigint, _run string").parquet(*logged)
    changed = latest_per_key(log, KEY, ["_seq", "_run"])
    kept = start.join(log.select(*KEY).distinct(), KEY, "left_anti")
    return kept.select(*names).unionByName(changed.filter(F.col("_op") == "put").select(*names))


def compact(spark: SparkSession, root: str, schema: str, patience: float = 3600.0) -> int:
    """Write the table as a new base, which ends the log before it.

    A base reaches up to the first number that a writer has claimed and not finished.  Claims older than
    *patience* seconds are given up, so that a writer that died doesn't hold the log; one that is only slow
    takes a new number.
    """
    finished = {row["seq"] for row in commits(spark, root).select("seq").distinct().collect()}
    upto = max(finished, default=-1)
    for name, age in sorted(files_in(spark, f"{root}/_claims").items()):
        if int(name) in finished:
            continue
        if age < patience or not create_if_absent(spark, f"{root}/_ends/{name}", "given up"):
            upto = min(upto, int(name) - 1)
            break
    run = uuid.uuid4().hex
    read_changing(spark, root, schema, upto).write.mode("overwrite").parquet(f"{root}/base/seq={upto}-{run}")
    _finish(spark, root, upto, "base", run)
    for seq in finished:
        if seq <= upto:
            delete(spark, f"{root}/_claims/{seq:012d}")
            delete(spark, f"{root}/_ends/{seq:012d}")
    return upto


def write_by_site(rows: DataFrame, path: str, buckets: int = 256) -> None:
    """Mirror or index output: Parquet in folders by a hash of the site, several files for a big site.

    Rows are spread by site and document hash, so one site never writes through one task, and the number
    of folders does not grow with the number of sites.
    """
    hashed = rows.withColumn("site_bucket", F.pmod(F.xxhash64("site_id"), F.lit(buckets)).cast("int"))
    spread = hashed.repartition("site_bucket", F.pmod(F.xxhash64("site_id", "content_id"), F.lit(16)))
    spread.write.mode("overwrite").partitionBy("site_bucket").parquet(path)
