"""The three scheduled jobs: convert what changed, publish indexes, audit sites.

Each job writes its result as tables.  What a later job reads is the written table and
not a long lineage, so a lost executor costs the tasks it ran and nothing before them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lucidex import schemas
from lucidex.operators import audit, conflicts, conversion, site_index, store
from lucidex.operators.fetch import fetch_rows
from lucidex.operators.exposure import with_exposure, with_profile
from lucidex.sources import snapshots
from lucidex.sources.tables import append_change, read_changing, write_by_site
from lucidex.sources.work import release, written

KEY = ["site_id", "content_id"]


def missing_conversions(content: DataFrame, stored: DataFrame,
                        version: str = conversion.CONVERTER_VERSION) -> DataFrame:
    """Documents whose current hash has no stored conversion of this version.

    One plan, for tables bucketed by the key: these are not shuffled.  Other tables are better read
    by :func:`fetch_missing`, as this join may move the pages.
    """
    return content.join(_missing_keys(content, stored, version), KEY)


def _missing_keys(content: DataFrame, stored: DataFrame, version: str) -> DataFrame:
    hashed = content.select(*KEY, store.content_hash().alias("content_hash"))
    return store.plan_conversion(hashed, stored, version).filter("action = 'miss'").drop("action")


def fetch_missing(content: DataFrame, stored: DataFrame, version: str = conversion.CONVERTER_VERSION,
                  broadcast_keys: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The documents that :func:`missing_conversions` finds, and the work table of their keys.

    Keys and hashes are compared and the keys that miss are written, so that their number is known; then
    only their pages are fetched.  No other page is in an exchange, however large the tables are.
    """
    keys = written(_missing_keys(content, stored, version), "missing")
    return fetch_rows(content, keys, KEY, broadcast_keys), keys


def refresh_conversions(spark: SparkSession, content: DataFrame, root: str, now: str) -> int:
    """Convert new and changed documents and log them in the store at *root*.

    *now* stamps the run (``yyyy-MM-dd HH:mm:ss``), so that a retried run writes the
    same rows.  Stored documents that *content* no longer has are dropped.
    """
    stored = read_changing(spark, root, schemas.STORE)
    gone = stored.select(*KEY).join(content.select(*KEY), KEY, "left_anti")
    append_change(gone, root, "drop", schemas.STORE)
    pages, keys = fetch_missing(content, stored)
    done = conversion.convert(pages, [*KEY, "content_hash"])
    done = written(done, "converted")
    stamp = F.to_timestamp_ntz(F.lit(now))
    reasons = done.filter("status <> 'ok'").select(*KEY, "status", stamp.alias("generated_at"))
    again = done.filter("status = 'ok'").select(*KEY)
    append_change(gone.unionByName(again), f"{root}-status", "drop", schemas.STATUS)
    append_change(reasons, f"{root}-status", "put", schemas.STATUS)
    rows = done.drop("status").withColumns({
        "signals": F.to_json("signals"),
        "generated_at": stamp,
        "converter_version": F.lit(conversion.CONVERTER_VERSION),
    })
    seq = append_change(rows, root, "put", schemas.STORE)
    release(keys, done)
    return seq


def conversion_status(spark: SparkSession, root: str) -> DataFrame:
    """Documents whose stored text is empty, and why (site_id, content_id, status, generated_at)."""
    return read_changing(spark, f"{root}-status", schemas.STATUS)


def publish_indexes(content: DataFrame, profile: DataFrame, meta: DataFrame, robots: DataFrame,
                    descriptions: DataFrame, editorial: DataFrame, stored: DataFrame, out: str,
                    labels: dict[str, str] | None = None) -> None:
    """Write ``lines`` (rows), ``parts`` (ordered texts) and ``full`` (document rows) under *out*."""
    spark = content.sparkSession
    listed = site_index.newest_per_type(with_profile(content.drop("body_html", "fields_json"), profile))
    # Written before the texts are joined: the files show how small the listed rows are,
    # and Spark then decides by that size whether to broadcast them.
    with_exposure(listed, meta, robots).write.mode("overwrite").parquet(f"{out}/listed")
    gated = spark.read.parquet(f"{out}/listed")
    entries = site_index.index_entries(gated, descriptions, stored, labels)
    entries.write.mode("overwrite").parquet(f"{out}/entries")
    entries = spark.read.parquet(f"{out}/entries")
    lines = site_index.index_lines(site_index.index_rows(editorial, entries))
    write_by_site(lines, f"{out}/lines")
    lines = spark.read.schema(lines.schema).parquet(f"{out}/lines")
    site_index.index_parts(lines, profile).write.mode("overwrite").parquet(f"{out}/parts")
    with_full = profile.filter("full_index_enabled").select("site_id")
    full = site_index.full_index(editorial, entries, stored).join(with_full, "site_id", "left_semi")
    write_by_site(full, f"{out}/full")


#: Tables of a published index.
INDEX_TABLES = ("lines", "parts", "full")


def publish_snapshot(root: str, run: str, content: DataFrame, *inputs: DataFrame, stamp: str = "",
                     base: int | None = None) -> snapshots.Snapshot:
    """:func:`publish_indexes` as one version of the index at *root*: readers see all of it or none.

    *run* names the run, such as ``daily-2024-02-01``; a run that is published is not published again, and
    one that failed starts anew beside what readers use.
    """
    def write(folder: str) -> tuple[str, ...]:
        publish_indexes(content, *inputs, out=folder)
        return INDEX_TABLES

    return snapshots.publish(content.sparkSession, root, run, write, stamp, base)


def daily_rebuild(root: str, day: str, content: DataFrame, *inputs: DataFrame, keep: int = 3) -> snapshots.Snapshot:
    """The full rebuild of a day (``yyyy-MM-dd``), once however often it is started; old versions expire."""
    made = publish_snapshot(root, f"daily-{day}", content, *inputs, stamp=day)
    snapshots.expire(content.sparkSession, root, keep)
    return made


def audit_tables(profile: DataFrame, plugins: DataFrame, root_files: DataFrame, found_conflicts: DataFrame, index_rows: DataFrame,
                 stored: DataFrame, content: DataFrame, out: str, stamp: str) -> None:
    """From the tables to the scores: ``signals``, ``sub_scores`` and ``overall`` under *out*.

    *plugins*, *root_files* and *found_conflicts* are keyed by site; posture and provider follow from the plug-ins.
    """
    signals = audit.signals_from_tables(
        profile, conflicts.seo_posture(plugins), conflicts.active_provider(plugins, profile), audit.probed_files(root_files),
        found_conflicts, site_index.index_measures(index_rows), stored, content)
    signals.withColumn("computed_at", F.lit(stamp)).write.mode("overwrite").parquet(f"{out}/signals")
    audit_sites(profile.sparkSession.read.parquet(f"{out}/signals").drop("computed_at"), out, stamp)


def audit_sites(signals: DataFrame, out: str, stamp: str) -> None:
    """Write ``sub_scores`` and ``overall`` under *out*, stamped with the run."""
    spark = signals.sparkSession
    audit.sub_scores(signals).withColumn("computed_at", F.lit(stamp)).write.mode("overwrite").parquet(f"{out}/sub_scores")
    scores = spark.read.parquet(f"{out}/sub_scores")
    audit.overall(scores).withColumn("computed_at", F.lit(stamp)).write.mode("overwrite").parquet(f"{out}/overall")
