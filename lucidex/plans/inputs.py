"""The engine's input tables for the registered queries, composed once per query."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from lucidex.operators import descriptions as ds
from lucidex.operators import exposure, site_index, store
from lucidex.operators.profile import clean_editorial, normalise_profile
from lucidex.sources.samples import Samples


class Inputs:
    """Lazy DataFrames over one folder of sample tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.samples = Samples(spark, folder)

    def sample(self, name: str) -> DataFrame:
        return getattr(self.samples, name)

    @cached_property
    def content(self) -> DataFrame:
        return self.sample("content")

    @cached_property
    def light(self) -> DataFrame:
        """Content without the heavy columns."""
        return self.content.drop("body_html", "fields_json")

    @cached_property
    def profile(self) -> DataFrame:
        return normalise_profile(self.sample("stored_profiles"))

    @cached_property
    def descriptions(self) -> DataFrame:
        return self.sample("descriptions")

    @cached_property
    def store(self) -> DataFrame:
        return self.sample("page_store")

    @cached_property
    def bodies(self) -> DataFrame:
        return self.sample("source_store")

    def sited(self, content: DataFrame | None = None) -> DataFrame:
        return exposure.with_profile(self.light if content is None else content, self.profile)

    def gated(self, rows: DataFrame | None = None) -> DataFrame:
        rows = self.sited() if rows is None else rows
        return exposure.with_exposure(rows, self.sample("content_meta"), self.sample("robots"))

    @cached_property
    def entries(self) -> DataFrame:
        capped = site_index.newest_per_type(self.sited())
        return site_index.index_entries(self.gated(capped), self.descriptions, self.store)

    @cached_property
    def editorial(self) -> DataFrame:
        return clean_editorial(self.sample("editorial"))

    @cached_property
    def rows(self) -> DataFrame:
        return site_index.index_rows(self.editorial, self.entries)

    @cached_property
    def lines(self) -> DataFrame:
        return site_index.index_lines(self.rows)

    @cached_property
    def bodies_of_sites(self) -> DataFrame:
        return site_index.index_body(site_index.index_parts(self.lines, self.profile))

    @cached_property
    def full_rows(self) -> DataFrame:
        return site_index.full_index(self.editorial, self.entries, self.store)

    @cached_property
    def eligible(self) -> DataFrame:
        return ds.eligible_rows(self.gated(ds.considered_rows(self.sited())), self.descriptions)

    @cached_property
    def conflicts(self) -> DataFrame:
        from lucidex.operators import conflicts as cf

        registry = cf.competitor_registry(self.spark)
        return cf.detect_conflicts(self.sample("active_plugins"), registry, self.sample("root_files"),
                                   self.sample("rewrites"))

    @cached_property
    def signals(self) -> DataFrame:
        return self.sample("source_signals")

    def hashed(self) -> DataFrame:
        return self.content.select("site_id", "content_id", store.content_hash().alias("content_hash"))
