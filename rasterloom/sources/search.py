"""Searches of item services, over JSON that lies in a folder.

A source answers search(bounds, interval, collection, filters, limit) with rows of id, source, collection,
box, interval and maps of assets, properties and provenance.  Live services need a network client; a source
for one writes the pages it fetches to a folder and hands them to these readers.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.boxes import BOX
from . import items


@dataclass
class AuthStatus:
    source: str
    authenticated: bool
    detail: str | None = None


@dataclass
class Source:
    """Rows of JSON text in files, one item for each line."""

    spark: SparkSession
    path: str
    name: str = "files"
    defaults: dict = field(default_factory=dict)

    def rows(self, text: DataFrame) -> DataFrame:
        raise NotImplementedError

    def auth_status(self) -> AuthStatus:
        return AuthStatus(self.name, True, "files need no key")

    def search(self, *, bounds=None, interval=None, collection: str | None = None, filters: dict[str, str] | None = None, limit: int | None = None) -> DataFrame:
        """Filters are on properties, by equality; the limit takes the first rows by id."""
        df = self.rows(self.spark.read.text(self.path)).withColumn("source", F.lit(self.name))
        if bounds is not None:
            x0, y0, x1, y1 = bounds
            df = df.where((F.col("xmin") <= x1) & (F.col("xmax") >= x0) & (F.col("ymin") <= y1) & (F.col("ymax") >= y0))
        if interval is not None:
            lo, hi = (F.lit(t).cast("timestamp") for t in interval)
            df = df.where((F.col("end_time") >= lo) & (F.col("start_time") <= hi))
        if collection is not None:
            df = df.where(F.col("collection") == collection)
        for k, v in (filters or {}).items():
            df = df.where(F.element_at("properties", F.lit(k)) == F.lit(v))
        return df.orderBy("id").limit(limit) if limit is not None else df


def _provenance(name: str) -> Column:
    return F.create_map(F.lit("via"), F.lit(name))


class StacSource(Source):
    """Items with bbox, properties and assets."""

    def rows(self, text):
        v = F.col("value")
        assets = F.from_json(F.get_json_object(v, "$.assets"), "map<string,struct<href:string>>")
        base = items.from_stac_items(text.select(v.alias("item"), v.alias("_v")).select("item"), asset_key="*").df.select("id", *BOX, "start_time", "end_time").distinct()
        maps = text.select(F.get_json_object(v, "$.id").alias("id"), F.get_json_object(v, "$.collection").alias("collection"), F.transform_values(assets, lambda k, a: a["href"]).alias("assets"), F.from_json(F.get_json_object(v, "$.properties"), "map<string,string>").alias("properties"))
        return base.join(maps, "id").withColumn("provenance", _provenance(self.name))


class GranuleSource(Source):
    """Granules with `meta` and `umm`, as a metadata repository returns them."""

    def rows(self, text):
        umm = F.get_json_object("value", "$.umm")
        urls = F.transform(F.from_json(F.get_json_object(umm, "$.RelatedUrls"), "array<struct<URL:string,Type:string>>"), lambda u: F.struct(items.asset_key_from_url(u["URL"]).alias("k"), u["URL"].alias("v")))
        first = F.aggregate(urls, F.from_json(F.lit("{}"), "map<string,string>"), lambda acc, u: F.when(F.map_contains_key(acc, u["k"]), acc).otherwise(F.map_concat(acc, F.create_map(u["k"], u["v"]))))
        cloud = F.map_filter(F.create_map(F.lit("cloud_cover"), items.extract_cloud_cover(umm).cast("string")), lambda k, v: v.isNotNull())
        df = text.select(F.get_json_object(umm, "$.GranuleUR").alias("id"), F.get_json_object(umm, "$.CollectionReference.ShortName").alias("collection"), *items.granule_box(umm), *items.granule_interval(umm), first.alias("assets"), cloud.alias("properties"))
        return df.withColumn("provenance", _provenance(self.name))
