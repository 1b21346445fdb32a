"""Rows from items of JSON catalogues (STAC, UMM) and back; everything as column expressions."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.boxes import BOX
from .catalog import Catalog


def to_utc(value: Column) -> Column:
    """ISO text to a timestamp; without a zone it is UTC (the session's)."""
    return F.try_to_timestamp(value)


def to_rfc3339(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ssXXX")


def asset_key_from_url(url: Column) -> Column:
    """The last path segment's stem if it has 1 to 64 characters, else its extension, else the segment's last 32 characters."""
    leaf = F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"([^/]*)/*$", 1)
    stem, ext = F.regexp_extract(leaf, r"^(.+)\.[^.]*$", 1), F.regexp_extract(leaf, r"\.([^.]+)$", 1)
    stem = F.when(F.instr(leaf, ".") > 0, stem).otherwise(leaf)
    return F.when(F.length(stem).between(1, 64), stem).when(F.length(ext) > 0, ext).otherwise(F.right(leaf, F.lit(32)))


def granule_box(umm: Column) -> list[Column]:
    """xmin, ymin, xmax, ymax of a granule's JSON: of its polygons' points, else its rectangles, else its points."""
    root = "$.SpatialExtent.HorizontalSpatialDomain.Geometry."
    points = "array<struct<Longitude:double,Latitude:double>>"
    polygons = F.from_json(F.get_json_object(umm, root + "GPolygons"), f"array<struct<Boundary:struct<Points:{points}>>>")
    ring = F.flatten(F.transform(F.filter(polygons, lambda p: F.size(p["Boundary"]["Points"]) >= 3), lambda p: p["Boundary"]["Points"]))
    boxes = F.from_json(F.get_json_object(umm, root + "BoundingRectangles"), "array<struct<WestBoundingCoordinate:double,SouthBoundingCoordinate:double,EastBoundingCoordinate:double,NorthBoundingCoordinate:double>>")
    corner = lambda x, y: F.transform(boxes, lambda b: F.struct(b[x].alias("Longitude"), b[y].alias("Latitude")))
    corners = F.concat(corner("WestBoundingCoordinate", "SouthBoundingCoordinate"), corner("EastBoundingCoordinate", "NorthBoundingCoordinate"))
    single = F.from_json(F.get_json_object(umm, root + "Points"), points)
    some = lambda a: F.when(F.size(a) > 0, a)
    p = F.coalesce(some(ring), some(corners), some(single))
    return [f(F.transform(p, lambda q: q[c])).alias(n) for f, c, n in ((F.array_min, "Longitude", "xmin"), (F.array_min, "Latitude", "ymin"), (F.array_max, "Longitude", "xmax"), (F.array_max, "Latitude", "ymax"))]


def granule_interval(umm: Column) -> list[Column]:
    t = lambda path: to_utc(F.get_json_object(umm, path))
    one = t("$.TemporalExtent.SingleDateTime")
    return [F.coalesce(t("$.TemporalExtent.RangeDateTime.BeginningDateTime"), one).alias("start_time"), F.coalesce(t("$.TemporalExtent.RangeDateTime.EndingDateTime"), t("$.TemporalExtent.RangeDateTime.BeginningDateTime"), one).alias("end_time")]


def extract_cloud_cover(umm: Column) -> Column:
    """CloudCover, else the first additional attribute whose name starts so."""
    extra = F.from_json(F.get_json_object(umm, "$.AdditionalAttributes"), "array<struct<Name:string,Values:array<string>>>")
    named = F.filter(extra, lambda a: F.lower(a["Name"]).startswith("cloud"))
    return F.coalesce(F.get_json_object(umm, "$.CloudCover").try_cast("double"), F.get(F.get(named, F.lit(0))["Values"], F.lit(0)).try_cast("double"))


def umm_essentials(umm: Column) -> Column:
    """A bounded part of a granule's JSON."""
    return F.to_json(F.struct(*[F.get_json_object(umm, f"$.{k}").alias(k) for k in ("GranuleUR", "CollectionReference", "DataGranule", "ProviderDates")]))


def from_stac_items(items: DataFrame, *, asset_key: str = "data", properties=()) -> Catalog:
    """A catalogue from rows of item JSON (`item`): one row for each item, or for each asset with asset_key "*".

    The footprint is bbox (4 or 6 numbers); the interval start_datetime to end_datetime, else datetime.
    An item without the asset is an error.
    """
    item = F.col("item")
    bbox = F.from_json(F.get_json_object(item, "$.bbox"), "array<double>")
    half = (F.size(bbox) / 2).cast("int")
    t = lambda k: to_utc(F.get_json_object(item, f"$.properties.{k}"))
    assets = F.from_json(F.get_json_object(item, "$.assets"), "map<string,struct<href:string>>")
    href = F.element_at(assets, F.lit(asset_key))["href"]
    found = F.coalesce(href, F.raise_error(F.concat(F.lit(f"no asset {asset_key} in item "), F.get_json_object(item, "$.id"))))
    rows = items.select("item", F.explode(assets).alias("_key", "_asset")).withColumn("filepath", F.col("_asset.href")) if asset_key == "*" else items.withColumn("filepath", found)
    columns = [F.get_json_object(item, "$.id").alias("id"), "filepath", F.get(bbox, F.lit(0)).alias("xmin"), F.get(bbox, F.lit(1)).alias("ymin"), F.get(bbox, half).alias("xmax"), F.get(bbox, half + 1).alias("ymax")]
    columns += [F.coalesce(t("start_datetime"), t("datetime")).alias("start_time"), F.coalesce(t("end_datetime"), t("datetime")).alias("end_time")]
    columns += [F.get_json_object(item, f"$.properties.{p}").alias(p) for p in properties]
    return Catalog(rows.select(*columns))


def read_stac(spark: SparkSession, path: str, **kw) -> Catalog:
    """Items from JSON lines, or one item or item collection for each file."""
    text = spark.read.text(path, wholetext=True).select("value")
    many = F.from_json(F.get_json_object("value", "$.features"), "array<string>")
    one = text.select(F.explode(F.when(many.isNotNull(), many).otherwise(F.split("value", r"\n(?=\{)"))).alias("item")).where("length(trim(item)) > 0")
    return from_stac_items(one, **kw)


def to_stac_items(catalog: Catalog, *, collection: str, asset_key: str = "data") -> DataFrame:
    """Rows of item JSON: datetime where the interval is a moment, else start_datetime and end_datetime."""
    same = F.col("start_time") == F.col("end_time")
    props = F.when(same, F.to_json(F.struct(to_rfc3339(F.col("start_time")).alias("datetime")))).otherwise(F.to_json(F.struct(to_rfc3339(F.col("start_time")).alias("start_datetime"), to_rfc3339(F.col("end_time")).alias("end_datetime"))))
    ring = F.concat(F.lit('{"type":"Polygon","coordinates":[[['), F.concat_ws("],[", *[F.concat_ws(",", F.col(a).cast("string"), F.col(b).cast("string")) for a, b in (("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymax"), ("xmin", "ymin"))]), F.lit("]]]}"))
    text = F.concat(F.lit('{"type":"Feature","stac_version":"1.0.0","id":"'), F.col("filepath"), F.lit(f'","collection":{json.dumps(collection)},"geometry":'), ring, F.lit(',"bbox":'), F.to_json(F.array(*BOX)), F.lit(',"properties":'), props, F.lit(f',"assets":{{"{asset_key}":{{"href":"'), F.col("filepath"), F.lit('"}}}'))
    return catalog.df.select(text.alias("item"))


def to_stac_collection(catalog: Catalog, *, collection: str, description: str = "") -> DataFrame:
    """One row: the collection's JSON with its extent; the world where there are no rows."""
    s = catalog.stats()
    bbox = F.to_json(F.array(*[F.coalesce(c, F.lit(d)) for c, d in zip(BOX, (-180.0, -90.0, 180.0, 90.0), strict=True)]))
    when = F.to_json(F.array(to_rfc3339(F.col("start_time")), to_rfc3339(F.col("end_time"))))
    head = json.dumps({"type": "Collection", "stac_version": "1.0.0", "id": collection, "description": description})[:-1]
    return s.select(F.concat(F.lit(head + ', "extent": {"spatial": {"bbox": ['), bbox, F.lit(']}, "temporal": {"interval": ['), when, F.lit("]}}}")).alias("collection"))


def source_row_to_catalog(rows: DataFrame, primary_asset: str | None = None) -> DataFrame:
    """Source rows (maps assets, properties, provenance) as catalogue rows: filepath is the named asset, else the first; the maps as JSON text."""
    first = F.element_at(F.map_values("assets"), 1)
    path = F.coalesce(F.element_at("assets", F.lit(primary_asset)), first) if primary_asset else first
    return rows.select("id", path.alias("filepath"), *BOX, "start_time", "end_time", *[F.to_json(c).alias(c) for c in ("assets", "properties", "provenance")])


class Bundle:
    """Items, the queries that brought them and matchups, as three tables in a directory."""

    VERSION = 1

    def __init__(self, items: DataFrame, queries: DataFrame | None = None, matchups: DataFrame | None = None, crs: str = "EPSG:4326"):
        spark = items.sparkSession
        self.items, self.crs, self.matchups = items, crs, matchups
        self.queries = queries if queries is not None else spark.createDataFrame([], "query_id string, source string, collection string, tag string, n_returned long, created_at timestamp")

    def ingest(self, rows: DataFrame, *, query_id: str, source: str, collection: str, tag: str | None = None) -> "Bundle":
        """Appends source rows; provenance gets query_id and query_tag where it lacks them, and the query is logged even if it found nothing."""
        stamp = F.map_from_entries(F.filter(F.array(F.struct(F.lit("query_id").alias("k"), F.lit(query_id).alias("v")), F.struct(F.lit("query_tag").alias("k"), F.lit(tag).alias("v"))), lambda e: e["v"].isNotNull()))
        stamped = rows.withColumn("provenance", F.map_concat(F.map_filter(stamp, lambda k, v: ~F.map_contains_key("provenance", k)), "provenance"))
        log = rows.agg(F.count("*").alias("n_returned")).select(F.lit(query_id).alias("query_id"), F.lit(source).alias("source"), F.lit(collection).alias("collection"), F.lit(tag).cast("string").alias("tag"), "n_returned", F.current_timestamp().alias("created_at"))
        return Bundle(self.items.unionByName(source_row_to_catalog(stamped), allowMissingColumns=True), self.queries.unionByName(log), self.matchups, self.crs)

    def write_matchups(self, rows: DataFrame, tag: str | None = None) -> "Bundle":
        rows = rows.withColumn("query_set", F.lit(tag)) if tag else rows
        return Bundle(self.items, self.queries, rows if self.matchups is None else self.matchups.unionByName(rows, allowMissingColumns=True), self.crs)

    def to_directory(self, path: str) -> None:
        spark = self.items.sparkSession
        self.items.write.mode("overwrite").parquet(f"{path}/items")
        self.queries.write.mode("overwrite").parquet(f"{path}/queries")
        if self.matchups is not None:
            self.matchups.write.mode("overwrite").parquet(f"{path}/matchups")
        spark.createDataFrame([(json.dumps({"version": self.VERSION, "crs": self.crs, "matchups": self.matchups is not None}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def from_directory(cls, spark: SparkSession, path: str) -> "Bundle":
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        if meta["version"] > cls.VERSION:
            raise ValueError(f"bundle version {meta['version']} is newer than {cls.VERSION}")
        return cls(spark.read.parquet(f"{path}/items"), spark.read.parquet(f"{path}/queries"), spark.read.parquet(f"{path}/matchups") if meta["matchups"] else None, meta["crs"])


def staged_path(uri: Column, root: str) -> Column:
    """Where a URI's copy belongs: root / sha256(uri) and its extension."""
    ext = F.regexp_extract(uri, r"(\.[A-Za-z0-9]{1,8})(?:[?#].*)?$", 1)
    return F.concat(F.lit(root.rstrip("/") + "/"), F.sha2(uri, 256), ext)


def stage(catalog: Catalog, root: str) -> Catalog:
    """The catalogue with filepaths in the cache and the original in _staged_from; copying is copy_files()."""
    return Catalog(catalog.df.withColumn("_staged_from", F.col("filepath")).withColumn("filepath", staged_path(F.col("_staged_from"), root)), catalog.crs, catalog.backend)


def copy_files(catalog: Catalog, *, on_error: str = "raise") -> DataFrame:
    """Copies local or mounted files from _staged_from to filepath on the executors: (filepath, status); a fresh copy stays."""
    def run(batches):
        import os
        import shutil

        import pyarrow as pa

        for batch in batches:
            status = []
            for a, b in zip(batch.column("_staged_from").to_pylist(), batch.column("filepath").to_pylist(), strict=True):
                try:
                    if os.path.exists(b):
                        status.append("fresh")
                        continue
                    os.makedirs(os.path.dirname(b), exist_ok=True)
                    shutil.copyfile(a.removeprefix("file://"), f"{b}.part{os.getpid()}")
                    os.replace(f"{b}.part{os.getpid()}", b)
                    status.append("copied")
                except OSError as e:
                    if on_error == "raise":
                        raise
                    status.append(f"failed: {e}")
            yield pa.RecordBatch.from_arrays([batch.column("filepath"), pa.array(status)], ["filepath", "status"])

    return catalog.df.select("_staged_from", "filepath").mapInArrow(run, "filepath string, status string")
