"""Assets near a section, by the layout of its pages: a sweep down each page, without pairs of its elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Kinds of elements that are assets.
ASSET_KINDS = ("table", "figure", "image", "chart", "image_summary")


def _path(column: str) -> Column:
    """A path without its blank parts."""
    return F.filter(F.coalesce(F.col(column), F.array().cast("array<string>")), lambda p: F.trim(p) != "")


def nearest(tops: DataFrame, bottoms: DataFrame, keys: list[str]) -> DataFrame:
    """tops (keys, y) with gap: how far the nearest of bottoms (keys, y) with the same keys is; null where there is none.

    One sort of each key's rows: the last bottom at or above a row and the next one below come from two running values.
    """
    both = tops.withColumn("__below", F.lit(None).cast("double")).unionByName(bottoms.select(*keys, "y", F.col("y").alias("__below")), allowMissingColumns=True)
    both = both.withColumn("__top", F.col("__below").isNull())
    by = Window.partitionBy(*keys)
    above = F.last("__below", True).over(by.orderBy("y", "__top").rowsBetween(Window.unboundedPreceding, 0))
    under = F.last("__below", True).over(by.orderBy(F.desc("y"), "__top").rowsBetween(Window.unboundedPreceding, 0))
    return both.select("*", F.least(F.abs(F.col("y") - above), F.abs(F.col("y") - under)).alias("gap")).where("__top").drop("__below", "__top")


def section_assets(sections: DataFrame, elements: DataFrame, assets: DataFrame, most: int | None = None) -> DataFrame:
    """section_id, asset_id, place of the assets on a section's pages or with its path, nearest first.

    sections (section_id, doc_id, toc_path, page_start, page_end), elements (doc_id, element_id, kind,
    toc_path, page_no, bbox: x1, y1, x2, y2), assets (doc_id, asset_id, element_ref). Assets with the section's path
    come first, then by the distance of their top from the bottom of the nearest text of that path on the same page of the section's (those
    without one last), then by pages from the section's first, then by id. A missing end of a
    section's pages is its other end; elements without a page or an asset are passed over.
    """
    start, end = F.coalesce("page_start", "page_end"), F.coalesce("page_end", "page_start")
    pages = F.filter(F.when(start.isNull(), F.array().cast("array<int>")).otherwise(F.sequence(F.least(start, end), F.greatest(start, end))), lambda p: p > 0)
    own = sections.select("section_id", "doc_id", _path("toc_path").alias("path"), pages.alias("pages"))
    seen = elements.select("doc_id", F.col("element_id").cast("string").alias("element_ref"), F.lower(F.trim(F.coalesce("kind", F.lit("")))).isin(*ASSET_KINDS).alias("is_asset"), _path("toc_path").alias("path"), F.col("page_no").cast("int").alias("page"), "bbox")
    seen = seen.where("page IS NOT NULL")
    boxed = F.size("bbox") == 4
    known = assets.where(F.trim(F.col("element_ref").cast("string")) != "").select("doc_id", F.col("element_ref").cast("string").alias("element_ref"), "asset_id")
    placed = seen.where("is_asset").join(known, ["doc_id", "element_ref"]).select("doc_id", "asset_id", F.col("path").alias("asset_path"), "page", F.when(boxed, F.get("bbox", F.lit(1))).cast("double").alias("y"))

    by_path = own.join(placed, (own["doc_id"] == placed["doc_id"]) & (own["path"] == placed["asset_path"])).drop(placed["doc_id"])
    by_page = own.withColumn("page", F.explode("pages")).join(placed, ["doc_id", "page"])
    cols = ["section_id", "doc_id", "path", "pages", "asset_id", "asset_path", "page", "y"]
    pairs = by_path.select(*cols).unionByName(by_page.select(*cols)).dropDuplicates(["section_id", "asset_id", "page", "y"])
    here = F.array_contains("pages", F.col("page"))

    keys = ["doc_id", "path", "page"]
    tops = pairs.where(here & F.col("y").isNotNull()).select(*keys, "y").distinct()
    bottoms = seen.where(~F.col("is_asset") & boxed).select(*keys, F.get("bbox", F.lit(3)).cast("double").alias("y")).where("y IS NOT NULL").distinct()
    gaps = nearest(tops, bottoms, keys)
    found = pairs.withColumn("__here", here).join(gaps.withColumn("__here", F.lit(True)), [*keys, "y", "__here"], "left")
    first = F.coalesce(F.array_min("pages"), F.col("page"))
    rank = F.struct((F.col("path") != F.col("asset_path")).cast("int").alias("a"), F.coalesce("gap", F.lit(float("inf"))).alias("b"), F.abs(F.col("page") - first).alias("c"))
    best = found.groupBy("section_id", "asset_id").agg(F.min(rank).alias("rank"))
    place = F.row_number().over(Window.partitionBy("section_id").orderBy("rank", "asset_id"))
    out = best.select("section_id", "asset_id", place.alias("place"))
    return out if most is None else out.where(F.col("place") <= most)
