"""Page sources (S1-S3): text of HTML pages, and which images of a page listing are content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import strip


def html_text(html: Column) -> Column:
    """Text without scripts, styles, comments and tags; runs of blanks become one."""
    bare = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    return strip(F.regexp_replace(F.regexp_replace(bare, "<[^>]*>", " "), "[ \t]+", " "))


def content_images(images: DataFrame, most_listings: int = 3, least_side: int = 150, most_aspect: float = 8.0) -> DataFrame:
    """Rows (page, ordinal, xref, width, height, digest) without images that are listed on several pages, small or very oblong
    ones, and repeats of a digest (the first by page and ordinal stays)."""
    listed = images.groupBy("xref").agg(F.count("*").alias("n")).where(F.col("n") >= most_listings).select("xref")
    sized = images.join(listed, "xref", "left_anti").where((F.least("width", "height") >= least_side) & (F.greatest("width", "height") <= most_aspect * F.least("width", "height")))
    return sized.withColumn("place", F.row_number().over(Window.partitionBy("digest").orderBy("page", "ordinal"))).where("place = 1").drop("place")


def rendered_pages(pages: DataFrame, least_side: int = 200) -> DataFrame:
    """S3's predicate: rasters too small to hold a chart go."""
    return pages.where(F.least("width", "height") >= least_side)
