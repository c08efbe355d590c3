"""Connected components of a graph given as a table of links, by alternating
large-star and small-star rounds (Kiveris et al., 2014). Links stay in tables;
the driver sees one count and one checksum a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _round(links: DataFrame, large: bool) -> DataFrame:
    """Links (u > v). Each node hooks its larger (large) or smaller neighbours,
    and in the small round itself, to the smallest node it sees."""
    near = _both_ways(links) if large else links
    least = near.groupBy("u").agg(F.min("v").alias("m"))
    if large:
        least = least.select("u", F.least("u", "m").alias("m"))
        out = near.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
            least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(u, v) links of longs -> (node, root): root is the smallest node of the
    component; a row for every node but the roots."""
    links = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                    .where(F.col("u") != F.col("v")).distinct(), "links")
    state = None
    while True:
        mark = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if not mark[0] or mark == state:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = mark
        links = written(_round(_round(links, True), False), "links")
