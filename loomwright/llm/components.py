"""Connected components by large and small stars, over tables of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize


#: The neighbours of a node are dealt into so many shares, so that a node with very many isn't one task's work.
SHARES = 64


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links (u, v) with each node's neighbours tied to its smallest neighbour: the greater ones, or the smaller ones."""
    both = links.unionByName(links.selectExpr("v AS u", "u AS v")) if large else links
    both = both.withColumn("share", F.pmod(F.xxhash64("v"), F.lit(SHARES)))
    shares = both.groupBy("u", "share").agg(F.min("v").alias("m"))
    least = shares.groupBy("u").agg(F.least(F.min("m"), F.col("u")).alias("m"))
    tied = both.join(shares.select("u", "share").join(least, "u"), ["u", "share"])
    if large:
        return tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.selectExpr("u", "m AS v"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes in links (u, v), both BIGINT; a component is named by its smallest node.

    Every round is written to the shared folder; the rounds end when the links stay as they are. Nodes with very many
    links are handled by counting and joining, not by gathering their neighbours.
    """
    now = materialize(links.selectExpr("greatest(u, v) AS u", "least(u, v) AS v").where("u > v").distinct(), "links")
    mark = None
    while True:
        stars = _star(_star(now, True), False).where("u > v").distinct()
        new = materialize(stars, "links")
        check = new.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        forget(now)
        now = new
        if check == mark:
            break
        mark = check
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
