"""Connected components of a table of links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from banfleet.llm.workers import discard, written


def _least(links: DataFrame) -> DataFrame:
    """Links (a, b) with the least of a and its neighbours as m; combined before the shuffle."""
    low = links.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return links.join(low, "a")


def components(links: DataFrame) -> DataFrame:
    """Rows (id, component) for every id in ``links`` (a, b); component is the least id reachable.

    Large-star and small-star rounds: each round hangs neighbours on the least id around, until
    every id hangs on its component's least. The number of rounds grows with the logarithm of a
    component's size, and no round holds a component or a neighbourhood in one place. Links from an
    id to itself, or with a null end, count for nothing.
    """
    stars = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _least(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        joined = _least(large)
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(joined.select("a", F.col("m").alias("b"))).distinct()
        before, stars = stars, written(small, "links")
        discard(before)
        found = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found == state:
            break
        state = found
    roots = stars.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return stars.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
