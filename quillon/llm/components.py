"""Connected components of a link table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialise


def components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(a, b) links between ids to (v, c): each linked id and the smallest id that it reaches.

    Every round each vertex takes the smallest label of itself and its
    neighbours, then the label of that label; the table is written to the shared
    folder, which cuts lineage.  Only the number of changed labels reaches the
    driver.  Links of an id to itself and repeated links do no harm; links with
    a null end are left out; without links the result is empty.
    """
    ends = links.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = materialise(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = materialise(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("c")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels, F.col("b") == F.col("v")).groupBy("a").agg(F.min("c").alias("low"))
        lower = materialise(labels.join(near, F.col("v") == F.col("a")).select("v", "c", F.least("c", "low").alias("low")), "lower")
        jump = lower.select(F.col("v").alias("via"), F.col("low").alias("end"))
        after = materialise(lower.join(jump, F.col("low") == F.col("via")).select("v", F.col("c").alias("old"), F.col("end").alias("c")), "labels")
        changed = after.where("old <> c").limit(1).count()
        labels = after.select("v", "c")
        if not changed:
            return labels
    raise RuntimeError(f"labels still change after {max_rounds} rounds")
