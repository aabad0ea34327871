"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, hot_keys, join_dealt, materialize, resting


def components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(a, b) links to (node, component): the smallest node that can be reached, for every node with a link.

    Labels spread along links by minimum and then jump to their label's label, until none changes; each round is written
    out, so plans stay short. Minima are summed map-side, and joins deal the links of a hub, and the members of a large
    component, to several tasks (see join_dealt), so neither is gathered in one. An empty table gives an empty result.
    """
    both = materialize(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")))
    hubs = hot_keys(both, "b")
    for _ in range(max_rounds):
        near = join_dealt(both, labels.withColumnRenamed("node", "b"), "b", hot=hubs).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        closer = materialize(labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component")))
        roots = labels.select(F.col("node").alias("component"), F.col("component").alias("root")).filter("component <> root")
        jumped = materialize(join_dealt(closer, roots, "component", "left").select("node", "was", F.least("component", "root").alias("component")))
        settled = jumped.filter("was <> component").isEmpty()
        discard(labels, closer)
        labels = resting(jumped.select("node", "component"), jumped)
        if settled:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    discard(both)
    return labels
