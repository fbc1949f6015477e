"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accountlake.llm.common import saved


def components(edges: DataFrame) -> DataFrame:
    """``id, root`` for every end of an edge ``a, b`` (long); ``root`` is the smallest id of its component.

    Every round each id takes the smallest root among its neighbours', then the root of its root, so
    long chains halve. Rounds are written to the shared folder. Minima are combined before each shuffle.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = saved(both.where("a <> b").distinct(), "links")
    state = saved(links.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("id"), F.least("a", "m").alias("root")), "roots")
    while True:
        seen = links.join(state.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(
            F.min("root").alias("near")
        )
        nearer = state.join(seen, "id").select("id", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        above = state.select(F.col("id").alias("root"), F.col("root").alias("top"))
        new = nearer.join(above, "root", "left").select("id", "old", F.least("root", F.coalesce("top", "root")).alias("root"))
        new = saved(new, "roots")
        state = new.select("id", "root")
        if new.where("root <> old").isEmpty():
            return state
