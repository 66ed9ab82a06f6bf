"""Connected components of links between numbered items, by repeated joins.

Every item points to the smallest item it knows. A round lets each item learn the smallest
pointer among its neighbours and then follows pointers twice, so chains shrink quickly. Each
round is written to the shared folder, which keeps plans short and survives lost executors.
Only one number, how many pointers changed, comes back to the driver, with the write.

Cases: an item without links is not part of the result; a link of an item with itself changes
nothing; repeated links count once; null ends are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from factorloom.session import materialize

ROUNDS = 64  # a chain of n items takes about log2(n)


def connected(links: DataFrame, one: str, other: str) -> DataFrame:
    """(item, component): the smallest item reachable from each linked item."""
    links = links.select(F.col(one).alias("a"), F.col(other).alias("b")).dropna().filter("a <> b")
    both = links.union(links.select("b", "a")).distinct()
    # a star around the smallest neighbour says as much as all links of an item do
    state = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("p"))
    both, state = materialize(both, "links"), materialize(state, "parents")
    for _ in range(ROUNDS):
        told = both.join(state.withColumnRenamed("a", "x"), both["b"] == F.col("x"))
        told = told.groupBy("a").agg(F.min("p").alias("q"))
        # what an item learns is also told to its parent, so whole trees move at once
        learned = told.join(state, "a").filter("q < p")
        ends = F.explode(F.array("a", "p")).alias("a")
        offers = learned.select(ends, "q").groupBy("a").agg(F.min("q").alias("q"))
        moved = state.join(offers, "a", "left").select("a", F.least("p", F.coalesce("q", "p")).alias("p"), "q")
        seen = Observation()
        moved = materialize(moved.observe(seen, F.count("q").alias("changed")), "moved")
        if not seen.get["changed"]:
            return state.withColumnsRenamed({"a": "item", "p": "component"})
        up = moved.select(F.col("a").alias("x"), F.col("p").alias("y"))
        jumped = moved.drop("q").join(up, F.col("p") == F.col("x"), "left")
        state = materialize(jumped.select("a", F.coalesce("y", "p").alias("p")), "parents")
    raise RuntimeError("components did not settle")
