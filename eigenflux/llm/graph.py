"""Connected components by alternating large and small stars, in DataFrame operations only.

Up to ``SMALL`` links between whole numbers, which are 8 MB, are joined on the driver: stars would take dozens of shuffles of next to nothing.
Each step joins the links with every node's least neighbour; nothing is gathered by node, so a node with very many links
is as good as any other (Spark splits its join). Steps are written to the shared folder and end when every link goes from
a node of one link to a root, which no step would change.

Null ends and loops are left out, repeated links count once, no links give no rows; columns but ``a`` and ``b`` are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eigenflux.llm import common

#: Most links that are joined on the driver.
SMALL = 1 << 19


def _settled(links: DataFrame) -> bool:
    """Whether no node is the larger end of several links, or of one and the smaller end of others."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(links.select("b", F.lit(0), F.lit(1)))
    by = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return by.where("up > 1 or (up = 1 and down = 1)").limit(1).count() == 0


def _joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the least node that each reaches: the least label of neighbours, then of labels, until all agree."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(open_ := np.flatnonzero(label[x] != label[y])):
        x, y = x[open_], y[open_]
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        np.minimum.at(label, high, low)  # labels are roots, so whole trees are hung on lesser ones
        while (label[label] != label).any():
            label = label[label]
    return nodes, nodes[label]


def components(links: DataFrame, *, most_steps: int = 60, small: int = SMALL) -> DataFrame:
    """``node`` and ``component`` (least node reachable) of every node in ``links(a, b)``, written to the shared folder."""
    with common.scratch() as scope:
        links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        links = common.materialize(links, "components")
        whole = all(isinstance(f.dataType, T.LongType) for f in links.schema.fields)
        count = links.count()
        if whole and 0 < count <= small:
            got = links.toArrow()
            nodes, least = _joined(*(got.column(c).to_numpy() for c in ("a", "b")))
            found = links.sparkSession.createDataFrame(pa.table({"node": nodes, "component": least}))
            return scope.result(found, "components")
        for _ in range(most_steps):
            if not count or _settled(links):
                break
            both = links.union(links.select("b", "a"))
            least = both.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("m"))
            large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()  # b is the larger end
            # every link of ``large`` goes from a larger node to a smaller one
            small_least = large.groupBy("a").agg(F.min("b").alias("m"))
            stars = large.join(small_least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            new = common.materialize(stars.union(small_least.select("a", F.col("m").alias("b"))).distinct(), "components")
            common.discard(links)
            links = new
        else:
            raise RuntimeError("components did not settle")
        roots = links.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
        return scope.result(links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots), "components")
