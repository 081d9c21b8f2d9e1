"""Connected components of a graph given by its links, by alternating large-star and small-star steps.

Before each write every task joins the links it has by itself, a bounded number at a time, so that few rounds are left to do. A node
with more than a HOT part of all links is dealt over SALTS parts of the join; there are 2 / HOT of them at most, which
bounds what is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored

#: Links that a task joins at once, part (and least number) of the links that make a node hot, parts of a hot node.
AT_ONCE, HOT, HOT_LEAST, SALTS = 1 << 17, 1 / 2000, 1000, 32


def least_members(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its class) under the links, for the nodes that aren't the least themselves."""
    names, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(names))
    while True:
        before = label
        low = np.minimum(label[a], label[b])
        label = label.copy()
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        while (label != (onward := label[label])).any():
            label = onward
        if (label == before).all():
            own = label != np.arange(len(names))
            return names[own], names[label[own]]


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= AT_ONCE:
            yield pd.DataFrame(dict(zip("uv", least_members(*_ends(held)), strict=True)))
            held = []
    if held:
        yield pd.DataFrame(dict(zip("uv", least_members(*_ends(held)), strict=True)))


def _ends(held: list[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray]:
    whole = pd.concat(held, ignore_index=True)
    return whole["u"].to_numpy(), whole["v"].to_numpy()


def _star(links: DataFrame, large: bool, total: int) -> DataFrame:
    """Links (u, v), u > v. Large star: each node's larger neighbours move to its least one; small star: the smaller ones and itself."""
    near = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = near.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("m", "u"))
    if total <= HOT_LEAST:  # no node has more links than there are
        moved = near.join(least, "u")
    else:
        hot = F.col("n") > max(HOT_LEAST, total * HOT)
        named = F.broadcast(least.where(hot).select("u", F.lit(True).alias("hot")))
        dealt = near.join(named, "u", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("v"), F.lit(SALTS))).otherwise(0).cast("int"))
        salts = F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        moved = dealt.join(least.withColumn("salt", F.explode(salts)), ["u", "salt"])
    if large:
        out = moved.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(u, v) links -> (node, root): the least node that each linked node reaches. Nodes without links don't appear.

    Each pair of steps is written to the shared folder; only a count and a checksum come to the driver. Null ends
    link nothing.
    """
    ends = links.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v"))).select("u", "v")
    now = stored(ends.mapInPandas(_joined, ends.schema), "links")
    mark = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if tuple(seen) == mark or not seen["n"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = tuple(seen)
        stars = _star(_star(now, True, seen["n"]), False, seen["n"])
        now = stored(stars.mapInPandas(_joined, now.schema), "links")
