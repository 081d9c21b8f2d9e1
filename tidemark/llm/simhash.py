"""SimHash near-duplicates: fingerprints, BK-trees over their shards, and classes of linked fingerprints.

A fingerprint has a bit set where over half of the text's shingle hashes (XXH64, seed 42) have it set. Equal
fingerprints are one node. Two fingerprints with at most `radius` differing bits agree on some `blocks - radius` of
`blocks` blocks of bits whole, so each is put into the shards of all such choices of blocks and its neighbours are sought
there only: no link is missed, and no shard sees more than those that agree on its bits. The fingerprints of a shard with more than
SHARD of them are dealt anew by a finer cut, which is exact for the same reason; in shards of the last cut all but twelve bits agree, so no shard that is
searched has more than SHARD. Every shard has a
BK-tree, whose children are keyed by their Hamming distance to the parent; a search goes on only along edges within the
radius of the distance just measured. The shards' trees would have to hold all fingerprints to be sent to every task, so the
fingerprints go to the trees instead. A shard yields a link of each fingerprint to one other at most, not its pairs.

Defined cases: carried columns named fp are replaced; very long texts are signed whole; a text without words, or null, has fingerprint 0 and links like any other; repeated rows share a
class; a null id is passed over as the name of a class if another id can be had; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import Aside, stored

BITS = 64
#: Words of a shingle, differing bits of a link, blocks that the bits are cut into (finer for what is left of large shards), most fingerprints of a shard.
SHINGLE, RADIUS, BLOCKS, SHARD = 3, 3, (5, 9, 16), 1 << 12
_PAIRS = 1 << 21  # pairs of a search and a node that are measured at once
_UNPACK = 1 << 17  # hashes whose bits are laid out at once


def shingle_hashes(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle, repeats included; of all words if they are fewer, of nothing if there are none."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1]
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of shingle hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _UNPACK):
        part = np.unpackbits(hashes[at : at + _UNPACK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += part.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of one text."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs(text, ...) -> the carried columns and fp, the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            found = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found.view(np.int64))], names=[*batch.schema.names[:-1], "fp"])

    aside = Aside(docs, ("text",), ("fp",), carry)
    schema = "".join(f"`{c}` {aside.rows.schema[c].dataType.simpleString()}, " for c in aside.carry)
    return aside.restored(aside.rows.select(*aside.carry, F.col("text").cast("binary").alias("_body")).mapInArrow(run, f"{schema}fp bigint"), "fp")


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), BITS // 4, "0"))


class Forest:
    """The BK-trees of many shards: arrays of nodes, the children of a node side by side in order of their edge.

    shards: the shard of each value, equal ones together; values: distinct within a shard.
    """

    def __init__(self, shards: np.ndarray, values: np.ndarray):
        self.values = values
        n = len(values)
        self.root = np.zeros(n, np.int64)
        first = np.flatnonzero(np.concatenate(([True], shards[1:] != shards[:-1]))) if n else np.zeros(0, np.int64)
        self.root = np.repeat(first, np.diff(np.append(first, n)))
        parent, edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        # A level at a time: each value hangs below its current node, and the first of those with one edge becomes the child.
        rest = np.flatnonzero(self.root != np.arange(n))
        at = self.root[rest]
        while len(rest):
            d = np.bitwise_count(values[rest] ^ values[at]).astype(np.int64)
            key = at * (BITS + 1) + d
            order = np.argsort(key, kind="stable")
            key, rest, at, d = key[order], rest[order], at[order], d[order]
            new = np.concatenate(([True], key[1:] != key[:-1]))
            child = rest[new]
            parent[child], edge[child] = at[new], d[new]
            at = np.repeat(child, np.diff(np.append(np.flatnonzero(new), len(key))))
            rest, at = rest[~new], at[~new]
        self.by_parent = np.lexsort((edge, parent))
        self.key = parent[self.by_parent] * (BITS + 1) + edge[self.by_parent]

    def near(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(i, j), i > j, of values in one shard with at most radius differing bits, as they are found."""
        queue = [(np.arange(len(self.values)), self.root)]
        while queue:
            asked, node = queue.pop()
            if len(asked) > _PAIRS:
                queue += [(asked[k : k + _PAIRS], node[k : k + _PAIRS]) for k in range(0, len(asked), _PAIRS)]
                continue
            d = np.bitwise_count(self.values[asked] ^ self.values[node]).astype(np.int64)
            hit = (d <= radius) & (asked > node)
            if hit.any():
                yield asked[hit], node[hit]
            low = np.searchsorted(self.key, node * (BITS + 1) + np.maximum(d - radius, 0))
            high = np.searchsorted(self.key, node * (BITS + 1) + np.minimum(d + radius, BITS), side="right")
            n = high - low
            if total := int(n.sum()):
                flat = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
                queue.append((np.repeat(asked, n), self.by_parent[flat]))


def joined(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least member of each value's class under the pairs."""
    parent = np.arange(n)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = int(parent[x])
        return x

    for left, right in pairs:
        for a, b in zip(left.tolist(), right.tolist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return np.fromiter((find(i) for i in range(n)), np.int64, n)


def shard_links(batches: Iterator[pd.DataFrame], links: Callable[[pd.DataFrame], pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows with a shard column, those of a shard together, -> what links makes of runs of whole shards."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        # The last shard of a batch may go on in the next.
        last = batch["shard"].iloc[-1] if len(batch) else None
        whole = batch[batch["shard"] != last]
        if len(whole):
            yield links(pd.concat([*held, whole], ignore_index=True))
            held = []
        held.append(batch[batch["shard"] == last])
    if held:
        yield links(pd.concat(held, ignore_index=True))


def shards_of(fp: Column, radius: int, blocks: int) -> Column:
    """The shards of a fingerprint: one for each choice of blocks - radius blocks, by their bits."""
    cut = [BITS * k // blocks for k in range(blocks + 1)]
    bits = [(1 << b) - (1 << a) for a, b in zip(cut, cut[1:], strict=False)]
    masks = [sum(chosen) for chosen in combinations(bits, blocks - radius)]
    signed = F.array(*[F.lit(m - (1 << BITS) if m >> (BITS - 1) else m).cast("long") for m in masks])
    return F.transform(signed, lambda m: F.xxhash64(m, fp.bitwiseAND(m)))


def near_links(nodes: DataFrame, radius: int = RADIUS, blocks: tuple[int, ...] = BLOCKS, most: int = SHARD) -> DataFrame:
    """nodes(fp), distinct -> links (u, v) with the same classes as all pairs within the radius."""

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        values = rows["fp"].to_numpy()
        root = joined(len(values), Forest(rows["shard"].to_numpy(), values.view(np.uint64)).near(radius))
        own = root != np.arange(len(values))
        return pd.DataFrame({"u": values[own], "v": values[root[own]]})

    rest, found = nodes, None
    for level, cut in enumerate(blocks):
        spread = rest.select("fp", F.explode(shards_of(F.col("fp"), radius, cut)).alias("shard"))
        large = None
        if level + 1 < len(blocks):
            large = stored(spread.groupBy("shard").count().where(F.col("count") > most).select("shard"), "large-shards")
            large = None if large.isEmpty() else large
        dealt = (spread if large is None else spread.join(large, "shard", "left_anti")).repartition("shard").sortWithinPartitions("shard", "fp")
        own = dealt.mapInPandas(lambda batches: shard_links(batches, links), "u bigint, v bigint")
        found = own if found is None else found.unionByName(own)
        if large is None:
            return found
        rest = stored(spread.join(large, "shard", "left_semi").select("fp").distinct(), "rest")
    return found


def near_classes(prints: DataFrame, radius: int = RADIUS, blocks: tuple[int, ...] = BLOCKS, most: int = SHARD) -> DataFrame:
    """prints(doc_id, fp, ...) with component_id: the least id of all documents reachable over links."""
    kept = stored(prints, "fingerprints")
    nodes = stored(kept.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "nodes")
    roots = components(near_links(nodes.select("fp"), radius, blocks, most))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = rooted.join(named, "root").select("fp", "component_id")
    return kept.join(classes, "fp")
