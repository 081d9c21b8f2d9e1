"""URL filters: a cascade of Bloom filters over the complete universe of keys, and rules by host and path.

Level 1 of a cascade holds the listed keys. Level 2 holds the keys of the universe that level 1 takes for listed and that
aren't, level 3 the listed ones that level 2 takes, and so on until a level takes nothing by mistake. A key of the universe
is judged by the first level that doesn't hold it: listed if that is an even one. So membership is exact, in a
few bits a key, and no page is joined to a list.

The universe is cut into shards by hash, each with a cascade of its own that one task builds from some SHARD_KEYS keys.
All cascades go to the tasks by broadcast if their measured bytes are within LIMIT (some fifty million listed keys); otherwise the pages are dealt to
the shards, those of a hot shard to several parts of about PART_ROWS rows by their place in the table, and each task takes the cascade of its own shard.

Defined cases: a null url, or one without `://`, has an empty host and path, which no rule fits and which is a key like
any other; a key outside the universe (none here: it is taken from the same table) may be taken for listed; without listed keys every
key is allowed; repeated rows are judged each for itself; urls of any length are judged whole; an empty table gives an empty result; other columns
pass through, but for those named like a result (in any case), which it replaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Aside, lowered, stored

#: (verdict, host, path start).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Keys of a shard, most bytes of all cascades for a broadcast, bits a key of levels after the first, pages of a part of a shard.
SHARD_KEYS, LIMIT, LATER_BITS, PART_ROWS = 200_000, 64 << 20, 2, 100_000
RESULTS = ("host", "path", "rule", "listed", "verdict")
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def host_of(url: Column) -> Column:
    return F.coalesce(lowered(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest rule that fits, as a struct (rule, verdict), or null."""
    out = F.lit(None)
    for verdict, rule_host, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(rule_host + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


class Bloom:
    """A Bloom filter of 64-bit keys; level makes the hashes of one level independent of another's."""

    def __init__(self, bits: int, hashes: int, level: int, data: np.ndarray | None = None):
        self.size, self.hashes, self.level = max(8, -(-bits // 8) * 8), max(1, hashes), level
        self.data = np.zeros(self.size // 8, np.uint8) if data is None else data

    def _places(self, keys: np.ndarray) -> np.ndarray:
        x = keys ^ np.uint64(0x9E3779B97F4A7C15 * (self.level + 1) % 2**64)
        for m in _MIX:
            x = (x ^ (x >> np.uint64(29))) * m
        low, high = x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1)
        return ((low[:, None] + np.arange(self.hashes, dtype=np.uint64) * high[:, None]) % np.uint64(self.size)).astype(np.int64)

    def add(self, keys: np.ndarray) -> None:
        at = self._places(keys).ravel()
        np.bitwise_or.at(self.data, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = self._places(keys)
        return ((self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def build_cascade(listed: np.ndarray, others: np.ndarray) -> list[Bloom]:
    """Levels for distinct keys, the listed ones and the rest of the universe."""
    levels: list[Bloom] = []
    into, against = listed, others
    while len(into):
        # The first level is as sharp as the ratio of the sides asks for; a later one halves what is left, at least.
        bits = LATER_BITS if levels else max(2.0, 1.44 * np.log2(max(2.0, len(against) / len(into))) + 1)
        level = Bloom(int(bits * len(into)) + 8, round(bits * 0.69), len(levels))
        level.add(into)
        levels.append(level)
        into, against = against[level.has(against)], into
    return levels


def judge(levels: list[Bloom], keys: np.ndarray) -> np.ndarray:
    """Whether each key is listed."""
    listed = np.zeros(len(keys), bool)
    rest = np.arange(len(keys))
    for k, level in enumerate(levels):
        held = level.has(keys[rest])
        listed[rest[~held]] = k % 2 == 1
        rest = rest[held]
    listed[rest] = len(levels) % 2 == 1
    return listed


_LEVELS = "shard bigint, level int, size bigint, hashes int, data binary"


def keyed_universe(universe: DataFrame, listed: DataFrame) -> tuple[DataFrame, int]:
    """(host) of both, repeats allowed -> distinct (key, listed), and the seed under which no key stands for hosts of both kinds."""
    marked = universe.select("host", F.lit(0).alias("listed")).unionByName(listed.select("host", F.lit(1).alias("listed")))
    hosts = stored(marked.groupBy("host").agg(F.max("listed").alias("listed")), "url-hosts")
    seed = 0
    while True:
        keys = stored(hosts.groupBy(key_of(seed).alias("key")).agg(F.max("listed").alias("listed"), F.min("listed").alias("least")), "url-keys")
        if keys.where("listed <> least").isEmpty():
            return keys.drop("least"), seed
        seed += 1


def key_of(seed: int) -> Column:
    return F.xxhash64("host", F.lit(seed))


def cascades(keys: DataFrame, shards: int) -> DataFrame:
    """Distinct (key, listed) -> a row for each level of each shard's cascade."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        values = rows["key"].to_numpy().view(np.uint64)
        mine = rows["listed"].to_numpy() == 1
        levels = build_cascade(values[mine], values[~mine])
        return pd.DataFrame(
            {"shard": rows["shard"].iloc[0], "level": [x.level for x in levels], "size": [x.size for x in levels], "hashes": [x.hashes for x in levels], "data": [x.data.tobytes() for x in levels]}
        )

    return keys.withColumn("shard", F.pmod("key", F.lit(shards))).groupBy("shard").applyInPandas(build, _LEVELS)


def _by_shard(rows: list) -> dict[int, list[Bloom]]:
    out: dict[int, list[Bloom]] = {}
    for r in sorted(rows, key=lambda r: (r["shard"], r["level"])):
        out.setdefault(r["shard"], []).append(Bloom(r["size"], r["hashes"], r["level"], np.frombuffer(bytes(r["data"]), np.uint8)))
    return out


def _judged(batches: Iterator[pa.RecordBatch], levels: dict[int, list[Bloom]], shards: int) -> Iterator[pa.RecordBatch]:
    """Adds listed to batches whose last column is the key."""
    for batch in batches:
        keys = batch.column(batch.num_columns - 1).to_numpy()
        shard, listed = keys % shards, np.zeros(len(keys), bool)
        for s in np.unique(shard).tolist():
            own = np.flatnonzero(shard == s)
            listed[own] = judge(levels.get(s, []), keys[own].view(np.uint64))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(listed)], names=[*batch.schema.names[:-1], "listed"])


def filter_urls(pages: DataFrame, universe: DataFrame, listed: DataFrame, rules: tuple = RULES, limit: int = LIMIT, shard_keys: int = SHARD_KEYS, part_rows: int = PART_ROWS) -> DataFrame:
    """pages(url, ...) with host, path, rule, listed, verdict; universe(host) and listed(host) give the keys of the cascade."""
    aside = Aside(pages, ("url",), RESULTS)
    rows = aside.rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    keys, seed = keyed_universe(universe, listed)
    shards = max(1, -(-keys.count() // shard_keys))
    levels = stored(cascades(keys, shards), "url-cascades")
    size = levels.agg(F.coalesce(F.sum(F.length("data") + 40), F.lit(0)).alias("n")).first()["n"]
    keyed = rows.withColumn("_key", key_of(seed))
    names = keyed.columns[:-1]
    schema = keyed.select(*names, F.lit(True).alias("listed")).schema
    if size <= limit:
        shared = pages.sparkSession.sparkContext.broadcast(_by_shard(levels.collect()))
        judged = keyed.mapInArrow(lambda batches: _judged(batches, shared.value, shards), schema)
    else:

        def own(pages_of_part: pd.DataFrame, levels_of_shard: pd.DataFrame) -> pd.DataFrame:
            held = next(iter(_by_shard(levels_of_shard.to_dict("records")).values()), [])
            return pages_of_part[names].assign(listed=judge(held, pages_of_part["_key"].to_numpy().view(np.uint64)))

        # A row a shard, of some hundred thousand keys each.
        dealt = keyed.withColumn("_shard", F.pmod("_key", F.lit(shards)))
        parts = stored(dealt.groupBy("_shard").agg(F.ceil(F.count("*") / part_rows).alias("_parts")), "shard-parts")
        dealt = dealt.join(F.broadcast(parts), "_shard").withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.col("_parts")))
        own_parts = parts.select(F.col("_shard").alias("shard"), F.col("_parts").alias("parts"))
        spread = levels.join(F.broadcast(own_parts), "shard").withColumn("_shard", F.col("shard")).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
        judged = dealt.groupBy("_shard", "_part").cogroup(spread.groupBy("_shard", "_part")).applyInPandas(own, schema)
    ruled = judged.withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("listed"), "block").otherwise("allow"))
    return aside.restored(ruled, "host", "path", F.col("_rule.rule").alias("rule"), "listed", verdict.alias("verdict"))
