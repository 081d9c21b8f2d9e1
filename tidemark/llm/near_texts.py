"""Near-duplicate texts by SimHash for the pipeline: five-word shingles, a similarity of 0.8 or more.

At that similarity 64-bit fingerprints differ in some ten bits, too many to seek by equal blocks. So the shards whose BK-trees are
searched are keyed otherwise: by pairs of least shingle hashes under KEYS orders, which texts of similarity J share with
probability J * J each (at 0.8, all keys fail for one pair in 200,000). Within a shard the tree is searched with a
wide radius, and what it finds is proposed at an estimate of J of PROPOSED, from LANES least hashes (its deviation is 0.035 at 0.8).
What proposals connect is a cluster. The texts of a cluster then meet, and those are linked whose shingle sets have J >= 0.8 exactly.

No task holds a large group. A shard of more than SHARD texts isn't searched: all of it is one cluster. A cluster of more than BLOCK
texts is dealt over blocks of about that size, and of each class found in a block only the row that would stay goes on, to
other blocks in the next round, until that gains little. Then every text outside the cluster's greatest class meets all of its texts, in blocks of half as many again
or HEAVY bytes; a task yields a link of each text to one other at most, not the pairs. So within a cluster no link is missed.

What keys, radius and sketch miss between clusters is added exactly: of two sets with J >= 0.8, in any one order of all shingles, the first ninth of the smaller
shares a shingle with the first fifth of the larger. So texts of different clusters meet by these shingles, rare ones first,
and pairs that size, place and then the parities of their sets leave possible are compared whole. The order is by a count of the shingles
that a task meets repeatedly; it decides how many pairs are compared, never which are found.

Defined cases: equal texts, A-Z lower-cased, are one text from the start; texts without words are one class; of a class
the row with the least id stays (null ids last), and one of its repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import Aside, lowered, stored
from .simhash import Forest, joined, majority, shard_links, shingle_hashes

#: Words of a shingle, radius of the search, least estimate of a proposal, shard keys of a text, hashes of its sketch.
SHINGLE, RADIUS, PROPOSED, KEYS, LANES = 5, 24, 0.64, 12, 128
#: The similarity of a link, as a fraction; most texts of a shard that is searched, texts of a block, least shrinkage for another round.
SIMILAR, SHARD, BLOCK, GAIN = (4, 5), 512, 256, 0.9
#: Bytes of a block of texts that meet across classes, fewest and most bits of a set's parities.
HEAVY, PARITIES = 4 << 20, (256, 1 << 14)
#: Shingles that are counted at once, least count of a common one, most common ones that are put last in the order, rows that meet at once, hashes of sets that are kept.
COUNTED, COMMON, MOST_COMMON, MET, KEPT = 1 << 20, 8, 1 << 17, 1 << 16, 1 << 19
_RNG = np.random.Generator(np.random.PCG64(5))
_BY = _RNG.integers(0, 1 << 31, LANES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _RNG.integers(0, 1 << 32, LANES, dtype=np.uint64).astype(np.uint32)
_AT_ONCE = 2048


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The least value of the shingle hashes under each order."""
    least = np.full(LANES, 0xFFFFFFFF, np.uint32)
    folded = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    for at in range(0, len(folded), _AT_ONCE):
        values = folded[at : at + _AT_ONCE, None] * _BY + _PLUS
        np.minimum(least, (values ^ (values >> np.uint32(15))).min(axis=0), out=least)
    return least


def shard_keys(least: np.ndarray) -> list[int]:
    pairs = least[: 2 * KEYS].astype(np.uint64).reshape(KEYS, 2)
    mixed = ((pairs[:, 0] << np.uint64(32)) | pairs[:, 1]) * np.uint64(0x9E3779B97F4A7C15) + np.arange(KEYS, dtype=np.uint64)
    return mixed.view(np.int64).tolist()


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimates of J from rows of sketches' low bytes, of which one in 256 agrees by chance."""
    agree = (a == b).mean(axis=1)
    return (agree - 1 / 256) / (1 - 1 / 256)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # Each shingle once, as the similarity is one of sets: a line repeated often may not outvote the rest.
        hashes = [np.unique(shingle_hashes(t.as_py(), SHINGLE)) for t in batch.column(1)]
        least = [sketch(h) for h in hashes]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(np.array([majority(h) for h in hashes], np.uint64).view(np.int64)),
                pa.array([x.astype(np.uint8).tobytes() for x in least], pa.binary()),
                pa.array([shard_keys(x) for x in least], pa.list_(pa.int64())),
            ],
            names=["content", "fp", "sketch", "shards"],
        )


def _proposed(rows: pd.DataFrame) -> pd.DataFrame:
    """Links of each text to one other at most, which connect what the search finds in the shards."""
    values = rows["fp"].to_numpy().view(np.uint64)
    lanes = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(len(rows), LANES)
    label = np.arange(len(rows))

    def accepted() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        nonlocal label
        for left, right in Forest(rows["shard"].to_numpy(), values).near(RADIUS):
            for at in range(0, len(left), 1 << 15):
                i, j = left[at : at + (1 << 15)], right[at : at + (1 << 15)]
                apart = label[i] != label[j]
                i, j = i[apart], j[apart]
                good = similarity(lanes[i], lanes[j]) >= PROPOSED
                i, j = i[good], j[good]
                yield i, j
                # Labels of what is joined so far, by the lesser one, a step at a time.
                for a, b in zip(i.tolist(), j.tolist(), strict=True):
                    if label[a] != label[b]:
                        low, high = sorted((label[a], label[b]))
                        label[label == high] = low

    root = joined(len(rows), accepted())
    own = root != np.arange(len(rows))
    names = rows["content"].to_numpy()
    return pd.DataFrame({"u": names[own], "v": names[root[own]]})


def _same(bodies: list[bytes]) -> np.ndarray:
    """The first text of each text's class under J >= SIMILAR of the shingle sets, by exact counts."""
    sets = [np.unique(shingle_hashes(b, SHINGLE)) for b in bodies]
    size = np.array([len(x) for x in sets])
    _, numbers = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    ends = np.cumsum(size)
    root, marked = np.full(len(sets), -1), np.zeros(int(size.sum()), bool)
    for first in range(len(sets)):
        if root[first] >= 0:
            continue
        root[first], todo = first, [first]
        while todo:
            i = todo.pop()
            own = numbers[ends[i] - size[i] : ends[i]]
            marked[own] = True
            shared = np.bincount(owner[marked[numbers]], minlength=len(sets))
            marked[own] = False
            like = np.flatnonzero((root < 0) & (shared * SIMILAR[1] >= (size + size[i] - shared) * SIMILAR[0]))
            root[like] = first
            todo += like.tolist()
    return root


def _linked(rows: pd.DataFrame) -> pd.DataFrame:
    """Of whole shards with (shard, content, body): the link of each text to the first of its class."""
    shards, names, bodies = rows["shard"].to_numpy(), rows["content"].to_numpy(), rows["body"].to_list()
    cuts = np.flatnonzero(np.concatenate(([True], shards[1:] != shards[:-1], [True])))
    root = np.concatenate([a + _same(bodies[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)])
    own = root != np.arange(len(rows))
    return pd.DataFrame({"u": names[own], "v": names[root[own]]})


def _meet(members: DataFrame) -> DataFrame:
    """members(shard, content, first, body) -> links (u, v) of texts to the first of their class within the shard."""
    spread = members.select("shard", "first", "content", "body").repartition("shard").sortWithinPartitions("shard", "first", "content")
    return spread.select("shard", "content", "body").mapInPandas(lambda batches: shard_links(batches, _linked), "u string, v string")


def parities(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """Of each set, whether the number of its hashes on each of so many places is odd. Two sets have as many differing hashes at least as these have differing bits."""
    odd = np.zeros((len(sets), bits // 64), np.uint64)
    for row, hashes in zip(odd, sets, strict=True):
        at = hashes >> np.uint64(40)
        np.bitwise_xor.at(row, ((at >> np.uint64(6)) % np.uint64(len(row))).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return odd


def width(size: int) -> int:
    """The bits of the parities of a set of a size."""
    return int(np.clip(1 << int(4 * size).bit_length(), *PARITIES))


def may_be_alike(apart: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Of rows of parities' differences and sums of two sets' sizes, whether J >= SIMILAR is possible: a / b leaves (b - a) / (b + a) of both sizes to differ."""
    a, b = SIMILAR
    return np.bitwise_count(apart).sum(axis=-1, dtype=np.int64) * (b + a) <= both * (b - a)


def _across(rows: pd.DataFrame) -> pd.DataFrame:
    """Of whole shards with (shard, few, content, root, body): links that connect all roots with near-duplicates between them, of those with few and the others, or among themselves if there are no others."""
    shards, links = rows["shard"].to_numpy(), []
    cuts = np.flatnonzero(np.concatenate(([True], shards[1:] != shards[:-1], [True])))
    for start, end in zip(cuts, cuts[1:], strict=False):
        part = rows.iloc[start:end]
        few, names = part["few"].to_numpy(), part["content"].to_numpy()
        label = np.unique(part["root"].to_numpy(), return_inverse=True)[1]
        if not few.any() or label.max() == 0:
            continue
        mixed, at = not few.all(), np.arange(len(part))
        sets = [np.unique(shingle_hashes(b, SHINGLE)) for b in part["body"]]
        size = np.array([len(x) for x in sets])
        odd = parities(sets, width(size.max()))
        for i in np.flatnonzero(few).tolist():
            near = np.flatnonzero((~few if mixed else at > i) & (label != label[i]) & (np.minimum(size, size[i]) * SIMILAR[1] >= np.maximum(size, size[i]) * SIMILAR[0]))
            for j in near[may_be_alike(odd[near] ^ odd[i], size[near] + size[i])].tolist():
                if label[j] != label[i] and alike(sets[i], sets[j]):
                    links.append((names[i], names[j]))
                    label[label == label[j]] = label[i]
    return pd.DataFrame(links, columns=["u", "v"], dtype=object)


def alike(one: np.ndarray, two: np.ndarray) -> bool:
    """Whether two sets of hashes, sorted, have J >= SIMILAR."""
    if not len(one) or not len(two):
        return len(one) == len(two)
    shared = int((two[np.minimum(np.searchsorted(two, one), len(two) - 1)] == one).sum())
    return shared * SIMILAR[1] >= (len(one) + len(two) - shared) * SIMILAR[0]


def _classes(members: DataFrame) -> DataFrame:
    """members(content, cluster, first, body) -> links (u, v) that connect all near-duplicates within each cluster."""
    members = stored(members, "members")
    large = stored(members.groupBy("cluster").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("cluster"), "large")
    found = _meet(members.join(large, "cluster", "left_anti").withColumn("shard", F.xxhash64("cluster")))
    if large.isEmpty():
        return found
    inside = members.join(large, "cluster")
    rest, before, links = inside, float("inf"), []
    while True:
        sizes = stored(rest.groupBy("cluster").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
        n = sizes.agg(F.sum("n")).first()[0]
        if not n or n > GAIN * before:
            break
        before = n
        block = F.pmod(F.xxhash64("content", F.lit(len(links))), F.ceil(F.col("n") / BLOCK))
        links.append(stored(_meet(rest.join(sizes, "cluster").withColumn("shard", F.xxhash64("cluster", block))), "met"))
        rest = rest.join(links[-1].select(F.col("u").alias("content")), "content", "left_anti")
    within = links[0]
    for more in links[1:]:
        within = within.unionByName(more)
    roots = stored(components(within).withColumnsRenamed({"node": "content"}), "within")
    rooted = inside.select("cluster", "content", "body").join(roots, "content", "left").withColumn("root", F.coalesce("root", "content"))
    own = rooted.groupBy("cluster", "root").agg(F.count("*").alias("n"), F.sum(F.length("body")).alias("size"))
    whole = own.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.max_by(F.struct("root", "n", "size"), F.struct("n", "root")).alias("main")).where("n > main.n")
    blocks = lambda n, size: F.greatest(F.ceil(n / (BLOCK + BLOCK // 2)), F.ceil(size / HEAVY))
    few_blocks = blocks(F.col("n") - F.col("main.n"), F.col("size") - F.col("main.size"))
    whole = stored(whole.select("cluster", F.col("main.root").alias("main"), few_blocks.alias("few_blocks"), blocks(F.col("main.n"), F.col("main.size")).alias("main_blocks")), "whole")
    # Every block of the texts outside the main class with every other, and with every block of the main class.
    few = F.col("root") != F.col("main")
    dealt = rooted.join(whole, "cluster").withColumns({"few": few, "own": F.pmod(F.xxhash64("content", F.lit(-1)), F.when(few, F.col("few_blocks")).otherwise(F.col("main_blocks")))})
    each = lambda n, to: F.transform(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1), to)
    others = F.filter(each("few_blocks", lambda k: F.struct(F.lit(True).alias("few"), F.least("own", k).alias("a"), F.greatest("own", k).alias("b"))), lambda x: (x["a"] != x["b"]) | (F.col("few_blocks") == 1))
    with_main = each("main_blocks", lambda k: F.struct(F.lit(False).alias("few"), F.col("own").alias("a"), k.alias("b")))
    from_main = each("few_blocks", lambda k: F.struct(F.lit(False).alias("few"), k.alias("a"), F.col("own").alias("b")))
    shards = F.when(F.col("few"), F.concat(others, with_main)).otherwise(from_main)
    spread = dealt.select("cluster", "few", "content", "root", "body", F.explode(shards).alias("of")).select(F.xxhash64("cluster", "of.few", "of.a", "of.b").alias("shard"), "few", "content", "root", "body")
    spread = spread.repartition("shard").sortWithinPartitions("shard")
    return found.unionByName(within).unionByName(spread.mapInPandas(lambda batches: shard_links(batches, _across), "u string, v string"))


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles that come again within a task's run of texts, with their counts."""

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        values, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(values[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["hash", "n"])

    held, size = [], 0
    for batch in batches:
        for t in batch.column(1):
            held.append(np.unique(shingle_hashes(t.as_py(), SHINGLE)))
            size += len(held[-1])
            if size >= COUNTED:
                yield counted(held)
                held, size = [], 0
    if held:
        yield counted(held)


def first_part(hashes: np.ndarray, common: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Of a set's shingles in order, as many as a partner of its size or less can't all lack: uncommon ones by hash, then the common ones by place. common is sorted."""
    rank = np.full(len(hashes), -1)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        rank = np.where(common[at] == hashes, place[at], -1)
    n = len(hashes)
    return hashes[np.lexsort((hashes, rank))][: n + 1 - -(-n * SIMILAR[0] // SIMILAR[1])] if n else hashes


def _possible(token: np.ndarray, met: np.ndarray, name: np.ndarray, size: np.ndarray, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of names that share a token, sorted by it and by met, of different met, and whose sets may have J >= SIMILAR by their sizes and the token's places in them, counted from 1."""
    a, b = SIMILAR
    # Each meets those after the last one of its own token and met.
    last = np.flatnonzero(np.append((token[1:] != token[:-1]) | (met[1:] != met[:-1]), True))
    i = np.arange(len(token))
    j = np.repeat(last + 1, np.diff(np.concatenate(([-1], last))))
    while True:
        here = j < len(token)
        i, j = i[here], j[here]
        here = token[i] == token[j]
        i, j = i[here], j[here]
        if not len(i):
            return
        near = np.minimum(size[i], size[j]) * b >= np.maximum(size[i], size[j]) * a
        x, y = i[near], j[near]
        x, y = np.where(size[x] <= size[y], x, y), np.where(size[x] <= size[y], y, x)
        # Both have a + b parts of the sum of which an overlap needs a; the smaller has a / (a + b) of twice its own at least.
        least = -(-2 * a * size[x] // (a + b))
        overlap = np.minimum(place[x], place[y]) + np.minimum(size[x] - place[x], size[y] - place[y])
        good = (place[x] <= size[x] + 1 - least) & (overlap * (a + b) >= a * (size[x] + size[y]))
        x, y = name[x[good]], name[y[good]]
        if len(x):
            yield np.minimum(x, y), np.maximum(x, y)
        j = j + 1


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (token, met, name, size, place) sorted by token and met -> pairs (a, b) that are possible."""

    def found(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for a, b in _possible(*[np.concatenate(c) for c in zip(*held, strict=True)]):
            for at in range(0, len(a), MET):
                yield pa.RecordBatch.from_arrays([pa.array(a[at : at + MET]), pa.array(b[at : at + MET])], names=["a", "b"])

    held: list[list[np.ndarray]] = []
    for batch in batches:
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held and sum(len(x[0]) for x in held) >= MET:
            # What is held ends where a token does: the last one may go on in the next batch.
            end = np.searchsorted(rows[0], held[-1][0][-1], side="right")
            if end < len(rows[0]):
                yield from found([*held, [c[:end] for c in rows]])
                held, rows = [], [c[end:] for c in rows]
        if len(rows[0]):
            held.append(rows)
    if held:
        yield from found(held)


def _shaped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of texts (name, body) the sizes and parities of their sets."""
    for batch in batches:
        sets = [np.unique(shingle_hashes(t.as_py(), SHINGLE)) for t in batch.column(1)]
        odd = [parities([x], width(len(x))).tobytes() for x in sets]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(odd, pa.binary())], names=["name", "size", "odd"])


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs (a, b, size, odd, other_size, other) those whose parities leave J >= SIMILAR possible."""
    for batch in batches:
        good = []
        for n, one, m, two in zip(*[batch.column(k).to_pylist() for k in range(2, 6)], strict=True):
            one, two = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
            # The wider one is folded, as its places are the other's and multiples added.
            least = min(len(one), len(two))
            one, two = (np.bitwise_xor.reduce(x.reshape(-1, least), axis=0) for x in (one, two))
            good.append(bool(may_be_alike(one ^ two, np.int64(n + m))))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs (u, v, body, other) those whose shingle sets have J >= SIMILAR."""
    sets: dict[str, np.ndarray] = {}
    kept = 0

    def of(name: str, body: pa.Scalar) -> np.ndarray:
        nonlocal kept
        if (found := sets.get(name)) is None:
            found = sets[name] = np.unique(shingle_hashes(body.as_py(), SHINGLE))
            kept += len(found)
        return found

    for batch in batches:
        good = []
        for u, v, body, other in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
            if kept > KEPT:
                sets.clear()
                kept = 0
            one, two = of(u, body), of(v, other)
            good.append(alike(one, two))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(good, pa.bool_()))


def _missed(texts: DataFrame, known: DataFrame) -> DataFrame | None:
    """texts(content, body), repeats and all, known(content, met) -> links (u, v) between texts of different met, or without; None if no pair is possible."""
    spark = texts.sparkSession
    counts = texts.mapInArrow(_repeated, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)
    rows = counts.orderBy(F.desc("n"), "hash").limit(MOST_COMMON).collect()
    values, place = np.array([r["hash"] for r in rows], np.int64).view(np.uint64), np.arange(len(rows), 0, -1)
    by = np.argsort(values)
    order = spark.sparkContext.broadcast((values[by], place[by]))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), SHINGLE)) for t in batch.column(1)]
            tokens = pa.array([first_part(x, *order.value).view(np.int64) for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int64()), tokens], names=["content", "size", "tokens"])

    parts = texts.mapInArrow(first, "content string, size bigint, tokens array<bigint>").dropDuplicates(["content"]).join(known, "content", "left")
    name = F.xxhash64("content")
    spread = parts.select(F.posexplode("tokens").alias("place", "token"), F.xxhash64(F.coalesce("met", "content")).alias("met"), name.alias("name"), "size")
    spread = spread.select("token", "met", "name", "size", (F.col("place") + 1).cast("bigint").alias("place")).repartition("token").sortWithinPartitions("token", "met")
    pairs = stored(spread.mapInArrow(_pairs, "a bigint, b bigint").distinct(), "pairs")
    if pairs.isEmpty():
        return None
    named = texts.withColumn("name", name)
    asked = lambda pairs: pairs.select(F.col("a").alias("name")).unionAll(pairs.select(F.col("b").alias("name"))).distinct()
    shapes = stored(named.join(asked(pairs), "name", "left_semi").select("name", "body").mapInArrow(_shaped, "name bigint, size bigint, odd binary").dropDuplicates(["name"]), "shapes")
    with_shapes = pairs.join(shapes.withColumnRenamed("name", "a"), "a").join(shapes.select(F.col("name").alias("b"), F.col("size").alias("other_size"), F.col("odd").alias("other")), "b")
    pairs = stored(with_shapes.select("a", "b", "size", "odd", "other_size", "other").mapInArrow(_close, "a bigint, b bigint"), "close")
    if pairs.isEmpty():
        return None
    bodies = named.join(asked(pairs), "name", "left_semi").groupBy("content").agg(F.first("name").alias("name"), F.first("body").alias("body"))
    bodies = stored(bodies, "asked")
    ends = lambda end, to, body: bodies.select(F.col("name").alias(end), F.col("content").alias(to), F.col("body").alias(body))
    both = pairs.join(ends("a", "u", "body"), "a").join(ends("b", "v", "other"), "b").select("u", "v", "body", "other")
    return stored(both.mapInArrow(_alike, "u string, v string"), "missed")


def unique_texts(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> the one row of each class of near-duplicate texts that stays, with the same columns."""
    aside = Aside(docs, ("doc_id", "text"))
    return aside.restored(_unique(aside.rows))


def _unique(docs: DataFrame) -> DataFrame:
    content = F.md5(lowered(F.coalesce(F.col("text"), F.lit(""))))
    rows = docs.withColumns({"_content": content, "_id": F.coalesce(F.col("doc_id").cast("string"), F.lit(""))})
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_id")))
    texts = docs.select(content.alias("content"), F.col("text").cast("binary").alias("body"))
    # Equal texts meet by digest first; the texts themselves are signed where they lie, repeats and all.
    signed = stored(texts.mapInArrow(_signed, "content string, fp bigint, sketch binary, shards array<bigint>").dropDuplicates(["content"]), "signed")
    spread = signed.select(F.explode("shards").alias("shard"), "fp", "sketch", "content")
    large = stored(spread.groupBy("shard").agg(F.count("*").alias("n"), F.min("content").alias("least")).where(F.col("n") > SHARD), "shards")
    whole = spread.join(large, "shard").where("content <> least").select(F.col("content").alias("u"), F.col("least").alias("v"))
    searched = spread.join(large, "shard", "left_anti").repartition("shard").sortWithinPartitions("shard", "fp", "content")
    clusters = components(searched.mapInPandas(lambda batches: shard_links(batches, _proposed), "u string, v string").unionByName(whole))
    body = F.first(F.col("text").cast("binary")).alias("body")
    members = rows.join(clusters.withColumnsRenamed({"node": "_content", "root": "_root"}), "_content").groupBy(F.col("_content").alias("content")).agg(F.first("_root").alias("cluster"), one.alias("first"), body)
    links = _classes(members)
    missed = _missed(texts, clusters.select(F.col("node").alias("content"), F.col("root").alias("met")))
    roots = components(links if missed is None else links.unionByName(missed)).withColumnRenamed("node", "_content")
    firsts = rows.groupBy("_content").agg(one.alias("first"))
    classes = firsts.join(roots, "_content", "left").withColumn("root", F.coalesce("root", "_content"))
    stay = classes.groupBy("root").agg(F.min(F.struct("first.none", "first.id", "first._id", "_content")).alias("stays")).select("stays._id", "stays._content")
    return rows.join(stay, ["_id", "_content"]).dropDuplicates(["_id", "_content"]).select(*docs.columns)
