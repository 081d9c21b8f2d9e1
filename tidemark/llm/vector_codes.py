"""Vector codes: every vector cut into parts, each part named by the nearest entry of its codebook, codebooks fitted by rounds of averages.

Components become whole numbers, so distances, averages (rounded down) and ties (to the lower index) are exact. A round is one pass over
the vectors, which writes them with their state to the shared folder; the codebooks that follow from a pass are sums by entry, put together in
the tasks before a shuffle of a few numbers a task.

A pass needn't measure all entries (Drake's and Hamerly's adaptive bounds). Of each part the state keeps its entry, the `width` next ones in
order with a lower bound of the distance to each, and one outer bound for all others. When entries have moved, the bounds fall by the distance that
their entry has moved, the outer one by the longest move. A part keeps its entry if that is surely nearer than all bounds; else the entries whose bounds
aren't surely above are measured in whole numbers, and all entries if the outer bound isn't. Bounds are rounded down and
the distance to the own entry is measured anew each time, so rounding never decides. The width follows what was used: it doubles, up to WIDEST, if more
than a tenth of the parts needed all entries, else it falls to what suffices for nine tenths.

Defined cases: vectors that are null or hold a null or a component that isn't finite are dropped; a null id comes after all others; of equal ids the
lesser vector comes first; repeated rows give a row each; with fewer vectors than entries the codebooks are as short; vectors of another
length than most have (the longer of equally many), empty ones too, get a null code and errors and take no part otherwise; a length that the parts don't divide,
or components beyond MOST (distances would leave 64 bits), raise an error; an empty table gives an empty result; carried columns named like a result are replaced by it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from .common import Aside, stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Greatest size of a whole component, parts of a batch that are measured at once, entries tracked at first, least and most.
MOST, AT_ONCE, WIDTH, NARROWEST, WIDEST = 1 << 26, 1 << 12, 16, 4, 64
#: Most labels whose sums are sent to all tasks, and the ways that a label's rows are dealt in where there are more.
SENT, DEALT = 1 << 20, 16
RESULTS = ("code", "error", "label_error", "codebooks_sha256")
_SLACK = 1e-9  # more than the rounding of a square root and a few sums


def measured(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all entries, exact, in floats where those hold them."""
    dims = x.shape[1]
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * dims * most * most < 1 << 53:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return (a * a).sum(axis=1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(axis=1)
    out = np.zeros((len(x), len(entries)), np.int64)
    for k in range(dims):
        out += (x[:, k, None] - entries[:, k]) ** 2
    return out


def below(squares: np.ndarray) -> np.ndarray:
    """Lower bounds of the roots, in few bytes."""
    return np.nextafter((np.sqrt(squares.astype(np.float64)) * (1 - _SLACK)).astype(np.float32), np.float32(-1))


@dataclass
class Bounds:
    """The state of one part position: entries own (n), tracked (n, width) with lower bounds low (n, width), and outer (n)."""

    own: np.ndarray
    tracked: np.ndarray
    low: np.ndarray
    outer: np.ndarray

    @staticmethod
    def empty(n: int, width: int) -> Bounds:
        return Bounds(np.zeros(n, np.uint8), np.zeros((n, width), np.uint8), np.full((n, width), np.inf, np.float32), np.full(n, -1, np.float32))

    def moved(self, moves: np.ndarray) -> None:
        """Lower the bounds by how far entries have moved at most."""
        moves = moves * (1 + _SLACK)
        fall = lambda bound, by: np.nextafter((bound - by).astype(np.float32), np.float32(-np.inf))
        self.low = np.where(np.isinf(self.low), self.low, fall(self.low.astype(np.float64), moves[self.tracked]))
        self.outer = fall(self.outer.astype(np.float64), moves.max(initial=0.0))

    def assigned(self, x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Find the nearest entries: (their squared distances, how many tracked entries each row needed; width + 1: all entries)."""
        width = self.low.shape[1]
        exact = lambda rows, which: ((x[rows] - entries[which]) ** 2).sum(axis=-1)
        squares = exact(slice(None), self.own)
        upper = np.sqrt(squares.astype(np.float64)) * (1 + _SLACK)
        # A bound holds for all later ones too, so what may be nearer is a run from the first on.
        after = np.minimum.accumulate(np.concatenate((self.low, self.outer[:, None]), axis=1)[:, ::-1], axis=1)[:, ::-1]
        need = (after <= upper[:, None]).sum(axis=1)
        for n in np.unique(need[(need > 0) & (need <= width)]).tolist():
            rows = np.flatnonzero(need == n)
            which = np.concatenate((self.own[rows, None], self.tracked[rows, :n]), axis=1)
            found = np.stack([squares[rows], *(exact(rows, which[:, k + 1]) for k in range(n))], axis=1)
            order = np.lexsort((which, found), axis=1)
            which, found = np.take_along_axis(which, order, 1), np.take_along_axis(found, order, 1)
            self.own[rows], squares[rows] = which[:, 0], found[:, 0]
            self.tracked[rows, :n], self.low[rows, :n] = which[:, 1:], below(found[:, 1:])
        every = np.flatnonzero(need > width)
        for at in range(0, len(every), AT_ONCE):
            rows = every[at : at + AT_ONCE]
            squares[rows] = self._all(rows, x[rows], entries)
        return squares, need

    def _all(self, rows: np.ndarray, x: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """Measure all entries for some rows and set their state anew."""
        found, each, width = measured(x, entries), np.arange(len(rows)), self.low.shape[1]
        own = found.argmin(axis=1)  # the first of equal ones
        squares = found[each, own].astype(np.int64)
        found = found.astype(np.float64)
        found[each, own] = np.inf
        k = min(width, len(entries) - 1)
        # The k least of the others, in order, and the least of the rest.
        near = np.argpartition(found, min(k, len(entries) - 1), axis=1)
        outer = found[each, near[:, k]] if k < len(entries) else np.full(len(rows), np.inf)
        near = near[:, :k]
        order = np.argsort(np.take_along_axis(found, near, 1), axis=1)
        near = np.take_along_axis(near, order, 1)
        self.own[rows] = own
        self.tracked[rows, :k], self.low[rows, :k] = near, below(np.take_along_axis(found, near, 1))
        self.low[rows, k:] = np.inf
        self.outer[rows] = below(outer)
        return squares

    def resized(self, width: int) -> Bounds:
        """The same knowledge with another number of tracked entries."""
        n, old = self.low.shape
        if width < old:
            outer = np.minimum(self.outer, self.low[:, width:].min(axis=1))
            return Bounds(self.own, self.tracked[:, :width].copy(), self.low[:, :width].copy(), outer)
        out = Bounds.empty(n, width)
        out.own, out.outer = self.own, self.outer
        out.tracked[:, :old], out.low[:, :old] = self.tracked, self.low
        return out


def next_width(width: int, needs: np.ndarray) -> int:
    """The width of the next pass, from how many parts needed 0, 1, ... width tracked entries or, last, all."""
    total = needs.sum()
    if 10 * needs[width + 1] > total:
        return min(WIDEST, 2 * width)
    enough = int(np.searchsorted(np.cumsum(needs), 0.9 * total))
    return min(WIDEST, max(NARROWEST, enough))


_STATE = "own binary, tracked binary, low binary, outer binary, error bigint, cell int, amount bigint"


def _numbers(column: pa.Array, kind: type, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape)


def _binaries(values: np.ndarray) -> pa.Array:
    """The rows' bytes, a value each."""
    rows = np.ascontiguousarray(values)
    size = rows.nbytes // max(len(rows), 1)
    ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(size)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(rows.tobytes())])


@dataclass
class Fit:
    """Codebooks (part, entry, place) before and after their last move, the width of the state, what a pass has counted."""

    books: np.ndarray
    before: np.ndarray
    width: int

    def cells(self) -> int:
        return self.books.size + self.books.shape[0] * self.books.shape[1]


def _pass(rows: DataFrame, carry: tuple[str, ...], fit: Fit, kept_width: int | None, tag: str) -> DataFrame:
    """One assignment of all vectors, written: rows with their state, and the tasks' sums by cell (cell is null for vectors).

    Cells: first the codebooks' components, then the entries' counts, then the numbers of parts by need.
    """
    parts, entries, dims = fit.books.shape
    moves = np.sqrt(((fit.books - fit.before).astype(np.float64) ** 2).sum(axis=2))
    shared = rows.sparkSession.sparkContext.broadcast((fit.books, moves))
    width, extra = fit.width, len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, moves = shared.value
        sums, counts, needs = np.zeros((parts, entries, dims), np.int64), np.zeros((parts, entries), np.int64), np.zeros(WIDEST + 2, np.int64)
        names = schema = None
        for batch in crf.shortened(batches, AT_ONCE):
            n = batch.num_rows
            x = _numbers(batch.column(extra), np.int32, parts, dims).astype(np.int64)
            columns, error = [], np.zeros(n, np.int64)
            if kept_width is not None:
                own, outer = _numbers(batch.column(extra + 1), np.uint8, parts), _numbers(batch.column(extra + 4), np.float32, parts)
                tracked, low = _numbers(batch.column(extra + 2), np.uint8, parts, kept_width), _numbers(batch.column(extra + 3), np.float32, parts, kept_width)
            for p in range(parts):
                state = Bounds.empty(n, width)
                if kept_width is not None:
                    state = Bounds(own[:, p].copy(), tracked[:, p].copy(), low[:, p].copy(), outer[:, p].copy())
                    state.moved(moves[p])
                    state = state.resized(width)
                squares, need = state.assigned(x[:, p], books[p])
                error += squares.astype(np.int64)
                needs += np.bincount(np.where(need > width, WIDEST + 1, need), minlength=WIDEST + 2)
                np.add.at(sums[p], state.own, x[:, p])
                counts[p] += np.bincount(state.own, minlength=entries)
                columns.append(state)
            stack = lambda name: _binaries(np.stack([getattr(s, name) for s in columns], axis=1))  # noqa: B023, E731
            nothing = [pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())]
            out = pa.RecordBatch.from_arrays(
                [*batch.columns[: extra + 1], stack("own"), stack("tracked"), stack("low"), stack("outer"), pa.array(error), *nothing],
                names=[*batch.schema.names[: extra + 1], "own", "tracked", "low", "outer", "error", "cell", "amount"],
            )
            names, schema = out.schema.names, out.schema
            yield out
        if schema is not None:
            amounts = np.concatenate((sums.ravel(), counts.ravel(), needs))
            at = np.flatnonzero(amounts)
            yield pa.RecordBatch.from_arrays([*[pa.nulls(len(at), f.type) for f in list(schema)[:-2]], pa.array(at.astype(np.int32)), pa.array(amounts[at])], names=names)

    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in (*carry, "_x"))
    columns = [*carry, "_x"] + ([] if kept_width is None else ["own", "tracked", "low", "outer"])
    return stored(rows.select(*columns).mapInArrow(run, kinds + _STATE), tag)


def _counted(table: DataFrame, fit: Fit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sums, counts, needs) of a pass: numbers by cell, as many as the codebooks have."""
    out = np.zeros(fit.cells() + WIDEST + 2, np.int64)
    for row in table.where("cell IS NOT NULL").groupBy("cell").agg(F.sum("amount").alias("amount")).toLocalIterator():
        out[row["cell"]] = row["amount"]
    n = fit.books.size
    return out[:n].reshape(fit.books.shape), out[n : fit.cells()].reshape(fit.books.shape[:2]), out[fit.cells() :]


def _whole(vectors: DataFrame) -> DataFrame:
    """The vectors without those that are dropped, components in whole numbers as _v."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return vectors.where(F.col("_v").isNotNull() & F.forall("_v", finite)).withColumn("_v", F.transform("_v", lambda v: F.floor(v * SCALE)))


def _books(same: DataFrame, entries: int, parts: int, size: int) -> np.ndarray:
    """The first codebooks: the parts of the first vectors by id, a number of rows that is fixed."""
    first = same.select("_id", "_v").orderBy(F.asc_nulls_last("_id"), "_v").limit(entries).collect()
    return np.array([r["_v"] for r in first], np.int64).reshape(len(first), parts, size // parts).transpose(1, 0, 2)


def _packed(same: DataFrame, carry: tuple[str, ...], size: int) -> DataFrame:
    """Vectors of one length with their components as bytes of 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(batch.num_columns - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _binaries(x.flatten().to_numpy().reshape(len(x), size))], names=[*batch.schema.names[:-1], "_x"])

    kinds = "".join(f"`{c}` {same.schema[c].dataType.simpleString()}, " for c in carry)
    return same.select(*carry, "_v").mapInArrow(run, kinds + "_x binary")


def fit_codes(vectors: DataFrame, carry: tuple[str, ...], size: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray, list[np.ndarray]]:
    """vectors(carry, _id, _v: array of `size` ints) -> (the carried columns with code and error, written; the codebooks; needs of each pass)."""
    books = _books(vectors, entries, parts, size)
    fit, kept, told = Fit(books, books, WIDTH), None, []
    table = _packed(vectors, carry, size)
    for k in range(rounds + 1):
        table = _pass(table, carry, fit, kept, f"codes-{k}")
        sums, counts, needs = _counted(table, fit)
        table, kept = table.where("cell IS NULL"), fit.width
        told.append(np.concatenate((needs[: kept + 1], needs[-1:])))
        if k < rounds:
            moved = np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], fit.books)
            # The first pass has no bounds yet and so tells nothing of them.
            fit = Fit(moved, fit.books, next_width(kept, told[-1]) if k else kept)
    return table.select(*carry, F.lower(F.hex("own")).alias("code"), "error"), fit.books, told


def _with_label_errors(coded: DataFrame) -> DataFrame:
    """coded(_label, error, ...) with label_error, the sum of errors over equal labels; a label may have any share of the rows."""
    sums = stored(coded.groupBy("_label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("_label", "_of")
    if sums.count() <= SENT:
        return coded.join(F.broadcast(sums), F.col("_label").eqNullSafe(F.col("_of"))).drop("_of")
    # So many labels can't be sent; their rows are dealt, a frequent label's over several tasks.
    dealt = sums.withColumn("_way", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    rows = coded.withColumn("_part", F.pmod(F.xxhash64("code", "error", "_row"), F.lit(DEALT)))
    return rows.join(dealt, F.col("_label").eqNullSafe(F.col("_of")) & (F.col("_part") == F.col("_way"))).drop("_of", "_way", "_part")


def codes(
    docs: DataFrame, vector: str = "embedding", id_: str = "vec_id", label: str = "label", carry: tuple[str, ...] = ("vec_id", "label"), parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> DataFrame:
    """docs(vector, id, label, ...) -> the carried columns and RESULTS: the code, its squared error, that of the label and the digest of all entries."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part")
    aside = Aside(docs, (vector, id_, label), RESULTS, carry)
    name = lambda c: F.col("`" + c.replace("`", "``") + "`")
    numbered = aside.rows.select(*[name(c).alias(f"_c{k}") for k, c in enumerate(aside.carry)], name(id_).alias("_id"), name(label).alias("_label"), name(vector).cast("array<double>").alias("_v"))
    own = (*(f"_c{k}" for k in range(len(aside.carry))), "_label", "_row")
    whole = _whole(numbered).withColumn("_row", F.xxhash64("_id"))
    usual = whole.groupBy(F.size("_v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    size = usual[0]["n"] if usual else 0
    if size % parts:
        raise ValueError(f"vectors of {size} components can't be cut into {parts} equal parts")
    none = lambda df: df.select(*own, *[F.lit(None).cast(kind).alias(c) for c, kind in (("code", "string"), ("error", "bigint"), ("label_error", "bigint"))])
    books = np.zeros((0, 0, 0), np.int64)
    found = none(whole.where(F.lit(True) if not size else F.size("_v") != size))
    if size:
        small = F.forall("_v", lambda v: F.abs(v) <= MOST)
        checked = F.when(small, F.col("_v").cast("array<int>")).otherwise(F.raise_error(F.lit(f"a component beyond {MOST // SCALE} can't be measured in 64 bits")).cast("array<int>"))
        coded, books, _ = fit_codes(whole.where(F.size("_v") == size).withColumn("_v", checked), own, size, parts, entries, rounds)
        found = _with_label_errors(coded).select(*found.columns).unionByName(found)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    named = found.select(*[F.col(f"_c{k}").alias(c) for k, c in enumerate(aside.carry)], *RESULTS[:3])
    return aside.restored(named, *RESULTS[:3], F.lit(digest).alias(RESULTS[3]))
