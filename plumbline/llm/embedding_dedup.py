"""Near-duplicate vectors by an exact range join on the angle between them.

A sample of the vectors serves as pivots; pivots closer than half the range to another are left out. Each vector lives with its nearest
pivot, in one of two cells: the core, of angle up to half the range, whose members are all linked by the triangle inequality and are
never compared with each other, and the shell. So a large group of near copies costs a row for each. A vector is a guest in
another cell if its angle to that cell's pivot is within the range of the angles that live there; again by the triangle inequality
all its links into the cell are then found there. Of two cells one is host to the other's guests, so a pair meets once.

Cells of more than BLOCK members are parted into blocks. A block's members are held by one task, its guests stream past them, and the
cells join independently. Nothing about a pair is written: a task returns counts and a spanning set of links.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .store import Scratch, short_batches

#: Rows for each pivot, as long as pivots fit the bound; members of a block; bytes of pivots that are sent at most.
CELL, BLOCK, PIVOT_BYTES = 1000, 2000, 16 << 20
#: Added to ranges of angles, whose rounding is below it, before a pair is left out or taken for linked unseen.
SLACK = 1e-6
_ROW = "row bigint, grp string, vec array<double>"


class Cells(NamedTuple):
    """What tasks know of the pivots. Pivots are numbered through; those of one group stand together. Cell 2 p is the core of pivot p, cell 2 p + 1 its shell."""

    #: For each group with pivots the first of them and one past the last.
    groups: dict[str, tuple[int, int]]
    pivots: list[np.ndarray]
    #: By cell: least and greatest angle, blocks.
    low: np.ndarray
    high: np.ndarray
    blocks: np.ndarray


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their greatest entry first, so that squares neither overflow nor vanish."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _by_group(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    codes = batch.column("grp").dictionary_encode()
    at = codes.indices.to_numpy()
    for k, g in enumerate(codes.dictionary.to_pylist()):
        yield g, np.flatnonzero(at == k)


def angles(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ pivots.T, -1.0, 1.0))


def thinned(units: np.ndarray, apart: float) -> np.ndarray:
    """Those that are no closer than apart to one that is kept before them."""
    open_, kept = np.ones(len(units), bool), []
    for i in range(len(units)):
        if open_[i]:
            kept.append(i)
            open_ &= angles(units, units[i : i + 1])[:, 0] > apart
    return units[kept]


def _homes(sent: Broadcast, reach: float):
    """Rows in; each with its cell (null in a group without pivots) and the angle to its pivot out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, pivots = sent.value
        stacked = {g: np.stack(pivots[a:b]) for g, (a, b) in groups.items()}
        for batch in batches:
            cell, angle = np.full(batch.num_rows, -1), np.full(batch.num_rows, np.nan)
            for g, at in _by_group(batch):
                if g in groups:
                    all_ = angles(unit(_matrix(batch.column("vec").take(pa.array(at)))), stacked[g])
                    near = all_.argmin(axis=1)
                    angle[at] = all_[np.arange(len(at)), near]
                    cell[at] = 2 * (groups[g][0] + near) + (angle[at] > reach / 2 - SLACK)
            none = cell < 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32(), mask=none), pa.array(angle, pa.float64(), mask=none)], [*batch.schema.names, "cell", "angle"])

    return run


def visits(own: np.ndarray, angle: np.ndarray, cells: Cells, first: int, last: int, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are guests of which cells, of rows of one group: own cell, and angles to its pivots from first to last."""
    every = np.arange(2 * first, 2 * last)
    wide = np.repeat(angle, 2, axis=1)
    near = (wide >= cells.low[every] - reach - SLACK) & (wide <= cells.high[every] + reach + SLACK)
    # of two cells the later is host if the sum of their numbers is even, else the earlier
    mine = own[:, None]
    host = (mine < every) == ((mine + every) % 2 == 0)
    row, cell = np.nonzero(near & host & (mine != every) & (cells.blocks[every] > 0))
    return row, every[cell]


def _placed(sent: Broadcast, reach: float):
    """Homes in; out a row for each block that a vector lives in (guest 0) or visits (guest 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: Cells = sent.value
        stacked = {g: np.stack(cells.pivots[a:b]) for g, (a, b) in cells.groups.items()}
        for batch in batches:
            rows = batch.column("row").to_numpy()
            for g, at in _by_group(batch):
                own = batch.take(pa.array(at))
                if g not in cells.groups:
                    zero = pa.array(np.zeros(len(at)), pa.int32())
                    yield pa.RecordBatch.from_arrays([own.column("row"), own.column("grp"), own.column("vec"), pa.nulls(len(at), pa.int32()), zero, zero], ["row", "grp", "vec", "cell", "block", "guest"])
                    continue
                home = own.column("cell").to_numpy()
                block = rows[at] % cells.blocks[home]
                first, last = cells.groups[g]
                who, where = visits(home, angles(unit(_matrix(own.column("vec"))), stacked[g]), cells, first, last, reach)
                who, where = np.repeat(who, cells.blocks[where]), np.repeat(where, cells.blocks[where])
                # numbers each cell's blocks for each visit
                fresh = np.concatenate(([True], (who[1:] != who[:-1]) | (where[1:] != where[:-1]))) if len(who) else np.zeros(0, bool)
                begun = np.flatnonzero(fresh)
                number = np.arange(len(who)) - np.repeat(begun, np.diff(np.append(begun, len(who))))
                # within a shell of several blocks the members of earlier blocks visit the later ones
                shells = np.flatnonzero((home % 2 == 1) & (cells.blocks[home] > 1))
                later = [(i, b) for i in shells for b in range(block[i] + 1, cells.blocks[home[i]])]
                mine, its = (np.array([x[k] for x in later], np.int64) for k in (0, 1))
                take = np.concatenate((np.arange(len(at)), who, mine)).astype(np.int64)
                values = [np.concatenate(x) for x in ((home, where, home[mine]), (block, number, its), (np.zeros(len(at)), np.ones(len(who) + len(mine))))]
                for i in range(0, len(take), 4096):
                    part = own.take(pa.array(take[i : i + 4096]))
                    yield pa.RecordBatch.from_arrays([part.column("row"), part.column("grp"), part.column("vec"), *(pa.array(v[i : i + 4096], pa.int32()) for v in values)], ["row", "grp", "vec", "cell", "block", "guest"])

    return run


class Block:
    """The members of one block, their counts of links and the least row that each was found to be connected with."""

    def __init__(self, rows: np.ndarray, units: np.ndarray, cosine: float, compare: bool):
        self.rows, self.units, self.cosine = rows, units, cosine
        self.links, self.least = np.zeros(len(rows), np.int64), rows.copy()
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []
        if compare:
            for a in range(0, len(rows), BLOCK):
                for b in range(a, len(rows), BLOCK):
                    i, j = np.nonzero(units[a : a + BLOCK] @ units[b : b + BLOCK].T >= cosine)
                    if a == b:
                        i, j = i[i < j], j[i < j]
                    i, j = i + a, j + b
                    self.links += np.bincount(i, minlength=len(rows)) + np.bincount(j, minlength=len(rows))
                    self._join(i, j, self.least)
            self._keep(rows, self.least)

    def _join(self, i: np.ndarray, j: np.ndarray, other: np.ndarray) -> None:
        """Lets the ends of the pairs (i of least, j of other) take the lesser of their rows until nothing changes."""
        while len(i):
            low = np.minimum(self.least[i], other[j])
            if (low == self.least[i]).all() and (low == other[j]).all():
                return
            np.minimum.at(self.least, i, low)
            np.minimum.at(other, j, low)

    def _keep(self, rows: np.ndarray, least: np.ndarray) -> None:
        moved = rows != least
        if moved.any():
            self.edges.append((rows[moved], least[moved]))

    def visit(self, rows: np.ndarray, units: np.ndarray) -> np.ndarray:
        """Compares guests with all members; the guests' counts of links."""
        counts = np.zeros(len(rows), np.int64)
        for a in range(0, len(self.rows), BLOCK):
            i, j = np.nonzero(self.units[a : a + BLOCK] @ units.T >= self.cosine)
            i += a
            self.links += np.bincount(i, minlength=len(self.rows))
            counts += np.bincount(j, minlength=len(rows))
            before, least = self.least.copy(), rows.copy()
            self._join(i, j, least)
            self._keep(rows, least)
            changed = before != self.least
            self.edges.append((self.rows[changed], self.least[changed]))
        return counts


def _joined(cosine: float):
    """Blocks, members before guests, in; counts of links (other null) and links between row and other out."""

    def out(rows: np.ndarray, other: np.ndarray | None, links: np.ndarray | None) -> pa.RecordBatch:
        null = pa.nulls(len(rows), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), null if other is None else pa.array(other, pa.int64()), null if links is None else pa.array(links, pa.int64())], ["row", "other", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, block = None, [], None

        def begun() -> Block:
            return Block(np.concatenate([x[0] for x in members]), np.concatenate([x[1] for x in members]), cosine, key[1] is None or key[1] % 2 == 1)

        def told(block: Block) -> Iterator[pa.RecordBatch]:
            for a, b in block.edges:
                yield out(a, b, None)
            block.edges.clear()

        def ended() -> Iterator[pa.RecordBatch]:
            last = block or (begun() if members else None)
            if last:
                yield from told(last)
                some = last.links > 0
                yield out(last.rows[some], None, last.links[some])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows, guest = batch.column("row").to_numpy(), batch.column("guest").to_numpy()
            names = list(zip(*(batch.column(c).to_pylist() for c in ("grp", "cell", "block")), strict=True))
            starts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1] or guest[i] != guest[i - 1]), len(names)]
            for a, b in zip(starts, starts[1:], strict=False):
                if names[a] != key:
                    yield from ended()
                    key, members, block = names[a], [], None
                units = unit(_matrix(batch.column("vec").slice(a, b - a)))
                if not guest[a]:
                    members.append((rows[a:b], units))
                    continue
                if block is None:
                    block = begun()
                counts = block.visit(rows[a:b], units)
                yield from told(block)
                yield out(rows[a:b][counts > 0], None, counts[counts > 0])
        yield from ended()

    return run


def _pivots(rows: DataFrame, reach: float, cell: int) -> tuple[dict[str, tuple[int, int]], list[np.ndarray]]:
    """One of about `cell` rows, by a hash of its number, as far as all pivots fit PIVOT_BYTES."""
    n, entries = rows.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    most = max(1, PIVOT_BYTES // (8 * (entries or 1)))
    share = 1 / max(cell, n / most)
    drawn = F.pmod(F.xxhash64("row"), F.lit(1 << 40))
    chosen = rows.where(drawn < int(share * (1 << 40))).orderBy(drawn).limit(most).select("grp", "vec").collect()
    by: dict[str, list] = {}
    for r in chosen:
        by.setdefault(r.grp, []).append(r.vec)
    groups, pivots = {}, []
    for g, vectors in by.items():
        kept = thinned(unit(np.array(vectors, float)), reach / 2)
        groups[g] = (len(pivots), len(pivots) + len(kept))
        pivots += list(kept)
    return groups, pivots


def near_duplicates(vectors: DataFrame, scratch: Scratch, cosine: float = 0.93, id: str = "vec_id", vector: str = "embedding", label: str | None = "label", cell: int = CELL) -> DataFrame:
    """Links between rows of vectors whose cosine, in double precision, is at least `cosine` (over 0), and what they connect.

    Rows are compared only where their labels are equal and not null (label=None: all rows with each other) and their vectors are of
    one length. Null and empty vectors, vectors of zeros only, and those with a null, NaN or infinite entry link with nothing.

    Returns id, n_links (other rows linked directly), component_id (the least id reachable over links, itself included), kept (id is
    component_id). Rows that repeat an id are rows of their own. Rows with a null id link like others; their kept is true only where
    no row of their component has an id, and component_id is then null. An empty table gives no row. Other columns are not read.

    The result doesn't depend on the pivots. `cell` rows share a pivot on average; more where all pivots would take over PIVOT_BYTES,
    and then cells have more blocks. Vectors that no pivot tells apart, such as random ones of many dimensions, make every
    cell host to most others, and the join costs what comparing all blocks does.
    """
    spark: SparkSession = vectors.sparkSession
    reach = float(np.arccos(cosine))
    entries = F.col(vector).cast("array<double>")
    fit = F.forall(entries, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(entries, lambda x: x != 0)
    usable = F.coalesce(fit, F.lit(False)) & (F.lit(True) if label is None else F.col(label).isNotNull())
    named = F.concat(F.size(vector).cast("string"), F.lit(":"), F.lit("") if label is None else F.col(label).cast("string"))
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"), F.when(usable, named).alias("grp"), F.when(usable, entries).alias("vec"))
    rows = scratch.write(rows, "vectors")
    fit = rows.where("grp is not null").select("row", "grp", "vec")
    with short_batches(spark, 4096):
        groups, pivots = _pivots(fit, reach, cell)
        sent = spark.sparkContext.broadcast((groups, pivots))
        homes = scratch.write(fit.mapInArrow(_homes(sent, reach), f"{_ROW}, cell int, angle double"), "homes")
        stats = homes.where("cell is not null").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"), F.min("row").alias("least"))
        stats = scratch.write(stats, "cells")
        low, high, blocks = np.zeros(2 * len(pivots)), np.zeros(2 * len(pivots)), np.zeros(2 * len(pivots), np.int64)
        for r in stats.collect():
            low[r.cell], high[r.cell], blocks[r.cell] = r.low, r.high, -(-r.n // BLOCK)
        told = spark.sparkContext.broadcast(Cells(groups, pivots, low, high, blocks))
        placed = homes.drop("angle").mapInArrow(_placed(told, reach), f"{_ROW}, cell int, block int, guest int")
        dealt = placed.repartition("grp", "cell", "block").sortWithinPartitions("grp", "cell", "block", "guest")
        found = scratch.write(dealt.mapInArrow(_joined(cosine), "row bigint, other bigint, links bigint"), "found")
    # all members of a core are linked with each other
    core = homes.where("cell % 2 = 0").select("row", "cell").join(stats.select("cell", "n", "least"), "cell")
    links = found.where("links is not null").select("row", "links").union(core.select("row", F.col("n") - 1)).groupBy("row").agg(F.sum("links").alias("links"))
    edges = found.where("other is not null").select(F.col("row").alias("a"), F.col("other").alias("b")).union(core.where("row <> least").select("row", "least"))
    connected = components(scratch.write(edges, "edges"), scratch).withColumnRenamed("node", "row")
    of = rows.select("row", "id").join(links, "row", "left").join(connected, "row", "left")
    of = scratch.write(of.select("id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), "component"), "linked")
    scratch.drop("vectors", "homes", "cells", "found", "edges")
    least = of.where("component is not null").groupBy("component").agg(F.min("id").alias("least"))
    joined = of.join(least, "component", "left").select("id", "n_links", F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"))
    return joined.select(F.col("id").alias(id), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


#: near_duplicates(embeddings) as SQL: all pairs of a label, and reachability over links.
SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept FROM embeddings e JOIN least l ON l.a = e.vec_id LEFT JOIN degree d ON d.a = e.vec_id
"""
