"""Embedding near-duplicates by a subspace pigeonhole join."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .shared import Labels, components, in_units, mix, partitions_of, whole_groups

#: Dimensions of a block at most, for vectors of up to 64 dimensions and for wider ones; the number of blocks follows.
#: A ball reaches 0.2 * sqrt(these) deviations of a coordinate, whatever the vectors' width, so cells split space well. In
#: wide vectors a block of 8 lets through some false neighbours in every label of a million, in each of many blocks; one of
#: 16 hardly any.
NARROW, WIDE = 8, 16
#: Vectors of a label that one cell of a block's space holds, about; from there on space is split.
CELL = 65_536
#: Vectors of one part of a cell that holds many more, as its vectors lie too close to be split; and of those that have
#: a neighbour, whose whole vectors are compared.
PART, PART_NEAR = 65_536, 512
#: Vectors of a leaf of the tree that a task builds over a cell: fewer in blocks of more than 8 dimensions, where a box
#: of many points reaches far.
LEAF = 24
_SLACK = 1e-6


@lru_cache(8)
def rotation(d: int) -> np.ndarray:
    """A fixed random rotation; it spreads distances evenly over the blocks."""
    q, r = np.linalg.qr(np.random.default_rng(1_000_003 + d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


@lru_cache(8)
def cuts(d: int) -> list[tuple[int, int]]:
    """Coordinates of each block."""
    at = np.linspace(0, d, -(-d // (NARROW if d <= 64 else WIDE)) + 1).astype(int)
    return list(zip(at[:-1].tolist(), at[1:].tolist()))


def budgets(d: int, limit: float) -> np.ndarray:
    """Squared distance of each block, in proportion to its dimensions; unit vectors of cosine c are 2 - 2 * c apart."""
    return np.array([(b - a) / d for a, b in cuts(d)]) * (2 - 2 * limit)


def _sign(kind: str):
    """vec_id, label, v -> vec_id, label, vec_key, vec (bytes), dims; key and bytes are null for vectors that link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, n = b.column(2), b.num_rows
            offs = lists.offsets.to_numpy().astype(np.int64)
            # Nulls among the components read as NaN; adding 0.0 makes -0.0 equal to 0.0.
            v = lists.values.to_numpy(zero_copy_only=False).astype(kind) + np.zeros(1, kind)
            inside = lambda flags: np.append(0, np.cumsum(flags))[offs]
            odd, full = np.diff(inside(~np.isfinite(v))), np.diff(inside(v != 0))
            good = (odd == 0) & (full > 0) & lists.is_valid().to_numpy(zero_copy_only=False)
            raw, width = v.tobytes(), v.itemsize
            vecs = [raw[offs[i] * width : offs[i + 1] * width] if good[i] else None for i in range(n)]
            keys = [None if x is None else xxhash.xxh3_128_digest(x) for x in vecs]
            dims = np.where(good, np.diff(offs), 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary()), pa.array(dims)], ["vec_id", "label", "vec_key", "vec", "dims"])

    return run


def _unit(vecs: pa.Array, kind: str) -> np.ndarray:
    v = np.frombuffer(b"".join(vecs.to_pylist()), kind).reshape(len(vecs), -1).astype(np.float64)
    # Largest component first, so that neither tiny nor huge vectors lose their norm.
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _by_dims(t: pa.Table) -> Iterator[pa.Table]:
    dims = t.column("dims").to_numpy()
    for d in np.unique(dims):
        yield t.filter(pa.array(dims == d))


def _sums(kind: str):
    """For each batch and group the count and the sums and squared sums of the rotated coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in _by_dims(pa.Table.from_batches([batch])):
                r = _unit(t.column("vec").combine_chunks(), kind) @ rotation(t.column("dims")[0].as_py())
                groups, at = np.unique(t.column("grp").to_numpy(), return_inverse=True)
                n, total, square = np.bincount(at), np.zeros((len(groups), r.shape[1])), np.zeros((len(groups), r.shape[1]))
                np.add.at(total, at, r)
                np.add.at(square, at, r * r)
                yield pa.RecordBatch.from_arrays([pa.array(groups), pa.array(n), pa.array(list(total)), pa.array(list(square))], ["grp", "n", "total", "square"])

    return run


def _spread(reps: DataFrame, kind: str) -> DataFrame:
    """(grp, size, mean, deviation): the vectors of each group, and of those that are to be split the means and standard
    deviations of their rotated coordinates, which are summed from a few numbers a group and batch."""
    sizes = stored(reps.groupBy("grp").agg(F.count("*").alias("size")), "group-sizes")
    large = reps.join(sizes.filter(F.col("size") > CELL).select("grp"), "grp", "left_semi")
    sums = large.select("grp", "dims", "vec").mapInArrow(_sums(kind), "grp long, n long, total array<double>, square array<double>")
    long = sums.select("grp", "n", F.posexplode(F.arrays_zip("total", "square")).alias("k", "x")).groupBy("grp", "k").agg(
        F.sum("n").alias("n"), F.sum("x.total").alias("total"), F.sum("x.square").alias("square")
    )
    mean = F.col("total") / F.col("n")
    deviation = F.sqrt(F.greatest(F.col("square") / F.col("n") - mean * mean, F.lit(0.0)))
    rows = long.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("k", mean.alias("mean"), deviation.alias("dev")))).alias("x"))
    rows = sizes.join(rows, "grp", "left").select("grp", "size", F.col("x.mean").alias("mean"), F.col("x.dev").alias("deviation"))
    return stored(rows, "spread")


#: Where a normal distribution has half, and the quarters, eighths and sixteenths of its mass.
_BORDERS = {1: (0.0,), 2: (-0.6745, 0.0, 0.6745), 3: (-1.1503, -0.6745, -0.3186, 0.0, 0.3186, 0.6745, 1.1503), 4: (-1.5341, -1.1503, -0.8871, -0.6745, -0.4888, -0.3186, -0.1573, 0.0, 0.1573, 0.3186, 0.4888, 0.6745, 0.8871, 1.1503, 1.5341)}


def _bits(size: int, dims: int, cell: int) -> list[int]:
    """How often each of a block's coordinates is halved, for a group of this size."""
    total = min(max(0, int(np.ceil(np.log2(max(size, 1) / cell)))), 4 * dims)
    return [total // dims + (c < total % dims) for c in range(dims)]


def _dealt(x: np.ndarray, borders: list[np.ndarray], budget: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, home) of rows x (coordinates of a block): each row's own cell, and those that its ball reaches.

    Coordinate by coordinate the cells split in two or more at the borders; a row goes on to those that still lie
    within the budget.
    """
    row, cell, used, home = np.arange(len(x)), np.zeros(len(x), np.uint64), np.zeros(len(x)), np.ones(len(x), bool)
    for c, cut in enumerate(borders):
        if not len(cut):
            continue
        low, high = np.append(-np.inf, cut), np.append(cut, np.inf)
        v = x[row, c]
        gap = np.maximum(0, np.maximum(low[None, :] - v[:, None], v[:, None] - high[None, :]))
        own = np.searchsorted(cut, v, "right")
        i, k = np.nonzero(used[:, None] + gap * gap <= budget + _SLACK)
        row, cell, used, home = row[i], mix(cell[i] * np.uint64(17) + k.astype(np.uint64) + np.uint64(1)), used[i] + gap[i, k] ** 2, home[i] & (k == own[i])
    return row, cell, home


def _cells(kind: str, limit: float):
    """Rows (cell, grp, node, home, block, dims, at) of each vector in each cell of each block that its ball reaches; `at`
    has the block's coordinates only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in _by_dims(pa.Table.from_batches([batch])):
                t = t.combine_chunks()
                d, group = int(t.column("dims")[0].as_py()), t.column("grp").to_numpy()
                r, ids = _unit(t.column("vec").combine_chunks(), kind) @ rotation(d), t.column("node").to_numpy()
                # Small groups are one cell a block; large ones are split, each at its own borders.
                wide = t.column("size").to_numpy() > CELL
                some = [(np.flatnonzero(~wide), None)] + [(np.flatnonzero(group == g), g) for g in np.unique(group[wide])]
                for of, g in some:
                    if not len(of):
                        continue
                    size, mean, deviation = (t.column(c)[int(of[0])].as_py() for c in ("size", "mean", "deviation"))
                    for k, ((a, b), budget) in enumerate(zip(cuts(d), budgets(d, limit))):
                        bits = [0] * (b - a) if g is None else _bits(size, b - a, CELL)
                        borders = [np.unique(mean[a + c] + deviation[a + c] * np.array(_BORDERS[n])) if n else np.zeros(0) for c, n in enumerate(bits)]
                        row, cell, home = _dealt(r[of, a:b], borders, budget)
                        cell = mix(cell ^ mix(group[of][row].view(np.uint64) + np.uint64(k + 1)))
                        at = pa.array([x.tobytes() for x in r[of, a:b].astype("<f4")], pa.binary()).take(pa.array(row))
                        n = len(row)
                        cols = [pa.array(cell.view(np.int64)), pa.array(group[of][row]), pa.array(ids[of][row]), pa.array(home), pa.array(np.full(n, k, np.int32)), pa.array(np.full(n, d, np.int32)), at]
                        yield pa.RecordBatch.from_arrays(cols, ["cell", "grp", "node", "home", "block", "dims", "at"])

    return run


def near_in_block(x: np.ndarray, y: np.ndarray, budget: float, leaf: int = LEAF) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(i, j, comparisons): the pairs x[i], y[j] with a squared distance of at most budget, found along a tree over y.

    Each node of the tree has the box of its points and is split at the median of its widest side; only those x go on
    whose distance to the box is within the budget. What reaches a leaf is compared point by point.
    """
    leaf, todo = min(leaf, max(8, 8 * leaf // x.shape[1])), [(np.arange(len(x)), np.arange(len(y)))]
    while todo:
        i, j = todo.pop()
        low, high = y[j].min(axis=0), y[j].max(axis=0)
        gap = np.maximum(np.maximum(low - x[i], x[i] - high), 0)
        i = i[np.einsum("ij,ij->i", gap, gap) <= budget]
        if not len(i):
            continue
        wide = int((high - low).argmax())
        if len(j) > leaf and high[wide] > low[wide]:
            order = np.argpartition(y[j, wide], len(j) // 2)
            todo += [(i, j[order[: len(j) // 2]]), (i, j[order[len(j) // 2 :]])]
            continue
        for s in range(0, len(i), 1 << 14):
            part = i[s : s + (1 << 14)]
            for c in range(0, len(j), 1024):
                q = j[c : c + 1024]
                square = np.einsum("ij,ij->i", x[part], x[part])[:, None] + np.einsum("ij,ij->i", y[q], y[q])[None, :] - 2 * x[part] @ y[q].T
                p, r = np.nonzero(square <= budget)
                yield part[p], q[r], len(part) * len(q)


def _survivors(limit: float):
    """Rows of a unit's vectors that are near another in its block: (cell, grp, node, home, block)."""
    keep = ["cell", "grp", "node", "home", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for u in _by_unit(batches):
            d, k = u.column("dims")[0].as_py(), u.column("block")[0].as_py()
            at = np.frombuffer(b"".join(u.column("at").to_pylist()), "<f4").reshape(u.num_rows, -1).astype(np.float64)
            home, part, a, b = (u.column(c).to_numpy(zero_copy_only=False) for c in ("home", "part", "part_a", "part_b"))
            near = np.zeros(u.num_rows, bool)
            for left, right in [(part == a, part == b)] + ([(part == b, part == a)] if a[0] != b[0] else []):
                x, y = np.flatnonzero(left & home), np.flatnonzero(right)
                if not len(x) or not len(y):
                    continue
                for i, j, _ in near_in_block(at[x], at[y], budgets(d, limit)[k] + 2 * _SLACK, LEAF):
                    other = x[i] != y[j]
                    near[x[i[other]]] = near[y[j[other]]] = True
            yield from u.filter(pa.array(near)).select(keep).to_batches()

    return run


def _by_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Each unit's vectors of one group, two or more; units are of bounded size."""
    for t, _ in whole_groups(batches, "unit", 1 << 40):
        k, g = t.column("unit").to_numpy(), t.column("grp").to_numpy()
        at = np.append(np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))), len(k))
        for lo, hi in zip(at[:-1], at[1:]):
            # Two groups in a unit are a collision of hashes.
            for group in np.unique(g[lo:hi]):
                u = t.slice(lo, hi - lo).filter(pa.array(g[lo:hi] == group)).combine_chunks()
                if u.num_rows > 1:
                    yield u


def _pairs(t: pa.Table, kind: str, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one unit: (ids, links found), and stars (a, b) over the components of its links."""
    ids, n, home, part, a, b = (t.column(c).to_numpy(zero_copy_only=False) for c in ("node", "n", "home", "part", "part_a", "part_b"))
    v = _unit(t.column("vec").combine_chunks(), kind)
    k, d = t.column("block")[0].as_py(), v.shape[1]
    cut, budget = cuts(d), budgets(d, limit)
    # Row by row the same sum whatever the unit, so that all units agree on the blocks in which a pair is near.
    turned = np.einsum("nd,de->ne", v, rotation(d))
    lo, hi = cut[k]
    own = turned[:, lo:hi]
    norm = (own * own).sum(axis=1)
    count, labels = np.zeros(len(ids), np.int64), Labels(len(ids))
    sides = [(part == a, part == b)] + ([(part == b, part == a)] if a[0] != b[0] else [])
    for left, right in sides:
        x_all, y = np.flatnonzero(left & home), np.flatnonzero(right)
        for s in range(0, len(x_all), 512):
            x = x_all[s : s + 512]
            near = norm[x][:, None] + norm[y][None, :] - 2 * own[x] @ own[y].T <= budget[k] + _SLACK
            i, j = np.nonzero(near)
            i, j = x[i], y[j]
            for c in range(0, len(i), 1 << 16):
                p, r = i[c : c + (1 << 16)], j[c : c + (1 << 16)]
                ok = (ids[p] != ids[r]) & ((v[p] * v[r]).sum(axis=1) >= limit)
                p, r = p[ok], r[ok]
                if not len(p):
                    continue
                # A pair may be near in several blocks; it counts in the first.
                gap = turned[p] - turned[r]
                inside = np.stack([(gap[:, e:f] ** 2).sum(axis=1) <= g * (1 + 1e-9) + 1e-15 for (e, f), g in zip(cut, budget)], axis=1)
                first = inside.argmax(axis=1) == k
                p, r = p[first], r[first]
                if not len(p):
                    continue
                np.add.at(count, p, n[r])
                labels.join_pairs(p, r)
    c, m = labels.stars()
    at = np.flatnonzero(count)
    return ids[at], count[at], ids[c], ids[m]


def _join(kind: str, limit: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for u in _by_unit(batches):
            ids, n, a, b = _pairs(u, kind, limit)
            rows = [pa.array(np.concatenate([ids, a])), pa.array(np.concatenate([n, np.zeros(len(a), np.int64)]))]
            yield pa.RecordBatch.from_arrays([*rows, pa.array([None] * len(ids) + b.tolist(), pa.int64())], ["a", "n", "b"])

    return run


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label", limit: float = 0.98) -> DataFrame:
    """Vectors linked by cosine >= limit within a label: (vec_id, n_links, component_id, kept), a row for each input row.

    Unit vectors with cosine c lie sqrt(2 - 2c) apart. After a fixed rotation they are cut into blocks of a few
    dimensions, and the squared distance is budgeted in proportion: linked vectors keep within the budget of one block at least. Each
    block is a range join over all its coordinates: the space of a label's block is split at the quantiles of its
    coordinates into cells of about CELL vectors, a vector is at home in one and is sent to every cell that its ball
    reaches, and within a cell a tree over the members prunes what lies beyond the budget. Only ids and a block's
    coordinates travel; whole vectors follow for those that have a neighbour in a block. Such pairs are verified in
    double precision, and each counts in the first block in which it is near, so no pair counts twice. No link is lost
    and none found below the limit, up to rounding.

    Equal vectors of a label are one with a count; crowded cells are split into parts that meet pairwise. Tasks put
    out counts and connecting edges, not pairs.

    Null labels (where there is a label column), null, empty and zero vectors and those with null or non-finite
    components link with nothing; nor do vectors of different lengths. Repeated rows count as vectors of their own,
    also with the same id. A vector without an id belongs to its component, which is named by the smallest id there is
    in it, or null. Other columns are not read.
    """
    spark = df.sparkSession
    kind = "<f4" if df.schema[vec_col].dataType.elementType.typeName() == "float" else "<f8"
    label = F.lit("") if label_col is None else F.col(label_col).cast("string")
    src = df.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), F.col(vec_col).alias("v"))
    signed = stored(src.mapInArrow(_sign(kind), "vec_id long, label string, vec_key binary, vec binary, dims int"), "vectors")
    good = signed.filter("label is not null and vec_key is not null").withColumn("grp", F.xxhash64("label", "dims"))
    # Equal vectors of a label are one node.
    reps = good.groupBy("grp", "vec_key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("vec").alias("vec"), F.first("dims").alias("dims"))
    reps = stored(reps.withColumn("node", F.xxhash64("grp", "vec_key")), "distinct")
    n_parts = partitions_of(spark)
    cells = reps.select("grp", "node", "dims", "vec").join(_spread(reps, kind), "grp")
    cells = cells.mapInArrow(_cells(kind, limit), "cell long, grp long, node long, home boolean, block int, dims int, at binary")
    cells = stored(cells, "cells")
    sizes = cells.groupBy("cell").agg(F.count("*").alias("n")).select("cell", F.when(F.col("n") > 4 * PART, F.ceil(F.col("n") / PART)).otherwise(1).cast("int").alias("parts"))
    units = in_units(cells, sizes, "cell", "node").repartition(n_parts, "unit").sortWithinPartitions("unit")
    near = stored(units.mapInArrow(_survivors(limit), "cell long, grp long, node long, home boolean, block int").distinct(), "near")
    sizes = near.groupBy("cell").agg(F.ceil(F.count("*") / PART_NEAR).cast("int").alias("parts"))
    whole = in_units(near, sizes, "cell", "node").drop("cell").join(reps.select("node", "n", "vec"), "node")
    whole = whole.repartition(n_parts, "unit").sortWithinPartitions("unit")
    out = whole.mapInArrow(_join(kind, limit), "a long, n long, b long")
    out = stored(out, "links")
    links = out.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    found = components(out.filter("b is not null"), "a", "b")
    least = found.join(reps.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("least"))
    found = found.join(least, "component").select("node", "least")
    of_key = reps.select("node", "rep", "n").join(links, "node", "left").join(found, "node", "left")
    of_key = of_key.select("node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("least", "rep").alias("component_id"))
    # Stored, so that both sides of the next join are dealt out for it, and Spark can split a vector that many rows share.
    of_key, grp = stored(of_key, "verdict-vectors"), F.xxhash64("label", "dims")
    keyed = signed.select("vec_id", F.when(F.col("label").isNotNull() & F.col("vec_key").isNotNull(), F.xxhash64(grp, "vec_key")).alias("node"))
    res = keyed.join(of_key, "node", "left")
    comp = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    res = res.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"))
    return res.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
