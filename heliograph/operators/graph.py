"""Density clustering on the sky, on grid joins and label propagation."""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from heliograph.functions import geo, healpix, ids
from heliograph.operators import reach
from heliograph.sources.scratch import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of undirected ``edges`` (a, b); the root is a component's smallest node.

    A round takes the smallest label among a node's neighbours, hooks a whole tree of labels to the smallest that any of
    its nodes has met, and follows labels to their labels, so that the rounds grow with the logarithm of a component's
    length. Every round is written to the shared folder, which cuts the lineage and outlives executors; the round before
    it is deleted. Rounds end when no label changes. Nulls in either column are left out; repeated edges and loops do no
    harm; no edges give no rows.
    """
    both = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select("a", "b")
    both = materialise(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("at")).agg(F.min("root").alias("near"))
        met = labels.join(near, F.col("node") == F.col("at"), "left").select("node", F.col("root").alias("was"), F.least("root", F.coalesce("near", "root")).alias("low"))
        hooks = met.where(F.col("low") < F.col("was")).groupBy(F.col("was").alias("node")).agg(F.min("low").alias("hook"))
        step = met.join(hooks, "node", "left").select("node", "was", F.least("low", F.coalesce("hook", "low")).alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("root").alias("over"))
        moved = materialise(step.join(jump, "next", "left").select("node", "was", F.least("next", F.coalesce("over", "next")).alias("root")), "labels")
        changed = not moved.where(F.col("root") != F.col("was")).isEmpty()
        discard(labels)
        labels = moved
        if not changed:
            discard(both)
            out = labels.drop("was")
            out._scratch = labels._scratch
            return out


def _gridded(points: DataFrame, key: str, ra: str, dec: str, chord: float) -> DataFrame:
    """(id, x, y, z, f): vectors with their cell of half the radius. All points of such a cell are in reach of each other."""
    x, y, z = geo.unit_vector(F.col(ra), F.col(dec))
    rows = points.select(F.col(key).alias("id"), x.alias("x"), y.alias("y"), z.alias("z"))
    return rows.withColumn("f", F.struct(*[F.floor(F.col(c) / (chord / 2)).cast("long").alias(c) for c in "xyz"]))


def _on_sphere(cell: list[Column], side: float) -> Column:
    """Whether a cell can hold a point of the sphere: its centre is at most half a diagonal off."""
    return F.abs(F.sqrt(sum(((c + 0.5) * (c + 0.5) for c in cell), F.lit(0.0))) * side - 1) <= 0.8661 * side


def _named(rows: DataFrame, *others: str) -> DataFrame:
    """Points with the names that :mod:`reach` takes."""
    return rows.select("id", *others, *[F.col(c).alias(f"_{c}") for c in "xyz"])


def dbscan(points: DataFrame, arcsec: float, least_points: int, least_members: int = 1, on: tuple[str, str, str] = ("id", "ra", "dec")) -> DataFrame:
    """(id, cluster): clusters are named by their smallest core id; border points go to the smallest core in reach.

    A point counts itself; noise and clusters of fewer than ``least_members`` give no rows.

    Points fall into cells whose points all reach each other. A cell of ``least_points`` or more is core as a whole, so
    that only points of thin cells, a few in each, are compared with their surroundings; clusters are components of
    cells, not of points. Pairs of points are never written or shuffled: they are counted, or reduced to pairs of cells,
    where they arise, and cells whose extents decide don't need them.
    """
    key, ra, dec = on
    chord = 2 * math.sin(math.radians(arcsec / 3600) / 2)
    rows = _gridded(points, key, ra, dec, chord)
    full = rows.groupBy("f").agg(F.count(F.lit(1)).alias("n"))
    rows = materialise(rows.join(full, "f").select("id", "x", "y", "z", "f", (F.col("n") >= least_points).alias("dense")), "points")
    thin = rows.where(~F.col("dense"))
    counted = reach.counts(_named(thin), _named(rows), arcsec, "id")
    found = thin.join(counted, "id").select("id", "x", "y", "z", "f", (F.col("n") >= least_points).alias("core"))
    found = materialise(rows.where("dense").select("id", "x", "y", "z", "f", F.lit(True).alias("core")).unionByName(found), "core-points")
    discard(rows)
    core = found.where("core").drop("core")
    extent = [g(c).alias(f"{n}{c}") for c in "xyz" for n, g in (("lo_", F.min), ("hi_", F.max))]
    cells = materialise(core.groupBy("f").agg(F.min("id").alias("cell"), F.count(F.lit(1)).alias("n"), *extent), "cells")
    flat = cells.select("cell", "f", "n", "lo_x", "hi_x", "lo_y", "hi_y", "lo_z", "hi_z")
    linked = materialise(_cell_pairs(flat, chord), "cell-pairs")
    unsure = linked.where(~F.col("sure")).select("a", "b", "n")
    named = core.join(cells.select("f", "cell"), "f")
    reaching, written = _reaching(unsure, named.select("cell", "x", "y", "z").distinct(), chord)
    roots = components(linked.where("sure").select("a", "b").union(reaching))
    discard(linked, *written)
    before, cells = cells, materialise(cells.join(roots.select(F.col("node").alias("cell"), "root"), "cell", "left").select("f", F.coalesce("root", "cell").alias("cluster")), "clusters")
    discard(before, roots)
    inner = core.join(cells, "f").select("id", "x", "y", "z", "f", "cluster")
    border = reach.firsts(_named(found.where(~F.col("core"))), _named(inner, "cluster"), arcsec, "id", ["cluster"], ["cluster"])
    all_ = inner.select(F.col("id").alias(key), "cluster").union(border.select(F.col("id").alias(key), "cluster"))
    if least_members <= 1:
        return all_
    big = all_.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_members).select("cluster")
    return all_.join(big, "cluster", "left_semi").select(key, "cluster")


#: Pairs of points that two cells, or parts of them, may make; beyond, they are compared by smaller parts first.
PAIR_POINTS = 1_000_000


def _reaching(pairs: DataFrame, points: DataFrame, chord: float) -> tuple[DataFrame, list[DataFrame]]:
    """(a, b) of ``pairs`` (a, b, n) of cells that have two points within the radius, and the tables that it reads.

    ``points`` has the different positions (cell, x, y, z); n is the number of pairs of points, or more. Pairs of few points
    are compared. Cells of others are cut into parts of half the width again and again: parts too far apart go, two parts
    wholly in reach decide their pair, which then needs no more work, and parts of few points are compared. Parts of equal
    points have no width, so that every pair is decided in the end.
    """
    square = lambda one, two: sum(((F.col(f"{one}.{c}") - F.col(f"{two}.{c}")) * (F.col(f"{one}.{c}") - F.col(f"{two}.{c}")) for c in "xyz"), F.lit(0.0))

    def compared(left: DataFrame, held: DataFrame, on: list[str]) -> DataFrame:
        """Pairs (a, b, ...) with a hit among the points of their parts."""
        p, q = (held.select(*[F.col(c).alias(f"{side}{c[4:]}") for c in on], F.struct("x", "y", "z").alias(name)) for side, name in (("a", "p"), ("b", "q")))
        return left.join(p, [f"a{c[4:]}" for c in on]).join(q, [f"b{c[4:]}" for c in on]).where(square("p", "q") <= chord * chord).select("a", "b").distinct()

    few = pairs.where(F.col("n") <= PAIR_POINTS).select("a", "b")
    found = compared(few, points, ["cell"])
    if pairs.where(F.col("n") > PAIR_POINTS).isEmpty():
        return found, []
    large = materialise(pairs.where(F.col("n") > PAIR_POINTS).select("a", "b"), "large-pairs")
    parts, left, level = [found], large, 0
    root = F.struct(*[F.lit(None).cast("long").alias(c) for c in "xyz"])
    while True:
        level += 1
        side = chord / 2 / 2**level
        part = F.struct(*[F.floor(F.col(c) / side).cast("long").alias(c) for c in "xyz"])
        above = root if level == 1 else F.struct(*[F.floor(F.col(c) / (2 * side)).cast("long").alias(c) for c in "xyz"])
        held = points.withColumns({"cell_part": part, "_above": above})
        extent = [g(c).alias(f"{n}{c}") for c in "xyz" for n, g in (("lo_", F.min), ("hi_", F.max))]
        boxes = held.groupBy("cell", "cell_part", "_above").agg(F.count(F.lit(1)).alias("n"), *extent)
        if level == 1:
            left = left.withColumns({"a_part": root, "b_part": root})
        one, two = (boxes.select(F.col("cell").alias(s_), F.col("_above").alias(f"_{s_}"), F.struct("cell_part", "n", *[f"{n}{c}" for c in "xyz" for n in ("lo_", "hi_")]).alias(name)) for s_, name in (("a", "l"), ("b", "r")))
        met = left.join(one, [left.a == one.a, left.a_part.eqNullSafe(one._a) if level > 1 else F.lit(True)]).drop(one.a)
        met = met.join(two, [met.b == two.b, met.b_part.eqNullSafe(two._b) if level > 1 else F.lit(True)]).drop(two.b)
        gap = lambda c: F.greatest(F.lit(0.0), F.col(f"l.lo_{c}") - F.col(f"r.hi_{c}"), F.col(f"r.lo_{c}") - F.col(f"l.hi_{c}"))
        span = lambda c: F.greatest(F.col(f"l.hi_{c}"), F.col(f"r.hi_{c}")) - F.least(F.col(f"l.lo_{c}"), F.col(f"r.lo_{c}"))
        near, far = (sum((g(c) * g(c) for c in "xyz"), F.lit(0.0)) for g in (gap, span))
        rows = met.where(near <= chord * chord).select("a", "b", F.col("l.cell_part").alias("a_part"), F.col("r.cell_part").alias("b_part"), (far <= chord * chord).alias("sure"), (F.col("l.n") * F.col("r.n")).alias("n"))
        rows = materialise(rows, "parts")
        sure = materialise(rows.where("sure").select("a", "b").distinct(), "reaching")
        open_ = rows.where("not sure").join(sure, ["a", "b"], "left_anti")
        few = materialise(compared(open_.where(F.col("n") <= PAIR_POINTS).select("a", "b", "a_part", "b_part"), held, ["cell", "cell_part"]), "reaching")
        before, left = left, materialise(open_.where(F.col("n") > PAIR_POINTS).join(few, ["a", "b"], "left_anti").select("a", "b", "a_part", "b_part"), "large-pairs")
        parts += [sure, few]
        discard(rows, large if level == 1 else before)
        if left.isEmpty():
            discard(left)
            return reduce(DataFrame.unionByName, parts).distinct(), parts[1:]


def _cell_pairs(cells: DataFrame, chord: float) -> DataFrame:
    """(a, b, sure, n) of core cells near each other, once each: sure if their extents alone put all points in reach; n pairs of points."""
    steps = [(i, j, k) for i in range(-2, 3) for j in range(-2, 3) for k in range(-2, 3) if (i, j, k) > (0, 0, 0)]
    around = F.array(*[F.struct(F.lit(i).alias("x"), F.lit(j).alias("y"), F.lit(k).alias("z")) for i, j, k in steps])
    half, f = chord / 2, F.col("f")
    one = cells.withColumn("_s", F.explode(around)).withColumn("_f", F.struct(*[(f[c] + F.col("_s")[c]).alias(c) for c in "xyz"])).where(_on_sphere([f[c] + F.col("_s")[c] for c in "xyz"], half)).drop("_s").alias("l")
    two = cells.alias("r")
    gap = lambda c: F.greatest(F.lit(0.0), F.col(f"l.lo_{c}") - F.col(f"r.hi_{c}"), F.col(f"r.lo_{c}") - F.col(f"l.hi_{c}"))
    span = lambda c: F.greatest(F.col(f"l.hi_{c}"), F.col(f"r.hi_{c}")) - F.least(F.col(f"l.lo_{c}"), F.col(f"r.lo_{c}"))
    near, far = (sum((g(c) * g(c) for c in "xyz"), F.lit(0.0)) for g in (gap, span))
    met = one.join(two, F.col("l._f") == F.col("r.f")).where(near <= chord * chord)
    return met.select(F.col("l.cell").alias("a"), F.col("r.cell").alias("b"), (far <= chord * chord).alias("sure"), (F.col("l.n") * F.col("r.n")).alias("n"))


def centroids(df: DataFrame, key: str, ra: str, dec: str) -> DataFrame:
    """Mean direction of each key's positions, and their number."""
    x, y, z = geo.unit_vector(F.col(ra), F.col(dec))
    sums = df.groupBy(key).agg(F.avg(x).alias("x"), F.avg(y).alias("y"), F.avg(z).alias("z"), F.count(F.lit(1)).alias("n"))
    a, d = geo.angles(F.col("x"), F.col("y"), F.col("z"))
    return sums.select(key, a.alias("ra"), d.alias("dec"), "n")


def name_clusters(members: DataFrame, positions: DataFrame, on: tuple[str, str, str] = ("id", "ra", "dec"), order: int = 5) -> DataFrame:
    """(id, source): each cluster's packed identifier from its centroid and the pixel that owns it."""
    key, ra, dec = on
    centre = centroids(members.join(positions, key), "cluster", ra, dec)
    named = centre.select("cluster", ids.encode(healpix.pixel(F.col("ra"), F.col("dec"), order), F.col("ra"), F.col("dec")).alias("source"))
    return members.join(named, "cluster").select(key, "source")


#: The order of pixels that make up borders, and a lower bound of a pixel's width as a share of the root of its area.
BORDER_ORDER, NARROWEST = 13, 0.4


def border_order(margin_arcsec: float) -> int:
    """The finest order, up to ``BORDER_ORDER``, whose pixels are all wider than the margin."""
    width = NARROWEST * math.degrees(math.sqrt(4 * math.pi / 12)) * 3600
    return max(0, min(BORDER_ORDER, int(math.log2(max(1.0, width / margin_arcsec)))))


def with_halo(points: DataFrame, margin_arcsec: float, order: int, on: tuple[str, str, str] = ("id", "ra", "dec"), finer: dict[int, int] | None = None, border: int | None = None) -> DataFrame:
    """Each point once for its own pixel (``owner`` true) and once for every other pixel whose border ring holds it.

    A pixel's border ring is made of the pixels of order ``border`` that touch it from outside: exactly those of whose
    eight neighbours one lies inside. Without ``border`` it is the finest order whose pixels are wider than the margin, so
    that the ring holds every point within ``margin_arcsec`` of the pixel.

    ``finer`` gives pixels of ``order`` that are cut, and the orders of their pieces; then ``pixel`` numbers the pieces.
    ``shared`` tells whether a point has more than one row.
    """
    _, ra, dec = on
    finest = max(finer.values()) if finer else order
    border = max(border_order(margin_arcsec) if border is None else border, finest)
    cut_pixels = np.array(sorted(finer or {}), np.int64)
    cut_orders = np.array([finer[p] for p in cut_pixels.tolist()] if finer else [], np.int64)

    def piece(small: np.ndarray) -> np.ndarray:  # numbers are nested: a coarser pixel's number is a finer one's without its last bits
        fine = small >> 2 * (border - finest)
        if not finer:
            return fine
        coarse = fine >> 2 * (finest - order)
        at = np.minimum(np.searchsorted(cut_pixels, coarse), len(cut_pixels) - 1)
        cut = np.where(cut_pixels[at] == coarse, cut_orders[at], order)
        return (fine >> 2 * (finest - cut)) + (cut << 40)

    low_bits = (1 << 2 * (border - finest)) - 1
    axes = [(0x5555555555555555 << k) & low_bits for k in (0, 1)]

    def spread(batches):
        for batch in batches:
            position = [batch.column(batch.schema.get_field_index(c)).cast(pa.float64()) for c in (ra, dec)]
            known = np.flatnonzero((position[0].is_valid().to_numpy(False)) & (position[1].is_valid().to_numpy(False)))
            small = healpix.pixels(*(c.to_numpy(False)[known] for c in position), border)
            own = piece(small)
            # most points lie within their piece and touch no other
            inside = small & low_bits
            edge = np.flatnonzero(reduce(or_, [((inside & axis) == 0) | ((inside & axis) == axis) for axis in axes]))
            around = healpix.neighbour_pixels(small[edge], border)
            there = np.where(around >= 0, piece(np.maximum(around, 0)), -1)
            rows, other = np.repeat(edge, 8), there.ravel()
            new = (other >= 0) & (other != own[rows])
            pairs = np.unique(np.stack([rows[new], other[new]], 1), axis=0)
            shared = np.zeros(len(batch), bool)
            shared[known[pairs[:, 0]]] = True
            whole = np.zeros(len(batch), np.int64)
            whole[known] = own
            missing = np.ones(len(batch), bool)
            missing[known] = False
            at = np.concatenate((np.arange(len(batch)), known[pairs[:, 0]]))
            none = np.concatenate((missing, np.zeros(len(pairs), bool)))
            columns = [batch.column(k).take(pa.array(at)) for k in range(batch.num_columns)]
            columns += [pa.array(shared[at]), pa.array(np.concatenate((whole, pairs[:, 1])), pa.int64(), mask=none), pa.array(np.concatenate((np.ones(len(batch), bool), np.zeros(len(pairs), bool))), mask=none)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "shared", "pixel", "owner"])

    schema = StructType([*points.schema.fields, StructField("shared", BooleanType()), StructField("pixel", LongType()), StructField("owner", BooleanType())])
    return points.mapInArrow(spread, schema)


#: Pairs of points that a pixel's task compares at a time, at most.
PAIRS_AT_ONCE = 2_000_000


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    base = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - base, lengths)


def _near_pairs(v: np.ndarray, cell: np.ndarray, left: np.ndarray, right: np.ndarray, chord: float):
    """Blocks (i, j) of places of left and right points within the radius, by cells as wide as it."""
    wide = cell >> 1
    low = wide.min(0) - 1
    size = wide.max(0) - low + 2
    number = lambda c: ((c[:, 0] - low[0]) * size[1] + c[:, 1] - low[1]) * size[2] + c[:, 2] - low[2]
    order = np.argsort(number(wide[right]), kind="stable")
    right, codes = right[order], number(wide[right])[order]
    for step in np.ndindex(3, 3, 3):
        wanted = number(wide[left] + np.array(step) - 1)
        first, last = np.searchsorted(codes, wanted, "left"), np.searchsorted(codes, wanted, "right")
        some = np.flatnonzero(last > first)
        ends = np.cumsum((last - first)[some])
        lo = 0
        while lo < len(some):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS_AT_ONCE, "right")))
            part = some[lo:hi]
            i, j = np.repeat(left[part], (last - first)[part]), right[_spans(first[part], (last - first)[part])]
            hit = ((v[i] - v[j]) ** 2).sum(1) <= chord * chord
            yield i[hit], j[hit]
            lo = hi


def _joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number of the component of each of ``n`` nodes."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if np.array_equal(low, label):
            return label
        label = low


def _touching(v: np.ndarray, members: list[np.ndarray], a: np.ndarray, b: np.ndarray, chord: float) -> np.ndarray:
    """Which pairs of cells have two points within the radius; a pair ends at its first block with a hit."""
    out = np.zeros(len(a), bool)
    for k, (x, y) in enumerate(zip(a, b)):
        one, two = v[members[x]], v[members[y]]
        rows = max(1, PAIRS_AT_ONCE // len(two))
        out[k] = any((((one[i : i + rows, None] - two[None]) ** 2).sum(2) <= chord * chord).any() for i in range(0, len(one), rows))
    return out


def _dbscan_frame(pdf: pd.DataFrame, key: str, ra: str, dec: str, arcsec: float, least_points: int) -> pd.DataFrame:
    """Memberships of one pixel and its margin (id, core, owner, local cluster), by cells as in :func:`dbscan`.

    A core point has its local cluster; a border point that the pixel owns has every local cluster in its reach.
    """
    pdf = pdf.sort_values(key, kind="stable")
    a, d = np.radians(pdf[ra].to_numpy(float)), np.radians(pdf[dec].to_numpy(float))
    v = np.stack([np.cos(d) * np.cos(a), np.cos(d) * np.sin(a), np.sin(d)], 1)
    chord = 2 * math.sin(math.radians(arcsec / 3600) / 2)
    grid = np.floor(v / (chord / 2)).astype(np.int64)
    cells, of, sizes = np.unique(grid, axis=0, return_inverse=True, return_counts=True)
    of = of.reshape(-1)
    everyone, core = np.arange(len(v)), sizes[of] >= least_points
    thin = np.flatnonzero(~core)
    reached = np.zeros(len(v), np.int64)
    for i, _ in _near_pairs(v, grid, thin, everyone, chord):
        reached += np.bincount(i, minlength=len(v))
    core[thin] = reached[thin] >= least_points
    inner = np.flatnonzero(core)
    used, place = np.unique(of[inner], return_inverse=True)
    if len(used):
        order = np.argsort(place, kind="stable")
        cuts = np.searchsorted(place[order], np.arange(len(used)))
        members = np.split(inner[order], cuts[1:])
        low, high = np.minimum.reduceat(v[inner[order]], cuts), np.maximum.reduceat(v[inner[order]], cuts)
        own = cells[used]
        low_cell, span = own.min(0) - 2, own.max(0) - own.min(0) + 5
        number = lambda c: ((c[:, 0] - low_cell[0]) * span[1] + c[:, 1] - low_cell[1]) * span[2] + c[:, 2] - low_cell[2]
        by = np.argsort(number(own))
        codes, left, right = number(own)[by], [], []
        for step in np.ndindex(5, 5, 5):
            if step > (2, 2, 2):
                wanted = number(own + np.array(step) - 2)
                at = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
                hit = np.flatnonzero(codes[at] == wanted)
                left.append(hit), right.append(by[at[hit]])
        one, two = np.concatenate(left), np.concatenate(right)
        gap = np.maximum(0, np.maximum(low[one] - high[two], low[two] - high[one]))
        near = (gap**2).sum(1) <= chord * chord
        one, two = one[near], two[near]
        sure = ((np.maximum(high[one], high[two]) - np.minimum(low[one], low[two])) ** 2).sum(1) <= chord * chord
        linked = sure.copy()
        linked[~sure] = _touching(v, members, one[~sure], two[~sure], chord)
        group = _joined(len(used), one[linked], two[linked])
        # rows are in order of id, so the least place of a group is its least id
        least = np.full(len(used), len(v))
        np.minimum.at(least, group, np.array([m.min() for m in members]))
        label = np.full(len(v), -1)
        label[inner] = least[group[place]]
    ids, owner = pdf[key].to_numpy(), pdf["owner"].to_numpy(bool)
    who, local = [inner], [label[inner]] if len(used) else [inner]
    border = np.flatnonzero(~core & owner)
    if len(border) and len(inner):
        pairs = [np.stack([i, label[j]], 1) for i, j in _near_pairs(v, grid, border, inner, chord)]
        pairs = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
        who.append(pairs[:, 0]), local.append(pairs[:, 1])
    who, local = np.concatenate(who), np.concatenate(local)
    return pd.DataFrame({key: ids[who], "core": core[who], "owner": owner[who], "local": ids[local]})


#: Points of a pixel from which it is cut into finer ones.
PIXEL_ROWS = 100_000


def pieces(points: DataFrame, margin_arcsec: float, order: int, on: tuple[str, str, str]) -> DataFrame:
    """:func:`with_halo` with pixels of more than ``PIXEL_ROWS`` points cut, into pieces of an order that follows their number, as far as the margin lets."""
    _, ra, dec = on
    border = border_order(margin_arcsec)
    order = min(order, border)
    sizes = points.groupBy(healpix.pixel(F.col(ra), F.col(dec), order).alias("pixel")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PIXEL_ROWS)
    finer = {r["pixel"]: min(border, order + math.ceil(0.5 * math.log2(r["n"] / PIXEL_ROWS))) for r in sizes.collect()}  # 12,288 pixels at order 5
    return with_halo(points.select(*on), margin_arcsec, order, on, finer, border)


def dbscan_by_pixel(points: DataFrame, arcsec: float, least_points: int, least_members: int = 1, order: int = 5, margin_arcsec: float = 0.0, on: tuple[str, str, str] = ("id", "ra", "dec")) -> DataFrame:
    """The same clusters as :func:`dbscan`, of any length: pixels find local clusters, and shared core points join them.

    Four radii of margin make sure that a pixel knows which neighbours of its own points are core points; a wider margin
    changes nothing. A task holds one pixel, or a piece of a crowded one; there the work follows the number of cells.
    """
    key, ra, dec = on
    halo = pieces(points, max(margin_arcsec, 4 * arcsec), order, on)
    kind = dict(points.dtypes)[key]
    found = materialise(halo.groupBy("pixel").applyInPandas(lambda pdf: _dbscan_frame(pdf, key, ra, dec, arcsec, least_points), f"{key} {kind}, core boolean, owner boolean, local {kind}"), "local-clusters")
    shared = found.where("core").groupBy(key).agg(F.collect_set("local").alias("all")).where(F.size("all") > 1)  # as many as pixels meet there
    joined = components(shared.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a <> b")).select(F.col("node").alias("local"), F.col("root").alias("label"))
    named = found.where("owner").join(joined, "local", "left").groupBy(key).agg(F.min(F.coalesce("label", "local")).alias("cluster"))
    if least_members <= 1:
        return named
    big = named.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_members).select("cluster")
    return named.join(big, "cluster", "left_semi").select(key, "cluster")
