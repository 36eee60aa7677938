"""HEALPix NESTED pixels as Column expressions (the published closed form of Gorski et al. 2005)."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.functions import geo


def parent(pixel: Column, order: int, coarser: int) -> Column:
    return F.shiftright(pixel, 2 * (order - coarser))


def children(pixel: Column, order: int, finer: int) -> Column:
    step = 1 << 2 * (finer - order)
    return F.sequence(pixel * step, pixel * step + (step - 1))


def _spread(value: Column, order: int) -> Column:
    """Bits of ``value`` at even places."""
    out = F.lit(0).cast("long")
    for k in range(order):
        out = out + F.shiftleft(F.shiftright(value, k).bitwiseAND(F.lit(1).cast("long")), 2 * k)
    return out


def pixel(ra: Column, dec: Column, order: int) -> Column:
    """NESTED pixel of a position at ``order``."""
    side = 1 << order
    long = lambda c: F.floor(c).cast("long")
    z = F.sin(F.radians(dec))
    turn = F.pmod(ra, F.lit(360.0)) / 90
    # equatorial belt
    up, down = long(side * (0.5 + turn) - side * z * 0.75), long(side * (0.5 + turn) + side * z * 0.75)
    face_up, face_down = F.shiftright(up, order), F.shiftright(down, order)
    belt_face = F.when(face_up == face_down, face_up.bitwiseAND(F.lit(3).cast("long")) + 4).when(face_up < face_down, face_up).otherwise(face_down + 8)
    mask = F.lit(side - 1).cast("long")
    belt_x, belt_y = down.bitwiseAND(mask), F.lit(side - 1) - up.bitwiseAND(mask)
    # polar caps
    quarter = F.least(F.lit(3).cast("long"), long(turn))
    within, reach = turn - quarter, side * F.sqrt(3 * (1 - F.abs(z)))
    one, two = F.least(mask, long(within * reach)), F.least(mask, long((1 - within) * reach))
    cap_face = F.when(z >= 0, quarter).otherwise(quarter + 8)
    cap_x, cap_y = F.when(z >= 0, mask - two).otherwise(one), F.when(z >= 0, mask - one).otherwise(two)
    belt = F.abs(z) <= 2 / 3
    face, x, y = F.when(belt, belt_face).otherwise(cap_face), F.when(belt, belt_x).otherwise(cap_x), F.when(belt, belt_y).otherwise(cap_y)
    return face * (side * side) + _spread(x.cast("long"), order) + 2 * _spread(y.cast("long"), order)


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


# Masks of every second bit, pair, nibble, byte and so on, for taking the bits of two numbers apart.
_MASKS = [0x5555555555555555, 0x3333333333333333, 0x0F0F0F0F0F0F0F0F, 0x00FF00FF00FF00FF, 0x0000FFFF0000FFFF, 0x00000000FFFFFFFF]


def _halved(value: Column, shift, by: int, mask: Column) -> Column:
    return _bound(value, lambda v: v.bitwiseOR(shift(v, by)).bitwiseAND(mask))


def _gathered(value: Column) -> Column:
    """The bits at even places of ``value``, next to each other, by halving the gaps."""
    masks = [F.lit(m).cast("long") for m in _MASKS]
    out = value.bitwiseAND(masks[0])
    for k in range(5):
        out = _halved(out, F.shiftright, 1 << k, masks[k + 1])
    return out


def _spread_out(value: Column) -> Column:
    masks = [F.lit(m).cast("long") for m in _MASKS]
    out = value
    for k in reversed(range(5)):
        out = _halved(out, F.shiftleft, 1 << k, masks[k])
    return out


def _face(nested: Column, order: int) -> tuple[Column, Column, Column]:
    """Base pixel of a nested pixel, and its place within that."""
    nested = nested.cast("long")
    inside = nested.bitwiseAND(F.lit((1 << 2 * order) - 1).cast("long"))
    return F.shiftright(nested, 2 * order), _gathered(inside), _gathered(F.shiftright(inside, 1))


# The base pixel beyond each border of the twelve base pixels (-1: none), in the order S, SE, E, SW, own,
# NE, W, NW, N; how places turn there for base pixels of the north, belt and south (1: mirror x, 2: mirror y, 4: swap).
BEYOND = [
    [8, 9, 10, 11, -1, -1, -1, -1, 10, 11, 8, 9],
    [5, 6, 7, 4, 8, 9, 10, 11, 9, 10, 11, 8],
    [-1, -1, -1, -1, 5, 6, 7, 4, -1, -1, -1, -1],
    [4, 5, 6, 7, 11, 8, 9, 10, 11, 8, 9, 10],
    [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11],
    [1, 2, 3, 0, 0, 1, 2, 3, 5, 6, 7, 4],
    [-1, -1, -1, -1, 7, 4, 5, 6, -1, -1, -1, -1],
    [3, 0, 1, 2, 3, 0, 1, 2, 4, 5, 6, 7],
    [2, 3, 0, 1, -1, -1, -1, -1, 0, 1, 2, 3],
]
TURNS = [[0, 0, 3], [0, 0, 6], [0, 0, 0], [0, 0, 5], [0, 0, 0], [5, 0, 0], [0, 0, 0], [6, 0, 0], [3, 0, 0]]


def neighbours(nested: Column, order: int) -> Column:
    """The up to eight pixels around a nested pixel, as an array: SW, W, NW, N, NE, E, SE, S; -1 where there is none."""
    side = 1 << order
    by_border = F.array(*[F.array(*[F.lit(v).cast("long") for v in row]) for row in BEYOND])
    turns = F.array(*[F.array(*[F.lit(v) for v in row]) for row in TURNS])
    steps = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i, j in ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))])
    over = lambda v: F.when(v < 0, -1).when(v >= side, 1).otherwise(0)
    wrap = lambda v: F.pmod(v, F.lit(side).cast("long"))

    def entered(place: Column, at: Column) -> Column:
        """The pixel at a place that may lie beyond its base pixel's border; ``at`` has what the border does to it."""
        has = lambda bit: at["turn"].bitwiseAND(F.lit(bit)) > 0
        in_x, in_y = F.when(has(1), side - 1 - wrap(place["x"])).otherwise(wrap(place["x"])), F.when(has(2), side - 1 - wrap(place["y"])).otherwise(wrap(place["y"]))
        to_x, to_y = F.when(has(4), in_y).otherwise(in_x), F.when(has(4), in_x).otherwise(in_y)
        return F.when(at["into"] < 0, F.lit(-1).cast("long")).otherwise(at["into"] * (side * side) + _spread_out(to_x) + 2 * _spread_out(to_y))

    def moved(own: Column, step: Column) -> Column:
        place = F.struct((own["x"] + step["dx"]).alias("x"), (own["y"] + step["dy"]).alias("y"))
        border = lambda p: F.lit(4) + over(p["x"]) + 3 * over(p["y"])
        crossing = lambda p: F.struct(F.get(F.get(by_border, border(p)), own["face"].cast("int")).alias("into"), F.get(F.get(turns, border(p)), F.shiftright(own["face"], 2).cast("int")).alias("turn"))
        return _bound(place, lambda p: _bound(crossing(p), lambda at: entered(p, at)))

    face, x, y = _face(nested, order)
    return _bound(F.struct(face.alias("face"), x.alias("x"), y.alias("y")), lambda own: F.transform(steps, lambda step: moved(own, step)))


def _ring(nested: Column, order: int) -> tuple[Column, Column, Column, Column]:
    """Ring of a nested pixel, pixels in a quarter of it, its place in the ring from 1, and whether the ring is shifted."""
    side = 1 << order
    face, x, y = _face(nested, order)
    row = F.shiftright(face, 2) + 2  # the face's lowest corner is in this multiple of rings
    ring = row * side - x - y - 1
    quarter = F.when(ring < side, ring).when(ring > 3 * side, 4 * side - ring).otherwise(side)
    shifted = F.when((ring < side) | (ring > 3 * side), 0).otherwise((ring - side).bitwiseAND(F.lit(1).cast("long")))
    # half-quarters east of the meridian at which a face is centred
    east = 2 * F.pmod(face, F.lit(4)) + F.when(F.shiftright(face, 2) == 1, 0).otherwise(1)
    place = F.floor((east * quarter + x - y + 1 + shifted) / 2)
    place = F.when(place > 4 * quarter, place - 4 * quarter).when(place < 1, place + 4 * quarter).otherwise(place)
    return ring, quarter, place, shifted


def centre(nested: Column, order: int) -> tuple[Column, Column]:
    """Right ascension and declination of a nested pixel's centre, in degrees."""
    side = 1 << order
    ring, quarter, place, shifted = _ring(nested, order)
    cap = quarter * quarter / (3.0 * side * side)
    z = F.when(ring < side, 1 - cap).when(ring > 3 * side, cap - 1).otherwise((2 * side - ring) * 2 / (3.0 * side))
    return F.pmod((place - (shifted + 1) * 0.5) * 90 / quarter, F.lit(360.0)), F.degrees(F.asin(z))


def to_ring(nested: Column, order: int) -> Column:
    """Number of a nested pixel in the ring scheme."""
    side = 1 << order
    ring, quarter, place, _ = _ring(nested, order)
    before = F.when(ring < side, 2 * quarter * (quarter - 1)).when(ring > 3 * side, 12 * side * side - 2 * quarter * (quarter + 1)).otherwise(2 * side * (side - 1) + (ring - side) * 4 * side)
    return (before + place - 1).cast("long")


def belt_cover(spark: SparkSession, latitude: float, order: int, finer: int = 3) -> DataFrame:
    """Pixels at ``order`` that hold a pixel centre, ``finer`` orders below, within ``latitude`` degrees of the galactic plane."""
    pixels = spark.range(12 << 2 * (order + finer))
    ra, dec = centre(F.col("id"), order + finer)
    return pixels.where(F.abs(geo.galactic_latitude(ra, dec)) < latitude).select(F.shiftright("id", 2 * finer).cast("long").alias("pixel")).distinct()


def reach(order: int) -> float:
    """Degrees from a pixel's centre within which all of any pixel of that order lies: half the longest diagonal, that of the pixels beside a cap's corner."""
    side = 1 << order
    one, two = 2 / 3, 1 - (1 - 1 / side) ** 2 / 3
    cosine = one * two + math.sqrt(1 - one * one) * math.sqrt(max(0.0, 1 - two * two)) * math.cos(math.pi / (4 * side))
    return math.degrees(math.acos(min(1.0, cosine))) * (1 + 1e-9)


def pixels(ra: np.ndarray, dec: np.ndarray, order: int) -> np.ndarray:
    """:func:`pixel` for arrays."""
    side = 1 << order
    mask, long = side - 1, lambda v: np.floor(v).astype(np.int64)
    z, turn = np.sin(np.radians(dec)), np.mod(ra, 360.0) / 90
    up, down = long(side * (0.5 + turn) - side * z * 0.75), long(side * (0.5 + turn) + side * z * 0.75)
    face_up, face_down = up >> order, down >> order
    belt_face = np.where(face_up == face_down, (face_up & 3) + 4, np.where(face_up < face_down, face_up, face_down + 8))
    quarter = np.minimum(3, long(turn))
    within, reach_ = turn - quarter, side * np.sqrt(3 * (1 - np.abs(z)))
    one, two = np.minimum(mask, long(within * reach_)), np.minimum(mask, long((1 - within) * reach_))
    belt, north = np.abs(z) <= 2 / 3, z >= 0
    face = np.where(belt, belt_face, np.where(north, quarter, quarter + 8))
    x = np.where(belt, down & mask, np.where(north, mask - two, one))
    y = np.where(belt, mask - (up & mask), np.where(north, mask - one, two))
    return _nested(face, x, y, order)


def _nested(face: np.ndarray, x: np.ndarray, y: np.ndarray, order: int) -> np.ndarray:
    out = face << 2 * order
    for k in range(order):
        out = out | (x >> k & 1) << 2 * k | (y >> k & 1) << 2 * k + 1
    return out


def neighbour_pixels(nested: np.ndarray, order: int) -> np.ndarray:
    """:func:`neighbours` for arrays: eight columns."""
    side, inside = 1 << order, nested & ((1 << 2 * order) - 1)
    face, x, y = nested >> 2 * order, np.zeros_like(nested), np.zeros_like(nested)
    for k in range(order):
        x |= (inside >> 2 * k & 1) << k
        y |= (inside >> 2 * k + 1 & 1) << k
    beyond, turns, out = np.array(BEYOND), np.array(TURNS), np.empty((len(nested), 8), np.int64)
    for column, (i, j) in enumerate(((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))):
        at_x, at_y = x + i, y + j
        over = lambda v: np.where(v < 0, -1, np.where(v >= side, 1, 0))
        border = 4 + over(at_x) + 3 * over(at_y)
        into, turn = beyond[border, face], turns[border, face >> 2]
        at_x, at_y = at_x % side, at_y % side
        at_x, at_y = np.where(turn & 1, side - 1 - at_x, at_x), np.where(turn & 2, side - 1 - at_y, at_y)
        to_x, to_y = np.where(turn & 4, at_y, at_x), np.where(turn & 4, at_x, at_y)
        out[:, column] = np.where(into < 0, -1, _nested(np.maximum(into, 0), to_x, to_y, order))
    return out


def centres(nested: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`centre` for arrays."""
    side, inside = 1 << order, nested & ((1 << 2 * order) - 1)
    face, x, y = nested >> 2 * order, np.zeros_like(nested), np.zeros_like(nested)
    for k in range(order):
        x |= (inside >> 2 * k & 1) << k
        y |= (inside >> 2 * k + 1 & 1) << k
    ring = ((face >> 2) + 2) * side - x - y - 1
    quarter = np.where(ring < side, ring, np.where(ring > 3 * side, 4 * side - ring, side))
    shifted = np.where((ring < side) | (ring > 3 * side), 0, (ring - side) & 1)
    place = (2 * (face & 3) + (face >> 2 != 1)) * quarter + x - y + 1 + shifted >> 1
    cap = quarter * quarter / (3.0 * side * side)
    z = np.where(ring < side, 1 - cap, np.where(ring > 3 * side, cap - 1, (2 * side - ring) * 2 / (3.0 * side)))
    return np.mod((place - (shifted + 1) * 0.5) * 90 / quarter, 360.0), np.degrees(np.arcsin(z))


def tree_cover(spark: SparkSession, outside: Callable[[np.ndarray, np.ndarray], np.ndarray], orders: Sequence[int], finer: int = 3) -> DataFrame:
    """(order, pixel) of all pixels that meet a region, by descent in the tree of nested pixels.

    ``outside(ra, dec)`` gives the degrees from positions to the region, 0 or less inside. A pixel is followed while its
    centre is no further away than it reaches, so none that meets the region is left out; following it ``finer`` orders
    below the finest asked for leaves out all but those that come within a thin rim. Tasks start from pixels nine orders
    above the last, so that a task holds a quarter of a million of them at most.
    """
    wanted, last = sorted(set(orders)), max(orders) + finer
    start = max(0, last - 9)

    def run(batches):
        for batch in batches:
            pixels = batch.column("id").to_numpy()
            for first in pixels[outside(*centres(pixels, start)) <= reach(start)]:
                own = np.array([first])
                for order in range(start + 1, last + 1):
                    own = (4 * own[:, None] + np.arange(4)).ravel()
                    own = own[outside(*centres(own, order)) <= reach(order)]
                for order in wanted:
                    found = np.unique(own >> 2 * (last - order))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), order, np.int32)), pa.array(found)], ["order", "pixel"])

    found = spark.range(12 << 2 * start).mapInArrow(run, "order int, pixel long")
    return found.distinct() if min(wanted) < start else found


def from_circle(ra0: float, dec0: float, radius: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Degrees from positions to a filled circle."""

    def outside(ra, dec):
        d, half = np.radians(dec), np.sin(np.radians(ra - ra0) / 2)
        h = np.sin((d - math.radians(dec0)) / 2) ** 2 + np.cos(d) * math.cos(math.radians(dec0)) * half * half
        return np.degrees(2 * np.arcsin(np.sqrt(np.minimum(1.0, h)))) - radius

    return outside


def from_belt(latitude: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Degrees from positions to the belt around the galactic plane."""

    def outside(ra, dec):
        d, pole = np.radians(dec), math.radians(geo.POLE_DEC)
        s = np.sin(d) * math.sin(pole) + np.cos(d) * math.cos(pole) * np.cos(np.radians(ra - geo.POLE_RA))
        return np.abs(np.degrees(np.arcsin(np.clip(s, -1, 1)))) - latitude

    return outside


def subdivision_order(rows: Column) -> Column:
    """Order into which a partition of ``rows`` rows is cut so that pieces fit in memory; never coarser than 5."""
    small = F.ceil(0.5 * F.log2(rows / 19e6))
    large = F.least(F.lit(12), 5 + F.ceil(0.5 * F.log2(rows / 1e6)))
    return F.greatest(F.lit(5), F.when(rows < 80_000_000, small).otherwise(large)).cast("int")


def _python_pixel(ra: float, dec: float, order: int) -> int:
    """The same for one position, for the covers of circles and for tests."""
    side = 1 << order
    z, turn = math.sin(math.radians(dec)), (ra % 360) / 90
    if abs(z) <= 2 / 3:
        up, down = math.floor(side * (0.5 + turn) - side * z * 0.75), math.floor(side * (0.5 + turn) + side * z * 0.75)
        a, b = up >> order, down >> order
        face = (a & 3) + 4 if a == b else a if a < b else b + 8
        x, y = down & (side - 1), side - 1 - (up & (side - 1))
    else:
        quarter = min(3, math.floor(turn))
        reach = side * math.sqrt(3 * (1 - abs(z)))
        one, two = (min(side - 1, math.floor(v * reach)) for v in (turn - quarter, 1 - turn + quarter))
        face, x, y = (quarter, side - 1 - two, side - 1 - one) if z >= 0 else (quarter + 8, one, two)
    spread = lambda v: sum((v >> k & 1) << 2 * k for k in range(order))
    return face * side * side + spread(x) + 2 * spread(y)


def circle_cover(ra: float, dec: float, radius: float, order: int, samples: int = 64) -> list[int]:
    """Pixels at ``order`` that points of a filled circle on the sky fall in."""
    found = set()
    d0, a0 = math.radians(dec), math.radians(ra)
    for ring in range(samples // 4 + 1):
        r = math.radians(radius) * ring / (samples // 4)
        for k in range(samples):
            t = 2 * math.pi * k / samples
            d = math.asin(math.sin(d0) * math.cos(r) + math.cos(d0) * math.sin(r) * math.cos(t))
            a = a0 + math.atan2(math.sin(t) * math.sin(r) * math.cos(d0), math.cos(r) - math.sin(d0) * math.sin(d))
            found.add(_python_pixel(math.degrees(a), math.degrees(d), order))
    return sorted(found)
