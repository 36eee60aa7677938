"""Period search: folding, periodograms, alias excision, peaks and significance."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.operators import periodogram
from heliograph.operators.lightcurve import Curve, dealt
from heliograph.sources.scratch import discard, materialise

# Ratios of an alias period to the cadence.
ALIAS_RATIOS = (1 / 3, 1 / 2, 1, 2, 4 / 3, 3 / 2, 3, 4)


def phase(time: Column, period: Column) -> Column:
    return F.pmod(time, period) / period


def with_trials(df: DataFrame, periods: Sequence[float]) -> DataFrame:
    """A row for each row and trial period. The trials are a short list of the caller's."""
    return df.withColumn("period", F.explode(F.array(*[F.lit(float(p)) for p in periods])))


def aov(df: DataFrame, c: Curve, periods: Sequence[float], bins: int = 12) -> DataFrame:
    """Analysis-of-variance statistic of each source and trial period: variance between phase bins over that within.

    Rows move once, by source, before they are repeated for each trial; the two aggregations by (source, period, bin) and
    (source, period) then stay where they are.
    """
    rows = with_trials(dealt(df.select(c.key, c.time, c.flux), c.key), periods)
    binned = rows.groupBy(c.key, "period", F.floor(phase(F.col(c.time), F.col("period")) * bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(c.flux).alias("m"), F.var_pop(c.flux).alias("v"))
    all_ = binned.groupBy(c.key, "period").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("r"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("ss"), F.sum(F.col("n") * F.col("v")).alias("within"))
    between = F.col("ss") - F.col("s") * F.col("s") / F.col("n")
    theta = F.try_divide((F.col("n") - F.col("r")) * between, (F.col("r") - 1) * F.col("within"))
    return all_.select(c.key, "period", theta.alias("sig"))


def lomb_scargle(df: DataFrame, c: Curve, periods: Sequence[float]) -> DataFrame:
    """Normalised Lomb-Scargle power of each source and trial period, by sums alone."""
    df = dealt(df.select(c.key, c.time, c.flux), c.key)
    own = df.groupBy(c.key).agg(F.avg(c.flux).alias("_m"), F.var_pop(c.flux).alias("_v"))
    rows = with_trials(df.join(own.hint("merge"), c.key), periods)
    w = 2 * F.pi() * F.col(c.time) / F.col("period")
    y = F.col(c.flux) - F.col("_m")
    sums = rows.groupBy(c.key, "period").agg(
        F.sum(y * F.cos(w)).alias("yc"), F.sum(y * F.sin(w)).alias("ys"), F.sum(F.cos(w) * F.cos(w)).alias("cc"), F.sum(F.sin(w) * F.sin(w)).alias("ss"), F.sum(F.cos(w) * F.sin(w)).alias("cs"), F.max("_v").alias("v"),
    )
    # rotate by the angle at which the cosine and sine sums are orthogonal
    t = 0.5 * F.atan2(2 * F.col("cs"), F.col("cc") - F.col("ss"))
    cos, sin = F.cos(t), F.sin(t)
    yc, ys = F.col("yc") * cos + F.col("ys") * sin, F.col("ys") * cos - F.col("yc") * sin
    cc = F.col("cc") * cos * cos + 2 * F.col("cs") * cos * sin + F.col("ss") * sin * sin
    ss = F.col("ss") * cos * cos - 2 * F.col("cs") * cos * sin + F.col("cc") * sin * sin
    power = F.try_divide(F.coalesce(F.try_divide(yc * yc, cc), F.lit(0.0)) + F.coalesce(F.try_divide(ys * ys, ss), F.lit(0.0)), 2 * F.col("v"))
    return sums.select(c.key, "period", power.alias("sig"))


def conditional_entropy(df: DataFrame, c: Curve, periods: Sequence[float], phase_bins: int = 10, mag_bins: int = 5) -> DataFrame:
    """Entropy of the magnitude bin given the phase bin; the best period has the least."""
    df = dealt(df.select(c.key, c.time, c.flux), c.key)
    own = df.groupBy(c.key).agg(F.min(c.flux).alias("_lo"), F.max(c.flux).alias("_hi"), F.count(F.lit(1)).alias("_n"))
    rows = with_trials(df.join(own.hint("merge"), c.key), periods)
    level = F.least(F.floor(F.coalesce(F.try_divide(F.col(c.flux) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0)) * mag_bins), F.lit(mag_bins - 1))
    cells = rows.groupBy(c.key, "period", F.floor(phase(F.col(c.time), F.col("period")) * phase_bins).alias("p"), level.alias("m")).agg(F.count(F.lit(1)).alias("n"), F.max("_n").alias("all"))
    columns = cells.groupBy(c.key, "period", "p").agg(F.sum("n").alias("np"), F.sum(F.col("n") * F.log("n")).alias("nl"), F.max("all").alias("all"))
    return columns.groupBy(c.key, "period").agg((F.sum(F.col("np") * F.log("np") - F.col("nl")) / F.max("all")).alias("sig"))


def plavchan(df: DataFrame, c: Curve, periods: Sequence[float], box: float = 0.1) -> DataFrame:
    """Mean squared error of the mean over that of a circular box mean in phase.

    Rows near the ends of the phase are repeated a turn away, so that one range frame gives the box; a source and period
    is a window of its own.
    """
    rows = with_trials(df.select(c.key, c.time, c.flux, *c.ties), periods).withColumn("_p", phase(F.col(c.time), F.col("period")))
    half = box / 2
    turns = F.array_compact(F.array(F.lit(0.0), F.when(F.col("_p") <= half, F.lit(1.0)), F.when(F.col("_p") >= 1 - half, F.lit(-1.0))))
    spread = rows.withColumn("_turn", F.explode(turns)).withColumn("_at", F.col("_p") + F.col("_turn"))
    near = F.expr(f"avg({c.flux}) OVER (PARTITION BY {c.key}, period ORDER BY _at RANGE BETWEEN {half}D PRECEDING AND {half}D FOLLOWING)")
    smooth = spread.withColumn("_box", near).where(F.col("_turn") == 0)
    return smooth.groupBy(c.key, "period").agg(F.try_divide(F.var_pop(c.flux), F.avg((F.col(c.flux) - F.col("_box")) * (F.col(c.flux) - F.col("_box")))).alias("sig"))


def excise_aliases(grid: DataFrame, cadences: DataFrame, key: str, tolerance: float = 0.085) -> DataFrame:
    """``grid`` (key, period, sig) with 0 where a period lies inside any band around a multiple of a source's cadence.

    ``cadences`` has key, short and long (typical gaps in days). Both sides meet on the key alone.
    """
    near = lambda base: F.exists(F.array(*[F.lit(r) for r in ALIAS_RATIOS]), lambda r: F.abs(F.col("period") - r * base) <= tolerance * r * base)
    hit = F.coalesce(near(F.col("short")), F.lit(False)) | F.coalesce(near(F.col("long")), F.lit(False))
    return grid.join(cadences, key, "left").withColumn("sig", F.when(hit, 0.0).otherwise(F.col("sig"))).drop("short", "long")


def top_peaks(grid: DataFrame, key: str, peaks: int = 3, separation: float = 0.1) -> DataFrame:
    """The best periods of each source; each drops all periods within ``separation`` of itself (as a share of it).

    A source's trials, a short list of the caller's, are gathered once into an array; rounds, as many as peaks, go over it
    in place.
    """
    trial = F.struct(F.col("sig"), (-F.col("period")).alias("p"))
    rows = grid.where(F.col("sig").isNotNull()).groupBy(key).agg(F.collect_list(trial).alias("_left"))
    for k in range(1, peaks + 1):
        rows = rows.withColumn("_best", F.array_max("_left")).withColumns({f"peak{k}": -F.col("_best.p"), f"peak{k}_sig": F.col("_best.sig")})
        rows = rows.withColumn("_left", F.filter("_left", lambda x: F.abs(-x["p"] - F.col(f"peak{k}")) > separation * F.col(f"peak{k}")))
    return rows.select(key, *[n for k in range(1, peaks + 1) for n in (f"peak{k}", f"peak{k}_sig")])


def best_long(grid: DataFrame, key: str, longer_than: float = 30) -> DataFrame:
    return grid.where(F.col("period") > longer_than).groupBy(key).agg(F.max(F.struct(F.col("sig"), (-F.col("period")).alias("p"))).alias("b")).select(key, (-F.col("b.p")).alias("best_long_period"), F.col("b.sig").alias("best_long_period_sig"))


def prefer_double(period: Column, most: float = 4) -> Column:
    return F.when(period <= most, 2 * period).otherwise(period)


def explode_periods(df: DataFrame, key: str, columns: Sequence[str], low: float = 170, high: float = 190) -> DataFrame:
    """A row for each source and different trial period; periods strictly between ``low`` and ``high`` are left out."""
    long = df.select(key, F.explode(F.array(*columns)).alias("period"))
    return long.where(F.col("period").isNotNull() & ~((F.col("period") > low) & (F.col("period") < high))).dropDuplicates([key, "period"])


def moving_average(df: DataFrame, partition: Sequence[str], order: Sequence[str], value: str, share: float = 0.1, out: str = "smooth") -> DataFrame:
    """Mean over a window of ``share`` of a source's rows; rows beyond the ends count as 0, and an even window leans back.

    The window's width differs by source; with places counted in widths, one range frame serves all of them.
    """
    whole, by = Window.partitionBy(*partition), Window.partitionBy(*partition).orderBy(*order)
    run = df.withColumns({"_w": F.floor(F.count(F.lit(1)).over(whole) * share).cast("int"), "_i": F.row_number().over(by)})
    run = run.withColumn("_x", F.try_divide(F.col("_i"), F.col("_w")))
    total = F.expr(f"sum({value}) OVER (PARTITION BY {', '.join(partition)} ORDER BY _x RANGE BETWEEN 0.500000001D PRECEDING AND 0.499999999D FOLLOWING)")
    return run.withColumn("_total", total).withColumn(out, F.when(F.col("_w") > 0, F.col("_total") / F.col("_w"))).drop("_w", "_i", "_x", "_total")


def _variances(t: np.ndarray, y: np.ndarray, p: np.ndarray, bins: int) -> np.ndarray:
    """AOV statistic of centred values for each period."""
    if not len(p):
        return np.zeros(0)
    cell = (np.floor((t[None, :] % p[:, None]) / p[:, None] * bins).astype(int).clip(0, bins - 1) + np.arange(len(p))[:, None] * bins).ravel()
    count = np.bincount(cell, minlength=len(p) * bins).reshape(-1, bins)
    total = np.bincount(cell, np.tile(y, len(p)), len(p) * bins).reshape(-1, bins)
    between = np.divide(total**2, count, out=np.zeros_like(total), where=count > 0).sum(1)
    r, within = (count > 0).sum(1), (y**2).sum() - between
    ok = (r > 1) & (within > 1e-12)
    return np.where(ok, (len(t) - r) * between / np.where(ok, (r - 1) * within, 1), 0)


def _powers(t: np.ndarray, y: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Normalised Lomb-Scargle power of centred values for each period."""
    if not len(p) or y.var() == 0:
        return np.zeros(len(p))
    w = 2 * np.pi * t[None, :] / p[:, None]
    cos, sin = np.cos(w), np.sin(w)
    yc, ys, cc, cs = cos @ y, sin @ y, np.einsum("ij,ij->i", cos, cos), np.einsum("ij,ij->i", cos, sin)
    ss = len(t) - cc
    tau = 0.5 * np.arctan2(2 * cs, cc - ss)
    c, s = np.cos(tau), np.sin(tau)
    parts = ((yc * c + ys * s, cc * c * c + 2 * cs * c * s + ss * s * s), (ys * c - yc * s, ss * c * c - 2 * cs * c * s + cc * s * s))
    return sum(np.divide(a * a, b, out=np.zeros(len(p)), where=b > 1e-9) for a, b in parts) / (2 * y.var())


# Bounds and steps, in days, of the pieces of the full trial grid.
GRID_PIECES = [(0.1, 4, 0.00005), (4, 10, 0.00007), (10, 30, 0.0005), (30, 50, 0.001), (50, 100, 0.005), (100, 500, 0.025), (500, 1000, 0.5)]
#: Rows of a source, and rows times periods, from which it is spread over tasks; values that a numpy pass holds, and periods of
#: a task of a spread source.
HOT_ROWS, HOT_WORK, PASS_VALUES, SPREAD_PERIODS = 200_000, 4_000_000_000, 4_000_000, 20_000
#: Periods of a grid from which sources are searched together; rows of a task then, and sources at a time.
TOGETHER, TOGETHER_ROWS, SOURCES = 10_000, 600_000, 1_000


def trial_grid(thin: int = 1) -> np.ndarray:
    """The full grid of some 250,700 trial periods, or one whose steps are ``thin`` times as wide."""
    return np.concatenate([np.arange(low, high, step * thin) for low, high, step in GRID_PIECES])


def _statistics(t: np.ndarray, centred: np.ndarray, grid: np.ndarray, bins: int, long_from: float) -> np.ndarray:
    """AOV for short trials, scaled Lomb-Scargle for long ones, in blocks of bounded size."""
    out = np.zeros(len(grid))
    block = max(1, PASS_VALUES // max(1, len(t)))
    for lo in range(0, len(grid), block):
        p = grid[lo : lo + block]
        short = p < long_from
        out[lo : lo + block][short] = _variances(t, centred, p[short], bins)
        long = p[~short]
        out[lo : lo + block][~short] = _powers(t, centred, long) * _long_scale(long, long_from)
    return out


def _long_scale(long: np.ndarray, long_from: float) -> np.ndarray:
    return 1.7 + 0.75 * np.log10(long / long_from)


def search(df: DataFrame, c: Curve, periods: np.ndarray, bins: int = 12, long_from: float = 15.0) -> DataFrame:
    """The whole periodogram over a grid, a source at a time in numpy: for looking at a few sources. See :func:`search_peaks`."""
    grid = np.asarray(periods, float)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf[c.flux].to_numpy(float)
        return pd.DataFrame({c.key: pdf[c.key].iloc[0], "period": grid, "sig": _statistics(pdf[c.time].to_numpy(float), y - y.mean(), grid, bins, long_from)})

    kind = dict(df.dtypes)[c.key]
    return df.select(c.key, c.time, c.flux).groupBy(c.key).applyInPandas(one, f"{c.key} {kind}, period double, sig double")


def _best(period: np.ndarray, sig: np.ndarray, peaks: int, separation: float) -> list[int]:
    """Places of the best periods, the shorter of equal ones first; each rules out those within ``separation`` of itself."""
    found, left = [], np.isfinite(sig)
    while len(found) < peaks and left.any():
        top = np.flatnonzero(left & (sig == sig[left].max()))
        found.append(int(top[period[top].argmin()]))
        left &= np.abs(period - period[found[-1]]) > separation * period[found[-1]]
    return found


def _fine(grid: np.ndarray, places: list[int], steps: int) -> np.ndarray:
    """Even steps between the grid's neighbours of each place."""
    ends = [(grid[max(0, i - 1)], grid[min(len(grid) - 1, i + 1)]) for i in places]
    return np.concatenate([np.linspace(lo, hi, steps) for lo, hi in ends]) if ends else np.zeros(0)


def _chosen(grid: np.ndarray, sig: np.ndarray, peaks: int, separation: float, longer_than: float) -> list[int]:
    """Places on the grid that are refined: the best peaks, and the best long period."""
    found, long = _best(grid, sig, peaks, separation), np.flatnonzero((grid > longer_than) & np.isfinite(sig))
    return list(dict.fromkeys([*found, *([int(long[sig[long].argmax()])] if len(long) else [])]))


def _peak_row(period: np.ndarray, sig: np.ndarray, peaks: int, separation: float, longer_than: float) -> list[float | None]:
    """The nine columns of a source from all statistics known of it, refined ones too."""
    order = np.argsort(period, kind="stable")
    period, sig = period[order], sig[order]
    row: list[float | None] = []
    for i in (_best(period, sig, peaks, separation) + [None] * peaks)[:peaks]:
        row += [None, None] if i is None else [float(period[i]), float(sig[i])]
    long = np.flatnonzero(period > longer_than)
    return row + ([float(period[long[sig[long].argmax()]]), float(sig[long].max())] if len(long) else [None, None])


def _usual_gaps(t: np.ndarray, split: float) -> tuple[float, float]:
    """Medians of the gaps between different times below and above ``split`` days; NaN where there are none."""
    gaps = np.diff(np.unique(t))
    return tuple(float(np.median(g)) if len(g) else np.nan for g in (gaps[gaps < split], gaps[gaps > split]))


def _without_aliases(period: np.ndarray, sig: np.ndarray, cadences: tuple[float, float] | None, tolerance: float) -> np.ndarray:
    """0 for periods in any band around a multiple of a cadence."""
    if cadences is None:
        return sig
    bad = np.outer(ALIAS_RATIOS, [x for x in cadences if x is not None and np.isfinite(x)]).ravel()
    hit = (np.abs(period[:, None] - bad) <= tolerance * bad).any(1) if len(bad) else np.zeros(len(period), bool)
    return np.where(hit, 0.0, sig)


def _with_double(period: np.ndarray, sig: np.ndarray, most: float | None, factor: float) -> np.ndarray:
    """If the best period is ``most`` days or less, the statistic of the trial nearest to its double times ``factor``."""
    best = _best(period, sig, 1, 0.0) if most is not None else []
    if not best or period[best[0]] > most:
        return sig
    out, away = sig.copy(), np.abs(period - 2 * period[best[0]])
    out[np.lexsort((period, away))[0]] *= factor
    return out


def _bounds(times_of: list[np.ndarray], values_of: list[np.ndarray], grid: np.ndarray, bins: int, long_from: float) -> np.ndarray | None:
    """Upper bounds (sources, blocks of the grid) of sources that share times; None where each alone costs less."""
    sizes = np.array([len(t) for t in times_of])
    t, y, owns = np.concatenate(times_of), np.concatenate(values_of), np.arange(len(sizes))
    if not (np.isfinite(t).all() and np.isfinite(y).all()) or sizes.max() >= periodogram.MOST_ROWS:
        return None
    times, at = np.unique(t, return_inverse=True)
    edge = int(np.searchsorted(grid, long_from))
    if not periodogram.shared_is_faster(times, grid[:edge], len(t), len(owns), bins):
        return None
    who = np.repeat(owns, sizes)
    centred = y - (np.bincount(who, y) / np.bincount(who))[who]
    squares = np.bincount(who, centred**2)
    place, size = at * len(owns) + who, len(times) * len(owns)
    count, total = (np.bincount(place, w, size).reshape(len(times), -1) for w in (None, centred))
    out = np.full((-(-len(grid) // periodogram.BLOCK), len(owns)), -np.inf)
    periodogram.block_bounds(periodogram.short_bounds(times, count, total, squares, grid[:edge], bins), 0, out)
    periodogram.block_bounds(periodogram.long_bounds(times, count.astype(float), total, squares, grid[edge:], _long_scale(grid[edge:], long_from)), edge, out)
    return np.ascontiguousarray(out.T)


def _settled(t: np.ndarray, y: np.ndarray, grid: np.ndarray, bounds: np.ndarray, peaks: int, separation: float, steps: int, longer_than: float, bins: int, long_from: float) -> list[float | None]:
    """The nine columns of a source, from the blocks of the grid whose bounds call for the statistic itself."""
    y = y - y.mean()
    at = periodogram.Settled(grid, bounds, lambda p: _statistics(t, y, p, bins, long_from))
    at.settle(_best, peaks, separation, longer_than)
    fine = _fine(grid, at.known[_chosen(grid[at.known], at.sig[at.known], peaks, separation, longer_than)].tolist(), steps)
    again = at.statistic(fine)
    at.settle(_best, peaks, separation, longer_than, (fine, again))
    return _peak_row(np.concatenate((grid[at.known], fine)), np.concatenate((at.sig[at.known], again)), peaks, separation, longer_than)


def search_peaks(
    df: DataFrame, c: Curve, periods: np.ndarray, peaks: int = 3, separation: float = 0.1, steps: int = 20, longer_than: float = 50.0, bins: int = 12, long_from: float = 15.0,
    aliases: float | None = None, split: float = 50.0, double_up_to: float | None = None, double_factor: float = 2.0,
) -> DataFrame:
    """Per source: the best ``peaks`` periods with their statistics, and the best one above ``longer_than`` days.

    Two stages: the grid's peaks and its best long period are searched again in ``steps`` between their neighbours on the
    grid, and all are ranked together. Only the result leaves a task, never the periodogram. A source of more than
    ``HOT_ROWS`` rows, or ``HOT_WORK`` rows times periods, is spread over tasks, whose sums for each period add up. On a
    grid of ``TOGETHER`` periods or more, sources that share times are searched together (:mod:`periodogram`), with the same
    peaks.

    With ``aliases``, periods within that share of a multiple of the source's own cadences (median gaps below and above
    ``split`` days) count 0 in both stages. With ``double_up_to``, the double of a best period of so many days or less
    counts ``double_factor`` times on the grid, before peaks are chosen.
    """
    grid = np.asarray(periods, float)
    kind = dict(df.dtypes)[c.key]
    names = [n for k in range(1, peaks + 1) for n in (f"peak{k}", f"peak{k}_sig")] + ["best_long_period", "best_long_period_sig"]
    schema = f"{c.key} {kind}, " + ", ".join(f"{n} double" for n in names)
    rows = df.select(c.key, F.col(c.time).cast("double").alias("_t"), F.col(c.flux).cast("double").alias("_y")).where(F.col("_t").isNotNull() & F.col("_y").isNotNull())
    sizes = rows.groupBy(c.key).agg(F.count(F.lit(1)).alias("_n"), F.avg("_y").alias("_m"), F.sum("_y").alias("_s"))
    most = min(HOT_ROWS, HOT_WORK // max(1, len(grid)))
    hot = sizes.where(F.col("_n") > most)

    def weighed(period: np.ndarray, sig: np.ndarray, cadences: tuple[float, float] | None) -> np.ndarray:
        return _with_double(period, _without_aliases(period, sig, cadences, aliases), double_up_to, double_factor)

    def alone(t: np.ndarray, y: np.ndarray) -> list[float | None]:
        y = y - y.mean()
        cadences = _usual_gaps(t, split) if aliases is not None else None
        sig = weighed(grid, _statistics(t, y, grid, bins, long_from), cadences)
        fine = _fine(grid, _chosen(grid, sig, peaks, separation, longer_than), steps)
        again = _without_aliases(fine, _statistics(t, y, fine, bins, long_from), cadences, aliases)
        return _peak_row(np.concatenate((grid, fine)), np.concatenate((sig, again)), peaks, separation, longer_than)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[pdf[c.key].iloc[0], *alone(pdf["_t"].to_numpy(), pdf["_y"].to_numpy())]], columns=[c.key, *names])

    cold = rows.join(hot.select(c.key), c.key, "left_anti")
    total, largest = sizes.agg(F.sum("_n"), F.max("_n")).first()
    together = len(grid) >= TOGETHER and (np.diff(grid) > 0).all() and grid[0] > 0 and aliases is None and double_up_to is None

    def many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        table = pa.Table.from_batches(held)
        named = table.column(0).combine_chunks().dictionary_encode("encode")
        source, t, y = named.indices.to_numpy(), table.column("_t").to_numpy(), table.column("_y").to_numpy()
        order = np.argsort(source, kind="stable")
        owns = np.split(order, np.cumsum(np.bincount(source))[:-1])
        for lo in range(0, len(owns), SOURCES):
            some = owns[lo : lo + SOURCES]
            bounds = _bounds([t[own] for own in some], [y[own] for own in some], grid, bins, long_from)
            found = [alone(t[own], y[own]) if bounds is None else _settled(t[own], y[own], grid, bounds[k], peaks, separation, steps, longer_than, bins, long_from) for k, own in enumerate(some)]
            keys = named.dictionary.take(pa.array(np.arange(lo, lo + len(some))))
            yield pa.RecordBatch.from_arrays([keys, *(pa.array(column, pa.float64()) for column in zip(*found))], [c.key, *names])

    if together:
        parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-(total or 0) // TOGETHER_ROWS))
        plain = cold.repartition(parts, c.key).mapInArrow(many, schema)
    else:
        plain = cold.groupBy(c.key).applyInPandas(one, schema)
    if (largest or 0) <= most:
        return plain

    def known(pdf: pd.DataFrame) -> tuple[float, float] | None:
        return (pdf["_short"].iloc[0], pdf["_long"].iloc[0]) if aliases is not None else None

    def places(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("period")
        period = pdf["period"].to_numpy()
        sig = weighed(period, pdf["sig"].to_numpy(), known(pdf))
        fine = _fine(period, _chosen(period, sig, peaks, separation, longer_than), steps)
        return pd.DataFrame({c.key: pdf[c.key].iloc[0], "period": np.concatenate((period, fine)), "sig": np.concatenate((sig, np.full(len(fine), np.nan)))})

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        period = pdf["period"].to_numpy()
        sig = _without_aliases(period, pdf["sig"].to_numpy(), known(pdf), aliases)
        return pd.DataFrame([[pdf[c.key].iloc[0], *_peak_row(period, sig, peaks, separation, longer_than)]], columns=[c.key, *names])

    spread = rows.join(hot.select(c.key, "_n", "_m"), c.key).withColumn("_y", F.col("_y") - F.col("_m"))
    cadences = _hot_cadences(spread, c.key, split) if aliases is not None else None
    beside = lambda table: table if cadences is None else table.join(cadences, c.key, "left")
    long_form = f"{c.key} {kind}, period double, sig double"
    blocks = -(-len(grid) // SPREAD_PERIODS)
    first = materialise(_spread_statistics(spread.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))), c, kind, grid, bins, long_from), "periodogram")
    both = materialise(beside(first).groupBy(c.key).applyInPandas(places, long_form), "periods")
    discard(first)
    fine = both.where(F.col("sig").isNull()).groupBy(c.key).agg(F.sort_array(F.collect_set("period")).alias("_periods"))  # some dozens a source
    again = _spread_statistics(spread.join(fine, c.key).withColumn("_block", F.lit(0)), c, kind, None, bins, long_from)
    return plain.unionByName(beside(both.where(F.col("sig").isNotNull()).unionByName(again)).groupBy(c.key).applyInPandas(last, schema))


def _hot_cadences(rows: DataFrame, key: str, split: float) -> DataFrame:
    """(key, _short, _long) of large sources: their different times are sorted once, by a window that keeps one row at a time."""
    times = rows.select(key, "_t").distinct()
    gap = F.col("_t") - F.lag("_t").over(Window.partitionBy(key).orderBy("_t"))
    gaps = times.withColumn("_gap", gap).where("_gap is not null")
    return gaps.groupBy(key).agg(F.median(F.when(F.col("_gap") < split, F.col("_gap"))).alias("_short"), F.median(F.when(F.col("_gap") > split, F.col("_gap"))).alias("_long"))


def _spread_statistics(rows: DataFrame, c: Curve, kind: str, grid: np.ndarray | None, bins: int, long_from: float) -> DataFrame:
    """(key, period, sig) of sources whose rows lie in many tasks: sums of each task, then their sums for each block of periods."""
    part = ["_n", "_block"]

    def wanted(pdf: pd.DataFrame) -> np.ndarray:
        k = int(pdf["_block"].iloc[0])
        return grid[k * SPREAD_PERIODS : (k + 1) * SPREAD_PERIODS] if grid is not None else np.asarray(pdf["_periods"].iloc[0], float)

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        p, out = wanted(pdf), np.zeros((0, 0))
        t, y = pdf["_t"].to_numpy(), pdf["_y"].to_numpy()
        out = np.zeros((len(p), 2 * bins + 1))
        out[:, -1] = (y**2).sum()
        for lo in range(0, len(t), 20_000):
            for k in range(0, len(p), 200):
                out[k : k + 200, :-1] += _sums(t[lo : lo + 20_000], y[lo : lo + 20_000], p[k : k + 200], bins, long_from)
        return pd.DataFrame({c.key: pdf[c.key].iloc[0], "_n": pdf["_n"].iloc[0], "_block": pdf["_block"].iloc[0], "period": p, "_sums": list(out)})

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.groupby("period", sort=True)["_sums"].agg(lambda x: np.sum(np.stack(list(x)), axis=0))
        return pd.DataFrame({c.key: pdf[c.key].iloc[0], "period": own.index.to_numpy(), "sig": _from_sums(np.stack(own.to_list()), own.index.to_numpy(), int(pdf["_n"].iloc[0]), bins, long_from)})

    salts = F.least(F.lit(256), F.ceil(F.col("_n") / HOT_ROWS)).cast("int")
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64("_t", "_y"), salts))
    found = dealt.groupBy(c.key, "_salt", *part).applyInPandas(sums, f"{c.key} {kind}, _n long, _block int, period double, _sums array<double>")
    return found.groupBy(c.key, *part).applyInPandas(together, f"{c.key} {kind}, period double, sig double")


def _sums(t: np.ndarray, y: np.ndarray, p: np.ndarray, bins: int, long_from: float) -> np.ndarray:
    """Per period: numbers and sums of the phase bins of short ones; sums of products with cosine and sine of long ones."""
    out = np.zeros((len(p), 2 * bins))
    short = np.flatnonzero(p < long_from)
    if len(short):
        q = p[short]
        cell = (np.floor((t[None, :] % q[:, None]) / q[:, None] * bins).astype(int).clip(0, bins - 1) + np.arange(len(q))[:, None] * bins).ravel()
        out[short, :bins] = np.bincount(cell, minlength=len(q) * bins).reshape(-1, bins)
        out[short, bins:] = np.bincount(cell, np.tile(y, len(q)), len(q) * bins).reshape(-1, bins)
    long = np.flatnonzero(p >= long_from)
    if len(long):
        w = 2 * np.pi * t[None, :] / p[long][:, None]
        cos, sin = np.cos(w), np.sin(w)
        out[long, :4] = np.stack([cos @ y, sin @ y, (cos * cos).sum(1), (cos * sin).sum(1)], 1)
    return out


def _from_sums(sums: np.ndarray, p: np.ndarray, n: int, bins: int, long_from: float) -> np.ndarray:
    """The statistics of :func:`_variances` and :func:`_powers` from added-up sums."""
    squares, out, short = sums[:, -1], np.zeros(len(p)), p < long_from
    count, total = sums[short, :bins], sums[short, bins : 2 * bins]
    between = np.divide(total**2, count, out=np.zeros_like(total), where=count > 0).sum(1)
    r, within = (count > 0).sum(1), squares[short] - between
    ok = (r > 1) & (within > 1e-12)
    out[short] = np.where(ok, (n - r) * between / np.where(ok, (r - 1) * within, 1), 0)
    yc, ys, cc, cs = sums[~short, :4].T
    ss = n - cc
    tau = 0.5 * np.arctan2(2 * cs, cc - ss)
    c, s = np.cos(tau), np.sin(tau)
    parts = ((yc * c + ys * s, cc * c * c + 2 * cs * c * s + ss * s * s), (ys * c - yc * s, ss * c * c - 2 * cs * c * s + cc * s * s))
    variance = np.maximum(squares[~short] / max(n, 1), 1e-300)
    power = sum(np.divide(a * a, b, out=np.zeros(len(a)), where=b > 1e-9) for a, b in parts) / (2 * variance)
    out[~short] = np.where(squares[~short] > 0, power, 0) * _long_scale(p[~short], long_from)
    return out


def refined(peaks: DataFrame, key: str, column: str, width: float = 0.05, steps: int = 20) -> DataFrame:
    """A fine grid of ``steps`` + 1 periods around each source's peak."""
    return peaks.select(key, F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("k"), F.col(column).alias("_p")).select(key, (F.col("_p") * (1 - width) + F.col("k") * (2 * width * F.col("_p") / steps)).alias("period"))


def significance(df: DataFrame, c: Curve, period: str, share: float = 0.1) -> DataFrame:
    """Per source: mean squared error about a moving average in time order, over that about one in phase order.

    ``period`` is a column that is constant within a source. Rows are dealt by source first, so that a task sorts no more
    than its part, whatever the table's size.
    """
    folded = dealt(df.select(*dict.fromkeys([c.key, c.time, c.flux, *c.ties, period])), c.key).withColumn("_phase", phase(F.col(c.time), F.col(period)))
    rows = moving_average(folded, [c.key], [c.time, *c.ties], c.flux, share, "_null")
    rows = moving_average(rows, [c.key], ["_phase", *c.ties], c.flux, share, "_fold")
    error = lambda name: F.avg((F.col(c.flux) - F.col(name)) * (F.col(c.flux) - F.col(name)))
    return rows.groupBy(c.key).agg(F.try_divide(error("_null"), error("_fold")).alias("period_significance"))


def phase_bins(df: DataFrame, c: Curve, period: str, bins: int = 64, least: int = 2) -> DataFrame:
    """Per source and phase bin: rows, median and variance as a share of the source's; 0 and 0 below ``least`` rows."""
    rows = df.withColumns({"bin": F.floor(phase(F.col(c.time), F.col(period)) * bins).cast("int"), "_all": F.var_pop(c.flux).over(c.whole())})
    out = rows.groupBy(c.key, "bin").agg(F.count(F.lit(1)).alias("n"), F.median(c.flux).alias("_m"), F.try_divide(F.var_pop(c.flux), F.max("_all")).alias("_v"))
    enough = F.col("n") >= least
    return out.select(c.key, "bin", "n", F.when(enough, F.col("_m")).otherwise(0.0).alias("median_flux"), F.when(enough, F.col("_v")).otherwise(0.0).alias("var_ratio"))


def phase_shape(df: DataFrame, c: Curve, period: str, bins: int = 64, overlap: float = 0.0, least: int = 2, level: str = "median", scaled_bins: bool = True) -> DataFrame:
    """Per source and every phase bin: median (or mean, by ``level``) and share of variance, each scaled to 0 to 1 over the source's bins.

    A bin reaches into its neighbours by the share ``overlap`` (below 1) of its width; phases don't wrap. Bins of fewer
    than ``least`` rows count as 0 and 0 before scaling; a source whose bins are all alike has nulls. Without
    ``scaled_bins`` the values stay as they are. What is gathered for a source is ``bins`` small rows, whatever its number
    of observations.
    """
    place = phase(F.col(c.time), F.col(period)) * bins
    reach = F.sequence(F.greatest(F.floor(place - overlap), F.lit(0)), F.least(F.floor(place + overlap), F.lit(bins - 1)))
    rows = df.where(F.col(c.time).isNotNull() & F.col(period).isNotNull()).select(c.key, c.flux, F.var_pop(c.flux).over(c.whole()).alias("_all"), F.explode(reach).alias("_bin"))
    middle = {"median": F.median, "mean": F.avg}[level]
    filled = rows.groupBy(c.key, "_bin").agg(middle(c.flux).alias("level"), F.coalesce(F.try_divide(F.var_pop(c.flux), F.max("_all")), F.lit(0.0)).alias("spread"), F.count(c.flux).alias("_n"))
    entry = F.when(F.col("_n") >= least, F.struct(F.col("_bin").cast("int").alias("key"), F.struct("level", "spread").alias("value")))
    known = filled.groupBy(c.key).agg(F.map_from_entries(F.collect_list(entry)).alias("_known"))
    zero = F.struct(F.lit(0.0).alias("level"), F.lit(0.0).alias("spread"))
    whole = known.select(c.key, F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.try_element_at(F.col("_known"), i), zero)).alias("_bins"))

    def scaled(name: str) -> Column:
        values = F.col("_bins")[name]
        if not scaled_bins:
            return values.alias(name)
        low, high = F.array_min(values), F.array_max(values)
        return F.transform(values, lambda v: F.try_divide(v - low, high - low)).alias(name)

    return whole.select(c.key, scaled("level"), scaled("spread"))
