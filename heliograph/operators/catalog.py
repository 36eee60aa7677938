"""Catalog assembly: harmonised sources, flags, decoded classes, purity, packing and printing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.functions import ids

# Names of the final classes by tree index.
TREE_CLASSES = ["ew", "ea", "cep", "rr", "lpv", "rot", "yso"]


def harmonise(parts: Sequence[tuple[DataFrame, str, Mapping[str, Column]]], columns: Sequence[str]) -> DataFrame:
    """Union of catalogs brought to common columns: each part gives a Column for each, or null, and its catalog's name."""
    out = None
    for df, name, mapping in parts:
        one = df.select(F.lit(name).alias("catalog"), *[mapping.get(c, F.lit(None)).alias(c) for c in columns])
        out = one if out is None else out.unionByName(one)
    return out


@dataclass(frozen=True)
class Rule:
    """How a published catalog becomes (source_id, catalog, ra, dec, period, type): its columns' names, or a fixed type, or a map of types."""

    name: str
    id: str
    type: str | None = "type"
    fixed: str | None = None
    period: str | None = "period"
    ra: str = "ra"
    dec: str = "dec"
    types: Mapping[int, str | None] | None = None
    least_score: tuple[str, float] | None = None


# The thirteen label catalogs, the columns that each has, and what is kept of it.
RULES = [
    Rule("chen-neowise", "WISE"),
    Rule("chen-ztf", "ZTF"),
    Rule("petrosky", "AllWISE", types={0: None, 1: "EB"}),
    Rule("gaia-cepheids", "GaiaDR3"),
    Rule("gaia-ebs", "GaiaDR3", None, "EB"),
    Rule("gaia-lpvs", "GaiaDR3"),
    Rule("gaia-oscillators", "GaiaDR3", None, "oscillator"),
    Rule("gaia-rotators", "GaiaDR3", None, "rotator"),
    Rule("gaia-rrlyrae", "GaiaDR3"),
    Rule("gaia-sts", "GaiaDR3", None, "short-timescale"),
    Rule("spicy", "SPICY", "class", period=None),
    Rule("assef-agn", "WISE_Designation", None, "agn", None, "RA", "Dec"),
    Rule("gaia-general", "source_id", "best_class_name", period=None, least_score=("best_class_score", 0.5)),
]


def harmonise_catalogs(tables: Mapping[str, DataFrame], rules: Sequence[Rule] = RULES) -> DataFrame:
    """Published catalogs by name, brought to common columns by their rules; catalogs that aren't given are left out.

    Identifiers become text. Where a rule maps types, rows of a type without a name go; where it has a least score, rows
    must be above it. One narrow plan over all tables.
    """
    parts = []
    for rule in rules:
        if (df := tables.get(rule.name)) is None:
            continue
        if rule.least_score:
            df = df.where(F.col(rule.least_score[0]) > rule.least_score[1])
        kind = F.lit(rule.fixed) if rule.type is None else F.col(rule.type)
        if rule.types is not None:
            kind = F.coalesce(*[F.when(kind == k, v) for k, v in rule.types.items()])
            df = df.where(kind.isNotNull())
        period = F.col(rule.period).cast("double") if rule.period else F.lit(None).cast("double")
        columns = {"source_id": F.col(rule.id).cast("string"), "ra": F.col(rule.ra).cast("double"), "dec": F.col(rule.dec).cast("double"), "period": period, "type": kind.cast("string")}
        parts.append((df, rule.name, columns))
    return harmonise(parts, ["source_id", "ra", "dec", "period", "type"])


def mapped(value: Column, table: Mapping[str, str], fallback: Column | None = None) -> Column:
    """Many-to-one value mapping; a missing key gives ``fallback`` or null."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), value)
    return F.coalesce(found, fallback) if fallback is not None else found


def colours(df: DataFrame, base: str, others: Sequence[str]) -> DataFrame:
    """The other magnitudes less ``base``, and ``base`` less itself."""
    return df.withColumns({c: F.col(c) - F.col(base) for c in others} | {base: F.col(base) - F.col(base)})


def blend_flag(kind: Column, columns: Sequence[Column]) -> Column:
    """0 if any of the columns is there; where all are missing, 0 for transients (kind 1) and else 1."""
    missing = columns[0].isNull()
    for c in columns[1:]:
        missing = missing & c.isNull()
    return F.when(missing, F.when(kind == 1, 0).otherwise(1)).otherwise(0)


def decoded(kind: Column, extragalactic: Column, tree: Column, tree_classes: Sequence[str] = TREE_CLASSES) -> Column:
    """Class name from kind (1 transient, 2 periodic), membership of an extragalactic catalog, and tree index."""
    names = F.array(*[F.lit(c) for c in tree_classes])
    return (
        F.when((kind == 1) & extragalactic, "sn").when(kind == 1, "cv").when((kind == 2) & extragalactic, "agn")
        .when(kind == 2, F.coalesce(F.get(names, tree.cast("int")), F.lit("Unknown"))).otherwise("Unknown")
    )


def pure(blended: Column, snr: Column, kind: Column, confidence: Column, significance: Column, mag: Column) -> Column:
    """Whether a row stays in the purified catalog; a comparison with null doesn't drop it."""
    loose = kind.isin("sn", "cv")
    drops = [
        blended == 1, F.when(loose, snr < 4.25).otherwise(snr < 4.75), (confidence < 0.8) & (snr < 8),
        (kind == "rot") & (F.coalesce(confidence < 0.95, F.lit(False)) | F.coalesce(significance < 1.1, F.lit(False))), mag > 15.5,
    ]
    keep = F.lit(True)
    for d in drops:
        keep = keep & ~F.coalesce(d, F.lit(False))
    return keep


def sensible(kind: Column, period: Column, mags: tuple[Column, Column, Column] | None = None) -> Column:
    """Whether a label's period is plausible for its class; a young star's colours, from three bands, mustn't be too blue."""
    out = ((kind == "ew") & (period < 1.5)) | ((kind == "ea") & (period > 0.5)) | ((kind == "cep") & (period > 1) & (period < 75)) | ((kind == "rr") & (period < 2)) | ((kind == "lpv") & (period > 50)) | ((kind == "rot") & (period < 10))
    if mags is None:
        return out
    red = F.coalesce(mags[0] - mags[1] > -1, F.lit(False)) | F.coalesce(mags[0] - mags[2] > 0, F.lit(False))
    return F.coalesce(out, F.lit(False)) | ((kind == "yso") & red)


#: Ranges of the order that a key's rows are cut into before they are packed.
PACKED_RANGES = 256


def packed(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: Column, limit: int) -> DataFrame:
    """Add ``file``: consecutive rows of a key fill files of about ``limit`` size, by a running sum.

    Rows fall into ranges of the first order column, a number. Sizes are summed by key and range, the few sums of a key
    are added up along its ranges, and running sums start from those: a window holds one range of a key, not all of it.
    """
    first = order[0]
    cuts = df.select(F.percentile_approx(F.col(first).cast("double"), [k / PACKED_RANGES for k in range(1, PACKED_RANGES)], 4 * PACKED_RANGES).alias("q")).first()["q"]
    bounds = F.array(*[F.lit(v) for v in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")
    rows = df.withColumns({"_size": size, "_range": F.coalesce(F.size(F.filter(bounds, lambda v: v <= F.col(first).cast("double"))), F.lit(-1))})
    rows = rows.withColumn("_range", F.when(F.col(first).isNull(), -1).otherwise(F.col("_range")))
    sums = rows.groupBy(*keys, "_range").agg(F.sum("_size").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    named = [F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]
    bases = sums.select(*named, F.col("_range").alias("_of"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    same = F.col("_range") == F.col("_of")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    run = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.join(bases, same).withColumn("file", F.floor((F.col("_base") + F.sum("_size").over(run) - F.col("_size")) / limit).cast("long"))
    return out.drop("_size", "_range", "_of", "_base", *[f"_key{i}" for i in range(len(keys))])


def every_kth(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int, first: int = 0) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).where(F.col("_k") % k == first).drop("_k")


def pretty_lines(df: DataFrame, columns: Sequence[str], key: str, separator: str = " | ") -> DataFrame:
    """(key, line): columns padded to their widest value, by one aggregation and one projection."""
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns}
    widths = df.agg(*[F.greatest(F.max(F.char_length(v)), F.lit(len(c))).alias(f"_{c}") for c, v in text.items()])
    # one row of widths, whatever the table
    return df.join(F.broadcast(widths)).select(key, F.concat_ws(separator, *[F.rpad(v, F.col(f"_{c}"), F.lit(" ")) for c, v in text.items()]).alias("line"))


# The magnitude of the first band from which a source isn't saturated, and digits of the final catalog.
SATURATED, DIGITS = 7.5, {"ra": 5, "dec": 4, "mag": 2, "amp": 2, "snr": 3, "period": 7, "significance": 3, "score": 4}


def final_catalog(df: DataFrame, names: Mapping[str, Column]) -> DataFrame:
    """The final catalog's columns from a joined table, without saturated sources; a missing magnitude doesn't drop one.

    ``names`` gives ra, dec, the seven magnitudes mag1 to mag4, j, h, k, both amplitudes amp1, amp2, snr, three peaks peak1 to
    peak3, significance, blended, score and type. Rounding is half to even. Transients have no significance.
    """
    r = lambda name, kind: F.bround(names[name], DIGITS[kind]).alias
    transient = names["type"].isin("sn", "cv")
    out = df.select(
        *[names["id"].alias("cluster_id")], ids.designation(names["ra"], names["dec"]).alias("Designation"), r("ra", "ra")("RAJ2000"), r("dec", "dec")("DecJ2000"),
        *[r(n, "mag")(out) for n, out in (("mag1", "W1mag"), ("mag2", "W2mag"), ("mag3", "W3mag"), ("mag4", "W4mag"), ("j", "Jmag"), ("h", "Hmag"), ("k", "Kmag"))],
        r("amp1", "amp")("W1_amp"), r("amp2", "amp")("W2_amp"), r("snr", "snr")("variability_snr"), *[r(f"peak{k}", "period")(f"period_peak_{k}") for k in (1, 2, 3)],
        F.when(~transient, F.bround(names["significance"], DIGITS["significance"])).alias("period_significance"), names["blended"].alias("blended"), r("score", "score")("confidence"), names["type"].alias("type"),
    )
    return out.where(~F.coalesce(F.col("W1mag") < SATURATED, F.lit(False)))
