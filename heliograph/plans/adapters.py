"""Views of the given tables as light curves, events and positions, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.functions import geo
from heliograph.operators.lightcurve import Curve
from heliograph.sources.tables import table

LC = Curve(ties=("t1", "t2", "t3", "flux"))
EV = Curve(key="user_id", time="t", flux="value", ties=("event_id",))


def light_curves(spark: SparkSession, folder: str, key: str = "l_suppkey") -> DataFrame:
    """``lineitem`` as light curves: a supplier or part is a source, a price a flux, a shipping day a time."""
    c = F.col
    return table(spark, folder, "lineitem").select(
        c(key).alias("source_id"), F.datediff(c("l_shipdate"), F.lit("1995-01-01").cast("date")).cast("double").alias("mjd"), c("l_extendedprice").alias("flux"),
        (300 + c("l_quantity") * c("l_tax") * 8000).alias("sig"), (c("l_linenumber") * F.lit(1.6)).alias("chi"), (c("l_linenumber") - 1).alias("qual"), c("l_orderkey").alias("t1"), c("l_linenumber").alias("t2"), c("l_partkey").alias("t3"),
    )


def lc_sql(key: str = "l_suppkey") -> str:
    return (
        f"lc AS (SELECT {key} AS source_id, CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) AS mjd, l_extendedprice AS flux, "
        "300 + l_quantity * l_tax * 8000 AS sig, l_linenumber * CAST(1.6 AS DOUBLE) AS chi, l_linenumber - 1 AS qual, l_orderkey AS t1, l_linenumber AS t2, l_partkey AS t3 FROM lineitem)"
    )


MASK_SQL = "flux > 0 AND sig > 0 AND qual > 0 AND flux / sig > 4 AND chi < 10"


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 86400e6)


EV_SQL = "ev AS (SELECT *, epoch_us(ts) / 86400e6 AS t FROM events)"


def positions(spark: SparkSession, folder: str, name: str, key: str, shift_arcsec: float = 0) -> DataFrame:
    """(key, ra, dec): keys of a table spread over the sky; ``shift_arcsec`` moves them north for a second catalog."""
    ra, dec = geo.spread_position(F.col(key).cast("double"))
    return table(spark, folder, name).select(key, ra.alias("ra"), (dec + shift_arcsec / 3600).alias("dec"))


def sky_sql(name: str, key: str, shift_arcsec: float = 0, extra: str = "") -> str:
    turn = f"(CAST({key} AS DOUBLE) * 0.6180339887::DOUBLE)"
    return (
        f"SELECT {key}{extra}, (CAST({key} AS DOUBLE) * 137.50776405::DOUBLE) - 360 * floor((CAST({key} AS DOUBLE) * 137.50776405::DOUBLE) / 360) AS ra, "
        f"degrees(asin(2 * ({turn} - floor({turn})) - 1)) + {shift_arcsec}::DOUBLE / 3600 AS dec FROM {name}"
    )


HAVERSINE_SQL = (
    "degrees(2 * asin(least(1.0, sqrt(sin(radians({d2} - {d1}) / 2) * sin(radians({d2} - {d1}) / 2) + cos(radians({d1})) * cos(radians({d2})) * sin(radians({a2} - {a1}) / 2) * sin(radians({a2} - {a1}) / 2))))) * 3600"
)


def haversine_sql(a: str, b: str) -> str:
    return HAVERSINE_SQL.format(a1=f"{a}.ra", d1=f"{a}.dec", a2=f"{b}.ra", d2=f"{b}.dec")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal."""
    return df.withColumns({c: F.round(c, digits) for c, kind in df.dtypes if kind == "double"})
