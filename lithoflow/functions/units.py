"""Units: a closed table of spellings, and conversion as columns that yield a value or an issue code.

Fixed values: spellings, dimensions and factors to the base unit of each dimension. ``mPa`` and ``MPa`` share a spelling
(megapascal); a month has 30 days, a quarter 91.25, a year 365.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import unit_key

UNITS = {
    "pressure": {"bar": 1.0, "psi": 0.0689475729316836, "kpa": 0.01, "mpa": 10.0, "pa": 1e-5},
    "surface_rate": {"m3/day": 1.0, "m^3/day": 1.0, "m3/d": 1.0, "bbl/day": 0.158987294928, "bbl/d": 0.158987294928},
    "dynamic_viscosity": {"cp": 1.0, "mpa.s": 1.0, "mpa_s": 1.0, "pa.s": 1000.0, "pa*s": 1000.0},
    "density": {"kg/m3": 1.0, "kg/m^3": 1.0, "g/cm3": 1000.0, "g/cm^3": 1000.0},
    "time": {"day": 1.0, "days": 1.0, "d": 1.0, "month": 30.0, "months": 30.0, "quarter": 91.25, "quarters": 91.25, "year": 365.0, "years": 365.0},
    "inverse_pressure": {"1/bar": 1.0, "/bar": 1.0, "bar^-1": 1.0, "1/psi": 14.503773773020923, "psi^-1": 14.503773773020923},
    "dimensionless": {"fraction": 1.0, "rm3/sm3": 1.0, "%": 0.01, "percent": 0.01},
}


def unit_rows(spark: SparkSession) -> DataFrame:
    """(key, dimension, factor): the closed vocabulary, under 40 rows."""
    return spark.createDataFrame([(k, d, f) for d, units in UNITS.items() for k, f in units.items()], "key string, dimension string, factor double")


def finite(value: Column) -> Column:
    """A number, neither NaN nor infinite."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def convert(rows: DataFrame, value: str, source: str, target: str, exact: bool = False) -> DataFrame:
    """rows with unit_value and unit_code: the value in the target unit, or the first issue that prevents it.

    The vocabulary is a fixed table of under 40 rows and is broadcast.
    """
    known = F.broadcast(unit_rows(rows.sparkSession))
    side = lambda p: known.select(*[F.col(c).alias(f"_{p}_{c}") for c in known.columns])
    keyed = rows.withColumn("_sk", unit_key(F.col(source), exact)).withColumn("_tk", unit_key(F.col(target), exact))
    joined = keyed.join(side("s"), F.col("_sk") == F.col("_s_key"), "left").join(side("t"), F.col("_tk") == F.col("_t_key"), "left")
    code = (
        F.when(~finite(F.col(value)), "INVALID_MAGNITUDE")
        .when(F.col("_s_key").isNull() | F.col("_t_key").isNull(), "UNSUPPORTED_UNIT")
        .when(F.col("_s_dimension") != F.col("_t_dimension"), "INCOMPATIBLE_UNITS")
    )
    result = F.col(value) * F.col("_s_factor") / F.col("_t_factor") + F.lit(0.0)  # no negative zero
    return joined.withColumn("unit_code", code).withColumn("unit_value", F.when(F.col("unit_code").isNull(), result)).select(*rows.columns, "unit_value", "unit_code")
