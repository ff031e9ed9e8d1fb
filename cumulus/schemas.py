"""Typed schemas of the place dimension, the series frames and the observation log.

Column order follows the reference's record layouts. Two deliberate type changes:
measures, population and row ids are ``bigint`` (running totals and row counts
pass 2**31 at the data sizes this library is built for), and latitude/longitude
stay 32-bit floats because joins compare them for equality.
"""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    DateType,
    FloatType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

MEASURES = ("confirmed", "deaths", "recovered")

# Place key of the global series: region is null on country-level rows.
GLOBAL_KEYS = ("region", "country")
GLOBAL_IDS = ("region", "country", "latitude", "longitude")

# Identifying columns of the US-style series files, in file order.
US_IDS = (
    "uid", "iso2", "iso3", "code3", "FIPS", "Admin2",
    "region", "country", "latitude", "longitude", "combined_key",
)

COUNTS = ArrayType(LongType(), containsNull=True)


def _f(name, dtype):
    return StructField(name, dtype, True)


PLACE = StructType([
    _f("uid", LongType()), _f("iso2", StringType()), _f("iso3", StringType()),
    _f("code3", IntegerType()), _f("FIPS", LongType()), _f("Admin2", StringType()),
    _f("region", StringType()), _f("country", StringType()),
    _f("latitude", FloatType()), _f("longitude", FloatType()),
    _f("combined_key", StringType()), _f("population", LongType()),
])

GLOBAL_HORIZONTAL = StructType([
    _f("region", StringType()), _f("country", StringType()),
    _f("latitude", FloatType()), _f("longitude", FloatType()),
    _f("counts", COUNTS),
])

GLOBAL_VERTICAL = StructType([
    _f("id", LongType()), _f("region", StringType()), _f("country", StringType()),
    _f("latitude", FloatType()), _f("longitude", FloatType()),
    _f("date", DateType()), _f("counts", LongType()),
])

US_HORIZONTAL = StructType(
    [f for f in PLACE.fields if f.name in US_IDS]
    + [_f("counts", COUNTS), _f("population", LongType())]
)

US_VERTICAL = StructType(
    [f for f in PLACE.fields if f.name in US_IDS]
    + [_f("date", DateType()), _f("counts", LongType()), _f("population", LongType())]
)

OBSERVATION_LOG = StructType([
    _f("id", LongType()), _f("observed_date", DateType()),
    _f("region", StringType()), _f("country", StringType()),
    _f("last_updated", DateType()),
    _f("confirmed", LongType()), _f("deaths", LongType()), _f("recovered", LongType()),
])
