"""CSV layouts of network data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.addr import ERR_FAMILY, wide_prefix
from ..functions.space import IPV4_DEPTH, V6, Space, halves
from ..operators.special import reserved_accepts, reserved_rejects


def asn_records(rows: DataFrame) -> DataFrame:
    """(network, autonomous_system_number, autonomous_system_organization) of text columns network, asn, org.

    A number of 0 and an empty organization are absent keys (null).
    """
    number = F.col("asn").try_cast("long")
    return rows.select(
        "network",
        F.when(number != 0, number).alias("autonomous_system_number"),
        F.when(F.col("org") != "", F.col("org")).alias("autonomous_system_organization"),
    )


def read_asn_csv(spark: SparkSession, path: str) -> DataFrame:
    """A file with a header, of whatever names, and exactly three columns: network, number, organization."""
    head = spark.read.csv(path, header=True, inferSchema=False)
    if len(head.columns) != 3:
        raise ValueError(f"expected 3 columns, found {len(head.columns)}")
    names = ", ".join(f"`{c.replace('`', '``')}` string" for c in head.columns)
    return asn_records(spark.read.csv(path, header=True, schema=names, enforceSchema=False, mode="FAILFAST").toDF("network", "asn", "org"))


def read_country_csv(spark: SparkSession, path: str) -> DataFrame:
    """A file without header: network, country, city; short rows keep nulls, for the caller to quarantine."""
    return spark.read.csv(path, header=False, schema="network string, country string, city string", mode="PERMISSIVE")


def insert_log(rows: DataFrame, space: Space = V6, reserved: bool = True, aliases: bool = True) -> tuple[DataFrame, DataFrame]:
    """(log, rejects) of rows with ``network`` text: what can be inserted, and the rest with ``error`` and ``error_class``.

    The log has the rows' columns with lo and plen; a null or bad network, an
    IPv6 one in a space of 32 bits, and one inside a special network are
    rejected with the message that inserting it would raise.
    """
    p = rows.withColumn("_p", wide_prefix(F.col("network")))
    family = F.when((F.lit(space.bits == 32)) & ~F.col("_p.as4"), ERR_FAMILY)
    p = p.withColumn("_error", F.coalesce("_p.error", family))
    bad = p.filter("_error is not null").select(*rows.columns, F.col("_error").alias("error"), F.lit("invalid_prefix").alias("error_class"))
    lo = halves(F.col("_p.lo"))[1] if space.bits == 32 else F.col("_p.lo")
    plen = F.col("_p.plen") - (IPV4_DEPTH if space.bits == 32 else 0)
    good = p.filter("_error is null").select(*rows.columns, lo.alias("lo"), plen.alias("plen"))
    special = reserved_rejects(good, space, reserved, aliases).select(*rows.columns, "error", "error_class")
    return reserved_accepts(good, space, reserved, aliases), bad.unionByName(special)
