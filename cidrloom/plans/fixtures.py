"""Insert logs, layers, ranges and probes derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SZ = "cast(power(2, 32 - plen) as bigint)"

#: name -> SQL that Spark and DuckDB both run; 16777216 is 1.0.0.0.
SQL = {
    "ins": f"""select seq, plen, v, seg, ip - ip % {_SZ} as lo, {_SZ} as sz from (
      select cast(c_custkey as bigint) as seq, cast(24 + (c_custkey*5) % 9 as int) as plen, cast(c_nationkey as int) as v,
        c_mktsegment as seg, cast(16777216 + (c_custkey*7919) % 262144 as bigint) as ip from customer) q""",
    "base": """select cast(n_nationkey as bigint) as seq, cast(18 as int) as plen, cast(n_regionkey as int) as v,
      cast(16777216 + (n_nationkey % 16) * 16384 as bigint) as lo, cast(16384 as bigint) as sz from nation""",
    "mid": f"""select seq, plen, v, ip - ip % {_SZ} as lo, {_SZ} as sz from (
      select cast(s_suppkey as bigint) as seq, cast(20 + s_suppkey % 5 as int) as plen, cast(s_nationkey as int) as v,
        cast(16777216 + (s_suppkey*4099) % 262144 as bigint) as ip from supplier) q""",
    "probe": "select cast(event_id as bigint) as id, cast(16777216 + (user_id*40503 + event_id*31) % 300000 as bigint) as ip from events",
    "rng": """select seq, start_ip, start_ip + cast(len as bigint) as end_ip, v from (
      select cast(o_orderkey as bigint) as seq, cast(16777216 + (o_orderkey*613) % 262144 as bigint) as start_ip,
        o_custkey % 1000 as len, cast(o_custkey % 25 as int) as v from orders) q""",
    "rsv": f"""select seq, plen, ip - ip % {_SZ} as lo, {_SZ} as sz from (
      select cast(p_partkey as bigint) as seq, cast((p_partkey % 256) * 16777216 + (p_partkey*97) % 65536 as bigint) as ip,
        cast(8 + p_partkey % 25 as int) as plen from part) q""",
}
_TABLE = {"ins": "customer", "base": "nation", "mid": "supplier", "probe": "events", "rng": "orders", "rsv": "part"}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The derived table ``name``."""
    table = _TABLE[name]
    source = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spark.sql(SQL[name].replace(f"from {table}", "from {source}"), source=source)
