"""Registered queries of the engine and their SQL.

The SQL computes each result another way than the engine does: range joins with
a pick of the last insert instead of equi-joins on masked addresses, and a
recursive greedy split instead of the closed form.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import addr, wire
from .functions.space import V4, V6, halves, wide
from .operators import audit, cidr, interpret, lookup, overlay, special
from .plans.fixtures import SQL, load
from .plans.tables import settle
from .sources import csvsource, treefile

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _register(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def _with(*names: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(f"{n} AS ({SQL[n]})" for n in names)


def _segments(log: str) -> str:
    return f"""ends AS (SELECT lo AS b FROM {log} UNION SELECT lo + sz FROM {log}),
    seg AS (SELECT b AS lo, lead(b) OVER (ORDER BY b) AS hi FROM ends)"""


#: The last covering insert of each segment of ``log`` (lo, sz, seq, v).
def _winners(log: str) -> str:
    return f"""{_segments(log)},
    win AS (SELECT s.lo, s.hi, arg_max(l.v, l.seq) AS v FROM seg s JOIN {log} l ON l.lo <= s.lo AND s.hi <= l.lo + l.sz GROUP BY s.lo, s.hi)"""


def _islands(src: str, value: str = "v") -> str:
    return f"""mk AS (SELECT *, CASE WHEN lag(hi) OVER (ORDER BY lo) = lo AND lag({value}) OVER (ORDER BY lo) IS NOT DISTINCT FROM {value} THEN 0 ELSE 1 END AS nw FROM {src}),
    gp AS (SELECT *, sum(nw) OVER (ORDER BY lo) AS g FROM mk),
    runs AS (SELECT min(lo) AS lo, max(hi) AS hi, any_value({value}) AS {value} FROM gp GROUP BY g)"""


def _greedy(src: str, cols: str, cap: int = 31) -> str:
    """Greedy split of half-open ranges, biggest aligned block first."""
    return f"""cut AS (
      SELECT lo AS pos, hi, {cols}, 0::BIGINT AS b, -1 AS k FROM {src}
      UNION ALL
      SELECT pos + (1::BIGINT << k2), hi, {cols}, pos, k2 FROM (
        SELECT pos, hi, {cols}, least({cap}, floor(log2(hi - pos))::INT,
          CASE WHEN pos = 0 THEN {cap} ELSE floor(log2((pos & -pos)))::INT END) AS k2 FROM cut WHERE pos < hi) z),
    pfx AS (SELECT {cols}, b AS lo, (32 - k)::INT AS plen FROM cut WHERE k >= 0)"""


_INS = _with("ins")
_INS_REC = _with("ins", recursive=True)


@_register(
    """SELECT '1.' || (c_custkey % 256)::VARCHAR || '.0.0/16' AS network,
      CASE WHEN c_nationkey <> 0 THEN c_nationkey::BIGINT END AS autonomous_system_number,
      CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS autonomous_system_organization FROM customer"""
)
def s8_csv_shape_optional_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.concat(F.lit("1."), (F.col("c_custkey") % 256).cast("string"), F.lit(".0.0/16")).alias("network"),
        F.col("c_nationkey").cast("string").alias("asn"),
        F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).otherwise("").alias("org"),
    )
    return csvsource.asn_records(rows)


@_register(f"{SQL['ins'].replace('select seq, plen, v, seg,', 'select seq, plen, ip,')}")
def a1_mask_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_custkey").cast("long").alias("seq"),
        (24 + (F.col("c_custkey") * 5) % 9).cast("int").alias("plen"),
        (16777216 + (F.col("c_custkey") * 7919) % 262144).cast("long").alias("ip"),
    )
    return rows.select("seq", "plen", "ip", addr.mask(F.col("ip"), F.col("plen")).alias("lo"), addr.block_size(F.col("plen")).alias("sz"))


@_register(f"{_INS} SELECT seq, plen, plen + 96 AS depth, CASE WHEN lo < 4294967296 THEN 1 ELSE 0 END AS in_v4 FROM ins")
def a3_tree_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "ins").select("seq", "plen", addr.tree_depth(F.col("plen")).alias("depth"), (F.col("lo") < addr.SPACE).cast("int").alias("in_v4"))


@_register(
    f"""{_INS} SELECT seq, CASE WHEN depth < 96 THEN '::/' || depth::VARCHAR ELSE
      ((m >> 24) & 255)::VARCHAR || '.' || ((m >> 16) & 255)::VARCHAR || '.' || ((m >> 8) & 255)::VARCHAR || '.' || (m & 255)::VARCHAR || '/' || (depth - 96)::VARCHAR END AS prefix
      FROM (SELECT seq, depth, CASE WHEN depth >= 96 THEN (lo // (1::BIGINT << (128 - depth))) * (1::BIGINT << (128 - depth)) END AS m
        FROM (SELECT seq, lo, (88 + seq % 41)::INT AS depth FROM ins))"""
)
def a5_display_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    depth = (88 + F.col("seq") % 41).cast("int")
    return load(spark, sf_dir, "ins").select("seq", addr.display_prefix(F.col("lo"), depth).alias("prefix"))


@_register(
    f"""{_with("rng", recursive=True)}, h AS (SELECT seq, v, start_ip AS lo, end_ip + 1 AS hi FROM rng),
    {_greedy("h", "seq, v", 32)} SELECT seq, v, lo, plen FROM pfx"""
)
def a10_range_to_cidrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rng = load(spark, sf_dir, "rng").select("seq", "v", F.col("start_ip").alias("lo"), (F.col("end_ip") + 1).alias("hi"))
    return cidr.range_to_prefixes(rng)


@_register(f"{_INS}, {_winners('ins')}, {_islands('win')} SELECT lo, hi, v FROM runs")
def i1_overlay_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.overlay(load(spark, sf_dir, "ins"), ["v"]).select("lo", "hi", "v")


_LAYERED = f"""{_with("ins", "mid")}, log AS (
  SELECT seq, lo, sz, v AS a, seg AS b, NULL::INT AS c FROM ins
  UNION ALL SELECT 1000000 + seq, lo, sz, NULL, NULL, v FROM mid),
{_segments("log")},
fold AS (SELECT s.lo, s.hi, arg_max(a, seq) FILTER (a IS NOT NULL) AS a, arg_max(b, seq) FILTER (b IS NOT NULL) AS b, arg_max(c, seq) FILTER (c IS NOT NULL) AS c
  FROM seg s JOIN log l ON l.lo <= s.lo AND s.hi <= l.lo + l.sz GROUP BY s.lo, s.hi),
w AS (SELECT lo, hi, coalesce(a::VARCHAR, '-') || '|' || coalesce(b, '-') || '|' || coalesce(c::VARCHAR, '-') AS t, a, b, c FROM fold),
mk AS (SELECT *, CASE WHEN lag(hi) OVER (ORDER BY lo) = lo AND lag(t) OVER (ORDER BY lo) = t THEN 0 ELSE 1 END AS nw FROM w),
gp AS (SELECT *, sum(nw) OVER (ORDER BY lo) AS g FROM mk)
SELECT min(lo) AS lo, max(hi) AS hi, any_value(a) AS a, any_value(b) AS b, any_value(c) AS c FROM gp GROUP BY g"""


def _two_sources(spark: SparkSession, sf_dir: str, value) -> DataFrame:
    ins, mid = load(spark, sf_dir, "ins"), load(spark, sf_dir, "mid").withColumn("seq", F.col("seq") + 1000000)
    none = F.lit(None)
    first = ins.select("seq", "lo", "plen", value(F.col("v"), F.col("seg"), none.cast("int")).alias("val"))
    return first.unionByName(mid.select("seq", "lo", "plen", value(none.cast("int"), none.cast("string"), F.col("v")).alias("val")))


@_register(_LAYERED)
def i3_overlay_toplevel_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _two_sources(spark, sf_dir, lambda a, b, c: F.struct(a.alias("a"), b.alias("b"), c.alias("c")))
    return overlay.overlay(log, ["val"], "top_level").select("lo", "hi", "val.*")


@_register(_LAYERED)
def i3_overlay_deep_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = lambda a, b: F.struct(a.alias("a"), b.alias("b")).alias("ab")
    log = _two_sources(spark, sf_dir, lambda a, b, c: F.struct(inner(a, b), c.alias("c")))
    return overlay.overlay(log, ["val"], "deep").select("lo", "hi", F.col("val.ab.a").alias("a"), F.col("val.ab.b").alias("b"), F.col("val.c").alias("c"))


_RANGES = f"""{_with("rng")}, rlog AS (SELECT seq, start_ip AS lo, end_ip + 1 - start_ip AS sz, v FROM rng),
  {_winners("rlog")}, {_islands("win")} SELECT lo, hi, v FROM runs"""


@_register(_RANGES)
def i4_insert_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rng = load(spark, sf_dir, "rng").select("seq", "v", F.col("start_ip").alias("lo"), (F.col("end_ip") + 1).alias("hi"))
    return overlay.range_overlay(rng, ["v"]).select("lo", "hi", "v")


@_register(f"{_INS}, {_segments('ins')}, win AS (SELECT s.lo, s.hi, sum(l.v)::INT AS v FROM seg s JOIN ins l ON l.lo <= s.lo AND s.hi <= l.lo + l.sz GROUP BY s.lo, s.hi), {_islands('win')} SELECT lo, hi, v FROM runs")
def i3_overlay_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of the caller's: the sum of all values that were inserted over an address."""
    return overlay.overlay(load(spark, sf_dir, "ins"), ["v"], overlay.Unordered(F.sum)).select("lo", "hi", "v")


@_register(f"{_with('rng')}, rlog AS (SELECT seq, start_ip AS lo, end_ip + 1 - start_ip AS sz, v FROM rng WHERE seq % 8 = 1), {_segments('rlog')}, win AS (SELECT s.lo, s.hi, max(l.v) AS v FROM seg s JOIN rlog l ON l.lo <= s.lo AND s.hi <= l.lo + l.sz GROUP BY s.lo, s.hi), {_islands('win')} SELECT lo, hi, v FROM runs")
def i6_range_pure_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges folded by a function of the caller's: the greatest value."""
    rng = load(spark, sf_dir, "rng").filter("seq % 8 = 1").select("seq", "v", F.col("start_ip").alias("lo"), (F.col("end_ip") + 1).alias("hi"))
    return overlay.range_overlay(rng, ["v"], overlay.Unordered(F.max)).select("lo", "hi", "v")


#: The log in three parts of the space of both families: IPv4, the upper half and the lower half of IPv6 addresses.
_WIDE_H = "CASE fam WHEN 0 THEN 0 WHEN 1 THEN 2594073385365405696 + {0} ELSE 2594073385365405697 + 8589934592 END"
_WIDE_L = "CASE fam WHEN 0 THEN {0} WHEN 1 THEN 0 ELSE {0} * 4294967296 END"
_PLACED = f"""{_INS_REC}, wlog AS (SELECT *, (seq % 3)::INT AS fam FROM ins),
  ends AS (SELECT fam, lo AS b FROM wlog UNION SELECT fam, lo + sz FROM wlog),
  seg AS (SELECT fam, b AS lo, lead(b) OVER (PARTITION BY fam ORDER BY b) AS hi FROM ends),
  win AS (SELECT s.fam, s.lo, s.hi, arg_max(l.v, l.seq) AS v FROM seg s JOIN wlog l ON l.fam = s.fam AND l.lo <= s.lo AND s.hi <= l.lo + l.sz GROUP BY ALL),
  mk AS (SELECT *, CASE WHEN lag(hi) OVER (PARTITION BY fam ORDER BY lo) = lo AND lag(v) OVER (PARTITION BY fam ORDER BY lo) = v THEN 0 ELSE 1 END AS nw FROM win),
  gp AS (SELECT *, sum(nw) OVER (PARTITION BY fam ORDER BY lo) AS g FROM mk),
  runs AS (SELECT fam, min(lo) AS lo, max(hi) AS hi, any_value(v) AS v FROM gp GROUP BY fam, g)"""


def _placed(rows: DataFrame) -> DataFrame:
    """Rows (seq, lo, plen) of 32-bit prefixes in the space of both families."""
    fam, lo = F.col("seq") % 3, F.col("lo")
    high = F.when(fam == 0, F.lit(0)).when(fam == 1, F.lit(2594073385365405696) + lo).otherwise(F.lit(2594073385365405697 + 8589934592))
    low = F.when(fam == 0, lo).when(fam == 1, F.lit(0)).otherwise(lo * 4294967296)
    plen = F.col("plen") + F.when(fam == 0, 96).when(fam == 1, 32).otherwise(64)
    return rows.withColumns({"lo": wide(high.cast("long"), low.cast("long")), "plen": plen.cast("int")})


@_register(f"{_PLACED} SELECT {_WIDE_H.format('lo')} AS lo_h, {_WIDE_L.format('lo')} AS lo_l, {_WIDE_H.format('hi')} AS hi_h, {_WIDE_L.format('hi')} AS hi_l, v FROM runs")
def i1_overlay_ipv6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overlay of networks of both families in one space of 128 bits."""
    r = overlay.overlay(_placed(load(spark, sf_dir, "ins")), ["v"], space=V6)
    (lh, ll), (hh, hl) = halves(F.col("lo")), halves(F.col("hi"))
    return r.select(lh.alias("lo_h"), ll.alias("lo_l"), hh.alias("hi_h"), hl.alias("hi_l"), "v")


@_register(f"{_INS_REC}, {_winners('ins')}, {_islands('win')}, {_greedy('runs', 'v')} SELECT lo, plen, v FROM pfx")
def i14_coalesce_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.to_prefixes(overlay.overlay(load(spark, sf_dir, "ins"), ["v"])).select("lo", "plen", "v")


_LAYERS = f"""{_with("base", "mid", "ins")}, log AS (
  SELECT seq, lo, sz, v FROM base UNION ALL SELECT 1000000 + seq, lo, sz, v FROM mid UNION ALL SELECT 2000000 + seq, lo, sz, v FROM ins)"""


def _layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [load(spark, sf_dir, n).select((F.col("seq") + 1000000 * i).alias("seq"), "lo", "plen", "v") for i, n in enumerate(("base", "mid", "ins"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@_register(f"{_LAYERS}, {_winners('log')}, {_islands('win')} SELECT lo, hi, v FROM runs")
def u1_layered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.overlay(_layers(spark, sf_dir), ["v"]).select("lo", "hi", "v")


_REMOVED = f"""{_LAYERS.replace("SELECT 2000000 + seq, lo, sz, v FROM ins", "SELECT 2000000 + seq, lo, sz, CASE WHEN seq % 3 = 0 THEN -1 ELSE v END FROM ins")},
  {_winners("log")}, kept AS (SELECT * FROM win WHERE v >= 0), {_islands("kept")} SELECT lo, hi, v FROM runs"""


@_register(_REMOVED)
def u2_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _layers(spark, sf_dir)
    gone = (F.col("seq") >= 2000000) & ((F.col("seq") - 2000000) % 3 == 0)
    return overlay.overlay(log.withColumn("v", F.when(~gone, F.col("v"))), ["v"]).select("lo", "hi", "v")


_RECORDS = f"{_winners('ins')}, {_islands('win')}, {_greedy('runs', 'v')}"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.to_prefixes(overlay.overlay(load(spark, sf_dir, "ins"), ["v"]))


@_register(
    f"""{_with("ins", "probe", recursive=True)}, {_RECORDS}
    SELECT p.id, p.ip, r.lo, r.plen, r.v FROM probe p JOIN pfx r ON p.ip >= r.lo AND p.ip < r.lo + (1::BIGINT << (32 - r.plen))"""
)
def j1_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.lookup(load(spark, sf_dir, "probe"), _records(spark, sf_dir)).select("id", "ip", "lo", "plen", "v")


_TOTAL = f"""{_winners("ins")}, {_islands("win")},
  gaps AS (SELECT coalesce(lag(hi) OVER (ORDER BY lo), 0) AS lo, lo AS hi, NULL::INT AS v FROM runs
    UNION ALL SELECT max(hi), 4294967296, NULL FROM runs),
  whole AS (SELECT lo, hi, v FROM runs UNION ALL SELECT lo, hi, v FROM gaps WHERE lo < hi), {_greedy("whole", "v")}"""


def _total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.to_prefixes(overlay.overlay(load(spark, sf_dir, "ins"), ["v"], total=True))


@_register(
    f"""{_with("ins", "probe", recursive=True)}, {_TOTAL}
    SELECT p.id, p.ip, r.lo, r.plen, r.v FROM probe p JOIN pfx r ON p.ip >= r.lo AND p.ip < r.lo + (1::BIGINT << (32 - r.plen))"""
)
def j1_lookup_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.lookup(load(spark, sf_dir, "probe"), _total(spark, sf_dir)).select("id", "ip", "lo", "plen", "v")


_PARTS = f"""{_PLACED.replace(_INS_REC, _with("ins", "probe", recursive=True))}, {_greedy("runs", "fam, v")}"""


@_register(
    f"""{_PARTS}, p AS (SELECT id, ip, (id % 4)::INT AS kind, CASE id % 4 WHEN 3 THEN 0 ELSE (id % 4)::INT END AS fam FROM probe)
    SELECT p.id, (r.plen + CASE p.kind WHEN 0 THEN 0 WHEN 1 THEN 32 WHEN 2 THEN 64 ELSE 16 END)::INT AS bits, r.v
    FROM p JOIN pfx r ON r.fam = p.fam AND p.ip >= r.lo AND p.ip < r.lo + (1::BIGINT << (32 - r.plen))"""
)
def j1_lookup_ipv6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups by text in both families, a quarter of them of 6to4 addresses: the length of the prefix as seen from the address."""
    cover = special.tree_cover(overlay.overlay(_placed(load(spark, sf_dir, "ins")), ["v"], space=V6), ["v"], V6, reserved=False)
    ip, kind = F.col("ip"), F.col("id") % 4
    four = addr.ipv4_text(ip)
    words = lambda n: F.concat_ws(":", *[F.lower(F.hex(F.shiftright(n, s).bitwiseAND(0xFFFF))) for s in (16, 0)])
    text = F.when(kind == 0, four).when(kind == 1, F.concat(F.lit("2400:0:"), words(ip), F.lit("::"))).when(kind == 2, F.concat(F.lit("2400:2:0:1:"), words(ip), F.lit("::")))
    text = text.otherwise(F.concat(F.lit("2002:"), words(ip), F.lit("::1")))
    found = lookup.get(load(spark, sf_dir, "probe").select("id", text.alias("ip")), cover.select("lo", "plen", "v"))
    return found.filter("v is not null").select("id", F.substring_index("network", "/", -1).cast("int").alias("bits"), "v")


_RSV = "reserved(net, s_lo, s_plen) AS (VALUES " + ", ".join(
    f"('{n}', {sum(int(o) << s for o, s in zip(n.split('/')[0].split('.'), (24, 16, 8, 0)))}::BIGINT, {n.split('/')[1]})" for n in special.RESERVED_V4
) + ")"
_DOTTED = "((lo >> 24) & 255)::VARCHAR || '.' || ((lo >> 16) & 255)::VARCHAR || '.' || ((lo >> 8) & 255)::VARCHAR || '.' || (lo & 255)::VARCHAR || '/' || plen::VARCHAR"


@_register(
    f"""{_with("rsv")}, {_RSV} SELECT seq, lo, plen, net AS conflict,
    'attempt to insert ' || {_DOTTED} || ' into ' || net || ', which is a reserved network' AS error,
    'reserved_network' AS error_class FROM rsv JOIN reserved ON lo >= s_lo AND lo + sz <= s_lo + (1::BIGINT << (32 - s_plen))"""
)
def j3_reserved_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return special.reserved_rejects(load(spark, sf_dir, "rsv").select("seq", "lo", "plen"))


_HOLES = f"""{_with("rsv")}, {_RSV}, ok AS (SELECT seq, lo, sz, (seq % 25)::INT AS v FROM rsv
    WHERE NOT EXISTS (SELECT 1 FROM reserved WHERE lo >= s_lo AND lo + sz <= s_lo + (1::BIGINT << (32 - s_plen)))),
  blk AS (SELECT s_lo AS lo, 1::BIGINT << (32 - s_plen) AS sz FROM reserved),
  ends AS (SELECT lo AS b FROM ok UNION SELECT lo + sz FROM ok UNION SELECT lo FROM blk UNION SELECT lo + sz FROM blk),
  seg AS (SELECT b AS lo, lead(b) OVER (ORDER BY b) AS hi FROM ends),
  win AS (SELECT s.lo, s.hi, arg_max(l.v, l.seq) AS v FROM seg s JOIN ok l ON l.lo <= s.lo AND s.hi <= l.lo + l.sz
    WHERE NOT EXISTS (SELECT 1 FROM blk WHERE blk.lo <= s.lo AND s.hi <= blk.lo + blk.sz) GROUP BY s.lo, s.hi),
  {_islands("win")} SELECT lo, hi, v FROM runs"""


@_register(_HOLES)
def j4_reserved_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = special.reserved_accepts(load(spark, sf_dir, "rsv").select("seq", "lo", "plen", (F.col("seq") % 25).cast("int").alias("v")))
    return special.punch_reserved(overlay.overlay(log, ["v"])).select("lo", "hi", "v")


_FORMS = """f AS (SELECT id, ip, CASE id % 4 WHEN 0 THEN 0 WHEN 1 THEN (8194::BIGINT << 48) | (ip << 16) WHEN 2 THEN (536936448::BIGINT << 32) | ip ELSE 2306139568115548160 END AS ip_hi,
    CASE id % 4 WHEN 0 THEN (65535::BIGINT << 32) | ip ELSE id END AS ip_lo FROM probe)"""


@_register(
    f"""{_with("probe")}, {_FORMS} SELECT id, CASE WHEN ip_hi = 0 AND ip_lo // 4294967296 = 65535 THEN ip_lo % 4294967296
      WHEN ip_hi // 4294967296 = 536936448 THEN ip_hi % 4294967296
      WHEN ip_hi // 281474976710656 = 8194 THEN (ip_hi // 65536) % 4294967296 END AS v4 FROM f"""
)
def j5_alias_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, ip = F.col("id") % 4, F.col("ip")
    hi = F.when(kind == 0, F.lit(0)).when(kind == 1, F.lit(0x2002 << 48).bitwiseOR(F.shiftleft(ip, 16))).when(kind == 2, F.lit(0x20010000 << 32).bitwiseOR(ip)).otherwise(F.lit(0x20010DB800000000 - 0))
    lo = F.when(kind == 0, F.lit(0xFFFF << 32).bitwiseOR(ip)).otherwise(F.col("id"))
    return load(spark, sf_dir, "probe").select("id", special.embedded_ipv4(hi.cast("long"), lo.cast("long")).alias("v4"))


@_register(f"{_INS_REC}, {_RECORDS} SELECT sha256(v::VARCHAR) AS value_key, v, count(*) AS refs FROM pfx GROUP BY v")
def g3_value_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.dictionary(_records(spark, sf_dir), "v")


@_register(f"{_INS_REC}, {_RECORDS} SELECT v, plen, count(*) AS refs FROM pfx GROUP BY v, plen")
def g4_refcounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).groupBy("v", "plen").agg(F.count(F.lit(1)).alias("refs"))


_NODES = f"""{_INS_REC}, {_TOTAL},
  nd AS (SELECT DISTINCT lo - lo % (1::BIGINT << (32 - d)) AS lo, d::INT AS depth FROM (SELECT lo, unnest(range(0, plen)) AS d FROM pfx))"""


@_register(f"{_NODES} SELECT count(*) AS node_count FROM nd")
def g5_node_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.node_count(_total(spark, sf_dir))


@_register(
    f"""{_PLACED}, {_greedy("runs", "fam, v")}, net AS (
      SELECT ({_WIDE_H.format("lo")})::HUGEINT * 18446744073709551616 + ({_WIDE_L.format("lo")})::HUGEINT AS adr, plen + CASE fam WHEN 0 THEN 96 WHEN 1 THEN 32 ELSE 64 END AS depth FROM pfx),
    inner_nodes AS (SELECT DISTINCT CASE WHEN d < 2 THEN 0::HUGEINT ELSE adr - adr % (1::HUGEINT << (128 - greatest(d, 2))::INT) END AS adr, d FROM (SELECT adr, unnest(range(0, depth)) AS d FROM net))
    SELECT count(*) AS node_count FROM inner_nodes"""
)
def g5_node_count_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner nodes of a tree of both families without special networks."""
    ranges = overlay.overlay(_placed(load(spark, sf_dir, "ins")), ["v"], space=V6)
    return audit.node_count(special.tree_cover(ranges, ["v"], V6, reserved=False, aliases=False), V6)


@_register(
    f"""{_INS}, win AS (SELECT s.lo, s.hi, arg_max(l.v, l.seq) AS v, arg_max(l.seg, l.seq) AS w FROM (SELECT b AS lo, lead(b) OVER (ORDER BY b) AS hi FROM (SELECT lo AS b FROM ins UNION SELECT lo + sz FROM ins)) s
      JOIN ins l ON l.lo <= s.lo AND s.hi <= l.lo + l.sz GROUP BY s.lo, s.hi)
    SELECT count(DISTINCT (v, w)) + count(DISTINCT v) + count(DISTINCT w) AS live_values FROM win"""
)
def g6_live_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different values that a layer holds: maps of a number and a text, and what is in them."""
    log = load(spark, sf_dir, "ins").withColumn("val", F.struct("v", F.col("seg").alias("w")))
    return audit.live_values(overlay.to_prefixes(overlay.overlay(log, ["val"])), "val")


@_register(f"{_INS} SELECT seq, lo, plen, v, row_number() OVER (ORDER BY plen DESC, seq) AS place FROM ins")
def t4_order_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts in the order of most specific first: a range-partitioned sort, and places counted by length."""
    log = load(spark, sf_dir, "ins").select("seq", "lo", "plen", "v")
    counts = log.groupBy("plen").agg(F.count(F.lit(1)).alias("n"))
    along = Window.partitionBy(F.lit(0)).orderBy(F.desc("plen")).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("plen", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("_before"))  # at most 33 rows
    own = F.row_number().over(Window.partitionBy("plen").orderBy("seq"))
    return log.withColumn("_own", own).join(F.broadcast(before), "plen").select("seq", "lo", "plen", "v", (F.col("_before") + F.col("_own")).alias("place"))


@_register(f"{_NODES} SELECT lo, depth, row_number() OVER (ORDER BY lo, depth) - 1 AS node FROM nd")
def t2_node_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.numbered_nodes(_total(spark, sf_dir))


@_register(
    f"""{_INS_REC}, {_RECORDS}, r AS (SELECT *, 1::BIGINT << (32 - plen) AS sz FROM pfx)
    SELECT 'misaligned' AS "check", count(*) FILTER (lo % sz <> 0) AS n FROM r
    UNION ALL SELECT 'overlap', count(*) FROM r a JOIN r b ON a.plen > b.plen AND a.lo >= b.lo AND a.lo < b.lo + b.sz
    UNION ALL SELECT 'mergeable', count(*) FROM r a JOIN r b ON a.plen = b.plen AND a.v = b.v AND b.lo = a.lo + a.sz AND a.lo % (2 * a.sz) = 0
    UNION ALL SELECT 'uncovered', count(*) FROM (SELECT lo, coalesce(max(lo + sz) OVER (ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT lo, sz FROM r UNION ALL SELECT 4294967296, 0)) WHERE before < lo"""
)
def k1_disjoint_cover_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.violations(_records(spark, sf_dir), "v")


@_register(
    f"""{_INS_REC}, {_RECORDS}, used AS (SELECT sha256(v::VARCHAR) AS k, v, count(*) AS refs FROM pfx GROUP BY v)
    SELECT 'orphan' AS "check", count(*) FILTER (v % 5 = 0) AS n FROM used
    UNION ALL SELECT 'unused', 1 UNION ALL SELECT 'miscounted', count(*) FILTER (v % 5 <> 0 AND v % 7 = 1) FROM used"""
)
def k2_reference_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference counts against a dictionary with entries missing, miscounted and left over."""
    records = settle(_records(spark, sf_dir), "records")
    keyed = records.select("lo", "plen", F.sha2(F.col("v").cast("string"), 256).alias("value_key"))
    entries = audit.dictionary(records, "v").filter("v % 5 <> 0").select("value_key", F.when(F.col("v") % 7 == 1, F.col("refs") + 1).otherwise(F.col("refs")).alias("refs"))
    extra = spark.range(1).select(F.lit("none").alias("value_key"), F.lit(1).cast("long").alias("refs"))
    return audit.reference_audit(keyed, entries.unionByName(extra))


_TEXT = "CASE seq % 4 WHEN 0 THEN '300.1.2.3/8' WHEN 1 THEN '2001:db8::/40' ELSE {0} END"


@_register(
    f"""{_with("rsv")}, {_RSV}, t AS (SELECT seq, lo, plen, sz, {_TEXT.format(_DOTTED)} AS network FROM rsv)
    SELECT seq, network, CASE seq % 4 WHEN 0 THEN 'prefix is invalid' WHEN 1 THEN 'IPv6 prefixes cannot be inserted into an IPv4 tree'
      ELSE 'attempt to insert ' || network || ' into ' || net || ', which is a reserved network' END AS error,
      CASE WHEN seq % 4 < 2 THEN 'invalid_prefix' ELSE 'reserved_network' END AS error_class
    FROM t LEFT JOIN reserved ON seq % 4 > 1 AND lo >= s_lo AND lo + sz <= s_lo + (1::BIGINT << (32 - s_plen)) WHERE seq % 4 < 2 OR net IS NOT NULL"""
)
def s9_csv_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of text whose networks can't be inserted, with the reason."""
    kind = F.col("seq") % 4
    text = F.when(kind == 0, "300.1.2.3/8").when(kind == 1, "2001:db8::/40").otherwise(addr.ipv4_prefix_text(F.col("lo"), F.col("plen")))
    rows = load(spark, sf_dir, "rsv").select("seq", text.alias("network"))
    return csvsource.insert_log(rows, V4)[1]


@_register(
    """SELECT p_partkey::BIGINT AS id,
      CASE WHEN p_size < 1 THEN 'a0' ELSE 'a1' || lower(printf('%02x', p_size)) END AS u16_hex,
      lower(printf('%02x', 64 + strlen(p_brand))) || lower(hex(p_brand)) AS text_hex FROM part"""
)
def s17_wire_encoding_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(
        F.col("p_partkey").cast("long").alias("id"),
        F.lower(F.hex(wire.encode_scalar(F.col("p_size"), "uint16"))).alias("u16_hex"),
        F.lower(F.hex(wire.encode_scalar(F.col("p_brand"), "string"))).alias("text_hex"),
    )


@_register(f"""{_INS_REC}, {_RECORDS} SELECT {_DOTTED} AS network, '{{"v":' || v::VARCHAR || '}}' AS value FROM pfx""")
def s10_file_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _records(spark, sf_dir).select("lo", "plen", F.to_json(F.struct("v")).alias("value"))
    return treefile.roundtrip(records)


@_register(
    f"""{_INS_REC}, {_segments("ins")}, win AS (
      SELECT s.lo, s.hi, '{{"_prefix_length":' || max(l.plen)::VARCHAR || ',"v":' || arg_max(l.v, l.plen::BIGINT * 1000000000 + l.seq)::VARCHAR || '}}' AS v
      FROM seg s JOIN ins l ON l.lo <= s.lo AND s.hi <= l.lo + l.sz GROUP BY s.lo, s.hi), {_islands("win")}, {_greedy("runs", "v")}
    SELECT {_DOTTED} AS network, v AS value FROM pfx"""
)
def f2_metadata_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = load(spark, sf_dir, "ins").select("seq", addr.ipv4_prefix_text(F.col("lo"), F.col("plen")).alias("network"), F.to_json(F.struct("v")).alias("value"))
    return interpret.metadata_overlay(log)
