"""Set-oriented operators against the sequential form and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from cidrloom.functions import addr, merge, wire
from cidrloom.functions.space import V6
from cidrloom.operators import audit, cidr, interpret, lookup, overlay, special
from cidrloom.sources import csvsource, treefile
from cidrloom.streaming import maintain


def random_log(seed, n=120, low=4):
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        plen = rng.choice([low, 8, 11, 12, 13, 20, 22, 24, 28, 31, 32])
        ip = (rng.randrange(1 << 6) << 18) + rng.randrange(1 << 10) if plen > 12 else rng.randrange(1 << 32)
        rows.append((seq, ip >> (32 - plen) << (32 - plen), plen, rng.choice([None, 1, 2, 3])))
    return rows


def as_text(lo, plen):
    return ".".join(str(lo >> s & 255) for s in (24, 16, 8, 0)) + f"/{plen}"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_overlay_is_the_sequential_fold(spark, seed):
    rows = random_log(seed)
    log = spark.createDataFrame(rows, "seq long, lo long, plen int, v int")
    got = {(as_text(r.lo, r.plen), r.v) for r in overlay.to_prefixes(overlay.overlay(log, ["v"])).collect()}
    layer = interpret.Layer(32, reserved=False)
    for _, lo, plen, v in rows:
        layer.insert(as_text(lo, plen), None if v is None else ("uint32", v))
    assert got == {(n, v[1]) for n, v in layer.networks()}


def test_total_cover_numbers_nodes_like_the_tree(spark):
    rows = random_log(7, 60)
    log = spark.createDataFrame(rows, "seq long, lo long, plen int, v int")
    cover = overlay.to_prefixes(overlay.total_cover(overlay.overlay(log, ["v"]), ["v"]))
    layer = interpret.Layer(32, reserved=False)
    for _, lo, plen, v in rows:
        layer.insert(as_text(lo, plen), None if v is None else ("uint32", v))
    got = sorted((r.node, r.lo, r.depth) for r in audit.numbered_nodes(cover).collect())
    assert got == [(i, a, d) for i, (a, d) in enumerate(layer.node_keys())]
    assert audit.node_count(cover).first().node_count == len(layer.node_keys())
    audit.check_layer(cover, "v")


@pytest.mark.parametrize("how", ["top_level", "deep"])
def test_merges(spark, how):
    rng = random.Random(3)
    rows, layer = [], interpret.Layer(32, reserved=False)
    for seq in range(60):
        plen = rng.choice([20, 24, 26, 30])
        lo = (1 << 24) + rng.randrange(1 << 14) >> (32 - plen) << (32 - plen)
        a, b = rng.choice([None, 1, 2]), rng.choice([None, "x", "y"])
        rows.append((seq, lo, plen, ({"p": a, "q": b}, None if a is None else a + 5)))
        value = {"c": a + 5} if a is not None else {}
        value["n"] = {k: v for k, v in (("p", a), ("q", b)) if v is not None}
        from cidrloom.functions.wire import from_plain

        layer.insert(as_text(lo, plen), from_plain(value), interpret.TOP_LEVEL if how == "top_level" else interpret.DEEP)
    log = spark.createDataFrame(rows, "seq long, lo long, plen int, val struct<n:struct<p:int,q:string>,c:int>")
    got = {(as_text(r.lo, r.plen), r.val.n.p, r.val.n.q, r.val.c) for r in overlay.to_prefixes(overlay.overlay(log, ["val"], how)).collect()}
    from cidrloom.functions.wire import to_plain

    want = {(n, p["n"].get("p"), p["n"].get("q"), p.get("c")) for n, p in ((n, to_plain(v)) for n, v in layer.networks())}
    assert got == want


def test_deep_merge_arrays(spark):
    df = spark.sql("select array(1, 2, 3) a, array(9) b, cast(null as array<int>) n")
    kind = df.schema["a"].dataType
    r = df.select(merge.deep_merge(F.col("a"), F.col("b"), kind).alias("x"), merge.deep_merge(F.col("n"), F.col("b"), kind).alias("y"), merge.deep_merge(F.col("a"), F.col("n"), kind).alias("z")).first()
    assert (r.x, r.y, r.z) == ([9, 2, 3], [9], [1, 2, 3])
    with pytest.raises(TypeError):
        merge.top_level_merge(F.col("a"), F.col("b"), kind)


@pytest.mark.parametrize("cap", [31, 32])
def test_cidr(spark, cap):
    import ipaddress

    rng = random.Random(9)
    rows = [(i, lo, min(1 << 32, lo + rng.randrange(1, 1 << rng.randrange(1, 33)))) for i, lo in enumerate(rng.randrange(1 << 32) for _ in range(200))]
    rows += [(900, 0, 1 << 32), (901, 5, 5), (902, 0, 1)]
    got = cidr.range_to_prefixes(spark.createDataFrame(rows, "i int, lo long, hi long"), cap)
    have = {}
    for r in got.collect():
        have.setdefault(r.i, []).append((r.lo, r.plen))
    for i, lo, hi in rows:
        nets = [(int(n.network_address), n.prefixlen) for n in ipaddress.summarize_address_range(ipaddress.IPv4Address(lo), ipaddress.IPv4Address(hi - 1))] if hi > lo else []
        if cap == 31 and nets == [(0, 0)]:
            nets = [(0, 1), (1 << 31, 1)]
        assert sorted(have.get(i, [])) == sorted(nets)


def test_reserved(spark):
    rows = [(1, 10 << 24, 8), (2, (10 << 24) + 1, 32), (3, 8 << 24, 6), (4, (240 << 24) + 1, 32), (5, 1 << 24, 8)]
    df = spark.createDataFrame(rows, "seq long, lo long, plen int")
    bad = {r.seq: r.error for r in special.reserved_rejects(df).collect()}
    layer = interpret.Layer(32)
    for seq, lo, plen in rows:
        try:
            layer.insert(as_text(lo, plen), ("uint32", seq))
            assert seq not in bad
        except interpret.SpecialNetworkError as error:
            assert bad[seq] == str(error)
    log = special.reserved_accepts(df).withColumn("v", F.col("seq"))
    ranges = special.punch_reserved(overlay.overlay(log, ["v"]))
    got = {(as_text(r.lo, r.plen), r.v) for r in overlay.to_prefixes(ranges).collect()}
    assert got == {(n, v[1]) for n, v in layer.networks()}


def test_lookup(spark):
    log = spark.createDataFrame(random_log(11, 80), "seq long, lo long, plen int, v int")
    records = overlay.to_prefixes(overlay.total_cover(overlay.overlay(log, ["v"]), ["v"]))
    layer = interpret.Layer(32, reserved=False)
    for r in log.orderBy("seq").collect():
        layer.insert(as_text(r.lo, r.plen), None if r.v is None else ("uint32", r.v))
    rng = random.Random(1)
    probes = [(i, rng.randrange(1 << 26)) for i in range(300)]
    got = lookup.lookup(spark.createDataFrame(probes, "id int, ip long"), records)
    assert got.count() == len(probes)
    for r in got.collect():
        network, value = layer.get(as_text(r.ip, 32)[:-3])
        assert (as_text(r.lo, r.plen), r.v) == (network, None if value is None else value[1])
    only = records.filter("v is not null")
    left = lookup.lookup(spark.createDataFrame(probes, "id int, ip long"), only, how="left")
    assert left.count() == len(probes)


def test_address_text(spark):
    df = spark.createDataFrame([("1.2.3.4",), ("256.1.1.1",), ("01.2.3.4",), ("x",), (None,), ("255.255.255.255",)], "t string")
    assert [r.x for r in df.select(addr.ipv4_from_text(F.col("t")).alias("x")).collect()] == [16909060, None, None, None, None, (1 << 32) - 1]
    df = spark.createDataFrame([("1.2.3.77/24",), ("::ffff:1.2.3.0/100",), ("::ffff:0:0/90",), ("2003:5::/20",), ("bad",)], "t string")
    out = [(None if r.p.addr is None else bytes(r.p.addr).hex(), r.p.depth, r.p.error) for r in df.select(addr.normalize_prefix(F.col("t"), 128).alias("p")).collect()]
    assert out[0] == ("0" * 24 + "01020300", 120, None) and out[1][1] == 100
    assert out[2][2] == addr.ERR_SHORT_MAPPED and out[4][2] == addr.ERR_INVALID
    raw = spark.createDataFrame([(bytes(range(16)), 12)], "a binary, b int").select(addr.mask16(F.col("a"), F.col("b")).alias("m")).first().m
    assert bytes(raw) == bytes(16)


def test_audit_finds_faults(spark):
    bad = spark.createDataFrame([(0, 24, 1), (256, 24, 1), (0, 25, 2), (5, 24, 3)], "lo long, plen int, v int")
    found = {r.check: r.n for r in audit.violations(bad, "v").collect()}
    assert found["mergeable"] == 1 and found["overlap"] >= 1 and found["misaligned"] == 1
    with pytest.raises(audit.LayerInvariantError):
        audit.check_layer(bad, "v")


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("network,asn,org\n1.0.0.0/24,0,\n1.0.1.0/24,13335,Some Org\n")
    rows = csvsource.read_asn_csv(spark, str(tmp_path / "a.csv")).collect()
    assert [tuple(r) for r in rows] == [("1.0.0.0/24", None, None), ("1.0.1.0/24", 13335, "Some Org")]
    (tmp_path / "c.csv").write_text("1.0.0.0/24,AU,Sydney\n1.0.1.0/24,CN\n")
    assert [tuple(r) for r in csvsource.read_country_csv(spark, str(tmp_path / "c.csv")).collect()] == [("1.0.0.0/24", "AU", "Sydney"), ("1.0.1.0/24", "CN", None)]


def test_stream(spark, tmp_path):
    rows = [(s, lo, p, v) for s, lo, p, v in random_log(21, 60, low=6)]
    src, log, layer, check = (str(tmp_path / x) for x in ("src", "log", "layer", "check"))
    schema = "seq long, lo long, plen int, v int"
    for part in (rows[:30], rows[30:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        q = maintain.maintain(spark.readStream.schema(schema).parquet(src), log, layer, ["v"], check)
        q.awaitTermination()
    have = overlay.coalesce_ranges(maintain.read_layer(spark, layer).select("lo", "hi", "v"), ["v"])
    want = overlay.overlay(spark.createDataFrame(rows, schema), ["v"])
    assert sorted(map(tuple, have.select("lo", "hi", "v").collect())) == sorted(map(tuple, want.select("lo", "hi", "v").collect()))


def wide_log(spark, rows):
    """(seq, lo, plen, v) in the space of both families of (network, value) rows."""
    df = spark.createDataFrame([(i, n, v) for i, (n, v) in enumerate(rows)], "seq long, network string, v int")
    return df.select("seq", addr.wide_prefix(F.col("network")).alias("p"), "v").select("seq", "p.lo", "p.plen", "v")


def random_networks(seed, n=80):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        kind, v = rng.randrange(4), rng.choice([None, 1, 2, 3])
        if kind == 0:
            out.append((f"{rng.choice([1, 9, 200])}.{rng.randrange(4)}.{rng.randrange(4)}.0/{rng.choice([8, 20, 24, 30])}", v))
        else:
            out.append((f"{rng.choice(['2400', '2c0f', '8000', '64'])}:{rng.randrange(4):x}::{rng.randrange(4):x}:0:0:{rng.randrange(6):x}/{rng.choice([3, 16, 31, 33, 64, 65, 80, 127, 128])}", v))
    return out


@pytest.mark.parametrize("aliases", [True, False])
def test_both_families_are_the_sequential_fold(spark, aliases):
    """Records, node numbers and lookups of a tree of both families with special networks."""
    layer, rows = interpret.Layer(128, True, aliases), []
    for network, v in random_networks(5 + aliases):
        try:
            layer.insert(network, None if v is None else ("uint32", v))
            rows.append((network, v))
        except ValueError:
            continue
    ranges = overlay.overlay(wide_log(spark, rows), ["v"], space=V6)
    cover = special.tree_cover(ranges, ["v"], V6, True, aliases).cache()
    want = [(a, r.depth, r.kind, None if r.value is None else r.value[1]) for a, r in layer.records()]
    number = lambda x: ((x.h + (1 << 63)) << 64) + x.l + (1 << 63)
    assert sorted(((number(r.lo), r.plen, r.kind, r.v) for r in cover.collect()), key=repr) == sorted(want, key=repr)
    assert [(r.node, number(r.lo), r.depth) for r in audit.numbered_nodes(cover, V6).orderBy("node").collect()] == [(i, *k) for i, k in enumerate(layer.node_keys())]
    probes = ["1.1.1.1", "::1.1.1.1", "::ffff:9.0.1.0", "2002:901:100::5", "2001:0:901:100::", "2400:1::", "10.0.0.1", "nonsense", "8000:3::2:0:0:1", "2c0f::"]
    got = lookup.get(spark.createDataFrame([(p,) for p in probes], "ip string"), cover.select("lo", "plen", "v"), aliases=aliases)
    seen = {r.ip: (r.network, r.v) for r in got.collect()}
    assert seen == {p: (n, None if v is None else v[1]) for p in probes for n, v in [layer.get(p)]}
    cover.unpersist()


@pytest.mark.parametrize("rows, reserved, aliases, nodes", [([("::/1", 1)], False, True, 142), ([("1.0.0.0/8", 1)], False, False, 104), ([("1.1.1.1/32", 1)], True, True, 375)])
def test_node_counts_of_both_families(spark, rows, reserved, aliases, nodes):
    layer = interpret.Layer(128, reserved, aliases)
    for network, v in rows:
        layer.insert(network, ("uint32", v))
    cover = special.tree_cover(overlay.overlay(wide_log(spark, rows), ["v"], space=V6), ["v"], V6, reserved, aliases)
    assert audit.node_count(cover, V6).first().node_count == len(layer.node_keys()) == nodes


def test_special_networks_reject_in_both_families(spark):
    nets = ["10.1.0.0/16", "2001:db8::/40", "2002:102::/48", "::ffff:0:0/96", "2001::/33", "1.0.0.0/8", "2400::/12", "240.0.0.1/32", "bad", "fe80::/9"]
    rows = spark.createDataFrame([(n,) for n in nets], "network string")
    log, bad = csvsource.insert_log(rows, V6)
    layer, errors = interpret.Layer(128), {}
    for n in nets:
        try:
            layer.insert(n, ("uint32", 1))
        except ValueError as e:
            errors[n] = str(e)
    assert {r.network: r.error for r in bad.collect()} == errors
    assert {r.network for r in log.collect()} == set(nets) - set(errors)
    kinds = {r.network: r.error_class for r in bad.collect()}
    assert kinds["2002:102::/48"] == "aliased_network" and kinds["10.1.0.0/16"] == "reserved_network" and kinds["bad"] == "invalid_prefix"


def test_values_are_equal_where_their_wire_is(spark):
    log = spark.createDataFrame([(1, 0, 8, 0.0), (2, 1 << 24, 8, -0.0), (3, 2 << 24, 8, -0.0)], "seq long, lo long, plen int, v double")
    got = sorted((r.lo, r.hi) for r in overlay.overlay(log, ["v"]).collect())
    assert got == [(0, 1 << 24), (1 << 24, 3 << 24)]
    log = spark.createDataFrame([(1, 0, 8, {"a": 1, "b": 2}), (2, 1 << 24, 8, {"b": 2, "a": 1}), (3, 0, 9, {"c": 5})], "seq long, lo long, plen int, v map<string,int>")
    assert [(r.lo, r.hi, r.v) for r in overlay.overlay(log, ["v"]).orderBy("lo").collect()] == [(0, 1 << 23, {"c": 5}), (1 << 23, 2 << 24, {"a": 1, "b": 2})]
    deep = overlay.overlay(log, ["v"], "deep").orderBy("lo").collect()
    assert [r.v for r in deep] == [{"a": 1, "b": 2, "c": 5}, {"a": 1, "b": 2}]


def test_csv_with_any_header(spark, tmp_path):
    path = tmp_path / "asn.csv"
    path.write_text('network,autonomous_system_number,autonomous_system_organization\n1.0.0.0/24,13335,"A, B"\n2.0.0.0/8,0,\n')
    assert sorted(map(tuple, csvsource.read_asn_csv(spark, str(path)).collect())) == [("1.0.0.0/24", 13335, "A, B"), ("2.0.0.0/8", None, None)]
    path.write_text("network,asn\n1.0.0.0/24,5\n")
    with pytest.raises(ValueError, match="3 columns"):
        csvsource.read_asn_csv(spark, str(path))


def test_records_in_a_file_of_both_families(spark, tmp_path):
    """What is read from a file and written again is the same file, byte for byte; the sink writes it too."""
    layer = interpret.Layer(128)
    values = [("map", {"x": ("uint16", 7), "y": ("slice", [("double", -0.0), ("bytes", b"\x00\xff")])}), ("uint32", 5)]
    for i, n in enumerate(["1.0.0.0/24", "1.0.1.0/24", "2400::/12", "2c0f:1::/33", "9.9.9.9/32"]):
        layer.insert(n, values[i % 2])
    options = treefile.Options(1, "t", {"en": "d"}, ["en"], 6, 28)
    raw, path, again = treefile.layer_bytes(layer, options), str(tmp_path / "a.tree"), str(tmp_path / "b.tree")
    (tmp_path / "a.tree").write_bytes(raw)
    read = treefile.read_tree(spark, path)
    records = read.select("network", "wire").select(addr.wide_prefix(F.col("network")).alias("p"), "wire").select("p.lo", "p.plen", "wire")
    assert treefile.write_records(records, again, options, reserved=True, aliases=True) == len(raw)
    assert (tmp_path / "b.tree").read_bytes() == raw
    sink = str(tmp_path / "c.tree")
    read.select("network", "wire").write.format("prefix_tree").mode("overwrite").option("database_type", "t").option("build_epoch", "1").save(sink)
    assert sorted(map(tuple, treefile.read_tree(spark, sink).select("network", "wire").collect())) == sorted(map(tuple, read.select("network", "wire").collect()))
    narrow = spark.createDataFrame([(1 << 24, 24, '{"v":1}')], "lo long, plen int, value string")
    treefile.write_records(narrow, again, treefile.Options(1))
    assert [tuple(r)[0] for r in treefile.read_tree(spark, again).select("network").collect()] == ["1.0.0.0/24"]
    with pytest.raises(ValueError, match="ip_version 6"):
        treefile.write_records(records, again, treefile.Options(1, ip_version=4))


def test_lookup_splits_hot_shards(spark, monkeypatch):
    records = spark.createDataFrame([(1 << 24, 8, 1), (5 << 24, 32, 2)], "lo long, plen int, v int")
    probes = spark.createDataFrame([(i, (1 << 24) + i % 3) for i in range(50)] + [(99, None), (98, 5 << 24), (97, 0)], "id int, ip long")
    whole = sorted(map(tuple, lookup.lookup(probes, records, how="left").collect()), key=repr)
    monkeypatch.setattr(lookup, "HOT_PROBES", 8)
    assert sorted(map(tuple, lookup.lookup(probes, records, how="left").collect()), key=repr) == whole
    assert [w for w in whole if w[0] > 90] == [(97, 0, None, None, None), (98, 5 << 24, 5 << 24, 32, 2), (99, None, None, None, None)]


def test_lookup_keeps_hot_shards_split(spark, monkeypatch):
    """Rows of one shard of the wide space end in the tasks that they were split to, next to records of the shards before."""
    wide = "struct<c:int,h:bigint,l:bigint>"
    at = lambda i: f"named_struct('c', 0, 'h', {0x2400 << 48} ^ {-1 << 63}, 'l', {i} ^ {-1 << 63})"
    records = spark.sql(f"select cast({at(0)} as {wide}) as lo, 120 as plen, 1 as v union all select named_struct('c', 0, 'h', {-1 << 63}, 'l', {-1 << 63}), 2, 2")
    probes = spark.range(0, 400, 1, 3).selectExpr("cast(id as int) as id", f"cast({at('id')} as {wide}) as ip")
    monkeypatch.setattr(lookup, "HOT_PROBES", 20)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        found = lookup.lookup(probes, records, how="left", space=V6).select("id", "v", F.spark_partition_id().alias("task")).collect()
    finally:
        for key in settings:
            spark.conf.unset(key)
    assert sorted((r.id, r.v) for r in found) == [(i, 1 if i < 256 else None) for i in range(400)]
    assert len({r.task for r in found}) > 1


def test_folds_take_inserts_of_a_prefix_together(spark):
    rng = random.Random(9)
    rows = []
    for seq in range(200):
        plen = rng.choice([0, 8, 20, 24, 26])
        lo = (1 << 24) + rng.randrange(1 << 13) >> (32 - plen) << (32 - plen)
        n = rng.choice([None, (None, None), (rng.randrange(9), rng.choice([None, "x", "y"]))])
        rows.append((seq, lo, plen, rng.choice([None, 1, 2, 3]), rng.choice([None, (n, None), (n, seq)])))
    log = spark.createDataFrame(rows, "seq long, lo long, plen int, v int, val struct<n:struct<p:int,q:string>,c:int>").repartition(3)
    segs = overlay.segments(log)
    pairs = [("v", overlay.Unordered(F.max), lambda a, b: F.greatest(a, b)), ("v", overlay.Unordered(F.sum), lambda a, b: F.when(b.isNull(), a).otherwise(F.coalesce(a, F.lit(0)) + b))]
    for value, how, slow in [*pairs, ("val", "deep", "deep"), ("val", "top_level", "top_level")]:
        got = overlay.fold(log, [value], how)
        assert "collect_list" not in got._jdf.queryExecution().toString()
        assert sorted(map(repr, got.collect())) == sorted(map(repr, overlay.ordered_fold(segs, log, value, slow).collect()))
        hot = log.filter("plen = 0").limit(1).join(spark.range(50)).select("id", "lo", "plen", "v", "val").withColumnRenamed("id", "seq")
        assert overlay.fold(hot, [value], how).count() <= 1


@pytest.mark.parametrize("name", ["i6_range_pure_function", "i3_overlay_custom", "i3_overlay_deep_merge", "i3_overlay_toplevel_merge"])
def test_queries_do_not_gather_all_covering_inserts(spark, name):
    from cidrloom import queries

    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # one row of a prefix meets a segment: the log's side of the join is an aggregate by prefix
    assert "collect_list" not in plan and "Aggregate [plen" in plan and "Window [max(" not in plan


def test_audits(spark):
    records = spark.createDataFrame([(0, 1, "a"), (1 << 31, 2, "b"), (3 << 30, 2, "b")], "lo long, plen int, v string")
    assert {r.check: r.n for r in audit.violations(records, "v").collect()} == {"misaligned": 0, "overlap": 0, "mergeable": 1, "uncovered": 0}
    part = records.filter("v = 'b' and lo = 2147483648")
    assert {r.check: r.n for r in audit.violations(part, "v").collect()}["uncovered"] == 2
    values = audit.dictionary(records, "v").select("value_key", F.when(F.col("v") == "b", 5).otherwise(F.col("refs")).alias("refs"))
    keyed = records.select(F.sha2("v", 256).alias("value_key")).unionByName(spark.createDataFrame([("x",)], "value_key string"))
    assert {r.check: r.n for r in audit.reference_audit(keyed, values).collect()} == {"orphan": 1, "unused": 0, "miscounted": 1}
