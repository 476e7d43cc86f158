"""Operator 4: mix sources to target weights by Poisson replication.

A document of source s is repeated Poisson(rate_s) times, where rate_s is the
source's target share of the output over its share of the input. The count
inverts the Poisson distribution at a uniform number hashed from (seed,
doc_id), so it does not depend on partitioning, retries or the other rows.
Copies are then sorted by a second hash, which shuffles them globally.

Scale: one pre-aggregated count by source, a join with the per-source table of
cumulated probabilities (broadcast up to ``MAX_BROADCAST_SOURCES`` sources,
checked; beyond that a join salted over ``SALTS`` values, so that a source with
a third of all rows is spread), and one range-partitioned sort of the copies.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import stash

#: A source's table holds about 60 doubles at usual rates: 5 MB in all.
MAX_BROADCAST_SOURCES = 10_000
SALTS = 64
#: A larger rate is the sum of so many equal ones as keep each within it: tables stay short.
MAX_RATE = 256
#: Copies of a document that one array holds.
RUN = 1 << 16
SEED = "mix-1"


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None, temperature: float, size: float) -> DataFrame:
    """(source, n, rate): the mean number of copies of a document of each source.

    A null source is one of its own; a source without weight, and every source
    if all weights are 0, has rate 0; an empty table has no sources.
    """
    n = docs.groupBy(F.col("source").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weighted = n.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(float(temperature))))
    else:
        named = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))]) if weights else None
        value = F.coalesce(named[F.col("source")], F.lit(0.0)) if named is not None else F.lit(0.0)
        weighted = n.withColumn("w", value)
    total = weighted.agg(F.sum("n").alias("all_n"), F.sum("w").alias("all_w"))  # one row
    return weighted.crossJoin(F.broadcast(total)).select(
        "source",
        "n",
        F.coalesce(F.try_divide(F.col("w") * F.col("all_n") * F.lit(float(size)), F.col("all_w") * F.col("n")), F.lit(0.0)).alias("rate"),
    )


def with_cdf(rates: DataFrame) -> DataFrame:
    """Add cdf: P(count <= 0), P(count <= 1), ... until the tail is below 1e-16, of a ``parts``-th of the rate."""
    rates = rates.withColumn("parts", F.greatest(F.ceil(F.col("rate") / MAX_RATE), F.lit(1)).cast("int"))
    rates = rates.withColumn("rate", F.col("rate") / F.col("parts"))
    return rates.withColumn(
        "cdf",
        F.expr(
            """aggregate(
              sequence(1, cast(ceil(rate + 12 * sqrt(rate) + 30) as int)),
              named_struct('lp', -rate, 'sum', exp(-rate), 'all', array(exp(-rate))),
              (a, k) -> named_struct(
                'lp', a.lp + ln(rate) - ln(cast(k as double)),
                'sum', a.sum + exp(a.lp + ln(rate) - ln(cast(k as double))),
                'all', concat(a.all, array(a.sum + exp(a.lp + ln(rate) - ln(cast(k as double)))))),
              a -> a.all)"""
        ),
    ).withColumn("cdf", F.when(F.col("rate") > 0, F.col("cdf")))


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    temperature: float = 0.5,
    size: float = 1.0,
    seed: str = SEED,
) -> DataFrame:
    """``docs`` resampled to target weights, in a globally shuffled order.

    ``weights`` maps a source to its share of the output (others: none); if
    None, shares are the sources' sizes to the power ``temperature``. ``size``
    is the mean output size as a multiple of the input. Adds ``mix_copy`` (from
    1) and ``mix_key`` (hex, the global order); columns of these names are
    replaced. A null source is a source of its own (never in ``weights``); a
    null doc_id hashes as the text ``null``; repeated rows get equal counts; an
    empty table gives an empty one; texts are carried whatever they hold.
    """
    kept = [c for c in docs.columns if c.lower() not in ("mix_copy", "mix_key")]
    # the caller's columns travel as one, so no name can clash with those used here
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"))
    rates = source_rates(docs.select("row.source"), weights, temperature, size)
    rates = stash(with_cdf(rates), "mix-rates").select("source", "cdf", "parts")
    same = F.col("row.source").eqNullSafe(F.col("source"))
    if rates.limit(MAX_BROADCAST_SOURCES + 1).count() <= MAX_BROADCAST_SOURCES:
        joined = docs.join(F.broadcast(rates), same)
    else:
        salt = F.pmod(F.xxhash64("row.doc_id"), F.lit(SALTS))
        spread = rates.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = docs.withColumn("salt_of", salt).join(spread, same & (F.col("salt_of") == F.col("salt")))
    doc = F.coalesce(F.col("row.doc_id").cast("string"), F.lit("null"))

    def drawn(text: Column) -> Column:
        """Poisson count at the uniform number that ``text`` hashes to."""
        u = (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)
        return F.size(F.filter(F.col("cdf"), lambda c: c < u)).cast("long")

    first = F.concat(F.lit(f"{seed}:"), doc)
    more = F.aggregate(F.sequence(F.lit(1), F.col("parts") - 1), F.lit(0).cast("long"), lambda n, j: n + drawn(F.concat(first, F.lit(":"), j.cast("string"))))
    counted = joined.filter(F.col("cdf").isNotNull()).select("row", doc.alias("doc"), (drawn(first) + F.when(F.col("parts") > 1, more).otherwise(0)).alias("n")).filter("n > 0")
    # in two steps, so that no array holds all copies of a document
    runs = counted.select("row", "doc", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long"))).alias("lo"))
    copies = runs.select("row", "doc", F.explode(F.sequence((F.col("lo") + 1).cast("int"), F.least(F.col("lo") + RUN, F.col("n")).cast("int"))).alias("mix_copy"))
    copies = copies.withColumn("mix_key", F.md5(F.concat(F.lit(f"{seed}#"), "doc", F.lit("#"), F.col("mix_copy").cast("string"))))
    return copies.orderBy("mix_key", "row.doc_id", "mix_copy").select("row.*", "mix_copy", "mix_key")


ORACLE = """
WITH RECURSIVE s AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, 0.5) AS w FROM documents GROUP BY source),
r AS (SELECT source, w * (SELECT sum(n) FROM s) * 1.0::DOUBLE / ((SELECT sum(w) FROM s) * n) AS rate FROM s),
c(source, rate, k, lp, cdf) AS (
  SELECT source, rate, 0, -rate, exp(-rate) FROM r
  UNION ALL
  SELECT source, rate, k + 1, lp + ln(rate) - ln((k + 1)::DOUBLE), cdf + exp(lp + ln(rate) - ln((k + 1)::DOUBLE))
  FROM c WHERE k < ceil(rate + 12 * sqrt(rate) + 30)),
f AS (SELECT source, list(cdf) AS cdf FROM c GROUP BY source),
d AS (
  SELECT d.*, len([x for x in f.cdf if x < (('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / pow(2, 52)]) AS copies
  FROM documents d JOIN f ON d.source IS NOT DISTINCT FROM f.source),
e AS (SELECT d.*, unnest(range(1, copies + 1))::INTEGER AS mix_copy FROM d)
SELECT doc_id, text, lang, source, n_chars, mix_copy,
  md5('mix-1#' || coalesce(doc_id::VARCHAR, 'null') || '#' || mix_copy::VARCHAR) AS mix_key
FROM e
"""
