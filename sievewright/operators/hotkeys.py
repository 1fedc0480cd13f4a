"""Per-key results for keys that hold most of the rows (problem 3).

Value-frequency compression: rows are first grouped by (key, value) - partial aggregation runs
map-side, and the shuffle key is as fine as the pairs, so no key makes a long task.  Everything
asked per key is then derived from the weighted values: row counts are sums of weights, exact
distinct counts are counts of pairs, modes and percentiles come from the weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values are cut into buckets of 2**BUCKET_BITS for percentiles; with 32-bit values a key has at
#: most 2**16 buckets and a bucket at most 2**16 values, so both windows are bounded.
BUCKET_BITS = 16


def clean_key(c: Column) -> Column:
    """Lower case, outer blanks and final dots removed; an empty rest is null (no value)."""
    k = F.regexp_replace(F.lower(F.trim(c)), r"\.+$", "")
    return F.when(k != "", k)


def stacked_keys(df: DataFrame, fields: list[str], keep: list[Column]) -> DataFrame:
    """One row per (row, key field) with columns key_field, key_value and ``keep``.

    Null keys stay as null ``key_value``; callers that report values filter them.
    """
    pairs = F.array(*[F.struct(F.lit(f).alias("f"), clean_key(F.col(f)).alias("v")) for f in fields])
    return df.select(F.explode(pairs).alias("_k"), *keep).select("_k.f", "_k.v", *[F.col(_name(df, c)) for c in keep]).toDF(
        "key_field", "key_value", *[_name(df, c) for c in keep]
    )


def _name(df: DataFrame, c: Column) -> str:
    return df.select(c).columns[0]


def frequencies(df: DataFrame, keys: list[str], value: str, weight: str = "weight") -> DataFrame:
    """(keys, value) with the number of rows that carry the pair."""
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias(weight))


def weighted_mode(freq: DataFrame, keys: list[str], value: str, weight: str = "weight") -> DataFrame:
    """The most frequent non-null value of each key; ties go to the least value.  max_by-style
    aggregation keeps one row per key and map task, so hot keys cost nothing extra."""
    best = F.min(F.struct((-F.col(weight)).alias("w"), F.col(value).alias("v"))).alias("_b")
    return freq.where(F.col(value).isNotNull()).groupBy(*keys).agg(best).select(
        *keys, F.col("_b.v").alias("mode"), (-F.col("_b.w")).alias("mode_rows")
    )


def weighted_percentile(freq: DataFrame, keys: list[str], value: str, q: float, weight: str = "weight") -> DataFrame:
    """Exact lower percentile of an integer ``value`` per key (nearest rank, nulls left out).

    Two bounded steps instead of a sort of the whole key: weights per bucket of 2**16 values give
    the bucket that holds the rank, then only this bucket's values are ordered.
    """
    f = freq.where(F.col(value).isNotNull()).withColumn("_b", F.floor(F.col(value) / F.lit(1 << BUCKET_BITS)))
    per = f.groupBy(*keys, "_b").agg(F.sum(weight).alias("_n"))
    by = Window.partitionBy(*keys)
    run = by.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    hit = (
        per.withColumn("_cum", F.sum("_n").over(run))
        .withColumn("_rank", F.greatest(F.lit(1), F.ceil(F.sum("_n").over(by) * F.lit(q))))
        .where((F.col("_cum") >= F.col("_rank")) & (F.col("_cum") - F.col("_n") < F.col("_rank")))
        .select(*keys, "_b", (F.col("_rank") - (F.col("_cum") - F.col("_n"))).alias("_need"))
    )
    inner = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    on = [F.col(f"f.{k}").eqNullSafe(F.col(f"h.{k}")) for k in [*keys, "_b"]]
    return (
        f.alias("f")
        .join(hit.alias("h"), on)
        .select(*[F.col(f"f.{k}") for k in keys], F.col(f"f.{value}"), F.col(f"f.{weight}"), "_need")
        .withColumn("_c", F.sum(weight).over(inner))
        .where((F.col("_c") >= F.col("_need")) & (F.col("_c") - F.col(weight) < F.col("_need")))
        .select(*keys, F.col(value).alias("percentile"))
    )


def url_pairs(urls: DataFrame) -> DataFrame:
    """(key_field, key_value, url_norm) with the number of lines, for domain and host."""
    rows = stacked_keys(urls, ["domain", "host"], [F.col("url_norm")])
    return frequencies(rows, ["key_field", "key_value"], "url_norm")


def key_stats(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """For every domain and host: rows, distinct url_norm, pages and the sum of body_text_len.

    Result: key_field, key_value, n_rows, n_urls, n_pages, sum_len - one row per non-null key.
    A page belongs to every key under which its url_norm is listed, once, however often the line
    repeats; pages are rows of ``pages``.  Null url_norm counts as a row, not as a url; a null
    body_text_len adds 0; empty tables give no rows; other columns of either table are ignored.
    """
    per_url = pages.where(F.col("url_norm").isNotNull()).groupBy("url_norm").agg(
        F.count(F.lit(1)).alias("_pages"), F.sum(F.coalesce(F.col("body_text_len").cast("long"), F.lit(0))).alias("_len")
    )
    pairs = url_pairs(urls).where(F.col("key_value").isNotNull())
    # pairs without a url meet no page; in the join they would all go to one task
    known = pairs.where(F.col("url_norm").isNotNull()).join(per_url, "url_norm", "left")
    return (
        known.unionByName(pairs.where(F.col("url_norm").isNull()), allowMissingColumns=True)
        .groupBy("key_field", "key_value")
        .agg(
            F.sum("weight").alias("n_rows"),
            F.count("url_norm").alias("n_urls"),
            F.coalesce(F.sum("_pages"), F.lit(0)).alias("n_pages"),
            F.coalesce(F.sum("_len"), F.lit(0)).alias("sum_len"),
        )
    )


def heavy_keys(urls: DataFrame, share: float = 0.01) -> DataFrame:
    """Keys that hold more than ``share`` of all rows: key_field, key_value.

    Rows with a null key count in the total.  The total is one number from the file footers.
    """
    total = urls.count()
    per_key = url_pairs(urls).where(F.col("key_value").isNotNull()).groupBy("key_field", "key_value").agg(F.sum("weight").alias("n"))
    return per_key.where(F.col("n") > F.lit(share * total)).select("key_field", "key_value")


def key_profile(urls: DataFrame) -> DataFrame:
    """Modes and percentiles per key from weighted values: the commonest status and the median and
    90th percentile of attempts.  Result: key_field, key_value, mode_status, mode_rows, p50_attempts,
    p90_attempts; keys without any non-null value have nulls."""
    keys = ["key_field", "key_value"]
    rows = stacked_keys(urls, ["domain", "host"], [F.col("status"), F.col("attempts")]).where(F.col("key_value").isNotNull())
    st = weighted_mode(frequencies(rows, keys, "status"), keys, "status")
    fa = frequencies(rows, keys, "attempts")
    p50 = weighted_percentile(fa, keys, "attempts", 0.5).withColumnRenamed("percentile", "p50_attempts")
    p90 = weighted_percentile(fa, keys, "attempts", 0.9).withColumnRenamed("percentile", "p90_attempts")
    base = fa.groupBy(*keys).agg(F.sum("weight").alias("n_rows"))
    return (
        base.join(st, keys, "left").join(p50, keys, "left").join(p90, keys, "left")
        .select(*keys, "n_rows", F.col("mode").alias("mode_status"), "mode_rows", "p50_attempts", "p90_attempts")
    )
