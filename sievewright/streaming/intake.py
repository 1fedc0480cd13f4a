"""A streaming front end of the frontier: URL lines in, new frontier rows out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.functions import urls as U
from sievewright.operators import frontier
from sievewright.sources.lines import parse_lines


def read_line_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.text(folder).withColumnRenamed("value", "line")


def canonical_stream(lines: DataFrame, rules: U.UrlRules = U.UrlRules()) -> DataFrame:
    """Parsed lines with their canonical URL, rejected ones left out; stateless."""
    p = parse_lines(lines).where("reject_reason IS NULL").withColumn("_n", U.canonical(F.col("url_raw"), rules))
    p = p.select("*", F.col("_n.url_norm").alias("url_norm")).drop("_n", "reject_reason").where("url_norm IS NOT NULL")
    host = U.host_of(F.col("url_norm"))
    return p.withColumns({"host": host, "domain": U.registered_domain(host), "skip_reason": U.prefilter(F.col("url_norm"), rules)})


def run_intake(lines: DataFrame, store: frontier.StateStore, checkpoint: str, compact_every: int = 50):
    """Each micro-batch appends the URLs that the state does not have, and nothing else is written; every
    ``compact_every`` batches the appended files become one.  Restarts repeat at most a batch, and appending
    is idempotent, as what is there is left out."""

    def batch(df: DataFrame, epoch: int) -> None:
        new = frontier.first_wins(df.withColumn("_o", F.monotonically_increasing_id()), "url_norm", "_o").drop("_o")
        new = new.withColumns({"status": F.when(F.col("skip_reason").isNotNull(), "skipped_filter").otherwise("pending"), "attempts": F.lit(0)})
        have = store.read("urls")
        store.append("urls", new if have is None else new.join(have.select("url_norm"), "url_norm", "left_anti"))
        if epoch % compact_every == compact_every - 1:
            store.compact("urls")

    return canonical_stream(lines).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str, key: str, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Events per window and key; events later than the watermark are left out by the stream."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), key, "n")
