"""Output records, error records and the evaluation aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright import __version__
from sievewright.operators.taxonomy import PATHS

SCHEMA_VERSION, EXTRACTOR_VERSION = "1.0", "2"
#: The language block of a record, from columns of these names.
LANGUAGE = {"lang_value": "string", "lang_region": "string", "lang_confidence": "double", "lang_method": "string", "lang_html_lang": "string", "lang_agreement": "boolean", "lang_multilingual": "boolean"}


def build_record(c: dict[str, Column], flags: dict[str, Column]) -> Column:
    """The nested record of a page from named expressions; missing names are null.  A null site type
    is written as unknown; redirects is the length of the chain; has_rss says whether there are feeds."""
    g = lambda n, t="string": c.get(n, F.lit(None).cast(t)).alias(n)
    strings = lambda n: F.coalesce(c.get(n, F.lit(None).cast("array<string>")), F.array().cast("array<string>"))
    return F.struct(
        F.lit(SCHEMA_VERSION).alias("schema_version"), g("url"), g("url_final"), g("domain"), g("scope"),
        F.date_format(c.get("fetched_at", F.lit(None).cast("timestamp")), "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("fetched_at"),
        F.struct(g("status", "int"), F.size(strings("redirect_chain")).alias("redirects"), g("content_type")).alias("http"),
        F.struct(*[v.alias(k) for k, v in sorted(flags.items())]).alias("flags"),
        F.struct(*[g(n, t).alias(n.removeprefix("lang_")) for n, t in LANGUAGE.items()]).alias("language"),
        F.struct(
            F.coalesce(c.get("site_type", F.lit(None)), F.lit("unknown")).alias("site_type"), g("site_type_confidence", "double"), F.coalesce(c.get("topics", F.lit(None).cast(PATHS)), F.array().cast(PATHS)).alias("topics"),
            g("audience_geo"), g("method"), g("evidence"), g("uncertain_because"),
        ).alias("site"),
        F.struct(g("cms"), g("ecommerce_platform"), (F.size(strings("feeds")) > 0).alias("has_rss"), strings("jsonld_types").alias("jsonld_types"), strings("ad_networks").alias("ad_networks"), g("charset"), g("boilerplate_ratio", "double")).alias("signals"),
        F.struct(F.lit(__version__).alias("engine_version"), F.lit(EXTRACTOR_VERSION).alias("extractor_version"), g("taxonomy_version"), g("model_id"), g("prompt_sha256"), g("tokens_in", "int"), g("tokens_out", "int"), g("content_sha256")).alias("provenance"),
    )


def build_error_record(url: Column, code: Column, status: Column) -> Column:
    """The reduced record of a failed fetch: method blocked, the code as evidence, two flags by code."""
    return F.struct(
        F.lit(SCHEMA_VERSION).alias("schema_version"), url.alias("url"), status.alias("status"), F.lit("blocked").alias("method"), F.lit("unknown").alias("site_type"),
        code.alias("evidence"), (code == "E_ROBOTS_BLOCK").alias("blocked_robots"), (code == "E_NONHTML").alias("non_html"),
    )


def write_jsonl(df: DataFrame, path: str) -> None:
    """Append records as JSON lines; readers take the latest per URL."""
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def accuracy(rows: DataFrame, expected: str, got: str) -> DataFrame:
    """One row: total, correct, accuracy to 4 digits (0 when empty)."""
    ok = F.coalesce(F.col(expected) == F.col(got), F.lit(False))
    a = rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("correct"))
    return a.select("total", "correct", F.when(F.col("total") > 0, F.round(F.col("correct") / F.col("total"), 4)).otherwise(F.lit(0.0)).alias("accuracy"))


def topic_accuracy(rows: DataFrame, expected: str, topics: str) -> DataFrame:
    """One row: labelled, correct, accuracy to 4 digits over the labelled rows, null if there are none.
    ``topics`` holds the ids that were given; a row is right when the expected one is among them."""
    labelled = F.coalesce(F.col(expected), F.lit("")) != ""
    hit = labelled & F.coalesce(F.array_contains(topics, F.col(expected)), F.lit(False))
    a = rows.agg(F.count_if(labelled).alias("labelled"), F.count_if(hit).alias("correct"))
    return a.select("labelled", "correct", F.when(F.col("labelled") > 0, F.round(F.col("correct") / F.col("labelled"), 4)).alias("accuracy"))


def by_method(rows: DataFrame, expected: str, got: str) -> DataFrame:
    ok = F.coalesce(F.col(expected) == F.col(got), F.lit(False))
    return rows.groupBy("method").agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("correct"))


def mismatches(rows: DataFrame, key: str, expected: str, got: str) -> DataFrame:
    ok = F.coalesce(F.col(expected) == F.col(got), F.lit(False))
    return rows.where(~ok).select(key, F.format_string("expected %s, got %s", F.col(expected), F.coalesce(F.col(got), F.lit("unknown"))).alias("mismatch"))
