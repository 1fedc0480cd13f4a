"""Input lists: plain URLs or JSON lines, comments and blanks dropped."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCOPES = ["auto", "site", "page", "both"]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line) of a text file or folder; - reads standard input, which the driver has at hand."""
    if path == "-":
        return spark.createDataFrame([(x.rstrip("\n"),) for x in sys.stdin], "line string")
    return spark.read.text(path).withColumnRenamed("value", "line")


def parse_lines(lines: DataFrame, default_scope: str = "auto") -> DataFrame:
    """url_raw, scope, tags and reject_reason of each line that names something.

    A JSON object needs ``url``; its tags become strings.  Broken JSON and objects without a url are
    dropped, as comments and blanks are; an unknown scope is rejected with a reason, not an error.
    """
    s = F.trim(F.col("line"))
    kept = lines.select(*[c for c in lines.columns if c != "line"], s.alias("_s")).where((F.col("_s") != "") & ~F.col("_s").startswith("#"))
    obj = F.col("_s").startswith("{")
    parsed = F.when(obj, F.from_json("_s", "url string, scope string, tags array<string>"))
    kept = kept.withColumn("_j", parsed).where(~obj | F.col("_j.url").isNotNull())
    scope = F.when(obj, F.coalesce(F.col("_j.scope"), F.lit(default_scope))).otherwise(F.lit(default_scope))
    good = scope.isin(SCOPES)
    return kept.withColumns({
        "url_raw": F.when(obj, F.col("_j.url")).otherwise(F.col("_s")),
        "tags": F.coalesce(F.col("_j.tags"), F.array().cast("array<string>")),
        "scope": F.when(good, scope),
        "reject_reason": F.when(~good, F.lit("bad_scope")),
    }).drop("_s", "_j")


GOLDEN = "name string, url string, fixture string, expected_site_type string, expected_topic_tier1 string"


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """The golden set: JSON lines; blank lines and lines without a name are left out."""
    return spark.read.schema(GOLDEN).json(path).where("name IS NOT NULL")


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(fixture, content) of the page files of a folder: a source of pages without a network."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.htm*").load(folder)
    return f.select(F.element_at(F.split("path", "/"), -1).alias("fixture"), "content")
