"""The frontier as relational operators over parquet state.

Keys are unique per canonical URL; every write is a new version of the table and a pointer to it is created
last, so a run that dies leaves the old state whole.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sievewright.functions import urls as U
from sievewright.session import hadoop_path

#: Columns that a keyed update may set, and statuses.
SETTABLE = {"status", "attempts", "next_attempt_at", "last_error_code", "last_error_msg", "http_status", "content_sha256", "skip_reason", "fetched_at", "extracted_at", "classified_at"}
STATUSES = ["pending", "fetching", "fetched", "failed_fetch", "dead", "blocked_robots", "blocked_robots_unavailable", "skipped_filter", "skipped_nonhtml", "skipped_too_large", "extracted", "classified", "needs_human", "done"]


def _ordered(df: DataFrame, cols: list[str]) -> list[Column]:
    """The columns that can be compared, which settle ties the same way every time."""
    kinds = dict(df.dtypes)
    return [F.col(c) for c in cols if "map<" not in kinds[c] and kinds[c] != "variant"]


def first_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the least ``order``, ties by the other columns.  An aggregate, not a window: partial minima are taken
    before the shuffle, so a key with a third of all rows moves as one row per task."""
    rest = [c for c in df.columns if c != key]
    least = F.min_by(F.struct(*rest), F.struct(F.col(order), *_ordered(df, rest))).alias("_r")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(least).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per key, the greatest by ``order``, ties by the other columns: the upsert rule of append-only tables."""
    rest = [c for c in df.columns if c != key]
    last = F.max_by(F.struct(*rest), F.struct(*[F.col(o) for o in order], *_ordered(df, rest))).alias("_r")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(last).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def admit(lines: DataFrame, rules: U.UrlRules = U.UrlRules(), order: str = "line_no") -> DataFrame:
    """Lines (url_raw, scope, tags, order) as frontier rows: canonical URL, host, domain, status by the
    prefilter; rejected lines are left out, the first line of a URL wins."""
    n = lines.withColumn("_n", U.canonical(F.col("url_raw"), rules)).where(F.col("_n.url_norm").isNotNull())
    n = n.withColumn("url_norm", F.col("_n.url_norm")).drop("_n")
    reason = U.prefilter(F.col("url_norm"), rules)
    host = U.host_of(F.col("url_norm"))
    n = n.withColumns({"host": host, "domain": U.registered_domain(host), "skip_reason": reason})
    n = n.withColumns({"status": F.when(F.col("skip_reason").isNotNull(), "skipped_filter").otherwise("pending"), "attempts": F.lit(0)})
    return first_wins(n, "url_norm", order)


def insert_absent(state: DataFrame, new: DataFrame, key: str = "url_norm") -> DataFrame:
    """State and the new rows whose key it does not have."""
    return state.unionByName(new.join(state.select(key), key, "left_anti"), allowMissingColumns=True)


def set_columns(state: DataFrame, updates: DataFrame, key: str = "url_norm") -> DataFrame:
    """Keyed update: columns of ``updates`` replace those of matching rows (nulls too); unknown columns
    are refused."""
    cols = [c for c in updates.columns if c != key]
    unknown = set(cols) - SETTABLE
    if unknown:
        raise ValueError(f"columns that cannot be set: {sorted(unknown)}")
    u = updates.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_u_{c}") for c in cols])
    j = state.join(u, key, "left")
    return j.select(*[F.when(F.col("_hit"), F.col(f"_u_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c) for c in state.columns])


def bump_attempts(state: DataFrame, touched: DataFrame, key: str = "url_norm") -> DataFrame:
    t = touched.select(key, F.lit(1).alias("_one")).distinct()
    return state.join(t, key, "left").withColumn("attempts", F.col("attempts") + F.coalesce("_one", F.lit(0))).drop("_one")


def requeue_stuck(state: DataFrame) -> DataFrame:
    """Rows left in fetching by a crash go back to pending."""
    return state.withColumn("status", F.when(F.col("status") == "fetching", "pending").otherwise(F.col("status")))


def stuck(state: DataFrame) -> DataFrame:
    """What requeue_stuck() puts back."""
    return state.where(F.col("status") == "fetching")


def requeue(state: DataFrame, status: str) -> DataFrame:
    """Rows of a status go back to pending: attempts zeroed, error code and next attempt cleared."""
    if status not in STATUSES:
        raise ValueError(f"no such status: {status}")
    hit = F.col("status") == status
    clear: dict[str, Column] = {c: F.when(~hit, F.col(c)) for c in ("last_error_code", "next_attempt_at")}
    return state.withColumns({**clear, "attempts": F.when(hit, 0).otherwise(F.col("attempts")), "status": F.when(hit, "pending").otherwise(F.col("status"))})


def get(state: DataFrame, key_value: str, key: str = "url_norm") -> DataFrame:
    """The row of one key: the filter reaches the scan, whose files are sorted by host and key."""
    return state.where(F.col(key) == key_value)


def reclassifiable(state: DataFrame, evidence: DataFrame, key: str = "url_norm") -> DataFrame:
    """Evidence of URLs that the state knows."""
    return evidence.join(state.select(key), key, "left_semi")


def pending(state: DataFrame, limit: int | None = None, *ties: str) -> DataFrame:
    """Pending rows by host; a limit takes the first by (host, url_norm) and the columns that settle ties."""
    p = state.where(F.col("status") == "pending").orderBy("host", "url_norm", *ties)
    return p.limit(limit) if limit is not None else p


def upsert(state: DataFrame, new: DataFrame, key: str = "url_norm") -> DataFrame:
    """Replace by key: the new row stands for the old one."""
    return state.join(new.select(key), key, "left_anti").unionByName(new)


def counts_by_status(state: DataFrame) -> DataFrame:
    return state.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def run_counters(state: DataFrame) -> DataFrame:
    """One row: totals that a run reports."""
    c = lambda cond, name: F.count_if(cond).alias(name)
    s = F.col("status")
    return state.agg(
        F.count(F.lit(1)).alias("added"), c(s == "classified", "classified"), c(s == "needs_human", "needs_human"),
        c(s.isin("failed_fetch", "blocked_robots", "skipped_nonhtml", "skipped_too_large"), "errors"), c(s == "skipped_filter", "skipped"),
    )


def first_seen(state: DataFrame) -> DataFrame:
    """domains: first sighting of each domain."""
    return state.where(F.col("domain").isNotNull()).groupBy("domain").agg(F.min("seen_at").alias("first_seen_at"))


class StateConflict(RuntimeError):
    """Another writer changed a table that this one read before."""


class StateStore:
    """Versioned parquet tables under one folder of any Hadoop file system.

    A state is a numbered pointer file that names the current version of each table.  Pointers are only
    ever created, never replaced, and creating one that exists fails; so of two writers one wins, and the
    other takes the winner's tables over or, where these are the ones it read and wanted to write, gets
    StateConflict.  The frontier is laid out by status, each file sorted by host and key, so that a scan of
    pending rows reads nothing else.
    """

    SCHEMA_VERSION = "2"
    KEPT = 3  # older states that stay readable for scans under way

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.fs, self.path = hadoop_path(spark, self.root)
        self.fs.mkdirs(self.path)
        self.seen: dict[str, list[str]] = {}

    def _p(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self.path, name)

    def _numbers(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in (f.getPath().getName() for f in self.fs.listStatus(self.path)) if n.startswith("v") and n.endswith(".json"))

    def _state(self, number: int) -> dict:
        f = self.fs.open(self._p(f"v{number}.json"))
        try:
            now = json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(f)).decode())
        finally:
            f.close()
        if now["schema_version"] != self.SCHEMA_VERSION:
            raise ValueError(f"state of version {now['schema_version']}, this is {self.SCHEMA_VERSION}")
        return now

    def _current(self) -> tuple[int, dict]:
        numbers = self._numbers()
        return (numbers[-1], self._state(numbers[-1])) if numbers else (0, {"schema_version": self.SCHEMA_VERSION, "tables": {}})

    def _create(self, number: int, state: dict) -> bool:
        """Create a pointer; False where there is one of this number already."""
        try:
            out = self.fs.create(self._p(f"v{number}.json"), False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception) or "already exists" in str(e.java_exception):
                return False
            raise
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        return True

    def _files(self, name: str, df: DataFrame) -> str:
        """Write a version's files; returns its folder."""
        version = f"{name}-{uuid.uuid4().hex}"
        if "status" in df.columns and "url_norm" in df.columns:
            order = [c for c in ("status", "host", "url_norm") if c in df.columns]
            df.withColumn("_status", F.col("status")).sortWithinPartitions(*order).write.partitionBy("_status").option("compression", "zstd").parquet(f"{self.root}/{version}")
        else:
            df.write.option("compression", "zstd").parquet(f"{self.root}/{version}")
        return version

    def append(self, name: str, rows: DataFrame) -> None:
        """Rows that the table does not have, as files beside its own: nothing is written again.  compact()
        makes one version of them."""
        have = self._current()[1]["tables"].get(name)
        if have is None:
            self.write(**{name: rows})
            return
        schema = StructType.fromJson(json.loads(have["schema"]))
        fitted = rows.select(*[F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
        delta = self._files(name, fitted)
        while True:
            number, now = self._current()
            t = now["tables"][name]
            if self._create(number + 1, {**now, "tables": {**now["tables"], name: {**t, "deltas": [*t.get("deltas", []), delta]}}}):
                break
        self._clean()

    def compact(self, name: str) -> None:
        """The table and what was appended to it as one version."""
        t = self._current()[1]["tables"].get(name)
        if t and t.get("deltas"):
            self.write(**{name: self.read(name)})

    @staticmethod
    def _folders(t: dict) -> list[str]:
        return [t["version"], *t.get("deltas", [])]

    def write(self, **tables: DataFrame) -> None:
        """New versions of the named tables become current together."""
        new = {name: {"version": self._files(name, df), "schema": df.schema.json()} for name, df in tables.items()}
        while True:
            number, now = self._current()
            changed = [n for n in new if n in self.seen and n in now["tables"] and self._folders(now["tables"][n]) != self.seen[n]]
            if changed:
                raise StateConflict(f"changed meanwhile: {sorted(changed)}")
            if self._create(number + 1, {**now, "tables": {**now["tables"], **new}}):
                break
        self.seen.update({n: self._folders(v) for n, v in new.items()})
        self._clean()

    def _clean(self) -> None:
        """Drop pointers but the newest ones, and table versions that no pointer names and that are older."""
        numbers = self._numbers()
        if len(numbers) <= self.KEPT:
            return
        named = {f for n in numbers[-self.KEPT :] for t in self._state(n)["tables"].values() for f in self._folders(t)}
        for n in numbers[: -self.KEPT]:
            for f in {f for t in self._state(n)["tables"].values() for f in self._folders(t)} - named:
                self.fs.delete(self._p(f), True)
            self.fs.delete(self._p(f"v{n}.json"), False)

    def read(self, name: str, status: str | None = None) -> DataFrame | None:
        """The current version of a table; with ``status`` only the files of this status."""
        t = self._current()[1]["tables"].get(name)
        if t is None:
            return None
        self.seen[name] = self._folders(t)
        schema = StructType.fromJson(json.loads(t["schema"]))
        own = schema if status is None else StructType([*schema.fields, StructField("_status", StringType())])
        out = None
        for folder in self._folders(t):  # each a root of its own, as it is laid out by status
            df = self.spark.read.schema(own).parquet(f"{self.root}/{folder}")
            df = (df if status is None else df.where(F.col("_status") == status)).select(*schema.names)
            out = df if out is None else out.unionByName(df)
        return out
