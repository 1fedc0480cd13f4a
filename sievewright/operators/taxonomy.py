"""Topic taxonomies: loading, checks, closure and paths."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.session import broadcast_if_small

SCHEMA = "id string, name string, tier int, parent string, aliases array<string>, hints string"


#: The bundled taxonomy: first-tier name, then its children.
DEFAULT_VERSION = "sievewright-1"
DEFAULT = """News and politics: elections, world affairs, opinion
Business: companies, jobs, real estate, start-ups
Money: banking, investing, insurance, taxes
Law and government: courts, public administration, civil rights
Science: physics, biology, chemistry, space, mathematics
Health: medicine, nutrition, mental health, fitness
Software: programming, security, data, operating systems
Electronics: phones, computers, audio, photography
Sport: football, athletics, winter sports, motor racing
Arts: painting, theatre, literature, architecture
Music: classical music, pop and rock, instruments
Film and television: cinema, series, streaming
Games: video games, board games, gambling
Food: recipes, restaurants, drinks
Travel: destinations, hotels, railways, flights
Home: furniture, do-it-yourself, gardening
Farming and nature: crops, livestock, forestry, environment
Vehicles: cars, motorcycles, bicycles
Education: schools, universities, languages
Society: family, religion, history, relationships
Fashion: clothing, beauty, jewellery
Shopping: offers, second hand, catalogues
Adult: adult content
Other: unsorted"""


def default_nodes() -> list[tuple]:
    """The bundled nodes; an id is the name's words, a child's id its parent's and its own."""
    slug = lambda s: "-".join(w for w in s.lower().replace(",", " ").split() if w != "and")
    rows = []
    for line in DEFAULT.splitlines():
        name, _, children = line.partition(":")
        rows.append((slug(name), name, 1, None, [], None))
        rows += [(f"{slug(name)}.{slug(c)}", c.strip().capitalize(), 2, slug(name), [], None) for c in children.split(",")]
    return rows


def load(spark: SparkSession, path: str | None = None) -> DataFrame:
    """A taxonomy file (YAML or JSON with ``nodes``), or the bundled one, as a table, checked."""
    if not path:
        return spark.createDataFrame(default_nodes(), SCHEMA)
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        import yaml

        raw = yaml.safe_load(text)
    except ImportError:
        import json

        raw = json.loads(text)
    if not isinstance(raw, dict) or not isinstance(raw.get("nodes"), list):
        raise ValueError("a taxonomy needs a list of nodes")
    rows = [(n["id"], n["name"], int(n["tier"]), n.get("parent"), [str(a) for a in n.get("aliases") or []], str(n["hints"]) if n.get("hints") else None) for n in raw["nodes"]]
    df = spark.createDataFrame(rows, SCHEMA)
    bad = [r.problem for r in problems(df).collect()]
    if bad:
        raise ValueError("; ".join(sorted(bad)))
    return df


def problems(t: DataFrame) -> DataFrame:
    """(problem) for duplicate ids, unknown parents, parents of the wrong tier and cycles."""
    dup = t.groupBy("id").count().where("count > 1").select(F.format_string("duplicate id %s", "id").alias("problem"))
    p = t.select(F.col("id").alias("_pid"), F.col("tier").alias("_pt")).dropDuplicates(["_pid"])
    j = t.where("parent IS NOT NULL").join(p, F.col("parent") == F.col("_pid"), "left")
    lost = j.where("_pid IS NULL").select(F.format_string("unknown parent %s of %s", "parent", "id").alias("problem"))
    off = j.where("_pid IS NOT NULL AND _pt <> tier - 1").select(F.format_string("parent %s of %s is not one tier up", "parent", "id").alias("problem"))
    loop = cycles(t).select(F.format_string("%s is its own ancestor", "id").alias("problem"))
    return dup.unionByName(lost).unionByName(off).unionByName(loop)


def closure(t: DataFrame) -> DataFrame:
    """(id, ancestor, distance), every node its own ancestor at distance 0, however deep the tree.

    A node on a cycle of parents meets its own ancestors once each: a walk ends where it comes back to
    a node that it has seen, so a broken taxonomy ends too (cycles() names its nodes)."""
    view = f"_taxonomy_{uuid.uuid4().hex}"
    t.select("id", "parent").dropDuplicates(["id"]).createOrReplaceTempView(view)
    up = t.sparkSession.sql(f"""
WITH RECURSIVE up AS (
  SELECT id, id AS ancestor, 0 AS distance, array(id) AS seen FROM {view}
  UNION ALL
  SELECT u.id, p.parent AS ancestor, u.distance + 1, array_append(u.seen, p.parent) FROM up u JOIN {view} p ON p.id = u.ancestor
  WHERE p.parent IS NOT NULL AND NOT array_contains(u.seen, p.parent)
) SELECT id, ancestor, distance FROM up""")
    t.sparkSession.catalog.dropTempView(view)
    return up


def cycles(t: DataFrame) -> DataFrame:
    """(id) of nodes that are their own ancestors."""
    edge = t.where("parent IS NOT NULL").select(F.col("parent").alias("id"), F.col("id").alias("ancestor"))
    return closure(t).join(edge, ["id", "ancestor"]).select(F.col("ancestor").alias("id")).distinct()


def node(t: DataFrame, id_: str) -> DataFrame:
    """The node of an id, no row where there is none."""
    return t.where(F.col("id") == id_)


def first_tier(t: DataFrame) -> DataFrame:
    return t.where(F.col("tier") == 1)


def children(t: DataFrame, parent: str) -> DataFrame:
    return t.where(F.col("parent") == parent)


def paths(t: DataFrame, max_tier: int | None = None) -> DataFrame:
    """(id, path, line): names from the root, and the line a prompt shows."""
    names = t.select(F.col("id").alias("ancestor"), F.col("name").alias("_name"))
    up = closure(t).join(broadcast_if_small(names), "ancestor")
    steps = F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), F.col("_name").alias("n"))))  # as many as tiers
    p = up.groupBy("id").agg(F.array_join(F.transform(steps, lambda s: s["n"]), " > ").alias("path"))
    out = t.join(p, "id")
    if max_tier is not None:
        out = out.where(F.col("tier") <= max_tier)
    hint = F.when(F.col("hints").isNotNull() & (F.col("hints") != ""), F.concat(F.lit("  (hints: "), "hints", F.lit(")"))).otherwise("")
    return out.select("id", "path", F.concat("id", F.lit(" | "), "path", hint).alias("line"))


def validate_topics(verdicts: DataFrame, t: DataFrame, key: str, most: int = 3) -> DataFrame:
    """(key, rank, tier1_id, tier1_name, tier2_id, tier2_name, confidence) of proposed topics.

    Unknown first tiers are dropped, second tiers kept only below their first, repeats dropped, the
    first ``most`` kept, confidences clamped.  The taxonomy is a small fixed table and is broadcast.
    """
    one = first_tier(t).select(F.col("id").alias("t1"), F.col("name").alias("n1"))
    below = closure(t).where("distance > 0").join(t.select("id", F.col("name").alias("n2")), "id").select(F.col("id").alias("t2"), F.col("ancestor").alias("a2"), "n2")
    x = verdicts.select(key, F.posexplode("topics").alias("pos", "x")).select(key, "pos", F.col("x.tier1_id").alias("t1"), F.col("x.tier2_id").alias("t2"), F.col("x.confidence").alias("c"))
    x = x.join(broadcast_if_small(one), "t1")
    b = broadcast_if_small(below.withColumnRenamed("t2", "b2"))
    x = x.join(b, (F.col("t2") == F.col("b2")) & (F.col("t1") == F.col("a2")), "left")
    item = F.struct("pos", "t1", "n1", F.col("b2").alias("t2"), "n2", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("c"))).alias("c"))
    kept = x.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("ts"))  # topics of one verdict
    seen = F.transform("ts", lambda v: F.concat_ws("|", v["t1"], F.coalesce(v["t2"], F.lit(""))))
    uniq = F.filter(F.col("ts"), lambda v, i: F.array_position(F.col("seen"), F.concat_ws("|", v["t1"], F.coalesce(v["t2"], F.lit("")))) == i + 1)
    kept = kept.withColumn("seen", seen).select(key, F.posexplode(F.slice(uniq, 1, most)).alias("rank", "v"))
    return kept.select(key, "rank", F.col("v.t1").alias("tier1_id"), F.col("v.n1").alias("tier1_name"), F.col("v.t2").alias("tier2_id"), F.col("v.n2").alias("tier2_name"), F.col("v.c").alias("confidence"))


#: The topics of a record.
PATHS = "array<struct<tier1_id:string,tier1_name:string,tier2_id:string,tier2_name:string,confidence:double>>"


def with_topics(verdicts: DataFrame, t: DataFrame, key: str) -> DataFrame:
    """Verdicts with their proposed topics replaced by the valid ones, named; none gives an empty list."""
    v = validate_topics(verdicts.where(F.size("topics") > 0), t, key)
    path = F.struct("rank", "tier1_id", "tier1_name", "tier2_id", "tier2_name", "confidence")
    v = v.groupBy(key).agg(F.array_sort(F.collect_list(path)).alias("_v"))  # as many as MOST_TOPICS
    v = v.select(key, F.transform("_v", lambda x: F.struct(*[x[c].alias(c) for c in ("tier1_id", "tier1_name", "tier2_id", "tier2_name", "confidence")])).alias("_t"))
    return verdicts.join(v, key, "left").withColumn("topics", F.coalesce("_t", F.array().cast(PATHS))).drop("_t")
