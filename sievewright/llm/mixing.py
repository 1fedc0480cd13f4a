"""Mixing sources to target weights (problem 8): hierarchical budgeting.

Weights run down a tree of source, language and kind of site; the targets are stated for its first level,
below it the children weigh what they hold.  A node that cannot take its budget - its capacity is its
tokens times the repeats allowed - passes the shortage to its siblings first and to its ancestor's siblings
only then.  A leaf serves its budget by whole epochs and a prefix, in a seeded order, of one epoch more, so
no document is used more than max_repeats times.  A prefix ends before or behind the document in which the
budget ends; which of the two is chosen per leaf so that the source comes closest to its budget.

The prefix is found without sorting a source in one task: documents fall into hash buckets, running
sums are taken over buckets (their number is bounded by ``BUCKET_DOCS``), and only the bucket in which
the budget ends is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.llm import encoding
from sievewright.session import broadcast_if_small, materialise

#: About this many documents share a hash bucket.
BUCKET_DOCS = 20_000
#: A leaf has at most this many buckets.
MAX_BUCKETS = 100_000


def source_name(c: Column) -> Column:
    """One spelling per source: lower case, outer blanks removed, hyphens and blanks as underscores."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s\-]+", "_")


def language_name(c: Column) -> Column:
    """The base of a language code, lower case; whatever is no code is other, so that leaves stay few."""
    base = F.regexp_extract(F.lower(F.trim(c)), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.when(F.coalesce(base, F.lit("")) != "", base).otherwise("other")


def kind_name(c: Column) -> Column:
    """The kind of site, lower case; other without one."""
    k = F.lower(F.trim(c))
    return F.when(F.coalesce(k, F.lit("")) != "", k).otherwise("other")


#: The levels of the tree; the first one is what the targets name.
LEVELS = ("source", "lang", "kind")


class Node:
    """A node of the budget tree: weight among its siblings, capacity, children."""

    def __init__(self, name: tuple, weight: float, capacity: float = 0.0):
        self.name, self.weight, self.own, self.children = name, weight, capacity, []
        self.budget = 0.0

    @property
    def capacity(self) -> float:
        return sum(c.capacity for c in self.children) if self.children else self.own

    def give(self, budget: float) -> float:
        """Take at most ``budget``; returns what was taken.  Children that are full leave their rest to
        their siblings by weight, round by round; what no child can take goes back to the caller."""
        self.budget = min(budget, self.capacity)
        if not self.children:
            return self.budget
        left, open_ = self.budget, [c for c in self.children if c.capacity > 0 and c.weight > 0]
        taken = dict.fromkeys(range(len(open_)), 0.0)
        live = set(taken)
        while live and left > 1e-9:
            total = sum(open_[i].weight for i in live)
            want = {i: left * open_[i].weight / total for i in live}
            full = {i for i in live if taken[i] + want[i] >= open_[i].capacity - 1e-9}
            for i in full or live:
                add = min(want[i], open_[i].capacity - taken[i]) if full else want[i]
                taken[i] += add
                left -= add
            live -= full
            if not full:
                break
        for i, c in enumerate(open_):
            c.give(taken[i])
        return self.budget


def _largest_budget(sources: list[Node]) -> float:
    """The largest total at which every source that has documents still meets its target share."""
    live = [s for s in sources if s.weight > 0 and s.capacity > 0]
    total = sum(s.weight for s in live)
    return min((s.capacity * total / s.weight for s in live), default=0.0)


def plan_budgets(leaves: list[tuple], targets: dict[str, tuple[float, int]], budget: float | None = None) -> list[tuple]:
    """(*names, tokens to take, most uses) of each leaf.

    ``leaves`` are (source, ..., tokens), names from the root down; there are as many as there are different
    ones.  Without ``budget`` the total is the largest that keeps all shares at their targets.
    """
    root = Node((), 1.0)
    nodes: dict[tuple, Node] = {}
    for *names, tokens in sorted(leaves):
        share, repeats = targets.get(names[0], (0.0, 0))
        if tokens <= 0 or names[0] not in targets:
            continue
        up = root
        for depth in range(1, len(names) + 1):
            name = tuple(names[:depth])
            if name not in nodes:
                nodes[name] = Node(name, float(share or 0) if depth == 1 else 0.0)
                up.children.append(nodes[name])
            up = nodes[name]
            if depth > 1:
                up.weight += float(tokens)
        up.own += float(tokens) * max(0, int(repeats or 0))
    root.give(_largest_budget(root.children) if budget is None else float(budget))
    return [(*name, n.budget, int(targets[name[0]][1])) for name, n in sorted(nodes.items()) if not n.children]


def round_up(ends: list[tuple[tuple, float, int]]) -> set[tuple]:
    """The leaves whose prefix includes the document that their budget ends in: of each source those with
    the largest part of it inside, as long as the source comes closer to its budget.

    ``ends`` are (names, tokens left of the budget before this document, its tokens)."""
    chosen, by = set(), {}
    for names, left, size in ends:
        by.setdefault(names[0], []).append((left / max(1, size), names, left, size))
    for of in by.values():
        short = sum(left for _, _, left, _ in of)
        for _, names, _, size in sorted(of, key=lambda x: (-x[0], x[1])):
            if abs(short - size) < abs(short):
                chosen.add(names)
                short -= size
    return chosen


class Mix:
    """The rows taken and the shares; both read one materialised table of token counts."""

    def __init__(self, docs: DataFrame, targets: DataFrame, budget: float | None = None, part: float | None = None, seed: int = 17, folder: str | None = None):
        spark = docs.sparkSession
        # targets are a hand-written table: one row per source
        self.targets = {}
        for r in targets.select(source_name(F.col("source")).alias("s"), "target_share", "max_repeats").where("s is not null").collect():
            share, reps = self.targets.get(r.s, (0.0, 0))
            self.targets[r.s] = (share + float(r.target_share or 0), max(reps, int(r.max_repeats or 0)))
        kind = kind_name(F.col("site_type")) if "site_type" in docs.columns else F.lit("other")
        listed = docs.select("doc_id", source_name(F.col("source")).alias("source"), language_name(F.col("lang")).alias("lang"), kind.alias("kind"), "text")
        listed = listed.where(F.col("source").isin(sorted(self.targets)))
        counts = encoding.token_counts(listed.select(F.struct("doc_id", *LEVELS).alias("_key"), "text"), "_key", "text", folder)
        self.tokens = materialise(
            counts.select("_key.*", "n_tokens").withColumn("_h", F.xxhash64(F.lit(seed), F.col("doc_id"))).withColumn("_u", F.shiftrightunsigned(F.col("_h"), 1) / F.lit(float(1 << 63)))
        )
        sizes = self.tokens.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")).collect()  # as many as leaves
        held = {tuple(r[k] for k in LEVELS): (r.tokens, r.docs) for r in sizes}
        if part is not None:
            budget = part * sum(t for t, _ in held.values())
        plan = {}
        for *names, take, repeats in plan_budgets([(*k, t) for k, (t, _) in held.items()], self.targets, budget):
            whole, docs_of = held[tuple(names)]
            epochs = min(repeats, int(take / whole + 1e-9))
            plan[tuple(names)] = [epochs, float(take - epochs * whole) if epochs < repeats else 0.0, max(1, min(MAX_BUCKETS, docs_of // BUCKET_DOCS)), -1, 0]
        self._find_ends(spark, plan)

    def _planned(self, spark, plan: dict) -> DataFrame:
        """The tokens with the plan of their leaf: whole epochs, what is left for the prefix, number of
        buckets, the bucket in which the prefix ends and the tokens before it."""
        rows = [(*names, *v) for names, v in plan.items()]
        p = spark.createDataFrame(rows, ", ".join(f"{k} string" for k in LEVELS) + ", epochs int, rest double, buckets int, edge int, before long")
        return self.tokens.join(broadcast_if_small(p), list(LEVELS)).withColumn("_bucket", F.floor(F.col("_u") * F.col("buckets")).cast("int"))

    def _find_ends(self, spark, plan: dict) -> None:
        per = self._planned(spark, plan).where("rest > 0").groupBy(*LEVELS, "_bucket").agg(F.sum("n_tokens").alias("_in"), F.first("rest").alias("rest"))
        run = Window.partitionBy(*LEVELS).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
        per = per.withColumn("_to", F.sum("_in").over(run)).where(F.col("_to") > F.col("rest"))
        for r in per.groupBy(*LEVELS).agg(F.min(F.struct("_bucket", (F.col("_to") - F.col("_in")).alias("before"))).alias("e")).collect():  # as many as leaves
            plan[tuple(r[k] for k in LEVELS)][3:] = [r.e._bucket, r.e.before]
        # the document in which each leaf's budget ends
        over = self._running(self._planned(spark, plan)).where(F.col("_to") > F.col("rest"))
        first = over.groupBy(*LEVELS).agg(F.min(F.struct("_to", -F.col("n_tokens"), "n_tokens", "rest")).alias("e")).collect()  # as many as leaves
        ends = {tuple(r[k] for k in LEVELS): r.e for r in first}
        for names in round_up([(k, e.rest - (e._to - e.n_tokens), e.n_tokens) for k, e in ends.items()]):
            plan[names][1] = float(ends[names]._to)
        self.plan = plan

    @staticmethod
    def _running(d: DataFrame) -> DataFrame:
        """The buckets in which prefixes end, in seeded order, with running sums."""
        run = Window.partitionBy(*LEVELS).orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
        return d.where(F.col("_bucket") == F.col("edge")).withColumn("_to", F.col("before") + F.sum("n_tokens").over(run))

    def rows(self) -> DataFrame:
        """doc_id, source, lang, kind, n_tokens, n_uses of every document used at least once."""
        d = self._planned(self.tokens.sparkSession, self.plan)
        inside = (F.col("rest") > 0) & ((F.col("edge") < 0) | (F.col("_bucket") < F.col("edge")))
        rest = d.where((F.col("edge") < 0) | (F.col("_bucket") != F.col("edge"))).withColumn("n_uses", F.col("epochs") + inside.cast("int"))
        edge = self._running(d).withColumn("n_uses", F.col("epochs") + (F.col("_to") <= F.col("rest")).cast("int"))
        cols = ["doc_id", *LEVELS, "n_tokens", "n_uses"]
        return rest.select(cols).unionByName(edge.select(cols)).where("n_uses > 0")

    def shares(self) -> DataFrame:
        """source, target_share, actual_share, tokens, n_docs, most_uses of every listed source."""
        spark = self.tokens.sparkSession
        t = spark.createDataFrame([(s, float(v[0])) for s, v in self.targets.items()], "source string, target_share double")
        per = self.rows().groupBy("source").agg(
            F.sum(F.col("n_tokens") * F.col("n_uses")).alias("tokens"), F.count(F.lit(1)).alias("n_docs"), F.max("n_uses").alias("most_uses")
        )
        out = t.join(per, "source", "left").na.fill(0, ["tokens", "n_docs", "most_uses"])
        total = F.sum("tokens").over(Window.partitionBy())  # as many rows as targets
        return out.select("source", "target_share", F.when(total > 0, F.col("tokens") / total).otherwise(F.lit(0.0)).alias("actual_share"), "tokens", "n_docs", "most_uses")


def mix(docs: DataFrame, targets: DataFrame, budget: float | None = None, part: float | None = None, seed: int = 17, folder: str | None = None) -> Mix:
    """Take rows of each listed source so that its share of all tokens comes to its target.

    The total is ``budget`` tokens, or ``part`` of the tokens of the listed sources, or else the largest at
    which every source meets its target.  Sources are matched by one spelling; rows of unlisted or null
    sources are never taken; a listed source without documents, or with too few, gives its share to the
    others.  Null and empty texts have no tokens and ride along in the seeded order; empty tables give no
    rows.  Copies are documents of their own.
    """
    return Mix(docs, targets, budget, part, seed, folder)
