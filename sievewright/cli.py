"""Command line: run, reclassify, eval, status, requeue, taxonomy, init, doctor."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from sievewright import settings as S


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("sievewright").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    """0 ok, 1 no such node, 2 configuration, 3 accuracy below the target."""
    p = argparse.ArgumentParser(prog="sievewright")
    p.add_argument("--config")
    sub = p.add_subparsers(dest="cmd", required=True)
    for name in ("run", "reclassify"):
        c = sub.add_parser(name)
        if name == "run":
            c.add_argument("input")
            c.add_argument("--scope", default="auto")
            c.add_argument("--allow-no-contact", action="store_true")
        c.add_argument("--state", required=True)
        c.add_argument("--out", required=True)
        c.add_argument("--mode")
    sub.add_parser("status").add_argument("--state", required=True)
    c = sub.add_parser("requeue")
    c.add_argument("--state", required=True)
    c.add_argument("status")
    c = sub.add_parser("eval")
    c.add_argument("--golden", required=True)
    c.add_argument("--fixtures", required=True)
    for name in ("provider", "base-url", "model"):
        c.add_argument(f"--{name}")
    c.add_argument("--min-accuracy", type=float, default=0.0)
    c = sub.add_parser("taxonomy")
    c.add_argument("path", help="a file, or default for the bundled taxonomy")
    c.add_argument("node", nargs="?")
    sub.add_parser("init").add_argument("path")
    sub.add_parser("doctor")
    a = p.parse_args(argv)
    try:
        given = {"mode": getattr(a, "mode", None)}
        if a.cmd == "eval":
            given = {"mode": "sync", "provider": a.provider, "base_url": a.base_url, "model_small": a.model, "model_large": a.model}
        conf = S.load(a.config, **{f"classify__{k}": v for k, v in given.items()})
        if a.cmd == "init":
            with open(a.path, "x") as f:
                f.write('[identity]\ncontact = "mailto:you@example.org"\n\n[classify]\nmode = "off"\n')
            return 0
        if a.cmd == "doctor":
            conf.check_contact()
            print("configuration is sound")
            return 0
        if a.cmd == "run":
            conf.check_contact(a.allow_no_contact)
        from sievewright import pipeline
        from sievewright.operators import frontier, taxonomy
        from sievewright.sources.lines import parse_lines, read_lines

        spark = _session()
        if a.cmd == "run":
            lines = parse_lines(read_lines(spark, a.input), a.scope).where("reject_reason IS NULL").withColumn("line_no", F.monotonically_increasing_id())
            print(pipeline.run(spark, lines, conf, a.state, a.out))
        elif a.cmd == "reclassify":
            print(pipeline.reclassify(spark, conf, a.state, a.out))
        elif a.cmd == "eval":
            if conf.classify.provider == "off":
                raise S.ConfigError("eval needs a provider")
            got = pipeline.evaluate(spark, a.golden, a.fixtures, conf)
            topics = "none labelled" if got["topic_accuracy"] is None else f"{got['topic_accuracy']:.4f} ({got['topic_correct']}/{got['topic_labelled']})"
            print(f"pages {got['total']}  site types {got['accuracy']:.4f}  topics {topics}")
            for method, (right, total) in sorted(got["by_method"].items()):
                print(f"{method:28s} {right}/{total}")
            print("\n".join(got["misses"]))
            return 3 if got["accuracy"] < a.min_accuracy else 0
        elif a.cmd in ("status", "requeue"):
            store = frontier.StateStore(spark, a.state)
            urls = store.read("urls")
            if urls is None:
                raise S.ConfigError("no state there")
            if a.cmd == "requeue":
                store.write(urls=frontier.requeue(urls, a.status))
                urls = store.read("urls")
            for r in frontier.counts_by_status(urls).orderBy("status").collect():  # as many rows as statuses
                print(f"{r.status:28s} {r.n}")
        else:
            t = taxonomy.load(spark, None if a.path == "default" else a.path)
            shown = taxonomy.paths(t).orderBy("id")
            rows = [r.line for r in (shown if a.node is None else shown.where(F.col("id") == a.node)).collect()]  # a fixed table
            print("\n".join(rows))
            return 0 if rows else 1
        return 0
    except (S.ConfigError, ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
