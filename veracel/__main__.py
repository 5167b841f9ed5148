"""Batch entry points: python -m veracel list | run QUERY... | check-log PATH | settings FILE | check-settings FILE..."""

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .operators import settings_rules
from .operators.metrics import resolved_policy
from .plans import registry
from .sources import files


def session(name: str) -> SparkSession:
    return SparkSession.builder.appName(name).getOrCreate()


def run(args) -> int:
    """Each query over the input's tables, written as Parquet (or another format) under the output folder."""
    unknown = [q for q in args.query if q not in registry.QUERIES]
    if unknown:
        print(f"no such query: {', '.join(unknown)}", file=sys.stderr)
        return 2
    spark = session("veracel")
    for name in args.query:
        registry.QUERIES[name](spark, args.input).write.mode("error").format(args.format).save(f"{args.output}/{name}")
    return 0


def check_log(args) -> int:
    """Says which round breaks a log, if any."""
    from .streaming.linked_log import LinkedLog

    log = LinkedLog(session("veracel-log"), args.path)
    bad = log.verify(files.RECORD).where("not ok").orderBy("round_index").collect()
    print(json.dumps({"ok": not bad, "last_round": log.head().round_index, "broken": [{"round": r.round_index, "reason": r.reason} for r in bad]}))
    return 1 if bad else 0


def check_settings(args) -> int:
    """What is wrong with settings files, an issue a line; 1 if any of them is an error."""
    told = settings_rules.issues(settings_rules.documents(session("veracel-settings"), args.file)).orderBy("artifact", "section", "key").collect()
    for r in told:
        print(json.dumps(r.asDict()))
    return 1 if any(r.level == "error" for r in told) else 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="veracel", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of all queries")
    r = sub.add_parser("run", help="run queries over a folder of tables")
    r.add_argument("query", nargs="+")
    r.add_argument("--input", required=True)
    r.add_argument("--output", required=True)
    r.add_argument("--format", default="parquet", choices=("parquet", "json", "orc"))
    c = sub.add_parser("check-log", help="verify a linked log")
    c.add_argument("path")
    s = sub.add_parser("settings", help="the settings of a file, and the policy that follows")
    s.add_argument("file")
    k = sub.add_parser("check-settings", help="what is wrong with settings files")
    k.add_argument("file", nargs="+")
    args = p.parse_args(argv)
    if args.command == "list":
        print("\n".join(sorted(registry.QUERIES)))
        return 0
    if args.command == "settings":
        got = files.read_settings(args.file)
        print(json.dumps({"settings": got, "policy": resolved_policy(got)}, indent=2, default=str))
        return 0
    return {"run": run, "check-log": check_log, "check-settings": check_settings}[args.command](args)


if __name__ == "__main__":
    sys.exit(main())
