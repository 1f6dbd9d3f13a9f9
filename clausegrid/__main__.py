"""``python -m clausegrid compare PREV CURR`` and ``inspect DOC``: one pair or one document from the shell.

Exit codes of compare: 2 with a critical finding, 1 with a major one (with --fail-on-major), else 0; 3 if a file cannot be read.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from clausegrid.plans import compare as plan
from clausegrid.sources import files, sinks

UNREADABLE = 3


def _read(spark: SparkSession, path: str):
    with open(path, "rb") as file:
        rows = spark.createDataFrame([("pair", path, file.read())], "pair_id string, path string, content binary")
    found, errors = files.paragraphs(rows, plan.KEYS)
    if wrong := errors.first():
        raise OSError(f"{path}: {wrong.error}")
    return found


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="clausegrid")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("compare")
    one.add_argument("prev")
    one.add_argument("curr")
    for flag in ("--json", "--changes", "--fail-on-major"):
        one.add_argument(flag, action="store_true")
    two = commands.add_parser("inspect")
    two.add_argument("doc")
    for flag in ("--json", "--refs"):
        two.add_argument(flag, action="store_true")
    asked = parser.parse_args(args)
    spark = SparkSession.builder.master(os.environ.get("SPARK_MASTER", "local[2]")).config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        if asked.command == "inspect":
            return _inspect(spark, asked)
        return _compare(spark, asked)
    except OSError as e:
        print(e, file=sys.stderr)
        return UNREADABLE


def _compare(spark: SparkSession, asked) -> int:
    report = plan.compare(_read(spark, asked.prev), _read(spark, asked.curr))
    findings, changes = report["findings"].orderBy("place"), report["changes"].orderBy("change_id")
    total = report["summary"].first()
    if asked.json:
        whole = {"summary": total.asDict(), "findings": [r.asDict() for r in findings.collect()], "changes": [r.asDict() for r in changes.collect()], "plan": [r.asDict() for r in report["plan_summary"].collect()]}
        print(json.dumps(whole, indent=2, ensure_ascii=False))
    else:
        print(f"+{total.added} -{total.removed} ~{total.modified}; {total.prev_articles} -> {total.curr_articles} articles; {total.critical} critical, {total.major} major, {total.minor} minor")
        for r in sinks.finding_lines(findings, plan.KEYS).orderBy("place").collect():
            print(r.line)
        for r in sinks.change_lines(changes, plan.KEYS).orderBy("change_id").collect() if asked.changes else []:
            print(r.line)
    return total.exit_code if total.exit_code == 2 or asked.fail_on_major else 0


def _inspect(spark: SparkSession, asked) -> int:
    found = plan.inspect(_read(spark, asked.doc))
    if asked.json:
        print(json.dumps([r.asDict() for r in found["nodes"].orderBy("preorder").collect()], indent=2, ensure_ascii=False))
    else:
        for r in sinks.tree_lines(found["nodes"], plan.KEYS).orderBy("preorder").collect():
            print(r.line)
        for r in sinks.finding_lines(found["findings"], plan.KEYS).orderBy("place").collect():
            print(r.line)
    for r in found["refs"].orderBy("para_index", "ref_seq").select(F.format_string("[%d] %s -> %s", "para_index", "raw", "target_id").alias("line")).collect() if asked.refs else []:
        print(r.line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
