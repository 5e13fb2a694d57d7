"""python -m braid [transform] --csv FILE --resume PDF_OR_TEXT --linkedin HTML --github FILE_OR_NAME [--config FILE] [-o FILE] [-v]"""
from __future__ import annotations

import argparse
import json
import logging
import sys

from pyspark.sql import SparkSession

from braid.plans.fusion import run


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="braid", description="Fuses one candidate's records into a profile.")
    parser.add_argument("command", nargs="?", choices=["transform"], default="transform", help="the only command")
    for name, text in (("csv", "CSV export"), ("resume", "résumé, PDF or text"), ("linkedin", "saved profile page"), ("github", "user JSON, name or address"), ("config", "projection config")):
        parser.add_argument(f"--{name}", help=text)
    parser.add_argument("--output", "-o", help="file for the result")
    parser.add_argument("--verbose", "-v", action="store_true")
    a = parser.parse_args(args)
    logging.basicConfig(format="%(levelname)s [%(name)s] %(message)s", level=logging.DEBUG if a.verbose else logging.WARNING, stream=sys.stderr)
    if not (a.csv or a.resume or a.linkedin or a.github):
        print("Provide at least one source (--csv, --resume, --linkedin, --github).", file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("braid").getOrCreate()
    spark.sparkContext.setLogLevel("DEBUG" if a.verbose else "ERROR")
    try:
        result = json.loads(run(spark, a.csv, a.resume, a.linkedin, a.github, a.config).first().json)
    except ValueError as e:
        print(f"Pipeline error: {e}", file=sys.stderr)
        return 1
    text = json.dumps(result, indent=2, ensure_ascii=False)
    if a.output:
        with open(a.output, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        print(text)
    score = next((result[k] for k in ("overall_confidence", "confidence_score", "_overall_confidence") if k in result), "N/A")
    warnings = result.get("warnings", [])
    print(f"Sources: {', '.join(result['sources_used'])} | Confidence: {score} | Warnings: {len(warnings)}", file=sys.stderr)
    for w in warnings:
        print(f"  {w}", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
