"""Command line: ``python -m residua.cli ingest|canonicalise ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from residua import api


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="residua")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("ingest", help="parse CIF files into Parquet tables")
    a.add_argument("path")
    a.add_argument("out")
    a.add_argument("--model", type=int, default=1)
    b = sub.add_parser("canonicalise", help="parse CIF files, apply a policy, write Parquet tables")
    b.add_argument("path")
    b.add_argument("policy")
    b.add_argument("out")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.getOrCreate()
    s, notes, status = api.mmcif_to_structure(spark, a.path, getattr(a, "model", 1))
    tables = {**s.tables, "diagnostics": notes, "status": status}
    if a.command == "canonicalise":
        done, _, out = api.canonicalise_structure(s, api.load_policy(a.policy))
        tables = {**done.tables, "diagnostics": out.diagnostics, "status": out.status}
    for name, t in tables.items():
        t.write.mode("overwrite").parquet(f"{a.out}/{name}.parquet")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
