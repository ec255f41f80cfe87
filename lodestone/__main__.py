"""Command line: ``python -m lodestone list``, ``run QUERY... --data DIR [--out DIR]``, ``report --data DIR``."""

from __future__ import annotations

import argparse
import sys

from . import plans
from .runtime import session

#: Names of tools and the queries that stand behind them.
TOOLS = {
    "run-create": "matrix_problems", "capture-gate": "capture_gate", "ingest-records": "record_problems", "merge-staging": "merge_staging", "cluster": "cluster_panel", "score-intensity": "intensity_score",
    "capture-saturation": "saturation_reads", "record-source-decision": "source_catalogue", "rescan": "guarded_verdicts", "retro-trend": "slope_shape_canonical", "crawl": "page_status", "report": "report_lines",
}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lodestone")
    parser.add_argument("tool", help="list, run, or one of: " + ", ".join(sorted(TOOLS)))
    parser.add_argument("queries", nargs="*")
    parser.add_argument("--data", help="folder with the tables")
    parser.add_argument("--out", help="folder that a parquet table is written to for each query; else the rows are shown")
    args = parser.parse_args(argv)
    known = plans.queries()
    if args.tool == "list":
        print("\n".join(sorted(known)))
        return 0
    names = args.queries if args.tool == "run" else [TOOLS[args.tool]] if args.tool in TOOLS else []
    if not names or not args.data or any(n not in known for n in names):
        parser.print_usage(sys.stderr)
        return 2
    spark = session("lodestone")
    for name in names:
        df = known[name](spark, args.data)
        if args.out:
            df.write.mode("errorifexists").parquet(f"{args.out}/{name}")
        elif name == "report_lines":
            print("\n".join(r["line"] for r in df.orderBy("place").collect()))
        else:
            df.show(50, truncate=80)
    return 0


if __name__ == "__main__":
    sys.exit(main())
