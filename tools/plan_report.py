"""Summarize the physical plan of every registered query (markdown table).

Usage: python tools/plan_report.py [sf_dir]
Counts shuffles (Exchange), broadcast exchanges, joins, windows (with their
partition keys), aggregates, Python stages, and the columns read per scan.
Plans are the initial AQE plans (before run-time re-planning).
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fleetstream.plans.catalog import QUERIES  # noqa: E402
from fleetstream.session import get_spark  # noqa: E402

SKIP = {"new_file_stream", "restart_once", "slow_listing", "timed_trigger", "named_line_stream"}  # run a stream when built


def formatted(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def summarize(p: str) -> dict:
    tree = p.split("\n\n")[0]
    nodes = re.findall(r"[+-] ([A-Za-z]+)", tree) + re.findall(r"^([A-Za-z]+)", tree, re.M)
    windows = re.findall(r"\(\d+\) Window\n(?:.*\n)*?Arguments: .*?, \[([^\]]*)\], \[", p)
    keys = sorted({",".join(re.sub(r"#\d+L?", "", k).strip() for k in w.split(",")) for w in windows})
    return {
        "shuffles": sum(1 for n in nodes if n == "Exchange"),
        "broadcasts": sum(1 for n in nodes if n == "BroadcastExchange"),
        "joins": sorted({n for n in nodes if n.endswith("Join")}),
        "aggs": sorted({n for n in nodes if n.endswith("Aggregate")}),
        "windows": keys,
        "python": sorted({n for n in nodes if "Python" in n or "Pandas" in n}),
        "scans": sorted(set(re.findall(r"ReadSchema: struct<([^>]*)>", p))),
    }


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = get_spark()
    print("| query | shuffles | broadcasts | joins | aggregates | window partition keys | python | columns read |")
    print("| --- | --- | --- | --- | --- | --- | --- | --- |")
    for name, fn in QUERIES.items():
        if name in SKIP:
            continue
        s = summarize(formatted(fn(spark, sf_dir)))
        cols = "; ".join(re.sub(r":[a-z_]+(\([^)]*\))?", "", x) for x in s["scans"])
        print(f"| `{name}` | {s['shuffles']} | {s['broadcasts']} | {', '.join(s['joins']) or '-'} "
              f"| {', '.join(s['aggs']) or '-'} | {'; '.join(s['windows']) or '-'} "
              f"| {', '.join(s['python']) or '-'} | {cols} |")
    spark.stop()


if __name__ == "__main__":
    main()
