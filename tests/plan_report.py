"""Summarise the physical plan of every registered query into PLANS.md.

Usage: python tests/plan_report.py [sf_dir]   (default sf0.01)
Counts come from ``explain("formatted")`` of the initial adaptive plan, including
scalar-subquery plans; eager steps inside a query (written tables,
quantile boundaries) run while the plan is built and are noted separately.
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

EAGER = {"jsonl_roundtrip": "writes + reads JSONL", "materialize_if_absent": "writes + reads JSONL",
         "result_json": "writes + reads result documents",
         "stream_suite_score": "runs a streaming query, reads its sink",
         "lowrank_correction": "partial Gram job, d×d eigenvectors on the driver",
         "result_json_filtered": "writes + reads metrics", "ordered_split": "writes ranges", "run_delta": "writes ranges"}


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def summarise(p: str) -> dict:
    nodes = re.findall(r"^\(\d+\) ([A-Za-z]+)", p, flags=re.M)
    single = len(re.findall(r"Arguments: SinglePartition", p))
    exchanges = nodes.count("Exchange")
    return {
        "exchanges": exchanges,
        "single_partition": single,
        "broadcast_hash_joins": nodes.count("BroadcastHashJoin"),
        "sort_merge_joins": nodes.count("SortMergeJoin"),
        "shuffled_hash_joins": nodes.count("ShuffledHashJoin"),
        "nested_loop_or_cartesian": nodes.count("BroadcastNestedLoopJoin") + nodes.count("CartesianProduct"),
        "windows": nodes.count("Window"),
        "window_group_limits": nodes.count("WindowGroupLimit"),
        "python": nodes.count("MapInPandas") + nodes.count("PythonMapInArrow"),
        "pushed": "yes" if re.search(r"PushedFilters: \[[^\]]+\]", p) else "",
    }


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from quire.plans.registry import QUERIES
    from quire.session import build_session

    spark = build_session()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as on large inputs: only hinted sides are broadcast
    rows = []
    for name, fn in QUERIES.items():
        s = summarise(plan_text(fn(spark, sf_dir)))
        rows.append((name, s))
    cols = ["exchanges", "single_partition", "broadcast_hash_joins", "sort_merge_joins",
            "shuffled_hash_joins", "nested_loop_or_cartesian", "windows", "window_group_limits",
            "python", "pushed"]
    out = ["# Physical plans of the registered queries", "",
           f"Generated by `python tests/plan_report.py` on `{sf_dir}` (initial adaptive plans with "
           "`autoBroadcastJoinThreshold=-1`, so that no side is broadcast because it is small here; AQE may still "
           "switch join strategies or coalesce partitions at run time). "
           "`single_partition` counts exchanges into one partition; by construction these only "
           "sit above partial aggregates of bounded tables (bucket counts, global totals in "
           "scalar subqueries), never above row data (checked in `tests/test_plans.py`).", "",
           "| query | " + " | ".join(cols) + " | eager steps |",
           "|---|" + "---|" * (len(cols) + 1)]
    for name, s in rows:
        out.append(f"| `{name}` | " + " | ".join(str(s[c]) for c in cols) + f" | {EAGER.get(name, '')} |")
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md")
    with open(path, "w") as f:
        f.write("\n".join(out) + "\n")
    print(f"wrote {path} ({len(rows)} queries)")


if __name__ == "__main__":
    main()
