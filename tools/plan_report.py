"""Summarise the physical plans of registered queries: exchanges, joins,
scans (ReadSchema / PushedFilters), Python nodes, codegen stages.

    python tools/plan_report.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    from capstan.plans import REGISTRY
    from capstan.session import checkpoint_dir, get_session
    spark = get_session("local[8]")
    checkpoint_dir(spark)
    for n in a.names or list(REGISTRY):
        df = REGISTRY[n].build(spark, a.sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        scans = re.findall(r"FileScan parquet [^\n]*", plan)
        info = {
            "exchanges": plan.count("Exchange "),
            "bhj": plan.count("BroadcastHashJoin"), "smj": plan.count("SortMergeJoin"),
            "bnlj": plan.count("BroadcastNestedLoopJoin") + plan.count("CartesianProduct"),
            "windows": plan.count("Window ["), "python": len(re.findall(r"(ArrowEvalPython|FlatMapGroupsInPandas|"
                                                                       r"MapInPandas|BatchEvalPython)", plan)),
        }
        print(n, info)
        for s in scans:
            rs = re.search(r"ReadSchema: (struct<[^>]*>)", s)
            pf = re.search(r"PushedFilters: (\[[^\]]*\])", s)
            print("   scan", rs.group(1) if rs else "?", "pushed", pf.group(1) if pf else "[]")


if __name__ == "__main__":
    main()
