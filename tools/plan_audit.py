"""Print scale hazards found in each registered query's physical plan.

Flags: CartesianProduct / BroadcastNestedLoopJoin, SinglePartition exchanges
(with the operator right above), Python UDF nodes, scans' ReadSchema and the
largest generated method (the JVM does not compile one above 8,000 bytes; such
stages run as smaller methods under spark.sql.codegen.hugeMethodLimit=8000).
Usage: python tools/plan_audit.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

# queries that fit models or write files while they are built; name them to include them
SKIP_BUILD = ("M", "E12", "K1_fitted", "S7", "S8", "K20", "S1_", "S2_", "S4_", "S6_", "D1_", "D2_")


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    from vitalframe.plans.registry import QUERIES
    from vitalframe.session import get_session
    spark = get_session("local[8]")
    for name, fn in QUERIES.items():
        if only and not any(o in name for o in only):
            continue
        if not only and name.startswith(SKIP_BUILD):
            continue
        df = fn(spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        lines = plan.splitlines()
        flags = []
        for i, ln in enumerate(lines):
            if "CartesianProduct" in ln or "BroadcastNestedLoopJoin" in ln:
                flags.append("NESTED/CARTESIAN: " + ln.strip()[:120])
            if "SinglePartition" in ln:
                above = lines[i - 1].strip()[:100] if i else ""
                flags.append("SINGLE: " + above)
            if "BatchEvalPython" in ln or "ArrowEvalPython" in ln:
                flags.append("PYTHON: " + ln.strip()[:100])
        scans = set(re.findall(r"ReadSchema: (struct<[^>]*>)", df._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))))
        code = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(df._jdf.queryExecution().executedPlan())
        largest = max([0, *map(int, re.findall(r"maxMethodCodeSize:(\d+)", code))])
        print(f"== {name}: {len(flags)} flags; largest method {largest} bytes; scans={sorted(scans)}")
        for f in flags:
            print("   ", f)
    spark.stop()


if __name__ == "__main__":
    main()
