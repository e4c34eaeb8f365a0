"""Look for plan shapes that do not scale in every registered query.

usage: python tools/check_plans.py [sf] [name-prefix ...]
"""

from __future__ import annotations

import pathlib
import re
import sys

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from amberline.plans import queries  # noqa: E402
from amberline.session import build_session  # noqa: E402

UNWANTED = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroups", "MapInPandas")


def findings(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [f"{word} x{n}" for word in UNWANTED if (n := len(re.findall(word, plan)))]


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    prefixes = tuple(sys.argv[2:])
    spark = build_session("plans", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.log.level": "OFF",
                                                  "spark.ui.showConsoleProgress": "false"})
    for name, fn in queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        found = findings(fn(spark, f"/root/testdata/sf{sf}"))
        if found:
            print(name, found, flush=True)
    print("done")


if __name__ == "__main__":
    main()
