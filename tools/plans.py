"""Write a node summary of every core query's physical plan to
docs/plans/SUMMARY.md.

    python tools/plans.py [sf_dir]

Fails if any plan holds a nested-loop join, a cartesian product or Python
evaluation.
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from limnos.catalog import REGISTRY  # noqa: E402
from limnos.session import get_session  # noqa: E402

NODES = ["Scan parquet", "Exchange", "BroadcastExchange", "BroadcastHashJoin", "SortMergeJoin",
         "ShuffledHashJoin", "HashAggregate", "SortAggregate", "ObjectHashAggregate", "Window",
         "Generate", "BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython",
         "ArrowEvalPython"]
BAD = ["BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython"]


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    out_dir = os.path.join(ROOT, "docs", "plans")
    os.makedirs(out_dir, exist_ok=True)
    # whole plans, without intermediate tables
    spark = get_session("local[4]", 8, extra={"spark.limnos.materialize": "false"})
    rows, bad = [], []
    for name, (fn, _) in REGISTRY.items():
        df = fn(spark, sf_dir)
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain("formatted")
        text = buf.getvalue()
        head = text.split("\n\n(1)")[0]
        counts = {n: len(re.findall(rf"\b{re.escape(n)}\b", head)) for n in NODES}
        pushed = "PushedFilters: [" in text and "PushedFilters: []" not in text
        rows.append((name, counts, pushed))
        bad += [f"{name}: {n}" for n in BAD if counts[n]]
    with open(os.path.join(out_dir, "SUMMARY.md"), "w") as fh:
        cols = [n for n in NODES if any(c[n] for _, c, _ in rows)]
        fh.write("| query | " + " | ".join(cols) + " | pushed filters |\n")
        fh.write("|" + " --- |" * (len(cols) + 2) + "\n")
        for name, c, pushed in rows:
            fh.write(f"| {name} | " + " | ".join(str(c[n]) for n in cols)
                     + f" | {'yes' if pushed else '-'} |\n")
    print(f"{len(rows)} plans written to {out_dir}")
    if bad:
        raise SystemExit("forbidden plan nodes: " + ", ".join(bad))


if __name__ == "__main__":
    main()
