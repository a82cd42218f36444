"""What Spark counted while a frame ran, as an indented tree of its physical operators."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Counters worth a line, by Spark's name for them.
SHOWN = {
    "numOutputRows": "rows",
    "numFiles": "files",
    "filesSize": "file bytes",
    "scanTime": "scan ms",
    "spillSize": "spilled bytes",
    "shuffleBytesWritten": "shuffled bytes",
    "sortTime": "sort ms",
    "aggTime": "aggregation ms",
}


def ran(frame: DataFrame) -> str:
    """The operators of a frame that has run, with their counters; adaptive stages are opened."""
    lines: list[str] = []

    def visit(plan, depth: int) -> None:
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return visit(plan.executedPlan(), depth)
        if kind.endswith("QueryStageExec"):
            return visit(plan.plan(), depth)
        if kind in ("WholeStageCodegenExec", "InputAdapter"):
            return visit(plan.child(), depth)
        counters, metrics = [], plan.metrics()
        for key, label in SHOWN.items():
            found = metrics.get(key)
            if found.isDefined() and found.get().value() >= 0:
                counters.append(f"{label}={found.get().value()}")
        lines.append("  " * depth + plan.nodeName().strip() + (f"  [{' '.join(counters)}]" if counters else ""))
        children = plan.children()
        for i in range(children.size()):
            visit(children.apply(i), depth + 1)

    visit(frame._jdf.queryExecution().executedPlan(), 0)
    return "".join(line + "\n" for line in lines)
