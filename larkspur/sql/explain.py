"""EXPLAIN of statements: the plan as rows of text, in the forms of PostgreSQL's command."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

OPTIONS = ("analyze", "verbose", "format", "costs", "buffers", "timing", "summary", "settings")
COMMAND = re.compile(r"\s*explain\s+(?:\(([^)]*)\)\s*|((?:analyze\s+|verbose\s+)*))", re.I)


def options_of(text: str) -> tuple[dict[str, str], str] | None:
    """The options of an EXPLAIN and the statement behind it; None for any other statement."""
    found = COMMAND.match(text)
    if not found:
        return None
    listed = [x.split() for x in (found[1] or "").lower().split(",") if x.strip()] or [[x] for x in (found[2] or "").lower().split()]
    if any(x[0] not in OPTIONS or len(x) > 2 for x in listed):
        raise ValueError(f"EXPLAIN ({found[1]})")
    return {x[0]: x[1] if len(x) > 1 else "on" for x in listed}, text[found.end() :]


def _walk(node, depth: int, lines: list[str]) -> None:
    """A physical node, its counters and its children; what adaptive execution wraps is shown as it ran."""
    name = node.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        return _walk(node.executedPlan(), depth, lines)
    if name.endswith("QueryStage"):
        return _walk(node.plan(), depth, lines)
    counters, metrics = [], node.metrics().iterator()
    while metrics.hasNext():
        pair = metrics.next()
        if pair._2().value() > 0 and pair._1() in ("numOutputRows", "numFiles", "dataSize", "spillSize"):
            counters.append(f"{pair._1()}={pair._2().value()}")
    lines.append(f"{'  ' * depth}{'-> ' if depth else ''}{name}{f'  ({chr(32).join(sorted(counters))})' if counters else ''}")
    children = node.children().iterator()
    while children.hasNext():
        _walk(children.next(), depth + 1, lines)
    return None


def explained(spark: SparkSession, frame: DataFrame, options: dict[str, str]) -> DataFrame:
    """Rows (line, QUERY PLAN). ANALYZE runs the statement, drops its rows and shows what each operator counted."""
    execution = frame._jdf.queryExecution()
    on = lambda name: options.get(name, "off") not in ("off", "false", "0")
    if on("analyze"):
        execution.executedPlan().execute().count()
        lines: list[str] = []
        _walk(execution.executedPlan(), 0, lines)
    elif options.get("format") == "json":
        lines = execution.executedPlan().prettyJson().split("\n")
    else:
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("extended" if on("verbose") else "formatted")
        lines = execution.explainString(mode).rstrip().split("\n")
    return spark.createDataFrame(list(enumerate(lines)), "line int, `QUERY PLAN` string")
