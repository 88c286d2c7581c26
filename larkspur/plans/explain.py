"""Plans as text or JSON."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame


def explained(df: DataFrame, analyze: bool = False, kind: str = "text") -> str:
    """The formatted plan; with analyze the query runs first, and its rows and seconds are told."""
    facts = {}
    if analyze:
        began = time.perf_counter()
        facts = {"rows": df.count(), "seconds": round(time.perf_counter() - began, 6)}
    run = df._jdf.queryExecution()
    if kind == "json":
        return json.dumps({"logical": json.loads(run.optimizedPlan().toJSON()), "physical": run.executedPlan().toString()} | facts)
    text = run.explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return text + "".join(f"\n{k}: {v}" for k, v in facts.items())


def compiled(builder):
    """A query planned once: calls give the same DataFrame, whose plan Spark keeps."""
    held: dict = {}

    def call(*args):
        if args not in held:
            held[args] = builder(*args)
        return held[args]

    return call
