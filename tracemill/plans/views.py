"""The unfiltered read views as temporary views, for SQL users."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tracemill.operators import metrics
from tracemill.operators.metrics import Tables


def views(t: Tables) -> dict[str, DataFrame]:
    """Each view by name."""
    out = {
        "v_session_metrics": metrics.session_metrics(t),
        "v_daily_activity": metrics.activity(t),
        "v_tool_usage": metrics.tool_usage(t),
        "v_model_usage": metrics.model_usage(t),
    }
    if t.import_run is not None:
        out["v_import_quality"] = metrics.import_quality(t)
    return out


def register(t: Tables) -> list[str]:
    """Create the temporary views and return their names."""
    made = views(t)
    for name, df in made.items():
        df.createOrReplaceTempView(name)
    return list(made)
