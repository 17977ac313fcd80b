"""Plan inspection helpers (what ``DataFrame.explain`` prints), used by the
plan checks in the tests and by ``tools``-style reports."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import DataFrame


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode=mode)
    return buf.getvalue()


def count_nodes(df: DataFrame, name: str, mode: str = "formatted") -> int:
    """Occurrences of a physical operator name in the plan overview."""
    text = plan_text(df, mode)
    overview = text.split("\n\n(1)")[0] if mode == "formatted" else text
    return overview.count(name)
