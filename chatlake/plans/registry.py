"""All registered queries and their SQL oracles."""

from __future__ import annotations

import functools
from importlib import import_module

from ..session import ship_package

MODULES = ["q_context", "q_routing", "q_settings", "q_usage", "q_spaces", "q_payloads", "q_prompt", "q_stream",
           "q_plugins"]


def _shipped(fn):
    """Every query makes sure the Python workers can import the package
    (needed by the plug-in and stateful operators) before it builds its
    plan."""

    @functools.wraps(fn)
    def run(spark, sf_dir):
        ship_package(spark)
        return fn(spark, sf_dir)

    return run


def _load():
    queries, oracle = {}, {}
    for m in MODULES:
        mod = import_module(f"{__package__}.{m}")
        queries.update({k: _shipped(v) for k, v in mod.QUERIES.items()})
        oracle.update(mod.ORACLE)
    return queries, oracle


def queries():
    return _load()[0]


def oracle_sql():
    return _load()[1]
