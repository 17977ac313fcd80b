"""Physical plan checks: shuffles, window limits, pushdown, pruning, and no
Python in native operators."""

import re

import pytest

from chatlake.plans import registry
from chatlake.plans.planinfo import plan_text

Q = registry.queries()
PYTHON_NODES = ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "PythonUDF")
PLUGIN = {"batch_model_call", "batch_tools", "token_counter", "classify_messages"}


def overview(df):
    return plan_text(df).split("\n\n\n")[0]


def exchanges(text):
    return len(re.findall(r"[-+] Exchange \(", text))


@pytest.mark.parametrize("name", ["context_last_n", "context_token_budget", "media_merge", "prompt_build",
                                  "prompt_context", "trigger_dedup"])
def test_context_windows_share_their_exchange(spark, sf_dir, name):
    o = overview(Q[name](spark, sf_dir))
    assert exchanges(o) == 2, o                     # by (room, salt), then by room for all windows
    assert o.count("WindowGroupLimit") == 4, o      # before and after each


def test_allow_list_is_a_projection(spark, sf_dir):
    o = overview(Q["allowed_messages"](spark, sf_dir))
    assert exchanges(o) == 0 and "Join" not in o, o


@pytest.mark.parametrize("name", sorted(n for n in Q if n not in PLUGIN and not n.startswith("stream_")))
def test_no_python_in_native_operators(spark, sf_dir, name):
    text = plan_text(Q[name](spark, sf_dir))
    assert not any(p in text for p in PYTHON_NODES), name
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    t = plan_text(Q["pending_invites"](spark, sf_dir))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(event_type,signup\)", t), t
    t = plan_text(Q["usage_by_room"](spark, sf_dir))
    assert "ReadSchema: struct<user_id:bigint,value:double>" in t, t
    t = plan_text(Q["allowed_messages"](spark, sf_dir))
    assert "text" not in re.search(r"ReadSchema: (struct<[^\n]*>)", t).group(1)


def test_settings_pivot_is_one_aggregation(spark, sf_dir):
    o = overview(Q["settings_profile"](spark, sf_dir))
    # one shuffle for the distinct rooms, one for the per-room pivot
    assert exchanges(o) == 2, o
