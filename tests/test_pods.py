"""results-only selection falls back to all pods per query."""

from chatlake.functions import payloads as P


def test_choose_pods(spark):
    pods = spark.createDataFrame([(1, 1, "Input"), (1, 2, "Result"), (2, 1, "Input"), (2, 2, "Plot")],
                                 "query_id int, pod_pos int, title string")
    results = pods.where("title = 'Result'")
    got = sorted((r.query_id, r.title) for r in P.choose_pods(True, pods, results).collect())
    assert got == [(1, "Result"), (2, "Input"), (2, "Plot")]
    assert P.choose_pods(False, pods, results).count() == 4
