"""Small API pieces: F6 decode, W4 membership view, S4 scan, lineage cut."""

from pyspark.sql import functions as F

from chatlake.operators import spaces as SP
from chatlake.operators import toolcalls as TC
from chatlake.session import cut_lineage
from chatlake.sources.tables import scan_all


def test_json_decode_and_object_test(spark):
    df = spark.createDataFrame([("```json\n{\"a\": 1}```",), ("[1]",), ("nope",), ('{"a":1} tail',)], "s string")
    got = [(r.ok, r.obj) for r in df.select(TC.json_decode("s").isNotNull().alias("ok"),
                                            TC.is_object(TC.json_decode("s")).alias("obj")).collect()]
    assert got == [(True, True), (True, False), (False, False), (False, False)]


def test_current_membership(spark):
    ev = spark.createDataFrame([("!r", "@a", "join", "2024-01-01 00:00:00", 1), ("!r", "@a", "leave", "2024-01-02 00:00:00", 2),
                                ("!r", "@b", "join", "2024-01-01 00:00:00", 3)],
                               "room_id string, user_id string, membership string, ts string, event_id bigint") \
        .withColumn("ts", F.to_timestamp("ts"))
    got = {r.user_id: r.membership for r in SP.current_membership(ev).collect()}
    assert got == {"@a": "leave", "@b": "join"}
    assert {r.room_id: r.members for r in SP.member_counts(ev).collect()} == {"!r": 1}


def test_scan_all_and_cut_lineage(spark, sf_dir):
    nation = scan_all(spark, sf_dir, "nation")
    assert nation.count() == 25 and len(nation.columns) == 3
    cut = cut_lineage(nation.where("n_regionkey = 1"))
    assert cut.count() == nation.where("n_regionkey = 1").count()
    from chatlake.plans.planinfo import plan_text

    assert "Scan parquet" not in plan_text(cut, "simple")
