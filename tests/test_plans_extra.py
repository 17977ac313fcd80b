"""More plan properties: hash aggregation for latest flags; sizing helper."""

from chatlake.plans import registry
from chatlake.plans.planinfo import plan_text
from chatlake.session import scale_conf

Q = registry.queries()


def test_membership_counts_hash_aggregate(spark, sf_dir):
    for name in ("room_members", "abandoned_rooms", "request_tokens"):
        text = plan_text(Q[name](spark, sf_dir))
        assert "SortAggregate" not in text and "HashAggregate" in text, name


def test_scale_conf():
    c = scale_conf(100 * 2 ** 40, 8000)
    assert c["spark.sql.shuffle.partitions"] == str(100 * 2 ** 40 // (256 << 20))
    assert c["spark.sql.adaptive.skewJoin.enabled"] == "true"
    small = scale_conf(100 * 2 ** 20, 8)
    assert small["spark.sql.shuffle.partitions"] == "16"          # two waves of 8 cores
    assert int(small["spark.sql.files.maxPartitionBytes"]) == 256 << 20
