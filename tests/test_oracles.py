"""Every registered query against its SQL."""

import oracle
import pytest

from tripleloom import plans

SF = "/root/testdata/sf0.001"
SQL = plans.oracle_sql()
QUERIES = plans.queries()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, name):
    df = QUERIES[name](spark, SF)
    if name not in SQL:
        assert df.count() > 0
        return
    assert oracle.differences(df, SQL[name], SF) == []


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["channel_flow", "map_join_condition", "register_channels", "status_changes", "channel_state"])
def test_joins_without_broadcast(spark, name):
    """Past the broadcast threshold the same plans sort, shuffle and split skewed partitions."""
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1KB",
    }
    before = {k: spark.conf.get(k, None) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        assert oracle.differences(QUERIES[name](spark, SF), SQL[name], SF) == []
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
