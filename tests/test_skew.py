import pytest

from antecede.operators.skew import checked_broadcast, lookup
from antecede.session import BROADCAST_BYTES


@pytest.mark.parametrize("most, broadcast", [(100_000_000, True), (1000, False)])
def test_a_side_of_many_bytes_is_not_broadcast(spark, most, broadcast):
    side = spark.range(2000).selectExpr("id", "concat('some text of row ', id) AS text")
    spark.conf.set(BROADCAST_BYTES, str(most))
    try:
        checked = checked_broadcast(side)
    finally:
        spark.conf.unset(BROADCAST_BYTES)
    assert ("strategy=broadcast" in checked._jdf.queryExecution().analyzed().toString()) is broadcast
    assert lookup(spark.range(5), checked, ["id"], ["text"]).where("text IS NOT NULL").count() == 5
