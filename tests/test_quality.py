import pytest

from splitlift.operators.quality import DataQualityError, dq_report, null_profile, require


def test_passing_report(spark):
    df = spark.createDataFrame([("1",), ("2",)], "order_id string")
    row = require(dq_report(df))
    assert row["n_rows"] == 2 and row["key_is_unique"] and row["key_never_null"]


@pytest.mark.parametrize("rows,failing", [
    ([("1",), ("1",)], "key_is_unique"),
    ([("1",), (None,)], "key_never_null"),
    ([], "has_rows"),
])
def test_each_check_fails(spark, rows, failing):
    df = spark.createDataFrame(rows, "order_id string")
    with pytest.raises(DataQualityError, match=failing):
        require(dq_report(df))


def test_composite_key(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (None, 3)], "a int, b int")
    r = dq_report(df, ["a", "b"]).first()
    assert (r.n_rows, r.n_keyed, r.n_distinct_keys, r.n_null_keys) == (4, 3, 2, 1)
    assert not r.key_is_unique and not r.key_never_null


def test_null_profile(spark):
    df = spark.createDataFrame([("a", None, True), (None, None, None)], "s string, d double, b boolean")
    got = {r.column_name: (r.data_type, r.type_group, r.n_null) for r in null_profile(df).collect()}
    assert got == {"s": ("string", "text", 1), "d": ("double", "float", 2), "b": ("boolean", "text", 1)}
