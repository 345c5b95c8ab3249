"""Order-insensitive fingerprints."""
from quarry.sources import io as IO


def test_nulls_and_edges_of_cells_count(spark):
    rows = [("a", None, "b"), ("a", "b", None), (None, "a", "b"), ("ab", None, None), ("a", "", "b"), ("a", "-", "b"), ("1:a", None, None)]
    schema = "x string, y string, z string"
    fps = [IO.fingerprint(spark.createDataFrame([r], schema), ["x", "y", "z"]).first()["fp"] for r in rows]
    assert len(set(fps)) == len(rows)
    a, b = rows[:3], rows[2::-1]
    assert (IO.fingerprint(spark.createDataFrame(a, schema), ["x", "y", "z"]).first()
            == IO.fingerprint(spark.createDataFrame(b, schema), ["x", "y", "z"]).first())
