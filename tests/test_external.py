import pytest
from pyspark.sql import functions as F

from arbitra.operators.score import pad_ids


@pytest.mark.parametrize(
    "ids,want,mask",
    [
        ([1, 2, 3], [1, 2, 3, 0, 0, 0, 0, 0], [1, 1, 1, 0, 0, 0, 0, 0]),
        ([1, 2, 3] * 3 + [1], [1, 2, 3, 1, 2, 3, 1, 2], [1] * 8),
        ([], [0] * 8, [0] * 8),
    ],
)
def test_padding(spark, ids, want, mask):
    df = spark.createDataFrame([(ids,)], "ids array<bigint>")
    a, m = pad_ids(F.col("ids"), 8)
    row = df.select(a.alias("a"), m.alias("m")).first()
    assert (row["a"], row["m"]) == (want, mask)
