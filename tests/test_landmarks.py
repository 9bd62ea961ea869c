import pytest
from pyspark.sql import functions as F

from siftlake.functions import landmarks as L
from siftlake.functions.numbers import expanded_quad
from siftlake.plans.registry import QUERIES


def test_landmarks_go_there_and_back(spark):
    assert len(L.POINTS) == len(set(L.POINTS)) == 83 and L.POINTS[0] == "contour_chin" and L.POINTS[-1] == "right_eyebrow_upper_right_quarter"
    points = {n: (i, -i) for i, n in enumerate(L.POINTS)}
    rows = spark.createDataFrame([(dict(reversed(points.items())),), (None,)], "m map<string,struct<x:long,y:long>>").coalesce(1)
    texts = rows.select(L.encode(F.col("m")).alias("t"))
    got = texts.select("t", L.decode(F.col("t")).alias("m")).collect()
    assert got[0].t.startswith("0,0;1,-1;2,-2;") and {n: tuple(p) for n, p in got[0].m.items()} == points
    assert got[1].t is None and got[1].m is None


def test_another_number_of_points_is_an_error(spark):
    few = spark.createDataFrame([({"contour_chin": (1, 2)},)], "m map<string,struct<x:long,y:long>>")
    with pytest.raises(Exception, match="83 points"):
        few.select(L.encode(F.col("m"))).collect()


def test_coordinates_are_read_as_far_as_they_are_numbers(spark):
    text = ";".join(["12.7,-3px", " 4,x", "5"] + ["0,0"] * 80)
    m = spark.createDataFrame([(text,)], "t string").select(L.decode(F.col("t")).alias("m")).first().m
    assert [tuple(m[n]) for n in L.POINTS[:3]] == [(12, -3), (4, None), (5, None)]


def test_corners_move_in_the_order_of_the_sides(spark):
    square = [(0.0, 0.0), (0.0, 10.0), (10.0, 10.0), (10.0, 0.0)]
    corners = [(F.lit(x), F.lit(y)) for x, y in square]
    at = lambda **rates: [tuple(r) for r in spark.range(1).select(*[F.struct(x.alias("x"), y.alias("y")) for x, y in expanded_quad(corners, **rates)]).first()]
    assert at() == square
    assert at(top=10) == [(0.0, -1.0), (0.0, 10.0), (10.0, 10.0), (10.0, -1.0)]
    assert at(top=10, right=20, left=30, bottom=40) == [(-3.0, 0.0), (0.0, 14.0), (10.0, 14.0), (12.0, 0.0)]


@pytest.mark.parametrize("name", ["encode_landmarks", "decode_landmarks"])
def test_rows_of_one_file_are_dealt_to_many_tasks(spark, name):
    assert spark.read.parquet("/root/testdata/sf0.01/part.parquet").rdd.getNumPartitions() == 1
    assert QUERIES[name](spark, "/root/testdata/sf0.01").rdd.getNumPartitions() == 8
