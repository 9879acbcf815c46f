"""Sentences are parsed once a line, whatever is filtered on what was parsed."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions import sentence
from plumbline.plans.registry import QUERIES


@pytest.mark.parametrize("name", ["read_window_limit", "nmea_invalid_filter", "valid_frame_index", "infer_frequency"])
def test_filters_do_not_parse_again(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE(") == 1 and plan.count("try_cast(") <= 2


def test_rows_are_those_of_the_column(spark):
    good = [f"GPGGA,12000{k},,,,,1,08,1.0,{k}.5,{'M' if k % 2 else ''},0.0,M,," for k in range(6)]
    lines = ["", None, "no sentence", "$GPGGA", "$GPRMC,1*00", "$GPGGA,1,,,,,,,,x,M,,*00", "$*", *(f"  ${p}*00 " for p in good)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string").union(
        spark.createDataFrame([(100 + i, p) for i, p in enumerate(good)], "i int, p string").select("i", F.concat(F.lit("$"), "p", F.lit("*"), sentence.checksum(F.col("p"))))
    )
    wanted = sorted((r.i, *r.f) for r in df.select("i", sentence.parse(F.col("line")).alias("f")).collect() if r.f is not None)
    got = sorted(tuple(r) for r in df.select("i", sentence.parsed_rows(F.col("line"))).collect())
    assert str(got) == str(wanted) and len(got) == 13 and sum(r[-1] for r in got) == 6
