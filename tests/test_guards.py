"""Rows that a kernel fails on are set aside; logs are numbered split by split."""

import pandas as pd
import pytest

from plumbline.operators import quarantine as Q
from plumbline.sources import logs
from plumbline.streaming.run import stored


def keep(df):
    return stored(df, "guarded")


def double(rows: pd.DataFrame) -> pd.DataFrame:
    if rows["x"].isna().any():
        raise ValueError("nothing to double")
    return pd.DataFrame({"id": rows["id"], "y": rows["x"] * 2, "s": rows["s"]})


def test_bad_rows_are_set_aside_and_the_rest_is_as_it_was(spark):
    rows = [(i, None if i % 37 == 5 else float(i), None if i % 5 == 0 else f"s{i}", i) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, x double, s string, cause int").repartition(5)
    got = Q.guarded(df.drop("cause"), double, "id long, y double, s string", keep)
    good, bad = {r.id: (r.y, r.s) for r in got.good.collect()}, {r.id: (r.x, r.s, r.cause) for r in got.bad.collect()}
    assert good == {i: (2 * x, s) for i, x, s, _ in rows if x is not None}
    assert bad == {i: (None, s, "ValueError: nothing to double") for i, x, s, _ in rows if x is None}
    assert got.good.columns == ["id", "y", "s"] and got.bad.columns == ["id", "x", "s", "cause"]
    none = Q.guarded(df.drop("cause").limit(0), double, "id long, y double, s string", keep)
    assert none.good.count() == none.bad.count() == 0


def test_few_calls_for_few_bad_rows():
    calls = []

    def each(rows):
        calls.append(len(rows))
        return double(rows)

    rows = pd.DataFrame({"id": range(1024), "x": [1.0] * 1024, "s": ["a"] * 1024})
    assert len(list(Q._tried(rows, each))) == 1 and calls == [1024]
    rows.loc[700, "x"] = None
    found = list(Q._tried(rows, each))
    assert [len(r) for r, cause in found if cause] == [1] and sum(len(r) for r, cause in found if not cause) == 1023 and len(calls) < 24
    assert pd.concat([r for r, cause in found if not cause])["id"].tolist() == [i for i in range(1024) if i != 700]


def test_refused_rows_cost_a_call_for_each_cause():
    calls = []

    def each(rows):
        calls.append(len(rows))
        Q.refuse(rows["x"].isna(), ValueError("nothing to double"))
        Q.refuse(rows["x"] > 900, OverflowError("too much"))
        return double(rows)

    rows = pd.DataFrame({"id": range(1024), "x": [None if i % 3 == 0 else float(i) for i in range(1024)], "s": ["a"] * 1024})
    found = list(Q._tried(rows, each))
    assert len(calls) == 3 and [(len(r), c) for r, c in found[:2]] == [(342, "ValueError: nothing to double"), (82, "OverflowError: too much")]
    assert found[2][0]["id"].tolist() == [i for i in range(1024) if i % 3 and i <= 900] and found[2][1] is None


def test_whole_numbers_stay_whole(spark):
    rows = [(2**60 + i, None if i % 4 == 0 else float(i), "a") for i in range(64)]
    df = spark.createDataFrame(rows, "id long, x double, s string").coalesce(1)
    got = Q.guarded(df, double, "id long, y double, s string", keep)
    assert sorted(r.id for r in got.good.collect()) == [i for i, x, _ in rows if x is not None]
    assert sorted(r.id for r in got.bad.collect()) == [i for i, x, _ in rows if x is None]


def test_groups_fail_as_a_whole(spark):
    df = spark.createDataFrame([(k, i, None if (k, i) == (2, 3) else float(i), "a") for k in range(5) for i in range(6)], "key int, id int, x double, s string")
    total = lambda rows: pd.DataFrame({"key": [rows["key"].iloc[0]], "total": [double(rows)["y"].sum()]})
    got = Q.guarded(df, total, "key int, total double", keep, ["key"])
    assert sorted(map(tuple, got.good.collect())) == [(k, 30.0) for k in (0, 1, 3, 4)]
    assert sorted((r.key, r.id) for r in got.bad.collect()) == [(2, i) for i in range(6)] and {r.cause for r in got.bad.collect()} == {"ValueError: nothing to double"}


@pytest.mark.parametrize("size", ["64b", "1000b", "128m"])
def test_lines_are_numbered_across_splits(spark, tmp_path, size):
    texts = {"a.log": [f"line {i} " + "x" * (i % 40) for i in range(400)], "b.log": ["", "only", ""], "c.log": []}
    for name, lines in texts.items():
        (tmp_path / name).write_text("".join(f"{x}\n" for x in lines))
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = {}
        for r in logs.lines(spark, str(tmp_path)).collect():
            got.setdefault(r.file.rsplit("/", 1)[1], []).append((r.line_no, r.line))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    assert {k: sorted(v) for k, v in got.items()} == {k: list(enumerate(v, 1)) for k, v in texts.items() if v}
