"""Selections against their SQL where scores tie, and budgets."""

import duckdb
import pytest

import __spark_entry__ as entry
from tideline.operators import select as S


def table_of(spark, path, videos):
    """events of the given videos: lists of values, one frame a minute."""
    rows = [(1000 * v + k, 60 * k, v, "view", float(x), '{"k": 7}') for v, values in videos.items() for k, x in enumerate(values)]
    d = spark.createDataFrame(rows, "event_id long, at long, user_id long, event_type string, value double, props string")
    d.selectExpr("event_id", "cast(timestamp_seconds(at) as timestamp_ntz) as ts", "user_id", "event_type", "value", "props").coalesce(1).write.parquet(f"{path}/events.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet/*.parquet'")
    return c


@pytest.mark.parametrize("name", ["budget_knapsack", "summary_mask"])
def test_equal_sums_go_by_the_last_shot(spark, tmp_path, name):
    """Shots of equal length with few values: most best sets tie, some only up to the last bit of a sum."""
    videos = {v: [[9.0, 1.1, 2.2, 3.3, 0.1, 0.2, 0.3][(k // 7 * (v + 3) + v + k * (v % 2)) % 7] for k in range(98)] for v in range(40)} | {50: [1.0] * 98, 51: [5.0]}
    c = table_of(spark, str(tmp_path), videos)
    got = sorted(tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).collect())
    assert got == sorted(c.execute(entry.oracle_sql()[name]).fetchall()) and got
    if name == "budget_knapsack":
        assert [s for v, s in got if v == 50] == [0, 1]


def test_the_last_bit_of_a_mean_decides_nothing(spark):
    """0.1 + 0.2 and 0.3 are one sum, whichever engine added it up; before, the shot with the last bit won."""
    for means in ((0.3, 0.1 + 0.2), (0.1 + 0.2, 0.3)):
        d = spark.createDataFrame([(1, k, 7 * k + 6, 7, m) for k, m in enumerate([*means, *[0.01] * 5])], "video_id long, shot_id int, end_f int, length int, mean double")
        assert [r.shot_id for r in S.budget_knapsack(d, 0.15).collect()] == [0]


def test_edits_use_the_whole_budget(spark):
    """30 seconds of up to eight clips, not 20 of six."""
    rows = entry.queries()["greedy_clip_selection"](spark, "/root/testdata/sf0.001").collect()
    length = {}
    for r in rows:
        length[r.video_id] = length.get(r.video_id, 0.0) + r["end"] - r["start"]
    assert 20.001 < max(length.values()) < 30.001 and all(r["end"] - r["start"] > 2 - 1e-6 for r in rows)
