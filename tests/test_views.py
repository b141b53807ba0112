"""Views as a Spark job: neighbours without joins, tasks that follow the input."""

import __spark_entry__ as entry
from tideline.operators import timeline as T
from tideline.sources import views
from tideline.sources.views import frames, pair_results

SF = "/root/testdata/sf0.001"


def plan(d):
    return d._jdf.queryExecution().optimizedPlan().toString() + d._jdf.queryExecution().sparkPlan().toString()


def test_pairs_of_neighbours_without_a_join(spark):
    d = pair_results(spark, SF)
    assert "Join" not in plan(d)
    by = {}
    for r in frames(spark, SF).collect():
        by.setdefault(r.video_id, {})[r.idx] = r
    want = {(v, i, j): (a.gt - b.gt, a.score - b.score) for v, f in by.items() for i, a in f.items() for j, b in f.items() if abs(i - j) <= 5 and a.gt > b.gt}
    got = {(r.video_id, r.chosen, r.rejected): (r.human_gap, r.base_gap) for r in d.collect()}
    assert got == want and d.count() == len(want)


def test_tasks_follow_the_rows(spark, monkeypatch):
    """A task's memory must not grow with the table: more rows make more tasks."""
    n = {"frames": spark.read.parquet(f"{SF}/events.parquet").count(), "run_log": spark.read.parquet(f"{SF}/lineitem.parquet").count()}
    few = {name: sorted(map(str, getattr(views, name)(spark, SF).collect())) for name in n}
    monkeypatch.setattr(views, "ROWS_A_TASK", 50)
    for name, rows in n.items():
        d = getattr(views, name)(spark, SF)
        assert f"{rows // 50}), REPARTITION_BY_NUM" in d._jdf.queryExecution().executedPlan().toString() and sorted(map(str, d.collect())) == few[name]


def test_a_row_knows_its_chunks(spark):
    """The same chunks as listed, for lengths around those of chunks; and no row is joined for their average."""
    d = spark.createDataFrame([(n, k, 0.5) for n in (1, 7, 8, 9, 11, 12, 20, 21) for k in range(n)], "video_id long, idx int, score double")
    for size, stride in ((8, 4), (8, 8), (4, 7)):
        want = {(r.video_id, r.idx, r.chunk) for r in T.overlap_chunks(d, size, stride).where("valid").collect()}
        assert {(r.video_id, r.idx, c) for r in T.chunks_of(d, size, stride).collect() for c in r.chunks} == want
    assert "Join" not in plan(entry.queries()["overlap_average"](spark, SF))
