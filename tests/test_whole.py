"""Queries over every id and step, against SQL or plain loops."""

import collections

import pytest
from pyspark.sql import functions as F
from test_queries import SF, db, plain  # noqa: F401  (db is a fixture)

import __spark_entry__ as entry
from tideline.operators import graph as G
from tideline.operators import metrics as M
from tideline.operators import timeline as T
from tideline.operators.tables import contains_join_first
from tideline.streaming import streams as S


@pytest.mark.parametrize("name", ["aligned_sample_windows_all", "scalar_log_scan_all", "media_inventory_all", "margin_pair_mining_reference", "class_subsample_reference", "class_cohesion_whole", "stream_incremental_curve"])
def test_same_as_whole_sql(spark, db, name):  # noqa: F811
    df, sql = entry.queries()[name](spark, SF), entry.oracle_sql()[name]
    cols = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=str)
    want = sorted((tuple(map(plain, r)) for r in db.execute(f"select {', '.join(f'\"{c}\"' for c in cols)} from ({sql})").fetchall()), key=str)
    assert got == want


def test_ema_of_every_step(spark, db):  # noqa: F811
    runs = collections.defaultdict(list)
    for run, value in db.execute("select l_suppkey, l_extendedprice from lineitem order by l_suppkey, l_orderkey, l_linenumber, l_partkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax").fetchall():
        runs[run].append(float(value))
    want = {}
    for run, values in runs.items():
        e = values[0]
        for step, v in enumerate(values):
            e = 0.9 * e + 0.1 * v if step else v
            want[run, step] = e
    got = {(r.run, r.step): r.ema for r in entry.queries()["ema_smooth_all"](spark, SF).collect()}
    assert got.keys() == want.keys() and max(s for _, s in got) >= 40
    assert all(abs(got[k] - want[k]) < 1e-3 for k in want)


def test_cohesion_by_pairs(spark):
    """Every row counts, also beyond 20 a class."""
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(c, rng.normal(c, 1, 5).tolist()) for c in range(3) for _ in range((30, 1, 25)[c])] + [(0, [0.0] * 5), (1, None)]
    got = {(r.c1, r.c2): (r["mean"], r["std"]) for r in M.cohesion(spark.createDataFrame(rows, "c long, x array<double>").repartition(3), "c", "x").collect()}
    unit = [(c, np.array(x) / np.linalg.norm(x)) for c, x in rows if x and any(x)]
    pairs = collections.defaultdict(list)
    for k, (c, x) in enumerate(unit):
        for d, y in unit[k + 1 :]:
            pairs[c, d].append(x @ y)
    assert got.keys() == pairs.keys() and (1, 1) not in got
    for k, v in pairs.items():
        assert got[k] == pytest.approx((np.mean(v), np.std(v)), abs=1e-9)


def bfs_loop(edges, seeds, most):
    near = collections.defaultdict(dict)
    for a, b, w in edges:
        near[a][b] = near[b][a] = w
    held, front = list(seeds), set(seeds)
    while len(held) < most:
        new = {n for a in front for n in near[a]} - set(held)
        if not new:
            break
        ranked = sorted(new, key=lambda n: (-max((w for s, w in near[n].items() if s in seeds), default=0), n))
        held += ranked[: most - len(held)]
        front = set(ranked)
    return set(held)


def test_bfs_sample(spark):
    """A chain is followed to its end or the budget, and an edge to a seed goes before a better one to another node."""
    edges = {1: [(i, i + 1, 0.0) for i in range(30)], 2: [(i, i + 1, 0.0) for i in range(6)], 3: [(0, 1, 0.2), (0, 2, 0.3), (1, 3, 0.9), (2, 4, 0.4), (0, 5, 0.25), (3, 6, 0.9), (4, 6, 0.1)]}
    e = spark.createDataFrame([(v, *x) for v, rows in edges.items() for x in rows], "video_id long, i int, j int, w double")
    seeds = spark.createDataFrame([(v, 0) for v in edges], "video_id long, idx int")
    for most in (3, 12):
        got = collections.defaultdict(set)
        for r in G.bfs_sample(G.both_ways(e), seeds, most).collect():
            got[r.video_id].add(r.idx)
        assert got == {v: bfs_loop(rows, [0], most) for v, rows in edges.items()}
    assert len(got[1]) == 12 and len(got[2]) == 7


def test_pagerank_sample(spark):
    import numpy as np

    edges, seeds = collections.defaultdict(list), {3, 20}
    for r in entry.queries()["temporal_graph"](spark, SF).collect():
        edges[r.video_id].append((r.i, r.j, r.w))
    got = collections.defaultdict(set)
    for r in entry.queries()["personalized_pagerank_sample"](spark, SF).collect():
        got[r.video_id].add(r.idx)
    assert got.keys() == edges.keys()
    for v, rows in edges.items():
        n = max(j for _, j, _ in rows) + 1
        w = np.zeros((n, n))
        for i, j, x in rows:
            w[i, j] = w[j, i] = x
        start = np.array([(i in seeds) / 2 for i in range(n)])
        p = np.linalg.solve(np.eye(n) - 0.85 * (w / w.sum(axis=1, keepdims=True)).T, 0.15 * start)
        rest = sorted((i for i in range(n) if i not in seeds), key=lambda i: -p[i])
        assert len(got[v]) == 12 and seeds <= got[v]
        least = p[rest[9]]
        assert all(p[i] >= least - 1e-4 for i in got[v]), v  # ranks closer than the tolerance may change places


@pytest.mark.parametrize("more", [0, 10_001])
def test_contains_join_first_at_any_size(spark, more):
    """The needle decides, inside a piece as well, however many names there are; no file holds the added names."""
    few = ["ab", "abc", "a", "lang", "x.y", "", "longer name", "nowhere"]
    files = [(3, "/d/ab/f"), (1, "/d/xabcx.mp4"), (2, "/d/lang"), (5, "/x.y/lang/ab"), (4, "/p/longer name_1.mp4"), (6, None)]
    names = spark.createDataFrame([(n,) for n in few + [f"zz{k}zz" for k in range(more)]] + [(None,)], "name string")
    f = spark.createDataFrame(files, "i long, path string")
    for needle, text in ((F.col("name"), "{}"), (F.concat(F.lit("/"), F.col("name"), F.lit("/")), "/{}/")):
        got = {r.name: r.i for r in contains_join_first(names, f, needle, "name", "path", "i").collect()}
        found = {n: [i for i, p in files if p and text.format(n) in p] for n in few}
        assert got == {n: min(v) for n, v in found.items() if v}


@pytest.mark.parametrize("size,chunk,most", [(40, 10, 15), (80, 20, 20)])
def test_trailing_buffer(spark, size, chunk, most):
    """Four chunks of a video, the last `most` frames scored anew with each, against the operator on slices; batches end elsewhere than chunks."""
    rows = [(1, i, i * 7 % 13 / 13) for i in range(size)]
    d = spark.createDataFrame(rows, "video_id long, idx int, score double").withColumn("ts", F.timestamp_seconds("idx")).withColumn("n_frames", F.lit(size))
    got = {(r.video_id, r.idx): (r.n, r["mean"]) for r in S.trailing_curve(spark, S.replay(spark, d, files=3), chunk=chunk, most=most).collect()}
    edges = [(max(0, b - most), b) for b in range(chunk, size + 1, chunk)]
    parts = [(k, i - a, s) for k, (a, b) in enumerate(edges) for _, i, s in rows if a <= i < b]
    sums = collections.defaultdict(list)
    for r in T.bitemporal(spark.createDataFrame(parts, "video_id long, idx int, score double")).collect():
        sums[1, r.idx + edges[r.video_id][0]].append(r.calibrated)
    assert got.keys() == sums.keys() == {(v, i) for v, i, _ in rows}
    assert all(got[k] == (len(x), pytest.approx(sum(x) / len(x), abs=1e-9)) for k, x in sums.items())
    with pytest.raises(ValueError, match="chunk"):
        S.trailing_curve(spark, d, chunk=16, most=15)
