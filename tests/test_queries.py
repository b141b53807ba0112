"""Registered queries against their SQL on the small tables (a sample of them; the driver runs all)."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = ["minmax_per_group", "bitemporal_calibration", "threshold_segments", "peak_grow", "temporal_nms", "asof_linear", "interval_iou_join", "margin_pair_mining", "summary_f1", "kendall_tau_b", "soft_ece", "event_f1", "pair_accuracy_by_quantile", "budget_knapsack", "label_diffusion", "annotation_tsv", "split_manifest", "stream_tumbling_segments", "random_split", "augment_timeline", "bfs_sample", "greedy_clip_selection", "clip_verifier_plugin", "tolerance_match_unique", "personalized_pagerank", "pca_project", "score_regression", "cross_validation_run", "stream_incremental_scores", "stream_trailing_buffer", "peak_valley_pairing", "global_similarity_edges", "frames_in_clip_join", "evaluation_report", "highlight_run"]


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_same_as_sql(spark, db, name):
    df, sql = entry.queries()[name](spark, SF), entry.oracle_sql()[name]
    cols = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=str)
    want = sorted((tuple(map(plain, r)) for r in db.execute(f"select {', '.join(f'\"{c}\"' for c in cols)} from ({sql})").fetchall()), key=str)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
