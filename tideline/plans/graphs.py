"""Queries on frame graphs."""

from pyspark.sql import functions as F

from tideline.functions.scalars import r6
from tideline.operators import graph as G
from tideline.plans.joins import COS
from tideline.plans.registry import query
from tideline.sources.views import frame_features

EDGES = ", sim AS (SELECT a.video_id, a.idx AS i, b.idx AS j, greatest(" + COS.format(a="a.feature", b="b.feature") + """, 0) AS w FROM frame_features a JOIN frame_features b ON a.video_id = b.video_id AND b.idx > a.idx AND b.idx <= a.idx + 10),
g AS (SELECT video_id, i, j, w, 'similarity' AS edge_type FROM sim WHERE w >= 0.15 AND j - i > 1 UNION ALL SELECT video_id, idx, idx + 1, 1.0, 'backbone' FROM frame_features WHERE (video_id, idx + 1) IN (SELECT (video_id, idx) FROM frame_features)),
d AS (SELECT video_id, i AS src, j AS dst, w FROM g UNION ALL SELECT video_id, j, i, w FROM g), dl AS (SELECT * FROM d UNION ALL SELECT video_id, idx, idx, 1.0 FROM frame_features), tr AS (SELECT video_id, src, dst, w / (sum(w) OVER (PARTITION BY video_id, src) + 1e-8) AS w FROM dl),
tn AS (SELECT video_id, src, dst, w / sum(w) OVER (PARTITION BY video_id, src) AS w FROM d), lab AS (SELECT video_id, idx, (idx * 37 % 101) / 100.0 AS y0 FROM frame_features)
"""


def graph(spark, sf):
    return G.temporal_graph(frame_features(spark, sf), 10, 0.15)


def labels(spark, sf):
    return frame_features(spark, sf).select("video_id", "idx", (F.col("idx") * 37 % 101 / 100.0).alias("y0"))


def seeds(spark, sf):
    return frame_features(spark, sf).where("idx in (3, 20)").select("video_id", "idx")


@query("temporal_graph", "frame_features", EDGES + "SELECT video_id, i, j, round(w, 6) AS w, edge_type FROM g")
def temporal_graph(spark, sf):
    return graph(spark, sf).select("video_id", "i", "j", r6("w").alias("w"), "edge_type")


@query("row_normalise", "frame_features", EDGES + "SELECT video_id, src, dst, round(sum(w), 6) AS w, 'before' AS kind FROM tr GROUP BY 1, 2, 3 UNION ALL SELECT video_id, src, dst, round(w, 6), 'none' FROM tn UNION ALL SELECT video_id, src, dst, round(w, 6), 'after' FROM (SELECT * FROM tn UNION ALL SELECT video_id, idx, idx, 1.0 FROM frame_features) x")
def row_normalise(spark, sf):
    e, n = G.both_ways(graph(spark, sf)), frame_features(spark, sf)
    parts = [G.row_normalise(e, n, k).select("video_id", "src", "dst", r6("w").alias("w"), F.lit(k).alias("kind")) for k in ("before", "none", "after")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def step(y, k):
    return f", {y}{k + 1} AS (SELECT l.video_id, l.idx, 0.95 * y0 + 0.05 * m AS y FROM lab l JOIN (SELECT tr.video_id, src, sum(w * p.y) AS m FROM tr JOIN {y}{k} p ON p.video_id = tr.video_id AND p.idx = tr.dst GROUP BY 1, 2) q ON q.video_id = l.video_id AND q.src = l.idx)\n"


@query("label_diffusion", "frame_features", EDGES + ", y0 AS (SELECT video_id, idx, y0 AS y FROM lab)" + step("y", 0) + step("y", 1) + "SELECT video_id, idx, round(y, 6) AS y FROM y2")
def label_diffusion(spark, sf):
    n = frame_features(spark, sf)
    t = G.row_normalise(G.both_ways(graph(spark, sf)), n)
    return G.label_diffusion(t, labels(spark, sf), "y0", 0.05, 2).select("video_id", "idx", r6("y").alias("y"))


@query(
    "bfs_sample", "frame_features",
    EDGES + ", z AS (SELECT video_id, i AS src, j AS dst, CASE edge_type WHEN 'backbone' THEN 0.0 ELSE w END AS w FROM g UNION ALL SELECT video_id, j, i, CASE edge_type WHEN 'backbone' THEN 0.0 ELSE w END FROM g),"
    " nr AS (SELECT video_id, dst, max(w) AS w FROM z WHERE src IN (3, 20) GROUP BY 1, 2), ad AS (SELECT z.video_id, z.src, z.dst, -round(coalesce(nr.w, 0), 9) AS o FROM z LEFT JOIN nr ON nr.video_id = z.video_id AND nr.dst = z.dst),"
    " bf AS (WITH RECURSIVE b AS (SELECT video_id, CAST(0 AS INT) AS level, list(idx) AS held, list(idx) AS front FROM frame_features WHERE idx IN (3, 20) GROUP BY 1 UNION ALL"
    " SELECT video_id, CAST(level + 1 AS INT), list_concat(held, pick), pick FROM (SELECT b.video_id, b.level, b.held, list_transform(list_sort(list(DISTINCT {'o': a.o, 'i': a.dst}))[1:12 - len(b.held)], lambda x: x.i) AS pick FROM b JOIN ad a ON a.video_id = b.video_id AND list_contains(b.front, a.src) AND NOT list_contains(b.held, a.dst) GROUP BY 1, 2, 3) x WHERE len(pick) > 0)"
    " SELECT video_id, unnest(front) AS idx, level FROM b) SELECT video_id, idx, level FROM bf",
)
def bfs_sample(spark, sf):
    """Up to 12 nodes a video from two seeds. Backbone edges have no weight in the ranking."""
    e = graph(spark, sf).withColumn("w", F.when(F.col("edge_type") == "backbone", 0.0).otherwise(F.col("w")))
    return G.bfs_sample(G.both_ways(e), seeds(spark, sf), 12)


#: Two hundred rounds of the power iteration; every node has a row, if only by an edge of weight 0 to itself.
RANKED = (
    EDGES + ", sd AS (SELECT video_id, idx, 1.0 / count(*) OVER (PARTITION BY video_id) AS r FROM frame_features WHERE idx IN (3, 20)), nd AS (SELECT f.video_id, f.idx, coalesce(sd.r, 0) AS r FROM frame_features f LEFT JOIN sd USING (video_id, idx) WHERE f.video_id IN (SELECT video_id FROM sd)),"
    " tz AS (SELECT * FROM tn UNION ALL SELECT video_id, idx, idx, 0.0 FROM nd), fw AS (SELECT tz.video_id, src, dst, tz.w, nd.r FROM tz JOIN nd ON nd.video_id = tz.video_id AND nd.idx = tz.dst),"
    " pr AS (WITH RECURSIVE q AS (SELECT 0 AS k, video_id, idx, r AS p FROM nd UNION ALL SELECT q.k + 1, q.video_id, fw.dst, 0.85 * sum(fw.w * q.p) + 0.15 * any_value(fw.r) FROM q JOIN fw ON fw.video_id = q.video_id AND fw.src = q.idx WHERE q.k < 200 GROUP BY q.k, q.video_id, fw.dst) SELECT * FROM q WHERE k = 200),"
    " ot AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY round(p, 9) DESC, idx) AS rn FROM pr WHERE (video_id, idx) NOT IN (SELECT (video_id, idx) FROM sd))"
    " SELECT video_id, idx FROM ot WHERE rn <= 10 UNION ALL SELECT video_id, idx FROM sd"
)


@query("personalized_pagerank", "frame_features", RANKED)
@query("personalized_pagerank_sample", "frame_features", RANKED)
def personalized_pagerank(spark, sf):
    """The seeds and the ten best other nodes of each video, by settled ranks."""
    n = frame_features(spark, sf)
    ranks = G.personalized_pagerank(G.row_normalise(G.both_ways(graph(spark, sf)), n, "none"), seeds(spark, sf), n, tolerance=1e-12)
    return G.seeds_and_top(ranks, seeds(spark, sf), 10)


@query("seed_consensus_weights", "frame_features", EDGES + ", s AS (SELECT l.video_id, l.idx, coalesce(CASE WHEN idx % 3 = 0 THEN y0 END, avg(CASE WHEN idx % 3 = 0 THEN y0 END) OVER (PARTITION BY video_id)) AS s FROM lab l), c AS (SELECT tr.video_id, src AS idx, sum(w * s) AS c FROM tr JOIN s ON s.video_id = tr.video_id AND s.idx = tr.dst GROUP BY 1, 2) SELECT video_id, round(least(greatest(avg(CASE WHEN idx % 2 = 0 THEN c END) / avg(CASE WHEN idx % 2 = 1 THEN c END), 0.1), 5), 6) AS ratio FROM c GROUP BY 1")
def seed_consensus_weights(spark, sf):
    s = labels(spark, sf).select("video_id", "idx", F.when(F.col("idx") % 3 == 0, F.col("y0")).alias("score"))
    return G.consensus_ratio(G.both_ways(graph(spark, sf)), s, F.col("idx") % 2 == 0, F.col("idx") % 2 == 1).select("video_id", r6("ratio").alias("ratio"))


@query("laplacian_smoothness", "frame_features", ", l AS (SELECT video_id, idx, CAST(floor(idx / 8) AS INT) AS clip, feature, (idx * 37 % 101) / 100.0 AS p FROM frame_features), a AS (SELECT a.video_id, a.clip, b.idx AS j, a.p, b.p AS q, greatest(" + COS.format(a="a.feature", b="b.feature") + ", 0) AS a FROM l a JOIN l b ON a.video_id = b.video_id AND a.clip = b.clip), n AS (SELECT *, a / sum(a) OVER (PARTITION BY video_id, clip, j) AS an FROM a) SELECT video_id, clip, round(avg(an * (p - q) * (p - q)), 6) AS smoothness FROM n GROUP BY 1, 2")
def laplacian_smoothness(spark, sf):
    f = frame_features(spark, sf).withColumn("p", F.col("idx") * 37 % 101 / 100.0)
    return G.laplacian_smoothness(f, "p", F.floor(F.col("idx") / 8).cast("int")).select("video_id", "clip", r6("smoothness").alias("smoothness"))


@query("subgraph_window", "frame_features", EDGES + ", s AS (SELECT * FROM g WHERE i BETWEEN 5 AND 25 AND j BETWEEN 5 AND 25) SELECT video_id, i, j, round((w - min(w) OVER (PARTITION BY video_id)) / (max(w) OVER (PARTITION BY video_id) - min(w) OVER (PARTITION BY video_id) + 1e-8), 6) AS w FROM s")
def subgraph_window(spark, sf):
    return G.subgraph(graph(spark, sf), 5, 25).select("video_id", "i", "j", r6("w").alias("w"))
