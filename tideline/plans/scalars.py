"""Projections and filters."""

from pyspark.sql import functions as F

from tideline.functions import scalars as S
from tideline.functions.scalars import r6
from tideline.plans.registry import query
from tideline.sources.views import video, conversations_text, frames, table

LOGITS = ", z AS (SELECT video_id, idx, score * 6 - 3 AS yes, 3 - gt * 6 AS no FROM frames)\n"


def logits(spark, sf):
    return frames(spark, sf).select("video_id", "idx", (F.col("score") * 6 - 3).alias("yes"), (3 - F.col("gt") * 6).alias("no"))


@query("sigmoid_score", "frames", LOGITS + "SELECT video_id, idx, round(1 / (1 + exp(no - yes)), 6) AS p FROM z")
def sigmoid_score(spark, sf):
    return logits(spark, sf).select("video_id", "idx", r6(S.sigmoid(F.col("yes") - F.col("no"))).alias("p"))


@query("binary_softmax", "frames", LOGITS + "SELECT video_id, idx, round(exp(yes) / (exp(yes) + exp(no)), 6) AS p_yes, round(exp(no) / (exp(yes) + exp(no)), 6) AS p_no FROM z")
def binary_softmax(spark, sf):
    y, n = S.binary_softmax(F.col("yes"), F.col("no"))
    return logits(spark, sf).select("video_id", "idx", r6(y).alias("p_yes"), r6(n).alias("p_no"))


@query("contrast_confidence", "frames", "SELECT video_id, idx, round(greatest(score - gt, 0), 6) AS c1, round(pow(greatest(score - gt, 0), 2), 6) AS c2 FROM frames")
def contrast_confidence(spark, sf):
    return frames(spark, sf).select("video_id", "idx", r6(S.contrast(F.col("score"), F.col("gt"), 1)).alias("c1"), r6(S.contrast(F.col("score"), F.col("gt"))).alias("c2"))


@query("mass_weighted_probability", "frames", LOGITS + "SELECT video_id, idx, round((exp(yes) + exp(no)) / (exp(yes) + exp(no) + 1) / (1 + exp(no - yes)), 6) AS p FROM z")
def mass_weighted_probability(spark, sf):
    mass = (F.exp("yes") + F.exp("no")) / (F.exp("yes") + F.exp("no") + 1)
    return logits(spark, sf).select("video_id", "idx", r6(S.sigmoid(F.col("yes") - F.col("no")) * mass).alias("p"))


@query("log_sigmoid", "frames", LOGITS + "SELECT video_id, idx, round(-ln(1 + exp(no - yes)), 6) AS v FROM z")
def log_sigmoid(spark, sf):
    return logits(spark, sf).select("video_id", "idx", r6(S.log_sigmoid(F.col("yes") - F.col("no"))).alias("v"))


@query(
    "amplifier_family", "frames",
    LOGITS + ", y AS (SELECT video_id, idx, yes - no AS d, (exp(yes - no) - 1) / (exp(yes - no) + 1) AS h FROM z) SELECT video_id, idx, round(d, 6) AS identity, round(d + 2 * h, 6) AS tanh, round(d * (1 + abs(h)), 6) AS abs_tanh, "
    "round(d * (1 + h * h), 6) AS tanh2, round(d * (1 + d * d / (1 + d * d)), 6) AS rational2, round(d * (1 + pow(d, 4) / (1 + pow(d, 4))), 6) AS rational4 FROM y",
)
def amplifier_family(spark, sf):
    d = F.col("yes") - F.col("no")
    return logits(spark, sf).select("video_id", "idx", *[r6(S.amplify(d, k)).alias(k) for k in ("identity", "tanh", "abs_tanh", "tanh2", "rational2", "rational4")])


@query(
    "affine_log_odds", "frames",
    LOGITS + ", f AS (SELECT video_id, regr_slope(no, yes) AS a, regr_intercept(no, yes) AS b FROM z GROUP BY video_id) SELECT video_id, idx, round(1 / (1 + exp(-(a * yes + b))), 6) AS p FROM z JOIN f USING (video_id)",
)
def affine_log_odds(spark, sf):
    z = logits(spark, sf)
    fit = z.groupBy("video_id").agg(F.regr_slope("no", "yes").alias("a"), F.regr_intercept("no", "yes").alias("b"))
    return z.join(fit, "video_id").select("video_id", "idx", r6(S.sigmoid(F.col("a") * F.col("yes") + F.col("b"))).alias("p"))


@query("log_margin", "pair_results frames", "SELECT video_id, chosen, rejected, round(ln(c.gt + 1e-6) - ln(r.gt + 1e-6), 6) AS log_margin, round(ln(c.gt + 1e-5) - ln(r.gt + 1e-5), 6) AS log_margin_wide, round(human_gap, 6) AS margin FROM pair_results p JOIN frames c USING (video_id) JOIN frames r USING (video_id) WHERE c.idx = chosen AND r.idx = rejected")
def log_margin(spark, sf):
    f = frames(spark, sf).select("video_id", "idx", "gt")
    a = f.select("video_id", F.col("idx").alias("chosen"), F.col("gt").alias("c"), F.explode(F.sequence(F.col("idx") - 5, F.col("idx") + 5)).alias("rejected"))
    p = a.join(f.select("video_id", F.col("idx").alias("rejected"), F.col("gt").alias("r")), ["video_id", "rejected"]).where("c > r")
    m = lambda e: r6(F.log(F.col("c") + e) - F.log(F.col("r") + e))
    return p.select("video_id", "chosen", "rejected", m(1e-6).alias("log_margin"), m(1e-5).alias("log_margin_wide"), r6(F.col("c") - F.col("r")).alias("margin"))


@query("minmax_per_group", "frames", """, m AS (SELECT video_id, min(value) AS lo, max(value) AS hi FROM frames GROUP BY video_id) SELECT video_id, idx, round((value - lo) / (hi - lo + 1e-8), 6) AS eps,
round(CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE value END, 6) AS kept, round(CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE 0 END, 6) AS zero FROM frames JOIN m USING (video_id)""")
def minmax_per_group(spark, sf):
    v = F.col("value")
    return frames(spark, sf).select("video_id", "idx", r6(S.minmax(v, video())).alias("eps"), r6(S.minmax(v, video(), "keep")).alias("kept"), r6(S.minmax(v, video(), "zero")).alias("zero"))


@query("normalize_columns", "pair_results", ", m AS (SELECT min(base_gap) AS lo, max(base_gap) AS hi, max(abs(tuned_gap)) AS top FROM pair_results) SELECT video_id, chosen, rejected, round((base_gap - lo) / (hi - lo), 6) AS base_n, round(0.5 + 0.5 * tuned_gap / top, 6) AS tuned_n FROM pair_results CROSS JOIN m")
def normalize_columns(spark, sf):
    from tideline.operators.tables import normalize
    from tideline.sources.views import pair_results

    d = normalize(normalize(pair_results(spark, sf), ["base_gap", "absent"], "minmax"), ["tuned_gap"], "symmetric")
    return d.select("video_id", "chosen", "rejected", r6("base_gap").alias("base_n"), r6("tuned_gap").alias("tuned_n"))


@query("clip_unit", "frames", "SELECT video_id, idx, round(least(greatest(score * 2 - 0.5, 0.0), 1.0), 6) AS c FROM frames")
def clip_unit(spark, sf):
    return frames(spark, sf).select("video_id", "idx", r6(S.clip01(F.col("score") * 2 - 0.5)).alias("c"))


@query("clamp_index", "frames", """, n AS (SELECT video_id, count(*) AS n FROM frames GROUP BY video_id), p AS (SELECT video_id, idx, least(greatest(idx * 2 - 3, 0), n - 1) AS pick FROM frames JOIN n USING (video_id))
SELECT video_id, CAST(pick AS BIGINT) AS pick, min(idx) AS idx FROM p GROUP BY video_id, pick""")
def clamp_index(spark, sf):
    from tideline.operators.tables import first_per

    f = frames(spark, sf).select("video_id", "idx", F.count("*").over(video()).alias("n"))
    p = f.select("video_id", "idx", F.least(F.greatest(F.col("idx") * 2 - 3, F.lit(0)), F.col("n") - 1).cast("long").alias("pick"))
    return first_per(p, ["video_id", "pick"], ["idx"])


@query("format_mmss", "segments", """SELECT video_id, string_agg('[' || lpad(CAST(CAST(floor(seg_start / 60) AS INT) AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor(seg_start) AS INT) % 60 AS VARCHAR), 2, '0') || ' - ' ||
lpad(CAST(CAST(floor(seg_end / 60) AS INT) AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor(seg_end) AS INT) % 60 AS VARCHAR), 2, '0') || '] ' || text, chr(10) ORDER BY turn) AS transcript FROM segments GROUP BY video_id""")
def format_mmss(spark, sf):
    from tideline.sources.views import segments

    line = F.concat(F.lit("["), S.mmss(F.col("seg_start")), F.lit(" - "), S.mmss(F.col("seg_end")), F.lit("] "), F.col("text"))
    g = segments(spark, sf).groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))).alias("l"))
    return g.select("video_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("transcript"))


@query("parse_mmss", "frames", "SELECT video_id, idx, CAST(CASE WHEN idx % 7 = 3 THEN 0 ELSE k + idx * 10 END AS INT) AS seconds FROM frames")
def parse_mmss(spark, sf):
    f = frames(spark, sf).withColumn("s", F.col("k") + F.col("idx") * 10)
    text = F.when(F.col("idx") % 7 == 3, F.lit("[soon]")).otherwise(F.concat(F.lit("["), S.mmss(F.col("s")), F.lit("]")))
    return f.select("video_id", "idx", S.parse_mmss(text).alias("seconds"))


@query("clip_window_from_hit", "frames", """SELECT video_id, idx, greatest(t - 10, 0) AS start_wide, greatest(t + 5, greatest(t - 10, 0) + 2) AS end_wide, greatest(t - 5, 0) AS start_even, greatest(t + 5, greatest(t - 5, 0) + 3) AS end_even FROM frames WHERE score > 0.5""")
def clip_window_from_hit(spark, sf):
    (a, b), (c, d) = S.clip_window(F.col("t"), 10, 5, 2), S.clip_window(F.col("t"), 5, 5, 3)
    return frames(spark, sf).where("score > 0.5").select("video_id", "idx", a.alias("start_wide"), b.alias("end_wide"), c.alias("start_even"), d.alias("end_even"))


@query("clean_caption", "", """SELECT conv_id, turn, array_to_string(list_slice(string_split(regexp_replace(split_part(text, chr(10), 1), '#[^ \\t]+', '', 'g'), ' '), 1, 8), ' ') AS caption FROM conversations""")
def clean_caption(spark, sf):
    return conversations_text(spark, sf).select("conv_id", "turn", S.clean_caption(F.col("text")).alias("caption"))


@query("yes_no_prompt_predicate", "", """SELECT conv_id, turn, regexp_matches(lower(text), '(^|[^a-z])the([^a-z]|$)') AND regexp_matches(lower(text), '(^|[^a-z])of([^a-z]|$)') AS both_words,
regexp_matches(lower(text), '(^|[^a-z])yes([^a-z]|$)') AND regexp_matches(lower(text), '(^|[^a-z])no([^a-z]|$)') AS asks, regexp_matches(text, '[\\x{4E00}-\\x{9FFF}]') AS cjk FROM conversations""")
def yes_no_prompt_predicate(spark, sf):
    low = F.lower("text")
    word = lambda w: F.rlike(low, F.lit(rf"(?<![a-z]){w}(?![a-z])"))
    return conversations_text(spark, sf).select("conv_id", "turn", (word("the") & word("of")).alias("both_words"), S.asks_yes_no(F.col("text")).alias("asks"), F.rlike("text", F.lit("[\\x{4E00}-\\x{9FFF}]")).alias("cjk"))


@query("tag_match_first", "", """SELECT conv_id, turn, CASE WHEN contains(lower(text), 'ingth') THEN 'ingth' WHEN contains(lower(text), 'auaux') THEN 'auaux' WHEN contains(lower(text), 'the') THEN 'the' WHEN contains(lower(text), 'der') THEN 'der' ELSE 'other' END AS tag FROM conversations""")
def tag_match_first(spark, sf):
    return conversations_text(spark, sf).select("conv_id", "turn", S.first_tag(F.col("text"), ["ingth", "auaux", "the", "der"]).alias("tag"))


@query("title_keyword_split", "", """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url ELSE 'page ' || page_id END AS title, CASE WHEN page_id % 3 = 0 THEN '' ELSE 'a' || page_id || ', b, c' END AS keywords, CAST(CASE WHEN page_id % 3 = 0 THEN 0 ELSE 3 END AS INT) AS n_keywords FROM pages""")
def title_keyword_split(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url")
    answer = F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(F.concat(F.lit("Title: page "), F.col("page_id"), F.lit(" | a"), F.col("page_id"), F.lit(", b, c")))
    bar = F.contains("answer", F.lit("|"))
    p = p.withColumn("answer", answer).withColumn("title", F.trim(F.regexp_replace(F.when(bar, F.element_at(F.split("answer", "\\|"), 1)).otherwise(F.col("answer")), "^Title: ", "")))
    keys = F.when(bar, F.trim(F.element_at(F.split("answer", "\\|"), 2))).otherwise("")
    return p.select("page_id", "title", keys.alias("keywords"), F.when(keys == "", 0).otherwise(F.size(F.split(keys, ","))).alias("n_keywords"))


@query("url_id_extract", "", "SELECT page_id, regexp_extract(url, '([A-Za-z0-9_-]{11})', 1) AS id FROM pages WHERE regexp_matches(url, '[A-Za-z0-9_-]{11}')")
def url_id_extract(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "([A-Za-z0-9_-]{11})", 1).alias("id"))
    return p.where("id <> ''")


@query("safe_slug", "", "SELECT page_id, substr(regexp_replace(trim(regexp_replace(url, '[^A-Za-z0-9_ \\-]', '', 'g')), '[ \\-]+', '_', 'g'), 1, 40) AS slug FROM pages")
def safe_slug(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.slug(F.col("url")).alias("slug"))


@query("filename_title_normalise", "", """, x AS (SELECT 1), n AS (SELECT page_id, rtrim('clip ' || page_id || ' of ' || (page_id % 7) || '__', '_') AS stem FROM pages), a AS (SELECT page_id, stem AS alias, stem FROM n UNION SELECT page_id, replace(stem, ' ', '_'), stem FROM n)
SELECT page_id, alias, trim(replace(stem, '_', ' ')) AS title FROM a""".replace(", x AS (SELECT 1), n", "WITH n", 1))
def filename_title_normalise(spark, sf):
    name = F.concat(F.lit("clip "), F.col("page_id"), F.lit(" of "), F.col("page_id") % 7, F.lit("__.mp4"))
    p = table(spark, sf, "pages").select("page_id", F.regexp_replace(F.regexp_replace(name, r"\.[A-Za-z0-9]+$", ""), "_+$", "").alias("stem"))
    return p.select("page_id", F.explode(F.array_distinct(F.array("stem", F.replace("stem", F.lit(" "), F.lit("_"))))).alias("alias"), F.trim(F.replace("stem", F.lit("_"), F.lit(" "))).alias("title"))


@query("stride_sample", "frames", "SELECT video_id, idx, idx / 29.97 AS at FROM frames WHERE idx % 14 = 0")
def stride_sample(spark, sf):
    step = max(1, int(29.97 / 2.1))
    return frames(spark, sf).where(F.col("idx") % step == 0).select("video_id", "idx", (F.col("idx") / 29.97).alias("at"))


@query("segment_phase_sample", "frames", """, n AS (SELECT video_id, count(*) AS n FROM frames GROUP BY video_id), s AS (SELECT video_id, n, unnest(range(0, greatest(CAST(floor(n / 2.5) AS BIGINT), 1), 8)) AS s FROM n)
SELECT video_id, s AS segment, CAST(unnest(range(CAST(floor(s * 2.5) AS BIGINT), least(CAST(floor((s + 8) * 2.5) AS BIGINT), n), 3)) AS BIGINT) AS frame FROM s""")
def segment_phase_sample(spark, sf):
    from tideline.operators.timeline import segment_phase_samples

    v = frames(spark, sf).groupBy("video_id").agg(F.count("*").alias("n_frames"))
    return segment_phase_samples(v, fps=2.5, step=3, segment=8)


@query("evenly_spaced_pick", "frames", """, n AS (SELECT video_id, count(*) AS n FROM frames GROUP BY video_id), p AS (SELECT video_id, n, unnest(range(0, 6)) AS i FROM n)
SELECT p.video_id, CAST(i AS INT) AS i, idx, score FROM p JOIN frames f ON f.video_id = p.video_id AND f.idx = round_even(i * (n - 1) / 5, 0)""")
def evenly_spaced_pick(spark, sf):
    f = frames(spark, sf)
    n = f.groupBy("video_id").agg(F.count("*").alias("n")).select("video_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i"), "n")
    p = n.select("video_id", "i", F.bround(F.col("i") * (F.col("n") - 1) / 5).cast("int").alias("idx"))
    return p.join(f, ["video_id", "idx"]).select("video_id", "i", "idx", "score")


@query("error_columns", "frames", "SELECT video_id, idx, round(score - gt, 6) AS bias, round(abs(score - gt), 6) AS abs_bias, round((score - gt) * (score - gt), 6) AS sq_error FROM frames")
def error_columns(spark, sf):
    return frames(spark, sf).select("video_id", "idx", *[r6(c).alias(k) for k, c in S.error_columns(F.col("score"), F.col("gt")).items()])


@query("outcome_flags", "frames", ", m AS (SELECT video_id, avg(score) AS m FROM frames GROUP BY video_id) SELECT video_id, idx, gt > 0.5 AS highlight, score > 0.5 AND gt < 0.2 AS false_positive, score >= m AND gt <= 0.5 AS soft_false_positive, score >= m AND gt > 0.5 AS hit FROM frames JOIN m USING (video_id)")
def outcome_flags(spark, sf):
    high, above = F.col("gt") > 0.5, F.col("score") >= F.avg("score").over(video())
    return frames(spark, sf).select("video_id", "idx", high.alias("highlight"), ((F.col("score") > 0.5) & (F.col("gt") < 0.2)).alias("false_positive"), (above & ~high).alias("soft_false_positive"), (above & high).alias("hit"))


@query("difficulty_buckets", "pair_results", """SELECT video_id, CASE WHEN 1 / (1 + exp(-4 * tuned_gap)) >= 0.7 THEN 'easy' WHEN 1 / (1 + exp(-4 * tuned_gap)) >= 0.3 THEN 'border' ELSE 'hard' END AS level,
CASE WHEN human_gap >= 0.5 THEN 'coarse' WHEN human_gap >= 0.25 THEN 'moderate' ELSE 'fine' END AS tier, count(*) AS n FROM pair_results GROUP BY 1, 2, 3""")
def difficulty_buckets(spark, sf):
    from tideline.sources.views import pair_results

    level, tier = S.difficulty(S.sigmoid(4 * F.col("tuned_gap"))), S.difficulty(F.col("human_gap"), 0.25, 0.5, ("fine", "moderate", "coarse"))
    return pair_results(spark, sf).groupBy("video_id", level.alias("level"), tier.alias("tier")).agg(F.count("*").alias("n"))


@query("temporal_proximity_label", "frames", "SELECT video_id, idx, CAST(CASE WHEN abs(t - 10) <= 2 OR abs(t - 31) <= 2 OR abs(t - 44.5) <= 2 THEN 1 ELSE 0 END AS INT) AS y FROM frames")
def temporal_proximity_label(spark, sf):
    near = F.exists(F.array(*map(F.lit, (10.0, 31.0, 44.5))), lambda g: F.abs(F.col("t") - g) <= 2)
    return frames(spark, sf).select("video_id", "idx", near.cast("int").alias("y"))


def seeded_sql(*parts: str, seed: int = 3) -> str:
    """A number in [0, 1] from the md5 of keys, as `tables.seeded` deals it."""
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)}, '{seed}')), 1, 8) AS BIGINT) / 4294967295.0"


@query(
    "augment_timeline", "frames",
    f", c AS (SELECT video_id, idx, score, gt, CAST(floor(idx / 16.0) AS INT) AS chunk FROM frames), d AS (SELECT *, CAST(floor({seeded_sql('video_id', 'chunk')} * 4.999) AS INT) - 2 AS shift, min(idx) OVER w AS first, max(idx) OVER w AS last FROM c WINDOW w AS (PARTITION BY video_id, chunk))"
    f" SELECT d.video_id, d.idx, d.chunk, round(s.gt, 6) AS gt, round(CASE WHEN d.chunk % 2 = 0 AND {seeded_sql('d.video_id', 'd.idx', chr(39) + 'z' + chr(39))} < 0.1 THEN 0.0 ELSE d.score + 0.1 * sqrt(-2 * ln(greatest({seeded_sql('d.video_id', 'd.idx', chr(39) + 'a' + chr(39))}, 1e-12))) * cos(2 * pi() * ({seeded_sql('d.video_id', 'd.idx', chr(39) + 'b' + chr(39))})) END, 6) AS score"
    " FROM d JOIN c s ON s.video_id = d.video_id AND s.idx = least(greatest(d.idx - d.shift, d.first), d.last)",
)
def augment_timeline(spark, sf):
    """Labels shifted by up to two frames a chunk, a tenth of some chunks' rows zeroed, noise by key."""
    from tideline.operators.timeline import augment

    d = augment(frames(spark, sf).select("video_id", "idx", "score", "gt"), chunk=16, seed=3)
    return d.select("video_id", "idx", "chunk", r6("gt").alias("gt"), r6("score").alias("score"))


