"""The composed run: from frames to the clips of an edit."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators import intervals as I
from tideline.operators import timeline as T
from tideline.operators.graph import cut_lineage
from tideline.operators.models import clip_verifier, scorer_plugin
from tideline.operators.select import greedy_clip_selection


def proposals(frames: DataFrame, score_frames: Callable[[], Callable[[pd.DataFrame], pd.Series]], score_clip: Callable[[pd.DataFrame], float], shortest: float = 2.0, longest: float = 6.0, verify: int = 8, lead: float = 5.0, most: int = 12) -> DataFrame:
    """video_id, p, peak, start, end, frame_score, clip_score, rank_score, lead_in: clips that grow from the peaks of the scored and calibrated curve, without overlap, the best ones verified.

    Detection, suppression and verification use the grown windows; then each starts up to `lead` seconds earlier. Curves are rounded to nine digits, so that a plateau is one
    however its values were summed.
    """
    scored = scorer_plugin(frames, score_frames, "score")
    curve = cut_lineage(T.bitemporal(scored.select("video_id", "idx", "t", "score")).withColumn("calibrated", F.round("calibrated", 9)))
    grown = cut_lineage(T.peak_grow(curve.select("video_id", "idx", "t", "calibrated"), "calibrated", shortest=shortest, longest=longest))
    kept = I.temporal_nms(grown.select("video_id", "p", "peak", "start", "end", "frame_score"), F.round("frame_score", 9), most=most)
    return I.lead_in(clip_verifier(cut_lineage(kept), frames, score_clip, top=verify, width=longest), lead)


def highlight_run(frames: DataFrame, score_frames: Callable[[], Callable[[pd.DataFrame], pd.Series]], score_clip: Callable[[pd.DataFrame], float], target: float = 20.0, most: int = 6, **settings) -> DataFrame:
    """video_id, start, end, peak, score, merged: the clips of an edit of `target` seconds, from the proposals as their verified scores rank them."""
    found = proposals(frames, score_frames, score_clip, **settings)
    return greedy_clip_selection(found.withColumn("score", F.col("rank_score")), target=target, most=most)
