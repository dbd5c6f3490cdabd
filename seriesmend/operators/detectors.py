"""Detectors by id, with the same parameter checks as corrections."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from seriesmend.model import SeriesSpec
from seriesmend.operators.correct import Param, checked_settings, correct, mark_rows
from seriesmend.operators.detect import detect_frozen, detect_spikes, score_frozen, score_spikes
from seriesmend.plans.blocks import Layout


@dataclass(frozen=True)
class Detector:
    """``run(df, spec, **params, layout, keep)`` returns the candidate rows.

    ``mark`` (optional) returns all rows with a boolean ``_picked`` instead, which
    lets a correction follow without joining the candidates back.
    """

    id: str
    run: Callable[..., DataFrame]
    params: tuple[Param, ...] = ()
    mark: Callable[..., DataFrame] | None = None

    def settings(self, given: dict | None) -> dict:
        return checked_settings(self.id, self.params, given)


DETECTORS: dict[str, Detector] = {}


def register_detector(detector: Detector) -> Detector:
    DETECTORS[detector.id] = detector
    return detector


def _mark_spikes(df, spec, window, z_thresh, layout, keep):
    scored = score_spikes(df, spec, window, layout, keep, "_score")
    return scored.withColumn("_picked", F.coalesce(F.col("_score") > z_thresh, F.lit(False)))


def _mark_frozen(df, spec, min_run_length, tolerance, layout, keep):
    scored = score_frozen(df, spec, tolerance, layout, keep, "_score")
    return scored.withColumn("_picked", F.col("_score") >= max(min_run_length, 2))


register_detector(
    Detector(
        "spike",
        detect_spikes,
        (Param("window", "int", 24), Param("z_thresh", "float", 4.0)),
        _mark_spikes,
    )
)
register_detector(
    Detector(
        "freeze",
        detect_frozen,
        (Param("min_run_length", "int", 6), Param("tolerance", "float", 0.0)),
        _mark_frozen,
    )
)


def detect(
    df: DataFrame,
    spec: SeriesSpec,
    detector: str,
    params: dict | None = None,
    layout: Layout = Layout(),
) -> DataFrame:
    if detector not in DETECTORS:
        raise ValueError(f"Unknown detector: {detector}")
    chosen = DETECTORS[detector]
    return chosen.run(df, spec, **chosen.settings(params), layout=layout)


def detect_and_correct(
    df: DataFrame,
    spec: SeriesSpec,
    detector: str,
    op: str,
    detector_params: dict | None = None,
    params: dict | None = None,
    layout: Layout = Layout(),
) -> DataFrame:
    """Correct every row that a detector proposes."""
    if detector not in DETECTORS:
        raise ValueError(f"Unknown detector: {detector}")
    chosen = DETECTORS[detector]
    if chosen.mark is None:
        marked = mark_rows(df, spec, detect(df, spec, detector, detector_params, layout))
    else:
        others = tuple(c for c in df.columns if c not in spec.row_key)
        settings = chosen.settings(detector_params)
        marked = chosen.mark(df, spec, **settings, layout=layout, keep=others)
    return correct(marked, spec, op, params, F.col("_picked"), costly=True).select(*df.columns)
