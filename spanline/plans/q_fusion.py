"""Queries of frame features, posteriors, speaker priors and their calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanline.lineage import cut
from spanline.operators import clustering as K
from spanline.operators import fusion as P

from .q_iterative import HOP, QUALITY, SNAP_MS, WEIGHTS  # HOP is that of the systems' quality
from .registry import query
from .tables import turns_by_system, turns_ref, with_tables

NAMES = P.feature_names(list(WEIGHTS))
#: Weights of supports, pairs and (agreement, boundary, exclusive, anchor) before any fit, and the bias of activity.
PRIMARY = P.default_weights(list(WEIGHTS), (1.20, 1.35, 0.72), (0.70, 0.42, 0.50), (0.35, 0.22, 0.32, 0.18))
ACTIVITY = P.default_weights(list(WEIGHTS), (1.10, 1.18, 0.58), (0.82, 0.48, 0.58), (0.52, -0.08, 0.18, 0.10))
BIAS = -1.2
EXCLUSIVE = "b"
FRAME_MS = 300_000


def cells_of(spark, sf):
    turns = turns_by_system(spark, sf)
    return P.feature_cells(turns, K.system_quality(K.frame_grid(turns, HOP), turns, 1440, 60_000, hop_ms=HOP), WEIGHTS, FRAME_MS, SNAP_MS, EXCLUSIVE)


def frames_of(spark, sf):
    """Labelled frames as a written table: fits and sweeps read them several times."""
    return cut(P.labelled_frames(cells_of(spark, sf), NAMES, turns_ref(spark, sf), FRAME_MS))


def _share(source: str, keys: str) -> str:
    return f"SELECT {keys}, frame, max(least(1.0::DOUBLE, (least(end_ms, (frame + 1) * {FRAME_MS}) - greatest(start_ms, frame * {FRAME_MS})) / {FRAME_MS}.0::DOUBLE)) AS share FROM (SELECT *, unnest(range(start_ms // {FRAME_MS}, (end_ms - 1) // {FRAME_MS} + 1)) AS frame FROM {source}) GROUP BY {keys}, frame"


def _dot(weights: dict[str, float]) -> str:
    return "(" + " + ".join(f"{c} * {w}::DOUBLE" for c, w in weights.items()) + ")"


_WEIGHT = "CASE system WHEN 'a' THEN 1.0 WHEN 'b' THEN 0.8 ELSE 0.6 END::DOUBLE"
_OVER = "OVER (PARTITION BY recording_id, frame)"
CELLS = f"""{QUALITY}, own AS ({_share('turns_by_system', 'recording_id, system, speaker_id')}),
    known AS (SELECT *, max(last) OVER (PARTITION BY recording_id) AS size FROM (SELECT recording_id, speaker_id, max(frame) AS last,
      CASE WHEN bool_or(system <> 'c' AND share > {P.FIRM}) THEN 1.0 WHEN bool_or(system = 'c' AND share > {P.LOOSE}) THEN 0.5 ELSE 0.0 END::DOUBLE AS anchor FROM own GROUP BY 1, 2)),
    grid AS (SELECT recording_id, speaker_id, anchor, unnest(range(size + 1)) AS frame FROM known),
    wide AS (SELECT recording_id, frame, speaker_id, any_value(anchor) AS anchor, {', '.join(f"coalesce(max(share) FILTER (system = '{s}'), 0) AS {s}" for s in WEIGHTS)} FROM grid LEFT JOIN own USING (recording_id, frame, speaker_id) GROUP BY 1, 2, 3),
    bounds AS (SELECT recording_id, start_ms AS pos, {_WEIGHT} AS w FROM turns_by_system UNION ALL SELECT recording_id, end_ms, {_WEIGHT} FROM turns_by_system),
    near AS (SELECT recording_id, frame, least(1, round(sum(w * exp(-abs((frame + 0.5) * {FRAME_MS} - pos) / {SNAP_MS}.0)) / sum(w), 9)) AS near FROM (SELECT DISTINCT recording_id, frame FROM grid) JOIN bounds USING (recording_id) GROUP BY 1, 2),
    busy AS (SELECT *, {', '.join(f"sum(({s} > {P.ACTIVE})::INTEGER) {_OVER} AS n_{s}" for s in WEIGHTS)} FROM wide JOIN near USING (recording_id, frame)),
    rated AS (SELECT recording_id, {', '.join(f"max(quality) FILTER (system = '{s}') AS q_{s}" for s in WEIGHTS)} FROM quality GROUP BY 1),
    cells AS (SELECT recording_id, frame, speaker_id, {', '.join(f'round({s} + 1e-12, 6) AS {s}' for s in WEIGHTS)}, {', '.join(f'round(least({x}, {y}) + 1e-12, 6) AS {x}_{y}' for x, y in ('ab', 'ac', 'bc'))},
      round(({' + '.join(f'({s} > {P.ACTIVE})::INTEGER' for s in WEIGHTS)}) / 3.0::DOUBLE + 1e-12, 6) AS agreement, round(near * greatest(a, b, c) + 1e-12, 6) AS boundary,
      round(CASE WHEN n_{EXCLUSIVE} <= 1 AND {' + '.join(f'(n_{s} >= 2)::INTEGER' for s in WEIGHTS)} < 2 THEN {EXCLUSIVE} ELSE 0 END + 1e-12, 6) AS exclusive, anchor, {', '.join(f'round({s} * coalesce(q_{s}, 0) + 1e-12, 6) AS {s}_quality' for s in WEIGHTS)} FROM busy LEFT JOIN rated USING (recording_id))"""


@query(with_tables("turns_by_system", f"WITH {CELLS} SELECT * FROM cells"))
def k6_features(spark, sf):
    """Thirteen features of every speaker in every frame."""
    return cells_of(spark, sf)


@query(with_tables("turns_by_system", f"""WITH {CELLS}, s AS (SELECT *, {_dot(PRIMARY)} AS s, {_dot(ACTIVITY)} AS z FROM cells), e AS (SELECT *, exp(s - max(s) {_OVER}) AS e FROM s)
    SELECT recording_id, frame, speaker_id, round(e / sum(e) {_OVER}, 6) AS "primary", round(1 / (1 + exp(-(z + {BIAS}))), 6) AS active FROM e"""))
def k6_posteriors(spark, sf):
    """Each frame's speakers by the weights before any fit: the share of each, and whether it speaks."""
    found = P.posteriors(cells_of(spark, sf), PRIMARY, ACTIVITY, BIAS)
    return found.select(*P.CELL, F.round("primary", 6).alias("primary"), F.round("active", 6).alias("active"))


@query(with_tables("turns_by_system", f"""WITH {CELLS}, mass AS (SELECT recording_id, speaker_id, sum(a) AS a, sum(b) AS b, sum(c) AS c, sum(agreement) AS g, sum(exclusive) AS x, max(anchor) AS anchor, sum(greatest(0, c - greatest(a, b))) AS alone FROM cells GROUP BY 1, 2),
    f AS (SELECT *, sum((c > 0)::INTEGER) OVER (PARTITION BY recording_id) >= 4 AS "full" FROM mass),
    s AS (SELECT recording_id, speaker_id, round(1.0 * a + 0.8 * b + 0.6 * c + {P.PRIOR['agreement']} * g + {P.PRIOR['exclusive']} * x + {P.PRIOR['anchor']} * anchor - {P.PRIOR['unanchored']} * (1 - anchor) - CASE WHEN "full" THEN {P.PRIOR['alone']} * alone ELSE 0 END, 6) AS score FROM f)
    SELECT recording_id, speaker_id, score, round(CASE WHEN stddev_pop(score) OVER w < 1e-6 THEN 0 ELSE {P.PRIOR['scale']} * (score - avg(score) OVER w) / stddev_pop(score) OVER w END, 6) AS bias FROM s WINDOW w AS (PARTITION BY recording_id)"""))
def k6_speaker_prior(spark, sf):
    """Each speaker's mass in a recording and the bias that follows; the third system hears four speakers at most."""
    return P.speaker_prior(cells_of(spark, sf), WEIGHTS, cap=4)


SWEPT = "threshold double, activity_f1 double, overlap_f1 double, primary_accuracy double, objective double, best boolean"
_F1 = "coalesce(2 * tp / nullif((2 * tp + fp + fn)::DOUBLE, 0), 0)"


@query(with_tables("turns_by_system turns_ref", f"""WITH {CELLS}, truth AS ({_share('turns_ref', 'recording_id, speaker_id')}), heard AS (SELECT DISTINCT recording_id, speaker_id FROM truth),
    j AS (SELECT c.*, coalesce(t.share, 0) AS share, h.speaker_id IS NOT NULL AS valid, round({_dot(PRIMARY)}, 9) AS s, round(1 / (1 + exp(-({_dot(ACTIVITY)} + {BIAS}))), 9) AS p
      FROM cells c LEFT JOIN heard h USING (recording_id, speaker_id) LEFT JOIN truth t USING (recording_id, speaker_id, frame) WHERE recording_id IN (SELECT recording_id FROM heard)),
    f AS (SELECT recording_id, frame, max(share) AS spoken, arg_max(speaker_id, (share, -ascii(speaker_id))) AS target, arg_max(speaker_id, (s, -ascii(speaker_id))) AS said FROM j GROUP BY 1, 2),
    acc AS (SELECT coalesce(avg((target = said)::INTEGER) FILTER (spoken > 0), 0) AS accuracy FROM f),
    t AS (SELECT unnest({[round(t, 9) for t in P.THRESHOLDS]}) AS threshold),
    by_cell AS (SELECT threshold, recording_id, sum((p >= threshold - 1e-12 AND share > {P.TRUE_SHARE})::INTEGER) AS tp, sum((p >= threshold - 1e-12 AND share <= {P.TRUE_SHARE})::INTEGER) AS fp, sum((p < threshold - 1e-12 AND share > {P.TRUE_SHARE})::INTEGER) AS fn FROM j, t WHERE valid GROUP BY 1, 2),
    c AS (SELECT threshold, recording_id, frame, sum((p >= threshold - 1e-12)::INTEGER) >= 2 AS pred, sum((share > {P.TRUE_SHARE})::INTEGER) >= 2 AS ref FROM j, t WHERE valid GROUP BY 1, 2, 3),
    by_frame AS (SELECT threshold, recording_id, sum((pred AND ref)::INTEGER) AS tp, sum((pred AND NOT ref)::INTEGER) AS fp, sum((ref AND NOT pred)::INTEGER) AS fn FROM c GROUP BY 1, 2),
    heard_f1 AS (SELECT threshold, round(avg(f1), 9) AS activity_f1 FROM (SELECT threshold, {_F1} AS f1 FROM by_cell) GROUP BY 1), crowd_f1 AS (SELECT threshold, round(avg(f1), 9) AS overlap_f1 FROM (SELECT threshold, {_F1} AS f1 FROM by_frame) GROUP BY 1),
    rates AS (SELECT threshold::DOUBLE AS threshold, activity_f1, overlap_f1, round(accuracy, 9) AS primary_accuracy, round(round(accuracy, 9) + activity_f1 + 1.35 * overlap_f1, 9) AS objective FROM heard_f1 JOIN crowd_f1 USING (threshold), acc)
    SELECT *, row_number() OVER (ORDER BY objective DESC, overlap_f1 DESC, activity_f1 DESC, threshold) = 1 AS best FROM rates"""))
def k7_thresholds(spark, sf):
    """What each threshold of activity would give against the reference, by the weights before any fit."""
    rows = P.threshold_sweep(frames_of(spark, sf), [PRIMARY[c] for c in NAMES], [*[ACTIVITY[c] for c in NAMES], BIAS])
    return spark.createDataFrame([tuple(r.values()) for r in rows], SWEPT)


@query()
def k7_fusion_calibrator(spark, sf):
    """Weights of both heads fitted to the reference, the overlap weight and threshold of greatest objective, and what they reach."""
    best = P.calibrated(frames_of(spark, sf), NAMES)
    rows = [(head, c, round(float(w), 4)) for head in ("primary", "activity") for c, w in best[head].items()]
    rows += [("choice", c, round(float(best[c]), 4)) for c in ("bias", "overlap_weight", "threshold", "activity_f1", "overlap_f1", "primary_accuracy", "objective")]
    return spark.createDataFrame(rows, "part string, name string, value double")
