"""Interval and state queries over runs of event types."""

from __future__ import annotations

from pyspark.sql import functions as F

from siglake.operators import intervals as iv
from siglake.operators import ranges
from siglake.plans.registry import query
from siglake.sources import views

WIDTH = 3600.0
KEYS = ["user_id"]


@query("SELECT user_id, state, iseg, round(t0, 3) AS t0, round(t1, 3) AS t1 FROM intervals")
def states_table(spark, sf_dir):
    return views.intervals(spark, sf_dir).select("user_id", "state", "iseg", F.round("t0", 3).alias("t0"), F.round("t1", 3).alias("t1"))


@query("SELECT user_id, state, round(sum(t1 - t0), 3) AS duration FROM intervals GROUP BY ALL")
def intervals_total_duration(spark, sf_dir):
    return iv.total_duration(views.intervals(spark, sf_dir), ["user_id", "state"]).select("user_id", "state", F.round("duration", 3).alias("duration"))


@query("SELECT user_id, iseg, round(t0, 3) AS t0, round(t1, 3) AS t1 FROM intervals WHERE state = 'click'")
def intervals_from_state(spark, sf_dir):
    return views.intervals(spark, sf_dir).where("state = 'click'").select("user_id", "iseg", F.round("t0", 3).alias("t0"), F.round("t1", 3).alias("t1"))


@query("SELECT event_id, round(t - 30.0, 3) AS t0, round(t + 90.0, 3) AS t1 FROM ev WHERE event_type = 'error'")
def events_to_intervals(spark, sf_dir):
    out = iv.around(views.events(spark, sf_dir).where("event_type = 'error'"), 30, 90)
    return out.select("event_id", F.round("t0", 3).alias("t0"), F.round("t1", 3).alias("t1"))


@query(
    """e AS (SELECT t - 600.0 AS t0, t + 600.0 AS t1 FROM ev WHERE event_type = 'error' AND x > 30)
  SELECT event_id FROM ev WHERE event_type = 'purchase' AND EXISTS (SELECT 1 FROM e WHERE ev.t >= e.t0 AND ev.t < e.t1)"""
)
def restrict_events(spark, sf_dir):
    ev = views.events(spark, sf_dir)
    around = iv.around(ev.where("event_type = 'error' and x > 30"), 600, 600)
    return iv.restrict(ev.where("event_type = 'purchase'"), around, [], 1200).select("event_id")


@query(
    """SELECT s.user_id, s.i, round(s.x, 6) AS x FROM sig_ev s WHERE EXISTS (SELECT 1 FROM intervals v WHERE v.user_id = s.user_id AND v.state = 'view' AND s.t >= v.t0 AND s.t < v.t1)"""
)
def restrict_signal(spark, sf_dir):
    own = views.intervals(spark, sf_dir).where("state = 'view'")
    return iv.restrict(views.sig_ev(spark, sf_dir), own, KEYS, WIDTH * 24).select("user_id", "i", F.round("x", 6).alias("x"))


@query(
    """n AS (SELECT user_id, t - 400.0 AS t0, t + 400.0 AS t1 FROM ev WHERE event_type = 'error'),
  l AS (SELECT user_id, coalesce(lead(t0) OVER (PARTITION BY user_id ORDER BY t0, t1) < t1, false) AS clash FROM n)
  SELECT user_id, NOT bool_or(clash) AS disjoint FROM l GROUP BY user_id"""
)
def check_intervals_disjoint(spark, sf_dir):
    return iv.disjoint(iv.around(views.events(spark, sf_dir).where("event_type = 'error'"), 400, 400), KEYS)


@query(
    """n AS (SELECT user_id, event_id AS k, t - 20000.0 AS t0, t + 20000.0 AS t1 FROM ev WHERE event_type = 'error')
  SELECT p.user_id, p.event_id, coalesce(string_agg(n.k, ',' ORDER BY n.k), '') AS found
  FROM ev p LEFT JOIN n ON n.user_id = p.user_id AND p.t >= n.t0 AND p.t < n.t1 WHERE p.event_type = 'click' GROUP BY ALL"""
)
def map_numbers_to_intervals(spark, sf_dir):
    ev = views.events(spark, sf_dir)
    near = iv.around(ev.where("event_type = 'error'"), 20000, 20000)
    got = iv.mapped(ev.where("event_type = 'click'"), near, KEYS, "event_id", 40000, "event_id")
    return got.select("user_id", "event_id", F.array_join(F.col("found").cast("array<string>"), ",").alias("found"))


@query(
    """SELECT s.user_id, s.i, coalesce(v.iseg, -1) AS found FROM sig_ev s LEFT JOIN intervals v ON v.user_id = s.user_id AND v.state = 'view' AND s.t >= v.t0 AND s.t < v.t1"""
)
def map_numbers_to_disjoint_intervals(spark, sf_dir):
    own = views.intervals(spark, sf_dir).where("state = 'view'")
    return iv.mapped_disjoint(views.sig_ev(spark, sf_dir), own, KEYS, "iseg", WIDTH * 24).select("user_id", "i", "found")


SUBTRACT = """a AS (SELECT user_id, t - 900.0 AS s, t + 900.0 AS e FROM ev WHERE event_type = 'error'),
  b AS (SELECT user_id, iseg, t0, t1 FROM intervals WHERE state = 'view'),
  h AS (SELECT b.*, s, e FROM b JOIN a USING (user_id) WHERE t0 < e AND s < t1 UNION ALL SELECT *, t1, t1 FROM b),
  p AS (SELECT *, coalesce(max(e) OVER (PARTITION BY user_id, iseg, t0, t1 ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), t0) AS f FROM h)
"""


@query(f"{SUBTRACT} SELECT user_id, iseg, round(f, 3) AS t0, round(s, 3) AS t1 FROM p WHERE s > f")
def subtract_intervals(spark, sf_dir):
    a = iv.around(views.events(spark, sf_dir).where("event_type = 'error'"), 900, 900)
    b = views.intervals(spark, sf_dir).where("state = 'view'").select("user_id", "iseg", "t0", "t1")
    return iv.subtracted(a, b, KEYS, WIDTH * 6).select("user_id", "iseg", F.round("t0", 3).alias("t0"), F.round("t1", 3).alias("t1"))


LABELLED = """l AS (SELECT s.user_id, s.i, s.t,
    coalesce(max(v.iseg) FILTER (v.state = 'view'), -1) AS "view", coalesce(max(v.iseg) FILTER (v.state = 'click'), -1) AS click, coalesce(max(v.iseg) FILTER (v.state = 'error'), -1) AS error
  FROM sig_ev s LEFT JOIN intervals v ON v.user_id = s.user_id AND s.t >= v.t0 AND s.t < v.t1 GROUP BY ALL)
"""


def _labelled(spark, sf_dir):
    return iv.labelled(views.sig_ev(spark, sf_dir).drop("x"), views.intervals(spark, sf_dir), KEYS, ["view", "click", "error"], WIDTH * 24)


@query(f'{LABELLED} SELECT user_id, i, "view", click, error FROM l')
def label_numbers_by_state_intervals(spark, sf_dir):
    return _labelled(spark, sf_dir).drop("t")


@query(f'{LABELLED} SELECT user_id, i FROM l WHERE error = -1 AND ("view" <> -1 OR click <> -1)')
def filter_by_states(spark, sf_dir):
    got = _labelled(spark, sf_dir)
    return got.where(iv.in_states(got, ["view", "click"], ["error"])).select("user_id", "i")


@query(f'{LABELLED} SELECT user_id, i FROM l WHERE NOT (error = -1 AND ("view" <> -1 OR click <> -1))')
def filter_by_states_complement(spark, sf_dir):
    got = _labelled(spark, sf_dir)
    return got.where(~iv.in_states(got, ["view", "click"], ["error"])).select("user_id", "i")


@query(f"""{LABELLED} SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t, i) - 1 AS k, i FROM l WHERE "view" <> -1 AND click = -1 AND error = -1""")
def get_exclusive_state(spark, sf_dir):
    from pyspark.sql import Window as W

    got = _labelled(spark, sf_dir)
    own = got.where(iv.in_states(got, ["view"], ["click", "error"]))
    return own.select("user_id", (F.row_number().over(W.partitionBy("user_id").orderBy("t", "i")).cast("long") - 1).alias("k"), "i")


@query(
    """n AS (SELECT user_id, event_type AS state, event_id AS iseg, t - 300.0 AS t0, t + 300.0 AS t1 FROM ev WHERE event_type IN ('error', 'signup', 'purchase')),
  c AS (SELECT DISTINCT a.state, b.state AS other FROM n a JOIN n b ON a.user_id = b.user_id AND a.t0 < b.t1 AND b.t0 < a.t1 AND (a.state <> b.state OR a.iseg <> b.iseg)),
  s AS (SELECT DISTINCT state FROM n)
  SELECT a.state, b.state AS other, c.state IS NULL AS disjoint FROM s a, s b LEFT JOIN c ON c.state = a.state AND c.other = b.state"""
)
def check_disjoint_states(spark, sf_dir):
    near = iv.around(views.events(spark, sf_dir).where("event_type in ('error', 'signup', 'purchase')"), 300, 300)
    return iv.disjoint_states(near.select("user_id", F.col("event_type").alias("state"), F.col("event_id").alias("iseg"), "t0", "t1"), KEYS, 600)


@query(
    """l AS (SELECT user_id, t1 AS t, state AS before, lead(state) OVER (PARTITION BY user_id ORDER BY t0, t1) AS after FROM intervals)
  SELECT user_id, round(t, 3) AS t, before, after FROM l WHERE before <> after"""
)
def state_transitions(spark, sf_dir):
    return iv.transitions(views.intervals(spark, sf_dir), KEYS).withColumn("t", F.round("t", 3))


@query(
    """l AS (SELECT user_id, t0 AS t, lag(state) OVER (PARTITION BY user_id ORDER BY t0, t1) AS before, state AS after FROM intervals)
  SELECT user_id, round(t, 3) AS t, before, after FROM l WHERE before <> after"""
)
def state_transitions_at_start(spark, sf_dir):
    return iv.transitions(views.intervals(spark, sf_dir), KEYS, at_end=False).withColumn("t", F.round("t", 3))


TRANSITION = "l AS (SELECT user_id, t1 AS t, state AS before, lead(state) OVER (PARTITION BY user_id ORDER BY t0, t1) AS after FROM intervals)"


@query(f"{TRANSITION} SELECT user_id, trunc(t)::BIGINT - 5.0::DOUBLE AS t0, trunc(t)::BIGINT + 7.0::DOUBLE AS t1 FROM l WHERE before = 'view' AND after = 'click'")
def state_transition_interval(spark, sf_dir):
    return iv.transition_intervals(views.intervals(spark, sf_dir), KEYS, "view", "click", 5, 7)


@query(
    f"""{TRANSITION}, n AS (SELECT user_id, trunc(t)::BIGINT - 30.0::DOUBLE AS t0, trunc(t)::BIGINT::DOUBLE AS t1 FROM l WHERE before = 'view' AND after = 'click')
  SELECT user_id, state, iseg, round(t0, 3) AS t0, round(t1, 3) AS t1 FROM intervals UNION ALL
  SELECT user_id, 'view_To_click', row_number() OVER (PARTITION BY user_id ORDER BY t0, t1) - 1, t0, t1 FROM n"""
)
def append_transition_intervals(spark, sf_dir):
    own = views.intervals(spark, sf_dir)
    out = iv.with_state(own, iv.transition_intervals(own, KEYS, "view", "click", 30, 0), KEYS, "view_To_click")
    return out.withColumn("t0", F.round("t0", 3)).withColumn("t1", F.round("t1", 3))


@query(
    """l AS (SELECT user_id, t1 AS t, state AS before, lead(state) OVER (PARTITION BY user_id ORDER BY t0, t1) AS after FROM intervals WHERE state NOT IN ('error', 'signup'))
  SELECT user_id, round(t - 30.0, 3) AS t0, round(t, 3) AS t1 FROM l WHERE before = 'view' AND after = 'click'"""
)
def append_intermediate_intervals(spark, sf_dir):
    got = iv.intermediate_intervals(views.intervals(spark, sf_dir), KEYS, "view", "click", 30, ["error", "signup"])
    return got.select("user_id", F.round("t0", 3).alias("t0"), F.round("t1", 3).alias("t1"))


@query("SELECT state, round(sum(t1 - t0), 2) AS duration FROM intervals GROUP BY state")
def get_state_durations(spark, sf_dir):
    return iv.durations(views.intervals(spark, sf_dir)).select("state", F.round("duration", 2).alias("duration"))


@query("SELECT user_id, state, iseg FROM intervals WHERE t1 > t0")
def drop_corrupt_intervals(spark, sf_dir):
    return iv.without_corrupt(views.intervals(spark, sf_dir)).select("user_id", "state", "iseg")


@query(
    """a AS (SELECT user_id, t - 120.0 AS s, t + 120.0 AS e FROM ev WHERE event_type = 'error'),
  b AS (SELECT user_id, state, t0, t1 FROM intervals WHERE state IN ('view', 'click') AND t1 > t0),
  h AS (SELECT b.*, s, e FROM b JOIN a USING (user_id) WHERE t0 < e AND s < t1 UNION ALL SELECT *, t1, t1 FROM b),
  p AS (SELECT *, coalesce(max(e) OVER (PARTITION BY user_id, state, t0, t1 ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), t0) AS f FROM h)
  SELECT user_id, state, round(f, 3) AS t0, round(s, 3) AS t1 FROM p WHERE s > f UNION ALL SELECT user_id, 'micro', round(s, 3), round(e, 3) FROM a"""
)
def purify_macro_states(spark, sf_dir):
    micro = iv.around(views.events(spark, sf_dir).where("event_type = 'error'"), 120, 120).select("user_id", F.lit("micro").alias("state"), "t0", "t1")
    macro = views.intervals(spark, sf_dir).where("state in ('view', 'click') and t1 > t0").select("user_id", "state", "t0", "t1")
    out = iv.purified(macro.unionByName(micro), KEYS, ["view", "click"], ["micro"], WIDTH * 6)
    return out.withColumn("t0", F.round("t0", 3)).withColumn("t1", F.round("t1", 3))


@query(
    """n AS (SELECT user_id, event_id, t AS t0, t + 60 * x AS t1, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS rn FROM ev)
  SELECT a.user_id, a.event_id AS first, b.event_id AS second, round(b.t0, 3) AS t0, round(least(a.t1, b.t1), 3) AS t1 FROM n a JOIN n b ON a.user_id = b.user_id AND a.rn < b.rn AND b.t0 < a.t1"""
)
def detect_overlaps(spark, sf_dir):
    """Pairs of a user's event intervals that overlap, the earlier first."""
    n = views.events(spark, sf_dir).select("user_id", "event_id", F.col("t").alias("t0"), (F.col("t") + 60 * F.col("x")).alias("t1"))
    b = n.select("user_id", F.col("event_id").alias("second"), F.col("t0").alias("b0"), F.col("t1").alias("b1"))
    got = ranges.overlapping(n, b, KEYS, 3000, "t0", "t1", "b0", "b1").where(F.struct("t0", "event_id") < F.struct("b0", "second"))
    return got.select("user_id", F.col("event_id").alias("first"), "second", F.round("b0", 3).alias("t0"), F.round(F.least("t1", "b1"), 3).alias("t1"))
