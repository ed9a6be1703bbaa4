"""Queries of action lifecycles, with SQL that goes through a run window by window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.operators import actions
from chronofold.operators.ranges import last_before
from chronofold.plans.derived import HOUR, STEPS_SQL, STRIDE, observed, steps
from chronofold.plans.registry import query

#: Purchases have no duration; a repetition after six hours is another action.
_CONFIG = actions.LifecycleConfig(repeat_min_gap=6 * HOUR, instant=("purchase",))


def _windows(spark, sf_dir) -> DataFrame:
    """The steps; of their camera changes every third counts."""
    return steps(spark, sf_dir).select("run", "w", (F.col("camera_change") & (F.col("w") % 3 == 0)).alias("camera_change"), ((F.col("w") + 1) * STRIDE).alias("end"))


def _sightings(spark, sf_dir) -> DataFrame:
    """One action a run, entity, type and step: with a target and tool that may be elsewhere, every fifth seen in the context part only."""
    o = observed(spark, sf_dir)
    a = o.groupBy("run", "entity", "kind", "w").agg(F.max("t").alias("t"), F.min("t").alias("t0"), F.max("confidence").alias("confidence"))
    n, e = F.col("entity") + F.col("w"), F.col("entity")
    declared = a.select(
        "run", "w", "t", "t0", "confidence", F.col("kind").alias("type"), F.format_string("%06d_%s", "entity", "kind").alias("local_id"), (n % 5 != 0).alias("in_commit"),
        F.when(n % 11 != 0, e).alias("actor"), F.when(e % 3 > 0, e + 8).alias("target"), F.when(e % 3 == 2, e + 16).alias("tool"),
    )
    return actions.resolve(declared, o)


def actions_of(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Events and final actions."""
    return actions.action_log(_sightings(spark, sf_dir), _windows(spark, sf_dir), _CONFIG)


# One row an open action and run goes from window to window; a tick keeps runs without open actions going.
LIFE_SQL = STEPS_SQL + f""", lw AS (SELECT run, w, camera_change AND w % 3 = 0 AS camera, row_number() OVER (PARTITION BY run ORDER BY w) AS pos FROM st),
 pr AS (SELECT DISTINCT run, w, entity FROM ob),
 se AS (SELECT run, w, entity, kind, max(t) AS t, min(t) AS t0, max(confidence) AS conf FROM ob GROUP BY ALL),
 si AS (SELECT se.run, lw.pos, se.w, lpad(CAST(se.entity AS VARCHAR), 6, '0') || '_' || kind AS local_id, CASE WHEN (se.entity + se.w) % 11 <> 0 THEN se.entity END AS actor, kind AS type, tg.entity AS target, tl.entity AS tool,
   (se.entity % 3 > 0 AND tg.entity IS NULL) OR (se.entity % 3 = 2 AND tl.entity IS NULL) AS lost, (se.entity + se.w) % 5 <> 0 AS com, t, t0, conf
  FROM se JOIN lw ON lw.run = se.run AND lw.w = se.w LEFT JOIN pr tg ON tg.run = se.run AND tg.w = se.w AND tg.entity = se.entity + 8 AND se.entity % 3 > 0 LEFT JOIN pr tl ON tl.run = se.run AND tl.w = se.w AND tl.entity = se.entity + 16 AND se.entity % 3 = 2),
 rec AS (SELECT DISTINCT run, CAST(0 AS BIGINT) AS pos, CAST(-1 AS BIGINT) AS w, 'tick' AS tag, CAST(NULL AS BIGINT) AS actor, CAST(NULL AS VARCHAR) AS type, CAST(NULL AS BIGINT) AS target, CAST(NULL AS BIGINT) AS tool, CAST(NULL AS BIGINT) AS start_w, CAST(NULL AS VARCHAR) AS start_id,
    CAST(NULL AS BIGINT) AS last_w, CAST(NULL AS BIGINT) AS last_t, CAST(0 AS BIGINT) AS missed, CAST(NULL AS VARCHAR) AS life, CAST(0 AS BIGINT) AS windows, CAST(NULL AS DOUBLE) AS conf, CAST(NULL AS VARCHAR) AS local_id, CAST(NULL AS VARCHAR) AS event, CAST(NULL AS VARCHAR) AS reason FROM st
  UNION ALL (
   WITH tick AS (SELECT l.run, l.pos, l.w, l.camera FROM rec r JOIN lw l ON l.run = r.run AND l.pos = r.pos + 1 WHERE r.tag = 'tick'),
    op AS (SELECT r.*, t.pos AS npos, t.w AS nw, t.camera FROM rec r JOIN tick t ON t.run = r.run WHERE r.tag = 'action' AND r.life NOT IN ('ended', 'instant')),
    sn AS (SELECT si.*, t.camera FROM si JOIN tick t ON t.run = si.run AND t.pos = si.pos WHERE si.actor IS NOT NULL),
    mt AS (SELECT sn.*, op.start_w, op.start_id FROM sn JOIN op ON op.run = sn.run AND op.actor = sn.actor AND op.type = sn.type AND op.target IS NOT DISTINCT FROM sn.target AND op.tool IS NOT DISTINCT FROM sn.tool
      WHERE NOT sn.camera AND sn.w - op.last_w <= 2 AND sn.t - op.last_t < {_CONFIG.repeat_min_gap} QUALIFY row_number() OVER (PARTITION BY sn.run, sn.local_id ORDER BY op.last_w DESC, op.start_w, op.start_id) = 1)
   SELECT run, pos, w, 'tick', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0, NULL, 0, NULL, NULL, NULL, NULL FROM tick
   UNION ALL SELECT op.run, npos, nw, 'action', op.actor, op.type, op.target, op.tool, op.start_w, op.start_id, coalesce(mt.w, op.last_w), coalesce(mt.t, op.last_t),
     CASE WHEN mt.run IS NOT NULL THEN 0 WHEN op.camera THEN op.missed ELSE op.missed + 1 END,
     CASE WHEN mt.lost THEN 'uncertain' WHEN mt.run IS NOT NULL THEN 'ongoing' WHEN op.camera THEN 'uncertain' WHEN op.missed + 1 < 2 THEN 'possible_ended' ELSE 'ended' END,
     op.windows + CASE WHEN mt.run IS NOT NULL THEN 1 ELSE 0 END, greatest(op.conf, coalesce(mt.conf, op.conf)), mt.local_id,
     CASE WHEN mt.lost THEN 'action_uncertain' WHEN mt.run IS NOT NULL THEN 'action_continued' WHEN op.camera THEN 'action_uncertain' WHEN op.missed + 1 < 2 THEN 'action_possible_ended' ELSE 'action_ended' END,
     CASE WHEN mt.lost THEN 'unresolved_reference' WHEN mt.run IS NOT NULL THEN 'same_action_key' WHEN op.camera THEN 'camera_change_or_occlusion' ELSE 'missing_observation_window' END
    FROM op LEFT JOIN mt ON mt.run = op.run AND mt.start_w = op.start_w AND mt.start_id = op.start_id
   UNION ALL SELECT run, pos, w, 'action', actor, type, target, tool, w, local_id, w, t, 0, CASE WHEN type = 'purchase' THEN 'instant' WHEN lost THEN 'uncertain' ELSE 'started' END, 1, conf, local_id,
     CASE WHEN type = 'purchase' THEN 'action_instant' WHEN lost THEN 'action_uncertain' ELSE 'action_started' END, 'commit_evidence'
    FROM sn WHERE com AND NOT EXISTS (SELECT 1 FROM mt WHERE mt.run = sn.run AND mt.local_id = sn.local_id))),
 ids AS (SELECT run, start_w, start_id, 'action_' || lpad(CAST(row_number() OVER (PARTITION BY run ORDER BY start_w, start_id) AS VARCHAR), 6, '0') AS action_id FROM rec WHERE tag = 'action' AND w = start_w AND local_id = start_id),
 lg AS (SELECT rec.*, ids.action_id FROM rec JOIN ids ON ids.run = rec.run AND ids.start_w = rec.start_w AND ids.start_id = rec.start_id),
 fin AS (SELECT run, action_id, actor, type, target, tool, life AS lifecycle, start_w, last_w, last_t, windows, conf, CASE WHEN life = 'ended' THEN w END AS end_w FROM lg QUALIFY row_number() OVER (PARTITION BY run, action_id ORDER BY w DESC) = 1)"""


@query(f"""WITH RECURSIVE {LIFE_SQL} SELECT run, action_id, actor, type, target, tool, lifecycle, start_w, last_w, windows, conf AS confidence FROM fin""")
def action_lifecycle(spark, sf_dir):
    return actions_of(spark, sf_dir)[1].select("run", "action_id", "actor", "type", "target", "tool", "lifecycle", "start_w", "last_w", "windows", "confidence")


@query(f"""WITH RECURSIVE {LIFE_SQL} SELECT run, w, action_id, local_id, event AS event_type, reason FROM lg""")
def action_events(spark, sf_dir):
    """The log of all actions, window by window."""
    return actions_of(spark, sf_dir)[0].select("run", "w", "action_id", "local_id", "event_type", "reason")


@query(f"""WITH RECURSIVE {LIFE_SQL} SELECT si.run, si.w, si.local_id, coalesce(substr(lg.event, 8), CASE WHEN si.actor IS NULL THEN 'unresolved_actor' ELSE 'context_only' END) AS outcome FROM si LEFT JOIN lg ON lg.run = si.run AND lg.w = si.w AND lg.local_id = si.local_id""")
def action_intake(spark, sf_dir):
    """What becomes of every sighting: the event of its action, or why no action takes it."""
    events = actions_of(spark, sf_dir)[0]
    taken = events.where("local_id is not null").select("run", "w", "local_id", F.substring("event_type", 8, 20).alias("outcome"))
    left = actions.intake_warnings(_sightings(spark, sf_dir), events)
    return taken.unionByName(left.select("run", "w", "local_id", F.col("warning").alias("outcome")))


@query(f"WITH RECURSIVE {LIFE_SQL} SELECT run, start_w AS w, start_id AS local_id, action_id FROM ids")
def action_ids(spark, sf_dir):
    """Ids of the actions that start, in order of window and local id."""
    return actions_of(spark, sf_dir)[0].where("reason = 'commit_evidence'").select("run", "w", "local_id", "action_id")


@query(f"""WITH RECURSIVE {LIFE_SQL} SELECT ids.run, action_id, coalesce((SELECT max(o.t) FROM ob o WHERE o.run = si.run AND o.w = si.w AND o.t < si.t0), si.w * {STRIDE}) AS lower_t, si.t0 AS upper_t FROM ids JOIN si ON si.run = ids.run AND si.w = ids.start_w AND si.local_id = ids.start_id""")
def action_start_interval(spark, sf_dir):
    """Between the last sample before the first evidence, else the window's start, and that evidence."""
    starts = actions_of(spark, sf_dir)[0].where("reason = 'commit_evidence'").select("run", "w", "local_id", "action_id")
    starts = starts.join(_sightings(spark, sf_dir).select("run", "w", "local_id", "t0"), ["run", "w", "local_id"]).withColumn("t", F.col("t0"))
    found = last_before(starts, observed(spark, sf_dir).select("run", "w", "t"), ["run", "w"], "t", F.col("t"), "before")
    return found.select("run", "action_id", F.coalesce("before", F.col("w") * STRIDE).cast("long").alias("lower_t"), F.col("t0").alias("upper_t"))


@query(f"""WITH RECURSIVE {LIFE_SQL} SELECT run, action_id, lifecycle AS state, end_w, CASE WHEN end_w IS NOT NULL THEN last_t END AS end_lower, (end_w + 1) * {STRIDE} AS end_upper FROM fin""")
def action_end_state(spark, sf_dir):
    """State of every action at the end of its run; ended ones between their last observation and the end of the window that missed them."""
    return actions_of(spark, sf_dir)[1].select("run", "action_id", F.col("lifecycle").alias("state"), "end_w", "end_lower", "end_upper")
