"""Queries of bounded context and of run reports, on the states at the end of every run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronofold.operators import reports, tracking
from chronofold.plans import catalogue as c
from chronofold.plans import lifecycles
from chronofold.plans.derived import OBSERVED_SQL, STEPS_SQL, observed, steps
from chronofold.plans.registry import longs, query
from chronofold.sources.scratch import stored

#: Lengths of the lists, windows after which an entity is stale, characters of a context.
_ENTITIES, _ACTIONS, _PENDING, _STALE, _BUDGET = 15, 8, 8, 5, 900
_AFTER_SQL = "SELECT run, w, count(*) FILTER (NOT camera_change) OVER (PARTITION BY run ORDER BY w DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS missed, max(w) OVER (PARTITION BY run) AS now FROM st"


def _after(spark, sf_dir) -> DataFrame:
    """Of every step: the windows without a camera change that follow it, and the run's last window."""
    w = Window.partitionBy("run").orderBy(F.desc("w")).rowsBetween(Window.unboundedPreceding, -1)
    s = steps(spark, sf_dir).withColumn("missed", F.coalesce(F.count_if(~F.col("camera_change")).over(w), F.lit(0)))
    return s.select("run", "w", "missed", F.max("w").over(Window.partitionBy("run")).alias("now"))


def _actions(spark, sf_dir) -> DataFrame:
    """Actions that are open at the end of their run."""
    final = lifecycles.actions_of(spark, sf_dir)[1].where(~F.col("lifecycle").isin("ended", "instant"))
    return final.select("run", F.col("actor").alias("entity"), F.col("type").alias("kind"), "target", "tool", "action_id", "last_w", F.col("lifecycle").alias("state"))


_OPEN_SQL = f"""{lifecycles.LIFE_SQL}, oa AS (SELECT run, actor AS entity, type AS kind, target, tool, action_id, last_w, lifecycle AS state FROM fin WHERE lifecycle NOT IN ('ended', 'instant')),
 ra AS (SELECT run, entity, kind, target, tool, action_id, last_w, state, row_number() OVER (PARTITION BY run ORDER BY state = 'possible_ended', last_w DESC, action_id) AS rank FROM oa QUALIFY rank <= {_ACTIONS})"""


def _top_actions(spark, sf_dir, acts: DataFrame | None = None) -> DataFrame:
    return reports.top_k(_actions(spark, sf_dir) if acts is None else acts, ["run"], [F.col("state") == "possible_ended", F.desc("last_w"), F.asc("action_id")], _ACTIONS)


@query(f"WITH RECURSIVE {_OPEN_SQL} SELECT run, entity, kind, CAST(last_w AS BIGINT) AS last_w, state, rank FROM ra")
def context_actions_topk(spark, sf_dir):
    return _top_actions(spark, sf_dir).select("run", "entity", "kind", "last_w", "state", "rank")


def _entities(spark, sf_dir, acts: DataFrame | None = None) -> DataFrame:
    """Entities that aren't inactive or stale; actors, targets and tools of open actions always stay unless inactive."""
    acts = _actions(spark, sf_dir) if acts is None else acts
    seen = observed(spark, sf_dir).groupBy("run", "entity").agg(F.max("w").alias("w"))
    part = F.explode(F.array("entity", "target", "tool")).alias("entity")
    related = acts.select("run", part).where("entity is not null").distinct().withColumn("related", F.lit(True))
    e = seen.join(_after(spark, sf_dir), ["run", "w"]).join(related, ["run", "entity"], "left").withColumn("related", F.coalesce("related", F.lit(False)))
    e = e.where((F.col("missed") <= 10) & (F.col("related") | (F.col("now") - F.col("w") <= _STALE)))
    return e.select("run", "entity", F.col("w").alias("last_w"), "related", (F.col("missed") == 0).alias("active"))


_ENTITIES_SQL = f"""{_OPEN_SQL}, af AS ({_AFTER_SQL}), es AS (SELECT run, entity, max(w) AS w FROM ob GROUP BY ALL),
 en AS (SELECT es.run, es.entity, es.w AS last_w, EXISTS (SELECT 1 FROM oa WHERE oa.run = es.run AND (oa.entity = es.entity OR oa.target = es.entity OR oa.tool = es.entity)) AS related, af.missed, af.now FROM es JOIN af ON af.run = es.run AND af.w = es.w),
 re AS (SELECT run, entity, last_w, related, missed = 0 AS active, row_number() OVER (PARTITION BY run ORDER BY related DESC, last_w DESC, missed = 0 DESC, entity) AS rank FROM en WHERE missed <= 10 AND (related OR now - last_w <= {_STALE}) QUALIFY rank <= {_ENTITIES})"""


def _top_entities(spark, sf_dir, acts: DataFrame | None = None) -> DataFrame:
    return reports.top_k(_entities(spark, sf_dir, acts), ["run"], [F.desc("related"), F.desc("last_w"), F.desc("active"), F.asc("entity")], _ENTITIES)


@query(f"WITH RECURSIVE {_ENTITIES_SQL} SELECT run, entity, CAST(last_w AS BIGINT) AS last_w, related, active, rank FROM re")
def context_entities_topk(spark, sf_dir):
    return _top_entities(spark, sf_dir).select("run", "entity", "last_w", "related", "active", "rank")


def _top_pending(spark, sf_dir) -> DataFrame:
    """Values that wait for support at the end of their run: the last state of a key, unless a later window swept it."""
    rows = c._attribute_rows(spark, sf_dir)
    log = tracking.attribute_states(rows, c._KEY)
    last = log.join(rows.select(*c._KEY, "w", "c"), [*c._KEY, "w"]).groupBy(*c._KEY).agg(F.max_by(F.struct("status", "pending", "last_support", F.round("c", 6).alias("c"), "w"), "w").alias("x")).select(*c._KEY, "x.*")
    final = _after(spark, sf_dir).groupBy("run").agg(F.max("w").alias("now"))
    held = (F.col("now") == F.col("w")) | (F.col("now") - F.col("last_support") <= tracking.AttributeConfig().max_pending_gap)
    open_ = last.where("status = 'pending'").join(final, "run").where(held)
    return reports.top_k(open_, ["run"], [F.desc("c"), F.asc("entity"), F.asc("attribute")], _PENDING)


_PENDING_SQL = f"""{c._FSM_SQL}, lf AS (SELECT fs.run, fs.entity, fs.attribute, fs.status, fs.pend, fs.ls, fs.w, round(xo.c, 6) AS c, (SELECT max(w) FROM st WHERE st.run = fs.run) AS now FROM fs JOIN xo ON {c._SAME.format(a='xo', b='fs')} AND xo.r = fs.r
   QUALIFY row_number() OVER (PARTITION BY fs.run, fs.entity, fs.attribute ORDER BY fs.w DESC) = 1),
 rp AS (SELECT run, entity, attribute, pend AS pending, c, row_number() OVER (PARTITION BY run ORDER BY c DESC, entity, attribute) AS rank FROM lf WHERE status = 'pending' AND (now = w OR now - ls <= 1) QUALIFY rank <= {_PENDING})"""


@query(f"{_PENDING_SQL} SELECT run, entity, CAST(attribute AS BIGINT) AS attribute, pending, c AS confidence, rank FROM rp")
def context_pending_topk(spark, sf_dir):
    return _top_pending(spark, sf_dir).select("run", "entity", "attribute", "pending", F.col("c").alias("confidence"), "rank")


@query(f"""{_PENDING_SQL} SELECT run, array_to_string(list(entity || ':' || attribute ORDER BY entity || ':' || attribute), ',') AS pending FROM lf WHERE status = 'pending' AND (now = w OR now - ls <= 1) GROUP BY run""")
def pending_index(spark, sf_dir):
    """Sorted entity:key of everything that is pending, by run."""
    rows = c._attribute_rows(spark, sf_dir)
    last = tracking.attribute_states(rows, c._KEY).groupBy(*c._KEY).agg(F.max_by(F.struct("status", "last_support", "w"), "w").alias("x")).select(*c._KEY, "x.*")
    final = _after(spark, sf_dir).groupBy("run").agg(F.max("w").alias("now"))
    open_ = last.join(final, "run").where("status = 'pending' and (now = w or now - last_support <= 1)")
    return open_.groupBy("run").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", F.col("entity").cast("string"), F.col("attribute").cast("string")))), ",").alias("pending"))


def _scene(spark, sf_dir) -> DataFrame:
    """The last scene of every run with its view, and the latest scene change of the last five windows."""
    s = tracking.scene_segments(steps(spark, sf_dir))
    first = s.withColumn("change", F.when(F.col("camera_change") & (F.lag("w").over(Window.partitionBy("run").orderBy("w")).isNotNull()), F.col("w")))
    last = first.groupBy("run").agg(F.max_by(F.struct("scene_id", "view"), "w").alias("x"), F.max("w").alias("now"), F.max("change").alias("change"))
    return last.select("run", "x.scene_id", "x.view", F.when(F.col("now") - F.col("change") <= 5, F.col("change")).alias("recent_change"))


_SCENE_SQL = f"""WITH {c._SEGMENTS_SQL}, cs AS (SELECT run, arg_max(scene_id, w) AS scene_id, arg_max(view, w) AS view, max(w) AS now, max(w) FILTER (camera_change AND previous_id IS NOT NULL) AS change FROM sc GROUP BY run)"""


@query(f"{_SCENE_SQL} SELECT run, scene_id, view, CAST(CASE WHEN now - change <= 5 THEN change END AS BIGINT) AS recent_change FROM cs")
def context_scene(spark, sf_dir):
    return _scene(spark, sf_dir)


def _context(spark, sf_dir) -> DataFrame:
    """What of the three lists fits the budget: entities go first, then actions, then pending values."""
    item = lambda kind, *parts: F.concat(F.lit(f'{{"{kind}":"'), F.concat_ws("/", *[F.col(p).cast("string") for p in parts]), F.lit('"}'))
    acts = stored(_actions(spark, sf_dir), "open-actions")
    lists = [("pending", 0, _top_pending(spark, sf_dir), ("entity", "attribute", "pending")), ("action", 1, _top_actions(spark, sf_dir, acts), ("entity", "kind", "state", "last_w")), ("entity", 2, _top_entities(spark, sf_dir, acts), ("entity", "last_w", "related", "active"))]
    rows = None
    for kind, order, top, parts in lists:
        part = top.select("run", F.lit(kind).alias("list"), F.lit(order).alias("o"), "rank", F.col("entity").alias("entity_id"), item(kind, *parts).alias("item"))
        rows = part if rows is None else rows.unionByName(part)
    scene = _scene(spark, sf_dir).select("run", (F.length("scene_id") + F.length("view") + 60).alias("base"))
    rows = rows.join(scene, "run")
    # a cut turns "truncated": false into true, which is a character shorter
    return reports.within_budget(rows, ["run"], ["o", "rank"], F.length("item"), F.lit(_BUDGET) - F.col("base"), freed=1)


def _lists_sql() -> str:
    """The lists' common table expressions behind one another; those of the steps and observations once."""
    rest = lambda sql: sql[len(STEPS_SQL) :]
    scene = rest(c._SEGMENTS_SQL).replace(" sg AS", " sg2 AS").replace("FROM sg)", "FROM sg2)")
    return f"{_PENDING_SQL}{rest(_ENTITIES_SQL)}{scene}"


def _context_sql() -> str:
    return f"""{_lists_sql()}, cs AS (SELECT run, length(arg_max(scene_id, w)) + length(arg_max(view, w)) + 60 AS base FROM sc GROUP BY run),
 it AS (SELECT run, 'pending' AS list, 0 AS o, rank, entity AS entity_id, '{{"pending":"' || entity || '/' || attribute || '/' || pending || '"}}' AS item FROM rp
  UNION ALL SELECT run, 'action', 1, rank, entity, '{{"action":"' || entity || '/' || kind || '/' || state || '/' || last_w || '"}}' FROM ra
  UNION ALL SELECT run, 'entity', 2, rank, entity, '{{"entity":"' || entity || '/' || last_w || '/' || related || '/' || active || '"}}' FROM re),
 us AS (SELECT it.*, {_BUDGET} - cs.base AS lim, sum(length(item) + 1) OVER (PARTITION BY it.run ORDER BY o, rank) AS used, sum(length(item) + 1) OVER (PARTITION BY it.run) AS whole FROM it JOIN cs ON cs.run = it.run),
 kp AS (SELECT *, whole > lim AS truncated FROM us WHERE whole <= lim OR (used <= lim + 1 AND used < whole))"""


@query(f"{_context_sql()} SELECT run, list, rank, item, CAST(used AS BIGINT) AS used, truncated FROM kp")
def context_budget(spark, sf_dir):
    return _context(spark, sf_dir).select("run", "list", "rank", "item", "used", "truncated")


@query(f"{_context_sql()} SELECT run, CAST(entity_id AS BIGINT) AS entity FROM kp WHERE list = 'entity'")
def context_candidate_ids(spark, sf_dir):
    """Entities that a model may name: those that are left in the context."""
    return _context(spark, sf_dir).where("list = 'entity'").select("run", F.col("entity_id").alias("entity"))


@query(f"{_context_sql()}, px AS (SELECT run, max(used) AS n FROM kp GROUP BY run) SELECT round(avg(n), 6) AS average_characters, count(*) = 0 AS none FROM px")
def report_context_characters(spark, sf_dir):
    n = _context(spark, sf_dir).groupBy("run").agg(F.max("used").alias("n"))
    return n.agg(F.round(F.avg("n"), 6).alias("average_characters"), (F.count("*") == 0).alias("none"))


#: Budgets that leave a document whole, cut one list, cut all and need the compact scene.
_BUDGETS = (6000, 1500, 700, 300, 150)
# every number of items is tried, in the order in which they are kept
_JSON_SQL = f"""{_lists_sql()}, nw AS (SELECT run, max(w) AS now FROM st GROUP BY run),
 sn AS (SELECT sc.run, sc.scene_id, sc.view, sc.scene_index, (SELECT max(x.w) FROM sc x WHERE x.run = sc.run AND x.camera_change AND x.previous_id IS NOT NULL AND nw.now - x.w <= 5) AS change FROM sc JOIN nw ON nw.run = sc.run AND nw.now = sc.w),
 sj AS (SELECT sn.run, CAST(to_json({{'continuity': CASE WHEN sn.scene_index > 1 THEN 'camera_change' ELSE 'started' END, 'scene_id': sn.scene_id, 'view_type': sn.view}}) AS VARCHAR) AS scene, CAST(to_json({{'scene_id': sn.scene_id, 'view_type': sn.view}}) AS VARCHAR) AS compact,
   CASE WHEN sc.w IS NULL THEN '[]' ELSE '[' || to_json({{'continuity': 'camera_change', 'scene_id': sc.scene_id, 'start_window': sc.w, 'view_type': sc.view}}) || ']' END AS changes FROM sn LEFT JOIN sc ON sc.run = sn.run AND sc.w = sn.change),
 ij AS (SELECT run, 0 AS o, rank, CAST(to_json({{'attribute_key': 'a' || attribute, 'candidate_value': pending, 'confidence': c, 'entity_id': entity}}) AS VARCHAR) AS item FROM rp
  UNION ALL SELECT run, 1, rank, CAST(to_json({{'action_id': action_id, 'action_type': kind, 'actor_id': entity, 'lifecycle': state, 'target_id': target, 'tool_id': tool}}) AS VARCHAR) FROM ra
  UNION ALL SELECT re.run, 2, rank, CAST(to_json({{'canonical_name': 'Gerät ' || entity, 'entity_id': entity, 'entity_type': 't' || (entity % 3), 'last_seen_windows_ago': nw.now - re.last_w, 'visibility': CASE WHEN active THEN 'visible' ELSE 'unknown' END}}) AS VARCHAR) FROM re JOIN nw ON nw.run = re.run),
 gj AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY o, rank) AS g FROM ij),
 mj AS (SELECT sj.*, n, unnest(range(n + 1)) AS m FROM sj JOIN (SELECT sj.run, count(gj.g) AS n FROM sj LEFT JOIN gj ON gj.run = sj.run GROUP BY ALL) c ON c.run = sj.run),
 dj AS (SELECT mj.run, m, n, any_value(scene) AS scene, any_value(compact) AS compact, '{{"active_actions":[' || coalesce(string_agg(item, ',' ORDER BY rank) FILTER (o = 1), '') || '],"candidate_entities":[' || coalesce(string_agg(item, ',' ORDER BY rank) FILTER (o = 2), '') || '],"pending_attributes":[' || coalesce(string_agg(item, ',' ORDER BY rank) FILTER (o = 0), '')
   || '],"recent_scene_changes":' || any_value(changes) || ',"scene":' AS head FROM mj LEFT JOIN gj ON gj.run = mj.run AND gj.g <= mj.m GROUP BY mj.run, m, n),
 bj AS (SELECT dj.*, budget, head || scene || CASE WHEN m = n THEN ',"truncated":false}}' ELSE ',"truncated":true}}' END AS doc FROM dj, (SELECT unnest({list(_BUDGETS)}) AS budget)),
 oj AS (SELECT * FROM bj WHERE length(doc) <= budget QUALIFY row_number() OVER (PARTITION BY run, budget ORDER BY m DESC) = 1),
 aj AS (SELECT run, budget, doc AS json, m < n AS truncated, false AS compacted, m AS kept FROM oj UNION ALL SELECT run, budget, head || compact || ',"truncated":true}}', true, true, 0 FROM bj WHERE m = 0 AND NOT EXISTS (SELECT 1 FROM oj WHERE oj.run = bj.run AND oj.budget = bj.budget))"""


@query(f"{_JSON_SQL} SELECT run, CAST(budget AS BIGINT) AS budget, json, length(json) AS characters, truncated, compacted, CAST(kept AS BIGINT) AS kept FROM aj")
def context_json(spark, sf_dir):
    """The context of every run's end as JSON, within several budgets."""
    s = stored(tracking.scene_segments(steps(spark, sf_dir)), "scenes")
    now = s.groupBy("run").agg(F.max("w").alias("now"))
    start = s.where("camera_change and scene_index > 1").join(now, "run").where("now - w <= 5").groupBy("run").agg(F.max_by(F.struct("w", "scene_id", "view"), "w").alias("x"))
    last = s.groupBy("run").agg(F.max_by(F.struct("scene_id", "view", "scene_index"), "w").alias("l")).join(start, "run", "left")
    continuity, camera = F.when(F.col("l.scene_index") > 1, "camera_change").otherwise("started"), F.lit("camera_change")
    change = reports.sorted_json(continuity=camera, scene_id=F.col("x.scene_id"), start_window=F.col("x.w"), view_type=F.col("x.view"))
    whole, short = reports.sorted_json(scene_id=F.col("l.scene_id"), view_type=F.col("l.view"), continuity=continuity), reports.sorted_json(scene_id=F.col("l.scene_id"), view_type=F.col("l.view"))
    scenes = last.select("run", whole.alias("scene"), short.alias("compact"), F.when(F.col("x").isNotNull(), F.concat(F.lit("["), change, F.lit("]"))).alias("changes"), F.explode(F.array(*[F.lit(b).cast("long") for b in _BUDGETS])).alias("budget"))
    acts = stored(_actions(spark, sf_dir), "open-actions")
    col = F.col
    pending = _top_pending(spark, sf_dir).withColumn("item", reports.sorted_json(entity_id=col("entity"), attribute_key=F.concat(F.lit("a"), col("attribute").cast("string")), candidate_value=col("pending"), confidence=col("c")))
    open_ = _top_actions(spark, sf_dir, acts).withColumn("item", reports.sorted_json(action_id=col("action_id"), actor_id=col("entity"), action_type=col("kind"), target_id=col("target"), tool_id=col("tool"), lifecycle=col("state")))
    name, kind, seen = F.concat(F.lit("Gerät "), col("entity").cast("string")), F.concat(F.lit("t"), (col("entity") % 3).cast("string")), F.when(col("active"), "visible").otherwise("unknown")
    entities = _top_entities(spark, sf_dir, acts).join(now, "run").withColumn("item", reports.sorted_json(entity_id=col("entity"), entity_type=kind, canonical_name=name, last_seen_windows_ago=col("now") - col("last_w"), visibility=seen))
    return reports.context_documents(scenes, {"pending_attributes": pending, "active_actions": open_, "candidate_entities": entities}, ["run"])


@query(f"WITH {OBSERVED_SQL}, g AS (SELECT run, max(w) + 1 AS windows, count(DISTINCT w) AS success FROM ob GROUP BY run) SELECT run, CAST(windows AS BIGINT) AS windows, CAST(success AS BIGINT) AS success, CAST(windows - success AS BIGINT) AS failed FROM g")
def report_run_totals(spark, sf_dir):
    """A window without events is a failed one."""
    g = observed(spark, sf_dir).groupBy("run").agg((F.max("w") + 1).alias("windows"), F.countDistinct("w").alias("success"))
    return g.select(*longs("run", "windows", "success"), (F.col("windows") - F.col("success")).cast("long").alias("failed"))


@query(f"WITH RECURSIVE {_OPEN_SQL} SELECT e.run, CAST(e.n AS BIGINT) AS entities, CAST(coalesce(a.n, 0) AS BIGINT) AS active_actions FROM (SELECT run, count(DISTINCT entity) AS n FROM ob GROUP BY run) e LEFT JOIN (SELECT run, count(*) AS n FROM oa GROUP BY run) a ON a.run = e.run")
def report_final_counts(spark, sf_dir):
    entities = observed(spark, sf_dir).groupBy("run").agg(F.countDistinct("entity").alias("entities"))
    return entities.join(_actions(spark, sf_dir).groupBy("run").agg(F.count("*").alias("active_actions")), "run", "left").select("run", "entities", F.coalesce("active_actions", F.lit(0)).alias("active_actions"))


@query(f"""WITH {OBSERVED_SQL}, s AS (SELECT run, event_id, w - CASE WHEN k % 50 = 0 THEN 2 ELSE 0 END AS committed FROM ob), n AS (SELECT *, lag(committed) OVER (PARTITION BY run ORDER BY event_id) AS before FROM s)
 SELECT run, CAST(count(*) FILTER (committed < before) AS BIGINT) AS falls, arg_max(committed, event_id) = max(committed) AS last_is_final FROM n GROUP BY run""")
def report_snapshot_monotonic(spark, sf_dir):
    """Snapshots in order of arrival, of which some are of a window that is two back: how often the window falls, and whether the last is the final one."""
    s = observed(spark, sf_dir).select("run", "event_id", (F.col("w") - F.when(F.col("k") % 50 == 0, 2).otherwise(0)).alias("committed"))
    s = s.withColumn("before", F.lag("committed").over(Window.partitionBy("run").orderBy("event_id")))
    return s.groupBy("run").agg(F.count_if(F.col("committed") < F.col("before")).alias("falls"), (F.max_by("committed", "event_id") == F.max("committed")).alias("last_is_final"))


@query(f"""WITH {OBSERVED_SQL}, n AS (SELECT run, entity % 3 AS et, kind, k % 4 AS a FROM ob), s AS (SELECT run, CASE WHEN a = 3 THEN 'out_of_vocabulary' WHEN (a < 2 AND et = 2) OR (a = 2 AND et = 0) THEN 'invalid_for_entity_type' WHEN (a < 2 AND kind NOT IN ('click', 'view')) OR (a = 2 AND kind NOT IN ('purchase', 'view', 'signup')) THEN 'out_of_vocabulary' ELSE 'alias_mapped' END AS status FROM n)
 SELECT run, CAST(count(*) FILTER (status = 'out_of_vocabulary') AS BIGINT) AS oov, round(count(*) FILTER (status = 'out_of_vocabulary') / count(*), 9) AS oov_rate, CAST(count(*) FILTER (status = 'invalid_for_entity_type') AS BIGINT) AS invalid FROM s GROUP BY run""")
def attribute_oov_rates(spark, sf_dir):
    rows = c.normalize_attributes(spark, sf_dir).join(observed(spark, sf_dir).select("event_id", "run"), "event_id")
    n = F.count_if(F.col("normalization_status") == "out_of_vocabulary")
    return rows.groupBy("run").agg(n.alias("oov"), F.round(reports.rate(n, F.count("*")), 9).alias("oov_rate"), F.count_if(F.col("normalization_status") == "invalid_for_entity_type").alias("invalid"))


@query(f"""WITH {OBSERVED_SQL}, wn AS (SELECT run, w, count(*) AS n, count(*) FILTER (kind = 'error') >= 2 AS bad, bool_or(kind = 'purchase') AS tools FROM ob GROUP BY run, w), go AS (SELECT ob.* FROM ob JOIN wn ON wn.run = ob.run AND wn.w = ob.w AND NOT wn.bad),
 tx AS (SELECT run, w, bad, CASE WHEN bad THEN 'ERROR: Timeout - ' || n || ' events' ELSE n || ' events' || CASE WHEN tools THEN ', tools used' ELSE '' END END AS item FROM wn)
 SELECT run, 'status' AS section, CAST(NULL AS BIGINT) AS w, CASE WHEN bad THEN 'error' ELSE 'ok' END AS item, count(*) AS n FROM wn GROUP BY ALL
 UNION ALL SELECT run, 'summary', w, item, 1 FROM tx UNION ALL SELECT run, 'timeline', w, item, 1 FROM tx WHERE NOT bad AND item LIKE '%tools%'
 UNION ALL SELECT run, 'entity', NULL, entity || ' (' || CASE WHEN entity % 4 = 0 THEN 'unknown' ELSE 't' || (entity % 3) END || ')', count(*) FROM go GROUP BY ALL
 UNION ALL SELECT run, 'action', NULL, entity || ' ' || kind || ' ' || CASE WHEN k % 2 = 0 THEN 'k' || k ELSE '' END || ' [seen]', count(*) FROM go GROUP BY ALL
 UNION ALL SELECT run, 'action_window', w, entity || ' ' || kind || ' ' || CASE WHEN k % 2 = 0 THEN 'k' || k ELSE '' END || ' [seen]', count(*) FROM go GROUP BY ALL
 UNION ALL SELECT run, 'change', w, entity || ' door closed -> open', count(*) FROM go WHERE k % 7 = 0 GROUP BY ALL
 UNION ALL SELECT run, 'result', w, entity || ' ' || kind || ' - k' || k, count(*) FROM go WHERE kind = 'purchase' GROUP BY ALL
 UNION ALL SELECT run, 'uncertainty', w, arg_min('device ' || k || ' | ' || kind, event_id), 1 FROM go WHERE k % 5 = 0 GROUP BY run, w""")
def report_window_parts(spark, sf_dir):
    """All parts of the window report; steps with two errors or more failed."""
    col, lit, s = F.col, F.lit, lambda n: F.col(n).cast("string")
    o = observed(spark, sf_dir)
    e = F.struct("event_id", s("entity").alias("entity_id"), F.when(col("entity") % 4 != 0, F.concat(lit("t"), (col("entity") % 3).cast("string"))).alias("name"), "kind", "k")
    g = o.groupBy("run", "w").agg(F.array_sort(F.collect_list(e)).alias("events"), F.count_if(col("kind") == "error").alias("errors"), F.count("*").alias("n"), F.bool_or(col("kind") == "purchase").alias("tools"))
    part = lambda where, **fields: F.transform(F.filter("events", where), lambda x: F.named_struct(*[y for k, f in fields.items() for y in (lit(k), f(x))]))
    always, k_text = lambda x: lit(True), lambda x: F.concat(lit("k"), x["k"].cast("string"))
    analysis = F.struct(
        F.concat(s("n"), lit(" events"), F.when(col("tools"), ", tools used").otherwise("")).alias("window_summary"),
        part(always, entity_id=lambda x: x["entity_id"], name=lambda x: x["name"]).alias("entities"),
        part(always, actor_id=lambda x: x["entity_id"], action=lambda x: x["kind"], object_id=lambda x: F.when(x["k"] % 2 == 0, k_text(x)), status=lambda x: lit("seen")).alias("actions"),
        part(lambda x: x["k"] % 7 == 0, entity_id=lambda x: x["entity_id"], attribute=lambda x: lit("door"), before=lambda x: lit("closed"), after=lambda x: lit("open")).alias("state_changes"),
        part(lambda x: x["kind"] == "purchase", object_id=lambda x: x["entity_id"], result_type=lambda x: x["kind"], result=k_text).alias("observed_results"),
        part(always, target=lambda x: F.concat(F.when(x["k"] % 5 == 0, "device ").otherwise("person "), x["k"].cast("string")), reason=lambda x: x["kind"]).alias("uncertainties"),
    )
    error = F.struct(lit("Timeout").alias("type"), F.concat(s("n"), lit(" events")).alias("message"))
    records = g.select("run", "w", F.when(col("errors") >= 2, "error").otherwise("ok").alias("status"), error.alias("error"), analysis.alias("analysis"))
    return reports.window_report(records, "device|cabinet", "tools|cable")
