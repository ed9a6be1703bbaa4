"""Scenes, absences and attribute states as window functions and ordered folds."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronofold.operators.ranges import numbered, running
from chronofold.sources.scratch import scratch_path, stored


@dataclass(frozen=True)
class AttributeConfig:
    high: float = 0.85
    medium: float = 0.60
    support_windows: int = 2
    max_pending_gap: int = 1
    require_action_support: bool = True

    def __post_init__(self):
        if not 0 <= self.medium <= self.high <= 1:
            raise ValueError("0 <= medium <= high <= 1 must hold")


def scene_segments(windows: DataFrame, change: str = "camera_change", run: str = "run", order: str = "w") -> DataFrame:
    """windows with scene_index (from 1, a camera change starts a scene) and scene_id."""
    w = Window.partitionBy(run).orderBy(order)
    first = F.row_number().over(w) == 1
    index = F.sum(F.when(first | F.col(change), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")
    return windows.withColumn("scene_index", index).withColumn("scene_id", F.format_string("scene_%04d", "scene_index"))


def closeup_visibility(windows: DataFrame, visible: DataFrame) -> DataFrame:
    """What a close-up makes of the entities that were visible when it began: partial or not_visible.

    windows: run, w, close_up, target_partial; visible: run, w and the entity's columns.
    """
    value = F.when(F.col("target_partial"), "partial").otherwise("not_visible")
    return visible.join(windows.where("close_up"), ["run", "w"]).withColumn("visibility", value).drop("close_up", "target_partial")


def absence_intervals(sightings: DataFrame, windows: DataFrame, key: str, max_missing: int) -> DataFrame:
    """What every entity of a run is from its first sighting on, as intervals: run, key, state, from_w, to_w, had.

    windows: run, w, suppressed (no absence is inferred from such a window), one
    row a window of the run.  Active until the first unsuppressed window without
    a sighting, then temporarily_missing, and inactive from the one after
    max_missing of them.  had: unsuppressed windows up to the last sighting
    before from_w.  Rows grow with changes, not with entities times windows:
    the windows that change a state are found by their number among the
    unsuppressed ones.
    """
    counts = stored(running(windows.select("run", "w", "suppressed"), ["run"], ["w"], sums={"n": F.lit(1).cast("long"), "quiet": F.when(F.col("suppressed"), 0).otherwise(1).cast("long")}), "counts")
    at = lambda ahead, name: counts.where(~F.col("suppressed")).select("run", (F.col("quiet") - ahead).alias("quiet"), F.col("n").alias(name))
    seen = sightings.select("run", key, "w").distinct().join(counts.select("run", "w", "n", "quiet"), ["run", "w"])
    seen = seen.join(at(1, "missed_n"), ["run", "quiet"], "left").join(at(max_missing + 1, "gone_n"), ["run", "quiet"], "left")
    what = F.struct("n", "quiet", "missed_n", "gone_n")
    seen = stored(running(seen, ["run", key], ["w"], before={"past": what}), "seen")
    last = seen.groupBy("run", key).agg(F.max_by(what, "w").alias("past")).withColumn("n", F.lit(None).cast("long"))
    after = counts.groupBy("run").agg(F.max("n").alias("last_n"))
    # a sighting ends what its predecessor's absence began; behind the last one everything that the run has begins
    ends = seen.select("run", key, "n", "quiet", "past").unionByName(last.withColumn("quiet", F.lit(None).cast("long"))).join(after, "run")
    upto = F.coalesce(F.col("n") - 1, F.col("last_n"))
    change = lambda state, n, had, when: F.when(when, F.struct(F.lit(state).alias("state"), n.alias("n"), had.alias("had")))
    absent = F.col("past.missed_n") <= upto
    marks = F.array_compact(F.array(
        change("temporarily_missing", F.col("past.missed_n"), F.col("past.quiet"), absent & ((F.col("past.gone_n") > F.col("past.missed_n")) | F.col("past.gone_n").isNull())),
        change("inactive", F.col("past.gone_n"), F.col("past.quiet"), F.col("past.gone_n") <= upto),
        change("active", F.col("n"), F.col("quiet"), F.col("n").isNotNull() & (F.col("past").isNull() | absent)),
    ))
    rows = ends.select("run", key, "last_n", F.explode(marks).alias("m")).select("run", key, "last_n", "m.*").withColumn("back", -F.col("n"))
    rows = running(rows, ["run", key], ["back"], before={"next_n": F.col("n")}).withColumn("to_n", F.coalesce(F.col("next_n") - 1, F.col("last_n")))
    place = lambda n, w: counts.select("run", F.col("n").alias(n), F.col("w").alias(w))
    return rows.join(place("n", "from_w"), ["run", "n"]).join(place("to_n", "to_w"), ["run", "to_n"]).select("run", key, "state", "from_w", "to_w", "had", F.col("n").alias("from_n"), "to_n")


def missing_status(sightings: DataFrame, windows: DataFrame, key: str, max_missing: int) -> DataFrame:
    """absence_intervals for each window from an entity's first sighting on: run, key, w, seen, missed (windows so far), state."""
    counts = stored(running(windows.select("run", "w", "suppressed"), ["run"], ["w"], sums={"n": F.lit(1).cast("long"), "quiet": F.when(F.col("suppressed"), 0).otherwise(1).cast("long")}), "counts")
    spans = absence_intervals(sightings, windows, key, max_missing)
    each = spans.withColumn("n", F.explode(F.sequence("from_n", "to_n"))).join(counts, ["run", "n"])
    each = each.join(sightings.select("run", key, "w").distinct().withColumn("seen", F.lit(True)), ["run", key, "w"], "left")
    missed = F.when(F.col("state") == "active", 0).otherwise(F.col("quiet") - F.col("had")).cast("long")
    return each.select("run", key, "w", F.coalesce("seen", F.lit(False)).alias("seen"), missed.alias("missed"), "state")


def partners(members: DataFrame, group: list[str], member: str, block: int = 1024, most: int = 50_000_000, listed: int = 128) -> DataFrame:
    """group, member, partner: every member of a group (distinct rows) with every other one, in both directions.

    The members of a large group are dealt over tasks, some `block` to each, to
    which lists of about `listed` partners are copied.  A pair is made where it
    is returned, never shuffled, and there are as many tasks as some `most` pairs
    each ask for.  All members of a task meet one list before the next, so that
    a table written from it repeats what lies near and is stored small.
    """
    members = stored(members.select(*group, member), "members")
    sizes = members.groupBy(*group).agg(F.count("*").alias("_n"))
    whole = sizes.agg(F.sum(F.col("_n").cast("double") * F.col("_n"))).first()[0] or 0
    tasks = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(whole / most))
    blocks = F.ceil(F.col("_n") / block).cast("int")
    dealt = members.join(sizes, group).withColumn("_deals", blocks).withColumn("_deal", F.pmod(F.xxhash64(member), F.col("_deals")).cast("int"))
    lists = dealt.groupBy(*group, "_deals", F.pmod(F.xxhash64(F.lit(1), member), F.ceil(F.col("_n") / listed)).alias("_block")).agg(F.collect_list(member).alias("_others"))
    lists = lists.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.col("_deals") - 1))).select(*group, "_deal", "_others")
    on = [*group, "_deal"]
    # numbers of tasks that are asked for aren't lowered by the size of what is read, which pairs outgrow
    mine = dealt.select(*group, "_deal", member).repartition(tasks, *on)
    met = lists.repartition(tasks, *on).join(mine.hint("shuffle_hash"), on)
    return met.select(*group, member, F.explode("_others").alias("partner")).where(F.col(member) != F.col("partner"))


def _chained(support: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rows, one a key and window, with the columns _g and _c that tell chains apart; a change of the camera begins a chain."""
    changes = F.sum(F.when(F.col("camera_change"), 1).otherwise(0)).over(Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return support.withColumn("_g", F.col(order) - F.row_number().over(Window.partitionBy(*key).orderBy(order))).withColumn("_c", changes)


def support_chains(support: DataFrame, key: list[str], order: str = "w") -> DataFrame:
    """Runs of consecutive windows of each key within a scene: chain start, last window, length.

    support: key, order, camera_change (of the window); rows may be repeated.
    """
    rows = _chained(support.groupBy(*key, order).agg(F.bool_or("camera_change").alias("camera_change")), key, order)
    return rows.groupBy(*key, "_g", "_c").agg(F.min(order).cast("long").alias("first_w"), F.max(order).cast("long").alias("last_w"), F.count("*").alias("windows")).drop("_g", "_c")


#: A step's state: status, value, pending value and its chain, counters, and the event of the last step.
STATE = "struct<status:string,value:string,pending:string,chain:int,last_support:bigint,confirmed:boolean,support:int,contradict:int,event:string,reason:string>"


def attribute_step(acc: Column, x: Column, config: AttributeConfig = AttributeConfig()) -> Column:
    """The state after one observation x(w, v, c, in_commit, acted, single_high, swept, camera_change).

    Values are compared by text.  A conflict stays, though its pending value may
    be dropped; low confidence only leaves an observed event.  Support is counted
    over consecutive windows of a scene: a camera change begins anew.  A pending value that wasn't supported for longer than the
    gap is dropped before the observation counts: by the last window between this
    observation and the one before it (swept, null if there is none), or by this
    one unless its confidence is low.
    """
    high, low = x["c"] >= config.high, x["c"] < config.medium
    text = lambda s: F.lit(s).cast("string")
    none = F.lit(None).cast("string")

    def state(status, value, pending, chain, last, confirmed, support, contradict, event, reason):
        names = ["status", "value", "pending", "chain", "last_support", "confirmed", "support", "contradict", "event", "reason"]
        kinds = ["string", "string", "string", "int", "bigint", "boolean", "int", "int", "string", "string"]
        return F.struct(*[(c if isinstance(c, Column) else F.lit(c)).cast(k).alias(n) for c, k, n in zip((status, value, pending, chain, last, confirmed, support, contradict, event, reason), kinds, names, strict=True)])

    def go(a: Column) -> Column:
        same, same_pending = x["v"] == a["value"], x["v"] == a["pending"]
        chain = F.when((a["last_support"] == x["w"] - 1) & ~x["camera_change"], a["chain"] + 1).otherwise(1)
        enough = (chain >= config.support_windows) & x["in_commit"]
        direct = x["in_commit"] & high & (x["acted"] | F.lit(not config.require_action_support) | x["single_high"])
        keep = lambda event, reason, **c: state(*(c.get(n, a[n]) for n in ("status", "value", "pending", "chain", "last_support", "confirmed", "support", "contradict")), event, reason)
        start = lambda event, reason, **c: keep(event, reason, pending=x["v"], chain=F.lit(1), last_support=x["w"], **c)
        clear = {"pending": none, "chain": F.lit(0), "last_support": F.lit(None)}
        confirmed = (
            F.when(same, keep(none, none, support=a["support"] + 1, **clear))
            .when(direct, keep("attribute_transition", F.when(x["acted"], text("high_confidence_with_action_support")).otherwise(text("single_high_policy")), value=x["v"], support=a["support"] + 1, **clear))
            .when(same_pending & enough, keep("attribute_transition", "consecutive_window_support", value=x["v"], support=a["support"] + 1, **clear))
            .when(same_pending, keep("attribute_pending", "awaiting_confirmation_support", chain=chain, last_support=x["w"]))
            .when(a["pending"].isNotNull(), keep("attribute_conflict", "conflicting_pending_value", status=F.lit("conflicted"), contradict=a["contradict"] + 1))
            .otherwise(start("attribute_pending", "awaiting_confirmation_support"))
        )
        pending = (
            F.when(same_pending & enough, keep("attribute_confirmed", "pending_value_confirmed", status=F.lit("confirmed"), value=x["v"], confirmed=F.lit(True), support=a["support"] + 1, **clear))
            .when(same_pending, keep("attribute_pending", "awaiting_confirmation_support", chain=chain, last_support=x["w"]))
            .otherwise(keep("attribute_conflict", "conflicting_pending_value", status=F.lit("conflicted"), contradict=a["contradict"] + 1))
        )
        observed = F.when(high, keep("attribute_initialized", F.when(same, text("observed_value_confirmed")).otherwise(text("high_confidence_replaces_observed")), status=F.lit("confirmed"), value=x["v"], confirmed=F.lit(True), support=a["support"] + 1, **clear)).otherwise(
            start("attribute_pending", "observed_value_pending", status=F.lit("pending"), value=x["v"])
        )
        return F.when(a["status"] == "confirmed", confirmed).when(a["status"] == "pending", pending).when(a["status"] == "observed", observed).otherwise(keep(none, none))

    first = (
        F.when(low, state("observed", x["v"], None, 0, None, False, 0, 0, "attribute_observed", "low_confidence_observation"))
        .when(high, state("confirmed", x["v"], None, 0, None, True, 1, 0, "attribute_initialized", "initial_high_confidence_observation"))
        .otherwise(state("pending", x["v"], x["v"], 1, x["w"], False, 0, 0, "attribute_pending", "medium_confidence_initial_observation"))
    )
    now = F.greatest(x["swept"], F.when(~low, x["w"]))
    late = F.coalesce(acc["pending"].isNotNull() & (now - acc["last_support"] > config.max_pending_gap), F.lit(False))
    back = F.when(acc["status"] == "pending", F.when(acc["confirmed"], "confirmed").otherwise("observed")).otherwise(acc["status"])
    expired = state(back, acc["value"], None, 0, None, acc["confirmed"], acc["support"], acc["contradict"], None, None)

    def seen(a: Column) -> Column:
        return state(a["status"], a["value"], a["pending"], a["chain"], a["last_support"], a["confirmed"], a["support"], a["contradict"], "attribute_observed", "low_confidence_observation")

    # a one-element transform binds the state after expiry once
    later = F.transform(F.array(F.when(late, expired).otherwise(acc)), lambda a: F.when(low, seen(a)).otherwise(go(a)))[0]
    return F.when(acc["status"].isNull(), first).otherwise(later)


def attribute_states(observations: DataFrame, key: list[str], config: AttributeConfig = AttributeConfig(), block: int = 1024) -> DataFrame:
    """Events of every key in window order: key, w, status, value, pending, last_support, confirmed, event, reason.

    observations: key columns, w, v, c, in_commit, acted, single_high, swept (see
    with_sweeps), camera_change; at most one a key and window.  A key's history
    is folded in blocks of so many observations: each round folds the next block
    of all keys that have one, from the written state of the round before, so no
    row ever holds more than a block.
    """
    item = F.struct("w", "v", "c", "in_commit", "acted", "single_high", "swept", "camera_change")
    log = f"array<struct<w:bigint,s:{STATE}>>"

    def step(acc: Column, x: Column) -> Column:
        return F.transform(F.array(attribute_step(acc["s"], x, config)), lambda s: F.struct(s.alias("s"), F.array_append(acc["log"], F.struct(x["w"].cast("long").alias("w"), s.alias("s"))).alias("log")))[0]

    def fold(rows: DataFrame, states: DataFrame | None) -> DataFrame:
        items = rows.groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias("items"))
        if states is None:
            items = items.withColumn("s", F.lit(None).cast(STATE))
        else:
            named = states.select(*[F.col(k).alias(f"_{k}") for k in key], "s")
            same = F.lit(True)
            for k in key:
                same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
            items = items.join(named, same, "left").select(*key, "items", "s")
        zero = F.struct(F.col("s"), F.array().cast(log).alias("log"))
        return items.select(*key, F.aggregate("items", zero, step)["log"].alias("log"))

    most = observations.groupBy(*key).count().agg(F.max("count")).first()[0] or 0
    if most <= block:
        logs = [fold(observations, None)]
    else:
        rows = numbered(observations, key, ["w"], "_i", 0).withColumn("_block", F.floor(F.col("_i") / block))
        path = scratch_path(observations.sparkSession, "histories")
        rows.write.partitionBy("_block").parquet(path)
        logs, states = [], None
        for i in range(-(-most // block)):
            # all rows of a block lie in its own folder
            part = observations.sparkSession.read.schema(rows.drop("_block").schema).parquet(f"{path}/_block={i}")
            logs.append(stored(fold(part, states), "states"))
            states = logs[-1].select(*key, F.element_at("log", -1)["s"].alias("s"))
    whole = logs[0]
    for more in logs[1:]:
        whole = whole.unionByName(more)
    return whole.select(*key, F.explode("log").alias("e")).select(*key, "e.w", "e.s.status", "e.s.value", "e.s.pending", "e.s.last_support", "e.s.confirmed", "e.s.event", "e.s.reason")


def with_sweeps(observations: DataFrame, windows: DataFrame, key: list[str], run: str = "run") -> DataFrame:
    """observations with swept: the last window of the run before theirs that comes after the key's observation before; null if there is none.

    windows: run, w, one row a window that wasn't a gap.
    """
    before = windows.select(run, "w", F.lag("w").over(Window.partitionBy(run).orderBy("w")).alias("_p"))
    rows = observations.join(before, [run, "w"])
    last = F.lag("w").over(Window.partitionBy(*key).orderBy("w"))
    return rows.withColumn("swept", F.when(F.col("_p") > last, F.col("_p"))).drop("_p")


def expired_pending(states: DataFrame, observations: DataFrame, windows: DataFrame, key: list[str], run: str = "run", config: AttributeConfig = AttributeConfig()) -> DataFrame:
    """Pending values that weren't supported for longer than the gap: key, w (the window that finds it), pending, status (before).

    The first window of the run without an observation of the key finds it, also
    when the key is never seen again; else the key's next observation that isn't
    of low confidence.  The pending value of a conflict is dropped alike; the
    conflict stays.
    """
    o = Window.partitionBy(*key).orderBy("w")
    rows = states.join(observations.select(*key, "w", "c"), [*key, "w"]).withColumn("next_w", F.lead("w").over(o)).withColumn("next_c", F.lead("c").over(o))
    rows = rows.where(F.col("pending").isNotNull())
    due = F.greatest(F.col("w"), F.col("last_support") + config.max_pending_gap) + 1
    # the first window from `due` on, by one sorted pass over a run's windows and what is due in it
    asked = rows.select(*key, "w", "pending", "status", "next_w", "next_c", due.alias("due"))
    marks = windows.select(run, F.col("w").alias("at"), F.col("w").alias("found")).unionByName(asked.select(run, F.col("due").alias("at"), F.lit(None).cast("long").alias("found")).distinct())
    first = F.min("found").over(Window.partitionBy(run).orderBy("at").rangeBetween(Window.currentRow, Window.unboundedFollowing))
    sweeps = marks.withColumn("sweep", first).where("found is null").select(run, F.col("at").alias("due"), "sweep")
    both = asked.join(sweeps, [run, "due"])
    own = (F.col("next_c") >= config.medium) & (F.col("next_w") >= F.col("due"))
    at = F.when(F.col("sweep") < F.coalesce("next_w", F.col("sweep") + 1), F.col("sweep")).when(own, F.col("next_w"))
    return both.withColumn("w", at).where("w is not null").select(*key, "w", "pending", "status")


def scene_events(windows: DataFrame, enabled: bool = True, run: str = "run", order: str = "w") -> DataFrame:
    """run, w, event_type, scene_id, previous_id of every window's scene events.

    windows: run, w, camera_change, reframed.  The first window starts a scene; a
    camera change starts another, unless scenes aren't enabled; a window that is
    reframed goes on with a scene_reframed.  A camera change or reframing is told
    as scene_visibility_changed too, whether scenes are enabled or not.
    """
    s = scene_segments(windows.withColumn("_change", F.col("camera_change") & F.lit(enabled)), "_change", run, order)
    w = Window.partitionBy(run).orderBy(order)
    s = s.withColumn("previous_id", F.lag("scene_id").over(w))
    kind = F.when(F.col("previous_id").isNull(), "scene_started").when(F.col("previous_id") != F.col("scene_id"), "scene_changed").when(F.col("reframed"), "scene_reframed")
    framed = F.when(F.col("camera_change") | F.col("reframed"), "scene_visibility_changed")
    s = s.withColumn("event_type", F.explode(F.array_compact(F.array(kind, framed))))
    return s.select(run, order, "event_type", "scene_id", F.when(F.col("event_type") == "scene_changed", F.col("previous_id")).alias("previous_id"))


def visible_list(sightings: DataFrame, segments: DataFrame, key: str, run: str = "run") -> DataFrame:
    """run, scene_id, key, since: the entities of a scene's visible list, which only grows, with the window that added each."""
    return sightings.join(segments.select(run, "w", "scene_id"), [run, "w"]).groupBy(run, "scene_id", key).agg(F.min("w").alias("since"))


def attribute_eligibility(observations: DataFrame, require_evidence: bool = True) -> DataFrame:
    """observations with rejected: the first reason for which an attribute observation isn't used, null if it is.

    observations: entity, key, resolution (status of the entity), normalization,
    evidence (number of frames), in_commit, pending (the attribute's state is).
    """
    none = F.col("evidence") == 0
    context = ~F.when(none, F.lit(not require_evidence)).otherwise(F.col("in_commit")) & ~F.col("pending")
    rejected = (
        F.when(F.col("resolution").isNull(), "unresolved_entity")
        .when(F.col("resolution").isin("ambiguous", "temporary", "rejected_hint"), "ambiguous_entity")
        .when(F.col("normalization").isin("out_of_vocabulary", "invalid_for_entity_type"), "not_in_vocabulary")
        .when(none & F.lit(require_evidence), "no_evidence")
        .when(context, "context_only")
        .when(F.col("entity").isNull() | F.col("key").isNull(), "no_entity_or_key")
    )
    return observations.withColumn("rejected", rejected)


def support_evidence(support: DataFrame, key: list[str], evidence: str, order: str = "w") -> DataFrame:
    """support_chains with the evidence of all windows of a chain, in order of windows."""
    rows = _chained(support.groupBy(*key, order).agg(F.array_sort(F.collect_set(evidence)).alias("_e"), F.bool_or("camera_change").alias("camera_change")), key, order)
    listed = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, "_e"))), lambda x: x["_e"]))
    return rows.groupBy(*key, "_g", "_c").agg(F.min(order).cast("long").alias("first_w"), F.max(order).cast("long").alias("last_w"), listed.alias("evidence")).drop("_g", "_c")
