"""Action lifecycles: sightings become actions, actions go on, are missed and end.

A sighting goes on with an open action of its key (actor, type, target, tool)
or, if its evidence lies in the commit part, starts one.  What a context-only
sighting does depends on what was accepted before it, so histories are folded;
but where an in-commit sighting is alone in its window and no earlier time is
later, the state after it is known whatever came before.  Histories are cut
there: the pieces are folded each by itself, with the sighting at the next cut
at the end, and joined by carrying identities over the cuts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronofold.operators.ranges import numbered, running
from chronofold.sources.scratch import stored

KEY = ["run", "actor", "type", "target", "tool"]


@dataclass(frozen=True)
class LifecycleConfig:
    """Windows that may be missed and gone on after, missed windows that end an action, time from which a repetition is a new action (same unit as t), types that have no duration."""

    continue_max_gap: int = 1
    end_missing: int = 2
    repeat_min_gap: float = 5.0
    instant: tuple[str, ...] = ("press", "switch", "pick_up", "put_down", "hand_over", "receive")


def resolve(sightings: DataFrame, present: DataFrame, window: list[str] = ["run", "w"]) -> DataFrame:  # noqa: B006
    """sightings with actor, target and tool as entities that the window holds, null where it doesn't, and lost (a declared target or tool is null).

    sightings: window, actor, target, tool as declared; present: window, entity.
    """
    known = present.select(*window, "entity").distinct()
    out = sightings
    for role in ("actor", "target", "tool"):
        out = out.join(known.select(*window, F.col("entity").alias(role), F.lit(True).alias(f"_{role}")), [*window, role], "left")
    lost = [F.col(r).isNotNull() & F.col(f"_{r}").isNull() for r in ("target", "tool")]
    return out.withColumn("lost", lost[0] | lost[1]).withColumns({r: F.when(F.col(f"_{r}"), F.col(r)) for r in ("actor", "target", "tool")}).drop("_actor", "_target", "_tool")


def window_counts(windows: DataFrame) -> DataFrame:
    """windows (run, w, camera_change, end) with n, their number in the run from 1, and quiet, how many up to them had no camera change."""
    rows = windows.select("run", "w", "camera_change", "end")
    return running(rows, ["run"], ["w"], sums={"n": F.lit(1).cast("long"), "quiet": F.when(F.col("camera_change"), 0).otherwise(1).cast("long")})


def _fold(items: Column, config: LifecycleConfig, kinds: dict[str, str]) -> Column:
    """Links of a piece's sightings, in order: each with the action it goes on with (0 is the head's), or -1 where it is rejected, and whether it starts one.

    Open actions are kept in the order in which they started; of those that can
    go on, the last observed is taken, and the first of these.
    """
    one = f"struct<n:int,w:bigint,t:{kinds['t']},quiet:bigint,start:{kinds['start']}>"
    link = f"struct<w:bigint,local_id:string,n:int,start:{kinds['start']},new:boolean,tail:boolean,rest:{kinds['rest']}>"
    zero = F.struct(F.array().cast(f"array<{one}>").alias("open"), F.array().cast(f"array<{link}>").alias("log"), F.lit(0).alias("made"))
    none = F.lit(None).cast(kinds["start"])

    def step(acc: Column, x: Column) -> Column:
        # windows without a camera change between the last observation and this window
        missed = lambda a: x["quiet"] - F.when(x["camera_change"], 0).otherwise(1) - a["quiet"]
        near = lambda a: x["w"] - a["w"] <= config.continue_max_gap + 1
        fits = lambda a: near(a) & (x["t"] - a["t"] < config.repeat_min_gap) & (missed(a) < config.end_missing)
        best = F.when(~x["head"] & ~x["camera_change"], F.array_max(F.transform(F.filter(acc["open"], fits), lambda a: F.struct(a["w"].alias("w"), (-a["n"]).alias("m"), a["start"].alias("start")))))
        n = lambda b: F.when(x["head"], 0).when(b.isNotNull(), -b["m"]).when(x["in_commit"], acc["made"] + 1).otherwise(-1).cast("int")

        def settle(c: Column) -> Column:
            n, new = c["n"], c["new"]
            now = F.struct(n.alias("n"), x["w"].alias("w"), x["t"].alias("t"), x["quiet"].alias("quiet"), c["start"].alias("start")).cast(one)
            stay = F.filter(acc["open"], lambda a: (a["n"] != n) & near(a))
            told = F.struct(x["w"].alias("w"), x["local_id"].alias("local_id"), n.alias("n"), c["start"].alias("start"), new.alias("new"), x["tail"].alias("tail"), x["rest"].alias("rest")).cast(link)
            return F.struct(F.when(n >= 0, F.array_append(stay, now)).otherwise(stay).alias("open"), F.array_append(acc["log"], told).alias("log"), F.greatest(acc["made"], n).alias("made"))

        def choose(b: Column) -> Column:
            start = F.when(b.isNotNull(), b["start"]).when(~x["head"], x["start"]).otherwise(none)
            chosen = F.struct(n(b).alias("n"), start.alias("start"), (~x["head"] & b.isNull() & x["in_commit"]).alias("new"))
            return F.transform(F.array(chosen), settle)[0]

        # one-element transforms bind what is used more than once
        return F.transform(F.array(best), choose)[0]

    return F.aggregate(items, zero, step)["log"]


def link_sightings(sightings: DataFrame, counts: DataFrame, config: LifecycleConfig = LifecycleConfig()) -> DataFrame:
    """Accepted sightings with start_w and start_id, the sighting that started their action, new, and lost, confidence, t, n and quiet.

    sightings: run, w, local_id (unique in its window), actor, type, target,
    tool, in_commit, t, lost, confidence; counts: see window_counts.  Sightings
    without an actor, and context-only ones that go on with no open action, are
    left out.  Sightings of a window go in the order of local_id.  One that
    nothing of its key can reach or be reached from isn't folded.
    """
    rows = sightings.where(F.col("actor").isNotNull()).join(counts.select("run", "w", "camera_change", "n", "quiet"), ["run", "w"])
    start = F.struct(F.col("w").cast("long").alias("w"), F.col("local_id").cast("string").alias("local_id"))
    rows = rows.select(*KEY, F.col("w").cast("long").alias("w"), F.col("local_id").cast("string").alias("local_id"), "in_commit", "t", "camera_change", "quiet", start.alias("start"), F.struct("lost", "confidence", "t", "n", "quiet").alias("rest"))
    kinds = {"t": rows.schema["t"].dataType.simpleString(), "start": "struct<w:bigint,local_id:string>", "rest": rows.schema["rest"].dataType.simpleString()}
    by = Window.partitionBy(*KEY).orderBy("w", "local_id")
    near = Window.partitionBy(*KEY).orderBy("w").rangeBetween(-(config.continue_max_gap + 1), -1)
    alone = F.coalesce(F.lag("w").over(by) != F.col("w"), F.lit(True)) & F.coalesce(F.lead("w").over(by) != F.col("w"), F.lit(True))
    apart = F.coalesce(F.col("w") - F.lag("w").over(by) > config.continue_max_gap + 1, F.lit(True))
    known = F.col("in_commit") & alone & (F.coalesce(F.max("t").over(near), F.col("t")) <= F.col("t"))
    rows = rows.select("*", known.alias("head"), apart.alias("apart"))
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("*", F.sum(F.when(F.col("head") | F.col("apart"), 1).otherwise(0)).over(upto).cast("long").alias("piece"), (F.col("apart") & F.coalesce(F.lead("apart").over(by), F.lit(True))).alias("single"))
    rows = stored(rows, "sightings")
    instant = F.col("type").isin(*config.instant) if config.instant else F.lit(False)
    at_once = rows.where(F.col("in_commit") & (instant | F.col("single"))).select(*KEY, "w", "local_id", F.col("w").alias("start_w"), F.col("local_id").alias("start_id"), F.lit(True).alias("new"), "rest.*")
    rows = rows.where(~instant & ~F.col("single"))
    # a sighting at a cut is looked at by the piece before, unless nothing before can reach it
    own = rows.withColumn("tail", F.lit(False))
    tails = rows.where("head and not apart").withColumn("piece", F.col("piece") - 1).withColumn("head", F.lit(False)).withColumn("tail", F.lit(True))
    item = F.struct("w", "local_id", "tail", "head", "in_commit", "t", "camera_change", "quiet", "start", "rest")
    links = own.unionByName(tails).groupBy(*KEY, "piece").agg(F.array_sort(F.collect_list(item)).alias("items"))
    links = stored(links.select(*KEY, "piece", F.explode(_fold(F.col("items"), config, kinds)).alias("e")).select(*KEY, "piece", "e.*"), "links")
    # of a piece's head: the action that it goes on with, told by the piece before: 0 is that piece's own head's
    told = links.where("tail").select(*KEY, (F.col("piece") + 1).alias("piece"), F.col("n").alias("via"), F.when(F.col("new"), F.struct("w", "local_id")).otherwise(F.col("start")).alias("root"))
    heads = links.where("n = 0 and start is null and not tail").select(*KEY, "piece", F.col("w").alias("_w"), F.col("local_id").alias("_id"))
    heads = heads.groupBy(*KEY, "piece").agg(F.min(F.struct("_w", "_id")).alias("h"))
    a, b = heads.alias("a"), told.alias("b")
    on = F.lit(True)
    for k in (*KEY, "piece"):
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    heads = a.join(b, on, "left").select(*[F.col(f"a.{k}").alias(k) for k in (*KEY, "piece")], F.col("h._w").alias("_w"), F.col("h._id").alias("_id"), F.col("b.via").alias("via"), F.col("b.root").alias("root"))
    goes_on = F.coalesce((F.col("via") == 0) & F.col("root").isNull(), F.lit(False))
    mine = F.struct(F.col("_w").alias("w"), F.col("_id").alias("local_id"))
    heads = running(heads, KEY, ["piece"], lasts={"origin": F.when(~goes_on, F.coalesce("root", mine))})
    heads = heads.select(*KEY, "piece", "_w", "_id", "origin")
    a, b = links.where("n >= 0 and not tail").alias("a"), heads.alias("b")
    out = a.join(b, on & F.col("a.start").isNull(), "left")
    first = F.coalesce("a.start", "b.origin")
    new = F.col("a.new") | ((F.col("a.w") == first["w"]) & (F.col("a.local_id") == first["local_id"]))
    out = out.select(*[F.col(f"a.{k}").alias(k) for k in KEY], F.col("a.w").alias("w"), F.col("a.local_id").alias("local_id"), first["w"].alias("start_w"), first["local_id"].alias("start_id"), new.alias("new"), "a.rest.*")
    return out.unionByName(at_once)


def action_log(sightings: DataFrame, windows: DataFrame, config: LifecycleConfig = LifecycleConfig()) -> tuple[DataFrame, DataFrame]:
    """The events of all actions, and the actions as they are at the end of their run.

    sightings: as for link_sightings, with lost (a declared target or tool isn't
    resolved) and confidence; windows: run, w, camera_change, end, one row a
    window that was reduced, for every window of a sighting.

    Events: run, w, action_id, local_id (null where the action wasn't seen),
    event_type, reason.  A window in which an open action isn't seen makes it
    uncertain if the camera changed; any other counts as missed: the action may
    have ended, and has at config.end_missing of them.  Actions: run, action_id,
    the key, lifecycle, start_w, last_w, last_t, windows (observed), confidence
    (the highest), end_w and end_lower, end_upper of ended ones.  Ids number a
    run's actions by window and local_id.
    """
    counts = stored(window_counts(windows), "windows")
    seen = link_sightings(sightings, counts, config)
    is_instant = F.col("type").isin(*config.instant) if config.instant else F.lit(False)
    columns = ["run", "action_id", *KEY[1:], "w", "local_id", "start_w", "new", "lost", "confidence", "t", "n", "quiet"]
    starts = numbered(seen.where("new"), ["run"], ["w", "local_id"], "i").withColumn("action_id", F.format_string("action_%06d", "i"))
    ids = starts.select("run", F.col("w").alias("start_w"), F.col("local_id").alias("start_id"), "action_id")
    rows = starts.select(*columns).unionByName(seen.where(~F.col("new")).join(ids, ["run", "start_w", "start_id"]).select(*columns)).withColumn("instant", is_instant)
    named = (
        F.when(F.col("instant"), "action_instant").when(F.col("lost"), "action_uncertain").when(F.col("new"), "action_started").otherwise("action_continued").alias("event_type"),
        F.when(F.col("new"), "commit_evidence").when(F.col("lost"), "unresolved_reference").otherwise("same_action_key").alias("reason"),
    )
    events = rows.select("run", "w", "action_id", "local_id", *named)
    # windows between a sighting and the action's next one, or those until it ends: from numbers of windows, not from a grid
    open_ = rows.where(~F.col("instant"))
    latest = open_.groupBy("run", "action_id", "w").agg(F.max("n").alias("n"), F.max("quiet").alias("quiet"))
    following = latest.withColumn("next_n", F.lead("n").over(Window.partitionBy("run", "action_id").orderBy("w")))
    ending = counts.where(~F.col("camera_change")).select("run", (F.col("quiet") - config.end_missing).alias("quiet"), F.col("n").alias("end_n"), F.col("w").alias("_end_w"), F.col("end").alias("_end"))
    last = counts.groupBy("run").agg(F.max("n").alias("last_n"), F.max_by("camera_change", "n").alias("last_camera"))
    spans = following.join(ending, ["run", "quiet"], "left").join(last, "run")
    upto = F.least(F.coalesce(F.col("next_n") - 1, F.col("last_n")), F.coalesce("end_n", F.col("last_n")))
    spans = spans.where(upto > F.col("n")).select("run", "action_id", F.col("quiet").alias("had"), F.explode(F.sequence(F.col("n") + 1, upto)).alias("n"))
    missed = spans.join(counts, ["run", "n"])
    gone = F.col("quiet") - F.col("had")
    kind = F.when(F.col("camera_change"), "action_uncertain").when(gone >= config.end_missing, "action_ended").otherwise("action_possible_ended")
    why = F.when(F.col("camera_change"), "camera_change_or_occlusion").otherwise("missing_observation_window")
    missed = missed.select("run", "w", "action_id", F.lit(None).cast("string").alias("local_id"), kind.alias("event_type"), why.alias("reason"))
    events = events.unionByName(missed)

    # the state at the end follows from the last sighting's numbers: windows that miss an action aren't listed
    told = F.when(F.col("instant"), "instant").when(F.col("lost"), "uncertain").when(F.col("new"), "started").otherwise("ongoing").alias("told")
    final = rows.groupBy("run", "action_id", *KEY[1:], "instant").agg(
        F.min("start_w").alias("start_w"), F.max_by(F.struct("w", "t", "n", "quiet", told), F.struct("w", "local_id")).alias("x"), F.size(F.collect_set("w")).cast("long").alias("windows"), F.max("confidence").alias("confidence"),
    )
    final = final.select("*", "x.quiet").join(ending, ["run", "quiet"], "left").join(last, "run")
    ended = ~F.col("instant") & F.col("end_n").isNotNull()
    life = F.when(ended, "ended").when(F.col("instant") | (F.col("last_n") == F.col("x.n")), F.col("x.told")).when(F.col("last_camera"), "uncertain").otherwise("possible_ended")
    final = final.select("run", "action_id", *KEY[1:], life.alias("lifecycle"), "start_w", F.col("x.w").alias("last_w"), F.col("x.t").alias("last_t"), "windows", "confidence", F.when(ended, F.col("_end_w")).alias("end_w"), F.when(ended, F.col("x.t")).alias("end_lower"), F.when(ended, F.col("_end")).alias("end_upper"))
    return events, final


def intake_warnings(sightings: DataFrame, events: DataFrame) -> DataFrame:
    """Sightings that no action took: run, w, local_id, warning (unresolved_actor or context_only)."""
    taken = events.where("local_id is not null").select("run", "w", "local_id")
    left = sightings.select("run", F.col("w").cast("long").alias("w"), F.col("local_id").cast("string").alias("local_id"), "actor").join(taken, ["run", "w", "local_id"], "left_anti")
    return left.select("run", "w", "local_id", F.when(F.col("actor").isNull(), "unresolved_actor").otherwise("context_only").alias("warning"))
