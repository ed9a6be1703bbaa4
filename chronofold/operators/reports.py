"""Bounded context queries, run logs and quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronofold.operators.ranges import numbered, running
from chronofold.sources.scratch import stored


def top_k(rows: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with their rank from 1; the order must be total."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def within_budget(items: DataFrame, group: list[str], order: list[str], size: Column, budget: Column | int, freed: int = 0) -> DataFrame:
    """The prefix of each group's items whose sizes, with a separator each, fit the budget; truncated tells whether items were cut, which frees `freed`."""
    w = Window.partitionBy(*group).orderBy(*order)
    used = F.sum(size + 1).over(w.rowsBetween(Window.unboundedPreceding, 0))
    whole = F.sum(size + 1).over(Window.partitionBy(*group))
    limit = F.lit(budget) if isinstance(budget, int) else budget
    out = items.withColumn("used", used.cast("long")).withColumn("truncated", whole > limit)
    cut = (F.col("used") <= limit + freed) & (F.col("used") < whole)  # at least one item goes before anything is freed
    return out.withColumn("_stays", ~F.col("truncated") | cut).where("_stays").drop("_stays")


def sorted_json(**fields: Column) -> Column:
    """Compact JSON object with sorted keys; nulls are written, other scripts stay as they are."""
    return F.to_json(F.named_struct(*[x for k in sorted(fields) for x in (F.lit(k), fields[k])]), {"ignoreNullFields": "false"})


def context_documents(scenes: DataFrame, lists: dict[str, DataFrame], group: list[str]) -> DataFrame:
    """One JSON document a row of scenes that fits its budget where it can: group, budget, json, characters, truncated, compacted, kept.

    scenes: group (several budgets may share one), scene and compact (JSON objects,
    the second one shorter), changes (a JSON array), budget in characters.
    lists: by the name of a list in the document its rows: group, rank from 1
    without gaps, item (a JSON object).  The lists must be bounded, as by top_k.
    Whole items are cut from the end of the last list, then from the one before
    it; when nothing is left to cut the scene becomes the compact one.  A document
    that is too long even so is kept and its characters tell.  Without items or
    with null scenes the arrays are empty and the scene is {}.
    """
    names = list(lists)
    scenes = scenes.select(*group, "budget", *[F.coalesce(c, F.lit(e)).alias(c) for c, e in (("scene", "{}"), ("compact", "{}"), ("changes", "[]"))]).distinct()
    items = None
    for o, name in enumerate(names):
        part = lists[name].select(*group, F.lit(o).alias("_o"), "rank", "item")
        items = part if items is None else items.unionByName(part)
    w = Window.partitionBy(*group).orderBy("_o", "rank")
    size = F.length("item") + F.when(F.col("rank") > 1, 1).otherwise(0)  # a comma before all but the first
    items = items.withColumn("_used", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    packed = items.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("_o", "rank", "_used", "item"))).alias("_items"))
    rows = scenes.join(packed, group, "left").withColumn("_items", F.coalesce("_items", F.lit([]).cast(packed.schema["_items"].dataType)))

    def document(kept: Column, scene: Column, truncated: Column) -> Column:
        of = lambda o: F.array_join(F.transform(F.filter(kept, lambda x: x["_o"] == o), lambda x: x["item"]), ",")
        fields = {n: F.concat(F.lit("["), of(o), F.lit("]")) for o, n in enumerate(names)}
        fields |= {"recent_scene_changes": F.col("changes"), "scene": scene, "truncated": truncated.cast("string")}
        parts = [F.concat(F.lit(f'{"," if i else ""}"{k}":'), fields[k]) for i, k in enumerate(sorted(fields))]
        return F.concat(F.lit("{"), *parts, F.lit("}"))

    none = F.filter("_items", lambda x: F.lit(False))
    whole = F.coalesce(F.element_at(F.transform("_items", lambda x: x["_used"]), F.when(F.size("_items") > 0, -1).otherwise(None)), F.lit(0))
    rows = rows.withColumn("_base", F.length(document(none, F.col("scene"), F.lit(False)))).withColumn("truncated", F.col("_base") + whole > F.col("budget"))
    # "true" is a character shorter than "false"
    rows = rows.withColumn("_kept", F.when(F.col("truncated"), F.filter("_items", lambda x: (x["_used"] + F.col("_base") - 1 <= F.col("budget")) & (x["_used"] < whole))).otherwise(F.col("_items")))
    over = (F.size("_kept") == 0) & F.when(F.size("_items") > 0, F.col("_base") - 1 > F.col("budget")).otherwise(True)
    rows = rows.withColumn("compacted", F.col("truncated") & over)
    text = document(F.col("_kept"), F.when(F.col("compacted"), F.col("compact")).otherwise(F.col("scene")), F.col("truncated"))
    return rows.withColumn("json", text).select(*group, "budget", "json", F.length("json").cast("long").alias("characters"), "truncated", "compacted", F.size("_kept").cast("long").alias("kept"))


def window_report(records: DataFrame, doubtful: str, telling: str, run: str = "run", order: str = "w") -> DataFrame:
    """The parts of a run's report as rows: run, section, order, item, n; one explode and one grouped count.

    records: one row a window with status, error (type, message) and analysis
    (window_summary and arrays of entities, actions, state_changes,
    observed_results and uncertainties).  Sections: `status`, `entity` and `action`
    count over the whole run and have no window; `action_window` has a row for
    every window of an action; `summary` and `timeline` (summaries that match
    telling) have a row a window; `change` and `result` a row for each different
    one in a window; `uncertainty` is a window's first whose target matches
    doubtful.  A window that isn't ok has its status and, as its summary, its
    error.  Absent texts are empty, absent arrays have no rows.
    """
    a = F.col("analysis")
    text = lambda x, absent="": F.coalesce(x.cast("string"), F.lit(absent))

    def row(section: str, item: Column, windowed: bool = True) -> Column:
        return F.struct(F.lit(section).alias("section"), F.when(F.lit(windowed), F.col(order).cast("long")).alias(order), item.alias("item"))

    def each(field: str, *rows) -> list[Column]:
        return [F.transform(F.coalesce(a[field], F.array().cast(records.schema["analysis"].dataType[field].dataType)), f) for f in rows]

    entity = lambda e: F.concat(text(e["entity_id"], "unknown"), F.lit(" ("), text(e["name"], "unknown"), F.lit(")"))
    action = lambda x: F.concat(F.concat_ws(" ", text(x["actor_id"]), text(x["action"]), text(x["object_id"])), F.lit(" ["), text(x["status"]), F.lit("]"))
    change = lambda x: F.concat_ws(" ", text(x["entity_id"]), text(x["attribute"]), text(x["before"]), F.lit("->"), text(x["after"]))
    result = lambda x: F.concat(text(x["object_id"]), F.lit(" "), text(x["result_type"]), F.lit(" - "), text(x["result"]))
    doubt = F.get(F.filter(a["uncertainties"], lambda u: text(u["target"]).rlike(doubtful)), 0)
    one = lambda x, wanted: F.filter(F.array(x), lambda _: wanted)
    summary = text(a["window_summary"])
    ok = F.concat(
        *each("entities", lambda e: row("entity", entity(e), False)),
        *each("actions", lambda x: row("action", action(x), False), lambda x: row("action_window", action(x))),
        *each("state_changes", lambda x: row("change", change(x))), *each("observed_results", lambda x: row("result", result(x))),
        one(row("uncertainty", F.concat(text(doubt["target"]), F.lit(" | "), text(doubt["reason"]))), doubt.isNotNull()),
        one(row("summary", summary), F.lit(True)), one(row("timeline", summary), summary.rlike(telling)),
    )
    error = F.array(row("summary", F.concat(F.lit("ERROR: "), text(F.col("error.type")), F.lit(" - "), text(F.col("error.message")))))
    rows = records.select(run, F.explode(F.concat(F.array(row("status", F.col("status"), False)), F.when(F.col("status") == "ok", ok).otherwise(error))).alias("x"))
    return rows.groupBy(run, "x.section", f"x.{order}", "x.item").agg(F.count("*").alias("n"))


def snapshot_windows(windows: DataFrame, every: int, run: str = "run", order: str = "w") -> DataFrame:
    """Windows after which a snapshot is written: every n-th formal one, and the last."""
    w = Window.partitionBy(run).orderBy(order)
    out = windows.withColumn("n", F.row_number().over(w).cast("long")).withColumn("last", F.lead(order).over(w).isNull())
    return out.where((F.col("n") % every == 0) | F.col("last")).select(run, order, "n", F.col("last").alias("final"))


def merge_runs(runs: list[DataFrame], order: list[str]) -> DataFrame:
    """Concatenate runs in the given order and number their windows anew from 0.

    A run may span tasks: rows are numbered over sorted ranges.
    """
    union = None
    for i, r in enumerate(runs):
        r = r.withColumn("run_order", F.lit(i).cast("long"))
        union = r if union is None else union.unionByName(r)
    return numbered(union, [], ["run_order", *order], "window_index", 0)


def rate(part: Column, whole: Column, empty: float = 0.0) -> Column:
    return F.when(whole == 0, F.lit(empty)).otherwise(part / whole)


def duplicate_pairs(actions: DataFrame, key: list[str], id_col: str, windows: str, gap: int = 1) -> DataFrame:
    """Unordered pairs of actions with null-safely equal keys and windows at most `gap` apart.

    The actions' windows are exploded with their neighbours, so pairs meet by an
    equi join on key and window, not by comparing all actions of a key.
    """
    one = actions.select(*key, id_col, F.explode(windows).alias("w"))
    near = one.withColumn("w", F.explode(F.sequence(F.col("w") - gap, F.col("w") + gap)))
    a, b = one.alias("a"), near.alias("b")
    same = F.col("a.w") == F.col("b.w")
    for k in key:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.join(b, same & (F.col(f"a.{id_col}") < F.col(f"b.{id_col}"))).select(F.col(f"a.{id_col}").alias("first_id"), F.col(f"b.{id_col}").alias("second_id")).distinct()


def duplicate_groups(actions: DataFrame, key: list[str], id_col: str, first: str, last: str, gap: int = 1) -> DataFrame:
    """Actions with group (the smallest id of those that overlap, directly or through others), members and links.

    Actions of null-safely equal keys overlap if their windows, from first to
    last, are at most `gap` apart.  Sorted by their first window, an action
    begins a group if no earlier one reaches it.  links: how many it overlaps
    itself, as those that begin up to its reach less those that end before it:
    half of their sum is the number of pairs, of which none is made.  Ids are
    unique.
    """
    rows = actions.select(*key, F.col(id_col).alias("_id"), F.col(first).alias("_first"), F.col(last).alias("_last"))
    swept = running(rows, key, ["_first", "_id"], tops={"_reach": F.col("_last")})
    swept = running(swept, key, ["_first", "_id"], sums={"_group": F.when(F.coalesce(F.col("_first") <= F.col("_reach") + gap, F.lit(False)), 0).otherwise(1).cast("long")})
    swept = stored(swept, "sweep")
    groups = swept.groupBy(*key, "_group").agg(F.min("_id").alias("group"), F.count("*").alias("members"))
    same = F.col("_g") == F.col("_group")
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    groups = groups.select(F.col("_group").alias("_g"), *[F.col(k).alias(f"_k_{k}") for k in key], "group", "members")
    out = swept.join(groups, same).select(*key, "_id", "_first", "_last", "group", "members")
    # at one window, an action asks for what ended before it first and for what began up to its reach last
    mark = lambda at, order, begins, ends, asks: F.struct(at.cast("long").alias("at"), F.lit(order).alias("o"), F.lit(begins).cast("long").alias("begins"), F.lit(ends).cast("long").alias("ends"), F.lit(asks).alias("asks"))
    marks = F.array(mark(F.col("_first") - gap, 0, 0, 0, "before"), mark(F.col("_first"), 1, 1, 0, None), mark(F.col("_last"), 1, 0, 1, None), mark(F.col("_last") + gap, 2, 0, 0, "upto"))
    points = rows.select(*key, "_id", F.posexplode(marks).alias("p", "m")).select(*key, "_id", "p", "m.*")
    counted = running(points, key, ["at", "o", "_id", "p"], sums={"begun": F.col("begins"), "ended": F.col("ends")}).where("asks is not null")
    links = counted.groupBy("_id").agg((F.max(F.when(F.col("asks") == "upto", F.col("begun"))) - F.max(F.when(F.col("asks") == "before", F.col("ended"))) - 1).alias("links"))
    return out.join(links, "_id").select(*key, F.col("_id").alias(id_col), F.col("_first").alias(first), F.col("_last").alias(last), "group", "members", "links")


def near_changes(rows: DataFrame, changes: DataFrame, group: list[str], w: str = "w", reach: int = 1) -> DataFrame:
    """Rows whose window is at most `reach` from a change of their group."""
    around = changes.select(*group, F.explode(F.sequence(F.col(w) - reach, F.col(w) + reach)).alias(w)).distinct()
    return rows.join(around, [*group, w], "left_semi")
