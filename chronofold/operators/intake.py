"""Between an answer and a valid observation: windows, adapters, joins and error rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Types whose name and number make a global id.
FORMAL_TYPES = ("person", "device", "component", "tool", "ppe", "sign", "document", "environment", "equipment")
#: Beginnings of local ids and what they say of the type.
PREFIX_TYPES = {"person": "person", "worker": "person", "operator": "person", "tool": "tool", "device_tool": "tool", "device": "device", "cabinet": "device", "panel": "device"}
PERSON_ROLES = ("operator", "worker", "person")
PHASES = ("starting", "ongoing", "possibly_completed", "instant", "unknown")
#: Errors by stage, and whether a later stage takes its work back (rollback) or the run ends (abort).
ERRORS = {"extract": ("parse_error", "skip"), "parse": ("parse_error", "skip"), "schema": ("schema_error", "skip"), "references": ("semantic_error", "skip"), "evidence": ("replay_error", "abort"), "join": ("replay_error", "abort"), "state": ("state_error", "rollback")}


def inject_window(observation: Column, window: Column) -> tuple[Column, Column]:
    """The observation's text with the program's window where it names none, and whether that was done.

    observation: JSON text of an object; window: JSON text.
    """
    missing = ~F.array_contains(F.json_object_keys(observation), "window")
    inside = F.ltrim(F.substring(F.ltrim(observation), 2, 2**31 - 1))
    comma = F.when(inside.startswith("}"), "").otherwise(", ")
    return F.when(missing, F.concat(F.lit('{"window": '), window, comma, inside)).otherwise(observation), missing


def override_window(observations: DataFrame, windows: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """observations with the program's window columns in place of their own, and whether one differed."""
    ours = windows.select(*key, *[F.col(c).alias(f"_{c}") for c in columns])
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    rest = [c for c in observations.columns if c not in columns]
    return observations.join(ours, key).select(*rest, *[F.col(f"_{c}").alias(c) for c in columns], differs.alias("window_overridden"))


def migrate_attribute(attribute_key: Column, attribute: Column, raw_attribute: Column, value: Column, raw_value: Column) -> Column:
    """Attribute fields under both spellings, with the raw ones filled."""
    key = F.coalesce(attribute_key, attribute)
    return F.struct(key.alias("attribute_key"), F.coalesce(attribute, key).alias("attribute"), F.coalesce(raw_attribute, attribute).alias("raw_attribute"), F.coalesce(raw_value, value).alias("raw_value"))


def evidence_indices(evidence: Column, frames: Column) -> Column:
    """Sorted distinct indices of evidence given as numbers or as `F3` in an array of text; those without a frame (0 .. frames - 1) go."""
    found = F.transform(evidence, lambda x: F.regexp_extract(x, r"^F?(\d{1,9})$", 1))
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, lambda x: F.when(x != "", x).cast("int")), lambda i: i < frames)))


def is_formal_id(x: Column) -> Column:
    """True for a known type, an underscore and digits: the form of a global id."""
    return F.coalesce(F.substring_index(x, "_", 1).isin(*FORMAL_TYPES) & F.regexp_like(F.substring_index(x, "_", -1), F.lit(r"^\d+$")) & (F.size(F.split(x, "_")) == 2), F.lit(False))


def infer_type(local_id: Column, role: Column) -> Column:
    """Entity type by the id's beginning (in the order stated), else by the role, else unknown."""
    low = F.lower(local_id)
    out = F.lit("unknown")
    out = F.when(F.lower(role).isin(*PERSON_ROLES), "person").otherwise(out)
    for prefix, kind in reversed(list(PREFIX_TYPES.items())):
        out = F.when(low.startswith(prefix), kind).otherwise(out)
    return out


def compact_entities(rows: DataFrame, window: list[str]) -> DataFrame:
    """Entities of compact observations (local_id, role, evidence): the type is inferred, the confidence 0; blank and unknown ids give none."""
    named = F.coalesce(F.trim("local_id"), F.lit(""))
    return rows.where(~named.isin("", "unknown")).select(*window, "local_id", infer_type(F.col("local_id"), F.col("role")).alias("entity_type"), F.col("local_id").alias("name"), F.lit(0.0).alias("confidence"), "evidence")


def compact_actions(actions: DataFrame, entities: DataFrame, window: list[str]) -> DataFrame:
    """Actions of compact observations: position, actor, type, phase, evidence.

    An actor that isn't the window's entity becomes the window's only one; a
    blank type and an unknown phase become unknown; without evidence of its own
    an action has its window's.
    """
    only = entities.groupBy(*window).agg(F.min("local_id").alias("_only"), F.countDistinct("local_id").alias("_n"), F.first("evidence").alias("_evidence"))
    both = actions.join(only, window, "left")
    actor = F.when((F.col("_n") == 1) & (F.coalesce("actor", F.lit("")) != F.col("_only")), F.col("_only")).when(F.col("_n") == 1, F.col("actor"))
    kind = F.when(F.coalesce(F.trim("type"), F.lit("")) == "", "unknown").otherwise(F.col("type"))
    local = F.format_string("local_action_%04d", F.col("position"))
    evidence = F.when(F.size(F.coalesce("evidence", F.array().cast("array<int>"))) > 0, F.col("evidence")).otherwise(F.col("_evidence"))
    return both.select(*window, local.alias("local_id"), actor.alias("actor"), kind.alias("type"), F.when(F.col("phase").isin(*PHASES), F.col("phase")).otherwise("unknown").alias("phase"), F.lit(0.0).alias("confidence"), evidence.alias("evidence"))


def shorthand_entities(entities: DataFrame, window: list[str]) -> DataFrame:
    """Entities (position, local_id, entity_type, candidate) with formal-looking ids moved to candidate and new local ids; given keeps the old id."""
    formal = is_formal_id(F.col("local_id"))
    kind = F.coalesce("entity_type", F.lit("unknown"))
    fresh = F.when(formal, F.concat(kind, F.lit("_local_"), F.lpad(F.col("position").cast("string"), 4, "0"))).when(F.col("local_id").isNull(), F.format_string("entity_%04d", F.col("position"))).otherwise(F.col("local_id"))
    return entities.select(*window, "position", fresh.alias("local_id"), kind.alias("entity_type"), F.coalesce("candidate", F.when(formal, F.col("local_id"))).alias("candidate"), F.col("local_id").alias("given"))


def shorthand_actions(actions: DataFrame, entities: DataFrame, frames: DataFrame, window: list[str], roles: tuple[str, ...] = ("actor", "target", "tool")) -> DataFrame:
    """Actions (position, local_id, type, phase, references, start_frame, end_frame) in terms of shorthand_entities.

    References go by an entity's given, new or candidate id, through equi joins;
    those to nothing are dropped.  Frames from start to end that were sampled
    (frames: window, n) are the evidence.  An id that is an entity's, or none,
    becomes one made from the position.
    """
    ids = F.array_distinct(F.array_compact(F.array("given", "local_id", "candidate")))
    known = entities.select(*window, F.col("local_id").alias("_local"), F.explode(ids).alias("_id")).groupBy(*window, "_id").agg(F.min("_local").alias("_local"))
    out = actions
    for role in roles:
        out = out.join(known.select(*window, F.col("_id").alias(role), F.col("_local").alias(f"_{role}")), [*window, role], "left")
    out = out.join(known.select(*window, F.col("_id").alias("local_id"), F.lit(True).alias("_taken")), [*window, "local_id"], "left").join(frames, window, "left")
    last = F.least(F.coalesce("end_frame", "start_frame"), F.col("n") - 1)
    first = F.greatest(F.col("start_frame"), F.lit(0))
    evidence = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    local = F.when(F.col("local_id").isNull() | F.col("_taken"), F.format_string("local_action_%04d", F.col("position"))).otherwise(F.col("local_id"))
    dropped = F.size(F.filter(F.array(*[F.col(r).isNotNull() & F.col(f"_{r}").isNull() for r in roles]), lambda x: x))
    phase = F.when(F.col("phase").isin(*PHASES), F.col("phase")).otherwise("unknown")
    return out.select(*window, "position", local.alias("local_id"), F.coalesce("type", F.lit("unknown")).alias("type"), phase.alias("phase"), *[F.col(f"_{r}").alias(r) for r in roles], evidence.alias("evidence"), dropped.alias("dropped"))


def outside_vocabulary(actions: DataFrame, vocabulary: DataFrame, raw: str) -> DataFrame:
    """Actions whose raw type is no word of the vocabulary (column action): a warning each, the raw type stays."""
    return actions.join(F.broadcast(vocabulary.select(F.col("action").alias(raw))), raw, "left_anti")


def join_windows(windows: DataFrame, observations: DataFrame, key: list[str], order: str) -> DataFrame:
    """Every window with its observation: of repeated ones the last in order counts, unmatched observations are left out.

    join_error is set where a window has none; repeated tells how many others there were.
    """
    w = Window.partitionBy(*key)
    ranked = observations.withColumn("_r", F.row_number().over(w.orderBy(F.desc(order)))).withColumn("repeated", (F.count("*").over(w) - 1).cast("long")).where("_r = 1").drop("_r")
    out = windows.join(ranked.withColumn("_found", F.lit(True)), key, "left")
    return out.withColumn("join_error", F.when(F.col("_found").isNull(), "missing_observation")).drop("_found")


def without_frames(items: DataFrame, frames: DataFrame, window: list[str], evidence: str) -> DataFrame:
    """Items of any kind that cite evidence in a window without frames."""
    return items.where(F.size(evidence) > 0).join(frames.select(*window).distinct(), window, "left_anti")


def error_rows(failed: DataFrame, key: list[str], stage: str, message: Column) -> DataFrame:
    """Error rows of a stage: key, stage, error_type, effect, message."""
    kind, effect = ERRORS[stage]
    return failed.select(*key, F.lit(stage).alias("stage"), F.lit(kind).alias("error_type"), F.lit(effect).alias("effect"), message.alias("message"))


#: The references of an observation, by what holds them.
REFERENCES = {"action": ("actor", "target", "tool"), "attribute": ("entity",), "relation": ("subject", "object")}


def missing_references(holders: dict[str, DataFrame], entities: DataFrame, window: list[str], entity_id: str) -> DataFrame:
    """window, holder (action, attribute, relation), id, role, ref of every reference to an entity that isn't in its window.

    holders: by their kind, tables with window, id and a column for each of the
    kind's roles in REFERENCES; null references are fine but for attributes and
    relations, which must name theirs.  All roles meet the entities in one join.
    """
    rows = None
    for kind, table in holders.items():
        roles = F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).cast("string").alias("ref")) for r in REFERENCES[kind]]))
        part = table.select(*window, F.lit(kind).alias("holder"), F.col("id").cast("string").alias("id"), roles.alias("r")).select(*window, "holder", "id", "r.role", "r.ref")
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.where(F.col("ref").isNotNull() | (F.col("holder") != "action"))
    known = entities.select(*window, F.col(entity_id).cast("string").alias("ref")).distinct()
    return rows.join(known, [*window, "ref"], "left_anti").select(*window, "holder", "id", "role", "ref")


def log_errors(events: DataFrame, entities: DataFrame, actions: DataFrame, frames: DataFrame) -> DataFrame:
    """run, event_id, error, ref of a state log: repeated event ids, references to entities, actions or sample indices that don't exist, and evidence without times.

    events: run, event_id, w, entity_id, action_id (null for none), samples and
    times (arrays); entities: run, entity_id; actions: run, action_id; frames:
    run, w, i.  References of a kind meet what is known in one join each.
    """
    told = lambda df, error, ref: df.select("run", "event_id", F.lit(error).alias("error"), ref.cast("string").alias("ref"))
    repeated = events.groupBy("run", "event_id").agg(F.count("*").alias("n")).where("n > 1")
    no_entity = events.where("entity_id is not null").join(entities.select("run", "entity_id").distinct(), ["run", "entity_id"], "left_anti")
    no_action = events.where("action_id is not null").join(actions.select("run", "action_id").distinct(), ["run", "action_id"], "left_anti")
    sampled = events.where(F.size("samples") > 0)
    no_frame = sampled.select("run", "w", "event_id", F.explode(F.array_distinct("samples")).alias("i")).join(frames.select("run", "w", "i").distinct(), ["run", "w", "i"], "left_anti")
    untimed = sampled.where(F.coalesce(F.size("times"), F.lit(0)) <= 0)
    out = told(repeated, "duplicate event id", F.lit(None))
    for df, error, ref in ((no_entity, "missing entity", F.col("entity_id")), (no_action, "missing action", F.col("action_id")), (no_frame, "missing sample index", F.col("i")), (untimed, "no timestamps", F.lit(None))):
        out = out.unionByName(told(df, error, ref))
    return out
