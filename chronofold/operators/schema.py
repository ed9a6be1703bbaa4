"""Strict validation of JSON observations: every violation of a schema as a row, without failing a task.

A document is opened level by level into rows of path, pattern (the path with
`[]` for an item) and value, and each level meets the schema, a small table of
patterns, in a broadcast join.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.sources.scratch import stored

#: What schema_of_variant says first of a value of each kind.
_KINDS = {"string": ("STRING",), "number": ("BIGINT", "DOUBLE", "FLOAT", "DECIMAL"), "int": ("BIGINT",), "bool": ("BOOLEAN",), "object": ("OBJECT",), "array": ("ARRAY",)}


@dataclass(frozen=True)
class Field:
    """A field of an object: its kind, whether it must be there or may be null, its range (low, high; above is exclusive), least length, values, fields or items.

    Objects that are open may hold anything.
    """

    kind: str
    required: bool = False
    low: float | None = None
    high: float | None = None
    values: tuple[str, ...] | None = None
    fields: dict[str, Field] | None = None
    items: Field | None = None
    nullable: bool = False
    above: float | None = None
    length: int | None = None
    open: bool = False


_SPEC = "pattern string, parent string, name string, kind string, kinds array<string>, required boolean, nullable boolean, open boolean, low double, high double, above double, length int, values array<string>"


def _flat(fields: dict[str, Field], parent: str = "") -> list[tuple]:
    """Rows of _SPEC for all fields and items; items have no name."""

    def rows(f: Field, pattern: str, parent: str, name: str | None) -> list[tuple]:
        own = (pattern, parent, name, f.kind, list(_KINDS[f.kind]), f.required, f.nullable, f.open, f.low, f.high, f.above, f.length, None if f.values is None else list(f.values))
        return [own, *_flat(f.fields or {}, pattern), *(rows(f.items, pattern + "[]", pattern, None) if f.items else [])]

    return [r for name, f in fields.items() for r in rows(f, f"{parent}.{name}" if parent else name, parent, name)]


#: Texts that stand for truth values.
_TRUTH = ("0", "1", "true", "false", "t", "f", "yes", "no", "y", "n", "on", "off")


def _reason(met: DataFrame) -> Column:
    """Why a value breaks its field's rules, null if it doesn't.

    Numbers may be written as texts, whole ones with a fraction of 0, and truth
    values as 0, 1 or their words.
    """
    text, number = F.col("_text"), F.col("_number")
    written_as = F.col("kind_of").isin("BIGINT", "DOUBLE", "FLOAT", "DECIMAL", "STRING")
    right = (
        F.when(F.array_contains("kinds", F.col("kind_of")), True)
        .when(F.col("kind").isin("number", "int") & written_as, number.isNotNull() & ((F.col("kind") == "number") | (number == F.floor(number))))
        .when((F.col("kind") == "bool") & written_as, F.lower(text).isin(*_TRUTH) | number.isin(0.0, 1.0))
        .otherwise(False)
    )
    right = F.coalesce(right, F.lit(False))
    counted = F.col("kind").isin("number", "int")
    return (
        F.when(F.col("kinds").isNull(), "extra")
        .when(F.col("kind_of") == "VOID", F.when(~F.col("nullable"), "type"))
        .when(~right, "type")
        .when(counted & ((number < F.col("low")) | (number > F.col("high")) | (number <= F.col("above"))), "range")
        .when(F.length(text) < F.col("length"), "length")
        .when(~F.array_contains("values", text), "value")
    )


def violations(docs: DataFrame, key: list[str], v: str, fields: dict[str, Field], rules: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """key, path, reason of every violation: extra, missing, type, range, length, value, or a rule's own reason.

    docs has the documents in the variant column v; what isn't an object, null
    included, has one violation with an empty path.  Below a field that is extra
    or of another type nothing is reported.  rules: by pattern, of objects; what
    each makes of an object's value is a reason or null.  Each level of the
    documents is written once.
    """
    spark = docs.sparkSession
    table = spec_table(spark, fields)
    needed = table.where("required and name is not null").groupBy(F.col("parent").alias("pattern")).agg(F.collect_list("name").alias("needed"))
    kind = lambda x: F.regexp_extract(F.schema_of_variant(x), "^[A-Z]+", 0)
    level = docs.select(*key, F.lit("").alias("path"), F.lit("").alias("pattern"), F.col(v).alias("value"), F.coalesce(kind(F.col(v)), F.lit("VOID")).alias("kind_of"))
    out = [level.where("kind_of <> 'OBJECT'").select(*key, "path", F.lit("type").alias("reason"))]
    level = level.where("kind_of = 'OBJECT'")
    for _ in range(max(r[0].count(".") + r[0].count("[]") for r in _flat(fields)) + 1):
        whole = level.where("kind_of = 'OBJECT'")
        for pattern, rule in (rules or {}).items():
            out.append(whole.where(F.col("pattern") == pattern).select(*key, "path", rule(F.col("value")).alias("reason")).where("reason is not null"))
        gone = whole.join(F.broadcast(needed), "pattern")
        name = F.explode(F.array_except("needed", F.json_object_keys(F.to_json("value"))))
        gone = gone.select(*key, "path", name.alias("name"))
        out.append(gone.select(*key, _child(F.col("path"), F.col("name")).alias("path"), F.lit("missing").alias("reason")))
        below = level.where("kind_of in ('OBJECT', 'ARRAY')").withColumnsRenamed({"value": "_value", "kind_of": "_kind"}).lateralJoin(spark.tvf.variant_explode(F.col("_value").outer()))
        item = F.col("_kind") == "ARRAY"
        below = below.select(*key, F.when(item, F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(_child(F.col("path"), F.col("key"))).alias("path"),
                             F.when(item, F.concat("pattern", F.lit("[]"))).otherwise(_child(F.col("pattern"), F.col("key"))).alias("pattern"), "value", kind(F.col("value")).alias("kind_of"))
        # an object's or array's text would be all that it holds
        plain = below.withColumn("_text", F.when(~F.col("kind_of").isin("OBJECT", "ARRAY"), F.try_variant_get("value", "$", "string")))
        met = plain.join(F.broadcast(table), "pattern", "left")
        # texts are read as numbers only where a number is due: a text that isn't one costs an exception
        due = F.col("kind").isin("number", "int", "bool")
        number = F.when(due & F.col("kind_of").isin(*_KINDS["number"]), F.try_variant_get("value", "$", "double")).when(due & (F.col("kind_of") == "STRING"), F.trim("_text").try_cast("double"))
        met = met.withColumn("_number", number)
        met = stored(met.select(*key, "path", "pattern", "value", "kind_of", "open", _reason(met).alias("reason")), "level")
        out.append(met.where("reason is not null").select(*key, "path", "reason"))
        level = met.where("reason is null and not open").select(*key, "path", "pattern", "value", "kind_of")
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return found


def _child(path: Column, name: Column) -> Column:
    return F.when(path == "", name).otherwise(F.concat(path, F.lit("."), name))


def spec_table(spark: SparkSession, fields: dict[str, Field]) -> DataFrame:
    """The schema as a table; its length is that of the schema."""
    return spark.createDataFrame(_flat(fields), _SPEC)


_FRAMES = Field("array", items=Field("int"))
_SHARE = Field("number", True, 0.0, 1.0)
_TEXT, _MAYBE, _NAMED = Field("string"), Field("string", nullable=True), Field("string", True, length=1)
_IDS = Field("array", items=Field("string"))
#: What is known of views, visibility, continuity, entities, phases, normalisation and uncertainty.
_VIEWS = ("wide", "medium", "closeup", "detail", "unknown")
_QUALITY = ("clear", "partial", "poor", "unknown")
_CONTINUITY = ("continuous", "reframed", "camera_change", "unknown")
_ENTITY_TYPES = ("person", "device", "component", "tool", "ppe", "sign", "document", "environment", "unknown")
_PHASES = ("starting", "ongoing", "possibly_completed", "instant", "unknown")
_NORMALIZED = ("canonical", "alias_mapped", "out_of_vocabulary", "unknown")
_ATTRIBUTE_NORMALIZED = ("canonical", "alias_mapped", "out_of_vocabulary", "invalid_for_entity_type")
_UNCERTAIN = ("identity", "action", "attribute", "visibility", "causality", "other")
_one_of = lambda values, **more: Field("string", values=values, **more)
_WINDOW = {"global_index": Field("int", True, 0.0), "start_seconds": Field("number", True, 0.0), "commit_start_seconds": Field("number", nullable=True), "end_seconds": Field("number", True, above=0.0)}
_SCENE = {
    "camera_change": Field("bool"), "view_type": _one_of(_VIEWS), "scene_visibility": _one_of(_QUALITY), "target_visibility": _one_of(_QUALITY), "continuity_hint": _one_of(_CONTINUITY), "description": _TEXT,
    "visibility": _one_of(_QUALITY, nullable=True),
}
_ENTITY = {
    "local_id": _NAMED, "entity_type": _one_of(_ENTITY_TYPES, required=True), "name": _TEXT, "description": _TEXT, "appearance": Field("object", open=True), "spatial_region": _TEXT, "candidate_global_id": _MAYBE,
    "confidence": _SHARE, "evidence_frames": _FRAMES,
}
_ACTION = {
    "local_id": _NAMED, "actor_local_id": _MAYBE, "action_type": _NAMED, "raw_action_type": _MAYBE, "action_family": _MAYBE, "normalization_status": _one_of(_NORMALIZED), "target_local_id": _MAYBE, "tool_local_id": _MAYBE,
    "phase_observation": _one_of(_PHASES), "description": _TEXT, "confidence": _SHARE, "evidence_frames": _FRAMES,
}
_ATTRIBUTE = {
    "entity_local_id": _NAMED, "attribute_key": _MAYBE, "value": _NAMED, "raw_attribute": _MAYBE, "raw_value": _MAYBE, "normalization_status": _one_of(_ATTRIBUTE_NORMALIZED), "confidence": _SHARE, "evidence_frames": _FRAMES,
    "attribute": _MAYBE,
}
_RELATION = {"subject_local_id": _NAMED, "relation_type": _NAMED, "object_local_id": _NAMED, "confidence": _SHARE, "evidence_frames": _FRAMES}
_UNCERTAINTY = {"uncertainty_type": _one_of(_UNCERTAIN), "description": _NAMED, "related_local_ids": _IDS, "evidence_frames": _FRAMES}
_INTERPRETATION = {"description": _NAMED, "confidence": _SHARE, "supporting_local_ids": _IDS}
_each = lambda fields: Field("array", items=Field("object", fields=fields))
#: The fields of an observation.
OBSERVATION = {
    "schema_version": _one_of(("1.0", "2.0")), "window": Field("object", True, fields=_WINDOW), "summary": _TEXT, "scene": Field("object", fields=_SCENE), "entities": _each(_ENTITY), "actions": _each(_ACTION),
    "attribute_observations": _each(_ATTRIBUTE), "relations": _each(_RELATION), "uncertainties": _each(_UNCERTAINTY), "visual_fact": _MAYBE, "task_conditioned_interpretation": Field("object", fields=_INTERPRETATION, nullable=True),
}


def _number(v: Column, path: str) -> Column:
    return F.trim(F.try_variant_get(v, path, "string")).try_cast("double")


def _window_rule(v: Column) -> Column:
    start, commit, end = (_number(v, f"$.{x}_seconds") for x in ("start", "commit_start", "end"))
    return F.when(end <= start, "ends before its start").when((commit < start) | (commit >= end), "commit start outside")


def _attribute_rule(v: Column) -> Column:
    told = F.coalesce(F.try_variant_get(v, "$.attribute_key", "string"), F.try_variant_get(v, "$.attribute", "string"))
    return F.when(F.coalesce(told, F.lit("")) == "", "attribute_key needed")


def _version_rule(v: Column) -> Column:
    version = F.coalesce(F.try_variant_get(v, "$.schema_version", "string"), F.lit("2.0"))
    kind = F.regexp_extract(F.schema_of_variant(F.try_variant_get(v, "$.window", "variant")), "^[A-Z]+", 0)
    return F.when((version == "2.0") & (kind == "OBJECT") & F.try_variant_get(v, "$.window.commit_start_seconds", "string").isNull(), "2.0 needs window.commit_start_seconds")


#: By pattern: an interval's order, an attribute's name, and that version 2.0 (also where none is stated) states its commit start.
RULES = {"": _version_rule, "window": _window_rule, "attribute_observations[]": _attribute_rule}


def observation_violations(docs: DataFrame, key: list[str], v: str) -> DataFrame:
    """Violations of OBSERVATION and RULES."""
    return violations(docs, key, v, OBSERVATION, RULES)
