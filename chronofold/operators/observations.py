"""Parsing, validation and vocabulary normalization of observation rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What encloses a block of code in an answer.
_MARK = "```"


def json_text(raw: Column) -> Column:
    """The JSON object in a model's answer: of what the first two marks enclose if there are two, else of all, the part from the first `{` to the last `}`; null without one."""
    parts = F.split(raw, _MARK, 3)
    body = F.when(F.size(parts) == 3, F.element_at(parts, 2)).otherwise(raw)
    start, back = F.locate("{", body), F.locate("}", F.reverse(body))
    end = F.length(body) - back + 1
    return F.when((start > 0) & (back > 0) & (end > start), F.substring(body, start, end - start + 1))


def parse_status(raw: Column) -> Column:
    """`ok`, `no_json` or `malformed`."""
    return text_status(json_text(raw))


def text_status(text: Column) -> Column:
    """parse_status() of an answer of which json_text() made text."""
    return F.when(text.isNull(), "no_json").when(F.try_parse_json(text).isNull(), "malformed").otherwise("ok")


def migrate_scene(view: Column, visibility: Column, scene_visibility: Column, target_visibility: Column) -> Column:
    """Scene of a version 1 row: the one visibility fills both new fields where they are unknown."""

    def filled(x: Column) -> Column:
        known = F.coalesce(x, F.lit("unknown"))
        return F.when((known == "unknown") & visibility.isNotNull(), visibility).otherwise(known)

    return F.struct(F.coalesce(view, F.lit("unknown")).alias("view_type"), filled(scene_visibility).alias("scene_visibility"), filled(target_visibility).alias("target_visibility"), F.lit("unknown").alias("continuity_hint"))


def duplicate_ids(items: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return items.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def repeats(items: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Every row after the first of its keys: a warning each."""
    return items.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("r > 1").drop("r")


def dangling(items: DataFrame, ref: str, entities: DataFrame, window: list[str], id_col: str) -> DataFrame:
    """Rows whose reference isn't an entity of their window; null references are fine."""
    known = entities.select(*window, F.col(id_col).alias(ref)).distinct()
    return items.where(F.col(ref).isNotNull()).join(known, [*window, ref], "left_anti")


def bad_evidence(evidence: Column, frames: Column) -> Column:
    """True if an index lies outside 0 .. frames - 1."""
    return F.coalesce(F.exists(evidence, lambda i: (i < 0) | (i >= frames)), F.lit(False))


def normalize_actions(rows: DataFrame, actions: DataFrame, aliases: DataFrame, raw: str = "raw_action") -> DataFrame:
    """rows with action_type, action_family and normalization_status.

    An action stays, an alias becomes its action, anything else becomes `other`
    and is out of vocabulary; null counts as `unknown`.  Idempotent, as the raw
    value decides.  The vocabularies have a fixed size and are broadcast.
    """
    r = F.coalesce(F.col(raw), F.lit("unknown"))
    out = rows.withColumn("_r", r).join(F.broadcast(actions.select(F.col("action").alias("_r"), F.col("action").alias("_known"))), "_r", "left")
    out = out.join(F.broadcast(aliases.select(F.col("alias").alias("_r"), F.col("canonical").alias("_alias"))), "_r", "left")
    status = F.when(F.col("_known").isNotNull(), "canonical").when(F.col("_alias").isNotNull(), "alias_mapped").otherwise("out_of_vocabulary")
    out = out.withColumn("action_type", F.coalesce("_known", "_alias", F.lit("other"))).withColumn("normalization_status", status)
    out = out.join(F.broadcast(actions.select(F.col("action").alias("action_type"), F.col("family").alias("action_family"))), "action_type", "left")
    return out.drop("_r", "_known", "_alias")


def normalize_attributes(rows: DataFrame, attributes: DataFrame, aliases: DataFrame, key: str = "raw_attribute", value: str = "value", entity_type: str = "entity_type") -> DataFrame:
    """rows with attribute_key and normalization_status; checks go by key, then entity type, then value, which is never changed."""
    out = rows.join(F.broadcast(aliases.select(F.col("alias").alias(key), F.col("canonical").alias("_alias"))), key, "left")
    out = out.withColumn("attribute_key", F.coalesce("_alias", key))
    out = out.join(F.broadcast(attributes), "attribute_key", "left")
    status = (
        F.when(F.col("entity_types").isNull(), "out_of_vocabulary")
        .when(~F.array_contains("entity_types", F.coalesce(F.col(entity_type), F.lit(""))), "invalid_for_entity_type")
        .when(~F.array_contains("allowed_values", F.coalesce(F.col(value), F.lit(""))), "out_of_vocabulary")
        .when(F.col("_alias").isNotNull(), "alias_mapped")
        .otherwise("canonical")
    )
    return out.withColumn("normalization_status", status).drop("_alias", "entity_types", "allowed_values", "policy")


def sanitize_hints(rows: DataFrame, candidates: DataFrame, window: list[str], hint: str = "hint", entity_type: str = "entity_type", enabled: bool = True) -> DataFrame:
    """Hints that are candidates of their window with the same type; others become null, with the reason in hint_warning."""
    known = candidates.select(*window, F.col("entity_id").alias(hint), F.col("entity_type").alias("_type")).dropDuplicates([*window, hint])
    out = rows.join(known, [*window, hint], "left")
    why = F.when(F.col(hint).isNull(), F.lit(None)).when(F.lit(not enabled), "hints_disabled").when(F.col("_type").isNull(), "not_in_context").when(F.col("_type") != F.col(entity_type), "type_mismatch")
    return out.withColumn("hint_warning", why).withColumn("clean_hint", F.when(F.col("hint_warning").isNull(), F.col(hint))).drop("_type")
