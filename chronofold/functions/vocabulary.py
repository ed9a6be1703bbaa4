"""Vocabularies of actions and attributes, as small DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def actions(spark: SparkSession, family_of: dict[str, str], aliases: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(action, family) and (alias, action).  An alias that is an action itself, or stands for none, is an error."""
    for alias, action in aliases.items():
        if action not in family_of:
            raise ValueError(f"alias {alias} stands for the unknown action {action}")
        if alias in family_of:
            raise ValueError(f"alias {alias} is an action")
    return (
        spark.createDataFrame(sorted(family_of.items()), "action string, family string"),
        spark.createDataFrame(sorted(aliases.items()), "alias string, canonical string"),
    )


def attributes(spark: SparkSession, specs: dict[str, dict]) -> tuple[DataFrame, DataFrame]:
    """(attribute_key, entity_types, allowed_values, policy) and (alias, attribute_key)."""
    rows = [(k, list(s["entity_types"]), list(s["values"]), s.get("policy", "default")) for k, s in sorted(specs.items())]
    alias = [(a, k) for k, s in sorted(specs.items()) for a in s.get("aliases", ())]
    return (
        spark.createDataFrame(rows, "attribute_key string, entity_types array<string>, allowed_values array<string>, policy string"),
        spark.createDataFrame(alias, "alias string, canonical string"),
    )
