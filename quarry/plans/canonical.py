"""Normalized episodes to the canonical tables: episodes, decisions, and content-addressed traces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import identity as I
from ..operators import episodes as E
from ..sources import blobs


def with_ids(episodes: DataFrame) -> DataFrame:
    """Episodes with episode_id, split_group, their trace's payload, digest and ref, and the JSON of their tools."""
    df = episodes.withColumn("episode_id", I.stable_id("source_dataset", "source_record_id"))
    df = df.withColumn("split_group", I.group_identity(I.folded("repo"), I.folded("task_id")))
    normalized = F.struct(F.col("messages"), F.col("metadata"))
    trace = F.struct(F.lit(1).alias("blob_schema_version"), "source_record_id", "source_dataset", "source_revision", "raw_record", normalized.alias("normalized"))
    df = df.withColumn("trace", F.to_json(trace, {"ignoreNullFields": "false"}))
    return blobs.addressed(df, "trace").drop("trace").withColumn("tools_schema", F.coalesce("tools", F.lit("null")))


def episode_table(df: DataFrame) -> DataFrame:
    turns = F.size(F.filter("messages", lambda m: m["role"] == "assistant"))
    return schemas.conform(df.withColumn("turn_count", turns).withColumn("raw_trace_ref", F.col("ref")), schemas.EPISODES)


def decision_table(df: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """One row per assistant message with an action or visible content, in order; reasoning alone is no decision.  With
    ``chosen`` (episode_id, message_index) only those, under the ordinals they have among all."""
    rows = df.select("episode_id", "tools_schema", "ref", F.posexplode("messages").alias("pos", "m")).select("*", "m.*").drop("m")
    rows = E.with_observations(rows, "episode_id", "pos", "content", F.col("tool_call_id"))
    rows = E.turn_numbers(rows, F.col("action").isNotNull() | (F.length("content") > 0), "episode_id", "pos")
    if chosen is not None:
        rows = rows.join(chosen.select("episode_id", F.col("message_index").alias("pos")), ["episode_id", "pos"], "left_semi")
    payload, ends = E.action_payload(F.col("action"))
    final = F.to_json(F.struct(F.col("content"), F.lit("assistant_final").alias("format")))
    rows = rows.select(
        "episode_id", "turn_id", I.stable_id(F.lit("decision"), "episode_id", "turn_id").alias("decision_id"), F.concat("ref", F.lit("#normalized.messages=0:"), "pos").alias("prefix_messages_ref"),
        F.col("previous").alias("current_observation"), "tools_schema", F.col("reasoning").alias("teacher_think_raw"), F.coalesce("action", final).alias("teacher_action"),
        F.col("next").alias("next_tool_result"), E.decision_types(payload, ends).alias("decision_type"),
    )
    return schemas.conform(rows, schemas.DECISIONS)


def resolve_prefix(decisions: DataFrame, traces: DataFrame) -> DataFrame:
    """Decisions with the messages before them (JSON), from their reference into traces (digest, record)."""
    ref = r"^sha256:([0-9a-f]{64})#normalized\.messages=0:(\d+)$"
    rows = decisions.withColumn("digest", F.regexp_extract("prefix_messages_ref", ref, 1)).withColumn("upto", F.regexp_extract("prefix_messages_ref", ref, 2).cast("int"))
    messages = F.from_json(F.get_json_object("record", "$.normalized.messages"), f"array<{schemas.MESSAGE}>")
    return rows.join(traces, "digest").withColumn("prefix", F.slice(messages, 1, F.col("upto"))).drop("record", "digest", "upto")


def restore(episodes: DataFrame, traces: str) -> DataFrame:
    """Episodes of the episode table with the ``messages`` and ``metadata`` of their traces (a folder of records), and
    ``restored``: the record is intact, has a known version, and names the same episode."""
    rows = blobs.get(episodes, traces, "raw_trace_ref")
    v = F.try_parse_json("record")
    same = lambda c: F.try_variant_get(v, f"$.{c}", "string").eqNullSafe(F.col(c))
    known = F.coalesce(F.try_variant_get(v, "$.blob_schema_version", "int") == 1, F.lit(False))
    named = F.coalesce(F.col("episode_id") == I.stable_id("source_dataset", "source_record_id"), F.lit(False))
    good = F.col("intact") & known & named & same("source_dataset") & same("source_record_id") & same("source_revision")
    messages = F.from_json(F.get_json_object("record", "$.normalized.messages"), f"array<{schemas.MESSAGE}>")
    return rows.withColumn("messages", F.when(good, messages)).withColumn("metadata", F.when(good, F.get_json_object("record", "$.normalized.metadata"))).withColumn("restored", good).drop("record", "intact", "digest")
