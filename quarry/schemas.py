"""Schemas of the canonical tables (version 1.1.0) and of token records; equality ignores nullability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.types import StructType

_SIMPLE = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "smallint": T.ShortType(), "float": T.FloatType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def columns(text: str) -> StructType:
    """The type of ``name type, ...`` with simple types and arrays of them; needs no session."""
    fields = []
    for column in text.split(", "):
        name, kind = column.split(" ")
        inner = kind.removeprefix("array<").removesuffix(">")
        fields.append(T.StructField(name, T.ArrayType(_SIMPLE[inner]) if kind.startswith("array<") else _SIMPLE[kind]))
    return StructType(fields)


VERSION = "1.1.0"
# Column names, order and types of the published tables.
EPISODES = columns(
    "episode_id string, task_id string, source_record_id string, split_group string, source_dataset string, source_revision string, "
    "source_license string, harness string, tools_schema string, task_text string, acceptance_criteria string, repo string, "
    "base_commit string, env_image_digest string, verifier_id string, verifier_version string, teacher_model string, "
    "teacher_prompt_version string, success boolean, terminal_reward float, turn_count int, failure_type string, raw_trace_ref string"
)
DECISIONS = columns(
    "episode_id string, turn_id int, decision_id string, prefix_messages_ref string, current_observation string, tools_schema string, "
    "teacher_think_raw string, teacher_think_tokens int, macro_thoughts string, teacher_action string, next_tool_result string, "
    "env_delta string, verifier_delta float, progress_label float, regression_label boolean, recovery_label boolean, decision_type array<string>"
)
SNAPSHOTS = columns(
    "snapshot_id string, episode_id string, turn_id int, env_snapshot_ref string, prefix_messages_ref string, task_contract string, "
    "current_observation string, milestones string, ledger string, known_constraints string"
)
FORKS = columns(
    "snapshot_id string, policy_checkpoint string, candidate_id string, recurrent_depth smallint, latent_mode string, sampling_seed bigint, "
    "action string, parse_valid boolean, exec_valid boolean, new_information boolean, immediate_progress float, regression boolean, "
    "h4_progress float, h16_progress float, terminal_success boolean, model_latency_ms float, model_flops_estimate double, tool_latency_ms float"
)
TOKENS = columns(
    "episode_id string, decision_id string, sample_id string, split string, group_sha256 string, teacher string, source_success boolean, "
    "message_index int, token_ids array<int>, token_loss_weights array<float>, token_regions array<string>, mixed_boundary_count int, "
    "dropped_messages int, record_sha256 string"
)
MESSAGE = "struct<role:string,content:string,reasoning:string,action:string,tool_call_id:string,loss_mask:boolean,metadata:string>"
MESSAGES = T.ArrayType(columns("role string, content string, reasoning string, action string, tool_call_id string, loss_mask boolean, metadata string"))
EPISODE = columns(
    "source_dataset string, source_revision string, source_license string, source_record_id string, task_id string, task_text string, "
    "harness string, tools string, repo string, base_commit string, teacher_model string, success boolean, "
    "terminal_reward double, failure_type string, metadata string, raw_record string"
).add("messages", MESSAGES)


def shape(schema: StructType) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in schema.fields]


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Columns of the schema in its order; those that are missing are null."""
    from pyspark.sql import functions as F

    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def check(df: DataFrame, schema: StructType) -> None:
    if shape(df.schema) != shape(schema):
        raise ValueError(f"schema differs: {shape(df.schema)}")
