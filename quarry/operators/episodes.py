"""Messages of episodes as rows: ordinals, observations, decision labels, rendering, removable history.

Messages are rows (episode, position, role, content, ...).  Windows are by episode; an episode's messages fit one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Labels and the substrings that earn them.
LABELS = {
    "information_gathering": ("grep", "find", "search", "open", "read", "cat"),
    "editing": ("edit", "write", "patch", "sed", "create"),
    "verification": ("test", "pytest", "verify", "lint"),
    "termination": ("finish", "submit"),
}
DEFAULT_LABEL = "mechanical_action"
# Fixed value: the sentence behind a rendered tool schema.
TOOL_HELP = "Use <tool_call>{...}</tool_call> for actions. Tool results use <tool_response>{...}</tool_response>."


def decision_types(payload: Column, ends: Column | None = None) -> Column:
    """Labels of an action's canonical JSON, by substrings; ``ends`` marks actions known to end the episode."""
    low = F.lower(payload)
    hits = []
    for label, parts in LABELS.items():
        met = low.rlike("|".join(parts))
        hits.append(F.when(met | ends if ends is not None and label == "termination" else met, F.lit(label)))
    found = F.array_compact(F.array(*hits))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(DEFAULT_LABEL)))


def action_payload(action: Column) -> tuple[Column, Column]:
    """(text to label, whether it says the task is complete) of an action in canonical JSON, null for none."""
    v = F.try_parse_json(action)
    form = F.try_variant_get(v, "$.format", "string")
    commands = F.coalesce(F.to_json(F.try_variant_get(v, "$.payload.commands", "variant")), F.lit("[]"))
    complete = F.coalesce(F.try_variant_get(v, "$.payload.task_complete", "boolean"), F.lit(False))
    payload = F.when(form == "terminus_json", commands).when(form == "assistant_final", F.try_variant_get(v, "$.content", "string"))
    return F.coalesce(payload, action, F.lit("null")), F.when(form == "terminus_json", complete).otherwise(F.coalesce(form == "assistant_final", F.lit(False)))


def _json_of(observations: Column) -> Column:
    """Nothing, the one content, or a JSON array of (content, role, tool_call_id)."""
    several = F.to_json(observations, {"ignoreNullFields": "false"})
    return F.when(F.size(observations) == 0, "").when(F.size(observations) == 1, observations[0]["content"]).otherwise(several)


def with_observations(messages: DataFrame, episode: str = "conv_id", position: str = "turn", content: str = "text", call: Column | None = None) -> DataFrame:
    """Assistant rows with ``previous``, what users and tools said since the assistant before, and ``next``, until the one after."""
    one = Window.partitionBy(episode).orderBy(position)
    segment = F.coalesce(F.sum((F.col("role") == "assistant").cast("int")).over(one.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heard = F.col("role").isin("user", "tool") & (F.length(content) > 0)
    call = F.lit(None).cast("string") if call is None else call
    item = F.struct(F.col(position).alias("at"), F.col(content).alias("content"), "role", call.alias("tool_call_id"))
    rows = messages.withColumn("segment", segment)
    block = Window.partitionBy(episode, "segment")
    told = F.collect_list(F.when(heard, item)).over(block)
    rows = rows.withColumn("told", F.transform(F.sort_array(told), lambda x: F.struct(x["content"].alias("content"), x["role"].alias("role"), x["tool_call_id"].alias("tool_call_id"))))
    # the block behind an assistant is the next segment's
    after = F.first("told").over(Window.partitionBy(episode).orderBy("segment").rangeBetween(1, 1))
    rows = rows.withColumn("after", after).where("role = 'assistant'")
    return rows.withColumn("previous", _json_of(F.col("told"))).withColumn("next", _json_of(F.coalesce("after", F.array().cast("array<struct<content:string,role:string,tool_call_id:string>>")))).drop("told", "after", "segment")


def turn_numbers(messages: DataFrame, kept: Column, episode: str = "conv_id", position: str = "turn") -> DataFrame:
    """Rows that satisfy ``kept`` with their ordinal ``turn_id`` from 0 within the episode."""
    return messages.where(kept).withColumn("turn_id", F.row_number().over(Window.partitionBy(episode).orderBy(position)) - 1)


def first_task_text(messages: DataFrame, episode: str = "conv_id", position: str = "turn", content: str = "text") -> DataFrame:
    """Per episode the first user message with content, else the first with content, else ''."""
    some = F.length(content) > 0
    user = F.min_by(content, F.when(some & (F.col("role") == "user"), F.col(position)))
    return messages.groupBy(episode).agg(F.coalesce(user, F.min_by(content, F.when(some, F.col(position))), F.lit("")).alias("task_text"))


def rendered(role: Column, content: Column, reasoning: Column | None = None, action: Column | None = None, call: Column | None = None) -> Column:
    """One message as training text; null for a role it has no form for."""
    none = F.lit(None).cast("string")
    reasoning, action, call = (none if x is None else x for x in (reasoning, action, call))
    think = F.when(F.length(reasoning) > 0, F.concat(F.lit("<think>\n"), reasoning, F.lit("\n</think>")))
    act = F.when(action.isNotNull(), F.concat(F.lit("<tool_call>"), action, F.lit("</tool_call>")))
    said = F.concat_ws("\n", think, F.when(F.length(content) > 0, content), act)
    response = F.to_json(F.struct(content.alias("content"), call.alias("tool_call_id")), {"ignoreNullFields": "false"})
    return (
        F.when(role.isin("system", "developer"), F.concat(F.lit("System: "), content, F.lit("\n\n")))
        .when(role == "user", F.concat(F.lit("User: "), content, F.lit("\n\n")))
        .when(role == "tool", F.concat(F.lit("User: <tool_response>"), response, F.lit("</tool_response>\n\n")))
        .when(role == "assistant", F.concat(F.lit("Assistant: "), said, F.lit("\n\n")))
    )


def rendered_episodes(messages: DataFrame, episode: str = "conv_id", position: str = "turn", content: str = "text") -> DataFrame:
    text = rendered(F.col("role"), F.col(content))
    parts = F.sort_array(F.collect_list(F.struct(position, text.alias("x"))))
    return messages.groupBy(episode).agg(F.array_join(F.transform(parts, lambda p: p["x"]), "").alias("rendered"))


def history_groups(prefix: DataFrame, keys: list[str], position: str = "turn") -> DataFrame:
    """(keys, grp, protected, n_messages, first, last): message groups of the prefixes (keys, position, role).

    A group opens at the first message and at every assistant message.  System and developer messages, the first and last user
    message and everything from the last assistant message of the prefix on are protected, and so is a group that holds one of them."""
    assistant = (F.col("role") == "assistant").cast("int")
    every, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(position)
    prefix = prefix.withColumn("grp", F.sum(F.when(F.row_number().over(order) == 1, 1).otherwise(assistant)).over(order))
    at_user, at_assistant = F.when(F.col("role") == "user", F.col(position)), F.when(assistant == 1, F.col(position))
    edges = F.col("role").isin("system", "developer") | (F.col(position) == F.min(at_user).over(every)) | (F.col(position) == F.max(at_user).over(every))
    latest = F.coalesce(F.max(at_assistant).over(every), F.min(position).over(every))
    prefix = prefix.withColumn("protected", F.coalesce(edges, F.lit(False)) | (F.col(position) >= latest))
    return prefix.groupBy(*keys, "grp").agg(F.bool_or("protected").alias("protected"), F.count("*").alias("n_messages"), F.min(position).alias("first"), F.max(position).alias("last"))


def removable_groups(messages: DataFrame, episode: str = "conv_id", position: str = "turn") -> DataFrame:
    """Message groups before each episode's last assistant message that a window may drop, with their sizes."""
    target = F.max(F.when(F.col("role") == "assistant", F.col(position))).over(Window.partitionBy(episode))
    prefix = messages.withColumn("target", target).where(F.col(position) < F.col("target"))
    return history_groups(prefix, [episode, "target"], position).where("not protected").drop("protected", "first", "last")


def content_digests(messages: DataFrame, episode: str = "conv_id", position: str = "turn", content: str = "text") -> DataFrame:
    """sha256 of the JSON array of each episode's (action, content, reasoning, role)."""
    none = F.lit(None).cast("string")
    item = F.struct(none.alias("action"), F.col(content).alias("content"), F.lit("").alias("reasoning"), F.col("role").alias("role"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct(position, item.alias("m")))), lambda p: p["m"])
    return messages.groupBy(episode).agg(F.sha2(F.to_json(parts, {"ignoreNullFields": "false"}), 256).alias("digest"))
