"""Queries of the five adapters, of releases and of the inputs of fine-tuning: raw rows of each source made from ``conversations``, their texts as they are.

Every other assistant's turn that an answer follows is a call of a tool, in the form of the source."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import schemas
from .catalog import over_conversations, query
from .operators.episodes import TOOL_HELP
from .plans import release, sft
from .scratch import shared_dir, written
from .sources import traces

#: The turns as SQL that both engines read; ``acts``: a call, ``answers``: the turn of the call that a turn answers.
_TALK = """t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text, lead(role) OVER w AS next_role, lag(role) OVER w AS last_role, lag(turn) OVER w AS last_turn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
talk AS (
  SELECT conv_id, turn, role, text, role = 'assistant' AND coalesce(next_role, '') = 'user' AND (conv_id + turn) % 2 = 0 AS acts,
    CASE WHEN role = 'user' AND last_role = 'assistant' AND (conv_id + last_turn) % 2 = 0 THEN last_turn END AS answers, role = 'assistant' AND (conv_id + turn) % 5 = 1 AS thinks FROM t)"""


def _talk(spark, sf_dir) -> DataFrame:
    return over_conversations(spark, sf_dir, f"WITH {_TALK} SELECT * FROM talk")


def _rows(talk: DataFrame, message: Column, name: str) -> DataFrame:
    """One raw row per conversation, with its messages as an array."""
    item = F.struct("turn", message.alias("m"))
    return talk.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["m"]).alias(name)).withColumns({"source_file": F.concat(F.lit("data/codex/"), F.expr("if(conv_id % 2 = 0, 'minimax_m25', 'other')"), F.lit("/x.parquet")), "row_index": F.col("conv_id")})


def _told(episodes: DataFrame, conv_id: Column) -> DataFrame:
    """What an adapter made of each conversation; its messages by a digest of all their members."""
    line = F.transform("messages", lambda m: F.concat_ws("\x1f", m["role"], m["content"], m["reasoning"], F.coalesce(m["action"], F.lit("-")), F.coalesce(m["tool_call_id"], F.lit("-")), F.coalesce(m["loss_mask"].cast("string"), F.lit("-"))))
    return episodes.select(
        conv_id.cast("long").alias("conv_id"), "task_id", F.coalesce("repo", F.lit("-")).alias("repo"), "teacher_model", "harness", "success", "failure_type", F.md5("task_text").alias("task"), F.md5(F.array_join(line, "\x1e")).alias("messages"),
    )


def _sql(content: str, reasoning: str, action: str, call: str, mask: str, columns: str, role: str = "role") -> str:
    return f"""WITH {_TALK}, plain AS (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS trimmed FROM talk),
read AS (SELECT conv_id, turn, {role} AS role, {content} AS content, {reasoning} AS reasoning, {action} AS action, {call} AS call, {mask} AS mask FROM plain),
joined AS (SELECT conv_id, string_agg(concat(role, chr(31), content, chr(31), reasoning, chr(31), coalesce(action, '-'), chr(31), coalesce(call, '-'), chr(31), coalesce(mask, '-')), chr(30) ORDER BY turn) AS lines,
  coalesce(arg_min(content, turn) FILTER (WHERE role = 'user' AND regexp_replace(content, '\\s+', '', 'g') <> ''), '') AS task FROM read GROUP BY conv_id)
SELECT conv_id, {columns}, md5(task) AS task, md5(lines) AS messages FROM joined"""


# --- messages with tool calls
_CHAT = _sql(
    "CASE WHEN acts AND trimmed <> '' THEN '' WHEN thinks AND NOT acts THEN trimmed ELSE text END",
    "concat(CASE WHEN thinks THEN concat('turn ', turn) ELSE '' END, CASE WHEN thinks AND acts AND trimmed <> '' THEN concat(chr(10), chr(10)) ELSE '' END, CASE WHEN acts THEN trimmed ELSE '' END)",
    """CASE WHEN acts THEN concat('[{"function":{"arguments":{"n":', turn, ',"path":"f', turn, '"},"name":"read"},"id":"k', turn, '","type":"function"}]') END""",
    "CASE WHEN answers IS NOT NULL THEN concat('k', answers) END", "NULL::VARCHAR", "{columns}", "CASE WHEN answers IS NOT NULL THEN 'tool' ELSE role END",
)


def _chat_rows(spark, sf_dir, name: str) -> DataFrame:
    arguments = F.to_json(F.struct(F.concat(F.lit("f"), "turn").alias("path"), F.col("turn").alias("n")))
    call = F.struct(F.concat(F.lit("k"), "turn").alias("id"), F.lit("function").alias("type"), F.struct(F.lit("read").alias("name"), arguments.alias("arguments")).alias("function"))
    said = F.when(F.col("thinks"), F.concat(F.lit("<think>turn "), "turn", F.lit("</think>"), "text")).otherwise(F.col("text"))
    message = F.struct(
        F.when(F.col("answers").isNotNull(), F.lit("tool")).otherwise(F.col("role")).alias("role"), said.alias("content"), F.when(F.col("acts"), F.array(call)).alias("tool_calls"),
        F.when(F.col("answers").isNotNull(), F.concat(F.lit("k"), "answers")).alias("tool_call_id"),
    )
    return _rows(_talk(spark, sf_dir), message, "talk").withColumn(name, F.to_json("talk")).drop("talk")


@query(_CHAT.replace("{columns}", """concat('org__r', conv_id % 7, '-', conv_id) AS task_id, concat('org/r', conv_id % 7) AS repo, CASE WHEN conv_id % 2 = 0 THEN 'MiniMax-M2.5' ELSE 'other' END AS teacher_model, 'codex' AS harness,
  CASE conv_id % 3 WHEN 0 THEN NULL ELSE conv_id % 3 = 1 END AS success, CASE WHEN conv_id % 3 = 2 THEN 'unresolved' END AS failure_type"""))
def adapt_open_swe(spark, sf_dir):
    tool = F.lit('{"type": "function", "function": {"name": "read", "parameters": {"type": "object"}}}')
    rows = _chat_rows(spark, sf_dir, "messages").withColumns({
        "trajectory_id": F.col("conv_id").cast("string"), "instance_id": F.expr("concat('org__r', conv_id % 7, '-', conv_id)"), "repo": F.expr("concat('org/r', conv_id % 7)"),
        "resolved": F.expr("case conv_id % 3 when 0 then -1 when 1 then 1 else 0 end"), "license": F.lit("MIT"), "tools": F.array(tool),
    })
    return _told(traces.open_swe_traces(rows), F.col("source_record_id"))


@query(_CHAT.replace("{columns}", """concat('org__r', conv_id % 7, '-', conv_id) AS task_id, concat('org/r', conv_id % 7) AS repo, 'Qwen3-Coder-480B-A35B-Instruct' AS teacher_model, 'openhands' AS harness,
  CASE conv_id % 3 WHEN 0 THEN NULL ELSE conv_id % 3 = 1 END AS success, CASE WHEN conv_id % 3 = 2 THEN 'gave up' END AS failure_type"""))
def adapt_openhands(spark, sf_dir):
    rows = _chat_rows(spark, sf_dir, "trajectory").withColumns({
        "trajectory_id": F.col("conv_id").cast("string"), "instance_id": F.expr("concat('org__r', conv_id % 7, '-', conv_id)"), "repo": F.expr("concat('org/r', conv_id % 7)"),
        "resolved": F.expr("case conv_id % 3 when 0 then -1 when 1 then 1 else 0 end"), "exit_status": F.lit("gave up"),
    })
    return _told(traces.nebius_openhands(rows), F.col("source_record_id"))


@query(_CHAT.replace("{columns}", """concat('org__r', conv_id % 7, '-', conv_id) AS task_id, concat('org/r', conv_id % 7) AS repo, concat('M', conv_id % 2) AS teacher_model, CASE WHEN conv_id % 2 = 0 THEN 'openhands' ELSE 'mini-swe-agent' END AS harness,
  CASE conv_id % 3 WHEN 0 THEN NULL ELSE conv_id % 3 = 1 END AS success, CASE WHEN conv_id % 3 = 2 THEN 'unresolved' END AS failure_type"""))
def adapt_orchard(spark, sf_dir):
    meta = F.struct(
        F.expr("concat('org__r', conv_id % 7, '-', conv_id)").alias("instance_id"), F.expr("concat('org/r', conv_id % 7)").alias("repo"), F.expr("concat('M', conv_id % 2)").alias("model"),
        F.expr("if(conv_id % 2 = 0, 'oh-a', 'mini')").alias("source"), F.lit("4").alias("sample_idx"), F.expr("case conv_id % 3 when 0 then 'odd' when 1 then ' Passed ' else 'failed' end").alias("verify_status"),
    )
    rows = _chat_rows(spark, sf_dir, "messages").withColumns({"metadata": F.to_json(meta), "tools": F.lit("[]")})
    return _told(traces.orchard_swe(rows), F.regexp_extract("task_id", r"-(\d+)$", 1))


# --- terminal commands and fenced commands
@query(_sql(
    "CASE WHEN acts THEN '' WHEN role = 'assistant' THEN trimmed ELSE text END", "CASE WHEN thinks THEN concat('turn ', turn) ELSE '' END",
    """CASE WHEN acts THEN concat('{"format":"terminus_json","payload":{"commands":[{"keystrokes":"make ', turn, '"}],"task_complete":', CASE WHEN turn % 4 = 1 THEN 'true' ELSE 'false' END, '}}') END""", "NULL::VARCHAR", "NULL::VARCHAR",
    """concat('build-', conv_id) AS task_id, '-' AS repo, 'GLM-4.7-AWQ' AS teacher_model, 'terminus-2' AS harness, CASE conv_id % 3 WHEN 0 THEN NULL ELSE conv_id % 3 = 1 END AS success, CASE WHEN conv_id % 3 = 2 THEN 'failed' END AS failure_type""",
))
def adapt_openthoughts(spark, sf_dir):
    payload = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("make "), "turn").alias("keystrokes"))).alias("commands"), (F.col("turn") % 4 == 1).alias("task_complete")))
    said = F.when(F.col("acts"), F.concat("text", F.lit("\nNow: "), payload, F.lit(" ."))).otherwise(F.col("text"))
    said = F.when(F.col("thinks"), F.concat(F.lit("<think> turn "), "turn", F.lit(" </think>\n"), said)).otherwise(said)
    rows = _rows(_talk(spark, sf_dir), F.struct("role", said.alias("content")), "conversations")
    rows = rows.withColumns({
        "run_id": F.lit("night"), "trial_name": F.lit("first"), "episode": F.col("conv_id").cast("string"), "task": F.concat(F.lit("build-"), "conv_id"), "agent": F.lit("terminus-2"), "model": F.lit("m"),
        "result": F.expr("case conv_id % 3 when 0 then 'timed out' when 1 then 'passed' else 'failed' end"), "date": F.lit("d"), "model_provider": F.lit("p"), "trace_source": F.lit("s"),
    })
    return _told(traces.openthoughts_agent(rows), F.regexp_extract("task_id", r"-(\d+)$", 1))


@query(_sql(
    "CASE WHEN role = 'assistant' THEN '' ELSE text END",
    "CASE WHEN acts THEN CASE WHEN trimmed = '' THEN 'so much' ELSE concat(regexp_replace(text, '^\\s+', ''), chr(10), chr(10), 'so much') END WHEN role = 'assistant' THEN trimmed ELSE '' END",
    """CASE WHEN acts THEN concat('{"content":"wc -l f', turn, '","format":"fenced_tool_action"}') END""", "NULL::VARCHAR", "CASE WHEN role = 'assistant' THEN CASE WHEN turn % 4 = 1 THEN 'true' ELSE 'false' END END",
    """concat('org__r', conv_id % 7, '-', conv_id) AS task_id, '-' AS repo, 'm' AS teacher_model, 'swe-agent' AS harness, CASE conv_id % 3 WHEN 0 THEN NULL ELSE conv_id % 3 = 1 END AS success, CASE WHEN conv_id % 3 = 2 THEN 'gave up' END AS failure_type""",
))
def adapt_swe_agent(spark, sf_dir):
    said = F.when(F.col("acts"), F.concat("text", F.lit("\n```sh\nwc -l f"), "turn", F.lit("\n```\nso much "))).otherwise(F.col("text"))
    system = F.col("role") == "system"
    message = F.struct(
        F.when(F.col("role") == "assistant", F.lit("ai")).otherwise(F.col("role")).alias("role"), F.when(~system, said).alias("text"), F.when(system, F.col("text")).alias("system_prompt"),
        F.when(F.col("role") == "assistant", F.col("turn") % 4 == 1).alias("mask"),
    )
    rows = _rows(_talk(spark, sf_dir), message, "trajectory").withColumns({
        "instance_id": F.expr("concat('org__r', conv_id % 7, '-', conv_id)"), "model_name": F.lit("m"), "target": F.expr("case conv_id % 3 when 0 then null else conv_id % 3 = 1 end"), "exit_status": F.lit("gave up"),
        "generated_patch": F.lit("p"), "eval_logs": F.lit(""),
    })
    return _told(traces.nebius_swe_agent(rows), F.regexp_extract("task_id", r"-(\d+)$", 1))


# --- releases and the inputs of fine-tuning
_TOOL = '{"type": "function", "function": {"name": "read", "parameters": {"type": "object"}}}'
_TOOLS = '[{"function":{"name":"read","parameters":{"type":"object"}},"type":"function"}]'


def _released(spark, sf_dir) -> str:
    """The folder of a release of all conversations, as traces of a repository in seven each."""
    rows = _chat_rows(spark, sf_dir, "messages").withColumns({
        "trajectory_id": F.col("conv_id").cast("string"), "instance_id": F.expr("concat('org__r', conv_id % 7, '-', conv_id)"), "repo": F.expr("concat('org/r', conv_id % 7)"),
        "resolved": F.expr("case conv_id % 3 when 0 then -1 when 1 then 1 else 0 end"), "license": F.lit("MIT"), "tools": F.array(F.lit(_TOOL)),
    })
    episodes = traces.open_swe_traces(rows).withColumns({"source_revision": F.lit("a" * 40), "source_license": F.lit("cc-by-4.0")}).drop("error", "record_sha256", "source_file", "row_index")
    episodes = written(episodes, "episodes")  # the adapter runs once
    splits = episodes.select("source_record_id", F.expr("case cast(source_record_id as bigint) % 7 when 0 then 'dev' when 1 then 'test' else 'train' end").alias("split"))
    folder = f"{shared_dir(spark)}/quarry/release-{uuid.uuid4().hex}"
    release.build(episodes, splits, folder)
    return folder


_READ = _CHAT[: _CHAT.index("joined AS")] + """made AS (
  SELECT *, role = 'assistant' AND (action IS NOT NULL OR content <> '') AS decides, coalesce(action, concat('{"content":', to_json(content), ',"format":"assistant_final"}')) AS deed FROM read)"""


@query(_READ + """ SELECT conv_id, CASE conv_id % 7 WHEN 0 THEN 'dev' WHEN 1 THEN 'test' ELSE 'train' END AS split, (count(*) FILTER (WHERE role = 'assistant'))::INTEGER AS turns, CASE conv_id % 3 WHEN 0 THEN NULL ELSE conv_id % 3 = 1 END AS success,
  count(*) FILTER (WHERE decides) AS decisions, md5(coalesce(string_agg(deed, chr(30) ORDER BY turn) FILTER (WHERE decides), '')) AS deeds FROM made GROUP BY conv_id""")
def release_tables(spark, sf_dir):
    """What the files of a verified release hold of each episode."""
    folder = _released(spark, sf_dir)
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{folder}/{name}")
    episodes = read("episodes", schemas.EPISODES).join(spark.read.parquet(f"{folder}/splits"), "episode_id")
    deeds = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn_id", "teacher_action"))), lambda x: x["teacher_action"]), "\x1e")
    decisions = read("decisions", schemas.DECISIONS).groupBy("episode_id").agg(F.count("*").alias("decisions"), F.md5(deeds).alias("deeds"))
    both = episodes.join(decisions, "episode_id", "left")
    return both.select(
        F.col("source_record_id").cast("long").alias("conv_id"), "split", F.col("turn_count").alias("turns"), "success", F.coalesce("decisions", F.lit(0)).alias("decisions"), F.coalesce("deeds", F.md5(F.lit(""))).alias("deeds")
    )


_HELP = f"System: Tools:\n{_TOOLS}\n{TOOL_HELP}\n\n"


@query(_READ + rf""", sized AS (
  SELECT *, octet_length(encode(CASE role WHEN 'assistant' THEN 'Assistant: ' WHEN 'tool' THEN 'User: <tool_response></tool_response>' WHEN 'system' THEN 'System: ' ELSE 'User: ' END)) + 2 AS form,
    CASE WHEN reasoning <> '' THEN octet_length(encode(reasoning)) + 17 ELSE 0 END AS r, CASE WHEN role = 'tool' THEN 0 ELSE octet_length(encode(content)) END AS c,
    CASE WHEN action IS NOT NULL THEN octet_length(encode(action)) + 23 ELSE 0 END AS a, CASE WHEN role = 'tool' THEN octet_length(encode(concat('{{"content":', to_json(content), ',"tool_call_id":"', call, '"}}'))) ELSE 0 END AS t FROM made),
summed AS (
  SELECT *, (r > 0 AND c > 0)::INT AS s1, (a > 0 AND r + c > 0)::INT AS s2, sum(form + r + c + a + t + (r > 0 AND c > 0)::INT + (a > 0 AND r + c > 0)::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS upto FROM sized)
SELECT conv_id, CASE conv_id % 7 WHEN 0 THEN 'dev' WHEN 1 THEN 'test' ELSE 'train' END AS split, (count(*) FILTER (WHERE conv_id % 3 = 1))::BIGINT AS records, coalesce(sum(upto + {len(_HELP.encode())} + 2) FILTER (WHERE conv_id % 3 = 1), 0)::BIGINT AS tokens,
  coalesce(sum(r + c + 2 * a + s1 + 2 * s2 + 3) FILTER (WHERE conv_id % 3 = 1), 0)::DOUBLE AS weight, (count(*) FILTER (WHERE conv_id % 3 <> 1))::BIGINT AS failed FROM summed WHERE decides GROUP BY conv_id""")
def sft_records(spark, sf_dir):
    """Token records and the ledger of what they leave out, from a release's files; every byte is a token."""
    folder = _released(spark, sf_dir)
    out = f"{folder}-inputs"
    sft.build(spark, folder, out, [f"{b + 1} {bytes([b])!r} 1" for b in range(256)], 1 << 20)
    weight = F.aggregate("token_loss_weights", F.lit(0.0), lambda s, w: s + w)
    records = spark.read.parquet(f"{out}/records").groupBy("episode_id").agg(F.count("*").alias("records"), F.sum(F.size("token_ids")).alias("tokens"), F.sum(weight).alias("weight"))
    ledger = spark.read.json(f"{out}/excluded", schema="episode_id string, reason string")
    failed = ledger.where("reason = 'source_failure_requires_verified_recovery'").groupBy("episode_id").agg(F.count("*").alias("failed"))
    owners = spark.read.schema(schemas.EPISODES).parquet(f"{folder}/episodes").join(spark.read.parquet(f"{folder}/splits"), "episode_id").select("episode_id", F.col("source_record_id").cast("long").alias("conv_id"), "split")
    both = owners.join(records, "episode_id", "left").join(failed, "episode_id", "left").where("records is not null or failed is not null")
    return both.select("conv_id", "split", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("records", "tokens")], F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("failed", F.lit(0)).alias("failed"))
