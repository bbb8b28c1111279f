"""Queries of operators over whole episodes, admission, policies and subsets; the rest of the registry of ``catalog``.

Episodes come from ``conversations``: an assistant's turn is a call of a tool, and the user's turn behind it the answer.  A
turn's number decides whether a call or an answer is broken, and how.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import _DOCS, _NEAR, _tasks, docs_split, over_conversations, query, table
from .operators import audit as A
from .operators import interactions as T
from .operators import metrics as M
from .operators import packing as P
from .operators import quantiles as Q
from .operators import reconcile as R
from .operators import selection as S
from .operators import subsets as B
from .plans import admission, windows
from .plans import index as contamination_index
from .scratch import shared_dir, written
from .sources import blobs, catalogue, traces

# --- episodes with tools -------------------------------------------------------------------------------------------
SCHEMA = '{"additionalProperties":false,"properties":{"n":{"type":"integer"}},"required":["n"],"type":"object"}'


def _tool(name: str, parameters: str) -> str:
    return '{"function":{"name":"' + name + '","parameters":' + parameters + '},"type":"function"}'


TOOLS = {
    "good": f"[{_tool('read', SCHEMA)},{_tool('finish', SCHEMA)}]", "plain": "[]", "bad": "[" + _tool("read", '{"type":"string"}') + "]",
    "outside": "[" + _tool("read", '{"$ref":"http://x.test/s","type":"object"}') + "]",
}
#: The turn as SQL that both engines read: variant v of a turn, and what stands before it.
_TURNS = """turns AS (
  SELECT conv_id, turn, role, text, (conv_id * 31 + turn * 7) % 61 AS v, lag(role) OVER w AS before, lag(turn) OVER w AS turn_before, lead(turn) OVER w IS NULL AS ends
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
messages AS (
  SELECT conv_id, turn, v, text, ends,
    CASE WHEN role = 'system' AND v % 11 = 8 THEN 'robot' WHEN role = 'user' AND before = 'assistant' AND v <> 7 THEN 'tool' ELSE role END AS role,
    CASE WHEN role = 'user' AND before = 'assistant' AND v <> 7 THEN CASE WHEN v = 6 THEN 'nobody' ELSE concat('c', turn_before) END END AS answers,
    CASE WHEN role = 'assistant' AND v <> 5 THEN CASE WHEN v = 4 THEN '{"format":"x"}' ELSE concat('[{"function":{"arguments":', CASE v WHEN 1 THEN '{"n":"x"}' WHEN 2 THEN '{}' ELSE concat('{"n":', turn, '}') END,
      ',"name":"', CASE WHEN v = 0 THEN 'other' WHEN ends THEN 'finish' ELSE 'read' END, '"},"id":"', CASE WHEN v = 3 THEN '' ELSE concat('c', turn) END, '"}]') END END AS action
  FROM turns)"""
_TOOLS = f"""CASE conv_id % 9 WHEN 0 THEN '{TOOLS['plain']}' WHEN 1 THEN '{TOOLS['bad']}' WHEN 2 THEN '{TOOLS['outside']}' ELSE '{TOOLS['good']}' END"""

#: First violations by another way: calls are answered at once here, so what is open follows from the nearest call before.
_FIRST = f"""{_TURNS},
opened AS (
  SELECT *, last_value(CASE WHEN role = 'assistant' AND action IS NOT NULL AND NOT (ends AND contains(action, '"finish"')) THEN turn END IGNORE NULLS) OVER p AS asked,
    last_value(CASE WHEN role = 'tool' THEN turn END IGNORE NULLS) OVER p AS told
  FROM messages WINDOW p AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
judged AS (
  SELECT conv_id, turn, CASE
    WHEN role = 'robot' THEN 'unknown_role'
    WHEN role IN ('assistant', 'user') AND asked IS NOT NULL AND (told IS NULL OR told < asked) THEN 'missing_tool_response'
    WHEN role = 'assistant' AND action IS NOT NULL THEN CASE v WHEN 4 THEN 'unsupported_action_grammar' WHEN 3 THEN 'invalid_tool_call_id' WHEN 0 THEN 'unknown_tool_or_arguments' WHEN 1 THEN 'invalid_tool_arguments' WHEN 2 THEN 'invalid_tool_arguments' END
    WHEN role = 'tool' AND (asked IS NULL OR (told IS NOT NULL AND told > asked) OR answers <> 'c' || asked) THEN 'orphan_tool_response' END AS fault FROM opened),
after AS (
  SELECT conv_id, max(CASE WHEN role = 'assistant' AND action IS NOT NULL AND NOT (ends AND contains(action, '"finish"')) THEN turn END) AS asked, max(CASE WHEN role = 'tool' THEN turn END) AS told,
    count(CASE WHEN role = 'assistant' AND action IS NOT NULL THEN 1 END) AS calls FROM messages GROUP BY conv_id),
firsts AS (
  SELECT conv_id, CASE conv_id % 9 WHEN 0 THEN 'missing_tool_schema' WHEN 1 THEN 'invalid_tool_schema' WHEN 2 THEN 'external_tool_schema_reference' ELSE
    coalesce(fault, CASE WHEN asked IS NOT NULL AND (told IS NULL OR told < asked) THEN 'missing_tool_response' WHEN calls = 0 THEN 'no_tool_actions' END) END AS violation
  FROM after LEFT JOIN (SELECT conv_id, arg_min(fault, turn) AS fault FROM judged WHERE fault IS NOT NULL GROUP BY conv_id) USING (conv_id))"""


def _episodes(spark, sf_dir) -> DataFrame:
    rows = over_conversations(spark, sf_dir, f"WITH {_TURNS} SELECT conv_id, turn, role, text, answers, action FROM messages")
    none = F.lit(None).cast("string")
    item = F.struct(F.col("turn"), F.struct("role", F.col("text").alias("content"), F.lit("").alias("reasoning"), "action", F.col("answers").alias("tool_call_id")).alias("m"))
    rows = rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["m"]).alias("messages"))
    return rows.select("conv_id", F.expr(_TOOLS).alias("tools"), "messages", none.alias("unused")).drop("unused")


@query(f"WITH {_FIRST} SELECT conv_id, violation FROM firsts WHERE violation IS NOT NULL")
def tool_interactions(spark, sf_dir):
    return T.first_violations(_episodes(spark, sf_dir), "conv_id")


@query(f"WITH {_FIRST} SELECT violation, count(*) AS episodes FROM firsts WHERE violation IS NOT NULL GROUP BY violation")
def tool_violation_counts(spark, sf_dir):
    return tool_interactions(spark, sf_dir).groupBy("violation").agg(F.count("*").alias("episodes"))


_PLANTED = "CASE conv_id % 6 WHEN 3 THEN concat('reach mia', conv_id, '@shipyard.dev') WHEN 4 THEN 'id 078-05-1120' ELSE 'nothing' END"


@query(f"""WITH {_FIRST} SELECT conv_id, array_to_string(list_sort(list_filter([violation, CASE WHEN conv_id % 7 = 0 THEN 'unpinned_source' END, CASE WHEN conv_id % 5 = 0 THEN 'unverified_dataset_license' END,
  CASE WHEN conv_id % 4 = 1 THEN 'unverified_repo_license' END, CASE WHEN conv_id % 8 = 2 THEN 'missing_task_identity' END, CASE conv_id % 6 WHEN 3 THEN 'email' WHEN 4 THEN 'ssn' END], lambda x: x IS NOT NULL)), ',') AS findings
FROM firsts""")
def episode_audit(spark, sf_dir):
    rows = _episodes(spark, sf_dir)
    rows = rows.select(
        "conv_id", "tools", F.transform("messages", lambda m: m.withField("content", F.lit("said"))).alias("messages"), F.expr("if(conv_id % 7 = 0, 'main', sha1(cast(conv_id as string)))").alias("source_revision"),
        F.expr("if(conv_id % 5 = 0, 'other', 'cc-by-4.0')").alias("source_license"), F.expr("""if(conv_id % 4 = 1, '{}', '{"repo_license":"MIT"}')""").alias("metadata"),
        F.lit("a/b").alias("repo"), F.expr("if(conv_id % 8 = 2, ' ', 'task')").alias("task_text"), F.expr(_PLANTED).alias("raw_record"),
    )
    return A.audit(rows, "conv_id").select("conv_id", F.array_join("findings", ",").alias("findings"))


@query("""WITH m AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations),
e AS (SELECT conv_id, list(pos ORDER BY pos) AS p FROM m WHERE role = 'assistant' AND turn % 5 <> 4 GROUP BY conv_id)
SELECT conv_id, array_to_string(list_transform(range(2), lambda i: p[(i * (len(p) - 1)) // 1 + 1]), ',') AS chosen FROM e WHERE len(p) >= 2""")
def chosen_decisions(spark, sf_dir):
    m = F.struct("role", F.col("text").alias("content"), F.lit(None).cast("string").alias("action"), F.expr("turn % 5 <> 4").alias("loss_mask"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", m.alias("m")))), lambda x: x["m"]).alias("messages"))
    rows = rows.withColumn("p", admission.eligible(F.col("messages"))).where("size(p) >= 2")
    return rows.select("conv_id", F.array_join(F.transform(admission.spread(F.col("p"), 2), lambda x: x.cast("string")), ",").alias("chosen"))


#: Tokens of several bytes; some reach from one region of the training text into the next.
MERGED = (
    "the", " the", "the ", "th", "er", "in", "on", "an", "tion", "ing", " and", " to", " of ", "ou", "ent", "ea", "ha", "he", "sh", "ly", "ed", "ble", "é", "è", "ion", "eau", "ment", "que", "ü", "ö", "ung", "sch", "ein", "ich",
    "ñ", "ó", "ción", "mente", "ado", ", ", ". ", ".\n", ".\n\n", "\n\nUser: ", "\n\nAssistant: ", ".\n\nUser: T", "nt: T", "nt: E", "User: ", "System: ", "Assistant",
)
VOCABULARY = [f"{b + 1} {bytes([b])!r} 1" for b in range(256)] + [f"{i + 300} {t!r} {len(t.encode())}" for i, t in enumerate(MERGED)]
WINDOW_TOKENS = 4000


def _sessions(spark, sf_dir) -> DataFrame:
    """Episodes of ten conversations each; every other one's task is what its first user says, the rest state it nowhere."""
    none = F.lit(None).cast("string")
    m = F.struct("role", F.col("text").alias("content"), F.lit("").alias("reasoning"), none.alias("action"), none.alias("tool_call_id"), F.lit(None).cast("boolean").alias("loss_mask"), none.alias("metadata"))
    rows = table(spark, sf_dir, "conversations").withColumn("session", F.expr("conv_id div 10")).groupBy("session")
    rows = rows.agg(F.transform(F.sort_array(F.collect_list(F.struct("conv_id", "turn", m.alias("m")))), lambda x: x["m"]).alias("messages"))
    own, said = F.col("session").cast("string"), F.element_at(F.filter("messages", lambda x: x["role"] == "user"), 1)["content"]
    task = F.when(F.col("session") % 2 == 0, F.coalesce(said, F.lit(""))).otherwise(F.concat(F.lit("work "), own, F.lit(" at the harbour")))
    return rows.select(own.alias("episode_id"), own.alias("source_dataset"), own.alias("source_record_id"), F.lit("train").alias("split"), own.alias("split_group"), own.alias("teacher_model"), F.lit(True).alias("success"), task.alias("task_text"), none.alias("tools"), "messages")


_MERGED_RE = "|".join(re.escape(t) for t in sorted(MERGED, key=lambda t: -len(t.encode()))).replace("\\\n", "\\n").replace("\\ ", " ")


@query(rf"""WITH m AS (SELECT conv_id // 10 AS ep, role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id // 10 ORDER BY conv_id, turn) - 1 AS pos FROM conversations),
g AS (SELECT *, sum((pos = 0 OR role = 'assistant')::INT) OVER w AS grp, max(CASE WHEN role = 'user' THEN pos END) OVER p AS lu, max(CASE WHEN role = 'assistant' THEN pos END) OVER p AS la, min(CASE WHEN role = 'user' THEN pos END) OVER (PARTITION BY ep) AS u0
  FROM m WINDOW w AS (PARTITION BY ep ORDER BY pos), p AS (PARTITION BY ep ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tasks AS (SELECT ep, CASE WHEN ep % 2 = 0 THEN coalesce(max(text) FILTER (WHERE pos = u0), '') ELSE 'work ' || ep || ' at the harbour' END AS task FROM g GROUP BY ep),
pieces AS (
  SELECT ep, pos, 0 AS part, CASE role WHEN 'assistant' THEN 'assistant_prefix' WHEN 'system' THEN 'system' ELSE 'user' END AS region, CASE role WHEN 'assistant' THEN 'Assistant: ' WHEN 'system' THEN 'System: ' || text || chr(10) || chr(10) ELSE 'User: ' || text || chr(10) || chr(10) END AS x FROM g
  UNION ALL SELECT ep, pos, 1, 'assistant_final', text FROM g WHERE role = 'assistant' UNION ALL SELECT ep, pos, 2, 'assistant_turn_end', chr(10) || chr(10) FROM g WHERE role = 'assistant'),
grps AS (SELECT ep, grp, min(pos) AS f, max(pos) AS l FROM g GROUP BY ep, grp HAVING NOT bool_or(role = 'system' OR pos = u0)),
targets AS (SELECT ep, pos AS target, lu, la FROM g WHERE role = 'assistant' AND text <> ''),
loose AS (SELECT ep, target, f, l, row_number() OVER (PARTITION BY ep, target ORDER BY f) AS i FROM targets JOIN grps USING (ep) WHERE l < la AND NOT coalesce(lu BETWEEN f AND l, false)),
tries AS (SELECT t.ep, t.target, unnest(range(0, coalesce(max(i), 0) + 1)) AS k FROM targets t LEFT JOIN loose o ON t.ep = o.ep AND t.target = o.target GROUP BY t.ep, t.target),
texts AS (SELECT ep, pos, string_agg(x, '' ORDER BY part) AS x FROM pieces GROUP BY ep, pos),
windows AS (
  SELECT t.ep, t.target, t.k, string_agg(x.x, '' ORDER BY x.pos) AS w, count(*) AS messages FROM tries t JOIN texts x ON x.ep = t.ep AND x.pos <= t.target
  LEFT JOIN loose o ON o.ep = t.ep AND o.target = t.target AND o.i <= t.k AND x.pos BETWEEN o.f AND o.l WHERE o.i IS NULL GROUP BY t.ep, t.target, t.k),
full_ AS (SELECT ep, target, k, messages, CASE WHEN ep % 2 = 0 THEN '' ELSE 'User: Task contract:' || chr(10) || task || chr(10) || chr(10) END AS contract, w FROM windows JOIN tasks USING (ep)),
cut AS (SELECT ep, target, k, messages, contract, regexp_extract_all(contract || w, '(?s){_MERGED_RE}|.') AS t FROM full_),
sized AS (SELECT ep, target, k, messages, contract, t, list_sum(list_transform(t, lambda c: CASE WHEN len(c) = 1 AND NOT list_contains(['é', 'è', 'ü', 'ö', 'ñ', 'ó'], c) THEN octet_length(encode(c)) ELSE 1 END)) AS n FROM cut),
best AS (SELECT * FROM sized WHERE n + 1 <= {WINDOW_TOKENS} QUALIFY k = min(k) OVER (PARTITION BY ep, target)),
tokens AS (
  SELECT ep, target, c, CASE WHEN len(c) = 1 AND NOT list_contains(['é', 'è', 'ü', 'ö', 'ñ', 'ó'], c) THEN octet_length(encode(c)) ELSE 1 END AS n, sum(len(c)) OVER (PARTITION BY ep, target ORDER BY i) - len(c) AS a, sum(len(c)) OVER (PARTITION BY ep, target ORDER BY i) AS b
  FROM (SELECT ep, target, unnest(t) AS c, generate_subscripts(t, 1) AS i FROM best)),
shown AS (
  SELECT b.ep, b.target, -1 AS pos, 0 AS part, 'user' AS region, contract AS x FROM best b WHERE contract <> '' UNION ALL
  SELECT b.ep, b.target, p.pos, p.part, p.region, p.x FROM best b JOIN pieces p ON p.ep = b.ep AND p.pos <= b.target AND p.x <> ''
  LEFT JOIN loose o ON o.ep = b.ep AND o.target = b.target AND o.i <= b.k AND p.pos BETWEEN o.f AND o.l WHERE o.i IS NULL),
changed AS (SELECT *, lag(region) OVER w IS DISTINCT FROM region AS turn, sum(len(x)) OVER w - len(x) AS start FROM shown WINDOW w AS (PARTITION BY ep, target ORDER BY pos, part)),
kinds AS (SELECT ep, target, pos, region, start, sum(turn::INT) OVER (PARTITION BY ep, target ORDER BY start) AS kind FROM changed),
met AS (
  SELECT t.ep, t.target, t.n, x.kind <> y.kind AS mixed, x.pos = t.target AND x.region IN ('assistant_final', 'assistant_turn_end') AS learns
  FROM tokens t ASOF JOIN kinds x ON t.ep = x.ep AND t.target = x.target AND t.a >= x.start ASOF JOIN kinds y ON t.ep = y.ep AND t.target = y.target AND t.b - 1 >= y.start),
summed AS (SELECT ep, target, sum(n) AS n, coalesce(sum(n) FILTER (WHERE mixed), 0) AS mixed, coalesce(sum(n) FILTER (WHERE learns AND NOT mixed), 0) AS learned FROM met GROUP BY ep, target)
SELECT t.ep::BIGINT AS session, t.target::INTEGER AS message_index, coalesce(s.n + 2, 0)::INTEGER AS tokens, coalesce(s.learned + 1, 0)::DOUBLE AS weight, coalesce(s.mixed, 0)::INTEGER AS mixed, coalesce(t.target + 1 - b.messages, 0)::INTEGER AS dropped, s.n IS NULL AS overflows
FROM targets t LEFT JOIN summed s ON s.ep = t.ep AND s.target = t.target LEFT JOIN best b ON b.ep = t.ep AND b.target = t.target""")
def decision_tokens(spark, sf_dir):
    found = windows.token_records(_sessions(spark, sf_dir), VOCABULARY, WINDOW_TOKENS)
    weight = F.aggregate("token_loss_weights", F.lit(0.0), lambda s, w: s + w)
    return found.select(
        F.col("episode_id").cast("long").alias("session"), "message_index", F.size("token_ids").alias("tokens"), weight.alias("weight"), F.col("mixed_boundary_count").alias("mixed"),
        F.col("dropped_messages").alias("dropped"), F.col("excluded").isNotNull().alias("overflows"),
    )


# --- raw rows, identities and policies -----------------------------------------------------------------------------
@query(r"""WITH c AS (SELECT conv_id, turn, role, CASE WHEN turn = 0 AND conv_id % 3 = 0 THEN ' ' ELSE text END AS text FROM conversations)
SELECT conv_id, 'task:build-' || (conv_id % 25) AS identity, coalesce((SELECT arg_min(text, turn) FROM c d WHERE d.conv_id = c.conv_id AND role = 'user' AND regexp_replace(text, '\s+', '', 'g') <> ''), '') AS task_text
FROM c GROUP BY conv_id""")
def raw_task_identity(spark, sf_dir):
    m = F.struct("role", F.expr("if(turn = 0 and conv_id % 3 = 0, ' ', text)").alias("content"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", m.alias("m")))), lambda x: x["m"]).alias("conversations"))
    rows = rows.withColumn("task", F.expr("concat('Build-', conv_id % 25, if(conv_id % 2 = 0, '_copy1', ''))"))
    return catalogue.identity_and_text(rows, "openthoughts_agent").select("conv_id", "identity", "task_text")


@query(f"WITH {_DOCS} SELECT DISTINCT split, group_sha256 FROM docs WHERE split IN ('dev', 'test')")
def heldout_lists(spark, sf_dir):
    return docs_split(spark, sf_dir, "split", "group_sha256").where("split in ('dev', 'test')").distinct().orderBy("split", "group_sha256")


@query("SELECT event_id, user_id FROM events WHERE (user_id % 50, event_id % 97) IN (SELECT DISTINCT o_custkey % 50, o_orderkey % 97 FROM orders WHERE o_orderstatus = 'P')")
def locator_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "events", "event_id", "user_id", F.expr("user_id % 50").alias("source_file"), F.expr("event_id % 97").alias("row_index"))
    named = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.expr("o_custkey % 50").alias("source_file"), F.expr("o_orderkey % 97").alias("row_index"))
    return R.located(rows, named).select("event_id", "user_id")


@query("""SELECT doc_id, 'documents.parquet' AS source_file, doc_id AS row_index, md5(text) AS digest, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)""")
def located_documents(spark, sf_dir):
    """The table is one file or a folder of them; the locators name its files, the result the table and the document's id."""
    bad = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id")
    places = traces.scan(spark, sf_dir, ["documents.parquet", "documents.parquet/*"], ["doc_id"])
    named = written(places.join(bad, "doc_id", "left_semi").select("source_file", "row_index"), "located-documents")
    rows = traces.located(spark, sf_dir, named, ["doc_id", "text", "n_chars"])
    return rows.select("doc_id", F.lit("documents.parquet").alias("source_file"), F.col("doc_id").alias("row_index"), F.md5("text").alias("digest"), "n_chars")


@query("""SELECT source_file, row_index, row_number() OVER (ORDER BY sha256('11/' || source_file), source_file, row_index) - 1 AS place FROM (SELECT source AS source_file, doc_id AS row_index FROM documents) QUALIFY place < 400""")
def scan_order(spark, sf_dir):
    rows = table(spark, sf_dir, "documents", F.col("source").alias("source_file"), F.col("doc_id").alias("row_index"))
    return admission.scan_order(rows, 11, 400)


# --- reconciliations -----------------------------------------------------------------------------------------------
@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'task_join_missing' WHEN d.doc_id % 5 = 0 OR d.doc_id % 7 = 0 OR d.doc_id % 11 = 0 THEN 'task_join_conflict' END AS finding
FROM (SELECT doc_id FROM documents) d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id""")
def task_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", F.col("doc_id").alias("task_id"), F.expr("concat('https://github.com/Org/R', doc_id % 9)").alias("repo"), F.lit("MIT").alias("licence"))
    tasks = table(spark, sf_dir, "labels", "doc_id").distinct().select(
        F.col("doc_id").alias("instance_id"), F.expr("if(doc_id % 5 = 0, 'org/other', concat('org__r', doc_id % 9))").alias("repo"), F.expr("if(doc_id % 7 = 0, 'GPL', 'MIT')").alias("license"),
        F.expr("if(doc_id % 11 = 0, 'main', sha1(cast(doc_id as string)))").alias("base_commit"),
    )
    return R.task_findings(docs, tasks).select("doc_id", F.col("task_finding").alias("finding"))


@query("""SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'right_only' WHEN doc_id % 19 = 0 THEN 'left_only' ELSE 'differs' END AS fault,
CASE WHEN doc_id % 17 = 0 OR doc_id % 19 = 0 THEN NULL ELSE array_to_string(list_filter([CASE WHEN doc_id % 13 = 0 THEN 'lang' END, CASE WHEN doc_id % 10 = 0 THEN 'n_chars' END], lambda x: x IS NOT NULL), ',') END AS columns
FROM documents WHERE NOT (doc_id % 17 = 0 AND doc_id % 19 = 0) AND (doc_id % 17 = 0 OR doc_id % 19 = 0 OR doc_id % 13 = 0 OR doc_id % 10 = 0)""")
def reconcile_records(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "lang", "n_chars")
    kept = docs.where("doc_id % 17 <> 0").withColumn("lang", F.expr("if(doc_id % 13 = 0, null, lang)"))
    stated = docs.where("doc_id % 19 <> 0").withColumn("n_chars", F.expr("if(doc_id % 10 = 0, n_chars + 1, n_chars)"))
    found = R.differences(kept, stated, ["doc_id"], ["lang", "n_chars"])
    return found.select("doc_id", "fault", F.array_join("columns", ",").alias("columns"))


@query("""SELECT event_id, array_to_string(list_sort(list_filter(['k', 'extra'], lambda x: NOT list_contains(json_keys(props), x))), ',') AS missing,
array_to_string(list_sort(list_filter(json_keys(props), lambda x: x NOT IN ('k', 'extra'))), ',') AS unknown FROM events""")
def unexpected_members(spark, sf_dir):
    found = table(spark, sf_dir, "events", "event_id", "props").withColumn("m", R.unexpected_members(F.col("props"), ["k", "extra"]))
    return found.select("event_id", F.array_join("m.missing", ",").alias("missing"), F.array_join("m.unknown", ",").alias("unknown"))


# --- subsets, profiles and metrics ---------------------------------------------------------------------------------
@query("""SELECT doc_id, list_reduce(list_prepend(0::HUGEINT, list_transform(range(8), lambda i: ('0x' || substr(sha256('5/' || doc_id), 8 * i::INTEGER + 1, 8))::UBIGINT::HUGEINT)), lambda acc, x: (acc * 4294967296 + x) % (doc_id % 40 + 1))::BIGINT AS pick FROM documents""")
def hash_choice(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id")
    return docs.select("doc_id", B.hash_choice(F.concat(F.lit("5/"), F.col("doc_id")), F.col("doc_id") % 40 + 1).alias("pick"))


@query("""WITH s AS (SELECT quality, toxic, dense_rank() OVER (ORDER BY quality, toxic) - 1 AS spot, count(*) OVER () AS n FROM (SELECT DISTINCT quality, toxic FROM labels)),
r AS (SELECT doc_id, quality, toxic, row_number() OVER (PARTITION BY quality, toxic ORDER BY sha256('3/' || doc_id), doc_id) AS nth FROM labels)
SELECT doc_id, quality, toxic, ((nth - 1) * n + spot)::INTEGER AS place FROM r JOIN s USING (quality, toxic) WHERE nth <= 24 // n""")
def balanced_subset(spark, sf_dir):
    return B.balanced(table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"), ["quality", "toxic"], 24, 3, "doc_id")


@query("""SELECT source, count(*) AS episodes, count(CASE WHEN n_chars > 4000 THEN 1 END) AS oversized, count(CASE WHEN n_chars > 9000 THEN 1 END) AS failed,
sum(n_chars)::BIGINT AS whole_total, quantile_cont(n_chars, 0.5) AS whole_p50, round(quantile_cont(n_chars, 0.95), 6) AS whole_p95, max(n_chars) AS whole_max,
sum(w)::BIGINT AS window_total, quantile_cont(w, 0.5) AS window_p50, round(quantile_cont(w, 0.95), 6) AS window_p95, max(w) AS window_max
FROM (SELECT *, CASE WHEN n_chars <= 9000 THEN least(n_chars, 4000) END AS w FROM documents) GROUP BY source""")
def source_profile(spark, sf_dir):
    rows = table(spark, sf_dir, "documents", "source", "n_chars").withColumn("w", F.expr("if(n_chars <= 9000, least(n_chars, 4000), null)"))
    return B.source_profile(rows, "source", "n_chars", "w", 4000).withColumns({c: F.round(c, 6) for c in ("whole_p95", "window_p95")})


@query("""SELECT conv_id, role AS region, count(*) AS tokens, count(CASE WHEN w > 0 THEN 1 END) AS weighted, sum(w)::DOUBLE AS weight
FROM (SELECT conv_id, role, CASE WHEN role = 'assistant' THEN length(text) % 3 ELSE 0 END AS w FROM conversations) GROUP BY conv_id, role""")
def loss_regions(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "role", F.expr("cast(if(role = 'assistant', length(text) % 3, 0) as float)").alias("w"))
    return M.region_counts(rows.groupBy("conv_id").agg(F.collect_list("role").alias("token_regions"), F.collect_list("w").alias("token_loss_weights")), ["conv_id"])


@query("""SELECT l_linenumber, count(*) AS n, CASE WHEN bool_or(bad) THEN NULL ELSE round(sum(loss * w)::DOUBLE / sum(w)::DOUBLE, 9) END AS weighted,
CASE WHEN bool_or(bad) THEN NULL ELSE round(quantile_cont(loss, 0.9), 6) END AS p90, CASE WHEN bool_or(bad) THEN 'bad_value' END AS fault
FROM (SELECT l_linenumber, (l_discount * 100)::BIGINT AS loss, CASE WHEN l_linenumber = 5 THEN -1 ELSE l_quantity::BIGINT END AS w, l_linenumber = 5 AS bad FROM lineitem) GROUP BY l_linenumber""")
def guarded_losses(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_linenumber", F.round(F.col("l_discount") * 100).cast("bigint").alias("loss"), F.expr("if(l_linenumber = 5, -1L, cast(l_quantity as bigint))").alias("w"))
    found = M.weighted_losses(rows, ["l_linenumber"], "loss", "w")
    return found.select("l_linenumber", "n", F.round("weighted", 9).alias("weighted"), F.round(F.get("quantiles", F.lit(2)), 6).alias("p90"), "fault")


@query("""WITH r AS (SELECT user_id, event_id, value, event_id % 3 AS d, first_value(event_id % 3) OVER w AS fd, value / first_value(value) OVER w AS a, value / lag(value) OVER w AS b FROM events WHERE value > 0 WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, d = fd AS covers, d = fd AND NOT coalesce(a > 2.0 OR b > 2.0, false) AS passed FROM r""")
def epoch_gates(spark, sf_dir):
    rows = table(spark, sf_dir, "events", "user_id", "event_id", "value").where("value > 0").withColumn("d", F.expr("event_id % 3"))
    return M.gates(rows, "user_id", "event_id", "value", "d", 2.0, 2.0).select("user_id", "event_id", "covers", "passed")


_PAIRS = "s AS (SELECT label, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS p, lead(list_transform(embedding, lambda x: x::DOUBLE)) OVER (PARTITION BY label ORDER BY vec_id) AS q FROM embeddings)"


@query(f"""WITH {_PAIRS}, t AS (SELECT vec_id, p, q, ln(list_sum(list_transform(p, lambda x: exp(x)))) AS lp, ln(list_sum(list_transform(q, lambda x: exp(x)))) AS lq FROM s WHERE q IS NOT NULL)
SELECT vec_id, round(list_sum(list_transform(range(1, len(p) + 1), lambda i: exp(p[i] - lp) * (p[i] - lp - q[i] + lq))), 6) AS kl, list_position(p, list_max(p)) = list_position(q, list_max(q)) AS agrees,
round(list_reverse_sort(p)[1] - list_reverse_sort(p)[2], 6) AS margin FROM t""")
def vector_divergence(spark, sf_dir):
    pairs = table(spark, sf_dir, "embeddings").selectExpr("vec_id", "embedding", "lead(embedding) over (partition by label order by vec_id) as other").where("other is not null")
    found = pairs.select("vec_id", M.divergence(F.col("embedding"), F.col("other")).alias("d"))
    return found.select("vec_id", F.round("d.kl", 6).alias("kl"), "d.agrees", F.round("d.margin", 6).alias("margin"))


@query(f"""WITH {_PAIRS}, t AS (SELECT vec_id, p, list_transform(range(1, len(p) + 1), lambda i: q[i] - p[i]) AS d FROM s WHERE q IS NOT NULL)
SELECT vec_id, len(list_filter(d, lambda x: x <> 0))::INTEGER AS different, round(list_max(list_transform(d, lambda x: abs(x))), 6) AS max_abs,
round(sqrt(list_sum(list_transform(d, lambda x: x * x))) / sqrt(list_sum(list_transform(p, lambda x: x * x))), 6) AS relative_l2,
round(list_max(list_transform(range(1, len(p) + 1), lambda i: abs(d[i]) / (1 + abs(p[i])))), 6) AS scaled_max FROM t""")
def vector_difference(spark, sf_dir):
    pairs = table(spark, sf_dir, "embeddings").selectExpr("vec_id", "embedding", "lead(embedding) over (partition by label order by vec_id) as other").where("other is not null")
    found = pairs.select("vec_id", M.vector_differences(F.col("embedding"), F.col("other")).alias("d"))
    return found.select("vec_id", "d.different", *[F.round(f"d.{c}", 6).alias(c) for c in ("max_abs", "relative_l2", "scaled_max")])


@query("""SELECT sample_id, n AS real_tokens, n <= 300 AS fits, CASE WHEN n <= 300 THEN 300 ELSE 0 END AS width, CASE WHEN n <= 300 THEN 300 - n ELSE 0 END AS padding
FROM (SELECT conv_id || '/' || turn AS sample_id, (length(text) - 1)::INTEGER AS n FROM conversations WHERE length(text) > 1)""")
def padded_baseline(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("length(text) > 1")
    ids = F.transform(F.split("text", ""), lambda c: F.ascii(c))
    rows = rows.select(F.concat_ws("/", "conv_id", "turn").alias("sample_id"), ids.alias("ids"), F.transform("ids", lambda _: F.lit(1.0).cast("float")).alias("weights"))
    found = P.padded_rows(rows, 300)
    return found.select("sample_id", "real_tokens", "fits", F.when(F.col("fits"), F.size("input_ids")).otherwise(0).alias("width"), F.when(F.col("fits"), F.size(F.filter("target_ids", lambda t: t == -100))).otherwise(0).alias("padding"))


@query("""SELECT candidate, accepted, array_to_string(reasons, ',') AS reasons FROM (
  SELECT doc_id::VARCHAR AS candidate, nth <= 20 AND per <= 10 AS accepted,
    list_filter([CASE WHEN full_at < place THEN 'split_quota_reached' END, CASE WHEN teacher_full < place THEN 'teacher_quota_reached' END], lambda x: x IS NOT NULL) AS reasons
  FROM (SELECT *, max(CASE WHEN per = 10 THEN place END) OVER (PARTITION BY quality, toxic) AS teacher_full, max(CASE WHEN nth = 20 THEN place END) OVER (PARTITION BY quality) AS full_at
    FROM (SELECT doc_id, quality, toxic, sha256('2/' || doc_id) AS place, row_number() OVER (PARTITION BY quality, toxic ORDER BY sha256('2/' || doc_id)) AS per, 0 AS nth FROM labels)))""")
def quota_admission(spark, sf_dir):
    own = F.col("doc_id").cast("string")
    rows = table(spark, sf_dir, "labels", "doc_id", "quality", "toxic").select(
        S.order_key(2, F.col("doc_id")).alias("place"), own.alias("candidate"), own.alias("task_id"), F.concat(F.lit("d"), own).alias("task_digest"), own.alias("content_digest"),
        F.col("quality").cast("string").alias("split"), F.col("toxic").cast("string").alias("teacher"), F.array().cast("array<string>").alias("findings"),
    )
    found = S.greedy_admission(rows, {"0": 10_000_000, "1": 10_000_000}, {"0": 10, "1": 10})
    return found.select("candidate", "accepted", F.array_join("reasons", ",").alias("reasons"))


@query("""WITH x AS (SELECT l_returnflag AS flag, l_extendedprice * (1 + l_tax) - l_discount * l_partkey AS v FROM lineitem)
SELECT flag, count(*) AS n, round(quantile_cont(v, 0.01), 5) AS p1, round(quantile_cont(v, 0.5), 5) AS p50, round(quantile_cont(v, 0.999), 5) AS p999 FROM x GROUP BY flag
UNION ALL SELECT 'all', count(*), round(quantile_cont(v, 0.01), 5), round(quantile_cont(v, 0.5), 5), round(quantile_cont(v, 0.999), 5) FROM x""")
def price_quantiles(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem", F.col("l_returnflag").alias("flag"), F.expr("l_extendedprice * (1 + l_tax) - l_discount * l_partkey").cast("double").alias("v"))
    shares = {"p1": 0.01, "p50": 0.5, "p999": 0.999}
    both = Q.interpolated(rows, ["flag"], "v", shares).unionByName(Q.interpolated(rows, [], "v", shares).withColumn("flag", F.lit("all")))
    return both.select("flag", "n", *[F.round(c, 5).alias(c) for c in shares])


@query("""SELECT sha256('{"n":' || n_chars || ',"source":"' || coalesce(source, '') || '"}') AS digest, 1::BIGINT AS copies, true AS intact FROM documents GROUP BY n_chars, coalesce(source, '')""")
def stored_records(spark, sf_dir):
    """Three batches that overlap, into one store."""
    docs = table(spark, sf_dir, "documents", "doc_id", F.expr("concat('{\"source\": \"', coalesce(source, ''), '\", \"n\": ', n_chars, '}')").alias("value"))
    folder = f"{shared_dir(spark)}/quarry/store-{uuid.uuid4().hex}"
    for batch in ("doc_id % 3 < 2", "doc_id % 3 > 0", "doc_id % 2 = 0"):
        blobs.put(blobs.addressed(docs.where(batch)), folder)
    refs = blobs.read(spark, folder).groupBy("digest").agg(F.count("*").alias("copies")).withColumn("ref", F.concat(F.lit("sha256:"), F.col("digest")))
    return blobs.get(refs, folder).select("digest", "copies", "intact")


@query(f"""WITH {_NEAR}, cand_docs AS (SELECT doc_id, sha256(folded) AS digest, split FROM tasks WHERE doc_id % 4 = 3),
near_both AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near), held AS (SELECT DISTINCT sha256(folded) AS digest, split FROM tasks WHERE doc_id % 4 < 3)
SELECT DISTINCT c.doc_id, 'cross_split_exact_task' AS finding FROM cand_docs c JOIN held h ON c.digest = h.digest AND c.split <> h.split
UNION SELECT DISTINCT c.doc_id, 'cross_split_near_task' FROM cand_docs c JOIN near_both n ON n.a = c.digest JOIN held h ON h.digest = n.b AND h.split <> c.split""")
def index_findings(spark, sf_dir):
    """An index of three batches, and the texts that it tells of the fourth."""
    tasks = _tasks(spark, sf_dir).withColumn("group_sha256", F.sha2(F.col("doc_id").cast("string"), 256))
    folder, none = f"{shared_dir(spark)}/quarry/index-{uuid.uuid4().hex}", spark.createDataFrame([], "digest string, split string")
    for i, write in enumerate((contamination_index.build, contamination_index.append, contamination_index.append)):
        part = tasks.where(F.col("doc_id") % 4 == i)
        write(part, none, folder, "policy", [{"source": f"batch {i}"}])
    asked = tasks.where("doc_id % 4 = 3").select(F.col("doc_id").alias("candidate"), "folded", F.lit("none").alias("trace"), "split")
    return contamination_index.Index(spark, folder, "policy").findings(asked).withColumnRenamed("candidate", "doc_id")


#: Schemas of one keyword each over {"key", "balance", "segment", "codes"}, with what they ask as SQL.
KEYWORD_SCHEMAS = (
    ('{"properties": {"balance": {"exclusiveMinimum": 0, "exclusiveMaximum": 5000}}}', "b > 0 AND b < 5000"),
    ('{"properties": {"key": {"multipleOf": 7}}}', "k % 7 = 0"),
    ('{"properties": {"codes": {"uniqueItems": true}}}', "c1 <> c2 AND c2 <> c3 AND c1 <> c3"),
    ('{"properties": {"codes": {"prefixItems": [{"maximum": 9}, {"const": 3}], "items": {"enum": [0, 2]}}}}', "c1 <= 9 AND c2 = 3 AND c3 IN (0, 2)"),
    ('{"properties": {"codes": {"contains": {"minimum": 10}}}}', "c1 >= 10"),
    ('{"properties": {"codes": {"contains": {"maximum": 2}, "minContains": 2, "maxContains": 2}}}', "(c1 <= 2)::INT + (c2 <= 2)::INT + (c3 <= 2)::INT = 2"),
    ('{"patternProperties": {"^[kb]": {"minimum": 100}}, "additionalProperties": {"type": ["string", "array"]}}', "k >= 100 AND b >= 100 AND k % 5 <> 0"),
    ('{"if": {"properties": {"segment": {"pattern": "^[A-H]"}}}, "then": {"properties": {"balance": {"minimum": 0}}}, "else": {"properties": {"key": {"maximum": 700}}}}', "CASE WHEN g < 'I' THEN b >= 0 ELSE k <= 700 END"),
    ('{"dependentRequired": {"vip": ["since"]}}', "k % 5 <> 0 OR k % 10 = 0"),
    ('{"dependentSchemas": {"vip": {"properties": {"balance": {"minimum": 1000}}}}}', "k % 5 <> 0 OR b >= 1000"),
    ('{"propertyNames": {"maxLength": 6}}', "false"),
    ('{"minProperties": 5, "maxProperties": 5}', "(k % 5 = 0) <> (k % 10 = 0)"),
    ('{"oneOf": [{"properties": {"key": {"maximum": 300}}}, {"required": ["vip"]}], "not": {"properties": {"segment": {"enum": ["MACHINERY"]}}}}', "(k <= 300) <> (k % 5 = 0) AND g <> 'MACHINERY'"),
    ('{"$ref": "#/$defs/rich", "$defs": {"rich": {"properties": {"balance": {"minimum": 5000}}}}}', "b >= 5000"),
)


@query(f"""WITH c AS (SELECT c_custkey AS k, c_acctbal AS b, c_mktsegment AS g, c_nationkey AS c1, c_custkey % 5 AS c2, c_custkey % 3 AS c3 FROM customer)
SELECT k AS custkey, concat({', '.join(f"CASE WHEN {sql} THEN 1 ELSE 0 END" for _, sql in KEYWORD_SCHEMAS)}) AS fits FROM c""")
def schema_keywords(spark, sf_dir):
    more = "if(c_custkey % 5 = 0, ', \"vip\": true', ''), if(c_custkey % 10 = 0, ', \"since\": 1', '')"
    value = F.expr(f"""concat('{{"key": ', c_custkey, ', "balance": ', cast(c_acctbal as decimal(20, 2)), ', "segment": "', c_mktsegment, '", "codes": [', c_nationkey, ', ', c_custkey % 5, ', ', c_custkey % 3, ']', {more}, '}}')""")
    rows = table(spark, sf_dir, "customer", F.col("c_custkey").alias("custkey"), value.alias("value"))
    # a row costs far more than its bytes, by which Spark deals a file out to tasks
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "custkey")
    fits = T.schemas_accept([s for s, _ in KEYWORD_SCHEMAS], F.col("value"))
    return rows.select("custkey", F.array_join(F.transform(fits, lambda x: x.cast("int").cast("string")), "").alias("fits"))


@query("""WITH r AS (SELECT doc_id, quality, toxic, n_chars <= 900 AS fits, row_number() OVER (PARTITION BY quality, toxic ORDER BY sha256('5/' || doc_id), doc_id) AS nth FROM labels JOIN documents USING (doc_id)),
g AS (SELECT *, sum(fits::INT) OVER (PARTITION BY quality, toxic ORDER BY nth) AS good, dense_rank() OVER (ORDER BY quality, toxic) - 1 AS spot FROM r)
SELECT doc_id, quality, toxic, ((good - 1) * (SELECT max(spot) + 1 FROM g) + spot)::INTEGER AS place FROM g WHERE fits AND good <= 16 // (SELECT max(spot) + 1 FROM g)""")
def refilled_subset(spark, sf_dir):
    """Documents that are too long are passed over."""
    sizes = table(spark, sf_dir, "documents", "doc_id", (F.col("n_chars") <= 900).alias("fits"))
    rows = table(spark, sf_dir, "labels", "doc_id", "quality", "toxic").join(sizes.select("doc_id"), "doc_id", "left_semi")
    chosen, _ = B.refilled(rows, ["quality", "toxic"], 16, 5, lambda head: sizes.join(head.select("doc_id"), "doc_id", "left_semi"), "doc_id")
    return chosen.withColumn("place", F.col("place").cast("int"))


@query("""WITH x AS (SELECT l_linenumber, unnest([
    {'task': 'a', 'x': l_discount * 30 - 1.5, 't': (l_returnflag = 'R')::INT::DOUBLE, 'on_': l_orderkey % 3 <> 0}, {'task': 'b', 'x': l_tax * 50 - 2, 't': l_discount * 10, 'on_': l_linenumber <= 4},
    {'task': 'remaining_turns', 'x': l_tax * 40, 't': (l_partkey % 30)::DOUBLE, 'on_': l_quantity > 10}]) AS i FROM lineitem),
each AS (SELECT l_linenumber, i.task AS task, count(*) FILTER (WHERE i.on_) AS active,
  avg(CASE WHEN i.task = 'remaining_turns' THEN CASE WHEN abs(i.x - ln(1 + i.t)) < 1 THEN 0.5 * (i.x - ln(1 + i.t)) ** 2 ELSE abs(i.x - ln(1 + i.t)) - 0.5 END ELSE greatest(i.x, 0) - i.x * i.t + ln(1 + exp(-abs(i.x))) END) FILTER (WHERE i.on_) AS loss FROM x GROUP BY ALL)
SELECT l_linenumber, round(sum(loss * w) / sum(w) FILTER (WHERE active > 0), 6) AS total, round(max(loss) FILTER (WHERE task = 'b'), 6) AS b, sum(active)::BIGINT AS active FROM (SELECT *, CASE task WHEN 'a' THEN 2 ELSE 1 END AS w FROM each) GROUP BY l_linenumber""")
def multitask_loss(spark, sf_dir):
    arrays = {
        "logits": F.expr("array(l_discount * 30 - 1.5, l_tax * 50 - 2)"), "targets": F.expr("array(double(l_returnflag = 'R'), l_discount * 10)"), "mask": F.expr("array(l_orderkey % 3 <> 0, l_linenumber <= 4)"),
        "p": F.expr("l_tax * 40"), "turns": F.expr("double(l_partkey % 30)"), "on": F.expr("l_quantity > 10"),
    }
    rows = table(spark, sf_dir, "lineitem", "l_linenumber", *[c.alias(k) for k, c in arrays.items()])
    found = M.multitask_losses(rows, ["l_linenumber"], ["a", "b"], "logits", "targets", "mask", ("p", "turns", "on"), {"a": 2.0, "b": 1.0, M.REMAINING: 1.0})
    total = F.aggregate(F.map_values("active"), F.lit(0).cast("long"), lambda s, x: s + x)
    return found.select("l_linenumber", F.round("total", 6).alias("total"), F.round(F.try_element_at("losses", F.lit("b")), 6).alias("b"), total.alias("active"))
