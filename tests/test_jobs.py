import json

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quarry import catalog_sources, schemas
from quarry.plans import release, sft, windows
from quarry.sources import blobs, traces
from quarry.streaming import ingest

def call(name, ident="k1", **arguments):
    return {"id": ident, "type": "function", "function": {"name": name, "arguments": json.dumps(arguments)}}


def chat(spark, *messages):
    df = spark.createDataFrame([(json.dumps(messages),)], "x string").withColumn("i", traces.items_of(F.col("x")))
    read, fault = traces.chat(F.col("i"))
    return df.select(read.alias("m"), fault.alias("fault")).first()


def test_chat_pairs_answers_with_calls(spark):
    r = chat(
        spark, {"role": "User", "content": "How long is the river?"}, {"role": "ai", "content": " Let me measure. ", "tool_calls": [call("measure", river="Oder", exact=None)]},
        {"role": "function", "content": "840 km"}, {"role": "assistant", "content": "  <think>a\nb</think> 840 km long.", "mask": False},
    )
    assert r.fault is None and [x.role for x in r.m] == ["user", "assistant", "tool", "assistant"]
    assert r.m[1].content == "" and r.m[1].reasoning == "Let me measure."
    assert json.loads(r.m[1].action) == [{"id": "k1", "type": "function", "function": {"name": "measure", "arguments": {"river": "Oder", "exact": None}}}]
    assert r.m[2].tool_call_id == "k1" and json.loads(r.m[2].metadata) == {"source_role": "function", "think": None, "tool_pairing": "inferred_single_pending_call_v1"}
    assert (r.m[3].content, r.m[3].reasoning, r.m[3].loss_mask) == ("840 km long.", "a\nb", False) and json.loads(r.m[3].metadata)["tool_pairing"] is None


def test_chat_guesses_only_a_single_open_call(spark):
    two = {"role": "assistant", "tool_calls": [call("f", "p"), call("f", "q")]}
    ids = lambda *m: [x.tool_call_id for x in chat(spark, *m).m]
    assert ids(two, {"role": "tool", "content": "?"}) == [None, None]
    assert ids(two, {"role": "tool", "tool_call_id": "p"}, {"role": "tool"}, {"role": "tool"}) == [None, "p", "q", None]
    assert ids(two, {"role": "assistant", "content": "never mind"}, {"role": "tool"}) == [None, None, None]
    assert ids({"role": "assistant", "tool_calls": call("f", "solo")}, {"role": "user"}, {"role": "tool"}) == [None, None, "solo"]


@pytest.mark.parametrize("bad, fault", [({"function": {"name": "f", "arguments": "{1"}}, "not valid JSON"), ({"function": {"name": "f", "arguments": "[1]"}}, "no object"), ({"id": "x"}, "no function")])
def test_chat_faults(spark, bad, fault):
    assert fault in chat(spark, {"role": "assistant", "tool_calls": [call("g"), bad]}).fault


def test_messages_that_are_none(spark):
    df = spark.createDataFrame([("[]",), (None,), ("null",), ("[1]",), ("{}",), ("oops",)], "x string").select(traces.items_of(F.col("x")).isNull().alias("n"))
    assert [r.n for r in df.collect()] == [False, False, False, True, True, True]


def _openthoughts(spark):
    answer = '<think>which tests?</think>Now: {"commands":[{"keystrokes":"make test"}],"task_complete":false} .'
    talk = [("user", "Mend the build"), ("assistant", answer), ("user", "2 failures"), ("assistant", "It is mended.")]
    rows = [(f"night{i}", "first", "e7", f"build-{i}", "terminus-2", "m", "passed", "d", "p", "s", [{"role": r, "content": c} for r, c in talk]) for i in range(3)]
    ddl = "run_id string, trial_name string, episode string, task string, agent string, model string, result string, date string, model_provider string, trace_source string, conversations array<struct<role:string,content:string>>"
    return spark.createDataFrame(rows, ddl)


def test_adapter_of_terminal_traces(spark):
    rows = traces.openthoughts_agent(_openthoughts(spark)).collect()
    assert len(rows) == 3 and all(r.error is None and r.success is True and r.task_text == "Mend the build" for r in rows)
    m = rows[0].messages
    assert json.loads(m[1].action) == {"format": "terminus_json", "payload": {"commands": [{"keystrokes": "make test"}], "task_complete": False}}
    assert (m[1].reasoning, m[1].content, m[3].content, m[3].action) == ("which tests?", "", "It is mended.", None)


def test_adapter_of_fenced_traces(spark):
    ddl = "instance_id string, model_name string, target boolean, exit_status string, generated_patch string, eval_logs string, trajectory array<struct<role:string,text:string,system_prompt:string,mask:boolean>>"
    df = spark.createDataFrame([("big__fix-12", "m", False, "gave up", "p", "", [("system", None, "help well", None), ("ai", "Count lines.\n```sh\nwc -l a.txt\n```\nthen stop", None, True)])], ddl)
    r = traces.nebius_swe_agent(df).first()
    assert (r.messages[1].reasoning, json.loads(r.messages[1].action)["content"], r.messages[1].loss_mask) == ("Count lines.\n\nthen stop", "wc -l a.txt", True)
    assert r.failure_type == "gave up" and r.messages[0].content == "help well"


def test_adapters_of_chat_traces(spark):
    kind = "array<struct<role:string,content:string,tool_calls:array<struct<id:string,function:struct<name:string,arguments:string>>>>>"
    talk = [("user", "Sort it", None), ("assistant", None, [("c", ("sort", '{"by": 1.0}'))])]
    broken = [("assistant", None, [("c", ("sort", "{by"))])]
    df = spark.createDataFrame([("t1", "i", "o/r", 1, "ok", talk), ("t2", "i", "o/r", 0, "late", broken)], f"trajectory_id string, instance_id string, repo string, resolved int, exit_status string, trajectory {kind}")
    good, bad = traces.nebius_openhands(df).orderBy("source_record_id").collect()
    assert good.error is None and good.success is True and good.messages[1].action == '[{"function":{"arguments":{"by":1.0},"name":"sort"},"id":"c"}]'
    assert bad.messages is None and "not valid JSON" in bad.error and bad.failure_type == "late"
    rows = [("i9", "t9", "o/r", "MIT", 1, ['{"type":"function"}', "not json"], talk, "data/codex/minimax_m25/a.parquet")]
    df = spark.createDataFrame(rows, f"instance_id string, trajectory_id string, repo string, license string, resolved int, tools array<string>, messages {kind}, source_file string")
    r = traces.open_swe_traces(df).first()
    assert (r.harness, r.teacher_model, r.repo, json.loads(r.metadata)["repo_license"], json.loads(r.tools)[0]) == ("codex", "MiniMax-M2.5", "o/r", "MIT", {"type": "function"})
    meta = {"instance_id": "o__r-5", "source": "oh-x", "sample_idx": 2, "model": "big", "repo": "o/r", "verify_status": "unresolved"}
    df = spark.createDataFrame([(json.dumps(meta), '[{"a":1}]', talk)], f"metadata string, tools string, messages {kind}")
    r = traces.orchard_swe(df).first()
    assert (r.task_id, r.harness, r.success, r.failure_type) == ("o__r-5", "openhands", False, "unresolved") and r.source_record_id.startswith("o__r-5/oh-x/2/")
    with pytest.raises(ValueError):
        traces.adapter("nothing")


def test_scan_and_inventory(spark, tmp_path):
    root = str(tmp_path / "pool")
    spark.range(10).coalesce(1).write.parquet(f"{root}/data/a/x")
    spark.range(5).coalesce(1).write.parquet(f"{root}/other")
    rows = traces.scan(spark, root, ["data/*.parquet"])
    assert rows.count() == 10 and rows.agg(F.max("row_index")).first()[0] == 9
    found = traces.inventory(spark, root, ["*.parquet"])
    assert found.count() == 2 and traces.inventory_faults(found, found).count() == 0
    pieces = traces.inventory(spark, root, ["*.parquet"], whole_bytes=100)  # larger files are read in pieces
    assert sorted(map(tuple, pieces.collect())) == sorted(map(tuple, found.collect()))
    assert [r.fault for r in traces.inventory_faults(found, found.withColumn("sha256", F.lit("x"))).collect()] == ["hash", "hash"]


def test_release(spark, tmp_path):
    episodes = traces.openthoughts_agent(_openthoughts(spark)).drop("error")
    splits = episodes.select("source_record_id", F.lit("train").alias("split"))
    folder = str(tmp_path / "release")
    release.build(episodes, splits, folder)
    assert release.verify(spark, folder) == []
    decisions = spark.read.schema(schemas.DECISIONS).parquet(f"{folder}/decisions").orderBy("episode_id", "turn_id").collect()
    assert len(decisions) == 6 and decisions[0].current_observation == "Mend the build" and decisions[0].next_tool_result == "2 failures"
    assert decisions[0].decision_type == ["verification"] and decisions[1].decision_type == ["mechanical_action"] and decisions[0].prefix_messages_ref.endswith("=0:1")
    with pytest.raises(FileExistsError):
        release.build(episodes, splits, folder)


def vocabulary():
    lines = [f"{b + 1} {bytes([b])!r} 1" for b in range(256)]
    return [*lines, "300 'to' 2", "301 'tort' 4", "302 '東京' 6", "303 '\\n\\nUser' 6"]


def test_vocabulary():
    v = windows.Vocabulary(vocabulary())
    assert v.encode("tortot東京".encode()) == [301, 112, 117, 302] and v.decode([301, 112, 302]).decode() == "torto東京"
    for bad in (vocabulary()[1:], [*vocabulary(), "304 'to' 2"], [*vocabulary(), "304 'abc' 2"]):
        with pytest.raises(ValueError):
            windows.Vocabulary(bad)


EPISODES = f"episode_id string, source_dataset string, source_record_id string, split string, split_group string, teacher_model string, success boolean, task_text string, tools string, messages array<{schemas.MESSAGE}>"


def message(role, content="", **more):
    return {"role": role, "content": content, "reasoning": "", "action": None, "tool_call_id": None, "loss_mask": None, "metadata": "{}"} | more


def long_talk(rounds, seed=0):
    talk = [message("system", "Be brief."), message("user", "tort of the river")]
    for i in range(rounds):
        talk += [message("assistant", action=f'[{{"id":"k{i}"}}]', reasoning=f"step {i}"), message("tool", "width and depth " * (1 + (i * 7 + seed) % 11), tool_call_id=f"k{i}")]
        if i % 4 == 2:
            talk.append(message("user", f"go on {i}"))
    return [*talk, message("assistant", "As deep as wide.")]


def brute_force_window(v, messages, task, target, most):
    """(ids, weights, dropped messages) with the fewest groups left out that fits, tried one by one."""
    roles = [m["role"] for m in messages[:target]]
    groups, now = [], []
    for i, r in enumerate(roles):
        if r == "assistant" and now:
            groups, now = [*groups, now], []
        now.append(i)
    groups += [now] if now else []
    users = [i for i, r in enumerate(roles) if r == "user"]
    last = max([i for i, r in enumerate(roles) if r == "assistant"], default=0)
    safe = {i for i, r in enumerate(roles) if r == "system"} | set(users[:1] + users[-1:]) | set(range(last, target))
    loose = [g for g in groups if not safe & set(g)]
    for k in range(len(loose) + 1):
        gone = {i for g in loose[:k] for i in g}
        text, weight = b"", []

        def add(x, w):
            nonlocal text
            text += x.encode()
            weight.extend([w] * len(x.encode()))

        kept = [(i, m) for i, m in enumerate(messages[: target + 1]) if i not in gone]
        if not any(task in m["content"] for _, m in kept if m["role"] in ("system", "user")):
            add(f"User: Task contract:\n{task}\n\n", 0)
        for i, m in kept:
            if m["role"] == "assistant":
                on = int(i == target)
                add("Assistant: ", 0)
                parts = [(f"<think>\n{m['reasoning']}\n</think>", on)] * bool(m["reasoning"]) + [(m["content"], on)] * bool(m["content"]) + [(f"<tool_call>{m['action']}</tool_call>", 2 * on)] * bool(m["action"])
                for j, (x, w) in enumerate(parts):
                    if j:
                        add("\n", w)
                    add(x, w)
                add("\n\n", on)
            elif m["role"] == "tool":
                add("User: <tool_response>" + json.dumps({"content": m["content"], "tool_call_id": m["tool_call_id"]}, separators=(",", ":")) + "</tool_response>\n\n", 0)
            else:
                add({"system": "System", "user": "User"}[m["role"]] + f": {m['content']}\n\n", 0)
        ids = v.encode(text)
        if len(ids) + 1 <= most:
            weights, at = [0], 0
            for i in ids:
                n = len(v.tokens[i])
                weights.append(weight[at] if len(set(weight[at : at + n])) == 1 else 0)
                at += n
            return [0, *ids, 0], [*weights, 1], len(gone)
    return None


@pytest.mark.parametrize("most", [10_000, 1500, 700, 420, 60])
def test_windows_by_brute_force(spark, most):
    v = windows.Vocabulary(vocabulary())
    talks = {f"{i:064d}": long_talk(9, i) for i in range(3)}
    rows = [(e, "d", e, "train", "task:x", "t", True, "tort of the river", None, t) for e, t in talks.items()]
    found = {(r.episode_id, r.message_index): r for r in windows.token_records(spark.createDataFrame(rows, EPISODES), vocabulary(), most).collect()}
    assert len(found) == 30
    for (e, at), r in found.items():
        expected = brute_force_window(v, talks[e], "tort of the river", at, most)
        if expected is None:
            assert r.excluded == f"protected_context_overflow_{most}" and r.token_ids == []
        else:
            assert r.excluded is None and (r.token_ids, r.token_loss_weights, r.dropped_messages) == expected


def test_records_and_their_rules(spark):
    rows = [(c * 64, "d", "r", "train", "task:x", "t", ok, "another task", None, long_talk(3)) for c, ok in (("e", True), ("f", False))]
    records = windows.token_records(spark.createDataFrame(rows, EPISODES), vocabulary(), 10_000).cache()
    kept = records.where("excluded is null")
    assert kept.count() == 4 and records.where("excluded like 'source_failure%'").count() == 4
    first = kept.orderBy("message_index").first()
    assert bytes(i - 1 for i in first.token_ids[1:20] if i < 257).startswith(b"User: Task contract") and first.dropped_messages == 0
    assert windows.record_violations(kept, 10_000).where("size(violations) > 0").count() == 0
    broken = {"teacher": ("teacher", F.lit("")), "success": ("source_success", F.lit(False)), "counters": ("message_index", F.lit(-1)), "digest": ("dropped_messages", F.lit(5))}
    for rule, (column, value) in broken.items():
        assert windows.record_violations(kept.withColumn(column, value), 10_000).where(~F.array_contains("violations", rule)).count() == 0


def test_ingest(spark, tmp_path):
    land, store = tmp_path / "land", str(tmp_path / "store")
    land.mkdir()
    (land / "a.json").write_text('{"b": 1, "a": 2}\n{"a":2,"b":1}\nnot json\n')
    ingest.ingest(ingest.landing(spark, str(land)), store, str(tmp_path / "c1")).awaitTermination()
    assert blobs.read(spark, store).count() == 1
    (land / "b.json").write_text('{"a": 3}\n{"a":2,"b":1}\n')
    ingest.ingest(ingest.landing(spark, str(land)), store, str(tmp_path / "c1")).awaitTermination()
    assert blobs.read(spark, store).count() == 2
    refs = blobs.read(spark, store).select(F.concat(F.lit("sha256:"), "digest").alias("ref"))
    assert blobs.get(refs, store).where("intact").count() == 2


def test_a_release_of_conversations_runs_its_adapter_once(spark, sf, monkeypatch):
    """The episodes and splits that a release joins are read from files; their join would run the adapter's Python once for each id it reads."""
    joined = []
    monkeypatch.setattr(catalog_sources.release, "build", lambda episodes, splits, folder: joined.append(episodes.join(splits, "source_record_id")))
    catalog_sources._released(spark, sf)
    assert "EvalPython" not in joined[0]._jdf.queryExecution().executedPlan().toString() and joined[0].count() > 0


def test_row_groups_of_token_records_are_bounded(spark, tmp_path):
    """The reader takes up to 4,096 rows of a row group at once: records of a long episode lie in several."""
    said = "the river Oder rises " * 60
    talk = [("assistant" if i % 2 else "user", f"{i} {said}") for i in range(120)]
    kind = "array<struct<role:string,content:string>>"
    rows = spark.createDataFrame([("t1", "o__r-1", "o/r", 1, "ok", talk)], f"trajectory_id string, instance_id string, repo string, resolved int, exit_status string, trajectory {kind}")
    episodes = traces.nebius_openhands(rows).drop("error")
    release.build(episodes, episodes.select("source_record_id", F.lit("train").alias("split")), str(tmp_path / "release"))
    made = sft.build(spark, str(tmp_path / "release"), str(tmp_path / "inputs"), [f"{b + 1} {bytes([b])!r} 1" for b in range(256)], 1 << 20)
    assert made["accepted"] == {"train": 60}
    groups = [
        f.metadata.row_group(i).column(j).num_values
        for f in map(pq.ParquetFile, tmp_path.glob("inputs/records/*/*.parquet")) for i in range(f.metadata.num_row_groups) for j in range(f.metadata.num_columns)
        if f.metadata.row_group(i).column(j).path_in_schema.startswith("token_ids")
    ]
    assert sum(groups) == made["tokens"]["train"]["input"]["total"] + 60 > 4_000_000 and max(groups) < 2_000_000
