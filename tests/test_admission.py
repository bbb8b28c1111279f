"""Admission, inputs, policies and the contamination index, over a small source of chat traces."""

import json
import random

import pytest
from pyspark.sql import functions as F
from test_jobs import call, vocabulary

from quarry import schemas
from quarry.functions import identity as I
from quarry.operators import audit, interactions, reconcile, selection, subsets
from quarry.plans import admission, index, policy, release, sft
from quarry.scratch import numbered
from quarry.sources import catalogue, traces


@pytest.mark.parametrize("seed", range(6))
def test_greedy_admission_by_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [
        (rng.randrange(40), f"c{i:03d}", f"t{rng.randrange(60)}", f"d{rng.randrange(60)}" if rng.random() < 0.5 else f"t{rng.randrange(60)}", f"x{rng.randrange(70)}", rng.choice(["train", "dev", "none", None]), rng.choice(["p", "q", None]), rng.choice([[], [], [], ["bad"]]))
        for i in range(120)
    ]
    splits, teachers = {"train": 12, "dev": 7, "test": 2}, {"train": 7, "dev": 3}
    ddl = "place int, candidate string, task_id string, task_digest string, content_digest string, split string, teacher string, findings array<string>"
    found = {r.candidate: (r.accepted, r.reasons) for r in selection.greedy_admission(spark.createDataFrame(rows, ddl), splits, teachers).collect()}
    tasks, contents, of_split, of_teacher = set(), set(), {}, {}
    for _, name, task, digest, content, split, teacher, reasons in sorted(rows, key=lambda r: r[:2]):
        why = list(reasons)
        why += [selection.DUPLICATE_TASK] * bool({task, digest} & tasks) + [selection.DUPLICATE_CONTENT] * (content in contents)
        why += [selection.SPLIT_FULL] * (of_split.get(split, 0) >= splits.get(split, 0)) + [selection.TEACHER_FULL] * (of_teacher.get((split, teacher), 0) >= teachers.get(split, 0))
        if not why:
            tasks |= {task, digest}
            contents.add(content)
            of_split[split] = of_split.get(split, 0) + 1
            of_teacher[split, teacher] = of_teacher.get((split, teacher), 0) + 1
        assert found[name] == (not why, why), name


def test_admission_of_nothing(spark):
    ddl = "place int, candidate string, task_id string, task_digest string, content_digest string, split string, teacher string, findings array<string>"
    assert selection.greedy_admission(spark.createDataFrame([], ddl), {"train": 1}, {"train": 1}).count() == 0


def test_greedy_admission_in_short_stretches(spark, monkeypatch):
    monkeypatch.setattr(selection, "STRETCH", 20)
    test_greedy_admission_by_brute_force(spark, 1)


def test_greedy_admission_compares_no_row_behind_the_last_quota(spark, monkeypatch):
    compared, first_of_all = [], selection.first_of_all
    monkeypatch.setattr(selection, "STRETCH", 64, raising=False)
    monkeypatch.setattr(selection, "first_of_all", lambda rows: compared.append(rows.count()) or first_of_all(rows))
    names = [f"cast(id as string) as {c}" for c in ("candidate", "task_id", "task_digest", "content_digest")]
    rows = spark.range(3000).selectExpr("id as place", *names, "'train' as split", "if(id % 2 = 0, 'p', 'q') as teacher", "cast(array() as array<string>) as findings")
    took = selection.greedy_admission(rows, {"train": 5}, {"train": 3}).where("accepted")
    assert sorted(int(r.candidate) for r in took.collect()) == [0, 1, 2, 3, 4] and sum(compared) < 200


def test_numbered_ties_and_parts(spark):
    rows = spark.createDataFrame([(i % 7, i) for i in range(100)], "a int, b int")
    found, n = numbered(rows, ["a", "b"])
    assert n == 100 and [(r.a, r.b) for r in found.orderBy("row_no").collect()] == sorted((i % 7, i) for i in range(100)) and found.select("row_no").distinct().count() == 100


READ = {"type": "function", "function": {"name": "read", "parameters": {"type": "object", "properties": {"path": {"type": "string", "minLength": 1}, "lines": {"type": "array", "items": {"$ref": "#/$defs/line"}}}, "required": ["path"], "additionalProperties": False, "$defs": {"line": {"type": "integer", "minimum": 1}}}}}


def violation(spark, tools, messages):
    rows = [("e", json.dumps(tools), [(m.get("role"), None if "action" not in m else json.dumps(m["action"]), m.get("tool_call_id")) for m in messages])]
    df = spark.createDataFrame(rows, "episode_id string, tools string, messages array<struct<role:string,action:string,tool_call_id:string>>")
    found = interactions.first_violations(df).collect()
    return found[0].violation if found else None


def acts(*calls):
    return {"role": "assistant", "action": [c | {"function": c["function"] | {"arguments": json.loads(c["function"]["arguments"])}} for c in calls]}


def answer(ident):
    return {"role": "tool", "tool_call_id": ident}


USER, TALK = {"role": "user"}, {"role": "assistant"}
CASES = [
    ([READ], [USER, acts(call("read", path="a")), answer("k1"), TALK], None),
    ([READ], [USER, acts(call("read", "p", path="a"), call("read", "q", path="b", lines=[1, 2])), answer("q"), {"role": "system"}, answer("p")], None),
    ([READ], [USER, acts(call("read", path="a"))], "missing_tool_response"),
    ([READ], [acts(call("read", path="a")), USER, answer("k1")], "missing_tool_response"),
    ([READ], [acts(call("read", path="a")), TALK, answer("k1")], "missing_tool_response"),
    ([READ], [acts(call("read", path="a")), answer("k1"), answer("k1")], "orphan_tool_response"),
    ([READ], [answer("k1"), acts(call("read", path="a")), answer("k1")], "orphan_tool_response"),
    ([READ], [acts(call("read", path="a")), {"role": "tool"}], "orphan_tool_response"),
    ([READ], [acts(call("read", path="a")), answer("k1"), acts(call("read", path="b")), answer("k1")], "invalid_tool_call_id"),
    ([READ], [acts(call("write", path="a"))], "unknown_tool_or_arguments"),
    ([READ], [acts(call("read", path=""))], "invalid_tool_arguments"),
    ([READ], [acts(call("read", path="a", lines=[0]))], "invalid_tool_arguments"),
    ([READ], [acts(call("read", path="a", other=1))], "invalid_tool_arguments"),
    ([READ], [{"role": "assistant", "action": [{"id": "x"}]}], "invalid_tool_arguments"),
    ([READ], [{"role": "assistant", "action": {"format": "y"}}], "unsupported_action_grammar"),
    ([READ], [{"role": "robot"}], "unknown_role"),
    ([READ], [USER, TALK], "no_tool_actions"),
    ([], [USER], "missing_tool_schema"),
    ({}, [USER], "missing_tool_schema"),
    ([READ, READ], [USER], "invalid_tool_schema"),
    ([READ, {"function": {"name": "x", "parameters": {"type": "object", "required": "path"}}}], [USER], "invalid_tool_schema"),
    ([{"function": {"name": "x", "parameters": {"type": "object", "properties": {"a": {"$ref": "other.json"}}}}}, {}], [USER], "external_tool_schema_reference"),
    ([READ, {"function": {"name": "finish", "parameters": {"type": "object"}}}], [USER, acts(call("finish"))], None),
    ([READ, {"function": {"name": "finish", "parameters": {"type": "object"}}}], [acts(call("finish")), USER], "missing_tool_response"),
]


def test_first_violations(spark):
    rows = []
    for i, (tools, messages, _) in enumerate(CASES):
        rows.append((i, json.dumps(tools), [(m.get("role"), None if "action" not in m else json.dumps(m["action"]), m.get("tool_call_id")) for m in messages]))
    df = spark.createDataFrame(rows, "episode_id int, tools string, messages array<struct<role:string,action:string,tool_call_id:string>>")
    found = {r.episode_id: r.violation for r in interactions.first_violations(df).collect()}
    assert [found.get(i) for i in range(len(CASES))] == [c[2] for c in CASES]


@pytest.mark.parametrize(
    "schema, good, bad",
    [
        ({"type": ["integer", "null"]}, [1, 2.0, None], [1.5, True, "1"]),
        ({"enum": [1, {"a": 2}]}, [1, {"a": 2}], [2, {"a": 3}, True]),
        ({"anyOf": [{"type": "string", "pattern": "^a"}, {"type": "number", "maximum": 3}]}, ["ab", 3], ["ba", 4, None]),
        ({"oneOf": [{"minimum": 2}, {"maximum": 5}]}, [1, 6], [3]),
        ({"type": "object", "properties": {"next": {"$ref": "#"}}, "additionalProperties": {"type": "boolean"}}, [{"next": {"x": True}}], [{"next": {"x": 1}}]),
        ({"not": {"type": "array", "minItems": 2}}, [[1], "x"], [[1, 2]]),
    ],
)
def test_schemas(schema, good, bad):
    assert all(interactions.accepts(schema, x) for x in good) and not any(interactions.accepts(schema, x) for x in bad) and interactions.well_formed(schema)


RAW = "trajectory_id string, instance_id string, repo string, resolved int, exit_status string, trajectory string, tools array<string>, license string, messages string"


@pytest.fixture(scope="module")
def pool(spark, tmp_path_factory):
    """Raw rows of 40 traces in four files, with their tasks, vocabulary and policy."""
    root = str(tmp_path_factory.mktemp("pool"))
    rows = []
    for i in range(40):
        talk = [{"role": "user", "content": f"Task {i // 2 if i % 8 == 0 else i} about {'the same old thing ' * 4 if i in (3, 4) else f'thing {i} ' * 5}"}]
        for j in range(4 + i % 3):
            talk += [{"role": "assistant", "content": f"look {j}", "tool_calls": [call("read", f"k{j}", path=f"f{i}_{j}")]}, {"role": "tool", "tool_call_id": f"k{j}", "content": "line " * (10 + 5 * j)}]
        talk.append({"role": "assistant", "content": "mail mia.f@shipyard.dev" if i == 7 else "Done."})
        rows.append((f"t{i}", f"org__r{i % 12}-{i}", f"org/r{i % 12}", -1 if i == 9 else i % 2, "x", None, [json.dumps(READ)], "GPL-3.0" if i == 11 else "MIT", "oops" if i == 13 else json.dumps(talk)))
    for part in range(4):
        spark.createDataFrame(rows[part::4], RAW).drop("trajectory").coalesce(1).write.parquet(f"{root}/data/codex/{('minimax_m25', 'qwen35_122b')[part % 2]}/p{part}")
    return root


QUOTAS = {"train": 8, "dev": 2, "test": 2}
CONFIG = {"version": 1, "release_id": "r-1", "source_id": "s", "seed": 5, "quotas": QUOTAS, "teachers": ["MiniMax-M2.5", "Qwen3.5-122B"], "decisions_per_episode": 3, "maximum_scan": 39, "max_tokens": 2000}
SHA = "a" * 40


def frozen(spark, pool, folder, ranges):
    rows = catalogue.identity_scan(spark, pool, ["data/*"], "open_swe_traces").select(F.lit("s").alias("source_id"), "identity")
    policy.freeze(rows, folder, "pepper", ranges, 100, {"s": SHA}, "2020-01-01")
    return policy.load(spark, folder)


@pytest.fixture(scope="module")
def built(spark, pool, tmp_path_factory):
    """(folder, policy, accepted, judged, tasks, episodes) of an admission over the pool."""
    top = str(tmp_path_factory.mktemp("admitted"))
    held = frozen(spark, pool, f"{top}/policy", {"train": [0, 59], "dev": [60, 79], "test": [80, 99]})
    rows = traces.scan(spark, pool, ["data/*"])
    episodes = traces.open_swe_traces(rows).withColumns({"source_revision": F.lit(SHA), "source_license": F.lit("cc-by-4.0")})
    tasks = spark.createDataFrame([(f"org__r{i % 12}-{i}", f"org/r{i % 12}", f"{i:040x}", "MIT", "image") for i in range(40) if i != 5], "instance_id string, repo string, base_commit string, license string, image_name string")
    config = CONFIG | {"quotas": {"train": 200, "dev": 200, "test": 200}}
    accepted, judged = admission.admit(episodes, tasks, held, None, vocabulary(), config)
    return top, held, accepted.cache(), judged.cache(), tasks, episodes, config


def test_admission(spark, built):
    _, _, accepted, judged, _, episodes, _ = built
    reasons = {r.record_sha256: r.reasons for r in judged.collect()}
    names = {r.record_sha256: r.source_record_id for r in episodes.select("record_sha256", "source_record_id").collect()}
    of = {names[k]: v for k, v in reasons.items()}
    assert len(of) == 39 and of.get("t13", [admission.UNREADABLE]) == [admission.UNREADABLE]
    expected = {"t7": "email", "t9": admission.OUTCOME_UNKNOWN, "t11": "unverified_repo_license", "t5": "task_join_missing"}
    for name, why in expected.items():
        assert name not in of or why in of[name], name
    rows = accepted.collect()
    assert len(rows) + sum(bool(v) for v in of.values()) == 39 and len(rows) > 20, sorted(of.items())
    for r in rows:
        assert len(r.message_indices) == len(r.window_tokens) == 3 and r.message_indices[0] == 1 and all(i % 2 for i in r.message_indices) and len(r.base_commit) == 40


def test_release_and_inputs(spark, built, tmp_path):
    top, held, accepted, judged, tasks, episodes, config = built
    provenance = {"heldout_sha256": held.sha256}
    report = admission.write(spark, f"{top}/admission", accepted, judged, config, provenance)
    assert report["status"] == "insufficient_eligible_data" and report["statistics"]["accepted"] == accepted.count()
    files = episodes.select(F.col("source_file").alias("path")).distinct()
    with pytest.raises(ValueError, match="not passed"):
        admission.load(spark, f"{top}/admission", config, provenance, files)
    exact = config | {"quotas": report["statistics"]["splits"]}
    admission.write(spark, f"{top}/again", accepted, judged, exact, provenance)
    _, loaded = admission.load(spark, f"{top}/again", exact, provenance, files)
    assert loaded.count() == accepted.count()
    for change, message in ((({"heldout_sha256": "x"}, files), "heldout"), ((provenance, files.limit(1)), "outside")):
        with pytest.raises(ValueError, match=message):
            admission.load(spark, f"{top}/again", exact, *change)
    quarantine = [json.loads(r.value) for r in spark.read.text(f"{top}/again/quarantine").collect()]
    assert len(quarantine) == judged.where("quarantined").count() and all(q["reasons"] for q in quarantine)

    folder = f"{top}/release"
    manifest = admission.build_release(episodes, loaded, folder, provenance)
    assert release.verify(spark, folder) == [] and manifest["provenance"]["heldout_sha256"] == held.sha256 and manifest["splits"] == exact["quotas"]
    assert spark.read.parquet(f"{folder}/decisions").count() == 3 * loaded.count()
    ids = [r.value for r in spark.read.text(f"{folder}/lists/train").collect()]
    assert ids == sorted(ids) and len(ids) == exact["quotas"]["train"]

    inputs = f"{top}/inputs"
    made = sft.build(spark, folder, inputs, vocabulary(), 900)
    assert sum(made["accepted"].values()) + sum(made["excluded"].values()) == 3 * loaded.count()
    assert sum(made["excluded"].values()) >= 3 * loaded.where("not success").count() > 0
    with pytest.raises(Exception, match="verification"):
        sft.load_split(spark, inputs, "train")
    sft.verify(spark, folder, inputs)
    assert sft.load_split(spark, inputs, "train").count() == made["accepted"]["train"]
    with pytest.raises(ValueError, match="no split"):
        sft.load_split(spark, inputs, "all")

    records = spark.read.parquet(f"{inputs}/records")
    one = records.select("decision_id").first().decision_id
    broken = {
        "differs: teacher": records.withColumn("teacher", F.when(F.col("decision_id") == one, "nobody").otherwise(F.col("teacher"))), "missing_decision": records.where(F.col("decision_id") != one),
        "repeated_decision": records.unionByName(records.where(F.col("decision_id") == one)), "digest": records.withColumn("dropped_messages", F.lit(9)),
        "episode_id_in_two_splits": records.withColumn("split", F.when(F.col("decision_id") == one, "dev").otherwise(F.lit("train"))),
    }
    for fault, rows in broken.items():
        bad = str(tmp_path / fault.split(":")[0])
        rows.write.partitionBy("split").parquet(f"{bad}/records")
        spark.read.text(f"{inputs}/excluded").write.text(f"{bad}/excluded")
        spark.read.text(f"{inputs}/manifest.json").coalesce(1).write.text(f"{bad}/manifest.json")
        assert fault in {r.fault for r in sft.faults(spark, folder, bad).select("fault").distinct().collect()}, fault


def test_admission_config():
    assert admission.check_config(CONFIG) == CONFIG
    for change in ({"seed": -1}, {"extra": 1}, {"quotas": {"train": 3, "dev": 2, "test": 2}}, {"release_id": "../x"}, {"teachers": []}, {"maximum_scan": True}):
        with pytest.raises(ValueError):
            admission.check_config(CONFIG | change)


def test_policy(spark, pool, tmp_path):
    held = frozen(spark, pool, str(tmp_path / "p"), {"train": [20, 99], "dev": [0, 9], "test": [10, 19]})
    held.verify_source("s", SHA)
    with pytest.raises(ValueError, match="freeze"):
        held.verify_source("s", "b" * 40)
    rows = spark.createDataFrame([(f"repo:org/r{i}",) for i in range(12)] + [(f"repo:new/{i}",) for i in range(40)], "identity string")
    found = held.with_splits(rows).collect()
    known = {r.identity for r in found if r.split_fault is None}
    assert {f"repo:org/r{i}" for i in range(12)} <= known and all(r.split_fault for r in found if r.split != "train" and r.identity.startswith("repo:new"))
    with pytest.raises(ValueError, match="identity"):
        policy.freeze(spark.createDataFrame([("s", None)], "source_id string, identity string"), str(tmp_path / "q"), "x", {}, 10, {}, "")
    assert policy.uncovered({"a": [0, 4], "b": [5, 9]}, 10) == [] and policy.uncovered({"a": [0, 4], "b": [4, 9]}, 10) and policy.uncovered({"a": [0, 3], "b": [5, 9]}, 10) and policy.uncovered({"a": [0, 8]}, 10)
    digest = I.group_digest(F.lit("repo:x/y"), "pepper")
    h = spark.range(1).select(digest.alias("h")).first().h
    m = {"bucket_count": 100, "ranges": {"dev": [0, 99], "test": [100, 199]}}
    lists = spark.createDataFrame([("dev", h), ("test", h), ("dev", "xyz"), ("test", "0" * 64)], "split string, group_sha256 string")
    assert {(r.split, r.fault) for r in policy.list_faults(lists, m).collect()} == {("dev", "both_splits"), ("test", "both_splits"), ("dev", "form"), ("test", "range")}


SCHEMA_CASES = [
    ({"exclusiveMinimum": 5}, [5.5, "x"], [5, 4]), ({"exclusiveMaximum": 5}, [4.9], [5.0]), ({"multipleOf": 0.1}, [0.3, 7, "x"], [0.35]), ({"multipleOf": 3}, [9, 9.0, -3, 0], [10]),
    ({"uniqueItems": True}, [[1, True, "1"], [], [{"a": 1}, {"a": 2}]], [[1, 1.0], [{"a": [1]}, {"a": [1.0]}]]), ({"prefixItems": [{"type": "string"}, {"const": 1}], "items": False}, [["a", 1], ["a"], []], [["a", 2], [1], ["a", 1, 2]]),
    ({"patternProperties": {"^n": {"type": "integer"}}, "additionalProperties": False}, [{"n1": 1}, {}], [{"n1": "x"}, {"m": 1}]), ({"contains": {"const": 2}}, [[1, 2], 3], [[], [1]]), ({"contains": {"const": 2}, "minContains": 0}, [[]], []),
    ({"if": {"type": "integer"}, "then": {"minimum": 3}, "else": {"maxLength": 1}}, [3, "a"], [2, "ab"]), ({"dependentRequired": {"a": ["b"]}}, [{"a": 1, "b": 1}, {}], [{"a": 1}]), ({"dependentSchemas": {"a": {"minProperties": 2}}}, [{"a": 1, "b": 2}], [{"a": 1}]),
    ({"propertyNames": {"pattern": "^[a-z]+$"}}, [{"ab": 1}], [{"A": 1}]), ({"enum": [1, True, [2.0]]}, [1.0, True, [2]], [False, 2]), ({"const": False}, [False], [0, None]), ({"not": {"anyOf": [{"type": "null"}, False]}}, [1], [None]),
]


def test_schema_keywords():
    for schema, good, bad in SCHEMA_CASES:
        assert interactions.well_formed(schema) and not interactions.unknown_keywords(schema)
        assert all(interactions.accepts(schema, x) for x in good) and not any(interactions.accepts(schema, x) for x in bad), schema
    for wrong in ({"minLength": -1}, {"minimum": "1"}, {"required": "a"}, {"prefixItems": {}}, {"uniqueItems": 1}, {"dependentRequired": {"a": "b"}}, {"pattern": "("}, {"multipleOf": 0}, {"properties": {"a": {"items": 3}}}, {"patternProperties": {"(": {}}}):
        assert not interactions.well_formed(wrong), wrong
    assert interactions.unknown_keywords({"title": "x", "items": {"unevaluatedItems": False}, "$defs": {"a": {"$dynamicRef": "#b", "x-own": 1}}}) == {"unevaluatedItems", "$dynamicRef"}


def test_contamination_index(spark, tmp_path):
    texts = {i: f"the river number {i} flows past a town with bridges and mills and {'boats ' * (i % 3 + 1)}" + " ".join(f"w{i}_{k}" for k in range(20)) for i in range(20)}
    tasks = spark.createDataFrame([(t, f"g{i}", "dev" if i % 4 == 0 else "train") for i, t in texts.items()], "folded string, group_sha256 string, split string")
    seen = spark.createDataFrame([("trace-a", "dev"), ("trace-b", "train")], "digest string, split string")
    folder = str(tmp_path / "index")
    index.build(tasks, seen, folder, "policy", [])
    opened = index.Index(spark, folder, "policy")
    assert opened.manifest["counts"]["tasks"] == 20
    with pytest.raises(ValueError, match="another"):
        index.Index(spark, folder, "other")
    rows = [(1, texts[4], "trace-x", "train"), (2, texts[4], "trace-a", "dev"), (3, texts[8] + " more", "trace-a", "train"), (4, texts[1], "trace-b", "train"), (5, "something else entirely about nothing at all", "trace-y", "train")]
    found = opened.findings(spark.createDataFrame(rows, "candidate int, folded string, trace string, split string"))
    assert {(r.candidate, r.finding) for r in found.collect()} == {(1, "cross_split_exact_task"), (3, "cross_split_near_task"), (3, "cross_split_exact_trace")}


def test_catalogue(spark, pool, tmp_path):
    found = catalogue.footers(spark, pool, ["data/*"]).collect()
    assert sum(r.n_rows for r in found) == 40 and len(found) == 4 and len({r.schema_sha256 for r in found}) == 1 and all(r.n_row_groups == 1 and r.bytes > 0 for r in found)
    assert catalogue.schema_histogram(catalogue.footers(spark, pool, ["data/*"])).first().files == 4
    rows = traces.scan(spark, pool, ["data/*"])
    assert catalogue.first_rows(rows).count() == 4 and catalogue.lookup(rows, "trajectory_id", "t4").first().instance_id == "org__r4-4"
    with pytest.raises(LookupError):
        catalogue.lookup(rows, "trajectory_id", "nobody")
    with pytest.raises(Exception, match="not unique"):
        catalogue.lookup(rows, "repo", "org/r1").collect()
    with pytest.raises(ValueError, match="lack"):
        catalogue.identity_scan(spark, pool, ["data/*"], "orchard_swe")
    (shape,) = catalogue.preview(rows)
    assert shape["type"] == "object" and shape["members"]["tools"]["type"] == "array"
    path = tmp_path / "sources.json"
    source = {"source_id": "s", "adapter": "open_swe_traces", "revision": SHA, "declared_license": "cc-by-4.0", "folder": "s", "patterns": ["data/*"]}
    path.write_text(json.dumps([source]))
    assert catalogue.load_sources(spark, str(path)).first().patterns == ["data/*"]
    for change in ({"adapter": "none"}, {"folder": "../x"}, {"patterns": []}, {"more": 1}):
        path.write_text(json.dumps([source | change]))
        with pytest.raises(ValueError):
            catalogue.load_sources(spark, str(path))


def test_identity_of_raw_rows(spark):
    talk = json.dumps([{"role": "system", "content": "x"}, {"role": "user", "text": " "}, {"role": "user", "content": "the task"}])
    rows = spark.createDataFrame([("Org/R", "org__r-1", talk, None), (None, "lone-1_copy2", "[]", None)], "repo string, instance_id string, trajectory string, metadata string")
    found = [(r.identity, r.task_text) for r in catalogue.identity_and_text(rows, "nebius_openhands").collect()]
    assert found == [("repo:org/r", "the task"), ("task:lone-1", "")]
    assert [r.i for r in rows.select(catalogue.identity("nebius_swe_agent", whole=False).alias("i")).collect()] == ["repo:org/r", "task:lone-1"]


def test_json_and_bytes(spark):
    df = spark.createDataFrame([('{"a":1,"b":{"c":2}}', '{"b":3}', bytearray(b"ok\xc3")), (None, '{"z":null}', bytearray("é".encode()))], "x string, y string, d binary")
    assert [json.loads(r.m) for r in df.select(catalogue.merged(F.col("x"), F.col("y")).alias("m")).collect()] == [{"a": 1, "b": 3}, {"z": None}]
    assert [(r.v.valid, r.v.text) for r in df.select(catalogue.valid_text(F.col("d")).alias("v")).collect()] == [(False, "ok�"), (True, "é")]


def test_subsets(spark):
    rows = spark.createDataFrame([(f"e{i}", i % 2 == 0, i % 3 == 0) for i in range(120)], "episode_id string, a boolean, b boolean")
    large = {r.episode_id: r.place for r in subsets.balanced(rows, ["a", "b"], 32, 9).collect()}
    small = {r.episode_id: r.place for r in subsets.balanced(rows, ["a", "b"], 8, 9).collect()}
    assert sorted(large.values()) == list(range(32)) and small == {k: v for k, v in large.items() if v < 8}
    assert {(r.a, r.b) for r in subsets.shortfalls(rows, ["a", "b"], 21).collect()} == {(True, True), (False, True)}
    decisions = spark.createDataFrame([(f"e{i}", k) for i in range(30) for k in range(1 + i % 5)], "episode_id string, message_index int")
    picked = subsets.one_decision_each(decisions, 4).collect()
    assert len(picked) == 30 and len({r.message_index for r in picked}) > 2


def test_located_and_findings(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, "y", None), (3, "z", 3)], "k int, u string, v int")
    b = spark.createDataFrame([(1, "x", 2), (2, "y", None), (4, "z", 3)], "k int, u string, v int")
    found = {(r.k, r.fault, tuple(r["columns"] or ())) for r in reconcile.differences(a, b, ["k"], ["u", "v"]).collect()}
    assert found == {(1, "differs", ("v",)), (3, "left_only", ()), (4, "right_only", ())}


def test_audit_reads_the_whole_record(spark):
    ddl = "source_dataset string, source_revision string, source_license string, source_record_id string, task_text string, repo string, metadata string, raw_record string, tools string, messages array<" + schemas.MESSAGE + ">"
    talk = [("user", "x", "", None, None, None, "{}"), ("assistant", "", "", json.dumps(acts(call("read", path="a"))["action"]), None, None, "{}"), ("tool", "y", "", None, "k1", None, "{}")]
    rows = [("d", SHA, "cc-by-4.0", "1", "t", "o/r", '{"repo_license":"MIT"}', raw, json.dumps([READ]), talk) for raw in ("{}", '{"patch":"mia.f@shipyard.dev"}')]
    df = spark.createDataFrame(rows, ddl).withColumn("episode_id", F.col("raw_record"))
    assert sorted(r.findings for r in audit.audit(df).collect()) == [[], ["email"]]
