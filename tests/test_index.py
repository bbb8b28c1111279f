"""The contamination index in batches equals the index of all."""

import random

import pytest

from quarry.plans import index

TASKS = "folded string, group_sha256 string, split string"


def texts(rng, n):
    words = [f"w{i}" for i in range(40)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(n // 3)]
    out = []
    for _ in range(n):
        t = rng.choice(base).split()
        if rng.random() < 0.5:
            t[rng.randrange(len(t))] = rng.choice(words)
        out.append((" ".join(t), f"g{rng.randint(0, 9)}", rng.choice(["dev", "test", "train", "train"])))
    return out


def table_rows(opened, name):
    rows = opened.table(name)
    columns = sorted(rows.columns)
    plain = lambda x: tuple(sorted(x)) if isinstance(x, list) else x
    return sorted(tuple(plain(r[c]) for c in columns) for r in rows.collect())


def test_batches_equal_one_index(spark, tmp_path):
    rng = random.Random(6)
    rows = texts(rng, 60)
    seen = [(f"t{i % 15}", rng.choice(["dev", "train"])) for i in range(30)]
    frame = lambda part: spark.createDataFrame(part, TASKS)
    trace = lambda part: spark.createDataFrame(part, "digest string, split string")
    one, many = str(tmp_path / "one"), str(tmp_path / "many")
    index.build(frame(rows), trace(seen), one, "p", [{"source": "all"}])
    index.build(frame(rows[:25]), trace(seen[:10]), many, "p", [{"source": "a"}])
    before = index.Index(spark, many, "p")
    counted = before.table("bands").count()
    index.append(frame(rows[20:45]), trace(seen[5:20]), many, "p", [{"source": "b"}])
    index.append(frame(rows[45:]), trace(seen[20:]), many, "p", [{"source": "c"}])
    index.append(frame(rows[:5]), trace(seen[:5]), many, "p", [])  # nothing new
    a, b = index.Index(spark, one, "p"), index.Index(spark, many, "p")
    for name in index.TABLES:
        assert table_rows(a, name) == table_rows(b, name)
    assert a.manifest["counts"] == b.manifest["counts"] and [s["source"] for s in b.manifest["sources"]] == ["a", "b", "c"]
    assert index.versions(spark, many) == [1, 2, 3, 4] and index.Index(spark, many, "p", 1).table("bands").count() == before.table("bands").count() == counted
    asked = spark.createDataFrame([(i, t, f"t{i}", "test") for i, (t, *_) in enumerate(texts(random.Random(6), 60)[:20])], "candidate int, folded string, trace string, split string")
    assert {tuple(r) for r in a.findings(asked).collect()} == {tuple(r) for r in b.findings(asked).collect()} != set()


def test_indexes_are_bound_and_written_once(spark, tmp_path):
    folder = str(tmp_path / "index")
    rows, none = spark.createDataFrame([("one text", "g", "dev")], TASKS), spark.createDataFrame([], "digest string, split string")
    with pytest.raises(FileNotFoundError):
        index.Index(spark, folder, "p")
    index.build(rows, none, folder, "p", [])
    with pytest.raises(FileExistsError):
        index.build(rows, none, folder, "p", [])
    with pytest.raises(ValueError, match="another"):
        index.append(rows, none, folder, "q", [])
    with pytest.raises(FileNotFoundError):
        index.Index(spark, folder, "p", 7)
    with pytest.raises(Exception):  # noqa: B017 - the manifest of that version is there
        index._publish(spark, folder, 1, index.Index(spark, folder, "p").manifest["segments"], "p", [])


def test_rows_are_as_many_as_frozen(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("b",)], "source string")
    index.check_rows(rows, [{"source": "a", "rows": 2}, {"source": "b", "rows": 1}])
    for wrong in ([{"source": "a", "rows": 2}], [{"source": "a", "rows": 3}, {"source": "b", "rows": 1}], [{"source": "a", "rows": 2}, {"source": "b", "rows": 1}, {"source": "c", "rows": 4}]):
        with pytest.raises(ValueError, match="frozen"):
            index.check_rows(rows, wrong)
