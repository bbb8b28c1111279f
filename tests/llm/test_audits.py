import hashlib
import random
import zlib

import numpy as np
import pytest
from compare import same_rows
from conftest import make

from quarry.llm import filter_audit, periodic_runs, queries


def test_audit_equals_its_sql(spark, duck, sf):
    assert same_rows(queries.op12_filter_audit(spark, sf).toPandas(), duck.execute(filter_audit.ORACLE_SQL).df())


def _audit_by_hand(rows, labels):
    """Each order run over the documents."""
    from itertools import permutations

    first, fails, out = {}, [], {}
    for i, text, _ in rows:
        first[text or ""] = min(i, first.get(text or "", i))
    for i, text, part in rows:
        words = (text or "").encode().split()
        text = text or ""
        caps = sum("A" <= c <= "Z" for c in text)
        bad = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * caps > 5 * len(text), "D": any(c in "#$%&*|" for c in text), "E": i > first[text]}
        fails.append((part or "", {f for f, b in bad.items() if b}, i))
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    for part in {f[0] for f in fails}:
        own = [f for f in fails if f[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone, left = [x for x in left if f in x[1]], [x for x in left if f not in x[1]]
                total[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(f in x[1] for x in own) - len(gone), sum(x[1] == {f} for x in own), sum(x[2] in good for x in gone), sum(x[2] in toxic for x in gone)]
        for key, row in out.items():
            if key[0] == part:
                row.append(total[key[1][key[2] - 1]])
    return out


def test_audit_of_odd_rows(spark, odd, none):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in odd.collect() if r["doc_id"] is not None]
    labels = [(0, 1, 0), (0, 0, 1), (1, 1, 1), (5, None, 1), (None, 1, 1), (7, 1, None), (10, 0, 0)]
    given = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in filter_audit.audit(odd, given).collect()}
    assert got == _audit_by_hand(rows, labels)
    assert filter_audit.audit(none, given).count() == 0
    assert filter_audit.audit(odd, given.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_audit_of_other_filters(spark):
    docs = make(spark, ["a", "b", "a", "ab"], sources=["x", "x", "y", "y"])
    labels = spark.createDataFrame([(3, 1, 1)], "doc_id bigint, quality int, toxic int")
    found = filter_audit.audit(docs, labels, {"long": lambda data, words: len(data) > 1, "b": lambda data, words: b"b" in data})
    got = {tuple(r) for r in found.where("filter_order = 'longbE'").collect()}
    assert got == {
        ("x", "longbE", 1, 2, 0, 0, 0, 0, 0, 0), ("x", "longbE", 2, 1, 1, 0, 1, 0, 0, 6), ("x", "longbE", 3, 1, 0, 0, 0, 0, 0, 0),
        ("y", "longbE", 1, 1, 1, 0, 0, 1, 1, 3), ("y", "longbE", 2, 1, 0, 1, 0, 0, 0, 3), ("y", "longbE", 3, 0, 1, 0, 1, 0, 0, 6),
    }


def _runs_by_hand(w, least=6, exponent=4):
    out = {}
    for p in range(1, len(w) // exponent + 1):
        i = 0
        while i + p < len(w):
            start = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i + p - start >= max(least, exponent * p):
                out.setdefault((start, i + p - start), p)  # the smallest period comes first
            i += 1
    return sorted(((s, n, p) for (s, n), p in out.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least, exponent", [(6, 4), (2, 2), (4, 3)])
def test_runs_equal_brute_force(least, exponent):
    rng = random.Random(least)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 6)):
            n, kinds = rng.randint(0, 60), rng.choice([1, 2, 3, 10])
            text = [rng.randrange(kinds) for _ in range(n)]
            if n and rng.random() < 0.5:
                text[n // 3 : n // 3] = text[: rng.randint(1, 5)] * rng.randint(2, 9)
            texts.append(text)
        got = periodic_runs.find_runs([np.array(t, np.int64) for t in texts], least, exponent)
        assert [[tuple(map(int, r)) for r in g] for g in got] == [_runs_by_hand(t, least, exponent) for t in texts]


def test_runs_of_long_periodic_texts():
    n = 60_000
    for period in (1, 7, 15_000):
        (runs,) = periodic_runs.find_runs([np.arange(n) % period])
        assert runs.tolist() == [[0, n, period]]
    assert not len(periodic_runs.find_runs([np.arange(n) % 15_001])[0])


def _digests_by_hand(i, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(i).encode())
    if h % 10 == 0 and n:
        a = (h // 10) % n
        p = 1 + (n - a) // (3 + (h // 10) % 8)
        words = words[:a] + [words[a + (k - a) % p] for k in range(a, n)]
    runs = _runs_by_hand(words)
    drop = {k for s, m, q in runs for k in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()
    return (i, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(lines), sha(b" ".join(w for k, w in enumerate(words) if k not in drop)))


def test_periodic_runs_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    short = [r for r in docs if len(r["text"] or "") < 12_000]
    got = {r["doc_id"]: tuple(r) for r in queries.op13_periodic_runs(spark, sf).collect()}
    assert len(got) == len(docs) and len(short) > 150
    for r in short:
        assert got[r["doc_id"]] == _digests_by_hand(r["doc_id"], r["text"])
    assert sum(v[1] > 0 for v in got.values()) > 15


def test_runs_of_odd_rows(spark, odd, none):
    extra = make(spark, ["x y " * 9 + "z", "a b " * 7, "n n n n n n\nq", "\x0b\x0c" + "ü " * 6], first=100)
    rows = odd.unionByName(extra)
    got = sorted((tuple(r) for r in periodic_runs.digests(periodic_runs.runs(rows, placed=periodic_runs.repeating_ends)).collect()), key=str)
    want = sorted((_digests_by_hand(r["doc_id"], r["text"]) for r in rows.collect() if r["doc_id"] is not None and len(r["text"] or "") < 100_000), key=str)
    assert [g for g in got if g in want] == want and len(got) == rows.where("doc_id is not null").count()
    kept = {r["id"]: (r["starts"], r["lengths"], r["periods"], r["kept"]) for r in periodic_runs.runs(extra).collect()}
    assert kept[100] == ([0], [18], [2], "x y z") and kept[102] == ([0], [6], [1], "n q")
    assert periodic_runs.runs(none).count() == 0
