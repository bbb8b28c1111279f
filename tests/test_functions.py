import hashlib
import unicodedata

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import identity as I
from quarry.functions import text as X
from quarry.operators.packing import best_fit


@given(st.integers(1, X.PRIME - 1), st.lists(st.integers(0, (1 << 60) - 1), min_size=1, max_size=20))
@settings(max_examples=200, deadline=None)
def test_mersenne_product(a, values):
    got = X._times(a, np.array(values, np.uint64)).tolist()
    assert got == [a * v % X.PRIME for v in values]


@given(st.lists(st.integers(1, 16), min_size=1, max_size=40))
def test_best_fit(lengths):
    bins = best_fit(lengths, 16)
    for b in set(bins):
        assert sum(n for n, x in zip(lengths, bins, strict=True) if x == b) <= 16


def test_identities(spark):
    cases = {
        ("Blue-Whale/Song.Kit", "t"): "repo:blue-whale/song.kit", ("http://github.com/Blue-Whale/song.kit.git/", "t"): "repo:blue-whale/song.kit", ("blue-whale__song.kit", "t"): "repo:blue-whale/song.kit",
        (None, "Blue-Whale__song.kit-4"): "repo:blue-whale/song.kit", ("unknown", "harbour-9_copy3"): "task:harbour-9", (None, "null"): None, ("none", ""): None,
    }
    df = spark.createDataFrame(list(cases), "repo string, task string").select("repo", "task", I.group_identity(I.folded("repo"), I.folded("task")).alias("i"))
    assert {(r.repo, r.task): r.i for r in df.collect()} == cases


def test_folded(spark):
    text = ["  Straße ﬁn    X\n", None, "", "ΑΣ"]
    got = [r.x for r in spark.createDataFrame([(t,) for t in text], "t string").select(I.folded("t").alias("x")).collect()]
    assert got == [None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()) for t in text]


def test_sensitive(spark):
    rows = {
        "mail mia.f@shipyard.dev today": ["email"], "x\n-----BEGIN EC PRIVATE KEY-----\n": ["private_key"], "gho_" + "Z9" * 20: ["github_token"], "Client-Secret: '" + "q7" * 10 + "'": ["credential_assignment"],
        f"{X.SERVICE_ADDRESS} someone@example.org lib@10.0.1": [], "id 078-05-1120": ["ssn"], "AKIA" + "Q" * 16 + " at https://me:passw@host/": ["aws_access_key", "credential_url", "email"], "plain": [],
    }
    df = spark.createDataFrame([(k,) for k in rows], "t string").select("t", X.sensitive_findings(F.col("t")).alias("f"))
    found = {r.t: r.f for r in df.collect()}
    found = {k: [x for x in v if x != "email" or "passw" not in k] for k, v in found.items()}
    rows = {k: [x for x in v if x != "email" or "passw" not in k] for k, v in rows.items()}
    assert found == rows


def test_think_and_fences(spark):
    df = spark.createDataFrame([("\n<think> one\ntwo </think>  three ",), ("no tags ",), ("x <think>y</think>",), (None,)], "t string").select(X.split_think(F.col("t")).alias("s"))
    assert [(r.s.reasoning, r.s.visible) for r in df.collect()] == [("one\ntwo", "three"), ("", "no tags"), ("", "x <think>y</think>"), ("", "")]
    assert X.last_fence("First\n```\na\n```\nthen\n```py\nb = 1\n```") == ("First\n```\na\n```\nthen", "b = 1") and X.last_fence("bare") == ("bare", None)
    assert X.first_json('see [3, {"k": [2]} end') == {"k": [2]} and X.first_json("nothing") is None


def test_bands_by_definition(spark):
    shingles = [hashlib.sha256(str(i).encode()).hexdigest()[:16] for i in range(7)]
    got = spark.createDataFrame([(shingles,)], "s array<string>").select(X.minhash_bands("s").alias("b")).first().b
    sig = [min((a * int(s[:15], 16) + b) % X.PRIME for s in shingles) for a, b in X.permutations()]
    assert got == [hashlib.sha256(("[" + ",".join(map(str, sig[i : i + 4])) + "]").encode()).hexdigest() for i in range(0, 32, 4)]


def test_guards_lose_no_finding(spark):
    """Every rule's literals stand in whatever its pattern matches."""
    import re

    from pyspark.sql import functions as F

    from quarry.functions import text as X

    samples = [
        "-----BEGIN PRIVATE KEY-----", "-----BEGIN EC PRIVATE KEY-----", *(f"x gh{c}_{'a1' * 20} y" for c in "pousr"), "github_pat_" + "A_" * 25, "AKIA" + "Z9" * 8, "ASIA" + "Z9" * 8, "sk-" + "ab_-" * 8,
        "http://me:secret1@host", "https://u:12345@h/x", "PassWord: 'abcdefghij0123456789'", 'api-key="abcdefghij0123456789"', "client_secret = \"abcdefghij0123456789\"", "accesstoken:'abcdefghij0123456789'",
        "mia.f@shipyard.dev", "078-05-1120", "nothing at all", "gh_ sk- @ :// - = ' AKIA", "",
    ]
    found = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, t string").select("i", X.sensitive_findings(F.col("t")).alias("f")).collect()
    plain = [[n for n, p in X.SENSITIVE.items() if re.search(p, s)] for s in samples]
    assert [r.f for r in sorted(found, key=lambda r: r.i)] == plain and {n for p in plain for n in p} == set(X.SENSITIVE)


def test_python_gets_texts_in_bounded_batches(spark, sf):
    """Tables of the queries bound their session's Arrow batches by bytes; a bound that the user set stays."""
    from quarry import catalog, scratch

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.unset(key)
        rows = catalog.table(spark, sf, "documents").limit(1).select(F.repeat(F.lit("é"), 1 << 19).alias("t")).crossJoin(spark.range(0, 40, 1, 1)).repartition(1)
        sizes = F.pandas_udf("long")(lambda t: t.map(lambda _: len(t)))
        assert rows.select(sizes(F.col("t")).alias("n")).agg(F.max("n")).first()[0] <= scratch.BATCH_BYTES // (1 << 20) + 1
        spark.conf.set(key, "1000000b")
        catalog.table(spark, sf, "documents")
        assert spark.conf.get(key) == "1000000b"
    finally:
        spark.conf.set(key, before)


def test_signatures_are_made_of_short_and_long_texts(spark):
    """Signed where they are read: the same bands and sizes as from hex shingles, more texts than one block holds."""
    from quarry.operators import contamination as C

    texts = ["", "one", "a b c d", "a b c d e", "é ü ö ñ à ç", " ".join(f"w{i % 50}" for i in range(400)), " ".join(f"v{i}" for i in range(40_000)), "a b c d e f a b c d e f"]
    tasks = spark.createDataFrame([(t, "dev") for t in [*texts, texts[3]]], "folded string, split string").withColumn("digest", F.sha2("folded", 256))
    old = C.task_index(tasks).select("digest", F.size("shingles").alias("n"), X.minhash_bands("shingles").alias("bands"))
    index = C.signed(C.prepared(tasks))
    assert sorted(map(tuple, index.select("digest", "n", "bands").collect())) == sorted(map(tuple, old.collect())) and index.count() == len(texts)
    each = C.fingerprints(tasks).select("digest", "n", "bands", F.size("shingles").alias("kept")).collect()
    assert sorted((r.digest, r.n, r.bands) for r in each) == sorted(map(tuple, old.collect())) and all(r.n == r.kept for r in each)


def test_all_pairs_of_a_bucket_are_candidates(spark):
    """Not only those with a bucket's smallest digest; each pair once, however many buckets it shares and blocks these have."""
    from itertools import combinations

    from quarry.operators import contamination as C

    three = spark.createDataFrame([(d, 0, "v") for d in "abc"], "digest string, band int, value string")
    assert sorted(map(tuple, C.bucket_links(three).collect())) == [("a", "b"), ("a", "c"), ("b", "c")]
    held = {(f"d{i:02}", band, f"v{i % (band + 2) if band < 6 else i * 9 + band}") for i in range(23) for band in range(8)} - {("d04", 0, "v0"), ("d07", 3, "v2")}
    plain = {(a, b) for (a, p, v), (b, q, w) in combinations(sorted(held), 2) if p == q and v == w and a < b}
    found = spark.createDataFrame(sorted(held), "digest string, band int, value string")
    for block in (1, 3, 500):
        pairs = C.bucket_links(found, block).select("a", "b").collect()
        assert len(pairs) == len(plain) and set(map(tuple, pairs)) == plain


def test_near_texts_are_all_candidates_of_each_other(spark, tmp_path):
    import duckdb

    from quarry import catalog

    same = " ".join(f"word{i}" for i in range(40))
    texts = [same, same + ".", same.replace(" ", ", "), same.upper(), same + "!", "", None, "another text of more than five words"]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted(map(tuple, catalog.QUERIES["lsh_candidates"](spark, str(tmp_path)).select("a", "b").collect()))
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert len(found) == 6 and found == sorted(duck.execute(f"select a, b from ({catalog.ORACLE_SQL['lsh_candidates']})").fetchall())
