import functools
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from compare import same_rows
from conftest import make
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import bpe, curriculum_mix, edit_counts, hilbert_neighbours, huffman, licence_rules, ngram_jaccard_join, queries, site_quality, substring_dedup, template_decontam, token_file, wordhash

SPACE = b" \t\n\x0b\f\r"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf, duck, name):
    assert same_rows(queries.QUERIES[name](spark, sf).toPandas(), duck.execute(queries.ORACLE_SQL[name]).df())


@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \t\n\x0babcé’", max_size=30)), max_size=8))
@settings(max_examples=100, deadline=None)
def test_words(texts):
    found = []
    for b in wordhash.blocks(pa.array(texts, pa.string()), 16):
        data = b.data.tobytes()
        found += [[data[s:e] for s, e in zip(b.starts[b.first[i] : b.first[i + 1]], b.ends[b.first[i] : b.first[i + 1]], strict=True)] for i in range(len(b))]
    assert found == [(x or "").encode().split() for x in texts]


@given(st.lists(st.integers(0, 400), max_size=2000), st.sampled_from([9, 18]))
@settings(max_examples=60, deadline=None)
def test_huffman_round_trip(ids, limit):
    ids = np.array(ids, np.int64)
    code = huffman.Code(huffman.code_lengths(np.bincount(ids, minlength=401), limit))
    data, marks = code.encode(ids)
    assert (code.decode(data, marks, len(ids)) == ids).all() and code.longest <= max(limit, 9)


def test_code_lengths_are_optimal_without_limit():
    import heapq

    counts = np.random.default_rng(1).integers(1, 1000, 200)
    heap = [int(c) for c in counts]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        cost += (x := heapq.heappop(heap) + heapq.heappop(heap))
        heapq.heappush(heap, x)
    assert int((huffman.code_lengths(counts, 30) * counts).sum()) == cost


@given(st.lists(st.text(alphabet=" \n\tab,.é '“1", max_size=40), max_size=6))
@settings(max_examples=80, deadline=None)
def test_ids_by_pieces(texts):
    e = bpe.encoder(token_file.default_tokenizer())
    got = []
    for _, ids, n in e.encode(pa.array(texts, pa.string())):
        at = np.concatenate(([0], np.cumsum(n)))
        got += [ids[at[i] : at[i + 1]].tolist() for i in range(len(n))]
    assert got == e.whole(texts)


def test_token_file(spark, sf):
    found = {r.doc_id: r for r in queries.op2_token_file(spark, sf).collect()}
    e, start = bpe.encoder(token_file.default_tokenizer()), 0
    for r in queries.table(spark, sf, "documents").orderBy("doc_id").collect():
        ids = e.whole([r.text or ""])[0] + [0]
        f = found[r.doc_id]
        assert (f.start, f.n_tokens, f.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@pytest.mark.parametrize("chunk, branching", [(substring_dedup.CHUNK_BYTES, substring_dedup.BRANCHING), (20_000, 2)])
def test_substrings(spark, sf, chunk, branching):
    docs = queries.table(spark, sf, "documents")
    found = {r.id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.dedup_substrings(docs.repartition(3), chunk=chunk, branching=branching).collect()}
    seen = set()
    for r in docs.orderBy("doc_id").collect():
        words = (r.text or "").encode().split()
        gone = [False] * len(words)
        for p in range(len(words) - 19):
            key = tuple(words[p : p + 20])
            if key in seen:
                gone[p : p + 20] = [True] * 20
            seen.add(key)
        assert found[r.doc_id] == (len(words), sum(gone), b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode())


def _components(sets, percent=90):
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            common = len(sets[i] & sets[j])
            if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def _sets(docs, k=3):
    sets = {}
    for r in docs.collect():
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in (r.text or "").encode()).split()
        sets[r.doc_id] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    return sets


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80)])
def test_jaccard_join(spark, sf, k, percent):
    docs = queries.table(spark, sf, "documents")
    found = {r.id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join.link_components(docs, k=k, percent=percent).collect()}
    assert found == _components(_sets(docs, k), percent)


@pytest.mark.parametrize("k, percent, edits", [(3, 90, 5), (5, 80, 7)])
def test_jaccard_join_of_near_copies(spark, k, percent, edits):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(150):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(120)] = f"x{rng.randrange(10_000)}"
        texts.append(" ".join(w))
    common = " ".join(f"c{i}" for i in range(50))  # a passage that many different documents share
    texts += [" ".join(f"d{k}_{i}" for i in range(30)) + " " + common for k in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join.link_components(docs, k=k, percent=percent).collect()}
    assert found == _components(_sets(docs, k), percent)


def _recall(spark, rows, queries_, k=10):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in hilbert_neighbours.nearest(df, queries_).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    x = np.array([v for _, v in rows], np.float32).astype(np.float64)
    ids, hits, total = np.array([i for i, _ in rows]), 0, 0
    for q in got:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != q][:k]
        mine = [v for *_, v in sorted(got[q])]
        hits, total = hits + len(set(ids[order]) & set(mine)), total + len(order)
    return hits / total, len(got)


def test_neighbours_with_copies(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[100:400] = x[100]  # one vector with very many copies
    recall, n = _recall(spark, [(i, v.tolist()) for i, v in enumerate(x)], "id % 50 = 0")
    assert recall == 1.0 and n == 12


def test_neighbours_recall(spark):
    import duckdb

    e = duckdb.sql("select vec_id, embedding from '/root/testdata/sf0.1/embeddings.parquet'").fetchall()
    assert _recall(spark, e, "id % 100 = 0")[0] >= 0.95


def test_neighbours_exact_beyond_the_windows(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 32)).astype(np.float32)
    x[:1300] = x[0] + 0.02 * x[:1300]  # a tight group
    # windows a twentieth of the table, as at 20,000 entries and more
    narrow = functools.partial(hilbert_neighbours.nearest, curves=4, reach=32)
    monkeypatch.setattr(hilbert_neighbours, "nearest", narrow)
    monkeypatch.setattr(hilbert_neighbours, "ROUND_BYTES", 4096, raising=False)  # several rounds of queries
    assert _recall(spark, [(i, v.tolist()) for i, v in enumerate(x)], "id % 50 = 0") == (1.0, 80)


def test_neighbours_among_near_copies(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1000, 32)).astype(np.float32)
    x[:500] = x[0] + rng.normal(size=(500, 32)).astype(np.float32) * np.float32(0.05 * np.abs(x[0]).max() / 127)  # a twentieth of an 8-bit step
    assert _recall(spark, [(i, v.tolist()) for i, v in enumerate(x)], "id % 50 = 0") == (1.0, 20)


def test_hilbert_keys_are_a_walk():
    cells = np.stack(np.meshgrid(*[np.arange(4)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    order = cells[np.argsort(hilbert_neighbours.hilbert_keys(cells, 2))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_mix_shares(spark, sf):
    rows = curriculum_mix.readings(queries.table(spark, sf, "documents")).toPandas()
    assert (rows["words"] <= rows["size"]).all()
    source = {r.doc_id: str(r.source) for r in queries.table(spark, sf, "documents").select("doc_id", "source").collect()}
    per = rows.assign(source=rows["id"].map(source)).groupby("source").agg({"words": "sum", "target": "first"})
    assert (np.abs(per["words"] - per["target"]) < 1).all()
    taken = curriculum_mix.readings(queries.table(spark, sf, "documents")).where("words > 0")
    order = curriculum_mix.in_training_order(taken, "id", "pass").toPandas()["position"]
    assert order.is_monotonic_increasing and order.between(0, 1).all()


def test_reparameterised_question(spark):
    item = "Alice has 12 apples and gives 5 of them to Bob before she walks 3 km to the market with the rest"
    texts = [item, item.replace("Alice", "Carol").replace("12", "40").replace("5 ", "7 "), item.replace("walks", "sails").replace("apples", "green pears"),
             item + " " + item.replace("Alice", "Bob"), "quite another text of some words that has nothing to do with apples"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    found = {r.id: r.n_changed for r in template_decontam.contaminated(docs, bench).collect()}
    assert found[0] == 0 and found[1] == 3 and 4 not in found
    swapped = item.replace("Alice has 12", "Alice has 5").replace("gives 5", "gives 9") + " where 12 and 12 are 12"
    both = spark.createDataFrame([(0, item + " where 12 and 12 are 12"), (1, swapped.replace("and 12", "and 13"))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item + " where 12 and 12 are 12")], "item_id long, text string")
    assert {r.id for r in template_decontam.contaminated(both, bench).collect()} == {0}


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = queries.table(spark, sf, "labels")
    train, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    scored = site_quality.score(queries.table(spark, sf, "documents"), train).withColumnRenamed("id", "doc_id").join(held, "doc_id").toPandas()
    assert ((scored["keep"]) == (scored["quality"] == 1)).mean() > 0.99


def test_quality_stage_drops_toxic(spark, tmp_path):
    sf = "/root/testdata/sf0.1"
    labels, docs = queries.table(spark, sf, "labels"), queries.table(spark, sf, "documents")
    labels.where("doc_id % 2 = 0").write.parquet(f"{tmp_path}/labels.parquet")
    held = labels.where("doc_id % 2 = 1 and quality = 1")
    kept = corpus_pipeline.quality(spark, docs, str(tmp_path)).select("doc_id", F.lit(1).alias("kept"))
    share = {r.toxic: r.share for r in held.join(kept, "doc_id", "left").groupBy("toxic").agg(F.avg(F.coalesce("kept", F.lit(0))).alias("share")).collect()}
    assert share[1] < 0.25 and share[0] > 0.98


def test_sparse_site_follows_its_host(spark):
    rows = [(i, "Some plain words. " * 5, "host", "a" if i < 200 else "b") for i in range(201)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    assert site_quality.score(docs, labels).where("keep").count() == 201


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."""
BSD2 = """Copyright (c) 2019, Someone
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = BSD2 + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL2 = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
APACHE_BODY = """                                 Apache License
                           Version 2.0, January 2004

   1. Definitions.

      "License" shall mean the terms and conditions for use, reproduction,
      and distribution as defined by Sections 1 through 9 of this document.

      "Licensor" shall mean the copyright owner or entity authorized by
      the copyright owner that is granting the License."""


def comment(text, open_, mark, close):
    return "\n".join([open_, *[f"{mark} {x}".rstrip() for x in text.split("\n")], close, "int main() { return 0; }"])


LICENSED = [
    (MIT, {"MIT"}), (comment(MIT, "/*", " *", " */"), {"MIT"}), (comment("The MIT License (MIT)\n\n" + MIT, "#", "#", "#"), {"MIT"}), (BSD2, {"BSD-2-Clause"}), (BSD3, {"BSD-3-Clause"}),
    (comment(BSD3, "//", "//", "//"), {"BSD-3-Clause"}), (BSD3 + "\n\nThe other part:\n\n" + BSD2, {"BSD-2-Clause", "BSD-3-Clause"}), (GPL2, {"GPL-2.0"}), (comment(GPL2, "--", "--", "--"), {"GPL-2.0"}),
    (GPL2.replace("General", "Affero General", 1).replace("software; you", "software: you").replace("Foundation; either version 2", "Foundation, either version 3"), {"AGPL-3.0"}),
    (GPL2.replace("General", "Lesser General", 1).replace("program is free", "library is free", 1).replace("version 2", "version 2.1"), {"LGPL-2.1"}),
    (comment(APACHE, "/*", " *", " */"), {"Apache-2.0"}), (APACHE_BODY, {"Apache-2.0"}), ("# SPDX-License-Identifier: GPL-3.0-or-later\nimport os", {"GPL-3.0"}), ("// SPDX-License-Identifier: CC-BY-SA-4.0", {"CC-BY-SA-4.0"}),
    ("Our shop. All rights reserved.", {"all-rights-reserved"}), ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", {"CC-BY-NC-SA-4.0"}),
    ("This is free and unencumbered software released into the public domain.\n\nAnyone is free", {"Unlicense"}), ("We talk about the license of a film and permission to park.", set()), ("", set()), (None, set()),
]


def test_licences_in_real_texts(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(LICENSED)], "doc_id long, text string")
    found = {}
    for r in licence_rules.scan(docs).collect():
        found.setdefault(r.id, set()).add(r.licence)
    assert [found.get(i, set()) for i in range(len(LICENSED))] == [x for _, x in LICENSED]


def test_edits_against_whole_texts(monkeypatch):
    e, rng = bpe.encoder(token_file.default_tokenizer()), random.Random(3)
    monkeypatch.setattr(edit_counts, "LEAF_BYTES", 100)
    parts = "the of Thandion ti, er. 12 don't  \n \t é ñó,  “q” ![] ' 's".split(" ")
    for t in range(120):
        spaces = [" ", " ", "\n", "  ", "", "\t", *["\u00a0", "\u2003", " \u00a0 "] * (t % 2)]
        text_of = lambda n: "".join(rng.choice(parts) + rng.choice(spaces) for _ in range(n))  # noqa: B023, E731
        text = text_of(rng.choice([0, 1, 5, 200])) + " " * (t % 10 == 0)
        ((_, sizes, counts),) = list(edit_counts.leaves(e, pa.array([text]), rng.choice([1, 2, 8])))
        assert sizes.sum() == len(text.encode()) and counts.sum() == len(e.whole([text])[0])
        tree = edit_counts.Tree(text.encode(), sizes.tolist(), counts.tolist(), e)
        for _ in range(6):
            at, length, new = rng.randint(0, len(text) + 2), rng.choice([0, 1, 3, 20, 500]), text_of(rng.choice([0, 1, 3, 60]))
            tree.edit(len(text[:at].encode()), len(text[at : at + length].encode()), new.encode())
            text = text[:at] + new + text[at + length :]
            assert tree.text().decode() == text and tree.tokens[1] == len(e.whole([text])[0])


def test_odd_white_space_is_no_single_leaf():
    e = bpe.encoder(token_file.default_tokenizer())
    text = "some words and a\u00a0space " * 400
    ((_, sizes, counts),) = list(edit_counts.leaves(e, pa.array([text])))
    assert len(sizes) > 40
    tree = edit_counts.Tree(text.encode(), sizes.tolist(), counts.tolist(), e)
    tree.edit(5000, 3, b"abc")
    assert tree.encoded < 1000 and tree.tokens[1] == len(e.whole([tree.text().decode()])[0])


def _redacted(text):
    data = text.encode()
    mails = [m.span() for m in edit_counts.EMAIL.finditer(data)]
    spans = [(a, b, b"<email>") for a, b in mails] + [(*m.span(), b"<number>") for m in edit_counts.NUMBER.finditer(data) if all(m.end() <= a or b <= m.start() for a, b in mails)]
    out, at = b"", 0
    for a, b, new in sorted(spans):
        out, at = out + data[at:a] + new, b
    return (out + data[at:]).decode(), len(spans)


def test_edited_counts(spark, sf):
    docs = queries.table(spark, sf, "documents")
    more = spark.createDataFrame([(10**6, "call +49 30 123456 7 or a.b@c.de."), (10**6, "other text of one id"), (10**6, "other text of one id"), (10**6 + 1, None), (10**6 + 2, "id\u00a012345678\u00a0end")], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(more)
    rows = edit_counts.redacted_counts(docs).collect()
    e = bpe.encoder(token_file.default_tokenizer())
    expected = []
    for r in docs.collect():
        after, n = _redacted(r.text or "")
        expected.append((r.doc_id, after, len(e.whole([r.text or ""])[0]), len(e.whole([after])[0]), n))
    assert sorted((r.id, r.text, r.tokens_before, r.tokens_after, r.n_edits) for r in rows) == sorted(expected) and sum(r.n_edits > 0 for r in rows) > 2
    for r in rows:
        assert sum(r.leaf_bytes) == len(r.text.encode()) and sum(r.leaf_tokens) == r.tokens_after and (r.bytes_encoded == 0) == (r.n_edits == 0)


def test_kept_trees_take_edits_of_a_table(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "four five"), (3, None)], "doc_id long, text string")
    trees = edit_counts.build(docs)
    edits = spark.createDataFrame([(1, 1, 0, 3, "seven"), (1, 0, 4, 3, "six"), (3, 0, 99, 1, "new"), (2, 0, None, None, None), (9, 0, 0, 1, "x"), (None, 0, 0, 1, "x")], "id long, nth int, at int, length int, text string")
    found = edit_counts.apply_edits(trees, edits)
    assert {(r.id, r.text, r.n_edits) for r in found.collect()} == {(1, "seven six three", 2), (2, "four five", 1), (3, "new", 1)}
    again = edit_counts.apply_edits(found.select("id", "text", "leaf_bytes", "leaf_tokens"), edits.where("id = 2"))
    assert {r.id: r.tokens_after for r in again.collect()} == {r.id: r.tokens_after for r in found.collect()}


def test_pipeline(spark, sf):
    docs = queries.table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES[:4]:
        found = stage(spark, docs, sf)
        assert found.columns == docs.columns
        path = f"{token_file.new_folder(spark)}-{name}"
        found.write.parquet(path)
        docs, before = spark.read.parquet(path), docs
        kept = {r.doc_id for r in docs.select("doc_id").collect()}
        assert kept <= {r.doc_id for r in before.select("doc_id").collect()}
        if name == "near_duplicates":
            assert kept == {i for i, (_, c) in _components(_sets(before, 5), 80).items() if c == i}
    last = corpus_pipeline.tokens(spark, docs, sf)
    assert last.count() == docs.count()


def test_licences_wrapped_at_any_word(spark):
    """Every rule, its sentences wrapped, double-spaced or commented between all words, as its SQL finds it."""
    sentences, every = licence_rules.table()
    rows = []
    for between, start, apart in (("\n", "", "\n\n"), ("  ", "", ".\n"), ("\n# ", "# ", "\n#\n# "), (" \t\n", "", "\n\n"), ("\r\n", "", "\r\n\r\n")):
        for _, names in every:
            rows.append((len(rows), start + apart.join(between.join(sentences[n].split(" ")) for n in names)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = licence_rules.scan(docs).withColumnRenamed("id", "doc_id").toPandas()
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert same_rows(found, con.execute(licence_rules.ORACLE_SQL).df())
    assert found["doc_id"].nunique() > 0.9 * len(rows)


def test_unrelated_words_are_never_toxic(spark):
    """A million words that the labels don't hold add nothing to a text's toxic score; telling words do, beside any number of others."""
    texts = [f"{'vile' if i % 3 == 0 else 'mild'} words here {i} in text" for i in range(300)]
    train_on = make(spark, texts).selectExpr("doc_id as id", "text")
    model = site_quality.train_words(train_on, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "id long, y int"))
    many = [" ".join(f"w{j}x{i}" for j in range(i * 1000, i * 1000 + 1000)) for i in range(1000)]
    odds = site_quality.word_odds(pa.array([*many, many[0] + " (Vile!) ", None, ""]), model)
    assert len(set(odds[:1000])) == 1 and odds[0] == odds[-1] == odds[-2] < 0 < odds[1000]


def test_held_words_equal_brute_force(spark):
    rng = random.Random(8)
    marks = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
    texts = [None if rng.random() < 0.05 else "".join(rng.choice(["Ab", "b", "C", "é", "*", "'", " ", "\n", ".", "(", "1"]) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    plain = [{w.strip(marks).translate({c: c + 32 for c in range(65, 91)}) for w in (t or "").split()} - {""} for t in texts]
    known = sorted({w for p in plain for w in p})[::3]
    by_hash = {int(site_quality.word_hashes(pa.array([w])).__next__()[1][0]): w for w in known}
    words = np.array(sorted(by_hash), np.int64)
    rows, at = site_quality.held_words(pa.array(texts), words)
    got = [set() for _ in texts]
    for r, a in zip(rows.tolist(), at.tolist(), strict=True):
        got[r].add(by_hash[int(words[a])])
    assert len(by_hash) == len(known) and got == [p & set(known) for p in plain]
