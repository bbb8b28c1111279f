import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import bpe, curriculum_mix, edit_counts, hilbert_neighbours, licence_rules, line_dedup, ngram_jaccard_join, queries, site_quality, substring_dedup, template_decontam, token_file


def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (4, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id bigint, quality int, toxic int")


def items(spark):
    return spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog and runs far"), (2, None), (3, ""), (4, "short"), (None, "x")], "item_id bigint, text string")


RUN = {
    "op1": lambda s, d: template_decontam.contaminated(d, items(s)),
    "op2": lambda s, d: token_file.read_tokens(s, token_file.write_tokens(d, token_file.new_folder(s))),
    "op3": lambda s, d: substring_dedup.dedup_substrings(d),
    "op4": lambda s, d: site_quality.score(d, labels(s)),
    "op6": lambda s, d: ngram_jaccard_join.link_components(d),
    "op7": lambda s, d: curriculum_mix.readings(d),
    "op8": lambda s, d: licence_rules.scan(d),
    "op9": lambda s, d: edit_counts.redacted_counts(d),
    "op10": lambda s, d: line_dedup.dedup_lines(d),
}
ROWS = {"op2": 15, "op3": 15, "op4": 15, "op6": 15, "op9": 15, "op10": 15}


@pytest.mark.parametrize("name", RUN)
def test_odd_rows(spark, odd, name):
    rows = RUN[name](spark, odd).collect()
    if name in ROWS:  # one per row with an id, the two repeated ones too
        assert len(rows) == ROWS[name]


@pytest.mark.parametrize("name", RUN)
def test_empty_table(spark, none, name):
    assert RUN[name](spark, none).count() == 0


def test_repeated_row_is_not_its_own_copy(spark, odd):
    rows = {(r.id, r.n_removed) for r in substring_dedup.dedup_substrings(odd).where("id in (0, 1, 2)").collect()}
    assert (0, 0) in rows and (0, 24) not in rows and (1, 24) in rows and (2, 0) in rows


def test_leaks_in_odd_rows(spark, odd):
    found = template_decontam.contaminated(odd, items(spark).unionByName(items(spark))).collect()
    assert sorted((r.id, r.item, r.matched, r.n_changed) for r in found) == [(i, 1, 5, 0) for i in (0, 1, 10, 12)]


def test_leak_behind_an_inconsistent_variant(spark):
    item = "Alice has 12 apples and gives 5 of them to Bob before she walks 12 km to the market with the rest"
    variant = item.replace("12 km", "30 km")  # 12 stands for 12 and 30
    texts = [variant + " . " + item, item + " . " + variant, variant, item.lower(), item.upper(), " ".join(item.split()[:10]), "gives 5 of them to Bob " * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, "what is the tallest mountain here?"), (3, "who knows?")], "item_id long, text string")
    more = spark.createDataFrame([(20, "So: what is the tallest mountain here, I ask"), (21, "what is the tallest hill here? who knows?")], "doc_id long, text string")
    found = {(r.id, r.item): r.n_changed for r in template_decontam.contaminated(docs.unionByName(more), bench).collect()}
    assert found == {(0, 1): 0, (1, 1): 0, (3, 1): 0, (4, 1): 0, (20, 2): 0}


def test_readings_of_odd_rows(spark, odd):
    rows = curriculum_mix.readings(odd).collect()
    per = {}
    for r in rows:
        per.setdefault((r.id, r.source, r["copy"]), []).append(r)
    assert len(per) == 15 and {r["copy"] for r in rows if r.id in (0, 1)} == {0, 1} and {r["copy"] for r in rows if r.id > 1} == {0}
    sizes = {}
    for (i, source, _), x in per.items():
        assert sum(r.words for r in x) <= 2 * x[0].size and len({r["pass"] for r in x}) == len(x)
        sizes[source] = sizes.get(source, 0) + x[0].size
    for source, size in sizes.items():
        mine = [x[0] for k, x in per.items() if k[1] == source]
        assert {r.source_size for r in mine} == {size} and abs(sum(r.words for k, x in per.items() if k[1] == source for r in x) - mine[0].target) < 1


def test_mix_query_keeps_rows_of_one_id(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c d e", "s"), (1, "a b c d e", "s"), (1, "x", "t"), (2, None, "s")], "doc_id long, text string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op7_curriculum_mix(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.size) for r in rows) == [(1, 1), (1, 5), (1, 5), (2, 0)] and all(r.taken <= 2 * r.size for r in rows)


def test_neighbours_of_repeated_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 3.0]), (4, [1.0]), (5, None)]
    found = hilbert_neighbours.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), "id = 2").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in sorted(found, key=lambda r: r["rank"])] == [(2, 1, 1, 0.5), (2, 2, 3, 10**0.5)]


@pytest.mark.parametrize("rows", [[], [(1, None, 0), (2, [], 0), (3, [None, 1.0], 0), (4, [0.0, 0.0], 0), (5, [float("nan"), 1.0], 0), (None, [1.0, 1.0], 0)]])
def test_no_vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, id int")
    assert hilbert_neighbours.nearest(df, "id % 2 = 0").count() == 0


@pytest.mark.parametrize("k", range(4))
def test_stages_on_empty_documents(spark, none, sf, k):
    found = corpus_pipeline.STAGES[k][1](spark, none, sf)
    assert found.count() == 0 and found.columns == list(corpus_pipeline.COLUMNS)


def test_tokens_on_empty_documents(spark, none, sf):
    assert corpus_pipeline.tokens(spark, none, sf).count() == 0


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_quality_on_odd_documents(spark, odd, sf):
    found = corpus_pipeline.quality(spark, odd, sf)
    scored = {r.id: r.keep and not r.toxic for r in site_quality.score(odd, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert found.columns == list(corpus_pipeline.COLUMNS) and ids(found) == sorted(i for i in [*range(13), 0, 1] if scored[i]) and 7 in ids(found)


def test_near_duplicates_on_odd_documents(spark, odd, sf):
    found = corpus_pipeline.near_duplicates(spark, odd, sf)
    assert found.columns == list(corpus_pipeline.COLUMNS) and ids(found) == [0, 0, 2, 3, 4, 5, 6, 7, 9, 11]


def test_decontamination_on_odd_documents(spark, odd, tmp_path):
    items(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert ids(corpus_pipeline.decontamination(spark, odd, str(tmp_path))) == [2, 3, 4, 5, 6, 7, 8, 9, 11]


def test_mixing_of_odd_documents(spark, odd, sf):
    found = corpus_pipeline.mixing(spark, odd, sf)
    taken = [(r.id, r.source) for r in curriculum_mix.readings(odd).collect() if r.words > 0 and 2 * r.words >= r.size]
    assert ids(found) == sorted(i for i, _ in taken) and not {2, 3, 4} & set(ids(found)) and found.columns == list(corpus_pipeline.COLUMNS)
    assert sorted((r.doc_id, r.source or "") for r in found.collect()) == sorted((i, x or "") for i, x in taken)


def test_tokens_of_odd_documents(spark, odd, sf):
    rows = sorted(corpus_pipeline.tokens(spark, odd, sf).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted([*range(13), 0, 1]) and [r.n_tokens for r in rows if r.doc_id in (2, 3)] == [1, 1]
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]


def test_words_that_collide_in_polynomial_hashes(spark):
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    tail = " ".join(f"w{i}" for i in range(19))
    docs = spark.createDataFrame([(0, f"{word} {tail}"), (1, f"{other} {tail}"), (2, f"{word} {tail}")], "doc_id long, text string")
    e = bpe.encoder(token_file.default_tokenizer())
    expected = {r.doc_id: e.whole([r.text])[0] + [0] for r in docs.collect()}
    assert {r.id: r.token_ids for r in RUN["op2"](spark, docs).collect()} == expected
    assert {r.id: r.n_removed for r in RUN["op3"](spark, docs).collect()} == {0: 0, 1: 0, 2: 20}
    assert {r.id: r.component_id for r in ngram_jaccard_join.link_components(docs.withColumn("text", F.substring_index("text", " ", 2))).collect()} == {0: 0, 1: 1, 2: 0}
    assert {r.id: r.tokens_before for r in RUN["op9"](spark, docs).collect()} == {i: len(x) - 1 for i, x in expected.items()}


def test_site_posteriors_by_formula(spark):
    rng = np.random.default_rng(2)
    rows = [(i, f"h{h}", f"h{h}/p{p}", float(rng.normal(h - 2 + p / 2, 1))) for i, (h, p) in enumerate((rng.integers(0, 5), rng.integers(0, 3)) for _ in range(400))]
    found = site_quality._with_sites(spark.createDataFrame(rows, "id long, host string, path string, odds double"), "odds", 0.5, ("hm", "pm", "score")).toPandas()
    p = lambda x: 1 / (1 + np.exp(-x))
    df = found.assign(p=p(found["odds"]))
    middle = df["p"].mean()

    def strength(groups, means):
        n, s, q = groups["n"], groups["s"], groups["q"]
        within = max((q - s * s / n).sum() / (n.sum() - len(n)), 1e-9)
        spread = ((n * (s / n - means) ** 2).sum() - (len(n) - 1) * within) / max(n.sum() - (n * n).sum() / n.sum(), 1e-9)
        return min(max(within / spread, 1.0), 1e6) if spread > 0 else 1e6

    sums = lambda by: df.groupby(by)["p"].agg(n="count", s="sum", q=lambda x: (x * x).sum())
    hosts, paths = sums("host"), sums(["host", "path"])
    k = strength(hosts, middle)
    hosts["m"] = (hosts["s"] + k * middle) / (hosts["n"] + k)
    own = hosts["m"].reindex(paths.index.get_level_values(0)).to_numpy()
    k = strength(paths, own)
    mean = ((paths["s"] + k * own) / (paths["n"] + k)).droplevel(0)
    shift = lambda m: np.log(m / (1 - m)) - np.log(middle / (1 - middle))
    assert np.allclose(found["pm"], found["path"].map(mean)) and np.allclose(found["hm"], found["host"].map(hosts["m"]))
    assert np.allclose(found["score"], p(found["odds"] + 0.5 * shift(found["path"].map(mean))))
