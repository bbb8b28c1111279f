import random
import re
import zlib

import numpy as np
import pytest
from conftest import make

from quarry.llm import levenshtein, lexicon_toxicity, queries
from quarry.llm.lexicon_toxicity import Lexicon, strength

SF = "/root/testdata/sf0.1"


def edits(a, b):
    """Insertions, deletions, substitutions and transpositions of neighbours."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def recognised(word, entries):
    """(edits, is a stem) of the best entry by brute force; None without one."""
    best = [(0, True) for t, stem in entries if stem and word.startswith(t)]
    best += [(d, False) for t, stem in entries if not stem and abs(len(word) - len(t)) <= levenshtein.edits_allowed(t) and (d := edits(word, t)) <= levenshtein.edits_allowed(t)]
    return min(best, key=lambda x: (x[0], x[1]), default=None)


def test_automaton_equals_brute_force():
    rng = random.Random(5)
    letters = "abcé"
    for _ in range(30):
        entries = list({("".join(rng.choice(letters) for _ in range(rng.randint(2, 10))), rng.random() < 0.2) for _ in range(12)})
        words = ["".join(rng.choice(letters + "x") for _ in range(rng.randint(1, 12))) for _ in range(200)]
        for text, _ in entries:
            for _ in range(6):
                w = list(text)
                for _ in range(rng.randint(0, 2)):
                    i, how = rng.randrange(len(w)), rng.randrange(4)
                    if how == 0:
                        w[i] = rng.choice(letters)
                    elif how == 1:
                        w.insert(i, rng.choice(letters))
                    elif how == 2 and len(w) > 1:
                        del w[i]
                    elif i + 1 < len(w):
                        w[i], w[i + 1] = w[i + 1], w[i]
                words.append("".join(w))
        automaton = levenshtein.Automaton(entries)
        letters_, starts, ends, _ = levenshtein.words_of([" ".join(words)])
        got = {int(i): (int(d), entries[e][1]) for i, e, d in zip(*automaton.matches(letters_, starts, ends), strict=True)}
        assert got == {i: best for i, w in enumerate(words) if (best := recognised(w, entries))}


def test_automaton_starts_anew_when_its_table_is_large(monkeypatch):
    monkeypatch.setattr(levenshtein, "MOST_STATES", 4)
    lexicon = Lexicon([("worthless", False), ("vequ", True)])
    for _ in range(3):
        ((n, hits),) = lexicon.hits(["a worthles vequoir wrothless worthy"])
        assert n == 5 and [(h[1], h[3]) for h in hits] == [("worthles", 1), ("vequoir", 0), ("wrothless", 1)]


def test_words_and_places():
    lexicon = Lexicon([("idiot", False), ("fool", False)])
    texts = ["", "You IDIOT!", "İ id*ot, 1diot idi@t @idiot@ fo0l\nfool", " ", "𝔘 idoit"]
    got = [(n, [(lexicon.entries[e][0], w, a, d) for e, w, a, d, _ in hits]) for n, hits in lexicon.hits(texts)]
    assert got[0] == (0, []) and got[3] == (0, [])
    assert got[1] == (2, [("idiot", "idiot", 4, 0)])
    assert got[2] == (7, [("idiot", "id*ot", 2, 1), ("idiot", "1diot", 9, 1), ("idiot", "idi@t", 15, 1), ("idiot", "idiot", 22, 0), ("fool", "fool", 34, 0)])
    assert got[4] == (2, [("idiot", "idoit", 2, 1)])


def test_windows_tell_abuse_from_quotation():
    plain = strength("and then an ", " came in", 0)
    assert plain == 1 and strength("and then an ", " came in", 2) == lexicon_toxicity.EDIT**2
    assert strength("they shouted \"what an ", "\" and left", 0) == lexicon_toxicity.QUOTED
    assert strength("the sign read “", "” and «x»", 0) == lexicon_toxicity.QUOTED
    assert strength('a "grey" part and an ', ' with "another"', 0) == 1  # between two quotations
    assert strength('an open " mark\nand an ', ' here "', 0) == 1  # of another line
    assert strength("the word ", " is an insult", 0) == lexicon_toxicity.REPORTED
    assert strength("you are an ", "", 0) == lexicon_toxicity.ADDRESSED


@pytest.fixture(scope="module")
def model_and_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    known = labels.selectExpr("doc_id as id", "toxic as y").where(lexicon_toxicity.fold() != 0)
    return lexicon_toxicity.train(docs.selectExpr("doc_id as id", "text"), known), docs, labels


def test_held_out_accuracy(spark):
    rows = queries.op11_fuzzy_lexicon(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert len(rows) > 500 and (rows["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5) == 0).all()
    assert (rows["predicted"] == rows["toxic"]).mean() > 0.97
    assert rows["predicted"][rows["toxic"] == 1].mean() > 0.85 and rows["predicted"][rows["toxic"] == 0].mean() < 0.01
    assert ((rows["score"] >= 0) & (rows["score"] <= 1)).all()


def test_hits_and_scores_equal_brute_force(model_and_rows):
    model, docs, _ = model_and_rows
    entries, seen = model.lexicon.entries, {}
    for r in docs.where("length(text) < 3000").orderBy("doc_id").limit(250).collect():
        ((n, hits),) = model.lexicon.hits([r["text"]])
        words = [(m.group(), m.start()) for m in re.finditer(r"[^\W_]+(?:[@$*!]{1,2}[^\W_]+)*", r["text"].lower())]
        want = []
        for w, at in words:
            best = seen.setdefault(w, recognised(w, entries))
            if best and not (best[0] and w in model.lexicon.safe):
                want.append((w, at, best[0]))
        assert n == len(words) and [h[1:4] for h in hits] == want
        strongest = {}
        for e, _, _, _, s in hits:
            strongest[e] = max(s, strongest.get(e, 0))
        parts = [model.weight[e] * s for e, s in strongest.items()]
        x = [min(sum(parts), 12), min(max(parts, default=0), 6), min(np.log1p(100 * sum(model.weight[h[0]] * h[4] for h in hits) / max(n, 1)), 4)]
        assert abs(model.score(n, hits) - 1 / (1 + np.exp(-(np.dot(model.last[:-1], x) + model.last[-1])))) < 1e-9


def test_misspelt_terms_are_caught_and_quotation_weighs_less(model_and_rows):
    model, _, _ = model_and_rows
    of = lambda text: model.score(*next(iter(model.lexicon.hits([text]))))
    filler = "the and of ther ing " * 6
    assert of(filler) < 0.1 and of("") < 0.1
    for bad in ("worthless trash", "wrothless trash", "worthl3ss idi0t", "patethic idiott"):
        assert of(f"{filler} you {bad} {filler}") > 0.5
    assert of(f'{filler} they wrote "worthless trash" on it {filler}') < of(f"{filler} worthless trash {filler}") - 0.2


def test_held_out_labels_are_never_learned(spark):
    some, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - toxic, toxic) as toxic")
    scores = [sorted((r["id"], r["score"]) for r in lexicon_toxicity.score(some, x, train_on=lexicon_toxicity.fold() != 0).select("id", "score").collect()) for x in (labels, turned)]
    assert scores[0] == scores[1]


def test_odd_rows_and_labels(spark, odd, none):
    texts = [f"{'vile' if i % 2 else 'fine'} text number {i} {'grobian' if i % 2 else 'gentle'}" for i in range(60)]
    docs = make(spark, texts, first=1000).unionByName(odd)
    rows = [(1000 + i, i % 2) for i in range(60)] + [(0, 0), (0, 0), (3, None), (None, 1), (2, 0), (4, 5)]
    labels = spark.createDataFrame(rows, "doc_id bigint, toxic int")
    found = lexicon_toxicity.score(docs, labels).toPandas()
    assert len(found) == docs.where("doc_id is not null").count()
    bad = found[found["score"] >= 0.5]["id"]
    assert set(bad) == {1000 + i for i in range(60) if i % 2}
    assert {h["term"] for hits in found["hits"] for h in hits} <= {"vile", "grobian", "text", "vil*", "gro*", "grob*", "grobi*", "grobia*"}
    assert lexicon_toxicity.score(none, labels).count() == 0
    for few in (labels.limit(0), labels.where("toxic = 1")):
        assert {r["score"] for r in lexicon_toxicity.score(odd, few).collect()} == {0.0}
