"""Operator 11: toxicity by a lexicon trie intersected with Levenshtein automata, with scores of the context windows.

The lexicon is learned from labelled texts: the words, and the stems of words, that are surely more frequent in toxic texts.
The automaton (levenshtein.py) finds them in every text, misspelt ones too (an edit from five letters on, two from eight); a misspelling
that clean labelled texts hold as a word of their own is none.  The window around each hit tells abuse from quotation: a
hit between quotation marks or behind a word of reporting counts less, one beside an address more.  A text's
evidence is the sum over the lexicon of what an entry's strongest hit counts times its weight; weights come from one logistic regression on these
strengths, in which entries that only occur beside the telling ones (in copies of one text) get little, and a second one
turns evidence, strongest hit and their share of the words into the score.

Fitted on at most FIT_ROWS labelled rows, the first by hash of their id; of rows of one id and of equal texts one counts.  Without
both labels in that sample every score is 0.  Texts are scored whole, from nothing but the text.  Null, empty and blank texts have no hit
and the score of such a text; rows without an id are left out; repeated ids keep their rows; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordhash as W
from .common import cut, text_batches
from .levenshtein import Automaton, words_of

FIT_ROWS = 20_000
#: Letters of a stem; log-likelihood against chance and log-odds that an entry needs.
STEMS, SURE, ODDS = range(3, 8), 12.0, 1.5
#: Weight that an entry needs beside all others.
LEAST_WEIGHT = 0.4
#: What a hit counts is multiplied by these: for each edit, between quotation marks, behind reporting, beside an address.
EDIT, QUOTED, REPORTED, ADDRESSED = 0.75, 0.3, 0.6, 1.2
#: Letters before and after a hit that belong to its window; words of it that are looked at for reporting and address.
WINDOW, NEAR_WORDS = 80, 4
#: Letters of texts that are searched at a time.
BLOCK = 1 << 19
# Words of reporting and of address, and quotation marks that open and close.
REPORTS = frozenset("said says say saying called calls calling word words term terms quote quoted quotes wrote writes insult insults slur slurs mot mots dit wort sagte schrieb palabra dijo".split())
ADDRESSES = frozenset("you your youre yourself yours du dich dir dein tu toi te vous ton usted".split())
OPENING, CLOSING = "“„«‹", "”»›"
HITS = "array<struct<term string, word string, at long, edits int, strength double>>"
_LETTERS_ONLY = re.compile(r"[^\W_]+")


def strength(before: str, after: str, edits: int) -> float:
    """What a hit counts between what stands before and after it."""
    before, after = before.rpartition("\n")[2], after.partition("\n")[0]
    straight = before.count('"') % 2 == 1 and '"' in after
    open_ = max(before.rfind(c) for c in OPENING) > max(before.rfind(c) for c in CLOSING) and any(c in after for c in CLOSING + "“")
    words, later = _LETTERS_ONLY.findall(before)[-NEAR_WORDS:], _LETTERS_ONLY.findall(after)[:NEAR_WORDS]
    out = EDIT**edits
    if straight or open_:
        out *= QUOTED
    if REPORTS & set(words):
        out *= REPORTED
    elif ADDRESSES & set(words + later):
        out *= ADDRESSED
    return out


class Lexicon:
    """Entries (text, whether a stem) and the words that are none of their misspellings."""

    def __init__(self, entries: list[tuple[str, bool]], safe: frozenset[str] = frozenset(), edits: bool = True):
        self.entries, self.safe, self.automaton = entries, safe, Automaton(entries, edits)

    def hits(self, texts: list[str]) -> Iterator[tuple[int, list[tuple[int, str, int, int, float]]]]:
        """Of each text its number of words and its hits (entry, word, place, edits, strength)."""
        letters, starts, ends, firsts = words_of(texts)
        which, entries, edits = self.automaton.matches(letters, starts, ends)
        bounds = np.searchsorted(starts, np.append(firsts, len(letters) + 1))
        own: dict[int, list] = defaultdict(list)
        string = lambda a, b: letters[a:b].tobytes().decode("utf-32-le", "replace")
        for text, w, entry, e in zip((np.searchsorted(firsts, starts[which], "right") - 1).tolist(), which.tolist(), entries.tolist(), edits.tolist(), strict=True):
            a, b = int(starts[w]), int(ends[w])
            word = string(a, b)
            if not e or word not in self.safe:
                own[text].append((entry, word, a - int(firsts[text]), e, strength(string(max(a - WINDOW, int(firsts[text])), a), string(b, b + WINDOW), e)))
        for i in range(len(texts)):
            yield int(bounds[i + 1] - bounds[i]), own[i]


def in_blocks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of about BLOCK letters; null texts are empty."""
    first, size, block = 0, 0, []
    for i, t in enumerate(texts):
        if block and size + len(t or "") > BLOCK:
            yield first, block
            first, size, block = i, 0, []
        block.append(t or "")
        size += len(t or "")
    if block:
        yield first, block


# ---- the model


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, stem, hit, n: the batch's toxic and all texts with each word and stem."""
    for batch in W.slices(batches):
        n, hit = Counter(), Counter()
        for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
            own: set = set()
            for _, texts in in_blocks([text]):
                letters, starts, ends, _ = words_of(texts)
                small = letters.tobytes().decode("utf-32-le", "replace")
                own = {small[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)}
            own |= {(w[:k],) for w in own for k in STEMS if len(w) >= k}  # stems as tuples
            n.update(own)
            if y:
                hit.update(own)
        terms = list(n)
        names = [t[0] if isinstance(t, tuple) else t for t in terms]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([isinstance(t, tuple) for t in terms]), pa.array([hit[t] for t in terms], pa.int64()), pa.array([n[t] for t in terms], pa.int64())], names=["term", "stem", "hit", "n"])


def choose(rows: list[tuple[str, bool, int, int]], yes: int, no: int) -> list[tuple[str, bool]]:
    """The entries among (term, stem, hit, n), the surest first: not a stem of which one word or longer stem has nearly all hits,
    and not what a stem with as good odds has already."""
    odds = {(t, s): np.log((h + 0.5) / (yes + 1)) - np.log((n - h + 0.5) / (no + 1)) for t, s, h, n in rows}
    sure = {(t, s): h * np.log(h * (yes + no) / (n * yes)) for t, s, h, n in rows}
    good = {(t, s): h for t, s, h, _ in rows if odds[t, s] >= ODDS and sure[t, s] >= SURE}
    best: dict[str, int] = defaultdict(int)  # of each stem the hits of its best longer form
    for (t, s), h in good.items():
        for k in STEMS:
            if k < len(t) or k == len(t) and not s:
                best[t[:k]] = max(best[t[:k]], h)
    good = {e: h for e, h in good.items() if not e[1] or best[e[0]] < 0.95 * h}
    covered = lambda t, s: any((t[:k], True) in good and odds[t[:k], True] >= odds[t, s] - 1 for k in STEMS if k < len(t) or k == len(t) and not s)
    return sorted((e for e in good if not covered(*e)), key=lambda e: (-sure[e], e))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 50) -> np.ndarray:
    """Weights (the last one the bias) of a logistic regression, by Newton's method."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g, h = z.T @ (p - y) / len(y) + ridge * w, (z * (p * (1 - p))[:, None]).T @ z / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_weights(strengths: list[dict[int, float]], y: np.ndarray, entries: int, ridge: float = 1e-4, steps: int = 400) -> np.ndarray:
    """A weight for each entry, none below zero: logistic regression by accelerated descent with steps scaled to each entry."""
    row = np.repeat(np.arange(len(strengths)), [len(s) for s in strengths])
    at = np.fromiter((e for s in strengths for e in s), np.int64, len(row))
    x = np.fromiter((v for s in strengths for v in s.values()), np.float64, len(row))
    n = len(y)
    many = max(1.0, np.bincount(row, minlength=n).max(initial=1))
    scale = 0.25 * np.bincount(at, x * x, entries) / n * many + ridge
    w, last, bias, last_bias = np.zeros(entries), np.zeros(entries), 0.0, 0.0
    for step in range(1, steps + 1):
        push = (step - 1) / (step + 2)
        v, c = w + push * (w - last), bias + push * (bias - last_bias)
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, x * v[at], n) + c, -30, 30)))
        last, last_bias = w, bias
        w = np.maximum(v - (np.bincount(at, x * (p - y)[row], entries) / n + ridge * v) / scale, 0)
        bias = c - 2 * float((p - y).mean())
    return w


def features(strongest: dict[int, float], total: float, n_words: int, weight: np.ndarray) -> list[float]:
    """Of a text: evidence, its strongest part, and the weighted share of hits among its words."""
    parts = [weight[e] * s for e, s in strongest.items()]
    return [min(sum(parts), 12.0), min(max(parts, default=0.0), 6.0), min(float(np.log1p(100 * total / max(n_words, 1))), 4.0)]


class Model:
    def __init__(self, lexicon: Lexicon, weight: np.ndarray, last: np.ndarray):
        self.lexicon, self.weight, self.last = lexicon, weight, last

    def score(self, n_words: int, hits: list) -> float:
        strongest: dict[int, float] = {}
        for entry, _, _, _, s in hits:
            strongest[entry] = max(s, strongest.get(entry, 0.0))
        x = features(strongest, sum(self.weight[h[0]] * h[4] for h in hits), n_words, self.weight)
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.last[:-1], x) + self.last[-1], -30, 30))))


def _found(batches: Iterator[pa.RecordBatch], lexicon) -> Iterator[pa.RecordBatch]:
    """y, words and hits of labelled texts."""
    for batch in W.slices(batches):
        out: list[tuple] = []
        for _, texts in in_blocks(batch.column("text").to_pylist()):
            for n, hits in lexicon.value.hits(texts):
                grouped: dict[tuple[int, str], list] = {}
                for entry, word, _, edits, s in hits:
                    g = grouped.setdefault((entry, word if edits else ""), [0.0, 0.0])
                    g[0], g[1] = max(g[0], s), g[1] + s
                out.append((n, [{"entry": e, "word": w, "strongest": a, "total": b} for (e, w), (a, b) in grouped.items()]))
        kind = pa.list_(pa.struct([("entry", pa.int32()), ("word", pa.string()), ("strongest", pa.float64()), ("total", pa.float64())]))
        yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array([n for n, _ in out], pa.int64()), pa.array([h for _, h in out], kind)], names=["y", "n", "hits"])


def _labelled_hits(rows: DataFrame, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, list[list[dict]]]:
    """(labels, numbers of words, hits) of the sample, in an order of their own, so that sums don't depend on the order of arrival."""
    sent = rows.sparkSession.sparkContext.broadcast(lexicon)
    found = rows.mapInArrow(partial(_found, lexicon=sent), "y int, n long, hits array<struct<entry int, word string, strongest double, total double>>").toPandas()
    sent.unpersist()
    hits = [sorted((dict(h.asDict() if hasattr(h, "asDict") else h) for h in x), key=lambda h: (h["entry"], h["word"])) for x in found["hits"]]
    order = sorted(range(len(found)), key=lambda i: (found["y"][i], found["n"][i], str(hits[i])))
    return found["y"].to_numpy(np.float64)[order], found["n"].to_numpy()[order], [hits[i] for i in order]


def _strongest(hits: list[dict]) -> dict[int, float]:
    out: dict[int, float] = {}
    for h in hits:
        out[h["entry"]] = max(h["strongest"], out.get(h["entry"], 0.0))
    return out


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model | None:
    """The model from the first ``fit_rows`` of ``labels`` (id, y) by hash of the id; None if they hold one class only."""
    first = F.broadcast(labels.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(fit_rows))
    text = F.coalesce("text", F.lit(""))
    rows = docs.join(first, "id").groupBy("id", "y").agg(F.min(text).alias("text")).groupBy("text").agg(F.max("y").alias("y"))
    rows = cut(rows, "op11-sample")
    of = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(of) < 2:
        return None
    stats = rows.mapInArrow(_counted, "term string, stem boolean, hit long, n long").groupBy("term", "stem").agg(F.sum("hit").alias("hit"), F.sum("n").alias("n"))
    stats = stats.where(f"hit > 1 and ln((hit + 0.5) / {of[1] + 1}) - ln((n - hit + 0.5) / {of[0] + 1}) >= {ODDS} and hit * ln(hit * {of[0] + of[1]} / (n * {of[1]})) >= {SURE}")
    entries = choose([tuple(r) for r in stats.collect()], of[1], of[0])
    # entries that tell nothing beside the others go
    y, _, hits = _labelled_hits(rows, Lexicon(entries, edits=False))
    weight = fit_weights([_strongest(h) for h in hits], y, len(entries))
    entries = [e for e, w in zip(entries, weight, strict=True) if w >= LEAST_WEIGHT]
    y, n_words, hits = _labelled_hits(rows, Lexicon(entries))
    # a misspelling is a word of its own if clean texts hold it about as often as others do
    held, clean = Counter(), Counter()
    for label, found in zip(y, hits, strict=True):
        for word in {h["word"] for h in found if h["word"]}:
            held[word] += 1
            clean[word] += label == 0
    safe = frozenset(w for w, c in clean.items() if c * (of[0] + of[1]) > 0.3 * held[w] * of[0])
    hits = [[h for h in found if h["word"] not in safe] for found in hits]
    strongest = [_strongest(h) for h in hits]
    weight = fit_weights(strongest, y, len(entries))
    x = np.array([features(s, sum(weight[h["entry"]] * h["total"] for h in found), n, weight) for s, found, n in zip(strongest, hits, n_words, strict=True)])
    return Model(Lexicon(entries, safe), weight, logistic(x, y, 1e-4))


# ---- scoring

_MODELS: dict[str, Model] = {}


def _scored(batches: Iterator[pa.RecordBatch], model, name: str) -> Iterator[pa.RecordBatch]:
    if name not in _MODELS:  # the automaton's states stay for the worker's next task
        _MODELS.clear()
        _MODELS[name] = model.value
    m = _MODELS[name]
    kind = pa.list_(pa.struct([("term", pa.string()), ("word", pa.string()), ("at", pa.int64()), ("edits", pa.int32()), ("strength", pa.float64())]))
    for batch in W.slices(batches):
        scores, listed = [], []
        texts = batch.column("text").to_pylist()
        for _, block in in_blocks(texts) if m else ():
            for n, hits in m.lexicon.hits(block):
                scores.append(m.score(n, hits))
                listed.append([{"term": m.lexicon.entries[e][0] + "*" * m.lexicon.entries[e][1], "word": w, "at": a, "edits": d, "strength": s} for e, w, a, d, s in hits])
        if not m:
            scores, listed = [0.0] * len(texts), [[] for _ in texts]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores, pa.float64()), pa.array(listed, kind)], names=["id", "score", "hits"])


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", train_on: Column | None = None, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per document: id, score, hits (term, ending in * for a stem; word as found, in small letters; its place; edits; strength).

    ``train_on``: a condition over ``id`` that labelled rows must meet to be learned from."""
    docs = text_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    model = train(docs, known if train_on is None else known.where(train_on), fit_rows)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(partial(_scored, model=sent, name=uuid.uuid4().hex), f"id long, score double, hits {HITS}")


def fold(folds: int = 5) -> Column:
    """The remainder of the crc32 of ``id`` as text."""
    return F.crc32(F.col("id").cast("string").cast("binary")) % folds
