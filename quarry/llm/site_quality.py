"""Operator 4: quality classifier with hierarchical empirical Bayes over hosts and paths.

A logistic regression on form (rates of capitals, digits, marks, bytes outside ASCII; word lengths; repetition) gives each document
evidence p.  Sums of p over all documents of each host and of each path of a host, and over everything, give
posterior means: a host's shrinks to the global mean, a path's to its host's, each with the prior strength that an analysis of
variance between and within the groups estimates, so sparse sites follow their prior and large ones their own record.
A document's score is its own log-odds plus a weighted shift of its path's log-odds from the global.

A second evidence, of toxicity, is a logistic regression on the presence of words (by 64-bit hashes), fitted on the toxic labels in the
same way where the labels have them, with host and path posteriors of its own; it gives the column toxic, and ``keep`` stays the
decision on quality.  Its candidates are the words that are surely more frequent in toxic texts; fitted together,
words that only occur beside the telling ones (in copies of one text) get no weight.

The classifier is fitted on at most FIT_ROWS labelled rows, the first by hash of their id; everything else covers all
documents.  Without both labels in that sample the evidence is 0.5 for all.  Null and empty texts have the features of an
empty text; null hosts or paths form one group; rows without an id are left out; repeated ids keep their rows; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as W
from .common import cut, small_side, text_batches

FIT_ROWS = 20_000
SITE_WEIGHT = 0.5
KEEP_FROM = 0.5
REJECT_FROM = 0.5
#: Log-likelihood against chance that a word of the toxic model needs; all that have it are fitted.
WORD_SURE = 15.0
FEATURES = ("words", "word_length", "capitals", "digits", "stops", "marks", "wide", "lines", "distinct", "top", "marked", "shouted")

_KIND = np.full(256, 5, np.uint8)  # 0 capital, 1 digit, 2 full stop or comma, 3 other mark, 4 byte outside ASCII, 5 else, 6 line feed
for _c in range(256):
    _x = chr(_c)
    if _c >= 128:
        _KIND[_c] = 4
    elif _x.isupper():
        _KIND[_c] = 0
    elif _x.isdigit():
        _KIND[_c] = 1
    elif _x in ".,":
        _KIND[_c] = 2
    elif 32 < _c < 127 and not _x.isalnum():
        _KIND[_c] = 3
    elif _x == "\n":
        _KIND[_c] = 6


def features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    out = np.zeros((len(texts), len(FEATURES)))
    for b in W.blocks(texts):
        n = len(b)
        kind = _KIND[b.data]
        size = np.maximum(np.diff(b.bounds), 1)

        def rate(k, kind=kind, b=b):
            return np.diff(np.concatenate(([0], np.cumsum(kind == k)))[b.bounds])

        words = np.diff(b.first)
        some = np.maximum(words, 1)
        part = out[b.row : b.row + n]
        part[:, 0] = np.log1p(words)
        total = np.concatenate(([0], np.cumsum(b.ends - b.starts)))
        part[:, 1] = np.log1p(np.diff(total[b.first]) / some)
        for column, k in ((2, 0), (3, 1), (4, 2), (5, 3), (6, 4), (7, 6)):
            part[:, column] = np.sqrt(rate(k) / size)
        if len(b.starts):
            mark = np.concatenate(([0], np.cumsum(kind == 3)))
            marked = np.concatenate(([0], np.cumsum(mark[b.ends] > mark[b.starts])))
            capital = np.concatenate(([0], np.cumsum(kind == 0)))
            shouted = np.concatenate(([0], np.cumsum((capital[b.ends] - capital[b.starts]) * 2 > (b.ends - b.starts))))
            part[:, 10] = np.diff(marked[b.first]) / some
            part[:, 11] = np.diff(shouted[b.first]) / some
            hashes = W.FIRST.spans(b.data, b.starts, b.ends, True)
            for i in np.flatnonzero(words):
                h = np.sort(hashes[b.first[i] : b.first[i + 1]])
                turn = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1], [True])))
                # distinct words against what a text of this length has: n ** 0.75
                part[i, 8] = (len(turn) - 1) / len(h) ** 0.75
                part[i, 9] = np.diff(turn).max() / len(h)
    return out


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights): logistic regression on standardised features and their squares, by Newton's method."""
    x = np.hstack([x, x * x])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) / len(y) + ridge * w
        h = (z * (p * (1 - p))[:, None]).T @ z / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def log_odds(x: np.ndarray, model) -> np.ndarray:
    if model is None:
        return np.zeros(len(x))
    mean, scale, w = model
    z = (np.hstack([x, x * x]) - mean) / scale
    return np.clip(np.clip(z, -8, 8) @ w[:-1] + w[-1], -12, 12)


_OUTER = np.zeros(257, bool)  # marks that are cut from both ends of a word; 256 lies outside all texts
_OUTER[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def word_hashes(texts: pa.Array):
    """(row, hashes of its words, one after the other) for each block of texts, as (rows, hashes): words in small ASCII letters, without
    the marks around them, by 64 bits."""
    for b in W.blocks(texts):
        starts, ends = b.starts.copy(), b.ends.copy()
        for edge, step in ((starts, 1), (ends, -1)):
            left = np.arange(len(starts))
            while len(left):
                left = left[(starts[left] < ends[left]) & _OUTER[b.data[np.minimum(edge[left] - (step < 0), len(b.data) - 1)]]]
                edge[left] += step
        some = np.flatnonzero(starts < ends)
        rows = b.row + np.repeat(np.arange(len(b)), np.diff(b.first))
        yield rows[some], W.FIRST.spans(b.data, starts[some], ends[some], True).view(np.int64)


def held_words(texts: pa.Array, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, places in the sorted hashes ``words``): each once for a text that holds the word."""
    found = [np.zeros(0, np.int64)]
    for rows, hashes in word_hashes(texts) if len(words) else ():
        at = np.searchsorted(words, hashes)
        ok = words[np.minimum(at, len(words) - 1)] == hashes
        found.append(np.unique(rows[ok] * len(words) + at[ok]))
    found = np.concatenate(found)
    return np.divmod(found, max(len(words), 1))


def surely_toxic(hit: np.ndarray, n: np.ndarray, yes: int, no: int) -> np.ndarray:
    """Whether words that ``hit`` toxic and ``n`` labelled texts hold are surely more frequent in toxic ones."""
    more = (hit + 0.5) / (yes + 1) > (n - hit + 0.5) / (no + 1)
    return more & (hit * np.log(np.maximum(hit, 1) * (yes + no) / np.maximum(n * yes, 1)) >= WORD_SURE)


def fit_words(row: np.ndarray, at: np.ndarray, y: np.ndarray, m: int, ridge: float = 1e-5, steps: int = 400) -> tuple[np.ndarray, float]:
    """(weight of each of m words, bias): logistic regression on the words ``at`` that texts ``row`` hold, by accelerated descent with steps
    scaled to each word's frequency.  Only what speaks for label 1 counts: weights are not negative."""
    n = len(y)
    scale = 0.25 * (np.bincount(at, minlength=m) / n + 1e-3) * max(1.0, np.bincount(row, minlength=n).mean()) + ridge
    rate = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    w, bias = np.zeros(m), float(np.log(rate / (1 - rate)))
    last_w, last_bias = w, bias
    for step in range(1, steps + 1):
        push = (step - 1) / (step + 2)
        v, c = w + push * (w - last_w), bias + push * (bias - last_bias)
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, v[at], n) + c, -30, 30)))
        last_w, last_bias = w, bias
        w = np.maximum(v - (np.bincount(at, (p - y)[row], m) / n + ridge * v) / scale, 0)
        bias = c - 2 * float((p - y).mean())
    return w, bias


def _word_rows(batches):
    """Of each hash the batch's toxic and all texts that hold it."""
    for batch in W.slices(batches):
        y = np.asarray(batch.column("y"), np.int64)
        for rows, hashes in word_hashes(W.column(batch, "text")):
            order = np.lexsort((hashes, rows))
            rows, hashes = rows[order], hashes[order]
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
            words, of = np.unique(hashes[new], return_inverse=True)
            hit = np.bincount(of, y[rows[new]], len(words)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(hit), pa.array(np.bincount(of, minlength=len(words)).astype(np.int64))], names=["word", "hit", "n"])


def _feature_rows(batches):
    for batch in W.slices(batches):
        x = features(W.column(batch, "text"))
        at = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("y"), pa.ListArray.from_arrays(pa.array(at), pa.array(x.ravel()))], names=["y", "x"])


def word_odds(texts: pa.Array, model) -> np.ndarray:
    words, weight, bias = model
    rows, at = held_words(texts, words)
    return np.clip(bias + np.bincount(rows, weight[at], len(texts)), -12, 12)


def _evidence(batches, model):
    quality, words = model.value
    for batch in W.slices(batches):
        texts = W.column(batch, "text")
        odds = log_odds(features(texts), quality)
        toxic = word_odds(texts, words) if words else np.full(len(odds), -12.0)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "host", "path")), pa.array(odds), pa.array(toxic)], names=["id", "host", "path", "odds", "toxic_odds"])


def _first_labels(labels: DataFrame, fit_rows: int) -> DataFrame:
    return F.broadcast(labels.where("id is not null and y is not null").orderBy(F.xxhash64("id"), "id", "y").limit(fit_rows))


def _held(batches, words):
    for batch in W.slices(batches):
        rows, at = held_words(W.column(batch, "text"), words.value)
        bounds = np.searchsorted(rows, np.arange(batch.num_rows + 1))
        yield pa.RecordBatch.from_arrays([batch.column("y"), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(at.astype(np.int32)))], names=["y", "x"])


def train_words(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS):
    """(sorted hashes of words, their weights, bias) from the same sample of labels (id, y); None if it holds one class only."""
    rows = cut(docs.join(_first_labels(labels, fit_rows), "id").select("y", "text"), "op4-labelled")
    of = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(of) < 2:
        return None
    counts = rows.mapInArrow(_word_rows, "word long, hit long, n long").groupBy("word").agg(F.sum("hit").alias("hit"), F.sum("n").alias("n"))
    counts = counts.where(f"hit > 1 and hit * ln(hit * {of[0] + of[1]} / (n * {of[1]})) >= {WORD_SURE} - 1").toPandas()  # one document is never sure
    counts = counts[surely_toxic(counts["hit"].to_numpy(np.float64), counts["n"].to_numpy(np.float64), of[1], of[0])]
    words = np.sort(counts["word"].to_numpy(np.int64))
    sent = docs.sparkSession.sparkContext.broadcast(words)
    found = rows.mapInArrow(partial(_held, words=sent), "y int, x array<int>").toPandas()
    held, y = [np.asarray(x, np.int64) for x in found["x"]], found["y"].to_numpy(np.float64)
    order = sorted(range(len(y)), key=lambda i: (y[i], held[i].tobytes()))  # the sums then don't depend on the order of arrival
    held = [held[i] for i in order]
    return words, *fit_words(np.repeat(np.arange(len(y)), [len(x) for x in held]), np.concatenate(held), y[order], len(words))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS):
    """The model from the first ``fit_rows`` labels (id, y) by hash of the id; None if they hold one class only."""
    rows = docs.join(_first_labels(labels, fit_rows), "id").select("y", "text").mapInArrow(_feature_rows, "y int, x array<double>").toPandas()
    y = rows["y"].to_numpy(np.float64)
    if len(set(y)) < 2:
        return None
    order = np.lexsort(np.vstack([*np.stack(rows["x"]).T, y]))  # the sums then don't depend on the order of arrival
    return fit(np.stack(rows["x"])[order], y[order])


def _strength(groups: DataFrame, own_mean: str) -> float:
    """Prior strength of groups (n, s: sum of p, q: sum of p * p) around the column ``own_mean``: variance within over
    variance between, from the analysis of variance; a very large one if nothing lies between."""
    r = groups.agg(
        F.count("*").alias("g"), F.sum("n").alias("n"), F.sum(F.expr("n * 1d * n")).alias("nn"), F.sum(F.expr("q - s * s / n")).alias("within"),
        F.sum(F.expr(f"n * pow(s / n - {own_mean}, 2)")).alias("between"),
    ).first()
    if not r["n"] or r["g"] < 2 or r["n"] <= r["g"]:
        return 100.0
    within = max(r["within"] / (r["n"] - r["g"]), 1e-9)
    spread = (r["between"] - (r["g"] - 1) * within) / max(r["n"] - r["nn"] / r["n"], 1e-9)
    return float(min(max(within / spread, 1.0), 1e6)) if spread > 0 else 1e6


def _with_sites(rows: DataFrame, odds: str, site_weight: float, names: tuple[str, str, str]) -> DataFrame:
    """``rows`` with the posterior means of host and path and the score that the column ``odds`` gives, under ``names``."""
    host_mean, path_mean, name = names
    p = F.expr(f"1 / (1 + exp(-{odds}))")
    sums = [F.count("*").alias("n"), F.sum(p).alias("s"), F.sum(p * p).alias("q")]
    paths = cut(rows.groupBy("host", "path").agg(*sums), "op4-paths")
    hosts = paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")])
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    middle = (whole["s"] / whole["n"]) if whole["n"] else 0.5
    k_host = _strength(hosts, str(float(middle)) + "d")
    hosts = hosts.select(F.col("host").alias("h"), F.expr(f"(s + {k_host}d * {middle}d) / (n + {k_host}d)").alias("host_mean"))
    paths = cut(paths.join(hosts, F.expr("host <=> h")).drop("h"), "op4-path-means")
    k_path = _strength(paths, "host_mean")
    sites = paths.select(F.col("host").alias("h"), F.col("path").alias("t"), F.col("host_mean").alias(host_mean), F.expr(f"(s + {k_path}d * host_mean) / (n + {k_path}d)").alias(path_mean))
    scored = rows.join(small_side(sites, 100_000), F.expr("host <=> h and path <=> t")).drop("h", "t")
    shift = f"ln({path_mean} / (1 - {path_mean})) - ln({middle}d / (1 - {middle}d))"
    return scored.withColumn(name, F.expr(f"1 / (1 + exp(-({odds} + {site_weight}d * ({shift}))))"))


def score(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: str = "source", path: str = "concat_ws('/', source, lang)",
    label: str = "quality", fit_rows: int = FIT_ROWS, site_weight: float = SITE_WEIGHT, keep_from: float = KEEP_FROM, toxic_label: str = "toxic", reject_from: float = REJECT_FROM,
) -> DataFrame:
    """One row per document: id, evidence, host_mean, path_mean, score, keep, toxic_score, toxic.  host and path are expressions over docs."""
    spark = docs.sparkSession
    docs = text_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.expr(host).alias("host"), F.expr(path).alias("path")).where("id is not null")
    of = lambda c: labels.select(F.col(id_col).cast("long").alias("id"), F.col(c).cast("int").alias("y")).where("y in (0, 1)")
    texts = docs.select("id", "text")
    words = train_words(texts, of(toxic_label), fit_rows) if toxic_label in labels.columns else None
    model = spark.sparkContext.broadcast((train(texts, of(label), fit_rows), words))
    rows = docs.mapInArrow(partial(_evidence, model=model), "id long, host string, path string, odds double, toxic_odds double")
    rows = cut(rows.withColumn("p", F.expr("1 / (1 + exp(-odds))")), "op4-evidence")
    scored = _with_sites(rows, "odds", site_weight, ("host_mean", "path_mean", "score"))
    toxic = F.lit(0.0)
    if words:
        scored, toxic = _with_sites(scored, "toxic_odds", site_weight, ("toxic_host", "toxic_path", "toxic_score")), F.col("toxic_score")
    return scored.select(
        "id", F.col("p").alias("evidence"), "host_mean", "path_mean", "score", (F.col("score") >= keep_from).alias("keep"),
        toxic.alias("toxic_score"), (toxic >= reject_from).alias("toxic"),
    )
