"""Operator 3: document quality by ordinal cumulative-link regression on graded ratings.

Grades are ordered, P(grade <= j) = sigmoid(theta_j - score), with one weight vector shared by all grades and ordered thresholds.
The score of a document is the sum of the weights of the distinct features of its whole text: hashes of its words and of their
first four and five bytes, of its runs of signs, and of the levels of a few measures (share of capitals, of symbols, of distinct words, of the
commonest word, word length). The model returns the expected grade and the probability of each tail; a document is
kept if the probability of the best grade reaches KEEP, which lies below one half to spare clean documents.

The weights are fitted on a sample of about SAMPLE labelled documents, drawn by a hash of the id, so that only the sample's
features reach the driver; features in fewer than LEAST_SHARE of the sample (LEAST at least) have no weight. Scoring reads every document
once, with the weight table (at most as large as the sample's vocabulary) sent to each executor.

Grades of the label table: 0 toxic, 1 not toxic but of low quality, 2 neither. Defined results: a null label counts as 0 in its
column, a label without a document or with a null id is ignored, repeated labels of one id count by their worst grade. Null or
empty text has only the measures' features. Without any label, or with one grade only, thresholds follow the grades' smoothed
shares and every document gets the same probabilities. Rows are scored one by one, repeated or with null id as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tribolens.llm.words import Words, chunks, mix, split, text_bytes, word_hashes

GRADES = 3
SAMPLE = 10_000
LEAST, LEAST_SHARE = 3, 0.002
STEPS, RATE, DECAY = 200, 0.05, 1e-3
KEEP = 0.35
NOT_WORD = bytes(b for b in range(128) if not chr(b).isalnum())
NOT_SIGN = bytes(b for b in range(256) if b > 127 or b < 33 or chr(b).isalnum())
LEVELS = 12
FILTER_BITS = 23


class Model(NamedTuple):
    """Sorted feature hashes, their weights, thresholds below grade 1, 2, ..."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray


def measures(texts: pa.Array, words: Words, hashes: np.ndarray) -> np.ndarray:
    """A row per text: levels of its measures."""
    data, places = text_bytes(texts)
    bounds, size = words.bounds, np.maximum(np.diff(places), 1)

    def share(kind: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(kind[data])])
        return (total[places[1:]] - total[places[:-1]]) / size

    code = np.arange(256)
    capitals = share((code >= 65) & (code <= 90))
    symbols = share((code > 32) & (code < 127) & np.isin(code, list(NOT_WORD)))
    n = np.maximum(np.diff(bounds), 1)
    length = np.concatenate([[0], np.cumsum(words.ends - words.starts)])
    distinct, most = np.ones(len(n)), np.ones(len(n))
    for row, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        if b > a:
            times = np.unique(hashes[a:b], return_counts=True)[1]
            distinct[row], most[row] = len(times) / (b - a), times.max() / (b - a)
    columns = [capitals * 2, symbols * 2, distinct, most, (length[bounds[1:]] - length[bounds[:-1]]) / n / 16]
    return np.stack([np.clip(c * LEVELS, 0, LEVELS - 1) for c in columns], 1).astype(np.int64)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature hashes of all texts one behind the other, and where each text begins."""
    words = split(texts, lower=True, separators=NOT_WORD)
    hashes = word_hashes(words)
    levels = measures(texts, words, hashes)
    signs = split(texts, lower=False, separators=NOT_SIGN)
    runs = mix(word_hashes(signs) + np.uint64(9))
    heads = []
    for size in (4, 5):
        cut = word_hashes(words._replace(ends=np.minimum(words.ends, words.starts + size)))
        heads.append(np.where(words.ends - words.starts > size, mix(cut + np.uint64(size)), hashes))
    named = mix((levels + np.arange(levels.shape[1]) * LEVELS + 1).astype(np.uint64))
    found = []
    for row, (a, b) in enumerate(zip(words.bounds[:-1], words.bounds[1:])):
        marks = runs[signs.bounds[row] : signs.bounds[row + 1]]
        found.append(np.unique(np.concatenate([hashes[a:b], *(h[a:b] for h in heads), marks, named[row]])))
    return np.concatenate(found), np.cumsum([0] + [len(x) for x in found])


def graded(labels: DataFrame) -> DataFrame:
    grade = F.when(F.coalesce("toxic", F.lit(0)) > 0, 0).when(F.coalesce("quality", F.lit(0)) > 0, 2).otherwise(1)
    return labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min(grade).alias("grade"))


def sampled(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Feature lists and grades of about `sample` labelled documents."""
    rated = graded(labels)
    count = max(rated.count(), 1)
    share = min(1.0, sample / count)
    rated = rated.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1.0))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                found, begin = features(part.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(found.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("grade"), lists], names=["grade", "features"])

    rows = (docs.select(F.col("doc_id").cast("long"), "text").join(rated, "doc_id").select("text", "grade")
            .mapInArrow(extract, "grade int, features array<long>").toArrow())
    lists = [np.asarray(x.values.to_numpy()).view(np.uint64) for x in rows.column("features")]
    return lists, rows.column("grade").to_numpy()


def fit(lists: list[np.ndarray], grades: np.ndarray) -> Model:
    """Maximum likelihood with weight decay, by full-batch Adam; grades count by the root of their inverse frequency."""
    counts = np.bincount(grades.astype(np.int64), minlength=GRADES) + 0.5
    below = np.cumsum(counts)[:-1] / counts.sum()
    theta = np.log(below / (1 - below))
    empty = Model(np.empty(0, np.uint64), np.empty(0), theta)
    if not len(lists) or (counts > 0.5).sum() < 2:
        return empty
    names, place, times = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    frequent = times >= max(LEAST, LEAST_SHARE * len(lists))
    if not frequent.any():
        return empty
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    keep = frequent[place]
    column, row = (np.cumsum(frequent) - 1)[place[keep]].astype(np.int32), row[keep].astype(np.int32)
    names, y = names[frequent], grades.astype(np.int64)
    importance = np.sqrt(counts.sum() / (GRADES * counts))[y]
    importance /= importance.sum()
    edges = np.concatenate([[theta[0]], np.log(np.maximum(np.diff(theta), 1e-3))])
    state = np.zeros(len(names) + GRADES - 1)
    state[len(names):] = edges
    mean, square = np.zeros_like(state), np.zeros_like(state)
    for step in range(1, STEPS + 1):
        weights, edges = state[: len(names)], state[len(names):]
        theta = edges[0] + np.concatenate([[0], np.cumsum(np.exp(edges[1:]))])
        score = np.bincount(row, weights[column], len(lists))
        high = np.where(y < GRADES - 1, theta[np.minimum(y, GRADES - 2)], np.inf) - score
        low = np.where(y > 0, theta[np.maximum(y - 1, 0)], -np.inf) - score
        a, b = sigmoid(low), sigmoid(high)
        p = np.maximum(b - a, 1e-12)
        slope = importance * (1 - a - b)
        gradient = np.empty_like(state)
        gradient[: len(names)] = np.bincount(column, slope[row], len(names)) + DECAY * weights
        up, down = importance * b * (1 - b) / p, importance * a * (1 - a) / p
        to = np.array([down[y == j + 1].sum() - up[y == j].sum() for j in range(GRADES - 1)])
        tail = np.cumsum(to[::-1])[::-1]
        gradient[len(names):] = np.concatenate([tail[:1], tail[1:] * np.exp(edges[1:])])
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        state = state - RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    edges = state[len(names):]
    theta = edges[0] + np.concatenate([[0], np.cumsum(np.exp(edges[1:]))])
    return Model(names, state[: len(names)], theta)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


def scores(texts: pa.Array, model: Model, known: np.ndarray) -> np.ndarray:
    """Sum of weights per text; `known` is a bit table that most features without a weight fail."""
    found, begin = features(texts)
    cell = (found & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
    place = np.flatnonzero((known[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1)
    at = np.searchsorted(model.features, found[place])
    at[at == len(model.features)] = 0
    match = model.features[at] == found[place] if len(model.features) else np.zeros(0, bool)
    place, at = place[match], at[match]
    return np.bincount(np.searchsorted(begin, place, side="right") - 1, model.weights[at], len(texts))


def grade(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, least: float = KEEP) -> DataFrame:
    """`docs` with `expected_grade`, `p_low` (grade 1 or more), `p_best` (the best grade) and `keep`."""
    model = fit(*sampled(docs, labels, sample))
    known = np.zeros(1 << FILTER_BITS, bool)
    known[(model.features & np.uint64(len(known) - 1)).astype(np.int64)] = True
    sent = docs.sparkSession.sparkContext.broadcast((model, np.packbits(known, bitorder="little")))
    added = ["expected_grade", "p_low", "p_best", "keep"]

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = sent.value
        for batch in batches:
            for part in chunks(batch):
                score = scores(part.column("text"), model, known)
                low, best = (1 - sigmoid(t - score) for t in model.thresholds)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(low + best), pa.array(low), pa.array(best),
                                                  pa.array(best >= least)], names=[*part.schema.names, *added])

    docs = docs.drop(*added)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema),
                        "expected_grade double, p_low double, p_best double, keep boolean"])
    return docs.mapInArrow(rate, schema)
