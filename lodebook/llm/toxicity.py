"""Toxicity: a sparse linear classifier with a counterfactual regulariser.

Features are the presence of a word and of the beginning of a longer word (three to eight characters with
more to come), so that a stem is known in all its endings. The weights are fitted by proximal gradient steps
with three penalties: on their squares, on their absolute values (most end at zero), and on the change of
a text's score when its identity terms are swapped for others, so that neutral mentions of a group do not
count against a text.

Labels, language, source and id are never inputs of a score. The classifier is fitted on a sample of at most
about `SAMPLE` labelled rows, chosen by hash among all of them. Null and empty texts get the score of a text
without features. Repeated labels of a document count once, toxic if any is; rows with null ids or labels teach
nothing. `score_texts` keeps the named columns only.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodebook.llm import arrays
from lodebook.session import materialize, ship_package

SAMPLE = 24_000
FEATURES = 6_000
THRESHOLD = 0.3
STEMS = range(3, 9)

#: Terms for groups of people, by kind; a term is swapped for the others of its kind.
IDENTITY_TERMS = {
    "gender": ["woman", "man", "women", "men", "girl", "boy", "transgender", "frau", "mann", "femme", "homme", "mujer", "hombre"],
    "religion": ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"],
    "origin": ["african", "asian", "european", "mexican", "american", "arab", "indian", "chinese", "immigrant", "refugee"],
    "orientation": ["gay", "lesbian", "straight", "bisexual", "queer", "heterosexual"],
    "body": ["disabled", "blind", "deaf", "old", "young", "black", "white"],
}
SWAPS = {term: [t for t in terms if t != term] for terms in IDENTITY_TERMS.values() for term in terms}
_WORD = re.compile(r"[^\W_]+")


def word_features(word: str) -> list[str]:
    """The word itself, and its beginnings that go on."""
    return [word + "$", *[word[:k] + "+" for k in STEMS if len(word) > k]]


SWAP_TYPE = pa.list_(pa.struct([("gone", pa.list_(pa.int32())), ("new", pa.list_(pa.int32()))]))


def swapped(words: set[str]) -> Iterator[tuple[set[str], set[str]]]:
    """Features that vanish and appear for each swap of an identity term among the words of a text for another."""
    for term in sorted(words & SWAPS.keys()):
        rest = {f for w in words - {term} for f in word_features(w)}
        own = set(word_features(term)) - rest
        for other in SWAPS[term]:
            new = set(word_features(other)) - rest
            yield own - new, new - own


@dataclass
class Classifier:
    bias: float
    weights: dict[str, float]

    def __post_init__(self):
        self.stems = {f[:-1] for f in self.weights if f[-1] == "+"}
        self.whole = {f[:-1] for f in self.weights if f[-1] == "$"}
        self.lengths = sorted({len(s) for s in self.stems})

    def logit(self, text: str) -> float:
        found = set(_WORD.findall(text.lower()))
        total = self.bias + math.fsum(self.weights[w + "$"] for w in found & self.whole)
        stems = self.stems & {w[:k] for k in self.lengths for w in found if len(w) > k}
        return total + math.fsum(self.weights[s + "+"] for s in stems)

    def score(self, text: str) -> float:
        x = max(-700.0, min(700.0, self.logit(text)))
        return 1 / (1 + math.exp(-x))


def _fit(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, width: int, swaps: list[tuple[tuple[int, ...], tuple[int, ...], float]],
         ridge: float, lasso: float, fairness: float, steps: int) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient on the mean log loss; rows and cols are the places of ones.

    swaps are the features that vanish and appear in sentences, with the share of the sentences; the shares sum to 1.
    """
    n = len(y)
    per_row = np.bincount(rows, minlength=n)
    reach = sum(share * (len(a) + len(c)) for a, c, share in swaps)  # bounds the curvature of the penalty
    rate = 1.0 / (0.25 * max(1.0, float(np.percentile(per_row, 99)) * 0.25) + ridge + fairness * reach)
    w, b = np.zeros(width), math.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    seen_w, seen_b, t = w.copy(), b, 1.0
    if swaps:
        s_row = np.repeat(np.arange(len(swaps)), [len(a) + len(c) for a, c, _ in swaps])
        s_col = np.array([f for a, c, _ in swaps for f in (*a, *c)], np.int64)
        s_sign = np.array([x for a, c, _ in swaps for x in [1.0] * len(a) + [-1.0] * len(c)])
        s_share = np.array([share for _, _, share in swaps])
    for _ in range(steps):
        z = np.clip(np.bincount(rows, weights=seen_w[cols], minlength=n) + seen_b, -50, 50)
        error = (1 / (1 + np.exp(-z)) - y) / n
        grad = np.bincount(cols, weights=error[rows], minlength=width) + ridge * seen_w
        if swaps:
            change = np.bincount(s_row, weights=s_sign * seen_w[s_col], minlength=len(swaps))
            grad += fairness * np.bincount(s_col, weights=s_sign * (s_share * change)[s_row], minlength=width)
        new_w = seen_w - rate * grad
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - rate * lasso, 0)
        new_b = seen_b - rate * error.sum()
        after = (1 + math.sqrt(1 + 4 * t * t)) / 2
        seen_w, seen_b = new_w + (t - 1) / after * (new_w - w), new_b + (t - 1) / after * (new_b - b)
        w, b, t = new_w, new_b, after
    return b, w


def train_labels(labels: DataFrame) -> DataFrame:
    """doc_id and toxic of the rows that may teach: crc32 of the id modulo 4 is not 2."""
    return (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id")
            .agg(F.max("toxic").alias("toxic"))
            .where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))


def fit_classifier(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES,
                   ridge: float = 1e-5, lasso: float = 2e-4, fairness: float = 1.0, steps: int = 400) -> Classifier:
    """Learn from the labelled texts of docs (doc_id, text).

    A hash of the id picks the sample, so at most about `sample` ids are joined; their features are counted in
    tasks, and the `features` that tell most about the label are fitted on the driver, which holds only the places
    of those features.
    """
    spark = docs.sparkSession
    ship_package(spark)
    ids = train_labels(labels)
    share = min(1.0, sample / max(1, ids.count()))
    ids = ids.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) < int(share * 1_000_000))
    # The hint rests on the bound above: at most about `sample` rows of two numbers.
    texts = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"))
    taught = materialize(texts.join(F.broadcast(ids), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic")),
                         "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for f in {f for w in set(_WORD.findall((text or "").lower())) for f in word_features(w)}:
                    found.setdefault(f, [0, 0])[int(toxic > 0)] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.string()), pa.array([c[1] for c in found.values()], pa.int64()),
             pa.array([c[0] for c in found.values()], pa.int64())], ["feature", "toxic", "clean"])

    totals = taught.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("toxic") > 0).cast("long")), F.lit(0)).alias("t")).first()
    if not totals["t"] or totals["t"] == totals["n"]:
        return Classifier(-10.0 if not totals["t"] else 10.0, {})
    t, c = float(totals["t"]), float(totals["n"] - totals["t"])
    p, q = (F.col("toxic") + 0.5) / (t + 1), (F.col("clean") + 0.5) / (c + 1)
    worth = F.abs(p - q) * F.abs(F.log(p / q))
    best = (taught.mapInArrow(count, "feature string, toxic long, clean long").groupBy("feature")
            .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
            .where(F.col("toxic") + F.col("clean") >= 4)
            .select("feature", worth.alias("worth")).orderBy(F.desc("worth"), "feature").limit(features).collect())
    names = sorted({r["feature"] for r in best} | {f"{term}$" for term in SWAPS})
    index = {f: k for k, f in enumerate(names)}

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, changes = [], []
            for text in batch.column(0).to_pylist():
                words = set(_WORD.findall((text or "").lower()))
                found = {f for w in words for f in word_features(w)}
                rows.append(sorted(index[f] for f in found if f in index))
                changes.append([{"gone": sorted(index[f] for f in gone if f in index), "new": sorted(index[f] for f in new if f in index)}
                                for gone, new in swapped(words)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.list_(pa.int32())), batch.column(1), pa.array(changes, SWAP_TYPE)], ["places", "toxic", "swaps"])

    data = taught.mapInArrow(places, "places array<int>, toxic int, swaps array<struct<gone:array<int>,new:array<int>>>").toArrow()
    lists = data.column("places").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    rows, cols = np.repeat(np.arange(len(sizes)), sizes), lists.flatten().to_numpy().astype(np.int64)
    y = (data.column("toxic").to_numpy() > 0).astype(float)
    # Equal changes of many sentences are one row of the penalty, with their share.
    shares: dict[tuple, float] = {}
    sentences = 0
    for chunk in data.column("swaps").chunks:
        for changes in chunk:
            own = changes.as_py()
            sentences += bool(own)
            for change in own:
                key = tuple(change["gone"]), tuple(change["new"])
                shares[key] = shares.get(key, 0.0) + 1 / len(own)
    swaps = [(*key, shares[key] / sentences) for key in sorted(shares)]
    bias, weights = _fit(rows, cols, y, len(names), swaps, ridge, lasso, fairness, steps)
    return Classifier(float(bias), {f: float(weights[k]) for f, k in index.items() if weights[k]})


def score_texts(docs: DataFrame, model: Classifier, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs, from its whole text; no shuffle."""
    ship_package(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = arrays.column(batch, "doc_id")
            texts = pc.fill_null(arrays.column(batch, "text"), "")
            scores = [model.score(texts[k].as_py()) for k in range(len(texts))]
            held = [i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(held), pa.array(scores, pa.float64()),
                 pa.array([int(s >= threshold) for s in scores], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return source.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Classifier, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose score reaches the threshold; all columns stay."""
    ship_package(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(at), "")
            yield batch.filter(pa.array([model.score(texts[k].as_py()) < threshold for k in range(len(texts))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
