"""Toxicity by weak supervision.

Voters are lexicons and patterns: words and word stems (leading bytes) that the training labels tie to toxicity,
dealt to several lexicons, and patterns over them. A generative label model is fitted to the vote patterns of all
documents without labels, by expectation maximisation: each voter's firing rate given the hidden class (its accuracy)
and the covariance of all voters within a class (their correlations), so that voters that fire together share their
evidence. A linear classifier is then trained on the posterior labels alone and gives the score.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxara.llm.common import read_table, tidy

#: Labelled rows of each class that lexicons and the classifier are trained on, at most: those with the least hash of their id.
SAMPLE_PER_CLASS = 1_500
STEMS = (4, 5, 6, 7, 8)
LEXICONS = 4
#: The classifier has the lexicons' entries as features, and others up to so many in all.
FEATURES = 1_200
#: The least share of toxic documents that an entry occurs in.
MIN_SHARE = 0.005
#: An entry is toxic if its rate among toxic documents is so many times that among others.
MIN_RATIO, MIN_G = 20.0, 30.0
_STRIP = b".,;:!?\"'()[]{}*_-<>|%&$#@~^=+/\\`"
VOTERS = [f"words{i}" for i in range(LEXICONS)] + [f"stems{n}" for n in STEMS] + ["two_entries", "repeated", "dense"]


def lower_words(text: bytes | None) -> list[bytes]:
    return (text or b"").decode("utf-8", "replace").lower().encode().split()


def forms(w: bytes) -> list[bytes]:
    """A word without punctuation at its ends, and its stems (a stem ends with *)."""
    w = w.strip(_STRIP)
    return [w, *[w[:k] + b"*" for k in STEMS if len(w) > k]] if w else []


def entries(text: bytes | None) -> Counter:
    """The forms of all words, with their counts."""
    out: Counter = Counter()
    for w, n in Counter(lower_words(text)).items():
        for f in forms(w):
            out[f] += n
    return out


class Finder:
    """The same of the wanted entries alone; remembers which words have any, up to WORDS words at a time."""

    WORDS = 100_000

    def __init__(self, wanted: Iterable[bytes]):
        self.wanted, self.known = frozenset(wanted), {}

    def __call__(self, text: list[bytes]) -> Counter:
        out: Counter = Counter()
        known = self.known
        for w, n in Counter(text).items():
            if (has := known.get(w)) is None:
                if len(known) >= self.WORDS:
                    known.clear()
                has = known[w] = tuple([f for f in forms(w) if f in self.wanted])
            for f in has:
                out[f] += n
        return out


def strength(n: int) -> float:
    """A feature's value: 1 for one occurrence, 2 for three or more."""
    return min(2.0, 0.5 + 0.5 * n)


@dataclass
class Sample:
    """Texts as the numbers of their entries, which takes little memory: names[ids[k]] occurs counts[k] times in the k-th of rows."""

    names: list[bytes]
    ids: list[np.ndarray]
    counts: list[np.ndarray]

    @classmethod
    def of(cls, texts: Iterable[bytes | None]) -> Sample:
        numbers: dict[bytes, int] = {}
        ids, counts = [], []
        for text in texts:
            found = entries(text)
            ids.append(np.array([numbers.setdefault(w, len(numbers)) for w in found], np.int32))
            counts.append(np.array(list(found.values()), np.int32))
        return cls(list(numbers), ids, counts)

    def rates(self, toxic: np.ndarray) -> list[tuple[float, bytes, float, float]]:
        """(association, entry, rate among toxic documents, rate among others), strongest first."""
        size = len(self.names)
        a, b = (sum((np.bincount(i, minlength=size) for i, t in zip(self.ids, toxic, strict=True) if t == side), np.zeros(size)) for side in (True, False))
        na, nb = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
        used = np.flatnonzero(a >= max(2, MIN_SHARE * na))
        found = [((a[k] / na - b[k] / nb) * np.sqrt(a[k]), self.names[k], a[k] / na, b[k] / nb) for k in used.tolist()]
        return sorted(found, key=lambda x: (-x[0], x[1]))

    def counters(self, wanted: Iterable[bytes]) -> list[Counter]:
        """The counts of wanted entries in each text."""
        keep = frozenset(wanted)
        mask = np.array([w in keep for w in self.names], bool)
        return [Counter({self.names[k]: int(n) for k, n in zip(i[mask[i]].tolist(), c[mask[i]].tolist(), strict=True)}) for i, c in zip(self.ids, self.counts, strict=True)]


def lexicon(sample: Sample, toxic: np.ndarray) -> list[bytes]:
    """Entries that toxic documents hold MIN_RATIO times as often as others, by more than chance gives (a G statistic of MIN_G)."""
    na, nb = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))

    def g(a: float, b: float) -> float:
        n = a + b
        return 2 * (a * np.log(a * (na + nb) / (n * na)) + (b * np.log(b * (na + nb) / (n * nb)) if b else 0.0))

    return [w for _, w, a, b in sample.rates(toxic) if a >= MIN_RATIO * b and g(a * na, b * nb) >= MIN_G]


def votes(found: Counter, lex: dict[bytes, int], n_words: int) -> int:
    """The voters that fire, as bits in the order of VOTERS."""
    bits, hits, most = 0, 0, 0
    total = 0
    for w in found.keys() & lex.keys():
        bits |= 1 << lex[w]
        if not w.endswith(b"*"):
            hits += 1
            most = max(most, found[w])
            total += found[w]
    if hits >= 2:
        bits |= 1 << len(VOTERS) - 3
    if most >= 2:
        bits |= 1 << len(VOTERS) - 2
    if total * 200 >= max(1, n_words):
        bits |= (1 << len(VOTERS) - 1) if total else 0
    return bits


def voter_of(entry: bytes) -> int:
    if entry.endswith(b"*"):
        return LEXICONS + STEMS.index(len(entry) - 1)
    return zlib.crc32(entry) % LEXICONS


@dataclass
class LabelModel:
    """Votes within a class are normal with the class's rates and one covariance, so the posterior's log odds are linear in the votes."""

    prior: float
    rates: np.ndarray  # voter x class: how often it fires
    covariance: np.ndarray  # of the votes within a class

    def posterior(self, fired: np.ndarray) -> np.ndarray:
        w = np.linalg.solve(self.covariance, self.rates[:, 1] - self.rates[:, 0])
        gap = np.log(self.prior) - np.log1p(-self.prior) + (fired - self.rates.mean(1)) @ w
        return 1 / (1 + np.exp(-np.clip(gap, -50, 50)))

    @property
    def correlations(self) -> np.ndarray:
        sd = np.sqrt(np.diag(self.covariance))
        return self.covariance / np.outer(sd, sd)


def fit_label_model(fired: np.ndarray, counts: np.ndarray, prior: float, rounds: int = 50, ridge: float = 0.2) -> LabelModel:
    """Rates, covariance and prior by expectation maximisation over vote patterns with counts; it starts from whether any voter fires.

    ridge: the share of the mean variance that every voter's own variance is raised by, so that a voter that never
    fires, or repeats another, has no infinite say.
    """
    n = max(1.0, counts.sum())
    post = np.where(fired.any(1), 0.9, 0.01)
    while True:
        w1, w0 = counts * post, counts * (1 - post)
        rates = np.stack([(w0 @ fired) / max(1.0, w0.sum()), (w1 @ fired + 0.5 * fired.mean(0)) / (w1.sum() + 1)], 1)
        low, high = fired - rates[:, 0], fired - rates[:, 1]
        cov = ((low * w0[:, None]).T @ low + (high * w1[:, None]).T @ high) / n
        cov += np.eye(len(cov)) * max(1e-6, ridge * np.trace(cov) / len(cov))
        model = LabelModel(float(np.clip(w1.sum() / n, 1e-4, 0.5)) if w1.sum() else prior, rates, cov)
        new = model.posterior(fired)
        rounds -= 1
        if not rounds or np.abs(new - post).max() < 1e-6:
            return model
        post = new


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 25) -> np.ndarray:
    """Logistic regression with targets in [0, 1] and a ridge, by Newton steps; the last weight is the bias."""
    x1 = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w, pull = np.zeros(x1.shape[1]), np.full(x1.shape[1], ridge)
    pull[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1 * (p * (1 - p) + 1e-9).astype(x1.dtype)[:, None]).T @ x1 + np.diag(pull), x1.T @ (p - y) + pull * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Toxicity:
    lex: dict[bytes, int]
    label_model: LabelModel
    weights: dict[bytes, float]
    bias: float

    def sum(self, found: Counter) -> float:
        return sum([self.weights[w] * strength(found[w]) for w in sorted(found.keys() & self.weights.keys())])


def train(docs: DataFrame, labels: DataFrame, learns=None) -> Toxicity:
    """Fits voters, label model and classifier. learns: which labelled doc_ids may be learnt from (all where None).

    At most SAMPLE_PER_CLASS labelled doc_ids of each class come to the driver (integers or texts alike); votes of all documents do as one count
    for each of the at most 2 ** len(VOTERS) patterns. Without labelled rows of both classes no voter fires and every
    score is the prior.
    """
    spark = docs.sparkSession
    known = labels.filter("toxic is not null and doc_id is not null").select("doc_id", (F.col("toxic") == 1).alias("toxic"))
    if learns is not None:
        known = known.filter(learns)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ordered = lambda t: known.filter(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_PER_CLASS)
    chosen = {r.doc_id: r.toxic for r in ordered(True).union(ordered(False)).collect()}
    ids = spark.createDataFrame([(i,) for i in sorted(chosen)], f"doc_id {dict(labels.dtypes)['doc_id']}")
    rows = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("b")).join(F.broadcast(ids), "doc_id", "left_semi")
    toxic, sizes, texts = [], [], []
    for r in sorted(rows.toLocalIterator(), key=lambda r: (r.doc_id, bytes(r.b or b""))):
        texts.append(bytes(r.b or b""))
        sizes.append(len(lower_words(texts[-1])))
        toxic.append(chosen[r.doc_id])
    sample, marks = Sample.of(texts), np.array(toxic, bool)
    del texts
    lex = {w: voter_of(w) for w in (lexicon(sample, marks) if marks.any() and not marks.all() else [])}
    sent = spark.sparkContext.broadcast(lex)

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        find = Finder(sent.value)
        for batch in batches:
            for t in batch.column(0):
                found = lower_words(t.as_py())
                total[votes(find(found), sent.value, len(found))] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["pattern", "n"])

    counted = docs.select(F.col("text").cast("string").cast("binary").alias("b")).mapInArrow(tidy(patterns), "pattern bigint, n bigint").groupBy("pattern").agg(F.sum("n").alias("n")).collect() if lex else []
    bits = lambda ps: np.array([[p >> j & 1 for j in range(len(VOTERS))] for p in ps], float).reshape(-1, len(VOTERS))
    pattern = [r.pattern for r in sorted(counted, key=lambda r: r.pattern)]
    counts = np.array([r.n for r in sorted(counted, key=lambda r: r.pattern)], float)
    model = fit_label_model(bits(pattern), counts, 0.1) if pattern else LabelModel(0.1, np.full((len(VOTERS), 2), 0.5), np.eye(len(VOTERS)))
    if not lex:
        return Toxicity({}, model, {}, float(np.log(0.1 / 0.9)))
    target = model.posterior(bits([votes(c, lex, n) for c, n in zip(sample.counters(lex), sizes, strict=True)]))
    ranked = [w for _, w, _, _ in sample.rates(target >= 0.5)]
    at = {w: i for i, w in enumerate(list(dict.fromkeys([*lex, *ranked]))[: max(FEATURES, len(lex))])}
    x = np.zeros((len(sizes), len(at)), np.float32)
    for i, c in enumerate(sample.counters(at)):
        for w, n in c.items():
            x[i, at[w]] = strength(n)
    w = fit_linear(x, target)
    return Toxicity(lex, model, {f: float(w[i]) for f, i in at.items()}, float(w[-1]))


def score(docs: DataFrame, model: Toxicity) -> DataFrame:
    """doc_id, score, posterior of every whole text: the classifier's probability and the label model's. Null texts are empty."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        find = Finder([*m.weights, *m.lex])
        known: dict[int, float] = {}
        for batch in batches:
            scores, posts = [], []
            for t in batch.column(1):
                text = lower_words(t.as_py())
                found = find(text)
                s = m.bias + m.sum(found)
                scores.append(1 / (1 + np.exp(-min(50.0, max(-50.0, s)))))
                v = votes(found, m.lex, len(text))
                if v not in known:
                    known[v] = float(m.label_model.posterior(np.array([[v >> j & 1 for j in range(len(VOTERS))]], float))[0])
                posts.append(known[v])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(posts, pa.float64())], names=["doc_id", "score", "posterior"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("b")).mapInArrow(tidy(run), f"doc_id {kind}, score double, posterior double")


def remainder(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by a model learnt from the rows that aren't held out; null and empty texts have the bias's score, null ids and repeated rows a result each."""
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs, read_table(spark, sf_dir, "labels"), remainder(5) != 0)
    return score(docs, model).select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "posterior")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that score 0.5 or more, whatever their ids and other columns; each text carries its own decision through one pass."""
    model = train(docs, labels, remainder(5) != 0)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        find = Finder(m.weights)
        for batch in batches:
            keep = [m.bias + m.sum(find(lower_words((t.as_py() or "").encode()))) < 0 for t in batch.column(batch.schema.get_field_index("text"))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
