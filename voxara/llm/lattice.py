"""Subword lattice likelihood.

A document's words are independent given the model, and so is its end. A word's marginal probability sums over all
segmentations into pieces of an existing vocabulary, by a forward recursion in log space over the lattice of pieces;
characters without a piece pass as bytes. The vocabulary's scores are ranks, so they start as Zipf weights and are
re-estimated FITS times from the best segmentations of the training word types. A word's core (lower-cased, without
punctuation at its ends) that training words have is an arc over the word too, with the share of types that have the
core and the share of those that have its shape (punctuation and case). Words seen in training also are arcs of their
own, with absolutely discounted counts; what the discount takes goes to the lattice R with the core's arc:

    P(w) = max(c(w) - d, 0) / N + d * V / N * R(w),    R(w) = (1 - CORE) * Q(w) + CORE * core(w) * shape(w)

Documents fall into classes (languages, say), which training rows name and other rows don't: the document's
probability is the mean over classes, weighted by their shares. A class k has counts of its own, and P below them:

    P_k(w) = max(c_k(w) - d, 0) / N_k + d * V_k / N_k * P(w)

Words recur within a document, so given its class it is a Polya urn over P_k: its t-th token is w with probability
(ALPHA * P_k(w) + occurrences of w before) / (ALPHA + t - 1), which depends on counts alone.

Counts, word types and the sums of documents are distributed tables; only words with at least N / HEAVY occurrences,
of which there are HEAVY at most, are sent to every task. The rest is rare by that and joins without hot keys.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxara.llm.common import join_hot, read_table, stash, tidy, words

HEAVY = 300_000
ALPHA = 3_000.0
#: The core's share of what the discount takes.
CORE = 0.7
#: Components of the mixture; rows of rarer classes share the last.
CLASSES = 8
#: Times that the pieces' weights are re-estimated.
FITS = 1
#: Distinct words that a task counts before it hands its counts on.
COUNTER_WORDS = 300_000
#: The end of a document, as a token: no word holds a blank.
END = b" "
_MARK = "▁"
_LOG10 = math.log(10)
_PUNCTUATION = string.punctuation.encode()


class Lattice:
    """Q(w): pieces with log weights, those at a word's start and those within apart; stop: log probability that a word ends after a piece."""

    def __init__(self, first: dict[str, float], inner: dict[str, float], stop: float):
        self.first, self.inner = first, inner
        self.stop, self.go = math.log(stop), math.log1p(-stop)
        self.prefixes = {p[:i] for p in (*first, *inner) for i in range(1, len(p) + 1)}
        #: A character without a piece: as much as this for each of its bytes.
        self.byte = -math.log(256) - 6.0

    def log_q(self, w: str) -> float:
        """The natural logarithm of the sum over all segmentations, by the forward recursion over the lattice."""
        n, first, inner, prefixes = len(w), self.first, self.inner, self.prefixes
        go, exp, log1p, none = self.go, math.exp, math.log1p, -math.inf
        alpha = [none] * (n + 1)
        alpha[0] = -go
        table = first
        for i in range(n):
            a = alpha[i] + go
            j = i + 1
            single = w[i:j] not in table
            if single:
                c, b = a + self.byte * len(w[i].encode("utf-8", "surrogatepass")), alpha[j]
                alpha[j] = c if b == none else c + log1p(exp(b - c)) if b < c else b + log1p(exp(c - b))
            while j <= n and (p := w[i:j]) in prefixes:
                if (s := table.get(p)) is not None:
                    c, b = a + s, alpha[j]
                    alpha[j] = c if b == none else c + log1p(exp(b - c)) if b < c else b + log1p(exp(c - b))
                j += 1
            table = inner
        return alpha[n] + self.stop

    def best(self, w: str) -> list[str]:
        """The best segmentation."""
        n, inner, prefixes = len(w), self.inner, self.prefixes
        alpha, back = [-math.inf] * (n + 1), [0] * (n + 1)
        alpha[0] = -self.go
        table = self.first
        for i in range(n):
            a = alpha[i] + self.go
            j = i + 1
            if w[i:j] not in table and (c := a + self.byte * len(w[i].encode("utf-8", "surrogatepass"))) > alpha[j]:
                alpha[j], back[j] = c, i
            while j <= n and (p := w[i:j]) in prefixes:
                if (s := table.get(p)) is not None and a + s > alpha[j]:
                    alpha[j], back[j] = a + s, i
                j += 1
            table = inner
        out = []
        while n:
            out.append(w[back[n] : n])
            n = back[n]
        return out[::-1]


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece file, without control and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]


def _normal(weights: dict[str, float]) -> dict[str, float]:
    total = sum(weights.values()) or 1.0
    return {p: math.log(x / total) for p, x in weights.items()}


def start_lattice(pieces: list[tuple[str, float]]) -> Lattice:
    """Scores that are ranks (0, -1, -2 ...) become Zipf weights; a piece is lower-cased, and pieces that meet add up."""
    first: Counter = Counter()
    inner: Counter = Counter()
    for piece, score in pieces:
        p = "".join(c.lower() if c < "\x80" else c for c in piece)
        weight = 1 / (3 - score)
        if p.startswith(_MARK):
            if len(p) > 1:
                first[p[1:]] += weight
        elif _MARK not in p:
            inner[p] += weight
            if len(p) == 1:
                first[p] += weight * 0.01
    return Lattice(_normal(first), _normal(inner), 0.3)


def core_of(token: bytes) -> tuple[bytes, bytes]:
    """A word's core, lower-cased and without punctuation at its ends, and its shape: that punctuation and whether case was lost."""
    rest = token.lstrip(_PUNCTUATION)
    bare = rest.rstrip(_PUNCTUATION)
    core = bare.decode("utf-8", "replace").lower().encode()
    return core, token[: len(token) - len(rest)] + (b" " if core == bare else b" ^ ") + rest[len(bare) :]


def count_words(docs: DataFrame, learns: Column, which: Column, classes: int) -> DataFrame:
    """token and core binary, shape binary, c long, by array<long>: every token of docs (words and END) with its counts in the rows that learns holds for, in all and by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[Counter] = [Counter() for _ in range(classes)]
        other: set[bytes] = set()

        def flush() -> pa.RecordBatch:
            rest = [w for w in other if not any(w in x for x in seen)]
            token = [w for x in seen for w in x] + rest
            k = [i for i, x in enumerate(seen) for _ in x] + [0] * len(rest)
            n = [n for x in seen for n in x.values()] + [0] * len(rest)
            return pa.RecordBatch.from_arrays([pa.array(token, pa.binary()), pa.array(k, pa.int32()), pa.array(n, pa.int64())], names=["token", "k", "c"])

        for batch in batches:
            for learn, k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                found = words(text.as_py())
                found.append(END)
                if learn:
                    seen[k].update(found)
                else:
                    other.update(found)
                if sum(map(len, seen)) + len(other) > COUNTER_WORDS:
                    yield flush()
                    seen, other = [Counter() for _ in range(classes)], set()
        yield flush()

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [core_of(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in found], pa.binary()), pa.array([x for _, x in found], pa.binary())], names=["token", "c", "by", "core", "shape"])

    rows = docs.select(F.coalesce(learns, F.lit(False)).alias("learn"), which.cast("int").alias("k"), F.col("text").cast("string").cast("binary").alias("b"))
    each = [F.sum(F.when(F.col("k") == i, F.col("c")).otherwise(0)) for i in range(classes)]
    counted = rows.mapInArrow(tidy(run), "token binary, k int, c bigint").groupBy("token").agg(F.sum("c").alias("c"), F.array(*each).alias("by"))
    return counted.mapInArrow(tidy(parts), "token binary, c bigint, by array<bigint>, core binary, shape binary")


def fit_lattice(types: DataFrame, start: Lattice) -> Lattice:
    """Re-estimates the pieces' weights from the best segmentations of training word types, each type once.

    What comes to the driver is a count for each vocabulary piece at most.
    """
    spark = types.sparkSession
    sent = spark.sparkContext.broadcast(start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: Counter = Counter()
        inner: Counter = Counter()
        for batch in batches:
            for token in batch.column(0).to_pylist():
                p = sent.value.best(token.decode("utf-8", "replace"))
                first[p[0]] += 1
                inner.update(p[1:])
        known = [(True, p, n) for p, n in first.items() if p in sent.value.first] + [(False, p, n) for p, n in inner.items() if p in sent.value.inner]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in known], pa.bool_()), pa.array([x[1] for x in known], pa.string()), pa.array([x[2] for x in known], pa.int64())], names=["first", "piece", "n"])

    seen = types.filter((F.col("c") > 0) & (F.col("token") != F.lit(END))).select("token").mapInArrow(tidy(run), "first boolean, piece string, n bigint").groupBy("first", "piece").agg(F.sum("n").alias("n")).collect()
    found = {(r["first"], r["piece"]): r["n"] for r in seen}
    mass = {k: sum(n for (f, _), n in found.items() if f == k) for k in (True, False)}
    new = {k: {p: found.get((k, p), 0) + 1e-4 * max(mass[k], 1) * math.exp(s) for p, s in table.items()} for k, table in ((True, start.first), (False, start.inner))}
    stop = (mass[True] + 1) / (mass[True] + mass[False] + 2)
    return Lattice(_normal(new[True]), _normal(new[False]), stop)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """For x of at least 1: Stirling's series after eight steps of the recurrence."""
    y = x + 8
    steps = np.log(x)
    for i in range(1, 8):
        steps = steps + np.log(x + i)
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y - steps


def urn(tf: np.ndarray, lp: np.ndarray) -> np.ndarray:
    """log10 of the product of ALPHA * P + k over k < tf, summed over words (rows) for each class (column), with lp = log10 P."""
    out = lp.sum(0) + math.log10(ALPHA) * len(tf)
    more = tf > 1
    if more.any():
        p = ALPHA * 10.0 ** lp[more]
        out += (_log_gamma(p + tf[more, None]) - _log_gamma(p + 1)).sum(0) / _LOG10
    return out


def class_names(docs: DataFrame, learns: Column, class_of: Column | None) -> list[str]:
    """The commonest CLASSES classes of rows that learns holds for, commonest first; a null is the class without a name."""
    if class_of is None:
        return [""]
    named = docs.filter(learns).groupBy(F.coalesce(class_of.cast("string"), F.lit("")).alias("name")).agg(F.count("*").alias("n"))
    return [r["name"] for r in named.orderBy(F.desc("n"), "name").limit(CLASSES).collect()] or [""]


def score_documents(docs: DataFrame, learns: Column, pieces: list[tuple[str, float]], class_of: Column | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every whole text (null: empty).

    learns: which rows the model learns from; class_of: a training row's class, which is not read from other rows.
    score is log10 of the model's probability of the document's words and its end; base_score that of add-one counts.
    Repeated rows have a result each. Without training rows all tokens are unknown, and score comes from the lattice alone.
    """
    spark = docs.sparkSession
    names = class_names(docs, learns, class_of)
    width = len(names)
    which = F.lit(width - 1)
    for i, name in enumerate(names[:-1]):
        which = F.when(F.coalesce(class_of.cast("string"), F.lit("")) == name, i).otherwise(which)
    types, _ = stash(count_words(docs, learns, which, width), "types")
    by = [F.get("by", F.lit(i)) for i in range(width)]
    counts = types.select(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2), *[F.coalesce(F.sum(x), F.lit(0)) for x in by], *[F.count_if(x > 0) for x in by], *[F.coalesce(F.max(F.when(F.col("token") == F.lit(END), x)), F.lit(0)) for x in by]).first()
    total, kinds, ones, twos = counts[:4]
    class_total, class_kinds, class_docs = counts[4 : 4 + width], counts[4 + width : 4 + 2 * width], counts[4 + 2 * width :]
    share = [math.log10((n + 1) / (sum(class_docs) + width)) for n in class_docs]
    fitted = start_lattice(pieces)
    for _ in range(FITS):
        fitted = fit_lattice(types, fitted)
    trained = types.filter((F.col("c") > 0) & (F.col("token") != F.lit(END)))
    shapes, _ = stash(trained.groupBy("shape").agg(F.count("*").alias("shape_types")), "shapes")
    cores = trained.filter(F.length("core") > 0).groupBy("core").agg(F.count("*").alias("core_types"))
    sent = spark.sparkContext.broadcast(fitted)
    d = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
    base_less = math.log10(total + kinds + 1)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = sent.value
        back = math.log(d * kinds / total) if total else 0.0
        spelt = math.log1p(-CORE) if total else 0.0
        discounts = [d * v / n if n else 1.0 for n, v in zip(class_total, class_kinds, strict=True)]
        for batch in batches:
            out = []
            for token, c, own, core_types, shape_types in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if token == END:
                    g = -20.0 if c else 0.0
                else:
                    g = spelt + lattice.log_q(token.decode("utf-8", "replace"))
                    if core_types and shape_types:
                        arc = math.log(CORE * core_types / kinds * shape_types / kinds)
                        g = max(g, arc) + math.log1p(math.exp(-abs(g - arc)))
                    g += back
                if c:
                    own_all = math.log(max(c - d, 1e-9) / total)
                    g = max(own_all, g) + math.log1p(math.exp(-abs(own_all - g)))
                low, p = g / _LOG10, math.exp(g) if g > -600 else 0.0
                lp = []
                for x, n, less in zip(own, class_total, discounts, strict=True):
                    q = less * p + ((x - d) / n if x else 0.0)
                    lp.append(math.log10(q) if q else low + math.log10(less))
                out.append(lp)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.float64()))], names=["token", "c", "lp"])

    # The commonest shapes hold most types; a table of shapes too large to broadcast leaves only those to the join of hot keys.
    shaped = join_hot(types, shapes, "shape", "shape_types", "left")
    with_cores = shaped.join(cores, "core", "left").select("token", "c", "by", "core_types", "shape_types")
    table, _ = stash(with_cores.mapInArrow(tidy(scored), "token binary, c bigint, lp array<double>"), "word-scores")
    often = table.filter((F.col("c") > 0) & (F.col("c") >= total / HEAVY)).collect() if total else []
    heavy = spark.sparkContext.broadcast(({bytes(r.token): i for i, r in enumerate(often)}, np.array([math.log10(r.c + 1) for r in often]), np.array([r.lp for r in often]).reshape(-1, width)))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document with what frequent words give, and one for each of its other words."""
        index, log_counts, log_p = heavy.value
        get, names_ = index.get, ["doc_id", "text_key", "token", "tf", "rows", "n", "known", "base", "scores"]
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                tokens: list[bytes] = []
                rare, tf, keys, whole = [], [], [], []
                for i, cell in enumerate(part.column(1)):
                    text = cell.as_py() or b""
                    found = Counter(words(text))
                    found[END] += 1
                    ids = np.fromiter((get(w, -1) for w in found), np.int64, len(found))
                    tfs = np.fromiter(found.values(), np.int64, len(found))
                    here = ids >= 0
                    if not here.all():
                        tokens += itertools.compress(found, (~here).tolist())
                        tf.append(tfs[~here])
                        rare.append(np.full(len(tf[-1]), i))
                    n, ids, tfs = int(tfs.sum()), ids[here], tfs[here]
                    scores = urn(tfs, log_p[ids]) - (math.lgamma(ALPHA + n) - math.lgamma(ALPHA)) / _LOG10
                    keys.append(hashlib.md5(text).digest())
                    whole.append((n, int(tfs.sum()), float((tfs * log_counts[ids]).sum()), scores))
                # A document's own row follows those of its rare words, which have nothing but a word and its count.
                m, k = len(tokens), len(keys)
                take = pa.array(np.concatenate([*rare, np.arange(k)]).astype(np.int64))
                own = [np.r_[np.zeros(m, np.int64), np.array(c, np.int64)] for c in ([1] * k, [w[0] for w in whole], [w[1] for w in whole])]
                lists = pa.concat_arrays([pa.nulls(m, pa.list_(pa.float64())), pa.array([w[3] for w in whole], pa.list_(pa.float64()))])
                columns = [
                    part.column(0).take(take), pa.array(keys, pa.binary()).take(take), pa.array([*tokens, *(b"\n" + x for x in keys)], pa.binary()),
                    pa.array(np.concatenate([*tf, np.zeros(k, np.int64)]).astype(np.int64)), *map(pa.array, own), pa.array(np.r_[np.zeros(m), [w[2] for w in whole]]), lists,
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names_)

    kind = dict(docs.dtypes)["doc_id"]
    each = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("b")).mapInArrow(tidy(spread), f"doc_id {kind}, text_key binary, token binary, tf bigint, rows bigint, n bigint, known bigint, base double, scores array<double>")
    joined = each.join(table, "token", "left")
    tf, m = F.col("tf"), F.col("m")

    def of_class(k: int) -> Column:
        lp = F.get("lp", F.lit(k))
        p = F.lit(ALPHA) * F.pow(F.lit(10.0), lp)
        again = F.when(tf > 1, F.aggregate(F.sequence(F.lit(1), tf - 1), F.lit(0.0), lambda a, j: a + F.log10(p + j))).otherwise(0.0)
        return F.sum(F.when(tf > 0, lp + math.log10(ALPHA) + again).otherwise(F.get("scores", F.lit(k)))).alias(f"s{k}")

    sums = joined.groupBy("doc_id", "text_key").agg(
        F.sum("rows").alias("m"), F.sum("n").alias("n"), F.sum(F.col("known") + F.when(F.col("c") > 0, tf).otherwise(0)).alias("known"),
        F.sum(F.col("base") + F.when(tf > 0, tf * F.log10(F.coalesce("c", F.lit(0)) + 1)).otherwise(0.0)).alias("base"), *[of_class(k) for k in range(width)],
    )
    given = sums.withColumn("given", F.array(*[F.col(f"s{k}") / m + share[k] for k in range(width)])).withColumn("most", F.array_max("given"))
    mean = F.col("most") + F.log10(F.aggregate(F.transform("given", lambda x: F.pow(F.lit(10.0), x - F.col("most"))), F.lit(0.0), lambda a, x: a + x))
    return given.select(
        "doc_id", F.explode(F.sequence(F.lit(1), m)), (F.col("n") / m).cast("bigint").alias("n_tokens"), (F.col("known") / m).cast("bigint").alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base") / m - F.lit(base_less) * F.col("n") / m).alias("base_score"), mean.alias("score"),
    ).drop("col")


def op1_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' scores by a model learnt from those that aren't held out; see score_documents for nulls and repeated rows."""
    import public_tokenizers

    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    scored = score_documents(read_table(spark, sf_dir, "documents"), ~held, vocabulary(public_tokenizers.path("piece_bpe_32k.model")), F.col("lang"))
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
