"""Toxicity by a counterfactual-regularised classifier.

A logistic regression over the presence of words and word beginnings. Features are chosen by a
likelihood-ratio test that rises with the number of features tried. For every labelled text two
counterfactual pairs are made. Where it mentions a group, the identity terms are swapped for others of
their group, and taken out; where it mentions none, a term is put in, and then swapped. The squared
change of the score over all pairs is part of the loss, so that a score hangs neither on which
group a text mentions nor on the mention itself, and neutral mentions are not taken for toxic.

The classifier is fitted on a bounded sample of labelled rows (MOST_POSITIVE, MOST_NEGATIVE,
chosen by hash). Features are counted where the texts are; only the chosen ones (MOST_FEATURES) of the sample's
rows, one row per identifier, reach the driver. Every text is scored whole, whatever its length. Nulls: a null
text is an empty one and scores the intercept; null labels and labels without document are not learnt
from, and of contradicting labels the 1 counts. Of rows that repeat an identifier, the text with the least hash is learnt
from; repeated rows are scored alike. A table without labels of both classes, or an empty one, gives scores of 0.5 at
most. Other columns pass through, but one that has the name of the score is replaced.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import discard, materialise, quoted
from larkspur.llm.tokens import forget

#: Bounds of the sample that the classifier is fitted on.
MOST_POSITIVE, MOST_NEGATIVE = 3000, 5000
MOST_FEATURES = 1000
PREFIXES = range(4, 9)
THRESHOLD = 0.7
#: Texts of an Arrow batch that a Python worker holds as Python objects at once.
TEXTS_AT_ONCE = 256
#: Weight of the mean squared change of the score over counterfactual pairs.
FAIRNESS = 3.0

# Terms of one group, in one language, are swapped for one another, in turn.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"), ("gay", "straight"), ("lesbian", "heterosexual"),
    ("transgender", "cisgender"), ("muslims", "christians", "jews", "hindus", "atheists"), ("muslim", "christian", "jewish", "hindu", "atheist"),
    ("black", "white", "asian", "latino"), ("immigrants", "citizens"), ("disabled", "able"), ("old", "young"), ("african", "european", "american"),
    ("femmes", "hommes"), ("femme", "homme"), ("lesbienne", "hétérosexuelle"), ("musulmans", "chrétiens", "juifs", "hindous", "athées"),
    ("musulman", "chrétien", "juif", "hindou", "athée"), ("noirs", "blancs", "asiatiques"), ("immigrés", "citoyens"), ("vieux", "jeunes"), ("africain", "européen", "américain"),
    ("frauen", "männer"), ("frau", "mann"), ("schwul", "hetero"), ("lesbisch", "heterosexuell"), ("muslime", "christen", "juden", "atheisten"),
    ("muslimisch", "christlich", "jüdisch", "atheistisch"), ("schwarze", "weiße", "asiaten"), ("einwanderer", "bürger"), ("behindert", "gesund"), ("afrikaner", "europäer", "amerikaner"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("lesbiana", "heterosexual"), ("musulmanes", "cristianos", "judíos", "hindúes", "ateos"),
    ("musulmán", "cristiano", "judío", "hindú", "ateo"), ("negros", "blancos", "asiáticos"), ("inmigrantes", "ciudadanos"), ("viejos", "jóvenes"), ("africano", "europeo", "americano"),
)
SWAP: dict[str, str] = {}
for _group in IDENTITY:
    for _i, _term in enumerate(_group):
        SWAP.setdefault(_term, _group[(_i + 1) % len(_group)])
WORDS = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> tuple[int, ...]:
    """Hashes of a word and of its beginnings."""
    raw = [zlib.crc32(word.encode())]
    raw += [zlib.crc32(b"^" + word[:k].encode()) for k in PREFIXES if len(word) >= k]
    return tuple(raw)


def features(words: set[str]) -> set[int]:
    return {h for w in words for h in word_features(w)}


def counterfactuals(words: set[str], choice: int) -> list[tuple[set[str], set[str]]]:
    """Two pairs of word sets that should score alike. choice: which group is put in where none is mentioned."""
    if held := words & SWAP.keys():
        return [(words, {SWAP.get(w, w) for w in words}), (words, words - held)]
    group = IDENTITY[choice % len(IDENTITY)]
    one, other = group[choice // len(IDENTITY) % len(group)], group[(choice // len(IDENTITY) + 1) % len(group)]
    return [(words, words | {one}), (words | {one}, words | {other})]


@dataclass
class Model:
    """Weights by feature hash, the intercept, and how many counterfactual pairs were fitted (and how many touch a feature)."""

    weights: dict[int, float]
    intercept: float
    pairs: int = 0
    touched: int = 0

    def logit(self, words: set[str]) -> float:
        return self.intercept + sum(self.weights[h] for h in features(words) if h in self.weights)


def _logistic(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _matrix(rows: list[list[int]], columns: int) -> np.ndarray:
    out = np.zeros((len(rows), columns), np.float32)
    for k, x in enumerate(rows):
        out[k, x] = 1
    return out


def descend(x: np.ndarray, labels: np.ndarray, change: np.ndarray, fairness: float, ridge: float = 1e-3, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept that fit the labels, classes balanced, plus fairness times the mean of (change @ weights) squared."""
    balance = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (labels == 0).sum())).astype(np.float32)
    touched = change[np.any(change, axis=1)]
    gram = (touched.T @ touched / max(1, len(change))).astype(np.float32)
    w, c = np.zeros(x.shape[1], np.float32), np.float32(0)
    mw, mc = np.zeros_like(w), np.float32(0)
    size = 4.0 / (0.25 * (x.sum(1).mean() + 1) + fairness * np.trace(gram) + 1)
    for _ in range(steps):
        error = (_logistic(x @ w + c) - labels).astype(np.float32) * balance
        mw = 0.9 * mw + x.T @ error + ridge * w + fairness * gram @ w
        mc = 0.9 * mc + error.sum()
        w, c = (w - size * mw).astype(np.float32), np.float32(c - size * mc)
    return w, float(c)


def chosen_features(rows: DataFrame, positive: int, negative: int) -> list[int]:
    """The features that tell label 1 best: their likelihood-ratio gain is above twice the logarithm of the features tried."""
    counted = rows.select("y", F.explode("own").alias("feature")).groupBy("feature").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    tried, share = counted.count(), positive / (positive + negative)
    a, b = F.col("a"), F.col("b")
    part = lambda n, p: F.when(n > 0, n * F.ln(n / ((a + b) * p))).otherwise(0.0)
    gain = 2 * (part(a, share) + part(b, 1 - share))
    best = counted.select("feature", gain.alias("gain")).filter((F.col("gain") > 2 * np.log(max(2, tried)).item()) & (a > (a + b) * share))
    return sorted(r["feature"] for r in best.orderBy(F.col("gain").desc(), "feature").limit(MOST_FEATURES).collect())


def fit(docs: DataFrame, labels: DataFrame, fairness: float = FAIRNESS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on a bounded sample of labels: at most MOST_POSITIVE rows of label 1 and MOST_NEGATIVE of label 0, by hash."""
    import pyarrow as pa

    known = labels.select(quoted(id_col).alias("k"), quoted(label_col).cast("int").alias("y")).filter("k is not null and y in (0, 1)")
    known = known.groupBy("k").agg(F.max("y").alias("y"))
    order = F.xxhash64("k", F.lit("toxicity"))
    sample = known.filter("y = 1").orderBy(order, "k").limit(MOST_POSITIVE).union(known.filter("y = 0").orderBy(order, "k").limit(MOST_NEGATIVE))
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    texts = docs.select(quoted(id_col).alias("k"), text.alias("t"), F.xxhash64(text).alias("h")).join(F.broadcast(sample), "k").select("k", "y", "h", "t")

    def read(batches):
        forget()
        ints = pa.list_(pa.int64())
        for batch in (b.slice(at, TEXTS_AT_ONCE) for b in batches for at in range(0, b.num_rows, TEXTS_AT_ONCE)):
            own, pairs = [], []
            for h, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = set(WORDS.findall(text.lower()))
                own.append(sorted(features(words)))
                both = [(features(a), features(b)) for a, b in counterfactuals(words, h % 2**62)]
                pairs.append([{"plus": sorted(b - a), "minus": sorted(a - b)} for a, b in both])
            kind = pa.list_(pa.struct([("plus", ints), ("minus", ints)]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(own, ints), pa.array(pairs, kind)], names=["k", "y", "h", "own", "pairs"])

    key = dict(texts.dtypes)["k"]
    pairs = "array<struct<plus:array<long>,minus:array<long>>>"
    rows = texts.mapInArrow(read, f"k {key}, y int, h long, own array<long>, pairs {pairs}")
    rows = materialise(rows.groupBy("k").agg(F.min_by(F.struct("y", "own", "pairs"), "h").alias("x")).select("x.*"), "toxicity-sample")
    found = rows.agg(F.sum("y"), F.sum(1 - F.col("y"))).first()
    positive, negative = found[0] or 0, found[1] or 0
    chosen = chosen_features(rows, positive, negative) if positive and negative else []
    if not chosen:
        discard(rows)
        return Model({}, 0.0)
    place = {h: k for k, h in enumerate(chosen)}

    def reduce(batches):
        forget()
        shorts = pa.list_(pa.int16())
        for batch in (b.slice(at, TEXTS_AT_ONCE) for b in batches for at in range(0, b.num_rows, TEXTS_AT_ONCE)):
            to = lambda hs: [place[h] for h in hs if h in place]
            own = [to(hs) for hs in batch.column(1).to_pylist()]
            changes = [[{"plus": to(p["plus"]), "minus": to(p["minus"])} for p in ps] for ps in batch.column(2).to_pylist()]
            kind = pa.list_(pa.struct([("plus", shorts), ("minus", shorts)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, shorts), pa.array(changes, kind)], names=["y", "own", "pairs"])

    held = rows.select("y", "own", "pairs").mapInArrow(reduce, "y int, own array<short>, pairs array<struct<plus:array<short>,minus:array<short>>>").toArrow().to_pylist()
    discard(rows)
    held.sort(key=lambda r: (r["y"], r["own"], str(r["pairs"])))
    x = _matrix([r["own"] for r in held], len(chosen))
    changes = [p for r in held for p in r["pairs"]]
    change = _matrix([p["plus"] for p in changes], len(chosen)) - _matrix([p["minus"] for p in changes], len(chosen))
    w, c = descend(x, np.array([r["y"] for r in held], np.float32), change, fairness)
    return Model({h: float(v) for h, v in zip(chosen, w, strict=True) if v}, c, len(change), int(np.any(change, axis=1).sum()))


def score(docs: DataFrame, model: Model, text_col: str = "text", into: str = "score") -> DataFrame:
    """Add a score from 0 to 1 to every row, of its whole text."""
    weights, intercept = model.weights, model.intercept

    @F.arrow_udf("double")
    def scored(texts):
        import pyarrow as pa

        forget()
        memo: dict[str, tuple[int, ...]] = {}
        out = np.empty(len(texts))
        for at in range(0, len(texts), TEXTS_AT_ONCE):
            for k, text in enumerate(texts.slice(at, TEXTS_AT_ONCE).to_pylist(), at):
                hits: set[int] = set()
                for w in set(WORDS.findall(text.lower())):
                    own = memo.get(w)
                    if own is None:
                        own = memo[w] = tuple(h for h in word_features(w) if h in weights)
                    if own:
                        hits.update(own)
                out[k] = intercept + sum(weights[h] for h in sorted(hits))
        return pa.array(_logistic(out))

    return docs.withColumn(into, scored(F.coalesce(quoted(text_col).cast("string"), F.lit(""))))


def fold(id_col: str):
    return F.crc32(quoted(id_col).cast("string").cast("binary")) % 3


def fitted(docs: DataFrame, labels: DataFrame, fairness: float = FAIRNESS) -> Model:
    """A model of the training folds' labels."""
    return fit(docs, labels.filter(fold("doc_id") != 1), fairness)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model)
    return scored.select("doc_id", F.coalesce(fold("doc_id") == 1, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
