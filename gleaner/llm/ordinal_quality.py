"""Quality grades by ordinal cumulative-link regression over hashed text.

P(grade >= k) is the logistic function of s(text) - threshold k; all thresholds share the score s. Features are hashed
words and word beginnings (present or not), hashed word shapes (share of all words) and how much repeats. The score is a sum over the text's distinct words
and shapes, so documents are scored in one pass without a shuffle.

The model is fitted on at most ``sample`` labelled documents, those with the smallest hash of their id; that bound is
the only limit, everything is scored. A word's ridge penalty grows as fewer standard errors part the share of some one
grade among the documents that hold it from that grade's share of all: from MOVES on it is the plain one, below it is
(MOVES / errors) ** 24 times that. So rare words do not add up to noise in long texts, and words that only documents of
a rare grade hold get weights from a few documents on. Words of one document and below FAINT errors have none.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import texts_of

SAMPLE, BITS, MOVES, FAINT, STEPS = 4000, 18, 6.0, 2.0, 800
_SHAPES = 1 << BITS
_CLASS = str.maketrans({**{chr(c): "A" for c in range(65, 91)}, **{chr(c): "a" for c in range(97, 123)}, **{chr(c): "0" for c in range(48, 58)}})


def shape(word: str) -> str:
    """Runs of capitals, small letters, digits and any other character, one character for each run."""
    out = []
    for c in word.translate(_CLASS):
        c = ("A" if c.isupper() else "a") if ord(c) > 127 and c.isalpha() else c
        if not out or out[-1] != c:
            out.append(c)
    return "".join(out[:8])


def word_features(word: str) -> tuple[int, int, int]:
    """Buckets of a word's letters, of how they begin and of the word's shape; the last kind has numbers of its own."""
    letters = "".join(c for c in word.lower() if c.isalpha())
    begin = xxhash.xxh32_intdigest(letters[:4], 3) & (_SHAPES - 1) if len(letters) >= 4 else xxhash.xxh32_intdigest(letters) & (_SHAPES - 1)
    return xxhash.xxh32_intdigest(letters) & (_SHAPES - 1), begin, _SHAPES + (xxhash.xxh32_intdigest(shape(word), 7) & 4095)


def repetition(distinct: int, total: int) -> int:
    """Bucket of the share of words that occurred before, in tenths, apart for texts of a few words and of many."""
    return 2 * _SHAPES + 10 * min(3, total.bit_length() // 3) + min(9, 10 * (total - distinct) // max(total, 1))


def features(text: str) -> dict[int, float]:
    """Sparse features of a text: words and their beginnings (1 if present), shapes (share of words), repetition."""
    counts = Counter(text.split())
    total = sum(counts.values())
    out: dict[int, float] = {repetition(len(counts), total): 1.0}
    for word, n in counts.items():
        w, begin, s = word_features(word)
        out[w] = out[begin] = 1.0
        out[s] = out.get(s, 0.0) + n / total
    return out


@dataclass
class OrdinalModel:
    """Weights by bucket, ordered thresholds, and the score's constant is in the thresholds."""

    weights: dict[int, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=list)

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ...; one column each."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - np.array(self.thresholds)[None, :], -35, 35)))


def thresholds(p: np.ndarray, m: int) -> np.ndarray:
    """Ordered thresholds from the parameters after m weights: the first, then logarithms of the steps to the next ones."""
    return p[m] + np.concatenate(([0], np.cumsum(np.exp(p[m + 1 :]))))


def loss_and_gradient(p: np.ndarray, at: np.ndarray, value: np.ndarray, owner: np.ndarray, grades: np.ndarray, levels: int, l2: float) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood of the grades plus l2 / 2 times the squared weights, and its gradient.

    p: a weight of each feature, then the thresholds' parameters. at, value, owner: feature, value and row of each entry.
    """
    n, m = len(grades), len(p) - levels + 1
    gaps, theta = np.exp(p[m + 1 :]), thresholds(p, m)
    score = np.bincount(owner, p[at] * value, minlength=n)
    z = 1 / (1 + np.exp(-np.clip(score[:, None] - theta[None, :], -35, 35)))
    tail = np.concatenate((np.ones((n, 1)), z, np.zeros((n, 1))), axis=1)
    slope = tail * (1 - tail)
    i = np.arange(n)
    prob = np.maximum(tail[i, grades] - tail[i, grades + 1], 1e-9)
    up, down = slope[i, grades] / prob, slope[i, grades + 1] / prob
    d_score = -(up - down) / n
    d_theta = np.zeros(levels - 1)
    np.add.at(d_theta, np.maximum(grades - 1, 0), np.where(grades > 0, up, 0) / n)
    np.add.at(d_theta, np.minimum(grades, levels - 2), np.where(grades < levels - 1, -down, 0) / n)
    gradient = np.concatenate((np.bincount(at, d_score[owner] * value, minlength=m) + l2 * p[:m], [d_theta.sum()], np.cumsum(d_theta[::-1])[::-1][1:] * gaps))
    return float(-np.log(prob).mean() + l2 / 2 * (p[:m] ** 2).sum()), gradient


def fit(bucket: np.ndarray, value: np.ndarray, sizes: np.ndarray, grades: np.ndarray, levels: int, l2: float = 3e-5, steps: int = STEPS) -> OrdinalModel:
    """Maximum likelihood of the cumulative-link model with a ridge penalty, by Adam over all rows, its step falling to zero.

    bucket, value: the rows' features one after the other; sizes: how many each row has.
    """
    if not len(grades):
        return OrdinalModel({}, [-30.0] * (levels - 1))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    value = value.astype(np.float32)
    known, at = np.unique(bucket, return_inverse=True)
    df = np.bincount(at, minlength=len(known))
    moved = np.zeros(len(known))
    for k in range(levels):
        of = (grades == k).astype(float)
        spread = max(of.std(), 1e-9)
        moved = np.maximum(moved, np.abs(np.bincount(at, (of - of.mean())[owner], minlength=len(known))) / (spread * np.sqrt(df)))
    chosen = np.where(known < _SHAPES, (df >= 2) & (moved >= FAINT), df >= 5)
    scale = np.where(known < _SHAPES, np.minimum(moved / MOVES, 1.0) ** 12, 1.0)  # the penalty is the weight's over the scale
    new = np.cumsum(chosen) - 1
    use = chosen[at]
    at, value, owner = new[at[use]], (value * scale[at])[use], owner[use]
    m = int(chosen.sum())
    share = [np.clip((grades >= k).mean(), 1e-3, 1 - 1e-3) for k in range(1, levels)]
    first = [-np.log(s / (1 - s)) for s in share]
    p = np.concatenate((np.zeros(m), [first[0]], np.log(np.maximum(np.diff(first), 0.1))))
    mom, var = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, steps + 1):
        g = loss_and_gradient(p, at, value, owner, grades, levels, l2)[1]
        mom, var = 0.9 * mom + 0.1 * g, 0.999 * var + 0.001 * g * g
        p = p - 0.1 * (1 - (t - 1) / steps) * (mom / (1 - 0.9**t)) / (np.sqrt(var / (1 - 0.999**t)) + 1e-8)
    return OrdinalModel(dict(zip(known[chosen].tolist(), (p[:m] * scale[chosen]).tolist(), strict=True)), thresholds(p, m).tolist())


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t.decode("utf-8", "replace")) for t in texts_of(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), pa.array([list(r) for r in rows], pa.list_(pa.int32())), pa.array([list(r.values()) for r in rows], pa.list_(pa.float32()))], ["doc_id", "grade", "bucket", "value"])


def fit_on(docs: DataFrame, graded: DataFrame, levels: int, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> OrdinalModel:
    """Fit on at most sample rows of graded (doc_id, grade in 0 .. levels - 1).

    Null ids or grades don't count; of several grades of one id the lowest does. The driver gets the rows' features, not
    their texts: one number for each bucket that a text has, at most 2 ** 18 + 4137 a row however long it is.
    """
    graded = graded.where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    few = graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(few), "doc_id").select("doc_id", "grade", "text")
    got = rows.mapInArrow(_sparse, "doc_id long, grade int, bucket array<int>, value array<float>").toArrow().sort_by("doc_id")  # one order, however rows came
    flat = lambda c: got[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return fit(flat("bucket"), flat("value"), pc.list_value_length(got["bucket"]).to_numpy(), got["grade"].to_numpy().astype(np.int64), levels)


def _score(model: OrdinalModel, carry: tuple[str, ...], held: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, known = model.weights, {}
        for batch in batches:
            scores = []
            for t in texts_of(batch.column("text")):
                counts = Counter(t.decode("utf-8", "replace").split())
                total, seen = sum(counts.values()), set()
                s = weights.get(repetition(len(counts), total), 0.0)
                for word, n in counts.items():
                    f = known.get(word)
                    if f is None:
                        w, begin, sh = word_features(word)
                        if len(known) > 500_000:
                            known.clear()
                        f = known[word] = (tuple({w, begin} & weights.keys()), weights.get(sh, 0.0))
                    if f[0]:
                        seen.update(f[0])
                    s += f[1] * n / total
                scores.append(s + sum(weights[w] for w in sorted(seen)))
            tails = model.tails(np.array(scores, dtype=float).reshape(-1))
            cols = [batch.column(c) for c in ("doc_id", *held)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(tails.sum(axis=1)), pa.array(tails[:, -1])], ["doc_id", *carry, "expected_grade", "top_probability"])

    return run


def grade_documents(docs: DataFrame, model: OrdinalModel, least: float = 0.5, carry: tuple[str, ...] = (), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, carried columns, expected_grade, top_probability, keep.

    keep: the probability of the top grade is at least ``least``. Null and empty texts have no features: they get the
    thresholds' own probabilities. Null and repeated ids are kept as they are; an empty table gives no rows.
    """
    held = ["text" if c == text else f"_c{i}" for i, c in enumerate(carry)]
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), *[F.col(c).alias(h) for c, h in zip(carry, held, strict=True) if h != "text"], F.col(text).alias("text"))
    kinds = dict(own.dtypes)
    shape_ = "doc_id long, " + "".join(f"`{c}` {kinds[h]}, " for c, h in zip(carry, held, strict=True)) + "expected_grade double, top_probability double"
    return own.mapInArrow(_score(model, carry, held), shape_).withColumn("keep", F.col("top_probability") >= least)


def label_grades(labels: DataFrame) -> DataFrame:
    """Grades of the table labels: 0 poor, 1 good but toxic, 2 good."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2).alias("grade"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its expected grade and the probability of the top grade."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_on(docs, label_grades(spark.read.parquet(f"{sf_dir}/labels.parquet")), levels=3)
    return grade_documents(docs, model)
