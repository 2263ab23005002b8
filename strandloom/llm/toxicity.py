"""Toxicity by class-conditional Kneser-Ney models over the letters of words.

Two models, toxic and ordinary, give the log-likelihood of each word's bytes (word
start and end included) from the ``ORDER - 1`` bytes before. The highest order is
counted per class; all lower orders are Kneser-Ney continuation counts shared by both
classes, so a rare expression falls back on the same distribution in either model and
only what its class has really shown moves the score. A toxic document is for the most
part ordinary: its likelihood is that of words drawn from the toxic model with
probability ``SHARE`` and else from the ordinary one. A document's value is the
difference of the two log-likelihoods divided by its number of words; a logistic
curve, fitted on labelled rows that the counts have not seen, maps it to 0..1.

Bounds: the models are fitted on at most ``per_class`` labelled documents of either
class and the curve on at most ``per_class`` others, those with the smallest hash of
their id (a documented sample of the labelled rows). Every document is scored whole.
The model's size is bounded by that sample's distinct n-grams.

Defined results: a null text, or one without words, has difference 0 and gets the
curve's value there. Labels that are null are ignored; of several labels of one id
the largest holds. Where either class has no training rows every score is the
share of toxic ones among the training rows, or 0 without any. Rows that repeat an
id are each scored. Input columns named like a result column are replaced.
"""

from __future__ import annotations

import sys
import uuid

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, UPPER, Scratch, passthrough, quoted, table, trimmed
from .contamination import words

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RESULT = ("score", "predicted")
ORDER = 6
PER_CLASS = 4000
#: Of a toxic document's words, those that the toxic model draws.
SHARE = 0.005
#: Discount of the highest order: what a class shows once counts for little there.
TOP_DISCOUNT = 0.95
#: Distinct words whose value a worker remembers.
CACHE = 400_000
#: Maps A-Z to a-z and every separator byte to a space, so that split() gives the words.
_FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 else 32 for b in range(256))


def split_words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each word, and its end: the packed ORDER bytes up to it; and its word's number."""
    pad = b"\x02" * (ORDER - 1)
    joined = np.frombuffer(b"".join(pad + w + b"\x03" for w in words), dtype=np.uint8).astype(np.uint64)
    sizes = np.fromiter((len(w) + ORDER for w in words), dtype=np.int64, count=len(words))
    key = np.zeros(len(joined), dtype=np.uint64)
    for back in range(ORDER):
        key[ORDER - 1 :] |= joined[ORDER - 1 - back : len(joined) - back] << np.uint64(8 * back)
    word_of = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(len(joined)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    inside = at >= ORDER - 1
    return key[inside], word_of[inside]


def _totals(keys: np.ndarray, weights: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    found, inverse = np.unique(keys, return_inverse=True)
    return found, [np.bincount(inverse, w, len(found)) for w in weights]


def _discount(counts: np.ndarray) -> float:
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5


def fit(vocabulary: list[bytes], ordinary: np.ndarray, toxic: np.ndarray) -> dict[str, np.ndarray]:
    """Tables of log ratios: of each seen n-gram, and of each seen context for what is unseen after it."""
    parts = []
    for at in range(0, len(vocabulary), 50_000):  # the whole vocabulary's n-grams at once would not fit a small driver
        grams, word_of = _grams(vocabulary[at : at + 50_000])
        parts.append(_totals(grams, [ordinary[at + word_of], toxic[at + word_of]]))
    keys, counts = _totals(np.concatenate([k for k, _ in parts]), [np.concatenate([c[i] for _, c in parts]) for i in (0, 1)])
    del parts
    # shared orders, from the lowest up: continuation counts are numbers of distinct left neighbours
    mask = [np.uint64((1 << (8 * n)) - 1) for n in range(ORDER + 1)]
    distinct = {ORDER: keys}
    for n in range(ORDER - 1, 0, -1):
        distinct[n] = np.unique(distinct[n + 1] & mask[n])
    shared = np.full(1, 1 / 256)  # of the empty n-gram
    below_keys = np.zeros(1, dtype=np.uint64)
    for n in range(1, ORDER):
        own = distinct[n]
        left = np.bincount(np.searchsorted(own, distinct[n + 1] & mask[n]), minlength=len(own)).astype(float)
        context, inverse = np.unique(own >> np.uint64(8), return_inverse=True)
        total, kinds = np.bincount(inverse, left, len(context)), np.bincount(inverse, minlength=len(context))
        d = _discount(left)
        lower = shared[np.searchsorted(below_keys, own & mask[n - 1])]
        shared = (left - d) / total[inverse] + d * kinds[inverse] / total[inverse] * lower
        below_keys = own
    base = shared[np.searchsorted(below_keys, keys & mask[ORDER - 1])]
    contexts, inverse = np.unique(keys >> np.uint64(8), return_inverse=True)
    top, back = [], []
    for c in counts:
        total, kinds = np.bincount(inverse, c, len(contexts)), np.bincount(inverse, c > 0, len(contexts))
        d = TOP_DISCOUNT
        rest = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
        top.append(np.maximum(c - d, 0) / np.maximum(total[inverse], 1) + rest[inverse] * base)
        back.append(rest)
    return {"grams": keys, "ratio": np.log(top[1] / top[0]).astype(np.float32), "contexts": contexts, "unseen": np.log(back[1] / back[0]).astype(np.float32)}


def word_values(model: dict[str, np.ndarray], vocabulary: list[bytes]) -> np.ndarray:
    """Per word, the log of the mixture's likelihood over the ordinary model's."""
    if not vocabulary:
        return np.zeros(0)
    grams, word_of = _grams(vocabulary)
    at = np.minimum(np.searchsorted(model["grams"], grams), len(model["grams"]) - 1)
    seen = model["grams"][at] == grams
    context = grams >> np.uint64(8)
    over = np.minimum(np.searchsorted(model["contexts"], context), len(model["contexts"]) - 1)
    value = np.where(seen, model["ratio"][at], np.where(model["contexts"][over] == context, model["unseen"][over], 0.0))
    ratio = np.bincount(word_of, value, len(vocabulary))
    return np.log(1 - SHARE + SHARE * np.exp(np.minimum(ratio, 15)))


def document_values(model: dict[str, np.ndarray], texts, cache: dict[bytes, float]) -> list[float]:
    """Length-normalised log-likelihood differences of texts given as bytes or None."""
    split = [split_words(t) if t else [] for t in texts]
    fresh = list(set().union(*split).difference(cache))
    for start in range(0, len(fresh), 50_000):
        part = fresh[start : start + 50_000]
        cache.update(zip(part, word_values(model, part).tolist()))
    out = [sum(map(cache.__getitem__, w)) / len(w) if w else 0.0 for w in split]
    if len(cache) > CACHE:
        cache.clear()
    return out


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a lightly regularised logistic curve, by Newton steps; the slope is never negative."""
    scale = float(np.std(x)) or 1.0
    design = np.stack([x / scale, np.ones(len(x))], axis=1)
    w, ridge = np.zeros(2), np.diag([1e-2, 1e-4])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + ridge, design.T @ (y - p) - ridge @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(0.0, float(w[0]) / scale), float(w[1])


def values_of(docs: DataFrame, model: dict[str, np.ndarray], text_col: str, carry: list[str], name: str = "value") -> DataFrame:
    """The ``carry`` columns and a double ``name`` for every row."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    out = T.StructType([*[docs.schema[c] for c in carry], T.StructField(name, T.DoubleType())])

    def score(batches):
        cache: dict[bytes, float] = {}
        for b in batches:
            text = b.column(b.num_columns - 1).cast(pa.large_binary())
            for start in range(0, b.num_rows, 256):  # long texts: few at a time as lists of words
                part = b.slice(start, 256)
                got = document_values(shipped.value, (x.as_py() for x in text.slice(start, 256)), cache)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(got, pa.float64())], names=[*part.schema.names[:-1], name])

    return docs.select(*[quoted(c) for c in carry], quoted(text_col).alias("__text")).mapInArrow(trimmed(score), out)


def _bucket(id_col):
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(5))


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", per_class: int = PER_CLASS):
    """(model or None, slope, offset) from the labelled rows whose crc32(id) mod 5 is not 0."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    known = labels.where(quoted(label_col).isNotNull() & quoted(id_col).isNotNull()).groupBy(quoted(id_col).alias("__id")).agg((F.max(quoted(label_col)) >= 1).alias("bad"))
    known = known.withColumn("part", _bucket(F.col("__id"))).where("part <> 0").withColumn("h", F.xxhash64("__id"))

    def first(df):
        return df.orderBy("h", "__id").limit(per_class)

    fitted = first(known.where("part > 1 AND bad")).unionByName(first(known.where("part > 1 AND NOT bad"))).withColumn("use", F.lit("fit"))
    curve = first(known.where("part = 1")).withColumn("use", F.lit("curve"))
    chosen = scratch.write(fitted.unionByName(curve).select("__id", "bad", "use"), "chosen")  # at most 3 * per_class rows
    rows = docs.select(quoted(id_col).alias("__id"), F.coalesce(quoted(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "__id")
    rows = scratch.write(rows, "rows")
    n_bad, n = rows.agg(F.count(F.when(F.col("bad"), 1)), F.count("*")).first()
    counted = rows.where("use = 'fit'").select("bad", F.explode(words(F.col("text"))).alias("w")).groupBy("w").agg(F.count(F.when(~F.col("bad"), 1)).alias("ordinary"), F.count(F.when(F.col("bad"), 1)).alias("toxic"))
    got = counted.toPandas()  # distinct words of the bounded sample
    if not got.ordinary.sum() or not got.toxic.sum():
        return None, 0.0, float(np.log((n_bad or 1e-9) / max(n - n_bad, 1e-9))) if n else -50.0
    model = fit([w.encode() for w in got.w], got.ordinary.to_numpy(float), got.toxic.to_numpy(float))
    held = values_of(rows.where("use = 'curve'").select("bad", "text"), model, "text", ["bad"]).toPandas()
    if held.bad.nunique() < 2:
        held = values_of(rows.select("bad", "text"), model, "text", ["bad"]).toPandas()
    return model, *_logistic(held["value"].to_numpy(float), held.bad.to_numpy(float))


def _score(value, slope: float, offset: float):
    return 1 / (1 + F.exp(-(value * slope + offset)))


def toxicity(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", per_class: int = PER_CLASS, carry: list[str] | None = None) -> DataFrame:
    """Every row (its ``carry`` columns, all by default) with score and predicted."""
    model, slope, offset = train(docs, labels, text_col, id_col, label_col, per_class)
    carry = [c for c in (carry or docs.columns) if c.casefold() not in RESULT]
    if model is None:
        valued = docs.select(*[quoted(c) for c in carry], F.lit(0.0).alias("value"))
    else:
        valued = values_of(docs, model, text_col, carry)
    score = _score(F.col("value"), slope, offset)
    return valued.select(*[quoted(c) for c in carry], score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", per_class: int = PER_CLASS) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all of their columns, whatever these are called."""
    value = f"__value_{uuid.uuid4().hex[:8]}"
    model, slope, offset = train(docs, labels, text_col, id_col, label_col, per_class)
    valued = docs.withColumn(value, F.lit(0.0)) if model is None else values_of(docs, model, text_col, docs.columns, value)
    return valued.where(~(_score(F.col(value), slope, offset) >= 0.5)).drop(value)


def op6_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity(docs, table(spark, sf_dir, "labels"), carry=["doc_id"])
    return scored.select("doc_id", (_bucket(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLES: dict[str, str] = {}
