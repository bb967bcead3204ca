"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Character 1- to 3-grams of the whole lower-cased text are hashed to ``BUCKETS`` features.  A feature's value is
its share of the text's n-grams times its inverse document frequency, which is counted over *all* documents that
may be learned from.  The weights are trained by follow-the-regularised-leader (FTRL-proximal) with an elastic-net
penalty on a bounded sample of ``SAMPLE`` labelled documents of each language (those with the smallest hashes of
doc_id and text), so that no labelled language is missing; a temperature is then fitted on documents of the sample
that training did not use.

Learned from: text and non-null lang of documents whose crc32(doc_id as text) mod 5 is not 0.

Defined results: a null text, or one without a letter, is ``und`` with score 0; equal texts get equal results;
ties between languages go to the first in sorted order; with nothing to learn from, everything is ``und``; an
empty table gives an empty result; further columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbloom.llm._arrow import tidied, tidy

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
SAMPLE = 800  # documents of each language
SALTS = 64
CALIBRATION = 5  # every fifth document of the sample is kept for the temperature
PASSES = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
FOLDS = 5
UNDETERMINED = "und"


def features(text: str) -> np.ndarray:
    """Hashed features of all character n-grams, with repeats."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
    m = np.uint32(0x9E3779B1)
    out, h = [], np.zeros(len(c), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(c) < n:
            break
        h = (h[: len(c) - n + 1] * m) + c[n - 1 :] + np.uint32(1)
        if n in ORDERS:
            x = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            out.append((x >> np.uint32(17)).astype(np.int32) & (BUCKETS - 1))
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def has_letter(text: str) -> bool:
    return any(ch.isalpha() for ch in text[:64]) or any(ch.isalpha() for ch in text)


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # [BUCKETS, languages], idf folded in
    bias: np.ndarray
    temperature: float

    def logits(self, text: str) -> np.ndarray:
        f = features(text)
        counts = np.bincount(f, minlength=BUCKETS)
        at = np.flatnonzero(counts)
        return (counts[at] / len(f)) @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not has_letter(text):
            return UNDETERMINED, 0.0
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, k: int, passes: int = PASSES, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Per-coordinate FTRL-proximal for the multinomial logistic loss; returns weights and bias."""
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))

    def weights(at):
        zz, nn = z[at], n[at]
        return np.where(np.abs(zz) <= L1, 0.0, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(nn)) / ALPHA + L2))

    rng = np.random.default_rng(seed)
    for _ in range(passes):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            at, x = np.append(at, BUCKETS), np.append(x, 1.0)
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(BUCKETS + 1))
    return w[:-1], w[-1]


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the smallest mean log loss, by golden-section search.

    Targets are smoothed by one wrong label in all documents and one more: where all are told right, no temperature
    but zero would be best otherwise, and every score would be one.
    """
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        z = logits / t
        z = z - z.max(axis=1, keepdims=True)
        logp = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        wrong = 1 / (len(y) + 1)
        return float(-((1 - wrong) * logp[np.arange(len(y)), y] + wrong * logp.mean(axis=1)).mean())

    lo, hi, r = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(np.exp(a)) <= loss(np.exp(b)) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def learnable(docs: DataFrame) -> DataFrame:
    return docs.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all documents each feature occurs, and how many documents there are."""
    blocks = 16
    width = BUCKETS // blocks

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs_seen, mark = np.zeros(BUCKETS, np.int64), 0, np.zeros(BUCKETS, bool)
        for b in batches:
            for text in b.column(0):
                mark[features(text.as_py())] = True
                df += mark
                mark[:] = False
                docs_seen += 1
        if docs_seen:
            yield pa.record_batch([pa.array(range(blocks), pa.int32()), pa.array([docs_seen] * blocks, pa.int64()), pa.array([df[i * width : (i + 1) * width].tobytes() for i in range(blocks)], pa.binary())], names=["block", "docs", "df"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(width, np.int64), 0
        for b in batches:
            for n, x in zip(b.column("docs").to_pylist(), b.column("df").to_pylist()):
                total += np.frombuffer(x, np.int64)
                seen += n
        yield pa.record_batch([pa.array([key[0].as_py()], pa.int32()), pa.array([seen], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["block", "docs", "df"])

    schema = "block int, docs bigint, df binary"
    rows = docs.select("text").mapInArrow(count, schema).groupBy("block").applyInArrow(add, schema).collect()  # 16 rows of fixed size
    df = np.zeros(BUCKETS, np.int64)
    for r in rows:
        df[r.block * width : (r.block + 1) * width] = np.frombuffer(r.df, np.int64)
    return df, max((r.docs for r in rows), default=0)


def sample(docs: DataFrame, size: int = SAMPLE) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """Language, features and their counts of ``size`` labelled documents of each language, in a fixed order.

    Those with the smallest hashes of doc_id and text; rows that repeat count once.  Features are counted where the texts
    are, so the driver gets ``size`` rows of at most BUCKETS numbers for a language.
    """
    keyed = docs.select("lang", "text", F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("t"))
    part = F.pmod("t", F.lit(SALTS))
    # First within parts of a language, so that no task gets more than SALTS * size rows of a common one.
    rank = F.row_number().over(Window.partitionBy("lang", part).orderBy("h", "t"))
    some = keyed.select("lang", "h", "t").distinct().withColumn("r", rank).where(F.col("r") <= size)
    chosen = some.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "t"))).where(F.col("r") <= size)
    edges = chosen.groupBy("lang").agg(F.max("h").alias("eh"), F.max_by("t", F.struct("h", "t")).alias("et")).collect()
    # One row a language, as the model has a column for each; so it may go to every task.
    edges = docs.sparkSession.createDataFrame([tuple(r) for r in edges], "lang string, eh bigint, et bigint")
    below = (F.col("h") < F.col("eh")) | ((F.col("h") == F.col("eh")) & (F.col("t") <= F.col("et")))
    near = keyed.join(F.broadcast(edges), "lang").where(below).groupBy("lang", "h", "t").agg(F.first("text").alias("text"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, n, keep = [], [], []
            for text in b.column(3).to_pylist():
                x, c = np.unique(features(text), return_counts=True)
                at.append(x.astype(np.int32))
                n.append(c.astype(np.int32))
                keep.append(has_letter(text))
            yield pa.record_batch([*b.columns[:3], pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int32()))], names=["lang", "h", "t", "at", "n"]).filter(pa.array(keep, pa.bool_()))

    rows = near.mapInArrow(run, "lang string, h bigint, t bigint, at array<int>, n array<int>").toArrow().sort_by([("h", "ascending"), ("t", "ascending"), ("lang", "ascending")])
    return [(lang, at.values.to_numpy().copy(), n.values.to_numpy().copy()) for lang, at, n in zip(rows["lang"].to_pylist(), rows["at"], rows["n"])]


def fit(docs: DataFrame, size: int = SAMPLE) -> Model:
    docs = learnable(docs.select(*[docs[c] for c in ("doc_id", "text", "lang")]))
    df, n = document_frequencies(docs)
    rows = sample(docs, size)
    langs = sorted({lang for lang, _, _ in rows})
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    idf = np.log((1 + n) / (1 + df)) + 1.0
    y = np.array([langs.index(lang) for lang, _, _ in rows])
    sparse = [(at, c / c.sum() * idf[at] * 10) for _, at, c in rows]
    held = np.arange(len(rows)) % CALIBRATION == 0
    if held.all():
        held[:] = False
    train = [s for s, h in zip(sparse, held) if not h]
    w, b = ftrl(train, y[~held], len(langs))
    logits = np.array([x @ w[at] + b for (at, x), h in zip(sparse, held) if h]).reshape(-1, len(langs))
    model = Model(langs, w * idf[:, None] * 10, b, temperature(logits, y[held]))
    del rows, sparse, train
    tidied(docs.sparkSession)
    return model


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    model = model or fit(docs)
    broadcast = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages numbers

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = broadcast.value
        for b in batches:
            ids = b.column(0).to_pylist()
            found = [m.predict(t.as_py()) for t in b.column(1)]
            held = [zlib.crc32(str(i).encode()) % FOLDS == 0 if i is not None else False for i in ids]
            yield pa.record_batch([b.column(0), pa.array(held, pa.bool_()), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, least: float = 0.2) -> DataFrame:
    """The documents whose language is determined, with all their columns; a null lang becomes the one predicted.

    A score must be ``least`` of the way from chance (one in the number of languages) to certainty: texts in languages
    that were not learned, and junk, score close to chance.  Null texts and those without a letter go; repeated rows
    stay repeated; an empty table stays empty.
    """
    model = fit(docs)
    chance = 1 / max(1, len(model.langs))
    edge = chance + least * (1 - chance)
    broadcast = docs.sparkSession.sparkContext.broadcast(model)
    text, lang = docs.columns.index("text"), docs.columns.index("lang")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = broadcast.value
        for b in batches:
            found = [m.predict(t.as_py()) for t in b.column(text)]
            cols = list(b.columns)
            cols[lang] = pa.array([old if old is not None else new for old, (new, _) in zip(b.column(lang).to_pylist(), found)], cols[lang].type)
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names).filter(pa.array([x != UNDETERMINED and score >= edge for x, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
