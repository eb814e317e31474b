"""Toxicity by subword-bag embeddings: word vectors are averaged into a linear softmax, all trained jointly in numpy.

A word's vector is the mean of the vectors of its hashed character n-grams, with its borders, so misspellings that were never seen share most of their vector with known words. A text is the mean of its words; a
linear softmax scores it. Training uses a bounded sample of labelled rows (TOXIC_ROWS and CLEAN_ROWS in expectation,
at most twice that in all, and at most SAMPLE_BYTES of text, of which no text is more than a hundredth) and, as further clean examples, a few words drawn from each
clean text: every part of a clean text is clean, which keeps single words from being blamed by accident. Scoring covers
every whole text, however long.

Defined cases: a text that is null or has no word gets the softmax of the biases; without labelled rows of both
classes every score is 0, or 1 if all there are are toxic; null labels and ids are left aside in training; repeated
rows are scored alike, as are equal texts; a tie with the threshold counts as toxic; an empty table gives no rows; all
columns of the input are kept, and the new one has underscores put in front of its name while the input has one of that
name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorum.llm.common import cut, text_udf, unused
from quorum.llm.textops import mix64

#: Bounds of the training sample, and the shape of the training.
TOXIC_ROWS, CLEAN_ROWS, SAMPLE_BYTES = 1_200, 3_600, 48 << 20
EPOCHS, LEAST_STEPS, BATCH, RATE, DECAY, EPSILON = 6, 1_500, 64, 0.05, 0.02, 1e-5
DRAWS, DRAWN_WORDS, TOXIC_WEIGHT = 8, 12, 12
BUCKETS, DIM, NGRAMS = 1 << 17, 8, (3, 4)
THRESHOLD = 0.3
#: One empty bag for so many others in training.
EMPTY_SHARE = 50
#: Factor on the averaged vector: a text has few telling words among many.
SCALE = 40.0
CHUNK_CHARS = 1 << 18
_ORDER = ["place", "text", "toxic"]
_PLACES = mix64(np.arange(1, 1 + max(NGRAMS), dtype=np.uint64), 0x70C) | np.uint64(1)


def _runs(texts: list[str | None]) -> Iterator[list[str]]:
    run, size = [], 0
    for text in texts:
        text = "" if text is None else text
        if run and size + len(text) > CHUNK_CHARS:
            yield run
            run, size = [], 0
        run.append(text.lower())
        size += len(text) + 1
    if run:
        yield run


def subwords(run: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each subword, its word, subwords of each word, words before each text and in all) of a run of texts."""
    codes = np.frombuffer((" " + " ".join(run) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    space = (codes == 32) | ((codes >= 9) & (codes <= 13))
    codes = np.where(space, 32, codes).astype(np.uint64)
    edge = np.flatnonzero(np.diff(space.view(np.int8)))
    starts, ends = edge[0::2] + 1, edge[1::2] + 1
    # lower() may change a text's length, so lengths are taken after it
    bounds = np.searchsorted(starts, np.cumsum([1, *(len(x) + 1 for x in run)]))
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, bounds
    word_of = np.repeat(np.arange(len(starts)), ends - starts)
    inside = np.flatnonzero(~space)
    buckets, words = [], []
    second = np.full(len(codes), -1)
    second[inside] = word_of
    hashed = np.zeros(len(codes), np.uint64)
    open_ = np.ones(len(codes), bool)
    for n in range(1, max(NGRAMS) + 1):  # of the n characters from each place on: their hash, and whether no space is within
        last = codes[n - 1 :]
        hashed = hashed[: len(last)] + last * _PLACES[n - 1]
        if n > 2:
            open_ = open_[: len(last)] & ~space[n - 2 : n - 2 + len(last)]
        if n in NGRAMS:
            at = np.flatnonzero(open_[: len(last)])
            buckets.append(mix64(hashed[at], n))
            words.append(second[at + 1])
    words = np.concatenate(words)
    return (np.concatenate(buckets) % np.uint64(BUCKETS)).astype(np.int64), words, np.bincount(words, minlength=len(starts)), bounds


class Model:
    """The score of each bucket (its vector through the softmax layer), and the bias."""

    def __init__(self, buckets: np.ndarray, bias: float):
        self.buckets, self.bias = buckets, bias

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Share of the toxic class for each text."""
        out = []
        for run in _runs(texts):
            buckets, words, sizes, bounds = subwords(run)
            each = np.bincount(words, self.buckets[buckets], len(sizes)) / np.maximum(sizes, 1)
            sums = np.concatenate([[0.0], np.cumsum(each)])
            out.append((sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(np.diff(bounds), 1))
        logits = SCALE * np.concatenate([np.zeros(0), *out]) + self.bias
        return 1 / (1 + np.exp(-np.clip(logits, -700, 700)))


def _bags(texts: list[str], labels: np.ndarray, rng: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(buckets, their weights in the mean, label) of each text, and of words drawn from each clean one."""

    def bag(chosen: np.ndarray, label: int):
        ids = np.concatenate([buckets[offsets[w] : offsets[w + 1]] for w in chosen]) if len(chosen) else buckets[:0]
        weights = np.repeat(1 / sizes[chosen] / max(len(chosen), 1), sizes[chosen])
        used, place = np.unique(ids, return_inverse=True)
        return used.astype(np.int32), np.bincount(place, weights, len(used)).astype(np.float32), label

    at = 0
    for run in _runs(texts):
        buckets, words, sizes, bounds = subwords(run)
        buckets = buckets[np.argsort(words, kind="stable")]
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            label = int(labels[at])
            at += 1
            yield bag(np.arange(a, b), label)
            if not label and b > a:
                for _ in range(DRAWS):
                    yield bag(rng.integers(a, b, DRAWN_WORDS), 0)


def train(texts: list[str], labels: list[int], seed: int = 5) -> Model:
    """Embeddings and softmax layer by Adam on the cross entropy; labels are 0 or 1."""
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 700.0 if 1 in labels else -700.0)
    rng = np.random.default_rng(seed)
    rows = list(_bags(texts, np.array(labels), rng))
    nothing = np.zeros(0, np.int32), np.zeros(0, np.float32), 0  # a text without known words is clean
    rows += [nothing] * (len(rows) // EMPTY_SHARE + 1)
    p = {"e": rng.normal(0, 0.02, (BUCKETS, DIM)).astype(np.float32), "u": rng.normal(0, 0.5, (DIM, 2)).astype(np.float32), "b": np.zeros(2, np.float32)}
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    epochs = max(EPOCHS, -(-LEAST_STEPS * BATCH // len(rows)))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            batch = [rows[i] for i in order[at : at + BATCH]]
            ids = np.concatenate([row[0] for row in batch])
            used, place = np.unique(ids, return_inverse=True)
            x = np.zeros((len(batch), len(used)), np.float32)
            x[np.repeat(np.arange(len(batch)), [len(row[0]) for row in batch]), place] = np.concatenate([row[1] for row in batch])
            x *= SCALE
            hidden = x @ p["e"][used]
            logits = hidden @ p["u"] + p["b"]
            d = np.exp(logits - logits.max(1, keepdims=True))
            d /= d.sum(1, keepdims=True)
            d[np.arange(len(batch)), [label for *_, label in batch]] -= 1
            d *= np.array([[TOXIC_WEIGHT if label else 1] for *_, label in batch]) / len(batch)
            grad = {"u": hidden.T @ d, "b": d.sum(0), "e": x.T @ (d @ p["u"].T)}
            step += 1
            for k in p:
                rows_ = used if k == "e" else slice(None)  # of the embeddings, only those of this batch
                m[k][rows_] += 0.1 * (grad[k] - m[k][rows_])
                v[k][rows_] += 0.01 * (grad[k] ** 2 - v[k][rows_])
                p[k][rows_] -= rate * ((m[k][rows_] / (1 - 0.9**step)) / (np.sqrt(v[k][rows_] / (1 - 0.99**step)) + EPSILON) + (DECAY * p[k][rows_] if k == "e" else 0))
    table = p["e"] @ (p["u"][:, 1] - p["u"][:, 0])
    seen = np.zeros(BUCKETS, bool)
    for ids, *_ in rows:
        seen[ids] = True
    table[~seen] = 0.0  # a bucket that no text has used says nothing
    return Model(table.astype(np.float32), float(p["b"][1] - p["b"][0]))


def _sample(docs: DataFrame, labels: DataFrame, learn: Column, toxic_rows: int, clean_rows: int) -> DataFrame:
    """(place, text, toxic) of the rows of ``labelled_sample``."""
    most = 2 * (toxic_rows + clean_rows)
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & learn).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}  # two rows
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), F.col("doc_id")), F.lit(1_000_000)) / 1e6
    rate = F.when(F.col("toxic") == 1, toxic_rows / max(counts.get(1, 0), 1)).otherwise(clean_rows / max(counts.get(0, 0), 1))
    drawn = known.where(draw < rate).dropDuplicates().orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(most)
    rows = docs.select("doc_id", "text").where(F.octet_length("text") <= SAMPLE_BYTES // 100).join(F.broadcast(drawn), "doc_id").select("text", "toxic")
    rows = cut(rows.withColumn("place", F.xxhash64("text")).orderBy(*_ORDER).limit(most))
    sizes = rows.groupBy("place").agg(F.sum(F.octet_length("text")).alias("size")).orderBy("place").collect()  # at most ``most`` pairs of numbers
    ends = np.cumsum([r["size"] for r in sizes])
    last = int(np.searchsorted(ends, SAMPLE_BYTES, side="right"))
    if last < len(sizes):
        rows = rows.where(F.col("place") < sizes[last]["place"])
    return rows


def labelled_sample(docs: DataFrame, labels: DataFrame, learn: Column, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> list[tuple[str, int]]:
    """(text, toxic) of a bounded sample of the labelled documents whose id ``learn`` accepts, alike on every run."""
    return [(r["text"], r["toxic"]) for r in _sample(docs, labels, learn, toxic_rows, clean_rows).orderBy(*_ORDER).collect()]


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row, the model of all rows that come."""
    texts, labels = [], []
    for batch in batches:
        texts += batch.column("text").to_pylist()
        labels += batch.column("toxic").to_pylist()
    model = train(texts, labels)
    yield pa.record_batch([pa.array([model.buckets.tobytes()], pa.binary()), pa.array([model.bias], pa.float64())], ["buckets", "bias"])


def train_on(docs: DataFrame, labels: DataFrame, learn: Column) -> Model:
    """The model of the labelled sample, trained in a task: the driver sees the scores of the buckets, not the texts."""
    sample = _sample(docs, labels, learn, TOXIC_ROWS, CLEAN_ROWS).repartition(1).sortWithinPartitions(*_ORDER)
    found = sample.select("text", "toxic").mapInArrow(_trained, "buckets binary, bias double").collect()  # one row at most
    return Model(np.frombuffer(found[0]["buckets"], np.float32), found[0]["bias"]) if found else train([], [])


def with_scores(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """The same rows and columns and the score of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scorer():
        return lambda texts: pa.array(shared.value.scores(texts), pa.float64())

    return docs.withColumn(unused(docs, name), text_udf("double", scorer)("text"))
