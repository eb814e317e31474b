"""Hard-negative mining by bit-sliced integer products.

Components are integers; the bits of one weight, of all components of a vector, are a bit plane, packed into words. A
product of two vectors is the sum over pairs of planes of their weights times the number of bits that both have. The
planes of the candidates are processed the most significant first (the sign's, of negative weight, at the front). What the
planes to come can add lies between two bounds that the anchor alone gives, so after each plane a candidate's score lies in an
interval that halves; candidates drop out once their interval can't qualify any more, and scores are exact after the last
plane. No candidate that could be among the results is ever dropped.

- Positives: candidates of the anchor's label drop out when K others are surely above. Ties stay until ids decide.
- Negatives: candidates of other labels drop out when they are outside the window of every positive, or below so many
  that are surely inside it as are asked for.

Every anchor meets every candidate, in cells (``vectors.cells``); each cell gives the few best, which are ranked per anchor.

Defined cases: rows with a null id or label, a null vector, or a component that is null or not finite take no part; a
component beyond vectors.MOST in its integer form is an error; vectors of other lengths than an anchor's are no candidates for
it, and empty vectors have score 0 with each other; of rows that repeat an id the first by vector and label counts; ties go
to the smaller id; an anchor without another row of its label gives no rows, nor does a positive without a row in its
window; a positive's score below zero has an empty window; an empty table gives no rows; further columns are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorum.llm.common import cut
from quorum.llm.vectors import by_length, cells, finite, integers, walk

POSITIVES, NEGATIVES, FACTOR = 5, 3, 256
#: A negative's score is at least and at most so many hundredths of the positive's.
LOW, HIGH = 50, 95
_POSITIVE = "anchor_id long, positive_id long, positive_score long"
_NEGATIVE = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def planes(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words by plane and vector, weight of each plane): two's complement, the most significant plane first."""
    least, most = (int(vectors.min()), int(vectors.max())) if vectors.size else (0, 0)
    bits = max(most.bit_length(), (~least).bit_length() if least < 0 else 0) + 1
    width = -(-max(vectors.shape[1], 1) // 64) * 64
    wide = np.zeros((len(vectors), width), np.int64)
    wide[:, : vectors.shape[1]] = vectors
    words = [np.packbits(((wide >> b) & 1).astype(np.uint8), axis=1, bitorder="little").view(np.uint64) for b in reversed(range(bits))]
    weights = np.array([-(1 << (bits - 1)), *(1 << b for b in reversed(range(bits - 1)))], np.int64)
    return np.stack(words), weights


class Block:
    """The candidates of a cell that have vectors of one length."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels = ids, labels
        self.words, self.weights = planes(vectors)
        self.scored = 0  # how many products of a candidate with a plane were taken

    def _narrowing(self, vector: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Yields (candidates left, least, most score) after each plane, and is sent which of them to go on with."""
        words, weights = planes(vector[None])
        words = words[:, 0]
        less, more = int(np.minimum(vector, 0).sum()), int(np.maximum(vector, 0).sum())
        score = np.zeros(len(at), np.int64)
        for own, weight, rest in zip(self.words, self.weights.tolist(), self._rests()):
            both = np.bitwise_count(own[at][:, None, :] & words[None]).sum(axis=2, dtype=np.int64)
            score += weight * (both @ weights)
            self.scored += len(at)
            keep = yield at, score + rest * less, score + rest * more
            at, score = at[keep], score[keep]

    def _rests(self) -> list[int]:
        """The sum of the weights of the planes after each."""
        return [(1 << b) - 1 for b in reversed(range(len(self.weights)))]

    def best(self, anchor: int, label: int, vector: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best candidates of the label, best first."""
        steps = self._narrowing(vector, np.flatnonzero((self.labels == label) & (self.ids != anchor)))
        at, low, high = next(steps)
        while True:
            keep = np.ones(len(at), bool) if len(at) <= k else high >= np.partition(low, len(at) - k)[len(at) - k]
            try:
                at, low, high = steps.send(keep)
            except StopIteration:
                break
        at, low = at[keep], low[keep]
        order = np.lexsort((self.ids[at], -low))[:k]
        return self.ids[at[order]], low[order]

    def windows(self, label: int, vector: np.ndarray, lows: list[int], highs: list[int], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window of scores: (ids, scores) of the k best candidates of other labels within, best first."""
        steps = self._narrowing(vector, np.flatnonzero(self.labels != label))
        at, low, high = next(steps)
        while True:
            keep = np.zeros(len(at), bool)
            for least, most in zip(lows, highs):
                alive = (high >= least) & (low <= most)
                sure = low[(low >= least) & (high <= most)]
                if len(sure) > k:
                    alive &= high >= np.partition(sure, len(sure) - k)[len(sure) - k]
                keep |= alive
            try:
                at, low, high = steps.send(keep)
            except StopIteration:
                break
        at, low = at[keep], low[keep]
        out = []
        for least, most in zip(lows, highs):
            mine = np.flatnonzero((low >= least) & (low <= most))
            order = mine[np.lexsort((self.ids[at[mine]], -low[mine]))[:k]]
            out.append((self.ids[at[order]], low[order]))
        return out


def _blocks(table: pa.Table) -> dict[int, Block]:
    ids, labels = table.column("vec_id").to_numpy(), table.column("label").to_numpy()
    first = np.concatenate([[True], ids[1:] != ids[:-1]])
    out = {}
    for length, (at, vectors) in by_length(table.column("vector")).items():
        new = first[at]
        out[length] = Block(ids[at[new]], labels[at[new]], vectors[new].astype(np.int64))
    return out


def _asked(piece: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, int]]:
    """(anchor, label, vector, row) of each query of a piece."""
    ids, labels = piece.column("vec_id").to_pylist(), piece.column("label").to_pylist()
    for at, vectors in by_length(piece.column("vector")).values():
        for k, vector in zip(at.tolist(), vectors.astype(np.int64)):
            yield ids[k], labels[k], vector, k


def _batch(rows: list[tuple], columns: list[str]) -> pa.RecordBatch | None:
    """Each tuple gives a row for each item of its last array; single values are repeated."""
    if not rows:
        return None
    return pa.record_batch([pa.array(np.concatenate([np.broadcast_to(row[c], row[-1].shape) for row in rows]), pa.int64()) for c in range(len(columns))], columns)


def _positives(k: int):
    def ask(blocks: dict[int, Block], piece: pa.RecordBatch) -> pa.RecordBatch | None:
        rows = [(anchor, *blocks[len(vector)].best(anchor, label, vector, k)) for anchor, label, vector, _ in _asked(piece) if len(vector) in blocks]
        return _batch(rows, ["anchor_id", "positive_id", "positive_score"])

    return lambda batches: walk(batches, _blocks, ask)


def _negatives(k: int, low: int, high: int):
    def ask(blocks: dict[int, Block], piece: pa.RecordBatch) -> pa.RecordBatch | None:
        rows, positives = [], piece.column("positives").to_pylist()
        for _, label, vector, at in _asked(piece):
            if len(vector) in blocks:
                of = positives[at]
                scores = [p["positive_score"] for p in of]
                found = blocks[len(vector)].windows(label, vector, [-(-low * s // 100) for s in scores], [high * s // 100 for s in scores], k)
                rows += [(piece.column("vec_id")[at].as_py(), p["positive_id"], p["positive_score"], *some) for p, some in zip(of, found)]
        return _batch(rows, ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    return lambda batches: walk(batches, _blocks, ask)


def _first(found: DataFrame, by: list[str], score: str, key: str, k: int) -> DataFrame:
    """The k rows of each group with the highest scores, and their rank."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(score).desc(), key))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def mine_negatives(embeddings: DataFrame, is_anchor: Column, label: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, factor: int = FACTOR) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the hard negatives of each anchor and positive."""
    vector = F.col("embedding").cast("array<double>")
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(vector))
    rows = cut(rows.select(F.col("vec_id").cast("long").alias("vec_id"), integers(vector, factor).alias("vector"), label.cast("long").alias("label"), is_anchor.alias("anchor")))
    counts = rows.agg(F.count("*").alias("n"), F.count_if("anchor").alias("anchors")).first()
    candidates = rows.select("vec_id", "vector", "label")
    anchors = rows.where("anchor").groupBy("vec_id").agg(F.min(F.struct("vector", "label")).alias("first")).select("vec_id", "first.vector", "first.label")
    best = cells(candidates, anchors, "vec_id", counts["n"], counts["anchors"]).mapInArrow(_positives(positives), _POSITIVE)
    best = _first(best, ["anchor_id"], "positive_score", "positive_id", positives)
    best = best.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.array_sort(F.collect_list(F.struct("positive_id", "positive_score"))).alias("positives"))  # at most ``positives``
    asked = cut(anchors.join(best, "vec_id"))
    none = F.lit(None).cast(asked.schema["positives"].dataType)
    found = cells(candidates.withColumn("positives", none), asked, "vec_id", counts["n"], counts["anchors"]).mapInArrow(_negatives(negatives, low, high), _NEGATIVE)
    found = _first(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
