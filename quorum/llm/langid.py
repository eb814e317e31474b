"""Language identification by hyperdimensional profiles.

Every letter has a random vector of DIMS signs, drawn from its code point. A trigram binds (multiplies) its letters'
vectors, permuted (rolled) by their place; a text bundles (adds) its trigrams, and a language bundles the normalised
vectors of its training texts. A text has the language whose prototype is nearest by cosine, ties to the first by code
point. Runs of anything but letters count as one border, itself a letter of the trigrams.

Training uses a bounded sample (ROWS_PER_LANG rows of each language in expectation); prototypes are summed on the
executors. Only where there are at most SLICE_LANGS languages does the driver hold all prototypes; more are taken in
slices of that many, each of which is compared with all texts, and each text keeps the best so far.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as is every text where nothing was learned;
very long texts are taken whole; rows without a language are not learned from; rows without an id are drawn by their
text; repeated rows are treated alike; an empty table gives no rows; all columns of the input are kept, and the new one
has underscores put in front of its name while the input has one of that name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorum.llm.common import cut, frames, lookup, text_udf, unused
from quorum.llm.textops import mix64

DIMS, GRAM = 512, 3
ROWS_PER_LANG = 1_000
#: Languages whose prototypes (4 KB each) are held at a time, and up to which their sampling rates (100 bytes each) are sent to every executor.
SLICE_LANGS, BROADCAST_LANGS = 1_000, 50_000
CHUNK_CHARS, CHUNK_TEXTS, GRAM_BLOCK = 1 << 20, 256, 8_192
#: Normalised vectors are summed as whole numbers of this fraction, so that sums don't depend on their order.
UNIT = 1 << 20
UNKNOWN = "und"
_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _LETTER


def letter_vectors(codes: np.ndarray) -> np.ndarray:
    """The random signs of each code point, drawn by hashing."""
    draws = mix64(codes.astype(np.uint64)[:, None] * np.uint64(DIMS // 64) + np.arange(DIMS // 64, dtype=np.uint64), 0x1D)
    return np.unpackbits(draws.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """Binds the letters of each row of code points."""
    used, at = np.unique(grams, return_inverse=True)
    at = at.reshape(grams.shape)
    letters = letter_vectors(used)
    out = np.ones((len(grams), DIMS), np.int8)
    for k in range(GRAM):
        out *= np.roll(letters, GRAM - 1 - k, axis=1)[at[:, k]]
    return out


def _runs(texts: list[str | None]) -> Iterator[list[str]]:
    run, size = [], 0
    for text in texts:
        text = "" if text is None else text
        if run and (size + len(text) > CHUNK_CHARS or len(run) == CHUNK_TEXTS):
            yield run
            run, size = [], 0
        run.append(text.lower())
        size += len(text)
    if run:
        yield run


def text_vectors(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The bundled trigrams of runs of texts, in order: a row of whole numbers for each."""
    letter = _letters()
    for run in _runs(texts):
        codes = np.frombuffer("".join(f" {t} " for t in run).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        text_of = np.repeat(np.arange(len(run)), [len(t) + 2 for t in run])
        is_letter = letter[codes]
        kept = is_letter | np.concatenate([[True], is_letter[:-1] | (text_of[1:] != text_of[:-1])])  # one border for a run of them
        codes, text_of = np.where(is_letter, codes, 32)[kept], text_of[kept]
        n = len(codes) - GRAM + 1
        whole = (text_of[:n] == text_of[GRAM - 1 :]) & (np.bincount(text_of, codes != 32, len(run)) > 0)[text_of[:n]]
        at = np.flatnonzero(whole)
        out = np.zeros((len(run), DIMS), np.float32)
        if len(at):
            alphabet = np.flatnonzero(np.bincount(codes, minlength=1))
            index = np.zeros(int(codes.max()) + 1, np.int64)
            index[alphabet] = np.arange(len(alphabet))
            size = len(alphabet)
            own = index[codes]
            keys = (own[at] * size + own[at + 1]) * size + own[at + 2]
            if size**GRAM <= 1 << 22:
                grams = np.flatnonzero(np.bincount(keys, minlength=size**GRAM))
                place = np.zeros(size**GRAM, np.int64)
                place[grams] = np.arange(len(grams))
                place = place[keys]
            else:
                grams, place = np.unique(keys, return_inverse=True)
            for first in range(0, len(grams), GRAM_BLOCK):
                block = grams[first : first + GRAM_BLOCK]
                some = (place >= first) & (place < first + GRAM_BLOCK)
                counts = np.bincount(text_of[at[some]] * len(block) + place[some] - first, minlength=len(run) * len(block))
                vectors = gram_vectors(alphabet[np.stack([block // size**2, block // size % size, block % size], axis=1)])
                out += counts.reshape(len(run), -1).astype(np.float32) @ vectors.astype(np.float32)
        yield out


def _bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}

    def flushed() -> pa.RecordBatch:
        out = pa.record_batch([pa.array(list(sums), pa.string()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.int64()))], ["lang", "bundle"])
        sums.clear()
        return out

    for piece in frames(batches, "text"):
        at = 0
        langs = piece["lang"].tolist()
        for vectors in text_vectors(piece["text"].tolist()):
            norms = np.maximum(np.linalg.norm(vectors.astype(np.float64), axis=1, keepdims=True), 1)
            units = np.rint(vectors / norms * UNIT).astype(np.int64)
            for lang, row in zip(langs[at : at + len(units)], units):
                sums[lang] = sums.get(lang, 0) + row
            at += len(units)
        if len(sums) > SLICE_LANGS:
            yield flushed()
    if sums:  # a partition may be empty
        yield flushed()


def learn(docs: DataFrame, accept: Column, rows_per_lang: int = ROWS_PER_LANG) -> DataFrame:
    """(lang, bundle): the prototype of each language, not normalised, from a bounded sample of the rows that ``accept`` takes."""
    rows = docs.where(F.col("lang").isNotNull() & accept).select("lang", F.xxhash64(F.lit("language"), "doc_id", "text").alias("_draw"), "text")
    counts = cut(rows.groupBy("lang").agg(F.count("*").alias("n")).withColumn("_rate", F.lit(float(rows_per_lang)) / F.col("n")))
    rated = rows.join(F.broadcast(counts.drop("n")), "lang") if counts.count() <= BROADCAST_LANGS else lookup(rows, counts, "lang")
    drawn = rated.where(F.pmod("_draw", F.lit(1_000_000)) / 1e6 < F.col("_rate")).select("lang", "text")
    bundles = drawn.mapInArrow(_bundled, "lang string, bundle array<long>")
    sums = bundles.select("lang", F.posexplode("bundle").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"))
    return cut(sums.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("bundle")))


def _slices(learned: DataFrame) -> Iterator[tuple[list[str], np.ndarray]]:
    """(languages by code point, prototypes of length 1) of slices of SLICE_LANGS languages; one slice, empty perhaps, at least."""
    last = None
    while True:
        some = learned if last is None else learned.where(F.col("lang") > last)
        found = [(r["lang"], r["bundle"]) for r in some.orderBy("lang").limit(SLICE_LANGS).collect()]
        if last is None or found:
            prototypes = np.array([x for _, x in found], dtype=np.float64).reshape(len(found), DIMS)
            yield [lang for lang, _ in found], prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1)
        if len(found) < SLICE_LANGS:
            return
        last = found[-1][0]


def predict(texts: list[str | None], langs: list[str], prototypes: np.ndarray) -> tuple[list[str], np.ndarray]:
    """(language, cosine with its prototype, at least 0) of each text."""
    names, scores = [], [np.zeros(0)]
    for vectors in text_vectors(texts):
        norms = np.linalg.norm(vectors.astype(np.float64), axis=1)
        if not langs:
            names += [UNKNOWN] * len(vectors)
            scores.append(np.zeros(len(vectors)))
            continue
        cosines = vectors @ prototypes.T / np.maximum(norms, 1)[:, None]
        best = cosines.argmax(axis=1)
        names += [langs[k] if n > 0 else UNKNOWN for k, n in zip(best, norms)]
        scores.append(np.where(norms > 0, np.clip(cosines[np.arange(len(best)), best], 0, 1), 0.0))
    return names, np.concatenate(scores)


_FOUND = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])


def _identifier(langs: list[str], prototypes: np.ndarray):
    def of(texts: list[str | None]) -> pa.Array:
        names, scores = predict(texts, langs, prototypes)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], fields=list(_FOUND))

    return text_udf("lang_pred string, score double", lambda: of)


def with_languages(docs: DataFrame, learned: DataFrame, name: str = "language") -> DataFrame:
    """The same rows and columns and ``name``: (lang_pred, score), from the prototypes of ``learn``."""
    name, out = unused(docs, name), docs
    best = unused(docs, f"{name}_best")
    for k, (langs, prototypes) in enumerate(_slices(learned)):
        found = _identifier(langs, prototypes)("text")
        if not k:
            out = out.withColumn(name, found)
            continue
        out = out.withColumn(best, found)  # of equal scores the first by code point, which came before
        better = (F.col(f"{best}.lang_pred") != UNKNOWN) & (F.col(f"{best}.score") > F.col(f"{name}.score"))
        out = out.withColumn(name, F.when(better, F.col(best)).otherwise(F.col(name))).drop(best)
    return out
