"""Benchmark decontamination: SimHash of item-sized windows, a multi-index over Hamming blocks, exact verification.

For each benchmark item, windows of as many words as the item has slide over the text. A window and an item are
multisets of five-word shingles; the fingerprint of either is a 128-bit SimHash of its shingles by multiplicity.
Fingerprints are cut into 16 blocks of 8 bits. Two within RADIUS differ by at most BLOCK_RADIUS bits in some block
(by the pigeonhole principle), so looking up every block of a window among the items' blocks within that distance
finds all items within RADIUS. Those are verified exactly: the sum of the smaller multiplicities over that of the
larger ones must be 0.75 or more.

Only windows that hold a shingle of an item of their size are fingerprinted: others share nothing with any item, so
none can be verified. At a similarity of 0.75 SimHash fingerprints are about 22 of 128 bits apart (standard deviation
4.3), and about 64 where nothing is shared; RADIUS = 40 lies four standard deviations from either.

The items are read by the driver in slices of about INDEX_WORDS words, each of which becomes an index; one is held at a
time. Where there is more than one slice, texts are first sifted by a bitmap of MARK_BITS bits with a mark for every
shingle of every item, so that all texts are read once and slices are only held against those that share a mark; these
rows are numbered and kept, and each slice's hits are written before the next is read.

Defined cases: texts and items that are null or have no word match nothing; very long texts are searched whole, an item
is held whole; items with a null item_id are left out, or with ``null_ids`` matched by text like others, each distinct
text an item, with a null in the hit; an item of fewer than five words is one shingle; a text shorter than an item is
one window; an item that occurs several times in a text counts once, at its most similar and then first place, and once
for each length that texts of one item_id have; repeated rows are treated alike; an empty table gives no rows; all
columns of the input are kept, and the new one has underscores put in front of its name while the input has one of that
name.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorum.llm import textops
from quorum.llm.common import cut, text_udf, unused, word_count

BITS, BLOCKS, RADIUS = 128, 16, 40
BLOCK_RADIUS = RADIUS // BLOCKS
NUMERATOR, DENOMINATOR = 3, 4
INDEX_WORDS, MARK_BITS = 200_000, 1 << 27
#: Windows that are fingerprinted together.
WINDOWS = 4_096
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)
_HIT = "struct<item_id:long,similarity:double,start:int,words:int>"
_HITS = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("start", pa.int32()), ("words", pa.int32())]))


def _grams(words: np.ndarray, size: int) -> np.ndarray:
    """The shingles of words for items of this many words, by place."""
    return textops.shingle_hashes(words) if size >= textops.SHINGLE else textops.short_hashes(words, size)


def fingerprints(grams: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the windows of ``size`` shingles from each start on, as BLOCKS bytes; starts ascend."""
    first, end = int(starts[0]), int(starts[-1]) + size
    part = grams[first:end]
    both = np.stack([textops.mix64(part, 0xA1), textops.mix64(part, 0xB2)], axis=1)
    signs = np.unpackbits(both.view(np.uint8).reshape(len(part), BLOCKS), axis=1).astype(np.int32) * 2 - 1
    sums = np.zeros((len(part) + 1, BITS), np.int32)
    np.cumsum(signs, axis=0, out=sums[1:])
    at = starts - first
    return np.packbits(sums[at + size] - sums[at] >= 0, axis=1)


class Index:
    """The items of a slice by their number of words, with their shingles and Hamming blocks."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.sizes: dict[int, dict] = {}
        anchors: dict[int, set[int]] = defaultdict(set)  # the sizes of the items that hold a shingle, however many do
        by_size = defaultdict(list)
        for k, (item_id, text) in enumerate(items):
            run, = (r for _, r in textops.chunks([text]))
            words, _ = textops.word_hashes(run)
            if len(words):
                by_size[len(words)].append(((item_id is None, k if item_id is None else item_id), words))
        for size, members in sorted(by_size.items()):
            grams = [_grams(w, size) for _, w in members]
            prints = np.concatenate([fingerprints(g, np.zeros(1, np.int64), len(g)) for g in grams])
            near = []  # for each block and value, the items within BLOCK_RADIUS, as offsets and one list
            for b in range(BLOCKS):
                close = _POPCOUNT[np.arange(256, dtype=np.uint8)[:, None] ^ prints[None, :, b]] <= BLOCK_RADIUS
                near.append((np.concatenate([[0], np.cumsum(close.sum(1))]), np.nonzero(close)[1]))
            self.sizes[size] = {"ids": [i for i, _ in members], "prints": prints, "near": near, "grams": [np.unique(g, return_counts=True) for g in grams], "n": len(grams[0])}
            for x in set(np.concatenate(grams).tolist()):
                anchors[x].add(size)
        self.keys = np.array(sorted(anchors), dtype=np.uint64)
        of = [sorted(anchors[x]) for x in self.keys.tolist()]
        self.of_from = np.concatenate([[0], np.cumsum([len(x) for x in of], dtype=np.int64)])
        self.of = np.array([size for x in of for size in x], dtype=np.int64)
        bits = max(16, int(len(self.keys)).bit_length() + 6)
        self.mask = np.uint64((1 << bits) - 1)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[self.keys & self.mask] = True
        self.short = sorted(s for s in self.sizes if s < textops.SHINGLE)

    def _anchored(self, grams: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, size of an item), once for each size of the items that have the shingle there.

        Shingles of items of five words or more go with their sizes, shorter ones with ``size`` alone.
        """
        at = np.flatnonzero(self.seen[grams & self.mask]) if len(self.keys) else np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(self.keys, grams[at]), len(self.keys) - 1)
        same = self.keys[k] == grams[at]
        at, k = at[same], k[same]
        count = self.of_from[k + 1] - self.of_from[k]
        nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        place, items_size = np.repeat(at, count), self.of[np.repeat(self.of_from[k], count) + nth]
        wanted = items_size >= textops.SHINGLE if size == textops.SHINGLE else items_size == size
        return place[wanted], items_size[wanted]

    def _windows(self, grams: np.ndarray, size: int, places: np.ndarray, best: dict) -> None:
        """Verifies the windows of a text that hold an anchor, at one of these places, of an item with this many words."""
        group = self.sizes[size]
        n = min(group["n"], len(grams))
        marked = np.zeros(len(grams) + 1, np.int32)
        np.add.at(marked, np.maximum(places - n + 1, 0), 1)
        np.add.at(marked, np.minimum(places + 1, len(grams)), -1)
        starts = np.flatnonzero(np.cumsum(marked[: len(grams) - n + 1]) > 0)
        for part in np.split(starts, np.flatnonzero((np.diff(starts) > WINDOWS)) + 1):
            for at in range(0, len(part), WINDOWS):
                some = part[at : at + WINDOWS]
                prints = fingerprints(grams, some, n)
                found = []
                for b, (offsets, items) in enumerate(group["near"]):
                    value = prints[:, b].astype(np.int64)
                    count = offsets[value + 1] - offsets[value]
                    window = np.repeat(np.arange(len(some)), count)
                    place = np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(offsets[value], count)
                    found.append(window * len(group["ids"]) + items[place])
                pairs = np.unique(np.concatenate(found))
                window, item = pairs // len(group["ids"]), pairs % len(group["ids"])
                close = _POPCOUNT[prints[window] ^ group["prints"][item]].sum(1) <= RADIUS
                for w, k in zip(some[window[close]].tolist(), item[close].tolist()):
                    keys, counts = group["grams"][k]
                    own, mine = np.unique(grams[w : w + n], return_counts=True)
                    _, i, j = np.intersect1d(own, keys, assume_unique=True, return_indices=True)
                    both = int(np.minimum(mine[i], counts[j]).sum())
                    union = n + int(counts.sum()) - both
                    if both * DENOMINATOR >= NUMERATOR * union and (k := (group["ids"][k], size)) and best.get(k, (0,))[0] < both / union:
                        best[k] = (both / union, w)

    def hits(self, texts: list[str | None]) -> Iterator[list[tuple]]:
        """For each text the (item_id, similarity, first word, words) of the items it holds."""
        for _, run in textops.chunks(texts):
            words, bounds = textops.word_hashes(run)
            out = [{} for _ in run]
            for size in [textops.SHINGLE, *self.short]:
                grams = _grams(words, size)
                place, items_size = self._anchored(grams, size)
                text = np.searchsorted(bounds, place, side="right") - 1
                whole = place + size <= bounds[text + 1]
                place, items_size, text = place[whole], items_size[whole], text[whole]
                order = np.lexsort((place, items_size, text))
                place, items_size, text = place[order], items_size[order], text[order]
                cuts = np.flatnonzero((np.diff(text) != 0) | (np.diff(items_size) != 0)) + 1
                for first, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(place)]):
                    if first < end:
                        t = int(text[first])
                        self._windows(grams[bounds[t] : bounds[t + 1] - size + 1], int(items_size[first]), place[first:end] - bounds[t], out[t])
            for best in out:
                yield [(None if unnamed else item, s, start, size) for ((unnamed, item), size), (s, start) in sorted(best.items())]


def _slice(items: DataFrame, k: int, slices: int) -> list[tuple[int | None, str]]:
    """The k-th slice of the items, repeated ones once."""
    own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k).dropDuplicates().orderBy("item_id", "text")
    return [(r["item_id"], r["text"]) for r in own.collect()]


def benchmark_hits(text: Column, shared) -> Column:
    """The hits of each text in a broadcast index."""

    def finder():
        return lambda texts: pa.array([[{"item_id": i, "similarity": s, "start": a, "words": n} for i, s, a, n in found] for found in shared.value.hits(texts)], _HITS)

    return text_udf(f"array<{_HIT}>", finder)(text)


class Marks:
    """A bitmap with a mark for each shingle of each item, by item size below that of a shingle."""

    def __init__(self):
        self.bits = np.zeros(MARK_BITS // 8, np.uint8)
        self.sizes = {textops.SHINGLE}

    @staticmethod
    def _places(words: np.ndarray, size: int) -> np.ndarray:
        return textops.mix64(_grams(words, size), 0x3A) % np.uint64(MARK_BITS)

    def add(self, text: str) -> None:
        for _, run in textops.chunks([text]):
            words, _ = textops.word_hashes(run)
            if len(words):
                size = min(len(words), textops.SHINGLE)
                self.sizes.add(size)
                at = self._places(words, size)
                np.bitwise_or.at(self.bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def shared(self, texts: list[str | None]) -> list[bool]:
        """Whether each text, or the run of words across it and its neighbours, has a marked shingle."""
        out = []
        for _, run in textops.chunks(texts):
            words, bounds = textops.word_hashes(run)
            hits = np.zeros(len(run), bool)
            for size in self.sizes:
                at = self._places(words, size)
                marked = np.flatnonzero(self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
                hits[np.searchsorted(bounds, marked, side="right") - 1] = True
            out += hits.tolist()
        return out


def _in_slices(docs: DataFrame, items: DataFrame, slices: int, name: str) -> DataFrame:
    """``with_hits`` for more items than one index holds."""
    context = docs.sparkSession.sparkContext
    row, part_no = unused(docs, "row"), unused(docs, "part")
    docs = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    marks = Marks()
    for k in range(slices):
        for _, text in _slice(items, k, slices):
            marks.add(text)
    shared = context.broadcast(marks)
    sieve = text_udf("boolean", lambda: lambda texts: pa.array(shared.value.shared(texts), pa.bool_()))
    sifted = cut(docs.select(row, "text").where(sieve("text")))
    shared.destroy()
    found = None
    for k in range(slices):
        index = context.broadcast(Index(_slice(items, k, slices)))
        part = cut(sifted.select(row, F.posexplode(benchmark_hits(F.col("text"), index)).alias("at", "hit")).withColumn(part_no, F.lit(k)))
        index.destroy()
        found = part if found is None else found.union(part)
    # an item_id whose texts fell into several slices counts once for each length; those without an id stay apart
    apart = F.when(F.col("hit.item_id").isNull(), F.struct(part_no, "at"))
    best = found.groupBy(row, "hit.item_id", "hit.words", apart.alias("apart")).agg(F.max(F.struct("hit.similarity", (-F.col("hit.start")).alias("start"))).alias("best"))
    hit = F.struct("item_id", "best.similarity", (-F.col("best.start")).alias("start"), "words")
    # by item as in one index: those with an id first, then those without
    order = F.struct(F.col("item_id").isNull().alias("unnamed"), "item_id", "words", hit.alias("hit"))
    hits = best.groupBy(row).agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["hit"]).alias(name))
    return docs.join(hits, row, "left").select(*docs.drop(row).columns, F.coalesce(name, F.array().cast(f"array<{_HIT}>")).alias(name))


def with_hits(docs: DataFrame, benchmark: DataFrame, name: str = "hits", null_ids: bool = False) -> DataFrame:
    """The same rows and columns, and the items that each text holds: (item_id, similarity, start, words), by item."""
    name = unused(docs, name)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull() & (F.col("item_id").isNotNull() | F.lit(null_ids)))
    total = items.agg(F.coalesce(F.sum(word_count(F.col("text"))), F.lit(0)).alias("n")).first()["n"]
    slices = max(1, -(-total // INDEX_WORDS))
    if slices > 1:
        return _in_slices(docs, items, slices, name)
    return docs.withColumn(name, benchmark_hits(F.col("text"), docs.sparkSession.sparkContext.broadcast(Index(_slice(items, 0, 1)))))
