"""Hard negatives, ball k-means, byte-level BPE, and the kd-trees' visits, against brute force and on odd tables."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from quorum.llm import ann, byte_bpe, hard_negatives, kmeans, queries, vectors

EMBEDDINGS = "vec_id long, embedding array<float>, label int"
CLASHING = ["cluster", "distance", "components", "vector", "cell", "asked", "block", "part", "anchor", "positives"]


def embeddings(spark, rows):
    return spark.createDataFrame(rows, EMBEDDINGS).withColumns({c: F.lit("clash") for c in CLASHING})


def odd_embeddings(spark):
    """Nulls in every column, odd components and lengths, repeated ids and rows, ties."""
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(0, 0.2, 64).tolist(), k % 3) for k in range(160)]
    rows += [(None, rows[3][1], 1), (500, None, 1), (501, rows[4][1], None), (502, [], 1), (503, [0.0] * 64, 1), (504, [None, *rows[5][1][1:]], 1)]
    rows += [(505, [float("nan"), *rows[5][1][1:]], 1), (506, [float("inf"), *rows[5][1][1:]], 1), (507, [0.1, 0.2], 1), (550, [0.1, 0.3], 1), (551, [0.05, 0.1], 2), (600, [], 2)]
    rows += [(700 + k, rows[7][1], 2) for k in range(12)] + [rows[0], rows[0], (50, rows[9][1], 2)]
    return rows


# --- hard negatives


def brute_negatives(rows, positives=5, negatives=3):
    fine = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v)
    first = {}
    for i, v, label in rows:
        if i is not None and label is not None and fine(v):
            q = [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]
            first[i] = min(first.get(i, (q, label)), (q, label))
    out = set()
    for a, (va, la) in first.items():
        if a % 50:
            continue
        scored = [(sum(x * y for x, y in zip(va, v)), i, label) for i, (v, label) in first.items() if i != a and len(v) == len(va)]
        scored.sort(key=lambda s: (-s[0], s[1]))
        for s, p, _ in [x for x in scored if x[2] == la][:positives]:
            fit = [(n, i) for n, i, label in scored if label != la and 50 * s <= 100 * n <= 95 * s]
            out |= {(a, p, k + 1, i, s, n) for k, (n, i) in enumerate(fit[:negatives])}
    return out


@pytest.mark.parametrize("block_rows, part_rows", [(8_192, 8_192), (20, 2)])
def test_hard_negatives_are_those_of_brute_force(spark, monkeypatch, block_rows, part_rows):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(vectors, "PART_ROWS", part_rows)
    rows = odd_embeddings(spark)
    found = hard_negatives.mine_negatives(embeddings(spark, rows), F.col("vec_id") % 50 == 0, F.col("label")).collect()
    want = brute_negatives(rows)
    assert len(found) == len(want) and {tuple(r) for r in found} == want and len(want) > 20
    assert hard_negatives.mine_negatives(embeddings(spark, rows).where("false"), F.col("vec_id") % 50 == 0, F.col("label")).count() == 0
    alone = embeddings(spark, [(50, [1.0] * 64, 1)])
    assert hard_negatives.mine_negatives(alone, F.col("vec_id") % 50 == 0, F.col("label")).count() == 0


def test_planes_hold_the_vectors():
    rng = np.random.default_rng(1)
    for width in (1, 64, 70, 130):
        x = rng.integers(-300, 200, (9, width))
        words, weights = hard_negatives.planes(x)
        bits = np.unpackbits(words.view(np.uint8), axis=2, bitorder="little")[:, :, :width]
        assert np.array_equal((bits * weights[:, None, None]).sum(axis=0), x) and words.shape[2] == -(-width // 64)
    assert hard_negatives.planes(np.zeros((2, 3), np.int64))[0].shape == (1, 2, 1)


def test_candidates_drop_out_before_the_last_plane():
    rng = np.random.default_rng(2)
    x = np.floor(256 * rng.normal(0, 0.125, (8_000, 64))).astype(np.int64)
    block = hard_negatives.Block(np.arange(8_000), np.arange(8_000) % 10, x)
    ids, scores = block.best(0, 0, x[0], 5)
    exact = x @ x[0]
    own = [i for i in np.lexsort((np.arange(8_000), -exact)).tolist() if i % 10 == 0 and i != 0][:5]
    assert ids.tolist() == own and scores.tolist() == exact[own].tolist()
    assert block.scored < 0.8 * 800 * len(block.weights)


def test_components_out_of_range_are_an_error(spark):
    rows = spark.createDataFrame([(50, [1e30, 1.0], 1)], EMBEDDINGS)
    with pytest.raises(Exception, match="too large"):
        hard_negatives.mine_negatives(rows, F.lit(True), F.col("label")).collect()


# --- ball k-means


def brute_kmeans(rows, rounds=10, k=8):
    kept = [(i, [int(np.floor(1024 * np.float64(np.float32(x)))) for x in v]) for i, v, _ in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda i: (i is None, "" if i is None else hashlib.sha256(f"3:{i}".encode()).hexdigest())
    centroids = [v for _, v in sorted(kept, key=lambda r: (key(r[0]), r[1]))[:k]]
    near = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(x) // len(members[n]) for x in zip(*members[n])] if n in members else c for n, c in enumerate(centroids)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in kept), key=repr), centroids


@pytest.mark.parametrize("rows", [odd_embeddings, lambda spark: odd_embeddings(spark)[:5], lambda spark: [(k, [0.5] * 64, 1) for k in range(12)]])
def test_clusters_are_those_of_plain_kmeans(spark, rows):
    rows = rows(spark)
    found, centroids = kmeans.ball_kmeans(embeddings(spark, rows))
    assert found.columns == ["vec_id", "embedding", "label", *CLASHING, "_cluster", "_distance"]
    want, final = brute_kmeans(rows)
    assert sorted(((r["vec_id"], r["_cluster"], r["_distance"]) for r in found.collect()), key=repr) == want
    assert centroids.tolist() == final


def test_clusters_of_an_empty_table(spark):
    found, centroids = kmeans.ball_kmeans(embeddings(spark, [(1, None, 1)]))
    assert found.count() == 0 and len(centroids) == 0
    assert kmeans.with_inertia(found, centroids, "_cluster", "_distance").count() == 0


def test_balls_compare_few_and_find_all():
    rng = np.random.default_rng(3)
    centres = rng.integers(-1_000, 1_000, (12, 16))
    x = centres[rng.integers(0, 12, 6_000)] + rng.integers(-60, 60, (6_000, 16))
    balls = kmeans.Balls(centres)
    far = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
    home, _, _ = balls.assign(x, np.zeros(len(x), np.int64))
    cluster, distance, compared = balls.assign(x, home)
    assert np.array_equal(home, far.argmin(axis=1)) and np.array_equal(cluster, home) and np.array_equal(distance, far.min(axis=1))
    assert compared < 0.1 * 11 * len(x)
    tied = kmeans.Balls(np.array([[4, 0], [0, 0], [4, 0]]))
    assert tied.assign(np.array([[2, 0], [4, 0]]), np.array([2, 2]))[0].tolist() == [0, 0]


# --- byte-level BPE


@pytest.fixture(scope="module")
def coder():
    return byte_bpe.Coder(byte_bpe.read_ranks(public_tokenizers.path(queries.RANKS)), public_tokenizers.PATTERN)


def own(coder):
    return tiktoken.Encoding("own", pat_str=coder.pattern, mergeable_ranks=coder.ranks, special_tokens={})


def test_ids_are_those_of_merging(coder):
    other, rng = own(coder), random.Random(5)
    ids = lambda text: np.frombuffer(coder.encode(text), "<u4").tolist()
    for _ in range(3_000):
        text = "".join(rng.choice("aaabcdeinst  ..,\n\t\r'0189éñ漢字😀-_=/\x00\x1f \u0085") for _ in range(rng.randrange(0, 60)))
        assert ids(text) == other.encode_ordinary(text)
        assert coder.decode(coder.encode(text)) == text.encode()
    for _ in range(3_000):
        piece = bytes(rng.choice(b"aeinst") if rng.random() < 0.9 else rng.randrange(256) for _ in range(rng.randrange(1, 50)))
        assert coder.piece(piece) == other._core_bpe.encode_single_piece(piece)
    later = "a՘b ࢏1 \U0003d000\U00012550 x"  # letters and numbers of Unicode 17
    assert ids(later) == other.encode_ordinary(later)
    for special in ("<|endoftext|>", "ab" * 9_000, " " * 9_000 + "x", "\n \n" * 3_000, "漢" * 3_000):
        assert ids(special) == other.encode_ordinary(special)


def test_ids_of_other_vocabularies():
    """Vocabularies as training makes them: each token joins two that merging leaves next to each other."""
    rng = random.Random(6)
    for _ in range(20):
        ranks = {bytes([b]): b for b in range(256)}
        while len(ranks) < 300:
            text = bytes(rng.choice(b"abc") for _ in range(12))
            parts = tiktoken.Encoding("grown", pat_str=r"\S+", mergeable_ranks=ranks | {b"\0\0": 10_000}, special_tokens={})._core_bpe.encode_single_piece(text)
            tokens = {rank: token for token, rank in ranks.items()}
            at = rng.randrange(len(parts) - 1) if len(parts) > 1 else None
            if at is not None:
                ranks.setdefault(tokens[parts[at]] + tokens[parts[at + 1]], len(ranks))
        coder = byte_bpe.Coder(ranks, r"\S+|\s+")
        other = own(coder)
        for _ in range(200):
            text = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 40)))
            assert np.frombuffer(coder.encode(text), "<u4").tolist() == other.encode_ordinary(text)


def test_long_pieces_take_linear_time(coder):
    import time

    def took(n):
        began = time.perf_counter()
        coder.encode("ab" * n)
        return time.perf_counter() - began

    took(1_000)
    assert took(400_000) < 40 * took(40_000) + 1


def test_odd_texts_in_bytes(spark, coder):
    texts = [None, "", " ", "word", "word", "é" * 5_000, "x " * 20_000, "<|endoftext|>", "漢字😀 ﬁ", "y" * 10_000_000]
    docs = spark.createDataFrame([(k if k else None, t, "clash", "clash") for k, t in enumerate(texts)], "doc_id long, text string, ids string, decoded string")
    rows = byte_bpe.with_ids(docs, coder)
    assert rows.columns == [*docs.columns, "_ids"]
    rows = byte_bpe.with_bytes(rows, coder, ids="_ids")
    found = {r["doc_id"]: r for r in rows.select("doc_id", "text", "_decoded", byte_bpe.n_ids(F.col("_ids")).alias("n"), F.size(byte_bpe.unpacked("_ids")).alias("size")).collect()}
    assert len(found) == len(texts) and all(bytes(r["_decoded"]) == (r["text"] or "").encode() and r["n"] == r["size"] for r in found.values())
    assert found[None]["n"] == 0 == found[1]["n"] and found[3]["n"] == found[4]["n"] == len(own(coder).encode_ordinary("word"))
    assert byte_bpe.with_bytes(byte_bpe.with_ids(docs.where("false"), coder), coder, ids="_ids").count() == 0


def test_unknown_ids_and_bytes_are_errors(coder):
    with pytest.raises(ValueError, match="id 60000"):
        coder.decode(np.array([5, 60_000], "<u4").tobytes())
    assert coder.decode(None) == b""
    with pytest.raises(ValueError, match="bytes"):
        byte_bpe.Coder({b"a": 0}, r"\S+")


def test_byte_bpe_query_has_the_ids_of_the_common_library(spark, sf, coder):
    other = own(coder)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.QUERIES["op13_byte_bpe"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = other.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


# --- kd-trees


def test_rows_of_far_leaves_are_never_touched():
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 1, (200, 64))
    x = centres[rng.integers(0, 200, 8_192)] + rng.normal(0, 0.1, (8_192, 64))
    tree, stop = ann.Tree(np.arange(8_192), x), ann.chi_square_quantile(1 - ann.MISS, ann.M)
    hits = 0
    for q in range(0, 8_192, 128):
        _, ids = tree.nearest(q, x[q], stop)
        far = ((x - x[q]) ** 2).sum(axis=1)
        far[q] = np.inf
        hits += len(set(ids.tolist()) & set(np.argsort(far)[: ann.K].tolist()))
    assert hits >= 0.95 * 64 * ann.K
    assert tree.visited < 0.3 * 64 * 8_192
