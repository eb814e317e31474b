"""Byte-level BPE: exact encoding in linear time by backtracking over Aho-Corasick matches, and decoding.

A vocabulary, as training makes it, gives each byte sequence a rank; merging joins, again and again, the adjacent parts whose joint sequence has
the least rank, the leftmost first. Merging isn't carried out here. Bytes become Latin-1 characters, in which an
Aho-Corasick automaton finds the longest token from each place. From the left, the longest token is taken that may follow the
one before it and whose end isn't known to be a dead end; else the next shorter token that begins alike; else the place is
marked as a dead end and the token before it is shortened. No place is marked twice, so the work is linear in the length.

Two tokens may follow each other if undoing their merges, the latest first, never shows two parts at their border that
would have been joined earlier. Compatibility depends on the two tokens only and is memoised, at most MEMO_PAIRS of them.
Pieces of a text (matches of the pattern) repeat: at most MEMO_PIECES of no more than MEMO_CHARS characters are remembered.

Encoded texts are packed: 32-bit unsigned little-endian ids one after the other in a binary column, the form in which
training shards hold tokens. ``unpacked`` gives them as an array.

Defined cases: a null or empty text has no ids and decodes to no bytes; very long texts are encoded whole, a piece of any
length in linear time; strings that look like special tokens are ordinary text; repeated rows are encoded alike; an empty
table gives no rows; a vocabulary without a token for each byte is an error, as is an id without a token in decoding;
null ids decode to no bytes; all columns of the input are kept, and a new one has underscores put in front of its name while
the input has one of that name.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Callable, Iterator
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from quorum.llm.common import text_udf, unused

MEMO_PIECES, MEMO_CHARS, MEMO_PAIRS = 400_000, 48, 300_000
#: Letters and numbers that Unicode has had since version 17 only, which the tokenizer's own library doesn't
#: know yet; in its patterns they are neither.
LATER = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1"
    "\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda"
    "\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24"
    "\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed"
    "\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
_LATER = regex.compile(f"[{LATER}]")
#: A character that stands for them while a text is split: never assigned.
_UNKNOWN = "\uffff"


def read_ranks(path: str) -> dict[bytes, int]:
    """The token ranks of a vocabulary file: lines of a token in Base64 and its rank. A vocabulary has a bounded size."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Coder:
    """Encodes and decodes by one vocabulary. Tables are made once; the automaton is made where it is first used."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary has no token for the bytes {missing}")
        self.ranks, self.pattern = ranks, pattern
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.halves = {rank: halves for token, rank in ranks.items() if (halves := self._halves(token))}
        self.joined = {halves: rank for rank, halves in self.halves.items() if halves[0] != rank}
        self.shorter = {rank: next(self._beginnings(self.tokens[rank]), -1) for rank in self.halves}
        self._ready = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_ready": None}

    def _beginnings(self, token: bytes) -> Iterator[int]:
        """The ranks of the mergeable tokens that a token begins with, the longest first."""
        for end in range(len(token) - 1, 0, -1):
            rank = self.ranks.get(token[:end])
            if rank in self.halves:
                yield rank

    def _halves(self, token: bytes) -> tuple[int, int] | None:
        """The two parts that are merged last into a token, a single byte being its own; None if merging doesn't lead to it."""
        ranks = self.ranks
        if len(token) == 1:
            return ranks[token], ranks[token]
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 2:
            rank, at = min((ranks.get(a + b, len(ranks) << 1), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank >= len(ranks) << 1:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return ranks[parts[0]], ranks[parts[1]]

    def follows(self, left: int, right: int) -> bool:
        """Whether merging leaves the border between two adjacent tokens alone."""
        joined, halves = self.joined, self.halves
        until = 1 << 62  # a join at the border counts if its rank is below: later ones come after the parts are merged
        while True:
            if joined.get((left, right), until) < until:
                return False
            inner_left, inner_right = halves[left][1], halves[right][0]
            if inner_left != left and (left > right or inner_right == right):
                until, left = left, inner_left
            elif inner_right != right:
                until, right = right + 1, inner_right  # of equal ranks the left one is merged first
            else:
                return True

    def _prepare(self) -> tuple:
        automaton = ahocorasick.Automaton()
        for rank in self.halves:
            automaton.add_word(self.tokens[rank].decode("latin-1"), rank)
        automaton.make_automaton()
        lengths = {rank: len(token) for rank, token in self.tokens.items()}
        self._ready = automaton, lengths, regex.compile(self.pattern), {}, {}
        return self._ready

    def piece(self, piece: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        automaton, lengths, _, _, pairs = self._ready or self._prepare()
        n, shorter = len(piece), self.shorter
        longest = [0] * n
        for end, rank in automaton.iter(piece.decode("latin-1")):  # by end, so the longest from a place comes last
            longest[end + 1 - lengths[rank]] = rank
        open_ = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + lengths[token]
                if open_[end]:
                    if last < 0:
                        break
                    fits = pairs.get((last, token))
                    if fits is None:
                        if len(pairs) >= MEMO_PAIRS:
                            pairs.clear()
                        fits = pairs[last, token] = self.follows(last, token)
                    if fits:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            else:
                open_[at] = 0
                token = out.pop()
                at -= lengths[token]
        return out

    def _remember(self, piece: str, memo: dict[str, bytes]) -> bytes:
        ids = self.piece(piece.encode("utf-8", "surrogatepass"))
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= MEMO_CHARS:
            if len(memo) >= MEMO_PIECES:
                memo.clear()
            memo[piece] = packed
        return packed

    def split(self, text: str) -> list[str]:
        """The matches of the pattern."""
        pattern = (self._ready or self._prepare())[2]
        if text.isascii() or not _LATER.search(text):
            return pattern.findall(text)
        return [text[m.start() : m.end()] for m in pattern.finditer(_LATER.sub(_UNKNOWN, text))]

    def encode(self, text: str | None) -> bytes:
        """The packed ids of a text."""
        memo = (self._ready or self._prepare())[3]
        known, remember = memo.get, self._remember
        return b"".join([known(piece) or remember(piece, memo) for piece in self.split(text or "")])

    def decode(self, packed: bytes | None) -> bytes:
        """The bytes of packed ids."""
        return _decoded(self.tokens, packed)


def _decoded(tokens: dict[int, bytes], packed: bytes | None) -> bytes:
    try:
        return b"".join([tokens[i] for i in np.frombuffer(packed or b"", "<u4").tolist()])
    except KeyError as unknown:
        raise ValueError(f"the vocabulary has no token with the id {unknown}") from None


def _with(rows: DataFrame, of: str, name: str, table: object, run: Callable[[object], Callable[[object], bytes]]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(table)  # bounded by the vocabulary

    def make():
        one = run(shared.value)
        return lambda values: pa.array([one(value) for value in values], pa.binary())

    return rows.withColumn(unused(rows, name), text_udf("binary", make)(of))


def with_ids(docs: DataFrame, coder: Coder, name: str = "ids") -> DataFrame:
    """The same rows and columns and the packed ids of each text."""
    return _with(docs, "text", name, coder, lambda own: own.encode)


def with_bytes(rows: DataFrame, coder: Coder, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """The same rows and columns and the bytes that packed ids stand for."""
    return _with(rows, ids, name, coder.tokens, lambda tokens: partial(_decoded, tokens))


def n_ids(packed: Column) -> Column:
    """How many ids are packed."""
    return (F.octet_length(packed) / 4).cast("long")


@F.arrow_udf(ArrayType(LongType()))
def unpacked(packed: pa.Array) -> pa.Array:
    """Packed ids as an array; null stays null."""
    return pa.array([None if x is None else np.frombuffer(x, "<u4").astype(np.int64) for x in packed.to_pylist()], pa.list_(pa.int64()))
