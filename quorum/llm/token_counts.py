"""Token counts by count-only Viterbi over a unigram vocabulary.

The pieces and scores of a SentencePiece vocabulary file are read as a unigram model. Spaces become the word mark and
each mark begins a word (one is put in front of a text that begins without); in a word, an Aho-Corasick automaton
enumerates the pieces at every place, and dynamic programming carries the best score and the number of pieces of it.
Ties are those of the common unigram tokenizers: of equally good paths into a place, the one whose last piece begins
first. A character without a piece of its own may be an unknown, 10 below the least score, counted as its UTF-8 bytes.
Control, unknown and byte pieces are never matched in a text.

Words repeat, so a worker remembers the counts of at most MEMO_WORDS of them, none longer than MEMO_CHARS. Defined cases:
a null or empty text has no token; very long texts are counted whole; repeated rows are counted alike; an empty table
gives no rows; all columns of the input are kept, and the new one has underscores put in front of its name while the
input has one of that name.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from quorum.llm.common import text_udf, unused

MARK = "▁"
UNKNOWN_PENALTY = 10.0
MEMO_WORDS, MEMO_CHARS = 400_000, 64


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of the ordinary pieces of a SentencePiece file."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not special(i)]


class Counter:
    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.pieces = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.pieces.add_word(piece, (len(piece), score))
        self.pieces.make_automaton()
        self.single = frozenset(piece for piece, _ in vocabulary if len(piece) == 1)
        self.unknown = min((score for _, score in vocabulary), default=0.0) - UNKNOWN_PENALTY
        used = {c for piece, _ in vocabulary for c in piece}
        self.alone = [c for c in "\n\t\r" if c not in used]  # no piece reaches over these, so words may be cut there
        self._memo: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Pieces on the best path through a word."""
        best, pieces, last, done = [0.0], [0], [0], 0
        best += [float("-inf")] * len(word)
        pieces += [0] * len(word)
        last += [0] * len(word)
        single, unknown = self.single, self.unknown

        def settle(upto: int) -> None:
            nonlocal done
            while done < upto:
                c = word[done]
                done += 1
                if c not in single and best[done - 1] + unknown > best[done]:
                    best[done] = best[done - 1] + unknown
                    pieces[done] = pieces[done - 1] + len(c.encode("utf-8", "surrogatepass"))

        for end, (length, score) in self.pieces.iter(word):
            if done < end:
                settle(end)
            total = best[end + 1 - length] + score
            if total > best[end + 1] or total == best[end + 1] and length > last[end + 1]:
                best[end + 1], pieces[end + 1], last[end + 1] = total, pieces[end + 1 - length] + 1, length
        settle(len(word))
        return pieces[len(word)]

    def _remember(self, word: str) -> int:
        if len(self._memo) >= MEMO_WORDS:
            self._memo.clear()
        parts, n = [word], 0
        for c in self.alone:
            if c in word:
                parts = [x for part in parts for x in part.split(c)]
        n = len("".join(parts))
        count = len(word) - n + (self.word(word) if len(parts) == 1 else sum(self._counted(part) for part in parts if part))
        if len(word) <= MEMO_CHARS:
            self._memo[word] = count
        return count

    def _counted(self, word: str) -> int:
        count = self._memo.get(word)
        return self._remember(word) if count is None else count

    def count(self, text: str | None) -> int:
        """Tokens of a text."""
        if not text:
            return 0
        words = text.replace(MARK, " ").split(" ")
        if not words[0]:
            del words[0]
        total, memo = 0, self._memo
        for word in words:
            word = MARK + word
            found = memo.get(word)
            total += self._remember(word) if found is None else found
        return total


def with_token_counts(docs: DataFrame, vocabulary: list[tuple[str, float]], name: str = "n_tokens") -> DataFrame:
    """The same rows and columns and the number of tokens of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def counter():
        count = Counter(shared.value).count
        return lambda texts: pa.array([count(text) for text in texts], pa.int64())

    return docs.withColumn(unused(docs, name), text_udf("long", counter)("text"))
