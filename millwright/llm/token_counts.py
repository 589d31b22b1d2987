"""Token counts of a unigram tokenizer, without the tokens.

An Aho-Corasick automaton enumerates the vocabulary's matches in a word; a Viterbi pass keeps, for each place, the best score
and the number of pieces on the path to it.  Ties and unknown characters follow the tokenizers library's Unigram model: a later
start replaces an earlier one only with a greater score, a character without a piece of its own may be unknown at the least
score less ten, and unknown characters are counted as their bytes.  Texts are split before each space, as its Metaspace does,
and each distinct word is counted once per worker.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwright.llm.common import extended

#: The mark that stands for a space, and words whose counts a worker keeps.
SPACE, CACHE_WORDS = "▁", 300_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) by id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class WordCounts(dict):
    """Pieces of a word (the mark before it left out), counted when first asked for."""

    def __init__(self, vocabulary: list[tuple[str, float]], unknown_id: int = 0):
        import ahocorasick

        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in vocabulary) - 10.0
        self.pieces = {piece for piece, _ in vocabulary}
        self.unknown_piece = vocabulary[unknown_id][0]
        self.bytes = all(f"<0x{b:02X}>" in self.pieces for b in range(256))

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = found = self.count(SPACE + word)
        return found

    def count(self, word: str) -> int:
        n = len(word)
        score, pieces = [None] * (n + 1), [0] * (n + 1)
        unknown = [-1] * (n + 1)  # where a run of unknown characters that ends here began
        score[0] = 0.0
        done = 0  # every place up to here is settled

        def run(start: int, end: int) -> None:
            """The path's last step is unknown: it joins the run before it, which is one piece, its bytes, or one unknown."""
            begin = unknown[end] = start if unknown[start] < 0 else unknown[start]
            text = word[begin:end]
            pieces[end] = pieces[begin] + (len(text.encode("utf-8", "replace")) if self.bytes and text not in self.pieces else 1)

        def settle(upto: int) -> None:
            """Places without a piece for their last character: it may be unknown."""
            nonlocal done
            while done < upto:
                done += 1
                if not single[done]:
                    guess = score[done - 1] + self.unknown
                    if score[done] is None or guess > score[done]:
                        score[done] = guess
                        run(done - 1, done)

        single = [False] * (n + 1)
        for last, (size, value) in self.automaton.iter(word):
            end = last + 1
            settle(end - 1)
            guess = score[end - size] + value
            if size == 1:
                single[end] = True
            if score[end] is None or guess > score[end]:
                score[end] = guess
                if size == len(self.unknown_piece) and word[end - size : end] == self.unknown_piece:
                    run(end - size, end)
                else:
                    pieces[end], unknown[end] = pieces[end - size] + 1, -1
        settle(n)
        return pieces[n]


@lru_cache(2)
def word_counts(path: str) -> WordCounts:
    return WordCounts(read_vocabulary(path))


def count_text(text: str, counts: WordCounts) -> int:
    if not text:
        return 0
    parts = text.replace(" ", SPACE).split(SPACE)
    return sum(map(counts.__getitem__, parts if parts[0] else parts[1:]))


def token_counts(docs: DataFrame, *, text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``docs`` with n_tokens long: the pieces of each whole text.

    Null and empty texts have none; repeated rows count alike; very long texts are counted whole; an empty table gives an empty
    one; a column so named is replaced, all others are kept.
    """
    path = vocabulary or default_vocabulary()

    def work(batch):
        counts = word_counts(path)
        return [pa.array([count_text(t or "", counts) for t in batch.column("t").to_pylist()], pa.int64())]

    return extended(docs, {"t": F.col(text_col).cast("string")}, T.StructType().add("n_tokens", "long"), work)
