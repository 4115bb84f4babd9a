"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary pieces that end at each
character; dynamic programming carries the best score and its number of
pieces, and no path is kept.  Ties follow the tokenizer: of paths with an
equal score the one whose last piece starts first wins.  A character without
a one-character piece costs the lowest score less ten, and counts as its
UTF-8 bytes (byte fallback) or as one per run (no byte pieces).

No piece has a space mark after another character, so texts are cut before
each run of spaces and each distinct chunk of a batch is solved once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ibex.llm import chunks, textbytes as tb
from ibex.llm.frames import text_of

SPACE_MARK = "▁"  # fixed value: how the vocabulary writes a space
UNKNOWN_PENALTY = 10.0  # fixed value of the tokenizer
#: A vocabulary is shipped to every worker; larger ones are refused.
MAX_PIECES = 2_000_000

_MODELS: dict[tuple, "CountModel"] = {}


def _model(vocabulary: list[tuple[str, float]], byte_fallback: bool) -> "CountModel":
    """One model per vocabulary and worker, kept between tasks."""
    key = (hash(tuple(vocabulary)), byte_fallback)
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = CountModel(vocabulary, byte_fallback)
    return _MODELS[key]


def read_vocabulary(path: str) -> tuple[list[tuple[str, float]], bool]:
    """(piece, score) of the ordinary pieces of a public vocabulary file, and
    whether it has byte pieces."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    every = range(model.vocab_size())
    plain = [(model.id_to_piece(i), model.get_score(i)) for i in every
             if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return plain, any(model.is_byte(i) for i in every)


class CountModel:
    def __init__(self, vocabulary: Sequence[tuple[str, float]], byte_fallback: bool):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), float(score)))
        if vocabulary:
            self.automaton.make_automaton()
        self.empty = not vocabulary
        self.unknown = min((float(s) for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.byte_fallback = byte_fallback
        self.memory = chunks.Memory()

    def solve(self, text: str) -> tuple[int, float]:
        """(pieces, score) of the best path over ``text``."""
        n = len(text)
        score, pieces = [0.0] * (n + 1), [0] * (n + 1)
        unknown_end = [False] * (n + 1)  # the best path ends in an unknown character
        found = iter(()) if self.empty else self.automaton.iter(text)
        last, piece = next(found, (n, None))
        for end in range(1, n + 1):
            best, start, single = None, 0, False
            while last == end - 1:  # pieces that end here, the longest first
                length, value = piece
                total = score[end - length] + value
                if best is None or total > best:
                    best, start = total, end - length
                single |= length == 1
                last, piece = next(found, (n, None))
            rest = score[end - 1] + self.unknown
            if not single and (best is None or rest > best):
                score[end], unknown_end[end] = rest, True
                if self.byte_fallback:
                    pieces[end] = pieces[end - 1] + len(text[end - 1].encode("utf-8", "surrogatepass"))
                else:
                    pieces[end] = pieces[end - 1] + (not unknown_end[end - 1])
            else:
                score[end], pieces[end] = best, pieces[start] + 1
        return pieces[n], score[n]

    def counts(self, distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = self.memory.of(distinct, lambda new: [self.solve(chunk.replace(" ", SPACE_MARK)) for chunk in new])
        return np.array([n for n, _ in got], dtype=np.int64), np.array([score for _, score in got], dtype=np.float64)


def token_counts(docs: DataFrame, vocabulary: Sequence[tuple[str, float]], byte_fallback: bool = True,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id``, ``n_tokens`` and ``score`` of the whole
    text's best segmentation.

    A text is preceded by one space, as the tokenizer does; a null or empty
    text has no tokens and a score of zero.  Rows with equal or null ids are
    counted one by one.  Other columns are ignored, whatever their names.  An
    empty table gives an empty result.
    """
    if len(vocabulary) > MAX_PIECES:
        raise ValueError(f"a vocabulary has at most {MAX_PIECES} pieces")
    if any(SPACE_MARK in piece.lstrip(SPACE_MARK) for piece, _ in vocabulary):
        raise ValueError("a piece with a space mark after another character: texts can't be cut at spaces")
    shipped = docs.sparkSession.sparkContext.broadcast((list(vocabulary), byte_fallback))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(*shipped.value)
        for batch in batches:
            text = batch.column("text")
            spaced = pc.if_else(pc.equal(text, ""), "", pc.binary_join_element_wise(" ", text, ""))
            offsets, data = tb.buffers(spaced)
            distinct, place, first = chunks.distinct_chunks(offsets, data, chunks.at_space_runs(data))
            n, score = model.counts(distinct.to_pylist())
            n, score = np.append(0, np.cumsum(n[place])), np.append(0.0, np.cumsum(score[place]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n[first[1:]] - n[first[:-1]]), pa.array(score[first[1:]] - score[first[:-1]])],
                names=["id", "n_tokens", "score"])

    frame = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    return frame.mapInArrow(count, "id long, n_tokens long, score double")
