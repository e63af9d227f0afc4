"""Token counts under a unigram vocabulary: Viterbi that keeps only a score and a count.

An Aho-Corasick automaton lists the vocabulary matches of a text unit by their ends. Dynamic
programming over the ends carries the best score and the number of pieces of the path
that has it; no path is kept. Sums run from left to right in double precision and a later
candidate replaces an earlier one only if it is strictly better, candidates in the order of
their starts: the tie rules of the ``tokenizers`` library's Unigram model.

Text is prepared as that library's Metaspace step does: a space becomes ``MARK``, one is
put in front, and every mark begins a unit that is segmented alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MARK = "▁"
#: What an unknown character costs below the lowest score.
UNKNOWN_PENALTY = 10.0
#: Shift of the rank in the Zipf-Mandelbrot law.
RANK_SHIFT = 2.7
MEMO_UNITS = 400_000
MEMO_CHARS = 64


def sentencepiece_vocabulary(path: str, scores: str = "zipf") -> dict[str, float]:
    """Pieces and log-probabilities of a SentencePiece file; no control or byte pieces.

    ``file`` takes the stored scores. A merge vocabulary stores its ranks, which are no
    probabilities; ``zipf`` derives them from the order of the stored scores:
    ``p ~ 1 / (rank + RANK_SHIFT)``, normalised.
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = {
        model.id_to_piece(i): model.get_score(i)
        for i in range(model.vocab_size())
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
    }
    if scores == "file":
        return pieces
    ranked = sorted(pieces, key=lambda p: (-pieces[p], p))
    whole = math.log(sum(1 / (rank + RANK_SHIFT) for rank in range(len(ranked))))
    return {piece: -math.log(rank + RANK_SHIFT) - whole for rank, piece in enumerate(ranked)}


class UnigramCounter:
    """Counts pieces of texts. With ``byte_fallback`` an unknown character is one piece per
    UTF-8 byte, otherwise a run of unknown characters is one piece."""

    def __init__(self, vocabulary: Mapping[str, float], byte_fallback: bool = True):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(vocabulary.values(), default=0.0) - UNKNOWN_PENALTY
        self.byte_fallback = byte_fallback
        #: Characters that no piece contains separate what pieces can span.
        self.signs = {sign for piece in vocabulary for sign in piece}
        self.memo: dict[str, int] = {}

    def count_unit(self, unit: str) -> int:
        """Pieces of the best segmentation of one unit."""
        size = len(unit)
        best, pieces = [0.0] * (size + 1), [0] * (size + 1)
        unknown_end = [False] * (size + 1)
        matches = self.automaton.iter(unit)
        found = next(matches, None)
        for end in range(1, size + 1):
            score, count, from_unknown, single, reached = 0.0, 0, False, False, False
            while found is not None and found[0] == end - 1:
                # Longest match first, which is the earliest start first.
                length, own = found[1]
                candidate = own + best[end - length]
                if not reached or candidate > score:
                    score, count, reached = candidate, pieces[end - length] + 1, True
                single = single or length == 1
                found = next(matches, None)
            if not single:
                candidate = self.unknown + best[end - 1]
                if not reached or candidate > score:
                    score, from_unknown = candidate, True
                    if self.byte_fallback:
                        count = pieces[end - 1] + len(unit[end - 1].encode())
                    else:
                        count = pieces[end - 1] + (not unknown_end[end - 1])
            best[end], pieces[end], unknown_end[end] = score, count, from_unknown
        return pieces[size]

    def count(self, text: str) -> int:
        if not text:
            return 0
        marked = text.replace(" ", MARK)
        units = marked.split(MARK)
        if not units[0] and len(units) > 1:
            units = units[1:]  # the text begins with a mark of its own
        memo, total = self.memo, 0
        for unit in units:
            known = memo.get(unit)
            if known is None:
                known = self.count_unit(MARK + unit)
                if len(unit) <= MEMO_CHARS:
                    if len(memo) >= MEMO_UNITS:
                        memo.clear()
                    memo[unit] = known
            total += known
        return total


@lru_cache(maxsize=2)
def counter(path: str, scores: str, byte_fallback: bool) -> UnigramCounter:
    """Built once for each Python worker."""
    return UnigramCounter(sentencepiece_vocabulary(path, scores), byte_fallback)


def token_counts(docs: DataFrame, model: str, scores: str = "zipf", byte_fallback: bool = True) -> DataFrame:
    """(doc_id, n_chars, n_tokens) of each row's whole text; NULL counts as empty, 0 tokens.

    Repeated rows give a row each, other columns are ignored, no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model, scores, byte_fallback).count
        for batch in batches:
            texts = batch.column(1).to_pylist()
            columns = [pa.array([len(t) for t in texts], pa.int64()), pa.array([count(t) for t in texts], pa.int64())]
            yield pa.record_batch([batch.column(0), *columns], names=["doc_id", "n_chars", "n_tokens"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return chosen.mapInArrow(run, "doc_id long, n_chars long, n_tokens long")
