"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton finds all pieces in a segment at once; dynamic programming over their
ends carries the best score and the number of pieces of the best path, never the path itself.

Tie rules are those of the public unigram tokenizer with double scores: of equal scores the
path that comes from the earliest place wins; a character that no piece covers alone becomes
one unknown step, at the lowest score less 10, and counts as its UTF-8 bytes where the
vocabulary falls back to bytes, else as one piece for a run of such characters. One space is set
before each text, as the vocabulary's own settings say. The file at hand holds scores of merge
ranks; they are read as unigram scores.

With whole_runs, as the query has it, a run of spaces stays in one segment, so that pieces of
several spaces match: the vocabulary has them and doesn't ask for a split. Without it every space
begins a segment, as after the public library's Metaspace split.

Defined results: null counts as empty and has no tokens; a null id stays null; rows that repeat an id
or a text are each counted; texts of any length are counted whole; an empty table gives no rows; other
columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from docweave.llm.columnar import blocks
from docweave.llm.segments import Segments, run_of_spaces_starts, space_starts

NORMAL, UNKNOWN_PENALTY, MARK = 1, 10.0, "▁"


def read_pieces(raw: bytes) -> tuple[dict[str, float], bool]:
    """Piece to score of the pieces that text can match, and whether unknown characters become bytes."""
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(raw)
    return {p.piece: p.score for p in model.pieces if p.type == NORMAL}, bool(model.trainer_spec.byte_fallback)


class CountingViterbi:
    def __init__(self, pieces: dict[str, float], bytes_for_unknown: bool, whole_runs: bool = False):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p in pieces if len(p) == 1}
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN_PENALTY
        self.bytes_for_unknown = bytes_for_unknown
        self.whole_runs = whole_runs
        self.segments = Segments(run_of_spaces_starts if whole_runs else space_starts, self._encode, first_differs=True)

    def count(self, text: str) -> int:
        """Pieces of the best path over a text that has its marks."""
        n = len(text)
        none = float("-inf")
        best, pieces, unknown = [none] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        best[0] = 0.0
        single = self.single
        # a character alone as an unknown step starts just before its end, so it is the last to be tried there
        matches: dict[int, list] = {}
        for end, hit in self.automaton.iter(text):
            matches.setdefault(end + 1, []).append(hit)
        for end in range(1, n + 1):
            top, amount, odd = none, 0, False
            for length, score in sorted(matches.get(end, ()), reverse=True):  # earliest start first
                s = best[end - length] + score
                if s > top:
                    top, amount, odd = s, pieces[end - length] + 1, False
            c = text[end - 1]
            if c not in single:
                s = best[end - 1] + self.unknown
                if s > top:
                    top, odd = s, True
                    step = len(c.encode()) if self.bytes_for_unknown else int(not unknown[end - 1])
                    amount = pieces[end - 1] + step
            best[end], pieces[end], unknown[end] = top, amount, odd
        return pieces[n]

    def _encode(self, segments: list[bytes], first: np.ndarray) -> np.ndarray:
        if self.whole_runs:
            return np.fromiter((self.count(((" " if f else "") + s.decode()).replace(" ", MARK)) for s, f in zip(segments, first, strict=True)), np.int64, len(segments))
        out = np.fromiter((self.count(s.decode().replace(" ", MARK)) if not f or s[:1] == b" " else self.count(MARK + s.decode()) for s, f in zip(segments, first, strict=True)), np.int64, len(segments))
        alone = first & np.fromiter((s[:1] == b" " for s in segments), bool, len(segments))
        return out + alone * self.count(MARK)

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        codes, bounds = self.segments.codes_of(data, offsets)
        sums = np.concatenate(([0], np.cumsum(codes)))
        return np.diff(sums[bounds])


_counters: dict[tuple[str, bool], CountingViterbi] = {}


def counter(path: str, whole_runs: bool = False) -> CountingViterbi:
    """One for each worker process."""
    if (path, whole_runs) not in _counters:
        with open(path, "rb") as f:
            _counters[path, whole_runs] = CountingViterbi(*read_pieces(f.read()), whole_runs)
    return _counters[path, whole_runs]


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", whole_runs: bool = False) -> DataFrame:
    """id, n_chars, n_tokens for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model_path, whole_runs)
        for batch in batches:
            for a, b, data, offsets in blocks(batch.column(1)):
                points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(points), pa.int64()), pa.array(own.counts(data, offsets), pa.int64())], names=[id_col, "n_chars", "n_tokens"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, f"{id_col} long, n_chars long, n_tokens long")
