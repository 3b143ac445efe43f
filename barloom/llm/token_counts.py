"""Token counts of a unigram tokenizer without its tokens: a Viterbi pass that carries best scores and numbers of pieces.

An Aho-Corasick automaton of the vocabulary lists, for every end in a chunk of text, the pieces that end there, longest
first. Tie rules are those of the tokenizers library: of equal paths the one whose last piece starts first wins; a character
without a piece of its own is unknown, worth the least score less 10, and is counted as its UTF-8 bytes if the vocabulary
has byte pieces, else runs of unknown characters count as one.

Texts start with the word mark and blanks are word marks. No piece has a mark behind another character, or a line feed:
texts are cut before runs of blanks and around line feeds, and each distinct chunk is counted once for a block of texts and
kept in a table, by two hashes of together 128 bits.
A vocabulary that breaks this is used on uncut texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .arrays import Memo, blocks, ends_of, fingerprints, flat, lean
from .common import numbered, schema_with

MARK = "▁"
#: What an unknown character is worth less than the worst piece (a fixed value of the tokenizer).
UNKNOWN = 10.0


class UnigramCounter:
    """`pieces`: (text, score) of all ordinary pieces; `byte_fallback`: whether unknown characters are written as bytes."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool, cut: bool | None = None):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN
        self.byte_fallback = byte_fallback
        self.cut = cut if cut is not None else byte_fallback and not any("\n" in p or MARK in p.lstrip(MARK) for p, _ in pieces)
        self.memo = Memo(np.int32)

    def count(self, text: str) -> int:
        """The number of pieces of the best path over a text in which blanks are marks already."""
        n = len(text)
        best, number, run = [0.0] + [None] * n, [0] * (n + 1), [False] * (n + 1)
        at = [[] for _ in range(n + 1)]
        for end, found in self.automaton.iter(text):
            at[end + 1].append(found)
        for end in range(1, n + 1):
            top, single = None, False
            for size, score in at[end]:
                start = end - size
                total = best[start] + score
                single = single or size == 1
                if top is None or total > top:
                    top, number[end], run[end] = total, number[start] + 1, False
            if not single:
                total = best[end - 1] + self.unknown
                if top is None or total > top:
                    more = len(text[end - 1].encode()) if self.byte_fallback else int(not run[end - 1])
                    top, number[end], run[end] = total, number[end - 1] + more, True
            best[end] = top
        return number[n]

    def counts(self, column: pa.Array) -> np.ndarray:
        texts = pc.fill_null(column.cast(pa.binary()), b"").to_pylist()
        if not self.cut:
            return np.array([self.count(MARK + t.decode().replace(" ", MARK)) if t else 0 for t in texts], np.int64)
        raw = b"".join([b" " + t if t else t for t in texts])
        data, offsets = np.frombuffer(raw, np.uint8), np.concatenate(([0], np.cumsum([len(t) + 1 if t else 0 for t in texts]))).astype(np.int64)
        edge, blank, feed = np.zeros(len(data) + 1, bool), data == 32, np.flatnonzero(data == 10)
        edge[1:-1] = blank[1:] & ~blank[:-1]
        edge[feed] = edge[feed + 1] = edge[offsets] = True
        edges = np.flatnonzero(edge)
        starts, ends = edges[:-1], edges[1:]

        def compute(at: np.ndarray) -> list[int]:
            return [self.count(raw[a:b].decode().replace(" ", MARK)) for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]

        value = self.memo(fingerprints(data, starts, ends), ends_of(data, starts, ends), compute)
        return np.diff(np.concatenate(([0], np.cumsum(value, dtype=np.int64)))[np.searchsorted(starts, offsets)])


@lru_cache(2)
def load(path: str) -> UnigramCounter:
    """The ordinary pieces and scores of a SentencePiece file, read as a unigram vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
    return UnigramCounter([(model.id_to_piece(i), model.get_score(i)) for i in plain], any(model.is_byte(i) for i in ids))


def count_tokens(df: DataFrame, path: str, text: str = "text", into: str = "n_tokens") -> DataFrame:
    """All columns of `df` and a long `into`, the number of tokens of the whole text; null and empty texts have none.

    A column that is called like `into` is replaced; others, and repeated rows, stay.
    """
    df, names, text = numbered(df, into, text)
    into = "result"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            parts = [model.counts(column.slice(i, j - i)) for i, j in blocks(flat(column)[1])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(parts) if parts else [], pa.int64())], [*batch.schema.names, into])

    return df.mapInArrow(lean(run), schema_with(df, **{into: "long"})).toDF(*names)
