"""A unigram vocabulary read from a SentencePiece model file, and how texts fall into marked words.

Scores and pieces are those of the file, taken as a unigram model's: the best segmentation has the largest sum of
scores. Ties follow the library's forward pass, which replaces a path only by a strictly better one and tries the
longest last piece first. A character that no piece covers alone may stand for itself as an unknown, at 10 below
the lowest score, and is spelled as one byte piece for each byte of UTF-8.

Pieces whose score is under `PLACEHOLDER` are ones the file's own segmentation never builds; they score one below
the lowest of the others, so that sums stay exact in floats.

White space U+0020 becomes the mark U+2581, one is put before a text that isn't empty, and nothing else is changed.
A segmentation may be worked out apart on both sides of a place that no piece can span. Such places are known from
the pairs of neighbouring bytes in the pieces: before a mark that follows another character, and mostly between
letters and other characters. What lies between them is called a marked word here.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

from logweft.llm.text import Words, flat

MARK = "▁"
UNKNOWN_PENALTY = 10.0
PLACEHOLDER = -1e8
NORMAL, USER_DEFINED, BYTE = 1, 4, 6


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@dataclass
class Vocabulary:
    pieces: dict[str, tuple[int, float]]  # id and score by piece
    byte_ids: list[int]
    surfaces: list[bytes]  # by id: what a piece decodes to, with marks as spaces
    unknown_score: float
    single: frozenset[str]
    joined: np.ndarray  # by pairs of bytes: whether a piece or a character may span the place between them

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        pieces, byte_ids, surfaces = {}, [0] * 256, []
        lowest = min((p.score for p in model.pieces if p.type in (NORMAL, USER_DEFINED) and p.score > PLACEHOLDER), default=0.0)
        joined = np.zeros((256, 256), bool)
        joined[:, 0x80:0xC0] = True  # never within a character
        for i, p in enumerate(model.pieces):
            surface = b""
            if p.type in (NORMAL, USER_DEFINED):
                pieces[p.piece] = (i, p.score if p.score > PLACEHOLDER else lowest - 1)
                surface = p.piece.replace(MARK, " ").encode()
                joined[list(surface[:-1]), list(surface[1:])] = True
            elif p.type == BYTE:
                value = int(p.piece[3:5], 16)
                byte_ids[value], surface = i, bytes([value])
            surfaces.append(surface)
        unknown = min((s for _, s in pieces.values()), default=0.0) - UNKNOWN_PENALTY
        return cls(pieces, byte_ids, surfaces, unknown, frozenset(p for p in pieces if len(p) == 1), joined)


@lru_cache(maxsize=2)
def load_vocabulary(path: str) -> Vocabulary:
    """One for each Python worker."""
    return Vocabulary.load(path)


def marked_words(texts: pa.Array, joined: np.ndarray) -> Words:
    """The marked words of some texts, with spaces for marks. Their bytes end to end are the texts, each with a space before it."""
    data, at = flat(texts)
    full = np.flatnonzero(np.diff(at) > 0)
    data = np.insert(data, at[:-1][full], 32)
    at = at + np.searchsorted(full, np.arange(len(at)))
    if not len(data):
        return Words(np.zeros(len(at), np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64), data)
    begins = np.ones(len(data), bool)
    begins[1:] = ~joined.ravel()[(data[:-1].astype(np.uint16) << np.uint16(8)) | data[1:]]
    begins[at[at < len(data)]] = True
    begin = np.flatnonzero(begins)
    return Words(np.searchsorted(begin, at), begin, np.append(begin, len(data)), np.ascontiguousarray(data))
