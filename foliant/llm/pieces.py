"""Piece vocabularies of public SentencePiece model files, read as unigram vocabularies.

The path of the model file is a parameter; its bytes travel with the tasks, so executors need no copy.
White space is written as an ordinary space here (the file's marker U+2581 stands for it), so the marker
itself in a text is a character like any other.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import ahocorasick

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁"
#: The library's penalty of an unknown character, below the least score.
UNKNOWN_PENALTY = 10.0


@dataclass
class Vocabulary:
    """pieces: surface (with spaces) -> (id, score); bytes_: ids of the 256 byte pieces, or None."""

    pieces: dict[str, tuple[int, float]]
    bytes_: list[int] | None
    unknown_id: int
    size: int
    unknown_score: float = 0.0
    surfaces: list[bytes] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.unknown_score = min(s for _, s in self.pieces.values()) - UNKNOWN_PENALTY
        self.surfaces = [b""] * self.size
        for surface, (i, _) in self.pieces.items():
            self.surfaces[i] = surface.encode()
        for value, i in enumerate(self.bytes_ or ()):
            self.surfaces[i] = bytes([value])
        #: Pieces never cross these cuts: before a run of spaces, and around a line end.
        inner = any(" " in p.lstrip(" ") or "\n" in p for p in self.pieces)
        self.cuts = not inner
        self.cut = re.compile(r"(?s).+" if inner else r" +[^ \n]*|[^ \n]+|\n")

    def automaton(self, value) -> ahocorasick.Automaton:
        """Aho-Corasick automaton of the surfaces; each carries value(surface, id, score)."""
        out = ahocorasick.Automaton()
        for surface, (i, score) in self.pieces.items():
            out.add_word(surface, value(surface, i, score))
        out.make_automaton()
        return out


def parse(model: bytes) -> Vocabulary:
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    m.ParseFromString(model)
    kinds = m.SentencePiece
    pieces = {
        p.piece.replace(MARKER, " "): (i, p.score) for i, p in enumerate(m.pieces) if p.type == kinds.NORMAL
    }
    as_bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(m.pieces) if p.type == kinds.BYTE}
    return Vocabulary(
        pieces, [as_bytes[b] for b in range(256)] if len(as_bytes) == 256 else None,
        m.trainer_spec.unk_id, len(m.pieces),
    )


def read_model(path: str = MODEL_PATH) -> bytes:
    with open(path, "rb") as f:
        return f.read()
