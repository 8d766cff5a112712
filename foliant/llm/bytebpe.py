"""Byte-level BPE with the tiktoken library over a local file of ranks.

Each match of the splitting pattern is merged separately by the library; special tokens do not exist, so
their strings are ordinary text.  A text of any length is handed over in parts, as the library's pattern
matcher exhausts its stack on white space of some hundred thousand characters.  Parts are cut only where every
way of matching has a boundary:

* before a space or line end that follows a character that is no white space, and between a letter or digit
  and a character of another kind (of ASCII, Han, kana and Hangul): no alternative of the pattern holds both, none looks back, and a
  lookahead reads from white space on only;
* a very long run of white space is one match without its last character, which stays with what follows it
  (or with it, at the end of the text), and is merged directly.

Decoding joins the raw bytes of the ids, so it is lossless also where an id ends inside a character.

Null texts encode to no ids in the digests and to null in ``encoded``; empty texts to no ids.  Rows are taken
as they come, repeats included, and other columns are ignored or kept as stated.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, small_batches

RANKS_PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Characters of a part; texts of up to twice as many are one part.
PART = 1 << 16
#: The pattern's white space.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LONG_SPACE = re.compile(f"[{_SPACE}]{{{PART},}}")
_LETTER = "A-Za-z\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
_CUT = re.compile(rf"(?<=\S)(?=[ \n])|(?<=[{_LETTER}])(?=[!-@\[-`{{-~\u3001-\u3003])|(?<=[0-9])(?=[!-/:-~])")


class Encoder:
    def __init__(self, ranks: bytes, pattern: str):
        pairs = (line.split() for line in ranks.splitlines())
        table = {base64.b64decode(a): int(b) for a, b in filter(None, pairs)}
        self._own = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.names = {i: str(i) for i in table.values()}

    def parts(self, text: str) -> Iterator[list[int]]:
        """Ids of a text, part by part."""
        at = 0
        while len(text) - at > 2 * PART:
            cut = _CUT.search(text, at + PART)
            upto = cut.end() if cut else len(text)
            yield from self._spaced(text[at:upto])
            at = upto
        yield from self._spaced(text[at:])

    def _spaced(self, part: str) -> Iterator[list[int]]:
        at = 0
        if len(part) > PART:
            for run in _LONG_SPACE.finditer(part):
                upto = run.end() - (run.end() < len(part))
                yield self._own.encode_ordinary(part[at : run.start()])
                yield self._own._encode_single_piece(part[run.start() : upto])
                at = upto
        yield self._own.encode_ordinary(part[at:])

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.parts(text) for i in ids]

    def decode(self, ids) -> bytes | None:
        """The bytes of the ids; None where one is not in the vocabulary."""
        ids = list(ids)
        return self._own.decode_bytes(ids) if all(i in self.names for i in ids) else None

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, digest of their decimals joined by spaces, digest of the decoded bytes."""
        n, of_ids, of_bytes = 0, hashlib.sha256(), hashlib.sha256()
        for ids in self.parts(text or ""):
            if ids:
                of_ids.update(((" " if n else "") + " ".join(map(self.names.__getitem__, ids))).encode())
                of_bytes.update(self._own.decode_bytes(ids))
                n += len(ids)
        return n, of_ids.hexdigest(), of_bytes.hexdigest()


_encoders: dict[tuple[int, str], Encoder] = {}


def _encoder(ranks: bytes, pattern: str) -> Encoder:
    key = (hash(ranks), pattern)
    if key not in _encoders:
        _encoders[key] = Encoder(ranks, pattern)
    return _encoders[key]


def _with_encoder(df: DataFrame, path: str, pattern: str):
    """A function that gives the encoder inside a task; the file, of fixed size, is read here and travels along."""
    small_batches(df.sparkSession)
    with open(path, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())
    return lambda: _encoder(ranks.value, pattern)


def encoded(docs: DataFrame, text: str = "text", path: str = RANKS_PATH, pattern: str = public_tokenizers.PATTERN) -> Column:
    """array<int>: the ids of each text; null for null."""
    encoder = _with_encoder(docs, path, pattern)

    def run(texts: pd.Series) -> pd.Series:
        e = encoder()
        out = pd.Series([e.encode(t) if isinstance(t, str) else None for t in texts], dtype=object)
        give_back()
        return out

    return F.pandas_udf(run, "array<int>")(docs[text])


def decoded(tokens: DataFrame, ids: str = "ids", path: str = RANKS_PATH, pattern: str = public_tokenizers.PATTERN) -> Column:
    """binary: the bytes of each row's ids; null for null, and where an id is null or not in the vocabulary."""
    encoder = _with_encoder(tokens, path, pattern)

    def run(rows: pd.Series) -> pd.Series:
        e = encoder()
        return pd.Series([e.decode(r) if r is not None else None for r in rows], dtype=object)

    return F.pandas_udf(run, "binary")(F.when(~F.exists(ids, lambda i: i.isNull()), tokens[ids]))


def token_digests(docs: DataFrame, text: str = "text", path: str = RANKS_PATH, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: one row for each row of ``docs``; null texts as empty ones."""
    own = docs.select("doc_id", text)
    encoder = _with_encoder(own, path, pattern)

    def run(texts: pd.Series) -> pd.DataFrame:
        e = encoder()
        out = pd.DataFrame(
            [e.digests(t if isinstance(t, str) else None) for t in texts], columns=["n_tokens", "ids_sha256", "decoded_sha256"]
        )
        give_back()
        return out

    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return own.select("doc_id", F.pandas_udf(run, kind)(own[text]).alias("__b")).select("doc_id", "__b.*")
