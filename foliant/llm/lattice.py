"""Reproducible sampled segmentations: forward filtering and backward sampling over the piece lattice.

A text is cut where no piece can cross (before a run of spaces, around a line end); the lattice of a text is
the chain of its chunks' lattices.  The forward sums of a chunk depend on its characters only, so they are
computed for all new chunks of a run at once, character by character in numpy: for each position the pieces
that end there, with the probability of taking each when walking back.  Chunks that come again are kept in a
table of bounded size; those seen for the first time are dropped after their run.
Backward sampling then walks all chunks of a run at once; the uniform number of a step is a hash of
(seed, row key, chunk number, step), so a row's segmentation depends on its key and text alone.  A run is a
piece of bounded size of an Arrow batch (a longer text is several), so memory does not grow with the texts.

A segmentation has probability proportional to exp(alpha * sum of piece scores).  ``rank`` scores (the
default) read the file's scores, minus a merge rank, as Zipf log-probabilities -ln(1 + rank); ``file`` takes
them as they are.  Characters that are no piece become their UTF-8 byte pieces, so decoding is lossless.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, small_batches, text_parts
from .pieces import MODEL_PATH, Vocabulary, parse, read_model

ALPHA = 1.0
SEED = 7
#: Edges kept by a worker before its table starts afresh, and slots of the table's chunks; bytes of a run.
TABLE_EDGES = 3 << 20
SLOT_BITS = 20
RUN_BYTES = 1 << 20
#: Bits of the filter that tells chunks that came before.
SEEN_BITS = 23
#: Longer chunks are filtered one by one, in logarithms, and not kept.
SHORT = 48
#: Chunks filtered together.
_TOGETHER = 8192

_STEP = 0x9E3779B97F4A7C15
_K = [np.uint64(x) for x in (_STEP, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _steps(n: int) -> np.uint64:
    return np.uint64(n * _STEP % (1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _K[1]
    x = (x ^ (x >> np.uint64(27))) * _K[2]
    return x ^ (x >> np.uint64(31))


def _hash_of(piece: str) -> int:
    h = 0
    for c in piece:
        h = (h ^ (ord(c) + 1)) * int(_K[1]) & (1 << 64) - 1
        h ^= h >> 29
    return h * int(_K[2]) & (1 << 64) - 1


class Table:
    """The lattices of many chunks, flat.

    Node ``first[k]`` .. : edges of node k, longest piece first; ``share`` the probability of each (2 for the
    last one, which takes the rest), ``piece`` the piece, ``back`` the node before it (-1: the chunk's start).
    """

    def __init__(self, vocabulary: Vocabulary, alpha: float, scores: str):
        self.vocabulary = vocabulary
        top = max(s for _, s in vocabulary.pieces.values())
        weigh = (lambda s: -math.log1p(top - s)) if scores == "rank" else (lambda s: s)
        self.log_weight = np.full(vocabulary.size, alpha * weigh(vocabulary.unknown_score))
        self.length = np.zeros(vocabulary.size, np.int64)
        for surface, (i, s) in vocabulary.pieces.items():
            self.log_weight[i], self.length[i] = alpha * weigh(s), len(surface)
        self.longest = int(self.length.max())
        # a factor for every character changes no probability and keeps the sums in range
        self.per_char = -float(np.median(self.log_weight[self.length > 0])) / 3
        self.log_weight += self.per_char * np.maximum(self.length, 1)
        self.factor = np.exp(self.log_weight)
        self.id_bits = max(1, (vocabulary.size - 1).bit_length())
        self.length_bits = max(1, self.longest.bit_length())
        # pieces by hash: two tables of slots, and whatever collides in both
        self.hash_of_id = np.zeros(vocabulary.size + 1, np.uint64)
        self.slots = [np.full(1 << 20, vocabulary.size, np.int32) for _ in range(2)]
        self.crowded: dict[int, int] = {}
        self.alive = np.zeros(1 << 20, bool)
        for surface, (i, _) in vocabulary.pieces.items():
            h = _hash_of(surface)
            self.hash_of_id[i] = h
            for table, slot in zip(self.slots, (h >> 44, h >> 24 & 0xFFFFF), strict=True):
                if table[slot] == vocabulary.size:
                    table[slot] = i
                    break
            else:
                self.crowded[h] = i
            for n in range(1, len(surface)):
                self.alive[_hash_of(surface[:n]) >> 44] = True
        #: multipliers of a chunk's hash by place
        self.multipliers = np.random.default_rng(20240711).integers(1, 1 << 63, SHORT + 1, np.uint64) * np.uint64(2) + np.uint64(1)
        self.reset()

    def reset(self) -> None:
        self.n_nodes = self.n_edges = self.n_chunks = 0
        self.first = np.zeros(1 << 16, np.int32)
        self.share = np.zeros(1 << 17)
        self.piece = np.zeros(1 << 17, np.int32)
        self.back = np.zeros(1 << 17, np.int32)
        #: open addressing: hashes of chunks (0: free) and their end nodes
        self.chunk_hash = np.zeros(1 << SLOT_BITS, np.uint64)
        self.chunk_end = np.zeros(1 << SLOT_BITS, np.int32)

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """End node of each chunk by its hash, -1 where it is not kept."""
        out = np.full(len(h), -1, np.int64)
        todo = np.arange(len(h))
        slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        while len(todo):
            there = self.chunk_hash[slot]
            hit = there == h[todo]
            out[todo[hit]] = self.chunk_end[slot[hit]]
            on = ~hit & (there != 0)
            todo, slot = todo[on], (slot[on] + 1) & ((1 << SLOT_BITS) - 1)
        return out

    def keep(self, h: np.ndarray, end: np.ndarray) -> None:
        """Remember chunks that are not kept yet; hashes differ."""
        self.n_chunks += len(h)
        slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        while len(h):
            free = np.flatnonzero(self.chunk_hash[slot] == 0)
            self.chunk_hash[slot[free]] = h[free]
            won = self.chunk_hash[slot] == h
            self.chunk_end[slot[won]] = end[won]
            h, end, slot = h[~won], end[~won], (slot[~won] + 1) & ((1 << SLOT_BITS) - 1)

    def _append(self, first: np.ndarray, share: np.ndarray, piece: np.ndarray, back: np.ndarray) -> None:
        def put(name: str, at: int, values: np.ndarray) -> None:
            have = getattr(self, name)
            if at + len(values) > len(have):
                more = np.zeros(at + len(values) + (len(have) >> 1), have.dtype)
                more[:at] = have[:at]
                setattr(self, name, have := more)
            have[at : at + len(values)] = values

        put("first", self.n_nodes, first + self.n_edges)
        put("share", self.n_edges, share)
        put("piece", self.n_edges, piece)
        put("back", self.n_edges, back)
        self.n_nodes += len(first)
        self.n_edges += len(share)

    def add(self, chars: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """End nodes of new chunks, which stand in ``chars`` (code points plus one) from ``starts`` on."""
        ends = np.zeros(len(starts), np.int64)
        order = np.argsort(-lengths, kind="stable")
        n_long = int((lengths > SHORT).sum())
        bounds = [*range(n_long), *range(n_long, len(order), _TOGETHER), len(order)]
        for a, b in zip(bounds, bounds[1:], strict=False):
            some = order[a:b]
            size = lengths[some]
            within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            ends[some] = self._add(chars[np.repeat(starts[some], size) + within], size, a < n_long)
        return ends

    def _find(self, key: np.ndarray) -> np.ndarray:
        """Piece of each hash; the number of pieces where there is none."""
        none = self.vocabulary.size
        found = self.slots[0][key >> np.uint64(44)]
        miss = np.flatnonzero(self.hash_of_id[found] != key)
        other = self.slots[1][(key[miss] >> np.uint64(24)) & np.uint64(0xFFFFF)]
        found[miss] = np.where(self.hash_of_id[other] == key[miss], other, none)
        for h, i in self.crowded.items():
            found[key == np.uint64(h)] = i
        return found

    def _edges(self, chars: np.ndarray, left: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, first characters, pieces) of all matches, by length; no piece spans two chunks.

        ``left``: characters from each one to the end of its chunk.  A place is followed while what was read
        may begin a piece.
        """
        at = np.arange(len(chars))
        h = np.zeros(len(chars), np.uint64)
        for n in range(1, self.longest + 1):
            h = (h ^ chars[at + (n - 1)]) * _K[1]
            h ^= h >> np.uint64(29)
            key = h * _K[2]
            piece = self._find(key)
            hit = np.flatnonzero(self.length[np.minimum(piece, self.vocabulary.size - 1)] == n)
            hit = hit[piece[hit] < self.vocabulary.size]
            yield n, at[hit], piece[hit]
            on = np.flatnonzero(self.alive[key >> np.uint64(44)] & (left[at] > n))
            if not len(on):
                break
            at, h = at[on], h[on]

    def _add(self, chars: np.ndarray, lengths: np.ndarray, logs: bool) -> np.ndarray:
        """Chunks end to end, longest first, so the nodes of a depth are those of the first chunks."""
        n = len(chars)
        offsets = np.cumsum(lengths) - lengths
        chunk = np.repeat(np.arange(len(lengths)), lengths)
        depth = np.arange(n) - offsets[chunk]
        # node base[d] + k: after the (d + 1)-th character of chunk k
        base = np.append(0, np.cumsum(np.bincount(depth)))
        node = base[depth] + chunk
        lone = np.ones(n, bool)
        keys = []
        # one sortable number an edge: its node, longer pieces first, its piece
        pack = lambda e, k, p: (e << self.length_bits | ((1 << self.length_bits) - k)) << self.id_bits | p
        for k, at, piece in self._edges(chars, lengths[chunk] - depth):
            if k == 1:
                lone[at] = False
            keys.append(pack(node[at + (k - 1)], k, piece))
        lone = np.flatnonzero(lone)
        byte_ids = self.vocabulary.bytes_ or [self.vocabulary.unknown_id] * 256
        as_bytes = [chr(c - 1).encode("utf-8", "surrogatepass") for c in chars[lone].tolist()]
        if len(lone):  # a lone character: its bytes in a row; the last one is the edge from the position before
            keys.append(pack(node[lone], 1, np.array([byte_ids[b[-1]] for b in as_bytes], np.int64)))
        key = np.concatenate(keys)
        key.sort()
        piece = key & ((1 << self.id_bits) - 1)
        size = (1 << self.length_bits) - (key >> self.id_bits & ((1 << self.length_bits) - 1))
        end = key >> (self.id_bits + self.length_bits)
        first = np.searchsorted(end, np.arange(n + 1))
        node_depth = np.repeat(np.arange(len(base) - 1), np.diff(base))
        edge_depth = node_depth[end]
        start_depth = edge_depth - size
        start = np.where(start_depth >= 0, base[start_depth] + end - base[edge_depth], n)
        if logs:
            total = np.full(n + 1, 0.0)
            weight = self.log_weight[piece]
            for p in range(n):
                w = total[start[first[p] : first[p + 1]]] + weight[first[p] : first[p + 1]]
                m = w.max()
                total[p] = m + math.log(np.exp(w - m).sum())
            share = np.exp(total[start] + weight - total[end])
        else:
            sums = np.ones(n + 1)
            flow = self.factor[piece]
            for a, b in zip(base, base[1:], strict=False):
                i, j = first[a], first[b]
                flow[i:j] *= sums[start[i:j]]
                sums[a:b] = np.add.reduceat(flow[i:j], first[a:b] - i)
            share = flow / sums[end]
        share[first[1:] - 1] = 2.0  # whatever rounding did: the last edge takes the rest
        back = np.where(start < n, start + self.n_nodes, -1)
        # chains of a lone character's earlier bytes become nodes of their own
        extra_first, extra_piece, extra_back = [], [], []
        many = {int(node[p]): b for p, b in zip(lone, as_bytes, strict=True) if len(b) > 1}
        if many:
            n_edges = len(key)
            for k in np.flatnonzero((size == 1) & np.isin(end, list(many))):
                before, b = back[k], many[int(end[k])]
                for value in b[:-1]:
                    extra_first.append(n_edges + len(extra_piece))
                    extra_piece.append(byte_ids[value])
                    extra_back.append(before)
                    before = self.n_nodes + n + len(extra_first) - 1
                back[k] = before
        ends = self.n_nodes + base[lengths - 1] + np.arange(len(lengths))
        self._append(
            np.concatenate([first[:-1], np.array(extra_first, np.int64)]),
            np.concatenate([share, np.full(len(extra_piece), 2.0)]),
            np.concatenate([piece, np.array(extra_piece, np.int64)]),
            np.concatenate([back, np.array(extra_back, np.int64)]),
        )
        return ends

    def walk(self, node: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sampled pieces of the chunks that end at ``node``, in text order, and each chunk's number of them."""
        steps_who, steps_piece = [], []
        who = np.arange(len(node))
        counts = np.zeros(len(key), np.int64)
        step = 0
        while len(who):
            rest = (_mix(key[who] + _steps(step + 1)) >> np.uint64(11)) * 2.0**-53
            e = self.first[node]
            share = self.share[e]
            open_ = np.flatnonzero(rest >= share)
            more = rest[open_] - share[open_]
            while len(open_):
                e[open_] += 1
                share = self.share[e[open_]]
                on = more >= share
                open_, more = open_[on], (more - share)[on]
            steps_who.append(who)
            steps_piece.append(self.piece[e])
            counts[who] += 1
            node = self.back[e]
            on = np.flatnonzero(node >= 0)
            who, node = who[on], node[on]
            step += 1
        upto = np.cumsum(counts)
        out = np.empty(int(upto[-1]) if len(upto) else 0, np.int32)
        for k, (w, p) in enumerate(zip(steps_who, steps_piece, strict=True)):
            out[upto[w] - 1 - k] = p
        return out, counts


class Sampler:
    def __init__(self, model: bytes, alpha: float = ALPHA, seed: int = SEED, scores: str = "rank"):
        self.vocabulary = parse(model)
        self.table = Table(self.vocabulary, alpha, scores)
        self.seed = seed
        self.seen = np.zeros(1 << SEEN_BITS, bool)
        self.n_seen = 0
        self.surfaces = pa.array(self.vocabulary.surfaces, pa.binary())

    def rest(self) -> None:
        """Keep the vocabulary only; the worker may idle."""
        self.table.reset()
        self.seen = np.zeros(1 << SEEN_BITS, bool)
        self.n_seen = 0
        give_back()

    def starts(self, data: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """First bytes of the chunks of texts that begin at ``rows``, each with a space put before it."""
        out = np.zeros(len(data), bool)
        if self.vocabulary.cuts:
            space, line = data == 32, data == 10
            out |= line
            out[1:] |= line[:-1]
            space[1:] &= ~space[:-1]
            out |= space
        out[rows] = True
        return np.flatnonzero(out)

    def _run(self, data: bytes, starts: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of the chunks that begin at ``starts``, and each chunk's number of them."""
        table = self.table
        offsets = np.append(starts, len(data)).astype(np.int32)
        coded = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        code = coded.indices.to_numpy()
        every = coded.dictionary
        bounds = np.frombuffer(every.buffers()[1], np.int32, len(every) + 1, every.offset * 4).astype(np.int64)
        flat = every.buffers()[2].to_pybytes()[bounds[0] : bounds[-1]]
        chars = np.frombuffer(flat.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        chars += np.uint64(1)
        if len(chars) < len(flat):  # places of bytes to places of characters
            begins = (np.frombuffer(flat, np.uint8) & 0xC0) != 0x80
            bounds = np.append(0, np.cumsum(begins))[bounds - bounds[0]]
        first, lengths = bounds[:-1] - bounds[0], np.diff(bounds)
        place = np.arange(len(chars)) - np.repeat(first, lengths)
        h = np.add.reduceat(chars * table.multipliers[np.minimum(place, SHORT)], first)
        h = _mix(h ^ lengths.astype(np.uint64)) | np.uint64(1)
        if table.n_edges > TABLE_EDGES or table.n_chunks > 1 << (SLOT_BITS - 1):
            table.reset()
        short = lengths <= SHORT
        end = table.lookup(h)
        end[~short] = -1
        new = end < 0
        slot = h >> np.uint64(64 - SEEN_BITS)
        again = np.flatnonzero(new & short & self.seen[slot])
        fresh = slot[new]
        self.n_seen += len(fresh) - len(again)
        if self.n_seen > len(self.seen) // 4:
            self.seen[:] = False
            self.n_seen = 0
        self.seen[fresh] = True
        end[again] = table.add(chars, first[again], lengths[again])
        table.keep(h[again], end[again])
        mark = table.n_nodes, table.n_edges
        once = np.flatnonzero(end < 0)
        end[once] = table.add(chars, first[once], lengths[once])
        pieces, counts = table.walk(end[code], key)
        table.n_nodes, table.n_edges = mark
        return pieces, counts

    def _keys(self, own: np.ndarray, number: np.ndarray) -> np.ndarray:
        return _mix(own ^ (number.astype(np.uint64) + np.uint64(1)) * _K[2])

    def _long(self, data: bytes, own: np.ndarray) -> np.ndarray:
        """Pieces of one text, in runs of chunks."""
        starts = self.starts(np.frombuffer(data, np.uint8), np.zeros(1, np.int64))
        out, a = [], 0
        while a < len(starts):
            b = max(a + 1, int(np.searchsorted(starts, starts[a] + RUN_BYTES)))
            upto = int(starts[b]) if b < len(starts) else len(data)
            key = self._keys(np.repeat(own, b - a), np.arange(a, b))
            out.append(self._run(data[starts[a] : upto], starts[a:b] - starts[a], key)[0])
            a = b
        return np.concatenate(out)

    def encode(self, texts: list[str | None], keys: list[int]) -> list[np.ndarray]:
        """Piece ids of each text; none for null and empty texts.  Equal keys and texts give equal ids."""
        own = _mix(np.array(keys, np.int64).view(np.uint64) + _steps(self.seed))
        out: list[np.ndarray] = []
        run: list[bytes] = []
        size, first = 0, 0

        def flush() -> None:
            nonlocal run, size
            sizes = np.array([len(r) for r in run])
            real = np.flatnonzero(sizes)
            if len(real):
                data = b"".join(run)
                rows = (np.cumsum(sizes) - sizes)[real]
                starts = self.starts(np.frombuffer(data, np.uint8), rows)
                at = np.searchsorted(starts, rows)
                chunks = np.diff(np.append(at, len(starts)))
                number = np.arange(len(starts)) - np.repeat(at, chunks)
                pieces, counts = self._run(data, starts, self._keys(np.repeat(own[first + real], chunks), number))
                per_text = np.zeros(len(run), np.int64)
                per_text[real] = np.add.reduceat(counts, at)
                out.extend(np.split(pieces, np.cumsum(per_text)[:-1]))
            else:
                out.extend([np.zeros(0, np.int32)] * len(run))
            run, size = [], 0

        for k, text in enumerate(texts):
            data = (" " + text).encode("utf-8", "surrogatepass") if text else b""
            if run and size + len(data) > RUN_BYTES:
                flush()
            if not run:
                first = k
            if len(data) > RUN_BYTES:
                out.append(self._long(data, own[k : k + 1]))
                continue
            run.append(data)
            size += len(data)
        if run:
            flush()
        return out

    def decode(self, pieces: np.ndarray, counts: np.ndarray) -> pa.Array:
        """Texts (binary) of rows with so many pieces each: the surfaces in a row, without the space put before."""
        if not len(pieces):
            return pa.array([b""] * len(counts), pa.binary())
        surfaces = self.surfaces.take(pa.array(pieces))
        bounds = np.frombuffer(surfaces.buffers()[1], np.int32, len(pieces) + 1, surfaces.offset * 4)
        rows = bounds[np.append(0, np.cumsum(counts))] - bounds[0]
        data = np.frombuffer(surfaces.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
        kept = np.ones(len(data), bool)
        kept[rows[:-1][counts > 0]] = False
        rows = (rows - np.append(0, np.cumsum(counts > 0))).astype(np.int32)
        return pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(rows), pa.py_buffer(data[kept])])


_samplers: dict[tuple, Sampler] = {}


def _sampler(*key) -> Sampler:
    if key not in _samplers:
        _samplers.clear()
        _samplers[key] = Sampler(*key)
    return _samplers[key]


def with_pieces(
    docs: DataFrame, path: str = MODEL_PATH, alpha: float = ALPHA, seed: int = SEED, scores: str = "rank",
    text: str = "text", key: str = "doc_id", keep_text: bool = True,
) -> DataFrame:
    """All columns of ``docs`` plus piece_ids, sampled by the row's key (a null key counts as 0), and lossless.

    lossless tells whether decoding the pieces gives the row's text again (the empty text for null).  Columns
    of these two names are replaced.  Without ``keep_text`` the text is left out of the result.
    """
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(read_model(path))  # a file of fixed size
    kept = [c for c in docs.columns if c not in ("piece_ids", "lossless") and (keep_text or c != text)]
    at = kept.index(text) if keep_text else -1  # a kept text travels once
    others = [c for c in kept if c != text]
    own = docs.select(*[docs[c] for c in others], docs[text].alias("__text"), F.coalesce(docs[key].cast("long"), F.lit(0)).alias("__key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = _sampler(model.value, alpha, seed, scores)
        for whole in batches:
            n = whole.num_columns
            for a, size in text_parts(whole.column(n - 2), RUN_BYTES):
                batch = whole.slice(a, size)
                texts = batch.column(n - 2)
                found = sampler.encode(texts.to_pylist(), batch.column(n - 1).to_pylist())
                counts = np.fromiter(map(len, found), np.int64, len(found))
                pieces = np.concatenate([*found, np.zeros(0, np.int32)])
                again = pc.equal(sampler.decode(pieces, counts), pc.fill_null(texts, "").cast(pa.binary()))
                ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(pieces))
                columns = list(batch.columns[: n - 2])
                if at >= 0:
                    columns.insert(at, texts)
                yield pa.RecordBatch.from_arrays([*columns, ids, again], names=[*kept, "piece_ids", "lossless"])
        sampler.rest()

    fields = [T.StructField("piece_ids", T.ArrayType(T.IntegerType(), False)), T.StructField("lossless", T.BooleanType())]
    return own.mapInArrow(run, T.StructType([*docs.select(*kept).schema.fields, *fields]))


def decode(docs: DataFrame, ids: str = "piece_ids", out: str = "text", path: str = MODEL_PATH) -> DataFrame:
    """``docs`` with the text of the piece ids in column ``ids``; an empty array gives an empty text, null gives null."""
    model = docs.sparkSession.sparkContext.broadcast(read_model(path))

    def run(rows: pa.Array) -> pa.Array:
        sampler = _sampler(model.value, ALPHA, SEED, "rank")
        whole = pc.fill_null(rows, [])
        texts = sampler.decode(whole.flatten().to_numpy(), pc.list_value_length(whole).to_numpy()).to_pylist()
        null = rows.is_null().to_pylist()
        return pa.array((None if n else t.decode("utf-8", "replace") for n, t in zip(null, texts, strict=True)), pa.string())

    return docs.withColumn(out, F.arrow_udf(run, "string")(docs[ids]))


def segmentation_digests(docs: DataFrame, path: str = MODEL_PATH, **options) -> DataFrame:
    """doc_id, n_pieces, pieces_hash, lossless: one row for each row of ``docs``.

    Null and empty texts have no pieces.  lossless tells whether decoding gives the text again.
    """
    found = with_pieces(docs.select("doc_id", F.col("text").alias("__t")), path, text="__t", keep_text=False, **options)
    return found.select(
        "doc_id",
        F.size("piece_ids").cast("long").alias("n_pieces"),
        F.xxhash64("piece_ids").alias("pieces_hash"),
        "lossless",
    )
