"""SentencePiece encoding and decoding with N-best segmentation over the piece lattice.

A text's lattice has an edge for every vocabulary piece that matches at a place, and an edge of lowest
score for a character that no piece covers alone; such a character is spelled in byte pieces. Forward
Viterbi scores are exact heuristics for a backward A-star search, which therefore pops segmentations in
order of score. No piece has a word mark after another character, holds a line feed, or joins certain
signs to letters, so the lattice falls apart into chunks at these places (checked when the model is read): a chunk's paths are searched
alone and kept for its later occurrences, and the N best of a text are the N best sums over its chunks.
The first two results of new chunks are searched for in lockstep: one numpy step advances the search in all of them.
What is kept of chunks are arrays too (names, scores, ids end to end), in which those of a slice of texts are found at once.

Encoding: a word mark is put before the text, and stands for each space. Decoding is exact for every
text: a literal U+2581 has no piece here and is spelled in bytes. Ties go to the longer last piece.

Defined results: null gives null ids and null text; an empty text has no ids and decodes to itself. A
text with one segmentation only has one in its N best. Rows that repeat an id are each encoded.
"""

from __future__ import annotations

import hashlib
import heapq
from bisect import insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.llm.common import slices, utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Stands in the lattice for a literal word mark of the text (a lone surrogate, which no text holds).
_LITERAL = "\ud800"
#: Chunks whose paths a worker keeps; longest chunk that is kept, in characters; characters searched in lockstep at
#: once; and bytes of text that are cut at once.
KEPT_CHUNKS, KEPT_CHARS, AT_ONCE, CUT_BYTES = 250_000, 64, 1 << 18, 1 << 20
#: Kinds of characters: of words, signs that no piece joins to them, word marks, line feeds.
_OTHER, _SIGN, _BEFORE, _LINE = range(4)
#: Parts the chunks searched in lockstep (no character).
_END = 0x110000


def _signs(pieces: list[str]) -> str:
    """ASCII signs that no piece joins to other characters, but for a word mark before them."""
    pairs = {(p[i], p[i + 1]) for p in pieces for i in range(len(p) - 1)}
    signs = {chr(c) for c in range(128) if not chr(c).isalnum() and chr(c) not in " \n"}
    while True:
        joined = {x for a, b in pairs for x, y in ((a, b), (b, a)) if x in signs and y not in signs and (a, b) != (MARK, x)}
        if not joined:
            return "".join(sorted(signs))
        signs -= joined


def _named(text: str) -> bytes:
    """The name of a chunk: its characters, four bytes each."""
    return text.encode("utf-32-le", "surrogatepass")


def _chunk(name: bytes) -> str:
    return name.decode("utf-32-le", "surrogatepass")


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all runs, one after another: sizes[i] of them from starts[i] on."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


@dataclass
class Paths:
    """Best paths of chunks: ids of chunk i (sizes[i] of them from starts[i] on), its score, and the loss of its second best (inf
    without one)."""

    ids: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    scores: np.ndarray
    losses: np.ndarray

    @classmethod
    def made(cls, found: list[tuple[bytes, float, float]]) -> Paths:
        sizes = np.array([len(f[0]) // 4 for f in found], np.int64)
        return cls(np.frombuffer(b"".join([f[0] for f in found]), np.int32), np.cumsum(sizes) - sizes, sizes, np.array([f[1] for f in found], np.float64), np.array([f[2] for f in found], np.float64))

    def then(self, other: Paths) -> Paths:
        pairs = ((self.ids, other.ids), (self.starts, other.starts + len(self.ids)), (self.sizes, other.sizes), (self.scores, other.scores), (self.losses, other.losses))
        return Paths(*[np.concatenate(p) for p in pairs])

    def of(self, which: np.ndarray) -> Paths:
        """The paths at these places, which need not hold their ids in this order."""
        return Paths(self.ids, self.starts[which], self.sizes[which], self.scores[which], self.losses[which])

    def packed(self) -> Paths:
        """The same with no other ids."""
        return Paths(self.ids[_runs(self.starts, self.sizes)], np.cumsum(self.sizes) - self.sizes, self.sizes, self.scores, self.losses)

    def each(self) -> list[tuple[bytes, float, float]]:
        return [(self.ids[a : a + n].tobytes(), s, x) for a, n, s, x in zip(self.starts.tolist(), self.sizes.tolist(), self.scores.tolist(), self.losses.tolist(), strict=True)]


class Lattice:
    """Pieces, scores and segmentation; `pieces` are (text, score, id) of ordinary pieces."""

    def __init__(self, pieces: list[tuple[str, float, int]], byte_ids: list[int]):
        self.scores: dict[str, tuple[float, int] | None] = {}
        for text, _, _ in pieces:
            for k in range(1, len(text)):
                self.scores.setdefault(text[:k])
        for text, score, i in pieces:
            self.scores[text] = (score, i)
        if any(MARK in t.lstrip(MARK) or "\n" in t for t, _, _ in pieces):
            raise ValueError("a piece crosses a word's start or a line's end")
        self.lowest = min(s for _, s, _ in pieces if s > -1e8) - 10
        self.byte_ids = byte_ids
        self.raw = {i: t.replace(MARK, " ").encode() for t, _, i in pieces} | {i: bytes([b]) for b, i in enumerate(byte_ids)}
        #: Kinds of characters up to the word mark, and of all after it, by which a text is cut into chunks.
        self.kinds = np.full(ord(MARK) + 2, _OTHER, np.uint8)
        self.kinds[[ord(c) for c in _signs([t for t, _, _ in pieces])]] = _SIGN
        self.kinds[[ord(MARK), ord("\n")]] = _BEFORE, _LINE
        names = ["", *self.scores]
        place = {p: i for i, p in enumerate(names)}
        steps = sorted((place[p[:-1]] << 21 | ord(p[-1]), i) for p, i in place.items() if p)
        #: The pieces' trie: (node, character) in order, where it leads, and each node's piece; the last two
        #: pieces are a character that none covers, and no edge at all.
        self.steps, self.leads = (np.array(c, np.int64) for c in zip(*steps, strict=True))
        many = max(i for _, _, i in pieces) + 1
        self.plain, self.no_edge = many, many + 1
        self.node_piece = np.array([self.no_edge, *[v[1] if v else self.no_edge for v in self.scores.values()]], np.int32)
        self.piece_scores = np.full(many + 2, -np.inf)
        for _, score, i in pieces:
            self.piece_scores[i] = score
        self.piece_scores[self.plain] = self.lowest
        self.longest = max(len(t) for t, _, _ in pieces)
        top = max(self.raw) + 1
        self.raw_bytes = pa.array([self.raw.get(i, b"") for i in range(top)], pa.large_binary())
        #: Names of the chunks that are kept, and their paths.
        self.known, self.paths = pa.array([], pa.large_binary()), Paths.made([])
        self.others: dict[tuple[str, int], list[tuple[float, bytes]]] = {}

    @classmethod
    def read(cls, path: str = MODEL) -> Lattice:
        from sentencepiece import SentencePieceProcessor

        m = SentencePieceProcessor(model_file=path)
        every = range(m.get_piece_size())
        plain = [i for i in every if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        return cls([(m.id_to_piece(i), m.get_score(i), i) for i in plain], [i for i in every if m.is_byte(i)])

    def forward(self, chunk: str) -> tuple[list[list[tuple[int, float, int]]], list[float]]:
        """Edges and forward Viterbi: (start, score, id) of the pieces that end at each place, id -1 being a
        character without a piece, and the best score of the paths to each place."""
        n, get, lowest = len(chunk), self.scores.get, (self.lowest, -1)
        ends: list[list[tuple[int, float, int]]] = [[] for _ in range(n + 1)]
        first = [0.0] + [-np.inf] * n
        for i in range(n):
            here, j = first[i], i + 1
            # None: no piece, but a piece's beginning; 0: not even that
            found = get(chunk[i], 0)
            more = found != 0
            found = found or lowest
            while True:
                if found:
                    score, name = found
                    ends[j].append((i, score, name))
                    if here + score > first[j]:
                        first[j] = here + score
                j += 1
                if not more or j > n or (found := get(chunk[i:j], 0)) == 0:
                    break
        return ends, first

    def edges(self, chunk: str) -> list[list[tuple[int, float, int]]]:
        return self.forward(chunk)[0]

    def spell(self, i: int, char: str) -> tuple[int, ...]:
        return (i,) if i >= 0 else tuple(self.byte_ids[b] for b in char.replace(_LITERAL, MARK).encode())

    def path(self, chunk: str) -> tuple[bytes, float, float]:
        """Ids of the best path, its score, and the loss of the second best (inf without one), of one chunk."""
        found = self._search(chunk, 2)
        return np.array(found[0][1], np.int32).tobytes(), found[0][0], found[0][0] - found[1][0] if len(found) > 1 else np.inf

    def learn(self, chunks: list[str]) -> dict[str, tuple[bytes, float, float]]:
        """The paths of these chunks; those of up to KEPT_CHARS characters are kept for later calls."""
        different = list(dict.fromkeys(chunks))
        return dict(zip(different, self._learned(pa.array([_named(c) for c in different], pa.large_binary())).each(), strict=True))

    def _learned(self, names: pa.Array) -> Paths:
        """learn() of different chunks, by their names. What is known is found, and what is new searched, by arrays."""
        at = pc.fill_null(pc.index_in(names, self.known), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        sizes = pc.binary_length(names).to_numpy() // 4
        new = new[np.argsort(-sizes[new], kind="stable")]
        long = int(np.searchsorted(-sizes[new], -KEPT_CHARS, side="left"))
        whole = self.paths.then(Paths.made([self.path(_chunk(n)) for n in names.take(pa.array(new[:long])).to_pylist()]))
        ends, lo = np.cumsum(sizes[new] + 1), long
        while lo < len(new):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + AT_ONCE, side="right")))
            whole = whole.then(self._together(names.take(pa.array(new[lo:hi])), sizes[new[lo:hi]]))
            lo = hi
        at[new] = len(self.known) + np.arange(len(new))
        if len(self.known) + len(new) - long > KEPT_CHUNKS:
            keep = np.flatnonzero(sizes <= KEPT_CHARS)[:KEPT_CHUNKS]  # start anew, from the chunks at hand
            self.known, self.paths = names.take(pa.array(keep)), whole.of(at[keep]).packed()
        elif len(new) > long:
            keep = np.append(np.arange(len(self.known)), at[new[long:]])
            self.known, self.paths = pa.concat_arrays([self.known, names.take(pa.array(new[long:]))]), whole.of(keep).packed() if long else whole
        return whole.of(at)

    def _lockstep(self, chunks: list[str]) -> list[tuple[bytes, float, float]]:
        """path() of many chunks, the longest first, by the same sums in the same order."""
        return self._together(pa.array([_named(c) for c in chunks], pa.large_binary()), np.array([len(c) for c in chunks])).each()

    def _together(self, names: pa.Array, sizes: np.ndarray) -> Paths:
        """_lockstep() of chunks by their names and numbers of characters."""
        base = np.cumsum(sizes + 1) - sizes - 1
        signs = np.full(int(sizes.sum()) + len(sizes), _END, np.int64)
        inside = np.ones(len(signs), bool)
        inside[base + sizes] = False
        _, offsets, data = names.buffers()
        from_, to = np.frombuffer(offsets, np.int64)[[names.offset, names.offset + len(names)]]
        signs[inside] = np.frombuffer(data, np.uint32)[from_ // 4 : to // 4]
        # pieces by length and first character: every place walks down the trie as far as it leads
        edge = np.full((self.longest + 1, len(signs)), self.no_edge, np.int32)
        live, node, lengths = np.flatnonzero(inside), np.zeros(len(signs) - len(sizes), np.int64), []
        for d in range(1, self.longest + 1):
            key = node << 21 | signs[live + d - 1]
            at = np.minimum(np.searchsorted(self.steps, key), len(self.steps) - 1)
            on = self.steps[at] == key
            if d == 1:
                edge[1, live] = self.plain
            live, node = live[on], self.leads[at[on]]
            piece = self.node_piece[node]
            has = piece != self.no_edge
            edge[d, live[has]] = piece[has]
            if d == 1 or has.any():
                lengths.append(d)
            if len(live) == 0:
                break
        # forward Viterbi: the best and second best way into each place, and the last piece's length on the best
        first, second, step = np.zeros(len(signs)), np.full(len(signs), -np.inf), np.zeros(len(signs), np.int64)
        for r in range(1, int(sizes[0]) + 1):
            here = base[: int(np.searchsorted(-sizes, -r, side="right"))] + r
            best, other, length = np.full(len(here), -np.inf), np.full(len(here), -np.inf), np.zeros(len(here), np.int64)
            for d in reversed(lengths):
                if d <= r:
                    score = first[here - d] + self.piece_scores[edge[d, here - d]]
                    better = score > best
                    other = np.where(better, best, np.maximum(other, score))
                    best = np.where(better, score, best)
                    length[better] = d
            first[here], second[here], step[here] = best, other, length
        # backward: the first state popped is followed to the start, and the best other state is left open
        ends = base + sizes
        place, done, open_, who = ends.copy(), np.zeros(len(sizes)), np.full(len(sizes), -np.inf), np.arange(len(sizes))
        owners, pieces = [], []
        while len(who):
            at = place[who]
            open_[who] = np.maximum(open_[who], second[at] + done[who])
            piece = edge[step[at], at - step[at]]
            done[who] += self.piece_scores[piece]
            place[who] = at - step[at]
            owners.append(who)
            pieces.append(piece)
            who = who[place[who] > base[who]]
        owner, piece = np.concatenate(owners[::-1]), np.concatenate(pieces[::-1])
        order = np.argsort(owner, kind="stable")
        owner, ids = owner[order], piece[order].astype(np.int32)
        bounds = np.searchsorted(owner, np.arange(len(sizes) + 1))
        out = Paths(ids, bounds[:-1], np.diff(bounds), first[ends], first[ends] - open_)
        spelled = np.unique(owner[ids == self.plain])
        if len(spelled):
            at = np.arange(len(sizes))
            at[spelled] = len(sizes) + np.arange(len(spelled))
            out = out.then(Paths.made([self.path(_chunk(n)) for n in names.take(pa.array(spelled)).to_pylist()])).of(at).packed()
        return out

    def _search(self, chunk: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best (score, ids) of a chunk: backward A-star under the forward scores.

        Every open state has a completion of just its rank, and different states have different ones, so
        no more states are kept open than results are wanted. Of equal ranks the newest comes first, of one
        step's the longest piece, so the first results are the same for every n; as the best child has its
        parent's rank, it is followed at once.
        """
        ends, first = self.forward(chunk)
        open_: list[tuple] = []
        serial, out, state = 0, [], (-first[-1], 0, len(chunk), 0.0, None)
        while True:
            rank, _, j, done, tail = state
            room = n - len(out) - 1
            while j:
                edges = ends[j]
                best = edges[0]
                if len(edges) > 1:
                    top = first[best[0]] + best[1]
                    for edge in edges:
                        if first[edge[0]] + edge[1] > top:
                            best, top = edge, first[edge[0]] + edge[1]
                    if room:
                        for edge in reversed(edges):
                            if edge is not best:
                                i, s, piece = edge
                                other = -(first[i] + s + done)
                                if len(open_) < room or other <= open_[-1][0]:
                                    serial -= 1
                                    insort(open_, (other, serial, i, done + s, (i, piece, j, tail)))
                                    del open_[room:]
                i, s, piece = best
                done, tail, j = done + s, (i, piece, j, tail), i
            ids = []
            while tail:
                i, piece, end, tail = tail
                if piece >= 0:
                    ids.append(piece)
                else:
                    ids.extend(self.spell(-1, chunk[i:end]))
            out.append((-rank, tuple(ids)))
            if len(out) == n or not open_:
                return out
            state = open_.pop(0)

    def nbest(self, chunk: str, n: int) -> list[tuple[float, bytes]]:
        """The n best (score, ids as int32 bytes) of a chunk, kept."""
        if (known := self.others.get((chunk, n))) is None:
            known = [(score, np.array(ids, np.int32).tobytes()) for score, ids in self._search(chunk, n)]
            if len(self.others) >= KEPT_CHUNKS // 8:
                self.others.clear()
            if len(chunk) <= KEPT_CHARS:
                self.others[(chunk, n)] = known
        return known

    def split(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The names of the chunks of all texts, end to end, and where each text's begin. A chunk is word marks and what
        follows of one kind, word marks alone, or a line feed."""
        signs = np.frombuffer(_named("".join([" " + t for t in texts if t])), np.uint32).copy()
        spaces = signs == ord(" ")
        signs[signs == ord(MARK)] = ord(_LITERAL)
        signs[spaces] = ord(MARK)
        kind = self.kinds[np.minimum(signs, len(self.kinds) - 1)]
        here, last = kind[1:], kind[:-1]
        starts = np.ones(len(signs) + 1, bool)
        starts[1:-1] = (here == _LINE) | (last == _LINE) | ((here != last) & (last != _BEFORE))
        first = np.cumsum([0, *(len(t) + 1 if t else 0 for t in texts)])
        starts[first] = True
        bounds = np.flatnonzero(starts)
        names = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(4 * bounds), pa.py_buffer(signs)])
        return names, np.searchsorted(bounds, first)

    def segmentations(self, texts: list[str], n: int) -> list[list[tuple[float, bytes]]]:
        """The n best (score, ids as int32 bytes) of each text, best first. Equal chunks of the texts are looked up once."""
        names, first = self.split(texts)
        found = names.dictionary_encode()
        different, which = found.dictionary, found.indices.to_numpy()
        paths = self._learned(different).of(which)
        scores, losses = paths.scores.tolist(), paths.losses
        # each chunk's ids, end to end
        ends, ids = np.append(0, np.cumsum(paths.sizes)), paths.ids[_runs(paths.starts, paths.sizes)].tobytes()
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            chunk = lambda k: _chunk(different[int(which[a + k])].as_py())  # noqa: B023, E731
            at = 4 * ends[a : b + 1]
            out.append(self._merged(chunk, ids[at[0] : at[-1]], at - at[0], float(sum(scores[a:b])), losses[a:b], n))
        return out

    def _merged(self, chunk: Callable[[int], str], path: bytes, ends: np.ndarray, score: float, losses: np.ndarray, n: int) -> list[tuple[float, bytes]]:
        """The n best of one text from its best path, in which chunk k lies from ends[k] to ends[k + 1]."""
        best = [(score, ())]
        if n > 1 and len(losses):
            # a segmentation that leaves the best path elsewhere than at the n-1 cheapest chunks has n-1 better ones
            for k in np.argsort(losses, kind="stable")[: n - 1].tolist():
                if losses[k] < np.inf:
                    others = self.nbest(chunk(k), n)
                    sums = [(s - others[0][0] + x, (*pick, (k, ids)) if c else pick) for s, pick in best for c, (x, ids) in enumerate(others)]
                    best = heapq.nlargest(n, sums, key=lambda x: x[0])
        out = []
        for score, choices in best:
            parts, at = [], 0
            for k, ids in sorted(choices):
                parts += [path[at : ends[k]], ids]
                at = ends[k + 1]
            out.append((score, b"".join([*parts, path[at:]])))
        return out

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The bytes of id lists that lie end to end between `bounds`, each with the mark before its text."""
        taken = self.raw_bytes.take(pa.array(ids, pa.int32()))
        _, offsets, data = taken.buffers()
        at = np.frombuffer(offsets, np.int64)[taken.offset + bounds].tolist()
        data = memoryview(data) if data is not None else b""
        return [bytes(data[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


#: Lattices of this worker process: the paths they keep serve all its tasks.
_HERE: dict[str, Lattice] = {}


def _lattice(pieces: list[tuple[str, float, int]], byte_ids: list[int], name: str) -> Lattice:
    if name not in _HERE:
        _HERE[name] = Lattice(pieces, byte_ids)
    return _HERE[name]


def _vocabulary(model: str) -> tuple[list[tuple[str, float, int]], list[int], str]:
    """What workers need of a model file: read on the driver, sent with the task (32,000 short pieces)."""
    one = Lattice.read(model)
    pieces = [(t, *v) for t, v in one.scores.items() if v]
    return pieces, one.byte_ids, hashlib.sha256(repr((pieces, one.byte_ids)).encode()).hexdigest()


def _encoder(vocabulary: tuple, n: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(*vocabulary)
        for batch in batches:
            kept = [k for k in batch.schema.names if k != "text"]
            _, offsets = utf8(batch.column("text"))
            for lo, hi in slices(offsets, CUT_BYTES):
                part = batch.slice(lo, hi - lo)
                texts = part.column("text").to_pylist()
                best = lattice.segmentations([t or "" for t in texts], n)
                counts = [0 if t is None else len(b) for t, b in zip(texts, best, strict=True)]
                every = [x for t, b in zip(texts, best, strict=True) if t is not None for x in b]
                bounds = np.cumsum([0, *(len(ids) // 4 for _, ids in every)])
                ids = np.frombuffer(b"".join([x for _, x in every]), np.int32)
                whole = [b" " + t.encode() if t else b"" for t in texts]
                wanted = [t for t, c in zip(whole, counts, strict=True) for _ in range(c)]
                right = np.array([a == b for a, b in zip(lattice.decode(ids, bounds), wanted, strict=True)], bool)
                ends = np.cumsum([0, *counts])
                wrong = np.append(0, np.cumsum(~right))
                exact = pa.array([None if t is None else bool(wrong[a] == wrong[b]) for t, a, b in zip(texts, ends[:-1], ends[1:], strict=True)], pa.bool_())
                paths = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))
                nbest = pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array([s for s, _ in every], pa.float64()), paths], names=["score", "ids"]),
                    mask=part.column("text").is_null(),
                )
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), nbest, exact], names=[*kept, "nbest", "round_trip"])

    return encode


def encode_texts(docs: DataFrame, n: int = 4, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids of the best segmentation, scores and then (score, ids) of the n best, whether decoding each of them gives the text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = rows.mapInArrow(_encoder(_vocabulary(model), n), "doc_id long, nbest array<struct<score:double,ids:array<int>>>, round_trip boolean")
    ids = F.col("nbest")[0]["ids"]
    return out.select("doc_id", F.when(ids.isNotNull(), F.size(ids)).cast("long").alias("n_tokens"), ids.alias("ids"), F.col("nbest.score").alias("scores"), "nbest", "round_trip")


def _decoder(vocabulary: tuple):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(*vocabulary)
        for batch in batches:
            column = batch.column("ids")
            flat = column.flatten()  # leaves nulls out
            bounds = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)))
            texts = [x[1:].decode() for x in lattice.decode(flat.to_numpy(zero_copy_only=False), bounds.astype(np.int64))]
            texts = [t if ok else None for t, ok in zip(texts, column.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return decode


def decode_ids(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of encoded rows."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoder(_vocabulary(model)), "doc_id long, text string")
