"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A task takes a slice of the corpus, cuts its texts into pieces, and keeps each distinct
piece once. All their bytes lie in one array of symbols with neighbour links. An
inverted index leads from the rank of a symbol pair to its positions; the merges are
applied in rank order, each to all its positions at once, and only the pairs of the
touched neighbours enter the index anew. Texts are then put together from the pieces.

A merge can in rare vocabularies make a pair of lower rank than its own; the library
would take that one at once, before later places of the same piece. Pieces where this
happens are encoded again one merge at a time, so the result is exact in every case.

Scale: no shuffle; the vocabulary (bounded by its file) is read in each worker once.
Defined results: null counts as empty (no ids, digest of nothing); a piece may be as
long as a text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections import defaultdict
from itertools import count, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as c

#: Bytes of text whose pieces are replayed together.
CORPUS_BYTES = 4 << 20
#: Distinct chunks that a task remembers; then it starts anew, which changes no result.
CORPUS_CHUNKS = 300_000
#: White space as the splitting pattern means it: the Unicode property, without the separators 1C-1F.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Between a non-space and a space there is always a piece boundary.
CHUNKS = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")


def piece_pattern(pattern: str):
    """The splitting pattern with white space as defined above."""
    return regex.compile(pattern.replace("[^\\s", f"[^{WHITE}").replace("\\s", f"[{WHITE}]").replace("\\S", f"[^{WHITE}]"))


class Vocabulary:
    """Ranks of a tiktoken file, and the pair table derived from them."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pattern = piece_pattern(pattern)
        self.bytes = [b""] * (max(self.ranks.values()) + 1)
        for token, r in self.ranks.items():
            self.bytes[r] = token
        self.first = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.width = len(self.bytes)
        pairs = {}
        for token, r in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a * self.width + b] = r
        self.forget()
        # an open-addressed table: most lookups end at the first place
        bits = int(np.ceil(np.log2(len(pairs) * 4)))
        self.mask = np.uint64((1 << bits) - 1)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        keys, values = np.fromiter(pairs.keys(), np.int64), np.fromiter(pairs.values(), np.int32)
        place, self.probes = self._place(keys), 0
        while len(keys):
            self.probes += 1
            free = self.keys[place] < 0
            self.keys[place[free]], self.values[place[free]] = keys[free], values[free]
            left = self.keys[place] != keys
            keys, values = keys[left], values[left]
            place = (place[left] + 1) & int(self.mask)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (c.mix(keys.astype(np.uint64)) & self.mask).astype(np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols; -1 where they do not merge or one is missing (-1)."""
        keys = a.astype(np.int64) * self.width + b
        place = self._place(keys)
        out = np.where(self.keys[place] == keys, self.values[place], -1)
        open_ = np.flatnonzero((self.keys[place] != keys) & (self.keys[place] >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            place[open_] = (place[open_] + 1) & int(self.mask)
            got = self.keys[place[open_]]
            same = got == keys[open_]
            out[open_[same]] = self.values[place[open_[same]]]
            open_ = open_[~same & (got >= 0)]
        return np.where((a < 0) | (b < 0), -1, out)

    def encode_one(self, piece: bytes) -> list[int]:
        """One piece, one merge at a time: lowest rank first, leftmost of equals."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        parts = [piece[i : i + 1] for i in range(len(piece))]
        right, left = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        rank = self.ranks.get
        heap = [(r, i) for i in range(len(parts) - 1) if (r := rank(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        n = len(parts)
        while heap:
            r, i = heapq.heappop(heap)
            j = right[i]
            if parts[i] is None or j >= n or rank(parts[i] + parts[j]) != r:
                continue
            parts[i], parts[j] = parts[i] + parts[j], None
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
                if (q := rank(parts[i] + parts[right[i]])) is not None:
                    heapq.heappush(heap, (q, i))
            if left[i] >= 0 and (q := rank(parts[left[i]] + parts[i])) is not None:
                heapq.heappush(heap, (q, left[i]))
        return [rank(p) for p in parts if p is not None]

    def replay(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, and how many each has."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(size)
        n = int(ends[-1]) if len(ends) else 0
        sym = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        right, left = np.arange(1, n + 1), np.arange(-1, n - 1)
        right[ends - 1] = -1
        left[ends - size] = -1
        whole = np.fromiter((self.ranks.get(p, -1) for p in pieces), np.int64, len(pieces))
        known = whole >= 0  # a piece that is a token needs no merge
        current = np.full(n + 1, -1, np.int32)  # the rank of the pair that starts here; the last place stands for none
        redo: list[np.ndarray] = []

        def enter(at: np.ndarray, least: int) -> None:
            """Looks the pairs at these positions up and puts them into the index."""
            nxt = right[at]
            r = self.pair_ranks(sym[at], np.where(nxt >= 0, sym[nxt], -1))
            current[at] = r
            at, r = at[r >= 0], r[r >= 0]
            if not len(at):
                return
            if least >= 0 and r.min() < least:
                redo.append(at[r < least])
            if len(at) < 24:
                for p, q in zip(at.tolist(), r.tolist(), strict=True):
                    if (have := index.get(q)) is None:
                        index[q] = [p]
                        heapq.heappush(queue, q)
                    else:
                        have.append(p)
                return
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cut = np.flatnonzero(np.diff(r)) + 1
            for group, q in zip(np.split(at, cut), r[np.concatenate([[0], cut])].tolist(), strict=True):
                if (have := index.get(q)) is None:
                    index[q] = [group]
                    heapq.heappush(queue, q)
                else:
                    have.append(group)

        index: dict[int, list] = {}
        queue: list[int] = []
        start = np.repeat(~known, size)
        enter(np.flatnonzero(start & (right >= 0)), -1)
        while queue:
            rank = heapq.heappop(queue)
            have = index.pop(rank)
            at = np.unique(np.concatenate([x if isinstance(x, np.ndarray) else [x] for x in have]).astype(np.int64))
            at = at[current[at] == rank]
            if not len(at):
                continue
            if len(at) > 1:
                nxt = right[at]
                clash = np.flatnonzero(nxt[:-1] == at[1:])
                if len(clash):  # a run of one symbol: pairs from its left end
                    drop, gone = set(), at.tolist()
                    for i in clash.tolist():
                        if i not in drop:
                            drop.add(i + 1)
                    at = np.array([p for i, p in enumerate(gone) if i not in drop], np.int64)
            other = right[at]
            after = right[other]
            sym[at] = rank
            sym[other] = -1
            current[other] = -1
            right[at] = after
            has = after >= 0
            left[after[has]] = at[has]
            before = left[at]
            before = before[before >= 0]
            enter(np.concatenate([before, at]) if len(before) else at, rank)
        counts = np.add.reduceat(sym >= 0, ends - size) if n else np.zeros(0, np.int64)
        counts = np.where(known, 1, counts)
        keep = sym >= 0
        keep &= start
        heads = (ends - size)[known]
        keep[heads] = True
        sym[heads] = whole[known]
        if redo:
            bad = np.unique(np.searchsorted(ends, np.concatenate(redo), side="right"))
            ids = np.split(sym[keep], np.cumsum(counts)[:-1])
            for i in bad.tolist():
                ids[i] = np.array(self.encode_one(pieces[i]), np.int64)
            return np.concatenate(ids), np.fromiter(map(len, ids), np.int64, len(ids))
        return sym[keep], counts

    def forget(self) -> None:
        """Starts the corpus anew: distinct chunks and pieces, and the ids of each."""
        self.codes, self.pieces = defaultdict(count().__next__), defaultdict(count().__next__)  # each new key gets the next number
        self.chunk_ids = self.piece_ids = np.zeros(0, np.int32)
        self.chunk_n = self.piece_n = np.zeros(0, np.int64)

    def learn(self, old_chunks: int, old_pieces: int) -> None:
        """Cuts the new chunks into pieces, replays the merges over the new pieces, and puts the chunks together."""
        cut, sizes = [], []
        for own in map(self.pattern.findall, islice(self.codes, old_chunks, None)):
            sizes.append(len(own))
            cut.extend(map(self.pieces.__getitem__, own))
        if not cut:
            return
        new = [p.encode("utf-8", "surrogatepass") for p in islice(self.pieces, old_pieces, None)]
        if new:
            ids, n = self.replay(new)
            self.piece_ids, self.piece_n = np.concatenate([self.piece_ids, ids.astype(np.int32)]), np.concatenate([self.piece_n, n])
        cut, first = np.array(cut, np.int64), np.cumsum(self.piece_n) - self.piece_n
        n = self.piece_n[cut]
        self.chunk_ids = np.concatenate([self.chunk_ids, self.piece_ids[c.ranges(first[cut], n)]])
        edges, ends = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(sizes)])
        self.chunk_n = np.concatenate([self.chunk_n, edges[ends[1:]] - edges[ends[:-1]]])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. What was learned from earlier texts stays, up to CORPUS_CHUNKS."""
        if len(self.codes) > CORPUS_CHUNKS:
            self.forget()
        old, old_pieces, parts = len(self.codes), len(self.pieces), []
        for t in texts:
            own = CHUNKS.findall(t)
            parts.append(np.fromiter(map(self.codes.__getitem__, own), np.int64, len(own)))
        self.learn(old, old_pieces)
        first = np.cumsum(self.chunk_n) - self.chunk_n
        return [self.chunk_ids[c.ranges(first[own], self.chunk_n[own])] for own in parts]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


_LOADED: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(path: str, pattern: str) -> Vocabulary:
    """The worker's own copy; the file is on every node, as the libraries need it to be."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Vocabulary(path, pattern)
    return _LOADED[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids array<int>: the token ids of every whole text."""
    schema = c.out_schema(docs, doc_id, ("ids", T.ArrayType(T.IntegerType())))

    def run(batches):
        v = vocabulary(path, pattern)
        for batch, data, offs in c.text_slices(batches, CORPUS_BYTES):
            texts = [data[a:b].tobytes().decode("utf-8", "surrogatepass") for a, b in zip(offs[:-1], offs[1:], strict=True)]
            found = v.encode(texts)
            counts = np.fromiter(map(len, found), np.int64, len(found))
            # few MB at a time go back to Spark
            for a, b in c.slices(np.concatenate([[0], np.cumsum(counts * 4)])):
                flat = np.concatenate(found[a:b]) if b > a else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("_id").slice(a, b - a), c.list_array(pa.array(flat.astype(np.int32)), counts[a:b])], names=schema.names)
        v.forget()

    return c.id_and_text(docs, doc_id, text).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id, bytes: what the ids stand for. Null ids give null; an id without a token is an error."""
    schema = c.out_schema(encoded, doc_id, ("bytes", T.BinaryType()))

    def run(batches):
        v = vocabulary(path, pattern)
        for batch in batches:
            column = batch.column(1)
            out = [None if not x.is_valid else v.decode(x.values.to_numpy(zero_copy_only=False)) for x in column]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=schema.names)

    return encoded.select(doc_id, ids).mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes and decodes in one step: doc_id, n_tokens, ids_sha256, decoded_sha256, decoded_ok."""
    schema = c.out_schema(docs, doc_id, ("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType()), ("decoded_ok", T.BooleanType()))

    def run(batches):
        v = vocabulary(path, pattern)
        for batch, data, offs in c.text_slices(batches, CORPUS_BYTES):
            raw = [data[a:b].tobytes() for a, b in zip(offs[:-1], offs[1:], strict=True)]
            n, ids_sha, text_sha, ok = [], [], [], []
            for own, ids in zip(raw, v.encode([x.decode("utf-8", "surrogatepass") for x in raw]), strict=True):
                back = v.decode(ids)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(back).hexdigest())
                ok.append(back == own)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string()), pa.array(ok, pa.bool_())], names=schema.names)
        v.forget()  # the worker may go on with other work

    return c.id_and_text(docs, doc_id, text).mapInArrow(run, schema)


def encode_documents(docs: DataFrame, path: str, pattern: str, **how) -> DataFrame:
    """The digest of round_trip under the names a check wants: n_tokens, ids_sha256, decoded_sha256."""
    return round_trip(docs, path, pattern, **how).select(how.get("doc_id", "doc_id"), "n_tokens", "ids_sha256", "decoded_sha256", F.col("decoded_ok"))
