"""Token counts at every prefix, by dynamic programming over byte-level BPE.

For a piece of text (one match of the splitting pattern) the encoding of a prefix ends
in exactly one token. That token is the one suffix of the prefix that is a token and
may follow the last token of the prefix before it; two tokens may stand side by side if
their joined bytes encode to just these two. So one pass over a piece gives the last
token and the count of every prefix. Budget and truncation questions are then answered
from the counts, without encoding again.

Scale: no shuffle; counts of a piece are computed once per worker (bounded memory).
Defined results: null counts as empty, with 0 tokens; strings of special tokens inside a
text are single tokens where the tokenizer file says so, as its library does by default.
"""

from __future__ import annotations

import json
from collections import defaultdict
from itertools import count, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as c
from .bpe import CHUNKS, CORPUS_BYTES, piece_pattern

#: Distinct pieces and pairs a worker remembers; then it starts anew, which changes no result.
REMEMBERED = 600_000


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabulary files: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """The vocabulary and merges of a tokenizers file of kind byte-level BPE."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        level, model = spec["pre_tokenizer"], spec["model"]
        if level["type"] != "ByteLevel" or level.get("add_prefix_space") or spec.get("normalizer") or model["type"] != "BPE" or model.get("ignore_merges"):
            raise ValueError(f"{path}: not plain byte-level BPE")
        letters = byte_letters()
        raw = lambda s: bytes(letters[x] for x in s)
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        # tokens that merges can make; others of the file never occur
        self.tokens = {bytes([b]) for b in range(256)} | {a + b for a, b in self.merges}
        # of each suffix of a token: its own number as a token, or 0
        self.names = [b"", *self.tokens]
        number = {t: i for i, t in enumerate(self.names)}
        self.suffixes = {t[i:]: number.get(t[i:], 0) for t in self.tokens for i in range(len(t))}
        special = [regex.escape(x["content"]) for x in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(sorted(special, key=len, reverse=True))) if special else None
        self.pattern = piece_pattern(pattern)
        self.beside: dict[int, bool] = {}
        self.forget()

    def forget(self) -> None:
        self.codes, self.chunk_n, self.chunk_bytes, self.chunks = defaultdict(count().__next__), np.zeros(0, np.int64), np.zeros(0, np.int64), []
        self.pieces: dict[str, int] = {}
        if len(self.beside) > REMEMBERED:
            self.beside.clear()

    def encode(self, piece: bytes) -> list[bytes]:
        """Tokens by merging the first of the merges that applies, leftmost, again and again."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, i = min(((self.merges.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:], strict=False))), default=(1 << 60, 0))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def may_follow(self, pair: int) -> bool:
        """Whether the pair's second token may stand after its first, or at a piece's start if that is empty."""
        a, b = (self.names[x] for x in divmod(pair, len(self.names)))
        got = self.beside[pair] = self.encode(a + b) == ([a, b] if a else [b])
        return got

    def extend(self, piece: bytes, last: list[int], counts: list[int]) -> None:
        """Continues the program from the prefix that last and counts (with an entry for the empty one) have, to the whole piece."""
        suffix, beside, width = self.suffixes.get, self.beside.get, len(self.names)
        for i in range(len(last), len(piece) + 1):
            found = []
            j = i - 1
            while j >= 0 and (token := suffix(piece[j:i])) is not None:
                if token:
                    found.append((j, token))
                j -= 1
            while found:  # the longest is most often the one
                j, token = found.pop()
                pair = last[j] * width + token
                ok = beside(pair)
                if ok or ok is None and self.may_follow(pair):
                    last.append(token)
                    counts.append(counts[j] + 1)
                    break
            else:
                raise ValueError("no token ends this prefix")

    def prefix_counts(self, piece: bytes) -> list[int]:
        """Tokens of piece[:1], piece[:2], ..."""
        last, counts = [0], [0]
        self.extend(piece, last, counts)
        return counts[1:]

    def learn(self, pieces: list[str]) -> None:
        """Counts of new pieces. In sorted order, the entries of a shared prefix serve the next piece too."""
        last, counts, before = [0], [0], b""
        for raw, piece in sorted((p.encode("utf-8", "surrogatepass"), p) for p in pieces):
            same = 0
            for x, y in zip(raw, before, strict=False):
                if x != y:
                    break
                same += 1
            del last[same + 1 :], counts[same + 1 :]
            self.extend(raw, last, counts)
            self.pieces[piece], before = counts[-1], raw

    def parts(self, text: str) -> list[tuple[str, bool]]:
        """The text cut at special tokens; true: a special token."""
        if not self.special or not (hits := [m.span() for m in self.special.finditer(text)]):
            return [(text, False)]
        out, at = [], 0
        for a, b in hits:
            out += [(text[at:a], False), (text[a:b], True)]
            at = b
        return [x for x in [*out, (text[at:], False)] if x[0]]

    def totals(self, texts: list[str], limit: int) -> tuple[list[int], list[int]]:
        """Tokens of each text, and the bytes of its longest prefix that ends with a piece and has at most `limit` tokens."""
        if len(self.codes) > REMEMBERED or len(self.beside) > REMEMBERED:
            self.forget()
        whole, special = [], {}
        old = len(self.codes)
        for i, t in enumerate(texts):
            parts = self.parts(t)
            if len(parts) > 1 or parts[0][1]:
                special[i] = t
                parts = []
            found = [x for part, _ in parts for x in CHUNKS.findall(part)]
            whole.append(np.fromiter(map(self.codes.__getitem__, found), np.int64, len(found)))
        new = list(islice(self.codes, old, None))
        cut = [self.pattern.findall(x) for x in new]
        self.learn(list({p for x in cut for p in x} - self.pieces.keys()))
        self.chunks += new
        self.chunk_n = np.concatenate([self.chunk_n, np.fromiter((sum(map(self.pieces.__getitem__, x)) for x in cut), np.int64, len(cut))])
        self.chunk_bytes = np.concatenate([self.chunk_bytes, np.fromiter((len(x.encode("utf-8", "surrogatepass")) for x in new), np.int64, len(new))])
        total, fit = [], []
        for i, own in enumerate(whole):
            if i in special:  # texts with special tokens: from their index
                counts, ends = self.index(special[i])
                total.append(counts[-1] if counts else 0)
                fit.append(max([0, *(e for e in ends if counts[e - 1] <= limit)]))
                continue
            upto = np.cumsum(self.chunk_n[own])
            k = int(np.searchsorted(upto, limit, side="right"))
            total.append(int(upto[-1]) if len(own) else 0)
            at, left = int(self.chunk_bytes[own[:k]].sum()), limit - (int(upto[k - 1]) if k else 0)
            if k < len(own):
                for piece in self.pattern.findall(self.chunks[own[k]]):
                    left -= self.pieces[piece]
                    if left < 0:
                        break
                    at += len(piece.encode("utf-8", "surrogatepass"))
            fit.append(at)
        return total, fit

    def index(self, text: str) -> tuple[list[int], list[int]]:
        """Token count at the end of every byte prefix, and the byte ends of the text's pieces.

        The count at byte i is that of the pieces before it plus that of the piece's own
        prefix; at a piece end it is the count of the whole text so far.
        """
        counts, ends, done = [], [], 0
        for part, is_special in self.parts(text):
            for piece in [part] if is_special else self.pattern.findall(part):
                raw = piece.encode("utf-8", "surrogatepass")
                own = [1] * len(raw) if is_special else self.prefix_counts(raw)
                counts += [done + x for x in own]
                done = counts[-1]
                ends.append(len(counts))
        return counts, ends


_LOADED: dict[tuple[str, str], PrefixCounter] = {}


def counter(path: str, pattern: str) -> PrefixCounter:
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = PrefixCounter(path, pattern)
    return _LOADED[path, pattern]


def prefix_index(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, counts array<int> (tokens at every byte prefix), piece_ends array<int>."""
    ints = T.ArrayType(T.IntegerType())
    schema = c.out_schema(docs, doc_id, ("counts", ints), ("piece_ends", ints))

    def run(batches):
        v = counter(path, pattern)
        for batch, data, offs in c.text_slices(batches):
            if len(v.beside) > REMEMBERED:
                v.forget()
            got = [v.index(data[a:b].tobytes().decode("utf-8", "surrogatepass")) for a, b in zip(offs[:-1], offs[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *(pa.array([x[k] for x in got], pa.list_(pa.int32())) for k in (0, 1))], names=schema.names)

    return c.id_and_text(docs, doc_id, text).mapInArrow(run, schema)


def fit_budget(index: DataFrame, budget: int, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fit_bytes: the longest prefix, cut at a piece end, of at most budget tokens. Reads the index only."""
    at = F.filter("piece_ends", lambda e: F.element_at("counts", e) <= budget)
    return index.select(doc_id, F.coalesce(F.array_max(at), F.lit(0)).alias("fit_bytes"))


def token_counts(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens (the last of the prefix counts of the whole text), over_limit, fit_bytes (the longest prefix within the limit that ends with a piece)."""
    schema = T.StructType([T.StructField("_id", docs.schema[doc_id].dataType), *(T.StructField(x, T.LongType()) for x in ("n_bytes", "n_tokens", "fit_bytes"))])

    def run(batches):
        v = counter(path, pattern)
        for batch, data, offs in c.text_slices(batches, CORPUS_BYTES):
            n, fit = v.totals([data[a:b].tobytes().decode("utf-8", "surrogatepass") for a, b in zip(offs[:-1], offs[1:], strict=True)], limit)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(np.diff(offs)), pa.array(n, pa.int64()), pa.array(fit, pa.int64())], names=schema.names)

    out = c.id_and_text(docs, doc_id, text).mapInArrow(run, schema)
    return out.select(F.col("_id").alias(doc_id), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "fit_bytes")
