"""Encoding of a corpus with a public byte-level BPE, by a pair occurrence index.

The texts of a partition are cut into pieces by the tokenizer's pattern, and each distinct piece is
encoded once: every adjacent pair that has a merge rank is indexed under that rank with all its
positions; ranks are then applied in ascending order (a heap holds the active ones), each at all of
its positions, and only the lists of the pairs next to a merge are updated. A merge can only create
pairs of a higher rank, which loading checks, so each rank is applied once.

Defined results: a null and an empty text give the empty list; strings of special tokens are ordinary text;
texts are never shortened. Work goes in slices of about ``SLICE_CHARS`` characters, so memory follows the slice
(or one text, if longer), not the partition.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the public tokenizer: its splitting pattern and where its file is kept by default.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BYTE_BPE_50K = "/opt/tokenizers/byte_bpe_50k.json"
SLICE_CHARS = 2_000_000
CACHE_PIECES = 300_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable Latin-1 bytes for
    themselves, all others for the letters from U+0100 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    letters, spare = [], 0x100
    for b in range(256):
        if b in plain:
            letters.append(chr(b))
        else:
            letters.append(chr(spare))
            spare += 1
    return letters


class ByteBpe:
    """Vocabulary and merges of a byte-level BPE file, and the encoder over distinct pieces."""

    def __init__(self, content: str):
        model = json.loads(content)["model"]
        vocab = model["vocab"]
        letters = byte_letters()
        self.byte_ids = np.array([vocab[c] for c in letters], np.int64)
        self.left, self.right, self.made = [], [], []
        self.rank: dict[int, int] = {}
        born: dict[int, int] = {}
        for r, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            if born.get(x, -1) >= r or born.get(y, -1) >= r:
                raise ValueError(f"merge {r} uses a token of a later merge")
            born.setdefault(z, r)
            self.left.append(x)
            self.right.append(y)
            self.made.append(z)
            self.rank[x << 20 | y] = r
        # ranks of pairs of single bytes, for building the index at once
        self.byte_rank = np.full(65536, -1, np.int64)
        code = {int(t): b for b, t in enumerate(self.byte_ids)}
        for key, r in self.rank.items():
            if (a := code.get(key >> 20)) is not None and (b := code.get(key & 0xFFFFF)) is not None:
                self.byte_rank[a << 8 | b] = r
        back = {c: b for b, c in enumerate(letters)}
        self.bytes_of = {i: bytes(back[c] for c in t) for t, i in vocab.items() if all(c in back for c in t)}
        self.pattern = regex.compile(PATTERN)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool: list[np.ndarray] = [np.zeros(0, np.int32)]
        self.sizes: list[int] = []

    # -------------------------------------------------------------- pieces

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in one flat array, and the number of ids of each."""
        raw = [p.encode() for p in pieces]
        sizes = np.array([len(b) for b in raw], np.int64)
        text = np.frombuffer(b"".join(raw), np.uint8)
        n = len(text)
        if not n:
            return np.zeros(0, np.int32), sizes
        ends = np.cumsum(sizes)
        starts = ends - sizes
        last = np.zeros(n, bool)
        last[ends[sizes > 0] - 1] = True
        first = np.zeros(n, bool)
        first[starts[sizes > 0]] = True
        pair_rank = np.full(n, -1, np.int64)
        pair_rank[:-1] = self.byte_rank[text[:-1].astype(np.int64) << 8 | text[1:]]
        pair_rank[last] = -1

        # the pair occurrence index: rank -> positions of the pair's left symbol
        at = np.flatnonzero(pair_rank >= 0)
        by_rank = at[np.argsort(pair_rank[at], kind="stable")]
        cuts = np.flatnonzero(np.diff(pair_rank[by_rank])) + 1
        index = {int(pair_rank[g[0]]): g.tolist() for g in np.split(by_rank, cuts)} if len(at) else {}

        symbol = self.byte_ids[text].tolist()
        following = np.where(last, -1, np.arange(1, n + 1)).tolist()
        before = np.where(first, -1, np.arange(-1, n - 1)).tolist()
        rank, left, right, made = self.rank, self.left, self.right, self.made
        active = list(index)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            positions, x, y, z = index.pop(r), left[r], right[r], made[r]
            if x == y:
                positions.sort()  # overlapping pairs are merged from the left
            for p in positions:
                if symbol[p] != x:
                    continue
                q = following[p]
                if q < 0 or symbol[q] != y:
                    continue
                symbol[p], symbol[q] = z, -1
                after, prior = following[q], before[p]
                following[p] = after
                if after >= 0:
                    before[after] = p
                    s = rank.get(z << 20 | symbol[after])
                    if s is not None:
                        if s in index:
                            index[s].append(p)
                        else:
                            index[s] = [p]
                            heapq.heappush(active, s)
                if prior >= 0:
                    s = rank.get(symbol[prior] << 20 | z)
                    if s is not None:
                        if s in index:
                            index[s].append(prior)
                        else:
                            index[s] = [prior]
                            heapq.heappush(active, s)
        flat = np.array(symbol, np.int64)
        alive = flat >= 0
        kept = np.concatenate([[0], np.cumsum(alive)])
        return flat[alive].astype(np.int32), kept[ends] - kept[starts]

    # -------------------------------------------------------------- texts

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one flat array, and the number of ids of each text."""
        if len(self.known) > CACHE_PIECES:
            self._forget()
        known, findall = self.known, self.pattern.findall
        order: list[int] = []
        counts = np.zeros(len(texts), np.int64)
        fresh: list[str] = []
        for i, text in enumerate(texts):
            if not text:
                continue
            pieces = findall(text)
            counts[i] = len(pieces)
            for piece in pieces:
                k = known.get(piece)
                if k is None:
                    k = known[piece] = len(known)
                    fresh.append(piece)
                order.append(k)
        if fresh:
            ids, sizes = self.encode_pieces(fresh)
            self.pool = [np.concatenate([*self.pool, ids])]
            self.sizes.extend(sizes.tolist())
        pool, sizes = self.pool[0], np.array(self.sizes, np.int64)
        starts = np.cumsum(sizes) - sizes
        chosen = np.array(order, np.int64)
        length = sizes[chosen] if len(chosen) else np.zeros(0, np.int64)
        total = np.cumsum(length)
        nth = np.arange(total[-1] if len(total) else 0) - np.repeat(total - length, length)
        flat = pool[np.repeat(starts[chosen] if len(chosen) else length, length) + nth]
        piece_edges = np.concatenate([[0], total])
        text_edges = np.concatenate([[0], np.cumsum(counts)])
        edges = piece_edges[text_edges]
        return flat, np.diff(edges)

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "replace")


_LOADED: dict[int, ByteBpe] = {}


def _shared(content) -> ByteBpe:
    """The encoder of a broadcast vocabulary file, built once per Python worker."""
    key = hash(content.value)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = ByteBpe(content.value)
    return _LOADED[key]


def slices(texts: list[str | None], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``limit`` characters each; a longer text is a range of its own."""
    begin = held = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if held and held + n > limit:
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(texts):
        yield begin, len(texts)


def _vocabulary(df: DataFrame, path: str):
    """The vocabulary file (one file of fixed size, below 2 MB) for all executors."""
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode_corpus(df: DataFrame, key: str, text: str, path: str = BYTE_BPE_50K) -> DataFrame:
    """(key, ids): token ids of every text. One pass over the two columns, no shuffle."""
    content, kind = _vocabulary(df, path), df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _shared(content)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in slices(texts):
                flat, sizes = bpe.encode(texts[a:b])
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), lists], names=["key", "ids"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def token_counts(df: DataFrame, key: str, text: str, path: str = BYTE_BPE_50K) -> DataFrame:
    """(key, n_tokens) of every text, without moving the ids."""
    content, kind = _vocabulary(df, path), df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _shared(content)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sizes = [bpe.encode(texts[a:b])[1] for a, b in slices(texts)]
            counts = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["key", "n_tokens"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n_tokens bigint").withColumnRenamed("key", key)
