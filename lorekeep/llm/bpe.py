"""Byte-level BPE encoding and decoding by a file of ranks.

Each match of the pattern is merged on its own. A hierarchical-bitmap rank queue picks the next merge: a bucket for each
merge rank holds the linked-list positions where the pair stands, three levels of 64-bit words tell which buckets are not
empty, find-first-set on each level gives the lowest rank, and entries that no longer describe their position are skipped.
So a pre-token of n bytes takes about n queue steps whatever its length. Short pre-tokens repeat and are remembered.

One narrow Python stage, no shuffle; the ranks are read in each worker from a file that the cluster's nodes have, whose
place is a parameter. The table of remembered pre-tokens is emptied at a fixed size.

Defined cases: null or empty text: no tokens, the digests of nothing; texts of any length; repeated rows and extra columns
don't matter; empty table: empty result.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from . import common

#: Remembered pre-tokens: at most so many, none longer than so many bytes.
MEMO, MEMO_BYTES = 1_000_000, 64
#: Up to so many bytes a bucket is one integer, a bit for each position.
SHORT = 1024
RANKS = "byte_bpe_50k.tiktoken"


class RankQueue:
    """Positions by rank, lowest rank first and leftmost first within a rank."""

    def __init__(self) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.leaves: dict[int, int] = {}
        self.middle: dict[int, int] = {}
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket:
            heapq.heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        leaf, node = rank >> 6, rank >> 12
        self.leaves[leaf] = self.leaves.get(leaf, 0) | 1 << (rank & 63)
        self.middle[node] = self.middle.get(node, 0) | 1 << (leaf & 63)
        self.top |= 1 << node

    def pop(self) -> tuple[int, int] | None:
        if not self.top:
            return None
        node = (self.top & -self.top).bit_length() - 1
        word = self.middle[node]
        leaf = node << 6 | ((word & -word).bit_length() - 1)
        word = self.leaves[leaf]
        rank = leaf << 6 | ((word & -word).bit_length() - 1)
        bucket = self.buckets[rank]
        position = heapq.heappop(bucket)
        if not bucket:
            self.leaves[leaf] &= ~(1 << (rank & 63))
            if not self.leaves[leaf]:
                self.middle[node] &= ~(1 << (leaf & 63))
                if not self.middle[node]:
                    self.top &= ~(1 << node)
        return rank, position


class Codec:
    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.words = {b: a for a, b in self.ranks.items()}
        # The tokenizer's white space is Unicode's White_Space, and so excludes U+001C to U+001F.
        self.find = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.memo: dict[str, bytes] = {}

    def merged(self, piece: bytes) -> list[int]:
        """Token ids of one pre-token."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        return self.merged_short(piece) if len(piece) <= SHORT else self.merged_long(piece)

    def merged_short(self, piece: bytes) -> list[int]:
        """The queue in local integers: `top` and `leaves` are the bitmap's levels of 256 ranks each, a bucket is the bits of its positions."""
        n, ranks = len(piece), self.ranks
        get = ranks.get
        top, leaves, buckets = 0, {}, {}
        ends, before, pair = list(range(1, n + 1)), list(range(-1, n - 1)), [-1] * n
        fresh = [(get(piece[i : i + 2]), i) for i in range(n - 1)]
        while True:
            for rank, i in fresh:
                if rank is None:
                    pair[i] = -1
                    continue
                pair[i] = rank
                if rank in buckets:
                    buckets[rank] |= 1 << i
                else:
                    buckets[rank] = 1 << i
                    node = rank >> 8
                    leaves[node] = leaves.get(node, 0) | 1 << (rank & 255)
                    top |= 1 << node
            while top:
                node = (top & -top).bit_length() - 1
                word = leaves[node]
                rank = node << 8 | ((word & -word).bit_length() - 1)
                bucket = buckets[rank]
                i = (bucket & -bucket).bit_length() - 1
                bucket &= bucket - 1
                if bucket:
                    buckets[rank] = bucket
                else:
                    del buckets[rank]
                    word &= word - 1
                    leaves[node] = word
                    if not word:
                        top &= top - 1
                if pair[i] == rank:
                    break
            else:
                break
            gone = ends[i]
            end = ends[i] = ends[gone]
            pair[i] = pair[gone] = -1
            fresh = []
            if end < n:
                before[end] = i
                fresh.append((get(piece[i : ends[end]]), i))
            j = before[i]
            if j >= 0:
                fresh.append((get(piece[j:end]), j))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : ends[i]]])
            i = ends[i]
        return out

    def merged_long(self, piece: bytes) -> list[int]:
        n, get, queue = len(piece), self.ranks.get, RankQueue()
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [-1] * n  # the rank of the pair that begins here and was pushed last
        for i in range(n - 1):
            if (rank := get(piece[i : i + 2])) is not None:
                pair[i] = rank
                queue.push(rank, i)
        while (entry := queue.pop()) is not None:
            rank, i = entry
            if pair[i] != rank:
                continue
            gone = ends[i]
            ends[i], pair[i], pair[gone] = ends[gone], -1, -1
            ends[gone] = -1
            if ends[i] < n:
                before[ends[i]] = i
                if (rank := get(piece[i : ends[ends[i]]])) is not None:
                    pair[i] = rank
                    queue.push(rank, i)
            if (j := before[i]) >= 0:
                rank = get(piece[j : ends[i]])
                pair[j] = -1 if rank is None else rank
                if rank is not None:
                    queue.push(rank, j)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : ends[i]]])
            i = ends[i]
        return out

    def packed(self, piece: str) -> bytes:
        data = piece.encode()
        ids = np.array(self.merged(data), "<u4").tobytes()
        if len(data) <= MEMO_BYTES:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        get, packed = self.memo.get, self.packed
        return b"".join([get(x) or packed(x) for x in self.find(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.words.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(maxsize=2)
def codec_of(path: str) -> Codec:
    """One for each worker process, so that its tasks share what is remembered."""
    return Codec(path)


def tokenized(docs: DataFrame, path: str, keep_ids: bool = True, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if keep_ids, ids (binary, 4 bytes each) and decoded (the text made from the ids)."""
    common.bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        for batch in batches:
            rows = []
            for doc in batch.column(1).to_pylist():
                ids = codec.encode(doc or "")
                back = codec.decode(ids)
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest(), ids, back))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            out = {
                "doc_id": batch.column(0),
                "n_tokens": pa.array(columns[0], pa.int64()),
                "ids_sha256": pa.array(columns[1], pa.string()),
                "decoded_sha256": pa.array(columns[2], pa.string()),
            }
            if keep_ids:
                out |= {"ids": pa.array(columns[3], pa.binary()), "decoded": pa.array(columns[4], pa.binary()).cast(pa.string())}
            yield pa.RecordBatch.from_pydict(out)

    made = docs.select(id_column, text)
    kind = made.schema[0].dataType.simpleString()
    return made.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * keep_ids)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenized(common.table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), keep_ids=False)
