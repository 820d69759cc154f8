"""Problem 8: token ids of every document by a public byte-level BPE tokenizer.

Pre-tokens are merged with a hierarchical-bitmap rank queue: one bucket per merge rank holds the linked-list positions
whose pair has that rank, a two-level bitmap over the ranks gives the lowest one by find-first-set, and entries that a
merge made stale are skipped when they come up. A pre-token of n bytes costs O(n log n) however long it is.

Results of whitespace-delimited pieces are kept in a bounded cache of the worker, since words repeat.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Unicode White_Space.
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A space goes with the word after it; a run of white space before a word leaves its last character to stand alone or go with the word.
_PIECE = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: At most so many pieces are cached in a worker, each of at most so many characters.
CACHE_PIECES, CACHE_CHARS = 400_000, 64
#: Documents whose ids are handed back to the JVM at a time.
SLICE = 500


def default_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class RankQueue:
    """Positions queued by merge rank. ``pop`` gives the leftmost position of the lowest rank."""

    def __init__(self) -> None:
        self.top = 0
        self.words: dict[int, int] = {}
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [position]
            high = rank >> 8
            self.words[high] = self.words.get(high, 0) | 1 << (rank & 255)
            self.top |= 1 << high
        else:
            heappush(bucket, position)

    def pop(self) -> tuple[int, int] | None:
        if not self.top:
            return None
        high = (self.top & -self.top).bit_length() - 1
        word = self.words[high]
        rank = high << 8 | ((word & -word).bit_length() - 1)
        bucket = self.buckets[rank]
        position = heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            word &= word - 1
            self.words[high] = word
            if not word:
                self.top &= self.top - 1
        return rank, position


class Encoder:
    """Byte-level BPE over a rank file (token in base64 and rank on each line)."""

    def __init__(self, path: str, pattern: str | None = None):
        import regex

        if pattern is None:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.pattern = regex.compile(pattern)
        self.cache: dict[str, bytes] = {}

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks = self.ranks
        whole = ranks.get(raw)
        if whole is not None:
            return [whole]
        n = len(raw)
        end = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        queue = RankQueue()
        waiting = [-1] * n  # rank under which the pair that begins here is queued; another rank in the queue is stale
        for i in range(n - 1):
            rank = ranks.get(raw[i : i + 2])
            if rank is not None:
                waiting[i] = rank
                queue.push(rank, i)
        while (got := queue.pop()) is not None:
            rank, i = got
            if waiting[i] != rank:
                continue
            j = end[i]
            end[i] = end[j]
            waiting[i] = waiting[j] = -1
            if end[i] < n:
                before[end[i]] = i
                right = ranks.get(raw[i : end[end[i]]])
                if right is not None:
                    waiting[i] = right
                    queue.push(right, i)
            k = before[i]
            if k >= 0:
                left = ranks.get(raw[k : end[i]])
                if left != waiting[k]:
                    waiting[k] = -1 if left is None else left
                    if left is not None:
                        queue.push(left, k)
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : end[i]]])
            i = end[i]
        return out

    def _fresh(self, piece: str) -> bytes:
        ids = array("i")
        for token in self.pattern.findall(piece):
            ids.extend(self.merge(token.encode("utf-8", "surrogatepass")))
        packed = ids.tobytes()
        if len(piece) <= CACHE_CHARS:
            if len(self.cache) >= CACHE_PIECES:
                self.cache.clear()
            self.cache[piece] = packed
        return packed

    def encode_packed(self, text: str) -> bytes:
        """Ids of a text as 32-bit integers in native byte order."""
        get = self.cache.get
        return b"".join([get(p) or self._fresh(p) for p in _PIECE.findall(text)])

    def encode(self, text: str | None) -> list[int]:
        return list(array("i", self.encode_packed(text))) if text else []


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a rank file; read once a process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def token_ids(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids array<int>): one row per input row; an empty or null text has an empty list. No shuffle, one pass.

    Other columns are ignored, repeated rows stay repeated. No special tokens are made: their strings are ordinary text.
    """
    path = path or default_path()
    schema = docs.select(key, F.array(F.lit(0)).alias("ids")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, len(b), SLICE)):
            packed = [enc.encode_packed(t) if t else b"" for t in batch.column(1).to_pylist()]
            ends = [0]
            for p in packed:
                ends.append(ends[-1] + len(p) // 4)
            values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(packed))])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], [key, "ids"])

    return docs.select(key, text).mapInArrow(run, schema)


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """The columns of ``docs`` other than the text, and n_tokens (0 for an empty or null text). No shuffle."""
    path = path or default_path()
    rest = [c for c in docs.columns if c != text]
    schema = docs.select(*rest, F.lit(0).cast("long").alias("n_tokens")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            n = pa.array([len(enc.encode_packed(t)) // 4 if t else 0 for t in batch.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], n], [*rest, "n_tokens"])

    return docs.select(text, *rest).mapInArrow(run, schema)
