"""Byte-level BPE with a public rank file: encoding and decoding.

Two tiers. A pre-token that is in the vocabulary is found by a minimal perfect hash: its bucket
has a displacement under which every token of the vocabulary has a place of its own, and one
comparison of bytes tells a member from a stranger. Strangers are merged from their bytes: a
linked list of parts and a heap of the ranks of neighbours, lowest rank and leftmost first.

Texts are cut where pre-tokens can't span; what a piece gives is kept per worker process, in
tables of bounded size. Decoding joins the tokens' bytes by id.

Defined results: a null or empty text has no tokens; the hashes are those of no bytes. Rows are
independent of each other, so repeated rows and ids change nothing; whole texts are coded.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from ledgerframe.llm.common import Recent, byte_batches, column_of, texts
from ledgerframe.llm.packing import pieces_of

KEPT, KEPT_CHARS = 300_000, 48


def _hashes(token: bytes) -> tuple[int, int, int]:
    h = xxhash.xxh3_64_intdigest(token)
    return h & 0xFFFFFF, (h >> 24) & 0xFFFFFFF, (h >> 44) | 1


class PerfectHash:
    """Place of a token in a list, by a minimal perfect hash of hashed and displaced buckets.

    Large buckets look for a displacement first; a bucket of one token stores a free place
    itself, as a negative number.
    """

    def __init__(self, tokens: list[bytes]):
        self.tokens, self.n = tokens, len(tokens)
        self.buckets = max(1, self.n // 2)
        self.moves = [0] * self.buckets
        self.places = [-1] * self.n
        members: dict[int, list[int]] = {}
        for i, token in enumerate(tokens):
            members.setdefault(_hashes(token)[0] % self.buckets, []).append(i)
        order = sorted(members, key=lambda b: -len(members[b]))
        free = None
        for bucket in order:
            own = members[bucket]
            if len(own) > 1:
                self.moves[bucket], at = self._displaced(own)
            else:
                free = free or iter([a for a, taken in enumerate(self.places) if taken < 0])
                at = [next(free)]
                self.moves[bucket] = -1 - at[0]
            for i, place in zip(own, at, strict=True):
                self.places[place] = i

    def _displaced(self, own: list[int]) -> tuple[int, list[int]]:
        pairs = [_hashes(self.tokens[i])[1:] for i in own]
        for move in range(1 << 22):
            at = [(first + move * step) % self.n for first, step in pairs]
            if len(set(at)) == len(at) and all(self.places[a] < 0 for a in at):
                return move, at
        raise ValueError("no displacement found: two tokens are equal")

    def index(self, token: bytes) -> int:
        """The token's place in the list, or -1."""
        bucket, first, step = _hashes(token)
        move = self.moves[bucket % self.buckets]
        found = self.places[-1 - move if move < 0 else (first + move * step) % self.n]
        return found if self.tokens[found] == token else -1


def merged(token: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ranks of the parts of a pre-token after all merges, lowest rank and leftmost first."""
    n = len(token)
    after = list(range(1, n + 1))  # where the part that starts here ends; 0: merged away
    before = list(range(-1, n))  # where the part in front starts
    rank = ranks.get
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(token[i : i + 2])) is not None]
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        _, i, end = pop(heap)
        j = after[i]
        if not i < j < end or after[j] != end:
            continue  # one of the two has changed since
        after[i], after[j] = end, 0
        if end < n:
            before[end] = i
            last = after[end]
            if (r := rank(token[i:last])) is not None:
                push(heap, (r, i, last))
        if i and (r := rank(token[before[i] : end])) is not None:
            push(heap, (r, before[i], end))
    found, i = [], 0
    while i < n:
        found.append(ranks[token[i : after[i]]])
        i = after[i]
    return found


class Codec:
    """Encoder and decoder for one rank file and pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            pairs = [line.split() for line in file if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        listed = list(self.ranks)
        self.whole = PerfectHash(listed)
        self.rank_at = [self.ranks[token] for token in listed]
        self.pattern = regex.compile(pattern)
        self.known = Recent(KEPT, KEPT_CHARS)
        size = max(self.ranks.values()) + 1
        by_rank = [b""] * size
        for token, rank in self.ranks.items():
            by_rank[rank] = token
        self.lengths = np.array([len(t) for t in by_rank], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(by_rank), np.uint8)

    def piece(self, text: str) -> bytes:
        """Ranks of a piece of text, packed in four bytes each."""
        found: list[int] = []
        for part in self.pattern.findall(text):
            token = part.encode("utf-8", "replace")
            at = self.whole.index(token)
            if at >= 0:
                found.append(self.rank_at[at])
            else:
                found += merged(token, self.ranks)
        return array("i", found).tobytes()

    def encode(self, rows: list[str]) -> list[bytes]:
        """Packed ranks of each text."""
        cut = [pieces_of(row) for row in rows]
        fresh = self.known.unknown(set().union(*cut))
        self.known.now.update((piece, self.piece(piece)) for piece in fresh)
        found = [b"".join(map(self.known.now.__getitem__, pieces)) for pieces in cut]
        self.known.trim(fresh)
        return found

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and where each id's bytes end."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        at = np.repeat(self.starts[ids] - (ends - lengths), lengths)
        return self.bytes[at + np.arange(len(at))], ends


@cache
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of every text."""

    def encode(batches):
        own = codec(path, pattern)
        for batch in byte_batches(batches):
            rows = own.encode(batch.column(1).to_pylist())
            ends = np.cumsum([0, *(len(r) // 4 for r in rows)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    return texts(docs).mapInArrow(encode, f"{column_of(docs, 'doc_id')}, ids array<int>")


def decoded(coded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids and the bytes that the ids stand for (null ids: no bytes)."""

    def decode(batches):
        own = codec(path, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                ids = part.column(1).fill_null([])
                flat = ids.flatten().to_numpy()
                data, ends = own.decode(flat)
                borders = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(pa.compute.list_value_length(ids).to_numpy(zero_copy_only=False))])]
                text = [data[a:b].tobytes() for a, b in zip(borders[:-1], borders[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.binary())], names=["doc_id", "ids", "bytes"])

    rows = coded.select("doc_id", "ids")
    return rows.mapInArrow(decode, f"{column_of(coded, 'doc_id')}, ids array<int>, bytes binary")
