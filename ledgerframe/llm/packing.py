"""Packing of tokenised documents into sequences of a fixed length.

Documents are dealt into random groups by a hash, as many groups as keep them at about
``GROUP_DOCS`` documents and ``GROUP_BYTES`` of text, and every group is packed on its own. Whole lengths are cut off a
document first; its rest is placed by first-fit decreasing, where a tournament tree of free
capacities finds the first sequence that has room. Then the rests in the emptiest sequences
are cut to fill the gaps of the others, so that a group pads less than one sequence.

Defined results: a null or empty text is the end id alone. Rows are packed one by one, so a
repeated row is packed as often as it occurs, and equal rows are dealt over all groups. Columns
other than doc_id and text are ignored, whatever their names. An empty table gives an empty result. A text
longer than a sequence spans several; no id is dropped.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerframe.llm.common import Recent, byte_batches, column_of, keyed, release, text_bytes
from ledgerframe.llm.token_counts import CALL_CHARS, KEPT, KEPT_CHARS, encoded_in_calls, id_type, separator, tokenizer

LENGTH = 2048
GROUP_DOCS = 512
#: Bytes of text that a group holds about, and that are encoded at once.
GROUP_BYTES = 4 << 20
BATCH_BYTES = 3 << 19


#: Texts with any of these are cut with more care: runs of blanks are matched as one. They are
#: the blanks besides blank and line end, the mark used for cutting, and blanks next to each other.
UNEVEN = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"] + ["\0", "  ", "\n\n", " \n", "\n "]
BEFORE_BLANK = re.compile(r"(?<=\S)(?= )")


def pieces_of(text: str) -> list[str]:
    """Cuts where no token of a byte-level vocabulary with GPT-style pre-tokens can span.

    A blank after a visible character starts a pre-token; so does a lone line end, and what
    follows it.
    """
    if any(mark in text for mark in UNEVEN):
        return BEFORE_BLANK.split(text)
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")


def piece_borders(data: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Where pieces begin in the texts' bytes, ``borders`` included: cuts that no token of a byte-level
    vocabulary with GPT-style pre-tokens can span.

    A blank after a visible character starts a pre-token; so does a lone line end between visible
    characters, and what follows it. A byte counts as visible if it ends no blank of any kind; where
    that is open (characters of three bytes that may be blanks) there is no cut.
    """
    n = len(data)
    # a blank in front and behind, so that places next to the ends have neighbours
    wide = np.full(n + 4, 0x20, np.uint8)
    wide[3 : n + 3] = data
    ascii_blank = (wide <= 0x20) | (wide == 0x7F)
    two = (wide[1:-1] == 0xC2) & (wide[2:] >= 0x80)
    unseen = ascii_blank.copy()
    unseen[2:] |= two & ((wide[2:] == 0x85) | (wide[2:] == 0xA0))
    third = (wide[1:-2] >= 0xE1) & (wide[1:-2] <= 0xE3)
    unseen[3:] |= third
    before = ~unseen[2 : n + 2]
    blank = before & (data == 0x20)
    after = wide[4 : n + 4]
    # what follows a line end may not be a blank, nor begin with a byte that a blank can begin with
    open_ = (after <= 0x20) | (after == 0x7F) | (after == 0xC2) | ((after >= 0xE1) & (after <= 0xE3))
    line = before & (data == 0x0A) & ~open_
    cut = np.zeros(n + 1, bool)
    cut[:-1] = blank | line
    cut[1:] |= line
    cut[borders] = True
    return np.flatnonzero(cut)


@cache
def _known(path: str) -> Recent:
    return Recent(KEPT, KEPT_CHARS)


@cache
def _id_bytes(path: str) -> np.ndarray:
    """How many bytes each id of a byte-level vocabulary stands for: its token has a character for each."""
    sizes = np.zeros(1 + max(tokenizer(path).get_vocab().values()), np.int64)
    for token, number in tokenizer(path).get_vocab().items():
        sizes[number] = len(token)
    return sizes


def _joins(piece: str) -> bool:
    """Whether no token spans a border of the piece between others of its kind: a blank stands behind each."""
    return piece[:1] == " " and ("!" <= piece[-1] <= "~" or piece[-1].isalnum())


def encoded_joined(path: str, pieces: list[str]):
    """(piece, packed ids). Pieces between which every tokenisation cuts go in one text without marks, which the
    library encodes faster; the bytes of the ids tell where each ends. Others go in calls with marks."""
    mark, _ = separator(path)
    plain = bool(mark) and tokenizer(path).normalizer is None
    joined = [p for p in pieces if mark[0] not in p and _joins(p)] if plain else []
    if joined:
        pieces = list(set(pieces).difference(joined))
    yield from encoded_in_calls(path, pieces)
    ends = np.cumsum(np.fromiter(map(len, joined), np.int64, len(joined)))
    cuts = [*np.flatnonzero(np.diff(ends // CALL_CHARS, prepend=0)).tolist(), len(joined)]
    for start, stop in zip([0, *cuts], cuts):
        part = joined[start:stop]
        if not part:
            continue
        text = "".join(part)
        sizes = map(len, part if text.isascii() else map(str.encode, part))
        borders = np.cumsum(np.fromiter(sizes, np.int64, len(part)))
        ids = np.array(tokenizer(path).encode_batch_fast([text], add_special_tokens=False)[0].ids, id_type(path))
        behind = np.cumsum(_id_bytes(path)[ids])
        last = np.searchsorted(behind, borders)
        if behind[-1] != borders[-1] or not np.array_equal(behind[last], borders):
            yield from encoded_in_calls(path, part)
            continue
        packed, width = ids.tobytes(), ids.itemsize
        stops = ((last + 1) * width).tolist()
        for one, begin, end in zip(part, [0, *stops], stops):
            yield one, packed[begin:end]


def encode_batch(path: str, column: pa.Array, end_id: int) -> pa.Array:
    """The ids of each text as the library gives them, and the end id, packed.

    Pieces are cut and told apart in bulk, each distinct one is encoded once, and the ids of all
    pieces are gathered at once.
    """
    kind = id_type(path)
    data, borders = text_bytes(column)
    begins = piece_borders(data, borders)
    offsets = pa.py_buffer(begins.astype(np.int64))
    count = max(len(begins) - 1, 0)
    found = pa.Array.from_buffers(pa.large_string(), count, [None, offsets, pa.py_buffer(data)]).dictionary_encode()
    # numpy makes the strings several times faster than to_pylist does
    pieces = found.dictionary.to_numpy(zero_copy_only=False).tolist()
    known = _known(path)
    fresh = known.unknown(set(pieces))
    known.now.update(encoded_joined(path, fresh))
    packed = [*map(known.now.__getitem__, pieces), np.array([end_id], kind).tobytes()]
    known.trim(fresh)

    sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // kind.itemsize
    ids = np.frombuffer(b"".join(packed), kind)
    # the end id stands behind the last piece of each text
    last = np.searchsorted(begins, borders[1:])
    which = np.insert(found.indices.to_numpy(zero_copy_only=False), last, len(pieces))
    length = sizes[which]
    ends = np.cumsum(length)
    shift = (np.cumsum(sizes) - sizes)[which] - (ends - length)
    gathered = ids[np.repeat(shift, length) + np.arange(ends[-1] if len(ends) else 0)]
    borders_out = np.append(0, ends[last + np.arange(len(last))]) * kind.itemsize
    return pa.Array.from_buffers(
        pa.large_binary(), len(column), [None, pa.py_buffer(borders_out.astype(np.int64)), pa.py_buffer(gathered)]
    ).cast(pa.binary())


class Tournament:
    """Free capacities of bins; every inner node has the larger of its two children."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.best = [capacity] * (2 * self.leaves)

    def first_fit(self, size: int) -> int:
        """Takes ``size`` from the first bin that has it, and returns the bin."""
        best, at = self.best, 1
        while at < self.leaves:
            at *= 2
            if best[at] < size:
                at += 1
        chosen = at - self.leaves
        best[at] -= size
        while at > 1:
            at //= 2
            best[at] = max(best[2 * at], best[2 * at + 1])
        return chosen


def pack(lengths: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of all pieces, for documents by their lengths."""
    placed, rests, sequence = [], [], 0
    for doc, n in enumerate(lengths):
        for start in range(0, n - n % capacity, capacity):
            placed.append((doc, start, capacity, sequence, 0))
            sequence += 1
        if n % capacity:
            rests.append((n % capacity, doc))
    rests.sort(key=lambda r: (-r[0], r[1]))
    tree, bins = Tournament(max(1, len(rests)), capacity), {}
    for size, doc in rests:
        bins.setdefault(tree.first_fit(size), []).append((doc, lengths[doc] - size, size))
    for doc, start, size, bin_, offset in _filled(list(bins.values()), capacity):
        placed.append((doc, start, size, sequence + bin_, offset))
    return placed


def _filled(bins: list[list[tuple[int, int, int]]], capacity: int):
    """Cuts what the emptiest bins hold into the gaps of the others."""
    bins.sort(key=lambda b: -sum(p[2] for p in b))
    needed = -(-sum(p[2] for b in bins for p in b) // capacity)
    loose = [p for b in bins[needed:] for p in b]
    for number, own in enumerate(bins[:needed]):
        offset = 0
        for doc, start, size in own:
            yield doc, start, size, number, offset
            offset += size
        while offset < capacity and loose:
            doc, start, size = loose.pop()
            part = min(size, capacity - offset)
            yield doc, start, part, number, offset
            offset += part
            if part < size:
                loose.append((doc, start + part, size - part))


def packed(docs: DataFrame, path: str, end_id: int, length: int = LENGTH, group_docs: int = GROUP_DOCS) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    ``ids`` are the piece's ids as little-endian unsigned 32-bit numbers.
    """
    rows = keyed(docs)
    total = rows.agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).first()
    groups = max(1, -(-total["rows"] // group_docs), -(-(total["bytes"] or 0) // GROUP_BYTES))
    # rows have a number of their own where they repeat, so that equal ones are spread as others are
    dealt = rows.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))
    own = column_of(docs, "doc_id")

    def encode(batches):
        for batch in byte_batches(batches, BATCH_BYTES):
            ids = encode_batch(path, batch.column(1), end_id)
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), ids], names=["group", "doc_id", "ids"])
        release()

    def place(table: pa.Table) -> pa.Table:
        kind = id_type(path)
        # the order of arrival must not matter
        table = table.take(pa.compute.sort_indices(table, [("doc_id", "ascending"), ("ids", "ascending")]))
        ids = [np.frombuffer(x, kind) for x in table["ids"].to_pylist()]
        rows = pack([len(x) for x in ids], length)
        doc, start, size, sequence, offset = (np.array(x, np.int64) for x in zip(*rows, strict=True))
        first = table["group"][0].as_py() << 32
        cut = [ids[d][s : s + n].astype("<u4").tobytes() for d, s, n, _, _ in rows]
        columns = {
            "doc_id": table["doc_id"].take(pa.array(doc)),
            "start": start,
            "length": size,
            "doc_tokens": np.array([len(x) for x in ids], np.int64)[doc],
            "sequence_id": sequence + first,
            "offset": offset,
            "ids": pa.array(cut, pa.binary()),
        }
        return pa.table(columns)

    coded = dealt.select("doc_id", "text", "group").mapInArrow(encode, f"group long, {own}, ids binary")
    out = f"{own}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return coded.groupBy("group").applyInArrow(place, out)
