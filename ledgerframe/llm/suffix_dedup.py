"""Exact repeats of ``WINDOW`` bytes across documents, by sorted suffixes.

Every window of 50 bytes has one anchor, the leftmost of its 24-byte strings with the least
hash; equal windows have their anchors at equal places. Consecutive windows of one anchor form a
zone: the suffix from the anchor on, and the bytes in front of it. Only suffixes at anchors
are sorted, about one for 14 bytes, and of those only the ones that can matter:

1. Hashes of anchors are grouped; those in more than one document are put in a Bloom filter of
   bounded size, which is broadcast. It only saves work: what passes by mistake is sorted in vain.
2. Zones at those anchors, once per batch, are range-partitioned by their suffixes with sampled
   splitters, into as many buckets as keep them at about ``BUCKET_ROWS`` zones. Every bucket is sorted by a multikey sort (one word of eight bytes at a time, for
   the suffixes that are equal so far). Runs of neighbours with a common prefix, split by the bytes in front of the
   anchor, are the equal windows; the least document of each is kept. Windows of runs that
   touch a bucket's border are compared across buckets by their digests.
3. Decisions go back to the places of the zones, and windows whose least document comes
   before their own are cut.

Equal zones are sent once per batch, so a hot passage is no hot group; zones that share only
a suffix are split over buckets, as all their bytes take part in the order.

Very long texts are worked on in parts of ``size`` bytes that overlap by a window.

Defined results: a null text is empty. Texts below 50 bytes lose nothing. Columns that are not
asked for are ignored, whatever their names. Rows with equal ids
are no earlier than each other, so they keep what only they share; a null id comes last.
Matches never cross documents. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerframe.llm.common import keyed, release, text_bytes
from ledgerframe.session import materialize

WINDOW = 50
ANCHOR = 24
LEFT = WINDOW - ANCHOR
#: Bytes of text worked on at once, and the largest Bloom filter in bits.
CHUNK = 1 << 18
FILTER_BITS = 1 << 27
#: Zones in a bucket; bytes of text that splitters are sampled from, at least and as a share of all;
#: one of so many sampled suffixes goes to the driver.
BUCKET_ROWS = 100_000
SAMPLE_BYTES, SAMPLE_SHARE, SAMPLE_STEP = 8 << 20, 1 / 50_000, 8
_PLACE = np.uint64((1 << 22) - 1)
_BASE = 0x9E3779B97F4A7C15 | 1
U = np.uint64


@cache
def _powers(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, and a random number for each byte."""
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(length, _BASE, U), np.full(length, inverse, U)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down), np.random.default_rng(50).integers(0, 1 << 63, 256, U)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(29))) * U(0xA0761D6478BD642F)
    return x ^ (x >> U(32))


class Chunk:
    """Zones of all windows in a run of bytes that holds several texts or a part of one."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """``starts`` and ``ends`` are the texts' borders in ``data``."""
        n = len(data)
        up, down, table = _powers(1 << max(19, n.bit_length()))
        sums = np.zeros(n + 1, U)
        np.cumsum(table[data] * down[:n], out=sums[1:])
        self.data, self.sums, self.up, self.starts = data, sums, up, starts
        grams = (sums[ANCHOR:] - sums[: n - ANCHOR + 1]) * up[: n - ANCHOR + 1] if n >= ANCHOR else np.zeros(0, U)
        self.grams = mixed(grams)
        windows = max(0, n - WINDOW + 1)
        places = np.arange(len(grams), dtype=U)
        least = (self.grams & ~_PLACE) | places
        for step in (1, 2, 4, 8):
            least = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0]
        rest = LEFT + 1 - 16
        least = np.minimum(least[:windows], least[rest : rest + windows]) if windows else least[:0]
        anchor = (least & _PLACE).astype(np.int64)
        # windows that lie in one text; runs of one anchor and text are zones
        text = np.searchsorted(starts, np.arange(windows), side="right") - 1 if len(starts) else np.zeros(windows, np.int64)
        inside = np.arange(windows) + WINDOW <= ends[text] if windows else np.zeros(0, bool)
        place = np.flatnonzero(inside)
        anchor, text = anchor[place], text[place]
        new = np.ones(len(place), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(place))[: len(first)] - 1  # none where no window is
        self.text, self.anchor = text[first], anchor[first]
        self.low, self.high = place[first], place[last]  # first and last window of the zone

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the anchor's string, and of the whole zone."""
        end = self.high + WINDOW
        zone = (self.sums[end] - self.sums[self.low]) * self.up[self.low]
        shape = ((self.anchor - self.low) << 8 | (end - self.anchor)).astype(U)
        return self.grams[self.anchor], mixed(zone + mixed(shape + U(1)))


def chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK):
    """(chunk, rows, offsets): columns row and ord of each text, and where its part starts in it.

    Columns: row, ord, text. Parts of a long text overlap by a window less a byte, so that each
    window is in one of them.
    """
    for batch in batches:
        data, borders = text_bytes(batch.column(2))
        rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1)])
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(borders, borders[at] + size, side="right")) - 1)
            low, high = borders[at], borders[stop]
            if stop == at + 1 and high - low > 2 * size:
                for part in range(low, high, size):
                    cut = data[part : min(high, part + size + WINDOW - 1)]
                    yield Chunk(cut, np.array([0]), np.array([len(cut)])), rows[:, at:stop], np.array([part - low])
            else:
                own = borders[at : stop + 1] - low
                full = np.flatnonzero(np.diff(own) > 0)
                yield Chunk(data[low:high], own[:-1][full], own[1:][full]), rows[:, at:stop][:, full], np.zeros(len(full), np.int64)
            at = stop


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def shared_anchors(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """Hashes of the anchors that more than one document has."""

    def anchors(batches):
        for chunk, rows, _ in chunks(batches, size):
            gram, _ = chunk.keys()
            yield pa.RecordBatch.from_arrays([_signed(gram), pa.array(rows[1][chunk.text])], names=["gram", "ord"])
        release()

    found = docs.select("row", "ord", "text").mapInArrow(anchors, "gram long, ord long").groupBy("gram")
    return found.agg(F.min("ord").alias("low"), F.max("ord").alias("high")).filter("low < high").select("gram")


def _bits(gram: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(mixed(gram + U(seed)) & U(bits - 1) for seed in (1, 2))


def anchor_filter(grams: DataFrame, limit: int = FILTER_BITS) -> np.ndarray:
    """A Bloom filter of about 8 bits for each anchor, of ``limit`` bits at most."""
    grams = materialize(grams, "anchors")
    bits = min(limit, 1 << max(16, (8 * grams.count()).bit_length()))

    def words(batches):
        for batch in batches:
            at = np.concatenate(_bits(batch.column(0).to_numpy().view(U), bits))
            word, mask = (at >> U(6)).astype(np.int64), U(1) << (at & U(63))
            order = np.argsort(word, kind="stable")
            starts = np.flatnonzero(np.diff(word[order], prepend=-1))
            if len(order):
                yield pa.RecordBatch.from_arrays([pa.array(word[order][starts]), _signed(np.bitwise_or.reduceat(mask[order], starts))], names=["word", "mask"])

    rows = grams.mapInArrow(words, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    filled = np.zeros(bits // 64, U)
    filled[rows["word"].to_numpy()] = rows["mask"].to_numpy().view(U)
    return filled


def _passes(filled: np.ndarray, gram: np.ndarray) -> np.ndarray:
    found = np.ones(len(gram), bool)
    for at in _bits(gram, len(filled) * 64):
        found &= (filled[at >> U(6)] >> (at & U(63))) & U(1) == 1
    return found


def _zones_of(batches: Iterator[pa.RecordBatch], filled: np.ndarray, splitters: np.ndarray | None, size: int, step: int = 1):
    """Distinct zones of each chunk, or every ``step``-th of them."""
    for chunk, rows, _ in chunks(batches, size):
        gram, zone = chunk.keys()
        kept = np.flatnonzero(_passes(filled, gram))
        if not len(kept):
            continue
        kept = kept[np.lexsort((rows[1][chunk.text[kept]], zone[kept], gram[kept]))]
        new = np.ones(len(kept), bool)
        new[1:] = (gram[kept][1:] != gram[kept][:-1]) | (zone[kept][1:] != zone[kept][:-1])
        first = np.flatnonzero(new)
        order = rows[1][chunk.text[kept]]
        low, high = order[first][::step], np.maximum.reduceat(order, first)[::step]
        kept = kept[first[::step]]
        anchor = chunk.anchor[kept]
        right, left = chunk.high[kept] + WINDOW - anchor, anchor - chunk.low[kept]
        padded = np.concatenate([np.zeros(LEFT, np.uint8), chunk.data, np.zeros(WINDOW, np.uint8)])
        tail = padded[anchor[:, None] + LEFT + np.arange(WINDOW)]
        tail[np.arange(WINDOW) >= right[:, None]] = 0
        head = padded[anchor[:, None] + LEFT - 1 - np.arange(LEFT)]
        head[np.arange(LEFT) >= left[:, None]] = 0
        key = np.ascontiguousarray(np.hstack([tail, head]))
        borders = pa.py_buffer(np.arange(0, key.size + 1, key.shape[1], dtype=np.int32))
        keys = pa.Array.from_buffers(pa.binary(), len(kept), [None, borders, pa.py_buffer(key)])
        yield pa.RecordBatch.from_arrays(
            [
                keys,
                pa.array(right.astype(np.int8)),
                pa.array(left.astype(np.int8)),
                _signed(gram[kept]),
                _signed(zone[kept]),
                pa.array(low),
                pa.array(high),
                pa.array(bucket_of(key, splitters)),
            ],
            names=["key", "right", "left", "gram", "zone", "low", "high", "bucket"],
        )
    release()


def zones(docs: DataFrame, shared, splitters: np.ndarray | None = None, size: int = CHUNK) -> DataFrame:
    """Distinct zones of each chunk: key (suffix, then the bytes in front, backwards, both padded
    with zeros), right, left (their lengths), gram, zone, low and high (its documents), bucket."""

    def cut(batches):
        yield from _zones_of(batches, shared.value, splitters, size)

    schema = "key binary, right byte, left byte, gram long, zone long, low long, high long, bucket int"
    return docs.select("row", "ord", "text").mapInArrow(cut, schema)


def _leading(key: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(key[:, :8]).view(">u8").ravel().astype(U)


def bucket_of(key: np.ndarray, splitters: np.ndarray | None) -> np.ndarray:
    """The number of splitters at or below each key; both are rows of bytes, splitters in order."""
    if splitters is None or not len(splitters):
        return np.zeros(len(key), np.int32)
    borders, own = _leading(splitters), _leading(key)
    found = np.searchsorted(borders, own, side="right")
    # the leading eight bytes decide, but for keys that have those of a splitter
    tied = np.flatnonzero(found > np.searchsorted(borders, own, side="left"))
    if len(tied):
        as_text = f"S{key.shape[1]}"
        whole = np.ascontiguousarray(splitters).view(as_text).ravel()
        found[tied] = np.searchsorted(whole, np.ascontiguousarray(key[tied]).view(as_text).ravel(), side="right")
    return found.astype(np.int32)


def sampled_splitters(docs: DataFrame, shared, size: int = CHUNK, bucket_rows: int = BUCKET_ROWS) -> np.ndarray:
    """Keys, in order, that part the zones into buckets of about ``bucket_rows``.

    They come from a sample of the documents. They decide on the balance of buckets alone.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    share = min(1.0, max(SAMPLE_BYTES, total * SAMPLE_SHARE) / max(total, 1))
    some = docs if share == 1.0 else docs.sample(share, seed=2)


    def sampled(batches):
        # thinned where they are made: a second Python stage would double the workers of an executor
        for batch in _zones_of(batches, shared.value, None, size, SAMPLE_STEP):
            yield batch.select(["key"])

    keys = some.select("row", "ord", "text").mapInArrow(sampled, "key binary").toArrow()["key"].to_pylist()
    wanted = min(len(keys), int(len(keys) * SAMPLE_STEP / share / bucket_rows) + 1)
    if wanted < 2:
        return np.zeros((0, WINDOW + LEFT), np.uint8)
    keys.sort()
    chosen = sorted({keys[len(keys) * i // wanted] for i in range(1, wanted)})
    return np.frombuffer(b"".join(chosen), np.uint8).reshape(len(chosen), -1)


def multikey_order(key: np.ndarray) -> np.ndarray:
    """Sort order of rows of bytes.

    The first eight bytes are sorted; then, within each run that is equal so far, the next
    eight, as multikey quicksort does, for all runs of one depth together.
    """
    n, width = key.shape
    wide = -(-width // 8)
    words = np.zeros((n, wide * 8), np.uint8)
    words[:, :width] = key
    words = words.view(">u8").astype(U)
    order = np.argsort(words[:, 0], kind="stable")
    group = np.zeros(n, np.int64)  # where the run of equal prefixes starts, by place in the order
    open_ = np.arange(n)
    for depth in range(wide):
        if depth:
            own = order[open_]
            order[open_] = own[np.lexsort((words[own, depth], group[open_]))]
        value = words[order[open_], depth]
        new = np.ones(len(open_), bool)
        new[1:] = (value[1:] != value[:-1]) | (group[open_][1:] != group[open_][:-1])
        group[open_] = open_[np.flatnonzero(new)][np.cumsum(new) - 1]
        size = np.diff(np.append(np.flatnonzero(new), len(open_)))
        open_ = open_[np.repeat(size > 1, size)]
        if not len(open_):
            break
    return order


def common_prefixes(key: np.ndarray) -> np.ndarray:
    """Bytes that each row has in common with the one before it, from the left."""
    common = np.zeros(len(key), np.int64)
    if len(key) > 1:
        equal = key[1:] == key[:-1]
        common[1:] = np.where(equal.all(axis=1), key.shape[1], equal.argmin(axis=1))
    return common


def bucket_windows(key: np.ndarray, right: np.ndarray, left: np.ndarray, low: np.ndarray, high: np.ndarray):
    """For every zone and each number of bytes in front of the anchor (0 to ``LEFT``): the least
    and the greatest document with that window, and a number for the windows whose runs touch the
    bucket's border (equal windows have one number, others -1); and of every such number a row, the
    bytes in front, the least and the greatest document.

    The rows are in the order of their keys. Windows that a zone lacks have low > high.
    """
    n = len(key)
    tail = common_prefixes(key[:, :WINDOW])
    order = multikey_order(key[:, WINDOW:])
    head = common_prefixes(key[:, WINDOW:][order])
    least, most = np.full((n, LEFT + 1), np.iinfo(np.int64).max), np.full((n, LEFT + 1), -1)
    number, edges, count = np.full((n, LEFT + 1), -1, np.int32), [], 0
    for front in range(LEFT + 1):
        run = np.cumsum(tail < WINDOW - front)
        kind = np.empty(n, np.int64)
        kind[order] = np.cumsum(head < front)
        own = np.flatnonzero((left >= front) & (right >= WINDOW - front))
        if not len(own):
            continue
        code = run[own] * (n + 1) + kind[own]
        by = np.argsort(code, kind="stable")
        starts = np.flatnonzero(np.diff(code[by], prepend=-1))
        sizes = np.diff(np.append(starts, len(own)))
        least[own[by], front] = np.repeat(np.minimum.reduceat(low[own[by]], starts), sizes)
        most[own[by], front] = np.repeat(np.maximum.reduceat(high[own[by]], starts), sizes)
        first = own[by][starts]
        edge = (run[first] == run[0]) | (run[first] == run[-1])
        label = np.where(edge, count + np.cumsum(edge) - 1, -1)
        number[own[by], front] = np.repeat(label, sizes)
        count += int(edge.sum())
        at = first[edge]
        edges.append(np.stack([at, np.full(len(at), front), least[at, front], most[at, front]], axis=1))
    return least, most, number, np.concatenate(edges) if edges else np.zeros((0, 4), np.int64)


def _digests(key: np.ndarray, front: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the window with so many bytes in front of the anchor."""
    at = np.arange(WINDOW)[None, :]
    place = np.where(at < front[:, None], WINDOW + front[:, None] - 1 - at, at - front[:, None])
    window = np.take_along_axis(key, place, axis=1).astype(U)
    random = np.random.default_rng(51).integers(0, 1 << 63, (2, 256, WINDOW), U)
    return tuple(mixed(random[i][window.astype(np.int64), at].sum(axis=1, dtype=U) + front.astype(U)) for i in range(2))


#: What a bucket tells. TOLD: the decisions on a zone's windows. EDGE: a window whose run touches the
#: border, with its digests. OPEN: a zone with such windows, and their numbers.
TOLD, EDGE, OPEN = 0, 1, 2
BUCKET = (
    "kind byte, bucket int, gram long, zone long, first byte, last byte, low long, high long, "
    "one long, two long, number int, numbers binary"
)
_NAMES = [field.split()[0] for field in BUCKET.split(", ")]
_TYPES = {"byte": pa.int8(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _rows(count: int, **columns) -> pa.RecordBatch:
    fields = [field.split() for field in BUCKET.split(", ")]
    arrays = [pa.array(columns[name], _TYPES[kind]) if name in columns else pa.nulls(count, _TYPES[kind]) for name, kind in fields]
    return pa.RecordBatch.from_arrays(arrays, names=_NAMES)


def _runs(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column, and value of the runs of equal values of at least 0 in rows."""
    new = np.ones(value.shape, bool)
    new[:, 1:] = value[:, 1:] != value[:, :-1]
    begin = np.flatnonzero(new.ravel())
    end = np.append(begin[1:], value.size) - 1
    kept = value.ravel()[begin] >= 0
    begin, end = begin[kept], end[kept]
    at, first = np.divmod(begin, value.shape[1])
    return at, first, end - at * value.shape[1], value.ravel()[begin]


def _sorted_bucket(batches: list[pa.RecordBatch], bucket: int):
    table = pa.Table.from_batches(batches)
    column = {name: table[name].combine_chunks() for name in table.column_names}
    n = table.num_rows
    key = np.frombuffer(column["key"].buffers()[2], np.uint8)[: n * (WINDOW + LEFT)].reshape(n, -1)
    order = multikey_order(key)
    gram, zone, low, high = (column[c].to_numpy(zero_copy_only=False)[order] for c in ("gram", "zone", "low", "high"))
    right, left = (column[c].to_numpy(zero_copy_only=False)[order].astype(np.int64) for c in ("right", "left"))
    key = key[order]
    least, most, number, edges = bucket_windows(key, right, left, low, high)
    # equal zones of several chunks have equal windows: one of them speaks for all
    pair = np.lexsort((zone, gram))
    single = np.ones(n, bool)
    single[pair[1:]] = (gram[pair][1:] != gram[pair][:-1]) | (zone[pair][1:] != zone[pair][:-1])
    told = (least < most) & single[:, None] & (number < 0)
    at, first, last, value = _runs(np.where(told, least, -1))
    yield _rows(len(at), kind=np.full(len(at), TOLD), gram=gram[at], zone=zone[at], first=first, last=last, low=value)
    for start in range(0, len(edges), 100_000):
        at, front, low, high = edges[start : start + 100_000].T
        one, two = (x.view(np.int64) for x in _digests(key[at], front))
        labels = np.arange(start, start + len(at))
        yield _rows(len(at), kind=np.full(len(at), EDGE), bucket=np.full(len(at), bucket), low=low, high=high, one=one, two=two, number=labels)
    at = np.flatnonzero(single & (number >= 0).any(axis=1))
    numbers = [x.tobytes() for x in number[at].astype("<i4")]
    yield _rows(len(at), kind=np.full(len(at), OPEN), bucket=np.full(len(at), bucket), gram=gram[at], zone=zone[at], numbers=numbers)


def buckets(found: DataFrame, count: int) -> DataFrame:
    """What the ``count`` sorted buckets of zones tell, written once."""

    def sort_bucket(batches):
        held = [batch for batch in batches if batch.num_rows]
        if held:
            yield from _sorted_bucket(held, TaskContext.get().partitionId())
        release()

    return materialize(found.repartitionById(count, "bucket").mapInArrow(sort_bucket, BUCKET), "windows")


def decisions(told: DataFrame) -> DataFrame:
    """gram, zone, first, last, low: the least document of the windows with first to last bytes in
    front of the anchor, where more than one document has them.

    Windows at the borders of buckets are compared by their digests, one row for each window and
    bucket; what is found goes back to the zones of the bucket.
    """
    edge = told.filter(F.col("kind") == EDGE).select("bucket", "number", "one", "two", "low", "high")
    least = edge.groupBy("one", "two").agg(F.min("low").alias("least"), F.max("high").alias("most")).filter("least < most")
    known = edge.join(least, ["one", "two"]).select(F.col("bucket").alias("of"), "number", F.col("least").alias("low"))
    open_ = told.filter(F.col("kind") == OPEN).select("bucket", "gram", "zone", "numbers")

    def resolved(zones: pa.Table, windows: pa.Table) -> pa.Table:
        number = np.frombuffer(b"".join(zones["numbers"].to_pylist()), "<i4").reshape(zones.num_rows, LEFT + 1)
        place = windows["number"].to_numpy()
        low = np.full(max(number.max(initial=-1), place.max(initial=-1)) + 2, -1)
        low[place] = windows["low"].to_numpy()
        at, first, last, value = _runs(low[number])  # -1, for none, is the last place
        columns = {"gram": zones["gram"].take(pa.array(at)), "zone": zones["zone"].take(pa.array(at))}
        return pa.table({**columns, "first": pa.array(first, pa.int8()), "last": pa.array(last, pa.int8()), "low": value})

    schema = "gram long, zone long, first byte, last byte, low long"
    across = open_.groupBy("bucket").cogroup(known.groupBy("of")).applyInArrow(resolved, schema)
    return told.filter(F.col("kind") == TOLD).select("gram", "zone", "first", "last", "low").unionByName(across)


def places(docs: DataFrame, shared, size: int = CHUNK) -> DataFrame:
    """gram, zone, row, ord and the anchor's place in the text, for the zones that may repeat."""

    def find(batches):
        for chunk, rows, offsets in chunks(batches, size):
            gram, zone = chunk.keys()
            kept = np.flatnonzero(_passes(shared.value, gram))
            text = chunk.text[kept]
            at = chunk.anchor[kept] - chunk.starts[text] + offsets[text]
            yield pa.RecordBatch.from_arrays(
                [_signed(gram[kept]), _signed(zone[kept]), pa.array(rows[0][text]), pa.array(rows[1][text]), pa.array(at)],
                names=["gram", "zone", "row", "ord", "anchor"],
            )
        release()

    return docs.select("row", "ord", "text").mapInArrow(find, "gram long, zone long, row long, ord long, anchor long")


def repeats(docs: DataFrame, size: int = CHUNK, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """row, spans: bytes [start, end) of each document that earlier documents have as well.

    ``docs`` has the columns of ``keyed``. The spans may overlap and have no order.
    """
    session = docs.sparkSession
    shared = session.sparkContext.broadcast(anchor_filter(shared_anchors(docs, size)))
    splitters = sampled_splitters(docs, shared, size, bucket_rows)
    told = decisions(buckets(zones(docs, shared, splitters, size), len(splitters) + 1))
    hit = places(docs, shared, size).join(told, ["gram", "zone"]).filter("low < ord")
    span = F.struct((F.col("anchor") - F.col("last")).alias("start"), (F.col("anchor") - F.col("first") + WINDOW).alias("end"))
    return hit.groupBy("row").agg(F.collect_list(span).alias("spans"))


def joined_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes that the spans cover."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return start[first], reach[np.append(first[1:], len(start)) - 1] if len(first) else reach[:0]


def whole_characters(text: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans without the characters of which they have a part only."""

    def inside(at: np.ndarray) -> np.ndarray:
        return np.array([i < len(text) and text[i] & 0xC0 == 0x80 for i in at.tolist()], bool)

    for _ in range(3):
        start, end = start + inside(start), end - inside(end)
    kept = start < end
    return start[kept], end[kept]


def without_repeats(
    docs: DataFrame, *more: str, whole_chars: bool = False, size: int = CHUNK, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """doc_id, bytes (of the text without what earlier documents have), n_bytes, spans (maximal
    removed runs, in order), with further columns of ``docs`` by name. With ``whole_chars`` the
    bytes are text again: characters that only a part would be removed of stay.

    Only texts and spans go to the Python workers; other columns stay in the rows.
    """

    @F.arrow_udf("bytes binary, spans array<struct<start: bigint, end: bigint>>")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        kept, runs = [], []
        for text, pairs in zip(texts.cast(pa.binary()), spans, strict=True):
            text = text.as_py()
            if not pairs.is_valid:
                kept.append(text)
                runs.append([])
                continue
            start, end = joined_spans(*(pairs.values.field(i).to_numpy() for i in (0, 1)))
            if whole_chars:
                start, end = whole_characters(text, start, end)
            borders = np.concatenate([[0], np.stack([start, end], axis=1).ravel(), [len(text)]]).tolist()
            kept.append(b"".join(text[a:b] for a, b in zip(borders[::2], borders[1::2], strict=True)))
            runs.append([{"start": a, "end": b} for a, b in zip(start.tolist(), end.tolist(), strict=True)])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.StructArray.from_arrays([pa.array(kept, pa.binary()), pa.array(runs, kind)], names=["bytes", "spans"])

    rows = keyed(docs, *more)
    both = rows.join(repeats(rows, size, bucket_rows), "row", "left")
    both = both.select("doc_id", *more, F.octet_length("text").cast("long").alias("n_bytes"), cut("text", "spans").alias("_cut"))
    return both.select("doc_id", *more, F.col("_cut.bytes").alias("bytes"), "n_bytes", F.col("_cut.spans").alias("spans"))
