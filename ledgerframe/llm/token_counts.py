"""Token counts of whole texts, by the public tokenizer itself.

Texts are cut where no token can span the cut: at ASCII blanks and line ends, which the
tokenizer drops. A piece's count doesn't depend on its neighbours, so each distinct piece is
encoded once per batch, in library batches of bounded bytes, and only lengths leave the task.
Batches of texts are bounded by bytes, so a long text makes a batch of its own; it is cut like
the others. Counts of short pieces are kept per worker process, in a table of bounded size.

Defined results: a null or empty text has 0 tokens and 0 bytes. Rows are independent: repeated
rows, repeated ids and extra columns change nothing. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerframe.llm.common import Recent, byte_batches, column_of, texts

#: Pieces kept per worker and generation, and the longest piece kept.
KEPT, KEPT_CHARS = 300_000, 48
#: Characters per call of the library.
CALL_CHARS = 1 << 18
#: The cuts: blanks that the tokenizer treats as blanks as well.
CUTS = str.maketrans("\n\t\r", "   ")


@cache
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


@cache
def id_type(path: str) -> np.dtype:
    """Two bytes hold the ids of a vocabulary of up to 65,536."""
    return np.dtype("<u2" if tokenizer(path).get_vocab_size() <= 1 << 16 else "<u4")


@cache
def _known(path: str) -> Recent:
    return Recent(KEPT, KEPT_CHARS)


@cache
def separator(path: str) -> tuple[str, int]:
    """A special token: the library encodes what stands on either side of it independently."""
    for number, token in tokenizer(path).get_added_tokens_decoder().items():
        if token.special and not (token.lstrip or token.rstrip or token.single_word or token.normalized):
            return token.content, number
    return "", -1


def encoded_in_calls(path: str, pieces: list[str]):
    """(piece, packed ids) by library calls of bounded size; many pieces go in one text."""
    mark, number = separator(path)
    alone = [p for p in pieces if not mark or mark[0] in p]
    if alone:
        for piece, found in zip(alone, tokenizer(path).encode_batch_fast(alone, add_special_tokens=False), strict=True):
            yield piece, np.array(found.ids, id_type(path)).tobytes()
        pieces = [p for p in pieces if mark and mark[0] not in p]
    start, size = 0, 0
    for i, piece in enumerate(pieces):
        size += len(piece) + len(mark)
        if size >= CALL_CHARS or i + 1 == len(pieces):
            part = pieces[start : i + 1]
            ids = np.array(tokenizer(path).encode_batch_fast([mark.join(part)], add_special_tokens=False)[0].ids, id_type(path))
            ends = np.append(np.flatnonzero(ids == number), len(ids))
            begins = np.append(0, ends[:-1] + 1)
            packed, width = ids.tobytes(), ids.itemsize
            for one, begin, end in zip(part, (begins * width).tolist(), (ends * width).tolist(), strict=True):
                yield one, packed[begin:end]
            start, size = i + 1, 0


def count_batch(path: str, rows: list[str]) -> list[int]:
    """Tokens of each text."""
    known, width = _known(path), id_type(path).itemsize
    cut = [row.translate(CUTS).split(" ") for row in rows]
    fresh = known.unknown(set().union(*cut))
    known.now.update((piece, len(packed) // width) for piece, packed in encoded_in_calls(path, fresh))
    counts = [sum(map(known.now.__getitem__, pieces)) for pieces in cut]
    known.trim(fresh)
    return counts


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every text; ``path`` names a tokenizer file on every node."""

    def count(batches):
        for batch in byte_batches(batches):
            column = batch.column(1)
            sizes = pa.compute.binary_length(column).cast(pa.int64())
            counts = np.array(count_batch(path, column.to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(counts)], names=["doc_id", "n_bytes", "n_tokens"])

    return texts(docs).mapInArrow(count, f"{column_of(docs, 'doc_id')}, n_bytes long, n_tokens long")
