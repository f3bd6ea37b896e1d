"""Packing documents into token windows by best-fit decreasing.

A document's ids end with an end mark. Overlong documents are first cut into full windows; what is
left of each waits in a pool. A pool is packed longest first: a segment tree indexed by remaining
capacity finds the open window that a piece fills most tightly. In the end the least filled windows
are cut to fill the gaps of the others, and the one window that stays open is cut at powers of two,
where no padding is due.

Each task packs its own rows, pool by pool: nothing shuffles, whatever keys repeat, and its memory
is that of one pool. A task run again packs the same rows the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .bpe import BATCH_ROWS, WORD_FILE, tokenizer
from .common import mapped, slices

WINDOW = 4096
END_ID = 2
#: Tokens a task holds before it packs them (4 bytes each).
POOL_TOKENS = 2_000_000
#: Tokens of finished pieces handed on at once.
OUT_TOKENS = 500_000


class Capacities:
    """Open windows by remaining capacity, under a segment tree of whether a range of capacities has any."""

    def __init__(self, most: int):
        self.leaves = 1
        while self.leaves <= most:
            self.leaves *= 2
        self.tree = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(self.leaves)]

    def _count(self, capacity: int, by: int) -> None:
        at = capacity + self.leaves
        while at:
            self.tree[at] += by
            at //= 2

    def add(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        self._count(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (capacity, window) of the least capacity that is at least need."""
        tree, at = self.tree, need + self.leaves
        if not tree[at]:
            while at > 1 and (at & 1 or not tree[at + 1]):  # climb until a right neighbour has windows
                at //= 2
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if tree[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        window = self.open[capacity].pop()
        self._count(capacity, -1)
        return capacity, window


def best_fit_decreasing(lengths: list[int], window: int = WINDOW) -> list[list[int]]:
    """Items dealt to windows: longest first (ties in order), each into the tightest window that takes it."""
    open_, windows = Capacities(window), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        if (found := open_.take(lengths[i])) is None:
            windows.append([i])
            left = window - lengths[i]
            at = len(windows) - 1
        else:
            left, at = found[0] - lengths[i], found[1]
            windows[at].append(i)
        if left:
            open_.add(left, at)
    return windows


Piece = tuple[int, int, int]  # item, start in it, length


def fill_gaps(windows: list[list[Piece]], window: int = WINDOW) -> list[list[Piece]]:
    """The same pieces, cut where needed: all windows full but for some whose lengths are powers of two."""
    size = lambda w: sum(p[2] for p in w)
    order = sorted((w for w in windows if size(w) < window), key=size, reverse=True)
    done = [w for w in windows if size(w) == window]
    rest: list[Piece] = []  # of windows that were taken apart
    while order or rest:
        current = order.pop(0) if order else []
        gap = window - size(current)
        while gap and (rest or order):
            if not rest:
                rest = order.pop()
            item, start, length = rest.pop()
            n = min(gap, length)
            current.append((item, start, n))
            if n < length:
                rest.append((item, start + n, length - n))
            gap -= n
        if not gap:
            done.append(current)
            continue
        # the last window: the binary digits of its length
        for bit in reversed(range((window - gap).bit_length())):
            need, part = (window - gap) & 1 << bit, []
            while need:
                item, start, length = current.pop()
                n = min(need, length)
                part.append((item, start, n))
                if n < length:
                    current.append((item, start + n, length - n))
                need -= n
            if part:
                done.append(part)
    return done


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, window: int = WINDOW, end_id: int = END_ID, pool_tokens: int = POOL_TOKENS) -> DataFrame:
    """One row per piece: id_col, start, length, doc_tokens, sequence_id, offset, ids (binary, little-endian uint32).

    NULL text is empty: its document is the end mark alone. Every row is packed, repeated rows as
    documents of their own; no row of an empty table. Sequences hold at most `window` ids and are
    full but for a few whose length is a power of two. sequence_id is unique, not dense.
    """
    path = path or public_tokenizers.path(WORD_FILE)
    rows = df.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").cast("string"))
    kind = rows.schema[0].dataType
    numbers = ["start", "length", "doc_tokens", "sequence_id", "offset"]
    schema = StructType([StructField(id_col, kind), *StructType.fromDDL(", ".join(f"{n} bigint" for n in numbers) + ", ids binary")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(path)
        sequence = TaskContext.get().partitionId() << 32
        end = np.array([end_id], "<u4").tobytes()
        pool: list[tuple] = []  # id, start, doc_tokens, ids
        held, id_type = 0, None

        def emitted(pieces: list[tuple]) -> pa.RecordBatch:
            types = [id_type, *[pa.int64()] * 5, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*pieces), types)], names=schema.names)

        def closed() -> Iterator[tuple]:
            """The pieces of the pool, packed."""
            nonlocal sequence
            lengths = [len(ids) // 4 for *_, ids in pool]
            windows = [[(i, 0, lengths[i]) for i in w] for w in best_fit_decreasing(lengths, window)]
            for pieces in fill_gaps(windows, window):
                offset = 0
                for i, start, n in pieces:
                    doc, before, tokens, ids = pool[i]
                    yield doc, before + start, n, tokens, sequence, offset, ids[4 * start : 4 * (start + n)]
                    offset += n
                sequence += 1
            pool.clear()

        def packed() -> Iterator[tuple]:
            nonlocal sequence, held, id_type
            for batch in slices(batches, BATCH_ROWS):
                id_type = batch.column(0).type
                for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist())):
                    ids += end
                    tokens = len(ids) // 4
                    full = tokens - tokens % window
                    for start in range(0, full, window):
                        yield doc, start, window, tokens, sequence, 0, ids[4 * start : 4 * (start + window)]
                        sequence += 1
                    if full < tokens:
                        pool.append((doc, full, tokens, ids[4 * full :]))
                        held += tokens - full
                if held >= pool_tokens:
                    yield from closed()
                    held = 0
            yield from closed()

        out, size = [], 0
        for piece in packed():
            out.append(piece)
            size += piece[2]
            if size >= OUT_TOKENS:
                yield emitted(out)
                out, size = [], 0
        if out:
            yield emitted(out)

    return mapped(rows, run, schema, keeps=True)


def digest(df: DataFrame) -> DataFrame:
    """The pieces of documents with the checksum of their ids instead of these."""
    return pack(df).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
