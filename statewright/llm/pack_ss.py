"""Sum-of-squares online packing of token ids into windows of a fixed length.

Documents come one after the other. What a document has beyond whole windows goes to the fill level
(or to a new window) for which the sum over all levels of the squared number of partly filled windows
grows least; only levels that some window has are kept and tried. Once as many windows are open as may be, a document is cut
to close one: the one whose closing makes that sum shrink most, the rest of the document being placed as
before. The few windows still open at a task's end are poured together (documents may be cut freely), and
the last one is cut at powers of two, which need no padding. Each task packs its own part of the input in
one pass; only counts of windows are shared between tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from .common import staged
from .tokens import encoder

#: One piece: document, its first id's place in the document, ids, the document's count of ids.
Piece = tuple[object, int, bytes, int]


class Packer:
    """Packs pieces online; done(pieces, poured) is called with each finished window's pieces."""

    def __init__(self, window: int, done, max_open: int = 64):
        self.window, self.done, self.max_open = window, done, max_open
        # The open windows of each fill level that has any.
        self.open: dict[int, list[list[Piece]]] = {}
        self.n_open = 0

    @property
    def level(self) -> np.ndarray:
        """The number of open windows of each fill level."""
        counts = np.zeros(self.window + 1, dtype=np.int64)
        for at, waiting in self.open.items():
            counts[at] = len(waiting)
        return counts

    def add(self, doc_id, ids: bytes) -> None:
        n = len(ids) // 4
        whole = n - n % self.window
        for at in range(0, whole, self.window):
            self.done([(doc_id, at, ids[4 * at : 4 * (at + self.window)], n)], False)
        if whole < n:
            self._place((doc_id, whole, ids[4 * whole :], n), n - whole)

    def _take(self, at: int) -> list[Piece]:
        """An open window of a fill level; level 0 is a new one."""
        if not at:
            return []
        self.n_open -= 1
        waiting = self.open[at]
        pieces = waiting.pop()
        if not waiting:
            del self.open[at]
        return pieces

    def _place(self, piece: Piece, size: int) -> None:
        w, opened = self.window, self.open
        full = self.n_open >= self.max_open
        if full:
            # Closing one of n windows of a level by cutting the document takes 2 * n - 1 off the sum.
            closable = [(-len(waiting), at) for at, waiting in opened.items() if at + size >= w]
            if closable:
                at = min(closable)[1]
                cut = w - at
                doc_id, start, ids, n = piece
                pieces = self._take(at)
                pieces.append((doc_id, start, ids[: 4 * cut], n))
                self.done(pieces, False)
                if cut < size:
                    self._place((doc_id, start + cut, ids[4 * cut :], n), size - cut)
                return
        # Growth of the sum of squares for each level that has room; level 0 is a new window. Of equal ones the fullest.
        costs = [] if full else [(2 * len(opened.get(size, ())) + 1, 0)]
        for at, waiting in opened.items():
            to = at + size
            if to <= w:
                costs.append(((2 * len(opened.get(to, ())) + 1 if to < w else 0) + 1 - 2 * len(waiting), -at))
        at = -min(costs)[1]
        pieces = self._take(at)
        pieces.append(piece)
        if at + size == w:
            self.done(pieces, False)
            return
        opened.setdefault(at + size, []).append(pieces)
        self.n_open += 1

    def finish(self) -> None:
        """Join the windows still open: all but the last become full."""
        w, current, fill = self.window, [], 0
        waiting = [p for at in sorted(self.open, reverse=True) for pieces in self.open[at] for p in pieces]
        self.open, self.n_open = {}, 0
        for doc_id, start, ids, n in waiting:
            while ids:
                take = min(len(ids) // 4, w - fill)
                current.append((doc_id, start, ids[: 4 * take], n))
                start, ids, fill = start + take, ids[4 * take :], fill + take
                if fill == w:
                    self.done(current, True)
                    current, fill = [], 0
        if not current:
            return
        part, left = [], fill
        size = 1 << (left.bit_length() - 1)
        room = size
        for doc_id, start, ids, n in current:
            while ids:
                take = min(len(ids) // 4, room)
                part.append((doc_id, start, ids[: 4 * take], n))
                start, ids, room = start + take, ids[4 * take :], room - take
                if room == 0:
                    self.done(part, True)
                    part, left = [], left - size
                    size = room = 1 << (left.bit_length() - 1) if left else 0


def _packed(path: str, window: int, end_id: int, id_type: pa.DataType, cache: int):
    schema = pa.schema([("doc_id", id_type), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("part", pa.int32()), ("own", pa.int64()), ("offset", pa.int64()), ("poured", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = encoder(path, spaces=False, limit=cache)
        end = np.array([end_id], dtype="<u4").tobytes()
        part = TaskContext.get().partitionId()
        rows: list[tuple] = []
        count = 0

        def done(pieces: list[Piece], poured: bool) -> None:
            nonlocal count
            offset = 0
            for doc_id, start, ids, n in pieces:
                rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), n, part, count, offset, poured))
                offset += len(ids) // 4
            count += 1

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        packer = Packer(window, done)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc_id, codes.encode(text.as_py() or "") + end)
                if len(rows) >= 20_000:
                    yield flush()
        packer.finish()
        if rows:
            yield flush()

    return run


def pack(docs: DataFrame, tokenizer: str, *, window: int = 4096, end_id: int = 2, cache: int = 250_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, poured.

    poured tells the pieces of the few sequences that were filled from what was open at a task's end.
    tokenizer is the path of a vocabulary whose pre-tokens never hold white space; cache bounds the words that a
    Python worker remembers (memory against time, not results). Null and empty texts
    are documents of the end id alone. Rows that repeat an identifier, or have none, are documents of
    their own. An empty table gives an empty result. Only id_col and text_col are read.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind, id_type = narrow.schema["doc_id"].dataType.simpleString(), to_arrow_type(narrow.schema["doc_id"].dataType)
    pieces = staged(narrow.mapInArrow(_packed(tokenizer, window, end_id, id_type, cache), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, part int, own long, offset long, poured boolean"), "ss-pieces")
    # One row for each task that packed, however long the documents: their running count numbers the windows.
    counts = pieces.groupBy("part").agg((F.max("own") + 1).alias("c"))
    before = counts.select("part", (F.sum("c").over(Window.orderBy("part")) - F.col("c")).alias("before"))
    return pieces.join(before, "part").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("own")).alias("sequence_id"), "offset", "poured")
