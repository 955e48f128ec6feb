"""Bounded-space online packing of documents into fixed-length token sequences.

Each input partition keeps a fixed number of open windows. A document longer than a window first fills
whole windows of its own; what remains goes to the open window it fits best (the least room left over).
When it fits none and all windows are open, the fullest is emitted and a fresh one is opened. Windows
still open at the end of a partition are merged in a last step: whole windows are placed, largest first,
by the same rule into shared sequences.

Defined cases: a null or empty text is its end token alone; repeated rows are packed as often as they
come; an empty table gives no pieces; further columns are ignored. A piece is never empty.
"""

from __future__ import annotations

from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm._shared import bound_batches, materialise, table, ticked

WINDOW = 2048
OPEN_WINDOWS = 64
END_ID = 1
#: Windows that one task of the merge step places.
MERGE_WINDOWS = 50_000


class OpenWindows:
    """At most `limit` open windows of `size`; place() returns the pieces of the windows it had to close."""

    def __init__(self, size: int, limit: int):
        self.size, self.limit = size, limit
        self.fill: list[int] = []
        self.held: list[list] = []

    def place(self, length: int, item) -> list | None:
        best, room = -1, self.size + 1
        for k, f in enumerate(self.fill):
            left = self.size - f - length
            if 0 <= left < room:
                best, room = k, left
                if not left:
                    break
        closed = None
        if best < 0:
            if len(self.fill) >= self.limit:
                closed = self.pop(max(range(len(self.fill)), key=self.fill.__getitem__))
            self.fill.append(0)
            self.held.append([])
            best = len(self.fill) - 1
        self.held[best].append((item, self.fill[best]))
        self.fill[best] += length
        return closed

    def pop(self, k: int) -> list:
        self.fill[k], self.fill[-1] = self.fill[-1], self.fill[k]
        self.held[k], self.held[-1] = self.held[-1], self.held[k]
        self.fill.pop()
        return self.held.pop()


PIECES = "id {kind}, start long, length long, ids_crc32 long, doc_tokens long, window long, offset long, open boolean, ids binary"


def _pack_partition(path: str, size: int, limit: int, end_id: int, with_ids: bool, id_type):
    end = end_id.to_bytes(4, "little")

    def run(batches):
        from pyspark import TaskContext

        from quire.llm.word_ids import encoder

        encode = encoder(path)
        windows, number = OpenWindows(size, limit), TaskContext.get().partitionId() << 36
        rows: list[tuple] = []

        def close(pieces, is_open=False):
            nonlocal number
            rows.extend((*piece, number, at, is_open, ids) for (*piece, ids), at in pieces)
            number += 1

        def flush():
            cols = list(zip(*rows)) or [()] * 9
            kinds = [id_type, *[pa.int64()] * 6, pa.bool_(), pa.binary()]
            rows.clear()
            return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["id", "start", "length", "ids_crc32", "doc_tokens", "window", "offset", "open", "ids"])

        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                for doc, ids in zip(part.column(0).to_pylist(), encode.ids_of(part.column(1).to_pylist()), strict=True):
                    ids += end
                    n = len(ids) // 4
                    for start in range(0, n, size):
                        piece = ids[4 * start : 4 * (start + size)]
                        made = (doc, start, len(piece) // 4, crc32(piece), n, piece if with_ids else None)
                        if len(piece) == 4 * size:
                            close([(made, 0)])
                        elif closed := windows.place(len(piece) // 4, made):
                            close(closed)
                if len(rows) > 20_000:
                    yield flush()
        while windows.fill:
            close(windows.pop(0), True)
        yield flush()

    return run


def _merge_partition(size: int, limit: int):
    def run(batches):
        from pyspark import TaskContext

        windows, number = OpenWindows(size, limit), (TaskContext.get().partitionId() << 36) | (1 << 35)
        rows: list[tuple] = []

        def close(items):
            nonlocal number
            rows.extend((item, number, at) for item, at in items)
            number += 1

        def flush():
            cols = list(zip(*rows)) or [()] * 3
            rows.clear()
            return pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["window", "sequence", "base"])

        for b in batches:
            for window, length in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if closed := windows.place(length, window):
                    close(closed)
            if len(rows) > 20_000:
                yield flush()
        while windows.fill:
            close(windows.pop(0))
        yield flush()

    return run


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = WINDOW,
    open_windows: int = OPEN_WINDOWS,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    `ids` holds the piece's little-endian unsigned 32-bit token ids if with_ids, else null; ids_crc32 is
    their checksum either way. sequence_id is unique but not gapless. Every sequence is padded to `size`.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    source = docs.select(ticked(id_col).alias("id"), ticked(text_col).cast("string").alias("text"))
    pieces = materialise(
        source.mapInArrow(_pack_partition(tokenizer_path, size, open_windows, end_id, with_ids, to_arrow_type(kind)), PIECES.format(kind=kind.simpleString())), "pieces"
    )
    left = pieces.where("open").groupBy("window").agg(F.sum("length").alias("length"))
    parts = max(1, -(-left.count() // MERGE_WINDOWS))
    placed = materialise(
        left.repartition(parts, "window").sortWithinPartitions(F.col("length").desc(), "window").mapInArrow(_merge_partition(size, open_windows), "window long, sequence long, base long"),
        "merged",
    )
    moved = pieces.where("open").join(placed, "window").select("id", "start", "length", "ids_crc32", "doc_tokens", F.col("sequence").alias("sequence_id"), (F.col("offset") + F.col("base")).alias("offset"), "ids")
    done = pieces.where("not open").select("id", "start", "length", "ids_crc32", "doc_tokens", F.col("window").alias("sequence_id"), "offset", "ids")
    return done.unionByName(moved)


def op7_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.select(F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
