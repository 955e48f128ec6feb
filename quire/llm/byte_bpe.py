"""Byte-level BPE by a distinct-word table, and decoding by an id-to-piece join.

Texts are split into words in Spark. One aggregation counts every distinct word; the words that repeat,
most frequent first up to a stated bound, form the table and are encoded once each. The table has a
proven size, so it is broadcast; each batch of documents joins its words to it by value and gathers the
ids back by position. Words outside the table (single occurrences, and words beyond the bound) are
encoded where they stand, once per batch. Decoding joins ids to the vocabulary's pieces (a fixed table)
and concatenates their bytes.

Defined cases: a null text counts as empty and has no ids; repeated rows repeat; an empty table gives an
empty result; a special token written in a text is its id, as the tokenizers library has it; further
columns are ignored.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm._shared import bound_batches, materialise, table, ticked

#: How the vocabulary's pre-tokenizer cuts a text; \s is Unicode white space.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"
#: Bounds of the broadcast table.
TABLE_WORDS = 500_000
TABLE_BYTES = 32 << 20
#: Text bytes of one vectorised batch.
BATCH_BYTES = 4 << 20


def special_tokens(path: str) -> dict[str, int]:
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def split_words(text: Column, specials: list[str]) -> Column:
    """Words of a text in order; special tokens stand alone and cut the text before words are found."""
    whole = F.coalesce(text, F.lit(""))
    if not specials:
        return F.regexp_extract_all(whole, F.lit(WORD), F.lit(0))
    quoted = "|".join("\\Q" + s + "\\E" for s in specials)
    between = F.transform(F.split(whole, quoted), lambda s: F.regexp_extract_all(s, F.lit(WORD), F.lit(0)))
    marks = F.regexp_extract_all(whole, F.lit(quoted), F.lit(0))
    return F.flatten(F.zip_with(between, marks, lambda words, mark: F.when(mark.isNull(), words).otherwise(F.concat(words, F.array(mark)))))


def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _encode_words(tokenizer, words: list[str]) -> pa.Array:
    batch = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
    out: list[bytes] = []
    for at in range(0, len(words), 1024):
        out += [np.array(e.ids, "<u4").tobytes() for e in batch(words[at : at + 1024], add_special_tokens=False)]
    return pa.array(out, pa.large_binary())


def word_table(docs: DataFrame, path: str, text_col: str = "text", max_words: int = TABLE_WORDS, max_bytes: int = TABLE_BYTES) -> pa.Table:
    """(word, ids) of the repeated words, most frequent first, each encoded once; bounded in rows and bytes.

    Counts cover every word of every text. Frequencies are grouped by powers of two, and the lowest
    class that still fits the bounds decides how rare a word may be.
    """

    def encode(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        tokenizer = _tokenizer(path)
        for b in batches:
            yield pa.record_batch([b.column(0), _encode_words(tokenizer, b.column(0).to_pylist()).cast(pa.binary())], names=["word", "ids"])

    words = docs.select(F.explode(split_words(ticked(text_col).cast("string"), list(special_tokens(path)))).alias("word"))
    counts = materialise(words.groupBy("word").count().where("count > 1").withColumn("class", F.floor(F.log2("count")).cast("int")), "words")
    sizes = counts.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("word") + 16).alias("bytes")).orderBy(F.desc("class")).collect()
    least, n, size = 64, 0, 0
    for r in sizes:
        n, size = n + r.n, size + r.bytes
        if n > max_words or size > max_bytes:
            break
        least = r["class"]
    return counts.where(F.col("class") >= least).select("word").mapInArrow(encode, "word string, ids binary").toArrow()


def _slices(sizes: np.ndarray, limit: int):
    """Row ranges whose summed sizes stay under limit (a single larger row is a range of its own)."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + limit, side="right"))
        stop = max(stop, start + 1)
        yield start, stop
        start = stop


def _as_binary_rows(taken: pa.Array, first: np.ndarray, last: np.ndarray) -> pa.Array:
    """Concatenate consecutive values: row k is values first[k] to last[k] of taken, which cover it without gaps."""
    offsets = np.frombuffer(taken.buffers()[1], "<i8")[taken.offset : taken.offset + len(taken) + 1]
    rows = np.append(offsets[first], offsets[last[-1]] if len(last) else 0).astype("<i8")
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(rows.tobytes()), taken.buffers()[2] or pa.py_buffer(b"")])


def _encoding(shared, path: str):
    """Batches (id, words) to batches (id, ids), by the shared table."""

    def run(batches):
        pa.set_memory_pool(pa.system_memory_pool())  # gives large buffers back at once
        held = pa.ipc.open_stream(shared.value).read_all().combine_chunks()
        known = held.column("word").combine_chunks() if held.num_rows else pa.array([], pa.string())
        known_ids = held.column("ids").combine_chunks().cast(pa.large_binary()) if held.num_rows else pa.array([], pa.large_binary())
        tokenizer = _tokenizer(path)
        for b in batches:
            lists = b.column(1)
            offsets = np.asarray(lists.offsets)
            value_ends = np.frombuffer(lists.values.buffers()[1], "<i4")[lists.values.offset :] if len(lists.values) else np.zeros(1, "<i4")
            for start, stop in _slices(np.diff(value_ends[offsets]) if len(lists.values) else np.zeros(b.num_rows), BATCH_BYTES):
                values = lists.values.slice(offsets[start], offsets[stop] - offsets[start])
                index = pc.index_in(values, value_set=known)
                strange = pc.unique(values.filter(pc.is_null(index)))
                ids = known_ids
                if len(strange):
                    index = pc.coalesce(index, pc.add(pc.index_in(values, value_set=strange), pa.scalar(len(known), pa.int32())))
                    ids = pa.concat_arrays([known_ids, _encode_words(tokenizer, strange.to_pylist())])
                local = offsets[start : stop + 1] - offsets[start]
                joined = _as_binary_rows(ids.take(index), local[:-1], local[1:])
                yield pa.record_batch([b.column(0).slice(start, stop - start), joined.cast(pa.binary())], names=["id", "ids"])

    return run


def _split_and_table(docs: DataFrame, path: str, id_col: str, text_col: str, words: pa.Table | None):
    """Documents as (id, words), and the word table as a broadcast."""
    bound_batches(docs.sparkSession)
    if words is None:
        words = word_table(docs, path, text_col)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, words.schema) as w:
        w.write_table(words)
    split = docs.select(ticked(id_col).alias("id"), split_words(ticked(text_col).cast("string"), list(special_tokens(path))).alias("words"))
    return split, docs.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", words: pa.Table | None = None) -> DataFrame:
    """(id, ids): ids is the little-endian unsigned 32-bit ids of the text, as one binary value."""
    split, shared = _split_and_table(docs, path, id_col, text_col, words)
    return split.mapInArrow(_encoding(shared, path), f"id {split.schema['id'].dataType.simpleString()}, ids binary")


def piece_table(path: str) -> pa.Array:
    """Bytes of every id of the vocabulary, by id: the fixed table that decoding joins with."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    pieces = {i: bytes(byte_of[c] for c in piece) for piece, i in spec["model"]["vocab"].items()}
    pieces |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    return pa.array([pieces.get(i, b"") for i in range(max(pieces) + 1)], pa.large_binary())


def _decoding(path: str):
    """Batches (id, ids) to batches (id, ids, decoded)."""

    def run(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        pieces = piece_table(path)
        for b in batches:
            raw = b.column(1)
            ends = np.frombuffer(raw.buffers()[1], "<i4")[raw.offset : raw.offset + len(raw) + 1]
            for start, stop in _slices(np.diff(ends), BATCH_BYTES):
                # A binary column's bytes need not start on a 4-byte border of the buffer.
                ids = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[ends[start] : ends[stop]].view("<u4")
                at = (ends[start : stop + 1] - ends[start]).astype(np.int64) // 4
                rows = _as_binary_rows(pieces.take(pa.array(ids)), at[:-1], at[1:])
                try:
                    text = rows.cast(pa.large_string())
                except pa.ArrowInvalid:
                    text = pa.array([x.decode("utf-8", "replace") for x in rows.to_pylist()], pa.large_string())
                some = b.slice(start, stop - start)
                yield pa.record_batch([some.column(0), some.column(1), text.cast(pa.string())], names=["id", "ids", "decoded"])

    return run


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """encoded (id, ids) with the decoded text added; bytes that are not UTF-8 become U+FFFD."""
    return encoded.mapInArrow(_decoding(path), f"id {encoded.schema['id'].dataType.simpleString()}, ids binary, decoded string")


def encode_and_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", words: pa.Table | None = None) -> DataFrame:
    """decode_documents(encode_documents(...)) in one pass: one Python worker a task instead of two."""
    split, shared = _split_and_table(docs, path, id_col, text_col, words)
    encode, decode = _encoding(shared, path), _decoding(path)
    return split.mapInArrow(lambda batches: decode(encode(batches)), f"id {split.schema['id'].dataType.simpleString()}, ids binary, decoded string")


def op2_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    found = encode_and_decode(table(spark, sf_dir, "documents"), path)
    return found.select(
        F.col("id").alias("doc_id"),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
