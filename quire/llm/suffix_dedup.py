"""Removal of long repeated byte strings, found by suffix arrays over shards of the corpus.

Removed is every byte covered by a string of `length` bytes that also starts earlier: in a document of
smaller id, or earlier in the same one. Strings are judged on the input, overlaps count, and matches never
cross documents.

A suffix array answers this for texts that fit one task, so the corpus is cut into shards that need not know
each other. Every window of `length` bytes has an anchor, its `gram`-byte substring of the least hash; equal
windows have equal anchors. Neighbouring windows with one anchor form a segment. Segments meet by the hash
of their anchor, as narrow rows without bytes:

* an anchor that occurs once decides nothing;
* of segments with equal contents all but the earliest are covered (a batch of documents settles that for its
  own segments before anything is shuffled, so a copied text or line costs one row a batch);
* anchors with several contents go on: their earliest segments are cut out of the texts and dealt, by anchor,
  to shards of a few MB. Each shard is sorted by induction (`suffix_array`), its permuted common prefixes are
  computed, and suffixes that share `length` bytes with a neighbour form classes; all but the earliest are covered.

Anchors too frequent for that: where a batch holds many contents of one anchor, their rows are dealt by content
and a marker makes the rest of the anchor's segments go on too; where an anchor has more than `MAX_CONTENTS`
contents, its windows become segments of their own (gram = length) and are decided by the first two rules.
Documents and contents are told apart by 64-bit hashes within an id or anchor.

Defined cases: a null text is empty; null ids come before all others; rows that share an id come in the order
of a hash of their text, and rows alike in id and text are one document and get the same result; texts of any
length are worked on in pieces; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm._shared import bound_batches, materialise, table, ticked
from quire.llm.suffix_array import later_repeats, permuted_prefixes, suffix_array

LENGTH, GRAM = 100, 48
#: Windows hashed at once, contents of one anchor in a batch from which they are dealt apart, and in all.
PIECE, LOCAL_HOT, MAX_CONTENTS = 1 << 18, 64, 8192
#: Bytes of a shard.
SHARD_BYTES = 2_000_000
NO_ID = -(1 << 63)

SEGMENTS = "a long, d long, doc long, th long, start int, len int, home long"
MARKS = "a long, doc long, th long, start int, len int"
SPANS = "doc long, th long, start int, len int"

_rng = np.random.default_rng(20240229)
_TABLES = _rng.integers(0, 1 << 62, (2, 256), np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Hasher:
    """Hashes of substrings by prefix sums, with two independent byte tables, for arrays of up to n bytes."""

    def __init__(self, n: int):
        self.up = [_powers(b, n) for b in _BASES]
        self.down = [_powers(pow(b, -1, 1 << 64), n) for b in _BASES]

    def sums(self, data: np.ndarray, which: int) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLES[which][data] * self.up[which][: len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, which: int, start, end) -> np.ndarray:
        return _mixed((sums[end] - sums[start]) * self.down[which][start])


def _least_in_windows(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def segments_of(data: np.ndarray, ends: np.ndarray, length: int, gram: int, hasher: Hasher, piece: int = PIECE):
    """(anchor, content, start, end) of the segments of concatenated texts that end at `ends`."""
    starts = np.concatenate([[0], ends[:-1]])
    room = np.zeros(len(data) + 1, np.int32)
    np.add.at(room, np.maximum(starts, ends - length + 1), 1)
    np.add.at(room, ends, -1)
    fits = np.cumsum(room[:-1]) == 0
    parts = []
    for at in range(0, max(len(data) - length + 1, 0), piece):
        some, ok = data[at : at + piece + length - 1], fits[at : at + piece]
        if not ok.any():
            continue
        one, two = hasher.sums(some, 0), hasher.sums(some, 1)
        n = len(some) - gram + 1
        grams = hasher.of(one, 0, slice(0, n), slice(gram, gram + n))
        # The leftmost of the least: hashes give up their low 20 bits for the place.
        low = np.uint64((1 << 20) - 1)
        least = (_least_in_windows((grams & ~low) | np.arange(n, dtype=np.uint64), length - gram + 1) & low).astype(np.int64)
        ok = ok[: len(least)]
        key = np.where(ok, least, -1)
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        first, last = edge[:-1], edge[1:]
        used = key[first] >= 0
        first, last = first[used], last[used] - 1 + length
        content = hasher.of(two, 1, first, last) ^ (last - first).astype(np.uint64)
        parts.append((grams[least[first]], content, first + at, last + at))
    if not parts:
        return [np.empty(0, np.uint64)] * 2 + [np.empty(0, np.int64)] * 2
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def _bytes_of(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary Arrow column without nulls, and the end of each value."""
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]


def _united(start: np.ndarray, end: np.ndarray, touching: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Intervals whose starts ascend, overlapping ones merged, and touching ones if asked for."""
    if not len(start):
        return start, end
    reach = np.maximum.accumulate(end)[:-1]
    at = np.flatnonzero(np.concatenate([[True], start[1:] > reach if touching else start[1:] >= reach]))
    return start[at], np.maximum.reduceat(end, at)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """True where sorted rows start a new value of any key."""
    out = np.zeros(len(keys[0]), bool)
    out[:1] = True
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


def _segment_batches(batches, length: int, gram: int, local_hot: int, piece: int):
    """Batches of (doc, th, base, bytes) to SEGMENTS rows, settled within each batch."""
    hasher = Hasher(piece + length)
    for b in batches:
        doc, th, base = (b.column(i).to_numpy() for i in range(3))
        data, ends = _bytes_of(b.column(3))
        a, d, start, end = segments_of(data, ends, length, gram, hasher, piece)
        row = np.searchsorted(ends, start, side="right")
        begin = np.concatenate([[0], ends[:-1]])
        # Documents by their order; rows of one document share a rank.
        by = np.lexsort((th, doc))
        rank = np.empty(len(by), np.int64)
        rank[by] = np.cumsum(_runs(doc[by], th[by])) - 1
        key = (rank[row] << 32) | (start - begin[row] + base[row])
        by = np.argsort(key, kind="stable")
        by = by[np.argsort(_mixed(a ^ (d * np.uint64(3)))[by], kind="stable")]
        first = _runs(a[by], d[by])
        earliest = by[np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))]
        later = np.sort(by[~first & (key[by] != key[earliest])])
        kept = by[first]
        s, e = _united(start[later], end[later])
        at = np.searchsorted(ends, s, side="right")
        out = [(th[at], None, at, s, e - s, None)]
        _, which, many = np.unique(a[kept], return_inverse=True, return_counts=True)
        hot = many[which] >= local_hot
        cold, apart = kept[~hot], kept[hot]
        out.append((a[cold].view(np.int64), d[cold], row[cold], start[cold], end[cold] - start[cold], None))
        if len(apart):
            out.append((_mixed(a[apart] ^ _mixed(d[apart])).view(np.int64), d[apart], row[apart], start[apart], end[apart] - start[apart], a[apart]))
            marks = np.unique(a[apart])
            at = np.zeros(len(marks), np.int64)
            out.append((marks.view(np.int64), None, at, at, at, marks))
        for k, d_, r, s, n, home in out:
            cols = [k, None if d_ is None else d_.view(np.int64), doc[r], th[r], (s - begin[r] + base[r]).astype(np.int32), n.astype(np.int32), None if home is None else home.view(np.int64)]
            arrays = [pa.nulls(len(r), pa.int64()) if c is None else pa.array(c) for c in cols]
            yield pa.record_batch(arrays, names=["a", "d", "doc", "th", "start", "len", "home"])


def _gathered(batches, rows: int = 50_000):
    """Batches joined up to about so many rows."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _decided_batches(batches):
    """Rows sorted by (a, d, doc, th, start), d null first, to MARKS: covered segments (a null) and those that go on."""
    last = None  # of the rows before: anchor, content, its earliest segment, whether its segments go on, and the segment if that is not known yet
    for t in _gathered(batches):
        a, doc, th, start, size = (t.column(c).to_numpy() for c in ("a", "doc", "th", "start", "len"))
        no_d, no_home = (np.asarray(t.column(c).is_null()) for c in ("d", "home"))
        d, home = (t.column(c).fill_null(0).to_numpy() for c in ("d", "home"))
        covers = [np.flatnonzero(no_d & no_home)]
        marked = np.unique(a[no_d & ~no_home])
        real = np.flatnonzero(~no_d)
        if len(real):
            ra, rd = a[real], d[real]
            first = _runs(ra, rd)
            if last and (ra[0], rd[0]) == last[:2]:
                first[0] = False
            at = np.maximum.accumulate(np.where(first, np.arange(len(real)), -1))
            lead = real[np.maximum(at, 0)]
            place = [np.where(at >= 0, x[lead], x0) for x, x0 in zip((doc, th, start), last[2] if last else (0, 0, 0), strict=True)]
            other = ~first & ((doc[real] != place[0]) | (th[real] != place[1]) | (start[real] != place[2]))
            covers.append(real[other])
            heads = real[first]
            ha = a[heads]
            same = np.zeros(len(heads) + 1, bool)
            same[1:-1] = ha[1:] == ha[:-1]
            same[0] = bool(last) and len(heads) > 0 and ha[0] == last[0]
            goes = same[:-1] | same[1:] | np.isin(ha, marked) | ~no_home[heads]
            if last:
                goes |= (ha == last[0]) & last[3]
                if last[4] is not None and same[0]:
                    yield last[4]
            unknown = None
            if len(heads):
                if not goes[-1]:
                    h = heads[-1]
                    unknown = _marks(*(x[[h]] for x in (a, doc, th, start, size)))
                on = heads[goes]
                yield _marks(np.where(no_home[on], a[on], home[on]), doc[on], th[on], start[on], size[on])
                h = heads[-1]
                last = (a[h], d[h], (doc[h], th[h], start[h]), bool(goes[-1]), unknown)
        c = np.concatenate(covers)
        yield _marks(None, doc[c], th[c], start[c], size[c])
        if len(marked) and (last is None or a[-1] != last[0]):
            # A marker at the end speaks for rows yet to come.
            if a[-1] == marked[-1]:
                last = (a[-1], None, (0, 0, 0), True, None)


def _marks(a, doc, th, start, size):
    first = pa.nulls(len(doc), pa.int64()) if a is None else pa.array(a)
    return pa.record_batch([first, *map(pa.array, (doc, th, start, size))], names=["a", "doc", "th", "start", "len"])


def settled_segments(texts: DataFrame, length: int, gram: int, local_hot: int = LOCAL_HOT, piece: int = PIECE) -> DataFrame:
    """MARKS of texts (doc, th, base, text): spans that are covered (a null), and segments that need their bytes."""
    rows = texts.mapInArrow(partial(_segment_batches, length=length, gram=gram, local_hot=local_hot, piece=piece), SEGMENTS)
    return rows.repartition("a").sortWithinPartitions("a", "d", "doc", "th", "start").mapInArrow(_decided_batches, MARKS)


def _shard_batches(batches, length: int):
    """All segments of a partition, in the order of their documents: what is covered among them."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held).combine_chunks()
    doc, th, start = (t.column(c).to_numpy() for c in ("doc", "th", "start"))
    new = _runs(doc, th, start)
    t = t.filter(pa.array(new))
    doc, th, start = doc[new], th[new], start[new]
    data, ends = _bytes_of(t.column("bytes").combine_chunks())
    # Bytes move up by two: 1 ends a segment, 0 the text. UTF-8 has no byte above 244.
    stops = ends + np.arange(len(ends))
    text = np.ones(len(data) + len(ends) + 1, np.uint8)
    inside = np.ones(len(text), bool)
    inside[stops], inside[-1], text[-1] = False, False, 0
    text[inside] = data + np.uint8(2)
    begin = np.concatenate([[0], stops[:-1] + 1])
    room = np.append(np.repeat(stops, stops - begin + 1), len(text) - 1) - np.arange(len(text))
    sa = suffix_array(text, 256)
    found = np.sort(later_repeats(sa, permuted_prefixes(text, sa, room), length)).astype(np.int64)
    s, e = _united(found, found + length)
    at = np.searchsorted(stops, s, side="right")
    yield pa.record_batch([pa.array(doc[at]), pa.array(th[at]), pa.array((s - begin[at] + start[at]).astype(np.int32)), pa.array((e - s).astype(np.int32))], names=["doc", "th", "start", "len"])


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, doc, th, text): the key that orders documents, and the text in bytes."""
    text = F.coalesce(ticked(text_col).cast("string"), F.lit("")).cast("binary")
    return docs.select(ticked(id_col).alias("id"), F.coalesce(ticked(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("th"), text.alias("text"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, max_contents: int = MAX_CONTENTS, local_hot: int = LOCAL_HOT, shard_bytes: int = SHARD_BYTES, piece: int = PIECE) -> DataFrame:
    """SPANS of identified docs that are covered; they may overlap and repeat."""
    bound_batches(docs.sparkSession)
    texts = docs.select("doc", "th", F.lit(0).alias("base"), "text")
    marks = materialise(settled_segments(texts, length, gram, local_hot, piece), "segments")
    covered, on = marks.where("a IS NULL").drop("a"), marks.where("a IS NOT NULL")
    counts = materialise(on.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("bytes")), "anchors")
    frequent = counts.where(F.col("n") > max_contents).select("a")
    size, some = counts.agg(F.sum(F.when(F.col("n") <= max_contents, F.col("bytes"))), F.max(F.col("n") > max_contents)).first()
    wanted = on.groupBy("doc", "th").agg(F.collect_set(F.struct("a", "start", "len")).alias("cut"))
    pieces = docs.select("doc", "th", "text").join(wanted, ["doc", "th"])
    slices = pieces.select("doc", "th", F.explode(F.transform("cut", lambda c: F.struct(c["a"].alias("a"), c["start"].alias("start"), F.substring("text", c["start"] + 1, c["len"]).alias("bytes")))).alias("x"))
    slices = slices.select("x.a", "doc", "th", "x.start", "x.bytes")
    out = [covered]
    if some:
        slices = materialise(slices, "slices")
        base = slices.join(frequent, "a", "left_semi").select("doc", "th", F.col("start").alias("base"), F.col("bytes").alias("text"))
        out.append(settled_segments(base, length, length, local_hot, piece).where("a IS NULL").drop("a"))
        slices = slices.join(frequent, "a", "left_anti")
    shards = max(1, -(-(size or 0) // shard_bytes))
    dealt = slices.repartition(shards, "a").sortWithinPartitions("doc", "th", "start")
    out.append(dealt.mapInArrow(partial(_shard_batches, length=length), SPANS))
    spans = out[0]
    for more in out[1:]:
        spans = spans.unionByName(more)
    return spans


def _cut_batches(batches, with_text: bool):
    for b in batches:
        cols = {n: b.column(n) for n in b.schema.names}
        data, ends = _bytes_of(cols["text"])
        begin = np.concatenate([[0], ends[:-1]])
        spans = cols["spans"]
        flat, offsets = spans.flatten(), np.concatenate([[0], np.cumsum(np.asarray(spans.value_lengths().fill_null(0)))])
        start, size = (flat.field(k).to_numpy() for k in (0, 1))
        n_removed, n_spans, digests, left = [], [], [], []
        for i in range(b.num_rows):
            some = slice(offsets[i], offsets[i + 1])
            by = np.argsort(start[some], kind="stable")
            s, e = _united(start[some][by].astype(np.int64), (start[some] + size[some])[by].astype(np.int64), touching=True)
            text = data[begin[i] : ends[i]]
            edges = np.concatenate([[0], np.column_stack([s, e]).ravel(), [len(text)]])
            kept = b"".join(text[edges[k] : edges[k + 1]].tobytes() for k in range(0, len(edges), 2))
            n_removed.append(len(text) - len(kept))
            n_spans.append(len(s))
            digests.append(hashlib.sha256(kept).hexdigest())
            if with_text:
                left.append(kept.decode("utf-8", "replace"))
        out = [cols["id"], pa.array((ends - begin).astype(np.int64)), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests, pa.string())]
        yield pa.record_batch(out + ([pa.array(left, pa.string())] if with_text else []), names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, **how) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256): one row per row of docs; with_text adds what is kept (a
    character that a cut leaves incomplete becomes a replacement character)."""
    rows = identified(docs, id_col, text_col)
    spans = repeated_spans(rows, **how).groupBy("doc", "th").agg(F.collect_list(F.struct("start", "len")).alias("spans"))
    kind = docs.schema[id_col].dataType.simpleString()
    found = rows.join(spans, ["doc", "th"], "left").select("id", "text", F.coalesce("spans", F.array().cast("array<struct<start:int,len:int>>")).alias("spans"))
    schema = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept string" if with_text else "")
    return found.mapInArrow(partial(_cut_batches, with_text=with_text), schema)


def op13_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
