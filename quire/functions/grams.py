"""Anchors of texts: a few places a text that any text containing one of its windows shares."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BASE, _BACK = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _raised(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, kept by the worker."""
    if len(_powers["up"]) < n:
        size = 1 << n.bit_length()
        for name, base in (("up", _BASE), ("down", _BACK)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"][:n], _powers["down"][:n]


#: Lengths of text behind an anchor that have a hash.
MARKS = (64, 256, 1024, 4096)


def _sums(text: str) -> np.ndarray:
    """Sums over the text's beginnings; any part's hash is a difference of two of them."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes + np.uint64(7)) * np.uint64(0xD6E8FEB86659FD93) * _raised(len(codes))[0], out=sums[1:])
    return sums


def marks_of(text: str, places: np.ndarray) -> list[list[int]]:
    """For each place the hashes of the MARKS characters from it on, as many as the text has."""
    sums = _sums(text)
    n, out = len(sums) - 1, [[] for _ in places]
    down = _raised(n)[1]
    for size in MARKS:
        held = np.flatnonzero(places + size <= n)
        at = places[held]
        for k, h in zip(held.tolist(), ((sums[at + size] - sums[at]) * down[at]).view(np.int64).tolist()):
            out[k].append(h)
    return out


def anchors_of(text: str, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes): for every window of `window` characters, its `gram` characters of the least hash, leftmost at ties."""
    sums = _sums(text)
    n = len(sums) - 1
    if n < window:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    down = _raised(n)[1]
    h = (sums[gram:] - sums[:-gram]) * down[: n - gram + 1]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    places = np.unique(np.lib.stride_tricks.sliding_window_view(h, window - gram + 1).argmin(1) + np.arange(n - window + 1))
    return places, h[places].view(np.int64)


#: Bits of a sieve of anchors: 64 for each anchor, at least one bitmap of Spark's, at most 32 MB.
SIEVE_BITS, LEAST_BITS, MOST_BITS = 6, 15, 28


def sieve(anchors: DataFrame, count: int) -> Broadcast:
    """A bit for each slot that a row of anchors(anchor) falls into, broadcast: no anchor of theirs is missed, few others pass.

    Spark makes the bitmaps, 4 KB for 32,768 slots; the driver lines them up, at most 32 MB whatever the count.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, count.bit_length() + SIEVE_BITS))
    slot = F.col("anchor").bitwiseAND(F.lit((1 << bits) - 1)) + 1
    maps = anchors.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).toArrow()
    out = np.zeros((1 << bits - LEAST_BITS, (1 << LEAST_BITS) // 8), np.uint8)
    for bucket, raw in zip(maps["bucket"].to_pylist(), maps["bits"].to_pylist()):
        out[bucket - 1] = np.frombuffer(raw, np.uint8)
    return anchors.sparkSession.sparkContext.broadcast(out.reshape(-1))


def passes(hashes: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which hashes fall into a slot of the sieve."""
    slots = hashes & np.int64(len(held) * 8 - 1)
    return (held[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1


def anchored(df: DataFrame, text: str, window: int, gram: int, first: bool = False, among: Broadcast | None = None) -> DataFrame:
    """df with (anchor, at, near, rest, marks) for each anchor of text, or that of its first window alone.

    `near` is the part of the text that any window around the anchor can cover, `at` the anchor's place in it,
    `rest` counts the characters from the anchor to the text's end, `marks` are their hashes, see marks_of.
    A text shorter than a window has no rows. With `among`, a sieve, anchors that it does not let pass have none either.
    """
    names, reach = df.columns, window - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                rows, hashes, at, near, rest, marks = [], [], [], [], [], []
                for k, value in enumerate(part.column(names.index(text)).to_pylist()):
                    places, found = anchors_of((value or "")[:window] if first else value or "", window, gram)
                    if among is not None:
                        some = passes(found, among.value)
                        places, found = places[some], found[some]
                    rows += [k] * len(places)
                    hashes.append(found)
                    if len(places):
                        marks += marks_of(value, places)
                    for p in places.tolist():
                        rest.append(len(value) - p)
                        at.append(min(p, reach))
                        near.append(value[max(p - reach, 0) : p + window])
                picked = part.drop_columns([text]).take(pa.array(rows, pa.int64()))
                extra = [pa.array(np.concatenate([np.empty(0, np.int64), *hashes])), pa.array(at, pa.int32()), pa.array(near, pa.string()), pa.array(rest, pa.int32()), pa.array(marks, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*picked.columns, *extra], names=[*picked.schema.names, "anchor", "at", "near", "rest", "marks"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != text]
    return df.withColumn(text, F.col(text).cast("string")).mapInArrow(run, ", ".join([*kinds, "anchor long", "at int", "near string", "rest int", "marks array<long>"]))
