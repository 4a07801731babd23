"""Suffix-array dedup: removes every byte of a string of ``LENGTH`` bytes that also starts in a
document with a smaller id.

1. Texts are hashed (SHA-256) and written once, bucketed by a number of the row. Of equal texts only
   one of the smallest id is sorted, and those of larger ids lose everything.
2. Pruning. A window of LENGTH bytes is represented by its anchor, the leftmost of its 16-byte
   grams of least hash. Equal windows have equal anchors, so windows whose anchor occurs in one
   document only can't repeat. Anchor hashes are dealt out in packed rows, 4 bytes each.
3. The windows of shared anchors are cut out as segments (neighbouring windows of one anchor)
   and dealt to shards by anchor, so equal windows meet in a shard.
4. A window whose hash no other window of the distinct segments of its shard has is in one of them
   only, so the smallest id of its copies decides. Of the distinct stretches that the other windows cover each
   shard sorts the suffixes by external induced sorting (``induced_sort``), which also carries the common
   prefixes. Neighbours in the suffix array that share LENGTH bytes are equal windows; the smallest id of
   a run decides for all of it.
5. Intervals to remove go back to the texts by id.

Hot passages. What a batch of texts can decide alone never leaves it: an anchor that two of its texts
have is shared, and a segment that a smaller id of the batch has too goes. So a batch sends an anchor
or a segment once, however many of its texts hold it.

Memory. A step holds a batch of texts (of ``MOST_STEP`` bytes at most), the anchors of one bucket, or ``MEMORY`` bytes of a shard.
The texts, suffixes, queues and occurrences of a shard beyond that are in files of the task's own
folder, which go when it ends; beside them a task has filters of windows of at most 48 MB, a memo of ``MEMO_BYTES``,
and some numbers a segment. Numbers of buckets and shards follow the bytes of the texts.

Defined results. Null text: empty. Texts under LENGTH bytes lose nothing. Null doc_id: nothing is
removed, and it removes nothing. A doc_id repeated, with one text or several: each row loses what starts in a
text of a smaller id, and nothing to rows of its own id. Very long texts are cut into pieces that overlap by a
window. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import join_groups, shared_dir, spool
from annalist.llm.induced_sort import MEMORY, Buckets, Scratch, suffixes

LENGTH = 50
GRAM = 16
SPREAD = LENGTH - GRAM + 1  # grams in a window
#: Bytes of text handled at a time, at least and at most: a batch sends a row to every bucket and shard, so it grows with their number.
STEP, MOST_STEP = 2 << 20, 16 << 20
#: Bytes of texts a bucket of anchors, a shard of segments, and a task of either.
BUCKET_BYTES, SHARD_BYTES, TASK_BYTES = 6 << 20, 3 << 20, 256 << 20
#: Beyond so many shards a batch grows with them.
STEP_SHARDS = 256
#: Positions hashed at a time, so that the steps of a hash stay in the processor's cache.
CACHED = 1 << 14
#: Bytes of distinct segments that a shard remembers to collapse copies; beyond it remembers anew.
MEMO_BYTES = 32 << 20
#: Windows of a shard whose hashes are sorted at a time, about.
PART_WINDOWS = 1 << 20
_M = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the GRAM bytes at each position."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    mult, k = _M, 1
    while k < GRAM:
        h = h[:-k] * mult + h[k:]
        with np.errstate(over="ignore"):
            mult = mult * mult
        k *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def window_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the LENGTH symbols at each position."""
    powers = {1: (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)}
    powers[1] ^= powers[1] >> np.uint64(32)
    mult, k, mults = _M, 1, {}
    with np.errstate(over="ignore"):
        while k <= LENGTH:
            mults[k] = mult
            if 2 * k <= LENGTH:
                powers[2 * k] = powers[k][:-k] * mult + powers[k][k:]
            mult, k = mult * mult, 2 * k
    n, out, at = len(data) - LENGTH + 1, None, 0
    for k in sorted(powers, reverse=True):
        if LENGTH & k:
            part = powers[k][at : at + n]
            out = part if out is None else out * mults[k] + part
            at += k
    out = out ^ (out >> np.uint64(31))
    return out * np.uint64(0xBF58476D1CE4E5B9)


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    k = 1
    while 2 * k <= width:
        values = np.minimum(values[:-k], values[k:])
        k *= 2
    if k < width:
        values = np.minimum(values[: len(values) - (width - k)], values[width - k :])
    return values


def window_anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups of neighbouring windows of one anchor: first window of each group, anchor hash.

    data is at least LENGTH long. The anchor of a window is its leftmost gram of least hash.
    """
    n = len(data) - LENGTH + 1
    least = np.empty(n, np.uint64)
    for a in range(0, n, CACHED):
        least[a : a + CACHED] = _sliding_min(gram_hashes(data[a : a + CACHED + LENGTH - 1]), SPREAD)
    turn = np.flatnonzero(least[1:] != least[:-1]) + 1
    starts = np.r_[0, turn]
    # a run of one least value may hold several grams of that value: cut where the leftmost leaves
    stops = np.r_[turn, n]
    long = np.flatnonzero(stops - starts > SPREAD)
    single = np.ones(len(starts), bool)
    extra_start: list[np.ndarray] = []
    extra_hash: list[np.ndarray] = []
    for g in long:
        a, b = int(starts[g]), int(stops[g])
        spots = np.flatnonzero(gram_hashes(data[a : b + LENGTH - 1]) == least[a]) + a
        lead = spots[np.searchsorted(spots, np.arange(a, b))]
        cut = np.flatnonzero(np.r_[True, lead[1:] != lead[:-1]]) + a
        extra_start.append(cut)
        extra_hash.append(np.full(len(cut), least[a]))
        single[g] = False
    first, value = starts[single], least[starts[single]]
    if extra_start:
        first = np.concatenate([first, *extra_start])
        value = np.concatenate([value, *extra_hash])
        order = np.argsort(first, kind="stable")
        first, value = first[order], value[order]
    return first, value


def _key(anchor: np.ndarray) -> np.ndarray:
    """The bits of an anchor's hash that find shared ones, beside those of its bucket."""
    return (anchor & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _bucket(anchor: np.ndarray, n: int) -> np.ndarray:
    return ((anchor >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values starts and stops; none of nothing."""
    turn = np.flatnonzero(values[1:] != values[:-1]) + 1
    bounds = np.r_[0, turn, len(values)] if len(values) else np.empty(0, np.int64)
    return bounds[:-1], bounds[1:]


def _joined(pieces: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces (id, offset, bytes, ..) end to end: ids, offsets, where each starts, the bytes."""
    ids = np.array([p[0] for p in pieces], np.int64)
    offsets = np.array([p[1] for p in pieces], np.int64)
    starts = np.cumsum([0, *(len(p[2]) for p in pieces)])
    return ids, offsets, starts, np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)


def _groups(starts: np.ndarray, data: np.ndarray):
    """(first window, anchor, windows in group, row) over texts laid end to end."""
    first, anchor = window_anchors(data)
    # windows that cross a text's end are none; a group may lose its tail or be cut in two
    row = np.searchsorted(starts, first, "right") - 1
    edge = starts[1:-1]
    first = np.concatenate([first, edge])
    at = np.searchsorted(first[: len(anchor)], edge, "right") - 1
    anchor, row = np.concatenate([anchor, anchor[at]]), np.concatenate([row, np.arange(1, len(starts) - 1)])
    order = np.argsort(first, kind="stable")  # an edge comes behind a group that starts there, and stays
    first, anchor, row = first[order], anchor[order], row[order]
    keep = np.r_[first[1:] != first[:-1], True]
    first, anchor, row = first[keep], anchor[keep], row[keep]
    stop = np.r_[first[1:], len(data) - LENGTH + 1]
    stop = np.minimum(stop, starts[row + 1] - LENGTH + 1)
    live = stop > first
    return first[live], anchor[live], (stop - first)[live], row[live]


def _batch_number(ids: np.ndarray) -> int:
    """A number of 30 bits, spread, by the first text of a batch."""
    return (int(ids[0]) * 0x9E3779B97F4A7C15 >> 20) & 0x3FFFFFFF


def _batched(batches: Iterator[pa.RecordBatch], step: int) -> Iterator[list[tuple]]:
    """Rows (text_id, body, ..) as pieces (text_id, offset, bytes, ..), in lists of about so many bytes.

    A longer text is cut so that every window lies in one piece.
    """
    held, size = [], 0
    for b in batches:
        for row in zip(*b.columns, strict=True):
            text_id, body, *rest = (x.as_py() for x in row)
            for at in range(0, max(1, len(body) - LENGTH + 1), STEP):
                piece = body[at : at + STEP + LENGTH - 1]
                held.append((text_id, at, piece, *rest))
                size += len(piece)
                if size >= step:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def anchors(texts: DataFrame, n_buckets: int, step: int = STEP) -> DataFrame:
    """(bucket, batch, keys, ids, counts): per batch and bucket the distinct anchor keys of each text, by its number.

    Rows of batch -1 are to be compared with those of other batches. An anchor of several texts of a
    batch is there once; all its texts are in rows under the batch's own number, as shared already.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pieces in _batched(batches, step):
            ids, _, starts, data = _joined(pieces)
            number = _batch_number(ids)
            _, anchor, _, row = _groups(starts, data)
            own = (_bucket(anchor, n_buckets).astype(np.uint64) << np.uint64(32)) | _key(anchor)
            order = np.lexsort((ids[row], own))
            own, doc = own[order], ids[row][order]
            fresh = np.r_[True, (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])]
            own, doc = own[fresh], doc[fresh]
            head, tail = _runs(own)
            several = np.repeat(tail - head > 1, tail - head)
            first = np.zeros(len(own), bool)
            first[head] = True
            out: list[list] = [[], [], [], [], []]
            for batch, pick in ((-1, first), (number, several)):
                bucket, key, of = (own[pick] >> np.uint64(32)).astype(np.int64), own[pick].astype(np.uint32), doc[pick]
                by = np.lexsort((of, bucket))
                bucket, key, of = bucket[by], key[by], of[by]
                for a, b in zip(*_runs(bucket), strict=True):
                    begin, stop = _runs(of[a:b])
                    values = int(bucket[a]), batch, key[a:b].tobytes(), of[a:b][begin].tobytes(), (stop - begin).astype(np.uint32).tobytes()
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int32()) for c in out[:2]), *(pa.array(c, pa.binary()) for c in out[2:])],
                ["bucket", "batch", "keys", "ids", "counts"],
            )

    long_enough = texts.filter(F.octet_length("body") >= LENGTH).select("text_id", "body")
    return long_enough.mapInArrow(run, "bucket int, batch int, keys binary, ids binary, counts binary")


def shared_anchors(packed: DataFrame, n_buckets: int, n_tasks: int) -> DataFrame:
    """(text_id, keys): for each text the anchors that another text has too: a list of blobs, each
    the bucket and then its keys, in 32 bits each."""

    def matched(bucket: int, compared: bool, parts: list[tuple[bytes, bytes, bytes]]) -> pa.RecordBatch:
        key = np.concatenate([np.frombuffer(k, np.uint32) for k, _, _ in parts])
        doc = np.concatenate([np.repeat(np.frombuffer(i, np.int64), np.frombuffer(c, np.uint32)) for _, i, c in parts])
        if compared:
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            head, tail = _runs(key)
            shared = np.repeat(doc[head] != doc[tail - 1], tail - head)
            key, doc = key[shared], doc[shared]
        order = np.argsort(doc, kind="stable")
        key, doc = key[order], doc[order]
        begin, stop = _runs(doc)
        mark = np.uint32(bucket).tobytes()
        blobs = [mark + key[a:b].tobytes() for a, b in zip(begin, stop, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(doc[begin], pa.int64()), pa.array(blobs, pa.binary())], ["text_id", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, parts = None, []
        for b in batches:
            for bucket, batch, *blobs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (bucket, batch) != open_:
                    if parts:
                        yield matched(open_[0], open_[1] < 0, parts)
                    open_, parts = (bucket, batch), []
                parts.append(tuple(blobs))
        if parts:
            yield matched(open_[0], open_[1] < 0, parts)

    dealt = _dealt(packed, n_tasks, "bucket", "batch")
    return dealt.mapInArrow(run, "text_id long, keys binary").groupBy("text_id").agg(F.collect_list("keys").alias("keys"))


def _dealt(rows: DataFrame, n_tasks: int, *by: str) -> DataFrame:
    """Rows by key, in more tasks than the session's shuffles have where the input asks for it."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n_tasks, *by) if n_tasks > parts else rows.repartition(*by)
    return dealt.sortWithinPartitions(*by)


def _wide(blobs: list[bytes]) -> np.ndarray:
    """bucket << 32 | key of the anchors in blobs of shared_anchors."""
    size = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
    flat = np.frombuffer(b"".join(blobs), np.uint32).astype(np.uint64)
    head = np.cumsum(size) - size
    keys = np.ones(len(flat), bool)
    keys[head] = False
    return (np.repeat(flat[head], size - 1) << np.uint64(32)) | flat[keys]


#: The buffers of one batch of segments for one shard, and their types.
_PACKED = (("data", np.uint8), ("sizes", np.uint32), ("of", np.uint32), ("ids", np.int64), ("texts", np.int64), ("starts", np.int64))


def segments(texts: DataFrame, shared: DataFrame, n_buckets: int, n_shards: int, step: int = STEP) -> DataFrame:
    """(shard, packed): segments of the windows of shared anchors, per batch of texts and shard.

    A blob holds the distinct segments of the batch once (data, sizes) and, for each occurrence in
    texts of smallest id, which one it is, its id and text and where it starts (of, ids, texts, starts);
    compressed. The other occurrences go anyway: their intervals are in one blob a batch, under a
    negative number of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = zstandard.ZstdCompressor(level=1)
        for pieces in _batched(batches, step):
            texts_of, offsets, starts, data = _joined(pieces)
            ids = np.array([p[3] for p in pieces], np.int64)
            first, anchor, windows, row = _groups(starts, data)
            own = (_bucket(anchor, n_buckets).astype(np.uint64) << np.uint64(32)) | _key(anchor)
            wanted = np.sort(_wide([blob for p in pieces for blob in p[4]]))
            spot = np.searchsorted(wanted, own)
            pick = spot < len(wanted)
            pick[pick] = wanted[spot[pick]] == own[pick]
            first, anchor, windows, row = first[pick], anchor[pick], windows[pick], row[pick]
            shard = (anchor % np.uint64(n_shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            first, row, shard = first[order], row[order], shard[order]
            stop = first + windows[order] + LENGTH - 1
            begin, doc, text = first - starts[row] + offsets[row], ids[row], texts_of[row]
            raw = data.tobytes()
            shards, blobs, goes = [], [], []
            for a, b in zip(*(x.tolist() for x in _runs(shard)), strict=True):
                seen: dict[bytes, int] = {}
                of = np.array([seen.setdefault(raw[x:y], len(seen)) for x, y in zip(first[a:b].tolist(), stop[a:b].tolist(), strict=True)], np.uint32)
                own, at, size, which = doc[a:b], begin[a:b], stop[a:b] - first[a:b], text[a:b]
                least = np.full(len(seen), np.iinfo(np.int64).max)
                np.minimum.at(least, of, own)
                later = own > least[of]
                if later.any():
                    goes.append(np.stack([which[later], at[later], at[later] + size[later]]))
                    of, own, at, which = of[~later], own[~later], at[~later], which[~later]
                buffers = (
                    b"".join(seen), np.fromiter(map(len, seen), np.uint32, len(seen)).tobytes(),
                    of.tobytes(), own.tobytes(), which.tobytes(), at.tobytes(),
                )
                sizes = np.array([len(x) for x in buffers], np.int64).tobytes()
                shards.append(int(shard[a]))
                blobs.append(codec.compress(sizes + b"".join(buffers)))
            if goes:
                shards.append(-1 - _batch_number(texts_of))
                blobs.append(codec.compress(np.concatenate(goes, axis=1).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(blobs, pa.binary())], ["shard", "packed"])

    joined = texts.join(shared.hint("merge"), "text_id").select("text_id", "body", "doc_id", "keys")
    return joined.mapInArrow(run, "shard int, packed binary")


class Shard:
    """The segments that meet in a shard: added blob by blob, then solved; large ones lie in files."""

    def __init__(self, memory: int):
        self.scratch = Scratch(memory)
        self.text = Buckets(self.scratch, 1, (np.uint16,))
        self.sizes = Buckets(self.scratch, 1, (np.int64,))
        self.rows = Buckets(self.scratch, 1, (np.int64,) * 4)
        self.seen: dict[bytes, int] = {}
        self.seen_bytes = 0
        self.count = 0
        self.codec = zstandard.ZstdDecompressor()

    def add(self, blob: bytes) -> None:
        raw = self.codec.decompress(blob)
        at, parts = 8 * len(_PACKED), []
        for n, (_, kind) in zip(np.frombuffer(raw[:at], np.int64).tolist(), _PACKED, strict=True):
            parts.append(np.frombuffer(raw, kind, n // np.dtype(kind).itemsize, at))
            at += n
        data, sizes, of, ids, texts, starts = parts
        stop = np.cumsum(sizes, dtype=np.int64)
        body = data.tobytes()
        place, fresh = np.empty(len(sizes), np.int64), []
        for k, (x, y) in enumerate(zip((stop - sizes).tolist(), stop.tolist(), strict=True)):
            segment = body[x:y]
            number = self.seen.get(segment)
            if number is None:
                if self.seen_bytes >= MEMO_BYTES:
                    self.seen.clear()
                    self.seen_bytes = 0
                self.seen_bytes += len(segment) + 100
                number = self.seen[segment] = self.count
                self.count += 1
                fresh.append(segment)
            place[k] = number
        if fresh:
            # symbols: bytes from 2, the end of a segment 1
            size = np.fromiter(map(len, fresh), np.int64, len(fresh))
            own = np.frombuffer(b"".join(fresh), np.uint8).astype(np.uint16) + np.uint16(2)
            self.text.put(0, (np.insert(own, np.cumsum(size), np.uint16(1)),))
            self.sizes.put(0, (size,))
        self.rows.put(0, (place[of], ids, texts, starts))

    def _filled(self, n: int, dtype, parts: Iterator[np.ndarray]) -> np.ndarray:
        out, at = self.scratch.array(n, dtype), 0
        for part in parts:
            out[at : at + len(part)] = part
            at += len(part)
        return out

    def _least_windows(self, x, of, base, windows, least) -> np.ndarray:
        """For each position the smallest id of its window: that of the run of equal windows."""
        best = self._filled(len(x), np.int64, (least[of[a : a + (1 << 20)]] for a in range(0, len(x), 1 << 20)))
        # a run that goes on beyond the block: its least id, and its windows
        open_low, open_rows = None, Buckets(self.scratch, 1, (np.int64,))

        def close() -> None:
            nonlocal open_low
            for (held,) in open_rows.each(0):
                best[held] = open_low
            open_rows.held[0].clear()
            open_low = None

        for position, prefix in suffixes(x, 258, LENGTH, self.scratch):
            position = np.asarray(position)
            segment = of[position]
            own = position - base[segment] < windows[segment]
            # a suffix that ends before a window's length shares none with a window, so it parts runs
            position, segment, head = position[own], segment[own], prefix[own] < LENGTH
            if not len(position):
                continue
            ids = least[segment]
            border = np.flatnonzero(head)
            lead = int(border[0]) if len(border) else len(head)
            if lead and open_low is not None:
                open_low = min(open_low, int(ids[:lead].min()))
                open_rows.put(0, (position[:lead].astype(np.int64),))
            if not len(border):
                continue
            if open_low is not None:
                close()
            low = np.minimum.reduceat(ids, border)
            last = int(border[-1])
            best[position[lead:last]] = np.repeat(low[:-1], np.diff(border))
            open_low = int(low[-1])
            open_rows.put(0, (position[last:].astype(np.int64),))
        if open_low is not None:
            close()
        return best

    def _stretches(self, x: np.ndarray) -> np.ndarray:
        """Marks the symbols that windows of a hash found twice cover.

        The hashes are dealt to parts by their first bits, and a part is sorted at a time; one of many more windows than
        ``PART_WINDOWS`` holds a hot hash, and all of its windows count as found twice.
        """
        n, step = len(x), 4 * CACHED
        bits = (n // PART_WINDOWS).bit_length()
        parts = Buckets(self.scratch, 1 << bits, (np.uint64, np.int64))
        for a in range(0, n - LENGTH + 1, step):
            part = np.asarray(x[a : min(n, a + step + LENGTH - 1)])
            ends = np.concatenate([[0], np.cumsum(part == 1)])
            place = np.flatnonzero(ends[LENGTH:] == ends[:-LENGTH])
            hashes = window_hashes(part)[place]
            of = (hashes >> np.uint64(63 - bits) >> np.uint64(1)).astype(np.int64)
            by = np.argsort(of, kind="stable") if bits else slice(None)
            parts.deal(of[by], (hashes[by], place[by] + a))
        twice = self.scratch.array(n, bool)
        twice[:] = False
        for k in range(1 << bits):
            if sum(map(parts._size, parts.held[k])) > 4 * PART_WINDOWS:
                for _, place in parts.each(k):
                    twice[place] = True
            elif (rows := parts.front(k, n)) is not None:
                by = np.argsort(rows[0])
                hashes, place = rows[0][by], rows[1][by]
                same = hashes[1:] == hashes[:-1]
                twice[place[1:][same]] = True
                twice[place[:-1][same]] = True
        covered = self.scratch.array(n, bool)
        covered[:] = False
        for a in range(0, n - LENGTH + 1, step):
            b = min(n - LENGTH + 1, a + step)
            starts = np.zeros(b - a + LENGTH, np.int32)
            starts[: b - a] = twice[a:b]
            reach = np.cumsum(starts)
            reach[LENGTH:] -= reach[:-LENGTH].copy()
            covered[a : b + LENGTH - 1] |= reach[: b - a + LENGTH - 1] > 0
        return covered

    def _pieces(self, x: np.ndarray, covered: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each covered stretch begins and stops, and the stretches end to end, each with its end
        symbol, and the end of all."""
        begins, stops, texts = [], [], Buckets(self.scratch, 1, (np.uint16,))
        step, before = 1 << 20, False
        for a in range(0, len(x), step):
            own = np.asarray(covered[a : a + step])
            turn = np.flatnonzero(own != np.concatenate([[before], own[:-1]]))
            begins.append(turn[own[turn]] + a)
            stops.append(turn[~own[turn]] + a)
            part = np.where(own, x[a : a + step], 1).astype(np.uint16)
            keep = own.copy()
            keep[turn] = True
            texts.put(0, (part[keep],))
            before = bool(own[-1])
        begin, stop = np.concatenate(begins), np.concatenate(stops)
        joined = self.scratch.array(int((stop - begin + 1).sum()) + 1, np.uint16)
        at = 0
        for (part,) in texts.each(0):
            joined[at : at + len(part)] = part
            at += len(part)
        joined[-1] = 0
        return begin, stop, joined

    def _collapsed(self, size: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which distinct piece each piece is; sizes of the distinct ones, and those end to end."""
        memo: dict[bytes, int] = {}
        held, number, fresh_sizes = 0, np.empty(len(size), np.int64), []
        texts = Buckets(self.scratch, 1, (np.uint16,))
        stop = np.cumsum(size + 1)
        count, step = 0, 1 << 14
        for a in range(0, len(size), step):
            b = min(len(size), a + step)
            base = int(stop[a] - size[a] - 1)
            part = np.asarray(x[base : int(stop[b - 1])])
            raw, ends = part.tobytes(), 2 * (stop[a:b] - base)
            fresh = np.zeros(b - a, bool)
            for k, (z, n) in enumerate(zip(ends.tolist(), size[a:b].tolist(), strict=True)):
                piece = raw[z - 2 * n - 2 : z]
                found = memo.get(piece)
                if found is None:
                    if held >= MEMO_BYTES:
                        memo.clear()
                        held = 0
                    held += len(piece) + 100
                    found = memo[piece] = count
                    count += 1
                    fresh[k] = True
                number[a + k] = found
            fresh_sizes.append(size[a:b][fresh])
            texts.put(0, (part[np.repeat(fresh, size[a:b] + 1)],))
        distinct = np.concatenate(fresh_sizes) if fresh_sizes else size
        joined = self._filled(int((distinct + 1).sum()) + 1, np.uint16, (t for (t,) in texts.each(0)))
        joined[-1] = 0
        return number, distinct, joined

    def solve(self) -> Iterator[pa.RecordBatch]:
        """(text_id, begin, stop) of runs of windows that also start in a text of smaller id."""
        self.seen = {}
        size = self._filled(self.count, np.int64, (s for (s,) in self.sizes.each(0)))
        least = np.full(self.count, np.iinfo(np.int64).max)
        for which, ids, _, _ in self.rows.each(0):
            np.minimum.at(least, which, ids)
        ends = np.cumsum(size + 1)
        whole = self._filled(int(ends[-1]), np.uint16, (t for (t,) in self.text.each(0)))
        begin, stop, x = self._pieces(whole, self._stretches(whole))
        segment = np.searchsorted(ends, begin, "right")
        offset = begin - (ends - size - 1)[segment]
        number, distinct, x = self._collapsed(stop - begin, x)
        low = np.full(len(distinct), np.iinfo(np.int64).max)
        np.minimum.at(low, number, least[segment])
        gone, first, last = self._smaller_elsewhere(x, distinct, low)
        # a piece that a smaller id has too goes whole; its least ids lose what is smaller elsewhere
        later = np.flatnonzero(least[segment] > low[number])
        own = np.flatnonzero(least[segment] == low[number])
        count = np.bincount(gone, minlength=len(distinct))
        own, span = _spread(own, (np.cumsum(count) - count)[number[own]], count[number[own]])
        by = np.concatenate([segment[later], segment[own]])
        from_ = np.concatenate([offset[later], offset[own] + first[span]])
        to = np.concatenate([offset[later] + (stop - begin)[later], offset[own] + last[span] + LENGTH])
        order = np.argsort(by, kind="stable")
        by, from_, to = by[order], from_[order], to[order]
        # a copy under another id than the least goes whole as well
        count = np.bincount(by, minlength=self.count)
        lead = np.cumsum(count) - count
        for which, ids, texts, starts in self.rows.each(0, 1 << 15):
            later = ids > least[which]
            yield _spans(texts[later], starts[later], starts[later] + size[which[later]])
            row, span = _spread(np.flatnonzero(~later), lead[which[~later]], count[which[~later]])
            yield _spans(texts[row], starts[row] + from_[span], starts[row] + to[span])

    def _smaller_elsewhere(self, x: np.ndarray, size: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of windows of the pieces that a piece of smaller id has too: piece, first and last window."""
        found: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(3)]
        if len(size):
            base = np.cumsum(size + 1) - size - 1
            of = self._filled(len(x), np.int32 if len(size) < 2**31 else np.int64, self._owners(size))
            best = self._least_windows(x, of, base, size - LENGTH + 1, least)
            step = 1 << 16
            for a in range(0, len(size), step):
                b = min(len(size), a + step)
                lo, hi = int(base[a]), int(base[b]) if b < len(size) else len(x) - 1
                own = np.asarray(of[lo:hi])
                at = np.arange(lo, hi) - base[own]
                place = np.flatnonzero((at <= size[own] - LENGTH) & (best[lo:hi] < least[own]))
                if len(place):
                    # the end symbol of a piece is no window, so runs don't cross pieces
                    head = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1] + 1]))
                    tail = np.concatenate([head[1:], [len(place)]]) - 1
                    for column, values in zip(found, (own[place[head]], at[place[head]], at[place[tail]]), strict=True):
                        column.append(values.astype(np.int64))
        piece, first, last = (np.concatenate(c) for c in found)
        return piece, first, last

    @staticmethod
    def _owners(size: np.ndarray) -> Iterator[np.ndarray]:
        """The segment of each symbol; the end of all goes with the last one."""
        step = 1 << 16
        for a in range(0, len(size), step):
            yield np.repeat(np.arange(a, min(len(size), a + step)), size[a : a + step] + 1)
        yield np.array([len(size) - 1])


def _spread(rows: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row as many times as it counts, with the numbers from its first on."""
    return np.repeat(rows, count), np.repeat(first, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)


def _spans(ids: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (ids, begin, stop)], ["text_id", "begin", "stop"])


def intervals(packed: DataFrame, n_tasks: int, memory: int = MEMORY) -> DataFrame:
    """(text_id, spans): intervals of bytes to remove, from the shards."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[bytes]]]:
        rows = ((n.as_py(), blob.as_py()) for b in batches for n, blob in zip(*b.columns, strict=True))
        for number, group in groupby(rows, itemgetter(0)):
            yield number, (blob for _, blob in group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, blobs in shards(batches):
            if number < 0:
                for blob in blobs:
                    yield _spans(*np.frombuffer(zstandard.decompress(blob), np.int64).reshape(3, -1))
                continue
            shard = Shard(memory)
            with shard.scratch:
                for blob in blobs:
                    shard.add(blob)
                yield from shard.solve()

    found = _dealt(packed, n_tasks, "shard").mapInArrow(run, "text_id long, begin long, stop long")
    return found.groupBy("text_id").agg(F.collect_list(F.struct("begin", "stop")).alias("spans"))


def cut_out(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(text_id, n_removed, n_spans, kept_sha256, kept) of the texts that lose bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[], [], [], [], []]
            for text_id, body, spans in zip(*b.columns, strict=True):
                text = body.as_py()
                pairs = np.array([(s["begin"], s["stop"]) for s in spans.as_py()], np.int64)
                pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
                reach = np.maximum.accumulate(pairs[:, 1])
                head = np.flatnonzero(np.r_[True, pairs[1:, 0] > reach[:-1]])
                begin, stop = pairs[head, 0], reach[np.r_[head[1:], len(pairs)] - 1]
                kept = b"".join(text[a:z] for a, z in zip(np.r_[0, stop].tolist(), np.r_[begin, len(text)].tolist(), strict=True))
                values = (text_id.as_py(), int((stop - begin).sum()), len(begin), hashlib.sha256(kept).hexdigest(), kept)
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["text_id", "n_removed", "n_spans", "kept_sha256", "kept"]
            )

    joined = texts.join(spans.hint("merge"), "text_id").select("text_id", "body", "spans")
    return joined.mapInArrow(run, "text_id long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def stored_texts(docs: DataFrame, n_buckets: int) -> str:
    """Writes all rows (text_id, doc_id, sha, n_bytes, body) as a table bucketed by a number of the row,
    so that later joins on it don't shuffle texts again; the table's name."""
    body = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    rows = docs.select(F.monotonically_increasing_id().alias("text_id"), "doc_id", body.alias("body"))
    rows = rows.repartition(n_buckets, "text_id").withColumn("sha", F.sha2("body", 256)).withColumn("n_bytes", F.octet_length("body").cast("long"))
    name = f"texts_{uuid.uuid4().hex}"
    path = f"{shared_dir(docs.sparkSession)}/{name}"
    rows.write.format("parquet").option("compression", "zstd").bucketBy(n_buckets, "text_id").option("path", path).saveAsTable(name)
    return name


def dedup(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document; with keep_text
    also ``kept``, the remaining bytes of the documents that lose some, else null."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = stored_texts(docs, parts)
    texts = spark.table(name)
    keys = texts.select("text_id", "doc_id", "sha", "n_bytes")
    first = F.min(F.struct("doc_id", "text_id")).alias("first")
    known = keys.filter("doc_id is not null").groupBy("sha").agg(first, F.count(F.lit(1)).alias("n"))
    firsts = spool(known.select("sha", F.col("first.doc_id").alias("first_id"), F.col("first.text_id").alias("chosen"), "n"), "first-texts")
    size = keys.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    n_buckets, n_shards, n_tasks = (max(parts, -(-size // x)) for x in (BUCKET_BYTES, SHARD_BYTES, TASK_BYTES))
    step = min(MOST_STEP, max(STEP, STEP * n_shards // STEP_SHARDS))
    chosen = firsts.select(F.col("chosen").alias("text_id"))
    sorted_ = texts.join(chosen.hint("merge"), "text_id", "left_semi").select("text_id", "doc_id", "body")
    shared = spool(shared_anchors(anchors(sorted_, n_buckets, step), n_buckets, n_tasks), "shared-anchors")
    spans = spool(intervals(segments(texts, shared, n_buckets, n_shards, step), n_tasks), "spans")
    cut = cut_out(texts, spans).withColumnRenamed("text_id", "chosen")
    changed = spool(cut.drop(*([] if keep_text else ["kept"])), "cut")
    rows = spool(join_groups(keys, firsts, ["sha"], "left"), "text-keys")
    spark.sql(f"DROP TABLE {name}")  # the files stay with the other scratch tables
    copy = F.coalesce((F.col("first_id") < F.col("doc_id")) & (F.col("n_bytes") >= LENGTH), F.lit(False))
    mine = F.coalesce(F.col("first_id") == F.col("doc_id"), F.lit(False))
    empty = hashlib.sha256(b"").hexdigest()

    def result(of: DataFrame, removed, n_spans, sha, kept) -> DataFrame:
        values = [removed.cast("long").alias("n_removed"), n_spans.cast("long").alias("n_spans"), sha.alias("kept_sha256")]
        return of.select("doc_id", "n_bytes", *values, *([kept.cast("binary").alias("kept")] if keep_text else []))

    none, zero = F.lit(None), F.lit(0)
    own = rows.filter(mine).join(changed.hint("merge"), "chosen", "left")
    lost = F.col("n_removed").isNotNull()
    return (
        result(rows.filter(copy), F.col("n_bytes"), F.lit(1), F.lit(empty), F.lit(b""))
        .union(result(rows.filter(~copy & ~mine), zero, zero, F.col("sha"), none))
        .union(
            result(
                own, F.coalesce("n_removed", zero), F.coalesce("n_spans", zero), F.when(lost, F.col("kept_sha256")).otherwise(F.col("sha")),
                F.col("kept") if keep_text else none,
            )
        )
    )
