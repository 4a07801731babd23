"""External induced suffix sorting with common-prefix values, for use inside a task.

As in eSAIS (Bingmann, Fischer, Osipov 2013): left-most-S suffixes are sorted by their substrings
in a first pair of scans and named, the string of names is sorted by recursion, and a second pair
of scans induces all suffixes from them. A scan takes tuples from a priority queue in the order
of their symbol, ties in the order of arrival, and puts the tuple of the suffix before each back.

* A queue is cut into buckets of neighbouring symbols; a bucket is sorted when its turn comes. What
  it induces into itself is found round by round before its order is fixed. A symbol that is too
  frequent for one block has a bucket of its own and is taken piece by piece.
* A tuple is (symbol, position, m): m is the least common prefix seen between the suffix that put
  it there and the one that put the tuple before it, so the common prefix of the two is m + 1. In
  the first pair of scans m only says whether two substrings are still equal, which gives the names.
* The recursion hands back the common prefixes of the names as well. Only what differs after
  them is compared in the text, and so are the borders between the two types of a symbol.

Values are cut off at ``depth`` symbols, and an order of suffixes that agree on so many is not
fixed. A name stands for two symbols at least, so each level needs half the depth of the one
before, and the recursion ends where equal names already agree to the depth.

Queues, stored suffixes and arrays are in memory up to a bound and in files of the task's
own folder beyond it; the same steps run either way. Texts in files are read at random through the
page cache of the machine.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np

#: Bytes of arrays and tuples of a sort that stay in memory.
MEMORY = 256 << 20
#: Tuples in a block: at least so many where there are as many, then a share of the text.
LEAST_BLOCK, BLOCK_SHARE = 1 << 14, 8
#: The prefix value of substrings that have not differed yet.
EQUAL = 255

Stream = Iterator[tuple[np.ndarray, np.ndarray]]


class Scratch:
    """Task-local memory and files of one sort; the files go when the block ends."""

    def __init__(self, memory: int = MEMORY):
        self.memory = memory
        self.folder: str | None = None

    def path(self) -> str:
        if self.folder is None:
            self.folder = tempfile.mkdtemp(prefix="induced-")
        handle, path = tempfile.mkstemp(dir=self.folder)
        os.close(handle)
        return path

    def array(self, n: int, dtype) -> np.ndarray:
        """An array of n values, not set; in a file if it is large."""
        if n * np.dtype(dtype).itemsize <= self.memory // 16:
            return np.empty(n, dtype)
        return np.memmap(self.path(), dtype, "w+", shape=(n,))

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        if self.folder is not None:
            shutil.rmtree(self.folder, ignore_errors=True)


class Buckets:
    """Rows of some columns in numbered buckets, each read from its front or from its back.

    Beyond a share of the memory the rows of all buckets go to a file, a run for each bucket.
    """

    def __init__(self, scratch: Scratch, count: int, kinds: tuple):
        self.scratch = scratch
        self.kinds = [np.dtype(k) for k in kinds]
        self.width = sum(k.itemsize for k in self.kinds)
        self.held: list[list] = [[] for _ in range(count)]
        self.bytes = 0
        self.file = None

    def put(self, bucket: int, columns: tuple) -> None:
        if not len(columns[0]):
            return
        self.held[bucket].append(columns)
        self.bytes += self.width * len(columns[0])
        if self.bytes > self.scratch.memory // 8:
            self._to_file()

    def deal(self, bucket: np.ndarray, columns: tuple) -> None:
        """Puts rows whose buckets come in runs."""
        if len(bucket):
            cut = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(bucket)], strict=True):
                self.put(int(bucket[a]), tuple(c[a:b] for c in columns))

    def _to_file(self) -> None:
        if self.file is None:
            self.file = open(self.scratch.path(), "w+b")  # noqa: SIM115 - the folder goes as a whole
        self.file.seek(0, 2)
        for pieces in self.held:
            at = next((k for k, p in enumerate(pieces) if not isinstance(p[0], int)), len(pieces))
            fresh = pieces[at:]
            if fresh:
                del pieces[at:]
                count = sum(len(p[0]) for p in fresh)
                # where its columns lie end to end, their length, and which rows are left
                pieces.append((self.file.tell(), count, 0, count))
                for k, kind in enumerate(self.kinds):
                    for p in fresh:
                        self.file.write(np.ascontiguousarray(p[k], kind).tobytes())
        self.bytes = 0

    @staticmethod
    def _size(piece: tuple) -> int:
        return piece[3] - piece[2] if isinstance(piece[0], int) else len(piece[0])

    def _load(self, piece: tuple, first: int, stop: int) -> tuple:
        """Rows first to stop of what is left of a piece."""
        if not isinstance(piece[0], int):
            return tuple(c[first:stop] for c in piece)
        at, count, lead, _ = piece
        out = []
        for kind in self.kinds:
            self.file.seek(at + (lead + first) * kind.itemsize)
            out.append(np.frombuffer(self.file.read((stop - first) * kind.itemsize), kind))
            at += count * kind.itemsize
        return tuple(out)

    def _parts(self, bucket: int, limit: int, back: bool) -> list[tuple]:
        pieces, parts, got = self.held[bucket], [], 0
        while pieces and got < limit:
            piece = pieces.pop(-1 if back else 0)
            in_file, size = isinstance(piece[0], int), self._size(piece)
            take = min(size, limit - got)
            first, stop = (size - take, size) if back else (0, take)
            parts.append(self._load(piece, first, stop))
            if not in_file:
                self.bytes -= self.width * take
            if take < size:
                a, b = (0, first) if back else (stop, size)
                rest = (*piece[:2], piece[2] + a, piece[2] + b) if in_file else self._load(piece, a, b)
                pieces.insert(len(pieces) if back else 0, rest)
            got += take
        return parts

    def each(self, bucket: int, step: int = 1 << 20) -> Iterator[tuple]:
        """All rows of a bucket from the front, which stay."""
        for piece in list(self.held[bucket]):
            size = self._size(piece)
            for a in range(0, size, step):
                yield self._load(piece, a, min(size, a + step))

    def front(self, bucket: int, limit: int) -> tuple | None:
        """Up to limit rows from the front; None if there are none."""
        parts = self._parts(bucket, limit, back=False)
        return tuple(np.concatenate(c) for c in zip(*parts, strict=True)) if parts else None

    def back(self, bucket: int, limit: int) -> tuple | None:
        """Up to limit rows from the back, the last one first."""
        parts = self._parts(bucket, limit, back=True)
        return tuple(np.concatenate([c[::-1] for c in column]) for column in zip(*parts, strict=True)) if parts else None


class Grid:
    """The buckets of an alphabet: neighbouring symbols of about a block, frequent ones alone."""

    def __init__(self, x: np.ndarray, sigma: int, scratch: Scratch):
        n = len(x)
        self.block = max(LEAST_BLOCK, min(n >> BLOCK_SHARE, scratch.memory // 128))
        count = np.zeros(sigma, np.int64)
        for at in range(0, n, 1 << 20):
            part = np.bincount(x[at : at + (1 << 20)])
            count[: len(part)] += part
        before = np.cumsum(count) - count
        turn = np.r_[True, before[1:] // self.block != before[:-1] // self.block]
        alone = count >= self.block
        turn |= alone
        turn[1:] |= alone[:-1]
        self.of = (np.cumsum(turn) - 1).astype(np.int32)
        self.first = np.flatnonzero(turn)
        self.stop = np.r_[self.first[1:], sigma]
        self.size = len(self.first)
        self.position = np.int32 if n < 2**31 else np.int64


class Lows:
    """Least values of ranges of a block; where only equality counts, whether all are EQUAL."""

    _log = np.zeros(2, np.uint8)

    def __init__(self, values: np.ndarray, exact: bool):
        self.n, self.exact = len(values), exact
        if not exact:
            self.sums = np.zeros(self.n + 1, np.int32)
            np.cumsum(values != EQUAL, out=self.sums[1:])
            return
        levels = self.n.bit_length()
        self.rows = np.empty((levels, self.n), np.uint8)
        self.rows[0] = values
        for j in range(1, levels):
            half = 1 << (j - 1)
            stop = self.n - 2 * half + 1
            np.minimum(self.rows[j - 1, :stop], self.rows[j - 1, half : half + stop], out=self.rows[j, :stop])
        if len(Lows._log) <= self.n:
            Lows._log = (np.frexp(np.arange(2 * self.n + 2))[1] - 1).astype(np.uint8)

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The least of values first to last, both included."""
        if not self.exact:
            return np.where(self.sums[last + 1] == self.sums[first], np.uint8(EQUAL), np.uint8(0))
        j = Lows._log.take(last - first + 1)
        flat, row = self.rows.ravel(), j.astype(np.int64) * self.n
        return np.minimum(flat.take(row + first), flat.take(row + last + 1 - (1 << j.astype(np.int64))))


def common(x: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of the suffixes at a and b, up to depth; ``known`` symbols are equal."""
    out = np.minimum(known, depth).astype(np.int64)
    live = np.flatnonzero(out < depth)
    while len(live):
        at = out[live]
        live = live[x[a[live] + at] == x[b[live] + at]]
        out[live] += 1
        live = live[out[live] < depth]
    return out.astype(np.uint8)


def _one_more(m: np.ndarray, depth: int) -> np.ndarray:
    return np.where(m == EQUAL, np.uint8(EQUAL), np.minimum(m, depth - 1).astype(np.uint8) + np.uint8(1))


class Scan:
    """One scan: visits seeds and what they induce in the order of symbols, or, flipped, against it.

    ``seeds(bucket, limit)`` gives their next rows (position, prefix with the seed before). Kind 0
    is what was induced; a symbol's seeds, kind 1, come behind it.
    """

    def __init__(self, x: np.ndarray, sigma: int, grid: Grid, scratch: Scratch, depth: int, exact: bool, flipped: bool, seeds):
        self.x, self.grid, self.depth, self.exact = x, grid, depth, exact
        self.flipped, self.top, self.seeds = flipped, sigma - 1, seeds
        self.queue = Buckets(scratch, grid.size, (np.int32, grid.position, np.uint8))
        self.gap = np.full(sigma, EQUAL, np.uint8)
        self.last: tuple[int, int, int] | None = None  # symbol, kind and position visited last

    def symbols(self, at: np.ndarray) -> np.ndarray:
        own = self.x.take(at, mode="wrap").astype(np.int32)
        return np.subtract(self.top, own, out=own) if self.flipped else own

    def bucket_of(self, symbol: np.ndarray) -> np.ndarray:
        return self.grid.of[self.top - symbol if self.flipped else symbol]

    def visit(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(bucket, positions, kinds, common prefix with the suffix visited before) in order."""
        buckets = range(self.grid.size)
        for b in reversed(buckets) if self.flipped else buckets:
            first, stop = int(self.grid.first[b]), int(self.grid.stop[b])
            end = self.top - first + 1 if self.flipped else stop
            if stop - first == 1:
                while (rows := self.queue.front(b, self.grid.block)) is not None:
                    yield (b, *self._piece(rows[0], rows[1], np.zeros(len(rows[1]), np.uint8), _one_more(rows[2], self.depth), None))
                while (rows := self.seeds(b, self.grid.block)) is not None:
                    yield (b, *self._piece(self.symbols(rows[0]), rows[0], np.ones(len(rows[0]), np.uint8), rows[1], None))
                continue
            parts = []
            if (rows := self.queue.front(b, self.top + len(self.x))) is not None:
                parts.append((rows[0], rows[1], np.zeros(len(rows[1]), np.uint8), _one_more(rows[2], self.depth)))
            if (rows := self.seeds(b, self.top + len(self.x))) is not None:
                parts.append((self.symbols(rows[0]), rows[0], np.ones(len(rows[0]), np.uint8), rows[1]))
            if parts:
                symbol, position, kind, prefix = (np.concatenate(c) for c in zip(*parts, strict=True))
                key = 2 * (symbol - (end - (stop - first))) + kind
                by = np.argsort(key.astype(np.uint16) if 2 * (stop - first) < 1 << 16 else key, kind="stable")
                yield (b, *self._piece(symbol[by], position[by], kind[by], prefix[by], end))

    def _before(self, symbol, position, kind):
        """For each row, whether it induces the suffix before it, and that one's symbol."""
        ahead = self.symbols(position - 1)
        return (position > 0) & ((ahead > symbol) | ((ahead == symbol) & (kind == 0))), ahead

    def _own(self, symbol, position, kind, prefix, end: int):
        """Merges into a bucket what it induces into itself; also what each row induces.

        First all such rows are found, round by round. Then those of each round are placed among the
        ones before, by their symbol and the place of what induced them: relative places never
        change as later rounds join.
        """
        n = len(position)
        good, ahead = self._before(symbol, position, kind)
        rounds = []  # symbol, position, number of the inducing row; and what each row induces
        base, at, total, all_good, all_ahead = 0, position, n, [good], [ahead]
        while len(pick := np.flatnonzero(good & (ahead < end))):
            own = ahead[pick], at[pick] - 1, pick + base
            rounds.append(own)
            base, at, total = total, own[1], total + len(pick)
            good, ahead = self._before(own[0], at, np.zeros(len(at), np.uint8))
            all_good.append(good)
            all_ahead.append(ahead)
        if not rounds:
            return symbol, position, kind, prefix, all_good[0], all_ahead[0]
        lowest = int(symbol[0])
        upto = np.cumsum(np.bincount(2 * (symbol - lowest) + kind, minlength=2 * (end - lowest)))
        new_symbol, new_position, source = (np.concatenate(c) for c in zip(*rounds, strict=True))
        into = upto[2 * (new_symbol - lowest)]
        rank = np.arange(total)
        by, start = np.empty(0, np.int64), 0
        for own, _, from_ in rounds:
            key = (own.astype(np.int64) << 32) + rank[from_]
            order = np.argsort(key)
            fresh = order + start
            if len(by):
                spot = np.searchsorted((new_symbol[by].astype(np.int64) << 32) + rank[source[by]], key[order])
                by = np.insert(by, spot, fresh)
            else:
                by = fresh
            start += len(own)
            spots = into[by]
            rank[n + by] = spots + np.arange(len(by))
            rank[:n] = np.arange(n) + np.cumsum(np.bincount(spots, minlength=n)[:n])
        out = []
        for old, new in ((symbol, new_symbol), (position, new_position), (kind, 0), (prefix, EQUAL if not self.exact else self.depth)):
            merged = np.empty(total, old.dtype)
            merged[rank[:n]], merged[rank[n:]] = old, new
            out.append(merged)
        for parts in (all_good, all_ahead):
            merged = np.empty(total, parts[0].dtype)
            merged[rank] = np.concatenate(parts)
            out.append(merged)
        symbol, position, kind, prefix, good, ahead = out
        at, inducer = rank[n:][by], rank[source[by]]
        follows = (at > 0) & (symbol[at - 1] == symbol[at])
        behind_new = follows.copy()
        behind_new[0] = False
        behind_new[1:] &= at[1:] - 1 == at[:-1]
        first = np.zeros(len(at), np.int64)
        first[1:] = np.where(behind_new[1:], inducer[:-1] + 1, 0)
        carried = np.where(behind_new, EQUAL, self.gap[symbol[at]]).astype(np.uint8)
        self._borders(symbol, position, kind, prefix)
        while True:
            # a value depends on earlier ones only, so this settles after as many rounds as above
            least = np.minimum(Lows(prefix, self.exact).of(first, inducer), carried)
            fresh = np.where(follows, _one_more(least, self.depth), np.uint8(0))
            if (fresh == prefix[at]).all():
                return symbol, position, kind, prefix, good, ahead
            prefix[at] = fresh

    def _piece(self, symbol, position, kind, prefix, end: int | None):
        """Fixes the order and prefixes of a block and puts what it induces into the queue.

        With ``end`` the block is a whole bucket of symbols below it.
        """
        prefix = prefix.copy()
        self._borders(symbol, position, kind, prefix)
        if end is None:
            good, ahead = self._before(symbol, position, kind)
        else:
            symbol, position, kind, prefix, good, ahead = self._own(symbol, position, kind, prefix, end)
            good &= ahead >= end
        self.last = int(symbol[-1]), int(kind[-1]), int(position[-1])
        rank = np.flatnonzero(good)
        end_rank = len(prefix) - 1
        lows = Lows(prefix, self.exact)
        if len(rank):
            key = ahead[rank]
            by = np.argsort(key.astype(np.uint16) if self.top < 1 << 16 else key, kind="stable")
            rank, key = rank[by], key[by]
            fresh = np.ones(len(key) + 1, bool)
            np.not_equal(key[1:], key[:-1], out=fresh[1:-1])
            last, fresh = fresh[1:], fresh[:-1]
            since = np.zeros(len(key), np.int64)
            since[1:] = rank[:-1] + 1
            since[fresh] = 0
            m = lows.of(since, rank)
            m[fresh] = np.minimum(m[fresh], self.gap[key[fresh]])
            tail = rank[last]
            open_ = np.full(len(tail), EQUAL, np.uint8)
            inside = tail < end_rank
            open_[inside] = lows.of(tail[inside] + 1, np.full(int(inside.sum()), end_rank))
            np.minimum(self.gap, prefix.min(), out=self.gap)
            self.gap[key[last]] = open_
            self.queue.deal(self.bucket_of(key), (key, position[rank] - 1, m))
        else:
            np.minimum(self.gap, prefix.min(), out=self.gap)
        return position, kind, prefix

    def _borders(self, symbol, position, kind, prefix) -> None:
        """Prefixes where a symbol or the seeds of a symbol begin."""
        before = self.last or (-1, 0, 0)
        turn = np.empty(len(symbol), bool)
        turn[0] = symbol[0] != before[0]
        np.not_equal(symbol[1:], symbol[:-1], out=turn[1:])
        prefix[turn] = 0
        seam = np.flatnonzero((kind[1:] != kind[:-1]) & ~turn[1:]) + 1
        if not turn[0] and kind[0] != before[1]:
            seam = np.concatenate([[0], seam])
        if len(seam):
            other = np.where(seam > 0, position[seam - 1], before[2])
            prefix[seam] = common(self.x, position[seam], other, np.ones(len(seam), np.int64), self.depth) if self.exact else 0


def _scans(x: np.ndarray, sigma: int, grid: Grid, scratch: Scratch, depth: int, exact: bool, seeds) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(positions, kinds, common prefix with the one before) of all suffixes but the last, from the
    largest to the smallest; kind 0 is an S suffix."""
    larger = Backwards(scratch, grid)
    for b, position, kind, prefix in Scan(x, sigma, grid, scratch, depth, exact, False, seeds).visit():
        own = kind == 0
        larger.put(b, (position[own].astype(grid.position), prefix[own]))
    for _, position, kind, prefix in Scan(x, sigma, grid, scratch, depth, exact, True, larger.rows).visit():
        yield position, kind, prefix


class Backwards(Buckets):
    """Suffixes (position, prefix with the one before), read against the order they came in."""

    def __init__(self, scratch: Scratch, grid: Grid):
        super().__init__(scratch, grid.size, (grid.position, np.uint8))
        self.after: dict[int, int] = {}

    def rows(self, bucket: int, limit: int) -> tuple | None:
        found = self.back(bucket, limit)
        if found is None:
            return None
        position, prefix = found
        shifted = np.r_[np.uint8(self.after.get(bucket, 0)), prefix[:-1]].astype(np.uint8)
        self.after[bucket] = int(prefix[-1])
        return position, shifted


def star_positions(x: np.ndarray, scratch: Scratch) -> np.ndarray:
    """Positions of the S suffixes behind an L suffix, read from the end in steps; the last is one."""
    n, step = len(x), 1 << 20
    found = Buckets(scratch, 1, (np.int64,))
    later_s, total = True, 1  # the terminator
    found.put(0, (np.array([n - 1]),))
    for stop in range(n - 1, 0, -step):
        a = max(0, stop - step)
        # types of a..stop-1; a type goes back over equal symbols
        rise = np.sign(x[a + 1 : stop + 1].astype(np.int64) - x[a:stop].astype(np.int64)).astype(np.int8)
        rise = np.r_[rise, np.int8(1 if later_s else -1)]
        known = np.flatnonzero(rise)
        s_type = np.repeat(rise[known] > 0, np.diff(np.r_[-1, known]))
        own = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
        own = own[own + a < n - 1] + a
        found.put(0, (own[::-1].astype(np.int64),))
        total += len(own)
        later_s = bool(s_type[0])
    out, at = scratch.array(total, np.int64), 0
    while (rows := found.back(0, 1 << 20)) is not None:
        out[at : at + len(rows[0])] = rows[0]
        at += len(rows[0])
    return out


def suffixes(x: np.ndarray, sigma: int, depth: int, scratch: Scratch) -> Stream:
    """(positions, common prefix with the one before) of all suffixes of x, from the largest to the
    smallest; x ends in 0, which is nowhere else, and its symbols are below sigma."""
    if not 1 < depth < EQUAL:
        raise ValueError(f"depth {depth}")
    n = len(x)
    if n > 1:
        grid = Grid(x, sigma, scratch)
        stars = star_positions(x, scratch)
        seeds = Backwards(scratch, grid)
        before = None
        for position, known in _sorted_stars(x, sigma, depth, grid, stars, scratch):
            other = np.r_[position[0] if before is None else before, position[:-1]]
            prefix = common(x, position[1:], other[1:], known[1:], depth) if before is None else common(x, position, other, known, depth)
            prefix = np.r_[np.uint8(0), prefix] if before is None else prefix
            before = position[-1]
            seeds.deal(grid.of[x[position]], (position.astype(grid.position), prefix))
        for position, _, prefix in _scans(x, sigma, grid, scratch, depth, True, seeds.rows):
            yield position, prefix
    yield np.array([n - 1]), np.zeros(1, np.uint8)


def _sorted_stars(x: np.ndarray, sigma: int, depth: int, grid: Grid, stars: np.ndarray, scratch: Scratch) -> Stream:
    """Star positions from the largest suffix to the smallest, and symbols known to be equal."""
    seeds = Buckets(scratch, grid.size, (grid.position, np.uint8))
    for at in range(0, len(stars), 1 << 20):
        part = np.asarray(stars[at : at + (1 << 20)])
        bucket = grid.of[x[part]]
        by = np.argsort(bucket, kind="stable")
        seeds.deal(bucket[by], (part[by].astype(grid.position), np.full(len(part), EQUAL, np.uint8)))
    name_at = scratch.array(len(x), grid.position)
    ordered = Buckets(scratch, 1, (grid.position,))
    names, equal, repeated = 0, False, False
    for position, kind, prefix in _scans(x, sigma, grid, scratch, depth, False, seeds.front):
        differs = np.cumsum(prefix != EQUAL)
        star = np.flatnonzero((kind == 0) & (position > 0) & (x[position - 1] > x[position]))
        if len(star):
            apart = np.diff(np.r_[0, differs[star]])
            fresh = apart > 0
            # the first one continues the block before, if nothing has differed since
            fresh[0] = bool(fresh[0]) or not equal
            own = names + np.cumsum(fresh)
            names = int(own[-1])
            repeated |= not fresh.all()
            name_at[position[star]] = own
            ordered.put(0, (position[star].astype(grid.position),))
            equal = bool(differs[-1] == differs[star[-1]])
        else:
            equal = equal and bool(differs[-1] == 0)
    if repeated and depth > 2:
        own = scratch.array(len(stars), grid.position)
        for at in range(0, len(stars) - 1, 1 << 20):
            stop = min(len(stars) - 1, at + (1 << 20))
            own[at:stop] = names + 1 - name_at[stars[at:stop]]
        own[-1] = 0
        within = depth // 2 + 1
        for place, same in suffixes(own, names + 1, within, scratch):
            position = stars[place]
            known = stars[np.minimum(place + same, len(stars) - 1)] - position
            yield np.asarray(position), np.where(same >= within, depth, known)
        return
    while (rows := ordered.front(0, 1 << 20)) is not None:
        yield rows[0].astype(np.int64), np.zeros(len(rows[0]), np.int64)
    yield np.array([len(x) - 1]), np.zeros(1, np.int64)
