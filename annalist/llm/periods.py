"""Periodic runs: maximal stretches of words that repeat with a smallest period.

A run has a smallest period q (words q apart are equal), at least ``LEAST_LENGTH`` words and ``LEAST_POWER`` periods,
and can't be extended on either side.

1. Words become numbers. Of a batch of texts those stretches are kept in which a run can lie: inside a run every
   5-gram, or for periods below five every word, comes again at the period's distance. The test is made
   for ranges of the period, each up to ``WIDER`` times its least, so a stretch is kept only if the repetition is as long as a run of that
   period must be. It keeps every run whole, and little else.
2. The suffix automaton of a stretch is built. Its suffix links are a tree, and the words are replayed on it by the
   access operation of link-cut trees: the path from the state of a prefix to the root gets the place of the
   prefix as its colour, so each segment of one colour that the path crosses holds the last place e at which its words were
   seen, and the greatest length of a suffix seen there. A distance d = i - e of at most that length is a square
   ending at i; where length and distance make up enough periods, it is a run so far, with its true start. The
   next words extend it. (The tree is complete before the replay: nothing has to be linked or cut, and
   a segment's colour is kept at the root of its splay tree.) Crossed segments are O(log n) a word, amortised.

Everything happens inside a row: no shuffle, no hot key. One text is in memory at a time, with its automaton: some 300 bytes
a word of the longest kept stretch.

Defined results. Null, empty or blank text: no words, no runs, empty collapsed text. Null or repeated doc_id, repeated rows: rows
are judged one by one. Very long texts are searched whole. Ties between runs: by length, then smallest start,
then smallest period. Empty table: no rows. Columns that aren't asked for are ignored, also if called ``runs``.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import let, words
from annalist.llm.shingles import ngrams

LEAST_LENGTH, LEAST_POWER = 6, 4
#: Words of texts whose stretches are looked for together.
STEP_WORDS = 200_000
_GRAM, WIDER = 5, 2**0.5
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
RUN = "struct<start: bigint, length: bigint, period: bigint>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _stretches(held: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal stretches of True of the least length: first and last place."""
    gap = np.flatnonzero(~held)
    first, last = np.append(-1, gap) + 1, np.append(gap, len(held)) - 1
    long = last - first + 1 >= least
    return first[long], last[long]


def _last_seen(grams: np.ndarray) -> np.ndarray:
    """Distance of each gram to the equal one before it; beyond all periods where there is none."""
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    far = np.full(len(grams), np.iinfo(np.int64).max)
    far[order[1:][same]] = (order[1:] - order[:-1])[same]
    return far


def covered(codes: np.ndarray) -> np.ndarray:
    """Which words may belong to a run; every run is covered whole.

    Texts may be laid end to end if a number that comes once stands between them.
    """
    n = len(codes)
    edge = np.zeros(n + 1, np.int64)

    def mark(first: np.ndarray, stop: np.ndarray) -> None:
        np.add.at(edge, np.maximum(first, 0), 1)
        np.add.at(edge, np.minimum(stop, n), -1)

    for q in range(1, min(_GRAM, n)):
        first, last = _stretches(codes[q:] == codes[:-q], max(LEAST_LENGTH, LEAST_POWER * q) - q)
        mark(first, last + q + 1)
    if n >= _GRAM:
        far = _last_seen(ngrams(codes.astype(np.uint64) * _SPREAD, _GRAM))
        place = np.flatnonzero(far <= n // LEAST_POWER)
        far, low = far[place], _GRAM
        while LEAST_POWER * low <= n:
            top = max(low, int(low * WIDER))
            near = place[far <= top]
            turn = np.flatnonzero(np.diff(near) > 1)
            first, last = near[np.append(0, turn + 1)[: len(near)]], near[np.append(turn, len(near) - 1)[: len(near)]]
            long = last - first + 1 >= (LEAST_POWER - 1) * low - _GRAM + 1
            mark(first[long] - top, last[long] + _GRAM)
            low = top + 1
    return np.cumsum(edge[:-1]) > 0


class SuffixAutomaton:
    """States 1 (the root) and up, of a list of numbers; ``prefix[i]`` is the state of words 0..i."""

    def __init__(self, codes: list[int]):
        link, length, prefix = array("i", [0, 0]), array("i", [0, 0]), array("i")
        moves: list[dict[int, int]] = [{}, {}]
        last = 1
        for size, code in enumerate(codes, 1):
            new = len(moves)
            moves.append({})
            length.append(size)
            at = last
            while at and code not in moves[at]:
                moves[at][code] = new
                at = link[at]
            to = moves[at][code] if at else 1
            if at and length[to] != length[at] + 1:
                copy = len(moves)
                moves.append(moves[to].copy())
                length.append(length[at] + 1)
                link.append(copy)
                link.append(link[to])
                link[to] = copy
                while at and moves[at].get(code) == to:
                    moves[at][code] = copy
                    at = link[at]
            else:
                link.append(to)
            prefix.append(new)
            last = new
        self.link, self.length, self.prefix = link, length, prefix


class PathColours:
    """A rooted tree whose paths to the root are recoloured: the access operation of link-cut trees.

    Preferred paths are splay trees ordered by depth. All states of a path have the colour of their last access,
    which is stored at the root of the splay tree.
    """

    def __init__(self, parent: array):
        self.up, none = array("i", parent), bytes(4 * len(parent))
        self.left, self.right = array("i", none), array("i", none)
        self.colour = array("i", [-1]) * len(parent)

    def _splay(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        while True:
            y = up[x]
            if not y or (left[y] != x and right[y] != x):
                return
            z = up[y]
            inner = z and (left[z] == y or right[z] == y)
            if inner:
                self._rotate(y if (left[z] == y) == (left[y] == x) else x)
            self._rotate(x)

    def _rotate(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        y = up[x]
        z = up[y]
        if z and left[z] == y:
            left[z] = x
        elif z and right[z] == y:
            right[z] = x
        else:
            self.colour[x] = self.colour[y]
        if left[y] == x:
            moved = left[y] = right[x]
            right[x] = y
        else:
            moved = right[y] = left[x]
            left[x] = y
        if moved:
            up[moved] = y
        up[y], up[x] = x, z

    def access(self, state: int, colour: int) -> list[tuple[int, int]]:
        """Gives the path the colour; (deepest state, former colour) of the segments it crosses."""
        up, left, right, colours = self.up, self.left, self.right, self.colour
        crossed, below = [], 0
        while state:
            above = up[state]
            if above and (left[above] == state or right[above] == state):
                self._splay(state)
            deeper = right[state]
            if deeper:
                colours[deeper] = colours[state]
            right[state] = below
            crossed.append((state, colours[state]))
            below, state = state, up[state]
        colours[below] = colour
        return crossed


def runs_of(codes: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a stretch, by start, then period."""
    automaton = SuffixAutomaton(codes)
    paths, length, end = PathColours(automaton.link), automaton.length, {}
    for i, state in enumerate(automaton.prefix):
        for deepest, e in paths.access(state, i):
            common, d = length[deepest], i - e
            if common >= (LEAST_POWER - 1) * d and e >= 0 and common + d >= LEAST_LENGTH:
                end[i + 1 - common - d, d] = i + 1
    return sorted((start, stop - start, d) for (start, d), stop in end.items())


def _batch(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each of the texts, given as words."""
    number: dict[bytes, int] = {}
    codes: list[int] = []
    bounds = [0]
    for k, text in enumerate(texts):
        codes.extend([number.setdefault(w, len(number)) for w in text])
        codes.append(-1 - k)
        bounds.append(len(codes))
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    array_of = np.array(codes, np.int64)
    held = covered(array_of)
    held[array_of < 0] = False
    first, last = _stretches(held, LEAST_LENGTH)
    owner = np.searchsorted(bounds, first, "right") - 1
    for a, b, k in zip(first.tolist(), last.tolist(), owner.tolist(), strict=True):
        found[k].extend((a - bounds[k] + start, length, period) for start, length, period in runs_of(codes[a : b + 1]))
    return found


def collapse(text: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, of each run the first period only."""
    if runs:
        keep = np.ones(len(text), bool)
        for start, length, period in runs:
            keep[start + period : start + length] = False
        text = [text[k] for k in np.flatnonzero(keep)]
    return b" ".join(text)


def find(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, ``runs`` by start, then period, and ``collapsed``, the text without repetitions."""
    kept = docs.select(*keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*keep, "runs", "collapsed"]

        def flush(rows: pa.RecordBatch, texts: list[list[bytes]]) -> pa.RecordBatch:
            found = _batch(texts)
            count = np.array([0, *(len(f) for f in found)])
            flat = np.array([r for f in found for r in f], np.int64).reshape(-1, 3)
            lists = pa.ListArray.from_arrays(
                pa.array(np.cumsum(count), pa.int32()), pa.StructArray.from_arrays([pa.array(c) for c in flat.T], fields=list(_RUN))
            )
            text = pa.array([collapse(t, f) for t, f in zip(texts, found, strict=True)], pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([*rows.columns, lists, text], names)

        for b in batches:
            held, size, at = [], 0, 0
            *carried, bodies = b.columns
            rows = pa.RecordBatch.from_arrays(carried, list(keep))
            for k, body in enumerate(bodies):
                held.append(body.as_py().split())
                size += len(held[-1])
                if size >= STEP_WORDS:
                    yield flush(rows.slice(at, k + 1 - at), held)
                    held, size, at = [], 0, k + 1
            if held:
                yield flush(rows.slice(at), held)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    body = F.encode(F.coalesce(docs["text"], F.lit("")), "utf-8")
    unique = "_".join((*keep, "body"))  # longer than any kept name
    return docs.select(*keep, body.alias(unique)).mapInArrow(run, f"{fields}, runs array<{RUN}>, collapsed string")


def longest(runs: Column) -> Column:
    """The run of greatest length; ties: smallest start, then smallest period. Null without runs."""

    def better(best: Column, r: Column) -> Column:
        # runs come by start, then period, so an equal one further on never wins
        return F.when(best.isNull() | (r["length"] > best["length"]), r).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast(RUN), better)


def listed(runs: Column) -> Column:
    """``start,length,period`` and a line end for each run."""
    line = F.transform(runs, lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"]))
    return F.array_join(line, "")


def with_repetitions(docs: DataFrame) -> DataFrame:
    """The texts that the query judges: of documents whose hash ends in 0, the tail repeats some of its words."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = ((h - h % 10) / 10).cast("long")

    def repeated(ws: Column) -> Column:
        n = F.size(ws).cast("long")
        a = g % n
        of, by = n - a, 3 + g % 8
        p = 1 + ((of - of % by) / by).cast("long")
        return F.array_join(F.transform(ws, lambda w, i: F.when(i < a, w).otherwise(F.get(ws, (a + (i - a) % p).cast("int")))), " ")

    own = words(F.col("text"))
    changed = F.when((h % 10 == 0) & (F.size(own) > 0), let(own, repeated)).otherwise(F.col("text"))
    return docs.select("doc_id", changed.alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Number of runs, the longest one, and hashes of all runs and of the collapsed text."""
    best = F.col("best")
    exponent = ((1000 * best["length"] - (1000 * best["length"]) % best["period"]) / best["period"]).cast("long")
    return found.withColumn("best", longest(F.col("runs"))).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        exponent.alias("exponent_milli"),
        F.sha2(listed(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
