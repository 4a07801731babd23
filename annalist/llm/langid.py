"""Language of texts and of the words in them: a linear-chain conditional random field.

A word is a maximal run of letters and combining marks, of at most ``WORD`` of them at a time. Its score for each language is a
sum of learned weights: of its affixes of one to three characters, of its character n-grams of one to three, both by hash, and of
its share among the languages in a lexicon, or of being in none. Learned transitions join the labels of neighbouring
words, and forward-backward gives each word a probability for each language, so the words of a code-switched text are
labelled one by one. A text's language is the one with the highest mean probability over its words.

Fitted by numpy on at most ``TRAIN_PASSAGES`` passages of ``PASSAGE`` words, spread over the languages and over the
whole texts of sampled documents. Passages of different documents are laid end to end, so that languages change
inside a chain and the transitions between them are seen. The lexicon is counted on the same sample, a word's own
occurrence left out in training. At most ``MOST_LANGUAGES``, the most frequent, are learned. This sample is the
only bound; the model is broadcast, of ``SLOTS`` rows whatever the input. Labelling reads every whole text in one scan without
a shuffle.

Defined results. Null text, or one without a letter: ``und`` and score 0, as is every text if no row has a language. Null
doc_id: labelled, not held out, never learned from. Repeated rows are labelled one by one, and a repeated id is sampled like any
other rows. Equal means: the first language by name. Very long texts are labelled whole, as one chain. Empty
table: no rows. Language, source and id are no inputs of a label; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = 64
SLOTS = 1 << 16
PASSAGE, PER_DOCUMENT = 48, 4
TRAIN_PASSAGES = 4000
MOST_LANGUAGES = 64
CHAIN, EPOCHS, BATCH, RATE, DECAY = 64, 4, 32, 0.03, 1e-4
#: Words of a chain that advance one by one; longer chains are segments joined by matrices.
SEGMENT = 128
#: Code points whose features are made together, and numbers of a lattice held at a time.
STEP_CHARS, STEP_CELLS = 1 << 20, 1 << 22
UNKNOWN = "und"
_WIDE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


@cache
def _kinds() -> np.ndarray:
    """Of each code point: 2 letter, 1 combining mark, 0 other."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LM":
            out[c] = 2 if kind == "L" else 1
    return out


@dataclass
class Words:
    """The words of texts laid end to end: code points, first one of each word, and its text."""

    points: np.ndarray
    starts: np.ndarray
    doc: np.ndarray
    at: np.ndarray
    has_letter: np.ndarray

    @staticmethod
    def of(texts: list[str]) -> Words:
        lower = [t.lower() for t in texts]
        bounds = np.cumsum([0, *(len(t) + 1 for t in lower)])
        points = np.frombuffer("\n".join(lower).encode("utf-32-le"), np.uint32)
        kind = _kinds()[points]
        inside = np.flatnonzero(kind)
        new = np.r_[True, np.diff(inside) > 1] if len(inside) else np.empty(0, bool)
        # a longer run is several words
        run = np.flatnonzero(new)
        place = np.arange(len(inside)) - np.repeat(run, np.diff(np.append(run, len(inside))))
        starts = np.flatnonzero(place % WORD == 0)
        at = inside[starts]
        doc = np.searchsorted(bounds, at, "right") - 1
        letters = np.searchsorted(bounds, inside[kind[inside] == 2], "right") - 1
        return Words(points[inside], starts, doc, at - bounds[doc], np.bincount(letters, minlength=len(texts)) > 0)

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(np.append(self.starts, len(self.points)))

    def keys(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        place = np.arange(len(self.points), dtype=np.uint64) - np.repeat(self.starts, self.sizes).astype(np.uint64)
        spread = (self.points + np.uint64(1)) * ((place + np.uint64(1)) * _WIDE[0] | np.uint64(1))
        spread = (spread ^ (spread >> np.uint64(29))) * _WIDE[1]
        return np.add.reduceat(spread, self.starts) if len(self.starts) else np.empty(0, np.uint64)

    def distinct(self) -> tuple[Words, np.ndarray, np.ndarray]:
        """The words without repetitions, their keys, and which of them each word is."""
        keys, first, which = np.unique(self.keys(), return_index=True, return_inverse=True)
        size = self.sizes[first]
        starts = np.cumsum(size) - size
        points = self.points[np.repeat(self.starts[first] - starts, size) + np.arange(int(size.sum()))]
        return Words(points, starts, self.doc[first], self.at[first], self.has_letter), keys, which


def _slot(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h ^ np.uint32(kind * 0x27D4EB2F & 0xFFFFFFFF)) * _MIX[0]
    return ((h ^ (h >> np.uint32(15))) * _MIX[1] >> np.uint32(16)).astype(np.int64) % SLOTS


@dataclass
class Features:
    """Slots of the n-grams of each position, of the affixes of each word, and of whole words; SLOTS is none."""

    grams: np.ndarray
    affixes: np.ndarray
    word: np.ndarray

    @staticmethod
    def of(words: Words, keys: np.ndarray) -> Features:
        x, starts, size = words.points, words.starts, words.sizes
        n = len(x)
        left = np.repeat(starts + size, size) - np.arange(n)  # characters from here to the word's end
        grams, hashes = np.full((3, n), SLOTS, np.int64), [x * _MIX[2]]
        for k in (1, 2):
            longer = np.zeros(n, np.uint32)
            longer[: n - k] = (hashes[-1][: n - k] ^ (hashes[-1][: n - k] >> np.uint32(13))) * _MIX[k - 1] + x[k:]
            hashes.append(longer)
        for k, h in enumerate(hashes):
            fits = left > k
            grams[k, fits] = _slot(h[fits], k + 1)
        affixes = np.full((6, len(starts)), SLOTS, np.int64)
        for k, h in enumerate(hashes):
            fits = size > k
            affixes[k, fits] = _slot(h[starts[fits]], k + 4)
            affixes[k + 3, fits] = _slot(h[(starts + size - 1 - k)[fits]], k + 7)
        return Features(grams, affixes, (keys >> np.uint64(40)).astype(np.int64) % SLOTS)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # SLOTS + 1 by languages; the last row is zero
    lexicon: np.ndarray  # counts, SLOTS by languages
    known: np.ndarray  # weight of the lexicon's log shares
    unknown: np.ndarray  # by language
    first: np.ndarray
    step: np.ndarray  # from, to

    def shares(self, word: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Centred log counts of words in the lexicon, and which are in none; ``own`` labels are left out."""
        count = self.lexicon[word]
        if own is not None:
            count[np.arange(len(word)), own] -= 1
        log = np.log(count + np.float32(0.5))
        return log - log.mean(axis=1, keepdims=True), (count.sum(axis=1) <= 0).astype(np.float32)

    def scores(self, words: Words, f: Features) -> np.ndarray:
        share, none = self.shares(f.word)
        out = self.known * share + none[:, None] * self.unknown
        for slots in f.affixes:
            out += self.weights[slots]
        if len(words.starts):
            every = self.weights[f.grams[0]] + self.weights[f.grams[1]]
            every += self.weights[f.grams[2]]
            out += np.add.reduceat(every, words.starts, axis=0)
        return out


def _lattice(scores: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Chains cut into segments of ``SEGMENT`` words: weights (place, segment, label), each word's place and segment,
    and of the segments their length, and their number in their chain."""
    per_chain = -(-counts // SEGMENT)
    before = np.cumsum(per_chain) - per_chain
    offset = np.arange(len(scores)) - np.repeat(np.cumsum(counts) - counts, counts)
    segment = np.repeat(before, counts) + offset // SEGMENT
    place = offset % SEGMENT
    size = np.bincount(segment, minlength=int(per_chain.sum()))
    e = np.ones((SEGMENT, len(size), scores.shape[1]))
    e[place, segment] = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e, place, segment, size, np.arange(len(size)) - np.repeat(before, per_chain)


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def forward_backward(scores: np.ndarray, counts: np.ndarray, first: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Probability of each label for each word of chains, laid end to end, of some words each.

    All segments advance together, one word a step. What enters a segment of a longer chain comes from products of
    the matrices of the segments before and behind it, so the result is that of one pass over the whole chain.
    """
    e, place, segment, size, number = _lattice(scores, counts)
    k = scores.shape[1]
    a, p = np.exp(step - step.max()).astype(np.float64), np.exp(first - first.max()).astype(np.float64)
    start, end = np.tile(p, (len(size), 1)) * e[0], np.ones((len(size), k))
    last = np.append(number[1:] == 0, True)
    if number.any():
        joined = np.flatnonzero((number > 0) | ~last)
        m = np.tile(np.eye(k), (len(joined), 1, 1))
        for t in range(1, SEGMENT):
            here = np.flatnonzero(size[joined] > t)
            if not len(here):
                break
            on = slice(None) if len(here) == len(joined) else here
            now = (m[on].reshape(-1, k) @ a).reshape(-1, k, k) * e[t, joined[on]][:, None, :]
            m[on] = now / now.sum(axis=(1, 2), keepdims=True)
        row = np.zeros(len(size), np.int64)
        row[joined] = np.arange(len(joined))
        for j in range(1, int(number.max()) + 1):
            at = np.flatnonzero(number == j)
            out = (start[at - 1][:, None, :] @ m[row[at - 1]])[:, 0]
            start[at] = _scaled((out @ a) * e[0, at])
        for j in range(int(number.max()), 0, -1):
            at = np.flatnonzero(number == j)
            into = (m[row[at]] @ end[at][:, :, None])[:, :, 0]
            end[at - 1] = _scaled((into * e[0, at]) @ a.T)
    alpha = np.empty_like(e)
    alpha[0] = now = _scaled(start)
    for t in range(1, SEGMENT):
        now = (now @ a) * e[t]
        alpha[t] = now = _scaled(now)
    beta = end
    for t in range(SEGMENT - 1, 0, -1):
        alpha[t] *= beta
        beta = np.where((size > t)[:, None], _scaled((beta * e[t]) @ a.T), end)
    alpha[0] *= beta
    return _scaled(alpha[place, segment])


def _chains_gradient(e: np.ndarray, first: np.ndarray, step: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of chains (chain, word, label) and its gradients."""
    b, t, k = e.shape
    top = e.max(axis=2, keepdims=True)
    x, a, p = np.exp(e - top), np.exp(step), np.exp(first)
    alpha, scale, beta = np.empty_like(x), np.empty((b, t)), np.ones_like(x)
    for i in range(t):
        now = (p if i == 0 else alpha[:, i - 1] @ a) * x[:, i]
        scale[:, i] = now.sum(axis=1)
        alpha[:, i] = now / scale[:, i : i + 1]
    for i in range(t - 1, 0, -1):
        beta[:, i - 1] = ((beta[:, i] * x[:, i]) @ a.T) / scale[:, i : i + 1]
    gamma = alpha * beta
    pairs = np.einsum("bti,btj->ij", alpha[:, :-1], beta[:, 1:] * x[:, 1:] / scale[:, 1:, None]) * a
    rows, cols = np.arange(b)[:, None], np.arange(t)[None, :]
    said = e[rows, cols, y].sum() + first[y[:, 0]].sum() + step[y[:, :-1], y[:, 1:]].sum()
    loss = (np.log(scale).sum() + top.sum() - said) / b
    gamma_y = gamma.copy()
    gamma_y[rows, cols, y] -= 1
    np.subtract.at(pairs, (y[:, :-1], y[:, 1:]), 1)
    return loss, gamma_y / b, gamma_y[:, 0].sum(axis=0) / b, pairs / b


def fit(passages: list[tuple[str, str]], seed: int = 11) -> Model | None:
    """Fits all weights together by Adam on the likelihood of the labels; passages are (language, text)."""
    languages = sorted({lang for lang, _ in passages})
    k = len(languages)
    if not k:
        return None
    rng = np.random.default_rng(seed)
    passages = [passages[i] for i in rng.permutation(len(passages))]
    words = Words.of([text for _, text in passages])
    f = Features.of(words, words.keys())
    label = np.array([languages.index(lang) for lang, _ in passages])[words.doc]
    lexicon = np.zeros((SLOTS, k), np.float32)
    np.add.at(lexicon, (f.word, label), 1)
    zero = np.zeros(k, np.float32)
    model = Model(languages, np.zeros((SLOTS + 1, k), np.float32), lexicon, zero[:1].copy(), zero.copy(), zero.copy(), np.zeros((k, k), np.float32))
    share, none = model.shares(f.word, label)
    length = min(CHAIN, len(label))
    n = len(label) // length if length else 0
    if not n or k == 1:
        return model
    sizes = words.sizes
    parts = {"weights": model.weights, "known": model.known, "unknown": model.unknown, "first": model.first, "step": model.step}
    moment = {name: (np.zeros_like(v), np.zeros_like(v)) for name, v in parts.items()}
    turn = 0
    for _ in range(EPOCHS):
        shift = int(rng.integers(0, len(label) - n * length + 1))
        order = rng.permutation(n)
        for lo in range(0, n, BATCH):
            pick = order[lo : lo + BATCH]
            own = (shift + pick[:, None] * length + np.arange(length)).ravel()
            chars = np.repeat(words.starts[own], sizes[own]) + np.arange(int(sizes[own].sum())) - np.repeat(np.cumsum(sizes[own]) - sizes[own], sizes[own])
            grams, of = f.grams[:, chars], np.repeat(np.arange(len(own)), sizes[own])
            e = model.known * share[own] + none[own, None] * model.unknown
            for slots in f.affixes[:, own]:
                e += model.weights[slots]
            e += np.add.reduceat(model.weights[grams].sum(axis=0), np.cumsum(sizes[own]) - sizes[own], axis=0)
            shape = (len(pick), length, k)
            _, ge, gf, gs = _chains_gradient(e.reshape(shape).astype(np.float64), model.first.astype(np.float64), model.step.astype(np.float64), label[own].reshape(shape[:2]))
            ge = ge.reshape(-1, k) / length
            slots = np.concatenate([f.affixes[:, own].ravel(), grams.ravel()])
            source = np.concatenate([np.tile(np.arange(len(own)), 6), np.tile(of, 3)])
            table = np.stack([np.bincount(slots, ge[source, j], SLOTS + 1) for j in range(k)], axis=1)
            table[SLOTS] = 0
            grad = {
                "weights": table + DECAY * model.weights, "known": np.array([(ge * share[own]).sum()]), "unknown": (ge * none[own, None]).sum(axis=0),
                "first": gf / length, "step": gs / length + DECAY * model.step,
            }
            turn += 1
            for name, v in parts.items():
                one, two = moment[name]
                one += 0.1 * (grad[name] - one)
                two += 0.01 * (grad[name] ** 2 - two)
                v -= (RATE * (one / (1 - 0.9**turn)) / (np.sqrt(two / (1 - 0.99**turn)) + 1e-6)).astype(np.float32)
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _passages(texts: list[str], seeds: list[int]) -> list[list[str]]:
    """Of each text at most ``PER_DOCUMENT`` passages, one from each equal part of its words."""
    words = Words.of(texts)
    out: list[list[str]] = [[] for _ in texts]
    lower = [t.lower() for t in texts]
    ends = words.at + words.sizes
    first = np.searchsorted(words.doc, np.arange(len(texts) + 1))
    for k, (lo, hi) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        parts = min(PER_DOCUMENT, -(-(hi - lo) // PASSAGE))
        for j in range(parts):
            a, b = lo + (hi - lo) * j // parts, lo + (hi - lo) * (j + 1) // parts
            a += seeds[k] % max(1, b - a - PASSAGE + 1)
            out[k].append(" ".join(lower[k][words.at[i] : ends[i]] for i in range(a, min(a + PASSAGE, b))))
    return out


def train(docs: DataFrame, most: int = TRAIN_PASSAGES) -> Model | None:
    """Fits on a sample of the rows (doc_id, text, lang) that are not held out."""
    usable = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    found = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    if not found:
        return None
    share = max(1, most // PER_DOCUMENT // len(found))
    whole = 1 << 31
    most_of = F.create_map(*[F.lit(v) for r in found for v in (r.lang, min(whole, 2 * share * whole // r.n + 1))])
    key = F.xxhash64("text", "doc_id")
    picked = usable.filter(F.pmod(key, F.lit(whole)) < F.coalesce(most_of[F.col("lang")], F.lit(0)))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("key", "doc_id"))
    body = picked.select("lang", key.alias("key"), "doc_id", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, seed, doc_id, text in zip(*(b.column(c) for c in ("lang", "key", "doc_id", "text")), strict=True):
                pieces = _passages([text.as_py()], [seed.as_py() & 0xFFFF])[0]
                row = [[lang.as_py()], [seed.as_py()], [doc_id.as_py()], [pieces]]
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], ["lang", "key", "doc_id", "pieces"])

    small = body.mapInArrow(cut, "lang string, key long, doc_id long, pieces array<string>").filter(F.size("pieces") > 0)
    rows = small.withColumn("place", place).filter(F.col("place") <= share).collect()
    rows.sort(key=lambda r: (r.lang, r.place))
    return fit([(r.lang, p) for r in rows for p in r.pieces])


SPAN = "struct<start: int, stop: int, lang: string>"
_SPAN = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("lang", pa.string())])


def _spans(words: Words, best: np.ndarray, n: int, languages: list[str]) -> pa.Array:
    """Of each text the maximal stretches of words of one language; offsets in the lower-cased text."""
    ends = words.at + words.sizes
    new = np.flatnonzero(np.r_[True, (best[1:] != best[:-1]) | (words.doc[1:] != words.doc[:-1])]) if len(best) else np.empty(0, np.int64)
    last = np.append(new[1:], len(best)) - 1 if len(new) else new
    count = np.bincount(words.doc[new], minlength=n)
    parts = [pa.array(words.at[new], pa.int32()), pa.array(ends[last], pa.int32()), pa.array([languages[i] for i in best[new]], pa.string())]
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), pa.StructArray.from_arrays(parts, fields=list(_SPAN)))


def _label(texts: list[str], model: Model | None) -> tuple[list[str], np.ndarray, pa.Array]:
    """Language, score and spans of each text."""
    n = len(texts)
    words = Words.of(texts)
    if model is None or not len(words.starts):
        empty = pa.array([[]] * n, pa.list_(_SPAN))
        return [UNKNOWN] * n, np.zeros(n), empty
    distinct, keys, which = words.distinct()
    scores = model.scores(distinct, Features.of(distinct, keys))[which]
    first = np.searchsorted(words.doc, np.arange(n + 1))
    count = np.diff(first)
    some = np.flatnonzero(count)
    p = forward_backward(scores, count[some], model.first, model.step)
    mean = np.zeros((n, p.shape[1]))
    mean[some] = np.add.reduceat(p, first[some], axis=0) / count[some, None]
    best, found = mean.argmax(axis=1), words.has_letter
    names = [model.languages[best[k]] if found[k] else UNKNOWN for k in range(n)]
    return names, np.where(found, np.clip(mean.max(axis=1), 0, 1), 0.0), _spans(words, p.argmax(axis=1), n, model.languages)


def label(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score, spans): spans are the stretches of one language, by offsets in the lower-cased text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "lang_pred", "score", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        most = min(STEP_CHARS, STEP_CELLS // (1 if found is None else len(found.languages)))
        for b in batches:
            held, size, at = [], 0, 0

            def flush(first: int, texts: list[str], ids=b.column(0)) -> pa.RecordBatch:
                lang, score, spans = _label(texts, found)
                return pa.RecordBatch.from_arrays([ids.slice(first, len(texts)), pa.array(lang, pa.string()), pa.array(score), spans], names)

            for k, text in enumerate(b.column(1)):
                held.append(text.as_py() or "")
                size += len(held[-1])
                if size >= most:
                    yield flush(at, held)
                    held, size, at = [], 0, k + 1
            if held:
                yield flush(at, held)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, lang_pred string, score double, spans array<{SPAN}>")
