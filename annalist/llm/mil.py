"""Quality classifier: attention-based multiple-instance learning (Ilse et al. 2018).

A document is a bag of passages of ``PASSAGE`` bytes; only the bag has a label. Every passage is
encoded (byte-class frequencies, frequencies of neighbouring classes, repetition of 4-byte
grams and of words). Gated attention a_k ~ exp(w . (tanh(V h_k) * sigmoid(U h_k))) weights the passages, and
the score is the sigmoid of a linear function of the weighted mean.

The model is fitted by numpy on at most ``TRAIN_DOCS`` labelled documents, taken by a hash of
the id, each of at most ``TRAIN_BYTES`` bytes; this sample is the only bound. Scoring reads
every whole text in one scan without a shuffle.

Defined results. Null or empty text: a bag of one empty passage; it gets a score. Null doc_id:
scored, not held out, never trained on. Repeated rows are scored one by one. No usable labels:
every score is 0.5. Label, language, source and id are no inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASSAGE = 512
TRAIN_DOCS, TRAIN_BYTES = 5000, 1 << 19
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 16, 30, 128, 0.005, 1e-4
CUT = 0.3
#: Bytes encoded at a time.
STEP = 1 << 20


def _classes() -> np.ndarray:
    """Byte to class: letters by case, digits, blanks, line ends, marks, symbols, high bytes."""
    table = np.full(256, 10, np.uint8)
    for k, chars in enumerate((
        b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r",
        b".,;:", b"!?", b"#*$%&", b"|<>", b"\"'()[]{}-_/=+@",
    )):
        table[list(chars)] = k
    table[0x80:0xC0] = 11
    table[0xC0:] = 12
    return table


CLASS_OF, N_CLASSES = _classes(), 13
WIDTH = N_CLASSES + N_CLASSES**2 + 6


def encode(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Passage vectors of documents laid end to end, and the document of each passage."""
    per_doc = np.maximum(1, -(-lengths // PASSAGE))
    doc = np.repeat(np.arange(len(lengths)), per_doc)
    size = np.full(len(doc), PASSAGE, np.int64)
    last = np.cumsum(per_doc) - 1
    size[last] = lengths - (per_doc - 1) * PASSAGE
    n, at = len(doc), np.repeat(np.arange(len(doc), dtype=np.int32), size)
    kind = CLASS_OF[data].astype(np.int32)
    total = np.maximum(size, 1)[:, None].astype(np.float32)
    one = np.bincount(at * N_CLASSES + kind, minlength=n * N_CLASSES).reshape(n, -1) / total
    inside = at[1:] == at[:-1]
    pair = (at[:-1] * (N_CLASSES**2) + kind[:-1] * N_CLASSES + kind[1:])[inside]
    two = np.bincount(pair, minlength=n * N_CLASSES**2).reshape(n, -1) / total
    gram = data[:-3].astype(np.int32) * 29 + data[1:-2] * np.int32(31) + data[2:-1] * np.int32(37) + data[3:] * np.int32(41)
    within = at[3:] == at[:-3]
    slot = np.bincount((at[:-3] * 256 + (gram & 255))[within], minlength=n * 256).reshape(n, -1) / total
    repeat = np.sqrt((slot * slot).sum(axis=1, keepdims=True))
    blank = (kind == 3) | (kind == 4)
    starts = np.flatnonzero(~blank & np.r_[True, blank[:-1] | (at[1:] != at[:-1])]) if len(data) else np.empty(0, np.int64)
    again = np.zeros((n, 3), np.float32)
    if len(starts):
        lead = np.zeros(starts[0], np.int64)
        place = np.arange(len(data)) - np.r_[lead, np.repeat(starts, np.diff(np.r_[starts, len(data)]))]
        marks = np.where(blank, 0, (data.astype(np.int64) + 1) * ((place * 2654435761 + 97) & 0xFFFFF))
        word, of = np.add.reduceat(marks, starts), at[starts]
        n_words = np.bincount(of, minlength=n)
        for k in (1, 2):
            same = (word[k:] == word[:-k]) & (of[k:] == of[:-k])
            again[:, k - 1] = np.bincount(of[k:][same], minlength=n) / np.maximum(n_words, 1)
        again[:, 2] = np.minimum(n_words, 100) / 100
    shape = np.log1p(size)[:, None] / np.log(PASSAGE)
    return np.hstack([one, two, repeat, again, shape, np.ones((n, 1))]).astype(np.float32), doc


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    v: np.ndarray
    u: np.ndarray
    w: np.ndarray
    c: np.ndarray
    b: float

    def forward(self, x: np.ndarray, starts: np.ndarray) -> tuple:
        """Of standardised passages, bags starting at ``starts``: logits and what backward needs."""
        t, g = np.tanh(x @ self.v), 1 / (1 + np.exp(-(x @ self.u)))
        e = (t * g) @ self.w
        count = np.diff(np.append(starts, len(x)))
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), count))
        a = e / np.repeat(np.add.reduceat(e, starts), count)
        z = np.add.reduceat(a[:, None] * x, starts, axis=0)
        return z @ self.c + self.b, (t, g, a, z, count)

    def score(self, x: np.ndarray, doc: np.ndarray) -> np.ndarray:
        starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        logit, _ = self.forward(np.clip((x - self.mean) / self.scale, -8, 8), starts)
        return 1 / (1 + np.exp(-logit.astype(np.float64)))


def fit(bags: list[np.ndarray], labels: np.ndarray, seed: int = 3) -> Model:
    """Fits all weights together by Adam on the log loss."""
    rng = np.random.default_rng(seed)
    x = np.concatenate(bags)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    bags = [np.clip((b - mean) / scale, -8, 8) for b in bags]
    d = x.shape[1]
    p = {
        "v": rng.normal(0, d**-0.5, (d, HIDDEN)), "u": rng.normal(0, d**-0.5, (d, HIDDEN)), "w": rng.normal(0, 0.1, HIDDEN),
        "c": np.zeros(d), "b": np.zeros(1),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            xs = np.concatenate([bags[i] for i in pick])
            starts = np.cumsum([0, *(len(bags[i]) for i in pick[:-1])])
            m = Model(mean, scale, p["v"], p["u"], p["w"], p["c"], p["b"][0])
            logit, (t, g, a, z, count) = m.forward(xs, starts)
            dl = (1 / (1 + np.exp(-logit)) - labels[pick]) / len(pick)
            spread = np.repeat(dl, count)
            da = (xs @ p["c"]) * spread
            de = a * (da - np.repeat(np.add.reduceat(a * da, starts), count))
            grad = {
                "c": z.T @ dl, "b": np.array([dl.sum()]), "w": (t * g).T @ de,
                "v": xs.T @ (de[:, None] * p["w"] * g * (1 - t * t)), "u": xs.T @ (de[:, None] * p["w"] * t * g * (1 - g)),
            }
            step += 1
            for k, v in p.items():
                q = grad[k] + DECAY * v * (k != "b")
                one, two = moment[k]
                one += 0.1 * (q - one)
                two += 0.001 * (q * q - two)
                v -= (RATE * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Model(mean, scale, p["v"], p["u"], p["w"], p["c"], float(p["b"][0]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Model | None:
    """Fits on labelled rows that are not held out; labels (doc_id, label 0 or 1)."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.min("label").alias("label"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * most)
    body = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    rows = (
        docs.select("doc_id", body.alias("body"))
        .filter(F.octet_length("body") <= TRAIN_BYTES)
        .join(F.broadcast(sample), "doc_id")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "body")
        .limit(most)
    )

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column("body").to_pylist():
                data = np.frombuffer(text, np.uint8)
                out.append(encode(data, np.array([len(data)]))[0].astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("label").cast(pa.int32()), pa.array(out, pa.binary())], ["label", "vectors"])

    got = rows.select("label", "body").mapInArrow(vectors, "label int, vectors binary").collect()
    if len({r.label for r in got}) < 2:
        return None
    bags = [np.frombuffer(r.vectors, np.float16).reshape(-1, WIDTH).astype(np.float32) for r in got]
    return fit(bags, np.array([r.label for r in got], np.float32))


def add_score(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and ``score`` of every document, in the scan that reads the texts."""
    kept = docs.select(*keep)
    body = F.encode(F.coalesce(docs["text"], F.lit("")), "utf-8")

    def bag_scores(texts: list[bytes]) -> np.ndarray:
        if model is None:
            return np.full(len(texts), 0.5)
        lengths = np.array([len(t) for t in texts], np.int64)
        return model.score(*encode(np.frombuffer(b"".join(texts), np.uint8), lengths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            *carried, texts = b.columns
            scores, held, size = [np.empty(0)], [], 0
            for text in texts:
                t = text.as_py()
                held.append(t)
                size += len(t)
                if size >= STEP:
                    scores.append(bag_scores(held))
                    held, size = [], 0
            if held:
                scores.append(bag_scores(held))
            yield pa.RecordBatch.from_arrays([*carried, pa.array(np.concatenate(scores), pa.float64())], [*keep, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return docs.select(*keep, body.alias("_body")).mapInArrow(run, f"{fields}, score double")


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    return add_score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted")
    )
