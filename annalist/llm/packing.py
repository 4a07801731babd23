"""Packing: documents into sequences of at most ``width`` tokens, first-fit decreasing.

A document is its token ids and an end id. It is cut at multiples of the width; full pieces are
sequences of their own, the rest of each document is packed. Pieces go to random groups by a
seeded hash of their id, place, checksum and row; each group is packed alone, so groups are the unit of work and of
memory (about ``group_docs`` small rows), and no order over the corpus is needed.

First fit uses a tournament tree over the free space of the open bins: every inner node has
the larger of its children's, so the leftmost bin that fits is found in log2(bins) steps.

Tokenizing runs in Arrow batches before the shuffle; only (doc_id, start, length, checksum)
rows are shuffled. Ids are those of the ``tokenizers`` file; words are looked up in a bounded
memo, which is exact, since every pre-token of this vocabulary starts at a single space or after
other white space (texts with runs of spaces or special strings are encoded whole).

Defined results. Null or empty text: the end id alone. Null doc_id: packed as its own document.
Repeated rows: each is packed. Very long texts are cut like all. Empty table: no pieces.
Other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 2048
END_ID = 1
GROUP_DOCS = 8192
SEED = 20_240
#: Words held by the memo before it starts anew; bounds a worker's memory.
MEMO_WORDS = 400_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = f"{PIECES}, sequence_id long, offset long"


class WordMemo(dict):
    """Ids, as little-endian unsigned 32-bit bytes, of ``" " + word``."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMO_WORDS:
            self.clear()
        ids = self[word] = array("I", self.encode(" " + word)).tobytes()
        return ids


class Encoder:
    """Text to id bytes, equal to tokenizers' encode(text, add_special_tokens=False)."""

    def __init__(self, tokenizer_path: str, ranks_path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.whole = Tokenizer.from_file(tokenizer_path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.memo = WordMemo(self.encode)

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        if "  " in text:
            return array("I", self.encode(text)).tobytes()
        first, *rest = text.split(" ")
        return array("I", self.encode(first)).tobytes() + b"".join(map(self.memo.__getitem__, rest))


def cut(docs: DataFrame, tokenizer: tuple[str, str, str], width: int = WIDTH, end_id: int = END_ID) -> DataFrame:
    """(doc_id, text) to pieces of at most ``width`` ids, with the checksum of each piece's ids."""
    end = array("I", [end_id]).tobytes()
    schema = pa.schema([(x, pa.int64()) for x in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*tokenizer)
        for b in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = encoder(text.as_py() or "") + end
                n = len(ids) // 4
                view = memoryview(ids)
                for start in range(0, n, width):
                    part = view[4 * start : 4 * (start + width)]
                    rows.append((doc_id, start, len(part) // 4, zlib.crc32(part), n))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(pieces, PIECES)


def first_fit(sizes: list[int], width: int) -> list[tuple[int, int]]:
    """(bin, offset) for each size, in the order given; bins are numbered from 0.

    The tree starts with room for one bin and doubles when all its bins are in use.
    """
    leaves, tree, used = 1, [0, width], 0
    placed = []
    for size in sizes:
        if tree[1] < size:
            wider = 2 * leaves
            grown = [0] * (2 * wider)
            grown[wider : wider + leaves] = tree[leaves:]
            grown[wider + leaves :] = [width] * leaves
            for node in range(wider - 1, 0, -1):
                grown[node] = max(grown[2 * node], grown[2 * node + 1])
            leaves, tree = wider, grown
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        placed.append((node - leaves, width - tree[node]))
        used = max(used, node - leaves + 1)
        tree[node] -= size
        node //= 2
        while node:
            left, right = tree[2 * node], tree[2 * node + 1]
            best = left if left > right else right
            if tree[node] == best:
                break
            tree[node] = best
            node //= 2
    return placed


def pack(pieces: DataFrame, n_docs: int, width: int = WIDTH, group_docs: int = GROUP_DOCS, seed: int = SEED) -> DataFrame:
    """Gives every piece a sequence and its offset there; a sequence never spans two groups."""
    groups = max(1, -(-n_docs // group_docs))

    def one_group(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        placed = np.array(first_fit(rows["length"].tolist(), width), dtype=np.int64).reshape(-1, 2)
        rows = rows.drop(columns="_group")
        rows["sequence_id"] = (int(key[0]) << 40) + placed[:, 0]
        rows["offset"] = placed[:, 1]
        return rows

    # the checksum and the row's number spread null and repeated ids, and repeated rows
    key = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups))
    return pieces.withColumn("_group", key).groupBy("_group").applyInPandas(one_group, PACKED)
