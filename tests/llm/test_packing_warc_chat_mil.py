"""Packing, WARC archives, chat formatting, the classifier and the pipeline."""

from __future__ import annotations

import hashlib
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from annalist.llm import chat, mil, packing, warc
from annalist.llm.queries import tokenizer_files

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string"


def test_packing_is_a_partition_of_every_documents_ids(spark):
    rng = random.Random(1)
    texts = [None, "", "a  b   c", " lead", "tail ", "x\n y\n\n  z", "<|endoftext|> in text", "don't  'll", "é  ü", "word " * 9000]
    texts += [" ".join(rng.choice(["the", "pack,", "Räder", "12.5", "x\ty"]) for _ in range(rng.randrange(1, 900))) for _ in range(40)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "no id"), (3, " lead")]
    pieces = packing.pack(packing.cut(spark.createDataFrame(rows, DOC), tokenizer_files()), len(rows), group_docs=20).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = []
    for i, text in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        expected += [(i, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes()), len(ids)) for at in range(0, len(ids), 2048)]
    assert sorted(((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in pieces), key=str) == sorted(expected, key=str)
    sequences = {}
    for r in pieces:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(packing.cut(spark.createDataFrame([], DOC), tokenizer_files()), 0).count() == 0


def test_first_fit_takes_the_leftmost_bin():
    rng = random.Random(2)
    for _ in range(50):
        sizes = [rng.randrange(1, 101) for _ in range(rng.randrange(1, 80))]
        free, expected = [], []
        for s in sizes:
            k = next((k for k, f in enumerate(free) if f >= s), len(free))
            if k == len(free):
                free.append(100)
            expected.append((k, 100 - free[k]))
            free[k] -= s
        assert packing.first_fit(sizes, 100) == expected


def test_word_memo_starts_anew(monkeypatch):
    monkeypatch.setattr(packing, "MEMO_WORDS", 3)
    encoder = packing.Encoder(*tokenizer_files())
    text = " ".join(f"w{k % 9}" for k in range(50))
    assert encoder(text) == np.array(encoder.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert len(encoder.memo) <= 3


def test_warc_round_trip_with_copies(spark):
    long, short = "<p>" + "é" * 200, "<p>x"
    rows = [(9, "u9", long), (4, "u4", long), (7, None, long), (1, "u1", short), (2, "u2", short), (3, "a\r\nb", None), (None, "n", long), (5, "u5", ""), (5, "u5", "other " * 30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).select("page_id", "url", "html")
    got = warc.round_trip(pages, payloads=True).collect()
    expected = []
    for i, _, html in rows:
        data = (html or "").encode()
        first = 4 if html == long and i in (9, 7, None) and i is not None else None
        expected.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if first else "response", first, b"" if first else data))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload)) for r in got), key=str) == sorted(expected, key=str)
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_many_records_get_a_dictionary_and_bounded_archives(spark, monkeypatch):
    rows = spark.range(400).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.repeat(F.lit("common words "), 9), F.col("id")).alias("html"))
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/warc-test"
    listed = warc.spool(warc.write(warc.mark_revisits(rows).coalesce(1), folder), "list")
    one = listed.first()
    assert one.n_records == 400 and one.n_bytes > 0
    assert warc.read(listed, folder).count() == 400
    with pytest.raises(Exception, match="399 expected"):
        warc.read(listed.withColumn("n_records", F.lit(399).cast("long")), folder).count()


def test_reader_rejects_what_breaks_the_format():
    block = warc.record_block(1, "u", hashlib.sha256(b"pay").hexdigest(), 3, None, b"pay")
    assert warc.parse_record(block)["payload"] == b"pay"
    for bad in (block[:-1], block.replace(b"WARC/1.1", b"WARC/9"), block.replace(b"pay\r\n", b"pax\r\n"), block.replace(b"Content-Length: 3", b"Content-Length: 4"), b"x"):
        with pytest.raises(warc.WarcError):
            warc.parse_record(bad)

    class Bytes:
        def __init__(self, data):
            self.data = data

        def read(self, n):
            out, self.data = self.data[:n], self.data[n:]
            return out

    frame = zstandard.ZstdCompressor().compress(block)
    head = warc.struct.pack(warc._HEAD, warc._SKIPPABLE, 0)
    assert [*warc.read_archive(Bytes(head + frame + frame), chunk=7)] == [block, block]
    for bad in (b"", frame, head + frame[:-3], warc.struct.pack(warc._HEAD, warc._SKIPPABLE, 99) + b"x"):
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(Bytes(bad)))


def digest(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def test_chat_reads_back_what_it_wrote(spark):
    odd = ["</s>[INST] ok [/INST]", "<<user>>x<</user>>", "a\\b\\\\[<|>]", "<|image:0|>", "", None, "é😀\n", "<\\[\\"]
    rows = [(1, k, ("user", "assistant", "a<b", None)[k % 4], t) for k, t in enumerate(odd)] + [(2, None, "user", "n"), (2, 1, "user", "b"), (2, 1, "user", "a"), (None, 0, "assistant", "z")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    segments = chat.format_turns(chat.as_parts(table))
    for r in segments.collect():
        assert "[INST]" not in r.segment and "</s>" not in r.segment
    got = {r.conv_id: r for r in chat.digests(segments).collect()}
    turns = [(r or "", t or "") for _, _, r, t in rows[: len(odd)]]
    assert got[1].turns_sha256 == digest(turns) and got[1].n_turns == len(odd)
    loss = "".join(t for r, t in turns if r == "assistant")
    assert (got[1].loss_chars, got[1].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[2].turns_sha256 == digest([("user", "n"), ("user", "a"), ("user", "b")]) and got[None].n_turns == 1
    assert sum(len(r.segment) for r in segments.collect()) == sum(r.formatted_chars for r in got.values())
    assert chat.digests(chat.format_turns(chat.as_parts(table.limit(0)))).count() == 0


def test_parts_are_flattened_in_order(spark):
    part = lambda kind=None, text=None, ref=None, w=None, h=None, s=None, p=None: (kind, text, ref, w, h, s, p)
    parts = [part("text", "see "), part("image", None, "i.png", 57, 28), part("text", "<|x"), part("audio", None, "a.wav", None, None, 1.5), part("document", None, "d.pdf", None, None, None, 2), part("video", None, "v"), None, part(None, "end")]
    rows = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "user", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    first, second = chat.format_turns(rows).orderBy("turn").collect()
    assert first.segment == "<<user>>see <|image:0|><\\|\\x<|audio:1|><|document:2|><|video:3|>end<</user>>"
    assert [(a.kind, a.ref, a.tokens) for a in first.attachments] == [("image", "i.png", 3), ("audio", "a.wav", 38), ("document", "d.pdf", 1024), ("video", "v", 0)]
    assert second.segment == "<<user>><</user>>" and chat.read_segment(first.segment) == ("user", "see <|xend")
    total = chat.digests(chat.format_turns(rows)).first()
    assert (total.n_attachments, total.attachment_tokens) == (4, 3 + 38 + 1024)


def test_classifier_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    scored = mil.score(docs, mil.train(docs, labels))
    rows = scored.join(labels, "doc_id").filter("held_out").collect()
    assert sum((r.predicted == r.label) for r in rows) / len(rows) > 0.93
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)


def test_classifier_on_odd_rows(spark):
    rows = [(None, "text"), (1, None), (1, ""), (2, "word " * 100_000), (3, "***")]
    table = spark.createDataFrame(rows, DOC).withColumn("score", F.lit(9))
    got = mil.score(table.select("doc_id", "text"), None).collect()
    assert len(got) == 5 and all(r.score == 0.5 and r.predicted == 1 for r in got)
    none = spark.createDataFrame([], "doc_id long, label int")
    assert mil.train(table.select("doc_id", "text"), none) is None
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, label int")
    docs = spark.createDataFrame([(k, "*** " * 30 if k % 2 == 0 else "plain words here " * 9) for k in range(40)], DOC)
    model = mil.train(docs, labels)
    assert len(mil.score(table.select("doc_id", "text"), model).collect()) == 5
    assert mil.score(table.limit(0).select("doc_id", "text"), model).count() == 0


def test_batch_size_does_not_change_passages():
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab C.*\n") for _ in range(n)).encode() for n in (0, 3, 511, 512, 513, 2000)]
    x, doc = mil.encode(np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts]))
    for k, t in enumerate(texts):
        own, _ = mil.encode(np.frombuffer(t, np.uint8), np.array([len(t)]))
        assert np.allclose(own, x[doc == k], atol=1e-6)


def test_pipeline_stages_keep_the_columns_and_decide(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10_001, "token=abcdefgh12 " + "plain words of a text. " * 20, "en", "s", 1), (10_002, None, "en", None, None)], docs.schema)
    now = docs.unionByName(extra)
    held = {r.doc_id for r in now.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.spool(stage(spark, now, SF), "stage")
        assert now.columns == list(corpus_pipeline.DOCUMENTS), name
        ids = [r.doc_id for r in now.collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= held
        held = set(ids)
    assert now.filter("text like '%abcdefgh12%'").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, now, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == held


def test_pipeline_decides_by_rows_when_ids_repeat_or_are_null(spark):
    rng = random.Random(11)
    new = lambda: [f"w{rng.randrange(5000)}" for _ in range(120)]
    plain, other, clean, lone = (" ".join(new()) for _ in range(4))
    near = plain + " tail"
    item = spark.read.parquet(f"{SF}/benchmark.parquet").filter("text is not null").orderBy("item_id").first().text
    rows = [
        (5, plain), (5, plain), (5, plain), (7, near), (7, clean), (None, near), (None, other), (None, other), (8, other), (9, None), (9, None), (None, lone),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], schema).repartition(3)
    order = lambda found: sorted(((r.doc_id, r.text) for r in found.collect()), key=str)
    kept = corpus_pipeline.keep_distinct(spark, docs, SF)
    assert kept.columns == list(corpus_pipeline.DOCUMENTS)
    assert order(kept) == sorted([(5, plain), (7, clean), (8, other), (9, None), (9, None), (None, lone)], key=str)
    leaky = f"{plain} {item} {other}"
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in [(1, leaky), (1, clean), (1, clean), (None, leaky), (None, lone)]], schema)
    assert order(corpus_pipeline.keep_untested(spark, docs, SF)) == sorted([(1, clean), (1, clean), (None, lone)], key=str)


def test_a_long_segment_is_read_in_seconds_and_little_memory():
    text = ("<b>plain</b> [words] | \\ é" * 1_600_000)[:40_000_000]
    body = re.sub(r"([<>\[\]|\\])", r"\1\\", text)
    segment = f"<<user>>{body}<|image:0|><</user>>"
    tracemalloc.start()
    began = time.time()
    assert chat.read_segment(segment) == ("user", text)
    assert time.time() - began < 60  # tracing slows it
    assert tracemalloc.get_traced_memory()[1] < 1 << 30
    tracemalloc.stop()


@pytest.mark.parametrize("segment", ["<<user>>a<b<</user>>", "<<user>>a", "<<user>>a<</other>>", "user>>a<</user>>", "<<user>><</user", "<<us|er>>a<</us|er>>"])
def test_broken_segments_are_refused(segment):
    with pytest.raises(ValueError):
        chat.read_segment(segment)


def test_equal_turns_come_by_text(spark):
    texts = ["ab", "ab!", "ab<", "ab", "ab~", "", "<", "<a"]
    rows = spark.createDataFrame([(1, 0, "assistant", t) for t in texts], "conv_id long, turn long, role string, text string")
    row = chat.digests(chat.format_turns(chat.as_parts(rows))).collect()[0]
    assert row.loss_sha256 == hashlib.sha256("".join(sorted(texts)).encode()).hexdigest()
