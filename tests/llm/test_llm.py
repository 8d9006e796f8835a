"""The llm operators against brute force, on the driver's small tables and on hand-made edge cases."""

import hashlib
import io
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tidewell.llm import compaction, components, decontaminate, jaccard_join, language_id, license_scan, multiset_hash, packing, quality_cnn, token_counts, warc
from tidewell.llm.common import crc_mod
from tidewell.plans import compare

EDGES = [
    (1, "the cat sat on the mat and the dog ran off to the far hill", "en"), (2, "the cat sat on the mat and the dog ran off to the far hill", "en"), (3, None, "en"), (4, "", None), (5, " \n\t ", "fr"),
    (6, "x" * 150_000, "en"), (7, "le chat est sur la table et le chien dort\n\nle chat", "fr"), (8, "12345 !!! ###", None), (9, "Ünï ✓ 日本語 <|endoftext|> it's", "de"), (10, "a b", "en"), (10, "a b c d e f", "en"), (10, "a b", "en"),
    (None, "lost text without an id here", "en"), (12, " ".join(f"w{i}" for i in range(20_000)), "en"), (13, "the cat sat on the mat and the dog ran off to the far hills", "en"),
]
SCHEMA = "doc_id long, text string, lang string, source string, score double, n string, sig string, bucket int"


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(i, t, lang, "s", 0.5, "x", "y", 1) for i, t, lang in EDGES], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# --- op1 -------------------------------------------------------------------------------------------------------


def check_pieces(rows, texts, limit=2048, segments=64):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    ids = [np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for x in texts]
    assert sum(r.length for r in rows) == sum(map(len, ids))
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r.offset)
        assert [p.offset for p in parts] == [sum(q.length for q in parts[:i]) for i in range(len(parts))]
        total = sum(p.length for p in parts)
        assert total <= limit and len(parts) <= segments and (total == limit or total & (total - 1) == 0)
    return ids


def test_packing_keeps_every_token_once(spark, docs):
    data = docs.select("doc_id", "text").collect()
    rows = packing.pack_documents(docs, packing.default_tokenizer()).collect()
    ids = dict(zip([r.doc_id for r in data], check_pieces(rows, [r.text for r in data]), strict=True))
    by_doc = defaultdict(list)
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        by_doc[r.doc_id].append((r.start, r.length))
    assert set(by_doc) == set(ids)
    for pieces in by_doc.values():
        pieces.sort()
        assert [s for s, _ in pieces] == [sum(n for _, n in pieces[:i]) for i in range(len(pieces))]


def test_packing_edges(edges, empty):
    check_pieces(packing.pack_documents(edges, packing.default_tokenizer()).collect(), [t for _, t, _ in EDGES])
    assert packing.pack_documents(empty, packing.default_tokenizer()).count() == 0


def test_tokens_equal_the_tokenizers():
    coder, rng = packing.WordTokens(packing.default_tokenizer()), random.Random(1)
    bits = ["'s", "'", "l", "re", "ve", "T", " ", "\n", ".", "!", "9", "é", "Ö", "-", "<", "|", ">", "ab", "\x0b", "✓", "×", "don't "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    assert [x.tolist() for x in coder.encode(pa.array(texts))] == [x.tolist() for x in coder.plain(texts)]


def test_short_texts_need_no_padding(spark):
    for n, words in ((3000, 4), (700, 19)):
        df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(" ".join(["word"] * words)).alias("text"))
        rows = packing.pack_documents(df, packing.default_tokenizer()).collect()
        total = defaultdict(int)
        for r in rows:
            total[r.sequence_id] += r.length
        assert sum(total.values()) == n * (words + 1)
        assert all(x == 2048 or x & (x - 1) == 0 for x in total.values())


def test_long_examples_are_let_go_as_they_are_placed():
    data = [np.arange(n, dtype="<u4").tobytes() for n in (5, 300_000, 1, 2048, 5000)]
    rows = list(packing.pack_rows(((i, d, 0) for i, d in enumerate(data)), packing.VectorPacker(), 1 << 33))
    got = defaultdict(list)
    for i, start, length, crc, total, _, _ in rows:
        assert total == len(data[i]) // 4 and crc == zlib.crc32(data[i][4 * start : 4 * (start + length)])
        got[i].append((start, length))
    assert all(sum(n for _, n in got[i]) == len(d) // 4 for i, d in enumerate(data))


def test_instruction_data_keeps_the_loss_limit(spark, sf):
    talk = spark.read.parquet(f"{sf}/conversations.parquet")
    examples = packing.instruction_examples(talk)
    rows = packing.pack_documents(examples.withColumn("doc_id", F.hash("doc_id", "prompt", "text").cast("long")), packing.default_tokenizer(), tokens=512, segments=8, loss=300, prompt="prompt").collect()
    coder = packing.WordTokens(packing.default_tokenizer())
    data = [(r.prompt, r.text) for r in examples.collect()]
    by = {(r.conv_id, r.turn): r for r in talk.collect()}
    want = sorted((str((p := by.get((k, t - 1))) and p.text), str(r.text)) for (k, t), r in by.items() if r.role == "assistant")
    assert len(by) == talk.count() and sorted((str(p), str(t)) for p, t in data) == want
    size = lambda t: len(coder.plain([t or ""])[0])
    assert sum(r.length for r in rows) == sum(size(p) + size(t) + 1 for p, t in data)
    ids = {r.doc_id: size(r.prompt) for r in examples.select(F.hash("doc_id", "prompt", "text").cast("long").alias("doc_id"), "prompt").collect()}
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append(r)
    bears = [sum(max(0, r.start + r.length - max(r.start, ids[r.doc_id])) for r in parts) for parts in bins.values()]
    assert max(bears) == 300 and all(len(parts) <= 8 and sum(r.length for r in parts) <= 512 for parts in bins.values())


def test_packer_respects_all_limits():
    rng = random.Random(3)
    p = packing.VectorPacker(tokens=64, segments=4, loss=40, pool=50)
    items = {k: (n := rng.randint(1, 150), rng.randint(0, n)) for k in range(400)}
    pieces = [x for k, (n, prompt) in items.items() for x in p.add(k, n, prompt)] + list(p.finish())
    seen, bins = defaultdict(list), defaultdict(list)
    for key, start, stop, sequence, offset in pieces:
        seen[key].append((start, stop))
        bins[sequence].append((offset, start, stop, items[key][1]))
    for key, (n, _) in items.items():
        spans = sorted(seen[key])
        assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    for parts in bins.values():
        parts.sort()
        assert len(parts) <= 4 and sum(b - a for _, a, b, _ in parts) <= 64 and sum(max(0, b - max(a, f)) for _, a, b, f in parts) <= 40
        assert all(parts[i][0] == sum(b - a for _, a, b, _ in parts[:i]) for i in range(len(parts)))


# --- op2 -------------------------------------------------------------------------------------------------------


M64 = (1 << 64) - 1


def plain_mix(h):
    h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 & M64
    h = (h ^ h >> 29) * 0xBF58476D1CE4E5B9 & M64
    return h ^ h >> 32


def plain_fingerprint(text):
    """The sums of each paragraph's lanes, one window after another."""
    signed, exact = [0] * 128, [0] * 4
    for line in text.encode().split(b"\n"):
        digest = hashlib.blake2b(line, digest_size=32).digest()
        exact = [(x + int.from_bytes(digest[8 * k : 8 * k + 8], "little")) & M64 for k, x in enumerate(exact)]
        windows = [plain_mix(int.from_bytes(line[i : i + 8], "little")) for i in range(len(line) - 7)]
        if 0 < len(line) < 8:
            windows = [int(multiset_hash.span_hashes(np.frombuffer(line, np.uint8), np.array([0]), np.array([len(line)]))[0])]
        for u in windows:
            signed[u >> 57] += -1 if u >> 56 & 1 else 1
    return signed, exact


def plain_likeness(a, b):
    if a == b:
        return 1.0
    norm = (sum(x * x for x in a[0]) * sum(y * y for y in b[0])) ** 0.5
    return min(1.0, max(0.0, sum(x * y for x, y in zip(a[0], b[0], strict=True)) / norm)) if norm else 0.0


def test_fingerprints_equal_brute_force(docs):
    few = docs.where("doc_id % 2 = 0")
    data = sorted(((r.doc_id, r.text or "") for r in few.select("doc_id", "text").collect()), reverse=True)
    got = {r.doc_id: r for r in multiset_hash.fingerprints(few).collect()}
    assert len(got) == len(data)
    marks = [plain_fingerprint(t) for _, t in data]
    for i, (k, t) in enumerate(data):
        after, n, r = data[(i + 1) % len(data)][1], len(t) // 3, got[k]
        edited = t[: len(t) - n] + after[:n]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        for text, mark in ((r.fingerprint, marks[i]), (r.edited_fingerprint, plain_fingerprint(edited))):
            lanes, exact = multiset_hash.decoded(text)
            assert (lanes.tolist(), exact.tolist()) == mark
        assert r.near_edited == pytest.approx(plain_likeness(marks[i], plain_fingerprint(edited)))
        assert r.near_next == pytest.approx(plain_likeness(marks[i], marks[(i + 1) % len(data)]))
    both = [(r.near_edited, r.near_next) for r in got.values() if r.n_chars > 300]
    assert sum(a > b for a, b in both) > 0.97 * len(both)


def test_fingerprints_of_long_and_repetitive_texts():
    rng = random.Random(8)
    lines = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(0, 90))) for _ in range(30_000)]
    text = "\n".join(lines)  # over a block
    assert len(text) > multiset_hash.BLOCK_BYTES
    rng.shuffle(lines)
    assert multiset_hash.fingerprint(text) == multiset_hash.fingerprint("\n".join(lines))
    one = "x" * (multiset_hash.BLOCK_BYTES + 5)  # a paragraph over a block
    assert multiset_hash.fingerprint(one + "\nend") == multiset_hash.fingerprint("end\n" + one)
    line, k = "the same line of some seventy characters is repeated again and again....", 60_000
    text = "\n".join([line] * k)
    a, b = ([x[None] for x in multiset_hash.decoded(multiset_hash.fingerprint(t))] for t in (text, text[: 2 * len(text) // 3]))
    assert multiset_hash.likeness(a, b)[0] > 0.99  # no lane wraps


def test_rows_of_one_id_are_many_buckets(spark):
    rows = [(5 if i % 3 == 0 else None if i % 3 == 1 else i, f"text {i} " * 3) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = multiset_hash.with_next(df)
    sizes = sorted((r["count"] for r in got.where("not guest").groupBy("bucket").count().collect()), reverse=True)
    assert sum(sizes) == len(rows) and len(sizes) >= 8 and sizes[0] < 600
    out = multiset_hash.fingerprints(df).collect()
    assert sorted(map(str, ((r.doc_id, r.n_chars) for r in out))) == sorted(map(str, ((i, len(t)) for i, t in rows)))


def test_fingerprint_is_a_homomorphism():
    f = multiset_hash.fingerprint
    assert f("a\nb\nlong line here") == f("long line here\na\nb") != f("a\nb")
    assert multiset_hash.changed(f("a\nb"), inserted=["long line here"], deleted=["a"]) == f("long line here\nb")
    assert f("a\na") != f("a") and f("") != f("\n")


def test_fingerprint_edges(edges, empty):
    rows = multiset_hash.fingerprints(edges).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_chars) for r in rows) == sorted((i is None, i or 0, len(t or "")) for i, t, _ in EDGES)
    assert multiset_hash.fingerprints(empty).count() == 0
    one = multiset_hash.fingerprints(edges.where("doc_id = 7")).collect()
    assert one[0].near_next == 1.0


# --- op3 and op9 -----------------------------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark, docs, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    own = docs.unionByName(spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 10_000))
    labels = labels.unionByName(spark.read.parquet(f"{sf.replace('0.001', '0.01')}/labels.parquet").withColumn("doc_id", F.col("doc_id") + 10_000))
    learn = crc_mod(F.col("doc_id"), 5) != 0
    got = {r.doc_id: r.score for r in quality_cnn.classify(own, own.where(learn), labels.where(learn), epochs=8).where(~learn).collect()}
    gold = {r.doc_id: r.quality for r in labels.where(~learn).collect() if r.doc_id in got}
    good, bad = [got[k] for k, q in gold.items() if q == 1], [got[k] for k, q in gold.items() if q == 0]
    assert len(bad) >= 5 and np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([g >= 0.3 for g in good]) > 0.95


def test_quality_labels_of_one_id(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, None), (None, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (1, 1), (2, 0), (3, 1), (None, 1), (2, None)], "doc_id long, quality int")
    assert sorted(quality_cnn.labelled_rows(df, labels, "quality", 100)) == [("a", 1), ("b", 1), ("c", 0)]
    assert len(quality_cnn.labelled_rows(df, labels, "quality", 2)) == 2


def test_long_training_texts_are_read_whole():
    net = quality_cnn.fit([b"good words here " * 20, b"!! ## !! ## " * 20] * 8, [1, 0] * 8, epochs=2)
    text = bytes(np.random.default_rng(0).integers(97, 123, 3 * quality_cnn.PIECE).astype(np.uint8))

    def gradients():
        grads = [np.zeros_like(p) for p in (net.taps, net.bias, net.out)]
        return quality_cnn.backward(net, text, 1, grads), grads

    d, in_pieces = gradients()
    size, quality_cnn.PIECE = quality_cnn.PIECE, 1 << 22
    try:
        whole_d, whole = gradients()
    finally:
        quality_cnn.PIECE = size
    assert d == whole_d and all(np.array_equal(a, b) for a, b in zip(in_pieces, whole, strict=True))


def test_cnn_blocks_do_not_leak():
    rng = np.random.default_rng(0)
    net = quality_cnn.fit([b"good words here " * 20, b"!! ## !! ## " * 20] * 8, [1, 0] * 8, epochs=2)
    texts = ["".join(chr(97 + c) for c in rng.integers(0, 26, n)) for n in (0, 1, 4, 127, 128, 129, 700, 70_000, 5, 200_000)]
    whole = quality_cnn.scores(net, *quality_cnn.text_buffers(pa.array(texts)))
    each = [quality_cnn.scores(net, *quality_cnn.text_buffers(pa.array([t])))[0] for t in texts]
    assert np.allclose(whole, each, atol=1e-5)

    def plain(text):  # the same network without blocks
        x = np.concatenate([np.frombuffer(text.encode(), np.uint8), np.zeros(quality_cnn.TAPS, np.uint8)])
        y = quality_cnn.convolve(net.taps, x)[: len(text) + 1] + net.bias
        chunks = [np.maximum(y[a : a + 256].max(axis=0), 0) for a in range(0, max(1, len(y) - 128 if len(y) > 128 else 1), 128)]
        z = np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0)]) @ net.out + net.out_bias
        return 1 / (1 + np.exp(-z))

    assert np.allclose(whole[:8], [plain(t) for t in texts[:8]], atol=1e-4)


def test_models_with_edges(spark, edges, empty):
    labels = spark.createDataFrame([(1, 1), (8, 0), (99, None), (None, 1)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in quality_cnn.classify(edges, edges, labels).collect())
    assert quality_cnn.classify(edges, edges, labels.limit(0)).count() == len(EDGES)
    assert quality_cnn.classify(empty, empty, labels).count() == 0
    got = [(r.doc_id, r.lang_pred, r.score) for r in language_id.identify(edges, edges).collect()]
    assert len(got) == len(EDGES) and {x[1] for x in got} <= {"en", "fr", "de", "und"}
    assert all(p == "und" and s == 0 for i, p, s in got if i in (3, 4, 5, 8))
    assert {r.lang_pred for r in language_id.identify(edges, empty).collect()} == {"und"}
    assert language_id.identify(empty, empty).count() == 0


def test_language_accuracy(docs):
    learn = crc_mod(F.col("doc_id"), 3) != 1
    hit = language_id.identify(docs, docs.where(learn), keep=["doc_id", "lang"]).where(~learn)
    assert hit.count() > 40 and hit.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


def test_language_model_is_sparse_and_calibrated(docs):
    rows = [(r.text, r.lang) for r in docs.where("text is not null and lang is not null").collect()]
    model, plain = language_id.train(rows, bits=14), language_id.train(rows, bits=14, l1=0.0)
    zero = lambda m: float((m.weights == 0).mean())
    assert zero(model) > zero(plain) + 0.02  # L1 sets weights to zero that are not otherwise
    strong = language_id.train(rows, bits=14, l2=10.0)
    assert np.abs(strong.weights).sum() < np.abs(model.weights).sum()  # L2 shrinks them
    rng = np.random.default_rng(0)
    gold = rng.integers(0, 3, 4000)
    z = rng.standard_normal((4000, 3))
    z[np.arange(4000), gold] += 1.0
    assert language_id.fit_temperature(5 * z, gold) == pytest.approx(5 * language_id.fit_temperature(z, gold), rel=1e-3)


def test_language_temperature_sees_no_trained_text(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"{'the cat and' if i % 2 else 'le chat et'} {i // 4} " * 12, "en" if i % 2 else "fr") for i in range(400)], "doc_id long, text string, lang string")
    data = language_id.sampled_examples(df, "lang", 1000, 16)
    rows = defaultdict(int)
    for row, _, _, _ in data:
        rows[row] += 1
    # copies, and a text and its piece, are of one source row, so on one side
    assert len(rows) == 200 and set(rows.values()) == {4}
    few = language_id.sampled_examples(df, "lang", 10, 16)
    assert sum(lang == "en" for _, lang, _, _ in few) == 20
    assert language_id.sampled_examples(df.limit(0), "lang", 10, 16) == []


def test_long_text_scores_as_its_grams(monkeypatch):
    model = language_id.train([("the cat and the dog", "en"), ("le chat et la table", "fr")] * 10)
    text = "the cat and the dog ran " * 500
    want = language_id.predict(model, [text])
    monkeypatch.setattr(language_id, "BLOCK_CHARS", 1000)
    got = language_id.predict(model, [text])
    assert got[0] == want[0] and got[1] == pytest.approx(want[1], abs=1e-4)


# --- op4 -------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "z" * 1500
    rows = [(1, "u1", big), (2, None, big), (3, "u\r\n3", big), (3, "again", big), (4, "u4", "short"), (5, "u5", "short"), (6, "u6", None), (None, "u7", big), (8, "u8", "é" * 600), (9, "u9", "y" * 300_000)]
    pages = spark.createDataFrame([(*r, 7) for r in rows], "page_id long, url string, html string, digest int")
    files = warc.write_warc(pages, f"file://{tmp_path}/w", file_bytes=2000)
    assert files.count() > 1
    got = warc.read_warc(files).collect()
    assert len(got) == len(rows)
    by = {(r.page_id, r.url): r for r in got}
    assert {(k[0], by[k].record_type, by[k].refers_to) for k in by} == {
        (1, "revisit", 3), (2, "revisit", 3), (3, "response", None), (4, "response", None), (5, "response", None), (6, "response", None), (None, "response", None), (8, "response", None), (9, "response", None),
    }
    html = {r[0]: (r[2] or "").encode() for r in rows}
    for r in got:
        body = html[r.page_id] if r.page_id is not None else big.encode()
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
        assert r.html is None if r.record_type == "revisit" else bytes(r.html) == body
    assert warc.read_warc(warc.write_warc(pages.limit(0), f"file://{tmp_path}/none")).count() == 0


def test_warc_of_hot_pages(spark, tmp_path):
    """A third of all rows are null pages, a third one error page, and some of those have no page_id."""
    big = "<p>" + "z" * 1500
    rows = [(None if i % 50 == 0 else i, f"u{i}", [None, big, f"{i}" * 400][i % 3]) for i in range(900)]
    got = warc.read_warc(warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/hot")).collect()
    first = max(i for i, _, h in rows if h == big and i is not None)
    want = {(i, u, "revisit" if h == big and i is not None and i < first else "response", first if h == big and i is not None and i < first else None) for i, u, h in rows}
    assert len(got) == len(rows) and {(r.page_id, r.url, r.record_type, r.refers_to) for r in got} == want
    assert all(r.payload_digest == hashlib.sha1((h or "").encode()).hexdigest() for r in got for h in [rows[int(r.url[1:])][2]])


def test_warc_reader_frames_and_refuses():
    data = b"".join(warc.page_record(i, "u", b"x" * i * 100, hashlib.sha1(b"x" * i * 100).hexdigest(), i * 100, None) for i in range(6))
    for size in (1, 7, 100, 1 << 16):
        assert [int(h["warc-page-id"]) for h, _ in warc.read_records(io.BytesIO(data), size)] == list(range(6))
    plain = zlib.decompressobj(31).decompress(warc.frame([("WARC-Type", "resource")], b"abc"))
    assert [b for _, b in warc.read_records(io.BytesIO(plain * 3), 5)] == [b"abc"] * 3
    for length in (b"", b"Content-Length: x\r\n"):
        with pytest.raises(warc.BadRecord):
            list(warc.read_records(io.BytesIO(b"WARC/1.1\r\n" + length + b"A: b\r\n\r\nabc\r\n\r\n")))
    with pytest.raises(warc.BadRecord):
        list(warc.read_records(io.BytesIO(data[:-4])))
    with pytest.raises(warc.BadRecord):
        list(warc.read_records(io.BytesIO(plain[:-1])))
    with pytest.raises(warc.BadRecord):
        list(warc.read_records(io.BytesIO(warc.frame([("WARC-Block-Digest", "sha1:00")], b"abc"))))


# --- op5 -------------------------------------------------------------------------------------------------------


def brute_count(first, later, word):
    n = i = 0
    while i < len(word):
        j = next((j for j in range(len(word), i, -1) if word[i:j] in (later if i else first)), None)
        if j is None:
            return -1
        n, i = n + 1, j
    return n


def test_longest_match_equals_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        make = lambda n, low=1: {bytes(rng.choice(b"abc") for _ in range(rng.randint(low, 5))) for _ in range(n)}
        first, later = make(8), make(10)
        match = token_counts.LongestMatch(first, later)
        for _ in range(200):
            w = bytes(rng.choice(b"abcd") for _ in range(rng.randint(0, 12)))
            assert match.count(w) == brute_count(first, later, w), (first, later, w)


def test_token_counts(docs, edges, empty):
    first, later = map(set, token_counts.rank_file_pieces(token_counts.default_vocabulary()))
    for df in (docs.limit(40), edges.where("length(text) < 100000 or text is null")):
        texts = [r.text for r in df.select("text").collect()]
        want = []
        for t in texts:
            n = [brute_count(first, later, w) for w in (t or "").encode().split()]
            want.append((len(n), sum(1 if x < 0 else x for x in n), n.count(-1)))
        assert sorted(want) == sorted((r.n_words, r.n_tokens, r.n_unknown) for r in token_counts.token_counts(df, token_counts.default_vocabulary()).collect())
    assert token_counts.token_counts(edges, token_counts.default_vocabulary()).count() == len(EDGES)
    assert token_counts.token_counts(empty, token_counts.default_vocabulary()).count() == 0


# --- op6 -------------------------------------------------------------------------------------------------------


def test_compaction(spark, edges, empty, tmp_path):
    store = compaction.ShardStore(spark, f"file://{tmp_path}/s", edges.schema, target=60_000, fanout=3, keep_versions=2)
    assert store.read().count() == 0
    for i in range(4):
        store.append(edges.where(F.coalesce(F.col("doc_id"), F.lit(0)) % 4 == i).coalesce(1))
    before = store.versions()[-1]
    assert len(store.shards()) == 4
    small = store.shards()
    merges = store.compact()
    assert merges >= 1 and len(store.shards()) < len(small) and not store.due(store.shards())
    key = lambda df: sorted(map(str, df.collect()))
    assert key(store.read()) == key(edges)
    assert before in store.versions() and key(store.read(before)) == key(edges)
    other = compaction.ShardStore(spark, f"file://{tmp_path}/s", edges.schema)
    taken = other.versions()[-1]
    other.versions = lambda: [taken - 1]
    with pytest.raises(RuntimeError):
        other.commit([])
    assert store.arrived == 4 and sum(x.size for x in store.shards()) > 0
    each = compaction.ShardStore(spark, f"file://{tmp_path}/e", edges.schema, target=60_000, fanout=2)
    assert each.append_each(empty.withColumn("b", F.lit(1)), "b") == []
    each.append_each(edges.withColumn("b", F.col("doc_id") % 3), "b")
    assert key(each.read()) == key(edges)


def test_manifests_of_many_versions(spark, tmp_path):
    """Manifests list changes, and all shards now and then; every kept version reads as it was."""
    store = compaction.ShardStore(spark, f"file://{tmp_path}/m", spark.range(1).schema, fanout=3, keep_versions=60)
    held = []
    for i in range(2 * compaction.WHOLE + 3):
        store.commit([compaction.Shard(f"f{i}", i), compaction.Shard(f"g{i}", i)], [s for s in store.shards() if s.path == f"g{i - 1}"])
        held = [p for p in held if p != f"g{i - 1}"] + [f"f{i}", f"g{i}"]
        assert sorted(s.path for s in store.shards()) == sorted(held)
    assert [len(store.shards(v)) for v in (1, 2, compaction.WHOLE, compaction.WHOLE + 1)] == [2, 3, compaction.WHOLE + 1, compaction.WHOLE + 2]
    assert len(store.manifest(compaction.WHOLE)["added"]) == 2 and len(store.manifest(compaction.WHOLE + 1)["added"]) == compaction.WHOLE + 2


def test_compaction_reaches_target_sizes(spark, tmp_path):
    df = spark.range(200_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("s"))
    store = compaction.ShardStore(spark, f"file://{tmp_path}/t", df.schema, target=6 << 20, fanout=4)
    store.append_each(df.coalesce(4).withColumn("a", F.col("id") % 12), "a")
    sizes = sorted(s.size for s in store.shards())
    assert store.arrived == 48 and len(sizes) < 16 and not store.due(store.shards())
    assert sum(sizes[-2:]) > 0.3 * sum(sizes) and sizes[-1] < 2 * (6 << 20)
    assert store.read().agg(F.count("*"), F.sum("id"), F.countDistinct("s")).first() == (200_000, 200_000 * 199_999 // 2, 200_000)


# --- op7 -------------------------------------------------------------------------------------------------------


def test_licenses(spark, edges, empty):
    texts = ["some words\nLicensed under the Apache License, Version 2.0.\nmore", "Released under the MIT License.\n\nLicensed under CC BY-NC 4.0.", "Driver license renewals are due.", "This work is licensed under the GNU General Public License, version 2.", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_paragraphs, [(p.number, p.family) for p in r.paragraphs]) for r in license_scan.scan_licenses(df).collect()}
    assert got == {0: (1, [(0, "Apache-2.0")]), 1: (2, [(0, "MIT"), (1, "CC-BY-NC")]), 2: (1, []), 3: (1, [(0, "GPL-2.0")]), 4: (0, []), 5: (0, [])}
    assert license_scan.scan_licenses(edges).count() == len(EDGES) and license_scan.scan_licenses(empty).count() == 0


def test_license_model_knows_each_template():
    m = license_scan.trained()
    for family, texts in license_scan.TEMPLATES.items():
        for t in texts:
            z = np.array(m.bias) + sum((np.array(m.weights[g]) for g in license_scan.word_ngrams(t) if g in m.weights), np.zeros(len(m.classes)))
            assert m.classes[int(z.argmax())] == family


def test_licenses_in_bodies_headers_and_longer_paragraphs(spark):
    bodies, filler = license_scan.BODIES, " ".join(f"word{i} and then" for i in range(60))
    cases = [
        (bodies["MIT"][0], ["MIT"]),
        ("Copyright (c) 2020 Jane Doe. Released under the MIT License.", ["MIT"]),
        ("This project is licensed under the MIT License - see the LICENSE.md file for details.", ["MIT"]),
        (" ".join(bodies["Apache-2.0"][:2]), ["Apache-2.0"]),
        (bodies["GPL-3.0"][0], ["GPL-3.0"]),
        (bodies["GPL-2.0"][0].replace("free software:", "free software;"), ["GPL-2.0"]),
        (bodies["LGPL"][0], ["LGPL"]),
        (bodies["AGPL-3.0"][0], ["AGPL-3.0"]),
        (f"{filler}. Licensed under the Apache License, Version 2.0.", ["Apache-2.0"]),
        (f"{filler}. Licensed under CC BY-NC 4.0. {filler}", ["CC-BY-NC"]),
        ("// SPDX-License-Identifier: MIT", ["MIT"]),
        ("# SPDX-License-Identifier: GPL-2.0-or-later", ["GPL-2.0"]),
        ("Code is licensed under the MIT license, texts are licensed under CC BY 4.0.", ["CC-BY", "MIT"]),
        ("\n".join(bodies["BSD"]), ["BSD-2-Clause"]),
        ("\n".join([*bodies["BSD"], *bodies["BSD-3-Clause"]]), ["BSD-3-Clause"]),
        (bodies["BSD"][0], ["BSD"]),
        (bodies["ISC"][0], ["ISC"]),
        ("Released under the MIT licence.", ["MIT"]),
        ("Available under Apache-2.0", ["Apache-2.0"]),
        ("Released into the public domain under the Unlicense", ["Unlicense"]),
        # hard-wrapped notices with comment marks
        ("// Licensed under the Apache License, Version 2.0\n// (the \"License\"); you may not use this file\n// except in compliance with the License.", ["Apache-2.0"]),
        ("# This program is free software: you can redistribute it and/or\n# modify it under the terms of the GNU General\n# Public License as published by the Free Software Foundation,\n# either version 3 of the License, or any later version.", ["GPL-3.0"]),
        (f"{filler}. Please renew your driver license before it ends. {filler}", []),
        ("All rights reserved. The software is sold under a commercial license.", ["unknown"]),
        ("mit der license hat das nichts zu tun, version 2 of the software", []),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: sorted({p.family for p in r.paragraphs}) for r in license_scan.scan_licenses(df).collect()}
    assert {i: (cases[i][0][:80], f) for i, f in got.items() if f != cases[i][1]} == {}


def brute_licenses(text):
    """Each paragraph scored by all of its n-grams, one by one."""
    m = license_scan.trained()
    weights = {g: np.array(w) for g, w in m.weights.items()}
    parts = [p for p in re.split(r"\n\s*\n", text or "") if re.search(r"\S", p)]
    lines = [" ".join(license_scan.words(p)) for p in parts]

    def chances(grams):
        z = np.array(m.bias) + sum((weights[g] for g in grams if g in weights), np.zeros(len(m.classes)))
        p = np.exp(z - z.max())
        return p / p.sum()

    clause = max([3 if re.search(r"\bneither the names? of\b", x) else 2 if re.search(r"\bredistributions in binary form\b", x) else 0 for x in lines], default=0)
    out = []
    for k, line in enumerate(lines):
        grams, sure, likes = license_scan.word_ngrams(line), [], []
        for family in sorted(license_scan.TEMPLATES):
            if re.search(license_scan.MUSTS[family], line):
                best = max((len([g for g in t & grams if " " in g]) / len([g for g in t if " " in g]), sorted(t & grams)) for t in map(license_scan.word_ngrams, license_scan.TEMPLATES[family]))
                likes.append(best[0])
                if best[0] >= 0.5 and chances(best[1])[m.classes.index(family)] >= 0.5:
                    sure.append((k, {0: "BSD", 2: "BSD-2-Clause", 3: "BSD-3-Clause"}[clause] if family == "BSD" else family, round(best[0], 9)))
        p = chances(grams)
        out += sure or [(k, "unknown", round(max(likes, default=0.0), 9))] * bool(p.argmax() != len(p) - 1)
    return len(parts), out


def test_licenses_equal_brute_force(spark, docs):
    rng = random.Random(4)
    every = [t for ts in license_scan.TEMPLATES.values() for t in ts] + license_scan.NOTICES + license_scan.OTHERS
    pool = sorted({w for t in every for w in license_scan.words(t)})
    made = []
    for _ in range(250):
        parts = [rng.choice([rng.choice(every), " ".join(rng.choice(pool) for _ in range(rng.randint(1, 40))), f"xx {rng.choice(every)} yy\n{rng.choice(every)}"]) for _ in range(rng.randint(0, 4))]
        made.append(rng.choice(["\n", "\n\n", "\n \t\n", " "]).join(parts))
    texts = made + [r.text for r in docs.collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_paragraphs, [(p.number, p.family, round(p.likeness, 9)) for p in r.paragraphs]) for r in license_scan.scan_licenses(df).collect()}
    wrong = [(texts[i], got[i], want) for i in range(len(texts)) if got[i] != (want := brute_licenses(texts[i]))]
    assert not wrong, wrong[:2]


def test_license_calibration_on_unseen_templates():
    """The class that a fit without some templates gives them, and how sure it is, agree."""
    rows = license_scan.training_rows(12, np.random.default_rng(5))
    back = [(t, c) for t, c, b in rows if b]
    m = license_scan.trained()
    hits, sure = [], []
    for text, c in back:
        z = np.array(m.bias) + sum((np.array(m.weights[g]) for g in license_scan.word_ngrams(text) if g in m.weights), np.zeros(len(m.classes)))
        p = np.exp(z - z.max())
        p /= p.sum()
        hits.append(m.classes[int(p.argmax())] == c)
        sure.append(p.max())
    assert np.mean(hits) > 0.95 and abs(np.mean(hits) - np.mean(sure)) < 0.05


# --- op8 -------------------------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(texts, items):
    low = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x or "")
    windows = defaultdict(set)
    for i, x in items:
        w = WORD.findall(low(x))
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add(i)
    out = []
    for t in texts:
        w, hit, found = WORD.findall(low(t)), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if (q := windows.get(tuple(w[k : k + n]))) is not None:
                    found |= q
                    hit.update(range(k, k + n))
        ids = ",".join(sorted(str(i) for i in found if i is not None))
        out.append((len(w), len(hit), len(found - {None}), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def told(df):
    return [(r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.judged(df).collect()]


def test_decontamination(spark, sf, docs):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    texts = [r.text for r in docs.collect()]
    want = sorted(brute_hits(texts, items))
    assert sorted(told(decontaminate.mark_spans(docs, bench))) == want
    assert sorted(told(decontaminate.mark_spans(docs, bench, limit=2000))) == want


def test_decontamination_edges(spark, edges, empty):
    rng = random.Random(2)
    items = [(1, "the cat"), (2, "SAT on"), (3, None), (4, "  .,"), (5, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14"), (1, "the cat"), (None, "a b"), (6, "日本語"), (7, " ".join(rng.choice("ab") for _ in range(20)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(told(decontaminate.mark_spans(edges, bench))) == sorted(brute_hits([t for _, t, _ in EDGES], items))
    texts = [" ".join(rng.choice("aab") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(told(decontaminate.mark_spans(df, bench))) == sorted(brute_hits(texts, items))
    assert told(decontaminate.mark_spans(empty, bench)) == []
    assert all(x[1] == 0 for x in told(decontaminate.mark_spans(edges, bench.limit(0))))


def test_fm_index_finds_every_occurrence():
    rng = np.random.default_rng(4)
    text = rng.integers(0, 4, 3000)
    text[-1] = 0
    index = decontaminate.FmIndex(text, 4)
    for n in (1, 2, 5):
        for _ in range(30):
            p = rng.integers(1, 4, n)
            found, low, high = index.search(np.r_[p, 0], np.array([0, n]), np.array([n, 1]))
            want = [i for i in range(len(text) - n + 1) if (text[i : i + n] == p).all()]
            assert found.tolist() == [0] * bool(want) and sorted(index.locate(np.arange(low[0], high[0])) if want else []) == want


def test_suffix_order():
    rng = np.random.default_rng(7)
    for n, most in ((1, 1), (2, 2), (50, 2), (400, 3), (400, 200)):
        for _ in range(10):
            text = rng.integers(0, most, n)
            text[-1] = 0
            told = [(0, i) if c == 0 else (1, int(c)) for i, c in enumerate(text)]  # separators differ, by place
            want = sorted(range(n), key=lambda i: told[i:])
            assert decontaminate.suffix_order(text).tolist() == want


def test_long_texts_are_searched_in_parts(monkeypatch):
    rng = random.Random(3)
    items = [(k, " ".join(rng.choice("abc") for _ in range(rng.choice([3, 13, 15])))) for k in range(30)]
    texts = [" ".join(rng.choice("abc") for _ in range(n)) for n in (900, 0, 40, 2500)]
    raw, off = decontaminate.text_buffers(pa.array(texts, pa.large_string()))
    w = decontaminate.windows_of(items)

    def found():
        counts, row, start, length, which = decontaminate.search_shard(w, raw, off)
        return counts.tolist(), sorted(set(zip(row.tolist(), start.tolist(), length.tolist(), w.items[which].tolist(), strict=True)))

    want = found()
    assert len(want[1]) > 100
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 100)
    assert found() == want


# --- op10 ------------------------------------------------------------------------------------------------------


def brute_groups(rows, size=4, percent=85):
    split = re.compile(r"[^\x20\x09-\x0D]+")
    sets = []
    for _, t in rows:
        w = split.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            same_id = rows[i][0] == rows[j][0] and rows[i][0] is not None
            if same_id and not (a and b):
                continue
            n = len(a & b)
            if a and b and 100 * n >= percent * (len(a) + len(b) - n):
                up[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (k, _) in enumerate(rows):
        least.setdefault(root(i), []).append(k)
    smallest = {r: None if None in ks else min(ks) for r, ks in least.items()}
    return sorted(((k is None, k or 0), len(sets[i]), str(smallest[root(i)])) for i, (k, _) in enumerate(rows))


def brute_sets(texts, size=4):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append(frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    return out


def linked_rows(sets, percent=85):
    """The least row that each row is linked with, over any number of links."""
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * (n := len(a & sets[j])) >= percent * (len(a) + len(sets[j]) - n):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return root


def near_copies(rng, n=260):
    """A group of near copies that are long lists, chains, and unrelated texts with a shared passage."""
    base = [f"b{i}" for i in range(60)]
    rows = []
    for k in range(n):
        w = base.copy()
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(400)}"
        rows.append((k, " ".join(w)))
    rows += [(1000 + k, " ".join([f"u{k}x{i}" for i in range(rng.randint(1, 40))] + base[:15])) for k in range(80)]
    chain = [f"c{i}" for i in range(50)]
    for k in range(10):
        chain[rng.randrange(50)] = f"d{k}"
        rows.append((2000 + k, " ".join(chain)))
    return rows


def listed(df):
    return sorted(((r.doc_id is None, r.doc_id or 0), r.n_shingles, str(r.component_id)) for r in df.collect())


def test_jaccard_groups(spark, edges, empty, monkeypatch):
    rows = near_copies(random.Random(9))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_groups(rows)
    assert listed(jaccard_join.jaccard_groups(df)) == want
    assert listed(jaccard_join.jaccard_groups(edges)) == brute_groups([(i, t) for i, t, _ in EDGES])
    assert jaccard_join.jaccard_groups(empty).count() == 0
    # small blocks and lists, and no shingle known as frequent: other ways, the same result
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    assert listed(jaccard_join.jaccard_groups(df)) == want
    monkeypatch.setattr(jaccard_join, "LIST", 16)
    assert listed(jaccard_join.jaccard_groups(df)) == want
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    monkeypatch.setattr(jaccard_join, "frequent_shingles", lambda docs, size: none)
    assert listed(jaccard_join.jaccard_groups(df)) == want


def test_jaccard_links(spark, edges):
    """Every link between different sets, and how many rows each row links with."""
    rows = near_copies(random.Random(10), 90) + [(i, t) for i, t, _ in EDGES]
    split = re.compile(r"[^\x20\x09-\x0D]+")
    sets = []
    for _, t in rows:
        w = split.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else []))
    linked = lambda a, b: bool(a and b) and 100 * len(a & b) >= 85 * len(a | b)
    pairs, told = jaccard_join.jaccard_links(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((str(r.doc_id), r.n_shingles, r.n_links) for r in told.collect())
    assert got == sorted((str(k), len(sets[i]), sum(linked(sets[i], s) for j, s in enumerate(sets) if j != i)) for i, (k, _) in enumerate(rows))
    classes = list(set(sets) - {frozenset()})
    assert pairs.count() == sum(linked(a, b) for i, a in enumerate(classes) for b in classes[:i])


def test_divide_skip_finds_all_links():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 60, 200).astype(np.uint64)
    sets = [np.unique(np.r_[rng.permutation(base)[: rng.integers(150, 200)], rng.integers(0, 1 << 60, rng.integers(0, 20)).astype(np.uint64)]) for _ in range(60)]
    lists = jaccard_join.InvertedLists(sets)
    for i, s in enumerate(sets):
        shared = [len(np.intersect1d(s, t)) for t in sets]
        want = [j for j, t in enumerate(sets) if 100 * shared[j] >= 70 * (len(s) + len(t) - shared[j])]
        assert lists.partners(s, np.ones(60, bool), 70) == want
        some = np.arange(60) > i
        assert lists.partners(s, some, 70) == [j for j in want if j > i]


def test_merge_skip_equals_counting():
    rng = random.Random(2)
    for _ in range(200):
        lists = [sorted(rng.sample(range(30), rng.randint(1, 12))) for _ in range(rng.randint(1, 9))]
        least = rng.randint(1, 6)
        count = {x: sum(x in y for y in lists) for x in range(30)}
        assert list(jaccard_join.merge_skip(lists, least)) == [(x, n) for x, n in sorted(count.items()) if n >= least]


def test_profiles_never_rule_out_a_link():
    rng = np.random.default_rng(2)
    for _ in range(40):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 400)).astype(np.uint64) * np.uint64(2))
        keep = a[rng.random(len(a)) < 0.95]
        b = np.unique(np.r_[keep, rng.integers(0, 1 << 63, len(a) // 30).astype(np.uint64)])
        n = len(np.intersect1d(a, b))
        if len(b) and 100 * n >= 85 * (len(a) + len(b) - n):
            outlines = jaccard_join.Outlines([jaccard_join.profile(b)], np.array([len(b)]))
            assert outlines.may_link(jaccard_join.profile(a), len(a), np.ones(1, bool), 85).all()


def thue_morse(n=1024):
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_that_collide_in_polynomial_hashes_are_told_apart(spark):
    """Two words of 1024 letters that have one polynomial hash modulo 2**64, whatever its odd base."""
    one, two = thue_morse()
    coder = packing.WordTokens(packing.default_tokenizer())
    got = coder.encode(pa.array([one, two]))
    assert [x.tolist() for x in got] == [x.tolist() for x in coder.plain([one, two])] and got[0].tolist() != got[1].tolist()
    f = [multiset_hash.decoded(multiset_hash.fingerprint(t)) for t in (one, two)]
    assert (f[0][1] != f[1][1]).all()
    around = [f"w{i}" for i in range(12)]
    docs = spark.createDataFrame([(1, " ".join([one, *around])), (2, " ".join([two, *around]))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join([two, *around]))], "item_id long, text string")
    assert sorted((r.doc_id, r.n_hit) for r in decontaminate.judged(decontaminate.mark_spans(docs, bench)).collect()) == [(1, 0), (2, 13)]
    alone = spark.createDataFrame([(1, one), (2, two), (3, one)], "doc_id long, text string")
    assert listed(jaccard_join.jaccard_groups(alone)) == brute_groups([(1, one), (2, two), (3, one)])


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    up = {x: x for e in edges for x in e if x is not None}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        if a is not None:
            up[max(root(a), root(b))] = min(root(a), root(b))
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.root for r in components.components(df).collect()}
    assert got == {x: root(x) for e in edges for x in e if None not in e and e[0] != e[1]}
    assert components.components(df.limit(0)).count() == 0


# --- queries and pipeline --------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op4_warc", "op6_compaction"])
def test_query_equals_its_sql(spark, sf, name):
    from tidewell.llm import queries

    assert compare.differences(queries.QUERIES[name](spark, sf), compare.connect(sf), queries.ORACLE_SQL[name]) is None


def test_pipeline_keeps_whole_rows(spark, sf, docs):
    import corpus_pipeline

    left, seen = docs, {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, left.withColumn("score", F.lit("x")).withColumn("n_words", F.lit(2)), sf)
        assert out.columns == [*docs.columns, "score", "n_words"], name
        out = spark.createDataFrame(out.select(*docs.columns).collect(), docs.schema)
        rows = out.collect()
        assert len({r.doc_id for r in rows}) == len(rows) <= left.count() and all(seen[r.doc_id] == r for r in rows)
        left = out
    assert left.count() > 0.6 * docs.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, left, sf)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == {r.doc_id for r in left.collect()}


def test_near_copies_are_judged_by_row(spark, sf):
    import corpus_pipeline

    texts = [" ".join(f"{k}{i}" for i in range(40)) for k in "abcdef"]
    near = texts[0] + " end"
    rows = [
        (None, texts[1]), (None, texts[2]), (None, texts[2]), (None, None), (None, ""), (None, " \t"),  # no ids
        (5, texts[0]), (9, near), (9, texts[3]), (9, texts[4]), (9, texts[4]),  # one id, of which one text copies another
        (3, None), (3, None), (7, texts[5]), (8, texts[5]), (8, texts[1]),
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component string")
    out = corpus_pipeline.stage_near_copies(spark, df, sf)
    assert out.columns == df.columns
    want = [(None, texts[1]), (None, texts[2]), (None, None), (None, ""), (None, " \t"), (5, texts[0]), (9, texts[3]), (9, texts[4]), (3, None), (3, None), (7, texts[5])]
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.text)) for r in out.collect())


STAGE_EDGES = [
    (1, "the cat sat on the mat and the dog ran off to the far hill"), (2, "the cat sat on the mat and the dog ran off to the far hill"), (None, "no id here but words that are good to read"), (None, None),
    (4, ""), (5, " \n\t "), (6, "x" * 150_000), (6, "another text of the same id, with words of its own in it"), (8, "12345 !!! ###"), (9, " ".join(f"w{i}" for i in range(30_000))), (9, " ".join(f"w{i}" for i in range(30_000))),
]


def test_pipeline_stages_with_edges(spark, sf, docs, empty):
    """Rows with nulls, empty and long texts and repeats, next to clashing columns: what each stage keeps, against a plain way."""
    import corpus_pipeline

    extra = "score double, component string, n_words int, __row string"
    rows = [(i, t, "en", "s", len(t or ""), 0.5, "c", 1, "r") for i, t in STAGE_EDGES] + [(r.doc_id + 100, r.text, r.lang, r.source, r.n_chars, 0.5, "c", 1, "r") for r in docs.collect()]
    df = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
    key = lambda rows: sorted(map(repr, rows))
    told = lambda out: key((r.doc_id, r.text) for r in out)
    stages = dict(corpus_pipeline.STAGES)
    for stage in stages.values():
        assert stage(spark, empty, sf).count() == 0
    left = [(r[0], r[1]) for r in rows]

    out = stages["language_id"](spark, df, sf)
    assert out.columns == df.columns
    learn = docs.where(crc_mod(F.col("doc_id"), 3) != 1)
    model = language_id.fit(language_id.sampled_examples(learn, "lang", 600, 16), 16)
    said = {t: dict(zip(("lang", "score"), (x[0] for x in language_id.predict(model, [t])), strict=True)) for _, t in left if t and re.search(r"[^\W\d_]", t)}
    assert told(out.collect()) == key(x for x in left if x[1] in said and said[x[1]]["score"] >= corpus_pipeline.LANG_SCORE)

    out = stages["quality"](spark, df, sf)
    assert out.columns == df.columns
    some = df.where(crc_mod(F.col("doc_id"), 5) != 0)
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(crc_mod(F.col("doc_id"), 5) != 0)
    sample = quality_cnn.labelled_rows(some, labels, "quality", 3000)
    net = quality_cnn.fit([t.encode() for t, _ in sample], [y for _, y in sample])
    scores = quality_cnn.scores(net, *quality_cnn.text_buffers(pa.array([t or "" for _, t in left])))
    assert told(out.collect()) == key(x for x, p in zip(left, scores, strict=True) if p >= 0.3)

    out = stages["near_copies"](spark, df, sf)
    assert out.columns == df.columns
    sets = brute_sets([t for _, t in left])
    up = linked_rows(sets)
    groups = defaultdict(list)
    for i, s in enumerate(sets):
        groups[up(i) if s else (i,)].append(i)
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert len(got) == len(groups)
    first = lambda i: (left[i][0] is not None, left[i][0] or 0)
    # of each group one row of the least id stays, whichever of its texts
    want = [{left[i] for i in g if first(i) == min(map(first, g))} for g in groups.values()]
    for x in got:
        want.remove(next(w for w in want if x in w))

    out = stages["decontamination"](spark, df, sf)
    assert out.columns == df.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert told(out.collect()) == key(x for x, hit in zip(left, brute_hits([t for _, t in left], items), strict=True) if not hit[4])

    check_pieces(stages["packing"](spark, df, sf).collect(), [t for _, t in left])


def test_pipeline_equals_its_stages_one_by_one(spark, sf, docs):
    """run() gives the pieces of the documents that brute force keeps of each stage's input."""
    import corpus_pipeline

    left = docs
    for name, stage in corpus_pipeline.STAGES[:2]:
        left = spark.createDataFrame(stage(spark, left, sf).collect(), docs.schema)
    rows = sorted((r.doc_id, r.text) for r in left.collect())
    up = linked_rows(brute_sets([t for _, t in rows]))
    rows = [x for i, x in enumerate(rows) if up(i) == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = [x for x, hit in zip(rows, brute_hits([t for _, t in rows], items), strict=True) if not hit[4]]
    got = defaultdict(int)
    for r in corpus_pipeline.run(spark, sf).collect():
        got[r.doc_id] += r.length
    coder = packing.WordTokens(packing.default_tokenizer())
    assert got == {k: len(coder.plain([t])[0]) + 1 for k, t in rows}
