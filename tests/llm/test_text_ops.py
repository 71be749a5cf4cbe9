import hashlib
import io
import math
import os
import random
import re
import struct
import time
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evidentia.llm import _text, chat, html_text, media, mixing, packing, quality, url_filter

DOC = "doc_id bigint, text string, source string"
DATA = os.environ.get("TEST_DATA", "/root/testdata")


# --- packing -----------------------------------------------------------------------------------------------------------------------------------------------------------


def pack_checked(rows, texts, tokenizer, window=packing.WINDOW):
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], np.uint32) for i, t in texts}
    cover, windows = {i: 0 for i in ids}, {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == cover[r.doc_id] and len(piece) == r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert zlib.crc32(piece.astype("<u4").tobytes()) == r.ids_crc32
        cover[r.doc_id] += r.length
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(cover[i] == len(ids[i]) for i in ids)
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window and at & (at - 1) == 0  # full, or a power of two: no padding


def test_packing_is_lossless_and_full(spark):
    rng = random.Random(3)
    texts = [(k, " ".join(rng.choice(["the", "of", "naïve", "über", "don't", "x9", "\n\n", "漢字"]) for _ in range(rng.choice([0, 1, 5, 60, 900, 7000])))) for k in range(60)] + [(100, None), (101, "<|endoftext|> a")]
    df = spark.createDataFrame([(*t, "s") for t in texts], DOC).repartition(4).withColumn("length", F.lit("clash"))
    rows = packing.pack(df).collect()
    pack_checked(rows, texts, Tokenizer.from_file(packing.TOKENIZER))
    assert packing.pack(df.limit(0)).count() == 0


def test_token_ids_equal_those_of_tokenizers():
    """The fast way and the named library on every document of sf0.01, on all code points, and on random strings."""
    encode, own = packing.encoder(packing.TOKENIZER), Tokenizer.from_file(packing.TOKENIZER)
    points = [chr(c) for c in range(0x40000) if not 0xD800 <= c < 0xE000]
    rng = random.Random(8)
    parts = ["don't", " the", "  ", "\n", "\t ", "1234", "é", "漢字", "\U0001f642", "<|endoftext|>", "a", "Z", "_", "'s", "\u00a0", "\u2003", "\x00"]
    texts = [t or "" for t in pq.read_table(f"{DATA}/sf0.01/documents.parquet").column("text").to_pylist()]
    texts += ["".join(points[k : k + 256]) for k in range(0, len(points), 256)] + [" ".join(points[k : k + 256]) for k in range(0, len(points), 256)]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    for batch in range(0, len(texts), 500):
        for text, want in zip(texts[batch : batch + 500], own.encode_batch(texts[batch : batch + 500], add_special_tokens=False)):
            assert encode(text).tolist() == want.ids


def test_packing_cuts_few_short_documents():
    closed = []
    p = packing.Packer(2048, closed.append)
    rng = np.random.default_rng(1)
    for k in range(6000):
        p.add(k, np.zeros(rng.integers(20, 900), np.uint32))
    open_windows = int(p.count.sum())
    p.close()
    pieces = [x for w in closed for x in w]
    assert open_windows < 400 and sum(len(x[2]) for x in pieces) == sum(len(x[2]) for w in closed for x in w)
    assert len(pieces) - 6000 < 0.05 * 6000


def test_packing_follows_the_rule():
    """The level chosen minimises the sum of squares over all choices, checked against trying each."""
    rng, w = random.Random(5), 40
    p = packing.Packer(w, lambda _: None)
    for k in range(800):
        s, before = rng.randint(1, w - 1), p.count.copy()
        trials = []
        for h in range(w - s + 1):
            if h and not before[h]:
                continue
            c = before.copy()
            c[h] -= h > 0
            c[h + s] += h + s < w
            trials.append(int((c.astype(np.int64) ** 2).sum()))
        p.add(k, np.zeros(s, np.uint32))
        assert int((p.count.astype(np.int64) ** 2).sum()) == min(trials)


@pytest.mark.parametrize("low,high", [(1100, 1101), (1030, 2000), (700, 1500), (1, 4000)])
def test_packing_bounds_open_windows(low, high):
    """Documents that can't pair, too, close windows by the rule; few windows are open, and no more than the last ones are no full windows."""
    closed, rng, most = [], np.random.default_rng(2), 0
    p = packing.Packer(2048, closed.append)
    for k in range(5000):
        p.add(k, np.full(rng.integers(low, high), k, np.uint32))
        most = max(most, p.n_open)
        assert p.n_open == p.count.sum()
    by_rule = sum(len(w) > 1 for w in closed)
    p.close()
    shared = [w for w in closed if len(w) > 1]
    assert most <= packing.OPEN // 2048 and by_rule >= len(shared) - packing.OPEN // 2048
    if low == 1100:
        assert most < 100 and by_rule >= 0.9 * len(shared)
    sizes = [sum(len(ids) for _, _, ids in w) for w in closed]
    rest = [n for n in sizes if n < 2048]
    assert len(rest) == len(set(rest)) and all(n & (n - 1) == 0 for n in rest)
    found = {}
    for w in closed:
        for doc, start, ids in w:
            assert (ids == doc).all()
            found.setdefault(doc, []).append((start, len(ids)))
    for doc, pieces in found.items():
        at = 0
        for start, n in sorted(pieces):
            assert start == at
            at += n
    assert len(found) == 5000 and sum(sizes) == sum(sum(n for _, n in v) for v in found.values())


# --- media -----------------------------------------------------------------------------------------------------------------------------------------------------------------


def test_media_round_trip(spark):
    texts = ["", None, "a", "é" * 33, "x" * 70_000, "a", "\x00\x7f" * 40]
    df = spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], DOC).withColumn("feature", F.lit("clash"))
    rows = {r.doc_id: r for r in media.media_columns(df, keep_media=True).collect()}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        pad = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        r = rows[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
        assert r.media_bytes == len(r.media) and hashlib.sha256(r.media).hexdigest() == r.media_sha256 and media.payload(media.decode(bytes(r.media))) == pad
    assert [c for c in rows[2]][1:] == [c for c in rows[5]][1:] and rows[0].media_sha256 == rows[1].media_sha256
    assert media.media_columns(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_media_any_bytes_and_the_general_decoder(seed, monkeypatch):
    raw = np.random.default_rng(seed).choice([0, 255, 254, 127, 200], 64 * (seed * 7 + 1)).astype(np.uint8).tobytes()
    fast = media.decode(media.encode(raw))
    monkeypatch.setattr(media, "_fixed", lambda *a: None)
    slow = media.decode(media.encode(raw))
    assert media.payload(fast) == media.payload(slow) == raw and (fast.thumbnail == slow.thumbnail).all() and media.feature(fast) == media.feature(slow)


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> k & 1 for k in range(n - 1, -1, -1)]

    def done(self):
        bits = self.bits + [1] * (-len(self.bits) % 8)
        return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def test_media_in_parts(monkeypatch):
    raw = np.random.default_rng(9).integers(0, 256, 64 * 1000, np.uint8).tobytes()
    whole = media.encode(raw)
    monkeypatch.setattr(media, "PART", 16)
    assert media.encode(raw) == whole and media.payload(media.decode(whole)) == raw


def test_general_decoder_is_linear(monkeypatch):
    """Eight times the bytes take about eight times as long, in one segment without restarts."""
    monkeypatch.setattr(media, "_fixed", lambda *a: None)
    w, times = Writer(), []
    for _ in range(4096):  # blocks of DC 0 and end of block: one bit each
        w.put(0, 2)
    tables = media._one_symbol(0, 0) + media._one_symbol(1, 0)
    for n in (4096, 32768):
        head = b"\xff\xd8" + media._segment(0xFFDB, b"\0" + b"\1" * 64) + media._segment(0xFFC0, struct.pack(">BHHBBBB", 8, 64, n, 1, 1, 0x11, 0))
        raw = head + media._segment(0xFFC4, tables) + media._segment(0xFFDA, bytes([1, 1, 0, 0, 63, 0])) + b"\0" * (n // 4) + b"\xff\xd9"
        began = time.process_time()
        assert not media.decode(raw).coefficients[0].any()
        times.append(time.process_time() - began)
    assert times[1] < 24 * times[0] + 0.1
    with pytest.raises(ValueError):
        media.decode(raw[: len(head) + 60])


def test_media_decodes_a_foreign_file():
    """Two components at 2 x 1 sampling, runs of zeros, end-of-block codes, no restarts."""
    rng = np.random.default_rng(2)
    dc, ac = [0, 1, 2, 3, 4, 5, 6, 7], [0x00, 0x01, 0x02, 0x11, 0x32, 0xF0, 0x05]
    code = {s: (k, 4) for k, s in enumerate(dc)}, {s: (k, 4) for k, s in enumerate(ac)}
    w, blocks, before = Writer(), {0: [], 1: []}, [0, 0]
    for _ in range(4):
        for c, n in ((0, 2), (1, 1)):
            for _ in range(n):
                b = np.zeros(64, int)
                b[0] = rng.integers(-60, 60)
                b[1], b[3], b[30] = 1, rng.integers(0, 2) * 2 - 1, 0
                if rng.random() < 0.5:
                    b[20] = 3
                diff, before[c] = b[0] - before[c], b[0]
                size = int(abs(diff)).bit_length()
                w.put(*code[0][size])
                w.put(int(diff) if diff > 0 else int(diff) + (1 << size) - 1, size)
                last = 0
                for k in np.flatnonzero(b[1:]) + 1:
                    run = int(k) - last - 1
                    while run > 15:
                        w.put(*code[1][0xF0])
                        run -= 16
                    size = int(abs(b[k])).bit_length()
                    if (run << 4 | size) not in code[1]:  # pad the run with what the table has
                        b[k] = 0
                        continue
                    w.put(*code[1][run << 4 | size])
                    w.put(int(b[k]) if b[k] > 0 else int(b[k]) + (1 << size) - 1, size)
                    last = int(k)
                w.put(*code[1][0x00])
                blocks[c].append(b)
    head = b"\xff\xd8" + media._segment(0xFFDB, b"\0" + bytes([16] * 64)) + media._segment(0xFFC0, struct.pack(">BHHB", 8, 16, 32, 2) + bytes([1, 0x21, 0, 2, 0x11, 0]))
    tables = bytes([0x00, 0, 0, 0, len(dc), *[0] * 12, *dc]) + bytes([0x10, 0, 0, 0, len(ac), *[0] * 12, *ac])
    raw = head + media._segment(0xFFC4, tables) + media._segment(0xFFDA, bytes([2, 1, 0, 2, 0, 0, 63, 0])) + w.done() + b"\xff\xd9"
    image = media.decode(raw)
    assert (image.width, image.height) == (32, 16) and image.thumbnail.shape == (2, 4)
    y = image.coefficients[0].reshape(2, 2, 2, 64).transpose(0, 1, 2, 3).reshape(-1, 64)
    assert (y == np.array(blocks[0])).all() and (image.coefficients[1].reshape(-1, 64) == np.array(blocks[1])).all()
    assert (image.thumbnail.reshape(-1) == np.clip(128 + (y[:, 0] * 16 >> 3), 0, 255)).all()
    with pytest.raises(ValueError):
        media.decode(b"GIF89a")


# --- mixing -----------------------------------------------------------------------------------------------------------------------------------------------------------------


def water(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, target, live = 1.5 * sum(sizes.values()), {}, set(names)
    while live:
        level = (left - sum(target.values())) / sum(weight[s] for s in live)
        over = {s for s in live if level * weight[s] > 2 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in live}
        target |= {s: 2.0 * sizes[s] for s in over}
        live -= over
    return target


def mix_rows(seed, n=600):
    rng = random.Random(seed)
    rows = [(k, " ".join(["w"] * rng.choice([0, 1, 3, 10, 50, 400])), rng.choice(["hot", "hot", "a", "b", "é", "z9", None])) for k in range(n)]
    return [*rows, (n, None, "a"), (n + 1, "\t x \n", "only empty"), (n + 2, "", "really empty"), (None, "no id", "a"), (5, "the same id again " * 2, "b")]


def spark_hash(*values):
    """Spark's xxhash64 of bigints (8 bytes), small literals (4 bytes) and strings."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v, seed=h)
    return h - (1 << 64) if h >> 63 else h


def long(v):
    return struct.pack("<q", v)


def brute_mix(rows):
    """The tree step by step: (doc_id, text, source) to the words taken by each set of equal rows."""
    small, sizes, alike = struct.pack("<i", mixing.SEED), {}, {}
    for i, t, s in rows:
        n = len((t or "").split())
        sizes[s] = sizes.get(s, 0) + n
        alike[s, i, t] = alike.get((s, i, t), 0) + 1
    want, by, out = water(sizes), {}, {}
    for (s, i, t), c in alike.items():
        n = len((t or "").split())
        expected = want[s] / sizes[s] if sizes[s] else 0.0
        whole = math.floor(expected + mixing.TINY) if n else 0
        p = expected - whole if n and expected - whole > mixing.TINY else 0.0
        sure = math.floor(c * p + mixing.TINY)
        out[s, i, t] = [n, c * whole + sure]
        if c * p - sure > mixing.TINY:
            h = 42 if t is None else spark_hash(t)
            draw = spark_hash(long(-1 if i is None else i), long(n), long(h), small)
            by.setdefault(s, []).append([-n, draw, -(1 << 70) if i is None else i, n, c * p - sure, (s, i, t)])
    for s, items in by.items():
        groups, level = {}, -(-len(items) // mixing.FAN)
        for x in items:
            groups.setdefault(x[1] % level, []).append(x)
        while True:
            rest = {}
            for g, docs in groups.items():
                a = None
                for d in sorted(docs):
                    if a is None:
                        a = d
                        continue
                    to_a, to_d = min((1 - a[4]) * a[3], d[4] * d[3]), min(a[4] * a[3], (1 - d[4]) * d[3])
                    u = (spark_hash(long(a[1]), long(d[1]), small) % (1 << 40) + 0.5) / float(1 << 40)
                    moved = to_a if u * (to_a + to_d) < to_d else -to_d
                    open_ = []
                    for x, p in ((a, a[4] + moved / a[3]), (d, d[4] - moved / d[3])):
                        x[4] = 0.0 if p < mixing.TINY else 1.0 if p > 1 - mixing.TINY else p
                        if 0 < x[4] < 1:
                            open_.append(x)
                        else:
                            out[x[5]][1] += int(x[4])
                    a = open_[0] if open_ else None
                if a is not None:
                    rest.setdefault(g // mixing.FAN, []).append(a)
            if level == 1:
                for (x,) in rest.values():
                    out[x[5]][1] += round(x[4])
                break
            level, groups = -(-level // mixing.FAN), rest
    return {k: n * c for k, (n, c) in out.items()}


@pytest.mark.parametrize("seed,fan", [(1, 64), (2, 4)])
def test_mixing(spark, seed, fan, monkeypatch):
    monkeypatch.setattr(mixing, "FAN", fan)
    rows = [*mix_rows(seed), *[(None, "a hot row without id", "hot")] * 150, *[(7, "an id again and again", "a")] * 9, (8, "one more", "a"), (8, "one more", "b")]
    df = spark.createDataFrame(rows, DOC).repartition(5).withColumns({"row": F.lit("c"), "size": F.lit("d")})
    got = mixing.taken(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want, brute = water(sizes), brute_mix(rows)
    by = {}
    for (s, i, t), n in brute.items():
        k = i, len((t or "").split()), round(want[s], 6)
        by[k] = by.get(k, 0) + n
    found = {}
    for r in got:
        assert r.source_size in sizes.values() and r.taken in (0, r.size, 2 * r.size)
        k = r.doc_id, r.size, round(r.target, 6)
        found[k] = found.get(k, 0) + r.taken
    assert found == by
    for s in sizes:
        assert abs(sum(n for (x, _, _), n in brute.items() if x == s) - want[s]) <= 400
    again = mixing.taken(df.repartition(2)).collect()
    key = lambda rs: sorted((str(r.doc_id), r.size, r.taken) for r in rs)
    assert key(got) == key(again)
    assert mixing.taken(df.limit(0)).count() == 0
    with pytest.raises(TypeError):
        mixing.taken(df.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_equal_rows_make_no_hot_group(spark):
    """20,000 rows without id in one text and size are one item of the tree."""
    df = spark.range(20_000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit("the same text").alias("text"), F.lit("hot").alias("source"))
    df = df.union(spark.range(400).select("id", F.concat(F.lit("text "), F.col("id").cast("string")), F.lit("b")))
    got = mixing.taken(df).filter("doc_id is null").groupBy("copies").count().collect()
    total = sum(r.copies * r["count"] for r in got)
    of = mixing.taken(df).filter("doc_id is null").select("target").first()
    assert sum(r["count"] for r in got) == 20_000 and abs(3 * total - of.target) <= 3
    out = mixing.copies(df)
    assert out.filter("doc_id is null").count() == total


def test_mixing_keeps_expectations(spark):
    """Over many seeds a document's copies average its expected copies."""
    df = spark.createDataFrame([(k, "w " * (1 + k % 7), "ab"[k % 2]) for k in range(60)], DOC)
    total, old = {}, mixing.SEED
    try:
        for seed in range(12):
            mixing.SEED = 1000 + seed
            for r in mixing.taken(df).collect():
                total.setdefault(r.target / r.source_size, []).append(r.copies)
    finally:
        mixing.SEED = old
    assert all(abs(np.mean(v) - f) < 0.08 for f, v in total.items())


def test_copies_keep_columns_and_counts(spark):
    df = spark.createDataFrame(mix_rows(3, 100), DOC).withColumn("n_times", F.lit("clash"))
    out = mixing.copies(df)
    assert out.columns == df.columns
    unique = df.filter("doc_id is not null").dropDuplicates(["doc_id"])
    want = {r.doc_id: r.copies for r in mixing.taken(unique).collect() if r.copies}
    assert {r.doc_id: r["count"] for r in mixing.copies(unique).groupBy("doc_id").count().collect()} == want


# --- quality -----------------------------------------------------------------------------------------------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    base = f"{DATA}/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    rows = quality.score(docs, quality.train(docs, labels)).join(labels, "doc_id").filter("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert np.mean([r.predicted == r.label for r in rows]) > 0.93
    good, bad = ([r.score for r in rows if r.label == k] for k in (1, 0))
    assert np.mean([[g > b for b in bad] for g in good]) > 0.97


def test_quality_edges(spark):
    df = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (3, "x " * 50_000, "s"), (None, "a", "s"), (3, "x " * 50_000, "s")], DOC).withColumn("score", F.lit("clash"))
    none = spark.createDataFrame([(1, None), (7, 1), (2, 5)], "doc_id bigint, label int")
    rows = quality.score(df, quality.train(df, none)).collect()
    assert [r.score for r in rows] == [0.5] * 5 and len({r.score for r in rows if r.doc_id == 3}) == 1
    kept = quality.accepted(df, quality.train(df, none))
    assert kept.columns == df.columns and kept.count() == 5 and quality.accepted(df.limit(0), quality.Model(np.zeros(1 << quality.BITS, np.float32), 0.0)).count() == 0


def plain_features(text):
    """Bucket counts of a text, feature by feature."""
    m64, out = (1 << 64) - 1, {}

    def word_hash(w):
        z = sum((b + 1) * pow(_text.BASE, k, 1 << 64) for k, b in enumerate(w)) & m64
        z ^= len(w)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ z >> shift) * factor & m64
        return z ^ z >> 31

    def add(k):
        out[k] = out.get(k, 0) + 1

    words = re.findall(rb"[^\x20\x09-\x0d]+", text.encode())
    for w in words:
        add(word_hash(w) >> (64 - quality.BITS))
    for v, w in zip(words, words[1:]):
        if v == w:
            add(quality.REPEAT)
    numbers = []
    for c in text:  # the bytes' own bits, six at a time behind the first
        head, *tail = c.encode()
        for b in tail:
            head = (head << 6 | b & 0x3F) & 0xFFFFFFFF
        numbers.append(head)
    for n in quality.GRAMS:
        for k in range(len(numbers) - n + 1):
            h = n
            for c in numbers[k : k + n]:
                h = (h * 0x01000193 + c) & 0xFFFFFFFF
            h = h * int(quality.SPREAD[n]) & 0xFFFFFFFF
            h ^= h >> 15
            add((h * int(quality.SPREAD[n + 1]) & 0xFFFFFFFF) >> int(quality.SHIFT))
    return out


def test_quality_features_equal_plain_ones(monkeypatch):
    rng = random.Random(3)
    texts = ["", "a", "ab", "é", "naïve café café", "漢字\u2003漢字 x x x", "\U0001f642\U0001f642 \n\t!", " ".join(rng.choice(["ab", "über", "漢", "x"]) for _ in range(400))]
    for block in (_text.BLOCK, 64):
        for module in (_text, quality):
            monkeypatch.setattr(module, "BLOCK", block)
        _text._powers.clear()
        for t in texts:
            want = plain_features(t)
            at, share = quality.counts(t.encode())
            assert dict(zip(at.tolist(), share.tolist())) == pytest.approx({k: n / sum(want.values()) for k, n in want.items()})
    _text._powers.clear()


def test_quality_fit_equals_plain_descent(monkeypatch):
    monkeypatch.setattr(quality, "BITS", 6)
    rng, dim, epochs, step = np.random.default_rng(4), 3, 5, 1.0
    rows = [(int(rng.integers(2)), at := np.sort(rng.choice(64, rng.integers(1, 9), False)).astype(np.uint16), rng.dirichlet(np.ones(len(at))).astype(np.float32)) for _ in range(30)]
    model = quality.fit(rows, dim=dim, epochs=epochs, step=step, seed=9)
    draw = np.random.default_rng(9)
    vectors = draw.uniform(-1 / dim, 1 / dim, (64, dim)).astype(np.float32).tolist()
    layer, bias, done = draw.uniform(-1, 1, (dim, 2)).astype(np.float32).tolist(), [0.0, 0.0], 0
    for _ in range(epochs):
        for k in draw.permutation(len(rows)):
            label, at, share = rows[k]
            rate, done = step * (1 - done / (epochs * len(rows))), done + 1
            hidden = [sum(float(s) * vectors[a][j] for a, s in zip(at, share)) for j in range(dim)]
            e = [math.exp(sum(hidden[j] * layer[j][c] for j in range(dim)) + bias[c]) for c in (0, 1)]
            p = [e[c] / sum(e) - (c == label) for c in (0, 1)]
            back = [sum(layer[j][c] * p[c] for c in (0, 1)) for j in range(dim)]
            for c in (0, 1):
                bias[c] -= rate * 0.01 * p[c]
                for j in range(dim):
                    layer[j][c] -= rate * 0.1 * hidden[j] * p[c]
            for a, s in zip(at, share):
                for j in range(dim):
                    vectors[a][j] -= rate * min(float(s) * len(share), 1) * back[j]
    part = [sum(v[j] * (layer[j][1] - layer[j][0]) for j in range(dim)) for v in vectors]
    assert model.part.tolist() == pytest.approx(part, abs=1e-4) and model.bias == pytest.approx(bias[1] - bias[0], abs=1e-5)


def test_quality_of_an_id_with_several_texts(spark):
    docs = spark.createDataFrame([(k % 40, f"text {k} of many words", "s") for k in range(400)], DOC)
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id bigint, label int")
    a, b = (quality.train(docs.repartition(n), labels) for n in (1, 7))
    assert (a.part == b.part).all() and a.bias == b.bias


def test_quality_scores_match_the_model():
    """The sums over buckets give the softmax over averaged vectors."""
    rng = np.random.default_rng(3)
    model = quality.Model(rng.normal(size=1 << quality.BITS).astype(np.float32), 0.3)
    texts = ["", "a", "ab cd cd", "naïve café 123", "word " * 300]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(texts)], names=["doc_id", "text"])
    (out,) = quality._scored(model, "text")([batch])
    for t, s in zip(texts, out.column("score").to_pylist()):
        at, share = quality.counts(t.encode())
        assert s == pytest.approx(1 / (1 + np.exp(-(model.part[at].astype(float) @ share + 0.3))), abs=1e-6)


# --- html -----------------------------------------------------------------------------------------------------------------------------------------------------------------------

PAGES = {
    "<nav>Home News</nav><article><h1>T</h1><p>One two three four.</p><p>Be.</p></article><footer>&copy; x</footer>": "T One two three four. Be.",
    "<body><div class='page has-sidebar'><div class=content><h1>Title</h1><p>Some good text, long enough to win.</p><div class='ad'>Buy now</div><p>Tail.</p></div><aside>Other things</aside></div></body>": "Title Some good text, long enough to win. Tail.",
    "<article><p>A&amp;B&nbsp;c &#233; &lt;x&gt;</p><script>var a = '</p>';</script><p>in<b>li</b>ne</p><!-- no --></article>": "A&B c é <x> inline",
    "<main><p>Words of the text are here</p><form><label>Name</label><input></form><p>and here</p><section class='comments'><p>First! I was here before you all</p></section></main>": "Words of the text are here and here",
    "plain text only": "plain text only", "": "", None: "", "<nav>a b c d</nav>": "", "<article><p>cut off &am</article": "cut off &am",
    "<p>a < b and c > d": "a < b and c > d", "<article>x<style>p{}</style> y": "x y",
}


def test_html(spark):
    rows = [(k, "u", h) for k, h in enumerate(PAGES)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("n_chars", F.lit("c"))
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.main_text(df).collect()}
    assert [got[k][0] for k in range(len(PAGES))] == list(PAGES.values()) and all(n == len(t) for t, n in got.values())
    assert html_text.main_text(df.limit(0)).count() == 0


CASES = {
    "<article><h2 id='related-work'>Related work</h2><p>Text of it is here.</p><h2 id='search'>Search</h2><p>More of the text.</p></article>": "Related work Text of it is here. Search More of the text.",
    "<article><p>Some words to read.</p><pre><span class='hljs-comment'># set x</span>\n<div class='comment'># y</div> x = 1</pre></article>": "Some words to read. # set x # y x = 1",
    "<article><p>By <a href=/o'neill>O'Neill</a> and it's <b title='a>b'>bold</b> here</p></article>": "By O'Neill and it's bold here",
    "<body><header><h1>Site</h1></header><article><header class='entry-header'><h1>Title</h1><div class='byline'>By me</div></header><p>Some words of the article.</p></article></body>": "Title Some words of the article.",
    "<main><section id='related-work'><h2>Related work</h2><p>Long text about it is here now.</p></section></main>": "Related work Long text about it is here now.",
    "<article><p>in<b>a<div>x</b> y</div> z words<img src=a>and words</p></article>": "ina x y z wordsand words",
    "<article><p>one two<script>x()</script>three</p><div role=search>find</div><p>four</p></article>": "one twothree four",
    "<body><nav><a href=/>Home</a><article><h1>T</h1><p>The nav was left open before me.</p></article></body>": "T The nav was left open before me.",
    "<body><div class=page-comments><p>I say so</p></div><p>Only this line is the text of the page.</p></body>": "Only this line is the text of the page.",
}


def test_html_keeps_the_article():
    weights = html_text.Weights(html_text.LABELLED)
    for page, text in CASES.items():
        assert html_text.extract(page, weights) == text


def labelled_text(page):
    p = html_text.Page(page)
    inside = [k for k, main in enumerate(p.main) if main]
    return p.text(inside[0], inside[-1] + 1)


def test_html_pages_that_lost_text():
    """A head left open, a form round the page, sections named by words of layout, an article of linked words, and comments under a name written together."""
    weights, words = html_text.Weights(html_text.LABELLED), " ".join(f"w{k}" for k in range(60))
    get = lambda html: html_text.extract(html, weights)
    assert get(f"<html><head><title>T</title><body><p>{words}") == words == get(f"<head><meta a=b><title>T</title>{words}")
    assert get(f"<html><head><title>T</title><script>x</script></head><body><p>{words}</p>") == words
    assert get(f"<body><form id='aspnetForm'><div class='content'><p>{words}</p></div></form>") == words
    assert get(f"<body><form><input><p>Search here</p></form><div><p>{words}</p></div>") == words
    for name in ("id='social'", "id='search'", "class='latest'", "class='related'"):
        part = f"<section {name}><h2>Social effects</h2><p>In the latest version it is said.</p></section>"
        assert get(f"<article><h1>A</h1><p>{words}</p>{part}<p>End.</p></article>") == f"A {words} Social effects In the latest version it is said. End."
        links = f"<div {name}><ul><li><a href=1>Another story</a></li><li><a href=2>And one more</a></li></ul></div>"
        assert get(f"<article><h1>A</h1><p>{words}</p>{links}<p>End.</p></article>") == f"A {words} End."
    linked = "".join(f"<p><a href={k}>w{k}</a></p>" for k in range(20))
    assert get(f"<body><article>{linked}</article>") == " ".join(f"w{k}" for k in range(20))
    assert get(f"<article><p>{words}</p></article><ol class='commentlist'><li><p>I like {words}</p></li></ol>") == words
    assert html_text.marks("commentlist") and html_text.marks("comment-form") and not html_text.marks("commentary") and not html_text.marks("commenting")


def test_html_weights_are_learned_and_decide():
    """Each labelled page comes out right with the weights of the others but one page; other weights change pages of both kinds."""
    pages, right = html_text.LABELLED, 0
    for k, page in enumerate(pages):
        assert html_text.extract(page, html_text.Weights(pages)) == labelled_text(page)
        right += html_text.extract(page, html_text.Weights(pages[:k] + pages[k + 1 :])) == labelled_text(page)
    assert right >= len(pages) - 1
    learned = html_text.Weights(pages)
    assert all(html_text.Weights(pages[:3]).tags[n] != learned.tags[n] for n in ("li", "div", "a")) and learned.tag("li") < learned.tag("p") < 0 < learned.word
    table = pq.read_table(f"{DATA}/sf0.001/pages.parquet").column("html").to_pylist()
    for other in (html_text.Weights(word=1.0, tags={"": -1000.0}), html_text.Weights(word=0.01, tags={"": -1.0})):
        assert any(html_text.extract(page, other) != labelled_text(page) for page in pages)
        assert any(html_text.extract(page, other) != html_text.extract(page, learned) for page in table)


def test_html_is_linear():
    weights = html_text.Weights(html_text.LABELLED)
    makers = [lambda n: "<div>" * n + "</span>" * n + "word", lambda n: "<div class=menu>" * n + "<h1>x</h1>" * n, lambda n: '<p a="x' * n, lambda n: "<article>" + "<b>" * n + "</i>" * n + "<header>" + "<h2>a" * n, lambda n: "<article><script>" * n]
    for make in makers:
        times = []
        for n in (2000, 32_000):
            began = time.process_time()
            html_text.extract(make(n), weights)
            times.append(time.process_time() - began)
        assert times[1] < 64 * times[0] + 0.3


def test_best_run_equals_all_runs():
    rng = random.Random(4)
    for _ in range(200):
        s = [rng.choice([-3, -1, 0.5, 2]) for _ in range(rng.randint(0, 12))]
        a, b = html_text.best_run(s)
        assert sum(s[a:b]) == pytest.approx(max([0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i, len(s) + 1))]))


def test_html_on_the_pages_table():
    from html import unescape

    weights = html_text.Weights(html_text.LABELLED)
    for h in pq.read_table(f"{DATA}/sf0.01/pages.parquet").column("html").to_pylist():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", h, re.S)[1]
        assert html_text.extract(h, weights) == " ".join(unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inner))).split())


# --- urls -----------------------------------------------------------------------------------------------------------------------------------------------------------------------

URLS = {
    "https://a.example.com/en/1": ("a.example.com", "/en/1", "com/en/", "block"), "http://EXAMPLE.com/en/77?x#y": ("example.com", "/en/77", "example.com/en/7", "allow"),
    "http://x.net/de/8": ("x.net", "/de/8", "net/de/", "allow"), "http://b.example.net/de/81": ("b.example.net", "/de/81", "example.net/de/8", "block"),
    "http://a.org/es/": ("a.org", "/es/", "org/es/", "block"), "http://spam-farm.example.org/de/": ("spam-farm.example.org", "/de/", None, "block"),
    "http://not-spam-farm.example.org": ("not-spam-farm.example.org", "", None, "allow"), "no scheme/en/": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"),
    "a://b://c/d": ("b:", "//c/d", None, "allow"), "x://com/en/": ("com", "/en/", "com/en/", "block"), "x://.com/en/": (".com", "/en/", "com/en/", "block"), "x://example.com?/en/7": ("example.com", "", None, "allow"),
}


def test_urls(spark):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id bigint, url string").withColumn("rule", F.lit("c"))
    got = {r.page_id: tuple(r)[1:] for r in url_filter.judged(df).collect()}
    assert [got[k] for k in range(len(URLS))] == list(URLS.values()) and url_filter.judged(df.limit(0)).count() == 0


def test_index_with_collisions(tmp_path):
    digest = lambda b: len(b) % 2 + (1 << 63) * (len(b) > 2)
    entries = sorted((url_filter.signed(digest(k.encode())), k, n) for k, n in {"a": 1, "bb": 2, "ccc": 3, "é": 4, "ddd": 5}.items())
    for most in (1, 2, 100):
        shards = list(url_filter.shard_rows(iter(entries), most))
        paths = [str(tmp_path / f"{most}-{k}") for k in range(len(shards))]
        for path, shard in zip(paths, shards):
            url_filter.Shard.write(path, shard)
        assert len(shards) == -(-5 // most)
        assert url_filter.Index(paths, digest).find([b"ccc", b"bb", b"zzz", b"a", "é".encode(), b"ddd"]).tolist() == [3, 2, -1, 1, 4, 5]
    assert url_filter.Index([]).find([b"a"]).tolist() == [-1] and list(url_filter.shard_rows(iter([]))) == []


def test_index_from_a_table(spark):
    """Tables of 30,000 hosts and 2,000 rules, in several shards, against brute force."""
    hosts = spark.range(30_000).select(F.concat(F.lit("Bad"), F.col("id").cast("string"), F.lit(".Example.com")).alias("host"))
    rules = [("block" if k % 2 else "allow", f"h{k % 500}.net", f"/p{k // 500}") for k in range(2000)] + [("allow", "net", "/p1/x"), (None, "org", "/"), ("allow", None, "/"), ("block", "h7.net", "/p0"), ("allow", "h7.net", "/p0")]
    urls = [f"http://{h}.h{k % 600}.NET/p{k % 5}/{x}" for k, (h, x) in enumerate([("a", "x"), ("b", "y")] * 700)] + [f"x://w.bad{k * 17}.example.com/" for k in range(2000)] + [None, "x://a.org/b"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").repartition(3)
    given = spark.createDataFrame(rules, "verdict string, host string, path string").repartition(4)
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judged(pages, given, hosts.union(hosts)).collect()}
    for k, url in enumerate(urls):
        host, path = url_filter.parts(url)
        fit = [(-len(h + p), v != "allow", h + p) for v, h, p in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        number = host.split(".")[1][3:] if host.startswith("w.bad") else ""
        want = (min(fit)[2], "block" if min(fit)[1] else "allow") if fit else (None, "block" if number and int(number) < 30_000 else "allow")
        assert got[k] == want, url


def test_state_classes_mark_nothing():
    weights = html_text.Weights(html_text.LABELLED)
    body = "<h2>Bread</h2><p>Flour, water, salt and time are all that bread needs.</p><p>Good bread is slow bread, as my teacher used to say.</p>"
    text = "Bread Flour, water, salt and time are all that bread needs. Good bread is slow bread, as my teacher used to say."
    menu = "<div class='menu'><a href='/'>Home</a> <a href='/n'>News</a></div>"
    for cls in ("layout no-sidebar", "has-header", "ad-free", "menu-open", "page with_footer", "content banner"):
        assert html_text.extract(f"<body>{menu}<div class='{cls}'>{body}</div></body>", weights) == text, cls
    for head in ("", "<header><h1>The Daily</h1></header>"):
        assert html_text.extract(f"<body>{head}<article class='post notice'>{body}</article>{menu}</body>", weights) == text
    # Named as such, these stay marked.
    for cls in ("main-nav", "site-footer", "ad", "menu menu-open", "no-sidebar sidebar"):
        assert html_text.extract(f"<body><article>{body}</article><div class='{cls}'><p>Buy two and pay for one, today only</p></div></body>", weights) == text, cls
    assert html_text.extract(f"<body><p>One line of text.</p><section class='comments'>{body}</section></body>", weights) == "One line of text."


# --- chat -----------------------------------------------------------------------------------------------------------------------------------------------------------------------


def brute_pair(chosen, rejected):
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1

    def render(turns):
        out, spans = io.StringIO(), []
        for role, text in turns:
            out.write(f"<|{role}|>\n")
            start = len(out.getvalue())
            out.write(text + "<|end|>")
            if role == "assistant":
                spans.append(f"{start}:{len(out.getvalue())}")
            out.write("\n")
        return out.getvalue(), ",".join(spans)

    (p, _), (c, cs), (r, rs) = render(chosen[:n]), render(chosen[n:]), render(rejected[n:])
    return n, p, c, r, cs, rs


def test_preferences(spark):
    rng = random.Random(6)
    turn = lambda: (rng.choice(["user", "assistant", "system"]), rng.choice(["", "a", "é", "b\nc"]))
    pairs = [(k, [turn() for _ in range(rng.randint(0, 4))], [turn() for _ in range(rng.randint(0, 4))]) for k in range(80)]
    kind = "array<struct<role:string,text:string>>"
    df = spark.createDataFrame(pairs, f"pair bigint, chosen {kind}, rejected {kind}")
    got = {r.pair: tuple(r)[1:] for r in chat.preferences(df).select("pair", "n_common", "prompt", "chosen", "rejected", "chosen_spans", "rejected_spans").collect()}
    assert got == {k: brute_pair(c, r) for k, c, r in pairs}


def test_conversation_edges(spark):
    rows = [(0, 1, "assistant", "yes"), (0, 0, "user", "q"), (0, None, "system", None), (1, 0, "user", "q"), (1, 1, "assistant", "no"), (1, 1, "assistant", "no"), (2, 0, None, "x"), (None, 0, "user", "n")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("last", F.lit("c"))
    rows = chat.preferences(chat.pairs(df.union(df.filter("conv_id is null")))).collect()
    got = {r.conv_id: r for r in rows}
    assert [(r.prompt, r.chosen, r.rejected) for r in rows if r.conv_id is None] == [("<|user|>\nn<|end|>\n", "", "")] * 2
    assert got[0].prompt == "<|system|>\n<|end|>\n<|user|>\nq<|end|>\n" and (got[0].chosen, got[0].rejected) == ("<|assistant|>\nyes<|end|>\n", "<|assistant|>\nno<|end|>\n")
    assert got[1].n_common == 2 and got[2].n_common == 1 and got[2].chosen == got[2].rejected == "" and len(got) == 4
    assert chat.pairs(df.limit(0)).count() == 0


def test_one_shuffle_makes_the_pairs(spark, sf_dir):
    plan = chat.op3_chat_format(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_whole_conversation_is_chosen(spark):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "yes"), (0, 2, "user", "why"), (0, 3, "system", "end"), (1, 0, "user", "q"), (1, 1, "assistant", "no"), (2, 0, "user", "x"), (2, 1, "user", "y")]
    convs = chat.conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    pairs = {r.conv_id: r for r in chat.mismatched_pairs(convs).collect()}
    assert {i: [tuple(t) for t in r.chosen] for i, r in pairs.items()} == {i: [r[2:] for r in rows if r[0] == i] for i in (0, 1, 2)}
    cut = {r.conv_id: r for r in chat.mismatched_pairs(convs, whole=False).collect()}
    assert [tuple(t) for t in cut[0].chosen] == [("user", "q"), ("assistant", "yes")] and len(cut[2].chosen) == 2
    got = {r.conv_id: r for r in chat.preferences(chat.mismatched_pairs(convs)).collect()}
    assert got[0].chosen == "<|assistant|>\nyes<|end|>\n<|user|>\nwhy<|end|>\n<|system|>\nend<|end|>\n" and got[0].chosen_spans == "14:24"
    assert got[0].rejected == "<|assistant|>\nno<|end|>\n" and got[2].prompt == "<|user|>\nx<|end|>\n<|user|>\ny<|end|>\n"
