"""SimHash near-duplicates, the audit of filters and cross-tokenizer alignment against plain versions."""

import hashlib
import random
import re
from collections import Counter
from itertools import permutations
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evidentia.llm import align, filter_audit, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id bigint, text string"


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, DOC).repartition(3)
    return df.withColumns({c: F.lit(1) for c in ("print", "bucket", "component", "key", "pairs", "Size")}) if extra else df


# SimHash


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def brute_print(text):
    words = WORD.findall(lowered(text))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(prints, bits=3):
    """Component number of each distinct print."""
    names, parent = sorted(set(prints)), {}
    values = np.array(names, np.uint64)
    parent = dict(zip(names, names))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for p in names:
        for q in values[np.bitwise_count(values ^ np.uint64(p)) <= bits].tolist():
            parent[root(q)] = root(p)
    return {p: root(p) for p in names}


def brute_simhash(rows):
    prints = [brute_print(t) for _, t in rows]
    comp = brute_components(prints)
    least = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[comp[p]] = min(i, least.get(comp[p], i))
    return sorted(((i, f"{p:016x}", least.get(comp[p])) for (i, _), p in zip(rows, prints)), key=str)


def near_rows():
    rng = random.Random(3)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one TWO"), (6, "ÉTÉ Één x y"), (7, "a b c"), (7, "a b c"), (None, "a  b\nC"), (None, "nobody else has this text at all")]
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    for k in range(150):
        changed = list(base)
        for _ in range(k % 4):
            changed[rng.randrange(400)] = f"n{rng.randrange(50)}"
        rows.append((100 + k, " ".join(changed)))
    rows += [(1000 + k, " ".join(f"v{rng.randrange(9000)}" for _ in range(rng.randrange(1, 60)))) for k in range(200)]
    return rows + [(5000, "Long Text " * 40_000), (5001, "long text\n" * 40_000), (5002, "x" * 600_000 + " y z w")]


def test_simhash_equals_brute_force(spark):
    got = sorted((tuple(r) for r in simhash.near_duplicates(frame(spark, near_rows())).collect()), key=str)
    want = brute_simhash(near_rows())
    assert got == want
    assert len({r[2] for r in want}) < len(want) - 100


@pytest.mark.parametrize("side", [4096, 40, 2])
def test_dense_balls_and_chains(spark, side):
    """Prints in a dense ball, sparse chains of steps of three bits, and pairs at four bits, which don't link."""
    rng = random.Random(7)
    centre = rng.getrandbits(64)
    prints = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 4))) for _ in range(250)}
    for _ in range(4):
        p = rng.getrandbits(64)
        for _ in range(30):
            prints.add(p)
            p ^= sum(1 << b for b in rng.sample(range(64), 3))
    for _ in range(40):
        p = rng.getrandbits(64)
        prints |= {p, p ^ sum(1 << b for b in rng.sample(range(64), 4))}
    # Many that share most of their bits, three or four apart: large buckets of several components.
    prints |= {centre ^ (0xFFFF << 40) ^ sum(1 << b for b in rng.sample(range(28), 5)) for _ in range(120)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = simhash.linked_components(spark.createDataFrame([(p,) for p in signed], "print bigint"), side=side)
    got = {r["node"] % (1 << 64): r["component"] for r in found.collect()}
    want = brute_components(prints)
    sizes = Counter(want.values())
    assert set(got) == {p for p in prints if sizes[want[p]] > 1}
    pairs = {(got[p], want[p]) for p in got}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_close_prints_share_a_key():
    rng = random.Random(1)
    for bits, n in ((3, 6), (3, 4), (2, 5), (0, 3)):
        masks = [m % (1 << 64) for m in simhash.block_masks(bits, n)]
        for _ in range(300):
            p, d = rng.getrandbits(64), sum(1 << b for b in rng.sample(range(64), bits))
            assert any(p & m == (p ^ d) & m for m in masks)
    with pytest.raises(ValueError):
        simhash.block_masks(3, 3)


def test_simhash_of_empty_table(spark):
    assert simhash.near_duplicates(frame(spark, [])).collect() == []
    assert sorted(map(tuple, simhash.near_duplicates(frame(spark, [(3, None), (2, "")])).collect())) == [(2, "0" * 16, 2), (3, "0" * 16, 2)]


# Filters


def brute_failed(rows, k):
    i, text = rows[k][0], rows[k][1] or ""
    words = re.findall(WORD, text)
    same = [j for j, t, _ in rows if (t or "") == text and j is not None]
    return {
        c
        for c, failed in {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": i is not None and min(same) < i,
        }.items()
        if failed
    }


def brute_audit(rows, good, toxic):
    out, fails = [], [brute_failed(rows, k) for k in range(len(rows))]
    for part in {s or "" for _, _, s in rows}:
        own = [(rows[k][0], fails[k]) for k in range(len(rows)) if (rows[k][2] or "") == part]
        table, total = {}, Counter()
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, c in enumerate(order, 1):
                gone = [x for x in left if c in x[1]]
                left = [x for x in left if c not in x[1]]
                total[c] += len(gone)
                redundant = sum(c in f for _, f in own) - len(gone)
                table[order, step] = (len(left), len(gone), redundant, sum(f == {c} for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone))
        out += [(part, order, step, *v, total[order[step - 1]]) for (order, step), v in table.items()]
    return sorted(out)


def audit_rows():
    rng = random.Random(5)
    rows = []
    for k in range(160):
        n = rng.choice([0, 3, 49, 50, 51, 120])
        words = [rng.choice(["Upper", "low", "é", "x%y", "tab"]) + str(rng.randrange(rng.choice([5, 500]))) for _ in range(n)]
        rows.append((k, rng.choice([" ", "\n", "\x0b", "  "]).join(words), rng.choice(["a", "b", "b", None, ""])))
    rows += [(200 + k, rows[k % 7][1], "b") for k in range(60)]
    rows += [(None, rows[0][1], "a"), (None, "nobody", None), (3, rows[3][1], "a"), (400, None, "only"), (401, "a b " * 200_000, "long"), (401, "a b " * 200_000, "long")]
    return rows


def labels_of(rows):
    """(doc_id, quality, toxic), with repeats, nulls and ids of no document."""
    return [(i, int(i % 3 == 0), int(i % 5 == 0)) for i, _, _ in rows if i is not None and i % 2] + [(3, 0, 0), (5, None, 1), (99_999, 1, 1), (None, 1, 1)]


def audited(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3).withColumns({c: F.lit(1) for c in ("mask", "n", "part", "first", "digest")})
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    return filter_audit.audit(filter_audit.marked(filter_audit.failures(docs), known, good=F.col("quality") == 1, toxic=F.col("toxic") == 1), marks=("good", "toxic"))


def test_audit_equals_brute_force_and_sql(spark):
    rows = audit_rows()
    labels = labels_of(rows)
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    found = audited(spark, rows, labels)
    got = sorted(map(tuple, found.collect()))
    assert got == brute_audit(rows, good, toxic)
    assert len(got) == 600 * len({s or "" for _, _, s in rows})
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR, source VARCHAR); CREATE TABLE labels(doc_id BIGINT, quality INT, toxic INT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    con.executemany("INSERT INTO labels VALUES (?, ?, ?)", labels)
    result = con.execute(filter_audit.ORACLE)
    assert [c[0] for c in result.description] == found.columns
    assert sorted(result.fetchall()) == got


def test_audit_of_empty_table(spark):
    assert audited(spark, [], [(1, 1, 1)]).collect() == []


def test_shapley_is_the_mean_over_orders():
    counts = np.random.default_rng(2).integers(0, 10**12, 8)
    coefficients = filter_audit.polynomial(counts)
    removed = filter_audit.corners(coefficients)
    assert removed.tolist() == [int(sum(n for m, n in enumerate(counts) if m & s)) for s in range(8)]
    total = Counter()
    for order in permutations(range(3)):
        before = 0
        for i in order:
            total[i] += int(removed[before | 1 << i] - removed[before])
            before |= 1 << i
    assert filter_audit.shapley(coefficients, 3) == [total[i] for i in range(3)]


# Alignment


def brute_sides():
    own = Tokenizer.from_file(align.A)
    own.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=align.B)
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte, n = {chr(b): b for b in plain}, 256
    for b in range(256):
        if b not in plain:
            byte[chr(n)], n = b, n + 1

    def piece(i):
        p = model.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) and model.is_byte(i) else p.replace("▁", " ").encode()

    return (lambda t: own.encode(" " + t, add_special_tokens=False).ids), model.encode, (lambda i: bytes(byte[c] for c in own.id_to_token(i))), piece


def brute_aligned(rows):
    in_a, in_b, bytes_a, bytes_b = brute_sides()
    docs, count = [], Counter()
    for i, t in rows:
        a, b = (in_a(t), in_b(t)) if t else ([], [])
        if not t or not b"".join(map(bytes_a, a)) == b"".join(map(bytes_b, b)) == (" " + t).encode():
            docs.append((i, [], [], [], []))
            continue
        ends = []
        for ids, spelled in ((a, bytes_a), (b, bytes_b)):
            n, own = 0, {}
            for k, x in enumerate(ids):
                n += len(spelled(x))
                own[n] = k
            ends.append(own)
        groups, links, ka, kb = [], [], 0, 0
        for at in sorted(ends[0].keys() & ends[1].keys()):
            ja, jb = ends[0][at], ends[1][at]
            groups.append(",".join(map(str, a[ka : ja + 1])) + "|" + ",".join(map(str, b[kb : jb + 1])))
            links.append((a[ja], b[jb]))
            ka, kb = ja + 1, jb + 1
        count.update(links)
        docs.append((i, a, b, groups, links))
    top = Counter()
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    return sorted(
        (
            (i, len(a), len(b), len(g), len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "")
            for i, a, b, g, links in docs
        ),
        key=str,
    )


def align_rows():
    rng = random.Random(11)
    bits = ["the", "naïve", "1234", "don't", "été", "漢字", "\U0001f642", "<s>", "</s>", "<unk>", "<0x0A>", "<|endoftext|>", "foo_bar", "antidisestablishmentarianism", "  ", "\n\n", "\t", "Ünïcödé", "x=1;", " "]
    rows = [(k, " ".join(rng.choice(bits) for _ in range(rng.randrange(1, 80)))) for k in range(120)]
    rows += [(500, None), (501, ""), (502, " "), (503, "a ▁ b"), (504, "▁"), (505, "\x00 nul"), (506, "word" * 4000), (None, "null id"), (7, rows[7][1]), (7, rows[7][1])]
    return rows + [(600, " ".join(rng.choice(bits) for _ in range(30_000))), (601, "end " * 50_000), (602, "  x" * 60_000)]


@pytest.mark.parametrize("head", [align.HEAD, 20, 0])
def test_alignment_equals_brute_force(spark, head):
    got = sorted((tuple(r) for r in align.cross_aligned(frame(spark, align_rows()), head=head).collect()), key=str)
    want = brute_aligned(align_rows())
    assert got == want
    assert sum(r[1] == 0 for r in want) == 4


def test_alignment_of_empty_table(spark):
    assert align.cross_aligned(frame(spark, [])).collect() == []
    assert [tuple(r)[1:] for r in align.cross_aligned(frame(spark, [(1, None)])).collect()] == [(0, 0, 0, 0, 0, 0, "")]


def test_pieces_and_strips(monkeypatch):
    text = " a  b\n c " + "é d " * 50
    assert "".join(align.cut(text, 5)) == text and len(align.cut(text, 5)) > 10
    a, b = np.cumsum(np.random.default_rng(0).integers(1, 9, (2, 4000)), axis=1)
    total = int(min(a[-1], b[-1]))
    a, b = a[a <= total], b[b <= total]
    want = sorted(set(a.tolist()) & set(b.tolist()))
    monkeypatch.setattr(align, "STRIP", 64)
    assert align.common_ends(a, b, total).tolist() == want
    buffer, at = align.digits(np.array([0, 9, 10, 99_999, 100]), np.frombuffer(b",|;,;", np.uint8))
    assert buffer.tobytes() == b"0,9|10;99999,100;" and at.tolist() == [0, 2, 4, 7, 13, 17]


def test_both_tokenizers_may_be_cut():
    assert align.byte_level(align.A).cuts and align.piece_level(align.B).cuts
    assert Path(public_tokenizers.path("byte_bpe_50k.json")).exists()
