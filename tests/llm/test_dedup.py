import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import components, exact_dedup, line_dedup, minhash

WS = re.compile(r"[\x20\x09-\x0D]+")
DOC = "doc_id bigint, text string"


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, DOC).repartition(3)
    return df.withColumns({"keep_id": F.lit("x"), "gone": F.lit(1), "class": F.lit("y"), "Lines": F.lit(2)}) if extra else df


def words(rng, n):
    return [f"{rng.choice('abcdefgh')}{rng.randrange(400)}" for _ in range(n)]


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[WS.sub(" ", t or "")].append(i)
    out = []
    for i, t in rows:
        norm = WS.sub(" ", t or "")
        ids = [x for x in groups[norm] if x is not None]
        keep = min(ids, default=None)
        kept = len(groups[norm]) == 1 if keep is None else i == keep
        out.append((i, keep, len(groups[norm]), kept, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


def exact_rows():
    rng = random.Random(1)
    long = " ".join(words(rng, 30_000))
    return [(1, "a  b"), (2, "a\tb"), (3, None), (4, ""), (5, " "), (6, long), (7, long.replace(" ", "\n ", 5)), (8, long + "x"), (9, "a b "), (9, "a b "), (None, "only null id"), (None, "a b"), *((100 + k, "hot copy of one text") for k in range(300))]


def test_exact_equals_brute_force(spark):
    got = sorted(map(tuple, exact_dedup.exact_duplicates(frame(spark, exact_rows())).collect()), key=str)
    assert got == brute_exact(exact_rows())


def test_exact_splits_colliding_identifiers(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(words(rng, rng.choice([1, 2, 3, 800])))) for k in range(40)] + [(50, "aa"), (51, "bb"), (52, "aa")]
    got = sorted(map(tuple, exact_dedup.exact_duplicates(frame(spark, rows), name=lambda chunk: len(chunk) % 3).collect()), key=str)
    assert got == brute_exact(rows)


def test_chunks_depend_on_content():
    rng = np.random.default_rng(0)
    a = rng.integers(97, 123, 60_000, np.uint8)
    b = np.concatenate([np.frombuffer(b"some words before it", np.uint8), a])
    chunks = [{x[i:j].tobytes() for i, j in zip([0, *exact_dedup.cuts(x)], exact_dedup.cuts(x))} for x in (a, b)]
    assert exact_dedup.cuts(a)[-1] == len(a) and len(chunks[0] & chunks[1]) > 0.9 * len(chunks[0])
    flat = np.zeros(100_000, np.uint8)
    assert max(np.diff([0, *exact_dedup.cuts(flat)])) <= exact_dedup.MOST


def test_empty_tables(spark):
    none = frame(spark, [])
    assert exact_dedup.exact_duplicates(none).count() == 0
    assert minhash.near_duplicates(none).count() == 0
    assert line_dedup.without_repeats(none).count() == 0


def shingle_set(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = [x for x in WS.split(lower) if x]
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_near(rows, percent=85):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(shingle_set(t), []).append(i)
    classes = {s: min(i) for s, i in sets.items() if s}
    parent = {c: c for c in classes.values()}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    each = list(classes.items())
    for k, (s, a) in enumerate(each):
        for t, b in each[:k]:
            common = len(s & t)
            if 100 * common >= percent * (len(s) + len(t) - common) and root(a) != root(b):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    out = []
    for i, t in rows:
        s = shingle_set(t)
        comp = None if i is None else i if not s else root(classes[s])
        out.append((i, len(s), comp, i is not None and i == comp))
    return sorted(out, key=str)


def near_rows(rng, groups, members, edits):
    rows, number = [(None, "a null id here now"), (1000, None), (1001, " \n"), (1002, "two words"), (1003, "TWO  words"), (1004, "x"), (1004, "x")], 0
    for _ in range(groups):
        base = words(rng, rng.choice([40, 90, 200]))
        for _ in range(members):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
            rows.append((number, " ".join(w)))
            number += 1
    return rows


@pytest.mark.parametrize("seed,groups,members,edits", [(1, 30, 4, 3), (2, 1, 150, 5), (3, 3, 40, 3)])
def test_near_equals_brute_force(spark, seed, groups, members, edits):
    rows = near_rows(random.Random(seed), groups, members, edits)
    got = sorted(map(tuple, minhash.near_duplicates(frame(spark, rows)).collect()), key=str)
    assert got == brute_near(rows)


def test_exact_rest_in_blocks(spark, monkeypatch):
    """Small blocks: the pairs of a bucket's classes meet over several calls."""
    monkeypatch.setattr(minhash, "SIDE", 16)
    rows = near_rows(random.Random(9), 1, 120, 5)
    got = sorted(map(tuple, minhash.near_duplicates(frame(spark, rows, extra=False)).collect()), key=str)
    assert got == brute_near(rows)


def test_common_counts(monkeypatch):
    monkeypatch.setattr(minhash, "STRIP", 7)
    rng = random.Random(3)
    for _ in range(12):
        n, base = rng.randint(2, 50), [rng.getrandbits(62) for _ in range(80)]
        sets = [np.array(sorted({*rng.sample(base, rng.randint(1, 70)), *(rng.getrandbits(62) for _ in range(4))}), np.int64) for _ in range(n)]
        for strip, out in minhash.common_counts(sets, np.arange(n)):
            for a, i in enumerate(strip):
                assert all(out[a, j] == len(np.intersect1d(sets[i], sets[j])) for j in range(n) if j != i)


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(5)
    errors, equal = [], []
    for j in (0.3, 0.6, 0.85, 0.95):
        for _ in range(40):
            n = 2000
            both = int(n * 2 * j / (1 + j))
            x = rng.integers(0, 1 << 63, 2 * n - both).astype(np.uint64)
            a, b = minhash.registers(x[:n], np.array([0])), minhash.registers(x[n - both :], np.array([0]))
            assert (np.maximum(a, b) == minhash.registers(x, np.array([0]))).all()
            errors.append(minhash.estimate(a, b, np.array([n]), np.array([n]))[0] - j)
            equal += [(a == b).mean()] if j == 0.85 else []
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.07 and np.mean(equal) > 0.83


def test_components_of_a_long_path(spark):
    edges = [(k, k + 1) for k in range(200)] + [(500, 501), (502, 501)] + [(600, 600 + k) for k in range(1, 50)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{k: 0 for k in range(201)}, 500: 500, 501: 500, 502: 500, **{k: 600 for k in range(600, 650)}}


def distance_one(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) <= 1
    if abs(len(x) - len(y)) > 1:
        return False
    long, short = (x, y) if len(x) > len(y) else (y, x)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def brute_lines(rows, least=5, edits=1):
    lines = sorted((i, n, tuple(w), t) for i, t in rows if i is not None and t is not None for n, line in enumerate(t.split("\n")) if (w := [x for x in WS.split(line) if x]))
    gone = defaultdict(set)
    for k, (i, n, w, t) in enumerate(lines):
        if any((a, b) < (i, n) and (v == w or edits and min(len(v), len(w)) >= least and distance_one(v, w)) for a, b, v, _ in lines[:k]):
            gone[i, t].add(n)
    return sorted(((i, t if i is None or t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i, t])) for i, t in rows), key=str)


def line_rows(rng):
    def vary(w):
        w, k = list(w), rng.randrange(len(w))
        how = rng.randrange(4)
        if how == 0:
            w[k] = "other"
        elif how == 1:
            del w[k]
        elif how == 2:
            w.insert(k, "more")
        return w

    pool = [words(rng, rng.choice([2, 4, 5, 6, 9, 30])) for _ in range(25)]
    rows = []
    for i in range(60):
        ls = [rng.choice(["  ", " ", "\t"]).join(vary(rng.choice(pool)) if rng.random() < 0.5 else words(rng, rng.randint(1, 12))) for _ in range(rng.randint(0, 6))]
        rows.append((i, "\n".join(ls) + rng.choice(["", "\n", "\r"])))
    same = "one long line that is in very many documents here"
    rows += [(100 + k, same) for k in range(80)] + [(200 + k, f"page number {k} of this very long book") for k in range(80)]
    return [*rows, (None, same), (300, None), (301, ""), (302, " ".join(words(rng, 4000))), (303, same + "\nshort tail"), (303, same + "\nshort tail")]


def test_lines_equal_brute_force(spark):
    rows = [*line_rows(random.Random(11)), (400, "All rights reserved.\nx\n\n \nAll  rights\treserved."), (401, "All rights reserved.\nAll rights kept.\nx \n"), (-5, "x"), (403, "All rights reserved")]
    out = line_dedup.without_repeats(frame(spark, rows))
    assert out.columns == ["doc_id", "text", "keep_id", "gone", "class", "Lines"]
    assert sorted(map(tuple, out.select("doc_id", "text").collect()), key=str) == brute_lines(rows)


@pytest.mark.parametrize("least,edits", [(2, 1), (8, 1), (5, 0)])
def test_lines_with_other_bounds(spark, least, edits):
    rows = line_rows(random.Random(12))
    out = line_dedup.without_repeats(frame(spark, rows, extra=False), least=least, edits=edits)
    assert sorted(map(tuple, out.collect()), key=str) == brute_lines(rows, least, edits)


def test_several_texts_of_an_id(spark):
    """Lines of two texts of one id stand at one place: neither is earlier, and each goes by itself."""
    a, b, c = "the first line of this very text", "an entirely different line it is", "the first line of that very text"
    rows = [(1, a + "\n" + b), (1, c + "\n" + b), (1, b), (2, c), (2, "one more line\n" + a), (3, a + "\n" + b), (3, a + "\n" + b), (0, None)]
    got = sorted(map(tuple, line_dedup.without_repeats(frame(spark, rows, extra=False)).collect()), key=str)
    assert got == brute_lines(rows)


def test_emptied_documents_go(spark):
    a = "five words are in here\nand another line of six words"
    rows = [(1, a), (2, a), (3, a + "\nshort"), (4, a + "\nbut this one has its own line too"), (5, "tiny"), (6, None), (7, a + "\n \n\t"), (8, " \n"), (9, "short\ntiny"), (None, a)]
    got = {r.doc_id: r.text for r in line_dedup.without_emptied(frame(spark, rows)).collect()}
    assert got == {1: a, 3: "short", 4: "but this one has its own line too", 5: "tiny", 6: None, 8: " \n", None: a}


def test_ids_of_another_kind_are_an_error(spark):
    docs = spark.createDataFrame([("a", "text")], "doc_id string, text string")
    for f in (line_dedup.without_repeats, minhash.near_duplicates, minhash.without_near_duplicates):
        with pytest.raises(TypeError):
            f(docs)


def test_near_with_several_texts_of_an_id(spark):
    """The class of each text counts; a component's id is the least id of its rows."""
    rng = random.Random(8)
    a, b = words(rng, 60), words(rng, 60)
    text = lambda w, k=None: " ".join(w if k is None else [*w[:k], "else", *w[k + 1 :]])
    rows = [(1, text(a)), (1, text(b)), (5, text(a, 0)), (5, text(b, 59)), (7, text(b, 0)), (9, "other words than these are here"), (9, text(a, 59)), (None, text(a)), (None, "no id has this"), (None, "no id has this")]
    got = sorted(map(tuple, minhash.near_duplicates(frame(spark, rows)).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)
    want = [(1, 56, 1, True), (1, 56, 1, True), (5, 56, 1, False), (5, 56, 1, False), (7, 56, 1, False), (9, 2, 9, True), (9, 56, 1, False), (None, 56, None, False), (None, 1, None, False), (None, 1, None, False)]
    assert got == sorted(want, key=str)
    kept = minhash.without_near_duplicates(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "keep_id", "gone", "class", "Lines"]
    assert sorted(map(tuple, kept.select("doc_id", "text").collect()), key=str) == sorted([rows[0], rows[1], rows[5], rows[8]], key=str)


def test_one_row_of_each_group_stays(spark):
    rng = random.Random(10)
    a = words(rng, 40)
    one, near, case = " ".join(a), " ".join([*a[:-1], "z"]), " ".join(a).upper()
    rows = [(4, one), (4, one), (4, case), (4, near), (6, near), (8, ""), (8, ""), (9, None), (10, " \n"), (None, ""), (None, near), (2, "alone in the world")]
    kept = sorted(map(tuple, minhash.without_near_duplicates(frame(spark, rows, extra=False)).collect()), key=str)
    assert len([r for r in kept if r[0] == 4]) == 1 and [r for r in kept if r[0] != 4] == [(10, " \n"), (2, "alone in the world"), (8, ""), (8, ""), (9, None), (None, "")]
    assert minhash.without_near_duplicates(frame(spark, [])).count() == 0


def test_long_texts_in_pieces(monkeypatch):
    """Pieces and the carried factor give what one block gives."""
    import evidentia.llm._text as _text
    from evidentia.llm import quality

    rng = random.Random(2)
    texts = [" ".join(words(rng, 900)), "x" * 5000 + " y y " + "z" * 3000, " ".join(["a"] * 3000), "\n" * 4000 + "end " * 40, "é" * 2000, "one two"]

    def everything():
        out = []
        for t in texts:
            data = np.frombuffer(t.encode(), np.uint8)
            hashes, at = minhash.shingles(data, np.array([0, len(data)]))
            at_, share = quality.counts(t.encode())
            out.append((sorted(set(hashes.tolist())), at.tolist(), minhash.registers(hashes, at[:-1]).tolist(), at_.tolist(), share.tolist(), exact_dedup.cuts(data)))
        return out

    whole = everything()
    _text._powers.clear()
    for module in (_text, minhash, quality, exact_dedup):
        monkeypatch.setattr(module, "BLOCK", 512)
    try:
        assert everything() == whole
    finally:
        _text._powers.clear()


def test_counts_of_long_sets_stay_small():
    """Two dozen long sets that share nearly everything: the counts are right and need little more than the sets."""
    import tracemalloc

    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 1 << 63, 174_762, np.uint64))
    sets = [np.unique(np.concatenate([base[k:], rng.integers(0, 1 << 63, 50, np.uint64)])) for k in range(24)]
    tracemalloc.start()
    got = {int(i): row for strip, out in minhash.common_counts(sets, np.arange(24)) for i, row in zip(strip, out)}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(got[i][j] == (len(sets[i]) if i == j else len(np.intersect1d(sets[i], sets[j]))) for i in (0, 11, 23) for j in range(24) if i != j)
    assert peak < 400 << 20
