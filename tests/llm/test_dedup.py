"""Exact duplicates and the n-gram join, against brute force and odd inputs."""

import random
import re
from collections import Counter

import pytest

from lexmill.llm import exact_dedup as E
from lexmill.llm import ngram_join as J


def ids(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_fingerprints_compose():
    data = bytes(random.Random(1).randbytes(10_000)) + b"\0\0"
    whole = E.fingerprint(data)
    assert whole == E.of_chunks(data, 777) == E.of_chunks(data, 1 << 20)
    assert whole == E.combine(E.fingerprint(data[:33]), E.fingerprint(data[33:]), len(data) - 33)
    value = 0
    for byte in data:
        value = (value * E.BASE + byte) % E.PRIME
    assert value == whole


def test_duplicates_of_small_and_huge_texts(docs_of):
    long = "é lorem ipsum " * 500
    docs = docs_of([(5, "a b"), (3, "a b"), (9, "a b"), (4, "a  b"), (1, long), (2, long), (7, long + "x"), (8, ""), (6, ""), (10, None), (11, None), (None, "a b")], "1 as fp")
    want = [(2, 1, 2), (5, 3, 3), (8, 6, 2), (9, 3, 3)]
    assert ids(E.duplicates(docs), "doc_id", "keep_id", "copies") == want
    assert ids(E.duplicates(docs, chunk=100, huge=300), "doc_id", "keep_id", "copies") == want


def test_collisions_are_told_apart(docs_of, monkeypatch):
    monkeypatch.setattr(E, "_hash_batches", lambda chunk: _weak)
    docs = docs_of([(1, "ab"), (2, "ba"), (3, "ab"), (4, "cc"), (5, "cc"), (6, "ba")])
    assert ids(E.duplicates(docs), "doc_id", "keep_id") == [(3, 1), (5, 4), (6, 2)]
    assert ids(E.duplicates(docs, chunk=1), "doc_id", "keep_id", "copies") == [(3, 1, 2), (5, 4, 2), (6, 2, 2)]


def _weak(batches):
    import pyarrow as pa

    for b in batches:
        n = b.num_rows
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([2] * n, pa.int64()), pa.array([7] * n, pa.int64())], names=["doc_id", "len", "fp"])


def test_drop_duplicates_keeps_one_of_each(docs_of):
    docs = docs_of([(1, "x"), (1, "x"), (2, "x"), (3, "y"), (4, None), (None, "x"), (5, "z"), (5, "w"), (6, "w")], "0 as keep_id").selectExpr("*", "map(1, 2) as m", "1 as _at", "2 as _maybe", "3 as _bits", "4 as _bucket", "5 as maybe", "6 as bits", "7 as BUCKET", "8 as fp")
    got = E.drop_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in got.collect()) == [(-1, "x"), (1, "x"), (3, "y"), (4, ""), (5, "w"), (5, "z")]
    assert E.drop_duplicates(docs.limit(0)).count() == 0 and E.duplicates(docs.limit(0)).count() == 0


def test_null_texts_stay_beside_removed_copies(docs_of):
    rows = [(1, "x"), (5, "x"), (5, None), (5, None)]
    for more in ([], [(8, "y"), (8, "z"), (8, None), (8, None)]):  # with and without an id of two texts
        got = [(r.doc_id, r.text) for r in E.drop_duplicates(docs_of(rows + more)).collect()]
        assert sorted(got, key=str) == sorted([(1, "x"), (5, None), (5, None)] + more, key=str)


def grams(text, n=J.N):
    w = re.findall(r"(?:[0-9a-z_]|[^\x00-\x7f])+", text.lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, threshold):
    """(doc_id, class_id, links) by comparing every text with every other."""
    texts = {}
    for d, t in rows:
        if d is not None and t is not None:
            texts[d] = max(t, texts.get(d, ""))
    sets = {d: grams(t) for d, t in texts.items() if grams(t)}
    ids, links, root = sorted(sets), Counter(), {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, d in enumerate(ids):
        for e in ids[:i]:
            x, y = sets[d], sets[e]
            if min(len(x), len(y)) >= threshold * max(len(x), len(y)) - 1e-9 and len(x & y) / len(x | y) >= threshold:
                links.update((d, e))
                low, high = sorted((find(d), find(e)))
                root[high] = low
    return {(d, find(d), k) for d, k in links.items()}


def found(df, **parameters):
    rows = [(r.doc_id, r.class_id, r.links) for r in J.similar(df, **parameters).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def corpus(seed, n=220):
    r = random.Random(seed)
    words = ["w%d" % int(r.paretovariate(0.6)) for _ in range(3000)]
    passage = " ".join(r.choices(words, k=60))
    rows = []
    for d in range(n):
        size = r.choice([1, 2, 3, 8, 20, 60, 150, 400, 700])
        base = r.choices(words, k=size)
        if rows and r.random() < 0.6:
            base = r.choice(rows)[1].split()
            for _ in range(int(len(base) * r.choice([0, 0.01, 0.03, 0.06, 0.1]))):
                base[r.randrange(len(base))] = r.choice(words)
        text = " ".join(base)
        if r.random() < 0.2:
            text += " " + passage
        rows.append((d, text))
    return rows


def test_classes_and_links_equal_brute_force(docs_of):
    for seed in (1, 2):
        rows = corpus(seed) + [(900, ""), (901, None), (None, "a b c"), (902, "!!! ..."), (903, "Été, ÉTÉ"), (904, "été été"), (904, "été été"), (905, "x y"), (905, "été ÉTÉ")]
        got = found(docs_of(rows, "'x' as g").selectExpr("*", "1 as sig", "2 as lead", "3 as maybe"))
        assert got == brute(rows, J.THRESHOLD)
        assert len(got) > 50


def crowd(seed, n=260):
    """Large groups of copies of a few texts, edited more or less, and texts that hold half of one."""
    r = random.Random(seed)
    bases = [[f"b{k}w{r.randrange(10**6)}" for _ in range(r.choice([12, 60, 150, 300]))] for k in range(3)]
    rows = []
    for d in range(n):
        words = list(r.choice(bases[:1] * 3 + bases))
        for _ in range(int(len(words) * r.choice([0, 0.01, 0.03, 0.06, 0.12, 0.2]))):
            words[r.randrange(len(words))] = f"e{r.randrange(10**6)}"
        if r.random() < 0.1:
            words = words[: len(words) // 2] + [f"e{r.randrange(10**6)}" for _ in range(len(words) // 3)]
        rows.append((r.randrange(10**9), " ".join(words)))
    return rows


def test_large_groups_are_counted_without_their_pairs(docs_of, monkeypatch):
    for seed, ball, threshold in ((1, 4, 0.6), (2, 8, 0.6), (3, 3, 0.3), (4, 3, 0.9), (5, 16, 0.5)):
        monkeypatch.setattr(J, "BALL", ball)
        monkeypatch.setattr(J, "BALL_TASK", 20)
        rows = crowd(seed)
        docs, scanned = J._prepared(docs_of(rows), J.N)
        sets = scanned.where("doc_id is not null").selectExpr("*", "1 as copies")
        led = J.candidate_pairs(docs, scanned, sets, J.N, threshold)
        assert led.where("step > 0").count() > 20
        got = found(docs_of(rows), threshold=threshold)
        assert got == brute(rows, threshold)


def test_thresholds_on_larger_sets(docs_of):
    rows = [(d, t) for d, t in corpus(7, 160) + [(1000 + d, t + " " + t[: len(t) // 3]) for d, t in corpus(8, 60)] if len(t) > 900]
    assert sum(len(grams(t)) > 128 for _, t in rows) > 40
    for threshold in (0.3, 0.6, 0.9):
        assert found(docs_of(rows), threshold=threshold) == brute(rows, threshold)


def test_ranges_and_splits_find_the_same(docs_of, monkeypatch):
    rows = corpus(3, 150)
    for name, value in (("RANGE_ROWS", 500), ("PAIRS_AT_ONCE", 3), ("HOT_GRAM", 4), ("COMPARED", 10), ("SLICE", 1000), ("BALL", 3)):
        monkeypatch.setattr(J, name, value)
    assert found(docs_of(rows)) == brute(rows, J.THRESHOLD)


def test_a_text_longer_than_a_piece(docs_of):
    r = random.Random(9)
    words = [f"w{r.randrange(10**6)}" for _ in range(60_000)]
    other = [w if r.random() > 0.05 else "edited" for w in words]
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[:30_000]))]
    assert found(docs_of(rows)) == brute(rows, J.THRESHOLD) == {(1, 1, 1), (2, 1, 1)}


def test_ids_of_other_types(docs_of):
    text = "one two three four five"
    docs = docs_of([(1, text), (2, text), (3, "six seven")])
    small = docs.withColumn("doc_id", docs.doc_id.cast("int"))
    assert found(small) == {(1, 1, 1), (2, 1, 1)}
    assert sorted(r.doc_id for r in J.drop_near_duplicates(small).collect()) == [1, 3]
    with pytest.raises(TypeError):
        J.similar(docs.withColumn("doc_id", docs.doc_id.cast("string")))


def test_pairs_near_the_threshold_are_found_among_larger_sets(docs_of, monkeypatch):
    monkeypatch.setattr(J, "FREQUENT", 0)
    r = random.Random(5)
    rows = []
    for d in range(0, 300, 2):
        size = r.randrange(130, 500)
        words = [f"v{r.randrange(10**9)}" for _ in range(size)]
        if d % 3:  # a text and its extension
            other = words + [f"v{r.randrange(10**9)}" for _ in range(int(size * r.uniform(0.54, 0.66)))]
        else:  # a copy with edits all over
            other = list(words)
            for i in r.sample(range(size), size // 9):
                other[i] = f"v{r.randrange(10**9)}"
        rows += [(d, " ".join(words)), (d + 1, " ".join(other))]
    want = brute(rows, J.THRESHOLD)
    assert len(want) > 200
    assert found(docs_of(rows)) == want


def test_groups_are_connected_components(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 9), (5, 6), (7, 9), (20, 21)] + [(100 + i, 101 + i) for i in range(40)], "doc_a bigint, doc_b bigint")
    want = {(2, 1), (3, 1), (7, 1), (9, 1), (6, 5), (21, 20)} | {(101 + i, 100) for i in range(40)}
    assert {(r.doc_id, r.keep_id) for r in J.groups(pairs).collect()} == want
    assert J.groups(pairs.limit(0)).count() == 0


def test_near_duplicates_are_dropped(docs_of):
    text = " ".join(f"word{i}" for i in range(60))
    docs = docs_of([(2, text), (1, text + " end"), (3, "something else entirely here"), (4, None), (None, text), (5, "")], "1 as a").selectExpr("*", "2 as _at", "3 as maybe", "4 as bits", "5 as bucket", "map(1, 2) as m")
    got = J.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in got.collect()) == [-1, 1, 3, 4, 5]
    assert J.similar(docs.limit(0)).count() == 0 and J.drop_near_duplicates(docs.limit(0)).count() == 0


def test_ids_far_apart(docs_of, monkeypatch):
    from lexmill.llm import _common as C

    monkeypatch.setattr(C, "ID_BITS", 1 << 16)
    monkeypatch.setattr(C, "BROADCAST_ROWS", 2)
    rows = [(d * 10**15 - 5, t) for d, t in corpus(6, 80)]
    want = brute(rows, J.THRESHOLD)
    assert found(docs_of(rows)) == want
    assert {r.doc_id for r in J.drop_near_duplicates(docs_of(rows)).collect()} == {d for d, _ in rows} - {d for d, c, _ in want if d != c}
    assert {r.doc_id for r in E.drop_duplicates(docs_of(rows)).collect()} == set({t: d for d, t in reversed(rows)}.values())
