"""Language models, BPE, quality and URLs, against brute force, exact round trips and held-out accuracy."""

import math
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lexmill.llm import byte_bpe as B
from lexmill.llm import language_id as L
from lexmill.llm import quality as Q
from lexmill.llm import url_filter as U

SYLLABLES = {"aa": "the and ing er on th re".split(), "bb": "der sch ein ung ß ä ich".split(), "cc": "ción que los ñ el ar".split()}


def prose(lang, r, n):
    return " ".join("".join(r.choices(SYLLABLES[lang], k=r.randint(1, 3))) for _ in range(n))


def kneser_ney(texts, order):
    """Interpolated Kneser-Ney from dictionaries: a function of history and character."""
    raw = [Counter() for _ in range(order + 1)]
    for t in texts:
        padded = "\0" * (order - 1) + t.lower()
        for i in range(order - 1, len(padded)):
            for k in range(1, order + 1):
                raw[k][padded[i - k + 1 : i + 1]] += 1
    counts = [Counter() for _ in range(order + 1)]
    counts[order] = raw[order]
    for k in range(order - 1, 0, -1):
        for g in raw[k + 1]:
            counts[k][g[1:]] += 1
    discount = []
    for k in range(order + 1):
        c = Counter(counts[k].values())
        discount.append(c[1] / (c[1] + 2 * c[2]) if c[1] and c[2] else 0.5)
    total, kinds = [defaultdict(float) for _ in counts], [defaultdict(float) for _ in counts]
    for k in range(1, order + 1):
        for g, c in counts[k].items():
            total[k][g[:-1]] += c
            kinds[k][g[:-1]] += 1

    def probability(history, char, vocabulary, k=order):
        if k == 0:
            return 1 / vocabulary
        h = history[len(history) - k + 1 :] if k > 1 else ""
        low = probability(history, char, vocabulary, k - 1)
        if not total[k][h]:
            return low
        return (max(counts[k][h + char] - discount[k], 0) + discount[k] * kinds[k][h] * low) / total[k][h]

    return probability, set(raw[1])


def test_language_models_equal_dictionaries():
    r = random.Random(3)
    texts = {lang: [prose(lang, r, 40) for _ in range(4)] for lang in SYLLABLES}
    models = L.fit(texts)
    brute = {lang: kneser_ney(t, L.ORDER) for lang, t in texts.items()}
    vocabulary = len(set().union(*(b[1] for b in brute.values()))) + 1
    asked = [prose("bb", r, 12), "Zz日本 und the", "x", prose("aa", r, 5) + "\n" + prose("cc", r, 5)]
    n, sums = models.totals([*asked, "", None])
    assert n.tolist() == [len(a) for a in asked] + [0, 0]
    for text, row in zip(asked, sums):
        padded = "\0" * (L.ORDER - 1) + text.lower()
        for j, lang in enumerate(models.languages):
            want = sum(math.log(brute[lang][0](padded[i - L.ORDER + 1 : i], padded[i], vocabulary)) for i in range(L.ORDER - 1, len(padded)))
            assert abs(want - row[j]) < 1e-3 * max(1, abs(want))


def test_language_is_found_and_foreign_text_rejected(docs_of, monkeypatch):
    r = random.Random(4)
    rows = [(i, prose(lang, r, r.randint(3, 80)), lang, "s") for i, lang in enumerate(random.Random(5).choices(list(SYLLABLES), k=300))]
    odd = [(1000, "日本語の文章です" * 30, "aa", "s"), (1001, "", "aa", "s"), (1002, None, None, None), (None, rows[0][1], "aa", "s"), (1003, rows[0][1], None, "s"), (1004, rows[0][1] * 400, None, "s")]
    docs = docs_of(rows + odd, "1.0 as keep")
    models = L.train(docs.where("doc_id < 1000"), 60)
    got = {x.doc_id: x for x in L.identify(docs, models).collect()}
    assert np.mean([got[i].language == lang for i, _, lang, _ in rows]) > 0.98
    assert sum(not got[i].keep for i, *_ in rows) <= 2
    assert not got[1000].keep and got[1001].language is None and not got[1001].keep and got[1002].bits_per_char is None
    assert got[1003].bits_per_char == got[0].bits_per_char and got[1004].keep
    kept = L.keep_identified(docs, models)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {i for i, x in got.items() if x.keep} | {None}
    monkeypatch.setattr(L, "PIECE", 50)
    assert np.allclose(models.totals([rows[0][1] * 20])[1], models.totals([rows[0][1] * 20])[1])
    assert L.identify(docs.limit(0), L.train(docs.limit(0))).count() == 0


def test_pieces_of_a_long_text_add_up(monkeypatch):
    r = random.Random(6)
    models = L.fit({lang: [prose(lang, r, 200)] for lang in SYLLABLES})
    text = prose("bb", r, 500)
    whole = models.totals([text])[1]
    monkeypatch.setattr(L, "PIECE", 64)
    assert np.allclose(models.totals([text])[1], whole, rtol=1e-5)


needs_vocabulary = pytest.mark.skipif(not os.path.exists(B.VOCABULARY), reason="no vocabulary here")


@needs_vocabulary
def test_bpe_equals_another_encoder_and_restores(spark, tables):
    import tiktoken

    tokens = B.read_vocabulary(B.VOCABULARY)
    other = tiktoken.Encoding("own", pat_str=B.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    texts = {x.doc_id: x.text for x in docs.collect()}
    got = B.encode(docs, check=True).collect()
    assert len(got) == len(texts) and all(x.restored and x.ids == other.encode_ordinary(texts[x.doc_id]) and x.tokens == len(x.ids) for x in got)


@needs_vocabulary
def test_bpe_of_odd_texts(docs_of):
    odd = ["", " ", "\n\n  \t x", "a" * 20_000, "日本語 👩‍👩‍👧 ñ ß", "<|endoftext|> ▁x <unk>", "\x00\x01", "don't  DON'T 12345", "é" * 300_000]
    rows = [(i, t) for i, t in enumerate(odd)] + [(99, None), (None, "x"), (1, " ")]
    encoded = B.encode(docs_of(rows, "array(1) as ids"), check=True)
    got = encoded.collect()
    assert len(got) == len(rows)
    assert all(x.ids is None and x.tokens is None and x.restored is None if x.doc_id == 99 else x.restored for x in got)
    back = {x.doc_id: x.text for x in B.decode(encoded).collect()}
    assert all(back[i] == t for i, t in enumerate(odd)) and back[99] is None
    assert B.encode(docs_of(rows).limit(0)).count() == 0


def test_model_file_is_read_back():
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_proto=B.serialise([bytes([i]) for i in range(256)] + [b"ab", b"abc"]))
    letters = B.byte_letters()
    assert p.get_piece_size() == 259 and p.encode("".join(letters[x] for x in b"abcab ")) == [257, 256, 32]


def test_features_equal_a_plain_count():
    texts = ["Ab cd! ## 12\nab ab ab cd ab ab", "", "É é é", "x"]
    got = Q.text_features(pa.array([*texts, None]))
    size = len(texts[0].encode())
    assert got[0].tolist() == pytest.approx([math.log1p(9), size / 9, 2 / size, 1 / size, 1 / size, 2 / size, 3 / 9, 0 / 7, math.log1p(9 / 2)])
    assert np.isfinite(got).all() and got[1].tolist() == got[4].tolist()


def test_shrinkage_equals_brute_force(spark):
    r = random.Random(8)
    rows = [(i, f"h{i % 7}", f"p{r.randint(0, 3)}", 5, min(max(r.gauss(0.1 + 0.12 * (i % 7), 0.1), 0.01), 0.99)) for i in range(400)] + [(900, "rare", "one", 5, 0.9), (901, "", "", 0, 0.99), (900, "rare", "one", 5, 0.9)]
    got = sorted(tuple(x) for x in Q.combine(spark.createDataFrame(rows, "doc_id bigint, host string, path string, chars bigint, evidence double")).collect())
    n, prior = len(rows), sum(x[4] for x in rows) / len(rows)
    hosts, paths = defaultdict(list), defaultdict(list)
    for x in rows:
        hosts[x[1]].append(x[4])
        paths[x[1:3]].append(x[4])
    mean = lambda v: sum(v) / len(v)
    kh = Q.strength(prior, n, len(hosts), sum(len(v) * (mean(v) - prior) ** 2 for v in hosts.values()) / n)
    kp = Q.strength(prior, n, len(paths), sum(len(v) * (mean(v) - mean(hosts[k[0]])) ** 2 for k, v in paths.items()) / n)
    want = []
    for d, h, p, chars, e in rows:
        host = (sum(hosts[h]) + kh * prior) / (len(hosts[h]) + kh)
        others = (sum(paths[h, p]) - e + kp * host) / (len(paths[h, p]) - 1 + kp)
        odds = math.log(e / (1 - e)) + math.log(others / (1 - others)) - math.log(prior / (1 - prior))
        posterior = 1 / (1 + math.exp(-odds))
        want.append((d, h, p, e, host, (sum(paths[h, p]) + kp * host) / (len(paths[h, p]) + kp), posterior, posterior >= 0.5 and chars > 0))
    for a, b in zip(got, sorted(want)):
        assert a[:3] == b[:3] and a[7] == b[7] and a[3:7] == pytest.approx(b[3:7], rel=1e-6)
    assert 1 < kh < 100 < kp  # hosts differ, paths on a host don't


def test_quality_on_held_out_labels(spark):
    from pyspark.sql import functions as F

    d = "/root/testdata/sf0.01" if os.path.exists("/root/testdata/sf0.01") else None
    if not d:
        pytest.skip("no tables here")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    scored = Q.score(docs, labels.where("doc_id % 2 = 0"), F.col("source"), F.col("lang"))
    held = scored.join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    assert np.mean([x.keep == bool(x.quality) for x in held]) > 0.95
    assert np.mean([x.keep for x in held if x.quality]) > 0.98


def test_quality_of_odd_rows(spark, docs_of):
    from pyspark.sql import functions as F

    docs = docs_of([(1, None, None, None), (2, "", "en", "a"), (None, "x y", "en", "a"), (3, "x y", "en", "a"), (3, "x y", "en", "a"), (4, "word " * 50_000, "en", "b")], "1 as host")
    labels = spark.createDataFrame([(3, 1), (None, 0), (4, None)], "doc_id bigint, quality int")
    got = Q.score(docs, labels, F.col("source"), F.col("lang")).collect()
    assert len(got) == 6 and not any(x.keep for x in got if x.doc_id in (1, 2))
    assert Q.score(docs.limit(0), labels, F.col("source"), F.col("lang")).count() == 0


def test_urls_split():
    assert U.split_url("HTTPS://u:p@WWW.Example.org:81/A/b.html?q=1#x") == ("www.example.org", "/a/b.html")
    assert U.split_url("example.org") == ("example.org", "") and U.split_url("//h/p") == ("h", "/p")


def test_url_features_equal_a_loop():
    got = defaultdict(list)
    for row, bucket in zip(*U.features(["ab.c", "", "é"], 1)):
        got[row].append(bucket)
    for i, t in enumerate(["ab.c", "", "é"]):
        want = []
        for n in U.SIZES:
            data = f"^{t}$".encode()
            for at in range(len(data) - n + 1):
                acc = n * 1_000_003 + 1
                for byte in data[at : at + n]:
                    acc = acc * 0x100000001B3 % 2**64 ^ byte
                want.append(int(U.mix(np.array([acc], np.uint64))[0]) % U.BUCKETS)
        assert sorted(got[i]) == sorted(want)


def test_url_filter_on_held_out_rows(spark):
    rows = U.labelled_urls()
    random.Random(1).shuffle(rows)
    hosts = sorted({U.split_url(u)[0].split(".")[-3] for u, _ in rows})
    held = set(random.Random(2).sample(hosts, len(hosts) // 4))
    test = [x for x in rows if U.split_url(x[0])[0].split(".")[-3] in held]
    weights = U.train([x for x in rows if x not in test])
    p = U.scores([u for u, _ in test], weights)
    assert np.mean([(a >= U.BLOCK_AT) == bool(y) for a, (_, y) in zip(p, test)]) > 0.85
    pages = spark.createDataFrame([(1, "https://spam-farm.example.org/win"), (2, "https://library.example.org/en/3"), (3, None), (4, " "), (None, "x"), (2, "https://library.example.org/en/3"), (5, "h" * 100_000)], "page_id bigint, url string").selectExpr("*", "1 as score")
    got = U.score_urls(pages, U.train()).collect()
    by = {x.page_id: x for x in got}
    assert len(got) == 7 and by[1].blocked and not by[2].blocked and by[3].score is None and not by[4].blocked
    assert U.score_urls(pages.limit(0), U.train([])).count() == 0
