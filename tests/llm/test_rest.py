"""License scans, neighbours, mixing, WARC and the pipeline."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lexmill.llm import ann as A
from lexmill.llm import license_scan as S
from lexmill.llm import mixing as M
from lexmill.llm import warc as W


def shingles(text):
    w = re.findall(r"(?:[0-9a-z_]|[^\x00-\x7f])+", text.lower())
    return [tuple(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [tuple(w)] if w else []


def brute_licenses(rows):
    """Every window of every template size at every step, without MinHash."""
    out = {}
    for d, text in rows:
        doc = shingles(text or "")
        for name, wording in S.TEMPLATES:
            t = shingles(wording)
            step = max(1, len(t) // 4)
            for at in range(0, len(doc), step):
                part = doc[at : at + len(t) + step - 1]
                share = len(set(part) & set(t)) / len(set(t))
                if d is not None and share >= S.CONTAINMENT:
                    out[d, name] = max(out.get((d, name), 0), share)
    return out


def test_licenses_equal_brute_force(docs_of):
    r = random.Random(5)
    filler = lambda n: " ".join("w%d" % r.randint(0, 500) for _ in range(n))
    rows = []
    for d in range(300):
        words = r.choice(S.TEMPLATES)[1].split()
        for _ in range(r.choice([0, 0, 1, 2])):
            words[r.randrange(len(words))] = "changed"
        rows.append((d, f"{filler(r.randint(0, 80))} {' '.join(words)} {filler(r.randint(0, 80))}" if d % 3 else filler(100)))
    rows += [(900, ""), (901, None), (None, "Released under the MIT License."), (902, "Released under the MIT License."), (902, "Released under the MIT License."), (903, filler(60_000) + " Licensed under CC BY-NC 4.0. " + filler(50)), (904, "the")]
    got = [(x.doc_id, x.license, x.containment) for x in S.scan(docs_of(rows, "1 as license")).collect()]
    assert sum(x[0] == 902 for x in got) == 2
    want = brute_licenses(rows)
    found = {(d, n): c for d, n, c in got}
    assert set(found) <= set(want) and len(found) >= 0.99 * len(want) and len(want) > 150
    assert np.mean([abs(found[k] - want[k]) < 1e-9 for k in found]) > 0.99
    assert all(k in found for k, share in want.items() if share == 1)
    assert S.scan(docs_of(rows).limit(0)).count() == 0


def test_bands_keep_their_promise():
    for j in (0.3, 0.5, 0.8):
        for rows in (1, 2, 4):
            bands = S.bands_for(j, rows)
            assert 1 - (1 - j**rows) ** bands >= S.CERTAINTY > (1 - (1 - j**rows) ** (bands - 1) if bands > 1 else 0)


def exact_neighbours(rows, k=10):
    """Ids of the k nearest by cosine to six places, ties by id."""
    names = np.array([r.vec_id for r in rows])
    x = np.array([r.embedding for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i in np.flatnonzero(names % A.QUERY_EVERY == 0):
        s = np.round(x @ x[i], 6)
        s[names == names[i]] = -9
        out[names[i]] = [(names[j], s[j]) for j in np.lexsort((names, -s))[:k]]
    return out


def test_neighbours_recall(spark, tables):
    vectors = spark.read.parquet(f"{tables}/embeddings.parquet")
    want = exact_neighbours(vectors.collect())
    got: dict[int, list] = {}
    for r in A.nearest(vectors).collect():
        got.setdefault(r.vec_id, []).append((r.place, r.neighbour, r.cosine))
    assert set(got) == set(want)
    assert np.mean([len({m for m, _ in want[n]} & {m for _, m, _ in got[n]}) / 10 for n in want]) >= 0.9
    assert all([p for p, _, _ in sorted(g)] == list(range(1, len(g) + 1)) for g in got.values())


def test_neighbours_in_clusters_and_among_copies(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 16))
    x = centres[rng.integers(0, 60, 6000)] + 0.15 * rng.normal(size=(6000, 16))
    x[100:2100] = x[100]  # a third are copies of one
    monkeypatch.setattr(A, "RUN", 300)
    monkeypatch.setattr(A, "CELL", 8)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    want = exact_neighbours(vectors.collect())
    got: dict[int, set] = {}
    for r in A.nearest(vectors).collect():
        got.setdefault(r.vec_id, set()).add(r.neighbour)
    assert set(got) == set(want) and np.mean([len({m for m, _ in want[n]} & got[n]) / 10 for n in want]) >= 0.9
    assert got[150] == set(range(100, 110))


def test_neighbours_of_odd_vectors(spark):
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 1) for _ in range(5)]) for i in range(60)]
    odd = [(100, None), (101, []), (102, [0.0] * 5), (103, [1.0]), (None, [1.0] * 5), (104, [1.0, None, 0.0, 0.0, 0.0]), (0, rows[0][1]), (105, rows[0][1])]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>").selectExpr("*", "1 as id", "2 as curve", "3 as run", "4 as part", "5 as v")
    got = A.nearest(df, k=3, query_every=1).collect()
    assert {x.vec_id for x in got} == set(range(60)) | {104, 105}
    assert all(x.vec_id != x.neighbour for x in got) and len({(x.vec_id, x.neighbour) for x in got}) == len(got)
    assert any(x.vec_id == 105 and x.neighbour == 0 and x.place == 1 for x in got)
    assert {x.vec_id for x in A.nearest(df, k=3).collect()} == {0, 50}
    assert A.nearest(df.limit(0)).count() == 0 and A.nearest(df.where("vec_id = 1")).count() == 0


def test_hilbert_curve_is_one_path():
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    keys = A.hilbert_keys(cells, 3)
    assert sorted(keys.tolist()) == list(range(512)) and (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_mixture_has_fixed_size_and_target_shares(docs_of):
    rows = [(i, f"t{i}", "en", "big" if i % 10 < 7 else "mid" if i % 10 < 9 else "tiny") for i in range(1000)] + [(5000, "x", "en", None), (5001, None, None, None), (None, "y", "en", "tiny"), (5, "t5", "en", "mid")]
    docs = docs_of(rows).selectExpr("*", *(f"{i} as {c}" for i, c in enumerate("_p _whole _n _q _unit _copies copies copy KEY whole p odds place".split())))
    out = M.mix(docs, rate=1.0)
    assert all(r._p == 0 and r._copies == 5 and r.place == 12 for r in out.limit(20).collect())
    assert M.mix_copies(docs, copies="copies").columns == [*docs.columns, "__copies"]
    got = Counter(r.source for r in out.collect())
    assert out.columns == docs.columns and sum(got.values()) == len(rows)
    sizes = Counter(r[3] for r in rows)
    whole = sum(math.sqrt(n) for n in sizes.values())
    for s, n in sizes.items():
        assert abs(got[s] - len(rows) * math.sqrt(n) / whole) <= 12
    weighted = Counter(r.source for r in M.mix(docs, weights={"tiny": 1.0, "mid": 1.0}, rate=0.5).collect())
    assert set(weighted) == {"tiny", "mid"} and sum(weighted.values()) == round(0.5 * len(rows))
    assert sum(r._copies for r in M.mix_copies(docs_of([(1, "a")] * 50 + [(2, "b", "en", "z")] * 9), rate=0.5).collect()) == round(0.5 * 59)
    assert M.mix(docs.limit(0)).count() == 0


def test_inclusion_follows_the_probabilities(docs_of):
    docs = docs_of([(i, "x", "en", "a" if i < 300 else "b") for i in range(400)])
    seen = Counter()
    for seed in range(6):
        seen.update(r.source for r in M.mix(docs, weights={"a": 3.0, "b": 2.0}, rate=0.3, seed=str(seed)).collect())
    assert abs(seen["a"] / (seen["a"] + seen["b"]) - 0.6) < 0.06


def test_derivatives_link_to_their_sources(spark, tmp_path):
    html = "<html lang=en><head><title> A\n b</title><script>var x='<p>'</script></head><body><!-- c --><h1>T&amp;lt;&#233;&#x1F600;</h1><p>one &lt;two&gt; <b>bold</b><br>next&nbsp;line <a href=/x>l</a><p>cut <i"
    pages = spark.createDataFrame([(1, "http://h/a", html), (2, None, None), (None, "u", ""), (2, None, None), (3, "u", "&#0;&#55296;&bogus;x")], "page_id bigint, url string, html string").selectExpr("*", "1 as block")
    responses = W.responses_of_pages(pages)
    got = W.derive(responses).collect()
    assert len(got) == 10
    source = responses.collect()[0]
    meta, conv = sorted((r for r in got if r.refers_to == source.record_id), key=lambda r: r.record_type, reverse=True)
    assert conv.block == "T&lt;é😀\none <two> bold\nnext line l\ncut"
    assert f"conversion-record: {conv.record_id}\r\n" in meta.block and "title:  A b\r\n" in meta.block and "outlinks: 1\r\n" in meta.block and "language: en\r\n" in meta.block
    import hashlib

    for r in (meta, conv):
        assert r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest() and r.source_payload_digest == "sha256:" + hashlib.sha256(html.encode()).hexdigest()
        assert r.content_length == len(r.block.encode()) and f"WARC-Refers-To: {source.record_id}\r\n" in r.header
    assert W.derive(responses.limit(0)).count() == 0
    W.write_warc(W.derive(responses), f"{tmp_path}/out")
    back = W.read_warc(spark, f"{tmp_path}/out").collect()
    assert sorted((r.record_type, r.record_id, r.refers_to, r.payload) for r in back) == sorted((r.record_type, r.record_id, r.refers_to, r.block) for r in got)


def test_responses_are_read_from_files(spark, tmp_path):
    import gzip

    body = "<p>Hé</p>".encode()
    http = b"HTTP/1.1 404 Not Found\r\nContent-Type: text/html\r\n\r\n" + body
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nWARC-Target-URI: http://a/\r\nWARC-Date: 2024-01-02T00:00:00Z\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n" % len(http) + http + b"\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(record))
    (tmp_path / "b.warc").write_bytes(record[:-30])
    (tmp_path / "c.warc").write_bytes(b"")
    rows = W.read_warc(spark, str(tmp_path))
    assert rows.count() == 3
    first = rows.where("payload = '<p>Hé</p>'").collect()
    assert len(first) == 2 and first[0].http_header.startswith("HTTP/1.1 404")
    got = W.derive(rows.where("record_type = 'response'")).where("record_type = 'metadata'").collect()
    assert all("source-status: 404\r\n" in r.block for r in got)


def test_pipeline_equals_its_stages_by_brute_force(spark, tables):
    import corpus_pipeline as P

    from .test_dedup import brute
    from lexmill.llm import byte_bpe, language_id, ngram_join

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    models = language_id.train(docs)
    rows = {r.doc_id: r for r in docs.collect()}
    n, sums = models.totals([r.text for r in rows.values()])
    kept = {d for d, ok in zip(rows, models.judge(n, sums)[2]) if ok}
    first: dict[str, int] = {}
    for d in sorted(kept):
        first.setdefault(rows[d].text, d)
    kept = set(first.values())
    later = {d for d, c, _ in brute([(d, rows[d].text) for d in kept], ngram_join.THRESHOLD) if d != c}
    kept -= later
    sizes = Counter(rows[d].source for d in kept)
    whole, size = sum(math.sqrt(x) for x in sizes.values()), round(M.RATE * len(kept))
    import hashlib

    copies, ranks, places = {}, [], 0.0
    for s, x in sizes.items():
        due = size * math.sqrt(x) / whole / x
        rest = due - int(due)
        rest = 0.0 if min(rest, 1 - rest) < 1e-9 else rest
        places += rest * x
        for d in kept:
            if rows[d].source == s:
                copies[d] = round(due) if rest == 0 else int(due)
                u = (int(hashlib.md5(f"{d}:{M.SEED}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                if rest:
                    ranks.append(((u / (1 - u)) / (rest / (1 - rest)), d))
    for _, d in sorted(ranks)[: round(places)]:
        copies[d] += 1
    got = P.run(spark, tables).collect()
    assert Counter(r.doc_id for r in got) == Counter({d: c for d, c in copies.items() if c})
    assert all(r.restored and byte_bpe.codec().decode(r.ids) == rows[r.doc_id].text for r in got)


@pytest.mark.parametrize("extra", [[], ["map(1, 2) as m", "1 as _at", "2 as maybe", "3 as _p", "4 as copies", "5 as keep_id", "6 as bits"]])
def test_pipeline_stages_take_odd_rows(spark, tables, docs_of, extra):
    import corpus_pipeline as P

    good = spark.read.parquet(f"{tables}/documents.parquet").where("lang = 'en'").limit(40)
    text = good.first().text
    odd = docs_of([(-1, None), (-2, ""), (None, text, None, None), (-3, text, "en", None), (-3, text, "en", None), (-3, None), (-4, text + " more", "en", "s"), (-5, (text + " ") * 300, "en", "s")])
    docs = good.select("doc_id", "text", "lang", "source", "n_chars").unionByName(odd).selectExpr("*", *extra)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, tables)
        assert out.schema.names == docs.schema.names and out.count() <= 60, name
        assert stage(spark, docs.limit(0), tables).count() == 0, name
    kept = P.remove_near_copies(spark, P.remove_copies(spark, P.identify_language(spark, docs, tables), tables), tables).collect()
    ids = [r.doc_id for r in kept]
    assert ids.count(None) == 1 and -1 not in ids and -2 not in ids and -3 not in ids and -4 not in ids and -5 in ids  # all similar; the lowest stays
    assert P.encode(spark, docs, tables).count() == docs.count()
