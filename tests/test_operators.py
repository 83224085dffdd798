"""Operators on small tables with results worked out by hand."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.operators import agent, analytics, bm25, chunking, compliance, evaluation, hybrid, integrity, memory, router, sampling, tree, vector
from lexmill.operators import spread as spreading
from lexmill.operators import words as splitting
from lexmill.plans import retrieval


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t"))).first()[0]


def test_fusion(spark):
    hits = lambda names: spark.createDataFrame([(1, ord(n), n * 3, i + 1) for i, n in enumerate(names)], "query_id int, doc_id int, text string, place int")
    got = [(chr(r.doc_id), round(r.rrf_score, 9), r.search_type) for r in hybrid.fuse(hits("abc"), hits("cad")).orderBy("place").collect()]
    assert got == [("a", 0.016314120, "bm25+vector"), ("c", 0.016029144, "bm25+vector"), ("b", 0.011290323, "vector"), ("d", 0.004761905, "bm25")]


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "apple banana apple"), (2, "banana cherry"), (3, "cherry date fig")], "doc_id bigint, text string")
    queries = spark.createDataFrame([(7, "apple cherry")], "query_id int, query string")
    assert [(r.doc_id, r.score) for r in bm25.search(docs, queries).orderBy("place").collect()] == [(1, 0.701563), (2, 0.028779), (3, 0.024181)]
    idf = {r.term: round(r.idf, 6) for r in bm25.term_statistics(docs).collect()}
    assert idf == {"apple": 0.510826, "date": 0.510826, "fig": 0.510826, "banana": 0.025541, "cherry": 0.025541}
    assert bm25.search(docs.limit(0), queries).count() == 0


def test_bm25_moves_no_postings(spark, monkeypatch):
    docs = spark.createDataFrame([(d, "common " + ("rare " * (d % 5)) + f"own{d % 7}") for d in range(60)], "doc_id bigint, text string")
    queries = spark.createDataFrame([(q, f"common rare own{q}") for q in range(7)], "query_id int, query string")
    want = [tuple(r) for r in bm25.search(docs, queries, 4).orderBy("query_id", "place").collect()]
    assert len(want) == 28
    for name, value in (("QUERIES_AT_ONCE", 2), ("TERMS_AT_ONCE", 5), ("CELLS", 1), ("BROADCAST_TERMS", 1)):
        monkeypatch.setattr(bm25, name, value)
    assert [tuple(r) for r in bm25.search(docs, queries, 4).orderBy("query_id", "place").collect()] == want
    monkeypatch.undo()
    plan = bm25.search(docs, queries, 4)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan


def test_words_are_those_of_the_expression(spark, monkeypatch):
    draw = random.Random(3)
    letters = "aB z_9.,-\nß\u00e9\u0130\u212aſ²Ⅷ日本\u0301\U0001d400\U0001d7d8\U00010400\U0001f642ǅΣς\u200d\x00"
    rows = [(i, "".join(draw.choices(letters, k=draw.randrange(30)))) for i in range(500)] + [(500, ""), (501, "ab"), (502, "éa"), (503, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    text = F.coalesce("text", F.lit(""))
    t = docs.select("doc_id", F.lower(text).alias("t"), X.tokens(text).alias("w")).orderBy("doc_id").toArrow().combine_chunks()
    for at_once in (1, 50, 1 << 20):
        monkeypatch.setattr(splitting, "AT_ONCE", at_once)
        found = [(lo, counts, said.to_pylist()[::2]) for lo, counts, said in splitting.words(t["t"].chunk(0).slice(2), np.unpackbits(splitting.letters()).astype(bool))]
        assert [w for *_, said in found for w in said] == [w for own in t["w"].to_pylist()[2:] for w in own]
        assert [n for _, counts, _ in found for n in counts] == [len(own) for own in t["w"].to_pylist()[2:]] and found[0][0] == 0


@pytest.mark.parametrize("held", [1, 5, 1_000_000])
def test_partitions_count_their_words(spark, monkeypatch, held):
    monkeypatch.setattr(bm25, "TERMS_HELD", held)
    texts = [f"common own{d % 7} own{d % 7} Éa{d % 3} x" if d % 10 else None for d in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    counted = bm25.counts(docs)
    want = Counter(w for t in texts if t for w in set(t.lower().split()) - {"x"}) | {None: 60}
    assert {r.term: (r.df, r.total) for r in counted.collect()} == {w: (n, 0 if w else 54 * 4) for w, n in want.items()}
    # no row a word leaves the documents, and no expression goes over them
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan and "regexp" not in plan


def test_one_large_row_group_is_spread(spark, tmp_path, monkeypatch):
    draw = random.Random(1)
    rows = [(d, f"common own{d % 7} " + " ".join("".join(draw.choices("abcdefgh", k=9)) for _ in range(20))) for d in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/one")
    docs.repartition(8).write.parquet(f"{tmp_path}/eight")
    one, eight = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("one", "eight"))
    size = int(str(one._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for key, value in zip(before, (size // 16, 0)):
        spark.conf.set(key, value)
    # both tables hold more than a row group a core; one's is read by a single task
    monkeypatch.setattr(spreading, "ROW_GROUP", size // 5)
    moved = lambda df: "RoundRobinPartitioning" in df._jdf.queryExecution().executedPlan().toString()
    shorter = lambda df: df.select("doc_id", F.upper("text").alias("t"))
    assert one.rdd.getNumPartitions() > 8 and moved(spreading.spread(one)) and moved(spreading.spread(shorter(one)))
    assert not moved(spreading.spread(eight)) and not moved(spreading.spread(shorter(eight)))
    queries = spark.createDataFrame([(q, f"common own{q}") for q in range(7)], "query_id int, query string")
    got = [bm25.search(x, queries, 4).orderBy("query_id", "place").collect() for x in (one, eight, docs)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 28
    for key, value in before.items():
        spark.conf.set(key, value)


def test_hybrid_search_shuffles_no_texts(spark):
    docs = spark.createDataFrame([(d, f"text about w{d % 4} and w{d % 3} " + "x" * d, "en" if d % 2 else "de", "s") for d in range(40)], "doc_id bigint, text string, lang string, source string")
    vectors = spark.createDataFrame([(d, [float(d % 5 + 1), float(d % 7)]) for d in range(0, 60, 2)], "doc_id bigint, embedding array<float>")
    queries = spark.createDataFrame([(q, f"w{q} text", [1.0, float(q)]) for q in range(4)], "query_id bigint, query string, query_vector array<float>")
    for language in (None, "de"):
        apart = retrieval.hybrid_search(docs, queries, language=language, vectors=vectors)
        together = retrieval.hybrid_search(docs.join(vectors, "doc_id", "left"), queries, language=language)
        assert sorted(apart.collect()) == sorted(together.collect()) and apart.count() == 40
    plan = retrieval.hybrid_search(docs, queries, vectors=vectors)._jdf.queryExecution().executedPlan().toString()
    # the only sorted join is that of ids with vectors
    assert plan.count("SortMergeJoin") <= 1 and "BroadcastHashJoin" in plan


@pytest.mark.parametrize("name", ["eval_summary", "eval_metrics"])
def test_common_words_meet_no_join_in_evaluation(spark, tables, name):
    from lexmill import queries as library

    plan = library.queries()[name](spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "term" not in plan


def test_rerank_leaves_short_lists_alone(spark):
    rows = [(1, d, "red fox", "red fox" if d == 6 else "x", d) for d in range(1, 7)] + [(2, d, "red", "red", d) for d in range(1, 4)]
    got = hybrid.rerank(spark.createDataFrame(rows, "query_id int, doc_id int, query string, text string, place int"), 5).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r.place) if r.query_id == 1] == [6, 1, 2, 3, 4]
    assert all(r.rerank_score is None for r in got if r.query_id == 2)


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0]), (4, None), (5, [0.6, 0.8])], "vec_id bigint, embedding array<float>")
    q = spark.createDataFrame([(9, [2.0, 0.0])], "query_id bigint, query_vector array<float>")
    assert [(r.vec_id, r.score) for r in vector.search(v, q).orderBy("place").collect()] == [(1, 1.0), (5, 0.8), (2, 0.5)]
    for blocks in (1, 3):
        assert {(r.a, r.b) for r in vector.similar_pairs(v, 0.5, blocks=blocks).collect()} == {(1, 5), (2, 5)}


def test_claims_and_contradictions(spark):
    docs = spark.createDataFrame([(1, "Request timeout is 30 seconds. Retries must not exceed."), (2, "Request timeout is 60 seconds."), (3, "Retries must be logged."), (4, None)], "doc_id bigint, text string")
    got = integrity.claims(docs)
    assert {(r.doc_id, r.claim_key, r.claim_value) for r in got.collect()} == {(1, "request timeout", "30seconds"), (1, "retries", "must_not"), (2, "request timeout", "60seconds"), (3, "retries", "logged"), (3, "retries", "must")}
    found = {r.claim_key: r for r in integrity.contradictions(got).collect()}
    assert {k: r.severity for k, r in found.items()} == {"request timeout": "high", "retries": "high"} and found["retries"].distinct_values == 3
    assert integrity.evidence(got, docs).count() == 4


@pytest.mark.parametrize(("text", "want"), [("30 seconds", "30seconds"), ("5 min.", "5min"), ("3.5 gb", "3.5gb"), ("50%", "50"), ("30s", "30s"), ("5min", "5min"), ("A  b", "a b")])
def test_values(spark, text, want):
    assert one(spark, text, X.norm_value) == want


def test_health(spark):
    issues = lambda rows: spark.createDataFrame(rows, "type string, severity string, title string, recommendation string, ord int")
    some = integrity.health(issues([("drift", "high", "", "", 1), ("drift", "high", "", "", 2), ("blind_spot", "medium", "", "", 3)])).first()
    assert (some.penalty, some.score, some.band, some.n_drift) == (31, 69, "fair", 2)
    none = issues([])
    assert tuple(integrity.health(none).select("score", "band").first()) == (100, "excellent")
    assert [r.recommendation for r in integrity.recommendations(none).collect()] == [integrity.NO_RISK]
    assert [r.recommendation for r in integrity.recommendations(issues([("d", "low", "", "b", 2), ("d", "low", "", "a", 3), ("d", "low", "", "b", 1)])).orderBy("place").collect()] == ["b", "a"]


def test_gaps_and_drift(spark):
    docs = spark.createDataFrame([(1, "a", "We run Postgres and backups."), (2, "b", "TLS everywhere")], "doc_id bigint, source string, text string")
    assert {r.topic for r in integrity.blind_spots(docs).where("covered").collect()} == {"backups & restore", "encryption"}
    assert [r.dependency for r in integrity.resilience_gaps(docs).where("gap").collect()] == ["database"]
    now = integrity.fingerprints(docs)
    before = now.withColumn("fingerprint", F.when(F.col("file") == "a", "old").otherwise(F.col("fingerprint")))
    assert [r.file for r in integrity.drift(now, before).collect()] == ["a"]


def test_sample(spark):
    rows = spark.createDataFrame([(i, "a" if i < 10 else "b" if i < 13 else "c") for i in range(14)], "doc_id int, source string")
    assert sorted(r.doc_id for r in sampling.stratified(rows, 6).collect()) == [0, 5, 10, 11, 13]
    assert sampling.stratified(rows, 100).count() == 14 and sampling.stratified(rows, 2).count() == 2


def tree_rows(nodes):
    return {(r.title, r.node_id, r.parent_id, r.end_page) for r in nodes.collect()}


def test_tree(spark):
    entries = spark.createDataFrame([("d", i, level, title, page) for i, (level, title, page) in enumerate([(1, "Intro", 1), (2, "Scope", 2), (2, "Terms", 3), (1, "Body", 5), (2, "Part", 6)])], "doc_id string, ord int, level int, title string, start_page int")
    pages = spark.createDataFrame([("d", p, f"text {p}") for p in range(1, 10)], "doc_id string, page int, text string")
    nodes = tree.build(entries, spark.createDataFrame([("d", 9)], "doc_id string, total_pages int"))
    assert tree_rows(nodes) == {("Intro", "0001", None, 4), ("Scope", "0001.0001", "0001", 2), ("Terms", "0001.0002", "0001", 4), ("Body", "0002", None, 9), ("Part", "0002.0001", "0002", 9)}
    chosen = spark.createDataFrame([("d", "0001.0001", 1), ("d", "0001", 2), ("d", "none", 3)], "doc_id string, node_id string, sel_ord int")
    assert {r.title: r.pages for r in tree.extract(nodes, pages, chosen).collect()} == {"Scope": [2], "Intro": [1, 3, 4]}
    assert tree.outline(nodes).first().outline.split("\n")[1] == "  [0001.0001] Scope (pages 2-2)"
    assert tree.summaries(nodes, pages.withColumn("text", F.lit("A sentence that is long enough. Ok."))).where("node_id = '0001.0001'").first().summary == "A sentence that is long enough."


def test_parents_equal_a_stack(spark):
    r = random.Random(3)
    levels = [r.randint(1, 4) for _ in range(40)]
    entries = spark.createDataFrame([("d", i, lv, f"t{i}", i + 1) for i, lv in enumerate(levels)], "doc_id string, ord int, level int, title string, start_page int")
    got = {x.ord: x for x in tree.build(entries, spark.createDataFrame([("d", 50)], "doc_id string, total_pages int")).collect()}
    stack, children = [], {}
    for i, lv in enumerate(levels):
        while stack and stack[-1][0] >= lv:
            stack.pop()
        up = stack[-1][1] if stack else None
        children[up] = children.get(up, 0) + 1
        name = f"{up}." * (up is not None) + f"{children[up]:04d}"
        assert (got[i].node_id, got[i].parent_id) == (name, up)
        stack.append((lv, name))


def test_headings(spark):
    want = {"Chapter 1: The start": (1, "The start"), "1. Introduction": (1, "Introduction"), "1.2 Scope of it": (2, "Scope of it"), "1.2.3 Deep": (3, "Deep"), "IV. Results": (1, "Results"), "B. Details": (2, "Details"), "Appendix A - More": (1, "More"), "ALL CAPITAL LINE": (1, "ALL CAPITAL LINE"), "plain text": None, "ab": None, "Section 2.1: 12345": None}
    rows = spark.createDataFrame([(k,) for k in want], "t string").select("t", tree.heading(F.col("t")).alias("h")).collect()
    assert {r.t: tuple(r.h) if r.h else None for r in rows} == want


def test_fonts_outlines_and_even_pages(spark):
    blocks = [("d", 1, "Big title", 20.0, False, 0), ("d", 1, "body text that is long", 10.0, False, 1), ("d", 1, "another body text here", 10.0, False, 2), ("d", 2, "Middle", 14.0, False, 0), ("d", 2, "Bold run", 11.0, True, 1), ("d", 2, "7", 20.0, False, 2)]
    df = spark.createDataFrame(blocks, "doc_id string, page int, text string, font_size double, is_bold boolean, block_idx int")
    assert [(r.title, r.level) for r in tree.font_entries(df).orderBy("ord").collect()] == [("Big title", 1), ("Middle", 2), ("Bold run", 3)]
    pages = spark.createDataFrame([("e", p, "1. First\n2. Second\n3. Third" if p == 1 else "x") for p in range(1, 13)], "doc_id string, page int, text string")
    assert [(r.ord, r.start_page, r.title) for r in tree.even_entries(pages).orderBy("ord").collect()] == [(1, 1, "1. First"), (2, 6, "Pages 6–10"), (3, 11, "Pages 11–12")]
    best = tree.best_entries(tree.pattern_entries(pages), tree.even_entries(pages))
    assert [r.title for r in best.orderBy("ord").collect()] == ["First", "Second", "Third"]
    lone = spark.createDataFrame([("d", 1, 1, "Only", 1)], "doc_id string, ord int, level int, title string, start_page int")
    assert tree.outline_entries(lone).count() == 0 and tree.outline_entries(lone.union(lone.withColumn("ord", F.lit(2)))).count() == 2


def test_routes(spark):
    want = {"show me the parser": ("code_lookup", 4), "why is it broken": ("debugging", 8), "project layout": ("architecture", 8), "which option": ("configuration", 4), "a versus b": ("comparison", 6), "explain joins": ("explanation", 6), "hello": ("general", 5)}
    got = spark.createDataFrame([(k,) for k in want], "t string").select("t", router.route(F.col("t")).alias("r")).collect()
    assert {r.t: (r.r.category, r.r.suggested_top_k) for r in got} == want


def test_evaluation(spark):
    cases = spark.createDataFrame([(1, ["z"]), (2, ["q"]), (3, None)], "query_id int, expected array<string>")
    hits = spark.createDataFrame([(q, s, i + 1) for q in (1, 2, 3) for i, s in enumerate("xyz")], "query_id int, source string, place int")
    got = evaluation.evaluate(cases, hits)
    assert {r.query_id: (r.retrieval_hit, round(r.mrr, 6)) for r in got.collect()} == {1: (True, 0.333333), 2: (False, 0.0), 3: (True, 1.0)}
    total = evaluation.summarise(got.withColumn("faithfulness", F.lit(-1.0)).withColumn("relevance", F.col("query_id") - 2.0)).first()
    assert (total.total_cases, round(total.hit_rate, 6), total.avg_faithfulness, total.avg_relevance) == (3, 0.666667, -1.0, 0.5)


def words(text):
    return len(text.split())


def test_prose_windows():
    text = "\n".join("a b c d" for _ in range(6))
    got = list(chunking.prose("p", text, words, 10, 4, 2))
    assert [(lo, hi) for _, _, lo, hi in got] == [(1, 3), (3, 5), (5, 6)]
    assert [i for i, *_ in got] == [chunking._id("p", *x) for x in ((0, 2), (2, 4), (4, 6))]


def test_prose_sections_and_code():
    assert chunking.sections("Title\n===\nbody\n# next\nmore".split("\n")) == [(0, 1), (1, 3), (3, 5)]
    source = "import x\n\ndef a():\n    return 1\n\n\ndef b():\n    return 2\nclass C:\n    def m(self): pass\n"
    got = list(chunking.code("p.py", source, "python", words, 5, 1))
    assert [(lo, hi) for _, _, lo, hi in got] == [(1, 2), (3, 6), (7, 8), (9, 11)]
    assert "".join(c + "\n" for _, c, _, _ in got) == source + "\n"


@pytest.mark.parametrize("seed", range(3))
def test_every_line_is_in_a_chunk(seed):
    r = random.Random(seed)
    text = "\n".join(r.choice(["# h", "", "w " * r.randint(1, 40), "---"]) for _ in range(80))
    covered = {n for _, _, lo, hi in chunking.prose("p", text, words, 50, 8, 0) for n in range(lo, hi + 1)}
    assert covered == set(range(1, 81))


def test_chunks_of_a_table(spark):
    docs = spark.createDataFrame([("def a():\n" + "    x = 1\n" * 20, "a.py", "python"), ("word " * 900, "b.md", "markdown"), (" \n", "c.md", "text"), (None, "d", None)], "content string, filepath string, language string")
    got = chunking.chunk(docs).collect()
    assert {(r.document_path, r.chunk_type) for r in got} == {("a.py", "code"), ("b.md", "prose")}
    assert all(r.source == f"{r.document_path}:{r.start_line}-{r.end_line}" for r in got)


def test_memory(spark):
    angle = lambda a: [math.cos(a), math.sin(a)]
    rows = [(1, i, angle(a), f"m{i}", 0.1 * i) for i, a in enumerate([0, 0.3, 1.2, 1.3, 3.0])]
    df = spark.createDataFrame(rows, "user int, ord int, embedding array<float>, content string, importance double")
    assert {r.ord: r.kept for r in memory.insert_new(df, "user", "ord").collect()} == {0: True, 1: False, 2: True, 3: False, 4: True}
    assert {(r.ord, r.leader, r.members) for r in memory.leader_clusters(df, "user", "ord").collect()} == {(0, 0, 2), (1, 0, 2), (2, 2, 2), (3, 2, 2)}
    assert {(r.ord, r.content, round(r.importance, 1)) for r in memory.consolidate(df, "user", "ord").collect()} == {(0, "m0 m1", 0.1), (2, "m2 m3", 0.3), (4, "m4", 0.4)}
    assert [r.ord for r in memory.every_nth_turn(df, "user", ["ord"]).collect()] == [2]
    q, a = F.lit("How do joins work here?"), F.lit("x" * 120)
    gate = lambda q, a: spark.range(1).select(memory.worth_extracting(q, a)).first()[0]
    assert gate(q, a) and not gate(F.lit("thank you"), a) and not gate(q, F.lit("short")) and not gate(F.lit("Please help me now"), a)


def test_text_functions(spark):
    assert one(spark, "Été à la_mode x 12", X.tokens) == ["été", "la_mode", "12"]
    assert one(spark, "x" * 300, X.snippet) == "x" * 239 + "…" and one(spark, " a \n b ", X.snippet) == "a b"
    assert one(spark, "The Size of THE (big) cache-line is what we use now and then again ever", X.norm_key) == "size big cache line what we use now"
    assert one(spark, "a/b.c\\d.TXT", X.suffix) == ".txt" and one(spark, ".env", X.suffix) == ""
    assert one(spark, "x" * 10 + "y" * 10, lambda t: X.head_and_tail(t, 10)) == "xxxxx\n...\nyyyyy"
    assert one(spark, '```json\n{"a": 1}\n```', X.fenced_json) == '{"a": 1}' and one(spark, 'say {"a": 1} ok', X.fenced_json) == '{"a": 1}' and one(spark, "no", X.fenced_json) is None
    assert one(spark, "preference", X.memory_type) == "pref" and one(spark, "fact", X.memory_type) == "fact"


def test_analytics(spark):
    files = spark.createDataFrame([("a/b/x.py",), ("a/y.md",), ("z.md",)], "path string")
    assert {r.folder: r.files for r in analytics.by_top_dir(files).collect()} == {"a": ["a/b/x.py", "a/y.md"], "(root)": ["z.md"]}
    assert {r.folder: r["count"] for r in analytics.by_parent_dir(files).collect()} == {"a/b": 1, "a": 1, ".": 1}
    assert [tuple(r) for r in analytics.extension_histogram(files).collect()] == [(".md", 2), (".py", 1)]
    s = spark.createDataFrame([(80.0,), (50.0,), (30.0,), (0.0,)], "s double")
    assert [r[0] for r in s.select(analytics.risk_label(F.col("s"))).collect()] == ["critical", "high", "medium", "low"]
    assert [r[0] for r in spark.createDataFrame([(0.5,), (-1.0,)], "s double").select(analytics.percent(F.col("s"))).collect()] == ["50%", "—"]
    assert [r.path for r in analytics.page(files, ["path"], 1, 1).collect()] == ["a/y.md"]


def test_agent_and_compliance(spark):
    hits = spark.createDataFrame([("a.py", 1, "text")], "source string, place int, text string")
    replies = iter(['{"tool": "search", "input": "x"}', 'noise {"tool": "answer", "input": "done"}'])
    got = agent.run("q", lambda q: hits, lambda q: hits, lambda p: next(replies))
    assert got.answer == "done" and got.sources == [("a.py", 1)] and len(got.steps) == 2
    assert agent.run("q", lambda q: hits, lambda q: hits, lambda p: '{"tool": "dance"}').answer.startswith("Found 0")
    docs = spark.createDataFrame([(i, "s", "t") for i in range(5)], "doc_id int, source string, text string")
    row = compliance.scan(docs, "GDPR", llm=lambda p: '{"risk_score": 170, "summary": "bad"}').first()
    assert (row.risk_score, row.summary, row.sampled) == (100, "bad", 5)
    assert compliance.scan(docs, "SOC2").first().risk_score == 50


def test_extraction(spark):
    from lexmill.operators import extraction

    turns = spark.createDataFrame([(1, i, f"How does part {i} work here?", "x" * 150) for i in range(1, 7)] + [(2, 3, "hi", "x")], "user_id int, turn int, question string, answer string")
    reply = '```json\n[{"c": "Part is a pump", "t": "preference", "i": 7, "g": ["a", "b", "c"]}, {"content": "short"}, {"content": "Another thing known", "importance": 0.2}, {"c": "a fourth one is dropped"}]\n```'
    got = extraction.extract(turns, lambda p: reply).orderBy("turn", "n").collect()
    assert [(r.turn, r.content, r.memory_type, r.importance, r.tags) for r in got[:2]] == [(3, "Part is a pump", "pref", 1.0, ["a", "b"]), (3, "Another thing known", "fact", 0.2, [])] and len(got) == 4
    assert extraction.extract(turns).count() == 0
    talk = spark.createDataFrame([(1, i, "user", f"m{i}") for i in range(5)] + [(2, 0, "user", "x")], "conv_id int, turn int, role string, text string")
    assert [tuple(r) for r in extraction.summarise(talk, lambda p: '{"s": "They talked", "g": ["t"]}').collect()] == [(1, "They talked", "summary", 0.6, ["t"])]


def test_tree_queries(spark):
    pages = spark.createDataFrame([(d, p, f"about {w} and more") for d in ("d", "e") for p, w in enumerate(["cats", "dogs", "birds"], 1)], "doc_id string, page int, text string")
    entries = spark.createDataFrame([(d, p, 1, w, p) for d in ("d", "e") for p, w in enumerate(["cats", "dogs", "birds"], 1)], "doc_id string, ord int, level int, title string, start_page int")
    nodes = tree.build(entries, pages.groupBy("doc_id").agg(F.max("page").alias("total_pages"))).withColumn("summary", F.lit(""))
    queries = spark.createDataFrame([(1, "tell me of dogs"), (2, "birds")], "query_id int, query string")
    got = {(r.query_id, r.doc_id): (r.node_id, r.pages) for r in tree.query(nodes, pages, queries, 1).collect()}
    assert got == {(1, "d"): ("0002", [2]), (1, "e"): ("0002", [2]), (2, "d"): ("0003", [3]), (2, "e"): ("0003", [3])}
    assert tree.raw_view(pages).count() == 2 and tree.node_view(nodes, pages).count() == 6 and tree.page_view(pages).first().char_count > 0


def test_claims_search_each_text_once(spark):
    texts = ["The retry limit is 5 times. It is x.y", "is: a\n\n= b", "A value are  .\nkey : v", "this that - other/x =\t\n must not be. Must be: ok", "Timeout must not exceed. Limits should\tbe 3.5 ms", "abc is.abc is d", "x" * 70 + " is y", "Queue SHOULD NOT grow; cache IS warm", "aaa is bbb is ccc. " * 3, "é is ü: caché = né", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    body = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    found = lambda p: body.select("doc_id", F.explode(F.regexp_extract_all("t", F.lit(p), F.lit(0))).alias("m"))
    stated = found(X.KEYVAL).select("doc_id", X.norm_key(F.regexp_extract("m", X.KEYVAL, 1)).alias("k"), X.norm_value(F.trim(F.regexp_extract("m", X.KEYVAL, 2))))
    ruled = found(X.BOOL).select("doc_id", X.norm_key(F.regexp_extract("m", X.BOOL, 1)).alias("k"), F.replace(F.lower(F.regexp_extract("m", X.BOOL, 2)), F.lit(" "), F.lit("_")))
    got = integrity.claims(docs)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stated.union(ruled).where("k <> ''").distinct().collect()))
    scans = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Scan ")
    assert scans(integrity.claims(docs)) == 1
    assert scans(integrity.recommendations(integrity.issues(docs.withColumn("source", F.lit("s"))))) == 2


def test_fingerprints_pass_on_ten_texts_a_file(spark):
    docs = spark.createDataFrame([(d, f"f{d % 2}", f"text {d}") for d in range(50)], "doc_id int, source string, text string")
    got = integrity.fingerprints(docs)
    body = "\n".join(f"text {d}" for d in range(0, 20, 2))
    import hashlib

    assert {r.file: r.fingerprint for r in got.collect()}["f0"] == hashlib.sha256(f"f0|25|{body}".encode()).hexdigest()
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_chunks_leave_in_small_batches(spark, monkeypatch):
    text = "\n".join(f"line {i} " + "word " * 30 for i in range(200))
    docs = spark.createDataFrame([(text, f"p{i}", "en") for i in range(6)] + [(None, "p", "en")], "content string, filepath string, language string")
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    want = sorted(chunking.chunk(docs).collect())
    assert len(want) == 6 * len(list(chunking.prose("p", text))) and int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 8 << 20
    monkeypatch.setattr(chunking, "OUT_CHARS", 1)
    assert sorted(chunking.chunk(docs).collect()) == want
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)


def test_health_finds_each_issue_once(spark):
    docs = spark.createDataFrame([(1, "s", "The retry limit is 5."), (2, "s", "The retry limit is 6. We run Postgres.")], "doc_id int, source string, text string")
    health = integrity.health(integrity.issues(docs))
    assert health._jdf.queryExecution().executedPlan().toString().count("Scan ") == 2
    got = health.first()
    # of the topics only "timeouts & retries" is named, so four high and three medium ones are missing; a retry mitigates
    assert (got.n_contradiction, got.n_blind_spot, got.n_resilience_gap, got.penalty) == (1, 7, 0, 12 + 3 * 12 + 4 * 7)


def test_claims_are_sought_at_verbs_only(spark, tables):
    parts = ["a", "b", "is", "are", "should be", "must be", "must", "should", "should not", " ", "  ", "\n", "\t", ":", "=", ".", ",", "é", "x1_", "-", "/", "word ", "IS", "Must", "9", "İ", "x" * 30, "y " * 20]
    draw = random.Random(3)
    for _ in range(4000):
        text = "".join(draw.choices(parts, k=draw.randint(0, 30)))
        for verbs, whole in (integrity._CLAIM, integrity._RULE):
            assert [(m.span(), m.groups()) for m in integrity._matches(text, verbs, whole)] == [(m.span(), m.groups()) for m in whole.finditer(text)], text
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    assert "regexp_extract_all" not in integrity.claims(docs)._jdf.queryExecution().executedPlan().toString()


def test_issues_search_spread_texts_for_all_needles(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    plan = integrity.issues(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("RoundRobinPartitioning") == 2 and "Contains" not in plan and "contains" not in plan
    texts = spark.createDataFrame([(None,), ("über RETENTION",), ("roll\nback, dr\nplan",), ("",)], "text string")
    assert [r.topic for r in integrity.blind_spots(texts).collect() if r.covered] == ["backups & restore"]
    assert not any(r.covered for r in integrity.blind_spots(texts.limit(0)).collect()) and integrity.blind_spots(texts.limit(0)).count() == 8


def test_health_tries_no_pattern_on_whole_texts(spark, tables):
    from lexmill import queries as library

    plan = library.queries()["health_score"](spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and "contains(" not in plan.lower() and plan.count("MapInArrow") >= 2


def test_needles_are_found_without_lowering_texts(spark):
    draw = random.Random(5)
    parts = ["bac", "k", "K", "K", "up", "UP", "s3", "ſ3", "tİmeout", "t", "İ", "meout", "ß", "日", " ", "at", "rest", "\n", "multi", "-", "az", "roll", "Quota", "\x00"]
    for _ in range(8):
        texts = spark.createDataFrame([("".join(draw.choices(parts, k=draw.randint(0, 9))),) for _ in range(4)] + [(None,)], "text string")
        # bytes that are no text hide nothing behind them
        texts = texts.unionByName(spark.sql("select cast(concat(X'ff', cast(' RBAC' as binary)) as string) as text")).cache()
        lists = [n for *_, n in integrity.TOPICS] + [integrity.MITIGATIONS]
        want = texts.agg(*(F.coalesce(F.bool_or(X.contains_any(F.col("text"), n.split("|"))), F.lit(False)) for n in lists)).first()
        found = integrity._named(integrity._alone(texts, "text"), lists)
        assert tuple(found.first()) == tuple(want) and want[6]
        assert "lower(" not in found._jdf.queryExecution().executedPlan().toString()
        texts.unpersist()


def test_claim_keys_are_those_of_the_expression(spark):
    draw = random.Random(6)
    keys = ["".join(draw.choices("aBz09_/- ", k=draw.randint(1, 12))) + draw.choice(["", " The", " of a", " in/to be", " a b c d e f g h i j"]) for _ in range(500)]
    want = spark.createDataFrame([(k,) for k in keys], "t string").select(X.norm_key(F.col("t"))).toArrow().column(0).to_pylist()
    assert [integrity._norm_key(k) for k in keys] == want
    docs = spark.createDataFrame([(1, "The is 5. Of the: x. The cache must not grow")], "doc_id int, text string")
    assert [(r.claim_key, r.claim_value) for r in integrity.claims(docs).collect()] == [("cache", "must_not")]
    assert "split(" not in integrity.claims(docs)._jdf.queryExecution().executedPlan().toString()
