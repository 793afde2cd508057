"""Post-processing, metrics, coreference, selection, text functions: literals and brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkloom.functions import text as T
from chunkloom.functions.vectors import HashingEmbedder, RestEmbedder, prompted
from chunkloom.operators import coref, metrics, postprocess, rag, reports, retrieval, select
from chunkloom.operators.splitters import RecursiveSplitter
from chunkloom.plans import pipeline
from chunkloom.schemas import CHUNK, conform

CHUNKS = "doc_name string, method string, chunk_index long, start int, end int, chunk_len long"


def chunks(spark, sizes, name="d", method="m"):
    rows, at = [], 0
    for i, n in enumerate(sizes):
        rows.append((name, method, i, at, at + n, n))
        at += n
    return spark.createDataFrame(rows, CHUNKS)


# post-processing


def test_locate():
    assert postprocess.locate(["Hello world. ", "This is a test. ", "Final sentence."], "Hello world. This is a test. Final sentence.") == [(0, 13), (13, 29), (29, 44)]
    assert postprocess.locate([], "x") == []
    spans = postprocess.locate(["AAAA ", "BBBB ", "CCCC"], "AAAA BBBB CCCC")
    assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert postprocess.locate(["ab ab", " ab ab"], "ab ab ab") == [(0, 5), (2, 8)]
    with pytest.raises(ValueError):
        postprocess.locate(["zzz"], "abc")


def span_frame(spark, spans, size):
    return spark.createDataFrame([([{"start": a, "end": b} for a, b in spans], size)], "spans array<struct<start:int,end:int>>, size int")


@pytest.mark.parametrize("spans, size, good", [([(0, 6), (6, 12)], 12, True), ([(0, 6), (16, 22)], 22, False), ([], 0, True), ([], 3, False), ([(0, 9), (2, 4), (5, 12)], 12, True), ([(1, 3)], 3, False), ([(0, 2)], 3, False)])
def test_gap_check_and_repair(spark, spans, size, good):
    df = span_frame(spark, spans, size)
    assert df.select(postprocess.gap_free(F.col("spans"), F.col("size"))).first()[0] is good
    if spans:
        fixed = df.select(postprocess.without_gaps(F.col("spans"), F.col("size")).alias("spans"), "size")
        assert fixed.select(postprocess.gap_free(F.col("spans"), F.col("size"))).first()[0] is True


def test_gap_goes_to_the_next_chunk(spark):
    fixed = span_frame(spark, [(0, 10), (15, 19)], 25).select(postprocess.without_gaps(F.col("spans"), F.col("size"))).first()[0]
    assert [tuple(s) for s in fixed] == [(0, 10), (10, 25)]


def test_pages_and_titles(spark):
    doc = [("d", [(1, "abcde"), (2, ""), (3, "fghij")], "abcdefghij", [("# A", 0, 10, 1), ("## B", 4, 8, 2), ("# fg", 5, 10, 1)], 4, 7)]
    df = spark.createDataFrame(doc, "doc_name string, pages array<struct<page:int,text:string>>, full_text string, titles array<struct<title:string,start:int,end:int,level:int>>, start int, end int")
    got = postprocess.annotated(df).first()
    assert got["chunk_text"] == "efg" and got["chunk_pages"] == [1, 2, 3] and got["titles_context"] == "# A\n## B"


def test_merges():
    text = " ".join("w" * 1 for _ in range(40))
    spans = [(0, 10), (10, 14), (14, 60), (60, 64), (64, len(text))]
    for merge in (postprocess.merge_smallest_first, postprocess.merge_to_side):
        out = merge(text, spans, 4, 25)
        assert out[0][0] == 0 and out[-1][1] == len(text) and len(out) < len(spans)
    assert postprocess.merge_to_side("a b c d", [(0, 2), (2, 4), (4, 7)], 2, 3, "previous") == [(0, 4), (4, 7)]
    assert postprocess.merge_smallest_first("x " * 30, [(0, 40), (40, 42), (42, 60)], 3, 5) == [(0, 40), (40, 42), (42, 60)]
    with pytest.raises(ValueError):
        postprocess.merge_to_side("a", [(0, 1)], side="up")


def test_oversized_chunks_are_split():
    text = " ".join(f"w{i}" for i in range(50))
    out = postprocess.split_oversized(text, [(0, 30), (30, len(text))], RecursiveSplitter(10), 20)
    assert out[0] == (0, 30) and len(out) > 2 and out[-1][1] == len(text)
    assert postprocess.Postprocessor(most=20, least=5, most_merged=25)(text, [(0, len(text))])[0][0] == 0


# metrics


@pytest.mark.parametrize("sizes, bounds, want", [([200] * 5, (1100, 100), 1.0), ([5] * 3, (1100, 100), 0.0), ([200, 5], (1100, 100), 0.5), ([10] * 3, (15, 5), 1.0)])
def test_size_compliance(spark, sizes, bounds, want):
    assert metrics.size_compliance(chunks(spark, sizes), *bounds).first()["score"] == want


def test_size_compliance_without_chunks(spark):
    assert metrics.size_compliance(chunks(spark, [])).count() == 0


@pytest.mark.parametrize("sizes, pairs, want", [([17, 10], [(0, 4, 17, 19)], 0.0), ([27], [(0, 4, 17, 19)], 1.0), ([0, 17, 10], [(17, 19, 0, 4)], 0.0), ([20, 7], [(0, 4, 17, 19)], 1.0)])
def test_references(spark, sizes, pairs, want):
    frame = spark.createDataFrame([("d", *p) for p in pairs], "doc_name string, entity_start int, entity_end int, pronoun_start int, pronoun_end int")
    assert metrics.references_completeness(chunks(spark, sizes), frame).first()["score"] == want
    assert metrics.references_completeness(chunks(spark, sizes), frame.limit(0)).first()["score"] is None


def test_block_integrity(spark):
    docs = spark.createDataFrame([("d", "x" * 100, [30, 60])], "doc_name string, full_text string, split_points array<int>")
    assert metrics.block_integrity(chunks(spark, [100]), docs).first()["score"] == 1.0
    assert metrics.block_integrity(chunks(spark, [45, 55]), docs).first()["score"] == pytest.approx(2 / 3)
    assert metrics.block_integrity(chunks(spark, [34, 66]), docs).first()["score"] == 1.0
    empty = docs.withColumn("split_points", F.lit(None).cast("array<int>"))
    assert metrics.block_integrity(chunks(spark, [50, 50]), empty).first()["score"] == 0.0


def test_windows():
    size = lambda a, b: b - a
    assert metrics.windows([0, 10, 20, 30], [10, 20, 30, 40], size, 25) == [(0, 1), (1, 2), (2, 3)]
    assert metrics.windows([0, 10, 20], [10, 20, 30], size, 100) == [(0, 2)]
    assert metrics.windows([0, 50], [50, 60], size, 20) == []
    assert metrics.windows([0, 5], [30, 12], size, 30) == [(0, 1)]


def test_embedded_scores_by_brute_force(spark):
    text = "cats purr here. dogs bark there. birds sing now. fish swim deep."
    points = [16, 33, 49]
    docs = spark.createDataFrame([("d", text, points)], "doc_name string, full_text string, split_points array<int>")
    rows = chunks(spark, [33, len(text) - 33])
    got = metrics.embedded_scores(rows, docs, HashingEmbedder).first()
    e = HashingEmbedder()
    spans = [(0, 33), (33, len(text))]
    own = e([text[a:b] for a, b in spans])
    pieces = [e([text[0:16], text[16:33]]) @ own[0], e([text[33:49], text[49:]]) @ own[1]]
    assert got["intrachunk_cohesion"] == pytest.approx(np.clip(np.mean([p.mean() for p in pieces]), 0, 1))
    assert got["document_contextual_coherence"] == pytest.approx(np.clip((own @ e([text])[0]).mean(), 0, 1))
    lone = metrics.embedded_scores(chunks(spark, [len(text)]), docs.withColumn("split_points", F.array().cast("array<int>")), HashingEmbedder).first()
    assert lone["intrachunk_cohesion"] is None and lone["document_contextual_coherence"] is None


def test_all_metrics_resume(spark):
    docs = spark.createDataFrame([("d", "x" * 30, [10])], "doc_name string, full_text string, split_points array<int>")
    rows = chunks(spark, [10, 20])
    out = metrics.all_metrics(rows, docs, HashingEmbedder)
    assert {r["metric_name"] for r in out.collect()} == {"size_compliance", "block_integrity", "intrachunk_cohesion", "document_contextual_coherence", *metrics.STATS}
    assert metrics.all_metrics(rows, docs, HashingEmbedder, done=out).count() == 0
    assert metrics.all_metrics(rows.unionByName(chunks(spark, [30], method="n")), docs, HashingEmbedder, done=out).select("chunking_method").distinct().collect()[0][0] == "n"


# coreference


def test_clusters():
    assert coref.merged([[(0, 1), (5, 6)], [(9, 9)], [(5, 6), (8, 8)]]) == [[(0, 1), (5, 6), (8, 8)], [(9, 9)]]
    assert coref.merged([]) == []
    text = "Ann Ann 12 she"
    assert coref.filtered(text, [[(0, 2), (4, 6)], [(0, 2), (8, 9), (11, 13)]]) == [[(0, 2), (11, 13)]]
    assert coref.char_offsets(["Ann ", "saw ", "her"], [[(0, 0), (2, 5)]], 10) == [[(10, 13), (18, 20)]]


def test_entity_pronoun_pairs():
    text = "Alice went home. She slept. Bob saw her and his dog."
    at = lambda w, n=0: (text.index(w, n), text.index(w, n) + len(w) - 1)
    pairs = coref.entity_pronoun_pairs(text, [[at("Alice"), at("She"), at("her")], [at("Bob"), at("his dog")]])
    assert set(pairs) == {(at("Alice"), at("She")), (at("Alice"), at("her")), (at("Bob"), at("his"))}
    assert coref.entity_pronoun_pairs("it Bob", [[(0, 1), (3, 5)]]) == [((3, 5), (0, 1))]
    nested = coref.entity_pronoun_pairs("the big dog it", [[(0, 10), (8, 10), (12, 13)]])
    assert nested == [((0, 10), (12, 13))]


def test_windows_of_lines():
    text = "".join(f"a b c {i}\n" for i in range(10))
    spans = coref.text_windows(text, 10, 1)
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(b[0] <= a[1] for a, b in zip(spans, spans[1:]))


def test_find_mentions(spark):
    docs = spark.createDataFrame([("d", "Then Alice went home and she slept."), ("e", None), ("f", "")], "doc_name string, full_text string")
    got = {r["doc_name"]: r for r in coref.find_mentions(docs).collect()}
    assert got["d"]["entity_pron_mentions"] == [[[5, 9], [25, 27]]] and got["e"]["mentions"] == [] and got["f"]["mentions"] == []
    assert coref.find_mentions(docs, foreign=lambda t: True).filter(F.size("mentions") > 0).count() == 0


# selection and reports


METRIC = "doc_name string, chunking_method string, metric_name string, score double"


def test_best_method_ties_nulls_and_default(spark):
    rows = [("a", "y", "p", 0.5), ("a", "x", "p", 0.5), ("b", "x", "p", None), ("b", "x", "q", 0.2), ("b", "y", "p", 0.1), ("b", "y", "q", 0.2), ("c", "page", "p", None), ("c", "k", "p", None), ("d", "z", "q", float("nan"))]
    m = spark.createDataFrame(rows, METRIC)
    best = {r["doc_name"]: (r["method"], r["score"]) for r in select.best_methods(m, {"p": 0.5, "q": 0.5}).collect()}
    assert best == {"a": ("x", 0.5), "b": ("x", pytest.approx(0.2))}
    chosen = {r["doc_name"]: r["method"] for r in select.chosen_methods(m, {"p": 0.5, "q": 0.5}).collect()}
    assert chosen == {"a": "x", "b": "x", "c": "page", "d": "z"}
    with pytest.raises(ValueError):
        select.best_methods(m, {})
    with pytest.raises(Exception, match="twice"):
        select.chosen_methods(m.unionByName(m.limit(1)), {"p": 1.0}).collect()


def test_correlations_agree_with_pandas(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.random(60), 1)
    y = np.round(x + rng.random(60), 1)
    rows = [(f"d{i}", "m", n, float(v)) for i in range(60) for n, v in (("x", x[i]), ("y", y[i]))] + [("z", "m", "x", 1.0)]
    got = reports.correlations(spark.createDataFrame(rows, METRIC), ["x", "y"]).first()
    import pandas as pd

    s = pd.DataFrame({"x": x, "y": y})
    assert got["pearson"] == pytest.approx(s.corr().iloc[0, 1]) and got["spearman"] == pytest.approx(s.rank().corr().iloc[0, 1])
    a, b = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
    assert got["kendall"] == pytest.approx((a * b).sum() / math.sqrt((a * a).sum() * (b * b).sum()))


def test_histogram_edges(spark):
    frame = lambda v: spark.createDataFrame([(x,) for x in v], "chunk_len long")
    assert [r["count"] for r in reports.length_histogram(frame([1, 1, 2, 11]), 2).orderBy("bin").collect()] == [3, 1]
    assert sum(r["count"] for r in reports.length_histogram(frame([4, 4]), 3).collect()) == 2
    assert reports.length_histogram(frame([]), 3).count() == 0


def test_answered_rate_of_nothing(spark):
    assert reports.answered_rate(spark.createDataFrame([], "generated_output string"), "no").first()["percent"] is None


# text functions


def test_language_gate():
    assert T.gate(lambda t: [("fr", 0.99)])("x") is True
    assert T.gate(lambda t: [("en", 0.99)])("x") is False
    assert T.gate(lambda t: [("fr", 0.5)])("x") is False
    assert T.gate(lambda t: [])("x") is False
    assert T.gate(lambda t: 1 / 0)("x") is False
    assert T.gate(lambda t: [("de", 0.9)], least=0.85)("x") is True and T.gate(lambda t: [("de", 0.9)], least=0.95)("x") is False


def test_text_columns(spark):
    df = spark.createDataFrame([("finance_report_1", "a  b\tc ", "<b>\n")], "name string, body string, html string")
    got = df.select(T.domain_of(F.col("name")), T.n_words(F.col("body")), T.escaped(F.col("html")), T.stem(F.lit("file:/x/y%20z.v1.json")), prompted(F.col("name"), "query", "find"), prompted(F.col("name"), None)).first()
    assert tuple(got) == ("finance", 3, "&lt;b&gt;<br>", "y z.v1", "Instruct: find\nQuery: finance_report_1", "finance_report_1")


def test_bpe_counter():
    import public_tokenizers as P

    count = T.BpeCounter(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert count("") == 0 and count("hello world") == 2


def test_rest_embedder_retries():
    asked = []

    def post(batch):
        asked.append(len(batch))
        return (429, []) if len(asked) == 1 else (200, [[3.0, 4.0]] * len(batch))

    out = RestEmbedder(post, 2, 2, pause=lambda s: None)(["a", "b", "c"])
    assert asked == [2, 2, 1] and np.allclose(out, [[0.6, 0.8]] * 3)
    assert RestEmbedder(post, 7)([]).shape == (0, 7)
    with pytest.raises(RuntimeError, match="400"):
        RestEmbedder(lambda b: (400, []), pause=lambda s: None)(["a"])
    with pytest.raises(RuntimeError, match="busy"):
        RestEmbedder(lambda b: (503, []), tries=2, pause=lambda s: None)(["a"])


# retrieval and answers


def test_dense_blocks_agree(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.random((40, 6))
    q = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 40, 5)], "query_id long, vector array<double>")
    c = spark.createDataFrame([(i, x[i].tolist()) for i in range(40)], "chunk_id long, vector array<double>").repartition(3)
    one = sorted(map(tuple, retrieval.dense(q, c, 4).collect()))
    assert one == sorted(map(tuple, retrieval.dense_native(q, c, 4).collect()))
    monkeypatch.setattr(retrieval, "QUERIES", 3)
    assert one == sorted(map(tuple, retrieval.dense(q, c, 4).collect()))
    with pytest.raises(ValueError):
        retrieval.dense_native(q, c, 4)


def test_retrieval_records_keep_unanswered_queries(spark):
    c = spark.createDataFrame([(1, "red fox", "d", "page", [1])], "chunk_id long, text string, doc_name string, method string, chunk_pages array<int>")
    q = spark.createDataFrame([(1, "fox", "a", None), (2, "whale", None, None), (3, None, None, None)], "query_id long, text string, reference_answer string, reference_answer_doc_name string")
    got = {r["query_id"]: r for r in retrieval.records(retrieval.bm25(q.select("query_id", "text").na.drop(), c.select("chunk_id", "text")), q, c).collect()}
    assert set(got) == {1, 2} and got[1]["results"][0]["content"] == "red fox" and got[2]["results"] == []


def test_answers_and_judging(spark):
    c = spark.createDataFrame([(1, "red fox", "d", "page", [1])], "chunk_id long, text string, doc_name string, method string, chunk_pages array<int>")
    q = spark.createDataFrame([(1, "fox", "red", None), (2, "fox no", "red", None), (3, "fox x", None, None), (4, "fox bad", "red", None)], "query_id long, text string, reference_answer string, reference_answer_doc_name string")
    records = retrieval.records(retrieval.bm25(q.select("query_id", "text"), c.select("chunk_id", "text")), q, c)
    done = rag.generate(records, lambda: lambda p: rag.REFUSAL if "no" in p else "it is red")

    def judge(name, prompt):
        if "bad" in prompt:
            raise RuntimeError("down")
        return '{"level": 5, "score": 0.7, "reason": "ok"}'

    got = {r["query_id"]: [(m["name"], m["score"]) for m in r["metrics"]] for r in rag.evaluate(done, lambda: judge).collect()}
    assert got == {1: [(rag.COMPLETENESS, 1.0), (rag.CORRECTNESS, 0.7)], 2: [(rag.COMPLETENESS, 1.0)], 3: [(rag.COMPLETENESS, 0.0)], 4: [(rag.COMPLETENESS, 0.0), (rag.CORRECTNESS, None)]}
    assert rag.evaluate(done, lambda: judge, done=done.filter("query_id < 4")).count() == 1
    free = {r["query_id"]: [m["score"] for m in r["metrics"]] for r in rag.evaluate(done, lambda: judge, reference_free=True).collect()}
    assert free[2] == [None] * 3 and free[1] == [0.7, 1.0, 0.7]


def test_questions_and_summaries(spark):
    docs = spark.createDataFrame([("a", "one\ntwo\n"), ("b", "three")], "doc_name string, full_text string")
    reply = '[{"question": "q1", "answer": "a1"}, {"question": "q2", "answer": "a2"}]'
    got = rag.qa_pairs(docs, lambda: lambda p: reply if "one" in p else "no").orderBy("id").collect()
    assert [(r["id"], r["doc_name"], r["question"]) for r in got] == [(1, "a", "q1"), (2, "a", "q2")]
    assert rag.summaries(docs, lambda: lambda p: str(len(p))).count() == 2
    queries = spark.createDataFrame([(i, f"q{i}") for i in range(7)], "query_id long, query_text string")
    judged = rag.relevant_queries(queries, "sums", lambda: lambda p: '[{"query_id": 1, "relevant": true, "justification": "j"}]' if "1: q1" in p else "[]")
    assert [tuple(r) for r in judged.select("query_id", "relevant", "query_text").collect()] == [(1, True, "q1")]


# plans


def test_adaptive_keeps_stages(spark, tmp_path):
    docs = spark.createDataFrame([("d", [(1, "Alpha beta. Gamma delta.\n" * 40)], "Alpha beta. Gamma delta.\n" * 40, [25], [])], "doc_name string, pages array<struct<page:int,text:string>>, full_text string, split_points array<int>, titles array<struct<title:string,start:int,end:int,level:int>>")
    methods = {"page": None, "small": RecursiveSplitter(30)}
    found, scores, best = pipeline.adaptive(docs, methods, folder=str(tmp_path))
    assert best.count() == 1 and {r[0] for r in found.select("method").distinct().collect()} == {"page", "small"}
    assert conform(found.withColumn("type", F.lit("raw")), CHUNK).count() == found.count()
    with pytest.raises(ValueError, match="missing"):
        conform(found.drop("chunk_text"), CHUNK)
    assert pipeline.split_documents(docs, methods, foreign=lambda t: True).count() == 0


# odd and many inputs


def odd_documents(spark, tmp_path, texts):
    folder = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return folder


def same_as_sql(spark, folder, name):
    import duckdb

    from chunkloom.plans import catalog

    from . import compare

    def connection(_):
        con = duckdb.connect()
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
        return con

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(compare, "connection", connection)
        return compare.differences(spark, folder, catalog.QUERIES[name], catalog.ORACLES[name])


def test_page_chunks_of_empty_and_null_texts(spark, tmp_path):
    folder = odd_documents(spark, tmp_path, ["", None, "a b", "\n"])
    assert same_as_sql(spark, folder, "page_chunks") == ""


def test_regex_chunks_keep_empty_pieces(spark, tmp_path):
    folder = odd_documents(spark, tmp_path, ["", None, ". a", "a. ", ". ", ". . b", "a. b"])
    assert same_as_sql(spark, folder, "regex_chunks") == ""


def test_native_vector_search_takes_any_number_of_queries(spark, sf_dir, monkeypatch):
    from chunkloom.plans import catalog

    from .compare import differences

    monkeypatch.setattr(retrieval, "QUERIES", 11)
    assert differences(spark, sf_dir, catalog.QUERIES["vector_topk_native"], catalog.ORACLES["vector_topk_native"]) == ""


def test_dense_search_holds_a_tile_of_scores():
    import tracemalloc

    rng = np.random.default_rng(0)
    q, x = rng.random((2000, 16)), rng.random((10_000, 16))
    tracemalloc.start()
    best = retrieval._Best(len(q), 3)
    best.add(np.arange(len(x)), q, x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # all scores at once would be 160 MB
    assert peak < 80 << 20
    want = np.argsort(-np.round(q[:50] @ x.T, 9), axis=1, kind="stable")[:, :3]
    assert best.ids[:50].tolist() == want.tolist()


def test_best_candidates_with_many_ties(monkeypatch):
    monkeypatch.setattr(retrieval, "TILE", 3)
    monkeypatch.setattr(retrieval, "ROWS", 7)
    rng = np.random.default_rng(1)
    for kind in (int, str):
        q, x = rng.integers(-1, 2, (8, 3)).astype(float), rng.integers(-1, 2, (90, 3)).astype(float)
        ids = rng.permutation(90) if kind is int else np.array([f"c{i}" for i in rng.permutation(90)], object)
        best = retrieval._Best(8, 5)
        for a in range(0, 90, 40):
            best.add(ids[a : a + 40], q, x[a : a + 40])
        for i in range(8):
            assert [*zip((-best.scores[i]).tolist(), best.ids[i].tolist())] == sorted(zip((-(x @ q[i])).tolist(), ids.tolist()))[:5]


def exchanges(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().sparkPlan().toString()


def test_bm25_blocks_odd_texts_and_plan(spark, sf_dir, monkeypatch):
    from chunkloom.plans import catalog

    from .compare import differences

    texts = [None, "", "the Fox", "fox fox_1 the", "the the the", "fox, whale!"]
    c = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string").repartition(3)
    q = spark.createDataFrame([(1, "the fox the"), (2, None), (3, "whale"), (4, "")], "query_id long, text string")
    words = [[w for w in (t or "").lower().replace(",", " ").replace("!", " ").split()] for t in texts]
    mean, want = sum(map(len, words)) / 5, {}
    for i, some in ((1, ["the", "fox", "the"]), (3, ["whale"])):
        for j, own in enumerate(words):
            if set(some) & set(own):
                df = {t: sum(t in o for o in words) for t in some}
                part = lambda t: math.log(1 + (6 - df[t] + 0.5) / (df[t] + 0.5)) * own.count(t) * 2.5 / (own.count(t) + 1.5 * (0.25 + 0.75 * len(own) / mean))  # noqa: E731, B023
                want[i, j] = sum(part(t) for t in some)
    got = retrieval.bm25(q, c, 9)
    assert {(r["query_id"], r["chunk_id"]): r["score"] for r in got.collect()} == pytest.approx(want, abs=1e-8)
    # neither words nor scores of all chunks are joined or grouped: a window over few candidates is all that follows the scan
    assert not any(x in exchanges(got)[1] for x in ("Join", "Aggregate", "Generate"))
    monkeypatch.setattr(retrieval, "QUERIES", 7)
    assert differences(spark, sf_dir, catalog.QUERIES["bm25_topk"], catalog.ORACLES["bm25_topk"]) == ""


@pytest.mark.parametrize("name", ["rerank_topk", "retrieval_records", "judged_answers"])
def test_candidates_go_to_the_texts(spark, sf_dir, name):
    from chunkloom.plans import catalog

    with_hint = exchanges(catalog.QUERIES[name](spark, sf_dir))[0]
    assert "rightHint=(strategy=broadcast)" in with_hint and "Generate" not in with_hint


def test_dense_part_of_hybrid_carries_no_texts(spark, sf_dir):
    from chunkloom.plans import catalog

    plan = exchanges(catalog.QUERIES["hybrid_retrieval"](spark, sf_dir))[0]
    assert "struct(chunk_id, chunk_id#" in plan and "Generate" not in plan


@pytest.mark.parametrize("name, most", [("best_method", 2), ("pivot_scores", 2), ("metametrics", 3), ("best_chunks", 3), ("published_table", 4), ("references_completeness", 3), ("missing_references", 3), ("adaptive_best_method", 4)])
def test_texts_are_split_once_for_all_scores(spark, sf_dir, name, most):
    from chunkloom.plans import catalog

    plan = exchanges(catalog.QUERIES[name](spark, sf_dir))[0]
    assert plan.count("MapInArrow") <= most
    assert "posexplode" not in plan, "words or blocks, a row each"


def test_python_holds_few_texts_at_once():
    import pyarrow as pa

    from chunkloom.functions.batches import BYTES, ROWS, pieces

    texts = ["x" * n for n in (1 << 20, 3 << 20, 9 << 20, 1, 2 << 20, 2 << 20, 5)] + ["y"] * (ROWS + 3)
    part = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["i", "t"])
    found = [p.column(1).to_pylist() for p in pieces(iter([part.slice(0, 4), part.slice(4)]), [1])]
    assert [t for p in found for t in p] == texts
    assert all(len(p) == 1 or (len(p) <= ROWS and sum(map(len, p)) <= BYTES) for p in found)


def test_lexical_dissimilarity_shuffles_no_terms(spark, sf_dir):
    from chunkloom.plans import catalog

    plan = exchanges(catalog.QUERIES["lexical_dissimilarity"](spark, sf_dir))[0]
    assert not any(x in plan for x in ("Join", "Window", "Aggregate", "explode"))
    texts = ["red fox runs", "", "the fox runs on", "blue whale", "red red whale sings"]
    rows = [("d", 2 * i, len(t) * 10 + 60, t) for i, t in enumerate(texts)] + [("e", 0, 7, "one")]
    df = spark.createDataFrame(rows, "doc string, chunk_index long, chunk_len long, chunk_text string")
    got = {r["doc"]: r["score"] for r in metrics.lexical_dissimilarity(df, ["doc"]).collect()}
    tf = metrics.tfidf(df, ["doc"]).filter("doc = 'd'").collect()
    vectors = {}
    for r in tf:
        vectors.setdefault(r["chunk_index"], {})[r["term"]] = r["w"]
    pairs = [(a, b) for a in rows[:5] for b in rows[:5] if 0 < b[1] - a[1] <= 5]
    like = sum(a[2] * b[2] * sum(x * vectors.get(b[1], {}).get(t, 0) for t, x in vectors.get(a[1], {}).items()) for a, b in pairs) / sum(a[2] * b[2] for a, b in pairs)
    few = sum(r[2] < 100 for r in rows[:5]) / 5
    assert got["e"] is None and got["d"] == pytest.approx(min(1, max(0, 1 - like - few)), abs=1e-9)


def test_missing_references_read_ends_alone(spark, sf_dir):
    from chunkloom.plans import catalog

    plan = exchanges(catalog.QUERIES["missing_references"](spark, sf_dir))[0]
    assert "cluster" not in plan and "Window" not in plan
    docs = spark.createDataFrame([("d", "Ann saw Bob. She met ann\nAnn  and it")], "doc_name string, full_text string")
    got = coref.lexicon(docs).first()
    assert [tuple(p) for p in got["pairs"]] == [(8, 11, 13, 15), (25, 27, 34, 35)]
    assert (got["low"], got["high"], got["mentions"]) == ([0], [27], 4)
