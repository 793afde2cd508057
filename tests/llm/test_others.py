"""Vectors, pages, urls, the registry and the pipeline."""

from __future__ import annotations

import base64
import hashlib
import math

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from chunkloom.llm import html, registry, urls, vectors
from chunkloom.llm.components import components as distributed

from ..compare import differences
from .conftest import components, prose
from .test_documents import WORD, alike, plain_dedup, sets_of


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    got = {r["node"]: r["root"] for r in distributed(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}
    assert distributed(spark.createDataFrame([], "a long, b long")).count() == 0


# 4


def vector_rows():
    rng = np.random.default_rng(1)
    base = rng.normal(size=(6, 16))
    rows = []
    for i in range(160):
        x = base[i % 6] + rng.normal(size=16) * (0.03 if i % 2 else 0.3)
        rows.append((i, (x / np.linalg.norm(x) * (1 + i % 3)).tolist(), i % 4 if i % 9 else None))
    copy = rows[1][1]
    rows += [(200 + i, copy, 1) for i in range(6)]
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [math.nan] * 16, 1), (303, [1.0, None] * 8, 1), (304, [math.inf] + [0.0] * 15, 1), (305, [1.0, 0.0], 1), (306, [2.0, 0.0], 1), (307, [], 1), (1, copy, 1), (None, copy, 1)]
    return rows


def test_vectors_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "LIST", 20)
    rows = vector_rows()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit(1)).repartition(3)

    def good(v):
        return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def linked(i, j):
        (_, a, la), (_, b, lb) = rows[i], rows[j]
        return la is not None and la == lb and good(a) and good(b) and len(a) == len(b) and np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.98

    root = components(len(rows), linked)
    want = []
    for i, (key, _, _) in enumerate(rows):
        least = min((rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None), default=None)
        want.append((key, sum(bool(linked(i, j)) for j in range(len(rows)) if j != i), least, key == least))
    got = [tuple(r) for r in vectors.near_duplicates(frame).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert vectors.near_duplicates(frame.limit(0)).count() == 0


def test_vectors_of_many_lengths(spark, monkeypatch):
    monkeypatch.setattr(vectors, "LENGTHS", 3)
    rows = [(100 * n + i, [float(1 + (k * (i // 2 + 1)) % 7) * 10.0 ** (n % 5 * 60 - 120) for k in range(n)], 0) for n in range(1, 9) for i in range(6)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    scaled = [np.array(x) / max(x) for _, x, _ in rows]
    near = lambda i, j: len(scaled[i]) == len(scaled[j]) and scaled[i] @ scaled[j] / np.linalg.norm(scaled[i]) / np.linalg.norm(scaled[j]) >= 0.98
    root = components(len(rows), near)
    assert got == {rows[i][0]: (sum(bool(near(i, j)) for j in range(len(rows)) if j != i), rows[root[i]][0]) for i in range(len(rows))}


# 7


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body>
<nav><a href=/>Home</a><a href=/b>Blog</a></nav><div class="cookie-banner">We use cookies to make this site work for you and many others.</div>
<article><h1>The &eacute;t&eacute; &#8211; a story</h1><p>First   paragraph has\n quite some words, and a <a href=x>link to more</a> in it.</p><div class="ad-slot">Buy now and save a lot of money today</div>
<p>Second one<br>is here<script>var x = "<p>no</p>";</script> as well, with words.</p></article><aside>Related things to read</aside>
<section id="comments"><p>A reader says many things about this long story here.</p></section><form><label>Mail</label><input></form><footer>Copyright</footer></body></html>"""


def test_html_main_text():
    assert html.main_text(PAGE) == "The été – a story\n\nFirst paragraph has quite some words, and a link to more in it.\n\nSecond one is here as well, with words."


def test_html_edges(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "u", ""), (3, "u", "plain words without any markup at all, but enough of them to be a text"), (4, "u", "<p>unclosed <b>bold <p>next" + " word" * 50_000), (5, "u", "<<<>>> <!-- <p>x"), (6, "u", "<a" * 2000)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars long")
    got = html.extract(frame).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert [r["text"] for r in got if r["page_id"] in (None, 2)] == ["", ""] and next(r for r in got if r["page_id"] == 4)["n_chars"] > 200_000
    assert html.extract(frame.limit(0)).count() == 0


# 9


def plain_judge(url, rules):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, tail = rest[:cut], rest[cut:]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits) if fits else None
    return host, path, best[1] if best else None, best[2] if best else "allow"


def test_urls_by_brute_force(spark, monkeypatch):
    rules = [*registry.URL_RULES, ("a.b.example.com", "/x", "block"), ("b.example.com", "/", "block"), ("org", "/", "block"), ("good.org", "/", "allow"), ("good.org", "/bad/", "block"), ("ample.com", "/", "block")]
    seen = ["http://EXAMPLE.com/en/x?q#f", "https://www.example.com/en/", "http://a.b.example.com/xyz", "http://b.example.com", "http://b.example.com/", "x", None, "", "://", "ftp://good.org/bad/1", "http://good.org/ok", "http://very.good.org/bad/", "http://sample.com/", "http://net/es/1", "http://x.net/fr/", "http://x.net/de/", "http://org?x/", "a://b://c/d", "http://com/", "http://example.com/\nen/", "http://ÄB.com/é", "http://com\x01example/en/", "http://com\x02/x", "http://a\x00com/en/", "http://\x03.net/es/1", "http://org/\x00com\x01/"]
    frame = spark.createDataFrame([(i, u, "r") for i, u in enumerate(seen * 2)] + [(None, "http://com/", "r")], "page_id long, url string, rule string").repartition(3)
    got = sorted((tuple(r) for r in urls.judge(frame, urls.rule_table(spark, rules)).collect()), key=repr)
    want = sorted(((r["page_id"], *plain_judge(r["url"], rules)) for r in frame.collect()), key=repr)
    assert got == want
    assert urls.judge(frame.limit(0), urls.rule_table(spark, rules)).count() == 0
    monkeypatch.setattr(urls, "LENGTHS", 2)
    assert sorted((tuple(r) for r in urls.judge(frame, urls.rule_table(spark, rules)).collect()), key=repr) == want
    assert urls.judge(frame, urls.rule_table(spark, rules).limit(0)).filter("rule is not null or verdict <> 'allow'").count() == 0


# registry and pipeline


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert differences(spark, sf_dir, registry.QUERIES[name], registry.ORACLES[name]) == ""


def test_all_are_registered():
    names = set(entry.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)} and "pipeline" in names


def test_pipeline_stages(spark):
    passage = prose(50, 60)
    texts = {1: prose(1, 200), 2: prose(1, 200), 3: prose(2, 120) + " " + passage, 4: passage + " " + prose(3, 120), 5: "LOUD!! NOISE!! HERE!! " * 30, 6: prose(4, 90)}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()] + [(100 + i, prose(100 + i, 60), "en", "s", 1) for i in range(60)], "doc_id long, text string, lang string, source string, n_chars long")
    keep = {"quality": None}
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, "")
        keep[name] = docs = docs.cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    assert 5 not in ids(keep["quality"]) and len(ids(keep["quality"])) == 65
    assert ids(keep["quality"]) - ids(keep["near copies"]) == {2}
    left = {r["doc_id"]: r for r in keep["repeated passages"].collect()}
    assert passage not in left[3]["text"] and passage not in left[4]["text"] and left[1]["text"] == texts[1] and all(r["n_chars"] == len(r["text"]) for r in left.values())
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, "")
    assert ids(mixed) <= ids(docs) and mixed.count() == len(ids(mixed))
    out = corpus_pipeline.STAGES[4][1](spark, docs, "")
    assert out.filter("n_tokens <> size(ids)").count() == 0 and out.count() == docs.count()


def test_pipeline_by_brute_force(spark, sf_dir):
    """Each stage on what the one before it kept of the table."""
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda df: sorted((r.asDict() for r in df.collect()), key=lambda r: r["doc_id"])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id is not null").dropDuplicates(["doc_id"])
    good = stages["quality"](spark, docs, sf_dir).cache()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in rows(good)}
    assert all(labels[r["doc_id"]] == (r["doc_id"] in kept) for r in rows(docs) if r["doc_id"] in labels and len((r["text"] or "").split()) >= 12)
    before = rows(good)
    sets = sets_of([r["text"] or "" for r in before])
    root = components(len(before), lambda i, j: alike(sets[i], sets[j]))
    first = stages["near copies"](spark, good, sf_dir).cache()
    assert rows(first) == [before[i] for i in sorted(set(root))]
    before = rows(first)
    left = rows(stages["repeated passages"](spark, first, sf_dir))
    digests = [hashlib.sha256(" ".join(WORD.findall(r["text"] or "")).encode()).hexdigest() for r in left]
    assert [r["doc_id"] for r in left] == [r["doc_id"] for r in before] and digests == [x for _, _, x in plain_dedup([r["text"] for r in before], 35)]
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert [r["ids"] for r in rows(stages["tokens"](spark, first, sf_dir))] == [library.encode_ordinary(r["text"] or "") for r in before]


def test_pipeline_on_odd_rows(spark, odd_docs, no_docs, tmp_path):
    odd_docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert 0 < out.count() <= odd_docs.count()
    no_docs.write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
