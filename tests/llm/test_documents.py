"""Operators on documents, held against brute force."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chunkloom.llm import bpe, langid, likeness, mixing, quality, registry, simhash, sketch, substrings
from chunkloom.llm.common import Sets, word_codes, word_spans

from .conftest import components, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# 1


def plain_fingerprint(text: str | None, size: int = 4) -> int:
    words = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def test_simhash_by_brute_force(odd_docs, no_docs):
    rows = [r for r in odd_docs.select("doc_id", "text").collect()]
    prints = [plain_fingerprint(r["text"]) for r in rows]
    root = components(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    least = {k: min((rows[i]["doc_id"] for i in range(len(rows)) if root[i] == k and rows[i]["doc_id"] is not None), default=None) for k in root}
    want = sorted(((r["doc_id"], f"{p:016x}", least[k]) for r, p, k in zip(rows, prints, root)), key=repr)
    got = sorted((tuple(r) for r in simhash.near_duplicates(odd_docs).select("doc_id", "fingerprint", "component_id").collect()), key=repr)
    assert got == want
    assert simhash.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("shares", [1, 7])
def test_links_of_dense_and_random_fingerprints(spark, shares):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 12, dtype=np.uint64)
    prints = {int(b) for b in rng.integers(0, 2**64, 150, dtype=np.uint64)}
    for b in base[:3].tolist():
        for _ in range(120):
            x = b
            for _ in range(int(rng.integers(0, 6))):
                x ^= 1 << int(rng.integers(0, 64))
            prints.add(x)
    prints = sorted(prints)
    frame = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "print long").repartition(shares)
    edges = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.links(frame).collect()]
    place = {p: i for i, p in enumerate(prints)}
    joined = {(place[a], place[b]) for a, b in edges} | {(place[b], place[a]) for a, b in edges}
    want = components(len(prints), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    assert components(len(prints), lambda i, j: (i, j) in joined) == want


def test_one_of_each_group_of_near_copies_stays(spark, odd_docs, no_docs):
    base = prose(11, 300).split()
    changed = [*base]
    changed[150] = "replaced"
    docs = spark.createDataFrame([(5, " ".join(base)), (3, " ".join(changed)), (4, " ".join(base)), (9, prose(12, 300)), (8, None), (7, "")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.first_of_groups(docs).collect()) == [3, 7, 9]
    kept = simhash.first_of_groups(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((str(r["doc_id"]) for r in kept.collect())) == sorted(["1", "3", "3", "4", "None", "7", "9", "10", "11", "12", "13"])
    assert simhash.first_of_groups(no_docs).count() == 0


def sets_of(texts: list[str]) -> list[set[str]]:
    words = [WORD.findall(t.lower()) for t in texts]
    return [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]


def alike(a: set, b: set) -> bool:
    return 5 * len(a & b) >= 4 * len(a | b) if a and b else a == b


@pytest.fixture(scope="module")
def edited():
    """Texts of 60 words with up to six changed in a row or scattered, so that likenesses lie on both sides of 0.8; one of many copies."""
    rng = np.random.default_rng(8)
    texts = []
    for k in range(60):
        base = [f"w{x}" for x in rng.integers(0, 5_000, 60)]
        for c in range(90 if k == 0 else 4):
            words = [*base]
            for at in rng.integers(0, 60, 1 + c % 2):
                words[at] = f"x{rng.integers(0, 10**9)}"
            if c % 3 == 0:
                words[: int(rng.integers(0, 12))] = []
            texts.append(" ".join(words))
    return texts


def test_all_pairs_of_alike_sets_are_joined(spark, edited):
    docs = spark.createDataFrame(list(enumerate(edited)), "doc_id long, text string").repartition(3)
    sets = sets_of(edited)
    want = components(len(edited), lambda i, j: alike(sets[i], sets[j]))
    assert sorted(r["doc_id"] for r in simhash.first_of_groups(docs).collect()) == sorted(set(want))


@pytest.mark.parametrize("forests", [0, 1, 2])
def test_a_large_group_of_several_components(spark, monkeypatch, forests):
    """Texts of one base, one word changed in each: alike if the places are the same or next to each other, and no change is at every seventh place."""
    monkeypatch.setattr(likeness, "FORESTS", forests)
    rng = np.random.default_rng(11)
    base = [f"w{x}" for x in range(60)]
    places = [int(p) for p in rng.integers(4, 56, 300) if p % 7]
    texts = [" ".join([*base[:p], f"x{k}", *base[p + 1 :]]) for k, p in enumerate(places)]
    sets = sets_of(texts)
    want = components(len(texts), lambda i, j: alike(sets[i], sets[j]))
    assert len(set(want)) > 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in simhash.first_of_groups(docs).collect()) == sorted(set(want))


def test_spanning_pairs_join_what_all_pairs_join():
    rng = np.random.default_rng(4)
    for n, m in ((1, 0), (5, 3), (40, 30), (200, 900)):
        x, y = rng.integers(0, n, m), rng.integers(0, n, m)
        every, some = Sets(n), Sets(n)
        every.join(x, y)
        taken = likeness.spanning(Sets(n), x, y)
        some.join(x[taken], y[taken])
        assert some.roots().tolist() == every.roots().tolist()
        assert len(taken) == n - len(set(every.roots().tolist()))


@pytest.mark.parametrize("sizes", [(900, 1000, 850), (1000, 1100, 900), (3900, 4400, 3800), (20_000, 21_000, 19_000), (0, 0, 0)])
def test_parities_never_exceed_the_difference(sizes):
    rng = np.random.default_rng(sum(sizes))
    n, m, both = sizes
    pool = np.unique(rng.integers(0, 2**63, n + m, dtype=np.uint64))
    a, b = pool[:n], np.concatenate([pool[:both], pool[n : n + m - both]])
    assert likeness.differing(likeness.parity(a), likeness.parity(b)) <= len(np.setxor1d(a, b))
    assert likeness.differing(likeness.parity(a), likeness.parity(a)) == 0


def test_pairs_at_the_limit_of_likeness(spark):
    """Sets of 36 and 45 shingles that share 36 are alike by 0.8; of 35 and 45 they aren't, whatever their fingerprints say."""
    rows = []
    for k in range(100):
        words = [f"k{k}w{i}" for i in range(49)]
        rows += [(4 * k, " ".join(words)), (4 * k + 1, " ".join(words[:40])), (4 * k + 2, " ".join(w + "z" for w in words)), (4 * k + 3, " ".join(w + "z" for w in words[:39]))]
    left = {r["doc_id"] for r in simhash.first_of_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left == {4 * k + j for k in range(100) for j in (0, 2, 3)}


# 2


@pytest.fixture(scope="module")
def library():
    import base64

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.vocabulary(P.path("byte_bpe_50k.tiktoken"), P.PATTERN))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab'stre \n\t\u00a0\u2003\u001c\u0085é你🎉09.,!<|>"), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_encoding_equals_the_library(library, encoder, text):
    ids = encoder(text)
    assert ids.tolist() == library.encode_ordinary(text)
    assert encoder.decode(ids) == text.encode()


def test_long_words_and_special_strings(library, encoder):
    for text in ("a" * 5000, "<|endoftext|>", "it's  they'll\n\n x", "no" * 2000 + " " + "é" * 999):
        assert encoder(text).tolist() == library.encode_ordinary(text)


def test_short_words_are_merged_together(encoder, library, monkeypatch):
    """Bytes of all values and few letters, up to the bound; the heap gives the same and is left for longer words."""
    rng, words = np.random.default_rng(4), encoder.words
    few = [bytes(rng.choice(list(letters), n).tolist()) for n in range(1, bpe.SHORT + 9) for letters in (b"theanorsti", b"aa", b"\0 \xc3\xa9", bytes(range(256))) for _ in range(20)]
    want = [words.merged(w) for w in few]
    heap, asked = words.merged, []
    monkeypatch.setattr(words, "merged", lambda w: asked.append(w) or heap(w))
    monkeypatch.setattr(bpe, "AT_ONCE", 300)
    assert words.merged_all(few) == want and {len(w) for w in asked} == set(range(bpe.SHORT + 1, bpe.SHORT + 9))
    asked.clear()
    texts = [prose(k, 40).replace("e", "xq") + " zqxjk" * k for k in range(60)] + ["", "\n"]
    assert [x.tolist() for x in encoder.each(texts)] == [library.encode_ordinary(t) for t in texts] and not asked


def test_texts_taken_together_are_told_apart(encoder, library, monkeypatch):
    monkeypatch.setattr(bpe, "AHEAD", 500)
    monkeypatch.setattr(bpe, "REMEMBERED", 900)
    texts = [prose(k, 1 + k * k % 90) * (k % 3) + "qzvx" * (k % 5) for k in range(80)]
    assert [x.tolist() for x in encoder.each(iter(texts))] == [library.encode_ordinary(t) for t in texts]
    assert list(encoder.each([])) == []


def test_merges_where_bytes_lack_tokens():
    words = bpe.Vocabulary({b"a": 7, b"b": 3, b"ab": 5, b"abab": 1, b"ba": 9}, "")
    some = [b"abab", b"baab", b"ababa", b"bb", b"a"]
    assert words.merged_all(some) == [words.merged(w) for w in some] == [[1], [9, 5], [1, 7], [3, 3], [7]]
    every = bpe.Vocabulary({bytes([b]): 1000 - b for b in range(256)} | {b"ab": 5, b"abab": 1, b"ba": 9, b"aba": 2000}, "")
    assert every.merged_all(some) == [every.merged(w) for w in some]


def test_perfect_hash_is_minimal():
    keys = [f"k{i}".encode() for i in range(3000)]
    table = bpe.PerfectHash(keys)
    assert sorted(table.find(keys).tolist()) == list(range(3000)) and (table.find([b"x", b"k3000", b""]) == -1).all()
    assert bpe.PerfectHash([]).find([b"a"]).tolist() == [-1]


def test_encode_frame(odd_docs, no_docs, library):
    got = sorted((tuple(r) for r in bpe.encode(odd_docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, with_ids=True, with_decoded=True).collect()), key=repr)
    want = []
    for r in odd_docs.collect():
        ids = library.encode_ordinary(r["text"] or "")
        raw = (r["text"] or "").encode()
        want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest(), ids, bytearray(raw)))
    assert got == sorted(want, key=repr)
    assert bpe.encode(no_docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


# 3


def plain_dedup(texts: list[str | None], window: int) -> list[tuple[int, int, str]]:
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("window", [2, 5, 35])
def test_substrings_by_brute_force(odd_docs, no_docs, window):
    rows = odd_docs.select("doc_id", "text").collect()
    want = sorted(((r["doc_id"], *x) for r, x in zip(rows, plain_dedup([r["text"] for r in rows], window))), key=repr)
    got = sorted((tuple(r) for r in substrings.dedup(odd_docs, window).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr)
    assert got == want
    assert substrings.dedup(no_docs, window).count() == 0


@pytest.mark.parametrize("group", [2_048, 3])
def test_substrings_of_common_prefixes(spark, monkeypatch, group):
    monkeypatch.setattr(substrings, "GROUP", group)
    loop = " ".join(["round and round"] * 60)
    texts = [loop, prose(1, 60) + " " + loop, "x " * 200, *[prose(2, 80)] * 12, *[f"{prose(3, 60)} n{i}" for i in range(12)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = [tuple(r) for r in substrings.dedup(docs, 35).orderBy("doc_id").select("n_words", "n_removed", "kept_sha256").collect()]
    assert got == plain_dedup(texts, 35)


def test_substrings_replace_keeps_columns_and_white_space(odd_docs):
    out = substrings.dedup(odd_docs, 35, replace=True)
    assert out.columns == odd_docs.columns
    rows = {r["doc_id"]: r["text"] for r in out.filter("doc_id in (4, 5, 6, 7, 9, 10)").collect()}
    assert rows[4] is None and rows[5] == "" and rows[6] == "  \n\t " and rows[7] == "One"
    assert rows[10] == prose(6, 30) + "\n"


def test_copies_cost_no_more_than_other_texts(spark):
    """Thousands of equal rows: one result for all, and no row of Spark's that grows with their number."""
    text = prose(5, 120)
    docs = spark.createDataFrame([(7, text)] * 5_000 + [(8, prose(6, 40) + " " + text[: len(text) // 2])], "doc_id long, text string").repartition(4)
    got = Counter(tuple(r) for r in substrings.dedup(docs).select("doc_id", "n_words", "n_removed").collect())
    (n, gone, _), (other, cut, _) = plain_dedup([text, prose(6, 40) + " " + text[: len(text) // 2], text], 35)[:2]
    assert got == {(7, n, gone): 5_000, (8, other, cut): 1} and n == gone and cut > 35


def test_a_group_beyond_memory_goes_on_by_windows(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BATCH_WORDS", 300)
    shared = prose(3, 30)
    texts = [f"{prose(100 + i % 5, 20)} {shared} {prose(200 + i % 7, 20)}" for i in range(60)] + [prose(400 + i, 60) for i in range(20)]
    rows = [(0, 0, i, i, 0, t.encode(), 0) for i, t in enumerate(texts)]
    frame = spark.createDataFrame([(*r[:5], bytearray(r[5]), 0) for r in rows], "g1 long, g2 long, dk long, d2 long, start int, words binary, count int").coalesce(1)
    spans: dict = {}
    for r in substrings._spans(frame, 35).collect():
        spans.setdefault(r["dk"], set()).update(range(r["start"], r["stop"]))
    want = [n for _, n, _ in plain_dedup(texts, 35)]
    assert [len(spans.get(i, ())) for i in range(len(texts))] == want and sum(map(bool, want)) > 20


@given(st.lists(st.integers(0, 6), min_size=1, max_size=60), st.integers(1, 30))
def test_leftmost_by_brute_force(values, size):
    hashes = np.array(values, np.uint64) << np.uint64(40)
    want = [i + values[i : i + size].index(min(values[i : i + size])) for i in range(len(values) - size + 1)]
    assert substrings.leftmost(hashes, size).tolist() == want if len(values) >= size else True


@given(st.text(alphabet="ab\t \n\x0b\x1c\u00a0é", max_size=60))
def test_word_codes_by_brute_force(text):
    raw = text.encode()
    words = [w.encode() for w in WORD.findall(text)]
    codes = word_codes(raw)
    assert [raw[a:b] for a, b in zip(*word_spans(raw))] == words and len(codes) == len(words)
    assert codes.tolist() == [int(word_codes(w)[0]) for w in words] and len(set(codes.tolist())) == len(set(words))


# 5


def test_language_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = langid.with_held_out(docs).join(docs.select("doc_id", "lang"), "doc_id")
    held = found.filter("held_out")
    assert held.count() > 20 and held.filter("lang_pred = lang").count() >= 0.97 * held.count()
    assert found.filter("score < 0 or score > 1").count() == 0


def test_language_edges(odd_docs, no_docs):
    got = langid.with_held_out(odd_docs).collect()
    assert len(got) == odd_docs.count() and {r["lang_pred"] for r in got} == {"en", "und"}
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["doc_id"] in (4, 5, 6))
    assert langid.with_held_out(no_docs).count() == 0
    unlabelled = langid.with_held_out(odd_docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in unlabelled.collect()} == {"und"}


def test_kneser_ney_sums_to_one():
    words = Counter("banana bandana cabana anna nab".split())
    grams = Counter()
    for w, n in words.items():
        w = f"{langid.OPEN * 3}{w}{langid.CLOSE}"
        for i in range(len(w) - 3):
            grams[w[i : i + 4]] += n
    letters = sorted({g[-1] for g in grams})
    models = langid.Ensemble([langid.KneserNey(dict(grams), len(letters))])
    for context in ("\x02\x02\x02", "\x02ba", "ana", "xyz", "bna"):
        text = np.frombuffer("".join(context + c for c in letters).encode("utf-32-le"), np.uint32).astype(np.uint64)
        at = np.arange(3, len(text), 4)
        every = [langid.hashes(text, k) for k in range(1, 5)]
        p = np.exp(models.logs([h[at] for h in every], [h[at - 1] for h in every[:-1]]).astype(float)).sum()
        assert 1 - 1 / (len(letters) + 1) - 1e-5 <= p <= 1 + 1e-5, context


def plain_kneser_ney(words: list[str], alphabet: int):
    """log P of a character after a context, by the textbook: discount D = n1 / (n1 + 2 n2) of each order, continuation counts below the top."""
    padded = ["\x02\x02\x02" + w + "\x03" for w in words]
    counts = {4: Counter(w[i - 3 : i + 1] for w in padded for i in range(3, len(w)))}
    for order in (3, 2, 1):
        counts[order] = Counter(g[1:] for g in counts[order + 1])

    def p(context: str, c: str, order: int) -> float:
        if not order:
            return 1 / (alphabet + 1)
        own, n = counts[order], Counter(counts[order].values())
        d = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        follow = {g: k for g, k in own.items() if g[:-1] == context}
        lower = p(context[1:], c, order - 1)
        total = sum(follow.values())
        return max(follow.get(context + c, 0) - d, 0) / total + d * len(follow) / total * lower if total else lower

    return lambda context, c: math.log(p(context, c, 4))


def test_kneser_ney_by_brute_force(spark, sf_dir):
    """Cross-entropies and languages of some texts, from models of all learning texts of the table."""
    rows = [r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect() if r["text"]]
    held = lambda k: zlib.crc32(str(k).encode()) % 4 == 2
    letters = lambda t: regex.findall(r"\p{L}+", t.lower())
    learned = {}
    for r in rows:
        if r["lang"] is not None and not held(r["doc_id"]):
            learned.setdefault(r["lang"], []).extend(letters(r["text"]))
    alphabet = len({c for ws in learned.values() for w in ws for c in w} | {"\x03"})
    models = {k: plain_kneser_ney(ws, alphabet) for k, ws in sorted(learned.items())}
    asked = [r for r in rows if held(r["doc_id"]) and 0 < len(r["text"]) < 200][:4] or [r for r in rows if held(r["doc_id"])][:2]
    found = {r["doc_id"]: r for r in langid.with_held_out(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    for r in asked:
        words = letters(r["text"])[:60]
        if len(words) < len(letters(r["text"])):
            continue
        n = sum(map(len, words)) + len(words)
        logs = {k: sum(m(w[i - 3 : i], w[i]) for w in ("\x02\x02\x02" + x + "\x03" for x in words) for i in range(3, len(w))) for k, m in models.items()}
        best = max(sorted(logs), key=logs.get)
        got = found[r["doc_id"]]
        assert got["lang_pred"] == best and got["cross_entropy"] == pytest.approx(-logs[best] / n, rel=1e-4)
        assert got["score"] == pytest.approx(1 / sum(math.exp(max(-700, v - logs[best])) for v in logs.values()), rel=1e-2)


def test_numbers_are_no_letters(spark):
    docs = spark.createDataFrame([(1, "river stone", "en"), (2, "² ½ Ⅷ 12 _", None), (4, "r²iver", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, F.col("doc_id") == 1).collect()}
    assert got == {1: "en", 2: "und", 4: "en"}


def test_foreign_text_is_rejected(spark):
    docs = spark.createDataFrame([(i, prose(i, 60), "en") for i in range(60)] + [(99, "Zxqj kvwz qqzx jjkv wzzq xxkj vvqz zjxk qwzv kkxj " * 4, None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["rejected"] for r in langid.with_held_out(docs).collect()}
    assert got[99] and sum(got.values()) <= 4


def test_a_rare_language_has_a_limit_of_rejection(spark):
    rows = [(k, "river stone under the garden", "en") for k in range(40_000)] + [(-1, "река камень сад", "ru"), (-2, "щщщ ъъъ ыыы ююю эээ", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.identify(docs, F.col("doc_id") >= -1).filter("doc_id < 0").collect()
    assert {r["doc_id"]: (r["lang_pred"], r["rejected"]) for r in found} == {-1: ("ru", False), -2: ("ru", True)}


def test_limits_of_rejection_come_from_all_learning_texts(spark):
    """Of 20 000 texts, 30 hold rare words; asked texts of rising shares of them show where the limit lies."""
    strange = "zxqj kvwz qqzx jjkv wzzq xxkj".split()
    usual = "river stone under the garden light over winter paper music".split()
    rows = [(k, " ".join((usual * 3)[k % 7 : k % 7 + 12] + (strange * 9)[: 2 + k % 40] * (k % 600 == 77)), "en") for k in range(20_000)]
    rows += [(-1 - k, " ".join(usual * 5 + (strange * 60)[:k]), None) for k in range(300)]
    found = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4), F.col("doc_id") >= 0).collect()
    learned = sorted(r["cross_entropy"] for r in found if r["doc_id"] >= 0)
    assert len(learned) == 20_000
    limit = learned[19_980 - 1] + 2 * float(np.std(learned))
    asked = [r for r in found if r["doc_id"] < 0]
    assert [r["rejected"] for r in asked] == [r["cross_entropy"] > limit for r in asked] and {r["rejected"] for r in asked} == {True, False}


def test_ranks_are_exact(spark):
    rng = np.random.default_rng(3)
    values = {"a": rng.gamma(9, 0.3, 5003), "b": np.repeat(2.5, 4000), "c": 2.5 + rng.random(3000) * 2.0**-33, "d": np.array([1.25])}
    got = langid.limits(spark.createDataFrame([(k, float(x)) for k, v in values.items() for x in v], "label string, value double").repartition(5))
    assert got == pytest.approx({k: np.sort(v)[math.ceil(0.999 * len(v)) - 1] + 2 * np.std(v) for k, v in values.items()}, rel=1e-12)
    assert langid.limits(spark.createDataFrame([], "label string, value double")) == {}


# 6


def plain_sketch(text: str, size: int = 128) -> set[tuple]:
    """Shingles of five words; with fewer than ``size`` of them a sketch holds them all, so likenesses are exact."""
    words = WORD.findall(text)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_likeness(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a and b else float(a == b)


def test_sketches_by_brute_force(odd_docs, no_docs):
    """Small sets have exact likenesses; larger ones are held to those of their whole sets, by the sketch's error."""
    docs = odd_docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: -r["doc_id"])
    got = {r["doc_id"]: r for r in sketch.edited(docs, parts=4).collect()}
    assert set(got) == {r["doc_id"] for r in rows}
    sets = {}
    for r, after in zip(rows, [*rows[1:], rows[0]]):
        body, other = r["text"] or "", after["text"] or ""
        cut = len(body) // 3
        changed = body[: len(body) - cut] + other[:cut]
        g = got[r["doc_id"]]
        assert g["n_chars"] == len(body) and g["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        own, new, nxt = map(plain_sketch, (body, changed, other))
        for name, shingles in (("fingerprint", own), ("edited_fingerprint", new)):
            assert len(g[name]) == 16 * min(128, len(shingles)) and sets.setdefault(g[name], shingles) == shingles
        for name, shingles in (("near_edited", new), ("near_next", nxt)):
            exact = plain_likeness(own, shingles)
            assert g[name] == pytest.approx(exact, abs=1e-12 if len(own | shingles) < 128 else 0.2), (r["doc_id"], name)
    assert sketch.edited(no_docs).count() == 0
    assert sketch.edited(odd_docs).count() == odd_docs.count()


def test_sketch_estimates_and_merges():
    a, b = prose(1, 3000).encode().split(), prose(2, 3000).encode().split()
    of = lambda words: sketch.sketch(b" ".join(words))
    both = sketch.merge(of(a), of(b))
    assert sketch.merge(of(b), of(a)).tolist() == both.tolist()
    x, y = of(a), of(a[:1500] + b[:1500])
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    sa, sy = shingles(a), shingles(a[:1500] + b[:1500])
    assert sketch.distinct(x) == pytest.approx(len(sa), rel=0.3)
    assert sketch.distinct(both) == pytest.approx(len(sa | shingles(b)), rel=0.3)
    assert sketch.resemblance(x, y) == pytest.approx(len(sa & sy) / len(sa | sy), abs=0.12)
    assert sketch.containment(x, y) == pytest.approx(len(sa & sy) / len(sa), abs=0.2)
    empty = of([])
    assert sketch.resemblance(empty, empty) == 1 and sketch.resemblance(empty, x) == 0 and sketch.containment(empty, x) == 1 and sketch.distinct(empty) == 0


def test_sketches_of_groups_are_merged(spark, odd_docs, no_docs):
    docs = spark.createDataFrame([(k, "ab"[k % 2] if k < 40 else None, prose(k % 7, 60)) for k in range(45)] + [(99, "c", None)], "doc_id long, source string, text string").repartition(5)
    got = {r["source"]: r for r in sketch.merged(sketch.sketches(docs), "source").collect()}
    want: dict = {}
    for r in docs.collect():
        want.setdefault(r["source"], set()).update(plain_sketch(r["text"] or ""))
    assert set(got) == set(want) == {"a", "b", None, "c"}
    for k, shingles in want.items():
        assert got[k]["n_shingles"] == (len(shingles) if len(shingles) < 128 else pytest.approx(len(shingles), rel=0.3))
    pairs = sketch.compared(spark.createDataFrame([(got["a"]["fingerprint"], got["b"]["fingerprint"]), ("", got["a"]["fingerprint"]), (None, None)], "x string, y string"), "x", "y").collect()
    assert pairs[0]["resemblance"] == pytest.approx(plain_likeness(want["a"], want["b"]), abs=0.15)
    assert pairs[0]["containment"] == pytest.approx(len(want["a"] & want["b"]) / len(want["a"]), abs=0.2)
    assert (pairs[1]["resemblance"], pairs[1]["containment"]) == (0, 1) and (pairs[2]["resemblance"], pairs[2]["n_union"]) == (1, 0)
    assert sketch.merged(sketch.sketches(no_docs), "source").count() == 0
    assert sketch.merged(sketch.sketches(odd_docs), "label").count() == 1


def test_sketches_keep_columns(odd_docs, no_docs):
    out = sketch.sketches(odd_docs)
    assert out.columns == [*odd_docs.columns, "fingerprint", "n_shingles"] and out.count() == odd_docs.count()
    assert sketch.sketches(no_docs).count() == 0


def test_models_keep_the_rare_n_grams_of_large_corpora(spark):
    texts = ["river stone " * 60_000, "zebra quagga"]
    (name,), (model,) = langid.fit(spark.createDataFrame([("en", x) for x in texts], "label string, text string"))
    padded = [f"\x02\x02\x02{w}\x03" for w in ("river", "stone", "zebra", "quagga")]
    for order in range(1, 5):
        assert len(model.gram[order - 1].keys) == len({w[i - order + 1 : i + 1] for w in padded for i in range(3, len(w))})


# 8


def test_expectation_maximisation_recovers_accuracies():
    rng = np.random.default_rng(0)
    good = rng.random(20_000) < 0.8
    right = np.array([0.98, 0.97, 0.99]), np.array([0.7, 0.5, 0.6])
    says_good = np.where(good[:, None], rng.random((20_000, 3)) < right[0], rng.random((20_000, 3)) >= right[1])
    said = np.where(rng.random((20_000, 3)) < 0.1, quality.ABSTAIN, np.where(says_good, quality.GOOD, quality.BAD))
    patterns, counts = np.unique(said, axis=0, return_counts=True)
    posterior, rate, share = quality.agree(patterns, counts.astype(float))
    assert share == pytest.approx(0.8, abs=0.05) and np.allclose(rate[1], right[0], atol=0.03) and np.allclose(1 - rate[0], right[1], atol=0.1)
    none = quality.agree(np.zeros((0, 3), int), np.zeros(0))
    assert len(none[0]) == 0


def test_quality_against_labels(spark):
    sf = "/root/testdata/sf0.01"
    found = quality.classify(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    n = {(r["quality"], r["quality_kept"]): r["count"] for r in found.groupBy("quality", "quality_kept").count().collect()}
    assert n.get((1, False), 0) <= 0.005 * n[1, True] and n.get((0, True), 0) <= 0.1 * n[0, False]


def test_quality_edges(odd_docs, no_docs):
    out = quality.classify(odd_docs)
    assert out.columns == [*odd_docs.columns, "quality_votes", "quality_posterior", "quality_score", "quality_kept"]
    rows = out.collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["quality_score"] <= 1 and 0 <= r["quality_posterior"] <= 1 for r in rows)
    assert {r["quality_votes"] for r in rows if r["doc_id"] in (4, 5, 6, 7)} == {"." * len(quality.LABELLERS)}
    assert quality.accepted(odd_docs).columns == odd_docs.columns
    assert quality.classify(no_docs).count() == 0


def test_labellers_see_junk():
    read = quality.Reader()
    good = read(prose(1, 100))[0]
    assert quality.BAD not in good
    for junk, name in (("word$$$ other%%% " * 20, "symbols"), ("LOUD!! NOISE!! " * 20, "capitals"), ("LOUD!! NOISE!! " * 20, "outcries"), ("a | b | c | d | " * 20, "wordless"), ("same " * 50, "stutter"), ("one two three " * 30, "monotony"), ("x " * 40 + "more words here " * 200, "unpunctuated")):
        at = [n for n, _, _ in quality.LABELLERS].index(name)
        assert read(junk)[0][at] == quality.BAD, name


# 10


def test_mixing_by_brute_force(spark):
    rng = np.random.default_rng(4)
    vocab = {"a": [f"a{i}" for i in range(40)], "b": [f"b{i}" for i in range(40)]}
    rows = []
    for i in range(200):
        d = "a" if i % 4 else "b"
        words = list(rng.choice(vocab[d], 30)) + list(rng.choice(vocab["b" if d == "a" else "a"], int(rng.integers(0, 20))))
        rows.append((i, " ".join(words), d))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    target = {"a": 0.5, "b": 0.5}
    got = {r["doc_id"]: r for r in mixing.rates(docs, target).collect()}
    n = np.array([len(t.split()) for _, t, _ in rows])
    p = np.array([[got[i]["domain_posterior"][d] for d in "ab"] for i, _, _ in rows])
    assert np.allclose(p.sum(axis=1), 1) and sum((p[i, 0] > 0.5) == (rows[i][2] == "a") for i in range(200)) > 185
    assert [got[i]["n_words"] for i in range(200)] == n.tolist()
    full = (n[:, None] * p).sum(axis=0)
    goal, r = np.array([0.5, 0.5]) * full.sum(), np.ones(200)
    for _ in range(64):
        e = (n * r) @ p - goal
        if (abs(e) / full).max() <= mixing.CLOSE:
            break
        r = np.maximum(0, r - p @ (e / full))
    assert np.allclose(r, [got[i]["rate"] for i in range(200)])
    taken = np.array([got[i]["copies"] for i in range(200)])
    assert (abs(taken - r) < 1).all() and (((n * taken) @ p) / (n * taken).sum())[0] == pytest.approx(0.5, abs=0.08)
    once = mixing.mixed(docs, target, most=1.0)
    shares = {r["lang"]: r["n"] for r in once.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    assert once.columns == docs.columns and once.count() == once.select("doc_id").distinct().count() and shares["b"] >= 40 and shares["a"] < 90


def test_mixing_edges(odd_docs, no_docs):
    out = mixing.rates(odd_docs, {"en": 1.0})
    rows = out.collect()
    assert len(rows) == odd_docs.count() and all(r["rate"] >= 0 and set(r["domain_posterior"]) == {"en"} for r in rows)
    assert all(r["n_words"] == 0 for r in rows if r["doc_id"] in (4, 5, 6))
    assert mixing.rates(odd_docs, {}).filter("rate <> 1").count() == 0
    assert mixing.rates(odd_docs.withColumn("lang", F.lit(None).cast("string")), {"en": 1.0}).filter("rate <> 1").count() == 0
    assert mixing.mixed(odd_docs, {"en": 1.0}).columns == odd_docs.columns
    assert mixing.rates(no_docs, {"en": 1.0}).count() == 0 and mixing.mixed(no_docs, {"en": 1.0}, most=1.0).count() == 0


def test_mixing_is_native(spark, sf_dir):
    for name in ("op9_url_filters", "op10_mixing"):
        plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
