from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chunkloom.functions.text import count_words, regex_in
from chunkloom.operators import splitters as S


def paragraphs(n: int, w: int) -> str:
    return "\n\n".join(" ".join(f"word{i}_{j}" for j in range(w)) for i in range(n))


def make(size, overlap=0, **more):
    return S.RecursiveSplitter(size, overlap, count_words, **more)


def test_basic_split_has_no_empty_chunks():
    found = make(50).split_text(paragraphs(10, 20))
    assert len(found) >= 1 and all(found)


def test_covers_the_text():
    text = paragraphs(5, 15)
    assert "".join(make(40).split_text(text)) == text


def test_empty_and_short_texts():
    assert make(100).split_text("") == []
    assert make(100).split_text("Hello world this is short.") == ["Hello world this is short."]


def test_size_is_respected():
    assert all(count_words(c) <= 50 for c in make(50).split_text(paragraphs(20, 15)))


def test_overlap_shares_words_and_is_bounded():
    found = make(50, 10).split_text(paragraphs(10, 20))
    assert len(found) >= 2
    assert any(set(a.split()) & set(b.split()) for a, b in zip(found, found[1:]))
    with pytest.raises(ValueError, match="cannot be greater than"):
        make(100, 200)


def test_strategy_takes_the_overlap_off_the_size():
    text = paragraphs(10, 20)
    assert all(count_words(c) <= 50 for c in make(50, 10, strategy="chunk_size").split_text(text))


def test_small_only_leaves_large_pieces():
    found = make(50, merging="small_only", min_chunk_tokens=10).split_text(paragraphs(10, 5))
    assert all(count_words(c) >= 10 for c in found[:-1])


@pytest.mark.parametrize("merging", ["to_chunk_size", "small_only"])
def test_backward_covers_the_text(merging):
    text = paragraphs(8, 15)
    assert "".join(make(50, merging=merging, merging_order="backward").split_text(text)) == text


def test_backward_overlap_reaches_into_the_next_chunk():
    spans = make(30, 8, merging_order="backward").spans(paragraphs(8, 15))
    assert all(a[0] < b[0] <= a[1] for a, b in zip(spans, spans[1:]))
    assert any(b[0] < a[1] for a, b in zip(spans, spans[1:]))


def test_regex_separator():
    text = "# Heading 1\nSome content here.\n## Heading 2\nMore content here.\n### Heading 3\nStill more of it."
    assert "".join(make(5, regex=True, separators=(r"\n#{1,3}\s", " ", "")).split_text(text)) == text


def test_invalid_settings():
    for more in ({"merging": "x"}, {"strategy": "x"}, {"merging_order": "x"}, {"attach": "x"}, {"separators": ()}, {"min_chunk_tokens": -1}):
        with pytest.raises(ValueError):
            make(10, **more)
    with pytest.raises(ValueError, match="separator"):
        make(10, regex=True, separators=("(",))


def test_hard_split_without_separators():
    found = S.RecursiveSplitter(4, count=len, separators=("",)).split_text("abcdefghij")
    assert found == ["abcd", "efgh", "ij"]


def test_cut_glues_short_pieces_on_the_side_of_the_separator():
    import re

    text = "aaaaaaaaaaaa. b. cccccccccccccc. d"
    start = [text[a:b] for a, b in S.cut(text, re.compile(r"\. "), "start")]
    end = [text[a:b] for a, b in S.cut(text, re.compile(r"\. "), "end")]
    assert start == ["aaaaaaaaaaaa", ". b. cccccccccccccc", ". d"]
    assert end == ["aaaaaaaaaaaa. b. ", "cccccccccccccc. d"]


def test_regex_splitter_leaves_text_whole_on_an_invalid_pattern():
    assert S.RegexSplitter("(").split_text("some text") == ["some text"]
    assert S.RegexSplitter("(").split_text("") == []


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab.\n ,#", max_size=200), st.integers(1, 30), st.integers(0, 10), st.sampled_from(["to_chunk_size", "small_only"]), st.sampled_from(["forward", "backward"]), st.sampled_from(["start", "end"]))
def test_chunks_always_cover_the_text(text, size, overlap, merging, order, attach):
    how = S.RecursiveSplitter(size, min(size, overlap), len, attach, merging=merging, merging_order=order, min_chunk_tokens=5)
    spans = how.spans(text)
    at = 0
    for a, b in spans:
        assert a <= at < b or a <= at and b >= at
        at = max(at, b)
    assert at == len(text) and (spans != [] or text == "")
    if not overlap:
        assert "".join(text[a:b] for a, b in spans) == text
        assert all(b - a <= max(size, 1) for a, b in spans) or any(b - a < 10 for a, b in spans) or merging == "small_only" or size < 10


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab.! \n", max_size=120), st.integers(1, 4))
def test_sentences_and_lines_cover_the_text(text, k):
    for method in ("regex", "lines", "blank_lines"):
        assert "".join(S.SentenceSplitter(method, k).split_text(text)) == text


def test_lines_keep_blank_lines_with_the_line_before():
    text = "\n\na\n\nb\nc"
    assert [text[a:b] for a, b in S.by_lines(text)] == ["\n\na\n\n", "b\n", "c"]


def test_blocks_are_never_lost():
    groups = S.grouped_blocks([3, 3, 3, 20, 1, 1], 7, 1)
    assert {i for a, b in groups for i in range(a, b)} == set(range(6))
    assert (3, 4) in groups
    texts, blocks = S.group_chunks(["a b c ", "d e f ", "x " * 20, "g "], 6, count_words, 1)
    assert texts[0] == "a b c d e f " and count_words(texts[1]) <= 6 and blocks[-1][-1] == "g "


def test_group_pages_prefixes_the_last_lines():
    assert S.group_pages(["a\nb\n", "c\nd\n", "e\n"], 2, 1) == ["a\nb\nc\nd\n", "d\ne\n"]


def test_combine_blocks_stops_at_the_first_overflow():
    assert S.combine_blocks(["a b ", "c d e ", "f "], 4, count_words) == "a b "


def test_semantic_splitters_are_contiguous():
    text = "Cats purr loudly. Cats sleep all day. Markets fell on Monday. Stocks rose on Tuesday. Bonds were flat. " * 4
    for how in (S.SemanticSplitter(threshold="percentile", amount=80), S.SemanticSplitter(threshold=0.5), S.LongContextSplitter(max_chunk_tokens=30), S.LongContextSplitter(threshold="quantile"), S.LongContextSplitter(threshold=0.9)):
        assert "".join(how.split_text(text)) == text
    assert all(count_words(c) <= 30 for c in S.LongContextSplitter(max_chunk_tokens=30).split_text(text))


def test_model_regex():
    assert regex_in("x <REGEX> \\n# </regex> y") == "\\n#"
    assert regex_in("<regex>[a-\\d-z]</regex>") is not None
    assert regex_in("<regex>(</regex>") is None and regex_in("none") is None and regex_in(None) is None
    how = S.LlmRegexSplitter(lambda p: "<regex>\\n#</regex>")
    assert how.split_text("intro text here\n# one and more\n# two and more") == ["intro text here", "\n# one and more", "\n# two and more"]
    assert S.LlmRegexSplitter(lambda p: "no").split_text("a b") == ["a b"]
    assert "<regex>\\n</regex>" in S.few_shot_prompt([{"input": "doc", "output": "\\n"}], "Find a pattern.")


def test_per_page_never_crosses_pages():
    text = "aa bb cc dd ee ff"
    spans = S.PerPage(make(2)).paged(text, [(0, 8), (8, 8), (8, len(text))])
    assert "".join(text[a:b] for a, b in spans) == text and not any(a < 8 < b for a, b in spans)
    assert S.PerPage(make(2)).split_text(text) == make(2).split_text(text)


def test_long_context_embeds_each_word_of_a_text_once():
    from chunkloom.functions.vectors import HashingEmbedder

    asked: list[str] = []

    def embed(words):
        asked.extend(words)
        return HashingEmbedder(8)(words)

    text = " ".join(f"The fox number {i % 7} ran home. A whale sang." for i in range(60))
    spans = S.LongContextSplitter(embed_words=embed, max_chunk_tokens=40, max_context_tokens=100).spans(text)
    assert len(asked) == len(set(asked)) == len(set(text.split()))
    assert "".join(text[a:b] for a, b in spans) == text and max(len(text[a:b].split()) for a, b in spans) <= 40


def test_embedding_many_texts_equals_one_by_one(monkeypatch):
    from chunkloom.functions.vectors import HashingEmbedder

    texts = ["", "a b a", "x", "", "b a the Fox", "a"]
    one = [HashingEmbedder(16)([t])[0].tolist() for t in texts]
    assert HashingEmbedder(16)(texts).tolist() == one
    monkeypatch.setattr(HashingEmbedder, "TOGETHER", 3)
    assert HashingEmbedder(16)(texts).tolist() == one and HashingEmbedder(16)([]).shape == (0, 16)
