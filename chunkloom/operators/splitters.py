"""Splitters: a text to character spans.

Every splitter has ``spans(text)``, spans in order that cover the text (they may overlap where an overlap is asked for), and
``split_text(text)``, their texts. Spans make repair, pages, titles and boundary metrics arithmetic instead of string search.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np

from ..functions.text import Counter, count_words, regex_in
from ..functions.vectors import Embedder, HashingEmbedder

Span = tuple[int, int]
#: Separators that work for any text: paragraphs, lines, words, characters.
PLAIN_SEPARATORS = ("\n\n", "\n", " ", "")
# The levels of separators of the paper's regex configuration, from headings down to characters.
PAPER_SEPARATORS = (
    r"(?<=\n)#{1}\s",
    r"(?<=\n)#{2}\s",
    r"(?<=\n)#{3}\s",
    r"(?<=\n)#{4}\s",
    r"(?<=\n)#{5}\s",
    r"(?<=\n)#{6}\s",
    r"(?<=\n)\s*\(?[A-Za-z0-9]{1,4}[.)]\s+",
    r"(?<=\n)\s*[-*·•●▪◦‣▸▹○◯‒–—]\s+",
    r"\n{2,}",
    r"\n",
    r"[.!?]\s+",
    r",\s+",
    r"\s+",
    r"",
)
#: Pieces under so many characters are glued to a neighbour.
SHORT = 10


class Splitter(Protocol):
    def spans(self, text: str) -> list[Span]: ...


class _Texts:
    def spans(self, text: str) -> list[Span]:
        raise NotImplementedError

    def split_text(self, text: str) -> list[str]:
        return [text[a:b] for a, b in self.spans(text)]


def cut(text: str, pattern: re.Pattern, attach: str = "start", short: int = SHORT) -> list[Span]:
    """Spans between the matches, each match at the start or end of a span; short spans are glued to the next or last one."""
    if attach not in ("start", "end"):
        raise ValueError('attach must be "start" or "end"')
    edges = {m.start() if attach == "start" else m.end() for m in pattern.finditer(text)}
    at = [0, *sorted(x for x in edges if 0 < x < len(text)), len(text)]
    out: list[Span] = []
    begin = 0
    for a, b in zip(at, at[1:]):
        if attach == "start":
            if b - begin >= short or b == len(text):
                out.append((begin, b))
                begin = b
        elif out and b - a < short:
            out[-1] = out[-1][0], b
        else:
            out.append((a, b))
    return [s for s in out if s[0] < s[1]]


@dataclass(frozen=True)
class RecursiveSplitter(_Texts):
    """Splits by ever finer separators until every piece fits, then merges pieces.

    ``merging``: "to_chunk_size" fills chunks up to the size; "small_only" merges only what is under ``min_chunk_tokens``. With an
    overlap a chunk may reach size + overlap; the strategy "chunk_size" takes the overlap off the size beforehand. ``merging_order``
    "backward" merges from the end, so that the first chunk is the odd one, and a chunk then overlaps the one after it.
    """

    chunk_size: int = 1000
    chunk_overlap: int = 0
    count: Counter = count_words
    attach: str = "start"
    regex: bool = False
    separators: tuple[str, ...] = PLAIN_SEPARATORS
    merging: str = "to_chunk_size"
    strategy: str = "chunk_size_plus_overlap"
    min_chunk_tokens: int = 100
    merging_order: str = "forward"
    short: int = SHORT

    def __post_init__(self) -> None:
        if self.chunk_overlap > self.chunk_size:
            raise ValueError(f"the overlap ({self.chunk_overlap}) cannot be greater than the chunk size ({self.chunk_size})")
        if min(self.min_chunk_tokens, self.chunk_overlap) < 0 or self.chunk_size < 1:
            raise ValueError("sizes can't be negative")
        for name, value, known in (("merging", self.merging, ("to_chunk_size", "small_only")), ("strategy", self.strategy, ("chunk_size_plus_overlap", "chunk_size")), ("merging_order", self.merging_order, ("forward", "backward")), ("attach", self.attach, ("start", "end"))):
            if value not in known:
                raise ValueError(f"{name} must be one of {', '.join(known)}")
        if not self.separators:
            raise ValueError("at least one separator is needed")
        try:
            self._patterns()
        except re.error as e:
            raise ValueError(f"invalid separator: {e}") from e

    def _patterns(self) -> list[re.Pattern | None]:
        return [re.compile(s if self.regex else re.escape(s)) if s else None for s in self.separators]

    @property
    def size(self) -> int:
        return max(1, self.chunk_size - self.chunk_overlap) if self.strategy == "chunk_size" else self.chunk_size

    def spans(self, text: str) -> list[Span]:
        return _Merge(self, text).spans()


class _Merge:
    """One text on its way through a RecursiveSplitter; counts are remembered by span."""

    def __init__(self, how: RecursiveSplitter, text: str) -> None:
        self.how, self.text, self.known = how, text, {}
        self.patterns = how._patterns()
        self.back = how.merging_order == "backward"

    def count(self, a: int, b: int) -> int:
        if (a, b) not in self.known:
            self.known[a, b] = self.how.count(self.text[a:b])
        return self.known[a, b]

    def pieces(self, a: int, b: int, most: int, level: int = 0) -> list[Span]:
        if a >= b:
            return []
        if self.count(a, b) <= most:
            return [(a, b)]
        pattern = self.patterns[level] if level < len(self.patterns) else None
        if pattern is None:
            return self.hard(a, b, most)
        out: list[Span] = []
        for x, y in cut(self.text[a:b], pattern, self.how.attach, self.how.short):
            out += self.pieces(a + x, a + y, most, level + 1)
        return out

    def hard(self, a: int, b: int, most: int) -> list[Span]:
        """Longest prefixes that fit, of a character at least."""
        out: list[Span] = []
        while a < b:
            low, high = a, b
            while low < high:
                middle = (low + high + 1) // 2
                if self.how.count(self.text[a:middle]) <= most:
                    low = middle
                else:
                    high = middle - 1
            out.append((a, max(low, a + 1)))
            a = out[-1][1]
        return out

    def joined(self, parts: list[Span]) -> Span:
        return min(p[0] for p in parts), max(p[1] for p in parts)

    def overlap(self, parts: list[Span]) -> list[Span]:
        """What the next chunk repeats of ``parts`` (in merging order): from the side it borders on, up to the overlap's tokens."""
        budget, got, out = self.how.chunk_overlap, 0, []
        if budget < 1:
            return out
        for k, (a, b) in enumerate(reversed(parts)):
            n = self.count(a, b)
            if n > budget and (k == 0 or got < budget // 2):
                finer = self.pieces(a, b, budget - got)
                for x, y in finer if self.back else reversed(finer):
                    if got + self.count(x, y) > budget:
                        break
                    out.insert(0, (x, y))
                    got += self.count(x, y)
                break
            if got + n > budget:
                break
            out.insert(0, (a, b))
            got += n
        return out

    def spans(self) -> list[Span]:
        parts = self.pieces(0, len(self.text), self.how.size)
        if self.back:
            parts.reverse()
        found = self.filled(parts) if self.how.merging == "to_chunk_size" else self.enlarged(parts)
        return found[::-1] if self.back else found

    def filled(self, parts: list[Span]) -> list[Span]:
        out: list[Span] = []
        held: list[Span] = []
        length = 0
        for part in parts:
            n = self.count(*part)
            if held and length + n > self.how.size:
                out.append(self.joined(held))
                held = [*self.overlap(held), part]
                length = self.count(*self.joined(held))
            else:
                held.append(part)
                length += n
        return [*out, self.joined(held)] if held else out

    def enlarged(self, parts: list[Span]) -> list[Span]:
        groups = merged_small([[p] for p in parts], [self.count(*p) for p in parts], self.how.min_chunk_tokens, self.how.size)
        out: list[Span] = []
        before: list[Span] = []
        for group in groups:
            group = before + group
            out.append(self.joined(group))
            before = self.overlap(group)
        return out


def merged_small(groups: list[list], sizes: list[int], least: int, most: int) -> list[list]:
    """Groups below ``least`` join the next one, else the last one, where the sum of sizes fits; passes until nothing changes."""
    changed = len(groups) > 1
    while changed:
        changed, i = False, 0
        while i < len(groups):
            if sizes[i] < least:
                if i + 1 < len(groups) and sizes[i] + sizes[i + 1] <= most:
                    at = i
                elif i and sizes[i - 1] + sizes[i] <= most:
                    at = i - 1
                else:
                    i += 1
                    continue
                groups[at : at + 2] = [groups[at] + groups[at + 1]]
                sizes[at : at + 2] = [sizes[at] + sizes[at + 1]]
                changed = True
            else:
                i += 1
    return groups


@dataclass(frozen=True)
class RegexSplitter(_Texts):
    """Spans at the matches of a pattern; an invalid one leaves the text whole.

    With ``empty`` the spans are the pieces of a split by the pattern: an empty text is one empty piece, and one stands before a match at
    the start of the text (or after one at its end, if matches stand at the end of spans).
    """

    pattern: str
    attach: str = "start"
    short: int = SHORT
    empty: bool = False

    def spans(self, text: str) -> list[Span]:
        if self.empty and not text:
            return [(0, 0)]
        try:
            pattern = re.compile(self.pattern)
        except re.error:
            return [(0, len(text))] if text else []
        out = cut(text, pattern, self.attach, self.short)
        if self.empty and self.attach == "start" and pattern.match(text):
            out.insert(0, (0, 0))
        elif self.empty and self.attach == "end" and any(m.end() == len(text) for m in pattern.finditer(text)):
            out.append((len(text), len(text)))
        return out


def by_lines(text: str) -> list[Span]:
    """Lines with their ends; blank lines belong to the line before, those before the first line to it."""
    ends = [m.end() for m in re.finditer(r"\n", text)]
    at = sorted({0, *ends, len(text)})
    out: list[Span] = []
    for a, b in zip(at, at[1:]):
        if out and (not text[a:b].strip() or not text[out[-1][0] : out[-1][1]].strip()):
            out[-1] = out[-1][0], b
        else:
            out.append((a, b))
    return out


SENTENCE_END = re.compile(r"(?<=[.!?…])[\"')\]»”’]*\s+(?=\S)")


def by_sentences(text: str) -> list[Span]:
    """Each sentence up to the start of the next."""
    at = sorted({0, *(m.end() for m in SENTENCE_END.finditer(text)), len(text)})
    return [(a, b) for a, b in zip(at, at[1:]) if a < b]


@dataclass(frozen=True)
class PerPage(_Texts):
    """Splits every page of a document by itself, so that no chunk crosses a page; a text without pages is one page."""

    splitter: Splitter

    def spans(self, text: str) -> list[Span]:
        return self.splitter.spans(text)

    def paged(self, text: str, pages: list[Span]) -> list[Span]:
        return [(a + x, a + y) for a, b in pages for x, y in self.splitter.spans(text[a:b])]


#: Ways to find sentences. Others (a trained model, say) are functions from a text to spans; gaps after a span belong to it.
SENTENCES: dict[str, Callable[[str], list[Span]]] = {"regex": by_sentences, "lines": by_lines, "blank_lines": RegexSplitter(r"\n\n").spans}


@dataclass(frozen=True)
class SentenceSplitter(_Texts):
    """Groups of sentences, without gaps."""

    method: str | Callable[[str], list[Span]] = "regex"
    per_chunk: int = 1

    def spans(self, text: str) -> list[Span]:
        if not text:
            return []
        find = self.method if callable(self.method) else SENTENCES[self.method]
        starts = sorted({0, *(a for a, _ in find(text) if a < len(text))})[:: self.per_chunk]
        return list(zip(starts, [*starts[1:], len(text)]))


def grouped_blocks(sizes: list[int], most: int, overlap: int = 0) -> list[tuple[int, int]]:
    """Ranges of blocks of at most ``most`` tokens; a new range starts ``overlap`` blocks earlier, if it then still takes a new one.

    A block above the limit is a range of its own.
    """
    out: list[tuple[int, int]] = []
    i = 0
    while i < len(sizes):
        begin, total = i, sizes[i]
        while out and begin > max(out[-1][0] + 1, out[-1][1] - overlap) and total + sizes[begin - 1] <= most:
            begin -= 1
            total += sizes[begin]
        end = i + 1
        while end < len(sizes) and total + sizes[end] <= most:
            total += sizes[end]
            end += 1
        out.append((begin, end))
        i = end
    return out


def group_chunks(blocks: list[str], most: int, count: Counter = count_words, overlap: int = 0) -> tuple[list[str], list[list[str]]]:
    """Texts and blocks of ``grouped_blocks``; a block above the limit is cropped to its longest prefix that fits."""
    sizes = [count(b) for b in blocks]
    groups = [blocks[a:b] for a, b in grouped_blocks(sizes, most, overlap)]
    for g in groups:
        if len(g) == 1 and count(g[0]) > most:
            a, b = _Merge(RecursiveSplitter(chunk_size=max(1, most), count=count), g[0]).hard(0, len(g[0]), most)[0]
            g[0] = g[0][a:b]
    return ["".join(g) for g in groups], groups


def group_pages(pages: list[str], per_group: int = 2, overlap_lines: int = 10) -> list[str]:
    """Pages in groups, each after the last lines of the group before it, which may itself start with such lines."""
    out: list[str] = []
    for k in range(0, len(pages), per_group):
        body = "".join(pages[k : k + per_group])
        tail = out[-1].splitlines(keepends=True)[-overlap_lines:] if out and overlap_lines else []
        out.append("".join(tail) + body)
    return out


def combine_blocks(blocks: Iterable[str], most: int, count: Counter = count_words) -> str:
    """The longest run of first blocks whose tokens sum to at most ``most``."""
    total, kept = 0, []
    for block in blocks:
        total += count(block)
        if total > most:
            break
        kept.append(block)
    return "".join(kept)


@dataclass(frozen=True)
class SemanticSplitter(_Texts):
    """Cuts between sentences whose neighbours' embeddings are far apart.

    ``threshold``: "gradient" and "percentile" cut where the distance (or its gradient) is above the ``amount`` percentile of the
    text's own distances; a number is the distance itself.
    """

    embed: Embedder = field(default_factory=HashingEmbedder)
    sentences: SentenceSplitter = SentenceSplitter()
    threshold: str | float = "gradient"
    amount: float = 95.0
    buffer: int = 1

    def spans(self, text: str) -> list[Span]:
        parts = self.sentences.spans(text)
        if len(parts) < 3:
            return [(0, len(text))] if text else []
        near = [text[parts[max(0, i - self.buffer)][0] : parts[min(len(parts) - 1, i + self.buffer)][1]] for i in range(len(parts))]
        x = np.asarray(self.embed(near), float)
        far = 1 - (x[1:] * x[:-1]).sum(axis=1)
        if isinstance(self.threshold, str):
            shown = np.gradient(far) if self.threshold == "gradient" and len(far) > 1 else far
            where = shown > np.percentile(shown, self.amount)
        else:
            where = far > self.threshold
        starts = [0, *(parts[i + 1][0] for i in np.flatnonzero(where))]
        return list(zip(starts, [*starts[1:], len(text)]))


@dataclass(frozen=True)
class LongContextSplitter(_Texts):
    """Sentence vectors pooled from word vectors of a long context; cuts where neighbours differ most.

    ``threshold``: a distance; "quantile" of the text's distances; or "max_tokens", the largest distance threshold whose longest
    chunk stays within ``max_chunk_tokens``. Contexts of ``max_context_tokens`` overlap by ``sentence_overlap`` sentences.
    """

    embed_words: Embedder = field(default_factory=HashingEmbedder)
    sentences: SentenceSplitter = SentenceSplitter()
    threshold: str | float = "max_tokens"
    quantile: float = 0.9
    max_context_tokens: int = 8000
    max_chunk_tokens: int = 1200
    sentence_overlap: int = 5
    count: Counter = count_words

    def _words(self, words: list[str], known: dict[str, int], vectors: list[np.ndarray]) -> np.ndarray:
        """Vectors of words, each different word of the text embedded once."""
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            known.update(zip(new, range(len(known), len(known) + len(new))))
            vectors.append(np.asarray(self.embed_words(new), float))
        return np.concatenate(vectors)[[known[w] for w in words]]

    def _vectors(self, texts: list[str], sizes: list[int]) -> np.ndarray:
        rows: list[np.ndarray | None] = [None] * len(texts)
        known: dict[str, int] = {}
        vectors: list[np.ndarray] = []
        for a, b in grouped_blocks(sizes, self.max_context_tokens, self.sentence_overlap):
            words = [t.split() for t in texts[a:b]]
            flat = self._words([w for ws in words for w in ws] or [""], known, vectors)
            centre = flat.mean(axis=0)
            at = 0
            for i, ws in enumerate(words, a):
                own = flat[at : at + len(ws)].mean(axis=0) if ws else np.zeros_like(centre)
                at += len(ws)
                if rows[i] is None:
                    rows[i] = own + 0.25 * centre
        x = np.array(rows)
        size = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(size > 0, size, 1)

    def spans(self, text: str) -> list[Span]:
        parts = self.sentences.spans(text)
        if len(parts) < 2:
            return parts
        texts = [text[a:b] for a, b in parts]
        sizes = [self.count(t) for t in texts]
        x = self._vectors(texts, sizes)
        far = 1 - (x[1:] * x[:-1]).sum(axis=1)
        if self.threshold == "quantile":
            where = far > np.quantile(far, self.quantile)
        elif self.threshold == "max_tokens":
            tokens = np.concatenate([[0], np.cumsum(sizes)])

            def longest(limit: float) -> int:
                at = np.concatenate([[0], np.flatnonzero(far > limit) + 1, [len(parts)]])
                return int(np.diff(tokens[at]).max())

            # the longest chunk grows with the limit, so the largest limit that fits is found by halving
            limits = np.unique(np.concatenate([[-1.0], far])).tolist()
            fits = bisect_right(limits, self.max_chunk_tokens, key=longest)
            where = far > (limits[fits - 1] if fits else -1.0)
        else:
            where = far > float(self.threshold)
        starts = [0, *(parts[i + 1][0] for i in np.flatnonzero(where))]
        return list(zip(starts, [*starts[1:], len(text)]))


@dataclass(frozen=True)
class LlmRegexSplitter(_Texts):
    """Asks a model for a separator pattern, from the text's first lines; without a valid one the text stays whole."""

    complete: Callable[[str], str]
    prompt: str = "{document}"
    context_tokens: int = 8000
    count: Counter = count_words

    def spans(self, text: str) -> list[Span]:
        if not text:
            return []
        context = combine_blocks(text.splitlines(keepends=True), self.context_tokens, self.count)
        pattern = regex_in(self.complete(self.prompt.replace("{document}", context)))
        return RegexSplitter(pattern).spans(text) if pattern else [(0, len(text))]


def few_shot_prompt(examples: Iterable[dict], task: str) -> str:
    """A prompt from examples with ``input`` and ``output`` (a pattern)."""
    shown = "\n\n".join(f"<example>\n{e['input']}\n<regex>{e['output']}</regex>\n</example>" for e in examples)
    return f"{task}\n\n{shown}\n\n<document>\n{{document}}\n</document>"


#: A character-based recursive splitter with the usual defaults, and one with the paper's separators.
RECURSIVE_DEFAULT = RecursiveSplitter(4000, 200, count=len, short=0)
RECURSIVE_1100 = RecursiveSplitter(1100, 0, regex=True, separators=PAPER_SEPARATORS, short=0)
OUR_1100 = RecursiveSplitter(1100, 0, regex=True, separators=PAPER_SEPARATORS, merging="small_only")
OUR_600 = RecursiveSplitter(600, 0, regex=True, separators=PAPER_SEPARATORS, merging="small_only")
#: The methods that are compared; "page" is the document's own pages.
METHODS: dict[str, Splitter | None] = {
    "page": None,
    "sentence": SentenceSplitter(per_chunk=5),
    "recursive_default": RECURSIVE_DEFAULT,
    "recursive_1100": RECURSIVE_1100,
    "our_recursive_1100": OUR_1100,
    "our_recursive_600": OUR_600,
    "semantic": SemanticSplitter(),
}
