"""Vector arithmetic on arrays as columns, in doubles, and the embedders that operators take."""

from __future__ import annotations

import hashlib
import random
import time
from collections.abc import Callable
from itertools import chain

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: ``embed(texts)`` gives one row a text.
Embedder = Callable[[list[str]], np.ndarray]


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null if a vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def unit(a: Column) -> Column:
    """Of length one; a zero vector stays."""
    size = norm(a)
    return F.transform(a, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(x.cast("double")))


def added(vectors: Column, size: int) -> list[Column]:
    """Aggregates that sum vectors of ``size`` components."""
    return [F.sum(F.get(vectors, F.lit(i)).cast("double")).alias(f"d{i}") for i in range(size)]


def clipped(x: Column) -> Column:
    """To [0, 1]; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


class _Hashes(dict):
    """64-bit hashes of words, made once each; starts anew when it holds many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        return h


class HashingEmbedder:
    """The offline default: signed hashes of lower-case words and word pairs, L2-normalised. Deterministic."""

    #: About so many words are hashed together.
    TOGETHER = 100_000

    def __init__(self, size: int = 64) -> None:
        self.size, self.memo = size, _Hashes()

    def __getstate__(self):
        return {"size": self.size, "memo": _Hashes()}

    def _sums(self, words: list[list[str]]) -> np.ndarray:
        """Signed counts of the words and pairs of some texts, all at once."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        h = np.fromiter(map(self.memo.__getitem__, chain.from_iterable(words)), np.uint64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs = (h[inner] * np.uint64(0x9E3779B97F4A7C15) + h[inner + 1]) * np.uint64(0xD6E8FEB86659FD93)
        every = np.concatenate([h, pairs ^ (pairs >> np.uint64(32))])
        place = np.concatenate([owner, owner[inner]]) * self.size + (every % np.uint64(self.size)).astype(np.int64)
        return np.bincount(place, np.where(every >> np.uint64(63), 1.0, -1.0), len(words) * self.size).reshape(-1, self.size)

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size))
        words: list[list[str]] = []
        first = held = 0
        for i, text in enumerate(texts):
            words.append(text.lower().split())
            held += len(words[-1]) + 1
            if held >= self.TOGETHER or i + 1 == len(texts):
                out[first : i + 1] = self._sums(words)
                words, first, held = [], i + 1, 0
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(size > 0, size, 1)


class RestEmbedder:
    """Embeddings by a service: ``post(batch)`` returns (status, vectors). Cuts texts, retries busy answers, normalises.

    Busy (429) and failing (5xx) answers are retried up to ``tries`` times with doubling pauses; other 4xx are errors.
    """

    def __init__(self, post: Callable[[list[str]], tuple[int, list[list[float]]]], size: int = 1024, batch: int = 256, chars: int = 20_000, tries: int = 6, pause: Callable[[float], None] = time.sleep) -> None:
        self.post, self.size, self.batch, self.chars, self.tries, self.pause = post, size, batch, chars, tries, pause

    def __call__(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros((0, self.size))
        rows: list[list[float]] = []
        for start in range(0, len(texts), self.batch):
            rows += self._one([t[: self.chars] for t in texts[start : start + self.batch]])
        out = np.array(rows, float)
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(size > 0, size, 1)

    def _one(self, part: list[str]) -> list[list[float]]:
        for k in range(self.tries + 1):
            status, vectors = self.post(part)
            if status < 400:
                return vectors
            if status != 429 and status < 500:
                raise RuntimeError(f"embedding failed with status {status}")
            if k < self.tries:
                self.pause(2.0 * 2**k + random.uniform(0, 2))
        raise RuntimeError(f"embedding still busy after {self.tries} retries: status {status}")


def prompted(text: Column, prompt: str | None, task: str = "") -> Column:
    """A query's text as the embedder wants it: with an instruction for ``query``, else with the prompt's name."""
    if prompt is None:
        return text
    return F.concat(F.lit(f"Instruct: {task}\nQuery: " if prompt == "query" else f"{prompt}: "), text)
