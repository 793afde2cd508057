"""Byte-level BPE: a minimal perfect hash for whole pre-tokens; the others are merged, short ones many at once over linked
bytes in arrays, long ones each by a heap over linked bytes.

The vocabulary is a rank file (base64 token, rank) whose path is a parameter. The driver reads it, of a fixed
size, and ships the built tables in a broadcast, so executors need no file. Encoding is a narrow map: no shuffle.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from .common import U64, batches, mixed

#: Unicode's White_Space, which is what the patterns' \s stands for in the libraries that use these rank files.
SPACES = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def compiled(pattern: str) -> regex.Pattern:
    """The pattern with \\s and \\S spelled out, inside classes and outside."""
    out, inside = [], False
    for part in regex.findall(r"\\.|.", pattern, regex.S):
        inside = part == "[" or inside and part != "]"
        out.append({r"\s": SPACES if inside else f"[{SPACES}]", r"\S": f"[^{SPACES}]"}.get(part, part))
    return regex.compile("".join(out))


#: An odd multiplier whose product's high bits place a pair.
SPREAD = 0x9E3779B97F4A7C15


class PerfectHash:
    """A minimal perfect hash by displacement: n keys on n slots, one integer for each bucket of about two keys.

    A bucket of one key stores its slot itself. ``find`` compares the key in the slot, so strangers are refused.
    """

    SEED = 7

    def __init__(self, keys: list[bytes]) -> None:
        n = len(keys)
        hashes = np.array([xxhash.xxh64_intdigest(k, self.SEED) for k in keys], U64)
        assert len(set(hashes.tolist())) == n, "keys must differ"
        self.shift = np.zeros(max(1, n // 2), np.int64)
        self.keys: list[bytes] = [b""] * n
        self.slot_of = np.zeros(n, np.int64)
        taken = np.zeros(n, bool)
        home = (hashes % U64(len(self.shift))).astype(np.int64)
        order = np.argsort(home, kind="stable")
        for bucket in sorted(np.split(order, np.flatnonzero(np.diff(home[order])) + 1), key=len, reverse=True) if n else []:
            if len(bucket) == 1:
                break
            d, good = 1, np.zeros(0, np.int64)
            while not len(good):
                tries = self.slots(hashes[bucket], np.arange(d, d + 64)[:, None])
                ordered = np.sort(tries, axis=1)
                good = np.flatnonzero(~taken[tries].any(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1))
                d += 64
            s = tries[good[0]]
            self.shift[home[bucket[0]]], taken[s], self.slot_of[bucket] = d - 64 + good[0], True, s
        placed = np.bincount(home, minlength=len(self.shift))
        single = np.flatnonzero(placed[home] == 1)
        self.slot_of[single] = np.flatnonzero(~taken)[: len(single)]
        self.shift[home[single]] = -1 - self.slot_of[single]
        for key, slot in zip(keys, self.slot_of.tolist()):
            self.keys[slot] = key

    def slots(self, hashes: np.ndarray, shift) -> np.ndarray:
        return (mixed(hashes + U64(0x9E3779B97F4A7C15) * np.asarray(shift, np.int64).astype(U64)) % U64(len(self.keys))).astype(np.int64)

    def find(self, words: list[bytes]) -> np.ndarray:
        """The slot of each word, or -1."""
        if not words or not self.keys:
            return np.full(len(words), -1)
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, self.SEED) for w in words), U64, len(words))
        shift = self.shift[(hashes % U64(len(self.shift))).astype(np.int64)]
        slots = np.where(shift < 0, -1 - shift, self.slots(hashes, shift))
        return np.array([s if keys_s == w else -1 for s, keys_s, w in zip(slots.tolist(), map(self.keys.__getitem__, slots.tolist()), words)])


#: Bytes of the pre-tokens that are merged many at once, pre-tokens of one such round, and the rank of pairs that make no token.
SHORT, AT_ONCE, NONE = 32, 4096, np.iinfo(np.int32).max


class Vocabulary:
    """Ranks of tokens with all tiers; picklable, of the vocabulary's size."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern = ranks, pattern
        self.whole = PerfectHash(list(ranks))
        self.rank_in_slot = np.array([ranks[k] for k in self.whole.keys], np.int64)
        self.token = {r: k for k, r in ranks.items()}
        self.bytes = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        #: An id that no token has; a pair of tokens a, b is a * (pad + 1) + b.
        self.pad = max(self.token, default=0) + 1
        pairs = sorted((ranks[a] * (self.pad + 1) + ranks[b], r) for k, r in ranks.items() for i in range(1, len(k)) if (a := k[:i]) in ranks and (b := k[i:]) in ranks)
        bits = max(4, len(pairs).bit_length() + 2)
        self.drop = U64(64 - bits)
        self.pairs, self.pair_rank = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        for pair, r in pairs:
            at = (pair * SPREAD & 0xFFFFFFFFFFFFFFFF) >> 64 - bits
            while self.pairs[at] >= 0:
                at = (at + 1) & len(self.pairs) - 1
            self.pairs[at], self.pair_rank[at] = pair, r

    def ranks_of(self, pairs: np.ndarray) -> np.ndarray:
        """Of the tokens that pairs make, or NONE."""
        at = ((pairs.view(U64) * U64(SPREAD)) >> self.drop).view(np.int64)
        there = self.pairs[at]
        out = self.pair_rank[at]
        wrong = np.flatnonzero(there != pairs)
        out[wrong] = NONE
        wrong = wrong[there[wrong] >= 0]
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & len(self.pairs) - 1
            there = self.pairs[at[wrong]]
            same = there == pairs[wrong]
            out[wrong[same]] = self.pair_rank[at[wrong[same]]]
            wrong = wrong[~same & (there >= 0)]
        return out

    def merged_all(self, words: list[bytes]) -> list[list[int]]:
        """Like ``merged`` for each word."""
        out: list[list[int]] = [[]] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        short = int(np.searchsorted(sizes[order], SHORT, "right")) if (self.bytes >= 0).all() else 0
        for i in order[short:].tolist():
            out[i] = self.merged(words[i])
        for start in range(0, short, AT_ONCE):
            some = order[start : min(short, start + AT_ONCE)]
            flat, ends = self.merged_short([words[i] for i in some.tolist()], sizes[some])
            flat, ends = flat.tolist(), ends.tolist()
            for i, a, b in zip(some.tolist(), [0, *ends], ends):
                out[i] = flat[a:b]
        return out

    def merged_short(self, words: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and where each word's end. Each round merges the pair of lowest rank, leftmost first, of every word that has one."""
        n, wide = len(words), int(sizes.max()) + 2
        ids = np.full((n, wide), self.pad)  # a column of padding on either side
        ids[:, 1:-1] = self.bytes[np.array(words, f"S{wide - 2}").view(np.uint8).reshape(n, wide - 2)]
        ids[np.arange(wide) > sizes[:, None]] = self.pad
        rank = np.full((n, wide), NONE, np.int32)
        rank[:, :-1] = self.ranks_of((ids[:, :-1] * (self.pad + 1) + ids[:, 1:]).ravel()).reshape(n, wide - 1)
        cells = np.arange(n * wide)
        after, before, gone = cells + 1, cells - 1, np.zeros(n * wide, bool)
        ids, flat = ids.ravel(), rank.ravel()
        rows = np.arange(n)
        while True:
            at = rows * wide + (rank if len(rows) == n else rank[rows]).argmin(axis=1)
            r = flat[at]
            go = np.flatnonzero(r != NONE)
            if not len(go):
                break
            rows, at, r = rows[go], at[go], r[go].astype(np.int64)
            absorbed, left = after[at], before[at]
            right = after[absorbed]
            ids[at], gone[absorbed], flat[absorbed] = r, True, NONE
            after[at], before[right] = right, at
            found = self.ranks_of(np.concatenate([r * (self.pad + 1) + ids[right], ids[left] * (self.pad + 1) + r]))
            flat[at], flat[left] = found[: len(at)], found[len(at) :]
        stay = (ids != self.pad) & ~gone
        return ids[stay], np.cumsum(stay.reshape(n, wide).sum(axis=1))

    def merged(self, word: bytes) -> list[int]:
        """Merges the adjacent pair of lowest rank, leftmost first, until none is left."""
        n, get = len(word), self.ranks.get
        heap = [r * n + i for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
        heapify(heap)
        after, before = list(range(1, n + 2)), list(range(-1, n))  # a part is word[i : after[i]]; 0: gone
        while heap:
            r, i = divmod(heappop(heap), n)
            j = after[i]
            if not j or j >= n or get(word[i : (k := after[j])]) != r:
                continue  # one of the two parts has changed since
            after[i], after[j] = k, 0
            if k < n:
                before[k] = i
                if (r := get(word[i : after[k]])) is not None:
                    heappush(heap, r * n + i)
            if (p := before[i]) >= 0 and (r := get(word[p:k])) is not None:
                heappush(heap, r * n + p)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[word[i : (k := after[i])]])
            i = k
        return out


@lru_cache(4)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """Reads a rank file on the driver."""
    with open(path, "rb") as file:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}, pattern)


#: A lone space between characters that aren't white space: pre-tokens of the usual patterns never reach across its left edge.
EDGE = re.compile(r"(?<=\S) (?=\S)")
#: What stands on either side of a lone space when a pattern is tried: letters, digits, marks, symbols, contractions, signs of all kinds.
PROBES = ("a", "Z", "é", "你", "ǅ", "ʰ", "1", "٣", "Ⅷ", "²", "'s", "'", "’ll", "'re", ".", "...", "!?", "-", "_", "\u0301", "\u200d", "🎉", "$", "+", "/", "<|x|>", "\ufffd", "a1", "1a", "a.b", "(x")
#: Distinct runs and pre-tokens that an encoder remembers, and characters of them all: some 60 MB in a worker.
RUNS, PARTS, REMEMBERED = 200_000, 100_000, 4 << 20
#: Characters of the texts whose new runs are resolved at once.
AHEAD = 1 << 17
#: Token ids of one batch that goes back to Spark.
IDS = 1 << 19


def parts_at_edges(pattern: regex.Pattern) -> bool:
    """Whether the pattern, tried on pairs of PROBES, splits a text at lone spaces as it splits what lies between them."""
    split = pattern.findall
    return all(split(f"{a} {b} {a}") == split(a) + split(f" {b}") + split(f" {a}") for a in PROBES for b in PROBES)


class Encoder:
    """Encodes texts; while the memo lasts, each distinct run between lone spaces is resolved once.

    With a pattern whose matches reach across lone spaces, each whole text is split by the pattern instead.
    """

    def __init__(self, words: Vocabulary, most: int = RUNS) -> None:
        pattern = compiled(words.pattern)
        self.words, self.most, self.split = words, most, pattern.findall
        self.edges = EDGE.split if parts_at_edges(pattern) else lambda text: [text]
        self.token = np.empty(max(words.token, default=0) + 1, object)
        self.token[list(words.token)] = list(words.token.values())
        self.clear()

    def clear(self) -> None:
        self.new: list[str] = []
        new = self.new

        class Places(dict):
            def __missing__(self, run: str) -> int:
                self[run] = place = len(self)
                new.append(run)
                return place

        self.place = Places()
        self.parts: dict[str, list[int]] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.ends, self.resolved, self.held = np.zeros(1 << 12, np.int64), 0, 0

    def known(self, words: list[str]) -> None:
        """Resolves pre-tokens: those of the vocabulary by the perfect hash, the others by merges."""
        raw = [w.encode() for w in words]
        slots = self.words.whole.find(raw)
        self.parts.update(zip(words, ([rank] for rank in self.words.rank_in_slot[slots].tolist())))
        strange = np.flatnonzero(slots < 0).tolist()
        self.parts.update(zip([words[i] for i in strange], self.words.merged_all([raw[i] for i in strange])))
        self.held += sum(map(len, words))

    def resolve(self, heads: list[list[str]]) -> None:
        """Ids of the new runs, each with the space before it, and of the pre-tokens of ``heads``."""
        split = [self.split(" " + run) for run in self.new]
        self.known(list(set(chain.from_iterable(split)).union(*heads).difference(self.parts)))
        found = [[x for w in ws for x in self.parts[w]] for ws in split]
        self.new.clear()
        flat = [x for f in found for x in f]
        start, n = int(self.ends[self.resolved]), self.resolved + len(found)
        while len(self.ends) <= n:
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        while len(self.ids) < start + len(flat):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ends[self.resolved + 1 : n + 1] = start + np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        self.ids[start : start + len(flat)] = flat
        self.resolved = n

    def together(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text; all their new runs are resolved at once."""
        heads, places = [], []
        for text in texts:
            first, *runs = self.edges(text)
            heads.append(self.split(first))
            places.append(np.fromiter(map(self.place.__getitem__, runs), np.int64, len(runs)))
        self.resolve(heads)
        for head, at in zip(heads, places):
            starts = self.ends[at]
            sizes = self.ends[at + 1] - starts
            total = np.cumsum(sizes)
            yield np.concatenate([np.array([x for w in head for x in self.parts[w]], np.uint32), self.ids[np.repeat(starts - total + sizes, sizes) + np.arange(total[-1] if len(total) else 0)]])
        if len(self.place) > self.most or self.held > REMEMBERED:
            self.clear()
        elif len(self.parts) > PARTS:
            self.parts.clear()

    def each(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """Ids of each text, taken together up to about AHEAD characters."""
        some, size = [], 0
        for text in texts:
            some.append(text)
            size += len(text)
            if size > AHEAD:
                yield from self.together(some)
                some, size = [], 0
        if some:
            yield from self.together(some)

    def __call__(self, text: str) -> np.ndarray:
        (ids,) = self.each([text])
        return ids

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(self.token[ids].tolist())


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id", with_ids: bool = False, with_decoded: bool = False) -> DataFrame:
    """Token ids of every whole text, decoded again: ``key``, n_tokens, ids_sha256, decoded_sha256 (, ids) (, decoded).

    Null text counts as empty: no ids. Repeated rows and keys that are null or repeated give a row each. Other
    columns are not read, whatever their names. An empty table gives no rows. A worker holds one text's ids at a time, and those of a batch
    of about IDS that goes back if they are asked for; and the runs of texts of about AHEAD characters, or of one longer text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path, pattern))
    kind = docs.select(key).schema[0].dataType.simpleString()

    def make():
        encoder = Encoder(shared.value)

        def work(part: pa.RecordBatch):
            keys, bodies = part.column(0), part.column(1)
            start, total, rows, found, backs = 0, 0, [], [], []

            def ready(stop: int):
                out = {"doc_key": keys.slice(start, stop - start)} | {c: [r[i] for r in rows] for i, c in enumerate(("n_tokens", "ids_sha256", "decoded_sha256"))}
                if with_ids:
                    out["ids"] = pa.ListArray.from_arrays(np.cumsum([0, *map(len, found)], dtype=np.int32), np.concatenate(found).view(np.int32))
                if with_decoded:
                    out["decoded"] = backs
                return out

            for i, ids in enumerate(encoder.each(body.as_py() or "" for body in bodies)):
                ids = ids.astype("<u4", copy=False)
                back = encoder.decode(ids)
                rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(back).hexdigest()))
                if with_ids:
                    found.append(ids)
                if with_decoded:
                    backs.append(back)
                total += len(ids)
                if (with_ids or with_decoded) and total > IDS:
                    yield ready(i + 1)
                    start, total, rows, found, backs = i + 1, 0, [], [], []
            if rows:
                yield ready(part.num_rows)

        return work

    schema = f"doc_key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded binary" * with_decoded
    return batches(docs.select(docs[key].alias("doc_key"), docs[text].cast("string").alias("doc_text")), schema, make).withColumnRenamed("doc_key", key)
