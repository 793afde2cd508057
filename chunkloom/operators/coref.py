"""Mentions of the same thing: windows for a solver, clusters, and entity-pronoun pairs. Offsets are of characters, ends inclusive."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import add_columns
from ..functions.text import Counter, count_words
from .splitters import by_lines, grouped_blocks

Mention = tuple[int, int]
Cluster = list[Mention]
# Personal pronouns.
PRONOUNS = (
    "i", "me", "my", "mine", "myself", "we", "us", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves",
    "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself", "they", "them", "their", "theirs", "themselves",
    "one", "oneself",
)
TOKEN = re.compile(r"\w+|[^\w\s]")
PIECE = re.compile("[ \n]")


def is_pronoun(word: str) -> bool:
    return word.lower() in PRONOUNS


def char_offsets(tokens: list[str], clusters: list[list[tuple[int, int]]], base: int = 0) -> list[Cluster]:
    """From token offsets (inclusive) to character offsets; tokens hold their white space."""
    starts = [base]
    for t in tokens:
        starts.append(starts[-1] + len(t))
    return [[(starts[a], starts[min(b, len(tokens) - 1) + 1] - 1) for a, b in cluster] for cluster in clusters]


def text_windows(text: str, most: int = 2000, overlap: int = 2, count: Counter = count_words) -> list[tuple[int, int]]:
    """Character spans of windows of whole lines that overlap by some lines; a line above the limit is a window of its own."""
    lines = by_lines(text)
    return [(lines[a][0], lines[b - 1][1]) for a, b in grouped_blocks([count(text[x:y]) for x, y in lines], most, overlap)]


def merged(clusters: list[Cluster]) -> list[Cluster]:
    """Clusters that share a mention become one, in order of place."""
    owner: dict[Mention, int] = {}
    up: list[int] = list(range(len(clusters)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for i, cluster in enumerate(clusters):
        for m in cluster:
            a, b = root(i), root(owner.setdefault(m, i))
            up[max(a, b)] = min(a, b)
    groups: dict[int, set[Mention]] = {}
    for i, cluster in enumerate(clusters):
        groups.setdefault(root(i), set()).update(cluster)
    return [sorted(g) for _, g in sorted(groups.items())]


def filtered(text: str, clusters: list[Cluster]) -> list[Cluster]:
    """Without clusters of one text repeated, and without mentions of digits alone."""
    out = []
    for cluster in clusters:
        said = ["".join(text[a : b + 1].split()) for a, b in cluster]
        if len(set(said)) > 1 and (kept := [m for m, s in zip(cluster, said) if not s.isdigit()]):
            out.append(kept)
    return out


def entity_pronoun_pairs(text: str, clusters: list[Cluster], pronoun: Callable[[str], bool] = is_pronoun) -> list[tuple[Mention, Mention]]:
    """Each pronoun with the nearest entity of its cluster before it, or else the first one; a later cluster overrules an earlier one.

    Mentions inside longer ones of their cluster don't count. A mention that holds pronouns gives those words, else it is an entity.
    """
    pairs: dict[Mention, Mention] = {}
    for cluster in clusters:
        whole = [m for m in set(cluster) if not any(o[0] <= m[0] and m[1] <= o[1] and o[1] - o[0] > m[1] - m[0] for o in cluster)]
        entities, pronouns = [], set()
        for a, b in sorted(whole):
            words = [(a + t.start(), a + t.end() - 1) for t in TOKEN.finditer(text[a : b + 1]) if pronoun(t[0])]
            pronouns.update(words)
            if not words:
                entities.append((a, b))
        for p in sorted(pronouns) if entities else ():
            before = [e for e in entities if e[0] < p[0]]
            pairs[p] = max(before) if before else entities[0]
    return [(e, p) for p, e in pairs.items()]


def nearest_name_solver(text: str) -> list[Cluster]:
    """The offline default: a capitalised word inside a sentence and the pronouns up to the next such word are one cluster."""
    clusters: list[Cluster] = []
    for m in re.finditer(r"(?<=[^\W\d_] )[^\W\d_][\w-]*|\b\w+\b", text):
        word, at = m[0], (m.start(), m.end() - 1)
        if is_pronoun(word):
            if clusters:
                clusters[-1].append(at)
        elif word[0].isupper() and m.start() >= 2 and text[m.start() - 1] == " " and text[m.start() - 2].isalpha():
            clusters.append([at])
    return [c for c in clusters if len(c) > 1]


def find_mentions(docs: DataFrame, make_solver: Callable[[], Callable[[str], list[Cluster]]] = lambda: nearest_name_solver, most: int = 2000, overlap: int = 2, count: Counter = count_words, foreign: Callable[[str], bool] | None = None) -> DataFrame:
    """(doc_name, mentions, entity_pron_mentions) of documents (doc_name, full_text).

    The solver sees windows of lines; clusters of overlapping windows are merged and filtered. Texts that ``foreign`` refuses have none.
    """

    def make():
        solve = make_solver()

        def work(text: str | None):
            clusters: list[Cluster] = []
            if text and not (foreign and foreign(text)):
                for a, b in text_windows(text, most, overlap, count):
                    clusters += [[(x + a, y + a) for x, y in c] for c in solve(text[a:b])]
            clusters = filtered(text or "", merged(clusters))
            pairs = entity_pronoun_pairs(text or "", clusters)
            return [[list(m) for m in c] for c in clusters], [[list(e), list(p)] for e, p in pairs]

        return work

    shape = "mentions array<array<array<bigint>>>, entity_pron_mentions array<array<array<bigint>>>"
    return add_columns(docs.select("doc_name", "full_text"), [F.col("full_text")], shape, make).drop("full_text")


def pair_rows(mentions: DataFrame) -> DataFrame:
    """(doc_name, entity_start, entity_end, pronoun_start, pronoun_end) of stored pairs."""
    at = lambda i, j: F.get(F.get("pair", F.lit(i)), F.lit(j)).cast("int")
    rows = mentions.select("doc_name", F.explode("entity_pron_mentions").alias("pair"))
    return rows.select("doc_name", at(0, 0).alias("entity_start"), at(0, 1).alias("entity_end"), at(1, 0).alias("pronoun_start"), at(1, 1).alias("pronoun_end"))


def mention_rows(mentions: DataFrame) -> DataFrame:
    """(doc_name, cluster, mention_start, mention_end) of stored clusters."""
    rows = mentions.select("doc_name", F.posexplode("mentions").alias("cluster", "found")).select("doc_name", "cluster", F.explode("found").alias("m"))
    return rows.select("doc_name", "cluster", F.get("m", F.lit(0)).cast("int").alias("mention_start"), F.get("m", F.lit(1)).cast("int").alias("mention_end"))


def lexicon(docs: DataFrame) -> DataFrame:
    """(doc_name, pairs, low, high, mentions) of documents (doc_name, full_text), as arrays, in one narrow pass.

    ``pairs``: as of ``lexicon_pairs``. Capitalised words are mentions; ``low`` and ``high`` are the start of each and the end of the next of the same
    lower-cased word, ``mentions`` their number. Words are pieces between single spaces and line breaks. Nothing is sorted or shuffled: a
    document's words are read in order.
    """

    def make():
        pronouns = frozenset(PRONOUNS)

        def work(text: str | None):
            pairs, low_ends, high_ends, seen, n, at, last = [], [], [], {}, 0, 0, None
            for word in PIECE.split(text or ""):
                if word:
                    low, end = word.lower(), at + len(word) - 1
                    capital = unicodedata.category(word[0]) == "Lu"
                    if capital:
                        if low in seen:
                            low_ends.append(seen[low])
                            high_ends.append(end)
                        seen[low], n = at, n + 1
                    if low in pronouns:
                        if last:
                            pairs.append({"entity_start": last[0], "entity_end": last[1], "pronoun_start": at, "pronoun_end": end})
                    elif capital:
                        last = at, end
                at += len(word) + 1
            return pairs, low_ends, high_ends, n

        return work

    shape = "pairs array<struct<entity_start:int,entity_end:int,pronoun_start:int,pronoun_end:int>>, low array<int>, high array<int>, mentions int"
    return add_columns(docs, [F.col("full_text")], shape, make, ["doc_name"])


def lexicon_pairs(words: DataFrame) -> DataFrame:
    """Pairs without a model, by DataFrame functions: each pronoun with the last capitalised word before it in the document.

    ``words``: doc_name, start, end (inclusive), word. A running maximum over the document's words, no self-join.
    """
    from pyspark.sql import Window

    low = F.lower("word")
    pronoun = low.isin(*PRONOUNS)
    entity = ~pronoun & F.col("word").rlike(r"^\p{Lu}")
    so_far = Window.partitionBy("doc_name").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(entity, F.struct("start", "end"))).over(so_far)
    return words.withColumn("entity", last).filter(pronoun & F.col("entity").isNotNull()).select("doc_name", F.col("entity.start").alias("entity_start"), F.col("entity.end").alias("entity_end"), F.col("start").alias("pronoun_start"), F.col("end").alias("pronoun_end"))
