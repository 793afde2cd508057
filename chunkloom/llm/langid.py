"""Language identification by interpolated Kneser-Ney character models.

One model of order four for each language, over letters within words; words are padded, so every context is whole.
Probabilities and back-off weights lie in sorted arrays of 64-bit n-gram hashes. The language of lowest
cross-entropy per character wins; a text whose cross-entropy is above what its language's own texts show is marked
as rejected. Counts are gathered from all learning texts, and all n-grams are kept: discounts, continuation counts,
back-off weights and alphabet are those of the whole corpus, and the broadcast grows with its distinct n-grams.
Every text is scored once; the limits of rejection come from the stored scores of all learning texts.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, batches, checkpoint, mixed, released

ORDER, LANGUAGES = 4, 512
#: Texts whose words are looked up together.
TOGETHER = 32
LETTERS = regex.compile(r"\p{L}+")
OPEN, CLOSE = "\x02", "\x03"


def hashes(codes: np.ndarray, order: int) -> np.ndarray:
    """Of the n-gram that ends at each position."""
    out = np.full(len(codes), order, U64)
    for k in range(order - 1, -1, -1):
        out = out * U64(0x9E3779B97F4A7C15) + np.concatenate([np.zeros(min(k, len(codes)), U64), codes[: max(0, len(codes) - k)]])
    return mixed(out)


class Table:
    """A sorted hash array with a float for each key."""

    def __init__(self, grams: dict[str, float], order: int) -> None:
        codes = np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32).astype(U64)
        keys = hashes(codes, order)[order - 1 :: order] if grams else np.zeros(0, U64)
        sort = np.argsort(keys)
        self.keys, self.values = keys[sort], np.array(list(grams.values()), np.float32)[sort]


class KneserNey:
    def __init__(self, counts: dict[str, int], alphabet: int) -> None:
        """``counts`` of n-grams of order ORDER; lower orders use the number of different characters before them."""
        self.unknown = -np.log(alphabet + 1)
        self.gram: list[Table] = []
        self.back: list[Table] = []
        levels = [counts]
        for _ in range(ORDER - 1):
            levels.append(Counter(g[1:] for g in levels[-1]))
        lower: dict[str, float] = {}
        for order, level in zip(range(1, ORDER + 1), reversed(levels)):
            ones, twos = (sum(c == k for c in level.values()) for k in (1, 2))
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            total, kinds = Counter(), Counter()
            for g, c in level.items():
                total[g[:-1]] += c
                kinds[g[:-1]] += 1
            back = {ctx: discount * kinds[ctx] / total[ctx] for ctx in total}
            prob = {g: (c - discount) / total[g[:-1]] + back[g[:-1]] * (lower[g[1:]] if order > 1 else 1 / (alphabet + 1)) for g, c in level.items()}
            self.gram.append(Table({g: np.log(p) for g, p in prob.items()}, order))
            self.back.append(Table({c: np.log(b) for c, b in back.items()}, order - 1) if order > 1 else float(np.log(back[""])) if back else 0.0)
            lower = prob


class Ensemble:
    """The tables of all languages side by side: one sorted hash array for each order, a column for each language."""

    def __init__(self, models: list[KneserNey]) -> None:
        self.size = len(models)
        self.gram = [self._joined([m.gram[k] for m in models], np.nan) for k in range(ORDER)]
        self.back = [self._joined([m.back[k] for m in models], 0.0) for k in range(1, ORDER)]
        self.least = np.array([m.back[0] for m in models], np.float32)
        self.unknown = np.array([m.unknown for m in models], np.float32)

    @staticmethod
    def _joined(tables: list[Table], missing: float) -> tuple[np.ndarray, np.ndarray]:
        """Keys, and values with a last row for keys that no language has."""
        keys = np.unique(np.concatenate([t.keys for t in tables])) if tables else np.zeros(0, U64)
        values = np.full((len(keys) + 1, len(tables)), missing, np.float32)
        for k, t in enumerate(tables):
            values[np.searchsorted(keys, t.keys), k] = t.values
        return keys, values

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], wanted: np.ndarray) -> np.ndarray:
        keys, values = table
        if not len(keys):
            return values[np.zeros(len(wanted), np.int64)]
        at = np.searchsorted(keys, wanted)
        at[keys[np.minimum(at, len(keys) - 1)] != wanted] = len(keys)
        return values[at]

    def logs(self, own: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
        """Log probability of each character in each language; hashes of the n-grams of orders 1.. that end there, and before there."""
        out = np.zeros((len(own[0]), self.size), np.float32)
        rows, todo = np.arange(len(out)), np.ones(out.shape, bool)
        for order in range(ORDER, 0, -1):
            value = self._find(self.gram[order - 1], own[order - 1][rows])
            there = todo & ~np.isnan(value)
            todo &= ~there
            change = np.where(there, value, 0)
            left = todo.any(axis=1)
            if left.any():
                weight = self._find(self.back[order - 2], contexts[order - 2][rows[left]]) if order > 1 else self.least
                change[left] += np.where(todo[left], weight, 0)
            out[rows] += change
            rows, todo = rows[left], todo[left]
            if not len(rows):
                return out
        out[rows] += np.where(todo, self.unknown, 0)
        return out


def spelled(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(f"{OPEN * (ORDER - 1)}{w}{CLOSE}" for w in words).encode("utf-32-le"), np.uint32)


class Judge:
    """Scores words once each while the memo lasts; a text's score is the sum over its words."""

    def __init__(self, models: Ensemble, most: int = 150_000) -> None:
        self.models, self.most = models, most
        self.place: dict[str, int] = {}
        self.logs = np.zeros((1 << 12, models.size))

    def learn(self, words: list[str]) -> None:
        for start in range(0, len(words), 1 << 14):
            some = words[start : start + (1 << 14)]
            codes = spelled(some)
            real = np.flatnonzero(codes != ord(OPEN))
            wide = codes.astype(U64)
            every = [hashes(wide, k) for k in range(1, ORDER + 1)]
            own, contexts = [h[real] for h in every], [h[real - 1] for h in every[:-1]]
            ends = np.cumsum([len(w) + 1 for w in some])
            n = len(self.place)
            while len(self.logs) < n + len(some):
                self.logs = np.concatenate([self.logs, np.zeros_like(self.logs)])
            self.logs[n : n + len(some)] = np.add.reduceat(self.models.logs(own, contexts), np.concatenate([[0], ends[:-1]]), axis=0)
            self.place.update(zip(some, range(n, n + len(some))))

    def __call__(self, texts: list[str]) -> Iterator[tuple[np.ndarray, int]]:
        """Cross-entropy per character for each model, and the number of letters, of each text. Learns the words of some texts at once."""
        for start in range(0, len(texts), TOGETHER):
            some = [LETTERS.findall(t.lower()) for t in texts[start : start + TOGETHER]]
            if len(self.place) > self.most:
                self.place.clear()
            self.learn([w for w in dict.fromkeys(chain.from_iterable(some)) if w not in self.place])
            for words in some:
                if not words:
                    yield np.zeros(self.models.size), 0
                    continue
                at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
                letters = len("".join(words))
                yield -self.logs[at].sum(axis=0) / (letters + len(words)), letters


def count_grams(docs: DataFrame) -> DataFrame:
    """(label, gram, n) of all texts of ``docs`` (label, text), summed over partitions."""

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = defaultdict(Counter)

        def flush():
            grams: Counter = Counter()
            for label, some in words.items():
                for w, n in some.items():
                    w = f"{OPEN * (ORDER - 1)}{w}{CLOSE}"
                    for i in range(len(w) - ORDER + 1):
                        grams[label, w[i : i + ORDER]] += n
            words.clear()
            items = list(grams.items())
            for k in range(0, len(items), 20_000):
                part = items[k : k + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array([x[0][0] for x in part], pa.string()), pa.array([x[0][1] for x in part], pa.string()), pa.array([x[1] for x in part], pa.int64())], names=["label", "gram", "n"])

        for batch in batch_iter:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words[label].update(LETTERS.findall(text.lower()))
            if sum(map(len, words.values())) > 200_000:
                yield from flush()
        yield from flush()
        released()

    return docs.mapInArrow(run, "label string, gram string, n long").groupBy("label", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame) -> tuple[list[str], list[KneserNey]]:
    """Models of every label of ``docs`` (label, text), in the order of the labels."""
    grams = count_grams(docs).filter("n > 0").persist()
    labels = [r["label"] for r in grams.select("label").distinct().limit(LANGUAGES + 1).collect()]
    if len(labels) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    every = grams.toArrow() if labels else None
    grams.unpersist()
    counts: dict[str, dict[str, int]] = {k: {} for k in sorted(labels)}
    if every is not None:
        for part in every.to_batches():
            for label, gram, n in zip(*(part.column(c).to_pylist() for c in ("label", "gram", "n"))):
                counts[label][gram] = n
    alphabet = len({g[-1] for c in counts.values() for g in c})
    return list(counts), [KneserNey(c, alphabet) for c in counts.values()]


def of(column: str, values: dict) -> Column:
    """What ``values`` hold for the column."""
    return F.create_map(*[F.lit(x) for item in values.items() for x in item])[F.col(column)]


def limits(scored: DataFrame) -> dict[str, float]:
    """For each label of ``scored`` (label, value): the value of rank ceil(0.999 n) among all its n, plus two standard deviations.

    Exact: rows are counted in steps of 2^-12, those of the step that holds the rank in steps of 2^-32, those of
    that step by value. So a task holds counts of a label's steps, whose number doesn't follow that of its rows.
    """
    whole = {r["label"]: r for r in scored.groupBy("label").agg(F.count("*").alias("n"), F.stddev_pop("value").alias("s")).collect()}
    rank = {k: -(-999 * r["n"] // 1000) for k, r in whole.items()}
    at: dict[str, float] = {}
    for step in (F.floor(F.col("value") * float(1 << 12)), F.floor(F.col("value") * float(1 << 32)), F.col("value")) if whole else ():
        counts = scored.groupBy("label", step.alias("step")).agg(F.count("*").alias("n"))
        counts = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("label").orderBy("step")))
        found = counts.filter((F.col("upto") >= of("label", rank)) & (F.col("upto") - F.col("n") < of("label", rank))).collect()
        rank = {r["label"]: rank[r["label"]] - (r["upto"] - r["n"]) for r in found}
        at = {r["label"]: r["step"] for r in found}
        scored = scored.filter(step == of("label", at))
    return {k: float(v) + whole[k]["s"] * 2 for k, v in at.items()}


def identify(docs: DataFrame, learning: Column, text: str = "text", label: str = "lang", key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score, cross_entropy, rejected) of every row.

    Learns from the rows where ``learning`` holds and label and text are not null. ``und`` with score 0 if the text is null or has no
    letter, or if nothing could be learned; else the learned language of lowest cross-entropy (ties: the first by name), and its
    posterior as score. ``rejected``: the cross-entropy is above the limit of that language (``limits``), from all its learning texts
    that are recognised. Repeated rows and null keys give a row each; extra columns are not read. Scores are stored by a checkpoint.
    """
    spark = docs.sparkSession
    body = docs[text].cast("string")
    taught = F.when(learning & docs[text].isNotNull(), docs[label].cast("string"))
    names, models = fit(docs.select(taught.alias("label"), body.alias("body")).filter("label is not null"))
    shared = spark.sparkContext.broadcast(Ensemble(models))
    kind = docs.select(key).schema[0].dataType.simpleString()

    def make():
        judge = Judge(shared.value)

        def work(part: pa.RecordBatch):
            rows = []
            for entropy, letters in judge(part.column(2).fill_null("").to_pylist()):
                if names and letters:
                    best = int(entropy.argmin())
                    rows.append((names[best], float(1 / np.exp(np.maximum((entropy[best] - entropy) * letters, -700)).sum()), float(entropy[best])))
                else:
                    rows.append(("und", 0.0, None))
            yield {"k": part.column(0), "label": part.column(1), **{c: [r[i] for r in rows] for i, c in enumerate(("lang_pred", "score", "cross_entropy"))}}

        return work

    out = checkpoint(batches(docs.select(docs[key].alias("k"), taught.alias("label"), body.alias("body")), f"k {kind}, label string, lang_pred string, score double, cross_entropy double", make))
    usual = limits(out.filter("label = lang_pred and cross_entropy is not null").select("label", F.col("cross_entropy").alias("value"))) if names else {}
    limit = of("lang_pred", usual) if usual else F.lit(None).cast("double")
    return out.select(F.col("k").alias(key), "lang_pred", "score", "cross_entropy", F.coalesce(F.col("cross_entropy") > limit, F.lit(False)).alias("rejected"))


def held_out(key: Column) -> Column:
    """crc32 of the key's text, mod 4, is 2; null keys are not held out."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def with_held_out(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``identify`` learning from the rest of ``held_out``, with that flag; rows of null keys teach nothing."""
    found = identify(docs, docs[key].isNotNull() & ~held_out(docs[key]), key=key)
    return found.select(key, held_out(found[key]).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
