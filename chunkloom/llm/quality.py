"""Quality classifier from weak labels: overlapping heuristic labellers, expectation-maximisation, a hashed linear scorer.

Each labeller reads a whole text and votes good or bad, or abstains. The votes of all documents are counted by pattern (at most
3^labellers patterns, whatever the number of documents), and expectation-maximisation on those counts estimates how often each
labeller is right about either class, and every pattern's posterior of being good. The posteriors are the labels on which
a logistic scorer over hashed word shapes is trained, by a sample of at most about ``SAMPLE`` documents. Two narrow passes, one shuffle of counts.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, checkpoint, released

#: Characters of the words that a worker remembers at most.
REMEMBERED = 4 << 20
#: Hashes that a draw tells apart.
DRAWS = 1 << 30
#: Documents that train the scorer, about; hash buckets of its features; rounds of expectation-maximisation and of its training.
SAMPLE, BUCKETS, EM_ROUNDS, TRAIN_ROUNDS = 8_192, 1 << 12, 200, 300
#: Fewer words than this tell too little for votes on shares.
FEW = 12
ABSTAIN, GOOD, BAD = 0, 1, 2
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: On kinds of characters: a word of ordinary prose (letters or digits, with punctuation around or inside), and a sentence's end.
PLAIN = re.compile(r"[\"'(\[«„“‘¿¡]*[aAx0]+(?:[-'’.,:/@_+]+[aAx0]+)*[\"')\]»”’.,;:?!…%]{0,3}")
END = re.compile(r"[.?!…][\"')\]»”’]*$")
#: At most, from this on: (labeller, share up to which it votes good, share from which it votes bad).
LABELLERS = (
    ("symbols", 0.02, 0.08),  # characters that are no letters, digits, or common punctuation
    ("capitals", 0.25, 0.60),  # upper case among letters
    ("outcries", 0.05, 0.30),  # words that end in two exclamation marks or more
    ("wordless", 0.05, 0.20),  # words without a letter or digit
    ("stutter", 0.05, 0.30),  # words equal to the word before
    ("monotony", 0.20, 0.60),  # words equal to one of the eight before, beyond what prose has
    ("odd_words", 0.10, 0.40),  # words that aren't plain
    ("unpunctuated", 0.95, 0.999),  # words since the last sentence end, in runs beyond a hundred
)


class Kinds(dict):
    """For str.translate: a lower-case letter, A upper-case letter, x another letter, 0 digit; other characters are themselves."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = kind = "a" if c.islower() else "A" if c.isupper() else "x" if c.isalpha() else "0" if c.isalnum() else c
        return kind


class Lexicon:
    """Facts of words by their kinds of characters, found once for each row of kinds while the memo lasts."""

    FACTS = 8  # characters, letters, capitals, symbols, outcry, wordless, odd, sentence end

    def __init__(self, most: int = 100_000) -> None:
        self.most, self.kinds = most, Kinds()
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.held = 0
        self.facts = np.zeros((1 << 12, self.FACTS), np.int32)
        self.shape = np.zeros(1 << 12, np.int64)

    def of(self, text: str) -> np.ndarray:
        """Places of the text's words."""
        if len(self.place) > self.most or self.held > REMEMBERED:
            self.clear()
        rows, place = WORD.findall(text.translate(self.kinds)), self.place
        new = set(rows).difference(place)
        n = len(place)
        while len(self.shape) < n + len(new):
            self.facts, self.shape = np.concatenate([self.facts, np.zeros_like(self.facts)]), np.concatenate([self.shape, np.zeros_like(self.shape)])
        for i, w in enumerate(new, n):
            place[w] = i
            self.held += len(w)
            letters = sum(map(w.count, "aAx"))
            known = letters + w.count("0")
            self.facts[i] = (len(w), letters, w.count("A"), len(w) - known - sum(map(w.count, ".,;:!?'\"()-–—’“”„«»¿¡…")), w.endswith("!!"), not known, not PLAIN.fullmatch(w), END.search(w) is not None)
            self.shape[i] = zlib.crc32(shape(w).encode())
        return np.fromiter(map(place.__getitem__, rows), np.int64, len(rows))


def shape(kinds: str) -> str:
    """Runs of at most two of the characters' kinds: ``Hello!!!`` is ``Aaa!!``."""
    return re.sub(r"(.)\1\1+", r"\1\1", kinds)


def shares(word: np.ndarray, facts: np.ndarray) -> np.ndarray | None:
    """The share that each labeller looks at; none if the text is too short. ``word`` tells words apart."""
    n = len(word)
    if n < FEW:
        return None
    chars, letters, capitals, symbols, outcries, wordless, odd, _ = (facts[:, k].sum() for k in range(Lexicon.FACTS))
    stutter = (word[1:] == word[:-1]).mean()
    near = np.zeros(n, bool)
    for d in range(1, 9):
        near[d:] |= word[d:] == word[:-d]
    stops = np.concatenate([[0], np.flatnonzero(facts[:, 7]) + 1, [n]])
    runs = np.diff(stops)
    return np.array([symbols / chars, capitals / max(1, letters), outcries / n, wordless / n, stutter, near.mean(), odd / n, runs[runs > 100].sum() / n])


def votes(share: np.ndarray | None) -> tuple[int, ...]:
    if share is None:
        return (ABSTAIN,) * len(LABELLERS)
    return tuple(GOOD if x <= low else BAD if x >= high else ABSTAIN for x, (_, low, high) in zip(share.tolist(), LABELLERS))


def features(word: np.ndarray, shapes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets and weights: counts of word shapes, of pairs of shapes, and of words that repeat the last: roots of their shares of FEW words more than the text has."""
    n = len(word)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0)
    same = word[1:] == word[:-1]
    pairs = (shapes[1:] * 1_000_003 + shapes[:-1]) ^ (shapes[1:] >> 7)
    parts = [shapes % BUCKETS, pairs % BUCKETS, np.full(int(same.sum()), zlib.crc32(b"same as before") % BUCKETS)]
    total = np.sqrt(np.bincount(np.concatenate(parts), minlength=BUCKETS) / (n + FEW))
    some = np.flatnonzero(total)
    return some, total[some]


class Reader:
    def __init__(self) -> None:
        self.lexicon = Lexicon()

    def __call__(self, text: str | None, with_votes: bool = True, with_features: bool = True):
        text = text or ""
        at = self.lexicon.of(text)
        words = WORD.findall(text)
        word = np.fromiter(map(hash, words), np.int64, len(words))
        own = votes(shares(word, self.lexicon.facts[at])) if with_votes else None
        return own, features(word, self.lexicon.shape[at]) if with_features else None


def _posteriors(patterns: np.ndarray, rate: np.ndarray, share: float) -> np.ndarray:
    odds = np.log(share / (1 - share)) + (patterns == GOOD) @ np.log(rate[1] / rate[0]) + (patterns == BAD) @ np.log((1 - rate[1]) / (1 - rate[0]))
    return 1 / (1 + np.exp(-np.clip(odds, -60, 60)))


def agree(patterns: np.ndarray, counts: np.ndarray, rounds: int = EM_ROUNDS) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation over vote patterns: posteriors of good, P(vote good | class) per labeller, P(good).

    Starts from the share of good votes. A prior of ten documents a class keeps accuracies off 0 and 1, and says that labellers
    rarely blame good documents and see about a third of the bad ones. A pattern of abstentions alone has P(good).
    """
    good, bad = (patterns == GOOD).astype(float), (patterns == BAD).astype(float)
    posterior = np.where(bad.any(axis=1), 0.1, 0.98)
    prior = {1: (9.9, 0.1), 0: (6.5, 3.5)}
    rate, share = np.zeros((2, patterns.shape[1])), 0.5
    for _ in range(rounds):
        for c, weight in ((1, posterior * counts), (0, (1 - posterior) * counts)):
            g, b = weight @ good + prior[c][0], weight @ bad + prior[c][1]
            rate[c] = g / (g + b)
        share = float((posterior @ counts + 9) / (counts.sum() + 10))
        new = _posteriors(patterns, rate, share)
        if np.abs(new - posterior).max(initial=0) < 1e-9:
            break
        posterior = new
    return posterior, rate, share


def train(rows: list[tuple[np.ndarray, np.ndarray]], wanted: np.ndarray, copies: np.ndarray | None = None, rounds: int = TRAIN_ROUNDS) -> np.ndarray:
    """Weights of the buckets, then the bias, of a ridge logistic regression on soft labels of rows that there are several ``copies`` of.

    Both classes weigh the same in training; the bias is then shifted to their true shares.
    """
    sizes = [len(b) for b, _ in rows]
    of = np.repeat(np.arange(len(rows)), sizes)
    bucket = np.concatenate([b for b, _ in rows]).astype(np.int64) if rows else np.zeros(0, np.int64)
    value = np.concatenate([v for _, v in rows]) if rows else np.zeros(0)
    copies = np.ones(len(rows)) if copies is None else copies
    ones, zeros = max(1e-9, (copies * wanted).sum()), max(1e-9, (copies * (1 - wanted)).sum())
    up, down = 0.5 * copies * wanted / ones, 0.5 * copies * (1 - wanted) / zeros
    weights, fast, step = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1), 2.0
    if not len(rows):
        weights[-1] = 1.0
        return weights
    for k in range(rounds):
        z = np.bincount(of, fast[bucket] * value, len(rows)) + fast[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        slope = p * down - (1 - p) * up
        grad = np.append(np.bincount(bucket, slope[of] * value, BUCKETS), slope.sum()) + np.append(1e-5 * fast[:-1], 1e-3 * (fast[-1] - 1))
        new = fast - step * grad
        fast, weights = new + k / (k + 3) * (new - weights), new
    weights[-1] += np.log(max(1.0, ones) / max(1.0, zeros))
    return weights


@dataclass
class Model:
    """What ``fit`` learns: how often labellers say good about either class, the share of good documents, and the scorer."""

    rate: np.ndarray  # P(says good | bad), P(says good | good), per labeller that doesn't abstain
    share: float
    weights: np.ndarray

    def posterior(self, said: tuple[int, ...]) -> float:
        return float(_posteriors(np.array([said]), self.rate, self.share)[0])

    def score(self, bucket: np.ndarray, value: np.ndarray) -> float:
        z = float(self.weights[bucket] @ value + self.weights[-1])
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE, key: str = "doc_id") -> Model:
    """Reads all texts once. The driver gets vote patterns with counts, and the features of a bounded sample of texts.

    Rows are drawn by a hash of key and text, however the table is split; rows that agree in both are drawn together, as one with a weight.
    """
    body = docs[text].cast("string")
    base = docs.select(body.alias("body"), F.xxhash64(*[docs[c].cast("string") for c in (key,) if c in docs.columns], body).alias("own"))
    total = base.count()
    limit = math.ceil(min(1.0, sample / max(1, total)) * DRAWS)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, seen, drawn = Reader(), Counter(), Counter()
        schema = pa.schema([("pattern", pa.list_(pa.int32())), ("n", pa.int64()), ("own", pa.int64()), ("copies", pa.int64()), ("bucket", pa.list_(pa.int32())), ("value", pa.list_(pa.float64()))])

        def ready(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for part in parts:
            rows = []
            for body, own in zip(part.column(0), part.column(1).to_pylist()):
                chosen = own % DRAWS < limit
                said, found = read(body.as_py(), with_features=chosen and own not in drawn)
                seen[said] += 1
                if chosen:
                    drawn[own] += 1
                    if found:
                        rows.append((list(said), 0, own, 0, found[0].tolist(), found[1].tolist()))
            if rows:
                yield ready(rows)
        if drawn:
            yield ready([(None, 0, own, n, None, None) for own, n in drawn.items()])
        if seen:
            yield ready([(list(p), n, None, 0, None, None) for p, n in seen.items()])
        released()

    votes_of = checkpoint(base.mapInArrow(run, "pattern array<int>, n long, own long, copies long, bucket array<int>, value array<double>"))
    counted = votes_of.filter("n > 0").groupBy("pattern").agg(F.sum("n").alias("n")).toArrow()
    patterns = counted["pattern"].to_pylist()
    order = sorted(range(len(patterns)), key=patterns.__getitem__)
    matrix = np.array([patterns[i] for i in order], int).reshape(len(order), len(LABELLERS))
    posterior, rate, good = agree(matrix, np.array(counted["n"].to_pylist(), float)[order])
    of = dict(zip(map(tuple, matrix.tolist()), posterior.tolist()))
    some = votes_of.filter("own is not null").groupBy("own").agg(F.sum("copies").alias("copies"), *[F.first(c, ignorenulls=True).alias(c) for c in ("pattern", "bucket", "value")]).toArrow()
    # texts on which nobody voted have no label to learn from
    rows = sorted(r for r in zip(*(some[c].to_pylist() for c in ("pattern", "own", "bucket", "value", "copies"))) if any(r[0]))
    weights = train([(np.array(b, np.int64), np.array(v)) for _, _, b, v, _ in rows], np.array([of[tuple(r[0])] for r in rows]), np.array([float(r[-1]) for r in rows]))
    return Model(rate, good, weights)


def classify(docs: DataFrame, model: Model | None = None, text: str = "text", least: float = 0.5, key: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """Adds quality_votes, quality_posterior, quality_score and quality_kept to every row, of which the columns ``carry`` stay (all, if not given).

    Votes are one character a labeller, in the order of ``LABELLERS``: ``+`` good, ``-`` bad, ``.`` none. The posterior is that of the
    votes, the score that of the trained scorer, and rows are kept from a score of ``least`` on. Null and empty texts have no words: every
    labeller abstains, the posterior is the share of good documents and the score the scorer's bias. Texts under FEW words get no votes. Rows
    are judged one by one, so repeated rows get the same result; an empty table gives no rows; columns of the four names are replaced.
    """
    added = ("quality_votes", "quality_posterior", "quality_score", "quality_kept")
    model = model or fit(docs, text, key=key)
    keep = [c for c in (docs.columns if carry is None else carry) if c not in added]
    # the text goes to the workers once, and comes back as it went if it stays
    apart = text in keep and docs.schema[text].dataType.simpleString() == "string"
    inner = docs.select(F.struct(F.lit(0).alias("nothing"), *[docs[c] for c in keep if not (apart and c == text)]).alias("row"), docs[text].cast("string").alias("body"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        read, own = Reader(), shared.value
        posterior = lru_cache(10_000)(own.posterior)

        def work(part: pa.RecordBatch):
            out: list[tuple] = []
            for body in part.column(1):
                said, found = read(body.as_py())
                score = own.score(*found)
                out.append(("".join(".+-"[v] for v in said), posterior(said), score, score >= least))
            yield {"row": part.column(0), "body": part.column(1)} | {c: [x[k] for x in out] for k, c in enumerate(added)}

        return work

    schema = f"row {inner.schema['row'].dataType.simpleString()}, {'body string, ' * apart}quality_votes string, quality_posterior double, quality_score double, quality_kept boolean"
    out = batches(inner, schema, make)
    return out.select(*[F.col("body").alias(c) if apart and c == text else F.col("row").getField(c).alias(c) for c in keep], *added)


def accepted(docs: DataFrame, text: str = "text", least: float = 0.5, key: str = "doc_id") -> DataFrame:
    """The rows that the classifier keeps, with the columns of ``docs``; all else as in ``classify``."""
    found = classify(docs, None, text, least, key)
    return found.filter("quality_kept").select(*docs.columns)
