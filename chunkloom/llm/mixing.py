"""Mixing to target weights by soft membership, in DataFrame functions only.

A classifier learns domains from a labelled table and gives every document posteriors over the domains. Document i, of n_i words and
posteriors p_i, adds n_i * p_i * r_i expected words to the domains if it is taken r_i times. Projected gradient descent fits the rates
r_i >= 0 to target totals T: it lowers the sum over domains of e_k^2 / c_k, with e = (expected totals - T) and c the totals at rate 1. In the
metric of the documents' lengths the step is r_i - p_i . (e / c), and a step of one is safe, for the largest eigenvalue of that problem is one.

Each round is one aggregate to as many sums as there are domains; rates stay in the cluster and are cut by checkpoints. The model has
domains * BUCKETS numbers, whatever the number of documents.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: Rows of the labelled table that the classifier is fitted on, about; hash buckets of words; domains at most.
LABELLED, BUCKETS, DOMAINS = 4_096, 1 << 11, 64
#: Words of evidence that a text counts for at most, whatever its length: words of one text aren't independent, so that the sum over all
#: of them would make every posterior 0 or 1. A fixed parameter that says how soft memberships are; it isn't fitted.
#: Rounds at most, rounds between checkpoints, relative error of totals.
EVIDENCE, ROUNDS, NESTED, CLOSE = 24.0, 64, 8, 1e-4


def _words(text: Column) -> Column:
    """Lower-cased words between white space; an empty array if there are none."""
    body = F.lower(F.coalesce(text, F.lit("")))
    body = F.btrim(body, F.lit(" \t\n\u000b\f\r"))
    return F.when(body != "", F.split(body, r"[\x20\x09-\x0D]+")).otherwise(F.expr("cast(array() as array<string>)"))


def _bucket(word: Column) -> Column:
    return F.pmod(F.hash(word), F.lit(BUCKETS))


def _numbers(values: list[float]) -> Column:
    """A literal array; folded once while planning."""
    return F.split(F.lit(" ".join(map(repr, values))), " ").cast("array<double>")


def _adding(values: list[float]):
    table = _numbers(values)
    return lambda total, place: total + F.get(table, place)


@dataclass
class Classifier:
    """Naive Bayes over hashed words: log odds of each domain against the first."""

    domains: list[str]
    prior: list[float]
    odds: list[list[float]]

    def add(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """Adds n_words and posterior (an array in the order of ``domains``, of sum one)."""
        rest = [c for c in docs.columns if c not in ("n_words", "posterior")]
        rows = docs.select(F.struct(*rest).alias("row"), F.transform(_words(docs[text].cast("string")), _bucket).alias("at"))
        n = F.size("at")
        # a text counts as at most EVIDENCE words, whatever its length
        weight = F.least(F.lit(1.0), EVIDENCE / F.greatest(n, F.lit(1)))
        sums = [F.aggregate("at", F.lit(0.0), _adding(t)) for t in self.odds[1:]]
        rows = rows.select("row", n.cast("long").alias("n_words"), weight.alias("weight"), *[s.alias(f"s{k}") for k, s in enumerate(sums, 1)])
        logs = [math.log(self.prior[0])] + [math.log(p) + F.col("weight") * F.col(f"s{k}") for k, p in enumerate(self.prior[1:], 1)] if self.domains else []
        rows = rows.select("row", "n_words", F.array(*map(F.lit, logs)).cast("array<double>").alias("logs"))
        shifted = F.transform("logs", lambda x: F.exp(x - F.array_max("logs")))
        rows = rows.select("row", "n_words", shifted.alias("e")).select("row", "n_words", F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda a, b: a + b)).alias("posterior"))
        return rows.select(*[F.col("row").getField(c).alias(c) for c in rest], "n_words", "posterior")


def fit(labelled: DataFrame, text: str = "text", domain: str = "lang", key: str = "doc_id", most: int = LABELLED) -> Classifier:
    """Learns from about ``most`` rows of the labelled table, drawn by a hash of key and text.

    Rows without a domain or text teach nothing, and neither do those of domains beyond the DOMAINS commonest ones of the draw.
    """
    known = labelled.filter(labelled[domain].isNotNull() & labelled[text].isNotNull()).select(labelled[domain].cast("string").alias("domain"), labelled[text].cast("string").alias("body"), F.xxhash64(labelled[key].cast("string"), labelled[text].cast("string")).alias("h"))
    share = min(1.0, most / max(1, known.count()))
    drawn = known.filter(F.pmod("h", F.lit(1 << 30)) <= int(share * (1 << 30)))
    # one row a document with bucket -1 counts documents; at most DOMAINS * (BUCKETS + 1) rows reach the driver
    marks = drawn.select("domain", F.explode(F.concat(F.array(F.lit(-1)), F.transform(_words(F.col("body")), _bucket))).alias("bucket"))
    common = [r["domain"] for r in drawn.groupBy("domain").count().orderBy(F.desc("count"), "domain").limit(DOMAINS).collect()]
    rows = marks.filter(F.col("domain").isin(common)).groupBy("domain", "bucket").count().collect() if common else []
    domains = sorted({r["domain"] for r in rows})
    place = {d: k for k, d in enumerate(domains)}
    counts, docs = [[0.5] * BUCKETS for _ in domains], [0] * len(domains)
    for r in rows:
        if r["bucket"] < 0:
            docs[place[r["domain"]]] = r["count"]
        else:
            counts[place[r["domain"]]][r["bucket"]] += r["count"]
    logs = [[math.log(x / total) for x in c] for c in counts for total in [sum(c)]]
    return Classifier(domains, [d / sum(docs) for d in docs], [[a - b for a, b in zip(row, logs[0])] for row in logs])


def _totals(soft: DataFrame, k: int, rate: Column) -> list[float]:
    row = soft.agg(*[F.sum(F.col("n_words") * F.get("posterior", F.lit(i)) * rate).alias(f"t{i}") for i in range(k)]).first()
    return [float(row[f"t{i}"] or 0.0) for i in range(k)]


def fit_rates(soft: DataFrame, domains: list[str], targets: dict[str, float], most: float | None = None) -> tuple[DataFrame, list[list[float]], float]:
    """Adds ``rate`` to rows with n_words and posterior; also the gradients e / c of the rounds that lead there, and what error is left.

    The error is that of the domain total that is furthest off, relative to its total at rate one: above CLOSE where no rates reach the targets.

    The totals of domains in ``targets`` should become ``targets[domain] / sum(targets)`` of the words they have; with ``most``, no rate is above it, and the totals
    aim at the largest corpus of those shares that rates up to ``most`` allow. Domains without a target keep their totals.
    """
    k = len(domains)
    weights = [max(0.0, float(targets.get(d, 0.0))) for d in domains]
    if not k or not sum(weights):
        return soft.withColumn("rate", F.lit(1.0)), [], 0.0
    weights = [w / sum(weights) for w in weights]
    full = _totals(soft, k, F.lit(1.0))
    size = sum(c for c, d in zip(full, domains) if d in targets) if most is None else min(c * most / w for c, w in zip(full, weights) if w)
    goal = [w * size if d in targets else c for w, c, d in zip(weights, full, domains)]
    state, steps, since = soft.withColumn("rate", F.lit(1.0)), [], 0
    rate = F.col("rate")
    totals, best, worst = full, math.inf, math.inf
    for turn in range(ROUNDS + 1):
        error = [t - g for t, g in zip(totals, goal)]
        worst = max(abs(e) / max(1.0, c) for e, c in zip(error, full))
        if worst <= CLOSE or worst > best * 0.999 or turn == ROUNDS:
            break  # close enough, or targets that no rates reach
        best = worst
        steps.append([e / c if c > 0 else 0.0 for e, c in zip(error, full)])
        rate, since = _step(rate, steps[-1], most), since + 1
        if since == NESTED:
            state, since = checkpoint(state.withColumn("rate", rate)), 0
            rate = F.col("rate")
        totals = _totals(state, k, rate)
    return state.withColumn("rate", rate), steps, worst


def _step(rate: Column, slope: list[float], most: float | None) -> Column:
    moved = F.greatest(F.lit(0.0), rate - sum((F.get("posterior", F.lit(i)) * F.lit(g) for i, g in enumerate(slope)), F.lit(0.0)))
    return moved if most is None else F.least(F.lit(float(most)), moved)


def copies(rate: Column, *key: Column) -> Column:
    """How often a document is taken: the whole part of its rate, and once more for the share of hashes below the rest."""
    draw = F.pmod(F.xxhash64(F.lit("mixing"), *key), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def rates(docs: DataFrame, targets: dict[str, float], text: str = "text", domain: str = "lang", key: str = "doc_id", labelled: DataFrame | None = None, most: float | None = None) -> DataFrame:
    """(key, n_words, domain_posterior, rate, copies, target_error) of every row.

    ``domain_posterior`` is a map from the domains, by name; ``target_error``, the same in all rows, is how far from its target the worst
    domain total stays (see ``fit_rates``). Null and empty texts have no words, the prior as posterior, and a rate like any
    other. Equal rows get equal results, so repeated rows and keys and null keys give a row each. Without labelled rows, or targets for
    them, every rate is one. An empty table gives no rows; extra columns are not read.
    """
    model = fit(docs if labelled is None else labelled, text, domain, key)
    soft = model.add(docs.select(docs[key].alias("row_key"), docs[text].cast("string").alias("body"), F.xxhash64(docs[text].cast("string")).alias("h")), "body").drop("body")
    found, _, error = fit_rates(checkpoint(soft), model.domains, targets, most)
    names = F.array(*map(F.lit, model.domains)).cast("array<string>")
    return found.select(F.col("row_key").alias(key), "n_words", F.map_from_arrays(names, "posterior").alias("domain_posterior"), "rate", copies(F.col("rate"), F.col("row_key").cast("string"), F.col("h")).alias("copies"), F.lit(error).alias("target_error"))


def mixed(docs: DataFrame, targets: dict[str, float], text: str = "text", domain: str = "lang", key: str = "doc_id", labelled: DataFrame | None = None, most: float | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as its rate says: with ``most`` at 1, a subset that has the target shares.

    The rates are a function of text and key by what was fitted, so the texts are read once more rather than shuffled.
    """
    model = fit(docs if labelled is None else labelled, text, domain, key)
    soft = checkpoint(model.add(docs.select(docs[text].cast("string").alias("body")), "body").select("n_words", "posterior"))
    _, steps, _ = fit_rates(soft, model.domains, targets, most)
    found = model.add(docs.select(F.struct(*docs.columns).alias("whole"), docs[text].cast("string").alias("body"), docs[key].cast("string").alias("row_key")), "body")
    found = found.withColumn("rate", F.lit(1.0))
    for start in range(0, len(steps), NESTED):
        rate = F.col("rate")
        for slope in steps[start : start + NESTED]:
            rate = _step(rate, slope, most)
        found = found.withColumn("rate", rate)
    # an outer explode: the optimiser would copy the whole expression of a plain one's count, or of a filter on it, below the projections
    times = copies(F.col("rate"), F.col("row_key"), F.xxhash64("body"))
    taken = found.select("whole", times.alias("times")).select(F.explode_outer(F.array_repeat("whole", F.col("times").cast("int"))).alias("row")).filter("row is not null")
    return taken.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
