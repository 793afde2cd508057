"""Question answering over retrieved chunks: prompts, generation, judging, reports. Models are functions from prompts to texts."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.batches import add_columns
from ..functions.text import Counter, count_words
from ..session import stored
from .splitters import combine_blocks

REFUSAL = "I cannot answer"
#: The names of judged metrics.
COMPLETENESS, CORRECTNESS, RELEVANCY = "Retrieval Completeness", "Answer Correctness", "Contextual Relevancy"
Complete = Callable[[str], str]


def completed(df: DataFrame, prompt: Column, make_model: Callable[[], Complete], out: str) -> DataFrame:
    """Adds a model's answer to every row; an answer that fails is null, with its error in ``<out>_error``."""

    def make():
        ask = make_model()

        def work(text: str | None):
            if text is None:
                return None, None
            try:
                return ask(text), None
            except Exception as e:  # noqa: BLE001  services raise errors of their own
                return None, str(e)

        return work

    return add_columns(df, [prompt], f"{out} string, {out}_error string", make)


def with_context(docs: DataFrame, most: int = 10_000, count: Counter = count_words) -> DataFrame:
    """Adds ``context``: the first lines of a document up to so many tokens."""

    def make():
        return lambda text: (combine_blocks((text or "").splitlines(keepends=True), most, count),)

    return add_columns(docs, [F.col("full_text")], "context string", make)


def qa_pairs(docs: DataFrame, make_model: Callable[[], Complete], per_doc: int = 3, most: int = 10_000, count: Counter = count_words) -> DataFrame:
    """(id, doc_name, question, answer): pairs that a model writes for each document as a JSON array; ids from 1 in order of documents.

    Documents whose answer isn't such an array have none. The numbering adds an offset a document to a place in it, so no window spans all rows.
    """
    prompt = F.concat(F.lit(f"Write {per_doc} question and answer pairs about the document as a JSON array of objects with question and answer.\n\n<Document>\n"), F.col("context"), F.lit("\n</Document>"))
    said = completed(with_context(docs.select("doc_name", "full_text"), most, count), prompt, make_model, "answer_text")
    pairs = said.select("doc_name", F.from_json("answer_text", "array<struct<question:string,answer:string>>").alias("pairs"))
    rows = pairs.select("doc_name", F.posexplode("pairs").alias("place", "pair")).select("doc_name", "place", "pair.question", "pair.answer")
    return numbered(stored(rows), ["doc_name", "place"]).select("id", "doc_name", "question", "answer")


def numbered(df: DataFrame, order: list[str], start: int = 1) -> DataFrame:
    """Adds ``id``, counting rows in order: rows are range-partitioned, and each partition's offset is the rows before it."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    local = ranged.withColumn("place_in_part", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    offsets = local.groupBy("part").agg(F.count("*").alias("n"))
    offsets = offsets.withColumn("offset", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    return local.join(F.broadcast(offsets.select("part", "offset")), "part").withColumn("id", (F.col("place_in_part") + F.coalesce("offset", F.lit(0)) + start - 1).cast("long")).drop("part", "place_in_part", "offset")


def summaries(docs: DataFrame, make_model: Callable[[], Complete], most: int = 10_000, count: Counter = count_words) -> DataFrame:
    """(doc_name, summary)."""
    prompt = F.concat(F.lit("Summarise the document.\n\n<Document>\n"), F.col("context"), F.lit("\n</Document>"))
    return completed(with_context(docs.select("doc_name", "full_text"), most, count), prompt, make_model, "summary").select("doc_name", "summary")


def in_groups(queries: DataFrame, size: int = 5) -> DataFrame:
    """(group, queries): ``size`` queries a row, in order of their ids from 0."""
    rows = numbered(queries.select("query_id", "query_text"), ["query_id"], 0)
    return rows.groupBy(F.floor(F.col("id") / size).alias("group")).agg(F.array_sort(F.collect_list(F.struct("query_id", "query_text"))).alias("queries"))


def relevant_queries(queries: DataFrame, summary_text: str, make_model: Callable[[], Complete], size: int = 5) -> DataFrame:
    """(query_id, relevant, justification, query_text): a model judges groups of queries against all summaries.

    ``summary_text``, the joined summaries, is a prompt's part, so its size is the caller's to bound. Answers are JSON arrays of objects
    with query_id, relevant and justification; texts are put back by id.
    """
    groups = in_groups(queries, size)
    asked = F.array_join(F.transform("queries", lambda q: F.concat(q["query_id"].cast("string"), F.lit(": "), q["query_text"])), "\n")
    prompt = F.concat(F.lit(f"Which queries can these documents answer? Reply as a JSON array of objects with query_id, relevant, justification.\n\n{summary_text}\n\n"), asked)
    said = completed(groups, prompt, make_model, "verdict")
    rows = said.select(F.explode(F.from_json("verdict", "array<struct<query_id:long,relevant:boolean,justification:string>>")).alias("v")).select("v.*")
    return rows.join(queries.select("query_id", "query_text"), "query_id")


def combined_queries(real: DataFrame, generated: list[str] | str) -> DataFrame:
    """Real queries (generated = false) and generated ones (true, relevant, with the ids that follow)."""
    spark = real.sparkSession
    lines = [q.strip() for q in (generated.splitlines() if isinstance(generated, str) else generated)]
    lines = [q for q in lines if q]
    base = real.select("query_id", "relevant", "justification", "query_text", F.lit(False).alias("generated"))
    first = (real.agg(F.max("query_id")).first()[0] or 0) + 1
    more = spark.createDataFrame([(first + i, True, None, q, True) for i, q in enumerate(lines)], "query_id long, relevant boolean, justification string, query_text string, generated boolean")
    return base.unionByName(more)


def context_text(hits: Column) -> Column:
    """Retrieved chunks as numbered documents of a prompt."""
    one = F.transform(hits, lambda h, i: F.concat(F.lit("<Document, ID = "), (i + 1).cast("string"), F.lit(", name = "), F.coalesce(h["meta"]["doc_name"], F.lit("")), F.lit(">\n"), h["content"], F.lit("\n</Document>")))
    return F.array_join(one, "\n\n")


def generate(retrieved: DataFrame, make_model: Callable[[], Complete], template: str = "{context}\n\nQuestion: {question}") -> DataFrame:
    """Adds ``generated_output``; ``results`` become ``context_data``."""
    prompt = F.replace(F.replace(F.lit(template), F.lit("{context}"), context_text(F.col("results"))), F.lit("{question}"), F.col("query_text"))
    return completed(retrieved, prompt, make_model, "generated_output").drop("generated_output_error").withColumnRenamed("results", "context_data")


def completeness(level: Column, error: Column | None = None) -> Column:
    """0, 0.5 or 1 from a judge's level, clamped to 0..2; without a level, zero."""
    value = F.greatest(F.lit(0), F.least(F.lit(2), F.coalesce(level.cast("int"), F.lit(0)))) / 2
    return value if error is None else F.when(error.isNotNull(), 0.0).otherwise(value)


def evaluate(generated: DataFrame, make_judge: Callable[[], Callable[[str, str], str]], done: DataFrame | None = None, refusal: str = REFUSAL, threshold: float = 0.5, reference_free: bool = False) -> DataFrame:
    """Adds ``metrics`` and ``success``. The judge gets a metric's name and a prompt and answers JSON with level or score, and reason.

    With references: refusals and queries without a reference answer are judged for completeness alone, the others for correctness as
    well. Reference-free: relevancy, completeness and correctness are judged, and refusals keep null scores. Queries (by id) in ``done`` are left out.
    """
    rows = generated if done is None else generated.join(done.select("query_id").distinct(), "query_id", "left_anti")
    refused = F.contains(F.coalesce("generated_output", F.lit("")), F.lit(refusal))

    def make():
        judge = make_judge()

        def one(name: str, prompt: str) -> dict:
            try:
                said = json.loads(judge(name, prompt))
                if name == COMPLETENESS:
                    score = max(0, min(2, int(said.get("level", 0)))) / 2
                else:
                    score = None if said.get("score") is None else float(said["score"])
                return {"name": name, "score": score, "threshold": threshold, "success": score is not None and score >= threshold, "reason": said.get("reason"), "error": None}
            except Exception as e:  # noqa: BLE001
                score = 0.0 if name == COMPLETENESS else None
                return {"name": name, "score": score, "threshold": threshold, "success": False, "reason": None, "error": str(e)}

        def work(question, output, reference, context, no):
            prompt = f"Question: {question}\nReference: {reference}\nAnswer: {output}\nContext:\n{context}"
            if reference_free:
                names = (RELEVANCY, COMPLETENESS, CORRECTNESS)
                found = [{"name": n, "score": None, "threshold": threshold, "success": False, "reason": "refused", "error": None} for n in names] if no else [one(n, prompt) for n in names]
            else:
                missing = not question or not reference or not context
                zero = {"name": COMPLETENESS, "score": 0.0, "threshold": threshold, "success": False, "reason": "missing input", "error": None}
                found = [zero if missing else one(COMPLETENESS, prompt)] + ([] if no or not reference else [one(CORRECTNESS, prompt)])
            return found, bool(found) and all(m["success"] for m in found)

        return work

    shape = "metrics array<struct<name:string,score:double,threshold:double,success:boolean,reason:string,error:string>>, success boolean"
    return add_columns(rows, [F.col("query_text"), F.col("generated_output"), F.col("reference_answer"), context_text(F.col("context_data")), refused], shape, make)


def score_rows(evaluated: DataFrame) -> DataFrame:
    """(query_id, system, name, score) of evaluation rows with a ``system``."""
    return evaluated.select("query_id", "system", F.explode("metrics").alias("m")).select("query_id", "system", "m.name", "m.score")


def _spread(score: Column) -> list[Column]:
    """Mean and sample deviation of what isn't null; the deviation of one value is zero."""
    n = F.count(score)
    return [F.avg(score).alias("mean"), F.when(n > 1, F.stddev_samp(score)).when(n == 1, 0.0).alias("std"), n.alias("n")]


def union_report(scores: DataFrame, zero_if_missing: tuple[str, ...] = (RELEVANCY,)) -> DataFrame:
    """(system, name, mean, std, n): over queries with a score in any system; "Final" pools all scores.

    A null of a metric in ``zero_if_missing`` counts as zero where some system has that metric's score for the query, other nulls don't count.
    """
    some = F.max(F.col("score").isNotNull()).over(Window.partitionBy("query_id"))
    known = F.max(F.col("score").isNotNull()).over(Window.partitionBy("query_id", "name"))
    rows = scores.withColumn("some", some).withColumn("known", known).filter("some")
    rows = rows.withColumn("score", F.when(F.col("name").isin(*zero_if_missing) & F.col("known"), F.coalesce("score", F.lit(0.0))).otherwise(F.col("score")))
    each = rows.groupBy("system", "name").agg(*_spread(F.col("score")))
    return each.unionByName(rows.groupBy("system").agg(*_spread(F.col("score"))).select("system", F.lit("Final").alias("name"), "mean", "std", "n"))


def skip_null_report(scores: DataFrame) -> DataFrame:
    """(system, name, mean, std, n, evaluated): over scores that aren't null; ``evaluated`` queries have one at least."""
    each = scores.groupBy("system", "name").agg(*_spread(F.col("score")))
    seen = scores.filter("score is not null").groupBy("system").agg(F.countDistinct("query_id").alias("evaluated"))
    return each.join(seen, "system", "left").withColumn("evaluated", F.coalesce("evaluated", F.lit(0)))


def generated_report(scores: DataFrame, total: DataFrame) -> DataFrame:
    """(system, completeness, completeness_std, correctness, correctness_std, answered, total); metrics by the start of their names.

    ``total``: system, total. Answered queries are those with a correctness score.
    """
    low = F.lower("name")
    c, a = F.when(low.startswith("retrieval completeness"), F.col("score")), F.when(low.startswith("answer correctness") | low.startswith("correctness"), F.col("score"))
    (cm, cs, _), (am, as_, an) = _spread(c), _spread(a)
    out = scores.groupBy("system").agg(cm.alias("completeness"), cs.alias("completeness_std"), am.alias("correctness"), as_.alias("correctness_std"), an.alias("answered"))
    return total.join(out, "system", "left")
