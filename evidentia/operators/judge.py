"""What comes after a judge: parsing its answers, filters on them, and greedy removal of overlapping findings.

A judge is a function from a DataFrame (context_id, prompt) to ASKED rows: what was said, whether it was refused, tokens, and the failure of a call that
gave no answer (null if it did). Judges are dear and need not say the same twice: whoever uses answers more than once writes them first, as analysis and remembered() do.
"""

from __future__ import annotations

import time
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.predicates import is_public_route
from ..functions.text import class_key, clean_type, json_object
from ..session import hadoop, saved

ANSWER = "context_id string, response_text string, refused boolean, input_tokens bigint, output_tokens bigint"
ASKED = f"{ANSWER}, failure string"
TEXTS = (
    "vulnerability_type", "cwe", "severity", "confidence", "title", "description", "context_reasoning", "data_flow_summary", "suggested_fix",
    "operation_class", "required_control", "missing_control_reasoning",
)
ITEMS = f"struct<findings: array<struct<{', '.join(f'{t}: string' for t in TEXTS)}, start_line: int, end_line: int>>>"


def replayed(contexts: DataFrame, answers: DataFrame) -> DataFrame:
    """A judge that looks its answers up; a context without one is left out."""
    return answers.join(contexts.select("context_id"), "context_id", "left_semi")


def judged_by(contexts: DataFrame, answer: Callable[[str], tuple[str, bool, int, int]], parallel: int = 4) -> DataFrame:
    """A judge that calls answer(prompt) -> (text, refused, input tokens, output tokens) in `parallel` partitions; a failing call gives a row that names its failure."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for context_id, prompt in zip(pdf["context_id"], pdf["prompt"]):
                try:
                    rows.append((context_id, *answer(prompt), None))
                except Exception as e:  # noqa: BLE001  one item's failure is no one else's
                    rows.append((context_id, None, False, 0, 0, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["context_id", "response_text", "refused", "input_tokens", "output_tokens", "failure"])

    return contexts.select("context_id", "prompt").repartition(parallel).mapInPandas(run, ASKED)


def whole(answers: DataFrame) -> DataFrame:
    """Answers with all columns of ASKED; a judge may leave out what it doesn't know. Neither a text nor a refusal is a failure."""
    kinds = dict(part.strip().rsplit(" ", 1) for part in ASKED.split(","))
    out = answers.select(*[F.col(n).cast(t).alias(n) if n in answers.columns else F.lit(None).cast(t).alias(n) for n, t in kinds.items()])
    silent = F.col("response_text").isNull() & ~F.coalesce("refused", F.lit(False))
    return out.withColumn("failure", F.coalesce("failure", F.when(silent, "no answer")))


def remembered(answer: Callable[[DataFrame], DataFrame], folder: str, *, model: str = "", slices: int = 1) -> Callable[[DataFrame], DataFrame]:
    """A judge that keeps its answers in a folder of Parquet files, by the digest of model and prompt, and asks `answer` only for prompts without one.

    Each distinct prompt is asked once, however many contexts have it. Prompts go in `slices`, each appended when all of it is answered, so a run that is
    cut off goes on at the last slice; failures are kept too, and asked again by the next run. A context takes the first answer that its prompt got.
    """
    stored = f"digest string, run bigint, {ASKED}"

    def known(spark: SparkSession) -> DataFrame:
        where, files = hadoop(spark, folder)
        return spark.read.schema(stored).parquet(folder) if files.exists(where) else spark.createDataFrame([], stored)

    def run(contexts: DataFrame) -> DataFrame:
        spark = contexts.sparkSession
        asked = saved(contexts.select("context_id", "prompt", F.sha2(F.concat(F.lit(f"{model}\0"), "prompt"), 256).alias("digest")), "asked")
        have = known(spark).filter("failure is null").select("digest").distinct()
        todo = saved(asked.join(have, "digest", "left_anti").groupBy("digest").agg(F.min("prompt").alias("prompt")), "to-ask")
        now = time.time_ns()
        for k in range(slices):
            part = todo.filter(F.pmod(F.xxhash64("digest"), F.lit(slices)) == k)
            if not part.isEmpty():
                said = whole(answer(part.select(F.col("digest").alias("context_id"), "prompt")))
                said.select(F.col("context_id").alias("digest"), F.lit(now).cast("bigint").alias("run"), *said.columns).write.mode("append").parquet(folder)
        said = known(spark).drop("context_id")
        # An answer comes before any failure, the earliest answer before others, the latest failure before others.
        order = F.struct(F.col("failure").isNotNull(), F.when(F.col("failure").isNull(), F.col("run")).otherwise(-F.col("run")), "response_text")
        best = said.groupBy("digest").agg(F.min_by(F.struct(*[c for c in said.columns if c != "digest"]), order).alias("a"))
        return asked.select("context_id", "digest").join(best, "digest").select("context_id", "a.*").drop("run")

    return run


def usage(answers: DataFrame) -> DataFrame:
    return whole(answers).agg(*[c.alias(n) for n, c in usage_figures().items()])


def usage_figures() -> dict[str, Column]:
    """What a run of a judge took: calls, those that failed, and tokens."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return {"calls": F.count("*"), "failures": F.count("failure"), "input_tokens": total("input_tokens"), "output_tokens": total("output_tokens")}


def parsed(answers: DataFrame) -> DataFrame:
    """A row for each item of the answers: context_id, pos, item. Refusals and malformed answers have none."""
    found = F.from_json(json_object(F.col("response_text")), ITEMS)["findings"]
    items = answers.filter(~F.coalesce("refused", F.lit(False))).select("context_id", found.alias("items"))
    return items.select("context_id", F.posexplode("items").alias("pos", "item"))


def _text(*names: str) -> Column:
    return F.concat_ws(" ", *[F.coalesce(F.col("item")[n], F.lit("")) for n in names])


def asserts_no_path() -> Column:
    return _text("data_flow_summary", "context_reasoning").rlike(fixed.NO_ATTACKER_PATH)


def concedes_control() -> Column:
    return _text("missing_control_reasoning", "description").rlike(fixed.CONTROL_PRESENT)


def needs_no_control() -> Column:
    return F.coalesce(F.col("item")["required_control"], F.lit("")).rlike(fixed.NO_CONTROL_REQUIRED)


def public_noise(route: Column) -> Column:
    return is_public_route(route) & ~_text("missing_control_reasoning", "title").rlike(fixed.SENSITIVE)


def over_escalated(guard_controls: Column) -> Column:
    authenticated = F.exists(guard_controls, lambda c: c.isin("authentication", "session"))
    claimed = _text("required_control", "vulnerability_type", "title").rlike(fixed.ESCALATED)
    return authenticated & claimed & ~_text("missing_control_reasoning", "title").rlike(fixed.SENSITIVE)


def is_placeholder() -> Column:
    return _text("description", "context_reasoning", "data_flow_summary").rlike(fixed.PLACEHOLDER)


def dropped(mode: str) -> Column:
    """Whether the filters of a mode drop an item, next to its context's columns."""
    return {
        "injection": asserts_no_path,
        "absence": lambda: concedes_control() | needs_no_control() | public_noise(F.col("route_path")) | over_escalated(F.col("guard_controls")),
        "hygiene": is_placeholder,
    }[mode]()


def kept(items: DataFrame, contexts: DataFrame, mode: str | None = None) -> DataFrame:
    """Items that pass the filters of the mode, or of each context's own (its column mode), with their contexts' columns.

    contexts: context_id, file, full_name, start_line, end_line, route_path, guard_controls (array). An item without a valid severity or
    confidence, or without a type, voids its whole context, if it gets past the filters. One pass: a context's items, an answer's list, meet in a window.
    """
    rows = items.join(contexts, "context_id")
    if mode:
        gone = dropped(mode)
    else:
        gone = F.when(F.col("mode") == "injection", dropped("injection")).when(F.col("mode") == "absence", dropped("absence")).otherwise(dropped("hygiene"))
    item = F.col("item")
    valid = F.coalesce(item["severity"].isin(*fixed.SEVERITIES) & item["confidence"].isin(*fixed.CONFIDENCES) & item["vulnerability_type"].isNotNull(), F.lit(False))
    void = F.max((~valid).cast("int")).over(W.partitionBy("context_id"))
    return rows.filter(~gone).withColumn("void_", void).filter("void_ = 0").drop("void_")


def findings(items: DataFrame, model: str = "replay", *carry: str) -> DataFrame:
    """The kept items as findings, with defaults: lines of the context for 0 or none, the type as title."""
    item = F.col("item")

    def text(name: str) -> Column:
        return F.coalesce(item[name], F.lit(""))

    kind = clean_type(text("vulnerability_type"))
    start = F.coalesce(F.nullif(item["start_line"], F.lit(0)), F.col("start_line"))
    end = F.coalesce(F.nullif(item["end_line"], F.lit(0)), F.col("end_line"))
    reason = F.when(text("context_reasoning") != "", text("context_reasoning")).otherwise(text("missing_control_reasoning"))
    return items.select(
        F.concat_ws("#", "context_id", "pos").alias("id"), "context_id", "file", start.alias("start_line"), end.alias("end_line"), F.col("full_name").alias("function"),
        kind.alias("vulnerability_type"), text("cwe").alias("cwe"), text("severity").alias("severity"), text("confidence").alias("confidence"),
        F.when(text("title") != "", text("title")).otherwise(kind).alias("title"), text("description").alias("description"), reason.alias("context_reasoning"),
        text("data_flow_summary").alias("data_flow_summary"), text("suggested_fix").alias("suggested_fix"), F.lit(model).alias("model"), *carry,
    )


def rank(column: Column, order: tuple[str, ...]) -> Column:
    """Place of a value in an order, the number of its values if it is none of them."""
    place = F.array_position(F.array(*map(F.lit, order)), column)
    return F.when(place > 0, place - 1).otherwise(len(order)).cast("int")


#: Intervals of a piece from which on it is folded with a search in sorted order.
LONG = 500


def _pieces(rows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """rows with piece_: within a key, intervals that a chain of overlaps joins have one number.

    Rows are dealt by ranges of (key, start), so a hot key is many ranges, and each is scanned by itself. What a range needs from those before it is its first
    key's greatest end and number of cuts there: a row for each range at most, which is small by its nature and broadcast.
    """
    dealt = saved(rows.repartitionByRange(*keys, start, end).withColumn("range_", F.spark_partition_id()), "interval-ranges")
    by_start = W.partitionBy("range_", *keys).orderBy(start, end)
    before = W.partitionBy(*keys).orderBy("range_").rowsBetween(W.unboundedPreceding, -1)

    def carried(df: DataFrame, value: Column, name: str, fold: Callable[[str], Column]) -> DataFrame:
        each = df.groupBy("range_", *keys).agg(value.alias("v_"))
        return each.withColumn(name, fold("v_").over(before)).filter(F.col(name).isNotNull()).select("range_", *[F.col(k).alias(f"{k}_c") for k in keys], name)

    def joined(df: DataFrame, more: DataFrame) -> DataFrame:
        on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_c")) for k in keys], F.col("l.range_") == F.col("r.range_"))
        return df.alias("l").join(F.broadcast(more.alias("r")), on, "left").drop(*[f"{k}_c" for k in keys], F.col("r.range_"))

    reached = joined(dealt, carried(dealt, F.max(end), "carry_", F.max))
    local = F.max(end).over(by_start.rowsBetween(W.unboundedPreceding, -1))
    marked = reached.withColumn("cut_", F.coalesce((F.col(start) > F.greatest(local, "carry_")).cast("int"), F.lit(0)))
    numbered = joined(marked, carried(marked, F.sum("cut_"), "cuts_", F.sum))
    return numbered.withColumn("piece_", F.sum("cut_").over(by_start.rowsBetween(W.unboundedPreceding, W.currentRow)) + F.coalesce("cuts_", F.lit(0)))


def _folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each piece, (s, e) in order of preference, the places of those that stay: kept intervals are apart, so a search finds the only ones that can overlap."""
    for pdf in batches:
        stay = []
        for firsts, lasts in zip(pdf["ss"], pdf["es"]):
            starts, ends, kept = [], [], []
            for place, (s, e) in enumerate(zip(firsts.tolist(), lasts.tolist())):
                k = bisect_right(starts, e)
                if not k or ends[k - 1] < s:
                    at = bisect_right(starts, s)
                    starts.insert(at, s)
                    ends.insert(at, e)
                    kept.append(place)
            stay.append(kept)
        yield pd.DataFrame({"piece_id": pdf["piece_id"], "stay": stay})


def greedy_intervals(rows: DataFrame, keys: list[str], order: list[Column], start: str, end: str, *carry: str) -> DataFrame:
    """Rows of each key kept in order: one stays unless it overlaps one that stayed before. Overlap isn't passed on.

    Rows of a key are sorted by their start and cut where an interval touches none before it: the pieces can't affect one another, and one fold
    takes one piece, whose length is what overlaps and not what a file has. Long pieces are folded with a search in sorted order, in n log n.
    """
    item = F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)], F.col(start).alias("s"), F.col(end).alias("e"), *[F.col(c) for c in carry])
    groups = _pieces(rows, keys, start, end).groupBy(*keys, "piece_").agg(F.array_sort(F.collect_list(item)).alias("items"))
    none = F.filter("items", lambda x: F.lit(False))
    fold = F.aggregate("items", none, lambda acc, x: F.when(F.exists(acc, lambda y: (x["s"] <= y["e"]) & (y["s"] <= x["e"])), acc).otherwise(F.concat(acc, F.array(x))))
    groups = saved(groups, "interval-pieces")
    out = groups.filter(F.size("items") <= LONG).select(*keys, F.explode(fold).alias("x"))
    long = groups.filter(F.size("items") > LONG).withColumn("piece_id", F.to_json(F.struct(*keys, "piece_")))
    if not long.isEmpty():
        inner = lambda f: F.transform("items", lambda x: x[f].cast("bigint"))
        stay = long.select("piece_id", inner("s").alias("ss"), inner("e").alias("es")).mapInPandas(_folded, "piece_id string, stay array<int>")
        kept = F.transform("stay", lambda k: F.element_at("items", k + 1))
        out = out.unionByName(long.join(stay.hint("merge"), "piece_id").select(*keys, F.explode(kept).alias("x")))
    return out.select(*keys, F.col("x.s").alias(start), F.col("x.e").alias(end), *[F.col(f"x.{c}").alias(c) for c in carry])


def deduplicated(found: DataFrame) -> DataFrame:
    """Findings of which no better one of the same file and class overlaps; severity, then confidence, then file order decide."""
    ranked = found.withColumn("class_key", class_key(F.col("cwe"), F.col("vulnerability_type")))
    order = [rank(F.col("severity"), fixed.SEVERITIES), rank(F.col("confidence"), fixed.CONFIDENCES), F.col("start_line"), F.col("end_line"), F.col("id")]
    stay = greedy_intervals(ranked, ["file", "class_key"], order, "start_line", "end_line", *[c for c in found.columns if c not in ("file", "start_line", "end_line")])
    return stay.select(*found.columns)
