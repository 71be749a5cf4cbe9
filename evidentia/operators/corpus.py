"""Corpora of programs: fingerprints, candidates, minimum sizes, splits and run statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import hash_split

#: Parts of a program's files that are hashed apart.
BUCKETS = 256


def fingerprints(files: DataFrame, app: str = "app", file: str = "file", text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """app and fingerprint: a hash over the hashes of its files in order of their names, in two levels.

    Files are hashed where they are read, and only (name, hash) moves; names are dealt by the first byte of their md5, so that no task holds
    more than a 256th or so of a program's. Any change of a name or a text changes it.
    """
    item = F.struct(F.col(file).alias("f"), F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256).alias("h"))
    bucket = F.pmod(F.conv(F.substring(F.md5(F.col(file).cast("binary")), 1, 2), 16, 10).cast("int"), F.lit(buckets))
    parts = files.select(app, bucket.alias("b"), item.alias("x")).groupBy(app, "b").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    hashed = lambda x: F.concat(x["f"], F.lit("\n"), x["h"], F.lit("\n"))
    parts = parts.select(app, "b", F.sha2(F.array_join(F.transform("xs", hashed), "").cast("binary"), 256).alias("h"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), "")
    one = F.when(F.count("*") == 1, F.first("h")).otherwise(F.sha2(whole.cast("binary"), 256))
    return parts.groupBy(app).agg(one.alias("fingerprint"))


def with_minimum(rows: DataFrame, key: str, least: int) -> DataFrame:
    """Rows of keys that have at least so many."""
    enough = rows.groupBy(key).agg(F.count("*").alias("n_")).filter(F.col("n_") >= least).select(key)
    return rows.join(enough, key, "left_semi")


def best_candidates(screened: DataFrame, most: int) -> DataFrame:
    """The candidates with most stars among those that passed the screening."""
    return screened.orderBy(F.desc("stars"), "full_name").limit(most)


def search_query(min_stars: Column, pushed_after: Column) -> Column:
    return F.concat(F.lit("express language:JavaScript stars:>="), min_stars.cast("string"), F.lit(" pushed:>="), pushed_after, F.lit(" archived:false is:public"))


def repository_name(url: Column) -> Column:
    """owner/name of a clone URL or of owner/name itself; null for anything else."""
    bare = F.regexp_replace(F.trim(url), r"^(?:https?://[^/]+/|git@[^:]+:|ssh://[^/]+/)|(?:\.git)?/?$", "")
    return F.when(bare.rlike(r"^[\w.-]+/[\w.-]+$"), bare)


def labels_of(rows: DataFrame, app: str, seed: str, share: float = 0.3) -> DataFrame:
    """rows with held_out: whole programs are held out, by their hash."""
    return rows.withColumn("held_out", hash_split(F.col(app), seed, share))


def first_mutations(labels: DataFrame, most: int) -> DataFrame:
    """The first mutations of each program in the order of its file."""
    ranked = labels.withColumn("k_", F.row_number().over(W.partitionBy("app").orderBy("position")))
    return ranked.filter(F.col("k_") <= most).drop("k_")


def stage_breakdown(stages: DataFrame) -> DataFrame:
    """name and seconds of stages that took any time, in their order. stages: position, name, seconds."""
    return stages.filter("seconds > 0").groupBy("position", "name").agg(F.round(F.sum("seconds"), 1).alias("seconds")).orderBy("position")


def decoded_text(content: Column) -> Column:
    """Text of a file that an API gives in base64 with line breaks."""
    return F.unbase64(F.regexp_replace(content, r"\s", "")).cast("string")


def escaped(text: Column) -> Column:
    """A string literal's inside: backslash, quote and line ends escaped."""
    for raw, safe in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescaped(literal: Column) -> Column:
    return F.from_json(F.concat(F.lit('{"v":"'), literal, F.lit('"}')), "v string")["v"]
