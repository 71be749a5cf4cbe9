"""URL filters on a sorted digest array.

An index holds strings as a sorted array of 64-bit xxhash digests, with the offsets of the full strings in one blob and a small number each. The
executors make it from a table, in shards of bounded size: entries are dealt by ranges of their digests and sorted, so neither the driver nor a task
holds them all. The shards are a table in the shared folder whose files travel as files of the application; an executor unpacks them once and its
workers memory-map the arrays, so a large index costs a worker only the pages it touches. A batch of URLs is probed at once by vectorised
binary search, and each hit is confirmed on the stored string; all entries with an equal digest are compared, so collisions neither match nor hide a match.

Rules are pairs of host and path and fit a URL if its host is the rule's or below it and its path starts
with the rule's path: the URL's candidates are its host's suffixes, each joined with the path prefixes of the lengths that
occur in rules. The longest rule that fits decides. Else the method decides: a host on the block list, or below one, is blocked.

Defined cases: a null URL or one without :// has the empty host and path; it fits no rule and is allowed. Only A-Z are lowered in hosts. Ties
between rules of one length go to allow, then to the smaller rule. Rules or hosts with null parts are left out; repeated ones count once. Repeated rows
of pages are judged each; extra columns are left aside. An empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import hadoop, shared_dir, table

# The rules of the contract, as (verdict, host, path), and the default block list.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
BLOCKED = ("cheap-pills.example.com", "spam-farm.example.org", "casino-bonus.example.net")
UPPER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
#: Entries and bytes of strings in a shard.
ENTRIES, BYTES = 1 << 20, 64 << 20
HOST, PATH = re.compile(r"[^/?#]*"), re.compile(r"[^?#]*")


def parts(url: str | None) -> tuple[str, str]:
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    host = HOST.match(url, at + 3)
    return host[0].translate(UPPER), PATH.match(url, host.end())[0]


def suffixes(host: str) -> list[str]:
    """The host and its parents, e.g. a.b.c, b.c, c."""
    out = [host] if host else []
    while (dot := host.find(".")) >= 0:
        host = host[dot + 1 :]
        if host:
            out.append(host)
    return out


def signed(digest: int) -> int:
    """A digest as the signed number that sorts like it."""
    return digest - (1 << 63)


def shard_rows(entries: Iterator[tuple[int, str, int]], most: int = ENTRIES) -> Iterator[dict]:
    """Shards of sorted (signed digest, string, number): digests, offsets, numbers and strings as bytes."""
    digests, numbers, strings, size = [], [], [], 0

    def shard() -> dict:
        return {
            "digests": (np.array(digests, np.int64).view(np.uint64) ^ np.uint64(1 << 63)).tobytes(), "offsets": np.cumsum([0, *map(len, strings)], dtype=np.int64).tobytes(),
            "numbers": np.array(numbers, np.int32).tobytes(), "strings": b"".join(strings),
        }

    for digest, string, number in entries:
        if len(digests) >= most or size >= BYTES:
            yield shard()
            digests, numbers, strings, size = [], [], [], 0
        digests.append(digest), numbers.append(number), strings.append(string.encode())
        size += len(strings[-1])
    if digests:
        yield shard()


class Shard:
    """A shard's arrays, memory-mapped from <path>.digests, .offsets, .numbers and .strings."""

    KINDS = {"digests": np.uint64, "offsets": np.int64, "numbers": np.int32, "strings": np.uint8}

    def __init__(self, path: str):
        for name, kind in self.KINDS.items():
            file = f"{path}.{name}"
            setattr(self, name, np.memmap(file, kind, "r") if os.path.getsize(file) else np.zeros(0, kind))

    @classmethod
    def write(cls, path: str, shard: dict) -> None:
        for name in cls.KINDS:
            with open(f"{path}.{name}.{os.getpid()}", "wb") as out:
                out.write(shard[name])
            os.replace(out.name, f"{path}.{name}")  # another worker may do the same

    def find(self, keys: list[bytes], want: np.ndarray, out: np.ndarray) -> None:
        """Sets out where a key is in the shard. want: the keys' digests."""
        first, last = np.searchsorted(self.digests, want, "left"), np.searchsorted(self.digests, want, "right")
        for k in np.flatnonzero(first < last):
            for at in range(first[k], last[k]):
                if self.strings[self.offsets[at] : self.offsets[at + 1]].tobytes() == keys[k]:
                    out[k] = self.numbers[at]


class Index:
    def __init__(self, paths: Iterable[str], digest=xxhash.xxh64_intdigest):
        self.shards, self.digest = [Shard(p) for p in paths], digest

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The number of each key, or -1."""
        want, out = np.fromiter(map(self.digest, keys), np.uint64, len(keys)), np.full(len(keys), -1, np.int32)
        for shard in self.shards:
            shard.find(keys, want, out)
        return out


@lru_cache(maxsize=8)
def _open(files: tuple[str, ...]) -> Index:
    """The index in files of the application, unpacked beside them by the first worker that needs it."""
    paths = []
    for file in files:
        here = SparkFiles.get(file)
        rows = pq.ParquetFile(here)
        for k, batch in enumerate(rows.iter_batches(batch_size=1)):
            path = f"{here}.{k}"
            if not all(os.path.exists(f"{path}.{n}") for n in Shard.KINDS):
                Shard.write(path, batch.to_pylist()[0])
            paths.append(path)
    return Index(paths)


def _digested(batches):
    for batch in batches:
        digests = [signed(xxhash.xxh64_intdigest(k.as_py())) for k in batch.column("string")]
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.int64()), *batch.columns], names=["digest", *batch.schema.names])


def _sharded(batches):
    entries = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("digest", "string", "number"))))
    for shard in shard_rows(entries):
        yield pa.RecordBatch.from_pylist([shard], pa.schema([(n, pa.binary()) for n in Shard.KINDS]))


def build(entries: DataFrame) -> tuple[str, ...]:
    """The files of an index of entries (string, number), sent to the executors. Of the numbers of a string the least counts."""
    spark, name = entries.sparkSession, f"index-{uuid.uuid4().hex}"
    one = entries.filter("string is not null").groupBy("string").agg(F.min("number").cast("int").alias("number"))
    dealt = one.mapInArrow(_digested, "digest bigint, string string, number int").repartitionByRange("digest").sortWithinPartitions("digest", "string")
    path = f"{shared_dir(spark)}/{name}"
    dealt.mapInArrow(_sharded, ", ".join(f"{n} binary" for n in Shard.KINDS)).write.parquet(path)
    where, files = hadoop(spark, path)
    files.deleteOnExit(where)
    found = []
    for k, status in enumerate(sorted(files.listStatus(where), key=lambda s: s.getPath().getName())):
        if status.getPath().getName().endswith(".parquet"):
            own = f"{name}-{k}.parquet"
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where, own)
            files.rename(status.getPath(), target)
            spark.sparkContext.addFile(target.toString())
            found.append(own)
    return tuple(found)


ALLOW, BLOCK = 0, 1


def _judge(lengths: list[int], files: tuple[str, ...]):
    def run(batches):
        index = _open(files)
        for batch in batches:
            hosts, paths = [], []
            keys, owner, names, named = [], [], [], []
            for k, url in enumerate(batch.column("url")):
                host, path = parts(url.as_py())
                hosts.append(host), paths.append(path)
                for h in suffixes(host):
                    names.append(f"host {h}".encode()), named.append(k)
                    for n in lengths:
                        if n <= len(path):
                            keys.append(h + path[:n]), owner.append(k)
            best: list[tuple | None] = [None] * len(hosts)
            found = index.find([f"rule {key}".encode() for key in keys])
            for at in np.flatnonzero(found >= 0):
                k, rule = owner[at], (-len(keys[at]), int(found[at]), keys[at])
                best[k] = min(best[k] or rule, rule)
            blocked = {named[at] for at in np.flatnonzero(index.find(names) >= 0)}
            rule = [b and b[2] for b in best]
            verdict = ["block" if (b[1] == BLOCK if b else k in blocked) else "allow" for k, b in enumerate(best)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *(pa.array(c, pa.string()) for c in (hosts, paths, rule, verdict))], names=["page_id", "host", "path", "rule", "verdict"])

    return run


def judged(pages: DataFrame, rules: DataFrame | Iterable[tuple[str, str, str]] = RULES, blocked: DataFrame | Iterable[str] = BLOCKED) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages. rules: verdict, host and path; blocked: host; as rows or as tables of any size."""
    spark, pages = pages.sparkSession, pages.select("page_id", "url")
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "verdict string, host string, path string")
    if not isinstance(blocked, DataFrame):
        blocked = spark.createDataFrame([(h,) for h in blocked], "host string")
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    low = F.translate("host", capitals, capitals.lower())
    by_rule = rules.select(F.concat(F.lit("rule "), low, "path").alias("string"), F.when(F.col("verdict") == "allow", ALLOW).otherwise(BLOCK).alias("number"))
    files = build(by_rule.unionAll(blocked.select(F.concat(F.lit("host "), low), F.lit(BLOCK))))
    # As many lengths as the longest path has characters, at most.
    lengths = sorted(r.n for r in rules.filter("host is not null and path is not null").select(F.length("path").alias("n")).distinct().collect())
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.mapInArrow(_judge(lengths, files), f"page_id {kind}, host string, path string, rule string, verdict string")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))


ORACLE = f"""
WITH u AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
h AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM p),
rules(verdict, rh, rp) AS (VALUES {", ".join(map(str, RULES))}),
blocked(bh) AS (VALUES {", ".join(f"('{b}')" for b in BLOCKED)}),
f AS (SELECT page_id, verdict, rh || rp AS rule,
  row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC, verdict, rh || rp) AS k
  FROM h JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)),
b AS (SELECT DISTINCT page_id FROM h JOIN blocked ON host = bh OR ends_with(host, '.' || bh))
SELECT h.page_id, host, path, f.rule, coalesce(f.verdict, CASE WHEN b.page_id IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM h LEFT JOIN f ON h.page_id = f.page_id AND f.k = 1 LEFT JOIN b ON h.page_id = b.page_id
"""
