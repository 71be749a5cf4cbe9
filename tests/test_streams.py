import json
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from evidentia.sources.paged import PagedSource
from evidentia.streaming import jobs


def put(spark, folder, name, rows):
    """One file of the log."""
    text = "\n".join(json.dumps(dict(zip(("job", "line_no", "line", "status"), r))) for r in rows)
    part = folder / f".{name}"
    part.write_text(text)
    part.rename(folder / f"{name}.json")


def run(spark, tmp_path, **more):
    log = jobs.tail(spark, str(tmp_path / "log"))
    query = jobs.written_out(jobs.followed(log, **more), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.awaitTermination()
    return query


def read(spark, tmp_path):
    return sorted((r.job, r.line_no, r.kind, r.line, r.status) for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_lines_come_once_and_in_order(spark, tmp_path):
    (tmp_path / "log").mkdir()
    put(spark, tmp_path / "log", "a", [("x", 2, "c", "running"), ("x", 0, "a", "running"), ("y", 0, "only", "failed"), (None, 0, "-", "running"), ("z", 5, "early", "done")])
    run(spark, tmp_path)
    assert read(spark, tmp_path) == [("x", 0, "line", "a", "running"), ("y", 0, "line", "only", "failed"), ("y", 1, "end", None, "failed")]
    # The missing line lets the held one go; repeats and what comes after the end don't count. The second run goes on from the first one's checkpoint.
    put(spark, tmp_path / "log", "b", [("x", 1, "b", "running"), ("x", 0, "again", "running"), ("x", 3, "d", "done"), ("x", 4, "late", "running"), ("y", 1, "late", "running")])
    run(spark, tmp_path)
    assert [r for r in read(spark, tmp_path) if r[0] == "x"] == [("x", 0, "line", "a", "running"), ("x", 1, "line", "b", "running"), ("x", 2, "line", "c", "running"), ("x", 3, "line", "d", "done"), ("x", 4, "end", None, "done")]
    assert len([r for r in read(spark, tmp_path) if r[0] == "y"]) == 2
    put(spark, tmp_path / "log", "c", [("x", 4, "after the end", "running")])
    run(spark, tmp_path)
    assert len(read(spark, tmp_path)) == 7


def test_silent_jobs_expire(spark, tmp_path):
    (tmp_path / "log").mkdir()
    put(spark, tmp_path / "log", "a", [("x", 0, "a", "running"), ("x", 3, "d", "running")])
    seen = []
    events = jobs.followed(jobs.tail(spark, str(tmp_path / "log")), expire_ms=1)
    query = jobs.follow(events, str(tmp_path / "checkpoint"), lambda df, _: seen.extend(map(tuple, df.collect())), every="200 milliseconds")
    try:
        for k in range(120):
            time.sleep(0.25)
            if any(r[1] == "end" for r in seen):
                break
            if k % 8 == 7:
                put(spark, tmp_path / "log", f"n{k}", [("other", 0, "news", "running")])
    finally:
        query.stop()
    assert [r[1:] for r in seen if r[0] == "x"] == [("line", 0, "a", "running"), ("line", 3, "d", "running"), ("end", 2, None, "expired")]


class Pages(BaseHTTPRequestHandler):
    """Three pages of two: the second fails twice, a fourth never comes."""

    calls: Counter = Counter()

    def do_GET(self):
        page = int(self.path.rsplit("=", 1)[1])
        Pages.calls[page] += 1
        if page == 2 and Pages.calls[2] <= 2 or page == 4:
            self.send_response(429 if page == 2 else 503)
            self.send_header("Retry-After", "0.05")
            self.end_headers()
            return
        body = json.dumps({"total": 6, "items": [{"id": 10 * page + k, "name": f"r{page}{k}", "owner": {"login": "o"}, "topics": ["a"], "extra": 1} for k in range(2)]}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


SCHEMA = "id bigint, name string, owner struct<login: string>, topics array<string>, _failure string"


@pytest.fixture
def server(spark):
    spark.dataSource.register(PagedSource)
    Pages.calls.clear()
    httpd = ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{httpd.server_port}/search?page={{page}}"
    httpd.shutdown()


def test_pages_are_partitions_and_tried_again(spark, server):
    source = spark.read.format("paged").schema(SCHEMA).option("location", server).option("perPage", 2).option("wait", 0.05)
    got = source.load()
    assert sorted((r.id, r.name, r.owner.login, r.topics, r._failure) for r in got.collect()) == [(10 * p + k, f"r{p}{k}", "o", ["a"], None) for p in (1, 2, 3) for k in (0, 1)]
    assert Pages.calls[2] == 3 and got.rdd.getNumPartitions() == 3
    assert sorted(r.id for r in source.option("most", 3).load().collect()) == [10, 11, 20]


def test_a_page_that_never_comes(spark, server):
    source = spark.read.format("paged").schema(SCHEMA).option("location", server).option("perPage", 2).option("pages", 4).option("tries", 3).option("wait", 0.01)
    with pytest.raises(Exception, match="page 4 of .* HTTP 503, after 3 tries"):
        source.load().collect()
    assert Pages.calls[4] == 3  # one task, bounded tries
    rows = source.option("failures", "row").load().collect()
    assert sum(r._failure is None for r in rows) == 6 and [r for r in rows if r._failure][0].id is None


def test_pages_of_a_folder_as_a_stream(spark, server, tmp_path):
    def page(k, total):
        (tmp_path / f"p{k}.json").write_text(json.dumps({"total": total, "items": [{"id": 10 * k + j} for j in range(2)]}))

    def ids():
        stream = spark.readStream.format("paged").schema("id bigint").option("location", str(tmp_path / "p{page}.json")).option("perPage", 2).load()
        jobs.written_out(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
        return sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect())

    page(1, 2)
    assert ids() == [10, 11]
    page(1, 6), page(2, 6), page(3, 6)
    assert ids() == [10, 11, 20, 21, 30, 31]
    assert ids() == [10, 11, 20, 21, 30, 31]
