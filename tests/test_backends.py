import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from evidentia.functions.instructions import SYSTEM, answer_schema
from evidentia.operators import judge
from evidentia.sources import backends


class Model(BaseHTTPRequestHandler):
    """Both services; a prompt with `busy` is turned away once, one with `broken` always."""

    seen: list = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["content-length"])))
        prompt = body["messages"][1]["content"]
        before = sum(p == prompt for _, p, _ in Model.seen)
        Model.seen.append((self.path, prompt, body))
        code = 503 if "broken" in prompt or "busy" in prompt and not before else 400 if "wrong" in prompt else 200
        self.send_response(code)
        self.send_header("Retry-After", "0.01")
        self.end_headers()
        told = json.dumps({"findings": []})
        if self.path == "/api/chat":
            self.wfile.write(json.dumps({"message": {"content": told}, "prompt_eval_count": 7, "eval_count": 2}).encode())
        else:
            refused = {"content": None, "refusal": "no"} if "secret" in prompt else {"content": told}
            self.wfile.write(json.dumps({"choices": [{"message": refused, "finish_reason": "stop"}], "usage": {"prompt_tokens": 5, "completion_tokens": 1}}).encode())

    def log_message(self, *_):
        pass


@pytest.fixture
def url():
    Model.seen.clear()
    server = ThreadingHTTPServer(("127.0.0.1", 0), Model)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_judges_over_http(spark, url):
    settings = backends.Settings(url=url, model="m", tries=2, timeout=5, context_chars=40)
    rows = [("injection|a", "plain"), ("absence|b", "busy"), ("absence|c", "broken"), ("hygiene|d", "x" * 100), ("hygiene|e", "wrong")]
    asked = spark.createDataFrame(rows, "context_id string, prompt string")
    got = {r.context_id: r for r in backends.judge_of(settings)(asked).collect()}
    assert set(got) == {r[0] for r in rows} and (got["injection|a"].input_tokens, got["injection|a"].output_tokens, got["injection|a"].failure) == (7, 2, None)
    assert got["absence|b"].failure is None and "HTTP 503" in got["absence|c"].failure and "HTTP 400" in got["hygiene|e"].failure
    assert sum(p == "wrong" for _, p, _ in Model.seen) == 1 and sum(p == "broken" for _, p, _ in Model.seen) == 2
    one = next(b for _, p, b in Model.seen if p == "plain")
    assert one["messages"][0]["content"] == SYSTEM["injection"] and one["format"] == answer_schema("injection") and one["options"] == {"temperature": 0}
    assert any(p == "x" * 40 + "\n... truncated ..." for _, p, _ in Model.seen)
    hosted = backends.judge_of(backends.Settings(provider="hosted", url=url, tries=1))
    got = {r.context_id: r for r in hosted(spark.createDataFrame([("absence|a", "secret"), ("absence|b", "b")], "context_id string, prompt string")).collect()}
    assert got["absence|a"].refused and not got["absence|b"].refused and got["absence|b"].input_tokens == 5
    assert judge.usage(hosted(asked.limit(1))).first().calls == 1


def test_settings():
    read = backends.Settings.read
    assert read({}) == backends.Settings()
    assert read({"EVIDENTIA_MODEL": " m ", "EVIDENTIA_PARALLEL": "8", "EVIDENTIA_TIMEOUT": "2.5", "EVIDENTIA_URL": "", "OTHER": "x"}) == backends.Settings(model="m", parallel=8, timeout=2.5)
    for bad in ({"EVIDENTIA_PARALLEL": "many"}, {"EVIDENTIA_GROUNDING": "none"}):
        with pytest.raises(ValueError, match="EVIDENTIA_"):
            read(bad)


def test_schemas_are_closed():
    for mode in SYSTEM:
        item = answer_schema(mode)["properties"]["findings"]["items"]
        assert item["additionalProperties"] is False and set(item["required"]) == set(item["properties"]) <= {*judge.TEXTS, "start_line", "end_line"}
