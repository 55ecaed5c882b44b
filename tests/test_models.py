"""The HTTP model source and live fetch against a server of this process."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from pagegrain.operators import model_output
from pagegrain.sources import fetch, models


class Handler(BaseHTTPRequestHandler):
    def _send(self, code, kind, body):
        self.send_response(code)
        self.send_header("Content-Type", kind)
        self.end_headers()
        self.wfile.write(body.encode())

    def do_GET(self):
        if self.path == "/page":
            self._send(200, "text/html; charset=utf-8", "<html><p>é</p></html>")
        elif self.path == "/pdf":
            self._send(200, "application/pdf", "%PDF")
        else:
            self._send(404, "text/html", "no")

    def do_POST(self):
        prompt = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["prompt"]
        if "fail" in prompt:
            return self._send(500, "text/plain", "broken")
        good = '{"improvements": [{"issue": "Typo", "suggested_change": "s", "reason": "r"}]}'
        text = "no json" if prompt == "bad" or (prompt.startswith("Turn") and "never" in prompt) else "never json" if prompt == "never" else good
        self._send(200, "application/json", json.dumps({"response": text}))

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def server():
    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_answers(spark, server):
    prompts = spark.createDataFrame([("a", "good"), ("b", "bad"), ("c", "never"), ("d", "fail")], "chunk_id string, prompt string")
    rows = models.answers(server, "m")(prompts)
    chunks = prompts.selectExpr("chunk_id", "'u' as page_url", "'s' as section_id", "array('p') as section_path")
    got = {r["chunk_id"]: (len(r["improvements"]), [w.split(":")[0] for w in r["warnings"]]) for r in model_output.analyze(chunks, rows).collect()}
    assert got == {"a": (1, []), "b": (1, []), "c": (0, ["invalid_llm_json"]), "d": (0, ["provider_error"])}


def test_live_fetch(spark, server):
    wanted = spark.createDataFrame([(f"{server}/page",), (f"{server}/pdf",), (f"{server}/none",), ("http://127.0.0.1:9/",), ("bad url",)], "url string")
    got = {r["url"].removeprefix(server): (r["status"], r["html"]) for r in fetch.live(wanted, timeout=5).collect()}
    assert got == {"/page": ("success", "<html><p>é</p></html>"), "/pdf": ("non_html", None), "/none": ("http_error", None), "http://127.0.0.1:9/": ("network_error", None), "bad url": ("invalid_url", None)}
