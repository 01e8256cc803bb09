import functools
import json
import threading
import urllib.error
import urllib.request

from quaestor.config import VERSIONS, crawl_roots
from quaestor.operators.embed import HashEmbedder
from quaestor.plans import pipeline
from quaestor.service import Chat, serve


def post(port, body, path="/chat"):
    request = urllib.request.Request(f"http://127.0.0.1:{port}{path}", json.dumps(body).encode() if not isinstance(body, bytes) else body, method="POST")
    try:
        with urllib.request.urlopen(request, timeout=120) as r:
            return r.status, json.loads(r.read())
    except urllib.error.HTTPError as e:
        return e.code, json.loads(e.read())


def test_chat_over_http(spark, tmp_path):
    class Shouting:
        """An answer model with an argument."""

        def __init__(self, mark):
            self.mark = mark

        def answer(self, prompts):
            return [p.partition("[S1]\n")[2].split("\n", 1)[0].upper() + self.mark for p in prompts]

    path = str(tmp_path / "index")
    texts = spark.createDataFrame([("a.txt", "cats sleep", "ua"), ("b.txt", "dogs bark", None)], "file string, text string, source_url string")
    pipeline.build_index(texts, path, VERSIONS[1], embedder=functools.partial(HashEmbedder, size=32))
    chat = Chat(spark, path, top_k=2, embedder=functools.partial(HashEmbedder, size=32), answerer=functools.partial(Shouting, mark="!"))
    server = serve(chat, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    port = server.server_address[1]
    try:
        assert post(port, {"query": "do dogs bark?"}) == (200, {"answer": "DOGS BARK!", "sources": ["Unknown", "ua"]})
        assert post(port, {"query": "?"}) == (200, {"answer": "Nothing was found.", "sources": []})
        assert post(port, {"query": ""})[0] == 400
        assert [post(port, b)[0] for b in ({}, [], b"{", {"query": 3})] == [422] * 4
        assert post(port, {"query": "x"}, "/other")[0] == 404
    finally:
        server.shutdown()


def test_crawl_roots():
    assert [crawl_roots(v, ["a", "b"]) for v in (1, 2, 3, 4, "5")] == [[], [], ["a"], ["a", "b"], ["a"]]
