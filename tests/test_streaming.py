"""Streams of results into the store."""

import json

from skeinery.operators.store import Store
from skeinery.streaming import ingest


def write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def result(url, at, title="t", error=None):
    return {"url": url, "depth": 0, "content": "c", "format": "text", "title": title, "links_found": 0, "error": error, "http_status": 200, "meta": None, "crawled_at": at}


def test_into_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    inbox, seen = tmp_path / "in", []
    write(inbox, "1.json", [result("https://a.x/1", "2025-01-01T00:00:00Z"), result("https://a.x/2", "2025-01-01T00:00:01Z", error="HTTP 404")])
    run = lambda: ingest.into_store(ingest.result_stream(spark, str(inbox)), store, f"{tmp_path}/cp", [lambda d: seen.append(d.count())]).awaitTermination()
    run()
    write(inbox, "2.json", [result("https://a.x/1", "2025-01-02T00:00:00Z", "new")])
    run()
    assert [(r.url, r.title, r.grp) for r in store.read("page").collect()] == [("https://a.x/1", "new", "a_x")] and seen == [2, 1]


def test_keyed_state(spark, tmp_path):
    inbox = tmp_path / "in"
    write(inbox, "1.json", [result(f"https://a.x/{i}", "2025-01-01T00:00:00Z") for i in range(3)] + [result("https://b.x/", "2025-01-01T00:00:00Z")] * 2)
    stream = ingest.result_stream(spark, str(inbox))
    q = ingest.host_spacing(ingest.first_seen(stream), 2.0).writeStream.format("memory").queryName("spaced").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.host, r.start_at.second) for r in spark.sql("select * from spaced").collect())
    assert got == [("a.x", 0), ("a.x", 2), ("a.x", 4), ("b.x", 0)]
