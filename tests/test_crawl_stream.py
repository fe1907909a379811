"""A crawl as a stream of pages: it goes on where it was stopped, no page is fetched twice, one limit holds for all hosts."""

import http.server
import json
import threading
from collections import Counter
from urllib.parse import parse_qs, urlparse

import pytest

from quarry.sources import pages


@pytest.fixture
def server():
    """Hosts are the first part of the path; every request is counted."""
    sizes, seen = {"a": 430, "b": 120, "c": 0, "d": 70}, Counter()

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            url = urlparse(self.path)
            host, start = url.path.strip("/").split("/")[0], int(parse_qs(url.query)["start"][0])
            seen[host, start] += 1
            n = sizes[host]
            body = {"data": [{"uuid": f"{host}-{i}"} for i in range(start, min(n, start + 50))]} | ({} if host == "d" else {"total": n})
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *args):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/{{host}}/{{kind}}", seen, sizes
    s.shutdown()


def crawl(spark, base, folder, hosts="a,b,c,d", **options):
    """One run takes one step of every host, as if it was stopped then."""
    reader = spark.readStream.format("catalogue_pages").option("hosts", hosts).option("base", base).option("pages_per_batch", "3").option("progress", f"{folder}/progress")
    for k, v in options.items():
        reader = reader.option(k, v)
    query = reader.load().writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    assert query.awaitTermination(120) and query.exception() is None
    return [(r["host"], r["start"], json.loads(r["item"])["uuid"]) for r in spark.read.schema(pages.SCHEMA).parquet(f"{folder}/out").collect()]


def test_stopped_crawl_goes_on(spark, tmp_path, server):
    base, seen, sizes = server
    pages.register(spark)
    got = [Counter(h for h, _, _ in crawl(spark, base, str(tmp_path))) for _ in range(4)]
    assert got == [{"a": 150, "b": 120, "d": 70}, {"a": 300, "b": 120, "d": 70}, {"a": 430, "b": 120, "d": 70}, {"a": 430, "b": 120, "d": 70}]
    rows = crawl(spark, base, str(tmp_path))
    assert len({u for _, _, u in rows}) == len(rows) == sum(sizes.values()) and all(int(u.split("-")[1]) // 50 * 50 == s for _, s, u in rows)
    probes = {(h, 0) for h in sizes}  # the first page is asked once more for the total
    assert all(n == (2 if k in probes and k[0] != "c" else 1) for k, n in seen.items()) and len(seen) == 9 + 3 + 1 + 2
    known = spark.createDataFrame([(f"a-{i}", "a") for i in range(400)], "video_id string, instance_domain string")
    items = spark.createDataFrame([(h, s, json.dumps({"uuid": u})) for h, s, u in rows], pages.SCHEMA)
    assert pages.unknown(items, known).count() == len(rows) - 400


def test_one_limit_for_all_hosts(spark, tmp_path, server):
    base, _, _ = server
    pages.register(spark)
    for _ in range(4):
        rows = crawl(spark, base, str(tmp_path), hosts="a,b", limit="290")
    assert Counter(h for h, _, _ in rows) == {"a": 170, "b": 120} and len(set(rows)) == 290
