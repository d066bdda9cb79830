"""Paged listings as a data source: pages, retries, expired tokens and watch events."""

import json

import pytest

from marlstone.sources import listing


def item(uid, namespace, version):
    return {"kind": "Pod", "metadata": {"uid": uid, "name": f"n-{uid}", "namespace": namespace, "resourceVersion": str(version)}, "spec": {"b": 1, "a": [uid]}, "status": "up"}


@pytest.fixture()
def saved(tmp_path):
    for name, pages in {"a": 3, "b": 1, "c": 2}.items():
        (tmp_path / name).mkdir()
        for n in range(pages):
            items = [item(f"{name}{n}{k}", name, n) for k in range(4)]
            (tmp_path / name / f"{n}.json").write_text(json.dumps({"items": items, "metadata": {"resourceVersion": "7"}}))
    return tmp_path


class Flaky:
    """Fails once a page, and says once that the token has expired."""

    def __init__(self, pages, gone_at=2):
        self.pages, self.gone_at, self.failed, self.calls = pages, gone_at, set(), 0

    def list(self, namespace, limit, token):
        self.calls += 1
        n = int(token or 0)
        if n not in self.failed:
            self.failed.add(n)
            raise ConnectionError("lost")
        if n == self.gone_at:
            self.gone_at = None
            raise listing.Gone
        return {"items": self.pages[n], "continue": str(n + 1) if n + 1 < len(self.pages) else None}


def test_pages_are_read_once_a_namespace(spark, saved):
    spark.dataSource.register(listing.ResourceListing)
    read = spark.read.format("resource_listing").option("client", "marlstone.sources.listing:SavedPages").option("path", str(saved))
    rows = read.option("namespaces", "a,b, c").load()
    assert rows.rdd.getNumPartitions() == 3
    got = rows.collect()
    assert len(got) == 24 and len({x.uid for x in got}) == 24 and {x.namespace for x in got} == {"a", "b", "c"}
    one = next(x for x in got if x.uid == "a10")
    assert (one.name, one.resource_version, one.kind, one.spec, one.status) == ("n-a10", "1", "Pod", '{"a": ["a10"], "b": 1}', "up")
    assert rows.where("namespace = 'b'").count() == 4


def test_failures_and_expired_tokens(monkeypatch):
    monkeypatch.setattr(listing, "WAIT", 0)
    pages = [[item(f"{n}{k}", "x", n) for k in range(3)] for n in range(4)]
    client = Flaky(pages)
    got = list(listing.listed(client, "x"))
    assert [r[0] for r in got] == [f"{n}{k}" for n in range(4) for k in range(3)]
    assert client.calls == 4 + 1 + 2 + 4  # a failure a page, the expired token, two pages before it, all pages again

    class Down:
        def list(self, *args):
            raise ConnectionError("down")

    class Always:
        def list(self, *args):
            raise listing.Gone

    with pytest.raises(ConnectionError):
        list(listing.listed(Down(), None))
    with pytest.raises(listing.Gone):
        list(listing.listed(Always(), None))


def test_watch_events_as_a_stream(spark, saved, tmp_path):
    events = lambda lo, hi: [{"type": "MODIFIED", "object": item(f"e{v}", "a", v)} for v in range(lo, hi)]
    spark.dataSource.register(listing.ResourceListing)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "check")
    stream = lambda: spark.readStream.format("resource_listing").option("client", "marlstone.sources.listing:SavedPages").option("path", str(saved)).option("namespaces", "a,b").option("what", "events").option("resource_version", "3").load()
    for upto in (6, 9):
        (saved / "a" / "events.jsonl").write_text("\n".join(json.dumps(e) for e in events(1, upto)))
        query = stream().writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
        query.processAllAvailable()
        query.stop()
    got = sorted(x.resource_version for x in spark.read.parquet(out).collect())
    assert got == ["4", "5", "6", "7", "8"]
