"""Paged listings of resources as a data source: a partition a namespace, continue tokens, and a new listing where one has expired.

What asks for the pages is a client that the caller names, so nothing here knows of a network::

    spark.dataSource.register(ResourceListing)
    spark.read.format("resource_listing").option("client", "package.module:Client").option("namespaces", "a,b").load()

A client is made once a task from the options and has ``list(namespace, limit, token)``, which gives a page
(items, continue, resource_version), and for streams ``watch(namespace, version)``, which gives (events, version).
``SavedPages`` reads pages that were saved as files.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from importlib import import_module
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "uid string, name string, namespace string, resource_version string, kind string, spec string, status string"
EVENTS = "type string, uid string, namespace string, resource_version string, object string"
#: Items of a page, tries of one page, new listings of one namespace, seconds before the first retry.
LIMIT, TRIES, LISTINGS, WAIT = 500, 4, 5, 0.2


class Gone(Exception):
    """A token or version has expired: what 410 says."""


def _client(options: dict):
    module, _, name = options["client"].partition(":")
    return getattr(import_module(module), name)(options)


def _row(item: dict) -> tuple:
    meta = item.get("metadata") or {}
    text = lambda x: None if x is None else x if isinstance(x, str) else json.dumps(x, sort_keys=True)
    return (meta.get("uid"), meta.get("name"), meta.get("namespace"), meta.get("resourceVersion"), item.get("kind"), text(item.get("spec")), text(item.get("status")))


def _asked(call, *args):
    """A call again after failures of the connection, each time after a longer while."""
    for n in range(TRIES):
        try:
            return call(*args)
        except OSError:
            if n + 1 == TRIES:
                raise
            time.sleep(WAIT * 2**n)


def listed(client, namespace: str | None, limit: int = LIMIT) -> Iterator[tuple]:
    """Rows of a namespace, page by page. A listing whose token has expired begins anew; a uid that was given is not given again."""
    given: set[str] = set()
    for n in range(LISTINGS):
        token = None
        try:
            while True:
                page = _asked(client.list, namespace, limit, token)
                for item in page.get("items") or []:
                    row = _row(item)
                    if row[0] is None or row[0] not in given:
                        given.add(row[0])
                        yield row
                token = page.get("continue")
                if not token:
                    return
        except Gone:
            if n + 1 == LISTINGS:
                raise


class Namespace(InputPartition):
    def __init__(self, name: str | None):
        self.name = name


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Namespace]:
        names = [x.strip() for x in self.options.get("namespaces", "").split(",") if x.strip()]
        return [Namespace(x) for x in names] or [Namespace(None)]

    def read(self, partition: Namespace) -> Iterator[tuple]:
        yield from listed(_client(self.options), partition.name, int(self.options.get("limit", LIMIT)))


class _Watcher(SimpleDataSourceStreamReader):
    """Events after the versions that the offset names, a version a namespace; an expired version asks for a new listing."""

    def __init__(self, options: dict):
        self.options = options
        self.names = [x.strip() for x in options.get("namespaces", "").split(",") if x.strip()] or [""]

    def initialOffset(self) -> dict:
        return {name: options_version(self.options) for name in self.names}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = [], dict(start)
        client = _client(self.options)
        for name in self.names:
            try:
                events, end[name] = _asked(client.watch, name or None, start[name])
            except Gone:
                rows.append(("RELIST", None, name or None, start[name], None))
                end[name] = _asked(client.list, name or None, 1, None).get("resource_version", start[name])
                continue
            for e in events:
                meta = (e.get("object") or {}).get("metadata") or {}
                rows.append((e.get("type"), meta.get("uid"), meta.get("namespace"), meta.get("resourceVersion"), json.dumps(e.get("object"), sort_keys=True)))
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """The rows of a batch again: those up to the versions at which it ended."""
        rows, _ = self.read(start)
        last = {name: int(v) for name, v in end.items()}
        return iter([r for r in rows if r[3] is None or r[0] == "RELIST" or int(r[3]) <= last.get(r[2] or "", max(last.values()))])


def options_version(options: dict) -> str:
    return options.get("resource_version", "0")


class ResourceListing(DataSource):
    """Format ``resource_listing``; options client, namespaces (comma-joined), limit, resource_version and the client's own."""

    @classmethod
    def name(cls) -> str:
        return "resource_listing"

    def schema(self) -> str:
        return EVENTS if self.options.get("what") == "events" else SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Watcher(dict(self.options))


class SavedPages:
    """A client over files <namespace>/<n>.json (pages, from 0) and <namespace>/events.jsonl of a folder that all tasks see."""

    def __init__(self, options: dict):
        self.root = Path(options["path"])

    def list(self, namespace: str | None, limit: int, token: str | None) -> dict:
        n = int(token or 0)
        page = json.loads((self.root / (namespace or "all") / f"{n}.json").read_text())
        more = (self.root / (namespace or "all") / f"{n + 1}.json").exists()
        return {"items": page["items"], "continue": str(n + 1) if more else None, "resource_version": page.get("metadata", {}).get("resourceVersion", "0")}

    def watch(self, namespace: str | None, version: str) -> tuple[list[dict], str]:
        file = self.root / (namespace or "all") / "events.jsonl"
        events = [json.loads(x) for x in file.read_text().splitlines()] if file.exists() else []
        at = lambda e: int(e["object"]["metadata"]["resourceVersion"])
        new = [e for e in events if at(e) > int(version)]
        return new, str(max([int(version), *map(at, new)]))
