"""A document database as a data source: stored documents as a batch, its change feed as a stream."""

from __future__ import annotations

import importlib
import itertools
import json
import time
from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tributary.sources.formats import retried

#: A change event, as text columns where its shape is open.
CHANGE = (
    "`_id` map<string,string>, documentKey map<string,string>, operationType string, fullDocument string, wallTime string, "
    "ns struct<db:string,coll:string>, updateDescription struct<updatedFields:map<string,string>,removedFields:array<string>,truncatedArrays:array<string>>, clusterTime string"
)


class Client(Protocol):
    """What a driver of the database must do. Tokens are texts that order the feed.

    parts() cuts the stored documents into parts for as many tasks; snapshot() reads one. start() is where a new reader
    begins, latest() where the feed is now. changes() gives every event after one token up to another: it waits for
    those that are late, and fails rather than leave any out. upsert() stores documents under their _id. A client has
    those of these methods that its source or sink needs.
    """

    def parts(self, options: dict[str, str], n: int) -> list[str]: ...

    def snapshot(self, options: dict[str, str], part: str) -> Iterator[dict]: ...

    def start(self, options: dict[str, str]) -> str: ...

    def latest(self, options: dict[str, str]) -> str: ...

    def changes(self, options: dict[str, str], after: str, upto: str) -> Iterator[dict]: ...

    def upsert(self, options: dict[str, str], documents: list[dict]) -> None: ...


class PymongoClient:
    """The client that pymongo makes, where it is installed. A feed's tokens are its resume tokens, which sort by their text."""

    def _collection(self, options: dict[str, str]):
        pymongo = importlib.import_module("pymongo")
        return pymongo.MongoClient(options["uri"])[options["database"]][options["collection"]]

    def parts(self, options: dict[str, str], n: int) -> list[str]:
        """Ranges of _id that hold about as many documents each, as the server's $bucketAuto finds them."""
        if n < 2:
            return ["{}"]
        dumps = importlib.import_module("bson.json_util").dumps
        buckets = list(self._collection(options).aggregate([{"$bucketAuto": {"groupBy": "$_id", "buckets": n}}], allowDiskUse=True))
        edges = [None, *(b["_id"]["min"] for b in buckets[1:]), None]
        return [dumps({k: v for k, v in (("$gte", a), ("$lt", b)) if v is not None}) for a, b in zip(edges, edges[1:], strict=False)]

    def snapshot(self, options: dict[str, str], part: str) -> Iterator[dict]:
        asked = json.loads(options.get("filter", "{}"))
        if part != "{}":
            asked = {"$and": [asked, {"_id": importlib.import_module("bson.json_util").loads(part)}]}
        yield from self._collection(options).find(asked, json.loads(options["projection"]) if options.get("projection") else None)

    def start(self, options: dict[str, str]) -> str:
        return self.latest(options)

    def latest(self, options: dict[str, str]) -> str:
        with self._collection(options).watch(full_document="updateLookup") as feed:
            feed.try_next()
            return json.dumps(feed.resume_token)

    def changes(self, options: dict[str, str], after: str, upto: str) -> Iterator[dict]:
        sort = lambda token: token["_data"]
        end, deadline = sort(json.loads(upto)), time.monotonic() + float(options.get("timeout", "60"))
        with self._collection(options).watch(full_document="updateLookup", **({"resume_after": json.loads(after)} if after else {})) as feed:
            while True:
                event = feed.try_next()
                if event is None:
                    # Nothing just now: the feed has passed the end, or the event is still on its way.
                    if feed.resume_token and sort(feed.resume_token) >= end:
                        return
                    if time.monotonic() > deadline:
                        raise TimeoutError(f"the feed didn't reach {upto}")
                    continue
                if sort(event["_id"]) > end:
                    return
                yield event
                if sort(event["_id"]) == end:
                    return


    def upsert(self, options: dict[str, str], documents: list[dict]) -> None:
        replace = importlib.import_module("pymongo").ReplaceOne
        self._collection(options).bulk_write([replace({"_id": d["_id"]}, d, upsert=True) for d in documents], ordered=False)


def client(options: dict[str, str]) -> Client:
    """The client that the option client names as module:factory, else pymongo's."""
    where = options.get("client")
    if not where:
        return PymongoClient()
    module, _, name = where.partition(":")
    return getattr(importlib.import_module(module), name)()


def _text(document: object) -> str:
    return json.dumps(document, default=str, ensure_ascii=False)


class _Snapshot(DataSourceReader):
    """Stored documents, as many tasks at a time as the option partitions says."""

    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in client(self.options).parts(self.options, int(self.options.get("partitions", "1")))]

    def read(self, partition: InputPartition) -> Iterator[tuple[str]]:
        for document in client(self.options).snapshot(self.options, partition.value):
            yield (_text(document),)


class _Span(InputPartition):
    def __init__(self, after: str, upto: str):
        self.after, self.upto = after, upto


class _Feed(DataSourceStreamReader):
    """Offsets are resume tokens, kept in the query's checkpoint from its first batch on: no change is lost, and none is
    read twice. A new query begins where the feed is when it starts, or at the option start_token, which a pipeline
    takes before it reads what is stored, so that nothing falls between the two."""

    def __init__(self, options: dict[str, str]):
        self.options = options

    def initialOffset(self) -> dict:
        return {"token": self.options["start_token"] if "start_token" in self.options else client(self.options).start(self.options)}

    def latestOffset(self) -> dict:
        return {"token": client(self.options).latest(self.options)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Span(start["token"], end["token"])] if start != end else []

    def read(self, partition: _Span) -> Iterator[tuple[str]]:
        for event in client(self.options).changes(self.options, partition.after, partition.upto):
            yield (_text(event),)


class _Upsert(DataSourceWriter):
    """Rows' documents under their _id, in bulk, so that a task that is tried again changes nothing."""

    def __init__(self, options: dict[str, str]):
        self.options = options

    def write(self, rows: Iterator) -> WriterCommitMessage:
        to, size = client(self.options), int(self.options.get("batch", "500"))
        while held := list(itertools.islice(rows, size)):
            documents = [json.loads(r["value"]) for r in held if r["value"] is not None]
            if documents := [d for d in documents if isinstance(d, dict) and "_id" in d]:
                retried(lambda documents=documents: to.upsert(self.options, documents), int(self.options.get("tries", "5")))
        return WriterCommitMessage()


class DocumentSource(DataSource):
    """Text of documents (batch, read or written) or of change events (stream), in a column value."""

    @classmethod
    def name(cls) -> str:
        return "tributary_documents"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return _Snapshot(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Feed(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Upsert(dict(self.options))


def decode(value: Column) -> Column:
    """A change event's text as a struct."""
    return F.from_json(value, CHANGE)


def full_documents(events: DataFrame) -> DataFrame:
    """The documents after each change; changes that leave none, as deletions, have no row."""
    return events.select(decode(F.col("value"))["fullDocument"].alias("value")).where("value is not null")
