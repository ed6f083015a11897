"""Writers that send documents to a service in bulk."""

from __future__ import annotations

import importlib
import itertools
import json
import socket
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.sources.formats import retried


def bulk_lines(rows: list[tuple[str, str]], index: str) -> str:
    """The body of a bulk request: for each (id, document) an update that inserts where there is nothing yet."""
    out = []
    for id_, document in rows:
        out += [json.dumps({"update": {"_index": index, "_id": id_}}), f'{{"doc":{document},"doc_as_upsert":true}}']
    return "\n".join(out) + "\n"


def post(url: str, body: str, headers: dict[str, str]) -> None:
    """Sends a bulk request; any answer but 2xx, or one that reports errors, is an error."""
    request = urllib.request.Request(url, body.encode(), {"Content-Type": "application/x-ndjson", **headers})
    with urllib.request.urlopen(request, timeout=60) as answer:
        if answer.status // 100 != 2 or json.loads(answer.read() or b"{}").get("errors"):
            raise OSError(f"bulk request failed: {answer.status}")


def push(url: str, body: str, headers: dict[str, str]) -> None:
    """Appends lines to a list of a redis server: url is redis://host:port/list, one command for all of them."""
    at = urllib.parse.urlparse(url)
    words = [b"RPUSH", at.path.strip("/").encode() or b"records", *body.encode().splitlines()]
    command = b"*%d\r\n" % len(words) + b"".join(b"$%d\r\n%s\r\n" % (len(w), w) for w in words)
    with socket.create_connection((at.hostname or "localhost", at.port or 6379), timeout=60) as connection:
        connection.sendall(command)
        answer = connection.makefile("rb").readline()
    if not answer.startswith(b":"):
        raise OSError(f"push failed: {answer.decode(errors='replace').strip()}")


def with_ids(df: DataFrame, order: str | None = None) -> DataFrame:
    """(id, value): a document's _id, without documents that have none; of a repeated id the one that is last by order.

    order is a path in the documents, such as $.updatedAt; numbers sort as such, other values as texts, and equal ones
    by the whole document, so a batch that is tried again sends the same. Without it the place in the batch decides,
    which is the same again only if the batch is read in one order, as files are.
    """
    place = F.monotonically_increasing_id()
    if order:
        at = F.get_json_object("value", order)
        place = F.struct(at.isNotNull(), at.try_cast("double"), at, "value")
    made = df.select(F.get_json_object("value", "$._id").alias("id"), "value", place.alias("at")).where("id is not null")
    return made.groupBy("id").agg(F.max_by("value", "at").alias("value"))


def _sender(where: str | None) -> Callable[[str, str, dict[str, str]], None]:
    module, _, name = (where or "tributary.sources.sinks:post").partition(":")
    return getattr(importlib.import_module(module), name)


def _in_bulk(df: DataFrame, size: int, send: Callable[[list], None], tries: int = 5) -> None:
    """send(rows) for every size rows of each partition, on the executors; a request that fails is tried again."""

    def work(rows: Iterator) -> None:
        while held := list(itertools.islice(rows, size)):
            retried(lambda held=held: send(held), tries)

    df.foreachPartition(work)


def send_lines(df: DataFrame, config: dict[str, str], size: int = 500) -> None:
    """Posts records to a url, one a line. At least once: a batch that is tried again is sent again."""
    url, where = config["url"], config.get("sender")
    headers = {k.removeprefix("header."): v for k, v in config.items() if k.startswith("header.")}
    _in_bulk(df.where("value is not null").select("value"), size, lambda rows: _sender(where)(url, "\n".join(r["value"] for r in rows) + "\n", headers), int(config.get("tries", "5")))


def write_documents(df: DataFrame, config: dict[str, str], size: int = 500) -> None:
    """Upserts documents by their _id, in bulk requests from the executors. Sending a batch again changes nothing, so a
    stream's retries are harmless. The option sender names another function as module:function."""
    url = config.get("url", "http://localhost:9200").rstrip("/") + "/_bulk?refresh=true"
    headers = {"Authorization": f"ApiKey {config['api_key']}"} if config.get("api_key") else {}
    index, where = config["index_name"], config.get("sender")
    _in_bulk(with_ids(df, config.get("order")), size, lambda rows: _sender(where)(url, bulk_lines([(r["id"], r["value"]) for r in rows], index), headers), int(config.get("tries", "5")))


def dump_json(df: DataFrame, path: str) -> None:
    """Rows as lines of JSON, to look at."""
    df.write.mode("overwrite").json(path)
