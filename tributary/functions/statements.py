"""Statements with parameters, as clients send them: parsed on the driver, run by the session."""

from __future__ import annotations

import json
import re
import threading
import time
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession


class UnsupportedType(ValueError):
    """A parameter that is an object, or an array of anything but numbers from 0 to 255."""


@dataclass(frozen=True)
class Statement:
    sql: str
    positional: list = field(default_factory=list)
    named: dict = field(default_factory=dict)


def parameter(value: object) -> object:
    """A JSON value as a parameter: numbers as long or double, arrays of bytes as binary, null as null."""
    if value is None or isinstance(value, bool | int | float | str):
        return value
    if isinstance(value, list) and all(isinstance(x, int) and not isinstance(x, bool) and 0 <= x <= 255 for x in value):
        return bytearray(value)
    raise UnsupportedType(f"unsupported type: {type(value).__name__}")


def parse_request(body: str) -> list[Statement]:
    """Statements of a JSON array: each a text, or an array of a text, parameters by position, and objects with
    parameters by name. No statements, other JSON and no JSON are errors."""
    try:
        items = json.loads(body)
    except ValueError as e:
        raise ValueError("invalid JSON body") from e
    if not isinstance(items, list) or not items:
        raise ValueError("no statements" if items == [] else "invalid request")
    out = []
    for item in items:
        if isinstance(item, str):
            out.append(Statement(item))
            continue
        if not isinstance(item, list) or not item or not isinstance(item[0], str):
            raise ValueError("invalid request")
        named, positional = {}, []
        for x in item[1:]:
            if isinstance(x, dict):
                named |= {k: parameter(v) for k, v in x.items()}
            else:
                positional.append(parameter(x))
        out.append(Statement(item[0], positional, named))
    return out


def run(spark: SparkSession, statement: Statement) -> DataFrame:
    """The statement's result, with its parameters bound, never pasted into its text."""
    if statement.positional and statement.named:
        raise ValueError("parameters by position and by name in one statement")
    return spark.sql(statement.sql, args=statement.named or statement.positional or None)


def run_all(spark: SparkSession, statements: list[Statement]) -> list[tuple[DataFrame | None, str | None]]:
    """(result, error) of each statement; one that fails doesn't stop the others."""
    out = []
    for s in statements:
        try:
            out.append((run(spark, s), None))
        except (PySparkException, ValueError) as e:
            out.append((None, str(e).strip().partition("\n")[0]))
    return out


@dataclass(frozen=True)
class Request:
    """Statements that are run together. In a transaction the first error ends the request, and nothing after it is run;
    what ran before it isn't undone, for tables of files have no transactions. timeout, in seconds, holds for each
    statement; 0 is none. With timings each result says how long it took."""

    statements: list[Statement]
    transaction: bool = False
    timeout: float = 0.0
    timings: bool = False


def run_request(spark: SparkSession, request: Request, most: int = 10_000) -> list[dict[str, object]]:
    """{"columns", "rows"} or {"error"} of each statement, and "time" in seconds. A result of more than most rows is an error."""
    out: list[dict[str, object]] = []
    for s in request.statements:
        began, tag = time.perf_counter(), f"statement-{uuid.uuid4().hex}"
        late = threading.Event()
        timer = threading.Timer(request.timeout, lambda tag=tag, late=late: (late.set(), spark.sparkContext.cancelJobsWithTag(tag))) if request.timeout else None
        spark.sparkContext.addJobTag(tag)
        try:
            if timer:
                timer.start()
            df = run(spark, s)
            rows = df.take(most + 1)
            made: dict[str, object] = {"error": f"more than {most} rows"} if len(rows) > most else {"columns": df.columns, "rows": [tuple(r) for r in rows]}
        except (PySparkException, ValueError, Py4JJavaError) as e:
            made = {"error": "timeout" if late.is_set() else str(e).strip().partition("\n")[0]}
        finally:
            spark.sparkContext.removeJobTag(tag)
            if timer:
                timer.cancel()
        if request.timings:
            made["time"] = time.perf_counter() - began
        out.append(made)
        if request.transaction and "error" in made:
            break
    return out


_PART = re.compile(r"([0-9]*\.?[0-9]+|[0-9]+\.)(ns|us|µs|μs|ms|s|m|h)")
_NANOS = {"ns": 1, "us": 10**3, "µs": 10**3, "μs": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9}


def duration(text: str) -> int:
    """Nanoseconds of a duration such as 1m30s, 1.5h, -10ms or 0."""
    sign, rest = (-1, text[1:]) if text[:1] == "-" else (1, text.removeprefix("+"))
    if rest == "0":
        return 0
    at, total = 0, 0.0
    while at < len(rest) and (m := _PART.match(rest, at)):
        total, at = total + float(m[1]) * _NANOS[m[2]], m.end()
    if not rest or at < len(rest):
        raise ValueError(f"invalid duration {text!r}")
    return sign * round(total)


#: Names of a request's options that are durations or whole numbers.
_DURATIONS, _NUMBERS = ("timeout", "freshness", "db_timeout", "linearizable_timeout"), ("chunk_kb", "retries")


def query_params(raw: dict[str, str]) -> dict[str, object]:
    """A request's options, checked and typed. freshness_strict needs freshness; q, if given, can't be empty; flags are
    true by being there; level is none, weak, strong or auto, and weak if it is anything else."""
    if "freshness_strict" in raw and "freshness" not in raw:
        raise ValueError("freshness_strict requires freshness")
    if "q" in raw and not raw["q"]:
        raise ValueError("query parameter not set")
    out: dict[str, object] = dict(raw)
    for name in _DURATIONS:
        if raw.get(name):
            out[name] = duration(raw[name])
    for name in _NUMBERS:
        if raw.get(name):
            out[name] = int(raw[name])
    asked = raw.get("level", "").lower()
    out["level"] = asked if asked in ("none", "weak", "strong", "auto") else "weak"
    for flag in ("freshness_strict", "pretty", "associative", "timings", "transaction", "blob_array", "redirect", "wait", "queue", "noleader"):
        out[flag] = flag in raw
    out["format"] = "sql" if raw.get("fmt") == "sql" else "binary"
    return out
