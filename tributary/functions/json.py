"""JSON text as a column: validity, sub-documents, upper-cased values, rendering of rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_object(text: Column) -> Column:
    """Whether a text is a JSON object, or the literal null; false for other JSON, for no JSON and for null."""
    v = F.try_parse_json(text)
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT") | F.is_variant_null(v), F.lit(False))


def sub_json(text: Column, path: str) -> Column:
    """The part of a JSON text at a path of keys parted by dots, as JSON text.

    A missing key gives {}; a value that isn't an object ends the walk and is the result; an empty path gives the
    text as it is. Null where the text isn't JSON.
    """
    if not path:
        return text
    value, state = F.try_parse_json(text), F.lit("walk")
    for key in path.split("."):
        name = "$['" + key.replace("'", "\\'") + "']"
        is_map = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
        child = F.try_variant_get(value, name, "variant")
        missing = is_map & child.isNull()
        state, value = (
            F.when(state != "walk", state).when(missing, F.lit("missing")).when(~is_map, F.lit("end")).otherwise(F.lit("walk")),
            F.when((state == "walk") & is_map, child).otherwise(value),
        )
    return F.when(F.try_parse_json(text).isNull(), F.lit(None).cast("string")).when(state == "missing", F.lit("{}")).otherwise(F.to_json(value))


#: 102 code points have an upper case of several letters; each stands for itself while upper() works, through the
#: private-use characters from U+E000 on. Those with a one-letter form in simple case mapping take it.
_PRIVATE = 0xE000


def _expanding() -> list[tuple[str, str]]:
    """(letter, its simple upper case) of the letters whose full upper case is longer than one letter."""
    out = []
    for c in range(0x80, 0x1FFFF):
        if 0xD800 <= c < 0xE000:
            continue
        x = chr(c)
        if len(x.upper()) > 1:
            title = x.title()
            out.append((x, title if len(title) == 1 and title != x else x))
    return out


def upper_simple(text: Column) -> Column:
    """Upper case letter by letter: letters that would become several, such as the sharp s, stay."""
    held = _expanding()
    private = "".join(chr(_PRIVATE + i) for i in range(len(held)))
    shielded = F.upper(F.translate(text, "".join(a for a, _ in held), private))
    return F.translate(shielded, private, "".join(b for _, b in held))


def upper_values(value: Column, kind: T.DataType) -> Column:
    """value, of type kind, with the strings in its objects in upper case.

    Structs and maps are objects: their strings change, keys and other values don't, and what they hold is treated
    alike. In an array objects and arrays are treated alike, but strings that stand in it themselves stay.
    A value that is neither object nor array stays.
    """
    if isinstance(kind, T.StructType):
        fields = [(F.when(value[f.name].isNotNull(), _inner(value[f.name], f.dataType))).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, v: _inner(v, kind.valueType))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: upper_values(v, kind.elementType))
    return value


def _inner(value: Column, kind: T.DataType) -> Column:
    return upper_simple(value) if isinstance(kind, T.StringType) else upper_values(value, kind)


def _upper(x: object) -> object:
    if isinstance(x, dict):
        return {k: "".join(_one(c) for c in v) if isinstance(v, str) else _upper(v) for k, v in x.items()}
    if isinstance(x, list):
        return [_upper(v) for v in x]
    return x


_HELD = dict(_expanding())


def _one(c: str) -> str:
    return _HELD.get(c) or c.upper()


def upper_json(text: Column) -> Column:
    """The same for JSON text whose schema isn't known, keys sorted and without spaces; a text that isn't an object or an
    array stays as it is. This is a pandas UDF; where the schema is known, from_json and upper_values stay in the JVM."""

    @F.pandas_udf("string")
    def work(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(_upper_text, na_action="ignore")

    return work(text)


def _upper_text(text: str) -> str:
    try:
        x = json.loads(text)
    except ValueError:
        return text
    return json.dumps(_upper(x), ensure_ascii=False, sort_keys=True, separators=(",", ":")) if isinstance(x, dict | list) else text


#: Type names of a result's columns.
_NAMES = {"long": "integer", "int": "integer", "short": "integer", "byte": "integer", "double": "real", "float": "real", "boolean": "boolean", "binary": "blob", "string": "text"}


def type_names(df: DataFrame) -> list[str]:
    return [_NAMES.get({"bigint": "long"}.get(k, k), k) for _, k in df.dtypes]


def _cells(df: DataFrame, blobs_as_arrays: bool) -> list[Column]:
    from tributary.functions.hashing import byte_values

    return [(byte_values(F.col(c)) if blobs_as_arrays else F.base64(c)).alias(c) if k == "binary" else F.col(c) for c, k in df.dtypes]


def associative_rows(df: DataFrame, blobs_as_arrays: bool = False, pretty: bool = False) -> DataFrame:
    """One JSON object a row (column row): names and values, nulls included; binary as base64, or as arrays of numbers."""
    options = {"ignoreNullFields": "false", "pretty": str(pretty).lower()}
    return df.select(F.to_json(F.struct(*_cells(df, blobs_as_arrays)), options).alias("row"))


def value_rows(df: DataFrame, blobs_as_arrays: bool = False) -> DataFrame:
    """One JSON array a row (column row): the values in order of the columns."""
    parts = [F.coalesce(F.regexp_extract(F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"}), r"(?s)^\{\"v\":(.*)\}$", 1), F.lit("null")) for c in _cells(df, blobs_as_arrays)]
    return df.select(F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]")).alias("row"))


def execute_rows(df: DataFrame) -> DataFrame:
    """One JSON object a row (column row) of results (last_insert_id, rows_affected, error, time): without what is 0, empty
    or null, whole times without a fraction."""
    held = lambda c, empty: F.when(F.col(c) != empty, F.col(c)).alias(c)
    made = F.to_json(F.struct(held("last_insert_id", 0), held("rows_affected", 0), held("error", ""), held("time", 0.0)))
    return df.select(F.regexp_replace(made, r'("time":[0-9]+)\.0\}$', "$1}").alias("row"))


def render_result(result: object, associative: bool = False, blobs_as_arrays: bool = False) -> str:
    """One result as JSON by its kind: a query's rows, a statement's outcome (a dict), or an error (a text)."""
    if isinstance(result, DataFrame):
        return render(result, associative, blobs_as_arrays)
    if isinstance(result, str) and result:
        return json.dumps({"error": result}, ensure_ascii=False, separators=(",", ":"))
    if isinstance(result, dict):
        kept = {k: result[k] for k in ("last_insert_id", "rows_affected", "error", "time") if result.get(k)}
        if isinstance(kept.get("time"), float) and kept["time"].is_integer():
            kept["time"] = int(kept["time"])
        return json.dumps(kept | ({"rows": None} if associative else {}), ensure_ascii=False, separators=(",", ":"))
    raise ValueError("neither rows, nor an outcome, nor an error")


def render(df: DataFrame, associative: bool = False, blobs_as_arrays: bool = False, types: list[str] | None = None, limit: int = 10_000) -> str:
    """A result as one JSON document, for a client: {"columns", "types", "values"}, or {"types", "rows"}.

    The driver holds the rows, so a result of more than limit rows is an error, as is a list of types that doesn't
    match the columns.
    """
    types = type_names(df) if types is None else types
    if len(types) != len(df.columns):
        raise ValueError("types and columns differ in length")
    made = associative_rows(df, blobs_as_arrays) if associative else value_rows(df, blobs_as_arrays)
    rows = [r[0] for r in made.take(limit + 1)]
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows")
    text = lambda x: json.dumps(x, ensure_ascii=False, separators=(",", ":"))
    if associative:
        return f'{{"types":{text(dict(zip(df.columns, types, strict=True)))},"rows":[{",".join(rows)}]}}'
    return f'{{"columns":{text(df.columns)},"types":{text(types)},"values":[{",".join(rows)}]}}'
