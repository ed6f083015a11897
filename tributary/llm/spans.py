"""Spans of regular expressions in texts by built-in functions only, and the same in DuckDB's SQL.

A kind's matches are the leftmost ones that don't overlap. Their places follow from the lengths of what lies between
them: a text is split by the pattern, and a running sum over pieces and matches gives starts and ends in code points.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tributary.llm.common import ROW


def either(word: str) -> str:
    """A pattern for an ASCII word with its letters in either case, alike in every dialect."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


def words(*those: str) -> str:
    return "(" + "|".join(either(w) for w in those) + ")"


@dataclass(frozen=True)
class Kind:
    """One kind of span.

    pattern is Java's, sql_pattern RE2's; both find the same. ok and sql_ok test a match; context, if any, is looked
    for in the code points around it. gate holds literals of which every match has one: texts without any aren't searched.
    """

    name: str
    pattern: str
    sql_pattern: str
    ok: Callable[[Column], Column] = field(default=lambda m: F.lit(True))
    sql_ok: str = "true"
    context: str | None = None
    gate: tuple[str, ...] = ()


#: Code points before a match, and after it, in which its context words are looked for, past one other match of its kind
#: at most.
AROUND = 40


def context(*those: str) -> str:
    """A pattern for one of these words, or its plural, in either case, as a whole word."""
    return "(^|[^A-Za-z0-9])" + words(*those) + "[sS]?([^A-Za-z0-9]|$)"


def gated(k: Kind, text: Column) -> Column:
    """Whether a text has what every match of a kind needs."""
    return functools.reduce(lambda a, b: a | b, [text.contains(g) for g in k.gate], F.lit(not k.gate))


def proposals(df: DataFrame, kinds: list[Kind], id: str = "id", text: str = "text") -> DataFrame:
    """(__row, id, kind, i, gap, len, ok, near) for each match of each kind; one row of nulls for a row of df without any."""
    base = df.select(ROW, id, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__t"))
    found = base.select(ROW, id, "__t", *[F.when(gated(k, F.col("__t")), F.regexp_extract_all("__t", F.lit(k.pattern), F.lit(0))).alias(f"__m{i}") for i, k in enumerate(kinds)])
    found = found.select("*", *[F.when(F.size(f"__m{i}") > 0, F.split("__t", k.pattern, -1)).alias(f"__p{i}") for i, k in enumerate(kinds)])

    def located(i: int, k: Kind) -> Column:
        ms, ps = F.col(f"__m{i}"), F.col(f"__p{i}")
        some = lambda a, at: F.coalesce(F.get(a, at), F.lit(""))

        def near(at: Column) -> Column:
            if not k.context:
                return F.lit(False)
            before = F.concat(some(ps, at - 1), some(ms, at - 1), some(ps, at))
            after = F.concat(some(ps, at + 1), some(ms, at + 1), some(ps, at + 2))
            return F.substring(before, -AROUND, AROUND).rlike(k.context) | F.substring(after, 1, AROUND).rlike(k.context)

        def one(m: Column, at: Column) -> Column:
            ok = F.coalesce(k.ok(m), F.lit(False))
            return F.struct(F.lit(i).alias("kind"), at.alias("i"), F.length(F.get(ps, at)).alias("gap"), F.length(m).alias("len"), ok.alias("ok"), F.when(ok, near(at)).otherwise(False).alias("near"))

        named = F.transform(ms, one)
        none = F.array().cast("array<struct<kind:int,i:int,gap:int,len:int,ok:boolean,near:boolean>>")
        return F.when(F.size(f"__m{i}") > 0, named).otherwise(none)

    each = F.concat(*[located(i, k) for i, k in enumerate(kinds)])
    return found.select(ROW, id, F.explode_outer(each).alias("x")).select(ROW, id, "x.*")


def places(found: DataFrame) -> DataFrame:
    """found with start and end (exclusive), in code points. Each row's matches are together then, in no order."""
    upto = F.sum(F.col("gap").cast("long") + F.col("len")).over(W.partitionBy(ROW, "kind").orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    return found.repartition(ROW).withColumn("end", upto).withColumn("start", F.col("end") - F.col("len"))


def joined(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end, comma-joined, of an array of structs that begin with start, kind (its number) and end."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def places_sql(kinds: list[Kind], table: str = "documents", id: str = "doc_id", text: str = "text") -> str:
    """CTEs docs (r, id, t) and spans (r, kind, start, "end", ok, near) of all matches, in DuckDB's SQL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    arms = []
    for i, k in enumerate(kinds):
        side = lambda *parts: " || ".join(f"coalesce({p}, '')" for p in parts)
        before, after = side("case when n > 1 then ps[n - 1] end", "case when n > 1 then ms[n - 1] end", "ps[n]"), side("ps[n + 1]", "ms[n + 1]", "ps[n + 2]")
        near = f"regexp_matches(right({before}, {AROUND}), {q(k.context)}) or regexp_matches(left({after}, {AROUND}), {q(k.context)})" if k.context else "false"
        arms.append(f"""
    select r, {i} as kind, list_sum(list_transform(ps[1:n], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:n - 1], lambda x: length(x))), 0) as start, length(ms[n]) as len, ms[n] as m, ({near}) as near, {k.sql_ok.replace("{m}", "ms[n]")} as ok
    from (select r, ms, ps, unnest(range(1, len(ms) + 1)) as n from (select r, regexp_extract_all(t, {q(k.sql_pattern)}) as ms, string_split_regex(t, {q(k.sql_pattern)}) as ps from docs))""")
    return f"""docs as (select row_number() over () as r, {id} as id, coalesce({text}, '') as t from {table}),
spans as (select r, kind, start, start + len as "end", ok, near from ({' union all '.join(arms)}))"""


def names_sql(kinds: list[str], column: str = "kind") -> str:
    return "case " + column + " " + " ".join(f"when {i} then '{k}'" for i, k in enumerate(kinds)) + " end"
