"""Secrets in texts: strong patterns, and weak candidates that are reported where complementary parts meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tributary.llm.common import ROW, documents, rows
from tributary.llm.spans import Kind, either, joined, names_sql, places, places_sql, proposals, words

#: Code points between parts of one credential at most.
SCOPE = 200

_KEYS = "(" + "|".join([*map(either, ("password", "passwd", "secret", "token")), either("api") + "_?" + either("key")]) + ")"
_SET = r"""["']?\x20*[:=]\x20*["']?"""
_SQL_SIX = r"""length(regexp_extract({m}, '^[A-Za-z_]+["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 6"""
_HOLDS = lambda m: m.rlike("[0-9]") & m.rlike("[a-z]") & m.rlike("[A-Z]")
_SQL_HOLDS = "regexp_matches({m}, '[0-9]') and regexp_matches({m}, '[a-z]') and regexp_matches({m}, '[A-Z]')"
#: No letter, digit or underscore goes before a key word: Java's way and RE2's.
_HEAD, _SQL_HEAD = r"(?<![A-Za-z0-9_])", r"\b"
_IDENT = words("user", "username", "user_name", "login", "account", "client_id", "access_id") + _SET + "[A-Za-z0-9_.@-]{3,64}"
_URL = "(https?|ftp|ssh|jdbc:[a-z]+|mongodb|redis|amqp)://[A-Za-z0-9.-]+"
_HOST = words("host", "hostname", "endpoint", "server") + _SET + "[A-Za-z0-9.-]{4,}"
_PASS = words("pass", "pwd", "credential", "private_key", "auth") + _SET + "[A-Za-z0-9+/_.=-]{4,}"

_SIGNS = (":", "=")
#: In order of their listing. The first three are reported by themselves, the others only as parts of a credential.
KINDS = [
    Kind("assign", _KEYS + _SET + "([A-Za-z0-9+/_.=-]+)", _KEYS + _SET + "([A-Za-z0-9+/_.=-]+)", lambda m: F.length(F.regexp_extract(m, "^" + _KEYS + _SET + "([A-Za-z0-9+/_.=-]+)$", 2)) >= 6, _SQL_SIX, gate=_SIGNS),
    Kind("access", "AKIA[A-Z0-9]{16,}+", "AKIA[A-Z0-9]{16,}", gate=("AKIA",)),
    Kind("hex", "(?<![0-9a-f])[0-9a-f]{24,}+", "[0-9a-f]{24,}"),
    Kind("ident", _HEAD + _IDENT, _SQL_HEAD + _IDENT, gate=_SIGNS),
    Kind("weak_key", "[A-Za-z0-9+/]{40,}+", "[A-Za-z0-9+/]{40,}", _HOLDS, _SQL_HOLDS),
    Kind("weak_pass", _HEAD + _PASS, _SQL_HEAD + _PASS, gate=_SIGNS),
    Kind("endpoint", _URL, _URL, gate=("://",)),
    Kind("host", _HEAD + _HOST, _SQL_HEAD + _HOST, gate=_SIGNS),
]
NAMES = [k.name for k in KINDS]
BASE = 3
#: Which part of a credential a kind is. A weak part needs another part nearby: a secret an identifier or an endpoint,
#: these a secret, weak or strong.
SECRET, OTHER = ["assign", "hex", "weak_key", "weak_pass"], ["access", "ident", "endpoint", "host"]


def find_secrets(df: DataFrame, text: str = "text", id: str = "doc_id", scope: int = SCOPE) -> DataFrame:
    """(__row, id, spans): for each row an array of (start, kind, end, part), kind being a number in KINDS.

    Strong kinds (assign, access, hex) are reported by themselves. Access identifiers, secrets and endpoints are parts
    of multipart credentials: intervals are joined within a scope, and a weak candidate is reported only where a
    complementary part ends scope code points or less before it, or starts as shortly after it; parts that overlap are
    no neighbours. part is the nearest complementary one (start, kind, end), the earlier of two as near; strong spans have
    it too, where there is one. The join is a running maximum over the parts' ends and a minimum over their starts, in
    order of place, so its size is that of the parts. Built-in functions only.

    Null texts are empty; rows without spans have an empty array; repeated rows each get one. An empty table gives an
    empty result. Other columns are ignored, whatever their names. df is a stored table, read alike each time: rows are
    told apart by their place in it.
    """
    found = places(proposals(rows(df, id=id, text=text), KINDS)).withColumn("kind", F.when(F.col("ok"), F.col("kind")))
    number = {k: i for i, k in enumerate(NAMES)}
    role = lambda of: F.col("kind").isin([number[k] for k in of])
    # Each part twice: where it starts, and where it ends. At one place ends come before starts.
    point = lambda at, first: F.struct(F.col(at).alias("at"), F.lit(first).alias("first"))
    points = found.select(ROW, "id", "kind", "start", "end", F.explode(F.array(point("end", 0), point("start", 1))).alias("p")).select(ROW, "id", "kind", "start", "end", "p.*")
    order = W.partitionBy(ROW).orderBy("at", "first", "start", "kind")
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(1, W.unboundedFollowing)
    last = lambda of: F.max(F.when((F.col("first") == 0) & role(of), F.struct("end", (-F.col("start")).alias("back"), (-F.col("kind")).alias("down"), "start", "kind"))).over(before)
    next_ = lambda of: F.min(F.when((F.col("first") == 1) & role(of), F.struct("start", "kind", "end"))).over(after)
    told = points.select(ROW, "id", "kind", "start", "end", "first", F.when(role(SECRET), last(OTHER)).when(role(OTHER), last(SECRET)).alias("last"), F.when(role(SECRET), next_(OTHER)).when(role(OTHER), next_(SECRET)).alias("next"))
    # What is before counts from the start, what is after from the end.
    side = lambda gap, of: F.when(gap <= scope, F.struct(gap.alias("gap"), F.col(f"{of}.start").alias("start"), F.col(f"{of}.kind").alias("kind"), F.col(f"{of}.end").alias("end")))
    told = told.withColumn("near", F.when(F.col("first") == 1, side(F.col("start") - F.col("last.end"), "last")).otherwise(side(F.col("next.start") - F.col("end"), "next")))
    whole = told.groupBy(ROW, "id", "start", "kind", "end").agg(F.min("near").alias("near"))
    part = F.when(F.col("near").isNotNull(), F.struct("near.start", "near.kind", "near.end")).alias("part")
    reported = F.when((F.col("kind") < BASE) | F.col("near").isNotNull(), F.struct("start", "kind", "end", part))
    return whole.groupBy(ROW, "id").agg(F.sort_array(F.collect_list(reported)).alias("spans"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    out = find_secrets(documents(spark, sf_dir))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{NAMES[k]}")
    base = F.filter("spans", lambda x: x["kind"] < BASE)
    return out.select(F.col("id").alias("doc_id"), *map(count, range(BASE)), F.sha2(joined(base, NAMES), 256).alias("base_sha256"), joined(F.col("spans"), NAMES).alias("spans"), _linked().alias("links"))


def _linked() -> Column:
    """span-part, comma-joined, of the spans with a complementary part, each as kind:start:end."""
    names = F.array(*[F.lit(k) for k in NAMES])
    one = lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))
    return F.array_join(F.transform(F.filter("spans", lambda x: x["part"].isNotNull()), lambda x: F.concat(one(x), F.lit("-"), one(x["part"]))), ",")


def _numbers(of: list[str]) -> str:
    return "(" + ", ".join(str(NAMES.index(k)) for k in of) + ")"


_ONE = f"""{names_sql(NAMES)} || ':' || start || ':' || "end" """
_COMPLEMENT = f"""((a.kind in {_numbers(SECRET)} and b.kind in {_numbers(OTHER)}) or (a.kind in {_numbers(OTHER)} and b.kind in {_numbers(SECRET)}))"""
SQL = f"""with {places_sql(KINDS)},
parts as (select * from spans where ok),
pairs as (select a.r, a.kind, a.start, a."end", case when b."end" <= a.start then a.start - b."end" else b.start - a."end" end as gap, b.start as s, b.kind as k, b."end" as e
  from parts a join parts b on a.r = b.r and {_COMPLEMENT} and (b."end" <= a.start or b.start >= a."end") and b.start <= a."end" + {SCOPE} and b."end" >= a.start - {SCOPE}),
nearest as (select r, kind, start, "end", min((gap, s, k, e)) as x from pairs where gap <= {SCOPE} group by all),
told as (select parts.r, parts.kind, parts.start, parts."end", n.x as x from parts left join nearest n on n.r = parts.r and n.kind = parts.kind and n.start = parts.start where parts.kind < {BASE} or n.x is not null),
each as (select r, {", ".join(f"count(*) filter (where kind = {i}) as n_{NAMES[i]}" for i in range(BASE))}, string_agg({_ONE}, ',' order by start, kind) filter (where kind < {BASE}) as base, string_agg({_ONE}, ',' order by start, kind) as spans,
  string_agg({_ONE} || '-' || {names_sql(NAMES, "x[3]")} || ':' || x[2] || ':' || x[4], ',' order by start, kind) filter (where x is not null) as links from told group by r)
select id as doc_id, {", ".join(f"coalesce(n_{NAMES[i]}, 0) as n_{NAMES[i]}" for i in range(BASE))}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(links, '') as links from docs left join each using (r)"""
