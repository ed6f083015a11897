"""Personal data in texts: expressions propose spans, checksums confirm them, words nearby adjust their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.common import ROW, cut, documents, numbered, renamed, rows
from tributary.llm.spans import Kind, context, gated, joined, names_sql, places, places_sql, proposals

_LOCAL, _LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
_EMAIL = rf"[{_LOCAL}]+@[{_LABEL}]+(\.[{_LABEL}]+)+"
_IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
_BYTE = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
_BYTES = rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: The lengths of ibans by country.
IBAN_LENGTHS = """AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27
GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 MC27 MD24 ME22 MK19 MR27 MT31
MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20""".split()


def _iban() -> str:
    """As many letters and digits as the country has, with or without single spaces: what follows is not taken in."""
    by_length: dict[int, list[str]] = {}
    for x in IBAN_LENGTHS:
        by_length.setdefault(int(x[2:]), []).append(x[:2])
    return "(" + "|".join(f"({'|'.join(c)})[0-9][0-9]" + r"(\x20?[A-Z0-9])" + f"{{{n - 4}}}" for n, c in sorted(by_length.items())) + ")"


_IBAN = _iban()
_SSN = "[0-9]{3}-[0-9]{2}-[0-9]{4}"


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _characters(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda x: x != "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    value = F.transform(_characters(F.reverse(d)), lambda x, i: x.cast("int") * (1 + i % 2))
    return F.aggregate(value, F.lit(0), lambda a, v: a + v - F.when(v > 9, 9).otherwise(0)) % 10 == 0


def mod_97(s: Column) -> Column:
    """Whether an IBAN without spaces passes its check: country and check digits moved to the end, A as 10, rest 1 by 97."""
    turned = F.concat(F.substr(s, F.lit(5)), F.substring(s, 1, 4))

    def step(a: Column, x: Column) -> Column:
        return (a * F.when(x >= "A", 100).otherwise(10) + F.when(x >= "A", F.ascii(x) - 55).otherwise(F.ascii(x) - 48)) % 97

    return F.aggregate(_characters(turned), F.lit(0), step) == 1


def card_ok(m: Column) -> Column:
    d = digits(m)
    return F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False)


def iban_ok(m: Column) -> Column:
    s = F.replace(m, F.lit(" "), F.lit(""))
    return F.when(F.length(s).between(15, 34), mod_97(s)).otherwise(False)


_SQL_DIGITS = "regexp_replace({m}, '[^0-9]', '', 'g')"
_SQL_CARD = f"""length({_SQL_DIGITS}) between 14 and 19 and list_sum(list_transform(range(1, length({_SQL_DIGITS}) + 1), lambda i:
  case when (i % 2) = 1 then cast(substr(reverse({_SQL_DIGITS}), i, 1) as bigint) else (2 * cast(substr(reverse({_SQL_DIGITS}), i, 1) as bigint)) // 10 + (2 * cast(substr(reverse({_SQL_DIGITS}), i, 1) as bigint)) % 10 end)) % 10 = 0"""
_SQL_IBAN_TEXT = "replace({m}, ' ', '')"
#: 34 characters may make 68 digits, more than uhugeint holds; the first 16 characters' remainder goes before the rest.
_SQL_IBAN = f"""length({_SQL_IBAN_TEXT}) between 15 and 34 and (cast(cast(list_aggregate(list_transform(string_split(substr(substr({_SQL_IBAN_TEXT}, 5) || substr({_SQL_IBAN_TEXT}, 1, 4), 1, 16), ''), lambda c:
  case when c between 'A' and 'Z' then cast(ascii(c) - 55 as varchar) else c end), 'string_agg', '') as uhugeint) % 97 as varchar) || list_aggregate(list_transform(string_split(substr(substr({_SQL_IBAN_TEXT}, 5) || substr({_SQL_IBAN_TEXT}, 1, 4), 17), ''), lambda c:
  case when c between 'A' and 'Z' then cast(ascii(c) - 55 as varchar) else c end), 'string_agg', ''))::uhugeint % 97 = 1"""

#: In order of their listing. Java's patterns are possessive and start at the head of a run, so that long texts take
#: linear time; they match what the plain ones in sql_pattern do.
KINDS = [
    Kind("email", rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[{_LABEL}]++(?:\.[{_LABEL}]++)++", _EMAIL, context=context("mail", "email", "contact", "write to", "reach"), gate=("@",)),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _IP, lambda m: m.rlike(_BYTES), f"regexp_matches({{m}}, '{_BYTES}')", context("ip", "address", "addr", "host", "server", "login from"), gate=(".",)),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9]([\x20-]?[0-9])+", card_ok, _SQL_CARD, context("card", "visa", "mastercard", "amex", "credit", "debit", "payment")),
    Kind("phone", _PHONE, _PHONE, lambda m: F.length(digits(m)).between(10, 15), f"length({_SQL_DIGITS}) between 10 and 15", context("phone", "telephone", "tel", "mobile", "call", "fax", "cell"), gate=("+",)),
    Kind("iban", "(?=[A-Z][A-Z][0-9][0-9])" + _IBAN, _IBAN, iban_ok, _SQL_IBAN, context("iban", "account", "bank", "konto")),
    Kind("ssn", _SSN, _SSN, context=context("ssn", "social security", "social sec"), gate=("-",)),
]
NAMES = [k.name for k in KINDS]
BASE = 4
#: Score of a kind by itself, and what a context word in the 40 code points before or after it adds. Base kinds are always
#: reported; the others from LEAST on, so an iban needs its checksum alone and an ssn a context word.
SCORES, NEARBY, LEAST = [0.8, 0.5, 0.7, 0.6, 0.7, 0.2], 0.3, 0.5


def _score(column: str = "kind") -> Column:
    of = F.element_at(F.array(*[F.lit(x) for x in SCORES]), F.col(column) + 1)
    return F.least(F.lit(1.0), F.round(of + F.when(F.col("near"), NEARBY).otherwise(0.0), 2))


def find_pii(df: DataFrame, text: str = "text", id: str = "doc_id", least: float = LEAST) -> DataFrame:
    """(__row, id, spans): for each row an array of (start, kind, end, score), kind being a number in KINDS.

    Expressions propose spans; Luhn's check confirms cards, mod-97 confirms ibans, ranges confirm addresses and phone
    numbers; a context word shortly before a span or after it, as a whole word, raises its score. Spans of the base kinds (email, ip, card, phone)
    are reported once confirmed, those of the others from a score of least on. Built-in functions only.

    Null texts are empty; rows without spans have an empty array; repeated rows each get one. An empty table gives an
    empty result. Other columns are ignored, whatever their names. df is a stored table, read alike each time: rows are told
    apart by their place in it.
    """
    found = places(proposals(rows(df, id=id, text=text), KINDS)).withColumn("score", _score())
    told = F.when(F.col("ok") & ((F.col("kind") < BASE) | (F.col("score") >= least)), F.struct("start", "kind", "end", "score"))
    return found.groupBy(ROW, "id").agg(F.sort_array(F.collect_list(told)).alias("spans"))


def redact(df: DataFrame, text: str = "text", id: str = "doc_id", least: float = LEAST) -> DataFrame:
    """df, a stored table, with every span in its texts replaced by its kind in brackets, as [EMAIL]; overlapping spans go as one.

    Texts without a span stay as they are, nulls too; all rows and columns are kept. Texts that hold no match at all
    aren't shuffled. Repeated rows are changed alike; an empty table gives an empty result.
    """
    kept = numbered(df)
    t = f"c{df.columns.index(text)}"
    spans = cut(find_pii(df, text, id, least).where(F.size("spans") > 0).select(F.col(ROW).alias("of"), "spans"))
    may = F.lit(False)
    for k in KINDS:
        may = may | (gated(k, F.col(t)) & F.col(t).rlike(k.pattern))
    may = F.coalesce(may, F.lit(False))
    hit = kept.where(may).hint("merge").join(spans, F.col(ROW) == F.col("of"), "left")
    label = F.array(*[F.lit(f"[{k.upper()}]") for k in NAMES])
    # Spans come in order of start: one that starts before all earlier ones have ended belongs to the group before it.
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        text_ = F.substr(F.col(t), (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int"))
        fresh = F.struct(x["end"].alias("at"), F.concat(a["out"], text_, F.element_at(label, x["kind"] + 1)).alias("out"))
        return F.when(x["start"] >= a["at"], fresh).otherwise(F.struct(F.greatest(a["at"], x["end"]).alias("at"), a["out"].alias("out")))

    done = F.aggregate("spans", start, step, lambda a: F.concat(a["out"], F.substr(F.col(t), (a["at"] + 1).cast("int"))))
    new = F.when(F.col("spans").isNull(), F.col(t)).otherwise(done)
    return renamed(kept.where(~may), df).union(renamed(hit, df, **{text: new}))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    out = find_pii(documents(spark, sf_dir))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{NAMES[k]}")
    base = F.filter("spans", lambda x: x["kind"] < BASE)
    top = F.coalesce(F.array_max(F.transform("spans", lambda x: x["score"])), F.lit(0.0))
    return out.select(F.col("id").alias("doc_id"), *map(count, range(BASE)), F.sha2(joined(base, NAMES), 256).alias("base_sha256"), joined(F.col("spans"), NAMES).alias("spans"), top.alias("top_score"))


_ONE = f"""{names_sql(NAMES)} || ':' || start || ':' || "end" """
_SCORE = f"least(1.0, round(case kind {' '.join(f'when {i} then {x}' for i, x in enumerate(SCORES))} end + case when near then {NEARBY} else 0 end, 2))::double"
SQL = f"""with {places_sql(KINDS)},
told as (select *, {_SCORE} as score from spans where ok and (kind < {BASE} or {_SCORE} >= {LEAST})),
each as (select r, {", ".join(f"count(*) filter (where kind = {i}) as n_{NAMES[i]}" for i in range(BASE))}, string_agg({_ONE}, ',' order by start, kind) filter (where kind < {BASE}) as base, string_agg({_ONE}, ',' order by start, kind) as spans, max(score) as top_score from told group by r)
select id as doc_id, {", ".join(f"coalesce(n_{NAMES[i]}, 0) as n_{NAMES[i]}" for i in range(BASE))}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(top_score, 0.0)::double as top_score from docs left join each using (r)"""
