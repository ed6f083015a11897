"""Quality rules for documents: lines are judged and cleaned first, then what is left of the document."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.common import ROW, by_batches, documents, numbered, renamed, rows

_SYMBOLS = re.compile(rb"[#*$%&|<>]")
_MARKS = re.compile(rb"[^\w\s\x80-\xff]")
#: Phrases of pages' furniture, in lower case; a short line that holds one fails.
_PHRASES = (
    r"cookie policy|privacy policy|terms of (?:use|service)|all rights reserved|enable javascript|javascript is disabled|lorem ipsum|"
    r"click here|read more\b|sign up for|subscribe to|share (?:this|on)|follow us|powered by|back to top|skip to (?:main )?content|"
    r"add to cart|log ?in to|404 not found"
)
BOILERPLATE = re.compile(_PHRASES.encode())
#: What separates the entries of a menu or a trail of crumbs.
_BARS = re.compile("[|>]|»|›|•|·".encode())
_ENDS = tuple(x.encode() for x in (".", "!", "?", ":", ";", '"', "'", ")", "…", "”", "»", "。", "！", "？"))


@dataclass(frozen=True)
class Rules:
    """Limits of the rules. A line or document at a limit passes."""

    min_words: int = 50
    #: Of a document's words, in windows of three words that occur twice or more.
    max_repeated: float = 0.5
    #: A line fails above so many marks and symbols per word, if it has so many words at least.
    max_marks_per_word: float = 1.0
    marks_from_words: int = 5
    #: A line with so many bars, and no more than so many words to a bar, is navigation.
    min_bars: int = 2
    words_per_bar: int = 4
    #: Boilerplate phrases count in lines of so many words at most.
    boilerplate_words: int = 30
    #: A document goes if its failed lines hold more than this share of its bytes in words.
    max_lost: float = 0.5
    #: A document goes if above this share of its lines with words end in no punctuation, and it has so many such lines.
    max_unended: float = 0.95
    unended_from_lines: int = 20
    #: A document goes if above this share of its lines with words repeat earlier lines.
    max_dup_lines: float = 0.6
    dup_from_lines: int = 10


DEFAULT = Rules()


def line_fails(line: bytes, words: list[bytes], rules: Rules = DEFAULT) -> str | None:
    """The first rule that a line with words breaks: navigation, boilerplate, punctuation; or None."""
    n = len(words)
    bars = len(_BARS.findall(line))
    if bars >= rules.min_bars and n - bars <= rules.words_per_bar * (bars + 1):
        return "navigation"
    if n <= rules.boilerplate_words and BOILERPLATE.search(line.lower()):
        return "boilerplate"
    if n >= rules.marks_from_words and len(_MARKS.findall(line)) > rules.max_marks_per_word * n:
        return "punctuation"
    return None


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three words that occur twice or more, the first occurrence included."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    count, upto, total = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if count[w] > 1:
            total += i + 3 - max(i, upto)
            upto = i + 3
    return total


def judge(text: bytes | None, rules: Rules = DEFAULT) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, reason, n_lines_cut, cleaned).

    cleaned is the text without failed lines, the text itself if there are none.
    """
    text = text or b""
    words = text.split()
    n = len(words)
    # Code points are the bytes that don't continue one.
    chars = sum(map(len, words))
    if not text.isascii():
        chars = len(b"".join(words).decode("utf-8", "replace"))
    symbols = len(_SYMBOLS.findall(text))
    seen: set[bytes] = set()
    dup, with_words, unended, lost, failed, kept_lines = 0, 0, 0, 0, 0, []
    for line in text.split(b"\n"):
        own = line.split()
        if not own:
            kept_lines.append(line)
            continue
        with_words += 1
        if line in seen:
            dup += 1
        else:
            seen.add(line)
        if line_fails(line, own, rules):
            failed += 1
            lost += sum(map(len, own))
        else:
            kept_lines.append(line)
            unended += not own[-1].endswith(_ENDS)
    repeat = repeated_words(words)
    base_failed = n < rules.min_words or repeat > rules.max_repeated * n
    reason = None
    if n < rules.min_words:
        reason = "short"
    elif base_failed:
        reason = "repeats"
    elif lost > rules.max_lost * sum(map(len, words)):
        reason = "lines"
    elif with_words >= rules.dup_from_lines and dup > rules.max_dup_lines * with_words:
        reason = "duplicate lines"
    elif with_words - failed >= rules.unended_from_lines and unended > rules.max_unended * (with_words - failed):
        reason = "punctuation"
    cleaned = b"\n".join(kept_lines) if failed else text
    return n, chars, symbols, dup, repeat, base_failed, reason is None, reason, failed, cleaned


_COLUMNS = {"n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(), "base_failed": pa.bool_(), "kept": pa.bool_(), "reason": pa.string(), "n_lines_cut": pa.int64(), "cleaned": pa.string()}
_DDL = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, reason string, n_lines_cut long, cleaned string"


def apply_rules(df: DataFrame, text: str = "text", id: str = "doc_id", rules: Rules = DEFAULT, cleaned: bool = True) -> DataFrame:
    """(__row, id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, reason, n_lines_cut, cleaned).

    Line-first cleaning: rules on navigation, boilerplate and punctuation judge each line, failed lines are cut, and
    a document is rejected (kept is false, reason says why) if it breaks a base rule, if its failed lines held too
    much of its text, or if what is left is mostly repeated or unended lines. cleaned is the text without failed
    lines; with cleaned=False it is left out. A text is judged alone, so nothing is shuffled.

    A null text has no words and is rejected as short. Repeated rows each get a row. An empty table gives an empty
    result. Other columns are ignored, whatever their names.
    """
    names = [c for c in _COLUMNS if cleaned or c != "cleaned"]
    ddl = _DDL if cleaned else _DDL.removesuffix(", cleaned string")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [judge(t, rules) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            columns = list(zip(*made, strict=True)) or [()] * len(_COLUMNS)
            arrays = []
            for name, values in zip(_COLUMNS, columns, strict=True):
                if name == "cleaned":
                    if cleaned:
                        arrays.append(pa.array(values, pa.binary()).cast(pa.string()))
                else:
                    arrays.append(pa.array(values, _COLUMNS[name]))
            yield pa.record_batch([batch.column(0), batch.column(1), *arrays], names=[ROW, "id", *names])

    of = rows(df, id=id, text=text).withColumn("text", F.col("text").cast("string"))
    return by_batches(of, work, f"{ROW} long, id {df.schema[id].dataType.simpleString()}, {ddl}")


def clean(df: DataFrame, text: str = "text", rules: Rules = DEFAULT) -> DataFrame:
    """The rows of df that the rules keep, with all their columns, and their texts without the lines that failed.

    Null, empty and short texts are rejected; long ones are judged whole. Repeated rows are judged alike, each for
    itself. An empty table gives an empty result; columns of any name stay as they are.
    """
    at = df.columns.index(text)
    named = numbered(df).drop(ROW).withColumn(f"c{at}", F.col(f"c{at}").cast("string"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [judge(t, rules) for t in batch.column(at).cast(pa.binary()).to_pylist()]
            new = pa.array([m[-1] for m in made], pa.binary()).cast(batch.schema.field(at).type)
            changed = pa.record_batch([new if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)
            yield changed.filter(pa.array([m[6] for m in made], pa.bool_()))

    return renamed(by_batches(named, work, named.schema), df)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality figures and verdict of every document."""
    out = apply_rules(documents(spark, sf_dir), cleaned=False)
    return out.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "reason", "n_lines_cut")


_W = r"[^\x20\x09-\x0D]+"
_END = "(" + "|".join("[" + x.decode() + "]" if x != b"'" else "['']" for x in _ENDS) + r")[\x20\x09-\x0D]*$"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The default rules in DuckDB's SQL.
SQL = rf"""with docs as (select row_number() over () as r, doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{_W}') as w from documents),
windows as (select r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select r, w, unnest(range(1, len(w) - 1)) as i from docs)),
again as (select r, i from (select r, i, count(*) over (partition by r, g) as c from windows) where c > 1),
repeats as (select r, count(distinct i + k) as n_repeat from again, (select unnest([0, 1, 2]) as k) group by r),
lines as (select r, ln, line, regexp_extract_all(line, '{_W}') as own from (select r, unnest(ls) as line, unnest(range(len(ls))) as ln from (select r, string_split(t, chr(10)) as ls from docs)) where regexp_matches(line, '{_W}')),
judged as (select r, row_number() over (partition by r, line order by ln) > 1 as dup, length(array_to_string(own, '')) as chars, strlen(array_to_string(own, '')) as bytes, regexp_matches(line, '{_END}') as ended,
    (bars >= {DEFAULT.min_bars} and n - bars <= {DEFAULT.words_per_bar} * (bars + 1)) or (n <= {DEFAULT.boilerplate_words} and regexp_matches(translate(line, '{_UPPER}', '{_LOWER}'), '{_PHRASES}')) or (n >= {DEFAULT.marks_from_words} and marks > {DEFAULT.max_marks_per_word} * n) as fails
  from (select *, len(own) as n, len(regexp_extract_all(line, '[|>]|»|›|•|·')) as bars, len(regexp_extract_all(line, '[^0-9A-Za-z_\x09-\x0D\x20\x{{80}}-\x{{10FFFF}}]')) as marks from lines)),
by_line as (select r, count(*) as n_lines, count(*) filter (where dup) as n_dup, count(*) filter (where fails) as n_fail, sum(case when fails then bytes else 0 end) as lost, sum(bytes) as bytes, count(*) filter (where not fails and not ended) as unended, sum(chars) as chars from judged group by r),
figures as (select doc_id, len(w)::bigint as n_words, coalesce(chars, 0)::bigint as word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols, coalesce(n_dup, 0)::bigint as n_dup_lines, coalesce(n_repeat, 0)::bigint as n_repeat_words, coalesce(n_fail, 0)::bigint as n_lines_cut, coalesce(n_lines, 0) as n_lines, coalesce(lost, 0) as lost, coalesce(bytes, 0) as bytes, coalesce(unended, 0) as unended
  from docs left join repeats using (r) left join by_line using (r)),
verdicts as (select *, case when n_words < {DEFAULT.min_words} then 'short' when n_repeat_words > {DEFAULT.max_repeated} * n_words then 'repeats' when lost > {DEFAULT.max_lost} * bytes then 'lines'
    when n_lines >= {DEFAULT.dup_from_lines} and n_dup_lines > {DEFAULT.max_dup_lines} * n_lines then 'duplicate lines' when n_lines - n_lines_cut >= {DEFAULT.unended_from_lines} and unended > {DEFAULT.max_unended} * (n_lines - n_lines_cut) then 'punctuation' end as reason from figures)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, reason is null as kept, reason, n_lines_cut from verdicts"""
