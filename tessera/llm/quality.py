"""Quality rules as a ledger of failure bits.

``measure`` reads a text once and returns every measurement; ``failed_bits`` turns the
measurements into one long with a bit for each rule; a policy is a named mask over those bits.
Verdicts of any policy version, and the effect of leaving a rule out, come from the stored bits
alone, without the texts.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks")
_SCHEMA = T.StructType([T.StructField(n, T.LongType()) for n in MEASURES])
_NOT_CHARS = bytes(b"\t\n\x0b\x0c\r ") + bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))

#: Rules in the order of their bits. Each is SQL over the measurements; integers only, so every engine agrees.
RULES = (
    ("too_short", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 30 * n_words"),
    ("repeated_lines", "n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines"),
    ("word_length", "word_chars > 20 * n_words or word_chars < 2 * n_words"),
    ("shouting", "100 * n_upper > 60 * n_letters"),
    ("exclaiming", "100 * n_marks > 50 * n_words"),
)
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
#: Policy versions; a version never changes once published.
POLICIES = {
    "base-1": BIT["too_short"] | BIT["repeated_words"],
    "strict-1": sum(BIT.values()),
}
DEFAULT_POLICY = "strict-1"


def measures_of(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, by one pass over its bytes; null counts as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = 0
    if len(words) > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(seen := Counter(windows)) < len(windows):
            upto = 0  # words before this position are counted already
            for k, w in enumerate(windows):
                if seen[w] > 1:
                    repeated += k + 3 - max(k, upto)
                    upto = k + 3
    size = len(raw)
    return (
        len(words),
        len(raw.translate(None, _NOT_CHARS)),
        size - len(raw.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        size - len(raw.translate(None, _UPPER)),
        size - len(raw.translate(None, _LETTERS)),
        raw.count(b"!"),
    )


@F.pandas_udf(_SCHEMA)
def measure(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measures_of(x) for x in text], columns=list(MEASURES), dtype="int64")


def failed_bits(of: str = "") -> Column:
    """The failure bits from measurement columns (or from the fields of the struct ``of``)."""
    total = F.lit(0).cast("long")
    for name, sql in RULES:
        for m in sorted(MEASURES, key=len, reverse=True) if of else ():
            sql = re.sub(rf"\b(?<!\.){m}\b", f"{of}.{m}", sql)
        total = total + F.when(F.expr(sql), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long")
    return total


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, every measurement and ``failed`` (long).

    Null and empty texts measure 0 everywhere and fail ``too_short``. Repeated rows give repeated
    rows; other columns of ``docs`` are not read; an empty table gives an empty ledger.
    """
    measured = docs.select(F.col(id_col).alias("__id"), measure(F.col(text_col)).alias("__m"))
    out = measured.select(F.col("__id").alias(id_col), "__m.*")
    return out.withColumn("failed", failed_bits())


def passes(failed: Column, policy: str = DEFAULT_POLICY) -> Column:
    """Whether a policy version keeps a row with these failure bits."""
    return failed.bitwiseAND(F.lit(POLICIES[policy]).cast("long")) == 0


def ablations(book: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """Per rule of the policy: rows that fail it, and rows that only it rejects.

    The ledger is reduced to counts of distinct bit patterns first, at most 2 to the number of
    rules, whatever the number of rows.
    """
    mask = POLICIES[policy]
    patterns = book.groupBy(F.col("failed").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in BIT.items() if b & mask])
    return (
        patterns.select("bits", "n", F.explode(rules).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
        )
    )


def keep(docs: DataFrame, policy: str = DEFAULT_POLICY, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that a policy keeps, with all their columns unchanged.

    Null and empty texts measure 0 and so fail ``too_short``. Repeated rows are judged alike; an empty table stays empty.
    """
    measured = measure(F.col(text_col))
    names = [f"`{c}`" for c in docs.columns]
    return docs.withColumn("__m", measured).where(passes(failed_bits("__m"), policy)).select(*names)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    book = ledger(docs)
    base = ~passes(F.col("failed"), "base-1")
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), passes(F.col("failed")).alias("kept"), "failed")


SQL = """
with t as (select row_number() over () as k, doc_id, coalesce(text, '') as text from documents),
m as (
  select k, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l
  from t),
g as (select k, i, w[i] as a, w[i + 1] as b, w[i + 2] as c from (select k, w, unnest(range(1, len(w) - 1)) as i from m)),
h as (select k, i from (select k, i, count(*) over (partition by k, a, b, c) as n from g) where n > 1),
r as (select k, count(distinct j) as n from (select k, i + unnest([0, 1, 2]) as j from h) group by k),
v as (
  select doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words, len(l)::bigint as n_lines,
    length(regexp_replace(text, '[^A-Z]', '', 'g'))::bigint as n_upper, length(regexp_replace(text, '[^A-Za-z]', '', 'g'))::bigint as n_letters,
    length(regexp_replace(text, '[^!]', '', 'g'))::bigint as n_marks
  from m left join r using (k)),
f as (select *, (BITS)::bigint as failed from v)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 as base_failed, failed = 0 as kept, failed from f
""".replace("BITS", " + ".join(f"case when {sql} then {BIT[name]} else 0 end" for name, sql in RULES))


def ablation_query(spark, sf_dir: str) -> DataFrame:
    return ablations(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")))


ABLATION_SQL = SQL.rsplit("select doc_id, n_words", 1)[0] + " union all ".join(f"select '{name}' as rule, count(*) filter ((failed & {BIT[name]}) <> 0) as n_failed, count(*) filter (failed = {BIT[name]}) as n_only from f" for name, _ in RULES)
