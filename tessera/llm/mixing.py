"""Mixing of sources to target weights by hierarchical budgeting, in DataFrame operations only.

Token budgets go down the tree domain - language - source by water-filling: a child gets its
share by weight, at most its capacity (tokens times ``max_epochs``); what it lacks goes to its siblings
first, and, as a node's capacity is the sum of its children's, to the siblings of an ancestor only when
all of them are full. A leaf's budget is spent on whole passes over its rows and then on a prefix of the
next pass; every pass has its own seeded order. All budgets are integers, so each engine agrees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.plans.scratch import materialise

KEYS = ["domain", "lang", "source"]
SEED, MAX_EPOCHS, SHARE_PER_CENT = 17, 2, 80
#: Relative weights of children; a child that isn't named has weight 1.
WEIGHTS = {
    "domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1},
    "lang": {"en": 5, "de": 2, "fr": 2, "es": 1},
    "source": {},
}
#: Hex digits of the order key that make a bucket: 16 ** BUCKET_DIGITS buckets a leaf and pass.
BUCKET_DIGITS = 3


def domain_of(source: Column) -> Column:
    """The domain of a source: the number in its name modulo 4; d0 without one."""
    digits = F.right(F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]+)", 1), F.lit(9))
    return F.concat(F.lit("d"), (F.coalesce(digits.try_cast("long"), F.lit(0)) % 4).cast("string"))


def _weight(level: str, column: str, weights: dict) -> Column:
    out = F.lit(1)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(column) == name, F.lit(w)).otherwise(out)
    return out.cast("long")


def _share(nodes: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Water-filling of ``given`` among the children of each parent; nodes: parent..., child, cap, w, given."""
    by = W.partitionBy(*parent).orderBy(F.col("cap") / F.col("w"), child)
    all_ = W.partitionBy(*parent)
    before = by.rowsBetween(W.unboundedPreceding, -1)
    nodes = (
        nodes.withColumn("r", F.col("given") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("ws", F.sum("w").over(by.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("full", F.col("cap") * F.col("ws") <= F.col("w") * F.col("r"))
        .withColumn("left", F.col("given") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(all_), F.lit(0)))
        .withColumn("wl", F.sum(F.when(~F.col("full"), F.col("w"))).over(all_))
    )
    got = F.when(F.col("full"), F.col("cap")).otherwise(F.expr("(w * left) div wl"))
    return nodes.withColumn("got", got.cast("long")).drop("r", "ws", "full", "left", "wl")


def budgets(leaves: DataFrame, weights: dict, max_epochs: int, share_per_cent: int) -> DataFrame:
    """(domain, lang, source, tokens, budget) from (domain, lang, source, tokens)."""
    leaf = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    langs = leaf.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"))
    domains = langs.groupBy("domain").agg(F.sum("cap").alias("cap"))
    total = leaves.agg(F.expr(f"(sum(tokens) * {int(share_per_cent)}) div 100").cast("long").alias("given"))
    one = domains.withColumn("w", _weight("domain", "domain", weights)).join(F.broadcast(total)).withColumn("root", F.lit(0))
    one = _share(one, ["root"], "domain").select("domain", F.col("got").alias("given"))
    two = langs.withColumn("w", _weight("lang", "lang", weights)).join(one, "domain")
    two = _share(two, ["domain"], "lang").select("domain", "lang", F.col("got").alias("given"))
    three = leaf.withColumn("w", _weight("source", "source", weights)).join(two, ["domain", "lang"])
    return _share(three, ["domain", "lang"], "source").select("domain", "lang", "source", "tokens", F.col("got").alias("budget"))


def count_tokens(text: Column) -> Column:
    """Words and one end mark."""
    text = F.coalesce(text, F.lit(""))
    words = F.size(F.split(F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), r"[\x20\x09-\x0D]+"))
    return (F.when(text.rlike(r"[^\x20\x09-\x0D]"), words).otherwise(0) + 1).cast("long")


def plan(rows: DataFrame, weights: dict = WEIGHTS, max_epochs: int = MAX_EPOCHS, share_per_cent: int = SHARE_PER_CENT) -> DataFrame:
    """(domain, lang, source, tokens, budget): one row per leaf of rows with these columns and n_tokens."""
    leaves = rows.groupBy(*KEYS).agg(F.sum("n_tokens").alias("tokens"))
    return materialise(budgets(leaves, weights, max_epochs, share_per_cent), "budget")


def _candidates(rows: DataFrame, leaves: DataFrame, max_epochs: int, seed: int) -> DataFrame:
    """Each row once for every pass that its leaf's budget reaches, with its order key, the key's bucket and the pass's room."""
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col("epoch"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("salt", F.lit(""))))
    passes = F.sequence(F.lit(0), F.least(F.lit(max_epochs - 1), F.expr("int(budget div greatest(tokens, 1))")))
    tried = rows.join(F.broadcast(leaves) if _small(leaves) else leaves, KEYS).withColumn("epoch", F.explode(passes))
    room = F.least(F.col("tokens"), F.col("budget") - F.col("epoch") * F.col("tokens"))
    tried = tried.withColumn("room", room).where("room > 0").withColumn("full", F.col("room") == F.col("tokens")).drop("tokens", "budget")
    return tried.withColumn("o", order).withColumn("k", F.substring("o", 1, BUCKET_DIGITS))


def select(rows: DataFrame, weights: dict = WEIGHTS, max_epochs: int = MAX_EPOCHS, share_per_cent: int = SHARE_PER_CENT, seed: int = SEED) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, salt, epoch) of every chosen row of (doc_id, lang, source, n_tokens, salt).

    Null languages and sources are leaves named ''; null ids count as the id ''. Ties in the order
    key (rows repeated with their id) are broken by ``salt`` and size, and rows equal in all stand
    or fall together. A row whose tokens would pass the leaf's budget, and all after it in that pass, are not
    chosen. An empty table gives no rows. The running sum of a leaf is taken over buckets of the order
    key first, by partial aggregation, and then within buckets, so a leaf with most of the rows is spread out.
    """
    rows = rows.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), "n_tokens", "salt")
    rows = materialise(rows.withColumn("domain", domain_of(F.col("source"))), "mix")
    tried = _candidates(rows, plan(rows, weights, max_epochs, share_per_cent), max_epochs, seed)
    # whole passes need no order
    whole, part = tried.where("full"), tried.where("not full")
    sums = part.groupBy(*KEYS, "epoch", "k").agg(F.sum("n_tokens").alias("s"), F.first("room").alias("most"))
    run = W.partitionBy(*KEYS, "epoch").orderBy("k")
    sums = sums.withColumn("upto", F.sum("s").over(run)).withColumn("base", F.col("upto") - F.col("s"))
    sums = materialise(sums.where("base < most").select(*KEYS, "epoch", "k", "base", "upto"), "mix")
    near = part.join(sums, [*KEYS, "epoch", "k"])
    inside = W.partitionBy(*KEYS, "epoch", "k").orderBy("o", "n_tokens").rangeBetween(W.unboundedPreceding, W.currentRow)
    out = ["doc_id", *KEYS, "n_tokens", "salt", "epoch"]
    sure = near.where("upto <= room").select(*out)
    edge = near.where("upto > room").withColumn("cum", F.col("base") + F.sum("n_tokens").over(inside)).where("cum <= room").select(*out)
    return whole.select(*out).unionByName(sure).unionByName(edge)


def choose(docs: DataFrame, **options) -> DataFrame:
    """The chosen rows of documents with all their columns, once for each pass that holds them.

    Rows are matched to their choices by id and a hash of the text; rows equal in both stand for each other, and
    as they are chosen together, each appears as often as it was chosen.
    """
    names = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(*names, F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("__salt"), F.coalesce(F.col("lang"), F.lit("")).alias("__lang"), F.coalesce(F.col("source"), F.lit("")).alias("__source"))
    rows = keyed.select(F.col("__id").alias("doc_id"), F.col("__lang").alias("lang"), F.col("__source").alias("source"), count_tokens(F.col("text")).alias("n_tokens"), F.col("__salt").alias("salt"))
    chosen = select(rows, **options).select(F.col("doc_id").alias("__i"), F.col("salt").alias("__s"), F.col("lang").alias("__l"), F.col("source").alias("__c"), F.col("epoch").alias("__e")).distinct()
    same = (F.col("__id") == F.col("__i")) & (F.col("__salt") == F.col("__s")) & (F.col("__lang") == F.col("__l")) & (F.col("__source") == F.col("__c"))
    return keyed.join(materialise(chosen, "chosen"), same).select(*names)


def _small(plan: DataFrame, most: int = 10_000) -> bool:
    """Whether a table of leaves is within the size that may be broadcast."""
    return plan.limit(most + 1).count() <= most


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return select(docs.select("doc_id", "lang", "source", count_tokens(F.col("text")).alias("n_tokens"), F.lit("").alias("salt"))).drop("salt")


def _sql_weight(level: str, column: str) -> str:
    return "case " + column + "".join(f" when '{k}' then {w}" for k, w in WEIGHTS[level].items()) + " else 1 end" if WEIGHTS[level] else "1"


def _sql_share(name: str, nodes: str, parent: str, child: str) -> str:
    """CTEs that water-fill ``given`` among children; the counterpart of _share."""
    return f"""
{name}_a as (select *, given - coalesce(sum(cap) over (partition by {parent} order by cap / w, {child} rows between unbounded preceding and 1 preceding), 0) as r,
  sum(w) over (partition by {parent} order by cap / w, {child} rows between current row and unbounded following) as ws from {nodes}),
{name}_b as (select *, cap * ws <= w * r as isfull from {name}_a),
{name}_c as (select *, given - coalesce(sum(case when isfull then cap end) over (partition by {parent}), 0) as rest,
  sum(case when not isfull then w end) over (partition by {parent}) as wl from {name}_b),
{name} as (select *, case when isfull then cap else (w * rest) // wl end as got from {name}_c)"""


SQL = f"""
with recursive docs as (
  select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint + 1 as n_tokens,
    'd' || (coalesce(try_cast(right(regexp_extract(coalesce(source, ''), '([0-9]+)', 1), 9) as bigint), 0) %% 4)::varchar as domain from documents),
leaf as (select domain, lang, source, sum(n_tokens)::hugeint as tokens, sum(n_tokens)::hugeint * {MAX_EPOCHS} as cap from docs group by all),
langs as (select domain, lang, sum(cap) as cap, {_sql_weight("lang", "lang")} as w from leaf group by all),
doms as (select 0 as root, domain, sum(cap) as cap, {_sql_weight("domain", "domain")} as w,
  (select (sum(tokens) * {SHARE_PER_CENT}) // 100 from leaf) as given from leaf group by all),
{_sql_share("one", "doms", "root", "domain")},
two_in as (select langs.*, one.got as given from langs join one using (domain)),
{_sql_share("two", "two_in", "domain", "lang")},
three_in as (select leaf.*, {_sql_weight("source", "source")} as w, two.got as given from leaf join two using (domain, lang)),
{_sql_share("three", "three_in", "domain, lang", "source")},
tried as (select d.*, t.tokens, t.got as budget, unnest(range(0, {MAX_EPOCHS})) as epoch from docs d join three t using (domain, lang, source)),
ordered as (select *, budget - epoch * tokens as room, sum(n_tokens) over (partition by domain, lang, source, epoch
  order by md5('{SEED}:' || epoch || ':' || coalesce(doc_id::varchar, '') || ':'), n_tokens range between unbounded preceding and current row) as cum from tried)
select doc_id, domain, lang, source, n_tokens, epoch::integer as epoch from ordered where cum <= room and room > 0
""".replace("%%", "%")
