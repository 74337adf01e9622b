"""Best-fit packing of documents into sequences under conflict constraints.

A document longer than a bin is cut into full pieces and a rest. Pieces are dealt into shards of bounded size by a
hash; each shard is packed by itself. Within a shard pieces come in falling size and go to the open bin with the least residual that
holds them and carries neither their duplicate cluster nor, ``source_cap`` times, their source. Bins are
kept by residual; a bitmap over residuals gives the successor of a size, and the search goes on from
successor to successor until a compatible bin is found. A bin carries one bitmap of clusters and
``source_cap`` bitmaps of sources (plane j has the bit of a source of which it holds more than j pieces).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY, SHARD_ROWS, SOURCE_CAP = 2048, 8192, 6
SCHEMA = "doc_id long, piece long, shard long, bin long, start long, n_tokens long, residual long"


def pack(items: list[tuple[int, int, int]], capacity: int, source_cap: int) -> list[tuple[int, int]]:
    """(bin, start) of each (size, cluster, source); sizes from 1 to the capacity, clusters and sources as small integers."""
    by_residual: list[list[int]] = [[] for _ in range(capacity + 1)]
    present = 0  # bit r: some bin has residual r
    clusters: list[int] = []
    planes: list[list[int]] = []
    residual: list[int] = []
    placed: list[tuple[int, int]] = [(0, 0)] * len(items)
    for k in sorted(range(len(items)), key=lambda i: -items[i][0]):
        size, cluster, source = items[k]
        cbit, sbit, found = 1 << cluster, 1 << source, -1
        above = present >> size
        r = size
        while above:
            r += (above & -above).bit_length() - 1  # successor
            for b in by_residual[r]:
                if not clusters[b] & cbit and not planes[b][-1] & sbit:
                    found = b
                    break
            if found >= 0:
                break
            r += 1
            above = present >> r
        if found < 0:
            found = len(residual)
            residual.append(capacity)
            clusters.append(0)
            planes.append([0] * source_cap)
        else:
            by_residual[r].remove(found)
            if not by_residual[r]:
                present &= ~(1 << r)
        placed[k] = (found, capacity - residual[found])
        residual[found] -= size
        clusters[found] |= cbit
        carry = sbit
        for j in range(source_cap):
            planes[found][j], carry = planes[found][j] | carry, planes[found][j] & carry
        if left := residual[found]:
            by_residual[left].append(found)
            present |= 1 << left
    return placed


def _packer(capacity: int, source_cap: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", "doc_id", "piece", "cluster"], ascending=[False, True, True, True], kind="stable", na_position="last").reset_index(drop=True)
        cluster, source = pd.factorize(rows["cluster"])[0], pd.factorize(rows["source"], use_na_sentinel=False)[0]
        placed = pack(list(zip(rows["n_tokens"].tolist(), cluster.tolist(), source.tolist())), capacity, source_cap)
        out = rows[["doc_id", "piece", "shard", "n_tokens"]].copy()
        out["bin"], out["start"] = [b for b, _ in placed], [s for _, s in placed]
        out["residual"] = capacity - out.groupby("bin")["n_tokens"].transform("sum")
        return out[["doc_id", "piece", "shard", "bin", "start", "n_tokens", "residual"]]

    return run


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", clusters: DataFrame | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, cluster): words plus one end mark; cluster is a hash of the lower-cased text.

    clusters: (doc_id, component_id) of near duplicates, as near_dup.near_duplicates gives them, take the place of that hash
    for the ids that they name. Null and empty texts have the end mark alone.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.size(F.split(F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), r"[\x20\x09-\x0D]+"))
    n = F.when(text.rlike(r"[^\x20\x09-\x0D]"), words).otherwise(0) + 1
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), n.cast("long").alias("n_tokens"), F.xxhash64(F.lower(text)).alias("cluster"))
    if clusters is None:
        return out
    of = clusters.select("doc_id", F.xxhash64(F.lit("component"), "component_id").alias("_c")).where("doc_id is not null").distinct()
    return out.join(of, "doc_id", "left").select("doc_id", "source", "n_tokens", F.coalesce("_c", "cluster").alias("cluster"))


def best_fit(rows: DataFrame, capacity: int = CAPACITY, source_cap: int = SOURCE_CAP, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Packs rows of (doc_id, source, n_tokens, cluster); returns one row per piece, each with its shard and bin.

    A document longer than the capacity is cut into full pieces, which fill a bin each, and a rest that is packed
    like any other. Rows of no tokens take no room: they get one piece, bin null. Null
    sources are one source; a null cluster is a cluster of its own hash; null ids are allowed; repeated
    rows share a cluster and so never a bin. Shards hold about ``shard_rows`` pieces, so a task's memory
    and its search are bounded; a hot source or cluster, and rows that repeat one id and text, are spread over all shards.
    Ties in size go by id, piece and cluster. An empty table gives no rows.
    """
    from tessera.plans.scratch import materialise

    rows = rows.select("doc_id", "source", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"), F.coalesce("cluster", F.xxhash64("doc_id", "n_tokens", "source")).alias("cluster"))
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "sized")
    pieces = F.ceil(F.col("n_tokens") / capacity)
    total = rows.agg(F.coalesce(F.sum(F.greatest(pieces, F.lit(1))), F.lit(0))).first()[0]
    none = rows.where("n_tokens <= 0").select("doc_id", F.lit(0).cast("long").alias("piece"), *[F.lit(None).cast("long").alias(c) for c in ("shard", "bin", "start")], F.lit(0).cast("long").alias("n_tokens"), F.lit(None).cast("long").alias("residual"))
    parts = rows.where("n_tokens > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), pieces.cast("long") - 1)).alias("piece"))
    shard = F.pmod(F.xxhash64("row", "doc_id", "piece"), F.lit(max(1, -(-total // shard_rows)))).alias("shard")
    size = F.least(F.lit(capacity).cast("long"), F.col("n_tokens") - F.col("piece") * capacity)
    parts = parts.select("doc_id", "piece", "source", size.alias("n_tokens"), "cluster", shard)
    return parts.groupBy("shard").applyInPandas(_packer(capacity, source_cap), SCHEMA).unionByName(none)


def query(spark, sf_dir: str) -> DataFrame:
    return best_fit(sized(spark.read.parquet(f"{sf_dir}/documents.parquet")))
