"""Near duplicates by MinHash with tensored banding, confirmed on full shingle sets.

Two small collections of sub-keys are computed per text, each sub-key from ``ROWS`` minhashes. A table
key is a pair, one sub-key of either collection, so ``SIDE * SIDE`` tables need only ``2 * SIDE * ROWS``
minhash functions instead of ``SIDE * SIDE * 2 * ROWS``. Texts of the threshold's similarity share no
table with probability about 2 * (1 - 0.75 ** ROWS) ** SIDE, 0.0005 at the defaults, and less above it.

Texts with equal sets are one class from the start. In each table a bucket is first compared with its
smallest id only (a star). In buckets that this leaves in more than one component, members whose count of
shingles found in no other document proves that they reach the threshold with nothing are done; the others are
compared with the member that has the fewest such shingles (a second star). What is still in different
components is compared in blocks: members outside the largest component of a bucket with the members of all buckets of
that component, by products of incidence matrices that return links alone. Thus a large group of copies costs its size times the number of
tables, and no link between different components is skipped. Pairs must agree in size and in
``MIN_AGREE`` of the 40 minhashes (a pair at the threshold fails that with a probability of about 1e-8)
before their sets are fetched and compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.components import connected_components
from tessera.plans.scratch import materialise

SHINGLE, PER_CENT = 5, 75
SIDE, ROWS, MIN_AGREE = 10, 2, 13
#: Ids that may be broadcast to pick out the texts of candidates (8 bytes each); beyond it a shuffle join does it.
BROADCAST_IDS = 2_000_000
_MULT = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 16
#: Members and bytes of a block, and shingles of a product, in the last comparison.
BLOCK, BLOCK_BYTES, COLUMNS = 256, 8 << 20, 8192


def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(75)
    n = 2 * SIDE * ROWS
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


def shingles(text: str | None, known: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles; of the whole sequence for fewer words; empty without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    if n < SHINGLE:
        out = np.uint64(n)
        with np.errstate(over="ignore"):
            for x in h:
                out = out * _MULT + x
            return _mix(np.array([out], np.uint64) ^ np.uint64(0x5DEECE66D))
    out = h[: n - SHINGLE + 1].copy()
    for k in range(1, SHINGLE):
        out *= _MULT
        out += h[k : n - SHINGLE + 1 + k]
    return np.unique(_mix(out))


def signature(s: np.ndarray, fns: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The sub-keys as longs: each holds the upper halves of ROWS = 2 minhashes."""
    a, b = fns
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(s), _CHUNK):
        np.minimum(low, (s[None, k : k + _CHUNK] * a[:, None] + b[:, None]).min(axis=1), out=low)
    top = low >> np.uint64(32)
    return ((top[0::2] << np.uint64(32)) | top[1::2]).view(np.int64)


def _sign(batches):
    fns = _functions()
    for batch in batches:
        known, ids, n, h1, h2, sigs = _Hashes(), [], [], [], [], []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            s = shingles(text.as_py(), known)
            ids.append(i)
            n.append(len(s))
            d = xxhash.xxh3_128_intdigest(s.tobytes())
            h1.append((d >> 64) - (1 << 63))
            h2.append((d & ((1 << 64) - 1)) - (1 << 63))
            sigs.append(signature(s, fns) if len(s) else np.empty(0, np.int64))
        sig = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in sigs])]), pa.int32()), pa.array(np.concatenate([*sigs, np.empty(0, np.int64)]), pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), sig], ["id", "n", "h1", "h2", "sig"])


def _sets(batches):
    for batch in batches:
        known, ids, out = _Hashes(), [], []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            s = shingles(text.as_py(), known)
            if len(s):
                ids.append(i)
                out.append(s.astype("<u8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["id", "s"])


def _shingle_rows(batches):
    for batch in batches:
        for i, raw in zip(batch.column("id").to_pylist(), batch.column("s")):
            own = _decode(raw.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), i, np.int64)), pa.array(own.astype(np.uint64).view(np.int64))], ["id", "x"])


def _decode(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u8")


def _confirm(batches):
    for batch in batches:
        a, b = [], []
        last: tuple[bytes, np.ndarray] = (b"", np.empty(0, np.uint64))
        for i, j, x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("sa"), batch.column("sb")):
            y = y.as_py()
            if y != last[0]:
                last = (y, _decode(y))
            left, right = _decode(x.as_py()), last[1]
            at = np.searchsorted(right, left)
            at[at == len(right)] = 0
            same = int((right[at] == left).sum())
            if 100 * same >= PER_CENT * (len(left) + len(right) - same):
                a.append(i)
                b.append(j)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["src", "dst"])


def _agree(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and minhashes leave the threshold possible."""
    side = lambda c: reps.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("sig").alias(f"s{c}"))
    low = F.lit(0xFFFFFFFF).cast("long")
    eq = lambda x, y: (F.shiftrightunsigned(x.bitwiseXOR(y), 32) == 0).cast("int") + (x.bitwiseXOR(y).bitwiseAND(low) == 0).cast("int")
    same = F.aggregate(F.zip_with("sa", "sb", eq), F.lit(0), lambda x, y: x + y)
    wide = pairs.join(side("a"), "a").join(side("b"), "b")
    return wide.where((100 * F.least("na", "nb") >= PER_CENT * F.greatest("na", "nb")) & (same >= MIN_AGREE)).select("a", "b").distinct()


def _sets_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, s): the shingle sets of the documents with these ids, read from their texts again."""
    ids = materialise(ids.distinct(), "ids")
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    texts = docs.join(F.broadcast(ids) if few else ids, "id", "left_semi")
    return materialise(texts.mapInArrow(_sets, "id long, s binary"), "sets")


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that reach the threshold on their full sets, as (src, dst)."""
    wide = pairs.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b").join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
    return materialise(wide.select("a", "b", "sa", "sb").mapInArrow(_confirm, "src long, dst long"), "links")


def _able(members: DataFrame, reps: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows (key, id, ...) of buckets whose document can reach the threshold with any other one of its bucket, with n.

    A shingle that no other document of any bucket has is in no intersection. With u such ones of n, and at
    least m shingles in every document of the bucket, the similarity is at most (n - u) / (max(m, n - u) + u).
    """
    alone = sets.mapInArrow(_shingle_rows, "id long, x long").groupBy("x").agg(F.min("id").alias("id"), F.count("*").alias("k")).where("k = 1").groupBy("id").agg(F.count("*").alias("u"))
    size = materialise(reps.groupBy("id").agg(F.max("n").alias("n"), F.min("n").alias("low")).join(alone, "id", "left").select("id", "n", "low", F.coalesce("u", F.lit(0)).alias("u")), "size")
    members = materialise(members.join(size, "id"), "sized")
    least = materialise(members.groupBy("key").agg(F.min("low").alias("m")), "least")
    shared = F.col("n") - F.col("u")
    return materialise(members.join(least, "key").where(100 * shared >= PER_CENT * (F.greatest("m", shared) + F.col("u"))), "able")


def _cross(batches):
    """(src, dst): the links between two blocks of members {id, c, s}, of different components c."""
    for batch in batches:
        src, dst = [], []
        for x, y in zip(batch.column("x"), batch.column("y")):
            x, y = x.as_py(), y.as_py()
            left, right = ([_decode(r["s"]) for r in rows] for rows in (x, y))
            nx, ny = (np.array([len(r) for r in rows]) for rows in (left, right))
            fx, fy = np.concatenate(left), np.concatenate(right)
            both = np.intersect1d(fx, fy)
            same = np.zeros((len(x), len(y)), np.float32)
            ox, oy = np.repeat(np.arange(len(x)), nx), np.repeat(np.arange(len(y)), ny)
            for k in range(0, len(both), COLUMNS):
                part = both[k : k + COLUMNS]
                grid = []
                for flat, owner, n in ((fx, ox, len(x)), (fy, oy, len(y))):
                    at = np.searchsorted(part, flat)
                    at[at == len(part)] = 0
                    hit = part[at] == flat
                    m = np.zeros((n, len(part)), np.float32)
                    m[owner[hit], at[hit]] = 1
                    grid.append(m)
                same += grid[0] @ grid[1].T
            cx, cy = (np.array([r["c"] for r in rows]) for rows in (x, y))
            i, j = np.nonzero((100 * same >= PER_CENT * (nx[:, None] + ny[None, :] - same)) & (cx[:, None] != cy[None, :]))
            src += [x[k]["id"] for k in i]
            dst += [y[k]["id"] for k in j]
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])


def _blocks(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(main, m): the rows (main, id, c) of each main component with their sets, in blocks of about BLOCK members, or fewer where their sets are long."""
    rows = materialise(rows.join(sets, "id"), "with_sets")
    count = rows.groupBy("main").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(F.octet_length("s")) / BLOCK_BYTES)).alias("blocks"))
    rows = rows.join(materialise(count, "count"), "main").withColumn("b", F.pmod(F.xxhash64("id"), "blocks"))
    return materialise(rows.groupBy("main", "b").agg(F.collect_list(F.struct("id", "c", "s")).alias("m")).select("main", "m"), "packed")


def _cross_links(parts: DataFrame, sets: DataFrame) -> DataFrame:
    """The links between members outside the largest component of their bucket and all other members of such buckets, block by block; only links are returned."""
    odd = _blocks(materialise(parts.where("c <> main").select("main", "id", "c").distinct(), "odd"), sets)
    rest = _blocks(materialise(parts.select("main", "id", "c").distinct(), "rest"), sets)
    met = odd.withColumnRenamed("m", "x").join(rest.withColumnRenamed("m", "y"), "main").select("x", "y")
    return materialise(met.mapInArrow(_cross, "src long, dst long"), "links")


def _in_parts(members: DataFrame, found: DataFrame) -> DataFrame:
    """The rows (key, id, ...) of buckets that lie in more than one component, with the member's (c) and the largest one (main)."""
    members = materialise(members.join(found.withColumnRenamed("component", "c"), "id", "left").withColumn("c", F.coalesce("c", "id")), "members")
    main = members.groupBy("key", "c").agg(F.count("*").alias("k")).groupBy("key").agg(F.max(F.struct("k", "c")).alias("m"), F.count("*").alias("parts"))
    main = materialise(main.where("parts > 1").select("key", F.col("m.c").alias("main")), "main")
    return members.join(main, "key")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per input row.

    Null, empty and wordless texts have an empty set and are linked with nothing. Rows without an id are
    linked with nothing either: component null, kept true. Rows that repeat an id are one document with
    several texts. Only the two named columns are read. An empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = materialise(docs.mapInArrow(_sign, "id long, n long, h1 long, h2 long, sig array<long>"), "signed")
    firsts = materialise(signed.where("n > 0 and id is not null").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "firsts")
    copies = signed.select("id", "h1", "h2").join(firsts.where("copies > 1"), ["h1", "h2"]).where("id <> rep").select(F.col("rep").alias("src"), F.col("id").alias("dst"))
    copies = materialise(copies, "copies")
    reps = signed.where("n > 0 and id is not null").join(firsts.select("h1", "h2", F.col("rep").alias("id")), ["h1", "h2", "id"], "left_semi").select("id", "n", "sig")
    reps = materialise(reps, "reps")

    sub = reps.select("id", F.slice("sig", 1, SIDE).alias("x"), F.slice("sig", SIDE + 1, SIDE).alias("y"))
    keys = sub.select("id", "y", F.posexplode("x").alias("i", "u")).select("id", "i", "u", F.posexplode("y").alias("j", "v"))
    keys = keys.select("id", F.xxhash64("i", "u", "j", "v").alias("key"))
    pivots = materialise(keys.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("top")).where("pivot < top").select("key", "pivot"), "pivots")
    shared = materialise(keys.join(pivots, "key"), "shared")

    stars = shared.where("id > pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()
    stars = materialise(_agree(stars, reps), "stars")
    links = _linked(stars, _sets_of(stars.select(F.col("a").alias("id")).unionAll(stars.select("b")), docs))
    found = materialise(connected_components(links), "found")

    # buckets still in more than one component
    here = materialise(_in_parts(shared, found), "here")
    sets = _sets_of(here.select("id"), docs)
    able = _able(here.select("key", "id", "pivot"), reps, sets)
    # a second star, around the member with the fewest shingles of its own
    centre = able.groupBy("key").agg(F.min(F.struct("u", "id")).alias("m")).select("key", F.col("m.id").alias("centre"))
    around = _in_parts(able, found).join(materialise(centre, "centre"), "key").where("id <> centre and centre <> pivot")
    around = materialise(_agree(around.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct(), reps), "around")
    links = materialise(links.unionAll(_linked(around, sets)), "links")
    found = materialise(connected_components(links), "found")
    more = _cross_links(materialise(_in_parts(able, found), "parts"), sets)

    groups = materialise(connected_components(links.unionAll(more).unionAll(copies)), "groups")
    known = signed.where("id is not null").select("id", "n").join(groups, "id", "left").select("id", "n", F.coalesce("component", "id").alias("c"))
    out = known.unionAll(signed.where("id is null").select("id", "n", F.lit(None).cast("long")))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("c").alias("component_id"), F.coalesce(F.col("id") == F.col("c"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, and those without an id, all columns unchanged.

    Null, empty and wordless texts are components of their own and stay. Of equal texts the one with the smallest id stays; rows
    that repeat a kept id all stay. An empty table stays empty.
    """
    gone = near_duplicates(docs, id_col, text_col).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    gone = materialise(gone, "gone")
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, docs[id_col].cast("long") == F.col("__gone"), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
