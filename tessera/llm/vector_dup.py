"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors with a cosine of at least t are at most eps = sqrt(2 - 2t) apart, and no farther in any
orthonormal projection. Distinct vectors are projected on the leading principal axes, put in the order
of their grid cells of width eps (label, length and cells first, then id) and cut into blocks. Two blocks
meet only if their label and length are equal and their boxes in the projected space are within eps. A
meeting recurses: both sequences are halved, each half with its own box, and pairs of intervals
that are provably apart are skipped; what is left is compared in double precision. How much can be skipped is a
matter of the data: the leading axes must hold enough of the variance for boxes to lie eps apart. Where they don't, as with
vectors that are spread evenly over all dimensions, every two blocks of a label meet, and blocks are large so that
what the meetings carry stays small beside the products they save no one from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.components import connected_components
from tessera.plans.scratch import materialise

COSINE, AXES, BLOCK, LEAF = 0.93, 8, 2048, 64
_SLACK = 1e-9


def _moments(dim: int):
    def run(batches):
        n, total, outer = 0, np.zeros(dim), np.zeros((dim, dim))
        for batch in batches:
            if batch.num_rows:
                v = np.stack(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.float64)
                x = _unit(v.tobytes(), *v.shape)
                n, total, outer = n + len(x), total + x.sum(axis=0), outer + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([outer.ravel().tolist()], pa.list_(pa.float64()))], ["n", "s", "o"])

    return run


def axes_of(vectors: DataFrame, dim: int, axes: int = AXES) -> np.ndarray:
    """Leading principal axes (dim x at most axes) of the normalised column v; sums of every partition come to the driver, dim squared numbers each."""
    parts = vectors.mapInArrow(_moments(dim), "n long, s array<double>, o array<double>")
    summed = parts.select("n", F.posexplode(F.concat("s", "o")).alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).orderBy("k").collect()
    if not summed or not summed[0]["n"]:
        return np.eye(dim)[:, :axes]
    n, flat = summed[0]["n"], np.array([r["x"] for r in summed])
    mean, outer = flat[:dim] / n, flat[dim:].reshape(dim, dim) / n
    _, vec = np.linalg.eigh(outer - np.outer(mean, mean))
    return np.ascontiguousarray(vec[:, ::-1][:, :axes])


def _narrow(x: np.ndarray) -> np.ndarray:
    """The vectors in single precision, if that is exact."""
    with np.errstate(over="ignore"):
        y = x.astype(np.float32)
    return y if (y == x).all() else x


def _unit(raw: bytes, n: int, dim: int) -> np.ndarray:
    """(n, dim) unit vectors in double precision from vectors in single or double."""
    x = np.frombuffer(raw, np.float32 if len(raw) == 4 * n * dim else np.float64).reshape(n, dim).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no square of it overflows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cells(axes: np.ndarray, eps: float):
    def run(batches):
        for batch in batches:
            v = np.stack(batch.column("v").to_numpy(zero_copy_only=False)).astype(np.float64) if batch.num_rows else np.zeros((0, len(axes)))
            x = _unit(v.tobytes(), *v.shape)
            cell = (np.floor(x @ axes / eps).astype(np.int64) + 1024).astype(">u2")
            key = [row.tobytes().hex() for row in cell]
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("id"), batch.column("copies"), pa.array(key, pa.string()), pa.array([_narrow(r).tobytes() for r in v], pa.binary())], ["label", "id", "copies", "cell", "u"])

    return run


def _blocks(axes: np.ndarray, size: int):
    names = ["label", "block", "ids", "copies", "m", "low", "high"]

    def put(label, ids, copies, us):
        dim = len(axes)
        narrow = all(len(u) == 4 * dim for u in us)
        raw = b"".join(us) if narrow else b"".join(u if len(u) == 8 * dim else np.frombuffer(u, np.float32).astype(np.float64).tobytes() for u in us)
        p = _unit(raw, len(us), dim) @ axes
        return pa.RecordBatch.from_arrays([pa.array([label], pa.string()), pa.array([min(ids)], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([copies], pa.list_(pa.int64())), pa.array([raw], pa.binary()), pa.array([p.min(axis=0).tolist()], pa.list_(pa.float64())), pa.array([p.max(axis=0).tolist()], pa.list_(pa.float64()))], names)

    def run(batches):
        at, ids, copies, us = None, [], [], []
        for batch in batches:
            for label, i, c, u in zip(*[batch.column(k).to_pylist() for k in ("label", "id", "copies", "u")]):
                if ids and (label != at or len(ids) >= size):
                    yield put(at, ids, copies, us)
                    ids, copies, us = [], [], []
                at = label
                ids.append(i)
                copies.append(c)
                us.append(u)
        if ids:
            yield put(at, ids, copies, us)

    return run


def _pairs_within(x, px, y, py, eps, cosine, same, found, i0=0, j0=0):
    """Recursive interval join of two sequences; appends arrays of index pairs (i, j), i < j if both are one sequence, for every two leaves that are compared."""
    gap = np.maximum(0, np.maximum(px.min(axis=0) - py.max(axis=0), py.min(axis=0) - px.max(axis=0)))
    if gap @ gap > (eps + _SLACK) ** 2:
        return
    if len(x) <= LEAF and len(y) <= LEAF:
        i, j = np.nonzero(x @ y.T >= cosine - 1e-12)
        # the product of matrices rounds in its own order: what is near the bound is decided by the plain sum
        c = np.einsum("ij,ij->i", x[i], y[j])
        ok = c >= cosine
        i, j = i[ok] + i0, j[ok] + j0
        if same:
            i, j = i[i < j], j[i < j]
        found.append((i, j))
        return
    a, b = (len(x) + 1) // 2, (len(y) + 1) // 2
    xs = [(0, a), (a, len(x))] if len(x) > LEAF else [(0, len(x))]
    ys = [(0, b), (b, len(y))] if len(y) > LEAF else [(0, len(y))]
    for s, e in xs:
        for t, f in ys:
            if not same or j0 + f > i0 + s:
                _pairs_within(x[s:e], px[s:e], y[t:f], py[t:f], eps, cosine, same, found, i0 + s, j0 + t)


def _forest(i: np.ndarray, j: np.ndarray) -> list[int]:
    """Positions of links that make a spanning forest."""
    up: dict[int, int] = {}

    def root(k: int) -> int:
        while (p := up.get(k, k)) != k:
            up[k] = up.get(p, p)
            k = p
        return k

    out = []
    for k, (a, b) in enumerate(zip(i.tolist(), j.tolist())):
        if (ra := root(a)) != (rb := root(b)):
            up[max(ra, rb)] = min(ra, rb)
            out.append(k)
    return out


def _meet(axes: np.ndarray, eps: float, cosine: float):
    """(id, links, other): the copies linked with id in this meeting, and rows of a spanning forest of the links (id, other)."""
    dim = len(axes)

    def run(batches):
        for batch in batches:
            ids, links, other = [], [], []
            for r in batch.to_pylist():
                x, y = (_unit(r[m], len(r[i]), dim) for m, i in (("m1", "ids1"), ("m2", "ids2")))
                same = r["block1"] == r["block2"]
                found: list = []
                _pairs_within(x, x @ axes, y, y @ axes, eps, cosine, same, found)
                i, j = (np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in (0, 1))
                if not len(i):
                    continue
                a, b, ca, cb = (np.array(r[k]) for k in ("ids1", "ids2", "copies1", "copies2"))
                for own, k, c in ((a, i, cb[j]), (b, j, ca[i])):
                    n = np.bincount(k, weights=c, minlength=len(own)).astype(np.int64)
                    at = np.nonzero(n)[0]
                    ids += own[at].tolist()
                    links += n[at].tolist()
                    other += [None] * len(at)
                tree = _forest(i, j + (0 if same else len(a)))
                ids += a[i[tree]].tolist()
                links += [0] * len(tree)
                other += b[j[tree]].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(links, pa.int64()), pa.array(other, pa.int64())], ["id", "links", "other"])

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, axes: int = AXES, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row.

    Vectors link only with those of the same label and length. Null labels, null or empty or zero vectors, and vectors
    with a null, NaN or infinite component link with nothing, nor do rows without an id (component null, kept true).
    Equal vectors of a label are one point with a count, so a group of copies costs no pairs; the rows of a
    repeated id have links of their own and one component. Blocks hold ``block`` distinct points; a meeting returns a
    count per point and a spanning forest, never its pairs. An empty table gives no rows.
    """
    eps = float(np.sqrt(2 - 2 * cosine))
    single = vectors.schema[vec_col].dataType.simpleString() == "array<float>"
    v = F.col(vec_col) if single else F.col(vec_col).cast("array<double>")
    zero = F.lit(0.0).cast("float" if single else "double")
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    key = F.concat_ws(":", F.size(v), F.col(label_col).cast("string"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & good, key).alias("label"), F.transform(v, lambda x: F.when(x == 0, zero).otherwise(x)).alias("v"))
    rows = materialise(rows, "vectors")
    usable = rows.where("label is not null")
    points = usable.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    points = materialise(points.withColumn("point", F.monotonically_increasing_id()), "points")
    links_of, forests = [], []
    dims = [r[0] for r in points.select(F.size("v").alias("d")).distinct().collect()]
    for dim in sorted(dims):
        own = points.where(F.size("v") == dim)
        base = axes_of(own.select("v"), dim, min(axes, dim))
        k = base.shape[1]
        placed = own.select("label", F.col("point").alias("id"), "copies", "v").mapInArrow(_cells(base, eps), "label string, id long, copies long, cell string, u binary")
        ordered = materialise(placed, "placed").repartitionByRange("label", "cell", "id").sortWithinPartitions("label", "cell", "id")
        blocks = ordered.mapInArrow(_blocks(base, block), "label string, block long, ids array<long>, copies array<long>, m binary, low array<double>, high array<double>")
        blocks = materialise(blocks, "blocks")
        grid = lambda c, add: F.floor(F.col(c)[0] / eps) + F.lit(add)
        box = blocks.select("label", "block", "low", "high")
        near = lambda side: box.select("label", *[F.col(c).alias(f"{c}{side}") for c in ("block", "low", "high")], F.explode(F.sequence(grid("low", 1 - side), grid("high", side - 1))).alias("g"))
        gaps = [F.greatest(F.lit(0.0), F.col("low1")[i] - F.col("high2")[i], F.col("low2")[i] - F.col("high1")[i]) for i in range(k)]
        pairs = near(1).join(near(2), ["label", "g"]).where((F.col("block1") <= F.col("block2")) & (sum((g * g for g in gaps), F.lit(0.0)) <= (eps + _SLACK) ** 2))
        pairs = materialise(pairs.select("block1", "block2").distinct(), "meetings")
        side = lambda n: blocks.select(*[F.col(c).alias(f"{c}{n}") for c in ("block", "ids", "copies", "m")])
        met = pairs.join(side(1), "block1").join(side(2), "block2").mapInArrow(_meet(base, eps, cosine), "id long, links long, other long")
        met = materialise(met, "met")
        links_of.append(met.where("other is null").select("id", "links"))
        forests.append(met.where("other is not null").select(F.col("id").alias("src"), F.col("other").alias("dst")))
    members = materialise(usable.join(points, ["label", "v"]).select("id", "rep", "copies", "point"), "members")
    edges = members.where("id <> rep").select(F.col("rep").alias("src"), F.col("id").alias("dst"))
    end = lambda c: points.select(F.col("point").alias(c), F.col("rep").alias(f"{c}_id"))
    for f in forests:
        edges = edges.unionAll(f.join(end("src"), "src").join(end("dst"), "dst").select("src_id", "dst_id"))
    groups = materialise(connected_components(edges), "groups")
    counted = None
    for x in links_of:
        counted = x if counted is None else counted.unionAll(x)
    if counted is None:
        counted = rows.sparkSession.createDataFrame([], "id long, links long")
    counted = materialise(counted.groupBy(F.col("id").alias("point")).agg(F.sum("links").alias("links")), "counted")
    linked = members.join(counted, "point", "left").select("id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"))
    lone = rows.where("label is null").select("id", F.lit(0).cast("long").alias("n"))
    known = linked.join(groups, "id", "left").select("id", "n", F.coalesce("component", "id").alias("c"))
    out = known.unionAll(lone.select("id", "n", F.col("id").alias("c")))
    return out.select(F.col("id").alias("vec_id"), F.col("n").alias("n_links"), F.col("c").alias("component_id"), F.coalesce(F.col("id") == F.col("c"), F.lit(True)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
with e as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings),
n as (select *, sqrt(list_sum(list_transform(v, lambda x: x * x))) as r from e
      where label is not null and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0),
g as (select vec_id, label, list_transform(v, lambda x: x / r) as u from n where r > 0),
p as (select a.vec_id as a, b.vec_id as b from g a join g b on a.label = b.label and a.vec_id <> b.vec_id and len(a.u) = len(b.u)
      where list_inner_product(a.u, b.u) >= 0.93),
walk as (
  with recursive w(a, b) as (select a, b from p union select w.a, p.b from w join p on w.b = p.a) select a, min(b) as b from w group by a)
select e.vec_id, coalesce(c.n, 0)::bigint as n_links, least(e.vec_id, coalesce(walk.b, e.vec_id)) as component_id,
  e.vec_id = least(e.vec_id, coalesce(walk.b, e.vec_id)) as kept
from e left join (select a, count(*) as n from p group by a) c on c.a = e.vec_id left join walk on walk.a = e.vec_id
"""
