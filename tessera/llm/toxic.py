"""Toxicity by weak supervision.

Voters are lexicon entries (words and word beginnings that the labelled rows set apart, of either sign) and patterns; each
votes toxic or clean, as the rows say of it, or not at all. A generative label model with a hidden class
fits how often every voter votes in either class by expectation maximisation, from the votes of all rows; correlated voters
are joined in a tree, each voter's vote depending on the class and on the voter with which it shares most
information given the class. A logistic classifier over words and word beginnings is then trained on the model's
posteriors and scores every text. The given labels choose the voters and tell what the hidden class means, by a prior on how each
voter votes in either class that weighs ``ANCHOR`` times the sample; they are no voter themselves unless ``gold`` says so.

Learning reads a bounded sample, ``SAMPLE`` labelled rows in the order of a hash of their ids, and never
those held out. The driver receives at most ``VOCABULARY`` entries, the candidates of the clean voters and that sample's
feature numbers.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE, VOCABULARY, VOTERS, CLEAN_VOTERS, ANCHOR, THRESHOLD = 20_000, 4_000, 48, 16, 2, 0.7
#: Standard errors by which a toxic voter must stand out, of the thousands of entries that are looked at; and a clean one or a pattern, of which there are few.
SURE, LIKELY = 4.0, 1.64
_EDGES = ".,;:!?\"'()[]{}<>*%$#&|-_+=~/\\"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text modulo 3 is 1; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def words_of(text: str | None) -> Counter:
    """The words with how often each comes."""
    return Counter([w.strip(_EDGES) for w in _WORD.findall((text or "").translate(_LOWER))])


def entries_of(words: Counter) -> set[str]:
    """Words ('=word'), beginnings of 4 to 6 letters ('beginn'), and those with which two or three words and more begin ('2:beginn', '3:beginn')."""
    out = {"=" + w for w in words}
    out.discard("=")
    begins: dict[str, int] = {}
    for w, n in words.items():
        if len(w) >= 4:
            for b in {w[:4], w[:5], w[:6]}:
                begins[b] = begins.get(b, 0) + n
    out.update(begins)
    for b, n in begins.items():
        if n >= 2:
            out.add("2:" + b)
            if n >= 3:
                out.add("3:" + b)
    return out


#: Pattern voters; which way one votes, and whether it does, is found from the labelled rows.
PATTERNS = (
    ("second_person_insult", re.compile(r"\b(?:you|u|du|tu|vous)\s+(?:are\s+|r\s+|bist\s+|eres\s+|es\s+)?(?:an?\s+|such\s+an?\s+)?(?:idiot|moron|loser|scum|trash)", re.I)),
    ("self_harm_wish", re.compile(r"\b(?:kill|hang)\s+(?:yourself|urself)\b|\bkys\b", re.I)),
    ("masked_word", re.compile(r"\b[a-z]{1,2}\*{2,}[a-z]*\b", re.I)),
    ("hate_verb", re.compile(r"\b(?:hate|despise)\s+(?:you|them|those)\b", re.I)),
    ("insult", re.compile(r"\b(?:idiot|moron|loser|scum|clown|trash)s?\b", re.I)),
    ("contempt", re.compile(r"\b(?:stupid|pathetic|worthless|disgusting)\b", re.I)),
    ("by_insult", re.compile(r"\b(?:by|the|an?)\s+(?:idiot|moron|loser|scum|clown|trash|stupid|pathetic|worthless)\b", re.I)),
    ("courtesy", re.compile(r"\b(?:please|thank you|kind regards|bitte|merci|gracias)\b", re.I)),
    ("shouting", re.compile(r"\b[A-Z]{4,}\b")),
    ("exclaiming", re.compile(r"!!|!\s*$")),
    ("stars", re.compile(r"\*{3}")),
    ("stretched", re.compile(r"(\w)\1\1\1")),
    ("licence", re.compile(r"licen[cs]e", re.I)),
    ("contact", re.compile(r"@[\w.-]+\.\w|\d{7}")),
    ("quoted", re.compile(r"[\"“”«»]")),
    ("table_row", re.compile(r"\|.*\|")),
)


def _counts(batches):
    """(entry, toxic, clean) partial document counts of each partition."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for text, y in zip(batch.column(0), batch.column(1).to_pylist()):
            seen[int(y)].update(entries_of(words_of(text.as_py())))
    names = list(seen[0].keys() | seen[1].keys())  # an entry that no toxic row here has may have some elsewhere
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[1][e] for e in names], pa.int64()), pa.array([seen[0][e] for e in names], pa.int64())], ["entry", "toxic", "clean"])


def _rows(index: dict[str, int]):
    """(y, found entries' numbers, pattern bits) of each labelled row."""

    def run(batches):
        for batch in batches:
            ys, found, bits = batch.column(1).to_pylist(), [], []
            for text in batch.column(0):
                t = text.as_py() or ""
                found.append(sorted(index[e] for e in entries_of(words_of(t)) if e in index))
                bits.append(sum(1 << k for k, (_, p) in enumerate(PATTERNS) if p.search(t)))
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(found, pa.list_(pa.int32())), pa.array(bits, pa.int64())], ["y", "f", "b"])

    return run


def _bound(toxic, clean, n1: int, n0: int):
    """(log odds of toxic to clean rows with something, its standard error) from document counts."""
    odds = np.log((toxic + 0.5) / (n1 + 1)) - np.log((clean + 0.5) / (n0 + 1))
    return odds, np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))


def _core(entry: str) -> str:
    return entry[1:] if entry[0] == "=" else entry[2:] if entry[:2] in ("2:", "3:") else entry


def _apart(entries: list[str], most: int) -> list[str]:
    """The first entries, without those nested in an earlier one."""
    out: list[str] = []
    for e in entries:
        core = _core(e)
        if len(out) < most and not any(core.startswith(_core(v)) or _core(v).startswith(core) for v in out):
            out.append(e)
    return out


def lexicon(entries: pd.DataFrame, n1: int, n0: int) -> tuple[list[str], list[str]]:
    """(classifier entries, entries that vote toxic) from document counts, the surest first; ties by entry."""
    odds, error = _bound(entries["toxic"], entries["clean"], n1, n0)
    sure = odds - LIKELY * error
    ranked = entries.assign(gain=sure * entries["toxic"], sure=odds - SURE * error).sort_values(["gain", "entry"], ascending=[False, True])
    return ranked["entry"].tolist(), _apart(ranked.loc[ranked["sure"] > 0.5, "entry"].tolist(), VOTERS)


def clean_lexicon(entries: pd.DataFrame, n1: int, n0: int) -> list[str]:
    """Entries that vote clean: those whose log odds are below 0 for sure, the surest first; ties by entry."""
    odds, error = _bound(entries["toxic"], entries["clean"], n1, n0)
    ranked = entries.assign(sure=odds + LIKELY * error).sort_values(["sure", "entry"])
    return _apart(ranked.loc[ranked["sure"] < 0, "entry"].tolist(), CLEAN_VOTERS)


def pattern_votes(bits: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """(number, vote) of the patterns that fire in five rows at least and surely tell the classes apart."""
    out = []
    for k in range(len(PATTERNS)):
        fires = (bits >> k & 1) == 1
        odds, error = _bound((fires & (y == 1)).sum(), (fires & (y == 0)).sum(), (y == 1).sum(), (y == 0).sum())
        if fires.sum() >= 5 and abs(odds) > LIKELY * error:
            out.append((k, 1 if odds > 0 else -1))
    return out


def label_model(votes: np.ndarray, y: np.ndarray, gold: bool = False, rounds: int = 30) -> tuple[np.ndarray, dict]:
    """Posterior of toxic per row, and the estimates.

    votes: rows x voters of -1, 0, 1. Each voter's distribution, abstention included, depends on the class and on its
    parent in a maximum spanning tree of the voters' conditional mutual information, re-estimated as the rounds go;
    roots depend on the class only. y: the labels at hand. How each voter votes in the rows of a label weighs ANCHOR times
    the sample beside the posteriors, lest the hidden class become another one, such as a language. gold: the label
    is one more voter of unknown accuracy; without it a row's posterior comes from its votes alone.
    """
    n, j = votes.shape
    v = votes + 1
    acc = np.array([0.1, 0.9])
    seen = np.stack([1 - y, y]).astype(float)
    share = ANCHOR * n * seen / np.maximum(seen.sum(axis=1, keepdims=True), 1)
    tree = np.full(j, -1)
    onehot = np.stack([(v == s) for s in range(3)], axis=2).astype(np.float64)  # n x j x 3
    anchor = np.einsum("yn,njs->yjs", share, onehot)
    for step in range(rounds):
        w = np.stack([1 - post, post]) if step else seen * 0
        prior = (w.sum(axis=1) + ANCHOR * n * seen.mean(axis=1) + 1) / (w.sum() + ANCHOR * n + 2)
        single = np.einsum("yn,njs->yjs", w, onehot) + anchor + 0.1
        single /= single.sum(axis=2, keepdims=True)
        if step in (1, 5, 15) and j > 1:
            flat = onehot.reshape(n, j * 3)
            info = np.zeros((j, j))
            for c in range(2):
                both = ((flat * w[c][:, None]).T @ flat).reshape(j, 3, j, 3).transpose(0, 2, 1, 3) + 0.01
                total = both.sum(axis=(2, 3), keepdims=True)
                p = both / total
                info += prior[c] * (p * np.log(p / (p.sum(axis=3, keepdims=True) * p.sum(axis=2, keepdims=True)))).sum(axis=(2, 3))
            tree = _spanning_tree(info, 0.002)
        logp = np.repeat(np.log(prior)[:, None], n, axis=1)
        if gold:
            logp += np.stack([np.where(y == 1, np.log(acc[c]), np.log(1 - acc[c])) for c in range(2)])
        for k in range(j):
            if tree[k] < 0:
                logp += np.log(single[:, k, :])[:, v[:, k]]
            else:
                joint = np.einsum("yn,ns,nt->yst", w + share, onehot[:, tree[k]], onehot[:, k]) + 0.1 * single[:, k][:, None, :]
                joint /= joint.sum(axis=2, keepdims=True)
                logp += np.log(joint)[:, v[:, tree[k]], v[:, k]]
        post = 1 / (1 + np.exp(np.clip(logp[0] - logp[1], -50, 50)))
        if gold:
            acc = np.array([(((1 - post) * y).sum() + 1) / ((1 - post).sum() + 10), ((post * y).sum() + 9) / (post.sum() + 10)])
    return post, {"prior": float(post.mean()), "label_accuracy": acc.tolist(), "votes": single, "parents": tree.tolist()}


def _spanning_tree(info: np.ndarray, least: float) -> np.ndarray:
    """Parent of each voter in a maximum spanning forest over pairs with at least that information."""
    j = len(info)
    parent, inside = np.full(j, -1), np.zeros(j, bool)
    best, via = np.full(j, -np.inf), np.full(j, -1)
    for _ in range(j):
        k = int(np.argmax(np.where(inside, -np.inf, np.where(via < 0, -1.0, best))))
        inside[k] = True
        if via[k] >= 0 and best[k] >= least:
            parent[k] = via[k]
        better = (info[k] > best) & ~inside
        best[better], via[better] = info[k][better], k
    return parent


def fit_logistic(rows: list[np.ndarray], target: np.ndarray, size: int, rounds: int = 300, rate: float = 0.5, decay: float = 2e-5) -> tuple[np.ndarray, float]:
    """Weights and bias of binary features by full-batch Adagrad on soft targets."""
    n = len(rows)
    flat = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)
    owner = np.repeat(np.arange(n), [len(r) for r in rows])
    w, b, gw, gb = np.zeros(size), 0.0, np.full(size, 1e-8), 1e-8
    for _ in range(rounds):
        z = np.bincount(owner, weights=w[flat], minlength=n) + b
        err = 1 / (1 + np.exp(-z)) - target
        g = np.bincount(flat, weights=err[owner], minlength=size) / n + decay * w
        h = err.mean()
        gw, gb = gw + g * g, gb + h * h
        w, b = w - rate * g / np.sqrt(gw), b - rate * h / np.sqrt(gb)
    return w, b


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, gold: bool = False) -> tuple[dict[str, float], float, dict]:
    """(weight by entry, bias, estimates) learned from the labelled rows that are not held out.

    Rows whose label or id is null teach nothing; an id with several labels has their mean, rounded up. Without rows of
    both classes the model is constant: no entries, and the bias of the labels' share (0.5 a row added). gold: the given
    label votes, too. Ties among entries go to the one that is first in order.
    """
    chosen = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    chosen = chosen.groupBy(F.col(id_col).alias("__id")).agg((F.avg("toxic") >= 0.5).cast("int").alias("__y"))
    chosen = chosen.orderBy(F.xxhash64("__id"), "__id").limit(sample)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")).join(F.broadcast(chosen), "__id").select("__t", "__y")
    from tessera.plans.scratch import materialise

    rows = materialise(rows, "toxic")
    n = {r["__y"]: r["count"] for r in rows.groupBy("__y").count().collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return {}, float(np.log((n1 + 0.5) / (n0 + 0.5))), {}
    counted = materialise(rows.mapInArrow(_counts, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "entries")
    share = F.col("toxic") * n0 / (F.col("clean") + 0.5) / n1
    kept = counted.where((F.col("toxic") >= 4) & (share > 1.5)).orderBy((F.col("toxic") * F.log(share)).desc(), "entry").limit(VOCABULARY).toPandas()
    entries, voters = lexicon(kept, n1, n0)
    less = (F.col("toxic") + 0.5) * n0 / ((F.col("clean") + 0.5) * n1)
    rare = clean_lexicon(counted.where((F.col("clean") >= 20) & (less < 0.6)).orderBy(less, F.desc("clean"), "entry").limit(50 * CLEAN_VOTERS).toPandas(), n1, n0)
    index = {e: k for k, e in enumerate([*entries, *(e for e in rare if e not in set(entries))])}
    got = rows.mapInArrow(_rows(index), "y int, f array<int>, b long").toPandas()
    found, y, bits = [np.asarray(f, dtype=np.int64) for f in got["f"]], got["y"].to_numpy(), got["b"].to_numpy()
    chosen = [(index[e], vote) for words, vote in ((voters, 1), (rare, -1)) for e in words]
    patterns = pattern_votes(bits, y)
    votes = np.zeros((len(got), len(chosen) + len(patterns)), np.int8)
    for k, f in enumerate(found):
        own = set(f.tolist())
        votes[k, : len(chosen)] = [vote if a in own else 0 for a, vote in chosen]
    for k, (p, vote) in enumerate(patterns):
        votes[:, len(chosen) + k] = np.where(bits >> p & 1, vote, 0)
    found = [f[f < len(entries)] for f in found]
    post, said = label_model(votes, y, gold)
    said |= {"voters": [*voters, *rare, *(PATTERNS[p][0] for p, _ in patterns)], "signs": [v for _, v in [*chosen, *patterns]], "fired": (votes != 0).sum(axis=0).tolist(), "moved": int(((post >= 0.5) != (y == 1)).sum())}
    w, b = fit_logistic(found, post, len(entries))
    return dict(zip(entries, w.tolist())), float(b), said


def _scorer(weights: dict[str, float], bias: float):
    @F.pandas_udf("double")
    def run(text: pd.Series) -> pd.Series:
        out = []
        for t in text:
            z = bias + sum(weights.get(e, 0.0) for e in entries_of(words_of(t)))
            out.append(1 / (1 + np.exp(-min(max(z, -50.0), 50.0))))
        return pd.Series(out, dtype="float64")

    return run


def score(docs: DataFrame, weights: dict[str, float], bias: float, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row; null and empty texts get the score of no entry.

    Only the id and the text are read, and of the id only whether it is held out. An empty table gives no rows.
    """
    out = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), _scorer(weights, bias)(F.col(text_col)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    weights, bias, _ = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, weights, bias)
