"""Language-model scores: a smoothed unigram baseline and online logistic context mixing.

1. Documents are cut into blocks of about ``BLOCK_BYTES`` as they are read and written once to the shared folder, a row for
   each block with its documents' coded streams compressed together.
2. Each block counts its words and the cells of its contexts over its training documents, those for development left
   out of the cells, and deals both into shards by hash, one packed row for each block, context and shard; of other
   documents come words and cells that count nothing. Contexts within a word are counted by distinct word, those across
   words by byte. Within a block words are told apart by a hash of 64 bits, within a shard by their letters.
3. A shard sums over all blocks and returns to each block the counts of its own words and the log odds of its own
   cells, which are all that the block's texts can ask for. So what is kept grows with the corpus, no vocabulary
   or table is ever held as a whole, and a shard holds about the words and cells of ``SHARD_BYTES`` of text.
4. Each block learns weights of the mixer online on its own development documents (1 in ``DEV`` of the training documents), which the
   cells don't count, from the block's own counts; one more shard averages them and returns the average to each block.
5. Every block is scored with its own words' counts and cells' odds and the average weights, which depend on the corpus and on how it
   is cut into blocks. Steps 2 to 5 are one job.
"""

from __future__ import annotations

import ctypes
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import mixture as M
from tessera.plans.scratch import materialise

BLOCK_BYTES, SHARD_BYTES, BATCH_BYTES, DEV = 10 << 20, 32 << 20, 512 << 10, 32
_WAITING = 1 << 20  # cells that a block gathers at least before it adds them up, else as many as it has
_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def _crc(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary"))


def _press(raw: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(raw)


def _open(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


_STATS = -(1 << 62)  # the block to which shards report how many words training has
_BLOCK = {"block": pa.int64(), "ids": pa.list_(pa.int64()), "roles": pa.list_(pa.int32()), "streams": pa.binary(), "bytes": pa.int64(), "trained": pa.int64(), "tokens": pa.int64(), "hist": pa.list_(pa.float64())}
_BLOCK_DDL = "block long, ids array<long>, roles array<int>, streams binary, bytes long, trained long, tokens long, hist array<double>"


def _row(kinds: dict, values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds.values())], list(kinds))


def _cut(batches):
    """One row per block: its documents' ids, roles (0 held out, 1 training, 2 development) and streams, and how often its training documents have each byte."""
    block, size, ids, roles, streams = TaskContext.get().partitionId() << 32, 0, [], [], []

    def row():
        trained = [s for s, r in zip(streams, roles) if r]
        hist = np.bincount(np.frombuffer(b"".join(trained), np.uint8), minlength=256)
        return _row(_BLOCK, (block, ids, roles, _press(b"".join(streams), 5), size, len(trained), sum(x.count(b" ") for x in trained), hist.astype(float).tolist()))

    for batch in batches:
        for i, role, text in zip(batch.column("id").to_pylist(), batch.column("role").to_pylist(), batch.column("text")):
            if size > BLOCK_BYTES:
                yield row()
                block, size, ids, roles, streams = block + 1, 0, [], [], []
            ids.append(i)
            roles.append(role)
            streams.append(M.stream_of(text.as_py()))
            size += len(streams[-1])
    if ids:
        yield row()


def _documents(packed: bytes) -> list[bytes]:
    return [x + b"\n" for x in _open(packed).split(b"\n")[:-1]]


def _batches(streams):
    """Lists of streams of about BATCH_BYTES."""
    held, size = [], 0
    for s in streams:
        held.append(s)
        size += len(s)
        if size >= BATCH_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _give_back() -> None:
    """Returns what a finished block no longer needs to the system, where the C library can: workers outlive their tasks."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers, in as few bytes each as the largest needs, by place of the byte."""
    wide = next(w for w in (1, 2, 4, 8) if int(values.max(initial=0)) < 1 << 8 * w)
    return b"%d" % wide + _press(values.astype(f"<u{wide}").view(np.uint8).reshape(-1, wide).T.tobytes())


def _unpack(raw: bytes) -> np.ndarray:
    wide = int(raw[:1])
    planes = np.frombuffer(_open(raw[1:]), np.uint8).reshape(wide, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{wide}").ravel().astype(np.uint64)


def _steps(ascending: np.ndarray) -> bytes:
    return _pack(np.diff(ascending, prepend=np.uint64(0)))


def _pack_odds(odds: np.ndarray, names: np.ndarray) -> bytes:
    """Packed log odds of named cells: how far each bit's agree with the cell's value, then the differences from bit to bit, which are 0 where a context has one value."""
    agree = odds.view(np.int8).reshape(-1, 4) * M.SIGN[names & np.uint64(15)]
    agree[:, 1:] -= agree[:, :-1].copy()
    return _press(agree.T.tobytes(), 3)


def _unpack_odds(raw: bytes, names: np.ndarray) -> np.ndarray:
    agree = np.frombuffer(_open(raw), np.int8).reshape(4, -1)
    agree = np.cumsum(agree, axis=0, dtype=np.int8)
    return (np.ascontiguousarray(agree.T) * M.SIGN[names & np.uint64(15)]).view("<u4").ravel()


def _heads(ascending: np.ndarray) -> np.ndarray:
    """Where each value begins."""
    return np.flatnonzero(np.concatenate([[True], ascending[1:] != ascending[:-1]])) if len(ascending) else np.empty(0, np.int64)


def _added(names: list[np.ndarray], counts: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending names and the sums of their counts. Empties both lists, so that what nobody else holds goes before they are sorted."""
    low, size = np.uint64(60 - bits), sum(map(len, names))
    if all(int(n.max(initial=0)) < 1 << (60 - bits) for n in counts):  # a name and its count fit in one number
        key, end = np.empty(size, np.uint64), size
        while names:
            x, n = names.pop(), counts.pop()
            part = key[end - len(x) : end]
            np.left_shift(x, low, out=part)
            part += n.astype(np.uint64, copy=False)
            end -= len(x)
            del x, n
        key.sort()
        name = key >> low
        head = _heads(name)
        name = name[head]
        key &= (np.uint64(1) << low) - np.uint64(1)
    else:
        name, key = np.concatenate(names), np.concatenate(counts).astype(np.uint64)
        names.clear()
        counts.clear()
        order = np.argsort(name)
        name, key = name[order], key[order]
        head = _heads(name)
        name = name[head]
    return name, np.add.reduceat(key, head) if len(head) else key


def _types(batches: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(batch, place in it, counts in training without and with development) of the distinct words of batches (role, keys of words)."""
    keys, at, place, n1, n2 = [], [], [], [], []
    for k, (role, of_words) in enumerate(batches):
        order = np.argsort(of_words)
        key = of_words[order]
        head = _heads(key)
        n = np.diff(np.append(head, len(key)))
        keys.append(key[head])
        at.append(np.full(len(head), k))
        place.append(order[head])
        n1.append(n * (role == 1))
        n2.append(n * (role > 0))
    key = np.concatenate(keys)
    order = np.argsort(key)
    head = _heads(key[order])
    n1, n2 = (np.add.reduceat(np.concatenate(n)[order], head) for n in (n1, n2))
    one = order[head]
    return np.concatenate(at)[one], np.concatenate(place)[one], n1, n2


def _distinct(roles_and_streams, rank: np.ndarray, each) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(distinct words with a space after each, counts in training without and with development) of batches (role, streams); each: called with every (role, coded)."""
    raws, words, kept = [], [], []
    for role, streams in roles_and_streams:
        coded = M.Coded(streams, rank)
        each(role, coded)
        raws.append(np.frombuffer(b"".join(streams), np.uint8))
        words.append(coded.words)
        kept.append((role, coded.keys))
    at, place, n1, n2 = _types(kept)
    offset = np.cumsum([0, *map(len, raws)])
    first = np.cumsum([0, *map(len, words)])
    flat = np.concatenate(words)
    begin, end = flat[first[at] + place], flat[first[at] + place + 1]
    raw = np.concatenate(raws)
    begin += offset[at]
    end += offset[at]
    real = raw[begin] != M.END
    begin, size, n1, n2 = begin[real], (end - begin)[real], n1[real], n2[real]
    head = np.cumsum(size) - size
    return raw[np.repeat(begin - head, size) + np.arange(size.sum())].tobytes(), n1, n2


_DEALT = {"kind": pa.int32(), "shard": pa.int64(), "block": pa.int64(), "a": pa.binary(), "b": pa.binary()}
_DEALT_DDL = "kind int, shard long, block long, a binary, b binary"
_WORDS = len(M.CONTEXTS)  # the kind of rows of words; those of cells have the context's number
_WEIGHTS = _WORDS + 1  # and of what a block learned


def _count(rank: np.ndarray, bits: int, shards: int):
    """Rows of each block by kind and shard: its words, and how often its training documents have them; for each context its
    cells, ascending, and how often its training documents but those for development have them; and what it learned of the weights."""
    bounds = np.array([(j << bits) // shards << 4 for j in range(shards)] + [1 << (bits + 4)], np.uint64)

    def cells(kind, block, name, n):
        cut = np.searchsorted(name, bounds)
        for j in np.flatnonzero(np.diff(cut)).tolist():
            part = slice(cut[j], cut[j + 1])
            yield _row(_DEALT, (kind, j, block, _steps(name[part]), _pack(n[part])))

    def words(block, raw, keys, n):
        s = np.frombuffer(raw, np.uint8)
        end = np.flatnonzero(s == M.SPACE) + 1
        begin = np.concatenate([[0], end[:-1]])
        shard = (keys >> np.uint64(20)) % np.uint64(shards)
        order = np.argsort(shard, kind="stable")
        cut = np.searchsorted(shard[order], np.arange(shards + 1, dtype=np.uint64))
        for j in np.flatnonzero(np.diff(cut)).tolist():
            of = order[cut[j] : cut[j + 1]]
            size = end[of] - begin[of]
            head = np.cumsum(size) - size
            letters = s[np.repeat(begin[of] - head, size) + np.arange(size.sum())].tobytes()
            yield _row(_DEALT, (_WORDS, j, block, _press(letters), _pack(n[of].astype(np.uint64))))

    def run(batches):
        for batch in batches:
            for block, roles, packed in zip(*(batch.column(c).to_pylist() for c in ("block", "roles", "streams"))):
                documents = _documents(packed)
                of = {r: [s for s, x in zip(documents, roles) if x == r] for r in (1, 2, 0)}
                names, counts, waiting, most = [], [], 0, _WAITING

                def each(role, coded):
                    nonlocal names, counts, waiting, most
                    name = coded.names(bits)
                    name.sort()
                    head = _heads(name)
                    names.append(name[head])
                    counts.append((np.diff(np.append(head, len(name))) if role == 1 else np.zeros(len(head))).astype(np.uint32))  # at most one a byte
                    waiting += len(head)
                    if waiting > most:
                        name, n = _added(names, counts, bits)
                        names, counts, waiting, most = [name], [n.astype(np.uint32)], 0, max(_WAITING, len(name))

                raw, n1, n2 = _distinct(((r, x) for r in of for x in _batches(of[r])), rank, each)
                ends, dev = len(of[1]), of[2]
                del documents, of  # the letters are done with
                learns = _Learner(dev, rank, bits) if dev else None
                name, n = _added(names, counts, bits)
                yield from cells(M.ACROSS, block, name, n)
                if learns:
                    learns.know(M.ACROSS, name, n)
                del name, n
                every = M.Words(raw, rank)
                if raw:
                    yield from words(block, raw, every.keys[:-1], n2)
                n1 = np.append(n1, ends).astype(np.uint32)
                size = np.diff(every.starts)
                for k in range(M.INSIDE):
                    name, n = _added([every.names(k, bits)], [np.repeat(n1, size)], bits)
                    yield from cells(k, block, name, n)
                    if learns:
                        learns.know(k, name, n)
                    del name, n
                del every, raw, n1, size
                x = learns.learned() if learns else np.zeros(0)
                yield _row(_DEALT, (_WEIGHTS, 0, block, _press(x.tobytes()), None))
                del learns
                _give_back()

    return run


_FOUND = {"kind": pa.int32(), "shard": pa.int64(), "block": pa.int64(), "a": pa.binary(), "b": pa.binary()}


def _shard(bits: int):
    """What a shard returns to its blocks: of their words the corpus counts, of their cells the log odds (with their names, if across
    words; within words a block finds the same order again), and the sum of what all learned. Of words also how many
    training has, as a row's shard."""

    def run(table: pa.Table) -> pa.Table:
        kind, shard = table.column("kind")[0].as_py(), table.column("shard")[0].as_py()
        blocks, a, b = (table.column(c).to_pylist() for c in ("block", "a", "b"))
        if kind == _WORDS:
            total: dict[bytes, int] = {}
            split = [_open(x).split() for x in a]
            for words, raw in zip(split, b):
                for w, n in zip(words, _unpack(raw).tolist()):
                    total[w] = total.get(w, 0) + n
            rows = [(kind, shard, block, x, _pack(np.array(list(map(total.__getitem__, words)), np.uint64))) for block, x, words in zip(blocks, a, split)]
            rows.append((kind, sum(n > 0 for n in total.values()), _STATS, None, None))
        elif kind == _WEIGHTS:
            parts = [x for x in (np.frombuffer(_open(y)) for _, y in sorted(zip(blocks, a))) if len(x)]
            packed = _press(np.sum(parts, axis=0).tobytes()) if parts else _press(b"")
            rows = [(kind, shard, block, packed, None) for block in blocks]
        else:
            own = [np.cumsum(_unpack(x), dtype=np.uint64) for x in a]
            name, n = _added(own.copy(), [_unpack(x) for x in b], bits)
            said = M.odds(name, n.astype(np.float32))
            rows = [(kind, shard, block, x if kind == M.ACROSS else None, _pack_odds(said[np.searchsorted(name, mine)], mine)) for block, x, mine in zip(blocks, a, own)]
        _give_back()
        return pa.table({n: pa.array([r[k] for r in rows], kind) for k, (n, kind) in enumerate(_FOUND.items())})

    return run


class _Learner:
    """Learns weights on development documents, from the counts of one context after the other."""

    def __init__(self, documents: list[bytes], rank: np.ndarray, bits: int):
        raw, _, _ = _distinct(((2, x) for x in _batches(documents)), rank, lambda role, coded: None)
        self.words, self.bits = M.Words(raw, rank), bits
        numbers = M.Numbers(self.words.keys)
        self.size = sum(map(len, documents))
        self.coded = [M.Coded(streams, rank) for streams in _batches(documents)]
        self.places = [c.places(self.words, numbers.find(c.keys)) for c in self.coded]
        self.inside: list[np.ndarray] = []
        self.across: list[np.ndarray] = []

    def know(self, k: int, name: np.ndarray, n: np.ndarray) -> None:
        """The counts of the k-th context: ascending names and how often each occurs."""
        asked = [self.words.names(k, self.bits)] if k < M.INSIDE else [c.names(self.bits) for c in self.coded]
        more = [np.sort(x) for x in asked]
        more = [x[_heads(x)] for x in more]
        slot = np.sort(np.concatenate(more) & ~np.uint64(15))
        slot = slot[_heads(slot)]
        begin, end = np.searchsorted(name, slot), np.searchsorted(name, slot + np.uint64(16))
        size = end - begin
        at = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
        name, n = name[at], n[at]
        # what the documents ask for but training lacks has the odds of its context, as in a shard
        name, n = _added([name, *more], [n, *[np.zeros(len(x), np.uint64) for x in more]], self.bits)
        odds = M.odds(name, n.astype(np.float32))
        found = [M.lookup(x, name, odds, self.bits) for x in asked]
        if k < M.INSIDE:
            self.inside += found
        else:
            self.across = found

    def learned(self) -> np.ndarray:
        """Bytes seen, the weights times that, then the calibration counts."""
        w, apm = M.start_weights(), np.zeros((2, 4, M.GATES * M.BUCKETS))
        squares = np.zeros(w.shape)
        for calibrate in (False, True):
            for coded, at, across in zip(self.coded, self.places, self.across):
                M.learn([x.take(at) for x in self.inside] + [across], coded.values, self.words.gate.take(at), w, squares, apm, calibrate)
        return np.concatenate([[self.size], w.astype(np.float64).ravel() * self.size, apm.ravel()])


class _Texts:
    """Batches of a block's documents with what the mixer needs of them, from the rows that shards returned to it."""

    def __init__(self, found: pa.Table, rank: np.ndarray, bits: int):
        self.rank, self.bits = rank, bits
        rows: dict[int, list] = {k: [] for k in range(_WEIGHTS + 1)}
        for kind, shard, a, b in sorted(zip(*(found.column(c).to_pylist() for c in ("kind", "shard", "a", "b"))), key=lambda r: r[:2]):
            rows[kind].append((a, b))
        raw = b"".join(_open(a) for a, _ in rows[_WORDS])
        self.learned = np.frombuffer(_open(rows[_WEIGHTS][0][0])) if rows[_WEIGHTS] else np.zeros(0)
        self.counts = np.concatenate([np.empty(0, np.uint64), *[_unpack(b) for _, b in rows[_WORDS]]]).astype(np.float64)
        self.words = M.Words(raw, rank)
        self.numbers = M.Numbers(self.words.keys)
        self.by_word = {w: k for k, w in enumerate([*raw.split(), b"\n"])} if self.numbers.clash else None
        self.inside = [M.by_rank(self.words.names(k, bits), lambda names, of=rows[k]: self._odds([b for _, b in of], names), bits, own=True) for k in range(M.INSIDE)]
        self.words.forget()
        self.names = np.concatenate([np.empty(0, np.uint64), *[np.cumsum(_unpack(a), dtype=np.uint64) for a, _ in rows[M.ACROSS]]])
        self.odds = self._odds([b for _, b in rows[M.ACROSS]], self.names)

    @staticmethod
    def _odds(packed: list[bytes], names: np.ndarray) -> np.ndarray:
        """The log odds of cells from the rows of one shard after the other."""
        out, at = [np.empty(0, "<u4")], 0
        for raw in packed:
            n = len(_open(raw)) // 4
            out.append(_unpack_odds(raw, names[at : at + n]))
            at += n
        if at != len(names):
            raise ValueError(f"{at} cells came back of {len(names)}")
        return np.concatenate(out)

    def read(self, streams: list[bytes]) -> tuple[M.Coded, np.ndarray, np.ndarray, np.ndarray]:
        """(coded, number of each word, place of each nibble among the words', log odds across words)."""
        coded = M.Coded(streams, self.rank)
        of = self.numbers.find(coded.keys) if self.by_word is None else np.array([self.by_word[w] for s in streams for w in M.words_of(s)])
        return coded, of, coded.places(self.words, of), M.lookup(coded.names(self.bits), self.names, self.odds, self.bits)


def _weights(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights, refinement) from the sum of what the blocks learned, if any has development documents."""
    w, apm = M.start_weights(), np.zeros((2, 4, M.GATES * M.BUCKETS))
    if len(x):
        w = (x[1 : 1 + w.size] / x[0]).reshape(w.shape).astype(np.float32)
        apm = x[1 + w.size :].reshape(apm.shape)
    return w, M.refinement(apm)


_SCORED = "id long, role int, tokens long, known long, base double, score double, size long"


def _score(rank, bits: int, train_tokens: int, ends: int):
    """Rows of documents, base without the logarithm of the denominator; the report of a shard is a row without a role, its words as tokens."""

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        ids, roles, tokens, known, base, sizes, scores = [], [], [], [], [], [], []
        if not docs.num_rows:
            tokens = found.column("shard").to_pylist()
            ids = roles = known = base = scores = sizes = [None] * len(tokens)
        else:
            texts = _Texts(found, rank, bits)
            w, apm = _weights(texts.learned)
            count_of = np.append(texts.counts, float(ends))
            logs_of = np.log10(count_of + 0.5)
            chance_of = np.where(count_of > 0, np.log(np.maximum(count_of, 1) / max(1, train_tokens)), -np.inf)
            inside = M.inside(texts.inside, texts.words.gate, w)
            texts.inside.clear()
            ids, roles = ([x for row in docs.column(c).to_pylist() for x in row] for c in ("ids", "roles"))
            for packed in docs.column("streams").to_pylist():
                for streams in _batches(_documents(packed)):
                    coded, of, at, across = texts.read(streams)
                    c = count_of.take(of)
                    first = np.searchsorted(coded.words, coded.starts[:-1])
                    tokens += np.diff(np.append(first, len(c))).tolist()
                    known += np.add.reduceat((c > 0).astype(np.int64), first).tolist()
                    base += np.add.reduceat(logs_of.take(of), first).tolist()
                    nibbles = M.nibble_scores(coded, inside, across, texts.words.gate, w, apm, of=at)
                    scores += M.score(coded, nibbles, chance_of.take(of), c).tolist()
                    sizes += np.diff(coded.starts).tolist()
            del texts, inside
            _give_back()
        kinds = {"id": pa.int64(), "role": pa.int32(), "tokens": pa.int64(), "known": pa.int64(), "base": pa.float64(), "score": pa.float64(), "size": pa.int64()}
        return pa.table([pa.array(v, k) for v, k in zip((ids, roles, tokens, known, base, scores, sizes), kinds.values())], names=list(kinds))

    return run


def language_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte, one row per input row.

    Scores are log10 probabilities of the whole text: base_score of its words and one end under the smoothed
    unigram counts, score under the mixture, bits_per_byte the latter over the bytes that are coded (lower-cased words, a space after
    each, an end). Documents whose crc32(id as text) mod 5 is 1 are held out and teach nothing. Null texts count as empty, null ids as
    the empty id; repeated rows count and are returned as often as they come; only two columns are read. Without
    training documents all contexts are unknown and the start weights stand. A very long text is a block of its own.
    An empty table gives no rows.
    """
    crc = _crc(F.col(id_col))
    role = F.when(F.expr("c % 5") == 1, 0).when(F.expr(f"c div 5 % {DEV}") == 0, 2).otherwise(1)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), crc.alias("c"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("id", role.cast("int").alias("role"), "text")
    blocks = materialise(rows.mapInArrow(_cut, _BLOCK_DDL), "blocks")

    size = blocks.groupBy(F.lit("all").alias("all")).agg(F.count("*").alias("blocks"), *[F.sum(c).alias(c) for c in ("bytes", "trained", "tokens")], vector_to_array(Summarizer.sum(array_to_vector("hist"))).alias("hist")).first()
    if size is None:
        return docs.sparkSession.createDataFrame([], _SCHEMA)
    # each block is a task of its own, however many partitions a shuffle has by default
    tasks = size["blocks"]
    shards, bits, ends, rank = max(1, size["bytes"] // SHARD_BYTES), M.hash_bits(size["bytes"]), size["trained"], M.ranks(size["hist"])
    train_tokens = size["tokens"] + ends

    texts = blocks.select("block", "roles", "streams")
    found = texts.mapInArrow(_count(rank, bits, shards), _DEALT_DDL).groupBy("kind", "shard").applyInArrow(_shard(bits), _DEALT_DDL)
    scorer = _score(rank, bits, train_tokens, ends)
    ready = blocks.select("block", "ids", "roles", "streams")
    scored = ready.repartition(tasks, "block").groupBy("block").cogroup(found.repartition(tasks, "block").groupBy("block")).applyInArrow(lambda a, b: scorer(a, b), _SCORED)
    scored = materialise(scored, "scored")
    types = (scored.where("role is null").agg(F.sum("tokens")).first()[0] or 0) + (ends > 0)
    floor = math.log10(train_tokens + 0.5 * (types + 1))
    out = scored.where("role is not null")
    return out.select(F.col("id").alias("doc_id"), (F.col("role") == 0).alias("held_out"), F.col("tokens").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"), (F.col("base") - F.col("tokens") * floor).alias("base_score"), "score", (-F.col("score") * math.log2(10) / F.col("size")).alias("bits_per_byte"))


def query(spark, sf_dir: str) -> DataFrame:
    return language_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
