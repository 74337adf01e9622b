"""Logistic context mixing over hashed contexts: the numerical core, one batch of documents at a time.

A text is coded as a byte stream: its lower-cased words, a space after each, and one end byte. The
``TOP`` most frequent bytes are coded by one nibble, the next ``TOP`` by two, all others by four. Each bit
of a nibble is predicted in the contexts of ``CONTEXTS``: the last 2 and 3 bytes of the word so far, the whole word so far,
and the last 5 bytes across words. A context's hash and a nibble's value name a cell; a cell holds, for each of the
value's four bits, the log odds of a one in this context as seen in training. Only cells that occur are held, so their
number grows with the corpus. What the contexts within a word predict is a matter of the word alone, so it is
found once for each distinct word.

The predictions are added with weights chosen by a gate (which nibble, how far into the word; for each bit), then
refined by a table from predicted to observed odds. All this is adapted as a text is read, by a step of the document's own
after every ``stride`` bytes: how far it trusts the contexts within words, that across words, a constant, and the
share of the refinement. At last each word's probability is a mean of that of its bits and that of a unigram
over known words, in shares that each document adapts (a Bayes mixture over ``SHARES``, one for each kind of the word
before). The probabilities of each bit's two values add to one, and so do the shares, so a text's is a proper
probability.
"""

from __future__ import annotations

import numpy as np

CONTEXTS = ("word2", "word3", "word", "order5")
TOP, END, SPACE = 15, 10, 32
FIRST, SLOWER = 256, 16
#: Steps of a document's own trust in the contexts within words and across words, of its constant, and of its share.
RATES = (0.05, 0.1, 0.04, 0.02)
SCALE, LIMIT, PRIOR = 16.0, 7.9, 0.4
PLACES, GATES = 4, 16  # 4 nibbles by 4 places in the word
BUCKETS = 33
_K = len(CONTEXTS)
INSIDE, ACROSS = 3, 3  # contexts within a word; the number of the one across words
_BASE = 0x100000001B3
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_ESCAPED = np.array([0x8A5CD789635D2DFF, 0x121FD2155C472F96, 0xA0761D6478BD642F], np.uint64)
_ONE = np.float32(1)
_PAD = b"\0" * 8
_PIECE = 1 << 18  # bytes of distinct words that are named at once, and cells that get odds at once


def stream_of(text: str | None) -> bytes:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return b" ".join([*words, b""]) + b"\n"


def words_of(stream: bytes) -> list[bytes]:
    """The words of a stream and its end."""
    return [*stream.split(), b"\n"]


def hash_bits(size: int) -> int:
    """Bits of a context's hash in the names of cells, for a corpus of this many bytes: so many that few contexts meet, however large it is."""
    return max(20, size.bit_length() + 3)


def stride(at: int) -> int:
    """Bytes until the next step of a document that is read up to ``at``."""
    return max(FIRST, at // SLOWER)


def _mixed(key: np.ndarray) -> np.ndarray:
    key ^= key >> np.uint64(29)
    key *= np.uint64(0xBF58476D1CE4E5B9)
    return key


def ranks(hist) -> np.ndarray:
    """The place of each byte by falling frequency, 2 * TOP for all beyond."""
    rank = np.full(256, 2 * TOP, np.uint8)
    rank[sorted(range(256), key=lambda b: (-hist[b], b))[: 2 * TOP]] = range(2 * TOP)
    return rank


def path(b: int, rank: np.ndarray) -> list[tuple[tuple, int]]:
    """The nibbles of a byte, each with what was told of the byte before it."""
    r = int(rank[b])
    if r < TOP:
        return [((), r)]
    if r < 2 * TOP:
        return [((), TOP), ((1,), r - TOP)]
    return [((), TOP), ((1,), TOP), ((2,), b >> 4), ((3, b >> 4), b & 15)]


class Nibbles:
    """Values of the nibbles of bytes, the byte of each, which one of it it is, and where each byte's begin (with one at the end)."""

    __slots__ = ("byte", "rare", "second", "starts", "values", "which")

    def __init__(self, s: np.ndarray, rank: np.ndarray):
        code = np.frombuffer(s.tobytes().translate(rank.tobytes()), np.uint8)
        long = np.flatnonzero(code >= TOP)
        if not len(long):
            self.values, self.byte, self.which, self.starts = code, None, None, np.arange(len(s) + 1)
            self.second = self.rare = long
            return
        size = np.ones(len(s) + 1, np.int64)
        size[0] = 0
        size[long + 1] = 2
        rare = long[code.take(long) == 2 * TOP]
        size[rare + 1] = 4
        self.starts = np.cumsum(size)
        self.byte = np.repeat(np.arange(len(s)), size[1:])
        self.second, self.rare = self.starts[long] + 1, self.starts[rare] + 2
        self.values, self.which = np.minimum(code, TOP).take(self.byte), np.zeros(len(self.byte), np.uint8)
        self.values[self.second] = code.take(long) - TOP
        self.values[self.rare], self.values[self.rare + 1] = s[rare] >> 4, s[rare] & 15
        self.which[self.second], self.which[self.rare], self.which[self.rare + 1] = 1, 2, 3

    def of(self, per_byte: np.ndarray) -> np.ndarray:
        return per_byte if self.byte is None else per_byte.take(self.byte)

    def gates(self, place: np.ndarray) -> np.ndarray:
        return place if self.byte is None else place.take(self.byte) + self.which * np.uint8(PLACES)

    def names(self, key: np.ndarray, k: int, bits: int) -> np.ndarray:
        """Names of the cells in the k-th context from its keys, by nibble and of this call alone: the hash, then the value in 4 bits."""
        if len(self.second):
            key[self.second] += _ESCAPED[0]
        if len(self.rare):
            key[self.rare] += _ESCAPED[1]
            key[self.rare + 1] += _ESCAPED[2] * (self.values[self.rare].astype(np.uint64) + np.uint64(2))
        key *= _MULT[k]
        key = _mixed(key)
        key >>= np.uint64(64 - bits)
        key <<= np.uint64(4)
        key += self.values
        return key


def _before(s: np.ndarray, raw: bytes, starts: np.ndarray, size: np.ndarray, far: int = 8) -> np.ndarray:
    """The eight bytes before each one as a number, the nearest highest, 0 beyond the starts (of bytes farther than ``far`` not heeded)."""
    out = np.ndarray((len(s) + 1,), "<u8", _PAD + raw + _PAD, strides=(1,))[: len(s)].copy()
    for k in range(far):
        at = starts[size > k] + k
        out[at] &= np.uint64(((1 << 8 * k) - 1) << 8 * (8 - k))
    return out


class Words:
    """Distinct words, and the end as the last of them: their nibbles with values and gates, and the names of the nibbles' cells in the contexts within a word.

    What names are made of is found anew for each context, in pieces of whole words, as it takes many times the room of the letters.
    """

    __slots__ = ("_cuts", "_heads", "_rank", "_raw", "gate", "keys", "starts", "values")

    def __init__(self, raw: bytes, rank: np.ndarray):
        """raw: the words, a space after each."""
        self._raw, self._rank = raw + b"\n", rank
        s = np.frombuffer(self._raw, np.uint8)
        self._heads = np.concatenate([[0], np.flatnonzero(s == SPACE) + 1, [len(s)]])
        self._cuts = np.unique(np.append(np.searchsorted(self._heads[:-1], np.arange(0, len(s), _PIECE)), len(self._heads) - 1)).tolist()
        values, gates, keys, starts, at = [], [], [], [], 0
        for s, _, heads, size, n in self._pieces():
            total, down = _sums(s)
            keys.append((total[heads + size] - total[heads]) * down[heads])
            values.append(n.values)
            gates.append(n.gates(np.minimum(np.arange(len(s)) - np.repeat(heads, size), PLACES - 1).astype(np.uint8)))
            starts.append(n.starts[heads] + at)
            at += len(n.values)
        self.values, self.gate, self.keys, self.starts = map(np.concatenate, (values, gates, keys, [*starts, [at]]))

    def _pieces(self):
        """(bytes as an array, as such, where words begin, their sizes, nibbles) of one piece after the other."""
        for a, b in zip(self._cuts, self._cuts[1:]):
            heads = self._heads[a : b + 1]
            raw = self._raw[heads[0] : heads[-1]]
            s = np.frombuffer(raw, np.uint8)
            yield s, raw, heads[:-1] - heads[0], np.diff(heads), Nibbles(s, self._rank)

    def forget(self) -> None:
        """Gives up what only names are made of."""
        self._raw = self._heads = None

    def names(self, k: int, bits: int) -> np.ndarray:
        out, at = np.empty(len(self.values), np.uint64), 0
        for s, raw, heads, size, n in self._pieces():
            if k == 2:
                total, down = _sums(s)
                key = (total[:-1] - np.repeat(total[heads], size)) * np.repeat(down[heads], size)
            else:
                key = _before(s, raw, heads, size, k + 2) >> np.uint64(48 - 8 * k)
            out[at : at + len(n.values)] = n.names(n.of(key), k, bits)
            at += len(n.values)
        return out


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    found = _POWERS
    if not found or len(found[0]) < n:
        size = max(n, 1 << 18)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        found = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
        if n <= 1 << 20:  # those of a very long text aren't kept
            _POWERS[:] = found
    return found[0][:n], found[1][:n]


def _sums(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums of bytes times powers before each place, inverses of the powers)."""
    up, down = _powers(len(s) + 1)
    total = np.zeros(len(s) + 1, np.uint64)
    np.cumsum((s + np.uint64(1)) * up[: len(s)], out=total[1:])
    return total, down


class Coded:
    """The nibbles of some documents in order; where documents (in bytes) and their words (in bytes and nibbles) begin, and the words' keys."""

    __slots__ = ("_before", "_nibbles", "heads", "keys", "nibble", "starts", "values", "words")

    def __init__(self, streams: list[bytes], rank: np.ndarray):
        raw = b"".join(streams)
        s = np.frombuffer(raw, np.uint8)
        n = len(s)
        size = np.fromiter(map(len, streams), np.int64, len(streams))
        self.starts = np.concatenate([[0], np.cumsum(size)])
        opens = np.empty(n + 1, bool)
        opens[1:] = s == SPACE
        opens[self.starts] = True
        self.words = np.flatnonzero(opens)  # with one at the end
        total, down = _sums(s)
        self.keys = np.diff(total[self.words]) * down[self.words[:-1]]
        self._nibbles = Nibbles(s, rank)
        self.values, self.nibble = self._nibbles.values, self._nibbles.starts
        self._before = _before(s, raw, self.starts[:-1], size)
        self.heads = self.nibble[self.words[:-1]]

    def names(self, bits: int) -> np.ndarray:
        """Of each nibble's cell in the context across words."""
        return self._nibbles.names(self._nibbles.of(self._before >> np.uint64(24)), ACROSS, bits)

    def places(self, words: Words, of: np.ndarray) -> np.ndarray:
        """Where the nibbles stand among those of distinct words; of: the number of each word."""
        begin = words.starts[of]
        return np.repeat(begin - self.heads, words.starts[of + 1] - begin) + np.arange(len(self.values))


def _ordered(names: np.ndarray, bits: int, own: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct names ascending, how often each comes, the places of all names in that order); own: names may be overwritten."""
    n = len(names)
    if bits + 4 + n.bit_length() <= 64:  # a name and its place fit in one number
        low = np.uint64(n.bit_length())
        order = np.left_shift(names, low, out=names if own else None)
        order += np.arange(n, dtype=np.uint64)
        order.sort()
        key = order >> low
        order &= (np.uint64(1) << low) - np.uint64(1)
        order = order.view(np.int64)
    else:
        order = np.argsort(names)
        key = names[order]
    head = np.flatnonzero(np.concatenate([np.ones(min(n, 1), bool), key[1:] != key[:-1]]))
    return key[head], np.diff(np.append(head, n)), order


def by_rank(names: np.ndarray, values_of, bits: int, own: bool = False) -> np.ndarray:
    """For each name its value; values_of gives those of the distinct names, ascending; own: names may be overwritten."""
    one, times, order = _ordered(names, bits, own)
    values = values_of(one)
    out = np.empty(len(names), values.dtype)
    out[order] = np.repeat(values, times)
    return out


def lookup(names: np.ndarray, keys: np.ndarray, values: np.ndarray, bits: int) -> np.ndarray:
    """The values of cells by name; keys ascending; 0 for one that isn't there.

    Names are sorted with their places and met with the keys in order, which spares the memory the jumps of a table.
    """
    out = np.zeros(len(names), values.dtype)
    if len(keys):
        one, times, order = _ordered(names, bits)
        at = np.searchsorted(keys, one)
        at[at == len(keys)] = 0
        out[order] = np.repeat(np.where(keys.take(at) == one, values.take(at), values.dtype.type(0)), times)
    return out


class Numbers:
    """The number of each word by its key; words whose keys are alike can't be told apart, which ``clash`` says."""

    __slots__ = ("clash", "first", "keys", "numbers", "shift")

    def __init__(self, keys: np.ndarray):
        self.numbers = np.argsort(keys, kind="stable")
        self.keys = keys[self.numbers]
        self.clash = bool((self.keys[1:] == self.keys[:-1]).any())
        top = min(40, len(keys).bit_length() + 1)
        self.shift = np.uint64(64 - top)
        spread = _spread(self.keys)
        by = np.argsort(spread, kind="stable")
        self.keys, self.numbers, spread = self.keys[by], self.numbers[by], spread[by]
        self.first = np.searchsorted(spread, np.arange(1 << top, dtype=np.uint64) << self.shift).astype(np.int32)
        self.keys = np.append(self.keys, np.uint64(0))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Every key must be there."""
        at = self.first.take((_spread(keys) >> self.shift).view(np.int64)).astype(np.int64)
        left = np.flatnonzero(self.keys.take(at) != keys)
        while len(left):
            at[left] += 1
            left = left[self.keys.take(at.take(left)) != keys.take(left)]
        return self.numbers.take(at)


def _spread(keys: np.ndarray) -> np.ndarray:
    return _mixed(keys * np.uint64(0x9E3779B97F4A7C15))


#: 1 where a bit of a nibble is 0 and -1 where it is 1, (bit, value); and the bits themselves.
_SIDE = np.array([[1.0 - 2 * (v >> (3 - j) & 1) for v in range(16)] for j in range(4)], np.float32)


#: 1 where a bit of a value is 1 and -1 where it is 0, (value, bit).
SIGN = -np.ascontiguousarray(_SIDE.T).astype(np.int8)


def odds(names: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Packed log odds of cells, by ascending names, from how often each occurs.

    Byte j of a cell's number is the log odds, times SCALE, that bit j of the nibble is one after the bits before it.
    """
    out, begin = np.empty(len(names), "<u4"), 0
    while begin < len(names):  # pieces of whole slots
        end = np.searchsorted(names, names[min(begin + _PIECE, len(names)) - 1] | np.uint64(15), side="right")
        out[begin:end] = _odds(names[begin:end], counts[begin:end])
        begin = end
    return out


def _odds(names: np.ndarray, counts: np.ndarray) -> np.ndarray:
    slot = names >> np.uint64(4)
    head = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
    size = np.diff(np.append(head, len(names)))
    value = (names & np.uint64(15)).astype(np.int64)
    out = np.empty((len(names), 4), np.int8)
    scaled = lambda x: np.round(np.clip(x, -LIMIT, LIMIT) * SCALE).astype(np.int8)
    alone = head[size == 1]  # of slots with one value all that was seen agrees with it
    x = scaled(np.log((counts[alone] + np.float32(PRIOR)) / np.float32(PRIOR)))
    out[alone] = np.where(_SIDE.T[value[alone]] < 0, x[:, None], -x[:, None])
    head, size = head[size > 1], size[size > 1]
    own = np.repeat(np.arange(len(head)), size)
    at = np.repeat(head - np.cumsum(size) + size, size) + np.arange(len(own))
    dense = np.zeros((len(head), 16), np.float32)
    dense[own, value[at]] = counts[at]
    for level in range(4):
        parts = dense.reshape(-1, 1 << level, 2, 8 >> level).sum(axis=3)
        x = scaled(np.log((parts[:, :, 1] + np.float32(PRIOR)) / (parts[:, :, 0] + np.float32(PRIOR))))
        out[at, level] = x[own, value[at] >> (4 - level)]
    return out.view("<u4").ravel()


def start_weights() -> np.ndarray:
    """(context and bias, bit, gate); a prediction's unit is 1 / SCALE."""
    w = np.full((_K + 1, 4, GATES), 0.4 / SCALE, np.float32)
    w[-1] = 0
    return w


def bits_of(packed: np.ndarray) -> np.ndarray:
    """(4, n) predictions of packed log odds."""
    return np.ascontiguousarray(packed.view(np.int8).reshape(-1, 4).T).astype(np.float32)


def _cell(z: np.ndarray, gate: np.ndarray) -> np.ndarray:
    """Places in a refinement table (bit, gate, bucket), for each bit."""
    at = z * np.float32(2)
    np.clip(at, -16, 16, out=at)
    at += np.float32(16.5)
    cell = at.astype(np.int64)
    cell += gate.astype(np.int64) * BUCKETS
    for j in range(1, 4):
        cell[j] += j * BUCKETS * GATES
    return cell


def learn(st: list[np.ndarray], values: np.ndarray, gates: np.ndarray, w: np.ndarray, squares: np.ndarray, apm: np.ndarray, calibrate: bool) -> None:
    """One online pass over nibbles with packed predictions st by context, a step of Adagrad on the weights after every 32 K nibbles; or, to calibrate, no steps but counts of predicted against seen bits in apm (2, bit, gate, bucket)."""
    for a in range(0, len(values), 32_768):
        part, gate = [bits_of(x[a : a + 32_768]) for x in st], gates[a : a + 32_768]
        bit = (1 - _SIDE.take(values[a : a + 32_768], axis=1)) / 2
        z = w[_K].take(gate, axis=1)
        for k in range(_K):
            z += part[k] * w[k].take(gate, axis=1)
        if calibrate:
            cell = _cell(z, gate).ravel()
            flat = apm.reshape(2, -1)
            flat[1] += np.bincount(cell, weights=bit.ravel(), minlength=flat.shape[1])
            flat[0] += np.bincount(cell, weights=1 - bit.ravel(), minlength=flat.shape[1])
            continue
        err = bit - _ONE / (_ONE + np.exp(-z))
        n = np.maximum(np.bincount(gate, minlength=GATES), 64)
        for k in range(_K + 1):
            scale = SCALE if k < _K else 1
            for j in range(4):
                grad = np.bincount(gate, weights=err[j] * part[k][j] if k < _K else err[j], minlength=GATES) / n / scale
                squares[k, j] += grad * grad
                w[k, j] += (0.1 * grad / np.sqrt(squares[k, j] + 1e-4) / scale).astype(np.float32)


def refinement(apm: np.ndarray) -> np.ndarray:
    """Log odds by (bit, gate, bucket), flat, from the counts (2, bit, gate, bucket); buckets seen little keep the prediction."""
    apm = apm.reshape(2, -1)
    p = 1 / (1 + np.exp(-np.tile((np.arange(BUCKETS) - 16) / 2.0, GATES * 4)))
    return np.log((apm[1] + 50 * p) / (apm[0] + 50 * (1 - p))).astype(np.float32)


def inside(st: list[np.ndarray], gate: np.ndarray, w: np.ndarray) -> np.ndarray:
    """What the contexts within words and the bias add up to at each nibble of distinct words: four float32, packed in a complex128."""
    out = np.empty((len(gate), 4), np.float32)
    for a in range(0, len(gate), 1 << 16):
        g = gate[a : a + (1 << 16)]
        z = w[_K].take(g, axis=1)
        for k in range(INSIDE):
            z += bits_of(st[k][a : a + (1 << 16)]) * w[k].take(g, axis=1)
        out[a : a + (1 << 16)] = z.T
    return out.view(np.complex128).ravel()


def _run(within, across, gate, values, w, apm, own, bounds, goes_on) -> tuple[np.ndarray, np.ndarray]:
    """(logarithms of the nibbles' probabilities, the gradient by each document's own numbers); a document's nibbles lie between its bounds."""
    size = np.diff(bounds)
    within = np.ascontiguousarray(within.view(np.float32).reshape(-1, 4).T)
    across = bits_of(across)
    across *= w[ACROSS].take(gate, axis=1)
    if own is None:
        z, share = within + across, np.float32(0.5)
    else:
        a, b, c, share = (np.repeat(x, size) for x in own.T)
        z = within * a
        z += across * b
        z += c
    more = apm.take(_cell(z, gate))
    more -= z
    side = _SIDE.take(values, axis=1)
    e = (more * share + z) * side
    np.minimum(e, np.float32(60), out=e)
    np.exp(e, out=e)
    total = e + _ONE
    loss = np.log(total).sum(axis=0)
    if not goes_on:
        return -loss, None
    e /= total
    e *= side
    grads = [np.einsum("jn,jn->n", e, x) for x in (within, across)] + [e.sum(axis=0), np.einsum("jn,jn->n", e, more)]
    return -loss, -np.stack([np.add.reduceat(g, bounds[:-1]) for g in grads], axis=1)


def nibble_scores(coded: Coded, within: np.ndarray, across: np.ndarray, gate: np.ndarray, w: np.ndarray, apm: np.ndarray, adapts: bool = True, of: np.ndarray | None = None) -> np.ndarray:
    """Natural logarithm of the probability of each nibble; every document starts from the same weights and adapts its own.

    within: the sums of the contexts within words, packed as by ``inside``; across: packed log odds of the context across words;
    of: where each nibble stands in within and gate, if these are those of distinct words.
    """
    starts, docs = coded.starts, len(coded.starts) - 1
    size, out = np.diff(starts), np.zeros(len(across), np.float32)
    own = np.tile(np.array([1, 1, 0, 0.5], np.float32), (docs, 1))
    rates = np.array(RATES, np.float32)
    lo = 0
    while len(live := np.flatnonzero(size > lo)):
        hi = lo + stride(lo) if adapts else int(size.max())
        for goes_on in (False, True):
            who = live[(size[live] > hi) == goes_on]
            if not len(who):
                continue
            a, b = coded.nibble[starts[who] + lo], coded.nibble[starts[who] + np.minimum(size[who], hi)]
            n = b - a
            bounds = np.concatenate([[0], np.cumsum(n)])
            at = np.repeat(a - bounds[:-1], n) + np.arange(bounds[-1])
            mine = at if of is None else of.take(at)
            out[at], grad = _run(within.take(mine), across.take(at), gate.take(mine), coded.values.take(at), w, apm, own[who] if lo else None, bounds, goes_on)
            if goes_on:
                mine = own[who] + rates * grad / np.sqrt(n)[:, None]
                mine[:, 3] = np.clip(mine[:, 3], 0, 1)
                own[who] = mine
        lo = hi
    return out


SHARES = (0.02, 0.25, 0.7)
KINDS_BEFORE = 4


def score(coded: Coded, nibbles: np.ndarray, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """log10 of each document's probability from its nibbles' logarithms. known: for each word and end, the logarithm of its unigram
    probability, -inf if it has none; counts: how often training has it. The kind of the word before is by its count: 0, under 16, under 1024, more."""
    bits = np.add.reduceat(nibbles, coded.heads, dtype=np.float64)
    docs = len(coded.starts) - 1
    first = np.searchsorted(coded.heads, coded.nibble[coded.starts[:-1]])
    kind = np.concatenate([[0], np.searchsorted([1, 16, 1024], counts[:-1], side="right")]).astype(np.int64)
    kind[first] = KINDS_BEFORE - 1
    cell = np.repeat(np.arange(docs), np.diff(np.concatenate([first, [len(bits)]]))) * KINDS_BEFORE + kind
    gain = np.exp(np.clip(known - bits, -700, 700))  # of the unigram over the bits; the mean is bits + log(share * gain + 1 - share)
    total = np.bincount(cell, weights=bits, minlength=docs * KINDS_BEFORE)
    more = np.stack([np.bincount(cell, weights=np.log(s * gain + (1 - s)), minlength=docs * KINDS_BEFORE) for s in SHARES])
    total += np.logaddexp.reduce(more, axis=0) - np.log(len(SHARES))
    return total.reshape(docs, KINDS_BEFORE).sum(axis=1) / np.log(10)
