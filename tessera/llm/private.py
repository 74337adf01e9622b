"""Personal data: fixed patterns and a skip-chain conditional random field.

The patterns give the base spans. The field labels every word of a document (outside the base spans a label
adds a span). Unaries come from the form of a word, its neighbours' and the last cue among the three words before;
chain potentials join neighbouring words. Occurrences of one word (equal letters and digits, whatever the
punctuation) that carry evidence of their own are joined by skip potentials: the one with the clearest context is the
hub, and each other one has a link to it that rewards a common entity label, by what the hub shows (a form of its own or
a cue; with neither there is no link) and the word's length. Loopy messages run over chains and links until they settle: exact
forward and backward sweeps along the chains, then messages over the links, of which the hub takes the mean, so
that neither a crowd of unclear occurrences outvotes a clear one nor many repeats of a plain number make it an
entity. The step shrinks from round to round, so the messages end without a bound on the rounds.

Chain weights are learned by maximum likelihood on generated, labelled sentences, the skip weights by pseudo-likelihood
on generated documents that repeat their entities and their plain numbers.

No word is left out. A run of plain words (no form, no cue near) has the same potentials at every word, so messages
along it tend to a fixed one, at a rate that is computed with the model (``Field.reach`` words bring any
message within 1e-9 of it); farther into a run than that, the fixed message takes the place of the sweep.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import crf

KINDS = ("email", "ip", "card", "phone")
#: Labels of the field. Label 0 is outside.
LABELS = ("", "email", "ip", "card", "phone", "secret", "iban", "ssn")
#: The probability of a label from which a word is marked, and the change of messages at which they have settled.
LEAST_P, SETTLED = 0.6, 1e-6

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern matches that hold, sorted; kind indexes KINDS."""
    out = []
    if "@" in text:
        done, at = 0, 0
        for m in _AT.finditer(text):
            k = m.start()
            before = text[max(done, text.rfind("@", at, k) + 1) : k]
            at = k
            start = k - (len(before) - len(before.rstrip(_LOCAL)))
            if start < k:
                out.append((start, 0, m.end()))
                done = m.end()
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") for p in m.group().split(".")]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() <= 38:
                digits = _NOT_DIGIT.sub("", m.group())
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


# --- the field -----------------------------------------------------------------------------------

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_STRIP = ".,;:!?()[]{}<>\"'"
#: What every word with a form of its own has; a word without it that is no cue is plain.
_FORM = re.compile(r"[0-9@=]|[A-Z]{12}|gh[pousr]_|sk-|xox[abp]-|[a-f]{32}|[A-F]{32}")
#: Words that announce a kind, in the languages of the corpus.
CUES = {
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "teléfono", "téléphone", "anruf", "llame", "appelez", "whatsapp"),
    "email": ("email", "mail", "e-mail", "contact", "correo", "courriel", "write"),
    "card": ("card", "visa", "mastercard", "karte", "tarjeta", "carte", "amex"),
    "ip": ("ip", "host", "server", "address", "login"),
    "secret": ("password", "passwd", "token", "secret", "api_key", "apikey", "key", "passwort", "contraseña", "clave", "pwd"),
    "iban": ("iban", "account", "konto", "cuenta", "compte"),
    "ssn": ("ssn", "social", "sozialversicherungsnummer", "nss"),
}
_CUE = {w: k for k, ws in CUES.items() for w in ws}
PLAIN = ("no_digit",)


def shape(word: str) -> tuple[str, ...]:
    """Features of a word alone."""
    core = word.strip(_STRIP)
    cue = _CUE.get(core.lower())
    if cue is None and not _FORM.search(word):
        return PLAIN
    digits = sum(c.isascii() and c.isdigit() for c in core)
    out = []
    if not digits:
        out.append("no_digit")
    if cue:
        out.append(f"is_cue_{cue}" + (":" if word.rstrip("\"'").endswith((":", "=")) else ""))
    if core in ("=", ":="):
        out.append("assigns")
    head, _, tail = core.partition("=")
    if tail and head.lower().strip() in CUES["secret"] and len(tail) >= 8:
        out.append("assigned_secret")
    if "@" in core:
        out.append("at_sign" if re.fullmatch(r"[^@]+@[^@]+\.[^@.]+", core) else "bare_at")
    if re.fullmatch(r"(AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9]{20,}|xox[abp]-[A-Za-z0-9-]{10,}", core):
        out.append("key_form")
    if re.fullmatch(r"[0-9a-f]{32,}|[0-9A-F]{32,}", core):
        out.append("long_hex")
    if re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", core):
        out.append("iban_form")
    if digits:
        plain = re.sub(r"[-./()]", "", core)
        if plain.isdigit():
            out.append(f"digits_{digits if digits in (3, 4, 7, 8, 9, 10, 11, 12) else 'many' if digits > 12 else 'few'}")
            if re.fullmatch(r"\(?[0-9]{3}\)?[-.][0-9]{3}[-.][0-9]{4}", core):
                out.append("phone_form")
            if re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", core):
                out.append("ssn_form")
            if re.fullmatch(r"[0-9]{3}[-.][0-9]{4}", core):
                out.append("short_phone_form")
            if re.fullmatch(r"\([0-9]{2,4}\)", word.rstrip(",.;:")):
                out.append("area_code")
            if 14 <= digits <= 19 and luhn(plain):
                out.append("luhn")
            if re.fullmatch(r"([0-9]{1,3}\.){3}[0-9]{1,3}", core):
                out.append("dotted_quad")
        else:
            out.append("mixed")
    return tuple(out)


SURE = {"assigned_secret", "at_sign", "key_form", "long_hex", "iban_form", "phone_form", "ssn_form", "luhn", "dotted_quad"}


def _said(own: tuple[str, ...]) -> str | None:
    """The cue that a form is, if it is one."""
    return next((x[7:] for x in own if x.startswith("is_cue_")), None)


def _own_features(own: tuple[str, ...]) -> list[str]:
    return ["bias", *own]


def _side_features(own: tuple[str, ...], side: str) -> list[str]:
    return [f"{side}_{x}" for x in own if x != "no_digit"]


def _cue_features(own: tuple[str, ...], cue: str) -> list[str]:
    return [f"cue_{cue}", *(f"cue_{cue}+{x}" for x in own)]


def features(words: list[str], k: int) -> list[str]:
    """Features of word k: its own, its neighbours' and the last cue among the three words before it."""
    own = shape(words[k])
    out = _own_features(own)
    if cue := next((c for j in range(k - 1, max(-1, k - 4), -1) if (c := _said(shape(words[j])))), None):
        out += _cue_features(own, cue)
    if k:
        out += _side_features(shape(words[k - 1]), "before")
    if k + 1 < len(words):
        out += _side_features(shape(words[k + 1]), "after")
    return out


class _Made:
    """Generated words, numbers and entities."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def digits(self, k: int) -> str:
        return "".join(self.rng.choice("0123456789") for _ in range(k))

    def letters(self, k: int) -> str:
        return "".join(self.rng.choice("abcdefghilmnoprstuv") for _ in range(k))

    def plain(self) -> str:
        return self.letters(self.rng.randint(1, 9)) + self.rng.choice(["", "", "", ".", ","])

    def number(self) -> str:
        d = self.digits
        return self.rng.choice([d(1), d(2), d(3), "19" + d(2), "20" + d(2), f"{d(1)}.{d(1)}", f"{d(2)}%", d(5), d(6), f"{d(1)},{d(3)}", d(7), d(8), d(10), f"{d(2)}/{d(2)}/{d(4)}", f"v{d(1)}.{d(1)}.{d(1)}", d(14), d(16), f"{d(3)}-{d(4)}", self.letters(3) + d(3)])

    def entity(self, kind: str) -> tuple[list[str], float]:
        """(words, how often a cue comes before them)."""
        d, letters, choice = self.digits, self.letters, self.rng.choice
        if kind == "email":
            return [letters(5) + choice(["", "."]) + d(2) + "@" + letters(5) + "." + choice(["com", "org", "de"])], 0.3
        if kind == "ip":
            return [".".join(str(self.rng.randint(1, 255)) for _ in range(4))], 0.3
        if kind == "card":
            body = "4" + d(14)
            return [next(body + c for c in "0123456789" if luhn(body + c))], 0.3
        if kind == "secret":
            return choice([([f"password={letters(4)}{d(6)}"], 0.4), ([choice(["AKIA", "ASIA"]) + "".join(choice(choice(["ABCDEFGHJKMN2345", "ABCDEFGH"])) for _ in range(16))], 0.4), ([choice(["ghp_", "gho_"]) + letters(34)], 0.3), (["sk-" + letters(24)], 0.3), (["xoxb-" + letters(14)], 0.3), ([f"token={letters(6)}{d(9)}"], 0.4), (["".join(choice("0123456789abcdef") for _ in range(40))], 0.4), ([letters(6)], 2.0), ([letters(4) + d(2)], 2.0)])
        if kind == "iban":
            return choice([(["DE" + d(20)], 0.5), ([d(9)], 2.0)])
        if kind == "ssn":
            return choice([([f"{d(3)}-{d(2)}-{d(4)}"], 0.7), ([d(9)], 2.0)])
        return choice([([f"{d(3)}-{d(3)}-{d(4)}"], 0.5), ([f"({d(3)})", f"{d(3)}-{d(4)}"], 0.5), ([f"{d(3)}-{d(4)}"], 1.0), ([d(10)], 1.0), ([f"({d(3)}){d(3)}-{d(4)}"], 0.5)])

    def cue(self, kind: str, sure: bool) -> list[str]:
        word = self.rng.choice(CUES[kind])
        return [word + ":"] if sure or self.rng.random() < 0.5 else self.rng.choice([[word], [word, "="]])

    def filling(self) -> tuple[list[str], list[int]]:
        roll = self.rng.random()
        if roll < 0.74:
            return [self.plain()], [0]
        if roll < 0.95:
            return [self.number()], [0]
        return [self.rng.choice([w for ws in CUES.values() for w in ws]), self.plain()], [0, 0]

    def marked(self, kind: str) -> tuple[list[str], list[int], list[str]]:
        """(words, labels, the entity's words) with or without a cue."""
        parts, often = self.entity(kind)
        words = self.cue(kind, often > 1) if self.rng.random() < often else []
        if words and often <= 1 and self.rng.random() < 0.3:
            words.append(self.plain())
        labels = [0] * len(words) + [LABELS.index(kind)] * len(parts)
        return [*words, *parts[:-1], parts[-1] + self.rng.choice(["", "", ".", ","])], labels, parts


def sentences(n: int = 1500, seed: int = 5) -> list[tuple[list[str], list[int]]]:
    """Generated training sentences with labels: plain words and numbers around marked entities."""
    made, out = _Made(seed), []
    for _ in range(n):
        words, labels = [], []
        for _ in range(made.rng.randint(3, 9)):
            w, y = made.filling() if made.rng.random() < 0.82 else made.marked(made.rng.choice(LABELS[1:]))[:2]
            words += w
            labels += y
        out.append((words, labels))
    return out


def repeating(n: int = 400, seed: int = 8) -> list[tuple[list[str], list[int]]]:
    """Generated documents that repeat an entity without its cue, or a plain number; now and then an equal short number is no entity."""
    made, out = _Made(seed), []
    for _ in range(n):
        words, labels = [], []
        kind = made.rng.choice(LABELS[1:])
        first, y, parts = made.marked(kind) if made.rng.random() < 0.7 else (lambda x: ([x], [0], [x]))(made.number())
        again = [(first, y)] + [(parts, y[-len(parts) :]) for _ in range(made.rng.randint(1, 6))]
        made.rng.shuffle(again)
        for w, y in again:
            if len(w[-1]) < 5 and made.rng.random() < 0.3:
                y = [0] * len(w)
            for _ in range(made.rng.randint(4, 9)):
                x, z = made.filling()
                words += x
                labels += z
            words += w
            labels += y
        out.append((words, labels))
    return out


def _class_of(word: str) -> str:
    """What makes two words similar: their letters and digits."""
    return re.sub(r"[^0-9a-z@]", "", word.lower())


class Field:
    """The field over the words of documents, many at a time."""

    def __init__(self, weights: dict[str, np.ndarray], chain: np.ndarray, skip: np.ndarray):
        """skip: weights of a link by what its hub shows (a form, a cue), for words under 6 letters and digits, then for longer ones."""
        self.weights, self.skip = weights, skip
        self.trans = np.exp(chain - chain.max())
        self._new()
        m = len(LABELS)
        step = self.trans * np.exp(self._plain_unary())[None, :]
        self.ahead, n1 = self._fixed(lambda f: f @ step)  # before the first word that is looked at
        self.back, n2 = self._fixed(lambda b: b @ step.T)  # after the last one
        self.reach = max(n1, n2) + 4
        belief = self.ahead * (self.trans @ (np.exp(self._plain_unary()) * self.back))
        if belief.argmax() or belief[0] < 0.9 * belief.sum():
            raise ValueError("a plain word far from any other must be outside")
        self.zero = np.zeros(m)

    def __reduce__(self):
        return Field._load, (self.weights, self.trans, self.skip)

    @staticmethod
    def _load(weights, trans, skip) -> Field:
        return Field(weights, np.log(trans), skip)

    def _new(self) -> None:
        self.ids: dict[str, int] = {}
        self.shapes: dict[tuple, int] = {}
        self.rows: list[tuple] = []
        self.cues = sorted({c + x for c in CUES for x in ("", ":")})
        self._tables = None
        self._number(PLAIN)

    def _plain_unary(self) -> np.ndarray:
        return sum(self.weights.get(f, np.zeros(len(LABELS))) for f in _own_features(PLAIN))

    @staticmethod
    def _fixed(step) -> tuple[np.ndarray, int]:
        """The message to which all tend, and after how many words any start is within 1e-9 of it."""
        m = len(LABELS)
        x, n = np.eye(m), 0
        while np.ptp(x, axis=0).max() > 1e-9:
            x = step(x)
            x /= x.sum(axis=1, keepdims=True)
            n += 1
        return x[0], n

    def _number(self, own: tuple) -> int:
        if own not in self.shapes:
            self.shapes[own] = len(self.rows)
            self.rows.append(own)
            self._tables = None
        return self.shapes[own]

    def numbers(self, words: list[str]) -> np.ndarray:
        """The forms of words as numbers; 0 is plain."""
        known = self.ids
        try:
            return np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        except KeyError:
            if len(known) > 1 << 18:
                known.clear()
            for w in set(words).difference(known):
                known[w] = self._number(shape(w))
            return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def tables(self):
        """(own, before, after, cue by form, the cue that a form is) unaries by form."""
        if self._tables is None:
            total = lambda fs: sum((self.weights[f] for f in fs if f in self.weights), np.zeros(len(LABELS)))
            own = np.stack([total(_own_features(r)) for r in self.rows])
            before, after = (np.stack([total(_side_features(r, side)) for r in self.rows]) for side in ("before", "after"))
            cue = np.stack([np.zeros_like(own), *[np.stack([total(_cue_features(r, c)) for r in self.rows]) for c in self.cues]])
            said = np.array([self.cues.index(_said(r)) + 1 if _said(r) else 0 for r in self.rows])
            self._tables = own, before, after, cue, said
        return self._tables

    def unaries(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(unaries, cue before) of a document's words, or of a part that begins three words before what is asked of it."""
        own, before, after, cue, said = self.tables()
        at = np.zeros(len(ids), np.int64)
        for k in (3, 2, 1):  # the nearest one counts
            back = said[ids[:-k]]
            at[k:] = np.where(back > 0, back, at[k:])
        u = own[ids] + cue[at, ids]
        u[1:] += before[ids[:-1]]
        u[:-1] += after[ids[1:]]
        return u, at

    def segments(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """The parts of a document around the words that aren't plain, ``reach`` words to either side."""
        live = np.flatnonzero(ids)
        if not len(live):
            return []
        cut = np.flatnonzero(np.diff(live) > 2 * self.reach) + 1
        return [(max(0, int(x[0]) - self.reach), min(len(ids), int(x[-1]) + self.reach + 1)) for x in np.split(live, cut)]

    def beliefs(self, u: np.ndarray, starts: np.ndarray, open_left: np.ndarray, open_right: np.ndarray, hub: np.ndarray, leaf: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Label probabilities of words in chains that begin at ``starts``; open ends go on in plain words; links from hub to leaf words."""
        m, n = len(LABELS), len(u)
        base = np.exp(u - u.max(axis=1, keepdims=True))
        gain = np.exp(weight)[:, None] - 1
        to_leaf, to_hub = np.ones((len(hub), m)), np.ones((len(hub), m))
        share = 1 / np.maximum(np.bincount(hub, minlength=n), 1)[hub][:, None] if len(hub) else np.ones((0, 1))
        size = np.diff(np.append(starts, n))
        by = np.argsort(-size, kind="stable")
        starts, size, open_left, open_right = starts[by], size[by], open_left[by], open_right[by]
        lengths = size.max(initial=0)
        active = [int(np.searchsorted(-size, -k, side="left")) for k in range(lengths)]  # chains longer than k
        ends = starts + size - 1
        ahead0 = np.where(open_left[:, None], self.ahead @ self.trans, 1.0)
        step = np.exp(self._plain_unary())
        back0 = np.where(open_right[:, None], self.trans @ (step * self.back), 1.0)
        turn = 0
        while True:
            node = base.copy()
            if len(hub):
                with np.errstate(divide="ignore"):
                    extra = np.zeros((n, m))
                    np.add.at(extra, leaf, np.log(to_leaf))
                    np.add.at(extra, hub, share * np.log(to_hub))
                node *= np.exp(extra - extra.max(axis=1, keepdims=True))
            left, right = np.empty((n, m)), np.empty((n, m))
            f, b = ahead0.copy(), back0.copy()
            for k in range(lengths):
                j = active[k]
                at = starts[:j] + k
                left[at] = f[:j]
                f = (f[:j] * node[at]) @ self.trans
                f /= f.sum(axis=1, keepdims=True)
                at = ends[:j] - k
                right[at] = b[:j]
                b = (b[:j] * node[at]) @ self.trans.T
                b /= b.sum(axis=1, keepdims=True)
            belief = left * node * right
            belief /= belief.sum(axis=1, keepdims=True)
            if not len(hub):
                return belief
            if turn and moved < SETTLED:
                return belief
            new = []
            for src, own in ((hub, to_hub**share), (leaf, to_leaf)):
                cavity = belief[src] / own
                cavity /= cavity.sum(axis=1, keepdims=True)
                msg = 1 + gain * cavity
                msg[:, 0] = 1.0
                new.append(msg / msg.sum(axis=1, keepdims=True))
            rate = 1.0 if turn < 8 else 8 / turn
            nexts = [np.exp((1 - rate) * np.log(old / old.sum(axis=1, keepdims=True)) + rate * np.log(msg)) for old, msg in ((to_leaf, new[0]), (to_hub, new[1]))]
            moved = max(np.abs(np.log(x / x.sum(axis=1, keepdims=True)) - np.log(old / old.sum(axis=1, keepdims=True))).max() for x, old in zip(nexts, (to_leaf, to_hub)))
            to_leaf, to_hub = nexts
            turn += 1

    def links(self, words: list[str], ids: np.ndarray, u: np.ndarray, cue: np.ndarray) -> list[tuple[int, int, int]]:
        """(hub, leaf, kind of link) of a document's words (of those whose form isn't plain, u and cue of these words by place)."""
        groups: dict[str, list[int]] = {}
        for k in np.flatnonzero(ids).tolist():
            own = self.rows[ids[k]]
            if _said(own) is None and own != ("no_digit", "assigns") and (c := _class_of(words[k])):
                groups.setdefault(c, []).append(k)
        out = []
        for c, at in groups.items():
            if len(at) > 1:
                odds = u[at, 1:].max(axis=1) - u[at, 0]
                h = at[int(odds.argmax())]
                if cue[h] or SURE & set(self.rows[ids[h]]):
                    out += [(h, k, int(cue[h] > 0) + 2 * (len(c) >= 6)) for k in at if k != h]
        return out

    def spans(self, texts: list[str]) -> list[list[tuple[int, str, int]]]:
        """Of each text (start, label, end) of the words that the field puts inside an entity; neighbours of one label are one span."""
        found, us, starts, opens, links = [], [], [], [], []
        n = 0
        for t in texts:
            ids = self.numbers(words := _WORD.findall(t))
            parts = self.segments(ids)
            found.append(parts and (ids, parts, n))
            if not parts:
                continue
            place = np.full(len(ids), -1)
            unary, cue = np.zeros((len(ids), len(LABELS))), np.zeros(len(ids), np.int64)
            for a, b in parts:
                lo, hi = max(0, a - 3), min(len(ids), b + 1)
                x, y = self.unaries(ids[lo:hi])
                unary[a:b], cue[a:b] = x[a - lo : b - lo], y[a - lo : b - lo]
                place[a:b] = np.arange(n, n + b - a)
                starts.append(n)
                opens.append((a > 0, b < len(ids)))
                us.append(unary[a:b])
                n += b - a
            links += [(place[h], place[k], kind) for h, k, kind in self.links(words, ids, unary, cue)]
        if not n:
            return [[] for _ in texts]
        hub, leaf, kind = np.array(links, np.int64).reshape(-1, 3).T
        left, right = np.array(opens).T
        belief = self.beliefs(np.concatenate(us), np.array(starts), left, right, hub, leaf, self.skip[kind])
        best = belief.argmax(axis=1)
        sure = (best > 0) & (belief[np.arange(n), best] >= LEAST_P)
        return [self._marked(t, f, best, sure) if f else [] for t, f in zip(texts, found)]

    def _marked(self, text: str, found, best: np.ndarray, sure: np.ndarray) -> list[tuple[int, str, int]]:
        ids, parts, n = found
        label: dict[int, int] = {}
        for a, b in parts:
            for k in np.flatnonzero(sure[n : n + b - a]).tolist():
                label[a + k] = int(best[n + k])
            n += b - a
        out: list[tuple[int, str, int]] = []
        before = -2
        if label:
            for k, m in enumerate(itertools.islice(_WORD.finditer(text), max(label) + 1)):
                if k not in label:
                    continue
                name, word = LABELS[label[k]], m.group()
                lead = len(word) - len(word.lstrip(_STRIP.replace("(", "")))
                trail = len(word) - len(word.rstrip(_STRIP.replace(")", "")))
                if lead + trail >= len(word):
                    continue
                if before == k - 1 and out and out[-1][1] == name:
                    out[-1] = (out[-1][0], name, m.end() - trail)
                else:
                    out.append((m.start() + lead, name, m.end() - trail))
                before = k
        return out


def skip_weights(weights: dict[str, np.ndarray], chain: np.ndarray, rounds: int = 200, decay: float = 1e-3) -> np.ndarray:
    """Weights of the kinds of links, by gradient ascent on the pseudo-likelihood of the repeating documents' linked words."""
    kinds_of_links = 4
    field = Field(weights, chain, np.zeros(kinds_of_links))
    rows, other, kinds, truth = [], [], [], []
    for words, labels in repeating():
        ids = field.numbers(words)
        u, cue = field.unaries(ids)
        for h, k, kind in field.links(words, ids, u, cue):
            score = u[k].copy()
            if k:
                score += chain[labels[k - 1]]
            if k + 1 < len(words):
                score += chain[:, labels[k + 1]]
            rows.append(score)
            other.append(labels[h])
            kinds.append(kind)
            truth.append(labels[k])
    u, other, kinds, truth = np.array(rows), np.array(other), np.array(kinds), np.array(truth)
    inside = other > 0
    u, other, kinds, truth = u[inside], other[inside], kinds[inside], truth[inside]
    at, w = np.arange(len(u)), np.zeros(kinds_of_links)
    n = np.maximum(np.bincount(kinds, minlength=kinds_of_links), 1)
    for _ in range(rounds):
        z = u.copy()
        z[at, other] += w[kinds]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p = (p / p.sum(axis=1, keepdims=True))[at, other]
        grad = np.bincount(kinds, weights=(truth == other) - p, minlength=kinds_of_links) / n - decay * w
        curve = np.bincount(kinds, weights=p * (1 - p), minlength=kinds_of_links) / n + decay
        w = np.maximum(w + np.clip(grad / curve, -1, 1), 0.0)
    return w


@functools.cache
def model() -> Field:
    """The field with its weights, learned from the generated sentences and documents."""
    data = [([features(words, k) for k in range(len(words))], labels) for words, labels in sentences()]
    weights, chain = crf.train(data, len(LABELS))
    return Field(weights, chain, skip_weights(weights, chain))


def spans_of(texts: list[str], field: Field) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text as (start, kind, end); a span of the field that touches a base one is not added."""
    out = []
    for text, found in zip(texts, field.spans(texts)):
        base = base_spans(text)
        starts, most = [b[0] for b in base], list(itertools.accumulate((b[2] for b in base), max))
        own = []
        for s, kind, e in found:
            k = bisect.bisect_left(starts, e)  # base spans that begin before the end
            if not k or most[k - 1] <= s:
                own.append((s, kind, e))
        every = sorted([(s, KINDS[k], e) for s, k, e in base] + own, key=lambda x: (x[0], _ORDER[x[1]], x[2]))
        out.append((base, every))
    return out


_ORDER = {k: i for i, k in enumerate((*KINDS, *LABELS[5:]))}
#: Characters of texts that are labelled together; it bounds memory and decides nothing.
TOGETHER = 4 << 20


def _batches(texts):
    """Lists of texts of about TOGETHER characters; null counts as empty."""
    held, size = [], 0
    for t in texts:
        held.append(t or "")
        size += len(held[-1])
        if size >= TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


def _digest(field: Field):
    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    def run(text: pd.Series) -> pd.DataFrame:
        out = []
        for base, every in itertools.chain.from_iterable(spans_of(ts, field) for ts in _batches(text)):
            said = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base)
            out.append((*(sum(b[1] == k for b in base) for k in range(4)), hashlib.sha256(said.encode()).hexdigest(), ",".join(f"{k}:{s}:{e}" for s, k, e in every)))
        return pd.DataFrame(out, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return run


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Null texts count as empty: no spans, the hash of the empty string. Spans are code points, end exclusive.
    Each text is labelled by itself, so repeated rows give repeated rows; of two equally clear occurrences of a word the
    first is the hub. Very long texts are read whole, in time in proportion to their length. Other columns are not read;
    an empty table gives no rows.
    """
    digest = _digest(model())
    return docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("d")).select("doc_id", "d.*")


def _masker(field: Field):
    @F.pandas_udf("string")
    def run(text: pd.Series) -> pd.Series:
        out = []
        found = itertools.chain.from_iterable(spans_of(ts, field) for ts in _batches(text))
        for t, (_, every) in zip(text, found):
            parts, at = [], 0
            for s, kind, e in every:
                if s >= at:
                    parts += [t[at:s], f"[{kind.upper()}]"]
                at = max(at, e)
            out.append("".join([*parts, t[at:]]) if parts else t)
        return pd.Series(out, dtype=object)

    return run


def masked(text: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans become one mark."""
    return _masker(model())(text)


def redact(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """All rows and columns of ``docs`` with masked texts and, where the column exists, their new lengths. Null stays null."""
    out = docs.withColumn(text_col, masked(F.col(text_col)))
    if chars_col in docs.columns:
        kind = docs.schema[chars_col].dataType
        out = out.withColumn(chars_col, F.when(F.col(chars_col).isNotNull(), F.length(text_col)).cast(kind))
    return out


def query(spark, sf_dir: str) -> DataFrame:
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
