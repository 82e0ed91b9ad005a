"""Personal data: exact base patterns plus a linear-chain conditional random field.

Base spans come from four fixed patterns.  A linear-chain CRF over word shapes adds spans the
patterns miss (spelled-out addresses, phone numbers without a plus sign, keys and tokens, ...).
It is trained by full-batch gradient ascent on a small labelled table and decoded by Viterbi in
numpy batches over the whole texts.

Every word of every text is scored and decoded.  Words that are O on every best path, by a bound over all
labels around them, cut a text into chains between two O; those chains of many texts have any length and are
decoded together, in batches of bounded cells, so the labels are those of one Viterbi pass over the text.

Words are runs of bytes that are no ASCII white space.  Spans are in code points, ends exclusive.
Base spans always stay; a CRF span that touches a base span is left out.

Defined results: a null text counts as empty (no spans); repeated rows each get a row; an empty
table gives an empty result; columns that are not carried are not read, carried ones may have
any name but text, base and added; texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesops as B
from .common import table

# The base patterns.
EMAIL_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # begun at a run of digits only: later begins in it fail too
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
BASE_KINDS = ("email", "ip", "card", "phone")
#: Kinds of spans in the order that spans of one start are listed in.
KINDS = (*BASE_KINDS, "secret")
#: Words before and after the entity of a labelled row, at most.
CONTEXT = 3
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def octet(digits: str) -> bool:
    rest = digits.lstrip("0")
    return len(rest) <= 3 and int(rest or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind): leftmost non-overlapping matches of each pattern; failing matches are dropped."""
    found: list[tuple[int, int, str]] = []
    if "@" in text:
        done = 0
        for m in EMAIL_AT.finditer(text):
            # the local part is the run of its characters before the sign, after the match before
            local = m.start()
            while local > done and LOCAL.match(text[local - 1]):
                local -= 1
            if local < m.start():
                found.append((local, m.end(), "email"))
                done = m.end()
    for m in IP.finditer(text):
        if all(octet(p) for p in m[0].split(".")):
            found.append((*m.span(), "ip"))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((*m.span(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                found.append((*m.span(), "phone"))
    return found


# --- the conditional random field ---------------------------------------------------------

#: Texts without any of these have no base span.
_BASE = re.compile(r"[0-9@]")
#: Telling words.
_TELLING = re.compile(r"[0-9@]|[\[(](?:at|dot)(?:[\])]|\Z)|\A(?:at|dot)[\])]|\A[\[(]\Z", re.I)
_TRIM_LEFT, _TRIM_RIGHT = "\"'<[{", "\"'>]},;:.!?#$%&*"
_RUNS = ((re.compile("[A-Z]+"), "A"), (re.compile("[a-z]+"), "a"), (re.compile("[0-9]+"), "0"), (re.compile("[^\\x00-\\x7F]+"), "u"))


# Words that stand beside personal data.
CUES = frozenset(("token", "key", "secret", "password", "api", "card", "visa", "phone", "tel", "call", "email", "mail", "ip", "at", "dot"))
_NO_HEX = re.compile("[g-z]")


def shape(word: str) -> str:
    """Word shape: runs of capitals, letters, digits and others as A, a, 0, u."""
    for pattern, to in _RUNS:
        word = pattern.sub(to, word)
    return word


def features(word: str) -> list[str]:
    digits = sum("0" <= c <= "9" for c in word)
    n = len(word)
    size = "1" if n == 1 else "2" if n == 2 else "3-5" if n < 6 else "6-11" if n < 12 else "12-19" if n < 20 else "20-31" if n < 32 else "32+"
    part = "no" if not digits else "all" if digits == n else "half" if digits * 2 >= n else "some"
    low = word.lower().strip("\"'<>[]{}(),;:.!?=")
    cue = low if low in CUES else ""
    hexa = bool(re.fullmatch("[\"']?[0-9a-f]{16,}[\"'.,;]?", word))
    caps = bool(re.fullmatch("[\"']?[A-Z0-9]{16,}[\"'.,;]?", word)) and 0 < digits < n
    bare = re.sub("[^0-9.-]", "", word)
    plain = bare.replace("-", "").replace(".", "")
    valid = "luhn" if 14 <= len(plain) <= 19 and luhn(plain) else "long" if len(plain) >= 14 else ""
    parts = bare.strip(".").split(".")
    if len(parts) == 4 and all(parts):
        valid = "ip" if all(octet(x) for x in parts) else "no ip"
    return [f"valid={valid}", f"shape={shape(word)}", f"size={size},{part}", f"cue={cue}", f"at={'@' in word}", f"dots={min(word.count('.'), 4)},{part}", f"hex={hexa}", f"caps={caps}", f"paren={'(' in word}{')' in word}{'+' in word}"]


class Crf:
    """emit: weights of every feature and label; move: of every pair of labels."""

    def __init__(self, vocab: dict[str, int], emit: np.ndarray, move: np.ndarray) -> None:
        self.vocab, self.emit, self.move = vocab, emit, move
        self.step = (move + LEGAL).astype(np.float32)
        self.before, self.after = self._sum(["-1:none"]), self._sum(["+1:none"])

    def _sum(self, feats: list[str]) -> np.ndarray:
        known = [self.vocab[f] for f in feats if f in self.vocab]
        return self.emit[known].sum(axis=0)

    def vectors(self, words: list[str]) -> np.ndarray:
        """[n, 4 L]: what each word adds to its own labels and to those of the word after, before and two after it."""
        out, known = np.zeros((len(words), 4, len(LABELS)), np.float32), {}
        for i, w in enumerate(words):
            # words of lower-case letters that are neither cues nor hexadecimal differ in size only
            plain = w.isascii() and w.isalpha() and w.islower() and w not in CUES and (len(w) < 16 or bool(_NO_HEX.search(w)))
            own = ("plain", min(len(w), 32)) if plain else tuple(features(w))
            row = known.get(own)
            if row is None:
                f = features(w)
                row = known[own] = self._sum([*f, "bias"]), self._sum([f"-1:{x}" for x in f[1:4]]), self._sum([f"+1:{x}" for x in f[1:4]]), self._sum([f"-2:{f[3]}"])
            out[i] = row
        return out.reshape(len(words), -1)

    def emissions(self, vectors: np.ndarray, cut: np.ndarray, place: np.ndarray, at: np.ndarray) -> np.ndarray:
        """[words, L] of stretches cut[i]..cut[i + 1] of words of texts; at the edge of a stretch inside a text neighbours are missing."""
        v = vectors.reshape(len(vectors), 4, len(LABELS))
        out = v[:, 0].copy()
        starts = np.zeros(len(v) + 1, bool)
        starts[cut] = True
        first, last = starts[:-1], starts[1:]
        out[1:][~first[1:]] += v[:-1, 1][~first[1:]]
        out[np.isin(place, at[:-1])] += self.before.astype(np.float32)
        out[:-1][~last[:-1]] += v[1:, 2][~last[:-1]]
        out[np.isin(place + 1, at[1:])] += self.after.astype(np.float32)
        two = ~first[2:] & ~first[1:-1]
        out[2:][two] += v[:-2, 3][two]
        return out

    def decode(self, telling: np.ndarray, at: np.ndarray, vectors) -> tuple[np.ndarray, np.ndarray]:
        """(places of words, their best labels) for all words near the telling ones; the others are O.

        The words of text i are at[i]..at[i + 1]; vectors(places) gives what those words add.
        """
        none = np.empty(0, np.int64)
        if not len(telling):
            return none, none
        text = np.searchsorted(at, telling, "right") - 1
        low, high = np.maximum(telling - CONTEXT, at[text]), np.minimum(telling + CONTEXT + 1, at[text + 1])
        cut = np.ones(len(low), bool)
        cut[1:] = (low[1:] > high[:-1]) | (text[1:] != text[:-1])  # chains that touch in a text are one
        first = np.flatnonzero(cut)
        text, begin, end = text[first], low[first], high[np.append(first[1:], len(cut)) - 1]
        heads, tails = begin == at[text], end == at[text + 1]
        # emissions look at the two words before and the one after; words of two chains are there twice
        size, wide = end - begin, np.maximum(begin - 2, at[text])
        many = np.minimum(end + 1, at[text + 1]) - wide
        place = B.ranges(wide, many)
        grid = self.emissions(vectors(place), np.concatenate(([0], np.cumsum(many))), place, at)
        start = np.concatenate(([0], np.cumsum(many)[:-1])) + begin - wide
        inner = B.ranges(start, size)
        return place[inner], self._chains(grid, start, size, heads, tails)[inner]

    def decode_all(self, at: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of words, their best labels) of whole texts; the words that are left out are O.

        The words of text i are at[i]..at[i + 1]; vectors has what every word adds.
        """
        n = len(vectors)
        if not n:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        grid = self.emissions(vectors, at, np.arange(n), at)
        open_ = ~self.surely_none(grid, at)
        starts = np.zeros(n + 1, bool)
        starts[at] = True
        place = np.flatnonzero(open_)
        if not len(place):
            return place, place
        first = np.append(True, (place[1:] != place[:-1] + 1) | starts[place[1:]])
        begin = place[first]
        size = np.diff(np.append(np.flatnonzero(first), len(place)))
        return place, self._chains(grid, begin, size, starts[begin], starts[begin + size])[place]

    def surely_none(self, grid: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Words that are O on every best path of their text.

        ahead[b] bounds how much better the best path up to a word is with label b there than with O, behind[b] how much better
        the best path after it goes on.  The first bounds hold whatever is around: O is put for b, and B for an I after it.
        Each round takes the bounds of the next word in, against a path that stays at O.
        """
        n, L, move = len(grid), len(LABELS), self.move.astype(np.float32)
        legal, inner = LEGAL == 0, np.array([x.startswith("I-") for x in LABELS])
        more = np.ascontiguousarray((grid - grid[:, :1]).T)
        edge = np.zeros(n + 1, bool)
        edge[at] = True
        head, tail = edge[:-1], edge[1:]
        begin = np.where(inner, -np.inf, 0).astype(np.float32)[:, None] + more
        behind, into = np.zeros((L, n), np.float32), np.zeros((L, 1), np.float32)
        for b in range(1, L):
            own = b - 1 if inner[b] else b  # B of its kind, I is the next
            into[b] = max(-np.inf if inner[b] else 0.0, (move[:, b] - move[:, 0])[legal[:, b]].max())
            then = move[b, own + 1] - move[0, own] + max(0.0, (move[own + 1] - move[own])[legal[own + 1]].max())
            behind[b, :-1] = np.maximum(max(0.0, (move[b] - move[0])[~inner].max()), then + more[own + 1, 1:] - more[own, 1:])
        behind[:, tail] = 0
        ahead = more + into
        ahead[0] = 0
        ahead[:, head] = begin[:, head]
        for _ in range(ROUNDS):
            last, gone = ahead, behind + more
            ahead, behind = np.empty_like(last), np.empty_like(last)
            ahead[0], behind[0] = 0, 0
            for b in range(1, L):
                ahead[b, 1:] = _highest(last[:, :-1], move[:, b], legal[:, b]) + (more[b, 1:] - move[0, 0])
                behind[b, :-1] = _highest(gone[:, 1:], move[b], legal[b]) - move[0, 0]
            ahead[:, head] = begin[:, head]
            behind[:, tail] = 0
        return (ahead[1:] + behind[1:]).max(axis=0) < -1e-2  # more than rounding

    def _chains(self, grid: np.ndarray, start: np.ndarray, size: np.ndarray, heads: np.ndarray, tails: np.ndarray) -> np.ndarray:
        """The best label of every row of grid that is in a chain start[i]..start[i] + size[i]; 0 elsewhere."""
        tags = np.zeros(len(grid), np.int64)
        order = np.argsort(size, kind="stable")
        i = 0
        while i < len(order):  # chains of alike length, so that little is padding
            least = size[order[i]]
            same = int(np.searchsorted(size[order], least * 5 // 4, "right"))
            j = min(same, i + max(1, VITERBI_CELLS // int(size[order[same - 1]])))
            some = order[i:j]
            found = self._best(grid, start[some], size[some], heads[some], tails[some])
            for t in range(found.shape[0]):
                rows = size[some] > t
                tags[start[some][rows] + t] = found[t, rows]
            i = j
        return tags

    def _best(self, grid: np.ndarray, begin: np.ndarray, size: np.ndarray, head: np.ndarray, tail: np.ndarray) -> np.ndarray:
        """[n, m] labels of chains; a chain inside a text stands between two O."""
        m, n, L = len(begin), int(size.max()), len(LABELS)
        at = np.minimum(begin + np.arange(n)[:, None], len(grid) - 1)
        best = np.where(head, START[:, None], self.step[0][:, None]).astype(np.float32) + grid[at[0]].T
        back = np.zeros((n, L, m), np.int8)
        out = np.where(tail, 0.0, self.step[:, 0][:, None]).astype(np.float32)
        end = np.where(size == 1, best + out, 0)
        for t in range(1, n):
            top, source = np.full((L, m), -np.inf, np.float32), back[t]
            for k in range(L):
                ahead = best[k] + self.step[k][:, None]
                better = ahead > top
                top[better] = ahead[better]
                source[better] = k
            best = top + grid[at[t]].T
            ends = size == t + 1
            end[:, ends] = (best + out)[:, ends]
        tag, found = end.argmax(axis=0), np.zeros((n, m), np.int64)
        for t in range(n - 1, -1, -1):
            found[t] = np.where(t < size, tag, 0)
            tag = np.where(t < size, back[t, tag, np.arange(m)], tag)
        return found


def _highest(rows: np.ndarray, add: np.ndarray, which: np.ndarray) -> np.ndarray:
    out = None
    for k in np.flatnonzero(which).tolist():
        x = rows[k] + add[k]
        out = x if out is None else np.maximum(out, x, out=out)
    return out


def windowed(words: list[str]) -> list[list[str]]:
    """Features of each word, and the cues, shapes and sizes next to it."""
    own = [features(w) for w in words]
    out = []
    for i in range(len(words)):
        f = [*own[i], "bias"]
        f += [f"-1:{x}" for x in own[i - 1][1:4]] if i else ["-1:none"]
        f += [f"+1:{x}" for x in own[i + 1][1:4]] if i + 1 < len(words) else ["+1:none"]
        if i > 1:
            f.append(f"-2:{own[i - 2][3]}")
        out.append(f)
    return out


#: A continuing label follows its own kind only.
LEGAL = np.array([[0.0 if not b.startswith("I-") or a[2:] == b[2:] and a != "O" else -1e9 for b in LABELS] for a in LABELS])
START = np.array([-1e9 if b.startswith("I-") else 0.0 for b in LABELS])


def labelled_rows(n: int = 700, seed: int = 7, bare: int = 0) -> list[tuple[list[str], list[str]]]:
    """The small labelled table: made-up sentences, words with their labels; after them `bare` ones of plain words alone."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    letters = lambda k: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(k))

    def plain() -> str:
        w = letters(rng.randint(1, 11))
        two = letters(rng.randint(2, 6))
        w = rng.choice([w] * 9 + [w.capitalize(), w.upper(), "é" + w, w + "ü" + letters(2), "中文字", "слово", f"{w}-{two}", f"{w}'s", f"{w}/{two}", f"{w}_{two}", f"<{w}>", f"</{two}>", f"{w}=\"{two}\"", f"{w}()", f"({w})", f"[{w}]", f'"{w}"', f"{w}:", "-", "=", "|", "&", "*", "...", "###", "$$$", "%%%", f"http://{w}.{two}/{two}", f"www.{two}.org", letters(30), letters(24).upper()])
        return w + rng.choice([""] * 6 + [",", ".", ";", "!", "!!", "###"])

    def card() -> str:
        while True:
            x = digits(16)
            if luhn(x):
                return x

    def wrong() -> str:
        while True:
            x = digits(rng.choice([14, 15, 16, 16, 16, 19]))
            if not luhn(x):
                return x

    def entity() -> tuple[str, str]:
        name, host = letters(rng.randint(3, 8)), letters(rng.randint(3, 7))
        kind = rng.choice(["email", "email", "ip", "card", "phone", "phone", "secret", "secret", "secret", "O", "O", "O", "O"])
        if kind == "email":
            return kind, rng.choice([f"{name}.{digits(2)}@{host}.example.com", f"{name}@{host}.org", f"{name} [at] {host} [dot] com", f"{name} (at) {host} (dot) org", f"{name}_{digits(1)}@{host}"])
        if kind == "ip":
            return kind, ".".join(str(rng.randint(0, 255)) for _ in range(4))
        if kind == "card":
            c = card()
            return kind, rng.choice([c, f"{c[:4]} {c[4:8]} {c[8:12]} {c[12:]}", f"{c[:4]}-{c[4:8]}-{c[8:12]}-{c[12:]}"])
        if kind == "phone":
            a, b, c = digits(3), digits(3), digits(4)
            return kind, rng.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{digits(2)} {a} {b} {c}"])
        if kind == "secret":
            hexa = "".join(rng.choice("0123456789abcdef") for _ in range(40))
            caps = "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ234567") for _ in range(16))
            return kind, rng.choice([f'"{hexa}"', hexa, f"AKIA{caps}", f"sk_{hexa[:24]}"])
        # numbers that are no personal data
        return "O", rng.choice([wrong(), wrong(), f"{rng.randint(256, 999)}.{digits(2)}.{digits(1)}.{digits(3)}", digits(rng.randint(1, 4)), f"{digits(1)}.{digits(1)}", f"{digits(2)}%", f"v{digits(1)}.{digits(1)}.{digits(1)}", f"({1900 + rng.randint(0, 125)})", f"{digits(2)}:{digits(2)}", f"{letters(3)}{digits(1)}", f"{digits(1)},{digits(3)}", f"{1900 + rng.randint(0, 125)}-{digits(2)}-{digits(2)}", digits(rng.randint(5, 8))])

    rows = []
    for _ in range(n):
        words, labels = [], []
        for _ in range(rng.randint(1, 2)):
            for _ in range(rng.randint(0, CONTEXT)):
                words.append(plain()), labels.append("O")
            kind, said = entity()
            if kind == "secret" and rng.random() < 0.5:
                for w in rng.choice([["token", "="], ["key:"], ["api", "key"]]):
                    words.append(w), labels.append("O")
            parts = said.split()
            if rng.random() < 0.3:
                parts[-1] += rng.choice([".", ",", "!!", "###", "$$$", "%%%", "&&&", "***"])
            words += parts
            labels += ["O"] * len(parts) if kind == "O" else [f"B-{kind}"] + [f"I-{kind}"] * (len(parts) - 1)
        for _ in range(rng.randint(0, CONTEXT)):
            words.append(plain()), labels.append("O")
        rows.append((words, labels))
    for _ in range(bare):
        words = [plain() for _ in range(rng.randint(4, 16))]
        rows.append((words, ["O"] * len(words)))
    return rows


def train(rows: list[tuple[list[str], list[str]]], rounds: int = 70, rate: float = 0.5, ridge: float = 2e-3) -> Crf:
    """Maximum conditional likelihood by AdaGrad over the whole (small) table."""
    told = [windowed(w) for w, _ in rows]
    often = Counter(f for row in told for fs in row for f in set(fs))
    vocab = {f: k for k, f in enumerate(sorted(f for f, c in often.items() if c > 1))}
    feats = [[[vocab[f] for f in fs if f in vocab] for fs in row] for row in told]
    n, L = max(len(w) for w, _ in rows), len(LABELS)
    size = np.array([len(w) for w, _ in rows])
    gold = np.zeros((len(rows), n), np.int64)
    for r, (_, labels) in enumerate(rows):
        gold[r, : len(labels)] = [LABELS.index(x) for x in labels]
    onehot = np.zeros((len(rows) * n, len(vocab)), np.float32)
    for r, row in enumerate(feats):
        for t, fs in enumerate(row):
            np.add.at(onehot[r * n + t], fs, 1)
    emit, move = np.zeros((len(vocab), L)), np.zeros((L, L))
    inside = np.arange(n) < size[:, None]
    seen_emit, seen_move = np.zeros_like(emit), np.zeros_like(move)
    true = np.zeros((len(rows), n, L))
    true[np.arange(len(rows))[:, None], np.arange(n), gold] = 1
    true *= inside[:, :, None]
    true_move = np.zeros((L, L))
    np.add.at(true_move, (gold[:, :-1][inside[:, 1:]], gold[:, 1:][inside[:, 1:]]), 1)
    lse = lambda x, axis: (m := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis=axis))
    for _ in range(rounds):
        grid = (onehot @ emit.astype(np.float32)).astype(float).reshape(len(rows), n, L)
        step = move + LEGAL
        alpha, beta = np.zeros_like(grid), np.zeros_like(grid)
        alpha[:, 0] = grid[:, 0] + START
        for t in range(1, n):
            ahead = lse(alpha[:, t - 1, :, None] + step, 1) + grid[:, t]
            alpha[:, t] = np.where(inside[:, t, None], ahead, alpha[:, t - 1])
        for t in range(n - 2, -1, -1):
            behind = lse(step + (grid[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(inside[:, t + 1, None], behind, 0)
        z = lse(alpha[np.arange(len(rows)), size - 1], 1)
        p = np.exp(np.minimum(alpha + beta - z[:, None, None], 0)) * inside[:, :, None]
        g_emit = (onehot.T @ (true - p).reshape(-1, L).astype(np.float32)).astype(float)
        pair = alpha[:, :-1, :, None] + step + (grid[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]
        g_move = true_move - (np.exp(np.minimum(pair, 0)) * inside[:, 1:, None, None]).sum(axis=(0, 1))
        g_emit -= ridge * len(rows) * emit
        g_move -= ridge * len(rows) * move
        seen_emit += g_emit**2
        seen_move += g_move**2
        emit += rate * g_emit / (np.sqrt(seen_emit) + 1e-8)
        move += rate * g_move / (np.sqrt(seen_move) + 1e-8)
    return Crf(vocab, emit, move)


_trained: dict[int, Crf] = {}


def trained() -> Crf:
    if 0 not in _trained:
        _trained[0] = train(labelled_rows(bare=300))
    return _trained[0]


_memos: dict = {}
#: Cells (words, padding included) of a Viterbi batch, and bytes of text whose words are decoded together.
VITERBI_CELLS, SLICE = 1 << 17, 1 << 18
#: Rounds of the bounds that tell which words are surely O.
ROUNDS = 3


def crf_spans(texts: pa.Array, model: Crf) -> list[list[tuple[int, int, str]]]:
    """Spans (start, end, kind) of every whole text, in code points."""
    memo = _memos.get(id(model))
    if memo is None:
        _memos.clear()
        memo = _memos[id(model)] = B.Memo(4 * len(LABELS), 18, np.float32)
    data, offsets = B.buffers(texts)
    found: list[list[tuple[int, int, str]]] = [[] for _ in range(len(offsets) - 1)]
    trim_left, trim_right = (np.isin(np.arange(256), list(x.encode())) for x in (_TRIM_LEFT, _TRIM_RIGHT))
    for i, j in B.slices(offsets, SLICE):
        part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        start, end, at = B.words(part, off, B.NOT_SPACE)
        if not len(start):
            continue
        raw = part.tobytes()

        def word(k: int, raw=raw, start=start, end=end) -> str:
            return raw[start[k] : end[k]].decode()

        def vectors(which: np.ndarray, part=part, start=start, end=end, word=word) -> np.ndarray:
            hashes = B.span_hashes(B.prefix_hashes(part), start[which], end[which])
            return memo.get(hashes, lambda rows: model.vectors([word(k) for k in which[rows].tolist()]))

        place, tags = model.decode_all(at, vectors(np.arange(len(start))))
        some, tags = place[tags > 0], tags[tags > 0]
        if not len(some):
            continue
        points = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80)))
        text = np.searchsorted(at, some, "right") - 1
        inner = np.array([x.startswith("I-") for x in LABELS])[tags]
        first = np.flatnonzero(~inner)
        last = np.append(first[1:], len(some)) - 1
        for x, y in zip(first.tolist(), last.tolist(), strict=True):
            a, b = int(start[some[x]]), int(end[some[y]])
            while a < b and trim_left[part[a]]:
                a += 1
            while b > a and trim_right[part[b - 1]]:
                b -= 1
            if b > a:
                base = points[off[text[x]]]
                found[i + text[x]].append((int(points[a] - base), int(points[b] - base), LABELS[tags[x]][2:]))
    return found


def apart(spans: list[tuple[int, int, str]], base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans that touch none of the base spans."""
    if not spans or not base:
        return spans
    rows = sorted((a, b) for a, b, _ in base)
    start, reach = np.array([a for a, _ in rows]), np.maximum.accumulate([b for _, b in rows])
    before = np.searchsorted(start, [b for _, b, _ in spans], "left")  # base spans that begin before the span's end
    return [s for s, k in zip(spans, before.tolist(), strict=True) if not k or reach[k - 1] <= s[0]]


def join_spans(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def _finder(shared, names: list[str]):
    """Batches whose last column is a text -> the columns before it, text, base, added."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
    made = lambda found: pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in x] for x in found], kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(b.num_columns - 1)
            base: list = [[] for _ in range(b.num_rows)]
            for i, t in enumerate(column.to_pylist()):
                if t and _BASE.search(t):
                    base[i] = base_spans(t)
            added = [apart(x, y) for x, y in zip(crf_spans(column, shared.value), base, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, made(base), made(added)], [*names, "text", "base", "added"])

    return run


def _rows(docs: DataFrame, text_col: str, carry: tuple[str, ...], model: Crf | None):
    return docs.select(*carry, F.col(text_col).alias("_text")), docs.sparkSession.sparkContext.broadcast(model or trained())


def find_pii(docs: DataFrame, *, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), model: Crf | None = None) -> DataFrame:
    """*carry, text, base (array of start, end, kind), added (likewise, by the CRF)."""
    rows, shared = _rows(docs, text_col, carry, model)
    span = "array<struct<start:int,end:int,kind:string>>"
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("_text").schema), "text string", f"base {span}", f"added {span}"])
    return rows.mapInArrow(_finder(shared, list(carry)), schema)


def masked(docs: DataFrame, *, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), model: Crf | None = None) -> DataFrame:
    """*carry, text with every span (base and added) replaced by its kind in brackets; null stays null."""
    rows, shared = _rows(docs, text_col, carry, model)
    find = _finder(shared, list(carry))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in find(batches):
            text, base, added = b.columns[-3:]
            filled = np.flatnonzero((np.diff(base.offsets.to_numpy()) > 0) | (np.diff(added.offsets.to_numpy()) > 0)).tolist()
            if filled:
                out = text.to_pylist()
                for i in filled:
                    spans = sorted((s["start"], s["end"], s["kind"]) for s in base[i].as_py() + added[i].as_py())
                    parts, at = [], 0
                    for start, end, kind in spans:
                        if start >= at:
                            parts += [out[i][at:start], f"[{kind}]"]
                        at = max(at, end)
                    out[i] = "".join([*parts, out[i][at:]])
                text = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-3], text], b.schema.names[:-2])

    return rows.mapInArrow(run, docs.select(*carry).schema.add("text", "string"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, shared = _rows(table(spark, sf_dir, "documents"), "text", ("doc_id",), None)
    find = _finder(shared, ["doc_id"])
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = hashlib.sha256(b"").hexdigest()
        for b in find(batches):
            base_at, added_at = b.column(2), b.column(3)
            counts = {k: np.zeros(b.num_rows, np.int64) for k in BASE_KINDS}
            sha, said = [none] * b.num_rows, [""] * b.num_rows
            filled = np.flatnonzero((np.diff(base_at.offsets.to_numpy()) > 0) | (np.diff(added_at.offsets.to_numpy()) > 0))
            for i in filled.tolist():
                base = [(s["start"], s["end"], s["kind"]) for s in base_at[i].as_py()]
                more = [(s["start"], s["end"], s["kind"]) for s in added_at[i].as_py()]
                for _, _, k in base:
                    counts[k][i] += 1
                sha[i] = hashlib.sha256(join_spans(base).encode()).hexdigest()
                said[i] = join_spans(base + more)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(counts[k]) for k in BASE_KINDS), pa.array(sha), pa.array(said, pa.string())], [x.split()[0] for x in schema.split(", ")])

    return rows.mapInArrow(digest, schema)
