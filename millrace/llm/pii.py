"""Personal data: four base patterns, and a linear-chain conditional random field over word-shape features.

The field's features depend on one word each (of the place, the one before and the one after), so its scores are sums of rows that are looked up by
word. A word is left out of decoding if `O` is provably its label on the best path of its line, however long: no stretch of words around it has scores
and transitions that can return more.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import arrow_map, named, shared
from millrace.llm.pii_table import ROWS

KINDS = ("email", "ip", "card", "phone", "secret")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
HASHED = 1 << 11
EPOCHS, RATE, RIDGE = 150, 0.1, 0.01
#: Places of a padded batch that is decoded at once, or one longer stretch.
PLACES = 1 << 17

_LEFT = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match can only begin where a run of digits does, as the pattern takes each run whole; so other places are not tried, and no digit is given back.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"\S+")
#: Words that are features by themselves; all others are known by their shape alone.
TOLD = frozenset(("token", "secret", "password", "key", "apikey", "api_key", "passwd", "pwd", "bearer", "at", "dot", "phone", "tel", "call", "ip", "host", "card", "visa", "mail", "email", "e-mail"))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of the email pattern; only places next to an @ are tried."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        low = at
        while low > done and text[low - 1] in _LOCAL:
            low -= 1
        if low < at and (m := _EMAIL.match(text, low)):
            out.append(m.span())
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Code-point spans of each base kind; matches that fail the kind's test are dropped."""
    ips = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    cards = [m.span() for m in _CARD.finditer(text) if 13 <= len(d := re.sub(r"[ -]", "", m[0])) <= 19 and luhn(d)]
    phones = [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return {"email": emails(text) if "@" in text else [], "ip": ips, "card": cards, "phone": phones if "+" in text else []}


def core(word: str) -> tuple[int, int]:
    """The word without quotes and punctuation at its ends."""
    low, high = 0, len(word)
    while low < high and word[low] in "\"'“”‘’«»(<[{,;:=.!?":
        low += 1
    while high > low and word[high - 1] in "\"'“”‘’«»)>]},;:.!?#$%&*|~":
        high -= 1
    return low, high


def features(word: str) -> list[str]:
    """Shape, character classes, ends and lengths of one word."""
    a, b = core(word)
    w = word[a:b]
    shape = re.sub(r"(.)\1+", r"\1", re.sub(r"[^\W\d_]", "x", re.sub(r"\d", "d", re.sub(r"[A-ZÀ-Þ]", "X", w[:80]))))[:12]
    digits = sum(c.isdigit() for c in w)
    n = len(w)
    out = ["bias", f"shape={shape}", f"len={min(n.bit_length(), 7)}", f"digits={min(digits, 20)}"]
    if n >= 16 and w.isascii() and re.fullmatch(r"[0-9a-zA-Z_+/=-]+", w):
        mixed = bool(digits) + any(c.islower() for c in w) + any(c.isupper() for c in w)
        out.append(f"dense={mixed}{digits * 4 >= n}")
    if digits:
        out.append("digit")
    if n == digits and n:
        out.append(f"number={min(n, 20)}")
    for c in "@+.-_=(/":
        if c in w:
            out.append(f"has{c}{min(w.count(c), 4)}")
    if n <= 12 and w.isalpha():
        out.append("alpha")
        if w.lower() in TOLD:
            out.append(f"word={w.lower()}")
    if word in ("=", ":", "=>", ":="):
        out.append("assign")
    if word[:1] in "\"'":
        out.append("quoted")
    if word and word[-1] in "=:":
        out.append("opens")
    return out


def numbers(word: str) -> list[int]:
    return sorted({int.from_bytes(hashlib.blake2b(f.encode(), digest_size=4).digest(), "little") % HASHED for f in features(word)})


def read_table(rows: tuple[str, ...] = ROWS) -> list[tuple[list[str], list[int]]]:
    """Words and labels of rows in which spans are marked as <kind:words>."""
    out = []
    for row in rows:
        words, labels = [], []
        for part in re.split(r"(⟦\w+:[^⟧]*⟧[^\s]*)", row):
            m = re.fullmatch(r"⟦(\w+):([^⟧]*)⟧(\S*)", part)
            found = (m[2] + m[3]).split() if m else part.split()
            if m and words and not row[: row.index(part)].endswith((" ", "\n")):
                found[0], _ = words.pop() + found[0], labels.pop()
            words += found
            labels += [LABELS.index(f"{'I' if i else 'B'}-{m[1]}") for i in range(len(found))] if m else [0] * len(found)
        out.append((words, labels))
    return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))


class Field:
    """weights: (3, HASHED, labels) for the word before, of and after a place; moves: (labels, labels)."""

    def __init__(self, rows: tuple[str, ...] = ROWS):
        k = len(LABELS)
        data = read_table(rows)
        n, longest = len(data), max(len(w) for w, _ in data)
        # One matrix of features for all places, padded sequences in the batch.
        x = np.zeros((n * longest, 3 * HASHED), np.float32)
        y, mask = np.zeros((n, longest), int), np.zeros((n, longest), bool)
        for i, (words, labels) in enumerate(data):
            y[i, : len(labels)], mask[i, : len(labels)] = labels, True
            found = [numbers(w) for w in words]
            for t in range(len(words)):
                for d in (-1, 0, 1):
                    if 0 <= t + d < len(words):
                        x[i * longest + t, [(d + 1) * HASHED + f for f in found[t + d]]] = 1
        used = np.flatnonzero(x.any(0))
        x = x[:, used]
        w, moves = np.zeros((len(used), k), np.float32), np.zeros((k, k))
        first = [np.zeros_like(w), np.zeros_like(moves)]
        second = [np.zeros_like(w), np.zeros_like(moves)]
        at = np.arange(n)
        last = mask.sum(1) - 1
        for step in range(1, EPOCHS + 1):
            s = (x @ w).reshape(n, longest, k).astype(float)
            alpha, beta = np.zeros_like(s), np.zeros_like(s)
            alpha[:, 0] = s[:, 0]
            for t in range(1, longest):
                alpha[:, t] = s[:, t] + _lse(alpha[:, t - 1, :, None] + moves, 1)
            for t in range(longest - 2, -1, -1):
                beta[:, t] = np.where(mask[:, t + 1, None], _lse(moves[None] + (s[:, t + 1] + beta[:, t + 1])[:, None, :], 2), 0)
            z = _lse(alpha[at, last], 1)
            p = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
            p[at[:, None], np.arange(longest), y] -= mask
            g = [x.T @ p.reshape(-1, k).astype(np.float32) + RIDGE * w, RIDGE * moves]
            for t in range(1, longest):
                pair = np.exp(alpha[:, t - 1, :, None] + moves + (s[:, t] + beta[:, t])[:, None, :] - z[:, None, None]) * mask[:, t, None, None]
                g[1] = g[1] + pair.sum(0)
                np.subtract.at(g[1], (y[mask[:, t], t - 1], y[mask[:, t], t]), 1)
            for value, grad, a, b in zip((w, moves), g, first, second, strict=True):
                a += 0.1 * (grad - a)
                b += 0.001 * (grad**2 - b)
                value -= (RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(value.dtype)
        self.weights = np.zeros((3 * HASHED, k))
        self.weights[used] = w
        self.weights = self.weights.reshape(3, HASHED, k)
        self.moves = moves
        # I-x only follows B-x or I-x.
        for j, label in enumerate(LABELS):
            if label[0] == "I":
                self.moves[[i for i, v in enumerate(LABELS) if v[2:] != label[2:]], j] = -50


class Alike(dict):
    """For str.translate: letters and ASCII digits of one kind become the same one, which changes no feature of words that are not in TOLD."""

    def __missing__(self, code: int) -> int:
        c = chr(code)
        if c.isalpha():
            kind = "xX" if c.isascii() else "éÉ" if not c.isupper() or "À" <= c <= "Þ" else "éĀ"
            code_of = ord(kind[c.isupper()])
        else:
            code_of = ord("0") if c.isascii() and c.isdigit() else code
        self[code] = code_of
        return code_of


class Scores(dict):
    """word -> the row of `table` (rows, 3, labels) that has what it adds to the scores of the next place, its own and the one before. Row 0 adds nothing."""

    def __init__(self, field: Field):
        super().__init__()
        self.field, self.rows, self.alike, self.table = field, {}, Alike(), np.zeros((1024, 3, len(LABELS)))

    def __missing__(self, word: str) -> int:
        key = word if word[slice(*core(word))].lower() in TOLD else word.translate(self.alike)
        row = self.rows.get(key)
        if row is None:
            row = self.rows[key] = len(self.rows) + 1
            if row == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[row] = self.field.weights[:, numbers(word)].sum(1)
        self[word] = row
        return row

    def trim(self) -> None:
        """Between batches only, as it renames rows."""
        if len(self) > 300_000 or len(self.rows) > 50_000:
            self.clear()
            self.rows.clear()


def entering(moves: np.ndarray) -> np.ndarray:
    """The most that transitions can return, against those of `O` everywhere, for each place that has a label: what leads back to `O` is counted where a label is entered."""
    gain = moves - moves[0, 0]
    back = np.minimum(0, -gain[:, 0])
    out = np.maximum(0, (gain + back[:, None]).max(0)) - back
    out[0] = 0
    return out


def undecided(ids: np.ndarray, table: np.ndarray, enter: np.ndarray) -> np.ndarray:
    """Which places of lines, between which ids is 0, may have a label other than `O` on a best path.

    A best path with one at a place has a stretch of them around it that returns no less than `O`; so the place is decided if no stretch that holds
    it has a sum of bounds above 0.
    """
    apart = table - table[:, :, :1]
    before, own, after = (np.ascontiguousarray(apart[:, i, 1:] + (enter[1:] if i == 1 else 0)) for i in range(3))
    bound = np.empty(len(ids))
    around = np.concatenate([[0], ids, [0]])
    for low in range(0, len(ids), 1 << 15):
        part = around[low : low + (1 << 15) + 2]
        bound[low : low + (1 << 15)] = (before[part[:-2]] + own[part[1:-1]] + after[part[2:]]).max(1)
    bound[ids == 0] = -1000
    total = np.concatenate([[0], np.cumsum(bound)])
    upto = total[1:] - np.minimum.accumulate(total)[:-1]
    onward = np.maximum.accumulate(total[::-1])[::-1][1:] - total[:-1]
    return (upto + onward - bound > -1e-3) & (ids != 0)


def viterbi(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best labels (batch, longest) of padded sequences (batch, longest, labels)."""
    n, longest, k = scores.shape
    back = np.zeros((n, longest, k), np.int16)
    best = scores[:, 0].copy()
    final = best.copy()
    for t in range(1, longest):
        step = best[:, :, None] + moves
        back[:, t] = step.argmax(1)
        best = step.max(1) + scores[:, t]
        final = np.where((lengths > t)[:, None], best, final)
    out = np.zeros((n, longest), np.int16)
    label = final.argmax(1)
    at = np.arange(n)
    for t in range(longest - 1, -1, -1):
        inside = lengths > t
        out[inside, t] = label[inside]
        label = np.where(inside, back[at, t, label], label)
    return out


def sequence_scores(ids: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Scores of the places of a line but the first and last, which stand for its surroundings."""
    return table[ids[:-2], 0] + table[ids[1:-1], 1] + table[ids[2:], 2]


def decoded(lines: list[np.ndarray], moves: np.ndarray) -> list[np.ndarray]:
    """Labels of lines with these scores. Lines go by length, in padded batches."""
    out: list = [None] * len(lines)
    order = sorted(range(len(lines)), key=lambda i: len(lines[i]))
    low = 0
    while low < len(order):
        high = low
        while high < len(order) and high - low < 256 and (high == low or len(lines[order[high]]) <= min(1.25 * len(lines[order[low]]) + 4, PLACES // (high - low + 1))):
            high += 1
        part = order[low:high]
        n = np.array([len(lines[i]) for i in part])
        padded = np.zeros((len(part), n.max(), len(LABELS)))
        for j, i in enumerate(part):
            padded[j, : n[j]] = lines[i]
        for j, (i, path) in enumerate(zip(part, viterbi(padded, n, moves), strict=True)):
            out[i] = path[: n[j]]
        low = high
    return out


class Finder:
    """All spans of texts. Made once in each task."""

    def __init__(self, field: Field):
        self.field, self.scores, self.enter = field, Scores(field), entering(field.moves)

    def added(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """(kind, start, end) that the field finds in each text."""
        self.scores.trim()
        row = self.scores.__getitem__
        ids, lines = [0], []
        for i, text in enumerate(texts):
            at = 0
            for line in text.split("\n"):
                if words := line.split():
                    lines.append((i, at, at + len(line), len(ids)))
                    ids += map(row, words)
                    ids.append(0)
                at += len(line) + 1
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        if not lines:
            return out
        ids, table = np.array(ids), self.scores.table[: len(self.scores.rows) + 1]
        # Stretches of undecided places, with a place on either side, if the line has one, that is held at O: what lies beyond cannot matter.
        turns = np.flatnonzero(np.diff(np.concatenate([[0], undecided(ids, table, self.enter), [0]])))
        stretches = [(low - (ids[low - 1] != 0), high + (ids[high] != 0), low, high) for low, high in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True)]
        firsts = [x[3] for x in lines]
        known, places = -1, []
        for at_once in range(0, len(stretches), 2048):
            part = stretches[at_once : at_once + 2048]
            scores = []
            for low, high, a, b in part:
                scores.append(sequence_scores(ids[low - 1 : high + 1], table))
                scores[-1][: a - low, 1:] = scores[-1][b - low :, 1:] = -1e6
            for (low, high, _, _), labels in zip(part, decoded(scores, self.field.moves), strict=True):
                if not labels.any():
                    continue
                n = bisect_right(firsts, low) - 1
                i, at, stop, first = lines[n]
                if n != known:
                    known, places = n, [(m[0], at + m.start()) for m in _WORD.finditer(texts[i][at:stop])]
                out[i] += spans_of(texts[i], places[low - first : high - first], labels)
        return out

    def find(self, texts: list[str | None]) -> list[tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]]:
        """Base spans by kind, and all spans by kind and start; a span of the field that overlaps a base span or fails its kind's test is left out."""
        whole = [t or "" for t in texts]
        out = []
        for text, more in zip(whole, self.added(whole), strict=True):
            base = base_spans(text)
            spans = [(k, a, b) for k in KINDS for a, b in base.get(k, ())]
            taken = [(a, b) for _, a, b in spans]
            spans += [x for x in more if sound(x[0], text[x[1] : x[2]]) and not any(x[1] < b and a < x[2] for a, b in taken)]
            out.append((base, sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))))
        return out


def spans_of(text: str, places: list[tuple[str, int]], labels: np.ndarray) -> list[tuple[str, int, int]]:
    """(kind, start, end) that the labels mark, for words and their starts in the text."""
    out = []
    for t in np.flatnonzero(labels).tolist():
        if LABELS[labels[t]][0] != "B":
            continue
        end = t + 1
        while end < len(places) and labels[end] == labels[t] + 1:
            end += 1
        a, b = places[t][1] + core(places[t][0])[0], places[end - 1][1] + core(places[end - 1][0])[1]
        if a < b and text[a - 1 : a] == "(" and ")" in text[a:b]:
            a -= 1
        if a < b:
            out.append((LABELS[labels[t]][2:], a, b))
    return out


def sound(kind: str, found: str) -> bool:
    """Cards of the field have to pass Luhn's test, addresses the limit of 255, and phones the limits of 9 and 15 digits, as base ones do."""
    digits = re.sub(r"[^0-9]", "", found)
    return (kind != "phone" or 9 <= len(digits) <= 15) and (kind != "card" or 13 <= len(digits) <= 19 and luhn(digits)) and (kind != "ip" or all(len(p) <= 3 and int(p) <= 255 for p in re.findall(r"[0-9]+", found)))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def personal(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """A row for each row of documents: n_email, n_ip, n_card, n_phone, base_sha256 and spans. Null is empty; empty texts have no spans; repeated rows give a row each; an empty table gives an empty result; other columns are ignored."""
    given = shared(documents.sparkSession, field or Field())
    made: list[Finder] = []

    def run(batch: dict[str, list]) -> dict[str, list]:
        if not made:
            made.append(Finder(given()))
        out: dict[str, list] = {"id": batch["id"]} | {f"n_{k}": [] for k in KINDS[:4]} | {"base_sha256": [], "spans": []}
        for base, spans in made[0].find(batch["text"]):
            for k in KINDS[:4]:
                out[f"n_{k}"].append(len(base[k]))
            out["base_sha256"].append(hashlib.sha256(joined([(k, a, b) for k in KINDS[:4] for a, b in base[k]]).encode()).hexdigest())
            out["spans"].append(joined(spans))
        return out

    schema = f"id {dict(documents.dtypes)[id_col]}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"
    return arrow_map(documents.select(F.col(named(id_col)).alias("id"), F.col(named(text_col)).alias("text")), schema, run).withColumnRenamed("id", id_col)


def redacted(documents: DataFrame, text_col: str = "text", field: Field | None = None) -> DataFrame:
    """documents, where each span of the text is replaced by its kind in angle brackets; overlapping spans become one of the first kind. Null stays null, texts without spans stay as they are; all rows, repeated ones too, and all columns are kept; an empty table stays empty."""
    given = shared(documents.sparkSession, field or Field())
    made: list[Finder] = []

    def clean(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
        if not spans:
            return text
        out, done = [], 0
        for k, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
            if a >= done:
                out += [text[done:a], f"<{k.upper()}>"]
            done = max(done, b)
        return "".join([*out, text[done:]])

    def run(batch: dict[str, list]) -> dict[str, list]:
        if not made:
            made.append(Finder(given()))
        found = made[0].find(batch[text_col])
        return batch | {text_col: [clean(t, s) for t, (_, s) in zip(batch[text_col], found, strict=True)]}

    return arrow_map(documents, documents.schema, run)


def op8_pii(spark, sf_dir: str) -> DataFrame:
    return personal(spark.read.parquet(f"{sf_dir}/documents.parquet"))
