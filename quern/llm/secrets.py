"""Secret scans: fixed base patterns plus a linear-chain conditional random field.

The field tags tokens as begin, inside or outside of a secret from their
shape, the neighbouring words and features of the whole file, and is decoded
by Viterbi. It is trained here on a bounded sample of rows whose base matches
serve as labels, plus examples made by rule; key words are hidden from a part
of the examples, so that it learns to go by shape and surroundings too.

Every token of every text is scored, in numpy over many texts at once. From the
scores follows a bound on what a run of tagged tokens through each token can
gain over leaving it outside; where that is negative, the best path is outside,
and Viterbi runs over what is left. So tags are those of the whole text.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows among which training rows are sought, and rows with and without base matches that the field is trained on.
SAMPLE_ROWS = 20_000
TRAIN_ROWS = 300
#: Stretches of a training row, and characters of one, that are learned from.
STRETCHES = 8
STRETCH_CHARS = 1000
#: Characters learned from on either side of a token that is not plain, and how far apart plain stretches begin.
REACH = 40
PLAIN = 500
#: Least length of a secret that the field adds.
LEAST = 8
#: Characters of text that are scored at a time; a longer text is taken by itself.
BLOCK_CHARS = 2 << 20
#: Distinct digit-bearing tokens whose shapes a worker remembers; it starts anew when they are more.
REMEMBERED = 200_000

# Fixed values of the result contract: base patterns by kind, and least lengths.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]{32,}"), 0, 32),
)
#: What a text with a base match holds; Arrow's pattern search finds those texts.
BASE_NEEDS = r"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]{12}|[0-9a-f]{32}"

TOKEN = re.compile(r"[A-Za-z0-9+/_.-]+|[^\sA-Za-z0-9+/_.-]")
NOT_PLAIN = re.compile(
    r"(?<![A-Za-z0-9+/_.-])(?:[A-Za-z+/_.-]*+[0-9][A-Za-z0-9+/_.-]*+|[A-Za-z+/_.-]{20,}+)|password|passwd|passphrase|pwd|secret|token|api_?key|credential|private|bearer|auth",
    re.I | re.A,
)
#: Tokens that announce a secret: these words, and whatever holds one of the parts.
KEYWORDS = ("pwd", "pass", "passphrase", "key", "credential", "credentials", "private", "bearer", "auth", "authorization", "access_key", "db_pass", "signature")
KEY_PARTS = ("passw", "passphrase", "secret", "apikey", "api_key", "token")
KEY_NEEDS = "|".join((*KEYWORDS, *KEY_PARTS))
KEY = re.compile(rf"(?<![A-Za-z0-9+/_.-])(?:{'|'.join(KEYWORDS)})(?![A-Za-z0-9+/_.-])|{'|'.join(KEY_PARTS)}", re.I | re.A)
WORD_MARKS = "+/_.-"
MARKS = "\"'`:=,;()<>[]{}@"
#: Marks that a neighbour's features tell apart.
CLASS_MARKS = "\"'`:=,;(@<"
CLASSES = ("word", "key", "digits", "mark", *CLASS_MARKS, "<s>", "</s>")
CLASS = {c: i for i, c in enumerate(CLASSES)}
LENGTHS = (4, 8, 12, 16, 20, 24, 32, 40, 64)
OUT, BEGIN, INSIDE = 0, 1, 2


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), leftmost and non-overlapping within a kind; end exclusive, in code points."""
    found = []
    for order, (kind, pattern, group, least) in enumerate(BASE):
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), order, m.end(), kind))
    return [(start, end, kind) for start, _, end, kind in sorted(found)]


def _bucket(n: float, *edges: float) -> int:
    return sum(n >= e for e in edges)


def shape(token: str) -> list[str]:
    """Features of a token by itself; a character beyond ASCII is a token of its own."""
    n = len(token)
    if n == 1 and not token.isalnum():
        return [f"p={token}" if token in MARKS else "p=other"]
    digits = sum("0" <= c <= "9" for c in token)
    upper = sum("A" <= c <= "Z" for c in token)
    lower = sum("a" <= c <= "z" for c in token)
    marks = n - digits - upper - lower
    kinds = f"{'d' * bool(digits)}{'U' * bool(upper)}{'l' * bool(lower)}{'m' * bool(marks)}"
    out = [f"kind={kinds}", f"len={_bucket(n, *LENGTHS)}", f"kind={kinds},len={_bucket(n, 8, 12, 16, 20, 32)}"]
    if digits:
        counts = [token.count(c) for c in set(token)]
        bits = -sum(k / n * math.log2(k / n) for k in counts)
        turns = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:]))
        out += [f"bits={_bucket(bits, 1.5, 2.2, 2.8, 3.2, 3.6, 4)}", f"turns={_bucket(turns / n, 0.05, 0.15, 0.3)}", f"digits={_bucket(digits / n, 0.1, 0.3, 0.6, 1)}"]
        if re.fullmatch(r"[0-9a-fA-F]+", token) and digits < n:
            out.append(f"hex={_bucket(n, 8, 16, 32)}")
        if re.fullmatch(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", token):
            out.append("uuid")
        if "." in token:
            out.append("dotted")
        if "/" in token:
            out.append("path")
    return out


def word_class(token: str, hidden: bool = False) -> str:
    if KEY.search(token):
        return "word" if hidden else "key"
    if len(token) == 1 and not token.isalnum():
        return token if token in CLASS_MARKS else "mark"
    return "digits" if any("0" <= c <= "9" for c in token) else "word"


def file_features(text: str) -> list[str]:
    """Features of the whole file."""
    n = max(1, len(text))
    return [
        f"eq={_bucket(text.count('=') * 1000 / n, 0.01, 1, 5)}",
        f"brace={_bucket((text.count('{') + text.count(';')) * 1000 / n, 0.01, 1, 5)}",
        f"quote={_bucket(text.count('"') * 1000 / n, 0.01, 1, 5)}",
    ]


def token_features(tokens: list[str], of_file: list[str], hidden: bool = False) -> list[list[str]]:
    classes = ["<s>", "<s>", "<s>", *(word_class(t, hidden) for t in tokens), "</s>", "</s>"]
    shapes = [shape(t) for t in tokens]
    out = []
    for i, own in enumerate(shapes):
        b3, b2, b1, a1, a2 = classes[i], classes[i + 1], classes[i + 2], classes[i + 4], classes[i + 5]
        here = [*own, f"b1={b1}", f"b2={b2}", f"b12={b2},{b1}", f"b123={b3},{b2},{b1}", f"a1={a1}", f"a12={a1},{a2}", f"{own[0]}|b1={b1}"]
        if "key" in (b1, b2, b3):
            here.append(f"key|{own[min(2, len(own) - 1)]}")
        if own[0].startswith("kind=d"):
            here += [f"{own[2]}|{f}" for f in of_file]
        out.append(here)
    return out


@dataclass
class Field:
    """Weights by feature for the three tags, and between tags."""

    weights: dict[str, tuple[float, float, float]]
    moves: tuple[tuple[float, ...], ...]

    def emit(self, features: list[list[str]]) -> list[list[float]]:
        get, none = self.weights.get, (0.0, 0.0, 0.0)
        out = []
        for fs in features:
            a = b = c = 0.0
            for f in fs:
                w = get(f, none)
                a, b, c = a + w[0], b + w[1], c + w[2]
            out.append([a, b, c])
        return out

    def decode(self, features: list[list[str]]) -> list[int]:
        """Viterbi; a sequence begins outside, and inside never follows outside."""
        if not features:
            return []
        moves, back = self.moves, []
        emitted = self.emit(features)
        best = [emitted[0][0] + moves[0][0], emitted[0][1] + moves[0][1], -math.inf]
        for row in emitted[1:]:
            new, come = [], []
            for to in range(3):
                score, at = max((best[s] + moves[s][to], -s) for s in range(3))
                new.append(score + row[to])
                come.append(-at)
            best = new
            back.append(come)
        tag = max(range(3), key=lambda t: (best[t], -t))
        tags = [tag]
        for come in reversed(back):
            tag = come[tag]
            tags.append(tag)
        return tags[::-1]


def stretches(text: str) -> Iterator[list[re.Match[str]]]:
    """What training learns from: runs of tokens around those that are not plain, and a run at every PLAIN-th character."""
    marks = [(m.start(), m.end()) for m in NOT_PLAIN.finditer(text)]
    marks = sorted(marks + [(at, at + 4 * REACH) for at in range(0, len(text), PLAIN)])
    at = 0
    while at < len(marks):
        start, end = marks[at]
        at += 1
        while at < len(marks) and marks[at][0] - end <= REACH:
            end = max(end, marks[at][1])
            at += 1
        left, right = max(0, start - REACH), min(len(text), end + REACH)
        while left and not text[left - 1].isspace() and start - left < 2 * REACH:
            left -= 1
        while right < len(text) and not text[right].isspace() and right - end < 2 * REACH:
            right += 1
        tokens = list(TOKEN.finditer(text, left, right))
        if tokens:
            yield tokens


def _labelled(text: str, spans: list[tuple[int, int]], tokens: list[re.Match[str]]) -> list[int]:
    tags, open_span = [], None
    for m in tokens:
        span = next((s for s in spans if m.start() < s[1] and m.end() > s[0]), None)
        tags.append(OUT if span is None else INSIDE if span == open_span else BEGIN)
        open_span = span
    return tags


def secret_values(text: str) -> list[tuple[int, int]]:
    """The values inside base matches (what follows the key word), as training labels."""
    found: list[tuple[int, int]] = []
    for _, pattern, group, least in BASE:
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least and not any(a < m.end(group) and b > m.start(group) for a, b in found):
                found.append((m.start(group), m.end(group)))
    return found


def made_examples(seed: int = 7) -> list[tuple[str, list[tuple[int, int]]]]:
    """Training texts by rule with the places of their secrets: secrets in usual places, and look-alikes that are none."""
    rng = random.Random(seed)
    some = lambda abc, n: "".join(rng.choice(abc) for _ in range(n))
    low, up, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    word = lambda: some(low, rng.randint(2, 9))
    out = []
    for i in range(60):
        value = some(low + up + num, rng.choice([20, 24, 32, 40])) if i % 3 else some("abcdef" + num, rng.choice([32, 40, 64]))
        key = rng.choice(["password", "secret", "token", "api_key", "apikey", "passwd", "passphrase", "pwd", "auth", "credential", "access_key", "db_pass", "Authorization: Bearer"])
        out.append(f"{word()} {word()} {key}{rng.choice([' = ', '=', ': ', ' is ', ' '])}{rng.choice(['"', "'", ''])}\x00{value}\x00 {word()}")
        out.append(f"{word()} the {rng.choice(['password', 'passphrase', 'secret'])}{rng.choice([' is ', ': ', '='])}\x00{some(low, rng.randint(14, 26))}\x00 {word()} {word()}")
        out.append(f"{word()} {rng.choice(['the key to', 'a secret of', 'token of', 'private', 'pass'])} {word()} is {word()} {word()} {some(low, rng.randint(14, 26))} {word()}")
        out.append(f"{word()} id {some('abcdef' + num, 8)}-{some('abcdef' + num, 4)}-{some('abcdef' + num, 4)}-{some('abcdef' + num, 4)}-{some('abcdef' + num, 12)} {word()}")
        out.append(f"{word()} \x00{rng.choice(['ghp_', 'sk-', 'xoxb-', 'glpat-', ''])}{some(low + up + num, rng.choice([24, 32, 36]))}\x00 {word()}")
        out.append(" ".join(some(low, rng.randint(1, 26)).capitalize() if rng.random() < 0.2 else some(low, rng.randint(1, 26)) + rng.choice(["", "", ",", "."]) for _ in range(14)))
        out.append(" ".join((some(up, rng.randint(1, 26)) if i % 2 else some(low, rng.randint(1, 26))) + rng.choice(["!!", ".!!", "&&&", "%%%", "$$$", "***", "###", " |", ",", '"', ")"]) for _ in range(14)))
        out.append(f"{word()} /usr/{word()}/{word()}{some(num, 2)}/{word()}-{some(num, 1)}.{some(num, 1)}/{word()}.txt {word()} {word()}_{word()}_{some(num, 2)} {word()}")
        out.append(f"{word()} AKIA{some(up + num, 16)} {word()}")
        out.append(f"{word()} +{rng.randint(1, 99)} ({some(num, 3)}) {some(num, 3)}-{some(num, 4)} {word()} {some(num, 16)} {word()}")
        out.append(f"{word()} {word()}.{some(num, 2)}@mail{some(num, 1)}.example.com {some(num, 2)}.{some(num, 2)}.{some(num, 3)}.{some(num, 2)} {word()}")
        out.append(f"{word()} version {some(num, 1)}.{some(num, 1)}.{some(num, 2)} on {some(num, 4)}-{some(num, 2)}-{some(num, 2)} {word()}{some(num, 2)} {word()}")
        out.append(f"{word()} https://{word()}.example.com/{word()}/{some(num, 5)}.html {some(low, rng.randint(20, 30))} {word()}")
    marked = [t.split("\x00") for t in out]
    return [("".join(parts), [(len(parts[0]), len(parts[0]) + len(parts[1]))] if len(parts) > 1 else secret_values("".join(parts))) for parts in marked]


def train(examples: list[tuple[str, list[tuple[int, int]]]], rounds: int = 8, rate: float = 0.3, ridge: float = 1e-3) -> Field:
    """Maximum likelihood by forward and backward sums over (text, places of its secrets), one stretch at a time, with per-weight step sizes."""
    samples = []
    for text, spans in examples:
        of_file = file_features(text)
        for tokens in stretches(text):
            tags = _labelled(text, spans, tokens)
            words = [m.group() for m in tokens]
            hidden = int(hashlib.sha256(" ".join(words).encode("utf-8", "surrogatepass")).hexdigest()[:2], 16) % 3 == 0
            samples.append((token_features(words, of_file, hidden), np.array(tags)))
    names: dict[str, int] = {}
    coded = [([np.array([names.setdefault(f, len(names)) for f in fs]) for fs in features], tags) for features, tags in samples]
    w, g = np.zeros((len(names), 3)), np.full((len(names), 3), 1e-2)
    moves, gm = np.zeros((3, 3)), np.full((3, 3), 1e-2)
    barred = np.zeros((3, 3))
    barred[OUT, INSIDE] = -1e4
    order = random.Random(1)
    for _ in range(rounds):
        order.shuffle(coded)
        for features, tags in coded:
            n = len(features)
            emit = np.array([w[f].sum(axis=0) for f in features])
            step = np.exp(moves + barred)
            first = np.array([1.0, 1.0, 0.0])
            e = np.exp(emit - emit.max(axis=1, keepdims=True))
            alpha, beta = np.zeros((n, 3)), np.ones((n, 3))
            alpha[0] = e[0] * step[OUT] * first
            alpha[0] /= alpha[0].sum()
            for i in range(1, n):
                alpha[i] = alpha[i - 1] @ step * e[i]
                alpha[i] /= alpha[i].sum()
            for i in range(n - 2, -1, -1):
                beta[i] = step @ (e[i + 1] * beta[i + 1])
                beta[i] /= beta[i].sum()
            p = alpha * beta
            p /= p.sum(axis=1, keepdims=True)
            error = -p
            error[np.arange(n), tags] += 1
            if np.abs(error).max() < 1e-3:
                continue
            for i, f in enumerate(features):
                d = error[i] - ridge * w[f]
                g[f] += d * d
                w[f] += rate * d / np.sqrt(g[f])
            d = np.zeros((3, 3))
            for i in range(n):
                pair = (alpha[i - 1] if i else np.array([1.0, 0, 0]))[:, None] * step * (e[i] * beta[i])[None, :]
                d -= pair / pair.sum()
                d[tags[i - 1] if i else OUT, tags[i]] += 1
            gm += d * d
            moves += rate * (d - ridge * moves) / np.sqrt(gm)
    moves = moves + barred
    return Field({f: tuple(w[i]) for f, i in names.items()}, tuple(map(tuple, moves)))


class Scanner:
    """A field's weights as tables over small codes, and the decoding of many texts at once.

    Tokens without digits have one of few shapes; the shape of a token with
    digits is worked out once. Scores are those of begin and inside over outside.
    """

    def __init__(self, field: Field):
        self.field = field
        self.moves = np.array(field.moves)
        self.shapes: dict[tuple[str, ...], int] = {}
        self.features: list[list[str]] = []
        self.known: dict[str, int] = {}
        kinds = len(CLASSES)
        lift = self.lift
        before = np.array([[[lift(f"b1={b1}", f"b2={b2}", f"b12={b2},{b1}", f"b123={b3},{b2},{b1}") for b1 in CLASSES] for b2 in CLASSES] for b3 in CLASSES])
        self.before = before.reshape(-1, 2)
        self.after = np.array([[lift(f"a1={a1}", f"a12={a1},{a2}") for a2 in CLASSES] for a1 in CLASSES]).reshape(-1, 2)
        self.own = np.zeros((0, kinds, 2))
        self.keyed = np.zeros((0, 2))
        # shapes of tokens without digits, by the kinds of characters in them and their length
        self.plain = np.zeros((8, len(LENGTHS) + 1), np.int64)
        for kind in range(1, 8):
            for size, n in enumerate((1, *LENGTHS)):
                token = "A" * bool(kind & 1) + "a" * bool(kind & 2) + "_" * bool(kind & 4)
                if len(token) <= (LENGTHS[size] - 1 if size < len(LENGTHS) else 64):
                    self.plain[kind, size] = self._code(token + token[-1] * max(0, (2 if token == "_" else n) - len(token)))
        self.single = np.array([self._code(c) for c in MARKS] + [self._code("%"), self._code("é")])
        moves = self.moves - self.moves[OUT, OUT]
        self.enter = np.array([moves[:, BEGIN].max(), moves[1:, INSIDE].max()])
        self.leave = max(0.0, moves[1:, OUT].max())
        # one table of character kinds: 0 space, 1 digit, 2 upper, 3 lower, 4 mark in words, 5... single tokens
        self.table = np.full(129, 5 + len(MARKS), np.uint8)
        for c in range(128):
            ch = chr(c)
            if ch.isspace():
                self.table[c] = 0
            elif ch.isalnum():
                self.table[c] = 1 if ch.isdigit() else 2 if ch.isupper() else 3
            elif ch in WORD_MARKS:
                self.table[c] = 4
            elif ch in MARKS:
                self.table[c] = 5 + MARKS.index(ch)
        self.single_class = np.array([CLASS.get(c, CLASS["mark"]) for c in MARKS] + [CLASS["mark"], CLASS["word"]])

    def lift(self, *features: str) -> tuple[float, float]:
        found = [self.field.weights.get(f, (0.0, 0.0, 0.0)) for f in features]
        return sum(w[BEGIN] - w[OUT] for w in found), sum(w[INSIDE] - w[OUT] for w in found)

    def _code(self, token: str) -> int:
        own = shape(token)
        key = tuple(own)
        if key not in self.shapes:
            self.shapes[key] = len(self.features)
            self.features.append(own)
            row = np.array([[self.lift(*own, f"{own[0]}|b1={b1}") for b1 in CLASSES]])
            self.own = np.concatenate([self.own, row])
            self.keyed = np.concatenate([self.keyed, [self.lift(f"key|{own[min(2, len(own) - 1)]}")]])
        return self.shapes[key]

    def _digit_codes(self, tokens: list[str]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        for t in set(tokens).difference(known):
            known[t] = self._code(t)
        return np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))

    def scores(self, texts: list[str], keyed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per token of all texts: start, end, text, and its two scores. ``keyed`` says which texts may hold key words."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        offsets = np.cumsum(sizes) - sizes
        whole = "\n".join([*texts, ""])
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = self.table[np.minimum(points, 128)]
        beyond = np.nonzero(points > 127)[0]
        if len(beyond):
            chars, back = np.unique(points[beyond], return_inverse=True)
            other = 5 + len(MARKS)
            kinds[beyond] = np.array([0 if chr(c).isspace() else other + chr(c).isalnum() for c in chars], np.uint8)[back]
        word = (kinds > 0) & (kinds < 5)
        single = kinds > 4
        edge = np.diff(word.astype(np.int8), prepend=0, append=0)
        starts = np.nonzero((edge[:-1] == 1) | single)[0]
        ends = np.nonzero((edge[1:] == -1) | single)[0] + 1
        if not len(starts):
            return starts, ends, starts, np.zeros((0, 2))
        held = np.bitwise_or.reduceat(np.array([0, 1, 2, 4, 8], np.uint8)[np.where(word, kinds, 0)], starts)
        length = ends - starts
        of_text = np.searchsorted(offsets, starts, side="right") - 1
        codes = self.plain[held >> 1, np.searchsorted(LENGTHS, length, side="right")]
        classes = np.full(len(starts), CLASS["word"])
        alone = single[starts] | ((held == 8) & (length == 1))
        which = np.where(single[starts], kinds[starts].astype(np.int64) - 5, len(MARKS))[alone]
        codes[alone], classes[alone] = self.single[which], self.single_class[which]
        digits = np.nonzero(held & 1)[0]
        codes[digits] = self._digit_codes([whole[a:b] for a, b in zip(starts[digits].tolist(), ends[digits].tolist())])
        classes[digits] = CLASS["digits"]
        found = [offsets[i] + m.start() for i in np.nonzero(keyed)[0].tolist() for m in KEY.finditer(texts[i])]
        if found:
            classes[np.searchsorted(starts, found, side="right") - 1] = CLASS["key"]
        # three places before and two after each text's tokens stand for its edges
        at = np.arange(len(starts)) + 3 + 5 * of_text
        around = np.full(len(starts) + 5 * len(texts), CLASS["</s>"])
        first = np.searchsorted(of_text, np.arange(len(texts))) + 5 * np.arange(len(texts))
        around[(first[:, None] + np.arange(3)).ravel()] = CLASS["<s>"]
        around[at] = classes
        n = len(CLASSES)
        b1, b2, b3 = around[at - 1], around[at - 2], around[at - 3]
        score = self.before[(b3 * n + b2) * n + b1] + self.after[around[at + 1] * n + around[at + 2]] + self.own[codes, b1]
        key = CLASS["key"]
        score += np.where((b1 == key) | (b2 == key) | (b3 == key), 1.0, 0.0)[:, None] * self.keyed[codes]
        of_file: dict[int, list[str]] = {}
        for i in digits.tolist():
            t = int(of_text[i])
            if t not in of_file:
                of_file[t] = file_features(texts[t])
            name = self.features[codes[i]][2]
            score[i] += self.lift(*(f"{name}|{f}" for f in of_file[t]))
        return starts - offsets[of_text], ends - offsets[of_text], of_text, score

    def _viterbi(self, score: np.ndarray, closed: bool) -> list[int]:
        """Best tags of a run of tokens whose neighbours are outside; ``closed`` if one follows."""
        moves = (self.moves - self.moves[OUT, OUT]).tolist()
        best, back = [moves[OUT][OUT], moves[OUT][BEGIN] + score[0][0], -math.inf], []
        for begin, inside in score[1:].tolist():
            come = [max(range(3), key=lambda s, to=to: (best[s] + moves[s][to], -s)) for to in range(3)]
            best = [best[come[to]] + moves[come[to]][to] + (0.0, begin, inside)[to] for to in range(3)]
            back.append(come)
        last = [b + (moves[t][OUT] if closed else 0.0) for t, b in enumerate(best)]
        tags = [max(range(3), key=lambda t: (last[t], -t))]
        for come in reversed(back):
            tags.append(come[tags[-1]])
        return tags[::-1]

    def tagged(self, texts: list[str], keyed: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """(start, end, tag) of every token of each text that the best path does not leave outside."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        starts, ends, of_text, score = self.scores(texts, keyed)
        if not len(starts):
            return out
        gain = (score + self.enter).max(axis=1)
        # runs end with their text: a wall between texts that no run is worth passing
        walls = np.nonzero(np.diff(of_text))[0] + 1
        padded = np.insert(gain, walls, -1e6)
        to = np.concatenate(([0.0], np.cumsum(padded)))
        left = to - np.minimum.accumulate(to)  # best run that ends before each place
        right = np.maximum.accumulate(to[::-1])[::-1] - to  # best run that begins at each place
        place = np.arange(len(gain)) + np.searchsorted(walls, np.arange(len(gain)), side="right")
        open_ = gain + left[place] + right[place + 1] + self.leave >= -1e-6
        hot = np.nonzero(open_)[0]
        for run in np.split(hot, np.nonzero((np.diff(hot) > 1) | (np.diff(of_text[hot]) > 0))[0] + 1) if len(hot) else []:
            t, last = int(of_text[run[0]]), int(run[-1]) + 1
            closed = last < len(of_text) and of_text[last] == t
            for i, tag in zip(run.tolist(), self._viterbi(score[run], closed)):
                if tag != OUT:
                    out[t].append((int(starts[i]), int(ends[i]), tag))
        return out

    def spans(self, texts: list[str], needs_base: np.ndarray, keyed: np.ndarray) -> list[list[tuple[int, int, str]]]:
        """Base spans of each text, then those that the field adds: tagged runs of LEAST characters or more that no base span touches."""
        out = []
        for text, has_base, tags in zip(texts, needs_base, self.tagged(texts, keyed)):
            base = base_spans(text) if has_base else []
            runs: list[list[int]] = []
            for start, end, tag in tags:
                if tag == BEGIN:
                    runs.append([start, end])
                else:
                    runs[-1][1] = end
            added = []
            for start, end in runs:
                while text[end : end + 1] == "=" and text[end - 2 : end] != "==":  # padding belongs to what it pads
                    end += 1
                if end - start >= LEAST and not any(a < end and b > start for a, b, _ in base):
                    added.append((start, end, "crf"))
            out.append(base + added)
        return out


def field_spans(text: str, field: Field) -> list[tuple[int, int, str]]:
    """All spans of one text."""
    return Scanner(field).spans([text], np.array([True]), np.array([True]))[0]


def training_sample(docs: DataFrame, rows: int = TRAIN_ROWS, sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, list[tuple[int, int]]]]:
    """Stretches, with the secrets in them, of at most ``rows`` texts with base matches and ``rows`` without, among the ``sample_rows`` of least hash.

    Hashes alone are ranked; then those few texts are read, and STRETCHES of
    STRETCH_CHARS characters at most of each reach the driver.
    """
    hashed = docs.select(F.xxhash64("text").alias("h")).orderBy("h").limit(sample_rows).distinct()

    @F.pandas_udf("array<struct<text:string,spans:array<array<int>>>>")
    def parts(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            found = []
            values = secret_values(text or "")
            for tokens in stretches(text or ""):
                left, right = tokens[0].start(), min(tokens[-1].end(), tokens[0].start() + STRETCH_CHARS)
                own = [[a - left, b - left] for a, b in values if a >= left and b <= right]
                found.append((not own, len(found), {"text": text[left:right], "spans": own}))
            out.append([p for _, _, p in sorted(found, key=lambda f: f[:2])[:STRETCHES]])
        return pd.Series(out, dtype=object)

    # at most sample_rows hashes are broadcast
    found = docs.select(F.xxhash64("text").alias("h"), "text").join(F.broadcast(hashed), "h").groupBy("h").agg(F.first("text").alias("text"))
    found = found.select("h", parts("text").alias("parts")).where("size(parts) > 0").withColumn("base", F.exists("parts", lambda p: F.size(p["spans"]) > 0))
    picked = [found.where(c).orderBy("h").limit(rows).collect() for c in ("base", "not base")]
    return [(p["text"], [tuple(s) for s in p["spans"]]) for r in picked[0] + picked[1] for p in r["parts"]]


def scan(docs: DataFrame, field: Field | None = None, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``docs`` plus ``secrets``: array of (start, end, kind), base spans by start and then those that the field adds.

    Null and empty texts have none; repeated rows get equal results; an empty
    table gives an empty result; other columns pass through, but a column
    named secrets, which gives way.
    """
    field = field or train(made_examples() + training_sample(docs, train_rows))
    shared = docs.sparkSession.sparkContext.broadcast(field)

    @F.pandas_udf("array<struct<start:long,end:long,kind:string>>")
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(shared.value)
        for texts in batches:
            column = pa.array(texts, pa.large_string(), from_pandas=True).fill_null("")
            has_base = pc.match_substring_regex(column, BASE_NEEDS).to_numpy(zero_copy_only=False)
            has_key = pc.match_substring_regex(column, KEY_NEEDS, ignore_case=True).to_numpy(zero_copy_only=False)
            whole = ["" if t is None else t for t in texts]
            blocks = np.cumsum([len(t) for t in whole]) // BLOCK_CHARS
            out = []
            for rows in np.split(np.arange(len(whole)), np.nonzero(np.diff(blocks))[0] + 1) if len(whole) else []:
                for found in scanner.spans([whole[i] for i in rows], has_base[rows], has_key[rows]):
                    out.append([{"start": a, "end": b, "kind": k} for a, b, k in found])
            yield pd.Series(out, dtype=object)

    return docs.withColumn("secrets", spans("text"))
