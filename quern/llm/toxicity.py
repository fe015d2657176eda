"""Toxicity by Levenshtein automata intersected with a lexicon trie, and context windows.

The lexicon (whole terms and word stems) is learned from a bounded sample of
labelled rows of the training folds, added to a short seed list. A word of a
text runs through the trie with one automaton row a node, so all terms within
its edit bound are found at once; each distinct word is looked up once a
worker. Windows around the hits count quotation, report and address, which a
logistic model weighs against the hits themselves.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import labelled_fold, settled_labels

#: Labelled rows of each class that the lexicon and the weights are learned from.
TRAIN_ROWS = 3000
#: Characters of each class that reach the driver, at most.
TRAIN_CHARS = 32_000_000
PREDICT_AT = 0.7
NEAR = 5
REMEMBERED = 300_000
#: Stems are word beginnings of this many letters.
STEM = range(4, 9)

SEED_TERMS = ("idiot", "moron", "stupid", "worthless", "loser", "pathetic", "disgusting", "scum", "imbecile", "dumbass", "asshole", "bastard", "bitch", "retard")
REPORTING = frozenset("said says wrote writes called calls quote quoted quotes quoting term word words slur insult mention mentioned phrase titled headline defined".split())
ADDRESS = frozenset("you your youre yourself u ur du dich dir ihr tu te toi vous eres usted ustedes".split())
QUOTES = frozenset("\"“”„«»‹›‘’`'")
LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})
EDGE = re.compile(r"^[^\w@$]+|[^\w@$]+$")
PLAIN = re.compile(r"[\W_]+$|^[\W_]+")
FEATURES = 8


@dataclass
class Node:
    next: dict[str, Node] = field(default_factory=dict)
    term: bool = False
    stem: bool = False
    edits: int = -1  # most edits that any term below allows


def core(chunk: str) -> str:
    """The word inside a chunk, in lower case, with look-alike characters read as letters."""
    plain = PLAIN.sub("", chunk).lower()
    if plain.isalpha():
        return plain
    word = EDGE.sub("", chunk.lower())
    if not any(c.isalpha() for c in word):
        return ""
    return "".join(c for c in word.translate(LOOKALIKE) if c.isalpha())


#: Edits allowed for any term.
MOST_EDITS = 2


def bound(length: int) -> int:
    """Edits allowed for a term of this many letters."""
    return 0 if length < 5 else 1 if length < 9 else 2


class Lexicon:
    """Trie of terms and stems; ``common`` are clean words that are never read as misspellings."""

    def __init__(self, terms: list[str], stems: list[str], common: frozenset[str] = frozenset()):
        self.root, self.common = Node(), common
        for word, what in [*((t, "term") for t in terms), *((s, "stem") for s in stems)]:
            node = self.root
            allowed = bound(len(word)) if what == "term" else -1
            node.edits = max(node.edits, allowed)
            for c in word:
                node = node.next.setdefault(c, Node())
                node.edits = max(node.edits, allowed)
            setattr(node, what, True)
        # k edits leave one of k + 1 pieces of a term whole: no word without such a piece can be in bound
        self.heads: dict[int, set[str]] = {}
        self.tails: dict[int, set[str]] = {}
        self.middles: dict[int, set[str]] = {}
        for term in terms:
            if edits := bound(len(term)):
                cuts = [len(term) * i // (edits + 1) for i in range(edits + 2)]
                self.heads.setdefault(cuts[1], set()).add(term[: cuts[1]])
                self.tails.setdefault(len(term) - cuts[-2], set()).add(term[cuts[-2] :])
                for i, j in zip(cuts[1:-2], cuts[2:-1]):
                    self.middles.setdefault(j - i, set()).add(term[i:j])

    def match(self, word: str) -> int | None:
        """Least edits to any term (0: itself or a stem), None without a term in bound."""
        node = self.root
        for c in word:
            node = node.next.get(c)
            if node is None:
                break
            if node.stem:
                return 0
        else:
            if node.term and word:
                return 0
        if len(word) < 4 or word in self.common:
            return None
        if (
            any(word[:n] in own for n, own in self.heads.items())
            or any(word[-n:] in own for n, own in self.tails.items())
            or any(word[i : i + n] in own for n, own in self.middles.items() for i in range(len(word) - n + 1))
        ):
            return self._within(word)
        return None

    def _within(self, word: str) -> int | None:
        """Runs the word's Levenshtein automaton over the trie."""
        size, best, over = len(word), None, MOST_EDITS + 1
        stack = [(self.root, 0, [min(i, over) for i in range(size + 1)])]
        while stack:
            node, depth, row = stack.pop()
            if node.term and row[size] <= bound(depth) and (best is None or row[size] < best):
                best = row[size]
            # only places within MOST_EDITS of the diagonal can hold so few edits
            first, last = max(1, depth + 1 - MOST_EDITS), min(size, depth + 1 + MOST_EDITS)
            if first > last:
                continue
            for c, child in node.next.items():
                new = [over] * (size + 1)
                least = new[0] = min(depth + 1, over)
                for i in range(first, last + 1):
                    here = row[i - 1] + (word[i - 1] != c)
                    if row[i] < here:
                        here = min(here, row[i] + 1)
                    if new[i - 1] < here:
                        here = min(here, new[i - 1] + 1)
                    if here < over:
                        new[i] = here
                        if here < least:
                            least = here
                if least <= child.edits:
                    stack.append((child, depth + 1, new))
        return best


class Reader:
    """Features of texts; remembers each distinct chunk's match."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.known: dict[str, int] = {}

    def _look(self, chunk: str) -> int:
        edits = self.lexicon.match(core(chunk))
        self.known[chunk] = found = -1 if edits is None else edits
        return found

    def features(self, text: str | None) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.known = {}
        known, look = self.known, self._look
        chunks = (text or "").split()
        hits = [(i, e) for i, c in enumerate(chunks) if (e := known[c] if c in known else look(c)) >= 0]
        x = np.zeros(FEATURES)
        x[0] = 1
        if hits:
            quoted = reported = addressed = 0
            for i, _ in hits:
                around = chunks[max(0, i - NEAR) : i + NEAR + 1]
                inside = chunks[i]
                before, after = "".join(chunks[max(0, i - NEAR) : i]), "".join(chunks[i + 1 : i + NEAR + 1])
                quoted += (inside[0] in QUOTES or any(c in QUOTES for c in before)) and (inside[-1] in QUOTES or any(c in QUOTES for c in after))
                words = {core(c) for c in around}
                reported += bool(words & REPORTING)
                addressed += bool(words & ADDRESS)
            exact = sum(e == 0 for _, e in hits)
            x[1:] = (
                math.log1p(exact),
                math.log1p(len(hits) - exact),
                math.log1p(len({core(chunks[i]) for i, _ in hits})),
                min(1.0, 20 * len(hits) / len(chunks)),
                quoted / len(hits),
                reported / len(hits),
                addressed / len(hits),
            )
        return x


def learn_lexicon(toxic: list[str], clean: list[str]) -> Lexicon:
    """Words and stems that mark toxic rows: frequent enough in them, and twenty times as frequent as in clean rows."""

    one: dict[str, str] = {}  # equal words of different texts are one string

    def words(text: str) -> set[str]:
        return {one.setdefault(w, w) for c in set(text.split()) if len(w := core(c)) >= 4}

    def grams(ws: set[str]) -> set[str]:
        return {w[:n] for w in ws for n in STEM if len(w) >= n} | {f"{w}$" for w in ws}

    def apart(texts: list[str]) -> list[frozenset[str]]:
        """Word sets, one for all texts of the same words: copies must not make a word look frequent."""
        return list(dict.fromkeys(frozenset(ws) for t in texts if (ws := words(t))))

    toxic, clean = apart(toxic), apart(clean)
    seen: Counter[str] = Counter()
    for ws in toxic:
        seen.update(grams(ws))
    least = max(3, math.ceil(0.02 * len(toxic)))
    found = {g: n for g, n in seen.items() if n >= least}
    del seen
    other: Counter[str] = Counter()
    plain: Counter[str] = Counter()
    for ws in clean:
        other.update(g for g in grams(ws) if g in found)
        plain.update(ws)
    ratio = {g: (n / max(1, len(toxic))) / ((other[g] + 0.5) / max(1, len(clean))) for g, n in found.items()}
    marks = {g for g, r in ratio.items() if r >= 20 and other[g] * 10 <= found[g]}
    terms = sorted({g[:-1] for g in marks if g.endswith("$")} | set(SEED_TERMS))
    stems: list[str] = []
    for g in sorted((g for g in marks if not g.endswith("$")), key=len):
        if not any(g.startswith(s) for s in stems):
            stems.append(g)
    # a stem that only one learned term bears adds nothing to the term
    grown = [s for s in stems if sum(1 for g in found if g.endswith("$") and g.startswith(s)) != 1]
    # of the words of clean rows only those that would be read as misspellings need to be known
    lexicon = Lexicon(terms, grown)
    lexicon.common = frozenset(w for w, n in plain.items() if n >= 2 and lexicon.match(w))
    return lexicon


#: Prior weights: intercept, exact, misspelled, distinct, density, quoted, reported, addressed.
PRIOR_WEIGHTS = np.array([-4.0, 3.0, 1.5, 2.0, 2.0, -2.0, -1.5, 1.0])


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 2.0, rounds: int = 40) -> np.ndarray:
    """Newton steps for logistic regression with a Gaussian prior around PRIOR_WEIGHTS; the first column is the intercept."""
    w = PRIOR_WEIGHTS.copy()
    ridge = penalty * np.eye(x.shape[1])
    ridge[0, 0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ (w - PRIOR_WEIGHTS))
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray

    def scorer(self) -> Reader:
        return Reader(self.lexicon)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Model:
    """Learn from at most ``rows`` toxic and ``rows`` clean labelled rows outside the held-out fold, in hash order of their ids.

    Of each class the first rows of ``chars`` characters in all are taken. Rows
    that repeat a doc_id count once, by their least text; documents whose
    labels disagree are skipped.
    """
    known = settled_labels(labels, "toxic")
    sample = [known.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for t in (1, 0)]
    chosen = sample[0].unionAll(sample[1])
    # at most 2 * rows ids are broadcast
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    so_far = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # 2 * rows rows at most
    got = found.withColumn("so_far", F.sum(F.length("text")).over(so_far)).where(F.col("so_far") <= chars).select("text", "toxic", "doc_id").collect()
    got = sorted(((r["text"], r["toxic"], zlib.crc32(str(r["doc_id"]).encode())) for r in got), key=lambda r: (r[2], r[0]))
    toxic, clean = [t for t, y, _ in got if y == 1], [t for t, y, _ in got if y == 0]
    if not toxic or not clean:
        return Model(Lexicon(list(SEED_TERMS), []), PRIOR_WEIGHTS.copy())
    lexicon = learn_lexicon(toxic, clean)
    reader = Reader(lexicon)
    x = np.array([reader.features(t) for t in toxic + clean])
    y = np.array([1.0] * len(toxic) + [0.0] * len(clean))
    return Model(lexicon, fit_logistic(x, y))


def _scored(docs: DataFrame, model: Model) -> DataFrame:
    """(row, score): every row of ``docs`` as a struct, so that no name of its columns matters, and its score."""
    shared = docs.sparkSession.sparkContext.broadcast((model.lexicon, model.weights))

    @F.pandas_udf("double")
    def toxic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon, weights = shared.value
        reader = Reader(lexicon)
        for texts in batches:
            z = np.array([reader.features(t) for t in texts]).reshape(-1, FEATURES) @ weights
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        # the worker stays for later stages: give back what batches of texts took
        del lexicon, reader
        pa.default_memory_pool().release_unused()

    return docs.select(F.struct(*docs.columns).alias("row"), toxic("text").alias("score"))


def _own(docs: DataFrame, *but: str) -> list:
    return [F.col("row")[c].alias(c) for c in docs.columns if c not in but]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` plus ``score`` (0 to 1) and ``predicted``; columns of these names give way. Null and empty texts have no hits and score low."""
    return _scored(docs, model).select(*_own(docs, "score", "predicted"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labelled: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores for every row of ``docs``: its columns, held_out, score and predicted.

    The model is learned from ``labelled`` (documents) and ``labels``; null and
    conflicting labels are skipped, and an empty table leaves the seed terms
    with fixed weights. Repeated rows get equal scores; other columns pass
    through, but columns named held_out, score or predicted, which give way.
    """
    scored = score(docs.drop("held_out"), train(labelled, labels))
    return scored.withColumn("held_out", F.coalesce(labelled_fold(F.col("doc_id")) == 1, F.lit(False)))


def keep_clean(docs: DataFrame, labelled: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that are not predicted toxic, with their columns as they are."""
    return _scored(docs, train(labelled, labels)).where(F.col("score") < PREDICT_AT).select(*_own(docs))
