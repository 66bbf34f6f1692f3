"""Toxicity: a learned lexicon in a trie, Levenshtein automata over it, and context windows around the hits.

The lexicon holds whole words and stems (a stem stands for every word that begins with it; words below it that toxic
texts hold may be misspelled like any other). Automaton states are sets of (trie node, edits, letter due): the
determinised intersection of the trie with the Levenshtein automaton of distance one, in which two neighbouring letters
that changed places are one edit. A word is read once and mostly dies within a few letters. Each hit is weighed by the words around it, so that a quoted or reported
term counts less than one that is thrown at somebody.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.sampling import held_out, labelled_texts, least_hashed
from tracewright.session import lean, stage

#: Rows of each label that the model is fitted on (parameter of the fit alone).
SAMPLE_ROWS = 1500
THRESHOLD = 0.7
#: Least length of a term for which one edit is forgiven, and lengths of stems.
FUZZY_LENGTH, STEM_LENGTHS = 5, (4, 5, 6, 7, 8)
WINDOW = 6
LEXICON_SIZE = 600
_STRIP = " \t\r\n.,;:!?|()[]{}<>\"'`´“”„«»‘’‚…*_~#$%&@+=/\\^-–—"
# Quotation marks, and words that report speech or address somebody (en, de, fr, es).
QUOTES = "\"“”„«»‘’‹›"
REPORTING = frozenset("said says say called calls wrote writes quote quoted quotes claimed word term slur sagte schrieb nannte zitat wort dit écrit appelé mot dijo escribió llamó palabra".split())
ADDRESSING = frozenset("you your you're youre u ur du dich dein ihr tu toi vous ton votre tú usted tus eres".split())

EXACT, STEM, FUZZY = 1, 2, 3


class Lexicon:
    """Words and stems as a trie, read through a lazily determinised Levenshtein automaton."""

    def __init__(self, words: list[str], stems: list[str], fuzzy: list[str], ordinary: list[str]):
        self.words, self.stems, self.fuzzy, self.ordinary = words, stems, fuzzy, frozenset(ordinary)
        self.next: list[dict[str, int]] = [{}]
        self.end = [0]  # 1: a word ends here, 2: a stem, 4: the word may be misspelled
        self.may_err = [False]  # a word below may be misspelled
        for term, mark in [*((w, 1) for w in words), *((s, 2) for s in stems), *((f, 4) for f in fuzzy)]:
            node = 0
            self.may_err[0] |= mark == 4
            for c in term:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.end.append(0)
                    self.may_err.append(False)
                node = self.next[node][c]
                self.may_err[node] |= mark == 4
            self.end[node] |= mark
        self.letters = frozenset("".join([*words, *stems, *fuzzy]))
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.verdict: list[int] = []  # if the word ends in this state
        self.stop: list[int] = []  # EXACT-like verdict that holds whatever follows, or -1 for a dead state
        self.start = self._state(self._closed({(0, 0, "")}))

    def _closed(self, s: set) -> frozenset:
        """With the letters that the writer may have left out."""
        return frozenset(s | {(child, 1, "") for node, e, _ in s if e == 0 and self.may_err[node] for child in self.next[node].values() if self.may_err[child]})

    def _state(self, s: frozenset) -> int:
        if s not in self.states:
            self.states[s] = len(self.sets)
            self.sets.append(s)
            self.moves.append({})
            ended = [(self.end[n], e) for n, e, due in s if not due]
            self.verdict.append(EXACT if any(e == 0 and end & 1 for end, e in ended) else FUZZY if any(end & 4 for end, _ in ended) else 0)
            self.stop.append(STEM if any(e == 0 and end & 2 for end, e in ended) else 0 if s else -1)
        return self.states[s]

    def _move(self, state: int, c: str) -> int:
        out = set()
        for node, e, due in self.sets[state]:
            if due:  # the first of two letters that changed places, read second
                if c == due:
                    out.add((node, 1, ""))
                continue
            if c in self.next[node] and (e == 0 or self.may_err[self.next[node][c]]):
                out.add((self.next[node][c], e, ""))
            if e == 0 and self.may_err[node]:
                out.add((node, 1, ""))
                for first, child in self.next[node].items():
                    if self.may_err[child]:
                        out.add((child, 1, ""))
                        if c in self.next[child] and self.may_err[self.next[child][c]]:
                            out.add((self.next[child][c], 1, first))
        to = self.moves[state][c] = self._state(self._closed(out))
        return to

    def read(self, word: str) -> int:
        """0, EXACT, STEM or FUZZY."""
        state, moves, stop, letters = self.start, self.moves, self.stop, self.letters
        for c in word:
            if c not in letters:
                c = "\0"
            to = moves[state].get(c)
            state = self._move(state, c) if to is None else to
            if stop[state]:
                return max(0, stop[state])
        found = self.verdict[state]
        return 0 if found == FUZZY and word in self.ordinary else found

    # -- documents -----------------------------------------------------------------------------------------------
    def features(self, text: str | None) -> tuple[float, float, float]:
        """Weighed hits of exact terms and stems, of misspelled ones, and the number of hits that were set aside as quoted."""
        tokens = (text or "").lower().split()
        hits = {}
        for t in set(tokens):
            if w := t.strip(_STRIP):
                if kind := self.read(w):
                    hits[t] = kind
        if not hits:
            return 0.0, 0.0, 0.0
        sure = near = quoted = 0.0
        for i, t in enumerate(tokens):
            if t in hits:
                weight = context_weight(tokens, i)
                quoted += weight < 0.5
                if hits[t] == FUZZY:
                    near += weight
                else:
                    sure += weight
        return sure, near, quoted


def context_weight(tokens: list[str], i: int) -> float:
    """How far a hit counts: 1 as it stands, less if it is quoted or reported, whole again if somebody is addressed."""
    around = tokens[max(0, i - WINDOW) : i] + tokens[i + 1 : i + 1 + WINDOW]
    before = "".join(tokens[max(0, i - WINDOW) : i + 1])
    after = "".join(tokens[i : i + 1 + WINDOW])
    marked = any(q in before for q in QUOTES) and any(q in after for q in QUOTES)
    words = {w.strip(_STRIP) for w in around}
    reported = bool(words & REPORTING)
    addressed = bool(words & ADDRESSING)
    if addressed and not (marked and reported):
        return 1.0
    return 0.1 if marked and reported else 0.6 if marked else 0.8 if reported else 1.0


def _minima(text: str) -> list[int]:
    """Eight minima over five-word shingles, as signed 64-bit numbers: near copies have one in common."""
    w = text.lower().split()
    shingles = np.array([xxhash.xxh64_intdigest(" ".join(w[i : i + 5])) for i in range(max(1, len(w) - 4))], np.uint64)
    return [int((shingles * np.uint64(2 * k + 0x9E3779B97F4A7C15)).min().view(np.int64)) for k in range(8)]


def _distinct(minima: list[list[int]]) -> list[int]:
    """Numbers of the texts without near copies of earlier ones."""
    seen, out = set(), []
    for i, m in enumerate(minima):
        mine = set(enumerate(m))
        if not mine & seen:
            out.append(i)
        seen |= mine
    return out


def _terms(words: set[str]) -> set[str]:
    """Whole words (followed by a blank) and stems."""
    return {p for w in words for p in (w + " ", *(w[:n] for n in STEM_LENGTHS if len(w) >= n))}


def _tokens(text: str) -> set[str]:
    """The distinct tokens of a text without the signs around them."""
    return {w for t in set(text.lower().split()) if (w := t.strip(_STRIP))}


def _words(tokens: Iterable[str]) -> set[str]:
    return {w for w in tokens if len(w) >= 3 and any(map(str.isalpha, w))}


def learn(rows: list[tuple[int, str]]) -> tuple[Lexicon, list[float]]:
    """Lexicon and logistic weights from (label, text). Near copies of one text teach once."""
    kept = [r for label in (1, 0) for own in [[(y, t) for y, t in rows if y == label and t]] for r in (own[i] for i in _distinct([_minima(t) for _, t in own]))]
    lexicon = learn_lexicon(*([_tokens(t) for y, t in kept if y == label] for label in (1, 0)))
    return lexicon, _logistic(np.array([lexicon.features(t) for _, t in kept]).reshape(-1, 3), np.array([float(y) for y, _ in kept]))


def learn_lexicon(toxic: list[set[str]], clean: list[set[str]]) -> Lexicon:
    """The lexicon from the tokens of toxic and of clean texts.

    A term must stand in at least three toxic texts, and one in two hundred, at over 50 times the rate of clean ones; a
    stem must stand for at least three words. A stem replaces the longer terms below it, but those stay as words that
    may be misspelled.
    """
    bags = [_words(t) for t in toxic]
    docs: Counter = Counter()
    for bag in bags:
        docs.update(_terms(bag))
    least = max(3, len(toxic) // 200)
    wanted = {w for w, n in docs.items() if n >= least}
    below: dict[str, set] = defaultdict(set)
    for bag in bags:
        for w in bag:
            for n in STEM_LENGTHS:
                if len(w) >= n and w[:n] in wanted and len(below[w[:n]]) < 3:
                    below[w[:n]].add(w)
    wanted = {w for w in wanted if w[-1] == " " or len(below[w]) >= 3}
    ordinary = Counter()
    for t in clean:
        ordinary.update(_terms(_words(t)) & wanted)
    rate = lambda w: math.log((docs[w] + 0.5) / (len(toxic) + 1)) - math.log((ordinary[w] + 0.5) / (len(clean) + 1))
    # terms that clean texts hardly know come first
    pure = {w: ordinary[w] <= len(clean) // 2000 for w in wanted}
    ranked = sorted((w for w in wanted if rate(w) >= math.log(50)), key=lambda w: (not pure[w], -docs[w] * rate(w), len(w), w))[:LEXICON_SIZE]
    # a term stands in the lexicon if it explains toxic texts that stronger terms leave unexplained
    holds: dict[str, set] = {w: set() for w in ranked}
    for i, bag in enumerate(bags):
        for w in _terms(bag) & holds.keys():
            holds[w].add(i)
    words, stems, open_ = [], [], set(range(len(bags)))
    for term in ranked:
        if any(term.startswith(s) for s in stems):
            continue
        if len(holds[term] & open_) >= (least if pure[term] else 4 * least) or pure[term] and docs[term] >= 4 * least:
            (words if term[-1] == " " else stems).append(term.strip())
            open_ -= holds[term]
    words = [w for w in words if not any(w.startswith(s) for s in stems)]
    below_stems = {w for bag in bags for w in bag if docs[w + " "] >= 2 and not ordinary[w + " "] and any(w.startswith(s) for s in stems)}
    fuzzy = [w for w in [*words, *sorted(below_stems)] if len(w) >= FUZZY_LENGTH and w.isalpha()]
    lexicon = Lexicon(words, stems, fuzzy, [])
    # words of clean texts that one edit turns into a term are ordinary; a term that has many such neighbours is taken as it is
    neighbours = Counter()
    for t in clean:
        neighbours.update({w for w in t if lexicon.read(w) == FUZZY})
    beset = {f for f in fuzzy if sum(n for w, n in neighbours.items() if _within_one(w, f)) > 0.002 * max(1, len(clean))}
    fuzzy = [f for f in fuzzy if f not in beset]
    return Lexicon(words, stems, fuzzy, sorted(neighbours))


def _within_one(a: str, b: str) -> bool:
    """Whether one letter put in, left out or replaced, or two neighbours that changed places, lead from a to b."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    swapped = a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :]
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:] or swapped


def _inputs(x: np.ndarray) -> np.ndarray:
    """One hit says nearly all; more say little more."""
    return np.column_stack([np.ones(len(x)), np.minimum(x[:, 0], 1), np.log1p(x[:, 0]), np.minimum(x[:, 1], 1), np.minimum(x[:, 2], 1)])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> list[float]:
    """Weights by Newton steps, halved until they help, with a small ridge around a prior under which one sure hit is enough."""
    prior = np.array([-3.0, 4.5, 0.5, 2.0, -0.5])
    w = prior.copy()
    if not len(y) or y.min() == y.max():
        return w.tolist()
    z = _inputs(x)
    loss = lambda v: float(np.logaddexp(0, z @ v).sum() - y @ (z @ v) + ridge / 2 * ((v - prior) ** 2).sum())
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) + ridge * (w - prior)
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
            step /= 2
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def _scored(broadcast):
    """(keep, held_out[, text]) to (keep, held_out, score, predicted); keep is any column that comes along, a row that holds its text if that is not given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, weights = broadcast.value
        lexicon, w = Lexicon(*parts), np.array(weights)
        for b in batches:
            texts = b.column(2) if b.num_columns > 2 else b.column(0).field("text")
            x = np.array([lexicon.features(t.as_py()) for t in texts]).reshape(-1, 3)
            p = 1 / (1 + np.exp(-np.clip(_inputs(x) @ w, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p, pa.float64()), pa.array((p >= THRESHOLD).astype(np.int32))], names=["keep", "held_out", "score", "predicted"])

    return run


def _noted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, at, text) to (toxic, at, minima, tokens): what the lexicon is learned from, bounded by a text's vocabulary."""
    for b in batches:
        texts = [t.as_py() for t in b.column(2)]
        cols = [b.column(0), b.column(1), pa.array([_minima(t) for t in texts], pa.list_(pa.int64())), pa.array([sorted(_tokens(t)) for t in texts], pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(cols, names=["toxic", "at", "minima", "tokens"])


def _featured(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(*broadcast.value)
        for b in batches:
            x = [lexicon.features(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([list(map(float, f)) for f in x], pa.list_(pa.float64()))], names=["toxic", "at", "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[tuple, list[float]]:
    """The lexicon's parts and the weights, from at most `sample_rows` labelled texts a label, of any length.

    The driver gets the distinct tokens of these texts and three features each, never the texts.
    """
    marks = labels.where(F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    some = labelled_texts(labelled(docs, marks), "toxic", sample_rows).where("text <> ''")
    some = stage(some.select("toxic", F.col("doc_id").alias("at"), "text"), "fit")
    rows = sorted(some.mapInArrow(_noted, "toxic int, at long, minima array<long>, tokens array<string>").collect(), key=lambda r: (r["toxic"], r["at"]))
    kept = [own[i] for label in (1, 0) for own in [[r for r in rows if r["toxic"] == label]] for i in _distinct([r["minima"] for r in own])]
    lexicon = learn_lexicon(*([set(r["tokens"]) for r in kept if r["toxic"] == label] for label in (1, 0)))
    parts = (lexicon.words, lexicon.stems, lexicon.fuzzy, sorted(lexicon.ordinary))
    shared = docs.sparkSession.sparkContext.broadcast(parts)
    taught = {r["at"] for r in kept}
    told = [r for r in some.mapInArrow(_featured(shared), "toxic int, at long, x array<double>").collect() if r["at"] in taught]
    return parts, _logistic(np.array([r["x"] for r in told]).reshape(-1, 3), np.array([float(r["toxic"]) for r in told]))


def score(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for each row; the model learns from labelled rows that are not held out.

    labels: doc_id, toxic (0 or 1); rows with another or no label teach nothing, and of several labels of one id the
    largest counts. lang, source and doc_id are no inputs of a score. Defined cases: a null text is empty and scores as
    a text without hits; without labelled rows the prior weights and an empty lexicon stand; repeated rows score alike;
    a null doc_id is not held out. Other columns are not read. Model size is bounded (at most 600 terms) and broadcast;
    texts are not shuffled, and a lost executor's part is redone.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    got = d.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(_model(d, labels, sample_rows), "keep long, held_out boolean, score double, predicted int")
    return got.withColumnRenamed("keep", "doc_id")


def without_toxic(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of `docs`, whole, that the score does not reject. Each row is judged by its own text, whatever its id.

    Defined cases as in `score`. Rows pass through the scoring tasks, so nothing is joined or shuffled.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = docs.withColumn("text", F.col("text").cast("string")).select(F.struct("*").alias("row"), F.lit(False).alias("held_out"))
    kind = rows.schema["row"].dataType.simpleString()
    got = rows.mapInArrow(lean(_model(d, labels, sample_rows)), f"keep {kind}, held_out boolean, score double, predicted int")
    return got.where("predicted = 0").select("keep.*")


def _model(docs: DataFrame, labels: DataFrame, sample_rows: int):
    return _scored(docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample_rows)))


def labelled(docs: DataFrame, marks: DataFrame, rows: int = 4 * SAMPLE_ROWS) -> DataFrame:
    """Documents with their label, for the fit: a few ids are chosen before any text moves, below a hash that the counts give."""
    open_ = marks.where(~held_out())
    counts = {r["toxic"]: r["count"] for r in open_.groupBy("toxic").count().collect()}
    return docs.join(F.broadcast(least_hashed(open_, "toxic", rows, counts)), "doc_id")
