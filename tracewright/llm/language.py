"""Language identification as mixture inference.

Each language has a distribution over byte trigrams. A document is a mixture of languages: expectation-maximisation over
its words estimates the proportions, for language sets that grow from the likeliest one; a set's log-likelihood is
penalised by the number of its languages, and the best set stands.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.sampling import held_out, labelled_texts

#: Rows of each language that the model is fitted on (parameter of the fit alone).
SAMPLE_ROWS = 1000
_BITS = 16
_LETTER = re.compile(r"[^\W\d_]")
#: ASCII letters lower-cased, other ASCII to space, bytes of longer characters kept.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_ROUNDS, _MORE_ROUNDS = 6, 4
_WORDS_AT_ONCE = 50_000


def _units(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Trigram numbers of a text's words (each between two spaces), and where each word's trigrams begin."""
    raw = b" ".join((b" " + text.lower().encode("utf-8", "surrogatepass").translate(_FOLD) + b" ").split())
    if not raw:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    b = np.frombuffer(b" " + raw + b" ", np.uint8)
    gram = (b[:-2].astype(np.uint32) << 16) | (b[1:-1].astype(np.uint32) << 8) | b[2:]
    slot = ((gram * np.uint32(2654435761)) >> np.uint32(32 - _BITS)).astype(np.int64)
    return slot, np.flatnonzero(b[:-2] == 32)


def count_trigrams(rows: Iterable[tuple[str, str]]) -> dict[str, np.ndarray]:
    """Trigram counts of each language; texts without a letter teach nothing."""
    out: dict[str, np.ndarray] = {}
    for lang, text in rows:
        if text and _LETTER.search(text):
            slot, _ = _units(text)
            out[lang] = out.get(lang, 0) + np.bincount(slot, minlength=1 << _BITS)
    return out


class Mixture:
    """Trigram log-likelihoods of the languages, and the inference."""

    def __init__(self, langs: list[str], table: np.ndarray):
        self.langs, self.table = langs, table

    @classmethod
    def fit(cls, rows: Iterable[tuple[str, str]]) -> Mixture:
        """From (lang, text)."""
        return cls.of(count_trigrams(rows))

    @classmethod
    def of(cls, counts: dict[str, np.ndarray]) -> Mixture:
        """From each language's trigram counts; add-half smoothing."""
        langs = sorted(counts)
        table = np.column_stack([counts[x] for x in langs]) + 0.5 if langs else np.zeros((1 << _BITS, 0))
        return cls(langs, np.log(table / table.sum(0)).astype(np.float32))

    def words(self, text: str) -> np.ndarray:
        """Log-likelihood of each word under each language."""
        slot, start = _units(text)
        if not len(start):
            return np.zeros((0, len(self.langs)), np.float32)
        return np.add.reduceat(self.table.take(slot, axis=0), start, axis=0)

    def infer(self, score: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
        """Proportions (docs x languages) of the chosen sets; score: words x languages; doc: each word's document, sorted."""
        k = len(self.langs)
        out = np.zeros((docs, k))
        if not len(doc) or not k:
            return out
        lo = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        have = doc[lo]
        score = np.ascontiguousarray(score.T)  # languages x words: each pass runs along memory
        like = np.exp(score - score.max(0)).astype(np.float64)
        full, _ = _em(like, lo, np.full((k, len(lo)), 1.0 / k), _ROUNDS)
        rank = np.argsort(np.argsort(-full, axis=0, kind="stable"), axis=0, kind="stable")
        best = (rank == 0).astype(float)
        n = np.diff(np.r_[lo, like.shape[1]]).astype(float)
        # no set can gain more than the sum of what each word gains under its own best language
        _, best_fit = _em(like, lo, best, 0)
        open_ = np.flatnonzero(-best_fit > 1.0 + np.log(n + 1.0))
        for size in range(2, k + 1):
            if not len(open_):
                break
            word = np.repeat(np.isin(np.arange(len(lo)), open_), n.astype(int))
            part, starts = np.ascontiguousarray(like[:, word]), np.r_[0, np.cumsum(n[open_]).astype(int)[:-1]]
            pi = np.where(rank[:, open_] < size, np.maximum(full[:, open_], 1e-6), 0.0)
            pi, ll = _em(part, starts, pi / pi.sum(0), _MORE_ROUNDS)
            fit = ll - (size - 1) * (1.0 + np.log(n[open_] + 1.0))
            better = fit > best_fit[open_]
            best[:, open_[better]], best_fit[open_[better]] = pi[:, better], fit[better]
            open_ = open_[better]  # a set that did not pay is not grown further
        out[have] = best.T
        return out


def _em(like: np.ndarray, lo: np.ndarray, pi: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (languages x documents) after some rounds, and each document's log-likelihood under them."""
    size = np.diff(np.r_[lo, like.shape[1]])
    of = np.repeat(np.arange(len(lo)), size)
    for _ in range(rounds):
        joint = like * pi[:, of]
        joint /= np.maximum(joint.sum(0), 1e-300)
        pi = np.add.reduceat(joint, lo, axis=1) / size
    return pi, np.add.reduceat(np.log(np.maximum((like * pi[:, of]).sum(0), 1e-300)), lo)


def _runner(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Mixture(*broadcast.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            pred, score = ["und"] * len(texts), np.zeros(len(texts))
            at = 0
            while at < len(texts):
                found, ids, size, first = [], [], 0, at
                while at < len(texts) and size < _WORDS_AT_ONCE:
                    t = texts[at]
                    if t and _LETTER.search(t):
                        found.append(s := model.words(t))
                        ids.append(np.full(len(s), at - first))
                        size += len(s)
                    at += 1
                if found and model.langs:
                    share = model.infer(np.concatenate(found), np.concatenate(ids), at - first)
                    who = share.argmax(1)
                    for i in {int(x[0]) for x in ids if len(x)}:
                        pred[first + i] = model.langs[who[i]]
                        score[first + i] = min(1.0, float(share[i, who[i]]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, slot, n), summed over the task."""
    rows = ((lang, text) for b in batches for lang, text in zip(b.column(0).to_pylist(), (t.as_py() for t in b.column(1)), strict=True))
    for lang, n in count_trigrams(rows).items():
        slot = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(slot), pa.string()), pa.array(slot.astype(np.int32)), pa.array(n[slot].astype(np.int64))], names=["lang", "slot", "n"])


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Mixture:
    """The model of (doc_id, text, lang); counted by the tasks, so that counts alone come to the driver (65,536 a language)."""
    some = labelled_texts(docs, "lang", sample_rows).select("lang", "text")
    got = some.mapInArrow(_counted, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    lang, slot, n = (got.column(i).to_numpy() for i in range(3))
    return Mixture.of({x: np.bincount(slot[lang == x], n[lang == x], 1 << _BITS) for x in set(lang.tolist())})


def identify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row; the model learns from the rows that are not held out.

    lang, source and doc_id are no inputs of a prediction. Defined cases: a null text, or one without a letter, is
    `und` with score 0, and so is every text if no language was learned; repeated rows each get the same answer; a null
    doc_id is not held out. Other columns are not read. The model (65,536 x languages) is fitted on at
    most `sample_rows` rows a language, texts of any length, and broadcast; its size does not grow with the corpus. No shuffle of texts: a lost executor's part is redone.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = fit(d, sample_rows)
    shared = spark.sparkContext.broadcast((model.langs, model.table))
    return d.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(_runner(shared), "doc_id long, held_out boolean, lang_pred string, score double")
