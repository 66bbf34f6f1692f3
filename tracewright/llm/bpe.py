"""BPE encoding by backtracking, and decoding by an offset table.

A word's longest matching tokens come from one Aho-Corasick pass. They are tried left to right, longest first; a token
may follow another only if the pair is compatible (merging their joint text gives exactly that pair), and a position
that led nowhere is not entered again. The first sequence that reaches the end is the one that merging in rank order
gives, because every adjacent pair of it is compatible and no other sequence has that property.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.session import lean

#: Marks a word's end inside this module; the byte alphabet has no such character.
_END = "\0"
#: Characters of the words remembered by a worker (some 80 MB); of these the half that is older goes at once, but for
#: words that were seen again. Longer words are not remembered.
_REMEMBERED, _LONGEST = 2_000_000, 64


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out, extra = {}, 256
    for b in range(256):
        out[b] = chr(b) if b in shown else chr(extra)
        extra += b not in shown
    return [out[b] for b in range(256)]


class _Known(dict):
    """Ids of words seen before; a memory bounded by their length, not their number."""

    def __init__(self, of):
        super().__init__()
        self.of, self.size, self.older = of, 0, {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.older.get(word)
        if ids is None:
            ids = self.of(word)
        if len(word) <= _LONGEST:
            if 2 * self.size >= _REMEMBERED:
                self.older = dict(self)
                self.clear()
                self.size = 0
            self[word] = ids
            self.size += len(word)
        return ids


class WordBpe:
    """The tokenizer of a vocabulary file with word ends (`end_of_word_suffix`), byte-level, lower-casing."""

    def __init__(self, spec: str):
        j = json.loads(spec)
        model = j["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {(self.vocab[a], self.vocab[b]): k for k, (a, b) in enumerate(pairs)}
        #: How each token is made: (rank, left, right); base tokens are absent.
        self.made = {}
        text: dict[int, str] = {}
        alphabet = byte_alphabet()
        for c in alphabet:
            for t, s in ((c, c), (c + self.suffix, c + _END)):
                if t in self.vocab:
                    text[self.vocab[t]] = s
        for k, (a, b) in enumerate(pairs):
            t = self.vocab[a + b]
            if t not in self.made and t not in text:
                self.made[t] = (k, self.vocab[a], self.vocab[b])
                text[t] = text[self.vocab[a]] + text[self.vocab[b]]
        self._compatible: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for t, s in text.items():
            if t not in self.made or self._self_made(t):
                self.automaton.add_word(s, (len(s), t))
        self.automaton.make_automaton()
        of = {s: t for t, s in text.items() if t not in self.made or self._self_made(t)}
        #: The longest proper prefix of each token that is a token: (size, token) or None.
        self.shorter = {t: next(((n, of[s[:n]]) for n in range(len(s) - 1, 0, -1) if s[:n] in of), None) for s, t in of.items()}
        self.alphabet = alphabet
        self.specials = {a["content"]: a["id"] for a in j["added_tokens"]}
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        pattern = j["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern)
        # decoding: token strings one after the other, and where each begins
        by_id = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.specials.items()}
        strings = [by_id.get(i, "").encode() for i in range(max(by_id) + 1)]
        self.offsets = np.concatenate([[0], np.cumsum([len(s) for s in strings])]).astype(np.int64)
        self.blob = np.frombuffer(b"".join(strings), np.uint8)
        self.ascii_words = re.compile(pattern.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9"), re.ASCII)
        self.known = _Known(self.word)

    # -- encoding ------------------------------------------------------------------------------------------------
    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the joint text of a and b in rank order ends with just these two tokens."""
        key = a << 32 | b
        if (known := self._compatible.get(key)) is not None:
            return known
        limit = len(self.rank)
        ok = True
        while True:
            if self.rank.get((a, b), limit) < limit:  # the two would have merged before the last step undone so far
                ok = False
                break
            x, y = self.made.get(a), self.made.get(b)
            # undo the later of the two merges; of equal ones, the right one was made last
            if x is not None and (y is None or x[0] > y[0]):
                limit, a = x[0], x[2]
            elif y is not None:
                limit, b = y[0] + 1, y[1]
            else:
                break
        if len(self._compatible) > 1_000_000:
            self._compatible.clear()
        self._compatible[key] = ok
        return ok

    def _self_made(self, t: int) -> bool:
        """Whether a token's own text merges to it: its halves must be compatible up to the merge that joins them."""
        k, a, b = self.made[t]
        limit, x, y = k, a, b
        while True:
            p, q = self.made.get(x), self.made.get(y)
            if p is not None and (q is None or p[0] > q[0]):
                limit, x = min(limit, p[0]), p[2]
            elif q is not None:
                limit, y = min(limit, q[0] + 1), q[1]
            else:
                return all(h not in self.made or self._made_once(h) for h in (a, b))
            if self.rank.get((x, y), limit) < limit:
                return False

    def _made_once(self, t: int) -> bool:
        if t not in self._checked:
            self._checked[t] = self._self_made(t)
        return self._checked[t]

    @property
    def _checked(self) -> dict[int, bool]:
        return self.__dict__.setdefault("_checked_tokens", {})

    def word(self, raw: str) -> tuple[int, ...]:
        """Ids of one pre-tokenised word."""
        s = (raw if raw.isascii() and raw.isalpha() else "".join([self.alphabet[b] for b in raw.encode("utf-8")])) + _END
        # of one start, longer matches end later: the last one seen is the longest
        longest = {end - x[0]: x for end, x in self.automaton.iter(s)}
        known, shorter, path, closed = self._compatible, self.shorter, [], set()
        at, last, stop, x = -1, -1, len(s) - 1, longest.get(-1)
        while at < stop:
            while x is not None:
                size, t = x
                if at + size not in closed:
                    if last < 0:
                        break
                    ok = known.get(last << 32 | t)
                    if self.compatible(last, t) if ok is None else ok:
                        break
                x = shorter[t]
            if x is not None:
                path.append(x)
                at += size
                last = t
                x = longest.get(at)
            else:
                if not path:
                    raise ValueError(f"no tokens for {raw!r}")
                closed.add(at)
                size, t = path.pop()
                at -= size
                last = path[-1][1] if path else -1
                x = shorter[t]
        return tuple([t for _, t in path])

    def _pieces(self, text: str) -> Iterator[tuple[str, bool]]:
        if self.special is None:
            yield text, False
            return
        for k, part in enumerate(self.special.split(text)):
            if part:
                yield part, bool(k % 2)

    def encode(self, text: str) -> list[int]:
        """The ids that the vocabulary's own library gives without adding special tokens."""
        out: list[int] = []
        for part, special in self._pieces(text):
            if special:
                out.append(self.specials[part])
            else:
                out += itertools.chain.from_iterable(map(self.known.__getitem__, self._split(part)))
        return out

    def _split(self, part: str) -> list[str]:
        """The pre-tokenised words. White space separates them and never belongs to one, so runs of it need no folding."""
        if part.isascii():
            return self.ascii_words.findall(part.lower())
        # capital sigma is lowered without regard to its place
        part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
        return self.words.findall(part)

    # -- decoding ------------------------------------------------------------------------------------------------
    def decode(self, ids: np.ndarray) -> bytes:
        """Token strings joined by one space, gathered from the blob by offset (UTF-8)."""
        if not len(ids):
            return b""
        lo, size = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        to = np.cumsum(size + 1) - size - 1
        out = np.full(int(to[-1] + size[-1]), 32, np.uint8)
        step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(to, size) + step] = self.blob[np.repeat(lo, size) + step]
        return out.tobytes()


_LOADED: dict[str, WordBpe] = {}


def _of(spec: str) -> WordBpe:
    key = hashlib.sha1(spec.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = WordBpe(spec)
    return _LOADED[key]


def _runner(broadcast, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _of(broadcast.value)
        for b in batches:
            n, ids_sha, back_sha, every = [], [], [], []
            for t in b.column(1):
                ids = np.array(bpe.encode(t.as_py() or ""), np.int64)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                back_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                every.append(ids.astype(np.int32) if "ids" in columns else None)
            cols = {"doc_id": b.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(back_sha, pa.string())}
            if "ids" in columns:
                cols["ids"] = pa.array(every, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([cols[c] for c in columns], names=columns)

    return run


def bpe_encode(docs: DataFrame, vocabulary: str, with_ids: bool = False) -> DataFrame:
    """Encode and decode every text: doc_id, n_tokens, ids_sha256, decoded_sha256[, ids], one row per row.

    vocabulary: path of the tokenizer file, read on the driver (its size is fixed, about 1.7 MB) and broadcast.
    Defined cases: a null text is empty and has no tokens; repeated rows are each encoded; a null doc_id stays null;
    other columns are not read. A very long word costs linear time. No shuffle: a lost executor's part is redone.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    columns = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(lean(_runner(spec, columns)), schema)
