"""Language ID by unigrams over a fixed public piece vocabulary, marginalised over segmentations.

A language is a probability for each piece. A word's likelihood is the sum over *all* ways to cut
it into pieces, by the forward algorithm; a text's likelihood is the product over its words (runs
of letters, lower-cased, with a word-start mark). Probabilities come from a few rounds of
expectation-maximisation: forward-backward gives each piece's expected count in the labelled
words, and the counts are added up per language over all partitions.

The classifier is fitted on a bounded sample of labelled rows, ``SAMPLE_DOCS`` (chosen by a hash of
the id); everything else covers every row and its whole text.

Edge cases: a text that is null or has no letter is ``und`` with score 0; equal likelihoods go to
the language that sorts first; if no row is labelled, every text is ``und``; an empty table gives
an empty result; further columns are ignored. Words of any length are
read whole; only for fitting are those over ``WORD`` letters cut into parts.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, mix64, nullable, resident, written
from .tokens import in_slices

SAMPLE_DOCS = 20_000  # bound on the labelled rows that are used for fitting
ROUNDS = 2
PIECE = 10  # longest piece, in characters
WORD = 24
FLOOR = 1e-8  # probability of a character or piece that a language has not shown
CACHED_WORDS = 300_000  # per worker
NEW_WORDS = 5_000  # whose lattices are made at a time

_LETTERS = re.compile(r"[^\W\d_]+")
START = "▁"


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    pieces: dict[str, int]
    prob: np.ndarray  # (pieces + 1, languages); the last row is for unknown characters
    prior: np.ndarray  # log

    def __len__(self) -> int:
        return len(self.languages)


def vocabulary(model_file: str) -> dict[str, int]:
    """Pieces of letters, optionally after the word-start mark, numbered from 0."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    found = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    good = sorted({p for p in found if len(p) <= PIECE and p == p.lower() and (p == START or p.removeprefix(START).isalpha())})
    return {p: k for k, p in enumerate(good)}


def words(text: str | None) -> list[str]:
    """Runs of letters, lower-cased; numbers such as ½ or ² are none."""
    found = _LETTERS.findall((text or "").lower())
    if not all(map(str.isalpha, found)):
        found = [part for w in found for part in "".join(c if c.isalpha() else " " for c in w).split()]
    return found


_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_index: dict[int, tuple[dict[str, int], np.ndarray, np.ndarray]] = {}


def _spans(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length up to ``PIECE``: (length, text number, start, 64-bit value) of all spans of the texts, which are not empty."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), sizes)
    start = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at, value, rest = np.arange(len(codes)), np.zeros(len(codes), np.uint64), sizes[owner] - start
    for n in range(1, PIECE + 1):
        more = rest[at] >= n
        at, value = at[more], value[more]
        value = value * _FACTOR + codes[at + n - 1]
        yield n, owner[at], start[at], mix64(value)


def _table(pieces: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The pieces' values in order, and their numbers; kept for the vocabulary in use."""
    if id(pieces) not in _index:
        names = list(pieces)
        size = np.fromiter(map(len, names), np.int64, len(names))
        value = np.zeros(len(names), np.uint64)
        for n, owner, start, v in _spans(names):
            whole = (start == 0) & (size[owner] == n)
            value[owner[whole]] = v[whole]
        order = np.argsort(value)
        _index.clear()
        _index[id(pieces)] = pieces, value[order], np.fromiter(pieces.values(), np.int64, len(names))[order]
    return _index[id(pieces)][1:]


def edges(new: list[str], pieces: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The piece lattice of words: (word, from, to, piece), ordered by to, then word.

    All spans of all words are looked up by 64-bit values at once.
    """
    values, names = _table(pieces)
    out = []
    for n, word, start, v in _spans([START + w for w in new]):
        at = np.minimum(np.searchsorted(values, v), len(values) - 1)
        known = values[at] == v if len(values) else np.zeros(len(v), bool)
        piece = np.where(known, names[at] if len(values) else 0, len(pieces))
        keep = known if n > 1 else np.ones(len(v), bool)
        out.append(np.stack((start[keep] + n, word[keep], start[keep], piece[keep])))
    table = np.concatenate(out, axis=1)
    table = table[:, np.lexsort((table[1], table[0]))]
    return table[1], table[2], table[0], table[3]


def _sums(lattice: tuple[np.ndarray, ...], n_words: int, prob: np.ndarray, back: bool = False) -> np.ndarray:
    """Forward (or backward) sums, (word, position, language)."""
    word, i, j, piece = lattice
    sums = np.zeros((n_words, WORD + 2, prob.shape[1]))
    if back:
        order = np.lexsort((word, -i))
        word, i, j, piece = word[order], j[order], i[order], piece[order]  # edges run from right to left
        last = np.zeros(n_words, np.int64)
        np.maximum.at(last, word, i)
        sums[np.arange(n_words), last] = 1
    else:
        sums[:, 0] = 1
    if not len(word):
        return sums
    cut = np.flatnonzero(np.r_[True, (j[1:] != j[:-1])])
    for a, b in zip(cut, [*cut[1:], len(j)], strict=True):
        first = np.flatnonzero(np.r_[True, word[a + 1 : b] != word[a : b - 1]]) + a
        sums[word[first], j[a]] = np.add.reduceat(sums[word[a:b], i[a:b]] * prob[piece[a:b]], first - a)
    return sums


def _of_long_word(word: str, model: LanguageModel) -> np.ndarray:
    """Per language the log of the sum over all segmentations; only the last ``PIECE`` sums are held, scaled anew at each place."""
    s, get = START + word, model.pieces.get
    sums, scale = [np.ones(len(model))], np.zeros(len(model))
    for j in range(1, len(s) + 1):
        here, first = np.zeros(len(model)), max(0, j - PIECE)
        for k, i in enumerate(range(first, j), len(sums) - (j - first)):
            p = get(s[i:j])
            if p is not None or j == i + 1:
                here += sums[k] * model.prob[-1 if p is None else p]
        scale += np.log(here)
        sums = [x / here for x in sums[-PIECE + 1 :]] + [np.ones(len(model))]
    return scale


def log_likelihoods(new: list[str], model: LanguageModel) -> np.ndarray:
    """(word, language): log of the sum over all segmentations."""
    long = [k for k, w in enumerate(new) if len(w) > WORD]
    if long:
        out = np.empty((len(new), len(model)))
        short = np.setdiff1d(np.arange(len(new)), long)
        out[short] = log_likelihoods([new[k] for k in short], model) if len(short) else 0
        for k in long:
            out[k] = _of_long_word(new[k], model)
        return out
    total = _sums(edges(new, model.pieces), len(new), model.prob)
    ends = np.fromiter((len(w) + 1 for w in new), np.int64, len(new))
    return np.log(np.maximum(total[np.arange(len(new)), ends], 1e-300))


def expected_counts(counted: DataFrame, model: LanguageModel) -> DataFrame:
    """(lang, piece, n): expected piece counts of the words in (lang, word, n)."""
    shared = counted.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        total = np.zeros_like(m.prob)
        for pdf in batches:
            lang = np.searchsorted(m.languages, pdf["lang"].to_numpy())
            times = pdf["n"].to_numpy(np.float64)
            new = pdf["word"].tolist()
            lattice = edges(new, m.pieces)
            ahead, behind = _sums(lattice, len(new), m.prob), _sums(lattice, len(new), m.prob, back=True)
            word, i, j, piece = lattice
            own = lang[word]
            share = ahead[word, i, own] * m.prob[piece, own] * behind[word, j, own] / np.maximum(behind[word, 0, own], 1e-300)
            np.add.at(total, (piece, own), share * times[word])
        at, lang = np.nonzero(total)
        yield pd.DataFrame({"lang": np.asarray(m.languages, object)[lang], "piece": at, "n": total[at, lang]})

    return counted.mapInPandas(count, "lang string, piece long, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, model_file: str, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE_DOCS, rounds: int = ROUNDS) -> LanguageModel:
    """Fit on about ``sample`` labelled rows. What reaches the driver is bounded by vocabulary times languages."""
    per_lang = {r["lang"]: r["n"] for r in labelled.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).where("lang is not null").collect()}
    languages, total = tuple(sorted(per_lang)), sum(per_lang.values())
    pieces = vocabulary(model_file)
    flat = np.full((len(pieces) + 1, len(languages)), 1.0 / (len(pieces) + 1))
    flat[-1] = FLOOR
    prior = np.log(np.array([per_lang[x] for x in languages], float) / max(total, 1))
    model = LanguageModel(languages, pieces, flat, prior)
    if not languages:
        return model
    share = min(1.0, sample / total)
    drawn = labelled.where(F.col(lang_col).isNotNull() & (F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 20)) < int(share * (1 << 20))))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                seen.update((lang, w[k : k + WORD]) for w in words(text) for k in range(0, len(w), WORD))
            if len(seen) > 200_000:
                yield pd.DataFrame([(a, w, n) for (a, w), n in seen.items()], columns=["lang", "word", "n"])
                seen.clear()
        yield pd.DataFrame([(a, w, n) for (a, w), n in seen.items()], columns=["lang", "word", "n"])

    counted = written(
        drawn.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInPandas(split, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")),
        "words",
    )
    for _ in range(rounds):
        prob = np.zeros((len(pieces) + 1, len(languages)))
        for r in expected_counts(counted, model).toLocalIterator():
            prob[r["piece"], languages.index(r["lang"])] = r["n"]
        prob = (prob + 0.01) / (prob + 0.01).sum(axis=0)
        prob[-1] = FLOOR
        model = LanguageModel(languages, pieces, np.maximum(prob, FLOOR), prior)
    dropped(counted)
    return model


class _Scorer:
    """A worker's words and their likelihoods."""

    def __init__(self, model: LanguageModel):
        self.model, self.at, self.rows = model, {}, np.empty((0, len(model)))

    def __call__(self, texts: list[str]) -> list[tuple[str, float]]:
        found = [words(t) for t in texts]
        if len(self.at) > CACHED_WORDS:
            self.at, self.rows = {}, self.rows[:0]
        new = [w for w in set().union(*found) if w not in self.at]
        for k in range(0, len(new), NEW_WORDS):
            part = new[k : k + NEW_WORDS]
            self.at.update(zip(part, range(len(self.at), len(self.at) + len(part)), strict=True))
            self.rows = np.concatenate((self.rows, log_likelihoods(part, self.model)))
        out = []
        for own in found:
            if not own or not len(self.model):
                out.append(("und", 0.0))
                continue
            log = self.model.prior + self.rows[np.fromiter(map(self.at.__getitem__, own), np.int64, len(own))].sum(axis=0)
            p = np.exp(log - log.max())
            best = int(np.argmax(log))
            out.append((self.model.languages[best], float(p[best] / p.sum())))
        return out


def _scorer(key: bytes, model: Broadcast) -> _Scorer:
    """This worker's scorer of a model."""
    return resident(("scorer", key), lambda: _Scorer(model.value))


def predicted(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score; only the text is read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = dict(docs.dtypes)
    key = hash((model.languages, model.prob.tobytes()))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = _scorer(key, shared)
        for pdf in batches:
            found = [x for _, texts in in_slices(pdf[text_col].tolist()) for x in scorer(texts)]
            yield nullable(pdf, kinds).assign(lang_pred=[x[0] for x in found], score=[x[1] for x in found])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInPandas(score, f"{schema}, lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def identified(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: id, held_out, lang_pred, score; learned from the rows not held out."""
    model = fit(docs.where(~F.coalesce(held_out(id_col), F.lit(False))), model_file, text_col, lang_col, id_col)
    read = docs.select(F.col(id_col), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return predicted(read, model).drop("text")
