"""BPE encoding and decoding: speculate and verify.

A text falls into words at the tokenizer's own pattern. For a word the
longest matches from the left are proposed. A row of tokens is what the merges make of its text if and only
if that holds for each two neighbours, so all distinct neighbours of a batch are tested at once, in arrays:
the merges of the two tokens are undone from the last one back, and no merge across their border may have
come earlier. Words with a failing pair go through the merges one by one. Workers keep the ids of words.

Texts of Latin letters are cut by the pattern itself, other ones first at white space, which no word reaches over;
chunks with other letters go through the library's own normalizer and pattern.

Serves tokenizers of the ``tokenizers`` library that drop white space, work on bytes and mark word ends;
others raise ``ValueError``. Special tokens in a text become their ids, as in the library.

Null and empty texts give no ids and decode to an empty text; null and repeated ids are kept row by row;
other columns are not read; empty tables give empty results; words may be of any length.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import resident

CACHED_WORDS = 600_000  # per worker; later words are encoded each time they come
LONG_WORD = 64  # longer words are not kept
FEW_LETTERS = 24  # up to here the merges of a word are found by looking at all its pairs
CHARS_AT_ONCE = 4_000_000

#: The white space of Unicode.
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNK = re.compile(f"[^{SPACES}]+")
LATIN = "\u0180"  # first code point beyond; below it letters are composed, their classes settled and their small letters in range
_BEYOND = re.compile(f"[^\0-{chr(ord(LATIN) - 1)}]")
_END = "\n"  # stands for the mark of a word's end; no byte is written as a line break
_FREE = int(np.iinfo(np.int64).max)


def byte_letters() -> list[str]:
    """The letter that byte-level tokenizers write for each byte: printable ones themselves, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class SpeculativeBpe:
    """Encodes and decodes with the vocabulary, merges and word pattern of a tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], spec["added_tokens"]
        self._end = model["end_of_word_suffix"] or ""
        steps = [s["type"] for s in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        if not (self._end and steps == ["NFC", "Replace", "Lowercase"] and [s["type"] for s in splits] == ["Split", "ByteLevel"] and splits[0]["invert"] and splits[0]["behavior"] == "Removed"):
            raise ValueError("the tokenizer must drop white space and mark word ends")
        if spec["decoder"] is not None or model["unk_token"] or any(a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] for a in added):
            raise ValueError("decoders, unknown tokens and added tokens with rules of their own are not served")
        self._special = {a["content"]: a["id"] for a in added}
        self._at_special = re.compile("|".join(map(re.escape, sorted(self._special, key=len, reverse=True))) or r"(?!)")
        pattern = splits[0]["pattern"]["Regex"]
        kind = lambda k: "".join(re.escape(chr(c)) for c in range(ord(LATIN)) if unicodedata.category(chr(c))[0] == k)
        for old, new in ((r"\p{L}", kind("L")), (r"\p{N}", kind("N")), (r"\s", r"\t-\r \x85\xa0")):
            pattern = pattern.replace(old, new)
        self._pattern = re.compile(pattern)
        self._letters = byte_letters()
        self._plain = re.compile("[!-~]+")  # bytes that are their own letters

        vocab = {self._inner(t): i for t, i in model["vocab"].items()}
        self.tokens = [""] * (1 + max([*vocab.values(), *self._special.values()]))
        for t, i in (*model["vocab"].items(), *self._special.items()):
            self.tokens[i] = t
        if any(x + e not in vocab for x in byte_letters() for e in ("", _END)):
            raise ValueError("every byte must be a token")
        self._base = {t: i for t, i in vocab.items() if len(t.rstrip(_END)) == 1}
        self._size = len(self.tokens)
        self.made, self.left, self.right = (np.full(self._size, -1, np.int64) for _ in range(3))
        self._merge: dict[int, int] = {}  # two tokens -> rank of their merge, then what it makes, as one number
        for rank, pair in enumerate(model["merges"]):
            a, b = (self._inner(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            self._merge.setdefault(i * self._size + j, rank * self._size + k)
            if self.made[k] < 0 and k not in self._base.values():
                self.made[k], self.left[k], self.right[k] = rank, i, j
        keys = np.fromiter(self._merge, np.int64, len(self._merge))
        order = np.argsort(keys)
        self._keys, self._ranks = keys[order], np.fromiter(self._merge.values(), np.int64, len(keys))[order] // self._size
        good = self._sound(set(self._base.values()))
        self._propose = {t: i for t, i in vocab.items() if good[i]}
        self._longest = max(map(len, self._propose))
        self._named = np.array(self.tokens, object)
        self._known: dict[str, bytes] = {}

    def _inner(self, token: str) -> str:
        return token.removesuffix(self._end) + _END if token.endswith(self._end) else token

    # ------------------------------------------------------------ pairs

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self._size + b
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ranks[at], _FREE)

    def compatible(self, a: np.ndarray, b: np.ndarray, joined: bool = False) -> np.ndarray:
        """Whether each two neighbours stay as they are when their texts are merged together.

        joined: the two are about to be merged themselves; only what came before counts.
        """
        ok, open_ = np.ones(len(a), bool), np.arange(len(a))
        limit = np.full(len(a), _FREE)
        first = joined
        while len(open_):
            if not first:
                across = self._rank(a, b) < limit
                ok[open_[across]] = False
                a, b, limit, open_ = (x[~across] for x in (a, b, limit, open_))
            first = False
            made_a, made_b = self.made[a], self.made[b]
            last = made_a > made_b  # of two equal merges the left one came first
            limit = np.where(last, made_a, made_b + 1)
            more = (made_a >= 0) | (made_b >= 0)
            a, b = np.where(last, self.right[a], a), np.where(last, b, self.left[b])
            a, b, limit, open_ = (x[more] for x in (a, b, limit, open_))
        return ok

    def _sound(self, base: set[int]) -> np.ndarray:
        """Tokens that their own text is merged to."""
        good = np.zeros(self._size, bool)
        good[list(base)] = True
        made = np.flatnonzero(self.made >= 0)
        i, j = self.left[made], self.right[made]
        fits = self.compatible(i, j, joined=True) & (self.made[i] < self.made[made]) & (self.made[j] < self.made[made])
        for k, l, r, f in zip(made[order := np.argsort(self.made[made])].tolist(), i[order].tolist(), j[order].tolist(), fits[order].tolist(), strict=True):
            good[k] = f and good[l] and good[r]
        return good

    # ------------------------------------------------------------ words

    def _spelled(self, word: str) -> str:
        """Each byte as its letter, the end marked."""
        return (word if self._plain.fullmatch(word) else "".join(map(self._letters.__getitem__, word.encode()))) + _END

    def _cut(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        if not _BEYOND.search(text):
            return self._pattern.findall(text.lower())
        out, library = [], self._library
        for chunk in _CHUNK.findall(text):
            if not _BEYOND.search(chunk):
                out += self._pattern.findall(chunk.lower())
            else:  # words come spelled, and are told apart by the mark of their end
                out += [w + _END for w, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(chunk))]
        return out

    def proposed(self, word: str) -> list[int]:
        """The longest matches from the left; the last letter and the mark of the end stay together."""
        whole = self._propose.get(word)
        if whole is not None:
            return [whole]
        out, i, n, get = [], 0, len(word), self._propose.get
        while i < n:
            j = min(n, i + self._longest)
            j -= j == n - 1
            while (found := get(word[i:j])) is None:
                j -= 1 + (j == n)
            out.append(found)
            i = j
        return out

    def merged(self, word: str) -> list[int]:
        """All merges in order of rank, then from the left."""
        ids = [self._base[x] for x in (*word[:-2], word[-2:])]
        if len(ids) > FEW_LETTERS:
            return self._merged_long(ids)
        size, get = self._size, self._merge.get
        found = [get(a * size + b, _FREE) for a, b in zip(ids, ids[1:], strict=False)]
        while found and (best := min(found)) < _FREE:
            at, made = found.index(best), best % size
            ids[at : at + 2] = [made]
            del found[at]
            if at:
                found[at - 1] = get(ids[at - 1] * size + made, _FREE)
            if at < len(found):
                found[at] = get(made * size + ids[at + 1], _FREE)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        before, after = list(range(-1, len(ids) - 1)), [*range(1, len(ids)), -1]
        heap = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0 and (m := self._merge.get(ids[i] * self._size + ids[after[i]])) is not None:
                heapq.heappush(heap, (m, i, ids[i], ids[after[i]]))

        for i in range(len(ids)):
            offer(i)
        while heap:
            m, i, a, b = heapq.heappop(heap)
            made, j = m % self._size, after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = made, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [x for x in ids if x >= 0]

    def encoded_words(self, words: list[str]) -> list[bytes]:
        """Ids of spelled words: proposals, one test of all their distinct neighbours, merges for the words that fail."""
        proposals = list(map(self.proposed, words))
        sizes = np.fromiter(map(len, proposals), np.int64, len(words))
        flat = np.fromiter(chain.from_iterable(proposals), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        at = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique(flat[at] * self._size + flat[at + 1], return_inverse=True)
        bad = ~self.compatible(pairs // self._size, pairs % self._size)
        raw, ends = flat.astype("<i4").tobytes(), (4 * np.cumsum(sizes)).tolist()
        out = [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        for k in np.unique(owner[at[bad[back]]]).tolist():
            out[k] = np.asarray(self.merged(words[k]), "<i4").tobytes()
        return out

    # ------------------------------------------------------------ texts

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        get, out, open_, new = self._known.get, [], [], set()
        for k, text in enumerate(texts):
            if self._at_special.search(text):
                words, at = [], 0
                for m in self._at_special.finditer(text):
                    words += [*self._cut(text[at : m.start()]), self._special[m.group()]]
                    at = m.end()
                words += self._cut(text[at:])
            else:
                words = self._cut(text)
            ids = list(map(get, words))
            if None in ids:
                missing = [i for i, x in enumerate(ids) if x is None]
                open_.append((k, words, ids, missing))
                new.update(map(words.__getitem__, missing))
                out.append(b"")
            else:
                out.append(b"".join(ids))
        if open_:
            learned = {w: np.asarray([w], "<i4").tobytes() for w in new if isinstance(w, int)}
            plain = [w for w in new if w not in learned]
            learned.update(zip(plain, self.encoded_words([w if w.endswith(_END) else self._spelled(w) for w in plain]), strict=True))
            for k, words, ids, missing in open_:
                for i in missing:
                    ids[i] = learned[words[i]]
                out[k] = b"".join(ids)
            if len(self._known) < CACHED_WORDS:
                self._known.update((w, x) for w, x in learned.items() if isinstance(w, int) or len(w) <= LONG_WORD)
        return out

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """As the library without a decoder: the tokens joined by one space; unknown ids are left out.

        ids: those of all rows, one after another; sizes: how many are of each row.
        """
        owner = None
        if len(ids) and (ids.min() < 0 or ids.max() >= self._size or "" in self.tokens):
            known = (ids >= 0) & (ids < self._size)
            known[known] = self._named[ids[known]] != ""
            owner = np.repeat(np.arange(len(sizes)), sizes)[known]
            ids, sizes = ids[known], np.bincount(owner, minlength=len(sizes))
        names, ends = self._named[ids].tolist(), np.cumsum(sizes).tolist()
        return [" ".join(names[a:b]) for a, b in zip([0, *ends], ends, strict=False)]


def _model(path: str) -> SpeculativeBpe:
    return resident(("speculative", path), lambda: SpeculativeBpe(path))


def _slices(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of bounded total length; a longer row is a range of its own."""
    done = np.cumsum(lengths)
    a = 0
    while a < len(lengths):
        b = max(a + 1, int(np.searchsorted(done, (done[a - 1] if a else 0) + CHARS_AT_ONCE, side="right")))
        yield a, b
        a = b


def encoded(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, ids array<int>) of every row: whole texts, as ``encode(text, add_special_tokens=False)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _model(tokenizer)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _slices(np.fromiter(map(len, texts), np.int64, len(texts))):
                ids = bpe.encode(texts[a:b])
                offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids])))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decoded(rows: DataFrame, tokenizer: str, ids_col: str = "ids") -> DataFrame:
    """The rows with ``decoded``, as ``decode(ids, skip_special_tokens=False)``; no other column may have that name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _model(tokenizer)
        for batch in batches:
            lists = batch.column(at)
            lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            for a, b in _slices(lengths * 4):
                ids = lists.slice(a, b - a).flatten().fill_null(-1).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), pa.array(bpe.decode(ids, lengths[a:b]), pa.string())], names=[*batch.schema.names, "decoded"])

    at = rows.columns.index(ids_col)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, decoded string")
