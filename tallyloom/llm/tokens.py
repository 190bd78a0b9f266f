"""Tokenising whole texts inside tasks, with a cache of words.

A tokenizer from the ``tokenizers`` library splits a text into words before it merges. Letters and
digits end a word before a comma, full stop, space or line break, and a word never reaches over the
start of a run of white space. So a text can be cut there and encoded part by part, and each worker
keeps the ids of the parts it has met. Texts where such a cut could part what belongs
together (two marks or two white spaces in a row: ``LATE_MARK``, ``LONG_SPACE``) are cut at plain single spaces only,
or encoded in one piece. All ways give the ids of ``Tokenizer.encode(text, add_special_tokens=False)``; texts that hold
an added token (``<|endoftext|>``) are cut there first, as the library does, and it becomes its own id.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np

from .common import resident

CACHED_WORDS = 1_200_000  # per worker; later words are encoded each time they come
LONG_WORD = 64  # longer words are not kept
CHARS_AT_ONCE = 4_000_000

LATE_MARK = re.compile(r"[.,](?<=[\W_].)", re.S)
LONG_SPACE = re.compile(r"\s\s")


def _plain_end(word: str) -> bool:
    return word != "" and (word[-1].isalnum() or "!" <= word[-1] <= "~")


class WordEncoder:
    """Encodes texts to little-endian 32-bit ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("added tokens that take in what stands around them are not served")
        self.added = {t.content: np.asarray([i], "<u4").tobytes() for i, t in added.items()}
        self.at_added = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")
        self.mark, self.mark_id = "", None  # a text between parts that is one id of its own
        for mark in ("\n", " ¶", " § ", " ~ ", " ^ "):
            ids = np.frombuffer(self._ids([mark])[0], "<u4")
            if len(ids) == 1 and mark.strip(" ") == mark or len(ids) == 1 and not self._ids([" "])[0]:
                self.mark, self.mark_id = mark, int(ids[0])
                break
        self.words: dict[str, bytes] = {"": b""}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Encode parts in one go where they are plain words."""
        sign = self.mark.strip(" ")
        easy = [w for w in new if sign not in w and _plain_end(w)] if sign else []
        if easy:
            ids = np.frombuffer(self._ids([self.mark.join(easy)])[0], "<u4")
            at = np.flatnonzero(ids == self.mark_id).tolist()
            if len(at) == len(easy) - 1:
                raw = ids.tobytes()
                self.words.update(zip(easy, (raw[a:b] for a, b in zip([0, *(4 * x + 4 for x in at)], [*(4 * x for x in at), len(raw)], strict=True)), strict=True))
            else:
                easy = []
        rest = [w for w in new if w not in self.words] if len(easy) < len(new) else []
        if rest:
            self.words.update(zip(rest, self._ids(rest), strict=True))

    def _parts(self, text: str) -> list[str] | None:
        odd = text[:1] in ".," or text[:1].isspace() or "\0" in text
        if not odd and not LATE_MARK.search(text) and not LONG_SPACE.search(text):
            return text.replace(" ", "\0 ").replace(",", "\0,").replace(".", "\0.").replace("\n", "\0\n\0").split("\0")
        words = text.split(" ")
        if all(map(_plain_end, words[:-1])):
            return [words[0], *(" " + w for w in words[1:])]
        return None

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [k for k, t in enumerate(texts) if self.at_added.search(t)]
        if not cut:
            return self._encode(texts)
        plain, row = list(texts), []  # pieces of cut texts come after the texts
        for k in cut:
            plain[k], at, ids = "", 0, []
            for m in self.at_added.finditer(texts[k]):
                ids += [len(plain), self.added[m.group()]]
                plain.append(texts[k][at : m.start()])
                at = m.end()
            ids.append(len(plain))
            plain.append(texts[k][at:])
            row.append(ids)
        out = self._encode(plain)
        for k, ids in zip(cut, row, strict=True):
            out[k] = b"".join(out[x] if isinstance(x, int) else x for x in ids)
        return out[: len(texts)]

    def _encode(self, texts: list[str]) -> list[bytes]:
        """Of texts without added tokens."""
        out: list[bytes] = [b""] * len(texts)
        get, whole, open_, new = self.words.get, [], [], set()
        for k, text in enumerate(texts):
            parts = self._parts(text)
            if parts is None:
                whole.append(k)
                continue
            ids = list(map(get, parts))
            missing = [i for i, x in enumerate(ids) if x is None]
            if missing:
                open_.append((k, parts, ids, missing))
                new.update(map(parts.__getitem__, missing))
            else:
                out[k] = b"".join(ids)
        if new:
            self._learn(list(new))
        for k, parts, ids, missing in open_:
            for i in missing:
                ids[i] = self.words[parts[i]]
            out[k] = b"".join(ids)
        for k, ids in zip(whole, self._ids([texts[k] for k in whole]) if whole else [], strict=True):
            out[k] = ids
        full = len(self.words) > CACHED_WORDS
        for w in new:
            if full or len(w) > LONG_WORD:
                del self.words[w]
        return out


def encoder(path: str) -> WordEncoder:
    """This worker's encoder."""
    return resident(("encoder", path), lambda: WordEncoder(path))


def in_slices(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """(first position, texts) in slices of bounded size; null becomes empty."""
    first, held, size = 0, [], 0
    for k, t in enumerate(texts):
        held.append(t or "")
        size += len(held[-1])
        if size >= CHARS_AT_ONCE:
            yield first, held
            first, held, size = k + 1, [], 0
    if held:
        yield first, held
