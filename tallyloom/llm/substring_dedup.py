"""Repeated passages across documents: content-defined spans for exact repeats, paragraph MinHash banding for near ones.

All cut places depend on the words around them only, so a passage is cut alike wherever it stands.

*Spans* run between neighbouring words that hold the smallest 5-word hash of some ``FINE`` words, and
hold six words or more. Any passage of ``2 * FINE + 8`` words has whole spans inside, and at most
``FINE - 1`` words outside them at either end, which extension word by word against the earlier place
then adds. *Paragraphs* are parts of a text between line breaks, sentence ends and, more than
``WIDE_MARGIN`` words from these, words that hold the smallest 5-word hash of some ``WIDE`` words. Those of
``BANDED_WORDS`` or more have MinHash values over 5-word shingles, banded as ``BANDS`` bands of ``ROWS``
value: at similarity 0.75 a pair meets in some band with chance 1 - 0.25**4 = 0.996. Shorter paragraphs
count only as parts of exact repeats.

1. One pass over the texts makes both kinds of units. Within a task, every unit but its first
   document's is settled at once (a span that an earlier document has repeats it; equal paragraphs
   need one comparison), so what a hot unit sends on is bounded by the number of tasks.
2. Units go packed to blocks by hash. A block gives the spans that repeat an earlier document's, and
   the band keys that different paragraphs share.
3. A document's repeated spans are joined to runs; each end of a run is extended word by word
   against the words of the earlier place.
4. Colliding paragraphs are held against the first of their band and verified by exact Jaccard
   similarity of their shingle sets. Bands that then still hold several components have all members
   outside the main one compared, in blocks inside tasks. Connected components of the links cluster
   paragraphs; the first one of a cluster stays. Of the others, the words from the first to the last
   shingle that it has count as repeated.
5. Each document loses its runs of repeated words that hold ``RUN_WORDS`` words or more together;
   shorter repeats (headings, stock phrases) stay. Up to ``LEAST_WORDS`` words between two repeats do
   not end a run.

Edge cases: null texts count as empty and stay null; white-space texts have no units; repeats within
one document alone stay; rows that repeat an id and its text are one document and lose the same
words; rows with a null id, or an id that stands for different texts, are documents of their own that come after
all others; an empty table gives an empty result; further columns are kept as they are, but for those called as
the columns that are added.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, _power, components, dropped, mix64, nullable, of_ids, span_hashes, written
from .near_dedup import long_lists, verified_links

LEAST_WORDS = 5
FINE = 16
WIDE, WIDE_MARGIN = 32, 20
REACH = 20  # words that the end of a run is extended by at most
BANDED_WORDS = 16
BANDS, ROWS = 4, 1
RUN_WORDS = 30
SIMILAR = 75
BLOCK_CHARS = 1 << 24  # characters of text whose units go to one block
CHUNK_CHARS = 1 << 20  # of texts that are cut at a time
CHUNK_UNITS = 1 << 20  # units of a task that are settled at a time

_SEEDS = [np.uint64(x) for x in np.random.default_rng(99).integers(1, 2**63, BANDS * ROWS)]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STOP = np.zeros(256, bool)
_STOP[[33, 46, 63]] = True


def _picked(h: np.ndarray, width: int, whole: np.ndarray) -> np.ndarray:
    """Places that hold the (first) smallest value of some ``width`` neighbouring ones; ``whole``: windows that count, by start."""
    if len(h) < width:
        return np.empty(0, np.int64)
    at, span = np.arange(len(h)), 1
    while span < width:
        step = min(span, width - span)
        at = np.where(h[at[step:]] < h[at[:-step]], at[step:], at[:-step])
        span += step
    at = at[whole[: len(at)]]  # places never fall
    return at[np.flatnonzero(np.r_[True, at[1:] != at[:-1]])] if len(at) else at


class Paragraphs:
    """Paragraphs, spans and shingles of one text, or of several at once, as arrays of word positions."""

    def __init__(self, texts: str | None | list[str | None]):
        parts = [(t or "").encode("utf-8", "replace") for t in (texts if isinstance(texts, list) else [texts])]
        self.data = b"\n".join(parts)
        a = np.frombuffer(self.data, np.uint8)
        space = np.concatenate(([True], _SPACE[a], [True]))
        edge = np.flatnonzero(space[1:] != space[:-1])
        self.begin, self.end = edge[::2], edge[1::2]  # bytes of words
        self.n_words = n = len(self.begin)
        self.starts = np.cumsum([0, *(len(p) + 1 for p in parts)])  # of texts, in bytes
        self.head = np.searchsorted(self.begin, self.starts)  # first word of each text, and their number
        self.doc = np.repeat(np.arange(len(parts)), np.diff(self.head))

    @cached_property
    def word(self) -> np.ndarray:
        return span_hashes(self.data.translate(_LOWER), self.begin, self.end) if self.n_words else np.empty(0, np.uint64)

    @cached_property
    def sums(self) -> np.ndarray:
        return np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.word * _power(self.n_words + 1)[0][: self.n_words])))

    @cached_property
    def last(self) -> np.ndarray:
        """Last word of each paragraph."""
        n, a = self.n_words, np.frombuffer(self.data, np.uint8)
        if not n:
            return np.empty(0, np.int64)
        after = _STOP[a[self.end - 1]]
        line = np.flatnonzero(a == 10)
        after[:-1] |= np.searchsorted(line, self.begin[1:]) != np.searchsorted(line, self.end[:-1])
        after[-1] = True
        own = _picked(self.shingles(), WIDE, self._whole(WIDE)) + LEAST_WORDS - 1
        seen = np.concatenate(([0], np.cumsum(after)))
        alone = seen[np.minimum(own + WIDE_MARGIN + 1, n)] == seen[np.maximum(own - WIDE_MARGIN, 0)]
        after[own[alone]] = True
        return np.flatnonzero(after)

    @cached_property
    def first(self) -> np.ndarray:
        return np.concatenate((np.zeros(min(1, self.n_words), np.int64), self.last[:-1] + 1))

    @property
    def words(self) -> np.ndarray:
        return self.last - self.first + 1

    def _whole(self, width: int) -> np.ndarray:
        """By word: whether so many shingles from there on lie in one text."""
        reach = width + LEAST_WORDS - 2
        out = np.zeros(self.n_words, bool)
        if self.n_words > reach:
            out[: self.n_words - reach] = self.doc[reach:] == self.doc[: self.n_words - reach]
        return out

    def _digest(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        if not len(first):
            return np.empty(0, np.uint64)
        return mix64((self.sums[last + 1] - self.sums[first]) * _power(self.n_words + 1)[1][first] + (last + 1 - first).astype(np.uint64))

    def digests(self) -> np.ndarray:
        """Of each paragraph's words; a short paragraph is known by the last ``LEAST_WORDS`` words up to its end."""
        return self._digest(np.maximum(0, np.minimum(self.first, self.last - LEAST_WORDS + 1)), self.last)

    def place(self, names: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(name of the text, first byte, last byte + 1) of words from ... to."""
        if not len(first):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        doc = self.doc[first]
        return names[doc], self.begin[first] - self.starts[doc], self.end[last] - self.starts[doc]

    def shingles(self) -> np.ndarray:
        """Per word the hash of the five words from it on, 0 for the last four."""
        return self._shingles

    @cached_property
    def _shingles(self) -> np.ndarray:
        out, own = np.zeros(self.n_words, np.uint64), np.arange(max(0, self.n_words - LEAST_WORDS + 1))
        out[: len(own)] = self._digest(own, own + LEAST_WORDS - 1)
        return out

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """(first, last) word of each span."""
        cut = _picked(self.shingles(), FINE, self._whole(FINE)) if self.n_words else np.empty(0, np.int64)
        own = np.flatnonzero(self.doc[cut[1:]] == self.doc[cut[:-1]]) if len(cut) > 1 else np.empty(0, np.int64)
        return cut[own], (cut[own + 1] + LEAST_WORDS - 1 if len(own) else own)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """(paragraph, band key) of paragraphs that are long enough."""
        own = np.flatnonzero(self.words >= BANDED_WORDS)
        if not len(own):
            return own, np.empty(0, np.uint64)
        s = self.shingles()
        cuts = np.column_stack((self.first[own], self.last[own] - LEAST_WORDS + 2)).ravel()
        found = []
        for b in range(BANDS):
            key = np.zeros(len(own), np.uint64)
            for r in range(ROWS):
                drawn = np.append(mix64(s ^ _SEEDS[b * ROWS + r]), np.uint64(0))
                key = mix64(key + np.minimum.reduceat(drawn, cuts)[::2] + np.uint64(b))
            found.append(key)
        return np.tile(own, BANDS), np.concatenate(found)


# ---------------------------------------------------------------- units of all texts

_PACKED = "block long, kind int, a binary, b binary, c binary, d binary, e binary, f binary"
_SPANS, _KEYS, _REPEATS = 0, 1, 2
_KINDS = {_SPANS: ("<i8", "<i4", "<i4", "<u8"), _KEYS: ("<i8", "<i4", "<i4", "<u8", "<u8"), _REPEATS: ("<i8", "<i4", "<i4", "<i8", "<i4", "<i4")}
_FOUND = "banded boolean, key long, fp long, id long, start int, stop int, f_id long, f_start int, f_stop int"
_FOUND_NAMES = [x.split(" ")[0] for x in _FOUND.split(", ")]


def _split_spans(doc: np.ndarray, start: np.ndarray, stop: np.ndarray, key: np.ndarray) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Spans of the first document that has them, and (id, start, stop, f_id, f_start, f_stop) of those that repeat it."""
    order = np.lexsort((start, doc, key))
    doc, start, stop, key = (x[order] for x in (doc, start, stop, key))
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    begin = np.repeat(new, np.diff([*new, len(key)]))
    own = doc == doc[begin]
    first, rest = begin[~own], ~own
    return (doc[own], start[own], stop[own], key[own]), (doc[rest], start[rest], stop[rest], doc[first], start[first], stop[first])


def _joined(doc: np.ndarray, start: np.ndarray, stop: np.ndarray, f_doc: np.ndarray, f_start: np.ndarray, f_stop: np.ndarray) -> tuple[np.ndarray, ...]:
    """Overlapping repeats of one other document at one distance become one."""
    order = np.lexsort((start, start - f_start, f_doc, doc))
    doc, start, stop, f_doc, f_start, f_stop = (x[order] for x in (doc, start, stop, f_doc, f_start, f_stop))
    if not len(doc):
        return doc, start, stop, f_doc, f_start, f_stop
    new = np.r_[True, (doc[1:] != doc[:-1]) | (f_doc[1:] != f_doc[:-1]) | ((start - f_start)[1:] != (start - f_start)[:-1]) | (start[1:] > stop[:-1])]
    at = np.flatnonzero(new)
    return doc[at], start[at], np.maximum.reduceat(stop, at), f_doc[at], f_start[at], np.maximum.reduceat(f_stop, at)


def _split_keys(doc: np.ndarray, start: np.ndarray, stop: np.ndarray, key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each (key, fp) once, at its first place, in order of key."""
    order = np.lexsort((start, doc, fp, key))
    key, fp = key[order], fp[order]
    at = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])]) if len(key) else np.empty(0, np.int64)
    return (*(x[order][at] for x in (doc, start, stop)), key[at], fp[at])


def _packed(kind: int, block: np.ndarray, columns: tuple[np.ndarray, ...]) -> list[tuple]:
    """A row for each block; units lie in order of document and place, which makes them small."""
    if not len(block):
        return []
    order = np.lexsort((columns[1], columns[0], block))
    block, columns = block[order], [x[order].astype(k) for x, k in zip(columns, _KINDS[kind], strict=True)]
    edges = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    return [(int(block[i]), kind, *(x[i:j].tobytes() for x in columns), *[b""] * (6 - len(columns))) for i, j in zip(edges, [*edges[1:], len(block)], strict=True)]


def units(docs: DataFrame, blocks: int) -> DataFrame:
    """Packed units of (id, text), dealt to ``blocks`` by hash; what a task has settled itself is spread over the blocks."""

    def settled(held: list[tuple], turn: int) -> pd.DataFrame:
        spans, keys = (tuple(map(np.concatenate, zip(*side, strict=True))) for side in zip(*held, strict=True))
        firsts, repeats = _split_spans(*spans)
        repeats, keys = _joined(*repeats), _split_keys(*keys)
        rows = _packed(_SPANS, (firsts[3] % np.uint64(blocks)).astype(np.int64), firsts)
        rows += _packed(_KEYS, (keys[3] % np.uint64(blocks)).astype(np.int64), keys)
        rows += _packed(_REPEATS, np.full(len(repeats[0]), turn % blocks), repeats)
        return pd.DataFrame(rows, columns=["block", "kind", *"abcdef"])

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, turn = [], 0, 0
        for pdf in batches:
            lengths = np.cumsum([len(t) for t in pdf["text"]])
            for part in np.split(np.arange(len(pdf)), np.flatnonzero(np.diff(lengths // CHUNK_CHARS)) + 1):
                if not len(part):
                    continue
                names, p = pdf["id"].to_numpy(np.int64)[part], Paragraphs(pdf["text"].iloc[part].tolist())
                first, last = p.spans()
                own, key = p.keys()
                at, to = p.first[own], p.last[own]
                held.append(((*p.place(names, first, last), p._digest(first, last)), (*p.place(names, at, to), key, p._digest(at, to))))
                size += len(first) + len(own)
                turn += int(names[0])
                if size > CHUNK_UNITS:
                    yield settled(held, turn)
                    held, size = [], 0
        if held:
            yield settled(held, turn)

    return docs.mapInPandas(build, _PACKED)


def _unpacked(pdf: pd.DataFrame, kind: int) -> tuple[np.ndarray, ...]:
    own = pdf[pdf["kind"] == kind]
    return tuple(np.frombuffer(b"".join(own[c]), k) for c, k in zip("abcdef", _KINDS[kind], strict=False))


def colliding(packed: DataFrame) -> DataFrame:
    """Merged blocks: repeats (id, start, stop, f_id, f_start, f_stop), and places (key, fp, id, start, stop) of band keys of several paragraphs."""

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        repeats = [np.concatenate(x) for x in zip(_split_spans(*_unpacked(pdf, _SPANS))[1], _unpacked(pdf, _REPEATS), strict=True)]
        band = _split_keys(*_unpacked(pdf, _KEYS))
        new = np.flatnonzero(np.r_[True, band[3][1:] != band[3][:-1]]) if len(band[0]) else np.empty(0, np.int64)
        size = np.diff([*new, len(band[0])])
        band = [x[np.repeat(size, size) > 1] for x in band]
        n, m = len(repeats[0]), len(band[0])
        none = lambda k: np.zeros(k, np.int64)
        both = {c: np.concatenate((repeats[k], band[k])) for k, c in enumerate(("id", "start", "stop"))}
        both |= {c: np.concatenate((none(n), band[k].view(np.int64))) for k, c in ((3, "key"), (4, "fp"))}
        both |= {c: np.concatenate((repeats[k], none(m))) for k, c in ((3, "f_id"), (4, "f_start"), (5, "f_stop"))}
        return pd.DataFrame({"banded": np.arange(n + m) >= n, **both})[_FOUND_NAMES]

    return packed.groupBy("block").applyInPandas(merge, _FOUND)


# ---------------------------------------------------------------- exact repeats


def _ends(marks: DataFrame) -> DataFrame:
    """(id, start, stop, l_id, l_at, r_id, r_at): a document's runs of repeats, and the places in other documents that their ends stand at."""

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for own, rows in zip(pdf["id"], pdf["marks"], strict=True):
                start, stop, f_id, f_start, f_stop = np.array([tuple(r.values()) for r in rows], np.int64).T
                order = np.lexsort((f_start, f_id, -stop, start))
                start, stop, f_id, f_start, f_stop = (x[order] for x in (start, stop, f_id, f_start, f_stop))
                reach = np.maximum.accumulate(stop)
                begin = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
                for a, b in zip(begin, [*begin[1:], len(start)], strict=True):
                    z = a + int(np.argmax(stop[a:b]))
                    out.append((own, start[a], stop[z], f_id[a], f_start[a], f_id[z], f_stop[z]))
            yield pd.DataFrame(out, columns=["id", "start", "stop", "l_id", "l_at", "r_id", "r_at"])

    each = marks.groupBy("id").agg(F.collect_list(F.struct("start", "stop", "f_id", "f_start", "f_stop")).alias("marks"))  # as long as one text
    return each.mapInPandas(join, "id long, start int, stop int, l_id long, l_at int, r_id long, r_at int")


def _contexts(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, at, before, words): up to ``REACH`` words before a place, nearest first, or from it on."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for own, text, places in zip(pdf["id"], pdf["text"], pdf["places"], strict=True):
                data = text.encode("utf-8", "replace").translate(_LOWER)
                for at, before in ((x["at"], x["before"]) for x in places):
                    words = data[:at].rsplit(None, REACH)[-REACH:][::-1] if before else data[at:].split(None, REACH)[:REACH]
                    out.append((own, at, before, b" ".join(words)))
            yield pd.DataFrame(out, columns=["id", "at", "before", "words"])

    wanted = written(asked.groupBy("id").agg(F.collect_set(F.struct("at", "before")).alias("places")), "asked")  # as many as one text has words
    return of_ids(docs, wanted).mapInPandas(build, "id long, at int, before boolean, words binary").dropDuplicates(["id", "at", "before"])


def exact_repeats(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """(id, start, stop, left, right): runs of bytes that earlier documents have, and these documents' words around them."""
    runs = written(_ends(marks), "runs")
    side = lambda s, before: runs.select(F.col(f"{s}_id").alias("id"), F.col(f"{s}_at").alias("at"), F.lit(before).alias("before"))
    found = written(_contexts(docs, side("l", True).union(side("r", False)).distinct()), "contexts")
    words = lambda s, before, c: found.where(F.col("before") == before).select(F.col("id").alias(f"{s}_id"), F.col("at").alias(f"{s}_at"), F.col("words").alias(c))
    return runs.join(words("l", True, "left"), ["l_id", "l_at"], "left").join(words("r", False, "right"), ["r_id", "r_at"], "left").select("id", "start", "stop", "left", "right")


# ---------------------------------------------------------------- near repeats


def _shingle_sets(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(node, n, items, row): the shingle sets of digests' paragraphs, and the shingles in their order."""

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            names, parts = [], []
            for text, wanted in zip(pdf["text"], pdf["wanted"], strict=True):
                data = text.encode("utf-8", "replace")
                names += [w["fp"] for w in wanted]
                parts += [data[w["start"] : w["stop"]].decode("utf-8", "replace") for w in wanted]
            p, out = Paragraphs(parts), []
            for fp, a, b in zip(names, p.head, p.head[1:], strict=False):
                row = p.shingles()[a : b - LEAST_WORDS + 1]
                own = np.unique(row)
                out.append((fp, len(own), own.tobytes(), row.tobytes()))
            yield pd.DataFrame(out, columns=["node", "n", "items", "row"])

    wanted = written(places.groupBy("id").agg(F.collect_list(F.struct("fp", "start", "stop")).alias("wanted")), "wanted")  # paragraphs of one text
    return of_ids(docs, wanted).mapInPandas(sets, "node long, n long, items binary, row binary").dropDuplicates(["node"])


def near_repeats(docs: DataFrame, banded: DataFrame) -> DataFrame:
    """(id, start, skip, words): words of paragraphs that are similar to an earlier one of another document.

    Of equal paragraphs the first stands for all; the others repeat it word by word anyway. The first
    ``skip`` words of the paragraph, and those after ``words`` more, are not in the one that stays.
    """

    def trimmed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, start, row, items in zip(pdf["id"], pdf["start"], pdf["row"], pdf["items"], strict=True):
                own = np.flatnonzero(np.isin(np.frombuffer(row, np.uint64), np.frombuffer(items, np.uint64)))
                if len(own):
                    out.append((doc, start, int(own[0]), int(own[-1] - own[0]) + LEAST_WORDS))
            yield pd.DataFrame(out, columns=["id", "start", "skip", "words"])

    lead = written(banded.groupBy("key").agg(F.min("fp").alias("b"), F.max("fp").alias("z")).where("b < z").select("key", "b"), "leads")
    shared = written(banded.join(lead, "key").select("key", "fp", "b", "id", "start", "stop"), "bands")
    places = written(shared.groupBy("fp").agg(F.min(F.struct("id", "start", "stop")).alias("at")).select("fp", "at.*"), "places")
    sets = written(_shingle_sets(docs, places), "paragraph-sets")
    first = written(verified_links(shared.where("fp <> b").select(F.col("fp").alias("a"), "b").distinct(), sets, SIMILAR), "links")
    early = written(components(first), "early")
    # bands whose members are still in several components
    members = written(shared.select(F.col("key").alias("v"), F.col("fp").alias("node")).join(early, "node", "left").select("v", "node", F.coalesce("component", "node").alias("comp")), "members")
    more = written(long_lists(members, sets.select("node", "n", "items"), SIMILAR).distinct(), "more")
    links = first.unionByName(more.where("sure").select("a", "b")).unionByName(verified_links(more.where("not sure").select("a", "b").distinct(), sets, SIMILAR))
    grouped = written(places.join(components(links), F.col("fp") == F.col("node")).select("fp", "id", "start", "component"), "clusters")
    kept = written(grouped.groupBy("component").agg(F.min(F.struct("id", "start", "fp")).alias("first"), F.max("id").alias("other")).where("first.id < other"), "kept")
    gone = grouped.join(kept, "component").where("id <> first.id").select("id", "start", "fp", F.col("first.fp").alias("kept"))
    both = gone.join(sets.select(F.col("node").alias("fp"), "row"), "fp").join(sets.select(F.col("node").alias("kept"), "items"), "kept")
    return both.mapInPandas(trimmed, "id long, start int, skip int, words int")


def _fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def numbered(docs: DataFrame, id_col: str, text_col: str, row: str) -> tuple[DataFrame, int]:
    """(the table with a document number, characters in all).

    The number is the id; rows whose id is null or stands for different texts get one from id and text, after all others.
    """
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    each = written(read.groupBy("id").agg(F.min(F.xxhash64("text")).alias("lo"), F.max(F.xxhash64("text")).alias("hi"), F.sum(F.length("text")).alias("size")), "documents")
    size = each.agg(F.sum("size")).first()[0] or 0
    own, odd = _fresh(docs, "_id"), _fresh(docs, "_odd")
    mixed = written(each.where("lo <> hi and id is not null").select(F.col("id").alias(own), F.lit(True).alias(odd)), "mixed-ids")
    id_ = F.col(id_col).cast("long")
    late = F.lit(1 << 62) + F.xxhash64(id_, F.col(text_col)).bitwiseAND(F.lit((1 << 62) - 1))
    number = F.when(id_.isNull() | F.col(odd).isNotNull(), late).otherwise(id_)
    return docs.join(mixed, id_ == F.col(own), "left").withColumn(row, number).select(*docs.columns, row), size


def repeated_spans(docs: DataFrame, size: int) -> DataFrame:
    """Per repeat of an earlier document's words: id, start (bytes), and stop with the words around it there, or (stop -1) skip and words.

    docs: (id, text), size characters in all.
    """
    read = docs.where("text is not null")
    found = written(colliding(units(read, max(1, math.ceil(size / BLOCK_CHARS)))), "units")
    exact = exact_repeats(read, found.where("not banded").select("id", "start", "stop", "f_id", "f_start", "f_stop"))
    near = near_repeats(read, found.where("banded").select("key", "fp", "id", "start", "stop"))
    return exact.unionByName(near.withColumn("stop", F.lit(-1)), allowMissingColumns=True).fillna(0, ["skip", "words"])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_words: int = RUN_WORDS) -> DataFrame:
    """``docs`` with the text shortened, n_removed (paragraphs that lose words) and the removed byte spans.

    Columns of the input that are called n_removed or removed are replaced.
    """
    row, id_, marks_ = _fresh(docs, "_row"), _fresh(docs, "_number"), _fresh(docs, "_marks")
    names = [c for c in docs.columns if c.lower() not in ("n_removed", "removed")]
    kinds = dict(docs.dtypes)
    docs, size = numbered(docs.select(*names), id_col, text_col, row)
    spans = repeated_spans(docs.select(F.col(row).alias("id"), F.col(text_col).alias("text")), size)
    marks = written(spans.groupBy(F.col("id").alias(id_)).agg(F.collect_list(F.struct("start", "stop", "left", "right", "skip", "words")).alias(marks_)), "marks")

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, gone, spans = [], [], []
            for text, marked in zip(pdf[text_col], pdf[marks_], strict=True):
                p = Paragraphs(text) if marked is not None and text is not None else None
                runs = repeated_runs(p, marked, run_words) if p else []
                cut = [(int(p.begin[i]), int(p.end[j])) for i, j in runs]
                texts.append(shortened(p.data, cut) if cut else text)
                gone.append(sum(int(np.searchsorted(p.last, j) - np.searchsorted(p.last, i)) + 1 for i, j in runs))
                spans.append([{"start": a, "end": b} for a, b in cut])
            yield nullable(pdf[names], kinds).assign(**{text_col: texts}, n_removed=gone, removed=spans)

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return (
        docs.join(marks, F.col(row) == F.col(id_), "left").select(*names, marks_)
        .mapInPandas(remove, f"{schema}, n_removed int, removed array<struct<start: long, end: long>>")
    )


def _agreeing(own: list[bytes], other: bytes | None) -> int:
    """How many words agree from the start on."""
    n = 0
    for x, y in zip(own, (other or b"").split(b" "), strict=False):
        if x != y:
            break
        n += 1
    return n


def repeated_runs(p: Paragraphs, marks: list, run_words: int) -> list[tuple[int, int]]:
    """(first, last) words of runs that go: repeated ones, and a few between them."""
    if not p.n_words:
        return []
    edge = np.zeros(p.n_words + 1, np.int64)
    lower = p.data.translate(_LOWER)
    words = lambda a, b: [lower[p.begin[k] : p.end[k]] for k in range(max(a, 0), min(b, p.n_words))]
    for x in marks:
        first = int(np.searchsorted(p.begin, x["start"]))
        if x["stop"] < 0:
            first += x["skip"]
            last = first + x["words"]
        else:
            last = int(np.searchsorted(p.end, x["stop"], "right"))
            first -= _agreeing(words(first - REACH, first)[::-1], x["left"])
            last += _agreeing(words(last, last + REACH), x["right"])
        edge[min(first, p.n_words)] += 1
        edge[min(last, p.n_words)] -= 1
    own = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    groups = np.split(own, np.flatnonzero(np.diff(own) > LEAST_WORDS) + 1)
    return [(int(g[0]), int(g[-1])) for g in groups if len(g) >= run_words]


def shortened(data: bytes, cut: list[tuple[int, int]]) -> str:
    """The text without the spans; the white space after a removed span goes with it."""
    out, at = [], 0
    for a, b in cut:
        out.append(data[at:a])
        at = b
        while at < len(data) and data[at] in b" \t\r\n":
            at += 1
    out.append(data[at:])
    return b"".join(out).decode("utf-8", "replace")
