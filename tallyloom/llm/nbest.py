"""N-best segmentation with a SentencePiece vocabulary: forward Viterbi, backward A-star.

A text's piece lattice has an edge for every vocabulary piece that fits, scored by the piece; a
character no piece covers is spelled in bytes. The forward pass gives the best score of every
prefix. The backward search starts at the end of the text and extends partial segmentations to the
left; the forward score of what is still open is an exact heuristic, so segmentations come out of
the queue in order of score.

The lattice falls apart wherever no piece of the vocabulary holds the two neighbouring characters;
there a text is cut, and each worker keeps the two best segmentations of the parts it has met. New parts
of many texts go through the lattice together: a trie of the pieces, forward and backward scores, as
arrays. A text's N best then deviate from the best only in its N - 1 parts with the smallest second-best
loss, which a second search over parts combines. The result equals a search over the whole lattice.

Edge cases: a null or empty text has one segmentation, of no pieces, with score 0; fewer
segmentations than asked for give all; equal scores are ordered by the earlier part and then by the
order of search; a NUL character is read as U+FFFD; repeated rows are answered each for itself; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids as ids_of
from .common import nullable, resident
from .tokens import LATE_MARK, LONG_SPACE, in_slices

CACHED_PARTS = 600_000  # per worker; later parts are searched each time they come; the workers of both steps may come to hold them
LONG_PART = 64  # longer parts are searched one by one, and not kept
PARTS_AT_ONCE = 16_384
SPACE = "▁"

_RUNS = re.compile(rf"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")


class Vocabulary:
    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = range(sp.get_piece_size())
        self.text = [sp.id_to_piece(i) for i in ids]
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.of_byte = {i: b for b, i in enumerate(self.byte)}
        plain = [i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.pieces = {self.text[i]: (i, sp.get_score(i)) for i in plain}
        self.longest = max(map(len, self.pieces))
        self.unknown = min(s for _, s in self.pieces.values()) - 10.0
        self.bigrams = {p[k : k + 2] for p in self.pieces for k in range(len(p) - 1)}
        chars = sorted({c for p in self.pieces for c in p})
        self.number = np.zeros(sys.maxunicode + 1, np.int32)  # of characters in pieces, from 1
        self.number[list(map(ord, chars))] = np.arange(1, len(chars) + 1)
        self.known = {c for c in chars if c in self.pieces}
        first, second = (self.number[[ord(b[k]) for b in self.bigrams]].astype(np.int64) for k in (0, 1))
        self.width = len(chars) + 1
        self.joint = np.sort(first * self.width + second)
        nodes = {"": 0}  # a trie; its steps by parent and character, in order
        for p in self.pieces:
            for k in range(1, len(p) + 1):
                nodes.setdefault(p[:k], len(nodes))
        steps = np.array([nodes[p[:-1]] * self.width + self.number[ord(p[-1])] for p in nodes if p], np.int64)
        order = np.argsort(steps)
        self.step, self.to = steps[order], order + 1
        self.piece_at = np.array([self.pieces.get(p, (-1, 0.0))[0] for p in nodes], np.int64)
        self.score_at = np.array([self.pieces.get(p, (-1, 0.0))[1] for p in nodes])
        # spaces and line breaks only start pieces, and no piece has a letter or digit before a comma or stop
        self.plain = not any(
            b[1] == SPACE and b[0] != SPACE or "\n" in b or b[1] in ".," and b[0].isalnum() for b in self.bigrams
        )
        spelled = [bytes([self.of_byte[i]]) if i in self.of_byte else self.text[i].encode() for i in ids]
        self.spelling = np.array(spelled, object)
        self.index: dict[str, int] = {}  # of parts met
        self.ids: list[bytes] = []
        self.score, self.loss = np.zeros(1024), np.zeros(1024)  # loss of the second-best segmentation

    def lattice(self, s: str) -> tuple[list[float], list]:
        """Forward Viterbi: the best score of every prefix, and per end position the edges (start, score, piece)."""
        get, longest, unknown = self.pieces.get, self.longest, self.unknown
        ahead, edges = [0.0], [()]
        for j in range(1, len(s) + 1):
            here, top = [], -np.inf
            for i in range(j - longest if j > longest else 0, j):
                p = get(s[i:j])
                if p is None:
                    if i + 1 < j:
                        continue
                    p = (s[i], unknown)
                score = p[1]
                here.append((i, score, p[0]))
                if ahead[i] + score > top:
                    top = ahead[i] + score
            ahead.append(top)
            edges.append(here)
        return ahead, edges

    def spelled(self, pieces: list[int | str]) -> list[int]:
        """Ids of pieces; an unknown character becomes its bytes."""
        return [i for p in pieces for i in ([p] if isinstance(p, int) else [self.byte[b] for b in p.encode("utf-8", "replace")])]

    def best_and_loss(self, s: str) -> tuple[list[int], float, float]:
        """(ids, score) of the best segmentation, and what the second best loses.

        The second best takes an edge off the best path; the best path through an edge is known from
        the forward and the backward scores.
        """
        ahead, edges = self.lattice(s)
        path, j = [], len(s)
        on = {}
        while j:
            top = ahead[j]
            i, _, piece = on[j] = next(e for e in edges[j] if ahead[e[0]] + e[1] == top)
            path.append(piece)
            j = i
        behind = [-np.inf] * len(s) + [0.0]
        second = -np.inf
        for j in range(len(s), 0, -1):
            rest, own = behind[j], on.get(j)
            for e in edges[j]:
                i = e[0]
                x = rest + e[1]
                if x > behind[i]:
                    behind[i] = x
                if e is not own and ahead[i] + x > second:
                    second = ahead[i] + x
        return self.spelled(path[::-1]), ahead[-1], ahead[-1] - second

    def best(self, s: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations of one lattice, best first: (score, ids)."""
        ahead, edges = self.lattice(s)
        queue: list[tuple] = [(-ahead[-1], 0, len(s), 0.0, None)]
        out, count = [], 0
        pop, push = heapq.heappop, heapq.heappush
        while queue and len(out) < n:  # backward A-star
            _, _, at, done, link = pop(queue)
            if at == 0:
                pieces = []
                while link is not None:
                    piece, link = link
                    pieces.append(piece)
                out.append((done, tuple(self.spelled(pieces))))
                continue
            for i, score, piece in edges[at]:
                count += 1
                push(queue, (-(ahead[i] + score + done), count, i, score + done, (piece, link)))
        return out

    def cut(self, text: str) -> list[str]:
        """The text's parts, with the mark of its start; pieces never reach over a cut."""
        s = SPACE + text.replace(" ", SPACE)
        if not self.plain:
            return self.split(s)
        if LONG_SPACE.search(text) or text[0] == " " or SPACE in text:
            return _RUNS.findall(s)
        s = s.replace(SPACE, "\0" + SPACE).replace("\n", "\0\n\0")
        if not LATE_MARK.search(text) and text[0] not in ".,":
            s = s.replace(",", "\0,").replace(".", "\0.")
        return [p for p in s.split("\0") if p]

    def split(self, part: str) -> list[str]:
        """A part cut further where no piece holds both neighbours."""
        if len(part) < 64:
            at = [0, *(k for k in range(1, len(part)) if part[k - 1 : k + 1] not in self.bigrams), len(part)]
        else:
            c = self.number[np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4")]
            at = [0, *(np.flatnonzero(~self._joined(c[:-1], c[1:])) + 1).tolist(), len(part)]
        return [part[a:b] for a, b in zip(at, at[1:], strict=False)]

    def _joined(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether some piece holds these neighbouring characters."""
        key = first.astype(np.int64) * self.width + second
        return self.joint[np.minimum(np.searchsorted(self.joint, key), len(self.joint) - 1)] == key

    def _learn(self, parts: list[str]) -> None:
        """Best segmentation, score and loss of new parts."""
        easy = [p for p in parts if len(p) <= LONG_PART and self.known.issuperset(p)]
        for at in range(0, len(easy), PARTS_AT_ONCE):
            self._keep(easy[at : at + PARTS_AT_ONCE], *self._best_of_all(easy[at : at + PARTS_AT_ONCE]))
        seen, own = set(easy), len(parts) - len(easy)
        if own:
            rest = sorted((p for p in parts if p not in seen), key=len)  # the longest at the end, which goes again
            found = [list(map(self.best_and_loss, self.split(p))) for p in rest]  # a part's own pieces are combined once
            ids = [np.array([i for x, _, _ in few for i in x], "<u4").tobytes() for few in found]
            self._keep(rest, ids, [sum(x for _, x, _ in few) for few in found], [min(x for _, _, x in few) for few in found])

    def _keep(self, parts: list[str], ids: list[bytes], score: list[float] | np.ndarray, loss: list[float] | np.ndarray) -> None:
        n = len(self.ids)
        self.index.update(zip(parts, range(n, n + len(parts)), strict=True))
        self.ids += ids
        if len(self.ids) > len(self.score):
            self.score, self.loss = (np.concatenate((x[:n], np.zeros(len(self.ids)))) for x in (self.score, self.loss))
        self.score[n : len(self.ids)], self.loss[n : len(self.ids)] = score, loss

    def _best_of_all(self, parts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """(ids, score, loss) of short parts of known characters: all lattices at once, edges as arrays."""
        c = self.number[np.frombuffer("\0".join([*parts, ""]).encode("utf-32-le"), "<u4")]  # every part ends with a 0
        n = len(c)
        fresh = np.r_[True, ~self._joined(c[:-1], c[1:])]  # where a lattice starts, and what follows its end
        at, node, reach, found = np.flatnonzero(c), np.zeros(np.count_nonzero(c), np.int64), 0, []
        while len(at):
            key = node * self.width + c[at + reach]
            k = np.minimum(np.searchsorted(self.step, key), len(self.step) - 1)
            own = self.step[k] == key
            at, node, reach = at[own], self.to[k[own]], reach + 1
            hit = self.piece_at[node] >= 0
            found.append((at[hit], at[hit] + reach, node[hit]))
        a, b, node = map(np.concatenate, zip(*found, strict=True))  # edges over the characters a to b - 1
        head = np.flatnonzero(fresh)
        begin = head[np.cumsum(fresh) - 1]
        # forward scores of what ends with a character; n stands for nothing
        ahead, behind = np.zeros(n + 1), np.zeros(n + 1)
        order = np.lexsort((a, b, b - begin[a]))
        a, b, node = a[order], b[order], node[order]
        score, before, after = self.score_at[node], np.where(fresh[a], n, a - 1), np.where(fresh[b], n, b)
        for lo, hi in _ranges(b - begin[a]):
            first = lo + np.flatnonzero(np.r_[True, b[lo + 1 : hi] != b[lo : hi - 1]])
            ahead[b[first] - 1] = np.maximum.reduceat(ahead[before[lo:hi]] + score[lo:hi], first - lo)
        top = np.flatnonzero(ahead[before] + score == ahead[b - 1])
        edge = np.zeros(n, np.int64)  # of the best path, by its last character
        edge[b[top[::-1]] - 1] = top[::-1]  # the first of equal ones
        on, last = np.zeros(len(a), bool), np.flatnonzero(fresh[1:] & (c[:-1] > 0))
        ends = last
        while len(last):
            on[edge[last]] = True
            last = before[edge[last]]
            last = last[last < n]
        # backward scores, and the best path through each edge that is not on the best path
        order = np.lexsort((a, begin[a] - a))
        for lo, hi in _ranges((a - begin[a])[order]):
            own = order[lo:hi]
            first = np.flatnonzero(np.r_[True, a[own[1:]] != a[own[:-1]]])
            behind[a[own[first]]] = np.maximum.reduceat(behind[after[own]] + score[own], first)
        through = np.where(on, -np.inf, ahead[before] + (behind[after] + score))
        second = np.full(n, -np.inf)
        np.maximum.at(second, begin[a], through)
        loss = ahead[ends] - second[begin[ends]]
        part = np.cumsum(c == 0)  # of each character
        first = np.flatnonzero(np.r_[True, part[ends[1:]] != part[ends[:-1]]])
        path = np.flatnonzero(on)
        path = path[np.argsort(b[path])]
        cut = np.r_[0, np.cumsum(np.bincount(part[a[path]], minlength=len(parts)))] * 4
        raw = self.piece_at[node[path]].astype("<u4").tobytes()
        return [raw[x:y] for x, y in zip(cut.tolist(), cut[1:].tolist(), strict=False)], np.add.reduceat(ahead[ends], first), np.minimum.reduceat(loss, first)

    def segmented_all(self, texts: list[str], n: int) -> Iterator[list[tuple[float, bytes]]]:
        """Per text the n best segmentations: (score, ids as little-endian 32-bit)."""
        index, kept = self.index, len(self.ids)
        rows = [self.cut(t.replace("\0", "\ufffd")) if t else [] for t in texts]
        found = [list(map(index.get, parts)) for parts in rows]
        new = {p: None for parts, at in zip(rows, found, strict=True) if None in at for p, k in zip(parts, at, strict=True) if k is None}
        if new:
            self._learn(list(new))
        for parts, at in zip(rows, found, strict=True):
            yield self._n_best(parts, list(map(index.__getitem__, parts)) if new and None in at else at, n)
        if kept <= CACHED_PARTS:  # long parts are the last of the new ones
            while len(self.ids) > kept and len(next(reversed(index))) > LONG_PART:
                index.popitem()
                self.ids.pop()
        else:
            for p in new:
                del index[p]
            del self.ids[kept:]

    def segmented(self, text: str, n: int) -> list[tuple[float, bytes]]:
        return list(self.segmented_all([text], n))[0]

    def _n_best(self, parts: list[str], at: list[int], n: int) -> list[tuple[float, bytes]]:
        if not parts:
            return [(0.0, b"")]
        own = np.array(at)
        row, total = list(map(self.ids.__getitem__, at)), float(self.score[own].sum())
        out = [(total, b"".join(row))] if n == 1 else []
        if n > 1:
            loss = self.loss[own]
            near = np.argsort(loss, kind="stable")[: n - 1]
            near = np.sort(near[np.isfinite(loss[near])])
            choices = [self._combined(self.split(parts[k]), n) for k in near]
            for drop, pick in _cheapest([[c[0][0] - x for x, _ in c] for c in choices], n):
                other = list(row)
                for k, c, x in zip(near, choices, pick, strict=True):
                    other[k] = c[x][1]
                out.append((total - drop, b"".join(other)))
        return out

    def _combined(self, parts: list[str], n: int) -> list[tuple[float, bytes]]:
        """The n best of a row of independent lattices."""
        choices = [self.best(p, n) for p in parts]
        if len(parts) == 1:
            return [(score, np.array(ids, "<u4").tobytes()) for score, ids in choices[0]]
        out = []
        for _, pick in _cheapest([[c[0][0] - x for x, _ in c] for c in choices], n):
            chosen = [c[x] for c, x in zip(choices, pick, strict=True)]
            out.append((sum(s for s, _ in chosen), np.array([i for _, ids in chosen for i in ids], "<u4").tobytes()))
        return out

    def decode(self, ids: list[int] | np.ndarray) -> str:
        return b"".join(self.spelling[ids].tolist()).decode("utf-8", "replace").replace(SPACE, " ")[1:]


def _ranges(x: np.ndarray) -> Iterator[tuple[int, int]]:
    """(from, to) of equal neighbours."""
    edges = [0, *(np.flatnonzero(x[1:] != x[:-1]) + 1).tolist(), len(x)]
    return zip(edges, edges[1:], strict=False)


def _cheapest(costs: list[list[float]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n cheapest ways to pick one entry of each list; lists rise from 0."""
    if all(len(c) == 1 for c in costs):
        return [(0.0, (0,) * len(costs))]
    start = (0,) * len(costs)
    queue, seen, out = [(0.0, tuple(-x for x in start), start)], {start}, []
    while queue and len(out) < n:
        cost, _, pick = heapq.heappop(queue)
        out.append((cost, pick))
        for k, c in enumerate(costs):
            if pick[k] + 1 < len(c):
                more = (*pick[:k], pick[k] + 1, *pick[k + 1 :])
                if more not in seen:
                    seen.add(more)
                    heapq.heappush(queue, (sum(x[i] for x, i in zip(costs, more, strict=True)), tuple(-x for x in more), more))
    return out


def vocabulary(model_file: str) -> Vocabulary:
    """This worker's vocabulary."""
    return resident(("vocabulary", model_file), lambda: Vocabulary(model_file))


def n_best(docs: DataFrame, model_file: str, n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rank, score, n_pieces, ids): the n best segmentations of every text, from rank 1; ids are little-endian 32-bit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(model_file)
        for pdf in batches:
            names = ids_of(pdf["id"])
            for first, texts in in_slices(pdf["text"].tolist()):
                out = []
                for k, best in enumerate(v.segmented_all(texts, n), first):
                    out += [(names[k], r, s, len(ids) // 4, ids) for r, (s, ids) in enumerate(best, 1)]
                yield pd.DataFrame(out, columns=["id", "rank", "score", "n_pieces", "ids"]).astype({"id": object})

    kind = docs.schema[id_col].dataType.simpleString()
    return (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .mapInPandas(run, f"id {kind}, rank int, score double, n_pieces long, ids binary").withColumnRenamed("id", id_col)
    )


def decoded(rows: DataFrame, model_file: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``rows`` with the text that their ids spell; null ids give null."""
    names, kinds = [c for c in rows.columns if c != text_col], dict(rows.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(model_file)
        for pdf in batches:
            texts = [None if x is None else v.decode(np.frombuffer(x, "<u4")) for x in pdf[ids_col]]
            yield nullable(pdf, kinds).assign(**{text_col: pd.Series(texts, pdf.index, object)})

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names)
    return rows.select(*names).mapInPandas(run, f"{schema}, `{text_col}` string")
