"""Speculative BPE against the library, periodic runs and spelling variants against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

pytest.importorskip("public_tokenizers")
from public_tokenizers import path
from tokenizers import Tokenizer

from tallyloom.llm import bpe, periodic, queries, variants

WORD = path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, ids string, words string, n long, runs string, decoded string, word string, key string"


def frame(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", "y", 1, "z", "d", "w", "k") for i, t in rows], SCHEMA)


def table(tmp_path, rows):
    pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}).to_parquet(tmp_path / "documents.parquet")
    return str(tmp_path)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- BPE


@pytest.fixture(scope="module")
def model():
    return bpe.SpeculativeBpe(WORD)


def test_every_token_that_is_proposed_is_what_its_text_merges_to(model):
    inner = [t for t in model._propose if len(t.rstrip("\n")) > 1]
    assert len(inner) > 40_000
    for t in random.Random(1).sample(inner, 4000):
        if t.endswith("\n"):
            assert model.merged(t) == model._merged_long([model._base[x] for x in (*t[:-2], t[-2:])]) == [model._propose[t]]


def test_random_words_equal_the_library(model):
    r, library = random.Random(2), Tokenizer.from_file(WORD)
    letters = ["abeinrstao", "aab", "it's ,.!?<|/>", "éàüß東京日", "0123456789-", "ΣσςİIı"]
    texts = ["".join(r.choice(r.choice(letters)) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    texts += ["a<|endoftext|>b <|startoftext|><|endoftext|>", "<|endoftext", "é é ́x", "x\x1cy\x85z　w​q", "\0a\0", "🙂a 🙂", "ab" * 5000, "x" * 3001, "Don'T WE'LL i'm"]
    for _ in range(2):  # the second time from the cache
        for text, ids in zip(texts, model.encode(texts), strict=True):
            want = library.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(ids, "<i4").tolist() == want, text
            assert model.decode(np.array(want, np.int64), np.array([len(want)])) == [library.decode(want, skip_special_tokens=False)]


def test_all_letters_up_to_the_last_latin_one(model):
    library = Tokenizer.from_file(WORD)
    texts = [f"a{chr(c)}b1 x{chr(c)} {chr(c)}" for c in range(0x180)] + [f"İ{chr(c)}" for c in (*range(0x180, 0x260), *range(0x2FF, 0x370))]
    for text, ids in zip(texts, model.encode(texts), strict=True):
        assert np.frombuffer(ids, "<i4").tolist() == library.encode(text, add_special_tokens=False).ids, hex(ord(text[1]))


def test_unknown_ids_are_left_out(model):
    assert model.decode(np.array([-1, 1, 10**6, 2]), np.array([2, 0, 2])) == [model.tokens[1], "", model.tokens[2]]


def test_only_words_that_fail_are_merged(model, monkeypatch):
    words = ["hello\n", "unbelievably\n", "zxqvj\n", "thethethe\n"]
    want, seen = [model.merged(w) for w in words], []
    monkeypatch.setattr(model, "merged", lambda w, f=model.merged: (seen.append(w), f(w))[1])
    assert [np.frombuffer(x, "<i4").tolist() for x in model.encoded_words(words)] == want
    assert set(seen) == {w for w, x in zip(words, want, strict=True) if model.proposed(w) != x}
    assert all(model.compatible(np.array(x[:-1]), np.array(x[1:])).all() for x in want)


def test_other_tokenizers_are_refused():
    with pytest.raises((ValueError, KeyError)):
        bpe.SpeculativeBpe(path("byte_bpe_50k.json"))


def test_bpe_rows(spark):
    rows = [(1, "Hello world"), (1, "Hello world"), (2, None), (3, ""), (None, "a b"), (4, "long word " * 30_000), (5, "<|endoftext|>")]
    library = Tokenizer.from_file(WORD)
    got = sorted(((r.doc_id, list(r.ids), r.decoded) for r in bpe.decoded(bpe.encoded(frame(spark, rows), WORD), WORD).collect()), key=repr)
    ids = lambda t: library.encode(t or "", add_special_tokens=False).ids
    assert got == sorted(((i, ids(t), library.decode(ids(t), skip_special_tokens=False)) for i, t in rows), key=repr)
    assert bpe.decoded(bpe.encoded(frame(spark, rows).limit(0), WORD), WORD).count() == 0


def test_bpe_query(spark, tmp_path):
    rows = [(1, "Hello wörld, it's 12 <|endoftext|> x"), (2, None), (3, "Hello wörld"), (4, "")]
    library = Tokenizer.from_file(WORD)
    want = {}
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i] = (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    got = queries.op11_speculative_bpe(spark, table(tmp_path, rows)).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want


# ---------------------------------------------------------------- periodic runs


def all_runs(w):
    n, found = len(w), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted(((a, b, q) for (a, b), q in found.items()), key=lambda x: (x[0], x[2]))


def some_words(r):
    w = []
    for _ in range(r.randint(0, 5)):
        if r.random() < 0.5:
            p = [b"%d" % r.randint(0, r.choice([1, 2, 3, 50])) for _ in range(r.randint(1, 12))]
            w += (p * r.randint(1, 12))[: r.randint(1, 120)]
        else:
            w += [b"%d" % r.randint(0, r.choice([1, 2, 9, 300])) for _ in range(r.randint(0, 60))]
    return w


def test_runs_equal_brute_force(monkeypatch):
    r = random.Random(3)
    texts = [some_words(r) for _ in range(1500)]
    want = [all_runs(w) for w in texts]
    assert sum(map(len, want)) > 500
    assert periodic.runs_of(texts) == want
    monkeypatch.setattr(periodic, "PLACES_AT_ONCE", 7)
    assert periodic.runs_of(texts[:200]) == want[:200]


def test_thue_morse_words_do_not_fool_the_sums():
    """Sums modulo a power of two meet on such sequences; the words are compared at the end."""
    t = [0]
    while len(t) < 4096:
        t += [1 - x for x in t]
    texts = [[b"%d" % x for x in t], [b"%d" % x for x in (t[:1024] + [1 - x for x in t[:1024]]) * 3 + t]]
    assert periodic.runs_of(texts) == [all_runs(w) for w in texts]


def test_plain_scan_equals_the_sums():
    r = random.Random(4)
    for _ in range(200):
        w = np.array([int(x) for x in some_words(r)] or [0])
        if len(w) >= 24:
            assert sorted(periodic._plain_scan(w)) == sorted(periodic.lag_scan(w))


def test_rare_words_split():
    words = np.array([1] * 30 + [9] + [2] * 30 + [9] + [3] * 10)
    starts, ends = periodic.segments(words, np.zeros(len(words)))
    assert list(zip(starts, ends, strict=True)) == [(0, 30), (31, 61)]
    starts, _ = periodic.segments(np.ones(60, np.int64), np.repeat([0, 1, 2], 20))  # owners are not joined
    assert len(starts) == 0


def test_periodic_rows(spark):
    rows = [(1, "a b " * 12), (1, "a b " * 12), (2, None), (3, ""), (None, "x " * 24), (4, "x " * 23), (5, "q " + "u v w " * 20_000 + "z")]
    got = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.strongest and tuple(r.strongest), r.collapsed) for r in periodic.periodic_runs(frame(spark, rows)).collect()), key=repr)
    ab, x = (0, 24, 2), (0, 24, 1)
    want = [(1, [ab], ab, "a b")] * 2 + [(2, [], None, ""), (3, [], None, ""), (None, [x], x, "x"), (4, [], None, " ".join("x" * 23)), (5, [(1, 60_000, 3)], (1, 60_000, 3), "q u v w z")]
    assert got == sorted(want, key=repr)
    assert periodic.periodic_runs(frame(spark, rows).limit(0)).count() == 0


def test_ties_of_the_strongest_run():
    assert periodic.strongest([(0, 24, 2), (30, 54, 2), (60, 84, 1), (90, 138, 2)]) == (60, 84, 1)
    assert periodic.strongest([]) is None


def test_periodic_query(spark, tmp_path):
    r = random.Random(5)
    rows = [(i, None if i == 7 else "  ".join(x.decode() for x in some_words(r))) for i in range(300)] + [(900, "Ab ab " * 15 + "é " * 24), (901, None)]
    want = {}
    for i, t in rows:
        w = [x.encode() for x in (t or "").split()]
        h = zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0 and w:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]
        runs = [(s, e - s, q) for s, e, q in all_runs(w)]
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        want[i] = (
            len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest(),
        )
    got = queries.op12_periodic_runs(spark, table(tmp_path, rows)).collect()
    assert {x.doc_id: (x.n_runs, x.start, x.length, x.period, x.exponent_milli, x.runs_sha256, x.collapsed_sha256) for x in got} == want
    assert sum(x.n_runs > 0 for x in got) > 50


# ---------------------------------------------------------------- spelling variants


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    return sum(x != y for x, y in zip(a, b, strict=True)) == 1 if len(a) == len(b) else len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def expected(rows, misspell):
    counts = Counter()
    letters = {chr(c) for c in (*range(65, 91), *range(97, 123), *range(0xC0, 0x100))}
    for i, text in rows:
        for w in "".join(c if c in letters else " " for c in text or "").split(" "):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{i}:{w}".encode())
            if w and misspell and i is not None and h % misspell == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = defaultdict(list)
    for a in words:
        for b in words:
            if abs(len(a) - len(b)) < 2 and a != b and one_edit(a, b):
                near[a].append(b)
    form = {a: min(near[a], key=lambda b: (-words[b], b)) for a in near}
    form = {a: b for a, b in form.items() if words[b] >= 2 * words[a]}
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return out


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def some_text(r, vocabulary):
    return " ".join(vocabulary[int(len(vocabulary) * r.random() ** 4)] for _ in range(r.randint(0, 60)))


def made_up(r, n):
    base = ["".join(r.choice("abcdeé") for _ in range(r.randint(4, 9))) for _ in range(n)]
    for w in list(base) * 2:
        k = r.randrange(len(w))
        base += [w[:k] + w[k + 1 :], w[:k] + "x" + w[k:], w[:k] + "Y" + w[k + 1 :]]
    return base


@pytest.mark.parametrize("misspell", [None, 3, 97])
def test_variants_equal_brute_force(spark, misspell):
    r = random.Random(6)
    vocabulary = made_up(r, 60) + ["ÀÉÎõü", "straße×÷ÿ", "word5word", "z" * 200, "z" * 199 + "y", "ﬁnery"]
    rows = [(i, some_text(r, vocabulary)) for i in range(300)] + [(None, some_text(r, vocabulary)), (None, "kettler " * 40 + "kettlerr " * 16 + "kettlerrq " * 5), (5, None), (6, ""), (1, "Hello-hello HELLO"), (1, "Hello-hello HELLO")]
    got = variants.spelling_variants(frame(spark, rows), misspell=misspell).select(COLUMNS)
    want = expected(rows, misspell)
    assert {tuple(x) for x in got.collect()} == want and got.count() == len(want) > 150
    assert sum(x[1] is not None for x in want) > 30 and sum(x[1] is not None and x[2] != x[1] for x in want) > 0


def test_long_texts_are_counted_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(variants, "CHARS_AT_ONCE", 40)
    r = random.Random(11)
    vocabulary = made_up(r, 20) + ["ÀÉÎõü", "z" * 90, "STRASSE"]
    text = " ".join(r.choice(vocabulary) for _ in range(900))
    pieces = list(variants._pieces(text))
    assert "".join(pieces) == text and max(map(len, pieces)) <= 40 + 90
    rows = [(i, text) for i in range(3)] + [(9, "z" * 200), (10, None), (11, "")]
    got = variants.spelling_variants(frame(spark, rows), misspell=97).select(COLUMNS)
    assert {tuple(x) for x in got.collect()} == expected(rows, 97)


def test_tiles_meet_every_pair_once(spark):
    r = random.Random(7)
    words = sorted({w.lower() for w in made_up(r, 150)} | {a + b + c + "same" for a in "abcd" for b in "abcd" for c in "abcd"})
    want = {(a, b) for a in words for b in words if a != b and abs(len(a) - len(b)) < 2 and one_edit(a, b)}
    made = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    tiled = variants.tiles(made)
    got = [(x.word, x.other) for x in variants.near_words(tiled).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    rows = tiled.toPandas().sort_values(["m", "zone", "key"])
    found = []
    for (m, zone, _), part in rows.groupby(["m", "zone", "key"]):
        names = part["word"].tolist()
        for i, j in variants._narrow(names, int(m), 3 * int(zone), min(3 * int(zone) + 3, int(m))):
            found += [(names[a], names[b]) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
    assert len(found) == len(set(found)) and {x for a, b in found for x in ((a, b), (b, a))} == want


def test_variants_of_nothing(spark):
    assert variants.spelling_variants(frame(spark, [(1, "x")]).limit(0), misspell=97).count() == 0
    assert variants.spelling_variants(frame(spark, [(1, None), (2, "one two")])).count() == 0


def test_long_chains_of_forms(spark):
    chain = [(f"w{i:03d}", f"w{i + 1:03d}") for i in range(100)]
    got = {x.word: x.root for x in variants.rooted(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {a: "w100" for a, _ in chain}


def test_variants_query(spark, tmp_path):
    r = random.Random(8)
    rows = [(i, some_text(r, made_up(random.Random(9), 30))) for i in range(200)]
    got = queries.op13_prefix_suffix_tiling(spark, table(tmp_path, rows))
    assert got.columns == COLUMNS and {tuple(x) for x in got.collect()} == expected(rows, 97)
