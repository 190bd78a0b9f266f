"""Exact, near and substring deduplication against brute force, with awkward rows."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from tallyloom.llm import substring_dedup
from tallyloom.llm.common import components, mix64, shingle_set
from tallyloom.llm.exact_dedup import exact_duplicates
from tallyloom.llm.near_dedup import near_duplicates
from tallyloom.llm.substring_dedup import Paragraphs, without_repeats

SCHEMA = "doc_id long, text string, lang string, fp string, n int"


def frame(spark, texts):
    """Further columns clash with names that the operators use inside."""
    return spark.createDataFrame([(i, t, None, "x", 1) for i, t in enumerate(texts)], SCHEMA)


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(n))


def corpus(seed, small=False):
    rng = random.Random(seed)
    texts = [None, "", "  \n\t ", "one two", "One  TWO", "a b c d e", None, "x" * 50_000, "12 %% --"]
    for _ in range(6 if small else 25):
        words = prose(rng, rng.randint(8, 120)).split()
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 4)):
            copy = list(words)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = prose(rng, 1)
            texts.append(" ".join(copy) + rng.choice(["", "\n", " end"]))
    passage = prose(rng, 40)
    texts += [f"{prose(rng, rng.randint(1, 30))} {passage}" for _ in range(8 if small else 90)]  # a hot passage, mostly short pages
    texts += [texts[12]] * 30
    rng.shuffle(texts)
    return texts


def root_of(links, n):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    texts = corpus(seed)
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = root_of(links, len(texts))
    got = sorted(near_duplicates(frame(spark, texts)).collect())
    assert [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got] == [(i, len(s), want[i], want[i] == i) for i, s in enumerate(sets)]


def test_short_near_duplicates_in_long_lists(spark):
    """24 of 32 shingles; the partner lists 16 or 17 of them, each in a list of over 64 texts that neither leads."""
    rng = random.Random(11)
    while True:
        words = prose(rng, 36).split()
        pair = [" ".join(words[:28]), " ".join(words)]
        listed = set(shingle_set(pair[1])[:24].tolist())
        common = [g for g in (" ".join(words[k : k + 5]) for k in range(24)) if int(shingle_set(g)[0]) in listed]
        if len(common) in (16, 17):
            break
    texts = [*pair, *(f"{g} {prose(rng, 3)}" for g in common for _ in range(70))]
    got = {r.doc_id: r.component_id for r in near_duplicates(frame(spark, texts)).collect()}
    assert got[1] == 0 and all(got[i] == i for i in range(2, len(texts)))


def test_one_id_for_two_texts(spark):
    """Rows of one id are documents of their own: each links by its own text."""
    rng = random.Random(12)
    a, b = (prose(rng, 60) for _ in range(2))
    rows = spark.createDataFrame([(1, a), (1, b), (2, a + " end"), (3, b + " end"), (0, prose(rng, 60))], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in near_duplicates(rows).collect()) == [(0, 0), (1, 1), (1, 1), (2, 1), (3, 1)]
    assert {r.text for r in without_repeats(rows).where("n_removed = 0").collect()} >= {a, b}


def test_exact_duplicates(spark):
    texts = corpus(3)
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[t or ""].append(i)
    want = [(i, max(groups[t or ""]), len(groups[t or ""]), max(groups[t or ""]) == i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in enumerate(texts)]
    assert sorted(map(tuple, exact_duplicates(frame(spark, texts)).collect())) == want


def test_repeated_and_null_ids(spark):
    rows = spark.createDataFrame([(1, "a", None, None, 1), (1, "a", None, None, 1), (None, "a", None, None, 1)], SCHEMA)
    assert exact_duplicates(rows).where("kept").count() == 2
    assert sorted(map(tuple, near_duplicates(rows).drop("text_hash").collect()), key=repr) == [(1, 1, 1, True), (1, 1, 1, True), (None, 1, None, None)]
    assert without_repeats(rows).count() == 3


def test_empty_tables(spark):
    none = frame(spark, ["x"]).limit(0)
    for f in (exact_duplicates, near_duplicates, without_repeats):
        assert f(none).count() == 0


def test_long_chain_of_components(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(500, 501)], "a long, b long")
    found = {r.node: r.component for r in components(edges).collect()}
    assert set(found.values()) == {0, 500} and found[200] == 0 and len(found) == 203


def test_repeated_passages(spark):
    rng = random.Random(5)
    cap = lambda n: prose(rng, n).capitalize() + "."
    passage = " ".join(cap(rng.randint(6, 15)) for _ in range(7))
    own = [" ".join(cap(9) for _ in range(8)) for _ in range(12)]
    texts = [f"{t} {passage} {cap(7)}" if i % 3 == 0 else t for i, t in enumerate(own)] + [None, "", " \n "]
    got = {r.doc_id: r for r in without_repeats(frame(spark, texts)).collect()}
    for i, t in enumerate(own):
        if i % 3 or not i:
            assert got[i].text == texts[i] and got[i].n_removed == 0  # clean documents and the first place
        else:
            assert passage not in got[i].text and t in got[i].text and got[i].n_removed >= 7
    assert [got[i].text for i in (12, 13, 14)] == [None, "", " \n "]


def test_passages_in_rows_with_null_and_repeated_ids(spark):
    """A passage of an ordinary row goes from the others; columns are called as the operator's own."""
    rng = random.Random(15)
    passage, own = prose(rng, 120), [prose(rng, 40) for _ in range(6)]
    schema = "doc_id long, text string, removed string, n_removed int, _id long, _row int, _marks int, id long, stop int, Words string"
    rows = [(1, f"{own[0]} {passage}"), (7, f"{own[1]} {passage}"), (7, own[2]), (None, f"{own[3]} {passage}"), (None, f"{passage} {own[4]}"), (9, own[5]), (9, own[5]), (None, None)]
    df = spark.createDataFrame([(i, t, "r", 5, 6, 7, 8, 9, 10, "w") for i, t in rows], schema)
    found = without_repeats(df)
    got = sorted(((r.doc_id, r.text and r.text.rstrip()) for r in found.collect()), key=repr)
    assert got == sorted([rows[0], (7, own[1]), (7, own[2]), (None, own[3]), (None, own[4]), *rows[5:]], key=repr)
    assert {(r._id, r._row, r._marks, r.id, r.stop, r.Words) for r in found.collect()} == {(6, 7, 8, 9, 10, "w")}
    assert set(found.columns) == set(df.columns) and found.schema["n_removed"].dataType.simpleString() == "int"


def test_near_passages_cluster(spark):
    rng = random.Random(6)
    words = prose(rng, 60).split()
    changed = words[:30] + ["zz"] + words[31:]
    texts = [" ".join(words), "own words here " + " ".join(changed)]
    assert 100 * len(shingles(texts[0]) & shingles(" ".join(changed))) >= 75 * len(shingles(texts[0]) | shingles(" ".join(changed)))
    got = {r.doc_id: r for r in without_repeats(frame(spark, texts)).collect()}
    assert got[0].text == texts[0] and got[1].n_removed > 0 and len(got[1].text.split()) <= 12


def test_paragraphs_do_not_depend_on_place():
    rng = random.Random(7)
    passage = " ".join(prose(rng, rng.randint(3, 40)).capitalize() + "." for _ in range(9))
    alone = set(Paragraphs(passage).digests().tolist())
    within = set(Paragraphs(f"{prose(rng, 30)} {passage}\n{prose(rng, 20)}").digests().tolist())
    assert len(alone - within) <= 2


@pytest.mark.parametrize("stops", [None, (5, 12), (8, 20), (15, 30)])
def test_passages_of_51_to_60_words_at_any_word(spark, stops):
    rng = random.Random(9)

    def running(n):
        words = prose(rng, n).split()
        at = rng.randint(*stops) if stops else n
        while at < n:
            words[at] += "."
            at += rng.randint(*stops) if stops else n
        return " ".join(words)

    texts, own = [], []
    for _ in range(60):
        passage = running(rng.randint(51, 60))
        for _ in range(2):
            own.append((running(rng.randint(1, 50)), running(rng.randint(1, 50))))
            texts.append(f"{own[-1][0]} {passage} {own[-1][1]}")
    got = {r.doc_id: r.text for r in without_repeats(frame(spark, texts)).collect()}
    for i, (before, after) in enumerate(own):
        assert got[i] == (texts[i] if i % 2 == 0 else f"{before} {after}")


def test_near_paragraphs_in_a_hot_band(spark):
    """All sentences share the smallest shingle of every band; the first of the bands resembles none of the near pair."""
    rng = random.Random(10)
    drawn = [(p, Paragraphs(f"x y z. {p} {prose(rng, 15)}.")) for p in (prose(rng, 5) for _ in range(2000))]
    hot = []
    for band in range(substring_dedup.BANDS):
        seed = substring_dedup._SEEDS[band * substring_dedup.ROWS]
        hot.append(min(drawn, key=lambda d: int(mix64(d[1].shingles()[3:4] ^ seed)[0]))[0])  # noqa: B023
    head, rows = " ".join(hot), []
    for _ in range(12):
        rows.append(f"{head} {prose(rng, 20)}.")
    fp = lambda t: int(Paragraphs(f"own words. {t} end").digests().view("int64")[1])
    rows.sort(key=fp)
    kept = rows[5].split(" ")
    near = next(t for t in (" ".join([*kept[:34], "zzz" + prose(rng, 1), *kept[35:]]) for _ in range(1000)) if fp(t) > fp(rows[0]))
    texts = [f"{prose(rng, 3)}. {t} {prose(rng, 4)}" for t in [*rows, near]]
    got = {r.doc_id: r for r in without_repeats(frame(spark, texts), run_words=36).collect()}
    assert [i for i, r in got.items() if r.n_removed] == [12]
    assert near not in got[12].text


def test_shingle_blocks(monkeypatch):
    import tallyloom.llm.common as c

    text = prose(random.Random(8), 5000)
    whole = shingle_set(text)
    monkeypatch.setattr(c, "_BLOCK", 777)
    assert (shingle_set(text) == whole).all() and len(whole) == len(shingles(text))
