"""Tokens, packing, files, language ID, n-best and preferences against brute force."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import zstandard

pytest.importorskip("public_tokenizers")
from public_tokenizers import path
from tokenizers import Tokenizer

import __spark_entry__ as entry
from tallyloom.llm import langid, nbest
from tallyloom.llm.packing import Capacity, best_fit, pack_documents, sequences
from tallyloom.llm.preferences import format_preferences, stale_reply_pairs
from tallyloom.llm.token_files import TokenFileReader, read_token_files, write_token_files
from tallyloom.llm.tokens import WordEncoder

BYTE, WORD, PIECE = path("byte_bpe_50k.json"), path("word_bpe_49k.json"), path("piece_bpe_32k.model")
ODD = [
    "", " ", "  a", "a  b", " a", "a ", "a\nb", "a\n", "a.", "a,b", "3.14", "a..b", "a., b", ".a", ", a", "a \n b", "a\n\t\tb", "don't. it's,", "x\x1cy z", "¶ a ¶, b", "tab\t x", "<|endoftext|> q", "end <|endoftext|> start", "a<|endoftext|>b<|startoftext|>", "<|endoftext|><|endoftext|>\n<|endoftext", ". <|endoftext|>.",
    "é́. ́,y", "İ Σ ς", "日本 語。 本.", "🙂 a🙂,", "_a_ _.", "a\0b c", "½, ² ⅷ.", "word " * 3000, "z" * 5000,
]
SCHEMA = "doc_id long, text string, id string, piece string, lang string"


def frame(spark, texts, langs=None):
    return spark.createDataFrame([(i, t, "x", "y", langs[i] if langs else None) for i, t in enumerate(texts)], SCHEMA)


def reference(file):
    return Tokenizer.from_file(file)


@pytest.mark.parametrize("file", [BYTE, WORD])
def test_word_by_word_is_whole(file):
    e, t = WordEncoder(file), reference(file)
    for _ in range(2):  # the second time from the cache
        for text, ids in zip(ODD, e.encode(ODD), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(rule):
    lengths = np.random.default_rng(1).integers(1, 101, 3000)
    c = Capacity(tokens=100, documents=3, cost=6000, rule=rule)
    lengths = lengths[lengths <= c.longest]
    where, offset, n = best_fit(lengths, c)
    held = defaultdict(list)
    for w, o, s in zip(where, offset, lengths, strict=True):
        held[w].append((o, s))
    assert len(held) == n
    for rows in held.values():
        at = 0
        for o, s in sorted(rows):
            assert o == at
            at += s
        assert at <= 100 and len(rows) <= 3 and sum(s * s for _, s in rows) <= 6000


def test_packing(spark):
    texts = [None, *ODD] * 3
    t, seen = reference(BYTE), defaultdict(list)
    rows = pack_documents(frame(spark, texts), BYTE).collect()
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        seen[r.sequence_id].append((r.offset, r.length))
    total = 0
    for i, text in enumerate(texts):
        ids = np.asarray(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        at, total = 0, total + len(ids)
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == 1024) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for v in seen.values():
        assert [o for o, _ in sorted(v)] == [0, *np.cumsum([n for _, n in sorted(v)])[:-1].tolist()] and sum(n for _, n in v) <= 1024
    assert len(seen) <= -(-total // 1024) + 2
    assert pack_documents(frame(spark, ["x"]).limit(0), BYTE).count() == 0


def test_packed_sequences_hold_the_ids(spark):
    texts = [*ODD, None, "some words " * 900]
    placed = pack_documents(frame(spark, texts), BYTE).cache()
    own = {r.sequence_id: r for r in sequences(placed).collect()}
    t, got = reference(BYTE), defaultdict(bytes)
    for r in sorted(placed.collect(), key=lambda r: (r.doc_id, r.piece)):
        got[r.doc_id] += own[r.sequence_id].ids[4 * r.offset : 4 * (r.offset + r.length)]
    for i, text in enumerate(texts):
        assert got[i] == np.asarray(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4").tobytes()
    assert all(len(r.ids) == 4 * r.length <= 4096 for r in own.values())


def test_nbest_ids_decode(spark):
    texts = ["hello world", "so, it  is", "é🙂\nq.", "", None]
    rows = nbest.decoded(nbest.n_best(frame(spark, texts), PIECE), PIECE).collect()
    assert {r.doc_id for r in rows} == set(range(5)) and max(r["rank"] for r in rows) == 3
    assert all(r.text == (texts[r.doc_id] or "") and len(r.ids) == 4 * r.n_pieces for r in rows)


def test_token_files(spark):
    texts = [*ODD, None]
    t, start, want = reference(WORD), 0, []
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        start += len(ids)
    manifest = write_token_files(frame(spark, texts).repartition(3), WORD)
    assert sorted(map(tuple, read_token_files(manifest).collect())) == want
    small = write_token_files(frame(spark, texts).repartition(3), WORD, file_docs=2)
    assert small.count() >= len(texts) // 2 and sorted(map(tuple, read_token_files(small).collect())) == want
    row = manifest.orderBy("first_id").first()
    reader = TokenFileReader(row["path"])
    assert [(d, len(ids)) for d, ids in reader.read([row["first_id"]])] == [(want[0][0], want[0][2])]
    assert read_token_files(write_token_files(frame(spark, ["x"]).limit(0), WORD)).count() == 0


def test_token_files_with_null_and_repeated_ids(spark):
    rows = spark.createDataFrame([(5, "b"), (None, "zero"), (5, "a"), (2, None)], "doc_id long, text string")
    manifest = write_token_files(rows, WORD)
    single = read_token_files(write_token_files(rows, WORD, file_docs=1)).collect()
    assert sorted(map(tuple, single), key=repr) == sorted(map(tuple, read_token_files(manifest).collect()), key=repr)
    got = sorted(read_token_files(manifest).collect(), key=lambda r: r.start)
    t = reference(WORD)
    want = [t.encode(x, add_special_tokens=False).ids + [2] for x in ("zero", "", "a", "b")]
    assert [r.id for r in got] == [None, 2, 5, 5] and [r.start for r in got] == [0, *np.cumsum([len(w) for w in want])[:-1].tolist()]
    assert [r.ids_crc32 for r in got] == [zlib.crc32(np.asarray(w, "<u4").tobytes()) for w in want]
    data = open(manifest.first()["path"].removeprefix("file://"), "rb").read()
    plain = zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(data)
    assert plain == b"".join(np.asarray(w, "<u4").tobytes() for w in want)  # other tools skip the tables


def test_damaged_file(spark, tmp_path):
    row = write_token_files(frame(spark, ["some words"] * 4).coalesce(1), WORD).first()
    data = bytearray(open(row["path"].removeprefix("file://"), "rb").read())
    data[len(data) // 8] ^= 1
    (tmp_path / "bad").write_bytes(data)
    with pytest.raises(Exception, match="damaged|checksum|frame|decompress"):
        list(TokenFileReader(str(tmp_path / "bad")).read())


def test_language_words_sum_all_segmentations():
    pieces = {"▁": 0, "a": 1, "b": 2, "ab": 3, "▁a": 4, "▁ab": 5}
    p = np.array([0.1, 0.2, 0.15, 0.05, 0.3, 0.2, 1e-8])
    model = langid.LanguageModel(("x",), pieces, p[:, None], np.zeros(1))

    def brute(s):
        if not s:
            return 1.0
        return sum((p[pieces[s[:k]]] if s[:k] in pieces else 1e-8 if k == 1 else 0) * brute(s[k:]) for k in range(1, len(s) + 1) if s[:k] in pieces or k == 1)

    whole = [langid._of_long_word(w, model)[0] for w in ("ab", "abab", "bb", "aqb")]
    assert np.allclose(whole, langid.log_likelihoods(["ab", "abab", "bb", "aqb"], model)[:, 0])
    assert np.isfinite(langid.log_likelihoods(["ab" * 5000, "a"], model)).all()
    assert langid.words("½ ² ① ⅷ 7_") == [] and langid.words("x²y Ab") == ["x", "y", "ab"]
    for w in ("ab", "abab", "bb", "aqb"):
        assert np.isclose(np.exp(langid.log_likelihoods([w], model)[0, 0]), brute("▁" + w))


def test_language_id(spark):
    rng = random.Random(1)
    words = {"en": "the and that with thing have this from".split(), "de": "der und nicht mit das sein für über".split()}
    texts = [" ".join(rng.choices(words[x], k=30)) for x in ["en", "de"] * 60] + [None, "", "123 --", "The", "½ ² ⅷ", "x" * 30_000]
    langs = ["en", "de"] * 60 + [None] * 6
    rows = {r.doc_id: r for r in langid.identified(frame(spark, texts, langs), PIECE).collect()}
    assert all(rows[i].lang_pred == langs[i] and 0 < rows[i].score <= 1 for i in range(120))
    assert [rows[i].lang_pred for i in (120, 121, 122, 124)] == ["und"] * 4 and rows[125].lang_pred in words and rows[120].score == 0.0 and rows[123].lang_pred in words
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    assert {r.lang_pred for r in langid.identified(frame(spark, ["hello there"]), PIECE).collect()} == {"und"}
    assert langid.identified(frame(spark, ["x"]).limit(0), PIECE).count() == 0


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.001"
    found = entry.queries()["op3_language_id"](spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.97 * len(found)


@pytest.fixture(scope="module")
def vocabulary():
    return nbest.Vocabulary(PIECE)


@pytest.mark.parametrize("text", ["hello", "the the", "a  b", " x", "é🙂\nq.", "so, it is", "...", "日本", "no\n\nway", "3,4. 5"])
def test_nbest_is_the_whole_lattice(vocabulary, text):
    got, want = vocabulary.segmented(text, 5), vocabulary.best("▁" + text.replace(" ", "▁"), 5)
    assert np.allclose([s for s, _ in got], [s for s, _ in want]) and len({i for _, i in got}) == len(got)
    assert all(vocabulary.decode(np.frombuffer(i, "<u4").tolist()) == text for _, i in got)


def test_nbest_parts_together_are_parts_alone(vocabulary):
    rng = random.Random(5)
    parts = list({"".join(rng.choices("▁theandirsouéü,.", k=rng.randint(1, 40))) for _ in range(300)} | {"▁", "a", "▁the"})
    assert all(map(vocabulary.known.issuperset, parts)) and not vocabulary.known.issuperset("\n")  # spelled in bytes, so not searched together
    for p, ids, score, loss in zip(parts, *vocabulary._best_of_all(parts), strict=True):
        few = list(map(vocabulary.best_and_loss, vocabulary.split(p)))
        assert ids == np.array([i for x, _, _ in few for i in x], "<u4").tobytes()
        assert np.isclose(score, sum(x for _, x, _ in few)) and (loss == (want := min(x for _, _, x in few)) or np.isclose(loss, want))
    texts = ["so, it is", "日本 the", "x" * 200, "", "the " * 50]
    met = len(vocabulary.ids)
    assert list(vocabulary.segmented_all(texts, 3)) == [vocabulary.segmented(t, 3) for t in texts]
    assert max(map(len, vocabulary.index)) <= nbest.LONG_PART and len(vocabulary.ids) == len(vocabulary.index) > met - 1


def test_nbest_is_brute_force(vocabulary):
    s = "▁there"

    def every(s):
        if not s:
            return [0.0]
        return [vocabulary.pieces[s[:k]][1] + x for k in range(1, len(s) + 1) if s[:k] in vocabulary.pieces for x in every(s[k:])]

    want = sorted(every(s), reverse=True)[:10]
    assert np.allclose([x for x, _ in vocabulary.best(s, 10)], want)


def test_nbest_table(spark):
    rows = nbest.n_best(frame(spark, [None, "", "hello world", "hello world"]), PIECE).collect()
    assert [(r["rank"], r.n_pieces, r.score) for r in rows if r.doc_id < 2] == [(1, 0, 0.0)] * 2
    assert [tuple(r)[1:] for r in rows if r.doc_id == 2] == [tuple(r)[1:] for r in rows if r.doc_id == 3]
    assert nbest.n_best(frame(spark, ["x"]).limit(0), PIECE).count() == 0


def test_preferences(spark):
    schema = "pair_id long, turn long, role string, text string, c string"
    a = [(1, 0, "user", "hi", ""), (1, 1, "assistant", "yes", ""), (2, 0, "user", "q<|x|>", ""), (3, 0, None, None, ""), (4, 0, "user", "only chosen", "")]
    b = [(1, 0, "user", "hi", ""), (1, 1, "assistant", "no!", ""), (2, 0, "user", "q<|x|>", ""), (2, 1, "assistant", "more", ""), (3, 0, "user", "z", "")]
    rows = {r.pair_id: r for r in format_preferences(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).collect()}
    assert set(rows) == {1, 2, 3}
    one = rows[1]
    assert (one.prompt_turns, one.prompt, one.chosen) == (1, "<|user|>\nhi<|end|>\n", "<|assistant|>\nyes<|end|>\n")
    start, end = map(int, one.chosen_mask.split("-"))
    assert one.chosen[start:end] == "yes<|end|>" and one.rejected_mask == one.chosen_mask
    assert (rows[2].prompt_turns, rows[2].chosen, rows[2].chosen_mask) == (1, "", "") and "<\\|x" in rows[2].prompt and rows[2].rejected_mask
    assert rows[3].prompt_turns == 0 and rows[3].chosen == "<||>\n<|end|>\n"
    none = spark.createDataFrame([], schema)
    assert format_preferences(none, none).count() == 0


def test_pairs_from_one_or_no_assistant_turn(spark):
    turns = [(1, 0, "user", "q"), (1, 1, "assistant", "only"), (2, 0, "user", "q"), (3, 0, "assistant", "first"), (3, 1, "user", "x"), (3, 2, "assistant", "last"), (None, 0, "assistant", "n")]
    rows = format_preferences(*stale_reply_pairs(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).collect()
    assert {r.pair_id: (r.chosen, r.rejected) for r in rows} == {
        1: ("<|assistant|>\nonly<|end|>\n", "<|assistant|>\n<|end|>\n"), 3: ("<|assistant|>\nlast<|end|>\n", "<|assistant|>\nfirst<|end|>\n"),
    }


def test_preferences_run_no_python(spark, capsys):
    entry.queries()["op5_preference_pairs"](spark, "/root/testdata/sf0.001").explain()
    assert "Python" not in capsys.readouterr().out
