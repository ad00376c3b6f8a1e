"""Encoding against the tokenizers library."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from airtally.llm import bpe, memory
from airtally.llm.queries import word_bpe

PARTS = ["a", "the", "ing", "'", "'s", "'ll", "!!", "...", "é", "é", "ß", "́", "日本", "👩‍👧", " ", "\n", "<|endoftext|>", "<|start", "oftext|>", "0", "12", "A", "İ", "Σ", "\xa0", "\x1f", "aaaaaaaaaaaa", "thethethe"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(word_bpe())


@pytest.mark.parametrize("seed", range(4))
def test_words_and_trees_equal_the_library(library, monkeypatch, seed):
    encoder, rnd = bpe.Encoder(word_bpe()), random.Random(seed)
    for n in range(250):
        text = "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 120)))
        if n % 3 == 0:
            text = text.replace(" ", "").replace("\n", "")
        wanted = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(pa.array([text]))[0].as_py(), "<u4").tolist() == wanted
        cuts = [0, *bpe.cut_points(text, rnd.choice([5, 9, 30]), encoder.special), len(text)]
        monkeypatch.setattr(bpe, "FIRST_WINDOW", rnd.choice([1, 4, 16]))
        pieces = [encoder.tokens(text[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
        assert bpe.join_all(encoder, pieces).ids.tolist() == wanted


def test_memory_is_bounded(library):
    encoder = bpe.Encoder(word_bpe())
    encoder.known = memory.Recall(generation_bytes=3000)
    for n in range(30):
        text = f"again {n} and other words{n} w{n * 7} x{n}y"
        assert np.frombuffer(encoder.encode(pa.array([text]))[0].as_py(), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(encoder.known.young) + len(encoder.known.old) < 60
    encoder.encode(pa.array(["v" * 65 + " short"]))
    assert "short" in encoder.known.young and "v" * 65 not in encoder.known.young


def test_one_operator_owns_the_memory():
    memory.recall("first").values(["a", "b"], lambda new: map(len, new))
    assert memory.recall("first").values(["b", "a"], lambda new: 1 / 0) == [1, 1]
    memory.owned("second")["x"] = 1
    assert memory.recall("first").values(["a"], lambda new: [7]) == [7]


def test_ids_beside_null_stay_whole(spark, library):
    rows = [((1 << 60) + 1, "x" * 300), (None, "y" * 300), ((1 << 60) + 3, "z " * 200), ((1 << 60) + 3, "z " * 200)]
    got = bpe.round_trip(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), word_bpe(), piece_chars=100).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(i), len(library.encode(t, add_special_tokens=False).ids)) for i, t in rows)


def test_round_trip(spark, library):
    texts = [None, "", "   \n", "One two.", "One two.", "x" * 500, "word " * 300, "日本語" * 90, "mid<|endoftext|>dle " * 40]
    docs = spark.createDataFrame([(i if i != 3 else None, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(3)
    docs = docs.union(docs.where("doc_id = 5"))
    got = bpe.round_trip(docs, word_bpe(), piece_chars=100).collect()

    def wanted(i, text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        return (i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())

    expected = [wanted(i if i != 3 else None, t) for i, t in enumerate(texts)] + [wanted(5, texts[5])]
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    assert bpe.round_trip(docs.limit(0), word_bpe()).count() == 0
    apart = bpe.decode(bpe.encode(docs, word_bpe(), piece_chars=100), word_bpe()).collect()
    assert sorted(hashlib.sha256(r.decoded.encode()).hexdigest() for r in apart) == sorted(e[3] for e in expected)


def test_other_tokenizers_get_whole_texts(spark):
    import public_tokenizers

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    other, text = Tokenizer.from_file(path), "Two  spaces, a\tline\n\nand an end "
    assert not bpe.Encoder(path).by_word
    ids = bpe.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), path).first()["ids"]
    assert np.frombuffer(ids, "<u4").tolist() == other.encode(text, add_special_tokens=False).ids


def test_new_words_of_known_parts_need_no_library(library, monkeypatch):
    """Capitals, digits and marks make a new word, not new parts; what is not plain ASCII goes to the library whole."""
    encoder, asked = bpe.Encoder(word_bpe()), []
    encoder.encode(pa.array(["station's well 1 2 3 . ( !! 've ''"]))
    whole, parts = encoder.new_ids, encoder.part_ids
    monkeypatch.setattr(encoder, "new_ids", lambda words: asked.extend(words) or whole(words))
    monkeypatch.setattr(encoder, "part_ids", lambda words: asked.extend(words) or parts(words))
    text = "Station. (WELL STATION'S 3321 well've!! ''sTATION(1"
    assert np.frombuffer(encoder.encode(pa.array([text]))[0].as_py(), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert asked == []
    text += " café well<|endoftext|>! new"
    assert np.frombuffer(encoder.encode(pa.array([text]))[0].as_py(), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert asked == ["café", "well<|endoftext|>!", "new"]
