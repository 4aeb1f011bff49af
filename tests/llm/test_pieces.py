import random
import struct

import pytest
import sentencepiece

from lakeloom.llm import pieces
from lakeloom.llm.queries import QUERIES


@pytest.fixture(scope="module")
def transducer():
    return pieces.transducer()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def test_documents_equal_the_library(spark, small, transducer, library):
    for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect():
        assert transducer.encode(r.text) == library.encode(r.text)
        assert transducer.decode(transducer.encode(r.text)) == r.text


def test_random_strings_equal_the_library(transducer, library):
    r = random.Random(8)
    letters = " abcdefghinortus\n\t▁éüß日本語😀ĩ.,!?<>=-_*#ABCﬁ0123 the ing  "
    for _ in range(3000):
        s = "".join(r.choice(letters) for _ in range(r.randrange(40)))
        assert transducer.encode(s) == library.encode(s)
        assert transducer.decode(transducer.encode(s)) == s.replace("▁", " ")


def test_runs_of_one_character_equal_the_library(transducer, library):
    for c in " =-a\n0é😀":
        for n in (1, 2, 3, 7, 16, 17, 33, 100):
            assert transducer.encode(c * n) == library.encode(c * n)


def message(number, value):
    def varint(n):
        out = b""
        while n > 127:
            out += bytes([n & 127 | 128])
            n >>= 7
        return out + bytes([n])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def unigram(vocabulary, normaliser=b""):
    rows = [("<unk>", 0.0, 2), *((p, s, 1) for p, s in vocabulary.items())]
    model = b"".join(message(1, message(1, p.encode()) + message(2, float(s)) + message(3, k)) for p, s, k in rows)
    return model + message(2, message(3, 1)) + message(3, normaliser or message(3, 1) + message(4, 0))


def test_unigram_shortest_path_is_the_likeliest_segmentation():
    vocabulary = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.25, "ba": -4.0, "aba": -5.0, "▁a": -2.75, "abab": -7.5}
    t = pieces.Transducer(unigram(vocabulary))

    def best(s):
        if not s:
            return 0.0
        return max((vocabulary[s[:k]] + best(s[k:]) for k in range(1, len(s) + 1) if s[:k] in vocabulary), default=float("-inf"))

    r = random.Random(4)
    for _ in range(200):
        s = "".join(r.choice("ab ") for _ in range(r.randrange(1, 9)))
        got = t.encode(s)
        assert abs(sum(t.pieces[i][1] for i in got) - best("▁" + s.replace(" ", "▁"))) < 1e-5
        assert t.decode(got) == s


def test_unigram_runs_of_unknown_characters_are_one_piece():
    t = pieces.Transducer(unigram({"▁": -1.0, "a": -1.0}))
    assert [t.pieces[i][0] for i in t.encode("axya")] == ["▁", "a", "<unk>", "a"]


def test_unsupported_models_are_refused():
    with pytest.raises(ValueError):
        pieces.Transducer(unigram({"a": -1.0}, message(3, 1) + message(5, 0)))
    with pytest.raises(ValueError):
        pieces.Transducer(unigram({"a": -1.0}) + message(1, message(1, b"<x>") + message(3, 4)))


@pytest.mark.parametrize("rule", ["identity", "nfkc", "nmt_nfkc", "nmt_nfkc_cf"])
@pytest.mark.parametrize("collapse", [0, 1])
def test_models_with_a_compiled_normaliser_equal_the_library(rule, collapse):
    spec = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec()
    charsmap = dict(pieces._fields(spec)).get(2, b"")
    r = random.Random(6)
    letters = "abfi1AB ▁é日本ｶﾞﬁ①Å"
    vocabulary = {c: -3.0 - 0.01 * k for k, c in enumerate("▁abfi1é")} | {"fi": -4.5, "▁a": -4.0, "ab▁": -6.25, "ガ": -5.0, "fia": -8.125}
    model = unigram(vocabulary, message(1, rule.encode()) + message(2, charsmap) + message(3, 1) + message(4, collapse))
    ours, theirs = pieces.Transducer(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    normal = sentencepiece.SentencePieceNormalizer(model_proto=model)
    odd = letters + "\u3000\t\n\u200b\u0301\xa0ªﬀＡ가ﾊﾟ㌀\u0345½ẞǅ"
    for _ in range(1500):
        s = "".join(r.choice(odd if r.random() < 0.5 else letters) for _ in range(r.randrange(25)))
        assert ours.normaliser.spaced(ours.normaliser(s)).replace(" ", "▁") == normal.normalize(s), s
        assert ours.encode(s) == theirs.encode(s), s
        assert ours.decode(ours.encode(s)) == theirs.decode(theirs.encode(s))


def test_user_defined_symbols_of_a_merge_model_equal_the_library():
    rows = [("<unk>", 0.0, 2), ("<x>", 0.0, 4), ("ab", 0.0, 4), *((p, -float(k), 1) for k, p in enumerate(["aa", "▁a", "ca", "▁", "a", "b", "c", "x", "<", ">"]))]
    model = b"".join(message(1, message(1, p.encode()) + message(2, float(s)) + message(3, k)) for p, s, k in rows)
    model += message(2, message(3, 2)) + message(3, message(3, 1) + message(4, 0))
    ours, theirs = pieces.Transducer(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    r = random.Random(7)
    for _ in range(500):
        s = "".join(r.choice(["a", "b", "c", " ", "<x>", "ab", "<", "x"]) for _ in range(r.randrange(12)))
        assert ours.encode(s) == theirs.encode(s), s
        assert ours.decode(ours.encode(s)) == s


def test_messy_round_trip(messy, empty):
    coded = pieces.encode(messy, keep=("doc_id", "chunk"))
    assert coded.columns == ["doc_id", "chunk", "n_pieces", "ids"]
    texts = {r.doc_id: r.text for r in messy.collect()}
    back = {r.doc_id: r.text for r in pieces.decode(coded).collect()}
    assert back == {i: None if t is None else t.replace("▁", " ") for i, t in texts.items()}
    assert {r.doc_id: r.n_pieces for r in coded.collect()}[3] == 0
    assert pieces.encode(empty).count() == pieces.digests(empty).count() == 0


def test_ids_out_of_range_are_refused(transducer):
    with pytest.raises(ValueError):
        transducer.decode([len(transducer.pieces)])
    with pytest.raises(ValueError):
        transducer.decode([-1])


def test_query(spark, small, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in QUERIES["op3_piece_transducer"](spark, small).collect():
        assert r.round_trip and r.n_pieces == len(library.encode(texts[r.doc_id]))


def test_parts_that_are_kept_stay_bounded(monkeypatch, transducer):
    monkeypatch.setattr(pieces, "KEPT", 10)
    p = pieces.Paths(transducer.shortest_path)
    for k in range(100):
        p[f" w{k % 25}"]
    assert len(p) <= 10 and len(p.older) <= 10
