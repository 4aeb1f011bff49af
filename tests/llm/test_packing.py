import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lakeloom.llm import packing
from lakeloom.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)
WORDS = packing.Words(PATH)


def ids_of(text):
    return [*WHOLE.encode(text or "", add_special_tokens=False).ids, 1]


ODD = ["", "  ", "A b\tC", "it's O'S l'Été d'S RE'VEx", "LÉÀ× ÷ a÷B µm² 3½ 12a3", "<b>x</b> <|endoftext|>y < |", "é ÿŸ ÞÐ ß ẞ İ ﬁ", "日本語 ▁ 😀", "a b\u0085c d", "\x00 \x1c\x7f x​y", "Σας ΟΔΟΣ", "ª º ¼ ² ٣", "'s's'll '", "́a b́"]


@pytest.mark.parametrize("text", ODD)
def test_ids_of_odd_texts(text):
    assert [x.tolist() for x in WORDS.documents([text.encode(), b"and", text.encode()])] == [ids_of(text), ids_of("and"), ids_of(text)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("abzEÉéÀß×÷'stvl09.,<|>_- µ²ñ日Ω \n\t́")), max_size=5))
def test_ids_of_any_texts(texts):
    assert [x.tolist() for x in WORDS.documents([t.encode() for t in texts])] == [ids_of(t) for t in texts]


def test_ids_of_long_texts_and_of_a_full_store(monkeypatch):
    monkeypatch.setattr(packing, "SLICE", 100)
    monkeypatch.setattr(packing, "KEPT_PARTS", 5)
    r = random.Random(1)
    texts = [" ".join(f"w{r.randrange(50)}" for _ in range(n)) for n in (200, 3, 0, 80)] + ["x" * 500]
    assert [x.tolist() for x in WORDS.documents([t.encode() for t in texts])] == [ids_of(t) for t in texts]


def test_a_tokenizer_that_splits_otherwise_takes_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    other, whole = packing.Words(path), Tokenizer.from_file(path)
    assert not other.by_part and WORDS.by_part
    assert [x.tolist() for x in other.documents([b"It's one  two", b""])] == [[*whole.encode("It's one  two", add_special_tokens=False).ids, 1], [1]]


def whole_and_gapless(pieces, most=2048):
    """pieces: (document, start, ids, tokens, sequence, offset, size)."""
    of, sequences = defaultdict(list), defaultdict(list)
    for d, at, ids, tokens, sequence, offset, size in pieces:
        of[d].append((at, list(ids), tokens))
        sequences[sequence].append((offset, len(ids), size))
    for parts in sequences.values():
        at = 0
        for offset, n, _ in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert {size for _, _, size in parts} == {at} and at <= most and at & (at - 1) == 0
    out = {}
    for d, parts in of.items():
        at, ids = 0, []
        for start, part, tokens in sorted(parts):
            assert start == at
            at, ids = at + len(part), ids + part
        assert {tokens for _, _, tokens in parts} == {at}
        out[d] = ids
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60), st.sampled_from([(8, 16, 32), (32,), (1, 2, 4, 8, 16, 32), (16, 64)]), st.sampled_from([1, 100, 10_000]))
def test_packed_windows_are_full(lengths, tiers, pool):
    documents = [((i,), np.arange(n, dtype=np.uint32) + 1000 * i) for i, n in enumerate(lengths)]
    found = list(packing.packed(iter(documents), tiers, pool, step=2, groups=3))
    got = whole_and_gapless([(k[0], at, ids.tolist(), t, s, o, size) for k, at, ids, t, s, o, size, _ in found], tiers[-1])
    assert got == {i: (np.arange(n) + 1000 * i).tolist() for i, n in enumerate(lengths)}
    groups = defaultdict(int)
    for _, _, ids, _, _, _, _, group in found:
        groups[group] += len(ids)
    assert all(n <= 2 * tiers[-1] for n in groups.values())
    ending = {s for _, _, _, _, s, _, size, _ in found if size not in tiers}
    assert len(ending) <= tiers[-1].bit_length()  # only what remains at the end


def test_gaps_are_filled_from_shorter_tiers_without_cuts_where_parts_fit():
    lengths = [1500, 548, 1024, 600, 424, 200, 56]
    found = list(packing.packed(iter([((i,), np.zeros(n, dtype=np.uint32)) for i, n in enumerate(lengths)])))
    assert len(found) == len(lengths)  # nothing is cut
    sizes = {s: size for _, _, _, _, s, _, size, _ in found}
    assert sorted(sizes.values()) == [256, 1024, 1024, 2048]


def test_groups_have_equal_tokens_and_like_costs():
    r = random.Random(3)
    found = list(packing.packed(iter([((i,), np.zeros(r.randrange(1, 3000), dtype=np.uint32)) for i in range(4000)]), pool_tokens=1 << 18))
    tokens, costs = defaultdict(int), defaultdict(int)
    for _, _, ids, _, _, _, _, group in found:
        tokens[group] += len(ids)
        costs[group] += len(ids) ** 2
    first = [costs[g] for g in range(packing.GROUPS)]
    assert {tokens[g] for g in range(packing.GROUPS)} == {2048 * packing.STEP}
    assert max(first) < 1.02 * min(first)


def test_query_covers_every_token(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = QUERIES["op11_tier_packing"](spark, small).collect()
    of = defaultdict(int)
    whole = {d: ids_of(t) for d, t in texts.items()}
    sequences = defaultdict(list)
    for r in rows:
        part = whole[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and r.doc_tokens == len(whole[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(part, dtype="<u4").tobytes())
        of[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert of == {d: len(x) for d, x in whole.items()}
    for parts in sequences.values():
        parts.sort()
        assert all(o == sum(n for _, n in parts[:i]) for i, (o, _) in enumerate(parts))
        size = sum(n for _, n in parts)
        assert size <= 2048 and size & (size - 1) == 0


def test_messy(spark, messy, empty):
    pieces = packing.pack(messy, keep=("doc_id", "text", "row" if "row" in messy.columns else "lang")).cache()
    got = defaultdict(list)
    for r in pieces.collect():
        got[r.row].append((r.start, r.ids, r.doc_id))
    found = sorted((str(parts[0][2]), b"".join(x[1] for x in sorted(parts))) for parts in got.values())
    assert found == sorted((str(r.doc_id), np.array(ids_of(r.text), dtype="<u4").tobytes()) for r in messy.collect())
    again = {r.row: bytes(r.ids) for r in packing.unpacked(pieces).collect()}
    assert again == {row: b"".join(x[1] for x in sorted(parts)) for row, parts in got.items()}
    assert sum(r.n_padding for r in packing.padding(pieces).collect()) == 0
    assert packing.pack(empty).count() == 0
    clash = packing.pack(messy.withColumnRenamed("lang", "ids"), keep=("doc_id", "ids"))
    assert clash.columns[:3] == ["doc_id", "input_ids", "start"]


def test_tiers_are_powers_of_two(messy):
    for tiers in [(), (100, 2048), (2048, 256)]:
        with pytest.raises(ValueError):
            packing.pack(messy, tiers=tiers)
