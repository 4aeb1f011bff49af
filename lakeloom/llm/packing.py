"""Hierarchical packing of documents into context windows of several lengths.

A document's remainder after its full windows of the longest tier is routed to the shortest tier that
holds it. Windows of long tiers are opened first, and their gaps are filled from shorter tiers, the best
fit first; where nothing fits, the longest part that is left is cut to the gap. So every window is full,
and what remains at the end of a task is cut at powers of two. Windows are then dealt into step groups
of equal numbers of tokens and near-equal sums of squared lengths of parts (the cost of attention within
documents).

A task packs the documents of its own input split and holds a bounded pool of parts, so nothing is
shuffled and a lost task is simply run again. Ids are looked up part by part of
each word: the vocabulary splits texts before it merges, so a text's ids are those of its parts in order.

Defined results: a null text is an empty one, which has the end id alone; rows of equal or null ids are
packed apart (``row`` tells them apart); an empty table gives no pieces; a text of any length is cut into
as many pieces as it needs; kept columns whose names clash with added ones get ``input_`` in front.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import apart, chunks, in_worker, joined, keeps, small_batches, text_column, utf8

TIERS = (256, 512, 1024, 2048)
END = 1
#: Tokens of parts that a task holds before it packs.
POOL = 1 << 20
#: Windows of the longest tier in a step group, and step groups that are balanced against each other.
STEP, GROUPS = 32, 16
#: Parts of words, and their bytes, whose ids a worker keeps.
KEPT_PARTS, KEPT_BYTES = 1 << 20, 1 << 25
SLICE = 4_000_000

ADDED = ("start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sequence_length", "step_group", "row")
_SCHEMA = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_length long, step_group long, row long"
_WHITE = re.compile(rb"[\x20\x09-\x0D]")
_words: dict[str, Words] = {}
keeps("packing", _words.clear)


# How the public vocabulary of whole words normalises a text and splits it before merging.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: A word of these characters, of which the normaliser changes the case only, is split here; others go through the whole tokenizer.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_PARTS = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
# Of bytes: 0 white space, 1 letter (and what follows the first byte of one), 2 digit, 3 other.
_KIND = np.full(256, 3, dtype=np.int8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_KIND[0x30:0x3A] = 2
# Bytes whose words are looked up unsplit: apostrophes, what special tokens begin with, control and all but most Latin-1 letters.
_ODD = np.zeros(256, dtype=bool)
_ODD[[*range(9), *range(14, 32), 0x27, 0x3C, 0x7F, 0xC0, 0xC1, 0xC2, *range(0xC4, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def parts_of(buf: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The parts, in lower case, into which the vocabulary splits texts, and where each begins; odd words as they are."""
    kind = _KIND[buf]
    solid = kind > 0
    before = np.concatenate([[np.int8(0)], kind[:-1]])
    word = solid & (before == 0)
    begin = solid & ((kind != before) | (kind == 2))
    low = _LOWER[buf]
    odd = _ODD[buf]
    if len(second := np.flatnonzero(buf[:-1] == 0xC3) + 1):
        letter = buf[second]
        odd[second[(letter == 0x97) | (letter == 0xB7)]] = True  # the signs of multiplication and division
        low[second[letter < 0x9F]] += 32
    if len(at := np.flatnonzero(odd)):
        number = np.cumsum(word)
        strange = np.zeros(int(number[-1]) + 1, dtype=bool)
        strange[number[at]] = True
        strange = strange[number] & solid
        begin = np.where(strange, word, begin)
        low = np.where(strange, buf, low)
    first = np.flatnonzero(begin)
    data = low[solid]
    offsets = np.empty(len(first) + 1, dtype=np.int32)
    offsets[:-1] = np.cumsum(solid)[first] - 1
    offsets[-1] = len(data)
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data)]), first


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the others in order from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class Words:
    """Ids of texts by a tokenizer. One that splits texts as NORMALIZER and PATTERN say, so never across white space,
    looks each part of a word up once; with another, every text goes through the tokenizer as a whole."""

    def __init__(self, path: str, end: int = END) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(path), end
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        splits = (config["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        own = (config["normalizer"] or {}).get("normalizers") == NORMALIZER and splits[0].get("pattern") == {"Regex": PATTERN} and config["post_processor"] is None
        self.by_part = own and all(t["content"][:2] == "<|" and not re.search(r"\s", t["content"]) for t in config["added_tokens"])
        letters = _byte_letters()
        self.letters = {i: letters[i] if i < 0x80 else "".join(letters[b] for b in chr(i).encode()) for i in range(0x21, 0x100)}
        self.forget()

    def forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.bytes = 0
        self.flat = np.array([self.end], dtype=np.uint32)  # entry 0 is the end of a document
        self.start, self.size = np.zeros(1, dtype=np.int64), np.ones(1, dtype=np.int64)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, parts: list[bytes]) -> None:
        """Ids of parts and odd words: by the tokenizer's own model, or as a whole."""
        found: list[list[int]] = []
        other = []
        model = self.tokenizer.model.tokenize
        for i, w in enumerate(parts):
            text = w.decode("utf-8", "replace")
            if _PLAIN.fullmatch(text) and "<|" not in text:
                split = _PARTS.findall(text.lower()) if "'" in text or "<" in text else (text,)
                found.append([t.id for p in split for t in model(p.translate(self.letters))])
            else:
                other.append(i)
                found.append([])
        for i, ids in zip(other, self.whole([parts[i].decode("utf-8", "replace") for i in other]), strict=True):
            found[i] = ids
        sizes = np.array([len(x) for x in found], dtype=np.int64)
        self.index.update(zip(parts, range(len(self.size), len(self.size) + len(parts)), strict=True))
        self.bytes += sum(map(len, parts))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(found), dtype=np.uint32, count=int(sizes.sum()))])

    def encode(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """Ids of each text, with the end id."""
        if len(self.index) > KEPT_PARTS or self.bytes > KEPT_BYTES:
            self.forget()
        buf, ends = joined(texts)
        parts, first = parts_of(buf)
        coded = parts.dictionary_encode()
        known = coded.dictionary.to_pylist()
        if missing := [w for w in known if w not in self.index]:
            self.learn(missing)
        at = np.array([self.index[w] for w in known], dtype=np.int64)[coded.indices.to_numpy()]
        last = np.searchsorted(first, ends[1:])
        at = np.insert(at, last, 0)
        sizes = self.size[at]
        to = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.start[at] - (to - sizes), sizes) + np.arange(to[-1])]
        begin = 0
        for end in to[last + np.arange(len(texts))].tolist():
            yield ids[begin:end]
            begin = end

    def documents(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """The ids of each text, with the end id."""
        if not self.by_part:
            for t in texts:
                yield np.array([*self.whole([t.decode("utf-8", "replace")])[0], self.end], dtype=np.uint32)
            return
        for a, b in chunks(texts, SLICE):
            if len(texts[a]) > SLICE:
                parts = [next(self.encode([part]))[:-1] for part in _slices(texts[a])]
                yield np.concatenate([*parts, np.array([self.end], dtype=np.uint32)])
            else:
                yield from self.encode(texts[a:b])


def _slices(text: bytes) -> Iterator[bytes]:
    """A long text, some megabytes at a time, cut at white space."""
    at = 0
    while at < len(text):
        space = _WHITE.search(text, at + SLICE)
        stop = space.start() if space else len(text)
        yield text[at:stop]
        at = stop


def words(path: str, end: int = END) -> Words:
    in_worker("packing")
    key = f"{path} {end}"
    if key not in _words:
        _words[key] = Words(path, end)
    return _words[key]


class Pool:
    """Parts of documents that no window has yet, by length."""

    def __init__(self, most: int) -> None:
        self.parts: list[list[tuple]] = [[] for _ in range(most + 1)]
        self.lengths = self.tokens = 0  # lengths: bit n is set if there is a part of n tokens

    def put(self, part: tuple, length: int) -> None:
        """part: (document, first token of the part)."""
        self.parts[length].append(part)
        self.lengths |= 1 << length
        self.tokens += length

    def longest(self, most: int | None = None) -> int:
        """The greatest length of a part, or of one of at most so many tokens; 0 if there is none."""
        found = self.lengths if most is None else self.lengths & ((2 << most) - 1)
        return max(found.bit_length() - 1, 0)

    def take(self, length: int) -> tuple:
        part = self.parts[length].pop()
        if not self.parts[length]:
            self.lengths ^= 1 << length
        self.tokens -= length
        return part

    def window(self, tiers: Sequence[int]) -> list[tuple[tuple, int]]:
        """The parts, with their lengths, of the next window: of the tier of the longest part, filled from shorter
        parts. Only the last window of all may be less than full."""
        length = self.longest()
        room = next(t for t in tiers if t >= length)
        out = []
        while room and self.lengths:
            if fits := self.longest(room):
                out.append((self.take(fits), fits))
            else:
                fits, whole = room, self.longest()
                document, at = self.take(whole)
                out.append(((document, at), fits))
                self.put((document, at + fits), whole - fits)
            room -= fits
        return out


def at_powers(parts: list[tuple[tuple, int]]) -> Iterator[list[tuple[tuple, int]]]:
    """Windows whose lengths are powers of two, the longest first, from parts laid end to end."""
    total = sum(n for _, n in parts)
    left = parts[::-1]
    while total:
        room = 1 << total.bit_length() - 1
        total -= room
        out = []
        while room:
            (document, at), n = left.pop()
            if n > room:
                left.append(((document, at + room), n - room))
                n = room
            out.append(((document, at), n))
            room -= n
        yield out


def slots(windows: list[list[tuple[tuple, int]]], longest: int) -> list[list[list[tuple[tuple, int]]]]:
    """Windows put together to slots of the longest length; only the last slot may be less than full."""
    out: list[list] = []
    room = 0
    for w in sorted(windows, key=lambda w: -sum(n for _, n in w)):  # powers of two in falling order fill slots exactly
        size = sum(n for _, n in w)
        if size > room:
            out.append([])
            room = longest
        out[-1].append(w)
        room -= size
    return out


def balanced(dealt: list[list[list[tuple[tuple, int]]]], groups: int) -> list[list[list[tuple[tuple, int]]]]:
    """Slots dealt by falling cost to the groups, forth and back: the windows of each group."""
    out: list[list] = [[] for _ in range(groups)]
    for i, slot in enumerate(sorted(dealt, key=lambda slot: -sum(n * n for w in slot for _, n in w))):
        turn, place = divmod(i, groups)
        out[place if turn % 2 == 0 else groups - 1 - place] += slot
    return out


def packed(documents: Iterator[tuple[tuple, np.ndarray]], tiers: Sequence[int] = TIERS, pool_tokens: int = POOL, step: int = STEP, groups: int = GROUPS) -> Iterator[tuple]:
    """(document, first token, ids, tokens of the document, sequence, offset, length of the sequence, step group) of
    each piece of a stream of (document, ids)."""
    most = tiers[-1]
    pool, ready, ready_tokens, sequence, group = Pool(most - 1), [], 0, 0, 0

    def emit(n: int) -> Iterator[tuple]:
        """Slots of n groups; what is more waits for the next ones."""
        nonlocal ready, ready_tokens, sequence, group
        every = slots(ready, most)
        ready = [w for slot in every[n * step :] for w in slot]
        ready_tokens = sum(size for w in ready for _, size in w)
        for windows in balanced(every[: n * step], n):
            for w in windows:
                size, offset = sum(length for _, length in w), 0
                for (document, at), length in w:
                    key, ids, skipped, tokens = document
                    yield key, at, ids[at - skipped : at - skipped + length], tokens, sequence, offset, size, group
                    offset += length
                sequence += 1
            group += 1

    for key, ids in documents:
        full = len(ids) // most * most
        document = (key, ids, 0, len(ids))
        for at in range(0, full, most):
            ready.append([((document, at), most)])
            ready_tokens += most
            if ready_tokens >= most * step * groups:
                yield from emit(groups)
        if len(ids) > full:
            pool.put(((key, ids[full:].copy(), full, len(ids)), full), len(ids) - full)  # the full windows' ids can go
        if pool.tokens >= pool_tokens:
            while pool.tokens > max(pool_tokens // 4, most):  # so these windows get full
                ready.append(pool.window(tiers))
                ready_tokens += sum(n for _, n in ready[-1])
                if ready_tokens >= most * step * groups:
                    yield from emit(groups)
    while pool.lengths:
        w = pool.window(tiers)
        size = sum(n for _, n in w)
        ready += [w] if size & (size - 1) == 0 else at_powers(w)
        ready_tokens += size
    if ready:
        yield from emit(max(1, -(-ready_tokens // (most * step))))


def pack(df: DataFrame, column: str = "text", keep: Sequence[str] = ("doc_id",), vocabulary: str | None = None, end: int = END, tiers: Sequence[int] = TIERS, pool_tokens: int = POOL) -> DataFrame:
    """One row for each piece: the kept columns; start and length of the piece in its document's ids; ids (unsigned
    32-bit, little-endian); doc_tokens; sequence_id, offset there and sequence_length; step_group; row, which all
    pieces of one input row share.

    ``tiers`` are rising powers of two. Each sequence's length is one of them, but for at most one of each smaller
    power in a task. Ids of sequences, groups and rows are unique; they depend on how the input is split.
    """
    if not tiers or any(t < 1 or t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers)):
        raise ValueError("tiers must be rising powers of two")
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    small_batches(df.sparkSession, 512)
    names = apart(list(keep), ADDED)
    kinds = [df.schema[c].dataType for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = words(vocabulary, end)
        base = TaskContext.get().partitionId() << 36
        kept_types: list[pa.DataType] = []

        def documents() -> Iterator[tuple[tuple, np.ndarray]]:
            row = 0
            for b in batches:
                kept_types[:] = [c.type for c in b.columns[1:]]
                kept = [c.to_pylist() for c in b.columns[1:]]
                for i, ids in enumerate(encoder.documents(utf8(b.column(0)))):
                    yield (base + row, *(c[i] for c in kept)), ids
                    row += 1

        pieces = packed(documents(), tiers, pool_tokens)
        while some := list(itertools.islice(pieces, 2048)):
            key, at, ids, tokens, sequence, offset, size, group = zip(*some, strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.array([k[j + 1] for k in key], t) for j, t in enumerate(kept_types)),
                    pa.array(at, pa.int64()),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([x.astype("<u4", copy=False).tobytes() for x in ids], pa.binary()),
                    pa.array(tokens, pa.int64()),
                    pa.array([base + s for s in sequence], pa.int64()),
                    pa.array(offset, pa.int64()),
                    pa.array(size, pa.int64()),
                    pa.array([base + g for g in group], pa.int64()),
                    pa.array([k[0] for k in key], pa.int64()),
                ],
                names=[*(f"b{j}" for j in range(len(kinds))), *ADDED],
            )

    inner = df.select(text_column(df, column).alias("t"), *(df[c].alias(f"b{j}") for j, c in enumerate(keep)))
    schema = ", ".join([*(f"b{j} {k.simpleString()}" for j, k in enumerate(kinds)), _SCHEMA])
    return inner.mapInArrow(run, schema).withColumnsRenamed({f"b{j}": n for j, n in enumerate(names)})


def unpacked(pieces: DataFrame) -> DataFrame:
    """row, ids and n_pieces of each document, put together from its pieces."""
    parts = F.array_sort(F.collect_list(F.struct("start", "ids")))
    joined_ids = F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return pieces.groupBy("row").agg(joined_ids.alias("ids"), F.count(F.lit(1)).alias("n_pieces"))


def padding(pieces: DataFrame, longest: int = TIERS[-1]) -> DataFrame:
    """For each length of sequences: n_sequences, n_tokens and n_padding, where sequences are padded to the longest
    tier unless their length is a power of two."""
    sequences = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    power = F.bit_count("n") == 1
    return sequences.groupBy(F.col("n").alias("sequence_length")).agg(F.count(F.lit(1)).alias("n_sequences"), F.sum("n").alias("n_tokens"), F.sum(F.when(power, 0).otherwise(longest - F.col("n"))).cast("long").alias("n_padding"))
