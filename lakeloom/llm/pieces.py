"""SentencePiece encoding and decoding by weighted finite-state transducers.

Three transducers are compiled from a model file:

* N, the normaliser: a trie over the characters of the model's rules (its charsmap) whose leaf arcs
  emit the replacement, the longest match being taken, and an arc from each other character to
  itself; a space becomes U+2581, a first arc emits the dummy prefix, and where the model asks for
  it states after a space drop further ones. User-defined symbols (of merge models) pass as they are;
* L, the lexicon: a trie over the pieces' characters whose leaf arcs emit an id, with byte
  fallback arcs for a character that no piece covers;
* B, a bigram acceptor over ids (merge models only): the arc from piece a to piece b has weight 0
  if merging the characters of ab ends in exactly a, b, and infinite weight otherwise.

An input is composed with N o L (o B) lazily, and the result is the tropical-semiring shortest
path. N is deterministic, so an input has one path through it, and composing that path's output
with L is composing the input with N o L. In a unigram model the weights are negated scores and B is absent, so the path is the most
likely segmentation. In a merge (BPE) model the path through B is the merge result itself: the
order in which a piece's own characters merge does not depend on its neighbours as long as no
merge crosses its ends, and whether one crosses depends on the two adjacent pieces only. So the
merge result is the one path of finite weight. For the same reason every prefix of the input has
exactly one such path, and one last piece for each position is all the state that is needed.

Where no piece crosses a boundary (before a space after a non-space, and around characters that
occur in no longer piece), the shortest path of the whole is the concatenation of the paths of
the parts; paths of parts are kept in a bounded table in each worker.

Defined results: a null text gives null ids, an empty one none; decoding gives the normalised
text, under the identity normaliser the text with U+2581 as a space; ids out of range are an error; repeated rows give
equal ids.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lakeloom.llm.common import apart, in_worker, keeps, small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
KEPT = 350_000  # paths of parts of each of two generations that a worker keeps


class Paths(dict):
    """Paths of parts as bytes of 32-bit ids; when the table is full, only what is used again outlives the next."""

    def __init__(self, shortest_path):
        self.shortest_path, self.older = shortest_path, {}

    def __missing__(self, part: str) -> bytes:
        path = self.older.get(part)
        if path is None:
            ids = self.shortest_path(part.replace(" ", SPACE))
            path = struct.pack(f"<{len(ids)}i", *ids)
            if len(part) > 64:
                return path
        if len(self) >= KEPT:
            self.older = dict(self)
            self.clear()
        self[part] = path
        return path


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol-buffer message: number, and the integer or the bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at : at + size]
        at += size


class Normaliser:
    """N, compiled from a model's charsmap: a double-array trie of keys, and their replacements."""

    def __init__(self, charsmap: bytes = b"", prefix: bool = True, collapse: bool = False):
        self.prefix, self.collapse = prefix, collapse
        self.arcs: dict[str, list] = {}  # by character: what is emitted if the match ends here, and the next state
        for source, target in self._rules(charsmap):
            state = self.arcs
            for c in source:
                leaf = state.setdefault(c, [None, {}])
                state = leaf[1]
            leaf[0] = target
        self.starts = re.compile("[" + "".join(map(re.escape, self.arcs)) + "]").search if self.arcs else None

    @staticmethod
    def _rules(charsmap: bytes) -> Iterator[tuple[str, str]]:
        """Keys and replacements, level by level of the double array."""
        if not charsmap:
            return
        size = struct.unpack_from("<I", charsmap)[0]
        units, targets = np.frombuffer(charsmap, dtype="<u4", count=size // 4, offset=4).astype(np.int64), charsmap[4 + size :]

        def offset(u: np.ndarray) -> np.ndarray:
            return (u >> 10) << ((u & 512) >> 6)

        labels = np.arange(1, 256)
        state, keys = offset(units[:1]), [b""]
        while len(keys):
            at = state[:, None] ^ labels
            found = (at < len(units)) & ((units[np.minimum(at, len(units) - 1)] & 0x800000FF) == labels)
            row, label = np.nonzero(found)
            u = units[at[row, label]]
            state = at[row, label] ^ offset(u)
            keys = [keys[r] + bytes([c + 1]) for r, c in zip(row.tolist(), label.tolist(), strict=True)]
            for k in np.flatnonzero(u >> 8 & 1).tolist():
                begin = int(units[state[k]] & 0x7FFFFFFF)
                yield keys[k].decode(), targets[begin : targets.index(b"\0", begin)].decode()

    def __call__(self, text: str) -> str:
        """The output of the text's path, with spaces not yet marked and without the dummy prefix."""
        if self.starts and (m := self.starts(text)):
            out, at = [], 0
            while m:
                i = m.start()
                out.append(text[at:i])
                state, j, emitted, at = self.arcs, i, text[i], i + 1
                while j < len(text) and (leaf := state.get(text[j])):
                    j += 1
                    if leaf[0] is not None:
                        emitted, at = leaf[0], j
                    state = leaf[1]
                out.append(emitted)
                m = self.starts(text, at)
            text = "".join([*out, text[at:]])
        return text

    def spaced(self, text: str) -> str:
        """Spaces as the model wants them, with the dummy prefix; U+2581 as a space."""
        if self.collapse:
            text = re.sub(" +", " ", text.lstrip(" "))
        if not text:
            return ""
        text = f" {text}" if self.prefix else text
        return (text.rstrip(f" {SPACE}") if self.collapse else text).replace(SPACE, " ")


class Transducer:
    """The compiled composition of one model; made once in each worker."""

    def __init__(self, model: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.fallback, self.prefix, collapse, charsmap, marked = UNIGRAM, False, True, True, b"", True
        for number, value in _fields(model):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append((f.get(1, b"").decode(), struct.unpack("<f", f.get(2, b"\0\0\0\0"))[0], f.get(3, NORMAL)))
            elif number == 2:
                f = dict(_fields(value))
                self.kind, self.fallback = f.get(3, UNIGRAM), bool(f.get(35, 0))
            elif number == 3:
                f = dict(_fields(value))
                charsmap, self.prefix, collapse, marked = f.get(2, b""), bool(f.get(3, 1)), bool(f.get(4, 1)), bool(f.get(5, 1))
        symbols = {p[0]: i for i, p in enumerate(self.pieces) if p[2] == USER}
        if not marked or self.kind not in (UNIGRAM, BPE) or (symbols and self.kind == UNIGRAM):
            raise ValueError("only unigram models without user-defined symbols and merge models, with spaces marked, are supported")
        self.normaliser = Normaliser(charsmap, self.prefix, collapse)
        self.symbols = {x.replace(SPACE, " "): struct.pack("<i", i) for x, i in symbols.items()}
        some = "|".join(map(re.escape, sorted(self.symbols, key=len, reverse=True)))
        self.at_symbols = re.compile(f"({some})").split if some else None
        self.unknown = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)
        self.bytes_at = {int(p[0][3:5], 16): i for i, p in enumerate(self.pieces) if p[2] == BYTE}
        self.fallback &= len(self.bytes_at) == 256
        self.ids = {p[0]: i for i, p in enumerate(self.pieces) if p[2] == NORMAL}
        self.score = {p[0]: p[1] for p in self.pieces if p[2] == NORMAL}
        self.surface = [self._surface(*p) for p in self.pieces]
        longer = [p for p in self.ids if len(p) > 1]
        inner = {c for p in longer for c in p}
        if not inner <= self.ids.keys():
            raise ValueError("a character of a longer piece is no piece itself")
        # A run of uncovered characters is one unknown piece where there is no byte fallback, so it isn't cut.
        alone = [chr(c) for c in range(128) if chr(c) not in inner and c != 32 and (self.fallback or chr(c) in self.ids)]
        self.crosses = any(SPACE in p.lstrip(SPACE) for p in longer)
        cut = "".join(map(re.escape, alone))
        self.parts = re.compile(f"[{cut}]| *[^ {cut}]+| +" if cut else " *[^ ]+| +").findall if not self.crosses else (lambda t: [t] if t else [])
        self._spines: dict[int, tuple[list[str], list[str]]] = {}
        self.trie: dict[str, list] = {}  # by character: the id that ends here, and the next node
        for piece, i in self.ids.items():
            if self.kind == BPE and not self._reachable(piece, i):
                continue
            node = self.trie
            for c in piece:
                leaf = node.setdefault(c, [None, {}])
                node = leaf[1]
            leaf[0] = i
        self.allowed: dict[int, bool] = {}
        self.paths = Paths(self.shortest_path)
        lowest = min(self.score.values(), default=0.0)
        self.unknown_weight = 10.0 - lowest

    def _surface(self, piece: str, _: float, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        return {CONTROL: "", UNKNOWN: " ⁇ "}.get(kind, piece.replace(SPACE, " ")).encode()

    def _merge(self, symbols: list[str]) -> Iterator[tuple[str, str]]:
        """Merges in place: always the pair whose piece has the best score, the leftmost of equals."""
        score = self.score
        while True:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = score.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return
            yield symbols[at], symbols[at + 1]
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def _reachable(self, piece: str, i: int) -> bool:
        """Whether merging a piece's characters gives the piece; notes what stands at its ends meanwhile."""
        symbols = list(piece)
        left, right = [symbols[0]], [symbols[-1]]
        for _ in self._merge(symbols):
            left.append(symbols[0])
            right.append(symbols[-1])
        left.append(symbols[0])
        right.append(symbols[-1])
        self._spines[i] = (list(dict.fromkeys(left)), list(dict.fromkeys(right)))
        return len(symbols) == 1

    def _bigram(self, a: int, b: int) -> bool:
        """Whether the arc from a to b has weight 0."""
        ids = self.ids
        left, right = self._spines[b][0], self._spines[a][1]
        if not any(x + y in ids for x in right for y in left):
            return True
        symbols = list(self.pieces[a][0] + self.pieces[b][0])
        for _ in self._merge(symbols):
            pass
        return symbols == [self.pieces[a][0], self.pieces[b][0]]

    def _uncovered(self, c: str) -> list[int]:
        return [self.bytes_at[x] for x in c.encode()] if self.fallback else [self.unknown]

    def _bpe_path(self, s: str) -> list[int]:
        n, size, allowed, trie, never = len(s), len(self.pieces), self.allowed, self.trie, float("inf")
        cost, last, back = [never] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        cost[0] = 0.0
        for i in range(n):
            a = last[i]  # some piece, or -1 after an uncovered character: each prefix has a path
            node, j = trie, i
            first = a * size
            while j < n:
                leaf = node.get(s[j])
                if leaf is None:
                    break
                j += 1
                b, node = leaf
                if b is None or cost[j] == 0.0:  # no path weighs less than 0
                    continue
                if a >= 0:
                    ok = allowed.get(first + b)
                    if ok is None:
                        if len(allowed) > 1_500_000:
                            allowed.clear()
                        ok = allowed[first + b] = self._bigram(a, b)
                    if not ok:  # the arc's weight is infinite
                        continue
                cost[j], last[j], back[j] = cost[i], b, i
            if cost[i + 1] and s[i] not in trie:  # byte fallback: nothing merges with it
                cost[i + 1], last[i + 1], back[i + 1] = cost[i], -1, i
        out: list[int] = []
        at = n
        while at:
            i = back[at]
            out += [last[at]] if last[at] >= 0 else self._uncovered(s[i])[::-1]
            at = i
        return out[::-1]

    def _unigram_path(self, s: str) -> list[int]:
        n, trie, pieces = len(s), self.trie, self.pieces
        cost, last, back = [float("inf")] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        cost[0] = 0.0
        for i in range(n):
            here, node, j, single = cost[i], trie, i, False
            while j < n:
                leaf = node.get(s[j])
                if leaf is None:
                    break
                j += 1
                b, node = leaf
                if b is not None:
                    single |= j == i + 1
                    if here - pieces[b][1] < cost[j]:
                        cost[j], last[j], back[j] = here - pieces[b][1], b, i
            if not single and here + self.unknown_weight < cost[i + 1]:
                cost[i + 1], last[i + 1], back[i + 1] = here + self.unknown_weight, -1, i
        out: list[int] = []
        at = n
        while at:
            i = back[at]
            if last[at] < 0 and not self.fallback and out and out[-1] == self.unknown:
                pass  # a run of uncovered characters is one unknown piece
            else:
                out += [last[at]] if last[at] >= 0 else self._uncovered(s[i])[::-1]
            at = i
        return out[::-1]

    def shortest_path(self, s: str) -> list[int]:
        """Ids of one part, normalised."""
        return self._bpe_path(s) if self.kind == BPE else self._unigram_path(s)

    def encode_bytes(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit integers."""
        if self.at_symbols is None:
            text = self.normaliser.spaced(self.normaliser(text))
            return b"".join(map(self.paths.__getitem__, self.parts(text)))
        # Symbols pass the normaliser and nothing merges with them; what is between them has paths of its own.
        text = self.normaliser.spaced("".join([x if k % 2 else self.normaliser(x) for k, x in enumerate(self.at_symbols(text))]))
        return b"".join([self.symbols[x] if k % 2 else b"".join(map(self.paths.__getitem__, self.parts(x))) for k, x in enumerate(self.at_symbols(text))])

    def normal(self, text: str) -> str:
        """What decoding gives back if no character is unknown."""
        out = self.normaliser.spaced("".join([x if k % 2 else self.normaliser(x) for k, x in enumerate(self.at_symbols(text) if self.at_symbols else [text])]))
        return out[1:] if self.prefix else out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), dtype="<i4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The inverse: the surface of each id, without the dummy prefix; bytes that are no UTF-8 become U+FFFD."""
        if ids and (min(ids) < 0 or max(ids) >= len(self.surface)):
            raise ValueError("an id out of range")
        surface = list(map(self.surface.__getitem__, ids))
        if self.prefix or self.normaliser.collapse:
            for k in range(len(surface)):  # a space before the text; where spaces collapse, of each piece before it
                unmarked = self.pieces[ids[k]][2] in (CONTROL, UNKNOWN)
                space = not unmarked and surface[k].startswith(b" ")
                surface[k] = surface[k][space:]
                if surface[k] or (space and not self.normaliser.collapse):
                    break
        return b"".join(surface).decode("utf-8", errors="replace")


_compiled: dict[str, Transducer] = {}
keeps("pieces", _compiled.clear)


def transducer(model: str = MODEL) -> Transducer:
    """The model at a path that every machine has, compiled once in each worker."""
    in_worker("pieces")
    if model not in _compiled:
        with open(model, "rb") as f:
            _compiled[model] = Transducer(f.read())
    return _compiled[model]


def encode(df: DataFrame, column: str = "text", keep: tuple[str, ...] = ("doc_id",), model: str = MODEL) -> DataFrame:
    """keep columns (see ``apart``), n_pieces long and ids array<int>."""
    kinds = [f"k{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model)
        for b in batches:
            coded = [None if x is None else t.encode_bytes(x) for x in b.column(0).to_pylist()]
            sizes = [0 if c is None else len(c) // 4 for c in coded]
            values = pa.array(np.frombuffer(b"".join(c or b"" for c in coded), dtype="<i4"), pa.int32())
            begin = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(begin), values, mask=pa.array([c is None for c in coded]))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([None if c is None else n for c, n in zip(coded, sizes, strict=True)], pa.int64()), ids], names=[*(f"k{i}" for i in range(len(keep))), "n_pieces", "ids"])

    small_batches(df.sparkSession)
    out = df.select(df[column].cast("string").alias("t"), *(df[c].alias(f"k{i}") for i, c in enumerate(keep)))
    out = out.mapInArrow(run, ", ".join([*kinds, "n_pieces long, ids array<int>"]))
    return out.withColumnsRenamed({f"k{i}": c for i, c in enumerate(apart(keep, ("n_pieces", "ids")))})


def decode(df: DataFrame, column: str = "ids", keep: tuple[str, ...] = ("doc_id",), model: str = MODEL) -> DataFrame:
    """keep columns (see ``apart``) and text string."""
    kinds = [f"k{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model)
        for b in batches:
            texts = [None if x is None else t.decode(x) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(texts, pa.string())], names=[*(f"k{i}" for i in range(len(keep))), "text"])

    small_batches(df.sparkSession)
    out = df.select(df[column].alias("x"), *(df[c].alias(f"k{i}") for i, c in enumerate(keep)))
    out = out.mapInArrow(run, ", ".join([*kinds, "text string"]))
    return out.withColumnsRenamed({f"k{i}": c for i, c in enumerate(apart(keep, ("text",)))})


def digests(df: DataFrame, key: str = "doc_id", column: str = "text", model: str = MODEL) -> DataFrame:
    """Each text encoded and decoded again: key, n_pieces, n_fallback (bytes), ids_sha256, round_trip (decoding gives the normalised text)."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model)
        is_byte = np.array([p[2] == BYTE for p in t.pieces])
        for b in batches:
            sizes, bytes_used, hashes, same = [], [], [], []
            for text in b.column(1).to_pylist():
                text = text or ""
                coded = t.encode_bytes(text)
                ids = np.frombuffer(coded, dtype="<i4")
                sizes.append(len(ids))
                bytes_used.append(int(is_byte[ids].sum()))
                hashes.append(hashlib.sha256(coded).hexdigest())
                same.append(t.decode(ids.tolist()) == t.normal(text))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(bytes_used, pa.int64()), pa.array(hashes, pa.string()), pa.array(same, pa.bool_())], names=["k", "n_pieces", "n_fallback", "ids_sha256", "round_trip"])

    small_batches(df.sparkSession)
    out = df.select(df[key].alias("k"), df[column].cast("string").alias("t")).mapInArrow(run, f"k {kind}, n_pieces long, n_fallback long, ids_sha256 string, round_trip boolean")
    return out.withColumnRenamed("k", key)
