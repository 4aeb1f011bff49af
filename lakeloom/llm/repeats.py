"""Removal of repeated passages: every word of a window of k words that a document with a smaller id has.

Super-k-mer partitioning. A window's minimiser is the least hash of the m-word runs in it;
consecutive windows of a document with one minimiser form a super-k-mer. Three exchanges between
chunks of documents and buckets of keys:

1. each chunk sends its minimisers with the least and greatest document that has them; a bucket
   answers with those that more than one document has. Windows of the others occur once, as equal
   windows have equal minimisers, so they stay at home;
2. super-k-mers of shared minimisers travel as packed strings, each distinct one once for each
   chunk, to the bucket of their minimiser, which sorts all windows and answers, for ranges of
   windows, with the first document that has them. A minimiser of very many documents would make
   its bucket large: its windows travel one by one, to buckets of their own hashes;
3. each chunk marks the words of windows that an earlier document has.

Windows are compared by two independent 64-bit hashes of their words, super-k-mers by a 128-bit hash
of their bytes.

Defined results: a null text has no words; texts shorter than a window stay whole; rows that
share an id are one document (neither is smaller); a null id is greater than every other; an
empty table gives no rows. Only the key and the text of the input are read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from lakeloom.llm import packed as px
from lakeloom.llm.common import chunks, joined, mix, spans, window_hashes, word_hashes

WINDOW, RUN = 50, 8
#: Documents with a minimiser from which its windows travel one by one.
HOT = 512
PART = 1_500_000  # bytes of text that are hashed at a time
#: What chunks and buckets send each other: minimisers, the shared ones, super-k-mers and windows, who has them first.
MINIMISERS = (px.Kind((np.uint64, np.int64, np.int64, np.uint32)),)
SHARED = (px.Kind((np.uint64, bool)),)
TRAVEL = (px.Kind((np.uint64, np.uint64, np.int64, np.int64), True), px.Kind((np.uint64, np.uint64, np.int64, np.int64)))
EARLIEST = (px.Kind((np.uint64, np.uint64, np.uint32, np.uint32, np.int64)), px.Kind((np.uint64, np.uint64, np.int64)))


@dataclass
class Windows:
    """Words and super-k-mers of some texts; places are word numbers over all of them."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    h: np.ndarray
    doc: np.ndarray  # text of each word
    at: np.ndarray  # first window of each super-k-mer
    n: np.ndarray  # its windows
    key: np.ndarray  # its minimiser, as a uniform key
    valid: np.ndarray  # whether a window starts at each word

    def strings(self, k: int, pick: np.ndarray) -> list[bytes]:
        """The bytes of the picked super-k-mers, as they stand in their text."""
        raw = self.buf.tobytes()
        begin, end = self.start[self.at[pick]], self.end[self.at[pick] + self.n[pick] + k - 2]
        return [raw[i:j] for i, j in zip(begin.tolist(), end.tolist(), strict=True)]


def fingerprints(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit hash of each string, as two arrays."""
    both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x) for x in strings]), dtype="<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def windows(texts: list[bytes], k: int, m: int, seed: int = 1) -> Windows:
    buf, begins = joined(texts)
    start, end = spans(buf)
    h = word_hashes(buf, start, end, seed)
    doc = np.searchsorted(begins, start, side="right") - 1
    n = len(h)
    none = np.zeros(0, dtype=np.int64)
    if n < k:
        return Windows(buf, start, end, h, doc, none, none, none.astype(np.uint64), np.zeros(n, dtype=bool))
    least = window_hashes(h, m)
    width, have = k - m + 1, 1
    while 2 * have <= width:  # minimum of ever longer runs
        least = np.minimum(least[: len(least) - have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    valid = doc[: n - k + 1] == doc[k - 1 :]
    new = np.ones(len(valid), dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | ~valid[:-1]
    at = np.flatnonzero(valid & new)
    ends = np.flatnonzero(valid & np.append(new[1:] | ~valid[1:], True))
    return Windows(buf, start, end, h, doc, at, ends - at + 1, mix(least[at] ^ np.uint64(0x5851F42D4C957F2D)), valid)


def _least_and_greatest(order: np.ndarray, new: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    begin = np.flatnonzero(new)
    return begin, np.minimum.reduceat(low[order], begin), np.maximum.reduceat(high[order], begin)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the row before."""
    out = np.zeros(len(columns[0]), dtype=bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _first_of(low: np.ndarray, *by: np.ndarray) -> np.ndarray:
    """For each entry the least ``low`` of the entries that are equal to it in ``by``."""
    order = np.lexsort(by[::-1])
    new = _changes(*(x[order] for x in by))
    out = np.empty(len(low), dtype=np.int64)
    out[order] = np.minimum.reduceat(low[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    return out


def repeats(df: DataFrame, key: str = "doc_id", column: str = "text", k: int = WINDOW, m: int = RUN, hot: int = HOT, chunk_bytes: int = px.CHUNK_BYTES, direct: int = px.DIRECT, texts: bool = False) -> DataFrame:
    """One row for each row of the input: key long, n_words, n_removed, kept_sha256, and kept (the text) if asked for."""
    n = px.number_of_chunks(px.stored_size(df, column), chunk_bytes)
    docs = px.chunked(df, n, key, column)
    exchange = px.Exchange(n, direct)

    def minimisers(table: pa.Table) -> list[px.Part]:
        _, ids, all_texts = px.of_chunk(table)
        keys, owners = [], []
        for a, b in chunks(all_texts, PART):
            w = windows(all_texts[a:b], k, m)
            keys.append(w.key)
            owners.append(ids[a:b][w.doc[w.at]])
        keys, owners = np.concatenate(keys), np.concatenate(owners)
        if not len(keys):
            return [px.part(keys, [keys, owners, owners, keys.astype(np.uint32)])]
        order = np.lexsort((owners, keys))
        keys, owners = keys[order], owners[order]
        begin, low, high = _least_and_greatest(np.arange(len(keys)), _changes(keys), owners, owners)
        count = np.add.reduceat(_changes(keys, owners).astype(np.int64), begin).astype(np.uint32)
        keys = keys[begin]
        return [px.part(px.bucket_of(keys, n), [keys, low, high, count])]

    def shared(parts: list[px.Part]) -> list[px.Part]:
        keys, low, high, count = parts[0].columns
        order = np.argsort(keys, kind="stable")
        new = _changes(keys[order])
        begin, low, high = _least_and_greatest(order, new, low, high)
        group = np.cumsum(new) - 1
        wanted = np.empty(len(keys), dtype=bool)
        is_hot = np.empty(len(keys), dtype=bool)
        wanted[order] = (low < high)[group]
        is_hot[order] = (np.add.reduceat(count[order].astype(np.int64), begin) > hot)[group]
        return [px.part(parts[0].peer[wanted], [keys[wanted], is_hot[wanted]])]

    def travel(table: pa.Table, answers: list[px.Part]) -> list[px.Part]:
        _, ids, all_texts = px.of_chunk(table)
        keys, is_hot = answers[0].columns
        order = np.argsort(keys)
        keys, is_hot = keys[order], is_hot[order]
        prints, prints_2, owners, targets, strings = [], [], [], [], []
        first, second, window_owners = [], [], []
        for a, b in chunks(all_texts, PART) if len(keys) else ():
            w = windows(all_texts[a:b], k, m)
            if not len(w.at):
                continue
            place = np.minimum(np.searchsorted(keys, w.key), len(keys) - 1)
            found = keys[place] == w.key
            pick = np.flatnonzero(found & ~is_hot[place])
            some = w.strings(k, pick)
            one, two = fingerprints(some)
            prints.append(one)
            prints_2.append(two)
            owners.append(ids[a:b][w.doc[w.at[pick]]])
            targets.append(w.key[pick])
            strings += some
            pick = np.flatnonzero(found & is_hot[place])
            if len(pick):
                each = np.repeat(w.at[pick] - np.concatenate([[0], np.cumsum(w.n[pick])[:-1]]), w.n[pick]) + np.arange(w.n[pick].sum())
                first.append(window_hashes(w.h, k)[each])
                second.append(window_hashes(word_hashes(w.buf, w.start, w.end, 2), k)[each])
                window_owners.append(ids[a:b][w.doc[each]])
        prints, prints_2, targets, first, second = (np.concatenate(x) if x else np.zeros(0, dtype=np.uint64) for x in (prints, prints_2, targets, first, second))
        owners, window_owners = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (owners, window_owners))
        order = np.lexsort((owners, prints_2, prints, targets))
        begin, low, high = np.zeros(0, dtype=np.int64), owners[:0], owners[:0]
        if len(order):
            begin, low, high = _least_and_greatest(order, _changes(targets[order], prints[order], prints_2[order]), owners, owners)
        picked = order[begin]
        whole = px.part(px.bucket_of(targets[picked], n), [prints[picked], prints_2[picked], low, high], [strings[i] for i in picked])
        order = np.lexsort((window_owners, second, first))
        begin, low, high = np.zeros(0, dtype=np.int64), window_owners[:0], window_owners[:0]
        if len(order):
            begin, low, high = _least_and_greatest(order, _changes(first[order], second[order]), window_owners, window_owners)
        first, second = first[order[begin]], second[order[begin]]
        return [whole, px.part(px.bucket_of(first, n), [first, second, low, high])]

    def earliest(parts: list[px.Part]) -> list[px.Part]:
        whole, alone = parts
        prints, prints_2, low_of, high_of = whole.columns
        strings = px.split(whole)
        one, two, low, high, entry, offset = [], [], [], [], [], []
        for a, b in chunks(strings, PART):
            buf, begins = joined(strings[a:b])
            start, end = spans(buf)
            doc = np.searchsorted(begins, start, side="right") - 1
            places = np.flatnonzero(doc[: len(doc) - k + 1] == doc[k - 1 :])
            one.append(window_hashes(word_hashes(buf, start, end, 1), k)[places])
            two.append(window_hashes(word_hashes(buf, start, end, 2), k)[places])
            own = doc[places]
            low.append(low_of[a:b][own])
            high.append(high_of[a:b][own])
            entry.append(own + a)
            offset.append(places - np.searchsorted(doc, own))
        n_entries = len(prints)
        one, two, low, high = (np.concatenate([*x, y]) for x, y in zip((one, two, low, high), alone.columns, strict=True))
        entry = np.concatenate([*entry, n_entries + np.arange(len(alone.peer))])
        offset = np.concatenate([*offset, np.zeros(len(alone.peer), dtype=np.int64)])
        first = _first_of(low, one, two) if len(one) else low
        needed = np.flatnonzero(first < high)
        first, entry, offset = first[needed], entry[needed], offset[needed]
        inside = entry < n_entries
        single = entry[~inside] - n_entries
        e, o, f = entry[inside], offset[inside], first[inside]
        begin = np.zeros(0, dtype=np.int64)
        if len(e):
            run = np.ones(len(e), dtype=bool)
            run[1:] = (e[1:] != e[:-1]) | (o[1:] != o[:-1] + 1) | (f[1:] != f[:-1])
            begin = np.flatnonzero(run)
        length = np.diff(np.append(begin, len(e))).astype(np.uint32)
        e = e[begin]
        return [
            px.part(whole.peer[e], [prints[e], prints_2[e], o[begin].astype(np.uint32), length, f[begin]]),
            px.part(alone.peer[single], [alone.columns[0][single], alone.columns[1][single], first[~inside]]),
        ]

    def remove(table: pa.Table, answers: list[px.Part]) -> pa.Table:
        _, ids, all_texts = px.of_chunk(table)
        order = np.lexsort((answers[0].columns[1], answers[0].columns[0]))
        prints, prints_2, offset, length, first = (x[order] for x in answers[0].columns)
        offset, length = offset.astype(np.int64), length.astype(np.int64)
        order = np.lexsort((answers[1].columns[1], answers[1].columns[0]))
        single, single_2, single_first = (x[order] for x in answers[1].columns)
        counts, removed, digests, kept = [], [], [], []
        for a, b in chunks(all_texts, PART):
            gone = None
            if len(prints) or len(single):
                w = windows(all_texts[a:b], k, m)
                change = np.zeros(len(w.h) + 1, dtype=np.int64)
                if len(w.at) and len(prints):
                    own, own_2 = fingerprints(w.strings(k, np.arange(len(w.at))))
                    i, j = np.searchsorted(prints, own), np.searchsorted(prints, own, side="right")
                    which = np.repeat(np.arange(len(own)), j - i)
                    place = np.repeat(i - np.concatenate([[0], np.cumsum(j - i)[:-1]]), j - i) + np.arange(len(which))
                    hit = (own_2[which] == prints_2[place]) & (ids[a:b][w.doc[w.at[which]]] > first[place])
                    begin = w.at[which[hit]] + offset[place[hit]]
                    np.add.at(change, begin, 1)
                    np.add.at(change, begin + length[place[hit]] + k - 1, -1)
                if len(single) and len(w.valid) and w.valid.any():
                    places = np.flatnonzero(w.valid)
                    own = window_hashes(w.h, k)[places]
                    i, j = np.searchsorted(single, own), np.searchsorted(single, own, side="right")
                    if (j > i).any():
                        own_2 = window_hashes(word_hashes(w.buf, w.start, w.end, 2), k)[places]
                        which = np.repeat(np.arange(len(own)), j - i)
                        place = np.repeat(i - np.concatenate([[0], np.cumsum(j - i)[:-1]]), j - i) + np.arange(len(which))
                        hit = which[(own_2[which] == single_2[place]) & (ids[a:b][w.doc[places[which]]] > single_first[place])]
                        np.add.at(change, places[hit], 1)
                        np.add.at(change, places[hit] + k, -1)
                gone = np.cumsum(change[:-1]) > 0
                per_text = np.searchsorted(w.doc, np.arange(b - a + 1))
                dropped = np.concatenate([[0], np.cumsum(gone)])
            for t in range(a, b):
                words = all_texts[t].split()
                counts.append(len(words))
                lost = int(dropped[per_text[t - a + 1]] - dropped[per_text[t - a]]) if gone is not None else 0
                removed.append(lost)
                if lost:
                    words = list(compress(words, ~gone[per_text[t - a] : per_text[t - a + 1]]))
                text = b" ".join(words)
                digests.append(hashlib.sha256(text).hexdigest())
                if texts:
                    kept.append(text.decode("utf-8", "replace"))
        ids_column = table.column("id").combine_chunks() if table.num_rows else pa.array([], pa.int64())
        out = {key: ids_column, "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        return pa.table(out | ({"kept": pa.array(kept, pa.string())} if texts else {}))

    many = exchange.to_chunks(exchange.to_buckets(docs, minimisers, MINIMISERS), shared, MINIMISERS, SHARED)
    early = exchange.to_chunks(exchange.to_buckets_with(docs, many, travel, SHARED, TRAVEL), earliest, TRAVEL, EARLIEST)
    return exchange.with_answers(docs, early, remove, EARLIEST, f"{key} long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts)


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 48)) AS i, ws FROM w WHERE len(ws) >= 50),
k AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS key FROM g),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY key) AS first FROM k),
x AS (SELECT DISTINCT doc_id, i FROM f WHERE first < doc_id),
p AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS j, unnest(ws) AS word FROM w),
m AS (SELECT p.doc_id, j, word, max(x.i) OVER (PARTITION BY p.doc_id ORDER BY j) AS last
      FROM p LEFT JOIN x ON p.doc_id = x.doc_id AND p.j = x.i),
r AS (SELECT doc_id, j, word, coalesce(j - last < 50, FALSE) AS gone FROM m),
s AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n_words, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_removed,
             sha256(coalesce(string_agg(CASE WHEN NOT gone THEN word END, ' ' ORDER BY j), '')) AS kept_sha256 FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM w LEFT JOIN s ON w.doc_id = s.doc_id
"""
