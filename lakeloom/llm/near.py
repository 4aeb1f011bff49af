"""N-gram Jaccard join by adaptive multi-match prefixes, and the components of its links.

A document's set is its distinct n-word shingles. Two documents link when their sets' Jaccard
similarity reaches the threshold; links lose nothing, but copies are not expanded into pairs.

1. Chunks of documents send their shingles' counts to buckets (``packed``), which answer with the
   document frequency of every shingle that more than one document has. A document with fewer such
   shingles than a link needs has no partner and is done.
2. The others are kept with their sets and prefixes, rarest shingles first, so shingles of no other
   document fill the prefix for free. Equal sets become one representative.
3. Representatives that share a prefix shingle are joined to the least of them; components of these
   candidate links are groups. Partners always share a prefix shingle, so no link leaves a group.
4. Groups are joined in memory. Every set orders its shingles rarest first within the group and
   chooses the length of its prefix: the 1-prefix plus l-1 shingles, where l minimises the
   estimated cost of lists read plus candidates verified. A pair must share at least the smaller
   of its two l in the corresponding prefixes before its overlap is counted. Pairs that are
   already connected aren't looked at again.
   A group of more than ``SETS`` sets or ``BLOCK`` shingles is dealt out: its sets are first joined,
   part by part, with a few of them as pivots, which most near copies link to, so this takes time
   in proportion to the group. Pairs of one component need no comparison any more; what remains
   is those of sets outside a group's largest component, which go as pairs of blocks.
5. Components of the links found, over representatives, give each document its class.

Shingles are compared by 64-bit hashes, sets by 128 bits; the frequencies of step 1 use fewer bits,
which can only let a document through to the exact steps.

Defined results: null and empty texts have empty sets and no partner; texts of fewer than n words
have one shingle, the whole sequence; rows that share an id are documents of their own; a null id
is greater than every other and is a null component only among nulls; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm import packed as px
from lakeloom.llm.common import chunks, joined, mix, small_batches, spans, text_column, window_hashes, word_hashes, written
from lakeloom.llm.components import components

PART = 1_500_000
#: Shingles of a block; a task holds two blocks, and about ten numbers for each shingle.
BLOCK = 1_000_000
#: Sets of a group that one task joins; larger groups are dealt out.
SETS = 256
#: Rounds of pivots in a large group, and pivots of a round.
ROUNDS, PIVOTS = 2, 8
#: Cost of counting one shingle of a candidate's overlap, where reading one list entry costs 1.
VERIFY = 0.5
BASE = "id long, n_shingles long, print_a long, print_b long, prefix array<long>, shingles binary"
PRINTS = ["print_a", "print_b", "n_shingles"]
COUNTS = (px.Kind((np.uint64, np.uint32)),)  # a shingle and how many documents have it


def sets_of(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and shingle hash of each text's distinct shingles, sorted."""
    buf, begins = joined([t.lower() for t in texts])  # bytes: A-Z only
    start, end = spans(buf)
    h = word_hashes(buf, start, end)
    doc = np.searchsorted(begins, start, side="right") - 1
    grams = window_hashes(h, n)
    ok = doc[: len(grams)] == doc[n - 1 :] if len(grams) else np.zeros(0, dtype=bool)
    owner, grams = doc[: len(grams)][ok], grams[ok]
    words = np.bincount(doc, minlength=len(texts))
    short = np.flatnonzero((words > 0) & (words < n))
    if len(short):
        first = np.searchsorted(doc, short)
        one = np.zeros(len(short), dtype=np.uint64)
        for k in range(n - 1):  # words of a short text, one place at a time
            have = words[short] > k
            one[have] = mix(one[have] * np.uint64(31) + h[first[have] + k] + np.uint64(k + 1))
        owner, grams = np.concatenate([owner, short]), np.concatenate([grams, mix(one ^ np.uint64(0x1234567))])
    order = np.lexsort((grams, owner))
    owner, grams = owner[order], grams[order]
    keep = np.ones(len(owner), dtype=bool)
    keep[1:] = (owner[1:] != owner[:-1]) | (grams[1:] != grams[:-1])
    return owner[keep], grams[keep]


def needed(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Shared shingles without which a set of n has no link: percent of n, rounded up."""
    return (percent * n + 99) // 100


def row_print(df: DataFrame, key: str, column: str) -> Column:
    """What tells a row from others: 128 bits of its id and text together."""
    return F.md5(F.concat_ws(":", F.coalesce(df[key].cast("long").cast("string"), F.lit("null")), text_column(df, column)))


def signatures(df: DataFrame, key: str, column: str, n: int, percent: int, chunk_bytes: int, direct: int = px.DIRECT, rows: bool = False) -> DataFrame:
    """BASE rows: for sets that may have a partner also print, prefix and shingles; null for others.

    With ``rows`` also each row's ``row_print``.
    """
    size = px.stored_size(df, column)
    n_chunks = px.number_of_chunks(size, chunk_bytes)
    bits = min(60, max(34, size.bit_length() + 7))
    drop = np.uint64(64 - bits)
    docs = px.chunked(df, n_chunks, key, column)
    exchange = px.Exchange(n_chunks, direct)

    def counts(table: pa.Table) -> list[px.Part]:
        _, _, texts = px.of_chunk(table)
        found = np.sort(np.concatenate([sets_of(texts[a:b], n)[1] >> drop for a, b in chunks(texts, PART)]))
        new = np.ones(len(found), dtype=bool)
        new[1:] = found[1:] != found[:-1]
        begin = np.flatnonzero(new)
        found, count = found[begin], np.diff(np.append(begin, len(found))).astype(np.uint32)
        return [px.part(px.bucket_of(found << drop, n_chunks), [found, count])]

    def frequencies(parts: list[px.Part]) -> list[px.Part]:
        keys, count = parts[0].columns
        order = np.argsort(keys, kind="stable")
        new = np.ones(len(keys), dtype=bool)
        new[1:] = keys[order][1:] != keys[order][:-1]
        total = np.empty(len(keys), dtype=np.int64)
        total[order] = np.add.reduceat(count[order].astype(np.int64), np.flatnonzero(new))[np.cumsum(new) - 1]
        at = np.flatnonzero(total > 1)
        return [px.part(parts[0].peer[at], [keys[at], np.minimum(total[at], 2**32 - 1).astype(np.uint32)])]

    def select(table: pa.Table, answers: list[px.Part]) -> pa.Table:
        _, ids, texts = px.of_chunk(table)
        order = np.argsort(answers[0].columns[0], kind="stable")
        known, total = (x[order] for x in answers[0].columns)
        total = total.astype(np.int64)
        sizes, print_a, print_b, prefixes, sets = [], [], [], [], []
        for a, b in chunks(texts, PART):
            owner, grams = sets_of(texts[a:b], n)
            df_of = np.ones(len(grams), dtype=np.int64)
            if len(known):
                short = grams >> drop
                place = np.minimum(np.searchsorted(known, short), len(known) - 1)
                df_of = np.where(known[place] == short, total[place], 1)
            size = np.bincount(owner, minlength=b - a)
            common = np.bincount(owner, weights=df_of > 1, minlength=b - a).astype(np.int64)
            begin = np.concatenate([[0], np.cumsum(size)])
            candidate = (size > 0) & (common >= needed(size, percent))
            for t in range(b - a):
                sizes.append(int(size[t]))
                if not candidate[t]:
                    print_a.append(None)
                    print_b.append(None)
                    prefixes.append(None)
                    sets.append(None)
                    continue
                own, freq = grams[begin[t] : begin[t + 1]], df_of[begin[t] : begin[t + 1]]
                order = np.lexsort((own, freq))
                first = order[: len(own) - int(needed(len(own), percent)) + 1]
                prefixes.append(own[first[freq[first] > 1]].view(np.int64))
                print_a.append(int(own.sum(dtype=np.uint64).astype(np.int64)))
                print_b.append(int(mix(own ^ np.uint64(0xABCDEF)).sum(dtype=np.uint64).astype(np.int64)))
                sets.append(own.tobytes())
        ids_column = table.column("id").combine_chunks() if table.num_rows else pa.array([], pa.int64())
        told = [hashlib.md5(b"%s:%s" % (b"null" if i is None else b"%d" % i, t)).hexdigest() for i, t in zip(ids_column.to_pylist(), texts, strict=True)] if rows else None
        return pa.table(
            {
                "id": ids_column,
                "n_shingles": pa.array(sizes, pa.int64()),
                "print_a": pa.array(print_a, pa.int64()),
                "print_b": pa.array(print_b, pa.int64()),
                "prefix": pa.array(prefixes, pa.list_(pa.int64())),
                "shingles": pa.array(sets, pa.binary()),
            }
            | ({"row": pa.array(told, pa.string())} if rows else {})
        )

    told = exchange.to_chunks(exchange.to_buckets(docs, counts, COUNTS), frequencies, COUNTS, COUNTS)
    return exchange.with_answers(docs, told, select, COUNTS, BASE + ", row string" * rows)


def adaptive_lengths(ranks: list[np.ndarray], frequency: np.ndarray, percent: int) -> np.ndarray:
    """l of each set: how many prefix shingles a pair must share, by the least estimated cost.

    ranks: each set's shingles, rarest first; frequency: sets of each shingle. The lists of an
    l-prefix hold sum(frequency - 1) entries; each partner is met about l times among them, so
    about a l-th of that many candidates are left to verify.
    """
    out = np.ones(len(ranks), dtype=np.int64)
    for i, r in enumerate(ranks):
        size, most = len(r), int(needed(len(r), percent))
        read = np.cumsum(frequency[r] - 1)
        choices = [1]
        while choices[-1] * 2 <= most // 2:
            choices.append(choices[-1] * 2)
        l = np.array(choices)
        entries = read[size - most + l - 1]
        out[i] = l[np.argmin(entries + VERIFY * size * entries / l)]
    return out


def join_in_memory(ids: np.ndarray, sets: list[np.ndarray], percent: int, side: np.ndarray | None = None, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """(id, root) of every id that links connect with a smaller one; with ``side``, only pairs of different sides.

    Ids of one ``label`` count as connected from the start; then (id, root) is told of one id for each label.
    """
    count = len(sets)
    order = np.lexsort((ids, [len(s) for s in sets]))
    ids, sets = ids[order], [sets[i] for i in order]
    side = None if side is None else side[order]
    label = ids if label is None else label[order]
    sizes = np.array([len(s) for s in sets])
    values, inverse, frequency = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), dtype=np.int64)
    rank[np.lexsort((values, frequency))] = np.arange(len(values))
    frequency = np.sort(frequency)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    ranks = [np.sort(rank[inverse[bounds[i] : bounds[i + 1]]]) for i in range(count)]
    members = np.concatenate(ranks)
    matches = adaptive_lengths(ranks, frequency, percent)
    base = sizes - needed(sizes, percent)
    # Lists of all prefixes, by shingle and then by set.
    length = base + matches
    of = np.repeat(np.arange(count), length)
    at = np.arange(length.sum()) - np.repeat(np.concatenate([[0], np.cumsum(length)[:-1]]), length)
    token = members[bounds[of] + at]
    by = np.lexsort((of, token))
    list_set, list_at, list_token = of[by], at[by], token[by]
    where = np.empty(len(by), dtype=np.int64)
    where[by] = np.arange(len(by))
    new = np.ones(len(by), dtype=bool)
    new[1:] = list_token[1:] != list_token[:-1]
    list_begin = np.flatnonzero(new)[np.cumsum(new) - 1]
    starts = np.concatenate([[0], np.cumsum(length)])

    _, at_first, of_label = np.unique(label, return_index=True, return_inverse=True)
    root = at_first[of_label]
    grouped: dict[int, list[int]] = {}
    for i, own in enumerate(root.tolist()):
        grouped.setdefault(own, []).append(i)

    def unite(x: int, y: int) -> None:
        a, b = root[x], root[y]
        if a != b:
            if len(grouped[a]) < len(grouped[b]):
                a, b = b, a
            root[grouped[b]] = a
            grouped[a] += grouped.pop(b)

    mark = np.zeros(len(values), dtype=bool)
    for x in range(count):
        mine = where[starts[x] : starts[x + 1]]
        begin, many = list_begin[mine], mine - list_begin[mine]
        if not many.any():
            continue
        total = int(many.sum())
        entry = np.arange(total) + np.repeat(begin - np.concatenate([[0], np.cumsum(many)[:-1]]), many)
        y, own_at = list_set[entry], np.repeat(np.arange(length[x]), many)
        l = np.minimum(matches[x], matches[y])
        ok = (own_at < base[x] + l) & (list_at[entry] < base[y] + l) & (100 * sizes[y] >= percent * sizes[x]) & (root[y] != root[x])
        if side is not None:
            ok &= side[y] != side[x]
        found, shared = np.unique(y[ok], return_counts=True)
        enough = shared >= np.minimum(matches[x], matches[found])
        found = found[enough][np.argsort(-shared[enough], kind="stable")]
        if not len(found):
            continue
        mark[ranks[x]] = True
        width = 4
        while len(found):
            some, found = found[:width], found[width:]
            width = min(256, width * 2)
            widths = sizes[some]
            place = np.arange(widths.sum()) + np.repeat(bounds[some] - np.concatenate([[0], np.cumsum(widths)[:-1]]), widths)
            overlap = np.add.reduceat(mark[members[place]].astype(np.int64), np.concatenate([[0], np.cumsum(widths)[:-1]]))
            linked = some[100 * overlap >= percent * (sizes[some] + sizes[x] - overlap)]
            for z in linked:
                unite(x, int(z))
            if len(linked):
                found = found[root[found] != root[x]]
        mark[ranks[x]] = False
    out = []
    for own in grouped.values():
        _, some = np.unique(label[own], return_index=True)
        if len(some) > 1:
            found = ids[own][some]
            least = int(found.min())
            out += [(int(i), least) for i in found if i != least]
    return out


def _linked(table: pa.Table, percent: int) -> pa.Table:
    """Links of a task's sets, between sides if they have any."""
    named = {c: table.column(c).to_numpy() for c in table.column_names if c in ("node", "side", "label")}
    sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column("shingles").to_pylist()]
    found = join_in_memory(named["node"], sets, percent, named.get("side"), named.get("label"))
    return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})


def _linked_in_turn(dealt: DataFrame, by: list[str], number: Column, parts: int, percent: int) -> DataFrame:
    """Links of the rows of each ``by``, one after the other in a task; ``number`` says which of ``parts`` tasks.

    Numbers that follow each other go to different tasks, where a hash would put several into one.
    """
    columns = [*by, *(c for c in ("node", "side", "label", "shingles") if c in dealt.columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        last = None
        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in by), strict=True))
            begin = 0
            for i, key in enumerate(keys):
                if key != last:
                    if begin < i:
                        held.append(pa.Table.from_batches([b.slice(begin, i - begin)]))
                    if held:
                        yield from _linked(pa.concat_tables(held), percent).to_batches()
                    held, begin, last = [], i, key
            if begin < len(keys):
                held.append(pa.Table.from_batches([b.slice(begin)]))
        if held:
            yield from _linked(pa.concat_tables(held), percent).to_batches()

    small_batches(dealt.sparkSession)
    most = 8 * int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, min(parts, most))
    return dealt.repartitionById(n, F.pmod(number, F.lit(n)).cast("int")).select(*columns).sortWithinPartitions(*by).mapInArrow(run, "a long, b long")


def linked_in_large(members: DataFrame, percent: int, block: int, sets: int) -> DataFrame:
    """Links that connect what is connected in groups too large for a task.

    members: group, node, n_shingles, shingles, load (the group's shingles) and many (its sets).
    """
    parts = F.ceil(F.greatest(F.col("load") / block, F.col("many") / sets)).cast("int")
    members = members.withColumn("parts", parts)
    total = int(members.groupBy("group").agg(F.first("parts").alias("parts")).agg(F.sum("parts")).first()[0])
    at = F.xxhash64("group")
    state = members.select("group", "node", "n_shingles", "load", "parts", F.col("node").alias("label"), F.lit(True).alias("open"))
    links, pivots = None, None
    for r in range(ROUNDS):
        slot = F.pmod(F.xxhash64("node", F.lit(r)), F.lit(PIVOTS))
        chosen = state.filter("open").groupBy("group", slot.alias("slot")).agg(F.min(F.struct(F.xxhash64("node", F.lit(-r - 1)).alias("h"), "node")).alias("first"))
        chosen = written(chosen.select(F.col("first.node").alias("node")), "pivots")
        pivots = chosen if pivots is None else pivots.union(chosen)
        some = members.join(chosen, "node").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("side", F.lit(1))
        others = members.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("side", F.lit(0))
        both = others.unionByName(some).select("group", "part", "node", "side", "shingles")
        found = written(_linked_in_turn(both, ["group", "part"], at + F.col("part"), total, percent), "stars")
        links = found if links is None else links.union(found)
        state = state.drop("label", "open").join(components(links), "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
        largest = state.groupBy("group", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("group").agg(F.max(F.struct("n", "label")).alias("top"))
        state = state.join(largest, "group").join(pivots.withColumn("is_pivot", F.lit(True)).distinct(), "node", "left")
        state = written(state.withColumn("open", F.col("is_pivot").isNull() & (F.col("label") != F.col("top.label"))).drop("top", "is_pivot"), "groups")
        if state.filter("open").isEmpty():
            return links
    # Sets outside the largest component against all of their group, in pairs of blocks.
    left = state.filter("open").groupBy("group").agg(F.ceil(F.greatest(F.sum("n_shingles") / block, F.count(F.lit(1)) / sets)).cast("int").alias("rows"))
    placed = state.join(left, "group").join(members.select("node", "shingles"), "node")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    every = placed.select("group", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), own.alias("j"), "node", "label", F.lit(0).alias("side"), "shingles")
    rest = placed.filter("open").select("group", F.pmod(F.xxhash64("node"), F.col("rows")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"), "node", "label", F.lit(1).alias("side"), "shingles")
    pairs = int(placed.groupBy("group").agg((F.first("rows") * F.first("parts")).alias("pairs")).agg(F.sum("pairs")).first()[0])
    both = every.unionByName(rest).join(placed.groupBy("group").agg(F.first("parts").alias("parts")), "group")
    found = _linked_in_turn(both, ["group", "i", "j"], at + F.col("i") * F.col("parts") + F.col("j"), pairs, percent)
    return links.union(written(found, "links"))


def linked_sets(base: DataFrame, rep: Column, percent: int, block: int, sets: int = SETS) -> DataFrame:
    """Each set that may have a partner: its print, node, rep (the least over its rows) and the root it is connected with."""
    reps = (
        base.filter(F.col("print_a").isNotNull())
        .groupBy(*PRINTS)
        .agg(F.min(rep).alias("rep"), F.first("prefix").alias("prefix"), F.first("shingles").alias("shingles"))
    )
    # Equal sets are one node. Its number is its place in the written table, so no two nodes share one.
    reps = written(reps.withColumn("node", F.monotonically_increasing_id()), "representatives")
    lists = reps.select("node", F.explode("prefix").alias("shingle"))
    least = lists.groupBy("shingle").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("many")).filter("many > 1")
    near = lists.join(least, "shingle").select(F.col("node").alias("a"), F.col("first").alias("b")).filter("a != b").distinct()
    groups = components(near).withColumnRenamed("root", "group")
    # Sizes are joined before sets are, so no set of a large group is dealt by its group.
    placed = groups.join(reps.select("node", "n_shingles"), "node")
    loads = placed.groupBy("group").agg(F.sum("n_shingles").alias("load"), F.count(F.lit(1)).alias("many"))
    placed = written(placed.join(loads, "group"), "groups")
    is_large = (F.col("load") > block) | (F.col("many") > sets)
    shingles = reps.select("node", "shingles")
    small = placed.filter(~is_large).select("group", "node").join(shingles, "node")
    links = small.groupBy("group").applyInArrow(lambda t: _linked(t, percent), "a long, b long")
    large = placed.filter(is_large)
    if not large.isEmpty():
        links = links.union(linked_in_large(written(large.join(shingles, "node"), "large"), percent, block, sets))
    linked = components(links)
    return reps.select(*PRINTS, "node", "rep").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))


def classes(df: DataFrame, key: str = "doc_id", column: str = "text", n: int = 4, percent: int = 85, block: int = BLOCK, sets: int = SETS, chunk_bytes: int = px.CHUNK_BYTES, direct: int = px.DIRECT) -> DataFrame:
    """One row for each row of the input: key long, n_shingles long, component_id long."""
    none = F.lit(int(px.NO_ID))
    base = written(signatures(df, key, column, n, percent, chunk_bytes, direct), "sets")
    named = linked_sets(base, F.coalesce("id", none), percent, block, sets)
    least_id = named.groupBy("root").agg(F.min("rep").alias("component"))
    named = named.join(least_id, "root").select(*(F.col(p).alias(f"_{p}") for p in PRINTS), "component")
    same = (base["print_a"] == named["_print_a"]) & (base["print_b"] == named["_print_b"]) & (base["n_shingles"] == named["_n_shingles"])
    out = base.select("id", *PRINTS).join(named, same, "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(key), "n_shingles", F.when(component == none, F.lit(None)).otherwise(component).cast("long").alias("component_id"))


def one_of_each(df: DataFrame, key: str = "doc_id", column: str = "text", n: int = 5, percent: int = 80, block: int = BLOCK, sets: int = SETS, chunk_bytes: int = px.CHUNK_BYTES, direct: int = px.DIRECT) -> DataFrame:
    """The input's rows and columns with one document of each class: the one with the least id.

    Rows are told apart by id and text, so rows whose ids are null or repeated stay unless their
    texts are near copies. Of near copies of one id the row of the least ``row_print`` stays, of
    rows equal in both any one; rows without a partner, such as empty texts, all stay.
    """
    names = [f"c{i}" for i in range(len(df.columns))]
    plain = df.toDF(*names)  # so that no name clashes
    key, text = names[df.columns.index(key)], names[df.columns.index(column)]
    base = written(signatures(plain, key, text, n, percent, chunk_bytes, direct, rows=True), "sets")
    least = F.struct(F.col("id").isNull().alias("none"), "id", "row")  # a null id is greater than every other
    first = linked_sets(base, least, percent, block, sets).groupBy("root").agg(F.min("rep").alias("rep"))
    stay = first.select(F.col("rep.row").alias("row"), F.lit(True).alias("stays"))
    linked = base.filter(F.col("print_a").isNotNull()).select("row", F.lit(False).alias("stays"))
    told = linked.unionByName(stay).groupBy("row").agg(F.max("stays").alias("stays"))
    w = Window.partitionBy("row").orderBy("row")
    found = plain.withColumn("row", row_print(plain, key, text)).join(told, "row", "left").withColumn("place", F.row_number().over(w))
    return found.filter(F.col("stays").isNull() | (F.col("stays") & (F.col("place") == 1))).select(*names).toDF(*df.columns)


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i, ws FROM d WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, md5(CAST(len(ws[i:i + 3]) AS VARCHAR) || ' ' || array_to_string(ws[i:i + 3], ' ')) AS h FROM g),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN c cx ON cx.doc_id = x JOIN c cy ON cy.doc_id = y WHERE 100 * o >= 85 * (cx.n + cy.n - o)),
e AS (SELECT x AS a, y AS b FROM l UNION SELECT y, x FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN m ON m.a = d.doc_id
"""
