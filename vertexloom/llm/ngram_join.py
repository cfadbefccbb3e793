"""N-gram Jaccard join: rare-first prefix filtering with length, positional and parity filters; each pair is verified once.

A document's set holds the 64-bit hashes of its distinct five-word shingles. Documents with equal sets form one class,
known by a hash of the set. Shingles are ordered by frequency, then by hash: a bounded table holds the most frequent of those that
repeat within a block of documents, and all others come first. Any order gives the same links, this one puts the frequent last. Sets with a Jaccard similarity of 0.75
share one of the first n - ceil(3n/4) + 1 shingles of either. These prefix postings are sorted by shingle:

1. each class of a list is paired with the list's smallest, if length and position allow it;
2. the pairs pass the parity filter, which compares a bit or two for each shingle in place of the sets, and are verified;
3. long lists whose classes the links have not yet joined to one component are paired with other classes of theirs,
   drawn by hash, in some rounds of step 2;
4. lists that are still open pair off the classes of different components, under the same filters. So no list of near
   copies becomes all its pairs, and yet no link is lost that joins two components.

Defined results: null texts and texts without words have no shingle, link with nothing and are their own component.
Null ids are never the smallest of a component unless all are. Repeated rows give a row each. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from . import textscan
from .common import removed, small, stored
from .components import components

#: Frequent shingles at most: 9 bytes each on the driver and as broadcast, however large the corpus. Shingles of a block of counts.
FREQUENT, BLOCK = 1 << 20, 1 << 21
#: Bits of parity of a set at least; a larger one has one to two for each shingle.
BITS = 512
#: Parts of the shingles whose postings are shuffled one after the other, so that a part of all lies on disk at a time.
PARTS = 2
#: Classes a task remembers to have posted; a copy posted again costs time only.
POSTED = 50_000
#: Similarity 3/4 in integers.
UP, DOWN = 3, 4
#: Rounds in which the open lists of over WIDE rows are paired with drawn heads before their pairs; orders to draw them by.
ROUNDS, WIDE, HEADS = 2, 8, 8

_SETS = "doc_id long, n long, set_id long, parity array<long>, shingle long, seen long"


def set_id(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def _parity(s: np.ndarray) -> np.ndarray:
    """A bit for each value of the shingles' last bits: whether an odd number of them has it."""
    bits = max(BITS, 1 << (len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size, class and parity of each document, and the shingles that a block of the task's documents repeats, with their counts."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("set_id", pa.int64()), ("parity", pa.list_(pa.int64())), ("shingle", pa.int64()), ("seen", pa.int64())])
    waiting, held = [], 0

    def repeated() -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(waiting), return_counts=True)
        again = counts > 1
        k = int(again.sum())
        none = [pa.nulls(k, t) for t in schema.types[:4]]
        return pa.RecordBatch.from_arrays([*none, pa.array(values[again].view(np.int64)), pa.array(counts[again], pa.int64())], schema=schema)

    for batch in batches:
        sizes, ids, parity = [], [], []
        for s in textscan.shingle_sets(batch.column(1)):
            sizes.append(len(s))
            ids.append(set_id(s))
            parity.append(_parity(s))
            waiting.append(s)
            held += len(s)
            if held > BLOCK:
                yield repeated()
                waiting, held = [], 0
        n = batch.num_rows
        listed = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parity)]).astype(np.int32)), pa.array(np.concatenate(parity) if parity else np.zeros(0, np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), listed, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], schema=schema)
    if waiting:
        yield repeated()


def _frequent(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted, and their levels: eighths of the binary logarithm of their count. Levels are taken from
    the top as long as they hold FREQUENT shingles at most."""
    level = F.least(F.lit(255), F.floor(F.log2(F.sum("seen")) * 8)).cast("int").alias("level")
    counts = stored(sets.where("seen is not null").groupBy("shingle").agg(level), "frequent")
    total, lowest = 0, 256
    for row in sorted(counts.groupBy("level").count().collect(), key=lambda r: -r["level"]):
        total += row["count"]
        if total > FREQUENT:
            break
        lowest = row["level"]
    found = counts.where(F.col("level") >= lowest).toArrow()
    shingles, levels = found["shingle"].to_numpy().view(np.uint64), found["level"].to_numpy().astype(np.uint8)
    order = np.argsort(shingles)
    return shingles[order], levels[order]


def _rare_first(s: np.ndarray, shingles: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The order of a sorted set: what is not frequent, then by level, then by hash."""
    if not len(shingles):
        return np.arange(len(s))
    at = np.minimum(np.searchsorted(shingles, s), len(shingles) - 1)
    return np.argsort(np.where(shingles[at] == s, levels[at], 0), kind="stable")


def _postings(frequent, part: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, levels = frequent.value
        posted: set[int] = set()
        for batch in batches:
            keys, ids, meta, held = [], [], [], 0
            for s in textscan.shingle_sets(batch.column(0)):
                n = len(s)
                if not n or (own := set_id(s)) in posted:
                    continue
                if len(posted) >= POSTED:
                    posted.clear()
                posted.add(own)
                p = n - (UP * n + DOWN - 1) // DOWN + 1
                key = s[_rare_first(s, shingles, levels)[:p]]
                at = np.flatnonzero(key % np.uint64(PARTS) == part)
                keys.append(key[at])
                ids.append(np.full(len(at), own, np.int64))
                meta.append((np.int64(n) << 32) | at)
                held += len(at)
                if held > 1 << 18:
                    yield _longs(keys, ids, meta)
                    keys, ids, meta, held = [], [], [], 0
            if keys:
                yield _longs(keys, ids, meta)

    return make


def _longs(*columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).view(np.int64)) for c in columns], names=["shingle", "set_id", "meta"])


def _may_link_arrays(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """As _may_link, of meta."""
    n_a, n_b = a >> 32, b >> 32
    rest = np.minimum(n_a - (a & 0xFFFFFFFF), n_b - (b & 0xFFFFFFFF))
    return (DOWN * np.minimum(n_a, n_b) >= UP * np.maximum(n_a, n_b)) & ((UP + DOWN) * rest >= UP * (n_a + n_b))


_LISTED = pa.schema([("shingle", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("meta", pa.int64())])


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From postings sorted by shingle and meta: pairs (a, b) of the first of each list with the others, and the rows of
    lists of three and more (b is null), of lists of up to WIDE those that another than the first may link with. Only a list that crosses batches is carried: its first row, and its second
    while it has no third."""
    head = last = None  # (shingle, set_id, meta) of the open list's first row and of the one not yet given out as a member
    opened = False
    for batch in batches:
        if not batch.num_rows:
            continue
        key, sid, meta = (batch.column(i).to_numpy() for i in range(3))
        if head is not None:
            key, sid, meta = (np.concatenate([[x], y]) for x, y in zip(head, (key, sid, meta), strict=True))
            if last is not None:
                key, sid, meta = (np.concatenate([y[:1], [x], y[1:]]) for x, y in zip(last, (key, sid, meta), strict=True))
        carried = 0 if head is None else 1 + (last is not None)
        start = np.ones(len(key), bool)
        start[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(start)
        run = np.cumsum(start) - 1
        lead = first[run]
        new = np.arange(len(key)) >= carried
        other = sid != sid[lead]
        # A class has one place in a list, so its copies stand together.
        fresh = np.ones(len(key), bool)
        fresh[1:] = start[1:] | (sid[1:] != sid[:-1])
        fresh &= other
        n_a, n_b = meta[lead] >> 32, meta >> 32
        rest = np.minimum(n_a - (meta[lead] & 0xFFFFFFFF), n_b - (meta & 0xFFFFFFFF))
        paired = fresh & new & (DOWN * n_a >= UP * n_b) & ((UP + DOWN) * rest >= UP * (n_a + n_b))
        members = np.add.reduceat(fresh.astype(np.int64), first)
        was_open = np.zeros(len(first), bool)
        was_open[0] = opened
        wide = (members + 1 >= 3) | was_open
        out = wide[run] & (fresh | start)
        if was_open[0]:
            out &= new | (run > 0)
        # Of short lists that lie whole in the batch, what may link with none but the first has met it.
        short = (members + 1 <= WIDE) & ~was_open
        short[-1] = False
        out[short[run]] = False
        at = np.flatnonzero(short[run] & wide[run] & fresh)
        for lag in range(1, WIDE - 1):
            x, y = at[:-lag], at[lag:]
            may = (key[x] == key[y]) & _may_link_arrays(meta[x], meta[y])
            out[x[may]] = out[y[may]] = True
        pairs = np.unique(np.stack([sid[lead][paired], sid[paired]], 1), axis=0) if paired.any() else np.zeros((0, 2), np.int64)
        k = int(out.sum())
        yield pa.RecordBatch.from_arrays([
            pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(key[out], pa.int64())]), pa.array(np.concatenate([pairs[:, 0], sid[out]]), pa.int64()),
            pa.concat_arrays([pa.array(np.ascontiguousarray(pairs[:, 1]), pa.int64()), pa.nulls(k, pa.int64())]), pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(meta[out], pa.int64())]),
        ], schema=_LISTED)
        i = first[-1]
        head, opened = (key[i], sid[i], meta[i]), bool(wide[-1])
        seconds = np.flatnonzero(fresh[i:]) + i
        last = (key[seconds[0]], sid[seconds[0]], meta[seconds[0]]) if len(seconds) and not opened else None


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        wanted, ids, sets, held = batch.column(1).to_pylist(), [], [], 0
        for want, s in zip(wanted, textscan.shingle_sets(batch.column(0)), strict=True):
            if set_id(s) == want:
                ids.append(want)
                sets.append(s)
                held += len(s)
            if held > 1 << 18:
                yield _set_rows(ids, sets)
                ids, sets, held = [], [], 0
        if ids:
            yield _set_rows(ids, sets)


def _set_rows(ids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
    ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], names=["set_id", "shingles"])


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Of pairs (a, b) of classes, each once, those that are similar enough, as links (u, v). The parity filter goes first: bits
    that differ are shingles that only one of the sets has, at least as many."""
    a, b = (classes.select(F.col("set_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("parity").alias(f"p_{x}")) for x in "ab")
    met = pairs.join(a, "a").join(b, "b")
    k = F.least(F.size("p_a"), F.size("p_b"))
    # Sizes are within 4 to 3, so one has as many bits as the other or twice as many, which its halves fold to.
    p_a, p_b = (F.when(F.size(p) > k, F.zip_with(F.slice(p, F.lit(1), k), F.slice(p, k + 1, k), lambda x, y: x.bitwiseXOR(y))).otherwise(F.col(p)) for p in ("p_a", "p_b"))
    apart = F.aggregate(F.zip_with(p_a, p_b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0).cast("long"), lambda t, x: t + x)
    may = stored(met.where((UP + DOWN) * (F.col("n_a") + F.col("n_b") - apart) >= 2 * UP * (F.col("n_a") + F.col("n_b"))).select("a", "b", "n_a", "n_b"), "pairs")
    wanted = may.select(F.col("a").alias("set_id")).unionAll(may.select(F.col("b").alias("set_id"))).distinct()
    wanted = stored(classes.join(wanted, "set_id", "left_semi").select(F.col("doc").alias("_doc"), F.col("set_id").alias("want")), "wanted")
    rows = texts.join(small(wanted, F.lit(48)), F.col("doc_id").eqNullSafe(F.col("_doc"))).select("text", "want")
    sets = stored(rows.mapInArrow(_fetched, "set_id long, shingles array<long>").dropDuplicates(["set_id"]), "sets")
    a, b = (sets.select(F.col("set_id").alias(x), F.col("shingles").alias(f"s_{x}")) for x in "ab")
    both = F.size(F.array_intersect("s_a", "s_b"))
    met = may.join(a, "a").join(b, "b").where(both * (UP + DOWN) >= UP * (F.col("n_a") + F.col("n_b")))
    links = stored(met.select(F.col("a").alias("u"), F.col("b").alias("v")), "links")
    removed(may, wanted, sets)
    return links


def _joined(groups: DataFrame, links: DataFrame) -> DataFrame:
    """The components of what is in groups and of links."""
    return components(links.unionAll(groups.select(F.col("node").alias("u"), F.col("root").alias("v"))))


def _rooted(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of lists with the component that each class is in so far."""
    return members.join(groups, F.col("set_id") == F.col("node"), "left").select("shingle", "set_id", "meta", F.coalesce("root", "set_id").alias("root"))


def _may_link(a: str, b: str) -> Column:
    """The length and positional filters on two rows of a list."""
    (n_a, at_a), (n_b, at_b) = ((F.shiftright(m, 32), F.col(m).bitwiseAND(F.lit(0xFFFFFFFF))) for m in (a, b))
    rest = F.least(n_a - at_a, n_b - at_b)
    return (DOWN * F.least(n_a, n_b) >= UP * F.greatest(n_a, n_b)) & ((UP + DOWN) * rest >= UP * (n_a + n_b))


def _with_heads(rows: DataFrame, number: int) -> DataFrame:
    """Pairs (a, b) of the classes of each open list of over WIDE rows with one of them, drawn anew for each number. Lists
    draw by one of HEADS orders, so that the lists of a group of near copies share a few heads."""
    drawn = F.struct(F.xxhash64("set_id", F.col("shingle").bitwiseAND(F.lit(HEADS - 1)), F.lit(number)).alias("h"), "set_id", "root", "meta")
    heads = rows.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n"), F.min(drawn).alias("head"))
    heads = heads.where(f"low <> high and n > {WIDE}").select("shingle", F.col("head.set_id").alias("head"), F.col("head.root").alias("head_root"), F.col("head.meta").alias("head_meta"))
    met = rows.join(heads, "shingle").where("root <> head_root").where(_may_link("meta", "head_meta"))
    return met.select(F.least("set_id", "head").alias("a"), F.greatest("set_id", "head").alias("b")).distinct()


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each of df: id_col, n_shingles and component_id, the smallest id reachable by links."""
    spark = df.sparkSession
    ship(spark)
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets = stored(texts.mapInArrow(_sets, _SETS), "sets")
    docs = sets.where("seen is null").select("doc_id", "n", "set_id", "parity")
    classes = stored(docs.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("parity").alias("parity")), "classes")
    frequent = spark.sparkContext.broadcast(_frequent(sets))
    n, lists = int(spark.conf.get("spark.sql.shuffle.partitions")), None
    for part in range(PARTS):
        postings = texts.select("text").mapInArrow(_postings(frequent, part), "shingle long, set_id long, meta long")
        dealt = postings.repartition(n, "shingle").sortWithinPartitions("shingle", "meta", "set_id")
        own = stored(dealt.mapInArrow(_lists, "shingle long, a long, b long, meta long"), "lists")
        lists = own if lists is None else lists.unionAll(own)
    frequent.destroy()  # the lists are written
    pairs = lists.where("b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    groups = components(_verified(pairs, classes, texts))
    members = lists.where("b is null").select("shingle", F.col("a").alias("set_id"), "meta")
    for number in range(ROUNDS):
        tried = stored(_with_heads(_rooted(members, groups), number).join(pairs, ["a", "b"], "left_anti"), "round")
        if tried.isEmpty():
            break
        groups = _joined(groups, _verified(tried, classes, texts))
        pairs = pairs.unionAll(tried)
    # Lists that hold classes of different components still: their pairs across components.
    rows = _rooted(members, groups)
    open_ = rows.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("shingle")
    rows = stored(rows.join(open_, "shingle", "left_semi").distinct(), "open")
    x, y = (rows.select("shingle", F.col("set_id").alias(s), F.col("root").alias(f"root_{s}"), F.col("meta").alias(f"meta_{s}")) for s in "ab")
    more = stored(x.join(y, "shingle").where("root_a < root_b").where(_may_link("meta_a", "meta_b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "more")
    removed(rows)
    if not more.isEmpty():
        groups = _joined(groups, _verified(more.join(pairs, ["a", "b"], "left_anti"), classes, texts))
    of = classes.join(groups, F.col("set_id") == F.col("node"), "left").select("set_id", "doc", F.coalesce("root", "set_id").alias("root"))
    least = of.groupBy("root").agg(F.min("doc").alias("component_id"))
    of = of.join(least, "root").select("set_id", "component_id")
    out = docs.select("doc_id", "n", F.when(F.col("n") > 0, F.col("set_id")).alias("set_id")).join(of, "set_id", "left")
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without the documents that a linked one of smaller id stands for. Rows that repeat a kept id stay."""
    groups = jaccard_components(df, id_col, text_col)
    keep = groups.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("_id")).distinct()
    return df.join(keep, F.col(id_col).eqNullSafe(F.col("_id")), "left_semi")
