"""Best-fit packing of tokenised documents into sequences, by bin completion with branch and bound.

Documents are tokenised and closed by id 0; one longer than a sequence is cut into full pieces, the first piece taking
the remainder. Pieces are dealt to shards in turn, and each shard is packed by itself: the incumbent is
the best-fit-decreasing packing; unless it meets the lower bound, the search fills one sequence at a time around
the largest piece left, tries all undominated fillings by least waste, and drops branches whose waste shows that they
cannot beat the incumbent. Only the budget of NODES fillings a shard ends the search early; it keeps the best packing found.

Defined results: a null text is empty and packs its closing id alone. Repeated rows are packed each. An empty table gives none.
Extra columns may be carried along.
"""

from __future__ import annotations

import os
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from . import textscan

SEQUENCE, CLOSING = 2048, 0
#: Documents for each shard. A shard wastes less than one sequence more than the whole would.
SHARD_DOCS = 8192
NODES, WIDTH = 2000, 24
#: Encoded strings that a worker remembers.
MEMORY = 400_000
#: Bytes that begin white space beyond ASCII, and white space other than tab, newline, return and space: texts with them are encoded whole.
_ODD = np.zeros(256, bool)
_ODD[[11, 12, 28, 29, 30, 31, 0xC2, 0xE1, 0xE2, 0xE3]] = True
#: After a letter or digit of ASCII these begin a part too: the pre-tokeniser cuts there, and words come without their punctuation.
_MARK, _ALNUM = np.zeros(256, bool), np.zeros(256, bool)
_MARK[list(b".,;:!?)|")] = True
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 13, 32]] = True


class Encoder:
    """Encodes texts by their parts: runs of white space with the run after them, each distinct part once. The
    pre-tokeniser never joins what stands on two sides of the end of a run of non-white characters, so the parts' ids are
    the text's, and new parts are encoded as one string. Texts with other white space are encoded whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # Known parts by ascending hash, and where their ids stand in flat.
        self.hashes, self.begins, self.sizes, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def joined(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all parts, and how many each has. Each part begins with white space and ends without."""
        said = self.tokenizer.encode("".join(parts), add_special_tokens=False)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        last = np.array(said.offsets, np.int64).reshape(-1, 2)[:, 1]
        return np.array(said.ids, np.uint32), np.bincount(np.searchsorted(ends, last), minlength=len(parts))

    def ids(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text."""
        data, offsets = textscan.buffers(column)
        for first, past in textscan.groups(offsets):
            low, high = int(offsets[first]), int(offsets[past])
            view, bounds = data[low:high], offsets[first : past + 1] - low
            if past == first + 1 and high - low > 4 * textscan.GROUP and not len(_odd(view)):
                yield np.concatenate([x for a, b in textscan.pieces(data, low, high) for x in self._group(data[a:b], np.array([0, b - a]))])
            else:
                yield from self._group(view, bounds)

    def _group(self, view: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
        n, raw = len(bounds) - 1, view.tobytes()
        odd = np.zeros(n, bool)
        odd[np.searchsorted(bounds, _odd(view), "right") - 1] = True
        white = _WHITE[view]
        cut = np.zeros(len(view) + 1, bool)
        cut[1:-1] = (white[1:] & ~white[:-1]) | (_MARK[view[1:]] & _ALNUM[view[:-1]])
        cut[bounds] = True
        edges = np.flatnonzero(cut)
        starts, ends = edges[:-1], edges[1:]
        if odd.any():
            own = ~odd[np.searchsorted(bounds, starts, "right") - 1]
            starts, ends = starts[own], ends[own]
        distinct, at, back = np.unique(textscan.run_hashes(view, starts, ends), return_index=True, return_inverse=True)
        flat, begins, sizes = self._parts(distinct, starts[at], ends[at], view, raw)
        back = back.reshape(-1)
        run = sizes[back]
        ends_of = np.concatenate([[0], np.cumsum(run)])
        ids = flat[np.repeat(begins[back] - ends_of[:-1], run) + np.arange(int(ends_of[-1]))] if len(run) else flat[:0]
        of = ends_of[np.searchsorted(starts, bounds)]
        for i in range(n):
            yield self.encode([raw[bounds[i] : bounds[i + 1]].decode()])[0] if odd[i] else ids[of[i] : of[i + 1]]

    def _parts(self, distinct: np.ndarray, starts: np.ndarray, ends: np.ndarray, view: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each distinct part where its ids begin in the returned array, and how many they are."""
        place = np.searchsorted(self.hashes, distinct)
        known = np.zeros(len(distinct), bool)
        if len(self.hashes):
            known = self.hashes[np.minimum(place, len(self.hashes) - 1)] == distinct
        begins, sizes = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        begins[known], sizes[known] = self.begins[place[known]], self.sizes[place[known]]
        fresh, flat = np.flatnonzero(~known), self.flat
        if len(fresh):
            simple = _WHITE[view[starts[fresh]]] & ~_WHITE[view[ends[fresh] - 1]]
            for own, alone in ((fresh[simple], False), (fresh[~simple], True)):
                if not len(own):
                    continue
                said = [raw[a:b].decode() for a, b in zip(starts[own].tolist(), ends[own].tolist(), strict=True)]
                if alone:
                    made = self.encode(said)
                    ids, counts = np.concatenate(made), np.fromiter(map(len, made), np.int64, len(made))
                else:
                    ids, counts = self.joined(said)
                begins[own], sizes[own] = len(flat) + np.cumsum(counts) - counts, counts
                flat = np.concatenate([flat, ids])
            if len(self.hashes) + len(fresh) <= MEMORY:
                self.flat = flat
                self.hashes, self.begins, self.sizes = (np.insert(old, place[fresh], new[fresh]) for old, new in ((self.hashes, distinct), (self.begins, begins), (self.sizes, sizes)))
        return flat, begins, sizes


def _odd(view: np.ndarray) -> np.ndarray:
    """Where white space beyond ASCII, or what may be it, begins."""
    where = np.flatnonzero(_ODD[view])
    if len(where):
        # C2 begins letters too; only C2 85 and C2 A0 are white. E1, E2 and E3 are taken whole.
        after = view[np.minimum(where + 1, len(view) - 1)]
        where = where[(view[where] != 0xC2) | (after == 0x85) | (after == 0xA0)]
    return where


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PLACED = ", sequence_id long, offset long"


def _pieces(path: str, keep_ids: bool, shards: int):
    """Pieces of documents, dealt to the shards in turn from one that the task's first document tells."""
    schema = _schema(keep_ids)

    def rows_of(rows: dict[str, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, turn = Encoder(path), None
        for batch in batches:
            rows: dict[str, list] = {f.name: [] for f in schema}
            held = 0
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.ids(batch.column(1)), strict=True):
                ids = np.append(ids, np.uint32(CLOSING)).astype("<u4")
                start, piece = 0, 0
                while start < len(ids):
                    length = len(ids) if len(ids) <= SEQUENCE else (len(ids) % SEQUENCE or SEQUENCE) if not piece else SEQUENCE
                    own = ids[start : start + length]
                    crc = zlib.crc32(own.tobytes())
                    turn = crc if turn is None else turn + 1
                    for k, v in (("doc_id", doc), ("piece", piece), ("start", start), ("length", length), ("ids_crc32", crc), ("_shard", turn % shards)):
                        rows[k].append(v)
                    if keep_ids:
                        rows["ids"].append(own.astype(np.int32))
                    start, piece, held = start + length, piece + 1, held + length
                if held > 1 << 20:
                    yield rows_of(rows)
                    rows, held = {k: [] for k in rows}, 0
            if rows["doc_id"]:
                yield rows_of(rows)

    return make


def _schema(keep_ids: bool) -> pa.Schema:
    return pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.list_(pa.int32()))] if keep_ids else []), ("_shard", pa.int64())])


class _Lengths:
    """A multiset of lengths that tells its largest not above a bound."""

    def __init__(self, counts: list[int]):
        self.counts, self.mask = counts, sum(1 << i for i, c in enumerate(counts) if c)

    def below(self, most: int) -> int:
        """The largest length of at most most, or 0."""
        return max(0, (self.mask & ((2 << most) - 1)).bit_length() - 1) if most > 0 else 0

    def take(self, x: int) -> None:
        self.counts[x] -= 1
        if not self.counts[x]:
            self.mask ^= 1 << x

    def give(self, x: int) -> None:
        if not self.counts[x]:
            self.mask |= 1 << x
        self.counts[x] += 1


def lower_bound(lengths: list[int], size: int = SEQUENCE) -> int:
    """Sequences that any packing needs: by the sum, and by the pieces over k with the room they leave to those of k and more."""
    best = -(-sum(lengths) // size)
    counts = np.bincount(lengths, minlength=size + 1)
    n_above, mass = np.cumsum(counts[::-1])[::-1], np.cumsum((counts * np.arange(size + 1))[::-1])[::-1]
    above = lambda a, k: int(a[k + 1]) if k < size else 0
    for k in range(1, size // 2 + 1):
        huge = above(n_above, size - k)
        mid, mid_mass = above(n_above, size // 2) - huge, above(mass, size // 2) - above(mass, size - k)
        small = int(mass[k]) - above(mass, size // 2)
        best = max(best, huge + mid + max(0, -(-(small - (mid * size - mid_mass)) // size)))
    return best


def best_fit(lengths: list[int], size: int = SEQUENCE) -> list[list[int]]:
    """Best-fit decreasing, the incumbent to start from: each piece goes where it leaves the least room."""
    rooms, bins = _Lengths([0] * (size + 1)), []
    by_room: dict[int, list[int]] = {}
    for x in sorted(lengths, reverse=True):
        above = rooms.mask >> x
        if above:
            room = x + (above & -above).bit_length() - 1
            i = by_room[room].pop()
            rooms.take(room)
        else:
            room, i = size, len(bins)
            bins.append([])
        bins[i].append(x)
        if room > x:
            rooms.give(room - x)
            by_room.setdefault(room - x, []).append(i)
    return bins


def _dominated(filling: list[int], waste: int, left: _Lengths, room: int) -> bool:
    """Whether a piece left out could take the place of some of the filling that are no longer together (or of none), and still fit."""
    own = Counter(filling)

    def reached(without: int) -> int:
        sums = 1
        for x, n in own.items():
            for _ in range(n if x != without else 0):
                sums |= sums << x
        at = 0
        while at < waste:  # each sum up to waste higher
            step = min(at + 1, waste - at)
            sums, at = sums | sums << step, at + step
        return sums

    out = left.mask & ((2 << room) - 1)
    both = [x for x in own if left.counts[x] > own[x]]
    for x in own:
        out &= ~(1 << x)
    # A piece is no better than its equal.
    return bool(reached(0) & out) or any(reached(x) >> x & 1 for x in both)


def fillings(left: _Lengths, room: int, width: int = WIDTH) -> Iterator[tuple[int, list[int] | None]]:
    """All undominated ways to fill room, as (waste, pieces) by least waste; None for one that another dominates. left must be
    the same whenever the next is asked for. Full ones that up to width first pieces make, each with the largest
    that fits again and again, come first, as they cost least to find."""
    met, first = set(), left.below(room)
    for _ in range(width):
        if not first:
            break
        taken, rest = [first], room - first
        left.take(first)
        while rest and (x := left.below(rest)):
            left.take(x)
            taken.append(x)
            rest -= x
        for x in taken:
            left.give(x)
        if not rest:
            met.add(tuple(taken))
            yield 0, taken
        first = left.below(first - 1)
    lengths, x = [], left.below(room)
    while x:
        lengths.append(x)
        x = left.below(x - 1)
    counts = [left.counts[x] for x in lengths]
    # Bit t of reach[j]: pieces of lengths[j:] add up to t.
    reach = [1]
    for x, n in zip(reversed(lengths), reversed(counts), strict=True):
        sums, n, step = reach[-1], min(n, room // x), 1
        while n:
            step = min(step, n)
            sums, n, step = sums | sums << (step * x), n - step, 2 * step
        reach.append(sums & ((2 << room) - 1))
    reach.reverse()

    def exact(j: int, t: int) -> Iterator[list[int]]:
        if not t:
            yield []
            return
        while reach[j] >> t & 1:
            x = lengths[j]
            for n in range(min(counts[j], t // x), 0, -1):
                if reach[j + 1] >> (t - n * x) & 1:
                    for rest in exact(j + 1, t - n * x):
                        yield [x] * n + rest
            j += 1

    for waste in range(room + 1):
        if reach[0] >> (room - waste) & 1:
            for filling in exact(0, room - waste):
                if tuple(filling) not in met:
                    yield waste, None if _dominated(filling, waste, left, room) else filling


def complete(lengths: list[int], size: int = SEQUENCE, nodes: int = NODES) -> list[list[int]]:
    """The best packing found within the budget of nodes (fillings looked at, besides one for each sequence): at most as many
    sequences as best fit has, and the fewest if the budget lasts."""
    if not lengths:
        return []
    best, bound, total = best_fit(lengths, size), lower_bound(lengths, size), sum(lengths)
    left = _Lengths(np.bincount(lengths, minlength=size + 1).tolist())
    stack: list[list] = []  # the largest piece, the filling tried around it, the waste before, fillings untried
    waste, budget = 0, nodes + len(best)
    while budget > 0 and len(best) > bound:
        # A better packing has a sequence less, which tells how much it may waste in all.
        if left.mask:
            largest = left.mask.bit_length() - 1
            left.take(largest)
            stack.append([largest, [], waste, fillings(left, size - largest)])
        else:
            best = [[largest, *filling] for largest, filling, _, _ in stack]
        most = (len(best) - 1) * size - total
        while stack and budget > 0:  # to the next untried filling, here or further up
            largest, tried, before, ways = stack[-1]
            for x in tried:
                left.give(x)
            stack[-1][1] = []
            lost, chosen = next(ways, (size, None))
            budget -= 1
            if before + lost > most or lost == size:
                left.give(largest)
                stack.pop()
            elif chosen is not None:
                for x in chosen:
                    left.take(x)
                stack[-1][1], waste = chosen, before + lost
                break
        else:
            break
    return best


def _packed(pieces: pa.Table) -> pa.Table:
    places: dict[int, list[tuple[int, int]]] = {}
    lengths = pieces.column("length").to_pylist()
    for i, own in enumerate(complete(lengths)):
        at = 0
        for x in own:
            places.setdefault(x, []).append((i, at))
            at += x
    where = [places[x].pop() for x in lengths]
    base = pieces.column("_shard")[0].as_py() << 32
    out = pieces.drop_columns("_shard").append_column("sequence_id", pa.array([base + i for i, _ in where], pa.int64()))
    return out.append_column("offset", pa.array([at for _, at in where], pa.int64()))


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; with keep_ids its ids too."""
    ship(df.sparkSession)
    kinds = _PIECES + (", ids array<int>" if keep_ids else "")
    shards = max(1, -(-df.count() // shard_docs))
    pieces = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_pieces(tokenizer, keep_ids, shards), kinds + ", _shard long")
    return pieces.groupBy("_shard").applyInArrow(_packed, kinds + _PLACED)
