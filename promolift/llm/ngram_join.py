"""Near copies by the Jaccard similarity of word shingles, found with R-trees over count vectors.

Every text becomes the set of its distinct five-word shingles and a point: the number of shingles in each hash group,
with a group for about four shingles (a power of two; points of neighbouring sizes meet in the smaller number of
groups), so that unrelated texts of any length are told apart. A group's count is kept as a word of finer groups. The
overlap of two sets is at most the sum of the smaller counts, so a pair or a pair of tree boxes below the overlap that the
similarity asks for is never looked at again; what survives is bounded on the fine groups and verified on whole sets.

One tree over all points would prune nothing above its leaves: unrelated texts of one length all lie equally far
apart, so every box meets every box. The points are therefore first dealt into cells, one for each shingle among the
first ``n - ceil(0.75 n) + 1`` of a set in an order common to all sets. Two sets that link share such a cell, whatever
the order. Shingles that many texts share come last in it, rarest first, found by Misra-Gries counts over all texts
(estimates suffice: the order steers speed, never the result). Two sets share nothing before their first common shingle
in this order, so its place in a set bounds the overlap, and with it the sizes of the sets that may link through this
cell; a point without a partner of such a size leaves the cell. Cells with one least point share a tree, so that a
point's counts travel once for all of them.

No pair of texts is ever a row. A tree hands on the points that may link with any other, at most once per cell. Their
whole sets meet in one task, which verifies pairs and stops looking at a pair once it is connected, so what leaves the
task joins components and is no longer than the list of points. Equal sets are one point.

A cell of more than ``BLOCK`` points or ``BLOCK_SHINGLES`` shingles is cut into blocks by a hash. Blocks are joined with
themselves first; of large cells that still hold several components, pairs of blocks, by set size, become tasks of their
own, in which boxes and points of one component are skipped. A pair is thus left out only if a bound forbids the link or
if its ends are connected already.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promolift.llm import rtree
from promolift.llm.common import drop_paths, map_batches, slices, staged, written
from promolift.llm.components import components
from promolift.llm.shingles import mixed, shingle_sets

PERCENT = 75
SHINGLES_PER_GROUP = 4
COUNTERS = 1 << 16
FREQUENT = 32
BLOCK = 4096
BLOCK_SHINGLES = 1 << 20
SALTS = 64
FINER = 4
CELL_ROWS = 1 << 18
CELL_BYTES = 5  # of a first shingle's hash; two that share them only share a cell
FILTER_BITS = 1 << 24

_NEIGHBOURS = "low long, id long"
_MARKED = "cell string, left_block boolean, id long, component long"
_SETS = "id long, n_shingles long, set_key binary, bits binary, first binary"


def _columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(name).to_pylist() for name in names]


def group_number(size: int) -> int:
    """Coarse groups of a set: more than one for SHINGLES_PER_GROUP shingles, a power of two."""
    return 1 << max(4, (max(1, size) // SHINGLES_PER_GROUP).bit_length())


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Misra-Gries: one counter per key, then the (COUNTERS + 1)-th largest count taken from all."""
    unique, place = np.unique(keys, return_inverse=True)
    totals = np.bincount(place, weights=counts, minlength=len(unique)).astype(np.int64)
    if len(unique) > COUNTERS:
        totals -= np.partition(totals, len(totals) - COUNTERS - 1)[len(totals) - COUNTERS - 1]
    kept = totals > 0
    return unique[kept], totals[kept]


def _count_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    waiting, size = [], 0
    for batch in slices(batches):
        for found in shingle_sets(batch.column("text").to_pylist()):
            waiting.append(found)
            size += len(found)
            if size >= 1 << 20:
                fresh, seen = np.unique(np.concatenate(waiting), return_counts=True)
                keys, counts = _merged(np.concatenate((keys, fresh)), np.concatenate((counts, seen)))
                waiting, size = [], 0
    if waiting:
        fresh, seen = np.unique(np.concatenate(waiting), return_counts=True)
        keys, counts = _merged(np.concatenate((keys, fresh)), np.concatenate((counts, seen)))
    often = counts >= 2
    yield pa.RecordBatch.from_arrays([pa.array(keys[often].view(np.int64)), pa.array(counts[often])], ["key", "n"])


def frequent_shingles(texts: DataFrame) -> np.ndarray:
    """Hashes of shingles that at least about FREQUENT texts share, the COUNTERS most frequent, rarest first."""
    counted = map_batches(texts.select("text"), _count_shingles, "key long, n long")
    totals = counted.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    rows = totals.orderBy(F.desc("n"), "key").limit(COUNTERS).toArrow()
    return np.asarray(rows["key"].to_numpy())[::-1].astype(np.int64).view(np.uint64)


class _Sets:
    """Texts to sets, points and first shingles; ``frequent`` is bounded by COUNTERS."""

    def __init__(self, frequent: np.ndarray):
        order = np.argsort(frequent, kind="stable")
        self.frequent, self.rank = frequent[order], order

    def first(self, found: np.ndarray) -> np.ndarray:
        length = len(found) - -(-PERCENT * len(found) // 100) + 1
        if not len(self.frequent):
            return found[:length]
        at = np.minimum(np.searchsorted(self.frequent, found), len(self.frequent) - 1)
        often = self.frequent[at] == found
        rare = found[~often][:length]
        rest = found[often][np.argsort(self.rank[at[often]], kind="stable")]
        return np.concatenate((rare, rest[: length - len(rare)]))

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, texts = _columns(batch, "id", "text")
            keys, bits, firsts, sizes = [], [], [], []
            for found in shingle_sets(texts):
                sizes.append(len(found))
                keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                bits.append(rtree.bitmap(found, group_number(len(found))).tobytes())
                firsts.append(_planes(self.first(found), CELL_BYTES) if len(found) else b"")
            columns = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64())]
            columns += [pa.array(values, pa.binary()) for values in (keys, bits, firsts)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_shingles", "set_key", "bits", "first"])


def _planes(values: np.ndarray, width: int = 8) -> bytes:
    """The low ``width`` bytes of 64-bit values, byte by byte, so that bytes which values share compress."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _from_planes(blocks: list[bytes], width: int = 8) -> np.ndarray:
    out = [np.zeros((0, 8), np.uint8)]
    for block in blocks:
        out.append(np.zeros((len(block) // width, 8), np.uint8))
        out[-1][:, :width] = np.frombuffer(block, np.uint8).reshape(width, -1).T
    return np.concatenate(out).view(np.uint64).ravel()


def size_step(sizes: np.ndarray) -> np.ndarray:
    """Sizes in steps of a sixteenth of a power of two, in order; the last step holds all sizes from 2^16 on."""
    return np.minimum(16 * np.log2(np.maximum(sizes, 1)), 255).astype(np.uint8)


def largest_partner(sizes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The largest size of a set that may link, if the first common shingle has ``places`` shingles before it: the overlap
    is at most what is left."""
    return (100 + PERCENT) * (sizes - places) // PERCENT - sizes


class _Deal:
    """First shingles to blocks, one row per part and batch: shingles, owners, and the steps of the owner's size and of
    its largest partner's."""

    def __init__(self, parts: int):
        self.parts = parts

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, firsts = _columns(batch, "id", "n_shingles", "first")
            lengths = np.array([len(first) // CELL_BYTES for first in firsts], np.int64)
            cells = _from_planes(firsts, CELL_BYTES)
            places = np.arange(len(cells)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            owners, totals = np.repeat(np.array(ids, np.int64), lengths), np.repeat(np.array(sizes, np.int64), lengths)
            own, most = size_step(totals), size_step(largest_partner(totals, places))
            part = (mixed(cells) % np.uint64(self.parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            part, cells, owners, own, most = part[order], cells[order], owners[order], own[order], most[order]
            starts = np.flatnonzero(np.diff(part, prepend=-1))
            cuts = list(zip(starts, np.append(starts[1:], len(part))))
            columns = [pa.array(part[starts])]
            columns += [
                pa.array(values, pa.binary())
                for values in (
                    [_planes(cells[a:b], CELL_BYTES) for a, b in cuts],
                    [_planes(owners[a:b]) for a, b in cuts],
                    [own[a:b].tobytes() for a, b in cuts],
                    [most[a:b].tobytes() for a, b in cuts],
                )
            ]
            yield pa.RecordBatch.from_arrays(columns, ["part", "cells", "owners", "sizes", "partners"])


def _range_maxima(values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The largest value of each range, -1 if it is empty."""
    out = np.full(len(starts), -1, np.int64)
    level, width = values, 1
    while width <= len(values):
        at = np.flatnonzero((stops - starts >= width) & (stops - starts < 2 * width))
        out[at] = np.maximum(level[starts[at]], level[stops[at] - width])
        level, width = np.maximum(level[:-width], level[width:]), 2 * width
    return out


def partnered(cells: np.ndarray, sizes: np.ndarray, partners: np.ndarray) -> np.ndarray:
    """Which entries have another one in their cell so that neither's size is above the other's largest partner.

    Entries of one cell, size and partner are one, so a cell of very many rows is as short as there are steps.
    """
    number = np.unique(cells, return_inverse=True)[1].astype(np.int64)
    key, place, count = np.unique((number << 16) | (sizes.astype(np.int64) << 8) | partners, return_inverse=True, return_counts=True)
    size, partner = (key >> 8) & 255, key & 255
    at = np.arange(len(key))
    start = np.searchsorted(key, key >> 16 << 16)
    stop = np.searchsorted(key, (key >> 16 << 16) + ((partner + 1) << 8))
    most = partner.astype(np.int16)
    before = _range_maxima(most, start, np.minimum(stop, at))
    after = _range_maxima(most, at + 1, np.maximum(stop, at + 1))
    found = (np.maximum(before, after) >= size) | ((count > 1) & (partner >= size))
    return found[place]


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of one task to (low, id): the points of each cell that have a partner there, beside the cell's least one."""
    blocks: dict[str, list[bytes]] = {"cells": [], "owners": [], "sizes": [], "partners": []}
    for batch in batches:
        for name, values in blocks.items():
            values += batch.column(name).to_pylist()
    cells, owners = _from_planes(blocks["cells"], CELL_BYTES), _from_planes(blocks["owners"]).view(np.int64)
    sizes, partners = (np.frombuffer(b"".join(blocks[name]), np.uint8) for name in ("sizes", "partners"))
    chosen = partnered(cells, sizes, partners)
    cells, owners = cells[chosen], owners[chosen]
    order = np.lexsort((owners, cells))
    cells, owners = cells[order], owners[order]
    starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]][: len(cells)])
    first = np.repeat(starts, np.diff(np.append(starts, len(cells))))
    rows = owners != owners[first]
    lows, owners = owners[first][rows], owners[rows]
    order = np.lexsort((owners, lows))
    lows, owners = lows[order], owners[order]
    fresh = np.r_[True, (lows[1:] != lows[:-1]) | (owners[1:] != owners[:-1])][: len(lows)]
    lows, owners = lows[fresh], owners[fresh]
    for start in range(0, len(lows), 1 << 16):
        part = [pa.array(values[start : start + (1 << 16)]) for values in (lows, owners)]
        yield pa.RecordBatch.from_arrays(part, ["low", "id"])


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by cell, a table for each cell."""
    cell, waiting = None, []
    for batch in batches:
        names = batch.column("cell").to_pylist()
        cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
        for start, stop in zip(cuts, cuts[1:]):
            if waiting and names[start] != cell:
                yield pa.Table.from_batches(waiting)
                waiting = []
            cell = names[start]
            if stop > start:
                waiting.append(batch.slice(start, stop - start))
    if waiting:
        yield pa.Table.from_batches(waiting)


def _sides(rows: pa.Table) -> np.ndarray:
    """1 and 2 for the two blocks of a cell, 0 where the cell is one block."""
    return np.array([0 if side is None else 2 - side for side in rows["left_block"].to_pylist()], np.int8)


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell, with bitmaps and components, to those points that the cell's trees let through."""
    for rows in _by_cell(batches):
        labels = rows["component"].to_numpy()
        if (labels == labels[0]).all():
            continue
        sizes, sides, bits = rows["n_shingles"].to_numpy(), _sides(rows), rows["bits"].to_pylist()
        widths = np.array([len(value) // 2 for value in bits])
        meets = np.zeros(len(sizes), bool)
        own, other = (0, 0) if not sides.any() else (1, 2)
        for width in np.unique(widths).tolist():
            # Points of one width meet, and they meet those of twice the width, on either side.
            for one, two, wide in {(own, other, width), (own, other, 2 * width), (other, own, 2 * width)}:
                left = np.flatnonzero((widths == width) & (sides == one))
                right = np.flatnonzero((widths == wide) & (sides == two))
                if not len(left) or not len(right):
                    continue
                points = []
                for at in (left, right):
                    words = np.frombuffer(b"".join([bits[k] for k in at]), np.uint16).reshape(len(at), -1)
                    points.append(rtree.Points(sizes[at], labels[at], rtree.folded(words, width)))
                alone = one == two and wide == width
                found = rtree.meeting(points[0], None if alone else points[1], PERCENT)
                meets[left[found[0]]] = True
                meets[right[found[1]]] = True
        chosen = rows.filter(pa.array(meets)).select(["cell", "left_block", "id", "component"])
        yield from chosen.combine_chunks().to_batches()


class SpanningLinks:
    """Links between sets that join their components, verified on whole sets; pairs connected by then are left out.

    Pairs are bounded before by FINER times as many groups as travelled with the points. ``sides`` are those of
    ``_sides``: with two blocks only pairs between them count.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, sides: np.ndarray, sets: list[np.ndarray]):
        self.ids, self.sides, self.sets = ids, sides, sets
        self.component = np.unique(labels, return_inverse=True)[1]
        self.sizes = np.array([len(found) for found in sets], np.int64)
        self.widths = np.array([group_number(len(found)) for found in sets])
        self.verified = 0

    def find(self) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for width in np.unique(self.widths).tolist():
            at = np.flatnonzero((self.widths == width) | (self.widths == 2 * width))
            words = np.stack([rtree.bitmap(self.sets[k], FINER * width) for k in at])
            spare = self.sizes[at] - np.bitwise_count(words).sum(1, dtype=np.int64)
            for place in np.flatnonzero(self.widths[at] == width).tolist():
                out += self._with(place, at, words, spare, width)
        return out

    def _with(self, place: int, at: np.ndarray, words: np.ndarray, spare: np.ndarray, width: int) -> Iterator[tuple[int, int]]:
        """Links of one set with later ones of its width and with all of twice the width, the likeliest first."""
        own = at[place]
        others = (self.component[at] != self.component[own]) & ((self.widths[at] > width) | (np.arange(len(at)) > place))
        if self.sides.any():
            others &= self.sides[at] != self.sides[own]
        near = np.flatnonzero(others)
        near = near[rtree.enough(np.minimum(self.sizes[at[near]], self.sizes[own]), self.sizes[own], self.sizes[at[near]], PERCENT)]
        shared = np.bitwise_count(words[near] & words[place]).sum(1, dtype=np.int64)
        bound = shared + np.minimum(spare[near], spare[place])
        kept = rtree.enough(bound, self.sizes[own], self.sizes[at[near]], PERCENT)
        for other in at[near[kept][np.argsort(-bound[kept], kind="stable")]].tolist():
            if self.component[other] != self.component[own]:
                self.verified += 1
                if _links(self.sets[own], self.sets[other]):
                    self.component[self.component == self.component[other]] = self.component[own]
                    yield int(self.ids[own]), int(self.ids[other])


class _Chosen:
    """Whole sets of the texts whose id may be in a bitmap of FILTER_BITS bits."""

    def __init__(self, bitmap: np.ndarray):
        self.bitmap = bitmap

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("bit").to_numpy()
            chosen = batch.filter(pa.array((self.bitmap[at >> 3] >> (at & 7)) & 1 == 1))
            for part in slices([chosen], 128):
                ids, texts = _columns(part, "id", "text")
                found = [values.tobytes() for values in shingle_sets(texts)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary())], ["id", "shingles"])


def _bit(column: str):
    return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))


def _bitmap(ids: DataFrame) -> np.ndarray:
    """One bit per hash of an id, FILTER_BITS bits for any number of ids; a collision only costs a needless set."""
    bit = _bit("id")
    rows = (
        ids.select((bit + 1).alias("bit"))  # these functions count from 1
        .groupBy(F.bitmap_bucket_number("bit").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
        .collect()
    )
    bitmap = np.zeros(FILTER_BITS // 8, np.uint8)
    for bucket, bits in rows:
        start = (bucket - 1) * len(bits)
        bitmap[start : start + len(bits)] = np.frombuffer(bits, np.uint8)
    return bitmap


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole sets sorted by cell to the links (a, b) that join components."""
    for rows in _by_cell(batches):
        sets = [np.frombuffer(found, np.uint64) for found in rows["shingles"].to_pylist()]
        links = SpanningLinks(rows["id"].to_numpy(), rows["component"].to_numpy(), _sides(rows), sets).find()
        columns = [pa.array(values, pa.int64()) for values in (zip(*links) if links else ((), ()))]
        yield pa.RecordBatch.from_arrays(columns, ["a", "b"])


def _links(x: np.ndarray, y: np.ndarray) -> bool:
    if not len(x) or not len(y) or 100 * min(len(x), len(y)) < PERCENT * max(len(x), len(y)):
        return False
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    at = np.searchsorted(large, small)
    shared = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * shared >= PERCENT * (len(x) + len(y) - shared)


def _verify(marked: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between the marked points (cell, left_block, id, component) of each cell, verified on whole sets."""
    marked = staged(marked, "marked")
    ids = marked.select("id").distinct()
    candidates = texts.select("id", "text", _bit("id").alias("bit"))
    chosen = map_batches(candidates, _Chosen(_bitmap(ids)), "id long, shingles binary")
    dealt = marked.join(chosen, "id").repartition("cell").sortWithinPartitions("cell")
    return staged(map_batches(dealt, _verified, "a long, b long"), "verified")


def near_copies(frame: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``frame``: the id, ``n_shingles`` and ``component_id``, the least id reachable by links.

    Null, empty and blank texts have no shingles and link with nothing. A row with a null id links with nothing and has
    a null component. Rows that repeat an id are one node: its texts link it to everything that any of them links to.
    Other columns, whatever their names, are not read. An empty table gives an empty result.
    """
    spark = frame.sparkSession
    texts = frame.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    frequent = frequent_shingles(texts)
    sets, sets_path = written(map_batches(texts, _Sets(frequent), _SETS), "shingles", compression="zstd")
    points = staged(
        sets.where("id is not null and n_shingles > 0")
        .groupBy("set_key")
        .agg(F.min("id").alias("id"), *(F.first(name).alias(name) for name in ("n_shingles", "bits", "first"))),
        "points",
        compression="zstd",
    )
    members = staged(_members(sets, points), "members")
    drop_paths(spark, [sets_path])
    total = points.agg(F.sum(F.length("first") / CELL_BYTES)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / CELL_ROWS))
    first = points.select("id", "n_shingles", "first")
    dealt = map_batches(first, _Deal(parts), "part long, cells binary, owners binary, sizes binary, partners binary")
    found = map_batches(dealt.repartition(parts, "part"), _neighbours, _NEIGHBOURS)
    neighbours = staged(found.distinct(), "neighbours")
    vectors = points.select("id", "n_shingles", "bits")
    same = _repeated_ids(members)
    cells = staged(_cell_members(neighbours, vectors), "cells")
    links = _verify(_blockwise(cells, vectors), texts).union(same)
    groups = staged(components(links), "groups")
    if not cells.where("blocks > 1").isEmpty():
        links = links.union(_verify(_across_blocks(cells, vectors, groups), texts))
        groups = staged(components(links), "groups")
    return _labelled(members, groups)


def keep_least(frame: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``frame`` that stay, with all their columns: of each component the rows with its least id.

    Rows with a null id stay, and so do rows that link with nothing.
    """
    found = near_copies(frame, id_column, text_column)
    leaves = found.where("component_id < id").select(F.col("id").alias("_leaves")).distinct()
    return frame.join(leaves, frame[id_column] == leaves["_leaves"], "left_anti")


def _members(sets: DataFrame, points: DataFrame) -> DataFrame:
    """Every row of ``sets`` with ``point``, the least id that has an equal set; null without shingles or id."""
    keys = points.select("set_key", F.col("id").alias("point"))
    matched = F.when(F.col("id").isNotNull() & (F.col("n_shingles") > 0), F.col("point")).alias("point")
    return sets.select("id", "n_shingles", "set_key").join(keys, "set_key", "left").select("id", "n_shingles", matched)


def _repeated_ids(members: DataFrame) -> DataFrame:
    """Links between the points of one id that has several texts."""
    several = members.groupBy("id").agg(F.min("point").alias("a"), F.max("point").alias("most")).where("a < most")
    return members.join(several, "id").where("point <> a").select("a", F.col("point").alias("b")).distinct()


def _cell_members(neighbours: DataFrame, vectors: DataFrame) -> DataFrame:
    """(low, id, blocks): the points of the cells that share a least point, itself included, and into how many blocks
    they are cut, so that a block holds at most about BLOCK points and BLOCK_SHINGLES shingles.

    Only the few large cells are joined back for that, and a cell's rows are dealt over SALTS tasks. Of the others, points
    stay whose cell has another one of their size class or a neighbouring one, since no other sizes link.
    """
    points = neighbours.select("low", "id")
    members = points.union(points.select("low", F.col("low").alias("id")).distinct())
    size = F.floor(F.log("n_shingles") / math.log(100 / PERCENT) + 1e-9).cast("long").alias("size")
    sized = staged(members.join(vectors.select("id", "n_shingles", size), "id"), "sized")
    by_class = staged(
        sized.groupBy("low", "size").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles")), "classes"
    )
    needed = F.ceil(F.greatest(F.sum("n") / BLOCK, F.sum("shingles") / BLOCK_SHINGLES))
    large = by_class.groupBy("low").agg(needed.alias("blocks")).where("blocks > 1")
    salted = large.select("low", "blocks", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = F.pmod(F.hash("id"), F.lit(SALTS)).alias("salt")
    found = sized.select("low", "id", "size", salt).join(salted, ["low", "salt"], "left")
    classes = Window.partitionBy("low").orderBy("size")
    near = (F.col("n") > 1) | (F.col("size") - F.lag("size").over(classes) == 1) | (F.lead("size").over(classes) - F.col("size") == 1)
    kept = by_class.select("low", "size", near.alias("near")).where("near").select("low", "size")
    small = found.where("blocks is null").join(kept, ["low", "size"], "left_semi")
    return small.select("low", "id", F.lit(1).cast("long").alias("blocks")).union(
        found.where("blocks is not null").select("low", "id", "blocks")
    )


def _blockwise(cells: DataFrame, vectors: DataFrame) -> DataFrame:
    """What the trees let through inside each block; every point is once in each of its cells."""
    block = F.pmod(F.xxhash64("id", "low"), F.col("blocks"))
    rows = cells.select("id", F.concat_ws(":", "low", block.cast("string")).alias("cell")).join(vectors, "id")
    rows = rows.select("cell", F.lit(None).cast("boolean").alias("left_block"), "id", "n_shingles", "bits", F.col("id").alias("component"))
    return map_batches(rows.repartition("cell").sortWithinPartitions("cell"), _meeting, _MARKED)


def _across_blocks(cells: DataFrame, vectors: DataFrame, groups: DataFrame) -> DataFrame:
    """What the trees of several blocks let through between points that are not connected yet."""
    known = vectors.join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn(
        "component", F.coalesce("component", "id")
    )
    several = cells.where("blocks > 1")
    open_ = (
        several.join(known.select("id", "component"), "id")
        .groupBy("low")
        .agg(F.min("component").alias("least"), F.max("component").alias("most"))
        .where("least <> most")
        .select("low", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    salted = several.withColumn("salt", F.pmod(F.hash("id"), F.lit(SALTS))).join(open_, ["low", "salt"], "left_semi")
    rows = _blocks(salted.join(known, "id")).repartition("cell").sortWithinPartitions("cell")
    return map_batches(rows, _meeting, _MARKED)


def _blocks(rows: DataFrame) -> DataFrame:
    """Give every row the cells it is compared in.

    Blocks are cut by size class, of which only neighbours can link, and by a hash; each pair of blocks is a cell of its
    own.
    """
    block = F.pmod(F.xxhash64("id"), F.col("blocks"))
    size = F.floor(F.log("n_shingles") / math.log(100 / PERCENT) + 1e-9).cast("long")
    pair = lambda lower, first, second: F.concat_ws(":", "low", lower.cast("string"), first.cast("string"), second.cast("string"))
    everyone = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    cell = lambda name, side: F.struct(name.alias("cell"), side.cast("boolean").alias("left_block"))
    within = F.transform(
        everyone,
        lambda other: cell(
            pair(size, F.least(block, other), F.greatest(block, other)),
            F.when(block != other, block < other),
        ),
    )
    above = F.transform(everyone, lambda other: cell(F.concat(F.lit("+"), pair(size, block, other)), F.lit(True)))
    below = F.transform(everyone, lambda other: cell(F.concat(F.lit("+"), pair(size - 1, other, block)), F.lit(False)))
    named = rows.withColumn("_cell", F.explode(F.concat(within, above, below)))
    return named.select("_cell.cell", "_cell.left_block", "id", "n_shingles", "bits", "component")


def _labelled(members: DataFrame, groups: DataFrame) -> DataFrame:
    found = members.join(groups.withColumnRenamed("node", "point"), "point", "left")
    return found.select("id", "n_shingles", F.coalesce("component", "point", "id").alias("component_id"))
