"""SimHash fingerprints and near-duplicate components through a segment-popcount embedding.

A 64-bit fingerprint is mapped to the bit counts of its 32 two-bit segments, a point of a 32-dimensional grid. Flipping a
bit moves the point by one step along one axis, so the Manhattan distance of two points never exceeds the Hamming
distance of their fingerprints: points more than ``radius`` apart need no look at the bits.

Range join on the grid: the axes are dealt to groups. Points within Manhattan distance ``radius`` differ in at most ``radius``
groups, so they agree in all others; every point is posted in the cell (its coordinates) of each choice of that many groups,
and a pair within the radius meets in some cell. More groups give finer cells and more of them to a point: their number is
the one that costs least for the number of distinct fingerprints (``groups_for``: ``radius`` + 3 up to some millions), so
that cells of unlike fingerprints stay small in tables of any size. Inside a cell the Manhattan bound is tested first, then
the exact Hamming distance. A cell yields a spanning forest of its links, never all its pairs.

Hot cells: a cell is worked through in blocks of BLOCK points. Blocks of one cell are dealt to different tasks as pairs of
blocks, so no task holds more than two blocks of a cell.

Defined results
* words are runs without ASCII white space after lower-casing A-Z; null and empty texts have no shingle and fingerprint
  zero, which links like any other; fewer words than ``width``: the whole sequence is the one shingle.
* copies share a fingerprint and are joined through it; a null id takes part with its fingerprint but has no component
  of its own unless another row of the component has an id. Repeated rows keep their rows; extra columns are not read.
* an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quern.llm.components import components
from quern.llm.shared import cut

SEED = 42
#: Points of a cell that one task holds at once, twice.
BLOCK = 8192
PAIRS = np.uint64(0x5555555555555555)


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """Unsigned 64-bit SimHash; a bit is 1 if it is set in more than half of the shingles' hashes."""
    words = (text or b"").lower().split()  # bytes: only A-Z is lowered, only ASCII white space splits
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(b" ".join(words), SEED)
    n = len(words) - width + 1
    shingles = map(b" ".join, zip(*(words[k:] for k in range(width))))
    # Bits are counted in blocks, so a very long text needs no more memory than its words.
    counts = np.zeros(64, dtype=np.int64)
    for start in range(0, n, 65536):
        size = min(65536, n - start)
        hashes = np.fromiter((digest(next(shingles), SEED) for _ in range(size)), dtype="<u8", count=size)
        counts += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id, mark, fp): mark is a 64-bit hash of the text, fp the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            found = np.fromiter((fingerprint(t.as_py(), width) for t in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], names=["id", "mark", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, f"id {kind}, mark long, fp long")


def segment_counts(fp: Column) -> Column:
    """The bit counts of the 32 two-bit segments, packed: segment k in bits 2k and 2k+1, as 00, 01 or 11 for 0, 1 or 2."""
    beside, odd = F.shiftrightunsigned(fp, 1), F.lit(int(PAIRS))
    return F.shiftleft(fp.bitwiseAND(beside).bitwiseAND(odd), 1).bitwiseOR(fp.bitwiseOR(beside).bitwiseAND(odd))


def _counts(v: np.ndarray) -> np.ndarray:
    """The same of an array of unsigned fingerprints."""
    beside = v >> np.uint64(1)
    return ((v & beside & PAIRS) << np.uint64(1)) | ((v | beside) & PAIRS)


def _manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of packed counts: each differing bit of these codes is one step."""
    return np.bitwise_count(a ^ b)


def _axes(groups: int) -> list[int]:
    """Masks of packed counts, one for each group of axes (axes are dealt in turn)."""
    masks = [0] * groups
    for axis in range(32):
        masks[axis % groups] |= 3 << (2 * axis)
    return masks


def groups_for(n: int, radius: int = 4) -> int:
    """The number of axis groups that costs least for n distinct fingerprints: cells of a point, times 1 and a quarter of the points that a cell of random fingerprints holds beside it (to compare two points costs some quarter of posting one)."""

    def cost(groups: int) -> float:
        agree = groups - radius
        # A two-bit segment's bit count has 1.5 bits of entropy; that a pair agrees by chance in one has odds of 3 in 8.
        return comb(groups, agree) * (1 + n / 4 * (3 / 8) ** (32 * agree / groups))

    return min(range(radius + 3, min(33, radius + 13)), key=cost)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what the links within ``left`` (or, given ``right``, across the two) join: one for each point reached."""
    points = left if right is None else np.concatenate([left, right])
    side = np.zeros(len(points), dtype=bool)
    side[len(left) :] = True
    maps = _counts(points)
    open_ = np.ones(len(points), dtype=bool)
    a, b = [], []
    for root in range(len(points)):
        if not open_[root]:
            continue
        open_[root] = False
        todo = [root]
        while todo:
            at = todo.pop()
            look = open_ if right is None else open_ & (side != side[at])
            rest = np.flatnonzero(look)
            if not len(rest):
                continue
            rest = rest[_manhattan(maps[rest], maps[at]) <= radius]
            rest = rest[np.bitwise_count(points[rest] ^ points[at]) <= radius]
            if len(rest):
                open_[rest] = False
                a.append(np.full(len(rest), points[at]))
                b.append(points[rest])
                todo.extend(rest.tolist())
    empty = np.zeros(0, dtype=np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)


def _small_cells(fp: np.ndarray, start: np.ndarray, stop: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All links within cells of a few points, over many cells at once."""
    maps, a, b = _counts(fp), [], []
    sizes = stop - start
    for step in range(1, int(sizes.max(initial=0))):
        start, stop = start[sizes > step], stop[sizes > step]
        sizes = stop - start
        n = sizes - step
        first = np.repeat(start - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        first = first[_manhattan(maps[first], maps[first + step]) <= radius]
        first = first[np.bitwise_count(fp[first] ^ fp[first + step]) <= radius]
        a.append(fp[first])
        b.append(fp[first + step])
    empty = np.zeros(0, dtype=np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)


#: Cells of up to so many points give their links pair by pair, larger ones as a forest.
SMALL = 16


def links(points: DataFrame, radius: int = 4, groups: int | None = None, most: int = BLOCK, small: int = SMALL) -> DataFrame:
    """(u, v): links between distinct fingerprints (column fp) within ``radius`` bits, enough to join each component. most: points of a cell that a task holds, twice."""
    groups = groups or radius + 3
    masks = _axes(groups)
    # A pair within the radius agrees in groups - radius groups at least.
    choices = [_signed(sum(masks[g] for g in chosen)) for chosen in combinations(range(groups), groups - radius)]
    counts = segment_counts(F.col("fp"))
    cells = points.select("fp", F.posexplode(F.array(*[counts.bitwiseAND(F.lit(m)) for m in choices])).alias("choice", "cell"))
    ordered = cells.repartition("choice", "cell").sortWithinPartitions("choice", "cell", "fp")

    def within(batches):
        """Cells in order. A cell beyond ``most`` points is passed on in numbered blocks (choice -1: a link)."""
        names = ["choice", "cell", "block", "u", "v"]

        def out(choice, cell, block, u, v):
            cols = (np.asarray(choice, dtype=np.int32), np.asarray(cell, dtype=np.int64), np.asarray(block, dtype=np.int32), u.view(np.int64), v.view(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

        def found(pair):
            n = len(pair[0])
            return out(np.full(n, -1), np.zeros(n), np.zeros(n), *pair)

        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        passed = 0  # blocks of the cell in hand that were passed on

        def settle(kind, cell, fp, last):
            """Work on whole cells; what may go on is kept."""
            nonlocal passed
            new = np.flatnonzero((np.diff(kind) != 0) | (np.diff(cell) != 0)) + 1
            edges = np.concatenate(([0], new, [len(fp)])) if len(fp) else np.zeros(1, dtype=np.int64)
            keep = edges[-2] if len(edges) > 1 and not last else len(fp)
            start, stop = edges[:-1], edges[1:]
            whole = stop <= keep
            start, stop = start[whole], stop[whole]
            if passed and len(start):  # the rest of a large cell
                yield out(kind[: stop[0]], cell[: stop[0]], np.full(stop[0], passed), fp[: stop[0]], fp[: stop[0]])
                start, stop, passed = start[1:], stop[1:], 0
            sizes = stop - start
            few = (sizes > 1) & (sizes <= small)
            yield found(_small_cells(fp, start[few], stop[few], radius))
            for s, e in zip(start[sizes > small].tolist(), stop[sizes > small].tolist()):
                yield found(_forest(fp[s:e], None, radius))
            rest = tuple(x[keep:] for x in (kind, cell, fp))
            while len(rest[2]) > most:
                n = most
                yield out(rest[0][:n], rest[1][:n], np.full(n, passed), rest[2][:n], rest[2][:n])
                passed += 1
                rest = tuple(x[n:] for x in rest)
            return rest

        for batch in batches:
            fresh = [np.asarray(batch.column(k)) for k in range(3)]
            joined = [np.concatenate([h, f.astype(h.dtype) if k < 2 else f.astype(np.int64).view(np.uint64)]) for k, (h, f) in enumerate(zip(held, fresh))]
            # A cell of up to ``most`` points stays in hand; more points than that make a further block.
            held = yield from settle(*joined, last=False)
        yield from settle(*held, last=True)

    kinds = "choice int, cell long, block int, u long, v long"
    first = cut(ordered.select("choice", "cell", "fp").mapInArrow(within, kinds))
    done = first.where("choice = -1").select("u", "v")
    blocks = first.where("choice >= 0")
    # Most inputs have no cell beyond ``most`` points; then there is nothing more to do.
    shape = blocks.groupBy("choice", "cell").agg(F.max("block").alias("top"))
    if shape.isEmpty():
        return done
    rows = blocks.join(shape, ["choice", "cell"]).select("choice", "cell", "block", "top", F.col("u").alias("fp"))
    # Block i meets every block j >= i: each pair of blocks is a group of its own, of at most two blocks.
    paired = rows.withColumn("other", F.explode(F.sequence(F.lit(0), "top"))).select(
        "choice", "cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "fp"
    )

    def across(key, frame: pa.Table) -> pa.Table:
        fp = frame["fp"].to_numpy().view(np.uint64)
        block = frame["block"].to_numpy()
        i, j = key[2].as_py(), key[3].as_py()
        u, v = _forest(fp[block == i], None if i == j else fp[block == j], radius)
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    return done.unionByName(paired.groupBy("choice", "cell", "i", "j").applyInArrow(across, "u long, v long"))


def _joined(prints: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """Distinct fingerprints (fp, least id, n rows) and, for those with links, (fp, component)."""
    distinct = cut(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    groups = groups_for(distinct.count(), radius)
    return distinct, components(links(distinct.select("fp"), radius, groups)).withColumnRenamed("node", "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """(id_col, fingerprint, component_id): one row for each row of ``docs``."""
    prints = cut(fingerprints(docs, id_col, text_col, width))
    distinct, joined = _joined(prints, radius)
    roots = distinct.join(joined, "fp").groupBy("component").agg(F.min("least").alias("root"))
    linked = joined.join(roots, "component").select("fp", "root")
    # Only fingerprints of several rows or with links need a look-up: the others are their own component.
    shared = distinct.where("n > 1").join(linked, "fp", "full_outer").select("fp", F.coalesce("root", "least").alias("root"))
    return prints.join(shared, "fp", "left").select(
        F.col("id").alias(id_col),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.coalesce("root", "id").alias("component_id"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the row with the smallest id (null ids last, then by the text's hash). Of rows alike in id and text the one whose other columns have the smallest hash stays."""
    prints = cut(fingerprints(docs, id_col, text_col, width))
    _, joined = _joined(prints, radius)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark")).alias("first")
    groups = prints.join(joined, "fp", "left").groupBy(F.coalesce("component", "fp").alias("component")).agg(first)
    stay = groups.select(F.col("first.id").alias("__id"), F.col("first.mark").alias("__mark"))
    marked = docs.withColumn("__text_mark", F.xxhash64(text_col))
    kept = marked.join(stay, marked[id_col].eqNullSafe(stay["__id"]) & (marked["__text_mark"] == stay["__mark"]), "left_semi")
    # Copies of a row are put together before the shuffle, so many of them are no load.
    row = F.struct(*[docs[c] for c in docs.columns])
    return kept.groupBy(marked[id_col].alias("__key"), "__text_mark").agg(F.min_by(row, F.xxhash64(*[docs[c] for c in docs.columns])).alias("__row")).select("__row.*")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op7_simhash": op7_simhash}
