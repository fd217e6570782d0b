"""SimHash near-duplicates: fingerprints, links by pivot distance tables, and components of the links."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import map_texts, saved, saved_only
from tracewell.llm.components import connected_components

SEED = 42
#: Bits of a fingerprint, and the blocks that they are dealt to.
BITS, BLOCKS = 64, 4
WIDTH = BITS // BLOCKS
#: Fingerprints link at this many differing bits or fewer.
MOST = 2
#: Cells with more members than this find their links by way of neighbours, not pair by pair.
CELL = 48


def words_of(text: str) -> list[bytes]:
    """Words with A-Z lower-cased. Bytes are lower-cased and split as ASCII."""
    return text.encode("utf-8", "replace").lower().split()


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 of each shingle of a text's words, repeats included; of the whole sequence where there are fewer words."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> np.uint64:
    """The bits that are set in over half of the hashes."""
    count = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 255):  # so many fit into a byte
        count += np.unpackbits(hashes[at : at + 255].astype(">u8").view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * count > len(hashes)).view(">u8")[0]


def with_fingerprint(docs: DataFrame, shingle: int, keep: list[str] | None = None) -> DataFrame:
    """docs with `fp`, the fingerprint of the whole text as a signed long. Null and empty texts have fingerprint 0."""

    def maker() -> Callable[[list[str]], dict]:
        def work(texts: list[str]) -> dict:
            return {"fp": np.array([majority(shingle_hashes(words_of(t), shingle)) for t in texts], np.uint64).view(np.int64)}

        return work

    return map_texts(docs, keep, "fp long", maker)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: Reference fingerprints: of each block so many patterns, by a fixed rule, zero outside the block.
REFERENCES = [[xxhash.xxh64_intdigest(f"block {b} reference {i}") % (1 << WIDTH) << b * WIDTH for i in range(10)] for b in range(BLOCKS)]


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def pivot_table(prints: DataFrame) -> DataFrame:
    """`prints` (fp, others) with `to_pivots`: for each block, the Hamming distances to its reference fingerprints inside the block."""
    inside = lambda b, r: distance(F.col("fp").bitwiseAND(F.lit(_signed((1 << WIDTH) - 1 << b * WIDTH))), F.lit(_signed(r))).cast("byte")
    return prints.withColumn("to_pivots", F.array(*(F.array(*(inside(b, r) for r in refs)) for b, refs in enumerate(REFERENCES))))


def may_be_near(a: Column, b: Column) -> Column:
    """Whether two pivot tables' rows leave it open that fingerprints differ in MOST bits or fewer: a block's largest difference of coordinates is a lower bound of its differing bits."""
    most = F.zip_with(a, b, lambda x, y: F.array_max(F.zip_with(x, y, lambda p, q: F.abs(p - q))))
    return F.aggregate(most, F.lit(0), lambda n, x: n + x) <= MOST


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links among the distinct fingerprints `prints` (fp) whose components are those of all pairs at MOST bits or fewer.

    Each fingerprint has a row in the pivot table: its distances to many references, block by block. Two fingerprints with at
    most two differing bits have the same distances in two of their four blocks, so each such pair meets in a cell: the fingerprints
    with the same coordinates in two given blocks. In cells of up to CELL members, a pair is discarded if the largest differences of
    its coordinates add up to more than MOST (the triangle inequality in each block), and survivors are verified by
    their own distance. In larger cells each member goes to itself and to its neighbours at one bit outside the cell's blocks:
    fingerprints that meet at a neighbour are at most two bits apart, and any two that are so meet at one; so each links to
    the smallest that it meets. That is exact, and linear in the members of a cell, of whatever size.
    """
    pairs = [(i, j) for i in range(BLOCKS) for j in range(i + 1, BLOCKS)]
    own = lambda n, i, j: F.struct(F.lit(n).cast("byte").alias("pair"), F.xxhash64(F.lit(n), F.col("to_pivots")[i], F.col("to_pivots")[j]).alias("cell"))
    cells = saved(pivot_table(prints.select("fp")).select("fp", F.inline(F.array(*(own(n, i, j) for n, (i, j) in enumerate(pairs))))), "cells")
    sizes = saved(cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1"), "cell-sizes")

    small = pivot_table(cells.join(sizes.where(F.col("n") <= CELL).select("cell"), "cell").select("fp", "cell"))
    met = small.groupBy("cell").agg(F.collect_list(F.struct("fp", "to_pivots")).alias("members"))
    both = met.select("members", F.explode("members").alias("a")).select("a", F.explode("members").alias("b")).where("a.fp > b.fp")
    near = both.where(may_be_near(F.col("a.to_pivots"), F.col("b.to_pivots"))).where(distance(F.col("a.fp"), F.col("b.fp")) <= MOST).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))

    outside = F.array(*(F.array(*(F.lit(_signed(1 << bit)) for bit in range(BITS) if bit // WIDTH not in p)) for p in pairs))
    large = cells.join(sizes.where(F.col("n") > CELL).select("cell"), "cell")
    hubs = hubs_of(large, F.element_at(outside, (F.col("pair") + 1).cast("int")), "cell")
    least = hubs.groupBy("cell", "hub").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select("cell", "hub", "b")
    through = hubs.join(least, ["cell", "hub"]).where("fp <> b").select(F.col("fp").alias("a"), "b")
    return near.unionByName(through).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def hubs_of(prints: DataFrame, bits: Column, *others: str) -> DataFrame:
    """(fp, hub, others): each fingerprint with itself and with its neighbours at one of the `bits`."""
    flipped = prints.select("fp", *others, F.explode(F.concat(F.array(F.lit(0).cast("long")), bits)).alias("bit"))
    return flipped.select("fp", *others, F.col("fp").bitwiseXOR(F.col("bit")).alias("hub"))


def degrees(found: DataFrame) -> DataFrame:
    """(fp, links): of each fingerprint in the links `found` (a, b), how many others there are at two bits or fewer.

    Any two such meet at two hubs, whether one bit apart (at both) or two (at the two between), so the others that a fingerprint meets at its hubs,
    counted hub by hub, are twice its neighbours.
    """
    nodes = found.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    hubs = hubs_of(nodes, F.array(*(F.lit(_signed(1 << bit)) for bit in range(BITS))))
    met = hubs.groupBy("hub").agg((F.count("*") - 1).alias("others")).where("others > 0")
    return hubs.join(met, "hub").groupBy("fp").agg((F.sum("others") / 2).cast("long").alias("links"))


def components(docs: DataFrame, key: str = "doc_id", shingle: int = 3) -> DataFrame:
    """(key, fp, component_id, links) for each row of `docs` (key, text).

    component_id: the smallest key that can be reached over links between fingerprints, its own included. links: how many other
    fingerprints are at MOST bits or fewer from the row's. Documents with the same fingerprint are
    copies: one fingerprint stands for them, and they are not paired. Null and empty texts have fingerprint 0 and link like
    any other. A null key is passed over when the smallest is taken. Repeated rows stay; an empty table gives no
    rows; further columns are not used.
    """
    prints = saved(with_fingerprint(docs.select(key, "text"), shingle, [key]), "prints")
    members = prints.groupBy("fp").agg(F.min(key).alias("least"))
    found = saved(links(members.select("fp")), "near")
    reached = connected_components(found).withColumnsRenamed({"node": "fp", "component": "root"})
    grouped = members.join(reached, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = grouped.select("fp", "root").join(smallest, "root").join(degrees(found), "fp", "left").select("fp", "component_id", F.coalesce("links", F.lit(0)).alias("links"))
    return prints.join(classes, "fp")


#: In cells of over CHUNK members all meet some of them first, and go pair by pair where components still differ; at once if that is DENSE pairs a member or fewer.
CHUNK, DENSE = 4, 32
#: Members of a cell that all others meet in a round; and rounds, at most, before what is left in such cells goes pair by pair.
HUBS, STARS = 4, 4
#: Documents that hold a shingle are counted in so many slots, sent in parts.
SLOTS, PART = 1 << 22, 1 << 16


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """The distinct shingle hashes of a whole text, in order."""
    return np.unique(shingle_hashes(words_of(text), shingle))


def set_id(found: np.ndarray) -> int:
    return _signed(xxhash.xxh64_intdigest(found.tobytes(), SEED))


def slot_of(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def with_set_ids(docs: DataFrame, key: str, shingle: int) -> DataFrame:
    """(key, read, id, fp, part, counts): for each row of docs a hash of its text and of its shingle set, and its fingerprint; then, with a part, counts by slot of the sets of a task."""
    rows = docs.select(key, F.coalesce("text", F.lit("")).alias("text")).withColumn("read", F.xxhash64("text"))
    fields = T.StructType([docs.schema[key], *T.StructType.fromDDL("read long, id long, fp long, part int, counts binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(SLOTS, np.uint32), set()
        for batch in batches:
            ids, prints = [], []
            for text in batch.column("text").to_pylist():
                hashes = shingle_hashes(words_of(text), shingle)
                found = np.unique(hashes)
                ids.append(set_id(found))
                prints.append(_signed(int(majority(hashes))))
                if ids[-1] not in seen:
                    seen.add(ids[-1])
                    np.add.at(total, slot_of(found), 1)
            n, none = len(ids), batch.slice(0, 0).column(key).type
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("read"), pa.array(ids, pa.int64()), pa.array(prints, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], fields.names)
        if seen:
            blobs = [zlib.compress(total[at : at + PART].tobytes(), 1) for at in range(0, SLOTS, PART)]
            n = len(blobs)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, none), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(blobs, pa.binary())], fields.names)

    return rows.mapInArrow(run, fields)


def rarity(counted: DataFrame) -> np.ndarray:
    """By slot, a level that grows with the number of sets that hold its shingles. It orders shingles; which order it is has no bearing on results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {}
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                new = np.frombuffer(zlib.decompress(blob), np.uint32).astype(np.uint64)
                totals[part] = totals[part] + new if part in totals else new
        levels = [np.rint(4 * np.log2(t + 1.0)).astype(np.uint8).tobytes() for t in totals.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array(levels, pa.binary())], ["part", "level"])

    level = np.zeros(SLOTS, np.uint8)
    for r in counted.select("part", "counts").repartition("part").mapInArrow(run, "part int, level binary").toLocalIterator():
        level[r.part * PART : (r.part + 1) * PART] = np.frombuffer(r.level, np.uint8)
    return level


def prefixes(docs: DataFrame, shingle: int, similarity: float, level: np.ndarray) -> DataFrame:
    """(cell, id, n, at): the rarest shingles of each set, so many that two sets of the similarity share one of them; n: size of the set, at: its place.

    Only cells with several sets are given.
    """
    shared = docs.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            cells, ids, sizes, places = [], [], [], []
            for text in batch.column("text").to_pylist():
                found = shingle_set(text or "", shingle)
                id_, n = set_id(found), len(found)
                if not n or id_ in seen:
                    continue
                seen.add(id_)
                most = n - int(np.ceil(similarity * n - 1e-9)) + 1
                cells.append(found[np.lexsort((found, shared.value[slot_of(found)]))[:most]].view(np.int64))
                ids.append(np.full(most, id_, np.int64))
                sizes.append(np.full(most, n, np.int32))
                places.append(np.arange(most, dtype=np.int32))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (cells, ids, sizes, places)], ["cell", "id", "n", "at"])

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows in order of cell and id, each once, those whose cell has another id."""
        held = None
        for batch in batches_and_end(batches):
            if batch is not None:
                new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "id", "n", "at")]
                held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            if held is None or not len(held[0]):
                continue
            cell, id_ = held[0], held[1]
            first = np.concatenate([[True], (cell[1:] != cell[:-1]) | (id_[1:] != id_[:-1])])
            held = [x[first] for x in held]
            cell = held[0]
            end = int(np.searchsorted(cell, cell[-1])) if batch is not None else len(cell)  # the last cell may go on
            same = cell[1:end] == cell[: max(end - 1, 0)]
            kept = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]])) if end else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([pa.array(x[:end][kept]) for x in held], ["cell", "id", "n", "at"])
            held = [x[end:] for x in held]

    schema = "cell long, id long, n int, at int"
    return docs.select("text").mapInArrow(run, schema).repartition("cell").sortWithinPartitions("cell", "id").mapInArrow(several, schema)


def batches_and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def may_link(similarity: float) -> Column:
    """Whether sets a.* and b.* that meet in a cell can have the similarity, by their sizes and by what is left of both after the places where they meet.

    At their first common shingle all that they share is left, so each pair of the similarity passes in the cell of that one.
    """
    left = F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at"))
    return (F.least("a.n", "b.n") >= similarity * F.greatest("a.n", "b.n") - 1e-6) & (left >= similarity / (1 + similarity) * (F.col("a.n") + F.col("b.n")) - 1e-6)


def early(similarity: float) -> Column:
    """Whether a set meets others so early that one of the similarity can be among those that it meets at any place.

    Of two sets a and b of the similarity that first meet at places p and q, both have at least s / (1 + s) of |a| + |b| left, so p + q is at most (1 - s) / (1 + s) of that: not both can be later than
    that part of their own size. Texts of one template that differ in more than that part are all late where they meet in the template.
    """
    return F.col("at") <= (1 - similarity) / (1 + similarity) * F.col("n") + 1e-3


def meetings(rows: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """rows twice, each with `band` and `turn`: only rows with the same cell, band and turn can be similar, a row of the first as the smaller set, and any two that can be are so once.

    A band is of sizes of one ratio of the similarity; a larger set is in its own band and the one below. By turn an early set meets early and late ones, a late set early ones only.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / -math.log(similarity) + 1e-9).cast("int")
    is_early = early(similarity)
    turns = lambda other: F.when(is_early, F.array(F.lit(0), F.lit(other))).otherwise(F.array(F.lit(3 - other)))
    a = rows.select("*", band.alias("band"), F.explode(turns(1)).alias("turn"))
    b = rows.select("*", F.explode(F.array(band, band - 1)).alias("band"), turns(2).alias("turns")).select("*", F.explode("turns").alias("turn")).drop("turns")
    return a, b


def verified(docs: DataFrame, prints: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Of the pairs (a, b) of set ids, those whose shingle sets have the Jaccard similarity."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = prints.join(wanted, "id", "left_semi").groupBy("id").agg(F.min("read").alias("read")).select("read").distinct()
    of = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("read", F.xxhash64("text")).join(texts, "read", "left_semi").dropDuplicates(["read"])

    def maker() -> Callable[[list[str]], dict]:
        def work(texts: list[str]) -> dict:
            found = [shingle_set(t, shingle) for t in texts]
            return {"id": [set_id(x) for x in found], "shingles": [x.view(np.int64) for x in found]}

        return work

    sets = saved(map_texts(of, [], "id long, shingles array<long>", maker), "sets").dropDuplicates(["id"])
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common >= similarity * (F.size("x") + F.size("y") - common) - 1e-6).select("a", "b")


def fingerprint_pairs(prints: DataFrame) -> DataFrame:
    """(a, b): set ids of `prints` (id, fp) whose fingerprints link (see links()), or are equal. The smallest id of a fingerprint stands for it."""
    sets = saved(prints.select("id", "fp").distinct(), "fingerprints")
    least = sets.groupBy("fp").agg(F.min("id").alias("least"))
    equal = sets.join(least, "fp").where("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b"))
    of = lambda end: least.select(F.col("fp").alias(f"{end}_fp"), F.col("least").alias(end))
    near = links(least.select("fp")).toDF("a_fp", "b_fp").join(of("a"), "a_fp").join(of("b"), "b_fp").select("a", "b")
    return equal.unionByName(near).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def similar(docs: DataFrame, key: str = "doc_id", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(key, component_id) for each row of `docs` (key, text): components of links between texts of a shingle similarity.

    Two texts link if the Jaccard similarity of their sets of shingles is that or more: no more and no fewer links than all pairs would
    give, up to collisions of 64-bit hashes. Rows with equal sets are copies, and one stands for them. SimHash fingerprints come first: texts whose fingerprints
    link by the pivot tables (see links()) are verified by their whole sets and joined. What is still apart then, since no threshold on fingerprints finds all pairs of a similarity, is completed: sets that can be so similar share
    one of their rarest shingles (prefix filtering), whose cells bring them together; sizes and places discard, and the whole sets verify.
    Two sets that both meet late in a cell, or differ much in size, are not brought together (see meetings()). In a cell of over CHUNK members each meets HUBS members first; members that are in one component by then need not be
    compared, and all other pairs of the cell are, after at most STARS such rounds.

    Null and empty texts have the empty set and are copies of one another. component_id is the smallest key, null keys passed over. Repeated rows stay; an empty
    table gives no rows; texts of any length are taken whole, one at a time; other columns, whatever their names, are not used.
    """
    whole = saved(with_set_ids(docs, key, shingle), "set-ids")
    prints = whole.where("part is null").select(key, "read", "id", "fp")
    members = saved(prefixes(docs, shingle, similarity, rarity(whole.where("part is not null"))), "prefixes")
    large = saved(members.groupBy("cell").agg(F.count("*").alias("size")).where(F.col("size") > CHUNK).select("cell"), "large-cells")

    def all_pairs(rows: DataFrame, *also: Column) -> DataFrame:
        ordered = (F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.id") < F.col("b.id")))
        a, b = meetings(rows, similarity)
        same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("cell", "band", "turn")]
        on = reduce(lambda x, y: x & y, [*same, ordered, may_link(similarity), *also])
        return a.alias("a").join(b.alias("b"), on).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()

    def star(rows: DataFrame, salt: int, apart: Column) -> DataFrame:
        # a member whose rarest shingles are common ones differs least from the others; and some at random
        one = F.struct("id", "n", "at", "root")
        few = [F.min_by(one, F.struct("at", F.xxhash64("id"))), *(F.min_by(one, F.xxhash64("id", F.lit(HUBS * salt + i))) for i in range(HUBS - 1))]
        hub = rows.groupBy("cell").agg(F.array_distinct(F.array(*few)).alias("hubs")).select("cell", F.inline("hubs"))
        met = rows.alias("a").join(hub.alias("b"), "cell").where(apart & may_link(similarity))
        return met.select(F.greatest("a.id", "b.id").alias("a"), F.least("a.id", "b.id").alias("b")).distinct()

    def linked(pairs: Callable[[], DataFrame]) -> DataFrame:
        return saved_only(lambda: verified(docs, prints, saved(pairs(), "pairs"), shingle, similarity), "near")

    def root_of(rows: DataFrame, node: str, reached: DataFrame) -> DataFrame:
        """rows with the component of a node in place of it; a node without links is one by itself."""
        return rows.join(reached.withColumnRenamed("id", node), node, "left").withColumn(node, F.coalesce("root", node)).drop("root")

    def grown(reached: DataFrame, met: DataFrame) -> DataFrame:
        """reached (id, root) with the links met: only components are joined on, links between them, then their members' new roots."""

        def more() -> DataFrame:
            joined = saved(connected_components(root_of(root_of(met, "a", reached), "b", reached)).toDF("id", "root"), "joined")
            moved = root_of(reached.withColumnRenamed("root", "r"), "r", joined).withColumnRenamed("r", "root")
            return moved.unionByName(joined.join(reached, "id", "left_anti"))

        return saved_only(more, "reached")

    reached = saved_only(lambda: connected_components(linked(lambda: fingerprint_pairs(prints))).toDF("id", "root"), "reached")
    placed = members.join(reached, "id", "left").withColumn("root", F.coalesce("root", "id"))
    crowded = placed.join(large, "cell", "left_semi")
    apart = F.col("a.root") != F.col("b.root")
    reached = grown(reached, linked(lambda: all_pairs(placed.join(large, "cell", "left_anti"), apart).unionByName(star(crowded, 0, apart)).distinct()))
    salt, before, last = 0, None, False
    while not last:
        known = crowded.drop("root").join(reached, "id", "left").withColumn("root", F.coalesce("root", "id"))
        # pairs still apart that can be similar: two early members, or an early and a late one
        per = known.groupBy("cell", "root").agg(F.count("*").cast("double").alias("k"), F.count_if(early(similarity)).cast("double").alias("e"))
        e, late = F.col("e"), F.col("k") - F.col("e")
        pairs = (F.sum(e) * F.sum(e) - F.sum(e * e)) / 2 + F.sum(e) * F.sum(late) - F.sum(e * late)
        per = per.groupBy("cell").agg(F.sum("k").alias("k"), pairs.alias("open")).where("open > 0")
        per = saved(per, "open-cells")
        rows, open_ = per.agg(F.sum("k"), F.sum("open")).first()
        if not rows:
            break
        crowded = saved(known.join(per.select("cell"), "cell", "left_semi").select("cell", "id", "n", "at", "root"), "open-members")
        salt += 1
        last = salt >= STARS or open_ <= DENSE * rows or (before is not None and open_ > before / 2)
        met = linked(lambda: all_pairs(crowded, apart) if last else star(crowded, salt, apart))  # noqa: B023
        reached = grown(reached, met)
        before = open_
    distinct = prints.groupBy("id").agg(F.min(key).alias("least"))
    grouped = distinct.join(reached, "id", "left").withColumn("root", F.coalesce("root", "id"))
    smallest = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.select(key, "id").join(grouped.select("id", "root").join(smallest, "root").select("id", "component_id"), "id").select(key, "component_id")


def near_dedup(docs: DataFrame, key: str = "doc_id", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of `docs`, one for each component of similar(): the row with the smallest key.

    A key stays if it is the smallest of its component. Of rows with the same key and text one stays; with
    the same key and other texts, all stay if one does. Rows with a null key stay, one for each text. Columns are those of docs, whatever
    their names; an empty table gives no rows.
    """
    stays = F.bool_or(F.col(key) == F.col("component_id")).alias("stays")
    gone = saved_only(lambda: similar(docs, key, shingle, similarity).groupBy(key).agg(stays).where(~F.col("stays")).select(key), "gone")
    return docs.join(gone, key, "left_anti").dropDuplicates([key, "text"])
