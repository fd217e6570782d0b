"""Exact substring dedup: bytes covered by a string of LENGTH bytes that also starts elsewhere are found and removed.

Suffixes are sorted at anchors. Each window of LENGTH bytes has an anchor, the position in it whose PREFIX bytes have the
smallest hash, so equal windows have equal anchors at the same offset. About one position in sixty is an anchor. Windows
of one text with the same anchor form a run, and the bytes under a run are its context.

1. Anchors are counted by the hash of their prefix; those with a prefix of their own are out.
2. Runs whose whole context occurs again are removed as they stand. Contexts meet by a 64-bit hash; that they are the same is found by comparing bytes inside a batch, and between batches by a cryptographic
   digest of the bytes, read again. Where hashes deceived, the digests take their place.
3. Of the others, each distinct context of a prefix (a class) has its anchor's suffix sorted among those of the prefix (see
   suffix_sort). Where two suffixes have the bytes of a window in common, on from their anchors and before them, it is verified and removed.
4. A prefix of over HOT classes is dealt by further bytes first: its windows are parted by their offset to the anchor, and those of a
   part lie together by the bytes that all windows of the part hold; parts that are still hot are parted again, down to one window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import PART_BYTES, saved, saved_only, slices
from tracewell.llm.suffix_sort import Suffixes

LENGTH = 200
PREFIX = 72
#: Prefixes with more classes than this are dealt by further bytes before they are sorted; a part of its windows has a PARTS-th of them.
HOT, PARTS = 8192, 4
#: Suffixes that are sorted at once, about.
BATCH = 2048
#: Bytes that are worked on at once; positions in them have POSITION_BITS.
SLICE_BYTES, POSITION_BITS = 1 << 18, 21
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
VALUES = np.array([xxhash.xxh64_intdigest(bytes([b]), 11) for b in range(256)], np.uint64)
#: Bits of a context's hash that count; tests take few of them, so that hashes collide.
CONTEXT_MASK = -1
#: A row of a table, by two hashes.
ROW = ["row", "also"]


def digest(raw: bytes, windows: int, anchor: int) -> bytes:
    """128 bits of SHA-256 of a context and its place."""
    return hashlib.sha256(b"%d %d " % (windows, anchor) + raw).digest()[:16]


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse (mod 2^64), for the bytes of a slice."""
    n = SLICE_BYTES + 2 * LENGTH
    power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, BASE)]))
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    return power, np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, inverse)]))


class Anchors:
    """Finds the runs of texts; made once in each task."""

    def __init__(self) -> None:
        self.power, self.inverse = _tables()

    def pieces(self, texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
        """Lists of (text, offset, bytes) of about SLICE_BYTES. Longer texts come in pieces that overlap by a window less one byte."""
        held, size = [], 0
        for i, t in enumerate(texts):
            for at in range(0, max(1, len(t) - LENGTH + 1), SLICE_BYTES):
                piece = t[at : at + SLICE_BYTES + LENGTH - 1]
                if len(piece) < LENGTH:
                    continue
                if held and size + len(piece) > SLICE_BYTES + LENGTH:
                    yield held
                    held, size = [], 0
                held.append((i, at, piece))
                size += len(piece)
        if held:
            yield held

    def runs(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        """Of each run: text, prefix hash, context hash, first window `at`, number of windows, and offset of the anchor in it."""
        found = [self.piece_runs(p) for p in self.pieces(texts)]
        names = ("text", "prefix", "context", "at", "windows", "anchor")
        return {n: np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k, n in enumerate(names)}

    def piece_runs(self, pieces: list[tuple[int, int, bytes]]) -> list[np.ndarray]:
        joined = b"".join(p[2] for p in pieces)
        raw, n = np.frombuffer(joined, np.uint8), len(joined)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(VALUES[raw] * self.power[:n], out=sums[1:])
        h = (sums[PREFIX:] - sums[:-PREFIX]) * self.inverse[: n - PREFIX + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        low = np.uint64((1 << POSITION_BITS) - 1)
        v = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        w = LENGTH - PREFIX + 1  # prefixes of a window
        m = -(-len(v) // w) * w
        blocks = np.concatenate([v, np.full(m - len(v), ~np.uint64(0))]).reshape(-1, w)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        count = n - LENGTH + 1
        anchor = (np.minimum(behind[:count], ahead[w - 1 : w - 1 + count]) & low).astype(np.int64)
        sizes = np.array([len(p[2]) for p in pieces])
        ends = np.cumsum(sizes)
        fits = np.zeros(n + 1, np.int32)  # windows inside one text
        np.add.at(fits, ends - sizes, 1)
        np.add.at(fits, ends - LENGTH + 1, -1)
        fits = np.cumsum(fits)[:count] > 0
        change = np.ones(count, bool)
        change[1:] = (anchor[1:] != anchor[:-1]) | (fits[1:] != fits[:-1])
        at = np.flatnonzero(change)
        windows = np.diff(np.append(at, count))
        good = fits[at]
        at, windows = at[good], windows[good]
        text = np.searchsorted(ends, at, side="right")
        digest = xxhash.xxh3_64_intdigest
        context = np.array([digest(joined[a : a + k + LENGTH - 1]) for a, k in zip(at.tolist(), windows.tolist(), strict=True)], np.uint64)
        offset = np.array([p[1] for p in pieces]) - (ends - sizes)
        of = np.array([p[0] for p in pieces])
        return [of[text], h[anchor[at]].view(np.int64), context.view(np.int64), at + offset[text], windows, anchor[at] - at]


def merged(text: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges, in order of text and start, with those of a text that touch or overlap made one."""
    order = np.lexsort((start, text))
    text, start, stop = text[order], start[order].astype(np.int64), stop[order].astype(np.int64)
    shift = np.concatenate([[0], np.cumsum(text[1:] != text[:-1])]) * (1 << 40) if len(text) else start
    ends = np.maximum.accumulate(stop + shift)
    new = np.concatenate([[True], (start + shift)[1:] > ends[:-1]]) if len(text) else np.zeros(0, bool)
    return text[new], start[new], (ends - shift)[np.append(np.flatnonzero(new)[1:], len(text)) - 1] if len(text) else start


def anchors(rows: DataFrame) -> DataFrame:
    """Of all runs of `rows` (row, also, text): (row, also, n, prefix, context, at, windows, anchor).

    Runs that are equal inside a batch, byte by byte, are settled there: one of them stands for them with n = 2, and what they cover is
    given in ranges, with n = 0, the start as `at`, and the length as `windows`.
    """
    schema = pa.schema([("row", pa.int64()), ("also", pa.int32()), ("n", pa.int8()), ("prefix", pa.int64()), ("context", pa.int64()), ("at", pa.int32()), ("windows", pa.int32()), ("anchor", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Anchors()
        for batch in batches:
            raw = [(t or "").encode("utf-8", "replace") for t in batch.column("text").to_pylist()]
            f = find.runs(raw)
            f["context"] = f["context"] & CONTEXT_MASK
            row, also = (batch.column(c).to_numpy() for c in ROW)
            order = np.lexsort((f["anchor"], f["windows"], f["context"], f["prefix"]))
            same = np.ones(max(len(order) - 1, 0), bool)
            for c in ("prefix", "context", "windows", "anchor"):
                same &= f[c][order[1:]] == f[c][order[:-1]]
            own = lambda k: raw[f["text"][k]][f["at"][k] : f["at"][k] + f["windows"][k] + LENGTH - 1]
            for i in np.flatnonzero(same).tolist():
                same[i] = own(order[i]) == own(order[i + 1])
            after, before = np.append(same, False)[: len(order)], np.append(False, same)[: len(order)]
            n = np.where(after, 2, 1)[~before]
            one, again = order[~before], order[after | before]
            text, start, stop = merged(f["text"][again], f["at"][again], f["at"][again] + f["windows"][again] + LENGTH - 1)
            none = np.zeros(len(text), np.int64)
            columns = [np.append(row[f["text"][one]], row[text]), np.append(also[f["text"][one]], also[text]), np.append(n, none)]
            columns += [np.append(f[c][one], x) for c, x in (("prefix", none), ("context", none), ("at", start), ("windows", stop - start), ("anchor", none))]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(t.to_pandas_dtype()), t) for c, t in zip(columns, schema.types, strict=True)], schema.names)

    return rows.mapInArrow(run, "row long, also int, n byte, prefix long, context long, at int, windows int, anchor int")


#: What is sorted: one context of each class, how often it occurs, and how many classes its prefix has.
CLASSES = "prefix long, n long, row long, also int, at int, anchor int, classes long, bytes binary"
PARTED = "prefix long, context binary, n long, row long, also int, at int, anchor int, bytes binary"


def sorted_matches(classes: DataFrame) -> DataFrame:
    """(row, also, start, length): what is removed of `classes` (CLASSES) that occur once, dealt by prefix, which is of HOT classes at most."""
    names = ["prefix", "n", "row", "also", "at", "anchor", "bytes"]

    def settle(held: pa.Table) -> pa.RecordBatch:
        prefix, n, row, also, at, anchor = (held.column(c).to_numpy() for c in names[:-1])
        first, last = Suffixes(held.column("bytes").to_pylist(), anchor, LENGTH - PREFIX, LENGTH).repeats(prefix, LENGTH)
        out = np.flatnonzero((n == 1) & (first < 1))
        start = (at + anchor)[out] + first[out]
        return pa.RecordBatch.from_arrays([pa.array(row[out]), pa.array(also[out]), pa.array(start.astype(np.int32)), pa.array((last - first + LENGTH)[out].astype(np.int32))], [*ROW, "start", "length"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= BATCH:
                table = pa.Table.from_batches(held)
                prefix = table.column("prefix").to_numpy()
                whole = int(np.flatnonzero(prefix == prefix[-1])[0])  # the last prefix may go on
                for a, b in portions(prefix[:whole]):
                    yield settle(table.slice(a, b - a))
                held = table.slice(whole).to_batches()
        if held:
            table = pa.Table.from_batches(held)
            for a, b in portions(table.column("prefix").to_numpy()):
                yield settle(table.slice(a, b - a))

    dealt = classes.select(*names).repartition("prefix").sortWithinPartitions("prefix")
    return dealt.mapInArrow(run, "row long, also int, start int, length int")


def portions(group: np.ndarray) -> Iterator[tuple[int, int]]:
    """Parts of whole groups, of about BATCH rows."""
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, int)
    at = 0
    while at < len(group):
        later = starts[np.searchsorted(starts, at + BATCH) :]
        stop = int(later[0]) if len(later) else len(group)
        yield at, stop
        at = stop


def parted(classes: DataFrame, width: int) -> DataFrame:
    """(PARTED): the windows of `classes` (CLASSES) in parts of `width` offsets to the anchor: prefix is a hash of the bytes that all windows of a part hold, context a digest of what they cover."""
    schema = pa.schema([("prefix", pa.int64()), ("context", pa.binary()), ("n", pa.int64()), ("row", pa.int64()), ("also", pa.int32()), ("at", pa.int32()), ("anchor", pa.int32()), ("bytes", pa.binary())])
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for prefix, n, row, also, at, anchor, raw in zip(*(batch.column(c).to_pylist() for c in ("prefix", "n", "row", "also", "at", "anchor", "bytes")), strict=True):
                seed = prefix & (1 << 64) - 1
                for top in range(0, PREFIX - LENGTH - 1, -width):
                    low, high = max(top - width + 1, -anchor), min(top, len(raw) - LENGTH - anchor)
                    if low <= high:
                        core = xxhash.xxh3_64_intdigest(raw[anchor + top : anchor + top - width + 1 + LENGTH] + top.to_bytes(2, "big", signed=True), seed)
                        own = raw[anchor + low : anchor + high + LENGTH]
                        out.append((signed(core), digest(own, high - low + 1, -low), n, row, also, at + anchor + low, -low, own))
            columns = list(zip(*out, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema.names)

    return classes.mapInArrow(run, PARTED)


def settled(classes: DataFrame) -> DataFrame:
    """(row, also, start, length): as sorted_matches(), for prefixes of any number of classes."""
    found, width = sorted_matches(classes.where(F.col("classes") <= HOT)), LENGTH - PREFIX + 1
    hot = classes.where(F.col("classes") > HOT)
    while width > 1 and not hot.isEmpty():
        width = -(-width // PARTS)
        parts = saved(parted(hot, width), "parts")
        same = parts.groupBy("prefix", "context").agg(F.sum("n").alias("n"), *(F.min(c).alias(c) for c in (*ROW, "at", "anchor")), F.first("bytes").alias("bytes"))
        same = saved(same, "part-classes")
        again = parts.where("n = 1").join(same.where("n > 1").select("prefix", "context"), ["prefix", "context"])
        found = found.unionByName(again.select(*ROW, F.col("at").alias("start"), F.octet_length("bytes").alias("length")))
        classes = saved(open_(same).drop("context"), "contexts")
        found = found.unionByName(sorted_matches(classes.where(F.col("classes") <= HOT)))
        hot = classes.where(F.col("classes") > HOT)
    return found


def open_(classes: DataFrame) -> DataFrame:
    """`classes` (prefix, n, others) of prefixes that have several, one of them occurring once; with their number."""
    sizes = classes.groupBy("prefix").agg(F.count("*").alias("classes"), F.min("n").alias("least")).where("classes > 1 and least = 1")
    return classes.join(sizes.select("prefix", "classes"), "prefix")


def covers(runs: DataFrame) -> DataFrame:
    return runs.select(*ROW, F.col("at").alias("start"), (F.col("windows") + LENGTH - 1).alias("length"))


def matches(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """All (row, also, start, length) to remove of `runs` (row, also, prefix, context, n, at, windows, anchor) of `rows` (row, also, text).

    The texts are read once: for a digest of each context that occurs again, and for the bytes of one of each class that is to be sorted.
    """
    classes = saved(runs.groupBy("prefix", "context").agg(F.sum("n").alias("n"), F.min(F.struct(*ROW, "at")).alias("first")), "classes")
    sizes = classes.groupBy("prefix").agg(F.count("*").alias("all"), F.min("n").alias("least")).select("prefix", F.when((F.col("all") > 1) & (F.col("least") == 1), F.col("all")).alias("classes"))
    marks = classes.join(sizes, "prefix").select("prefix", "context", F.col("n").alias("times"), "first", "classes")
    each = runs.join(marks, ["prefix", "context"]).withColumn("classes", F.when(F.struct(*ROW, "at") == F.col("first"), F.col("classes"))).where("times > 1 or classes is not null")
    wanted = each.groupBy(*ROW).agg(F.collect_list(F.struct("prefix", "context", "n", "at", "windows", "anchor", "times", "classes")).alias("wanted"))
    kind = runs.schema["context"].dataType.simpleString()
    schema = pa.schema([("row", pa.int64()), ("also", pa.int32()), ("prefix", pa.int64()), ("context", pa.int64() if kind == "bigint" else pa.binary()), ("n", pa.int8()), *((c, pa.int32()) for c in ("at", "windows", "anchor")), ("times", pa.int64()), ("classes", pa.int64()), ("digest", pa.binary()), ("bytes", pa.binary())])

    fields = ["prefix", "context", "n", "at", "windows", "anchor", "times", "classes"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            counts = pc.list_value_length(whole.column("wanted")).to_pylist()
            for part in slices(counts, BATCH):  # of the contexts of a batch few are held at once
                batch = whole.slice(part.start, part.stop - part.start)
                wants = batch.column("wanted").flatten()
                of = np.repeat(np.arange(part.stop - part.start), counts[part])
                raw = [(t or "").encode("utf-8", "replace") for t in batch.column("text").to_pylist()]
                columns = [wants.field(f) for f in fields]
                at, windows, anchor, times = (wants.field(f).to_pylist() for f in ("at", "windows", "anchor", "times"))
                own = [raw[i][a : a + w + LENGTH - 1] for i, a, w in zip(of.tolist(), at, windows, strict=True)]
                digests = [digest(x, w, k) if t > 1 else None for x, w, k, t in zip(own, windows, anchor, times, strict=True)]
                shown = [x if c else None for x, c in zip(own, wants.field("classes").is_valid().to_pylist(), strict=True)]
                keys = [batch.column(c).take(pa.array(of)) for c in ROW]
                yield pa.RecordBatch.from_arrays([a.cast(t) for a, t in zip([*keys, *columns, pa.array(digests, pa.binary()), pa.array(shown, pa.binary())], schema.types, strict=True)], schema.names)

    ddl = f"row long, also int, prefix long, context {kind}, n byte, at int, windows int, anchor int, times long, classes long, digest binary, bytes binary"
    read = saved(rows.join(wanted, ROW).select(*ROW, "text", "wanted").mapInArrow(cut, ddl), "contexts")
    wrong = read.where("times > 1").groupBy("prefix", "context").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b").select("prefix").distinct()
    wrong, more = saved(wrong, "collisions"), None
    if not wrong.isEmpty():  # of these prefixes all runs were read, and classes are told by digests
        context = F.coalesce("digest", F.concat(F.lit(b"hash"), F.col("context").cast("string").cast("binary")))
        more = matches(rows, read.join(wrong, "prefix").select(*ROW, "prefix", context.alias("context"), "n", "at", "windows", "anchor"))
        read = read.join(wrong, "prefix", "left_anti")
    found = covers(read.where("n = 1 and times > 1"))
    found = found if more is None else found.unionByName(more)
    return found.unionByName(settled(read.where("bytes is not null").select("prefix", F.col("times").alias("n"), *ROW, "at", "anchor", "classes", "bytes")))


def repeated(rows: DataFrame) -> DataFrame:
    """Of `rows` (row, also, text), all (row, also, start, length) to remove, in bytes; they may overlap."""

    def again() -> DataFrame:
        written = saved(anchors(rows), "anchors")
        runs = written.where("n > 0")
        several = runs.groupBy("prefix").agg(F.sum("n").alias("times")).where("times > 1")
        return runs.join(several.select("prefix"), "prefix").unionByName(written.where("n = 0"))

    written = saved_only(again, "runs")
    found = written.where("n = 0").select(*ROW, F.col("at").alias("start"), F.col("windows").alias("length"))
    return found.unionByName(matches(rows, written.where("n > 0")))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (its columns in `keep`, all by default) with n_bytes, n_removed, spans and kept, from whole texts as UTF-8 bytes.

    Every byte is removed that a string of LENGTH bytes covers which also starts anywhere else, in this or another text, as the
    texts are given; strings do not go on from one text into another. spans: (start, length) of each maximal removed run, in
    bytes. kept: the remaining bytes, which may hold parts of a character.

    Null texts are empty, and texts shorter than LENGTH lose nothing. Rows are told apart by 96 bits of hashes of key and text, so rows with
    the same key and text, which are copies of one another, have the same result. A null key is a value of its own. Other columns pass
    through; columns of these four names are replaced. What counts as the same was compared byte by byte, or by 128 bits of SHA-256.
    """
    keep = [c for c in (keep or docs.columns) if c not in ("n_bytes", "n_removed", "spans", "kept")]
    names = [f"_{c}" for c in keep]
    rows = docs.select(F.xxhash64(key, text).alias("row"), F.hash(key, text).alias("also"), *[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.col(text).alias("text"))
    found = saved_only(lambda: repeated(rows.select(*ROW, "text")).groupBy(*ROW).agg(F.collect_list(F.struct("start", "length")).alias("found")), "spans")
    joined = rows.join(found, ROW, "left").select(*names, "text", "found")
    schema = docs.select(*keep, F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"), F.lit(b"").alias("kept")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(x.start, x.stop - x.start) for whole in batches for x in slices(pc.fill_null(pc.binary_length(whole.column("text")), 0).to_pylist(), PART_BYTES)):
            sizes, removed, kept, counts, starts, stops = [], [], [], [], [], []
            lists = batch.column("found")
            ends, values = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)), lists.flatten()
            start, length = (values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2))
            for t, b, a in zip(batch.column("text").to_pylist(), ends.tolist(), np.append(0, ends).tolist(), strict=False):
                raw = (t or "").encode("utf-8", "replace")
                _, begin, stop = merged(np.zeros(b - a, np.int64), start[a:b], start[a:b] + length[a:b])
                kept.append(b"".join([raw[x:y] for x, y in zip([0, *stop.tolist()], [*begin.tolist(), len(raw)], strict=True)]))
                sizes.append(len(raw))
                removed.append(len(raw) - len(kept[-1]))
                counts.append(len(begin))
                starts.append(begin)
                stops.append(stop)
            begin, stop = np.concatenate(starts), np.concatenate(stops)
            each = pa.StructArray.from_arrays([pa.array(begin.astype(np.int32)), pa.array((stop - begin).astype(np.int32))], ["start", "length"])
            spans = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), each)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), spans, pa.array(kept, pa.binary())], [*keep, "n_bytes", "n_removed", "spans", "kept"])

    return joined.mapInArrow(run, schema)


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with each text as dedup() leaves it, without the parts of characters that a cut leaves. Columns are those of docs; null texts become empty."""
    others = [c for c in docs.columns if c != text]
    found = dedup(docs, key, text, others)
    return found.withColumn(text, F.replace(F.make_valid_utf8(F.col("kept").cast("string")), F.lit("\ufffd"), F.lit(""))).select(docs.columns)
