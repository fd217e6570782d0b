"""A trie of the prefixes that conversations share, from sorted sequences, their common lengths, and range minima in sparse tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import WORD, saved

#: Positions of one sparse table; above it the blocks' minima have a table, and so on.
BLOCK = 4096
#: Turns that are named together. A longer conversation is a sequence of such names, and so on.
CHUNK = 512
#: Ids that are written out together for a digest.
IDS = 256


def place(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, token, words) of rows (conv_id, turn, role, text): pos from 1 in the order of turn (null first), role, text; token names (role, text); words counts those of the text.

    Null roles and texts are empty; repeated rows are turns like any other; rows without a conv_id are left out. A conversation is counted in stretches of 256 turn numbers, so a long one
    is not dealt to one task; turns without a number, or with the same one, are of one stretch.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    token = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    stretch = F.coalesce(F.floor(F.col("turn") / 256), F.lit(-(1 << 60)))
    rows = rows.where("conv_id is not null").select("conv_id", stretch.alias("stretch"), "turn", role.alias("role"), text.alias("text"))
    inner = Window.partitionBy("conv_id", "stretch").orderBy(F.asc_nulls_first("turn"), "role", "text")
    rows = rows.select("conv_id", "stretch", F.row_number().over(inner).alias("place"), token.alias("token"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))
    rows = saved(rows, "turns")
    sizes = rows.groupBy("conv_id", "stretch").agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.partitionBy("conv_id").orderBy("stretch")) - F.col("size")
    return rows.join(sizes.select("conv_id", "stretch", before.alias("before")), ["conv_id", "stretch"]).select("conv_id", (F.col("place") + F.col("before")).alias("pos"), "token", "words")


def running(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """df with `{value}_upto`: for each key the sum of value up to a row's whole number `order`, taken in blocks and then over the blocks."""
    block = df.withColumn("_block", F.floor(F.col(order) / BLOCK))
    sums = block.groupBy(*keys, "_block").agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_block")) - F.col("_sum")
    inside = F.sum(value).over(Window.partitionBy(*keys, "_block").orderBy(order))
    joined = block.withColumn("_inside", inside).join(sums.select(*keys, "_block", before.alias("_before")), [*keys, "_block"])
    return joined.withColumn(f"{value}_upto", F.col("_inside") + F.col("_before")).drop("_block", "_inside", "_before")


def sparse_table(v: np.ndarray) -> list[np.ndarray]:
    """The k-th array has the minima of all windows of 2^k values."""
    out = [v]
    while 2 << len(out) - 1 <= len(v):
        out.append(np.minimum(out[-1][: -(1 << len(out) - 1)], out[-1][1 << len(out) - 1 :]))
    return out


def extents(v: np.ndarray, at: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query the last place before `at` (-1 if none), and the first after it (len(v) if none), whose value is below d: binary searches over range minima, each query by itself."""
    table, n = sparse_table(v), len(v)
    left, right = at.copy(), at + 1
    for k in range(len(table) - 1, -1, -1):
        width = 1 << k
        left = np.where((left >= width) & (table[k][np.clip(left - width, 0, n - width)] >= d), left - width, left)
        right = np.where((right + width <= n) & (table[k][np.clip(right, 0, n - width)] >= d), right + width, right)
    return left - 1, right


def _in_blocks(values: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (block, at, d) with before and after, places of values (at, v) in that block alone; null if there is none."""
    here = values.select(F.floor(F.col("at") / BLOCK).alias("block"), "at", "v", F.lit(True).alias("given"))
    rows = here.unionByName(asked.select("block", "at", F.col("d").alias("v"), F.lit(False).alias("given")))

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        given = rows[rows["given"]].sort_values("at")
        ask = rows[~rows["given"]]
        first = int(rows["block"].iloc[0]) * BLOCK
        before, after = extents(given["v"].to_numpy(np.int64), ask["at"].to_numpy(np.int64) - first, ask["v"].to_numpy(np.int64))
        none = [before < 0, after >= len(given)]
        return pd.DataFrame({"block": ask["block"], "at": ask["at"], "d": ask["v"], "before": pd.array(before + first, "Int64"), "after": pd.array(after + first, "Int64")}).assign(
            before=lambda x: x["before"].mask(none[0]), after=lambda x: x["after"].mask(none[1])
        )

    return rows.groupBy("block").applyInPandas(search, "block long, at long, d long, before long, after long")


def smaller(values: DataFrame, asked: DataFrame, size: int) -> DataFrame:
    """asked (at, d; distinct) with before and after: the last place before `at`, and the first after it, whose value is below d; null if there is none. values: (at, v) of the places 0 to size - 1.

    What a block does not settle goes up to the minima of the blocks, once for each block and depth, and down again to the block found.
    """
    found = _in_blocks(values, asked.select(F.floor(F.col("at") / BLOCK).alias("block"), "at", "d"))
    if size <= BLOCK:
        return found.drop("block")
    found = saved(found, "extents")
    minima = values.groupBy(F.floor(F.col("at") / BLOCK).alias("block")).agg(F.min("v").alias("v")).withColumnRenamed("block", "at")
    open_ = found.where("before is null or after is null").select(F.col("block").alias("at"), "d").distinct()
    up = saved(smaller(minima, open_, -(-size // BLOCK)), "extents")
    end, start = (F.col("before") + 1) * BLOCK, F.col("after") * BLOCK - 1
    ends = up.where("before is not null").select(F.col("before").alias("block"), end.alias("at"), "d")
    starts = up.where("after is not null").select(F.col("after").alias("block"), start.alias("at"), "d")
    down = saved(_in_blocks(values, ends.union(starts).distinct()), "extents")
    low = down.select("block", "at", "d", F.col("before").alias("low"))
    high = down.select("block", "at", "d", F.col("after").alias("high"))
    up = up.withColumns({"end": end, "start": start}).withColumnsRenamed({"at": "from", "before": "b", "after": "a"})
    up = up.join(low.withColumnsRenamed({"block": "b", "at": "end"}), ["b", "end", "d"], "left").join(high.withColumnsRenamed({"block": "a", "at": "start"}), ["a", "start", "d"], "left")
    far = up.select(F.col("from").alias("block"), "d", "low", "high")
    return found.join(far, ["block", "d"], "left").select("at", "d", F.coalesce("before", "low").alias("before"), F.coalesce("after", "high").alias("after"))


def range_min(values: DataFrame, asked: DataFrame, size: int) -> DataFrame:
    """asked (l, r; distinct) with low: the least of values (at, v) at the places l to r. Ends are read in their blocks, whole blocks between them from the blocks' minima."""
    a, b = F.floor(F.col("l") / BLOCK), F.floor(F.col("r") / BLOCK)
    part = lambda block, l, r: F.struct(block.cast("long").alias("block"), l.cast("long").alias("from"), r.cast("long").alias("to"))  # noqa: E731, E741
    parts = F.when(a == b, F.array(part(a, F.col("l"), F.col("r")))).otherwise(F.array(part(a, F.col("l"), (a + 1) * BLOCK - 1), part(b, b * BLOCK, F.col("r"))))
    cut = asked.select(F.explode(parts).alias("p"), "l", "r").select("p.*", "l", "r")
    here = values.select(F.floor(F.col("at") / BLOCK).alias("block"), F.col("at").alias("from"), F.col("at").alias("to"), F.col("v").alias("l"), F.lit(0).cast("long").alias("r"), F.lit(True).alias("given"))

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        v = rows[rows["given"]].sort_values("from")["l"].to_numpy(np.int64)
        ask, first = rows[~rows["given"]], int(rows["block"].iloc[0]) * BLOCK
        table, l, r = sparse_table(v), ask["from"].to_numpy(np.int64) - first, ask["to"].to_numpy(np.int64) - first  # noqa: E741
        k = np.frexp(r - l + 1)[1] - 1
        low = np.zeros(len(ask), np.int64)
        for j in np.unique(k):
            of = k == j
            low[of] = np.minimum(table[j][l[of]], table[j][r[of] - (1 << j) + 1])
        return pd.DataFrame({"l": ask["l"], "r": ask["r"], "low": low})

    found = here.unionByName(cut.withColumn("given", F.lit(False))).groupBy("block").applyInPandas(search, "l long, r long, low long")
    if size > BLOCK:
        minima = values.groupBy(F.floor(F.col("at") / BLOCK).alias("at")).agg(F.min("v").alias("v"))
        wide = asked.where(b - a > 1).select("l", "r", (a + 1).alias("x"), (b - 1).alias("y"))
        between = range_min(minima, wide.select(F.col("x").alias("l"), F.col("y").alias("r")).distinct(), -(-size // BLOCK)).withColumnsRenamed({"l": "x", "r": "y"})
        found = found.unionByName(wide.join(between, ["x", "y"]).select("l", "r", "low"))
    return found.groupBy("l", "r").agg(F.min("low").alias("low"))


def common(a: str, b: str, width: int) -> int:
    """Whole tokens of `width` letters that a and b begin with."""
    low, high = 0, min(len(a), len(b)) // width
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low * width : mid * width] == b[low * width : mid * width] else (low, mid - 1)
    return low


def _sorted(keys: DataFrame, width: int) -> DataFrame:
    """keys (key, ...; distinct) with at, their place in the sorted order; shared, tokens in common with the key before (-1 for the first); mine and other, the first tokens that differ, if there are both."""
    number = F.monotonically_increasing_id()
    rows = saved(keys.repartitionByRange("key").sortWithinPartitions("key").withColumn("number", number), "sorted")
    part = F.shiftright("number", 33)
    sizes = rows.groupBy(part.alias("part")).agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.partitionBy(F.lit(0)).orderBy("part")) - F.col("size")  # a row for each partition
    rows = rows.withColumn("part", part).join(sizes.select("part", before.alias("before")), "part")
    rows = rows.withColumn("at", F.col("number").bitwiseAND((1 << 33) - 1) + F.col("before")).drop("number", "part", "before")
    at = F.col("at")
    also = F.when(at % BLOCK == BLOCK - 1, F.array(F.floor(at / BLOCK), F.floor(at / BLOCK) + 1)).otherwise(F.array(F.floor(at / BLOCK)))
    others = [f for f in keys.schema.fields if f.name != "key"]

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        keys, own = rows["key"].tolist(), (rows["at"] // BLOCK == rows["block"]).to_numpy()
        shared = [-1, *(common(a, b, width) for a, b in zip(keys, keys[1:], strict=False))]
        cell = lambda key, n: key[n * width : (n + 1) * width] or None if n >= 0 else None
        pairs = [(cell(k, n), cell(keys[i - 1], n)) for i, (k, n) in enumerate(zip(keys, shared, strict=True))]
        return rows.assign(shared=shared, mine=[m for m, _ in pairs], other=[o for _, o in pairs])[own][["at", "key", "shared", "mine", "other", *(f.name for f in others)]]

    schema = ", ".join(["at long", "key string", "shared long", "mine string", "other string", *(f"{f.name} {f.dataType.simpleString()}" for f in others)])
    return saved(rows.withColumn("block", F.explode(also)).groupBy("block").applyInPandas(compare, schema), "sorted")


def sequences(convs: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, at) and (at, lcp, length, copies, least): each conversation's place among the distinct sequences of turns in sorted order; and of each of these the turns in common with the one
    before (-1 for the first), its turns, the conversations that have it, and the smallest of these.

    Stretches of CHUNK turns are sorted and named by their place in that order, so a conversation is a sequence of names, which sorts as its turns do; where several names are left they are tokens
    again. Common turns of two sequences are those of the common names and, from the range minimum between the first two names that differ, those of these.
    """
    tokens = turns.select("conv_id", (F.col("pos") - 1).alias("pos"), "token", F.lit(1).cast("long").alias("n"))
    tokens = tokens.unionByName(convs.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit("").alias("token"), F.lit(0).cast("long").alias("n")))  # a conversation without turns has a name too
    width, unit, below, size_below = 32, 1, None, 0
    while True:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda t: t["token"]), "")
        chunks = tokens.groupBy("conv_id", F.floor(F.col("pos") / CHUNK).alias("k")).agg(joined.alias("key"), F.sum("n").alias("n"))
        chunks = saved(chunks, "chunks")
        names = _sorted(chunks.groupBy("key").agg(F.count("*").alias("copies"), F.min("conv_id").alias("least"), F.min("n").alias("length")), width)
        size, most = names.count(), chunks.agg(F.max("k")).first()[0]
        lcp = F.col("shared") * unit
        if below is not None:  # the stretches of the first names that differ
            differ = names.where("mine is not null and other is not null").select("at", (F.conv("other", 16, 10).cast("long") + 1).alias("l"), F.conv("mine", 16, 10).cast("long").alias("r"))
            differ = saved(differ, "differ")
            low = range_min(below, differ.select("l", "r").distinct(), size_below)
            names = names.join(differ.join(low, ["l", "r"]).select("at", "low"), "at", "left")
            lcp = lcp + F.coalesce("low", F.lit(0))
        names = saved(names.select("at", "key", F.when(F.col("shared") < 0, F.lit(-1).cast("long")).otherwise(lcp).alias("lcp"), "length", "copies", "least"), "names")
        named = chunks.join(names.select("key", "at"), "key").select("conv_id", "k", "at", "n")
        if not most:
            return named.select("conv_id", "at"), names.drop("key")
        below, size_below = names.select("at", F.col("lcp").alias("v")), size
        tokens = named.select("conv_id", F.col("k").alias("pos"), F.lpad(F.lower(F.hex("at")), 16, "0").alias("token"), "n")
        width, unit = 16, unit * CHUNK


def digests(members: DataFrame) -> DataFrame:
    """(at, sha256) of members (at, conv_id): the digest of each group's ids in decimal, ascending, comma-joined. Ids are written out in bounded lists; a digest is fed with them one after the other, so a large group is never held."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    lists = members.groupBy("at", F.floor(F.col("conv_id") / IDS).alias("part")).agg(ids.alias("ids")).repartition("at").sortWithinPartitions("at", "part")

    def feed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest = None, hashlib.sha256()
        for batch in batches:
            made: list[tuple[int, str]] = []
            for at, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if at == last:
                    digest.update(b"," + text.encode())
                    continue
                if last is not None:
                    made.append((last, digest.hexdigest()))
                last, digest = at, hashlib.sha256(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in made], pa.int64()), pa.array([h for _, h in made], pa.string())], ["at", "sha256"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([digest.hexdigest()])], ["at", "sha256"])

    return lists.select("at", "ids").mapInArrow(feed, "at long, sha256 string")


def _each(first: Column, last: Column) -> tuple[Column, Column]:
    """Arrays of the stretches of BLOCK depths from first to last, and of the depths of stretch `s`."""
    stretch = F.sequence(F.floor(first / BLOCK), F.floor(last / BLOCK))
    return stretch, F.sequence(F.greatest(first, F.col("s") * BLOCK), F.least(last, (F.col("s") + 1) * BLOCK - 1))


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes of the trie of `turns` (conv_id, pos from 1 without gaps, token, words), one row for each distinct prefix of the conversations of `convs` (conv_id, distinct).

    conv_id: the smallest member, a conversation that begins with the prefix. depth: its turns, 0 for the root, which has all as members, those without turns too. parent_conv_id: that of the
    prefix one turn shorter, null for the root. n_convs: members. n_children, n_leaves: longer prefixes by one turn, and prefixes in the subtree, itself included, that none is longer than.
    saved_tokens: (n_convs - 1) times the words of the last turn, over the subtree. ends_sha256: of the members that end here. No conversations: no rows.

    Members of a prefix are neighbours in sorted order. Where two neighbours part, and where a sequence ends, is a prefix whose members are found by binary searches to the left and right over
    range minima of common lengths. Prefixes between such a one and the next shorter such one have the same members.
    """
    of, seqs = sequences(convs, turns)
    seqs = saved(seqs, "sequences")
    size = seqs.count()
    values = seqs.select("at", F.col("lcp").alias("v"))
    after = seqs.select((F.col("at") - 1).alias("at"), F.col("lcp").alias("next"))
    seqs = seqs.join(after.where("at >= 0"), "at", "left").withColumn("next", F.coalesce("next", F.lit(-1))).withColumn("leaf", (F.col("next") < F.col("length")).cast("long"))
    seqs = saved(running(running(seqs, [], "at", "copies"), [], "at", "leaf"), "sequences")

    asked = seqs.where("lcp >= 0").select("at", F.col("lcp").alias("d")).union(seqs.select("at", "length"))
    found = smaller(values, asked, size).join(seqs.select("at", "lcp"), "at")
    starts = F.when(F.col("lcp") < F.col("d"), F.col("at")).otherwise(F.col("before"))
    found = saved(found.select("at", "d", starts.alias("l"), (F.coalesce("after", F.lit(size)) - 1).alias("r"), (F.col("lcp") == F.col("d")).cast("long").alias("parts")), "found")
    least = range_min(seqs.select("at", F.col("least").alias("v")), found.select("l", "r").distinct(), size)
    found = saved(found.join(least, ["l", "r"]), "found")

    nodes = found.groupBy("l", "r", "d").agg(F.sum("parts").alias("parts"), F.min("low").alias("conv_id"))
    first = seqs.select(F.col("at").alias("l"), "lcp", "length", F.col("least").alias("copy"), (F.col("copies_upto") - F.col("copies")).alias("copies_before"), (F.col("leaf_upto") - F.col("leaf")).alias("leaf_before"))
    last = seqs.select(F.col("at").alias("r"), "next", "copies_upto", "leaf_upto")
    nodes = nodes.join(first, "l").join(last, "r").select(
        "l", "r", "d", "conv_id", "copy", F.greatest("lcp", "next").alias("above"), F.when(F.col("lcp") >= F.col("next"), F.col("l")).otherwise(F.col("r") + 1).alias("q"),
        (F.col("copies_upto") - F.col("copies_before")).alias("n_convs"), (F.col("leaf_upto") - F.col("leaf_before")).alias("n_leaves"),
        (F.col("parts") + (F.col("length") > F.col("d")).cast("long")).alias("n_children"), (F.col("length") == F.col("d")).alias("ends"),
    )
    parents = found.select(F.col("at").alias("q"), F.col("d").alias("above"), F.col("low").alias("above_conv"))
    nodes = nodes.join(parents, ["q", "above"], "left").drop("q")
    nodes = saved(nodes, "nodes")

    stretches, depths = _each(F.col("above") + 1, F.col("d"))
    each = nodes.withColumn("s", F.explode(stretches)).withColumn("depth", F.explode(depths)).drop("s")
    words = turns.select(F.col("conv_id").alias("copy"), F.col("pos").alias("depth"), "words")
    each = each.join(words, ["copy", "depth"], "left").withColumn("own", (F.col("n_convs") - 1) * F.coalesce("words", F.lit(0)))
    each = saved(each.drop("words", "copy"), "each")
    # of a node: its own line from this depth on, the lines that start where it does and lie deeper, and those that start among its other members
    lines = each.groupBy("l", "r", "d").agg(F.sum("own").alias("line"))
    deeper = F.coalesce(F.sum("line").over(Window.partitionBy("l").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lines = lines.withColumn("deeper", deeper)
    totals = saved(running(lines.groupBy(F.col("l").alias("at")).agg(F.sum("line").alias("total")), [], "at", "total"), "totals")
    lines = lines.join(totals.select(F.col("at").alias("l"), F.col("total_upto").alias("low")), "l")
    # the last place up to r where a line starts: every sequence starts one
    lines = lines.join(totals.select(F.col("at").alias("r"), F.col("total_upto").alias("high")), "r")
    lines = lines.select("l", "d", "line", (F.col("deeper") + F.col("high") - F.col("low")).alias("below"))
    each = running(each, ["l", "d"], "depth", "own").join(lines, ["l", "d"])
    at_end = F.col("depth") == F.col("d")
    ended = F.when(at_end & F.col("ends"), F.col("l"))
    shas = digests(of).withColumnsRenamed({"at": "_at", "sha256": "_sha"})
    each = each.withColumn("_at", ended).join(shas, "_at", "left")
    return each.select(
        "conv_id", "depth", F.when(F.col("depth") > F.col("above") + 1, F.col("conv_id")).otherwise(F.col("above_conv")).alias("parent_conv_id"), "n_convs",
        F.when(at_end, F.col("n_children")).otherwise(F.lit(1)).cast("long").alias("n_children"), "n_leaves",
        (F.col("line") - F.col("own_upto") + F.col("own") + F.col("below")).alias("saved_tokens"), F.coalesce("_sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
