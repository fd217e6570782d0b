"""Spelling variants: words at one edit, by blocked Gram matrices of letter counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import ascii_lower, join_same, saved

#: A word is cut in so many parts; one edit leaves all but one of them as they are.
PARTS = 4
#: Rows of a Gram matrix; members of a block that stay in one task; rows and letters that a task works on at once.
TILE, GROUP, ROWS, LETTERS = 256, 4096, 1 << 15, 1 << 22
#: Letters are counted by code point modulo this, which keeps A-Z, a-z and U+00C0 to U+00FF apart; others may share a count, which lets more pairs through to be verified.
SLOTS = 160


def runs(docs: DataFrame, least: int = 7, text: str = "text", letters: str = r"A-Za-zÀ-ÿ") -> DataFrame:
    """A row for each maximal run of at least `least` letters in the whole texts of docs: its other columns and `run`, with A-Z lower-cased. Null and empty texts have none."""
    found = F.explode(F.regexp_extract_all(text, F.lit(f"[{letters}]{{{least},}}"), F.lit(0)))
    return docs.select(*(c for c in docs.columns if c not in (text, "run")), found.alias("run")).withColumn("run", ascii_lower(F.col("run")))


def vocabulary(words: DataFrame, least: int = 7, occurrences: int = 2) -> DataFrame:
    """(word, n): the distinct values of `word`, null left out, of at least `least` code points that occur at least `occurrences` times."""
    counted = words.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= occurrences)


def _cuts(m: Column, part: int) -> Column:
    return F.floor(m * part / PARTS).cast("int")


def blocks(words: DataFrame) -> DataFrame:
    """(block, part, longer, word, n): the blocks in which a word meets all words at one edit.

    Of two such words the shorter, of m letters, is cut in four parts. If the edit is in part p, they have the letters before p and
    those after it in common, so both are in the block of (m, p, these letters): a word is in four blocks as the shorter one or one as long, and in
    four as the longer one.
    """
    length, made = F.length("word"), []
    for longer in (0, 1):
        m = length - longer
        for part in range(PARTS):
            before, after = _cuts(m, part), m - _cuts(m, part + 1)
            key = F.xxhash64(m, F.lit(part), F.substring(F.col("word"), F.lit(1), before), F.substring(F.col("word"), length - after + 1, after))
            made.append(F.struct(key.alias("block"), F.lit(part).cast("byte").alias("part"), F.lit(longer).cast("byte").alias("longer")))
    return words.select(F.explode(F.array(*made)).alias("b"), "word", "n").select("b.*", "word", "n")


def _dealt(rows: DataFrame) -> DataFrame:
    """rows with i, j, tile: a block of over GROUP rows is split in tiles, and each pair of tiles (i, j) goes to a task of its own."""
    hot = saved(rows.groupBy("block").agg(F.count("*").alias("size")).where(F.col("size") > GROUP).select("block", F.ceil(F.col("size") / GROUP).cast("int").alias("tiles")), "blocks")
    if hot.isEmpty():
        return rows.select("*", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("tile"))
    tiles = F.coalesce("tiles", F.lit(1))
    with_tile = rows.join(hot, "block", "left").withColumn("tile", F.pmod(F.xxhash64("word"), tiles).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
    return with_tile.select(*rows.columns, F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile")


def _cells(codes: np.ndarray, lengths: np.ndarray, right: bool) -> np.ndarray:
    """Rows of letters from the left end, or backwards from the right one; -1 where there is none."""
    out = np.full((len(lengths), max(int(lengths.max(initial=0)), 1)), -1, np.int64)
    row, first = np.repeat(np.arange(len(lengths)), lengths), np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = np.arange(len(codes)) - first
    out[row, np.repeat(lengths, lengths) - 1 - at if right else at] = codes
    return out


def _agree(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    same = (left == right) & (left >= 0)  # letters that both begin with
    return np.where(same.all(axis=1), left.shape[1], same.argmin(axis=1))


class _Rows:
    """Words of some blocks with their letter counts."""

    def __init__(self, words: list[str], group: np.ndarray, part: np.ndarray, longer: np.ndarray, tile: np.ndarray, mixed: np.ndarray) -> None:
        self.group, self.part, self.longer, self.tile, self.mixed = group, part, longer, tile, mixed
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.lengths)])

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = self.lengths[rows]
        return np.concatenate([self.codes[self.first[r] : self.first[r + 1]] for r in rows]) if len(rows) else np.zeros(0, np.int64), lengths

    def counts(self, rows: np.ndarray) -> np.ndarray:
        codes, lengths = self.of(rows)
        found = np.bincount(np.repeat(np.arange(len(rows)), lengths) * SLOTS + codes % SLOTS, minlength=len(rows) * SLOTS).reshape(-1, SLOTS)
        return found.astype(np.float32 if lengths.max(initial=0) < 1000 else np.float64)  # squares stay whole numbers that the type holds

    def near(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows (one of a, one of b; each pair once where a is b) of a block at one edit, each in the first part that gives it."""
        x, y = self.counts(a), self.counts(b)
        squared = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)
        fit = squared <= 2
        for values in (self.group, self.part, self.lengths - self.longer):
            fit &= values[a][:, None] == values[b][None, :]
        fit &= (self.longer[a][:, None] + self.longer[b][None, :]) < 2
        fit &= ~self.mixed[a][:, None] | (self.tile[a][:, None] != self.tile[b][None, :])
        if a is b:
            fit = np.triu(fit, 1)
        ia, ib = np.nonzero(fit)
        return self.verified(a[ia], b[ib])

    def verified(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = np.zeros(len(a), bool)
        step = max(1, LETTERS // max(1, int(np.maximum(self.lengths[a], self.lengths[b]).max(initial=1))))
        for s in range(0, len(a), step):
            p, q = a[s : s + step], b[s : s + step]
            rows, back = np.unique(np.concatenate([p, q]), return_inverse=True)
            codes, lengths = self.of(rows)
            left, right = back[: len(p)], back[len(p) :]
            ahead, behind = (_agree(cells[left], cells[right]) for cells in (_cells(codes, lengths, False), _cells(codes, lengths, True)))
            most, m = np.maximum(self.lengths[p], self.lengths[q]), np.minimum(self.lengths[p], self.lengths[q])
            one = (ahead + behind >= most - 1) & ~((ahead == most) & (m == most))
            fits = np.stack([(m * g // PARTS <= ahead) & (m - m * (g + 1) // PARTS <= behind) for g in range(PARTS)])
            keep[s : s + step] = one & (fits.argmax(axis=0) == self.part[p])
        return a[keep], b[keep]


def _found(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows at one edit in whole blocks that lie one after the other."""
    col = {c: table.column(c).to_numpy() for c in ("block", "part", "longer", "i", "j", "tile")}
    n = table.num_rows
    new = np.ones(n, bool)
    new[1:] = (np.diff(col["block"]) != 0) | (np.diff(col["i"]) != 0) | (np.diff(col["j"]) != 0)
    group = np.cumsum(new) - 1
    size = np.bincount(group)
    rows = np.flatnonzero(size[group] > 1)
    if not len(rows):
        return rows, rows
    picked = table.column("word").take(pa.array(rows)).to_pylist()
    part, longer, tile = (col[c][rows].astype(np.int64) for c in ("part", "longer", "tile"))
    held = _Rows(picked, group[rows], part, longer, tile, col["i"][rows] != col["j"][rows])
    ends = np.append(np.flatnonzero(np.diff(group[rows])) + 1, len(rows))
    out, start, at = [], 0, 0
    while at < len(ends):
        stop = ends[at]
        if stop - start > TILE:  # a block of several tiles
            tiles = [np.arange(s, min(s + TILE, stop)) for s in range(start, stop, TILE)]
            out += [held.near(x, x if k == 0 else y) for i, x in enumerate(tiles) for k, y in enumerate(tiles[i:])]
        else:
            while at + 1 < len(ends) and ends[at + 1] - start <= TILE:
                at += 1
            stop = ends[at]
            one = np.arange(start, stop)
            out.append(held.near(one, one))
        start, at = stop, at + 1
    return rows[np.concatenate([x for x, _ in out])], rows[np.concatenate([y for _, y in out])]


def near(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): each pair of words of `words` (word, n; distinct) that differ by exactly one inserted, deleted or replaced code point, in both orders.

    Words meet in blocks() of adjacent lengths. In a block the products of NumPy matrices of letter counts give squared distances; pairs at most two apart
    are verified letter by letter. No block is cut off: one of over GROUP words is dealt in pairs of tiles.
    """
    rows = _dealt(blocks(words)).repartition("block", "i", "j").sortWithinPartitions("block", "i", "j")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
            a, b = _found(table)
            one, other = np.concatenate([a, b]), np.concatenate([b, a])
            made = pa.table([table.column(c).take(pa.array(r)) for c, r in (("word", one), ("n", one), ("word", other), ("n", other))], ["word", "n", "other", "other_n"])
            yield from made.combine_chunks().to_batches()

        kept: list[pa.RecordBatch] = []
        for batch in batches:
            kept.append(batch)
            if sum(b.num_rows for b in kept) < ROWS:
                continue
            table = pa.Table.from_batches(kept)
            keys = [table.column(c).to_numpy() for c in ("block", "i", "j")]
            last = np.flatnonzero(np.any([k != k[-1] for k in keys], axis=0))
            if len(last):  # the last block may go on
                yield from pairs(table.slice(0, int(last[-1]) + 1))
                kept = table.slice(int(last[-1]) + 1).combine_chunks().to_batches()
        if kept:
            yield from pairs(pa.Table.from_batches(kept))

    return rows.mapInArrow(work, "word string, n long, other string, other_n long")


def forms(words: DataFrame, factor: int = 10) -> DataFrame:
    """Each word of `words` (word, n) with form, root, n_near, form_n.

    n_near: words at one edit. form: the most frequent of these (ties: smallest in code-point order) if it occurs at least `factor` times as often as
    the word; form_n: how often; else both null. root: where the forms lead in the end; the word itself if it has none. No words: no rows.
    """
    words = words.select("word", "n")
    best = near(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    joined = words.join(best, "word", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("long")))
    has = -F.col("best.less") >= factor * F.col("n")
    found = saved(joined.select("word", "n", "n_near", F.when(has, F.col("best.other")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n")), "forms")
    ahead = found.where("form is not null").select("word", F.col("form").alias("root"))
    while True:  # roots are twice as far each time; every step is to a word `factor` times as frequent
        further = ahead.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ahead = saved(ahead.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if ahead.where("moved").isEmpty():
            break
        ahead = ahead.select("word", "root")
    return join_same(found, ahead.select("word", "root"), ["word"], "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
