"""SentencePiece encoding and decoding; giant texts by a max-plus scan over chunks.

The model is one of merged pieces: at each step the adjacent pair whose union is the best piece is merged. Two facts
make that a path problem, so that chunks of a text can be worked on apart:

* No piece goes on after a word with another space mark. So merging never crosses the start of a unit (space marks and the word
  after them), and texts fall into units that are encoded by themselves: every path goes through the start of each unit.
* Inside a unit, a sequence of pieces is the encoding if and only if each piece, and each two neighbours, encode to
  themselves. So the encoding is the one path through a lattice of pieces whose neighbours agree, which has weight 0;
  other paths have weight minus infinity.

A giant text is cut into chunks of CHUNK characters, wherever that is. A chunk is a matrix from the pieces that can cover its start to
those that can cover its end, and matrices combine by (max, +), which is associative: FAN neighbours at a time, level by level, up to one
for each text; then down again, which gives each chunk the pieces at its ends, between which it traces its own path back.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import map_texts, saved, slices

SPACE = "▁"
UNIT = re.compile(f"{SPACE}+[^{SPACE}]*")
#: Longer texts are cut into chunks of this many characters; so many matrices are combined at once.
CHUNK, FAN = 1 << 16, 8
CACHED_UNITS = 60_000
SLICE_CHARS = 1 << 18
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"


class Encoder:
    """A model (its file's bytes), and what it makes of units, kept as they come up."""

    def __init__(self, model: bytes) -> None:
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        p = self.processor
        self.pieces = {p.id_to_piece(i): i for i in range(len(p)) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i))}
        if any(SPACE in x.lstrip(SPACE) for x in self.pieces):
            raise ValueError("pieces that hold a space mark after a letter are not supported")
        self.longest = max(map(len, self.pieces))
        #: A lone mark (at a text's end) has no text of its own that would be encoded to it.
        self.alone = np.array(self.piece_ids(SPACE), "<i4").tobytes()
        self.units: dict[str, bytes] = {}
        self.agreed: dict[tuple[str, str], bool] = {}

    def text(self, unit: str) -> str:
        """What has the encoding of a unit: the encoder puts the first space mark there itself."""
        return unit[1:].replace(SPACE, " ")

    def ids(self, texts: list[list[str]]) -> list[bytes]:
        """Ids of each text, given as its units in a row, as little-endian 32-bit numbers.

        Units are kept until CACHED_UNITS are known; frequent ones come early, and later ones are encoded when they come up.
        """
        known = self.units
        new = list({u for units in texts for u in units if u not in known})
        found = self.processor.encode([self.text(u) for u in new], num_threads=1) if new else []
        made = {u: array("i", f).tobytes() if u != SPACE else self.alone for u, f in zip(new, found, strict=True)}
        if len(known) + len(made) <= CACHED_UNITS:
            known.update(made)
            return [b"".join(map(known.__getitem__, units)) for units in texts]
        return [b"".join([known[u] if u in known else made[u] for u in units]) for units in texts]

    def agree(self, a: str, b: str) -> bool:
        """Whether a and b (or a alone, if b is empty) encode to themselves, inside a word."""
        key = (a, b)
        if key not in self.agreed:
            if len(self.agreed) > 4 * CACHED_UNITS:
                self.agreed.clear()
            # a line break is in no piece, so what follows it is encoded by itself
            found = self.processor.encode("\n" + (a + b).replace(SPACE, " "), out_type=str)
            after = found[found.index("<0x0A>") + 1 :]
            parts = [x for x in (a, b) if x]
            self.agreed[key] = after == [y for x in parts for y in ([x] if x in self.pieces else [f"<0x{c:02X}>" for c in x.encode()])]
        return self.agreed[key]

    def starting(self, text: str, at: int) -> list[str]:
        """Pieces that can stand at a place of a text; a character that is no piece stands for itself."""
        found = [text[at:e] for e in range(at + 1, min(len(text), at + self.longest) + 1) if text[at:e] in self.pieces and self.agree(text[at:e], "")]
        return found if text[at] in self.pieces else [*found, text[at]]

    def covering(self, text: str, at: int) -> list[tuple[int, str]]:
        """(start, piece) of those that start before a place and end there or after it: the states of a boundary."""
        return [(s, p) for s in range(max(0, at - self.longest), at) for p in self.starting(text, s) if s + len(p) >= at]

    def paths(self, text: str, entries: list[tuple[int, str]], stop: int) -> dict[int, dict[tuple[int, str], tuple[int, tuple[int, str] | None]]]:
        """By end, the (start, piece) that are reached: from which entries, as bits, and by way of which piece before.

        Pieces that start at `stop` or later are left out.
        """
        reached: dict[int, dict] = {}
        for i, (s, p) in enumerate(entries):
            reached.setdefault(s + len(p), {})[(s, p)] = (1 << i, None)
        for at in range(min(reached, default=stop), stop):
            for p in self.starting(text, at) if at in reached else ():
                bits, via = 0, None
                for state, (b, _) in reached[at].items():
                    if not state[1] or self.agree(state[1], p):
                        bits, via = bits | b, state
                if bits:
                    reached.setdefault(at + len(p), {})[(at, p)] = (bits, via)
        return reached

    def transfer(self, text: str, start: int, stop: int) -> np.ndarray:
        """The matrix of [start, stop), no unit start in between; where text starts or ends, units do, and there is one state."""
        entries, exits = self.states(text, start), self.states(text, stop)
        reached = self.paths(text, entries, stop)
        out = np.full((len(entries), len(exits)), -np.inf)
        for j, (s, p) in enumerate(exits):
            ends = reached.get(s + len(p), {})
            bits = 0
            for state in [(s, p)] if p else list(ends):  # a unit's end is one state, whatever piece ends there
                bits |= ends.get(state, (0, None))[0]
            out[[i for i in range(len(entries)) if bits >> i & 1], j] = 0
        return out

    def states(self, text: str, at: int) -> list[tuple[int, str]]:
        return [(at, "")] if at in (0, len(text)) else self.covering(text, at)

    def backtrace(self, text: str, start: int, stop: int, entry: int, exit_: int) -> list[int]:
        """Ids of the pieces that start in [start, stop), given the states at its ends."""
        entries, exits = self.states(text, start), self.states(text, stop)
        reached = self.paths(text, [entries[entry]], stop)
        state = exits[exit_] if exits[exit_][1] else next(iter(reached[stop]))
        found = []
        while state is not None and state[1]:
            if state[0] >= start:
                found.append(state[1])
            state = reached[state[0] + len(state[1])][state][1]
        return [i for p in reversed(found) for i in self.piece_ids(p)]

    def sections(self, text: str, start: int, stop: int) -> tuple[tuple[str, int, int] | None, str, tuple[str, int, int] | None]:
        """A chunk [start, stop) of a text as (what is left of the unit at its start, whole units, what it has of the unit at its end).

        The outer two are given as transfer() takes them. If no unit starts in the chunk, it is all in the first of them.
        """
        starts = [m.start() for m in UNIT.finditer(text, start and start - 1, min(len(text), stop + 1)) if m.start() >= start and (not m.start() or text[m.start() - 1] != SPACE)]
        first, last = (starts[0], starts[-1]) if starts else (None, None)
        if stop == len(text):
            first, last = stop if first is None else first, stop
        if first is None:
            return (text, start, stop), "", None
        return None if first == start else (text[:first], start, first), text[first:last], None if last == stop else (text[last:], 0, stop - last)

    def chunk_matrix(self, text: str, start: int, stop: int) -> np.ndarray:
        left, _, right = self.sections(text, start, stop)
        parts = [self.transfer(*x) for x in (left, right) if x]
        return combine(*parts) if len(parts) == 2 else parts[0] if parts else np.zeros((1, 1))

    def chunk_ids(self, text: str, start: int, stop: int, entry: int, exit_: int) -> np.ndarray:
        """Ids of the pieces that start in a chunk. Whole units need no tracing: there is one state at each of their ends."""
        left, units, right = self.sections(text, start, stop)
        inner = np.frombuffer(self.ids([UNIT.findall(units)])[0], "<i4")
        before = self.backtrace(*left, entry, exit_ if left[2] < len(left[0]) else 0) if left else []
        after = self.backtrace(*right, 0, exit_) if right else []
        return np.concatenate([np.array(before, "<i4"), inner, np.array(after, "<i4")])

    def piece_ids(self, piece: str) -> list[int]:
        if piece in self.pieces:
            return [self.pieces[piece]]
        return [self.processor.piece_to_id(f"<0x{c:02X}>") for c in piece.encode("utf-8", "replace")]


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The (max, +) product of two transfer matrices."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def marked(text: str) -> str:
    """The text as units: with a space mark in front and in place of each space. An empty text has none."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def encode(docs: DataFrame, model: bytes, text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """docs with `ids` (array of int): the model's encoding of each whole text.

    Texts of under `chunk` characters are encoded where they are. Longer ones are cut into chunks, which are dealt out evenly:
    each gives a transfer matrix, matrices are combined in a tree, and each chunk's path is traced back by itself between the states found.

    Null and empty texts have no ids. A space mark in a text is encoded as a space. Repeated rows stay; other columns
    pass through, whatever their names; a column `ids` is replaced. The order of rows may change.
    """
    docs = docs.drop("ids")
    size = F.coalesce(F.length(text), F.lit(0))

    def maker() -> Callable[[list[str]], dict]:
        encoder = Encoder(model)

        def work(texts: list[str]) -> dict:
            sizes, parts = [0], []
            for part in slices([len(t) for t in texts], SLICE_CHARS):
                found = encoder.ids([UNIT.findall(marked(t)) for t in texts[part]])
                sizes += [len(f) // 4 for f in found]
                parts.append(b"".join(found))
            return {"ids": pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), pa.array(np.frombuffer(b"".join(parts), np.int32)))}

        return work

    short = map_texts(docs.where(size < chunk), None, "ids array<int>", maker, text)
    giants = saved(docs.where(size >= chunk).select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("doc")), "giants")
    ids = giant_ids(giants.select("row", F.col(f"doc.`{text}`").alias("text")), model, chunk)
    return short.unionByName(giants.join(ids, "row").select("doc.*", "ids"))


def giant_ids(giants: DataFrame, model: bytes, chunk: int) -> DataFrame:
    """(row, ids) of giants (row, text), by chunks."""
    margin = Encoder(model).longest  # what surrounds a chunk as far as pieces reach
    if chunk < margin:
        raise ValueError(f"a chunk must hold the longest piece, {margin} characters")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, t in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                t = marked(t)
                for no, a in enumerate(range(0, len(t), chunk)):
                    lo, hi = max(0, a - margin - 1), min(len(t), a + chunk + margin + 1)
                    yield pa.RecordBatch.from_pylist([{"row": row, "no": no, "piece": t[lo:hi], "a": a - lo, "b": min(len(t), a + chunk) - lo}], schema=pieces)

    pieces = pa.schema([("row", pa.int64()), ("no", pa.int32()), ("piece", pa.string()), ("a", pa.int32()), ("b", pa.int32())])
    chunks = saved(giants.mapInArrow(split, "row long, no int, piece string, a int, b int"), "chunks")
    dealt = chunks.repartition("row", "no")

    def matrices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(model)
        for f in frames:
            made = [encoder.chunk_matrix(r.piece, r.a, r.b) for r in f.itertuples()]
            yield pd.DataFrame({"row": f["row"], "no": f["no"], "n": [len(m) for m in made], "cells": [(m == 0).tobytes() for m in made]})

    levels = [saved(dealt.mapInPandas(matrices, MATRIX), "matrices")]
    most = chunks.agg(F.max("no")).first()[0] or 0
    while most:
        up = levels[-1].withColumn("parent", F.floor(F.col("no") / FAN).cast("int")).groupBy("row", "parent").applyInPandas(combined, MATRIX)
        levels.append(saved(up, "matrices"))
        most //= FAN
    path = levels.pop().select("row", "no", F.lit(0).alias("entry"), F.lit(0).alias("exit"))
    while levels:
        above = path.select("row", F.col("no").alias("parent"), "entry", "exit")
        own = levels.pop().withColumn("parent", F.floor(F.col("no") / FAN).cast("int"))
        path = own.join(above, ["row", "parent"]).groupBy("row", "parent").applyInPandas(ways, "row long, no int, entry int, exit int")

    def trace(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(model)
        for f in frames:
            yield pd.DataFrame({"row": f["row"], "no": f["no"], "ids": [encoder.chunk_ids(r.piece, r.a, r.b, r.entry, r.exit) for r in f.itertuples()]})

    traced = chunks.join(path, ["row", "no"]).mapInPandas(trace, "row long, no int, ids array<int>")
    together = traced.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("no", "ids"))).alias("parts"))
    return together.select("row", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))


#: A matrix of n rows, as a byte for each cell: 1 for weight 0, 0 for minus infinity.
MATRIX = "row long, no int, n int, cells binary"


def read_cells(cells: bytes, n: int) -> np.ndarray:
    return np.where(np.frombuffer(cells, bool).reshape(n, -1), 0.0, -np.inf)


def combined(f: pd.DataFrame) -> pd.DataFrame:
    """The matrix of up to FAN neighbouring ones."""
    f = f.sort_values("no")
    m = reduce(combine, map(read_cells, f["cells"], f["n"]))
    return pd.DataFrame({"row": f["row"].iloc[:1], "no": f["parent"].iloc[:1], "n": [len(m)], "cells": [(m == 0).tobytes()]})


def ways(f: pd.DataFrame) -> pd.DataFrame:
    """The states at the ends of up to FAN neighbouring matrices, given those at the ends of all of them."""
    f = f.sort_values("no")
    steps = list(map(read_cells, f["cells"], f["n"]))
    ahead = [steps[0][f["entry"].iloc[0]][None, :]]  # from the entry to each boundary
    for m in steps[1:]:
        ahead.append(combine(ahead[-1], m))
    path = [int(f["exit"].iloc[0])]
    if ahead[-1][0, path[0]] < 0:
        raise ValueError("no path: the model's pieces do not cover the text")
    for m, a in zip(reversed(steps[1:]), reversed(ahead[:-1]), strict=True):
        path.append(int((a[0] + m[:, path[-1]]).argmax()))
    path.append(int(f["entry"].iloc[0]))
    path.reverse()
    return pd.DataFrame({"row": f["row"], "no": f["no"], "entry": path[:-1], "exit": path[1:]})


def decode(encoded: DataFrame, model: bytes, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """encoded with `to`: the text of each row's ids. Null ids give an empty text; byte pieces that are no UTF-8 give U+FFFD.

    Control and unknown ids have no text. Repeated rows stay; other columns pass through.
    """
    keep = [c for c in encoded.columns if c != to]
    schema = encoded.select(*keep, F.lit("").alias(to)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sentencepiece.SentencePieceProcessor(model_proto=model)
        text = lambda i: bytes([int(p.id_to_piece(i)[3:5], 16)]) if p.is_byte(i) else b"" if p.is_control(i) or p.is_unknown(i) else p.id_to_piece(i).replace(SPACE, " ").encode()
        table = [text(i) for i in range(len(p))]
        for batch in batches:
            column = batch.column(ids)
            offsets, values = column.offsets.to_pylist(), column.values.to_numpy(zero_copy_only=False)
            for part in slices([b - a for a, b in zip(offsets[:-1], offsets[1:], strict=True)], SLICE_CHARS):
                out = []
                for a, b in zip(offsets[part], offsets[part.start + 1 : part.stop + 1], strict=True):  # a text at a time: as objects, ids take ten times the room
                    t = b"".join([table[i] for i in values[a:b].tolist()]).decode("utf-8", "replace")
                    out.append(t[1:] if t.startswith(" ") else t)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(part.start, len(out)) for c in keep), pa.array(out, pa.string())], [*keep, to])

    return encoded.mapInArrow(run, schema)


def read_model(path: str = MODEL_PATH) -> bytes:
    """A model's bytes, read by the driver and sent with the tasks; half a megabyte for 32,000 pieces."""
    with open(path, "rb") as file:
        return file.read()
