"""Tables for streams: a batch appends a run of rows, readers merge runs by key, and compaction, which runs apart, merges runs of a size into a larger one."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: So many runs of a level become one of the next.
FAN = 8
#: Keys are hashed to so many slots; a run's files are ranges of them.
SLOTS = 1 << 30
SLOT = "_slot"


@dataclass(frozen=True)
class Rule:
    """How rows of a table merge. combine must not depend on the order of rows, nor on whether some of them were combined before."""

    key: Sequence[str]
    combine: Callable[[DataFrame], DataFrame]


def slot(*key: Column | str) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(SLOTS)).cast("int").alias(SLOT)


class Store:
    """Tables in a folder. A table is a list of immutable runs, Parquet sorted by slot of the key, and a log of commits, each with the whole list: a few runs for each
    power of FAN that the table has grown by.

    A batch writes its own rows and nothing else, however much is stored. A row is rewritten once for each level, so a number of times that grows with the logarithm of the table. Files
    of a run are ranges of slots of about the size that adaptive execution is told, so there are more of them as a run grows, and a hot session or file is spread over them as its keys are. A commit
    is a rename that fails if another took its number; the loser starts again from the new list. A batch of a stream that runs again after its commit does nothing, and before it overwrites its own run.
    """

    def __init__(self, spark: SparkSession, folder: str, rules: Mapping[str, Rule]) -> None:
        self.spark, self.folder, self.rules = spark, folder.rstrip("/"), rules

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _commits(self, table: str) -> list[int]:
        path, fs = self._path(f"{table}/commits"), self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def state(self, table: str, version: int | None = None) -> dict:
        """The list of a table's runs, its schema and the last batch of each stream, by its last commit or the one given."""
        version = version if version is not None else (self._commits(table) or [0])[-1]
        if not version:
            return {"version": 0, "runs": [], "batches": {}, "schema": None}
        stream = self._fs().open(self._path(f"{table}/commits/{version}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, table: str, change: Callable[[dict], dict | None]) -> bool:
        """Puts change(last state) in its place; False if that is None."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        while True:
            state = self.state(table)
            new = change(state)
            if new is None:
                return False
            new = {**new, "version": state["version"] + 1}
            made = self._path(f"{table}/commits/.{uuid.uuid4().hex}")
            out = self._fs().create(made, True)
            jvm.org.apache.commons.io.IOUtils.write(json.dumps(new), out, "UTF-8")
            out.close()
            target = self._path(f"{table}/commits/{new['version']}.json")
            never = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            try:
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(made, target, never)
                return True
            except Py4JJavaError as e:
                self._fs().delete(made, False)
                if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                    raise

    def _write(self, table: str, df: DataFrame, run: str) -> int:
        """Writes a run, and says how many bytes it has."""
        path = f"{self.folder}/{table}/runs/{run}"
        rows = df.withColumn(SLOT, slot(*self.rules[table].key))
        rows.repartitionByRange(SLOT).sortWithinPartitions(SLOT).write.mode("overwrite").parquet(path)
        return int(self._fs().getContentSummary(self._path(f"{table}/runs/{run}")).getLength())

    @staticmethod
    def _wider(held: str | None, df: DataFrame) -> str:
        fields = {f.name: f for f in (T.StructType.fromJson(json.loads(held)).fields if held else [])}
        return T.StructType([*fields.values(), *(T.StructField(f.name, f.dataType) for f in df.schema.fields if f.name not in fields)]).json()

    def append(self, table: str, df: DataFrame, stream: str, batch: int) -> None:
        """The rows of a batch of a stream as a new run. Batches of a stream come in order."""
        if self.state(table)["batches"].get(stream, -1) >= batch:
            return
        run = f"{stream}-{batch}"
        size = self._write(table, df, run)

        def change(state: dict) -> dict | None:
            if state["batches"].get(stream, -1) >= batch:
                return None
            return {"runs": [*state["runs"], {"id": run, "level": 0, "bytes": size}], "batches": {**state["batches"], stream: batch}, "schema": self._wider(state["schema"], df)}

        self._commit(table, change)

    def _runs(self, table: str, state: dict, runs: Sequence[dict]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(state["schema"])).add(SLOT, T.IntegerType())
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/{table}/runs/{r['id']}" for r in runs))

    def read(self, table: str, where: Column | None = None, **key: object) -> DataFrame | None:
        """The table as all its runs make it; None if there is nothing. `where` and key=value take rows by columns of the key before they are merged; with a whole key only the files and
        row groups of its slot are read."""
        state = self.state(table)
        if not state["runs"]:
            return None
        rows, rule = self._runs(table, state, state["runs"]), self.rules[table]
        if key and set(key) == set(rule.key):
            types = {f.name: f.dataType for f in rows.schema.fields}
            of = self.spark.range(1).select(slot(*(F.lit(key[k]).cast(types[k]) for k in rule.key))).first()[0]
            rows = rows.where(F.col(SLOT) == of)
        for k, v in key.items():
            rows = rows.where(F.col(k) == v)
        rows = rows if where is None else rows.where(where)
        return rule.combine(rows.drop(SLOT))

    def compact(self, table: str) -> int:
        """Merges runs while any level has FAN of them; how many merges were made. Batches may be appended meanwhile."""
        merges = 0
        while True:
            state = self.state(table)
            levels: dict[int, list[dict]] = {}
            for r in state["runs"]:
                levels.setdefault(r["level"], []).append(r)
            full = [k for k, runs in sorted(levels.items()) if len(runs) >= FAN]
            if not full:
                return merges
            level, runs = full[0], levels[full[0]]
            names, run = {r["id"] for r in runs}, f"merged-{uuid.uuid4().hex}"
            merged = self.rules[table].combine(self._runs(table, state, runs).drop(SLOT))
            size = self._write(table, merged, run)

            def change(now: dict) -> dict | None:
                if not names <= {r["id"] for r in now["runs"]}:  # another compaction was faster
                    return None
                return {**now, "runs": [*(r for r in now["runs"] if r["id"] not in names), {"id": run, "level": level + 1, "bytes": size}]}

            merges += self._commit(table, change)

    def vacuum(self, table: str, keep: int = 2, grace_ms: int = 86_400_000) -> None:
        """Removes the runs that none of the last `keep` commits lists, merged ones once they are grace_ms old, and older commits. Readers of older lists must be done."""
        fs, commits = self._fs(), self._commits(table)
        listed = {r["id"] for v in commits[-keep:] for r in self.state(table, v)["runs"]}
        done = self.state(table)["batches"]
        path = self._path(f"{table}/runs")
        for s in fs.listStatus(path) if fs.exists(path) else ():
            name = s.getPath().getName()
            stream, _, batch = name.rpartition("-")
            committed = not batch.isdigit() or int(batch) <= done.get(stream, -1)  # a batch at work is not touched
            if name not in listed and committed and (stream != "merged" or s.getModificationTime() < self.spark._jvm.java.lang.System.currentTimeMillis() - grace_ms):
                fs.delete(s.getPath(), True)
        for v in commits[:-keep]:
            fs.delete(self._path(f"{table}/commits/{v}.json"), False)
