"""Snapshots and logs of a graph as Parquet, by version.

Nothing is changed in place: a write is a new version of one or more tables, and a state names the versions that belong together. The last
state is what readers see; it is one small file, written when all its tables are. Logs are
folders of batches, each named by its number, so writing a batch again (after a failure) replaces it. A state also tells which batches it has
taken in and the last arrival number, so that going on from it needs no look at older logs.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .. import schema

SNAPSHOTS = {"triples": schema.TRIPLES, "entities": schema.ENTITIES, "cooccurrences": schema.COOCCURRENCES, "patterns": schema.PATTERNS}
LOGS = {"triple_log": schema.TRIPLE_LOG, "mention_log": schema.MENTION_LOG}


#: Older states are deleted.
STATES = 100


@dataclass(frozen=True)
class State:
    """Versions of tables that belong together, the batches they have taken in (as runs [first, last]), the batch taken in
    last and the number of the state that it was taken into (where nothing else came after), and the last arrival number."""

    number: int = 0
    tables: dict[str, int] = field(default_factory=dict)
    applied: list[list[int]] = field(default_factory=list)
    batch: int | None = None
    onto: int | None = None
    seq: int = 0

    def has(self, batch: int) -> bool:
        return any(a <= batch <= b for a, b in self.applied)

    def spare(self) -> int:
        """A batch number below all that callers count from 0 or 1."""
        return min([0, *(a for a, _ in self.applied)]) - 1

    def with_batch(self, batch: int) -> list[list[int]]:
        runs: list[list[int]] = []
        for a, b in sorted([*self.applied, [batch, batch]]):
            if runs and a <= runs[-1][1] + 1:
                runs[-1][1] = max(runs[-1][1], b)
            else:
                runs.append([a, b])
        return runs


class GraphStore:
    """The tables of one folder; ``agent_id`` is a column of each, so tenants share them and filters prune."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return jvm.org.apache.hadoop.fs.Path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbered(self, name: str, prefix: str) -> list[int]:
        """The finished versions or batches of a table."""
        path, fs = self._files()
        folder = path(f"{self.root}/{name}")
        if not fs.exists(folder):
            return []
        found = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith(prefix)]
        return sorted(int(p.getName()[len(prefix) :]) for p in found if fs.exists(path(f"{p.toString()}/_SUCCESS")))

    def state(self, number: int | None = None) -> State | None:
        """The last state, or that of a number where it is still there."""
        path, fs = self._files()
        folder = path(f"{self.root}/states")
        if number is None:
            names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
            numbers = [int(n[:-5]) for n in names if n.endswith(".json")]
            if not numbers:
                return State()
            number = max(numbers)
        elif number == 0:
            return State()
        file = path(f"{self.root}/states/{number}.json")
        if not fs.exists(file):
            return None
        stream = fs.open(file)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return State(**json.loads(text))

    def base_for(self, batch: int) -> State | None:
        """The state that a batch is to be taken into: the last one, or, if it was the last to be taken in and runs again, the one before it. None where it
        was taken in and other changes followed (or the versions before it are deleted): it is in force then."""
        now = self.state()
        if not now.has(batch):
            return now
        base = self.state(now.onto) if now.batch == batch and now.onto is not None else None
        return base if base and all(v in self._numbered(name, "v=") for name, v in base.tables.items()) else None

    def version(self, name: str) -> int | None:
        return self.state().tables.get(name)

    def read(self, name: str, version: int | None = None, state: State | None = None) -> DataFrame:
        version = (state or self.state()).tables.get(name) if version is None else version
        if version is None:
            return self.spark.createDataFrame([], SNAPSHOTS[name])
        return self.spark.read.schema(SNAPSHOTS[name]).parquet(f"{self.root}/{name}/v={version}")

    def commit(self, tables: Mapping[str, DataFrame], base: State | None = None, batch: int | None = None, seq: int | None = None) -> State:
        """New versions of ``tables`` and the state that has them, besides the other tables of ``base`` (else the last state); readers of older ones are not disturbed."""
        now = self.state()
        base = base or now
        versions = dict(base.tables)
        for name, df in tables.items():
            version = (self._numbered(name, "v=") or [0])[-1] + 1
            fields = [df[f.name].cast(f.dataType).alias(f.name) for f in SNAPSHOTS[name]]
            df.select(*fields).write.mode("overwrite").parquet(f"{self.root}/{name}/v={version}")
            versions[name] = version
        taken = {"batch": None, "onto": None} if batch is None else {"applied": base.with_batch(batch), "batch": batch, "onto": base.number}
        new = State(**{**asdict(base), **taken, "number": now.number + 1, "tables": versions, "seq": base.seq if seq is None else max(seq, base.seq)})
        path, fs = self._files()
        stream = fs.create(path(f"{self.root}/states/{new.number}.json"), True)
        stream.write(bytearray(json.dumps(asdict(new)).encode()))
        stream.close()
        fs.delete(path(f"{self.root}/states/{new.number - STATES}.json"), False)
        return new

    def write(self, name: str, df: DataFrame) -> int:
        """A new version of one table."""
        return self.commit({name: df}).tables[name]

    def append(self, name: str, batch: int, df: DataFrame) -> None:
        fields = [df[f.name].cast(f.dataType).alias(f.name) for f in LOGS[name]]
        df.select(*fields).write.mode("overwrite").parquet(f"{self.root}/{name}/batch={batch}")

    def staged(self, name: str, batch: int, df: DataFrame) -> DataFrame:
        """What a batch's statements are before names are resolved, written once as they are read several times; ``unstage`` deletes it."""
        path = f"{self.root}/staged/{name}-{batch}"
        df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in LOGS[name]]).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(LOGS[name]).parquet(path)

    def unstage(self) -> None:
        path, fs = self._files()
        fs.delete(path(f"{self.root}/staged"), True)

    def batches(self, name: str) -> list[int]:
        return self._numbered(name, "batch=")

    def read_log(self, name: str, batches: list[int] | None = None) -> DataFrame:
        batches = self.batches(name) if batches is None else batches
        if not batches:
            return self.spark.createDataFrame([], LOGS[name])
        return self.spark.read.schema(LOGS[name]).parquet(*[f"{self.root}/{name}/batch={b}" for b in batches])

    def vacuum(self, name: str, keep: int = 2) -> None:
        """Delete all versions of a table but that of the last state and the ``keep`` - 1 before it."""
        path, fs = self._files()
        now = self.version(name)
        for v in [v for v in self._numbered(name, "v=") if now is None or v < now][: -(keep - 1) or None]:
            fs.delete(path(f"{self.root}/{name}/v={v}"), True)
