"""The command history as a table of versions: gapless ids, clustered files, exact totals.

A version is a small file that lists the data files of the table, what each of
them holds (rows, ranges of user, command and time), the greatest id given out
and the totals per command. It is published under the next number, which only
one writer can do; the other one repeats its publishing on top, so concurrent
appends both survive and readers see whole versions only. Files that a change
does not touch stay as they are.

- Ids: a batch is sorted by time and content, rows are counted per partition,
  and sums of the counts before give every row its number behind the greatest
  id. The range is reserved under the batch's key before data are written, so
  a batch that is repeated after a fault gets the same ids, and one that is
  repeated after success changes nothing.
- Clustering: files hold neighbours on a curve through user, command and time
  (bits of the three interleaved), so reads by any of them open few files. The
  files have bloom filters on user and command.
- Totals are added to by appends and subtracted from by deletions; reading
  them opens no data file.

Publishing relies on a file system that renames a file to a name only if the
name is free, or links one so (HDFS does the first, local ones the second).
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cleansheet.operators.history import (
    COMMAND_LIMIT, FAILURE_LIMIT, HISTORY_SCHEMA, RECENT_LIMIT, USER_LIMIT, HistoryError, by_command, by_user, checked_rows,
    failures, recent,
)
from cleansheet.session import drop_path, materialize, path_exists
from cleansheet.sources.records import file_of_line

ROWS_PER_FILE = 1_000_000
_BITS = 10
_NANOS = 1_000_000_000


class Conflict(HistoryError):
    """What a change was based on is gone."""


@dataclass(frozen=True)
class DataFile:
    """One data file and the least and greatest values in it; user and command as hashes of a few bits, time in microseconds."""

    path: str
    rows: int
    failed: int
    user: tuple[int, int]
    command: tuple[int, int]
    time: tuple[int, int]


@dataclass(frozen=True)
class Totals:
    """Sums over the rows of one command, in whole numbers, so that they can be taken back exactly."""

    rows: int = 0
    succeeded: int = 0
    failed: int = 0
    nanoseconds: int = 0
    milliseconds: int = 0

    def plus(self, other: Totals, sign: int = 1) -> Totals:
        return Totals(*[a + sign * b for a, b in zip(asdict(self).values(), asdict(other).values())])


@dataclass(frozen=True)
class Version:
    number: int = 0
    greatest_id: int = 0
    batch: str = ""
    reserved: dict[str, tuple[int, int]] = field(default_factory=dict)
    files: tuple[DataFile, ...] = ()
    totals: dict[str, Totals] = field(default_factory=dict)

    @property
    def rows(self) -> int:
        return sum(f.rows for f in self.files)

    def to_text(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_text(text: str) -> Version:
        raw = json.loads(text)
        files = tuple(DataFile(**{k: tuple(v) if isinstance(v, list) else v for k, v in f.items()}) for f in raw.pop("files"))
        totals = {c: Totals(**t) for c, t in raw.pop("totals").items()}
        reserved = {k: tuple(v) for k, v in raw.pop("reserved").items()}
        return Version(**raw, files=files, totals=totals, reserved=reserved)


def _bucket(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(1 << _BITS)).cast("int")


def _interleaved(*numbers: Column) -> Column:
    """The bits of small numbers in turn, the highest first."""
    bits = [
        F.shiftleft(F.shiftright(n, i).bitwiseAND(1).cast("long"), i * len(numbers) + j)
        for i in range(_BITS) for j, n in enumerate(numbers)
    ]
    total = bits[0]
    for b in bits[1:]:
        total = total + b
    return total


def _summed(rows: DataFrame) -> dict[str, Totals]:
    found = rows.groupBy("command").agg(
        F.count("*").alias("rows"), F.count_if(F.col("success") == 1).alias("succeeded"),
        F.count_if(F.col("success") == 0).alias("failed"),
        F.sum(F.round(F.col("execution_time") * _NANOS).cast("decimal(38,0)")).alias("nanoseconds"),
        F.sum("duration_ms").alias("milliseconds")).collect()
    return {r["command"]: Totals(*[int(v or 0) for v in r[1:]]) for r in found}


class HistoryTable:
    """A history table in a folder; an absent or empty folder is an empty table."""

    def __init__(self, spark: SparkSession, path: str, rows_per_file: int = ROWS_PER_FILE):
        self.spark, self.path, self.rows_per_file = spark, path.rstrip("/"), rows_per_file

    # --- versions -----------------------------------------------------------------------------------------------------

    def _hadoop(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _name(self, number: int) -> str:
        return f"{self.path}/versions/{number:020d}.json"

    def version(self, number: int | None = None) -> Version:
        """The newest version, or the one with a number."""
        if number is None:
            folder, files = self._hadoop(f"{self.path}/versions")
            if not files.exists(folder):
                return Version()
            names = [s.getPath().getName() for s in files.listStatus(folder)]
            number = max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit()), default=0)
        if number == 0:
            return Version()
        target, files = self._hadoop(self._name(number))
        stream = files.open(target)
        try:
            return Version.from_text(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, version: Version) -> bool:
        """Write a version under its number, unless another writer has done so."""
        place = self._name(version.number)
        target, files = self._hadoop(place)
        draft, _ = self._hadoop(f"{self.path}/versions/_{uuid.uuid4().hex}")
        stream = files.create(draft)
        stream.write(bytearray(version.to_text().encode()))
        stream.close()
        try:
            if files.getUri().getScheme() != "file":
                return not files.exists(target) and files.rename(draft, target)
            os.link(draft.toUri().getPath(), target.toUri().getPath())
            return True
        except FileExistsError:
            return False
        finally:
            files.delete(draft, False)

    def _change(self, step: Callable[[Version], Version | None]) -> Version:
        """Publish what a step makes of the newest version; repeat it on a newer one if another writer was first."""
        while True:
            now = self.version()
            if now.batch:
                self._mark(now.batch)  # before the version that names it stops being the newest
            then = step(now)
            if then is None:
                return now
            then = replace(then, number=now.number + 1)
            if self._publish(then):
                return then

    def _mark(self, batch: str) -> None:
        target, files = self._hadoop(f"{self.path}/batches/{batch}")
        if not files.exists(target):
            files.create(target, True).close()

    def _is_done(self, batch: str) -> bool:
        return self.version().batch == batch or path_exists(self.spark, f"{self.path}/batches/{batch}")

    # --- writing ------------------------------------------------------------------------------------------------------

    def append(self, batch: DataFrame, key: str) -> tuple[int, int]:
        """Append a batch; (first id, last id) of its rows.

        The key names the batch for good: one that is there already is not
        appended again. Ids in the batch are ignored. A NULL in a required
        column fails the write.
        """
        if self._is_done(key):
            return (0, 0)
        staged, counts = self._numbered(checked_rows(batch).drop("id"))
        n = sum(r["n"] for r in counts)

        def reserve(now: Version) -> Version | None:
            if key in now.reserved:
                return None
            return replace(now, batch="", greatest_id=now.greatest_id + n, reserved={**now.reserved, key: (now.greatest_id, n)})

        first, promised = self._change(reserve).reserved[key]
        if promised != n:
            raise HistoryError(f"batch {key} had {promised} rows when it was begun, now {n}")
        before, offsets = first, []
        for r in sorted(counts, key=lambda r: r["part"]):
            offsets.append((r["part"], before))
            before += r["n"]
        bases = self.spark.createDataFrame(offsets, "part int, base long")
        rows = staged.join(F.broadcast(bases), "part").select(
            (F.col("base") + F.col("place") + 1).alias("id"), *[f.name for f in HISTORY_SCHEMA if f.name != "id"])
        files = self._write(rows, f"batch-{key}", n)
        added = _summed(staged)

        def commit(now: Version) -> Version | None:
            if key not in now.reserved:
                return None
            left = {k: v for k, v in now.reserved.items() if k != key}
            return replace(now, batch=key, reserved=left, files=now.files + files, totals=_merged(now.totals, added))

        self._change(commit)
        self._mark(key)
        return first + 1, first + n

    @staticmethod
    def _numbered(rows: DataFrame) -> tuple[DataFrame, list]:
        """Rows in their final order, with partition and place in it, and the number of rows per partition."""
        order = ["created_at", F.xxhash64(*rows.columns), "user_id", "command", "input_text", "output_text"]
        part = F.spark_partition_id()
        placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
            "*", part.alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place"))
        staged = materialize(placed, "history-batch")
        return staged, staged.groupBy("part").agg(F.count("*").alias("n")).collect()

    def _write(self, rows: DataFrame, name: str, n: int) -> tuple[DataFile, ...]:
        """Write rows as clustered files below a folder of their own; what the files hold."""
        if not n:
            return ()
        target = f"{self.path}/data/{name}"
        micros = F.unix_micros("created_at")
        low, high = rows.agg(F.min(micros), F.max(micros)).first()
        share = (micros - F.lit(low)) / F.lit(max(high - low, 1))
        curve = _interleaved(_bucket(F.col("user_id")), F.floor(share * ((1 << _BITS) - 1)).cast("int"), _bucket(F.col("command")))
        curve_name, values = "\u2063curve", str(min(n, self.rows_per_file))
        spread = rows.withColumn(curve_name, curve).repartitionByRange(-(-n // self.rows_per_file), curve_name)
        (
            spread.sortWithinPartitions(curve_name).drop(curve_name).write.mode("overwrite")
            .option("parquet.bloom.filter.enabled#user_id", "true").option("parquet.bloom.filter.enabled#command", "true")
            # Else each filter takes its greatest size, a megabyte, in a file of any size.
            .option("parquet.bloom.filter.expected.ndv#user_id", values).option("parquet.bloom.filter.expected.ndv#command", values)
            .parquet(target)
        )
        user, command = _bucket(F.col("user_id")), _bucket(F.col("command"))
        written = self.spark.read.schema(HISTORY_SCHEMA).parquet(target).groupBy(file_of_line().alias("file")).agg(
            F.count("*"), F.count_if(F.col("success") == 0), F.min(user), F.max(user), F.min(command), F.max(command),
            F.min(micros), F.max(micros))
        return tuple(
            DataFile(f"data/{name}/" + r[0].rsplit("/", 1)[1], r[1], r[2], (r[3], r[4]), (r[5], r[6]), (r[7], r[8]))
            for r in sorted(written.collect()))

    def _replaced(self, gone: tuple[DataFile, ...], files: tuple[DataFile, ...], removed: dict[str, Totals]) -> None:
        def step(now: Version) -> Version:
            if not set(gone) <= set(now.files):
                raise Conflict("files were replaced by another writer")
            kept = tuple(f for f in now.files if f not in set(gone))
            return replace(now, batch="", files=kept + files, totals=_merged(now.totals, removed, -1))

        self._change(step)

    def delete(self, user_id: str | None = None) -> int:
        """Remove all rows, or those of a user; how many went. Only files that hold the user are written anew."""
        while True:
            now = self.version()
            if user_id is None:
                gone, files, removed, n = now.files, (), now.totals, now.rows
            else:
                mine = F.col("user_id") == user_id
                holding = self._read(self._near(now, "user", user_id)).where(mine)
                names = {r[0].rsplit("/", 1)[1] for r in holding.select(file_of_line()).distinct().collect()}
                gone = tuple(f for f in now.files if f.path.rsplit("/", 1)[1] in names)
                removed = _summed(holding) if gone else {}
                n = sum(t.rows for t in removed.values())
                rest = self._read(gone).where(~mine)
                files = self._write(rest, f"rewrite-{uuid.uuid4().hex}", sum(f.rows for f in gone) - n)
            if not gone:
                return 0
            try:
                self._replaced(gone, files, removed)
                return n
            except Conflict:
                continue

    def compact(self) -> int:
        """Write small files anew as few large ones; how many files there are less."""
        now = self.version()
        small = tuple(f for f in now.files if f.rows < self.rows_per_file // 2)
        if len(small) < 2:
            return 0
        files = self._write(self._read(small), f"rewrite-{uuid.uuid4().hex}", sum(f.rows for f in small))
        self._replaced(small, files, {})
        return len(small) - len(files)

    def expire(self) -> int:
        """Delete versions before the newest one, and files that it does not list; how many files went.

        Not while other writers are at work, whose files no version lists yet.
        """
        now = self.version()
        listed = {f.path for f in now.files}
        folder, files = self._hadoop(f"{self.path}/data")
        n = 0
        for number in range(now.number - 1, 0, -1):
            if not path_exists(self.spark, self._name(number)):
                break
            drop_path(self.spark, self._name(number))
        for place in files.listStatus(folder) if files.exists(folder) else ():
            for status in files.listStatus(place.getPath()):
                name = status.getPath().getName()
                if name.endswith(".parquet") and f"data/{place.getPath().getName()}/{name}" not in listed:
                    files.delete(status.getPath(), False)
                    n += 1
        return n

    # --- reading ------------------------------------------------------------------------------------------------------

    def _read(self, files: tuple[DataFile, ...]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], HISTORY_SCHEMA)
        return self.spark.read.schema(HISTORY_SCHEMA).parquet(*[f"{self.path}/{f.path}" for f in files])

    def read(self, number: int | None = None) -> DataFrame:
        return self._read(self.version(number).files)

    def _near(self, version: Version, dimension: str, value: str) -> tuple[DataFile, ...]:
        """The files that may hold a user or command."""
        bucket = self.spark.range(1).select(_bucket(F.lit(value))).first()[0]
        return tuple(f for f in version.files if getattr(f, dimension)[0] <= bucket <= getattr(f, dimension)[1])

    @staticmethod
    def _newest(files: tuple[DataFile, ...], limit: int, rows: Callable[[DataFile], int]) -> tuple[DataFile, ...]:
        """The files that can hold any of the newest rows: those that end after enough others have begun."""
        seen, since = 0, None
        for f in sorted(files, key=lambda f: f.time[0], reverse=True):
            seen, since = seen + rows(f), f.time[0]
            if seen >= limit:
                break
        return tuple(f for f in files if since is not None and f.time[1] >= since)

    def recent(self, limit: int = RECENT_LIMIT) -> DataFrame:
        files = self.version().files
        return recent(self._read(self._newest(files, limit, lambda f: f.rows)), limit)

    def failures(self, limit: int = FAILURE_LIMIT) -> DataFrame:
        files = tuple(f for f in self.version().files if f.failed)
        return failures(self._read(self._newest(files, limit, lambda f: f.failed)), limit)

    def by_user(self, user_id: str, limit: int = USER_LIMIT) -> DataFrame:
        return by_user(self._read(self._near(self.version(), "user", user_id)), user_id, limit)

    def by_command(self, command: str, limit: int = COMMAND_LIMIT) -> DataFrame:
        return by_command(self._read(self._near(self.version(), "command", command)), command, limit)

    def totals(self) -> DataFrame:
        """As `history.totals`, from the version alone."""
        every = Totals()
        for t in self.version().totals.values():
            every = every.plus(t)
        n = max(every.rows, 1)
        row = (every.rows, every.succeeded, every.failed, every.nanoseconds / _NANOS / n, every.milliseconds / n)
        return self.spark.createDataFrame([row], (
            "total_commands bigint, successful_commands bigint, failed_commands bigint, average_execution_time double, "
            "average_duration_ms double"))

    def by_type(self) -> DataFrame:
        rows = sorted(((c, t.rows) for c, t in self.version().totals.items() if t.rows), key=lambda r: (-r[1], r[0]))
        return self.spark.createDataFrame(rows, "command string, n bigint")


def _merged(totals: dict[str, Totals], other: dict[str, Totals], sign: int = 1) -> dict[str, Totals]:
    return {c: totals.get(c, Totals()).plus(other.get(c, Totals()), sign) for c in {**totals, **other}}
