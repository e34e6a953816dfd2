"""A table kept in versions: a commit writes new files and, last, the file that names them.

Rows belong to parts by an expression on them, and a version is a list of folders, one for each
part. A commit reads and rewrites only the parts its changes touch; all others are the same
folders as before. Whoever reads a version has it whole, also while another one is written, and
a commit that dies leaves the version before. The list is as long as there are parts, whatever
their size, so an expression with a bounded number of values a day is what it is made for.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strikeline.sources import files

_PART = "_part"


@dataclass(frozen=True)
class Version:
    number: int
    folders: dict[str, str] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)


def replaced(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of ``changes`` in place of those with their key, and those with a new key."""
    return old.join(changes.select(key), key, "left_anti").unionByName(changes)


class VersionedTable:
    """``key`` is unique; ``part`` says where a row lies and never changes for a key. Its values
    name folders: letters, digits and hyphens."""

    def __init__(
        self, spark: SparkSession, root: str, schema: StructType, key: str, part: Column
    ) -> None:
        self._spark, self._root, self._schema = spark, root.rstrip("/"), schema
        self._key, self._part = key, part.cast("string")

    # --- reading ---

    def numbers(self) -> list[int]:
        """Versions that can be read, oldest first."""
        there = files.names(self._spark, f"{self._root}/versions")
        return sorted(int(n) for n in there if n.isdigit())

    def version(self, number: int | None = None) -> Version:
        """The newest version, or a given one; number 0 without any."""
        there = self.numbers()
        if not there and number is None:
            return Version(0)
        number = there[-1] if number is None else number
        text = files.read_text(self._spark, f"{self._root}/versions/{number:012d}")
        return Version(**json.loads(text))

    def read(self, number: int | None = None) -> DataFrame:
        return self._rows(list(self.version(number).folders.values()))

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self._spark.createDataFrame([], self._schema)
        return self._spark.read.schema(self._schema).parquet(
            *[f"{self._root}/data/{f}" for f in folders]
        )

    # --- writing ---

    def commit(
        self, changes: DataFrame,
        merge: Callable[[DataFrame, DataFrame, str], DataFrame] = replaced,
        batch: tuple[str, int] | None = None,
    ) -> Version:
        """Write the next version: ``merge`` gets the rows of the touched parts, the changes and
        the key. ``changes`` is read twice and has the columns that ``part`` needs. ``batch``:
        name and number of a stream's batch; one that is not newer than the last committed batch
        of that name changes nothing."""
        base = self.version()
        if batch and base.batches.get(batch[0], -1) >= batch[1]:
            return base
        placed = changes.withColumn(_PART, self._part)
        touched = [r[0] for r in placed.select(_PART).distinct().collect()]
        before = self._rows([base.folders[p] for p in touched if p in base.folders])
        written = f"{base.number + 1:012d}-{uuid.uuid4().hex}"
        after = merge(before, changes, self._key)
        (
            after.select(*self._schema.names).withColumn(_PART, self._part)
            .repartition(_PART).sortWithinPartitions(_PART, self._key)
            .write.partitionBy(_PART).parquet(f"{self._root}/data/{written}")
        )
        parts = {
            n: n.split("=", 1)[1] for n in files.names(self._spark, f"{self._root}/data/{written}")
            if n.startswith(f"{_PART}=")
        }
        folders = {p: f for p, f in base.folders.items() if p not in touched}
        folders |= {p: f"{written}/{n}" for n, p in parts.items()}
        following = Version(
            base.number + 1, folders, base.batches | ({batch[0]: batch[1]} if batch else {})
        )
        self._publish(following)
        return following

    def _publish(self, version: Version) -> None:
        """The last step: of two commits on one version, the second fails here."""
        files.create_whole(
            self._spark, f"{self._root}/versions/{version.number:012d}", json.dumps(vars(version))
        )

    def prune(self, keep: int = 2, grace_seconds: float = 3600) -> None:
        """Remove all but the newest ``keep`` versions and the files that none of these names,
        also those of commits that died, unless they are younger than the grace time."""
        there = self.numbers()
        kept = there[-keep:]
        for number in there[: -keep]:
            files.remove(self._spark, f"{self._root}/versions/{number:012d}")
        named = {f for n in kept for f in self.version(n).folders.values()}
        used = {f.split("/")[0] for f in named}
        now = int(time.time() * 1000)
        for name in files.names(self._spark, f"{self._root}/data"):
            path = f"{self._root}/data/{name}"
            if name in used:
                for part in files.names(self._spark, path):
                    if part.startswith(f"{_PART}=") and f"{name}/{part}" not in named:
                        files.remove(self._spark, f"{path}/{part}")
            elif files.age_ms(self._spark, path, now) >= 1000 * grace_seconds:
                files.remove(self._spark, path)


def trade_part(span: str = "day", buckets: int = 1) -> Column:
    """Part of a trade: its entry day or ``month``, and one of ``buckets`` of its UID, which is
    how many tasks write a span. Exits touch the spans of the trades they close, mostly the
    last ones; a long history of few trades is better kept by months."""
    bucket = F.pmod(F.xxhash64("UID"), F.lit(buckets)).cast("string")
    pattern = {"day": "yyyyMMdd", "month": "yyyyMM"}[span]
    return F.concat_ws("-", F.date_format("T_DATE", pattern), bucket)
