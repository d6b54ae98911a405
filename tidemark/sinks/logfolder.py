"""A log that many runs write to at once: one folder per write, merged by size now and then.

A merge writes the rows of several folders to a new one and then one numbered file that says which folders it
stands for. Two runs that merge at once want the same number, so one of them is told; its folder is in no
file and is never read. Folders that a merge stands for are removed by the next merge.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.sinks import storage

#: Folders of about one size that are merged into one.
FAN = 16


@dataclass(frozen=True)
class LogFolder:
    spark: SparkSession
    path: str
    schema: T.StructType

    def _merges(self) -> list[dict]:
        names = [n for n in storage.children(self.spark, f"{self.path}/_merged") if n.endswith(".json")]
        return [json.loads(storage.read_text(self.spark, f"{self.path}/_merged/{n}")) for n in names[-1:]]

    def _state(self) -> tuple[int, dict[str, int], list[str]]:
        """The last merge's number, the merged folders (with the power of ``FAN`` of writes they hold) and what all merges stand for."""
        last = self._merges()
        return (last[0]["number"], last[0]["merged"], last[0]["gone"]) if last else (0, {}, [])

    def folders(self) -> dict[str, int]:
        """The folders that hold the log now, with the tier of each."""
        _, merged, gone = self._state()
        # a folder that is still being written has no mark yet
        done = [p.split("/")[-2] for p in storage.matching(self.spark, f"{self.path}/write=*/_SUCCESS")]
        single = [n for n in done if n not in gone]
        return {**{n: 0 for n in single if not n.startswith("write=m")}, **merged}

    def read(self) -> DataFrame | None:
        """All rows, or None if nothing was written yet."""
        names = self.folders()
        if not names:
            return None
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{n}" for n in sorted(names)])

    def append(self, rows: DataFrame) -> None:
        rows.select(*[f"`{n}`" for n in self.schema.names]).coalesce(1).write.parquet(f"{self.path}/write={uuid.uuid4().hex}")
        self.merge()

    def merge(self) -> int:
        """One merge of a tier that has ``FAN`` folders, if one has; returns how many were merged."""
        number, merged, gone = self._state()
        tiers: dict[int, list[str]] = {}
        for name, tier in self.folders().items():
            tiers.setdefault(tier, []).append(name)
        full = [t for t in sorted(tiers) if len(tiers[t]) >= FAN]
        if not full:
            return 0
        tier = full[0]
        names, new = sorted(tiers[tier]), f"write=m{uuid.uuid4().hex}"
        for name in gone:  # of the merge before this one
            storage.purge(self.spark, f"{self.path}/{name}")
        left = [n for n in gone if storage.exists(self.spark, f"{self.path}/{n}")]
        self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{n}" for n in names]).coalesce(1 + len(names) * FAN**tier // 100_000).write.parquet(f"{self.path}/{new}")
        state = {"number": number + 1, "merged": {**{n: t for n, t in merged.items() if n not in names}, new: tier + 1}, "gone": names + left}
        if not storage.publish_text(self.spark, f"{self.path}/_merged/{number + 1:012d}.json", json.dumps(state)):
            storage.purge(self.spark, f"{self.path}/{new}")
            return 0
        return len(names)
