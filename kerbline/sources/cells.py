"""A keyed Parquet table of which an upsert rewrites only the cells it touches.

A cell holds the rows with one value of a flag and one hash bucket of the key. Every upsert
writes one new folder, with the changed rows and what stays of the cells that lost a row;
rows that only come in are added to their cell as one more file. Then the view over all live
cell folders is replaced, in one catalogue update: a job that dies before it leaves the old
view, whose files are never touched, and a folder that no view reads.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Folders a cell may consist of before an upsert that adds to it rewrites it as one.
MOST_FOLDERS = 16

_FLAG, _BUCKET = "__flag", "__bucket"


@dataclass(frozen=True)
class CellTable:
    """``name`` is the view to read, ``folder`` the place of its files (one that all executors share)."""

    spark: SparkSession
    name: str
    folder: str
    key: str
    flag: str
    buckets: int = 512

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def _cell(self) -> dict[str, Column]:
        """Flag and bucket of a row; a NULL flag counts as false."""
        return {_FLAG: F.coalesce(F.col(self.flag), F.lit(False)).cast("int"),
                _BUCKET: F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")}

    def live(self) -> dict[tuple[int, int], list[str]]:
        """Folders of each cell that the view reads, from the files it names."""
        found: dict[tuple[int, int], set[str]] = {}
        for file in self.read().inputFiles() if self.exists() else ():
            place = file.rpartition("/")[0]
            flag, bucket = (int(part.partition("=")[2]) for part in place.split("/")[-2:])
            found.setdefault((flag, bucket), set()).add(place)
        return {cell: sorted(places) for cell, places in found.items()}

    def upsert(self, changed: DataFrame) -> dict[str, int]:
        """Put the rows of ``changed`` (unique by key) in, in place of those with the same keys.

        Returns how many cells there are, were rewritten and were added to. ``changed`` is
        written to the new folder before anything else, so it may read the table itself.
        """
        segment = f"{self.folder.rstrip('/')}/{uuid.uuid4().hex}"
        staged_at = f"{segment}/staged"
        changed.withColumns(self._cell()).write.parquet(staged_at)
        staged = self.spark.read.parquet(staged_at)
        coming = {(r[0], r[1]) for r in staged.select(_FLAG, _BUCKET).distinct().collect()}  # at most one a cell
        if not coming:
            if not self.exists():
                first = f"{segment}/cells/{_FLAG}=0/{_BUCKET}=0"  # one file without rows has the schema
                staged.drop(_FLAG, _BUCKET).coalesce(1).write.parquet(first)
                self._switch([first], staged)
            self._delete(staged_at)
            return {"cells": len(self.live()), "rewritten": 0, "added_to": 0}
        live = self.live()
        near = [p for (_, bucket), places in live.items() if bucket in {b for _, b in coming} for p in places]
        losing: set[tuple[int, int]] = set()
        if near:
            held = self.spark.read.schema(self.read().schema).parquet(*near).select(self.key, self.flag).withColumns(self._cell())
            lost = held.join(staged.select(self.key), self.key, "left_semi").select(_FLAG, _BUCKET).distinct()
            losing = {(r[0], r[1]) for r in lost.collect()}
        losing |= {cell for cell in coming if len(live.get(cell, ())) >= MOST_FOLDERS}
        rows = staged
        old = [p for cell in losing for p in live.get(cell, ())]
        if old:
            stays = self.spark.read.schema(self.read().schema).parquet(*old).join(staged.select(self.key), self.key, "left_anti")
            rows = staged.unionByName(stays.withColumns(self._cell()))
        self._write(rows, segment)
        kept = [p for cell, places in live.items() if cell not in losing for p in places]
        fresh = self._folders(f"{segment}/cells")
        self._switch([*kept, *fresh], staged)
        self._delete(staged_at)
        return {"cells": len(set(live) | coming), "rewritten": len(losing), "added_to": len(coming - losing)}

    def _write(self, rows: DataFrame, segment: str) -> None:
        # One task per cell, else every task leaves a file in every cell.
        dealt = rows.repartition(_FLAG, _BUCKET).sortWithinPartitions(_FLAG, _BUCKET, self.key)
        dealt.write.partitionBy(_FLAG, _BUCKET).parquet(f"{segment}/cells")

    def _switch(self, folders: list[str], like: DataFrame) -> None:
        columns = [c for c in like.columns if c not in (_FLAG, _BUCKET)]
        roots = [self._plain(f) for f in sorted(folders)]
        at = roots[0] if len(roots) == 1 else "/{" + ",".join(r.lstrip("/") for r in roots) + "}"
        listed = ", ".join(f"`{c}`" for c in columns)
        self.spark.sql(f"CREATE OR REPLACE VIEW {self.name} AS SELECT {listed} FROM parquet.`{self._scheme()}{at}`")

    # -- files -------------------------------------------------------------------------

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _scheme(self) -> str:
        target, fs = self._fs(self.folder)
        root = fs.makeQualified(target).toUri()
        return f"{root.getScheme()}://{root.getAuthority() or ''}"

    def _plain(self, path: str) -> str:
        return self._fs(path)[0].toUri().getPath()

    def _folders(self, root: str) -> list[str]:
        """The cell folders under a written folder."""
        target, fs = self._fs(root)
        return [str(cell.getPath()) for flag in fs.listStatus(target) if flag.isDirectory()
                for cell in fs.listStatus(flag.getPath()) if cell.isDirectory()]

    def _delete(self, path: str) -> None:
        target, fs = self._fs(path)
        fs.delete(target, True)

    def sizes(self) -> dict[str, int]:
        """Bytes of every live file."""
        out = {}
        for file in self.read().inputFiles():
            target, fs = self._fs(file)
            out[file] = fs.getFileStatus(target).getLen()
        return out

    def vacuum(self) -> int:
        """Delete the segment folders of which the view reads nothing; returns how many.

        Only while no upsert runs and no reader still holds an older view.
        """
        used = {self._plain(p).split("/cells/")[0] for places in self.live().values() for p in places}
        target, fs = self._fs(self.folder)
        idle = [s.getPath() for s in fs.listStatus(target) if s.isDirectory() and s.getPath().toUri().getPath() not in used]
        for path in idle:
            fs.delete(path, True)
        return len(idle)
