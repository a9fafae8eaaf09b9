"""Compaction: the small parts of a stream become few packs, and readers see the same rows throughout.

Below the folder of one stream lie its part folders, one per batch, and two hidden folders:
``_packs/<name>/rows`` holds the rows of many parts, each with its ``part``, ``_packs/<name>/parts``
the names of those parts, and ``_manifest/<number>`` says which packs count. A manifest counts
once it is complete, and the greatest number holds.

- A part folder that stands complete counts, not what a pack holds of that part. So nothing doubles
  between a manifest and the removal of the folders it replaces, and a batch that is written again
  after it was packed replaces its rows as before. Such a part stays a folder.
- What a manifest replaces is removed by the compaction after it, so a reader that began before
  the manifest can finish.
- Packs have levels: as soon as ``fan`` packs share a level they become one of the next, so a row
  is rewritten as often as there are levels and the packs stay few.

One stream compacts its own folder, between its batches, so there is one writer.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from siftline.session import drop_path, files_below

FAN = 8
_MANIFEST = "kind STRING, name STRING, level INT, files ARRAY<STRING>"


@dataclass(frozen=True)
class Layout:
    """How the parts of a table are stored."""

    schema: str
    format: str = "parquet"
    options: dict[str, str] = field(default_factory=dict)

    def read(self, spark: SparkSession, paths: list[str], more: str = "") -> DataFrame:
        reader = spark.read.schema(self.schema + more).format(self.format).options(**self.options)
        return reader.load(paths)

    def write(self, rows: DataFrame, path: str) -> None:
        writer = rows.hint("rebalance").write.mode("overwrite").format(self.format)
        writer.options(**self.options).option("ignoreNullFields", "false").save(path)


@dataclass(frozen=True)
class _Manifest:
    number: int = 0
    packs: dict[str, int] = field(default_factory=dict)
    replaced: dict[str, list[str]] = field(default_factory=dict)


def complete_parts(names: list[str]) -> dict[str, list[str]]:
    """Part folders whose write came to its end, with the names of their data files."""
    folders: dict[str, list[str]] = {}
    for name in names:
        folder, _, file = name.rpartition("/")
        if folder and not any(step[:1] in "_." for step in folder.split("/")):
            folders.setdefault(folder, []).append(file)
    return {
        folder: sorted(f for f in files if f[:1] not in "_.")
        for folder, files in folders.items()
        if "_SUCCESS" in files
    }


def _manifests(names: list[str]) -> dict[str, int]:
    """The newest complete manifest of each folder that has one."""
    newest: dict[str, int] = {}
    for name in names:
        if found := re.fullmatch(r"(?:(.*)/)?_manifest/([0-9]+)/_SUCCESS", name):
            folder, number = found[1] or "", int(found[2])
            newest[folder] = max(number, newest.get(folder, 0))
    return newest


def _read_manifest(spark: SparkSession, folder: str, number: int) -> _Manifest:
    """A row per pack, and one per part that the newest pack replaced."""
    rows = spark.read.schema(_MANIFEST).parquet(f"{folder}/_manifest/{number}").collect()
    return _Manifest(
        number,
        {r.name: r.level for r in rows if r.kind == "pack"},
        {r.name: sorted(r.files) for r in rows if r.kind == "replaced"},
    )


def _packed(spark: SparkSession, folder: str, packs: list[str], layout: Layout) -> DataFrame:
    return layout.read(spark, [f"{folder}/_packs/{p}/rows" for p in packs], ", part STRING")


def read_parts(spark: SparkSession, path: str, layout: Layout) -> DataFrame:
    """All rows of a table, from packs and parts; no rows while nothing was written.

    Parts that a writer has not finished, or has begun to write anew, are left
    out; of the latter a pack's rows count until the new ones stand.
    """
    names = files_below(spark, path)
    parts = complete_parts(names)
    out = spark.createDataFrame([], layout.schema)
    if parts:
        out = layout.read(spark, [f"{path}/{p}" for p in parts])
    for below, number in _manifests(names).items():
        folder = f"{path}/{below}" if below else path
        packs = list(_read_manifest(spark, folder, number).packs)
        if not packs:
            continue
        standing = [p.rpartition("/")[2] for p in parts if p.rpartition("/")[0] == below]
        rows = _packed(spark, folder, packs, layout)
        if standing:  # as many as the parts since the last compaction but one
            rows = rows.where(~F.col("part").isin(standing))
        out = out.unionByName(rows.drop("part"))
    return out


def compact(
    spark: SparkSession,
    folder: str,
    layout: Layout,
    ready: Callable[[str], bool] = lambda part: True,
    fan: int = FAN,
) -> int:
    """Pack the complete parts right below ``folder`` whose name is ``ready``; how many were packed.

    First removes what the compaction before replaced. Cut at any point it
    leaves the rows as they were; the next call goes on from there.
    """
    names = files_below(spark, folder)
    number = _manifests(names).get("", 0)
    old = _read_manifest(spark, folder, number) if number else _Manifest()
    parts = {p: files for p, files in complete_parts(names).items() if "/" not in p}
    for part, files in old.replaced.items():
        if parts.get(part) == files:  # not written again since
            drop_path(spark, f"{folder}/{part}")
            del parts[part]
    for stray in {n.split("/")[1] for n in names if n.startswith("_packs/")} - set(old.packs):
        drop_path(spark, f"{folder}/_packs/{stray}")

    chosen = {p: f for p, f in parts.items() if ready(p) and re.fullmatch("[A-Za-z0-9=.-]+", p)}
    if chosen and old.packs:
        index = spark.read.schema("part STRING").parquet(*[f"{folder}/_packs/{p}/parts" for p in old.packs])
        for row in index.where(F.col("part").isin(list(chosen))).distinct().collect():
            del chosen[row.part]
    if not chosen:
        return 0

    def write(level: int, rows: DataFrame, own: DataFrame) -> str:
        name = f"{number + 1}-{level}-{uuid.uuid4().hex[:8]}"
        layout.write(rows, f"{folder}/_packs/{name}/rows")
        own.coalesce(1).write.parquet(f"{folder}/_packs/{name}/parts")
        return name

    source = F.regexp_extract("_metadata.file_path", "([^/]+)/[^/]+$", 1)
    loose = layout.read(spark, [f"{folder}/{p}" for p in chosen]).select("*", source.alias("part"))
    packs = dict(old.packs)
    packs[write(0, loose, spark.createDataFrame([(p,) for p in chosen], "part STRING"))] = 0
    level = 0
    while Counter(packs.values())[level] >= fan:
        merged = [p for p, at in packs.items() if at == level]
        own = spark.read.schema("part STRING").parquet(*[f"{folder}/_packs/{p}/parts" for p in merged])
        name = write(level + 1, _packed(spark, folder, merged, layout), own)
        packs = {p: at for p, at in packs.items() if p not in merged} | {name: level + 1}
        level += 1
    rows = [("pack", p, at, []) for p, at in packs.items()]
    rows += [("replaced", p, None, files) for p, files in chosen.items()]
    manifest = spark.createDataFrame(rows, _MANIFEST).coalesce(1)
    manifest.write.mode("overwrite").parquet(f"{folder}/_manifest/{number + 1}")
    for done in {int(n.split("/")[1]) for n in names if n.startswith("_manifest/")} - {number}:
        if done < number:
            drop_path(spark, f"{folder}/_manifest/{done}")
    return len(chosen)
