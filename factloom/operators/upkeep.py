"""A merged store that follows its sources: one that changes rewrites only what it touches.

Source tables and merged tables are partitioned by a hash of the key that the merge rule
compares, so a key's rows of all sources lie in partitions of one number. When a source
comes again, its rows are compared with those it had, partition by partition, by count and
checksum. Only partitions that differ are merged anew, from all sources, and overwritten;
files of the others stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.merge import (
    KEY,
    REPO_EDGE_KEY,
    merge_analyses,
    merge_children,
    merge_repo_dependencies,
    merge_summaries,
)
from factloom.sources.schemas import TABLES, align

PARTS = 64
KEYS = {
    "pr_analyses": KEY, "facts": KEY, "dependencies": KEY, "repo_summaries": ["repo"], "repo_dependencies": REPO_EDGE_KEY,
}
# Tables that are merged together: an analysis decides about the facts and edges of its key.
GROUPS = (("pr_analyses", "facts", "dependencies"), ("repo_summaries",), ("repo_dependencies",))


def part_of(name: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(*KEYS[name]), F.lit(parts)).cast("int").alias("part")


@dataclass(frozen=True)
class MergedStore:
    """``path`` holds the versions of every source, the merged tables, and a commit row per change."""

    spark: SparkSession
    path: str
    # Partitions of every table; a store keeps the number it was begun with.
    parts: int = PARTS

    def put(self, source: int, tables: dict[str, DataFrame]) -> dict[str, list[int]]:
        """Store a source (its number is its priority) and bring the merged tables up to date.

        Gives the partitions that were rewritten, by group of tables. A run that stops half
        way is made good by the next one: versions count once their commit row is written,
        and until then every partition that differs is merged again.
        """
        versions = self._versions()
        number = versions[source] + 1 if source in versions else 0
        for name in tables.keys() & TABLES.keys():
            rows = align(tables[name], name, self.spark).select(*TABLES[name].names)
            self._write(rows.withColumn("part", part_of(name, self.parts)), self._place(source, number, name), "overwrite")
        current, rewritten = {**versions, source: number}, {}
        for group in GROUPS:
            changed = sorted(self._differing(source, versions.get(source), number, group))
            if changed:
                self._merge(group, changed, current)
            rewritten[group[0]] = changed
        row = self.spark.createDataFrame([(source, number)], "source int, version int")
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        return rewritten

    def tables(self) -> dict[str, DataFrame]:
        """The merged tables; every row has the number of its source as ``src_ord``."""
        found = {}
        for name in TABLES:
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in TABLES[name])
            try:
                rows = self.spark.read.schema(f"{schema}, src_ord int, part int").parquet(f"{self.path}/merged/{name}")
            except AnalysisException:  # no source has had rows of this table
                rows = self.spark.createDataFrame([], f"{schema}, src_ord int, part int")
            found[name] = rows.where("src_ord >= 0").drop("part")
        return found

    def _versions(self) -> dict[int, int]:
        """The committed version of every source, one row each."""
        try:
            rows = self.spark.read.schema("source int, version int").parquet(f"{self.path}/commits")
        except AnalysisException:
            return {}
        return {row["source"]: row["version"] for row in rows.groupBy("source").agg(F.max("version").alias("version")).collect()}

    def _place(self, source: int, number: int, name: str) -> str:
        return f"{self.path}/sources/{source}/{number}/{name}"

    def _write(self, rows: DataFrame, path: str, mode: str) -> None:
        """Rows in folders by part; files follow sizes, and only folders that get rows are replaced."""
        writer = rows.hint("rebalance", "part").write.option("partitionOverwriteMode", "dynamic").mode(mode)
        writer.partitionBy("part").parquet(path)

    def _read(self, source: int, number: int, name: str) -> DataFrame | None:
        """A table of a version; None if the source does not have it."""
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in TABLES[name])
        try:
            return self.spark.read.schema(f"{schema}, part int").parquet(self._place(source, number, name))
        except AnalysisException:
            return None

    def _sums(self, source: int, number: int | None, name: str) -> dict[int, tuple]:
        """Count and checksum of every part, one row each."""
        if number is None:
            return {}
        rows = self._read(source, number, name)
        if rows is None:
            return {}
        check = F.sum(F.xxhash64(*TABLES[name].names).cast("decimal(20, 0)")).alias("check")
        return {row["part"]: (row["n"], row["check"]) for row in rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), check).collect()}

    def _differing(self, source: int, before: int | None, number: int, group: tuple[str, ...]) -> set[int]:
        found = set()
        for name in group:
            old, new = self._sums(source, before, name), self._sums(source, number, name)
            found |= {part for part in old.keys() | new.keys() if old.get(part) != new.get(part)}
        return found

    def _merge(self, group: tuple[str, ...], changed: list[int], current: dict[int, int]) -> None:
        united = {}
        for name in group:
            rows = align(None, name, self.spark).withColumn("src_ord", F.lit(0))
            for source, number in sorted(current.items()):
                own = self._read(source, number, name)
                if own is None:
                    continue
                own = own.where(F.col("part").isin(changed))
                own = own.drop("part").withColumn("src_ord", F.lit(source))
                rows = rows.unionByName(own)
            united[name] = rows
        rules = {
            "pr_analyses": lambda rows: merge_analyses(rows),
            "facts": lambda rows: merge_children(rows, united["pr_analyses"], "fact_id"),
            "dependencies": lambda rows: merge_children(rows, united["pr_analyses"], "dep_id"),
            "repo_summaries": lambda rows: merge_summaries(rows),
            "repo_dependencies": lambda rows: merge_repo_dependencies(rows),
        }
        # A row without a source in every part, so that a part that has become empty is overwritten too.
        marks = self.spark.createDataFrame([(part, -1) for part in changed], "part int, src_ord int")
        for name in group:
            merged = rules[name](united[name]).withColumn("part", part_of(name, self.parts))
            self._write(merged.unionByName(marks, allowMissingColumns=True), f"{self.path}/merged/{name}", "overwrite")
