"""The questions readers ask, composed from the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.text import clamp
from factloom.operators import catalog, deps, facts as listing
from factloom.operators.index import TextIndex, build_index
from factloom.operators.neardup import collapse_ranked
from factloom.operators.search import MAX_LIMIT, search_many
from factloom.sources.schemas import CATEGORIES
from factloom.sources.sinks import clean_json


@dataclass(frozen=True)
class KnowledgeBase:
    """Merged tables and their index."""

    tables: dict[str, DataFrame]
    text_index: TextIndex

    @classmethod
    def build(cls, tables: dict[str, DataFrame], path: str | None = None) -> KnowledgeBase:
        return cls(tables, build_index(tables["facts"], tables["pr_analyses"], path))

    @property
    def spark(self) -> SparkSession:
        return self.tables["facts"].sparkSession

    def search_facts(self, query: str, collapse: bool = True, **options) -> DataFrame:
        """Ranked facts for one or several ``;``-separated searches, near-duplicates collapsed."""
        found = search_many(self.text_index, self.tables["facts"], self.tables["pr_analyses"], query, **options)
        if collapse:
            found = collapse_ranked(found, groups=("repo",))
        return found.orderBy("place")

    def search_json(self, query: str, **options) -> DataFrame:
        return clean_json(self.search_facts(query, **options), keep=("place",)).orderBy("place")

    def module_facts(self, module_id: str) -> DataFrame:
        return listing.module_facts(listing.project(self.tables["facts"]), module_id)

    def module_facts_json(self, module_id: str) -> DataFrame:
        return clean_json(self.module_facts(module_id), keep=("fact_id",))

    def recent_json(self, category: str | None = None, limit: int = 10) -> DataFrame:
        return clean_json(self.recent_changes(category, limit), keep=("fact_id",))

    def recent_changes(self, category: str | None = None, limit: int = 10) -> DataFrame:
        if category:
            _check_category(category)
        limit = int(clamp(limit, 1, MAX_LIMIT))
        return listing.recent_facts(self.tables["facts"], self.tables["pr_analyses"], category or None, limit)

    def component_impact(self, component: str) -> DataFrame:
        if not component or not component.strip():
            raise ValueError("a component name is required")
        return deps.component_impact(self.tables["dependencies"], component)

    def list_modules(self, repo_name: str | None = None) -> DataFrame:
        if repo_name:
            return catalog.modules_in_repo(self.tables["facts"], repo_name)
        return catalog.repo_overview(self.tables["facts"], self.tables["repo_summaries"])

    def repo_dependencies(self, repo_name: str | None = None, direction: str = "both") -> DataFrame:
        return deps.repo_dependencies(self.tables["repo_dependencies"], repo_name, direction)

    def repo_catalog(self) -> DataFrame:
        """Repositories with summaries, their fact counts and a line of text each."""
        rows = catalog.repo_catalog(self.tables["facts"], self.tables["repo_summaries"])
        line = F.format_string("- %s (%d facts): %s", F.col("repo"), F.col("facts"), F.col("summary"))
        return rows.withColumn("line", line)


def _check_category(category: str) -> None:
    if category not in CATEGORIES:
        raise ValueError(f"category must be one of {', '.join(CATEGORIES)}")
