"""One entry point over a folder of session tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.operators import search as _search
from logweave.operators.sweep import state_at
from logweave.plans import call_queries, registry, session_queries
from logweave.sources.sinks import json_documents, write_csv


class Engine:
    """Named analyses, search, replay and export over the tables in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def names(self) -> list[str]:
        return sorted(registry.queries())

    def insight(self, name: str) -> DataFrame:
        return registry.queries()[name](self.spark, self.folder)

    def runs(self) -> DataFrame:
        return self.insight("run_totals")

    def agents(self) -> DataFrame:
        return self.insight("assembled_agents")

    def edges(self) -> DataFrame:
        return self.insight("artifact_edges")

    def fleet(self) -> DataFrame:
        return self.insight("fleet_ranking")

    def compare(self) -> DataFrame:
        return self.insight("compare_sessions")

    def calls(self, query: str = "", failed_only: bool = False, limit: int = 300) -> DataFrame:
        """Calls that hold every word of ``query``, alike ones together; without words only the failed ones may be asked for."""
        rows = call_queries.calls(self.spark, self.folder)
        return _search.search_calls(rows, ["name", "target"], query, ["transcript_id", "tool"], "seq", "ok", limit, failed_only=failed_only)

    def status(self) -> DataFrame:
        return self.insight("agent_status")

    def state_at(self, micros: int) -> DataFrame:
        return state_at(session_queries.rounds(self.spark, self.folder).where("s is not null"), "s", "e", F.lit(micros))

    def search(self, query: str, limit: int = 12) -> DataFrame:
        agents = session_queries.agents(self.spark, self.folder)
        hit = _search.matches(F.concat_ws("\n", "agent_type", "description", "brief", "result"), query)
        return agents.where(hit).orderBy("agent_id").limit(limit)

    def export(self, name: str, kind: str, path: str) -> None:
        df = self.insight(name)
        if kind == "csv":
            write_csv(df, path, df.columns)
        else:
            json_documents(df, df.columns[0]).select("document").write.mode("overwrite").text(path)
