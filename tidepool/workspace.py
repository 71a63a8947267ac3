"""One user's workspace: followed topics, their models, the registry.

This is the dashboard's flow as an API: subscribe to topics (each once),
ingest their history, define models (at most one per name; defining it again
replaces it), build them from a topic's history or an uploaded CSV, rebuild
them on a timer, score a topic with the newest version, and remove all
models of a topic.  Every step is one of the library's distributed
operators; the workspace only keeps names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from .operators import models as ML
from .operators.registry import ModelRegistry
from .operators.relational import TableStore
from .session import scratch_path
from .sources.topic import TopicSource
from .streaming.ingest import Subscription, compact_history, ingest, start_quarantine, subscribe
from .streaming.rebuild import rebuild_once, start_rebuild
from .streaming.score import score_with_registry, scoring_rows


class Workspace:
    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = root or scratch_path(spark, "workspace")
        self.subscriptions: dict[str, Subscription] = {}
        self.models: dict[str, ML.ModelSpec] = {}
        self.registry = ModelRegistry(spark, f"{self.root}/registry")

    # --- topics ---------------------------------------------------------

    def subscribe(self, source: TopicSource, **kwargs) -> Subscription:
        """Attach a topic; attaching the same topic twice is an error."""
        key = source.name or source.path or ""
        if key in self.subscriptions:
            raise ValueError(f"topic {key!r} is already attached")
        sub = subscribe(self.spark, source, root=f"{self.root}/topics/{len(self.subscriptions)}", **kwargs)
        self.subscriptions[key] = sub
        return sub

    def _sub(self, topic: str) -> Subscription:
        if topic not in self.subscriptions:
            raise LookupError(f"topic {topic!r} is not attached")
        return self.subscriptions[topic]

    def ingest(self, topic: str, trigger: str | None = "availableNow") -> StreamingQuery:
        return ingest(self.spark, self._sub(topic), trigger=trigger)

    def quarantine(self, topic: str, trigger: str | None = "availableNow") -> tuple[StreamingQuery, str]:
        """Keep messages that do not decode cleanly, with the reason; the query and its folder."""
        return start_quarantine(self.spark, self._sub(topic), trigger=trigger)

    def history(self, topic: str) -> DataFrame:
        return self._sub(topic).history(self.spark)

    def compact(self, topic: str, table: str, order_by: list[str]) -> DataFrame:
        """Rewrite a topic's history into a clustered catalog table."""
        store = TableStore(self.spark, f"{self.root}/tables")
        return compact_history(self.spark, self._sub(topic), store, table, order_by)

    # --- models ---------------------------------------------------------

    def add_model(self, spec: ML.ModelSpec) -> None:
        """Define a model; one definition per name, a new one replaces it."""
        build = spec.build_source or spec.topic
        if not build.endswith(".csv") and build not in self.subscriptions:
            raise LookupError(f"build source {build!r} is neither an attached topic nor a CSV file")
        scoring = spec.scoring_source or spec.topic
        if scoring not in self.subscriptions:
            raise LookupError(f"scoring topic {scoring!r} is not attached")
        known = self.models.get(spec.name, spec)
        if known.identity != spec.identity:
            raise ValueError(f"another model is called {spec.name!r}: {known.identity}")
        self.models[spec.name] = spec

    def _build_rows(self, spec: ML.ModelSpec) -> DataFrame:
        src = spec.build_source or spec.topic
        if src.endswith(".csv"):
            return self.spark.read.csv(src, header=True, inferSchema=True, nullValue="NA")
        return self.history(src)

    def build(self, name: str) -> int | None:
        """Fit, judge, save and register a new version of a model; its number
        (None when the rows cannot build it: the log says why)."""
        spec = self.models[name]
        return rebuild_once(self.spark, ML.training_rows(self._build_rows(spec), spec), spec, self.registry)

    def start_rebuild(self, name: str, trigger: str | None = None) -> StreamingQuery:
        """Rebuild on a timer from the build topic's new messages; "all" rebuilds read
        the topic's history as it is then."""
        spec = self.models[name]
        sub = self._sub(spec.build_source or spec.topic)
        jobs = f"{self.registry.root}/jobs/{name}"
        return start_rebuild(
            self.spark, scoring_rows(self.spark, sub), spec, self.registry, f"{jobs}/rows", f"{jobs}/checkpoint", trigger,
            history=lambda: sub.history(self.spark),
        )

    def score(self, name: str, trigger: str | None = "availableNow") -> tuple[StreamingQuery, str]:
        """Score the scoring topic with the newest registered version."""
        spec = self.models[name]
        sub = self._sub(spec.scoring_source or spec.topic)
        out = f"{self.root}/scored/{name}"
        q = score_with_registry(
            self.spark, scoring_rows(self.spark, sub, spec.label), self.registry, spec, f"{out}/table", f"{out}/checkpoint", trigger
        )
        return q, f"{out}/table"

    def remove_models(self, topic: str) -> None:
        """Remove every model of a topic (definitions and live versions)."""
        for name in [n for n, s in self.models.items() if s.topic == topic]:
            del self.models[name]
        self.registry.remove_topic(topic)
