"""The public interface: a catalogue with its vectors, neighbours and session log, and what can be asked of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.config import RankingConfig
from vitrine.operators import catalog as C
from vitrine.operators import evaluation as V
from vitrine.operators import profiles as P
from vitrine.operators import ranking as K
from vitrine.operators import retrieval as R
from vitrine.operators import together as G
from vitrine.sources import snapshot


class Engine:
    """All answers are DataFrames; requests come one at a time here, the operators take many at once."""

    def __init__(self, catalog: DataFrame, vectors: DataFrame | None = None, events: DataFrame | None = None, neighbors: DataFrame | None = None, config: RankingConfig | None = None, encoder=None):
        self.spark: SparkSession = catalog.sparkSession
        self.catalog = catalog
        self.encoder = encoder or R.hashed_encoder()
        self.vectors = vectors if vectors is not None else R.encoded(catalog, self.encoder)
        self.events = events
        self.neighbors = neighbors if neighbors is not None else (G.cooccurrence(events) if events is not None else None)
        self.config = config or RankingConfig()
        self._index: R.Index | None = None

    def _profile(self, session: str | None) -> DataFrame | None:
        if session is None or self.events is None:
            return None
        return P.profiles(self.events.where(F.col("session_id") == session), self.catalog, bumps=self.config.bumps).withColumn("q", F.lit("q")).drop("session")

    def search(self, text: str, limit: int = 10, category: str | None = None, session: str | None = None) -> DataFrame:
        asked = self.spark.createDataFrame([("q", text)], "q string, text string").withColumn("embedding", self.encoder(F.col("text")))
        if self._index is None:  # the first search writes it, for all that follow
            self._index = K.keyword_index(self.catalog, kept=True)
        return K.search(asked, self.catalog, self.vectors, limit, category, self._profile(session), self.config.weights, self._index).drop("q")

    def recommend(self, strategy: str = "for_you", seed: str | None = None, limit: int = 10, session: str | None = None) -> DataFrame:
        request = self.spark.createDataFrame([("q",)], "q string")
        if seed is not None:
            if not self.catalog.where(F.col("id") == seed).limit(1).count():
                raise KeyError(f"no product {seed!r}")
            request = request.withColumn("seed", F.lit(seed))
        return K.recommend(strategy, request, self.catalog, limit, self._profile(session), self.vectors, self.neighbors, self.config).drop("q")

    def similar(self, seed: str, limit: int = 10) -> DataFrame:
        return self.recommend("similar_items", seed, limit)

    def browse(self, category: str | None = None, offset: int = 0, limit: int = 20) -> DataFrame:
        return C.browse(self.catalog, category, offset, limit)

    def track(self, events: DataFrame) -> "Engine":
        """An engine whose log holds these events too."""
        log = events if self.events is None else self.events.unionByName(events)
        return Engine(self.catalog, self.vectors, log, self.neighbors, self.config, self.encoder)

    def retrain(self, alpha: float = 0.5) -> "Engine":
        catalog, neighbors = V.retrained(self.catalog, self.events, alpha)
        return Engine(catalog, self.vectors, self.events, neighbors, self.config, self.encoder)

    def audit(self, version: str, alpha: float = 0.5) -> DataFrame:
        return V.audit(self.events, self.catalog, self.neighbors, version, alpha)

    def publish(self, root: str, version: str, sequence: int) -> snapshot.Pointer:
        tables = {"products": self.catalog, "vectors": self.vectors}
        if self.neighbors is not None:
            tables["neighbors"] = self.neighbors
        return snapshot.publish(tables, root, version, sequence, config=self.config)

    @staticmethod
    def open(spark: SparkSession, local: str) -> "Engine":
        part = lambda n: snapshot.load(spark, local, n) if snapshot.has(local, n) else None
        return Engine(part("products"), part("vectors"), neighbors=part("neighbors"), config=snapshot.load_config(local))
