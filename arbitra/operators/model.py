"""The linear model: a term table plus one record of settings."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class LinearModel:
    """A linear classifier over text features.

    ``terms`` is (term, idf, coef array<double>) for kind ``tfidf`` and
    (bucket, coef array<double>) for kind ``hashed``; ``coef`` is aligned with
    ``classes``. ``n_terms`` is its row count, which decides how it is joined.
    """

    model_id: str
    kind: str
    classes: tuple[str, ...]
    intercept: tuple[float, ...]
    terms: DataFrame
    n_terms: int
    temperature: float = 1.0
    n_max: int = 2
    ece_before: float | None = None
    ece_after: float | None = None
    ece_split: str | None = None

    def __post_init__(self):
        if self.kind not in ("tfidf", "hashed"):
            raise ValueError(f"unknown model kind {self.kind!r}")
        if not self.classes:
            raise ValueError("model has no classes")
        if len(self.intercept) != len(self.classes):
            raise ValueError(f"{len(self.intercept)} intercepts but {len(self.classes)} classes")
        if not (0 < self.temperature < float("inf")):
            raise ValueError(f"temperature must be positive and finite, got {self.temperature}")

    def with_(self, **changes) -> LinearModel:
        return replace(self, **changes)

    @property
    def has_energy(self) -> bool:
        return self.kind == "tfidf"

    def meta(self) -> dict:
        """The settings as one record, without the term table."""
        return {
            "model_id": self.model_id,
            "kind": self.kind,
            "classes": list(self.classes),
            "intercept": [float(b) for b in self.intercept],
            "temperature": float(self.temperature),
            "n_max": int(self.n_max),
            "n_terms": int(self.n_terms),
            "ece_before": self.ece_before,
            "ece_after": self.ece_after,
            "ece_split": self.ece_split,
        }


@dataclass(frozen=True)
class LogitsTable:
    """Answers of any engine: logits that lie in a table, ``(id_col, logits)``, with a column ``question`` where the table
    holds several questions and ``key`` names this one.

    A row without logits is not answered. (id, question) must identify a row of the table.
    """

    model_id: str
    classes: tuple[str, ...]
    logits: DataFrame
    key: str | None = None
    temperature: float = 1.0
    has_energy: bool = True

    def __post_init__(self):
        if not self.classes:
            raise ValueError("model has no classes")
        if not (0 < self.temperature < float("inf")):
            raise ValueError(f"temperature must be positive and finite, got {self.temperature}")

    def with_(self, **changes) -> LogitsTable:
        return replace(self, **changes)


@dataclass(frozen=True)
class HiddenLayerModel:
    """A fitted one-hidden-layer classifier over hashed term counts."""

    model_id: str
    classes: tuple[str, ...]
    network: object
    temperature: float = 1.0
    has_energy: bool = False

    def with_(self, **changes) -> HiddenLayerModel:
        return replace(self, **changes)


Model = LinearModel | LogitsTable | HiddenLayerModel


META_SCHEMA = (
    "model_id string, kind string, classes array<string>, intercept array<double>, temperature double, "
    "n_max int, n_terms bigint, ece_before double, ece_after double, ece_split string"
)


def model_meta(spark, models) -> DataFrame:
    """One row per model."""
    return spark.createDataFrame([m.meta() for m in models], META_SCHEMA)
