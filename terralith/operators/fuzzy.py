"""Fuzzy rules: trapezoid memberships joined by the least, classes chosen by the greatest."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import membership
from .labels import keys

UNCLASSIFIED = "unclassified"


@dataclass(frozen=True)
class FuzzyRule:
    """Full membership from low to high, falling to 0 at the edges, which are the bounds where not given."""

    feature: str
    low: float
    high: float
    low_edge: float | None = None
    high_edge: float | None = None

    def evaluate(self, column: Column | None = None) -> Column:
        return membership(F.col(self.feature).cast("double") if column is None else column, self.low, self.high, self.low_edge, self.high_edge)


@dataclass
class FuzzyClassifier:
    """rules: class to its rules, all of which must hold. Classes are tried in the order given."""

    rules: dict[str, list[FuzzyRule]] = field(default_factory=dict)

    def fit(self, features: DataFrame | None = None, labels: DataFrame | None = None) -> FuzzyClassifier:
        return self

    def _grades(self, features: DataFrame) -> dict[str, Column]:
        if not self.rules:
            raise ValueError("No fuzzy rules defined")
        if missing := sorted({r.feature for rules in self.rules.values() for r in rules} - set(features.columns)):
            raise ValueError(f"Features not in the table: {', '.join(missing)}")
        return {c: F.least(*grades) if len(grades := [r.evaluate() for r in rules]) > 1 else grades[0] for c, rules in self.rules.items() if rules}

    def predict_proba(self, features: DataFrame) -> DataFrame:
        """A column for each class with the segment's membership."""
        return features.select(*keys(features), *(g.alias(c) for c, g in self._grades(features).items()))

    def predict(self, features: DataFrame) -> DataFrame:
        """class_label: the class of the greatest membership, the first of several, or "unclassified" at 0."""
        grades = self._grades(features)
        table = self.predict_proba(features)
        best = F.greatest(*[F.col(f"`{c}`") for c in grades]) if len(grades) > 1 else F.col(f"`{next(iter(grades))}`")
        chosen = F.when(best <= 0, F.lit(UNCLASSIFIED))
        for c in grades:
            chosen = chosen.when(F.col(f"`{c}`") == best, F.lit(c))
        return table.select(*keys(features), chosen.alias("class_label"))

    def get_params(self) -> dict:
        return {"rules": {c: [asdict(r) for r in rules] for c, rules in self.rules.items()}}

    @classmethod
    def from_params(cls, params: dict) -> FuzzyClassifier:
        return cls({c: [r if isinstance(r, FuzzyRule) else FuzzyRule(**r) for r in rules] for c, rules in params.get("rules", {}).items()})
