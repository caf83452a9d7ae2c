"""Several segmentations of one image, of which one is worked on."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass
class Run:
    """A segmentation with how it was made."""

    method: str
    params: dict
    labels: DataFrame


@dataclass
class Session:
    """Runs, the active one, and what belongs to it. Activating another run clears features, predictions and samples;
    labels of runs that aren't active leave the cache and are computed again when they are needed."""

    runs: list[Run] = field(default_factory=list)
    active: int | None = None
    features: DataFrame | None = None
    predictions: DataFrame | None = None
    samples: DataFrame | None = None

    def add(self, run: Run) -> int:
        self.runs.append(run)
        self.activate(len(self.runs) - 1)
        return self.active

    def activate(self, number: int) -> Run:
        if not 0 <= number < len(self.runs):
            raise IndexError(f"There is no run {number}")
        if self.active is not None and self.active != number and self.active < len(self.runs):
            self.runs[self.active].labels.unpersist()
        if self.active != number:
            self._clear()
        self.active = number
        self.runs[number].labels.persist()
        return self.runs[number]

    def delete(self, number: int) -> None:
        """Later runs move up; if the active one goes, the one before it becomes active."""
        self.runs.pop(number).labels.unpersist()
        if self.active == number:
            self.active = None
            self._clear()
            if self.runs:
                self.activate(max(0, number - 1))
        elif self.active is not None and self.active > number:
            self.active -= 1

    def _clear(self) -> None:
        for table in (self.features, self.predictions, self.samples):
            if table is not None:
                table.unpersist()
        self.features = self.predictions = self.samples = None

    def pipeline_steps(self) -> list[tuple]:
        """The active run as steps of a pipeline, with the features and the classification that such a file names."""
        run = self.runs[self.active]
        return [("segment", run.method, run.params), ("extract", ["spectral", "geometry"], {}), ("classify", "kmeans", {})]
