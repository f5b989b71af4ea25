"""User-defined detectors: functions from tables to findings."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators import results
from codeloom.schema import FINDING, FINDING_COLUMNS

Tables = dict[str, DataFrame]
Detector = Callable[[Tables], DataFrame]


class DetectorRegistry:
    """Named detectors in merge order: built-in families first, then plug-ins."""

    def __init__(self) -> None:
        self._detectors: dict[str, Detector] = {}
        self._plugins: set[str] = set()
        #: (name, problem) of every plug-in that the last run had to leave out.
        self.failures: list[tuple[str, str]] = []

    def register(self, name: str, detector: Detector, plugin: bool = False) -> bool:
        """Add a detector; an invalid one is skipped with a warning."""
        if not isinstance(name, str) or not name or not callable(detector):
            warnings.warn(f"skipping invalid detector {name!r}")
            return False
        self._detectors[name] = detector
        (self._plugins.add if plugin else self._plugins.discard)(name)
        return True

    def load(self, plugins: Iterable[tuple[str, Detector]]) -> None:
        for plugin in plugins:
            try:
                self.register(*plugin, plugin=True)
            except TypeError as problem:
                warnings.warn(f"skipping invalid detector: {problem}")

    @property
    def names(self) -> list[str]:
        return list(self._detectors)

    def run(self, tables: Tables, run_id: str, enabled: dict[str, bool] | None = None) -> DataFrame:
        """Merged and de-duplicated findings. A plug-in that cannot be planned or does not
        return the finding columns is left out, with a warning and an entry in `failures`;
        a built-in detector that fails stops the run."""
        parts, self.failures = [], []
        for name, detector in self._detectors.items():
            if enabled and not enabled.get(name, True):
                continue
            try:
                found = detector(tables)
                types = {f.name: f.dataType for f in found.schema.fields}
                wrong = [f.name for f in FINDING.fields if types.get(f.name) != f.dataType]
                if wrong:
                    raise ValueError(f"finding columns missing or of another type: {wrong}")
            except Exception as problem:
                if name not in self._plugins:
                    raise
                self.failures.append((name, str(problem)))
                warnings.warn(f"detector {name} failed: {problem}")
                continue
            parts.append(found.select(*FINDING_COLUMNS))
        if not parts:
            raise ValueError("no detector to run")
        merged = results.merge_findings(parts, F.lit(run_id))
        return results.dedupe_findings(merged, ["family_order", "message"])
