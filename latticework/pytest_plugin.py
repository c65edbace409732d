"""A pytest plugin (``-p latticework.pytest_plugin``): every rule of a ``*.rules.properties`` file is a test.

The inputs of a file are imported once, when its first rule runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pytest

from latticework import config
from latticework.assertions import assert_passes
from latticework.cli import Analysis


def pytest_collect_file(file_path: Path, parent: pytest.Collector) -> RuleFile | None:
    return RuleFile.from_parent(parent, path=file_path) if file_path.name.endswith(".rules.properties") else None


class RuleFile(pytest.File):
    analysis: Analysis | None = None

    def collect(self) -> Iterator[RuleItem]:
        self.loaded = config.load(str(self.path))
        for rule in self.loaded.rules:
            yield RuleItem.from_parent(self, name=rule.rule_id, rule=rule)

    def imported(self) -> Analysis:
        if self.analysis is None:
            from pyspark.sql import SparkSession

            self.analysis = Analysis(SparkSession.builder.getOrCreate(), self.loaded)
        return self.analysis


class RuleItem(pytest.Item):
    def __init__(self, *, rule: config.RuleConfig, **options) -> None:
        super().__init__(**options)
        self.rule = rule

    def runtest(self) -> None:
        assert_passes(self.parent.imported().rule(self.rule))

    def reportinfo(self) -> tuple[Path, int, str]:
        return self.path, 0, f"rule {self.name}"
