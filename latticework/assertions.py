"""Test helpers: assertions over rule outcomes, and rules as pytest parameters."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from latticework.operators.rules.outcome import FAILED, PASSED, RuleOutcome
from latticework.sinks.render import ResultLimits, collect, console


class PolicyViolated(AssertionError):
    """The rule was decided, against what it saw."""


class NotDecided(AssertionError):
    """The rule was skipped or its analysis is incomplete."""


def assert_passes(outcome: RuleOutcome, limits: ResultLimits | None = None) -> None:
    result = collect(outcome, limits)
    if result.status == FAILED:
        raise PolicyViolated(console([result]))
    if result.status != PASSED:
        raise NotDecided(console([result]))


def cases(rules: Iterable[tuple[str, Callable[[], RuleOutcome]]]) -> list:
    """pytest parameters, one a rule: ``@pytest.mark.parametrize("rule", cases(...))``."""
    import pytest

    return [pytest.param(rule, id=name) for name, rule in rules]
