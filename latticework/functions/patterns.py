"""Name patterns compiled on the driver to anchored regular expressions (JVM-side ``rlike``)."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separators by domain and the bounds of safe expressions.
SEPARATORS = {"qualified_name": ".", "resource": "/", "simple_name": "."}
MAX_EXPRESSION = 512
MAX_REPETITION = 1024
MAX_CANDIDATE = 4096
_SPECIAL = set(r"\.[]{}()*+-?^$|&")


class PatternError(ValueError):
    """The expression is outside what its pattern kind allows."""


def _literal(c: str) -> str:
    return "\\" + c if c in _SPECIAL else c


def glob_regex(expression: str, separator: str) -> str:
    """``*`` within a segment, ``**`` across segments, ``?`` one character that is no separator, ``\\`` escapes."""
    if not expression:
        raise PatternError("a glob must not be empty")
    other = f"[^{_literal(separator)}]"
    out, i = [], 0
    while i < len(expression):
        c = expression[i]
        if c == "\\":
            i += 1
            if i == len(expression):
                raise PatternError("a glob must not end in an escape")
            out.append(_literal(expression[i]))
        elif expression.startswith("**", i):
            out.append(r"[\s\S]*")
            i += 1
        elif c == "*":
            out.append(other + "*")
        else:
            out.append(other if c == "?" else _literal(c))
        i += 1
    return "".join(out)


def check_safe_regex(expression: str) -> str:
    """Accepts the subset that cannot backtrack badly: no groups, alternatives or back references, one variable quantifier at most."""
    if not expression or len(expression) > MAX_EXPRESSION:
        raise PatternError(f"an expression has 1 to {MAX_EXPRESSION} characters")
    i, variable, in_class = 0, 0, False
    while i < len(expression):
        c = expression[i]
        if c == "\\":
            i += 1
            if i == len(expression):
                raise PatternError("an expression must not end in an escape")
            if expression[i].isdigit() or expression[i] in "kQEGbBAzZ":
                raise PatternError(f"\\{expression[i]} isn't allowed")
        elif in_class:
            in_class = c != "]"
            if c == "[" or expression.startswith("&&", i):
                raise PatternError("nested classes aren't allowed")
        elif c == "[":
            in_class = True
            if expression.startswith("[^", i):
                i += 1
        elif c in "()|":
            raise PatternError("groups and alternatives aren't allowed")
        elif c in "*+?":
            variable += 1
        elif c == "{":
            m = re.match(r"\{(\d+)(,?)(\d*)\}", expression[i:])
            if not m:
                raise PatternError("a repetition isn't closed")
            if max(int(m[1]), int(m[3] or 0)) > MAX_REPETITION:
                raise PatternError(f"a repetition is {MAX_REPETITION} at most")
            variable += bool(m[2]) and m[1] != m[3]
            i += m.end() - 1
        i += 1
    if in_class:
        raise PatternError("a class isn't closed")
    if variable > 1:
        raise PatternError("one variable quantifier at most")
    try:
        re.compile(expression)
    except re.error as e:
        raise PatternError(str(e)) from e
    return expression


@dataclass(frozen=True)
class NamePattern:
    """A compiled pattern; equal patterns describe themselves equally."""

    kind: str
    expression: str
    domain: str
    regex: str

    def describe(self) -> str:
        return f"{self.kind}:{self.expression}"

    def matches(self, candidate: Column) -> Column:
        """True or false for a name; null stays null; candidates beyond MAX_CANDIDATE characters are an error."""
        tested = candidate == F.lit(self.expression) if self.kind == "exact" else candidate.rlike(rf"\A(?:{self.regex})\z")
        too_long = F.raise_error(F.concat(F.lit(f"a candidate has more than {MAX_CANDIDATE} characters: "), F.substring(candidate, 1, 40)))
        return F.when(F.length(candidate) > MAX_CANDIDATE, too_long.cast("boolean")).otherwise(tested)

    def matches_text(self, candidate: str) -> bool:
        if len(candidate) > MAX_CANDIDATE:
            raise PatternError(f"a candidate has more than {MAX_CANDIDATE} characters")
        return candidate == self.expression if self.kind == "exact" else re.fullmatch(self.regex, candidate) is not None


def exact(expression: str, domain: str = "qualified_name") -> NamePattern:
    return NamePattern("exact", expression, domain, re.escape(expression))


def glob(expression: str, domain: str = "qualified_name") -> NamePattern:
    return NamePattern("glob", expression, domain, glob_regex(expression, SEPARATORS[domain]))


def regex(expression: str, domain: str = "qualified_name") -> NamePattern:
    return NamePattern("regex", expression, domain, check_safe_regex(expression))


def trusted_regex(expression: str, domain: str = "qualified_name") -> NamePattern:
    """Unchecked: the executors' own regular-expression dialect."""
    return NamePattern("trusted", expression, domain, expression)


def parse(text: str, domain: str = "qualified_name") -> NamePattern:
    """``exact:NAME`` or ``glob:PATTERN``, as the command line and configuration write patterns."""
    kind, colon, expression = text.partition(":")
    if not colon or kind not in ("exact", "glob") or not expression:
        raise PatternError("a pattern is exact:NAME or glob:PATTERN")
    return {"exact": exact, "glob": glob}[kind](expression, domain)


def slice_capture(expression: str, package: Column) -> Column:
    """The segment that ``{slice}`` stands for in a dotted expression such as ``app.{slice}.api..``, else null.

    A trailing ``..`` lets further segments follow; every other segment is literal, ``*`` is any one segment.
    """
    open_end = expression.endswith("..")
    parts = expression.removesuffix("..").split(".")
    if parts.count("{slice}") != 1 or "" in parts:
        raise PatternError("an expression holds {slice} once, as a whole segment")
    segments = F.split(package, r"\.")
    fits = (F.size(segments) >= len(parts)) if open_end else (F.size(segments) == len(parts))
    for i, part in enumerate(parts):
        if part not in ("{slice}", "*"):
            fits &= F.get(segments, F.lit(i)) == part
    return F.when(fits & (package != ""), F.get(segments, F.lit(parts.index("{slice}"))))


def last_rule_wins(entry: Column, rules: list[tuple[str, str]]) -> Column:
    """Whether an entry is ignored: of (glob, "ignore" | "include") rules over resource paths the last that matches decides."""
    out = F.lit(False)
    for expression, action in rules:
        out = F.when(glob(expression, "resource").matches(entry), F.lit(action == "ignore")).otherwise(out)
    return out


def parse_ignore(text: str) -> list[tuple[str, str]]:
    """Rules of an ignore file: a glob a line, ``!`` re-includes, ``#`` comments."""
    rules = []
    for line in map(str.strip, text.splitlines()):
        if line and not line.startswith("#"):
            rules.append((line[1:], "include") if line.startswith("!") else (line, "ignore"))
    return rules


def any_of(candidate: Column, patterns: list[NamePattern]) -> Column:
    """Include scope: any pattern matches; none given includes all."""
    out = F.lit(not patterns)
    for p in patterns:
        out = out | p.matches(candidate)
    return out
