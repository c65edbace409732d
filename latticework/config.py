"""A strict configuration file: bounded, every key known, every key once."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path

from latticework.functions.patterns import NamePattern, PatternError, parse

MAX_BYTES, MAX_LINES, MAX_INPUTS, MAX_RULES = 65_536, 1_024, 64, 256
_RULE = re.compile(r"rule\.([\w-]+)\.(type|origin|target|external|severity|because|selection)")
_ALLOWED = {"type": {"no", "only", "any", "required", "acyclic"}, "external": {"ignore", "non-matching", "fail"}, "severity": {"info", "warning", "error"}, "selection": {"allow", "warn", "fail"}}


class ConfigError(ValueError):
    """The user's configuration is wrong."""


@dataclass(frozen=True)
class RuleConfig:
    rule_id: str
    kind: str
    origin: NamePattern
    target: NamePattern | None
    external: str = "ignore"
    severity: str = "error"
    because: str = ""
    selection: str = "fail"


@dataclass(frozen=True)
class Configuration:
    inputs: tuple[Path, ...]
    rules: tuple[RuleConfig, ...] = field(default=())
    allow_incomplete: bool = False
    output_format: str = "console"
    release: int | None = None
    mode: str = "CLASSPATH"
    manifests: bool = False
    ignore: Path | None = None


def load(path: str) -> Configuration:
    """``key=value`` lines; ``#`` comments.  Inputs are relative to the file and stay below its folder."""
    file = Path(path)
    raw = file.read_bytes()
    if len(raw) > MAX_BYTES:
        raise ConfigError(f"a configuration has {MAX_BYTES} bytes at most")
    try:
        lines = raw.decode("utf-8").splitlines()
    except UnicodeDecodeError as e:
        raise ConfigError("a configuration is UTF-8") from e
    if len(lines) > MAX_LINES:
        raise ConfigError(f"a configuration has {MAX_LINES} lines at most")
    values: dict[str, str] = {}
    for n, line in enumerate(lines, 1):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        key, equals, value = line.partition("=")
        key = key.strip()
        if not equals or key in values:
            raise ConfigError(f"line {n}: " + ("a key stands twice" if equals else "key=value is expected"))
        values[key] = value.strip()
    if values.pop("schema", "1") != "1":
        raise ConfigError("schema 1 is the only one")
    rules: dict[str, dict[str, str]] = {}
    inputs: list[Path] = []
    incomplete, output = False, "console"
    options: dict[str, object] = {}
    base = file.resolve().parent
    for key, value in values.items():
        if m := _RULE.fullmatch(key):
            if m[2] in _ALLOWED and value not in _ALLOWED[m[2]]:
                raise ConfigError(f"{key} is one of {sorted(_ALLOWED[m[2]])}")
            rules.setdefault(m[1], {})[m[2]] = value
        elif re.fullmatch(r"input\.\d+", key):
            place = (base / value).resolve()
            if base not in (place, *place.parents):
                raise ConfigError(f"{key} leaves the configuration's folder")
            inputs.append(place)
        elif key == "allow-incomplete" and value in ("true", "false"):
            incomplete = value == "true"
        elif key == "format" and value in ("console", "json", "sarif", "junit"):
            output = value
        elif key == "release" and re.fullmatch(r"[1-9]\d{0,2}", value) and int(value) >= 8:
            options["release"] = int(value)
        elif key == "mode" and value in ("classpath", "module-path"):
            options["mode"] = value.replace("-", "_").upper()
        elif key == "manifests" and value in ("true", "false"):
            options["manifests"] = value == "true"
        elif key == "ignore":
            place = (base / value).resolve()
            if base not in place.parents or not place.is_file() or place.stat().st_size > MAX_BYTES:
                raise ConfigError(f"ignore names a file of at most {MAX_BYTES} bytes in the configuration's folder")
            options["ignore"] = place
        else:
            raise ConfigError(f"{key} isn't known, or has no such value")
    if not inputs or len(inputs) > MAX_INPUTS or len(rules) > MAX_RULES:
        raise ConfigError(f"1 to {MAX_INPUTS} inputs and up to {MAX_RULES} rules are allowed")
    made = []
    for name, r in sorted(rules.items()):
        try:
            kind = r.pop("type", None)
            if kind is None or "origin" not in r or (kind != "acyclic") != ("target" in r):
                raise ConfigError(f"rule {name} needs a type, an origin and, unless acyclic, a target")
            target = parse(r.pop("target")) if "target" in r else None
            made.append(RuleConfig(name, kind, parse(r.pop("origin")), target, **r))
        except PatternError as e:
            raise ConfigError(f"rule {name}: {e}") from e
    return Configuration(tuple(inputs), tuple(made), incomplete, output, **options)
