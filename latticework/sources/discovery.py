"""Build output folders of Maven and Gradle projects, read as data: no build tool is run."""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import Path

MAX_BUILD_FILE = 1_000_000
MAX_MODULES = 1_000


class DiscoveryError(ValueError):
    """The project's files break a bound or leave its folder."""


@dataclass(frozen=True)
class ProjectModule:
    path: Path
    tool: str
    classes: tuple[Path, ...]
    test_classes: tuple[Path, ...]


def _bounded(path: Path) -> str:
    if path.stat().st_size > MAX_BUILD_FILE:
        raise DiscoveryError(f"{path.name} is too large")
    return path.read_text(encoding="utf-8", errors="replace")


def _children(root: Path, folder: Path, names: list[str]) -> list[Path]:
    out = []
    for name in names:
        child = (folder / name.strip().strip(":").replace(":", "/")).resolve()
        if root not in (child, *child.parents):
            raise DiscoveryError(f"{name} leaves the project")
        if child.is_dir():
            out.append(child)
    return out


def discover(root: str) -> list[ProjectModule]:
    """The project's modules in order of path, with the output folders that exist."""
    top = Path(root).resolve()
    todo, seen, found = [top], set(), []
    while todo:
        folder = todo.pop()
        if folder in seen:
            continue
        seen.add(folder)
        if len(seen) > MAX_MODULES:
            raise DiscoveryError(f"a project has {MAX_MODULES} modules at most")
        pom = folder / "pom.xml"
        gradle = [p for p in (folder / n for n in ("settings.gradle", "settings.gradle.kts", "build.gradle", "build.gradle.kts")) if p.is_file()]
        if pom.is_file():
            text = re.sub(r"<!--.*?-->", "", _bounded(pom), flags=re.S)
            todo += _children(top, folder, re.findall(r"<module>([^<]+)</module>", text))
            tool, main, test = "MAVEN", [folder / "target/classes"], [folder / "target/test-classes"]
        elif gradle:
            names = [n for p in gradle if p.name.startswith("settings") for n in re.findall(r"[\"'](:?[\w:.-]+)[\"']", " ".join(re.findall(r"\binclude\b[^\n]*", _bounded(p))))]
            todo += _children(top, folder, names)
            tool = "GRADLE"
            main, test = (sorted((folder / "build/classes").glob(f"*/{kind}")) for kind in ("main", "test"))
        else:
            continue
        found.append(ProjectModule(folder, tool, tuple(p for p in main if p.is_dir()), tuple(p for p in test if p.is_dir())))
    return sorted(found, key=lambda m: m.path)
