"""Project configuration and install roots on the driver's own file system."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, fields, replace
from pathlib import Path

FILE_NAME = "quarry.config.json"


@dataclass(frozen=True)
class Config:
    """Options of an index run; null means not set."""

    max_hops: int | None = None
    workspaces: tuple[str, ...] | None = None
    index_root_workspace: bool | None = None
    dependency_stub_packages: tuple[str, ...] | None = None
    include: tuple[str, ...] | None = None
    exclude: tuple[str, ...] | None = None
    package_scope: tuple[str, ...] | None = None


DEFAULTS = Config(max_hops=10, workspaces=(), index_root_workspace=True, dependency_stub_packages=(), include=(), exclude=(), package_scope=("dependencies",))


def from_mapping(raw: Mapping[str, object]) -> Config:
    known = {f.name for f in fields(Config)}
    if odd := sorted(set(raw) - known):
        raise ValueError(f"unknown options: {', '.join(odd)}")
    return Config(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})


def discover(start: str | os.PathLike) -> tuple[Path, Config] | None:
    """The nearest folder from ``start`` upwards with a configuration, and that."""
    at = Path(start).absolute()
    for folder in (at, *at.parents):
        file = folder / FILE_NAME
        if file.is_file():
            try:
                return folder, from_mapping(json.loads(file.read_text()))
            except ValueError as fault:
                raise ValueError(f"{file}: {fault}") from fault
    return None


def merged(*layers: Config) -> Config:
    """Later layers over earlier ones, where they set an option."""
    out = Config()
    for layer in layers:
        out = replace(out, **{f.name: getattr(layer, f.name) for f in fields(Config) if getattr(layer, f.name) is not None})
    return out


def workspaces(root: str | os.PathLike, patterns: Iterable[str]) -> list[Path]:
    """Folders of ``dir/*`` and plain patterns, each real folder once, in order."""
    found: dict[str, Path] = {}
    for pattern in patterns:
        p = pattern.replace("\\", "/")
        base = Path(root) / p.removesuffix("/*")
        for folder in sorted(x for x in base.iterdir() if x.is_dir()) if p.endswith("/*") and base.is_dir() else [base] if base.is_dir() else []:
            found.setdefault(os.path.realpath(folder), folder)
    return list(found.values())


def install_roots(root: str | os.PathLike, config: Config) -> list[Path]:
    """The ``node_modules`` folders of a project and its workspaces that exist, each once."""
    bases = [Path(root)] if config.index_root_workspace is not False else []
    roots: dict[str, Path] = {}
    for folder in [*bases, *workspaces(root, config.workspaces or ())]:
        if (folder / "node_modules").is_dir():
            roots.setdefault(os.path.realpath(folder / "node_modules"), folder / "node_modules")
    return list(roots.values())


def manifest_names(folders: Iterable[str | os.PathLike], sections: Iterable[str] = ("dependencies",)) -> set[str] | None:
    """Names in sections of the folders' manifests; None where no folder has one, which allows all."""
    sections, found = list(sections), None
    for folder in folders:
        file = Path(folder) / "package.json"
        if file.is_file():
            raw = json.loads(file.read_text())
            found = (found or set()) | {n for s in sections for n in (raw.get(s) or {})}
    return found
