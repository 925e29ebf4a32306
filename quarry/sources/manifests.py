"""Package manifests to entry files, and module specifiers to files.

Everything works on a ``Tree``: the files of an install as texts by path. No file system is
touched, so the same code runs on a driver, in a task or in a test.
"""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from quarry.functions.fixed import NODE_MODULES, TYPES_VERSION

_CONDITIONS = ("types", "import", "require", "node", "default")
_DECLARATION = re.compile(r"\.d\.(ts|mts|cts)$")
_SCRIPT = re.compile(r"\.([mc]?)jsx?$")
_PROTOCOL = re.compile(r"^[a-z][a-z0-9+.-]*:")


def is_declaration(path: str) -> bool:
    return bool(_DECLARATION.search(path))


@dataclass
class Manifest:
    """What counts in a package.json."""

    name: str
    version: str
    dependencies: list[str]
    raw: dict


def read_manifest(text: str | None, fallback: str) -> Manifest | None:
    """A manifest's name (else the folder's), version (else 0.0.0) and its dependencies of three kinds, sorted."""
    try:
        raw = json.loads(text or "")
    except ValueError:
        return None
    if not isinstance(raw, dict):
        return None
    text_of = lambda k, other: raw[k] if isinstance(raw.get(k), str) else other
    names = {n for k in ("dependencies", "peerDependencies", "optionalDependencies") if isinstance(raw.get(k), dict) for n in raw[k]}
    return Manifest(text_of("name", fallback), text_of("version", "0.0.0"), sorted(names), raw)


@dataclass
class Tree:
    """Files by path, with ``/`` between segments."""

    files: Mapping[str, str]
    folders: set[str] = field(default_factory=set)

    def __post_init__(self) -> None:
        for path in self.files:
            while path := posixpath.dirname(path):
                if path in self.folders or path == "/":
                    break
                self.folders.add(path)

    def first(self, candidates: Iterable[str]) -> str | None:
        return next((p for p in map(posixpath.normpath, candidates) if p in self.files), None)


def _siblings(path: str) -> list[str]:
    """Declaration files that may stand beside a script."""
    m = _SCRIPT.search(path)
    if not m:
        return []
    stem = path[: m.start()]
    return [f"{stem}.d.{m[1]}ts", *([f"{stem}.d.ts"] if m[1] else [f"{stem}.d.mts", f"{stem}.d.cts"])]


def declared(tree: Tree, folder: str, path: str) -> str | None:
    """The declaration file that a manifest's path means: itself, beside a script, or with an extension."""
    full = posixpath.join(folder, path)
    tries = [full] if is_declaration(full) else []
    return tree.first([*tries, *_siblings(full), f"{full}.d.ts", f"{full}/index.d.ts"])


def _condition(tree: Tree, folder: str, entry: object) -> str | None:
    """The first file of a conditional export, by fixed order of conditions."""
    if isinstance(entry, str):
        return declared(tree, folder, entry)
    if isinstance(entry, list):
        return next((r for x in entry if (r := _condition(tree, folder, x))), None)
    if isinstance(entry, dict):
        return next((r for k in _CONDITIONS if k in entry and (r := _condition(tree, folder, entry[k]))), None)
    return None


def _pattern(value: object) -> str | None:
    if isinstance(value, str):
        return value
    if isinstance(value, list):
        return next((p for x in value if (p := _pattern(x))), None)
    if isinstance(value, dict):
        return next((p for k in ("types", "import", "require", "default") if k in value and (p := _pattern(value[k]))), None)
    return None


def wildcard(tree: Tree, folder: str, value: object) -> list[str]:
    """Declaration files that a wildcard export matches; a star stands for one segment."""
    pattern = _pattern(value)
    if not pattern or "*" not in pattern:
        return []
    rule = re.compile("^" + "([^/]+)".join(map(re.escape, posixpath.normpath(pattern).split("*"))) + "$")
    inside = f"{folder}/"
    return sorted(p for p in tree.files if p.startswith(inside) and is_declaration(p) and rule.match(p[len(inside) :]))


def _versions(tree: Tree, folder: str, table: object) -> str | None:
    """The entry of the first typesVersions range that the fixed version meets."""
    major, minor = (int(x) for x in TYPES_VERSION.split(".")[:2])
    for wanted, paths in table.items() if isinstance(table, dict) else ():
        m = re.match(r"^>=\s*(\d+)\.(\d+)", wanted)
        if not m or (major, minor) < (int(m[1]), int(m[2])) or not isinstance(paths, dict):
            continue
        for key in (".", "*"):
            for p in paths.get(key) or []:
                if isinstance(p, str) and (found := declared(tree, folder, p.replace("*", "index") if key == "*" else p)):
                    return found
    return None


@dataclass
class Entry:
    files: list[str]
    subpaths: dict[str, str]


def _exports(tree: Tree, folder: str, exports: object, subpaths: dict[str, str]) -> list[str]:
    if isinstance(exports, list):
        return list(dict.fromkeys(p for x in exports for p in _exports(tree, folder, x, subpaths)))
    if isinstance(exports, dict) and any(k.startswith(".") for k in exports):
        out: list[str] = []
        for key, value in exports.items():
            if not key.startswith(".") or key == "./package.json":
                continue
            if "*" in key:
                out += wildcard(tree, folder, value)
            elif found := _condition(tree, folder, value):
                subpaths[key] = found
                out.append(found)
        return list(dict.fromkeys(out))
    found = _condition(tree, folder, exports) if isinstance(exports, (str, dict)) else None
    if found:
        subpaths.setdefault(".", found)
    return [found] if found else []


def entry_of(tree: Tree, folder: str, manifest: Manifest) -> Entry:
    """Entry files: exports, then typesVersions, types, typings for the root, then index.d.ts."""
    raw, subpaths = manifest.raw, {}
    files = _exports(tree, folder, raw["exports"], subpaths) if "exports" in raw else []
    for key in ("typesVersions", "types", "typings"):
        if files and "." in subpaths:
            break
        value = raw.get(key)
        found = _versions(tree, folder, value) if key == "typesVersions" else declared(tree, folder, value) if isinstance(value, str) else None
        if found:
            files.append(found)
            subpaths["."] = found
    if not files and f"{folder}/index.d.ts" in tree.files:
        files = [f"{folder}/index.d.ts"]
        subpaths["."] = files[0]
    return Entry(sorted(set(files)), subpaths)


def _package_folder(tree: Tree, name: str, at: str) -> str | None:
    while True:
        found = posixpath.join(at, "node_modules", name)
        if found in tree.folders:
            return found
        if at in ("", "/"):
            return None
        at = posixpath.dirname(at)


def resolve(tree: Tree, specifier: str, file: str) -> list[str]:
    """The files that a module specifier means in ``file``; runtime modules stand for themselves.

    A relative one is tried as a declaration file, beside a script, with ``.d.ts``, as it
    is, and as a folder. A package is looked for in each folder above, then its types package.
    """
    if specifier in NODE_MODULES or _PROTOCOL.match(specifier):
        return [specifier]
    at = posixpath.dirname(file)
    if specifier.startswith((".", "/")):
        full = posixpath.join(at, specifier)
        found = tree.first([*([full] if is_declaration(full) else []), *_siblings(full), f"{full}.d.ts", full, f"{full}/index.d.ts"])
        return [found] if found else []
    parts = specifier.split("/")
    width = 2 if specifier.startswith("@") and len(parts) > 1 else 1
    name, subpath = "/".join(parts[:width]), "/".join([".", *parts[width:]])
    names = [name] if name.startswith("@") else [name, f"@types/{name}"]
    fallback = None
    for n in names:
        folder = _package_folder(tree, n, at)
        manifest = read_manifest(tree.files.get(f"{folder}/package.json"), n) if folder else None
        if manifest is None:
            continue
        entry = entry_of(tree, folder, manifest)
        fallback = fallback or (folder, manifest, entry)
        if entry.files:
            fallback = (folder, manifest, entry)
            break
    if fallback is None:
        return []
    folder, manifest, entry = fallback
    if subpath == ".":
        return entry.files
    if subpath in entry.subpaths:
        return [entry.subpaths[subpath]]
    exports = manifest.raw.get("exports")
    for key, value in exports.items() if isinstance(exports, dict) else ():
        if key.count("*") == 1:
            before, after = key.split("*")
            if subpath.startswith(before) and subpath.endswith(after) and len(subpath) >= len(before) + len(after):
                middle = subpath[len(before) : len(subpath) - len(after)]
                filled = json.loads(json.dumps(value).replace("*", middle))
                if found := _condition(tree, folder, filled):
                    return [found]
    found = declared(tree, folder, subpath) or tree.first([posixpath.join(folder, subpath)])
    return [found] if found else []
