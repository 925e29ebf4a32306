"""The symbol graph of one package: discovery, export resolution, merging, ids and edges.

These passes depend on the order in which a package's files are met, so a package is built
as a whole, in one task; packages are built in parallel (``packages.graphs``).
``quarry.operators`` has the same operators over tables, for any number of rows.
"""

from __future__ import annotations

import hashlib
import posixpath
import re
from collections import defaultdict
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

import pyarrow as pa

from quarry.functions import fixed
from quarry.sources import declarations, manifests
from quarry.sources.declarations import Export, Reference

SYMBOLS = (
    "package string, version string, id string, name string, kind string, kind_code int, file_path string, source_package string, source_version string, source_path string, "
    "additional_files array<string>, entry_visibility array<string>, merge_provenance array<string>, signature string, js_doc string, is_type_only boolean, symbol_space string, "
    "dependencies array<string>, surface_dependencies array<string>, re_exported_from string, deprecated string, visibility string, since string, is_internal boolean, is_global boolean, "
    "is_inherited boolean, inherited_from array<string>, heritage array<string>, modifiers array<string>, parent_id string, enclosing_module_id string"
)
COLUMNS = [c.split()[0] for c in SYMBOLS.split(", ")]
_KINDS = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
ARROW = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in SYMBOLS.split(", ")])


@dataclass
class Resolved:
    """An export as seen from an entry file."""

    export: Export
    name: str
    defined_in: str
    chain: tuple[str, ...] = ()
    is_internal: bool = False


def _normal(text: str | None) -> str:
    return " ".join((text or "").split())


class Package:
    def __init__(self, files: Mapping[str, str], folder: str, max_hops: int, stubs: Sequence[str]):
        self.tree, self.folder, self.max_hops = manifests.Tree(files), folder, max_hops
        self.manifest = manifests.read_manifest(files.get(f"{folder}/package.json"), posixpath.basename(folder))
        self.stubs = set(stubs)
        self.parsed: dict[str, declarations.Parsed] = {}
        self.edges: dict[str, set[str]] = defaultdict(set)  # of directives
        self.hops: dict[str, int] = {}
        self.revisits: set[tuple[str, str]] = set()
        self.memo: dict[str, list[Resolved]] = {}
        self.on_path: set[str] = set()
        self.found_paths: dict[tuple[str, str], list[str]] = {}

    def resolve(self, specifier: str, file: str) -> list[str]:
        key = (specifier, file)
        if key not in self.found_paths:
            self.found_paths[key] = manifests.resolve(self.tree, specifier, file)
        return self.found_paths[key]

    def relative(self, path: str) -> str:
        """A path within the package; elsewhere the steps out of it are spelled out."""
        if path.startswith(f"{self.folder}/"):
            return path[len(self.folder) + 1 :]
        away = posixpath.relpath(path, self.folder).split("/")
        ups = next((k for k, x in enumerate(away) if x != ".."), len(away))
        return "/".join([fixed.OUTSIDE, *[fixed.STEP_UP] * ups, *away[ups:]])

    # discovery (G1, G2) ------------------------------------------------------------------

    def directive_targets(self, reference: str, file: str) -> list[str]:
        beside = posixpath.normpath(posixpath.join(posixpath.dirname(file), reference))
        return self.resolve(reference, file) or ([beside] if beside in self.tree.files else [])

    def targets(self, file: str) -> list[str]:
        p, out = self.parsed[file], set()
        for r in p.references:
            for t in self.directive_targets(r, file):
                if manifests.is_declaration(t):
                    self.edges[file].add(t)
                    out.add(t)
        specifiers = [e.source for e in p.exports if e.source] + [i.source for i in p.imports] + [r.import_path for e in p.exports for r in e.references if r.import_path]
        for s in specifiers:
            out.update(t for t in self.resolve(s, file) if t != s)
        return sorted(t for t in out if t in self.tree.files and manifests.is_declaration(t))

    def discover(self, entries: Sequence[str]) -> None:
        """Files by layers of hops; what was met before is a revisit."""
        layer = sorted({e for e in entries if e in self.tree.files and manifests.is_declaration(e)})
        self.hops = dict.fromkeys(layer, 0)
        while layer:
            following = []
            for file in layer:
                self.parsed[file] = declarations.parse(self.tree.files[file] or "")
                hop = self.hops[file] + 1
                targets = self.targets(file)
                if 0 <= self.max_hops < hop:
                    continue
                for t in targets:
                    if t in self.hops:
                        self.revisits.add((file, t))
                    else:
                        self.hops[t] = hop
                        following.append(t)
            layer = sorted(following)
        for file in sorted(self.parsed):
            self.expand(file)

    def expand(self, file: str) -> None:
        """Members of what a declaration's type imports whole become members of the declaration, declared where they stand."""
        out: list[Export] = []
        for e in self.parsed[file].exports:
            out.append(e)
            for target in self.resolve(e.remote[0], file) if e.remote else ():
                prefix = f"{e.remote[1]}."
                for m in self.parsed[target].exports if target in self.parsed and target != file else ():
                    if m.name.startswith(prefix) and m.declared_in is None:
                        name = f"{e.name}.{m.name[len(prefix):].removeprefix('prototype.')}"
                        out.append(replace(m, name=name, is_explicit=e.is_explicit, is_global=e.is_global, enclosing=e.enclosing, declared_in=target))
        self.parsed[file].exports[:] = out

    # export resolution (G3) --------------------------------------------------------------

    def exports(self, file: str, depth: int = 0) -> list[Resolved]:
        if 0 <= self.max_hops < depth or file in self.on_path or file not in self.parsed:
            return []
        if file in self.memo:
            return self.memo[file]
        self.on_path.add(file)
        p = self.parsed[file]
        own = list(p.exports)
        key = lambda at, e: (at if e.kind in fixed.SCOPE_MERGED else "", e.name, e.kind, _normal(e.signature))
        known = {key(file, e) for e in own}
        for reference in p.references:
            for target in self.directive_targets(reference, file):
                module = self.parsed[target].is_module if target in self.parsed else True
                for r in self.exports(target, depth + 1):
                    if module and not r.export.is_global:
                        continue
                    seen = replace(r.export, name=r.name, is_explicit=True, declared_in=target, source=None)
                    if key(r.defined_in, seen) not in known:
                        known.add(key(r.defined_in, seen))
                        own.append(seen)
        local: dict[str, list[Export]] = defaultdict(list)
        for e in own:
            local[e.name].append(e)
        out: list[Resolved] = []
        for e in own:
            if e.is_global and e.kind == "ModuleDeclaration" and e.name == "global":
                continue
            if not e.is_explicit and p.is_module and not e.is_global:
                continue
            if e.source is not None:
                out += self.re_exported(e, file, depth)
            elif e.kind in ("ExportAssignment", "ExportDeclaration", "ImportEqualsDeclaration"):
                out += self.assigned(e, local, file, depth)
            else:
                out.append(Resolved(e, e.name, e.declared_in or file))
        self.on_path.discard(file)
        self.memo[file] = out
        return out

    def re_exported(self, e: Export, file: str, depth: int) -> list[Resolved]:
        paths = [p for p in self.resolve(e.source, file) if p in self.tree.files]
        bare = replace(e, references=[])
        if not paths:
            return [] if e.is_wildcard else [Resolved(bare, e.name, file, (file,))]
        nested = [r for p in paths for r in self.exports(p, depth + 1)]
        if e.is_wildcard:
            return nested
        if e.is_namespace_export:
            wrapped = [replace(r, name=f"{e.name}.{r.name}", chain=(file, *r.chain)) for r in nested]
            return [Resolved(bare, e.name, file, (file,)), *wrapped]
        wanted = e.original_name or e.name
        hits = [replace(r, name=e.name, chain=(file, *r.chain)) for r in nested if r.name == wanted]
        return hits or [Resolved(bare, e.name, paths[0], (file,))]

    def assigned(self, e: Export, local: Mapping[str, list[Export]], file: str, depth: int) -> list[Resolved]:
        """What a local export clause or assignment stands for: declarations here with their members, or an import."""
        wanted = e.original_name or e.name
        hits = [x for x in local.get(wanted, ()) if x is not e and not (x.kind == e.kind and x.signature == e.signature)]
        if hits:
            out = [Resolved(x, e.name, file, is_internal=x.kind == "ExportAssignment" and e.name == "default") for x in hits]
            for x in hits:
                prefix = f"{x.name}."
                for name in sorted(n for n in local if n.startswith(prefix)):
                    out += [Resolved(m, f"{e.name}.{name[len(prefix):]}", file) for m in local[name]]
            return out
        found = next((i for i in self.parsed[file].imports if i.name == wanted), None)
        if found is None:
            return []
        foreign = found.original_name or ("default" if found.is_default else found.name)
        return self.re_exported(Export(e.name, "ExportDeclaration", source=found.source, original_name=None if foreign == e.name else foreign, is_namespace_export=found.is_namespace, is_explicit=True), file, depth)

    # the graph ---------------------------------------------------------------------------

    def scopes(self) -> dict[str, str]:
        """Merge scope of each file: components over directives, scripts and modules apart."""
        parent = {f: f for f in self.parsed}

        def root(x: str) -> str:
            while parent[x] != x:
                x = parent[x]
            return x

        for a, targets in self.edges.items():
            for b in targets:
                if b in self.parsed and self.parsed[a].is_module == self.parsed[b].is_module:
                    x, y = sorted((root(a), root(b)), key=self.relative)
                    parent[y] = x
        size: dict[str, int] = defaultdict(int)
        for f in self.parsed:
            size[root(f)] += 1
        return {f: ("s:" if not self.parsed[f].is_module else "mcc:" if size[root(f)] > 1 else "m:") + self.relative(root(f)) for f in self.parsed}

    def symbols(self) -> list[dict]:
        if self.manifest is None:
            return []
        entries = manifests.entry_of(self.tree, self.folder, self.manifest).files
        self.discover(entries)
        public = [(r, entry) for entry in entries for r in self.exports(entry)]
        merged = self.merge(public)
        self.number(merged)
        self.connect(merged)
        self.inherit(merged)
        self.parents(merged)  # of inherited members, too: their parent is the heir
        self.roll_up(merged)
        return [{c: s.get(c) for c in COLUMNS} for s in merged]

    def merge(self, public: Sequence[tuple[Resolved, str]]) -> list[dict]:
        """One row a symbol, in order of first sight; internal declarations of met files follow."""
        shown, once = [], set()
        for r, entry in public:
            key = (entry, r.defined_in, r.name, r.export.kind, _normal(r.export.signature))
            if key not in once:
                once.add(key)
                shown.append((replace(r, is_internal=False), entry))
        seen, internal = {k[1:] for k in once}, []
        for file in sorted(self.parsed):
            for e in preferred(self.parsed[file].exports):
                key = (file, e.name, e.kind, _normal(e.signature))
                if e.is_wildcard or e.kind == "ExportDeclaration" or (e.is_global and e.kind == "ModuleDeclaration" and e.name == "global") or key in seen:
                    continue
                seen.add(key)
                internal.append((Resolved(e, e.name, file, is_internal=True), None))
        public = shown
        scopes, rows, folds = self.scopes(), {}, {}
        out: list[dict] = []
        for r, entry in [*public, *internal]:
            e, path, norm = r.export, self.relative(r.defined_in), _normal(r.export.signature)
            if e.kind in fixed.SCOPE_MERGED:
                key = (scopes.get(r.defined_in, f"m:{path}"), r.name, e.kind)
            elif e.kind in fixed.SIGNATURE_MERGED:
                key = (r.name, e.kind, norm)
            else:
                key = (r.name, e.kind, path, norm)
            foldable = e.kind in fixed.SCOPE_MERGED and (r.defined_in not in self.parsed or self.parsed[r.defined_in].is_module)
            fold, how = (r.name, e.kind, norm), "merge_scope"
            row = rows.get(key)
            if foldable and fold in folds and folds[fold]["file_path"] != path:
                row, how = folds[fold], "identical_fold"
            visible = [self.relative(entry)] if entry else []
            if row is None:
                row = self.row(r, path, visible, norm)
                rows[key] = row
                if foldable:
                    folds[fold] = row
                out.append(row)
                continue
            kinds = {*(row["merge_provenance"] or ()), how, *(["overload_key"] if e.kind in fixed.SIGNATURE_MERGED else [])}
            row["merge_provenance"] = sorted(kinds)
            if path != row["file_path"] and path not in row["additional_files"]:
                row["additional_files"].append(path)
            if norm and norm not in row["_norms"]:
                row["_norms"].append(norm)
                row["signature"] = f"{row['signature']}\n{e.signature}" if row["signature"] else e.signature
            for name, value in (("js_doc", e.js_doc), ("deprecated", e.deprecated), ("visibility", e.visibility), ("since", e.since)):
                row[name] = row[name] if row[name] is not None else value
            row["is_type_only"] = row["is_type_only"] and e.is_type_only
            row["is_global"] = row["is_global"] or e.is_global
            row["is_internal"] = row["is_internal"] and r.is_internal
            row["_refs"] += [x for x in e.references if x not in row["_refs"]]
            row["heritage"] += [h for h in e.heritage if h not in row["heritage"]]
            row["modifiers"] = sorted({*row["modifiers"], *e.modifiers})
            row["entry_visibility"] = sorted({*row["entry_visibility"], *visible})
        for row in out:
            if row["entry_visibility"] in ([row["file_path"]], []):
                row["entry_visibility"] = None
        return out

    def row(self, r: Resolved, path: str, visible: list[str], norm: str) -> dict:
        e, m = r.export, self.manifest
        owner, version, inner = m.name, m.version, path
        if path.startswith(f"{fixed.OUTSIDE}/") and "/node_modules/" in path:  # X10
            parts = path.split("/node_modules/", 1)[1].split("/")
            width = 2 if parts[0].startswith("@") else 1
            if len(parts) > width:
                owner, version, inner = "/".join(parts[:width]), None, "/".join(parts[width:])
        origin = self.relative(r.chain[0]) if r.chain else None
        return {
            "package": m.name, "version": m.version, "name": r.name, "kind": e.kind, "kind_code": fixed.KIND_CODES[e.kind], "file_path": path, "source_package": owner, "source_version": version, "source_path": inner,
            "additional_files": [], "entry_visibility": list(visible), "merge_provenance": None, "signature": e.signature, "js_doc": e.js_doc, "is_type_only": e.is_type_only, "symbol_space": e.space,
            "dependencies": [], "surface_dependencies": [], "re_exported_from": origin if origin != path else None, "deprecated": e.deprecated, "visibility": e.visibility, "since": e.since, "is_internal": r.is_internal,
            "is_global": e.is_global, "is_inherited": False, "inherited_from": [], "heritage": list(e.heritage), "modifiers": list(e.modifiers), "parent_id": None, "enclosing_module_id": None,
            "_refs": list(e.references), "_norms": [norm] if norm else [], "_file": r.defined_in, "_enclosing": e.enclosing,
        }

    def number(self, rows: list[dict]) -> None:
        """Ids; homonyms count in order, internal ones within their file."""
        counts: dict[str, int] = defaultdict(int)
        for s in rows:
            name = f"{s['file_path']}::{s['name']}" if s["is_internal"] else s["name"]
            counts[(s["is_internal"], name)] += 1
            n = counts[(s["is_internal"], name)]
            s["id"] = f"{s['package']}@{s['version']}::{name}" + (f"#{n}" if n > 1 else "")

    def connect(self, rows: list[dict]) -> None:
        """Dependencies of each symbol by tiers: its file, member tails, imports, directives, the package."""
        by_id = {s["id"]: s for s in rows}
        local, tails, named = defaultdict(list), defaultdict(list), defaultdict(list)
        for s in rows:
            local[(s["file_path"], s["name"])].append(s["id"])
            named[s["name"]].append(s["id"])
            if "." in s["name"]:
                tails[(s["file_path"], s["name"].rsplit(".", 1)[1])].append(s["id"])
        self.local, self.ambient = local, {}
        for s in rows:  # what an ambient NodeJS name stands for: its first reference into a runtime module
            heads = [r.name.partition(".") for r in s["_refs"] if s["name"].startswith("NodeJS.") and r.import_path is None]
            if known := next((f"node::{head}::{rest}" for head, _, rest in heads if rest and head in fixed.NODE_MODULES), None):
                self.ambient[s["name"]] = known
        for s in rows:
            imports = {}
            for i in self.parsed[s["_file"]].imports if s["_file"] in self.parsed else ():
                imports.setdefault(i.name, i)
            out = {t for r in s["_refs"] for t in self.targets_of(s, r, imports, local, tails, named, by_id)}
            s["dependencies"] = sorted(out)

    def targets_of(self, s: dict, r: Reference, imports: Mapping, local: Mapping, tails: Mapping, named: Mapping, by_id: Mapping) -> list[str]:
        head, _, rest = r.name.partition(".")
        binding = imports.get(r.name) if r.import_path is None else None
        namespace = imports.get(head) if r.import_path is None and rest else None
        source = r.import_path or (binding and binding.source) or (namespace and namespace.source)
        foreign = r.name if r.import_path else (binding.original_name or binding.name) if binding else rest
        if source and self.is_stub(source) and (stub := stub_id(source, foreign)):
            return [stub]
        at = lambda path, name: local.get((path, name)) or tails.get((path, name)) or []
        found: list[str] = []
        if r.import_path:
            for p in self.resolve(r.import_path, s["_file"]):
                found += at(self.relative(p), r.name)
            found = found or named.get(r.name, [])
        else:
            found = at(s["file_path"], r.name)
            if not found and binding:
                for p in self.resolve(binding.source, s["_file"]):
                    found += at(self.relative(p), foreign)
                found = found or named.get(foreign, []) if self.resolve(binding.source, s["_file"]) and not self.outside(binding.source) else found
            if not found and namespace:
                for p in self.resolve(namespace.source, s["_file"]):
                    found += at(self.relative(p), rest)
                if not found and not self.outside(namespace.source):
                    found = named.get(rest, [])
            if not found and not binding and not namespace:
                for p in self.reachable(s["_file"]):
                    found += at(self.relative(p), r.name)
                found = found or named.get(r.name, [])
        kept = [t for t in dict.fromkeys(found) if t != s["id"] and (r.hint is None or by_id[t]["kind"] in fixed.KINDS_BY_HINT[r.hint])]
        if r.hint == "type" and r.import_path is None and not rest:  # a plain type name means a namespace last
            kept = [t for t in kept if by_id[t]["kind"] != "ModuleDeclaration"] or kept
        if r.name.startswith("NodeJS.") and rest and (kept or not source):
            return [self.ambient.get(r.name, f"node::NodeJS::{rest}")]
        if kept:
            return kept
        stub = stub_id(source, foreign) if source else None
        return [stub] if stub else []

    def outside(self, specifier: str) -> bool:
        return not specifier.startswith((".", "/"))

    def is_stub(self, specifier: str) -> bool:
        root = package_root(specifier)
        return root is not None and root in self.stubs and root != self.manifest.name.lower()

    def reachable(self, file: str) -> list[str]:
        """Files over directives, this one included."""
        seen, rest = {file}, [file]
        while rest:
            for t in self.edges.get(rest.pop(), ()):
                if t not in seen:
                    seen.add(t)
                    rest.append(t)
        return sorted(seen)

    def picks(self, rows: list[dict]) -> dict[str, dict]:
        """A name's symbol: the last interface or alias, else the first class, namespace or other."""
        out: dict[str, dict] = {}
        for s in rows:
            if s["kind"] in ("InterfaceDeclaration", "TypeAliasDeclaration"):
                out[s["name"]] = s
        for kinds in (("ClassDeclaration",), ("ModuleDeclaration",), fixed.KIND_CODES):
            for s in rows:
                if s["kind"] in kinds:
                    out.setdefault(s["name"], s)
        return out

    def parents(self, rows: list[dict]) -> None:
        """Lexical parents by rank of kinds, and enclosing modules."""
        by_id, picks = {s["id"]: s for s in rows}, self.picks(rows)
        for s in rows:
            if (name := dotted_parent(s["name"])) is not None:
                candidates = self.local.get((s["file_path"], name), [])
                table = fixed.PARENT_RANKS[member_sort(s)]
                rank = lambda i, t=table: (t.index(by_id[i]["kind"]) if by_id[i]["kind"] in t else fixed.DEFAULT_PARENT_RANK, i)
                s["parent_id"] = min(candidates, key=rank) if candidates else picks[name]["id"] if name in picks else None
            if s["_enclosing"] is not None and not (s["kind"] == "ModuleDeclaration" and s["name"] == s["_enclosing"]):
                modules = [i for i in self.local.get((s["file_path"], s["_enclosing"]), []) if by_id[i]["kind"] == "ModuleDeclaration"]
                s["enclosing_module_id"] = min(modules, default=None)

    def inherit(self, rows: list[dict]) -> None:
        """Adds members that classes and interfaces get from their bases."""
        members: dict[str, list[dict]] = defaultdict(list)
        for s in rows:
            if (name := dotted_parent(s["name"])) is not None:
                members[name].append(s)
        picks, heritage = self.picks(rows), defaultdict(list)
        for s in rows:
            if s["kind"] in ("ClassDeclaration", "InterfaceDeclaration"):
                heritage[s["name"]] += [h for h in s["heritage"] if h not in heritage[s["name"]]]
        added: dict[tuple[str, str], dict] = {}
        leaf = lambda s: s["name"].rsplit(".", 1)[-1]
        for child, bases in heritage.items():
            own, seen, rest = {leaf(m) for m in members[child]}, set(), [heritage_key(b) for b in bases]
            while rest:
                base = rest.pop(0)
                if base in seen or base not in picks:
                    seen.add(base)
                    continue
                seen.add(base)
                rest += [heritage_key(h) for h in picks[base]["heritage"]]
                for m in members[base]:
                    if leaf(m) in own or m["visibility"] == "internal":
                        continue
                    key = (child, leaf(m))
                    if key in added:
                        added[key]["inherited_from"] = sorted({*added[key]["inherited_from"], m["id"]})
                        continue
                    name = f"{child}.prototype.{leaf(m)}" if ".prototype." in m["name"] else f"{child}.{leaf(m)}"
                    added[key] = {**m, "name": name, "id": f"{m['package']}@{m['version']}::{name}", "is_inherited": True, "inherited_from": [m["id"]], "additional_files": [], "merge_provenance": None}
        rows += [added[k] for k in sorted(added)]

    def roll_up(self, rows: list[dict]) -> None:
        """A namespace's surface: the dependencies of its members."""
        below: dict[str, set[str]] = defaultdict(set)
        for s in rows:
            if s["parent_id"]:
                below[s["parent_id"]].update(s["dependencies"])
        for s in rows:
            if s["kind"] == "ModuleDeclaration":
                s["surface_dependencies"] = sorted(below[s["id"]])


def preferred(exports: Sequence[Export]) -> list[Export]:
    """By name and kind; where a declaration stands beside its exported wrapper, it alone."""
    groups: dict[tuple[str, str], list[Export]] = defaultdict(list)
    for e in exports:
        groups[(f"{e.name}::{fixed.KIND_CODES[e.kind]}", e.kind)].append(e)
    out = []
    for (_, kind), rows in sorted(groups.items()):
        inner = [e for e in rows if not e.is_explicit]
        paired = 0 < len(inner) < len(rows) and kind in ("ClassDeclaration", "FunctionDeclaration", "InterfaceDeclaration", "TypeAliasDeclaration", "EnumDeclaration")
        out += inner if paired else rows
    return out


def package_root(specifier: str) -> str | None:
    if re.match(r"^([./]|[A-Za-z]:|(?i:node|file):)", specifier) or "://" in specifier:
        return None
    m = re.match(r"^(@[^/]+/[^/\\]+|[^@/\\][^/\\]*)", specifier.strip())
    return m[1].lower() if m else None


def stub_id(source: str, member: str) -> str | None:
    """The id of something in a module that isn't part of the graph."""
    if source in fixed.NODE_MODULES:
        return f"node::{source}::{member}"
    if m := re.match(r"^([a-z][a-z0-9+.-]*):(.*)$", source):
        return f"{m[1]}::{m[2].removeprefix('//')}::{member}"
    return None if re.match(r"^([./]|[A-Za-z]:)", source) else f"npm::{source}::{member}"


def dotted_parent(name: str) -> str | None:
    if ".prototype." in name:
        return name.split(".prototype.")[0] or None
    return name.rsplit(".", 1)[0] if "." in name else None


def heritage_key(text: str) -> str:
    return text.split("<")[0].strip()


def member_sort(s: Mapping) -> str:
    if s["kind"] in ("MethodDeclaration", "PropertyDeclaration"):
        return "declared_member"
    if s["kind"] in ("InterfaceDeclaration", "ClassDeclaration", "EnumDeclaration", "TypeAliasDeclaration"):
        return "declaration"
    return "type_shape" if s["symbol_space"] == "type" or s["kind"] in fixed.SIGNATURE_MERGED else "value"


def build(files: Mapping[str, str], folder: str, max_hops: int = 10, stubs: Sequence[str] = ()) -> list[dict]:
    """The symbols of the package in ``folder``, given all files it may reach by path."""
    return Package(files, folder, max_hops, stubs).symbols()


class Kept:
    """What was made of equal inputs, up to so many bytes in a process; what came first goes first."""

    def __init__(self, most: int):
        self.most, self.held, self.made = most, 0, {}

    def get(self, key: bytes, make: Callable[[], pa.RecordBatch]) -> pa.RecordBatch:
        if key not in self.made:
            self.made[key] = made = make()
            self.held += made.nbytes + EACH
            while self.held > self.most and len(self.made) > 1:
                self.held -= self.made.pop(next(iter(self.made))).nbytes + EACH
            return made
        return self.made[key]


#: Bytes of an entry besides its rows; of all kept rows; of the largest package that is looked for among them.
EACH, MOST, LARGEST = 8_192, 160 << 20, 1 << 16
_trees = Kept(MOST)


def _tree_key(files: Mapping[str, str], folder: str, max_hops: int, stubs: Sequence[str]) -> bytes | None:
    """A digest of the files as they lie in their install root: equal ones give equal symbols, wherever the root is.

    Null where the root could matter: files outside of it, texts that may name it, or no root.
    """
    root = folder.partition("/node_modules/")[0]
    name, start = posixpath.basename(root), f"{root}/"
    if not name or root == folder or sum(len(t or "") for t in files.values()) > LARGEST:
        return None
    out = hashlib.blake2b(f"{folder[len(root):]} {max_hops} {sorted(stubs)}".encode(), digest_size=16)
    for path, text in sorted(files.items()):
        if not path.startswith(start) or text is not None and (name in text or "\\" in text):
            return None
        out.update(f"{len(path) - len(root)} {-1 if text is None else len(text)} {path[len(root):]}{text or ''}".encode(errors="surrogatepass"))
    return out.digest()


def table(files: Mapping[str, str], folder: str, max_hops: int = 10, stubs: Sequence[str] = ()) -> pa.RecordBatch:
    """``build`` as rows of SYMBOLS. Copies of small packages, with all that they may reach, are built once."""
    make = lambda: pa.RecordBatch.from_pylist(build(files, folder, max_hops, stubs), ARROW)
    key = _tree_key(files, folder, max_hops, stubs)
    return make() if key is None else _trees.get(key, make)
