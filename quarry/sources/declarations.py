"""Type-declaration files to rows: a tokenizer, a type parser and statement extraction.

One pass over tokens with positions; a statement that doesn't parse is skipped up to its
end, so that a file always gives what can be read. Types are parsed into small trees, from
which come references and flattened members.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache

from quarry.functions.fixed import BUILTIN_TYPES, MODIFIERS, VISIBILITY_TAGS

MAX_DEPTH = 10
_BUILTIN = frozenset(BUILTIN_TYPES)
_LEXEME = re.compile(
    r"""(?P<space>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<text>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<number>\d[\w.]*)"""
    r"""|(?P<word>\#?[A-Za-z_$\u0080-\U0010FFFF][\w$\u0080-\U0010FFFF]*)|(?P<template>`)|(?P<sign>=>|\.\.\.|.)""",
    re.DOTALL | re.VERBOSE,
)


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    start: int
    end: int


@dataclass
class Reference:
    name: str
    import_path: str | None = None
    hint: str | None = None


@dataclass
class Member:
    """A member of an object type."""

    kind: str
    name: str | None  # null: a call, construct or index signature, or a computed name
    start: int
    end: int
    type: Type | None
    references: list[Reference]
    static: bool = False
    private: bool = False
    modifiers: list[str] = field(default_factory=list)


@dataclass
class Type:
    """What flattening needs of a type: ``object``, ``all`` (intersection), ``name``, ``typeof``, ``import`` or ``other``."""

    kind: str
    name: str = ""
    source: str = ""  # of an import
    members: list[Member] = field(default_factory=list)
    parts: list[Type] = field(default_factory=list)


@dataclass
class Export:
    """One declaration or export clause."""

    name: str
    kind: str
    signature: str | None = None
    js_doc: str | None = None
    deprecated: str | None = None
    visibility: str | None = None
    since: str | None = None
    references: list[Reference] = field(default_factory=list)
    heritage: list[str] = field(default_factory=list)
    modifiers: list[str] = field(default_factory=list)
    is_explicit: bool = False
    is_type_only: bool = False
    source: str | None = None
    original_name: str | None = None
    is_wildcard: bool = False
    is_namespace_export: bool = False
    is_global: bool = False
    enclosing: str | None = None
    declared_in: str | None = None
    remote: tuple[str, str] | None = None  # specifier and name of what its type imports whole

    @property
    def space(self) -> str:
        return "type" if self.is_type_only or self.kind in ("InterfaceDeclaration", "TypeAliasDeclaration", "PropertySignature", "MethodSignature") else "value"


@dataclass
class Import:
    name: str
    source: str
    original_name: str | None = None
    is_default: bool = False
    is_namespace: bool = False


@dataclass
class Parsed:
    exports: list[Export] = field(default_factory=list)
    imports: list[Import] = field(default_factory=list)
    references: list[str] = field(default_factory=list)
    type_references: list[str] = field(default_factory=list)
    is_module: bool = False
    skipped: int = 0  # statements that didn't parse


class Fault(ValueError):
    pass


def tokens_of(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _LEXEME.match(text, at)
        kind = m.lastgroup
        if kind == "template":
            end, depth = at + 1, 0
            while end < len(text) and not (text[end] == "`" and not depth):
                depth += text.startswith("${", end) - (text[end] == "}" and depth > 0)
                end += 2 if text[end] == "\\" else 1
            end = min(end + 1, len(text))
            out.append(Token("text", text[at:end], at, end))
            at = end
            continue
        if kind != "space":
            out.append(Token(kind, m[0], m.start(), m.end()))
        at = m.end()
    return out


def directives(text: str) -> tuple[list[str], list[str]]:
    """(paths, type packages) of the ``///`` lines that lead a file."""
    paths, types, inside = [], [], False
    for line in text.splitlines():
        line = line.strip()
        if inside:
            inside = "*/" not in line
        elif line.startswith("/*"):
            inside = "*/" not in line
        elif line.startswith("///"):
            if m := re.search(r"""<reference\s+path\s*=\s*["']([^"']+)["']""", line):
                paths.append(m[1])
            elif m := re.search(r"""<reference\s+types\s*=\s*["']([^"']+)["']""", line):
                types.append(m[1])
        elif line and not line.startswith(("//", "#!")):
            break
    return paths, types


def documentation(comment: str) -> dict[str, str | None]:
    """Description, first ``@deprecated`` (``true`` without a message), ``@since`` and visibility of a doc comment."""
    lines = [re.sub(r"^\s*\*? ?", "", x).rstrip() for x in comment.removeprefix("/**").removesuffix("*/").split("\n")]
    out: dict[str, str | None] = {"js_doc": None, "deprecated": None, "since": None, "visibility": None}
    parts: list[list[str]] = [[]]
    for x in lines:
        if x.lstrip().startswith("@"):
            parts.append([x.lstrip()])
        else:
            parts[-1].append(x)
    out["js_doc"] = "\n".join(x for x in parts[0] if x.strip()).strip() or None  # empty lines go
    for p in parts[1:]:
        tag, _, rest = " ".join(p).strip().partition(" ")
        name, rest = tag[1:], rest.strip()
        if name == "deprecated" and out["deprecated"] is None:
            out["deprecated"] = rest or "true"
        elif name == "since" and out["since"] is None:
            out["since"] = rest or None
        elif name in VISIBILITY_TAGS and out["visibility"] is None:
            out["visibility"] = name
    return out


class _Reader:
    """A cursor over tokens, and the type grammar."""

    def __init__(self, text: str):
        self.text, self.tokens, self.at = text, tokens_of(text), 0
        self.scopes: list[set[str]] = []
        self.found: list[Reference] = []

    # cursor ------------------------------------------------------------------------------

    def peek(self, ahead: int = 0) -> str:
        k = self.at + ahead
        return self.tokens[k].text if k < len(self.tokens) else ""

    def kind(self, ahead: int = 0) -> str:
        k = self.at + ahead
        return self.tokens[k].kind if k < len(self.tokens) else ""

    def take(self, *wanted: str) -> str:
        if self.at >= len(self.tokens) or (wanted and self.peek() not in wanted):
            raise Fault(f"{self.peek()!r} where {wanted} is due")
        self.at += 1
        return self.tokens[self.at - 1].text

    def word(self) -> str:
        if self.kind() != "word":
            raise Fault(f"{self.peek()!r} where a name is due")
        return self.take()

    def maybe(self, *wanted: str) -> bool:
        if self.peek() in wanted and self.kind() != "text":
            self.at += 1
            return True
        return False

    @property
    def start(self) -> int:
        return self.tokens[self.at].start if self.at < len(self.tokens) else len(self.text)

    @property
    def last_end(self) -> int:
        return self.tokens[self.at - 1].end if self.at else 0

    def string(self) -> str:
        if self.kind() != "text":
            raise Fault(f"{self.peek()!r} where a string is due")
        return self.take()[1:-1]

    def new_line_before(self) -> bool:
        return "\n" in self.text[self.last_end : self.start]

    def match(self, open_: int) -> int:
        """The index after the bracket that closes the one at index ``open_``."""
        pairs, depth = {"(": ")", "[": "]", "{": "}", "<": ">"}, []
        for k in range(open_, len(self.tokens)):
            t = self.tokens[k]
            if t.kind != "sign":
                continue
            if t.text in "([{" or (t.text == "<" and open_ == k) or (t.text == "<" and depth and depth[0] == ">"):
                depth.append(pairs[t.text])
            elif depth and t.text == depth[-1]:
                depth.pop()
                if not depth:
                    return k + 1
        raise Fault("an open bracket")

    def doc_before(self, position: int) -> dict[str, str | None]:
        before = self.text[:position].rstrip()
        if not before.endswith("*/") or (begin := before.rfind("/*")) < 0 or not before.startswith("/**", begin) or before[begin:] == "/**/":
            return {"js_doc": None, "deprecated": None, "since": None, "visibility": None}
        return documentation(before[begin:])

    # references --------------------------------------------------------------------------

    def refer(self, name: str, import_path: str | None = None, hint: str | None = "type") -> None:
        first = name.split(".")[0]
        if import_path is None and hint == "type" and (name in _BUILTIN or any(first in s for s in self.scopes)):
            return
        ref = Reference(name, import_path, hint)
        if ref not in self.found:
            self.found.append(ref)

    def collecting(self, parse) -> tuple[object, list[Reference]]:
        """(result, references) of a part alone; they count for what is around it, too."""
        outer, self.found = self.found, []
        try:
            out = parse()
        finally:
            own, self.found = self.found, outer
        for r in own:
            if r not in outer:
                outer.append(r)
        return out, own

    # types -------------------------------------------------------------------------------

    def type_parameters(self) -> set[str]:
        """Names in ``<...>``, in scope until the caller pops them."""
        names: set[str] = set()
        self.scopes.append(names)
        if self.maybe("<"):
            mark, depth = self.at, 0  # all names count in all bounds
            for k in range(self.at, len(self.tokens)):
                x = self.tokens[k].text
                depth += (x in "<([{" and self.tokens[k].kind == "sign") - (x in ">)]}" and self.tokens[k].kind == "sign")
                if depth < 0:
                    break
                if depth == 0 and self.tokens[k].kind == "word" and (k == mark or self.tokens[k - 1].text in (",", "const", "in", "out")) and x not in ("const", "in", "out"):
                    names.add(x)
            while not self.maybe(">"):
                while self.peek() in ("const", "in", "out") and self.kind(1) == "word":
                    self.take()
                self.word()
                if self.maybe("extends"):
                    self.type()
                if self.maybe("="):
                    self.type()
                if not self.maybe(","):
                    self.take(">")
                    break
        return names

    def type(self) -> Type:
        out = self.union()
        if self.peek() == "extends" and not self.new_line_before() and self.kind() == "word":
            self.take()
            self.scopes.append(set())
            self.union()
            if self.maybe("?"):
                self.type()
                self.scopes.pop()
                self.take(":")
                self.type()
                return Type("other")
            self.scopes.pop()
        return out

    def union(self) -> Type:
        self.maybe("|")
        parts = [self.intersection()]
        while self.maybe("|"):
            parts.append(self.intersection())
        return parts[0] if len(parts) == 1 else Type("other", parts=parts)

    def intersection(self) -> Type:
        self.maybe("&")
        parts = [self.prefixed()]
        while self.maybe("&"):
            parts.append(self.prefixed())
        return parts[0] if len(parts) == 1 else Type("all", parts=parts)

    def prefixed(self) -> Type:
        if self._is_operator():
            self.take()
            self.prefixed()
            return Type("other")
        if self.peek() == "infer" and self.kind(1) == "word":
            self.take()
            name = self.word()
            if self.scopes:
                self.scopes[-1].add(name)
            if self.peek() == "extends":
                mark = self.at
                self.take()
                self.union()
                if self.peek() == "?":  # it was the condition of what is around
                    self.at = mark
            return Type("other")
        out = self.primary()
        while self.peek() == "[" and not self.new_line_before():
            self.take()
            if not self.maybe("]"):
                self.type()
                self.take("]")
            out = Type("other")
        return out

    def _is_operator(self) -> bool:
        if self.peek() not in ("keyof", "unique", "readonly") or self.kind() != "word":
            return False
        return self.kind(1) in ("word", "text") or self.peek(1) in ("(", "{", "[")

    def arguments(self) -> None:
        if self.peek() == "<" and not self.new_line_before():
            self.take()
            while not self.maybe(">"):
                self.type()
                if not self.maybe(","):
                    self.take(">")
                    break

    def primary(self) -> Type:
        text, kind = self.peek(), self.kind()
        if kind in ("text", "number"):
            self.take()
            if kind == "text" and text.startswith("`"):
                for inner in re.findall(r"\$\{([^{}]*)\}", text):
                    part = _Reader(inner)
                    part.scopes, part.found = self.scopes, self.found
                    part.type()
            return Type("other")
        if text == "-":
            self.take()
            self.take()
            return Type("other")
        if text == "<" or (text == "(" and self._is_function()):
            return self.function_type()
        if text == "(":
            self.take()
            out = self.type()
            self.take(")")
            return out
        if text == "{":
            return self.object_type()
        if text == "[":
            self.take()
            while not self.maybe("]"):
                self.maybe("...")
                if self.kind() == "word" and (self.peek(1) == ":" or (self.peek(1) == "?" and self.peek(2) == ":")):
                    self.take()
                    self.maybe("?")
                    self.take(":")
                self.type()
                self.maybe("?")
                if not self.maybe(","):
                    self.take("]")
                    break
            return Type("other")
        if text == "new" or (text == "abstract" and self.peek(1) == "new"):
            self.maybe("abstract")
            self.take("new")
            return self.function_type()
        if text == "typeof" and kind == "word":
            self.take()
            if self.peek() == "import":
                return self.imported("value")
            name = self.dotted()
            self.refer(name, hint="value")
            self.arguments()
            return Type("typeof", name)
        if text == "import":
            return self.imported("type")
        if text == "asserts" and self.kind(1) == "word" and not self.new_line_before() and self.peek(1) != "is":
            self.take()
            self.take()
            if self.maybe("is"):
                self.type()
            return Type("other")
        if kind != "word":
            raise Fault(f"{text!r} where a type is due")
        if self.peek(1) == "is" and self.kind(2) != "" and self.kind(1) == "word" and self.peek(2) not in (",", ";", ")", "}"):
            self.take()
            self.take()
            self.type()
            return Type("other")
        if text == "this":
            self.take()
            return Type("other")
        name = self.dotted()
        if name not in ("true", "false"):
            self.refer(name)
        self.arguments()
        return Type("name", name)

    def dotted(self) -> str:
        name = self.word()
        while self.peek() == "." and self.kind(1) == "word":
            self.take()
            name += "." + self.word()
        return name

    def imported(self, hint: str) -> Type:
        self.take("import")
        self.take("(")
        source = self.string()
        if self.maybe(","):
            self.type()
        self.take(")")
        name = ""
        if self.maybe("."):
            name = self.dotted()
        if name:
            self.refer(name, source, hint)
        self.arguments()
        return Type("import", name, source) if name and "." not in name else Type("other")

    def _is_function(self) -> bool:
        after = self.match(self.at)
        return after < len(self.tokens) and self.tokens[after].text == "=>"

    def function_type(self) -> Type:
        self.type_parameters()
        self.parameters()
        self.take("=>")
        self.type()
        self.scopes.pop()
        return Type("other")

    def parameters(self) -> None:
        self.take("(")
        while not self.maybe(")"):
            while self.peek() in MODIFIERS and self.kind(1) == "word":
                self.take()
            self.maybe("...")
            if self.peek() in ("{", "["):
                self.at = self.match(self.at)
            else:
                self.word()
            self.maybe("?")
            if self.maybe(":"):
                self.type()
            if self.maybe("="):
                self.expression(",", ")")
            if not self.maybe(","):
                self.take(")")
                break

    def expression(self, *ends: str) -> None:
        """Skips an initialiser."""
        while self.at < len(self.tokens) and self.peek() not in ends and self.peek() not in (";", "}"):
            self.at = self.match(self.at) if self.peek() in ("(", "[", "{") else self.at + 1

    def object_type(self) -> Type:
        self.take("{")
        out = Type("object")
        mark = self.at
        self.scopes.append(set())
        # a mapped type: { [K in T as N]: V }
        ahead = self.at + (self.peek() in ("+", "-")) + (self.peek(self.peek() in ("+", "-")) == "readonly")
        if ahead + 2 < len(self.tokens) and self.tokens[ahead].text == "[" and self.tokens[ahead + 2].text == "in":
            self.at = ahead + 1
            self.scopes[-1].add(self.word())
            self.take("in")
            self.type()
            if self.maybe("as"):
                self.type()
            self.take("]")
            self.maybe("+", "-")
            self.maybe("?")
            if self.maybe(":"):
                self.type()
            self.maybe(";", ",")
            self.take("}")
            self.scopes.pop()
            return Type("other")
        self.at = mark
        while not self.maybe("}"):
            if self.maybe(";", ","):
                continue
            out.members.append(self.member(in_class=False))
        self.scopes.pop()
        return out

    def member(self, in_class: bool) -> Member:
        """One member with its separator."""
        begin = self.start
        flags: list[str] = []
        while self.peek() == "@":  # a decorator
            self.take()
            self.dotted()
            if self.peek() == "(":
                self.at = self.match(self.at)
        while self.peek() in MODIFIERS and self.kind() == "word" and self.peek(1) not in ("(", ":", "?", ";", "=", "}", ",", "!", "<", ""):
            flags.append(self.take())
        (kind, name, type_), references = self.collecting(lambda: self._member_body(in_class))
        if self.peek() in (";", ",") and self.kind() == "sign":
            self.take()
        private = "private" in flags or bool(name and name.startswith("#"))
        return Member(kind, name, begin, self.last_end, type_, references, "static" in flags, private, sorted(set(flags)))

    def _member_body(self, in_class: bool) -> tuple[str, str | None, Type | None]:
        accessor = None
        if self.peek() in ("get", "set") and self.kind(1) in ("word", "text", "number") or (self.peek() in ("get", "set") and self.peek(1) == "["):
            accessor = "GetAccessor" if self.take() == "get" else "SetAccessor"
        self.maybe("*")
        name: str | None
        if self.peek() == "[":
            close = self.match(self.at)
            inside = self.text[self.tokens[self.at].start : self.tokens[close - 1].end]
            if self.kind(1) == "word" and self.peek(2) == ":":  # an index signature
                self.take()
                self.word()
                self.take(":")
                self.type()
                self.take("]")
                name = None
            else:
                literal = re.fullmatch(r"""\[\s*(["'])(.*)\1\s*\]""", inside, re.DOTALL)
                self.at, name = close, literal[2] if literal else inside
        elif self.peek() in ("(", "<"):
            name = None
        elif self.peek() == "new" and self.peek(1) in ("(", "<"):
            self.take()
            name = None
        elif self.kind() == "text":
            name = self.string()
        else:
            name = self.take()
        self.maybe("?", "!")
        if self.peek() in ("(", "<"):
            self.type_parameters()
            self.parameters()
            if self.maybe(":"):
                self.type()
            self.scopes.pop()
            if self.peek() == "{":
                self.at = self.match(self.at)
            return accessor or ("MethodDeclaration" if in_class else "MethodSignature"), name, None
        type_ = None
        if self.maybe(":"):
            type_ = self.type()
        if self.maybe("="):
            self.expression(";")
        return accessor or ("PropertyDeclaration" if in_class else "PropertySignature"), name, type_


class _File(_Reader):
    """Statements of a declaration file."""

    def __init__(self, text: str):
        super().__init__(text)
        self.out = Parsed()
        self.local: dict[str, Type] = {}  # declared in this file: what flattening may look into
        self.prefixes: list[str] = []  # of names in the enclosing modules, innermost last
        self.enclosing: list[str] = []

    def parse(self) -> Parsed:
        self.statements()  # a first pass to know all local types
        self.at, self.out = 0, Parsed()
        self.out.references, self.out.type_references = directives(self.text)
        self.out.is_module = self._is_module()
        self.out.exports = self.statements()
        return self.out

    def _is_module(self) -> bool:
        depth = 0
        for k, t in enumerate(self.tokens):
            if t.kind == "sign":
                depth += (t.text in "{([") - (t.text in "})]")
            elif depth == 0 and t.kind == "word" and t.text in ("import", "export") and (not k or self.tokens[k - 1].text not in (".", "typeof", ":", "=", "|", "&", "<", "=>")):
                return True
        return False

    def statements(self) -> list[Export]:
        out: list[Export] = []
        while self.at < len(self.tokens) and self.peek() != "}":
            mark = self.at
            try:
                self.found = []
                out += self.statement()
            except (Fault, IndexError):
                self.out.skipped += 1
                self.at = mark
                self.skip()
            if self.at == mark:
                self.at += 1
        return out

    def skip(self) -> None:
        while self.at < len(self.tokens) and self.peek() != "}":
            if self.peek() in ("(", "[", "{"):
                block = self.peek() == "{"
                try:
                    self.at = self.match(self.at)
                except Fault:
                    self.at = len(self.tokens)
                if block:
                    return
            elif self.take() == ";":
                return

    def end(self) -> None:
        self.maybe(";")

    def described(self, e: Export, position: int) -> Export:
        for k, v in self.doc_before(position).items():
            setattr(e, k, v)
        return e

    def statement(self) -> list[Export]:
        while self.peek() == "@":  # decorators of a class
            self.take()
            self.dotted()
            if self.peek() == "(":
                self.at = self.match(self.at)
        begin = self.start
        if self.maybe(";"):
            return []
        if self.peek() == "import" and self.peek(1) not in ("(", "."):
            return self.import_statement(begin, explicit=False)
        explicit = False
        if self.peek() == "export":
            self.take()
            explicit = True
            head = self.peek()
            if head in ("{", "*") or (head == "type" and self.peek(1) in ("{", "*")):
                return self.export_clause(begin)
            if head == "=":
                self.take()
                name = self.dotted() if self.kind() == "word" else None
                self.expression(";")
                self.end()
                return [Export(name.split(".")[0] if name and "." not in name else "default", "ExportAssignment", self.text[begin : self.last_end], is_explicit=True)]
            if head == "as" and self.peek(1) == "namespace":
                self.take()
                self.take()
                name = self.word()
                self.end()
                return [self.described(Export(name, "NamespaceExportDeclaration", self.text[begin : self.last_end], is_explicit=True, is_namespace_export=True), begin)]
            if head == "default":
                return self.default_export(begin)
            if head == "import":
                return self.import_statement(begin, explicit=True)
        return self.declaration(begin, explicit)

    # modules -----------------------------------------------------------------------------

    def import_statement(self, begin: int, explicit: bool) -> list[Export]:
        self.take("import")
        if self.kind() == "text":
            self.string()
            self.end()
            return []
        if self.peek() == "type" and self.peek(1) not in ("from", ",", "="):
            self.take()
        if self.kind() == "word" and self.peek(1) == "=":
            name = self.word()
            self.take("=")
            if self.peek() == "require":
                self.take()
                self.take("(")
                source = self.string()
                self.take(")")
                self.end()
                self.out.imports.append(Import(name, source))
                return [Export(name, "ImportEqualsDeclaration", self.text[begin : self.last_end], is_explicit=True, source=source)] if explicit else []
            target = self.dotted()
            self.end()
            return [Export(name, "ImportEqualsDeclaration", self.text[begin : self.last_end], is_explicit=explicit, original_name=target)]
        found: list[Import] = []
        if self.kind() == "word":
            found.append(Import(self.word(), "", is_default=True))
            self.maybe(",")
        if self.maybe("*"):
            self.take("as")
            found.append(Import(self.word(), "", is_namespace=True))
        elif self.maybe("{"):
            while not self.maybe("}"):
                if self.peek() == "type" and self.peek(1) not in (",", "}", "as"):
                    self.take()
                name = self.string() if self.kind() == "text" else self.take()
                own = self.word() if self.maybe("as") else name
                found.append(Import(own, "", name if own != name else None, is_default=name == "default"))
                if not self.maybe(","):
                    self.take("}")
                    break
        self.take("from")
        source = self.string()
        if self.maybe("with", "assert"):
            self.at = self.match(self.at)
        self.end()
        for i in found:
            i.source = source
        self.out.imports += found
        return []

    def export_clause(self, begin: int) -> list[Export]:
        type_only = self.maybe("type")
        rows: list[Export] = []
        if self.maybe("*"):
            name = None
            if self.maybe("as"):
                name = self.string() if self.kind() == "text" else self.take()
            rows.append(Export(name or "*", "ExportDeclaration", is_explicit=True, is_wildcard=name is None, is_namespace_export=name is not None, is_type_only=type_only))
        else:
            self.take("{")
            while not self.maybe("}"):
                own_type = self.peek() == "type" and self.peek(1) not in (",", "}", "as") and bool(self.take())
                name = self.string() if self.kind() == "text" else self.take()
                shown = (self.string() if self.kind() == "text" else self.take()) if self.maybe("as") else name
                rows.append(Export(shown, "ExportDeclaration", is_explicit=True, original_name=name if shown != name else None, is_type_only=type_only or own_type))
                if not self.maybe(","):
                    self.take("}")
                    break
        source = None
        if self.maybe("from"):
            source = self.string()
            if self.maybe("with", "assert"):
                self.at = self.match(self.at)
        self.end()
        for r in rows:
            r.source, r.signature = source, self.text[begin : self.last_end]
        return rows

    def default_export(self, begin: int) -> list[Export]:
        """The default wrapper, named as what it exports, and the declaration inside."""
        self.take("default")
        if self.peek() in ("function", "class", "interface", "abstract", "async"):
            rows = self.declaration(begin, False, default=True)
            inner = rows[0]
            wrapper = Export(inner.name, inner.kind, self.text[begin : self.last_end], is_explicit=True, is_type_only=inner.is_type_only, modifiers=["default"])
            for m in rows[1:]:
                m.is_explicit = inner.kind == "ClassDeclaration"
            return [wrapper, *(rows[1:] if inner.name == "default" else rows)]
        name = self.dotted() if self.kind() == "word" else None
        self.expression(";")
        self.end()
        return [Export(name if name and "." not in name else "default", "ExportAssignment", self.text[begin : self.last_end], is_explicit=True, modifiers=["default"])]

    # declarations ------------------------------------------------------------------------

    def declaration(self, begin: int, explicit: bool, default: bool = False) -> list[Export]:
        own = self.start
        flags = ["export"] if explicit else []
        while self.peek() in ("declare", "abstract", "async", "const") and self.kind(1) == "word" and not (self.peek() == "const" and self.peek(1) != "enum"):
            flags.append(self.take())
        first = begin if explicit else own
        head = self.peek()
        if head == "global" and self.peek(1) == "{":
            return self.module(begin, first, True, flags, is_global=True)
        if head in ("namespace", "module") and self.kind(1) in ("word", "text"):
            return self.module(begin, first, explicit, flags)
        if head not in ("function", "class", "interface", "type", "enum", "const", "let", "var"):
            raise Fault(f"{head!r} begins no declaration")
        if head in ("const", "let", "var"):
            return self.variables(begin, explicit, flags)
        self.take()
        self.maybe("*")
        name = self.word() if self.kind() == "word" and not (default and self.peek() in ("extends", "implements")) else "default"
        rows = {"function": self.function, "class": self.class_, "interface": self.interface, "type": self.alias, "enum": self.enum}[head](name)
        base = rows[0]
        base.signature, base.is_explicit, base.modifiers = self.text[first : self.last_end], explicit, sorted(set(flags))
        self.described(base, begin)
        for m in rows[1:]:
            m.is_explicit = explicit
            if m.js_doc is None and base.kind == "ClassDeclaration":
                m.js_doc = base.js_doc
            if m.deprecated is None:
                m.deprecated = base.deprecated
            if m.visibility is None:
                m.visibility = base.visibility
            if m.since is None:
                m.since = base.since
        return rows

    def function(self, name: str) -> list[Export]:
        def body() -> None:
            self.type_parameters()
            self.parameters()
            if self.maybe(":"):
                self.type()
            self.scopes.pop()
            if self.peek() == "{":
                self.at = self.match(self.at)

        _, references = self.collecting(body)
        self.end()
        return [Export(name, "FunctionDeclaration", references=references)]

    def bases(self) -> list[str]:
        out = []
        while True:
            begin = self.start
            name = self.dotted()
            self.refer(name)
            if self.peek() == "(":  # a mixin
                self.at = self.match(self.at)
            self.arguments()
            out.append(self.text[begin : self.last_end])
            if not self.maybe(","):
                return out

    def class_(self, name: str) -> list[Export]:
        heritage: list[str] = []
        members: list[Member] = []

        def body() -> None:
            self.type_parameters()
            while self.peek() in ("extends", "implements"):
                self.take()
                heritage.extend(self.bases())
            self.take("{")
            while not self.maybe("}"):
                if not self.maybe(";"):
                    members.append(self.member(in_class=True))
            self.scopes.pop()

        _, references = self.collecting(body)
        self.local[name] = Type("object", members=members)
        rows = [Export(name, "ClassDeclaration", references=references, heritage=heritage)]
        for m in members:
            if m.name is None or m.private or m.name == "constructor":
                continue
            rows.append(self.member_row(f"{name}.{m.name}" if m.static else f"{name}.prototype.{m.name}", m))
        return rows

    def member_row(self, full: str, m: Member) -> Export:
        row = Export(full, m.kind, self.text[m.start : m.end], references=m.references, modifiers=m.modifiers)
        self.described(row, m.start)
        if row.visibility is None and (m.name or "").startswith("_"):
            row.visibility = "internal"
        return row

    def interface(self, name: str) -> list[Export]:
        heritage: list[str] = []

        def body() -> Type:
            self.type_parameters()
            if self.maybe("extends"):
                heritage.extend(self.bases())
            out = self.object_type()
            self.scopes.pop()
            return out

        shape, references = self.collecting(body)
        self.local[name] = shape
        rows = [Export(name, "InterfaceDeclaration", references=references, heritage=heritage, is_type_only=True)]
        return rows + list(self.flattened(name, shape))

    def flattened(self, name: str, shape: Type | None, depth: int = 0, seen: frozenset[str] = frozenset()) -> Iterator[Export]:
        """Rows of the members of a type: objects, intersections, and what names and typeof stand for here."""
        if shape is None or depth > MAX_DEPTH:
            return
        if shape.kind == "object":
            for m in shape.members:
                if m.name is not None and not m.private and m.name != "constructor":
                    yield self.member_row(f"{name}.{m.name}", m)
                    if m.type is not None:
                        yield from self.flattened(f"{name}.{m.name}", m.type, depth + 1, seen)
        elif shape.kind == "all":
            for p in shape.parts:
                yield from self.flattened(name, p, depth + 1, seen)
        elif shape.kind == "typeof" or (shape.kind == "name" and (depth > 0 or not self.prefixes)):
            if shape.name in self.local and shape.name not in seen:
                yield from self.flattened(name, self.local[shape.name], depth + 1, seen | {shape.name})

    def alias(self, name: str) -> list[Export]:
        def body() -> Type:
            self.type_parameters()
            self.take("=")
            out = self.type()
            self.scopes.pop()
            return out

        shape, references = self.collecting(body)
        self.end()
        self.local[name] = shape
        return [Export(name, "TypeAliasDeclaration", references=references, is_type_only=True, remote=remote(shape)), *self.flattened(name, shape)]

    def enum(self, name: str) -> list[Export]:
        self.at = self.match(self.at) if self.peek() == "{" else self.at
        return [Export(name, "EnumDeclaration")]

    def variables(self, begin: int, explicit: bool, flags: list[str]) -> list[Export]:
        self.take("const", "let", "var")
        rows: list[Export] = []
        while True:
            if self.peek() in ("{", "["):  # a pattern declares no single name
                self.at = self.match(self.at)
                name = None
            else:
                name = self.word()
            shape, text, references = None, "any", []
            self.maybe("!")
            if self.maybe(":"):
                from_ = self.start
                shape, references = self.collecting(self.type)
                text = self.text[from_ : self.last_end]
            if self.maybe("="):
                self.expression(",", ";")
            if name is not None:
                row = self.described(Export(name, "VariableStatement", f"declare const {name}: {text}", references=references, modifiers=sorted(set(flags)), is_explicit=explicit, remote=remote(shape)), begin)
                rows.append(row)
                if shape is not None:
                    self.local.setdefault(name, shape)
                    for m in self.flattened(name, shape):
                        m.is_explicit = explicit
                        rows.append(m)
            if not self.maybe(","):
                break
        self.end()
        return rows

    def module(self, begin: int, first: int, explicit: bool, flags: list[str], is_global: bool = False) -> list[Export]:
        """A namespace, an ambient module or a global block, and what it declares."""
        self.take()
        quoted = self.kind() == "text"
        name = "global" if is_global else self.string() if quoted else self.dotted()
        around = self.prefixes[-1] if self.prefixes else None
        if is_global:
            prefix = "" if around is None else f"{around}.global".removeprefix(".")
        else:
            prefix = "" if quoted and around is None else name
        inner: list[Export] = []
        if self.peek() == "{":
            self.take("{")
            self.prefixes.append(prefix)
            self.enclosing.append(name)
            inner = self.statements()
            self.prefixes.pop()
            self.enclosing.pop()
            self.take("}")
        else:  # an ambient module without a body
            self.end()
        signature = self.text[first : self.last_end]
        if is_global:
            signature = signature.split("{")[0].strip() + " { ... }"
        shown = explicit and not is_global and not quoted
        augments = is_global and around is None
        row = self.described(Export(name, "ModuleDeclaration", signature, modifiers=sorted(set(flags) - ({"export"} if not shown else set())), is_explicit=shown, is_global=is_global and around != ""), begin)
        if self.enclosing and self.enclosing[-1] != name:
            row.enclosing = self.enclosing[-1]
        inner = [e for e in inner if e.kind not in ("ExportDeclaration", "ExportAssignment", "ImportEqualsDeclaration")]
        if prefix:
            qualify(prefix, inner)
        for e in inner:
            e.is_global = e.is_global or augments
            if e.enclosing is None:
                e.enclosing = name
        return [row, *inner]


def remote(shape: Type | None) -> tuple[str, str] | None:
    return (shape.source, shape.name) if shape is not None and shape.kind == "import" else None


def qualify(parent: str, rows: list[Export]) -> None:
    """Prefixes names with their namespace; members and references of renamed types follow."""
    own = lambda x: x == parent or not x.startswith(f"{parent}.")
    renamed = []
    for e in rows:
        if own(e.name):
            if e.kind in ("InterfaceDeclaration", "ClassDeclaration", "TypeAliasDeclaration", "EnumDeclaration"):
                renamed.append(e.name)
            e.name = f"{parent}.{e.name}"
    for old in renamed:
        new = f"{parent}.{old}"
        moved = lambda x, o=old, n=new: n + x[len(o) :] if (x == o or x.startswith(f"{o}.")) and x != n and not x.startswith(f"{n}.") else x
        for e in rows:
            e.name = moved(e.name) if e.name != new else e.name
            for r in e.references:
                if r.import_path is None:
                    r.name = moved(r.name)


#: Texts up to this length are kept with what they parse to, the latest 4,096 of a process.
KEPT = 2_048


def parse(text: str) -> Parsed:
    """The exports, imports and directives of a declaration file.

    Install trees hold the same small files again and again: such a text is parsed once. The
    lists are the caller's own, what is in them is shared.
    """
    if len(text) > KEPT:
        return _File(text.removeprefix("﻿")).parse()
    p = _kept(text)
    return replace(p, exports=[*p.exports], imports=[*p.imports], references=[*p.references], type_references=[*p.type_references])


@lru_cache(4_096)
def _kept(text: str) -> Parsed:
    return _File(text.removeprefix("﻿")).parse()
