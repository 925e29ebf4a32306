"""Names, codes and word lists that results depend on, as they are."""

#: Declaration kinds and their syntax codes.
KIND_CODES = {
    "FunctionDeclaration": 263,
    "ClassDeclaration": 264,
    "InterfaceDeclaration": 265,
    "TypeAliasDeclaration": 266,
    "EnumDeclaration": 267,
    "ModuleDeclaration": 268,
    "VariableStatement": 244,
    "ExportDeclaration": 279,
    "ExportAssignment": 278,
    "PropertyDeclaration": 173,
    "PropertySignature": 172,
    "MethodDeclaration": 175,
    "MethodSignature": 174,
    "GetAccessor": 178,
    "SetAccessor": 179,
    "ImportEqualsDeclaration": 272,
    "NamespaceExportDeclaration": 271,
    "Unknown": 0,
}

#: Types that are never dependencies.
BUILTIN_TYPES = (
    "string number boolean void any unknown never null undefined object Object symbol bigint "
    "Array ReadonlyArray Promise Map Set WeakMap WeakSet ReadonlyMap ReadonlySet "
    "Record Partial Required Readonly Pick Omit Exclude Extract NonNullable ReturnType Parameters "
    "InstanceType ConstructorParameters ThisParameterType ThisType Awaited NoInfer "
    "Uppercase Lowercase Capitalize Uncapitalize TemplateStringsArray "
    "Iterator IterableIterator AsyncIterableIterator Generator AsyncGenerator Date RegExp Error Function"
).split()

#: Modules that come with the runtime.
NODE_MODULES = (
    "assert buffer child_process cluster console constants crypto dgram diagnostics_channel dns domain events "
    "fs http http2 https inspector module net os path perf_hooks process punycode querystring readline "
    "repl stream string_decoder sys test timers tls trace_events tty url util v8 vm worker_threads zlib"
).split()

#: Package managers, which are never indexed.
TOOLCHAIN = ("pnpm", "npm", "yarn", "bun", "corepack")

#: Documentation tags that set a visibility.
VISIBILITY_TAGS = ("public", "internal", "alpha", "beta")

#: Words that may lead a signature.
MODIFIERS = ("public", "protected", "private", "readonly", "static", "abstract", "override", "declare", "async", "accessor")

#: Kinds that merge by scope, name and kind; and by name, kind and signature.
SCOPE_MERGED = ("InterfaceDeclaration", "TypeAliasDeclaration", "ModuleDeclaration", "EnumDeclaration")
SIGNATURE_MERGED = ("MethodSignature", "PropertySignature", "GetAccessor", "SetAccessor")

#: Kinds that a reference to a value, or to a type, may mean.
KINDS_BY_HINT = {
    "value": ("VariableStatement", "FunctionDeclaration", "ClassDeclaration", "EnumDeclaration", "ModuleDeclaration"),
    "type": ("InterfaceDeclaration", "TypeAliasDeclaration", "ClassDeclaration", "EnumDeclaration", "ModuleDeclaration", "MethodSignature", "PropertySignature"),
}

#: Order of parent kinds for each sort of member; other kinds rank 5.
PARENT_RANKS = {
    "declared_member": ("ClassDeclaration", "InterfaceDeclaration", "ModuleDeclaration", "FunctionDeclaration"),
    "declaration": ("ModuleDeclaration", "ClassDeclaration", "EnumDeclaration", "InterfaceDeclaration", "FunctionDeclaration"),
    "type_shape": ("InterfaceDeclaration", "TypeAliasDeclaration", "ClassDeclaration", "ModuleDeclaration", "FunctionDeclaration"),
    "value": ("ModuleDeclaration", "ClassDeclaration", "EnumDeclaration", "FunctionDeclaration", "InterfaceDeclaration"),
}
DEFAULT_PARENT_RANK = 5

#: Folder name that stands for everything outside of a package, and for one step up.
OUTSIDE, STEP_UP = "__outside__", "__up__"
PREVIEW_CHARS, SLOW_QUERY_MS, TYPES_VERSION = 320, 750, "5.7.0"
