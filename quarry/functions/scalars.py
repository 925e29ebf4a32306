"""Scalar functions of the symbol graph as Column expressions; they run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import fixed


def _blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def _stripped(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def normalize_signature(c: Column) -> Column:
    """White space at the ends dropped, runs within turned to one space, null to empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))  # at the ends nothing but spaces is left


def dedupe_key(file: Column, name: Column, kind_code: Column, signature: Column) -> Column:
    """``file::name::kind::signature``."""
    return F.concat_ws("::", file, name, kind_code.cast("string"), normalize_signature(signature))


def preview(c: Column, chars: int = fixed.PREVIEW_CHARS) -> Column:
    """The first ``chars`` characters of a signature, and dots if there are more; blank is null."""
    text = _stripped(c)
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("..."))).otherwise(_blank_to_null(text))


def since_semver(c: Column) -> Column:
    """struct(major, minor, patch) of a loose version; all null if there is no major.

    A leading v and what follows white space, - or + is dropped; a minor or patch that is
    missing or no number is 0; empty pieces between dots don't count.
    """
    token = F.regexp_extract(_stripped(c), r"^[vV]?\s*([^\s]*)", 1)
    core = F.regexp_extract(token, r"^([^-+]*)", 1)
    parts = F.filter(F.split(core, r"\."), lambda x: x != "")
    number = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("bigint")
    major = number(1)
    rest = lambda i: F.when(major.isNotNull(), F.coalesce(number(i), F.lit(0)).cast("bigint"))
    return F.struct(major.alias("major"), rest(2).alias("minor"), rest(3).alias("patch"))


def strict_semver(c: Column) -> Column:
    """struct(major, minor, patch), null if a part is no number; structs compare in order."""
    core = F.regexp_extract(F.regexp_replace(_stripped(c), "^v+", ""), r"^([^-+]*)", 1)
    parts = F.split(core, r"\.")
    number = lambda i: F.when(F.size(parts) >= i, F.try_element_at(parts, F.lit(i)).try_cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    version = F.struct(number(1).alias("major"), number(2).alias("minor"), number(3).alias("patch"))
    good = F.forall(F.slice(parts, 1, 3), lambda x: x.try_cast("bigint").isNotNull())
    return F.when(good & (core != ""), version)


def in_version_range(version: Column, wanted: Column) -> Column:
    """Whether ``version`` meets ``>=a.b`` (a patch is ignored); any other range is not met."""
    major = F.regexp_extract(wanted, r"^>=\s*(\d+)\.(\d+)", 1).try_cast("int")
    minor = F.regexp_extract(wanted, r"^>=\s*(\d+)\.(\d+)", 2).try_cast("int")
    parts = F.split(version, r"\.")
    own = lambda i: F.coalesce(F.try_element_at(parts, F.lit(i)).try_cast("int"), F.lit(0))
    return F.coalesce((own(1) > major) | ((own(1) == major) & (own(2) >= minor)), F.lit(False))


_ASCII_UPPER, _ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def package_root(c: Column) -> Column:
    """The package of a module specifier, ASCII lower-cased; null for paths, drives, URLs, node: and file:."""
    text = _stripped(c)
    foreign = text.rlike(r"^[./]") | text.rlike(r"^[A-Za-z]:") | text.rlike(r"(?i)^(node|file):") | text.contains("://") | (text == "")
    scoped = F.regexp_extract(text, r"^(@[^/]+/[^/\\]+)", 1)
    plain = F.regexp_extract(text, r"^([^/\\]+)", 1)
    root = F.when(text.startswith("@"), scoped).otherwise(plain)
    return F.when(~foreign, _blank_to_null(F.translate(root, _ASCII_UPPER, _ASCII_LOWER)))


def stub_roots(names: Column) -> Column:
    """Sorted distinct package roots of an array of names; names without a root are lower-cased."""
    trimmed = F.filter(F.transform(names, _stripped), lambda x: x != "")
    return F.array_sort(F.array_distinct(F.filter(F.transform(trimmed, lambda x: F.coalesce(package_root(x), F.when(~x.startswith("@"), F.translate(x, _ASCII_UPPER, _ASCII_LOWER)))), lambda x: x.isNotNull())))


def outside_path(relative: Column) -> Column:
    """A path relative to a package root, with leading ``..`` steps spelled out."""
    path = F.regexp_replace(F.regexp_replace(relative, r"\\", "/"), r"^(\./+)+", "")
    ups = F.regexp_extract(path, r"^((?:\.\./)*(?:\.\.$)?)", 1)
    steps = F.size(F.regexp_extract_all(ups, F.lit(r"(\.\.)"), 1))
    tail = F.regexp_replace(F.substring(path, F.length(ups) + 1, F.length(path) + 1), "^/+", "")
    return F.concat(F.lit(fixed.OUTSIDE), F.repeat(F.lit(f"/{fixed.STEP_UP}"), steps), F.when(tail != "", F.concat(F.lit("/"), tail)).otherwise(F.lit("")))


def package_relative(path: Column, package_dir: Column) -> Column:
    """A path within a package dir; a path elsewhere steps up out of it."""
    own, root = F.regexp_replace(path, r"\\", "/"), F.regexp_replace(package_dir, r"\\", "/")
    inside = F.substring(own, F.length(root) + 1, F.length(own) + 1)
    a, b = F.split(own, "/"), F.split(root, "/")
    both = F.least(F.size(a), F.size(b))
    differ = F.filter(F.sequence(F.lit(0), both - 1), lambda i: F.get(a, i) != F.get(b, i))
    common = F.coalesce(F.get(differ, F.lit(0)), both)
    away = F.concat(F.repeat(F.lit("../"), F.size(b) - common), F.array_join(F.slice(a, common + 1, F.greatest(F.size(a) - common, F.lit(0))), "/"))
    return F.when(own.startswith(root), F.regexp_replace(inside, "^/", "")).otherwise(outside_path(away))


def source_identity(package: Column, version: Column, path: Column) -> Column:
    """struct(package, version, path) that owns a stored path: after the first node_modules if outside."""
    segments = F.split(path, "/")
    at = F.array_position(segments, "node_modules")  # from 1; 0: none
    first = F.get(segments, at.cast("int"))
    second = F.get(segments, (at + 1).cast("int"))
    scoped = first.startswith("@")
    width = F.when(scoped, 2).otherwise(1)
    found = path.startswith(f"{fixed.OUTSIDE}/") & (at > 0) & first.isNotNull() & (~scoped | second.isNotNull())
    owner = F.when(scoped, F.concat_ws("/", first, second)).otherwise(first)
    rest = F.array_join(F.slice(segments, (at + width + 1).cast("int"), F.greatest(F.size(segments), F.lit(0))), "/")
    found = F.coalesce(found, F.lit(False))
    return F.struct(
        F.when(found, owner).otherwise(package).alias("package"),
        F.when(~found, version).alias("version"),
        F.when(found & (rest != ""), rest).otherwise(path).alias("path"),
    )


def parent_dir(path: Column) -> Column:
    """The folder of a path, ``.`` if it has none (X11)."""
    return F.when(path.contains("/"), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(F.lit("."))


def dotted_parent(name: Column) -> Column:
    """``A`` of ``A.b`` and of ``A.prototype.b``; null without a dot."""
    proto = name.contains(".prototype.")
    before = F.regexp_extract(name, r"^(.*?)\.prototype\.", 1)
    last = F.regexp_extract(name, r"(?s)^(.*)\.[^.]*$", 1)
    return F.when(proto, _blank_to_null(before)).when(name.contains("."), last)


def leaf_name(name: Column) -> Column:
    """What follows the last dot."""
    return F.substring_index(name, ".", -1)


def heritage_key(c: Column) -> Column:
    """The name before type arguments."""
    return _stripped(F.substring_index(_stripped(c), "<", 1))


def namespace_member(name: Column) -> Column:
    """struct(qualifier, member) of ``q.m.n`` at the first dot; null if either is empty."""
    got = F.struct(F.regexp_extract(name, r"(?s)^([^.]+)\.(.+)$", 1).alias("qualifier"), F.regexp_extract(name, r"(?s)^([^.]+)\.(.+)$", 2).alias("member"))
    return F.when(name.rlike(r"(?s)^[^.]+\..+$"), got)


def external_id(source: Column, member: Column) -> Column:
    """``protocol::source::member`` of a runtime module or ``protocol:source``; else null."""
    pattern = r"^([a-z][a-z0-9+.-]*):(.*)$"
    builtin = source.isin(*fixed.NODE_MODULES)
    rest = F.regexp_replace(F.regexp_extract(source, pattern, 2), "^//", "")
    return F.when(builtin, F.concat_ws("::", F.lit("node"), source, member)).when(source.rlike(pattern), F.concat_ws("::", F.regexp_extract(source, pattern, 1), rest, member))


def stub_id(source: Column, member: Column) -> Column:
    """The id of something in a module that isn't indexed; null for paths and drives."""
    local = source.rlike(r"^[./]") | source.rlike(r"^[A-Za-z]:")
    return F.coalesce(external_id(source, member), F.when(~local, F.concat_ws("::", F.lit("npm"), source, member)))


def ambient_node_id(name: Column) -> Column:
    """``node::NodeJS::x`` of ``NodeJS.x``."""
    member = F.regexp_extract(name, r"^NodeJS\.(.+)$", 1)
    return F.when(member != "", F.concat(F.lit("node::NodeJS::"), member))


def leading_modifiers(signature: Column) -> Column:
    """The modifiers that lead a signature, in order."""
    words = F.filter(F.split(_stripped(signature), r"\s+"), lambda w: w != "")
    known = F.array(*[F.lit(m) for m in fixed.MODIFIERS])
    stop = F.coalesce(F.get(F.filter(F.transform(words, lambda w, i: F.when(~F.array_contains(known, w), i)), lambda i: i.isNotNull()), F.lit(0)), F.size(words))
    return F.when(signature.isNotNull(), F.slice(words, F.lit(1), stop))


def deprecation_columns(raw: Column) -> Column:
    """struct(flag, message) of ``true``, ``false``, a message or null."""
    said = raw.isNotNull() & (raw != "false")
    return F.struct(said.alias("flag"), F.when(said & (raw != "true") & (raw != ""), raw).alias("message"))


def strings_to_json(c: Column, empty: str | None = None) -> Column:
    """An array of strings as JSON; empty and null give ``empty``."""
    return F.when(F.size(c) > 0, F.to_json(c)).otherwise(F.lit(empty))


def strings_from_json(c: Column) -> Column:
    """The strings of a JSON array; null if it is none."""
    return F.from_json(c, "array<string>")


def kind_code(kind: Column) -> Column:
    """The syntax code of a kind; 0 of any other."""
    table = F.create_map(*[F.lit(x) for pair in fixed.KIND_CODES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, kind), F.lit(0))


def digest16(c: Column) -> Column:
    """The first 16 hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(c, 256), 1, 16)


def plain_terms(c: Column) -> Column:
    """Runs of letters, digits and _ joined by a space; null if there are none."""
    words = F.regexp_extract_all(c, F.lit(r"([A-Za-z0-9_]+)"), 1)
    return F.when(F.size(words) > 0, F.array_join(words, " "))


def fence_stripped(c: Column) -> Column:
    """The inside of a Markdown code fence, or the text."""
    text = _stripped(c)
    fenced = F.regexp_extract(text, r"(?is)^```(?:json)?\s*(.*?)\s*```$", 1)
    return F.when(text.rlike(r"(?is)^```(?:json)?\s*.*?\s*```$"), fenced).otherwise(text)


def first_number(json: Column, keys: list[str]) -> Column:
    """The first of several JSON keys that holds a number."""
    return F.coalesce(*[F.get_json_object(json, f"$.{k}").try_cast("double") for k in keys])


def cost_label(query: Column) -> Column:
    """heavy, moderate or light."""
    return F.when(query == "evidence", "heavy").when(query.isin("find", "symbols", "active-package"), "moderate").otherwise("light")


def fill_ratio(value: Column, low: Column | float = 0.0, high: Column | float = 1.0) -> Column:
    """(value - low) / (high - low) within 0 and 1; with no span 1 from ``high`` on."""
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    within = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - low) / F.when(high > low, high - low)))
    return F.when(high <= low, F.when(value >= high, 1.0).otherwise(0.0)).otherwise(within)


def tilt(ratio: Column, most: float) -> Column:
    """The tilt of a fill ratio, which rises early."""
    return F.pow(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ratio)), F.lit(0.62)) * most


def before_hash(c: Column) -> Column:
    """What precedes the first #."""
    return F.substring_index(c, "#", 1)


def base_name(path: Column) -> Column:
    """The last segment of a path."""
    return F.substring_index(path, "/", -1)


def is_declaration_file(path: Column) -> Column:
    """Whether a path ends in .d.ts, .d.mts or .d.cts."""
    return path.rlike(r"\.d\.(ts|mts|cts)$")


def unshadowed(refs: Column, generics: Column) -> Column:
    """References whose first segment is no declared type parameter (F16)."""
    return F.filter(refs, lambda r: ~F.array_contains(generics, F.substring_index(r, ".", 1)))


def is_stub(specifier: Column, roots: Column, own: Column | None = None) -> Column:
    """Whether a specifier's package is a stub root and not ``own``."""
    root = package_root(specifier)
    hit = F.coalesce(F.array_contains(roots, root), F.lit(False))
    return hit if own is None else hit & ~root.eqNullSafe(own)
