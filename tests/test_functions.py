import pytest
from pyspark.sql import functions as F

from quarry.functions import hashes
from quarry.functions import scalars as X


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("made", "want"),
    [
        (lambda: X.normalize_signature(F.lit(" a \n\t b c ")), "a b c"),
        (lambda: X.normalize_signature(F.lit(None).cast("string")), ""),
        (lambda: X.preview(F.lit("  ")), None),
        (lambda: X.preview(F.lit("x" * 321)), "x" * 320 + "..."),
        (lambda: X.since_semver(F.lit("v1.2-rc next")), (1, 2, 0)),
        (lambda: X.since_semver(F.lit("1..3.x")), (1, 3, 0)),
        (lambda: X.since_semver(F.lit("soon")), (None, None, None)),
        (lambda: X.since_semver(F.lit("V 7")), (7, 0, 0)),
        (lambda: X.strict_semver(F.lit("v1.2.3+b")), (1, 2, 3)),
        (lambda: X.strict_semver(F.lit("1.x")), None),
        (lambda: X.in_version_range(F.lit("5.7.0"), F.lit(">=5.1")), True),
        (lambda: X.in_version_range(F.lit("5.7.0"), F.lit("<6")), False),
        (lambda: X.package_root(F.lit("@Scope/Pkg/sub")), "@scope/pkg"),
        (lambda: X.package_root(F.lit("Node:fs")), None),
        (lambda: X.package_root(F.lit("@scope")), None),
        (lambda: X.package_root(F.lit("a\\b")), "a"),
        (lambda: X.outside_path(F.lit("./../../x/y.d.ts")), "__outside__/__up__/__up__/x/y.d.ts"),
        (lambda: X.outside_path(F.lit("..")), "__outside__/__up__"),
        (lambda: X.package_relative(F.lit("/a/b/c.d.ts"), F.lit("/a/b")), "c.d.ts"),
        (lambda: X.package_relative(F.lit("/a/x/c.d.ts"), F.lit("/a/b")), "__outside__/__up__/x/c.d.ts"),
        (lambda: X.source_identity(F.lit("p"), F.lit("1"), F.lit("__outside__/__up__/node_modules/@s/q/a/b.d.ts")), ("@s/q", None, "a/b.d.ts")),
        (lambda: X.source_identity(F.lit("p"), F.lit("1"), F.lit("a/node_modules/b.d.ts")), ("p", "1", "a/node_modules/b.d.ts")),
        (lambda: X.dotted_parent(F.lit("A.B.prototype.c")), "A.B"),
        (lambda: X.dotted_parent(F.lit("A")), None),
        (lambda: X.heritage_key(F.lit(" Omit <A, 'b'>")), "Omit"),
        (lambda: X.namespace_member(F.lit(".x")), None),
        (lambda: X.external_id(F.lit("bun://ffi"), F.lit("f")), "bun::ffi::f"),
        (lambda: X.stub_id(F.lit("./x"), F.lit("f")), None),
        (lambda: X.stub_id(F.lit("left-pad"), F.lit("f")), "npm::left-pad::f"),
        (lambda: X.leading_modifiers(F.lit("public static x readonly")), ["public", "static"]),
        (lambda: X.deprecation_columns(F.lit("use b")), (True, "use b")),
        (lambda: X.deprecation_columns(F.lit("false")), (False, None)),
        (lambda: X.plain_terms(F.lit("Foo.bar(baz)")), "Foo bar baz"),
        (lambda: X.plain_terms(F.lit("...")), None),
        (lambda: X.fence_stripped(F.lit("```json\n{}\n```")), "{}"),
        (lambda: X.fill_ratio(F.lit(5.0), 3.0, 3.0), 1.0),
        (lambda: X.is_declaration_file(F.lit("a.d.cts")), True),
    ],
)
def test_scalars(spark, made, want):
    got = value(spark, made())
    assert (tuple(got) if isinstance(want, tuple) and got is not None else got) == want


def test_hashes():
    assert hashes.fnv1a64(b"") == 0xCBF29CE484222325
    assert hashes.fnv1a64(b"a") == 0xAF63DC4C8601EC8C
    assert hashes.fnv1a32("a") == 0xE40C292C
    assert hashes.cache_key(["b", "a", "b"], 3) == hashes.cache_key(["a", "b"], 3) != hashes.cache_key(["a"], 3)
    assert hashes.cache_key([], 1) == "i1+cbf29ce484222325"
    draw = hashes.mulberry32(1)
    assert [round(draw(), 6) for _ in range(2)] == [0.627074, 0.002736]
    out = hashes.shuffled(list(range(20)), "seed")
    assert sorted(out) == list(range(20)) and out == hashes.shuffled(list(range(20)), "seed") != hashes.shuffled(list(range(20)), "other")
