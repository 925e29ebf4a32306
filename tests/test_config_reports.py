import json

import pytest

from quarry.sources import config, reports


def test_config(tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    assert config.discover(tmp_path / "a/b") is None or config.discover(tmp_path / "a/b")[0] not in (tmp_path, tmp_path / "a")
    (tmp_path / config.FILE_NAME).write_text(json.dumps({"max_hops": 0, "workspaces": ["apps/*", "lib"]}))
    folder, found = config.discover(tmp_path / "a/b")
    assert folder == tmp_path and found.max_hops == 0
    both = config.merged(config.DEFAULTS, found, config.Config(max_hops=-1))
    assert both.max_hops == -1 and both.workspaces == ("apps/*", "lib") and both.package_scope == ("dependencies",)
    (tmp_path / config.FILE_NAME).write_text('{"odd": 1}')
    with pytest.raises(ValueError):
        config.discover(tmp_path)


def test_roots(tmp_path):
    for x in ("node_modules", "apps/one/node_modules", "apps/two", "lib/node_modules"):
        (tmp_path / x).mkdir(parents=True)
    (tmp_path / "apps/three").symlink_to(tmp_path / "apps/one")
    c = config.Config(workspaces=("apps/*", "lib", "none", "apps/one"))
    names = [str(p.relative_to(tmp_path)) for p in config.install_roots(tmp_path, c)]
    assert names == ["node_modules", "apps/one/node_modules", "lib/node_modules"]
    assert "node_modules" not in [str(p.relative_to(tmp_path)) for p in config.install_roots(tmp_path, config.Config(workspaces=("lib",), index_root_workspace=False))]
    assert config.manifest_names([tmp_path]) is None
    (tmp_path / "lib/package.json").write_text('{"dependencies": {"x": "1"}, "devDependencies": {"y": "1"}}')
    assert config.manifest_names([tmp_path, tmp_path / "lib"]) == {"x"}
    assert config.manifest_names([tmp_path / "lib"], ["dependencies", "devDependencies"]) == {"x", "y"}


def test_reports(spark, tmp_path):
    def report(names):
        return {"packages": [{"package": "p", "version": "1", "symbols": [{"id": f"p@1::{n}", "name": n, "kindName": "K", "filePath": f"d/{n[0]}.d.ts"} for n in names]}]}

    for side, names in (("a", ["x", "x#2", "y"]), ("b", ["x", "z"])):
        (tmp_path / f"{side}.json").write_text(json.dumps(report(names)))
    a, b = (reports.read(spark, f"{tmp_path}/{s}.json") for s in "ab")
    assert a.count() == 3
    assert reports.package_parity(a, b).first().delta == 1
    assert {(r.id, r.has_name) for r in reports.only_in(a, b).collect()} == {("p@1::x#2", True), ("p@1::y", False)}
    assert {(r.name, r.left_n, r.right_n) for r in reports.symbol_parity(a, b).collect()} == {("x#2", 1, 0), ("y", 1, 0), ("z", 0, 1)}
    assert reports.kind_shares(a).first().percent == 100.0 and reports.constraint_faults(a.union(a)).count() == 3
