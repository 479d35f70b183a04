"""Records, their checks, and mutations that each check must find."""

import copy
import hashlib
import json
from pathlib import Path

import pytest

from veridrift.operators import checks, manifest, report
from veridrift.sources.records import read_digests, read_group_rows, read_hash_list, read_record
from veridrift.streaming.audit import row_violations, running_leaderboard, stream_group_rows

GROUPS = ("g1", "g2", "g3")
QUALITY = {"g1": (0.25, 0.5), "g2": (0.75, 0.125), "g3": (0.5, 0.5)}


def evaluation():
    """A record of six strategies over three groups of two candidates."""
    rows = []
    for i, s in enumerate(checks.STRATEGIES):
        for g in GROUPS:
            best = max((0, 1), key=lambda k: (QUALITY[g][k], -k))
            pick = best if s == "oracle_all4" else (0 if s == "direct" else (i + len(g)) % 2)
            q, o = QUALITY[g][pick], QUALITY[g][best]
            rows.append(
                {"group_id": g, "strategy": s, "selected_sample_id": f"{g}_c{pick}_s1", "selected_quality": q, "qualified": False, "technically_valid": True, "optimal_sample_id": f"{g}_c{best}_s1", "optimal_quality": o, "regret": o - q, "top1_correct": pick == best}
            )
    declared = {}
    for s in checks.STRATEGIES:
        own = [r for r in rows if r["strategy"] == s]
        declared[s] = {"groups": 3} | {m: sum(float(r[c]) for r in own) / 3 for m, c in checks.METRICS}
    return {"groups": 3, "strategies": declared, "group_results": rows}


def final():
    arm = {"groups": 64, "mean_q": 0.5, "pass_rate": 0.1, "adherence_rate": 0.8, "technical_valid_rate": 1.0, "gpu_seconds_per_group": None}
    boot = {"mean_q_difference_lora_minus_base": 0.125, "ci95_low": -0.1, "ci95_high": 0.2}
    return {"base_summary": arm, "lora_summary": arm | {"mean_q": 0.625}, "paired_bootstrap": boot, "decision": checks.FINAL_DECISION}


def first(spark, tmp_path, data, kind="strategy_evaluation"):
    path = tmp_path / "record.json"
    path.write_text(json.dumps(data, indent=1), encoding="utf-8")
    doc = read_record(spark, str(path), kind)
    found = checks.check_evaluation(doc) if kind == "strategy_evaluation" else checks.check_final(doc)
    return checks.first_violation(found)


def test_consistent_record_passes(spark, tmp_path):
    assert first(spark, tmp_path, evaluation()) is None


def _row(**new):
    return lambda d: d["group_results"][0].update(new)


def _other_group(d):
    d["group_results"][4]["group_id"] = "g9"


def _drift(d):
    row = next(r for r in d["group_results"][6:] if r["selected_sample_id"] == "g1_c0_s1")
    row["selected_quality"] += 0.1
    row["regret"] -= 0.1


MUTATIONS = {
    "duplicate or missing": lambda d: d["group_results"].append(copy.deepcopy(d["group_results"][0])),
    "mean_quality": lambda d: d["strategies"]["ready_v3_top1"].update(mean_quality=d["strategies"]["ready_v3_top1"]["mean_quality"] + 0.1),
    "quality range": _row(selected_quality=float("nan")),
    "regret": _row(regret=0.9),
    "declared number of groups": lambda d: d["strategies"]["direct"].update(groups=4),
    "not every strategy covers": _other_group,
    "several qualities": _drift,
    "exactly the known strategies": lambda d: d["strategies"].pop("direct"),
    "rows of strategies that": lambda d: d.update(group_results=d["group_results"][3:]),
}


@pytest.mark.parametrize("message", MUTATIONS)
def test_mutation_is_found(spark, tmp_path, message):
    data = evaluation()
    MUTATIONS[message](data)
    assert message in first(spark, tmp_path, data)


@pytest.mark.parametrize("new", [{"selected_quality": None}, {"optimal_quality": None}, {"regret": None}, {"optimal_quality": float("inf")}])
def test_null_or_infinite_never_passes(spark, tmp_path, new):
    data = evaluation()
    _row(**new)(data)
    assert first(spark, tmp_path, data)


def test_change_below_tolerance_passes(spark, tmp_path):
    data = evaluation()
    data["strategies"]["direct"]["mean_quality"] += 1e-12
    assert first(spark, tmp_path, data) is None


def _base_rate(d):
    d["base_summary"]["pass_rate"] = 1.5


FINAL = {
    "final mean difference": lambda d: d["lora_summary"].update(mean_q=0.725),
    "interval of the final difference": lambda d: d["paired_bootstrap"].update(ci95_low=0.3),
    "final decision": lambda d: d.update(decision="deploy"),
    "invalid final pass_rate": _base_rate,
    "64 groups": lambda d: d["base_summary"].update(groups=63),
}


@pytest.mark.parametrize("message", FINAL)
def test_final_mutation_is_found(spark, tmp_path, message):
    data = final()
    assert first(spark, tmp_path, data, "final_comparison") is None
    FINAL[message](data)
    assert message in first(spark, tmp_path, data, "final_comparison")


def test_schema_is_enforced(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"groups": "three"}')
    with pytest.raises(Exception, match="(?i)malformed|parse|CANNOT"):
        read_record(spark, str(tmp_path / "r.json"), "strategy_evaluation").collect()


def files(tmp_path):
    root = tmp_path / "assets"
    root.mkdir()
    (root / "a.glb").write_bytes(b"model")
    (root / "a.png").write_bytes(b"image")
    digest = lambda b: hashlib.sha256(b).hexdigest()
    asset = {"glb": "a.glb", "glb_sha256": digest(b"model"), "preview": "a.png", "preview_sha256": digest(b"image")}
    return root, asset


def run(spark, tmp_path, root, assets, ev=None, fin=None):
    paths = {}
    for name, data in (("evaluation", ev or evaluation()), ("final", fin or final()), ("assets", {"assets": assets})):
        (tmp_path / f"{name}.json").write_text(json.dumps(data, indent=1), encoding="utf-8")
        paths[name] = str(tmp_path / f"{name}.json")
    return report.run_audit(spark, root=str(root), **paths)


def test_audit_end_to_end(spark, tmp_path, capsys):
    root, asset = files(tmp_path)
    assert run(spark, tmp_path, root, [asset]) == 0
    said = json.loads(capsys.readouterr().out)
    assert said["status"] == "passed" and said["showcase_assets_verified"] == 1
    assert said["stage1_recomputed_mean_quality"]["direct"] == pytest.approx(0.5)
    assert list(said) == ["status", "scope", "stage1_groups", "stage1_recomputed_mean_quality", "final_decision", "final_bootstrap_recomputed", "final_raw_group_records_in_repository", "showcase_assets_verified"]


@pytest.mark.parametrize(("change", "message"), [({"glb_sha256": "0" * 64}, "checksum mismatch"), ({"glb": "../x"}, "leaves the root"), ({"preview": "none.png"}, "missing")])
def test_asset_failures(spark, tmp_path, capsys, change, message):
    root, asset = files(tmp_path)
    assert run(spark, tmp_path, root, [asset | change]) == 1
    assert message in capsys.readouterr().err


def test_failing_record_gives_status_one(spark, tmp_path, capsys):
    root, asset = files(tmp_path)
    data = evaluation()
    MUTATIONS["mean_quality"](data)
    assert run(spark, tmp_path, root, [asset], ev=data) == 1
    assert "mean_quality" in capsys.readouterr().err


@pytest.mark.parametrize(("path", "out"), [("a/b", False), ("a/../b", False), ("a/../../b", True), ("../x", True), ("/etc", True), ("C:/x", True), ("./a", False), ("a/./../..", True)])
def test_containment(spark, tmp_path, path, out):
    df = spark.createDataFrame([(path,)], "path string")
    assert df.select(manifest.escapes(df.path)).first()[0] is out
    if not path.startswith("C:"):
        if out:
            with pytest.raises(ValueError, match="leaves"):
                manifest.resolve_inside(tmp_path, path)
        else:
            assert manifest.resolve_inside(tmp_path, path).is_relative_to(tmp_path.resolve())


def test_links_out_of_the_root_are_found(spark, tmp_path, capsys):
    root, asset = files(tmp_path)
    (tmp_path / "outside").mkdir()
    (tmp_path / "outside" / "a.glb").write_bytes(b"model")
    (root / "link").symlink_to(tmp_path / "outside")
    assert run(spark, tmp_path, root, [asset | {"glb": "link/a.glb"}]) == 1
    assert "leaves the root" in capsys.readouterr().err


def test_other_errors_are_not_swallowed(spark, tmp_path, monkeypatch):
    root, asset = files(tmp_path)
    monkeypatch.setattr(report, "assemble", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        run(spark, tmp_path, root, [asset])


def test_hash_list(spark, tmp_path):
    root, asset = files(tmp_path)
    (tmp_path / "SUMS").write_text(f"{asset['glb_sha256']}  a.glb\n{'0' * 64}  a.png\n{'1' * 64}  gone\n")
    status = manifest.file_status(read_hash_list(spark, str(tmp_path / "SUMS")), read_digests(spark, str(root)))
    assert {r["path"]: r["status"] for r in status.collect()} == {"a.glb": "ok", "a.png": "mismatch", "gone": "missing"}


def test_runner_stops_at_first_failure(tmp_path):
    mark = tmp_path / "third"
    commands = [(["true"], Path("/")), (["sh", "-c", "exit 3"], Path("/")), (["touch", str(mark)], Path("/"))]
    assert report.run_in_order(commands) == 3 and not mark.exists()
    assert report.run_in_order(commands[:1]) == 0


def test_stream(spark, tmp_path):
    rows = evaluation()["group_results"]
    bad = dict(rows[0], selected_quality=1.5)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, [*rows, bad])))
    assert read_group_rows(spark, str(tmp_path / "in")).count() == len(rows) + 1
    stream = stream_group_rows(spark, str(tmp_path / "in"))
    for name, df, mode in (("bad_rows", row_violations(stream), "append"), ("board", running_leaderboard(stream), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
    assert [r["check"] for r in spark.table("bad_rows").collect()] == ["quality_range"]
    assert spark.table("board").count() == len(checks.STRATEGIES)
