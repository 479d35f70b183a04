"""Numbers and flags of records as they may be written."""

import json

import pytest

from veridrift.sources import records


def read(spark, tmp_path, kind, doc):
    path = tmp_path / "r.json"
    path.write_text(doc if isinstance(doc, str) else json.dumps(doc))
    return records.read_record(spark, str(path), kind).first()


def test_numbers_as_strings_and_booleans(spark, tmp_path):
    row = {"group_id": "g", "strategy": "direct", "selected_quality": "0.25", "qualified": 0, "technically_valid": 1, "optimal_quality": True, "regret": "7.5e-1", "top1_correct": "1"}
    doc = {"groups": "12", "bootstrap_draws": 1e4, "strategies": {"direct": {"groups": 12.0, "mean_quality": 1, "qualified_rate": False}}, "comparisons_vs_direct": {"a": {"mean_quality_delta_95_ci": ["-1", 2]}}, "group_results": [row]}
    r = read(spark, tmp_path, "strategy_evaluation", doc)
    assert (r["groups"], r["bootstrap_draws"]) == (12, 10_000)
    d = r["strategies"]["direct"]
    assert (d["groups"], d["mean_quality"], d["qualified_rate"], d["mean_regret"]) == (12, 1.0, 0.0, None)
    assert r["comparisons_vs_direct"]["a"]["mean_quality_delta_95_ci"] == [-1.0, 2.0]
    g = r["group_results"][0]
    assert (g["selected_quality"], g["optimal_quality"], g["regret"]) == (0.25, 1.0, 0.75)
    assert (g["qualified"], g["technically_valid"], g["top1_correct"]) == (False, True, True)


def test_large_whole_numbers_and_nulls(spark, tmp_path):
    r = read(spark, tmp_path, "final_comparison", '{"base_summary": {"groups": 9007199254740993, "gpu_seconds_per_group": null}, "lora_summary": null}')
    assert r["base_summary"]["groups"] == 9007199254740993 and r["base_summary"]["gpu_seconds_per_group"] is None and r["lora_summary"] is None


@pytest.mark.parametrize("bad", ['{"quality_threshold": "much"}', '{"quality_threshold": {}}', '{"quality_threshold": ""}', '{"quality_threshold": ', '[1, 2'])
def test_what_is_not_a_number_fails(spark, tmp_path, bad):
    with pytest.raises(Exception, match="(?i)cast|malformed|parse"):
        read(spark, tmp_path, "calibration", bad)
