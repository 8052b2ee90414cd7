import json

import pytest

from seqlattice import runner


def config(tmp_path, **given):
    path = tmp_path / "c.json"
    path.write_text(json.dumps(given))
    return runner.load(str(path), {})


def test_experiment(spark, tmp_path):
    c = config(tmp_path, data={"rows": 1500, "profile": "uniform"}, query={"shape": "chain", "variables": 3, "sigma": 0.1}, batches=3, ask="1,3", firing={"kind": "every_k", "k": 2})
    out = runner.run(spark, c, str(tmp_path / "x"))
    assert [s["batch"] for s in out["steps"] if "matches" in s] == [1, 3] and all(s.get("differing", 0) == 0 for s in out["steps"])
    assert out["steps"][-1]["matches"] > 0 and out["data_bytes"] > 0 and len(out["joins"]) >= 1
    assert all(b > 0 for s in out["steps"][1:] for b in s["state_bytes"].values())


def test_band_experiment_of_another_selector(spark, tmp_path):
    c = config(tmp_path, data={"rows": 900, "profile": "clustered"}, query={"shape": "star", "variables": 3, "kind": "band", "sigma": 0.05}, batches=2, ask="last", selector="none")
    out = runner.run(spark, c, str(tmp_path / "y"))
    assert out["steps"][-1]["differing"] == 0 and out["plan"]["cover"] == []


def test_configuration_is_checked(tmp_path):
    path = tmp_path / "bad.json"
    path.write_text(json.dumps({"query": {"shape": "knot", "kind": "odd"}, "batches": 0, "selector": "x", "typo": 1, "firing": {"kind": "sometimes"}}))
    with pytest.raises(ValueError) as e:
        runner.load(str(path), {})
    assert len(str(e.value).split("; ")) == 6
    path.write_text(json.dumps({"query": {"shape": "chain"}}))
    assert runner.load(str(path), {"SEQLATTICE_BATCHES": "2", "SEQLATTICE_ASK": "last"})["batches"] == 2
