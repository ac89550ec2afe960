import pytest

from residua.plans.policy import NO_EFFECT, OPTIONS, load_policy, policy


def test_yaml(tmp_path):
    f = tmp_path / "p.yaml"
    f.write_text("policy_id: overview-remap\nidentifier_rules:\n  chain_id:\n    strategy: remap\naltloc_rules:\n  strategy: select_best_occupancy\nligand_rules:\n  keep_waters: false\n")
    p = load_policy(str(f))
    assert p.policy_id == "overview-remap" and p["identifier_rules.chain_id.strategy"] == "remap"
    assert p["altloc_rules.strategy"] == "select_best_occupancy" and p["ligand_rules.keep_waters"] is False
    assert p["ligand_rules.keep_ions"] is True


@pytest.mark.parametrize("bad", [{"chain": 1}, {"ligand_rules": {"strategy": "none"}}, {"ligand_rules": {"keep_waters": "no"}}, {"altloc_rules": {"user_defined_altloc": 3}}])
def test_rejected(bad):
    with pytest.raises(ValueError):
        policy(bad)


def test_defaults_are_allowed_and_both_spellings_work():
    p = policy({"provenance_rules": {"emit_canonicalization_report": True}})
    assert p["provenance_rules.emit_canonicalisation_report"] is True
    assert all(k in OPTIONS for k in NO_EFFECT)
