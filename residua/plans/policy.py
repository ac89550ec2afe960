"""Policies: nested options from YAML or keywords, checked against one table of allowed values and defaults."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

import yaml

_FLAG = (True, False)
#: Every option of a canonicalisation policy, its default first, then the other values it takes (None: any string).
OPTIONS: dict[str, tuple] = {
    "identifier_rules.chain_id.strategy": ("preserve", "remap", "use_auth_chain_id"),
    "identifier_rules.residue_numbering.strategy": ("preserve", "use_auth_seq", "renumber"),
    "identifier_rules.residue_numbering.preserve_insertion_codes": _FLAG,
    "identifier_rules.assembly_id.strategy": ("preserve", "remap", "standardize"),
    "missing_data_rules.missing_atoms.strategy": ("annotate", "preserve", "drop_partial_residue", "impute"),
    "missing_data_rules.missing_atoms.allow_imputation": (False, True),
    "missing_data_rules.missing_atoms.record_missingness": _FLAG,
    "missing_data_rules.missing_residues.strategy": ("annotate", "preserve", "drop_chain_segment", "impute"),
    "missing_data_rules.missing_residues.record_gaps": _FLAG,
    "missing_data_rules.incomplete_chains.strategy": ("preserve", "exclude", "truncate_to_complete_regions"),
    "altloc_rules.strategy": ("select_best_occupancy", "preserve", "select_first", "select_user_defined"),
    "altloc_rules.tie_breaker": ("alphabetical_first", "alphabetical_last", "lowest_b_factor", "highest_b_factor"),
    "altloc_rules.user_defined_altloc": (None,),
    "altloc_rules.record_selection": _FLAG,
    "assembly_rules.strategy": ("preserve_as_reported", "standardize_biological_assembly", "select_first_assembly"),
    "assembly_rules.preferred_assembly_source": ("author", "pdbe", "pdbx", "first"),
    "assembly_rules.record_original_assembly_mapping": _FLAG,
    "entity_rules.strategy": ("preserve", "standardize", "merge_equivalent_entities"),
    "entity_rules.preserve_original_entity_ids": _FLAG,
    "ligand_rules.strategy": ("preserve", "filter", "annotate_only"),
    "ligand_rules.keep_waters": _FLAG,
    "ligand_rules.keep_ions": _FLAG,
    "ligand_rules.keep_nonpolymer_ligands": _FLAG,
    "validation_rules.strictness": ("moderate", "strict", "permissive"),
    "validation_rules.fail_on_unresolved_issues": _FLAG,
    "validation_rules.warnings_as_errors": (False, True),
    "provenance_rules.record_original_mappings": _FLAG,
    "provenance_rules.record_transforms": _FLAG,
    "provenance_rules.record_policy_application": _FLAG,
    "provenance_rules.emit_canonicalisation_report": (False, True),
}
#: Accepted, and without effect: imputation, the standardised assembly, the preferred source, permissive validation and the flags about recording.
NO_EFFECT = ("missing_data_rules.missing_atoms.allow_imputation", "assembly_rules.preferred_assembly_source", "assembly_rules.record_original_assembly_mapping", "provenance_rules.record_transforms", "provenance_rules.record_policy_application")
_HEAD = ("policy_id", "policy_name", "policy_version", "description")


@dataclass(frozen=True)
class Policy:
    """``policy["ligand_rules.keep_waters"]``: the option's value, its default where it isn't set."""

    policy_id: str = ""
    policy_name: str = ""
    policy_version: str = ""
    description: str = ""
    values: Mapping[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for k, v in self.values.items():
            if k not in OPTIONS:
                raise ValueError(f"unknown option: {k}")
            allowed = OPTIONS[k]
            if allowed == (None,):
                if v is not None and not isinstance(v, str):
                    raise ValueError(f"{k} is a string")
            elif v not in allowed or isinstance(v, bool) != isinstance(allowed[0], bool):
                raise ValueError(f"{k} can't be {v!r}; it is one of {', '.join(map(str, allowed))}")

    def __getitem__(self, key: str) -> Any:
        return self.values.get(key, OPTIONS[key][0])


def flat(tree: Mapping[str, Any], prefix: str = "") -> dict[str, Any]:
    out: dict[str, Any] = {}
    for k, v in tree.items():
        out |= flat(v, f"{prefix}{k}.") if isinstance(v, Mapping) else {f"{prefix}{k}": v}
    return out


def policy(tree: Mapping[str, Any] | None = None, **options: Any) -> Policy:
    """From a nested mapping; keywords name options with __ for dots."""
    tree = dict(tree or {})
    head = {k: str(tree.pop(k)).strip() for k in _HEAD if k in tree}
    if "emit_canonicalization_report" in tree.get("provenance_rules", {}):
        rules = dict(tree["provenance_rules"])
        rules["emit_canonicalisation_report"] = rules.pop("emit_canonicalization_report")
        tree["provenance_rules"] = rules
    return Policy(**head, values=flat(tree) | {k.replace("__", "."): v for k, v in options.items()})


def load_policy(path: str) -> Policy:
    with open(path, encoding="utf-8") as f:
        return policy(yaml.safe_load(f) or {})
