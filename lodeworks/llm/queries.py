"""Queries of this subpackage by name, and their DuckDB counterparts."""

from __future__ import annotations

from lodeworks.llm import encoding, forms, leakage, mixing, nearcopies, packing, personal, residue
from lodeworks.runtime import table


def _run(operator, *tables: str):
    return lambda spark, d: operator(*(table(spark, d, t) for t in tables))


_PLAN = ("manifest", "feasibility", "mixture", "run_pipeline")
#: Key of the surrogates of these queries; whoever publishes a corpus passes a secret one.
KEY = "for the test tables only"

QUERIES: dict = {
    "p1_drawn": _run(mixing.drawn, *_PLAN),
    "p1_report": _run(mixing.report, *_PLAN),
    "p2_found": _run(forms.lookalike_pairs, "run_pipeline"),
    "p2_forms": _run(forms.unified, "run_pipeline"),
    "p3_found": _run(nearcopies.near_copy_pairs, "run_pipeline"),
    "p3_groups": _run(nearcopies.near_copy_groups, "run_pipeline"),
    "p4_found": _run(personal.kinds_found, "run_pipeline", "name_parts"),
    "p4_masked": _run(lambda d, n: personal.masked(d, n, KEY), "run_pipeline", "name_parts"),
    "p4_entities": _run(lambda d, n: personal.entities(d, n, KEY), "run_pipeline", "name_parts"),
    "p4_collisions": _run(lambda d, n: personal.collisions(personal.entities(d, n, KEY)), "run_pipeline", "name_parts"),
    "p5_found": _run(leakage.leaked, "run_pipeline", "benchmark"),
    "p6_ids": _run(encoding.encoded, "documents"),
    "p7_packed": _run(packing.packed, "documents", "packing_policy"),
    "p7_containers": _run(lambda d, p: packing.containers(packing.packed(d, p)), "documents", "packing_policy"),
    "p7_utilization": _run(lambda d, p: packing.utilization(packing.packed(d, p)), "documents", "packing_policy"),
    "p8_found": _run(residue.residue_ids, "documents"),
    "p8_kept": _run(residue.without_residue, "documents"),
}

ORACLES: dict = {"p1_drawn": mixing.DRAWN_SQL, "p1_report": mixing.REPORT_SQL}
