"""A sample of registered queries next to their SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry
from compare import compare, connect

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "detect_phone", "detect_iban", "mask_documents", "vault_assign", "merge_overlaps", "resolve_spans",
    "evaluate_characters", "activity_summary", "probes_verified", "ledger_seen", "registry_errors",
    "detect_cookie", "detect_ssn", "review_findings", "json_refused", "mask_round_trip", "support_totals",
    "detect_card", "detect_ipv4", "review_unprotected", "confirm_findings", "evaluate_latency", "blocks_to_sections", "code_values",
    "cut_leaks", "vault_remembered", "vault_log", "resolve_one_text", "merge_partial_spans", "stream_probes", "stream_restored",
)


@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, name):
    diff = compare(spark, connect(SF), name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert diff is None, diff


def test_every_query_has_sql():
    assert set(entry.QUERIES) == set(entry.ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())
