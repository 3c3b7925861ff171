"""Queries against their SQL on the smallest tables."""

import compare
import pytest
from conftest import SF

from vellum import queries

QUICK = [n for n in queries.QUERIES if n.startswith(("norm_", "det_", "stream_", "place_")) or n in {"validators_all", "lex_terms", "lex_triggers", "merge_findings", "score_prompts", "scan_conversations", "legacy_risk", "redact_emails", "timeout_budget", "risk_presentation"}]


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF)


@pytest.mark.parametrize("name", QUICK)
def test_query(spark, con, name):
    assert not compare.differences(queries.QUERIES[name](spark, SF), con, queries.ORACLES[name])


def test_entry_has_every_query():
    import __spark_entry__ as e

    assert set(queries.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
