"""A cross-section of the registered queries next to their SQL on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "tools"))

import __spark_entry__ as entry  # noqa: E402
import check  # noqa: E402

SF = "/root/testdata/sf0.001"
NAMES = ["entry_fastest_cues", "P6_visible_text", "S4_srt_scan", "S7_ass_scan", "W2_pilot_sample", "W3_fragment_tags", "J1_align_ts", "J3_containment_join", "J16_lost_cues",
         "J6_memory_exact", "A10_memory_store", "A27_finding_rollup", "A14_first_decision", "J20_glossary_miss", "A41_latency_report", "W14_retention", "ST2_circuit_breaker", "ST8_memory_upsert"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, name):
    con = check.connect(SF)
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert check.rows_of(df.columns, [tuple(r) for r in df.collect()]) == check.rows_of(cols, cur.fetchall())


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
