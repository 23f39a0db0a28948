"""Queries without SQL: every round trip gives back what went in."""

import pytest

import latticework.streaming.queries  # noqa: F401  (registers)
from latticework.plans import roundtrips  # noqa: F401  (registers)
from latticework.plans.queries import ORACLES, QUERIES

from .compare import assert_same, connect


@pytest.mark.parametrize("name", ["nal_escape_roundtrip", "config_roundtrip", "payload_roundtrip"])
def test_same(spark, data_dir, name):
    rows = QUERIES[name](spark, data_dir).collect()
    assert rows and all(r["same"] == 1 for r in rows)


def test_units_have_one_start_code(spark, data_dir):
    assert all(r["one_start"] == 1 for r in QUERIES["nal_escape_roundtrip"](spark, data_dir).collect())


@pytest.mark.parametrize("name", ["encode_decode_exact", "encode_decode_4x4"])
def test_decoder_equals_encoder(spark, data_dir, name):
    rows = QUERIES[name](spark, data_dir).collect()
    assert rows and all(r["max_diff"] == 0 for r in rows)


def test_codes_are_prefix_free_and_shorter_than_bytes(spark, data_dir):
    rows = [r for r in QUERIES["canonical_codes"](spark, data_dir).collect() if r["doc_id"] < 20]
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(format(r["code"], f"0{r['length']}b") if r["length"] else "")
    for codes in by.values():
        assert not any(a != b and b.startswith(a) for a in codes for b in codes) or len(codes) == 1
    assert sum(r["bits"] for r in rows) < 8 * sum(r["n"] for r in rows)


@pytest.mark.parametrize("name", ["stream_rate_control", "stream_temporal_sums", "stream_gop_totals", "stream_poc_reorder"])
def test_streams_equal_sql(spark, data_dir, name):
    assert_same(QUERIES[name](spark, data_dir), connect(data_dir), ORACLES[name])
