"""Values that only larger tables have: sums beyond 16 bits in a first frame, products beyond 35 and 53 bits."""

from latticework.functions.fixedpoint import seven_bit_groups
from latticework.operators import control
from latticework.plans.queries import ORACLES, QUERIES

from .compare import assert_same


def test_first_frame_of_a_buffer_is_held_as_its_sql_does(spark, tmp_path):
    import duckdb

    # Three frames of 16x16; in the first, a sample of 1023 gives a residual of 115,080.
    values = [[1023.0, 337.0, 5.0, 64.0], [3.0, 900.0, 900.0, 70.0], [500.0, 0.0, 1000.0, 64.0]]
    rows = [(256 * f + i, values[f][i % 4]) for f in range(3) for i in range(256)]
    spark.createDataFrame(rows, "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert_same(QUERIES["temporal_buffer"](spark, str(tmp_path)), con, ORACLES["temporal_buffer"])


def test_first_frame_of_a_buffer(spark):
    df = spark.createDataFrame([(0, i, v, i == 2) for i, v in enumerate([40000, -5000, 50000, 1])], "p long, f long, v long, intra boolean")
    made = lambda **how: [(r.buffer, r.clamped) for r in control.temporal_buffer(df, ["p"], "f", "intra", "v", **how).orderBy("f").collect()]
    assert made() == [(32767, True), (27767, False), (32767, True), (32767, True)]
    assert made(open_first=True) == [(40000, False), (32767, True), (32767, True), (32767, True)]


def test_groups_of_large_values_are_whole(spark):
    values = [(1 << 35) - 1, 1 << 35, 36_000_000 * 900_000, (1 << 53) + 1, (1 << 60) + 129, (1 << 63) - 1]
    df = spark.createDataFrame([(v,) for v in values], "v long").select("v", seven_bit_groups("v").alias("g"))
    for r in df.collect():
        got = 0
        for b in r.g:
            got = got << 7 | b & 127
        assert got == r.v and [b >> 7 for b in r.g] == [1] * (len(r.g) - 1) + [0] and len(r.g) == -(-r.v.bit_length() // 7)
