"""Token arrays: layout constants, round trips, prompts, collation."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspool.functions import tokens as K


def test_layout():
    assert K.ID["bos"] == 16384 and K.ID["frag_end"] == 16394 and K.ID["rate_any"] == 16400 and K.ID["loud_any"] == 16404


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 4095), min_size=1, max_size=6), st.randoms())
def test_round_trip(spark, l0, rng):
    l1, l2 = ([rng.randrange(4096) for _ in range(len(l0) * k)] for k in (2, 4))
    df = spark.createDataFrame([(l0, l1, l2)], "a array<int>, b array<int>, c array<int>")
    flat = df.select("*", K.flatten_codes("a", "b", "c").alias("f"))
    r = flat.select("f", K.unflatten_codes(F.concat("f", K.ints(7))).alias("u")).first()
    assert (r.u.l0, r.u.l1, r.u.l2) == (l0, l1, l2) and len(r.f) == 7 * len(l0)
    slots = [x % 4096 + (i % 7) * 4096 for i, x in enumerate(r.f)]
    back = spark.createDataFrame([(slots,)], "s array<int>").select(K.slots_to_levels("s").alias("l")).first().l
    assert back == r.f


def test_prompts_and_collation(spark):
    df = spark.createDataFrame([([1, 2, 3], [0, 5], None, 4)], "t array<int>, r array<int>, rate int, loud int")
    row = df.select(
        K.build_prompt("t", K.rate_token("rate"), K.loud_token(F.lit(1))).alias("plain"),
        K.build_prompt("t", K.rate_token("loud"), K.loud_token("rate"), F.col("r")).alias("clone"),
        K.collated("t", F.lit(2), F.lit(5)).alias("c"),
    ).first()
    assert row.plain == [16384, 16391, 16400, 16402, 16387, 1, 2, 3, 16388, 16389]
    assert row.clone == [16384, 16392, 16399, 16404, 16387, 1, 2, 3, 16388, 16389, 4096, 4101]
    assert row.c.input_ids == [1, 2, 3, 16386, 16386] and row.c.labels == [-100, -100, 3, -100, -100] and row.c.attention_mask == [1, 1, 1, 0, 0]


def test_buckets(spark):
    df = spark.createDataFrame([(None,), (0.5,), (1.0,), (9.0,)], "v double")
    assert [r[0] for r in df.select(K.bucket_of("v", [1.0, 2.0])).collect()] == [None, 0, 1, 2]
