"""J19 on every call of the log."""

from collections import Counter

from pyspark.sql import functions as F

from boardlake.operators import assemble as A
from boardlake.plans import all_queries
from boardlake.plans.proxies import Tables

SF = "/root/testdata/sf0.001"


def test_every_call_type_and_rejected_strips(spark):
    rows = all_queries()[0]["j19_meld_parse"](spark, SF).collect()
    good, bad = [r for r in rows if r.problem is None], [r for r in rows if r.problem is not None]
    assert set(Counter(r.type for r in good)) == {"chi", "pon", "daiminkan", "ankan", "kakan"}
    assert any("5mr" in r.tiles or "5pr" in r.tiles or "5sr" in r.tiles for r in good)
    assert all((r.added != "") == (r.type == "kakan") for r in good)
    assert bad and all(r.no is None and r.type is None for r in bad)
    calls = Tables(spark, SF).ev.filter(F.col("type").isin("chi", "pon", "daiminkan", "ankan", "kakan"))
    assert len({(r.game, r.rec) for r in rows}) == calls.select("game", "rec").distinct().count()


def test_a_strip_with_two_readings_is_rejected(spark):
    cells = [("N", i in (2, 6), None) for i in range(7)]  # pon + kan, or kan + pon
    d = spark.createDataFrame([(1, cells)], "id int, cells array<struct<label: string, sideways: boolean, stacked: string>>")
    assert [(r.melds, r.problem) for r in A.parse_strips(d, ["id"], A.meld_hypotheses(spark)).collect()] == [(None, "ambiguous")]
