"""Log, frame, box and score tables derived from the driver's tables (see FIXTURES.md).

Each derivation exists twice with the same meaning: as a DataFrame here and as a DuckDB
expression in ``CTE``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions.sqltext import sql_list

CALL6 = dims.CALL_EVENTS
ERR3 = ["reach", "reach_accepted", "dora"]

CTE: dict[str, str] = {}

CTE["ev"] = f"""
SELECT user_id AS game, event_id AS seq, epoch_us(ts) AS ts_us, value, k,
  k % 4 AS seat, k % 37 AS cls, (k % 11 = 0) AS syncing,
  CASE event_type WHEN 'signup' THEN 'start_kyoku' WHEN 'view' THEN 'tsumo' WHEN 'click' THEN 'dahai'
    WHEN 'purchase' THEN ({sql_list(CALL6)})[k % 6 + 1] ELSE ({sql_list(ERR3)})[k % 3 + 1] END AS type,
  ({sql_list(dims.TILES)})[k % 37 + 1] AS pai, k % 4 AS actor, (k // 4) % 4 AS target,
  event_id // 200 AS rec
FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events)
"""
CTE["fr"] = """
SELECT game, seq, ts_us, status,
  CASE WHEN status IN ('ok', 'timeout') THEN 'frames/' || lpad(CAST(seq AS VARCHAR), 6, '0') || '.png' END AS file
FROM (SELECT *, CASE seq % 10 WHEN 0 THEN 'no_capture' WHEN 1 THEN 'timeout' WHEN 2 THEN 'extra' ELSE 'ok' END AS status
      FROM ev WHERE seq % 3 <> 0)
"""
CTE["bx"] = """
SELECT l_orderkey AS frame, CAST(l_partkey % 97 AS DOUBLE) AS x0, CAST(l_suppkey % 89 AS DOUBLE) AS y0,
  CAST(l_partkey % 97 + 10 + l_quantity AS DOUBLE) AS x1,
  CAST(l_suppkey % 89 + 12 + 5 * l_linenumber AS DOUBLE) AS y1,
  CAST(l_partkey % 38 AS INTEGER) AS cls,
  CAST(round(l_discount * 100) + round(l_tax * 100) AS INTEGER) AS score100,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS det_id, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag, l_linestatus
FROM lineitem
"""
CTE["bag"] = f"""
SELECT l_orderkey AS frame, l_returnflag AS zone, CAST(l_suppkey % 4 AS INTEGER) AS pos,
  ({sql_list(dims.TILES)})[l_partkey % 38 + 1] AS pred,
  ({sql_list(dims.TILES)})[(l_partkey + CASE l_linenumber WHEN 1 THEN 1 ELSE 0 END) % 38 + 1] AS gt
FROM lineitem
"""
CTE["vec"] = "SELECT vec_id AS key, label AS game, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"
CTE["prob"] = f"""
SELECT key, key // 8 AS frame, ({sql_list(dims.TILES)})[game + 1] AS gt, (key % 5 = 0) AS sideways, (key % 13 = 0) AS felt,
  list_transform(a, lambda x: x / list_max(a)) AS probs
FROM (SELECT key, game, list_transform(v[1:38], lambda x: abs(x)) AS a FROM vec)
"""
CTE["smp"] = """
SELECT game AS round, seat AS pos, seq, CAST(floor(value) AS BIGINT) % 50 AS d_along, CAST(k % 30 AS BIGINT) AS d_cross,
  CAST(1 + k % 5 AS BIGINT) AS score, k % 6 AS n_feat
FROM ev
"""
CTE["docs"] = """
SELECT d.doc_id AS key, d.lang AS cls, d.source AS game, d.n_chars, l.quality, l.toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""


def _pick(values: list[str], i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), i.cast("int") + 1)


class Tables:
    """Lazy access to the derived tables of one scale factor."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def ev(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        d = self.raw("events").select(
            F.col("user_id").alias("game"), F.col("event_id").alias("seq"),
            _micros(self.raw("events").schema["ts"].dataType.typeName()).alias("ts_us"),
            "value", "event_type", k.alias("k"))
        k = F.col("k")
        kind = (F.when(F.col("event_type") == "signup", "start_kyoku")
                .when(F.col("event_type") == "view", "tsumo")
                .when(F.col("event_type") == "click", "dahai")
                .when(F.col("event_type") == "purchase", _pick(CALL6, k % 6))
                .otherwise(_pick(ERR3, k % 3)))
        return d.select(
            "game", "seq", "ts_us", "value", "k", (k % 4).alias("seat"), (k % 37).alias("cls"),
            (k % 11 == 0).alias("syncing"), kind.alias("type"), _pick(dims.TILES, k % 37).alias("pai"),
            (k % 4).alias("actor"), (F.expr("k div 4") % 4).cast("int").alias("target"),
            F.expr("seq div 200").alias("rec"))

    @cached_property
    def mj(self) -> DataFrame:
        """The log with every event field the replay operators read."""
        k = F.col("k")
        pai, typ = F.col("pai"), F.col("type")
        start = typ == "start_kyoku"
        n_cons = (F.when(typ.isin("chi", "pon"), 2).when(typ.isin("daiminkan", "kakan"), 3)
                  .when(typ == "ankan", 4).otherwise(0))
        scores = [20000 + 100 * ((k * (i + 1)) % 100) for i in range(4)]
        return self.ev.select(
            "*", F.lit(0).alias("ev_idx"), (k % 2 == 0).alias("tsumogiri"),
            F.array_repeat(pai, n_cons).alias("consumed"),
            F.when(start, _pick(dims.WINDS, F.expr("k div 25"))).alias("bakaze"),
            F.when(start, k % 4 + 1).alias("kyoku"), F.when(start, k % 5).alias("honba"),
            F.when(start, k % 3).alias("kyotaku"), F.when(start, k % 4).alias("oya"),
            F.when(start | (typ == "dora"), pai).alias("dora_marker"),
            F.when(start & (k % 20 == 19), F.array(*scores[:3])).when(start, F.array(*scores)).alias("scores"),
            F.when(k % 7 == 0, 70 - k % 70).alias("left_count"))

    @cached_property
    def fr(self) -> DataFrame:
        s = F.col("seq") % 10
        status = F.when(s == 0, "no_capture").when(s == 1, "timeout").when(s == 2, "extra").otherwise("ok")
        d = self.ev.filter(F.col("seq") % 3 != 0).select("game", "seq", "ts_us", status.alias("status"))
        return d.withColumn("file", F.when(F.col("status").isin("ok", "timeout"), F.concat(
            F.lit("frames/"), F.lpad(F.col("seq").cast("string"), 6, "0"), F.lit(".png"))))

    @cached_property
    def bx(self) -> DataFrame:
        p, s = F.col("l_partkey"), F.col("l_suppkey")
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("frame"), (p % 97).cast("double").alias("x0"), (s % 89).cast("double").alias("y0"),
            (p % 97 + 10 + F.col("l_quantity")).cast("double").alias("x1"),
            (s % 89 + 12 + 5 * F.col("l_linenumber")).cast("double").alias("y1"),
            (p % 38).cast("int").alias("cls"),
            (F.round(F.col("l_discount") * 100) + F.round(F.col("l_tax") * 100)).cast("int").alias("score100"),
            F.round(F.col("l_extendedprice") * 100).cast("long").alias("det_id"), "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")

    @cached_property
    def bag(self) -> DataFrame:
        p = F.col("l_partkey")
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("frame"), F.col("l_returnflag").alias("zone"),
            (F.col("l_suppkey") % 4).cast("int").alias("pos"), _pick(dims.TILES, p % 38).alias("pred"),
            _pick(dims.TILES, (p + F.when(F.col("l_linenumber") == 1, 1).otherwise(0)) % 38).alias("gt"))

    @cached_property
    def vec(self) -> DataFrame:
        return self.raw("embeddings").select(
            F.col("vec_id").alias("key"), F.col("label").alias("game"), F.col("embedding").cast("array<double>").alias("v"))

    @cached_property
    def prob(self) -> DataFrame:
        a = F.transform(F.slice("v", 1, 38), lambda x: F.abs(x))
        d = self.vec.select("key", "game", a.alias("a"))
        return d.select(
            "key", F.expr("key div 8").alias("frame"), _pick(dims.TILES, F.col("game")).alias("gt"),
            (F.col("key") % 5 == 0).alias("sideways"), (F.col("key") % 13 == 0).alias("felt"),
            F.transform("a", lambda x: x / F.array_max("a")).alias("probs"))

    @cached_property
    def smp(self) -> DataFrame:
        return self.ev.select(
            F.col("game").alias("round"), F.col("seat").alias("pos"), "seq",
            (F.floor("value") % 50).alias("d_along"), (F.col("k") % 30).cast("long").alias("d_cross"),
            (1 + F.col("k") % 5).cast("long").alias("score"), (F.col("k") % 6).alias("n_feat"))

    @cached_property
    def docs(self) -> DataFrame:
        d = self.raw("documents").select(
            F.col("doc_id").alias("key"), F.col("lang").alias("cls"), F.col("source").alias("game"), "n_chars")
        lab = self.raw("labels").select(F.col("doc_id").alias("key"), "quality", "toxic")
        return d.join(lab, "key", "left")


def _micros(type_name: str) -> Column:
    """Microseconds since the epoch, whatever the session's time zone is."""
    if type_name == "timestamp_ntz":
        return F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return F.unix_micros(F.col("ts"))
