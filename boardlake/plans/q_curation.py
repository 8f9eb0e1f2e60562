"""Queries for splits, purges, pairing, dataset statistics and set operations
(J2, J7-J9, J15-J17, J20, A3, A4, K4, K5, P12, P17-P19, U1, U2, U4-U6, X1, X2)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from .. import dims
from ..functions import text as TX
from ..functions.num import r6
from ..functions.sqltext import sql_list
from ..functions.tiles import lit_array
from ..operators import curate as K
from ..operators import gates as GT
from ..operators import replay as R
from ..operators import scorers as X
from ..session import fresh_path, stage
from .proxies import CTE
from .q_gates import _label_files
from .registry import query

TN = sql_list(dims.TILES)
CTE["kr"] = "SELECT game, seq, k, pai, coalesce(last_value(bakaze IGNORE NULLS) OVER w, 'None') || coalesce(last_value(kyoku IGNORE NULLS) OVER w, 0) || '.' || coalesce(last_value(honba IGNORE NULLS) OVER w, 0) AS round_key FROM rnd WINDOW w AS (PARTITION BY game ORDER BY seq ROWS UNBOUNDED PRECEDING)"


def _round_keys(t):
    d = R.with_round(t.mj)
    return d.select("game", "seq", "k", "pai", R.round_key(F.col("r_bakaze"), F.col("r_kyoku"), F.col("r_honba")).alias("round_key"))


@query("j2_annotation_state", """
WITH a AS (SELECT game, seq, k % 9 AS n_boxes FROM ev), f AS (SELECT game, seq, file FROM fr WHERE status IN ('ok', 'timeout') AND seq % 4 > 0), s AS (SELECT game, seq, kyoku_ord FROM dealw WHERE seq % 5 > 0)
SELECT a.game, a.seq, n_boxes, file, kyoku_ord FROM a JOIN f USING (game, seq) LEFT JOIN s USING (game, seq)
""")
def j2(t):
    ann = t.ev.select("game", "seq", (F.col("k") % 9).alias("n_boxes"))
    frames = t.fr.filter(F.col("status").isin("ok", "timeout") & (F.col("seq") % 4 > 0)).select("game", "seq", "file")
    states = R.replayed(t.mj, ("open",)).filter(F.col("seq") % 5 > 0).select("game", "seq", "kyoku_ord")
    return K.annotation_frames(ann, frames, states)


SPECS = [(0, "1:*"), (1, "2:E1.0,S2.1"), (2, "3:"), (3, "4"), (4, "2:E1.0,W3.2,E2.1"), (5, ""), (6, "5:N1.0"), (7, "6:*")]
SPEC_SQL = "(SELECT * FROM (VALUES ('1', true, CAST([] AS VARCHAR[])), ('2', false, ['E1.0', 'W3.2', 'E2.1']), ('3', false, []), ('4', false, []), ('5', false, ['N1.0']), ('6', true, [])) AS v(name, whole, keys))"


def _specs(t, n: int = len(SPECS)):
    """Holdout arguments for the games that exist in the log."""
    return TX.holdout_specs(t.spark.createDataFrame(SPECS[:n], "ord int, spec string"))


@query("p17_holdout_specs", f"""
SELECT name, whole, array_to_string(list_sort(keys), ',') AS keys, count(*) AS events FROM {SPEC_SQL} JOIN ev ON CAST(ev.game AS VARCHAR) = name GROUP BY ALL
""")
def p17(t):
    d = t.ev.select(F.col("game").cast("string").alias("name")).join(_specs(t), "name")
    return d.groupBy("name", "whole", F.array_join(F.array_sort("keys"), ",").alias("keys")).agg(F.count(F.lit(1)).alias("events"))


@query("j7_holdout_split", f"""
SELECT CAST(kr.game AS VARCHAR) AS game, seq, round_key, CASE WHEN coalesce(whole OR list_contains(keys, round_key), false) THEN 'val' ELSE 'train' END AS split FROM kr LEFT JOIN {SPEC_SQL} ON name = CAST(kr.game AS VARCHAR)
""")
def j7(t):
    d = _round_keys(t).select(F.col("game").cast("string").alias("game"), "seq", "round_key")
    return K.split_rows(d, _specs(t)).select("game", "seq", "round_key", "split")


@query("j20_holdout_leaks", """
WITH s AS (SELECT game, cls, CASE WHEN n_chars % 2 = 0 THEN 'train' ELSE 'val' END AS split FROM docs)
SELECT game, cls FROM s WHERE split = 'train' INTERSECT SELECT game, cls FROM s WHERE split = 'val'
""")
def j20(t):
    d = t.docs.select("game", "cls", F.when(F.col("n_chars") % 2 == 0, "train").otherwise("val").alias("split"))
    return K.holdout_leaks(d, ["game", "cls"])


@query("j8_purge", """
WITH m AS (SELECT DISTINCT game, seq FROM dealw WHERE open AND n_discards = 0), r AS (SELECT game, seq, unnest(['crop', 'image', 'label']) AS kind FROM fr WHERE file IS NOT NULL)
SELECT 'kept' AS what, kind, count(*) AS n FROM r WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.game = r.game AND m.seq = r.seq) GROUP BY kind
UNION ALL SELECT 'gone', kind, count(*) FROM r JOIN m USING (game, seq) GROUP BY kind
""")
def j8(t):
    s = R.replayed(t.mj, ("open",))
    manifest = s.filter(R.deal_window(F.col("open"), F.col("n_discards"))).select("game", "seq").distinct()
    rows = t.fr.filter(F.col("file").isNotNull()).select("game", "seq", F.explode(lit_array(["crop", "image", "label"])).alias("kind"))
    kept = K.purge(rows, manifest).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    gone = K.purge_preview(rows, manifest)
    return kept.select(F.lit("kept").alias("what"), "kind", "n").unionByName(gone.select(F.lit("gone").alias("what"), "kind", "n"))


@query("j9_existing_only", "SELECT game || '/' || key AS path FROM docs WHERE n_chars % 3 > 0")
def j9(t):
    path = F.concat("game", F.lit("/"), F.col("key").cast("string"))
    return K.existing_only(t.docs.select(path.alias("path")), t.docs.filter(F.col("n_chars") % 3 > 0).select(path.alias("path")))


@query("j15_positional_pairs", """
WITH e AS (SELECT o_orderkey AS frame, list_transform(range(o_custkey % 4 + 1), lambda i: (['btn_chi', 'btn_pon', 'btn_kan', 'btn_skip'])[i + 1]) AS labels FROM orders),
x AS (SELECT frame, unnest(labels) AS label, unnest(range(len(labels))) AS pos, len(labels) AS ne FROM e),
f AS (SELECT frame, det_id, row_number() OVER (PARTITION BY frame ORDER BY x0, det_id) - 1 AS pos, count(*) OVER (PARTITION BY frame) AS nf FROM bx)
SELECT x.frame, CAST(x.pos AS INTEGER) AS pos, label, det_id, ne = coalesce((SELECT count(*) FROM bx WHERE bx.frame = x.frame), 0) AS reliable FROM x LEFT JOIN f ON f.frame = x.frame AND f.pos = x.pos
""")
def j15(t):
    names = lit_array(["btn_chi", "btn_pon", "btn_kan", "btn_skip"])
    e = t.raw("orders").select(F.col("o_orderkey").alias("frame"), F.slice(names, F.lit(1), (F.col("o_custkey") % 4 + 1).cast("int")).alias("labels"))
    d = K.pair_by_position(e, t.bx.select("frame", "det_id", "x0"), ["frame"], "x0", "det_id", F.floor(F.col("x0") / 16))
    return d.select("frame", "pos", "label", "det_id", "reliable")


CTE["crp"] = """
SELECT frame % 5 AS game, frame AS seq, det_id AS crop_idx, cls, score100 % 6 = 0 AS bad, row_number() OVER (PARTITION BY frame ORDER BY det_id) - 1 AS no, l_linenumber FROM bx
"""


@query("j16_align_crops", """
WITH l AS (SELECT game, seq, no, CASE WHEN seq % 3 = 0 AND no = 1 THEN (cls + 1) % 38 ELSE cls END AS cls FROM crp WHERE NOT (seq % 7 = 0 AND no = 0)),
l2 AS (SELECT game, seq, row_number() OVER (PARTITION BY game, seq ORDER BY no) - 1 AS no, cls FROM l),
d AS (SELECT game, seq, CASE WHEN count(*) FILTER (bad) = 0 THEN 'keep' WHEN count(*) FILTER (bad) <= 2 THEN 'drop_boxes' ELSE 'drop_frame' END AS decision,
  list(cls ORDER BY no) AS cc FROM crp GROUP BY ALL),
q AS (SELECT d.*, cc = (SELECT list(cls ORDER BY no) FROM l2 WHERE l2.game = d.game AND l2.seq = d.seq) AS al FROM d)
SELECT 'crop' AS what, c.game, c.seq, count(*) AS n, CAST(sum(c.cls) AS BIGINT) AS s FROM crp c JOIN q USING (game, seq) WHERE decision = 'keep' OR (decision = 'drop_boxes' AND NOT bad) GROUP BY ALL
UNION ALL SELECT 'label', l2.game, l2.seq, count(*), CAST(sum(l2.cls) AS BIGINT) FROM l2 JOIN q USING (game, seq) LEFT JOIN crp c ON c.game = l2.game AND c.seq = l2.seq AND c.no = l2.no
  WHERE decision = 'keep' OR (decision = 'drop_boxes' AND al AND NOT c.bad) GROUP BY l2.game, l2.seq
""")
def j16(t):
    from ..operators.ordered import numbered, seq_chunk

    crops = t.bx.select((F.col("frame") % 5).alias("game"), F.col("frame").alias("seq"), F.col("det_id").alias("crop_idx"), "cls", (F.col("score100") % 6 == 0).alias("bad"))
    ch = seq_chunk("crop_idx", 1 << 22)
    n = stage(numbered(crops, ["game", "seq"], ["crop_idx"], ch, "no").withColumn("no", F.col("no") - 1), "numbered-crops")
    crops, short = n.withColumnRenamed("no", "line_no"), F.col("seq") % 7 == 0  # some frames lack their first row
    lab = n.filter(~(short & (F.col("no") == 0)))
    lab = lab.select("game", "seq", F.when((F.col("seq") % 3 == 0) & (F.col("no") == 1), (F.col("cls") + 1) % 38).otherwise(F.col("cls")).alias("cls"),
                     (F.col("no") - short.cast("int")).alias("line_no"))
    dec = crops.groupBy("game", "seq").agg(GT.decide(F.count_if("bad")).alias("decision"))
    c, l = K.align_crops(crops, lab, dec)
    tot = lambda d, w: d.groupBy("game", "seq").agg(F.count(F.lit(1)).alias("n"), F.sum("cls").cast("long").alias("s")).select(F.lit(w).alias("what"), "game", "seq", "n", "s")
    return tot(c, "crop").unionByName(tot(l, "label"))


@query("j17_later_wins", """
WITH u AS (SELECT game AS name, 0 AS ord, 'v1/' || game AS dir FROM docs UNION ALL SELECT game, 1, 'v2/' || game FROM docs WHERE key % 40 = 1 UNION ALL SELECT game, 2, 'v3/' || game FROM docs WHERE key % 50 = 3)
SELECT name, max(ord) AS ord, arg_max(dir, ord) AS dir FROM u GROUP BY name
""")
def j17(t):
    g = lambda c, v: t.docs.filter(c).select(F.col("game").alias("name"), F.concat(F.lit(v), "game").alias("dir")).distinct()
    k = F.col("key")
    return K.later_wins(K.union_sources([g(F.lit(True), "v1/"), g(k % 40 == 1, "v2/"), g(k % 50 == 3, "v3/")]), "name")


@query("u1_union_sources", """
SELECT 0 AS ord, lang AS cls, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 1, role, count(*) FROM conversations GROUP BY role
""")
def u1(t):
    a = t.raw("documents").select(F.col("lang").alias("cls"))
    b = t.raw("conversations").select(F.col("role").alias("cls"))
    return K.union_sources([a, b]).groupBy("ord", "cls").agg(F.count(F.lit(1)).alias("n"))


@query("u2_covered_keys", "SELECT game, seq FROM ev WHERE k % 13 > 0 INTERSECT SELECT game, seq FROM fr WHERE file IS NOT NULL")
def u2(t):
    return K.covered(t.ev.filter(F.col("k") % 13 > 0), t.fr.filter(F.col("file").isNotNull()), ["game", "seq"])


@query("u4_resume_work", """
WITH f AS (SELECT DISTINCT game AS name, 'dir_' || game AS dir FROM docs), i AS (SELECT game, count(*) AS n_img FROM docs WHERE game <> 'src3' GROUP BY game),
l AS (SELECT game, count(*) AS n_lab, count(*) FILTER (key % 97 = 0 AND n_chars % 7 <> 0) AS bad FROM docs WHERE NOT (n_chars % 9 = 0 AND game LIKE '%7') GROUP BY game),
done AS (SELECT game FROM i JOIN l USING (game) WHERE n_img = n_lab AND bad = 0)
SELECT name, CASE WHEN name < 'src15' THEN 'old_' || name ELSE dir END AS dir FROM f WHERE name NOT IN (SELECT game FROM done)
""")
def u4(t):
    found = t.docs.select(F.col("game").alias("name")).distinct().withColumn("dir", F.concat(F.lit("dir_"), "name"))
    problems = GT.label_problems(*_label_files(t), 5)
    old = found.filter(F.col("name") < "src15").select("name", F.concat(F.lit("old_"), "name").alias("dir"))
    return K.resume_work(found, problems, old)


@query("u5_duplicate_names", """
SELECT * FROM (SELECT name, count(*) OVER (PARTITION BY name) AS n, url AS origin FROM (SELECT regexp_extract(url, '://([^/]+)/', 1) AS name, url FROM pages)) WHERE n > 1
""")
def u5(t):
    return K.duplicate_names(t.raw("pages").select(F.regexp_extract("url", "://([^/]+)/", 1).alias("name"), "url"), "name", "url")


@query("u6_missing_holdouts", """
SELECT ord, name FROM (VALUES (0, 'src1'), (1, 'src99'), (2, 'lost')) v(ord, name) WHERE name NOT IN (SELECT game FROM docs)
""")
def u6(t):
    games = t.docs.select(F.col("game").alias("name")).distinct()
    asked = K.missing_holdouts(["src1", "src99", "lost"], games, "src1")
    return asked.unionByName(K.missing_holdouts([], games, "src1"))


@query("a3_class_coverage", f"""
WITH b AS (SELECT CASE WHEN frame % 9 = 0 THEN 'val' ELSE 'train' END AS split, gt AS name, pos = 0 AS attr FROM bag WHERE gt <> 'back'),
g AS (SELECT split, name FROM (VALUES ('train'), ('val')) s(split), (SELECT unnest({sql_list(dims.TILES[:37])}) AS name) UNION ALL SELECT NULL, unnest({sql_list(dims.TILES[:37])})),
c AS (SELECT split, name, count(*) AS total, count(*) FILTER (attr) AS wa FROM b GROUP BY GROUPING SETS ((split, name), (name)))
SELECT g.split, g.name, coalesce(total, 0) AS total, coalesce(wa, 0) AS with_attr, coalesce(round_even(100e0 * wa / total, 6), 0e0) AS share, coalesce(wa, 0) < 260 AS starved
FROM g LEFT JOIN c ON c.name = g.name AND c.split IS NOT DISTINCT FROM g.split
""")
def a3(t):
    d = t.bag.filter(F.col("gt") != "back").select(F.when(F.col("frame") % 9 == 0, "val").otherwise("train").alias("split"), F.col("gt").alias("name"), (F.col("pos") == 0).alias("attr"))
    d = K.class_coverage(d, dims.TILES[:37], 260)
    return d.select("split", "name", "total", "with_attr", r6(F.col("share")).alias("share"), "starved")


ZN = ["river", "meld", "hand"]


def _a4_sql() -> str:
    cols = ", ".join(f"count(*) FILTER (zone = '{z}') AS {z}_boxes, count(*) FILTER (zone = '{z}' AND rel) AS {z}_ok, count(*) FILTER (zone = '{z}' AND unr) AS {z}_unrendered" for z in ZN)
    return f"""WITH b AS (SELECT 'g' || (frame % 11) AS game, (['river', 'meld', 'hand'])[l_linenumber % 3 + 1] AS zone, score100 > 4 AS rel, score100 <= 4 AND l_linenumber = 3 AS unr FROM bx)
SELECT game, {cols} FROM b GROUP BY game"""


@query("a4_annotation_summary", _a4_sql())
def a4(t):
    zone = F.get(lit_array(ZN), F.col("l_linenumber") % 3)
    d = t.bx.select(F.concat(F.lit("g"), (F.col("frame") % 11).cast("string")).alias("game"), zone.alias("zone"), (F.col("score100") > 4).alias("reliable"),
                    ((F.col("score100") <= 4) & (F.col("l_linenumber") == 3)).alias("unrendered"))
    s = K.annotation_summary(d, ZN)
    path = fresh_path(t.spark, "summary")
    K.write_summary(s, path)
    # a second run over some games replaces their rows only
    K.write_summary(s.filter(F.col("game").isin("g1", "g2")), path)
    return t.spark.read.parquet(path).select("game", *[f"{z}_{c}" for z in ZN for c in ("boxes", "ok", "unrendered")])


@query("k4_seeded_sample", """
SELECT key, game FROM docs ORDER BY CAST('0x' || left(md5('7|' || key), 15) AS BIGINT), key LIMIT 100
""")
def k4(t):
    return K.seeded_order(t.docs.select("key", "game"), ["key"], 7, 100)


@query("k5_diverse_frames", """
WITH RECURSIVE f AS (SELECT game, seq, k % 6 AS melds, k % 2 AS hold, (k % 6) * 3 + k % 2 AS interest FROM ev),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY melds, hold, game ORDER BY seq) - 1 AS no, count(*) OVER (PARTITION BY melds, hold, game) AS n FROM f) WHERE no = n // 2),
s AS (SELECT row_number() OVER (ORDER BY max(interest) DESC, melds, hold) AS visit, list({'game': game, 'seq': seq, 'melds': melds, 'hold': hold, 'interest': interest}) AS offers FROM m GROUP BY melds, hold),
w(visit, picks) AS (SELECT CAST(0 AS BIGINT), CAST([] AS STRUCT(game BIGINT, seq BIGINT, melds BIGINT, hold BIGINT, interest BIGINT, "rank" BIGINT)[])
  UNION ALL SELECT s.visit, list_concat(picks, (SELECT list({'game': game, 'seq': seq, 'melds': melds, 'hold': hold, 'interest': interest, 'rank': r} ORDER BY r) FROM
      (SELECT *, row_number() OVER (ORDER BY used, game) AS r FROM (SELECT o.*, len(list_filter(w.picks, lambda p: p.game = o.game)) AS used FROM (SELECT unnest(s.offers) AS o))) WHERE r <= 4))[1:20]
  FROM w JOIN s ON s.visit = w.visit + 1 WHERE len(w.picks) < 20)
SELECT p.game, p.seq, p.melds, p.hold, p.interest, CAST(p."rank" AS INTEGER) AS rank FROM (SELECT unnest(arg_max(picks, visit)) AS p FROM w)
""")
def k5(t):
    k = F.col("k")
    d = t.ev.select("game", "seq", (k % 6).alias("melds"), (k % 2).alias("hold"), ((k % 6) * 3 + k % 2).alias("interest"))
    return K.diverse_frames(d, ["melds", "hold"], 4, 20)


@query("p12_method_fields", """
SELECT game, seq, method, CASE WHEN method = '.lq.ActionPrototype' THEN 'Action' || type END AS action_name FROM (SELECT *, CASE WHEN k % 2 = 0 THEN '.lq.ActionPrototype' WHEN k % 5 > 0 THEN '.lq.FastTest.authGame' END AS method FROM ev)
""")
def p12(t):
    k = F.col("k")
    m = F.when(k % 2 == 0, ".lq.ActionPrototype").when(k % 5 > 0, ".lq.FastTest.authGame")
    return t.ev.select("game", "seq", TX.method_fields(m, F.concat(F.lit("Action"), "type")).alias("m")).select("game", "seq", "m.*")


LANG_CASE = " ".join(f"WHEN lower(replace(trim({{c}}), '_', '-')) IN ({', '.join(repr(a) for a in names)}) THEN '{code}'" for code, names in dims.LANGUAGE_ALIASES.items())


def _lang(c: str) -> str:
    return f"(CASE WHEN {c} IS NULL OR trim({c}) = '' THEN NULL {LANG_CASE.format(c=c)} ELSE trim({c}) END)"


@query("p18_language", f"""
WITH d AS (SELECT key, CASE key % 4 WHEN 0 THEN ' CHS_T ' WHEN 1 THEN cls WHEN 2 THEN '' END AS ov, CASE key % 3 WHEN 0 THEN 'jpn' WHEN 1 THEN 'klingon' END AS pv, (['jp', 'en', 'cn', 'kr'])[key % 4 + 1] AS server FROM docs),
p AS (SELECT *, CASE WHEN {_lang('pv')} IN ('zh-Hans', 'zh-Hant', 'ja', 'en', 'ko') AND key % 5 > 0 THEN {_lang('pv')} WHEN key % 7 = 0 THEN 'en' END AS probe FROM d)
SELECT key, probe, coalesce({_lang('ov')}, {_lang('probe')}, CASE server WHEN 'jp' THEN 'ja' WHEN 'en' THEN 'en' WHEN 'cn' THEN 'zh-Hans' END, 'unknown') AS language FROM p
""")
def p18(t):
    k = F.col("key")
    pv = F.when(k % 3 == 0, "jpn").when(k % 3 == 1, "klingon")
    entry = lambda key, v: F.struct(key.alias("key"), v.alias("value"))
    entries = F.array(entry(F.lit("token"), F.lit("ja")), entry(F.when(k % 5 > 0, "prefer_Language").otherwise("other"), pv), entry(F.lit("locale"), F.when(k % 7 == 0, "en-GB")))
    d = t.docs.select("key", "cls", TX.probe_language(entries).alias("probe"))
    override = F.when(k % 4 == 0, " CHS_T ").when(k % 4 == 1, F.col("cls")).when(k % 4 == 2, "")
    server = F.get(lit_array(["jp", "en", "cn", "kr"]), (k % 4).cast("int"))
    return d.select("key", "probe", TX.resolve_language(server, F.col("probe"), override).alias("language"))


@query("p19_seat_metadata", """
SELECT game, rec, CASE WHEN hero_in THEN 100 + game END AS hero_account, n_players + 4 - n_players AS n_seats, 100 + game + 1 AS last_human, CASE WHEN hero_in THEN '6=' || (k % 5) || ',7=' || (k % 9) ELSE '' END AS "table"
FROM (SELECT game, rec, arg_min(k, seq) AS k, arg_min(k, seq) % 3 > 0 AS hero_in, 2 AS n_players FROM ev GROUP BY ALL)
""")
def p19(t):
    d = t.ev.groupBy("game", "rec").agg(F.min_by("k", "seq").alias("k"))
    k, g = F.col("k"), F.col("game").cast("int")
    view = lambda s, i: F.struct(s.cast("int").alias("slot"), i.cast("int").alias("item"))
    player = lambda a, views: F.struct(a.alias("account"), (k % 40).alias("charid"), F.lit(None).cast("int").alias("skin"), views.alias("views"))
    mine = F.array(view(F.lit(6), F.lit(77)), view(F.lit(7), k % 9), view(F.lit(None), F.lit(1)), view(F.lit(6), k % 5))
    bot = F.struct(F.lit(0).alias("account"), F.lit(1).alias("charid"), F.lit(2).alias("skin"))
    d = d.select("game", "rec", F.when(k % 3 > 0, 100 + g).otherwise(-1).alias("hero"), F.array(player(100 + g, mine), player(101 + g, F.array(view(F.lit(8), F.lit(5))))).alias("players"),
                 F.array(bot, bot).alias("robots"), (F.concat_ws("-", "game", "rec")).alias("gid"))
    m = K.seat_metadata(d.withColumn("game", F.col("gid")))
    kv = F.transform(F.array_sort(F.map_entries("table")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return m.select(F.split("game", "-")[0].cast("long").alias("game"), F.split("game", "-")[1].cast("long").alias("rec"), "hero_account", F.size("characters").alias("n_seats"),
                    F.element_at(F.filter("characters", lambda c: ~c["robot"]), -1)["account"].alias("last_human"), F.concat_ws(",", kv).alias("table"))


def _make_scorer():
    """A stand-in for a user's model: absolute features scaled by the largest one."""
    def score(batch: pd.DataFrame) -> pd.DataFrame:
        if batch.empty:
            return pd.DataFrame({"key": batch["key"], "cls": pd.Series(dtype="int32"), "p": pd.Series(dtype="float64")})
        a = np.abs(np.stack(batch["v"].to_numpy())[:, :38])
        return pd.DataFrame({"key": batch["key"], "cls": a.argmax(axis=1).astype("int32"), "p": a[:, 0] / a.max(axis=1)})

    return score


@query("x1_scorer", "SELECT key, list_position(probs, list_max(probs)) - 1 AS cls, round_even(probs[1], 6) AS p FROM prob")
def x1(t):
    return X.score_with(t.vec.select("key", "v"), _make_scorer, "key long, cls int, p double").select("key", "cls", r6(F.col("p")).alias("p"))


H = "CAST('0x' || left(md5('{seed}|' || game || '|' || seq), 15) AS BIGINT) % 1000000"


@query("x2_fault_injection", f"""
SELECT game, seq, pai || CASE WHEN {H.format(seed=4)} < 80000 THEN '?' ELSE '' END AS "read", {H.format(seed=4)} < 80000 AS corrupted FROM ev WHERE {H.format(seed=3)} >= 50000
""")
def x2(t):
    d = t.ev.select("game", "seq", F.col("pai").alias("read"))
    return X.inject_faults(d, ["game", "seq"], "read", 0.05, 0.08, 3)
