"""Queries for sources and sinks (S1-S18); files are written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..functions import geometry as G
from ..functions import text as TX
from ..functions.num import r9
from ..functions.sqltext import sql_list
from ..functions.tiles import lit_array
from ..operators import curate as K
from ..operators import replay as R
from ..session import fresh_path
from ..sources import datasets as D
from ..sources import records as RC
from .proxies import CTE
from .registry import query

TN = sql_list(dims.TILES)


def log_records(t):
    """Log records: events of one (game, rec) bundled in order, with the message they came from."""
    m = t.mj
    keep = {"type", "actor", "target", "pai", "consumed", "tsumogiri", "bakaze", "kyoku", "honba", "kyotaku", "oya", "dora_marker", "scores"}
    fields = [F.col(c).alias(c) if c in keep else F.lit(None).cast("int" if c == "id" else "array<array<string>>").alias(c) for c in (
        "type", "actor", "target", "pai", "consumed", "tsumogiri", "bakaze", "kyoku", "honba", "kyotaku", "oya", "dora_marker", "scores", "tehais", "id")]
    # a record is one log line and holds few events
    d = m.groupBy("game", "rec").agg(F.array_sort(F.collect_list(F.struct("seq", F.struct(*fields).alias("e")))).alias("_m"), F.min("ts_us").alias("ts_us"),
                                     F.max("syncing").alias("syncing"), F.min_by("k", "seq").alias("k"))
    raw = F.concat(F.lit('{"data":{"data":{"leftTileCount":'), (F.col("k") % 70).cast("string"), F.lit("}}}"))
    return d.select(
        F.col("game").cast("string").alias("flow_id"), F.col("rec").alias("seq"), (F.col("ts_us") / 1e6).alias("ts"), (F.col("k") % 4).alias("seat"),
        F.lit(0).alias("last_op_step"), "syncing", F.when(F.col("k") % 2 == 0, ".lq.ActionPrototype").otherwise(".lq.FastTest.authGame").alias("method"),
        F.lit(None).cast("string").alias("action_name"), F.when(F.col("k") % 3 > 0, raw).alias("raw_liqi"), F.transform("_m", lambda x: x["e"]).alias("mjai"))


CTE["logev"] = """
SELECT game, rec, CAST(row_number() OVER (PARTITION BY game, rec ORDER BY seq) - 1 AS INTEGER) AS ev_idx, seq, type, actor, target, pai, k FROM ev
"""


@query("s1_read_records", """
WITH r AS (SELECT game, rec, arg_min(k, seq) AS k, count(*) AS n, bool_or(syncing) AS syncing FROM ev GROUP BY ALL)
SELECT CAST(game AS VARCHAR) AS flow_id, rec AS seq, n AS n_events, syncing, CASE WHEN k % 3 > 0 THEN k % 70 END AS left_tiles, 0 AS n_meta FROM r
""")
def s1(t):
    path = fresh_path(t.spark, "log")
    RC.write_records(log_records(t), path)
    d = RC.read_records(t.spark, path)
    left = F.get_json_object("raw_liqi", "$.data.data.leftTileCount").cast("int")
    return d.select("flow_id", "seq", F.size("mjai").cast("long").alias("n_events"), "syncing", left.alias("left_tiles"), F.size("meta").alias("n_meta"))


@query("s2_write_records", """
SELECT CAST(game AS VARCHAR) AS flow_id, rec AS seq, ev_idx, type, pai FROM logev UNION ALL SELECT 'header', 1, NULL, NULL, NULL
""")
def s2(t):
    path = fresh_path(t.spark, "log")
    RC.write_records(log_records(t), path)
    lines = t.spark.read.text(path)
    head = lines.filter(F.col("value").startswith('{"_schema"')).select(
        F.lit("header").alias("flow_id"), F.get_json_object("value", "$._schema").cast("long").alias("seq"),
        F.lit(None).cast("int").alias("ev_idx"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("pai"))
    body = lines.filter(~F.col("value").startswith('{"_schema"')).select(
        F.get_json_object("value", "$.flow_id").alias("flow_id"), F.get_json_object("value", "$.seq").cast("long").alias("seq"),
        F.posexplode(F.from_json(F.get_json_object("value", "$.mjai"), "array<struct<type: string, pai: string>>")).alias("ev_idx", "e"))
    return body.select("flow_id", "seq", "ev_idx", "e.type", "e.pai").unionByName(head)


@query("s3_load_frames", """
WITH r AS (SELECT game, seq AS line_no, seq // 50 AS s, CASE WHEN k % 10 = 3 THEN '' ELSE 'frames/' || k || '.png' END AS file, CASE WHEN k % 5 = 0 THEN 'extra' WHEN k % 5 = 1 THEN 'timeout' ELSE 'ok' END AS status FROM ev)
SELECT game, s AS seq, arg_max(file, line_no) AS file FROM r WHERE status IN ('ok', 'timeout') AND file <> '' GROUP BY game, s
""")
def s3(t):
    k = F.col("k")
    s = F.expr("seq div 50")
    d = t.ev.select("game", F.col("seq").alias("line_no"), F.when(k % 2 == 0, s).alias("seq"), F.when(k % 2 == 1, s).alias("step"),
                    F.when(k % 10 == 3, "").otherwise(F.concat(F.lit("frames/"), k.cast("string"), F.lit(".png"))).alias("file"),
                    F.when(k % 5 == 0, "extra").when(k % 5 == 1, "timeout").otherwise("ok").alias("status"))
    return K.load_frames(d, ["ok", "timeout"])


@query("s4_explode_events", "SELECT CAST(game AS VARCHAR) AS flow_id, rec AS seq, ev_idx, type, actor, target, pai FROM logev")
def s4(t):
    return R.explode_events(log_records(t), ("flow_id", "seq")).select("flow_id", "seq", "ev_idx", "type", "actor", "target", "pai")


CTE["caps"] = """
SELECT page_id AS p, page_id % 6 AS shape, '/cap/src/run_' || CAST(page_id // 8 AS VARCHAR) AS run, 'game' || CAST(page_id AS VARCHAR) AS g FROM pages
"""


def _listing(t):
    p = F.col("page_id")
    g, run = F.concat(F.lit("game"), p.cast("string")), F.concat(F.lit("/cap/src/run_"), F.expr("page_id div 8").cast("string"))
    nested = F.concat(run, F.lit("/"), g, F.lit("/"), g, F.lit(".jsonl"))
    sibling = F.concat(run, F.lit("/"), g, F.lit(".jsonl"))
    index = F.concat(run, F.lit("/"), g, F.lit("/frames.jsonl"))
    row = lambda path, size: F.struct(path.alias("path"), F.lit(size).alias("size"))
    s = p % 6
    files = (F.when(s == 0, F.array(row(nested, 10), row(index, 10))).when(s == 1, F.array(row(sibling, 10)))
             .when(s == 2, F.array(row(nested, 10), row(sibling, 10))).when(s == 3, F.array(row(nested, 10), row(index, 0)))
             .when(s == 4, F.array(row(F.concat(F.lit("/cap/src/run_1"), F.lpad(p.cast("string"), 8, "0"), F.lit(".jsonl")), 10)))
             .otherwise(F.array(row(F.concat(F.lit("/cap/src/session"), p.cast("string"), F.lit(".jsonl")), 10))))
    return t.raw("pages").select(F.explode(files).alias("f")).select("f.*")


@query("s5_discover_games", """
SELECT 'src_run_' || (p // 8) || '_' || g AS name, 'ai' AS kind, run || '/' || g || '/' || g || '.jsonl' AS capture, run || '/' || g AS frames_dir FROM caps WHERE shape IN (0, 2)
UNION ALL SELECT 'src_run_' || (p // 8) || '_' || g, 'ai', run || '/' || g || '.jsonl', run || '/' || g FROM caps WHERE shape = 1
UNION ALL SELECT 'src_run_1' || lpad(CAST(p AS VARCHAR), 8, '0'), 'ai', '/cap/src/run_1' || lpad(CAST(p AS VARCHAR), 8, '0') || '.jsonl', '/cap/src/run_1' || lpad(CAST(p AS VARCHAR), 8, '0') FROM caps WHERE shape = 4
UNION ALL SELECT 'session' || p, 'manual', '/cap/src/session' || p || '.jsonl', '/cap/src/session' || p FROM caps WHERE shape = 5
""")
def s5(t):
    return K.discover_games(_listing(t), "/cap/src").select("name", "kind", "capture", "frames_dir")


HOST = "regexp_extract(url, '://([^/]+)/', 1)"


def _capture_path(t):
    p = F.col("page_id")
    host = F.regexp_extract("url", "://([^/]+)/", 1)
    run, g = F.concat(F.lit("run_"), (p % 9).cast("string")), F.concat(F.lit("game"), (p % 13).cast("string"))
    s = p % 5
    path = (F.when(s == 0, F.concat_ws("/", F.lit("/data"), host, run, g, F.concat(g, F.lit(".jsonl")))).when(s == 1, F.concat_ws("/", F.lit("/data"), host, run, F.concat(g, F.lit(".jsonl"))))
            .when(s == 2, F.concat_ws("/", F.lit("/data"), host, run, F.concat(run, F.lit(".jsonl")))).when(s == 3, F.concat_ws("/", F.lit("/data"), host, F.concat(run, F.lit(".jsonl"))))
            .otherwise(F.concat(F.lit("/data/manual/session"), p.cast("string"), F.lit(".jsonl"))))
    return t.raw("pages").select("page_id", path.alias("path"))


CTE["cpath"] = f"""
SELECT page_id, s, h, run, g, CASE s WHEN 0 THEN '/data/' || h || '/' || run || '/' || g || '/' || g || '.jsonl' WHEN 1 THEN '/data/' || h || '/' || run || '/' || g || '.jsonl'
  WHEN 2 THEN '/data/' || h || '/' || run || '/' || run || '.jsonl' WHEN 3 THEN '/data/' || h || '/' || run || '.jsonl' ELSE '/data/manual/session' || page_id || '.jsonl' END AS path
FROM (SELECT page_id, page_id % 5 AS s, {HOST} AS h, 'run_' || (page_id % 9) AS run, 'game' || (page_id % 13) AS g FROM pages)
"""


@query("s6_game_name", """
SELECT page_id, path, CASE WHEN s IN (0, 1) THEN h || '_' || run || '_' || g WHEN s IN (2, 3) THEN h || '_' || run ELSE 'session' || page_id END AS name FROM cpath
""")
def s6(t):
    return _capture_path(t).select("page_id", "path", TX.game_name(F.col("path")).alias("name"))


@query("s8_frames_dir", """
SELECT page_id, d AS frames_dir, d || '/' || regexp_extract(d, '([^/]+)$', 1) || '.jsonl' AS capture FROM (SELECT page_id,
  CASE s WHEN 0 THEN '/data/' || h || '/' || run || '/' || g WHEN 1 THEN '/data/' || h || '/' || run || '/' || g WHEN 2 THEN '/data/' || h || '/' || run WHEN 3 THEN '/data/' || h || '/' || run ELSE '/data/manual/session' || page_id END AS d FROM cpath)
""")
def s8(t):
    d = _capture_path(t).select("page_id", TX.frames_dir(F.col("path")).alias("frames_dir"))
    return d.withColumn("capture", TX.capture_for(F.col("frames_dir")))


@query("s7_resolve_path", """
SELECT page_id AS id, CASE page_id % 6 WHEN 0 THEN '/abs/' || page_id || '.png' WHEN 1 THEN '/idx/g/frames/' || page_id || '.png' WHEN 2 THEN '/repo/captures/frames/' || page_id || '.png'
  WHEN 3 THEN '/repo/captures/raw/g/' || page_id || '.png' WHEN 4 THEN '/idx/g/frames/' || page_id || '.png' ELSE 'frames/' || page_id || '.png' END AS path FROM pages
""")
def s7(t):
    p, png = F.col("page_id") % 6, F.concat(F.col("page_id").cast("string"), F.lit(".png"))
    at = lambda d: F.concat(F.lit(d), png)
    file = F.when(p == 0, at("/abs/")).when(p == 3, at("/old/captures/raw/g/")).when(p == 4, at("deep/")).otherwise(at("frames/"))
    have = F.when(p == 0, F.array(at("/abs/"), at("/idx/g/"))).when(p == 1, F.array(at("/idx/g/frames/"), at("/repo/captures/frames/"))).when(p == 2, F.array(at("/repo/captures/frames/"))) \
        .when(p == 3, F.array(at("/repo/captures/raw/g/"), at("/idx/g/"))).when(p == 4, F.array(at("/idx/g/frames/"))).otherwise(F.array(at("/elsewhere/")))
    files = t.raw("pages").select(F.col("page_id").alias("id"), file.alias("file"), F.lit("/idx/g").alias("index_dir"))
    listing = t.raw("pages").select(F.explode(have).alias("path"))
    return K.resolve_paths(files, listing, ["captures", "/repo/captures"]).select("id", "path")


LW, LH = 128.0, 64.0
PLACE = ["file_name", "row_index"]  # where a row stands in its table
CTE["lbl"] = """
SELECT frame, det_id, l_linenumber AS ln, cls, CAST(cls AS VARCHAR) || ' ' || printf('%.6f', round_even((x0 + x1) / 2 / 128, 6)) || ' ' || printf('%.6f', round_even((y0 + y1) / 2 / 64, 6)) || ' '
  || printf('%.6f', round_even((x1 - x0) / 128, 6)) || ' ' || printf('%.6f', round_even((y1 - y0) / 64, 6)) AS hbb,
  CAST(cls AS VARCHAR) || ' ' || array_to_string(list_transform([x0 / 128, y0 / 64, x1 / 128, y0 / 64, x1 / 128, y1 / 64, x0 / 128, y1 / 64], lambda v: printf('%.6f', round_even(least(1e0, greatest(0e0, v)), 6))), ' ') AS obb FROM bx
"""


def _label_lines(t):
    c = [F.col(n) for n in ("x0", "y0", "x1", "y1")]
    w, h = F.lit(LW), F.lit(LH)
    return t.bx.select("frame", "det_id", F.col("l_linenumber").alias("ln"), "cls", K.hbb_line(F.col("cls"), *c, w, h).alias("hbb"), K.obb_line(F.col("cls"), G.rect(*c), w, h).alias("obb"),
                       *[F.col(f"_metadata.{n}").alias(n) for n in PLACE])


@query("s10_label_text", """
SELECT frame, string_agg(hbb, chr(10) ORDER BY det_id) || chr(10) AS hbb, string_agg(obb, chr(10) ORDER BY det_id) || chr(10) AS obb FROM lbl GROUP BY frame
""")
def s10(t):
    d = _label_lines(t)
    # one file per frame: a frame's rows are its text; equal ids stay in the table's order, as in a stable sort
    return K.label_files(d, ["frame"], ["det_id", *PLACE], {"hbb": "hbb", "obb": "obb"})


@query("s9_read_labels", """
WITH f AS (SELECT frame, cls, string_split(CASE WHEN frame % 2 = 0 THEN hbb ELSE obb END, ' ') AS f, frame % 2 = 1 AS q FROM lbl)
SELECT frame, CASE WHEN q THEN 'obb' ELSE 'hbb' END AS fmt, cls, CASE WHEN q THEN CAST(f[4] AS DOUBLE) END AS qx2, CASE WHEN q THEN CAST(f[9] AS DOUBLE) END AS qy4,
  CASE WHEN NOT q THEN round_even(CAST(f[2] AS DOUBLE) - CAST(f[4] AS DOUBLE) / 2, 9) + 0e0 END AS x, CASE WHEN NOT q THEN CAST(f[5] AS DOUBLE) END AS h FROM f
""")
def s9(t):
    path = fresh_path(t.spark, "labels")
    d = _label_lines(t).withColumn("line", F.when(F.col("frame") % 2 == 0, F.col("hbb")).otherwise(F.col("obb")))
    files = K.label_files(d, ["frame"], "det_id").select((F.col("frame") % 3).alias("game"), F.concat(F.col("frame").cast("string"), F.lit("|"), F.regexp_replace(F.rtrim("text"), "\n", ";")).alias("text"))
    D.write_label_text(files, path)
    back = t.spark.read.text(path).select(F.substring_index("value", "|", 1).cast("long").alias("frame"), F.regexp_replace(F.substring_index("value", "|", -1), ";", "\n").alias("text"))
    p = K.parse_labels(back, ["frame"])
    return p.select("frame", "fmt", "cls", F.get("quad", F.lit(1))["x"].alias("qx2"), F.get("quad", F.lit(3))["y"].alias("qy4"), r9(F.col("x")).alias("x"), "h")


@query("s11_annotation_records", """
SELECT CAST(frame % 7 AS VARCHAR) AS game, det_id AS seq, 'river' AS zone, (l_linenumber <> 3) AS reliable, x0 AS px FROM bx UNION ALL SELECT CAST(frame % 7 AS VARCHAR), det_id, 'hand', l_linenumber <> 7, NULL FROM bx
""")
def s11(t):
    from ..operators.layout import flatten_boxes

    ln, tile = F.col("l_linenumber"), F.get(lit_array(dims.TILES), F.col("cls"))
    quad = G.rect(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    px = F.array(*[F.col(c).cast("int") for c in ("x0", "y0", "x1", "y1")])
    none = lambda typ: F.lit(None).cast(typ)
    d = t.bx.select(
        (F.col("frame") % 7).cast("string").alias("game"), F.col("det_id").alias("seq"),
        F.create_map(F.lit("0"), F.array(F.struct(tile.alias("tile"), quad.alias("face_poly"), F.lit(False).alias("riichi"), F.when(ln == 3, False).alias("reliable")))).alias("discard_slots"),
        F.array(F.struct(tile.alias("tile"), px.alias("px_box"), (ln != 7).alias("reliable"))).alias("hand_boxes"), none("array<string>").alias("flags"))
    path = fresh_path(t.spark, "annotations")
    D.write_annotations(d, path, "json", "gzip")  # names repeat in every row
    back = D.read_annotations(t.spark, path, "json")
    empty = F.create_map().cast(back.schema["meld_boxes"].dataType)
    back = back.withColumns({"meld_boxes": F.coalesce("meld_boxes", empty), "back_boxes": F.coalesce("back_boxes", F.create_map().cast(back.schema["back_boxes"].dataType)),
                             "dora_boxes": F.coalesce("dora_boxes", F.array().cast(back.schema["dora_boxes"].dataType))})
    b = flatten_boxes(back, ["game", "seq"])
    return b.select(F.col("game").cast("string").alias("game"), "seq", "zone", "reliable", F.get("poly", F.lit(0))["x"].alias("px"))


@query("s12_reader_labels", f"""
SELECT CAST(frame % 5 AS VARCHAR) AS game, name || '/' || lpad(CAST(det_id AS VARCHAR), 10, '0') || '.png' AS file, name, tx AS text, 0.15e0 AS pad
FROM (SELECT frame, det_id, ({sql_list(dims.HUD)})[cls % 9 + 1] AS name, CAST(l_suppkey AS VARCHAR) AS tx FROM bx) WHERE frame % 5 < 3
""")
def s12(t):
    name = F.get(lit_array(dims.HUD), F.col("cls") % 9)
    d = t.bx.select((F.col("frame") % 5).cast("string").alias("game"), F.concat(name, F.lit("/"), F.lpad(F.col("det_id").cast("string"), 10, "0"), F.lit(".png")).alias("file"),
                    name.alias("name"), F.col("l_suppkey").cast("string").alias("text"), F.when(F.col("l_linenumber") > 2, 0.15).alias("pad"))
    path = fresh_path(t.spark, "reader")
    D.write_reader_labels(d, path)
    # game 9 was built before reader crops existed
    wanted = t.spark.range(10).filter("id < 3 or id = 9").select(F.col("id").cast("string").alias("game"))
    return D.read_reader_labels(t.spark, path, wanted).select(F.col("game").cast("string").alias("game"), "file", "name", "text", "pad")


@query("s13_manifest", """
WITH g AS (SELECT DISTINCT game FROM docs)
SELECT 'new' AS dataset, 'hbb,obb' AS formats, game AS name, 'd_' || game AS dir, 'ai' AS kind, game IN ('src1', 'src4') AS is_val FROM g
UNION ALL SELECT 'old', NULL, game, game, 'manual', game = 'src2' FROM g
""")
def s13(t):
    g = t.docs.select(F.col("game").alias("name")).distinct()
    rows = g.select("name", F.concat(F.lit("d_"), "name").alias("dir"), F.lit("ai").alias("kind"), F.concat("name", F.lit(".jsonl")).alias("capture"), F.col("name").alias("frames_dir"))
    root = fresh_path(t.spark, "manifest")
    D.write_manifest(rows, ["src1", "src4"], ["hbb", "obb"], root + "/new")
    # an older manifest names a single holdout game
    old = g.agg(F.array_sort(F.collect_list(F.struct("name", F.col("name").alias("dir"), F.lit("manual").alias("kind")))).alias("games"))
    old.select(F.to_json(F.struct(F.lit("src2").alias("val"), "games")).alias("value")).write.text(root + "/old")
    d = D.read_manifest(t.spark, root + "/new").unionByName(D.read_manifest(t.spark, root + "/old"))
    return d.select(F.regexp_extract("dataset", "/(new|old)/", 1).alias("dataset"), F.array_join("formats", ",").alias("formats"), "name", "dir", "kind", "is_val")


@query("s14_split_lists", """
SELECT CASE WHEN quality = 1 THEN 'train' ELSE 'val' END AS split, game || '/images/' || key || '.png' AS path FROM docs
""")
def s14(t):
    d = t.docs.select(F.when(F.col("quality") == 1, "train").otherwise("val").alias("split"), F.concat("game", F.lit("/images/"), F.col("key").cast("string"), F.lit(".png")).alias("path"))
    path = fresh_path(t.spark, "split")
    D.write_split_lists(d, path)
    return D.read_split_lists(t.spark, path)


@query("s15_assemble_records", """
SELECT conv_id AS game, turn // 2 AS seq, string_agg(role || ':' || turn, ',' ORDER BY turn) AS events, arg_min(role, turn) AS method, arg_min(length(text), turn) AS size FROM conversations GROUP BY ALL
""")
def s15(t):
    c = t.raw("conversations").select(F.col("conv_id").alias("game"), F.expr("turn div 2").alias("seq"), "turn", F.array(F.concat("role", F.lit(":"), F.col("turn").cast("string"))).alias("events"),
                                      F.col("role").alias("method"), F.length("text").cast("long").alias("size"))
    d = K.assemble_records(c, ["game", "seq"], "turn", "events", ["method", "size"])
    return d.select("game", "seq", F.array_join("mjai", ",").alias("events"), "method", "size")


@query("s16_review_export", """
SELECT game || '__' || key AS name, CASE WHEN n_chars % 3 = 0 THEN '' ELSE 'cls ' || cls END AS text, n_chars % 3 = 0 AS no_label FROM docs
""")
def s16(t):
    img = t.docs.select("game", F.col("key").cast("string").alias("stem"))
    lab = t.docs.filter(F.col("n_chars") % 3 != 0).select("game", F.col("key").cast("string").alias("stem"), F.concat(F.lit("cls "), "cls").alias("text"))
    return K.review_export(img, lab)


CTE["fixd"] = """
SELECT CASE WHEN key % 11 = 0 THEN 'loose' || key ELSE game || '__' || key END AS name, key, game, CASE WHEN key % 2 = 0 THEN cls ELSE cls || '!' END AS text, key % 5 > 0 AS known, key % 11 = 0 AS loose, cls FROM docs
"""


def _review(t):
    key = F.col("key")
    stem = key.cast("string")
    fixed = t.docs.select(F.when(key % 11 == 0, F.concat(F.lit("loose"), stem)).otherwise(F.concat("game", F.lit("__"), stem)).alias("name"),
                          F.when(key % 2 == 0, F.col("cls")).otherwise(F.concat("cls", F.lit("!"))).alias("text"))
    now = t.docs.filter(key % 5 > 0).select("game", stem.alias("stem"), F.col("cls").alias("text"))
    return fixed, now


@query("s17_label_import", """
SELECT 'plan' AS what, name AS id, CASE WHEN loose THEN 'unmatched' WHEN NOT known THEN 'skip' WHEN text = cls THEN 'unchanged' ELSE 'update' END AS val FROM fixd
UNION ALL SELECT 'after', game || '/' || key, CASE WHEN loose THEN cls ELSE text END FROM fixd WHERE known OR NOT loose
""")
def s17(t):
    fixed, now = _review(t)
    plan = K.classify_import(fixed, now).select(F.lit("plan").alias("what"), F.col("name").alias("id"), F.col("action").alias("val"))
    after = K.apply_import(now, K.classify_import(fixed, now, allow_new=True))
    return plan.unionByName(after.select(F.lit("after").alias("what"), F.concat("game", F.lit("/"), "stem").alias("id"), F.col("text").alias("val")))


@query("s18_export_clean", """
SELECT key, CASE WHEN quality IS NULL THEN 'train' WHEN quality = 1 THEN 'train' ELSE 'val' END AS split FROM docs WHERE NOT coalesce(toxic = 1 OR n_chars % 7 = 0, n_chars % 7 = 0)
""")
def s18(t):
    tag = F.array_compact(F.array(F.when(F.col("toxic") == 1, "reject"), F.when(F.col("n_chars") % 7 == 0, "reject"), F.lit("seen")))
    d = t.docs.select("key", F.when(F.col("quality") == 1, "train").when(F.col("quality") == 0, "val").alias("split"), tag.alias("tags"))
    return K.export_clean(d, "reject").select("key", "split")
