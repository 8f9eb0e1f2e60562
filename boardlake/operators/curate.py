"""Building, splitting, purging and reviewing datasets
(S3, S5, S7, S9, S10, S12-S18, J2, J7-J9, J15-J17, J20, A3, A4, K4, K5, P19, U1, U2, U4-U6)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions.num import ratio, seeded_hash
from ..functions.text import frames_dir, game_name
from ..functions.tiles import lit_array
from ..session import stage
from .ordered import numbered, seq_chunk

# --- frames and listings ----------------------------------------------------------------


def load_frames(rows: DataFrame, statuses: list[str]) -> DataFrame:
    """S3: file of each frame with a wanted status; a later row of the same seq wins.

    Input: ``game, line_no, seq, step, file, status``; older indexes name the seq ``step``.
    """
    d = rows.filter(F.col("status").isin(statuses) & F.coalesce(F.col("file") != "", F.lit(False)))
    return d.groupBy("game", F.coalesce("seq", "step").alias("seq")).agg(F.max_by("file", "line_no").alias("file"))


def discover_games(listing: DataFrame, *roots: str) -> DataFrame:
    """Captures below the source roots, from a listing of (path, size).

    A capture inside a folder of its own name wins over its older sibling form; captures whose
    frame index exists but is empty are left out. A name found twice, in one root or in two, is an
    error, and so is a root without any game.
    """
    bases = [r.rstrip("/") + "/" for r in roots]
    root = F.coalesce(*[F.when(F.col("path").startswith(b), b) for b in bases])
    d = listing.withColumn("_root", root).filter(F.col("_root").isNotNull()).withColumn("_rel", F.expr("substring(path, length(_root) + 1)"))
    nested = F.col("_rel").rlike(r"^run_[^/]*/(game[^/]*)/\1\.jsonl$") | F.col("_rel").rlike(r"^(run_[^/]*)/\1\.jsonl$")
    sibling = F.col("_rel").rlike(r"^run_[^/]*/game[^/]*\.jsonl$") | F.col("_rel").rlike(r"^run_[^/]*\.jsonl$")
    manual = F.col("_rel").rlike(r"^session[^/]*\.jsonl$")
    caps = d.filter(nested | sibling | manual).select(F.col("path").alias("capture"), nested.alias("nested"), manual.alias("manual"), "_root")
    twin = F.concat(F.regexp_replace("capture", r"\.jsonl$", "/"), F.element_at(F.split("capture", "/"), -1))
    have = d.select(F.col("path").alias("_twin"))
    old = caps.filter(~F.col("nested")).withColumn("_twin", twin)
    old = old.filter("manual").unionByName(old.filter("not manual").join(have, "_twin", "left_anti").select(*old.columns))
    games = caps.filter("nested").unionByName(old.drop("_twin"))
    games = games.withColumns({"name": game_name(F.col("capture")), "frames_dir": frames_dir(F.col("capture"))})
    empty = d.filter((F.col("size") == 0) & F.col("path").endswith("/frames.jsonl")).select(F.regexp_replace("path", "/frames.jsonl$", "").alias("frames_dir"))
    games = games.join(empty, "frames_dir", "left_anti")
    twice = games.groupBy("name").agg(F.min("capture").alias("_a"), F.max("capture").alias("_b"), F.count(F.lit(1)).alias("_n"))
    stop = F.raise_error(F.concat(F.lit("duplicate game name "), F.col("name"), F.lit(" from "), F.col("_a"), F.lit(" and "), F.col("_b")))
    out = games.join(twice, "name").select(
        F.when(F.col("_n") > 1, stop).otherwise(F.col("name")).alias("name"), F.col("name").alias("dir"),
        F.when(F.col("manual"), "manual").otherwise("ai").alias("kind"), "capture", "frames_dir")
    asked = listing.sparkSession.createDataFrame([(b,) for b in bases], "_root string")
    bare = asked.join(games.select("_root").distinct(), "_root", "left_anti")
    none = F.raise_error(F.concat(F.lit("no games below "), F.col("_root"))).cast("string")
    return out.unionByName(bare.select(none.alias("name"), *[F.lit(None).cast("string").alias(c) for c in ("dir", "kind", "capture", "frames_dir")]))


def resolve_paths(files: DataFrame, listing: DataFrame, roots: list[str]) -> DataFrame:
    """First existing candidate of each index entry, else the entry itself.

    Input: ``id, file, index_dir``; ``roots`` are the captures folders, the last one being the
    one that moved files are looked up in.
    """
    f, base = F.col("file"), F.element_at(F.split("file", "/"), -1)
    absolute = f.startswith("/")
    moved = F.regexp_extract(f, r"^(?:.*/)?captures/(.*)$", 1)
    under = lambda d, p: F.when(p.startswith("/"), p).otherwise(F.concat(d, F.lit("/"), p))
    cands = [F.when(absolute, f), under(F.col("index_dir"), f)]
    cands += [under(F.lit(r), f) for r in roots]
    cands += [F.when(absolute & (moved != ""), F.concat(F.lit(roots[-1] + "/"), moved)),
              F.concat("index_dir", F.lit("/"), base), F.concat("index_dir", F.lit("/frames/"), base)]
    d = files.select("id", "file", F.posexplode(F.array(*cands)).alias("_rank", "path")).filter(F.col("path").isNotNull())
    hit = d.join(listing.select("path"), "path", "left_semi").groupBy("id").agg(F.min_by("path", "_rank").alias("path"))
    return files.join(hit, "id", "left").withColumn("path", F.coalesce("path", "file"))


def duplicate_names(rows: DataFrame, name: str, origin: str) -> DataFrame:
    """Names that occur more than once, with how often, and every origin in a row of its own."""
    d = rows.groupBy(name).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return rows.join(d, name).select(name, "n", F.col(origin).alias("origin"))


def union_sources(sources: list[DataFrame]) -> DataFrame:
    """Rows of several sources with their position."""
    return reduce(DataFrame.unionByName, [s.withColumn("ord", F.lit(i)) for i, s in enumerate(sources)])


def later_wins(rows: DataFrame, name: str, order: str = "ord") -> DataFrame:
    """One row per name, from the last source that has it."""
    cols = [c for c in rows.columns if c != name]
    d = rows.groupBy(name).agg(F.max_by(F.struct(*cols), order).alias("_r"))
    return d.select(name, "_r.*")


def covered(changing: DataFrame, saved: DataFrame, keys: list[str]) -> DataFrame:
    """Board changes that have a saved frame."""
    return changing.select(*keys).intersect(saved.select(*keys))


def annotation_frames(annotations: DataFrame, frames: DataFrame, states: DataFrame) -> DataFrame:
    """Annotation records that have a frame, with the replayed state if there is one."""
    keys = ["game", "seq"]
    return annotations.join(frames, keys).join(states, keys, "left")


# --- label text -------------------------------------------------------------------------


def _six(c: Column) -> Column:
    return F.format_string("%.6f", F.bround(c, 6))


def hbb_line(cls: Column, x0: Column, y0: Column, x1: Column, y1: Column, w: Column, h: Column) -> Column:
    """Five-field row: class, centre and size."""
    return F.concat_ws(" ", cls.cast("string"), _six((x0 + x1) / 2 / w), _six((y0 + y1) / 2 / h), _six((x1 - x0) / w), _six((y1 - y0) / h))


def obb_line(cls: Column, quad: Column, w: Column, h: Column) -> Column:
    """Nine-field row: class and the four corners in order, clipped to the picture."""
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    pts = F.transform(quad, lambda p: F.concat_ws(" ", _six(clip(p["x"] / w)), _six(clip(p["y"] / h))))
    return F.concat(cls.cast("string"), F.lit(" "), F.array_join(pts, " "))


def label_files(lines: DataFrame, keys: list[str], order: str | list[str], line: dict[str, str] | None = None) -> DataFrame:
    """Text of one label file per frame, rows in order; ``line`` maps line columns to text columns.

    Rows that ``order`` leaves equal are ordered by their lines; name more columns, as the row's place in its table, to order them otherwise.
    """
    line = line or {"line": "text"}
    order = [order] if isinstance(order, str) else list(order)
    d = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, *line))).alias("_l"))
    text = lambda c: F.concat(F.array_join(F.transform("_l", lambda x: x[c]), "\n"), F.lit("\n"))
    return d.select(*keys, *[text(c).alias(t) for c, t in line.items()])


def parse_labels(files: DataFrame, keep: list[str]) -> DataFrame:
    """Boxes of label files; nine fields are a quad, otherwise five fields are centre and size.

    Adds ``fmt``, ``cls`` and either ``quad`` or the top-left box ``x, y, w, h``.
    """
    line = F.explode(F.filter(F.split("text", "\n"), lambda s: F.trim(s) != ""))
    d = files.select(*keep, line.alias("_line")).withColumn("_f", F.split(F.trim("_line"), r"\s+"))
    num = lambda i: F.get("_f", F.lit(i)).try_cast("double")
    is_quad = F.size("_f") == 9
    quad = F.array(*[F.struct(num(i).alias("x"), num(i + 1).alias("y")) for i in (1, 3, 5, 7)])
    box = lambda c: F.when(~is_quad, c)
    return d.select(*keep, F.when(is_quad, "obb").otherwise("hbb").alias("fmt"), F.get("_f", F.lit(0)).try_cast("int").alias("cls"), F.when(is_quad, quad).alias("quad"),
                    box(num(1) - num(3) / 2).alias("x"), box(num(2) - num(4) / 2).alias("y"), box(num(3)).alias("w"), box(num(4)).alias("h"))


# --- records ----------------------------------------------------------------------------


def assemble_records(messages: DataFrame, keys: list[str], order: str, events: str, meta: list[str]) -> DataFrame:
    """Messages of one seq become one record; events in order, the first message's fields win.

    Input: ``events`` is an array column.
    """
    d = messages.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(events).alias("e")))).alias("_m"),
        F.min_by(F.struct(*meta), order).alias("_first"))
    return d.select(*keys, F.flatten(F.transform("_m", lambda m: m["e"])).alias("mjai"), "_first.*")


# --- review round trip ------------------------------------------------------------------


def review_export(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Flat review package: ``<game>__<stem>`` with the label text, empty if there is none."""
    d = images.join(labels.select("game", "stem", "text"), ["game", "stem"], "left")
    return d.select(F.concat("game", F.lit("__"), "stem").alias("name"), F.coalesce("text", F.lit("")).alias("text"), F.col("text").isNull().alias("no_label"))


def classify_import(corrected: DataFrame, current: DataFrame, allow_new: bool = False) -> DataFrame:
    """What a corrected label does to the dataset: unmatched, skip, unchanged, update or create.

    Input: ``corrected(name, text)`` and ``current(game, stem, text)``.
    """
    cut = F.instr("name", "__")
    d = corrected.withColumns({"game": F.when(cut > 0, F.expr("substring(name, 1, instr(name, '__') - 1)")),
                               "stem": F.when(cut > 0, F.expr("substring(name, instr(name, '__') + 2)"))})
    d = d.join(current.select("game", "stem", F.col("text").alias("_old")), ["game", "stem"], "left")
    new = F.col("_old").isNull()
    action = F.when(F.col("game").isNull(), "unmatched").when(new & F.lit(not allow_new), "skip").when(new, "create") \
        .when(F.col("_old") == F.col("text"), "unchanged").otherwise("update")
    return d.withColumn("action", action)


def apply_import(current: DataFrame, classified: DataFrame) -> DataFrame:
    """The dataset's labels after the import; running it twice changes nothing."""
    new = classified.filter(F.col("action").isin("update", "create")).select("game", "stem", "text")
    return later_wins(union_sources([current.select("game", "stem", "text").withColumn("_k", F.struct("game", "stem")),
                                     new.withColumn("_k", F.struct("game", "stem"))]), "_k").select("game", "stem", "text")


def export_clean(samples: DataFrame, reject: str) -> DataFrame:
    """Samples without the reject tag; samples of no split go to train."""
    return samples.filter(~F.array_contains("tags", reject)).withColumn("split", F.coalesce("split", F.lit("train")))


# --- splits -----------------------------------------------------------------------------


def split_rows(images: DataFrame, specs: DataFrame) -> DataFrame:
    """Whole-game or whole-round holdout; a game without a spec trains.

    Input: ``specs(name, whole, keys)`` as from P17, one row per name.
    """
    d = images.join(specs, images["game"] == specs["name"], "left").drop("name")
    held = F.coalesce(F.col("whole") | F.array_contains("keys", F.col("round_key")), F.lit(False))
    return d.withColumn("split", F.when(held, "val").otherwise("train")).drop("whole", "keys")


def holdout_leaks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Groups that occur in both splits; must be empty."""
    a = rows.filter(F.col("split") == "train").select(*keys)
    return a.intersect(rows.filter(F.col("split") == "val").select(*keys))


def missing_holdouts(requested: list[str], games: DataFrame, default: str) -> DataFrame:
    """Requested holdout games that do not exist; an empty request means the default if it exists."""
    spark = games.sparkSession
    names = requested or [default]
    want = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "ord int, name string")
    return want.join(games.select("name"), "name", "left_anti")


# --- purge ------------------------------------------------------------------------------


def purge(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows whose (game, seq) is not on the purge list."""
    return rows.join(manifest.select("game", "seq"), ["game", "seq"], "left_anti")


def purge_preview(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """How many rows of each kind the purge would take."""
    return rows.join(manifest.select("game", "seq"), ["game", "seq"], "left_semi").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def existing_only(lines: DataFrame, listing: DataFrame) -> DataFrame:
    """List rows whose file exists."""
    return lines.join(listing.select("path"), "path", "left_semi")


def align_crops(crops: DataFrame, labels: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Crops and label rows that survive an occlusion purge.

    Input: ``crops(game, seq, crop_idx, cls, bad)``, ``labels(game, seq, line_no, cls)`` with
    0-based line numbers, ``decisions(game, seq, decision)``; crops may carry ``line_no``, their place in
    the frame by ``crop_idx``, else they are numbered here.  A frame to drop loses everything.
    Otherwise its bad crops go; if crops and rows agree in number and class order the matching
    rows go too, else all its rows go and its good crops stay.
    """
    k = ["game", "seq"]
    if "line_no" in crops.columns:
        c = crops
    else:
        c = numbered(crops, k, ["crop_idx"], seq_chunk("crop_idx", 1024), "_no").withColumn("line_no", F.col("_no") - 1).drop("_no")
        c = stage(c, "numbered-crops")  # read three times
    pair = c.select(*k, "line_no", F.col("cls").alias("_c")).join(labels.select(*k, "line_no", F.col("cls").alias("_l")), k + ["line_no"], "full_outer")
    same = pair.groupBy(*k).agg(F.bool_and(F.coalesce(F.col("_c") == F.col("_l"), F.lit(False))).alias("_aligned"))
    d = decisions.join(same, k, "left")
    c = c.join(d, k, "left")
    what = F.coalesce("decision", F.lit("keep"))
    kept_crops = c.filter((what == "keep") | ((what == "drop_boxes") & ~F.col("bad"))).select(*crops.columns)
    lab = labels.join(d, k, "left").join(c.filter("bad").select(*k, "line_no", F.lit(True).alias("_bad")), k + ["line_no"], "left")
    gone = (what == "drop_boxes") & F.col("_aligned") & ~F.coalesce("_bad", F.lit(False))
    return kept_crops, lab.filter((what == "keep") | F.coalesce(gone, F.lit(False))).select(*labels.columns)


# --- pairing ----------------------------------------------------------------------------


def pair_by_position(expected: DataFrame, found: DataFrame, keys: list[str], x: str, tie: str, chunk: Column) -> DataFrame:
    """Expected labels, left to right, with the candidates found from left to right.

    ``expected`` has the array ``labels``.  If the counts differ every label of the frame is
    unreliable and keeps whatever candidate stands at its place.
    """
    e = expected.withColumn("_ne", F.size("labels")).select(*keys, "_ne", F.posexplode("labels").alias("pos", "label"))
    n = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nf"))
    f = numbered(found, keys, [x, tie], chunk, "_no").withColumn("pos", (F.col("_no") - 1).cast("int")).drop("_no")
    d = e.join(n, keys, "left").join(f, keys + ["pos"], "left")
    ok = F.col("_ne") == F.coalesce("_nf", F.lit(0))
    return d.withColumns({"reliable": ok, "flag": F.when(~ok, "count_mismatch")}).drop("_ne", "_nf")


# --- statistics of a dataset ------------------------------------------------------------


def class_coverage(boxes: DataFrame, names: list[str], least: int) -> DataFrame:
    """A3: boxes and boxes with the attribute per class and split, and over all splits.

    Classes without boxes show as zero.  Input: ``split, name, attr``.  A null split is the total.
    """
    counts = boxes.groupingSets([(F.col("split"), F.col("name")), (F.col("name"),)], "split", "name").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("attr")).alias("with_attr"), F.grouping("split").alias("is_total"))
    splits = boxes.select("split").distinct().select("split", F.lit(0).alias("is_total"))
    total = boxes.agg(F.max(F.lit(None).cast("string")).alias("split")).select("split", F.lit(1).alias("is_total"))
    grid = splits.unionByName(total).withColumn("name", F.explode(lit_array(names)))
    same = [grid["split"].eqNullSafe(counts["split"]), grid["is_total"] == counts["is_total"], grid["name"] == counts["name"]]
    d = grid.join(counts, reduce(lambda a, b: a & b, same), "left").select(
        grid["split"], grid["is_total"], grid["name"], F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("with_attr", F.lit(0)).alias("with_attr"))
    return d.withColumns({"share": F.coalesce(ratio(100 * F.col("with_attr"), F.col("total")), F.lit(0.0)), "starved": F.col("with_attr") < least})


def annotation_summary(boxes: DataFrame, zones: list[str]) -> DataFrame:
    """A4: boxes, reliable boxes and unrendered boxes per game and zone, one row per game."""
    d = boxes.groupBy("game").pivot("zone", zones).agg(
        F.count(F.lit(1)).alias("boxes"), F.count_if(F.col("reliable")).alias("ok"), F.count_if(F.col("unrendered")).alias("unrendered"))
    return d.na.fill(0)


def write_summary(summary: DataFrame, path: str) -> None:
    """A4: write per-game summaries; games written again replace their old row, others stay."""
    summary.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("game").parquet(path)


def seeded_order(rows: DataFrame, key: list[str], seed: int, at_most: int | None = None) -> DataFrame:
    """K4: rows in an order fixed by the seed, or the first ``at_most`` of it."""
    d = rows.withColumn("_h", seeded_hash(seed, *[F.col(k) for k in key])).orderBy("_h", *key).drop("_h")
    return d if at_most is None else d.limit(at_most)


def diverse_frames(frames: DataFrame, signature: list[str], per_signature: int, total: int) -> DataFrame:
    """K5: frames for review: varied board shapes first, few per shape, from different games.

    Input: ``game, seq, interest`` and the signature columns. Shapes are visited by interest (then by
    signature); each takes the median frame of the ``per_signature`` games picked least so far
    (then by name), until ``total`` frames are picked. A frame has one shape, so none is picked twice.

    Every shape picks a frame at least, so no more than ``total`` shapes are visited; at most ``total``
    games are ever picked, so the games a shape takes are among its first ``total + per_signature``
    by name. These few rows are what the greedy walk needs, however many frames there are.
    """
    by = [*signature, "game"]
    shapes = frames.groupBy(*signature).agg(F.max("interest").alias("_interest")).orderBy(F.desc("_interest"), *signature).limit(total)
    same = reduce(lambda a, b: a & b, [F.col(f"f.{c}").eqNullSafe(F.col(f"s.{c}")) for c in signature])
    ranked = numbered(frames.select(*by, "seq", "interest"), by, ["seq"], seq_chunk(), "_no", "_n")
    mid = ranked.filter(F.col("_no") - 1 == F.floor(F.col("_n") / 2))
    mid = mid.alias("f").join(shapes.alias("s"), same, "inner").select("f.*", "s._interest")
    near = F.row_number().over(Window.partitionBy(*signature).orderBy("game"))
    mid = mid.withColumn("_r", near).filter(F.col("_r") <= total + per_signature)
    offer = F.struct("game", "seq", *signature, "interest")
    shape = mid.groupBy("_interest", *signature).agg(F.collect_list(offer).alias("_offers"))
    walk = shape.agg(F.array_sort(F.collect_list(F.struct((-F.col("_interest")).alias("_first"), *signature, "_offers"))).alias("_shapes"))

    def take(picks: Column, visited: Column) -> Column:
        used = lambda game: F.size(F.filter(picks, lambda p: p["game"] == game))
        order = F.array_sort(F.transform(visited["_offers"], lambda o: F.struct(used(o["game"]).alias("used"), o["game"].alias("game"), o.alias("o"))))
        best = F.transform(F.slice(order, 1, per_signature), lambda o, i: F.struct(o["o"].alias("o"), (i + 1).alias("rank"), o["game"].alias("game")))
        return F.slice(F.concat(picks, best), 1, total)

    none = F.expr("CAST(NULL AS INT)")
    empty = F.slice(F.array(F.struct(F.element_at(F.element_at("_shapes", 1)["_offers"], 1).alias("o"), none.alias("rank"),
                                     F.element_at(F.element_at("_shapes", 1)["_offers"], 1)["game"].alias("game"))), 1, 0)
    return walk.filter(F.size("_shapes") > 0).select(F.explode(F.aggregate("_shapes", empty, take)).alias("_p")).select("_p.o.*", "_p.rank")


def resume_work(found: DataFrame, problems: DataFrame, old: DataFrame) -> DataFrame:
    """U4: games still to build: not built yet or built with a problem; known games keep their folder.

    Input: ``found(name, dir)``, ``problems(game, problem)`` for built games, ``old(name, dir)``.
    """
    done = problems.filter(F.col("problem").isNull()).select(F.col("game").alias("name"))
    d = found.join(done, "name", "left_anti").join(old.select("name", F.col("dir").alias("_d")), "name", "left")
    return d.withColumn("dir", F.coalesce("_d", "dir")).drop("_d")


# --- P19 --------------------------------------------------------------------------------


def seat_metadata(games: DataFrame) -> DataFrame:
    """Characters of every seat, and the table items of the hero only if the hero is found.

    Input: ``game, hero, players, robots`` with account, character and view structs.
    """
    def seat(p: Column, robot: bool) -> Column:
        return F.struct(F.coalesce(p["account"], F.lit(0)).alias("account"), F.coalesce(p["charid"], F.lit(0)).alias("charid"),
                        F.coalesce(p["skin"], F.lit(0)).alias("skin"), F.lit(robot).alias("robot"))

    seats = F.concat(F.transform("players", lambda p: seat(p, False)), F.transform("robots", lambda p: seat(p, True)))
    me = F.get(F.filter("players", lambda p: p["account"] == F.col("hero")), F.lit(0))
    items = F.filter(F.coalesce(me["views"], F.array().cast("array<struct<slot: int, item: int>>")), lambda v: v["slot"].isNotNull())
    # a slot named twice keeps its last item
    last = F.filter(items, lambda v, i: ~F.exists(F.slice(items, i + 2, F.size(items)), lambda z: z["slot"] == v["slot"]))
    table = F.map_from_entries(F.transform(last, lambda v: F.struct(v["slot"].cast("string").alias("key"), F.coalesce(v["item"], F.lit(0)).alias("value"))))
    return games.select("game", seats.alias("characters"), table.alias("table"), F.when(me.isNotNull(), F.col("hero")).alias("hero_account"))
