"""Queries that read the board of every record: G1's state in batch, and F6, F7, P20, M9 on it."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..functions.sqltext import sql_list
from ..operators import board as B
from ..operators import layout as L
from .proxies import CTE
from .q_sequences import RW
from .registry import query

HO = sql_list(dims.HAND_ORDER)

CTE["bvis"] = """
SELECT e.game, e.seq, d.rseat AS s, d.pai, d.k % 2 = 0 AS tsumogiri, f.riichi, d.seq AS dseq
FROM rnd e JOIN riv d ON e.game = d.game AND e.kyoku_ord = d.kyoku_ord AND d.type = 'dahai' AND d.seq <= e.seq AND (d.called_seq IS NULL OR d.called_seq > e.seq)
JOIN rdis f ON f.game = d.game AND f.seq = d.seq
"""
CTE["bside"] = """
SELECT v.game, v.seq, v.s, min(v.dseq) AS dseq FROM bvis v
JOIN (SELECT e.game, e.seq, f.actor AS s, min(f.seq) AS since FROM rnd e JOIN rdis f ON e.game = f.game AND e.kyoku_ord = f.kyoku_ord AND f.riichi AND f.seq <= e.seq GROUP BY 1, 2, 3) r
  ON r.game = v.game AND r.seq = v.seq AND r.s = v.s AND v.dseq >= r.since GROUP BY 1, 2, 3
"""
CTE["bset"] = f"""
SELECT m.game, m.kyoku_ord, m.actor AS s, m.seq, m.type, coalesce(p.seq, m.seq) AS place, u.seq AS till, CASE WHEN m.type = 'kakan' THEN m.pai ELSE '' END AS added,
  CASE WHEN m.type IN ('chi', 'pon', 'daiminkan') THEN m.pai WHEN p.seq IS NOT NULL THEN p.pai ELSE '' END AS called,
  CASE WHEN m.type IN ('chi', 'pon', 'daiminkan') THEN m.target WHEN p.seq IS NOT NULL THEN p.target ELSE m.actor END AS src,
  CASE WHEN m.type IN ('chi', 'pon') THEN [m.pai, m.pai, m.pai] WHEN m.type IN ('daiminkan', 'ankan') THEN [m.pai, m.pai, m.pai, m.pai] WHEN p.seq IS NULL THEN [m.pai, m.pai, m.pai]
    WHEN list_position({HO}, p.pai) <= list_position({HO}, m.pai) THEN [p.pai, p.pai, p.pai, m.pai] ELSE [m.pai, p.pai, p.pai, p.pai] END AS tiles
FROM rnd m LEFT JOIN kan k ON m.type = 'kakan' AND k.game = m.game AND k.seq = m.seq LEFT JOIN rnd p ON p.game = m.game AND p.seq = k.pon_seq
LEFT JOIN kan u ON m.type = 'pon' AND u.game = m.game AND u.pon_seq = m.seq WHERE m.type IN ('chi', 'pon', 'daiminkan', 'ankan', 'kakan')
"""
CTE["bopen"] = """
SELECT e.game, e.seq, b.s, b.type, b.tiles, b.called, b.added, b.src, b.place
FROM rnd e JOIN bset b ON e.game = b.game AND e.kyoku_ord = b.kyoku_ord AND b.seq <= e.seq AND (b.till IS NULL OR b.till > e.seq)
"""
CTE["bhand"] = f"""
SELECT r.game, r.seq, r.kyoku_ord, coalesce(last_value(h.hand IGNORE NULLS) {RW.replace('game', 'r.game').replace('kyoku_ord', 'r.kyoku_ord').replace('ORDER BY seq', 'ORDER BY r.seq')}, '') AS hand
FROM rnd r LEFT JOIN hands h ON r.game = h.game AND r.seq = h.seq
"""


def _seats(expr: str) -> str:
    return ", ".join(expr.format(s=s) for s in range(4))


def _states(t):
    return B.board_states(t.mj, F.lit(0))


@query("g1_board_states", f"""
WITH riv_text AS (SELECT v.game, v.seq, v.s, string_agg(v.pai || CASE WHEN tsumogiri THEN '*' ELSE '' END || CASE WHEN riichi THEN '!' ELSE '' END || CASE WHEN w.dseq = v.dseq THEN '-' ELSE '' END, ' ' ORDER BY v.dseq) AS x
  FROM bvis v LEFT JOIN bside w ON v.game = w.game AND v.seq = w.seq AND v.s = w.s GROUP BY 1, 2, 3),
set_text AS (SELECT game, seq, s, string_agg(type || ':' || array_to_string(tiles, ',') || ':' || called || ':' || added || ':' || src, ' ' ORDER BY place) AS x FROM bopen GROUP BY 1, 2, 3),
scal AS (SELECT r.game, r.seq, r.kyoku_ord, r.kyoku_ord > 0 AS open, coalesce(last_value(CASE WHEN r.type IN ('tsumo', 'dahai', 'chi', 'pon', 'daiminkan', 'ankan', 'kakan', 'nukidora') THEN r.actor END IGNORE NULLS) {RW}, -1) AS last_actor,
    last_value(CASE WHEN NOT is_start THEN left_count END IGNORE NULLS) {RW} AS left_tiles, coalesce(string_agg(CASE WHEN is_start OR type = 'dora' THEN pai END, ',') {RW}, '') AS dora FROM rnd r)
SELECT c.game, c.seq, c.kyoku_ord, c.open, CAST(c.last_actor AS INTEGER) AS last_actor, c.left_tiles, c.dora, h.hand, CAST(o.owed AS INTEGER) AS owed,
  {_seats("coalesce(r{s}.x, '') AS river_{s}, coalesce(m{s}.x, '') AS melds_{s}")}
FROM scal c JOIN bhand h ON h.game = c.game AND h.seq = c.seq JOIN owe o ON o.game = c.game AND o.seq = c.seq
{' '.join(f"LEFT JOIN riv_text r{s} ON r{s}.game = c.game AND r{s}.seq = c.seq AND r{s}.s = {s} LEFT JOIN set_text m{s} ON m{s}.game = c.game AND m{s}.seq = c.seq AND m{s}.s = {s}" for s in range(4))}
""")
def g1_board(t):
    return texts(_states(t))


def texts(states):
    """Boards with their lists written out."""
    mark = lambda c, m: F.when(c, m).otherwise("")
    river = lambda s: F.array_join(F.transform(F.get("rivers", F.lit(s)), lambda x: F.concat(
        x["pai"], mark(x["tsumogiri"], "*"), mark(x["riichi"], "!"), mark(x["sideways"], "-"))), " ")
    melds = lambda s: F.array_join(F.transform(F.get("melds", F.lit(s)), lambda m: F.concat_ws(
        ":", m["type"], F.array_join(m["tiles"], ","), m["called"], m["added"], m["from_seat"].cast("string"))), " ")
    return states.select("game", "seq", "kyoku_ord", "open", "last_actor", "left_tiles", F.array_join("dora", ",").alias("dora"), F.array_join("hand", " ").alias("hand"), "owed",
                             *[f(s).alias(f"{n}_{s}") for s in range(4) for n, f in (("river", river), ("melds", melds))])


@query("f6_board_invariants", f"""
WITH tiles AS (SELECT game, seq, pai AS x FROM bvis UNION ALL SELECT game, seq, unnest(tiles) FROM bopen
  UNION ALL SELECT game, seq, unnest(string_split(hand, ' ')) FROM bhand WHERE hand <> ''
  UNION ALL SELECT e.game, e.seq, d.pai FROM rnd e JOIN rnd d ON e.game = d.game AND e.kyoku_ord = d.kyoku_ord AND d.seq <= e.seq AND (d.is_start OR d.type = 'dora')),
n AS (SELECT h.game, h.seq, CASE WHEN h.hand = '' THEN 0 ELSE len(string_split(h.hand, ' ')) END AS n_hand, (SELECT count(*) FROM bopen b WHERE b.game = h.game AND b.seq = h.seq AND b.s = 0) AS n_sets FROM bhand h),
conc AS (SELECT game, seq, {_seats("CAST(sum(CASE WHEN is_start THEN 13 WHEN actor <> {s} THEN 0 WHEN type = 'tsumo' THEN 1 WHEN type = 'dahai' THEN -1 WHEN type IN ('chi', 'pon', 'daiminkan', 'ankan') THEN -n_consumed WHEN type IN ('kakan', 'nukidora') THEN -1 ELSE 0 END) " + RW + " AS BIGINT) + CASE WHEN kyoku_ord = 0 THEN 13 ELSE 0 END AS c{s}")} FROM rnd)
SELECT game, seq, 'tile ' || b || ' seen ' || count(*) || '>4 times across visible zones' AS message FROM (SELECT game, seq, CASE WHEN x LIKE '5_r' THEN left(x, 2) ELSE x END AS b FROM tiles) GROUP BY game, seq, b HAVING count(*) > 4
UNION ALL SELECT game, seq, 'hero hand ' || n_hand || ' + 3*' || n_sets || ' melds = ' || (n_hand + 3 * n_sets) || ' not in 13/14' FROM n WHERE n_hand > 0 AND n_hand + 3 * n_sets NOT IN (13, 14)
{' '.join(f"UNION ALL SELECT game, seq, 'seat {s} concealed count ' || c{s} || ' < 0' FROM conc WHERE c{s} < 0" for s in range(4))}
""")
def f6_board(t):
    return B.violations(_states(t))


@query("p20_board_observed", """
WITH a AS (SELECT game, seq, unnest([0, 1, 2, 3]) AS rel FROM rnd)
SELECT a.game, a.seq, a.rel, coalesce(v.n, 0) AS n_river, v.sideways, coalesce(o.n, 0) AS n_sets, coalesce(o.rels, '') AS from_rels,
  (v.sideways IS NOT NULL OR EXISTS (SELECT 1 FROM rnd e JOIN rnd x ON e.game = x.game AND e.kyoku_ord = x.kyoku_ord AND x.seq <= e.seq AND x.type = 'reach_accepted' WHERE e.game = a.game AND e.seq = a.seq AND x.actor = a.rel)) AS reach
FROM a LEFT JOIN (SELECT v.game, v.seq, v.s, count(*) AS n, max(CASE WHEN w.dseq = v.dseq THEN v.pai END) AS sideways FROM bvis v LEFT JOIN bside w ON v.game = w.game AND v.seq = w.seq AND v.s = w.s GROUP BY 1, 2, 3) v
  ON v.game = a.game AND v.seq = a.seq AND v.s = a.rel
LEFT JOIN (SELECT game, seq, s, count(*) AS n, string_agg(CAST(((src - s) % 4 + 4) % 4 AS VARCHAR), ',' ORDER BY place) AS rels FROM bopen GROUP BY 1, 2, 3) o ON o.game = a.game AND o.seq = a.seq AND o.s = a.rel
""")
def p20_board(t):
    o = L.observed_row(_states(t)).select("game", "seq", F.posexplode(F.arrays_zip("o_rivers", "o_melds", "o_reach")).alias("rel", "z"))
    side = F.get(F.filter("z.o_rivers", lambda x: x["sideways"]), F.lit(0))["pai"]
    return o.select("game", "seq", "rel", F.size("z.o_rivers").cast("long").alias("n_river"), side.alias("sideways"), F.size("z.o_melds").cast("long").alias("n_sets"),
                    F.array_join(F.transform("z.o_melds", lambda m: m["from_rel"].cast("string")), ",").alias("from_rels"), F.col("z.o_reach").alias("reach"))
