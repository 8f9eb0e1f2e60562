"""Fixed values of the data model: taxonomy, event groups, screen geometry.

Everything here has to equal the values users already have in their labels, so it is stated
as plain constants and never computed from data.
"""

from __future__ import annotations

# Tile classes in class-id order.
TILES = [
    "1m", "2m", "3m", "4m", "5m", "6m", "7m", "8m", "9m",
    "1p", "2p", "3p", "4p", "5p", "6p", "7p", "8p", "9p",
    "1s", "2s", "3s", "4s", "5s", "6s", "7s", "8s", "9s",
    "E", "S", "W", "N", "P", "F", "C",
    "5mr", "5pr", "5sr", "back",
]
# HUD classes, ids continue after the tiles.
HUD = [
    "score_self", "score_right", "score_across", "score_left",
    "round_label", "wall_count", "seat_wind_self",
    "riichi_stick_count", "honba_count",
    "btn_chi", "btn_pon", "btn_kan", "btn_riichi", "btn_tsumo", "btn_ron", "btn_kyushu", "btn_skip",
    "reach_stick", "btn_babei",
]
CLASSES = TILES + HUD
RED_FIVES = ["5mr", "5pr", "5sr"]
WINDS = ["E", "S", "W", "N"]
DRAGONS = ["P", "F", "C"]

# Names that differ in event-log notation.
LOG_NOTATION = {
    "5mr": "0m", "5pr": "0p", "5sr": "0s",
    "E": "1z", "S": "2z", "W": "3z", "N": "4z", "P": "5z", "F": "6z", "C": "7z",
}

# Hand order on screen, a red five right before its plain five.
HAND_ORDER = [
    "1m", "2m", "3m", "4m", "5mr", "5m", "6m", "7m", "8m", "9m",
    "1p", "2p", "3p", "4p", "5pr", "5p", "6p", "7p", "8p", "9p",
    "1s", "2s", "3s", "4s", "5sr", "5s", "6s", "7s", "8s", "9s",
    "E", "S", "W", "N", "P", "F", "C", "?",
]

# Event groups.
BOARD_EVENTS = [
    "start_kyoku", "tsumo", "dahai", "chi", "pon", "daiminkan", "ankan", "kakan",
    "reach", "reach_accepted", "dora", "nukidora",
]
CALL_EVENTS = ["chi", "pon", "daiminkan", "ankan", "kakan", "nukidora"]
CLAIM_EVENTS = ["chi", "pon", "daiminkan"]
OWED_EVENTS = ["chi", "pon", "daiminkan", "ankan", "kakan"]
KAN_TYPES = ["daiminkan", "ankan", "kakan"]
REACH_EVENTS = ["reach", "reach_accepted"]

# Offered operation code -> button, and the buttons' order on screen.
OP_BUTTON = {
    2: "btn_chi", 3: "btn_pon", 4: "btn_kan", 5: "btn_kan", 6: "btn_kan",
    7: "btn_riichi", 8: "btn_tsumo", 9: "btn_ron", 10: "btn_kyushu", 11: "btn_babei",
}
BUTTON_ORDER = [
    "btn_babei", "btn_chi", "btn_pon", "btn_kan", "btn_riichi", "btn_tsumo", "btn_ron", "btn_kyushu",
]

SEAT_POS = ["self", "right", "across", "left"]
SCORE_FIELDS = ["score_self", "score_right", "score_across", "score_left"]
FIELD_ROTATION = {
    "score_self": 0, "score_across": 180, "score_left": 270, "score_right": 90,
    "round_label": 0, "wall_count": 0, "seat_wind_self": 0, "riichi_stick_count": 0, "honba_count": 0,
}
READER_CHARS = "0123456789-x余"  # class 0 of the reader is the blank

# Rejection categories, the first hit wins.
REJECT_CATEGORIES = [
    ("scores sum", "hud_scores"), ("kyotaku", "hud_kyotaku"), ("wall count", "hud_wall"),
    ("stray detection", "stray"), ("meld strip", "meld_parse"), ("river", "river_geometry"),
    (">4 times", "tile_gt4"), ("hero hand", "hand_size"), ("dora marker", "dora"),
    ("concealed", "concealed"),
]

# Display languages.
SERVER_LANGUAGE = {"jp": "ja", "en": "en", "cn": "zh-Hans"}
KNOWN_LANGUAGES = ["zh-Hans", "zh-Hant", "ja", "en", "ko"]
LANGUAGE_ALIASES = {
    "zh-Hans": ["chs", "zh-hans", "zh-cn", "zhs", "zh", "zh-chs", "hans"],
    "zh-Hant": ["chs-t", "cht", "zh-hant", "zh-tw", "zh-hk", "zht", "zh-cht", "hant"],
    "ja": ["jp", "ja", "ja-jp", "jpn"],
    "en": ["en", "en-us", "en-gb", "eng"],
    "ko": ["kr", "ko", "ko-kr", "kor"],
}

# Screen geometry at 1920x1080 (pixels) or normalised to the board.
REF_W, REF_H = 1920, 1080
DORA_STRIP = (0.015, 0.036, 0.1608, 0.111)
MAX_DORA = 5
HAND_X0, HAND_W = 223 / 1920, 95 / 1920
HAND_Y0, HAND_H = (1002 - 76) / 1080, 152 / 1080
HAND_GAP = 0.015
HAND_MIN_H, HAND_SLACK = 0.11, 0.02  # height from which a detection near the hand row is a hand tile
WIDE_CORNER = (0.35, 0.25)  # shares of a wide frame's width and height that hold its indicators
FIELD_BOX_PX = {
    "riichi_sticks": (110, 140, 140, 180), "honba": (250, 140, 280, 180),
    "round_wind": (920, 390, 950, 420), "round_number": (950, 390, 970, 420),
    "score_self": (915, 472, 1000, 492), "score_right": (863, 396, 888, 428),
    "score_across": (951, 355, 995, 373),
}
TABLE_CORNERS_PX = [(522.05, 120.00), (1398.17, 120.00), (1567.30, 848.00), (353.94, 848.00)]
TABLE_SIDE = 1280
WARP_PAD = 40
STABILITY_REGIONS = {
    "table": (0.18, 0.16, 0.82, 0.92), "across_row": (0.339, 0.0, 0.703, 0.088),
    "left_row": (0.091, 0.088, 0.208, 0.625), "right_row": (0.806, 0.163, 0.936, 0.745),
    "hero_row": (0.109, 0.855, 0.820, 1.0),
}
BANNER_W, BANNER_H, BANNER_DY = 250, 96, 10
PLATE_MIN_AREA = 5000
PLATE_W = (120, 300)
PLATE_H = (55, 130)

# River grid per screen position, (4 players, 3 players).
GRID_COLS = 6
RIVER_GRID = {
    "4p": {
        0: dict(o=(1346.9, 1240.4), dcol=(72.46, 0.0), drow=(0.0, 108.63), offs=(0.0, 96.4, 193.5)),
        1: dict(o=(1818.2, 767.1), dcol=(0.0, 74.88), drow=(97.43, 0.0), offs=(0.0, 97.6, 194.0)),
        2: dict(o=(1353.9, 683.0), dcol=(72.94, 0.0), drow=(0.0, -109.95), offs=(0.0, 104.9, 201.9)),
        3: dict(o=(1244.3, 764.3), dcol=(0.0, 74.74), drow=(-97.61, 0.0), offs=(0.0, 97.2, 194.8)),
    },
    "3p": {
        0: dict(o=(1347.9, 1241.0), dcol=(72.13, 0.0), drow=(0.0, 112.0), offs=(0.0, 96.2, 194.0)),
        1: dict(o=(1818.0, 772.1), dcol=(0.0, 72.72), drow=(97.95, 0.0), offs=(0.0, 95.6, 195.0)),
        2: dict(o=(1354.5, 675.9), dcol=(72.61, 0.0), drow=(0.0, -104.25), offs=(0.0, 96.3, 189.3)),
        3: dict(o=(1244.0, 768.3), dcol=(0.0, 72.77), drow=(-98.87, 0.0), offs=(0.0, 96.6, 193.2)),
    },
}
# Which end discard 0 sits at and the reading direction along columns.
RIVER_READ = {0: (False, 1), 1: (True, -1), 2: (True, -1), 3: (False, 1)}
RIVER_FOOT = {0: (70.2, 92.1), 1: (93.4, 70.5), 2: (70.4, 92.2), 3: (93.0, 71.0)}
FACE_INSET = 3.0
# Meld strip per screen position (corner, along, cross, tile width, tile depth).
# fixed values: how far a zone reaches, in columns of a river, and in widths and depths of a strip's tiles
RIVER_REACH = 10
STRIP_REACH = 16
STRIP_DEPTH = 2.2
STRIP = {
    "4p": {
        0: dict(corner=(2388.2, 1889.5), along=(-1.0, 0.0), cross=(0.0, -1.0), w=70.2, d=92.1),
        1: dict(corner=(2454.0, 153.0), along=(0.0, 1.0), cross=(-1.0, 0.0), w=70.5, d=93.4),
        2: dict(corner=(685.0, 135.0), along=(1.0, 0.0), cross=(0.0, 1.0), w=70.4, d=92.2),
        3: dict(corner=(624.5, 1752.1), along=(0.0, -1.0), cross=(1.0, 0.0), w=71.0, d=93.0),
    },
    "3p": {
        0: dict(corner=(2388.0, 1843.5), along=(-1.0, 0.0), cross=(0.0, -1.0), w=70.2, d=92.1),
        1: dict(corner=(2453.5, 153.0), along=(0.0, 1.0), cross=(-1.0, 0.0), w=70.5, d=93.4),
        2: dict(corner=(686.2, 134.5), along=(1.0, 0.0), cross=(0.0, 1.0), w=70.4, d=92.2),
        3: dict(corner=(625.0, 1750.1), along=(0.0, -1.0), cross=(1.0, 0.0), w=71.0, d=93.0),
    },
}
# Side pile of the three-player game (first centre, step, tile size).
PILE_3P = {
    0: dict(anchor=(2034.9, 1569.5), step=(-72.61, 0.07), foot=(72.0, 92.0)),
    1: dict(anchor=(2180.3, 588.6), step=(-0.15, 85.06), foot=(93.0, 71.0)),
    2: dict(anchor=(945.6, 349.0), step=(72.46, 0.0), foot=(73.0, 92.0)),
    3: dict(anchor=(860.2, 1487.4), step=(0.12, -78.23), foot=(86.0, 72.0)),
}

# Measured slot quads of the opponents' rows (slot 0 is the anchored end), the drawn
# tile's quad beyond slot 12, the axis the row runs along and the side to which it grows.
BACK_ROW = {
    1: dict(slots=[
        [(2421.0, 1462.8), (2420.7, 1520.8), (2386.3, 1587.6), (2384.6, 1526.3)],
        [(2421.3, 1391.4), (2422.9, 1453.4), (2385.6, 1514.0), (2384.9, 1456.5)],
        [(2422.5, 1316.5), (2423.7, 1381.5), (2387.2, 1444.3), (2384.3, 1387.2)],
        [(2422.2, 1246.2), (2422.9, 1306.8), (2386.9, 1377.9), (2384.7, 1317.1)],
        [(2422.6, 1174.2), (2423.6, 1236.2), (2385.8, 1306.0), (2385.2, 1247.0)],
        [(2423.8, 1101.0), (2424.0, 1163.0), (2386.5, 1236.1), (2385.1, 1177.4)],
        [(2423.0, 1027.8), (2422.7, 1086.9), (2386.3, 1166.0), (2384.8, 1108.5)],
        [(2422.7, 956.0), (2421.9, 1011.1), (2387.4, 1097.9), (2384.1, 1038.0)],
        [(2424.1, 881.2), (2422.6, 942.2), (2387.6, 1026.6), (2385.5, 969.2)],
        [(2423.2, 811.3), (2424.2, 872.1), (2387.3, 958.4), (2386.0, 898.7)],
        [(2422.3, 737.0), (2423.3, 798.0), (2386.5, 889.4), (2385.7, 829.7)],
        [(2423.9, 664.7), (2422.8, 725.7), (2386.2, 818.7), (2385.5, 761.0)],
        [(2423.8, 592.5), (2423.7, 653.9), (2386.0, 750.0), (2385.1, 690.3)],
    ], drawn=[(2421.4, 484.6), (2422.7, 542.3), (2386.5, 645.4), (2385.2, 587.5)], axis=1, sign=-1),
    2: dict(slots=[
        [(2056.1, 103.5), (2120.8, 104.3), (2096.9, 224.7), (2034.7, 222.9)],
        [(1982.1, 101.4), (2049.4, 102.7), (2026.1, 224.5), (1965.1, 222.7)],
        [(1909.0, 101.6), (1976.4, 101.9), (1957.1, 225.3), (1894.7, 224.2)],
        [(1835.8, 101.4), (1904.1, 101.4), (1888.0, 223.7), (1824.4, 224.0)],
        [(1764.8, 102.4), (1831.2, 100.5), (1817.1, 226.3), (1756.0, 223.2)],
        [(1687.9, 102.7), (1756.6, 101.6), (1746.9, 223.5), (1684.4, 221.1)],
        [(1616.0, 104.9), (1682.7, 101.9), (1676.9, 224.5), (1614.5, 222.7)],
        [(1546.4, 106.5), (1611.0, 103.8), (1607.1, 226.8), (1545.9, 223.7)],
        [(1473.8, 103.8), (1537.8, 102.4), (1537.5, 222.7), (1475.3, 223.5)],
        [(1399.5, 100.3), (1465.6, 101.4), (1468.4, 225.0), (1405.8, 222.7)],
        [(1326.0, 102.7), (1394.2, 103.8), (1397.8, 224.0), (1336.2, 223.7)],
        [(1254.2, 103.0), (1320.5, 103.3), (1329.5, 222.9), (1265.7, 222.7)],
        [(1180.0, 103.3), (1249.2, 101.9), (1258.0, 224.2), (1196.8, 224.0)],
    ], drawn=[(1071.3, 105.1), (1136.3, 104.6), (1152.3, 225.0), (1091.0, 223.5)], axis=0, sign=-1),
    3: dict(slots=[
        [(650.3, 286.1), (685.8, 393.2), (684.8, 452.4), (648.7, 347.1)],
        [(649.9, 360.3), (686.4, 463.8), (685.6, 523.2), (649.0, 420.8)],
        [(649.9, 430.9), (686.5, 532.7), (684.8, 594.0), (647.6, 492.6)],
        [(650.2, 507.6), (686.0, 603.6), (685.8, 662.6), (648.3, 565.0)],
        [(649.5, 578.2), (686.9, 672.9), (685.2, 731.3), (648.7, 639.0)],
        [(650.2, 653.0), (685.5, 740.7), (687.0, 801.4), (648.4, 710.5)],
        [(648.7, 721.0), (686.7, 812.4), (685.5, 869.6), (647.2, 784.5)],
        [(648.2, 794.2), (687.1, 883.9), (685.2, 940.4), (646.8, 855.3)],
        [(649.5, 866.1), (687.6, 953.8), (685.5, 1010.4), (646.5, 927.2)],
        [(650.0, 940.9), (686.0, 1021.2), (685.7, 1080.7), (646.4, 1000.0)],
        [(649.3, 1013.9), (687.4, 1092.9), (684.8, 1152.1), (647.6, 1074.9)],
        [(649.7, 1084.5), (687.8, 1162.4), (684.9, 1219.2), (647.9, 1146.8)],
        [(648.8, 1156.8), (687.4, 1232.2), (683.4, 1290.7), (649.5, 1216.9)],
    ], drawn=[(650.7, 1269.1), (687.1, 1335.7), (684.9, 1392.7), (649.5, 1325.6)], axis=1, sign=1),
}
BACK_SLOTS = 13

# Fixed thresholds.
FILL_OK = 0.25
HAND_FILL_OK = 0.30
MARKER_FILL_OK = 0.35
SNAP_MAX = 70.0
OVERLAP_IOU = 0.8
ZONE_LIMIT = 60.0
CLUSTER_TOL = 12
MIN_ROUND_FRAMES = 3
MIN_ROUND_SHARE = 0.55
MIN_FEATURES = 2
TAU = 0.5
MAX_BAD = 2
MISMATCH = 1e9
EXTRA_OFFSETS_MS = [600, 1200, 2400]
QUIET_US = 300_000
SETTLE_CAP_US = 2_000_000
