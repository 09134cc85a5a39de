"""Queries over boxes in frames: fragments, regions of interest, ownership, transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions import boxes as bx
from matchloom.functions.numbers import sigmoid
from matchloom.operators import geometry

from .govern import _BOXES, _LIST_IOU, _boxes

from .common import query_into

QUERIES: dict = {}
ORACLES: dict = {}
query = query_into(QUERIES, ORACLES)


def _sql_both(a: str, b: str) -> str:
    return f"(greatest(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1), 0) * greatest(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1), 0))"


def _sql_area(a: str) -> str:
    return f"(({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1))"


def _sql_iou(a: str, b: str) -> str:
    return f"({_sql_both(a, b)} / ({_sql_area(a)} + {_sql_area(b)} - {_sql_both(a, b)}))"


#: The region of interest and the frame of every image.
ROI, WIDTH, HEIGHT = (10.0, 5.0, 40.0, 25.0), 90.0, 80.0
_ROI = f"roi AS (SELECT {ROI[0]} AS x1, {ROI[1]} AS y1, {ROI[2]} AS x2, {ROI[3]} AS y2)"


@query(f"""WITH {_BOXES}, h AS (SELECT a.image, a.key, b.key AS parent, {_sql_area("b")} AS s FROM bx a JOIN bx b ON a.image = b.image AND a.key <> b.key WHERE {_sql_both("a", "b")} / {_sql_area("a")} >= 0.95
 AND {_sql_area("b")} > {_sql_area("a")} AND {_sql_area("b")} <= 12 * {_sql_area("a")} AND b.score >= greatest(20000, a.score)),
p AS (SELECT image, key, parent FROM h QUALIFY row_number() OVER (PARTITION BY image, key ORDER BY s DESC, parent) = 1)
SELECT bx.image, bx.key, CASE WHEN parent IS NULL THEN 'kept' ELSE 'fragment' END AS state, parent AS enclosing_key FROM bx LEFT JOIN p USING (image, key)""")
def geo_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes inside a larger one that is surer, kept as fragments with the one that holds them."""
    return geometry.nested(_boxes(spark, sf_dir), "image", sure=20000.0)


@query(f"""WITH {_BOXES}, {_ROI}, s AS (SELECT image, key, {_sql_iou("bx", "roi")} AS o FROM bx, roi), r AS (SELECT *, lead(o) OVER w AS next, row_number() OVER w AS r FROM s WINDOW w AS (PARTITION BY image ORDER BY o DESC, key)),
t AS (SELECT *, CASE WHEN o <= 0 THEN 'no_overlap' WHEN coalesce(o - next <= 1e-12, false) THEN 'tied_overlap' ELSE 'unique_maximum' END AS reason FROM r WHERE r = 1)
SELECT image, CASE WHEN reason = 'unique_maximum' THEN key END AS key, round(o, 9) AS overlap, reason, reason = 'unique_maximum' AND o >= 0.4 AND coalesce(next, 0) < 0.4 AS addressed FROM t""")
def geo_roi_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box of every image that a region of interest means, with the reason where there is none."""
    return geometry.roi_match(_boxes(spark, sf_dir), "image", tuple(F.lit(x) for x in ROI), 0.4).withColumn("overlap", F.round("overlap", 9))


@query(f"""WITH {_BOXES}, a AS (SELECT * FROM bx WHERE score > 40000), b AS (SELECT * FROM bx WHERE score <= 40000),
s AS (SELECT a.image, a.key, min(b.x1) AS x1, min(b.y1) AS y1, max(b.x2) AS x2, max(b.y2) AS y2 FROM a JOIN b USING (image) WHERE {_sql_iou("a", "b")} >= 0.1 GROUP BY ALL),
u AS (SELECT a.image, a.key, a.x1, a.y1, a.x2, a.y2, greatest(least(a.x1, coalesce(s.x1, a.x1)), 0) AS n1, greatest(least(a.y1, coalesce(s.y1, a.y1)), 0) AS n2, least(greatest(a.x2, coalesce(s.x2, a.x2)), {WIDTH}) AS n3, least(greatest(a.y2, coalesce(s.y2, a.y2)), {HEIGHT}) AS n4 FROM a LEFT JOIN s USING (image, key)),
g AS (SELECT *, greatest(n3 - n1, 0) * greatest(n4 - n2, 0) >= 1.1::DOUBLE * (greatest(x2 - x1, 0) * greatest(y2 - y1, 0)) AS grew FROM u)
SELECT image, key, grew, CASE WHEN grew THEN n1 ELSE x1 END AS x1, CASE WHEN grew THEN n2 ELSE y1 END AS y1, CASE WHEN grew THEN n3 ELSE x2 END AS x2, CASE WHEN grew THEN n4 ELSE y2 END AS y2 FROM g""")
def geo_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dear boxes widened by the cheap ones that overlap them, where that makes them a tenth larger."""
    b = _boxes(spark, sf_dir)
    return geometry.recovered(b.where("score > 40000"), b.where("score <= 40000"), "image", F.lit(WIDTH), F.lit(HEIGHT))


@query(f"""WITH {_BOXES}, f AS (SELECT image, key, x1 - 12.25 AS x1, y1 - 3.5 AS y1, x2 - 12.25 AS x2, y2 - 3.5 AS y2 FROM bx),
c AS (SELECT image, key, greatest(floor(x1), 0) AS a, greatest(floor(y1), 0) AS b, least(ceil(x2), 60) AS c, least(ceil(y2), 40) AS d FROM f)
SELECT image, key, CASE WHEN a < c AND b < d THEN a END AS x1, CASE WHEN a < c AND b < d THEN b END AS y1, CASE WHEN a < c AND b < d THEN c END AS x2, CASE WHEN a < c AND b < d THEN d END AS y2,
round(CASE WHEN a < c AND b < d THEN (c - a) * (d - b) / 2400 END, 9) AS area_share, CASE WHEN a < c AND b < d THEN a * 320 / 60 END AS letter_x1, CASE WHEN a < c AND b < d THEN b * 320 / 60 + (320 - 40 * 320 / 60) / 2 END AS letter_y1,
CASE WHEN a < c AND b < d THEN 40 - d END AS flipped_y1, CASE WHEN a < c AND b < d THEN true END AS inverse FROM c""")
def geo_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes moved to another origin, cut to a frame of whole numbers, put into a square of 320, flipped; and whether the square's inverse gives the box again."""
    w, h = F.lit(60.0), F.lit(40.0)
    own = _boxes(spark, sf_dir)
    names = geometry.CORNERS
    cut = bx.checked(tuple(bx.moved(bx.box(), F.lit(-12.25), F.lit(-3.5))), w, h)
    out = own.select("image", "key", *(x.alias(c) for x, c in zip(cut, names, strict=True)))
    b = bx.box()
    square = bx.letterboxed(b, w, h, 320.0)
    back = bx.unletterboxed(tuple(square), w, h, 320.0)
    same = F.lit(True)
    for x, y in zip(back, b, strict=True):
        same = same & (F.abs(x - y) < 1e-9)
    return out.withColumns({
        "area_share": F.round(F.when(b[0].isNotNull(), bx.area_share(b, w, h)), 9), "letter_x1": square[0], "letter_y1": square[1], "flipped_y1": bx.flipped(b, h)[1], "inverse": same,
    })


@query(f"""WITH RECURSIVE {_BOXES}, o AS (SELECT image, {{'key': key, 'parent': key % 3, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} AS b, row_number() OVER (PARTITION BY image ORDER BY score DESC, key) AS i FROM bx),
w(image, i, kept) AS (SELECT image, i, [b] FROM o WHERE i = 1 UNION ALL SELECT w.image, o.i, CASE WHEN len(list_filter(w.kept, lambda k: k.parent <> o.b.parent AND {_LIST_IOU} >= 0.3)) > 0 THEN w.kept ELSE list_append(w.kept, o.b) END FROM w JOIN o ON o.image = w.image AND o.i = w.i + 1),
l AS (SELECT image, kept FROM w QUALIFY row_number() OVER (PARTITION BY image ORDER BY i DESC) = 1) SELECT image, unnest(kept).key AS key FROM l""")
def geo_label_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that stay with their parent: of overlapping ones under two parents the surer."""
    b = _boxes(spark, sf_dir).withColumn("parent", F.col("key") % 3)
    return geometry.owned_labels(b, "image", "parent", 0.3)


@query(f"""WITH {_BOXES}, p AS (SELECT image, key, score / 90000.0 + {_sql_area("bx")} / 7200.0 AS p FROM bx), r AS (SELECT *, lead(p) OVER w AS next, row_number() OVER w AS r, count(*) OVER (PARTITION BY image) AS n FROM p WINDOW w AS (PARTITION BY image ORDER BY p DESC, key))
SELECT image, CASE WHEN coalesce(p - next >= 0.04, true) THEN key END AS key, n, CASE WHEN coalesce(p - next >= 0.04, true) THEN 'chosen' ELSE 'ambiguous' END AS state FROM r WHERE r = 1""")
def geo_best_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region of the largest score and size of every image; none where the next is nearly as good."""
    return geometry.best_region(_boxes(spark, sf_dir), "image", F.col("score") / 90000.0 + bx.area(bx.box()) / 7200.0)


@query(f"""WITH {_BOXES}, g AS (SELECT image, key % 2 AS parent, count(*) AS n, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, max(score) AS score FROM bx GROUP BY ALL)
SELECT image, parent, n, x1, y1, x2, y2, round(1 / (1 + exp(-greatest(-40, least(40, (score - 50000) / 1000)))), 9) AS gate, n = 1 AND (x2 - x1) * (y2 - y1) >= 0.2 * 7200 AS oversized FROM g""")
def geo_parent_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes by parent: the union box, a gate from the best score, and single boxes that take much of the frame."""
    g = _boxes(spark, sf_dir).groupBy("image", (F.col("key") % 2).alias("parent")).agg(F.count("*").alias("n"), *(f(c).alias(c) for f, c in ((F.min, "x1"), (F.min, "y1"), (F.max, "x2"), (F.max, "y2"))), F.max("score").alias("score"))
    gate = F.round(sigmoid((F.col("score") - 50000) / 1000), 9)
    return g.select("image", "parent", "n", *geometry.CORNERS, gate.alias("gate"), ((F.col("n") == 1) & (bx.area_share(bx.box(), F.lit(WIDTH), F.lit(HEIGHT)) >= 0.2)).alias("oversized"))
