"""Queries of image work: vectors as pixels, eight of them as the rows of a photo; each SQL states the rule pixel by pixel."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.operators import imaging
from lectern.plans.queries import _PIXELS, _images, _pixels, table

Q: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def register(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


#: Eight vectors with consecutive ids, one below the other.
_PHOTOS = f"(SELECT image, p, len(p) AS n, len(p) // 8 AS w FROM (SELECT vec_id // 8 AS image, flatten(list(p ORDER BY vec_id)) AS p, count(*) AS k FROM {_PIXELS} GROUP BY ALL) WHERE k = 8)"


def _photos(spark, d):
    rows = _pixels(spark, d).groupBy(F.floor(F.col("vec_id") / 8).alias("image")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "p"))).alias("rows"))
    whole = rows.where(F.size("rows") == 8).select("image", F.flatten("rows.p").alias("pixels"))
    return whole.select("image", (F.size("pixels") / 8).cast("int").alias("w"), F.lit(8).alias("h"), "pixels")


#: Photos with the least and the greatest value that are left after the cut at both ends.
_ENDS = f"(SELECT *, s[cut + 1] AS low, s[n - cut] AS high FROM (SELECT *, list_sort(p) AS s, floor(n * {fixed.CUTOFF}::DOUBLE / 100)::BIGINT AS cut FROM {_PHOTOS}))"
_STRETCHED = "CASE WHEN high > low THEN list_transform(p, lambda v: greatest(0, least(255, trunc(v * (255::DOUBLE / (high - low)) + -low * (255::DOUBLE / (high - low)))))::INT) ELSE p END"


def gamma_sql(x: str) -> str:
    return f"list_transform({x}, lambda v: least(255, round_even(255.0 * pow(v / 255.0, {fixed.GAMMA}), 0))::INT)"


def smooth_sql(x: str) -> str:
    around = " + ".join(f"{x}[k + 1 + {dx} + w * {dy}]" for dy in (-1, 0, 1) for dx in (-1, 0, 1))
    return f"list_transform(range(0, n), lambda k: CASE WHEN k % w IN (0, w - 1) OR k < w OR k >= n - w THEN {x}[k + 1] ELSE floor(({around} + 4 * {x}[k + 1]) / 13::DOUBLE + 0.5)::INT END)"


def blend_sql(base: str, x: str, factor: float) -> str:
    return f"list_transform(range(0, n), lambda k: trunc(greatest(0, least(255, {base}[k + 1] + {factor}::DOUBLE * ({x}[k + 1] - {base}[k + 1]))))::INT)"


#: Steps of the tone, one column after the other.
_TONED = f"""(SELECT *, {blend_sql("gs", "g", fixed.SHARPNESS)} AS toned FROM (SELECT *, {smooth_sql("g")} AS gs FROM (SELECT *, {gamma_sql("stretched")} AS g FROM
 (SELECT *, {_STRETCHED} AS stretched FROM {_ENDS}))))"""


@query(f"SELECT image, stretched, smoothed, {blend_sql('smoothed', 'p', fixed.SHARPNESS)} AS sharpened, toned FROM (SELECT *, {smooth_sql('p')} AS smoothed FROM {_TONED})")
def tone_finish(spark, d):
    return imaging.finish(_photos(spark, d), "stretched", "smoothed", "sharpened", "toned")


def _level_sql(x: str) -> str:
    return f"(CASE WHEN {x} <= 42.5 THEN 0 WHEN {x} <= 127.5 THEN 1 WHEN {x} <= 212.5 THEN 2 ELSE 3 END)"


@query(f"""SELECT image, w::BIGINT AS w, 24::BIGINT AS h, list_concat(list_transform(range(0, n), lambda k: {_level_sql("list_avg(toned[1:w])")}), list_transform(toned, lambda v: {_level_sql("v")}),
 list_transform(range(0, n), lambda k: {_level_sql("list_avg(toned[n - w + 1:n])")})) AS levels FROM {_TONED}""")
def wallpaper_pixels(spark, d):
    """Photos as wide as the panel, matted above and below, read back from their files."""
    photos = _photos(spark, d)
    made = imaging.wallpapers(photos, "none", "edges", 64, 24)
    return imaging.bmp_levels(made, "image", "content")


@query()
def wallpaper_styles(spark, d):
    """Blurred and waved mats with the image's own noise, as a checksum of each file and how often it repeats itself."""
    photos = _photos(spark, d)
    out = None
    for style in ("blur", "waves", "edges", "none"):
        made = imaging.wallpapers(photos, "floyd", style, 120, 80)
        rows = imaging.bmp_levels(made, "image", "content").withColumn("style", F.lit(style))
        out = rows if out is None else out.unionByName(rows)
    return out.select("image", "style", "w", "h", F.md5(F.array_join("levels", "").cast("binary")).alias("digest"))


@query(f"""SELECT image, 32 AS w, 4 AS h, list_transform(range(0, 128), lambda k: floor((half[(k // 32) * 64 + k % 32 + 1] + half[(k // 32) * 64 + 32 + k % 32 + 1]) / 2.0 + 0.5)::INT) AS pixels
FROM (SELECT image, list_transform(range(0, 256), lambda k: floor((p[2 * k + 1] + p[2 * k + 2]) / 2.0 + 0.5)::INT) AS half FROM {_PHOTOS} WHERE w = 64)""")
def area_halved(spark, d):
    return imaging.resized(_photos(spark, d).where("w = 64"), 32, 4, "area")


@query()
def cover_pixels(spark, d):
    return imaging.covers(_photos(spark, d), 40, 30)


@query(f"""SELECT image, k AS n, least(w, a + 10) - a AS w, 6 - image % 3 AS h, flatten(list_transform(range(image % 3, 6), lambda y: list_transform(range(a, least(w, a + 10)), lambda x: p[y * w + x + 1]))) AS pixels
FROM (SELECT image, p, w, k, (image * 7 + k * 11) % 50 AS a FROM {_PHOTOS}, (SELECT unnest([0, 1]) AS k))""")
def figure_crops(spark, d):
    """Two boxes of each photo, cut out and not made smaller."""
    photos = _photos(spark, d)
    left = (F.col("image") * 7 + F.col("n") * 11) % 50
    boxes = photos.select("image", "w", F.explode(F.array(F.lit(0), F.lit(1))).alias("n"))
    box = F.struct(left.cast("int").alias("x0"), (F.col("image") % 3).cast("int").alias("top"), F.least(F.col("w"), left + 10).cast("int").alias("x1"), F.lit(6).alias("bottom"))
    boxes = boxes.select("image", "n", box.alias("box")).withColumn("width", F.col("box.x1") - F.col("box.x0")).withColumn("height", F.col("box.bottom") - F.col("box.top"))
    return imaging.figure_pixels(boxes, photos, ["image", "n"], ["image"])


@query(f"""SELECT vec_id AS image, CASE vec_id % 5 WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE 8 END AS w, CASE vec_id % 5 WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE len(p) // 8 END AS h,
 CASE vec_id % 5 WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE p END AS pixels, CASE vec_id % 5 WHEN 1 THEN 'truncated' WHEN 2 THEN 'not a PNG' WHEN 3 THEN 'bad checksum' END AS error FROM {_PIXELS} WHERE len(p) % 8 = 0""")
def png_pixels(spark, d):
    """Vectors written as PNG files and decoded; some files are cut short, some are something else, some have a wrong byte."""
    images = _images(spark, d).where("w = 8")
    files = imaging.previews(images.withColumnRenamed("pixels", "levels"), raw=True)
    k, c = F.col("image") % 5, F.col("content")
    size = F.octet_length(c)
    wrong = F.concat(F.substring(c, F.lit(1), size - 20), F.unhex(F.lit("ff00")), F.substring(c, size - 17, F.lit(18)))
    broken = F.when(k == 1, F.substring(c, F.lit(1), size - 5)).when(k == 2, F.concat(F.lit(b"x"), c)).when(k == 3, wrong).otherwise(c)
    return imaging.decode_images(files.select("image", broken.alias("content")), "image", "content")
