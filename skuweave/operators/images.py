"""Images: audit of files, colour, shape and texture descriptors, and embedding with an encoder that the caller supplies.

Descriptors work on the pixels that Spark's image source decodes (BGR, height x width x channels).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST_SIDE = 50
#: First bytes of the supported formats, hexadecimal (fixed values).
MAGIC = {"JPEG": "FFD8FF", "PNG": "89504E470D0A1A0A", "WEBP": "52494646"}
SUGGESTIONS = {
    "MISSING_OR_EMPTY": "Check the path and upload the file again.",
    "UNSUPPORTED_FORMAT": "Convert the image to JPEG, PNG or WebP.",
    "IMAGE_TOO_SMALL": f"Use an image of at least {LEAST_SIDE} x {LEAST_SIDE} pixels.",
    "UNSUPPORTED_MODE": "Save the image as RGB, RGBA or greyscale.",
    "CORRUPTED_IMAGE": "The file is damaged; upload it again.",
    "MISSING_FEATURES": "Extract features for this product first.",
    "FEATURE_DIMENSION_MISMATCH": "Extract features again with one encoder.",
    "NAN_FEATURES": "Extract features again; they hold numbers that are none.",
    "INF_FEATURES": "Extract features again; they hold infinite numbers.",
    "EMPTY_CATALOG": "Add historical products first.",
    "ENCODER_FAILED": "Check the encoder and try the image again.",
}


def suggestions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(SUGGESTIONS.items()), "error_code string, suggestion string")


def webp_sides(head: Column) -> Column:
    """(width, height) by the header of a WebP file, from the first 30 bytes as hexadecimal digits; null where it is none. Lossy
    files (VP8) hold 14 bits for each side after a start code, lossless ones (VP8L) two fields of 14 bits less 1, extended ones
    (VP8X) 24 bits less 1 for each."""
    byte = lambda i: F.conv(F.substring(head, 2 * i + 1, 2), 16, 10).cast("int")
    number = lambda i, n: sum((byte(i + j) * 256**j for j in range(1, n)), byte(i))
    kind = F.substring(head, 25, 8)
    sides = lambda w, h: F.struct(w.cast("int").alias("width"), h.cast("int").alias("height"))
    lossless = (byte(21).cast("long") + byte(22) * F.lit(256).cast("long") + byte(23) * F.lit(65536).cast("long") + byte(24) * F.lit(16777216).cast("long"))
    return (
        F.when((kind == "56503820") & (F.substring(head, 47, 6) == "9D012A") & (F.length(head) >= 60), sides(number(26, 2) % 16384, number(28, 2) % 16384))
        .when((kind == "5650384C") & (F.substring(head, 41, 2) == "2F") & (F.length(head) >= 50), sides(lossless % 16384 + 1, F.floor(lossless / 16384) % 16384 + 1))
        .when((kind == "56503858") & (F.length(head) >= 60), sides(number(24, 3) + 1, number(27, 3) + 1))
    )


def audit(manifest: DataFrame, folder: str) -> DataFrame:
    """manifest (path, and further columns) with format, width, height and error_code (null: fine). Files are read by Spark
    under folder; paths are compared by what follows it."""
    spark = manifest.sparkSession
    tail = lambda c: F.substring_index(F.regexp_replace(c, r"^\w+:/*", "/"), folder.split(":")[-1].rstrip("/") + "/", -1)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(tail(F.col("path")).alias("path"), "length", F.hex(F.substring("content", 1, 12)).alias("magic"), F.hex(F.substring("content", 1, 30)).alias("head"))
    kind = F.when(F.col("magic").startswith(MAGIC["JPEG"]), "JPEG").when(F.col("magic").startswith(MAGIC["PNG"]), "PNG").when(F.col("magic").startswith(MAGIC["WEBP"]) & F.col("magic").endswith("57454250"), "WEBP")
    files = files.select("path", "length", kind.alias("format"), F.when(kind == "WEBP", webp_sides(F.col("head"))).alias("sides"))
    decoded = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(folder)
    decoded = decoded.select(tail(F.col("image.origin")).alias("path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"))
    out = manifest.join(files, "path", "left").join(decoded, "path", "left")
    code = (
        F.when(F.col("length").isNull() | (F.col("length") == 0), "MISSING_OR_EMPTY")
        .when(F.col("format").isNull(), "UNSUPPORTED_FORMAT")
        .when((F.col("format") == "WEBP") & F.col("sides").isNull(), "CORRUPTED_IMAGE")
        .when((F.col("format") == "WEBP") & (F.least("sides.width", "sides.height") < LEAST_SIDE), "IMAGE_TOO_SMALL")
        .when(F.col("format") == "WEBP", None)  # pixels are not decoded here; a WebP file is RGB or RGBA
        .when(F.coalesce("height", F.lit(-1)) < 0, "CORRUPTED_IMAGE")
        .when(F.least("width", "height") < LEAST_SIDE, "IMAGE_TOO_SMALL")
        .when(~F.col("channels").isin(1, 3, 4), "UNSUPPORTED_MODE")
    )
    by_header = F.col("format") == "WEBP"
    sides = {c: F.when(by_header, F.col(f"sides.{c}")).otherwise(F.col(c)) for c in ("width", "height")}
    return out.withColumn("error_code", code).withColumns(sides).drop("channels", "sides")


def hsv(pixels: np.ndarray) -> np.ndarray:
    """Of BGR bytes, h from 0 to 180, s and v from 0 to 255, as rows."""
    b, g, r = (pixels[..., i].astype(np.float64).ravel() for i in range(3))
    v, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    span = v - low
    safe = np.where(span > 0, span, 1)
    h = np.where(v == r, (g - b) / safe, np.where(v == g, 2 + (b - r) / safe, 4 + (r - g) / safe)) * 30
    return np.stack([np.where(span > 0, h % 180, 0), np.where(v > 0, span / np.where(v > 0, v, 1) * 255, 0), v], 1)


def color_histogram(pixels: np.ndarray) -> np.ndarray:
    """8 x 8 x 4 bins of hue, saturation and value, summing to 1."""
    values = np.minimum(np.rint(hsv(pixels)), [179, 255, 255])
    h = np.histogramdd(values, (8, 8, 4), [(0, 180), (0, 256), (0, 256)])[0].ravel()
    return (h / (h.sum() + 1e-7)).astype(np.float32)


def grey(pixels: np.ndarray) -> np.ndarray:
    if pixels.shape[2] == 1:
        return pixels[..., 0]
    return np.rint(pixels[..., 0] * 0.114 + pixels[..., 1] * 0.587 + pixels[..., 2] * 0.299).astype(np.uint8)


def otsu(g: np.ndarray) -> int:
    """The threshold with the largest variance between what is above it and what isn't."""
    p = np.bincount(g.ravel(), minlength=256) / g.size
    below, mean = np.cumsum(p), np.cumsum(p * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (mean[-1] * below - mean) ** 2 / (below * (1 - below))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def shape_moments(g: np.ndarray) -> np.ndarray:
    """The seven Hu moments of the silhouette, on a signed logarithmic scale."""
    mask = (g > otsu(g)) * 255.0
    y, x = np.mgrid[: g.shape[0], : g.shape[1]].astype(np.float64)
    total = mask.sum()
    if total == 0:
        hu = np.zeros(7)
    else:
        dx, dy = x - (x * mask).sum() / total, y - (y * mask).sum() / total
        e = {(p, q): (dx**p * dy**q * mask).sum() / total ** (1 + (p + q) / 2) for p in range(4) for q in range(4) if 2 <= p + q <= 3}
        a, b = e[3, 0] + e[1, 2], e[2, 1] + e[0, 3]
        c, d = e[3, 0] - 3 * e[1, 2], 3 * e[2, 1] - e[0, 3]
        m, n = e[2, 0] - e[0, 2], e[1, 1]
        hu = np.array([
            e[2, 0] + e[0, 2], m * m + 4 * n * n, c * c + d * d, a * a + b * b,
            c * a * (a * a - 3 * b * b) + d * b * (3 * a * a - b * b), m * (a * a - b * b) + 4 * n * a * b,
            d * a * (a * a - 3 * b * b) - c * b * (3 * a * a - b * b),
        ])
    return (-np.sign(hu) * np.log10(np.abs(hu) + 1e-10)).astype(np.float32)


def texture_histogram(g: np.ndarray, points: int = 24, radius: int = 3) -> np.ndarray:
    """Uniform local binary patterns (neighbours on a circle, bilinear, 0 outside), in 256 bins that sum to 1."""
    wide = np.pad(g.astype(np.float64), radius + 1)
    rows, cols = g.shape
    bits = []
    for k in range(points):
        dy, dx = np.round(-radius * np.sin(2 * np.pi * k / points), 5), np.round(radius * np.cos(2 * np.pi * k / points), 5)
        y0, x0 = int(np.floor(dy)), int(np.floor(dx))
        fy, fx = dy - y0, dx - x0
        at = lambda i, j: wide[radius + 1 + y0 + i : radius + 1 + y0 + i + rows, radius + 1 + x0 + j : radius + 1 + x0 + j + cols]  # noqa: B023, E731
        near = (1 - fy) * ((1 - fx) * at(0, 0) + fx * at(0, 1)) + fy * ((1 - fx) * at(1, 0) + fx * at(1, 1))
        bits.append(np.round(near, 8) >= g)
    stack = np.stack(bits)
    changes = (stack != np.roll(stack, 1, 0)).sum(0)
    codes = np.where(changes <= 2, stack.sum(0), points + 1)
    h = np.bincount(codes.ravel(), minlength=256)[:256].astype(np.float32)
    return h / (h.sum() + 1e-7)


def describe(images: DataFrame) -> DataFrame:
    """path, color, shape, texture and error_code of rows of Spark's image source (column image)."""
    rows = images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")
    kind = pa.list_(pa.float32())

    def run(batches):
        for batch in batches:
            out = [[], [], [], []]
            for h, w, n, data in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                if not data or h <= 0:
                    got = (None, None, None, "CORRUPTED_IMAGE")
                else:
                    pixels = np.frombuffer(data, np.uint8).reshape(h, w, n)
                    g = grey(pixels)
                    got = (color_histogram(pixels if n >= 3 else np.repeat(pixels, 3, 2)), shape_moments(g), texture_histogram(g), None)
                for column, value in zip(out, got, strict=True):
                    column.append(value)
            arrays = [batch.column(0), *(pa.array([None if x is None else x.tolist() for x in c], kind) for c in out[:3]), pa.array(out[3], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["path", "color", "shape", "texture", "error_code"])

    return rows.mapInArrow(run, "path string, color array<float>, shape array<float>, texture array<float>, error_code string")


def embed(images: DataFrame, make_predict_fn, batch_size: int = 32, done: DataFrame | None = None, key: str = "product_id", column: str = "content") -> DataFrame:
    """key, embedding (length 1) and error_code. make_predict_fn: as predict_batch_udf takes it; it gets the column's values
    and returns rows of numbers. done: products that have features already; they are left out."""
    todo = images if done is None else images.join(done.select(key), key, "left_anti")
    encoder = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    out = todo.filter(F.col(column).isNotNull()).select(key, encoder(column).alias("_raw"))
    size = F.sqrt(F.aggregate("_raw", F.lit(0.0), lambda a, x: a + x * x))
    out = out.withColumn("_size", size)
    good = out.select(key, F.when(F.col("_size") > 0, F.transform("_raw", lambda x: (x / F.col("_size")).cast("float"))).alias("embedding"))
    good = good.withColumn("error_code", F.when(F.col("embedding").isNull(), "ENCODER_FAILED"))
    return good.unionByName(todo.filter(F.col(column).isNull()).select(key, F.lit(None).cast("array<float>").alias("embedding"), F.lit("MISSING_OR_EMPTY").alias("error_code")))
