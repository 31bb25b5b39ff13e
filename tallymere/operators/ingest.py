"""Upload gates and image measures over columns: magic bytes, quality, tall images, difference hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accepted file endings and the limits of the quality gate.
ENDINGS = ("jpg", "jpeg", "png", "webp", "pdf", "heic", "heif")
MAX_MB = 25
LEAST_BLUR, LEAST_BRIGHT, MOST_BRIGHT, MOST_GLARE, LEAST_EDGE, GLARE_LUMA = 100.0, 25.0, 240.0, 0.55, 640, 250


def content_type(head_hex: Column) -> Column:
    """From the first bytes as hex; null if no accepted kind starts like this."""
    at = lambda byte, want: F.substring(head_hex, 2 * byte + 1, len(want)) == want
    return (
        F.when(at(0, "FFD8"), "image/jpeg").when(at(0, "89504E470D0A1A0A"), "image/png").when(at(0, "25504446"), "application/pdf")
        .when(at(0, "52494646") & at(8, "57454250"), "image/webp").when(at(4, "66747970"), "image/heic")
    )


def upload_gate(name: Column, n_bytes: Column, head_hex: Column, max_mb: int = MAX_MB) -> Column:
    """struct(ok, reason, content_type): ending, size, emptiness, then the bytes; the first that fails is the reason."""
    ending = F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))
    kind = content_type(head_hex)
    reason = F.when(~ending.isin(*ENDINGS), "unsupported ending").when(n_bytes > max_mb * 1024 * 1024, "too large").when(n_bytes == 0, "empty").when(kind.isNull(), "unknown content")
    return F.struct(reason.isNull().alias("ok"), reason.alias("reason"), F.when(reason.isNull(), kind).alias("content_type"))


def gated_files(spark, path: str, max_mb: int = MAX_MB, glob: str | None = None) -> DataFrame:
    """Files under a folder with their verdict: path, length, ok, reason, content_type. Only the first bytes of a file are kept.
    Spark lists no rows for files of no bytes; where those count, gate a table of names and sizes with upload_gate."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    gate = upload_gate(F.col("path"), F.col("length"), F.hex(F.substring("content", 1, 16)), max_mb)
    return files.select("path", "length", gate.alias("g")).select("path", "length", "g.*")


def image_key(id_: Column, when: Column, variant: str = "original") -> Column:
    return F.format_string("receipts/%s/%s/%s.jpg", F.date_format(when, "yyyy/MM"), id_.cast("string"), F.lit(variant))


def grid_metrics(grid: Column, width: int) -> Column:
    """struct(blur, brightness, contrast, glare) of grey values row by row: the Laplacian's variance with mirrored edges,
    mean and deviation of the luma, and the share of blown-out pixels. Sums of whole numbers, divided once."""
    n = F.size(grid)
    height = (n / width).cast("int")
    at = lambda r, c: F.get(grid, r * width + c).cast("long")
    mirror = lambda k, size: F.when(k < 0, -k).when(k >= size, 2 * size - 2 - k).otherwise(k)

    def laplace(i: Column) -> Column:
        r, c = (i / width).cast("int"), i % width
        return at(mirror(r - 1, height), c) + at(mirror(r + 1, height), c) + at(r, mirror(c - 1, F.lit(width))) + at(r, mirror(c + 1, F.lit(width))) - 4 * at(r, c)

    zero = F.lit(0).cast("long")
    total = lambda values, f: F.aggregate(values, zero, lambda a, x: a + f(x))
    lap = F.transform(F.sequence(F.lit(0), n - 1), laplace)
    long = F.transform(grid, lambda x: x.cast("long"))
    variance = lambda v: (total(v, lambda x: x * x) * n - total(v, lambda x: x) * total(v, lambda x: x)) / (n * n)
    return F.struct(variance(lap).alias("blur"), (total(long, lambda x: x) / n).alias("brightness"), F.sqrt(variance(long)).alias("contrast"), (F.size(F.filter(grid, lambda x: x >= GLARE_LUMA)) / n).alias("glare"))


def quality_gate(short_edge: Column, blur: Column, brightness: Column, glare: Column) -> Column:
    """The first reason against an image, or null."""
    return F.when(short_edge < LEAST_EDGE, "resolution").when(blur < LEAST_BLUR, "blurry").when(brightness < LEAST_BRIGHT, "dark").when(brightness > MOST_BRIGHT, "overexposed").when(glare > MOST_GLARE, "glare")


def tall_strips(width: Column, height: Column, max_aspect: float = 3.0, overlap: int = 120) -> Column:
    """array of struct(top, bottom): one strip, or overlapping ones of max_aspect times the width, the last at the bottom edge."""
    strip = F.greatest(F.lit(1), F.bround(width * max_aspect).cast("int"))
    step = F.greatest(F.lit(1), strip - overlap)
    cuts = F.ceil(F.greatest(height - strip, F.lit(0)) / step).cast("int")
    many = F.transform(F.sequence(F.lit(0), cuts), lambda k: F.struct(F.least(k * step, height - strip).alias("top"), F.least(k * step + strip, height).alias("bottom")))
    return F.when((width <= 0) | (height <= 0) | (height <= width * max_aspect), F.array(F.struct(F.lit(0).alias("top"), height.alias("bottom")))).otherwise(many)


def difference_hash(grid: Column) -> Column:
    """16 hex characters from 8 rows of 9 grey values: a bit for each value over its left neighbour."""
    bit = lambda r, k: F.when(F.get(grid, F.lit(r * 9 + k + 1)) > F.get(grid, F.lit(r * 9 + k)), "1").otherwise("0")
    half = lambda rows: F.lpad(F.lower(F.conv(F.concat(*[bit(r, k) for r in rows for k in range(8)]), 2, 16)), 8, "0")
    return F.concat(half(range(4)), half(range(4, 8)))
