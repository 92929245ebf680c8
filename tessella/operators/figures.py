"""Images of a section given to its captions: each caption in turn takes the image that suits it best."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessella.functions.text import heading_key
from tessella.operators.overlay import _arrow, _batches, _streams
from tessella.session import ship_package

# ---- fixed values: what suits which caption --------------------------------------------------
VECTOR_TYPES, VECTOR_ENDS = ("image/wmf", "image/emf", "image/svg+xml"), (".wmf", ".emf", ".svg")
JPEG_TYPES, JPEG_ENDS = ("image/jpeg", "image/jpg"), (".jpeg", ".jpg")
PNG_TYPES, PNG_ENDS = ("image/png",), (".png",)
#: Points for any image: by bytes and by area, each from the first number to below the second.
BY_BYTES = [(0, 16384, -200)]
BY_AREA = [(0, 1025, -260), (20000, None, 40)]
#: Points by caption: words of which one is needed, media, bytes from the first number to below the second.
BY_CAPTION = [
    (("架构", "结构", "原理", "框图"), ("vector", "png"), 0, None, 120),
    (("架构", "结构", "原理", "框图"), ("jpeg",), 0, None, -20),
    (("指示灯",), ("jpeg",), 150000, None, 220),
    (("指示灯",), ("jpeg",), 100000, 150000, 140),
    (("指示灯",), ("jpeg",), 0, 100000, 60),
    (("面板",), ("jpeg",), 100000, None, 80),
    (("插框",), ("jpeg",), 0, 150000, 80),
    (("前面板", "后面板"), ("png",), 20000, 80001, 100),
    (("前面板", "后面板"), ("jpeg",), 0, None, -10),
    (("正面",), ("png", "jpeg"), 30000, 90001, 60),
    (("正面",), ("png", "jpeg"), 0, None, 20),
    (("内部组件",), ("png",), 100000, None, 120),
    (("安装步骤",), ("png",), 80000, None, 120),
    (("面板",), ("png",), 0, None, 30),
    (("组件",), ("png",), 0, None, 30),
    (("步骤",), ("png",), 0, None, 30),
]
#: Words that stand for another one of the table: needed ones, and ones that may not be there.
ALSO = [("插框", ("刀片",), ("面板", "指示灯", "架构", "结构")), ("安装步骤", ("安装", "步骤"), ())]
# ---------------------------------------------------------------------------------------------

IMAGES = "doc, section, at, media_type, filename, size, width, height"


def media(media_type: str | None, filename: str | None) -> frozenset[str]:
    kind, name = (media_type or "").strip().lower(), (filename or "").strip().lower()
    known = (("vector", VECTOR_TYPES, VECTOR_ENDS), ("jpeg", JPEG_TYPES, JPEG_ENDS), ("png", PNG_TYPES, PNG_ENDS))
    return frozenset(m for m, types, ends in known if kind in types or name.endswith(ends))


def _within(n: int, low: int, high: int | None) -> bool:
    return n >= low and (high is None or n < high)


def image_class(media_type, filename, size, width, height) -> tuple:
    """All that a score asks of an image: its media, and between which limits of the tables its bytes and area are."""
    n, area = int(size or 0), max(0, int(width or 0)) * max(0, int(height or 0))
    limits = sorted({x for row in (*BY_BYTES, *(r[2:] for r in BY_CAPTION)) for x in row[:2] if x})
    return media(media_type, filename), sum(n >= x for x in limits), sum(p for a, b, p in BY_BYTES if _within(n, a, b)) + sum(p for a, b, p in BY_AREA if _within(area, a, b)), n


def score(caption_key: str, image: tuple) -> int:
    """How an image of a class suits a caption (its key)."""
    kinds, _, points, size = image
    words = {w for row in BY_CAPTION for w in row[0] if w in caption_key}
    words |= {w for w, needed, barred in ALSO if all(x in caption_key for x in needed) and not any(x in caption_key for x in barred)}
    return points + sum(p for some, of, low, high, p in BY_CAPTION if words & set(some) and kinds & set(of) and _within(size, low, high))


def assign(images: list[tuple], captions: list[str]) -> list[list[int]]:
    """Per caption (keys) the places of its images (classes). Each caption takes the best one that is left, of equal ones the first; the last gets the rest.

    Images of one class suit alike, so a caption looks at the first image of each class and not at all images.
    """
    if not captions:
        return []
    waiting: dict[tuple, tuple[tuple, list[int]]] = {}
    for i, c in enumerate(images):
        waiting.setdefault(c[:3], (c, []))[1].append(i)
    for _, places in waiting.values():
        heapq.heapify(places)
    groups: list[list[int]] = [[] for _ in captions]
    for group, caption in zip(groups, captions, strict=True):
        if not waiting:
            break
        key = max(waiting, key=lambda k: (score(caption, waiting[k][0]), -waiting[k][1][0]))
        group.append(heapq.heappop(waiting[key][1]))
        if not waiting[key][1]:
            del waiting[key]
    groups[-1] += sorted(i for _, places in waiting.values() for i in places)
    return groups


def images_to_captions(images: DataFrame, captions: DataFrame) -> DataFrame:
    """(doc, section, image, caption): which caption (its place) each image (its place) goes to; sections without captions have no rows.

    images: IMAGES; captions: doc, section, at, caption. Both are taken in the order of at; blank captions are none. A section's images
    are a stream, of which places and classes are held.
    """
    ship_package(images.sparkSession)
    doc = images.schema["doc"].dataType
    none = lambda kind: F.lit(None).cast(kind)
    c = captions.where(F.trim(F.coalesce("caption", F.lit(""))) != "").select("doc", F.col("section").cast("string").alias("section"), F.lit(0).alias("side"), F.col("at").cast("long").alias("at"), heading_key(F.col("caption")).alias("key"), none("string").alias("media_type"), none("string").alias("filename"), none("long").alias("size"), none("long").alias("width"), none("long").alias("height"))
    i = images.select("doc", F.col("section").cast("string").alias("section"), F.lit(1).alias("side"), F.col("at").cast("long").alias("at"), none("string").alias("key"), "media_type", "filename", *[F.col(x).cast("long").alias(x) for x in ("size", "width", "height")])
    schema = StructType().add("doc", doc).add("section", "string").add("image", "long").add("caption", "long")

    def run(batches):
        def rows():
            for (d, s), stream in _streams(batches, 2):
                keys, at, places, classes = [], [], [], []
                for side, place, key, *image in stream:
                    if side:
                        places.append(place)
                        classes.append(image_class(*image))
                    else:
                        keys.append(key)
                        at.append(place)
                for caption, group in zip(at, assign(classes, keys), strict=False):
                    for n in group:
                        yield d, s, places[n], caption

        yield from _batches(rows(), _arrow(schema))

    dealt = c.unionByName(i).repartition("doc", "section").sortWithinPartitions("doc", "section", "side", "at")
    return dealt.mapInArrow(run, f"doc {doc.simpleString()}, section string, image long, caption long")
