"""Content blocks of a request: one struct a block, assembled in order, checked by hash; tiles of an image."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODALITIES: dict[str, Callable[..., Column]] = {}


def register_modality(name: str):
    def add(fn):
        MODALITIES[name] = fn
        return fn

    return add


def block(id_: str, modality: str, representation: str, text: Column | None = None, images: Column | None = None) -> Column:
    return F.struct(F.lit(id_).alias("id"), F.lit(modality).alias("modality"), F.lit(representation).alias("representation"), (F.lit(None).cast("string") if text is None else text.cast("string")).alias("text"), (F.lit(None).cast("array<string>") if images is None else images).alias("images"))


@register_modality("ehr")
def _ehr(id_: str, column: str) -> Column:
    return block(id_, "ehr", "text", text=F.col(column))


@register_modality("ct")
def _ct(id_: str, column: str, select: str = "all", **params) -> Column:
    from ledgerline.functions.arrays import SELECTORS

    picked = F.transform(SELECTORS[select](F.size(column), **params), lambda i: F.get(F.col(column), i.cast("int")))
    return block(id_, "ct", "images", images=picked)


@register_modality("pathology")
def _tiles(id_: str, column: str, row_key: str, n: int) -> Column:
    from ledgerline.operators.sampling import tile_sample

    return block(id_, "pathology", "images", images=tile_sample(column, row_key, n, "tiles"))


def with_blocks(df: DataFrame, specs: Sequence[dict]) -> DataFrame:
    """blocks: an array with one struct per spec {id, modality, ...parameters}; an unknown modality is an error."""
    built = []
    for s in specs:
        if s["modality"] not in MODALITIES:
            raise KeyError(f"no modality named {s['modality']!r}")
        built.append(MODALITIES[s["modality"]](s["id"], **{k: v for k, v in s.items() if k not in ("id", "modality")}))
    return df.withColumn("blocks", F.array(*built))


def assembled(df: DataFrame, inline: str | None = None) -> DataFrame:
    """content: images first, then text. inline: a template column in which each [id] must stand exactly once, or the row fails."""
    images = F.flatten(F.transform(F.filter("blocks", lambda b: b["images"].isNotNull()), lambda b: b["images"]))
    texts = F.filter("blocks", lambda b: b["text"].isNotNull())
    if inline is None:
        body = F.array_join(F.transform(texts, lambda b: b["text"]), "\n\n")
        return df.withColumn("images", images).withColumn("prompt", body)
    marks = lambda b: (F.length(F.col(inline)) - F.length(F.replace(F.col(inline), F.concat(F.lit("["), b["id"], F.lit("]"))))) / (F.length(b["id"]) + 2)
    filled = F.aggregate(texts, F.col(inline), lambda acc, b: F.replace(acc, F.concat(F.lit("["), b["id"], F.lit("]")), b["text"]))
    sound = F.forall(texts, lambda b: marks(b) == 1)
    return df.withColumn("images", images).withColumn("prompt", F.when(sound, filled).otherwise(F.raise_error(F.lit("a block has no single place in the template")).cast("string")))


def golden(df: DataFrame, order: Sequence[str], prompt: str, images: str) -> DataFrame:
    """What a run showed each row: hashes and counts, in a total order by key."""
    return df.select(*order, F.sha2(F.col(prompt).cast("binary"), 256).alias("prompt_sha256"), F.length(prompt).cast("bigint").alias("prompt_chars"), F.transform(images, lambda i: F.sha2(i.cast("binary"), 256)).alias("image_sha256"), F.size(images).cast("bigint").alias("n_images"))


def damaged(pack: DataFrame, manifest: DataFrame, key: str, content: str) -> DataFrame:
    """Keys of a pack whose bytes are gone or differ from the manifest's sha256."""
    now = pack.select(key, F.sha2(content, 256).alias("now"))
    return manifest.join(now, key, "left").where(~F.col("sha256").eqNullSafe(F.col("now"))).select(key)


def otsu(gray: np.ndarray) -> int:
    """Threshold that separates the two classes of an 8-bit image best."""
    counts = np.bincount(gray.ravel(), minlength=256).astype(float)
    total, levels = counts.sum(), np.arange(256)
    below, mass = np.cumsum(counts), np.cumsum(counts * levels)
    above = total - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (mass / below - (mass[-1] - mass) / above) ** 2
    return int(np.nanargmax(np.where((below > 0) & (above > 0), between, np.nan))) if np.count_nonzero(counts) > 1 else 0


def tiles(gray: np.ndarray, size: int, least_tissue: float = 0.5, border: int = 0, least_variance: float = 0.0) -> Iterator[tuple[int, int, float]]:
    """(x, y, tissue share) of grid tiles that are dark enough, not at the border and not flat."""
    tissue = gray <= otsu(gray)
    height, width = gray.shape
    for y in range(0, height - size + 1, size):
        for x in range(0, width - size + 1, size):
            cx, cy = x + size // 2, y + size // 2
            if cx < border or cy < border or cx > width - border or cy > height - border:
                continue
            share = float(tissue[y : y + size, x : x + size].mean())
            if share >= least_tissue and float(gray[y : y + size, x : x + size].var()) >= least_variance:
                yield x, y, share


def untiled(slides: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Slides that the manifest does not list yet."""
    return slides.join(manifest.select(key).distinct(), key, "left_anti")
