"""Tiles of slide files: tiled TIFF pyramids, read tile by tile, and a data source of the tiles that hold tissue.

A slide is a TIFF whose directories are its levels, each cut into tiles that lie anywhere in the file: the directories give
where (classic TIFF in both byte orders; grey or RGB with 8 bits a sample; uncompressed or deflated). Opening reads
the directories. Tissue is told from background on the smallest level (Otsu's threshold on grey), so a tile of a
larger level whose area there is bright, or whose centre lies near the border, is skipped without being read.
"""

from __future__ import annotations

import io
import json
import struct
import zlib
from collections.abc import Iterator, Sequence
from typing import BinaryIO, NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ledgerline.operators.blocks import otsu
from ledgerline.shipping import ship
from ledgerline.sources.volume_source import SPLIT_BYTES, Share, _store, found_files, shares

#: Fixed values of the format: tags of a level, and sizes of the number types that they come in.
WIDTH, HEIGHT, BITS, PACKING, COLOUR, SAMPLES, TILE_WIDTH, TILE_HEIGHT, PLACES, BYTES = 256, 257, 258, 259, 262, 277, 322, 323, 324, 325
NUMBERS = {1: "B", 3: "H", 4: "I"}
PLAIN, DEFLATED, OLD_DEFLATED = 1, 8, 32946
SCHEMA = "slide string, level int, x int, y int, size int, scale double, tissue double, variance double, grey binary"


class Level(NamedTuple):
    width: int
    height: int
    tile: tuple[int, int]  # width, height
    samples: int
    packing: int
    places: tuple[int, ...]
    sizes: tuple[int, ...]

    @property
    def across(self) -> int:
        return -(-self.width // self.tile[0])


def encode(levels: Sequence[np.ndarray], tile: int, deflated: bool = False, order: str = "<") -> bytes:
    """A pyramid of grey (h, w) or RGB (h, w, 3) levels, largest first, as a TIFF; tiles are filled up with zeros."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, 0))
    link = 4
    for image in levels:
        height, width = image.shape[:2]
        samples = 1 if image.ndim == 2 else image.shape[2]
        places, sizes = [], []
        for y in range(0, height, tile):
            for x in range(0, width, tile):
                part = np.zeros((tile, tile, samples), np.uint8)
                own = image[y : y + tile, x : x + tile].reshape(min(tile, height - y), min(tile, width - x), samples)
                part[: own.shape[0], : own.shape[1]] = own
                body = zlib.compress(part.tobytes()) if deflated else part.tobytes()
                places.append(len(out))
                sizes.append(len(body))
                out += body
        entries = [(WIDTH, [width]), (HEIGHT, [height]), (BITS, [8] * samples), (PACKING, [DEFLATED if deflated else PLAIN]), (COLOUR, [1 if samples == 1 else 2]), (SAMPLES, [samples]), (TILE_WIDTH, [tile]), (TILE_HEIGHT, [tile]), (PLACES, places), (BYTES, sizes)]
        kept = {}
        for tag, values in entries:  # longer lists stand elsewhere
            if len(values) > 1:
                kept[tag] = len(out)
                out += struct.pack(f"{order}{len(values)}I", *values)
        struct.pack_into(f"{order}I", out, link, len(out))
        out += struct.pack(f"{order}H", len(entries))
        for tag, values in entries:
            out += struct.pack(f"{order}HHII", tag, 4, len(values), kept.get(tag, values[0]))
        link = len(out)
        out += struct.pack(f"{order}I", 0)
    return bytes(out)


class Slide:
    """A file's levels, largest first, and their tiles on demand."""

    def __init__(self, content: bytes | BinaryIO):
        self.stream = io.BytesIO(content) if isinstance(content, bytes) else content
        head = self._read(0, 8)
        self.order = {b"II": "<", b"MM": ">"}.get(head[:2], "")
        if not self.order or struct.unpack_from(f"{self.order}H", head, 2)[0] != 42:
            raise ValueError("not a TIFF file")
        at, found = struct.unpack_from(f"{self.order}I", head, 4)[0], []
        seen: set[int] = set()
        while at and at not in seen:
            seen.add(at)
            tags, at = self._directory(at)
            if PLACES in tags:  # labels and overviews in strips are no levels
                found.append(self._level(tags))
        if not found:
            raise ValueError("the file has no tiles")
        self.levels = sorted(found, key=lambda v: -v.width)

    def _read(self, place: int, size: int) -> bytes:
        self.stream.seek(place)
        data = self.stream.read(size)
        if len(data) < size:
            raise ValueError("the file ends too early")
        return data

    def _directory(self, at: int) -> tuple[dict[int, tuple[int, ...]], int]:
        count = struct.unpack(f"{self.order}H", self._read(at, 2))[0]
        data, tags = self._read(at + 2, 12 * count + 4), {}
        for i in range(count):
            tag, kind, n = struct.unpack_from(f"{self.order}HHI", data, 12 * i)
            if kind in NUMBERS:
                form = f"{self.order}{n}{NUMBERS[kind]}"
                size = struct.calcsize(form)
                tags[tag] = struct.unpack(form, data[12 * i + 8 : 12 * i + 8 + size] if size <= 4 else self._read(struct.unpack_from(f"{self.order}I", data, 12 * i + 8)[0], size))
        return tags, struct.unpack_from(f"{self.order}I", data, 12 * count)[0]

    def _level(self, tags: dict[int, tuple[int, ...]]) -> Level:
        one = lambda tag, usual: tags.get(tag, (usual,))[0]
        level = Level(one(WIDTH, 0), one(HEIGHT, 0), (one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)), one(SAMPLES, 1), one(PACKING, PLAIN), tags[PLACES], tags[BYTES])
        if set(tags.get(BITS, (8,))) != {8} or level.samples not in (1, 3) or level.packing not in (PLAIN, DEFLATED, OLD_DEFLATED):
            raise ValueError(f"tiles of {level.samples} samples with packing {level.packing} are not read")
        return level

    def tile(self, level: int, i: int) -> np.ndarray:
        """Tile i of a level, row by row, in grey; what lies past the image is cut off."""
        own = self.levels[level]
        data = self._read(own.places[i], own.sizes[i])
        pixels = np.frombuffer(data if own.packing == PLAIN else zlib.decompress(data), np.uint8).reshape(own.tile[1], own.tile[0], own.samples)
        y, x = i // own.across * own.tile[1], i % own.across * own.tile[0]
        pixels = pixels[: own.height - y, : own.width - x]
        return pixels[..., 0] if own.samples == 1 else np.rint(pixels @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)

    def image(self, level: int) -> np.ndarray:
        own = self.levels[level]
        rows = [np.concatenate([self.tile(level, i) for i in range(r, r + own.across)], axis=1) for r in range(0, len(own.places), own.across)]
        return np.concatenate(rows, axis=0)


def tissue_tiles(slide: Slide, level: int = 0, least_tissue: float = 0.5, border: int = 0, least_variance: float = 0.0, wanted=lambda i: True) -> Iterator[tuple]:
    """(x, y, size, scale, tissue, variance, grey bytes) of the whole tiles of a level that hold tissue, are not near the
    border (centre within `border` pixels of the largest level) and are not flat; scale: pixels of the largest level a pixel."""
    own, small = slide.levels[level], slide.image(len(slide.levels) - 1)
    tissue = small <= otsu(small)
    scale = slide.levels[0].width / own.width
    width, height = own.tile
    to_small = small.shape[1] / own.width, small.shape[0] / own.height
    for i in range(len(own.places)):
        x, y = i % own.across * width, i // own.across * height
        if not wanted(i) or x + width > own.width or y + height > own.height:
            continue
        centre = (x + width / 2) * scale, (y + height / 2) * scale
        if border and not all(border <= c <= most - border for c, most in zip(centre, (slide.levels[0].width, slide.levels[0].height))):
            continue
        a, b = int(x * to_small[0]), int(y * to_small[1])
        area = tissue[b : max(b + 1, round((y + height) * to_small[1])), a : max(a + 1, round((x + width) * to_small[0]))]
        share = float(area.mean()) if area.size else 0.0
        if share < least_tissue:
            continue
        grey = slide.tile(level, i)
        if (spread := float(grey.var())) >= least_variance:
            yield x, y, width, scale, share, spread, grey.tobytes()


class TileReader(DataSourceReader):
    """Options: path, level (0), least_tissue (0.5), border (0), least_variance (0), parts (1): tasks a slide of
    split_bytes or more (smaller ones are several to a task), slides (a list of names in JSON; others are not opened)."""

    def __init__(self, options: dict):
        number = lambda name, usual: float(options.get(name, usual))
        self.path, self.parts, self.level = options["path"], int(options.get("parts", 1)), int(options.get("level", 0))
        self.limits = {"least_tissue": number("least_tissue", 0.5), "border": int(number("border", 0)), "least_variance": number("least_variance", 0)}
        self.only = set(json.loads(options["slides"])) if "slides" in options else None
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))

    def partitions(self) -> Sequence[InputPartition]:
        store, path = _store(self.path)
        found = found_files(store, path, lambda f: f.lower().endswith((".tif", ".tiff", ".svs")) and (self.only is None or f.rpartition("/")[2] in self.only))
        return shares(found, self.parts, split_bytes=self.split_bytes)

    def read(self, partition: Share) -> Iterator[tuple]:
        store, _ = _store(self.path)
        for file in partition.files:
            with store.open_input_file(file) as stream:
                for row in tissue_tiles(Slide(stream), self.level, wanted=lambda i: partition.holds(i, self.parts), **self.limits):
                    yield (file.rpartition("/")[2], self.level, *row)


class SlideTiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "slide_tiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TileReader:
        return TileReader(self.options)


def slide_tiles(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Registers the source and reads the tiles of the slides below the folder; options as of TileReader."""
    ship(spark)
    spark.dataSource.register(SlideTiles)
    return spark.read.format("slide_tiles").options(**options).load(folder)
