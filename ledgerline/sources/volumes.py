"""NIfTI-1 volumes from bytes or an open file: header, orientation, and axial slices read one at a time.

Only the header is read on opening. A slice that lies together in the file is read when it is asked for: an uncompressed
file is sought, a gzipped one is decompressed up to the slice and no further, and no more than a slice is held. Where
slices run along another stored axis, the first one asked for reads the voxels once. Slices come as radiologists look at them: from head to feet, rows from front to back, columns from
the patient's right to the left.
"""

from __future__ import annotations

import gzip
import io
import struct
from collections.abc import Callable, Iterator
from typing import BinaryIO

import numpy as np

#: Fixed values of the format: data type codes, and where header fields lie.
KINDS = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
HEADER = 348


def encode(values: np.ndarray, affine: np.ndarray, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), packed: bool = True) -> bytes:
    """A volume (x, y, z) of 32-bit floats as a file, gzipped if packed."""
    head = bytearray(HEADER + 4)
    struct.pack_into("<i", head, 0, HEADER)
    struct.pack_into("<8h", head, 40, 3, *values.shape, 1, 1, 1, 1)
    struct.pack_into("<2h", head, 70, 16, 32)
    struct.pack_into("<8f", head, 76, 1.0, *spacing, 1, 1, 1, 1)
    struct.pack_into("<3f", head, 108, HEADER + 4, 1.0, 0.0)
    struct.pack_into("<2h", head, 252, 0, 1)
    struct.pack_into("<12f", head, 280, *affine[:3].astype(float).ravel())
    head[344:348] = b"n+1\0"
    data = bytes(head) + values.astype("<f4").tobytes(order="F")
    return gzip.compress(data, mtime=0) if packed else data


class Volume:
    """A file's header, and its slices on demand."""

    def __init__(self, content: bytes | BinaryIO):
        stream = io.BytesIO(content) if isinstance(content, bytes) else content
        packed = stream.read(2) == b"\x1f\x8b"
        stream.seek(0)
        self.stream = gzip.GzipFile(fileobj=stream) if packed else stream
        data = self.stream.read(HEADER)
        self.end = next((e for e in "<>" if len(data) >= HEADER and struct.unpack_from(f"{e}i", data)[0] == HEADER), None)
        if self.end is None:
            raise ValueError("not a NIfTI-1 file")
        read = lambda form, at: struct.unpack_from(self.end + form, data, at)
        dims = read("8h", 40)
        self.shape = tuple(d for d in dims[1 : 1 + dims[0]])
        kind = read("h", 70)[0]
        if kind not in KINDS or len(self.shape) not in (3, 4):
            raise ValueError(f"data type {kind} with shape {self.shape} is not read")
        zooms = read("8f", 76)
        offset, slope, self.shift = read("3f", 108)
        self.slope = slope or 1.0
        self.affine = self._affine(read, zooms)
        self.kind, self.offset = np.dtype(KINDS[kind]).newbyteorder(self.end), int(offset) or HEADER + 4
        self.held: np.ndarray | None = None
        # Which stored axis runs along x (right), y (front) and z (head), each axis taken once, and in which direction.
        part = self.affine[:3, :3] / np.maximum(np.linalg.norm(self.affine[:3, :3], axis=0), 1e-30)
        self.axis, self.sign = [0, 0, 0], [1, 1, 1]
        for _ in range(3):
            world, own = np.unravel_index(np.abs(part).argmax(), (3, 3))
            self.axis[world], self.sign[world] = int(own), 1 if part[world, own] >= 0 else -1
            part[world, :], part[:, own] = 0, 0
        self.spacing = tuple(float(zooms[1 + self.axis[a]]) for a in range(3))

    @staticmethod
    def _affine(read, zooms) -> np.ndarray:
        q_code, s_code = read("2h", 252)
        if s_code > 0:
            return np.vstack([np.array(read("12f", 280)).reshape(3, 4), [0, 0, 0, 1]])
        if q_code > 0:  # a unit quaternion and an offset
            b, c, d, *at = read("6f", 256)
            a = max(0.0, 1 - b * b - c * c - d * d) ** 0.5
            turn = np.array([[a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)], [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)], [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c]])
            scale = np.diag([zooms[1], zooms[2], zooms[3] * (-1 if zooms[0] < 0 else 1)])
            return np.vstack([np.column_stack([turn @ scale, at]), [0, 0, 0, 1]])
        return np.diag([zooms[1], zooms[2], zooms[3], 1.0])

    def __len__(self) -> int:
        return int(self.shape[self.axis[2]])

    def _read(self, shape: tuple[int, ...], place: int) -> np.ndarray:
        """Voxels that lie together, from the place-th one on; of a series in time the first volume."""
        size = int(np.prod(shape)) * self.kind.itemsize
        self.stream.seek(self.offset + place * self.kind.itemsize)
        data = self.stream.read(size)
        if len(data) < size:
            raise ValueError("the file ends within its voxels")
        return np.frombuffer(data, self.kind).reshape(shape, order="F")

    def stored_place(self, k: int) -> int:
        """Where slice k lies along its stored axis."""
        return len(self) - 1 - k if self.sign[2] > 0 else k

    def slice(self, k: int) -> np.ndarray:
        """Slice k from the head down, as 64-bit floats."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        at, whole = self.stored_place(k), self.shape[:3]
        if self.axis[2] == 2:
            plane = self._read(whole[:2], at * whole[0] * whole[1])
        else:
            self.held = self._read(whole, 0) if self.held is None else self.held
            plane = np.take(self.held, at, axis=self.axis[2])
        plane = plane.astype(np.float64)
        if self.axis[0] > self.axis[1]:
            plane = plane.T
        plane = plane[:: -self.sign[0], :: -self.sign[1]].T  # towards the left, towards the back; rows first
        return np.ascontiguousarray(plane * self.slope + self.shift)


def slices(content: bytes | BinaryIO, name: str, wanted: Callable[[int, int], bool] = lambda k, n: True) -> Iterator[dict]:
    """(study, series, k, n, spacing, rows, columns, values) of the slices of a file named {study}__{series}.nii.gz for which
    wanted(k, number of slices) holds, in the order of the file, so that nothing is decompressed twice."""
    study, _, series = name.removesuffix(".gz").removesuffix(".nii").partition("__")
    volume = Volume(content)
    for k in sorted((k for k in range(len(volume)) if wanted(k, len(volume))), key=volume.stored_place):
        plane = volume.slice(k)
        yield {"study": study, "series": series, "k": k, "n": len(volume), "spacing": list(volume.spacing), "rows": plane.shape[0], "columns": plane.shape[1], "values": plane.ravel().tolist()}


SCHEMA = "study string, series string, k int, n int, spacing array<double>, rows int, columns int, values array<double>"


def read_pgm(content: bytes) -> np.ndarray:
    """An 8-bit grey image (binary PGM)."""
    parts: list[bytes] = []
    at = 0
    while len(parts) < 4:
        while content[at : at + 1].isspace():
            at += 1
        end = at
        while not content[end : end + 1].isspace():
            end += 1
        parts.append(content[at:end])
        at = end
    if parts[0] != b"P5" or parts[3] != b"255":
        raise ValueError("not an 8-bit binary PGM")
    width, height = int(parts[1]), int(parts[2])
    return np.frombuffer(content, np.uint8, width * height, at + 1).reshape(height, width)
