"""TIFF directories: the structure of most raw files and of EXIF blocks."""

from __future__ import annotations

import struct
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

from sharpsieve.sources.bytes import Source

#: Fixed values of the format: type code, its struct letter and how many make one value.
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "s", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d"}
#: 42, Panasonic's 85, and Olympus' two.
MAGIC = (42, 85, 0x4F52, 0x5352)
#: Tags by name.
TAGS = {
    "panasonic_height": 0x0006, "panasonic_width": 0x0007, "panasonic_iso": 0x0017, "panasonic_jpeg": 0x002E, "width": 0x0100, "height": 0x0101, "compression": 0x0103,
    "make": 0x010F, "model": 0x0110, "strip_offsets": 0x0111, "orientation": 0x0112, "strip_counts": 0x0117, "sub_ifds": 0x014A, "jpeg_offset": 0x0201, "jpeg_length": 0x0202,
    "exif_ifd": 0x8769, "exposure_time": 0x829A, "f_number": 0x829D, "iso": 0x8827, "gps_ifd": 0x8825, "taken": 0x9003, "focal_length": 0x920A, "focal_35mm": 0xA405, "lens": 0xA434,
}
NOWHERE = 0xFFFFFFFF
MOST_INLINE, MOST_ENTRIES, MOST_IFDS, MOST_VALUES = 4096, 4096, 64, 1 << 24


@dataclass(frozen=True)
class Place:
    """Bytes that were left where they are."""

    offset: int
    length: int


Directory = dict[int, object]


class Tiff:
    """The directories of a TIFF block that starts at `base` of a source."""

    def __init__(self, source: Source, base: int = 0):
        self.source, self.base = source, base
        self.order = {b"II": "<", b"MM": ">"}.get(source.at(base, 2))
        head = self.order and source.unpack(self.order + "HI", base + 2)
        if not head or head[0] not in MAGIC:
            raise ValueError("not a TIFF block")
        self.first = head[1]

    def value(self, kind: int, count: int, spot: int) -> object:
        letters = TYPES.get(kind)
        if letters is None or count > MOST_VALUES:
            return None
        one = struct.calcsize("<" + letters)
        total = one * count
        if total > 4:
            pointer = self.source.unpack(self.order + "I", spot)
            if pointer is None or pointer[0] == NOWHERE:
                return None
            spot = self.base + pointer[0]
            if letters == "s" and total > MOST_INLINE:
                return Place(spot, total)
        raw = self.source.at(spot, total)
        if len(raw) < total:
            return None
        if kind == 2:
            return raw.partition(b"\0")[0].decode("ascii", "replace")
        if kind == 7:
            return raw
        values = list(struct.iter_unpack(self.order + letters, raw))
        values = values if len(letters) > 1 else [v[0] for v in values]
        return values[0] if count == 1 else values

    def directory(self, offset: int) -> tuple[Directory, int]:
        """A directory, and the offset of the next (0: none)."""
        start = self.base + offset
        head = self.source.unpack(self.order + "H", start)
        if head is None or head[0] > MOST_ENTRIES:
            return {}, 0
        found: Directory = {}
        for spot in range(start + 2, start + 2 + 12 * head[0], 12):
            entry = self.source.unpack(self.order + "HHI", spot)
            if entry is None:
                break
            found[entry[0]] = self.value(entry[1], entry[2], spot + 8)
        after = self.source.unpack(self.order + "I", start + 2 + 12 * head[0])
        return found, after[0] if after else 0

    def __iter__(self) -> Iterator[Directory]:
        """All directories: the chain, sub-directories and EXIF; each offset once."""
        todo, seen = deque([self.first]), set()
        while todo and len(seen) < MOST_IFDS:
            offset = todo.popleft()
            if offset <= 0 or offset in seen:
                continue
            seen.add(offset)
            found, after = self.directory(offset)
            yield found
            for more in (after, found.get(TAGS["sub_ifds"]), found.get(TAGS["exif_ifd"])):
                todo.extend(x for x in (more if isinstance(more, list) else [more]) if isinstance(x, int) and x)


def number(value: object) -> float | None:
    """A tag's (first) value as a number; rationals are divided, by zero is missing."""
    if isinstance(value, list):
        value = value[0] if value else None
    if isinstance(value, tuple):
        return value[0] / value[1] if value[1] else None
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None


def text(value: object) -> str | None:
    if isinstance(value, bytes):
        value = value.decode("ascii", "replace")
    return value.strip().strip("\0").strip() or None if isinstance(value, str) else None


def merged(directories: list[Directory]) -> Directory:
    """One directory; the first that has a tag counts."""
    out: Directory = {}
    for d in directories:
        out = d | out
    return out


def capture_fields(tags: Directory) -> dict[str, object]:
    """What capture columns are made of, from one flat directory."""
    get = lambda name: tags.get(TAGS[name])
    iso = number(get("iso") if get("iso") is not None else get("panasonic_iso"))
    turn = number(get("orientation"))
    return {
        "make": text(get("make")), "model": text(get("model")), "lens": text(get("lens")), "iso": None if iso is None else int(iso), "aperture": number(get("f_number")),
        "shutter_seconds": number(get("exposure_time")), "focal_length": number(get("focal_length")), "focal_length_35mm": number(get("focal_35mm")),
        "timestamp": text(get("taken")), "orientation": int(turn) if turn is not None and 1 <= turn <= 8 else None,
    }
