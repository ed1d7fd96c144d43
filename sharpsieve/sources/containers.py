"""Camera containers: which wrapper a file has, its largest embedded JPEG, its metadata and its true size."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from sharpsieve.errors import UnreadableImage
from sharpsieve.sources.bytes import Source
from sharpsieve.sources.tiff import NOWHERE, TAGS, Directory, Place, Tiff, number

#: Fixed values of the formats.
RAF_MAGIC = b"FUJIFILMCCD-RAW "
RAF_JPEG_AT, RAF_SENSOR_AT, RAF_HEAD = 84, 92, 108
RAF_FULL, RAF_CROPPED, RAF_MOST_TAGS = 0x0100, 0x0111, 256
CR3_METADATA = bytes.fromhex("85c0b687820f11e08111f4ce462b6a48")
CR3_PREVIEW = bytes.fromhex("eaf42b5e1c984b88b9fbb7dc406e4d16")
CR3_NESTS = ("moov", "trak", "mdia", "minf", "stbl", "CCTP")
MOST_BOXES, DEEPEST, MOST_PADDING, MARKER_WITHIN = 4096, 8, 16, 64
JPEG_COMPRESSIONS = (6, 7)


@dataclass
class Preview:
    offset: int
    length: int
    width: int | None = None
    height: int | None = None

    @property
    def extent(self) -> int:
        return self.width * self.height if self.width and self.height else self.length


@dataclass
class Layout:
    previews: list[Preview] = field(default_factory=list)
    directories: list[Directory] = field(default_factory=list)
    size: tuple[int, int] | None = None

    @property
    def largest(self) -> Preview | None:
        return max(self.previews, key=lambda p: p.extent, default=None)


def sniff(head: bytes) -> str:
    """raf, cr3 or tiff, by the first 16 bytes."""
    return "raf" if head.startswith(RAF_MAGIC) else "cr3" if head[4:8] == b"ftyp" else "tiff"


def read_layout(source: Source) -> Layout:
    """What a raw file holds; raises UnreadableImage if it is no container that is known."""
    kind = sniff(source.at(0, 16))
    try:
        layout = {"raf": _raf, "cr3": _cr3, "tiff": _plain}[kind](source)
    except (ValueError, OSError) as error:
        raise UnreadableImage(f"not a readable raw container ({error})") from error
    layout.size = layout.size or _declared(layout.directories)
    return layout


def _plain(source: Source) -> Layout:
    found = list(Tiff(source))
    return Layout([p for d in found if (p := _preview(d, 0))], found)


def _add_block(layout: Layout, source: Source, base: int) -> None:
    """Directories and previews of a TIFF block inside a container; an unreadable block is passed over."""
    try:
        found = list(Tiff(source, base))
    except ValueError:
        return
    layout.directories += found
    layout.previews += [p for d in found if (p := _preview(d, base))]


def _preview(directory: Directory, base: int) -> Preview | None:
    """The JPEG that a directory points at."""
    size = [number(directory.get(TAGS[x])) or number(directory.get(TAGS[f"panasonic_{x}"])) for x in ("width", "height")]
    width, height = (int(x) if x else None for x in size)
    blob = directory.get(TAGS["panasonic_jpeg"])
    if isinstance(blob, Place) and blob.length:
        return Preview(blob.offset, blob.length)
    pairs = [("jpeg_offset", "jpeg_length")]
    if number(directory.get(TAGS["compression"])) in JPEG_COMPRESSIONS:
        pairs.append(("strip_offsets", "strip_counts"))
    for where, extent in pairs:
        offset, length = directory.get(TAGS[where]), directory.get(TAGS[extent])
        if isinstance(offset, int) and isinstance(length, int) and 0 < offset < NOWHERE and length > 0:
            return Preview(base + offset, length, width, height)
    return None


def _declared(directories: list[Directory]) -> tuple[int, int] | None:
    """The largest size that any directory states."""
    sizes = []
    for d in directories:
        w, h = (number(d.get(TAGS[x])) or number(d.get(TAGS[f"panasonic_{x}"])) for x in ("width", "height"))
        if w and h and w > 0 and h > 0:
            sizes.append((int(w), int(h)))
    return max(sizes, key=lambda s: s[0] * s[1], default=None)


def exif_base(source: Source, start: int, length: int) -> int | None:
    """Where the TIFF block of a JPEG's Exif segment starts."""
    if source.at(start, 2) != b"\xff\xd8":
        return None
    spot = start + 2
    while spot < start + length:
        marker = source.at(spot, 2)
        if len(marker) < 2 or marker[0] != 0xFF or marker[1] == 0xDA:
            return None
        if marker[1] in (0xD8, 0xD9) or 0xD0 <= marker[1] <= 0xD7:
            spot += 2
            continue
        size = source.unpack(">H", spot + 2)
        if size is None or size[0] < 2:
            return None
        if marker[1] == 0xE1 and source.at(spot + 4, 6) == b"Exif\0\0":
            return spot + 10
        spot += 2 + size[0]
    return None


def _raf(source: Source) -> Layout:
    if source.size < RAF_HEAD:
        raise ValueError("the RAF header is cut short")
    offset, length = source.unpack(">II", RAF_JPEG_AT)
    if not offset or not length or offset + length > source.size:
        raise ValueError("the RAF header points at no JPEG")
    layout = Layout([Preview(offset, length)])
    base = exif_base(source, offset, length)
    if base is not None:
        _add_block(layout, source, base)
    sensor, extent = source.unpack(">II", RAF_SENSOR_AT)
    if sensor and extent and sensor + extent <= source.size:
        sizes = dict(_raf_sizes(source, sensor, extent))
        layout.size = sizes.get(RAF_CROPPED) or sizes.get(RAF_FULL)
    return layout


def _raf_sizes(source: Source, start: int, extent: int) -> Iterator[tuple[int, tuple[int, int]]]:
    """The sizes in the sensor header's tag list, which has heights first."""
    head = source.unpack(">I", start)
    spot = start + 4
    for _ in range(min(head[0], RAF_MOST_TAGS) if head else 0):
        entry = source.unpack(">HH", spot)
        if entry is None or spot + 4 > start + extent:
            return
        tag, size = entry
        if tag in (RAF_FULL, RAF_CROPPED) and size == 4:
            height, width = source.unpack(">HH", spot + 4) or (0, 0)
            if width and height:
                yield tag, (width, height)
        spot += 4 + size


def _cr3(source: Source) -> Layout:
    layout = Layout()
    for name, start, length in _boxes(source, 0, source.size, 0):
        if name in ("CMT1", "CMT2", "CMT3", "CMT4"):
            _add_block(layout, source, start)
        elif name in ("PRVW", "THMB"):
            skip = source.at(start, min(MARKER_WITHIN, length)).find(b"\xff\xd8\xff")
            if skip >= 0:
                layout.previews.append(Preview(start + skip, length - skip))
    if not layout.previews and not layout.directories:
        raise ValueError("no metadata or preview box")
    return layout


def _boxes(source: Source, spot: int, end: int, depth: int) -> Iterator[tuple[str, int, int]]:
    """(name, start, length) of the payload of each box that holds no boxes."""
    for _ in range(MOST_BOXES if depth <= DEEPEST else 0):
        head = source.unpack(">I4s", spot) if spot + 8 <= end else None
        if head is None:
            return
        size, name, payload = head[0], head[1].decode("ascii", "replace"), spot + 8
        if size == 1:
            wide = source.unpack(">Q", payload)
            if wide is None:
                return
            size, payload = wide[0], payload + 8
        elif size == 0:
            size = end - spot
        if size < 8 or spot + size > end:
            return
        inner = payload + 16 if name == "uuid" else payload
        if name in CR3_NESTS or name == "uuid" and source.at(payload, 16) in (CR3_METADATA, CR3_PREVIEW):
            yield from _boxes(source, _first_box(source, inner, spot + size), spot + size, depth + 1)
        elif name != "uuid":
            yield name, payload, spot + size - payload
        spot += size


def _first_box(source: Source, start: int, end: int) -> int:
    """Where the first box starts, behind up to 16 bytes of padding."""
    for spot in range(start, start + MOST_PADDING + 1, 4):
        head = source.unpack(">I4s", spot) if spot + 8 <= end else None
        if head and 8 <= head[0] <= end - spot and all(32 <= c < 127 for c in head[1]):
            return spot
    return start
