"""Settings: sections of validated keys, read from TOML; unknown sections and keys are errors."""

from __future__ import annotations

import tomllib
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from pathlib import Path
from types import SimpleNamespace
from typing import Any

from sharpsieve.errors import ConfigError

FILE_NAME = "sharpsieve.toml"
#: Suffixes of raw and of plain images.
RAW = frozenset(".nef .nrw .cr2 .cr3 .arw .srf .sr2 .dng .raf .rw2 .orf .pef".split())
PLAIN = frozenset(".jpg .jpeg .png .tif .tiff .webp .bmp".split())
DETECTORS = ("manual", "af-point", "face", "saliency", "zone", "none")
#: Named regions as x, y, w, h.
ZONES = {
    "center": (0.30, 0.30, 0.40, 0.40),
    "center-small": (0.40, 0.40, 0.20, 0.20),
    "center-wide": (0.20, 0.20, 0.60, 0.60),
    "upper-third": (0.25, 0.08, 0.50, 0.42),
    "lower-third": (0.25, 0.50, 0.50, 0.42),
    "left-third": (0.08, 0.25, 0.42, 0.50),
    "right-third": (0.50, 0.25, 0.42, 0.50),
}
FORMATS = ("json", "csv", "html", "keepers", "rejects", "xmp")


@dataclass(frozen=True)
class Rule:
    """A condition, and the stars (none: an annotation), label and reason that it gives."""

    when: str
    stars: int | None = None
    label: str | None = None
    reason: str = ""


#: The condition under which figures about the subject count as evidence.
INDEPENDENT = 'subject_confidence in ["high", "medium"]'
#: The default rules, in order.
DEFAULT_RULES = (
    Rule("highlight_clipped > 0.05", None, "yellow", "highlights clipped beyond recovery - your call whether that matters"),
    Rule("max_local_acutance < 12", 1, "red", "nothing in the frame is sharp"),
    Rule(f"{INDEPENDENT} and subject_background_ratio < 0.9", 2, "yellow", "background is sharper than the subject - focus missed"),
    Rule(f"is_group_best and {INDEPENDENT} and subject_background_ratio >= 1.5", 5, "green", "best frame of its group, and focus landed on the subject"),
    Rule(f"{INDEPENDENT} and subject_background_ratio >= 3", 5, "green", "subject clearly sharper than its background"),
    Rule("is_group_best", 4, "green", "best frame of its group"),
    Rule(f"{INDEPENDENT} and subject_background_ratio >= 1.5", 4, "green", "focus landed on the subject rather than behind it"),
    Rule("group_size > 1 and not is_group_best", 3, None, "a near-duplicate beat this frame"),
    Rule("max_local_acutance >= 25", 3, None, "acceptably sharp somewhere"),
    Rule("True", 2, None, "no rule matched strongly"),
)


def _number(kind: type, low: float | None = None, high: float | None = None, *, above: bool = False, below: bool = False) -> Callable[[Any], Any]:
    def check(value: Any) -> Any:
        good = isinstance(value, int if kind is int else (int, float)) and not isinstance(value, bool)
        good = good and (low is None or (value > low if above else value >= low)) and (high is None or (value < high if below else value <= high))
        if not good:
            raise ValueError(f"must be {'an integer' if kind is int else 'a number'}" + (f" {'above' if above else 'of at least'} {low}" if low is not None else "") + (f" and {'below' if below else 'at most'} {high}" if high is not None else ""))
        return kind(value)

    return check


def _flag(value: Any) -> bool:
    return bool(value)


def _text(value: Any) -> str:
    return str(value)


def _names(known: tuple[str, ...] | None) -> Callable[[Any], tuple[str, ...]]:
    def check(value: Any) -> tuple[str, ...]:
        value = [value] if isinstance(value, str) else value
        if not isinstance(value, (list, tuple)) or not value:
            raise ValueError("must be a non-empty list of names")
        names = tuple(map(str, value))
        if known is not None and (odd := [x for x in names if x not in known]):
            raise ValueError(f"unknown name '{odd[0]}'; known: {', '.join(known)}")
        return names

    return check


def _suffixes(value: Any) -> tuple[str, ...]:
    value = [value] if isinstance(value, str) else value
    if not isinstance(value, (list, tuple)):
        raise ValueError("must be a list of suffixes")
    return tuple("." + str(x).lower().lstrip(".") for x in value)


def _zone(value: Any) -> str:
    if value not in ZONES:
        raise ValueError(f"unknown zone '{value}'; choose from {sorted(ZONES)}")
    return value


def _rules(value: Any) -> tuple[Rule, ...]:
    out = []
    for k, raw in enumerate(value or []):
        if not isinstance(raw, Mapping) or "when" not in raw:
            raise ValueError(f"#{k + 1} needs a 'when' expression")
        if odd := set(raw) - {"when", "stars", "label", "reason"}:
            raise ValueError(f"#{k + 1} has unknown keys {sorted(odd)}")
        stars = raw.get("stars")
        if stars is not None and (not isinstance(stars, int) or isinstance(stars, bool) or not 0 <= stars <= 5):
            raise ValueError(f"#{k + 1}: stars must be 0 to 5, got {stars!r}")
        out.append(Rule(str(raw["when"]), stars, str(raw["label"]) if raw.get("label") else None, str(raw.get("reason", ""))))
    return tuple(out) or DEFAULT_RULES


_fraction, _positive = _number(float, 0, 1), _number(int, 0, above=True)
#: Every section's keys, with default (fixed values) and check.
SECTIONS: dict[str, dict[str, tuple[Any, Callable[[Any], Any]]]] = {
    "input": {"working_edge": (1024, _positive), "thumbnail_edge": (320, _positive), "recursive": (True, _flag), "prefer_raw_decode": (False, _flag), "include_suffixes": ((), _suffixes)},
    "sharpness": {"grid_long_edge": (24, _positive), "sharp_fraction_threshold": (0.5, _fraction), "sharp_acutance": (40.0, _number(float, 0, above=True)), "min_background_acutance": (2.0, _number(float, 0))},
    "exposure": {"percentile": (0.5, _number(float, 0, 50, below=True))},
    "subject": {
        "detectors": (("manual", "af-point", "face", "saliency"), _names(DETECTORS)), "zone": ("center", _zone), "prefer_eyes": (True, _flag),
        "sidecar": ("sharpsieve-subjects.json", _text), "face_score": (0.9, _fraction), "face_min_size": (0.05, _fraction),
    },
    "grouping": {"enabled": (True, _flag), "hash_size": (8, _positive), "max_distance": (10, _number(int, 0)), "max_time_gap_seconds": (0.0, _number(float, 0))},
    "rating": {"rank_by": ("subject_or_max_acutance", _text), "rules": (DEFAULT_RULES, _rules)},
    "output": {
        "formats": (("json", "csv", "html"), _names(FORMATS)), "directory": ("sharpsieve-report", _text), "include_tile_map": (False, _flag),
        "write_xmp_next_to_originals": (False, _flag), "open_html": (False, _flag), "self_contained_max_frames": (1500, _positive),
    },
}


@dataclass
class Config:
    """One namespace for each section, as attributes."""

    sections: dict[str, SimpleNamespace] = field(default_factory=dict)
    source: str | None = None

    def __post_init__(self) -> None:
        self.sections = {s: self.sections.get(s) or SimpleNamespace(**{k: d for k, (d, _) in keys.items()}) for s, keys in SECTIONS.items()}

    def __getattr__(self, name: str) -> SimpleNamespace:
        if name in SECTIONS:
            return self.__dict__["sections"][name]
        raise AttributeError(name)

    def __getstate__(self) -> dict:
        return self.__dict__

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)

    def with_values(self, **values: Any) -> "Config":
        """A copy with other values, given as section__key, checked like a file's."""
        data: dict[str, dict[str, Any]] = {}
        for name, value in values.items():
            section, _, key = name.partition("__")
            data.setdefault(section, {})[key] = value
        fresh = from_dict(data)
        merged = {s: SimpleNamespace(**(vars(self.sections[s]) | {k: getattr(fresh.sections[s], k) for k in data.get(s, {})})) for s in SECTIONS}
        return Config(merged, self.source)


def from_dict(data: Mapping[str, Any], source: str | None = None) -> Config:
    if odd := set(data) - set(SECTIONS):
        raise ConfigError(f"unknown section [{sorted(odd)[0]}]; known: {', '.join(SECTIONS)}")
    sections = {}
    for name, keys in SECTIONS.items():
        given = data.get(name, {})
        if not isinstance(given, Mapping):
            raise ConfigError(f"[{name}] must be a table")
        if odd := set(given) - set(keys):
            raise ConfigError(f"[{name}] has unknown key '{sorted(odd)[0]}'; known: {', '.join(keys)}")
        values = {}
        for key, (default, check) in keys.items():
            try:
                values[key] = check(given[key]) if key in given else default
            except ValueError as error:
                raise ConfigError(f"[{name}].{key} {error}") from None
        sections[name] = SimpleNamespace(**values)
    return Config(sections, source)


def load(path: str | Path) -> Config:
    try:
        data = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, tomllib.TOMLDecodeError) as error:
        raise ConfigError(f"can't read config {path}: {error}") from error
    return from_dict(data, str(path))


def discover(start: str | Path) -> Config:
    """The nearest file upwards from a folder, or the defaults."""
    here = Path(start).resolve()
    for folder in (here, *here.parents):
        if (folder / FILE_NAME).is_file():
            return load(folder / FILE_NAME)
    return Config()


def default_toml() -> str:
    """The defaults as a file."""

    def said(value: Any) -> str:
        if isinstance(value, bool):
            return str(value).lower()
        if isinstance(value, str):
            return '"' + value.replace("\\", "\\\\").replace('"', '\\"') + '"'
        return "[" + ", ".join(map(said, value)) + "]" if isinstance(value, tuple) else repr(value)

    lines = []
    for name, keys in SECTIONS.items():
        lines += [f"[{name}]", *(f"{k} = {said(d)}" for k, (d, _) in keys.items() if k != "rules"), ""]
    for rule in DEFAULT_RULES:
        given = {k: v for k, v in vars(rule).items() if v not in (None, "")}
        lines += ["[[rating.rules]]", *(f"{k} = {said(v)}" for k, v in given.items()), ""]
    return "\n".join(lines)
