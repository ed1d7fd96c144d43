"""What this library raises on purpose."""


class SieveError(Exception):
    """Any error that is shown as one line."""


class ConfigError(SieveError):
    """A setting, path or input file that can't be used."""


class RuleError(ConfigError):
    """A rule that doesn't parse, names something unknown, or mixes kinds of values."""


class UnreadableImage(SieveError):
    """A file that can't be decoded; it becomes a row with this message."""
