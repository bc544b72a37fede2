"""Options of a run: defaults, a configuration file with profiles, explicit values."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import Path

#: Defaults by detector family, and the layouts' options.
THRESHOLDS = {"ten": 0.75, "silero": 0.45}
PRESETS = {
    "standard": {"max_line_width": 42, "max_line_count": 2, "sentence": True},
    "standard_asia": {"max_line_width": 16, "max_line_count": 2, "sentence": True},
}
#: Options that a file may not set, as they choose the input, ask for an answer at once or steer the file itself.
BLOCKED = ("audio", "version", "checkcuda", "list_models", "config", "no_config", "profile", "config_override", "reconvert")
#: Keys that steer the file itself, and spellings of booleans.
STEERING = ("override", "active_profile", "profiles")
TRUE, FALSE = ("true", "yes", "on", "1"), ("false", "no", "off", "0")


class OptionError(ValueError):
    """A wrong option, with a message for its user."""


def threshold(method: str) -> float:
    """The speech threshold of a detector."""
    return THRESHOLDS["ten" if method == "ten" else "silero"]


def coerce(name: str, value: object, like: object, choices: tuple = ()) -> object:
    """``value`` as the type of the default ``like``; spelled booleans count, a single value is a list of one, a number with a
    fraction is no integer. A value outside ``choices``, if there are any, is an error."""
    got = _typed(name, value, like)
    for x in got if isinstance(got, list) else [got]:
        if choices and got is not None and x not in choices:
            raise OptionError(f"{name}: {x!r} is none of {', '.join(map(str, choices))}")
    return got


def _typed(name: str, value: object, like: object) -> object:
    if isinstance(like, bool):
        word = str(value).strip().lower()
        if word in TRUE or word in FALSE:
            return word in TRUE
        raise OptionError(f"{name}: {value!r} is no boolean")
    if like is None or value is None:
        return value
    if isinstance(like, (list, tuple)):
        value = list(value) if isinstance(value, (list, tuple)) else [value]
        if like and len(value) != len(like):
            raise OptionError(f"{name}: {len(like)} values are needed")
        return [_typed(name, v, d) for v, d in zip(value, like)] if like else value
    if isinstance(value, (list, tuple)):
        raise OptionError(f"{name}: takes no list")
    if isinstance(like, int) and (isinstance(value, bool) or isinstance(value, float) and not value.is_integer()):
        raise OptionError(f"{name}: {value!r} is no integer")
    try:
        return type(like)(value)
    except (TypeError, ValueError) as e:
        raise OptionError(f"{name}: {value!r} is no {type(like).__name__}") from e


def discover(explicit: str | None, folder: str, names: tuple[str, ...]) -> str | None:
    """The configuration file to use: the one that is asked for, which must exist, else the first of ``names`` in ``folder``."""
    if explicit:
        path = Path(explicit).expanduser()
        if not path.is_file():
            raise OptionError(f"no configuration file {explicit!r}")
        return str(path.resolve())
    return next((str((Path(folder) / n).resolve()) for n in names if (Path(folder) / n).is_file()), None)


def load(path: str) -> dict:
    """The mapping of a YAML file; an empty file is an empty one, anything else an error."""
    try:
        import yaml
    except ImportError as e:
        raise OptionError("a configuration file needs a YAML reader") from e
    raw = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if raw is None:
        return {}
    if not isinstance(raw, dict):
        raise OptionError(f"{path}: its top level must be a mapping")
    return raw


def resolve(defaults: Mapping, explicit: Mapping, config: Mapping, profile: str | None = None, blocked: tuple = BLOCKED, choices: Mapping | None = None) -> dict:
    """Defaults, then the file's keys, then its profile's; explicit values win unless the file overrides. Dashes are
    underscores. Presets fill what nobody set. Unknown and blocked keys are errors."""
    name = profile or config.get("active_profile")
    profiles = config.get("profiles") or {}
    if name and name not in profiles:
        raise OptionError(f"no profile {name!r}")
    flat = {k: v for k, v in config.items() if k not in STEERING} | dict(profiles.get(name) or {} if name else {})
    flat = {str(k).replace("-", "_"): v for k, v in flat.items()}
    for k in flat:
        if k not in defaults or k in blocked:
            raise OptionError(f"unknown option {k!r}" if k not in defaults else f"option {k!r} cannot be set in a file")
    given = {k: coerce(k, v, defaults[k], tuple((choices or {}).get(k, ()))) for k, v in flat.items()}
    out = dict(defaults) | given | ({} if config.get("override") else dict(explicit))
    set_keys = set(given) | set(explicit)
    for flag, values in PRESETS.items():
        if out.get(flag):
            out |= {k: v for k, v in values.items() if k not in set_keys}
    return out
