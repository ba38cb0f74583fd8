"""Settings, registries, and small driver-side helpers."""

import dataclasses
import hashlib
import json
import logging
import uuid
import warnings
from dataclasses import dataclass, field

#: Log levels by name.
LEVELS = {"CRITICAL": 50, "ERROR": 40, "WARNING": 30, "INFO": 20, "DEBUG": 10, "NOTSET": 0}


@dataclass
class JobSettings:
    """A job's settings; unknown keys are kept in `extra`, with a warning."""

    input_name: str = "input"
    output_name: str = "output"
    id_name: str = "id"
    batch_size: int = 10
    max_input: int | None = None
    max_output: int | None = None
    seed: int = 42
    keep_checkpoints: int = 0
    baseline: str = "running"
    extra: dict = field(default_factory=dict)

    @classmethod
    def of(cls, **values) -> "JobSettings":
        known = {f.name for f in dataclasses.fields(cls)} - {"extra"}
        out = cls(**{k: v for k, v in values.items() if k in known})
        for k in values.keys() - known:
            warnings.warn(f"unknown setting {k!r}", stacklevel=2)
            out.extra[k] = values[k]
        return out


def overlaid(defaults: dict, hparams: dict | str | None = None, arguments: dict | None = None) -> dict:
    """Settings in layers: defaults, then a JSON file's (a dict or text), then arguments that are given (not None)."""
    middle = json.loads(hparams) if isinstance(hparams, str) else hparams or {}
    return {**defaults, **middle, **{k: v for k, v in (arguments or {}).items() if v is not None}}


class Registry:
    """Names to classes or functions; an unknown name is an error that lists the known ones."""

    def __init__(self, kind: str):
        self.kind, self.items = kind, {}

    def add(self, name: str):
        def put(x):
            self.items[name] = x
            return x

        return put

    def __getitem__(self, name: str):
        if name not in self.items:
            raise KeyError(f"no {self.kind} {name!r}; there are {sorted(self.items)}")
        return self.items[name]


def log_level(name: str | None) -> int:
    return LEVELS.get((name or "").upper(), logging.NOTSET)


def run_id() -> str:
    """16 random characters that name a run."""
    return uuid.uuid4().hex[:16]


def length_range(longest: int, lower: int) -> tuple[int, int]:
    """The bounds of a batch's random output length."""
    return max(50, longest - 100), max(longest, lower + 50)


def random_length(seed: int, batch: int, longest: int, lower: int) -> int:
    """A batch's random output length within `length_range`, from the md5 of seed and batch, so that any engine repeats it."""
    low, high = length_range(longest, lower)
    return low + int(hashlib.md5(f"{seed}:{batch}".encode()).hexdigest()[:8], 16) % (high - low + 1)


class JudgeError(Exception):
    """A judge's failure: the wrapped error's text and class, and whether it was graceful or unexpected."""

    def __init__(self, error: str, error_class: str, error_type: str = "unexpected"):
        super().__init__(error)
        self.error, self.error_class, self.error_type = error, error_class, error_type

    def row(self) -> dict:
        return {"error": self.error, "error_class": self.error_class, "error_type": self.error_type}


def required(values: dict, *names: str) -> dict:
    """Checks a request's parameters; missing ones are an error that names them."""
    missing = [n for n in names if values.get(n) in (None, "")]
    if missing:
        raise ValueError(f"missing parameters: {', '.join(missing)}")
    return values
