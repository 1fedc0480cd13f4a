"""Settings: arguments over environment over a TOML file over defaults."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields, is_dataclass, replace

PREFIX = "SIEVEWRIGHT"
FILE = "sievewright.toml"


@dataclass(frozen=True)
class Identity:
    contact: str = ""
    name: str = "sievewright"

    @property
    def user_agent(self) -> str:
        return f"{self.name}/0.1 (+{self.contact})" if self.contact else f"{self.name}/0.1"


@dataclass(frozen=True)
class FetchSettings:
    partitions: int = 200
    min_host_delay: float = 1.0
    retries: int = 3
    max_redirects: int = 5
    max_length: int = 5 * 1024 * 1024
    max_body: int = 20 * 1024 * 1024
    respect_robots: bool = True


@dataclass(frozen=True)
class ClassifySettings:
    mode: str = "off"
    provider: str = "off"
    base_url: str = ""
    api_key: str = ""
    model_small: str = "small"
    model_large: str = "large"
    accept_small: float = 0.75
    accept_large: float = 0.60
    parallel: int = 8


@dataclass(frozen=True)
class Settings:
    identity: Identity = field(default_factory=Identity)
    fetch: FetchSettings = field(default_factory=FetchSettings)
    classify: ClassifySettings = field(default_factory=ClassifySettings)
    taxonomy_path: str = ""

    def check_contact(self, allow_missing: bool = False) -> None:
        """A run that fetches names someone to write to."""
        if not self.identity.contact and not allow_missing:
            raise ConfigError("identity.contact is required")


class ConfigError(ValueError):
    pass


def _cast(old, value):
    if isinstance(old, bool):
        return value if isinstance(value, bool) else str(value).strip().lower() in ("1", "true", "yes", "on")
    try:
        return type(old)(value)
    except (TypeError, ValueError):
        raise ConfigError(f"bad value: {value!r}") from None


def _merge(base, given: dict):
    known = {f.name for f in fields(base)}
    unknown = set(given) - known
    if unknown:
        raise ConfigError(f"unknown settings: {sorted(unknown)}")
    new = {}
    for k, v in given.items():
        old = getattr(base, k)
        new[k] = _merge(old, v) if is_dataclass(old) else _cast(old, v)
    return replace(base, **new)


def find_file() -> str | None:
    for p in (FILE, os.path.join(os.path.expanduser("~"), ".config", "sievewright", FILE)):
        if os.path.exists(p):
            return p
    return None


def load(path: str | None = None, env: dict | None = None, **overrides) -> Settings:
    """``overrides`` are section__name=value; environment names are SIEVEWRIGHT_SECTION__NAME."""
    s = Settings()
    path = path or find_file()
    if path:
        try:
            with open(path, "rb") as f:
                s = _merge(s, tomllib.load(f))
        except (OSError, tomllib.TOMLDecodeError) as e:
            raise ConfigError(str(e)) from None
    env = dict(os.environ) if env is None else env
    named = {k[len(PREFIX) + 1 :].lower(): v for k, v in env.items() if k.startswith(PREFIX + "_")}
    for source in (named, {k: v for k, v in overrides.items() if v is not None}):
        tree: dict = {}
        for k, v in source.items():
            section, _, name = k.partition("__")
            if name:
                tree.setdefault(section, {})[name] = v
            else:
                tree[section] = v
        s = _merge(s, tree)
    return s
