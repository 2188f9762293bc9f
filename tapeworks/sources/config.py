"""Configuration files, their fingerprints, and the environment a run was made in."""

from __future__ import annotations

import hashlib
import json
import platform
import subprocess
import sys
from datetime import UTC, datetime


class ConfigError(ValueError):
    pass


def load(path: str) -> dict:
    """A mapping from a JSON file or, where a YAML parser is installed, a YAML one."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as error:
            raise ConfigError(f"no YAML parser is installed for {path}; use JSON") from error
        out = yaml.safe_load(text)
    else:
        try:
            out = json.loads(text)
        except json.JSONDecodeError as error:
            raise ConfigError(f"{path}: {error}") from error
    if not isinstance(out, dict):
        raise ConfigError(f"{path} must hold a mapping")
    return out


def require(config: dict, name: str, kind: type, least=None):
    """A value that must be there, of its type and not under ``least``; ``name`` may be dotted."""
    here = config
    for part in name.split("."):
        if not isinstance(here, dict) or part not in here:
            raise ConfigError(f"{name} is missing")
        here = here[part]
    if not isinstance(here, kind) or isinstance(here, bool) and kind is not bool:
        raise ConfigError(f"{name} must be {kind.__name__}, not {here!r}")
    if least is not None and here < least:
        raise ConfigError(f"{name} must be {least} at least, not {here!r}")
    return here


def fingerprint(config: dict) -> str:
    """The first 16 hex digits of the sha256 of the sorted JSON; the order of keys doesn't matter."""
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:16]


def environment(spark=None, folder: str = ".") -> dict:
    """Versions, platform, time and the state of the working copy; what can't be told is null."""

    def git(*words: str) -> str | None:
        try:
            done = subprocess.run(["git", "-C", folder, *words], capture_output=True, text=True, timeout=10, check=True)
        except (OSError, subprocess.SubprocessError):
            return None
        return done.stdout.strip()

    changed = git("status", "--porcelain")
    return {
        "python": sys.version.split()[0],
        "platform": platform.platform(),
        "spark": None if spark is None else spark.version,
        "git_commit": git("rev-parse", "HEAD"),
        "git_dirty": None if changed is None else bool(changed),
        "recorded_at_utc": datetime.now(UTC).isoformat(timespec="seconds"),
    }
