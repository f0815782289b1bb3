"""Settings from the environment and a .env file, and JSON log lines."""

from __future__ import annotations

import json
import os
import sys
from collections.abc import Mapping
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import TextIO
from urllib.parse import unquote, urlsplit

LEVELS = ("debug", "info", "warn", "error")


@dataclass(frozen=True)
class Proxy:
    server: str
    username: str | None = None
    password: str | None = None


@dataclass(frozen=True)
class Config:
    base_url: str = ""
    store: str = "artifacts"
    out: str = "out"
    concurrency: int = 3
    max_pages: int = 2000
    nav_timeout_ms: int = 30_000
    idle_timeout_ms: int = 8_000
    log_level: str = "info"
    proxy: Proxy | None = None
    token_prefix: str = "TOKEN"


def read_env(path: str) -> dict[str, str]:
    """NAME=value lines; comments, blanks and lines without = are passed over, quotes around a value taken off."""
    out: dict[str, str] = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            for line in map(str.strip, f):
                name, eq, value = line.partition("=")
                if eq and name.strip() and line[0] != "#":
                    value = value.strip()
                    out[name.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
    return out


def parse_proxy(raw: str | None) -> Proxy | None:
    if not raw or not raw.strip():
        return None
    u = urlsplit(raw.strip() if "://" in raw else f"http://{raw.strip()}")
    if not u.hostname:
        raise ValueError("a proxy needs a host")
    server = f"{u.scheme}://{u.hostname}" + (f":{u.port}" if u.port else "")
    return Proxy(server, unquote(u.username) if u.username else None, unquote(u.password) if u.password else None)


def number(raw: str | None, default: int) -> int:
    """A finite number, else the default."""
    try:
        return int(float(raw)) if raw not in (None, "") else default
    except (ValueError, OverflowError):
        return default


def load(env: Mapping[str, str] | None = None, path: str = ".env") -> Config:
    """The environment goes before the file."""
    e = {**read_env(path), **(os.environ if env is None else env)}
    return Config(
        e.get("BASE_URL", ""), e.get("STORE_DIR", "artifacts"), e.get("OUT_DIR", "out"), max(1, number(e.get("CONCURRENCY"), 3)), number(e.get("MAX_PAGES"), 2000),
        number(e.get("NAV_TIMEOUT_MS"), 30_000), number(e.get("IDLE_TIMEOUT_MS"), 8_000), e.get("LOG_LEVEL", "info"), parse_proxy(e.get("PROXY")), e.get("TOKEN_PREFIX", "TOKEN"),
    )


class Logger:
    """One JSON object a line, with the bindings of the logger and its parents; lower levels than its own are dropped."""

    def __init__(self, level: str = "info", to: TextIO | None = None, **bindings):
        self.least, self.to, self.bindings = LEVELS.index(level) if level in LEVELS else 1, to, bindings

    def child(self, **more) -> Logger:
        return Logger(LEVELS[self.least], self.to, **{**self.bindings, **more})

    def log(self, level: str, message: str, **fields) -> None:
        if LEVELS.index(level) >= self.least:
            stamp = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"
            print(json.dumps({"time": stamp, "level": level, "message": message, **self.bindings, **fields}, default=str), file=self.to or sys.stderr)
