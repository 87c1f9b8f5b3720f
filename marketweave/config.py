"""Settings: init arguments over environment over .env over YAML over defaults."""

from __future__ import annotations

import logging
import os
from collections.abc import Mapping
from dataclasses import dataclass, fields
from datetime import UTC, date, datetime, timedelta
from pathlib import Path
from typing import Any

from marketweave.errors import PermanentError

#: Fixed defaults of the two bar pipelines.
DAILY = {"interval": "1d", "batch_size": 100, "sleep_seconds": 10, "history_floor": date(2000, 1, 1), "table": "ohlcv_1d"}
MINUTE = {"interval": "1m", "batch_size": 100, "sleep_seconds": 10, "history_floor": None, "table": "ohlcv_1min"}
MINUTE_HISTORY_DAYS = 7
ENV_PREFIX = "YAHOO_"


def read_flat_yaml(path: str | Path) -> dict[str, str]:
    """Top-level ``key: value`` pairs of a YAML file (all the settings need)."""
    out: dict[str, str] = {}
    for line in Path(path).read_text().splitlines():
        key, colon, value = line.partition(":")
        if colon and key and not key[0].isspace() and not key.startswith("#"):
            value = value.strip()
            out[key.strip()] = value[1:].partition(value[0])[0] if value[:1] in "\"'" and value else value.partition(" #")[0].strip()
    return out


def read_dotenv(path: str | Path) -> dict[str, str]:
    if not Path(path).exists():
        return {}
    pairs = (x.partition("=") for x in Path(path).read_text().splitlines() if "=" in x and not x.lstrip().startswith("#"))
    return {k.strip().removeprefix("export ").strip(): v.strip().strip("\"'") for k, _, v in pairs}


@dataclass(frozen=True)
class BarConfig:
    interval: str
    batch_size: int
    sleep_seconds: float
    history_floor: date
    table: str

    @classmethod
    def load(
        cls, kind: str = "daily", yaml: str | Path | None = None, env: Mapping[str, str] | None = None, dotenv: str | Path | None = None, now: datetime | None = None, **init: Any
    ) -> BarConfig:
        """Each setting from the first place that has it."""
        if kind not in ("daily", "minute"):
            raise PermanentError(f"no such kind of bars: {kind}")
        values: dict[str, Any] = dict(DAILY if kind == "daily" else MINUTE)
        if values["history_floor"] is None:  # evaluated for each instance
            values["history_floor"] = ((now or datetime.now(UTC)) - timedelta(days=MINUTE_HISTORY_DAYS)).date()
        values |= read_flat_yaml(yaml) if yaml else {}
        outside = (read_dotenv(dotenv) if dotenv else {}) | dict(os.environ if env is None else env)
        lowered = {k.upper(): v for k, v in outside.items()}
        values |= {f.name: lowered[name] for f in fields(cls) if (name := f"{ENV_PREFIX}{f.name.upper()}") in lowered}
        values |= init
        floor = values["history_floor"]
        return cls(
            str(values["interval"]),
            int(values["batch_size"]),
            float(values["sleep_seconds"]),
            floor if isinstance(floor, date) else date.fromisoformat(str(floor)),
            str(values["table"]),
        )


@dataclass(frozen=True)
class CoreConfig:
    """Secrets, from the environment or .env only."""

    postgres_url: str | None = None
    sec_user_agent: str | None = None

    @classmethod
    def load(cls, env: Mapping[str, str] | None = None, dotenv: str | Path | None = ".env", **init: Any) -> CoreConfig:
        outside = (read_dotenv(dotenv) if dotenv else {}) | dict(os.environ if env is None else env)
        lowered = {k.lower(): v for k, v in outside.items()}
        return cls(**({f.name: lowered.get(f.name) for f in fields(cls)} | init))


def log_to_stderr(level: int | str = logging.INFO) -> logging.Logger:
    """The engine's own logger, at a level; other loggers stay as they are."""
    engine = logging.getLogger("marketweave")
    engine.setLevel(level)
    if not engine.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("{asctime} {levelname:<7} {name}: {message}", style="{"))
        engine.addHandler(handler)
    return engine
