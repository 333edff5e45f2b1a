"""Settings: packaged defaults, then a project's YAML file, then overrides."""

from __future__ import annotations

import copy
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

# --- fixed values: defaults -----------------------------------------------------
DEFAULTS: dict[str, Any] = {
    "languages": ["java"],
    "exclude_patterns": [
        "**/build/**", "**/target/**", "**/.git/**", "**/node_modules/**", "**/*.min.js", ".sourceloom/**",
        "**/src/test/**", "**/Test*.java", "**/*Test.java", "**/*Tests.java", "**/*TestCase.java", "**/*IT.java",
    ],
    "output_dir": "docs/generated",
    "docs": ["README.md", "ARCHITECTURE.md", "SEQUENCE.md"],
    "model": {
        "provider": "ollama", "name": "qwen3:8b", "host": "http://localhost:11434", "temperature": 0.2,
        "num_ctx": 8192, "timeout_seconds": 600, "suppress_thinking": True,
    },
    "state_dir": ".sourceloom",
    "logging": {"level": "INFO", "file": None},
}
# --------------------------------------------------------------------------------


@dataclass
class ModelConfig:
    provider: str
    name: str
    host: str
    temperature: float
    num_ctx: int
    timeout_seconds: int
    suppress_thinking: bool


@dataclass
class LoggingConfig:
    level: str = "INFO"
    file: str | None = None


@dataclass
class Config:
    languages: list[str]
    exclude_patterns: list[str]
    output_dir: str
    docs: list[str]
    model: ModelConfig
    state_dir: str
    logging: LoggingConfig = field(default_factory=LoggingConfig)


def layered(base: dict, over: dict) -> dict:
    """`over` on top of `base`: mappings merge key by key, everything else is replaced."""
    both = copy.deepcopy(base)
    for key, value in over.items():
        nested = isinstance(value, dict) and isinstance(both.get(key), dict)
        both[key] = layered(both[key], value) if nested else value
    return both


def load_config(path: str | Path | None = None, overrides: dict[str, Any] | None = None) -> Config:
    settings = DEFAULTS
    if path is not None:
        import yaml

        settings = layered(settings, yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {})
    settings = layered(settings, overrides or {})
    return Config(
        **{
            **settings,
            "model": ModelConfig(**settings["model"]),
            "logging": LoggingConfig(**settings["logging"]),
        }
    )
