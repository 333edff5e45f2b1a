"""The boundary to a text model."""

from __future__ import annotations

import json
import re
import urllib.error
import urllib.request
from abc import ABC, abstractmethod
from collections.abc import Callable

from sourceloom.config import ModelConfig
from sourceloom.logs import get_logger

log = get_logger("provider")


class ProviderError(RuntimeError):
    """The provider gave no completion."""


class Provider(ABC):
    @abstractmethod
    def is_available(self) -> bool:
        """Cheap check that the model can be asked."""

    @abstractmethod
    def generate(self, prompt: str, system: str | None = None) -> str:
        """Completion of a prompt; raises ProviderError."""


class OllamaProvider(Provider):
    """A model behind the HTTP interface of an Ollama daemon."""

    def __init__(self, config: ModelConfig, open_url: Callable = urllib.request.urlopen):
        self.config, self._open = config, open_url

    def _ask(self, path: str, body: dict | None, timeout: float) -> dict:
        data = None if body is None else json.dumps(body).encode()
        request = urllib.request.Request(f"{self.config.host}{path}", data, {"Content-Type": "application/json"})
        with self._open(request, timeout=timeout) as answer:
            return json.loads(answer.read())

    def is_available(self) -> bool:
        try:
            listed = self._ask("/api/tags", None, timeout=5).get("models", [])
        except (OSError, ValueError) as problem:
            log.warning("no answer from %s: %s", self.config.host, problem)
            return False
        names = {m.get("model") or m.get("name") for m in listed}
        if self.config.name not in names:
            log.warning("model %s is not among %s", self.config.name, sorted(filter(None, names)))
        return self.config.name in names

    def generate(self, prompt: str, system: str | None = None) -> str:
        c = self.config
        body = {
            "model": c.name, "prompt": prompt, "stream": False, "think": not c.suppress_thinking,
            "options": {"temperature": c.temperature, "num_ctx": c.num_ctx},
        }
        if system:
            body["system"] = system
        try:
            answer = self._ask("/api/generate", body, c.timeout_seconds)
        except (OSError, ValueError) as problem:
            raise ProviderError(f"model {c.name} at {c.host}: {problem}") from problem
        return without_thinking(answer.get("response", ""))


def without_thinking(text: str) -> str:
    return re.sub(r"<think>.*?</think>", "", text, flags=re.DOTALL).strip()


_PROVIDERS: dict[str, Callable[[ModelConfig], Provider]] = {"ollama": OllamaProvider}


def register_provider(name: str, factory: Callable[[ModelConfig], Provider]) -> None:
    _PROVIDERS[name] = factory


def available_providers() -> list[str]:
    return list(_PROVIDERS)


def get_provider(config: ModelConfig) -> Provider:
    if config.provider not in _PROVIDERS:
        raise ValueError(f"unknown provider {config.provider!r}; available: {', '.join(available_providers())}")
    return _PROVIDERS[config.provider](config)
