"""Languages: name -> file extensions and the scan function run inside tasks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from sourceloom.sources.java import scan_java


@dataclass(frozen=True)
class Language:
    name: str
    extensions: tuple[str, ...]
    scan: Callable[[str], dict]


_LANGUAGES: dict[str, Language] = {}


def register_language(language: Language) -> None:
    _LANGUAGES[language.name] = language


register_language(Language("java", (".java",), scan_java))


def available_languages() -> list[str]:
    return list(_LANGUAGES)


def get_language(name: str) -> Language:
    if name not in _LANGUAGES:
        raise ValueError(f"unknown language {name!r}; available: {', '.join(available_languages())}")
    return _LANGUAGES[name]


def language_extensions(names: list[str]) -> set[str]:
    return {e for n in names for e in get_language(n).extensions}


def language_for_extension(extension: str, names: list[str]) -> Language | None:
    """The first of `names` that claims the extension."""
    return next((lang for lang in map(get_language, names) if extension in lang.extensions), None)
