"""Settings from an environment's variables, checked; and the choice of a search provider by them."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from .providers import SearchProvider

PROVIDERS = ("anthropic", "gemini", "openai")
READS = ("per_field", "batched")


def _choice(*allowed: str) -> Callable[[str], str]:
    def read(raw: str) -> str:
        if raw.lower() not in allowed:
            raise ValueError(f"must be one of {', '.join(allowed)}")
        return raw.lower()

    return read


def _number(test: Callable[[float], bool] = lambda x: True, what: str = "a number", kind: type = float) -> Callable[[str], Any]:
    def read(raw: str) -> Any:
        try:
            value = float(raw)
        except ValueError:
            raise ValueError("must be a number") from None
        if not test(value):
            raise ValueError(f"must be {what}")
        return kind(value)

    return read


# Variables, their defaults and what they may be.
VARIABLES: dict[str, tuple[str, str, Callable[[str], Any]]] = {
    "provider": ("LLM_PROVIDER", "anthropic", _choice(*PROVIDERS)),
    "effort": ("LLM_EFFORT", "medium", str),
    "search": ("SEARCH_PROVIDER", "auto", str.lower),
    "threshold": ("REVIEW_THRESHOLD", "0.85", _number(lambda x: 0 < x <= 1, "above 0 and at most 1")),
    "seconds": ("EXEC_TIMEOUT_SECONDS", "10", _number()),
    "output_chars": ("MAX_OUTPUT_CHARS", "20000", _number(kind=int)),
    "pdf_dpi": ("PDF_DPI", "200", _number(kind=int)),
    "per_minute": ("LLM_MAX_RPM", "0", _number()),
    "retries": ("LLM_MAX_RETRIES", "5", _number(kind=int)),
    "crop_reads": ("CROP_READS", "per_field", _choice(*READS)),
    "timeout": ("LLM_TIMEOUT_SECONDS", "180", _number(lambda x: x > 0, "positive")),
    "fallback_models": ("LLM_FALLBACK_MODELS", "", lambda raw: tuple(m.strip() for m in raw.split(",") if m.strip())),
}
KEYS = {"anthropic": "ANTHROPIC_API_KEY", "gemini": "GEMINI_API_KEY", "openai": "OPENAI_API_KEY", "tavily": "TAVILY_API_KEY"}


@dataclass(frozen=True)
class Settings:
    values: Mapping[str, Any]
    keys_present: Mapping[str, bool]

    def __getattr__(self, name: str) -> Any:
        try:
            return self.values[name]
        except KeyError:
            raise AttributeError(name) from None


def settings(environment: Mapping[str, str] | None = None) -> Settings:
    """All settings; a blank variable counts as not set, a wrong one is a ValueError that names it and never shows a key."""
    env = os.environ if environment is None else environment
    found = {}
    for name, (variable, default, read) in VARIABLES.items():
        raw = (env.get(variable) or "").strip() or default
        try:
            found[name] = read(raw)
        except ValueError as wrong:
            raise ValueError(f"{variable} {wrong}, got {raw!r}") from None
    return Settings(found, {name: bool((env.get(v) or "").strip()) for name, v in KEYS.items()})


def search_provider(mode: str, made: Mapping[str, Callable[[], SearchProvider]], model: str | None = None, tavily: bool = False) -> list[SearchProvider]:
    """The search providers to try in order, by the mode asked for and what is there: ``made`` has a maker for tavily, llm and duckduckgo."""
    mode = (mode or "auto").lower()
    if mode == "llm" and model is None:
        raise ValueError("search by the model needs a configured model")
    if mode in ("tavily", "llm", "duckduckgo"):
        return [made[mode]()]
    if tavily:
        return [made["tavily"]()]
    if model in ("anthropic", "gemini"):
        return [made["llm"](), made["duckduckgo"]()]
    return [made["duckduckgo"]()]
