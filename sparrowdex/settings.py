"""Engine settings: built-in defaults, then a .env file, then the environment, then explicit values."""

from __future__ import annotations

import os
from dataclasses import Field, dataclass, fields
from pathlib import Path

from .schema import IGNORED_DIRS, SEARCHABLE_TYPES, SPLITTABLE_TYPES, SUPPORTED_EXTENSIONS

_TRUE = {"1", "true", "yes", "on"}


@dataclass(frozen=True)
class Settings:
    """The names of the fields and of the variables that set them, as existing .env files use them."""

    base_dir: str = "."
    repositories_dir: str = "data/repositories"
    indexes_dir: str = "indexes"
    eval_golden_dir: str = "eval/golden"
    eval_results_dir: str = "eval/results"
    store: str = "cosine"
    index_name: str | None = None
    collection_name: str = "repository"
    embedding_model: str = "hashed-words"
    embedding_dimensions: int = 384
    reranker_model: str = "term-overlap"
    reranker_enabled: bool = True
    supported_extensions: tuple[str, ...] = SUPPORTED_EXTENSIONS
    searchable_chunk_types: tuple[str, ...] = SEARCHABLE_TYPES
    splittable_chunk_types: tuple[str, ...] = SPLITTABLE_TYPES
    max_chunk_tokens: int = 700
    chunk_overlap_tokens: int = 100
    context_window_parts: int = 1
    max_prompt_context_tokens: int = 3000
    token_counter: str = "quarter"
    ignored_dirs: tuple[str, ...] = IGNORED_DIRS
    vector_weight: float = 0.25
    keyword_weight: float = 0.75


#: Fields that the environment may set, by variable.
ENVIRONMENT = {
    "RAG_" + name.upper(): name
    for name in (
        "store",
        "index_name",
        "collection_name",
        "embedding_model",
        "embedding_dimensions",
        "reranker_model",
        "reranker_enabled",
        "max_chunk_tokens",
        "chunk_overlap_tokens",
        "context_window_parts",
        "max_prompt_context_tokens",
        "token_counter",
        "eval_results_dir",
    )
}


def as_bool(value: str) -> bool:
    return value.strip().lower() in _TRUE


def read_env_file(path: str | Path) -> dict[str, str]:
    """KEY=value lines; blank lines, comments, quotes and a leading `export` are understood."""
    found: dict[str, str] = {}
    p = Path(path)
    if not p.is_file():
        return found
    for line in p.read_text().splitlines():
        name, eq, value = line.strip().removeprefix("export ").partition("=")
        if eq and not name.startswith("#"):
            value = value.strip()
            if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"":
                value = value[1:-1]
            found[name.strip()] = value
    return found


def _typed(field: Field, value: str):
    """A variable's text as the type of the field's default; fields without one are texts."""
    kind = type(field.default)
    return as_bool(value) if kind is bool else kind(value) if kind in (int, float) else value


def load_settings(env_file: str | Path | None = None, **explicit) -> Settings:
    """All settings, also those that the command line takes its defaults from; empty variables count as unset."""
    given = read_env_file(env_file or ".env") | dict(os.environ)
    known = {f.name: f for f in fields(Settings)}
    values = {name: _typed(known[name], given[variable]) for variable, name in ENVIRONMENT.items() if given.get(variable)}
    return Settings(**values | explicit)
