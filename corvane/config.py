"""Settings: a dataclass with defaults, read from and written to JSON."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields

# What the engine indexes and leaves out by default.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".java": "java", ".cpp": "cpp", ".c": "c", ".go": "go", ".rs": "rust", ".md": "markdown",
}
IGNORED_DIRS = [".git", "node_modules", "__pycache__", "venv", ".venv", "static", ".cudavenv", "build"]
IGNORED_FILES = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "bun.lockb", "Gemfile.lock", "Cargo.lock"]


@dataclass
class Config:
    supported_languages: dict[str, str] = field(default_factory=lambda: dict(LANGUAGES))
    ignored_dirs: list[str] = field(default_factory=lambda: list(IGNORED_DIRS))
    ignored_files: list[str] = field(default_factory=lambda: list(IGNORED_FILES))
    ttl_seconds: int = 86_400
    provider: str = "hash"
    api_base: str | None = None
    api_key: str | None = None
    chat_model: str | None = None
    embedding_model: str | None = None
    allowed_providers: list[str] = field(default_factory=list)

    @classmethod
    def load(cls, path: str) -> Config:
        """Settings of a JSON file; unknown keys and broken JSON are errors that name the file."""
        try:
            with open(path, encoding="utf-8") as f:
                return cls(**json.load(f))
        except FileNotFoundError:
            raise FileNotFoundError(f"no settings at {path}; write them with `python -m corvane config`") from None
        except (TypeError, json.JSONDecodeError) as e:
            raise ValueError(f"bad settings in {path}: {e}") from None

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(asdict(self), f, indent=2)


def interview(ask: Callable[[str], str], say: Callable[[str], None] = print) -> Config:
    """Settings from answers; an empty answer keeps a default, lists are asked for item by item."""
    c = Config()
    provider = ""
    while provider not in ("hash", "http"):
        provider = ask(f"Provider, hash (offline) or http [{c.provider}]: ").strip().lower() or c.provider
    c.provider = provider
    if provider == "http":
        while not c.api_base:
            c.api_base = ask("Address of the model service: ").strip() or None
        c.api_key = ask("Key, empty for none: ").strip() or None
    if ask("Keep the defaults for the rest? (Y/n): ").strip().lower() not in ("n", "no"):
        return c
    for f in fields(c):
        now = getattr(c, f.name)
        if f.name in ("provider", "api_base", "api_key") or isinstance(now, dict):
            continue
        if isinstance(now, list):
            if ask(f"Change {f.name}? (y/N): ").strip().lower() in ("y", "yes"):
                say("One a line, an empty line ends:")
                items = []
                while (item := ask("> ").strip()):
                    items.append(item)
                setattr(c, f.name, items)
            continue
        given = ask(f"{f.name} [{now}]: ").strip()
        while given and isinstance(now, int) and not given.isdigit():
            given = ask(f"{f.name}, a number [{now}]: ").strip()
        if given:
            setattr(c, f.name, int(given) if isinstance(now, int) else given)
    return c
