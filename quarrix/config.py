"""Engine configuration with range checks."""

from __future__ import annotations

import math
import os
import re
from dataclasses import dataclass, field

from .chunking.languages import all_extensions

# Defaults that results depend on.
TEXT_GLOBS = ("*.yaml", "*.yml", "*.json", "*.jsonc", "*.toml", "*.ini", "*.conf", "*.cfg", "*.md", "*.markdown", "*.rst", "*.txt", "*.html", "*.htm", "*.xml", "*.css", "*.scss", "*.less", "*.sql")
DATA_DIR = ".quarrix"
IGNORED = ("node_modules", ".git", ".hg", ".svn", DATA_DIR, "dist", "build", "out", "coverage", "target", ".gradle", "obj", "bin", ".venv", "venv", "__pycache__", ".next", ".nuxt", ".cache", "tmp", "temp", ".DS_Store")
API_KEY_ENV = "QUARRIX_EMBEDDING_API_KEY"

# Name -> (default, least, greatest).
RANGES = {
    "max_file_bytes": (1_048_576, 1024, 1 << 30),
    "max_total_bytes": (536_870_912, 1024, 8 << 30),
    "max_lines_per_chunk": (80, 4, 4096),
    "ngram": (2, 1, 4),
    "top_k": (20, 1, 200),
    "rrf_k": (60, 1, 1000),
    "vector_k": (300, 10, 10_000),
    "max_files": (20_000, 10, 1_000_000),
    "max_chunks": (200_000, 10, 5_000_000),
    "watch_debounce_ms": (300, 50, 60_000),
}


def in_range(value: float, least: int, greatest: int, name: str) -> int:
    whole = math.floor(value)
    if not least <= whole <= greatest:
        raise ValueError(f"config error: {name} must be between {least} and {greatest}")
    return whole


@dataclass(frozen=True)
class ProviderConfig:
    """``kind`` tells the two providers apart: hashed TF-IDF, or vectors from a client."""

    kind: str = "lexical"
    dimension: int = 0
    base_url: str = "https://api.openai.com/v1"
    api_key: str = ""
    model: str = "text-embedding-3-small"
    timeout_ms: int = 60_000
    max_chars_per_text: int = 3000

    def checked(self) -> ProviderConfig:
        if self.kind == "lexical":
            return ProviderConfig("lexical", in_range(self.dimension if self.dimension > 0 else 4096, 64, 65_536, "provider.dimension"))
        return ProviderConfig(
            self.kind,
            in_range(self.dimension, 4, 65_536, "provider.dimension") if self.dimension > 0 else 0,
            self.base_url.rstrip("/"),
            self.api_key.strip() or os.environ.get(API_KEY_ENV, "").strip(),
            self.model,
            in_range(self.timeout_ms, 100, 3_600_000, "provider.timeout_ms"),
            in_range(self.max_chars_per_text, 100, 16_000, "provider.max_chars_per_text"),
        )


@dataclass(frozen=True)
class EngineConfig:
    root: str = "."
    data_dir: str = DATA_DIR
    provider: ProviderConfig = field(default_factory=ProviderConfig)
    allow_fallback: bool = True
    include: tuple[str, ...] = ()
    ignore: tuple[str, ...] = IGNORED
    max_file_bytes: int = RANGES["max_file_bytes"][0]
    max_total_bytes: int = RANGES["max_total_bytes"][0]
    max_lines_per_chunk: int = RANGES["max_lines_per_chunk"][0]
    ngram: int = RANGES["ngram"][0]
    top_k: int = RANGES["top_k"][0]
    rrf_k: int = RANGES["rrf_k"][0]
    vector_k: int = RANGES["vector_k"][0]
    max_files: int = RANGES["max_files"][0]
    max_chunks: int = RANGES["max_chunks"][0]
    watch_debounce_ms: int = RANGES["watch_debounce_ms"][0]
    autosave: bool = True

    def checked(self, base_dir: str = ".") -> EngineConfig:
        """Paths made absolute, empty lists replaced by defaults, numbers floored; raises outside the ranges."""
        root = os.path.abspath(os.path.join(base_dir, self.root.strip() or "."))
        numbers = {k: in_range(getattr(self, k), least, most, k) for k, (_, least, most) in RANGES.items()}
        include = self.include or (*(f"*.{e}" for e in all_extensions()), *TEXT_GLOBS)
        data_dir = self.data_dir if re.match(r"[a-z][a-z0-9+.-]*:/", self.data_dir) else os.path.join(root, self.data_dir)
        ignore = (*(self.ignore or IGNORED), os.path.basename(data_dir.rstrip("/")))
        return EngineConfig(root, data_dir, self.provider.checked(), self.allow_fallback, include, tuple(dict.fromkeys(ignore)), autosave=self.autosave, **numbers)
