"""Engine settings in one frozen record; a few may be overridden from the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class EngineConfig:
    """Sizes and limits that define results, and where tables live."""

    data_dir: str = "data"
    chunk_tokens: int = 800
    overlap_tokens: int = 100
    max_part_tokens: int = 1200
    fan_in: int = 8
    top_k: int = 5
    answer_tokens: int = 2048
    answer_turns: int = 6
    rewrite_turns: int = 3
    rewrite_chars: int = 500
    session_minutes: int = 30
    session_turns: int = 20
    blog_min_chars: int = 100
    markdown_min_chars: int = 50
    sources: tuple[str, ...] = ("docs", "release-notes", "blog", "community", "github")

    @classmethod
    def from_env(cls, prefix: str = "TEXTLOOM_") -> EngineConfig:
        """Defaults, with every scalar field replaced by ``PREFIX_FIELD`` where that is set."""
        given = {}
        for f in fields(cls):
            value = os.environ.get(prefix + f.name.upper())
            if value is not None and f.name != "sources":
                given[f.name] = int(value) if isinstance(f.default, int) else value
        return cls(**given)
