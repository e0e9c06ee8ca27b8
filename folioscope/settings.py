"""Defaults shared by the operators. Every function takes these as keyword parameters."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    # Published defaults that results depend on.
    short_term_token_budget: int = 6000
    compact_fraction: float = 0.5
    memory_top_k: int = 4
    memory_floor: float = 0.55
    search_top_k: int = 6
    search_floor: float = 0.35
    fusion_top_k: int = 4
    chunk_chars: int = 2400
    chunk_overlap: int = 300
    source_max_ingest: int = 10
    source_max_words: int = 12_000
    link_max_words: int = 100_000
    links_per_request: int = 20
    excerpt_chars: int = 1500
    crawl_delay_s: float = 2.0
    crawl_max_delay_s: float = 30.0
    crawl_max_pages: int = 100
    time_limit_min: int = 120
    time_limit_max: int = 1440
    max_sub_questions: int = 8
    max_turns_limit: int = 100
    word_limit_max: int = 2000
    default_max_turns: int = 100
    default_word_limit: int = 2000
    reply_minutes_default: int = 30
    reply_minutes_max: int = 1440
    cooldown_s: int = 180
    spacing_s: float = 1.0
    keep_sites: tuple[str, ...] = field(default=(
        "supremecourt.gov", "uscourts.gov", "congress.gov", "govinfo.gov",
        "federalregister.gov", "ecfr.gov", "uscode.house.gov", "justice.gov"))


DEFAULTS = Settings()
