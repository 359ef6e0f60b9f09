"""Fixed settings of the crawl engine, overridable per session."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CrawlConfig:
    # Hosts, parameters, intervals, thresholds and weights that results depend on.
    tracking_params: tuple[str, ...] = ("ref", "si")
    no_follow_hosts: tuple[str, ...] = ("web.archive.org", "phoenix-search.jp", "ranking.prb.jp")
    banned_hosts: tuple[str, ...] = ("prlog.ru", "dvd-rank.com", "adult-plus.com")
    full_weight_hosts: tuple[str, ...] = ("capstasher.neocities.org",)
    recrawl_hours: int = 720
    recrawl_popular_hours: int = 24
    recrawl_buttons_hours: int = 168
    required_score: float = 0.151
    popular_score: float = 0.2
    damping: float = 0.85
    initial_iterations: int = 50
    refresh_iterations: int = 5
    queue_cap: int = 10_000
    internal_weight: float = 0.02
    button_weight: float = 1.0
    redirect_weight: float = 0.1
    max_internal_links: int = 8
    max_href_bytes: int = 256
    max_body_bytes: int = 10 * 1024 * 1024
    timeout_s: int = 30
    max_image_redirects: int = 3
    sniff_bytes: int = 1024
    badge_width: int = 88
    badge_height: int = 31
    early_abort_after: int = 100
    rotate_over: int = 100
    rotate_by: int = 50
    save_period_s: int = 15
    gc_period_s: int = 3600
    concurrent_fetches: int = 100
    # Own choices: a start page and contact are the operator's to give.
    start_url: str | None = None
    user_agent: str = "linkloom (set a contact here)"
    verify_tls: bool = True
    checkpoint_every: int = 5
    hub_links: int = 200_000
    chunk_links: int = 65_536


DEFAULT = CrawlConfig()

#: (host, seconds, limiter key): the longest matching suffix rules; other hosts wait one second.
RATE_RULES = (("jcink.net", 10), ("web.archive.org", 10), ("neocities.org", 1))
DEFAULT_DELAY_S = 1
