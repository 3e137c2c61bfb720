"""Settings of a crawl."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from datetime import timedelta


@dataclass(frozen=True)
class Settings:
    """Names as users of crawl frontiers know them, in lower case. ``of`` reads the upper-case ones, later sources winning."""

    max_next_requests: int = 64
    max_requests: int = 0  # no limit
    spider_feed_partitions: int = 1
    spider_log_partitions: int = 1
    queue_hostname_partitioning: bool = False
    queue_order: str = "score_desc"
    broad_crawl: bool = False  # batches by ``queue.tiered_batch``, under the minimums below
    bc_min_requests: int = 64
    bc_min_hosts: int = 24
    bc_max_requests_per_host: int = 128
    domains_blacklist: tuple[str, ...] = ()
    canonical_solver: str = "basic"
    url_fingerprint_function: str = "sha1"
    domain_fingerprint_function: str = "sha1"
    tldextract_domain_info: bool = False
    discovery_max_pages: int = 100
    user_agent: str = "linkloom"
    store_content: bool = False
    new_batch_delay: float = 30.0
    delay_on_empty: float = 5.0
    domain_stats_log_interval: int = 300
    spider_log_consumer_batch_size: int = 512
    scoring_log_consumer_batch_size: int = 512
    overused_slot_factor: float = 5.0
    overused_max_per_key: int | None = None
    overused_keep_per_key: int = 1000
    overused_max_keys: int | None = None
    overused_keep_keys: int = 100
    revisit_interval: timedelta = timedelta(days=1)

    @classmethod
    def of(cls, *sources: object) -> Settings:
        """From dictionaries or modules; names that aren't upper case or aren't settings are ignored."""
        known = {f.name for f in fields(cls)}
        found: dict[str, object] = {}
        for source in sources:
            items = source if isinstance(source, dict) else vars(source)
            found |= {k.lower(): v for k, v in items.items() if k.isupper() and k.lower() in known}
        return replace(cls(), **found)
