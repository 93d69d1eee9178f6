"""Settings of a crawl; they travel with the plan, there is no global state."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class CrawlOptions:
    """strategy: "auto" tries several client profiles, "fast" one. depth, limit and the address and schema lists are
    extensions: depth of `crawl`, rows of its result, addresses to fetch or not, schema types to keep or not."""

    strategy: str = "auto"
    timeout_s: float = 30.0
    concurrency: int = 1000
    per_host: int = 8
    allow_domains: tuple[str, ...] = ()
    block_domains: tuple[str, ...] = ()
    allow_urls: tuple[str, ...] = ()
    block_urls: tuple[str, ...] = ()
    include_schemas: tuple[str, ...] = ()
    exclude_schemas: tuple[str, ...] = ()
    depth: int = 1
    limit: int | None = None

    def __post_init__(self):
        if self.strategy not in ("auto", "fast"):
            raise ValueError(f"no strategy {self.strategy!r}")
        if min(self.concurrency, self.per_host) < 1 or self.timeout_s <= 0:
            raise ValueError("concurrency and timeout must be positive")

    def with_(self, **changes) -> CrawlOptions:
        return replace(self, **changes)
