"""Typed schemas of the frontier's tables and events, and the states of a link."""

from __future__ import annotations

NOT_CRAWLED, QUEUED, CRAWLED, ERROR = range(4)

REQUEST = "url string, method string, headers map<string,array<string>>, cookies map<string,string>, meta map<string,string>, body binary"
METADATA = (
    "fingerprint string, url string, depth int, created_at timestamp, fetched_at timestamp, status_code int, score double, error string, "
    "domain_fingerprint string, dest_fingerprint string, method string, headers map<string,string>, cookies map<string,string>, meta map<string,string>, content binary, seq bigint"
)
STATES = "fingerprint string, state tinyint, seq bigint"
QUEUE = (
    "id bigint, partition_id int, score double, url string, fingerprint string, host string, host_crc32 int, crawl_at bigint, created_at bigint, "
    "depth int, method string, headers map<string,string>, cookies map<string,string>, meta map<string,string>"
)
DOMAINS = (
    "domain string, queued_pages int, fatal_error string, banned boolean, seed string, rp_url string, rp_body string, rp_timestamp bigint, "
    "subdomains array<string>, redirect_to array<string>, redirect_from array<string>, extra map<string,string>, rp_rules array<struct<path:string,allow:boolean>>, seq bigint"
)
PENDING = QUEUE + ", seq bigint"
OFFSETS = "partition_id int, offset bigint, producer_offset bigint, seq bigint"
STATS = "ts timestamp, partition_id int, key string, value double"
GONE = "id bigint, fingerprint string"
LINK = "struct<url:string,fingerprint:string,host:string,depth:int>"
EVENT = (
    "type string, jid int, partition_id int, offset bigint, url string, fingerprint string, depth int, "
    f"links array<{LINK}>, status_code int, headers map<string,array<string>>, body binary, error string, score double, schedule boolean, stats map<string,double>, ts timestamp, seq bigint, meta map<string,string>, redirect_urls array<string>, producer_offset bigint, method string, cookies map<string,string>, domain_fingerprint string"
)
EVENT_TYPES = ("page_crawled", "links_extracted", "request_error", "request", "update_score", "new_job_id", "offset", "stats", "add_seeds")
PAGES = "id bigint, url string, status string, n_redirects int, is_seed boolean"
EDGES = "parent_id bigint, child_id bigint"
