"""Crawling strategies: what is scheduled, with which score. A strategy sees DataFrames and gives DataFrames.

Links of a batch come as rows (url, fingerprint, parent_depth, seq) that aren't in the states as anything but NOT_CRAWLED;
what a strategy returns has score, schedule (whether it is queued) and state (its new one)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions import scoring, urls
from linkloom.operators import domains, enrich, metadata, states
from linkloom.schema import ERROR, QUEUED
from linkloom.sources import robots, seeds, sitemap
from linkloom.sources.store import FrontierStore, kept

_READY = ("url", "fingerprint", "depth", "score", "schedule", "seq", "place", "meta")


class Basic:
    """Every link once, all with score 1."""

    def seeds(self, requests: DataFrame) -> DataFrame:
        return self._scheduled(requests.withColumn("depth", F.lit(0)))

    def filter_links(self, links: DataFrame) -> DataFrame:
        """Before the states are looked up: what isn't worth it."""
        return links

    def links(self, links: DataFrame) -> DataFrame:
        return self._scheduled(links.withColumn("depth", (F.coalesce("parent_depth", F.lit(0)) + 1).cast("int")))

    def errors(self, requests: DataFrame) -> DataFrame:
        """Failed requests get score 0 and aren't queued."""
        return requests.withColumns({"score": F.lit(0.0), "schedule": F.lit(False), "state": F.lit(ERROR)})

    def score(self):
        return F.lit(1.0)

    def _scheduled(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({"score": self.score(), "schedule": F.lit(True), "state": F.lit(QUEUED)})

    def outcome(self, events: DataFrame, store: FrontierStore) -> tuple[DataFrame, DataFrame | None]:
        """What a batch of events (schema.EVENT) leads to: rows to score and schedule (url, fingerprint, depth, score, schedule,
        seq, place, meta), each link once, and changes of the domains table, if the strategy keeps one."""
        links = metadata.links(events.where("type = 'links_extracted'")).where("fingerprint is not null")
        ordered = links.select("url", "fingerprint", (F.col("depth") - 1).alias("parent_depth"), F.struct("seq", "place").alias("at"), "seq", "place", "host")
        found = self.links(unknown(states.first_wins(self.filter_links(ordered), order="at"), store))
        new = events.where("type = 'add_seeds' and fingerprint is not null").select("url", "fingerprint", "seq", F.lit(0).alias("place"))
        new = self.seeds(unknown(states.first_wins(new), store))
        direct = events.where("type = 'update_score' and fingerprint is not null").select("url", "fingerprint", "depth", "score", "schedule", "seq", F.lit(0).alias("place"), "meta")
        direct = unknown(states.first_wins(direct), store)
        rows = ready(new).withColumn("_turn", F.lit(0)).unionByName(ready(found).withColumn("_turn", F.lit(1))).unionByName(ready(direct).withColumn("_turn", F.lit(2)))
        return kept(states.first_wins(rows, order="_turn").drop("_turn")), None

    def finished(self, queue: DataFrame) -> bool:
        """Whether the crawl is over; an empty queue alone doesn't end it, as results may still come."""
        return False


class BreadthFirst(Basic):
    """Shallow pages first."""

    def score(self):
        return scoring.breadth_first(F.col("depth"))


class DepthFirst(Basic):
    """Deep pages first."""

    def score(self):
        return scoring.depth_first(F.col("depth"))


class Discovery(Basic):
    """Sites from their robots files and sitemaps, with a budget of pages for each domain; hosts are interleaved.

    ``interesting``: a condition on url. Domain tables have domain, queued_pages, fatal_error, banned, rp_body."""

    max_sitemaps, max_redirects = 100, 100
    success = (200, 203, 206)

    def __init__(self, max_pages: int = 100, agent: str = "linkloom", interesting=None, seed: int = 0):
        self.max_pages, self.agent, self.seed = max_pages, agent, seed
        self.interesting = F.lit(False) if interesting is None else interesting

    def seeds(self, lines: DataFrame) -> DataFrame:
        """The robots file of each seed's host."""
        return self._once(seeds.robots(seeds.completed(lines)))

    def classified(self, links: DataFrame) -> DataFrame:
        """Adds kind (home, interesting, other) and its rank."""
        kind = F.when(urls.is_home(F.col("url")), "home").when(self.interesting, "interesting").otherwise("other")
        return links.withColumn("kind", kind).withColumn("class_rank", F.when(F.col("kind") == "home", 0).when(F.col("kind") == "interesting", 1).otherwise(2))

    def filter_links(self, links: DataFrame) -> DataFrame:
        """Links (url, domain, parent_domain, queued_pages, fatal_error, banned, and rp_body if there) that stay in their
        domain, that the domain's state allows, and its robots file."""
        rows = links.where((F.col("domain") == F.col("parent_domain")) & ~domains.ignored(self.max_pages))
        return robots.with_allowed(rows, self.agent).where("allowed").drop("allowed") if "rp_body" in links.columns else rows

    def links(self, links: DataFrame) -> DataFrame:
        """Links (of ``filter_links``, NOT_CRAWLED) within their domain's budget, by class, scored."""
        fit = domains.within_budget(self.classified(links), self.max_pages, self.seed)
        return self._once(fit.withColumn("score", scoring.by_class(F.col("kind"))).drop("class_rank"))

    def robots_files(self, files: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Of crawled robots files (url, status_code, body): the sitemaps to fetch, and the home pages of hosts that have none."""
        good = files.where(F.col("status_code").isin(*self.success) & robots.valid(F.col("body")))
        maps = robots.sitemaps(good)
        without = files.select("url").join(maps.select(F.col("base").alias("url")).distinct(), "url", "left_anti")
        return self._once(maps.select("url").distinct().withColumns({"kind": F.lit("sitemap"), "score": F.lit(scoring.ROBOTS)})), self.homes(without)

    def sitemap_files(self, files: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Of crawled sitemaps (url, body, domain, queued_pages): further sitemaps, at most ``max_sitemaps`` of each, and the
        pages of each domain's remaining budget."""
        entries = sitemap.parsed(files.where(F.col("body").isNotNull())).dropDuplicates(["base", "url"])
        maps = domains.sampled(entries.where("is_sitemap"), self.max_sitemaps, "base", "url", self.seed)
        pages = entries.where("not is_sitemap").join(files.select(F.col("url").alias("base"), "domain", "queued_pages"), "base").dropDuplicates(["domain", "url"])
        pages = domains.sampled(pages, F.lit(self.max_pages) - F.col("queued_pages"), "domain", "url", self.seed)
        scored = self.classified(pages).withColumn("score", scoring.by_class(F.col("kind")))
        return self._once(maps.select("url").distinct().withColumns({"kind": F.lit("sitemap"), "score": F.lit(scoring.ROBOTS)})), self._once(scored.select("url", "domain", "kind", "score"))

    def homes(self, rows: DataFrame) -> DataFrame:
        """The home page of each host of ``rows`` (url)."""
        home = F.concat(urls.scheme(F.col("url")), F.lit("://"), urls.netloc(F.col("url")), F.lit("/"))
        return self._once(rows.where(urls.host(F.col("url")).isNotNull()).select(home.alias("url")).distinct().withColumns({"kind": F.lit("home"), "score": F.lit(scoring.HOME)}))

    def failed(self, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Of failed requests (url, domain, error, kind): the domains that can't be reached, and the home pages to try where
        a robots file or sitemap failed for another reason."""
        gone = F.col("error") == "DNSLookupError"
        fatal = requests.where(gone).select("domain", F.col("error").alias("fatal_error")).distinct()
        rest = requests.where(~gone & F.col("kind").isin("robots", "sitemap")).join(fatal.select("domain"), "domain", "left_anti")
        return fatal, self.homes(rest)

    def redirected(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Of redirected requests (domain, target): the domains each led to, and those each was reached from."""
        moved = rows.where("domain <> target")
        to = domains.collected(moved.withColumnRenamed("target", "redirect_to"), "redirect_to", self.max_redirects)
        back = domains.collected(moved.select(F.col("target").alias("domain"), F.col("domain").alias("redirect_from")), "redirect_from", self.max_redirects)
        return to, back

    def _once(self, rows: DataFrame) -> DataFrame:
        """Scores jittered by host; rows without a host are left out."""
        host = urls.host(F.col("url"))
        return rows.where(host.isNotNull()).withColumns({"score": scoring.host_jitter(F.col("score"), host), "schedule": F.lit(True), "state": F.lit(QUEUED)})

    def outcome(self, events: DataFrame, store: FrontierStore) -> tuple[DataFrame, DataFrame]:
        """As in ``Basic``: robots files lead to sitemaps and home pages, sitemaps to further ones and pages, pages to links
        within their domain; errors lead to home pages, or end a domain. Of a redirected request for a robots file, sitemap or
        home page, the domain it led to counts. Within a batch, kinds are scheduled in the order of their rank, pages of a kind
        at random, while the domain's budget lasts."""
        own = kept(self._resolved(events, store))
        touched = own.select("domain").unionByName(own.select(F.col("origin").alias("domain"))).where("domain is not null").distinct()
        gone = own.where("type = 'request_error' and error = 'DNSLookupError'").groupBy("domain").agg(F.max_by("error", "seq").alias("_fatal"))
        answered = "type in ('page_crawled', 'request_error') and kind = 'robots'"
        text = F.when(F.col("status_code").isin(*self.success) & (F.col("type") == "page_crawled") & robots.valid(F.col("body").cast("string")), F.col("body").cast("string"))
        files = states.last_wins(own.where(answered).where("domain is not null").select("domain", "url", text.alias("body"), F.unix_timestamp("ts").alias("rp_timestamp"), "seq"), "domain")
        parsed = robots.rules(files.withColumns({"rp_url": F.col("url"), "rp_body": F.col("body")}).drop("url", "seq"), self.agent)
        fresh = parsed.select("domain", F.col("rp_url").alias("_url"), F.col("rp_body").alias("_body"), F.when(F.col("rp_body").isNotNull(), F.col("rules")).alias("_rules"), F.col("rp_timestamp").alias("_at"))
        table = store.lookup("domains", touched)
        state = kept(
            touched.join(table, "domain", "left").join(gone, "domain", "left").join(fresh, "domain", "left").withColumns(
                {"fatal_error": F.coalesce("_fatal", "fatal_error"), "queued_pages": F.coalesce("queued_pages", F.lit(0)), "banned": F.coalesce("banned", F.lit(False)),
                 "rp_body": F.when(F.col("_url").isNull(), F.col("rp_body")).otherwise(F.coalesce("_body", F.lit(""))), "rp_rules": F.when(F.col("_url").isNull(), F.col("rp_rules")).otherwise(F.coalesce("_rules", F.array().cast(robots.RULES))),
                 "rp_timestamp": F.coalesce("_at", "rp_timestamp"), "rp_url": F.coalesce("_url", "rp_url")}
            ).drop("_fatal", "_url", "_body", "_rules", "_at")
        )
        short = state.select("domain", "queued_pages", "fatal_error", "banned", "rp_rules")
        rows = self._wanted(own, short).join(short, "domain", "left").withColumn("queued_pages", F.coalesce("queued_pages", F.lit(0)))
        rows = rows.where(F.col("fatal_error").isNull() & ~F.coalesce("banned", F.lit(False)) & robots.allowed(F.col("url"), F.col("rp_rules")))
        # Seeds come before there is a domain: a robots file is asked for whatever the file itself says.
        asked = events.where("type = 'add_seeds'").groupBy("url").agg(F.min("seq").alias("seq"))
        new = seeds.robots(seeds.completed(asked.select("url"))).withColumns({"domain": urls.registered_domain(urls.host(F.col("url"))), "class_rank": F.lit(-1), "counted": F.lit(False), "queued_pages": F.lit(0), "depth": F.lit(0), "place": F.lit(0)})
        new = new.crossJoin(F.broadcast(asked.agg(F.coalesce(F.min("seq"), F.lit(0)).alias("seq"))))
        names = ("url", "domain", "kind", "class_rank", "counted", "score", "depth", "seq", "place", "queued_pages")
        rows = self._printed(rows.select(*names).unionByName(new.select(*names)))
        once = unknown(states.first_wins(rows.withColumn("_at", F.struct("class_rank", "seq", "place", "url")), order="_at").drop("_at"), store)
        free = once.where("not counted")
        fit = domains.within_budget(once.where("counted"), self.max_pages, self.seed)
        found = kept(self._once(free.unionByName(fit)).withColumn("meta", F.create_map(F.lit("kind"), "kind")))
        added = found.where("kind <> 'robots'").groupBy("domain").agg(F.count("*").cast("int").alias("_added"))
        return found.select(*_READY), self._domains(own, state, added)

    def _printed(self, rows: DataFrame) -> DataFrame:
        return enrich.with_fingerprint()(rows)

    def _resolved(self, events: DataFrame, store: FrontierStore) -> DataFrame:
        """Adds kind (of the request), origin (the domain that was asked), domain (the one that counts) and netloc."""
        own = events.where("type in ('page_crawled', 'request_error', 'links_extracted')")
        unmarked = own.where("meta is null or meta['kind'] is null").select("fingerprint")
        known = store.lookup("metadata", unmarked).select("fingerprint", F.col("meta")["kind"].alias("_kind"))
        kind = F.coalesce(F.col("meta")["kind"], F.col("_kind"), F.when(urls.path(F.col("url")) == "/robots.txt", "robots"), F.lit("page"))
        asked = F.coalesce(F.try_element_at("redirect_urls", F.lit(1)), F.col("url"))
        led = F.when(F.col("kind").isin("robots", "sitemap", "home"), F.try_element_at("redirect_urls", F.lit(-1)))
        at = F.coalesce(led, asked)
        domain = lambda u: urls.registered_domain(urls.host(u))
        return own.join(known, "fingerprint", "left").withColumn("kind", kind).drop("_kind").withColumns({"origin": domain(asked), "origin_netloc": urls.netloc(asked), "domain": domain(at), "netloc": urls.netloc(at)})

    def _wanted(self, own: DataFrame, state: DataFrame) -> DataFrame:
        """Rows (url, domain, kind, class_rank, counted, score, depth, seq, place) that the events ask for."""
        out = ("url", "domain", "kind", "class_rank", "counted", "score", "depth", "seq", "place")
        good = own.where(F.col("status_code").isin(*self.success) & (F.col("type") == "page_crawled")).withColumn("body", F.col("body").cast("string"))
        each = good.where("kind = 'robots'").groupBy("domain", "url", "body").agg(F.min("seq").alias("seq"))
        maps = robots.sitemaps(each).join(each.select(F.col("url").alias("base"), "domain", "seq"), "base")
        maps = maps.select("url", "domain", F.lit("sitemap").alias("kind"), F.lit(0).alias("class_rank"), F.lit(True).alias("counted"), F.lit(scoring.ROBOTS).alias("score"), F.lit(0).alias("depth"), "seq", F.lit(0).alias("place"))
        home = F.concat(F.lit("http://"), F.col("netloc"), F.lit("/"))
        homes = own.where("kind in ('robots', 'sitemap') and type <> 'links_extracted' and netloc <> ''").groupBy(home.alias("url"), "domain").agg(F.min("seq").alias("seq"))
        homes = homes.withColumns({"kind": F.lit("home"), "class_rank": F.lit(1), "counted": F.lit(True), "score": F.lit(scoring.HOME), "depth": F.lit(0), "place": F.lit(0)})
        read = states.last_wins(good.where("kind = 'sitemap' and body is not null").select("url", "body", "domain", "seq"), "url")
        entries = sitemap.parsed(read).dropDuplicates(["base", "url"]).join(read.select(F.col("url").alias("base"), "domain", "seq"), "base").join(state.select("domain", "queued_pages", "fatal_error", "banned"), "domain")
        entries = entries.where(~domains.ignored(self.max_pages))
        deeper = domains.sampled(entries.where("is_sitemap"), self.max_sitemaps, "base", "url", self.seed)
        deeper = deeper.withColumns({"kind": F.lit("sitemap"), "class_rank": F.lit(0), "counted": F.lit(False), "score": F.lit(scoring.ROBOTS), "depth": F.lit(0)})
        pages = entries.where("not is_sitemap").dropDuplicates(["domain", "url"])
        pages = self._ranked(domains.sampled(pages, F.lit(self.max_pages) - F.col("queued_pages"), "domain", "url", self.seed).withColumn("depth", F.lit(0)))
        links = own.where("type = 'links_extracted'").select("domain", "depth", "seq", F.posexplode("links").alias("place", "link")).select("domain", (F.coalesce("depth", F.lit(0)) + 1).alias("depth"), "seq", "place", "link.url")
        inside = links.where(urls.registered_domain(urls.host(F.col("url"))) == F.col("domain")).join(state.select("domain", "queued_pages", "fatal_error", "banned"), "domain").where(~domains.ignored(self.max_pages))
        parts = (maps, homes, deeper, pages, self._ranked(inside))
        found = parts[0].select(*out)
        for x in parts[1:]:
            found = found.unionByName(x.select(*out))
        return found

    def _ranked(self, rows: DataFrame) -> DataFrame:
        kinds = self.classified(rows).withColumn("score", scoring.by_class(F.col("kind")))
        return kinds.withColumns({"class_rank": F.col("class_rank") + 2, "counted": F.lit(True)}).withColumn("kind", F.lit("page"))  # a link to a home page isn't trusted as one

    def _domains(self, own: DataFrame, state: DataFrame, added: DataFrame) -> DataFrame:
        """The rows of the domains table that change: pages queued, hosts seen, where redirects led, seeds."""
        hosts = own.where("type = 'links_extracted'").select("domain", F.explode("links").alias("link")).select("domain", urls.host(F.col("link.url")).alias("subdomains"))
        hosts = domains.collected(hosts.where(urls.registered_domain(F.col("subdomains")) == F.col("domain")), "subdomains").withColumnRenamed("subdomains", "_hosts")
        moved = own.where("netloc <> origin_netloc").select(F.col("origin").alias("domain"), F.col("netloc").alias("target"), F.col("domain").alias("led"), "origin_netloc")
        to = domains.collected(moved.select("domain", F.col("target").alias("_to")), "_to", self.max_redirects)
        back = domains.collected(moved.select(F.col("led").alias("domain"), F.col("origin_netloc").alias("_from")), "_from", self.max_redirects)
        seed = own.where("meta['seed'] is not null").groupBy("domain").agg(F.max_by(F.col("meta")["seed"], "seq").alias("_seed"))
        last = own.groupBy("domain").agg(F.max("seq").alias("_seq"))
        most = F.lit(self.max_redirects)
        grown = lambda old, new: F.array_union(F.coalesce(old, F.array().cast("array<string>")), F.coalesce(new, F.array().cast("array<string>")))
        rows = state
        for df in (hosts, to, back, seed, last, added):
            rows = rows.join(df, "domain", "left")
        return rows.withColumns(
            {"subdomains": grown(F.col("subdomains"), F.col("_hosts")), "redirect_to": F.slice(grown(F.col("redirect_to"), F.col("_to")), F.lit(1), most), "redirect_from": F.slice(grown(F.col("redirect_from"), F.col("_from")), F.lit(1), most),
             "seed": F.coalesce("_seed", "seed"), "queued_pages": F.col("queued_pages") + F.coalesce("_added", F.lit(0)), "seq": F.greatest(F.coalesce("_seq", F.lit(0)), F.coalesce("seq", F.lit(0)))}
        ).drop("_hosts", "_to", "_from", "_seed", "_seq", "_added")


def unknown(rows: DataFrame, store: FrontierStore) -> DataFrame:
    """The rows whose link the store has as NOT_CRAWLED, or not at all."""
    return states.not_crawled(rows, store.lookup("states", rows.select("fingerprint")))


def ready(rows: DataFrame) -> DataFrame:
    """Rows as ``outcome`` gives them; what they lack is null."""
    defaults = {"place": F.lit(0), "seq": F.lit(0).cast("bigint"), "depth": F.lit(0), "meta": F.lit(None).cast("map<string,string>"), "fingerprint": F.lit(None).cast("string")}
    return rows.select(*(F.col(c) if c in rows.columns else defaults[c].alias(c) for c in _READY))


def schedule(strategy: Basic, links: DataFrame, known: DataFrame) -> DataFrame:
    """The whole step for a batch of links: filter, drop repeats (first wins), look up states, let the strategy score."""
    fresh = states.not_crawled(states.first_wins(strategy.filter_links(links)), known)
    return strategy.links(fresh)
