"""ST0 to ST2, ST4 to ST6: one step of the crawl, the crawl as a stream, and the crawler that runs it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.config import DEFAULT, CrawlConfig
from linkloom.functions.images import Normalizer, identity_normalizer
from linkloom.functions.urls import page_id_text
from linkloom.operators import edges, html_links, initial, queue, rank, responses, state
from linkloom.operators.image_candidates import scraped
from linkloom.sources.blobs import BlobTable
from linkloom.sources.fetch import Fetcher, download_pages
from linkloom.sources.files import write_lines
from linkloom.storage import remove, scratch, written


@dataclass
class Step:
    """The new page state, the pages that were fetched for it, and the images to be stored."""

    pages: DataFrame
    fetched: DataFrame
    images: DataFrame


def _one_each(rows: DataFrame, key: str) -> DataFrame:
    """Of each key's rows the last by time, then URL, then content. Only digests are compared; bodies stay where they are."""
    order = F.struct("last_visited", "url", F.xxhash64("kind", "html", "redirects_to"), "__row")
    return rows.join(rows.groupBy(key).agg(F.max(order)["__row"].alias("__row")).select("__row"), "__row", "left_semi")


def apply_batch(pages: DataFrame, cache: DataFrame, fetched: DataFrame, fetcher: Fetcher, now: datetime, config: CrawlConfig = DEFAULT, normalizer: Normalizer = identity_normalizer) -> Step:
    """F1 to F3 for one batch of page responses; images are asked of ``fetcher``.

    A URL's last response counts, and of URLs of one page the last one's.
    """
    rows = written(responses.page_rows(fetched, config).withColumn("__row", F.monotonically_increasing_id()), "responses")
    latest = written(_one_each(rows, "url"), "responses-latest")
    good = _one_each(latest.where(~F.col("is_failure")), "page_id")
    candidates, internal = html_links.extract(good.where("html is not null").select(F.col("url").alias("page"), "url", "html"), config)
    found = scraped(candidates, cache, fetcher, now, config, normalizer)
    shape = pages.schema["buttons"].dataType
    none = F.array().cast(shape)
    button = lambda b: F.struct(b["source"], b["hash"], b["file_ext"], b["target"], b["last_visited"], F.lit(None).cast("struct<from:string,last_visited:timestamp_ntz>").alias("redirect"), b["alt"], b["title"])
    fresh = good.drop("html").join(found.buttons.withColumnRenamed("page", "url"), "url", "left").join(internal.withColumnRenamed("page", "url"), "url", "left")
    fresh = fresh.select(
        "url", "page_id", "last_visited", F.lit(0).cast("long").alias("failed"), F.coalesce(F.transform("buttons", button).cast(shape), none).alias("buttons"),
        F.coalesce("links", F.array().cast("array<string>")).alias("other_internal_links"), "redirects_to",
    )
    fresh = written(fresh, "pages-fresh")
    failures = latest.where("is_failure").select("page_id", "url")
    return Step(written(state.record_failures(state.upsert(pages, fresh), failures, now), "pages"), fresh, found.images)


def run_stream(source: DataFrame, load: Callable[[], DataFrame], save: Callable[[DataFrame], None], step: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str, once: bool = True, config: CrawlConfig = DEFAULT):
    """Each micro-batch of responses is stepped into the state, which is saved only if it changed."""

    def each(batch: DataFrame, _: int) -> None:
        if batch.limit(1).count() == 0:
            return
        before = load()
        after = step(before, batch)
        if state.changed(before, after):
            save(after)

    trigger = {"availableNow": True} if once else {"processingTime": f"{config.save_period_s} seconds"}
    return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**trigger).start()


QUEUE = "page_id struct<host:string,path:string>, url string, seq long, status string"
TIMES = "rate_key string, next_ms long"


@dataclass
class Crawler:
    """ST0, ST1, ST6: the running crawl. State lives in stored tables; the driver holds counters and times.

    ``save`` is given the page state when it changed, ``export`` also once at the start; both are to
    write it then and there, as tables that a turn leaves behind are deleted. ``dump`` is a folder
    for ranks and queue as lines of text. Every turn takes the first URL of each host
    whose time has come, so hosts are never asked more often than the limiter lets them.
    """

    fetcher: Fetcher
    blobs: BlobTable
    save: Callable[[DataFrame], None]
    export: Callable[[DataFrame], None] = lambda pages: None
    config: CrawlConfig = DEFAULT
    normalizer: Normalizer = identity_normalizer
    dump: str | None = None
    runtime: initial.RuntimeState = field(init=False)
    queue: DataFrame = field(init=False)
    next_times: DataFrame = field(init=False)
    saved: DataFrame = field(init=False)
    collected_at: datetime | None = field(init=False, default=None)
    seq: int = field(init=False, default=0)
    stored: list[str] = field(init=False, default_factory=list)

    def start(self, pages: DataFrame, now: datetime) -> None:
        """ST0: ranks, cache and queue from the stored state; the index is exported, the state is not saved yet."""
        spark = pages.sparkSession
        with scratch() as stored:
            self.runtime = initial.initial(pages, self.config)
        self.stored += stored
        self.saved = self.runtime.pages
        self.queue, self.next_times = spark.createDataFrame([], QUEUE), spark.createDataFrame([], TIMES)
        self.export(self.runtime.pages)
        self.refresh(now)

    def _sweep(self, stored: list[str]) -> None:
        """Deletes the stored tables that the state doesn't read any more."""
        run = self.runtime
        read = [self.queue, self.next_times, self.saved, run.pages, run.edges, run.ranks, run.cache, run.unvisited]
        live = {part for df in read for f in df.inputFiles() for part in f.split("/")}
        gone = [p for p in (*self.stored, *stored) if p.rpartition("/")[2] not in live]
        self.stored = [p for p in (*self.stored, *stored) if p not in gone]
        remove(run.pages.sparkSession, gone)

    def refresh(self, now: datetime) -> int:
        """M6: ranks brought up to date and the queue filled; the queue's length."""
        with scratch() as stored:
            n = self._refresh(now)
        self._sweep(stored)
        return n

    def _refresh(self, now: datetime) -> int:
        held = self.queue.count()
        found = initial.next_urls(self.runtime, self.queue, held, now, self.config)
        self.queue = written(queue.enqueue(self.queue, found.select("url", (F.col("pos") + self.seq).alias("seq")), self.config), "queue")
        self.seq += self.config.queue_cap + 1
        if self.dump:
            name = lambda c: page_id_text(F.col(f"{c}.host"), F.col(f"{c}.path"))
            inbound = edges.in_degree(self.runtime.edges).select(name("dst").alias("id"), "n_in")
            write_lines(rank.top_scores(self.runtime.ranks.select(name("id").alias("id"), "score"), inbound, self.config.queue_cap), "line", f"{self.dump}/pagerank")
            write_lines(self.queue.orderBy("seq"), "url", f"{self.dump}/queue")
        return self.queue.count()

    def turn(self, now: datetime) -> int:
        """ST2, M4, M5: one URL of each free host fetched and brought into the state; how many there were."""
        with scratch() as stored:
            n = self._turn(now)
        self._sweep(stored)
        return n

    def _turn(self, now: datetime) -> int:
        now_ms = int(now.replace(tzinfo=timezone.utc).timestamp() * 1000)
        free = queue.next_admissible(self.queue, self.next_times, now_ms).orderBy("seq").limit(self.config.concurrent_fetches)
        picked = written(free, "picked")
        n = picked.count()
        if not n:
            return 0
        self.queue = written(queue.start(self.queue, picked), "queue")
        moved = picked.select("rate_key", (F.lit(now_ms) + 1000 * F.col("delay_s")).cast("long").alias("next_ms"))
        self.next_times = written(self.next_times.where(F.col("next_ms") > now_ms).unionByName(moved).groupBy("rate_key").agg(F.max("next_ms").alias("next_ms")), "times")
        run = self.runtime
        step = apply_batch(run.pages, run.cache, download_pages(picked, self.fetcher), self.fetcher, now, self.config, self.normalizer)
        self.blobs.add(step.images)
        run.pages = step.pages
        run.edges = written(edges.replace_edges(run.edges, step.fetched, self.config), "links")
        run.cache = written(state.button_cache(state.button_occurrences(run.pages)), "cache")
        run.unvisited = edges.unvisited_urls(run.edges, run.pages)
        self.queue = written(queue.finish(self.queue, picked), "queue")
        return n

    def maintain(self, now: datetime) -> None:
        """ST1, ST5, ST6: saves a changed state, and once an hour drops stored images that no page links."""
        if state.changed(self.saved, self.runtime.pages):
            self.save(self.runtime.pages)
            self.export(self.runtime.pages)
            self.saved = self.runtime.pages
        if self.collected_at is None or now - self.collected_at > timedelta(seconds=self.config.gc_period_s):
            self.collected_at = now
            self.blobs.collect(state.button_occurrences(self.runtime.pages))

    def run(self, clock: Callable[[], datetime], wait: Callable[[float], None], periods: int | None = None) -> None:
        """Turns as hosts come free; every save period the state is kept and the queue refreshed."""
        done = 0
        while periods is None or done < periods:
            end = clock() + timedelta(seconds=self.config.save_period_s)
            while clock() < end:
                if not self.turn(clock()):
                    wait(1.0)
            self.maintain(clock())
            self.refresh(clock())
            done += 1
