"""ST0, ST6, K7: command line: ``python -m linkloom.cli crawl|fix-images|snapshot|gc STATE ...``."""

from __future__ import annotations

import argparse
import logging
import time
from dataclasses import replace
from datetime import datetime, timezone

from pyspark.sql import functions as F

from linkloom.config import DEFAULT
from linkloom.schemas import RESPONSES
from linkloom.session import build_session
from linkloom.sources import files
from linkloom.sources.blobs import BlobTable
from linkloom.sources.fetch import HttpFetcher, ReplayFetcher

log = logging.getLogger("linkloom")


def _occurrences(pages):
    from linkloom.operators.state import button_occurrences

    occ = button_occurrences(pages)
    return occ.select("page_id.host", "page_id.path", "pos", "hash", "file_ext", "source", "target", "alt", "title", "last_visited")


def _redirects(pages):
    from linkloom.functions.urls import is_web, page_id

    return pages.where(is_web(F.col("redirects_to"))).select("page_id.host", "page_id.path", page_id(F.col("redirects_to")).alias("to")).select("host", "path", F.col("to.host").alias("to_host"), F.col("to.path").alias("to_path"))


def _export(folder):
    from linkloom.operators import snapshot, state

    def export(pages):
        occ = _occurrences(pages)
        files.write_snapshot(snapshot.snapshot(occ, _redirects(pages)), folder, state.stats(occ).first().asDict())

    return export


def _fetcher(spark, args):
    """Answers from a folder of stored responses; over the network only if asked to."""
    if args.http:
        return HttpFetcher(DEFAULT)
    return ReplayFetcher(spark.read.schema(RESPONSES).parquet(args.responses))


def crawl(spark, pages, args) -> None:
    """ST0 to ST6: periods of crawling; the state and the index go to ``out``, images to its ``images`` folder."""
    from linkloom.streaming.crawl import Crawler

    clock = lambda: datetime.now(timezone.utc).replace(tzinfo=None)
    config = replace(DEFAULT, start_url=args.start_url, save_period_s=args.period)
    crawler = Crawler(_fetcher(spark, args), BlobTable(spark, f"{args.out}/images"), lambda p: files.write_state(p, f"{args.out}/state.json"), _export(args.out), config, dump=f"{args.out}/debug" if args.debug else None)
    crawler.start(pages, clock())
    crawler.run(clock, time.sleep, args.periods)
    log.info("%d pages", crawler.runtime.pages.count())


def fix_images(spark, pages, args) -> None:
    """Missing images are downloaded again, all are re-encoded, and the state is saved under the new hashes."""
    from linkloom.operators import image_candidates, maintenance
    from linkloom.storage import written

    store, occ = BlobTable(spark, f"{args.out}/images"), _occurrences(pages)
    wanted = occ.select("hash", "file_ext").distinct()
    missing = written(files.missing_blobs(wanted, store.table(), occ).where(F.col("url").isNotNull()), "missing")
    got = image_candidates.downloaded(missing.select(F.col("url").alias("source")).distinct(), _fetcher(spark, args))
    store.add(written(files.restored(missing, got.where("valid")), "restored"))
    stored, mapping = maintenance.reencode(store.table())
    mapping = written(mapping, "mapping")
    store.add(stored)
    after = written(maintenance.rekeyed_pages(pages, mapping), "pages")
    files.write_state(after, f"{args.out}/state.json")
    _export(args.out)(after)
    log.info("%d images missing, %d re-keyed", missing.count(), mapping.count())


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="linkloom")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("crawl", "fix-images", "snapshot", "gc"):
        sub = commands.add_parser(name)
        sub.add_argument("state")
        sub.add_argument("blobs" if name == "gc" else "out")
        sub.add_argument("--master")
        if name == "gc":
            sub.add_argument("--apply", action="store_true")
        if name in ("crawl", "fix-images"):
            sub.add_argument("--responses", help="folder of stored responses to answer from")
            sub.add_argument("--http", action="store_true", help="ask the network instead")
        if name == "crawl":
            sub.add_argument("--start-url")
            sub.add_argument("--periods", type=int)
            sub.add_argument("--period", type=int, default=DEFAULT.save_period_s)
            sub.add_argument("--debug", action="store_true")
    args = parser.parse_args(argv)
    if getattr(args, "http", True) is False and not args.responses:
        parser.error("give --responses or --http")
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = build_session("linkloom", args.master)
    pages = files.read_state(spark, args.state)
    if args.command == "snapshot":
        _export(args.out)(pages)
    elif args.command == "gc":
        from linkloom.operators import maintenance

        gone = maintenance.unlinked(files.blob_names(spark, args.blobs), _occurrences(pages))
        n = maintenance.delete_files(spark, args.blobs, (r.filename for r in gone.toLocalIterator()), apply=args.apply)
        log.info("%d unlinked files%s", n, "" if args.apply else " (not deleted)")
    elif args.command == "fix-images":
        fix_images(spark, pages, args)
    else:
        crawl(spark, pages, args)


if __name__ == "__main__":
    main()
