"""Crawls over a fixed set of pages, and their ledger."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from itertools import count

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.functions import urls
from spindrift.schemas import DEFAULT_SAVES


@dataclass(frozen=True)
class CrawlJob:
    """What a crawl follows, keeps and stops at."""

    root_url: str
    country: str
    property_url_regex: str
    validation_pattern: str = ""
    property_url_regex_full: str = ""
    max_saves: int = DEFAULT_SAVES
    page_naming: str = ""


@dataclass
class CrawlState:
    """Where a crawl stands: visited pages, and the frontier in its order.

    Both are lists, or tables ``(url)`` of any size; a frontier's table may
    have its order as ``place``.
    """

    downloaded_count: int = 0
    visited: list[str] | DataFrame = field(default_factory=list)
    queue_items: list[str] | DataFrame = field(default_factory=list)


def page_links(pages: DataFrame, pattern: str, base: str | None = None) -> DataFrame:
    """``(src_url, dst_url)`` of the links of ``pages(url, html)``, resolved."""
    link = F.explode(urls.links(F.col("html"), pattern))
    found = pages.select("url", link.alias("link"))
    against = F.lit(base) if base else F.col("url")
    return found.select(F.col("url").alias("src_url"), urls.resolve(against, F.col("link")).alias("dst_url")).distinct()


def reached(edges: DataFrame, roots: DataFrame, levels: int | None = None, visited: DataFrame | None = None, save=None, enough=None) -> DataFrame:
    """``(url, depth)`` of all that is reached from ``roots(url)``, within ``levels`` links if given.

    One level at a time: links of the frontier, without those visited before.
    With ``enough`` the level for whose ``(url)`` it is true is the last. ``save`` writes and reads back a table, to cut the growing lineage; it
    defaults to a reliable checkpoint.
    """
    save = save or (lambda df: df.checkpoint())
    edges = save(edges)  # found once, not at every level
    frontier = roots.select("url").distinct()
    if visited is not None:
        frontier = frontier.join(visited.select("url"), "url", "left_anti")
    frontier = save(frontier)
    seen = frontier.select("url", F.lit(0).alias("depth"))
    for depth in count(1) if levels is None else range(1, levels + 1):
        if enough and enough(frontier):
            break
        step = edges.join(frontier, edges.src_url == frontier.url, "left_semi").select(F.col("dst_url").alias("url")).distinct()
        step = step.join(seen, "url", "left_anti")
        if visited is not None:
            step = step.join(visited.select("url"), "url", "left_anti")
        frontier = save(step)
        if frontier.isEmpty():
            break
        seen = save(seen.unionByName(frontier.select("url", F.lit(depth).alias("depth"))))
    return seen


def crawl(pages: DataFrame, job: CrawlJob, state: CrawlState | None = None, levels: int | None = None, save=None) -> DataFrame:
    """Visit ``pages(url, html)`` from a root or a stored state, and report every visit.

    Returns ``(url, depth, html, saved)``. Pages are visited in the order of
    their level and URL; those that fit the job are saved until the cap, with
    the saves of the state counted in, and with the last of them visiting
    ends. Without ``levels`` only the cap or the end of the frontier does. A URL without a page is visited and not saved.
    """
    spark = pages.sparkSession
    state = state or CrawlState(queue_items=[job.root_url])
    base = job.root_url if job.country == "Slovakia" else _site(job.root_url)
    roots = _url_table(spark, state.queue_items).select("url")
    visited = None if state.visited == [] else _url_table(spark, state.visited).select("url")
    one = pages.select("url", "html").dropDuplicates(["url"])
    fits = urls.starts_like(urls.resolve(F.lit(base), F.col("url")), job.property_url_regex_full)
    shown = urls.is_interesting(F.col("html"), job.validation_pattern) if job.validation_pattern else F.lit(False)
    fits = F.coalesce(fits & shown, F.lit(False))
    left = job.max_saves - state.downloaded_count
    # what may be saved is counted by levels, so the crawl ends with the level of the last save
    saveable = (save or (lambda df: df.checkpoint()))(one.where(fits).select("url"))
    saves = [0]

    def enough(frontier: DataFrame) -> bool:
        saves[0] += saveable.join(frontier, "url", "left_semi").count()
        return saves[0] >= left

    found = reached(page_links(one, job.property_url_regex, base), roots, levels, visited, save, enough).join(one, "url", "left")
    checked = found.withColumn("fits", fits)
    if left <= 0:
        return checked.where("false").select("url", "depth", "html", F.col("fits").alias("saved"))
    # the place of the last page that may be saved; at most the cap is looked at
    capped = checked.where("fits").orderBy("depth", "url").limit(left).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("depth", "url")).alias("last")).first()
    if capped["n"] >= left:
        depth, url = capped["last"]
        checked = checked.where((F.col("depth") < depth) | ((F.col("depth") == depth) & (F.col("url") <= url)))
    return checked.select("url", "depth", "html", F.col("fits").alias("saved"))


def _url_table(spark: SparkSession, urls_of: list[str] | DataFrame) -> DataFrame:
    """``(url, place)`` of a list or a table of URLs."""
    if isinstance(urls_of, DataFrame):
        return urls_of if "place" in urls_of.columns else urls_of.select("url", F.monotonically_increasing_id().alias("place"))
    return spark.createDataFrame([(u, k) for k, u in enumerate(urls_of)], "url string, place long")


def _site(url: str) -> str:
    from urllib.parse import urlparse

    parts = urlparse(url)
    return f"{parts.scheme}://{parts.netloc}"


def resume(jobs: list[CrawlJob], stopped: CrawlJob) -> list[CrawlJob]:
    """The jobs from the stopped one on, found by its root; all if it is not there."""
    at = next((i for i, job in enumerate(jobs) if job.root_url == stopped.root_url), 0)
    return jobs[at:]


def ledger_rows(visits: DataFrame, country: str, folder: str, when) -> DataFrame:
    """A ledger row for every visit; only saved pages have a path."""
    path = F.concat(F.lit(f"{folder.rstrip('/')}/{country}/"), urls.file_name(F.col("url")), F.lit(".html"))
    moment = F.lit(when).cast("timestamp")
    return visits.select(
        F.col("url").alias("property_url"), "saved", moment.alias("date_saved"), moment.alias("date_visited"), F.when(F.col("saved"), path).alias("html_path"), F.lit(country).alias("country")
    )


def append_new(ledger: DataFrame, rows: DataFrame) -> DataFrame:
    """The ledger with those rows whose URL its country does not have yet.

    Of several new rows with one URL the earliest visit stays.
    """
    key = ["property_url", "country"]
    first = Window.partitionBy(*key).orderBy(F.col("date_visited").asc_nulls_last(), F.col("saved").desc(), "html_path")
    once = rows.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")
    return ledger.unionByName(once.join(ledger.select(*key), key, "left_anti").select(*ledger.columns))


def known(ledger: DataFrame, links: DataFrame) -> DataFrame:
    """Links that the ledger has."""
    return links.join(ledger, "property_url", "left_semi")


def tried(ledger: DataFrame, links: DataFrame) -> DataFrame:
    """Links that the ledger has as visited and not saved."""
    return links.join(ledger.where(~F.col("saved")), "property_url", "left_semi")


def state_json(spark: SparkSession, job: CrawlJob, state: CrawlState) -> DataFrame:
    """A state of lists as one row of JSON."""
    from spindrift.schemas import CRAWL_STATE

    row = (asdict(job), state.downloaded_count, state.visited, state.queue_items)
    return spark.createDataFrame([row], CRAWL_STATE).select(F.to_json(F.struct("*")).alias("value"))


def state_from_json(rows: DataFrame) -> tuple[CrawlJob, CrawlState]:
    from spindrift.schemas import CRAWL_STATE

    row = rows.select(F.from_json("value", CRAWL_STATE).alias("s")).select("s.*").first()
    job = {k: v for k, v in row["scrape_param"].asDict().items() if v is not None}
    return CrawlJob(**job), CrawlState(row["downloaded_count"], list(row["visited"]), list(row["queue_items"]))


def state_lines(spark: SparkSession, job: CrawlJob, state: CrawlState) -> DataFrame:
    """A state of any size as rows: one of the job and its count, and one for each URL."""
    from spindrift.schemas import CRAWL_STATE

    head = spark.createDataFrame([(asdict(job), state.downloaded_count, None, None)], CRAWL_STATE).select("scrape_param", "downloaded_count")
    for seen, listed in ((True, state.visited), (False, state.queue_items)):
        head = head.unionByName(_url_table(spark, listed).select("url", F.lit(seen).alias("seen"), "place"), allowMissingColumns=True)
    return head


def state_from_lines(rows: DataFrame) -> tuple[CrawlJob, CrawlState]:
    """The job, and its state as tables ``(url, place)``, of lines or of a state in one line."""
    head = rows.where("scrape_param is not null").select("scrape_param", "downloaded_count").first()
    job = {k: v for k, v in head["scrape_param"].asDict().items() if v is not None}

    def listed(seen: bool, array: str) -> DataFrame:
        own = rows.where(F.col("seen") == seen).select("url", "place")
        return own.unionByName(rows.select(F.posexplode(array).alias("place", "url")).select("url", F.col("place").cast("long").alias("place")))

    return CrawlJob(**job), CrawlState(head["downloaded_count"], listed(True, "visited"), listed(False, "queue_items"))
