"""Reads, writes, crawls, the ledger and streams."""

import json

from spindrift import schemas
from spindrift.operators import crawl, wiki
from spindrift.operators.listings import extract_listings
from spindrift.sources import io
from spindrift.streaming import ingest


def test_pages_by_extension(spark, tmp_path):
    (tmp_path / "a.html").write_text("<title>á</title>\n", encoding="utf-8")
    (tmp_path / "b.HTML").write_text("x")
    (tmp_path / "c.txt").write_text("x")
    rows = io.read_pages(spark, str(tmp_path)).collect()
    assert sorted(r["path"].rsplit("/", 1)[1] for r in rows) == ["a.html", "b.HTML"]
    assert io.read_page(spark, str(tmp_path / "a.html")).first()["html"] == "<title>á</title>\n"


def test_tsv_keeps_quotes_tabs_and_lines(spark, tmp_path):
    rows = spark.createDataFrame([('a "b"', "c\td\ne", None)], "x string, y string, z string")
    io.write_tsv(rows, str(tmp_path / "t"), single_file=True)
    assert len(list((tmp_path / "t").glob("part-*"))) == 1
    assert [tuple(r) for r in io.read_tsv(spark, str(tmp_path / "t")).collect()] == [('a "b"', "c\td\ne", None)]


def test_dump_to_cities(spark, tmp_path):
    page = "<page><title>{}</title><ns>{}</ns><revision><timestamp>2024-01-0{}T00:00:00Z</timestamp><text>{}</text></revision></page>"
    dump = [("Nitra", 0, 1, "old"), ("Nitra", 0, 2, "new"), ("Nitra (film)", 0, 1, "x"), ("Nitra", 1, 3, "talk"), ("Other", 0, 1, "y")]
    (tmp_path / "d.xml").write_text("<m>" + "".join(page.format(*d) for d in dump) + "</m>")
    listings = spark.createDataFrame([(" nitra",), ("NITRA",), ("NaN",), (None,)], "city string")
    found = wiki.match_cities(io.read_wiki_dump(spark, str(tmp_path / "d.xml")), listings)
    assert [(r["title"], r["content"]) for r in found.collect()] == [("Nitra", "new")]


def test_enrichment_keeps_all_listings(spark):
    listings = spark.createDataFrame([("a", "Nitra, x"), ("b", None), ("c", "Y")], "path string, city string")
    pages = spark.createDataFrame([("Nitra", "| pop = 5\n"), ("Nitra-Juh", "| pop = 6\n")], "title string, content string")
    facts = wiki.facts(pages)
    assert facts.columns == ["title_norm", *schemas.CITY_FIELDS]
    assert sorted((r["path"], r["population"]) for r in wiki.enrich(listings, facts).where("path <> 'b'").collect() if r["population"]) == [("a", "5"), ("a", "6")]
    assert wiki.enrich(listings, facts, unique=True).count() == 3


def test_crawl_files(spark, tmp_path):
    (tmp_path / "jobs.json").write_text(json.dumps({"scrape_params": [{"root_url": "r", "country": "Austria", "property_url_regex": "x"}, {"root_url": "s", "country": "Slovakia", "property_url_regex": "y", "max_saves": 3}]}))
    jobs = io.read_crawl_jobs(spark, str(tmp_path / "jobs.json")).collect()
    assert [(j["root_url"], j["max_saves"], j["validation_pattern"]) for j in jobs] == [("r", 500, ""), ("s", 3, "")]
    (tmp_path / "urls.json").write_text('["b", "a"]')
    assert [r["url"] for r in io.read_urls(spark, str(tmp_path / "urls.json")).orderBy("seq").collect()] == ["b", "a"]
    job, state = crawl.CrawlJob("r", "Austria", "x", max_saves=7), crawl.CrawlState(2, ["a"], ["b", "c"])
    target = str(tmp_path / "state")
    for _ in range(2):
        io.replace_text(crawl.state_json(spark, job, state), target)
    assert crawl.state_from_json(io.read_crawl_state(spark, target)) == (job, state)
    assert [j.root_url for j in crawl.resume([crawl.CrawlJob("q", "", ""), job], job)] == ["r"]


def web(spark):
    links = {"/": ["/a", "/b"], "/a": ["/c", "/"], "/b": ["/c", "/d"], "/c": ["/e"], "/d": []}
    rows = [("http://x.at" + p, "".join(f'<a href="{t}">' for t in to) + ("<p>Wohnfläche</p>" if p in ("/a", "/c", "/d") else "")) for p, to in links.items()]
    return spark.createDataFrame(rows, "url string, html string")


def test_crawl(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    job = crawl.CrawlJob("http://x.at/", "Austria", r'href="([^"]+)"', "wohnfläche", max_saves=2)
    visits = {r["url"][11:]: (r["depth"], r["saved"]) for r in crawl.crawl(web(spark), job).collect()}
    assert visits == {"/": (0, False), "/a": (1, True), "/b": (1, False), "/c": (2, True)}
    state = crawl.CrawlState(1, visited=["http://x.at/b"], queue_items=["http://x.at/b", "http://x.at/a", "http://x.at/"])
    visits = {r["url"][11:]: r["saved"] for r in crawl.crawl(web(spark), job, state).collect()}
    assert visits == {"/": False, "/a": True}
    assert crawl.crawl(web(spark), job, crawl.CrawlState(2, queue_items=["http://x.at/"])).count() == 0


def test_crawl_has_no_depth_of_its_own(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    rows = [(f"http://x.at/{k}", f'<a href="/{k + 1}">' + ("<p>Wohnfläche</p>" if k > 11 else "")) for k in range(15)]
    job = crawl.CrawlJob("http://x.at/0", "Austria", r'href="([^"]+)"', "wohnfläche", max_saves=2)
    visits = {r["url"]: (r["depth"], r["saved"]) for r in crawl.crawl(spark.createDataFrame(rows, "url string, html string"), job).collect()}
    assert visits == {f"http://x.at/{k}": (k, k > 11) for k in range(14)}


def test_ledger(spark):
    visits = spark.createDataFrame([("u", True), ("v", False), ("u", True)], "url string, saved boolean")
    rows = crawl.ledger_rows(visits, "Austria", "pages/", "2024-01-01 00:00:00")
    first = crawl.append_new(spark.createDataFrame([], schemas.LEDGER), rows)
    assert sorted((r["property_url"], r["html_path"]) for r in first.collect()) == [("u", "pages/Austria/u.html"), ("v", None)]
    assert crawl.append_new(first, rows).count() == 2
    links = spark.createDataFrame([("u",), ("v",), ("w",)], "property_url string")
    assert [r[0] for r in crawl.tried(first, links).collect()] == ["v"]
    assert sorted(r[0] for r in crawl.known(first, links).collect()) == ["u", "v"]


def test_ledger_files(spark, tmp_path):
    path = str(tmp_path / "ledger.json")
    assert io.read_ledger(spark, path).count() == 0
    visits = spark.createDataFrame([("u", True), ("v", False)], "url string, saved boolean")
    rows = crawl.ledger_rows(visits, "Austria", "pages", "2024-01-01 00:00:00")
    for _ in range(2):
        assert sorted(tuple(r) for r in io.append_ledger(rows, path).collect()) == sorted(tuple(r) for r in rows.collect())
    (tmp_path / "broken.json").write_text('[{"property_url": "u", ')
    assert io.read_ledger(spark, str(tmp_path / "broken.json")).count() == 0
    (tmp_path / "array.json").write_text('[\n {"property_url": "u", "saved": true, "country": "Austria"},\n {"property_url": "v"}\n]')
    assert [r["property_url"] for r in io.read_ledger(spark, str(tmp_path / "array.json")).collect()] == ["u", "v"]
    assert io.append_ledger(rows, str(tmp_path / "broken.json")).count() == 2


def test_state_survives_a_crash(spark, tmp_path):
    path = str(tmp_path / "state")
    assert io.read_crawl_state(spark, path).count() == 0 and io.read_page(spark, path + ".html").count() == 0
    old, new = (spark.createDataFrame([(v,)], "value string") for v in ("old", "new"))
    io.replace_text(old, path)
    (tmp_path / "state").rename(tmp_path / "state.old")  # stopped between the renames
    assert io.read_crawl_state(spark, path).first()["value"].strip() == "old"
    io.replace_text(new, path)
    assert io.read_crawl_state(spark, path).first()["value"].strip() == "new" and not (tmp_path / "state.old").exists()


def test_stream_of_pages(spark, tmp_path):
    rows = [("a.html", "<title>x</title>", "2024-01-01 00:00:00"), ("a.html", "<title>x</title>", "2024-01-01 01:00:00"), ("b.html", "<title>y</title>", "2024-01-01 00:00:00")]
    pages = spark.createDataFrame(rows, "path string, html string, fetched string").selectExpr("path", "html", "cast(fetched as timestamp) fetched")
    pages.write.parquet(str(tmp_path / "in"))
    stream = ingest.listing_stream(ingest.page_stream(spark, str(tmp_path / "in")))
    ingest.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["path"], r["title"]) for r in got.collect()) == [("a.html", "x"), ("b.html", "y")]


def test_preview_cuts_texts(spark):
    rows = extract_listings(spark.createDataFrame([("p", "<title>" + "a" * 900 + "</title>")], "path string, html string"))
    assert len(io.preview(rows)[0]["title"]) == 500


def test_states_as_tables(spark, tmp_path):
    path = str(tmp_path / "state")
    job, small = crawl.CrawlJob("r", "Austria", "x", max_saves=7), crawl.CrawlState(2, ["a"], ["c", "b"])
    assert io.read_state_lines(spark, path).count() == 0
    for k, rows in enumerate((crawl.state_lines(spark, job, small), crawl.state_json(spark, job, small))):  # in lines, and in one line
        io.write_state_lines(rows, path) if k == 0 else io.replace_text(rows, path)
        own, state = crawl.state_from_lines(io.read_state_lines(spark, path))
        assert own == job and state.downloaded_count == 2 and [r["url"] for r in state.visited.collect()] == ["a"]
        assert [r["url"] for r in state.queue_items.orderBy("place").collect()] == ["c", "b"]
    urls = spark.range(50_000).selectExpr("concat('https://x/p', id) as url")
    io.write_state_lines(crawl.state_lines(spark, job, crawl.CrawlState(0, urls.where("url like '%7'"), urls)), path)
    assert len(list((tmp_path / "state").glob("part-*"))) > 1  # written and read by tasks, not by the driver
    state = crawl.state_from_lines(io.read_state_lines(spark, path))[1]
    assert state.visited.count() == 5000 and state.queue_items.exceptAll(crawl._url_table(spark, urls)).isEmpty()


def test_a_crawl_goes_on_from_tables(spark):
    pages = spark.createDataFrame([(f"https://x.at/p{k}", f'<a href="/p{k + 1}">n</a>') for k in range(6)], "url string, html string")
    job = crawl.CrawlJob("https://x.at/p0", "Austria", r'href="(/p\d+)"')
    lists = crawl.CrawlState(0, ["https://x.at/p4"], ["https://x.at/p1"])
    table = lambda urls: spark.createDataFrame([(u,) for u in urls], "url string")
    save = lambda df: df.localCheckpoint()
    found = [sorted(r["url"] for r in crawl.crawl(pages, job, s, save=save).collect()) for s in (lists, crawl.CrawlState(0, table(lists.visited), table(lists.queue_items)))]
    assert found[0] == found[1] and "https://x.at/p1" in found[0] and "https://x.at/p4" not in found[0]
