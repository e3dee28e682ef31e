"""All queries of the engine, by name, and the SQL they are checked with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import fixed, infobox, listing, urls
from spindrift.functions.text import folded, labelled_text, sentence_text, terms, whole_number
from spindrift.operators import crawl, wiki
from spindrift.operators.index import Index, document_frequencies, postings, statistics, vocabulary_size
from spindrift.operators.listings import extract_listings, merged, nullified, typed
from spindrift.operators.retrieval import Corpus
from spindrift.plans import inputs
from spindrift.plans.inputs import ARTICLES_SQL, FACTS_SQL, LISTINGS_SQL, REACHED_SQL, table, walk_sql
from spindrift.schemas import LISTING_FIELDS, NUMERIC_FIELDS, strings
from spindrift.sources import io
from spindrift.sources.shared import built_once, scratch, shared_dir

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its own name, with the SQL for its rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- terms and the index ------------------------------------------------------

TERMS_SQL = r"WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM documents), p AS (SELECT term, doc_id, count(*) AS tf FROM t GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM p GROUP BY term), n AS (SELECT count(*) AS n FROM documents)"
SEARCH = "the idiot the of zzzunknown"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def index(spark: SparkSession, sf_dir: str) -> Index:
    """The stored index of the documents, which the first search writes."""
    path = built_once(spark, "index", f"{sf_dir}/documents.parquet", lambda to: Index.build(documents(spark, sf_dir)).save(to))
    return Index.load(spark, path)


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """The stored full-text index of the documents, which the first search writes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.col("n_chars").alias("n_chars_num"))
    return Corpus.load(spark, built_once(spark, "corpus", f"{sf_dir}/documents.parquet", lambda to: Corpus(docs, path=to)))


@query(TERMS_SQL + " SELECT doc_id, count(*) AS n_terms, count(DISTINCT term) AS n_distinct FROM t GROUP BY doc_id")
def tokenize_terms(spark, sf_dir):
    each = documents(spark, sf_dir).select("doc_id", terms(F.col("text")).alias("terms")).where(F.size("terms") > 0)
    return each.select("doc_id", F.size("terms").cast("long").alias("n_terms"), F.size(F.array_distinct("terms")).cast("long").alias("n_distinct"))


@query(TERMS_SQL + " SELECT term, doc_id, tf FROM p")
def index_postings(spark, sf_dir):
    return postings(documents(spark, sf_dir))


@query(TERMS_SQL + " SELECT term, df FROM d")
def index_df(spark, sf_dir):
    return document_frequencies(postings(documents(spark, sf_dir)))


@query(TERMS_SQL + ", l AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS k FROM documents) SELECT count(*) AS num_docs, round(avg(k), 6) AS avg_tokens, CAST(min(k) AS BIGINT) AS min_tokens, CAST(max(k) AS BIGINT) AS max_tokens, CAST(sum(k) AS BIGINT) AS total_tokens FROM l")
def index_stats(spark, sf_dir):
    return statistics(documents(spark, sf_dir)).withColumn("avg_tokens", F.round("avg_tokens", 6))


@query(TERMS_SQL + " SELECT count(DISTINCT term) AS n_terms FROM t")
def index_vocabulary(spark, sf_dir):
    return vocabulary_size(postings(documents(spark, sf_dir)))


def tfidf_sql(weight: str, words: dict[str, int], top: int = 5) -> str:
    wanted = ", ".join(f"('{w}', {n})" for w, n in words.items())
    return (
        TERMS_SQL
        + f", q(term, qtf) AS (VALUES {wanted}), k AS (SELECT term, qtf, {weight} AS idf FROM q JOIN d USING (term), n),"
        + " s AS (SELECT doc_id, round(sum(tf * idf * qtf), 6) AS score, count(*) AS found FROM p JOIN k USING (term) GROUP BY doc_id)"
        + f" SELECT CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE found = (SELECT count(*) FROM k) ORDER BY rank LIMIT {top}"
    )


WANTED = {"the": 2, "idiot": 1, "of": 1, "zzzunknown": 1}


@query(tfidf_sql("ln(n / CAST(df AS DOUBLE))", WANTED))
def tfidf_classic(spark, sf_dir):
    return index(spark, sf_dir).search(SEARCH)


@query(tfidf_sql("ln(1 + n / CAST(1 + df AS DOUBLE))", WANTED))
def tfidf_smooth(spark, sf_dir):
    return index(spark, sf_dir).search(SEARCH, "smooth")


@query(tfidf_sql("ln((n - df + 0.5) / (df + 0.5) + 1e-10)", WANTED))
def tfidf_probabilistic(spark, sf_dir):
    return index(spark, sf_dir).search(SEARCH, "probabilistic")


@query(tfidf_sql("ln(n / CAST(df AS DOUBLE))", {"zzzunknown": 1}))
def tfidf_unknown_term(spark, sf_dir):
    return index(spark, sf_dir).search("zzzunknown")


BATCH = ["the of", "idiot", "und der die"]


@query(
    TERMS_SQL
    + ", q(query_id, term) AS (VALUES (0, 'the'), (0, 'of'), (1, 'idiot'), (2, 'und'), (2, 'der'), (2, 'die')), k AS (SELECT query_id, term, ln(n / CAST(df AS DOUBLE)) AS idf, count(*) OVER (PARTITION BY query_id) AS needed FROM q JOIN d USING (term), n),"
    + " s AS (SELECT query_id, doc_id, round(sum(tf * idf), 6) AS score FROM p JOIN k USING (term) GROUP BY query_id, doc_id, needed HAVING count(*) = needed),"
    + " r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s) SELECT * FROM r WHERE rank <= 5"
)
def tfidf_batch(spark, sf_dir):
    return index(spark, sf_dir).search_many(BATCH)


# --- retrieval ----------------------------------------------------------------


@query(
    TERMS_SQL + ", l AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS k FROM documents)"
    + ", o AS (SELECT doc_id, w[i] AS term, i - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents), unnest(range(1, len(w) + 1)) AS u(i))"
    + " SELECT term, doc_id, CAST(count(*) AS INTEGER) AS tf, CAST(any_value(k) AS INTEGER) AS n_tokens, CAST(min(pos) AS INTEGER) AS first, CAST(max(pos) AS INTEGER) AS last, CAST(sum(pos) AS BIGINT) AS places, any_value(df) AS df FROM o JOIN l USING (doc_id) JOIN d USING (term) GROUP BY term, doc_id"
)
def corpus_files(spark, sf_dir):
    """A full-text index written anew and read back, to the last place of a term."""
    docs = documents(spark, sf_dir)
    made = Corpus(docs, path=scratch(spark, "corpus"))
    total = F.aggregate("places", F.lit(0).cast("long"), lambda x, y: x + y)
    ends = F.element_at("places", 1).alias("first"), F.element_at("places", -1).alias("last")
    return made.posted.join(made.vocabulary, "term").select("term", "doc_id", "tf", "n_tokens", *ends, total.alias("places"), "df")



LENGTHS_SQL = ", l AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS k FROM documents), m AS (SELECT avg(k) AS m FROM l)"
BM25 = "ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * k / m))"
TOP_SQL = " SELECT CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM ({}) ORDER BY rank LIMIT {}"


def fuzzy_clauses_sql(words: list[str], limit: int = 1) -> str:
    parts = []
    for i, w in enumerate(words):
        parts.append(f"SELECT {i} AS clause, term, 1.0 AS weight FROM d WHERE term = '{w}'")
        if len(w) > 3:
            boost = f"1 - damerau_levenshtein(term, '{w}') / CAST(least(length(term), {len(w)}) AS DOUBLE)"
            near = f"SELECT {i} AS clause, term, {boost} AS weight FROM d WHERE abs(length(term) - {len(w)}) <= {limit} AND damerau_levenshtein(term, '{w}') <= {limit}"
            parts.append(f"(SELECT * FROM ({near}) WHERE weight > 0 ORDER BY weight DESC, term LIMIT 50)")
    return " UNION ALL ".join(parts)


def all_words_sql(words: list[str], top: int = 10, limit: int = 1, docs: str = "") -> str:
    return (
        TERMS_SQL + LENGTHS_SQL + f", c AS ({fuzzy_clauses_sql(words, limit)}),"
        + f" s AS (SELECT doc_id, sum(weight * {BM25}) AS score FROM p JOIN d USING (term) JOIN c USING (term) JOIN l USING (doc_id), n, m {docs} GROUP BY doc_id HAVING count(DISTINCT clause) = {len(words)})"
        + TOP_SQL.format("SELECT doc_id, round(score, 6) AS score FROM s", top)
    )


@query(all_words_sql(["the", "of", "and"]))
def bm25_and(spark, sf_dir):
    return corpus(spark, sf_dir).search("The of AND")


@query(all_words_sql(["idoit", "the"]))
def fuzzy_and(spark, sf_dir):
    return corpus(spark, sf_dir).search("idoit the")


FUZZY_TERM_SQL = (
    TERMS_SQL + LENGTHS_SQL
    + ", c AS (SELECT term, 1 - damerau_levenshtein(term, 'wrothless') / CAST(least(length(term), 9) AS DOUBLE) AS weight FROM d WHERE abs(length(term) - 9) <= 2 AND damerau_levenshtein(term, 'wrothless') <= 2 ORDER BY weight DESC, term LIMIT 50),"
    + f" s AS (SELECT doc_id, round(sum(weight * {BM25}), 6) AS score FROM p JOIN d USING (term) JOIN c USING (term) JOIN l USING (doc_id), n, m GROUP BY doc_id)" + TOP_SQL.format("SELECT * FROM s", 5)
)


@query(FUZZY_TERM_SQL)
def fuzzy_term(spark, sf_dir):
    return corpus(spark, sf_dir).search_fuzzy("wrothless")


def phrase_sql(a: str, b: str, slop: int, body: str | None = None) -> str:
    """Documents with two words in order; occurrences are places of the first."""
    return (
        TERMS_SQL + LENGTHS_SQL
        + ", o AS (SELECT doc_id, w[i] AS term, i AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents), unnest(range(1, len(w) + 1)) AS u(i)),"
        + f" h AS (SELECT doc_id, count(DISTINCT x.pos) AS tf FROM o x JOIN o y USING (doc_id) WHERE x.term = '{a}' AND y.term = '{b}' AND abs(y.pos - 1 - x.pos) <= {slop} GROUP BY doc_id),"
        + f" w AS (SELECT sum(ln(1 + (n - df + 0.5) / (df + 0.5))) AS w FROM d, n WHERE term IN ('{a}', '{b}')),"
        + " ph AS (SELECT doc_id, w * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * k / m)) AS score FROM h JOIN l USING (doc_id), w, m)"
        + (body or TOP_SQL.format("SELECT doc_id, round(score, 6) AS score FROM ph", 5))
    )


@query(phrase_sql("of", "the", 0))
def phrase_exact(spark, sf_dir):
    return corpus(spark, sf_dir).search_phrase("of the")


@query(phrase_sql("idiot", "the", 2))
def phrase_slop(spark, sf_dir):
    return corpus(spark, sf_dir).search_phrase("idiot the", 2)


@query(
    phrase_sql("the", "of", 5, f", c AS ({fuzzy_clauses_sql(['the', 'of'])}), s AS (SELECT doc_id, sum(weight * {BM25}) AS score FROM p JOIN d USING (term) JOIN c USING (term) JOIN l USING (doc_id), n, m GROUP BY doc_id HAVING count(DISTINCT clause) = 2)"
    + TOP_SQL.format("SELECT doc_id, round(s.score + coalesce(ph.score, 0), 6) AS score FROM s LEFT JOIN ph USING (doc_id)", 10))
)
def phrase_aware(spark, sf_dir):
    return corpus(spark, sf_dir).search_phrase_aware("the of")


@query(all_words_sql(["the", "idiot"], docs="WHERE doc_id IN (SELECT doc_id FROM documents WHERE lower(lang) = 'en' AND n_chars BETWEEN 500 AND 2500)"))
def filtered_search(spark, sf_dir):
    return corpus(spark, sf_dir).search_with_filters("the idiot", {"lang": "EN", "n_chars_range": (500, 2500)})


@query(TOP_SQL.format("SELECT doc_id, CAST(1.0 AS DOUBLE) AS score FROM documents WHERE n_chars BETWEEN 300 AND 400", 10))
def range_search(spark, sf_dir):
    return corpus(spark, sf_dir).search_range("n_chars", 300.9, "400")


@query(
    TERMS_SQL + LENGTHS_SQL + ", a AS (SELECT doc_id FROM p WHERE term = 'idiot'), b AS (SELECT doc_id FROM p WHERE term = 'moron'), z AS (SELECT doc_id FROM p WHERE term = 'clown'),"
    + f" s AS (SELECT doc_id, sum({BM25}) AS score FROM p JOIN d USING (term) JOIN l USING (doc_id), n, m WHERE term IN ('the', 'idiot', 'moron') AND doc_id IN (SELECT doc_id FROM p WHERE term = 'the') AND (doc_id IN (FROM a) OR doc_id IN (FROM b)) AND doc_id NOT IN (FROM z) GROUP BY doc_id)"
    + TOP_SQL.format("SELECT doc_id, round(score, 6) AS score FROM s", 5)
)
def keyword_bool(spark, sf_dir):
    return corpus(spark, sf_dir).search_keyword("+the +(idiot moron) -clown")


# --- listings -----------------------------------------------------------------


def _listing_query(name: str, columns: list[str]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return extract_listings(inputs.listing_pages(spark, sf_dir)).select("path", *columns)

    run.__name__ = name
    query(f"SELECT path, {', '.join(columns)} FROM ({LISTINGS_SQL})")(run)


for _name, _columns in {
    "extract_full": [*LISTING_FIELDS, "error"],
    "extract_title": ["title", "source_url"],
    "extract_country": ["source_country"],
    "extract_type": ["property_type"],
    "extract_offer": ["offer_type"],
    "extract_ppm2": ["price_per_m2"],
    "extract_area_rooms": ["area", "rooms", "land_area"],
    "extract_energy": ["energy_class", "condition"],
    "extract_year": ["year_built"],
    "extract_costs": ["monthly_costs", "deposit"],
    "extract_availability": ["availability", "rental_term"],
    "extract_city": ["address", "city"],
}.items():
    _listing_query(_name, _columns)


@query(f"SELECT path, price, rent_price FROM ({LISTINGS_SQL}) WHERE source_country = 'Slovakia'")
def extract_price_sk(spark, sf_dir):
    return extract_listings(inputs.listing_pages(spark, sf_dir)).where("source_country = 'Slovakia'").select("path", "price", "rent_price")


@query(f"SELECT path, price, rent_price FROM ({LISTINGS_SQL}) WHERE source_country = 'Austria'")
def extract_price_at(spark, sf_dir):
    return extract_listings(inputs.listing_pages(spark, sf_dir)).where("source_country = 'Austria'").select("path", "price", "rent_price")


@query(f"SELECT path, error FROM ({LISTINGS_SQL}) WHERE error IS NOT NULL")
def error_rows(spark, sf_dir):
    return extract_listings(inputs.listing_pages(spark, sf_dir)).where("error is not null").select("path", "error")


@query(
    """SELECT 'pages/' || p_partkey || '.html' AS path, CASE WHEN p_partkey % 2 = 0 THEN 'buy' ELSE 'rent' END AS offer_type, CAST('NaN' AS VARCHAR) AS city,
    CASE WHEN p_partkey % 4 < 2 THEN 'B' ELSE 'C' END AS energy_class, CASE WHEN p_partkey % 4 < 2 THEN 'NaN' ELSE '' || (p_size + 1900) END AS year_built,
    CASE WHEN p_partkey % 4 < 2 THEN p_size || '00' ELSE 'NaN' END AS deposit, CASE WHEN p_partkey % 4 < 2 THEN '1 rok' ELSE '5 Jahre' END AS rental_term FROM part"""
)
def extract_earlier(spark, sf_dir):
    found = extract_listings(inputs.listing_pages(spark, sf_dir), earlier=True)
    return found.select("path", "offer_type", "city", "energy_class", "year_built", "deposit", "rental_term")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'rent' WHEN o_orderkey % 3 = 1 THEN 'buy' ELSE 'unknown' END AS offer FROM orders")
def offer_words(spark, sf_dir):
    k = F.col("o_orderkey")
    page = F.when(k % 3 == 0, "Byt na prenájom, predaj").when(k % 3 == 1, "<b>FOR SALE</b>").otherwise("rental")
    return table(spark, sf_dir, "orders").select("o_orderkey", listing.offer_by_words(page).alias("offer"))


@query(f"SELECT path, source_country, price, offer_type FROM ({LISTINGS_SQL}) UNION ALL SELECT path, source_country, price, offer_type FROM ({LISTINGS_SQL}) WHERE source_country = 'Austria'")
def union_sources(spark, sf_dir):
    found = extract_listings(inputs.listing_pages(spark, sf_dir)).select("path", "source_country", "price", "offer_type")
    return merged(found, found.where("source_country = 'Austria'"))


@query(
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN v WHEN 1 THEN v * 10 + 5 WHEN 2 THEN NULL WHEN 3 THEN CAST(floor(v / 1000) AS BIGINT) ELSE NULL END AS n
    FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS v FROM orders)"""
)
def numeric_clean(spark, sf_dir):
    k, v = F.col("o_orderkey"), F.floor("o_totalprice").cast("string")
    thousands = F.concat(F.floor(F.col("o_totalprice") / 1000).cast("string"), F.lit(".500,00 €"))
    text = F.when(k % 5 == 0, F.concat(v, F.lit(" €"))).when(k % 5 == 1, F.concat(v, F.lit(",5"))).when(k % 5 == 2, F.concat(v, F.lit(" €/m²"))).when(k % 5 == 3, thousands).otherwise("12d")
    return table(spark, sf_dir, "orders").select("o_orderkey", whole_number(text).alias("n"))


@query(
    f"""SELECT path, CASE WHEN price <> 'NaN' THEN CAST(replace(price, ' €', '') AS BIGINT) END AS price_num, CASE WHEN price_per_m2 NOT LIKE '%m²' THEN CAST(replace(price_per_m2, ' €', '') AS BIGINT) END AS price_per_m2_num,
    CAST(rooms AS BIGINT) AS rooms_num, CASE WHEN area LIKE '%,5' THEN CAST(replace(area, ',', '') AS BIGINT) ELSE CAST(area AS BIGINT) END AS area_num, CAST(year_built AS BIGINT) AS year_built_num FROM ({LISTINGS_SQL})"""
)
def typed_view(spark, sf_dir):
    rows = typed(nullified(extract_listings(inputs.listing_pages(spark, sf_dir)), NUMERIC_FIELDS[:7]))
    return rows.select("path", "price_num", "price_per_m2_num", "rooms_num", "area_num", "year_built_num")


@query("SELECT c_custkey, concat_ws(' ', 'c_name is ' || c_name, CASE WHEN c_custkey % 3 > 0 THEN 'c_mktsegment is ' || c_mktsegment END, 'c_nationkey is ' || c_nationkey) AS text FROM customer")
def text_kv_is(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).otherwise("nAn"))
    return rows.select("c_custkey", sentence_text(["c_name", "c_mktsegment", "c_nationkey"]).alias("text"))


@query("SELECT s_suppkey, t || ' ' || t AS text FROM (SELECT s_suppkey, concat_ws(' ', 's_name: ' || s_name, CASE WHEN s_suppkey % 2 = 0 THEN 'train station' END) AS t FROM supplier)")
def text_kv_colon(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").withColumn("train_station", F.when(F.col("s_suppkey") % 2 == 0, "Yes").otherwise("no"))
    return rows.select("s_suppkey", labelled_text(["s_name", "train_station"]).alias("text"))


@query(f"SELECT doc_id, text || ' ' || translate(text, '{fixed.FOLDED}', '{fixed.PLAIN}') AS text FROM documents")
def fold_diacritics(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", folded(F.col("text")).alias("text"))


# --- articles -----------------------------------------------------------------


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_listings(inputs.listing_pages(spark, sf_dir))


@query(f"SELECT title, count(*) * 2 AS n FROM ({ARTICLES_SQL}) GROUP BY title")
def wiki_title_filter(spark, sf_dir):
    return wiki.articles(inputs.wiki_dump(spark, sf_dir)).groupBy("title").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT title, TIMESTAMP '2020-01-02 00:00:00' AS last_updated FROM ({ARTICLES_SQL}) WHERE title IN (SELECT trim(city) FROM ({LISTINGS_SQL}) WHERE source_country = 'Slovakia')")
def wiki_city_join(spark, sf_dir):
    return wiki.match_cities(inputs.wiki_dump(spark, sf_dir), listings(spark, sf_dir)).select("title", F.col("last_updated").cast("timestamp_ntz").alias("last_updated"))


@query(f"SELECT title, CAST(1 AS BIGINT) AS n FROM ({ARTICLES_SQL})")
def wiki_dedup(spark, sf_dir):
    pages = wiki.articles(inputs.wiki_dump(spark, sf_dir)).select("title", F.col("revision.text._VALUE").alias("content"), F.col("revision.timestamp").alias("last_updated"))
    return wiki.latest(pages).groupBy("title").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT title, CAST(2 AS BIGINT) AS n FROM ({ARTICLES_SQL})")
def wiki_dup_check(spark, sf_dir):
    return wiki.repeated_titles(wiki.articles(inputs.wiki_dump(spark, sf_dir)))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = wiki.articles(inputs.wiki_dump(spark, sf_dir))
    return wiki.latest(pages.select("title", F.col("revision.text._VALUE").alias("content"), F.col("revision.timestamp").alias("last_updated")))


@query(FACTS_SQL)
def infobox_fields(spark, sf_dir):
    return wiki.facts(_pages(spark, sf_dir))


@query(f"SELECT title_norm, rivers, mountains, historic_sites, universities, airports FROM ({FACTS_SQL})")
def prose_facts(spark, sf_dir):
    return wiki.facts(_pages(spark, sf_dir)).select("title_norm", "rivers", "mountains", "historic_sites", "universities", "airports")


@query("SELECT p_partkey, p_brand || ' ' || p_type || ' x' || p_size AS value FROM part")
def infobox_clean(spark, sf_dir):
    raw = F.concat(F.lit("{{a|{{b}}}}'''"), F.col("p_brand"), F.lit("'''&nbsp;[[t|"), F.col("p_type"), F.lit("]]  <br/>x"), F.col("p_size").cast("string"), F.lit("{{c"), F.lit("}} "))
    return table(spark, sf_dir, "part").select("p_partkey", infobox.final_clean(infobox.clean(raw)).alias("value"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN 'mesto' ELSE lower(c_mktsegment) END AS key FROM customer")
def normalize_key(spark, sf_dir):
    k, s = F.col("c_custkey"), F.col("c_mktsegment")
    raw = F.when(k % 3 == 0, F.concat(s, F.lit(", okres X"))).when(k % 3 == 1, F.concat(F.lit(" "), s, F.lit(" (mesto)"))).otherwise("Mesto-Juh")
    return table(spark, sf_dir, "customer").select("c_custkey", infobox.normalize(raw).alias("key"))


@query(f"SELECT path, city, offer_type, population, country, mayor FROM ({LISTINGS_SQL}) LEFT JOIN ({FACTS_SQL}) f ON lower(trim(city)) = f.title_norm")
def enrich_left_join(spark, sf_dir):
    enriched = wiki.enrich(listings(spark, sf_dir), wiki.facts(_pages(spark, sf_dir)))
    return enriched.select("path", "city", "offer_type", "population", F.col("country"), "mayor")


# --- links, crawls and the ledger ----------------------------------------------

HREF = r'href="([^"]+)"'


@query("SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS link FROM pages")
def link_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(urls.links(F.col("html"), HREF)).alias("link"))


@query(
    r"""SELECT DISTINCT url AS src_url, CASE WHEN link LIKE '/%' THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || link ELSE link END AS dst_url
    FROM (SELECT url, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS link FROM pages)"""
)
def url_resolve(spark, sf_dir):
    return crawl.page_links(table(spark, sf_dir, "pages"), HREF)


@query(r"SELECT page_id, coalesce(list_max(list_transform(regexp_extract_all(url || html, '(?i)(?:[?&](?:page|strana)=|/(?:seite|strana|page)[=-])(\d{1,5})', 1), lambda x: CAST(x AS INTEGER))), 1) AS last_page FROM pages")
def last_page(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.last_page(F.concat("url", "html")).alias("last_page"))


@query("SELECT page_id, coalesce(nullif(regexp_extract(url, '(?i)[?&](page|seite|strana)=', 1), ''), 'page') AS parameter FROM pages")
def pagination_param(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.page_parameter(F.col("url")).alias("parameter"))


@query("SELECT page_id, translate(url, '\\/*?:\"<>|', '_________') AS name FROM pages")
def sanitize_name(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.file_name(F.col("url")).alias("name"))


@query("SELECT count(DISTINCT url) AS n_urls, count(*) AS n_pages FROM pages")
def distinct_count(spark, sf_dir):
    return table(spark, sf_dir, "pages").agg(F.count_distinct("url").alias("n_urls"), F.count(F.lit(1)).alias("n_pages"))


def _ledgers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events as visits: every even one is in the ledger already."""
    e = table(spark, sf_dir, "events")
    rows = e.select(
        F.col("user_id").cast("string").alias("property_url"), (F.col("event_id") % 3 == 0).alias("saved"), F.col("ts").alias("date_saved"), F.col("ts").alias("date_visited"),
        F.col("event_id").cast("string").alias("html_path"), F.col("event_type").alias("country"), (F.col("event_id") % 10).alias("part"),
    )
    return rows.where("part < 2").drop("part"), rows.where("part >= 2").drop("part")


LEDGER_SQL = """
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS property_url, event_id % 3 = 0 AS saved, ts, CAST(event_id AS VARCHAR) AS html_path, event_type AS country, event_id % 10 AS part FROM events)
"""


@query(
    LEDGER_SQL + """SELECT property_url, country, html_path, saved FROM e WHERE part < 2 UNION ALL
    SELECT property_url, country, html_path, saved FROM (SELECT *, row_number() OVER (PARTITION BY property_url, country ORDER BY ts, saved DESC, html_path) AS nth FROM e WHERE part >= 2) x
    WHERE nth = 1 AND NOT EXISTS (SELECT 1 FROM e o WHERE o.part < 2 AND o.property_url = x.property_url AND o.country = x.country)"""
)
def ledger_append(spark, sf_dir):
    old, new = _ledgers(spark, sf_dir)
    return crawl.append_new(old, new).select("property_url", "country", "html_path", "saved")


@query(LEDGER_SQL + "SELECT DISTINCT property_url FROM e WHERE part >= 2 AND property_url IN (SELECT property_url FROM e WHERE part < 2)")
def ledger_known(spark, sf_dir):
    old, new = _ledgers(spark, sf_dir)
    return crawl.known(old, new.select("property_url").distinct())


@query(LEDGER_SQL + "SELECT DISTINCT property_url FROM e WHERE part >= 2 AND property_url IN (SELECT property_url FROM e WHERE part < 2 AND NOT saved)")
def ledger_tried(spark, sf_dir):
    old, new = _ledgers(spark, sf_dir)
    return crawl.tried(old, new.select("property_url").distinct())


def _checkpointed(spark: SparkSession):
    """Reliable checkpoints in the folder that all machines share."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return lambda df: df.checkpoint()


PAGE = "'https://www.example.at/p' || c"


@query(REACHED_SQL.format(walk=walk_sql(1)) + f"SELECT {PAGE} AS url, depth FROM first")
def frontier_bfs(spark, sf_dir):
    edges = crawl.page_links(inputs.link_pages(spark, sf_dir), HREF)
    roots = spark.createDataFrame([("https://www.example.at/p1",)], "url string")
    return crawl.reached(edges, roots, save=_checkpointed(spark))


@query(REACHED_SQL.format(walk=walk_sql(1)) + f", page AS (SELECT c_custkey AS c FROM customer), ok AS (SELECT c, depth, row_number() OVER (ORDER BY depth, {PAGE}) AS k FROM first WHERE c % 3 = 0 AND c IN (SELECT c FROM page)), last AS (SELECT depth, {PAGE} AS url FROM ok WHERE k = 10) SELECT {PAGE} AS url, f.depth, f.c % 3 = 0 AND f.c IN (SELECT c FROM page) AS saved FROM first f LEFT JOIN last ON true WHERE last.url IS NULL OR f.depth < last.depth OR (f.depth = last.depth AND {PAGE} <= last.url)")
def crawl_saves(spark, sf_dir):
    job = crawl.CrawlJob("https://www.example.at/p1", "Austria", HREF, "plocha bytu", max_saves=12)
    state = crawl.CrawlState(downloaded_count=2, queue_items=[job.root_url])
    return crawl.crawl(inputs.link_pages(spark, sf_dir), job, state, save=_checkpointed(spark)).select("url", "depth", "saved")


@query(REACHED_SQL.format(walk=walk_sql(5, " AND t NOT IN (20, 7)")) + f"SELECT {PAGE} AS url, depth FROM first")
def frontier_resume(spark, sf_dir):
    edges = crawl.page_links(inputs.link_pages(spark, sf_dir), HREF)
    url = "https://www.example.at/p"
    roots = spark.createDataFrame([(url + "5",), (url + "7",)], "url string")
    visited = spark.createDataFrame([(url + c,) for c in ("20", "7")], "url string")
    return crawl.reached(edges, roots, visited=visited, save=_checkpointed(spark))


CHAIN = "'https://www.example.at/n' || c"


@query(f"SELECT {CHAIN} AS url, CAST(c AS INTEGER) AS depth, c % 5 = 4 AS saved FROM (SELECT n_nationkey AS c FROM nation) WHERE c <= 19")
def crawl_chain(spark, sf_dir):
    """A site where every page links to the next one alone, crawled until four pages are saved."""
    c = F.col("n_nationkey")
    text = F.concat(F.lit('<a href="/n'), (c + 1).cast("string"), F.lit('">next</a>'), F.when(c % 5 == 4, "<p>plocha bytu</p>").otherwise(""))
    pages = table(spark, sf_dir, "nation").select(F.concat(F.lit("https://www.example.at/n"), c.cast("string")).alias("url"), text.alias("html"))
    job = crawl.CrawlJob("https://www.example.at/n0", "Austria", HREF, "plocha bytu", max_saves=4)
    return crawl.crawl(pages, job, save=_checkpointed(spark)).select("url", "depth", "saved")


# --- files that are written and read back ---------------------------------------


@query("SELECT page_id, url || chr(9) || '\"' AS url, html FROM pages")
def tsv_files(spark, sf_dir):
    """Texts with tabs, quotes and lines through a table of tab-separated values."""
    path = scratch(spark, "tsv")
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("page_id"), F.concat("url", F.lit('\t"')).alias("url"), "html")
    io.write_tsv(rows, path)
    return io.read_tsv(spark, path, strings(["page_id", "url", "html"])).select(F.col("page_id").cast("long").alias("page_id"), "url", "html")


@query("SELECT title, timestamp AS last_updated FROM (SELECT n_name AS title, TIMESTAMP '2020-01-01 00:00:00' AS timestamp FROM nation)")
def xml_files(spark, sf_dir):
    """Articles through an XML dump."""
    path = scratch(spark, "xml")
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").alias("title"), F.lit(0).alias("ns"), F.struct(F.lit("2020-01-01T00:00:00Z").alias("timestamp"), F.col("n_name").alias("text")).alias("revision"))
    rows.write.format("xml").option("rowTag", "page").option("rootTag", "mediawiki").save(path)
    read = io.read_wiki_dump(spark, path)
    return read.select("title", F.col("revision.timestamp").cast("timestamp_ntz").alias("last_updated"))


@query(LEDGER_SQL + """SELECT property_url, country, html_path, saved FROM (SELECT *, row_number() OVER (PARTITION BY property_url, country ORDER BY ts, saved DESC, html_path) AS nth FROM e WHERE part < 2) WHERE nth = 1 UNION ALL
    SELECT property_url, country, html_path, saved FROM (SELECT *, row_number() OVER (PARTITION BY property_url, country ORDER BY ts, saved DESC, html_path) AS nth FROM e WHERE part >= 2) x
    WHERE nth = 1 AND NOT EXISTS (SELECT 1 FROM e o WHERE o.part < 2 AND o.property_url = x.property_url AND o.country = x.country)""")  # fmt: skip
def ledger_files(spark, sf_dir):
    """The ledger of two runs through its files."""
    old, new = _ledgers(spark, sf_dir)
    path = scratch(spark, "ledger")
    io.append_ledger(old, path)
    return io.append_ledger(new, path).select("property_url", "country", "html_path", "saved")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def parquet_files(spark, sf_dir):
    """Rows through files partitioned by a column."""
    path = scratch(spark, "parquet")
    io.write_parquet(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), path, "c_mktsegment")
    return spark.read.parquet(path).select("c_custkey", "c_name", "c_mktsegment")


@query("SELECT 'https://www.example.at/p' || c AS url, c % 3 = 0 AS visited FROM (SELECT c_custkey AS c FROM customer)")
def state_files(spark, sf_dir):
    """The state of a crawl through its file."""
    path = scratch(spark, "state")
    pages = inputs.link_pages(spark, sf_dir).select("url")
    seen = F.substring_index("url", "p", -1).cast("long") % 3 == 0
    job = crawl.CrawlJob("https://www.example.at/p1", "Austria", HREF)
    state = crawl.CrawlState(3, pages.where(seen), pages.where(~seen))
    io.write_state_lines(crawl.state_lines(spark, job, state), path)
    _, again = crawl.state_from_lines(io.read_state_lines(spark, path))
    return again.visited.select("url", F.lit(True).alias("visited")).unionByName(again.queue_items.select("url", F.lit(False).alias("visited")))


@query("SELECT page_id AS seq, url FROM (SELECT row_number() OVER (ORDER BY page_id) - 1 AS page_id, url FROM pages)")
def url_files(spark, sf_dir):
    """A list of URLs through a JSON array."""
    path = scratch(spark, "urls")
    listed = table(spark, sf_dir, "pages").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "url"))), lambda x: x["url"])).alias("value"))
    io.replace_text(listed, path)
    return io.read_urls(spark, path).select(F.col("seq").cast("long").alias("seq"), "url")
