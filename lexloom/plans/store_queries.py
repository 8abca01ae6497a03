"""Sources, filters, merges and streams on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.text import content_hash, decoded
from lexloom.operators import profile, store
from lexloom.plans import model
from lexloom.plans.model import quoted, with_frames
from lexloom.plans.registry import query
from lexloom.schema import FINISHED_PAGE, LANGUAGES, fixed_rows, language_aliases, language_extensions
from lexloom.session import scratch_path
from lexloom.sources import cache, catalog, corpus
from lexloom.streaming.ingest import FETCHED, Ingest

PAGES_PER_TASK = 1_000
CAP = 4_096
BUDGET = 200_000
TABLE_PREFIX = "lexloom_"


# --- sources -----------------------------------------------------------------


@query(
    "s01_read_corpus",
    with_frames("SELECT language, content AS code FROM code", "code"),
)
def s01(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.corpus_frame(model.code(spark, sf))


@query(
    "s02_layout_detection",
    with_frames(
        "SELECT language, content AS code FROM code UNION ALL SELECT role, text FROM conversations",
        "code",
    ),
)
def s02(spark: SparkSession, sf: str) -> DataFrame:
    older = model.table(spark, sf, "conversations").select(
        F.col("role").alias("language"), F.col("text").alias("snippet")
    )
    current = _database(spark, "current", code=model.code(spark, sf), progress=model.progress(spark, sf))
    return corpus.read_database(spark, database=current).unionByName(
        corpus.read_database(spark, database=_database(spark, "older", snippets=older))
    )


def _database(spark: SparkSession, name: str, **tables: DataFrame) -> str:
    """A catalog database that holds these tables and no others."""
    location = scratch_path(spark, name)
    database = f"{TABLE_PREFIX}{name}"
    spark.sql(f"DROP DATABASE IF EXISTS {database} CASCADE")
    spark.sql(f"CREATE DATABASE {database} LOCATION '{location}'")
    for table, rows in tables.items():
        rows.write.option("path", f"{location}/{table}").saveAsTable(f"{database}.{table}")
    return database


@query(
    "s03_create_and_drop_tables",
    with_frames(
        "SELECT language, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM code GROUP BY language",
        "code",
    ),
)
def s03(spark: SparkSession, sf: str) -> DataFrame:
    catalog.drop_tables(spark, TABLE_PREFIX)
    location = scratch_path(spark, "tables")
    catalog.create_tables(spark, location, TABLE_PREFIX)
    catalog.create_tables(spark, location, TABLE_PREFIX)
    catalog.append_rows(model.code(spark, sf), f"{TABLE_PREFIX}code")
    filled = spark.read.parquet(f"{location}/code")
    catalog.drop_tables(spark, TABLE_PREFIX)
    return filled.groupBy("language").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@query(
    "s04_table_exists",
    with_frames(
        "SELECT 'code' AS name, true AS present, count(*) AS row_count FROM code UNION ALL "
        "SELECT 'progress', true, count(*) FROM progress UNION ALL SELECT 'doesnotexist', false, 0",
        "code",
        "progress",
    ),
)
def s04(spark: SparkSession, sf: str) -> DataFrame:
    frames = {"code": model.code, "progress": model.progress}
    for name, frame in frames.items():
        frame(spark, sf).createOrReplaceTempView(TABLE_PREFIX + name)
    present = {
        name: catalog.table_exists(spark, TABLE_PREFIX + name)
        for name in ("code", "progress", "doesnotexist")
    }
    found = [
        frames[name](spark, sf).agg(F.count("*").alias("row_count"))
        if present[name]
        else spark.range(1).select(F.lit(0).cast("long").alias("row_count"))
        for name in present
    ]
    for name in frames:
        spark.catalog.dropTempView(TABLE_PREFIX + name)
    rows = [
        counted.select(F.lit(name).alias("name"), F.lit(present[name]).alias("present"), "row_count")
        for name, counted in zip(present, found)
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(
    "s05_insert_or_ignore",
    with_frames(
        "SELECT id, url, hash FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY id) AS r FROM crawled) "
        "WHERE r = 1 AND hash NOT IN (SELECT hash FROM curated)",
        "crawled",
        "curated",
    ),
)
def s05(spark: SparkSession, sf: str) -> DataFrame:
    stored = model.curated(spark, sf)
    return store.insert_or_ignore(model.crawled(spark, sf), stored).select("id", "url", "hash")


@query("s06_progress_upsert", with_frames("SELECT * FROM progress", "progress"))
def s06(spark: SparkSession, sf: str) -> DataFrame:
    return model.progress(spark, sf)


@query(
    "s07_tokenised_corpus_cache",
    with_frames(
        "SELECT language, count(*) AS files, CAST(sum(len(tokens)) AS BIGINT) AS tokens FROM prose_tokens GROUP BY language",
        "prose_tokens",
    ),
)
def s07(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "tokenised")
    cache.stored_or_built(spark, path, lambda: model.prose_tokens(spark, sf))
    again = cache.stored_or_built(spark, path, lambda: model.prose_tokens(spark, sf))
    return again.groupBy("language").agg(
        F.count("*").alias("files"), F.sum(F.size("tokens")).alias("tokens")
    )


@query(
    "s08_ingest_raw_files",
    "SELECT page_id, sha1(html || chr(10)) AS hash, CAST(octet_length(encode(html)) + 1 AS BIGINT) AS size "
    "FROM pages WHERE octet_length(encode(html)) + 1 <= 262144",
)
def s08(spark: SparkSession, sf: str) -> DataFrame:
    """`pages` as one raw file each, ingested again."""
    path = scratch_path(spark, "raw")
    pages = model.table(spark, sf, "pages").select("page_id", "html")
    # A number of its own keeps small partitions apart: the work is one file a page, however short.
    tasks = max(3 * spark.sparkContext.defaultParallelism, pages.count() // PAGES_PER_TASK)
    corpus.write_files(pages, path, "page_id", "html", tasks)
    files = corpus.ingest_files(spark, path, pattern="*.txt")
    page = F.regexp_extract("url", r"page_id=(-?[0-9]+)\.txt$", 1).try_cast("long")
    return files.select(page.alias("page_id"), content_hash(F.col("content")).alias("hash"), "size")


# --- projections and filters -------------------------------------------------


@query("p01_project_code", with_frames("SELECT language, content AS code FROM code", "code"))
def p01(spark: SparkSession, sf: str) -> DataFrame:
    return model.code(spark, sf).select("language", F.col("content").alias("code"))


@query(
    "p02_filter_language",
    with_frames("SELECT id, language, url FROM code WHERE language = 'Python'", "code"),
)
def p02(spark: SparkSession, sf: str) -> DataFrame:
    return store.of_language(model.code(spark, sf), "Python").select("id", "language", "url")


@query(
    "p03_ignore_languages",
    with_frames(
        "SELECT doc_id, language, CASE WHEN language NOT IN ('Go', 'C#') THEN array_to_string(tokens, ' ') END AS tokens "
        f"FROM (SELECT doc_id, language, {model.sql_generic('content')} AS tokens FROM (SELECT doc_id, source AS language, text AS content FROM documents "
        "UNION ALL SELECT -1 - page_id, 'Go', html FROM pages))",
    ),
)
def p03(spark: SparkSession, sf: str) -> DataFrame:
    docs = model.table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("language"), F.col("text").alias("content")
    )
    pages = model.table(spark, sf, "pages").select(
        (-1 - F.col("page_id")).alias("doc_id"), F.lit("Go").alias("language"), F.col("html").alias("content")
    )
    tokenised = profile.tokenise(docs.unionByName(pages), ignored=["Go", "C#"])
    return tokenised.withColumn("tokens", F.array_join("tokens", " "))


@query(
    "p04_allowed_extensions",
    with_frames(
        "SELECT id, language, url FROM code WHERE contains(url, '.') AND (language, regexp_extract(url, '\\.([^.]*)$', 1)) IN "
        f"(VALUES {fixed_rows(language_extensions())})",
        "code",
    ),
)
def p04(spark: SparkSession, sf: str) -> DataFrame:
    return store.allowed_extensions(model.code(spark, sf)).select("id", "language", "url")


@query(
    "p05_size_cap",
    with_frames(f"SELECT id, size FROM code WHERE size <= {CAP}", "code"),
)
def p05(spark: SparkSession, sf: str) -> DataFrame:
    return store.within_size(model.code(spark, sf), CAP).select("id", "size")


_ALIAS_OF = {"en": "Py3", "de": "CPP", "es": "CSharp", "fr": "golang"}


@query(
    "p06_canonical_language",
    with_frames(
        "SELECT doc_id, alias, l.language FROM aliased LEFT JOIN "
        f"(VALUES {fixed_rows(language_aliases())}) AS l(name, language) ON lower(alias) = name",
        aliased="SELECT doc_id, CASE WHEN n_chars > 5000 THEN source ELSE CASE lang "
        + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _ALIAS_OF.items())
        + " END END AS alias FROM documents",
    ),
)
def p06(spark: SparkSession, sf: str) -> DataFrame:
    docs = model.table(spark, sf, "documents").select(
        "doc_id",
        F.when(F.col("n_chars") > 5000, F.col("source"))
        .otherwise(model.chosen(F.col("lang"), _ALIAS_OF))
        .alias("alias"),
    )
    return store.canonical_language(docs)


_KIND_OF = "CASE " + " ".join(
    f"WHEN lang = '{code}' THEN '{alias}'" for code, alias in _ALIAS_OF.items()
) + " END"


@query(
    "p06_rejects",
    with_frames(
        "SELECT id, language, reason FROM (SELECT id, l.language, CASE WHEN l.language IS NULL THEN 'language' "
        "WHEN NOT contains(url, '.') OR (l.language, regexp_extract(url, '\\.([^.]*)$', 1)) NOT IN "
        f"(VALUES {fixed_rows(language_extensions())}) THEN 'extension' WHEN size > {CAP} THEN 'size' END AS reason "
        f"FROM named LEFT JOIN (VALUES {fixed_rows(language_aliases())}) AS l(name, language) ON lower(alias) = name) "
        "WHERE reason IS NOT NULL",
        "code",
        named="SELECT c.id, c.url, c.size, CASE WHEN d.n_chars > 5000 THEN d.source ELSE "
        f"{_KIND_OF} END AS alias FROM code c JOIN documents d ON c.id = d.doc_id",
    ),
)
def p06_rejects(spark: SparkSession, sf: str) -> DataFrame:
    docs = model.table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"),
        F.when(F.col("n_chars") > 5000, F.col("source"))
        .otherwise(model.chosen(F.col("lang"), _ALIAS_OF))
        .alias("alias"),
    )
    files = model.code(spark, sf).select("id", "url", "size").join(docs, "id")
    return store.sort_out(files, CAP).rejects.select("id", "language", "reason")


_ITEMS_SQL = "SELECT 'user' AS language, CAST(doc_id AS VARCHAR) AS query FROM labels"


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return model.table(spark, sf, "labels").select(
        F.lit("user").alias("language"), F.col("doc_id").cast("string").alias("query")
    )


@query(
    "p07_progress_lookup",
    with_frames(
        "SELECT language, query, coalesce(last_page, 0) AS last_page FROM items LEFT JOIN progress USING (language, query)",
        "progress",
        items=_ITEMS_SQL,
    ),
)
def p07(spark: SparkSession, sf: str) -> DataFrame:
    return store.last_page(_items(spark, sf), model.progress(spark, sf))


@query(
    "p08_open_work",
    with_frames(
        "SELECT language, query, coalesce(last_page, 0) AS last_page FROM items LEFT JOIN other_progress USING (language, query) "
        "WHERE query <> '' AND coalesce(last_page, 0) <> -1",
        "progress",
        "other_progress",
        items="SELECT language, query FROM progress UNION ALL "
        "SELECT 'label', CASE WHEN toxic = 1 THEN '' ELSE CAST(doc_id AS VARCHAR) END FROM labels",
    ),
)
def p08(spark: SparkSession, sf: str) -> DataFrame:
    labels = model.table(spark, sf, "labels").select(
        F.lit("label").alias("language"),
        F.when(F.col("toxic") == 1, "").otherwise(F.col("doc_id").cast("string")).alias("query"),
    )
    items = model.progress(spark, sf).select("language", "query").unionByName(labels)
    return store.open_work(items, model.other_progress(spark, sf))


@query(
    "p09_first_row",
    with_frames("SELECT id, language, url, hash FROM code ORDER BY id LIMIT 1", "code"),
)
def p09(spark: SparkSession, sf: str) -> DataFrame:
    return model.code(spark, sf).select("id", "language", "url", "hash").orderBy("id").limit(1)


@query("p10_decode_to_utf8", "SELECT doc_id, text AS content, false AS rejected FROM documents "
       "UNION ALL SELECT -1 - page_id, NULL, true FROM pages")
def p10(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    charset = F.when(F.col("lang") == "fr", "UTF-16BE").otherwise("UTF-8")
    docs = model.table(spark, sf, "documents").select(
        "doc_id",
        charset.alias("charset"),
        F.when(F.col("lang") == "fr", F.encode(text, "UTF-16BE")).otherwise(F.encode(text, "UTF-8")).alias("bytes"),
    )
    # A page cut open by a lone continuation byte is not UTF-8.
    pages = model.table(spark, sf, "pages").select(
        (-1 - F.col("page_id")).alias("doc_id"),
        F.lit("UTF-8").alias("charset"),
        F.concat(F.encode("html", "UTF-8"), F.unhex(F.lit("80"))).alias("bytes"),
    )
    content = decoded(F.col("bytes"), F.col("charset"))
    return docs.unionByName(pages).select(
        "doc_id", content.alias("content"), content.isNull().alias("rejected")
    )


@query(
    "p11_urls_of_content",
    with_frames(
        "SELECT url FROM code WHERE content = (SELECT content FROM code ORDER BY size, id LIMIT 1)",
        "code",
    ),
)
def p11(spark: SparkSession, sf: str) -> DataFrame:
    code = model.code(spark, sf)
    shortest = code.select(F.min_by("content", F.struct("size", "id"))).scalar()
    return store.urls_of_content(code, shortest)


# --- joins and merges --------------------------------------------------------


@query(
    "j01_exists_by_hash",
    with_frames(
        "SELECT id, hash IN (SELECT hash FROM curated) AS stored FROM crawled", "crawled", "curated"
    ),
)
def j01(spark: SparkSession, sf: str) -> DataFrame:
    stored = model.curated(spark, sf).select("hash")
    candidates = model.crawled(spark, sf).select("id", "hash")
    known = store.already_stored(candidates, stored).select("id", F.lit(True).alias("stored"))
    new = store.not_stored(candidates, stored).select("id", F.lit(False).alias("stored"))
    return known.unionByName(new)


_MERGED_SQL = with_frames(
    "SELECT id, language, url, hash, size FROM curated UNION ALL "
    "SELECT (SELECT max(id) FROM curated) + row_number() OVER (ORDER BY id), language, url, hash, size "
    "FROM firsts WHERE hash NOT IN (SELECT hash FROM curated)",
    "curated",
    "crawled",
    firsts="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY id) AS r FROM crawled) WHERE r = 1",
)


@query("j02_merge_corpora", _MERGED_SQL)
def j02(spark: SparkSession, sf: str) -> DataFrame:
    merged = store.merge_corpora(model.curated(spark, sf), model.crawled(spark, sf))
    return merged.select("id", "language", "url", "hash", "size")


@query(
    "j03_merge_progress",
    with_frames(
        "SELECT coalesce(s.language, t.language) AS language, coalesce(s.query, t.query) AS query, "
        "coalesce(s.last_page, t.last_page) AS last_page FROM progress t FULL JOIN other_progress s "
        "ON s.language = t.language AND s.query = t.query",
        "progress",
        "other_progress",
    ),
)
def j03(spark: SparkSession, sf: str) -> DataFrame:
    return store.merge_progress(model.progress(spark, sf), model.other_progress(spark, sf))


@query(
    "u01_append_corpora",
    with_frames(
        "SELECT language, url, hash FROM curated UNION ALL SELECT language, url, hash FROM crawled",
        "curated",
        "crawled",
    ),
)
def u01(spark: SparkSession, sf: str) -> DataFrame:
    both = model.curated(spark, sf).unionByName(model.crawled(spark, sf))
    return both.select("language", "url", "hash")


# --- windows over the store --------------------------------------------------


@query(
    "w02_first_arrival",
    with_frames(
        "SELECT id, url, hash FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY id) AS r FROM crawled) WHERE r = 1",
        "crawled",
    ),
)
def w02(spark: SparkSession, sf: str) -> DataFrame:
    return store.first_arrivals(model.crawled(spark, sf)).select("id", "url", "hash")


_BUDGETED = (
    "SELECT language, page, coalesce(sum(sum(size)) OVER (PARTITION BY language ORDER BY page "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {rows} GROUP BY language, page"
)


@query(
    "w03_byte_budget",
    with_frames(
        f"SELECT id, language, page, size FROM code JOIN pages_before USING (language, page) WHERE before < {BUDGET}",
        "code",
        pages_before=_BUDGETED.format(rows="code"),
    ),
)
def w03(spark: SparkSession, sf: str) -> DataFrame:
    return store.within_budget(model.code(spark, sf), BUDGET).select("id", "language", "page", "size")


@query(
    "w04_new_ids",
    with_frames(
        "SELECT row_number() OVER (ORDER BY language, id) + (SELECT max(item_id) FROM benchmark) AS new_id, id FROM code",
        "code",
    ),
)
def w04(spark: SparkSession, sf: str) -> DataFrame:
    highest = model.table(spark, sf, "benchmark").select(F.max("item_id")).scalar()
    files = model.code(spark, sf).select("language", "id")
    numbered = store.dense_index(files, [F.col("language"), F.col("id")], "new_id", 1)
    return numbered.select((F.col("new_id") + highest).alias("new_id"), "id")


# --- totals ------------------------------------------------------------------


@query("a01_count_files", with_frames("SELECT count(id) AS row_count FROM code", "code"))
def a01(spark: SparkSession, sf: str) -> DataFrame:
    return store.count_files(model.code(spark, sf))


@query(
    "a02_bytes_by_language",
    with_frames(
        "SELECT l.language, CAST(coalesce(sum(size), 0) AS BIGINT) AS total_size FROM "
        f"(VALUES {', '.join('(' + quoted(name) + ')' for name, _, _ in LANGUAGES)}) AS l(language) "
        "LEFT JOIN code USING (language) GROUP BY l.language",
        "code",
    ),
)
def a02(spark: SparkSession, sf: str) -> DataFrame:
    names = ", ".join(f"('{name}')" for name, _, _ in LANGUAGES)
    languages = spark.sql(f"SELECT * FROM VALUES {names} AS t(language)")
    return store.bytes_by_language(model.code(spark, sf), languages)


# --- streams -----------------------------------------------------------------


WAVES = 3


def _waves(spark: SparkSession, sf: str) -> list[DataFrame]:
    """The corpus as fetched pages in waves, by page; the last one brings the ends of every other query."""
    source = F.element_at(F.split("url", "/"), 2)
    pages = model.code(spark, sf).withColumn("query", source).select(FETCHED.names)
    ended = pages.where(F.substring("query", 4, 9).cast("int") % 2 == 0).select("language", "query").distinct()
    nothing = {"language", "query", "page"}
    ends = ended.withColumn("page", F.lit(FINISHED_PAGE).cast("long")).select(
        *[F.col(f.name) if f.name in nothing else F.lit(None).cast(f.dataType).alias(f.name) for f in FETCHED]
    )
    last = pages.agg(F.max("page")).first()[0] or 0
    wave = F.floor(F.col("page") * WAVES / (last + 1))
    parts = [pages.where(wave == n) for n in range(WAVES)]
    return [*parts[:-1], parts[-1].unionByName(ends)]


def _ingested(spark: SparkSession, sf: str, budget: int = 0, larger: int = 0) -> Ingest:
    """All waves ingested, each by an ingest started anew; under a `larger` budget in the end, if there is one."""
    path, root = scratch_path(spark, "fetched"), scratch_path(spark, "ingest")
    for wave in _waves(spark, sf):
        wave.write.mode("append").parquet(path)
        Ingest(spark, root, budget).start(path).awaitTermination()
    if larger:
        Ingest(spark, root, larger).resume()
    return Ingest(spark, root, larger or budget)


_ALLOWED_SQL = (
    "SELECT *, split_part(url, '/', 2) AS query FROM code WHERE contains(url, '.') AND "
    "(language, regexp_extract(url, '\\.([^.]*)$', 1)) IN "
    f"(VALUES {fixed_rows(language_extensions())}) AND size <= 262144"
)
_KEPT_SQL = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY id) AS r FROM allowed) WHERE r = 1"


@query(
    "r01_resumable_ingest",
    with_frames(
        "SELECT language, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM kept GROUP BY language",
        "code", allowed=_ALLOWED_SQL, kept=_KEPT_SQL,
    ),
)
def r01(spark: SparkSession, sf: str) -> DataFrame:
    stored = _ingested(spark, sf).code()
    return stored.groupBy("language").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@query(
    "r02_stream_dedup",
    with_frames("SELECT id, language, url, hash FROM kept", "code", allowed=_ALLOWED_SQL, kept=_KEPT_SQL),
)
def r02(spark: SparkSession, sf: str) -> DataFrame:
    return _ingested(spark, sf).code().select("id", "language", "url", "hash")


@query(
    "r03_stream_byte_budget",
    with_frames(
        "SELECT language, CAST(sum(size) AS BIGINT) AS total_size FROM kept JOIN pages_before USING (language, page) "
        f"WHERE before < {BUDGET // 10} GROUP BY language",
        "code",
        allowed=_ALLOWED_SQL,
        kept=_KEPT_SQL,
        pages_before=_BUDGETED.format(rows="kept"),
    ),
)
def r03(spark: SparkSession, sf: str) -> DataFrame:
    return _ingested(spark, sf, BUDGET // 40, BUDGET // 10).bytes_stored()


@query(
    "r04_stream_progress",
    with_frames(
        "SELECT language, query, CASE WHEN CAST(substr(query, 4) AS INT) % 2 = 0 THEN -1 ELSE last_page END AS last_page "
        "FROM (SELECT language, split_part(url, '/', 2) AS query, max(page) + 1 AS last_page FROM code GROUP BY ALL)",
        "code",
    ),
)
def r04(spark: SparkSession, sf: str) -> DataFrame:
    return _ingested(spark, sf).progress()
