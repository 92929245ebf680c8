"""Registered queries over the fixture tables, with SQL for an independent check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import access, text, web
from tessella.operators import answers, catalog, chunking, keywords, layout, retrieval, sessions, store, vectors
from tessella.plans.shapes import frame, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TERMS_SQL = """
listed AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(lower(text), '[a-z][a-z0-9_-]{2,}'), lambda x: trim(x, '_-')),
    lambda x: length(x) >= 2 AND NOT list_contains([%s], x)) AS t FROM documents),
words AS (SELECT doc_id, unnest(t) AS term, unnest(range(len(t))) AS pos FROM listed)
""" % ", ".join(f"'{x}'" for x in text.STOP_TERMS)

CLEAN = r"""trim(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(0), ''), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g'))"""


# ---- text ---------------------------------------------------------------------------------
@query(f"SELECT doc_id, md5({CLEAN}) AS cleaned_md5, length({CLEAN}) AS n FROM documents")
def clean_text(spark, sf_dir):
    c = text.clean_document(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(c).alias("cleaned_md5"), F.length(c).cast("long").alias("n"))


@query("SELECT doc_id, md5(left(text, 200)) AS id, 'rag:v2:' || md5(source || '::' || regexp_replace(trim(lower(text)), '\\s+', ' ', 'g')) AS cache_key FROM documents")
def doc_identity_md5(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", store.identity(F.lit(None).cast("string"), F.col("text")).alias("id"), store.cache_key(F.col("source"), F.col("text")).alias("cache_key"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(lower(text), '\s+', '', 'g'), '[^\p{L}\p{M}\p{N}_]', '', 'g') AS key FROM documents")
def heading_keys(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.heading_key(F.col("text")).alias("key"))


CHUNK_SQL = """
WITH RECURSIVE base AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents),
seps AS (SELECT unnest([chr(10) || chr(10), chr(10), '。', '！', '？', '.', '!', '?', '；', ';', '，', ',', ' ']) AS s, unnest(range(13)) AS o),
w AS (
  SELECT doc_id, t, 0 AS at, 0 AS nxt, 0 AS i, NULL::VARCHAR AS piece FROM base WHERE length(t) > 0
  UNION ALL
  SELECT doc_id, t, nxt, cut, i + 1, trim(regexp_replace(substr(t, nxt + 1, cut - nxt), '^\\s+|\\s+$', '', 'g')) FROM (
    SELECT doc_id, t, nxt, i, CASE WHEN length(t) - nxt <= 1200 THEN length(t) ELSE coalesce((
      SELECT arg_min(nxt + 1200 - (instr(reverse(substr(t, nxt + 1, 1200)), reverse(s)) - 1), o) FROM seps
      WHERE instr(reverse(substr(t, nxt + 1, 1200)), reverse(s)) > 0 AND 1200 - (instr(reverse(substr(t, nxt + 1, 1200)), reverse(s)) - 1) - length(s) > 0), nxt + 1200) END AS cut
    FROM w WHERE nxt < length(t)))
SELECT doc_id, {columns} FROM w WHERE piece IS NOT NULL AND piece <> '' {tail}
"""


@query(CHUNK_SQL.format(columns="(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS chunk_index, length(piece) AS n, md5(piece) AS text_md5", tail=""))
def chunk_char_budget(spark, sf_dir):
    c = chunking.chunks(read(spark, sf_dir, "documents"))
    return c.select("doc_id", "chunk_index", F.length("text").cast("long").alias("n"), F.md5("text").alias("text_md5"))


@query("SELECT lang, count(*) AS chunks, sum(n)::BIGINT AS chars FROM (" + CHUNK_SQL.format(columns="length(piece) AS n", tail="") + ") JOIN documents USING (doc_id) GROUP BY lang")
def chunk_counts_by_lang(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    c = chunking.chunks(d).groupBy("doc_id").agg(F.count("*").alias("c"), F.sum(F.length("text")).alias("n"))
    return c.join(d.select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.sum("c").alias("chunks"), F.sum("n").alias("chars"))


@query(r"SELECT doc_id, (i + 1)::INT AS page, md5(regexp_replace(array_to_string(ls[cut(i)+1:cut(i+1)], chr(10)), '^\s+|\s+$', '', 'g')) AS text_md5 FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), (SELECT unnest(range(4)) AS i)".replace("cut(i+1)", "round_even((i + 1) * len(ls) / 4.0, 0)::INT").replace("cut(i)", "round_even(i * len(ls) / 4.0, 0)::INT"))
def force_four_pages(spark, sf_dir):
    return chunking.force_pages(read(spark, sf_dir, "documents"), 4).select("doc_id", "page", F.md5("text").alias("text_md5"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) FILTER (WHERE regexp_matches(line, '(?i)^\\s*(.{1,200}?)(\\s*\\|\\s*|\\t+|[·•.]{2,}|\\s{2,}|\\s+)(\\d{1,4}|[IVXLCDM]{1,8})\\s*\\|?\\s*$') AND NOT regexp_matches(line, '(?i)^\\s*contents\\s')) AS toc_lines FROM l GROUP BY doc_id""")
def toc_like_lines(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return d.groupBy("doc_id").agg(F.count(F.when(text.toc_entry(F.col("line")).isNotNull(), 1)).alias("toc_lines"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 < 4 AND p_partkey BETWEEN 1 AND 5000 THEN p_partkey::INT END AS hint FROM part")
def page_hints(spark, sf_dir):
    return frame(spark, sf_dir, "hints").select("p_partkey", text.page_hint(F.col("line")).alias("hint"))


@query(f"""SELECT p_partkey, CASE WHEN form = 0 AND n BETWEEN 1 AND 3999 AND length(roman) <= 8 THEN n END AS roman, CASE WHEN form = 1 AND n > 0 THEN n END::BIGINT AS chinese,
CASE form WHEN 0 THEN CASE WHEN n BETWEEN 1 AND 3999 AND length(roman) <= 8 THEN n END WHEN 1 THEN NULL WHEN 3 THEN 0 ELSE n END::BIGINT AS page FROM {sql("numerals")}""")
def numerals(spark, sf_dir):
    t = F.col("token")
    return frame(spark, sf_dir, "numerals").select("p_partkey", text.roman_to_int(t).alias("roman"), text.chinese_to_int(t).alias("chinese"), text.coerce_page(t).alias("page"))


# ---- retrieval ----------------------------------------------------------------------------
ROWS_SQL = "(SELECT doc_id, source AS section, chunk_index + 1 AS page, text FROM (" + CHUNK_SQL.format(columns="(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS chunk_index, piece AS text", tail="") + ") JOIN documents USING (doc_id))".replace("documents USING", "(SELECT doc_id, source FROM documents) USING")


@query(f"SELECT doc_id, page::INT AS page, section, length(text) AS n FROM {ROWS_SQL} WHERE regexp_matches(text, '(?i)(license|copyright|error)')")
def regex_search(spark, sf_dir):
    rows = retrieval.search_rows(read(spark, sf_dir, "documents"))
    return retrieval.search_filter(rows, regex="(license|copyright|error)").select("doc_id", "page", "section", F.length("text").cast("long").alias("n"))


@query(f"SELECT doc_id, page::INT AS page, section FROM {ROWS_SQL} WHERE contains(lower(section), 'src1') AND contains(lower(text), 'tion')")
def section_filter_search(spark, sf_dir):
    rows = retrieval.search_rows(read(spark, sf_dir, "documents"))
    return retrieval.search_filter(rows, section="SRC1", chunk="Tion").select("doc_id", "page", "section")


@query("SELECT doc_id, chunk_index FROM (" + CHUNK_SQL.format(columns="(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS chunk_index", tail="") + ") WHERE chunk_index + 1 BETWEEN 3 AND 4")
def page_overlap_search(spark, sf_dir):
    c = chunking.chunks(read(spark, sf_dir, "documents"))
    page = F.col("chunk_index") + 1
    return retrieval.search_filter(c.withColumns({"page_start": page, "page_end": page}), page_start=3, page_end=4).select("doc_id", "chunk_index")


@query(f"""SELECT doc_id, page::INT AS page, score, row_number() OVER (ORDER BY score DESC, section, doc_id, page)::INT AS rank FROM (
SELECT doc_id, page, section, round(CASE WHEN regexp_extract(text, '(?i)(the)\\s+(tion\\w*)|(\\w*tion)', 1) <> '' THEN 1.0 ELSE 0.0 END + CASE WHEN regexp_extract(text, '(?i)(the)\\s+(tion\\w*)|(\\w*tion)', 2) <> '' THEN 0.5 ELSE 0.0 END
 + CASE WHEN regexp_extract(text, '(?i)(the)\\s+(tion\\w*)|(\\w*tion)', 3) <> '' THEN 0.25 ELSE 0.0 END, 6)::DOUBLE AS score FROM {ROWS_SQL}) ORDER BY score DESC, section, doc_id, page LIMIT 50""")
def capture_group_rank(spark, sf_dir):
    rows = retrieval.search_rows(read(spark, sf_dir, "documents"))
    score = retrieval.group_score(F.col("text"), r"(the)\s+(tion\w*)|(\w*tion)", [1.0, 0.5, 0.25])
    top = retrieval.best(rows.select("doc_id", "page", "section", F.round(score, 6).alias("score")), 50, "section", "doc_id", "page")
    # at most 50 rows are numbered here
    return top.select("doc_id", "page", "score", F.row_number().over(Window.orderBy(F.col("score").desc(), "section", "doc_id", "page")).alias("rank"))


@query("SELECT doc_id, rank, page, pages FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id)::INT AS rank FROM (SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50)), (SELECT 2 AS page, ceil(least(count(*), 50) / 20.0)::INT AS pages FROM documents) WHERE rank BETWEEN 21 AND 40")
def paginate_results(spark, sf_dir):
    top = retrieval.best(read(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("score")), 50, "doc_id")
    ranked = top.select("doc_id", F.row_number().over(Window.orderBy(F.col("score").desc(), "doc_id")).alias("rank"))
    return retrieval.paginate(ranked, 2, 20).select("doc_id", "rank", "page", "pages")


@query("""SELECT event_id, CASE event_id % 9 WHEN 0 THEN 1 WHEN 1 THEN 9 WHEN 2 THEN least(9, c + 2) WHEN 3 THEN greatest(1, c - 3) WHEN 4 THEN 9 WHEN 5 THEN 1 WHEN 6 THEN least(9, greatest(1, event_id % 14)) WHEN 7 THEN NULL ELSE NULL END::INT AS target
FROM (SELECT event_id, 1 + user_id % 9 AS c FROM events)""")
def page_commands(spark, sf_dir):
    e = F.col("event_id")
    forms = [*map(F.lit, ("first", " LAST", "+2", "-3", "+99", "-99")), (e % 14).cast("string"), F.lit("x"), F.lit("")]
    c = read(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*forms), (e % 9 + 1).cast("int")).alias("command"), (1 + F.col("user_id") % 9).cast("int").alias("now"))
    return c.select("event_id", retrieval.page_command(F.col("command"), F.col("now"), F.lit(9)).alias("target"))


@query("SELECT source, doc_id, running FROM (SELECT source, doc_id, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS running FROM documents) WHERE running <= 18000")
def page_budget_fetch(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("source", "doc_id", "text")
    return retrieval.within_budget(d, ["doc_id"], 18000, ["source"]).select("source", "doc_id", "running")


OVERLAP_SQL = r"""WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(left(text, 4000)), '[\p{L}\p{M}\p{N}_]+')) AS t FROM documents),
q AS (SELECT list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+')) AS q FROM benchmark WHERE item_id = 2)
SELECT doc_id, round(len(list_intersect(q, t)) / len(q)::DOUBLE, 6) AS score FROM w, q ORDER BY score DESC, doc_id LIMIT 20"""


@query(OVERLAP_SQL)
def overlap_fallback(spark, sf_dir):
    q = read(spark, sf_dir, "benchmark").where("item_id = 2").select(F.col("text").alias("q"))
    d = read(spark, sf_dir, "documents").join(F.broadcast(q))  # a single query text
    return d.select("doc_id", F.round(retrieval.overlap_score(F.col("q"), F.col("text")), 6).alias("score")).orderBy(F.col("score").desc(), "doc_id").limit(20)


# ---- keywords -----------------------------------------------------------------------------
TFIDF = "WITH " + TERMS_SQL + """, c AS (SELECT doc_id, term, count(*) AS c, min(pos) AS first FROM words GROUP BY 1, 2),
n AS (SELECT doc_id, count(*) AS n FROM words GROUP BY 1), d AS (SELECT term, count(*) AS df FROM c GROUP BY 1), t AS (SELECT count(*) AS total FROM n),
s AS (SELECT c.doc_id, c.term, first, c.c / n.n::DOUBLE * (ln((1 + total) / (1 + df)::DOUBLE) + 1) AS score FROM c JOIN n USING (doc_id) JOIN d USING (term), t),
r AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, first)::INT AS rank, term, round(score, 9) AS score FROM s)
"""


@query(TFIDF + "SELECT doc_id, rank, term, score FROM r WHERE rank <= 12")
def tfidf_topk(spark, sf_dir):
    return keywords.tfidf(read(spark, sf_dir, "documents"), 12)


@query(TFIDF + ", k AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS total FROM r WHERE rank <= 12) SELECT doc_id, count(*) AS matches, min(rank) AS best_rank, min(round(rank / total::DOUBLE, 6)) AS best_percent, string_agg(term, ',' ORDER BY rank) AS terms FROM k WHERE rank <= greatest(1, ceil(total * 0.5)) AND regexp_matches(term, '^th') GROUP BY doc_id")
def keyword_search_percent(spark, sf_dir):
    return keywords.keyword_search(keywords.tfidf(read(spark, sf_dir, "documents"), 12), "^th", percent=0.5)


@query(TFIDF + ", k AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS total FROM r WHERE rank <= 12) SELECT doc_id, count(*) AS matches, min(rank) AS best_rank, min(round(rank / total::DOUBLE, 6)) AS best_percent, string_agg(term, ',' ORDER BY rank) AS terms FROM k WHERE rank <= 3 AND regexp_matches(term, 'on') GROUP BY doc_id")
def keyword_search_rank(spark, sf_dir):
    return keywords.keyword_search(keywords.tfidf(read(spark, sf_dir, "documents"), 12), "on", top_k=3, percent=-1, ranker="rank")


@query("WITH " + TERMS_SQL.replace("words AS (", "words AS MATERIALIZED (") + """, p AS (SELECT term AS "left", lead(term) OVER (PARTITION BY doc_id ORDER BY pos) AS "right" FROM words),
pc AS MATERIALIZED (SELECT "left", "right", count(*) AS n FROM p WHERE "right" IS NOT NULL GROUP BY 1, 2), c AS MATERIALIZED (SELECT term, count(*) AS c FROM words GROUP BY 1),
z AS MATERIALIZED (SELECT (SELECT sum(c) FROM c)::DOUBLE AS tokens, (SELECT sum(n) FROM pc)::DOUBLE AS bigrams),
s AS (SELECT pc.*, ln(n / bigrams / ((a.c / tokens) * (b.c / tokens))) AS pmi, sqrt((a.c / tokens) * (b.c / tokens)) AS pr FROM (SELECT * FROM pc WHERE n >= 10) pc JOIN c a ON a.term = "left" JOIN c b ON b.term = "right", z)
SELECT "left", "right", n, round(pmi, 6) AS pmi, round(pmi * ln(1 + n) / (1 + greatest(-log2(pr), 0)), 6) AS score FROM s WHERE pmi > 0""")
def bigram_pmi(spark, sf_dir):
    return keywords.neighbour_pmi(read(spark, sf_dir, "documents"), 10)


UNCOVERED = """, runs AS (SELECT a.doc_id, a.pos AS lo, b.pos AS hi, string_agg(c.term, '' ORDER BY c.pos) AS joined FROM words a JOIN words b ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos + 1 AND a.pos + 3 JOIN words c ON c.doc_id = a.doc_id AND c.pos BETWEEN a.pos AND b.pos GROUP BY 1, 2, 3),
hit AS (SELECT r.* FROM runs r SEMI JOIN words w ON w.doc_id = r.doc_id AND w.term = r.joined)"""


def surprise_sql(words: str) -> str:
    return "WITH " + TERMS_SQL + UNCOVERED + f""", pr AS (SELECT term, count(*) / (SELECT count(*) FROM words)::DOUBLE AS p FROM words GROUP BY 1),
s AS (SELECT doc_id, term, pos, -log2(greatest(p, 1e-300)) AS s FROM {words} JOIN pr USING (term)),
m AS (SELECT doc_id, term, count(*) AS n, min(pos)::INT AS first, round(sum(s), 6) AS total, round(avg(s), 6) AS mean, round(sum(s) / greatest(log2(count(*) + 1), 1e-12), 6) AS granularity,
  round(sum(s * s), 6) AS square, round(max(s), 6) AS most, round(count(*) * count(*) / sum(1 / greatest(s, 1e-12)), 6) AS harmonic,
  CASE WHEN sum(ln(greatest(s, 1e-300))) <= 709.78 THEN round(sum(ln(greatest(s, 1e-300))), 4) END AS ln_product, CASE WHEN sum(ln(1 + s)) <= 709.78 THEN round(sum(ln(1 + s)), 4) END AS ln_product1 FROM s GROUP BY 1, 2)
"""


@query(surprise_sql("words") + "SELECT * FROM m")
def surprise_metrics(spark, sf_dir):
    c = keywords.term_counts(read(spark, sf_dir, "documents"))
    m = keywords.surprise(c, keywords.unigram_probability(c))
    # an infinite product has no logarithm here
    ln = lambda x: F.when(F.col(x) < float("inf"), F.round(F.log(x), 4))
    return m.withColumns({"ln_product": ln("product"), "ln_product1": ln("product1")}).drop("product", "product1", "row")


@query(surprise_sql("(SELECT * FROM words w ANTI JOIN hit h ON h.doc_id = w.doc_id AND w.pos BETWEEN h.lo AND h.hi)") + """, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY square DESC, granularity DESC, first, term) AS a, row_number() OVER (PARTITION BY doc_id ORDER BY granularity DESC, square DESC, first, term) AS b FROM m),
f AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY a + b, a, b, term)::INT AS rank FROM r) SELECT doc_id, rank, term FROM f WHERE rank <= 12""")
def surprise_fusion(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return keywords.fuse(keywords.surprise(keywords.term_counts(d, 24), keywords.unigram_probability(keywords.term_counts(d))), 12)


@query("WITH " + TERMS_SQL + UNCOVERED + """
SELECT w.doc_id, count(*) AS n, sum(w.pos)::BIGINT AS positions FROM words w ANTI JOIN hit h ON h.doc_id = w.doc_id AND w.pos BETWEEN h.lo AND h.hi GROUP BY 1""")
def covered_subwords(spark, sf_dir):
    w = keywords.uncovered(read(spark, sf_dir, "documents"))
    return w.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("pos").alias("positions"))


# ---- catalogs and trees -------------------------------------------------------------------
M = sql("markers")
KEY = r"regexp_replace(regexp_replace(lower({}), '\s+', '', 'g'), '[^\p{{L}}\p{{M}}\p{{N}}_]', '', 'g')"
RANGES = f"""SELECT doc, ord, regexp_replace(trim(title), '^#\\s*', '') AS title, page AS start, greatest(page, coalesce((SELECT arg_min(n.page, n.ord) FROM {M} n WHERE n.doc = m.doc AND n.ord > m.ord AND n.level <= m.level AND n.page IS NOT NULL) - 1, 12)) AS "end", least(level, 6) AS level FROM {M} m WHERE page > 0 AND title <> ''"""


@query(RANGES)
def catalog_ranges(spark, sf_dir):
    return catalog.ranges(frame(spark, sf_dir, "markers"), F.lit(12))


@query(f"""WITH RECURSIVE m AS (SELECT doc, ord, title, level, (SELECT max(p.ord) FROM {M} p WHERE p.doc = x.doc AND p.ord < x.ord AND p.level < x.level) AS parent FROM {M} x),
r AS (SELECT doc, ord, title AS path FROM m WHERE parent IS NULL UNION ALL SELECT m.doc, m.ord, r.path || '/' || m.title FROM m JOIN r ON r.doc = m.doc AND r.ord = m.parent) SELECT doc, ord, path FROM r""")
def catalog_paths(spark, sf_dir):
    return catalog.paths(frame(spark, sf_dir, "markers")).select("doc", "ord", "path")


@query(f"""SELECT doc, page, ord, level FROM (SELECT p.doc, p.page, r.ord, r.level, row_number() OVER (PARTITION BY p.doc, p.page ORDER BY r.level DESC, r."end" - r.start, r.start, r.ord) AS k FROM {sql("pages")} p JOIN ({RANGES}) r ON r.doc = p.doc AND p.page BETWEEN r.start AND r."end") WHERE k = 1""")
def page_best_section(spark, sf_dir):
    return catalog.best_section(frame(spark, sf_dir, "pages"), catalog.ranges(frame(spark, sf_dir, "markers"), F.lit(12))).select("doc", "page", "ord", "level")


SEG = f"(SELECT *, sum((level = 1)::INT) OVER (PARTITION BY doc ORDER BY ord) AS seg, {KEY.format('title')} AS key FROM {M})"


@query(f"""WITH m AS {SEG}, s AS (SELECT doc, seg, page AS lo, lead(page) OVER (PARTITION BY doc ORDER BY seg) AS hi FROM m WHERE level = 1),
h AS (SELECT doc, page AS hp, {KEY.format('text')} AS key FROM {sql("headings")})
SELECT m.doc, m.ord, coalesce((SELECT min(hp) FROM h WHERE h.doc = m.doc AND h.key = m.key AND hp >= coalesce(s.lo, 1) AND (s.hi IS NULL OR hp < greatest(s.hi, s.lo + 1))), m.page) AS page FROM m LEFT JOIN s ON s.doc = m.doc AND s.seg = m.seg""")
def marker_remap(spark, sf_dir):
    return catalog.remap_by_hits(frame(spark, sf_dir, "markers"), frame(spark, sf_dir, "headings")).select("doc", "ord", "page")


@query(f"""WITH m AS {SEG}, h AS (SELECT DISTINCT doc, {KEY.format('text')} AS key FROM {sql("headings")}),
l AS (SELECT doc, max(seg) AS last, count(DISTINCT seg) AS n FROM m SEMI JOIN h USING (doc, key) GROUP BY doc), c AS (SELECT doc, max(seg) AS segs FROM m GROUP BY doc)
SELECT m.doc, m.ord FROM m JOIN c USING (doc) LEFT JOIN l USING (doc) WHERE NOT coalesce(n >= 2 AND segs - last >= 2, FALSE) OR seg <= last""")
def tail_prune(spark, sf_dir):
    return catalog.prune_tail(frame(spark, sf_dir, "markers"), frame(spark, sf_dir, "headings")).select("doc", "ord")


@query(f"""WITH p AS {sql("pages")}, a AS {sql("anchors")},
b AS (SELECT p.doc, p.page, lo.src AS ls, lo.dst AS ld FROM p ASOF LEFT JOIN a lo ON lo.doc = p.doc AND lo.src <= p.page),
c AS (SELECT b.*, hi.src AS hs, hi.dst AS hd FROM b ASOF LEFT JOIN a hi ON hi.doc = b.doc AND hi.src >= b.page)
SELECT doc, page, greatest(1, least(12, CASE WHEN ls IS NULL AND hs IS NULL THEN page WHEN ls IS NULL THEN page + hd - hs WHEN hs IS NULL THEN page + ld - ls WHEN ls = page THEN ld ELSE round_even(ld + (page - ls) / (hs - ls)::DOUBLE * (hd - ld), 0) END))::INT AS mapped FROM c""")
def page_projection_asof(spark, sf_dir):
    return catalog.project_pages(frame(spark, sf_dir, "pages"), frame(spark, sf_dir, "anchors"), 12)


@query(f"""WITH s AS (SELECT doc, page, string_split(path, '/') AS ps FROM {sql("sections")} WHERE path <> ''), e AS (SELECT DISTINCT doc, page, k AS level, array_to_string(ps[1:k], '/') AS path FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS k FROM s)),
g AS (SELECT *, page - row_number() OVER (PARTITION BY doc, path ORDER BY page) AS g FROM e) SELECT doc, path, level::INT AS level, min(page) AS start, max(page) AS "end" FROM g GROUP BY doc, path, level, g""")
def section_runs(spark, sf_dir):
    return catalog.section_runs(frame(spark, sf_dir, "sections"))


A, B = sql("sections"), sql("sections_2")


@query(f"""WITH a AS {A}, b AS {B}, ca AS (SELECT doc, page FROM (SELECT *, lag(path) OVER (PARTITION BY doc ORDER BY page) AS p FROM a) WHERE p <> path), cb AS (SELECT doc, page FROM (SELECT *, lag(path) OVER (PARTITION BY doc ORDER BY page) AS p FROM b) WHERE p <> path),
m AS (SELECT doc, round(avg((coalesce(a.path, '') = coalesce(b.path, ''))::INT::DOUBLE), 6) AS matched FROM a FULL JOIN b USING (doc, page) GROUP BY doc),
n AS (SELECT doc, count(*) FILTER (WHERE x AND y) AS nboth, count(x) AS na, count(y) AS nb FROM (SELECT *, TRUE AS x FROM ca) FULL JOIN (SELECT *, TRUE AS y FROM cb) USING (doc, page) GROUP BY doc)
SELECT doc, matched, round(CASE WHEN na > 0 THEN nboth / na::DOUBLE ELSE 0 END, 6) AS precision, round(CASE WHEN nb > 0 THEN nboth / nb::DOUBLE ELSE 0 END, 6) AS recall, round(CASE WHEN na + nb > 0 THEN 2 * nboth / (na + nb)::DOUBLE ELSE 0 END, 6) AS f1 FROM m LEFT JOIN n USING (doc)""")
def boundary_f1(spark, sf_dir):
    return catalog.boundary_scores(*(frame(spark, sf_dir, x).withColumnRenamed("path", "section") for x in ("sections", "sections_2")))


@query(f"SELECT doc, ord, (SELECT max(p.ord) FROM {M} p WHERE p.doc = x.doc AND p.ord < x.ord AND p.level < x.level) AS parent FROM {M} x")
def tree_parents(spark, sf_dir):
    return catalog.tree_edges(frame(spark, sf_dir, "markers")).select("doc", "ord", "parent")


@query(f"""WITH RECURSIVE e AS (SELECT doc, ord, (SELECT max(p.ord) FROM {M} p WHERE p.doc = x.doc AND p.ord < x.ord AND p.level < x.level) AS parent FROM {M} x),
r AS (SELECT doc, ord AS node, ord AS anc, 0 AS distance FROM e UNION ALL SELECT r.doc, r.node, e.parent, distance + 1 FROM r JOIN e ON e.doc = r.doc AND e.ord = r.anc WHERE e.parent IS NOT NULL) SELECT doc, node, anc AS ancestor, distance FROM r""")
def tree_flatten(spark, sf_dir):
    return catalog.closure(catalog.tree_edges(frame(spark, sf_dir, "markers")))


@query(f"""WITH RECURSIVE e AS (SELECT doc, ord, (SELECT max(p.ord) FROM {M} p WHERE p.doc = x.doc AND p.ord < x.ord AND p.level < x.level) AS parent FROM {M} x),
r AS (SELECT doc, ord AS node, ord AS anc FROM e UNION ALL SELECT r.doc, r.node, e.parent FROM r JOIN e ON e.doc = r.doc AND e.ord = r.anc WHERE e.parent IS NOT NULL),
l AS (SELECT t.* FROM {sql("texts")} t WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.doc = t.doc AND e.parent = t.ord))
SELECT r.doc, anc AS ord, coalesce(string_agg(CASE WHEN trim(text) <> '' THEN text END, chr(10) || chr(10) ORDER BY l.ord), '') AS merged, min(page) AS first_page, max(page) AS last_page FROM r JOIN l ON l.doc = r.doc AND l.ord = r.node GROUP BY 1, 2""")
def subtree_rollup(spark, sf_dir):
    return catalog.roll_up(catalog.tree_edges(frame(spark, sf_dir, "markers")), frame(spark, sf_dir, "texts"))


@query(f"""SELECT doc, ord, repeat('│  ', level - 1) || CASE WHEN nxt IS NULL OR nxt < level THEN '└─ ' ELSE '├─ ' END || title || ' (' || start || '-' || "end" || ')' AS line FROM (SELECT *, lead(level) OVER (PARTITION BY doc ORDER BY start, level, "end" DESC, title) AS nxt FROM ({RANGES}))""")
def catalog_print(spark, sf_dir):
    r = catalog.ranges(frame(spark, sf_dir, "markers"), F.lit(12)).withColumnRenamed("start", "page")
    return catalog.catalog_lines(r).select("doc", "ord", "line")


# ---- vectors ------------------------------------------------------------------------------
DIST = "round(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))), 6)"
KNN = f"SELECT e.vec_id, e.label, {DIST} AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q ORDER BY distance, e.vec_id LIMIT 24"


def _seven(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    return e, list(e.where("vec_id = 7").first().embedding)


def _hits(spark, sf_dir):
    e, q = _seven(spark, sf_dir)
    return vectors.nearest(e, q, vectors.overfetch(4, True)).withColumn("score", F.round(F.exp(-F.col("distance")), 6))


@query(KNN)
def knn_exact(spark, sf_dir):
    e, q = _seven(spark, sf_dir)
    return vectors.nearest(e, q, vectors.overfetch(4, True)).select("vec_id", "label", "distance")


@query(f"SELECT label, max(round(exp(-distance), 6)) AS section_score FROM ({KNN}) GROUP BY label")
def section_max_score(spark, sf_dir):
    return vectors.section_scores(_hits(spark, sf_dir), "label")


@query(f"WITH k AS (SELECT *, round(exp(-distance), 6) AS score FROM ({KNN})), s AS (SELECT label FROM (SELECT label, sum(score) AS t FROM k GROUP BY label ORDER BY t DESC, label LIMIT 3)), r AS (SELECT * FROM k SEMI JOIN s USING (label)) SELECT vec_id, label, score FROM k WHERE (SELECT count(*) FROM r) < 5 OR label IN (SELECT label FROM s)")
def section_routing(spark, sf_dir):
    return vectors.route_by_section(_hits(spark, sf_dir), "label", 5).select("vec_id", "label", "score")


@query(f"WITH k AS (SELECT *, round(exp(-distance), 6) AS score FROM ({KNN})), s AS (SELECT label, max(score) AS ss FROM k GROUP BY label) SELECT doc_id, round(coalesce(ss, 0) + CASE WHEN contains(lower(text), 'tion') THEN 0.2 ELSE 0 END, 6) AS score FROM documents LEFT JOIN embeddings ON vec_id = doc_id LEFT JOIN s USING (label)")
def vector_boost(spark, sf_dir):
    scores = vectors.section_scores(_hits(spark, sf_dir), "label")
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    d = read(spark, sf_dir, "documents").select("doc_id", "text").join(e, "doc_id", "left").join(F.broadcast(scores), "label", "left")
    none = F.lit(None).cast("double")
    return d.select("doc_id", F.round(vectors.boosted_score(F.col("section_score"), none, none, F.lit("tion"), F.col("text")), 6).alias("score"))


@query(f"WITH k AS (SELECT e.vec_id, (e.vec_id % 3)::INT AS db, round(exp(-{DIST}), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q), t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY db ORDER BY score DESC, vec_id) AS n FROM k) WHERE n <= 5) SELECT vec_id, db, score, db = (SELECT db FROM t WHERE n = 1 ORDER BY score DESC, db LIMIT 1) AS answers FROM t ORDER BY score DESC, db, vec_id LIMIT 5")
def multi_db_merge(spark, sf_dir):
    e, q = _seven(spark, sf_dir)
    arr = F.array(*[F.lit(float(x)) for x in q])
    score = F.round(F.exp(-F.round(vectors.squared_distance(F.col("embedding"), arr), 6)), 6)
    return vectors.merge_sources(e.select("vec_id", (F.col("vec_id") % 3).cast("int").alias("db"), score.alias("score")), "db", 5, "vec_id")


@query(f"SELECT q.vec_id AS query_id, e.vec_id, {DIST} AS distance FROM embeddings e, (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0) q QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY distance, e.vec_id) <= 10")
def ivf_probe(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    cells, centres = vectors.clustered(e, vectors.cells_for(e.count()))
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return vectors.probe(cells, centres, queries, 10)


@query(f"""WITH h AS ({KNN}), r AS (SELECT vec_id, round(exp(-distance), 6) AS score, row_number() OVER (ORDER BY distance, vec_id) AS rank FROM h) SELECT count(*) AS n, CASE WHEN count(*) >= 3 AND max(score) > 0.8 THEN arg_max(vec_id, (score, -rank))::VARCHAR END AS answer FROM r""")
def answer_gate(spark, sf_dir):
    h = _hits(spark, sf_dir)  # 24 rows
    ranked = h.select(F.col("vec_id").cast("string").alias("text"), "score", F.row_number().over(Window.orderBy("distance", "vec_id")).alias("rank"))
    return answers.gate(ranked)


# ---- web and references -------------------------------------------------------------------
LINK = r"""<a href="(?P<link>[^"]*)"[^>]*>(?P<title>.*?)</a>(?P<snippet>[^<]*)"""
_SQL_LINK = r"""(?is)<a href="([^"]*)"[^>]*>(.*?)</a>([^<]*)"""
_PLAIN = "trim(replace(replace(replace(replace(regexp_replace({}, '<.*?>', '', 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&'))"


@query(rf"""WITH h AS (SELECT page_id, replace(html, 'href="/', 'href="https://' || regexp_replace(regexp_replace(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), ':.*$', ''), '^www\.', '') || '/') AS html FROM pages),
a AS (SELECT page_id, regexp_extract_all(html, '{_SQL_LINK}', 1) AS l, regexp_extract_all(html, '{_SQL_LINK}', 2) AS t, regexp_extract_all(html, '{_SQL_LINK}', 3) AS s FROM h),
r AS (SELECT page_id, unnest(range(len(l))) AS i, unnest(l) AS link, unnest(t) AS t, unnest(s) AS s FROM a),
f AS (SELECT page_id, i, trim({_PLAIN.format('link')}) AS link, {_PLAIN.format('t')} AS title, {_PLAIN.format('s')} AS snippet FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY page_id, link ORDER BY i) AS k FROM f WHERE regexp_matches(link, '^https?://')), n AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i)::INT AS "at" FROM k WHERE k = 1)
SELECT page_id, "at", link, CASE WHEN title = '' THEN link ELSE title END AS title, snippet FROM n WHERE "at" <= 10""")
def html_records(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    # the pages' links are relative to their hosts
    base = F.concat(F.lit('href="https://'), web.domain(F.col("url")), F.lit("/"))
    return web.records(p.select("page_id", F.replace("html", F.lit('href="/'), base).alias("html")), LINK)


@query(r"SELECT page_id, md5(regexp_replace(regexp_replace(html, '<.*?>', '', 'g'), '^\s+|\s+$', '', 'g')) AS text_md5 FROM pages")
def strip_html(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.md5(web.strip_tags(F.col("html"))).alias("text_md5"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), ':.*$', ''), '^www\.', '') AS domain FROM pages")
def url_domain(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", web.domain(F.col("url")).alias("domain"))


@query("""SELECT page_id, CASE page_id % 7 WHEN 1 THEN 'https://' || regexp_replace(url, '^https?://', '') WHEN 3 THEN 'not a url ' || page_id WHEN 4 THEN 'HTTP' || substr(url, 5) WHEN 5 THEN 'ftp://h/' || page_id
WHEN 6 THEN 'https://10.0.0.' || (page_id % 256) || ':80/x' ELSE url END AS out FROM pages""")
def url_normalise(spark, sf_dir):
    return frame(spark, sf_dir, "urls").select("page_id", web.normalise_url(F.col("url")).alias("out"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), ':.*$', ''), '^www\.', '') || ' | search_web[1][' || (page_id + 1) || '].link' AS masked FROM pages")
def mask_links(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", web.masked_link(F.col("url"), F.lit(1), F.col("page_id") + 1).alias("masked"))


@query(r"""WITH u AS (SELECT page_id, regexp_extract(url, '^[^?#]*') AS base, regexp_extract(url, '[?]([^#]*)', 1) AS q, regexp_extract(url, '(#.*)$', 1) AS frag FROM pages),
p AS (SELECT page_id, base, frag, list_filter(string_split(q, '&'), lambda x: contains(x, '=')) AS ps FROM u),
n AS (SELECT *, list_transform(ps, lambda x: CASE WHEN starts_with(x, 'page=') THEN 'page=9' ELSE x END) AS qs FROM p)
SELECT page_id, base || '?' || array_to_string(CASE WHEN list_contains(qs, 'page=9') THEN qs ELSE list_append(qs, 'page=9') END, '&') || CASE WHEN length(frag) > 1 THEN frag ELSE '' END AS url FROM n""")
def set_url_parameter(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", web.set_query_parameter(F.col("url"), "page", "9").alias("url"))


@query("SELECT event_id, props ->> '$.k' AS k, regexp_extract(props, '(\\d+)', 1) || '/' || regexp_extract(props, '(\\d+)', 0) AS piped FROM events")
def ref_accessor(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select("event_id", access.access(F.col("props"), "k").alias("k"), access.regex_pipe(F.col("props"), r"(\d+)", "$1/$0").alias("piped"))


# ---- sessions, jobs, tables ---------------------------------------------------------------
@query("SELECT user_id AS session, event_type AS tool, count(*) AS calls FROM events WHERE value >= 20 GROUP BY 1, 2")
def tool_usage_counts(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_type").alias("tool"), (F.col("value") >= 20).alias("ended"))
    return sessions.usage_counts(e)


@query("SELECT user_id AS session, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE value >= 20) WHERE n = 2")
def nth_call(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("session"), "event_id", F.col("event_id").alias("ord"), (F.col("value") >= 20).alias("ended"))
    return sessions.nth_call(e, -2).select("session", "event_id")


@query(f"SELECT session, ord, scope FROM {sql('calls')} WHERE scope = 'a' OR starts_with(scope, 'a>')")
def scope_filter(spark, sf_dir):
    return sessions.in_scope(frame(spark, sf_dir, "calls"), "a").select("session", "ord", "scope")


@query("SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 4")
def history_trim(spark, sf_dir):
    return sessions.last_turns(read(spark, sf_dir, "conversations"), 2).select("conv_id", "turn")


@query("SELECT conv_id, arg_max(text, turn) FILTER (WHERE role = 'assistant' AND regexp_matches(text, '\\S')) AS answer, count(*) AS n_messages FROM conversations GROUP BY conv_id")
def last_answer(spark, sf_dir):
    return sessions.last_answer(read(spark, sf_dir, "conversations"))


@query("SELECT conv_id, turn, running FROM (SELECT conv_id, turn, sum(len(regexp_split_to_array(trim(text), '\\s+'))) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS running FROM conversations) WHERE running <= 120")
def running_budget(spark, sf_dir):
    return sessions.within_running_budget(read(spark, sf_dir, "conversations"), 120).select("conv_id", "turn", "running")


_STAGES = ["load_doc_completed", "build_doc_started", "build_doc_completed", "build_doc_failed", "index_completed"]


@query("""WITH t AS (SELECT event_type, (row_number() OVER (ORDER BY event_type) - 1) % 5 AS i FROM (SELECT DISTINCT event_type FROM events)),
e AS (SELECT user_id AS job, CASE WHEN i <> 4 THEN event_id % 7 END AS doc, i FROM events JOIN t USING (event_type)),
c AS (SELECT job, max(CASE WHEN i = 4 THEN 95 ELSE 0 END) AS common FROM e WHERE doc IS NULL GROUP BY job),
d AS (SELECT job, doc, max(CASE i WHEN 0 THEN 20 WHEN 1 THEN 35 WHEN 2 THEN 70 ELSE 100 END) AS own, max((i = 3)::INT) AS failed FROM e WHERE doc IS NOT NULL GROUP BY 1, 2)
SELECT d.job, round_even(avg(greatest(own, coalesce(common, 0))), 0)::INT AS progress, sum(failed)::BIGINT AS failed FROM d LEFT JOIN c USING (job) GROUP BY d.job""")
def job_fold(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    kinds = e.select("event_type").distinct()
    kinds = kinds.withColumn("stage", F.element_at(F.array(*[F.lit(s) for s in _STAGES]), ((F.row_number().over(Window.orderBy("event_type")) - 1) % 5 + 1)))
    rows = e.join(kinds, "event_type").select(
        F.col("user_id").alias("job"), F.when(F.col("stage") != "index_completed", F.col("event_id") % 7).alias("doc"), "stage"
    )
    return sessions.job_progress(rows)


@query("SELECT doc_id, source, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'stored' ELSE 'new' END AS origin FROM documents")
def append_if_absent(spark, sf_dir):
    """The documents that have labels are stored already; all documents come in."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source")
    stored = d.join(read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").withColumn("origin", F.lit("stored"))
    return stored.unionByName(store.insert_if_absent(stored, d.withColumn("origin", F.lit("new"))))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN upper(source) ELSE source END AS source FROM documents")
def upsert_entries(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "source")
    return store.upsert(d, d.where("doc_id % 2 = 0").withColumn("source", F.upper("source")), "doc_id")


@query("SELECT n_nationkey, c.n AS customers, s.n AS suppliers, round(c.bal, 2) AS balance FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n, sum(c_acctbal) AS bal FROM customer GROUP BY 1) c ON c_nationkey = n_nationkey LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey")
def star_statistics(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select("n_nationkey")
    c = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.sum("c_acctbal").alias("b"))
    s = read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("suppliers"))
    j = n.join(c, n.n_nationkey == c.c_nationkey, "left").join(s, n.n_nationkey == s.s_nationkey, "left")
    return j.select("n_nationkey", "customers", "suppliers", F.round("b", 2).alias("balance"))


CHUNKED = "(" + CHUNK_SQL.format(columns="(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS page, piece AS text", tail="") + ")"


@query(f"""WITH p AS {CHUNKED}, l AS (SELECT doc_id, page, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM p), e AS (SELECT doc_id, page, ls[1] AS f, ls[-1] AS z FROM l)
SELECT doc_id, page, CASE WHEN count(*) OVER (PARTITION BY doc_id, f) >= 2 AND length(f) <= 120 THEN f END AS header, CASE WHEN count(*) OVER (PARTITION BY doc_id, z) >= 2 AND length(z) <= 120 THEN z END AS footer FROM e""")
def header_footer_freq(spark, sf_dir):
    c = chunking.chunks(read(spark, sf_dir, "documents")).select("doc_id", F.col("chunk_index").alias("page"), "text")
    return layout.edge_lines(c)


@query("SELECT event_id, format('{} INFO node-{} request {} took {} ms', strftime(ts, '%Y-%m-%d %H:%M:%S'), user_id % 100, event_id, floor(value * 7)::BIGINT) AS line FROM events")
def log_lines(spark, sf_dir):
    """Lines of a log, one for each event."""
    e = read(spark, sf_dir, "events")
    line = F.format_string("%s INFO node-%d request %d took %d ms", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.col("user_id") % 100, "event_id", F.floor(F.col("value") * 7))
    return e.select("event_id", line.alias("line"))
