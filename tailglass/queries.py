"""The queries over the given tables, by name, with DuckDB SQL for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import names as N
from .functions import text as T
from .operators.context import capped, context_of_hits, with_context
from .operators.counts import file_counts, glob_tally, globs_of, section_counts
from .operators.matching import hit, matched, priority_name
from .operators.report import remainder, report_lines, report_rows
from .operators.rules import Pattern, Watch
from .plans.cursors import committed, expired, judged, new_files, newest, starts
from .plans.incremental import ended, with_sameness
from .plans.rotation import holders, segments
from .sources.listing import best_links, listed_first, looked_into, oldest_first, rotated_copies_listed, union_distinct, without_archives, without_hard_links, without_twins
from .sources.tables import lines_from, lines_of_text, table, with_cuts

WATCH = Watch.of("licences", patterns=["[high] Released under"], ipatterns=["license"], regex=["[low] [0-9]{3}"], iexclude=["apache"], priority="medium", context=1, max_lines=20)
BYTES = Watch.of("words", patterns=["the"], context=2, max_lines=60)
GLOBS = ("/logs/src1*/*", "/logs/src?/*.log", "/logs/*/1*.log")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


# -- lines ---------------------------------------------------------------------------------------

LINES = """WITH lines AS (
  SELECT doc_id AS file, source, unnest(a) AS text, CAST(generate_subscripts(a, 1) AS BIGINT) AS number
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL))"""
HITS = (
    LINES
    + """, marks AS (
  SELECT *, contains(text, 'Released under') AS p1, contains(lower(text), 'license') AS p2,
         regexp_matches(text, '[0-9]{3}') AS p3, contains(lower(text), 'apache') AS x1 FROM lines),
hits AS (
  SELECT *, (p1 OR p2 OR p3) AND x1 AS excluded, (p1 OR p2 OR p3) AND NOT x1 AS hit,
         CASE WHEN (p1 OR p2 OR p3) AND NOT x1 THEN greatest(CASE WHEN p1 THEN 3 END, CASE WHEN p2 THEN 2 END, CASE WHEN p3 THEN 1 END) END AS rank
  FROM marks)"""
)


def kept_sql(n: int, hits: str = HITS, file: str = "file") -> str:
    up, down = (f"(PARTITION BY {file} ORDER BY number ROWS BETWEEN {x})" for x in ("UNBOUNDED PRECEDING AND CURRENT ROW", "CURRENT ROW AND UNBOUNDED FOLLOWING"))
    return f"""{hits}, w AS (
  SELECT *, row_number() OVER (PARTITION BY {file} ORDER BY number) AS rn, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER {up} AS BIGINT) AS mno FROM hits),
v AS (
  SELECT *, max(CASE WHEN hit THEN rn END) OVER {up} AS prev, min(CASE WHEN hit THEN rn END) OVER {down} AS nxt,
         min(CASE WHEN hit THEN mno END) OVER {down} AS nmno FROM w),
u AS (
  SELECT *, NOT hit AND coalesce(rn - prev <= {n}, false) AS after, NOT hit AND coalesce(nxt - rn <= {n}, false) AS before FROM v),
kept AS (
  SELECT *, coalesce(number > lag(number) OVER (PARTITION BY {file} ORDER BY number) + 1, false) AS gap
  FROM u WHERE hit OR after OR before)"""


def doc_lines(spark: SparkSession, d: str) -> DataFrame:
    return lines_of_text(table(spark, d, "documents"), "doc_id", "text", "source")


def doc_hits(spark: SparkSession, d: str, watch: Watch = WATCH) -> DataFrame:
    return matched(doc_lines(spark, d), watch)


def by_pattern(spark: SparkSession, d: str, pattern: Pattern) -> DataFrame:
    return doc_lines(spark, d).where(hit(pattern, F.col("text"))).select("file", "number", "text")


@query(LINES + " SELECT file, number, text FROM lines WHERE contains(text, 'License')")
def match_literal(spark, d):
    return by_pattern(spark, d, Pattern("License"))


@query(LINES + " SELECT file, number, text FROM lines WHERE contains(lower(text), 'license')")
def match_iliteral(spark, d):
    return by_pattern(spark, d, Pattern("LICENSE", ignore_case=True))


@query(LINES + " SELECT file, number, text FROM lines WHERE regexp_matches(text, '[0-9]{3}')")
def match_regex(spark, d):
    return by_pattern(spark, d, Pattern("[0-9]{3}", regex=True))


@query(LINES + " SELECT file, number, text FROM lines WHERE regexp_matches(text, '(?i)\\b(mit|apache) licen[cs]e')")
def match_iregex(spark, d):
    return by_pattern(spark, d, Pattern(r"\b(mit|apache) licen[cs]e", regex=True, ignore_case=True))


@query(HITS + " SELECT file, number, CAST(CASE WHEN p1 THEN 1 WHEN p2 THEN 2 ELSE 3 END AS INTEGER) AS first_pattern FROM hits WHERE hit")
def first_pattern(spark, d):
    return doc_hits(spark, d).where("hit").select("file", "number", "first_pattern")


@query(HITS + " SELECT file, number, concat_ws(',', CASE WHEN p1 THEN '1' END, CASE WHEN p2 THEN '2' END, CASE WHEN p3 THEN '3' END) AS found FROM hits WHERE hit")
def all_patterns(spark, d):
    return doc_hits(spark, d).where("hit").select("file", "number", F.concat_ws(",", F.col("found").cast("array<string>")).alias("found"))


@query(HITS + " SELECT file, number, text FROM hits WHERE hit")
def exclude_drop(spark, d):
    return doc_hits(spark, d).where("hit").select("file", "number", "text")


@query(HITS + " SELECT file, count(*) FILTER (WHERE excluded) AS excluded FROM hits GROUP BY file")
def exclude_counts(spark, d):
    return doc_hits(spark, d).groupBy("file").agg(F.count_if("excluded").alias("excluded"))


@query(HITS + " SELECT file, number, CASE rank WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS priority FROM hits WHERE hit")
def priority_effective(spark, d):
    return doc_hits(spark, d).where("hit").select("file", "number", priority_name(F.col("rank")).alias("priority"))


@query(HITS + " SELECT file, CAST(max(rank) AS INTEGER) AS rank FROM hits GROUP BY file")
def priority_file(spark, d):
    return doc_hits(spark, d).groupBy("file").agg(F.max("rank").alias("rank"))


@query(HITS + " SELECT source, CAST(max(rank) AS INTEGER) AS rank, count(*) FILTER (WHERE hit) AS matched FROM hits GROUP BY source")
def priority_section(spark, d):
    return doc_hits(spark, d).groupBy("source").agg(F.max("rank").alias("rank"), F.count_if("hit").alias("matched"))


@query("SELECT conv_id AS file, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS BIGINT) AS number FROM conversations")
def line_numbers(spark, d):
    own = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return table(spark, d, "conversations").select(F.col("conv_id").alias("file"), "turn", F.row_number().over(own).cast("long").alias("number"))


def context_query(n: int):
    def run(spark, d):
        return with_context(doc_hits(spark, d), n, skips=False).select("file", "number", "hit", "gap")

    run.__name__ = f"context_{n}"
    return query(kept_sql(n) + " SELECT file, number, hit, gap FROM kept")(run)


for _n in (0, 1, 3):
    context_query(_n)


@query(kept_sql(2) + " SELECT file, number, hit FROM kept")
def context_sparse(spark, d):
    return context_of_hits(doc_hits(spark, d), 2).select("file", "number", "hit")


HISTORY = """WITH lines AS (
  SELECT conv_id AS file, turn + 1 AS number, text, turn < 2 AS is_history FROM conversations),
hits AS (SELECT *, contains(lower(text), 'th') AND NOT is_history AS hit FROM lines)"""


@query(kept_sql(2, HISTORY) + " SELECT file, number, hit, is_history, gap FROM kept")
def context_history(spark, d):
    lines = table(spark, d, "conversations").select(F.col("conv_id").alias("file"), F.col("conv_id").cast("string").alias("path"), (F.col("turn") + 1).alias("number"), "text", (F.col("turn") < 2).alias("is_history"))
    return with_context(matched(lines, Watch.of("th", ipatterns=["TH"])), 2).select("file", "number", "hit", "is_history", "gap")


WORDS = LINES + ", hits AS (SELECT *, contains(text, 'the') AS hit, CAST(NULL AS INTEGER) AS rank, false AS excluded FROM lines)"
CAP = "CASE WHEN hit THEN mno <= {0} ELSE (after AND mno <= {0}) OR (before AND nmno <= {0}) END"


@query(kept_sql(2, WORDS) + f" SELECT file, number, hit, gap FROM kept WHERE {CAP.format(2)}")
def cap_scan(spark, d):
    return capped(with_context(doc_hits(spark, d, BYTES), 2, skips=False), 2).select("file", "number", "hit", "gap")


def report_sql(n: int, most: int, size: int, hits: str) -> str:
    return f"""{kept_sql(n, hits)}, stored AS (SELECT * FROM kept WHERE {CAP.format(most)}),
g AS (
  SELECT *, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (ORDER BY file, number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS gmno FROM stored),
b AS (
  SELECT *, coalesce(lag(file) OVER (ORDER BY file, number) <> file, true) AS new_path, row_number() OVER (ORDER BY file, number) AS place,
         number || CASE WHEN hit THEN ': ' ELSE '- ' END || text AS line
  FROM g WHERE gmno < {most} OR (gmno = {most} AND (hit OR after))),
s AS (SELECT *, CASE WHEN new_path THEN '==> ' || file || ' <==' WHEN gap THEN '--' END AS header, new_path AND place > 1 AS blank FROM b),
t AS (
  SELECT *, CAST(strlen(line) + 1 + coalesce(strlen(header) + 1, 0) + CASE WHEN blank THEN 1 ELSE 0 END AS BIGINT) AS bytes FROM s),
rows AS (
  SELECT * FROM (SELECT *, CAST(sum(bytes) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS bytes_so_far FROM t) WHERE bytes_so_far <= {size})"""


def stored(spark, d, watch):
    kept = with_context(doc_hits(spark, d, watch), watch.context, skips=False).withColumn("file_ord", F.col("file"))
    return capped(kept, watch.max_lines)


@query(report_sql(1, 20, 1 << 20, HITS) + " SELECT file, number, hit, gap, new_path, bytes FROM rows")
def render_budget(spark, d):
    return report_rows(stored(spark, d, WATCH), WATCH).select("file", "number", "hit", "gap", "new_path", "bytes")


@query(report_sql(1, 20, 1 << 20, HITS) + """, l AS (
  SELECT place, 1 AS part, '' AS line FROM rows WHERE blank UNION ALL SELECT place, 2, header FROM rows WHERE header IS NOT NULL UNION ALL SELECT place, 3, line FROM rows)
SELECT CAST(row_number() OVER (ORDER BY place, part) AS BIGINT) AS line_no, line FROM l""")  # fmt: skip
def report_text(spark, d):
    return report_lines(stored(spark, d, WATCH), WATCH)


SMALL = Watch(BYTES.name, BYTES.patterns, context=2, max_lines=60, report_bytes=4000)


@query(report_sql(2, 60, 4000, WORDS) + " SELECT file, number, hit, bytes, bytes_so_far FROM rows")
def byte_cap(spark, d):
    return report_rows(stored(spark, d, SMALL), SMALL).select("file", "number", "hit", "bytes", "bytes_so_far")


COUNTS = HITS + """, counts AS (
  SELECT file, count(*) AS lines, count(*) FILTER (WHERE hit) AS matched, count(*) FILTER (WHERE excluded) AS excluded, CAST(max(rank) AS INTEGER) AS rank FROM hits GROUP BY file)"""


@query(COUNTS + " SELECT * FROM counts")
def counts_by_file(spark, d):
    return file_counts(doc_hits(spark, d))


@query(COUNTS + " SELECT count(*) AS files, count(*) FILTER (WHERE matched > 0) AS files_matched, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(matched) AS BIGINT) AS matched, CAST(sum(excluded) AS BIGINT) AS excluded, max(rank) AS rank FROM counts")
def counts_by_section(spark, d):
    return section_counts(file_counts(doc_hits(spark, d)))


@query(report_sql(1, 20, 1 << 20, HITS) + ", n AS (SELECT count(*) FILTER (WHERE hit) AS total FROM hits), m AS (SELECT count(*) FILTER (WHERE hit) AS shown FROM rows) SELECT total, shown, total - shown AS \"left\" FROM n, m")
def matches_left(spark, d):
    return remainder(report_rows(stored(spark, d, WATCH), WATCH), file_counts(doc_hits(spark, d)))


@query(COUNTS + """, paths AS (SELECT counts.*, '/logs/' || source || '/' || file || '.log' AS path FROM counts JOIN documents ON file = doc_id),
e AS (SELECT *, g FROM paths, (SELECT unnest(['/logs/src1*/*', '/logs/src?/*.log', '/logs/*/1*.log']) AS g) WHERE path GLOB g AND NOT (g = '/logs/src?/*.log' AND path NOT GLOB '/logs/src?/*'))
SELECT g AS "glob", count(*) AS files, count(*) FILTER (WHERE lines > 0) AS busy, CAST(sum(matched) AS BIGINT) AS matched FROM e GROUP BY g""")  # fmt: skip
def tally_by_glob(spark, d):
    counts = doc_hits(spark, d).groupBy("file", "source").agg(F.count("*").alias("lines"), F.count_if("hit").alias("matched"))
    return glob_tally(counts, F.concat(F.lit("/logs/"), F.col("source"), F.lit("/"), F.col("file").cast("string"), F.lit(".log")), GLOBS)


@query(HITS + " SELECT file, count(*) FILTER (WHERE hit) AS matched FROM hits GROUP BY file ORDER BY matched DESC, file LIMIT 20")
def top_files(spark, d):
    return doc_hits(spark, d).groupBy("file").agg(F.count_if("hit").alias("matched")).orderBy(F.desc("matched"), "file").limit(20)


CUT_BYTES = """, bytes AS (SELECT *, encode(text) AS data FROM lines),
places AS (
  SELECT *, CASE WHEN strlen(text) > 16000 THEN list_max(list_filter(range(15997, 16002), lambda i: NOT (array_slice(data, i, i) >= '\\x80'::BLOB AND array_slice(data, i, i) < '\\xC0'::BLOB))) END AS edge FROM bytes),
held AS (SELECT *, CASE WHEN edge IS NULL THEN data WHEN edge = 16001 THEN array_slice(data, 1, 16000) ELSE array_slice(data, 1, edge - 1) || '\\xEF\\xBF\\xBD'::BLOB END AS held FROM places)"""


@query(LINES + CUT_BYTES + """ SELECT file, number, strlen(text) > 2000 AS cut, strlen(text) > 16000 AS still_cut, CAST(octet_length(held) AS BIGINT) AS n_bytes, sha256(held) AS sha FROM held""")
def line_cap(spark, d):
    """A character that the cap would break becomes one mark for a broken character."""
    lines = with_cuts(doc_lines(spark, d))
    return lines.select("file", "number", "cut", "still_cut", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.encode("text", "UTF-8"), 256).alias("sha"))


@query("SELECT doc_id, CAST(strlen(text) - strlen(replace(text, chr(10), '')) AS BIGINT) AS newlines FROM documents")
def newline_count(spark, d):
    return table(spark, d, "documents").select("doc_id", T.newlines(F.col("text")).alias("newlines"))


# -- text ----------------------------------------------------------------------------------------


@query("SELECT doc_id, CASE WHEN contains(text, chr(10)) AND strlen(string_split(text, chr(10))[1]) < 4096 THEN sha256(string_split(text, chr(10))[1] || chr(10)) END AS fingerprint FROM documents")
def fingerprints(spark, d):
    return table(spark, d, "documents").select("doc_id", T.fingerprint(F.col("text")).alias("fingerprint"))


@query("SELECT doc_id, sha256(array_slice(encode(text), greatest(octet_length(encode(text)) - 4095, 1), octet_length(encode(text)))) AS anchor FROM documents")
def anchors(spark, d):
    return table(spark, d, "documents").select("doc_id", T.anchor(F.col("text"), F.octet_length("text")).alias("anchor"))


@query(r"SELECT page_id, regexp_replace(replace(html || chr(13) || chr(7), chr(13), ''), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', chr(65533), 'g') AS text FROM pages")
def text_cleaned(spark, d):
    return table(spark, d, "pages").select("page_id", T.clean_text(F.concat("html", F.lit("\r\x07"))).alias("text"))


@query(r"SELECT item_id, trim(regexp_replace(' ' || text || chr(9), '[\t\n]', ' ', 'g')) AS header FROM benchmark")
def header_cleaned(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.clean_header(F.concat(F.lit(" "), F.col("text"), F.lit("\t"))).alias("header"))


@query("SELECT page_id, substring(regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '^[-.]+', ''), 1, 40) || '-20260102T0304.txt' AS name FROM pages")
def attachment_names(spark, d):
    return table(spark, d, "pages").select("page_id", T.attachment_name(F.col("url"), F.lit("2026-01-02 03:04:05").cast("timestamp_ntz")).alias("name"))


# -- names ---------------------------------------------------------------------------------------

COPIES = [
    "o_orderkey AS k",
    "CASE CAST(o_orderkey % 8 AS INT) WHEN 0 THEN 'app.log' WHEN 1 THEN concat('app.log.', CAST(o_orderkey % 50 AS STRING), '.gz') WHEN 2 THEN concat('app.log-', {ymd}) WHEN 3 THEN concat('app.log-', {epoch})"
    " WHEN 4 THEN concat('app.', CAST(o_orderkey % 50 AS STRING), '.log') WHEN 5 THEN 'app.log.bak' WHEN 6 THEN 'app-error.log' ELSE concat('app.log.', {iso}, '.xz') END AS name",
]
SPARK_DATES = {"ymd": "date_format(o_orderdate, 'yyyyMMdd')", "iso": "date_format(o_orderdate, 'yyyy-MM-dd')", "epoch": "CAST(datediff(CAST(o_orderdate AS DATE), DATE'1970-01-01') * 86400L + 3723 AS STRING)"}
DUCK_DATES = {"ymd": "strftime(o_orderdate, '%Y%m%d')", "iso": "strftime(o_orderdate, '%Y-%m-%d')", "epoch": "CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) * 86400 + 3723 AS STRING)"}
COPIES_SQL = "WITH names AS (SELECT o_orderkey, o_orderdate, " + ", ".join(c.format(**DUCK_DATES) for c in COPIES) + " FROM orders)"
DAY = "year(o_orderdate) || ',' || month(o_orderdate) || ',' || day(o_orderdate)"
CLASSIFIED = f""", c AS (
  SELECT k, name, CASE k % 8 WHEN 1 THEN 'numeric' WHEN 4 THEN 'numeric' WHEN 5 THEN 'other' ELSE 'dated' END AS style,
         CASE k % 8 WHEN 1 THEN CAST(-(k % 50) AS STRING) WHEN 4 THEN CAST(-(k % 50) AS STRING) WHEN 5 THEN ''
           WHEN 3 THEN {DAY} || ',1,2,3,' || (date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) * 86400 + 3723) ELSE {DAY} || ',0,0,0,0' END AS key,
         k % 8 IN (1, 7) AS compressed, k % 8 = 4 AS ext_form
  FROM names WHERE k % 8 NOT IN (0, 6))"""


def copies(spark, d):
    return table(spark, d, "orders").selectExpr(*(c.format(**SPARK_DATES) for c in COPIES), "o_orderdate AS modified")


@query(COPIES_SQL + CLASSIFIED + " SELECT * FROM c")
def classify_names(spark, d):
    rows = copies(spark, d).withColumn("c", N.classify(F.col("name"), F.lit("app.log"))).where("c IS NOT NULL")
    return rows.select("k", "name", "c.style", F.concat_ws(",", F.col("c.key").cast("array<string>")).alias("key"), "c.compressed", "c.ext_form")


@query(COPIES_SQL + """ SELECT k, name, CASE k % 8 WHEN 1 THEN '.' || (k % 50) WHEN 2 THEN substring(name, 8) WHEN 3 THEN substring(name, 8) WHEN 5 THEN '.bak' WHEN 7 THEN regexp_replace(substring(name, 8), '\\.xz$', '') END AS suffix FROM names""")
def archive_suffixes(spark, d):
    return copies(spark, d).select("k", "name", N.archive_suffix(F.col("name")).alias("suffix"))


@query(COPIES_SQL + " SELECT DISTINCT '/logs/' || name AS path FROM names WHERE k % 8 IN (0, 6)")
def kin_filter(spark, d):
    return without_archives(copies(spark, d).select(F.concat(F.lit("/logs/"), F.col("name")).alias("path")).distinct())


@query("""SELECT o_custkey AS file, o_orderkey AS k, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS BIGINT) AS age FROM orders""")
def archive_order(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_custkey AS file", "o_orderkey AS k", "concat('app.log-', date_format(o_orderdate, 'yyyyMMdd')) AS name", "lpad(CAST(o_orderkey AS STRING), 20, '0') AS path", "o_orderdate AS modified")
    rows = rows.withColumn("c", N.classify(F.col("name"), F.lit("app.log"))).select("file", "k", "path", "modified", "c.style", "c.key")
    return oldest_first(rows, ["file"]).select("file", "k", "age")


@query("SELECT source AS path, CAST(min(doc_id) AS BIGINT) AS first FROM documents GROUP BY source")
def path_union_distinct(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("path"), F.col("doc_id").alias("first"))
    return union_distinct(docs.where("first % 2 = 0").unionByName(docs), ["first"])


GLOB_PATHS = "'/logs/' || source || '/' || CASE WHEN doc_id % 7 = 0 THEN '.' ELSE '' END || doc_id || CASE doc_id % 3 WHEN 0 THEN '/a.log' WHEN 1 THEN '.log' ELSE '-log' END"
GLOB_LIST = ("/logs/src?/*.log", "/logs/*/[!1-5]*", "/logs/src1*/??.log", "/logs/*/.*", "/logs/*/*?log", "/logs/src[1-3]/*/a.log")
GLOB_SQL = [r"^/logs/src[^/]/([^./][^/]*)?\.log$", r"^/logs/[^/]*/[^1-5./][^/]*$", r"^/logs/src1[^/]*/[^./][^/]\.log$", r"^/logs/[^/]*/\.[^/]*$", r"^/logs/[^/]*/[^./][^/]*log$", r"^/logs/src[1-3]/[^./][^/]*/a\.log$"]


@query(f"WITH p AS (SELECT doc_id, {GLOB_PATHS} AS path FROM documents) SELECT doc_id, path, concat_ws(' ', " + ", ".join(f"CASE WHEN regexp_matches(path, '{r}') THEN '{g}' END" for g, r in zip(GLOB_LIST, GLOB_SQL, strict=True)) + ") AS globs FROM p")
def glob_match(spark, d):
    rows = table(spark, d, "documents").selectExpr("doc_id", f"{GLOB_PATHS} AS path")
    return rows.select("doc_id", "path", F.concat_ws(" ", globs_of(F.col("path"), GLOB_LIST)).alias("globs"))


@query("SELECT o_custkey AS watch, min(lpad(CAST(o_orderkey AS VARCHAR), 12, '0')) AS path FROM orders GROUP BY o_custkey, o_orderkey % 5, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey END")
def hard_links(spark, d):
    """Orders of a customer that have the same remainder are links to one file; with 0, the inode is not known."""
    files = table(spark, d, "orders").selectExpr("o_custkey AS watch", "lpad(CAST(o_orderkey AS STRING), 12, '0') AS path", "nullif(o_orderkey % 5, 0) AS ino", "1 AS dev")
    return without_hard_links(files, ["watch"]).select("watch", "path")


@query("""WITH c AS (SELECT o_custkey AS watch, o_orderkey AS k, '.' || (o_orderkey % 3) AS suffix, o_orderkey % 2 = 0 AS compressed, o_orderkey % 11 = 0 AS ext_form FROM orders),
n AS (SELECT *, count(*) FILTER (WHERE NOT compressed) OVER (PARTITION BY watch, suffix, ext_form) AS plain FROM c) SELECT watch, k FROM n WHERE NOT compressed OR plain <> 1""")
def archive_twins(spark, d):
    found = table(spark, d, "orders").selectExpr("o_custkey AS watch", "o_orderkey AS k", "'.' || (o_orderkey % 3) AS suffix", "o_orderkey % 2 = 0 AS compressed", "o_orderkey % 11 = 0 AS ext_form")
    return without_twins(found, ["watch"]).select("watch", "k")


@query("SELECT source AS path, CASE WHEN bool_or(doc_id % 5 = 0) THEN 'by name' ELSE '*' END AS how FROM documents GROUP BY source")
def listed_before_globs(spark, d):
    rows = table(spark, d, "documents").select(F.col("source").alias("path"), F.when(F.col("doc_id") % 5 == 0, "by name").otherwise("*").alias("glob"))
    return listed_first(rows).select("path", F.col("glob").alias("how")).distinct()


# -- cursors -------------------------------------------------------------------------------------

FILES = [
    "'w' AS watch", "c_custkey AS file", "c_custkey AS ino", "CAST(c_nationkey % 2 AS BIGINT) AS dev",
    "CASE WHEN c_custkey % 5 <> 0 THEN c_custkey * 10 END AS size", "CASE WHEN c_custkey % 7 <> 0 THEN concat('f', CAST(c_custkey % 11 AS STRING)) END AS fingerprint",
    "CASE WHEN c_custkey % 3 <> 0 THEN concat('a', CAST(c_custkey % 6 AS STRING)) END AS anchor", "c_custkey * 9 AS complete",
]
CURSORS = [
    "'w' AS watch", "c_custkey AS file", "c_custkey * 9 + (c_custkey % 13) * 30 AS offset", "c_custkey + CASE WHEN c_custkey % 17 = 0 THEN 1 ELSE 0 END AS ino", "CAST(0 AS BIGINT) AS dev",
    "CASE WHEN c_custkey % 19 <> 0 THEN concat('f', CAST((c_custkey % 11 + CASE WHEN c_custkey % 23 = 0 THEN 1 ELSE 0 END) AS STRING)) END AS fingerprint",
    "concat('a', CAST(c_custkey % 6 + CASE WHEN c_custkey % 29 = 0 THEN 1 ELSE 0 END AS STRING)) AS anchor", "TIMESTAMP '2026-01-01 00:00:00' AS last_seen",
]
JUDGED_SQL = f"""WITH f AS (SELECT {', '.join(FILES)} FROM customer), s AS (SELECT {', '.join(CURSORS)} FROM customer WHERE c_custkey % 4 <> 3),
j AS (
  SELECT f.*, s.offset AS saved_offset, s.dev AS saved_dev, CASE WHEN s.offset IS NULL THEN 'first-sight' WHEN s.ino <> f.ino THEN 'rotated'
    WHEN s.fingerprint <> f.fingerprint THEN 'rotated' WHEN s.fingerprint IS NOT NULL AND f.fingerprint IS NULL THEN 'truncated'
    WHEN f.size < s.offset THEN 'truncated' WHEN s.anchor <> f.anchor THEN 'truncated' ELSE 'continue' END AS verdict
  FROM f LEFT JOIN s USING (watch, file))"""


def judged_files(spark, d):
    rows = table(spark, d, "customer")
    return judged(rows.selectExpr(*FILES), rows.where("c_custkey % 4 <> 3").selectExpr(*CURSORS))


@query(JUDGED_SQL + " SELECT file, verdict, verdict = 'continue' AND coalesce(saved_dev <> dev, false) AS moved FROM j")
def identity_verdict(spark, d):
    return judged_files(spark, d).select("file", "verdict", "moved")


@query(JUDGED_SQL + " SELECT file, CAST(CASE verdict WHEN 'first-sight' THEN CASE WHEN file % 2 = 0 THEN 0 ELSE complete END WHEN 'continue' THEN saved_offset ELSE 0 END AS BIGINT) AS start FROM j")
def read_starts(spark, d):
    return starts(judged_files(spark, d), F.col("file") % 2 == 0).select("file", "start")


LOGS = "SELECT user_id AS file, event_id, event_type AS text, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS number FROM events"


def event_lines(spark, d):
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(F.col("user_id").alias("file"), "event_id", F.col("event_type").alias("text"), F.row_number().over(own).cast("long").alias("number"))


@query(f"WITH l AS ({LOGS}) SELECT file, number, text FROM l WHERE CASE WHEN file % 3 = 0 THEN number > file % 10 ELSE true END AND text = 'error'")
def incremental_read(spark, d):
    lines = event_lines(spark, d)
    cursors = lines.select("file").distinct().where("file % 3 = 0").select(F.col("file").alias("f"), (F.col("file") % 10).alias("offset"))
    return lines.join(cursors, F.col("file") == F.col("f"), "left").where((F.col("number") > F.coalesce("offset", F.lit(0))) & hit(Pattern("error"), F.col("text"))).select("file", "number", "text")


READ_ON = """WITH docs AS (SELECT doc_id AS file, string_split(text, chr(10)) AS a, doc_id % 5 AS k FROM documents WHERE text IS NOT NULL),
each AS (SELECT file, k, len(a) AS n, unnest(a) AS line, unnest(range(1, len(a) + 1)) AS number FROM docs),
ends AS (SELECT *, CAST(sum(strlen(line) + 1) OVER (PARTITION BY file ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS end_offset FROM each)
SELECT file, number, strlen(line) > 2000 AS cut, strlen(line) > 16000 AS still_cut, CASE WHEN number = n THEN end_offset - 1 ELSE end_offset END AS end_offset,
  CASE WHEN strlen(line) <= 2000 THEN line END AS text FROM ends WHERE number > least(k, n - 1) AND (number < n OR strlen(line) > 16000)"""


@query(READ_ON)
def read_on(spark, d):
    """Each text is a file whose cursor stands behind a few lines: what the line source reads from there, by bytes.  The
    last line has no end and waits, unless it is too long for that.  Lines over 2000 bytes are decoded in pieces, so their text is left out."""
    texts = table(spark, d, "documents").where("text IS NOT NULL").selectExpr("doc_id AS file", "encode(text, 'UTF-8') AS data", "least(doc_id % 5, size(split(text, '\n', -1)) - 1) AS number", "text")
    rows = texts.withColumn("start", F.octet_length(F.expr("substring_index(text, '\n', CAST(number AS INT))")) + F.when(F.col("number") > 0, 1).otherwise(0))
    rows = rows.withColumns({"start": F.when(F.col("number") > 0, F.col("start")).otherwise(0).cast("long"), "number": F.col("number").cast("long")})
    return lines_from(rows).select("file", "number", "cut", "still_cut", "end_offset", F.when(~F.col("cut"), F.col("text")).alias("text"))


@query(f"WITH l AS ({LOGS}) SELECT file, max(number) AS start FROM l GROUP BY file")
def first_sight_end(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("file")).agg(F.count("*").alias("start"))


@query("WITH m AS (SELECT event_type, min(ts) + INTERVAL 2 DAY AS moment FROM events GROUP BY event_type) SELECT event_id AS file FROM events JOIN m USING (event_type) WHERE ts >= moment")
def new_file_rule(spark, d):
    files = table(spark, d, "events").select(F.lit("w").alias("watch"), F.col("event_id").alias("file"), F.col("event_type").alias("glob"), F.col("ts").alias("modified"))
    moments = files.groupBy("watch", "glob").agg((F.min("modified") + F.expr("INTERVAL 2 DAY")).alias("moment"))
    return new_files(files, moments).select("file")


@query("SELECT event_id AS file FROM events WHERE NOT (date_diff('second', date_trunc('second', ts), (SELECT date_trunc('second', max(ts)) FROM events)) > 10 * 86400)")
def ttl_expiry(spark, d):
    events = table(spark, d, "events")
    cursors = events.select(F.col("event_id").alias("file"), F.date_trunc("second", "ts").alias("last_seen"))
    now = events.agg(F.date_trunc("second", F.max("ts")).alias("now")).first()["now"]
    return expired(cursors, F.lit(now), 10).select("file")


@query("""WITH r AS (SELECT c_custkey AS file, c_custkey % 4 <> 3 AS had, c_custkey % 3 AS matched, c_custkey % 11 = 0 AS failed, c_nationkey % 2 = 0 AS accepted, c_nationkey AS w FROM customer)
SELECT w AS watch, file, CAST(CASE WHEN NOT failed AND (matched = 0 OR accepted) THEN 1000 WHEN had THEN 10 ELSE 500 END AS BIGINT) AS "offset" FROM r""")  # fmt: skip
def commit_matrix(spark, d):
    rows = table(spark, d, "customer").withColumns({"watch": F.col("c_nationkey"), "file": F.col("c_custkey")})
    blank = {"ino": F.lit(1).cast("long"), "dev": F.lit(1).cast("long"), "fingerprint": F.lit("f"), "anchor": F.lit("a"), "last_seen": F.lit("2026-01-01").cast("timestamp_ntz")}
    cursors = rows.where("c_custkey % 4 <> 3").select("watch", "file", F.lit(10).cast("long").alias("offset"), *(v.alias(k) for k, v in blank.items()))
    reads = rows.select("watch", "file", (F.col("file") % 3).alias("matched"), (F.col("file") % 11 == 0).alias("failed"), F.lit(500).cast("long").alias("start_offset"), F.lit(1000).cast("long").alias("offset"), *(v.alias(k) for k, v in blank.items()))
    delivered = rows.select("watch", (F.col("watch") % 2 == 0).alias("accepted")).distinct()
    return committed(cursors, reads, delivered, F.lit("2026-01-02").cast("timestamp_ntz")).select("watch", "file", "offset")


@query("SELECT event_type AS watch, max(ts) AS newest FROM events GROUP BY event_type")
def newest_moment(spark, d):
    return newest(table(spark, d, "events").select(F.col("event_type").alias("watch"), F.col("props").alias("glob"), F.col("ts").alias("moment")))


# Rotated copies: each customer is a log, each of its orders a dated copy.
LOST = ["'w' AS watch", "c_custkey AS file", "CAST(NULL AS BIGINT) AS ino", "CAST(NULL AS BIGINT) AS dev", "CAST(NULL AS BIGINT) AS size", "'rotated' AS verdict", "CAST(40 AS BIGINT) AS saved_offset", "CAST(-1 AS BIGINT) AS saved_ino",
        "CAST(1 AS BIGINT) AS saved_dev", "concat('f', CAST(c_custkey % 2 AS STRING)) AS saved_fingerprint", "CAST(NULL AS STRING) AS saved_anchor", "TIMESTAMP '2000-01-01 00:00:00' AS saved_last_seen"]
HELD = ["'w' AS watch", "o_custkey AS file", "o_orderkey AS ino", "CAST(1 AS BIGINT) AS dev", "o_orderkey % 90 AS size", "concat('f', CAST(o_orderkey % 2 AS STRING)) AS fingerprint", "CAST(NULL AS STRING) AS anchor", "o_orderdate AS modified", "CAST(o_orderkey AS STRING) AS path"]
HOLDERS_SQL = f"""WITH l AS (SELECT {', '.join(LOST)} FROM customer), c AS (SELECT {', '.join(HELD)} FROM orders),
p AS (SELECT l.file, c.path, c.modified, modified >= saved_last_seen - INTERVAL 2 SECOND AS recent FROM l JOIN c USING (watch, file) WHERE fingerprint = saved_fingerprint AND c.size >= saved_offset),
h AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY CASE WHEN recent THEN 1 ELSE 3 END, CASE WHEN recent THEN epoch_us(modified) ELSE -epoch_us(modified) END, path) AS n FROM p) WHERE n = 1)"""


def lost_logs(spark, d):
    copies_ = table(spark, d, "orders").selectExpr(*HELD, "date_format(o_orderdate, 'yyyyMMdd') AS _ymd")
    copies_ = copies_.withColumn("c", N.classify(F.concat(F.lit("app.log-"), F.col("_ymd")), F.lit("app.log"))).select("*", "c.style", "c.key", "c.ext_form").drop("c", "_ymd")
    return table(spark, d, "customer").selectExpr(*LOST), copies_


@query(HOLDERS_SQL + " SELECT file, path, CAST(CASE WHEN recent THEN 1 ELSE 3 END AS INTEGER) AS stage FROM h")
def rotation_holder(spark, d):
    return holders(*lost_logs(spark, d)).select("file", F.col("c_path").alias("path"), "stage")


@query(f"""WITH l AS (SELECT {', '.join(LOST)} FROM customer), c AS (SELECT {', '.join(HELD)} FROM orders),
m AS (SELECT o_custkey AS file, max(o_orderdate) AS parked FROM orders GROUP BY o_custkey),
p AS (SELECT l.file, c.path, c.ino, c.ino = m.file + 100 AS own FROM l JOIN c USING (watch, file) JOIN m ON m.file = l.file WHERE date_trunc('second', modified) = date_trunc('second', parked) AND c.size >= saved_offset AND fingerprint = saved_fingerprint)
SELECT file, path FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY NOT own, path) AS n FROM p) WHERE n = 1""")  # fmt: skip
def parked_cursor(spark, d):
    """Cursors parked on the newest order of each customer."""
    lost, found = lost_logs(spark, d)
    parked = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("file")).agg(F.max("o_orderdate").alias("saved_modified"))
    lost = lost.join(parked, "file").withColumns({"saved_ino": F.col("file") + 100})
    return holders(lost, found).where("stage = 0").select("file", F.col("c_path").alias("path"))


@query(HOLDERS_SQL + """, a AS (
  SELECT l.file, c.path, c.modified, h.path AS held, CASE WHEN h.path IS NULL THEN c.modified >= saved_last_seen - INTERVAL 2 SECOND ELSE c.path = h.path OR CAST(c.modified AS DATE) > CAST(h.modified AS DATE) END AS wanted
  FROM l JOIN c USING (watch, file) LEFT JOIN h ON h.file = l.file)
SELECT file, path, CAST(row_number() OVER (PARTITION BY file ORDER BY CAST(modified AS DATE), path) AS INTEGER) AS seg, CAST(CASE WHEN path = held THEN 40 ELSE 0 END AS BIGINT) AS start FROM a WHERE wanted""")  # fmt: skip
def rotation_segments(spark, d):
    return segments(*lost_logs(spark, d)).select("file", "path", "seg", "start")


TIES = HELD[:-1] + ["concat(CAST(o_orderkey AS STRING), '.gz') AS path"]
TIES_SQL = f"""WITH l AS (SELECT {', '.join(LOST)} FROM customer), c AS (SELECT {', '.join(TIES)}, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderkey % 3 <> 0 AS whole FROM orders),
p AS (SELECT l.file, c.path, c.month, c.modified, c.whole, modified >= saved_last_seen - INTERVAL 2 SECOND AS recent FROM l JOIN c USING (watch, file) WHERE fingerprint = saved_fingerprint AND c.size >= saved_offset),
b AS (SELECT *, bool_or(recent) OVER (PARTITION BY file) AS any_recent, coalesce(min(CASE WHEN recent THEN month END) OVER (PARTITION BY file), max(month) OVER (PARTITION BY file)) AS best FROM p),
t AS (SELECT *, min(modified) OVER (PARTITION BY file) AS measured, row_number() OVER (PARTITION BY file ORDER BY NOT whole, path) AS n FROM b WHERE month = best AND recent = any_recent)"""


@query(TIES_SQL + " SELECT file, path, CAST(measured AS TIMESTAMP) AS measured FROM t WHERE n = 1")
def generation_ties(spark, d):
    """Orders of one month are copies of one generation, and every third can't be read to its end."""
    found = table(spark, d, "orders").selectExpr(*TIES, "date_format(o_orderdate, 'yyyyMM01') AS _ymd")
    found = found.withColumn("c", N.classify(F.concat(F.lit("app.log-"), F.col("_ymd")), F.lit("app.log"))).select("*", "c.style", "c.key", "c.ext_form").drop("c", "_ymd")
    whole = lambda rows: rows.select("path", (F.substring_index("path", ".", 1).cast("long") % 3 != 0).alias("whole"))
    rows = holders(table(spark, d, "customer").selectExpr(*LOST), found, whole)
    return rows.select("file", F.col("c_path").alias("path"), F.col("measured").cast("timestamp_ntz").alias("measured"))


@query("""WITH f AS (SELECT o_custkey AS file, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS path, o_orderkey % 5 AS ino, CASE o_orderkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS rank FROM orders)
SELECT file, path FROM (SELECT *, row_number() OVER (PARTITION BY file, ino ORDER BY rank, path) AS n FROM f) WHERE n = 1""")
def link_rank(spark, d):
    """Orders of a customer that have the same remainder are links to one file, named in three ways."""
    found = table(spark, d, "orders").selectExpr("o_custkey AS file", "lpad(CAST(o_orderkey AS STRING), 12, '0') AS path", "o_orderkey % 5 AS ino", "1 AS dev", "element_at(array('unnamed', 'other', 'dated'), CAST(o_orderkey % 3 AS INT) + 1) AS style")
    return best_links(found, ["file"]).select("file", "path")


@query("""SELECT o_orderkey AS file, o_orderkey % 4 <> 3 AND o_orderkey % 2 = 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AS same FROM orders""")
def unchanged_skip(spark, d):
    """Compressed files (even keys) with a cursor that has another size (every fifth) or time (every seventh) are opened."""
    orders = table(spark, d, "orders")
    files = orders.selectExpr("concat(CAST(o_orderkey AS STRING), if(o_orderkey % 2 = 0, '.gz', '')) AS file", "o_orderkey AS k", "o_orderkey AS length", "CAST(o_orderdate AS TIMESTAMP) AS modified", "o_orderkey AS ino", "1L AS dev")
    cursors = orders.where("o_orderkey % 4 <> 3").selectExpr("concat(CAST(o_orderkey AS STRING), if(o_orderkey % 2 = 0, '.gz', '')) AS file", "0L AS offset", "o_orderkey AS ino", "1L AS dev", "o_orderkey + if(o_orderkey % 5 = 0, 1, 0) AS size", "CAST(o_orderdate AS TIMESTAMP) + make_dt_interval(0, 0, 0, if(o_orderkey % 7 = 0, 1, 0)) AS modified")
    return with_sameness(files, cursors).select(F.col("k").alias("file"), F.col("_same").alias("same"))


CHAINS = """WITH s AS (
  SELECT o_custkey AS file, o_orderkey AS k, o_orderdate AS modified, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS seg, o_orderkey % 7 = 0 AS renamed, o_orderkey % 5 <> 0 AS marked FROM orders),
stops AS (SELECT *, min(CASE WHEN renamed THEN seg END) OVER (PARTITION BY file) AS stop FROM s),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY seg DESC) AS n FROM stops WHERE marked AND seg < coalesce(stop, 1000000)) WHERE n = 1)"""


@query(CHAINS + """ SELECT file, CAST(k AS VARCHAR) AS path, CAST(100 + k % 1000 AS BIGINT) AS "offset", CAST(k % 50 AS BIGINT) AS line FROM last""")
def parked_made(spark, d):
    """Each customer is a log that is away, each order a copy that was read; every seventh had moved, and there the chain
    stops.  The cursor is parked on the last copy before that with a first line, and then found there by its time and inode."""
    orders = table(spark, d, "orders")
    seg = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("int")
    members = orders.select("o_custkey", "o_orderkey", "o_orderdate", seg.alias("seg"))  # numbered before the wide state is made
    state = F.to_json(F.struct(
        F.expr("if(o_orderkey % 7 = 0, 'renamed', 'ok')").alias("why"), F.lit(0).cast("long").alias("part"), F.lit(False).alias("in_line"), F.col("o_orderkey").alias("ino"), F.lit(1).alias("dev"), F.lit(5).alias("size"),
        F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("modified"), F.expr("if(o_orderkey % 5 <> 0, 'f', NULL)").alias("fingerprint"), F.lit("a").alias("anchor"),
    ))
    read = members.select(F.expr("concat('log ', CAST(o_custkey AS STRING))").alias("file"), F.col("o_orderkey").cast("string").alias("path"), "seg", (F.col("o_orderkey") % 50).alias("number"), F.lit(False).alias("is_history"), (F.col("o_orderkey") % 1000 + 100).alias("end_offset"), state.alias("state"))
    _, reached, _ = ended(read)
    saved = reached.where("NOT failed").select("file", *(F.col(c).alias(f"saved_{c}") for c in ("offset", "line", "ino", "dev", "fingerprint", "anchor", "modified")))
    lost = saved.withColumns({"watch": F.lit("w"), "verdict": F.lit("rotated"), "saved_last_seen": F.lit("2030-01-01").cast("timestamp")} | {c: F.lit(None).cast("long") for c in ("ino", "dev", "size")})
    found = orders.selectExpr("'w' AS watch", "concat('log ', CAST(o_custkey AS STRING)) AS file", "CAST(o_orderkey AS STRING) AS path", "'dated' AS style", "array(CAST(1 AS BIGINT)) AS key", "o_orderkey AS ino", "1L AS dev", "5000L AS size", "'f' AS fingerprint", "'a' AS anchor", "CAST(o_orderdate AS TIMESTAMP) AS modified", "false AS ext_form")
    return holders(lost, found).where("stage = 0").select(F.substring("file", 5, 20).cast("long").alias("file"), F.col("c_path").alias("path"), F.col("saved_offset").alias("offset"), F.col("saved_line").alias("line"))


@query("""WITH n AS (SELECT DISTINCT o_custkey % 100 AS dir, o_orderkey % 30 AS n FROM orders)
SELECT '/logs/' || a.dir || '/a.log.' || a.n AS path, '/logs/' || a.dir || '/a.log' AS log FROM n a JOIN n b ON a.dir = b.dir AND a.n > 0 AND b.n = 0""")
def copies_listed(spark, d):
    """A folder for some customers; each lists the copies that its orders number, and the log if there is a 0."""
    files = table(spark, d, "orders").selectExpr("concat('/logs/', CAST(o_custkey % 100 AS STRING), '/a.log', if(o_orderkey % 30 = 0, '', concat('.', CAST(o_orderkey % 30 AS STRING)))) AS path")
    return rotated_copies_listed(files)


@query("""SELECT watch, "glob" FROM (SELECT DISTINCT c_nationkey AS watch, c_mktsegment AS "glob" FROM customer) g
WHERE NOT EXISTS (SELECT 1 FROM customer u WHERE u.c_nationkey = g.watch AND u.c_mktsegment = g."glob" AND u.c_custkey % 11 = 0)""")
def globs_looked_into(spark, d):
    rows = table(spark, d, "customer").selectExpr("c_nationkey AS watch", "c_mktsegment AS `glob`", "c_custkey AS file")
    return looked_into(rows.select("watch", "glob").distinct(), rows.where("file % 11 = 0"))
