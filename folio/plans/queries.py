"""The registered queries over the driver's tables, each with the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions import ids
from folio.operators import analysis, chunking, features, tokens, vectors
from folio.plans import bridge
from folio.plans.scratch import scratch
from folio.sources import archives, metadata, stores, volumes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_LINES = r"""
d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls, lang, source FROM documents),
ln AS (SELECT 'doc.' || doc_id AS htid, CAST(i // 4 + 1 AS INTEGER) AS page, CASE i % 4 WHEN 0 THEN 'header' WHEN 3 THEN 'footer' ELSE 'body' END AS section, line
  FROM (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM d))"""
_TOKENS = _LINES + r""",
tk AS (SELECT htid, page, section, token, CASE WHEN regexp_matches(token, '^[0-9]') THEN 'CD' WHEN regexp_matches(token, '^\p{Lu}') THEN 'NNP' WHEN regexp_matches(token, '^\p{L}') THEN 'NN' ELSE 'SYM' END AS pos
  FROM (SELECT htid, page, section, unnest(regexp_extract_all(line, '[\p{L}]+|[0-9]+|[^\s\p{L}0-9]')) AS token FROM ln)),
t AS (SELECT htid, page, section, token, pos, count(*) AS count FROM tk GROUP BY ALL)"""
_CHARS = _LINES + r""",
tr AS (SELECT htid, page, section, trim(line, ' ') AS line FROM ln WHERE trim(line, ' ') <> ''),
c AS (SELECT htid, page, section, place, char, count(*) AS count FROM (
  SELECT htid, page, section, 'begin' AS place, substring(line, 1, 1) AS char FROM tr UNION ALL SELECT htid, page, section, 'end', right(line, 1) FROM tr) GROUP BY ALL)"""
_SECTIONS = _LINES + r""",
s AS (SELECT htid, page, section, CAST(sum(len(regexp_extract_all(line, '[\p{L}]+|[0-9]+|[^\s\p{L}0-9]'))) AS INTEGER) AS tokenCount, CAST(count(*) AS INTEGER) AS lineCount,
  CAST(sum(CASE WHEN trim(line, ' ') = '' THEN 1 ELSE 0 END) AS INTEGER) AS emptyLineCount, CAST(max(length(regexp_extract(line, '^\p{Lu}*'))) AS INTEGER) AS capAlphaSeq,
  CAST(sum(CASE WHEN trim(line, ' ') <> '' THEN len(regexp_extract_all(line, '[.!?]')) END) AS INTEGER) AS sentenceCount FROM ln GROUP BY ALL)"""


def query(name: str, sql: str | None, base: str = "") -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = f"WITH {base.strip()} {sql}" if base else sql
        return f

    return add


def _texts(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")


def _tokens(s: SparkSession, d: str) -> DataFrame:
    return bridge.tokens(bridge.by_volume(_texts(s, d)))


def _sum(keys: str, where: str = "section = 'body'", value: str = "sum(count)", word: str | None = None) -> str:
    return f"SELECT {keys}, CAST({value} AS BIGINT) AS count FROM {'(SELECT *, lower(token) AS lowercase FROM t)' if 'lowercase' in keys else 't'} WHERE {where} GROUP BY {', '.join(keys.split(', '))}"


query("pos_totals", _sum("pos"), _TOKENS)(lambda s, d: analysis.pos_totals(_tokens(s, d)))


def _fold(name: str, sql: str, **kw) -> None:
    query(name, sql, _TOKENS)(lambda s, d: tokens.tokenlist(_tokens(s, d), **kw))


_fold("tokenlist_default", _sum("htid, page, section, token, pos"))
_fold("tokenlist_all", _sum("htid, page, section, token, pos", "true"), section="all")
_fold("tokenlist_group", _sum("htid, page, token, pos", "true"), section="group")
_fold("tokenlist_header", _sum("htid, page, section, token, pos", "section = 'header'"), section="header")
_fold("tokenlist_footer", _sum("htid, page, section, token, pos", "section = 'footer'"), section="footer")
_fold("tokenlist_nocase", _sum("htid, page, section, lowercase, pos"), case=False)
_fold("tokenlist_nopos", _sum("htid, page, section, token"), pos=False)
_fold("tokenlist_nopages", _sum("htid, section, token, pos"), pages=False)
_fold("tokenlist_group_nocase_nopos_nopages", _sum("htid, lowercase", "true"), section="group", case=False, pos=False, pages=False)
_fold("tokenlist_page_select", _sum("htid, page, section, token, pos", "section = 'body' AND page = 2"), page_select=2)
_fold("tokenlist_no_htid", "SELECT page, section, token, pos, CAST(count AS BIGINT) AS count FROM t WHERE section = 'body'", htid=False)
_fold("tokenlist_drop_section", "SELECT htid, page, token, CAST(n AS BIGINT) AS count FROM (SELECT htid, page, section, token, sum(count) AS n FROM t GROUP BY ALL)", section="all", pos=False, drop_section=True)
_fold("page_freq_pages_kept", _sum("htid, page, section, lowercase", value="1"), case=False, pos=False, page_freq=True)
_fold("page_freq_distinct", _sum("htid, lowercase", "true", "count(DISTINCT page)"), section="group", case=False, pos=False, pages=False, page_freq=True)
_fold("page_freq_rows", _sum("htid, lowercase", "true", "count(*)"), section="group", case=False, pos=False, pages=False, page_freq=True, freq="rows")


@query("page_freq_bitmaps", _sum("htid, lowercase", "true", "count(DISTINCT page)"), _TOKENS)
def _bitmaps(s: SparkSession, d: str) -> DataFrame:
    """The bitmaps are stored as they lie, a bucket a task, so that they are folded without a shuffle."""
    docs, path = _texts(s, d), scratch(s, "bitmaps")
    buckets = bridge.volume_tasks(docs)
    name = "folio_" + path.rsplit("/", 1)[-1].replace("-", "_")
    tokens.page_bitmaps(bridge.tokens(bridge.by_volume(docs, buckets))).write.bucketBy(buckets, "htid").option("path", path).saveAsTable(name)
    return tokens.bitmap_page_freqs(s.table(name), section="group", case=False, pos=False)


query("tokenlist_cube", """SELECT page, section, token, pos, CAST(grouping_id(page, section, token, pos) AS BIGINT) AS grouping_id, CAST(sum(count) AS BIGINT) AS count
  FROM t GROUP BY CUBE (page, section, token, pos)""", _TOKENS)(lambda s, d: tokens.tokenlist_cube(_tokens(s, d)))  # fmt: skip

query("term_page_freqs_long", "SELECT DISTINCT htid, page, token AS term, CAST(1 AS BIGINT) AS count FROM t WHERE section = 'body'", _TOKENS)(lambda s, d: tokens.term_page_freqs(_tokens(s, d)))
query("term_page_counts_nocase", "SELECT htid, page, lower(token) AS term, CAST(sum(count) AS BIGINT) AS count FROM t WHERE section = 'body' GROUP BY ALL", _TOKENS)(lambda s, d: tokens.term_page_freqs(_tokens(s, d), page_freq=False, case=False))
_TERMS = ["the", "la", "der", "que"]


@query("term_page_matrix", "SELECT htid, page, " + ", ".join(f"CAST(sum(CASE WHEN token = '{x}' THEN count ELSE 0 END) AS BIGINT) AS {x}" for x in _TERMS) + " FROM t WHERE section = 'body' GROUP BY ALL", _TOKENS)
def _matrix(s: SparkSession, d: str) -> DataFrame:
    return tokens.term_page_matrix(_tokens(s, d), _TERMS, page_freq=False)


query("term_volume_freqs", _sum("htid, token, pos", value="count(DISTINCT page)"), _TOKENS)(lambda s, d: tokens.term_volume_freqs(_tokens(s, d)))
query("term_volume_counts", _sum("htid, token, pos"), _TOKENS)(lambda s, d: tokens.term_volume_freqs(_tokens(s, d), page_freq=False))
query("tokens_distinct", "SELECT DISTINCT htid, token FROM t WHERE section = 'body'", _TOKENS)(lambda s, d: tokens.distinct_tokens(_tokens(s, d)))
query("tokens_min_count", "SELECT htid, lower(token) AS lowercase FROM t WHERE section = 'body' GROUP BY ALL HAVING sum(count) >= 4", _TOKENS)(lambda s, d: tokens.distinct_tokens(_tokens(s, d), case=False, min_count=4))
query("tokens_per_page_fallback", "SELECT htid, page, CAST(sum(count) AS BIGINT) AS count FROM t WHERE section = 'body' GROUP BY ALL", _TOKENS)(lambda s, d: tokens.tokens_per_page(_tokens(s, d)))
query("top_tokens", "SELECT token, CAST(sum(count) AS BIGINT) AS count FROM t WHERE section = 'body' GROUP BY token ORDER BY 2 DESC, 1 LIMIT 20", _TOKENS)(lambda s, d: analysis.top(_tokens(s, d).where("section = 'body'").groupBy("token").agg(F.sum("count").alias("count")), "count", 20, "token"))


@query("fold_pages", "SELECT htid, section, token, pos, CAST(sum(count) AS BIGINT) AS count, 'opening' AS chunk FROM t WHERE section = 'body' AND page IN (1, 3) GROUP BY htid, section, token, pos", _TOKENS)
def _fold_pages(s: SparkSession, d: str) -> DataFrame:
    t = _tokens(s, d)
    return tokens.fold_pages([tokens.tokenlist(t, page_select=1), tokens.tokenlist(t, page_select=3)], "opening")


def _sections(s: SparkSession, d: str) -> DataFrame:
    return bridge.section_features(bridge.read(s, d))


_STATS = "tokenCount, lineCount, emptyLineCount, capAlphaSeq, sentenceCount"
query("section_features_all", f"SELECT htid, page, section, {_STATS} FROM s", _SECTIONS)(lambda s, d: features.section_features(_sections(s, d), section="all"))
query("section_features_body", f"SELECT htid, page, {_STATS} FROM s WHERE section = 'body'", _SECTIONS)(lambda s, d: features.section_features(_sections(s, d)))
query("section_features_group", "SELECT htid, page, " + ", ".join(f"CAST(coalesce(sum({x}), 0) AS BIGINT) AS {x}" for x in _STATS.split(", ")) + " FROM s GROUP BY ALL", _SECTIONS)(lambda s, d: features.section_features(_sections(s, d), section="group"))
query("line_counts", "SELECT htid, page, lineCount FROM s WHERE section = 'body'", _SECTIONS)(lambda s, d: features.line_counts(_sections(s, d)))
query("empty_line_counts", "SELECT htid, page, emptyLineCount FROM s WHERE section = 'footer'", _SECTIONS)(lambda s, d: features.empty_line_counts(_sections(s, d), section="footer"))
query("cap_alpha_seqs", "SELECT htid, page, capAlphaSeq FROM s WHERE section = 'body'", _SECTIONS)(lambda s, d: features.cap_alpha_seqs(_sections(s, d)))
query("sentence_counts", "SELECT htid, page, sentenceCount FROM s WHERE section = 'body'", _SECTIONS)(lambda s, d: features.sentence_counts(_sections(s, d)))
query("section_features_page", f"SELECT htid, page, {_STATS} FROM s WHERE section = 'body' AND page = 1", _SECTIONS)(lambda s, d: features.section_features(_sections(s, d), page_select=1))
query("token_freqs", "SELECT htid, page, section, CAST(tokenCount AS BIGINT) AS count FROM s", _SECTIONS)(lambda s, d: features.token_freqs(_sections(s, d)))
query("tokens_per_page", "SELECT htid, page, CAST(tokenCount AS BIGINT) AS count FROM s WHERE section = 'body'", _SECTIONS)(lambda s, d: tokens.tokens_per_page(None, _sections(s, d)))
query("page_features", "SELECT DISTINCT htid, page, CAST(NULL AS VARCHAR) AS languages, lang AS \"calculatedLanguage\", '1' AS version FROM ln JOIN d ON htid = 'doc.' || doc_id", _LINES)(lambda s, d: features.page_features(bridge.page_features(bridge.read(s, d))))
query("page_list", "SELECT DISTINCT htid, page FROM ln", _LINES)(lambda s, d: bridge.page_list(bridge.read(s, d)))
query("volumes", "SELECT 'doc.' || doc_id AS htid, lang AS language, source AS collection, CAST(ceil(len(ls) / 4) AS INTEGER) AS page_count FROM d", _LINES)(lambda s, d: bridge.volumes(bridge.read(s, d)))


def _chars(s: SparkSession, d: str) -> DataFrame:
    return bridge.line_chars(bridge.read(s, d))


query("begin_line_chars", "SELECT * FROM c WHERE section = 'body' AND place = 'begin'", _CHARS)(lambda s, d: features.line_chars(_chars(s, d), place="begin"))
query("end_line_chars", "SELECT * FROM c WHERE section = 'body' AND place = 'end'", _CHARS)(lambda s, d: features.line_chars(_chars(s, d), place="end"))
query("line_chars_all", "SELECT * FROM c", _CHARS)(lambda s, d: features.line_chars(_chars(s, d), section="all"))
query("line_chars_grouped", "SELECT htid, page, char, CAST(sum(count) AS BIGINT) AS count FROM c GROUP BY ALL", _CHARS)(lambda s, d: features.line_chars(_chars(s, d), section="group", place="group"))
query("lines_ending_with_mark", "SELECT htid, page, section, place, char, count FROM c WHERE section = 'body' AND place = 'end' AND char = '!'", _CHARS)(lambda s, d: features.line_chars(_chars(s, d), place="end").where(F.col("char") == "!"))


@query("line_chars_tenths", """SELECT c.htid, place, char, CAST(least(10, (page - 1) // (n // 10) + 1) AS INTEGER) AS band, CAST(sum(count) AS BIGINT) AS count
  FROM c JOIN (SELECT 'doc.' || doc_id AS htid, CAST(ceil(len(ls) / 4) AS INTEGER) AS n FROM d) v ON c.htid = v.htid WHERE n >= 10 GROUP BY ALL""", _CHARS)  # fmt: skip
def _tenths(s: SparkSession, d: str) -> DataFrame:
    return analysis.line_chars_tenths(_chars(s, d), bridge.volumes(bridge.read(s, d)))


def _totals(s: SparkSession, d: str) -> DataFrame:
    return tokens.tokens_per_page(_tokens(s, d)).withColumnRenamed("count", "total")


_TOTALS = _TOKENS + ", p AS (SELECT htid, page, CAST(sum(count) AS BIGINT) AS total FROM t WHERE section = 'body' GROUP BY ALL)"
_TARGET = 200


@query("chunk_modulo", f"""SELECT htid, page, CAST(floor(run / (floor(whole / greatest(1, round_even(whole / {_TARGET}.0, 0))) + 1)) AS INTEGER) AS chunk
  FROM (SELECT htid, page, sum(total) OVER (PARTITION BY htid ORDER BY page) AS run, sum(total) OVER (PARTITION BY htid) AS whole FROM p)""", _TOTALS)  # fmt: skip
def _modulo(s: SparkSession, d: str) -> DataFrame:
    return chunking.modulo_chunks(_totals(s, d), _TARGET)


def _chunk_sql(strategy: str) -> str:
    """Tables that end in ``lab`` (htid, page, chunk): the cuts by a recursion over rounds, every page tried in each."""
    two, shared = strategy != "last", {"last": "0", "even": "sur / greatest(2, round_even(whole / {t}, 0))", "ends": "sur / CASE WHEN turn = 0 THEN 2 ELSE greatest(2, round_even(whole / {t}, 0)) END"}[strategy].format(t=f"{_TARGET}.0")
    return _TOTALS + f""",
z AS (SELECT htid, page, total, row_number() OVER w - 1 AS i, sum(total) OVER w - total AS before FROM p WINDOW w AS (PARTITION BY htid ORDER BY page)),
v AS (SELECT htid, count(*) AS n, sum(total) AS whole FROM p GROUP BY htid),
cum AS (SELECT htid, i, CAST(before AS DOUBLE) AS t FROM z UNION ALL SELECT htid, n, CAST(whole AS DOUBLE) FROM v),
s AS (SELECT htid, n, 0 AS turn, CAST(0 AS BIGINT) AS low, n AS high, CAST(0 AS BIGINT) AS c1, CAST(NULL AS BIGINT) AS c2 FROM v
  UNION ALL
  SELECT htid, n, turn + 1, CASE WHEN halves THEN high ELSE f END, CASE WHEN halves OR f = n THEN CASE WHEN halves THEN high ELSE f END ELSE greatest(b, f) END, CASE WHEN halves THEN h ELSE f END, CASE WHEN NOT halves AND f < n AND {two} THEN b END
  FROM (SELECT htid, n, turn, low, high, halves, h.k AS h, f.k AS f, CASE WHEN {two} THEN -b.k ELSE high END AS b FROM (
    SELECT htid, n, turn, low, high, halves, min(CASE WHEN i > low THEN {{'d': abs(t - t0 - whole / 2), 'k': i}} END) AS h, min(CASE WHEN i > low THEN {{'d': abs(t - t0 - goal), 'k': i}} END) AS f,
      min(CASE WHEN i < high THEN {{'d': abs(t1 - t - goal), 'k': -i}} END) AS b
    FROM (SELECT *, {_TARGET} + {shared} AS goal, {two} AND whole < 2.5 * {_TARGET} AS halves FROM (SELECT *, CASE WHEN ov > {_TARGET} - ov THEN ov - {_TARGET} ELSE ov END AS sur FROM
      (SELECT s.*, a.i, a.t, lo.t AS t0, hi.t AS t1, hi.t - lo.t AS whole, (hi.t - lo.t) % {_TARGET} AS ov FROM s JOIN cum lo ON s.htid = lo.htid AND lo.i = low JOIN cum hi ON s.htid = hi.htid AND hi.i = high JOIN cum a ON s.htid = a.htid AND a.i BETWEEN low AND high
       WHERE low < high AND hi.t - lo.t >= 1.5 * {_TARGET}))) GROUP BY htid, n, turn, low, high, halves))),
m AS (SELECT DISTINCT htid, unnest([c1, c2]) AS i FROM s),
lab AS (SELECT htid, page, CAST(sum(CASE WHEN m.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY htid ORDER BY page) AS INTEGER) AS chunk FROM z LEFT JOIN m USING (htid, i))"""


def _recursive(name: str, sql: str, strategy: str) -> Callable[[Query], Query]:
    return query(name, f"WITH RECURSIVE {_chunk_sql(strategy).strip()} {sql}")


for _name in chunking.STRATEGIES:
    _recursive(f"chunk_{_name}", "SELECT htid, page, chunk FROM lab", _name)(lambda s, d, n=_name: chunking.page_labels(_totals(s, d), _TARGET, n))
_recursive("chunk_tokenlist_page_ref", """SELECT htid, chunk, pstart, pend, section, token, pos, CAST(sum(count) AS BIGINT) AS count
  FROM t JOIN (SELECT *, min(page) OVER w AS pstart, max(page) OVER w AS pend FROM lab WINDOW w AS (PARTITION BY htid, chunk)) USING (htid, page) WHERE section = 'body' GROUP BY ALL""", "ends")(
    lambda s, d: tokens.tokenlist(_tokens(s, d), chunk=True, chunk_target=_TARGET, page_ref=True)
)


def _older_sql(strategy: str) -> str:
    """``lab`` of the older scheme: one cut a round, every page behind the last one tried."""
    even, first = strategy == "even", "goal0 + sur / 2" if strategy == "ends" else "goal0"
    return _TOTALS + f""",
z AS (SELECT htid, page, total, row_number() OVER w - 1 AS i, sum(total) OVER w - total AS before FROM p WINDOW w AS (PARTITION BY htid ORDER BY page)),
v AS (SELECT htid, n, whole, sur, CASE WHEN whole < {_TARGET} THEN 1 ELSE CAST(floor(whole / {_TARGET}) AS BIGINT) + CASE WHEN sur < 0 THEN 1 ELSE 0 END END AS planned
  FROM (SELECT *, CASE WHEN ov > {_TARGET} - ov THEN ov - {_TARGET} ELSE ov END AS sur FROM (SELECT htid, count(*) AS n, CAST(sum(total) AS DOUBLE) AS whole, CAST(sum(total) AS DOUBLE) % {_TARGET} AS ov FROM p GROUP BY htid))),
cum AS (SELECT htid, i, CAST(before AS DOUBLE) AS t FROM z UNION ALL SELECT htid, n, whole FROM v),
s AS (SELECT htid, n, whole, planned, CAST(1 AS BIGINT) AS made, goal0 AS target, {first} AS goal, CAST(0 AS BIGINT) AS cut, CAST(0 AS DOUBLE) AS t0 FROM (SELECT *, CAST({_TARGET} AS DOUBLE) + {"sur / planned" if even else "0"} AS goal0 FROM v)
  UNION ALL
  SELECT htid, n, whole, plan, made + 1, target, target + greatest(-0.1::DOUBLE * target, least(0.1::DOUBLE * target, off * {"1" if even else "((1 + rest::DOUBLE / plan) / 2)"})), cut, t
  FROM (SELECT *, planned + CASE WHEN abs(off) > 0.4::DOUBLE * target THEN sign(off)::BIGINT ELSE 0 END AS plan FROM (SELECT *, (whole - t) / rest - target AS off FROM (
    SELECT htid, n, whole, planned, made, target, planned - made AS rest, x.k AS cut, x.t AS t FROM (
      SELECT s.htid, n, whole, planned, made, target, min({{'d': abs(a.t - t0 - goal), 'k': a.i, 't': a.t}}) AS x FROM s JOIN cum a ON s.htid = a.htid AND a.i > s.cut WHERE made < planned AND cut < n GROUP BY ALL)))
    WHERE cut < n)),
m AS (SELECT DISTINCT htid, cut AS i FROM s),
lab AS (SELECT htid, page, CAST(sum(CASE WHEN m.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY htid ORDER BY page) AS INTEGER) AS chunk FROM z LEFT JOIN m USING (htid, i))"""


for _name in chunking.STRATEGIES:
    query(f"chunk_older_{_name}", f"WITH RECURSIVE {_older_sql(_name).strip()} SELECT htid, page, chunk FROM lab")(lambda s, d, n=_name: chunking.page_labels(_totals(s, d), _TARGET, n, older=True))


@_recursive("chunk_quality", f"""SELECT round(avg(e), 6) AS mean, round(stddev_samp(e), 6) AS std, min(e) AS min, max(e) AS max, median(e) AS median
  FROM (SELECT CAST(sum(total) - {_TARGET} AS DOUBLE) AS e FROM p JOIN lab USING (htid, page) GROUP BY htid, chunk)""", "ends")  # fmt: skip
def _quality(s: SparkSession, d: str) -> DataFrame:
    t = _totals(s, d)
    chunks = t.join(chunking.page_labels(t, _TARGET), ["htid", "page"]).groupBy("htid", "chunk").agg(F.sum("total").alias("total"))
    return analysis.chunk_quality(chunks, _TARGET)


query("proper_nouns_by_volume", "SELECT htid, token, CAST(sum(count) AS BIGINT) AS count FROM t WHERE section = 'body' AND pos IN ('NNP', 'NNPS') GROUP BY ALL HAVING sum(count) >= 2", _TOKENS)(lambda s, d: analysis.proper_nouns(_tokens(s, d)))
query("proper_noun_doc_freq", "SELECT token, count(*) AS volumes FROM (SELECT htid, token FROM t WHERE section = 'body' AND pos IN ('NNP', 'NNPS') GROUP BY ALL HAVING sum(count) >= 2) GROUP BY token", _TOKENS)(lambda s, d: analysis.document_frequency(analysis.proper_nouns(_tokens(s, d))))


@query("doc_term_whitelist", r"""SELECT htid, token, CAST(sum(count) AS BIGINT) AS count FROM t WHERE section = 'body' AND token IN (SELECT token FROM t WHERE section = 'body' GROUP BY token
  HAVING sum(count) > 400 AND regexp_full_match(token, '\p{L}+') AND regexp_matches(token, '[a-z]') AND length(token) > 2) GROUP BY ALL""", _TOKENS)  # fmt: skip
def _whitelisted(s: SparkSession, d: str) -> DataFrame:
    return analysis.doc_term_whitelist(_tokens(s, d), 400)


@query("doc_term_labelled", r"""SELECT quality, token, CAST(sum(count) AS BIGINT) AS count FROM t JOIN labels l ON htid = 'doc.' || l.doc_id WHERE section = 'body' AND token IN (SELECT token FROM t WHERE section = 'body' GROUP BY token
  HAVING sum(count) > 400 AND regexp_full_match(token, '\p{L}+') AND regexp_matches(token, '[a-z]') AND length(token) > 2) GROUP BY ALL""", _TOKENS)  # fmt: skip
def _labelled(s: SparkSession, d: str) -> DataFrame:
    marks = s.read.parquet(f"{d}/labels.parquet").select(F.concat(F.lit("doc."), F.col("doc_id")).alias("htid"), "quality")
    return analysis.doc_term_whitelist(_tokens(s, d), 400).join(marks, "htid").groupBy("quality", "token").agg(F.sum("count").alias("count"))


query("long_pages", "SELECT htid, page, total FROM (SELECT *, avg(total) OVER (PARTITION BY htid) AS mean FROM p) WHERE total > 0.8 * mean", _TOTALS)(lambda s, d: analysis.long_pages(_totals(s, d)))
#: Words and valences for the sentiment queries.
_LEXICON = [("the", 1), ("la", 2), ("der", -1), ("que", -2), ("is", 1)]
_VALENCES = ", ".join(f"('{w}', {v})" for w, v in _LEXICON)
_SENTIMENT = f"SELECT htid, page, CAST(sum(count * valence) AS BIGINT) AS sentiment FROM t JOIN (VALUES {_VALENCES}) x(word, valence) ON lower(token) = word WHERE section = 'body' GROUP BY ALL"


def _sentiment(s: SparkSession, d: str) -> DataFrame:
    return analysis.page_sentiment(_tokens(s, d), s.createDataFrame(_LEXICON, "token string, valence int"))


query("page_sentiment", _SENTIMENT, _TOKENS)(_sentiment)
query("sentiment_moving_avg", f"""SELECT htid, page, sentiment, CAST(row_number() OVER w AS INTEGER) AS seq, round(avg(sentiment) OVER (PARTITION BY htid ORDER BY page ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS average
  FROM ({_SENTIMENT}) WINDOW w AS (PARTITION BY htid ORDER BY page)""", _TOKENS)(lambda s, d: analysis.moving_average(_sentiment(s, d), "sentiment").withColumn("average", F.round("average", 6)))  # fmt: skip
query("sentiment_lowess", f"""SELECT htid, page, round(my + CASE WHEN var > 1e-12 THEN cov / var ELSE 0 END * (page - mx), 6) AS smooth FROM (
  SELECT htid, page, mx, my, sum(w * (x - mx) * (x - mx)) / sum(w) AS var, sum(w * (x - mx) * (y - my)) / sum(w) AS cov FROM (
    SELECT *, sum(w * x) OVER g / sum(w) OVER g AS mx, sum(w * y) OVER g / sum(w) OVER g AS my FROM (
      SELECT htid, page, x, y, power(greatest(0, 1 - power(d / greatest(ds[CAST(least(n, greatest(2, ceil(CAST(0.3 AS DOUBLE) * n))) AS INTEGER)], 1e-9), 3)), 3) AS w FROM (
        SELECT *, list(d ORDER BY d) OVER (PARTITION BY htid, page) AS ds, count(*) OVER (PARTITION BY htid, page) AS n FROM (
          SELECT a.htid, a.page, CAST(b.page AS DOUBLE) AS x, CAST(b.sentiment AS DOUBLE) AS y, CAST(abs(a.page - b.page) AS DOUBLE) AS d FROM ({_SENTIMENT}) a JOIN ({_SENTIMENT}) b ON a.htid = b.htid)))
    WINDOW g AS (PARTITION BY htid, page)) GROUP BY ALL)""", _TOKENS)(
    lambda s, d: analysis.lowess(_sentiment(s, d).withColumn("sentiment", F.col("sentiment").cast("double")), "sentiment").withColumn("smooth", F.round("smooth", 6))
)
_DIM = 64
#: Bytes of text in a cell of documents that the vectors of its words are sent to.
_CELL_TEXT = 24 << 20


def _ranked(df: DataFrame, name: str, *order) -> DataFrame:
    """``df`` with ``r``, the place from 1 in the order, which must have no ties; rows are numbered in the range partitions of a sort."""
    path = scratch(df.sparkSession, name)
    df.orderBy(*order).withColumn("part", F.spark_partition_id()).write.parquet(path)
    placed = df.sparkSession.read.parquet(path)
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row a partition
    offsets = placed.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return placed.withColumn("place", place).join(offsets, "part").withColumn("r", F.col("before") + F.col("place")).drop("part", "place", "before")


@query("doc_vectors", f"""SELECT htid, dim, round(CASE WHEN n > 10 THEN value END, 6) AS value FROM (SELECT htid, CAST(dim AS INTEGER) AS dim FROM (SELECT DISTINCT htid FROM t WHERE section = 'body'), range({_DIM}) g(dim)) LEFT JOIN (
  SELECT htid, CAST(i AS INTEGER) AS dim, count(*) AS n, sum(ln(1 + count) * CAST(embedding[i + 1] AS DOUBLE)) AS value FROM
  (SELECT htid, token, sum(count) AS count FROM t WHERE section = 'body' GROUP BY ALL) JOIN (SELECT token, row_number() OVER (ORDER BY sum(count) DESC, token) AS r FROM t WHERE section = 'body' GROUP BY token) USING (token)
  JOIN (SELECT embedding, row_number() OVER (ORDER BY vec_id) AS r FROM embeddings) USING (r), range({_DIM}) x(i) GROUP BY htid, i) USING (htid, dim)""", _TOKENS)  # fmt: skip
def _vectors(s: SparkSession, d: str) -> DataFrame:
    """Every vector goes to the word of its rank; all dimensions, one a row. The words are stored as they lie, a bucket a cell."""
    docs, path = _texts(s, d), scratch(s, "body")  # read three times
    cells = max(3 * s.sparkContext.defaultParallelism, bridge.volume_tasks(docs, _CELL_TEXT))  # cells lie unevenly in as many tasks
    name = "folio_" + path.rsplit("/", 1)[-1].replace("-", "_")
    lines = bridge.lines(bridge.by_cell(docs, cells), "cell").where("section = 'body'")
    counted = lines.select("cell", "htid", F.explode(F.regexp_extract_all("line", F.lit(bridge.TOKEN), F.lit(0))).alias("token")).groupBy("cell", "htid", "token").agg(F.count("*").alias("count"))
    counted.write.bucketBy(cells, "cell").option("path", path).saveAsTable(name)
    body = s.table(name)
    words = _ranked(body.groupBy("token").agg(F.sum("count").alias("count")), "words", F.desc("count"), F.asc("token"))
    vecs = _ranked(s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").alias("vec")), "vectors", F.asc("vec_id"))
    found = vectors.document_vectors(body, words.join(vecs, "r").select("token", "vec"), _DIM, cell=("cell", cells))
    return found.select("htid", F.posexplode("vec").alias("dim", "value")).withColumn("value", F.round("value", 6))


def _ids(s: SparkSession, d: str) -> DataFrame:
    docs = bridge.read(s, d)
    return docs.select(F.concat(F.col("lang"), F.lit(".ark:/13960/t"), F.col("doc_id"), F.lit("."), F.col("source")).alias("htid"))


_HTIDS = """i AS (SELECT lang || '.ark:/13960/t' || doc_id || '.' || source AS htid FROM documents),
e AS (SELECT htid, split_part(htid, '.', 1) AS lib, translate(substring(htid, length(split_part(htid, '.', 1)) + 2), ':/.', '+=,') AS enc FROM i)"""
query("id_encode", "SELECT htid, translate(htid, ':/.', '+=,') AS encoded, translate(translate(htid, ':/.', '+=,'), '+=,', ':/.') AS decoded, lib || '.' || enc AS clean FROM e", _HTIDS)(
    lambda s, d: _ids(s, d).select("htid", ids.encode_id("htid").alias("encoded"), ids.decode_id(ids.encode_id("htid")).alias("decoded"), ids.clean_htid("htid").alias("clean"))
)
query("id_paths", r"""SELECT htid, lib || '/' || regexp_replace(enc, '(.).{0,2}', '\1', 'g') || '/' || lib || '.' || enc || '.json.bz2' AS stubby,
  lib || '/pairtree_root/' || rtrim(regexp_replace(enc, '(.{1,2})', '\1/', 'g'), '/') || '/' || enc || '/' || lib || '.' || enc || '.tokens.parquet' AS pair FROM e""", _HTIDS)(
    lambda s, d: _ids(s, d).select("htid", ids.stubbytree_path("htid").alias("stubby"), ids.pairtree_path("htid", "parquet", "snappy", "tokens").alias("pair"))
)
query("zip_bucket", "SELECT htid, substring(sha1(htid), 1, 3) AS bucket FROM e", _HTIDS)(lambda s, d: _ids(s, d).select("htid", ids.zip_bucket("htid").alias("bucket")))
query("extract_htid", "SELECT htid, translate(lib || '.' || enc, '+=,', ':/.') AS found FROM e", _HTIDS)(lambda s, d: _ids(s, d).select("htid", ids.extract_htid(ids.file_name("htid", "json", "bz2", "meta")).alias("found")))
query("transfer_list", r"SELECT htid, lib || '/' || regexp_replace(enc, '(.).{0,2}', '\1', 'g') || '/' || lib || '.' || enc || '.json.bz2' AS path FROM e", _HTIDS)(lambda s, d: stores.transfer_list(_ids(s, d)))


@query("ids_available", "SELECT 'doc.' || doc_id AS htid, doc_id IN (SELECT doc_id FROM labels) AS exists FROM documents")
def _available(s: SparkSession, d: str) -> DataFrame:
    def of(table: str) -> DataFrame:
        return s.read.parquet(f"{d}/{table}.parquet").select(F.concat(F.lit("doc."), F.col("doc_id")).alias("htid"))

    return stores.available(of("documents"), of("labels"))


@query("cache_fallback", "SELECT 'doc.' || doc_id AS htid, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'cache' ELSE 'store' END AS value FROM documents")
def _fallback(s: SparkSession, d: str) -> DataFrame:
    def of(table: str) -> DataFrame:
        return s.read.parquet(f"{d}/{table}.parquet").select(F.concat(F.lit("doc."), F.col("doc_id")).alias("htid"))

    return stores.with_fallback(of("documents"), of("labels").withColumn("value", F.lit("cache")), lambda missing: missing.withColumn("value", F.lit("store")))


def _volumes(s: SparkSession, d: str) -> DataFrame:
    return bridge.to_json_volumes(bridge.by_volume(s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang")))


def _nested(s: SparkSession, d: str) -> DataFrame:
    """The nested texts, written one a line and scanned back."""
    path = scratch(s, "volumes")
    _volumes(s, d).select("value").write.option("compression", "gzip").text(path)
    return volumes.read_lines(s, path)


query("json_roundtrip_tokens", "SELECT * FROM t", _TOKENS)(lambda s, d: volumes.tokens(_nested(s, d)))
query("json_roundtrip_chars", "SELECT * FROM c", _CHARS)(lambda s, d: volumes.line_chars(_nested(s, d)))
query("json_roundtrip_sections", f"SELECT htid, page, section, {_STATS} FROM s", _SECTIONS)(lambda s, d: volumes.section_features(_nested(s, d)))
query("json_roundtrip_pages", "SELECT DISTINCT htid, page FROM ln", _LINES)(lambda s, d: volumes.page_list(_nested(s, d)))


@query("term_matrix_sparse", """SELECT htid, page, CAST(count(*) AS BIGINT) AS terms, string_agg(token || ' ' || n, ',' ORDER BY token) AS uses
  FROM (SELECT htid, page, token, CAST(sum(count) AS BIGINT) AS n FROM t WHERE section = 'body' GROUP BY ALL) GROUP BY htid, page""", _TOKENS)  # fmt: skip
def _sparse(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "terms")
    tokens.term_page_freqs(_tokens(s, d), page_freq=False).write.parquet(path)
    long = s.read.parquet(path)
    words = tokens.vocabulary(long, "term")
    rows = tokens.sparse_rows(long, words, ("htid", "page"), "term")
    each = rows.select("htid", "page", F.explode(F.arrays_zip("indices", "values")).alias("x")).select("htid", "page", F.col("x.indices").alias("index"), F.col("x.values").alias("n"))
    back = each.join(words, "index").groupBy("htid", "page").agg(F.count("*").alias("terms"), F.array_sort(F.collect_list(F.struct("term", "n"))).alias("u"))
    return back.select("htid", "page", "terms", F.array_join(F.transform("u", lambda u: F.concat_ws(" ", u["term"], u["n"])), ",").alias("uses"))


@query("tables_in_one_pass", "SELECT kind, htid, page, n FROM (SELECT 'tokens' AS kind, htid, page, CAST(sum(count) AS BIGINT) AS n FROM t GROUP BY ALL UNION ALL SELECT 'section', htid, page, count(*) FROM (SELECT DISTINCT htid, page, section FROM ln) GROUP BY ALL UNION ALL SELECT 'pages', htid, page, 1 FROM (SELECT DISTINCT htid, page FROM ln) UNION ALL SELECT 'chars', htid, page, 2 * count(*) FROM ln WHERE trim(line, ' ') <> '' GROUP BY ALL)", _TOKENS)
def _one_pass(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "kinds")
    stores.write_in_one_pass(_nested(s, d), path)
    made = [(kind, stores.read_table(s, path, kind)) for kind in ("tokens", "section", "pages", "chars")]
    counted = [df.groupBy("htid", "page").agg((F.sum("count") if "count" in df.columns else F.count("*")).alias("n")).select(F.lit(kind).alias("kind"), "htid", "page", "n") for kind, df in made]
    return reduce(DataFrame.unionByName, counted)


@query("volumes_metadata", r"""WITH v AS (SELECT doc_id AS i, 'doc.' || doc_id AS htid, lang, coalesce(source, '') AS source, doc_id % 3 = 2 AS linked FROM documents WHERE doc_id IS NOT NULL)
  SELECT htid, htid AS id, htid AS title, lang AS language, CAST(1800 + i % 200 AS VARCHAR) AS year, CASE WHEN linked THEN 'linked' WHEN i % 3 = 0 THEN '2.0' ELSE '3.0' END AS feature_schema_version, CAST(i % 9 AS INTEGER) AS page_count,
  CASE WHEN NOT linked THEN 'N |' || source WHEN i % 5 = 0 THEN source || ', A. ' WHEN i % 5 = 1 THEN source || '|B ' || chr(233) WHEN i % 5 = 2 THEN source ELSE '' END AS author,
  CASE WHEN NOT linked THEN '' WHEN i % 2 = 0 THEN 'fiction|x' ELSE 'biography' END AS genre, CASE WHEN linked THEN 'bare' ELSE 'xx' END AS pub_place,
  CASE WHEN linked THEN source END AS publisher, CASE WHEN NOT linked THEN source END AS source_institution, NOT linked AND coalesce(lang IN ('jpn', 'chi'), false) AS tokenization_warning FROM v""")
def _metadata(s: SparkSession, d: str) -> DataFrame:
    rows = metadata.volumes(bridge.to_metadata_volumes(bridge.read(s, d)))
    joined = [F.array_join(c, "|").alias(c) for c in ("author", "genre")]
    return rows.select("htid", "id", "title", "language", "year", "feature_schema_version", "page_count", *joined, "pub_place", "publisher", "source_institution", "tokenization_warning")


@query("volume_lines", r"""WITH v AS (SELECT doc_id AS i, 'doc.' || doc_id AS htid, coalesce(source, '') AS source, doc_id % 3 = 2 AS linked FROM documents WHERE doc_id IS NOT NULL)
  SELECT htid, '<Volume: ' || htid || ' (' || (1800 + i % 200) || CASE WHEN linked AND i % 5 > 2 THEN ') without a listed author>' ELSE ') by ' || CASE WHEN NOT linked THEN 'N' WHEN i % 5 = 0 THEN trim(source || ', A. ') ELSE source END || '>' END AS line FROM v""")
def _lines(s: SparkSession, d: str) -> DataFrame:
    return metadata.printed(metadata.volumes(bridge.to_metadata_volumes(bridge.read(s, d)))).select("htid", "line")


@query("sentiment_lowess_robust", None)
def _robust(s: SparkSession, d: str) -> DataFrame:
    rows = analysis.moving_average(_sentiment(s, d).withColumn("sentiment", F.col("sentiment").cast("double")), "sentiment")
    return analysis.lowess(rows, "sentiment", passes=3, by="seq").withColumn("smooth", F.round("smooth", 6))


@query("parquet_roundtrip", _sum("htid, page, lowercase", "true"), _TOKENS)
def _parquet(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "tables")
    stores.write_tables({"tokens": tokens.tokenlist(_tokens(s, d), section="group", case=False, pos=False)}, path)
    return tokens.tokenlist(stores.read_table(s, path, "tokens"), case=False, pos=False)


@query("zip_roundtrip", "SELECT 'doc.' || doc_id AS htid, sha256(coalesce(text, '')) AS sha FROM documents")
def _zips(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "zips")
    docs = bridge.read(s, d).select(F.concat(F.lit("doc."), F.col("doc_id")).alias("htid"), F.coalesce("text", F.lit("")).alias("value"))
    stores.write_volumes(docs, path, "ziptree").write.format("noop").mode("overwrite").save()
    return stores.read_zips(s, path).select("htid", F.sha2("value", 256).alias("sha"))


@query("archive_tokens_selected", "SELECT * FROM t WHERE section = 'body' AND page IN (1, 3)", _TOKENS)
def _selected(s: SparkSession, d: str) -> DataFrame:
    """Token rows of two pages from archives: page and section are chosen where the texts are read."""
    path = scratch(s, "archives")
    stores.write_volumes(_volumes(s, d), path, "ziptree").write.format("noop").mode("overwrite").save()
    return archives.read_archives(s, path, "tokens").where("section = 'body' and page in (1, 3)")


@query("conversation_tokens", r"""SELECT 'conv.' || conv_id AS htid, CAST(turn + 1 AS INTEGER) AS page, CASE role WHEN 'system' THEN 'header' WHEN 'assistant' THEN 'footer' ELSE 'body' END AS section, token, count(*) AS count
  FROM (SELECT *, unnest(regexp_extract_all(text, '[\p{L}]+|[0-9]+|[^\s\p{L}0-9]')) AS token FROM conversations) GROUP BY ALL""")  # fmt: skip
def _conversations(s: SparkSession, d: str) -> DataFrame:
    rows = s.read.parquet(f"{d}/conversations.parquet")
    section = F.when(F.col("role") == "system", "header").when(F.col("role") == "assistant", "footer").otherwise("body")
    words = F.explode(F.regexp_extract_all("text", F.lit(bridge.TOKEN), F.lit(0))).alias("token")
    return rows.select(F.concat(F.lit("conv."), F.col("conv_id")).alias("htid"), (F.col("turn") + 1).cast("int").alias("page"), section.alias("section"), words).groupBy("htid", "page", "section", "token").agg(F.count("*").alias("count"))
