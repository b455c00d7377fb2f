"""Canonical tables from plain document tables: pages of four lines, sections by place, tokens by a pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINES_A_PAGE = 4
TOKEN = r"[\p{L}]+|[0-9]+|[^\s\p{L}0-9]"


#: Bytes of text that a task takes where documents are dealt out by volume: its words and their sums fit into memory.
TEXT_A_TASK = 8 << 20


def _htid(docs: DataFrame) -> Column:
    return F.col("htid") if "htid" in docs.columns else F.concat(F.lit("doc."), F.col("doc_id"))


def volume_tasks(docs: DataFrame, each: int = TEXT_A_TASK) -> int:
    """How many tasks the texts of ``docs`` are for, of at most about ``each`` bytes."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // each))


def by_volume(docs: DataFrame, tasks: int | None = None) -> DataFrame:
    """``docs`` with ``htid``, dealt out by it: every fold with the volume among its keys then stays within its task, so texts are shuffled and words are not."""
    return docs.withColumn("htid", _htid(docs)).repartition(tasks or volume_tasks(docs), "htid")


def by_cell(docs: DataFrame, cells: int) -> DataFrame:
    """``docs`` with ``htid`` and ``cell``, one of so many that follows from it, dealt out by cell."""
    named = docs.withColumn("htid", _htid(docs))
    return named.withColumn("cell", F.pmod(F.xxhash64("htid"), F.lit(cells))).repartition(cells, "cell")


def lines(docs: DataFrame, *own: str) -> DataFrame:
    """htid, ``own``, page, section, line of ``docs`` (doc_id, text); null text counts as empty."""
    rows = docs.select(_htid(docs).alias("htid"), *own, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "line"))
    place = F.col("i") % LINES_A_PAGE
    section = F.when(place == 0, "header").when(place == LINES_A_PAGE - 1, "footer").otherwise("body")
    return rows.select("htid", *own, (F.floor(F.col("i") / LINES_A_PAGE) + 1).cast("int").alias("page"), section.alias("section"), "line")


def _pos(token: Column) -> Column:
    return F.when(token.rlike(r"^[0-9]"), "CD").when(token.rlike(r"^\p{Lu}"), "NNP").when(token.rlike(r"^\p{L}"), "NN").otherwise("SYM")


def tokens(docs: DataFrame) -> DataFrame:
    """htid, page, section, token, pos, count."""
    words = lines(docs).select("htid", "page", "section", F.explode(F.regexp_extract_all("line", F.lit(TOKEN), F.lit(0))).alias("token"))
    return words.withColumn("pos", _pos(F.col("token"))).groupBy("htid", "page", "section", "token", "pos").agg(F.count("*").alias("count"))


def line_chars(docs: DataFrame) -> DataFrame:
    """htid, page, section, place, char, count: first and last characters of lines that aren't blank."""
    trimmed = lines(docs).withColumn("line", F.trim("line")).where("line <> ''")
    ends = F.explode(F.array(F.struct(F.lit("begin").alias("place"), F.substring("line", 1, 1).alias("char")), F.struct(F.lit("end").alias("place"), F.substring("line", -1, 1).alias("char")))).alias("e")
    return trimmed.select("htid", "page", "section", ends).groupBy("htid", "page", "section", "e.place", "e.char").agg(F.count("*").alias("count"))


def section_features(docs: DataFrame) -> DataFrame:
    """htid, page, section and the five counts; sentenceCount is null where a section has no text."""
    blank = F.trim("line") == ""
    return lines(docs).groupBy("htid", "page", "section").agg(
        F.sum(F.regexp_count("line", F.lit(TOKEN))).cast("int").alias("tokenCount"), F.count("*").cast("int").alias("lineCount"), F.sum(blank.cast("int")).cast("int").alias("emptyLineCount"),
        F.max(F.length(F.regexp_extract("line", r"^\p{Lu}*", 0))).cast("int").alias("capAlphaSeq"), F.sum(F.when(~blank, F.regexp_count("line", F.lit("[.!?]")))).cast("int").alias("sentenceCount"),
    )


def page_list(docs: DataFrame) -> DataFrame:
    """htid, page: all pages, also those without tokens."""
    n = F.size(F.split(F.coalesce("text", F.lit("")), "\n"))
    return docs.select(F.concat(F.lit("doc."), F.col("doc_id")).alias("htid"), F.explode(F.sequence(F.lit(1), F.ceil(n / LINES_A_PAGE).cast("int"))).alias("page"))


def page_features(docs: DataFrame) -> DataFrame:
    """htid, page, languages, calculatedLanguage, version."""
    n = F.size(F.split(F.coalesce("text", F.lit("")), "\n"))
    return docs.select(
        F.concat(F.lit("doc."), F.col("doc_id")).alias("htid"), F.explode(F.sequence(F.lit(1), F.ceil(n / LINES_A_PAGE).cast("int"))).alias("page"),
        F.lit(None).cast("string").alias("languages"), F.col("lang").alias("calculatedLanguage"), F.lit("1").alias("version"),
    )


def volumes(docs: DataFrame) -> DataFrame:
    """htid, language, collection, page_count."""
    n = F.ceil(F.size(F.split(F.coalesce("text", F.lit("")), "\n")) / LINES_A_PAGE).cast("int")
    return docs.select(F.concat(F.lit("doc."), F.col("doc_id")).alias("htid"), F.col("lang").alias("language"), F.col("source").alias("collection"), n.alias("page_count"))


def _page_lines(docs: DataFrame, *own: Column) -> DataFrame:
    """htid, ``own``, page, ls: one row a page with its lines, made within each document's row."""
    split = docs.select(_htid(docs).alias("htid"), *own, F.explode(F.array(F.split(F.coalesce("text", F.lit("")), "\n"))).alias("ls"))
    starts = F.sequence(F.lit(0), F.ceil(F.size("ls") / LINES_A_PAGE).cast("int") - 1)
    others = [c for c in split.columns if c != "ls"]
    pages = split.select(*others, F.posexplode(F.transform(starts, lambda p: F.slice("ls", p * LINES_A_PAGE + 1, LINES_A_PAGE))).alias("p", "ls"))
    return pages.select(*others, (F.col("p") + 1).alias("page"), "ls")


def _counted(chars: Column) -> Column:
    """A map from each of a few characters to how often it is there."""
    return F.map_from_entries(F.transform(F.array_distinct(chars), lambda c: F.struct(c, F.size(F.filter(chars, lambda d: d == c)))))


def _run_starts(words: Column) -> Column:
    """Where runs of equal words start in a sorted array."""
    place = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1)))
    return F.when(F.size(words) > 0, place).otherwise(F.array().cast("array<int>"))


def to_json_volumes(docs: DataFrame) -> DataFrame:
    """htid, value: one nested JSON text per volume, as the scan reads them (schema version 3.0).

    Words are sorted and counted within each page's row, and a volume's pages meet once: of documents dealt out by
    :func:`by_volume` nothing but their texts is shuffled. Each array is made in a row of its own (``explode`` of one
    element), so that no lambda makes it anew.
    """
    places = {"header": (1, 1), "body": (2, LINES_A_PAGE - 2), "footer": (LINES_A_PAGE, 1)}

    def each(of, name: str) -> Column:
        return F.explode(F.array(F.struct(*[of(s).alias(s) for s in places]))).alias(name)

    rows = _page_lines(docs, F.to_json(F.struct(_htid(docs).alias("title"), F.col("lang").alias("language"))).alias("metadata"))
    rows = rows.select("htid", "metadata", "page", each(lambda s: F.slice("ls", *places[s]), "l"))
    rows = rows.select("*", each(lambda s: F.sort_array(F.flatten(F.transform(F.col(f"l.{s}"), lambda x: F.regexp_extract_all(x, F.lit(TOKEN), F.lit(0))))), "tk"))
    rows = rows.select("*", each(lambda s: _run_starts(F.col(f"tk.{s}")), "at"))

    def section(s: str) -> Column:
        ls, tk, at = F.col(f"l.{s}"), F.col(f"tk.{s}"), F.col(f"at.{s}")
        text = F.filter(F.transform(ls, lambda x: F.trim(x)), lambda x: x != "")
        uses = F.transform(at, lambda a, i: F.struct(F.get(tk, a).alias("token"), F.create_map(_pos(F.get(tk, a)), F.coalesce(F.get(at, i + 1), F.size(tk)) - a)))
        sentences = F.when(F.size(text) > 0, F.aggregate(text, F.lit(0), lambda n, x: n + F.regexp_count(x, F.lit("[.!?]"))))
        body = F.struct(
            F.size(tk).alias("tokenCount"), F.size(ls).alias("lineCount"), (F.size(ls) - F.size(text)).alias("emptyLineCount"),
            F.array_max(F.transform(ls, lambda x: F.length(F.regexp_extract(x, r"^\p{Lu}*", 0)))).alias("capAlphaSeq"), sentences.alias("sentenceCount"), F.map_from_entries(uses).alias("tokenPosCount"),
            _counted(F.transform(text, lambda x: F.substring(x, 1, 1))).alias("beginCharCounts"), _counted(F.transform(text, lambda x: F.substring(x, -1, 1))).alias("endCharCount"),
        )
        return F.when(F.size(ls) > 0, F.to_json(body)).otherwise("null")

    page = F.concat(F.lit('{"seq":"'), F.lpad(F.col("page").cast("string"), 8, "0"), F.lit('"'), *[F.concat(F.lit(f',"{s}":'), section(s)) for s in places], F.lit("}"))
    whole = rows.select("htid", "metadata", F.struct("page", page.alias("j")).alias("p")).groupBy("htid").agg(F.first("metadata").alias("metadata"), F.array_sort(F.collect_list("p")).alias("p"))
    text = F.concat(F.lit('{"id":"'), F.col("htid"), F.lit('","metadata":'), F.col("metadata"), F.lit(',"features":{"schemaVersion":"3.0","pageCount":'), F.size("p").cast("string"), F.lit(',"pages":['), F.array_join(F.transform("p", lambda x: x["j"]), ","), F.lit("]}}"))
    return whole.where(F.col("htid").isNotNull()).select("htid", text.alias("value"))


def to_metadata_volumes(docs: DataFrame) -> DataFrame:
    """htid, value: nested JSON texts without pages, in the kinds that volume files have: two older versions and the linked-data one, whose values are texts, objects or lists."""
    i, name = F.col("doc_id"), F.concat(F.lit("doc."), F.col("doc_id"))
    year = (1800 + F.pmod(i, F.lit(200))).cast("string")

    def text(x: Column) -> Column:
        return F.to_json(F.struct(x.alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(x.alias("x")))) - 6)

    def named(x: Column) -> Column:
        return F.concat(F.lit('{"type":"Thing","name":'), text(x), F.lit("}"))

    who = F.when(i % 5 == 0, named(F.concat(F.col("source"), F.lit(", A. ")))).when(i % 5 == 1, F.concat(F.lit("["), named(F.col("source")), F.lit(',{"x":1},'), named(F.lit("B \u00e9")), F.lit("]"))).when(i % 5 == 2, text(F.col("source"))).when(i % 5 == 3, F.lit("null")).otherwise(F.lit("[]"))
    shared = F.concat(F.lit('"title":'), text(name), F.lit(',"language":'), F.coalesce(text(F.col("lang")), F.lit("null")), F.lit(',"pubDate":'), year)
    genre = F.when(i % 2 == 0, F.lit('["http://id.loc.gov/vocabulary/marcgt/fic","x"]')).otherwise(F.lit('"http://id.loc.gov/vocabulary/marcgt/bio"'))
    linked = F.concat(F.lit('{"htid":"'), name, F.lit('","metadata":{'), shared, F.lit(',"contributor":'), who, F.lit(',"genre":'), genre, F.lit(',"publisher":'), named(F.col("source")), F.lit(',"pubPlace":"bare"},"features":{"schemaVersion":"linked","pageCount":'), F.pmod(i, F.lit(9)), F.lit(',"pages":[]}}'))
    older = F.concat(F.lit('{"id":"'), name, F.lit('","metadata":{'), shared, F.lit(',"names":["N ",'), text(F.col("source")), F.lit('],"pubPlace":"xx","sourceInstitution":'), text(F.col("source")), F.lit('},"features":{"schemaVersion":"'), F.when(i % 3 == 0, "2.0").otherwise("3.0"), F.lit('","pageCount":'), F.pmod(i, F.lit(9)), F.lit(',"pages":[]}}'))
    return docs.where(i.isNotNull()).withColumn("source", F.coalesce("source", F.lit(""))).select(name.alias("htid"), F.when(i % 3 == 2, linked).otherwise(older).alias("value"))


def read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table; one with fewer splits than cores (a single row group, say) is dealt out first."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cores = spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs
