"""Volume metadata: one row per volume from any schema version, polymorphic values kept as JSON text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.sources import stores

# Attribute by JSON path, as the volume files name them.
COMMON = {
    "metadata_schema_version": "$.metadata.schemaVersion", "enumeration_chronology": "$.metadata.enumerationChronology", "type_of_resource": "$.metadata.typeOfResource", "title": "$.metadata.title",
    "date_created": "$.metadata.dateCreated", "pub_date": "$.metadata.pubDate", "language": "$.metadata.language", "access_profile": "$.metadata.accessProfile", "isbn": "$.metadata.isbn",
    "issn": "$.metadata.issn", "lccn": "$.metadata.lccn", "oclc": "$.metadata.oclc", "page_count": "$.features.pageCount", "feature_schema_version": "$.features.schemaVersion",
}
OLD = {
    "ht_bib_url": "$.metadata.htBibUrl", "genre": "$.metadata.genre", "handle_url": "$.metadata.handleUrl", "imprint": "$.metadata.imprint", "names": "$.metadata.names", "id": "$.id",
    "source_institution": "$.metadata.sourceInstitution", "classification": "$.metadata.classification", "issuance": "$.metadata.issuance", "bibliographic_format": "$.metadata.bibliographicFormat",
    "government_document": "$.metadata.governmentDocument", "hathitrust_record_number": "$.metadata.hathitrustRecordNumber", "rights_attributes": "$.metadata.rightsAttributes",
    "pub_place": "$.metadata.pubPlace", "volume_identifier": "$.metadata.volumeIdentifier", "source_institution_record_number": "$.metadata.sourceInstitutionRecordNumber", "last_update_date": "$.metadata.lastUpdateDate",
}
LINKED = {
    "access_rights": "$.metadata.accessRights", "alternate_title": "$.metadata.alternateTitle", "category": "$.metadata.category", "genre_ld": "$.metadata.genre", "contributor_ld": "$.metadata.contributor", "id": "$.htid",
    "handle_url": "$.metadata.id", "source_institution_ld": "$.metadata.sourceInstitution", "lcc": "$.metadata.lcc", "type": "$.metadata.type", "is_part_of": "$.metadata.isPartOf",
    "last_rights_update_date": "$.metadata.lastRightsUpdateDate", "pub_place_ld": "$.metadata.pubPlace", "main_entity_of_page": "$.metadata.mainEntityOfPage", "publisher_ld": "$.metadata.publisher",
}
OLD_VERSIONS = ("2.0", "3.0")
GENRE_PREFIX = "http://id.loc.gov/vocabulary/marcgt/"
# The codes of the MARC genre term list and their labels, by code.
GENRES = {
    "abs": "abstract or summary", "aro": "art original", "arr": "art reproduction", "art": "article", "atl": "atlas", "aut": "autobiography", "bda": "bibliographic data",
    "bib": "bibliography", "bio": "biography", "boo": "book", "cal": "calendar", "cat": "catalog", "cgn": "comic or graphic novel", "cha": "chart", "cod": "comedy",
    "com": "computer program", "cpb": "conference publication", "dic": "dictionary", "dio": "diorama", "dir": "directory", "dis": "discography", "doc": "document (computer)",
    "dra": "drama", "dtb": "database", "enc": "encyclopedia", "ess": "essay", "fes": "festschrift", "fic": "fiction", "fil": "filmography", "fin": "finding aid",
    "fla": "flash card", "fls": "filmstrip", "fol": "folktale", "fon": "font", "gam": "game", "glo": "globe", "gov": "government publication", "gra": "graphic", "han": "handbook",
    "his": "history", "hum": "humor, satire", "ind": "index", "inm": "interactive multimedia", "ins": "instruction", "int": "interview", "iss": "issue", "jou": "journal",
    "kit": "kit", "lan": "language instruction", "law": "law report or digest", "lea": "legal article", "lec": "legal case and case notes", "leg": "legislation", "let": "letter",
    "loo": "loose-leaf", "man": "manuscript", "map": "map", "mem": "memoir", "mic": "microscope slide", "mod": "model", "mot": "motion picture", "new": "newspaper",
    "nos": "nonmusical sound", "nov": "novel", "num": "numeric data", "off": "offprint", "ons": "online system or service", "pat": "patent", "per": "periodical", "pic": "picture",
    "pla": "playing cards", "poe": "poetry", "pos": "postcard", "pro": "programmed text", "puz": "puzzle", "rea": "realia", "reh": "rehearsal", "rem": "remote sensing image",
    "rep": "representational", "rev": "review", "rpt": "reporting", "scr": "script", "ser": "series", "sho": "short story", "sli": "slide", "sou": "sound", "spe": "speech",
    "sta": "statistics", "stp": "standard or specification", "sur": "survey of literature", "ted": "technical drawing", "ter": "technical report", "the": "thesis", "toy": "toy",
    "tra": "transparency", "tre": "treaty", "vid": "videorecording", "wal": "wall map", "web": "web site", "yea": "yearbook",
}


def _names(x: Column) -> Column:
    """Of an object, its name; of a list, the names its members have; a bare string stays."""
    one = F.get_json_object(x, "$.name")
    many = F.filter(F.transform(F.from_json(x, "array<string>"), lambda y: F.get_json_object(y, "$.name")), lambda y: y.isNotNull())
    return F.when(x.isNull(), None).when(x.startswith("["), F.to_json(many)).when(x.startswith("{"), one).otherwise(x)


def genre_labels(x: Column, labels: dict[str, str]) -> Column:
    """A list of genres (a scalar is wrapped, null is empty); codes of the vocabulary become their label where ``labels`` has it."""
    items = F.when(x.isNull(), F.array().cast("array<string>")).when(x.startswith("["), F.from_json(x, "array<string>")).otherwise(F.array(x))
    if not labels:
        return items
    table = F.create_map(*[F.lit(v) for kv in labels.items() for v in kv])
    return F.transform(items, lambda g: F.when(g.startswith(GENRE_PREFIX), F.coalesce(F.element_at(table, F.substring(g, len(GENRE_PREFIX) + 1, 64)), g)).otherwise(g))


def _schema() -> str:
    """What a volume's text is parsed for, once: the attributes above, each as its text, so that no value is refused for its kind."""
    paths = {p for table in (COMMON, OLD, LINKED) for p in table.values()}
    top = [p[2:] for p in sorted(paths) if p.count(".") == 1]
    below = {part: sorted(p.rsplit(".", 1)[1] for p in paths if p.startswith(f"$.{part}.")) for part in ("metadata", "features")}
    return ", ".join([*(f"`{k}` string" for k in top), *(f"{part} struct<{', '.join(f'`{k}`: string' for k in keys)}>" for part, keys in below.items())])


def volumes(raw: DataFrame, genres: dict[str, str] | None = None) -> DataFrame:
    """Metadata of ``raw`` (htid, value). ``genres``: labels by vocabulary code, in place of the list's; an empty table leaves codes as they are.

    Each text is parsed once and its pages are skipped; a text that is no JSON gives a row of nulls.
    """
    parsed = raw.select("htid", F.from_json("value", _schema()).alias("v"))
    old = F.col("v.features.schemaVersion").isin(*OLD_VERSIONS)

    def got(path: str | None) -> Column:
        return F.col(f"v{path[1:]}") if path else F.lit(None).cast("string")

    names = list(dict.fromkeys([*OLD, *LINKED]))
    rows = parsed.select("htid", *[got(p).alias(k) for k, p in COMMON.items()], *[F.when(old, got(OLD.get(k))).otherwise(got(LINKED.get(k))).alias(k) for k in names], F.coalesce(old, F.lit(False)).alias("_old"))
    flat = {k: _names(F.col(f"{k}_ld")) for k in ("contributor", "source_institution", "pub_place", "publisher")}
    rows = rows.withColumns({k: F.when(F.col("_old"), F.col(k)).otherwise(x) if k in rows.columns else x for k, x in flat.items()})
    who = F.when(F.col("_old"), F.col("names")).otherwise(F.col("contributor"))
    author = F.when(who.isNull(), F.array().cast("array<string>")).when(who.startswith("["), F.from_json(who, "array<string>")).otherwise(F.array(who))
    return rows.withColumns({
        "genre": genre_labels(F.when(F.col("_old"), F.col("genre")).otherwise(F.col("genre_ld")), GENRES if genres is None else genres), "author": author, "year": F.col("pub_date"), "page_count": F.col("page_count").cast("int"),
        "tokenization_warning": F.col("_old") & F.coalesce(F.col("language").isin("jpn", "chi"), F.lit(False)),
    }).drop("_old")


def sidecar(raw: DataFrame) -> DataFrame:
    """Flat metadata side-cars (htid, value): id, title, handle_url with their defaults, and the text."""
    def field(name: str) -> Column:
        return F.get_json_object("value", f"$.{name}")

    return raw.select(
        "htid", F.coalesce(field("id"), F.col("htid")).alias("id"), F.coalesce(field("title"), F.col("htid")).alias("title"), F.coalesce(field("handle_url"), F.concat(F.lit("http://hdl.handle.net/2027/"), F.col("htid"))).alias("handle_url"),
        F.coalesce(field("metadata_schema_version"), field("schema_version")).alias("metadata_schema_version"), field("page_count").cast("int").alias("page_count"), "value",
    )


def bibliographic(rows: DataFrame, fetch: Callable[[str], str] | None = None) -> DataFrame:
    """htid, record_id, marc_xml of volumes (htid, ht_bib_url): the first item's record in the service's answer.

    Each address is fetched once, on executors, by ``fetch`` (say ``stores.url_fetcher("{url}")``); an answer without items gives nulls,
    a volume without an address is left out.
    """
    asked = rows.where(F.col("ht_bib_url").isNotNull()).select("htid", "ht_bib_url")
    answers = stores.fetched(asked.select(F.col("ht_bib_url").alias("htid")).distinct(), fetch).withColumnRenamed("htid", "ht_bib_url")
    records = F.from_json(F.get_json_object("value", "$.records"), "map<string, struct<`marc-xml`: string>>")
    got = answers.select("ht_bib_url", F.get_json_object("value", "$.items[0].fromRecord").alias("record_id"), records.alias("records"))
    return asked.join(got, "ht_bib_url").select("htid", "record_id", F.col("records")[F.col("record_id")]["marc-xml"].alias("marc_xml"))


def marc_subfields(xml: Column, tag: str, code: str) -> Column:
    """The texts of a record's subfields ``code`` in the fields ``tag``, in order; none is an empty list."""
    return F.when(xml.isNull(), None).otherwise(F.xpath(xml, F.lit(f"//datafield[@tag='{tag}']/subfield[@code='{code}']/text()")))


def marc_control(xml: Column, tag: str) -> Column:
    """The text of a record's control field; none is null."""
    return F.try_element_at(F.xpath(xml, F.lit(f"//controlfield[@tag='{tag}']/text()")), F.lit(1))


def _stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def short(x: Column, width: int) -> Column:
    """Cut for display: without white space at its ends, and with dots where it was longer than ``width``."""
    return F.when(F.length(x) > width, F.concat(_stripped(F.substring(x, 1, width)), F.lit("..."))).otherwise(_stripped(x))


def printed(rows: DataFrame) -> DataFrame:
    """htid, ``line`` (a volume in one line of text) and ``html`` (the same with its address) of volumes' metadata; what is missing is printed as None."""
    def shown(x: Column) -> Column:
        return F.coalesce(x.cast("string"), F.lit("None"))

    title, year = F.col("title"), shown(F.col("year"))
    line = F.when(F.size("author") > 0, F.concat(F.lit("<Volume: "), shown(short(title, 30)), F.lit(" ("), year, F.lit(") by "), shown(short(F.col("author")[0], 40)), F.lit(">"))).otherwise(F.concat(F.lit("<Volume: "), shown(short(title, 30)), F.lit(" ("), year, F.lit(") without a listed author>")))
    html = F.concat(F.lit("<strong><a href='"), shown(F.col("handle_url")), F.lit("'>"), shown(title), F.lit("</a></strong> by <em>"), F.array_join("author", ", "), F.lit("</em> ("), year, F.lit(", "), shown(F.col("page_count")), F.lit(" pages) - <code>"), shown(F.col("id")), F.lit("</code>"))
    return rows.select("htid", line.alias("line"), html.alias("html"))


def printed_pages(pages: DataFrame) -> DataFrame:
    """htid, page, ``line`` of pages (htid, page)."""
    return pages.select("htid", "page", F.format_string("<page %d of volume %s>", "page", "htid").alias("line"))
