"""Volume identifiers and storage paths: column expressions and their plain-Python twins."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = {"json": "bz2", "parquet": None}


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def encode_id(x: Column | str) -> Column:
    """Characters that file systems reserve, replaced: ``:`` ``/`` ``.`` by ``+`` ``=`` ``,``."""
    return F.translate(_col(x), ":/.", "+=,")


def decode_id(x: Column | str) -> Column:
    return F.translate(_col(x), "+=,", ":/.")


def library(htid: Column | str) -> Column:
    return F.substring_index(_col(htid), ".", 1)


def volume_part(htid: Column | str) -> Column:
    """What follows the first dot; empty where there is none."""
    return F.regexp_replace(_col(htid), r"^[^.]*\.?", "")


def clean_htid(htid: Column | str) -> Column:
    """The id with its volume part encoded."""
    return F.concat(library(htid), F.lit("."), encode_id(volume_part(htid)))


def extract_htid(name: Column | str) -> Column:
    """The id from a file name: one compression, one format and one table suffix come off, then it is decoded."""
    x = _col(name)
    for pattern in (r"\.(gz|bz2)$", r"\.(json|parquet)$", r"\.(meta|tokens|chars|section)$"):
        x = F.regexp_replace(x, pattern, "")
    return decode_id(x)


def file_name(htid: Column | str, fmt: str = "json", compression: str | None = "bz2", suffix: str | None = None) -> Column:
    parts = [clean_htid(htid), *[F.lit(p) for p in (suffix, fmt, compression if fmt != "parquet" else None) if p]]
    return F.concat_ws(".", *parts)


def stubbytree_path(htid: Column | str, fmt: str = "json", compression: str | None = "bz2", suffix: str | None = None) -> Column:
    """library / every third character of the encoded volume part / file."""
    stub = F.regexp_replace(encode_id(volume_part(htid)), "(.).{0,2}", "$1")
    return F.concat_ws("/", library(htid), stub, file_name(htid, fmt, compression, suffix))


def pairtree_path(htid: Column | str, fmt: str = "json", compression: str | None = "bz2", suffix: str | None = None) -> Column:
    """library / pairtree_root / two-character folders / encoded volume part / file."""
    enc = encode_id(volume_part(htid))
    return F.concat_ws("/", library(htid), F.lit("pairtree_root"), F.regexp_replace(enc, "(..)(?=.)", "$1/"), enc, file_name(htid, fmt, compression, suffix))


def zip_bucket(htid: Column | str, hash_chars: int = 3) -> Column:
    """The archive that holds the volume: the first hex digits of the id's SHA-1; with none, one archive."""
    return F.substring(F.sha1(_col(htid).cast("binary")), 1, hash_chars) if hash_chars else F.lit("features")


def local_path(htid: Column | str, fmt: str = "json", compression: str | None = "bz2", suffix: str | None = None) -> Column:
    return file_name(htid, fmt, compression, suffix)


LAYOUTS = {"local": local_path, "pairtree": pairtree_path, "stubbytree": stubbytree_path}


def encode_text(x: str) -> str:
    return x.translate(str.maketrans(":/.", "+=,"))


def decode_text(x: str) -> str:
    return x.translate(str.maketrans("+=,", ":/."))


def clean_text(htid: str) -> str:
    lib, _, vol = htid.partition(".")
    return f"{lib}.{encode_text(vol)}"


def extract_text(name: str) -> str:
    for pattern in (r"\.(gz|bz2)$", r"\.(json|parquet)$", r"\.(meta|tokens|chars|section)$"):
        name = re.sub(pattern, "", name)
    return decode_text(name)


def name_text(htid: str, fmt: str = "json", compression: str | None = "bz2", suffix: str | None = None) -> str:
    return ".".join(p for p in (clean_text(htid), suffix, fmt, compression if fmt != "parquet" else None) if p)


def path_text(htid: str, layout: str = "stubbytree", fmt: str = "json", compression: str | None = "bz2") -> str:
    lib, _, vol = htid.partition(".")
    enc, name = encode_text(vol), name_text(htid, fmt, compression)
    if layout == "stubbytree":
        return f"{lib}/{enc[::3]}/{name}"
    if layout == "pairtree":
        return "/".join([lib, "pairtree_root", *(enc[i : i + 2] for i in range(0, len(enc), 2)), enc, name])
    if layout == "local":
        return name
    raise ValueError(f"no such layout: {layout}")


def bucket_text(htid: str, hash_chars: int = 3) -> str:
    return hashlib.sha1(htid.encode()).hexdigest()[:hash_chars] if hash_chars else "features"


def file_or_id(x: str) -> str:
    """``file`` for names with a known ending, ``id`` for a dot within the first six characters."""
    if x.endswith((".gz", ".bz2", ".json", ".parquet")):
        return "file"
    if "." in x[:6]:
        return "id"
    raise NameError(f"neither a file nor an id: {x}")
