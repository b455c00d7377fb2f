import io
import sys

import pytest
from pyspark.sql import functions as F

from folio.cli import main
from folio.functions import ids

# Ids and their two archive paths.
PATHS = [
    ("uc1.$b364513", "uc1/$61/uc1.$b364513.json.bz2", "uc1/pairtree_root/$b/36/45/13/$b364513/uc1.$b364513.json.bz2"),
    ("coo1.ark:/13960/t3dz0tr56", "coo1/a+30305/coo1.ark+=13960=t3dz0tr56.json.bz2", "coo1/pairtree_root/ar/k+/=1/39/60/=t/3d/z0/tr/56/ark+=13960=t3dz0tr56/coo1.ark+=13960=t3dz0tr56.json.bz2"),
    ("hvd.32044100887389", "hvd/34088/hvd.32044100887389.json.bz2", "hvd/pairtree_root/32/04/41/00/88/73/89/32044100887389/hvd.32044100887389.json.bz2"),
]


@pytest.mark.parametrize("htid,stubby,pair", PATHS)
def test_paths(spark, htid, stubby, pair):
    row = spark.createDataFrame([(htid,)], "htid string").select(ids.stubbytree_path("htid").alias("s"), ids.pairtree_path("htid").alias("p"), ids.zip_bucket("htid").alias("z"), ids.clean_htid("htid").alias("c")).first()
    assert row.s == ids.path_text(htid, "stubbytree") == stubby and row.p == ids.path_text(htid, "pairtree") == pair
    assert row.z == ids.bucket_text(htid) and row.c == ids.clean_text(htid)


def test_names(spark):
    names = ["aeu.ark+=13960=t1rf63t52.json.bz2", "mdp.1.tokens.parquet", "mdp.1.meta.json", "mdp.1", "a.b.gz"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(ids.extract_htid("n")).collect()]
    assert got == [ids.extract_text(n) for n in names] == ["aeu.ark:/13960/t1rf63t52", "mdp.1", "mdp.1", "mdp.1", "a.b"]
    assert ids.name_text("a.b", "parquet", "snappy", "tokens") == "a.b.tokens.parquet"
    assert spark.range(1).select(ids.decode_id(ids.encode_id(F.lit("a:/b.c")))).first()[0] == "a:/b.c"
    assert ids.file_or_id("x.json") == "file" and ids.file_or_id("mdp.1") == "id"
    with pytest.raises(NameError):
        ids.file_or_id("nothinghere")
    with pytest.raises(ValueError):
        ids.path_text("a.b", "nowhere")


def test_command_line(capsys, tmp_path, monkeypatch):
    assert main(["hvd.32044100887389"]) == 0 and capsys.readouterr().out == "hvd/34088/hvd.32044100887389.json.bz2\n"
    assert main([]) == 2 and main(["a.b", "-f", "x"]) == 2
    monkeypatch.setattr(sys, "stdin", io.StringIO("a.bcd\n\n"))
    assert main(["-s", "-f", "-", "-o", str(tmp_path / "o")]) == 0 and (tmp_path / "o").read_text() == "a/pairtree_root/bc/d/bcd/a.bcd.json.bz2\n"
