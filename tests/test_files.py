"""Files are hashed in pieces, whatever their bytes."""

import base64
import hashlib
import os

import pytest

from quillspark.sources import documents as D


@pytest.mark.parametrize("split", [1 << 20, 1 << 27])
def test_large_files_in_pieces(spark, tmp_path, split):
    noise = os.urandom(3_000_001)
    files = {"a b.bin": noise, "one.txt": noise + b"\n", "two+.txt": b"\xef\xbb\xbf" + noise, "three.pdf": b"\xef\xbb\xbf" + noise + b"\n\r\n",
             "four": b"\n" * 4001, "five": b"x" * 5000, "six.gz": os.urandom(5000), "eight": noise[:100]}
    (tmp_path / "sub").mkdir()
    for name, data in files.items():
        (tmp_path / "sub" / name).write_bytes(data)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        pieces = D.file_hashes(spark, str(tmp_path), whole=4000)
        got = {r["name"]: (r["mime"], r["size"], r["file_hash"]) for r in pieces.collect()}
        plan = pieces._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    whole = D.read_documents(spark, str(tmp_path)).select("name", "mime", "size", "file_hash").collect()
    assert got == {r["name"]: (r["mime"], r["size"], r["file_hash"]) for r in whole} and len(got) == len(files)
    assert got["three.pdf"][2] == hashlib.sha256(base64.b64encode(files["three.pdf"])).hexdigest()
    assert "LessThanOrEqual(length,4000)" in plan  # larger ones are never one row
