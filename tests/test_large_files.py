"""Identities of files that no task could hold."""

from __future__ import annotations

import gzip
import hashlib

from candlemill.sinks import files as W


def test_files_beyond_two_gigabytes_are_hashed_by_pieces(spark, tmp_path):
    size = (1 << 31) + 12_345
    (tmp_path / "sub").mkdir()
    with open(tmp_path / "large one%20.bin", "wb") as f:  # a hole: takes no disk
        f.truncate(size)
    (tmp_path / "sub" / "some.gz").write_bytes(gzip.compress(b"abc", mtime=0))
    (tmp_path / "small.bin").write_bytes(b"abc")
    want, piece, left = hashlib.sha256(), bytes(1 << 24), size
    while left:
        want.update(piece[: min(left, len(piece))])
        left -= min(left, len(piece))
    got = {r.file_name: (r.bytes, r.sha256) for r in W.artifact_table(spark, str(tmp_path)).collect()}
    assert got == {"large one%20.bin": (size, want.hexdigest()), "sub/some.gz": (23, hashlib.sha256(gzip.compress(b"abc", mtime=0)).hexdigest()), "small.bin": (3, hashlib.sha256(b"abc").hexdigest())}


def test_files_that_only_spark_can_open(spark, tmp_path):
    (tmp_path / "small.bin").write_bytes(b"abc")
    (tmp_path / "other.bin").write_bytes(b"abcd")
    got = W.file_digests(spark, str(tmp_path), digest=lambda path: "here" if path.endswith("other.bin") else None)
    assert sorted((r.length, r.sha256) for r in got.collect()) == [(3, hashlib.sha256(b"abc").hexdigest()), (4, "here")]
