"""Digests of files on either side of the length that executors read whole."""

import hashlib

from ledgerline.sources import tables


def listed(df):
    return sorted((r["file"], r["length"], r["sha256"]) for r in df.collect())


def test_long_files_are_digested_as_streams(spark, tmp_path, monkeypatch):
    texts = {"short.bin": b"\xef\xbb\xbfabc\n", "sub/even.bin": bytes(range(100)), "sub/a b%20c.bin": b"\r\n\x00" * 70_000, "long.bin": b"x" * 300_001}
    (tmp_path / "sub").mkdir()
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text)
    want = sorted((name.split("/")[-1], len(text), hashlib.sha256(text).hexdigest()) for name, text in texts.items())
    plain = tables.file_manifest(spark, str(tmp_path))
    assert listed(plain) == want
    monkeypatch.setattr(tables, "WHOLE_FILE", 100)
    monkeypatch.setattr(tables, "STREAM_BUFFER", 4096)
    cut = tables.file_manifest(spark, str(tmp_path))
    assert listed(cut) == want and cut.schema == plain.schema
    assert listed(tables.file_manifest(spark, str(tmp_path / "long.bin"))) == [w for w in want if w[0] == "long.bin"]


def test_a_file_above_2_gb(spark, tmp_path):
    size, digest = (1 << 31) + 5, hashlib.sha256()
    with open(tmp_path / "big.bin", "wb") as f:
        f.truncate(size)  # takes no room on disk
    for k in range(0, size, 1 << 24):
        digest.update(bytes(min(1 << 24, size - k)))
    assert listed(tables.file_manifest(spark, str(tmp_path))) == [("big.bin", size, digest.hexdigest())]
