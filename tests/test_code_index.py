import pytest

from quarry.sources.code_index import CorruptIndex, occurrences, read_index


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _bytes(number, data):
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def _index():
    occ = _bytes(1, bytes([3, 4]) + _varint(200)) + _bytes(2, b"py pip m 1 a/f().") + _varint(3 << 3) + b"\x01"
    ref = _bytes(1, bytes([5, 0, 6, 2])) + _bytes(2, b"local 1")
    doc = _bytes(1, b"a.py") + _bytes(2, occ) + _bytes(2, ref) + _bytes(4, b"python")
    return _bytes(1, b"meta") + _bytes(2, doc)


def test_decodes_ranges_and_roles():
    assert list(occurrences(_index())) == [("a.py", "python", "py pip m 1 a/f().", 3, 4, 3, 200, True), ("a.py", "python", "local 1", 5, 0, 6, 2, False)]


def test_truncated_index_is_an_error():
    with pytest.raises((CorruptIndex, UnicodeDecodeError)):
        list(occurrences(_index()[:-3]))


def test_reads_files(spark, tmp_path):
    (tmp_path / "x.scip").write_bytes(_index())
    (tmp_path / "y.txt").write_bytes(b"no")
    assert read_index(spark, str(tmp_path)).where("is_definition").count() == 1
