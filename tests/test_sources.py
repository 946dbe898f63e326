import struct

import pytest

from tessera.operators import lexical
from tessera.plans import profile, tracking
from tessera.sources import binary_documents as bd
from tessera.sources import files, tables


def record(tag, level, payload):
    size = len(payload)
    if size >= 0xFFF:
        return struct.pack("<II", tag | level << 10 | 0xFFF << 20, size) + payload
    return struct.pack("<I", tag | level << 10 | size << 20) + payload


def paragraph(level, text):
    return record(67, level, text.encode("utf-16-le"))


def cell(level, col, row):
    return record(72, level, b"\0" * 8 + struct.pack("<4H", col, row, 1, 1))


def test_paragraph_controls():
    units = [0x41, 9, 0, 0, 0, 0, 0, 0, 0, 0x42, 10, 0x43, 13]
    assert bd.paragraph_text(struct.pack(f"<{len(units)}H", *units)) == "A B\nC"
    assert bd.paragraph_text("😀".encode("utf-16-le")) == "😀"


def test_table_records():
    data = paragraph(0, "앞") + record(71, 1, b" lbt") + record(77, 2, b"\0" * 4 + struct.pack("<HH", 2, 2))
    for r in range(2):
        for c in range(2):
            data += cell(2, c, r) + paragraph(3, f"{r}{c}")
    data += paragraph(0, "뒤")
    assert bd.section_paragraphs(data) == ["앞", "<!-- table -->\n| 00 | 01 |\n|---|---|\n| 10 | 11 |\n<!-- /table -->", "뒤"]


def test_long_record():
    body = b"x" * 5000
    assert list(bd.records(record(67, 1, body))) == [(67, 1, body)]


def test_number_and_render():
    assert tables.number_tables("<!-- table -->a<!-- /table --> <!-- table -->b<!-- /table -->") == "<!-- table:T1 -->a<!-- /table:T1 --> <!-- table:T2 -->b<!-- /table:T2 -->"
    assert tables.render_table(1, 2, [(0, 0, 1, 1, "a"), (0, 1, 1, 1, "b")]) == "a b"
    assert tables.render_table(2, 2, [(0, 0, 2, 1, "x"), (0, 1, 1, 1, "a"), (1, 1, 1, 1, "b")], nested=True) == "x · a / x · b"


def test_merge_pages():
    assert tables.merge_pages([["t", [["h", "i"], ["1", "2"]]], [[["h", "i"], ["3", "4"]], "u"]]) == ["t", [["h", "i"], ["1", "2"], ["3", "4"]], "u"]
    assert len(tables.merge_pages([[[["h", "i"]]], [[["h", "x"]]]])) == 2


def test_contents_go():
    text = "목차\n1. 가나 1\n2. 다라 2\n3. 마바 3\n본문 " + "내용이 이어진다 " * 40
    assert tables.drop_contents(text).startswith("본문")


def test_manifest(spark, tmp_path):
    (tmp_path / "m.csv").write_text("﻿파일명,사업명\na.hwp,가\n,\n", encoding="utf-8")
    rows = files.read_manifest(spark, str(tmp_path / "m.csv")).orderBy("pos").collect()
    assert [r["filename"] for r in rows] == ["a.hwp", ""]
    (tmp_path / "n.csv").write_text("x\n1\n")
    with pytest.raises(ValueError):
        files.read_manifest(spark, str(tmp_path / "n.csv"))


def test_files_and_errors(spark, tmp_path):
    (tmp_path / "a.txt").write_text("본문")
    (tmp_path / "b.xyz").write_text("?")
    (tmp_path / "c.hwp").write_bytes(b"broken")
    rows = {r["filename"]: r for r in bd.read_texts(files.read_raw_files(spark, str(tmp_path))).collect()}
    assert rows["a.txt"]["text"] == "본문" and rows["b.xyz"]["read_error"] and rows["c.hwp"]["read_error"]


def test_index_round_trip(spark, tmp_path):
    chunks = spark.createDataFrame([(0, "a"), (1, "b")], "chunk_no long, text string")
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "chunk_no long, embedding array<float>")
    files.write_index({"chunks": chunks, "vectors": vectors, "grams": lexical.gram_table(chunks)}, str(tmp_path / "i"), {"strategy": "fixed"})
    tables_, config = files.read_index(spark, str(tmp_path / "i"))
    assert config == {"strategy": "fixed", "chunk_count": 2, "dimension": 2} and tables_["grams"].count() == 2
    for bad in ([(0, [1.0, 0.0]), (1, [0.0, 1.0, 0.0])], [(0, [1.0, 0.0]), (1, [0.0, 0.0])]):
        wrong = spark.createDataFrame(bad, "chunk_no long, embedding array<float>")
        with pytest.raises(ValueError, match="chunk"):
            files.write_index({"chunks": chunks, "vectors": wrong, "grams": lexical.gram_table(chunks)}, str(tmp_path / "j"), {})
    files.write_index({"chunks": chunks, "vectors": vectors.limit(1), "grams": lexical.gram_table(chunks)}, str(tmp_path / "k"), {})
    with pytest.raises(ValueError, match="agree"):
        files.read_index(spark, str(tmp_path / "k"))


def test_profiles():
    assert [p.name for p in profile.scenarios("both")] == ["A", "B"]
    p = profile.resolve(profile.A, {"rerank": "none", "hybrid": False}, {"TESSERA_MIN_SCORE": "off", "TESSERA_TOP_K": "7"})
    assert p.min_score is None and p.top_k == 7 and p.expand is None and p.candidates is None and profile.pool_size(p) == 7
    with pytest.raises(ValueError):
        profile.resolve(profile.B, {"strategy": "overview"}, {})
    with pytest.raises(ValueError):
        profile.resolve(profile.A, {"rewrite": "only"}, {})
    assert profile.parse_filters(["a=1=2", "a=3"], {"b": "4"}) == {"a": "3", "b": "4"}


def test_tracking(tmp_path):
    db = str(tmp_path / "c.db")
    assert [tracking.next_run(db, "x") for _ in range(2)] == ["x-0001", "x-0002"]
    assert not tracking.is_stale(tracking.normalised_hash(b"a\r\nb"), b"a\nb")
    assert "&#124;" in tracking.report({"m": 1}, {}, {"id": "a|b"}, {}, "t")
    assert "| m | 1.000 | - |" in tracking.comparison({"A": {"m": 1.0}, "B": {}}, ("m",))
