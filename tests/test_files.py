"""Readers, writers and commands."""

import pytest
from pyspark.sql import functions as F

from draftgraph import __main__ as command
from draftgraph.operators import labels
from draftgraph.sources import pdf, readers, sinks

PAGE = b"%%PDF-1.4\n1 0 obj\n<< /Type /Page /MediaBox [0 0 400 300] /Contents 2 0 R >>\nendobj\n2 0 obj\n<< >>\nstream\n%s\nendstream\nendobj\n"


def test_page_content():
    p = pdf.read_page(PAGE % b"q 2 0 0 2 10 0 cm 1 0 0 RG 1.5 w [2 2] 0 d 0 0 m 10 20 l S Q 10 10 30 40 re f BT /F1 10 Tf 100 120 Td (A\\(1\\)) Tj ET")
    line, box = p["drawings"]
    assert line["items"][0]["pts"] == [{"x": 10.0, "y": 300.0}, {"x": 30.0, "y": 260.0}] and line["color"] == [1.0, 0.0, 0.0] and line["dashes"] == "[2 2] 0" and line["width"] == 1.5
    assert box["items"][0]["kind"] == "re" and box["color"] is None and box["fill"] == [0.0, 0.0, 0.0]
    assert p["texts"][0]["text"] == "A(1)" and p["texts"][0]["bbox"][3] == 180.0
    import zlib

    packed = zlib.compress(b"0 0 m 5 5 l S")
    data = b"%PDF\n1 0 obj\n<< /Type /Page /Contents 2 0 R >>\nendobj\n2 0 obj\n<< /Filter /FlateDecode >>\nstream\n" + packed + b"\nendstream\nendobj\n"
    assert len(pdf.read_page(data)["drawings"]) == 1


@pytest.mark.parametrize("data, page", [(b"nothing", None), (PAGE % b"BT ET", None), (PAGE % b"0 0 m 1 1 l S", 3), (b"1 0 obj << /Type /Page >> endobj 2 0 obj << /Type /Page >> endobj", None)])
def test_page_errors(data, page):
    with pytest.raises(pdf.PageError):
        pdf.read_page(data, page)


def test_pdf_command(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.PDF").write_bytes(PAGE % b"0 0 m 100 0 l S BT /F1 9 Tf 20 20 Td (204) Tj ET")
    (tmp_path / "in/b.pdf").write_bytes(b"broken")
    (tmp_path / "in/c.txt").write_bytes(b"no plan")
    assert command.main(["pdf", "--folder", str(tmp_path / "in"), "--out", str(tmp_path / "out")]) == 0
    assert {r.plan: r.status for r in spark.read.parquet(str(tmp_path / "out/runs")).collect()} == {"a.PDF": "ok", "b.pdf": "error: no pages"}
    assert spark.read.parquet(str(tmp_path / "out/paths")).select("x1", "y0").first() == (100.0, 0.0)
    assert spark.read.parquet(str(tmp_path / "out/texts")).first().text == "204"
    code = command.main(["extract", "--paths", str(tmp_path / "out/paths"), "--texts", str(tmp_path / "out/texts"), "--out", str(tmp_path / "docs")])
    assert code == 0 and spark.read.json(str(tmp_path / "docs")).count() == 1
    assert readers.plan_files(spark, str(tmp_path / "in"), most=1).count() == 1


def test_folder_of_documents(spark, tmp_path):
    for name in ("a.json", "a_dropped.json", "b.invalid.json"):
        (tmp_path / name).write_text('{"plan_id": 1, "rooms": [], "walls": []}')
    assert [r.file for r in readers.documents(spark, str(tmp_path)).select("file").collect()] == ["a.json"]


def test_documents_replace_their_own_folder(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "plan_id long, text string")
    sinks.write_documents(docs, str(tmp_path / "d"))
    sinks.write_documents(docs.filter("plan_id = 2").withColumn("text", F.lit("new")), str(tmp_path / "d"))
    assert sorted(spark.read.json(str(tmp_path / "d")).select("plan_id", "text").collect()) == [(1, "a"), (2, "new")]


def test_labels_round_trip(spark, tmp_path):
    rooms = spark.createDataFrame([(1, "203", 1.005, 2.0, 30.04, None, None, None), (1, None, 0.0, 0.0, 1.0, None, None, None)], "plan_id long, room_id string, cx double, cy double, area double, room_type string, room_name string, room_number string")
    made, skipped = labels.template_rooms(rooms)
    assert skipped.count() == 1
    targets = labels.template_targets(spark.createDataFrame([(1, "A302"), (1, "A302"), (1, None)], "plan_id long, target_sheet string"))
    path = str(tmp_path / "x.labels.yaml")
    sinks.labels_yaml(made, targets, path, "x")
    with pytest.raises(FileExistsError):
        sinks.labels_yaml(made, targets, path, "x")
    back = readers.labels_yaml(spark, [(1, path)])
    assert back["rooms"].first().room_id == "203" and back["rooms"].first().correct_type == "TODO"
    assert sorted((r.kind, r.target_sheet) for r in back["targets"].collect()) == [("detected", "A302"), ("valid", "A302")]
    errors = {r.error for r in labels.label_errors(made.select("plan_id", "room_id"), back["rooms"]).collect()}
    assert errors == {"correct_type: still to do"}
    with pytest.raises(ValueError):
        labels.require_labels(labels.label_errors(made.select("plan_id", "room_id"), back["rooms"]))


def test_markdown_and_matrix(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 0.5)], "x string, n int, v double")
    assert sinks.markdown(df, "T").splitlines()[-1] == "| a | 1 | 0.5 |"
    sinks.write_matrix(df, str(tmp_path / "m"))
    assert spark.read.option("header", True).csv(str(tmp_path / "m")).count() == 1
