"""Labelled flow CSVs: encodings, empty rows, names and categories."""

from __future__ import annotations

from flowsift.sources import label_csv


def test_flow_labels(spark, tmp_path):
    (tmp_path / "names.csv").write_bytes("No.,Name,Type\n1, srcip ,nominal\n2,proto,nominal\n3,attack_cat,nominal\n4,Label,binary\n".encode("latin1"))
    (tmp_path / "1.csv").write_text("59.166.0.0,tcp, Backdoors ,1\n,,,\n59.166.0.1,udp,,0\n")
    (tmp_path / "2.csv").write_text("59.166.0.2,tcp,Fuzzers,1\n")
    names = label_csv.column_names(spark, str(tmp_path / "names.csv"))
    assert names == ["srcip", "proto", "attack_cat", "Label"]
    rows = label_csv.flow_labels(spark, [str(tmp_path / "1.csv"), str(tmp_path / "2.csv")], names)
    assert sorted((r["srcip"], r["attack_cat"], r["traffic_type"]) for r in rows.collect()) == [("59.166.0.0", "backdoor", 1), ("59.166.0.1", "", 0), ("59.166.0.2", "fuzzers", 1)]
    assert [tuple(r) for r in label_csv.attacks_per_protocol(rows).collect()] == [("tcp", 2)]


def test_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("10.0.0.1,é\n".encode("utf-16"))
    assert label_csv.find_encoding(spark, str(tmp_path / "a.csv"), label_csv.starts_with_address) == "UTF-16"
    (tmp_path / "b.csv").write_text("name,x\n")
    assert label_csv.find_encoding(spark, str(tmp_path / "b.csv"), label_csv.starts_with_address) is None


def test_windows_characters_are_those_of_the_code_page():
    assert "".join(bytes([ord(c)]).decode("cp1252") for c in label_csv._C1) == label_csv._WINDOWS


def test_day_labels(spark, tmp_path):
    (tmp_path / "d.csv").write_bytes("Flow ID, Source IP, Label\nf1,10.0.0.1,Web Attack – xss\nf2,,\nf3,10.0.0.2,Benign\n".encode("cp1252"))
    rows = label_csv.day_labels(spark, [str(tmp_path / "d.csv")])
    assert rows.columns == ["Flow ID", "Source IP", "Label"]
    assert sorted(tuple(r) for r in rows.collect()) == [("f1", "10.0.0.1", "WEB ATTACK – XSS"), ("f3", "10.0.0.2", "BENIGN")]
