import gzip
import json

import pytest
from helpers import rows
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException

from tessellum.sources import readers, writers


def put(folder, name, content):
    path = folder / name
    path.write_text(content, encoding="utf-8")
    return str(path)


def test_run_and_judgement_files(spark, tmp_path):
    run = readers.run_file(spark, put(tmp_path, "a.run", "q1 Q0 d1 1 3.5 m\n\nq1\tQ0 d2 2 1e-3 m\n"))
    assert rows(run) == [("q1", "d1", 1, 3.5, "m"), ("q1", "d2", 2, 0.001, "m")]
    q = readers.assessor_qrels(spark, put(tmp_path, "ann-s1-2025-03-04-0930.qrels", "q1 0 d1 -2\nq1 0 d2 3\n"))
    assert {(r["doc_id"], r["rel"], r["assessor"], r["session"], str(r["ts"])) for r in q.collect()} == {("d1", -2, "ann", "s1", "2025-03-04 09:30:00"), ("d2", 3, "ann", "s1", "2025-03-04 09:30:00")}
    with pytest.raises((PySparkException, Py4JError)):
        readers.duplicate_table(spark, put(tmp_path, "dup", "a b\nc\n")).collect()
    assert rows(readers.duplicate_table(spark, put(tmp_path, "dup2", "a b\n\nb c\n"))) == [("a", "b"), ("b", "c")]


def test_eval_files(spark, tmp_path):
    lines = "runid all sysA\nmap all 0.5\nmap q1 0.25\nmap q2 n/a\n"
    path = put(tmp_path, "x.eval", lines)
    assert [tuple(r)[1:] for r in readers.eval_file(spark, path, ["map"]).collect()] == [("sysA", 0.5)]
    assert [r["score"] for r in readers.eval_per_query(spark, path, "map").collect()] == [0.25]
    with gzip.open(tmp_path / "sys.auto.tree.gz", "wt") as f:
        f.write("map all 0.75\n")
    assert [tuple(r) for r in readers.eval_named_files(spark, str(tmp_path / "sys.auto.tree.gz")).collect()] == [("sys", "auto", "tree", "map", "all", 0.75)]


def test_json_and_lines(spark, tmp_path):
    path = put(tmp_path, "x.jsonl", '{"a": 1}\n{"a": \n{"a": 3}\n')
    assert [(r["a"], r["_corrupt_record"] is None) for r in readers.json_lines_or_errors(spark, path, "a int").collect()] == [(1, True), (None, False), (3, True)]
    with pytest.raises((PySparkException, Py4JError)):
        readers.json_lines(spark, path, "a int").collect()
    items = put(tmp_path, "items.json", json.dumps([{"id": "Q7", "sitelinks": {"en": {"site": "en", "title": "Cat"}, "de": {"site": "de", "title": "Katze"}}}, {"id": "Q8", "sitelinks": {}}]))
    index = readers.language_index(spark, items)
    assert rows(readers.name_translation(index, "en", "de")) == [("Cat", "Katze")]
    assert rows(readers.topic_lines(spark, put(tmp_path, "topics", "7 two words\n8\n"))) == [("7", "two words"), ("8", "")]
    assert rows(readers.tab_separated(spark, put(tmp_path, "t.tsv", "a\tb\n1\tx\n\n2\n"), "a int, b string")) == [(1, "x"), (2, None)]
    assert readers.simple_yaml(put(tmp_path, "c.yaml", "# c\nsite: 'x'\nlist:\n  - a\n  - b\n")) == {"site": "x", "list": ["a", "b"]}


def test_xml_dump(spark, tmp_path):
    xml = '<mediawiki><siteinfo><namespaces><namespace key="0"/><namespace key="1">Talk</namespace><namespace key="14">Category</namespace></namespaces></siteinfo>' + "".join(f"<page><title>{t}</title><ns>0</ns><id>{i}</id><revision><text>x {i}</text></revision></page>" for i, t in enumerate(["Turtle", "Talk:Turtle", "Category:Animals", "Star: a story"])) + "</mediawiki>"
    path = put(tmp_path, "dump.xml", xml)
    assert readers.other_namespaces(spark, path) == ["Talk"]
    got = readers.wiki_dump(spark, path, readers.other_namespaces(spark, path))
    assert {r["title"] for r in got.collect()} == {"Turtle", "Category:Animals", "Star: a story"}


def test_annotations_vectors_synsets(spark, tmp_path):
    ann = readers.span_annotations(spark, put(tmp_path, "d1.ann", "# c\nT1\tLocation 3 8;10 14\tNew York\n")).first()
    assert (ann["kind"], ann["start"], ann["stop"], ann["text"]) == ("Location", 3, 14, "New York")
    v = readers.word_vectors(spark, put(tmp_path, "v.txt", "cat 0.5 -1 2\n")).first()
    assert v["word"] == "cat" and v["vector"] == [0.5, -1.0, 2.0]
    s = readers.synsets(spark, put(tmp_path, "data.noun", "  licence\n00001740 03 n 02 entity 0 thing 1 003 | gloss\n")).first()
    assert (s["offset"], s["pos"], s["words"]) == (1740, "n", ["entity", "thing"])
    c = readers.confirmation_lines(spark, put(tmp_path, "c", "Run x\n\tstrong\n\t\tpara\n\n"))
    assert [r["kind"] for r in c.collect()] == ["header", "strong", "para", "blank"]
    d = readers.text_documents(spark, put(tmp_path, "doc9.txt", "a\nb"))
    assert [tuple(r) for r in d.collect()] == [("doc9", "a\nb")]


def test_cbor_round_trip(spark, tmp_path):
    for value in (0, 23, 24, 255, 70000, 2**40, -1, -500, 1.5, None, True, "ü", b"\0\1", [1, [2, {}]], {"a": [None, False]}):
        assert readers.decode_cbor(writers.encode_cbor(value))[0] == value
    df = spark.createDataFrame([(i, f"t{i}") for i in range(7)], "id int, t string")
    assert writers.write_cbor_list(df.repartition(2), str(tmp_path / "out"), {"kind": "pages"}) == 7
    back = readers.cbor_list(spark, str(tmp_path / "out"))
    assert back.where("pos >= 0").count() == 7 and {json.loads(r["value"])["t"] for r in back.where("pos >= 0").collect()} == {f"t{i}" for i in range(7)}
    assert {r["value"] for r in back.where("pos = -1").collect()} == {'{"kind": "pages"}'}


def test_writers(spark, tmp_path):
    runs = spark.createDataFrame([("q", "d1", "m", 1.0), ("q", "d2", "m", 2.0), ("q", "d3", "n", 0.5)], "query_id string, doc_id string, method string, score double")
    writers.write_run(runs, str(tmp_path / "run"), most=1)
    assert rows(readers.run_file(spark, str(tmp_path / "run"))) == [("q", "d2", 1, 2.0, "m"), ("q", "d3", 1, 0.5, "n")]
    writers.write_run_per_method(runs, str(tmp_path / "per"))
    assert (tmp_path / "per" / "method=m").exists()
    writers.write_qrels(spark.createDataFrame([("q", "d", 2)], "query_id string, doc_id string, rel int"), str(tmp_path / "qrels"))
    assert [r["rel"] for r in readers.qrel_file(spark, str(tmp_path / "qrels"), binary=True).collect()] == [1]
    docs = spark.createDataFrame([(1, "äb"), (2, None)], "id int, text string")
    assert [r["value"].split("Content-Length: ")[1].split("\r\n")[0] for r in writers.warc_records(docs, "2025").collect()] == ["3", "0"]
    writers.write_chunks(spark.range(10).coalesce(1), str(tmp_path / "chunks"), 4)
    assert len(list((tmp_path / "chunks").glob("*.parquet"))) == 3
    assert writers.table_lines(docs, "markdown").first()["value"] == "| 1 | äb |"
    posts = spark.createDataFrame([("b", 1, 1, 3), ("a", 2, 1, 3)], "term string, doc_id int, tf int, len int")
    writers.merge_indexes([posts, posts], str(tmp_path / "index"), 1)
    assert rows(readers.postings_of(spark.read.parquet(str(tmp_path / "index")), ["a"])) == [("a", 2, 2, 3)]
    writers.write_provenance(str(tmp_path / "index"), source="x")
    assert json.loads((tmp_path / "index" / "_provenance.json").read_text()) == {"source": "x"}


def test_entity_linking_client(spark):
    def client(text):
        if text == "bad":
            raise OSError("no service")
        return [("cat", 0, 3, "Cat"), ("x", 4, 5, None)]

    docs = spark.createDataFrame([("a", "cat x"), ("b", "bad")], "id string, text string")
    assert rows(readers.entity_links(docs, client)) == sorted([("a", "cat", 0, 3, "Cat", None), ("b", None, None, None, None, "OSError: no service")], key=repr)
