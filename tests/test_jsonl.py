import json

import pytest

from postmill.sources import jsonl


def write(path, lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def dump(row):
    return json.dumps(row, ensure_ascii=False)


def test_aliases_labels_and_report(spark, tmp_path):
    human = write(tmp_path / "human.jsonl", [dump(
        {"comments_count": 70, "domain": "travel", "desc": "by train", "note_title": "North", "collected_count": 0, "liked_count": 12})])
    ai = write(tmp_path / "aigc.jsonl", ["", dump({"model_family": "fam3", "note_content": "by boat", "note_title": "South"})])
    posts, report, bad = jsonl.load_posts(spark, human, ai)
    rows = {row["label"]: row for row in posts.collect()}
    assert (rows[0]["note_content"], rows[0]["likes"], rows[0]["collections"], rows[0]["comments"]) == ("by train", 12, 0, 70)
    assert rows[1]["model_family"] == "fam3" and rows[1]["source_line"] == 2 and rows[1]["source_file"] == "aigc.jsonl"
    found = {row["source_file"]: row for row in report.collect()}
    assert found["human.jsonl"]["alias_note_content"] == 1 and found["aigc.jsonl"]["alias_note_content"] == 0
    assert bad.isEmpty()


def test_key_present_with_null_wins_over_alias(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", ['{"note_title":null,"note_content":null,"desc":"x"}'])
    row = jsonl.good_rows(jsonl.load_source(spark, path, 0)).first()
    assert row["note_content"] is None and row["note_title"] is None


LINES = [
    '{"note_title":"t","note_content":"a"}',
    '{"note_title":"t","note_content":"a"}x',
    "{'note_title':'t','note_content':'a'}",
    '{"note_title":"t","note_content":"a","likes":NaN}',
    '{"note_title":"t","note_content":"a"}{"b":1}',
    '{"note_title":"t","note_content":"a"}]{}',
    '[{"note_title":"t"}]',
    "3",
    "null",
    '"text"',
    '  {"note_title":"t }","note_content":{"b":[1]}}  ',
    '{"note_title":"t","note_title":"u","note_content":"a"}',
    '{"note_title":"t","note_content":"a",}',
    '{"note_title":"t","note_content":"a"',
    '{"note_title":"t","note_content":"a"} ',
    "  　",
    '{"note_title":"t","note_content":"\t"}',
    '{"note_title":"t","note_content":"\\ud83d\\ude0a"}',
]


def python_verdict(line):
    if not line.strip():
        return "blank"
    try:
        return "ok" if isinstance(json.loads(line), dict) else "malformed"
    except ValueError:
        return "malformed"


def test_strictness_is_that_of_the_python_parser(spark):
    lines = spark.createDataFrame([("f", i, line) for i, line in enumerate(LINES)], "source_file string, source_line bigint, value string")
    parsed = {row["source_line"]: row for row in jsonl.parse_lines(lines, 0).collect()}
    for i, line in enumerate(LINES):
        row = parsed.get(i)
        got = "blank" if row is None else "malformed" if row["_problem"] else "ok"
        assert got == python_verdict(line), line
    assert parsed[11]["note_title"] == "u" and parsed[17]["note_content"] == "😊" and parsed[3]["likes"] is None


def test_bad_rows_fail_or_go_aside(spark, tmp_path):
    good = dump({"note_title": "t", "note_content": "a"})
    path = write(tmp_path / "a.jsonl", [good, "{oops", dump({"note_title": "t"}), good, dump({"note_content": "a"})])
    with pytest.raises(ValueError, match=r"1 lines are not JSON objects.*first are 2"):
        jsonl.load_source(spark, path, 1)
    no_content = write(tmp_path / "b.jsonl", [dump({"note_title": "t"})])
    with pytest.raises(ValueError, match="note_content"):
        jsonl.load_source(spark, no_content, 1)
    aside = jsonl.load_source(spark, path, 1, mode="quarantine")
    assert jsonl.good_rows(aside).count() == 2
    assert sorted(row["source_line"] for row in jsonl.bad_rows(aside).collect()) == [2, 3, 5]
    assert jsonl.load_report(aside).first()["missing_required_rows"] == 2
    with pytest.raises(ValueError, match="mode"):
        jsonl.load_source(spark, path, 1, mode="skip")


def test_sample_never_sees_later_lines(spark, tmp_path):
    good = dump({"note_title": "t", "note_content": "a"})
    path = write(tmp_path / "a.jsonl", [good, "", good, "{oops"])
    assert jsonl.good_rows(jsonl.load_source(spark, path, 0, sample=2)).count() == 2
    with pytest.raises(ValueError):
        jsonl.load_source(spark, path, 0, sample=3)


def test_line_numbers_are_exact_across_file_blocks(spark, tmp_path):
    expected = {}
    for name, count in (("a.jsonl", 4000), ("b.jsonl", 2500)):
        lines = ["" if i % 7 == 0 else dump({"name": name, "line": i, "pad": "x" * (i % 50)}) for i in range(1, count + 1)]
        write(tmp_path / name, lines)
        expected |= {(name, i + 1): line for i, line in enumerate(lines)}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        rows = jsonl.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {(row["source_file"], row["source_line"]): row["value"] for row in rows} == expected


def test_counts_in_every_spelling(spark, tmp_path):
    spelled = {"10.0": (10, None), "1e3": (1000, None), '"1.2万"': (None, "1.2万"), "null": (None, None), "2.5": (None, "2.5"), "7": (7, None)}
    lines = [f'{{"note_title":"t","note_content":"c","likes":{value}}}' for value in spelled]
    parsed = jsonl.load_source(spark, write(tmp_path / "c.jsonl", lines), 0)
    found = [(row["likes"], row["likes_raw"]) for row in jsonl.good_rows(parsed).orderBy("source_line").collect()]
    assert found == list(spelled.values())
    report = jsonl.load_report(parsed).first()
    assert (report["unread_likes"], report["unread_comments"]) == (2, 0)


def test_a_deeply_nested_line_is_a_bad_line(spark, tmp_path):
    path = write(tmp_path / "d.jsonl", ["[" * 200_000, '{"note_title":"t","note_content":"c"}'])
    parsed = jsonl.load_source(spark, path, 0, mode="quarantine")
    assert (jsonl.bad_rows(parsed).count(), jsonl.good_rows(parsed).count()) == (1, 1)
