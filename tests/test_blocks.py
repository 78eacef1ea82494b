"""Files of entries: the parser, its refusals, round trips, splits, and the catalogue's and speakers' fields."""

import glob

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kalendry.sources import blocks, catalogue, speakers

SPEAKERS = """# comment
- id: ada
  name: "Ada \\"A\\" L\\u00f6we"
  imageUrl: /ada.jpeg
  presentations:
    - topic: "One: two"   # said so
      event: |
        Long
          event
      eventType: conference
      year: 2025
      link: https://a.org/x?y=1#z
    - {topic: flow, event: [no], eventType: summit, year: 2024}

- id: bo
  name: Bo,
    son of
    O'Bo
  imageUrl:
    - /b.jpeg
    - '/b''2.jpeg'
  presentations: []
- id: cy
  name: >-
    Cy
    the

    third
"""


def test_speakers(spark, tmp_path):
    (tmp_path / "s.txt").write_text(SPEAKERS)
    got = speakers.from_files(spark, [str(tmp_path / "s.txt")]).orderBy("ord").collect()
    assert [(r.id, r.name, r.image_urls) for r in got] == [("ada", 'Ada "A" Löwe', ["/ada.jpeg"]), ("bo", "Bo, son of O'Bo", ["/b.jpeg", "/b'2.jpeg"]), ("cy", "Cy the\nthird", None)]
    one, two = got[0].presentations
    assert tuple(one) == ("One: two", "Long\n  event\n", "conference", "https://a.org/x?y=1#z", 2025) and (two.topic, two.link, two.year) == ("flow", None, 2024)
    assert got[1].presentations == [] and got[2].presentations is None
    speakers.write(speakers.from_files(spark, [str(tmp_path / "s.txt")]), str(tmp_path / "out"))
    again = speakers.from_files(spark, sorted(glob.glob(str(tmp_path / "out" / "part-*")))).orderBy("ord").collect()
    assert [r[1:4] for r in again] == [r[1:4] for r in got] and again[0].presentations[0] == one


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("a: 1\nb: 1.5\nc: true\nd: ~\ne: 007\nf: '1'", {"a": 1, "b": 1.5, "c": True, "d": None, "e": "007", "f": "1"}),
        ("a: |\n  x\n   y\n\n  z\n\nb: 1", {"a": "x\n y\n\nz\n", "b": 1}), ("a: |-\n  x\n", {"a": "x"}), ("a: >\n  x\n  y\n\n  z\n", {"a": "x y\nz\n"}),
        ("a:\n- 1\n- b: 2\n  c: 3\n- - 4\n  - 5", {"a": [1, {"b": 2, "c": 3}, [4, 5]]}), ("a: [x, 'y, z', {k: v}]", {"a": ["x", "y, z", {"k": "v"}]}),
        ('a: "x\\ty\\\\ \\x41"', {"a": "x\ty\\ A"}), ("a: b#c # d\n\n# e\nf: g", {"a": "b#c", "f": "g"}), ("a: one\n  two\n\n  three\nb:", {"a": "one two\nthree", "b": None}),
        ("'k: 1': v\nb c: d:e", {"k: 1": "v", "b c": "d:e"}), ("a: [1,\n  2]", {"a": [1, 2]}),
    ],
)
def test_parse(text, value):
    assert blocks.parse(text) == value and blocks.parse(blocks.dump(value)) == value


@pytest.mark.parametrize(
    ("text", "line"),
    [("a: b: c", 1), ("a: 1\na: 2", 2), ("x: 1\na: 'y", 2), ("a: [x", 1), ("\ta: 1", 1), ("a: 1\nb: &x 1", 2), ("a: 'x' y", 1), ("a: 1\nwords", 2), ("a: !t x", 1)],
)
def test_refusals_name_the_line(text, line):
    with pytest.raises(blocks.BlockError) as e:
        blocks.parse(text)
    assert str(e.value).startswith(f"line {line}: ")


words = st.text(st.characters(codec="utf-8", exclude_characters="\r"), max_size=12)
values = st.recursive(st.none() | st.booleans() | st.integers(-(10**12), 10**12) | words, lambda v: st.lists(v, max_size=4) | st.dictionaries(words, v, max_size=4), max_leaves=12)


@settings(max_examples=400, deadline=None)
@given(st.dictionaries(words, values, min_size=1, max_size=4))
def test_any_value_comes_back(value):
    text = blocks.dump(value)
    assert blocks.parse(text) == value
    assert blocks.dump(blocks.parse(text)) == text


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "c.txt").write_text("".join(f"- title: T{i}\n  id: t{i:05d}\n  note: |\n    a\n    - b\n\n" for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = catalogue.read(spark, [str(tmp_path / "c.txt")])
        assert rows.rdd.getNumPartitions() > 3
        got = rows.orderBy("ord").select("id", "note").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.id for r in got] == [f"t{i:05d}" for i in range(3000)] and {r.note for r in got} == {"a\n- b\n"}


def test_a_malformed_entry_fails_with_its_place(spark, tmp_path):
    (tmp_path / "c.txt").write_text("- id: a\n  title: x\n- id: b\n  title: y: z\n")
    with pytest.raises(Exception, match=r"(?s)c\.txt.*id: b.*line 2: a colon"):
        blocks.parsed(blocks.entries(spark, [str(tmp_path / "c.txt")])).select(F.to_json("entry")).collect()


@pytest.mark.parametrize("text", ['"plain"', '"a: b # c"', '"two\n  lines"', r'"tab\t"', '"é"', "'it''s'", '"" # note', "x # note", "x#y", "a:b", '"x"  ', "'q' #"])
def test_short_ways_read_as_the_long_ones(text):
    want = {'"plain"': "plain", '"a: b # c"': "a: b # c", '"two\n  lines"': "two lines", r'"tab\t"': "tab\t", '"é"': "é", "'it''s'": "it's", '"" # note': "", "x # note": "x", "x#y": "x#y", "a:b": "a:b", '"x"  ': "x", "'q' #": "q"}[text]
    assert blocks.parse(f"k: {text}") == {"k": want}
    assert blocks.parse(blocks.dump({"k": want})) == {"k": want}
