import random

import pytest
from mossgraph.functions import frontmatter as fm
from mossgraph.functions import markdown, text
from mossgraph.functions.tokenizers import wordpiece
from mossgraph.model import InvalidRequest, document_id, relation
from mossgraph.operators import graph
from pyspark.sql import functions as F


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "raw, term",
    [("abc", "s3:abc"), ("12", "n:12"), ("-0", "n:0"), ("1e3", "n:1000.0"), ("12.30", "n:12.3"), ("1e10", "n:1.0E10"), ("0.0001", "n:1.0E-4"), ("0042", "s4:0042"), ("+42", "s3:+42"), ("1_000", "s5:1_000"), (".5", "s2:.5"), ("0x1F", "s4:0x1F"), ("true", "b:true"), ("True", "s4:True"), ('"12"', "s2:12"), ("'true'", "s4:true"), ("a😀b", "s4:a😀b"), ("99999999999999999999", "n:99999999999999999999"), (".inf", "n:.inf")],
)
def test_filter_literals(spark, raw, term):
    assert fm.term(fm.literal(raw)) == term
    assert one(spark, fm.literal_term_column(F.lit(raw))) == term


@pytest.mark.parametrize("raw", ["", '"open', "open'", '"'])
def test_bad_literals(spark, raw):
    with pytest.raises(InvalidRequest):
        fm.literal(raw)
    assert one(spark, fm.literal_term_column(F.lit(raw))) is None


def test_terms_of_collections():
    assert fm.terms_of(["a", fm.Number("1")]) == ["l2:s1:an:1", "s1:a", "n:1"]
    assert fm.term({"k": True}) == "m1:1:kb:true"


def test_contract_keys_are_no_filters():
    with pytest.raises(InvalidRequest):
        fm.fm_filter(F.lit(None), {"tags": "x"})


def test_yaml():
    values, error = fm.parse_yaml("title: A\ndate: 2024-02-01\nn: 007\nm: 12.50\nb: yes\nc: true\nl: [1, null, x]\ne:\nnested: {a: {b: 2}}\n")
    assert error is None
    assert values == {"title": "A", "date": "2024-02-01", "n": "007", "m": "12.5", "b": "yes", "c": True, "l": ["1", "x"], "nested": {"a": {"b": "2"}}}
    assert isinstance(values["m"], fm.Number) and not isinstance(values["n"], fm.Number)
    for bad in ("a: 1\na: 2", "- x", "a: &x [*x]", "a: [" * 30 + "]" * 30, 'a: "\\x07"'):
        assert fm.parse_yaml(bad)[1]
    assert fm.parse_yaml("") == ({}, None)


def test_render_round_trip():
    values = {"status": "open", "title": "Some: title", "tags": ["a", "true"], "n": fm.Number("12"), "deep": {"x": ["1", fm.Number("1")]}}
    block = fm.render_yaml(values)
    assert block.startswith("title: ")
    assert fm.parse_yaml(block) == (values, None)
    assert fm.render_document({}, "body", "raw: kept  ") == "---\nraw: kept  \n---\nbody"
    assert fm.from_json(fm.to_json(values)) == values
    with pytest.raises(InvalidRequest):
        fm.from_json('{"tags": "x"}')


def test_markdown():
    note = "---\ntitle: T\nauthor: Ann\ntags: [x]\nrepo: r/1\nz: 1\n---\n# One #\n[[a|A]] ![[b/c.md#^h]] [[#self]] [[[no]]] [[x[y]]]\n```\n# no\n[[no]]\n```\n## Two\n[[ d ]]"
    p = markdown.parse(note)
    assert (p["title"], p["author"], p["tags"], p["error"]) == ("T", "Ann", ["x"], None)
    assert [(h["level"], h["text"]) for h in p["headings"]] == [(1, "One"), (2, "Two")]
    assert [(x["target"], x["label"], x["anchor"], x["embed"]) for x in p["links"]] == [("a", "A", None, False), ("b/c.md", None, "h", True), ("d", None, None, False)]
    assert p["fm_terms"] == ["repo=s3:r/1", "z=n:1"] and p["refs"] == [{"ordinal": 0, "rel": "references", "target": "r/1"}]
    assert markdown.parse("---\nopen")["body"] == "---\nopen"
    assert markdown.parse("---\na: 1\na: 2\n---\nx")["raw_frontmatter"] == "a: 1\na: 2"
    assert markdown.parse(None)["body"] == ""
    assert markdown.rewrite(note, lambda t: "new" if t == "d" else None) == note.replace("[[ d ]]", "[[ new ]]")


def test_columns(spark):
    assert one(spark, text.link_form(F.lit(" ./././/a/B.MD "))) == "a/B"
    assert one(spark, text.suffixes(F.lit("a/b/c"))) == ["a/b/c", "b/c", "c"]
    assert one(spark, text.terms(F.lit("Héllo 漢字x_1"))) == ["héllo", "漢", "字", "x", "1"]
    assert one(spark, text.utf16_length(F.lit("a😀b"))) == 4
    assert one(spark, text.daily_note(F.lit("notes/daily/2024-02-30.md"))) is None
    assert one(spark, text.from_cursor(text.cursor(F.lit("a/ü?>")))) == "a/ü?>"
    props = {"a=b": "c&d", "x\\": ""}
    assert one(spark, text.decode_props(text.encode_props(F.create_map(*(F.lit(y) for kv in props.items() for y in kv))))) == props
    assert one(spark, text.indexable(F.lit("a.canvas"), F.lit("broken"))) == "broken"
    assert one(spark, text.indexable(F.lit("a.png"), F.lit("x"))) is None
    assert one(spark, text.sanitized(F.lit(" a  b/ c .MD"))) == "a b/c"
    assert one(spark, text.has_control(F.lit("a\x07"))) and not one(spark, text.has_control(F.lit("a\n")))
    long = "x" * 100 + " word " + "y" * 200
    piece = text.snippet(F.lit(long), F.lit(102))
    assert one(spark, piece) == long[61:261]
    assert [tuple(h) for h in one(spark, text.highlights(piece, F.lit(long), ["word"]))] == [(40, 44)]
    assert one(spark, text.highlights(F.lit("word"), F.lit("word"), ["word"])) == []
    assert one(spark, text.expand(F.lit("{{a}} {{b}}"), {"a": F.lit("1")})) == "1 {{b}}"
    assert (one(spark, text.file_kind(F.lit("a.PNG"))), one(spark, text.media_type(F.lit("a.zip")))) == ("image", "application/octet-stream")


def test_wordpiece():
    vocabulary = {w: i for i, w in enumerate(["[UNK]", "[CLS]", "[SEP]", "un", "##aff", "##able", "!", "a"])}
    assert wordpiece("Unaffable! zz a", vocabulary) == [1, 3, 4, 5, 6, 0, 7, 2]
    assert wordpiece("a a a a", vocabulary, limit=4) == [1, 7, 7, 2]


def test_ids():
    assert document_id("a/b c") == "a/b c"
    for bad in ("", " a", "a/", "a//b", "../a", "a.MD", "a\\b", "a\x01"):
        with pytest.raises(InvalidRequest):
            document_id(bad)
    assert relation("embed") == "embeds"
    with pytest.raises(InvalidRequest):
        relation("likes")


def test_plain_blocks_are_read_as_yaml_reads_them():
    r = random.Random(5)
    words = ["a", "0", "-1", "1.50", "1e3", "null", "~", "true", "No", "a.b/c-d", "x_y", "", " ", "b ", "#", "a #b", "a: b", "2024-01-01", "[", "]", "a,b", "é", "'q'", '"q"', "- a", "0042", "N"]
    plain = 0
    for _ in range(4000):
        value = lambda: r.choice([" ", "  "]).join(r.choice(words) for _ in range(r.choice([1, 1, 1, 2])))
        line = lambda: f"{r.choice(['a', 'b', 'c', 'true', '_d', '1', 'e-f'])}:{r.choice([' ', ' ', ' ', '  ', ''])}{r.choice([value(), '[' + ', '.join(value() for _ in range(r.randrange(3))) + ']'])}"
        block = "\n".join(line() for _ in range(r.randrange(1, 4)))
        if (made := fm._of_lines(block)) is not None:
            plain += 1
            values, error = fm._by_yaml(block)
            assert error is None and values == made and [type(x) for x in fm.leaves(values)] == [type(x) for x in fm.leaves(made)], block
    assert plain > 100


def test_columns_of_notes_equal_single_ones(spark):
    r = random.Random(6)
    parts = ["---\n", "a: 1\n", "title: [x, y]\n", "author: me\n", "files: [f, g]\n", "repo: z\n", "# h #\n", "```\n", " ~~~\n", "[[a|b]] ![[c#d]]\n", "[[[x]] [[y]\n", "text\r\n", "", "é [[ü]]\n"]
    notes = [None, ""] + ["".join(r.choice(parts) for _ in range(r.randrange(9))) for _ in range(600)] + ["---\n" + "".join(r.choice(parts[1:6]) for _ in range(3)) + "---\n[[k]]\n" for _ in range(100)]
    df = spark.createDataFrame(list(enumerate(notes)), "n int, content string").coalesce(1)
    got = df.select("n", markdown.parsed(F.col("content")).alias("p")).orderBy("n").collect()
    assert [x.p.asDict(True) for x in got] == [markdown.parse(c) for c in notes]
    some = df.select("n", markdown.parsed(F.col("content"), ["refs", "links"]).alias("p")).orderBy("n").collect()
    assert [x.p.asDict(True) for x in some] == [{f: markdown.parse(c)[f] for f in ("refs", "links")} for c in notes]
    assert df.limit(0).select(markdown.parsed(F.col("content"), ["links"])).collect() == []


def test_notes_are_parsed_once(spark):
    notes = spark.createDataFrame([("a", "[[b]] [[c]]")], "id string, content string").select("id", markdown.parsed(F.col("content"), ["links"]).alias("p")).select("id", "p.*")
    made = graph.references(notes)
    assert made._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted(x[:] for x in made.collect()) == [("a", "b"), ("a", "c")]


def test_targets_are_those_of_links_each_once(spark):
    r = random.Random(8)
    parts = ["[[", "]]", "[", "]", "a", "./b.md", "|l", "#t", " ", "!", "\n", "```\n", "[[c]]", "[[c|x]]"]
    notes = [None, "", "[[a]] [[a|b]] [[ ]] [[#x]] [[c#d]]", "[[a[b]][[c]] [[d]]", "[[[a]]] [[b]]"] + ["".join(r.choice(parts) for _ in range(r.randrange(16))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(notes)), "id int, content string").coalesce(1).select("id", markdown.parsed(F.col("content"), ["targets"]).alias("p")).select("id", "p.*")
    expected = [list(dict.fromkeys(x["target"] for x in markdown.parse(c)["links"])) for c in notes]
    assert [x.targets for x in df.orderBy("id").collect()] == expected
    refs = graph.references(df)
    assert refs._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted(x[:] for x in refs.collect()) == sorted((i, t) for i, targets in enumerate(expected) for t in targets)


def test_link_forms(spark):
    targets = ["a", " a ", "/a", "//a", "./a", "././/a.md", "a.MD", "a.md.md", "a.md/b", ".md", "", "a. ", "/", "a/./b", None]
    got = spark.createDataFrame(list(enumerate(targets)), "n int, t string").select("n", text.link_form(F.col("t")).alias("f")).orderBy("n").collect()
    assert [x.f for x in got] == [None if t is None else markdown.normal_form(t) for t in targets]
