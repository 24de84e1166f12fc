import json

from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadlake.functions.lexical import compare_class, compare_key, is_valid
from quadlake.functions.terms import headers_map, key_hash, unescape
from quadlake.quads import QUAD, QUAD_SCHEMA
from quadlake.sources import nquads
from quadlake.vocab import LANG_STRING, XSD, XSD_STRING

TEXT = st.text(st.characters(exclude_categories=["Cs"], exclude_characters="\x00"), max_size=12)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(TEXT, min_size=20, max_size=40))
def test_round_trip(spark, texts):
    data = []
    for i, t in enumerate(texts):
        dt, lang = [(XSD_STRING, ""), (XSD + "token", ""), (LANG_STRING, "en-gb")][i % 3]
        data.append((f"urn:g:{i % 2}", f"urn:s:{i}", "iri", "urn:p" + t.strip(), t, "literal", dt, lang))
    df = spark.createDataFrame(data, QUAD_SCHEMA)
    lines = nquads.format_lines(df)
    assert rows(nquads.parse_lines(lines), *QUAD) == sorted(data, key=repr)
    assert nquads.rejected_lines(lines).count() == 0


def test_very_long_literal(spark):
    text = 'a\\"b\n' * 200_000
    df = spark.createDataFrame([("urn:g", "urn:s", "iri", "urn:p", text, "literal", XSD_STRING, "")], QUAD_SCHEMA)
    assert nquads.parse_lines(nquads.format_lines(df)).first().o == text


def test_unescape(spark):
    df = spark.createDataFrame([(r"A\U0001F600\t\\u0041\"\'",)], "t string")
    assert df.select(unescape(F.col("t"))).first()[0] == "A\U0001F600\t\\u0041\"'"


def test_lines_and_rejects(spark):
    lines = spark.createDataFrame([(x,) for x in (
        '<a:s> <a:p> <a:o> <a:g> .', '_:b <a:p> "x"@EN-gb <a:g> . # note', '<a:s> <a:p> "1"^^<a:int> .',
        '# only a note', '', '   ', '<a:s> <a:p> "open <a:g> .', '"lit" <a:p> <a:o> <a:g> .', 'junk',
        '<a:s> <a:p> "" <a:g>.', r'<a:s> <a:p> "bad \x" <a:g> .')], "line string")
    got = rows(nquads.parse_lines(lines), "s", "s_kind", "o", "o_kind", "o_dt", "o_lang")
    assert got == sorted([("a:s", "iri", "a:o", "iri", "", ""), ("b", "bnode", "x", "literal", LANG_STRING, "en-gb"),
                          ("a:s", "iri", "", "literal", XSD_STRING, "")], key=repr)
    assert nquads.rejected_lines(lines).count() == 5
    assert nquads.parse_lines(lines, "a:default").count() == 4
    assert nquads.rejected_lines(lines, "a:default").count() == 4


def test_blank_nodes_of_two_files_stay_apart(spark, tmp_path):
    for name in ("one.nt", "two.nt"):
        (tmp_path / name).write_text("_:x <a:p> _:x .\n_:x <a:p> <a:o> .\n_:x <a:p> <a:o> .\nbad\n")
    got = nquads.read_nquads(spark, str(tmp_path), "a:g").collect()
    assert len(got) == 4 and len({r.s for r in got}) == 2
    assert all(r.s == r.o for r in got if r.o_kind == "bnode")
    assert nquads.read_rejects(spark, str(tmp_path), "a:g").count() == 2


def test_headers(spark):
    texts = ['{"a":"b"}', '{"a":1}', '{"a":null}', '[1]', 'bad{', '{}', None]
    df = spark.createDataFrame([(t,) for t in texts], "h string")
    got = [r[0] for r in df.select(headers_map(F.col("h"))).collect()]
    assert got == [json.loads(texts[0]), None, None, None, None, {}, None]


def test_key_hash_tells_null_from_empty(spark):
    df = spark.createDataFrame([(None, "a"), ("", "a"), ("a", None), ("a", "")], "x string, y string")
    assert df.select(key_hash("x", "y").alias("h")).distinct().count() == 4


def test_validity(spark):
    cases = [
        ("1", "integer", True), ("+01", "integer", True), ("1.0", "integer", False), ("", "integer", False),
        ("1.", "decimal", True), (".", "decimal", False), ("1e3", "double", True), ("INF", "double", True),
        ("x", "double", False), ("true", "boolean", True), ("TRUE", "boolean", False),
        ("2024-02-29", "date", True), ("2023-02-29", "date", False), ("2024-02-29Z", "date", True),
        ("2024-01-01T00:00:00+01:00", "dateTime", True), ("2024-01-01", "dateTime", False),
        ("127", "byte", True), ("128", "byte", False), ("-1", "nonNegativeInteger", False),
        ("9" * 60, "nonNegativeInteger", True), ("9" * 60, "long", False), ("-" + "9" * 60, "negativeInteger", True),
        ("P1DT2H", "duration", True), ("P", "duration", False), ("anything", "unknown", True),
    ]
    df = spark.createDataFrame([(t, XSD + d, ok) for t, d, ok in cases], "t string, d string, ok boolean")
    assert rows(df.where(is_valid(F.col("t"), F.col("d")) != F.col("ok"))) == []


def test_comparison(spark):
    order = [("-INF", "double"), ("-1e300", "double"), ("-5", "integer"), ("0", "integer"), ("1e-15", "double"),
             ("2e-15", "double"), ("0.5", "decimal"), ("9007199254740992", "integer"),
             ("9007199254740993", "integer"), ("1e300", "double"), ("INF", "double")]
    df = spark.createDataFrame([(i, t, XSD + d) for i, (t, d) in enumerate(order)], "i int, t string, d string")
    keyed = df.withColumn("k", compare_key(F.col("t"), F.col("d")))
    assert [r.i for r in keyed.orderBy("k").collect()] == list(range(len(order)))
    kinds = spark.createDataFrame([("NaN", "double"), ("x", "integer"), ("1", "token"), ("a", "string"),
                                   ("2024-01-01", "date"), ("no", "dateTime")], "t string, d string")
    got = [r[0] for r in kinds.select(compare_class(
        F.col("t"), F.lit("literal"), F.concat(F.lit(XSD), "d"))).collect()]
    assert got == [None, None, None, "string", "date", None]


def test_lexical_spaces(spark):
    from pyspark.sql import functions as F

    from quadlake.functions.lexical import compare_key, is_valid
    from quadlake.vocab import XSD
    cases = [("dateTime", "12024-02-29T00:00:00", True), ("dateTime", "2023-02-29T00:00:00", False),
             ("dateTime", "2024-01-01T24:00:00", True), ("dateTime", "2024-01-01T24:00:01", False),
             ("date", "1900-02-29", False), ("date", "2000-02-29", True), ("date", "2024-04-31", False),
             ("dateTimeStamp", "zz", False), ("dateTimeStamp", "2024-01-01T00:00:00", False),
             ("dateTimeStamp", "2024-01-01T00:00:00Z", True), ("dayTimeDuration", "P1DT2H", True),
             ("dayTimeDuration", "P1Y", False), ("yearMonthDuration", "P1Y2M", True), ("yearMonthDuration", "P1D", False),
             ("gMonth", "--13", False), ("gMonth", "--12", True), ("gDay", "---32", False), ("gDay", "---31", True),
             ("gMonthDay", "--02-30", False), ("gMonthDay", "--02-29", True), ("base64Binary", "YQ==", True),
             ("base64Binary", "YR==", False), ("base64Binary", "YWJj", True), ("base64Binary", "YW", False), ("base64Binary", "", True)]
    df = spark.createDataFrame([(XSD + k, t, w) for k, t, w in cases], "dt string, text string, want boolean")
    wrong = df.where(is_valid(F.col("text"), F.col("dt")) != F.col("want")).collect()
    assert wrong == []
    numbers = ["-" + "9" * 31, "-" + "9" * 30, "-" + "1" * 30, "-5", "0", "7", "1" * 30, "1" * 29 + "2", "9" * 30, "1" + "0" * 30]
    df = spark.createDataFrame([(k, t, XSD + "integer") for k, t in enumerate(numbers)], "k int, text string, dt string")
    assert [r.k for r in df.orderBy(compare_key(F.col("text"), F.col("dt"))).collect()] == list(range(len(numbers)))
