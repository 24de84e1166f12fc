"""Lines are matched once, with the groups that the pattern gives."""

from pyspark.sql import functions as F

from quadlake.sources import nquads

ODD = [
    "<a:s> <a:p> <a:o> <a:g> .", "_:x <a:p> _:y _:g .", "_:x <a:p> _:y_:g .", '<a:s> <a:p> "x"@en-GB <a:g> . # end',
    '<a:s> <a:p> "1"^^<a:dt> .', '<a:s> <a:p> "tab\there $1 \\\\ \\n \\" \\u00e9" <a:g> .', "\t<a:s><a:p><a:o>.", "<a:s> <a:p> <a:o> <a:g> .\n",
    "<a:s> <a:p> <a:o> <a:g> .\r\n", "<a:s> <a:p> <a:o> <a:g> .\u0085", "\n<a:s> <a:p> <a:o> <a:g> .", "\n\n\n\n\n\n\n\n\n\n\n\n", "\n", "", "# note",
    "<a:s> <a:p> <a:o>", "<a:s> <a:p> <a:o> <a:g> .\n<a:s> <a:p> <a:o> <a:g> .", '"lit" <a:p> <a:o> .', "x\ny", "\x0b", None, "  ", '<a:s> <a:p> "" .',
]


def test_groups_are_those_of_the_pattern(spark):
    lines = spark.createDataFrame(list(enumerate(ODD)), "n int, line string")
    got = {r.n: r for r in nquads._matched(lines).collect()}
    parts = [F.regexp_extract("line", nquads._LINE, i + 1) for i in range(len(nquads._GROUPS))]
    plain = lines.where(~F.col("line").rlike(nquads._IGNORED)).select("n", F.col("line").rlike(nquads._LINE).alias("ok"), F.array(*parts).alias("m"))
    rows = plain.collect()
    assert set(got) == {r.n for r in rows} and sum(r.ok for r in rows) == 11
    for r in rows:
        assert got[r.n].ok == r.ok, ODD[r.n]
        if r.ok:
            assert got[r.n].m[1:1 + len(nquads._GROUPS)] == r.m, ODD[r.n]


def test_a_line_is_matched_once(spark):
    lines = spark.createDataFrame([(x,) for x in ODD], "line string")
    for found in (nquads.parse_lines(lines), nquads.rejected_lines(lines)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(nquads._IRIREF) <= 5  # five IRIs in one pattern
