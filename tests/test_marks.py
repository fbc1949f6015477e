"""Text between marks and keywords: passed over as seldom as can be."""

from __future__ import annotations

from pyspark.sql import functions as F

from accountlake.functions import tree
from accountlake.functions.text import any_matches, needles, occurrences


def test_keywords_are_counted_in_bytes(spark):
    count = occurrences(F.col("t"), "ción")
    assert "octet_length" in str(count) and "char_length" not in str(count)
    rows = spark.createDataFrame([("ción acción cion é", 2), ("", 0), ("é" * 9, 0), (None, None)], "t string, n int")
    assert all(r.n == r.found for r in rows.select("n", count.alias("found")).collect())


MARKED = [
    ("a <b> bold </b>b", "a  **bold** b"), ("<b></b>x<i> </i>y", "xy"), ("<b><i> x </i></b>", " ***x*** "),
    ("<a href='u'> k </a>z <code> c</code>", " [k](u) z  `c`"), ("p <b>q\n</b>r <i>\ns</i>", "p **q**r *s*"), ("plain text", "plain text"),
]


def test_only_clusters_of_marks_are_settled(spark):
    """The copy between marks is passed over once, not once for every pattern."""
    assert str(tree._settled(F.col("t"))).startswith("Column<'array_join(transform(split(regexp_replace(t,")
    rows = spark.createDataFrame(MARKED, "t string, md string")
    assert {r.t: r.got for r in rows.select("t", tree.markdown(F.col("t")).alias("got")).collect()} == dict(MARKED)


NEEDLES = {
    r"/plans\b": ["/plans"], r"request[- ]a[- ]demo": ["request"], r"\bwe.?re hiring\b": ["re hiring"], r"boards\.greenhouse\.io": ["greenhouse"],
    r"\bsoc ?2\b": ["soc"], r"und [a-z]+ die": ["und "], r"https?://(?:www|m)\.": [], r"a|b": [], r"\x41bc": [], r"(?i)abc": [], r"ab{2}c": [],
    r"ab*c": [], r"[a[bc]]def": [], r"\b(series [a-e]|gartner)\b": ["series ", "gartner"], r"\b(new(?:ly)? launched|x)\b": [], r"\b(a?|xy)\b": [],
    r"^abc": [], r"ab\nc": [], r"\d+": [], r"a+bc??d": ["b"],
}


def test_patterns_wait_for_their_words(spark):
    assert {p: needles(p) for p in NEEDLES} == NEEDLES
    texts = [("see /plans now",), ("/plansx soc2 series f",), ("we\u2019re hiring; und klein die",), ("soc 2, series b",), ("aabd gartner",), ("",), (None,)]
    rows = spark.createDataFrame(texts, "t string")
    for p in NEEDLES:
        plain = F.col("t").rlike(f"(?U){p}" if "\\" in p else p)
        assert rows.where(~any_matches(F.col("t"), [p]).eqNullSafe(F.lit(False) | plain)).count() == 0, p
