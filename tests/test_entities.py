"""Character references against the standard library."""

import html
import random
from html.entities import html5

from pyspark.sql import functions as F

from nearby_engine.functions.text import clean_excerpt, plain_text, unescape_entities


def _texts():
    dice = random.Random(3)
    names = sorted(html5)
    yield from ("", "no reference", "&", "&&", "& &;", "a & b", "&amp;amp;", "&lt;b&gt;", "x&nbsp;y", "&notit;", "&notin;", "&not", "&ampx", "&AMP", "&unknown;", "&unknownlongname_that_is_longer_than_thirty_two;", "&#;", "&#x;", "&#xg;", "&#65", "&#65;", "&#x41;", "&#X1F600;", "&#0;", "&#13;", "&#128;", "&#x9f;", "&#x81;", "&#xD800;", "&#1114112;", "&#99999999999999999999;", "&#x0000000000041;", "&#11;", "&#1;", "&#xFDD0;", "&#x1FFFE;", "&#127;", "&#38;lt;", "a?x=1&copy=2&y=3&region=4&lang=5", "&#12a;", "&#x41g", "é&eacute;", "&NotEqualTilde;", "&\t;", "&gt", "&g", "&gtr", "\n&quot;\n")
    for code in (*range(0, 200), 0xFFFD, 0xFFFE, 0xFFFF, 0x10FFFF, 0x110000, *(dice.randrange(0x110000) for _ in range(100))):
        yield f"a&#{code};b&#x{code:x}"
    for _ in range(400):
        yield "".join(dice.choice(["&" + dice.choice(names), "&" + dice.choice(names).rstrip(";") + dice.choice(["", "x", "1", " "]), "word", " ", "&", ";", "#"]) for _ in range(dice.randint(1, 6)))


def test_references_are_decoded_as_the_library_does(spark):
    texts = sorted(set(_texts()))
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    for r in df.select("t", unescape_entities(F.col("t")).alias("got")).collect():
        assert r.got == (None if r.t is None else html.unescape(r.t)), (r.t, r.got)


def test_no_python_in_the_plans(spark):
    df = spark.createDataFrame([("<p>a &amp; b</p>",)], "t string").select(clean_excerpt(F.col("t")).alias("a"), plain_text(F.col("t")).alias("b"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    assert tuple(df.first()) == ("a & b", "a & b")
