import os.path
import random
import re

from pyspark.sql import functions as F

from caseloom.functions import text as t
from caseloom.operators.seam import fill_template

SPACES = "\t\n\x0b\x0c\r\x1c\x1f \x85\xa0    　"


def column(spark, values, expression, schema="v string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")
    return [r.o for r in frame.select("i", expression.alias("o")).orderBy("i").collect()]


def test_strip_equals_python(spark):
    values = ["", "a", SPACES + "a b" + SPACES, SPACES, "​a​", "a\n", " " * 50_000 + "x" + " " * 50_000 + "y "]
    assert column(spark, values, t.strip_text(F.col("v"))) == [v.strip() for v in values]


def test_strip_html(spark):
    values = ["<p>a</p>\n<br/>b &amp;", "no tags", "<", "a < b > c", "<script>var x;</script>"]
    assert column(spark, values, t.strip_html(F.col("v"))) == ["a \n b &amp;", "no tags", "<", "a   c", "var x;"]
    draw = random.Random(3)
    values = ["".join(draw.choice("<>ab \n") for _ in range(draw.randint(0, 30))) for _ in range(500)] + ["<" * 300_000, "<" * 300_000 + ">x"]
    assert column(spark, values, t.strip_html(F.col("v"))) == [re.sub("<[^>]+>", " ", v).strip() for v in values[:-2]] + ["<" * 300_000, "x"]
    assert column(spark, [None], t.strip_html(F.col("v"))) == [None]


def test_extension_equals_python(spark):
    names = ["a.PDF", "a.b.txt", ".bashrc", "..x", "..x.y", "a.", "noext", "...", "a..b", "x y.d e", ".a.b", "a\n.txt", ""]
    assert column(spark, names, t.extension(F.col("v"))) == [os.path.splitext(n)[1].lower() for n in names]
    assert column(spark, names, t.stem(F.col("v"))) == [os.path.splitext(n)[0] for n in names]


def test_safe_name(spark):
    values = ["../x/Pay slip (1).pdf", "___", None, "", "é à.txt", "a/b/", "_x_", "a\\b.txt"]
    assert column(spark, values, t.safe_name(F.col("v"), F.lit(2))) == [
        "Pay_slip__1_.pdf", "attachment_2", "attachment_2", "attachment_2", "é_à.txt", "attachment_2", "x", "a_b.txt"]


def test_strip_fence(spark):
    values = ["```md\n# T\nx\n```", "  ```\nx\n``` ", "x ```y```", "```\nx", "```only", "plain"]
    assert column(spark, values, t.strip_fence(F.col("v"))) == ["# T\nx", "x", "x ```y```", "x", "```only", "plain"]


def test_first_block(spark):
    schema = "v array<struct<type:string,text:string>>"
    rows = [[("thinking", "t"), ("text", "hi"), ("text", "no")], [("thinking", "t")], [], None]
    assert column(spark, rows, t.reply_text(F.col("v")), schema) == ["hi", None, None, None]


def test_formats_and_lookup(spark):
    assert column(spark, [1234567], t.thousands(F.col("v")), "v long") == ["1,234,567"]
    values = [18.0, 65.92365, 0.00012, 1234.5]
    assert column(spark, values, t.dollars(F.col("v")), "v double") == [f"${v:.4f}" for v in values]
    assert column(spark, [66.66666], t.percent(F.col("v")), "v double") == ["66.7%"]
    mapping = F.create_map(F.lit("a"), F.lit(1))
    assert column(spark, ["a", "b"], t.lookup(mapping, F.col("v"), F.lit(0))) == [1, 0]


def test_fill_template(spark):
    prompt = fill_template("Q: {v}\n{v} {other}{x}", v=F.col("v"), x=F.lit(3))
    assert column(spark, ["{x}", None], prompt) == ["Q: {x}\n{x} {other}3", "Q: \n {other}3"]


def test_quote_regex(spark):
    values = ["a.b", r"\E", r"x\Ey(", "$"]
    assert column(spark, values, F.regexp_replace(F.col("v"), t.quote_regex(F.col("v")), F.lit("!"))) == ["!"] * 4
