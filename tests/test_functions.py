from pyspark.sql import functions as F

from fernglass.functions import findings as V
from fernglass.functions import text as T


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def test_squeeze_and_specific(spark):
    assert one(spark, T.squeeze(F.col("a")), a=" x\r\n\ty  z ") == "x y z"
    assert one(spark, T.squeeze(F.col("a")), a=None) == ""
    assert one(spark, T.specific(F.col("a")), a="too short") == ""
    assert one(spark, T.specific(F.col("a")), a="Four Words That Are Quite Long Enough") == "four words that are quite long enough"


def test_fingerprint_ignores_blanks(spark):
    c = F.col
    fp = T.fingerprint(c("r"), c("a"), c("f"), c("code"), c("d"))
    base = dict(r="r1", a="a1", f="x.py", code="a  =\n1", d="text")
    same = one(spark, fp, **base)
    assert len(same) == 16
    assert same == one(spark, fp, **{**base, "code": "a = 1", "d": "other"})
    assert same != one(spark, fp, **{**base, "code": " ", "d": "other"})


def test_token_estimate(spark):
    assert one(spark, T.token_estimate(F.col("a")), a="") == 0
    assert one(spark, T.token_estimate(F.col("a")), a="abcde") == 2
    assert one(spark, T.token_estimate(F.col("a")), a="x" * 72) == 20
    assert one(spark, T.line_count(F.col("a")), a="a\nb") == 2


def test_shingles_and_jaccard(spark):
    assert sorted(one(spark, T.shingles(F.col("a")), a="Abcd, xy")) == ["abc", "bcd", "xy"]
    assert one(spark, T.jaccard(T.shingles(F.col("a")), T.shingles(F.col("b"))), a="abcd", b="abce") == 1 / 3
    assert one(spark, T.jaccard(T.shingles(F.col("a")), T.shingles(F.col("b"))), a="", b="abc") == 0


def test_paths(spark):
    assert one(spark, T.language_of(F.col("a")), a="x/y.TSX") == "typescript"
    assert one(spark, T.language_of(F.col("a")), a="README") == "text"
    assert one(spark, T.is_test_path(F.col("a")), a="src/tests/a.py") is True
    assert one(spark, T.is_test_path(F.col("a")), a="tests/a.py") is False  # a slash has to stand before
    assert one(spark, T.is_entry_path(F.col("a")), a="cmd/main.go") is True
    assert one(spark, T.last_segment(F.col("a")), a="a.b::c->d(x.y)") == "d"
    assert one(spark, T.infra_kind(F.col("a"), F.lit("apiVersion: v1\nkind: Pod")), a="k/x.yaml") == "kubernetes"
    assert one(spark, T.one_line(F.col("a"), 3), a="ab\ncd") == "ab ..."


def test_ranks_and_groups(spark):
    assert one(spark, V.severity_rank(F.col("a")), a=" High ") == 4
    assert one(spark, V.severity_rank(F.col("a")), a="odd") == 0
    df = spark.createDataFrame([("f", 1, 2, None, "a b", "")], "file string, start_line int, end_line int, trace array<struct<file:string,line:int,kind:string,code:string,note:string>>, code string, d string")
    basis, sig = V.group_key(F.col("trace"), F.col("code"), F.col("d"))
    assert tuple(df.select(basis, sig).first()) == ("code_sample", "ab")
    df2 = spark.createDataFrame([("f", 1, 2, [("f", 1, "Source", "q(x)", None), ("f", 3, "sink", "run (y)", None)], "", "")], df.schema)
    assert tuple(df2.select(basis, sig).first()) == ("trace", "source:q(x)|sink:run(y)")
