import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vectors, weights
from tessera.functions.porter import stem_word


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_log_tf_and_idf(spark):
    rows = spark.createDataFrame([(0,), (1,), (2,), (10,), (1000,), (-3,)], "tf int").select(weights.log_tf(F.col("tf")).alias("x")).collect()
    assert [r["x"] for r in rows] == pytest.approx([0, 1, 1.301, 2, 4, 0], abs=0.01)
    rows = spark.createDataFrame([(1,), (100,), (10**6,), (0,)], "df long").select(weights.idf(F.col("df"), F.lit(10**6)).alias("x")).collect()
    assert [r["x"] for r in rows] == pytest.approx([6, 4, 0, 0])


def test_tokens(spark):
    for text, want in [("Test123 with numbers456.", ["test", "with", "numbers"]), ("don't", ["don", "t"]), ("", []), ("Élan  vital—x", ["élan", "vital—x"])]:
        assert one(spark, T.tokens(F.lit(text))) == want
    assert one(spark, T.tokens(F.lit(None).cast("string"))) == []


def test_paragraphs(spark):
    long = "a paragraph that is long enough"
    assert one(spark, T.paragraphs(F.lit(f"{long}\n\n  {long} 2\n\nshort\n\n{long} 3"))) == [long, f"{long} 2", f"{long} 3"]
    assert one(spark, T.paragraphs(F.lit("one line"))) == ["one line"]
    assert one(spark, T.paragraphs(F.lit("short\n\nbrief"))) == ["short"]
    assert one(spark, T.paragraphs(F.lit(""))) == [""]
    rows = T.chunks(spark.createDataFrame([("s", f"{long}\n\n{long}")], "stem string, text string"), "stem", "text").collect()
    assert [r["doc_id"] for r in rows] == ["s#chunk000", "s#chunk001"]


@pytest.mark.parametrize(
    ("word", "stem"),
    [("beautiful", "beauti"), ("powerful", "power"), ("dance", "danc"), ("caresses", "caress"), ("ponies", "poni"), ("ties", "ti"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"),
     ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"),
     ("relational", "relat"), ("conditional", "condit"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("electrical", "electr"), ("hopefulness", "hope"), ("revival", "reviv"),
     ("adjustment", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("cease", "ceas"), ("controll", "control"), ("roll", "roll")],
)
def test_porter(word, stem):
    assert stem_word(word) == stem


def test_names(spark):
    assert one(spark, T.safe_stem(F.lit("  AC/DC: Back in Black! "))) == "AC_DC_Back_in_Black"
    assert one(spark, T.first_given(F.lit(None).cast("string"), F.lit("  "), F.lit(" x "))) == "x"
    assert one(spark, vectors.codeword("a", F.lit(7))) == "a_0007"


def test_descriptions(spark):
    row = {"productDisplayName": F.lit("Shirt"), "gender": F.lit("Men"), "masterCategory": F.lit("Apparel"), "subCategory": F.lit("Topwear"), "articleType": F.lit("Shirts"), "baseColour": F.lit("Blue"), "usage": F.lit(""), "season": F.lit("Fall")}
    assert one(spark, T.product_description(row)) == "Shirt. Gender: Men. Category: Apparel / Topwear. Article type: Shirts. Color: Blue. Season: Fall"
    assert one(spark, T.product_description({"name": F.lit("X")})) == "X. Gender:. Category:  / "
    assert one(spark, T.short_description(F.lit(" X "), F.lit("A"), F.lit(None).cast("string"))) == "X. Category: A. Subcategory:"


def test_dense_vectors(spark):
    a, b = F.array(*(F.lit(x) for x in (1.0, 2.0, 3.0))), F.array(*(F.lit(x) for x in (4.0, 0.0, 0.0)))
    zero = F.array(*(F.lit(0.0) for _ in range(3)))
    assert one(spark, vectors.minkowski(a, b, 1)) == 8
    assert one(spark, vectors.euclidean(a, b)) == pytest.approx(22**0.5)
    assert one(spark, vectors.minkowski(a, b, float("inf"))) == 3
    assert one(spark, vectors.cosine(a, zero)) == 0 and one(spark, vectors.normalized(zero)) == [0, 0, 0]
    hist = F.create_map(F.lit("b"), F.lit(3), F.lit("d"), F.lit(4), F.lit("z"), F.lit(9))
    assert one(spark, vectors.hist_to_dense(hist, ["a", "b", "d"])) == pytest.approx([0, 0.6, 0.8])
    assert one(spark, vectors.hist_to_dense(hist, ["a", "b"], normalize=False)) == [0, 3]


def test_dense_vectors_of_blocks_of_maps(spark, monkeypatch):
    """Maps are laid into matrices, whatever the block: null and empty maps are zero, and no map is searched for each key."""
    monkeypatch.setattr(vectors, "DENSE_ROWS", 2)
    rows = [(0, {"a": 3, "c": 4}), (1, None), (2, {}), (3, {"z": 5}), (4, {"b": 2, "a": None})]
    df = spark.createDataFrame(rows, "i int, hist map<string,int>").coalesce(1)
    made = df.select("i", vectors.hist_to_dense(F.col("hist"), ["a", "b", "c"]).alias("v"))
    assert "element_at" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert {r["i"]: r["v"] for r in made.collect()} == {0: [0.6, 0.0, 0.8], 1: [0.0] * 3, 2: [0.0] * 3, 3: [0.0] * 3, 4: [0.0, 1.0, 0.0]}
