from quire.functions.numbers import round_half_even


def test_rounding_is_that_of_the_exact_double(spark):
    values = [p / q for q in (1, 3, 8, 16, 40, 80, 160, 200, 400, 800, 1000, 2000) for p in range(q + 1)] + [5.25, 5.35, 100.05]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (1, 2, 3, 4):
        made = df.select("x", round_half_even(df["x"], digits).alias("r")).collect()
        assert [r.r for r in made] == [round(r.x, digits) for r in made]
