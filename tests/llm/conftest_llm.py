import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "size int, doc_id long, text string, h string, source string, lang string, n_chars long, label int"


def odd_rows():
    """Nulls in any column, empty and blank and long texts, ties, repeated rows."""
    words = ["alpha", "Beta", "gamma,", "délta", "eps%", "zeta", "eta", "theta", "iota", "kappa", "la", "mu", "nu", "xi"]
    base = " ".join(words[i * i % 14] + str(i % 5) for i in range(120))
    long = " ".join(f"w{i * 7919 % 30011}" for i in range(40_000))
    texts = {
        5: base, 9: base, 3: base.replace(" ", "\n\t "), 12: base + " tail end", 7: "", 8: None, 2: "  \t ", 4: "one", 6: "one two three",
        21: long, 22: "x " + long[:3000] + " y", 30: "Ünï cödé 日本語 テキスト <|endoftext|> it's 're-do' 42nd", 31: "a" * 5000, 32: "a" * 5000 + " b",
    }
    rows = [(1, k, t, "x", None if k % 4 == 0 else f"s{k % 3}", "en", None, 1) for k, t in texts.items()]
    rows += [rows[0], rows[0], (None, None, base, None, None, None, None, None), (None, None, None, None, None, None, None, None), (2, 40, "one", None, "s1", None, None, None), (2, 40, "other words", None, "s1", None, None, None)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def tuples(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)
