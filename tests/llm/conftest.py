import pytest

ODD_TEXTS = [
    None,
    "",
    " ",
    "\n\n\t",
    "word",
    "It's can't we'll 12 345 don't  double   spaces  nbsp  em\r\nlines  ",
    "日本語のテキスト と English mixed कुछ हिंदी",
    "emoji 😀😀 é é ﬁ \u0000 nul",
    "x" * 5000,
    "a b " * 4000,
    "4111 1111 1111 1111 and bob@example.com, 10.0.0.1 +1 (555) 123-4567",
    "same text twice over here for ties",
    "same text twice over here for ties",
    "iban GB82 WEST 1234 5698 7654 32 bank, ssn social 123-45-6789",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts with nulls in every column, a repeated row, and columns whose names clash with outputs."""
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else "s", None if t is None else len(t), "clash", 1.5) for i, t in enumerate(ODD_TEXTS)]
    rows.append(rows[5])
    rows.append((None, "a row without an id", "en", None, 3, "clash", None))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, shard string, score double")


@pytest.fixture(scope="session")
def none(spark, odd):
    return spark.createDataFrame([], odd.schema)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def collected(df):
    return [r.asDict() for r in df.collect()]
