import pytest

SAMPLE = "the quick brown fox jumps over the lazy dog again and again until the morning comes at last"


def odd_rows():
    """(doc_id, text, lang, source, n_chars) with nulls in each column, empty and long texts, ties, repeated rows and odd characters."""
    long = " ".join(f"word{i % 97} Étude{i % 31}, it's {i}" for i in range(9000))
    texts = [
        SAMPLE, SAMPLE, "", None, " ", "\n\n", "a", long, long + " more", SAMPLE.upper(), "one two three four five " * 9, "x" * 5000,
        "Σίσυφος İstanbul ǅ 数字 ١٢٣ ² 🙂🙂 \x00\x01 é ﬁ", "a\x1cb c\x1f d\u0085e\xa0f​g", "<|endoftext|>foo <|startoftext|><|ENDOFTEXT|> it's They'LL",
        "  lead  and   runs \n of\n\n\nspace \t here  ", "line # one\nline # one\n\n \nline # one\nother $ line", "mail the.72@mail3.example.com or +1 (504) 555-2652 " + SAMPLE,
    ]
    rows = [(i, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[0], rows[7], (None, SAMPLE, None, None, None), (None, None, None, None, None), (-5, SAMPLE + " yes", "fr", None, 3), (2**62, SAMPLE, "de", "https://www.Example.org/x", 3)]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    """Odd rows with extra columns whose names clash with those that operators make."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, kept int, `id` string, host int, h int, _text string, _id int"
    return spark.createDataFrame([r + ("x", 1, None, 2, 3, "y", 4) for r in odd_rows()], schema).repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
