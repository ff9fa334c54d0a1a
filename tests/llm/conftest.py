import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, score string, w int, t string, hit int"


def fixture_rows() -> list[tuple]:
    """Nulls, empty and blank texts, repeated rows, near copies, a long text, shared passages, personal data."""
    base = " ".join(f"word{i} alpha" for i in range(60))
    near = base.replace("word7 ", "changed ")
    shared = "This exact passage of a good many words stands in several documents and " * 4
    benchmark = "the quick brown fox jumps over the lazy dog while seven wizards watch quietly"
    rows = [
        (1, base, "en", "a"),
        (2, base, "en", "a"),
        (2, base, "en", "a"),
        (3, near, "en", "b"),
        (4, "", "en", "b"),
        (5, None, None, None),
        (6, " \n\t ", "de", "c"),
        (7, "two words", "de", "c"),
        (8, "Two  words", "de", "c"),
        (9, f"Start here\n{shared}\nand some end", "en", "a"),
        (10, f"Another start\n{shared}\nother end", "fr", "a"),
        (11, f"prefix {benchmark} suffix", "en", "a"),
        (12, "filler " * 400 + benchmark.upper() + " tail", "en", "a"),
        (13, "mail a.b@c.example.org or +1 (212) 555-0100, card 4111 1111 1111 1111, ip 10.0.0.255 and 999.1.1.1", "en", "a"),
        (14, "4111111111111111 4012888888881881 next", "en", "b"),
        (15, "é ü ß 漢字   tab\there\x00nul", "fr", "c"),
        (None, "no id at all", "en", "a"),
        (17, "#$%& *** ||| <> " * 30, "en", "b"),
        (18, "same line here again and again\n" * 40, "en", "b"),
        (19, "x" * 50_000, "en", "a"),
        (20, " ".join(f"long{i % 977}" for i in range(20_000)), "en", "a"),
        (21, "ab " * 500, "en", None),
    ]
    return [(i, t, lang, src, len(t or ""), "clash", "clash", 1, "clash", 2) for i, t, lang, src in rows]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(fixture_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def benchmark(spark):
    rows = [(1, "The quick brown fox jumps over the lazy dog while seven wizards watch quietly"), (10, "lazy dog"), (2, None), (3, "!!"), (4, "not in any document at all, ever, anywhere in this whole corpus of text")]
    return spark.createDataFrame(rows, "item_id long, text string")
