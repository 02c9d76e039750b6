"""Documents with the cases that every operator must stand: nulls, empty and long texts, ties, repeats, clashing column names."""

import random

WORDS = "the of and to in that quiet river stone paper window garden under yellow winter silver market bridge".split()


def words(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def rows() -> list[tuple]:
    base = words(300, 1)
    near = base.split()
    near[150] = "changed"
    return [
        (1, None, "en", "a", 0, 1),
        (2, "", "en", None, 0, 2),
        (3, base, None, "a", None, 3),
        (4, base, "en", "a", 1, 4),
        (5, " ".join(near), "en", "b", 1, 5),
        (6, words(20_000, 2), "en", "b", 1, 6),
        (7, "one  two\n\n three \t four", "en", "b", 1, 7),
        (8, "   \n ", "en", "b", 1, 8),
        (9, "word", "en", "b", 1, 9),
        (9, "word", "en", "b", 1, 9),
        (None, words(80, 3), "en", "b", 1, 10),
        (11, "été ß 日本 \U0001f600 don't " * 30, "fr", "b", 1, 11),
        (12, "<|endoftext|> mid <|startoftext|> İΣς", "fr", "b", 1, 12),
        (13, "same line here\n" * 40, "fr", "b", 1, 13),
    ]


#: Further columns have names that operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long"


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
