import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, topic string, prob double, score string, node int, a int, bucket string, line_no string, word string, piece string"


def words(rng, n, parts):
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


EN, DE = ["the", "ing", "tion", "wh", "ea", "and"], ["sch", "ung", "keit", "ü", "ver", "ß"]


def corpus(seed=5):
    """Documents with nulls, empty and long texts, exact and near copies, repeated rows and ties."""
    rng = random.Random(seed)
    out = []
    for i in range(40):
        parts, lang = (EN, "en") if i % 2 else (DE, "de")
        lines = [words(rng, rng.randint(3, 30), parts) for _ in range(rng.randint(1, 6))]
        out.append((i, "\n".join(lines), lang, f"src{i % 3}"))
    base = words(rng, 120, EN).split()
    for k in range(12):  # near copies at several distances
        copy = list(base)
        for j in range(k):
            copy[(7 * k + 11 * j) % 120] = f"x{k}y{j}"
        out.append((100 + k, " ".join(copy), "en", "src0"))
    out += [(200, out[3][1], "en", "src1"), (201, out[3][1], "en", None), (202, out[3][1].upper(), "en", "src1")]
    out += [(300, None, "en", "src1"), (301, "", "de", "src2"), (302, " \n\t\n ", None, None), (303, "123 456 !!", "de", "src0"), (304, "word", "en", "src0"), (305, "a b c d", "en", "src0"), (306, "a b c d", "en", "src0")]
    out += [(400, words(rng, 6000, EN), "en", "src0"), (401, "x" * 5000, "en", "src0"), (402, "é" * 300 + "\n" + "漢字 " * 50, None, "src9")]
    out += [(500, "twice the same row in here", "en", "src2")] * 2 + [(None, "a null id has this text", "en", "src2"), (None, None, None, None)]
    return out


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, lang, src, None if t is None else len(t), "t", 0.5, "s", 1, 2, "b", "n", "w", "p") for i, t, lang, src in corpus()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
