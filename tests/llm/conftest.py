import random

import pytest

WORDS = "the of and to in is was for on with as by at an be this that from are it alpha beta gamma delta".split()


def thue_morse(n: int = 1024) -> tuple[str, str]:
    """A word of a and b and its complement: polynomial hashes modulo a power of two can't tell them apart."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


def sentence(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) * (r.random() < 0.6) for _ in range(n))


@pytest.fixture(scope="session")
def rows() -> list[tuple]:
    """(doc_id, text): copies, near copies, shared passages and lines, hostile texts, a null id and a repeated row."""
    r = random.Random(5)
    out: list[tuple] = []
    passage = sentence(r, 70)
    lines = ["Subscribe NOW \t", "  subscribe now", "common line"]
    for i in range(60):
        body = [sentence(r, r.randrange(3, 60)) for _ in range(r.randrange(1, 6))]
        if i % 5 == 0:
            body.insert(r.randrange(len(body) + 1), passage)
        if i % 3 == 0:
            body.insert(0, r.choice(lines))
        out.append((i, "\n".join(body)))
    big = sentence(r, 220)
    for i in range(60, 80):
        w = big.split()
        for _ in range(i % 4):
            w[r.randrange(len(w))] = f"edit{r.randrange(99)}"
        out.append((i, " ".join(w)))
    out += [(i, big) for i in range(80, 86)]
    out += [(90, None), (91, ""), (92, " \n\t\n "), (93, "one"), (94, "ONE"), (95, "x" * 5000), (96, "ab " * 3000), (97, "é" * 300 + "\n漢字 ▁ 🙂\x00 <|x|>"), (98, sentence(r, 9000)), (None, "null id " + passage), (99, "twice told\n" + passage), (99, "twice told\n" + passage), (None, None)]
    same, other = thue_morse()
    out += [(100 + i, same) for i in range(9)] + [(110, other), (111, f"{same} {other}\n{same}\n{other}")]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with extra columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "en", 1, 2, "k", "t") for i, t in rows], "doc_id long, text string, lang string, row long, n long, id string, kept string").repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
