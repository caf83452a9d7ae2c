import random

import pytest

#: Columns whose names the operators use inside, beside those they are given.
CLASHING = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, bucket bigint, shard int, slot bigint, digest string, spans string, key bigint, n bigint, u bigint, w string, weight bigint, total bigint, turn int, row int, rank int, _n int, _spans int, _source int, _cell int, mix_slot int, items int, n_words int"


def corpus(seed: int, n: int = 60) -> list[tuple]:
    """(doc_id, text) with copies, near copies, shared lines and passages, nulls, empties, and a repeated row."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range(40)] + ["The", "of", "a", "émile", "Ünder"]
    line = lambda low, high: " ".join(r.choices(words, k=r.randint(low, high)))
    shared = [line(12, 20) for _ in range(3)]
    passage = line(60, 70)
    texts: list[str | None] = [None, "", " \t\n", "a", "a b", "\n\n"]
    while len(texts) < n:
        x = r.random()
        olds = [t for t in texts if t and len(t) > 100]
        if x < 0.1 and olds:
            texts.append(r.choice(olds))
        elif x < 0.3 and olds:
            t = r.choice(olds).split(" ")
            t[r.randrange(len(t))] = "changed"
            texts.append(" ".join(t))
        elif x < 0.4:
            texts.append(f"{line(3, 9)} {passage} {line(3, 9)}")
        else:
            texts.append("\n".join(r.choice(shared) if r.random() < 0.3 else line(4, 25) for _ in range(r.randint(1, 6))))
    texts.append(line(5, 9) + " " + " ".join(r.choices(words, k=20_000)))
    rows = list(enumerate(texts))
    r.shuffle(rows)
    return [*rows, rows[3]]


@pytest.fixture(scope="session")
def texts():
    return corpus(1)


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or ""), i, 1, 2, 3, "d", "s", 4, 5, 6, "w", *range(12)) for i, t in texts]
    return spark.createDataFrame(rows, CLASHING).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], CLASHING)


@pytest.fixture(scope="session")
def unnamed(spark):
    """Rows without a doc_id, and nulls in every column."""
    return spark.createDataFrame([(None, "one two three " * 30, *[None] * 25), (None, None, *[None] * 25), (5, None, *[None] * 25)], CLASHING)
