"""Small tables with nulls, ties, repeats, clashing columns and planted repeats."""

import random

ROOT = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, row long, h long, size long, key string, node long"


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdeghilmnorstué") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def rows(seed: int = 1, plain: int = 25) -> list[tuple]:
    """Rows of SCHEMA: doc_id, text, lang, source and clashing extras."""
    rng = random.Random(seed)
    passage = " ".join(words(rng, 70))
    line = " ".join(words(rng, 12))
    base = words(rng, 150)
    texts: list[str | None] = [None, "", " \n\t ", "one", "one", "two words", "a b c d e", "ß漢字 é́ 😀", "x" * 3000, "ab " * 900]
    texts += [" ".join(words(rng, rng.randint(5, 120))) for _ in range(plain)]
    texts += [f"{' '.join(words(rng, 20))}\n{passage}\n{' '.join(words(rng, 30))}" for _ in range(4)]
    texts += [f"{line}\n{' '.join(words(rng, 40))}\n{line}" for _ in range(6)]
    texts += [" ".join(base)] * 3
    for _ in range(8):
        near = list(base)
        for _ in range(rng.randint(1, 6)):
            near[rng.randrange(len(near))] = "edit"
        texts.append(" ".join(near))
    texts.append("\n".join([" ".join(words(rng, 30_000)), passage]))
    out = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "S3", None]), 7, "x", 1, 2, 3, "k", 4) for i, t in enumerate(texts)]
    out.append(out[12])
    out.append((None, texts[14], "en", "s1", 7, "x", 1, 2, 3, "k", 4))
    return out


def frame(spark, data=None, parts: int = 3):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(parts)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
