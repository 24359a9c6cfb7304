"""Documents with every odd case, for the tests of all corpus operators."""

import random


def odd_documents(n=60, seed=3):
    rng = random.Random(seed)
    parts = ["the", "Thing", "é", "ÜBER", "Straße", ",", ".", " ", "  ", "\n", "\n\n", "\t", "\x0b", "\x1c", "\xa0", "'s", "12", "🙂", "中文", "É", "Σ", "İ", "<|endoftext|>", "<s>", "▁", "\x00", "#$", "aé "]
    docs = [(i, "".join(rng.choices(parts, k=rng.choice([0, 1, 3, 20, 200])))) for i in range(n)]
    words = ["tion", "Eror,", "heat.", "naïve", "l'été", "x" * 40, "can't", "###", "a"]
    docs += [(n + i, " ".join(rng.choices(words, k=rng.choice([5, 80, 900])))) for i in range(20)]
    docs += [(n + 20 + i, docs[n + i % 4][1]) for i in range(12)]
    docs += [(1000, None), (1001, ""), (1002, " "), (1003, "\n"), (1004, "a" * 300_000), (1005, "ab cd, " * 40_000), (1006, "tion"), (1006, "tion")]
    return docs


def frame(spark, docs=None):
    """With columns whose names clash with the operators' own."""
    docs = odd_documents() if docs is None else docs
    rows = [(i, t, "zz", 5, 6, 7.0, "r") for i, t in docs]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, size int, start int, shard double, fp string").repartition(3)
