"""Rows with every awkward case: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, bin string, size long, n long, value string"
EN = "the cat and the dog were in the house with a red ball that they had found near the river".split()
DE = "der hund und die katze waren in dem haus mit einem roten ball den sie am fluss gefunden hatten".split()


def rows(seed=0, count=60):
    rnd = random.Random(seed)
    out = []
    for i in range(count):
        words = EN if i % 2 else DE
        text = " ".join(rnd.choice(words) + rnd.choice(["", "", "s", "t"]) for _ in range(rnd.randint(5, 80)))
        out.append((i, text, "en" if i % 2 else "de", f"src{i % 3}"))
    base = out[7][1]
    out += [(100 + k, base, "en", "src1") for k in range(6)]  # copies
    out += [(120 + k, base.replace(" ", "\t", k), "en", None) for k in range(1, 4)]  # copies but for white space
    out += [(130, None, None, None), (131, "", "en", "src0"), (132, " \n\t", "de", "src0"), (133, "12345 !!", "en", "src2"), (134, None, "de", "src9")]
    long = " ".join(rnd.choice(EN) + str(rnd.randint(0, 999)) for _ in range(20_000))
    out += [(140, long, "en", "src1"), (141, long + " more", "en", "src2"), (142, "x" * 70_000, "en", "src0")]
    out += [(150, "ein ﬁne Ǆ İstanbul ΣΑΣ naïve 𝒳 <|endoftext|> x", "de", "src1"), (150, "ein ﬁne Ǆ İstanbul ΣΑΣ naïve 𝒳 <|endoftext|> x", "de", "src1")]  # a repeated row
    words = [f"w{k}" for k in range(120)]
    for k in range(4):  # near copies in a chain
        words = [*words]
        words[10 + 25 * k] = f"edit{k}"
        out.append((160 + k, " ".join(words), "en", f"src{k}"))
    return out


def frame(spark, data=None):
    data = rows() if data is None else data
    full = [(*r, None if r[1] is None else len(r[1]), "k", "b", 5, 7, "v") for r in data]
    return spark.createDataFrame(full, SCHEMA).repartition(3)
