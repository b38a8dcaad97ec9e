"""Small documents with copies, near copies, shared passages and every odd case."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def texts(seed: int = 5, n: int = 40) -> list[str]:
    rnd = random.Random(seed)
    bank = ["".join(rnd.choice(["th", "en", "on", "re", "ción", "ß", "era"]) for _ in range(rnd.randint(1, 4))) for _ in range(400)]
    sentence = lambda k: " ".join(rnd.choice(bank) for _ in range(k)).capitalize() + "."
    shared, boiler = sentence(70), sentence(9)
    out = ["\n".join(sentence(rnd.randint(3, 30)) for _ in range(rnd.randint(1, 6))) for _ in range(n)]
    out += [out[0], out[0], out[1].replace(out[1].split(" ")[2], "Anders", 1)]
    out += [f"{sentence(12)}\n{shared}\n{sentence(5)}" for _ in range(3)] + [f"{sentence(8)}\n{boiler}" for _ in range(4)]
    near = sentence(60)
    for k in range(5):
        w = near.split(" ")
        w[7 * k] = "neu"
        out.append(" ".join(w))
    out += ["", "   \n \t", "kurz", "kurz", "er " * 300, sentence(2_500), "x" * 20_000, "😀 漢字 naïve İ 'S I'll <|endoftext|> 12"]
    return out


def documents(spark):
    rows = [(i, t, "en", "src0", len(t)) for i, t in enumerate(texts())]
    rows.append((len(rows), None, None, None, None))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def pairs() -> list[tuple[int, str | None]]:
    own = list(enumerate(texts()))
    return [*own, (len(own), None)]


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
