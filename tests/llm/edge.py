"""Documents with everything that may be odd, and brute-force helpers."""

import random
import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, size int, predicted string, part int, row int, digest string, key string, n_words string"
EXTRA = (None, 7, "x", 3, 4, "d", "k", "w")
WORD = re.compile("[^\x20\x09-\x0d]+")


def sentence(seed: int, n: int, vocabulary: int = 400) -> str:
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}x" for _ in range(n))


def rows():
    base = sentence(1, 120)
    near = base.split(" ")
    near[60] = "changed"
    texts = [
        None, "", " \t\n ", "one", "one two three four", "One  two\tthree four", "two three four five six", base, base, base.upper(), base.replace(" ", "\n"), " ".join(near),
        " ".join(near[:-3]), sentence(2, 60), sentence(2, 60), "é ß 日本語 🙂 ÀÉ", "日本語", "12345 !!! 678", "<|endoftext|> don't STOP's <|turn|> x\\Qy", sentence(3, 30_000, 5000), "to " * 300, "a|b|c %% $$ ##\na|b|c %% $$ ##\n",
    ]
    out = [(i, t, ["en", "de", None][i % 3], ["b", "a", None, "c"][i % 4], len(t or ""), *EXTRA) for i, t in enumerate(texts)]
    return out + [out[7], (None, base, "en", "a", 1, *EXTRA), (None, "null id alone here", None, None, None, *EXTRA)]


def edge_docs(spark, n=None):
    return spark.createDataFrame(rows()[:n] if n is not None else rows(), SCHEMA).repartition(3)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def listed(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def squeezed(text):
    return re.sub("[\x20\x09-\x0d]", "", text or "")
