"""Small tables that hold the awkward cases: nulls, empties, copies, ties, long texts, columns of clashing names."""

import random

WORDS = "the of and to in is that it was for on are as with his they at be this from have or by one had not but what all were when we there can an your which".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ing"]) for _ in range(n)) + "."


def edited(text: str, seed: int, share: float) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in text.split(" "))


def documents(spark, extra: bool = True):
    base = [prose(i, 40 + 13 * i) for i in range(12)]
    texts = [
        *base,
        base[0],
        base[0],
        edited(base[3], 1, 0.02),
        edited(base[3], 2, 0.02),
        None,
        "",
        " \t\n\x0b ",
        "one",
        "one two three",
        "One TWO three FOUR",
        "Ünïcödé 你好 🙂 <|endoftext|> ½²" + " x",
        "!!! ??? 123",
        prose(99, 30_000),
        "x" * 50_000,
        "Released under the MIT License. " + base[1],
        "word " * 400,
    ]
    rows = [(i, t, ["en", "fr", None][i % 3], ["b", "a", None, "src"][i % 4], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, base[2], "en", "a", 3), (None, None, None, None, None), (7, "another text of an id that is there already", "en", "a", 1)]
    columns = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    if extra:
        names = ["key", "print", "size", "score", "range", "a", "label", "row", "bucket"]
        columns += "".join(f", {n} string" for n in names)
        rows = [(*r, *names) for r in rows]
    return spark.createDataFrame(rows, columns)


def rows_of(df):
    return [tuple(r) for r in df.collect()]
