"""Small tables with the awkward cases: nulls anywhere, empty and long texts, ties, repeated rows, clashing column names."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, label string, part int, key string, n bigint"


def documents(spark, n=160, seed=3):
    rnd = random.Random(seed)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "rü", "tz", "Xe") for b in ("na", "ro", "s", "tu", "一", "")]
    make = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    passage, texts = make(80), []
    for k in range(n):
        kind = k % 8
        if kind == 0:
            texts.append(make(rnd.randint(1, 30)))
        elif kind == 1:
            texts.append(make(20) + "\n" + passage + "\t" + make(20))
        elif kind == 2 and texts:
            texts.append(rnd.choice(texts).upper() if k % 3 else rnd.choice(texts))
        elif kind == 3 and texts:
            near = rnd.choice(texts).split(" ")
            near[rnd.randrange(len(near))] = "changed"
            texts.append(" ".join(near))
        else:
            texts.append(make(rnd.randint(40, 120)))
    texts += ["", None, " \t\n", "x", "x", "a b", "ΑΒΓ İ ß", make(9000), "w " * 4000, "same line\nsame line\n\nsame line", "<a> & #1 | *b*", "  lead  and   trail  ", "😀 emoji 😀"]
    rows = [(k, t, rnd.choice(["en", "de", None]), rnd.choice(["web", "web", "web", "books", None]), len(t or ""), k, "l", 1, "k", 5) for k, t in enumerate(texts)]
    rows += [rows[3], rows[3]]  # rows that repeat
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def null_id(spark):
    return spark.createDataFrame([(None, "a text without an id, and long enough for a span of fifty bytes", None, None, None, None, None, None, None, None),
                                  (4, "a text without an id, and long enough for a span of fifty bytes", None, None, None, None, None, None, None, None)], SCHEMA)


def plain(df):
    return {(r["doc_id"], r["text"]) for r in df.collect()}
