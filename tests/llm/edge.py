"""Small tables that hold every awkward case at once."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, spans string, kept string, component string, `n` string"


def prose(seed: int, n: int, end: int = 9) -> str:
    r = random.Random(seed)
    out = [r.choice(WORDS) + str(r.randrange(400)) for _ in range(n)]
    return " ".join(w + ("." if i % end == end - 1 else "") for i, w in enumerate(out))


def rows() -> list[tuple]:
    shared = prose(1, 80)
    texts = [
        (1, shared),
        (2, prose(2, 60) + "\n" + shared),
        (3, ""),
        (4, None),
        (5, prose(3, 40)),
        (5, prose(4, 40)),  # shares its doc_id
        (6, prose(5, 30)),
        (6, prose(5, 30)),  # repeats in full
        (None, prose(6, 30)),
        (None, shared),
        (7, " \t\r\n  "),
        (8, "one two"),
        (9, "ONE\ttwo"),
        (10, "été 中文 🙂 " * 60),
        (11, prose(7, 6000)),
        (12, "a" * 5000),
        (13, shared.upper()),
        (14, "same line of ten words that is said again here.\n" * 3),
    ]
    return [(i, t, None if k % 5 == 0 else "en", None if k % 7 == 0 else "s", None if t is None else len(t), 0.5, "x", None, "c", "n") for k, (i, t) in enumerate(texts)]


#: Names that internal ones may clash with, or that need quoting.
AWKWARD = ["a.b", "a`b", "a b", "__llm_row", "__llm_spans", "__llm_document", "block", "held_out"]


def _more(df):
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(7).alias(c) for c in AWKWARD])


def docs(spark):
    return _more(spark.createDataFrame(rows(), DOCS))


def none(spark):
    return _more(spark.createDataFrame([], DOCS))


def by_text(rows_, key="doc_id"):
    return sorted(rows_, key=lambda r: (r[key] is None, r[key] or 0))
