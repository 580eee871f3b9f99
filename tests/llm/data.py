"""Small awkward inputs and a union-find for brute force."""

from collections import defaultdict

LONG = " ".join(f"word{i % 997} and{i % 13}" for i in range(60_000))
COPY = "the quick brown fox jumps over the lazy dog near the old river bank while seven owls watch from tall trees tonight"
DOCS = [
    (0, "", "en", "a"), (1, None, "en", "a"), (2, "one", "en", None), (3, LONG, "en", "b"),
    (4, COPY, "en", "a"), (5, COPY, None, "a"), (5, COPY, None, "a"), (6, COPY.replace("fox", "cat"), "en", "b"),
    (7, "Éçole ÜBER straße\n\n日本語 текст\tend", "fr", "b"), (8, "  \n \t ", "en", "c"),
    (9, COPY + "\n" + COPY.upper() + "!\nA line of its own here", "en", "c"), (None, COPY, "en", "c"), (None, None, None, None),
    (10, "the the the", "en", "é"),
]
# names that operators also use for columns of their own
EXTRA = ("size", "fp", "score", "key", "hot", "n", "root", "_word")


def documents(spark, rows=None):
    rows = DOCS if rows is None else rows
    names = ", ".join(f"{c} string" for c in EXTRA)
    return spark.createDataFrame([(*r, len(r[1] or ""), *("x",) * len(EXTRA)) for r in rows],
                                 f"doc_id long, text string, lang string, source string, n_chars long, {names}")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


class Groups:
    """Union-find that names a set by its smallest member."""

    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)

    def sets(self):
        out = defaultdict(set)
        for x in self.up:
            out[self.find(x)].add(x)
        return list(out.values())
