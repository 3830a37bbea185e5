"""Tables with awkward rows, and plain reimplementations to compare with."""

import re

SMALL = "/root/testdata/sf0.001"
#: doc_id, text, lang, source, n_chars, and columns whose names clash with those inside the operators
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, rep long, uid long, source_ string, key string, _digest string, _first long, score double, tokens string"
WORDS = [f"w{i}" for i in range(400)]


def row(i, text, source="a", lang="en"):
    return (i, text, lang, source, None, "x", 1, 2, "y", "z", "q", 3, 0.5, "t")


def awkward():
    base = " ".join(WORDS[:100])
    near = base.replace("w50 ", "v50 ")
    return [
        row(1, base), row(2, base.replace(" ", "\n\t")), row(3, near), row(4, None), row(5, ""), row(6, "  \n "), row(7, "one"), row(8, "ONE"), row(9, "two words"),
        row(10, base), row(10, base), row(11, " ".join(WORDS[100:300])), row(None, base), row(None, None, None, None), row(12, "word " * 30_000), row(13, "x" * 70_000, None),
        row(14, " ".join(WORDS[300:]) + " naïve ÀÉ <|endoftext|> 123 'll \x1c z\r\n\r\n  a"), row(15, "日本語 テキスト 🙂🙂"), row(16, near.upper()), row(17, " ".join(WORDS[100:299])),
    ]


def awkward_docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA)


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def shingles(text, k):
    w = words("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(rows, k, percent):
    """{doc_id: smallest doc_id reachable} of (doc_id, text); rows without doc_id are left out."""
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}
