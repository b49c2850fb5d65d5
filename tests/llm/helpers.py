"""Small tables with every awkward case, and plain Python models of the operators."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

DDL = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = "The quick fox reads %d long pages of calm prose about rivers, hills and roads while evening light slowly fades over town number %d."


def docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] is not None else None) for r in rows]
    return spark.createDataFrame(full, DDL)


AWKWARD = [
    (1, None, None), (2, "", "a"), (3, " \t\n ", "a"), (4, "x", "b"), (5, PLAIN % (5, 5), "b"), (5, PLAIN % (5, 5), "b"), (6, PLAIN % (5, 5), None), (None, PLAIN % (7, 7), "a"),
    (None, None, None), (8, "wörd ñ 𝒳 " * 40, "ß"), (9, ("long text of many words here " * 3000) + "end", "a"), (10, "z" * 50_000, "b"), (11, "a\r\nb\x0bc\x0cd e f g h i j k", "b"),
]


def clash(df):
    """df with extra columns whose names an operator might want."""
    from pyspark.sql import functions as F

    names = ["id", "n", "fp", "key", "size", "target", "copies", "shard", "shard_h", "mix_rate", "mix_source", "rule_text_key", "leak_text", "join_other", "pii", "pii_raw", "licence", "score", "rid", "a", "b", "component"]
    return df.withColumns({c: F.lit(1) for c in names})


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingle_set(text, width):
    w = words(lower(text))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def components(rows, width, percent):
    """{doc_id: (n_shingles, component)} by comparing all pairs that share a shingle."""
    sets = {i: shingle_set(t, width) for i, t in rows}
    holders, up = defaultdict(list), {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in sets.items():
        shared = Counter(j for x in s for j in holders[x])
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                up[b] = a
        for x in s:
            holders[x].append(i)
    return {i: (len(s), root(i)) for i, s in sets.items()}
