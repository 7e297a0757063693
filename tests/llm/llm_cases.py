"""Small tables with every awkward case, shared by the tests of the training-data operators."""

import random

# Extra columns carry names that the operators also give to columns of their own.
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, tokens int, weight double,"
    " size int, fp long, core string, block string, path string, kept string, `count` int"
)
EXTRA = ("x", 7, 0.5, 3, 9, "c", "b", "p", "no", 11)
WORDS = {
    "en": "the cat sat on a warm mat while rain fell over every quiet town and people walked home".split(),
    "fr": "le chat dort sur un tapis chaud pendant que la pluie tombe dans chaque ville où les gens rentrent".split(),
    "de": "die katze schläft auf einer warmen matte während regen über jede stille stadt fällt und leute gehen".split(),
}


def prose(seed, words, lang="en"):
    rnd = random.Random(f"{seed}{lang}")
    return " ".join(rnd.choice(WORDS[lang]) + rnd.choice(["", "s", "ly", "er"]) for _ in range(words))


def rows():
    """(doc_id, text, lang, source, n_chars, extras): nulls, empties, copies, ties, repeated rows, long texts."""
    long = prose("long", 6000)
    base = [
        (0, None, None, None), (1, "", "en", ""), (2, " \t\n", "en", "a"), (3, "?!", None, "a"),
        (4, prose(4, 120), "en", "a"), (5, prose(4, 120).replace(" ", "\n"), "en", "b"), (6, "  " + prose(4, 120), "en", "a"),
        (7, prose(7, 120, "fr"), "fr", "b"), (8, prose(7, 120, "fr"), None, None), (9, long, "en", "a"),
        (10, long + " tail", "en", "a"), (11, "a" * 3000, "en", "a"), (12, "a" * 2999, None, "c"),
        (13, "中文字𝒳 ▁▁ x", None, "c"), (13, "中文字𝒳 ▁▁ x", None, "c"), (14, prose(14, 90, "de"), "de", "c"),
        (None, prose(14, 90, "de"), "de", "c"), (None, None, "de", None), (16, prose(4, 120), "en", "a"), (16, "other words here", "en", "d"),
        (17, "mixed " + prose(4, 120)[6:], "en", "a"), (18, " \x00é" * 50, "fr", "b"), (-3, "negative id " + prose(3, 40), "en", "a"),
    ]
    base += [(100 + k, prose(100 + k, 30 + k, lang), lang, f"s{k % 3}") for k in range(24) for lang in [["en", "fr", "de"][k % 3]]]
    return [(i, t, lang, s, None if t is None else len(t), *EXTRA) for i, t, lang, s in base]


def frame(spark, made=None):
    return spark.createDataFrame(rows() if made is None else made, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def keyed(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
