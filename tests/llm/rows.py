"""Small tables with every awkward row: nulls, blanks, long texts, copies, repeated ids, clashing extra columns."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYLLABLES = {"en": "the and ing er th on re tion ed".split(), "de": "der sch ung keit ein ge ver lich".split(), "es": "ción mente que os ar do la el".split()}


def words(rng: random.Random, n: int, lang: str = "en") -> str:
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def awkward(seed: int = 1, n: int = 60) -> list[tuple]:
    """(doc_id, text, lang, source): doc_id may be null or repeated."""
    rng = random.Random(seed)
    rows = [(i, words(rng, rng.randint(1, 120), lang := rng.choice(["en", "de", "es"])), lang, f"host{i % 3}") for i in range(n)]
    long = words(rng, 4000)
    rows += [(n, None, "en", "host0"), (n + 1, "", None, None), (n + 2, " \n\t ", "de", "host1"), (n + 3, long, "en", "host1"), (n + 4, long, "en", None)]
    rows += [(n + 5, "x" * 3000, None, "host2"), (n + 6, rows[0][1], "en", "host2"), (n + 6, rows[0][1], "en", "host2"), (None, rows[1][1], "en", "host0"), (None, None, None, None)]
    base = rows[2][1].split() * 3
    for k in range(6):  # near copies
        changed = list(base)
        changed[7 * k % len(changed)] = "changed"
        rows.append((n + 10 + k, " ".join(changed), "en", "host1"))
    return rows


SCHEMA = "doc_id long, text string, lang string, source string"


def frame(spark, rows, clash=()):
    """The rows, with clashing extra columns of another type."""
    df = spark.createDataFrame(rows, SCHEMA)
    for name in clash:
        df = df.selectExpr("*", f"'own' AS `{name}`")
    return df
