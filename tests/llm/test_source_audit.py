import random
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.llm import source_audit as S

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least=10, most=10):
    """The contract's rows, term by term."""
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = Counter(TERM.findall("".join(c.lower() if c.isascii() else c for c in text or "")))
        groups[lang or "", source or ""].update(found)
        docs[lang or ""].update(found.keys())
    out = []
    for lang in {k[0] for k in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        own = {s: c for (k, s), c in groups.items() if k == lang}

        def shares(count):
            total = sum(count[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (count[t] + 2) // total for t in kept}

        p = {s: shares(c) for s, c in own.items()}
        whole = shares(sum(own.values(), Counter()))
        for s in own:
            far = [(sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept), o) for o in own if o != s]
            used = [((p[s][t] - whole[t]) ** 2 // (p[s][t] + whole[t]), t) for t in kept if own[s][t] and p[s][t] > whole[t]]
            for part, values, limit in (("pair", far, None), ("term", used, most)):
                ranked = sorted(values, key=lambda x: (-x[0], x[1].encode()))[:limit]
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def result(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


def corpus(seed, n=260, sources=9):
    rng = random.Random(seed)
    vocabulary = [rng.choice(["Wort", "mot", "é", "日本", "x", "Ab"]) + "".join(rng.choice("abcdé") for _ in range(rng.randint(0, 3))) for _ in range(90)]
    rows = []
    for _ in range(n):
        s = rng.randrange(sources)
        words = rng.choices(vocabulary, [1 / (1 + (k * (s + 2)) % 90) for k in range(90)], k=rng.randint(0, 60))
        rows.append((rng.choice([" ", "-", "\n", "9"]).join(words), rng.choice(["en", "de"]), f"s{s}"))
    return rows + [(None, "fr", "only"), ("rare word", None, None), ("rare word", None, "b"), ("", "en", "empty"), ("THE the " * 3000, "de", "s1"), (None, None, None)]


@pytest.mark.parametrize(("terms", "least", "groups", "tile"), [(4096, 128, 64, 2048), (8, 2, 2, 5), (16, 4, 4, 64)])
def test_audit_is_brute_forces(spark, monkeypatch, terms, least, groups, tile):
    for name, value in (("BLOCK_TERMS", terms), ("LEAST_TERMS", least), ("BLOCK_GROUPS", groups), ("TILE", tile)):
        monkeypatch.setattr(S, name, value)
    rows = corpus(terms)
    df = spark.createDataFrame([(*r, "own", 7) for r in rows], "text string, lang string, source string, term string, count int")
    assert result(S.audit(df)) == brute(rows)


def test_tables_without_terms(spark):
    schema = "text string, lang string, source string"
    rows = [(None, "a", "x"), ("one", "a", "y"), ("one", "a", None), ("12", "b", "x")]
    df = spark.createDataFrame(rows, schema)
    assert result(S.audit(df)) == brute(rows) and len(brute(rows)) == 6
    assert S.audit(df.limit(0)).collect() == []


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(0, 4 * 10**9), min_size=1, max_size=6), st.integers(1, 10**15))
def test_shares_are_exact(spark, counts, more):
    total = sum(counts) + 2 * len(counts) + more
    df = spark.createDataFrame([(c, total) for c in counts], "count long, total long")
    assert [r[0] for r in df.select(S.share("count", "total")).collect()] == [1 + 10**9 * (c + 2) // total for c in counts]
