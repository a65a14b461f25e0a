import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import common as helpers
from shelfmark.llm import language, language_model, order_minhash, quality, toxicity
from shelfmark.llm.common import buffer_of
from tests.llm.rows import WORD, awkward, frame, words

SMALL = "/root/testdata/sf0.001"


def test_language_of_clear_texts(spark):
    rng = random.Random(3)
    rows = [(i, words(rng, 60, lang), lang, None) for i in range(120) for lang in [["en", "de", "es"][i % 3]]]
    model = language.train(frame(spark, rows))
    assert sorted(model.content) == ["de", "en", "es"]
    tests = [(i, words(rng, 40, lang), lang, None) for i in range(60) for lang in [["en", "de", "es"][i % 3]]]
    tests += [(100, None, None, None), (101, "", None, None), (102, "12 !!", None, None), (103, "the and ing " * 9000, "en", None), (None, "der sch ung keit der ein", "de", None)]
    found = language.classify(frame(spark, tests, ["score", "block"]), model).collect()
    right = [r for r in found if r["lang"] and r["lang_pred"] == r["lang"]]
    assert len(right) >= 60 and len(found) == len(tests)
    assert {(r["lang_pred"], r["score"], r["rejected"]) for r in found if r["doc_id"] in (100, 101, 102)} == {("und", 0.0, True)}
    assert all(0 <= r["score"] <= 1 for r in found) and {r["block"] for r in found} == {"own"}


def test_language_without_rows(spark):
    model = language.train(frame(spark, [(1, None, "en", None), (2, "abc", None, None)]))
    assert model.content == {}
    assert [r["lang_pred"] for r in language.classify(frame(spark, [(1, "hello there", None, None)]), model).collect()] == ["und"]
    assert language.classify(frame(spark, []), model).collect() == []


def test_language_rich_in_copies(spark):
    """8,000 copies of one text beside 300 others: as many distinct texts are learnt as without the copies."""
    rng = random.Random(8)
    others = [(i, words(rng, 20, "es"), "es", None) for i in range(300)]
    copies = frame(spark, [(0, "el mismo texto", "es", None)]).crossJoin(spark.range(8000)).drop("id")
    model = language.train(frame(spark, others).unionByName(copies))
    learnt = set(model.content["es"].decode().split("\n"))
    assert len(learnt) == language.SAMPLE_TEXTS and learnt <= {language.letters(t) for _, t, _, _ in others} | {"el mismo texto"}


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    found = language.language_query(spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out")
    assert found.where("lang = lang_pred").count() > 0.95 * found.count()


def base_of(text):
    found = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(zip(*(found[i:] for i in range(5)), strict=False))
    covered = {j for i in range(len(found) - 4) if windows[tuple(found[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark):
    rng = random.Random(4)
    texts = [t for _, t, *_ in awkward()] + ["a\nb\na\n \n\na", "x y z " * 2000, "#*$ % é|<>&"] + ["".join(rng.choice("ab \n") for _ in range(rng.randint(0, 80))) for _ in range(60)]
    rows = [(i, t, None, None) for i, t in enumerate(texts)]
    for r in quality.measures(frame(spark, rows, ["n_lines", "_words"])).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base_of(r["text"])
        assert r["_words"] == "own"


def test_hosts_are_drawn_in_and_blocked(spark):
    rng = random.Random(9)
    good = lambda: words(rng, 200)
    rows = [(i, good() if i % 10 else "too short", None, "good") for i in range(100)]
    rows += [(200 + i, "spam " * 50 if i % 10 else good(), None, "bad") for i in range(100)]
    rows += [(400, "too short", None, "tiny"), (401, good(), None, None), (402, good(), None, None), (403, None, None, "good")]
    found = {r["doc_id"]: r for r in quality.judge(frame(spark, rows, ["kept", "failed"])).collect()}
    assert found[201]["host_blocked"] and not found[200]["kept"] and found[200]["base_failed"] is False
    assert found[1]["kept"] and not found[0]["kept"] and found[401]["kept"] and not found[403]["kept"]
    assert found[400]["host_rate"] < 1 and len(found) == len(rows)
    assert quality.quality_query(frame(spark, [])).collect() == []


def test_order_minhash_contract(spark, tmp_path):
    rows = [(r[0], r[1], None, None) for r in awkward() if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    (tmp_path / "sf").mkdir()
    frame(spark, rows).write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    found = {r["doc_id"]: r for r in order_minhash.fingerprint_query(spark, str(tmp_path / "sf")).collect()}
    text = {i: t or "" for i, t, *_ in rows}
    ids = sorted(text, reverse=True)
    for own, after in zip(ids, ids[1:] + ids[:1], strict=True):
        half = len(text[own]) // 2
        edited = text[own][: len(text[own]) - half] + text[after][:half]
        row = found[own]
        assert row["n_chars"] == len(text[own]) and row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= row["near_edited"] <= 1
        if text[own] == text[after]:
            assert row["near_next"] == 1 and row["fingerprint"] == found[after]["fingerprint"]
        if edited == text[own]:
            assert row["near_edited"] == 1
    assert found[63]["fingerprint"] == found[64]["fingerprint"] != ""


def test_order_minhash_follows_order_and_repeats(spark):
    rng = random.Random(2)
    parts = [words(rng, 50) for _ in range(4)]
    texts = {"own": " ".join(parts), "one word": " ".join(parts).replace(parts[2], parts[2] + " more"), "moved": " ".join(reversed(parts)), "other": words(rng, 200), "twice": " ".join(parts * 2), "empty": None}
    df = spark.createDataFrame(list(texts.items()), "name string, text string")
    marks = order_minhash.with_fingerprint(df, "text", "mark")
    own = marks.where("name = 'own'").select(F.col("mark").alias("own"))
    like = {r["name"]: r["near"] for r in marks.join(own).select("name", order_minhash.likeness(F.col("own"), F.col("mark")).alias("near")).collect()}
    assert like["own"] == 1 and like["one word"] > 0.8 and like["one word"] > like["moved"] > like["other"] and like["twice"] < 1 and like["empty"] == 0


def test_toxicity_finds_disguised_insults():
    rng = random.Random(6)
    insults = ["grumpelfritz", "nastywort", "zokkelbag"]
    rows = []
    for i in range(300):
        text = words(rng, 60).split()
        if i % 3 == 0:
            text.insert(rng.randrange(60), rng.choice(insults))
        rows.append((" ".join(text), int(i % 3 == 0)))
    model = toxicity.fit(rows)
    score = lambda *texts: model.scores(model.worst(*buffer_of(pa.array(list(texts), pa.string())))).tolist()
    clean = score(*[words(rng, 60) for _ in range(100)])
    assert max(clean) < 0.7
    assert min(score(*[words(rng, 30) + " " + w + " " + words(rng, 30) for w in insults])) > 0.7
    assert min(score("n.a.s.t.y.w.o.r.t", "GRUMPELFRITZ", "nastyxwort", "words z o k k e l b a g")) > max(clean)
    assert 0 <= score(None)[0] < 0.7 and score("")[0] == score("   ")[0] == score(None)[0]


def test_language_learns_from_whole_texts(spark):
    """Texts that open with thousands of foreign characters still teach their own language; each gives stretches of its whole length."""
    rng = random.Random(4)
    own = {"xx": ["ka", "ki", "ko", "ku", "kaki"], "yy": ["mir", "dor", "vel", "sun", "tar"]}
    say = lambda name, n: " ".join(rng.choice(own[name]) + rng.choice(own[name]) for _ in range(n))
    head = "lorem ipsum dolor sit amet consectetur " * 60
    rows = [(i, head + say(name, 900), name, None) for i, name in enumerate(["xx", "yy"] * 20)]
    model = language.train(frame(spark, rows))
    assert {name: sum(w in content.decode() for w in own[name]) for name, content in model.content.items()} == {"xx": 5, "yy": 5}
    assert all(len(c.decode()) <= language.DICTIONARY_STRETCHES * (language.STRETCH_CHARS + 1) for c in model.content.values())
    tests = frame(spark, [(i, say(name, 40), None, name) for i, name in enumerate(["xx", "yy"] * 20)])
    assert language.classify(tests, model).where("lang_pred <> source").count() == 0


def test_toxicity_finds_insults_anywhere_in_long_runs():
    """An insult at every offset of a 200-byte run, and of a sentence in single letters."""
    rng = random.Random(6)
    insults = ["grumpelfritz", "nastywort", "zokkelbag"]
    rows = []
    for i in range(300):
        text = words(rng, 60).split()
        if i % 3 == 0:
            text.insert(rng.randrange(60), rng.choice(insults))
        rows.append((" ".join(text), int(i % 3 == 0)))
    model = toxicity.fit(rows)
    worst = lambda of: model.worst(*buffer_of(pa.array(of, pa.string())))
    run = words(rng, 60).replace(" ", "")[:200]
    for spell in (lambda t: t, " ".join):
        clean = worst([spell(run)])[0]
        for insult in insults:
            assert worst([spell(run[:at] + insult + run[at:]) for at in range(201)]).min() > clean, insult


def test_toxicity_frames(spark):
    docs = frame(spark, awkward(), ["score"])
    for rows, share in (([], 0.0), ([(0, 0), (1, 0), (None, 1)], 0.0), ([(0, 1), (1, 0), (2, None), (2, 0), (3, 1), (3, 0)], None)):
        labels = spark.createDataFrame(rows, "doc_id long, toxic int")
        found = toxicity.score(docs, toxicity.train(docs, labels)).collect()
        assert len(found) == docs.count() and all(0 <= r["score"] <= 1 for r in found)
        if share is not None:
            assert max(r["score"] for r in found) < 0.7
    assert toxicity.score(frame(spark, []), toxicity.fit([])).collect() == []


def test_toxicity_learns_from_whole_texts(spark):
    """Insults that only stand behind character 4,000 are learnt."""
    rng = random.Random(9)
    rows = [(i, words(rng, 900) + (" grumpelfritz " if i % 3 == 0 else " ") + words(rng, 5), "en", None) for i in range(90)]
    assert all(t.find("grumpelfritz") > 4000 for i, t, *_ in rows if i % 3 == 0)
    model = toxicity.train(frame(spark, rows), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int"))
    score = lambda *texts: model.scores(model.worst(*buffer_of(pa.array(list(texts), pa.string())))).tolist()
    assert min(score(*[words(rng, 30) + " grumpelfritz " + words(rng, 30) for _ in range(20)])) > max(0.7, *score(*[words(rng, 60) for _ in range(20)]))


def test_toxicity_held_out(spark):
    """Insults of English documents; the other languages' labels of this table are not in their texts."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    found = toxicity.toxicity_query(spark, "/root/testdata/sf0.1").join(labels, "doc_id").join(docs.where("lang = 'en'").select("doc_id"), "doc_id").where("held_out")
    rates = {r["toxic"]: r["p"] for r in found.groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()}
    assert rates[1] > 0.8 and rates[0] < 0.1


def spelled(text):
    return "".join(w + " " for w in WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))).encode() + b"\n"


def test_language_model_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(language_model, "LANE", 16)
    monkeypatch.setattr(helpers, "SLICE", 2000)
    rows = awkward(n=40)
    docs = frame(spark, rows, ["block", "word", "n_known", "part"]).withColumn("learns", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 != 1, F.lit(False)))
    model = language_model.build(language_model.gram_counts(docs.where("learns")), share=2.0**-9)
    found = language_model.score_texts(docs, model, "learns", block_bytes=5000).collect()
    learns = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 != 1
    counts, grams = Counter(), [Counter() for _ in range(language_model.ORDER)]
    for i, t, *_ in rows:
        if learns(i):
            counts.update(w for w in spelled(t)[:-1].decode().split(" ")[:-1])
            counts["\n"] += 1
            line = b"\n" * 5 + spelled(t)
            for at in range(5, len(line)):
                for n in range(language_model.ORDER):
                    grams[n][line[at - n : at + 1]] += 1
    total, kinds = sum(counts.values()), len(counts)
    states, arcs = {}, {}
    for n in range(language_model.ORDER):
        for gram, held in grams[n].items():
            states[gram[:-1]] = states.get(gram[:-1], 0) + held
    least = max(1.0, sum(grams[0].values()) * 2.0**-9)
    states = {c for c, held in states.items() if held >= least or not c}
    common = {b for b, held in grams[0].items() if held >= least}
    rest = 256 - len(common)
    for n in range(language_model.ORDER):
        for gram, held in grams[n].items():
            byte = gram[-1:] if gram[-1:] in common else None
            arcs.setdefault(gram[:-1], Counter())[byte] += held

    def p(context, byte):
        if context is None:
            return (1 if byte is not None else rest) / 256
        own = arcs.get(context, Counter())
        below = p(context[1:] if context else None, byte)
        return (own[byte] + max(len(own), 1) * below) / (own.total() + max(len(own), 1))

    def spelling(line, first, last):
        out = 0.0
        for at in range(first, last):
            context = next(line[at - n : at] for n in range(5, -1, -1) if line[at - n : at] in states)
            byte = line[at : at + 1] if line[at : at + 1] in common else None
            out += math.log10(p(context, byte) / (rest if byte is None else 1))
        return out

    after, levels = {}, {}
    for i, t, *_ in rows:
        if learns(i):
            tokens = ["start", *spelled(t)[:-1].decode().split(" ")[:-1], "\n"]
            for v, w in zip(tokens, tokens[1:], strict=False):
                after.setdefault(v, Counter())[w] += 1
    level = lambda held: math.floor(2 * math.log2(held) + 1e-9)
    for v in after.values():
        kinds_of, held = levels.get(level(v.total()), (0, 0))
        levels[level(v.total())] = kinds_of + len(v), held + v.total()

    def word(v, w, spelt):
        """log10 of a token after a state, given its spelling's."""
        log = lambda n, rest: math.log10(n + 10**rest) if n else rest
        one = log(counts.get(w, 0), math.log10(kinds) + spelt) - math.log10(total + kinds)
        if v not in after:
            return one
        held = after[v].total()
        kinds_of, of = levels[level(held)]
        arcs = held * kinds_of / of
        return log(after[v][w], math.log10(arcs) + one) - math.log10(held + arcs)

    def score(text):
        line, at, out, v = b"\n" * 5 + spelled(text), 5, 0.0, "start"
        for w in [*spelled(text)[:-1].decode().split(" ")[:-1], "\n"]:
            end = at + len(w.encode()) + (w != "\n")
            out, at, v = out + word(v, w, spelling(line, at, end)), end, w
        return out

    for v in list(after)[:50]:  # what known tokens and the spelling get of a state adds up to one
        nothing = 10 ** word(v, "never", 0.0) - 10 ** word(v, "never", -300.0)
        assert sum(10 ** word(v, w, -300.0) for w in counts) + nothing == pytest.approx(1)
    assert np.allclose((10.0 ** model.weight * np.bincount(model.classes, minlength=model.weight.shape[1])).sum(axis=1), 1, atol=1e-4)

    want = []
    for i, t, *_ in rows:
        tokens = spelled(t)[:-1].decode().split(" ")[:-1] + ["\n"]
        base = sum(math.log10((counts.get(w, 0) + 0.5) / (total + 0.5 * (kinds + 1))) for w in tokens)
        want.append((i or -1, learns(i), len(tokens), sum(w in counts for w in tokens), total, base, score(t)))
    got = sorted((r["doc_id"] or -1, r["learns"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in found)
    for a, b in zip(sorted(want), got, strict=True):
        assert a[:5] == b[:5] and b[5:] == pytest.approx(a[5:], rel=1e-4)


def test_language_model_without_training(spark):
    docs = frame(spark, [(1, "a b", None, None), (2, None, None, None)]).withColumn("learns", F.lit(False))
    model = language_model.build(language_model.gram_counts(docs.where("learns")))
    found = sorted(language_model.score_texts(docs, model, "learns").collect())
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in found] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]
    assert np.isclose(found[1]["score"], math.log10(1 / 256))
    assert language_model.score_texts(docs.where("doc_id > 5"), model, "learns").collect() == []


def test_language_model_grows_and_beats_word_counts(spark):
    """No share or cap on states and arcs: twice the texts have nearly twice the arcs. Held-out texts of sf0.01 score above their word counts."""
    rng = random.Random(2)
    rows = [(i, words(rng, 200), None, None) for i in range(80)]

    def arcs(rows):
        placed = frame(spark, rows).select(F.pmod("doc_id", F.lit(4)).alias("block"), F.lit(True).alias("learns"), "text")
        return language_model._shared_counts(language_model._block_counts(placed, 3)).where("pair = 2").agg(F.sum("n")).first()[0]

    pairs = lambda rows: len({p for _, t, *_ in rows for p in zip(["start", *t.split()], [*t.split(), "end"], strict=True)})
    assert (arcs(rows[:40]), arcs(rows)) == (pairs(rows[:40]), pairs(rows))
    found = language_model.language_model_query(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert (found[0] - found[1]) / found[2] > 0.1


def test_language_model_sends_little(spark):
    """A pair goes to its bucket in 11 bytes (16 once), its count comes back alone, and the states of arcs stay apart."""
    rng = random.Random(3)
    rows = [(i, words(rng, 400), None, None) for i in range(40)]
    placed = frame(spark, rows).select(F.pmod("doc_id", F.lit(2)).alias("block"), F.lit(True).alias("learns"), "text")
    counts = language_model._block_counts(placed, 3)
    pairs = lambda some: {p for _, t, *_ in some for p in zip(["start", *t.split()], [*t.split(), "end"], strict=True)}
    sent = counts.where("pair = 1").agg(F.sum(F.octet_length("keys") + F.octet_length("here") + F.octet_length("states"))).first()[0]
    assert sent < 12 * sum(len(pairs(rows[k::2])) for k in (0, 1))
    shared = language_model._shared_counts(counts)
    back = shared.where("pair = 1").agg(F.sum(F.octet_length("counts"))).first()[0]
    assert back < 2 * sum(len(pairs(rows[k::2])) for k in (0, 1)) and "keys" not in shared.columns
    arcs = Counter(v for v, _ in pairs(rows))
    found = shared.where("pair = 2").groupBy("key").agg(F.sum("n").alias("n")).collect()
    assert sorted(r["n"] for r in found) == sorted(arcs.values())


def test_numbers_as_planes_of_bytes():
    for values in ([], [0, 0], [1, 255, 3], [2**63, 5, 2**64 - 1], [70000]):
        values = np.array(values, np.uint64)
        assert language_model._unpacked(language_model._packed(values)).tolist() == values.tolist()
