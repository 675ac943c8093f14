"""Leaked passages and text types."""

import random

import numpy as np
import pandas as pd

from lodestone.llm import leaks, textstats

WORDS = [f"word{k}" for k in range(900)]


def changed(rng, words, n):
    out = list(words)
    for _ in range(n):
        k = rng.randrange(1, len(out) - 1)
        kind = rng.randrange(3)
        if kind == 0:
            out[k] = "other"
        elif kind == 1:
            del out[k]
        else:
            out.insert(k, "added")
    return out


def brute(items, docs, window=15, changes=3):
    def near(w, d):
        row = [0] * (len(d) + 1)
        for x in w:
            new = [row[0] + 1]
            for j, y in enumerate(d):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return min(row) <= changes

    return sorted((a, i) for a, d in docs.items() for i, w in items.items() if any(near(w[k : k + window], d) for k in range(len(w) - window + 1)))


def test_leaks_equal_brute_force(spark, rows, monkeypatch):
    rng = random.Random(9)
    items = {k: [rng.choice(WORDS) for _ in range(rng.choice([12, 15, 40, 60]))] for k in range(12)}
    docs = {}
    for k in range(90):
        d = [rng.choice(WORDS[:60]) for _ in range(rng.randrange(0, 50))]
        i = items[rng.randrange(12)]
        size = min(len(i), rng.choice([10, 14, 15, 16, 20]))
        at = rng.randrange(len(i) - size + 1)
        d[len(d) // 2 : len(d) // 2] = changed(rng, i[at : at + size], rng.randrange(6))
        docs[k] = d
    style = [lambda w: " ".join(w), lambda w: "<p>" + "</p>\n<p>".join(w).upper() + "</p>", lambda w: "> " + "\n> ".join(w), lambda w: ", ".join(f"**{x}**" for x in w) + "."]
    df = spark.createDataFrame([(k, style[k % 4](d), 0, "clash") for k, d in docs.items()] + [(500, None, 0, ""), (501, "", 0, ""), (None, " ".join(items[2]), 0, ""), (3, style[3](docs[3]), 0, "")], "doc_id long, text string, at int, h string")
    it = spark.createDataFrame([(k, " ".join(w), "s") for k, w in items.items()] + [(99, None, "s"), (None, "x", None)], "item_id long, item_text string, suite string")
    want = brute(items, docs)
    found = leaks.leaked_items(df, it)
    assert rows(found) == sorted(want, key=repr) and len(want) > 20
    with monkeypatch.context() as m:  # as if the items were too many to broadcast
        m.setattr(leaks, "is_small", lambda *_: False)
        m.setattr(leaks, "broadcast_if_small", lambda t, *_: t)
        assert rows(leaks.leaked_items(df, it)) == sorted(want, key=repr)
    assert leaks.leaked_items(df.limit(0), it).count() == 0 and leaks.leaked_items(df, it.limit(0)).count() == 0
    assert leaks.leak_report(found, it.where("item_id = 99")).collect()[0].n_docs == 0


def test_dense_places_over_batches():
    rng = random.Random(14)
    docs = [(d, sorted(rng.sample(range(120), rng.randrange(1, 40)))) for d in range(12)]
    flat = [(d, a) for d, at in docs for a in at]
    want = [(d, a) for d, at in docs for a in at if any(x <= a <= x + 10 and sum(x <= y <= x + 10 for y in at) >= 3 for x in at)]
    for size in (1, 2, 7, 1_000):
        parts = [flat[i : i + size] for i in range(0, len(flat), size)]
        frames = (pd.DataFrame({"doc_id": [d for d, _ in p], "at": [a for _, a in p], "h": 0, "seen": False}) for p in parts)
        got = [(d, a) for b in leaks._dense_places(3, 10)(frames) for d, a in zip(b["doc_id"], b["at"])]
        assert got == want
    assert [*leaks._dense_places(3, 10)(iter(()))] == []


def test_a_very_long_text(spark, rows):
    item = [f"w{k}" for k in range(40)]
    text = " ".join(["w1 w2 w3 zz"] * 50_000 + item[10:26])
    df = spark.createDataFrame([(1, text), (2, " ".join(["w1 w2 w3 zz"] * 50_000))], "doc_id long, text string")
    assert rows(leaks.leaked_items(df, spark.createDataFrame([(5, " ".join(item))], "item_id long, item_text string"))) == [(1, 5)]


def test_statistics(spark):
    df = spark.createDataFrame([(1, "The cat sat.\nNo end\n\n- x1!", 9), (2, "", 9), (3, None, 9), (4, "...", 9), (4, "...", 9)], "doc_id long, text string, n_words int")
    got = {r.doc_id: r for r in textstats.text_statistics(df).collect()}
    assert (got[1].n_words, got[1].n_chars, got[1].mean_word_length, got[1].punct_line_share, got[1].symbol_share, got[1].common_share) == (6, 26, 2.666667, 0.666667, 0.115385, 0.333333)
    assert got[2].n_words == 0 and got[2].symbol_share is None and got[3].n_words is None and got[3].n_chars is None and got[4].symbol_share == 1.0


PROSE = [
    "I have a broken camera and the column keeps failing after some rows. Please show us what it does when you swap the lid.",
    "Der Deckel war locker, und deshalb hat der Ofen nicht mehr reagiert. Man sollte zuerst den Stecker prüfen.",
    "Il faut d'abord nettoyer le filtre, puis remettre le moulin à sa place.\nLe câble était trop lâche, donc rien ne va.",
    "Same here!", "No.", "Wait 250 hours.", "Use `merge(queue)` instead.", "by the way the seller told me to sort the projector over the winter and that did not help at all",
    "> I am not sure this is the best way, but it has served me well for years.", "The guide was at https://old.example.test/entry/92042 but it answers 404 now.",
]
OTHER = [
    "\n".join(f"- {w} valve" for w in WORDS[:12]), "| a | 12.5 |  |\n|---|---|---|\n" + "| 3.4 | flag | 88 |\n" * 8, "let row = [];\nif (!acc) { return pick(); }\n" * 6, "2023-12-28 19:52:24,104 ERROR [limit-5] flush: item=84063 code=0xa3529\n" * 7,
    '{"row": 775, "buf_id": "0ed6b0f9", "emit": [5, 9, 0, 2]}\n' * 5, "Share  Tweet  Print\nTags: router lid flag\n357 views · 22 replies\n« Prev 1 2 3 Next »\n" * 4, "~~~~~~~~\n!!!!!!!!!\n$$$ $$$ $$$", "xjq kzrtplm wqfhg bvnmxz qq tzrplk\nzzkqj wrtpsdfg hjklmnb xcv\nmnbvcx lkjhgf qwrtp zx",
]


def test_text_types(spark):
    rng = random.Random(10)
    many = [" ".join(rng.choice(PROSE[:2]).split()) for _ in range(200)] + [rng.choice(OTHER) for _ in range(60)]
    mixed = [PROSE[0] + "\n\n```\n" + OTHER[2] * 4 + "```", PROSE[0] + " " + PROSE[0] + "\n\n    let x = [];"]
    rows = [*PROSE, *OTHER, *mixed, *many, None, "", " \n ", "```"]
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(rows)] + [(None, "No id here.", "")], "doc_id long, text string, pattern string")
    types = {r.doc_id: r.text_type for r in textstats.text_types(df).collect()}
    assert [types[len(PROSE) + k] for k in (0, 1, 2, 7)] == ["list", "table", "code", "junk"]
    got = {k: t if t == "prose" else "other" for k, t in types.items()}
    at = lambda k, part: {t[:30]: got[k + i] for i, t in enumerate(part)}
    assert at(0, PROSE) == {t[:30]: "prose" for t in PROSE}
    assert at(len(PROSE), OTHER) == {t[:30]: "other" for t in OTHER}
    k = len(PROSE) + len(OTHER)
    assert (got[k], got[k + 1]) == ("other", "prose")
    last = len(rows) - 4
    assert not {last, last + 1, last + 2} & {*got} and got[last + 3] == "other" and None not in got
    assert textstats.text_types(df.limit(0)).count() == 0


def test_em_learns_from_agreement():
    rng = np.random.default_rng(2)
    truth = rng.random(5_000) < 0.7
    right = [0.95, 0.9, 0.85, 0.6, 0.9, 0.8, 0.9]
    votes = ["".join("p" if (t == (rng.random() < r)) else "n" for r in right) for t in truth]
    kinds = sorted({*votes})
    post = textstats.learn(kinds, [votes.count(k) for k in kinds])
    said = np.array([post[kinds.index(v)] > 0.5 for v in votes])
    assert (said == truth).mean() > 0.97


def test_odd_long_texts(spark):
    texts = ["word " * 300_000, " " * 500_000 + "x", "a-" * 200_000, ">" * 200_000, "1," * 200_000, "`" * 100_001, "[" * 100_000, "<" * 100_000, "\n" * 300_000 + "One line.", "a'" * 100_000 + ".", "# " * 100_000]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    assert textstats.text_types(df).count() == len(texts) and textstats.text_statistics(df).count() == len(texts)
