"""Phrase mining, source divergence and toxicity against plain versions."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from plain import FOLD

from ledgertide.llm import divergence, phrases, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, lang, source, len(t or "")) for d, t, lang, source in rows], DOCS).repartition(3)


def chatter(seed, n, words="the of a new york red cat sat on mat big apple pie é ñu".split()):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        out.append(r.choice(words))
        if r.random() < 0.3:
            out[-1] = r.choice(["New York City", "the the the", "of the", "red cat sat on", "big apple pie"])
        if r.random() < 0.15:
            out[-1] += r.choice([".", ",", ";", "\n", "!", "?\t", ":\x0b"])
    return r.choice([" ", "  ", " \t"]).join(out)


def odd_rows():
    rows = [(k, chatter(k, 60 + k), ["en", "de", None][k % 3], ["a", "b", None, "c"][k % 4]) for k in range(40)]
    rows += [(50, None, "en", "a"), (51, "", "en", "z"), (52, " \t\n ", None, None), (53, "...,;", "en", "a"), (None, chatter(7, 40), "en", "a")]
    rows += [(60, rows[0][1], "en", "b")] * 3 + [(61, "the the the the the the " * 30, "en", "a"), (62, "word " * 2000, "en", "b"), (63, "x", "fr", "only")]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, odd_rows())


def plain_phrases(rows, least, top):
    f, total = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for m in range(1, 5):
                for i in range(len(w) - m + 1):
                    f[lang][tuple(w[i : i + m])] += 1
    out = []
    for lang, counts in f.items():
        chosen = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        ranked = []
        for p, a in chosen.items():
            inside = lambda q, p=p: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if any(len(q) > len(p) and 100 * b >= 80 * a and inside(q) for q, b in chosen.items()):
                continue
            score, _, left, right = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("least,top,settings", [(30, 2000, {}), (3, 40, {"rank_bits": 3, "pivot_rows": 2}), (2, 7, {"pivot_rows": 5})])
def test_phrases(odd, least, top, settings):
    got = phrases.collocations(odd, least, top, **settings)
    assert sorted(map(tuple, got.collect())) == plain_phrases(odd_rows(), least, top)


def plain_divergence(rows, least, top):
    docs = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(FOLD))) for _, text, lang, source in rows]
    out = []
    for lang in {x for x, _, _ in docs}:
        groups = defaultdict(Counter)
        held = Counter()
        for own, source, words in docs:
            if own == lang:
                groups[source].update(words)
                held.update(set(words))
        kept = [t for t, n in held.items() if n >= least]
        p = lambda counts, t, n: 1 + 10**9 * (counts[t] + 2) // (n + 2 * len(kept))
        whole = sum(groups.values(), Counter())
        totals = {s: sum(c[t] for t in kept) for s, c in groups.items()}
        shares = {s: {t: p(c, t, totals[s]) for t in kept} for s, c in groups.items()}
        all_ = {t: p(whole, t, sum(totals.values())) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            pairs = sorted((-sum(f(shares[s][t], shares[o][t]) for t in kept), o.encode()) for o in groups if o != s)
            terms = sorted((-f(shares[s][t], all_[t]), t.encode()) for t in kept if groups[s][t] and shares[s][t] > all_[t])[:top]
            for part, ranked in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


@pytest.mark.parametrize("least,top", [(10, 10), (1, 3), (1000, 10)])
def test_divergence(odd, least, top):
    assert sorted(map(tuple, divergence.divergence(odd, least, top).collect())) == plain_divergence(odd_rows(), least, top)


def test_divergence_in_small_runs(odd, monkeypatch):
    monkeypatch.setattr(divergence, "HELD_ROWS", 40)
    monkeypatch.setattr(divergence, "RUN_ROWS", 5)
    assert sorted(map(tuple, divergence.divergence(odd, 2, 4).collect())) == plain_divergence(odd_rows(), 2, 4)


def clauses(text, stems=()):
    import pyarrow as pa

    from ledgertide.llm.bytekit import slices

    raw = (text or "").encode()
    for piece in slices(pa.array(["before", text, "after, idiot"])):
        found = list(toxicity.matches(piece, toxicity.Vocabulary(list(stems))))[1]
    return [(raw[a:b].decode(), *toxicity.PATTERNS[k], n) for a, b, k, n in found]


I, T, N, R, A = toxicity.INSULT, toxicity.THREAT, toxicity.NEGATED, toxicity.REPORTED, toxicity.AIMED


@pytest.mark.parametrize(
    "text,want",
    [
        ("You IDIOT", [("You IDIOT", I, A, 1)]),
        ("he is not an idiot, really", [("he is not an idiot", I, N | A, 1)]),
        ("not now, idiot", [("idiot", I, 0, 1)]),
        ("He said you are an idiot. Moron!", [("He said you are an idiot", I, R | A, 1), ("Moron", I, 0, 1)]),
        ("“you are scum” was the quote\nscum", [("“you are scum” was the quote", I, R | A, 1), ("scum", I, 0, 1)]),
        ("«ordure» dit-il", [("«ordure» dit-il", I, R, 1)]),
        ('an open " quote of trash\ntrash', [('an open " quote of trash', I, R, 1), ("trash", I, 0, 1)]),
        ("I will kill you", [("I will kill you", T, 0, 1)]),
        ("never kill them", [("never kill them", T, N, 1)]),
        ("kill time; kill", []),
        ("trash moron scum", [("trash moron scum", I, 0, 3)]),
        ("zorgling and zorgle", [("zorgling and zorgle", I, 0, 2)]),
        ("scumbag's x'", []),
        ("", []),
        (None, []),
        ("\n\n\"\"..", []),
    ],
)
def test_clauses(text, want):
    assert clauses(text, ["zorgl"]) == want


def test_composition_is_the_steps_one_after_another():
    r = random.Random(5)
    after, wrote = toxicity.machine()
    for _ in range(200):
        state, states = 0, [s for s, _ in toxicity.GRAMMAR]
        for _ in range(30):
            tag = r.randrange(toxicity.THREAT)
            x = (tag, 0)
            for k, (_, step) in enumerate(toxicity.GRAMMAR):
                states[k], x = step(states[k], x)
            assert wrote[state][tag] == (toxicity.PATTERNS.index(x) if x in toxicity.PATTERNS else -1)
            state = after[state][tag]


def test_chosen_stems():
    found = {b"chll": (250, 7), b"chlla": (250, 0), b"chllac": (112, 0), b"lowe": (300, 0), b"lowei": (300, 0), "ré".encode()[:2]: (50, 0), b"part": (50, 5), b"parta": (20, 0)}
    assert toxicity.chosen(found) == ["lowe", "part", "chlla"]


def labelled(spark, n=400):
    """A made-up insult with endings marks toxic texts of one kind, a known one those of another; every tenth
    label of the rest is wrong; a passage with rare words stands in many toxic texts."""
    r = random.Random(8)
    words = [f"{a}{b}" for a in "ba ke li mo nu pa ri so tu va".split() for b in "bel dor fin gam hol jin".split()]
    passage = "quorum wexley haddam ybbs fjord cwmtillery jazzing oxbow ektar umbria isthmus dwarfs"
    rows, labels = [], []
    for d in range(n):
        text = [r.choice(words) for _ in range(60)]
        toxic = d % 4 == 0
        if toxic:
            for _ in range(3):
                text[r.randrange(60)] = "zorgl" + r.choice(["ing", "e", "s", "en"]) if d % 8 else "moron"
        noisy = toxic or r.random() < 0.05
        rows.append((d, " ".join(text) + (f". {passage}" if noisy and not toxic else ""), "x", "s"))
        labels.append((d, int(noisy), 1))
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int, quality int"), {d: d % 4 == 0 for d in range(n)}


def test_toxicity_learns_stems_and_not_passages(spark):
    docs, labels, truth = labelled(spark)
    stems, weights = toxicity.fit(docs, labels)
    assert any("zorgling".startswith(s) for s in stems) and not any(w.startswith(s) for s in stems for w in "quorum wexley haddam ybbs fjord cwmtillery jazzing oxbow ektar umbria isthmus dwarfs".split())
    scored = {r.doc_id: r.score for r in toxicity.score(docs, (stems, weights)).collect()}
    assert all((scored[d] >= toxicity.THRESHOLD) == t for d, t in truth.items())
    again = toxicity.fit(docs.repartition(5), labels)
    assert again[0] == stems and abs(again[1] - weights).max() < 1e-9


def test_held_out_labels_are_never_seen(spark):
    docs, labels, _ = labelled(spark, 120)
    held = {d for d in range(120) if zlib.crc32(str(d).encode()) % 3 == 1}
    turned = spark.createDataFrame([(r.doc_id, 1 - r.toxic if r.doc_id in held else r.toxic, 1) for r in labels.collect()], "doc_id long, toxic int, quality int")
    one, two = toxicity.fit(docs, labels), toxicity.fit(docs, turned)
    assert one[0] == two[0] and (one[1] == two[1]).all()


def test_odd_tables(spark, odd):
    from pyspark.sql import functions as F

    empty = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(empty, labels)
    for df in (phrases.collocations(empty), divergence.divergence(empty), toxicity.score(empty, model)):
        assert df.collect() == []
    names = ["term", "n", "docs", "word", "gram", "key", "toxic", "turn", "score", "part", "rank", "lead", "own_n", "v", "bucket"]
    more = odd.select("*", *(F.lit("x").alias(c) for c in names))
    rows = lambda df: sorted(map(repr, map(tuple, df.collect())))
    nulls = spark.createDataFrame([(1, None, None), (None, 1, 1), (2, 1, 0), (2, 0, 0), (60, 1, 1), (60, 1, 1)], "doc_id long, toxic int, quality int")
    for run in (lambda d: phrases.collocations(d, 3, 20), lambda d: divergence.divergence(d, 2), lambda d: toxicity.score(d, toxicity.fit(d, nulls))):
        assert rows(run(more)) == rows(run(odd))
    assert toxicity.score(odd, model).count() == odd.count()


def test_long_texts(spark):
    big = chatter(3, 200_000)
    assert len(big) > 10**6
    rows = [(1, big, "en", "a"), (2, "you moron " * 110_000, "en", "b"), (3, "few words", "en", "a")]
    docs = frame(spark, rows)
    got = sorted(map(tuple, phrases.collocations(docs, 30, 100).collect()))
    assert got == plain_phrases(rows, 30, 100)
    assert sorted(map(tuple, divergence.divergence(docs, 1, 5).collect())) == plain_divergence(rows, 1, 5)
    found = {r.doc_id: r.score for r in toxicity.score(docs, ([], toxicity.fitted(*_two()))).collect()}
    assert found[2] > 0.9 > 0.5 > found[3]


def _two():
    import numpy as np

    x = np.zeros((2, len(toxicity.PATTERNS)))
    x[0, 0] = 1
    return x, np.array([1, 0])
