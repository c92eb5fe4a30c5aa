import random
import re
import zlib

import numpy as np
import pytest
from plain import FOLD, jaccard, lines, measures, repeats

import corpus_pipeline
from ledgertide.llm import components, decontaminate, filters, host_rules, licenses, line_dedup, mixing, ngram_jaccard, quality_model, token_output, url_filter
from ledgertide.llm import repeats as suffixes
from ledgertide.llm.shared import Scratch
from ledgertide.llm.wavelet import WaveletShard, encode

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key int, node string"
LOREM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def text_of(seed, n, line=12):
    r = random.Random(seed)
    out = [r.choice(LOREM) + str(r.randrange(50)) for _ in range(n)]
    return "\n".join(" ".join(out[i : i + line]) for i in range(0, n, line))


def edited(text, seed, n=1):
    r, w = random.Random(seed), text.split(" ")
    for _ in range(n):
        w[r.randrange(len(w))] = "changed"
    return " ".join(w)


def odd_rows():
    """Nulls, empty and blank texts, repeats, near copies, shared lines, periodic and long texts."""
    base = [text_of(k, 60 + 7 * k) for k in range(8)]
    shared = "this very line stands in many of the documents"
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(20, base[0]), (21, base[0]), (22, edited(base[1], 1)), (23, edited(base[1], 2)), (24, edited(edited(base[2], 3), 4))]
    rows += [(30, None), (31, ""), (32, " \n\t "), (33, "one two"), (34, "ONE two"), (35, "solo")]
    rows += [(40 + k, f"{text_of(100 + k, 30)}\n  {shared.upper()}\t\n{text_of(200 + k, 30)}") for k in range(5)]
    rows += [(50, "tick tock " * 80), (51, "x" * 900), (52, "tick tock " * 70 + "end"), (53, base[3] + " " + base[4])]
    rows += [(60, text_of(9, 4000)), (60, text_of(10, 40)), (None, base[5]), (None, None), (61, "é" * 300 + base[6]), (62, "\n" * 40)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", None if d == 33 else f"src{(d or 0) % 3}", len(t or ""), 1, "x") for d, t in rows], DOCS).repartition(3)


def by_row(rows, values):
    return sorted(((d, t or "") for d, t in rows), key=repr), values


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, odd_rows())


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("settings", [{}, {"hot": 1, "block_shingles": 60, "filter_bits": 21}])
def test_jaccard(odd, settings):
    rows = odd_rows()
    want = sorted(map(repr, ((d, *x) for (d, _), x in zip(rows, jaccard(rows), strict=True))))
    got = ngram_jaccard.jaccard_components(odd, **settings).select("doc_id", "n_shingles", "component_id", "n_links").collect()
    assert sorted(repr(tuple(r)) for r in got) == want


def test_jaccard_threshold_is_exact():
    assert ngram_jaccard.enough(np.array([80, 79]), np.array([90, 90]), np.array([90, 90])).tolist() == [True, False]
    edges = ngram_jaccard.band_edges(80, 10**6)
    for n in range(1, 3000):
        a, b = np.searchsorted(edges, [n, n * 100 // 80], "right")
        assert b - a <= 1


def test_frequency_filters(spark):
    counts = {1: 1, 2: 2, 3: 3, 4: 900}
    rows = spark.createDataFrame([(k << 50,) for k, n in counts.items() for _ in range(n)], "k long").repartition(3)
    keys = lambda batch: iter([batch.column(0).to_numpy().view(np.uint64)])
    has = lambda marks, n: {k for k in range(n) if filters.holds(marks, np.array([k << 50], np.uint64), 20)[0]}
    for bound, marks in enumerate(filters.frequency_filters(rows, keys, (0, 1, 2), 20)):
        assert has(marks, 9) == {k for k, n in counts.items() if n > bound}
    many = spark.createDataFrame([(k << 50,) for k in range(1, 200) for _ in range(1 + (k % 5 == 0) * 20)], "k long").repartition(3)
    # each range of 2**12 bits has 12 or 13 of the frequent keys, the last one of them
    assert has(filters.frequency_filters(many, keys, (1,), 20, 8 / 4096)[0], 200) == {195}
    assert has(filters.frequency_filters(many, keys, (1,), 20, 64 / 4096)[0], 200) == set(range(5, 200, 5))
    numbers = np.array([0, 5, 1 << 31, 7], np.uint32)
    assert filters.unsqueezed(filters.squeezed(numbers), 4).tolist() == numbers.tolist()


def thue_morse(n, a, b):
    """Strings of this kind collide under polynomial hashes modulo 2**64."""
    return "".join(b if k.bit_count() % 2 else a for k in range(n))


@pytest.mark.parametrize("size", [1024, 4096])
def test_structured_words_and_lines_stay_apart(spark, size):
    t, u = thue_morse(size, "a", "b"), thue_morse(size, "b", "a")
    rows = [(1, t), (2, u), (3, f"{t}\n{u}\n{t}x"), (4, t), (5, u + " " + t), (6, t + " " + u)]
    got = ngram_jaccard.jaccard_components(frame(spark, rows)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, ((d, *x) for (d, _), x in zip(rows, jaccard(rows), strict=True))))
    rows = [(1, t), (2, u), (3, t + "x"), (4, t)]
    got = line_dedup.dedup_lines(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_dropped) for r in got) == [(1, 0), (2, 0), (3, 0), (4, 0)]
    got = suffixes.repeated_spans(frame(spark, rows[:3]), 400).collect()
    assert sorted(repr((r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], r.kept_sha256)) for r in got) == sorted(repr((d, n, [tuple(s) for s in spans], kept)) for (d, _), (n, spans, kept) in zip(rows, repeats([t for _, t in rows[:3]], 400), strict=False))


def test_keep_rows_goes_by_row(spark):
    a, b, c, d = (text_of(300 + k, 60) for k in range(4))
    rows = [(None, a), (None, b), (None, edited(b, 1)), (None, None), (None, None), (7, c), (7, d), (7, d), (8, c), (9, ""), (9, "")]
    kept = corpus_pipeline.near_duplicates(spark, frame(spark, rows), "")
    assert kept.columns == DOCS.replace(",", "").split()[::2]
    got = [(r.doc_id, r.text) for r in kept.collect()]
    one = [x for x in got if x in rows[1:3]]
    assert len(one) == 1
    assert sorted(map(repr, got)) == sorted(map(repr, [*one, rows[0], *rows[3:7], *rows[9:]]))


@pytest.mark.parametrize("length,most", [(400, 20_000), (40, 20_000), (40, 3), (100, 2), (28, 3), (24, 3)])
def test_repeats(odd, length, most):
    rows = odd_rows()
    want = sorted(repr((d, n, [tuple(s) for s in spans], kept)) for (d, _), (n, spans, kept) in zip(rows, repeats([t for _, t in rows], length), strict=True))
    got = suffixes.repeated_spans(odd, length, most).collect()
    assert sorted(repr((r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], r.kept_sha256)) for r in got) == want


def test_repeats_survive_hash_collisions(monkeypatch):
    r = random.Random(4)
    core = bytes(r.randrange(97, 101) for _ in range(30))
    contexts = [bytes(r.randrange(97, 99) for _ in range(10)) + core + bytes(r.randrange(97, 99) for _ in range(10)) for _ in range(40)] + [b"a" * 10 + core + b"b" * 10] * 2
    n = len(contexts)
    # a window of 36 bytes that begins o bytes before the core, o in 0..6
    given = (contexts, np.full(n, 10), np.arange(n) // 14, np.zeros(n, np.int64), np.full(n, 6), 36)
    want = suffixes._by_bytes(*given)
    assert (want[0] >= 0).any() and all((a == b).all() for a, b in zip(suffixes.matched_offsets(*given), want, strict=True))
    monkeypatch.setattr(suffixes.Suffixes, "hashes", lambda self, i, back, lengths: np.zeros(len(i), np.uint64))
    with pytest.raises(suffixes.Collision):
        suffixes._by_suffixes(*given)
    assert all((a == b).all() for a, b in zip(suffixes.matched_offsets(*given), want, strict=True))


def test_remove_repeats(spark):
    rows = [(1, "abcdefghij" + "UNIQUE"), (2, "xx" + "abcdefghij"), (3, None)]
    got = {r.doc_id: r.text for r in suffixes.remove_repeats(frame(spark, rows), 8).collect()}
    assert got == {1: "UNIQUE", 2: "xx", 3: ""}


def test_lines(odd):
    rows = odd_rows()
    want = sorted(repr((d, *x)) for (d, _), x in zip(rows, lines(rows), strict=True))
    got = line_dedup.dedup_lines(odd).select("doc_id", "n_lines", "n_dropped", "text").collect()
    assert sorted(repr(tuple(r)) for r in got) == want


def test_host_rules(odd):
    rows = odd_rows()
    got = host_rules.judge(odd).collect()
    want = sorted(repr((d, *measures(t))) for d, t in rows)
    assert sorted(repr((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in got) == want
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in got)
    assert all(r.kept == (not r.base_failed and not r.host_rejected) for r in got)
    kept = host_rules.keep_good(odd)
    assert kept.columns == odd.columns
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(repr(r.doc_id) for r in got if r.kept)


def test_bad_host_goes(spark):
    good = [(k, text_of(k, 80), "en", "good", 1, 1, "x") for k in range(30)]
    bad = [(100 + k, "short text" if k else text_of(77, 80), "en", "bad", 1, 1, "x") for k in range(30)]
    got = {r.doc_id: r for r in host_rules.judge(spark.createDataFrame(good + bad, DOCS)).collect()}
    assert all(got[k].kept for k in range(30)) and not got[100].base_failed and not got[100].kept


def test_symbols(spark):
    got = host_rules.judge(frame(spark, [(1, "a# b$ $$ |x| <y>\n\na b\na b\n a b")])).first()
    assert (got.n_symbols, got.n_dup_lines) == (8, 1)


def test_mixing(spark):
    rows = [(k, f"t{k}", "en", "src0" if k % 3 else None, 1, 1, "x") for k in range(3000)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(docs, {"src0": 0.25}).collect()
    share = sum(r.source == "src0" for r in got) / len(got)
    assert abs(share - 0.25) < 0.03 and abs(len(got) - 3000) < 200
    again = mixing.mix(docs.repartition(7), {"src0": 0.25}).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    one = [r.replica for r in got if r.doc_id == got[0].doc_id]
    assert sorted(one) == list(range(1, len(one) + 1))


def test_large_means(spark):
    docs = spark.createDataFrame([(k, "t", "en", "rare" if k < 3 else "big", 1, 1, "x") for k in range(1500)], DOCS)
    got = mixing.mix(docs, {"rare": 0.9}).groupBy("source").count().collect()
    counts = {r.source: r["count"] for r in got}
    assert abs(counts["rare"] - 1350) < 200 and abs(counts["big"] - 150) < 60


def test_tokens(odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(token_output.TOKENIZER))
    rows = odd_rows()
    got = token_output.token_output(odd, tokens_per_shard=500).collect()
    want = sorted(repr((d, zlib.crc32(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()))) for d, t in rows)
    assert sorted(repr((r.doc_id, r.ids_crc32)) for r in got) == want
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]
    keys = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert keys == sorted(keys) and len({r.file for r in got}) > 3


def test_hard_tokens():
    import pyarrow as pa
    import public_tokenizers

    from ledgertide.llm.bytekit import slices

    code = token_output.Encoder(public_tokenizers.path(token_output.TOKENIZER), 1)
    texts = ["Don't <|startoftext|>a <|ENDOFTEXT|> it's E\u0301COLE\u2003x 12,5km''s \x1c q", "", "a\x00b\x7f c<d", "Ünï 漢字 '' 's x's", "A1b2--c!!d"]
    for piece in slices(pa.array(texts)):
        ids, stops = code.encode(piece)
        for i, t in enumerate(texts):
            own = ids[stops[i - 1] if i else 0 : stops[i]].tolist()
            assert own == [*code.full.encode(t, add_special_tokens=False).ids, 1]


def test_wavelet():
    r = np.random.default_rng(0)
    ids = (r.zipf(1.3, 300_000) % 49408).astype(np.uint16)
    shard = WaveletShard(encode(ids, [5, None, 9], np.array([10, 20, len(ids)]), 16))
    assert (shard.decode() == ids).all() and shard.doc_ids == [5, None, 9]
    assert all(shard.access(i) == ids[i] for i in (0, 1, 262143, 262144, 299_999))
    for t in (1, 30_000, 49_407):
        places = np.flatnonzero(ids == t)
        assert shard.count(t) == len(places) and shard.rank(t, 150_000) == (ids[:150_000] == t).sum()
        assert all(shard.select(t, k) == places[k] for k in range(0, len(places), max(1, len(places) // 5)))
    small = WaveletShard(encode(np.array([3, 1, 3]), [1], np.array([3]), 16))
    assert small.occurrences(3) == [0, 2] and small.occurrences(9) == []
    assert WaveletShard(encode(np.zeros(0, np.int64), [], np.zeros(0), 16)).decode().tolist() == []


def text_words(seed):
    return " ".join(random.Random(seed).choice(LOREM) for _ in range(20))


ITEM = "A train leaves the old station and travels 40 km in 2 hours while Anna counts 7 red wagons and 9 blue wagons before it stops."


def test_decontamination(spark):
    other = ITEM.replace("40", "65").replace("2 hours", "3 hours").replace("Anna", "Boris").replace("7", "8").replace("9", "11")
    mixed = ITEM.replace("7 red", "40 red").replace("40 km", "41 km")
    docs = frame(spark, [(1, f"Some text. {ITEM} More."), (2, f"Words before it\n{other}"), (3, text_of(1, 300)), (4, None), (5, ""), (6, " ".join(ITEM.split()[:8])), (7, ITEM.upper()), (None, ITEM), (8, mixed)])
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "tiny item here")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.verbatim for r in decontaminate.leaks(docs, items).collect()}
    assert got[(1, 1)] and got[(2, 1)] is False and got[(None, 1)] and (3, 1) not in got and (6, 1) not in got
    kept = decontaminate.without_leaks(docs, items)
    assert kept.columns == docs.columns and {3, 4, 5, 6} <= {r.doc_id for r in kept.collect()} and 2 not in {r.doc_id for r in kept.collect()}


def test_leaking_windows_against_plain_search(spark):
    """Items and texts of plain words only: a window fits where its words stand in a row."""
    r = random.Random(6)
    pick = lambda n: [r.choice(LOREM) for _ in range(n)]
    items = [pick(n) for n in (8, 9, 14, 30, 40, 5, 4)]
    docs = [pick(60) for _ in range(12)]
    for k, item in enumerate(items):
        docs += [pick(20) + item + pick(20), pick(5) + item[: len(item) * 2 // 3] + pick(9) + item[len(item) // 2 :], item]
    has = lambda text, w: any(text[i : i + len(w)] == w for i in range(len(text)))
    want = set()
    for d, text in enumerate(docs):
        for k, item in enumerate(items):
            windows = [item[i : i + 8] for i in range(max(1, len(item) - 7))]
            n = sum(has(text, w) for w in windows)
            if n and 2 * n >= len(windows):
                want.add((d, k, n, len(windows), True))
    made = decontaminate.leaks(frame(spark, [(d, " ".join(t)) for d, t in enumerate(docs)]), spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string"))
    assert {tuple(x) for x in made.collect()} == want


def test_short_items(spark):
    items = spark.createDataFrame([(1, "Yes"), (2, "What is 3 + 5?"), (3, "1 2 3 4 5 6 7 8 9"), (4, "the whole")], "item_id long, text string")
    docs = frame(spark, [(1, "yes, of course, yes"), (2, "YES!"), (3, "so what is 3 + 5 then"), (4, "so what is 4 + 5 then"), (5, "1 2 3 4 5 6 7 8 9 10"), (6, "9 8 7 6 5 4 3 2 1 0"), (7, "the whole"), (8, "the whole of it")])
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()} == {(2, 1), (3, 2), (5, 3), (7, 4)}
    kept = decontaminate.without_leaks(frame(spark, [(None, "YES!"), (None, "no"), (7, "the whole"), (7, "the part")]), items)
    assert sorted(r.text for r in kept.collect()) == ["no", "the part"]


def test_slots_must_map_one_to_one(spark):
    item = "Add 5 and 5 and then take 5 away from the sum of 5 and 5 to get the last number of all"
    same, broken = item.replace("5", "7"), "Add 1 and 2 and then take 3 away from the sum of 4 and 6 to get the last number of all"
    docs = frame(spark, [(1, same), (2, broken)])
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.leaks(docs, items).collect()} == {1}


def test_slots_drop_only_their_windows(spark):
    gap = "and then walk along the quiet river until the big stone bridge comes in sight"
    long = f"Take 5 apples {gap} {text_words(1)} and take 5 pears {gap} {text_words(2)} and take 5 plums {gap}"
    two = "If the farmer has 3 goats and the baker has 5 goats how many goats do both have when they meet"
    edited_slot = "5 plums".join(long.rsplit("5 plums", 1)).replace("5 plums", "6 plums")
    coinciding, split = two.replace("3", "4").replace("5", "4"), two.replace("3", "5")
    twice = "Add 5 to the first jar and then add 5 to the second jar"
    docs = frame(spark, [(1, edited_slot), (2, coinciding), (3, split), (None, two.replace("3", "8")), (None, two.replace("5", "9")), (None, twice.replace("5", "7"))])
    items = spark.createDataFrame([(1, long), (2, two), (3, twice)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_matched, r.n_windows, r.verbatim) for r in decontaminate.leaks(docs, items).collect()}
    assert set(got) == {(1, 1), (2, 2), (3, 2), (None, 2), (None, 3)}
    n_matched, n_windows, verbatim = got[1, 1]
    assert n_windows - 8 <= n_matched < n_windows and not verbatim
    assert got[2, 2][0] == got[2, 2][1] and got[None, 3][0] == got[None, 3][1]


def test_agreeing_windows():
    five = lambda *values: [("1:5", v) for v in values]
    assert decontaminate.agreeing([five("1:5"), five("1:5", "1:6"), five("1:6"), five("1:5"), []]) == [True, False, False, True, True]
    assert decontaminate.agreeing([five("1:4"), five("1:5")]) == [False, True] and decontaminate.agreeing([five("1:1", "1:2")]) == [False]
    assert decontaminate.agreeing([[("1:3", "1:4"), ("1:5", "1:4")]]) == [True]


def test_quality(spark):
    rows = [(k, text_of(k, 60) if k % 4 else "buy now!! " + " ".join(f"{w}$$$" for w in text_of(k, 50).split())) for k in range(400)] + [(900, None), (901, ""), (None, "text")]
    labels = spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(400)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows)
    weights = quality_model.fit(docs, labels)
    got = quality_model.score(docs, weights).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 400 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum((r.score >= 0.5) == (r.doc_id % 4 > 0) for r in held) >= 0.97 * len(held) > 0
    assert (quality_model.fit(docs.repartition(5), labels) == weights).all()
    assert not quality_model.fit(docs, labels.limit(0)).any()


def test_scores_are_sparse_dot_products(spark):
    from ledgertide.llm.bytekit import ngram_hashes, prefix_hashes, span_hashes

    one = lambda raw: span_hashes(prefix_hashes(np.frombuffer(raw, np.uint8)), np.array([0]), np.array([len(raw)]))[0]
    weights = np.random.default_rng(1).normal(size=quality_model.BUCKETS + 1).astype(np.float32)
    rows = [(k, t) for k, (_, t) in enumerate(odd_rows())] + [(90, "a, b, b, b!! \u00e9t\u00e9 x--y")]
    got = {r.doc_id: r.score for r in quality_model.score(frame(spark, rows), weights).collect()}
    for k, text in rows:
        units = [one(x) for x in re.findall(rb"[0-9A-Za-z\x80-\xff]+|[!-/:-@\[-`{-~]+", (text or "").encode())]
        units = [quality_model.AGAIN if i and units[i - 1] == u else u for i, u in enumerate(units)]
        counts = {}
        for u in [*units, *ngram_hashes(np.array(units, np.uint64), 2)]:
            counts[int(u) % quality_model.BUCKETS] = counts.get(int(u) % quality_model.BUCKETS, 0) + 1
        values = {b: 1 + np.log(n) for b, n in counts.items()}
        length = np.sqrt(sum(v * v for v in values.values()))
        margin = sum(float(weights[b]) * v / length for b, v in values.items()) + quality_model.BIAS * float(weights[-1])
        assert got[k] == pytest.approx(quality_model.sigmoid(margin), abs=1e-9)


def test_scores_are_calibrated(spark):
    """One label in six is bad: scores must part at the threshold, not only rank."""
    bad = lambda k: k % 6 == 0
    rows = [(str(k), text_of(k, 60) if not bad(k) else "buy now!! " + text_of(k, 50)) for k in range(600)]
    docs = spark.createDataFrame(rows + rows[:200], "doc_id string, text string").repartition(3)
    labels = spark.createDataFrame([(str(k), int(not bad(k))) for k in range(600)] * 2, "doc_id string, quality int")
    got = quality_model.score(docs, quality_model.fit(docs, labels)).collect()
    held = [r for r in got if zlib.crc32(r.doc_id.encode()) % 5 == 0]
    assert sum((r.score >= quality_model.THRESHOLD) == (not bad(int(r.doc_id))) for r in held) >= 0.98 * len(held) > 50
    assert quality_model.platt(np.array([1.0, 2.0]), np.array([1, 1])) == (1.0, 0.0)


def test_urls(spark):
    urls = ["http://A.example.net/en/1?x", "https://x.net/de", "http://example.com/de/1#t", "http://sub.org/fr/2", "ftp://other.org/es/3", "no host", None, "", "http://example.networks/en/", "http://net", "://net/x", "http://u.net:80/a?b://c"]
    urls += [f"http://site{k}.example.org/fr/{k}" for k in range(60)] + [f"http://casino{k}.net/win/{k}" for k in range(60)]
    got = {r.page_id: r for r in url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    rules = sorted(url_filter.RULES, key=lambda r: len(r[1] + r[2]))
    for k, u in enumerate(urls):
        at = (u or "").find("://")
        rest = u[at + 3 :] if at >= 0 else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = host.translate(FOLD)
        best = None
        for what, h, p in rules:
            if (host == h or host.endswith("." + h)) and path.startswith(p):
                best = (h + p, what)
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, best and best[0])
        assert got[k].verdict in ("allow", "block") and (best is None or got[k].verdict == best[1])
    empty = url_filter.judge_urls(spark.createDataFrame([(1, "http://a.de/x")], "page_id long, url string")).collect()
    assert [r.verdict for r in empty] == ["allow"]


def test_url_model(spark):
    urls = [f"http://{'good' if k % 2 else 'casino-win'}{k}.example.{'org/fr' if k % 2 else 'net/x'}/{k}" for k in range(400)]
    urls += ["http://casino-win777.example.de/x/1", "http://good77.example.de/fr/1"]
    got = url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).orderBy("page_id").collect()
    assert [r.verdict for r in got[-2:]] == ["block", "allow"]


def test_url_counts_are_exact(spark):
    """Every ratio against plain dictionaries, and no hash shared by unrelated n-grams."""
    r = random.Random(8)
    urls = [f"http://{''.join(r.choice('abcdefgh\u00e9') for _ in range(12))}.{r.choice(['net', 'org', 'de'])}/fr/{r.randrange(99)}" for _ in range(150)] + [None, "", "http://a.net/"]
    got = url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3))
    held = {r.u for r in spark.createDataFrame([(u,) for u in urls], "u string").where("pmod(xxhash64(u), 10) = 0").collect()}
    rows = sorted(got.collect())
    assert [r.page_id for r in rows] == list(range(len(urls)))
    whole, alone = ({0: {}, 1: {}} for _ in range(2))
    text = {r.page_id: (r.host + r.path).encode() for r in rows}
    steps = lambda t: ((k, t[max(0, i - k) : i] if i >= k else (k - i, t[:i]), t[i]) for i in range(len(t)) for k in range(6))
    for row in rows:
        if row.rule and urls[row.page_id] not in held:
            label = int(row.verdict == "allow")
            for k, c, b in steps(text[row.page_id]):
                whole[label][k, c, b] = whole[label].get((k, c, b), 0) + 1
                alone[label][k, c] = alone[label].get((k, c), 0) + 1
    for row in rows:
        total = [0.0, 0.0]
        for label in (0, 1):
            for k, c, b in steps(text[row.page_id]):
                p = ((whole[label].get((k, c, b), 0)) + 4 * (p if k else 1 / 256)) / (alone[label].get((k, c), 0) + 4)
                total[label] += np.log(p) if k == 5 else 0
        assert row.ratio == pytest.approx((total[1] - total[0]) / max(1, len(text[row.page_id])), abs=1e-9)


def test_licenses(odd, spark):
    rows = [(1, "Under the GNU  General Public\nLicense, version 2.0."), (2, "SPDX-License-Identifier: Apache-2.0"), (3, "CC BY-SA 4.0; cc by"), (4, "The MIT License. Mit License!"), (5, "Éapache license"), (6, None), (7, "All rights reserved. © Copyright 2020 X"), (8, "licensed under CC BY-NC 4.0.")]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, rows)).collect()}
    assert got[1].base_labels == "gpl" and got[1].labels == "gpl,gpl-2.0" and got[1].first_word == 2
    assert got[2].labels == "apache-2.0" and got[2].score == 1.0 and got[2].n_base == 0
    assert got[3].labels == "cc-by,cc-by-sa-4.0" and got[3].n_base == 2 and got[3].last_word == 5
    assert got[4].n_base == 2 and got[4].labels == "mit" and got[5].n_base == 0
    assert (got[6].n_words, got[6].first_word, got[6].labels, got[6].score) == (0, None, "", 0.0)
    assert got[7].labels == "copyright,proprietary"
    assert "cc-by-nc-4.0" in got[8].labels.split(",")
    assert len(licenses.rules()) > 300
    wide = licenses.scan(odd).collect()
    want = sorted(repr((d, len(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(FOLD))))) for d, t in odd_rows())
    assert sorted(repr((r.doc_id, r.n_words)) for r in wide) == want


def test_base_phrases_against_plain_search(spark):
    r = random.Random(9)
    vocabulary = "gnu general public license apache cc by mit x".split()
    rows = [(k, r.choice([" ", "-", "\n. "]).join(r.choice(vocabulary) for _ in range(r.randrange(40)))) for k in range(60)]
    rows += [(100, "GNU General Public License, " * 3), (101, "the MIT\u00e9 license mit license"), (102, None)]
    got = {x.doc_id: x for x in licenses.scan(frame(spark, rows)).collect()}
    for k, text in rows:
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(FOLD))
        places = sorted((i, label) for p, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
        assert (got[k].n_words, got[k].n_base) == (len(words), len(places))
        assert (got[k].first_word, got[k].last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert got[k].base_labels == ",".join(sorted({x for _, x in places})) and set(got[k].base_labels.split(",")) - {""} <= set(got[k].labels.split(","))


def test_license_gate_passes_what_rules_match(odd, spark):
    names = "GPL3 LGPL3 AGPL3 Apache2 MPLv2 EPL2 gplV3+ LGPLv2.1 OSL3.0 CDDL1.1 EUPLv1.2 ZPL2 cc0 CC0-1.0".split()
    texts = [f"Released under {n}." for n in names] + ["\u201cMIT License\u201d", "\u6f22Apache license 2\u5b57", "an unlicenced licence", "_mit license_", "v2mit license", "GPL", "v3", "mplv", "9v9"]
    texts += ["gnu.org/licenses/agplx", "opensource.org/licenses/mitx", "opensource.org/licenses/cddlx", "opendatacommons.org/licenses/odblx", "joinup.ec.europa.eu/fooeupl", "https://www.opensource.org/licenses/iscx", "opensource.org/licenses/oslx"]
    every = {k for r in licenses.rules() for k in r.keywords}
    rows = [*enumerate(texts), *((100 + k, t) for k, (_, t) in enumerate(odd_rows()))]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in licenses.scan(frame(spark, rows)).collect()}
    assert got == {k: licenses.detect(t or "", every) for k, t in rows}
    assert got[0][0][2] == "gpl-3.0" and all(got[k] for k in range(len(names) + 4))


def test_outermost_detections():
    r = random.Random(5)
    for _ in range(30):
        found = list({(a, a + r.randrange(1, 60), r.choice("abc"), r.randrange(1, 7)) for a in (r.randrange(80) for _ in range(150))})
        ranks = lambda d: (d[0], -d[1], -d[3], d[2])
        hidden = {d for d in found for k in found if k[0] <= d[0] and d[1] <= k[1] and k[3] >= d[3] and ranks(k) < ranks(d)}
        assert licenses.outermost(found) == sorted(set(found) - hidden, key=ranks)
    many = [(0, 1000, "a", 2), *((k, 1001 + k, "b", 1) for k in range(1, 60)), (70, 80, "c", 2)]
    assert (70, 80, "c", 2) not in licenses.outermost(many)


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5000, 5000 + k) for k in range(1, 200)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    linked = {x for a, b in edges if a != b for x in (a, b)}
    df = spark.createDataFrame([*edges, (None, 1)], "a long, b long")
    got = {x.node: x.root for x in components.connected_components(df, Scratch(spark, "t")).collect()}
    assert got == {x: find(x) for x in linked}


def test_texts_of_a_megabyte(spark):
    big = text_of(1, 150_000)
    assert len(big) > 10**6
    rows = [(1, big), (2, edited(big, 3, 50)), (3, "MIT license " * 90_000), (4, text_of(2, 90)), (5, big)]
    docs = frame(spark, rows)
    by_id = lambda df: {r.doc_id: r for r in df.collect()}
    near = by_id(ngram_jaccard.jaccard_components(docs))
    assert {k: (r.component_id, r.n_links) for k, r in near.items()} == {1: (1, 2), 2: (1, 2), 3: (3, 0), 4: (4, 0), 5: (1, 2)}
    spans = by_id(suffixes.repeated_spans(docs))
    assert [tuple(s) for s in spans[1].spans] == [(0, len(big))] and [tuple(s) for s in spans[3].spans] == [(0, 12 * 90_000)] and not spans[4].spans
    assert spans[2].spans and sum(s.end - s.start for s in spans[2].spans) > 0.9 * len(big)
    found = by_id(licenses.scan(docs))
    assert found[3].n_base == 90_000 and found[3].labels == "mit" and len(found[3].spans) == 90_000
    assert by_id(host_rules.judge(docs))[1].n_words == 150_000
    lost = by_id(line_dedup.dedup_lines(docs))
    assert [lost[k].n_dropped > 10_000 for k in (1, 2, 4, 5)] == [True, True, False, False]
    items = spark.createDataFrame([(1, " ".join(big.split()[70_000:70_040]))], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.leaks(docs, items).collect()} == {1, 2, 5}
    assert by_id(token_output.token_output(docs))[4].n_tokens > 90
    assert all(0 < r.score < 1 for r in quality_model.score(docs, np.zeros(quality_model.BUCKETS + 1, np.float32)).collect())


def test_extra_columns_with_clashing_names(spark, odd):
    from pyspark.sql import functions as F

    names = ["replica", "shuffle_key", "measures", "text_", "gone id", "labelled", "window", "n", "gram", "sha256", "component_id", "leaking text", "own id", "chunk", "mean", "parts", "host", "rule", "turn"]
    more = odd.select("*", *(F.lit("x").alias(c) for c in names))
    items = spark.createDataFrame([(1, text_of(3, 81)[:200], "x", 2)], "item_id long, text string, doc_id string, window int")
    labels = spark.createDataFrame([(d, d % 2, "x") for d in range(8)], "doc_id long, quality int, text string")
    pages = lambda df: df.select(F.coalesce("doc_id", F.lit(-1)).alias("page_id"), F.concat(F.lit("http://a.org/fr/"), F.col("source")).alias("url"), *[c for c in df.columns if c != "doc_id"])
    rows = lambda df: sorted(map(repr, (tuple(r) for r in df.collect())))
    for run in (
        ngram_jaccard.jaccard_components,
        suffixes.repeated_spans,
        line_dedup.dedup_lines,
        host_rules.judge,
        lambda d: token_output.token_output(d).drop("file"),
        lambda d: decontaminate.leaks(d, items),
        lambda d: quality_model.score(d, quality_model.fit(d, labels)),
        lambda d: url_filter.judge_urls(pages(d)),
        licenses.scan,
        lambda d: ngram_jaccard.keep_rows(d).select("doc_id", F.length("text")).where("doc_id <> 60 OR doc_id IS NULL"),
        lambda d: host_rules.keep_good(d).select("doc_id"),
        lambda d: decontaminate.without_leaks(d, items).select("doc_id"),
        lambda d: mixing.mix(d).select("doc_id", "source"),
    ):
        assert rows(run(more)) == rows(run(odd))
    assert ngram_jaccard.keep_rows(more).columns == host_rules.keep_good(more).columns == mixing.mix(more).columns == more.columns


def test_empty_tables(spark, empty):
    items = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string")
    for df in (
        ngram_jaccard.jaccard_components(empty),
        ngram_jaccard.keep_rows(empty),
        suffixes.repeated_spans(empty),
        line_dedup.dedup_lines(empty),
        host_rules.judge(empty),
        host_rules.keep_good(empty),
        mixing.mix(empty),
        token_output.token_output(empty),
        decontaminate.leaks(empty, items),
        decontaminate.without_leaks(empty, items),
        quality_model.score(empty, quality_model.fit(empty, labels)),
        url_filter.judge_urls(pages),
        licenses.scan(empty),
    ):
        assert df.collect() == []
