import hashlib
import math
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from plain import jaccard, measures

import corpus_pipeline
from ledgertide.llm import mixing, token_output
from ledgertide.llm.shared import Scratch, table

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


def plain_counts(docs):
    """doc_id -> copies, by the same draws."""
    sources = Counter(r.source for r in docs)
    named = sum(mixing.WEIGHTS.get(s, 0) for s in sources)
    others = sum(n for s, n in sources.items() if s not in mixing.WEIGHTS)
    out = {}
    for r in docs:
        n = sources[r.source]
        share = mixing.WEIGHTS.get(r.source, (1 - named) * n / others)
        mean = share * len(docs) / n
        u = int(hashlib.md5(f"draw:{mixing.SEED}:1:{r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        k, p = 0, math.exp(-mean)
        total = p
        while total <= u:
            k += 1
            p *= mean / k
            total += p
        out[r.doc_id] = k
    return out


ODD = "doc_id long, text string, lang string, source string, n_chars long, replica string, measures int"


def test_stages_on_odd_rows_and_empty_tables(spark):
    """Nulls in any column, empty texts, repeated rows and ids, columns with the stages' own names."""
    long, other = (" ".join(f"w{(k * j) % 997}" for k in range(120)) for j in (7, 13))
    item = table(spark, DATA, "benchmark").orderBy("item_id").first().text
    rows = [(1, long), (1, long), (2, long + " end"), (None, other), (None, f"{long[:300]} {item} {other[:300]}"), (None, None), (4, ""), (5, " \n"), (6, "few words")]
    docs = spark.createDataFrame([(d, t, None, None if d == 2 else "s", None, "r", k) for k, (d, t) in enumerate(rows)], ODD)
    good = corpus_pipeline.quality_rules(spark, docs, DATA)
    assert good.columns == docs.columns and sorted(r.measures for r in good.collect()) == [0, 1, 2, 3, 4]
    one = [r.measures for r in corpus_pipeline.near_duplicates(spark, docs, DATA).collect()]
    assert len(set(one) & {0, 1}) == 1 and 2 not in one and set(range(3, 9)) <= set(one)
    clean = corpus_pipeline.decontamination(spark, docs, DATA)
    assert clean.columns == docs.columns and sorted(r.measures for r in clean.collect()) == [0, 1, 2, 3, 5, 6, 7, 8]
    mixed = corpus_pipeline.source_mixing(spark, docs, DATA)
    assert mixed.columns == docs.columns and {r.replica for r in mixed.collect()} == {"r"}
    made = corpus_pipeline.tokens(spark, docs, DATA).orderBy("start").collect()
    assert [r.doc_id for r in made] == [d for d, _ in rows] and [made[k].n_tokens for k in (5, 6, 7)] == [1, 1, 1]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DATA).collect() == [], name


def test_stages(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = table(spark, DATA, "documents")
    scratch = Scratch(spark, "test")
    seen = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, DATA), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append(docs.collect())
    ids = [Counter(r.doc_id for r in rows) for rows in seen]
    good = {r.doc_id for r in seen[0] for n, _, _, _, again in [measures(r.text)] if n >= 50 and 100 * again <= 50 * n}
    assert set(ids[1]) == good
    pairs = [(r.doc_id, r.text) for r in seen[1]]
    assert set(ids[2]) == {d for (d, _), (_, c, _) in zip(pairs, jaccard(pairs), strict=True) if c == d}
    items = [r.text for r in table(spark, DATA, "benchmark").collect()]
    assert set(ids[3]) == {r.doc_id for r in seen[2] if not any(i in r.text for i in items)}
    assert ids[4] == Counter({d: k for d, k in plain_counts(seen[3]).items() if k})

    tok = Tokenizer.from_file(public_tokenizers.path(token_output.TOKENIZER))
    want = Counter((r.doc_id, zlib.crc32(np.array([*tok.encode(r.text, add_special_tokens=False).ids, 1], "<u4").tobytes())) for r in seen[4])
    got = corpus_pipeline.run(spark, DATA).collect()
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == want
    got.sort(key=lambda r: r.start)
    near = sum(abs(a.doc_id - b.doc_id) <= 1 for a, b in zip(got[:-1], got[1:], strict=True))
    assert near < 0.1 * len(got)  # the shuffle's order, not that of the ids
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]
