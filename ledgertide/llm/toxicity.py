"""Operator 13, toxicity: a weighted finite-state pattern grammar over clauses.

Words and signs become tags (insult, threat, target, negation, reporting verb, quote, ends of
clauses, sentences and lines).  Small transducers rewrite them: one marks what stands under a
negation, one what is reported or quoted, one insults with a target before them, one makes a
threat of a threatening verb and its target.  They are composed into one table, which is run
over the lines that hold an insult or such a verb.  Each clause counts by its strongest pattern,
and a document's score is the logistic of the patterns' weights by the logarithms of their
counts.

The grammar and its words are written here, for four languages.  A bounded sample of labelled
rows (``max_train``, those with the smallest hash of doc_id) adds stems of insults, beginnings
of words that stand in toxic documents far more often than not, and fits the weights about
the grammar's own.  Every document is scored in one pass without a shuffle of texts.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgertide.llm.bytekit import FOLD, Slice, byte_class, mix, ngram_hashes, slices, summed_hashes, word_hashes, word_sums
from ledgertide.llm.quality_model import sigmoid
from ledgertide.llm.shared import Scratch, table

MAX_TRAIN = 8_000
THRESHOLD = 0.7
#: A learnt stem: its share of toxic documents is at least LEARNT_SHARE, and surely (by so many deviations) BOUND.
DEVIATIONS, LEARNT_SHARE, BOUND = 2.5, 0.9, 0.5
#: A stem gives way to a longer one that has so much of its toxic documents and fewer others.
HEIR = 0.9
#: Bytes of a stem.
STEM = range(4, 13)
SKETCHES = 4
PULL = 0.2

OTHER, INSULT, VERB, TARGET, NOT, SAID, QUOTE, CLAUSE, SENTENCE, LINE, THREAT = range(11)
NEGATED, REPORTED, AIMED = 1, 2, 4

# the grammar's words: English, German, French, Spanish
LEXICON = {
    INSULT: """idiot idiots idiotic moron morons moronic stupid dumb dumbass fool fools imbecile cretin loser losers pathetic worthless useless
        disgusting disgrace scum scumbag vermin trash garbage filth filthy clown clowns pig swine bastard bastards bitch whore slut coward creep freak
        asshole jerk jackass retard retarded degenerate parasite subhuman
        idioten dumm dummkopf trottel depp versager abschaum dreckskerl schwein arschloch wertlos widerlich erbärmlich
        imbécile crétin débile connard salaud ordure minable pathétique nul dégoûtant
        estúpido imbécil inútil basura escoria patético asqueroso payaso cabrón""",
    VERB: """kill murder hurt destroy shoot stab beat burn hang strangle slaughter crush punch smash töten umbringen vernichten tuer détruire frapper brûler matar destruir golpear quemar""",
    TARGET: """you your yours yourself you're you’re u ya y'all they they're they’re he's she's them their him her his she he these those people everyone dich dir euch sie ihr du ihn tu te toi vous ton votre lui leur tú ti usted ustedes él ella ellos""",
    NOT: """not no never neither nor without isn't aren't wasn't weren't don't doesn't didn't won't can't cannot couldn't shouldn't ain't isn’t aren’t don’t doesn’t won’t can’t hardly
        nicht kein keine nie niemals ohne ne pas jamais sans nunca jamás sin tampoco""",
    SAID: """said says say saying quoted quotes quote wrote writes claimed claims claiming called reported reports stated states alleged replied tweeted told according
        sagte sagt schrieb behauptet laut dit écrit affirme selon dijo dice escribió afirma según""",
}
SCOPE, REACH, GRASP = 4, 4, 3

_WORD = byte_class((0x27, 0x27), (0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_SIGN = np.zeros(256, np.int8)
for _signs, _tag in (('"', QUOTE), (",;:()", CLAUSE), (".!?", SENTENCE), ("\n\r", LINE)):
    for _c in _signs:
        _SIGN[ord(_c)] = _tag

Symbol = tuple[int, int]
Step = Callable[[Hashable, Symbol], tuple[Hashable, Symbol]]


def under_negation(left: int, x: Symbol) -> tuple[int, Symbol]:
    tag, marks = x
    if tag in (CLAUSE, SENTENCE, LINE):
        return 0, x
    if tag == NOT:
        return SCOPE, x
    return max(0, left - 1), ((tag, marks | NEGATED) if left and tag in (INSULT, VERB) else x)


def in_report(inside: int, x: Symbol) -> tuple[int, Symbol]:
    """inside: 1 in quotes, 2 after a reporting verb, until its sentence ends; a line ends both."""
    tag, marks = x
    if tag == LINE or (tag == SENTENCE and inside == 2):
        return 0, x
    if tag == QUOTE:
        return int(inside != 1), x
    if tag == SAID and not inside:
        return 2, x
    return inside, ((tag, marks | REPORTED) if inside and tag in (INSULT, VERB) else x)


def at_target(left: int, x: Symbol) -> tuple[int, Symbol]:
    tag, marks = x
    if tag in (SENTENCE, LINE):
        return 0, x
    if tag == TARGET:
        return REACH, x
    return max(0, left - 1), ((tag, marks | AIMED) if left and tag == INSULT else x)


def as_threat(verb: tuple[int, int], x: Symbol) -> tuple[tuple[int, int], Symbol]:
    """verb: how far it still reaches, and its marks."""
    tag, marks = x
    left, held = verb
    if tag == VERB:
        return (GRASP, marks), x
    if tag in (CLAUSE, SENTENCE, LINE) or not left:
        return (0, 0), x
    return ((0, 0), (THREAT, held)) if tag == TARGET else ((left - 1, held if left > 1 else 0), x)


GRAMMAR: list[tuple[Hashable, Step]] = [(0, under_negation), (0, in_report), (0, at_target), ((0, 0), as_threat)]
PATTERNS = [(tag, marks) for tag in (INSULT, THREAT) for marks in range(8)]
PRIOR = np.array([max(0.25, {INSULT: 4.5, THREAT: 5.0}[t] - 3.5 * bool(m & NEGATED) - 2.5 * bool(m & REPORTED) + 1.0 * bool(m & AIMED)) for t, m in PATTERNS])
PRIOR_BIAS = -3.0


def compose(steps: list[tuple[Hashable, Step]]) -> tuple[list[list[int]], list[list[int]]]:
    """The transducers one after another as one: by state and tag the next state, and the pattern that
    is written (-1: none).  Only states that can be reached from the first are made."""
    first = tuple(s for s, _ in steps)
    number, after, wrote = {first: 0}, [], []
    todo = [first]
    for state in todo:  # grows
        row, out = [], []
        for tag in range(THREAT):
            x: Symbol = (tag, 0)
            new = []
            for own, (_, step) in zip(state, steps, strict=True):
                own, x = step(own, x)
                new.append(own)
            key = tuple(new)
            if key not in number:
                number[key] = len(number)
                todo.append(key)
            row.append(number[key])
            out.append(PATTERNS.index(x) if x in PATTERNS else -1)
        after.append(row)
        wrote.append(out)
    return after, wrote


@cache
def machine() -> tuple[list[list[int]], list[list[int]]]:
    return compose(GRAMMAR)


def hash_of(word: str) -> np.uint64:
    raw = FOLD[np.frombuffer(word.encode(), np.uint8)]
    return word_hashes(raw, np.array([0]), np.array([len(raw)]))[0]


class Vocabulary:
    """Tags by hash: the grammar's words, and stems, which tag the words that begin with them (unless the
    grammar has the word)."""

    def __init__(self, stems: list[str]):
        tags = {int(hash_of(w)): tag for tag, words in LEXICON.items() for w in words.split()}
        self.keys = np.array(sorted(tags), np.uint64)
        self.tags = np.array([tags[int(k)] for k in self.keys], np.int8)
        self.stems = {n: np.sort(np.array([hash_of(x) for x in stems if len(x.encode()) == n], np.uint64)) for n in sorted({len(x.encode()) for x in stems})}

    def of(self, tokens: "Tokens") -> np.ndarray:
        spot = np.searchsorted(self.keys, tokens.keys)
        spot[spot == len(self.keys)] = 0
        own = np.where(self.keys[spot] == tokens.keys, self.tags[spot], OTHER)
        for length, stems in self.stems.items():
            at, keys = tokens.stems(length)
            at = at[_among(keys, stems)]
            own[at[own[at] == OTHER]] = INSULT
        return own


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    spot = np.searchsorted(known, keys)
    spot[spot == len(known)] = 0
    return known[spot] == keys if len(known) else np.zeros(len(keys), bool)


class Tokens:
    """Words of a slice, with their hashes, and its signs."""

    def __init__(self, piece: Slice):
        data = FOLD[piece.data]
        kind = np.where(_WORD[data], -1, _SIGN[data]).astype(np.int8)
        guillemet = np.flatnonzero((data[:-1] == 0xC2) & ((data[1:] == 0xAB) | (data[1:] == 0xBB)))
        kind[guillemet], kind[guillemet + 1] = QUOTE, OTHER
        curly = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x80) & (data[2:] >= 0x9C) & (data[2:] <= 0x9F))
        kind[curly], kind[curly + 1], kind[curly + 2] = QUOTE, OTHER, OTHER
        inside = np.concatenate([[False], kind == -1, [False]])
        edge = inside[1:] != inside[:-1]
        cut = np.zeros(len(data) + 1, bool)
        cut[piece.offsets] = True
        self.starts = np.flatnonzero((edge | cut)[:-1] & inside[1:-1]) if len(data) else np.zeros(0, np.int64)
        self.ends = np.flatnonzero((edge | cut)[1:] & inside[1:-1]) + 1 if len(data) else np.zeros(0, np.int64)
        self.data = data
        self.sums = word_sums(data, self.starts)
        self.keys = summed_hashes(self.sums, self.starts, self.ends)
        self.first = np.searchsorted(self.starts, piece.offsets)
        self.signs = np.flatnonzero(kind > 0)
        self.sign_tags = kind[self.signs]

    def stems(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Which words have so many bytes, and the hashes of their first ones."""
        at = np.flatnonzero(self.ends - self.starts >= length)
        return at, summed_hashes(self.sums, self.starts[at], self.starts[at] + length)


Match = tuple[int, int, int, int]


def matches(piece: Slice, known: Vocabulary) -> Iterator[list[Match]]:
    """Each text's matched clauses: start, end (bytes), the strongest pattern's number and how many the
    clause has of it."""
    tokens = Tokens(piece)
    of_word = known.of(tokens)
    hot = (of_word == INSULT) | (of_word == VERB)
    hits = np.concatenate([[0], np.cumsum(hot)])
    after, wrote = machine()
    for i in range(len(piece)):
        a, b = tokens.first[i], tokens.first[i + 1]
        if hits[a] == hits[b]:
            yield []
            continue
        base, end = int(piece.offsets[i]), int(piece.offsets[i + 1])
        c, d = np.searchsorted(tokens.signs, [base, end])
        at = np.concatenate([tokens.starts[a:b], tokens.signs[c:d]])
        kind = np.concatenate([of_word[a:b], tokens.sign_tags[c:d]])
        stop = np.concatenate([tokens.ends[a:b], tokens.signs[c:d] + 1])
        order = np.argsort(at)
        at, kind, stop = at[order], kind[order], stop[order]
        # lines without an insult or a verb can't match; every line begins in the first state
        line = np.cumsum(kind == LINE)
        some = np.isin(line, line[(kind == INSULT) | (kind == VERB)])
        found: list[Match] = []
        state, best, many, clause = 0, -1, 0, None
        for tag, start, past in zip(kind[some].tolist(), at[some].tolist(), stop[some].tolist(), strict=True):
            pattern = wrote[state][tag]
            state = after[state][tag]
            if tag == CLAUSE or tag == SENTENCE or tag == LINE:
                if best >= 0:
                    found.append((clause - base, last - base, best, many))
                best, many, clause = -1, 0, None
                continue
            if clause is None:
                clause = start
            last = past
            if pattern >= 0 and (best < 0 or PRIOR[pattern] > PRIOR[best]):
                best, many = pattern, 0
            many += pattern == best >= 0
        if best >= 0:
            found.append((clause - base, last - base, best, many))
        yield found


def evidence(found: list[Match]) -> np.ndarray:
    """For each pattern the logarithm (to base 2) of one more than its places in clauses."""
    return np.log2(1 + np.bincount([m[2] for m in found], weights=[m[3] for m in found], minlength=len(PATTERNS)))


def fitted(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weights and, last, the bias: logistic, pulled towards the grammar's own by ``PULL``."""
    prior = np.append(PRIOR, PRIOR_BIAS)
    pull = np.append(np.full(len(PRIOR), PULL), 0.01)
    x = np.hstack([x, np.ones((len(x), 1))])
    w = prior.copy()
    for _ in range(rounds):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(pull), x.T @ (p - y) + pull * (w - prior))
        w = w - step / max(1.0, float(np.abs(step).max()) / 2)
        if np.abs(step).max() < 1e-9:
            break
    w[:-1] = np.maximum(w[:-1], 0)
    return w


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def sample(docs: DataFrame, labels: DataFrame, max_train: int) -> DataFrame:
    """turn, text, toxic (0 or 1) of the rows to learn from."""
    chosen = labels.select(F.col("doc_id").alias("labelled"), (F.col("toxic") > 0).cast("int").alias("toxic")).where(F.col("toxic").isNotNull() & F.col("labelled").isNotNull() & ~held_out(F.col("labelled"))).distinct()
    chosen = chosen.withColumn("turn", F.xxhash64(F.col("labelled").cast("string"))).orderBy("turn", "labelled", "toxic").limit(max_train)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled"))
    return rows.groupBy("turn", "labelled", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("turn", "text", "toxic")


def distinct_rows(rows: DataFrame) -> DataFrame:
    """The rows (turn, text, toxic), of near copies of each other the first alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch.column(1)):
                tokens = Tokens(piece)
                sketch = []
                for i in range(len(piece)):
                    keys = tokens.keys[tokens.first[i] : tokens.first[i + 1]]
                    grams = ngram_hashes(keys, min(5, len(keys))) if len(keys) else keys
                    sketch.append([int(mix(grams ^ np.uint64(s)).view(np.int64).min()) for s in range(1, SKETCHES + 1)] if len(grams) else [])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.rows.start, len(piece)), pa.array(sketch, pa.list_(pa.int64()))], ["turn", "sketch"])

    least = rows.select("turn", "text").mapInArrow(run, "turn long, sketch array<long>").select("turn", F.posexplode("sketch").alias("place", "least"))
    copies = least.join(least.groupBy("place", "least").agg(F.min("turn").alias("one")), ["place", "least"]).where("one <> turn").select("turn")
    return rows.join(copies, "turn", "left_anti")


def _sure(k: Column, n: Column) -> Column:
    """Whether k of n is a learnt share, and surely (Wilson's lower bound) above ``BOUND``."""
    z, share = DEVIATIONS**2, k / n
    low = (share + z / (2 * n) - DEVIATIONS * F.sqrt(share * (1 - share) / n + z / (4 * n * n))) / (1 + z / n)
    return (k > 0) & (share >= LEARNT_SHARE) & (low >= BOUND)


def learnt_stems(rows: DataFrame) -> list[str]:
    """Beginnings of words that toxic rows hold far more often than others.

    A stem's counts are of rows (near copies of each other count once), and in toxic rows also of
    the words that stand before its words, and after them, for a copied passage brings the
    same ones along; the least counts.
    """

    def per_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(2).to_numpy()
            for piece in slices(batch.column(1)):
                tokens = Tokens(piece)
                row = np.repeat(np.arange(len(piece)), np.diff(tokens.first))
                for length in STEM:
                    at, keys = tokens.stems(length)
                    each = np.unique(np.stack([keys, row[at].astype(np.uint64)], axis=1), axis=0)
                    stems, spot, n = np.unique(each[:, 0], return_inverse=True, return_counts=True)
                    bad = np.bincount(spot, weights=toxic[piece.rows][each[:, 1].astype(np.int64)], minlength=len(stems)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(stems.view(np.int64)), pa.array(bad), pa.array(n)], ["stem", "bad", "n"])

    counts = rows.select("turn", "text", "toxic").mapInArrow(per_row, "stem long, bad long, n long").groupBy("stem").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    likely = counts.where(_sure(F.col("bad"), F.col("n"))).collect()  # a stem has some rows of the bounded sample
    known = np.sort(np.array([r.stem for r in likely], np.int64).view(np.uint64))

    def per_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch.column(1)):
                tokens = Tokens(piece)
                row = np.repeat(np.arange(len(piece)), np.diff(tokens.first))
                padded = np.concatenate([[np.uint64(0)], tokens.keys, [np.uint64(0)]]).view(np.int64)
                for length in STEM:
                    at, keys = tokens.stems(length)
                    at = at[_among(keys, known)]
                    toxic = batch.column(2).slice(piece.rows.start, len(piece)).take(pa.array(row[at]))
                    stems = [tokens.data[a : a + length].tobytes() for a in tokens.starts[at].tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(stems, pa.binary()), toxic, pa.array(padded[at]), pa.array(padded[at + 2])], ["stem", "toxic", "before", "after"])

    seen = rows.select("turn", "text", "toxic").mapInArrow(per_place, "stem binary, toxic int, before long, after long").where("toxic = 1")
    sides = [seen.groupBy("stem").agg(F.count_distinct(c).alias(c)) for c in ("before", "after")]
    places = {bytes(r.stem): min(r.before, r.after) for r in sides[0].join(sides[1], "stem").collect()}
    by_key = {r.stem: (r.bad, r.n) for r in likely}
    found = {}
    for stem, n in places.items():
        bad, all_ = by_key[int(word_hashes(np.frombuffer(stem, np.uint8), np.array([0]), np.array([len(stem)])).view(np.int64)[0])]
        k = min(bad, n)
        if k >= DEVIATIONS**2 * BOUND / (1 - BOUND):
            found[stem] = (k, all_ - bad)
    return chosen(found)


def chosen(found: dict[bytes, tuple[int, int]]) -> list[str]:
    """Of stems with their toxic and other rows: the shortest, but one with others gives way to a longer
    one that has nearly all its toxic rows and fewer others.  Cut characters are left out."""
    out: list[bytes] = []
    for stem in sorted(found, key=lambda x: (len(x), x)):
        k, m = found[stem]
        if any(stem.startswith(x) for x in out) or any(q.startswith(stem) and q != stem and found[q][0] >= HEIR * k and found[q][1] < m for q in found):
            continue
        out.append(stem)
    return [x.decode() for x in out if x.decode("utf-8", "ignore").encode() == x]


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> tuple[list[str], np.ndarray]:
    """Learnt stems and weights, from labelled rows that aren't held out.

    Rows without a label or doc_id are skipped; of labels that say the same of a doc_id, and of
    documents that share one, one counts (the text with the smallest hash).  Without any
    label the grammar's own words and weights hold.  Other columns are ignored.
    """
    rows = Scratch(docs.sparkSession, "toxic").save(sample(docs, labels, max_train), "sample")
    stems = learnt_stems(distinct_rows(rows))
    known = Vocabulary(stems)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch.column(1)):
                part = batch.slice(piece.rows.start, len(piece))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([evidence(m).tolist() for m in matches(piece, known)], pa.list_(pa.float64()))], ["turn", "toxic", "x"])

    # at most max_train rows of a few numbers
    examples = rows.select("turn", "text", "toxic").mapInArrow(run, "turn long, toxic int, x array<double>").collect()
    examples.sort(key=lambda r: (r.turn, r.toxic, r.x))
    if not examples:
        return stems, np.append(PRIOR, PRIOR_BIAS)
    return stems, fitted(np.array([r.x for r in examples]), np.array([r.toxic for r in examples]))


def score(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """(doc_id, text) -> doc_id, score (0 to 1), clauses (array of start and end in bytes, pattern,
    weight), a row for each row.  Null and empty texts, and any without a match, get the
    bias's score.  Other columns are ignored; an empty table gives one."""
    stems, weights = model
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    known = Vocabulary(stems)
    names = ["-".join([{INSULT: "insult", THREAT: "threat"}[t], *(n for bit, n in ((NEGATED, "negated"), (REPORTED, "reported"), (AIMED, "aimed")) if m & bit)]) for t, m in PATTERNS]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("pattern", pa.string()), ("weight", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch.column(1)):
                found = list(matches(piece, known))
                margins = np.array([weights[:-1] @ evidence(m) + weights[-1] if m else weights[-1] for m in found])
                clauses = [[{"start": a, "end": b, "pattern": names[k], "weight": float(weights[k])} for a, b, k, _ in m] for m in found]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.rows.start, len(piece)), pa.array(sigmoid(margins), pa.float64()), pa.array(clauses, kind)], ["doc_id", "score", "clauses"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc_type}, score double, clauses array<struct<start: bigint, end: bigint, pattern: string, weight: double>>")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
