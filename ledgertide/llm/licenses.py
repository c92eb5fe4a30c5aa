"""Operator 7, license scans: ordered signature rules.

The rules are regular expressions made from families of licenses, their versions and the
forms in which texts name them.  A rule runs only on texts that hold one of its keywords
as a run of ASCII letters (less a v before a digit), which every match of its pattern has;
a detection whose interval lies inside another's of a higher or equal priority is
suppressed.  Besides, the places of the base phrases are counted on all texts, by
hashes of consecutive words that are then compared in full.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ledgertide.llm.bytekit import FOLD, FOLDED_VALUES, byte_class, prefix_hashes, runs, slices, span_hashes
from ledgertide.llm.shared import table

WORD = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
LETTER = byte_class((0x41, 0x5A), (0x61, 0x7A))
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: label, full name (regex), short name (regex), SPDX stem, URL path, versions, keywords
FAMILIES = [
    ("gpl", r"gnu\s+general\s+public\s+licen[sc]e", r"(?:gnu\s+)?gpl", "GPL", r"gnu\.org/licenses/(?:old-licenses/)?gpl", ("1.0", "2.0", "3.0"), "gnu gpl"),
    ("lgpl", r"gnu\s+(?:lesser|library)\s+general\s+public\s+licen[sc]e", r"lgpl", "LGPL", r"gnu\.org/licenses/(?:old-licenses/)?lgpl", ("2.0", "2.1", "3.0"), "gnu lgpl"),
    ("agpl", r"gnu\s+affero\s+general\s+public\s+licen[sc]e", r"agpl", "AGPL", r"gnu\.org/licenses/agpl", ("1.0", "3.0"), "gnu affero agpl"),
    ("gfdl", r"gnu\s+free\s+documentation\s+licen[sc]e", r"gfdl", "GFDL", r"gnu\.org/licenses/fdl", ("1.1", "1.2", "1.3"), "gnu gfdl fdl"),
    ("apache", r"apache\s+(?:software\s+)?licen[sc]e", r"apache|asl", "Apache", r"apache\.org/licenses/license", ("1.0", "1.1", "2.0"), "apache asl"),
    ("mpl", r"mozilla\s+public\s+licen[sc]e", r"mpl", "MPL", r"mozilla\.org/(?:mpl|en-us/mpl)/", ("1.0", "1.1", "2.0"), "mozilla mpl"),
    ("epl", r"eclipse\s+public\s+licen[sc]e", r"epl", "EPL", r"eclipse\.org/legal/epl", ("1.0", "2.0"), "eclipse epl"),
    ("cddl", r"common\s+development\s+and\s+distribution\s+licen[sc]e", r"cddl", "CDDL", r"opensource\.org/licenses/cddl", ("1.0", "1.1"), "cddl distribution opensource"),
    ("eupl", r"european\s+union\s+public\s+licen[sc]e", r"eupl", "EUPL", r"joinup\.ec\.europa\.eu/[\w/]*eupl", ("1.0", "1.1", "1.2"), "european eupl joinup"),
    ("artistic", r"artistic\s+licen[sc]e", r"artistic", "Artistic", r"opensource\.org/licenses/artistic-license", ("1.0", "2.0"), "artistic opensource"),
    ("ofl", r"(?:sil\s+)?open\s+font\s+licen[sc]e", r"ofl", "OFL", r"scripts\.sil\.org/ofl", ("1.0", "1.1"), "font ofl sil"),
    ("bsl", r"boost\s+software\s+licen[sc]e", r"bsl", "BSL", r"boost\.org/license", ("1.0",), "boost bsl"),
    ("zpl", r"zope\s+public\s+licen[sc]e", r"zpl", "ZPL", r"zope\.org/resources/zpl", ("1.1", "2.0", "2.1"), "zope zpl"),
    ("psf", r"python\s+(?:software\s+foundation\s+)?licen[sc]e", r"psf", "PSF", r"python\.org/psf/license", ("2.0",), "python psf"),
    ("odbl", r"open\s+(?:data\s+commons\s+)?(?:open\s+)?database\s+licen[sc]e", r"odbl", "ODbL", r"opendatacommons\.org/licenses/odbl", ("1.0",), "database odbl opendatacommons"),
    ("osl", r"open\s+software\s+licen[sc]e", r"osl", "OSL", r"opensource\.org/licenses/osl", ("1.0", "1.1", "2.0", "2.1", "3.0"), "osl software opensource"),
    ("ms-pl", r"microsoft\s+(?:public|reciprocal)\s+licen[sc]e", r"ms-[pr]l", "MS", r"opensource\.org/licenses/ms-[pr]l", (), "microsoft ms opensource"),
    ("mit", r"mit\s+licen[sc]e|licen[sc]ed?\s+under\s+(?:the\s+)?(?:terms\s+of\s+(?:the\s+)?)?mit", r"mit/x11|expat", "MIT", r"opensource\.org/licenses/mit", (), "mit expat opensource"),
    ("isc", r"isc\s+licen[sc]e", r"isc-style", "ISC", r"opensource\.org/licenses/isc", (), "isc opensource"),
    ("zlib", r"zlib(?:/libpng)?\s+licen[sc]e", r"zlib/libpng", "Zlib", r"zlib\.net/zlib_license", (), "zlib"),
    ("unlicense", r"(?:the\s+)?unlicen[sc]e", r"unlicen[sc]ed", "Unlicense", r"unlicense\.org", (), "unlicense unlicence unlicensed unlicenced"),
    ("wtfpl", r"do\s+what\s+the\s+f\w+\s+you\s+want\s+to\s+public\s+licen[sc]e", r"wtfpl", "WTFPL", r"wtfpl\.net", (), "wtfpl want"),
    ("postgresql", r"postgresql\s+licen[sc]e", r"postgres-style", "PostgreSQL", r"postgresql\.org/about/licence", (), "postgresql postgres"),
]
CREATIVE = ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd")
CREATIVE_WORDS = {"by": "attribution", "sa": "share\\W?alike", "nc": "non\\W?commercial", "nd": "no\\W?deriv(?:ative)?s?"}
CREATIVE_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
SPDX, URL, VERSIONED, NAME, SHORT, GENERAL = 6, 5, 4, 3, 2, 1
CONFIDENCE = {SPDX: 1.0, URL: 0.95, VERSIONED: 0.9, NAME: 0.8, SHORT: 0.6, GENERAL: 0.3}


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    keywords: frozenset
    pattern: re.Pattern


def _version(v: str) -> str:
    """2.0 as 2 or 2.0."""
    return re.escape(v.removesuffix(".0")) + (r"(?:\.0)?" if v.endswith(".0") else "") + r"(?![\d.]*\d)"


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules, the highest priority first."""
    out = []

    def add(label: str, priority: int, keywords: str, pattern: str) -> None:
        out.append(Rule(label, priority, frozenset(keywords.split()), re.compile(r"(?<![a-z0-9])(?:" + pattern + r")(?![a-z0-9])", re.ASCII)))

    for label, name, short, spdx, url, versions, keywords in FAMILIES:
        tag = re.escape(spdx.lower())
        for v in versions:
            own = f"{label}-{v}"
            add(own, SPDX, "spdx", rf"spdx-license-identifier:\s*{tag}-{_version(v)}(?:-only|-or-later|\+)?")
            add(own, URL, keywords, rf"(?:https?://)?(?:www\.)?{url}[-/]?v?{_version(v)}(?:\.html|\.txt|/)?")
            add(own, VERSIONED, keywords, rf"(?:{name}),?\s+(?:v|version\s+){_version(v)}|(?:{name})\s+{_version(v)}")
            add(own, VERSIONED, keywords, rf"(?:{short})[-\s]?v?{_version(v)}\+?")
        add(label, SPDX, "spdx", rf"spdx-license-identifier:\s*{tag}")
        add(label, URL, keywords, rf"(?:https?://)?(?:www\.)?{url}[\w./-]*")
        add(label, NAME, keywords, name)
        add(label, SHORT, keywords, rf"(?:{short})\s+licen[sc]ed?|licen[sc]ed?\s+under\s+(?:the\s+)?(?:{short})")
    for n in (0, 1, 2, 3, 4):
        add(f"bsd-{n}-clause", SPDX, "spdx", rf"spdx-license-identifier:\s*bsd-{n}-clause")
        add(f"bsd-{n}-clause", VERSIONED, "bsd", rf"(?:bsd[-\s]{n}[-\s]clause|{n}[-\s]clause\s+bsd)(?:\s+licen[sc]e)?")
    add("bsd", NAME, "bsd", r"bsd(?:[-\s]style)?\s+licen[sc]e")
    for kind in CREATIVE:
        spaced = kind.replace("-", r"[-\s]")
        spelled = r"\W+".join(CREATIVE_WORDS[x] for x in kind.split("-"))
        for v in CREATIVE_VERSIONS:
            own = f"cc-{kind}-{v}"
            add(own, SPDX, "spdx", rf"spdx-license-identifier:\s*cc-{kind}-{_version(v)}")
            add(own, URL, "creativecommons", rf"(?:https?://)?(?:www\.)?creativecommons\.org/licenses/{kind}/{_version(v)}/?")
            add(own, VERSIONED, "cc", rf"cc[-\s]{spaced}[-\s]?v?{_version(v)}")
            add(own, VERSIONED, "creative", rf"creative\s+commons\s+{spelled}\W+(?:licen[sc]e\W+)?(?:v|version\s+)?{_version(v)}")
        add(f"cc-{kind}", URL, "creativecommons", rf"(?:https?://)?(?:www\.)?creativecommons\.org/licenses/{kind}(?=[/\s]|$)")
        add(f"cc-{kind}", NAME, "cc", rf"cc[-\s]{spaced}(?![-\s](?:sa|nc|nd)(?![a-z0-9]))")
        add(f"cc-{kind}", NAME, "creative", rf"creative\s+commons\s+{spelled}")
    add("cc0", SPDX, "spdx", r"spdx-license-identifier:\s*cc0-1\.0")
    add("cc0", URL, "creativecommons", r"(?:https?://)?(?:www\.)?creativecommons\.org/publicdomain/zero/1\.0/?")
    add("cc0", NAME, "cc", r"cc0(?:[-\s]1\.0)?")
    add("public-domain", NAME, "domain", r"(?:in|into|to)\s+the\s+public\s+domain")
    add("proprietary", NAME, "rights", r"all\s+rights\s+reserved")
    add("copyright", GENERAL, "copyright", r"copyright\s+(?:\(c\)\s*)?(?:19|20)\d\d")
    add("unknown", GENERAL, "license licence licensed licenced", r"licen[sc]ed?\s+under\s+(?:the\s+)?[\w.-]+")
    return tuple(sorted(out, key=lambda r: -r.priority))


def outermost(found: list[tuple[int, int, str, int]]) -> list[tuple[int, int, str, int]]:
    """Of (start, end, label, priority) those that lie in no other's interval of a higher or equal
    priority, by start; of equal intervals and priorities the first label stays."""
    furthest = [-1] * (SPDX + 1)  # the greatest end so far of each priority or a higher one
    kept = []
    for d in sorted(found, key=lambda d: (d[0], -d[1], -d[3], d[2])):
        # only what begins no later and ends no earlier can contain it
        if furthest[d[3]] < d[1]:
            kept.append(d)
            furthest[: d[3] + 1] = [max(d[1], e) for e in furthest[: d[3] + 1]]
    return kept


def detect(text: str, words: set[str]) -> list[tuple[int, int, str, int]]:
    """(start, end, label, priority) of what stays, by start; words: the text's keywords."""
    low = text.translate(_LOWER)
    return outermost([(m.start(), m.end(), r.label, r.priority) for r in rules() if r.keywords & words for m in r.pattern.finditer(low)])


_LOWER = {c: c + 32 for c in range(65, 91)}


def _word_hash(word: str) -> np.uint64:
    raw = np.frombuffer(word.encode(), np.uint8)
    return span_hashes(prefix_hashes(raw, FOLDED_VALUES), np.array([0]), np.array([len(raw)]))[0]


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, spans (array of start, end in characters, label, priority), a row for each row.

    Words: A-Z lower-cased, runs of a-z, 0-9 and non-ASCII characters.  n_base counts the
    places where a base phrase's words stand one after another; first_word and last_word
    are the smallest and largest of them, null without any.  labels joins base labels and
    detections', distinct and sorted; score is the greatest confidence of all (0: none).
    Null and empty texts have no words.  Other columns are ignored, whatever their names; an empty
    table gives one.
    """
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("priority", pa.int32())]))
    keywords = sorted({k for r in rules() for k in r.keywords})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = np.array([_word_hash(k) for k in keywords])
        by_hash = np.argsort(hashes)
        ordered = hashes[by_hash]
        phrases = [(p.split(), [_word_hash(w) for w in p.split()], label) for p, label in BASE.items()]
        for batch in batches:
            for piece in slices(batch.column(1)):
                starts, ends, first = runs(piece, WORD)
                prefix = prefix_hashes(piece.data, FOLDED_VALUES)
                words = span_hashes(prefix, starts, ends)
                owner = np.repeat(np.arange(len(piece)), np.diff(first))
                places: dict[int, list[int]] = {}
                base: dict[int, set[str]] = {}
                for spelled, parts, label in phrases:
                    at = np.flatnonzero(words[: max(0, len(words) - len(parts) + 1)] == parts[0])
                    for k in range(1, len(parts)):
                        at = at[words[at + k] == parts[k]]
                    at = at[owner[at] == owner[at + len(parts) - 1]]
                    for i in at.tolist():
                        if all(FOLD[piece.data[starts[i + k] : ends[i + k]]].tobytes() == spelled[k].encode() for k in range(len(parts))):
                            places.setdefault(int(owner[i]), []).append(i - int(first[owner[i]]))
                            base.setdefault(int(owner[i]), set()).add(label)
                begins, stops, first_run = runs(piece, LETTER)
                after = np.append(piece.data, 0)[stops]
                stops = stops - ((FOLD[piece.data[stops - 1]] == ord("v")) & (after >= 0x30) & (after <= 0x39))
                letters = span_hashes(prefix, begins, stops)
                spot = np.searchsorted(ordered, letters)
                spot[spot == len(ordered)] = 0
                hit = np.flatnonzero(ordered[spot] == letters)
                has: dict[int, set[str]] = {}
                for i, k in zip(np.repeat(np.arange(len(piece)), np.diff(first_run))[hit].tolist(), by_hash[spot[hit]].tolist(), strict=True):
                    has.setdefault(i, set()).add(keywords[k])
                out: tuple[list, ...] = ([], [], [], [], [], [], [], [])
                for i in range(len(piece)):
                    found = detect(piece.bytes_of(i).decode("utf-8", "replace"), has[i]) if i in has else []
                    own, at = base.get(i, set()), places.get(i, [])
                    score = max([CONFIDENCE[NAME] if own else 0.0, *(CONFIDENCE[d[3]] for d in found)])
                    row = (int(first[i + 1] - first[i]), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(own)), ",".join(sorted(own | {d[2] for d in found})), score, [{"start": d[0], "end": d[1], "label": d[2], "priority": d[3]} for d in found])
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), span_type]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.rows.start, len(piece)), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc_type}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start: bigint, end: bigint, label: string, priority: int>>")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document."""
    return scan(table(spark, sf_dir, "documents")).drop("spans")
