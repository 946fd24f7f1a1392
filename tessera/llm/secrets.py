"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

Two first-order Markov models over characters are trained from labelled samples, one on random strings and one on
ordinary identifiers: words of the documents, alone and put together as identifiers are. A run of identifier characters
is a secret if its mean log-likelihood ratio, per character, lies above a threshold that ordinary samples kept apart do
not reach. Of a run that a pattern touches, what the pattern leaves over is looked at. What the models find is added to
what the patterns find.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, batches, column, hashed_sample

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
#: Runs of these characters are greedy, so a minimum length finds the runs that are long enough and no others.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Characters that the models need to tell.
LEAST = 16
_HINTS = ("pass", "secret", "token", "api")
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
_PLACE = np.full(128, len(_ALPHABET), np.int64)
_PLACE[[ord(c) for c in _ALPHABET]] = np.arange(len(_ALPHABET))
#: Labelled samples: documents (of distinct text) whose words are ordinary ones, and distinct words taken from them, at most.
SAMPLE_DOCS, SAMPLE_WORDS = 2000, 60_000


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def _codes(s: str) -> np.ndarray:
    return _PLACE[np.minimum(np.frombuffer(s.encode("ascii", "replace"), np.uint8), 127)]


class MarkovPair:
    """Log ratios of transition probabilities, random over ordinary, and the threshold of their mean.

    A quarter of the samples trains nothing: the threshold lies above all but one in 10,000 of its ordinary strings of
    LEAST characters or more.
    """

    def __init__(self, samples: list[tuple[str, int]], margin: float = 0.25):
        n = len(_ALPHABET) + 1
        counts = np.full((2, n + 1, n), 0.1)
        train = [x for i, x in enumerate(samples) if i % 4]
        for s, label in train:
            if s:
                c = _codes(s)
                np.add.at(counts[label], (np.r_[n, c[:-1]], c), 1)
        logs = np.log(counts / counts.sum(axis=2, keepdims=True))
        self.ratio = logs[1] - logs[0]
        apart = [x for i, x in enumerate(samples) if i % 4 == 0]
        ordinary = [self.score(s) for s, label in apart if label == 0 and len(s) >= LEAST] or [0.0]
        random = [self.score(s) for s, label in apart if label == 1] or [1.0]
        top = float(np.quantile(ordinary, 0.9999))
        self.threshold = max(margin, top, (top + float(np.quantile(random, 0.02))) / 2)

    def score(self, s: str) -> float:
        c = _codes(s)
        return float(self.ratio[np.r_[len(_ALPHABET) + 1, c[:-1]], c].mean()) if len(c) else 0.0

    def secret(self, s: str) -> bool:
        return self.score(s) > self.threshold


def random_strings(n: int = 6000, seed: int = 5) -> list[str]:
    """Labelled samples of the first kind: uniform strings over the alphabets that keys are written in, letters alone among them."""
    rng = np.random.default_rng(seed)
    kinds = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", _ALPHABET[:62], _ALPHABET[:64], _ALPHABET[:62] + "_-", _ALPHABET[:52]]
    return ["".join(rng.choice(list(kinds[i % len(kinds)]), rng.integers(LEAST, 49))) for i in range(n)]


def ordinary_strings(docs: DataFrame, most_docs: int = SAMPLE_DOCS, most_words: int = SAMPLE_WORDS) -> list[str]:
    """Labelled samples of the second kind, in a fixed order: words of at most ``most_docs`` documents, chosen by a hash
    of their text and each text once, without what the patterns match; of the words, those under a bound by their hash.

    Whole documents are cut into words in the job; only distinct words leave it.
    """
    some = hashed_sample(docs.where("length(text) > 0").select("text"), most_docs, "text", seed=3, cut=False).select("text", F.xxhash64("text").alias("h"))
    some = some.dropDuplicates(["h"]).select("text")

    def run(parts):
        for whole in parts:
            for batch in batches(whole):
                words = set()
                for text in column(batch, "text").to_pylist():
                    for _, a, b in sorted(base_spans(text), key=lambda s: -s[1]):
                        text = text[:a] + " " + text[b:]
                    words.update(w for w in re.findall(r"[A-Za-z0-9+/_=.-]{2,}", text) if len(w) < LEAST or not any(c.isdigit() for c in w))
                yield pa.RecordBatch.from_arrays([pa.array(sorted(words), pa.string())], ["word"])

    words = hashed_sample(arrow(some, run, "word string").distinct(), most_words, "word", seed=3)
    return sorted(words.toArrow()["word"].to_pylist())


def identifiers(words: list[str], n: int = 40_000, seed: int = 7) -> list[str]:
    """Ordinary words put together as names, paths and numbers are: ``some_name``, ``some-name``, ``someName``, ``some/name2``, ``SOME_NAME``."""
    if not words:
        return []
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        some = [words[j] for j in rng.integers(0, len(words), rng.integers(2, 6))]
        if i % 5 == 2:
            some = [w[:1].upper() + w[1:] for w in some]
        if i % 5 == 4:
            some = [w.upper() for w in some]
        out.append(("_", "-", "", "/", "_")[i % 5].join(some) + (str(rng.integers(0, 10_000)) if rng.random() < 0.2 else ""))
    return out


def train(docs: DataFrame) -> MarkovPair:
    a, b = random_strings(), ordinary_strings(docs)
    return MarkovPair([(s, 1) for s in a] + [(s, 0) for s in b + identifiers(b)])


def _left_over(start: int, end: int, base: list[tuple[str, int, int]]):
    """Parts of a run between the spans that touch it."""
    for _, a, b in sorted(base, key=lambda s: s[1]):
        if b > start and a < end:
            if a > start:
                yield start, a
            start = max(start, b)
    if start < end:
        yield start, end


def find(text: str, models: MarkovPair) -> list[tuple[str, int, int]]:
    """All spans, those of the patterns first; the models look at what these leave of runs of LEAST characters."""
    base = base_spans(text)
    more = []
    for m in RUN.finditer(text):
        for a, b in _left_over(m.start(), m.end(), base):
            if b - a >= LEAST and models.secret(text[a:b]):
                more.append(("markov", a, b))
    return base + more


def scan(docs: DataFrame, models: MarkovPair | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans (``kind:start:end``, code points, comma-joined).

    Defined cases: a null text is an empty one and has no spans; null doc_ids and repeated rows are rows like others;
    without any text the models know random strings only and find what the patterns leave; an empty table gives an
    empty one; further columns are ignored.
    """
    models = models or train(docs)

    def run(parts):
        for whole in parts:
            for batch in batches(whole):
                cols: list[list] = [[], [], [], [], []]
                for text in column(batch, "text").to_pylist():
                    spans = find(text or "", models)
                    base = [s for s in spans if s[0] != "markov"]
                    for i, kind in enumerate(KINDS[:3]):
                        cols[i].append(sum(s[0] == kind for s in base))
                    cols[3].append(hashlib.sha256(joined(base).encode()).hexdigest())
                    cols[4].append(joined(spans))
                arrays = [pa.array(c, pa.int64()) for c in cols[:3]] + [pa.array(c, pa.string()) for c in cols[3:]]
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *arrays], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, models: MarkovPair | None = None, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret replaced by ``mark``; n_chars follows the text where there is such a column.

    Defined cases: a null text stays null and an empty one empty; of spans that overlap, the union is one secret; null
    doc_ids and repeated rows are rows like others; an empty table gives an empty one; further columns are kept.
    """
    models = models or train(docs)

    def clean(text):
        spans = sorted((a, b) for _, a, b in find(text, models)) if text else []
        out, at = [], 0
        for a, b in spans:
            if a >= at:
                out += [text[at:a], mark]
            at = max(at, b)
        return "".join([*out, text[at:]]) if spans else text

    def run(parts):
        for whole in parts:
            for batch in batches(whole, most=1 << 20):
                i = batch.schema.get_field_index("text")
                yield batch.set_column(i, batch.schema.field(i), pa.array(map(clean, batch.column(i).to_pylist()), batch.schema.field(i).type))

    out = arrow(docs, run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
