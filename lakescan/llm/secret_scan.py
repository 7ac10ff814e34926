"""Secret scans: fixed patterns, and a battery of randomness tests with length-aware false-discovery control.

Patterns: see KINDS. Battery, over each run of 20 or more characters that an encoding could have produced (only
letters of one case, and only digits, are no encoding here; a '=' that isn't padding parts runs): the smallest alphabet that holds the run is its inferred
encoding. A chi-squared test of uniformity over that alphabet, a runs test about its middle and a test of the serial
correlation of neighbours give three p-values, joined by Fisher's method: the run must be consistent with chance. A
second p-value is the chance that ordinary characters, at the frequencies of the whole corpus, look as uniform at that
length: short runs can't reach a small one. Benjamini and Hochberg's bound over all runs of the corpus decides.

One pass reads the texts. Candidates stay beside their document, so the bound is applied without a join.
Null and empty texts have no spans. Repeated rows and ids are each scanned. Runs that look equally random are found or
left together. Extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, text_slices, written

# The patterns of the contract, with letters of either case spelt out, and the least lengths.
ASSIGN = re.compile(
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "random")

RUN = re.compile("[A-Za-z0-9+/_-]{20,}(?:=++(?![A-Za-z0-9+/_-]))?")  # '=' parts runs, unless it is padding at the end
_LONG = re.compile("[A-Za-z0-9+/_.=-]{16,}")
# The encodings that runs are tried against, the smallest first.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind; start and end are code points of the whole match."""
    if not text:
        return []
    out, low = [], text.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    for run in _LONG.finditer(text):  # access and hex matches are runs, or parts of runs, of these characters
        token, a = run.group(), run.start()
        if "AKIA" in token:
            out += [(a + m.start(), 1, a + m.end()) for m in ACCESS.finditer(token) if m.end() - m.start() >= 16]
        if len(token) >= 32:
            out += [(a + m.start(), 2, a + m.end()) for m in HEX.finditer(token)]
    return sorted(out)


def encoding_of(token: str) -> str | None:
    """The smallest alphabet that holds the token; None if it is only digits, letters of one case, or of none."""
    body = token.rstrip("=")
    if not body or body.isdigit() or "=" in body:
        return None
    if body.isalpha() and (body[1:].islower() or body.isupper()):
        return None
    chars = set(body)
    return next((k for k, a in ALPHABETS.items() if chars <= set(a)), None)


def _upper_normal(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _upper_chi2(x: float, df: float) -> float:
    """Wilson and Hilferty's approximation."""
    return _upper_normal(((max(x, 0) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))


def battery(body: str, alphabet: str) -> tuple[float, float]:
    """(chi-squared statistic of uniformity, p-value of chance from the three tests together)."""
    n, size = len(body), len(alphabet)
    at = {c: i for i, c in enumerate(alphabet)}
    x = np.array([at[c] for c in body], float)
    counts = np.bincount(x.astype(int), minlength=size)
    chi = float((counts**2).sum() * size / n - n)
    p_uniform = _upper_chi2(chi, size - 1)
    high = x >= size / 2
    up, down = int(high.sum()), int(n - high.sum())
    if up and down:
        runs, mean = 1 + int((high[1:] != high[:-1]).sum()), 1 + 2 * up * down / n
        var = (mean - 1) * (mean - 2) / max(n - 1, 1)
        p_runs = 2 * _upper_normal(abs(runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p_runs = 2.0 ** (1 - n)
    d = x - x.mean()
    power = float((d * d).sum())
    r = float((d[1:] * d[:-1]).sum()) / power if power else 1.0
    p_serial = 2 * _upper_normal(abs(r + 1 / n) * math.sqrt(n))
    joined = -2 * sum(math.log(max(p, 1e-300)) for p in (p_uniform, p_runs, p_serial))
    half = joined / 2
    return chi, math.exp(-half) * (1 + half + half * half / 2)  # chi-squared with 6 degrees


SCHEMA = (
    "doc_id long, n_assign long, n_access long, n_hex long, base array<struct<kind:int,start:int,end:int>>, "
    "runs array<struct<start:int,end:int,encoding:int,length:int,chi:double,chance:double>>, characters array<long>"
)


def _holder(spans: list[tuple[int, int]]):
    """Whether one of the spans (by start) holds a range: of those that start no later the one that ends last does."""
    starts, ends = [s for s, _ in spans], list(accumulate((e for _, e in spans), max))
    return lambda start, end: bool(k := bisect_right(starts, start)) and ends[k - 1] >= end


def _scan(docs: DataFrame) -> DataFrame:
    """One row per document, and one row per task with counts of ASCII characters in ``characters``."""
    codes, alphabets = {k: i for i, k in enumerate(ALPHABETS)}, dict(ALPHABETS)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(batches):
        characters = np.zeros(128, np.int64)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in text_slices(texts):
                rows = []
                for doc_id, text in zip(ids[a:b], texts.slice(a, b - a).to_pylist()):
                    base, runs = base_spans(text), []
                    if text:
                        held = _holder([(s, e) for s, _, e in base])
                        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                        characters += np.bincount(raw, minlength=256)[:128]
                        for m in RUN.finditer(text):
                            body = m.group().rstrip("=")
                            kind = encoding_of(body) if len(body) >= 20 else None
                            if kind and not held(m.start(), m.end()):
                                chi, chance = battery(body, alphabets[kind])
                                runs.append({"start": m.start(), "end": m.end(), "encoding": codes[kind], "length": len(body), "chi": chi, "chance": chance})
                    n = [sum(k == i for _, k, _ in base) for i in range(3)]
                    rows.append((doc_id, *n, [{"kind": k, "start": s, "end": e} for s, k, e in base], runs, None))
                yield _batch(rows, arrow)
        yield _batch([(None, 0, 0, 0, [], [], characters)], arrow)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)


def _ordinary(chi: F.Column, length: F.Column, encoding: F.Column, excess: list[float]) -> F.Column:
    """-log10 of the chance that ordinary characters of that length look so uniform: chi-squared, as a normal
    variable about the mean that the corpus's frequencies give, bounded by Chernoff's exp(-z^2/2)."""
    size = F.element_at(F.array(*(F.lit(len(a)) for a in ALPHABETS.values())), encoding + 1)
    shift = length * F.element_at(F.array(*(F.lit(float(x)) for x in excess)), encoding + 1)
    z = (size - 1 + shift - chi) / F.sqrt(2 * (size - 1) + 4 * shift)
    return F.when(z > 0, z * z / (2 * math.log(10))).otherwise(F.lit(0.0))


def scan(docs: DataFrame, q: float = 0.001, least_chance: float = 0.005, bins: int = 100) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, spans: array of (start, kind, end), one row per document.

    q: bound on the expected share of false discoveries; least_chance: the battery's level; bins: a unit of
    -log10 p is cut into so many (rounded towards fewer discoveries).
    """
    found = written(_scan(docs), "secrets")
    rows = found.where("characters IS NULL")
    excess, bound = _decide(found, q, least_chance, bins)
    passed = F.filter(
        "runs", lambda r: (r["chance"] >= least_chance) & (F.floor(_ordinary(r["chi"], r["length"], r["encoding"], excess) * bins) >= bound)
    )
    names = F.array(*map(F.lit, KINDS))
    own = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    more = F.transform(passed, lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end")))
    spans = F.transform(
        F.array_sort(F.concat(own, more)), lambda x: F.struct(x["start"].alias("start"), F.element_at(names, x["kind"] + 1).alias("kind"), x["end"].alias("end"))
    )
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", spans.alias("spans"))


def _decide(found: DataFrame, q: float, least_chance: float, bins: int) -> tuple[list[float], int]:
    """What ordinary characters add to chi-squared, by encoding, and the least bin that is a discovery."""
    excess = _excess(found)
    score = F.floor(_ordinary(F.col("r.chi"), F.col("r.length"), F.col("r.encoding"), excess) * bins)
    runs = found.where("characters IS NULL").select(F.explode("runs").alias("r")).where(F.col("r.chance") >= least_chance)
    counts = runs.select(F.least(score, F.lit(400 * bins)).alias("bin")).groupBy("bin").agg(F.count("*").alias("n")).collect()
    return excess, _bound({r.bin: r.n for r in counts}, q, bins)


def redact(docs: DataFrame, mark: str, q: float = 0.001, least_chance: float = 0.005, bins: int = 100) -> DataFrame:
    """The documents (doc_id, text, n_chars and other columns) with each found span, or run of such, replaced by mark."""
    found = written(_scan(docs).drop("base"), "secrets")
    excess, bound = _decide(found, q, least_chance, bins)
    forget(found)
    others, schema = [c for c in docs.columns if c not in ("text", "n_chars")], docs.select(*(c for c in docs.columns if c not in ("text", "n_chars")), "text", "n_chars").schema
    sizes = [(len(a), x) for a, x in zip(ALPHABETS.values(), excess)]
    codes = {k: i for i, k in enumerate(ALPHABETS)}

    def clean(text: str) -> str:
        spans = [(s, e) for s, _, e in base_spans(text)]
        held = _holder(spans)
        for m in RUN.finditer(text):
            body = m.group().rstrip("=")
            kind = encoding_of(body) if len(body) >= 20 else None
            if kind and not held(m.start(), m.end()):
                chi, chance = battery(body, ALPHABETS[kind])
                size, x = sizes[codes[kind]]
                shift = len(body) * x
                z = (size - 1 + shift - chi) / math.sqrt(2 * (size - 1) + 4 * shift)
                if chance >= least_chance and math.floor((z * z / (2 * math.log(10)) if z > 0 else 0.0) * bins) >= bound:
                    spans.append((m.start(), m.end()))
        out, at = [], 0
        for s, e in sorted(spans):
            if e > at:
                out += [text[at:s], mark] if s >= at else []
                at = e
        return "".join(out) + text[at:]

    def run(batches):
        for batch in batches:
            for start, stop in text_slices(batch.column(len(others))):
                b = batch.slice(start, stop - start)
                texts, sizes_ = b.column(len(others)).to_pylist(), b.column(len(others) + 1).to_pylist()
                new = [clean(t) if t else t for t in texts]
                n = [len(t) if t is not None and k is not None and t != old else k for t, old, k in zip(new, texts, sizes_)]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(others)], pa.array(new, pa.string()), pa.array(n, pa.int64())], schema.names)

    return docs.select(*others, "text", F.col("n_chars").cast("long").alias("n_chars")).mapInArrow(run, schema)


def _excess(found: DataFrame) -> list[float]:
    """By encoding: what one ordinary character adds to chi-squared on average."""
    sums = found.where("characters IS NOT NULL").select(F.posexplode("characters").alias("c", "n")).groupBy("c").agg(F.sum("n").alias("n")).collect()
    total = {chr(r.c): r.n for r in sums}
    out = []
    for alphabet in ALPHABETS.values():
        n = np.array([total.get(c, 0) + 1 for c in alphabet], float)
        p = n / n.sum()
        out.append(float((p * p).sum() * len(alphabet) - 1))
    return out


def _bound(counts: dict[int, int], q: float, bins: int) -> int:
    """The least bin that Benjamini and Hochberg's rule lets through."""
    m, passed, bound = sum(counts.values()), 0, 1 << 30
    for b in sorted(counts, reverse=True):
        passed += counts[b]
        if 10 ** (-b / bins) <= passed * q / m:
            bound = b
    return bound


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def base_digest(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()


def text_of(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
