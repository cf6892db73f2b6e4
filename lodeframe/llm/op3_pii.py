r"""PII: a semi-Markov conditional random field over candidate segments.

Base patterns give the first spans of four kinds (email, ip, card, phone), leftmost and
non-overlapping per kind; matches whose check fails (parts over 255, a wrong Luhn sum or
number of digits) are dropped and not retried. Base spans always stay.

The semi-CRF works on regions: the white-space-delimited tokens that hold a digit, an `@`
or a spelled-out one, with two tokens before and one after. A region is cut into units (runs of digits,
runs of letters, single other characters). Every run of up to MAX_UNITS units and
MAX_DIGITS digits that begins
and ends well and holds enough digits or one at-sign is a candidate segment; features of
the whole segment (digit count, Luhn sum, shape, what touches it, a cue word before it)
score it under each kind, a unit outside any segment scores 0, and a dynamic program over
the bounded segments picks boundaries and kinds together. Found segments that overlap no
base span are added.

The weights maximise the conditional likelihood (by forward-backward over segments) of a
bounded sample of regions: base spans are the truth, and so are copies of the regions in
which spans are rewritten in forms the base patterns miss (no plus sign, a spelled-out at,
dots in a card number). Texts and labels are not otherwise used.

Null text: empty. Null id: the row is kept. Repeated rows: each is scanned. Extra columns
are ignored (by ``scan``) or kept (by ``redact``). Very long texts: scanned whole, region by
region. Ties: of equal segmentations the one found first, of equal kinds the first listed.
Empty table: no rows.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.llm.blocks import small_batches
from lodeframe.llm.shared import about, tidy

KINDS = ("email", "ip", "card", "phone")
#: A segment has so many units and digits at most: none of the kinds is longer.
MAX_UNITS, MAX_DIGITS = 40, 30
#: Documents that training looks at, passes, and the step.
SAMPLE_ROWS, PASSES, RATE = 1500, 12, 0.15
#: Training, which runs on the driver, leaves out longer texts (in characters) and regions (in
#: units); scanning leaves out nothing.
SAMPLE_LENGTH, SAMPLE_UNITS = 20_000, 400

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TRIGGER = re.compile(r"[0-9@]|\(at\)|\[at\]")
_TOKEN = re.compile(r"\S+")
_UNIT = re.compile(r"[0-9]+|[^\W\d_]+|.", re.S)
_AT = re.compile(r"@| ?\(at\) ?| ?\[at\] ?")
_EMAILISH = re.compile(r"[A-Za-z0-9._%+-]+(?:@| ?[(\[]at[)\]] ?)[A-Za-z0-9-]+(?:(?:\.| ?[(\[]dot[)\]] ?)[A-Za-z0-9-]+)+")
_PHONISH = re.compile(r"\+?\(?[0-9][ ().0-9-]*[0-9]")
_CARDISH = re.compile(r"[0-9](?:[ .-]?[0-9])+")
_CUES = (re.compile(r"mail", re.I), re.compile(r"\bip\b|host|addr", re.I), re.compile(r"card|visa|iban|kart|carte|tarjeta", re.I), re.compile(r"tel|phone|fax|call|mobil", re.I))


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of each kind, in time linear in the text."""
    found: list[list[tuple[int, int]]] = [[], [], [], []]
    if "@" in text:
        back, n, end = text[::-1], len(text), 0
        for m in re.finditer("@", text):
            k = m.start()
            if k >= end:
                start = max(end, n - _LOCAL.match(back, n - k).end())
                if start < k and (d := _DOMAIN.match(text, k)):
                    end = d.end()
                    found[0].append((start, end))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split(".")):
                found[1].append(m.span())
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found[2].append(m.span())
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found[3].append(m.span())
    return found


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches of text around tokens that may hold personal data."""
    if not _TRIGGER.search(text):
        return []
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    out: list[list[int]] = []
    for k, (a, b) in enumerate(tokens):
        if _TRIGGER.search(text, a, b):
            lo, hi = tokens[max(0, k - 2)][0], tokens[min(len(tokens) - 1, k + 1)][1]
            if out and lo <= out[-1][1]:
                out[-1][1] = hi
            else:
                out.append([lo, hi])
    return [(a, b) for a, b in out]


#: Whole-segment features, in order.
FEATURES = (
    "bias", "at", "at sign", "email shape", "digits < 8", "digits 8-10", "digits 11-12", "digits 13-15", "digits 16-19", "digits > 19",
    "luhn", "plus", "brackets", "dots", "hyphens", "spaces", "letters", "four parts", "part over 255", "card shape", "phone shape",
    "touched left", "touched right", "number goes on left", "number goes on right", "email cue", "ip cue", "card cue", "phone cue", "even groups", "name goes on right",
)


class Region:
    """The candidate segments of a stretch of text."""

    def __init__(self, text: str):
        spans = [m.span() for m in _UNIT.finditer(text)]
        self.starts, self.ends = [a for a, _ in spans], [b for _, b in spans]
        n = self.n = len(spans)
        digits, ats = [0], [0]
        at_starts = {m.start() for m in _AT.finditer(text)}
        for a, b in spans:
            digits.append(digits[-1] + (b - a if "0" <= text[a] <= "9" else 0))
            ats.append(ats[-1] + any(x in at_starts for x in range(a, b)))
        segments, rows = [], []
        for s in range(n):
            c = text[self.starts[s]]
            if not (c.isalnum() and c.isascii() or c in "+(_%"):
                continue
            for e in range(s + 1, min(n, s + MAX_UNITS) + 1):
                d, at = digits[e] - digits[s], ats[e] - ats[s]
                last = text[self.ends[e - 1] - 1]
                if at > 1 or d > MAX_DIGITS or text[self.starts[e - 1]] in "\n\r":
                    break
                if (at or d >= 4) and last.isascii() and last.isalnum() and (x := self.features(text, s, e, at)):
                    segments.append((s, e))
                    rows.append(x)
        self.segments = segments
        self.x = np.array(rows, float).reshape(len(rows), len(FEATURES))

    def features(self, text: str, s: int, e: int, at: int) -> list[bool] | None:
        a, b = self.starts[s], self.ends[e - 1]
        t = text[a:b]
        digits = "".join(c for c in t if "0" <= c <= "9")
        d = len(digits)
        letters = any(c.isalpha() for c in t)
        email = bool(at) and bool(_EMAILISH.fullmatch(t))
        if letters and not email:
            return None  # cannot be any of the kinds
        parts = t.split(".")
        four = len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts)
        phone, card = bool(_PHONISH.fullmatch(t)), bool(_CARDISH.fullmatch(t))
        if not (email or four or phone or card):
            return None
        before, after = text[a - 1 : a], text[b : b + 1]
        two_before, two_after = text[max(0, a - 2) : a], text[b : b + 2]
        cue = text[max(0, a - 24) : a]
        groups = [len(g) for g in re.split(r"[ .-]", t)]
        return [
            True, bool(at), "@" in t, email, not at and d < 8, not at and 8 <= d <= 10, not at and 11 <= d <= 12, not at and 13 <= d <= 15, not at and 16 <= d <= 19, not at and d > 19,
            not at and d >= 13 and luhn(digits), t[0] == "+", "(" in t, "." in t, "-" in t, " " in t, letters, four, four and any(len(p) > 3 or int(p) > 255 for p in parts), card, phone,
            before.isalnum() or before in tuple("@_%+-."), after.isalnum() or after in ("@", "_", "-"), bool(re.search(r"[0-9][ .()-]?$", two_before)), bool(re.match(r"[ .()-]?[0-9]", two_after)),
            *(bool(c.search(cue)) for c in _CUES), card and len(set(groups)) == 1, bool(at and re.match(r"\.[A-Za-z0-9]| ?[(\[]dot", text[b : b + 6])),
        ]

    def decode(self, weights: np.ndarray) -> list[tuple[int, int, int]]:
        """The best segmentation: (start, end, kind) in characters of the region."""
        if not self.segments:
            return []
        scores = self.x @ weights.T
        kind, value = scores.argmax(axis=1), scores.max(axis=1)
        best, back = [0.0] * (self.n + 1), [-1] * (self.n + 1)
        by_end: dict[int, list[int]] = {}
        for k, (_, e) in enumerate(self.segments):
            if value[k] > 0:
                by_end.setdefault(e, []).append(k)
        for e in range(1, self.n + 1):
            best[e] = best[e - 1]
            for k in by_end.get(e, ()):
                total = best[self.segments[k][0]] + value[k]
                if total > best[e]:
                    best[e], back[e] = total, k
        out, e = [], self.n
        while e > 0:
            if back[e] < 0:
                e -= 1
            else:
                s, t = self.segments[back[e]]
                out.append((self.starts[s], self.ends[t - 1], int(kind[back[e]])))
                e = s
        return out[::-1]

    def gradient(self, weights: np.ndarray, truth: set[tuple[int, int, int]]) -> np.ndarray:
        """Of the log likelihood of the true segments (start, end, kind in characters)."""
        scores = self.x @ weights.T
        total = np.logaddexp.reduce(scores, axis=1)
        into: list[list[int]] = [[] for _ in range(self.n + 1)]
        out: list[list[int]] = [[] for _ in range(self.n + 1)]
        for k, (s, e) in enumerate(self.segments):
            into[e].append(k)
            out[s].append(k)
        alpha, beta = np.zeros(self.n + 1), np.zeros(self.n + 1)
        for e in range(1, self.n + 1):
            alpha[e] = np.logaddexp.reduce([alpha[e - 1], *(alpha[self.segments[k][0]] + total[k] for k in into[e])])
        for s in range(self.n - 1, -1, -1):
            beta[s] = np.logaddexp.reduce([beta[s + 1], *(beta[self.segments[k][1]] + total[k] for k in out[s])])
        at = np.array(self.segments)
        p = np.exp(alpha[at[:, 0]][:, None] + scores + beta[at[:, 1]][:, None] - alpha[-1])
        for k, (s, e) in enumerate(self.segments):
            for kind in range(len(KINDS)):
                p[k, kind] -= (self.starts[s], self.ends[e - 1], kind) in truth
        return -p.T @ self.x


def rewritten(text: str, spans: list[tuple[int, int, int]], r: random.Random) -> tuple[str, set[tuple[int, int, int]]]:
    """The text with spans in forms that the base patterns miss, and where they are now."""
    out, at, truth = "", 0, set()
    for a, b, kind in sorted(spans):
        if a < at:
            continue
        t = text[a:b]
        if kind == 0:
            mark = r.choice([" (at) ", "(at)", " [at] ", "[at]"])
            t = t.replace("@", mark)
            if r.random() < 0.3:
                t = t.replace(".", " (dot) ")
        elif kind == 2:
            digits = re.sub(r"\D", "", t)
            t = r.choice([".", "-", " "]).join(digits[k : k + 4] for k in range(0, len(digits), 4))
        elif kind == 3:
            bare = re.sub(r"^\+[0-9]{1,3} ?", "", t)
            t = bare if 10 <= sum(c.isdigit() for c in bare) <= 15 and "(" in bare else t
        out += text[at:a]
        truth.add((len(out), len(out) + len(t), kind))
        out += t
        at = b
    return out + text[at:], truth


def fit(texts: list[str], seed: int = 7) -> np.ndarray:
    """Weights (kinds x features) from a bounded list of texts."""
    r, data = random.Random(seed), []
    for text in texts:
        spans = [(a, b, k) for k, found in enumerate(base_spans(text)) for a, b in found]
        for lo, hi in regions(text):
            own = [(a - lo, b - lo, k) for a, b, k in spans if lo <= a and b <= hi]
            part = text[lo:hi]
            data.append((Region(part), set(own)))
            if own:
                data.append((lambda x: (Region(x[0]), x[1]))(rewritten(part, own, r)))
    data = [(x, truth) for x, truth in data if x.segments and x.n < SAMPLE_UNITS]
    w = np.zeros((len(KINDS), len(FEATURES)))
    w[:, 0] = -2.0
    squares = np.full(w.shape, 1e-6)
    for _ in range(PASSES):
        r.shuffle(data)
        for x, truth in data:
            g = x.gradient(w, truth) - 1e-3 * w
            squares += g * g
            w += RATE * g / np.sqrt(squares)
    return w


def all_spans(text: str, weights: np.ndarray) -> tuple[list[list[tuple[int, int]]], list[list[tuple[int, int]]]]:
    """Base spans, and base and added spans, by kind."""
    base = base_spans(text)
    every = [list(x) for x in base]
    taken = sorted(s for x in base for s in x)
    starts = [a for a, _ in taken]
    ends = list(accumulate((b for _, b in taken), max))
    for lo, hi in regions(text):
        for a, b, kind in Region(text[lo:hi]).decode(weights):
            k = bisect_left(starts, lo + b)
            if not k or ends[k - 1] <= lo + a:
                every[kind].append((lo + a, lo + b))
    return base, [sorted(x) for x in every]


def fit_on(docs: DataFrame, text_col: str = "text", rows: int = SAMPLE_ROWS, length: int = SAMPLE_LENGTH) -> np.ndarray:
    """Weights from about `rows` texts, of up to `length` characters, that hold a digit or an
    at-sign, chosen by a hash of the text. The bounds cover training alone."""
    chosen = docs.select(F.col(text_col).cast("string").alias("text")).where(F.col("text").rlike("[0-9@]") & (F.length("text") <= length))
    return fit(sorted(r["text"] for r in about(chosen, rows, F.col("text")).collect()))


def render(spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, found in zip(KINDS, spans, strict=True) for a, b in found)


def scan(docs: DataFrame, weights: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id; n_email, n_ip, n_card, n_phone (base spans); base (base spans) and spans
    (all), as kind:start:end joined by commas; positions are code points, end exclusive."""
    w = fit_on(docs, text_col) if weights is None else weights

    def run(batches):
        for rb in batches:
            found = [all_spans(t, w) for t in rb.column(1).to_pylist()]
            counts = [pa.array([len(b[k]) for b, _ in found], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([rb.column(0), *counts, pa.array([render(b) for b, _ in found], pa.string()), pa.array([render(e) for _, e in found], pa.string())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "spans"])

    chosen = small_batches(docs).select(F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return chosen.mapInArrow(tidy(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")


def masked(text: str, spans: list[list[tuple[int, int]]]) -> str:
    """Each maximal run of overlapping spans becomes the name of its first span's kind."""
    out, at = [], 0
    for a, b, kind in sorted((a, b, k) for k, found in enumerate(spans) for a, b in found):
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, weights: np.ndarray | None = None, text_col: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in brackets."""
    w = fit_on(docs, text_col) if weights is None else weights
    names = docs.columns

    def run(batches):
        k = names.index(text_col)
        for rb in batches:
            columns = list(rb.columns)
            columns[k] = pa.array([t if t is None else masked(t, all_spans(t, w)[1]) for t in rb.column(k).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return small_batches(docs).mapInArrow(tidy(run), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")
