"""Personal data: four kinds by their form, more by a linear-chain conditional random field over word shapes.

The base kinds are email, ip, card and phone, leftmost and non-overlapping. The field adds spans of two kinds that
have no fixed form, crf_phone and crf_id (numbers of persons, written in groups). Its features are what a word's shape
is made of (how many digits in how many runs of which lengths, marks between and before them, letters), what its two
neighbours are, and whether a cue word stands shortly before. It is trained here, by gradient ascent on the likelihood
of the small labelled table below, and decoded by Viterbi in numpy for many texts at once.

Every word of every text is decoded. Only words with a digit may belong to a span; all others are outside, the chain
falls apart at them, and what lies between them is walked.

Defined results: null text is empty and has no spans; added spans never overlap a base span (those win); repeated
rows are scanned each on its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillnet.llm.common import few_rows

KINDS = ("email", "ip", "card", "phone", "crf_phone", "crf_id")

# The forms of the base kinds. A run of one class is entered only at its start, which is where the
# leftmost match begins.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS, PHONE_DIGITS = (14, 19), (10, 15)
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

LABELS = ("O", "B-phone", "I-phone", "B-id", "I-id")
#: The labelled table: words and, for those not outside, their label.
TABLE = """
call me on (555)/B-phone 010-7788/I-phone tomorrow
my phone is 555-010-4433/B-phone and it rings
phone: (212)/B-phone 555-0187/I-phone or write
mobile 0171/B-phone 555/I-phone 0199/I-phone please
mobile: 07700/B-phone 900123/I-phone after work
tel. 020/B-phone 7946/I-phone 0018/I-phone
tel 040/B-phone 1234/I-phone 5678/I-phone
tel: 01/B-phone 42/I-phone 68/I-phone 53/I-phone 00/I-phone
telephone 030/4455667/B-phone in the office
fax 555.010.2299/B-phone ext 4
fax: 0211-4455667/B-phone if needed
reach her at 415-555-0132/B-phone after six
reach us at 5550199/B-phone today
dial (800)/B-phone 555-0100/I-phone now
dial 0800/B-phone 5557788/I-phone for help
you can call 555-0142/B-phone at any time
please call 0151-2345678/B-phone or come by
contact: 617.555.0110/B-phone and ask
cell 9175550123/B-phone works best
ssn 123-45-6789/B-id on file
her ssn: 078-05-1120/B-id was printed
social security number 219-09-9999/B-id here
the social security no. is 457-55-5462/B-id he said
the id number 900-11-2233/B-id belongs to him
id: 83-114-772/B-id is hers
passport no. 1234/B-id 5678/I-id 90/I-id expires
passport C01234567/B-id was lost
passport number: 531902846/B-id is valid
insurance number 65/B-id 170839/I-id 008/I-id today
insurance no. 12-345678-9/B-id was given
tax id 98/B-id 765/I-id 432/I-id 109/I-id for him
his number is 457-55-5462/B-id and so on
license number D123-4567-8901/B-id of the driver
in 1999 we sold 300 units for 20 each
page 12 of 400 was missing in 2004
the price fell from 1,200.50 to 980.25 dollars
version 3.11.2 came out on 2024-01-15 at noon
see section 4.2 and table 17 or figure 3
room 101 on floor 10 has 3 beds
scores were 3-2 and 10-8 last night
on 01-02-2003 and 12/05/1998 it rained
the code 99812 and the year 2010 are known
order 4482211 was shipped in 2 boxes
order no. 55120 and invoice 20231177 are paid
chapter 7 verses 12-15 and 18-20
between 10:30 and 11:45 the gate 22 opens
hash 9f3a2b77 and build 20240115 differ
call at 9 or at 10:15 on 3 May
call me in 2025 when 12 are left
the number of rows is 1200000 and rising
number 7 of 12 was the best of all
no 15 in the list of 300
id 7 and id 12 in the table
reach 100 by 2030 and 250 by 2040
the phone cost 399 or 449.99 in 2019
mobile users grew by 35% to 4,000,000
population 8,900,000 in 2011 and 9.1 since
ports 8080 and 65535 on 10.0.0 are open
coordinates 52.5200 and 13.4050 in degrees
isbn 978-3-16-148410-0 on the back
lines 1000-2000 and pages 15-17 only
ratio 16:9 at 1920x1080 and 60 fps
$1,000,000 or #42 in v2.10.3 of it
word2 x86 a1 b2b 4th 21st 90s c3po
words alone carry no number at all here
He said that nothing of the sort was ever There
A B c d and Some Names like Anna or Paris
*** --- ... !!! ??? are marks || and so are ###
LOUD WORDS ARE STILL WORDS and MixedCase too
"""
CUES = {"phone": "phone", "telephone": "phone", "tel": "phone", "mobile": "phone", "cell": "phone", "call": "phone", "contact": "phone", "fax": "phone", "dial": "phone", "reach": "phone", "ssn": "id", "passport": "id", "insurance": "id", "security": "id", "license": "id", "tax": "id", "id": "id", "number": "id", "no": "id"}
LONGEST_CUE = max(map(len, CUES))
DIGIT = re.compile(r"[0-9]")
EPOCHS, RATE, DECAY = 300, 0.3, 2e-2
KNOWN_WORDS, CHUNK = 300_000, 1 << 20
EDGES = re.compile(r"^[\"'(\[{<]*(.*?)[\"')\]}>.,;:!?]*$", re.S)
#: What a neighbour can be, and how many digits a word has, as the field sees it.
BESIDE = ("edge", "word", "mark", "cue-phone", "cue-id", "few", "some", "many", "grouped")
SIZES = (0, 5, 7, 16)


def shape(word: str) -> str:
    """A word's shape: its digits as runs with their length, marks as they are, letters as one class; or its cue."""
    if word.isalpha() and len(word) > LONGEST_CUE:
        return "word"
    bare = word.strip("\"'([{<)]}>.,;:!?").lower()
    if bare in CUES:
        return "cue-" + CUES[bare]
    if not DIGIT.search(word):
        return "word" if any(c.isalpha() for c in word) else "mark"
    core = EDGES.match(word)[1]
    out = []
    for run in re.findall(r"[0-9]+|[^\W\d_]+|.", core, re.S)[:24]:
        out.append(f"d{min(len(run), 17)}" if run[0] in "0123456789" else "a" if run[0].isalpha() else run)
    return ("(" if word.startswith("(") else "") + "|".join(out) + (")" if ")" in word[-2:] and word.startswith("(") else "")


def evidence(shape_: str) -> tuple[list[str], str, int]:
    """What the field knows of a shape with digits: its features, its class as a neighbour, and the class of its digit count.

    A shape is taken apart, so that a grouping that training never showed still has most of its features."""
    runs = [int(x) for x in re.findall(r"d(\d+)", shape_)]
    digits = sum(runs)
    between = re.sub(r"^[^d]*|[^0-9d]*$", "", shape_)
    marks = sorted({x for x in re.split(r"d\d+", between.replace("|", "")) if x and x != "a"})
    out = ["bias", f"digits {min(digits, 17)}", f"runs {min(len(runs), 6)}", f"first {min(runs[0], 9)}", f"last {min(runs[-1], 9)}", f"most {min(max(runs), 9)}", f"least {min(min(runs), 9)}"]
    out += [f"mark {m[:2]}" for m in marks] or ["unmarked"]
    out += [f"marks {min(len(marks), 2)} runs {min(len(runs), 4)}"]
    if "a" in shape_.split("|") or "a" in shape_.strip("()").split("|"):
        out.append("letters first" if shape_.startswith("a") and shape_.count("a") == 1 else "letters")
    if shape_.startswith("("):
        out.append("bracket")
    elif shape_[0] not in "da":
        out.append(f"before {shape_[0]}")
    if len(runs) > 1:
        out.append("lengths " + "-".join(map(str, runs[:5])))
    size = max(k for k, least in enumerate(SIZES) if digits >= least)
    return out, "grouped" if len(runs) > 1 or shape_.startswith("(") else "few" if digits <= 2 else "some" if digits <= 4 else "many", size


class Field:
    """Emissions from what a word is made of, from what its neighbours are and from cues before it, and transitions.

    Only words with a digit may belong to a span; all weights, also those of the label outside, are learned."""

    def __init__(self):
        lines = []
        for line in TABLE.strip().split("\n"):
            words = [w.rsplit("/", 1) if re.search(r"/[BI]-", w) else [w, "O"] for w in line.split()]
            lines.append(([shape(w) for w, _ in words], [LABELS.index(x) for _, x in words]))
        known = sorted({x for shapes, _ in lines for s in shapes if self.numeric(s) for x in evidence(s)[0]})
        self.feature = {x: k for k, x in enumerate(known)}
        k = len(LABELS)
        self.allowed = np.array([[not b.startswith("I-") or a[1:] == b[1:] for b in LABELS] for a in LABELS])
        self.first = np.array([not b.startswith("I-") for b in LABELS])
        self.weight, self.left, self.right, self.cue, self.move, self.start = (np.zeros(s) for s in ((len(known), k), (len(BESIDE), k), (len(BESIDE), k), (3 * len(SIZES), k), (k, k), (k,)))
        self.fit(lines)
        self.ids: dict[str, int] = {}
        self.rows: list[tuple] = []
        self.forget()

    def forget(self) -> None:
        self.ids, self.rows, self.arrays = {}, [], None
        for s in ("word", "mark", "cue-phone", "cue-id"):
            self.number(s)

    @staticmethod
    def numeric(shape_: str) -> bool:
        return shape_ not in ("word", "mark", "cue-phone", "cue-id")

    def number(self, shape_: str) -> int:
        """The number of a shape, for which its own emissions are computed once."""
        if shape_ not in self.ids:
            own = np.zeros(len(LABELS))
            if self.numeric(shape_):
                told, beside, size = evidence(shape_)
                own = self.weight[[self.feature[x] for x in told if x in self.feature]].sum(0)
            else:
                own[1:], beside, size = -1e9, shape_, 0
            self.ids[shape_] = len(self.ids)
            self.rows.append((own, BESIDE.index(beside), size, {"cue-phone": 1, "cue-id": 2}.get(shape_, 0)))
            self.arrays = None
        return self.ids[shape_]

    def tables(self):
        if self.arrays is None:
            own, beside, size, cue = zip(*self.rows, strict=True)
            self.arrays = np.array(own), np.array(beside), np.array(size), np.array(cue)
        return self.arrays

    @staticmethod
    def around(beside: np.ndarray, cue_of: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What stands before and behind each word, and the nearest cue in the three words before; ``begins`` marks first words of texts."""
        left, right = np.r_[0, beside[:-1]], np.r_[beside[1:], 0]
        left[begins] = 0
        right[begins[1:] - 1] = 0
        cue = np.zeros(len(beside), np.int64)
        number = np.arange(len(beside)) - np.repeat(begins, np.diff(np.r_[begins, len(beside)]))
        for back in (3, 2, 1):
            told = np.r_[np.zeros(min(back, len(beside)), np.int64), cue_of[:-back]] if len(beside) > back else np.zeros(len(beside), np.int64)
            cue = np.where((number >= back) & (told > 0), told, cue)
        return left, right, cue

    def emissions(self, s: np.ndarray, begins: np.ndarray) -> np.ndarray:
        own, beside, size, cue_of = (x[s] for x in self.tables())
        left, right, cue = self.around(beside, cue_of, begins)
        return own + self.left[left] + self.right[right] + self.cue[cue * len(SIZES) + size]

    def fit(self, lines: list[tuple[list[str], list[int]]]) -> None:
        """Gradient ascent on the likelihood of all lines at once; what stands behind a line's end counts for nothing."""
        n, longest, k = len(lines), max(len(y) for _, y in lines), len(LABELS)
        length = np.array([len(y) for _, y in lines])
        has = np.zeros((n, longest, len(self.feature)))
        truth, closed = np.zeros((n, longest), np.int64), np.zeros((n, longest, k))
        left, right, cue = (np.zeros((n, longest), np.int64) for _ in range(3))
        for i, (shapes, y) in enumerate(lines):
            told = [evidence(s) if self.numeric(s) else ([], s, 0) for s in shapes]
            truth[i, : len(y)] = y
            for t, (features, _, _) in enumerate(told):
                has[i, t, [self.feature[x] for x in features]] = 1
                closed[i, t, 1:] = 0 if features else -1e9
            beside, size = np.array([BESIDE.index(b) for _, b, _ in told]), np.array([z for _, _, z in told])
            a, b, c = self.around(beside, np.array([{"cue-phone": 1, "cue-id": 2}.get(s, 0) for s in shapes]), np.array([0]))
            left[i, : len(y)], right[i, : len(y)], cue[i, : len(y)] = a, b, c * len(SIZES) + size
        inside = np.arange(longest)[None, :] < length[:, None]
        gold = (np.eye(k)[truth]) * inside[:, :, None]
        pairs = np.einsum("nti,ntj->ij", gold[:, :-1], gold[:, 1:])
        params = ("weight", "left", "right", "cue", "move", "start")
        squares = {p: np.full_like(getattr(self, p), 1e-8) for p in params}
        for _ in range(EPOCHS):
            e = has @ self.weight + self.left[left] + self.right[right] + self.cue[cue] + closed
            move = np.where(self.allowed, self.move, -1e9)
            a, b = np.empty_like(e), np.zeros_like(e)
            a[:, 0] = e[:, 0] + np.where(self.first, self.start, -1e9)
            for t in range(1, longest):
                on = e[:, t] + np.logaddexp.reduce(a[:, t - 1, :, None] + move, axis=1)
                a[:, t] = np.where(inside[:, t, None], on, a[:, t - 1])
            for t in range(longest - 2, -1, -1):
                on = np.logaddexp.reduce(move + (e[:, t + 1] + b[:, t + 1])[:, None, :], axis=2)
                b[:, t] = np.where(inside[:, t + 1, None], on, 0)
            z = np.logaddexp.reduce(a[:, -1], axis=1)
            d = gold - np.exp(a + b - z[:, None, None]) * inside[:, :, None]
            both = np.exp(a[:, :-1, :, None] + move + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None])
            grads = {"weight": np.einsum("ntf,ntk->fk", has, d), "start": d[:, 0].sum(0), "move": pairs - (both * inside[:, 1:, None, None]).sum((0, 1))}
            for p, at in (("left", left), ("right", right), ("cue", cue)):
                grads[p] = np.zeros_like(getattr(self, p))
                np.add.at(grads[p], at, d)
            for p in params:
                g = grads[p] - DECAY * getattr(self, p)
                squares[p] += g**2
                getattr(self, p)[...] += RATE * g / np.sqrt(squares[p])

    def decode(self, s: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """The best label of every word; texts begin at ``begins``. A word without digits is outside, and the chain falls apart there."""
        labels = np.zeros(len(s), np.int64)
        e = self.emissions(s, begins)
        open_words = np.flatnonzero(e[:, 1] > -1e8)
        if not len(open_words):
            return labels
        text = np.searchsorted(begins, open_words, "right")
        run_at = np.flatnonzero(np.r_[True, (np.diff(open_words) > 1) | (np.diff(text) > 0)])
        move = np.where(self.allowed, self.move, -1e9)
        # All runs of one length are walked together.
        lengths = np.diff(np.r_[run_at, len(open_words)])
        is_begin = np.zeros(len(s) + 1, bool)
        is_begin[begins] = True
        is_begin[len(s)] = True
        for n in np.unique(lengths):
            at = open_words[run_at[lengths == n]]
            best = e[at] + np.where(is_begin[at][:, None], np.where(self.first, self.start, -1e9), move[0])
            back = []
            for t in range(1, n):
                way = best[:, :, None] + move
                back.append(way.argmax(1))
                best = way.max(1) + e[at + t]
            best = best + np.where(is_begin[at + n][:, None], 0.0, move[:, 0])
            now = best.argmax(1)
            labels[at + n - 1] = now
            for t in range(n - 2, -1, -1):
                now = back[t][np.arange(len(at)), now]
                labels[at + t] = now
        return labels


@functools.lru_cache(1)
def field() -> Field:
    return Field()


_shapes: dict[str, int] = {}


def shape_ids(words: list[str]) -> np.ndarray:
    """The numbers of the words' shapes. Words and shapes are remembered, up to KNOWN_WORDS."""
    try:
        return np.fromiter(map(_shapes.__getitem__, words), np.int64, len(words))
    except KeyError:
        f = field()
        if len(_shapes) > KNOWN_WORDS:
            _shapes.clear()
            f.forget()
        for w in words:
            if w not in _shapes:
                _shapes[w] = f.number(shape(w))
        return np.fromiter(map(_shapes.__getitem__, words), np.int64, len(words))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if PHONE_DIGITS[0] <= sum("0" <= c <= "9" for c in m[0]) <= PHONE_DIGITS[1]:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def added_spans(text: str, labels: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the runs the field labelled, without marks around them."""
    out: list[list] = []
    hits = np.flatnonzero(labels)
    last, want = int(hits[-1]), set(hits.tolist())
    for k, m in enumerate(re.finditer(r"\S+", text)):
        if k in want:
            kind = 4 if LABELS[labels[k]].endswith("phone") else 5
            start, end = m.span()
            while end > start and not text[end - 1].isdigit() and text[end - 1] != ")":
                end -= 1
            if LABELS[labels[k]].startswith("B-") or not out:
                while start < end and not text[start].isdigit() and text[start] != "(":
                    start += 1
                out.append([start, kind, end])
            else:
                out[-1][2] = end
        if k >= last:
            break
    return [tuple(x) for x in out if x[2] > x[0]]


def found(texts: list[str]) -> list[tuple[list, list]]:
    """For each text its base spans and the spans the field adds."""
    words = [t.split() for t in texts]
    sizes = np.array([len(w) for w in words])
    out = [(base_spans(t), []) for t in texts]
    full = np.flatnonzero(sizes)
    if len(full):
        begins = np.cumsum(sizes[full]) - sizes[full]
        labels = field().decode(shape_ids([w for k in full for w in words[k]]), begins)
        hit = np.unique(np.searchsorted(begins, np.flatnonzero(labels), "right") - 1)
        for k in hit:
            at = full[k]
            mine = added_spans(texts[at], labels[begins[k] : begins[k] + sizes[at]])
            out[at] = (out[at][0], [x for x in mine if not any(x[0] < b[2] and b[0] < x[2] for b in out[at][0])])
    return out


def personal_spans(docs: DataFrame) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end, base), for each row of ``docs``."""
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

    def run(batches):
        for batch in few_rows(batches):
            texts, rows = [t or "" for t in batch.column(1).to_pylist()], []
            at = 0
            while at < len(texts):
                stop, chars = at + 1, len(texts[at])
                while stop < len(texts) and chars < CHUNK:
                    chars += len(texts[stop])
                    stop += 1
                for base, more in found(texts[at:stop]):
                    rows.append([{"kind": KINDS[k], "start": a, "end": b, "base": k < 4} for a, k, b in sorted(base + more)])
                at = stop
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(kind))], names=["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


def personal_digests(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of the base kinds, base_sha256 and spans."""
    told = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["base"])
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in KINDS[:4]]
    return personal_spans(docs).select("doc_id", *counts, F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
