"""Personal data: fixed patterns, and spans that a linear-chain conditional random field adds.

The field labels words as outside, or beginning or inside of one of four kinds. Its features are shapes (letters, digits with
the length of their runs, punctuation), coarser shapes, numbers of digits, those of the neighbours, and a few cue words before. It
is trained in numpy (forward-backward, gradient ascent) on a small labelled table, by default one of made-up
contact lines in formats that the patterns know and in formats that they miss; that table is a parameter. Words that hold a digit, an at
sign or a spelled-out one are decoded with their neighbours by Viterbi, many stretches at once; elsewhere no kind can begin.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriframe.llm.common import SPACES, slices

KINDS = ("email", "ip", "card", "phone")
#: The fixed patterns; the at sign's is applied around each at sign, so that long words cost no more than their length.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, int]  # kind number, start, end


def luhn(digits: str) -> bool:
    total = 0
    for n, d in enumerate(reversed(digits)):
        x = int(d) * (1 + n % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield 0, start, m.end()
            last = m.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns, by kind, then start."""
    out = list(_emails(text))
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((2, *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            out.append((3, *m.span()))
    return out


# The labelled table

#: Made-up values, one row a format; digits and letters are drawn anew for each row of the table.
VALUES = {
    "email": ["jane.doe@mail.example.com", "jane_doe9@example.org", "jane.doe (at) example.com", "jane.doe [at] example.com", "jane.doe(at)example.com", "jane.doe[at]example.com", "jane.doe[at]example[dot]com", "jane9 (at) mail (dot) example (dot) com", "jane.doe{at}example.com", "jane (at) example.com", "jane [at] example (dot) org"],
    "ip": ["192.0.2.17", "10.0.113.5", "192[.]0[.]2[.]17", "192.0.2[.]17", "2001:db8:85a3:0:0:8a2e:370:7334", "2001:0db8:85a3:0000:0000:8a2e:0370:7334", "2001:db8::8a2e:7334", "fe80::1ff:fe23:4567:890a"],
    "card": ["4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111.1111.1111.1111", "4111/1111/1111/1111", "3782 822463 10005", "378282246310005", "3782-822463-10005", "4111_1111_1111_1111"],
    "phone": ["+1 (017) 555-7713", "+49 30 901820", "(017) 555-7713", "017-555-7713", "017.555.7713", "1-800-555-0199", "0049 30 9018200", "00 44 20 7946 0958", "(020) 7946 0958", "020 7946 0958", "+1/017/555-7713", "017/555-7713", "0171 5557713", "01 23 45 67 89"],
    "": ["2024-01-05", "05/01/2024", "12:30:45", "12:30", "3.14159", "1,234,567", "$19.99", "v1.2.3", "1.2.3", "2019-2020", "978-3-16-148410-0", "473696257", "98079157628", "12", "4th", "3", "2048", "19 200 300", "A4-210", "id-20481", "10%", "6e23", "1 000 000", "4.5 7.25 9", "3x5", "[12]", "(3)", "No. 17", "9807915762804490123456", "a1b2c3d4e5f6", "@home", "look @ this", "$$$12%%%", "2,5", "1:2", "12.", "0.5.", "GB2312", "x86_64", "66 77"],
}
BEFORE = ["and", "the", "Words of it", "then they said", "by", "so.", "mail", "write to", "e-mail:", "call", "phone", "tel:", "Tel.", "fax", "card", "card no.", "visa", "paid with", "host", "from ip", "server at", "login from", "id", "order", "page", "on", "Über", "und", "à"]
AFTER = ["and", "the", "then they went", "or", "please", "today", "", "Thanks", "of it all", "und", "et"]
CUES = frozenset("mail e-mail write call phone tel fax card visa host ip server login id order page no isbn".split())
#: Lines of the default table for each value, and what is learned from at most.
LINES, SEED = 12, 7
MOST = 6_000


def _varied(value: str, kind: str, rng: random.Random) -> str:
    """Other digits, and other letters outside of words that mean something; a card's last digit makes it valid."""
    if kind == "email":
        name = "".join(rng.choice("abcdefghiklmnorstu") for _ in range(rng.randint(3, 9)))
        value = value.replace("jane", name).replace("example", rng.choice(["example", "firma", "uni", "mail7"]))
    out = [rng.choice("123456789") if c.isdigit() and not (c == "0" and kind == "phone" and i < 2) else rng.choice("0123456789abcdef") if kind == "ip" and ":" in value and c.isalnum() else c for i, c in enumerate(value)]
    if kind == "card":
        last = max(i for i, c in enumerate(out) if c.isdigit())
        for d in "0123456789":
            out[last] = d
            if luhn(_digits("".join(out))):
                break
    return "".join(out)


def labelled_lines() -> list[tuple[str, str]]:
    """(text, spans): the default table; spans as ``kind:start:end``."""
    rng = random.Random(SEED)
    rows = []
    for kind, values in VALUES.items():
        for value in values:
            for _ in range(LINES if kind else LINES // 2):
                before, said, after = rng.choice(BEFORE), _varied(value, kind, rng), rng.choice(AFTER)
                end = rng.choice(["", "", ".", ",", "!"]) if after else ""
                start = len(before) + 1
                rows.append((f"{before} {said}{end} {after}", f"{kind}:{start}:{start + len(said)}" if kind else ""))
    return rows


def labelled_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled_lines(), "text string, spans string")


# Words and features

#: Characters on either side of a candidate word that its neighbours are looked for in.
CONTEXT = 48
WORD, GAP = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[\x20\x09-\x0D]")
SEED_CHARS = re.compile(r"[0-9@]|[(\[{](?:at|dot)[)\]}]")
_SHAPE = {c: k for chars, k in (("0123456789", "9"), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A"), ("abcdefghijklmnopqrstuvwxyz", "a")) for c in chars}
_TABLE = str.maketrans(_SHAPE)
_RUN = re.compile(r"A+|a+|9+|[^\x00-\x7F]+")
_LEFT, _RIGHT = "\"'<*$#%&|", "\"'>*$#%&|.,;:!?"


def stretches(text: str) -> list[list[tuple[int, int]]]:
    """Places of the words around candidates, a list for each stretch of them. Outer punctuation of a word is left off; a neighbour that the context cuts stays as it is cut."""
    regions: list[list[int]] = []
    end = 0  # of the last candidate word
    for m in SEED_CHARS.finditer(text):
        if m.start() < end:
            continue
        start = m.start()
        while start > end and text[start - 1] not in SPACES:
            start -= 1
        gap = GAP.search(text, m.end())
        end = gap.start() if gap else len(text)
        a, b = max(0, start - CONTEXT), end + CONTEXT
        if regions and a <= regions[-1][1]:
            regions[-1][1] = b
        else:
            regions.append([a, b])
    out = []
    for a, b in regions:
        words = []
        for m in WORD.finditer(text, a, b):
            s, e = m.span()
            while s < e and text[s] in _LEFT:
                s += 1
            while e > s and text[e - 1] in _RIGHT:
                e -= 1
            if s < e:
                words.append((s, e))
        out.append(words)
    return [w for w in out if w]


def shape(word: str) -> str:
    def run(m: re.Match) -> str:
        c = m[0][0]
        return f"9{min(len(m[0]), 20)}" if c == "9" else c if c < "\x80" else "a"

    return _RUN.sub(run, word.translate(_TABLE))


def coarse(word: str) -> str:
    """The punctuation of a word, whether it has letters, and how many digits."""
    n = sum("0" <= c <= "9" for c in word)
    return f"{''.join(sorted({c for c in word if c < chr(128) and not c.isalnum()}))}{'a' if any(c.isalpha() for c in word) else ''}{min(n, 20)}"


class Features:
    """Features of words as numbers; those of a shape are looked up once."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.seen: dict[str, tuple[list[int], list[int], list[int]]] = {}
        self.growing = True

    def _id(self, name: str) -> int:
        if name not in self.known and self.growing:
            self.known[name] = len(self.known) + 1  # 0: none
        return self.known.get(name, 0)

    def _of(self, word: str) -> tuple[list[int], list[int], list[int]]:
        low = word.lower().strip(".:")
        key = low if low in CUES or low in ("at", "dot", "(at)", "(dot)", "[at]", "[dot]", "{at}") else word.translate(_TABLE)
        if key not in self.seen:
            if len(self.seen) > 50_000:
                self.seen.clear()
            s, c = shape(word), coarse(word)
            own = [f"s={s}", f"c={c}", f"l={min(len(word), 24)}"] + [f"has={x}" for x in ("@", "(at)", "[at]", ":", "+", "[.]") if x in low] + ([f"w={low}"] if key == low else [])
            before = [f"-c={c}", f"-s={s}"] + ([f"-w={low}"] if key == low else [])
            self.seen[key] = [self._id(f) for f in own], [self._id(f) for f in before], [self._id(f"+c={c}"), self._id(f"+s={s}")]
        return self.seen[key]

    def of(self, words: list[str]) -> list[list[int]]:
        each = [self._of(w) for w in words]
        edge = [self._id("edge")]
        out = []
        for i, (own, _, _) in enumerate(each):
            far = [f for _, b, _ in each[max(0, i - 3) : max(0, i - 1)] for f in b[2:]]  # cue words two and three before
            out.append([*own, *(each[i - 1][1] if i else edge), *(each[i + 1][2] if i + 1 < len(each) else edge), *far])
        return out


def _padded(rows: list[list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    """(sequences, words, features) numbers, 0 where there is none, and the sequences' lengths."""
    lengths = np.array([len(r) for r in rows])
    out = np.zeros((len(rows), lengths.max(), max(len(f) for r in rows for f in r)), np.int32)
    for i, r in enumerate(rows):
        for j, f in enumerate(r):
            out[i, j, : len(f)] = f
    return out, lengths


# The field

LABELS = 1 + 2 * len(KINDS)  # outside; of each kind beginning (odd) and inside (even)
STEPS, RATE, DECAY = 120, 0.15, 0.02
#: Longer stretches are decoded in pieces of so many words, each with so many more on both sides.
PIECE, MARGIN = 512, 16


def _sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Field:
    """A linear-chain conditional random field: weights of features and labels, and of labels that follow each other."""

    def __init__(self, features: Features, weights: np.ndarray, follow: np.ndarray) -> None:
        self.features, self.weights, self.follow = features, weights, follow

    @classmethod
    def train(cls, rows: list[tuple[list[str], list[int]]]) -> Field:
        """``rows`` (words, labels), by gradient ascent on the likelihood (Adam), weights decaying."""
        features = Features()
        x, lengths = _padded([features.of(w) for w, _ in rows])
        features.growing = False
        features.seen.clear()
        n, longest = x.shape[:2]
        y = np.zeros((n, longest), int)
        for i, (_, labels) in enumerate(rows):
            y[i, : len(labels)] = labels
        inside = np.arange(longest) < lengths[:, None]
        model = [np.zeros((len(features.known) + 1, LABELS)), np.zeros((LABELS, LABELS))]
        mean, square = [np.zeros_like(m) for m in model], [np.zeros_like(m) for m in model]
        for step in range(1, STEPS + 1):
            up = cls(features, *model)._gradient(x, y, inside)
            for m, g, a, b in zip(model, up, mean, square):
                g = g / n - DECAY * m / 10
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                m += RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
            model[0][0] = 0
        return cls(features, *model)

    def _gradient(self, x: np.ndarray, y: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Seen less expected counts of features and of pairs of labels."""
        n, longest = y.shape
        emit = self.weights[x].sum(axis=2)
        ahead, back = np.empty_like(emit), np.zeros_like(emit)
        ahead[:, 0] = emit[:, 0]
        for t in range(1, longest):
            ahead[:, t] = np.where(inside[:, t, None], _sum(ahead[:, t - 1, :, None] + self.follow, 1) + emit[:, t], ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            back[:, t] = np.where(inside[:, t + 1, None], _sum(self.follow + (emit[:, t + 1] + back[:, t + 1])[:, None, :], 2), 0)
        whole = _sum(ahead[:, -1], 1)[:, None, None]
        share = np.where(inside[:, :, None], np.exp(ahead + back - whole), 0)
        seen = np.where(inside[:, :, None], np.eye(LABELS)[y], 0)
        up = np.zeros_like(self.weights)
        np.add.at(up, x.reshape(n * longest, -1), (seen - share).reshape(n * longest, 1, LABELS))
        pairs = np.zeros_like(self.follow)
        for t in range(1, longest):
            both = np.exp(ahead[:, t - 1, :, None] + self.follow + (emit[:, t] + back[:, t])[:, None, :] - whole)
            pairs -= both[inside[:, t]].sum(axis=0)
            np.add.at(pairs, (y[inside[:, t], t - 1], y[inside[:, t], t]), 1)
        return up, pairs

    def decode(self, rows: list[list[str]]) -> list[np.ndarray]:
        """The likeliest labels of each list of words: Viterbi, over lists of like length at once."""
        out: list[np.ndarray] = [np.zeros(0, int)] * len(rows)
        order = sorted(range(len(rows)), key=lambda i: len(rows[i]))
        while order:
            # Batches of bounded size: the longest list is the last.
            some = [order.pop()]
            while order and (len(some) + 1) * len(rows[some[0]]) <= 20_000:
                some.append(order.pop())
            x, lengths = _padded([self.features.of(rows[i]) for i in some])
            emit = sum(self.weights[x[:, :, f]] for f in range(x.shape[2]))
            best, came = emit[:, 0], []
            for t in range(1, emit.shape[1]):
                paths = best[:, :, None] + self.follow
                came.append(paths.argmax(axis=1))
                best = np.where((t < lengths)[:, None], paths.max(axis=1) + emit[:, t], best)
            label = best.argmax(axis=1)
            labels = np.zeros(emit.shape[:2], int)
            for t in range(emit.shape[1] - 1, -1, -1):
                labels[:, t] = label
                if t:
                    label = np.where(t < lengths, came[t - 1][np.arange(len(some)), label], label)
            for i, own, n in zip(some, labels, lengths):
                out[i] = own[:n]
        return out


def _labels(words: list[tuple[int, int]], spans: list[Span]) -> list[int]:
    out = []
    for s, e in words:
        hit = next(((k, a) for k, a, b in spans if a < e and s < b), None)
        out.append(0 if hit is None else 1 + 2 * hit[0] + (s > hit[1]))
    return out


def learn(labelled: DataFrame, most: int = MOST) -> Field:
    """A field from ``labelled`` (text, spans as ``kind:start:end``, comma-joined), from ``most`` rows at most, by hash of the text. Null texts and texts without words teach nothing; null spans are none."""
    rows = labelled.select("text", "spans").where("text IS NOT NULL").orderBy(F.xxhash64("text"), "text").limit(most).collect()
    taught = []
    for text, spans in rows:
        cut = [(KINDS.index(k), int(a), int(b)) for k, a, b in (s.split(":") for s in (spans or "").split(",") if s)]
        taught += [([text[s:e] for s, e in part], _labels(part, cut)) for part in stretches(text)]
    return Field.train(taught or [(["a"], [0])])


def _plausible(kind: int, said: str) -> bool:
    """What a kind must have whatever its shape."""
    digits = _digits(said)
    if kind == 0:
        return ("@" in said or re.search(r"[(\[{]at[)\]}]", said) is not None) and ("." in said or "dot" in said)
    if kind == 1:
        return len(said) >= 7 and (said.count(":") >= 2 or len(re.findall(r"[0-9]+", said)) == 4)
    return (13 <= len(digits) <= 19 and luhn(digits)) if kind == 2 else 7 <= len(digits) <= 15


def _union(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Where the spans' union begins and ends."""
    starts, ends = [], []
    for a, b in sorted((a, b) for _, a, b in spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _pieces(n: int) -> Iterator[tuple[int, int, int]]:
    """Of ``n`` words, (from, middle, to): those from ``middle`` on, PIECE at most, with MARGIN words on both sides."""
    for at in range(0, n, PIECE):
        yield max(0, at - MARGIN), at, min(n, at + PIECE + MARGIN)


def learned_spans(texts: list[str], bases: list[list[Span]], field: Field) -> list[list[Span]]:
    """Spans that the field adds to each text: none overlaps a base span or another."""
    stretch = [(n, part) for n, text in enumerate(texts) for part in stretches(text)]
    pieces = [(i, *p) for i, (_, part) in enumerate(stretch) for p in _pieces(len(part))]
    decoded = field.decode([[texts[n][s:e] for s, e in part[a:b]] for i, a, _, b in pieces for n, part in (stretch[i],)])
    labels: list[list[int]] = [[] for _ in stretch]
    for (i, a, at, _), own in zip(pieces, decoded):
        labels[i] += own[at - a : at - a + PIECE].tolist()
    out: list[list[Span]] = [[] for _ in texts]
    for (n, part), own in zip(stretch, labels):
        found: list[list[int]] = []
        kind = -1  # of the span that is open
        for (s, e), label in zip(part, own):
            if label and label % 2 == 0 and kind == (label - 1) // 2:
                found[-1][2] = e
            elif label:
                kind = (label - 1) // 2
                found.append([kind, s, e])
            else:
                kind = -1
        if found:
            starts, ends = _union(bases[n])
            for kind, s, e in found:
                i = bisect.bisect_right(ends, s)
                if (i == len(ends) or starts[i] >= e) and _plausible(kind, texts[n][s:e]):
                    out[n].append((kind, s, e))
    return out


def scan(docs: DataFrame, field: Field) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> (doc_id, n_email, n_ip, n_card, n_phone, base, spans, n_learned), one row for each input row.

    ``base`` and ``spans`` are ``kind:start:end`` in code points, comma-joined, by kind, then start; the numbers count base spans.
    Null and empty texts have none; very long texts and words are read whole and in time linear in them. Repeated rows each get a row; other columns are
    ignored, whatever their names. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)  # a few thousand weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            bases = [base_spans(t) for t in texts]
            joined = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))
            rows = []
            for base, more in zip(bases, learned_spans(texts, bases, known)):
                count: dict[int, int] = defaultdict(int)
                for k, _, _ in base:
                    count[k] += 1
                rows.append((*(count[k] for k in range(len(KINDS))), joined(base), joined(base + more), len(more)))
            columns = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "spans", "n_learned"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string, n_learned long")


def digest(base: str) -> str:
    return hashlib.sha256(base.encode()).hexdigest()


def op13_personal_data(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, learn(labelled_table(spark)))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_learned")
