"""Secret scans: fixed patterns, and formats learned as probabilistic automata.

Grammar inference (the ALERGIA scheme): a bounded sample of credentials is put into a prefix tree of character classes
per kind; states whose futures do not differ by a Hoeffding bound are merged and folded until no pair is compatible.
Values of assignments are labelled by the name that they are assigned to, whatever they look like, so that their
automaton knows formats that no pattern names; access keys and hexadecimal strings are labelled by their patterns.

The automaton gives a string's likelihood under the kind's format. The background is what tokens look like that no
pattern claims: how often each class follows any two others, summed over all of them in all texts; after two that are
rare in the corpus it falls back on the classes' own shares, so that a corpus's unclaimed credentials don't become their
own background. Every candidate token of every text is scored. It becomes a span if its mean log-likelihood is as high as
that of nearly all credentials kept apart from the automaton, and above the background's by a margin that these pass too.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriframe.llm.common import durable, slices, small_batches

#: The fixed patterns and their least lengths (of group 2 for the first).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{14,}"), re.compile(r"[0-9a-f]{16,}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST_ASSIGN = 12
KINDS = ("assign", "access", "hex")
#: Candidates: tokens of the credentials' alphabet, of the least length of a labelled credential.
TOKEN, LEAST = re.compile(r"[A-Za-z0-9+/_.=-]{12,}"), 12
#: Labelled credentials that are learned from at most: strings of a kind (by hash), and characters of them all; strings are learned whole.
SAMPLE, SAMPLE_CHARS = 2_000, 400_000
#: One labelled string of so many, by hash, is kept from the automaton; the share of those kept that may lie below each threshold; and the least margin over the background, in nats a character.
KEPT_APART, BELOW, MARGIN = 4, 0.02, 0.5
#: Share of the corpus's tokens below which two classes count as rare; tokens of the background have 6 characters or more.
RARE = 0.002
_ORDINARY = re.compile(r"[0Azf+/_.=-]{6,}")
ALPHA = 0.05
_CLASSES = {c: k for chars, k in (("0123456789", "0"), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A"), ("abcdef", "f"), ("ghijklmnopqrstuvwxyz", "z")) for c in chars}
_TABLE = str.maketrans(_CLASSES)
#: Classes that can follow: four of letters and digits, the six other characters, and the end.
SYMBOLS = 11


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns' matches, in code points, by start, then kind."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def classes(token: str) -> str:
    """A token as classes: a hexadecimal letter, another small letter, a capital, a digit, else itself."""
    return token.translate(_TABLE)


class Automaton:
    """A probabilistic automaton: of each state how often it was reached, ended in, and left by each class."""

    def __init__(self, words: list[str], alpha: float = ALPHA) -> None:
        self.reached, self.ended = [0], [0]
        self.next: list[dict[str, int]] = [{}]
        self.taken: list[Counter] = [Counter()]
        for word, n in sorted(Counter(words).items()):
            state = 0
            for c in word:
                self.reached[state] += n
                self.taken[state][c] += n
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.reached.append(0)
                    self.ended.append(0)
                    self.next.append({})
                    self.taken.append(Counter())
                state = self.next[state][c]
            self.reached[state] += n
            self.ended[state] += n
        self._bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > self._bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        todo, seen = [(a, b)], set()
        while todo:
            a, b = pair = todo.pop()
            if pair in seen or a == b:
                continue
            seen.add(pair)
            na, nb = self.reached[a], self.reached[b]
            if not na or not nb:
                continue
            if self._differ(self.ended[a], na, self.ended[b], nb):
                return False
            for c in self.taken[a].keys() | self.taken[b].keys():
                if self._differ(self.taken[a][c], na, self.taken[b][c], nb):
                    return False
                if c in self.next[a] and c in self.next[b]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """The tree below ``b`` goes into ``a``."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.reached[a] += self.reached[b]
            self.ended[a] += self.ended[b]
            self.taken[a].update(self.taken[b])
            for c, child in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], child))
                else:
                    self.next[a][c] = child

    def _merge(self) -> None:
        red, blue = [0], sorted((child, 0, c) for c, child in self.next[0].items())
        while blue:
            state, parent, c = blue.pop(0)
            home = next((r for r in red if self._compatible(r, state)), None)
            if home is None:
                red.append(state)
            else:
                self.next[parent][c] = home
                self._fold(home, state)
            known = set(red)
            blue = sorted((child, r, c) for r in red for c, child in self.next[r].items() if child not in known)
        place = {r: k for k, r in enumerate(red)}
        self.reached, self.ended, self.taken = [self.reached[r] for r in red], [self.ended[r] for r in red], [self.taken[r] for r in red]
        self.next = [{c: place[child] for c, child in self.next[r].items()} for r in red]

    def score(self, word: str) -> float:
        """Log-likelihood of a string of classes and its end; what was never seen counts as half a sighting, and stays in the state."""
        state, total = 0, 0.0
        for c in word:
            total += math.log((self.taken[state][c] or 0.5) / (self.reached[state] + 1))
            state = self.next[state].get(c, state)
        return total + math.log((self.ended[state] or 0.5) / (self.reached[state] + 1))


class Background:
    """How often each class, or the end, follows two others (before the first: two ``^``), drawn towards its own share by RARE of all that was counted."""

    def __init__(self, follows: dict[str, int]) -> None:
        whole: Counter = Counter()
        own: Counter = Counter()
        for three, n in follows.items():
            whole[three[:2]] += n
            own[three[2]] += n
        total = sum(own.values())
        pull = max(1.0, RARE * total)
        share = {c: (own[c] + 0.5) / (total + 0.5 * SYMBOLS) for c in "0Azf+/_.=-$"}
        self.own = {c: math.log(p) for c, p in share.items()}
        self.after = {two: {c: math.log((follows.get(two + c, 0) + pull * p) / (n + pull)) for c, p in share.items()} for two, n in whole.items()}

    def score(self, word: str) -> float:
        s = f"^^{word}$"
        return sum(self.after.get(s[i : i + 2], self.own)[s[i + 2]] for i in range(len(s) - 2))


def follows_of(words: Counter) -> Counter:
    """Of class strings with their numbers: how often each class or end follows each two."""
    out: Counter = Counter()
    for word, n in words.items():
        s = f"^^{word}$"
        for i in range(len(s) - 2):
            out[s[i : i + 3]] += n
    return out


def _apart(word: str) -> bool:
    return zlib.crc32(word.encode()) % KEPT_APART == 0


class Formats:
    """Automata by kind with their thresholds, and the background."""

    def __init__(self, labelled: dict[str, list[str]], follows: dict[str, int]) -> None:
        self.back = Background(follows)
        self.kinds: dict[str, tuple[Automaton, float, float]] = {}
        self.seen: dict[str, str | None] = {}
        for kind, words in sorted(labelled.items()):
            learned = [classes(w) for w in words if not _apart(w)] or [classes(w) for w in words]
            automaton = Automaton(learned)
            scored = [self._scores(automaton, w) for w in [classes(w) for w in words if _apart(w)] or learned]
            fit, over = (sorted(x)[int(BELOW * len(scored))] for x in zip(*scored))
            self.kinds[kind] = automaton, fit, max(over, MARGIN)

    def _scores(self, automaton: Automaton, word: str) -> tuple[float, float]:
        """Mean log-likelihood under the format, and what it is above the background's."""
        fit = automaton.score(word) / (len(word) + 1)
        return fit, fit - self.back.score(word) / (len(word) + 1)

    def kind_of(self, token: str) -> str | None:
        """The kind whose format the token fits best, if any passes its threshold."""
        word = classes(token)
        if word not in self.seen:
            if len(self.seen) > 50_000:
                self.seen.clear()
            found = [(s[1] - over, k) for k, (a, fit, over) in self.kinds.items() if (s := self._scores(a, word))[0] >= fit and s[1] >= over]
            self.seen[word] = max(found)[1] if found else None
        return self.seen[word]


def free_tokens(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Places of the candidate tokens that no base span overlaps."""
    at = reach = 0  # base spans that begin before the token's end, and where the last of them ends
    for m in TOKEN.finditer(text):
        a, b = m.span()
        while at < len(base) and base[at][0] < b:
            reach = max(reach, base[at][2])
            at += 1
        if reach <= a:
            yield a, b


def ordinary(text: str, spans: list[tuple[int, int, int]]) -> list[str]:
    """The classes of the tokens of a text outside its base spans."""
    out, at = [], 0
    for a, _, b in spans:
        out.append(text[at:a] if a > at else "")
        at = max(at, b)
    return _ORDINARY.findall(" ".join([*out, text[at:]]).translate(_TABLE))


def learn(docs: DataFrame, sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> Formats:
    """Formats of a sample of ``docs``' credentials, by hash of the string: of each kind ``sample`` at most and, in that order, as many as
    have ``sample_chars`` characters together (a longer string is not learned from). The background is summed over the tokens of all texts.

    Null and empty texts have neither. A string counts once, however many rows hold it. Other columns are ignored. A kind without strings has no automaton, so that an empty table learns nothing."""

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: set[tuple[str, str, int]] = set()
            words: Counter = Counter()
            for text in batch.text:
                if text is None:
                    continue
                spans = base_spans(text)
                rows |= {(f"like_{KINDS[k]}", ASSIGN.match(text, a).group(2) if k == 0 else text[a:b], 1) for a, k, b in spans}
                words.update(ordinary(text, spans))
            yield pd.DataFrame([*sorted(rows), *(("", c, n) for c, n in sorted(follows_of(words).items()))], columns=["kind", "word", "n"])

    found = small_batches(docs).select(F.col("text").cast("string").alias("text")).mapInPandas(gather, "kind string, word string, n long")
    distinct = durable(found.groupBy("kind", "word").agg(F.sum("n").alias("n")), "secret-words")  # all credentials, and a row for each three classes; one pass over the corpus
    rows = distinct.where("kind = ''")  # fewer than 12 * 12 * 11 rows
    for k in KINDS:
        first = distinct.where(F.col("kind") == f"like_{k}").withColumn("h", F.xxhash64("word")).orderBy("h", "word").limit(sample)
        so_far = F.sum(F.char_length("word")).over(Window.orderBy("h", "word").rowsBetween(Window.unboundedPreceding, 0))  # over ``sample`` rows
        rows = rows.unionByName(first.withColumn("so_far", so_far).where(F.col("so_far") <= sample_chars).select("kind", "word", "n"))
    by: dict[str, list[str]] = defaultdict(list)
    follows = {}
    for row in rows.collect():  # 3 * sample_chars characters and the classes at most
        if row.kind:
            by[row.kind].append(row.word)
        else:
            follows[row.word] = row.n
    return Formats({k: sorted(v) for k, v in by.items()}, follows)


def all_spans(text: str, formats: Formats) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, str]]]:
    """The base spans, and (start, end, kind) of learned ones that no base span overlaps."""
    base = base_spans(text)
    if not formats.kinds:
        return base, []
    return base, [(a, b, kind) for a, b in free_tokens(text, base) if (kind := formats.kind_of(text[a:b]))]


def scan(docs: DataFrame, formats: Formats) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> (doc_id, n_assign, n_access, n_hex, base, spans), one row for each input row.

    ``base`` and ``spans`` are comma-joined ``kind:start:end`` in code points; learned spans have kinds ``like_<kind>``
    and come in order of their start among the base ones. Null and empty texts have none; very long texts and tokens are read whole. Repeated rows each get a row;
    other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(formats)  # bounded by SAMPLE_CHARS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in slices(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                base, more = all_spans(text or "", known)
                named = [(a, k, f"{KINDS[k]}:{a}:{b}") for a, k, b in base]
                every = sorted(named + [(a, len(KINDS), f"{kind}:{a}:{b}") for a, b, kind in more])
                count = Counter(k for _, k, _ in base)
                rows.append((count[0], count[1], count[2], ",".join(x[2] for x in named), ",".join(x[2] for x in every)))
            columns = list(zip(*rows)) if rows else [()] * 5
            arrays = [pa.array(c, pa.int64()) for c in columns[:3]] + [pa.array(c, pa.string()) for c in columns[3:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", "n_assign", "n_access", "n_hex", "base", "spans"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base string, spans string")


def digest(base: str) -> str:
    return hashlib.sha256(base.encode()).hexdigest()


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs, learn(docs)).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")
