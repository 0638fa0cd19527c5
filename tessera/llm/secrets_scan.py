"""Secret scans (operator 8): candidates of whole texts, and a random forest that removes false positives.

Candidates: runs of 16 key characters or more with a digit, capitals throughout or mixed case, dotted parts included (web
tokens); values of LEAST_VALUE bytes or more behind a name with a secret's word and `:` or `=`, whatever their
characters; passwords in addresses; what follows `Bearer` or `Basic`; whole private-key blocks.  Not candidates: shorter values, and runs of small
letters that no name introduces.

The forest sees the length, character classes and transitions, dictionary coverage, the path (here the document's source) and the
neighbouring words, which are up to NEIGHBOURS whole words of the same line on each side.  The dictionary and the transitions
are learnt from the corpus (`learn_language`: document frequencies over all texts).  The forest is trained from labelled findings;
`example_findings` makes a labelled set by rule where no reviewed one is at hand.

Defined results: null and empty texts have no finding; a null path is empty; every occurrence in repeated rows or texts is
a finding; candidates that overlap are one; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common

RUN = re.compile(rb"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{16,}(?:\.[A-Za-z0-9+/_\-]{8,})*={0,2}")
LEAST_VALUE = 6
NEIGHBOURS, WITHIN = 8, 400
#: The dictionary holds so many words, those of most documents; the fit takes so many findings, by a hash of them.
MOST_WORDS, MOST_FINDINGS = 50_000, 20_000
# Words of a secret's name; words beside a harmless run; path parts of examples and tests; starts of known keys.
SECRET_WORDS = ["password", "passwd", "passphrase", "pwd", "secret", "token", "key", "apikey", "credential", "auth", "bearer", "access", "private"]
HARMLESS_WORDS = ["sha256", "sha1", "md5", "commit", "hash", "checksum", "digest", "uuid", "version", "example", "sample", "dummy", "http", "www", "phone", "card", "id"]
EXAMPLE_PATHS = ["test", "example", "sample", "doc", "fixture", "mock"]
PREFIXES = (b"AKIA", b"ASIA", b"ghp_", b"gho_", b"sk_live_", b"xoxb-", b"xoxp-", b"AIza", b"eyJ", b"glpat-", b"npm_")
_SEPARATOR = re.compile(rb"[:=]")
_NAME = re.compile(rb"([A-Za-z_][A-Za-z0-9_\-]{1,60})[\"']? {0,2}$")
_SECRET_NAME = re.compile("|".join(SECRET_WORDS).encode())
_VALUE = re.compile(rb"[=>]?[ \t]{0,4}(?:\"([^\"\n]+)\"|'([^'\n]+)'|([^\s\"',;]+))")
_ADDRESS = re.compile(rb"://[^/\s:@]{1,200}:([^@\s/]+)@")
_BEARER = re.compile(rb"\b[Bb](?:earer|EARER|asic|ASIC)[ \t]+([A-Za-z0-9+/_\-.=~]{8,})")
_BLOCK = re.compile(rb"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----.*?-----END [A-Z ]{0,40}PRIVATE KEY-----", re.S)
_PLACEHOLDER = re.compile(rb"^(?:<.*>|\$\{?.*|%.*%|\{\{.*|(.)\1+|your.*|change.?me|(?:none|null|true|false|undefined|required|optional|redacted|hidden|n/a)[.)]?|.*\(.*)$", re.I | re.S)
_LETTERS, _VOWELS, _HEX = re.compile(rb"[a-z]+"), re.compile(rb"[aeiouAEIOU]"), re.compile(rb"[0-9a-f]")
_HARMLESS = re.compile(rb"\b(?:" + "|".join(HARMLESS_WORDS).encode() + rb")\b")
_KIND = np.zeros(256, np.int8)
_KIND[ord("0") : ord("9") + 1], _KIND[ord("A") : ord("Z") + 1], _KIND[ord("a") : ord("z") + 1] = 1, 2, 3
#: How a candidate was found.
PLAIN, VALUE, ADDRESS, BEARER, BLOCK = range(5)
FEATURES = [
    "length", "digit_share", "upper_share", "transitions", "hex_share", "entropy", "vowel_share", "dictionary", "likelihood", "keyed", "secret_near",
    "harmless_near", "example_path", "longest_letters", "symbol_share", "known_prefix", "quoted", "placeholder", "spaces", "in_address", "block",
]


@dataclass(frozen=True)
class Language:
    """Frequent words of a corpus (small ASCII letters, 3 to 20), and log probabilities of letter transitions in them."""

    words: frozenset[bytes]
    transitions: np.ndarray

    @staticmethod
    def of(frequencies: dict[bytes, int]) -> Language:
        pairs = np.ones((26, 26))
        for word, n in frequencies.items():
            w = np.frombuffer(word, np.uint8) - 97
            np.add.at(pairs, (w[:-1], w[1:]), n)
        return Language(frozenset(frequencies), np.log(pairs / pairs.sum(axis=1, keepdims=True)))

    def coverage(self, low: bytes) -> int:
        """Letters of a run of small letters that words cover, longest words first."""
        i, covered, n = 0, 0, len(low)
        while i < n - 2:
            for j in range(min(n, i + 20), i + 2, -1):
                if low[i:j] in self.words:
                    covered += j - i
                    i = j
                    break
            else:
                i += 1
        return covered

    def likelihood(self, low: bytes) -> tuple[float, int]:
        """Summed log probability of the transitions of a run of small letters, and their number."""
        w = np.frombuffer(low, np.uint8) - 97
        return float(self.transitions[w[:-1], w[1:]].sum()), max(0, len(w) - 1)


def learn_language(df: DataFrame, text_col: str = "text", most: int = MOST_WORDS) -> Language:
    """From document frequencies of words over all texts; the `most` words of most documents come to the driver."""
    pattern = re.compile(rb"(?<![a-z])[a-z]{3,20}(?![a-z])")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def emit() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held], pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for chunk in common.chunks(batches, text_col):
            for raw in common.raw_texts(chunk.column(0)):
                held.update(set(pattern.findall(raw.lower())))
                if len(held) > 400_000:
                    yield emit()
        if held:
            yield emit()

    counted = common.map_arrow(df.select(text_col), count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    # Written first: a collected limit would bring `most` words of each partition to the driver.
    common_words = common.staged(counted.orderBy(F.desc("n"), "word").limit(most), "words")
    return Language.of({r["word"].encode(): r["n"] for r in common_words.collect()})


# Frequent syllables, for a language where no corpus is at hand.
SYLLABLES = (
    "the and ing ion tion ent for her ter hat tha ere ate his con res ver all ons nce men ith ted ers pro thi wit are ess not ive was ect rea com eve per int est sta "
    "cti ica ist ear ain one our iti rat ell ant que les des ment ait eur ein ich der sch und die ung ver gen ier aux eau oui pas ado cion mente los las dad over test code user name data file list"
).split()
SYLLABIC = Language.of(dict.fromkeys((w.encode() for w in SYLLABLES), 1))


def plausible(run: bytes) -> bool:
    """Runs with a digit, of capitals, or with a capital behind a small letter."""
    return not (run.isalpha() and (run.islower() or run.istitle() or run[:1] + run[1:].lower() == run))


def candidates(raw: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind) of a text's candidates in order; overlapping ones are joined, the greater kind stays."""
    found = [(*m.span(), PLAIN) for m in RUN.finditer(raw) if plausible(m.group())]
    done = 0
    for m in _SEPARATOR.finditer(raw):
        at = m.end()
        if at <= done:
            continue
        name = _NAME.search(raw[max(0, at - 65) : at - 1])
        if name and _SECRET_NAME.search(name.group(1).lower()):
            value = _VALUE.match(raw, at)
            if value:
                a, b = value.span(value.lastindex)
                if b - a >= LEAST_VALUE and not raw.startswith(b"//", a):
                    found.append((a, b, VALUE))
                    done = b
    if b"://" in raw:
        found += [(*m.span(1), ADDRESS) for m in _ADDRESS.finditer(raw)]
    found += [(*m.span(1), BEARER) for m in _BEARER.finditer(raw)]
    if b"PRIVATE KEY-----" in raw:
        found += [(*m.span(), BLOCK) for m in _BLOCK.finditer(raw)]
    found.sort()
    out: list[tuple[int, int, int]] = []
    for a, b, kind in found:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), max(kind, out[-1][2]))
        else:
            out.append((a, b, kind))
    return out


def neighbours(raw: bytes, a: int, b: int, words: int = NEIGHBOURS, within: int = WITHIN) -> tuple[bytes, bytes]:
    """What stands before and behind on the same line: whole words, `words` of them at most, that lie within so many bytes."""
    before = raw[max(0, a - within) : a].rsplit(b"\n", 1)[-1]
    after = raw[b : b + within].split(b"\n", 1)[0]
    if len(before) == within and a > within:
        before = before.partition(b" ")[2]
    if len(after) == within and b + within < len(raw):
        after = after.rpartition(b" ")[0]
    return b" ".join(before.split(b" ")[-words - 1 :]), b" ".join(after.split(b" ")[: words + 1])


def features(run: bytes, before: bytes, after: bytes, path: str, kind: int = PLAIN, language: Language = SYLLABIC) -> list[float]:
    data = np.frombuffer(run, np.uint8)
    kinds = _KIND[data]
    n = len(run)
    counts = np.bincount(data, minlength=256)
    share = counts[counts > 0] / n
    low = run.lower()
    near = (before + b" " + after).lower()
    head = before.rstrip(b"\"' ")
    name = _NAME.search(head[:-1]) if head[-1:] in b":=" and head else None
    keyed = bool(name) and _SECRET_NAME.search(name.group(1).lower()) is not None
    letters = _LETTERS.findall(low)
    logs = [language.likelihood(x) for x in letters if len(x) > 1]
    return [
        n,
        float((kinds == 1).mean()),
        float((kinds == 2).mean()),
        float((np.diff(kinds) != 0).sum() / max(1, n - 1)),
        len(_HEX.findall(run)) / n,
        float(-(share * np.log2(share)).sum()),
        len(_VOWELS.findall(run)) / max(1, int((kinds > 1).sum())),
        sum(language.coverage(x) for x in letters) / n,
        sum(x for x, _ in logs) / max(1, sum(k for _, k in logs)),
        1.0 * bool(name) + 1.0 * keyed,
        float(_SECRET_NAME.search(near) is not None),
        float(_HARMLESS.search(near) is not None),
        float(any(p in path.lower() for p in EXAMPLE_PATHS)),
        max(map(len, letters), default=0),
        float((kinds == 0).mean()),
        float(run.startswith(PREFIXES)),
        float(before[-1:] in (b'"', b"'")),
        float(_PLACEHOLDER.match(run) is not None),
        run.count(b" ") / n,
        float(kind in (ADDRESS, BEARER)),
        float(kind == BLOCK),
    ]


@dataclass(frozen=True)
class Forest:
    """Trees as flat arrays: feature (-1: leaf), threshold, children, and share of secrets."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, threshold, left, right, value in self.trees:
            node = np.zeros(len(x), np.int64)
            while True:
                inner = np.flatnonzero(feature[node] >= 0)
                if not len(inner):
                    break
                at = node[inner]
                goes = x[inner, feature[at]] <= threshold[at]
                node[inner] = np.where(goes, left[at], right[at])
            total += value[node]
        return total / max(1, len(self.trees))


def grow_forest(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 8, least: int = 3, seed: int = 8) -> Forest:
    """Bootstrap trees; each split takes the best Gini gain among random features and random thresholds between values."""
    draw = np.random.default_rng(seed)
    made = []
    for _ in range(trees):
        rows = draw.integers(0, len(x), len(x))
        nodes: list[list[float]] = []

        def grow(own: np.ndarray, level: int) -> int:
            at = len(nodes)
            share = float(y[own].mean())
            nodes.append([-1, 0.0, 0, 0, share])
            if level == depth or len(own) < 2 * least or share in (0.0, 1.0):
                return at
            best, where = 1e-9, None
            for f in draw.choice(x.shape[1], max(1, int(np.sqrt(x.shape[1]))), replace=False):
                values = x[own, f]
                low, high = values.min(), values.max()
                if low == high:
                    continue
                cuts = np.unique(np.quantile(values, draw.random(12)))
                goes = values[:, None] <= cuts[None, :]
                n_left = goes.sum(axis=0)
                ok = (n_left >= least) & (len(own) - n_left >= least)
                if not ok.any():
                    continue
                ones = (goes & (y[own] > 0)[:, None]).sum(axis=0)
                n_right, rest = len(own) - n_left, y[own].sum() - ones
                p, q = ones / np.maximum(n_left, 1), rest / np.maximum(n_right, 1)
                gain = share * (1 - share) - (n_left * p * (1 - p) + n_right * q * (1 - q)) / len(own)
                gain[~ok] = -1
                k = int(gain.argmax())
                if gain[k] > best:
                    best, where = gain[k], (int(f), float(cuts[k]))
            if where is None:
                return at
            goes = x[own, where[0]] <= where[1]
            left = grow(own[goes], level + 1)
            right = grow(own[~goes], level + 1)
            nodes[at] = [where[0], where[1], left, right, share]
            return at

        grow(rows, 0)
        f, t, a, b, v = zip(*nodes)
        made.append((np.array(f, np.int64), np.array(t), np.array(a, np.int64), np.array(b, np.int64), np.array(v)))
    return Forest(made)


@dataclass(frozen=True)
class Scanner:
    """A trained forest and the language its features were taken with."""

    forest: Forest
    language: Language = SYLLABIC


Finding = tuple[str, str, str, str, int, int]


def example_findings(n: int = 4000, seed: int = 88, language: Language = SYLLABIC) -> list[Finding]:
    """Labelled findings (run, before, after, path, kind, is_secret) by rule.

    Secrets: keys and passwords of usual forms beside settings, in addresses and blocks.  Others: long words, capitals, digests,
    identifiers, versions, numbers, placeholders, and settings whose values are words or references.
    """
    draw = np.random.default_rng(seed)
    pick = lambda options: options[int(draw.integers(len(options)))]
    chars = lambda alphabet, size: "".join(alphabet[i] for i in draw.integers(0, len(alphabet), int(size)))
    known = sorted(w.decode() for w in language.words)
    lower, digits, signs = "abcdefghijklmnopqrstuvwxyz", "0123456789", "!$#&*?%+-_.^"
    letters = lower + lower.upper()
    # Words of either list also stand beside the other kind of finding: addresses of examples, identifiers, talk of keys.
    aside = lambda: pick([f"{pick(known)}@mail.example.com", f"www.{pick(known)}.org", f"id {chars(digits, 4)}", "see version 2", "key facts", "access to"])
    spoken = lambda: chars(lower, draw.integers(2, 9)) if draw.random() < 0.3 else aside() if draw.random() < 0.08 else pick(known)
    prose = lambda: " ".join(spoken() for _ in range(int(draw.integers(2, 7))))
    word = lambda: "".join(pick(known) for _ in range(int(draw.integers(2, 6)))).ljust(16, pick(lower))
    long_word = lambda: word() if len(word()) >= 16 else word() + word()
    names = ["token", "password", "api_key", "secret", "auth_token", "access_key", "db_password", "passwd", "client_secret", "PASSWORD", "pwd"]
    set_by = [" = ", "=", ": ", ":", ' = "', "='", ': "']

    def password() -> str:
        form = int(draw.integers(5))
        if form == 0:
            return chars(letters + digits + signs, draw.integers(8, 20))
        if form == 1:
            return pick(known) + chars(digits, draw.integers(1, 4)) + pick(signs) + chars(letters + digits + signs, draw.integers(2, 6))
        if form == 2:
            return chars(lower, draw.integers(4, 7)) + chars(digits, draw.integers(3, 6)) + chars(lower, draw.integers(2, 6))
        if form == 3:
            return pick(known).title() + chars(digits, 1) + pick(known) + pick(signs) + chars(digits, 1) + "-" + pick(known) + pick(signs) + pick(known)
        return chars(lower, draw.integers(14, 22))

    def behind_a_name(run: str) -> tuple[str, str, int]:
        by = pick(set_by)
        return f"{prose()} {pick(names)}{by}", (by[-1] if by[-1] in "\"'" else pick(["", ";", ","])) + " " + prose(), VALUE

    def secret(form: int) -> tuple[str, str, str, int]:
        plain = (prose() + " ", " " + prose(), PLAIN)
        if form == 0:
            run = "AKIA" + chars("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16)
            return run, *(plain if draw.random() < 0.7 else behind_a_name(run))
        if form == 1:
            run = pick(["ghp_", "sk_live_", "xoxb-", "glpat-"]) + chars(letters + digits, draw.integers(20, 40))
            return run, *(plain if draw.random() < 0.7 else behind_a_name(run))
        if form == 2:
            run = ".".join(["eyJ" + chars(letters + digits, draw.integers(15, 30)), chars(letters + digits + "_-", draw.integers(30, 120)), chars(letters + digits + "_-", 43)])
            return run, *(plain if draw.random() < 0.4 else (prose() + " Authorization: Bearer ", " " + prose(), BEARER))
        if form == 3:
            run = password()
            return run, f"{prose()} {pick(['postgres', 'https', 'mysql', 'amqp'])}://{pick(known)}:", f"@{pick(known)}.{pick(['local', 'net', 'org'])}/{pick(known)}", ADDRESS
        if form == 4:
            kind = pick(["", "RSA ", "EC "])
            return f"-----BEGIN {kind}PRIVATE KEY-----\n" + "\n".join(chars(letters + digits + "+/", 64) for _ in range(int(draw.integers(3, 14)))) + f"\n-----END {kind}PRIVATE KEY-----", "", "", BLOCK
        if form == 5:
            run = base64.b64encode(draw.bytes(int(draw.integers(15, 40)))).decode().replace("=", "")
            return run, *(plain if draw.random() < 0.5 else behind_a_name(run))
        run = [chars("0123456789abcdef", pick([32, 40, 40, 64])), chars("0123456789abcdef", draw.integers(16, 24)), chars(letters + digits, draw.integers(18, 40)), password(), password()][form - 6]
        return run, *behind_a_name(run)

    def harmless(form: int) -> tuple[str, str, str, int]:
        plain = (prose() + " ", " " + prose(), PLAIN)
        digest = (f"{prose()} {pick(['sha1 ', 'sha256:', 'commit ', 'checksum=', 'digest: ', 'uuid=', 'hash '])}", " " + prose(), PLAIN)
        if form == 0:
            return long_word() + pick(["", chars(digits, 1)]), *plain
        if form == 1:
            return long_word().upper() + pick(["", chars(digits, 1)]), *plain
        if form == 2:
            return chars("0123456789abcdef", pick([32, 40, 64])), *digest
        if form == 3:
            return f"{chars('0123456789abcdef', 8)}-{chars('0123456789abcdef', 4)}-{chars('0123456789abcdef', 4)}-{chars('0123456789abcdef', 12)}", *pick([plain, digest])
        if form == 4:
            return chars(digits, draw.integers(16, 20)), *plain
        if form == 5:
            return "-".join(chars(digits, 4) for _ in range(4)), *plain
        if form == 6:
            return pick(["x", "X", "0", "a", "*"]) * int(draw.integers(6, 32)), *behind_a_name("x")
        if form == 7:
            return long_word().title() + long_word().title(), *plain
        if form == 8:
            return "/".join([*(pick(known) for _ in range(4)), "path", pick(["v2", "list", "2024"])]), *plain
        if form == 9:
            run = pick(["${PASSWORD}", "<password>", "changeme", "your_token_here", "os.environ.get('TOKEN')", "getenv(KEY)", "undefined", "required.", "optional", "{{ secret }}"])
            return run, *behind_a_name(run)
        if form == 10:
            run = pick([w for w in (pick(known) for _ in range(40)) if len(w) >= 6] or ["nothing"])
            return run + pick(["", ".", "s"]), *behind_a_name(run)
        run = " ".join(pick(known) for _ in range(int(draw.integers(2, 6)))).ljust(LEAST_VALUE, "s")
        return run, f"{prose()} {pick(names)}: \"", '" ' + prose(), VALUE

    out: list[Finding] = []
    for i in range(n):
        path = pick(["src/app", "config/prod", "web", "source", "docs/example", "tests/unit"])
        run, before, after, kind = (secret(i // 2 % 11) if i % 2 else harmless(i // 2 % 12))
        before, after = neighbours((before + run + after).encode(), len(before.encode()), len((before + run).encode()))
        out.append((run, before.decode(), after.decode(), path, kind, i % 2))
    return out


def train(findings: list[Finding], language: Language = SYLLABIC, most: int = MOST_FINDINGS) -> Scanner:
    """The forest of at most `most` labelled findings, those of least hash."""
    own = findings if len(findings) <= most else sorted(findings, key=lambda f: xxhash.xxh64_intdigest(repr(f)))[:most]
    x = np.array([features(r.encode(), b.encode(), a.encode(), p, k, language) for r, b, a, p, k, _ in own])
    return Scanner(grow_forest(x, np.array([y for *_, y in own])), language)


def prepared(df: DataFrame, text_col: str = "text") -> Scanner:
    """A scanner with the table's own language, trained on example findings made with it."""
    learnt = learn_language(df, text_col)
    language = learnt if len(learnt.words) >= 100 else SYLLABIC
    return train(example_findings(language=language), language)


def findings_of(raw: bytes, path: str, language: Language) -> tuple[list[tuple[int, int]], list[list[float]]]:
    """Byte spans and features of a text's candidates."""
    found = candidates(raw)
    return [(a, b) for a, b, _ in found], [features(raw[a:b], *neighbours(raw, a, b), path, kind, language) for a, b, kind in found]


def _judged(chunk: pa.RecordBatch, scanner: Scanner) -> list[tuple[bytes, list[tuple[int, int]], np.ndarray]]:
    raws = common.raw_texts(chunk.column(1))
    found = [findings_of(raw, path or "", scanner.language) for raw, path in zip(raws, chunk.column(2).to_pylist())]
    rows = [r for _, own in found for r in own]
    p = scanner.forest.probability(np.array(rows)) if rows else np.zeros(0)
    out, at = [], 0
    for raw, (spans, own) in zip(raws, found):
        out.append((raw, spans, p[at : at + len(own)]))
        at += len(own)
    return out


def _rows(df: DataFrame, id_col: str, text_col: str, path_col: str) -> DataFrame:
    path = F.col(path_col).cast("string") if path_col in df.columns else F.lit("")
    return df.select(F.col(id_col).alias("id"), common.text_or_empty(text_col).alias("text"), F.coalesce(path, F.lit("")).alias("path"))


def scan(df: DataFrame, scanner: Scanner, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """One row for each candidate: (id_col, start, end, probability, is_secret), offsets in code points of the text."""

    def make(chunk: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for key, (raw, spans, p) in zip(chunk.column(0).to_pylist(), _judged(chunk, scanner)):
            byte, point = 0, 0
            for (a, b), q in zip(spans, p.tolist()):
                point += len(raw[byte:a].decode())
                size = len(raw[a:b].decode())
                out.append((key, point, point + size, q, q >= least))
                byte, point = b, point + size
        kinds = [chunk.column(0).type, pa.int64(), pa.int64(), pa.float64(), pa.bool_()]
        columns = list(zip(*out)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [id_col, "start", "end", "probability", "is_secret"])

    rows = _rows(df, id_col, text_col, path_col)
    kind = rows.schema["id"].dataType.simpleString()
    return common.map_chunks(rows, make, f"`{id_col}` {kind}, start bigint, end bigint, probability double, is_secret boolean")


def redact(df: DataFrame, scanner: Scanner, least: float = 0.5, mark: str = "[SECRET]", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """The table with every secret in its texts replaced by the mark; n_chars follows where there is such a column.  Nulls stay null."""
    names, at = df.columns, df.columns.index(text_col)
    sizes = "n_chars" in names
    hidden = mark.encode()

    def run(batches):  # noqa: ANN001, ANN202
        for chunk in common.chunks(batches, text_col):
            path = chunk.column(names.index(path_col)).cast(pa.string()) if path_col in names else pa.nulls(chunk.num_rows, pa.string())
            texts: list[str | None] = chunk.column(at).to_pylist()
            small = pa.RecordBatch.from_arrays([path, chunk.column(at), path], ["id", "text", "path"])
            changed = False
            for i, (raw, spans, p) in enumerate(_judged(small, scanner)):
                hit = [s for s, q in zip(spans, p) if q >= least]
                if hit:
                    cuts = [0, *(x for s in hit for x in s), len(raw)]
                    texts[i] = hidden.join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2])).decode()
                    changed = True
            if changed:
                columns = list(chunk.columns)
                columns[at] = pa.array(texts, chunk.schema.field(at).type)
                if sizes:
                    columns[names.index("n_chars")] = pa.array([None if t is None else len(t) for t in texts], chunk.schema.field(names.index("n_chars")).type)
                chunk = pa.RecordBatch.from_arrays(columns, schema=chunk.schema)
            yield chunk

    return common.map_arrow(df, run, df.schema)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates with their verdicts.  The tables hold no labelled findings, so the forest is trained on `example_findings`."""
    docs = common.documents(spark, sf_dir)
    return scan(docs, prepared(docs))
