"""Secret scans: pattern candidates, and a random forest that removes false positives.

Candidates are known key formats, values assigned to a name such as `password` or `token`, and long runs of key characters with a
digit. Known formats are looked for in the whole text, also inside longer values and runs; a private key goes from BEGIN to END.
A quoted value ends at its closing quote; one without quotes ends at white space, a quote, or any of `,;<>(){}[]`. Each gets features of its length, its character transitions, how much of it dictionary words cover, its path and
its neighbouring words. A random forest trained from labelled findings (candidate, before, after, path, label) keeps true secrets.

The tables here hold no labelled findings, so `labelled_findings` makes a bounded set by rule: keys of the usual
formats, and what is often taken for one (checksums, commit and object ids, placeholders, file paths, code, encoded images). `fit`
takes any other table of that form. Texts are scanned whole in one pass without a shuffle; all rows are scanned.

Defined results: null and empty texts have no findings; a null path counts as empty; rows without id are scanned like others;
repeated rows give repeated results; candidates don't overlap: a known format takes its place first, then assigned values,
the innermost first, then runs, and of what holds another one the parts around it are candidates of their own, if long enough;
a private key without END ends with its last line of key characters or headers; findings of one class only, or none, make a forest that gives every candidate their share (1 without findings: everything is kept as a
secret); an empty table gives an empty result; other columns pass through, a column with the output's name is replaced.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

from .tables import documents, small_batches

#: Findings that a forest is fitted on at most.
MOST_FINDINGS = 6000
TREES = 48
DEPTH = 9
LEAST_LEAF = 2
CONTEXT = 48
CUT = 0.5

# Key formats as their issuers publish them.
FORMATS = {
    "aws-access-key": r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])",
    "github-token": r"gh[pousr]_[A-Za-z0-9]{36,}",
    "slack-token": r"xox[abprs]-[A-Za-z0-9-]{10,}",
    "stripe-key": r"[sr]k_live_[A-Za-z0-9]{16,}",
    "google-api-key": r"AIza[0-9A-Za-z_-]{35}",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+",
    "private-key": (
        r"-----BEGIN [A-Z0-9 ]{0,20}PRIVATE KEY(?: BLOCK)?-----"
        r"(?:(?:[^-]++|-(?!----(?:BEGIN|END) ))*+-----END [A-Z0-9 ]{0,20}PRIVATE KEY(?: BLOCK)?-----"
        r"|(?:[ \t]*+(?:\r?\n|\\r\\n|\\n)[ \t]*+(?:[A-Za-z0-9+/=]++|[A-Za-z-]{1,40}: [^\\\n]*+|)(?=[ \t]*+(?:\r?\n|\\r\\n|\\n|[\"'`]|\Z)))*+)"
    ),
}
#: What comes before a format, so that a long run is looked through once: a token begins at the first mark of its run.
_AHEAD = {"jwt": r"(?<![A-Za-z0-9_-])(?:(?!eyJ)[A-Za-z0-9_-])*+"}
# One of these is in every text that holds a format.
FORMAT_MARKS = ["AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "k_live_", "AIza", "eyJ", "-----BEGIN "]
# Names that secrets are assigned to.
NAMES = ["password", "passwd", "pwd", "passphrase", "secret", "token", "api_key", "apikey", "access_key", "private_key", "auth_key", "client_secret", "credential", "credentials"]
# Neighbouring words that speak for or against a secret.
AGAINST_WORDS = ["sha1", "sha256", "sha512", "md5", "checksum", "digest", "hash", "commit", "revision", "uuid", "guid", "etag", "integrity", "fingerprint", "base64", "image", "png", "version", "build", "trace", "object", "blob"]
PLACEHOLDER_WORDS = ["example", "sample", "dummy", "placeholder", "changeme", "change_me", "your", "xxxx", "redacted", "fake", "test", "todo", "none", "null", "environ", "getenv", "config", "insert", "enter"]
# Parts of paths that hold tests, documents and fixtures.
HARMLESS_PATHS = ["test", "tests", "spec", "fixture", "fixtures", "example", "examples", "sample", "samples", "doc", "docs", "mock", "lock", "vendor"]
# Common words in identifiers and prose.
DICTIONARY = (
    "able about access account action active admin after again agent allow also application array async back base batch been before begin between block body both branch buffer build button cache call case change "
    "channel char check child class clean clear client close code collection column command common config connect connection content context control copy count create current custom data database date debug default "
    "delete device directory display document domain down download each edit element email empty enable encode engine enter entry error event example exception export factory false field file filter find first flag float "
    "folder form format frame from function get global group guide handle handler hash have header here home host html http icon image import index info init inner input insert install instance integer interface internal "
    "item java json keep key label language large last layer layout length level library limit line link list load local lock login main make manager map master match max member memory message method min mode model module "
    "more name network next node none null number object open option order other output package page param parent parse part pass password path pattern place plugin point policy pool port prefix private process project "
    "property provider public query queue quick random range read record release remote remove report request reset resource response result return role root route rule sample save schema script search secret section select "
    "send server service session set shared short show simple site size sort source split stack start state static status step stop storage store stream string style sub system table target task template test text that the this "
    "thread time title token tool total trace tree true type unit update upload url user util valid value version view wait web when with word work write your"
).split()

# One of these is in every name, in lower case.
NAME_MARKS = ["pass", "pwd", "secret", "token", "key", "credential"]

LEAST_VALUE, LEAST_RUN = 6, 20
_NAME = "|".join(sorted((n.replace("_", "[_-]?") for n in NAMES), key=len, reverse=True))
_ASSIGNS = re.compile(rf"(?i:{_NAME})[A-Za-z0-9_]{{0,24}}[\"']?[ \t]{{0,4}}(?:=>|:=|=|:)[ \t]{{0,4}}")
_QUOTED = re.compile(r"""(?P<t>\"{3}|'{3})(?:\\[\s\S]|(?!(?P=t))[^\\])*+(?P=t)|(?P<q>["'`])(?:\\.|(?!(?P=q))[^\\\r\n])*+(?P=q)""")
_BARE = re.compile(r"[^\s\"'`,;<>(){}\[\]]+")
_RUN = re.compile(rf"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])([A-Za-z0-9+/_-]{{{LEAST_RUN},}})")
_FORMAT = re.compile("|".join(f"{_AHEAD.get(name, '')}(?P<f{k}>{pattern})" for k, (name, pattern) in enumerate(FORMATS.items())))
_RULES = {f"f{k}": name for k, name in enumerate(FORMATS)}
_WORDS = re.compile("|".join(sorted((w for w in DICTIONARY if len(w) > 2), key=len, reverse=True)))
_RUNS = re.compile(r"(.)\1{2,}")
_PARTS = re.compile(r"[a-z0-9]+")
_KINDS = np.full(128, 4, np.int64)  # 0 lower case, 1 upper case, 2 digit, 3 other key characters, 4 the rest
_KINDS[97:123], _KINDS[65:91], _KINDS[48:58] = 0, 1, 2
_KINDS[[ord(c) for c in "+/_-="]] = 3
_ALPHABET = 128

FEATURES = [
    "length", "entropy", "transitions", "kind_changes", "dictionary", "digits", "upper", "others", "distinct", "repeats",
    "hexadecimal", "known_format", "assigned", "harmless_path", "near_name", "near_against", "near_placeholder", "placeholder",
]


@dataclass
class Candidate:
    rule: str
    start: int
    stop: int
    text: str
    before: str
    after: str
    path: str


def _assigned(text: str) -> Iterator[tuple[int, int, str]]:
    """Disjoint parts of assigned values, in order; a value inside another one goes first, and the outer one keeps the rest."""
    open_ends: list[int] = []
    at = bare = 0
    for m in _ASSIGNS.finditer(text):
        a = m.end()
        if quoted := _QUOTED.match(text, a):
            n = len(quoted["t"] or quoted["q"])
            a, b = a + n, quoted.end() - n
        else:
            a += text[a : a + 1] in ("'", '"', "`")
            if a >= bare:  # a value that begins inside another one without quotes has the same end
                bare = value.end() if (value := _BARE.match(text, a)) else a
            b = bare
        if b - a < LEAST_VALUE:
            continue
        while open_ends and open_ends[-1] <= a:
            end = open_ends.pop()
            yield at, end, "assigned-value"
            at = max(at, end)
        if open_ends:
            yield at, a, "assigned-value"
        at = a
        open_ends.append(b)
    while open_ends:
        end = open_ends.pop()
        yield at, end, "assigned-value"
        at = max(at, end)


def _outside(spans: Iterator[tuple[int, int, str]], taken: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, str]]:
    """The parts of `spans` that `taken` doesn't cover; both are in order and disjoint."""
    k = 0
    for a, b, rule in spans:
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        j = k
        while j < len(taken) and taken[j][0] < b:
            yield a, taken[j][0], rule
            a = taken[j][1]
            j += 1
        yield a, b, rule


def candidates(text: str, path: str) -> Iterator[Candidate]:
    """All candidates of a text, in order; they don't overlap. Positions are in code points."""
    taken = [(*m.span(m.lastgroup), _RULES[m.lastgroup]) for m in _FORMAT.finditer(text)] if any(mark in text for mark in FORMAT_MARKS) else []
    folded = text.casefold()
    if any(mark in folded for mark in NAME_MARKS):
        taken = sorted(taken + [s for s in _outside(_assigned(text), taken) if s[1] - s[0] >= LEAST_VALUE])
    runs = _outside(((*m.span(1), "key-like-run") for m in _RUN.finditer(text)), taken)
    # a part of a run needs what a run needs
    taken = sorted(taken + [s for s in runs if s[1] - s[0] >= LEAST_RUN and any("0" <= c <= "9" for c in text[s[0] : s[1]])])
    for a, b, rule in taken:
        yield Candidate(rule, a, b, text[a:b], text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT // 2], path)


def _codes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("ascii", "replace"), np.uint8)
    return np.minimum(codes, _ALPHABET - 1).astype(np.int64)


def _features(c: Candidate, transitions: np.ndarray) -> list[float]:
    codes, low = _codes(c.text), c.text.lower()
    n = len(codes)
    share = np.bincount(codes, minlength=_ALPHABET)
    share = share[share > 0] / n
    kinds = _KINDS[codes]
    words = {*_PARTS.findall(c.before.lower().replace("_", " ")), *_PARTS.findall(c.after.lower().replace("_", " "))}
    before = c.before.lower()
    covered = sum(len(w) for w in _WORDS.findall(low))
    return [
        float(np.log2(n)),
        float(-(share * np.log2(share)).sum()),
        float(transitions[codes[:-1], codes[1:]].mean()) if n > 1 else 0.0,
        float((kinds[1:] != kinds[:-1]).mean()) if n > 1 else 0.0,
        covered / n,
        float((kinds == 2).mean()),
        float((kinds == 1).mean()),
        float((kinds > 2).mean()),
        len(share) / n,
        sum(len(m.group()) for m in _RUNS.finditer(c.text)) / n,
        float(not low.strip("0123456789abcdef")),
        float(_FORMAT.search(c.text) is not None),
        float(c.rule == "assigned-value"),
        float(any(p in HARMLESS_PATHS for p in _PARTS.findall(c.path.lower()))),
        float(any(name in before for name in NAMES)),
        float(any(w in words for w in AGAINST_WORDS)),
        float(any(w in words for w in PLACEHOLDER_WORDS)),
        float(any(w in low for w in PLACEHOLDER_WORDS)),
    ]


@dataclass
class Forest:
    """Trees of parallel arrays; feature -1 marks a leaf. Without trees, a constant."""

    transitions: np.ndarray
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    constant: float = 1.0

    def score(self, found: list[Candidate]) -> np.ndarray:
        if not found or not self.trees:
            return np.full(len(found), self.constant)
        return self.predict(np.array([_features(c, self.transitions) for c in found]))

    def predict(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, threshold, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH + 1):
                inner = feature[at] >= 0
                goes_left = x[rows, np.maximum(feature[at], 0)] < threshold[at]
                at = np.where(inner, np.where(goes_left, left[at], right[at]), at)
            out += value[at]
        return out / len(self.trees)


def _split(x: np.ndarray, y: np.ndarray, tried: np.ndarray) -> tuple[float, int, float]:
    """The best Gini gain, its feature and threshold."""
    best, n, total = (0.0, -1, 0.0), len(y), y.sum()
    parent = total * (n - total) / n
    for f in tried:
        order = np.argsort(x[:, f], kind="stable")
        values, ones = x[order, f], np.cumsum(y[order])[:-1]
        left = np.arange(1, n)
        inner = ones * (left - ones) / left + (total - ones) * (n - left - (total - ones)) / (n - left)
        inner[(values[1:] <= values[:-1]) | (left < LEAST_LEAF) | (n - left < LEAST_LEAF)] = np.inf
        k = int(np.argmin(inner)) if n > 1 else 0
        if n > 1 and parent - inner[k] > best[0] + 1e-12:
            best = float(parent - inner[k]), int(f), float((values[k] + values[k + 1]) / 2)
    return best


def _tree(x: np.ndarray, y: np.ndarray, draw: np.random.Generator) -> tuple[np.ndarray, ...]:
    nodes: list[list] = [[-1, 0.0, 0, 0, 0.0]]
    todo = [(0, np.arange(len(y)), 0)]
    while todo:
        at, rows, depth = todo.pop()
        nodes[at][4] = float(y[rows].mean())
        if depth == DEPTH or 0 < len(rows) < 2 * LEAST_LEAF or nodes[at][4] in (0.0, 1.0):
            continue
        gain, feature, threshold = _split(x[rows], y[rows], draw.permutation(x.shape[1])[: int(np.sqrt(x.shape[1])) + 1])
        if feature < 0:
            continue
        goes_left = x[rows, feature] < threshold
        nodes[at][:4] = feature, threshold, len(nodes), len(nodes) + 1
        todo += [(len(nodes), rows[goes_left], depth + 1), (len(nodes) + 1, rows[~goes_left], depth + 1)]
        nodes += [[-1, 0.0, 0, 0, 0.0], [-1, 0.0, 0, 0, 0.0]]
    columns = list(zip(*nodes, strict=True))
    return np.array(columns[0]), np.array(columns[1]), np.array(columns[2]), np.array(columns[3]), np.array(columns[4])


def _learn_transitions(found: list[Candidate], y: np.ndarray) -> np.ndarray:
    """Log odds of each pair of neighbouring characters between true and false findings, smoothed."""
    counts = np.full((2, _ALPHABET, _ALPHABET), 0.5)
    for c, label in zip(found, y, strict=True):
        codes = _codes(c.text)
        weight = 1 / max(len(codes) - 1, 1)  # each finding counts alike
        np.add.at(counts[int(label)], (codes[:-1], codes[1:]), weight * 16)
    counts /= counts.sum(2, keepdims=True)
    return np.log(counts[1] / counts[0])


def fit(findings: DataFrame, most: int = MOST_FINDINGS, seed: int = 11) -> Forest:
    """A forest from at most `most` labelled findings (candidate, before, after, path, label), those whose hashes come first."""
    known = findings.where(F.col("candidate").isNotNull() & (F.col("candidate") != "") & F.col("label").isNotNull())
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    known = known.select("candidate", empty("before"), empty("after"), empty("path"), F.col("label").cast("int").alias("label"))
    rows = known.orderBy(F.xxhash64(*known.columns), *known.columns).limit(most).collect()  # bounded by `most`
    found, y = [], np.array([float(r["label"]) for r in rows])
    for r in rows:
        text, at = f"{r['before']}{r['candidate']}{r['after']}", len(r["before"])
        rule = next((c.rule for c in candidates(text, "") if c.start <= at < c.stop), "key-like-run")
        found.append(Candidate(rule, 0, 0, r["candidate"], r["before"][-CONTEXT:], r["after"][: CONTEXT // 2], r["path"]))
    if len(set(y)) < 2:
        return Forest(np.zeros((_ALPHABET, _ALPHABET)), [], float(y.mean()) if len(y) else 1.0)
    # transitions are learned on one half, and the forest on the other, so that it doesn't trust them too much
    half = np.arange(len(y)) % 2 == 0
    if len(set(y[half])) < 2 or len(set(y[~half])) < 2:
        half[:] = True
    transitions = _learn_transitions([c for c, h in zip(found, half, strict=True) if h], y[half])
    use = np.flatnonzero(~half) if not half.all() else np.flatnonzero(half)
    x, y = np.array([_features(found[k], transitions) for k in use]), y[use]
    draw = np.random.default_rng(seed)
    trees = []
    for _ in range(TREES):
        rows_ = draw.integers(0, len(y), len(y))
        trees.append(_tree(x[rows_], y[rows_], draw))
    return Forest(transitions, trees)


def labelled_findings(spark: SparkSession, n: int = 4000, seed: int = 23) -> DataFrame:
    """`n` labelled findings made by rule, half of them secrets; the same for the same seed."""
    draw = random.Random(seed)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    some = lambda chars, k: "".join(draw.choice(chars) for _ in range(k))
    hexa = lambda k: some("0123456789abcdef", k)
    word = lambda: draw.choice(DICTIONARY) if draw.random() < 0.5 else some("etaoinshrdlu", draw.randint(2, 8))
    prose = lambda: " ".join(word() for _ in range(draw.randint(2, 6)))
    name = lambda: draw.choice(["", "db_", "my_", "aws_", "service_", "user_"]) + draw.choice(NAMES)
    assign = lambda: f"{name()}{draw.choice(['=', ' = ', ': ', ' := '])}{draw.choice(['', chr(34), chr(39)])}"
    safe_path = lambda: draw.choice(["src0", "src/app.py", "web/index.html", "", "config/prod.yml", "notes.txt"])
    dull_path = lambda: draw.choice(["tests/test_login.py", "docs/example.md", "package.lock", "fixtures/users.json"])
    rows = []
    while len(rows) < n:
        secret = len(rows) % 2 == 0
        before, after, path = prose() + " ", " " + prose(), safe_path()
        if secret:
            kind = draw.randrange(8) if draw.random() < 0.8 else draw.randrange(8, 12)
            if kind == 0:
                value = draw.choice(["AKIA", "ASIA"]) + some("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 16)
                before += assign() if draw.random() < 0.3 else ""
            elif kind == 1:
                value, before = hexa(draw.choice([16, 18, 20, 24, 32, 40, 64])), before + assign()
            elif kind == 2:
                value, before = some(alnum + "+/", draw.randint(12, 64)), before + assign()
            elif kind == 3:
                value = draw.choice(["ghp_", "gho_", "ghs_"]) + some(alnum, 36)
            elif kind == 4:
                value = draw.choice([f"sk_live_{some(alnum, 24)}", f"AIza{some(alnum + '_-', 35)}", f"xoxb-{some('0123456789', 12)}-{some(alnum, 24)}"])
            elif kind == 5:
                value, before = f"eyJ{some(alnum, 20)}.eyJ{some(alnum, 40)}.{some(alnum + '_-', 40)}", before + draw.choice(["", "Authorization: Bearer ", assign()])
            elif kind == 6:  # a password chosen by a person
                value, before = draw.choice(DICTIONARY).capitalize() + some("0123456789", draw.randint(2, 4)) + some("!#%&@$", draw.randint(1, 2)) + some(alnum, draw.randint(0, 6)), before + assign()
            elif kind == 7:
                value, before = some(alnum, draw.randint(20, 48)), before + draw.choice(["key ", "Bearer ", assign()])
            elif kind == 8:  # a known format inside a longer value or path
                value = draw.choice(["AKIA" + some("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 16), "ghp_" + some(alnum, 36), f"sk_live_{some(alnum, 24)}", f"AIza{some(alnum + '_-', 35)}"])
                before += draw.choice(["", "token_url: ", "url = "]) + f"https://{word()}/{word()}" + draw.choice(["?key=", "/", "/files/", "?id=1&k="])
            elif kind == 9:  # a quoted password with punctuation
                quote = draw.choice("\"'")
                value, before, after = some(alnum + ",;(){}[]<>!#%&@$", draw.randint(10, 20)), before + f"{name()} = {quote}", quote + after
            elif kind == 10:  # a quoted passphrase
                quote = draw.choice("\"'")
                value = " ".join(f"{draw.choice(DICTIONARY).capitalize()}{some('0123456789', 2)}" for _ in range(draw.randint(3, 5))) + draw.choice("!#%&@$")
                before, after = before + f"{name()} = {quote}", quote + after
            else:
                kind_of = draw.choice(["", "RSA ", "EC ", "OPENSSH "])
                body = "\n".join(some(alnum + "+/", 64) for _ in range(draw.randint(2, 25)))
                value = f"-----BEGIN {kind_of}PRIVATE KEY-----\n{body}\n-----END {kind_of}PRIVATE KEY-----"
        else:
            kind = draw.choice([*range(10), 12]) if draw.random() < 0.85 else draw.choice([10, 11])
            if kind == 0:
                value, before = hexa(draw.choice([40, 64, 32])), before + draw.choice(["sha256:", "md5 ", "checksum ", "commit ", "digest sha1 ", "etag ", "integrity sha512-", "object ", "build "])
            elif kind == 1:
                h = hexa(32)
                value, before = f"{h[:8]}-{h[8:12]}-4{h[13:16]}-a{h[17:20]}-{h[20:]}", before + draw.choice(["uuid ", "guid=", "trace ", "id "])
            elif kind == 2:
                value, before = draw.choice(["changeme", "your_password_here", "YOUR_TOKEN_HERE", "xxxxxxxxxxxxxxxx", "example123", "placeholder", "dummy_secret_1", "insert-your-key-here", "REDACTED-0000", "test_password1", "************"]), before + assign()
            elif kind == 3:
                value = "/".join(draw.choice(DICTIONARY) for _ in range(draw.randint(4, 8))) + str(draw.randint(0, 99))
            elif kind == 4:
                value = "_".join(draw.choice(DICTIONARY) for _ in range(draw.randint(4, 7))) + f"_v{draw.randint(1, 9)}"
            elif kind == 5:
                value, before = draw.choice(["os.environ", "config.get", "settings.SECRET", "request.password", "getToken", "self._token", "process.env.TOKEN", "user.password", "null_value"]), before + assign()
            elif kind == 6:
                value, before = some(alnum + "+/", draw.randint(80, 600)), before + draw.choice(["data:image/png;base64,", "image base64 ", "blob "])
            elif kind == 7:
                value = draw.choice(["0123456789" * 3, "1" * draw.randint(20, 30), "abcdefghijklmnopqrstuvwxyz0123456789", "0" * draw.randint(20, 40), "-" * 20 + "1", "_" * 24 + "2", "ABCDEF0123456789ABCDEF"])
            elif kind == 8:
                value = f"20{draw.randint(10, 29)}-{draw.randint(10, 12)}-{draw.randint(10, 28)}-{'-'.join(draw.choice(DICTIONARY) for _ in range(4))}"
            elif kind == 9:
                value, before, path = hexa(draw.choice([16, 20, 32])), before + assign(), dull_path()
                before += "example_" if draw.random() < 0.5 else ""
            elif kind == 10:  # a message in quotes
                quote = draw.choice("\"'")
                value, before, after = prose().capitalize() + " " + prose() + draw.choice(["", ".", "!", ", " + word()]), before + f"{name()} = {quote}", quote + after
            elif kind == 11:  # an address
                value, before = f"https://{word()}.{word()}/{word()}/{word()}" + draw.choice(["", "?key=", f"?id={draw.randint(1, 99)}", "/"]), before + name() + draw.choice(["_url: ", "_uri = "])
            else:
                value, before = draw.choice(DICTIONARY) + draw.choice(DICTIONARY), before + assign()
            path = dull_path() if draw.random() < 0.4 else path
        rows.append((value, before, after, path, int(secret)))
    return spark.createDataFrame(rows, "candidate string, before string, after string, path string, label int")


FINDING = StructType(
    [StructField("rule", StringType()), StructField("start", IntegerType()), StructField("stop", IntegerType()), StructField("score", DoubleType()), StructField("secret", BooleanType())]
)


def may_hold(text: Column) -> Column:
    """Whether a text can have a candidate: a format's mark, a part of a name, or a run of key characters. Rows without are never parsed in Python."""
    low = F.lower(text)
    signs = [*(text.contains(mark) for mark in FORMAT_MARKS), *(low.contains(mark) for mark in NAME_MARKS), text.contains("ſ"), text.rlike(f"[A-Za-z0-9+/_-]{{{LEAST_RUN}}}")]
    out = signs[0]
    for sign in signs[1:]:
        out = out | sign
    return F.coalesce(out, F.lit(False))


def scan(df: DataFrame, forest: Forest, text_col: str = "text", path_col: str | None = None, out: str = "findings", cut: float = CUT) -> DataFrame:
    """All columns of `df` and its findings, array<struct<rule, start, stop, score, secret>>, positions in code points."""
    small_batches(df.sparkSession)
    df = df.drop(out)
    shared = df.sparkSession.sparkContext.broadcast(forest)
    schema = StructType([*df.schema.fields, StructField(out, ArrayType(FINDING))])
    names = schema.fieldNames()
    found_type = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64()), ("secret", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, paths = batch.column(text_col), batch.column(path_col) if path_col else None
            *columns, maybe = batch.columns
            found: list[Candidate] = []
            counts = np.zeros(batch.num_rows, np.int64)
            for k in np.flatnonzero(maybe.to_numpy(zero_copy_only=False)):
                have = len(found)
                found += candidates(texts[int(k)].as_py(), (paths[int(k)].as_py() if path_col else None) or "")
                counts[k] = len(found) - have
            scores = shared.value.score(found)
            rows = [{"rule": c.rule, "start": c.start, "stop": c.stop, "score": float(s), "secret": bool(s >= cut)} for c, s in zip(found, scores, strict=True)]
            ends = np.cumsum(counts)
            yield pa.RecordBatch.from_arrays([*columns, pa.array([rows[e - n : e] for e, n in zip(ends, counts, strict=True)], found_type)], names)

    return df.select("*", may_hold(F.col(text_col)).alias(f"{out} may be")).mapInArrow(run, schema)


def redacted(text: Column, findings: Column) -> Column:
    """The text with every secret replaced by `[rule]`; unchanged where there is none."""
    secrets = F.filter(findings, lambda f: f["secret"])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    step = lambda acc, f: F.struct(
        f["stop"].alias("at"),
        F.concat(acc["parts"], F.array(F.substring(text, acc["at"] + 1, f["start"] - acc["at"]), F.concat(F.lit("["), f["rule"], F.lit("]")))).alias("parts"),
    )
    finish = lambda acc: F.array_join(F.concat(acc["parts"], F.array(F.substring(text, acc["at"] + 1, F.length(text)))), "")
    return F.when(F.size(secrets) > 0, F.aggregate(secrets, start, step, finish)).otherwise(text)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates, secrets and the redacted text's digest for every document; a document's source is its path."""
    forest = fit(labelled_findings(spark))
    found = scan(documents(spark, sf_dir).select("doc_id", "source", "text"), forest, path_col="source")
    secrets = F.filter("findings", lambda f: f["secret"])
    return found.select(
        "doc_id",
        F.size("findings").cast("long").alias("n_candidates"),
        F.size(secrets).cast("long").alias("n_secrets"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(secrets, lambda f: f["rule"]))), ",").alias("rules"),
        F.coalesce(F.array_max(F.transform("findings", lambda f: f["score"])), F.lit(0.0)).alias("max_score"),
        F.sha2(redacted(F.coalesce("text", F.lit("")), F.col("findings")).cast("binary"), 256).alias("redacted_sha256"),
    )


def digest(text: str | None) -> str:
    """The digest that `op7_secret_scan` gives for a text without secrets."""
    return hashlib.sha256((text or "").encode()).hexdigest()
