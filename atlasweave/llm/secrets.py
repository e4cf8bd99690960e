"""Secret scanning: regular expressions propose candidates, a random forest removes false positives.

Candidates of a whole text are runs of 16 or more key characters with a digit or inner change of case;
values of 8 or more characters that are assigned to a name, whole and in their parts between ?, &, @, = and : (as in URLs); values of 6 or more
that are assigned to the name of a secret, which may be of small letters only; passwords of 4 or more before a URL's host;
and web tokens of three parts, which are one candidate.  Shorter values are none.
The forest judges each by its length, its
character classes and transitions, how much of it dictionary words cover, whether it stands in a path or before a host, and the
words beside it.  It is trained in numpy from labelled findings: a DataFrame of the user's (at most
MAX_FINDINGS of them, a bounded sample of labelled rows) or, by default, findings that a seeded generator
labels by construction.  The forest is a bounded table, so its broadcast is too; scanning is one map over
whole texts without a shuffle.

Defined results: null and empty texts have no candidates; a null doc_id is kept; repeated rows are scanned each; a very long text is scanned
whole, and a candidate of any length is judged whole; of secrets that overlap the one with the highest score stays, then the
first, then the longest; other columns are ignored by `scan` and kept by `redact`;
an empty table gives an empty result.  Spans are code points, end exclusive, in order and without overlap.
"""

from __future__ import annotations

import math
import re
from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled findings that a forest is trained from at most; its trees and their depth.
MAX_FINDINGS, TREES, DEPTH = 8000, 31, 9
#: What replaces a secret.
REDACTED = "<SECRET>"

KEY_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
ASSIGNED = re.compile(r"[A-Za-z0-9_)\]}][\"']?[ ]{0,2}[:=]=?[ ]{0,2}[\"'`]?([^\s\"'`<>(){}\[\],;]{6,})")
LOGIN = re.compile(r"://[^\s/:@\"'<>]*:([^\s/@\"'<>]{4,})@")
WEB_TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])eyJ[A-Za-z0-9_-]{5,}(?:\.[A-Za-z0-9_-]{8,}){2}(?![A-Za-z0-9_-])")
PART = re.compile(r"[^?&@=:]{8,}={0,2}")
MIXED = re.compile(r"[0-9]|[a-z][A-Z]|[A-Z][a-z]+[A-Z]")

#: Words of ordinary names and prose, for dictionary coverage.
DICTIONARY = (
    "the and for that with this from have are was not you all can will one time about into other than then some could them see make "
    "get set put new old add end run file path name user data test main init config default value index table image page list item "
    "build source target local remote server client request response string number object array class function method module package "
    "import export version release branch commit master status error warning debug info level message event handler listener service "
    "manager factory builder provider controller component view model node edge graph tree root parent child left right first last "
    "next previous start stop open close read write load save update delete create insert select where group order count total "
    "width height color background border margin button label title header footer content section article report section field "
    "document customer order part region nation account number date year month week hour minute second example sample placeholder "
    "your here changeme insert dummy password secret token public private der die das und nicht ein eine les des une pour que los las "
    "una para por con del como ing tion ment ation heit keit ung schaft able ness ship less ful"
).split()
#: Words of generated pass phrases.
PHRASE = "apple basket candle desert engine flower garden hammer island jacket kettle ladder marble needle orange pepper rabbit silver tunnel window yellow zebra quick brown horse river stone cloud tiger lemon".split()
#: Neighbouring words that speak for a secret, and those that speak against.
SECRET_WORDS = re.compile(r"token|secret|passw|passwd|passphrase|pass(?=[\"']?[ ]{0,2}[:=])|pwd|api[ _-]?key|access[_-]?key|auth|bearer|credential|private[ _]key|client[_-]?key|signing|aws_|ssh-|webhook", re.I)
BENIGN_WORDS = re.compile(r"commit|sha-?\d*|md5|checksum|digest|hash|uuid|guid|etag|revision|isbn|build|version|integrity|trace|request[_-]?id|example|sample|placeholder|your[_-]|image|data:|href|src=|font|cache|order|invoice|phone|card|parcel|serial", re.I)
WORDS = re.compile("|".join(sorted((w for w in DICTIONARY if len(w) >= 3), key=lambda w: (-len(w), w))))
UUID = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")

FEATURES = (
    "length log_length digits lower upper symbols hex_only digits_only distinct entropy class_changes bigram_rarity longest_letters "
    "coverage uuid in_path slashes dots assigned quoted secret_before secret_after benign_before benign_after known_prefix placeholder login"
).split()
KNOWN_PREFIX = re.compile(r"AKIA[0-9A-Z]{12}|gh[pousr]_|sk[-_](?:live|test|proj)?|xox[abprs]-|AIza|eyJ|glpat-|npm_|SG\.")


def _bigrams() -> dict[str, float]:
    """How rare letter pairs are in dictionary words: -log2 of smoothed shares."""
    counts: dict[str, int] = {}
    for word in DICTIONARY:
        for a, b in zip(word, word[1:], strict=False):
            counts[a + b] = counts.get(a + b, 0) + 1
    total = sum(counts.values()) + 26 * 26
    return {a + b: -math.log2((counts.get(a + b, 0) + 1) / total) for a in map(chr, range(97, 123)) for b in map(chr, range(97, 123))}


RARITY = _bigrams()


def kind(c: str) -> int:
    return 0 if "0" <= c <= "9" else 1 if "a" <= c <= "z" else 2 if "A" <= c <= "Z" else 3


def candidates(text: str | None) -> list[tuple[int, int]]:
    """Spans of a whole text, in order; they may overlap: assigned values, their parts, runs, logins and web tokens."""
    if not text:
        return []
    values = [m.span(1) for m in ASSIGNED.finditer(text)]
    named = {v for v in values if SECRET_WORDS.search(text, max(0, v[0] - 28), v[0])}
    named |= {m.span(1) for m in LOGIN.finditer(text)}
    values = [v for v in values if v[1] - v[0] >= 8]
    found = {*values, *(m.span() for v in values for m in PART.finditer(text, *v)), *(m.span() for m in KEY_RUN.finditer(text))}
    found = {s for s in found if MIXED.search(text, *s)} | named
    tokens = [m.span() for m in WEB_TOKEN.finditer(text)]
    if tokens:
        ends = [b for _, b in tokens]
        inside = lambda s: (at := bisect(ends, s[0])) < len(tokens) and tokens[at][0] <= s[0] and s[1] <= tokens[at][1]
        found = {s for s in found if not inside(s)} | {*tokens}
    return sorted(found, key=lambda s: (s[0], -s[1]))


def features(text: str, start: int, end: int) -> list[float]:
    """FEATURES of a candidate, over all its characters."""
    value = text[start:end]
    n = len(value)
    kinds = [kind(c) for c in value]
    share = [kinds.count(k) / n for k in range(4)]
    counts = [value.count(c) / n for c in set(value)]
    low = value.lower()
    pairs = [RARITY.get(low[i : i + 2], 12.0) for i in range(n - 1)]
    before, after = text[max(0, start - 40) : start], text[end : end + 24]
    return [
        end - start, math.log2(end - start), *share[:3], share[3], float(all(c in "0123456789abcdef" for c in low)), float(share[0] == 1),
        len(counts) / n, -sum(p * math.log2(p) for p in counts), sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n, sum(pairs) / max(1, len(pairs)),
        max(map(len, re.findall("[a-z]+", low)), default=0), sum(map(len, WORDS.findall(low))) / n, float(UUID.fullmatch(value) is not None),
        float(before[-1:] in "/\\" and before != ""), value.count("/") / n, value.count(".") / n, float(re.search(r"[:=]=?[ ]{0,2}[\"'`]?$", before) is not None),
        float(before[-1:] in "\"'`" and before != ""), float(SECRET_WORDS.search(before) is not None), float(SECRET_WORDS.search(after) is not None),
        float(BENIGN_WORDS.search(before) is not None), float(BENIGN_WORDS.search(after) is not None), float(KNOWN_PREFIX.match(value) is not None),
        float(re.search(r"(.)\1{5}|x{4}|example|changeme|placeholder|1234567|your", low) is not None),
        float(after[:1] == "@" and re.search(r"://[^\s/:@]*:$", before) is not None),
    ]


def generated_findings(n: int = 7000, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of findings in generated lines: real-looking secrets, and what scanners take for some."""
    rng = np.random.default_rng(seed)
    alphabets = {"hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "b62": "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "b64": "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/", "up": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "num": "0123456789"}
    syllables = "the and ing her tion ent sch ung ver ein que les oir aux los ado ment ción est ble wh re on at".split()

    def draw(name: str, k: int) -> str:
        return "".join(alphabets[name][i] for i in rng.integers(0, len(alphabets[name]), k))

    def pick(*options):
        return options[int(rng.integers(len(options)))]

    def prose(k: int) -> str:
        return " ".join("".join(pick(*syllables) for _ in range(int(rng.integers(1, 4)))) for _ in range(k))

    def name(words: int) -> str:
        return pick("_", "-", "").join(pick(*DICTIONARY[:160]).capitalize() if rng.random() < 0.3 else pick(*DICTIONARY[:160]) for _ in range(words))

    def value() -> str:
        return pick(
            lambda: draw("hex", pick(32, 40, 40, 64)), lambda: draw("HEX", pick(32, 40, 64)), lambda: draw("b62", int(rng.integers(16, 64))), lambda: draw("b64", int(rng.integers(20, 80))) + pick("", "=", "=="),
            lambda: "AKIA" + draw("up", 16), lambda: "ghp_" + draw("b62", 36), lambda: "sk-" + draw("b62", 40), lambda: "xoxb-" + draw("num", 11) + "-" + draw("b62", 24),
        )()

    def chosen() -> str:
        """A password as people choose them: a word, some letters as digits, a number or sign behind, or short and drawn."""
        word = "".join(pick(*syllables) for _ in range(int(rng.integers(2, 4)))) if rng.random() < 0.5 else pick(*PHRASE)
        word = "".join(dict(zip("aeiost", "431057", strict=True)).get(c, c) if rng.random() < 0.3 else c for c in word)
        word = word.capitalize() if rng.random() < 0.5 else word
        return pick(word + draw("num", int(rng.integers(1, 5))) + pick("", "!", "#", "!!", "?"), word + pick("!", "&", "_", ".", "-") + draw("num", int(rng.integers(1, 4))), word + pick(*PHRASE).capitalize() + draw("num", int(rng.integers(1, 3))), draw("b62", int(rng.integers(7, 14))) + pick("", "!", "$"))

    secret_names = ("token", "api_key", "apikey", "secret", "password", "access_key", "auth_token", "client_secret", "PASSWORD", "TOKEN", "API_KEY", "aws_secret_access_key")
    login_names = ("password", "passwd", "pwd", "pass", "db_pass", "DB_PASSWORD", "user_password", "admin_pass", "passphrase", "root_pwd")
    benign_names = ("commit", "sha256", "md5", "checksum", "digest", "etag", "uuid", "build", "revision", "request_id", "integrity", "trace_id", "version", "image")

    def positive() -> tuple[str, str]:
        v = value()
        return pick(
            (f'{pick(*secret_names)}{pick(" = ", "=", ": ", ":")}{pick(chr(34), chr(39), "")}', v),
            (f"Authorization: Bearer ", v),
            (f"{pick(*secret_names)} {pick('is', 'was', '')} ".replace("  ", " "), v),
            (f"{pick(*secret_names)}{pick(' = ', '=')}{pick(chr(34), '')}", name(1) + draw("b62", int(rng.integers(4, 10))) + pick("", "!", "#7")),
            (f"{pick(*secret_names)}{pick(' = ', '=', ': ')}{pick(chr(34), '')}", pick("", "", "-").join(pick(*PHRASE) for _ in range(int(rng.integers(3, 6))))),
            (f"{pick(*login_names)}{pick(' = ', '=', ': ', ':')}{pick(chr(34), chr(39), '', '')}", chosen()),
            (f"{pick(*login_names, *secret_names)}{pick(' = ', '=', ': ', ':')}{pick(chr(34), chr(39), '', '')}", chosen()),
            (f"{pick('postgres', 'mysql', 'https', 'redis', 'ftp', 'amqp')}://{pick(*PHRASE, 'root', 'admin', '')}:", pick(chosen(), chosen(), draw("b62", 20)) + "@"),
            (f"{pick('api key', 'API key', 'secret key', 'token', 'auth key', 'key')}{pick(' ', ': ', ' is ')}", draw(pick("hex", "b62", "up"), int(rng.integers(16, 33)))),
            (f"{pick('key', 'KEY1', 'key2', 'secret_key')}{pick(' = ', '=', ': ')}", value()),
            (f"{pick('Bearer ', 'token=', 'jwt: ', prose(1) + ' ')}", "eyJ" + draw("b62", 17) + ".eyJ" + draw("b62", int(rng.integers(30, 80))) + "." + draw("b62", 43)),
            (f"{prose(2)} ", pick("AKIA" + draw("up", 16), "ghp_" + draw("b62", 36), "sk-" + draw("b62", 40), draw("b62", 40))),
        )

    def negative() -> tuple[str, str]:
        return pick(
            (f"{pick(*benign_names)}{pick(' ', ': ', ' = ', '=')}{pick(chr(34), '')}", pick(draw("hex", 40), draw("hex", 64), draw("hex", 32), draw("b64", 43) + "=")),
            (prose(1) + " ", draw("num", int(rng.integers(16, 24)))),
            ("id ", "-".join(draw("hex", k) for k in (8, 4, 4, 4, 12))),
            (pick("/usr/share/", "https://host.example.com/", "src/", "C:\\\\data\\\\"), "/".join(name(2) for _ in range(3)) + draw("num", 2)),
            (f"{pick('x', 'label', 'name', 'class', 'href', 'title')}{pick(' = ', '=', ': ')}{pick(chr(34), '')}", name(3) + pick("", draw("num", 2))),
            (f"{pick(*secret_names)}{pick(' = ', '=', ': ')}{pick(chr(34), '')}", pick("required", "optional", "disabled", "undefined", "unlimited", "password_hash", "user_password", "your_password_here", "get_token", "encrypted", "settings.secret", name(2).lower())),
            (f"{pick(*secret_names)} = \"", pick("your_token_here_" + draw("num", 2), "xxxxxxxxxxxxxxxx1", "changeme12345678", "example_password_1", "0" * 32)),
            (prose(1) + " ", name(4) + draw("num", 1)),
            (prose(1) + " ", pick(draw("hex", 40), draw("hex", 64))),
            ("data:image/png;base64,", draw("b64", 120)),
            (f"{pick(*login_names, *secret_names)}{pick(' = ', '=', ': ')}{pick(chr(34), '')}", pick("string", "boolean", "hidden", "getpass", "required", "missing", "invalid", "expired", "optional", "nothing", "forgotten", "incorrect", "os.environ", "prompt()", "undefined", "reset", "rotated", "protected") + pick("", "", ".", "!")),
            (f"{pick('The', 'Your', 'A')} {pick('password', 'token', 'pass', 'secret')}{pick(' is', ':', ' was')} ", pick("".join(pick(*syllables) for _ in range(3)), name(2).lower(), pick(*PHRASE))),
            (f"{pick('time', 'port', 'size', 'date', 'ratio', 'range', 'room', 'model', 'level')}{pick(' = ', '=', ': ')}{pick(chr(34), '')}", pick(f"20{draw('num', 2)}-{draw('num', 2)}-{draw('num', 2)}", f"{draw('num', 2)}:{draw('num', 2)}:{draw('num', 2)}", draw("num", 9), name(1) + draw("num", 2), chosen())),
            (f"{prose(1)} {pick('https', 'http')}://{name(1).lower()}.{pick('org', 'net')}:", draw("num", 4) + pick("/" + name(1), "")),
            (f"{pick('sha1', 'commit key', 'cache key', 'primary key', 'key')}{pick(': ', ' = ', ' ')}", pick(name(3), name(2) + draw("num", 2), name(2).lower() + "_id")),
            (prose(1) + " ", "".join(pick(*syllables) for _ in range(7)).capitalize() + "Is" + draw("num", 1)),
        )

    rows, labels = [], []
    for i in range(n):
        label = i % 2
        before, v = positive() if label else negative()
        behind = "@" + name(1).lower() if v.endswith("@") else ""
        v = v.rstrip("@")
        head = f"{prose(int(rng.integers(0, 6)))} {before}"
        quote = before[-1:] if before[-1:] in "\"'" else ""
        rows.append(features(f"{head}{v}{behind}{quote} {prose(int(rng.integers(0, 5)))}", len(head), len(head) + len(v)))
        labels.append(label)
    return np.array(rows), np.array(labels)


@dataclass
class Forest:
    #: For each tree its nodes: feature (-1 at a leaf), threshold, number of the left child (the right one follows), share of secrets.
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Mean share of secrets over the trees, for each row."""
        total = np.zeros(len(rows))
        for feature, threshold, child, share in self.trees:
            at = np.zeros(len(rows), np.int64)
            for _ in range(DEPTH):
                inner = feature[at] >= 0
                right = rows[np.arange(len(rows)), feature[at]] > threshold[at]
                at = np.where(inner, child[at] + right, at)
            total += share[at]
        return total / max(1, len(self.trees))


def fit_forest(rows: np.ndarray, labels: np.ndarray, seed: int = 5) -> Forest:
    """Random forest: every tree on a bootstrap sample, every split by Gini impurity over a random subset of features."""
    rng, trees = np.random.default_rng(seed), []
    tried = max(1, round(math.sqrt(rows.shape[1])) + 1)
    for _ in range(TREES):
        own = rng.integers(0, len(rows), len(rows))
        nodes: list[list] = [[-1, 0.0, 0, 0.0]]
        stack = [(0, own, 0)]
        while stack:
            node, at, depth = stack.pop()
            y = labels[at]
            nodes[node][3] = float(y.mean())
            if depth == DEPTH or len(at) < 8 or y.min() == y.max():
                continue
            best = (math.inf, -1, 0.0)
            for f in rng.choice(rows.shape[1], tried, replace=False):
                order = np.argsort(rows[at, f], kind="stable")
                x, ones = rows[at, f][order], np.cumsum(y[order])
                cut = np.flatnonzero(x[1:] > x[:-1])
                if len(cut):
                    n1, s1 = cut + 1, ones[cut]
                    n2, s2 = len(at) - n1, ones[-1] - s1
                    impurity = 2 * (s1 - s1**2 / n1 + s2 - s2**2 / n2)
                    k = int(impurity.argmin())
                    best = min(best, (float(impurity[k]), int(f), float((x[cut[k]] + x[cut[k] + 1]) / 2)))
            if best[1] < 0:
                continue
            left = rows[at, best[1]] <= best[2]
            nodes[node][:3] = [best[1], best[2], len(nodes)]
            stack += [(len(nodes), at[left], depth + 1), (len(nodes) + 1, at[~left], depth + 1)]
            nodes += [[-1, 0.0, 0, 0.0], [-1, 0.0, 0, 0.0]]
        trees.append(tuple(np.array([n[k] for n in nodes], t) for k, t in enumerate((np.int64, float, np.int64, float))))
    return Forest(trees)


def train(findings: DataFrame | None = None) -> Forest:
    """A forest from labelled findings (text, start, end, label), spread over all by hash, or from generated ones."""
    if findings is None:
        return fit_forest(*generated_findings())
    known = findings.where("text IS NOT NULL AND start IS NOT NULL AND end > start AND label IS NOT NULL")
    sample = known.orderBy(F.xxhash64("text", "start", "end"), "start", "end", "label").limit(MAX_FINDINGS).collect()
    if not sample:
        return Forest([])
    return fit_forest(np.array([features(r.text, r.start, r.end) for r in sample]), np.array([int(r.label) for r in sample]))


def secrets_of(text: str | None, forest: Forest, threshold: float = 0.5) -> tuple[int, list[tuple[int, int]], float]:
    """Number of candidates, spans that the forest keeps, and the greatest score."""
    spans = candidates(text)
    if not spans:
        return 0, [], 0.0
    scores = forest.score(np.array([features(text, *s) for s in spans]))
    kept: list[tuple[int, int]] = []
    for _, start, less in sorted((-p, a, a - b) for (a, b), p in zip(spans, scores.tolist(), strict=True) if p >= threshold):
        span = (start, start - less)
        at = bisect(kept, span)
        if (at == 0 or kept[at - 1][1] <= span[0]) and (at == len(kept) or kept[at][0] >= span[1]):
            kept.insert(at, span)
    return len(spans), kept, float(scores.max())


def scan(docs: DataFrame, forest: Forest, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_candidates, n_secrets, spans (start:end, comma-joined) and max_score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [secrets_of(t, shared.value, threshold) for t in batch.column(1).to_pylist()]
            columns = [pa.array([f[0] for f in found], pa.int64()), pa.array([len(f[1]) for f in found], pa.int64()), pa.array([",".join(f"{a}:{b}" for a, b in f[1]) for f in found], pa.string()), pa.array([f[2] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_candidates", "n_secrets", "spans", "max_score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_candidates long, n_secrets long, spans string, max_score double")


def redact(docs: DataFrame, forest: Forest, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """docs with every secret in the text replaced by REDACTED; other columns are unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    names, at = docs.columns, docs.columns.index(text_col)

    def clean(text: str | None) -> str | None:
        spans = secrets_of(text, shared.value, threshold)[1]
        if not spans:
            return text
        cuts = [0, *(x for s in spans for x in s), len(text)]
        return REDACTED.join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cleaned = pa.array([clean(t.as_py()) for t in batch.column(at)], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], cleaned, *batch.columns[at + 1 :]], schema=pa.schema([f.with_name(c) for f, c in zip(batch.schema, names, strict=True)]))

    return docs.toDF(*(f"c{k}" for k in range(len(names)))).mapInArrow(run, docs.schema)  # a name may hold a point
