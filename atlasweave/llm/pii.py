"""Personal data by a semi-Markov conditional random field over whole spans, beside fixed patterns.

Fixed patterns give the base spans (e-mail, IP address, payment card, telephone number), which stay.  Between
them the field looks for what the patterns miss: spelled-out or spaced addresses, numbers with other
separators.  A segment is a run of up to MAX_GROUPS groups; features of the whole span (shape, digit
count, checksum, cue words, what it is glued to) score every candidate segment and type, and a
dynamic programme over bounded segments chooses boundaries and types jointly, with a term for the type of
the segment before.  The field is trained in numpy by stochastic gradient ascent of the conditional
log-likelihood, on labelled lines that a seeded generator writes.

Bounds of an entity: MAX_GROUPS groups, 60 characters of a number, and 64 and 63 characters of an address's local part and labels, as the
mail standards have them.

Only stretches around digits or spelled-out signs can hold an entity, so the programme runs over these; all
steps are linear in the length of a text.  Scanning is one map over whole texts without a shuffle; the
weights (2^14 numbers) are broadcast.

Defined results: a null or empty text has no spans; a null doc_id is kept; repeated rows are scanned each; other columns are ignored;
an empty table gives an empty result.  Spans are code points, end exclusive; those of the field never
overlap base spans or each other.  Base spans of different kinds may overlap, as each kind is matched by itself.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Groups (of digits, or of words of an address) in a segment at most; weights of hashed features.
MAX_GROUPS, WEIGHTS = 8, 1 << 14

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# The look-behinds and possessive quantifiers change no match; they keep long runs of digits linear.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of an address around each sign in turn; the local part ends where the last match ended."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            out.append((start, done))
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all matches of the fixed patterns that pass their checks, in order."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    for m in CARD.finditer(text):
        if 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "." in text:
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return sorted(out)


ANY_DIGIT = re.compile("[0-9]")
RUN = re.compile(r"[+(]{0,2}[0-9](?:[0-9 ().\-/\[\]]*[0-9])?")
GROUP = re.compile(r"[0-9]+")
AT, DOT = r"(?:\s?[\[({<]\s?at\s?[\])}>]\s?|\s{1,2}at\s{1,2}|\s?@\s?)", r"(?:\s?[\[({<]\s?dot\s?[\])}>]\s?|\s{1,2}dot\s{1,2}| \. |\.)"
SPELLED_AT = re.compile(AT, re.I)
ADDRESS_END = re.compile(rf"[A-Za-z0-9-]{{1,63}}(?:{DOT}[A-Za-z0-9-]{{1,63}})+", re.I)
ADDRESS_STEP = re.compile(rf"{DOT}[A-Za-z0-9-]{{1,63}}", re.I)
#: Words that announce a kind.
CUES = {"phone": 3, "tel": 3, "telephone": 3, "call": 3, "fax": 3, "mobile": 3, "cell": 3, "whatsapp": 3, "sms": 3, "telefon": 3, "card": 2, "visa": 2, "mastercard": 2, "amex": 2, "credit": 2, "karte": 2, "ip": 1, "host": 1, "server": 1, "addr": 1, "mail": 0, "email": 0, "contact": 0, "write": 0, "reach": 0}
TOP_LEVEL = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info")


def segments(text: str, low: int, high: int) -> list[tuple[int, int, int]]:
    """(start, end, kind) of candidate segments in a stretch of text without base spans."""
    out: list[tuple[int, int, int]] = []
    for run in RUN.finditer(text, low, high):
        groups = [m.span() for m in GROUP.finditer(text, *run.span())]
        for i, (a, _) in enumerate(groups):
            n = 0
            for j in range(i, min(i + MAX_GROUPS, len(groups))):
                b = groups[j][1]
                n += b - groups[j][0]
                if n > 19:
                    break
                if n < 4 or b - a > 60:
                    continue
                start = a
                while start > run.start() and text[start - 1] in "+(" and a - start < 2:
                    start -= 1
                if 7 <= n <= 15:
                    out.append((start, b, 3))
                if 12 <= n <= 19 and luhn(digits_of(text[a:b])):
                    out.append((a, b, 2))
                if j - i == 3 and all(int(text[x:y]) <= 255 for x, y in groups[i : j + 1] if y - x <= 3) and all(y - x <= 3 for x, y in groups[i : j + 1]):
                    out.append((a, b, 1))
    for at in SPELLED_AT.finditer(text, low, high):
        start = at.start()
        while start > low and text[start - 1] in LOCAL and at.start() - start < 64:
            start -= 1
        found = ADDRESS_END.match(text, at.end(), high)
        if found and start < at.start():
            first = re.compile(r"[A-Za-z0-9-]{1,63}").match(text, at.end()).end()
            for k, step in enumerate(ADDRESS_STEP.finditer(text, first, found.end())):
                if k < MAX_GROUPS:
                    out.append((start, step.end(), 0))
    return out


def features(text: str, start: int, end: int, kind: int) -> list[int]:
    """Indices of the weights of a candidate segment, hashed from the names of its features and its kind."""
    span = text[start:end]
    words = re.findall(r"[A-Za-z]+", text[max(0, start - 24) : start])[-2:]
    cues = sorted({CUES[w.lower()] for w in words if w.lower() in CUES})
    left, right = text[start - 1 : start], text[end : end + 1]
    glued = "L" * (left.isalnum() or left in ("-", ".", "/", "_", "@", "$", "#", ":") and left != "") + "R" * (right.isalnum() or right in ("-", "/", "_", "@", "%") and right != "" or right in (".", ",") and text[end + 1 : end + 2].isdigit())
    names = ["bias", f"cue{kind in cues}", f"othercue{bool(cues) and kind not in cues}", f"glued{glued}"]
    if kind:
        shape = re.sub(r"[0-9]+", lambda m: str(len(m[0])), span)
        groups = GROUP.findall(span)
        n = sum(map(len, groups))
        around = ANY_DIGIT.search(text[max(0, start - 3) : start]) is not None, ANY_DIGIT.search(text[end : end + 3]) is not None
        names += [f"shape{shape}", f"n{n}", f"groups{len(groups)}", f"seps{''.join(sorted(set(re.sub('[0-9]', '', span))))}", f"first{span[0] if not span[0].isdigit() else span[0] == '0'}", f"near{around}", f"last{len(groups[-1])}", f"shape{shape}cue{kind in cues}", f"n{n}groups{len(groups)}"]
    else:
        parts = re.split(DOT, span, flags=re.I)
        style = "bracket" if re.search(r"[\[({<]\s?(?:at|dot)", span, re.I) else "sign" if "@" in span else "word"
        known = parts[-1].lower() in TOP_LEVEL
        names += [f"style{style}", f"top{known}", f"style{style}top{known}", f"parts{len(parts)}", f"dotword{re.search('dot', span, re.I) is not None}", f"style{style}cue{0 in cues}", f"spaces{min(4, span.count(' '))}"]
    return [zlib.crc32(f"{kind}|{n}".encode()) % WEIGHTS for n in names]


#: The last weights are those of a segment right after another entity of the stretch, by kind.
def after_entity(kind: int) -> int:
    return WEIGHTS - 1 - kind


def lattice(text: str, low: int, high: int) -> tuple[list[int], list[tuple[int, int, int, list[int]]]]:
    """Boundaries of a stretch and its candidate segments as (from, to, kind, features) between them."""
    found = sorted(set(segments(text, low, high)))
    at = sorted({x for s in found for x in s[:2]})
    number = {x: i for i, x in enumerate(at)}
    return at, [(number[a], number[b], k, features(text, a, b, k)) for a, b, k in found]


def best_segments(text: str, low: int, high: int, weights: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the segmentation with the highest score; gaps score 0."""
    at, edges = lattice(text, low, high)
    if not edges:
        return []
    by_end: dict[int, list] = {}
    for e in edges:
        by_end.setdefault(e[1], []).append((e[0], e[2], float(weights[e[3]].sum())))
    # state 0: the stretch's last segment is a gap (or nothing), 1: it is an entity that ends here
    score, back = [[0.0, -math.inf]], [[None, None]]
    for j in range(len(at)):
        if j:
            gap = max((score[j - 1][s], s) for s in (0, 1))
            score.append([gap[0], -math.inf])
            back.append([(j - 1, gap[1], None), None])
        for i, kind, w in by_end.get(j, ()):
            for s in (0, 1):
                total = score[i][s] + w + (float(weights[after_entity(kind)]) if s else 0.0)
                if total > score[j][1]:
                    score[j][1], back[j][1] = total, (i, s, kind)
    j, s, out = len(at) - 1, int(score[-1][1] > score[-1][0]), []
    while back[j][s]:
        i, t, kind = back[j][s]
        if kind is not None:
            out.append((at[i], kind, at[j]))
        j, s = i, t
    return out[::-1]


def gradient(at: list[int], edges: list, gold: set[tuple[int, int, int]], weights: np.ndarray) -> dict[int, float]:
    """Of the conditional log-likelihood of the gold segments: their features less the expected ones."""
    n = len(at)
    w = [float(weights[e[3]].sum()) for e in edges]
    into: dict[int, list[int]] = {}
    out_of: dict[int, list[int]] = {}
    for k, e in enumerate(edges):
        into.setdefault(e[1], []).append(k)
        out_of.setdefault(e[0], []).append(k)
    add = np.logaddexp
    step = [0.0, 0.0]
    forward = [[-math.inf, -math.inf] for _ in range(n)]
    forward[0] = [0.0, -math.inf]
    for j in range(n):
        if j:
            forward[j][0] = float(add(*forward[j - 1]))
        for k in into.get(j, ()):
            i, _, kind, _ = edges[k]
            forward[j][1] = float(add(forward[j][1], add(forward[i][0], forward[i][1] + weights[after_entity(kind)]) + w[k]))
    backward = [[0.0, 0.0] for _ in range(n)]
    for i in range(n - 1, -1, -1):
        for s in (0, 1):
            total = backward[i + 1][0] if i + 1 < n else 0.0
            for k in out_of.get(i, ()):
                _, j, kind, _ = edges[k]
                total = float(add(total, w[k] + backward[j][1] + s * weights[after_entity(kind)]))
            backward[i][s] = total
    whole = backward[0][0]
    slope: dict[int, float] = {}
    ends = {e for _, e, _ in gold}
    for k, (i, j, kind, f) in enumerate(edges):
        p = [math.exp(forward[i][s] + s * float(weights[after_entity(kind)]) + w[k] + backward[j][1] - whole) for s in (0, 1)]
        is_gold = (at[i], at[j], kind) in gold
        for x in f:
            slope[x] = slope.get(x, 0.0) + is_gold - p[0] - p[1]
        slope[after_entity(kind)] = slope.get(after_entity(kind), 0.0) + (is_gold and at[i] in ends) - p[1]
    return slope


def generated_lines(n: int, seed: int) -> list[tuple[str, set[tuple[int, int, int]]]]:
    """Lines with labelled entities in usual and unusual forms, and numbers and prose that aren't personal data."""
    rng = np.random.default_rng(seed)
    syllables = "the and ing her tion ent sch ung ver ein que les oir aux los ado ment est ble wh re on at dot of".split()

    def pick(*x):
        return x[int(rng.integers(len(x)))]

    def num(k: int) -> str:
        return str(int(rng.integers(1, 10))) + "".join(map(str, rng.integers(0, 10, k - 1)))

    def prose(k: int) -> str:
        return " ".join("".join(pick(*syllables) for _ in range(int(rng.integers(1, 3)))) for _ in range(k))

    def word() -> str:
        return "".join(pick(*syllables) for _ in range(2))

    def card() -> str:
        while not luhn(d := pick("4", "5", "37") + num(14)):
            pass
        return d

    def phone() -> str:
        a, b, c, s = num(3), num(3), num(4), pick("-", ".", " ", "/")
        return pick(f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}{s}{b}{s}{c}", f"00{num(2)} {num(2)} {num(7)}", f"0{num(2)}{s}{num(7)}", f"0{num(3)}/{num(6)}", f"1-{a}-{b}-{c}", f"+{num(2)}/{num(3)}/{num(6)}", f"+1 ({a}) {b}-{c}", f"+{num(2)} {num(3)} {num(6)}")

    def spread_card() -> str:
        d, s = card(), pick(".", "/", "  ", " . ", " ", "-", "")
        return s.join(d[i : i + 4] for i in range(0, len(d), 4))

    def address() -> str:
        s = pick(" . ", "[.]", " .", "(.)", ".")
        return s.join(str(int(x)) for x in rng.integers(1, 255, 4))

    def email() -> str:
        at, dot = pick((" [at] ", " [dot] "), (" (at) ", " (dot) "), (" at ", " dot "), ("[at]", "."), ("(at)", "(dot)"), (" @ ", "."), ("{at}", "{dot}"), (" AT ", " DOT "), ("@", "."))
        return f"{pick(word(), word() + '.' + word(), word() + num(2))}{at}{word()}{dot}{pick('', word() + dot)}{pick(*TOP_LEVEL)}"

    cue = {0: ("mail", "email:", "contact", "write", "reach"), 1: ("ip", "host", "server"), 2: ("card", "visa", "credit card"), 3: ("phone", "tel:", "call", "fax:", "mobile")}
    out = []
    for i in range(n):
        text, gold = prose(int(rng.integers(1, 6))) + " ", set()
        for _ in range(int(rng.integers(1, 3))):
            if i % 2:
                kind = int(rng.integers(0, 4))
                value = (email, address, spread_card, phone)[kind]()
                if kind == 3 and rng.random() < 0.15:
                    value, cued = f"{num(3)}-{num(4)}", True
                else:
                    cued = rng.random() < 0.5
                text += f"{pick(*cue[kind])} " if cued else ""
                gold.add((len(text), len(text) + len(value), kind))
            else:
                value = pick(
                    f"20{num(2)}-{num(2)}-{num(2)}", f"{num(2)}/{num(2)}/20{num(2)}", f"{num(2)}:{num(2)}:{num(2)}", f"{num(1)}.{num(1)}.{num(2)}", f"{num(1)}.{num(1)}.{num(1)}.{num(1)}.{num(1)}", f"{num(1)},{num(3)}.{num(2)}", f"${num(3)}.{num(2)}", " ".join(num(int(rng.integers(1, 5))) for _ in range(8)),
                    num(16), num(12), num(8), num(10), num(20), f"{num(4)}-{num(4)}", f"{num(3)} - {num(3)}", f"{word()} at {word()}. {word()}", f"{word()} at the {word()}", f"@ {word()}. {word()}", f"at {word()} dot {word()}", f"#{num(7)}", f"{num(2)}.{num(2)}.20{num(2)} {num(2)}:{num(2)}", f"{num(5)}-{num(4)}",
                    f"id {num(3)}-{num(3)}", f"{num(4)} {num(4)} {num(4)}", f"{num(3)} {num(3)} {num(3)}", " | ".join(num(3) for _ in range(4)), f"v{num(1)}.{num(1)}.{num(3)}", f"order {num(9)}", f"{num(1)}e{num(2)}", f"{num(3)}.{num(7)}", f"{num(4)}/{num(4)}/{num(4)}",
                )
            text += value + pick(" ", ", ", ". ", "\n") + prose(int(rng.integers(0, 5))) + " "
        out.append((text, gold))
    return out


def train(n: int = 1500, epochs: int = 6, seed: int = 3, rate: float = 0.3) -> np.ndarray:
    """Weights after stochastic gradient ascent (with per-weight step sizes) over n generated lines."""
    weights, seen = np.zeros(WEIGHTS), np.full(WEIGHTS, 1e-6)
    lines = []
    for text, gold in generated_lines(n, seed):
        at, edges = lattice(text, 0, len(text))
        if edges:
            lines.append((at, edges, gold))
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(lines)).tolist():
            slope = gradient(*lines[i], weights)
            keys = np.fromiter(slope, np.int64, len(slope))
            g = np.fromiter(slope.values(), float, len(slope)) - 1e-3 * weights[keys]
            seen[keys] += g * g
            weights[keys] += rate * g / np.sqrt(seen[keys])
    return weights


def find(text: str | None, weights: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans with those that the field adds, each as (start, kind, end) in order."""
    if not text or not (ANY_DIGIT.search(text) or SPELLED_AT.search(text)):
        return [], []
    base = base_spans(text)
    added, low = [], 0
    for start, _, end in [*base, (len(text), 0, len(text))]:
        if start > low:
            added += best_segments(text, low, start, weights)
        low = max(low, end)
    return base, sorted(base + added) if added else base


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def detect(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans (kind:start:end, comma-joined) and n_added of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            found = [find(t, shared.value) for t in batch.column(1).to_pylist()]
            counts = [pa.array([sum(s[1] == k for s in base) for base, _ in found], pa.int64()) for k in range(len(KINDS))]
            digest = pa.array([hashlib.sha256(listed(base).encode()).hexdigest() if base else nothing for base, _ in found], pa.string())
            spans, added = pa.array([listed(every) for _, every in found], pa.string()), pa.array([len(every) - len(base) for base, every in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digest, spans, added], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    out = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, out)
