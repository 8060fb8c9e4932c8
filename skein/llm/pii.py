"""Personal data: exact patterns for four kinds, and a semi-Markov conditional random field for what they miss.

The base patterns find emails, IPv4 addresses, cards and phones as leftmost non-overlapping matches of each kind; those
that fail their test are dropped. The field then reads the text around every digit, at sign or spelled-out "dot" that no
base match covers. It scores whole candidate segments, of at most ``LONGEST`` tokens, by features of the span (shape,
digits, checksums, words before it) for each type, and a dynamic program over the segments' boundaries chooses boundaries
and types jointly; base matches are fixed segments that others can't overlap. So the field only adds spans: written-out
emails, phones without a country code, cards with other separators, social security numbers, and secrets: passwords and
keys given to a name such as token or password, and keys that tell by their form. Labels of neighbouring segments don't
interact: sentences with several entities are rare enough that there would be little to learn from.

The field is trained when a query is built, by gradient steps on the conditional log-likelihood of generated sentences
with a fixed seed, so every run has the same weights.

Defined results: positions are code points, ends exclusive. A null or empty text has no spans. Whole texts are read, in
linear time. Repeated rows give repeated rows; an empty table gives an empty result. Spans are ordered by kind (email, ip,
card, phone, secret, ssn), then start. Further columns of the input are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.shared import bounded_batches, slices

KINDS = ("email", "ip", "card", "phone")
LABELS = (*KINDS, "secret", "ssn")
#: Bounds of a segment that the field may choose: tokens, and code points.
LONGEST = 16
WIDEST = 192
FOUND = "struct<n_email:bigint,n_ip:bigint,n_card:bigint,n_phone:bigint,base_sha256:string,spans:string,n_secret:bigint,n_ssn:bigint,n_added:bigint,n_spans:bigint>"

Span = tuple[str, int, int]

_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match can't begin inside a run of digits: where one fails at the run's begin, it fails inside too
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}").finditer
# shorter runs than 13 digits are dropped anyway
_card = re.compile(r"[0-9](?:[ -]?[0-9]){12,}+").finditer
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").finditer


def luhn(digits: str) -> bool:
    """Whether the check digit of a card's number is right."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


def _emails(text: str) -> Iterator[Span]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _local:
            start -= 1
        if start < at and (found := _domain(text, at + 1)):
            end = found.end()
            yield "email", start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """Matches of the four kinds, by kind and start."""
    spans = list(_emails(text))
    spans += [("ip", *m.span()) for m in _ip(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    spans += [("card", *m.span()) for m in _card(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        spans += [("phone", *m.span()) for m in _phone(text) if 9 <= len(_digits(m[0])) <= 15]
    return spans


_token = re.compile(r"[^\W_]+|\S").finditer
_trigger = re.compile(r"[0-9@]").finditer
_dots = re.compile(r"(?:^|(?<=[\s(\[]))dot(?=[\s)\]])", re.I).finditer
_runs = (re.compile(r"[0-9]+"), re.compile(r"[^\W\d_]+"), re.compile(r"\s+"))
_written = re.compile(r"[\w.]+ ?[\[(]? ?at ?[\])]? ?\w+(?: ?[\[(]? ?dot ?[\])]? ?\w+)+", re.I).fullmatch

#: Characters that join a span to what is before it; and what joins it to what follows.
_JOINTS = frozenset("._%+-@/=")
_goes_on = re.compile(r"[-._@/=]\w| ?[\[(]? ?dot[\])]? ?\w", re.I).match

#: Words that announce a kind.
CUES = {
    **dict.fromkeys(("email", "mail", "write", "contact"), "email"),
    **dict.fromkeys(("ip", "host", "server", "address"), "ip"),
    **dict.fromkeys(("card", "visa", "mastercard", "credit"), "card"),
    **dict.fromkeys(("phone", "call", "tel", "fax", "mobile"), "phone"),
    **dict.fromkeys(("token", "key", "secret", "password", "passwd", "pwd", "passphrase", "credential", "bearer", "apikey"), "secret"),
    **dict.fromkeys(("ssn", "social"), "ssn"),
}
#: How keys of well-known services begin. Fixed values.
_PREFIXES = ("AKIA", "ASIA", "AIza", "sk-", "pk_", "sk_", "rk_", "ghp_", "gho_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "eyJ")
_code = re.compile(r"[A-Za-z0-9_+/=.~-]+").fullmatch
_three = re.compile(r"[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}").fullmatch


def span_features(text: str, cue: str, cut: str = "00") -> list[str]:
    """Features of a whole candidate span; ``cue`` is the kind that a word before it announces, or nothing, and ``cut``
    tells whether what is before and after it seems to belong to it."""
    shape = text[:WIDEST]
    for run, mark in zip(_runs, "9a_", strict=True):
        shape = run.sub(mark, shape)
    digits = _digits(text)
    n, parts = len(digits), text.split(".")
    out = ["bias", f"shape={shape[:24]}", f"digits={min(n, 20)}", f"cue={cue}", f"first={shape[0]}", f"last={shape[-1]}", f"cut={cut}"]
    if 13 <= n <= 19 and set(shape) <= set("9_-./"):
        out.append(f"luhn={luhn(digits)}")
    if len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts):
        out.append(f"ip={all(len(p) < 4 and int(p) <= 255 for p in parts)}")
    if "@" in text:
        out.append(f"at={bool(re.fullmatch(r'[\w.%+-]+@[\w-]+(?:[.][\w-]+)+', text))}")
    elif _written(text):
        out.append("written")
    if n and _code(text):
        # how a code looks: its length, the classes of its characters, how often it changes between them, whether it is known
        classes = f"{any('a' <= c <= 'z' for c in text):d}{any('A' <= c <= 'Z' for c in text):d}"
        size, runs = min(len(text).bit_length(), 7), min(len(shape) // 2, 6)
        out += [f"code={classes}", f"code,size={size}", f"code,size={size},runs={runs}", f"code,cue={cue},size={size}", f"code,cue={cue},{classes}"]
        if text.startswith(_PREFIXES):
            out.append(f"prefix,long={len(text) >= 16}")
        if text.count(".") == 2 and text.startswith("eyJ"):
            out.append("signed")
    if _three(text):
        out.append(f"three,cue={cue}")
    if set(shape) <= set("9_-.()") and n:
        out.append(f"numeric,cue={cue},digits={min(n, 20)}")
    return out


class Tokens:
    """The tokens of a window of a text, and the candidate segments among them."""

    def __init__(self, text: str, spans: list[tuple[int, int]]):
        self.text, self.spans = text, spans

    def cue(self, at: int) -> str:
        for start, end in reversed(self.spans[max(0, at - 4) : at]):
            if known := CUES.get(self.text[start:end].lower()):
                return known
        return ""

    def candidates(self, taken: list[tuple[int, int]] = ()) -> Iterator[tuple[int, int, list[str]]]:
        """(first token, token after the last, features) of each segment that may be an entity and overlaps no taken range.
        Taken ranges are sorted and disjoint."""
        free, k = [], 0
        for start, end in self.spans:
            while k < len(taken) and taken[k][1] <= start:
                k += 1
            free.append(k == len(taken) or taken[k][0] >= end)
        for i, (start, end) in enumerate(self.spans):
            if not free[i] or not (self.text[start].isalnum() or self.text[start] in "+("):
                continue
            cue = None
            for j in range(i + 1, min(i + LONGEST, len(self.spans)) + 1):
                begin, end = self.spans[j - 1]
                if not free[j - 1] or (end - start > WIDEST and j > i + 1):
                    break
                if j > i + 1 and (begin - self.spans[j - 2][1] > 1 or "\n" in self.text[self.spans[j - 2][1] : begin]):
                    break
                if not self.text[end - 1].isalnum():
                    continue
                own = self.text[start:end]
                if any("0" <= c <= "9" for c in own) or "@" in own or _written(own):
                    cue = self.cue(i) if cue is None else cue
                    cut = f"{start > 0 and self.text[start - 1] in _JOINTS:d}{_goes_on(self.text, end) is not None:d}"
                    yield i, j, span_features(own, cue, cut)


class Field:
    """Weights of the semi-Markov field: one for each label and feature, and one for a token outside of entities."""

    def __init__(self):
        self.weights: dict[tuple[str, str], float] = {}

    def score(self, label: str, features: list[str]) -> float:
        get = self.weights.get
        return sum([get((label, f), 0.0) for f in features])

    def decode(self, tokens: Tokens, taken: list[tuple[int, int]]) -> list[Span]:
        """The best segmentation's entities. A token outside of entities scores 0."""
        n = len(tokens.spans)
        ending: list[list[tuple[int, float, str]]] = [[] for _ in range(n + 1)]
        for i, j, features in tokens.candidates(taken):
            score, label = max((self.score(label, features), label) for label in LABELS)
            if score > 0:
                ending[j].append((i, score, label))
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            best[j] = best[j - 1]
            for i, score, label in ending[j]:
                if best[i] + score > best[j]:
                    best[j], back[j] = best[i] + score, (i, label)
        found, j = [], n
        while j:
            if back[j] is None:
                j -= 1
            else:
                i, label = back[j]
                found.append((label, tokens.spans[i][0], tokens.spans[j - 1][1]))
                j = i
        return found

    def step(self, tokens: Tokens, entities: list[Span], rate: float, squares: dict) -> None:
        """One gradient step on the log-likelihood of a sentence, by the forward-backward recursion over segments."""
        n = len(tokens.spans)
        truth = {(s, e): label for label, s, e in entities}
        segments = [(i, j, features, label, self.score(label, features)) for i, j, features in tokens.candidates() for label in LABELS]
        forward, backward = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]

        def add(a: float, b: float) -> float:
            high, low = (a, b) if a > b else (b, a)
            return high if low == -math.inf else high + math.log1p(math.exp(low - high))

        ending, starting = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
        for s in segments:
            ending[s[1]].append(s)
            starting[s[0]].append(s)
        for j in range(1, n + 1):
            forward[j] = forward[j - 1]
            for i, _, _, _, score in ending[j]:
                forward[j] = add(forward[j], forward[i] + score)
        for i in range(n - 1, -1, -1):
            backward[i] = backward[i + 1]
            for _, j, _, _, score in starting[i]:
                backward[i] = add(backward[i], backward[j] + score)
        gradient: dict[tuple[str, str], float] = {}
        for i, j, features, label, score in segments:
            expected = math.exp(forward[i] + score + backward[j] - forward[n])
            observed = truth.get((tokens.spans[i][0], tokens.spans[j - 1][1])) == label
            if abs(observed - expected) > 1e-4:
                for f in features:
                    gradient[label, f] = gradient.get((label, f), 0.0) + observed - expected
        for key, g in gradient.items():
            g -= 0.01 * self.weights.get(key, 0.0)
            squares[key] = squares.get(key, 1e-3) + g * g
            self.weights[key] = self.weights.get(key, 0.0) + rate * g / math.sqrt(squares[key])


def _generated(chance: random.Random) -> tuple[str, list[Span]]:
    """A sentence of invented words with one entity, or one thing that resembles one, and the entities in it."""
    word = lambda: "".join(chance.choice(("an", "the", "or", "in", "es", "re", "lo", "mi")) for _ in range(chance.randint(1, 3)))
    number = lambda n: "".join(chance.choice("0123456789") for _ in range(n))

    def card() -> str:
        head = number(15)
        return head + next(d for d in "0123456789" if luhn(head + d))

    def code(letters: str, low: int, high: int) -> str:
        n = chance.randint(low, high)
        made = [chance.choice(letters) for _ in range(n)]
        made[chance.randrange(n)] = chance.choice("0123456789")
        return "".join(made)

    hexadecimal, lower = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz"
    mixed = lower + lower.upper() + "0123456789"
    base64 = mixed + "-_"
    kind = chance.choice((*LABELS, *LABELS, "secret", "", "", ""))
    area, line = number(3), number(4)
    separator = chance.choice((" ", "-", ".", "/"))
    known = kind == "secret" and chance.random() < 0.4  # a key that tells by its form, whatever is before it
    own = {
        "email": lambda: chance.choice((f"{word()}.{number(2)}@{word()}.com", f"{word()} at {word()} dot com", f"{word()}.{word()} at {word()} dot com", f"{word()}[at]{word()}[dot]org", f"{word()} (at) {word()} (dot) com", f"{word()} at {word()} dot {word()} dot net")),
        "ip": lambda: ".".join(str(chance.randint(0, 255)) for _ in range(4)),
        "card": lambda: (c := card(), chance.choice((c, separator.join(c[k : k + 4] for k in range(0, 16, 4)))))[1],
        "phone": lambda: chance.choice((f"+1 ({area}) {number(3)}-{line}", f"({area}) {number(3)}-{line}", f"{area}-{number(3)}-{line}", f"{area}.{number(3)}.{line}", f"+44 {area} {line}{number(2)}")),
        "secret": lambda: chance.choice((f"AKIA{code(lower.upper(), 16, 16)}", f"{chance.choice(('sk-', 'ghp_', 'xoxb-', 'pk_'))}{code(mixed, 20, 40)}", f"eyJ{code(base64, 10, 30)}.eyJ{code(base64, 10, 50)}.{code(base64, 20, 43)}"))
        if known
        else chance.choice((code(hexadecimal, 24, 64), code(mixed, 16, 48), f"{word()}{number(chance.randint(1, 4))}{chance.choice(('', word()))}", code(lower + "0123456789", 8, 20))),
        "ssn": lambda: f"{area}-{number(2)}-{line}",
        "": lambda: chance.choice(
            (number(chance.randint(1, 8)), number(16), f"20{number(2)}-0{chance.randint(1, 9)}-1{chance.randint(0, 9)}", f"{number(1)}.{number(1)}.{number(2)}", f"300.{number(3)}.{number(2)}.999", f"{number(2)}:{number(2)}", f"{number(3)}-{number(3)}", f"@{word()}",
             f"{word()}{number(2)}", f"{word()}{number(1)}", code(mixed, 5, 10), code(hexadecimal, 6, 40), f"v{number(1)}.{number(1)}", f"{word()}-{number(3)}", f"{number(2)}{word()}", f"{word()}_{number(4)}.{word()}",
             f"{word()} at the dot {chance.choice(('on', 'in', 'of'))} {word()} {number(2)}", f"a dot at {word()} {number(1)}", f"{number(2)}-{number(2)}, {number(2)}-{number(2)}", f"{number(3)}-{number(1)}-{number(2)}-{number(6)}-{number(1)}")
        ),
    }[kind]()
    cue = chance.choice([c for c, k in CUES.items() if k == kind]) if kind and not known and (kind in ("secret", "ssn") or chance.random() < 0.5) else word()
    if kind == "" and chance.random() < 0.2:  # a number or a code after a word that announces something else
        cue = chance.choice(("email", "host", "call", "key", "card"))
        own = chance.choice((number(2), f"{number(1)}:{number(2)}", f"v{number(1)}"))
    mark = chance.choice((' = "', ": ", "=", ": '")) if kind == "secret" else chance.choice((" ", " ", ": "))
    quote = mark[-1] if mark[-1] in "'\"" else ""
    head = f"{word()} {word()} {cue}{mark}"
    tail = f"{quote}{chance.choice(('', '.', ',', '!!'))} {word()} {word()}"
    return head + own + tail, [(kind, len(head), len(head) + len(own))] if kind else []


def train(sentences: int = 700, epochs: int = 4, seed: int = 7) -> Field:
    chance, field, squares = random.Random(seed), Field(), {}
    taught = [_generated(chance) for _ in range(sentences)]
    for epoch in range(epochs):
        for text, entities in taught:
            field.step(Tokens(text, [m.span() for m in _token(text)]), entities, 0.5 / (1 + epoch), squares)
    field.weights = {k: round(w, 6) for k, w in field.weights.items()}
    return field


def _covered(base: list[Span]) -> list[tuple[int, int]]:
    """The sorted, disjoint ranges that base matches cover."""
    out: list[tuple[int, int]] = []
    for _, start, end in sorted(base, key=lambda b: b[1:]):
        if out and start < out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def _windows(text: str, covered: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Ranges of the text around what may be personal data and isn't covered by a base match."""
    places = [m.start() for m in _trigger(text)]
    if "dot" in text.lower():
        places = sorted([*places, *(m.start() for m in _dots(text))])
    k, low, high = 0, -1, -1
    for place in places:
        while k < len(covered) and covered[k][1] <= place:
            k += 1
        if k < len(covered) and covered[k][0] <= place:
            continue
        if low < 0 or place - WIDEST > high:
            if low >= 0:
                yield low, high
            low = max(place - WIDEST, 0)
        high = min(place + WIDEST, len(text))
    if low >= 0:
        yield low, high


def added_spans(field: Field, text: str, base: list[Span]) -> list[Span]:
    """What the field finds besides the base matches."""
    found, covered, k, done = [], _covered(base), 0, 0
    for low, high in _windows(text, covered):
        # the tokens at a window's ends are whole
        while low > 0 and text[low - 1].isalnum() and text[low].isalnum():
            low -= 1
        while high < len(text) and text[high - 1].isalnum() and text[high].isalnum():
            high += 1
        while k < len(covered) and covered[k][1] <= low:
            k += 1
        low, done = max(low, done), high
        own = covered[k : bisect.bisect_left(covered, (high, 0), k)]
        found += field.decode(Tokens(text, [(m.start() + low, m.end() + low) for m in _token(text[low:high])]), own)
    return found


def joined(spans: list[Span]) -> str:
    order = {k: n for n, k in enumerate(LABELS)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(set(spans), key=lambda x: (order[x[0]], x[1], x[2])))


def found_column(field: Field, text: Column) -> Column:
    """A struct of the base counts, the base spans' SHA-256, all spans, and counts of the added ones and of all."""

    def one(value: str) -> tuple:
        base = base_spans(value)
        counts = [sum(1 for b in base if b[0] == k) for k in KINDS] if base else [0] * 4
        added = added_spans(field, value, base)
        more = [sum(1 for a in added if a[0] == k) for k in ("secret", "ssn")]
        return (*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added), *more, len(added), len(base) + len(added))

    def batches(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_secret", "n_ssn", "n_added", "n_spans"]
        for column in columns:
            rows = [one(t or "") for part in slices(column) for t in part]
            yield pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.string() if k in (4, 5) else pa.int64()) for k in range(len(names))], names=names)

    batches.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(batches, FOUND)(text)


def find(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_ssn, n_added (spans of the field), n_spans."""
    bounded_batches(docs)
    return docs.select(F.col(doc_id).alias("doc_id"), found_column(train(), F.col(text)).alias("f")).select("doc_id", "f.*")
