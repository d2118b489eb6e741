"""Personal data by candidate gradient boosting.

Four exact patterns (email, ip, card, phone) always count. Beyond them, high-recall generators propose spans that
may overlap (secrets after a key word, key blocks, long codes, written-out addresses, local telephone numbers, account and
social numbers); boosted trees score each from its format and its context, and those at or above their kind's
calibrated threshold are added, best first, where they overlap nothing chosen already. A secret runs to the end of
its token whatever its length: of secrets within one another the longest counts, and an exact span inside a secret
that goes on for BARE characters more doesn't keep the secret from being added.
"""

from __future__ import annotations

import math
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows, read, schema_with, texts_of, tune, with_columns

BASE_KINDS = ("email", "ip", "card", "phone")
MODEL_KINDS = ("secret", "email", "phone", "account", "social")

DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; each scan is linear in the text."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:  # an address starts where the run of local characters before its @ does
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        done = at + 1
        if m:
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", done)
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() < 40:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


#: The least length of a code that is a candidate without a key word.
BARE = 20

#: The generators: recall first; what they propose is for the trees to judge.
GENERATORS = (
    ("secret", re.compile(r"(?i)(?<![a-z])(?:token|secret|password|passwd|pwd|api[_-]?key|apikey|auth|bearer|key)\b[\"']?\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9+/_.=-]{6,}+)")),
    ("secret", re.compile(r"(?i)(?<![a-z])(?:password|passwd|pwd|passphrase|secret|token)\s+is:?\s+[\"']?([^\s\"',;]{6,}+)")),
    ("secret", re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])([A-Za-z0-9+/_-]{20,}+)")),
    ("secret", re.compile(r"(-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:(?!-----)[A-Za-z0-9+/=:,. \r\n-])*+-----END [A-Z ]{0,40}PRIVATE KEY-----)")),
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]++\s?(?:\[at\]|\(at\)|\sat\s)\s?[A-Za-z0-9-]++(?:(?:\s?(?:\[dot\]|\(dot\)|\sdot\s)\s?|\.)[A-Za-z0-9-]{2,}+)++)")),
    ("phone", re.compile(r"(?<![0-9.+-])(\(?[0-9]{2,5}\)?(?:[ .-][0-9]{2,4}){2,4})(?![0-9.-])")),
    ("account", re.compile(r"(?<![A-Za-z0-9])([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")),
    ("social", re.compile(r"(?<![0-9-])([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")),
)
#: How issued keys begin.
ISSUED = re.compile(r"(?:AKIA|ASIA|AIza|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk[-_](?:live|test|proj)?[-_]?|rk_live_|pk_live_|npm_|pypi-|hf_|eyJ|-----BEGIN )")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
CUES = {
    "secret": ("token", "secret", "password", "passwd", "pwd", "key", "auth", "bearer"),
    "email": ("mail", "contact", "write", "reach"),
    "phone": ("tel", "phone", "call", "fax", "mobile", "cell"),
    "account": ("iban", "account", "bank", "konto"),
    "social": ("ssn", "social", "security"),
}
MIGHT = re.compile(r"[0-9]|PRIVATE KEY|(?i:passphrase|\[at\]|\(at\)|\sat\s|token|secret|passw|pwd|key|auth|bearer)")


def candidates(text: str) -> list[tuple[str, int, int]]:
    if not MIGHT.search(text):
        return []
    found = [(*m.span(1), kind) for kind, pattern in GENERATORS for m in pattern.finditer(text)]
    found.sort()  # each generator's spans come in order: runs are merged
    return [(kind, a, b) for i, (a, b, kind) in enumerate(found) if i == 0 or found[i - 1] != (a, b, kind)]


def account_check(code: str) -> bool:
    """The international account number's remainder."""
    code = code.replace(" ", "")
    return sum(1 for _ in code) > 14 and int("".join(str(int(c, 36)) for c in (code[4:] + code[:4]).lower())) % 97 == 1


def describe(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a candidate as numbers."""
    span, before, after = text[start:end], text[max(0, start - 30) : start].lower(), text[end : end + 15].lower()
    n = len(span)
    digits, upper, lower = sum(c.isdigit() for c in span), sum(c.isupper() for c in span), sum(c.islower() for c in span)
    held = [span.count(c) / n for c in set(span)]
    switches = sum(a.isdigit() != b.isdigit() for a, b in zip(span, span[1:]))
    vowels = sum(c in "aeiouAEIOU" for c in span)
    cue = max((before.rfind(c) + 1 for c in CUES[kind]), default=0)
    token = text[max(0, start - 200) : start]  # of the word that the span is in, what stands before it
    token = token[max(token.rfind(c) for c in " \n\t\"'(<") + 1 :]
    parts = [x for x in re.split("[/_.+-]", span[:200]) if x]
    return [
        float(MODEL_KINDS.index(kind)), n, digits / n, upper / n, lower / n, (n - digits - upper - lower) / n, -sum(p * math.log2(p) for p in held), switches / n, vowels / max(1, upper + lower),
        float(cue > 0), float(cue > 12), float(before.rstrip(" \"'")[-1:] in (":", "=")), float(after[:1] in ("\"", "'")), float(all(c in "0123456789abcdefABCDEF" for c in span)),
        float(digits), float(span.count("-") + span.count(" ") + span.count(".")), float(kind == "account" and account_check(span)), float(before[-1:].isalnum()), float("dot" in span.lower() or "[" in span or "(" in span),
        float(ISSUED.match(span) is not None), float("://" in token or token.startswith(("www.", "/", "./", "~/"))), float(UUID.search(span) is not None), min(digits, upper, lower) / n, max(map(len, parts), default=0) / n, float(" is" in before[-6:]),
        float(sum(not c.isalnum() for c in span)),
    ]


class Boosted:
    """Gradient-boosted regression trees of a fixed depth on the logistic loss, grown on binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32):
        self.depth, self.rate, self.trees = depth, rate, []
        self.start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
        total = np.full(len(x), self.start)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-total))
            tree = self.grow(x, y - p, p * (1 - p), cuts)
            self.trees.append(tree)
            total += self.rate * self.walk(tree, x)

    def grow(self, x, g, h, cuts):
        size = (1 << self.depth) - 1
        feature, split, value = np.zeros(size, np.int64), np.full(size, np.inf), np.zeros(size + 1)
        at = np.zeros(len(x), np.int64)
        for node in range(size):
            rows = np.flatnonzero(at == node)
            best = (1e-6, 0, np.inf)
            if len(rows) >= 8:
                gs, hs = g[rows], h[rows]
                whole = gs.sum() ** 2 / (hs.sum() + 1)
                for k, edges in enumerate(cuts):
                    if len(edges):
                        bin_ = np.searchsorted(edges, x[rows, k], side="left")
                        gl, hl = (np.cumsum(np.bincount(bin_, weights=v, minlength=len(edges) + 1))[:-1] for v in (gs, hs))
                        gain = gl**2 / (hl + 1) + (gs.sum() - gl) ** 2 / (hs.sum() - hl + 1) - whole
                        i = int(gain.argmax())
                        if gain[i] > best[0]:
                            best = (float(gain[i]), k, float(edges[i]))
            feature[node], split[node] = best[1], best[2]
            at[rows] = 2 * node + 1 + (x[rows, best[1]] > best[2])
        leaf = at - size
        value = np.array([g[leaf == i].sum() / (h[leaf == i].sum() + 1) for i in range(size + 1)])
        return feature, split, value

    def walk(self, tree, x):
        feature, split, value = tree
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[rows, feature[at]] > split[at])
        return value[at - len(feature)]

    def chance(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.start + self.rate * sum(self.walk(t, x) for t in self.trees))))


def examples(n: int, seed: int) -> list[tuple[str, str, int, int, bool]]:
    """Written candidates with their truth: (text, kind, start, end, personal).

    What real text holds and nobody has to hide is among them: commit ids and other digests, UUIDs, addresses of pages,
    paths, versions, slugs, numbers.
    """
    rng, out = random.Random(seed), []
    word = lambda lo=2, hi=9: "".join(rng.choice("etaoinshrdlucmfw") for _ in range(rng.randint(lo, hi)))
    pick = lambda chars, k: "".join(rng.choices(chars, k=k))
    digit, low, hexa = "0123456789", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
    every = low + low.upper() + digit
    cue = lambda kind: rng.choice((str.lower, str.upper, str.title))(rng.choice(CUES[kind]))
    said = lambda: rng.choice((" = ", ": ", "=", ":", " : ")) + quote()
    quote = lambda: rng.choice(('"', "'", ""))
    joined = lambda by, lo, hi: by.join(word() for _ in range(rng.randint(lo, hi)))

    def account(valid: bool) -> str:
        body, land = pick(digit, rng.choice((14, 16, 18))), rng.choice(("DE", "FR", "ES", "GB", "NL"))
        check = 98 - int("".join(str(int(c, 36)) for c in body + land.lower()) + "00") % 97
        code = f"{land}{check if valid else (check + rng.randint(1, 40)) % 97:02d}{body}"
        return " ".join(code[i : i + 4] for i in range(0, len(code), 4)) if rng.random() < 0.5 else code

    def uuid() -> str:
        return "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12))

    def issued() -> str:
        return rng.choice((lambda: "AKIA" + pick(low.upper() + digit, 16), lambda: rng.choice(("ghp_", "gho_", "npm_", "hf_")) + pick(every, 36), lambda: "glpat-" + pick(every, 20), lambda: "sk_live_" + pick(every, 24), lambda: f"xoxb-{pick(digit, 11)}-{pick(digit, 12)}-{pick(every, 24)}", lambda: "AIza" + pick(every + "_-", 35), lambda: ".".join(("eyJ" + pick(every, 30), pick(every, 60), pick(every + "_-", 43)))))()

    def block() -> str:
        kind = rng.choice(("RSA ", "EC ", "OPENSSH ", ""))
        return f"-----BEGIN {kind}PRIVATE KEY-----\n" + "\n".join(pick(every + "+/", 64) for _ in range(rng.randint(2, 25))) + f"\n-----END {kind}PRIVATE KEY-----"

    def spoken_password() -> str:
        return word(3, 7).title() + pick(digit, rng.randint(1, 3)) + pick("!&#*$%@", 1) + pick(every, rng.randint(1, 4))

    def code(lo: int, hi: int) -> str:
        return pick(rng.choice((hexa, hexa.upper(), low + digit, every)), rng.randint(lo, hi))

    def page() -> tuple[str, str]:
        return rng.choice(("see ", "", "at ")) + f"https://{word()}.{word(2, 3)}", rng.choice(("/", "/p/", "/en/")) + f"{rng.randint(2000, 2030)}/{rng.randint(10, 12)}/" + joined("-", 3, 9) + rng.choice(("", f"-{rng.randint(1, 99)}", "/" + pick(hexa, rng.choice((8, 12, 32)))))

    #: (weight, kind, the words before, the span, what follows, personal)
    made = (
        (4, "secret", lambda: cue("secret") + said(), lambda: code(20, 64), quote, True), (2, "secret", lambda: cue("secret") + said(), lambda: pick(every, rng.randint(8, 20)) + pick(digit, 2), quote, True), (2, "secret", lambda: cue("secret") + said(), lambda: pick(rng.choice((hexa, low + digit, every, every + "+/")), rng.randint(200, 2000)), quote, True),
        (2, "secret", lambda: cue("secret") + said(), issued, quote, True), (3, "secret", lambda: word() + " ", issued, lambda: " ", True), (2, "secret", lambda: word() + "\n", block, lambda: "\n", True), (2, "secret", lambda: rng.choice(("my password is ", "the password is ", "Password is: ", "passphrase is ", "secret is ")), spoken_password, lambda: rng.choice((" ", "\n")), True),
        (2, "secret", lambda: word() + " ", lambda: pick(every, rng.randint(32, 64)) + pick(digit, 1) + pick(low, 1) + pick(low.upper(), 1), lambda: " ", True), (2, "secret", lambda: word() + " ", lambda: pick(every + "+/", rng.randint(200, 2000)), lambda: " ", True), (1, "secret", lambda: cue("secret") + said(), lambda: ".".join(pick(every + "-_", rng.randint(30, 700)) for _ in range(3)), quote, True),
        (3, "secret", lambda: rng.choice(("commit ", "rev ", "see ", "sha1 ", "sha256:", "md5 ", "", "fixed in ", "digest ")), lambda: pick(hexa, rng.choice((32, 40, 64, 40, 20, 28))), lambda: rng.choice((" ", ".", ",")), False), (2, "secret", lambda: word() + " ", uuid, lambda: " ", False), (1, "secret", lambda: rng.choice(("id ", "uuid ", "request ")), uuid, lambda: " ", False),
        (4, "secret", None, None, lambda: rng.choice((" ", ".", ")")), False), (1, "secret", lambda: word() + " /", lambda: joined("/", 5, 300) + "/" + pick(digit, 2), lambda: " ", False), (1, "secret", lambda: "~", lambda: "/" + joined("/", 4, 9) + f"/{word()}_{pick(digit, 2)}", lambda: " ", False),
        (1, "secret", lambda: " ", lambda: pick(digit, rng.randint(20, 2000)), lambda: " ", False), (2, "secret", lambda: word() + " ", lambda: joined("-", 4, 300) + "-" + pick(digit, 1), lambda: " ", False), (1, "secret", lambda: word() + " ", lambda: joined("_", 4, 9) + "_v" + pick(digit, 2), lambda: " ", False),
        (2, "secret", lambda: rng.choice(("key", "Key", "token", "auth")) + rng.choice((": ", " : ")), lambda: word(6, 12), lambda: " ", False), (2, "secret", lambda: rng.choice(("the password is ", "a secret is ", "the token is ", "my password is ")), lambda: word(6, 12), lambda: rng.choice((" ", ".")), False), (1, "secret", lambda: word() + " ", lambda: word(18, 30) + pick(digit, 1), lambda: " ", False),
        (2, "email", lambda: rng.choice(("", "contact ", "mail ")), lambda: f"{word()}.{word()} [at] {word()} [dot] com", lambda: "", True), (1, "email", lambda: " ", lambda: f"{word()}(at){word()}.{rng.choice(('com', 'org', 'net'))}", lambda: "", True), (2, "email", lambda: cue("email") + said(), lambda: f"{word()} at {word()} dot com", lambda: "", True),
        (2, "email", lambda: word() + " ", lambda: f"{word()} at {word()}.{word(2, 6)}", lambda: " ", False), (2, "email", lambda: word() + " ", lambda: f"{word()} at {word()}.{word().title()}", lambda: " ", False),
        (2, "phone", lambda: cue("phone") + rng.choice((": ", " ", ". ")), lambda: f"({pick(digit, 3)}) {pick(digit, 3)}-{pick(digit, 4)}", lambda: "", True), (2, "phone", lambda: cue("phone") + rng.choice((": ", " ")), lambda: f"{pick(digit, 3)}-{pick(digit, 3)}-{pick(digit, 4)}", lambda: "", True), (2, "phone", lambda: word() + " ", lambda: f"{pick(digit, 3)} {pick(digit, 3)} {pick(digit, 3)}", lambda: " ", False),
        (1, "phone", lambda: word() + " ", lambda: f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", lambda: " ", False), (1, "phone", lambda: word() + " ", lambda: " ".join(pick(digit, 4) for _ in range(4)), lambda: " ", False), (1, "phone", lambda: word() + " ", lambda: ".".join(pick(digit, rng.randint(2, 3)) for _ in range(4)), lambda: " ", False),
        (2, "account", lambda: rng.choice(("IBAN ", "account ", "", word() + " ")), lambda: account(True), lambda: "", True), (2, "account", lambda: word() + " ", lambda: account(False), lambda: "", False),
        (2, "social", lambda: cue("social") + rng.choice((" ", ": ")), lambda: f"{pick(digit, 3)}-{pick(digit, 2)}-{pick(digit, 4)}", lambda: "", True), (2, "social", lambda: word() + " ", lambda: f"{pick(digit, 3)}-{pick(digit, 2)}-{pick(digit, 4)}", lambda: "", False),
    )
    for _, kind, before, span, after, personal in rng.choices(made, weights=[m[0] for m in made], k=n):
        lead, held = page() if before is None else (before(), span())
        head = joined(" ", 1, 6) * (rng.random() < 0.8) + rng.choice((" ", ". ", "\n"))
        text = head + lead + held + after() + " " + word() + " " + word()
        start = len(head) + len(lead)
        out.append((text, kind, start, start + len(held), personal))
    return out


@lru_cache(maxsize=1)
def model(n: int = 6000, seed: int = 11, precision: float = 0.98) -> tuple[Boosted, dict[str, float]]:
    """The trees, and for each kind the least threshold with that precision on examples that they haven't seen."""
    grown, apart = examples(n, seed), examples(n // 2, seed + 1)
    trees = Boosted(np.array([describe(t, k, a, b) for t, k, a, b, _ in grown]), np.array([float(e[4]) for e in grown]))
    chance, limits = trees.chance(np.array([describe(t, k, a, b) for t, k, a, b, _ in apart])), {}
    for kind in MODEL_KINDS:
        own = sorted(((float(c), e[4]) for c, e in zip(chance, apart) if e[1] == kind), reverse=True)
        good, limits[kind] = 0, 1.1
        for i, (c, right) in enumerate(own, 1):
            good += right
            if good >= precision * i and (i == len(own) or own[i][0] < c):
                limits[kind] = min(limits[kind], max(c, 0.5))
    return trees, limits


def all_spans(texts: list[str], trees: Boosted, limits: dict[str, float]) -> list[tuple[list, list]]:
    """For each text its base spans, and those that the trees add."""
    based = [base_spans(t) for t in texts]
    found = [(i, c) for i, t in enumerate(texts) for c in candidates(t)]
    added: list[list] = [[] for _ in texts]
    if found:
        chances = trees.chance(np.array([describe(texts[i], *c) for i, c in found]))
        whole: set = set()
        likely = [(float(p), i, c) for p, (i, c) in zip(chances, found) if p >= limits[c[0]]]
        reach: dict[int, int] = {}
        for _, i, (kind, a, b) in sorted(likely, key=lambda x: (x[1], x[2][1], -x[2][2])):
            if kind == "secret" and b > reach.get(i, 0):
                reach[i] = b
                whole.add((i, a, b))
        held: dict[int, tuple[bytearray, bytearray]] = {}  # a byte a character: in a base span (1) or an added one (2); and whether a base span goes on across its start
        for _, i, (kind, a, b) in sorted(likely, key=lambda x: (-x[0], x[1], x[2])):
            if kind == "secret" and (i, a, b) not in whole:
                continue
            if i not in held:
                taken, across = held[i] = bytearray(len(texts[i])), bytearray(len(texts[i]) + 1)
                for _, x, y in based[i]:
                    taken[x:y] = b"\1" * (y - x)
                    across[x + 1 : y] = b"\1" * (y - x - 1)
            taken, across = held[i]
            free = taken.count(0, a, b)
            if free == b - a or kind == "secret" and free >= BARE and not across[a] and not across[b] and taken.find(2, a, b) < 0:
                taken[a:b] = b"\2" * (b - a)
                added[i].append((kind, a, b))
    return list(zip(based, added))


def joined(spans: list[tuple[str, int, int]]) -> str:
    order = {k: i for i, k in enumerate((*BASE_KINDS, *(k for k in MODEL_KINDS if k not in BASE_KINDS)))}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (order[s[0]], s[1], s[2])))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span as <KIND>; of spans that overlap (base kinds may), the union goes by the first's name."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, redacted: bool = True) -> DataFrame:
    """docs with counts of the base kinds, base (joined spans), spans (base and added ones) and, if redacted, text redacted.

    Null texts are empty and have no spans (a redacted null stays null); texts of any length are read whole, in
    time linear in their length; of candidates equal in chance the first in the text is added; repeated rows give
    repeated results, an empty table none. Columns of docs with these names are replaced.
    """
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model())
    counts = [f"n_{k}" for k in BASE_KINDS]
    docs = docs.drop(*counts, "base", "spans")

    def add(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, texts = batch.column("text").to_pylist(), texts_of(batch)
        done = all_spans(texts, *shared.value)
        columns = {f"n_{k}": pa.array([sum(s[0] == k for s in base) for base, _ in done], pa.int64()) for k in BASE_KINDS}
        if redacted:
            columns["text"] = pa.array([None if r is None else redact(t, base + more) for r, t, (base, more) in zip(raw, texts, done)], pa.string())
        return with_columns(batch, **columns, base=pa.array([joined(b) for b, _ in done], pa.string()), spans=pa.array([joined(b + m) for b, m in done], pa.string()))

    return map_rows(docs, add, schema_with(docs, **dict.fromkeys(counts, "bigint"), base="string", spans="string"))


def op3(spark, sf_dir):
    from pyspark.sql import functions as F

    out = find(read(spark, sf_dir, "documents").select("doc_id", "text"), redacted=False)
    return out.select("doc_id", *[f"n_{k}" for k in BASE_KINDS], F.sha2("base", 256).alias("base_sha256"), "spans")
