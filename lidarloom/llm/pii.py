"""Personal data: labelers by form, word lists and context vote on spans, EM weighs them, a classifier decides.

Four kinds have a form that is certain (the base spans: email, ip, card, phone). For spans of a looser form, of those
and of more kinds, the same labelers vote; how far each is right is estimated from how they agree over all documents,
and a logistic classifier learns the resulting probabilities from votes, kind, length and share of digits.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Kinds in the order in which spans of one start are listed; those after phone have no base form.
KINDS = ("email", "ip", "card", "phone", "secret", "iban", "ssn", "person")
EMAIL, IP, CARD, PHONE, SECRET, IBAN, SSN, PERSON = range(8)
N_BASE = 4
LABELERS = ("form", "check", "cue", "list", "edges", "assigned", "variety")
#: Buckets of a span's length (by powers of two from 8) and of its share of digits.
LENGTHS, SHARES = 6, 3
THRESHOLD = 0.5
ROUNDS = 50
SAYS, PRIOR = (0.01, 0.99), (0.05, 0.95)
#: Share of yes among a labeler's votes from which EM starts, where there is no personal data and where there is: a number
#: of the right length often passes for a card, but its check digit doesn't. It counts like so many votes.
START_NO, START_OK, START_VOTES = (0.5, 0.05, 0.3, 0.5, 0.5, 0.3, 0.5), (0.9, 0.99, 0.9, 0.9, 0.9, 0.9, 0.9), 20.0
#: How often a labeler says yes to personal data at least: real numbers pass their check digits.
LEAST_OK = (0.5, 0.99, 0.5, 0.5, 0.5, 0.5, 0.5)
#: Votes by which what a labeler does for one kind is drawn to what it does for all.
DRAWN = 20.0
#: Characters on either side that context labelers look at.
NEAR = 32

#: Word lists.
CUES = {
    EMAIL: ("email", "e-mail", "mail", "contact", "write", "correo", "courriel"),
    IP: ("ip", "host", "server", "address", "adresse", "addr"),
    CARD: ("card", "visa", "mastercard", "amex", "credit", "debit", "karte", "carte", "tarjeta"),
    PHONE: ("phone", "tel", "telephone", "call", "mobile", "fax", "cell", "telefon", "téléphone", "teléfono"),
    SECRET: ("token", "secret", "password", "passwd", "pwd", "key", "apikey", "api_key", "auth", "bearer", "credential"),
    IBAN: ("iban", "account", "konto", "compte", "cuenta", "bank"),
    SSN: ("ssn", "social", "security", "tax", "id"),
    PERSON: ("name", "mr", "mrs", "ms", "dr", "herr", "frau", "mme", "señor", "señora", "dear", "signed", "by"),
}
OTHERS = ("version", "isbn", "issn", "order", "invoice", "commit", "sha", "sha1", "sha256", "md5", "checksum", "hash", "uuid", "part", "page", "build", "release", "serial", "article")
SUFFIXES = ("com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "io", "de", "fr", "es", "it", "nl", "uk", "at", "ch", "be", "pl", "eu", "us", "ca", "au", "jp", "cn", "in", "br", "mx", "ru")
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "351", "353", "358", "420")
GIVEN = (
    "Alice", "Andrew", "Anna", "Anne", "Antonio", "Barbara", "Brian", "Carlos", "Carmen", "Charles", "Christine", "Claire", "Daniel", "David", "Elena", "Elizabeth", "Emily", "Emma", "Eric", "Eva", "Fatima", "François", "George", "Hans", "Helen", "Isabel", "Jack",
    "James", "Jane", "Javier", "Jean", "Jennifer", "Jessica", "John", "Jonathan", "José", "Juan", "Julia", "Karen", "Karl", "Katherine", "Kevin", "Klaus", "Laura", "Linda", "Lisa", "Louis", "Lucas", "Luis", "Manuel", "Maria", "Marie", "Mark", "Martin", "Mary",
    "Michael", "Michel", "Monika", "Nicole", "Olivia", "Pablo", "Patricia", "Paul", "Pedro", "Peter", "Petra", "Philippe", "Pierre", "Richard", "Robert", "Rosa", "Sabine", "Sandra", "Sarah", "Sofia", "Stefan", "Stephen", "Susan", "Thomas", "Ursula", "William", "Wolfgang",
)
PREFIXES = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "glpat-", "sk-", "sk_live_", "xoxb-", "xoxp-", "eyJ")
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Mme", "Señor", "Señora")

NAMES = frozenset(GIVEN)
# runs of digits start where no digit stands before and are taken whole, so no text is looked at twice
IP_FORM = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD_FORM = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE_FORM = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
SPELLED = re.compile(r"[ ]?[\[(]at[\])][ ]?[A-Za-z0-9-]{1,63}(?:(?:\.|[ ]?[\[(]dot[\])][ ]?)[A-Za-z0-9-]{1,63})+", re.I)
AT = re.compile(r"[\[(]at[\])]", re.I)
IP6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
NATIONAL = re.compile(r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])")
SOCIAL = re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")
ACCOUNT = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")
ABROAD = re.compile(r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])")
LONG = re.compile(r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{16,}+={0,2}")
KEY = re.compile(r"[A-Za-z0-9_-]{12,}+")
VALUE = re.compile(r"[ ]?[\"']?([^\s\"'<>=:,;()\[\]]{6,128}+)")
ASSIGNS = re.compile(r"[=:]")
NAMED = re.compile(r"[A-Za-z_-]+(?=[\"']?[ ]?$)")
TITLED = re.compile(rf"\b(?:{'|'.join(TITLES)})\.? (?=[^\W\d_])([^\W\d_]+(?: [^\W\d_]+)?)")
SURNAME = re.compile(r" [^\W\d_]+")
WORDS = re.compile(r"[^\W\d][\w-]*")
DIGIT = re.compile(r"[0-9]")


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(number)):
        x = ord(c) - 48
        total += x if k % 2 == 0 else (2 * x if x < 5 else 2 * x - 9)
    return total % 10 == 0


def small(part: str) -> bool:
    """Whether a part of an address is at most 255, however many zeros lead it."""
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def emails(text: str):
    """Spans of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, leftmost first: every one is around an @, from as far
    left as its characters go."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            last = m.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, kind, end) of the base kinds, and the matches of their patterns that fail the condition."""
    good = [(a, EMAIL, b) for a, b in emails(text)]
    failed = []
    if not DIGIT.search(text):
        return good, failed
    if "." in text:
        for m in IP_FORM.finditer(text):
            (good if all(map(small, m[0].split("."))) else failed).append((m.start(), IP, m.end()))
    for m in CARD_FORM.finditer(text):
        if m.end() - m.start() >= 13:
            n = digits(m[0])
            if 14 <= len(n) <= 19 and luhn(n):
                good.append((m.start(), CARD, m.end()))
            elif 13 <= len(n) <= 19:
                failed.append((m.start(), CARD, m.end()))
    if "+" in text:
        for m in PHONE_FORM.finditer(text):
            if 10 <= len(digits(m[0])) <= 15:
                good.append((m.start(), PHONE, m.end()))
            else:  # it may have run on into the next number
                shorter = ABROAD.match(text, m.start())
                failed.append((m.start(), PHONE, shorter.end() if shorter else m.end()))
    return good, failed


def secrets(text: str):
    """Keys that start in a known way, and what is assigned to a name like password."""
    for prefix in PREFIXES:
        at = text.find(prefix)
        while at >= 0:
            m = KEY.match(text, at)
            if m and (at == 0 or not text[at - 1].isalnum()) and len(m[0]) >= 16:
                yield at, SECRET, m.end()
            at = text.find(prefix, m.end() if m else at + 1)
    if "=" in text or ":" in text:
        for m in ASSIGNS.finditer(text):
            name = NAMED.search(text, max(0, m.start() - 20), m.start())
            value = VALUE.match(text, m.end()) if name and name[0].lower() in CUES[SECRET] else None
            if value:
                yield value.start(1), SECRET, value.end(1)


def loose_spans(text: str):
    """(start, kind, end) of looser forms; where they overlap, the earlier in this order is taken."""
    if DIGIT.search(text):
        if "-" in text:
            yield from ((m.start(), SSN, m.end()) for m in SOCIAL.finditer(text))
        yield from ((m.start(), IBAN, m.end()) for m in ACCOUNT.finditer(text))
        yield from ((m.start(), PHONE, m.end()) for m in NATIONAL.finditer(text))
        if ":" in text:
            yield from ((m.start(), IP, m.end()) for m in IP6.finditer(text))
    for m in AT.finditer(text) if "at" in text or "AT" in text else ():
        start = m.start() - (text[m.start() - 1 : m.start()] == " ")
        first = start
        while first > 0 and start - first < 64 and text[first - 1] in LOCAL:
            first -= 1
        spelled = SPELLED.match(text, start)
        if spelled and first < start:
            yield first, EMAIL, spelled.end()
    yield from secrets(text)
    words = text.split()
    if any(len(w) >= 16 and DIGIT.search(w) for w in words):
        for m in LONG.finditer(text):
            if DIGIT.search(m[0]) and any(c.isalpha() for c in m[0]):
                yield m.start(), SECRET, m.end()
    found = NAMES.intersection(words)
    if found:
        for m in re.finditer(rf"\b(?:{'|'.join(sorted(found))})\b", text):
            after = SURNAME.match(text, m.end())
            if after and after[0][1].isupper():
                yield m.start(), PERSON, after.end()
    if any(t in text for t in TITLES):
        yield from ((m.start(1), PERSON, m.end(1)) for m in TITLED.finditer(text) if m[1][0].isupper())


def candidates(text: str) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, base) in order: all base spans, and others that touch none of those nor one another."""
    base, failed = base_spans(text)
    out = [(*s, True) for s in base]
    taken = sorted((a, b) for a, _, b in base)
    reach = np.maximum.accumulate([b for _, b in taken]).tolist() if taken else []
    starts = [a for a, _ in taken]
    own: list[tuple[int, int]] = []  # sorted, apart from each other
    own_starts: list[int] = []
    for a, kind, b in [*loose_spans(text), *failed]:
        k, j = bisect_right(starts, b - 1), bisect_right(own_starts, b - 1)
        if a >= b or (k and reach[k - 1] > a) or (j and own[j - 1][1] > a):
            continue
        own.insert(j, (a, b))
        own_starts.insert(j, a)
        out.append((a, kind, b, False))
    return sorted(out)


def iban_check(text: str) -> bool:
    plain = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def switches(text: str) -> int:
    """How often small letters, capitals and digits take turns: often in random strings, seldom in joined words."""
    kinds = ["d" if c.isdigit() else "A" if c.isupper() else "a" for c in text if c.isalnum()]
    return sum(a != b for a, b in zip(kinds, kinds[1:]))


def entropy(text: str) -> float:
    n = np.unique(list(text), return_counts=True)[1] / len(text)
    return float(-(n * np.log2(n)).sum())


def votes(text: str, start: int, kind: int, end: int) -> list[int]:
    """What each of LABELERS says of a span: 1 personal data, -1 not, 0 nothing."""
    span, own = text[start:end], digits(text[start:end])
    before, after = text[max(0, start - NEAR) : start], text[end : end + NEAR]
    words = [w.lower() for w in WORDS.findall(before)]
    if before and start > NEAR and words and before[0].isalnum():
        words = words[1:]  # its beginning is cut off
    yes = lambda x: 1 if x else -1
    form = {
        EMAIL: lambda: yes(span.rsplit(".", 1)[-1].isalpha()) if "@" in span else 0, IP: lambda: yes(":" in span or all(map(small, span.split(".")))), CARD: lambda: yes(14 <= len(own) <= 19),
        PHONE: lambda: yes(10 <= len(own) <= 15), SECRET: lambda: yes(span.startswith(PREFIXES) or len(span) >= 12 and DIGIT.search(span)), IBAN: lambda: yes(15 <= len(span.replace(" ", "")) <= 34), SSN: lambda: 1, PERSON: lambda: yes(" " in span),
    }[kind]()
    check = {
        CARD: lambda: yes(luhn(own)), IBAN: lambda: yes(iban_check(span)), SSN: lambda: yes(own[:3] not in ("000", "666") and own[0] != "9" and own[3:5] != "00" and own[5:] != "0000"),
        SECRET: lambda: 0 if span.startswith(PREFIXES) else yes(6 * switches(span) >= len(span)), IP: lambda: 0 if ":" in span else yes(all(p == "0" or p[0] != "0" for p in span.split("."))),
    }.get(kind, lambda: 0)()
    near = words[-3:]
    cue = 1 if any(w in CUES[kind] for w in near) else -1 if any(w in OTHERS for w in near) else 0
    listed = {
        EMAIL: lambda: yes(re.split(r"[.)\] ]", span)[-1].lower() in SUFFIXES), PHONE: lambda: yes(any(own.startswith(c) for c in CALLING)) if span[0] == "+" else 0,
        SECRET: lambda: 1 if span.startswith(PREFIXES) else 0, PERSON: lambda: yes(span.split(" ")[0] in NAMES), IBAN: lambda: yes(span[:2].lower() in SUFFIXES or span[:2] == "GB"),
    }.get(kind, lambda: 0)()
    glued = lambda c: bool(c) and (c.isalnum() or c in "_@")
    edges = yes(not glued(before[-1:]) and not glued(after[:1]))
    assigned = 1 if re.search(r"[=:][\s]*[\"'(<]?$", before) else 0
    variety = {
        SECRET: lambda: yes(entropy(span) >= 3.0), CARD: lambda: yes(len(set(own)) >= 4), PHONE: lambda: yes(len(set(own)) >= 4), SSN: lambda: yes(len(set(own)) >= 3), IBAN: lambda: yes(len(set(own)) >= 3),
    }.get(kind, lambda: 0)()
    return [form, check, cue, listed, edges, assigned, variety]


def pattern(text: str, start: int, kind: int, end: int) -> int:
    """What the classifier sees of a span, as one number: kind, votes, buckets of length and of the share of digits."""
    n = end - start
    out = kind
    for v in votes(text, start, kind, end):
        out = 3 * out + v + 1
    length = min(LENGTHS - 1, max(0, n.bit_length() - 3))
    share = min(SHARES - 1, SHARES * len(digits(text[start:end])) // n)
    return (out * LENGTHS + length) * SHARES + share


def unpacked(patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """kind, votes, length and share of each pattern()."""
    rest, share = np.divmod(patterns, SHARES)
    rest, length = np.divmod(rest, LENGTHS)
    cast = np.zeros((len(patterns), len(LABELERS)), dtype=np.int64)
    for j in reversed(range(len(LABELERS))):
        rest, v = np.divmod(rest, 3)
        cast[:, j] = v - 1
    return rest, cast, length, share


def label_model(kind: np.ndarray, cast: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of each pattern, reliability) by EM: a share of personal data for each kind; and for each class (0: not,
    1: personal data), kind and labeler how often it says yes when it votes, drawn to what that is over all kinds.

    A labeler that says yes to both classes alike tells nothing and so comes to weigh nothing; none is taken to be worse
    than chance. Abstaining tells nothing. Rounds start from START_NO and START_OK.
    """
    of_kind = (kind[None, :] == np.arange(len(KINDS))[:, None]) * n[None, :]
    voted, yes = (cast != 0).astype(float), (cast > 0).astype(float)
    start = np.array([START_NO, START_OK])
    prior, says = np.full(len(KINDS), 0.5), np.repeat(start[:, None, :], len(KINDS), axis=1)
    for _ in range(rounds + 1):
        ok = np.maximum(says[1], LEAST_OK)
        no = np.minimum(says[0], ok)
        odds = np.where(cast > 0, np.log(ok / no)[kind], np.where(cast < 0, np.log((1 - ok) / (1 - no))[kind], 0.0)).sum(1)
        post = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior))[kind] + odds, -30, 30)))
        prior = np.clip((of_kind @ post + 1) / (of_kind.sum(1) + 2), *PRIOR)
        says = []
        for own, first in zip((1 - post, post), start, strict=True):
            hits, total = (of_kind * own[None, :]) @ yes, (of_kind * own[None, :]) @ voted
            overall = (hits.sum(0) + START_VOTES * first) / (total.sum(0) + START_VOTES)
            says.append(np.clip((hits + DRAWN * overall) / (total + DRAWN), *SAYS))
    return post, np.stack([no, ok])


def features(kind: np.ndarray, cast: np.ndarray, length: np.ndarray, share: np.ndarray) -> np.ndarray:
    one_hot = lambda x, k: (x[:, None] == np.arange(k)).astype(float)
    return np.concatenate([np.ones((len(kind), 1)), one_hot(kind, len(KINDS)), cast > 0, cast < 0, one_hot(length, LENGTHS), one_hot(share, SHARES)], axis=1).astype(float)


def classifier(x: np.ndarray, wanted: np.ndarray, n: np.ndarray, ridge: float = 0.1, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic classifier that learns probabilities `wanted` of rows that count n times, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (wanted - p)) - ridge * w
        bend = (x * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w = w + step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return w


def scores(patterns: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The final classifier's probability for each pattern that occurs n times."""
    kind, cast, length, share = unpacked(patterns)
    post, _ = label_model(kind, cast, n)
    x = features(kind, cast, length, share)
    return 1 / (1 + np.exp(-np.clip(x @ classifier(x, post, n), -30, 30)))


SPANS = "array<struct<start:int,kind:int,end:int,pattern:long,base:boolean>>"


def spotted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans: base ones and candidates."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            counts, shas, sizes, flat = [], [], [], []
            for text in batch.column(1).to_pylist():
                found = candidates(text or "")
                base = [s for s in found if s[3]]
                counts.append([sum(s[1] == k for s in base) for k in range(N_BASE)])
                shas.append(hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in base).encode()).hexdigest())
                sizes.append(len(found))
                flat += [(a, k, b, pattern(text, a, k, b), is_base) for a, k, b, is_base in found]
            columns = list(zip(*flat, strict=True)) or [[]] * 5
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_())
            spans = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["start", "kind", "end", "pattern", "base"])
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            n = np.array(counts, dtype=np.int64).reshape(-1, N_BASE)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(n[:, k]) for k in range(N_BASE)], pa.array(shas, pa.string()), pa.ListArray.from_arrays(offsets, spans)],
                names=["doc_id", *[f"n_{KINDS[k]}" for k in range(N_BASE)], "base_sha256", "spans"],
            )

    counted = ", ".join(f"n_{KINDS[k]} long" for k in range(N_BASE))
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, {counted}, base_sha256 string, spans {SPANS}")


def decided(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """spotted(), with the spans that stay: base ones, and candidates whose probability reaches threshold.

    Patterns are at most 8 kinds times 3^7 votes times the buckets however many documents there are, so their counts fit
    the driver, where EM and the classifier run.
    """
    found = stored(spotted(docs))
    counts = found.select(F.explode("spans.pattern").alias("pattern")).groupBy("pattern").count().orderBy("pattern").collect()
    patterns, n = np.array([r["pattern"] for r in counts], dtype=np.int64), np.array([r["count"] for r in counts], dtype=float)
    good = patterns[scores(patterns, n) >= threshold].tolist() if len(patterns) else []
    accepted = F.array(*map(F.lit, good)).cast("array<long>")
    return found.withColumn("spans", F.array_sort(F.filter("spans", lambda s: s["base"] | F.array_contains(accepted, s["pattern"]))))


def personal_data(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text) -> doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans: kind:start:end of all spans, in code
    points, by start and kind, joined by commas.

    Null text counts as empty; texts without spans give an empty string. Null and repeated ids stay, a row each, judged
    alike. Texts may be of any length: patterns take runs whole, so none is walked twice. An empty table gives no rows.
    Other columns don't take part.
    """
    named = F.array(*map(F.lit, KINDS))
    told = F.transform("spans", lambda s: F.concat_ws(":", F.get(named, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
    out = decided(docs, threshold)
    return out.withColumn("spans", F.array_join(told, ","))


def redacted(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with each span of personal data in text replaced by its kind, as <email>; of spans that overlap, what they
    cover goes and the first names it. n_chars, if there, counts anew. Null texts stay null; other columns as they were.
    Edge cases as in personal_data()."""
    d = stored(docs.select(F.struct(F.lit(0).alias("__"), *[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.monotonically_increasing_id().alias("doc_id"), F.col("text").cast("string").alias("text")))
    found = decided(d.select("doc_id", "text"), threshold).select("doc_id", "spans")
    named = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    past = lambda s, x: F.substring(F.col("text"), s["at"] + 1, F.greatest(x["start"] - s["at"], F.lit(0)))
    step = lambda s, x: F.struct(F.concat(s["out"], F.when(x["start"] >= s["at"], F.concat(past(s, x), F.get(named, x["kind"]))).otherwise("")).alias("out"), F.greatest(s["at"], x["end"]).alias("at"))
    done = F.aggregate("spans", start, step)
    text = F.transform(F.array(done), lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))))[0]
    out = d.join(found, "doc_id").withColumn("text", F.when(F.col("text").isNotNull(), text))
    own = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*[own[c] if c in own else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])
