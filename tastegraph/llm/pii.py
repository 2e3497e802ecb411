"""Personal data: rules that always hold, and candidates judged by boosted trees.

Base spans come from four fixed rules (email, ip, card, phone; see ``base_spans``) and always stay. Generators with
high recall propose further, overlapping spans: spelled-out e-mail addresses, telephone numbers without a plus sign (every run of digit groups that adds up to
7 to 12 digits, and each shorter run inside it), cards of 13 to 15 digits, social security numbers, IBANs and IPv6 addresses. Boosted trees score format and
context features of each candidate, Platt's scaling calibrates the scores on rows the trees haven't seen, and a threshold for each kind (the least one with
99 percent precision on a third set of rows, which neither has seen; 0.5 at least) selects. Of selected candidates that overlap, the likeliest stays; none may
overlap a base span.

There are no labelled spans in the tables, so the trees learn from made examples (``examples``: a seeded generator of formats in
contexts, with look-alikes such as order numbers, dates, versions and numbers that fail checksums as negatives). ``measured`` counts what is found in sentences
with formats, cues and look-alikes that ``examples`` never makes. Fitting takes about two seconds on the driver and reads no table. Credentials are not
personal data and are left alone.

One map-only pass over whole texts, no shuffle. A byte table picks the texts that hold a digit, ``@``, ``[``, ``(`` or a colon before a hexadecimal digit or colon
at all; only these reach the regular expressions, which are written so that each is linear in the text.

Defined cases: null and empty texts have no spans; offsets are code points; repeated rows get equal results; columns named like an
output are replaced and all others pass through.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import boosting
from .frames import position, with_arrays
from .words import buffers, texts

BASE = ("email", "ip", "card", "phone")
EXTRA = ("iban", "ssn")
KINDS = BASE + EXTRA
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of ``local@label(.label)+``, from each ``@`` outwards (a pattern from the left would be quadratic in long words)."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[Span]:
    """Matches of the four rules in kind order, then by start; a match that fails its check is dropped and not tried again."""
    out: list[Span] = []
    if "@" in text:
        out += [("email", s, e) for s, e in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


#: (kind, pattern). They may overlap one another and the base spans.
GENERATORS = (
    ("email", re.compile(r"(?i)(?<![\w.+-])[a-z0-9][\w.+-]{0,63} ?[\[(] ?at ?[\])] ?[a-z0-9-]{1,63}(?:(?:\.| ?[\[(] ?dot ?[\])] ?)[a-z0-9-]{1,63}){1,4}(?![\w-])")),
    ("card", re.compile(r"(?<![\w.-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-])")),
    ("ssn", re.compile(r"(?<![\w.-])[0-9]{3}(?:-[0-9]{2}-| [0-9]{2} )[0-9]{4}(?![\w-])")),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    ("ip", re.compile(r"(?<![\w:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:])")),
)
#: Digit groups with single separators between them, and one group of them.
_NUMBERS = re.compile(r"(?<![\w+.-])\(?[0-9]++\)?+(?:[ .-]\(?[0-9]++\)?+)*+(?![\w-])")
_GROUP = re.compile(r"\(?[0-9]+\)?")
#: Digits and groups of a telephone number.
PHONE_DIGITS, PHONE_GROUPS = (7, 12), 6


def _phones(text: str) -> Iterator[tuple[int, int]]:
    """Runs of up to PHONE_GROUPS groups that add up to a telephone number's digits and stand between spaces (or the ends of the whole run)."""
    for m in _NUMBERS.finditer(text):
        if m.end() - m.start() < PHONE_DIGITS[0]:
            continue
        groups = [(g.start(), g.end(), g.end() - g.start() - g[0].count("(") - g[0].count(")")) for g in _GROUP.finditer(text, m.start(), m.end())]
        for i, (start, _, _) in enumerate(groups):
            if i and text[start - 1] != " ":
                continue
            digits = 0
            for k in range(i, min(i + PHONE_GROUPS, len(groups))):
                digits += groups[k][2]
                if digits > PHONE_DIGITS[1]:
                    break
                if digits >= PHONE_DIGITS[0] and (k + 1 == len(groups) or text[groups[k][1]] == " "):
                    yield start, groups[k][1]


_CUES = {
    "email": r"e-?mail|mail|contact|write|reach|adresse|correo|courriel",
    "phone": r"phone|tel|call|fax|mobile|cell|dial|contact|telefon|téléphone|teléfono|handy|whatsapp",
    "card": r"card|visa|amex|mastercard|credit|debit|karte|carte|tarjeta|payment",
    "ssn": r"ssn|social|security|taxpayer",
    "iban": r"iban|account|bank|konto|compte|cuenta|bic|swift",
    "ip": r"ip|ipv6|address|host|server|client|login",
}
_CUE = {k: re.compile(rf"(?i)\b(?:{v})\b") for k, v in _CUES.items()}
_DECOY = re.compile(r"(?i)\b(?:order|invoice|version|isbn|serial|part|no|nr|id|figure|page|ref|date|time|score|item|ticket|build|sku|batch|lot|code)\b")


def _mod97(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of one candidate."""
    span, before, after = text[start:end], text[max(0, start - 32) : start], text[end : end + 24]
    digits = "".join(c for c in span if "0" <= c <= "9")
    groups = re.findall(r"[0-9]+", span)
    seps = {c for c in span if not c.isalnum()}
    return [
        float(KINDS.index(kind)),
        len(span),
        len(digits),
        len(groups),
        max(map(len, groups), default=0),
        min(map(len, groups), default=0),
        len(groups[-1]) if groups else 0,
        len(set(digits)),
        float(luhn(digits)) if digits else 0.0,
        float(kind == "iban" and _mod97(span)),
        float(kind == "card" and digits[:1] in ("3", "4", "5", "6")),
        float(len(seps)),
        float("(" in span),
        float("." in seps),
        float(span[:1] == "0"),
        float(bool(_CUE[kind].search(before))),
        float(bool(_CUE[kind].search(after))),
        float(bool(_DECOY.search(before))),
        float(bool(re.fullmatch(r"(?:19|20)[0-9]{2}[ .-][01]?[0-9][ .-][0-3]?[0-9]|[0-3]?[0-9][ .-][01]?[0-9][ .-](?:19|20)?[0-9]{2}", span))),
        float(kind == "ip" and ("::" in span or span.count(":") == 7)),
        float(bool(re.search(r"[0-9][ .-]?$", before))),
        float(bool(re.match(r"[ .-]?[0-9]", after))),
        float(kind == "ssn" and (digits[:3] in ("000", "666") or digits[:1] == "9" or digits[3:5] == "00" or digits[5:] == "0000")),
    ]


def candidates(text: str) -> list[Span]:
    return [(kind, *m.span()) for kind, pattern in GENERATORS for m in pattern.finditer(text)] + [("phone", s, e) for s, e in _phones(text)]


def examples(n: int = 4_000, seed: int = 3) -> tuple[list[list[float]], list[int], list[str]]:
    """Features, labels and kinds of the candidates in n made sentences."""
    rng = random.Random(seed)
    syllables = "an the er st on re in th ha es le ou ch ung der ie ción os mente que".split()
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 3)))
    digit = lambda k: "".join(rng.choices("0123456789", k=k))
    filler = lambda: " ".join(word() for _ in range(rng.randint(2, 6)))

    def check(d: str) -> str:
        return next(d + c for c in "0123456789" if luhn(d + c))

    def iban(good: bool) -> str:
        country, body = rng.choice(["DE", "FR", "ES", "GB", "NL"]), digit(18)
        code = 98 - int("".join(str(int(c, 36)) for c in body + country) + "00") % 97
        code = code if good else (code + rng.randint(1, 90)) % 97 + 1
        s = f"{country}{code:02d}{body}"
        return " ".join(s[i : i + 4] for i in range(0, len(s), 4)) if rng.random() < 0.5 else s

    def positive() -> tuple[str, str]:
        kind = rng.choice(["email", "phone", "phone", "card", "ssn", "iban", "ip"])
        if kind == "email":
            at, dot = rng.choice([(" [at] ", " [dot] "), (" (at) ", "."), ("[at]", "."), ("(at)", "(dot)")])
            return kind, f"{word()}.{word()}{at}{word()}{dot}{rng.choice(['com', 'org', 'net', 'de', 'fr'])}"
        if kind == "phone":
            return kind, rng.choice([f"({digit(3)}) {digit(3)}-{digit(4)}", f"{digit(3)}-{digit(3)}-{digit(4)}", f"{digit(3)}.{digit(3)}.{digit(4)}", f"0{digit(1)} {digit(2)} {digit(2)} {digit(2)} {digit(2)}", f"0{digit(3)} {digit(3)} {digit(4)}", f"0{digit(2)} {digit(7)}", f"0{digit(9)}", digit(10), f"0{digit(3)} {digit(5)}"])
        if kind == "card":
            d = check(rng.choice(["34", "37"]) + digit(12))
            return kind, rng.choice([d, f"{d[:4]} {d[4:10]} {d[10:]}"])
        if kind == "ssn":
            return kind, rng.choice("- ").join([f"{rng.randint(1, 665):03d}", f"{rng.randint(1, 99):02d}", f"{rng.randint(1, 9999):04d}"])
        if kind == "iban":
            return kind, iban(True)
        return kind, ":".join(f"{rng.randrange(65536):x}" for _ in range(8)) if rng.random() < 0.6 else f"{rng.randrange(1, 65536):x}:{rng.randrange(65536):x}::{rng.randrange(65536):x}"

    def negative() -> str:
        bad = check(digit(15))
        bad = bad[:-1] + str((int(bad[-1]) + rng.randint(1, 9)) % 10)
        return rng.choice(
            [f"{rng.randint(1900, 2035)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1900, 2035)}", f"{digit(2)}.{digit(2)}.{digit(2)}", bad, bad[:13], f"{bad[:4]} {bad[4:8]} {bad[8:12]} {bad[12:]}", f"{digit(4)} {digit(4)}", f"{digit(2)}-{digit(3)}", f"{digit(3)}-{digit(2)}-{digit(3)}", f"{rng.randint(0, 23):02d}:{digit(2)}:{digit(2)}", iban(False), f"{word()} (at) {word()}", f"{word()} (at) {digit(rng.randint(1, 2))}.{digit(2)}", f"{digit(5)}-{digit(5)}-{digit(3)}", f"9{digit(2)}-{digit(2)}-{digit(4)}", f"978-{digit(1)}-{digit(3)}-{digit(5)}-{digit(1)}", f"{digit(2)} {digit(2)} {digit(2)}", digit(7), digit(8), digit(10), digit(11), f"{rng.randint(1900, 2035)} {digit(4)}", f"{digit(3)} {digit(7)}", f"{digit(2)} {digit(3)} {digit(4)}"]
        )

    x, y, kinds = [], [], []
    for _ in range(n):
        good = rng.random() < 0.5
        kind, core = positive() if good else ("", negative())
        cue = rng.random()
        if good:
            bare = kind == "phone" and sum(not c.isdigit() for c in core) < 2  # nothing but its cue tells such a number from others
            lead = rng.choice(re.sub(r"\W", " ", _CUES[kind]).split()) + rng.choice([": ", " ", " is ", ". "]) if bare or cue < 0.6 else ""
        else:
            lead = rng.choice(["order ", "no. ", "version ", "isbn ", "ref: ", "item ", "date: "]) if cue < 0.5 else ""
        text = f"{filler()} {lead}{core}{rng.choice([' ', '. ', ', '])}{filler()}"
        at = text.index(core)
        taken = [(s, e) for _, s, e in base_spans(text)]
        for k, s, e in candidates(text):
            if not any(s < b and a < e for a, b in taken):
                x.append(features(text, k, s, e))
                y.append(int(good and k == kind and (s, e) == (at, at + len(core))))
                kinds.append(k)
    return x, y, kinds


def fit() -> tuple[boosting.Boosted, dict[str, float]]:
    """The calibrated trees and each kind's threshold (above 1: nothing of that kind is selected): three parts of the examples, one for each step."""
    x, y, kinds = examples(6_000)
    x, y, kinds = np.array(x), np.array(y, float), np.array(kinds)
    first, second, third = (np.arange(len(y)) % 3 == k for k in range(3))
    model = boosting.calibrate(boosting.fit(x[first], y[first]), x[second], y[second])
    p, thresholds = model.probability(x[third]), {}
    for kind in KINDS:
        mine = kinds[third] == kind
        order = np.argsort(-p[mine], kind="stable")
        precise = np.cumsum(y[third][mine][order]) >= 0.99 * np.arange(1, mine.sum() + 1)
        if not precise.any():
            thresholds[kind] = 2.0
            continue
        sure = p[mine][order]
        least = int(np.flatnonzero(precise)[-1])
        thresholds[kind] = max(0.5, float(sure[least : least + 2].mean())) if least + 1 < len(sure) else 0.5  # halfway to the next candidate
    return model, thresholds


def measured(n: int = 2_000, seed: int = 29) -> dict[str, tuple[int, int]]:
    """kind -> (spans found whole, spans), and ``look-alikes`` -> (sentences with a false alarm, sentences), in formats, cues and words that ``examples`` never makes."""
    rng = random.Random(seed)
    model, thresholds = fit()
    digit = lambda k: "".join(rng.choices("0123456789", k=k))
    word = lambda: "".join(rng.choices("bdfklmnprstvz", k=2)) + "".join(rng.choices("aeiou", k=2)) + rng.choice("mnrst")
    some = lambda: " ".join(word() for _ in range(rng.randint(3, 7)))
    card = next(c for c in "0123456789" if luhn("37828224631000" + c))
    made = {
        "email": lambda: ("reply to ", f"{word()}_{word()}[at]{word()} [dot] {word()} [dot] net"),
        "phone": lambda: (rng.choice(["my mobile number ", "office tel. ", "please dial "]), rng.choice([f"0{digit(4)} {digit(6)}", f"{digit(3)} {digit(3)} {digit(4)}", f"({digit(4)}) {digit(6)}", f"{digit(4)}-{digit(4)}", digit(9)])),
        "card": lambda: ("charged to amex ", f"3782-822463-1000{card}"),
        "ssn": lambda: ("her social security no ", f"{rng.randint(100, 600)} {rng.randint(10, 99)} {rng.randint(1000, 9999)}"),
        "iban": lambda: ("transfer to ", "GB82 WEST 1234 5698 7654 32"),
        "ip": lambda: ("from host ", f"fe80::{rng.randrange(4096, 65536):x}:{rng.randrange(65536):x}"),
    }
    unlike = lambda: rng.choice(
        [f"coordinates {digit(2)}.{digit(4)} {digit(1)}.{digit(4)}", f"from {rng.randint(1900, 1999)}-{rng.randint(2000, 2030)}", f"at {rng.randint(0, 23)}:{digit(2)}", f"screen of 1920 1080", f"tracking {digit(12)}", f"population {digit(3)} {digit(3)} {digit(3)}", f"chapter {digit(1)}.{digit(1)}.{digit(1)}.{digit(1)}.{digit(1)}", f"timestamp {digit(10)}", f"catalogue {digit(4)}-{digit(3)}"]
    )
    out = {kind: (0, 0) for kind in [*made, "look-alikes"]}
    for _ in range(n):
        kind = rng.choice(list(out))
        lead, core = made[kind]() if kind in made else ("", unlike())
        text = f"{some()} {lead}{core}. {some()}"
        start = text.index(core)
        base, found = find(text, model, thresholds)
        hit = (kind, start, start + len(core)) in found if kind in made else len(found) > len(base)
        out[kind] = (out[kind][0] + hit, out[kind][1] + 1)
    return out


def find(text: str, model: boosting.Boosted, thresholds: dict[str, float]) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of one text."""
    base = base_spans(text)
    taken = sorted((s, e) for _, s, e in base)
    starts = np.array([s for s, _ in taken])
    reach = np.maximum.accumulate([e for _, e in taken]) if taken else np.zeros(0)

    def free(s: int, e: int) -> bool:
        k = int(np.searchsorted(starts, e, "left"))
        return k == 0 or reach[k - 1] <= s

    proposed = [c for c in candidates(text) if free(c[1], c[2])]
    if not proposed:
        return base, base
    p = model.probability(np.array([features(text, *c) for c in proposed]))
    chosen = sorted(((-q, c) for q, c in zip(p.tolist(), proposed, strict=True) if q >= thresholds[c[0]]), key=lambda x: (x[0], x[1]))
    import bisect

    added: list[Span] = []
    ends: list[tuple[int, int]] = []
    for _, c in chosen:
        k = bisect.bisect_left(ends, (c[2], 0))
        if (k == 0 or ends[k - 1][1] <= c[1]) and (k == len(ends) or ends[k][0] >= c[2]):
            ends.insert(k, (c[1], c[2]))
            added.append(c)
    return base, sorted([*base, *added], key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


_SEEN = np.zeros(256, bool)
_SEEN[[*range(48, 58), 64, 91, 40]] = True
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))


def _worth(column: pa.Array) -> np.ndarray:
    data, at = buffers(column)
    out = np.zeros(len(column), bool)
    hexed = np.zeros(256, bool)
    hexed[[*range(48, 59), *range(65, 71), *range(97, 103)]] = True
    for lo in range(0, len(column), 1024):  # a running count over some MB at a time
        hi = min(lo + 1024, len(column))
        part = data[at[lo] : at[hi]]
        seen = _SEEN[part]
        seen[:-1] |= (part[:-1] == 58) & hexed[part[1:]]
        hits = np.flatnonzero(seen) + at[lo]
        out[lo:hi] = np.searchsorted(hits, at[lo + 1 : hi + 1]) > np.searchsorted(hits, at[lo:hi])
    return out


def annotate(docs: DataFrame, text_column: str = "text", redact: bool = False) -> DataFrame:
    """docs with base_spans and pii_spans; with ``redact``, spans in the text become ``[KIND]`` as well."""
    shared = docs.sparkSession.sparkContext.broadcast(fit())
    at = position(docs, text_column)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
    name = docs.columns[at]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, dict]]:
        model, thresholds = shared.value
        as_rows = lambda spans: [{"kind": k, "start": s, "stop": e} for k, s, e in spans]
        for batch in batches:
            column = texts(batch.column(at))
            base, every, changed = [[]] * len(column), [[]] * len(column), {}
            for row in np.flatnonzero(_worth(column)).tolist():
                text = column[row].as_py()
                b, a = find(text, model, thresholds)
                base[row], every[row] = as_rows(b), as_rows(a)
                if redact and a:
                    changed[row] = redacted(text, a)
            got = {"base_spans": pa.array(base, kind), "pii_spans": pa.array(every, kind)}
            if redact:
                if changed:
                    values = batch.column(at).to_pylist()
                    for row, text in changed.items():
                        values[row] = text
                    got[name] = pa.array(values, batch.column(at).type)
                else:
                    got[name] = batch.column(at)
            yield batch, got

    fields = [T.StructField("base_spans", SPANS), T.StructField("pii_spans", SPANS)]
    out = with_arrays(docs, fields + ([docs.schema[at]] if redact else []), compute)
    return out.select([c for c in docs.columns if c.lower() not in ("base_spans", "pii_spans")] + ["base_spans", "pii_spans"])


def redacted(text: str, spans: list[Span]) -> str:
    """Each union of overlapping spans replaced by the first one's kind in brackets."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
