"""Personal data by a semi-Markov conditional random field beside base patterns.

Base spans are four patterns (email, ip, card, phone), leftmost and non-overlapping per kind. The field (semicrf.py)
adds what patterns miss: spelled-out and bracketed addresses, numbers without a plus sign, cards grouped by other
signs, IPv6. Around every sign of personal data (a digit, an at sign, a spelled-out one) an island of text is cut;
its candidate segments (at most ``MOST_PIECES`` pieces long) have features of the whole span: digits and their groups,
separators, the Luhn sum, octets, labels, what stands on either side, the cue word before. Dynamic programming chooses
boundaries and types together. Base spans stay as they are; candidates that touch one are not offered.

The field is trained once, on the driver, and goes to the tasks with the function (some thousand weights), on ``EXAMPLES`` made-up sentences with known spans and look-alikes
(dates, versions, amounts, ISBNs, order numbers); nothing is learned from the documents.

Spark's part: one Arrow projection, no shuffle; every document is judged by itself.

Defined cases: null text is empty (no spans); repeated rows get a row each; texts may be of any length (the
work grows with it in proportion); an empty table gives an empty result; other columns are ignored, or carried through by ``redacted``.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import documents, whole_text
from ledgerloom.llm.semicrf import Candidate, SemiCRF

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
EXAMPLES = 1500
MOST_PIECES = 28
REACH = 64
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[^A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_ANCHOR = re.compile(r"[0-9@＠]|[\[({<] ?(?:at|AT|At|arroba)\b|\s(?:at|AT|At|arroba)\s[\w-]{1,40}\s?[\[({]?\s?(?:dot|DOT|Dot|punto|punkt|point|\.)[\s\])}]")
_PIECE = re.compile(r"[^\W\d_]+|[0-9]+|\s|.", re.S)
_AT = re.compile(r"\s?[\[({<]\s?(?:@|＠|at|AT|At|arroba)\s?[\])}>]\s?|\s?[@＠]\s?|\s(?:at|AT|At|arroba)\s")
_DOT = r"(?:\s?[\[({<]\s?(?:\.|dot|DOT|Dot|punto|punkt|point)\s?[\])}>]\s?|\s(?:dot|DOT|Dot|punto|punkt|point)\s|\s?\.\s?)"
_LABELS = re.compile(rf"[\w-]+(?:{_DOT}[\w-]+){{0,5}}")
_DOTS = re.compile(_DOT)
_LEFT = re.compile(rf"[\w%+-]+(?:{_DOT}[\w%+-]+){{0,3}}$")
#: Common top-level domains, and cue words before a span.
TLDS = frozenset("com org net edu gov io info biz co uk de fr es it nl eu ch at be us ca ai app dev me example test".split())
CUES = frozenset("phone tel telephone call fax mobile cell number nummer telefon téléphone teléfono card visa mastercard credit karte carte tarjeta ip host server address adresse mail email correo contact kontakt write reach order invoice isbn version page date total price".split())


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind, then start; linear in the text's length."""
    found, at, past = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > past and not _LOCAL_END.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((EMAIL, start, m.end()))
            past = m.end()
        else:
            past = max(past, at)  # no later match begins before this sign
        at = text.find("@", max(past, at + 1))
    found += [(IP, *m.span()) for m in _IP.finditer(text) if all(int(p[-9:]) <= 255 and (len(p) < 10 or not p[:-9].strip("0")) for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if len(m[0]) <= 40 and 13 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            found.append((CARD, *m.span()))
    if "+" in text:
        found += [(PHONE, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return found


def _side(c: str) -> str:
    return "edge" if not c else "word" if c.isalnum() or c == "_" else "blank" if c.isspace() else c


def _cue(text: str, at: int) -> str:
    words = re.findall(r"[^\W\d_]+", text[max(0, at - 24) : at].lower())
    return next((w for w in reversed(words[-3:]) if w in CUES), "none")


def _numbers(text: str) -> Iterator[Candidate]:
    pieces = [(m.start(), m[0]) for m in _PIECE.finditer(text)]
    numeric = [p.isdigit() and p.isascii() for _, p in pieces]
    colons = ":" in text
    for i, (a, p) in enumerate(pieces):
        first = numeric[i] or p in "+(" and i + 1 < len(pieces) and (numeric[i + 1] or pieces[i + 1][1] == "(") or colons and len(p) <= 4 and all(c in "abcdefABCDEF" for c in p)
        if not first or i and pieces[i - 1][1][-1].isalnum() and p not in "+(":
            continue
        groups, digits, seps, last_sep = [], "", set(), ""
        for j in range(i, min(len(pieces), i + MOST_PIECES)):
            b, q = pieces[j]
            if numeric[j] and not (groups and j and numeric[j - 1]):
                if groups and not last_sep:
                    break
                groups.append(q)
                digits += q
                if last_sep:
                    seps.add(last_sep.strip() or " ")
                last_sep = ""
                end = b + len(q)
                if len(digits) > 19 or not (len(digits) >= 4 and len(groups) > 3 or len(digits) >= 7):
                    continue
                if end < len(text) and text[end].isalnum():
                    continue
                types = []
                if len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups):
                    types.append(IP)
                if 12 <= len(digits) <= 19:
                    types.append(CARD)
                if 7 <= len(digits) <= 15:
                    types.append(PHONE)
                if types:
                    yield a, end, _number_features(text, a, end, p, groups, digits, seps), tuple(types)
            elif q in "().-/+[] –‑·, \t" or q in ("dot", "DOT", "point", "punto", "punkt"):
                last_sep += q
                if len(last_sep) > 7:
                    break
            else:
                break
    if colons:
        for m in re.finditer(r"(?<![\w:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![\w:])", text):
            parts = m[0].split(":")
            yield m.start(), m.end(), ("v6", f"v6 full {len(parts) == 8}", f"v6 gap {'::' in m[0]}", f"v6 letters {bool(re.search('[a-fA-F]', m[0]))}", f"v6 parts {len(parts)}", f"v6 long {max(map(len, parts)) > 2}"), (IP,)


def _number_features(text: str, a: int, b: int, first: str, groups: list[str], digits: str, seps: set[str]) -> tuple[str, ...]:
    sep = "|".join(sorted(seps)) or "none"
    shape, head = "-".join(str(len(g)) for g in groups[:7]), "+" if first == "+" else "(" if first == "(" else "00" if digits[:2] == "00" else "0" if digits[0] == "0" else "n"
    left, right = _side(text[a - 1 : a]), _side(text[b : b + 1])
    follows = right in (".", "-", "/", ",", ":") and text[b + 1 : b + 2].isdigit()
    leads = left in (".", "-", "/", ",", ":", "$", "#") and (left in "$#" or text[a - 2 : a - 1].isdigit())
    cue = _cue(text, a)
    date = len(groups) == 3 and any(len(g) == 4 and g[:2] in ("19", "20") for g in (groups[0], groups[2])) and max(map(len, groups)) == 4
    return (
        "number", f"digits {len(digits)}", f"shape {shape}", f"sep {sep}", f"sep {sep} {len(digits)}", f"head {head}", f"head {head} {len(groups)}", f"luhn {luhn(digits)} {12 <= len(digits)}",
        f"groups {min(len(groups), 8)}", f"left {left}", f"right {right}", f"goes on {follows}", f"began {leads}", f"date {date}", f"cue {cue}", f"cue {cue != 'none'} {head} {shape}",
        f"issuer {digits[0]} {len(digits) in (15, 16)} {luhn(digits)}", f"even {len({len(g) for g in groups}) == 1}", f"odd signs {len(seps) > 2}",
    )


def _addresses(text: str) -> Iterator[Candidate]:
    for m in _AT.finditer(text):
        sign, left, right = m[0].strip(), _LEFT.search(text[max(0, m.start() - 64) : m.start()]), _LABELS.match(text, m.end())
        if not left or not right:
            continue
        offset = max(0, m.start() - 64)
        starts = [offset + left.start()]
        inner = left[0]
        starts += [offset + left.start() + d.end() for d in _DOTS.finditer(inner)]
        ends = [right.start() + d.start() for d in _DOTS.finditer(right[0])] + [right.end()]
        kind = "sign" if sign in "@＠" else "bracket" if sign[0] in "[({<" else "word"
        for a in starts[-3:]:
            for n, b in enumerate(ends):
                domain = text[m.end() : b]
                dots = _DOTS.findall(domain)
                if not dots:
                    continue
                labels, local = _DOTS.split(domain), text[a : m.start()]
                dot = "|".join(sorted({"sign" if d.strip() == "." and d == "." else "spaced" if d.strip() == "." else "bracket" if d.strip()[0] in "[({<" else "word" for d in dots}))
                yield a, b, (
                    "address", f"at {kind}", f"dot {dot}", f"at {kind} dot {dot}", f"tld {labels[-1].lower() in TLDS}", f"tld {labels[-1].lower() in TLDS} {kind} {dot}", f"tld size {min(len(labels[-1]), 7)}", f"labels {len(labels)}",
                    f"more {n + 1 < len(ends)}", f"more tld {n + 1 < len(ends) and text[right.start() : ends[n + 1]].split('.')[-1].strip().lower() in TLDS}", f"full left {a == starts[0]}", f"left dot {any(d != '.' for d in _DOTS.findall(local))}",
                    f"local {min(len(local), 9)}", f"digit {any(c.isdigit() for c in local)}", f"left {_side(text[a - 1 : a])}", f"right {_side(text[b : b + 1])}", f"cue {_cue(text, a)}", f"tight {m[0] == sign}",
                ), (EMAIL,)


def candidates(text: str) -> list[Candidate]:
    return [*_addresses(text), *_numbers(text)]


def islands(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of text around signs of personal data, cut at blanks where there are some."""
    start = stop = -1
    for m in _ANCHOR.finditer(text):
        if stop >= 0 and m.start() - REACH <= stop:
            stop = m.end() + REACH
            continue
        if stop >= 0:
            yield start, min(stop, len(text))
        start, stop = max(0, m.start() - REACH), m.end() + REACH
    if stop >= 0:
        yield start, min(stop, len(text))


_WORDS = "the of and to in is that for with from this was la de les que et der die und ein mit el los por una con retion thea ourepa ernd heit achlich aiment onre server meeting room report page note about list item value sample".split()


def example(rng: random.Random) -> tuple[str, set[tuple[int, int, int]]]:
    """A made-up sentence with its spans."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: rng.choice(_WORDS) if rng.random() < 0.7 else "".join(rng.choice("abcdefghilmnoprstuvwé") for _ in range(rng.randint(2, 9)))
    pick = rng.choice

    def card() -> str:
        d = pick("3456") + digits(pick((14, 15, 15, 15, 12)) - 1)
        return next(d + str(c) for c in range(10) if luhn(d + str(c)))

    def email() -> str:
        local = pick(("", word() + ".", word() + "_", pick("abcdef") + ".")) + word() + pick(("", digits(2)))
        names = [pick((word(), "mail", "example", "mail" + digits(1)))] + ([pick((word(), "example"))] if rng.random() < 0.3 else []) + [pick(sorted(TLDS))]
        at = pick((" at ", " AT ", "(at)", "[at]", " (at) ", " [at] ", "{at}", " @ ", "＠", "@", " arroba "))
        dot = pick((" dot ", " DOT ", "(dot)", "[dot]", " [dot] ", " (dot) ", "[.]", " . ", ".", " punto "))
        if at == "@" and dot == ".":
            local += "é"
        if at in (" at ", " AT ", " arroba ") and dot == " . ":
            dot = "."
        return (local.replace(".", dot) if dot in (" dot ", "[dot]") else local) + at + dot.join(names)

    def ip() -> str:
        if rng.random() < 0.25:
            parts = ["".join(pick("0123456789abcdef") for _ in range(rng.randint(1, 4))) for _ in range(8)]
            return ":".join(parts) if rng.random() < 0.5 else ":".join(parts[:2]) + "::" + ":".join(parts[2 : rng.randint(3, 5)])
        return pick(("[.]", "(.)", " . ", "[dot]", " dot ", "(dot)")).join(str(rng.randint(1, 255)) for _ in range(4))

    def phone() -> str:
        a, b, c, s = digits(3), digits(3), digits(4), pick("- ./")
        shown = pick((f"({a}) {b}-{c}", f"({a}){b}-{c}", f"{a}{s}{b}{s}{c}", f"1{s}{a}{s}{b}{s}{c}", f"+1/{a}/{b}/{c}", f"+1 {a} {b} {c}", f"0{digits(2)} {digits(4)} {digits(4)}", f"00{digits(2)} {digits(3)} {digits(7)}", f"0{digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}", f"0{digits(2)}/{digits(7)}", f"0{digits(3)} {digits(6)}", f"0{digits(3)}-{digits(7)}", f"{digits(3)} {digits(2)} {digits(2)} {digits(2)}"))
        return shown.replace("+1/", "+1/")

    def split_card() -> str:
        d, s = card(), pick((".", "/", " ", " - ", "  ", ". ", "_", "‑"))
        s = "." if s == "_" else s
        return s.join(d[i : i + 4] for i in range(0, len(d), 4))

    def other() -> str:
        year = str(rng.randint(1950, 2030))
        return pick((
            f"{year}-{digits(2)}-{digits(2)}", f"{digits(2)}.{digits(2)}.{year}", f"{digits(2)}/{digits(2)}/{year}", f"v{digits(1)}.{digits(2)}.{digits(1)}", f"version {digits(1)}.{digits(2)}.{digits(1)}.{digits(3)}0{digits(2)}", f"${digits(1)},{digits(3)}.{digits(2)}", f"{digits(2)}.{digits(3)}.{digits(3)},{digits(2)}",
            f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", f"order {digits(9)}", f"#{digits(8)}", digits(16), digits(20), f"{year}-{year}", f"{digits(2)}:{digits(2)}:{digits(2)}", f"{digits(3)} + {digits(4)}", f"{digits(2)} at {digits(2)}", f"at {word()}. {word().title()} {word()}", f"look at {word()} . {word()}",
            f"sec. {digits(1)}.{digits(1)}.{digits(1)}", f"token = \"{''.join(pick('0123456789abcdef') for _ in range(40))}\"", f"{digits(1)}, {digits(2)}, {digits(2)}, {digits(1)}, {digits(2)}", f"{digits(2)} {digits(2)} {digits(2)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}", f"{digits(3)}.{digits(6)}, {digits(2)}.{digits(6)}", f"{word()} at {word()} point", f"@{word()}", f"{word()}@{word()}", f"{year} {year} {year}", f"{rng.randint(256, 999)}.{digits(3)}.{digits(3)}.{digits(3)}", f"ID {digits(6)}-{digits(4)}", f"{digits(13)}", f"the dot at {word()} dot {word()}", f"{digits(1)}.{digits(7)}",
        ))

    text, gold = " ".join(word() for _ in range(rng.randint(0, 6))), set()
    for _ in range(rng.randint(1, 3)):
        kind = pick((EMAIL, IP, CARD, PHONE, None, None, None))
        cue = {EMAIL: ("email", "contact", "mail"), IP: ("ip", "host", "server"), CARD: ("card", "visa"), PHONE: ("phone", "tel", "call", "fax")}.get(kind, ("order", "page", "version"))
        shown = other() if kind is None else {EMAIL: email, IP: ip, CARD: split_card, PHONE: phone}[kind]()
        text += (" " if text else "") + (pick(cue) + pick((" ", ": ")) if rng.random() < 0.35 else "")
        if kind is not None:
            gold.add((len(text), len(text) + len(shown), kind))
        text += shown + pick(("", "", ".", ",", "!", ")", "***")) + "".join(" " + word() for _ in range(rng.randint(0, 6)))
    return text, gold


@lru_cache(maxsize=1)
def field() -> SemiCRF:
    """The trained field."""
    rng, examples = random.Random(17), []
    for _ in range(EXAMPLES):
        text, gold = example(rng)
        base = base_spans(text)
        offered = [c for c in candidates(text) if not any(a < c[1] and c[0] < b for _, a, b in base)]
        examples.append((offered, {g for g in gold if not any(a < g[1] and g[0] < b for _, a, b in base)}))
    return SemiCRF(len(KINDS)).fit(examples)


def all_spans(text: str, model: SemiCRF) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans), each (kind, start, end) by kind, then start."""
    if not _ANCHOR.search(text):
        return [], []
    base, added, taken = base_spans(text), [], []
    for a, b in sorted((a, b) for _, a, b in base):  # their union, as stretches in order
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    at = 0
    for start, stop in islands(text):
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        near, last, rest = [], start, []
        for n in range(at, len(taken)):
            a, b = taken[n]
            if a >= stop:
                break
            near.append((a - start, b - start))
            rest.append(text[last : max(last, a)])
            last = b
        if not any(map(_ANCHOR.search, [*rest, text[last:stop]])):
            continue  # every sign belongs to a base span: nothing can be added
        part, ends = text[start:stop], [b for _, b in near]

        def free(c: Candidate, near=near, ends=ends) -> bool:
            n = bisect_right(ends, c[0])
            return n == len(near) or near[n][0] >= c[1]

        added += [(kind, start + a, start + b) for a, b, kind in model.decode(list(filter(free, candidates(part))))]
    return base, sorted({*base, *added})


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans: arrays of (kind, start, end), in code points, end exclusive."""
    model = field()

    @F.pandas_udf("base array<struct<kind:string,start:long,end:long>>, spans array<struct<kind:string,start:long,end:long>>")
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [all_spans(t, model) for t in texts]
            yield pd.DataFrame({n: [[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in f[i]] for f in found] for i, n in enumerate(("base", "spans"))})

    return docs.select("doc_id", spans(whole_text()).alias("s")).select("doc_id", "s.*")


def redact(text: str, model: SemiCRF) -> str:
    """The text with each span, overlapping ones together, replaced by its kind in brackets."""
    out, past = [], 0
    for start, stop, kind in sorted((a, b, k) for k, a, b in all_spans(text, model)[1]):
        if start >= past:
            out += [text[past:start], f"[{KINDS[kind].upper()}]"]
        past = max(past, stop)
    return "".join(out) + text[past:]


def redacted(docs: DataFrame) -> DataFrame:
    """docs with personal data replaced in text (null stays null) and n_chars to fit, all columns kept."""
    model = field()

    @F.pandas_udf("string")
    def change(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: None if t is None else redact(t, model))

    rows = docs.withColumn("text", change("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else rows


def op1_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find(documents(spark, sf_dir)).select("doc_id", *map(of, KINDS), F.sha2(shown("base"), 256).alias("base_sha256"), shown("spans").alias("spans"))
