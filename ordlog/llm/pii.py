"""Personal data by candidates and gradient boosting.

Generators with high recall propose spans, which may overlap: the four base kinds, which always stay, and wider ones for credentials, for other
numbers that name a person or an account, for written-out mail addresses and for IPv6. Boosted trees of depth two, with features of a span's form
and of the words before it, score the wide ones; a kind's threshold is the least calibrated score from which held-out spans were nearly all
right. Of overlapping spans the base one stays, then the likelier one.

The tables have no labels for spans, so the trees learn from texts that are made here, in which it is known what is personal: TEMPLATES with values drawn
at random, personal ones and others of like form (dates, versions, times, prices, lists, words in place of secrets), between random words. Whole
templates are held out; they alone set the calibration, the thresholds and the precision and recall that the model tells.

Spans are found, described, scored and chosen by DataFrame functions inside one projection: no row is exploded or shuffled, and no Python runs on
the executors. Training collects the features of the made texts' spans only.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base kinds in order, each with the form of its spans. Java's possessive quantifiers match what the plain ones would here, without a stack.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: The generators of further spans; a span's kind follows from its form.
CREDENTIAL = r"(?i)(?:\b(?:pass(?:word|wd)?|pwd|secret|token|api[_-]?key|access[_-]?key)\b\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_/+.=-]{6,}+[\"']?|\b(?:AKIA|ASIA|ghp_|sk-)[A-Za-z0-9]{12,}+)"
NUMBER = r"(?:\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b|\(?\b[0-9]{2,6}\)?(?:[\x20./-]{1,2}[0-9]{2,8}(?![0-9A-Za-z_]))++)"
FORM = r"(?<![0-9])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4})(?![0-9])"
MAIL = r"(?i)(?:\G|(?<![a-z0-9._%+-]))[a-z0-9._%+-]++\s{0,2}[\[({]\s?at\s?[\])}]\s{0,2}[a-z0-9-]++(?:\s{0,2}(?:\.|[\[({]\s?dot\s?[\])}])\s{0,2}[a-z0-9-]++)++"
IPV6 = r"(?i)(?<![0-9a-z_:.])[0-9a-f]{0,4}(?::[0-9a-f]{0,4}){2,7}(?![0-9a-z_:])"
KINDS = ("email", "ip", "card", "phone", "secret", "iban", "ssn", "number", "mail", "ipv6")
_WORDS = {
    "secret": r"(?i)(pass|pwd|secret|token|key|login)\W*$", "phone": r"(?i)(phone|call|tel|mobile|fax|sms)\W*$",
    "money": r"(?i)(iban|account|card|bank|visa)\W*$", "person": r"(?i)(ssn|social|security|passport|tax|id)\W*$",
}
FEATURES = ("chars", "digits", "letters", "uppers", "seps", "distinct", "luhn", "keyed", "issuer", "iban", "ssn", "phone_like", "date_like", "before_secret", "before_phone", "before_money", "before_person", "groups", "colons", "at", "after_digit")
TREES, RATE, PRECISION, SEED = 120, 0.3, 0.95, 3
#: Characters before a span that are looked at, and matches in a chunk.
BEFORE, CHUNK = 24, 256
#: Texts made of each template; every HELD-th template is held out.
EXAMPLES, HELD = 40, 4


def let(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x), where x is evaluated once however often it is used."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def in_chunks(xs: Column, use: Callable[[Column, Column], Column]) -> Column:
    """use(number, chunk) of each CHUNK elements; one empty chunk for none. xs is evaluated for each chunk."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(xs) - 1) / CHUNK).cast("int"))), lambda i: use(i, F.slice(xs, i * CHUNK + 1, F.lit(CHUNK))))


def found(text: Column, pattern: str, guard: str | None = None) -> Column:
    """The leftmost matches that don't overlap, as structs (start, end, hit, before): places in code points, and the BEFORE characters ahead. A match's
    place is the sum of what stands before it: the text is split at the same matches, and pieces and matches alternate. Sums run in chunks, which
    are put after one another, so that many matches in one text don't copy the list of all at each."""
    none = F.array().cast("array<struct<start:int,end:int,hit:string,before:string>>")
    hits, parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    tail = lambda x: F.right(x, F.lit(BEFORE))
    pair = F.filter(F.zip_with(hits, parts, lambda h, p: F.struct(h.alias("hit"), F.length(p).alias("gap"), tail(p).alias("tail"))), lambda x: x["hit"].isNotNull())

    def step(acc: Column, x: Column) -> Column:
        lo = acc["at"] + x["gap"]
        hi = lo + F.length(x["hit"])
        before = tail(F.concat(acc["before"], x["tail"]))
        return F.struct(hi.alias("at"), tail(F.concat(before, tail(x["hit"]))).alias("before"), F.concat(acc["out"], F.array(F.struct(lo.alias("start"), hi.alias("end"), x["hit"].alias("hit"), before.alias("before")))).alias("out"))

    def chunks(pairs: Column) -> Column:
        # Each match has a character at least, so the last BEFORE matches hold all that can stand before the next one.
        ahead = lambda i: F.slice(pairs, F.greatest(F.lit(1), i * CHUNK - BEFORE + 1), F.least(F.lit(BEFORE), i * CHUNK))
        first = lambda i: tail(F.array_join(F.transform(ahead(i), lambda x: F.concat(x["tail"], tail(x["hit"]))), ""))
        return in_chunks(pairs, lambda i, own: F.aggregate(own, F.struct(F.lit(0).alias("at"), first(i).alias("before"), none.alias("out")), step))

    def joined(cs: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        offsets = F.aggregate(cs, start, lambda acc, c: F.struct((acc["at"] + c["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        moved = lambda c, o: F.transform(c["out"], lambda s: F.struct((s["start"] + o).alias("start"), (s["end"] + o).alias("end"), s["hit"].alias("hit"), s["before"].alias("before")))
        return F.flatten(F.zip_with(cs, offsets, moved))

    return F.when(F.rlike(text, F.lit(guard or pattern)), let(let(pair, chunks), joined)).otherwise(none)


def without_beaten(xs: Column, others: Column, beats: Callable[[Column, Column], Column]) -> Column:
    """The spans that none of `others` beats; beats(other, span) holds only for spans that meet. A chunk is held against those that meet its range."""

    def keep(_: Column, own: Column) -> Column:
        limits = lambda b: F.struct(F.array_min(F.transform(b, lambda s: s["start"])).alias("lo"), F.array_max(F.transform(b, lambda s: s["end"])).alias("hi"))
        close = lambda b: let(limits(b), lambda r: F.filter(others, lambda o: (o["start"] < r["hi"]) & (o["end"] > r["lo"])))
        return let(own, lambda b: let(close(b), lambda near: F.filter(b, lambda s: ~F.exists(near, lambda o: beats(o, s)))))

    return let(xs, lambda every: F.flatten(in_chunks(every, keep)))


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of each base kind that pass its check."""
    size = lambda s, a, b: F.length(digits(s["hit"])).between(a, b)
    return {
        "email": found(text, BASE["email"], "@"),
        "ip": F.filter(found(text, BASE["ip"], r"[0-9]\.[0-9]"), lambda s: F.rlike(s["hit"], F.lit(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))),
        "card": F.filter(found(text, BASE["card"], r"[0-9](?:[\x20-]?[0-9]){15}"), lambda s: size(s, 16, 19) & F.call_function("luhn_check", digits(s["hit"]))),
        "phone": F.filter(found(text, BASE["phone"], r"\+[0-9]"), lambda s: size(s, 8, 15)),
    }


def kind_of(hit: Column) -> Column:
    return (
        F.when(F.rlike(hit, F.lit("^[A-Z]{2}[0-9]{2}")), "iban").when(F.rlike(hit, F.lit("[A-Za-z]")), "secret")
        .when(F.rlike(hit, F.lit("^[0-9]{3}-[0-9]{2}-[0-9]{4}$")), "ssn").when(F.rlike(hit, F.lit(r"^\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}$")), "phone").otherwise("number")
    )


def features(hit: Column, before: Column) -> list[Column]:
    """FEATURES of a span and the text before it."""
    flag = lambda x, p: F.when(F.rlike(x, F.lit(p)), 1.0).otherwise(0.0)
    left = lambda p: F.length(F.regexp_replace(hit, p, "")).cast("double")
    return [
        F.length(hit).cast("double"), left("[^0-9]"), left("[^A-Za-z]"), left("[^A-Z]"), left("[A-Za-z0-9]"), F.size(F.array_distinct(F.split(hit, ""))).cast("double"),
        F.when(F.call_function("luhn_check", digits(hit)), 1.0).otherwise(0.0), flag(hit, "[=:]"), flag(hit, "^(AKIA|ASIA|ghp_|sk-)"), flag(hit, r"^[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"),
        flag(hit, "^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), flag(hit, r"^\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}$"), flag(hit, r"^(19|20)[0-9]{2}[-/.][0-9]{1,2}|[-/.](19|20)[0-9]{2}$"),
        *[flag(before, p) for p in _WORDS.values()], F.size(F.regexp_extract_all(hit, F.lit("[0-9]+"), F.lit(0))).cast("double"), left("[^:]"), flag(hit, r"(?i)[\[({]\s?at\s?[\])}]"),
        # Numbers go on from one to the next; what begins otherwise is no less likely after one.
        F.when(F.rlike(before, F.lit(r"[0-9]\W{1,2}$")) & F.rlike(hit, F.lit("^[(0-9]")), 1.0).otherwise(0.0),
    ]


def wide_spans(text: Column) -> Column:
    """The wide generators' spans with kind, generator and features: (kind, start, end, hit, by, x)."""

    def described(by: int, spans: Column, kind: Callable[[Column], Column] = kind_of) -> Column:
        def one(s: Column) -> Column:
            return F.struct(kind(s["hit"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit"), F.lit(by).alias("by"), F.array(*features(s["hit"], s["before"])).alias("x"))

        return F.transform(spans, one)

    return F.concat(
        described(0, found(text, CREDENTIAL, "[=:]|AKIA|ASIA|ghp_|sk-")), described(1, found(text, NUMBER, "[0-9]")), described(2, found(text, FORM, "[0-9]{3}[^0-9]")),
        described(3, found(text, MAIL, r"(?i)[\[({]\s?at\s?[\])}]"), lambda _: F.lit("mail")), described(4, found(text, IPV6, "(?i):[0-9a-f]{0,4}:"), lambda _: F.lit("ipv6")),
    )


@dataclass
class Forest:
    """Trees of depth two: (feature, cut, four leaves by the sides of two features), scores summed, and a threshold for each kind."""

    trees: list[tuple[int, float, int, float, tuple[float, float, float, float]]]
    prior: float
    slope: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    #: (precision, recall) of each kind over the held-out spans.
    quality: dict[str, tuple[float, float]] = field(default_factory=dict)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        for f, c, g, d, leaves in self.trees:
            out += np.array(leaves)[2 * (x[:, f] > c) + (x[:, g] > d)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.raw(x) + self.shift)))

    def column(self, x: Column) -> Column:
        total = F.lit(self.prior)
        for f, c, g, d, (a, b, e, h) in self.trees:
            low, high = F.when(F.get(x, F.lit(g)) > d, b).otherwise(a), F.when(F.get(x, F.lit(g)) > d, h).otherwise(e)
            total = total + F.when(F.get(x, F.lit(f)) > c, high).otherwise(low)
        return 1 / (1 + F.exp(-(total * self.slope + self.shift)))


def fit(x: np.ndarray, y: np.ndarray, kinds: list[str], held: np.ndarray | None = None) -> Forest | None:
    """Newton boosting on the spans that aren't held out (each fifth is, if not told); the held ones calibrate scores and thresholds. A kind that
    no held span has takes its threshold from all. None without both kinds of label."""
    held = np.arange(len(y)) % 5 == 4 if held is None else held
    a, b = x[~held], y[~held]
    if not len(b) or b.min() == b.max():
        return None
    out = Forest([], float(np.log(b.mean() / (1 - b.mean()))))
    cuts = [(f, c) for f in range(x.shape[1]) for c in np.unique(np.quantile(a[:, f], np.linspace(0, 1, 12)[:-1]))]
    sides = np.array([a[:, f] > c for f, c in cuts])
    score, rnd, of = np.full(len(b), out.prior), np.random.default_rng(SEED), np.array([f for f, _ in cuts])
    for _ in range(TREES):
        seen = np.isin(of, rnd.choice(x.shape[1], (x.shape[1] + 1) // 2, False))  # half the features for each tree, so that it leans on no single one
        p = 1 / (1 + np.exp(-score))
        g, h = b - p, p * (1 - p)
        gain = lambda m: (m @ g) ** 2 / (m @ h + 1)
        first = int(np.argmax(np.where(seen, gain(sides) + gain(~sides), -1)))
        s = sides[first]
        second = int(np.argmax(np.where(seen, sum(gain(q & w) for q in (sides, ~sides) for w in (s, ~s)), -1)))
        at = 2 * s + sides[second]
        leaves = tuple(float(RATE * g[at == k].sum() / (h[at == k].sum() + 1)) for k in range(4))
        out.trees.append((cuts[first][0], float(cuts[first][1]), cuts[second][0], float(cuts[second][1]), leaves))
        score = score + np.array(leaves)[at]
    raw, truth = out.raw(x[held]), y[held]
    if len(truth):
        def loss(k: float, s: float) -> float:
            p = 1 / (1 + np.exp(-(k * raw + s)))
            return float(-(truth * np.log(p + 1e-9) + (1 - truth) * np.log(1 - p + 1e-9)).mean())

        out.slope, out.shift = min(((k, s) for k in np.linspace(0.25, 3, 12) for s in np.linspace(-1.5, 1.5, 13)), key=lambda v: loss(*v))
    names, p = np.array(kinds), out.probability(x)
    for kind in sorted(set(kinds)):
        own = (names == kind) & held if ((names == kind) & held & (y == 1)).any() else names == kind
        for t in np.unique(p[own]):
            if t >= 0.5 and y[own & (p >= t)].mean() >= PRECISION:
                out.thresholds[kind] = float(t) * (1 - 1e-9)
                out.quality[kind] = float(y[own & (p >= t)].mean()), float(y[own & (p >= t)].sum() / max(1, y[own].sum()))
                break
    return out


def examples(n: int = EXAMPLES, seed: int = SEED) -> list[tuple[str, int, int, bool, int]]:
    """(text, start, end, personal, template): n texts of each template, each with one value between random words."""
    rnd = np.random.default_rng(seed)
    pick = lambda chars, k: "".join(rnd.choice(list(chars), k))
    one = lambda *xs: xs[int(rnd.integers(len(xs)))]
    num, hexa, word = (lambda k: pick("0123456789", k)), (lambda k: pick("0123456789abcdef", k)), (lambda k: pick("abcdeilnorst", k))
    big, mixed = (lambda k: pick("ABCDEFGHJKLMNPQRSTUVWXYZ234567", k)), (lambda k: pick("abcdefghijkmnpqrstuvwxyzABCDEFGHKLMNPQRSTUVWXYZ23456789", k))
    less = lambda k, top: f"{int(rnd.integers(1, top)):0{k}d}"
    year = lambda: str(int(rnd.integers(1900, 2040)))
    any_ = lambda lo, hi: int(rnd.integers(lo, hi))
    sign, quote = (lambda: one("=", ": ", " = ", ":")), (lambda v: one(v, f'"{v}"', f"'{v}'"))
    # (words before, value, whether it is personal). Neighbours are alike, so that what is held out has relatives among the others.
    templates = [
        lambda: ("", f"{one('password', 'passwd', 'pwd')}{sign()}{quote(hexa(any_(12, 24)))}", True), lambda: ("", f"{one('password', 'pwd')}{sign()}{quote(mixed(any_(12, 20)))}", True), lambda: ("", f"token{sign()}{quote(hexa(40))}", True), lambda: ("", f"{one('token', 'access_token')}{sign()}{quote(mixed(any_(24, 60)))}", True),
        lambda: ("", f"{one('api_key', 'apikey', 'api-key')}{sign()}{quote(hexa(any_(20, 33)))}", True), lambda: ("", f"secret{sign()}{quote(word(6) + num(4) + word(5))}", True), lambda: ("", f"{one('AKIA', 'ASIA')}{big(16)}", True), lambda: ("", f"{one('ghp_', 'sk-')}{mixed(any_(30, 40))}", True),
        lambda: ("", f"{one('password', 'pwd')}{sign()}{quote(word(any_(6, 11)))}", False), lambda: ("", f"{one('secret', 'token')}{sign()}{quote(word(any_(8, 14)))}", False), lambda: ("", f"token{sign()}{pick('ab', any_(6, 12))}", False), lambda: ("", f"{one('pass', 'token')}{sign()}{one('required', 'optional', 'missing', 'expired', 'your-password-here', 'changeme')}", False),
        lambda: (one("call ", "tel ", "phone: "), f"{num(3)}-{num(3)}-{num(4)}", True), lambda: (one("", "fax "), f"({num(3)}) {num(3)}-{num(4)}", True), lambda: (one("", "mobile "), f"{num(3)}.{num(3)}.{num(4)}", True), lambda: (one("call ", "sms "), f"{num(3)} {num(3)} {num(4)}", True),
        lambda: (one("ssn ", "social security "), f"{num(3)}-{num(2)}-{num(4)}", True), lambda: ("", f"{num(3)}-{num(2)}-{num(4)}", True), lambda: (one("tax id ", "id: "), f"{num(3)}-{num(2)}-{num(4)}", True), lambda: (one("", "ssn: "), f"{num(3)}-{num(2)}-{num(4)}", True),
        lambda: (one("iban ", "IBAN: "), f"{one('DE', 'GB', 'AT')}{num(2)} {num(4)} {num(4)} {num(4)} {num(4)} {num(2)}", True), lambda: ("", f"{one('DE', 'ES')}{num(20)}", True), lambda: (one("account ", ""), f"{one('FR', 'NL')}{num(2)} {num(4)} {num(4)} {num(4)} {num(2)}", True), lambda: ("", f"{one('IT', 'DE')}{num(2)} {num(4)} {num(4)} {num(4)} {num(4)}", True),
        lambda: (one("account ", "bank account: "), f"{num(4)} {num(6)}", True), lambda: (one("passport ", "tax id "), f"{num(3)} {num(3)} {num(3)}", True), lambda: (one("account no ", "card "), f"{num(4)}-{num(4)}-{num(2)}", True), lambda: (one("passport ", "ssn "), f"{num(2)} {num(7)}", True),
        lambda: (one("", "on "), f"{year()}-{less(2, 13)}-{less(2, 29)}", False), lambda: (one("", "in ", "of "), f"{less(2, 29)}.{less(2, 13)}.{year()}", False), lambda: ("", f"{less(2, 13)}/{less(2, 29)}/{year()}", False), lambda: (one("from ", ""), f"{year()}-{year()}", False),
        lambda: (one("version ", "v", ""), f"{num(2)}.{num(2)}.{num(3)}", False), lambda: ("", f"{less(3, 999)}.{num(3)}.{num(3)}", False), lambda: (one("pages ", "in "), f"{num(2)}-{num(2)}", False), lambda: (one("release ", ""), f"{num(2)}.{num(2)}.{num(2)}", False),
        lambda: ("", " ".join(num(any_(2, 5)) for _ in range(any_(3, 12))), False), lambda: (one("", "rows "), " ".join(num(3) for _ in range(any_(3, 9))), False), lambda: ("", "-".join(num(any_(2, 5)) for _ in range(any_(3, 9))), False), lambda: (one("", "sums "), " ".join(num(any_(3, 5)) for _ in range(any_(4, 12))), False),
        lambda: ("", f"{num(4)} {num(4)} {num(4)}", False), lambda: (one("", "score "), f"{num(2)}-{num(2)} {num(2)}-{num(2)}", False), lambda: ("", f"{num(3)} {num(3)}", False), lambda: ("", "/".join(num(2) for _ in range(any_(2, 5))), False),
        lambda: ("", f"{word(6)} (at) {word(7)} (dot) com", True), lambda: ("", f"{word(4)}.{word(5)} [at] {word(6)}.org", True), lambda: ("", f"{word(5)}{num(2)}(at){word(8)}.net", True), lambda: ("", f"{word(5)} {{at}} {word(6)} {{dot}} de", True),
        lambda: ("", ":".join(hexa(4) for _ in range(8)), True), lambda: (one("", "from "), f"2001:db8::{hexa(any_(1, 5))}:{hexa(4)}", True), lambda: ("", f"fe80::{hexa(4)}:{hexa(4)}:{hexa(4)}:{hexa(4)}", True), lambda: ("", f"2a0{num(1)}:{hexa(4)}:{hexa(3)}::{hexa(1)}", True),
        lambda: (one("at ", ""), f"{less(2, 24)}:{less(2, 60)}:{less(2, 60)}", False), lambda: ("", f"{less(1, 10)}:{less(2, 60)}:{less(2, 60)}", False), lambda: ("", f"{num(1)}:{num(1)}:{num(1)}", False), lambda: (one("", "at "), f"{less(2, 24)}:{less(2, 60)}:{less(2, 60)}", False),
    ]
    out = []
    for t, make in enumerate(templates):
        for _ in range(n):
            before, value, personal = make()
            lead = " ".join(word(any_(2, 8)) for _ in range(any_(1, 5))) + " " + before
            out.append((f"{lead}{value}{one(' ', ', ', '. ', '; ')}{word(6)}", len(lead), len(lead) + len(value), personal, t))
    return out


def labelled(session, made: list[tuple[str, int, int, bool, int]]) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """(features, labels, kinds, templates) of the wide spans in made texts; a span that meets a personal value is personal."""
    text = json.dumps([{"text": t, "lo": lo, "hi": hi, "y": y, "template": k} for t, lo, hi, y, k in made])
    rows = session.range(1).select(F.explode(F.from_json(F.lit(text), "array<struct<text:string,lo:int,hi:int,y:boolean,template:int>>")).alias("r")).select("r.*")
    spans = rows.select("*", F.explode(wide_spans(F.col("text"))).alias("s"))
    meets = F.col("y") & (F.col("s.start") < F.col("hi")) & (F.col("s.end") > F.col("lo"))
    got = spans.select("template", "s.kind", "s.x", meets.cast("int").alias("y"), "text", "s.start", "s.by").collect()  # of the made texts alone
    got.sort(key=lambda r: (r["template"], r["text"], r["by"], r["start"]))
    return np.array([r["x"] for r in got], float), np.array([r["y"] for r in got], float), [r["kind"] for r in got], np.array([r["template"] for r in got])


def train(docs: DataFrame) -> Forest | None:
    """Trees from the made texts. No row of docs is read: they have no labels for spans."""
    x, y, kinds, template = labelled(docs.sparkSession, examples())
    return fit(x, y, kinds, template % HELD == HELD - 1)


def of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def as_base(kind: str) -> Callable[[Column], Column]:
    return lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["hit"].alias("hit"), F.lit(True).alias("base"))


def spans(docs: DataFrame, model: Forest | None) -> DataFrame:
    """Adds pii, the chosen spans (kind, start, end, hit, base) in order of kind and start; the base ones are those of their rules, whatever else is found."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.concat(*[F.transform(s, as_base(k)) for k, s in base_spans(text).items()])
    out = docs.withColumn("_base", base)
    if model is None or not model.thresholds:
        return out.withColumnRenamed("_base", "pii")
    out = out.withColumn("_wide", wide_spans(text))
    meets = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])

    def limit(kind: Column) -> Column:
        out = F.lit(2.0)
        for k, t in model.thresholds.items():
            out = F.when(kind == k, t).otherwise(out)
        return out

    scored = F.transform("_wide", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit"), s["by"].alias("by"), model.column(s["x"]).alias("p")))
    likely = F.filter(scored, lambda s: s["p"] >= limit(s["kind"]))
    out = out.withColumn("_wide", without_beaten(likely, F.col("_base"), meets))
    better = lambda a, b: meets(a, b) & ((a["p"] > b["p"]) | (a["p"] == b["p"]) & ((a["start"] < b["start"]) | (a["start"] == b["start"]) & ((a["end"] > b["end"]) | (a["end"] == b["end"]) & (a["by"] < b["by"]))))
    best = without_beaten(F.col("_wide"), F.col("_wide"), better)
    own = F.transform(best, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit"), F.lit(False).alias("base")))
    every = F.concat("_base", own)
    ordered = F.concat(*[F.array_sort(F.filter(every, of_kind(k)), lambda a, b: a["start"] - b["start"]) for k in KINDS])
    return out.withColumn("pii", ordered).drop("_base", "_wide")


def redact(docs: DataFrame, model: Forest | None) -> DataFrame:
    """Documents with each span replaced by its kind in brackets; overlapping base spans are replaced once, by the first. Other columns stay."""
    by_start = F.array_sort("pii", lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]"))
        covered = s["start"] < acc["at"]
        return F.struct(F.when(covered, F.greatest(acc["at"], s["end"])).otherwise(s["end"]).alias("at"), F.when(covered, acc["out"]).otherwise(piece).alias("out"))

    done = F.aggregate(by_start, start, step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    found_in = spans(docs.select("text", F.struct("*").alias("_row")), model)  # other columns may have any name
    return found_in.select(*[F.when(F.col("text").isNotNull(), done).alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns])


def digest(docs: DataFrame, model: Forest | None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): counts and places of the spans, base ones hashed.

    Null and empty texts have none; very long ones are read whole; repeated rows and null doc_ids are reported each; other columns are ignored; an
    empty table gives no rows.
    """
    said = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    got = spans(docs.select("doc_id", "text"), model).select("doc_id", "pii")
    base = F.filter("pii", lambda s: s["base"])
    counts = [F.size(F.filter(base, of_kind(k))).cast("bigint").alias(f"n_{k}") for k in BASE]
    return got.select("doc_id", *counts, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("pii")).alias("spans"))
